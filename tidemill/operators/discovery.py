"""Endpoints seen on the network: screened, grouped, judged."""

from __future__ import annotations

from tidemill.operators.base import operator


@operator("observed_requests")
def screen_observed_requests(d):
    """PRJ-24: why a request is not a candidate, in order, or PROMISING."""
    return f"""SELECT req_id, CASE WHEN {d.rx("url", "google-analytics|doubleclick|/collect|/track|/telemetry|/beacon|/pixel|/analytics")} THEN 'REJECTED_NOISE' WHEN position('json' IN content_type) = 0 THEN 'REJECTED_NOT_JSON'
      WHEN request_header_name IN ('authorization', 'cookie', 'x-api-key') THEN 'REJECTED_AUTH' WHEN {d.rx("url", "^https?://([0-9]{1,3}[.]){3}[0-9]{1,3}")} OR {d.rx("url", "^[a-z]+://[^/]*@")} THEN 'REJECTED_NOT_PUBLIC'
      WHEN status < 200 OR status > 299 THEN 'REJECTED_STATUS' ELSE 'PROMISING' END AS verdict FROM @observed_requests"""


@operator("observed_requests", "screen_observed_requests", "endpoint_identity")
def endpoint_candidates(d):
    """AGG-30: per endpoint: requests, pages, shapes, and whether it is validated."""
    shape = d.sub(d.sub("body", r":\s*\x22[^\x22]*\x22", ":str"), r":\s*[0-9.]+", ":num")
    return f"""WITH e AS (SELECT i.identity, count(*) AS n, count(DISTINCT r.page_url) AS pages, count(DISTINCT {shape}) AS shapes, count_if(s.verdict = 'PROMISING') AS promising, min(r.req_id) AS first_req FROM @observed_requests r JOIN @screen_observed_requests s ON r.req_id = s.req_id JOIN @endpoint_identity i ON r.req_id = i.req_id GROUP BY i.identity)
    SELECT identity, n, pages, shapes, first_req, CASE WHEN promising = 0 THEN 'REJECTED' WHEN shapes > 1 THEN 'REJECTED_UNSTABLE' WHEN pages >= 2 THEN 'VALIDATED' ELSE 'PROMISING' END AS state,
      CASE WHEN promising = 0 OR shapes > 1 THEN 'NONE' WHEN pages >= 10 THEN 'HIGH' WHEN pages >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM e"""


@operator("observed_requests", "screen_observed_requests", "endpoint_identity")
def endpoint_runs(d):
    """What one run (a day) saw of an endpoint: its first request's verdict, its requests, shape, and up to 64 pages by hash."""
    shape = d.sub(d.sub("body", r":\s*\x22[^\x22]*\x22", ":str"), r":\s*[0-9.]+", ":num")
    pages = "array_to_string(list_sort(list(DISTINCT page))[1:64], ',')" if d.duck else "array_join(slice(sort_array(collect_set(page)), 1, 64), ',')"
    page = f"substring({d.sha('page_url')}, 1, 16)"
    return f"""WITH o AS (SELECT i.identity, CAST(r.observed_at AS DATE) AS run, r.req_id, s.verdict, {shape} AS shape, {page} AS page FROM @observed_requests r JOIN @screen_observed_requests s ON r.req_id = s.req_id JOIN @endpoint_identity i ON r.req_id = i.req_id),
    g AS (SELECT identity, run, count(*) AS requests, count(DISTINCT CASE WHEN verdict = 'PROMISING' THEN shape END) AS shapes, min(CASE WHEN verdict = 'PROMISING' THEN shape END) AS shape, count(DISTINCT page) AS run_pages, min_by(verdict, req_id) AS first_verdict, {pages} AS pages FROM o GROUP BY identity, run)
    SELECT identity, {d.ext("identity", "//([^/]*)", 1)} AS domain, run, requests, substring({d.sha("shape")}, 1, 16) AS signature, pages,
      CASE WHEN first_verdict <> 'PROMISING' THEN first_verdict WHEN shapes > 1 THEN 'REJECTED_UNSTABLE' END AS rejection, first_verdict = 'PROMISING' AND shapes = 1 AND run_pages >= 2 AS validated FROM g"""


@operator("endpoint_runs")
def endpoint_evidence(d):
    """AGG-31: over daily runs: distinct pages, shape changes, and the state that the last run leads to."""
    pages = f"SELECT identity, count(DISTINCT page) AS pages FROM (SELECT identity, {"unnest(string_split(pages, ','))" if d.duck else "explode(split(pages, ','))"} AS page FROM @endpoint_runs) x GROUP BY identity"
    return f"""WITH c AS (SELECT *, CASE WHEN rejection IS NULL AND lag(signature) OVER (PARTITION BY identity ORDER BY run) <> signature THEN 1 ELSE 0 END AS changed FROM @endpoint_runs),
    p AS ({pages})
    SELECT c.identity, max(domain) AS domain, CAST(sum(requests) AS BIGINT) AS requests, count(*) AS runs, count_if(validated) AS validated, count_if(rejection IS NOT NULL) AS rejected, CAST(sum(changed) AS BIGINT) AS changes, max(least(p.pages, 64)) AS pages, min(run) AS first_seen, max(run) AS last_seen,
      CASE WHEN max_by(coalesce(rejection, ''), run) <> '' THEN 'REJECTED' WHEN max_by(changed, run) = 1 THEN 'REVALIDATION_REQUIRED' WHEN max(p.pages) >= 3 THEN 'VALIDATED' ELSE 'PROMISING' END AS state FROM c JOIN p ON c.identity = p.identity GROUP BY c.identity"""


@operator("endpoint_candidates")
def discovery_summary(d):
    """AGG-32: endpoints by state."""
    return "SELECT state, count(*) AS endpoints, CAST(sum(n) AS BIGINT) AS requests FROM @endpoint_candidates GROUP BY state"


@operator("endpoint_candidates")
def order_candidates(d):
    """TOP-07: rejected last, the most observed first. Places are given within rows of one count, after the sums of the counts before; only those sums meet."""
    return """WITH c AS (SELECT identity, n, state, CASE WHEN state LIKE 'REJECTED%' THEN 1 ELSE 0 END AS late FROM @endpoint_candidates),
    g AS (SELECT late, n, count(*) AS rows_of FROM c GROUP BY late, n),
    b AS (SELECT late, n, coalesce(sum(rows_of) OVER (ORDER BY late, n DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g)
    SELECT c.identity, c.n, c.state, CAST(b.before + row_number() OVER (PARTITION BY c.late, c.n ORDER BY c.identity) AS BIGINT) AS rnk FROM c JOIN b ON c.late = b.late AND c.n = b.n"""


@operator("endpoint_candidates")
def cap_per_group(d):
    """WIN-05: at most 100 endpoints per host."""
    return f"SELECT identity, host, n FROM (SELECT identity, n, {d.ext('identity', '//([^/]*)', 1)} AS host, row_number() OVER (PARTITION BY {d.ext('identity', '//([^/]*)', 1)} ORDER BY n DESC, identity) AS r FROM @endpoint_candidates) x WHERE r <= 100"


@operator("endpoint_candidates", "latency_percentiles")
def compare_routes(d):
    """JOIN-12: validated endpoints against the site's measured latency; savings only where both are known."""
    return f"""SELECT e.identity, e.pages, l.p95 AS current_p95, CASE WHEN e.state = 'VALIDATED' AND l.p95 IS NOT NULL THEN 'MIGRATE' WHEN e.state = 'VALIDATED' THEN 'MEASURE_FIRST' ELSE 'KEEP' END AS recommendation
    FROM @endpoint_candidates e LEFT JOIN @latency_percentiles l ON {d.ext("e.identity", "//api[.]([^/]*)", 1)} = l.domain"""


@operator("observed_requests", "endpoint_identity")
def endpoint_fields(d):
    """The field names that an endpoint's documents have at the top."""
    return f"""SELECT DISTINCT identity, field FROM (SELECT i.identity, {d.json_keys("r.body")} AS field FROM @observed_requests r JOIN @endpoint_identity i ON r.req_id = i.req_id) x"""


@operator("diff_fields", "endpoint_candidates", "endpoint_fields", "extractor_values")
def propose_repairs(d):
    """JOIN-14: for each lost field: a validated endpoint that has it, else another source that still gives it, else a person looks."""
    return """WITH v AS (SELECT f.field, min(f.identity) AS route FROM @endpoint_fields f JOIN @endpoint_candidates e ON f.identity = e.identity WHERE e.state = 'VALIDATED' GROUP BY f.field),
    a AS (SELECT field, count(DISTINCT page_id) AS pages FROM @extractor_values GROUP BY field)
    SELECT l.page_id, l.field, v.route, CASE WHEN v.route IS NOT NULL THEN 'MIGRATE' WHEN a.pages > 0 THEN 'ADD_QUORUM_SOURCE' ELSE 'NEEDS_INVESTIGATION' END AS proposal
    FROM @diff_fields l LEFT JOIN v ON l.field = v.field LEFT JOIN a ON l.field = a.field WHERE l.change = 'lost'"""
