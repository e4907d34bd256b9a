"""Where every URL ended, and what the run did."""

from __future__ import annotations

from tidemill.operators.base import operator
from tidemill.operators.dims import PHASES, PLAYBOOK, VERDICT_DIM

LAST_TIME = "(SELECT max(attempted_at) FROM @attempts)"


@operator("attempts")
def read_attempts(d):
    """SRC-03: the newest attempts first, bounded."""
    return "SELECT attempt_id, url, verdict FROM @attempts ORDER BY attempted_at DESC, attempt_id DESC LIMIT 5000"


@operator("attempts")
def advance_queue(d):
    """PUB-04: the state of each URL after its latest outcome."""
    return """WITH l AS (SELECT url, max_by(verdict, struct_key) AS verdict, count(*) AS attempts, max(attempted_at) AS updated_at FROM (SELECT *, ROW_STRUCT AS struct_key FROM @attempts) a GROUP BY url)
    SELECT url, attempts, verdict, updated_at, CASE WHEN verdict IN ('OK', 'NOT_MODIFIED') THEN 'DONE' WHEN verdict = 'DEAD_URL' THEN 'QUARANTINED' WHEN verdict IN ('ORIGIN_DOWN', 'RATE_LIMITED', 'PROVIDER_ERROR') THEN 'RETRY'
      WHEN attempts >= 30 THEN 'DEAD_ZONE' ELSE 'FAILED' END AS status FROM l""".replace("ROW_STRUCT", "struct_pack(a := attempted_at, b := attempt_id)" if d.duck else "struct(attempted_at, attempt_id)")


@operator("advance_queue")
def status_census(d):
    """AGG-01: URLs by status, and how many could run now."""
    return "SELECT status, count(*) AS urls, count_if(status IN ('PENDING', 'RETRY')) AS runnable FROM @advance_queue GROUP BY status"


@operator("advance_queue", "missing_seeds")
def url_accounting(d):
    """AGG-02: every queued URL in one bucket, and the seeds that never got there; complete only if none is lost or missing."""
    return """WITH s AS (SELECT count(*) AS input_urls, count_if(status NOT IN ('PENDING', 'RETRY', 'IN_PROGRESS')) AS settled, count_if(status IN ('PENDING', 'RETRY')) AS carried, count_if(status = 'IN_PROGRESS') AS lost FROM @advance_queue),
    m AS (SELECT count(DISTINCT url) AS missing FROM @missing_seeds)
    SELECT input_urls, settled, carried, lost, missing, input_urls - settled - carried - lost + missing AS unaccounted, lost = 0 AND missing = 0 AS complete FROM s, m"""


@operator("attempts")
def run_metrics(d):
    """AGG-03: per verdict: URLs, fallbacks, domains, credits known and not."""
    return """SELECT verdict, count(*) AS attempts, count(DISTINCT url) AS urls, count(DISTINCT domain) AS domains, count_if(level = 'L3') AS paid_calls, CAST(sum(cost_credits) AS DOUBLE) AS known_credits,
      count_if(level = 'L3' AND cost_certainty = 'UNKNOWN') AS unknown_cost_calls FROM @attempts GROUP BY verdict"""


@operator("advance_queue")
def run_report(d):
    """AGG-04: coverage of the run; a stricter form counts OK only."""
    return """SELECT count(*) AS total, count_if(verdict IN ('OK', 'NOT_MODIFIED')) AS resolved, count_if(verdict = 'OK') AS resolved_strict, round(count_if(verdict IN ('OK', 'NOT_MODIFIED')) / count(*), 6) AS coverage,
      count_if(verdict IN ('BLOCKED', 'SOFT_BLOCK')) AS paid_candidates, count_if(verdict NOT IN ('OK', 'NOT_MODIFIED', 'DEAD_URL')) AS unresolved FROM @advance_queue"""


@operator("attempts")
def diagnose_failures(d):
    """AGG-10: failures by verdict, normalised reason and level, with cause and share."""
    return f"""WITH g AS (SELECT verdict, substring(lower({d.sub("reason", "[0-9]+", "N")}), 1, 120) AS reason, level, count(*) AS n, min(url) AS sample_url FROM @attempts WHERE verdict NOT IN ('OK', 'NOT_MODIFIED')
      GROUP BY verdict, substring(lower({d.sub("reason", "[0-9]+", "N")}), 1, 120), level)
    SELECT g.verdict, reason, level, n, round(n / sum(n) OVER (), 6) AS share, sample_url, coalesce(cause, 'unclassified failure') AS cause, g.verdict IN ('BLOCKED', 'SOFT_BLOCK') AS may_pay FROM g LEFT JOIN {PLAYBOOK} p ON g.verdict = p.verdict"""


@operator("attempts")
def failure_overview(d):
    """AGG-11: totals, success rate, and the domain with most failures."""
    return """WITH f AS (SELECT domain, count_if(verdict NOT IN ('OK', 'NOT_MODIFIED')) AS failures, count(*) AS n, count_if(verdict IN ('BLOCKED', 'SOFT_BLOCK')) AS payable FROM @attempts GROUP BY domain)
    SELECT CAST(sum(n) AS BIGINT) AS attempts, CAST(sum(failures) AS BIGINT) AS failures, round(1 - sum(failures) / sum(n), 6) AS success_rate, round(sum(payable) / sum(failures), 6) AS payable_share, CAST(max(failures) AS BIGINT) AS worst_domain_failures FROM f"""


@operator("attempts")
def latency_percentiles(d):
    """AGG-13: sorted[min(int(n f), n - 1)] per domain; this is neither nearest rank nor interpolation.

    Rows are counted per latency first, so a domain sends its distinct latencies to one task and not its rows.
    """
    at = lambda f: f"min(CASE WHEN upto > least(CAST(floor(n * {f}) AS BIGINT), n - 1) THEN latency_ms END)"
    return f"""WITH c AS (SELECT domain, latency_ms, count(*) AS k FROM @attempts WHERE latency_ms IS NOT NULL GROUP BY domain, latency_ms),
    r AS (SELECT domain, latency_ms, k, sum(k) OVER (PARTITION BY domain ORDER BY latency_ms ROWS UNBOUNDED PRECEDING) AS upto, sum(k) OVER (PARTITION BY domain) AS n FROM c)
    SELECT domain, {at(0.5)} AS p50, {at(0.95)} AS p95, {at(0.99)} AS p99, round(sum(latency_ms * k) / sum(k), 6) AS mean, max(latency_ms) AS most FROM r GROUP BY domain"""


@operator("advance_queue")
def select_phase(d):
    """PRJ-31: the phases that take a URL, by its latest verdict."""
    return f"SELECT q.url, p.phase FROM @advance_queue q JOIN {PHASES} p ON q.verdict = p.verdict"


@operator("select_phase", "advance_queue")
def phase_disjointness(d):
    """SET-04: retry and paid phases share no URL."""
    return "SELECT count(*) AS in_both FROM (SELECT url FROM @select_phase WHERE phase = 'B' INTERSECT SELECT url FROM @select_phase WHERE phase = 'C') x"


@operator("responses")
def quarantine_dead(d):
    """PRJ-32: what a liveness check says about each URL."""
    return "SELECT page_id, url, CASE WHEN status IN (404, 410) THEN 'quarantine' WHEN status IS NULL OR status = 405 THEN 'inconclusive' ELSE 'alive' END AS outcome FROM @responses"


@operator("attempts")
def quarantine_ledger(d):
    """PUB-05: per dead URL: first and last check, checks, and what was seen."""
    return f"SELECT url, min(attempted_at) AS first_seen, max(attempted_at) AS last_check, count(*) AS checks, {d.joined('verdict', True)} AS verdicts FROM @attempts WHERE verdict = 'DEAD_URL' GROUP BY url"


@operator("advance_queue", "due_urls")
def reopen_urls(d):
    """PUB-06: due URLs go back to PENDING."""
    return "SELECT q.url, CASE WHEN q.status = 'DONE' AND u.url IS NOT NULL THEN 'PENDING' WHEN q.status = 'IN_PROGRESS' THEN 'PENDING' ELSE q.status END AS status FROM @advance_queue q LEFT JOIN @due_urls u ON q.url = u.url"


@operator("advance_queue")
def select_runnable(d):
    """TOP-01: the runnable URLs that waited longest."""
    return "SELECT url, status, updated_at FROM @advance_queue WHERE status IN ('PENDING', 'RETRY') ORDER BY updated_at, url LIMIT 20"


@operator("attempts")
def paid_eligible_urls(d):
    """JOIN-15: blocked URLs that no paid call has been made for."""
    key = "struct_pack(a := attempted_at, b := attempt_id)" if d.duck else "struct(attempted_at, attempt_id)"
    return f"""WITH l AS (SELECT url, max_by(verdict, k) AS verdict FROM (SELECT url, verdict, {key} AS k FROM @attempts) a GROUP BY url)
    SELECT l.url FROM l LEFT JOIN (SELECT DISTINCT url FROM @attempts WHERE level = 'L3' AND cost_certainty = 'EXACT') p ON l.url = p.url WHERE l.verdict IN ('BLOCKED', 'SOFT_BLOCK') AND p.url IS NULL"""


#: Share of disagreeing pages from which a field's quorum deserves a look.
CONFLICTS_TO_ALERT = 0.1


@operator("attempts", "url_accounting", "drift_findings", "validate_staging", "quorum_fields")
def derive_alerts(d):
    """SNK-04: rows that deserve a human: URLs unaccounted for, paid calls of unknown cost, dead zones, drift and staging that block promotion, and quorum conflicts."""
    text = lambda x: f"CAST({x} AS VARCHAR(40))"
    return f"""SELECT 'unaccounted' AS kind, concat({text("unaccounted")}, ' URLs') AS message FROM @url_accounting WHERE unaccounted <> 0
    UNION ALL SELECT 'stranded_paid', concat(provider, ': ', {text("count(*)")}, ' calls of unknown cost') FROM @attempts WHERE cost_certainty = 'UNKNOWN' AND provider IS NOT NULL GROUP BY provider
    UNION ALL SELECT 'dead_zone', domain FROM @attempts GROUP BY domain HAVING count_if(verdict IN ('BLOCKED', 'SOFT_BLOCK')) > 0.5 * count(*)
    UNION ALL SELECT 'drift_block', concat(field, ': ', finding) FROM @drift_findings WHERE severity = 'block'
    UNION ALL SELECT 'promote_rejected', reason FROM @validate_staging WHERE reason <> 'ok'
    UNION ALL SELECT 'quorum_conflict', concat(field, ': ', {text("count_if(agreement = 'conflict')")}, ' of ', {text("count(*)")}) FROM @quorum_fields GROUP BY field HAVING count_if(agreement = 'conflict') > {CONFLICTS_TO_ALERT} * count(*)"""


@operator("observations")
def freshness_state(d):
    """WIN-01: per URL in time order: changed, the check interval, and the last change.

    A body is compared with the last one that was stored; a 304 stores none and never is a
    change, a missing body always is one.
    """
    return f"""WITH h AS (SELECT obs_id, url, observed_at, not_modified, CASE WHEN NOT not_modified THEN {d.sha("trim(" + d.sub("body", r"\s+", " ") + ")")} END AS hash FROM @observations),
    p AS (SELECT *, {d.last_known("hash")} OVER (PARTITION BY url ORDER BY observed_at, obs_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM h),
    c AS (SELECT *, CASE WHEN not_modified THEN 0 WHEN hash IS NULL OR before IS NULL OR hash <> before THEN 1 ELSE 0 END AS changed FROM p),
    g AS (SELECT *, sum(changed) OVER (PARTITION BY url ORDER BY observed_at, obs_id ROWS UNBOUNDED PRECEDING) AS grp FROM c),
    k AS (SELECT *, row_number() OVER (PARTITION BY url, grp ORDER BY observed_at, obs_id) - 1 AS k FROM g)
    SELECT obs_id, url, changed = 1 AS changed, round(least(900 * power(1.5, least(k, 40)), 2592000), 6) AS interval_s, coalesce(max(CASE WHEN changed = 1 THEN observed_at END) OVER (PARTITION BY url ORDER BY observed_at, obs_id ROWS UNBOUNDED PRECEDING), min(observed_at) OVER (PARTITION BY url)) AS last_changed FROM k"""


@operator("freshness_state", "observations")
def due_urls(d):
    """PRJ-33: URLs whose interval has passed at the end of the log."""
    return f"""WITH l AS (SELECT f.url, max_by(f.interval_s, o.obs_id) AS interval_s, max_by({d.epoch("o.observed_at")}, o.obs_id) AS checked FROM @freshness_state f JOIN @observations o ON f.obs_id = o.obs_id GROUP BY f.url)
    SELECT url, interval_s FROM l WHERE (SELECT max({d.epoch("observed_at")}) FROM @observations) - checked >= interval_s"""


@operator("listing_pages")
def traverse_listings(d):
    """WIN-03: fresh keys per page, and why the walk over a listing stops first."""
    return """WITH f AS (SELECT listing_id, record_key, min(page_no) AS page_no FROM @listing_pages GROUP BY listing_id, record_key),
    p AS (SELECT l.listing_id, l.page_no, min(l.cursor_token) AS cursor_token, count(f.record_key) AS fresh FROM @listing_pages l LEFT JOIN f ON l.listing_id = f.listing_id AND l.record_key = f.record_key AND l.page_no = f.page_no GROUP BY l.listing_id, l.page_no),
    r AS (SELECT *, row_number() OVER (PARTITION BY listing_id, cursor_token ORDER BY page_no) AS seen, CAST(sum(fresh) OVER (PARTITION BY listing_id ORDER BY page_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM p)
    SELECT listing_id, page_no, fresh, total, CASE WHEN seen > 1 THEN 'REPEATED_CURSOR' WHEN fresh = 0 THEN 'NO_NEW_RECORDS' WHEN total >= 100 THEN 'EXPECTED_COUNT_REACHED' END AS stop_reason FROM r"""


@operator("fingerprint_failures")
def top_fingerprints(d):
    """TOP-02: the commonest failures."""
    return "SELECT digest, label, count(*) AS n FROM @fingerprint_failures GROUP BY digest, label ORDER BY n DESC, digest LIMIT 500"
