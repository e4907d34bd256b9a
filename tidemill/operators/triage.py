"""Verdicts: one ladder of conditions over status, signatures, size, type and canaries."""

from __future__ import annotations

from tidemill.operators.base import operator
from tidemill.operators.bodies import ACCESS_MARKERS, block_signature, content_kind, csr_shell, first_marker, without_blocks


def first_rule(d, url: str, column: str) -> str:
    """A column of the first rule, in declared order, whose pattern matches; rules are one small array."""
    if d.duck:
        return f"list_filter(k.rules, lambda x: regexp_matches({url}, x.pattern))[1].{column}"
    return f"get(filter(k.rules, x -> {url} RLIKE x.pattern), 0).{column}"


#: What a rule asks of a body; lists are joined by semicolons, and an empty text asks nothing.
RULE_COLUMNS = ("position", "pattern", "url_class", "min_body_bytes", "canary", "expected_type", "json_paths", "signatures")


def gathered_rules(d) -> str:
    """All rules as one small array in declared order."""
    if d.duck:
        return f"list(struct_pack({', '.join(f'{c} := {c}' for c in RULE_COLUMNS)}) ORDER BY position)"
    return f"sort_array(collect_list(struct({', '.join(RULE_COLUMNS)})))"


def listed(d, x: str) -> str:
    return d.among(d.pieces(x, ";"), lambda t: f"{t} <> ''")


@operator("responses", "rules")
def triage_responses(d):
    """PRJ-12: verdict, reason, signature, title and whether policy lets it pay, of every response.

    Cheap tests come first: transport, whose answer it is, status, then signatures, size,
    type, JSON paths and canaries. One pass over the bodies: the rules come along as one
    array, and class, signatures and shell are expressions over the row.
    """
    title = d.ext("body", "(?is)<title[^>]*>(.*?)</title>", 1)
    own = ", ".join(f"{first_rule(d, 'r.url', c)} AS {c}" for c in RULE_COLUMNS[2:])
    declared, want = "lower(coalesce(content_type, ''))", "lower(coalesce(expected_type, ''))"
    extra = d.at(d.among(listed(d, "lower(coalesce(signatures, ''))"), lambda t: f"position({t} IN lower(body)) > 0"), 1)
    step = d.sub("{t}", r"[.]([0-9]+)", "[$1]")
    there = lambda t: d.json_by("body", f"concat('$.', {step.replace('{t}', t)})")
    lost = d.some(listed(d, "coalesce(json_paths, '')"), lambda t: f"coalesce({d.rx(there(t), r'^\[(null(,null)*)?\]$')}, TRUE)")
    unseen = d.some(listed(d, "coalesce(canary, '')"), lambda t: f"position({t} IN {without_blocks(d, 'body')}) = 0")
    kind = f"lower({content_kind(d, 'body', "''")})"
    return f"""WITH k AS (SELECT {gathered_rules(d)} AS rules FROM @rules),
    c AS (SELECT r.page_id, r.url, r.status, r.content_type, r.cf_mitigated, r.source, r.transport_error, r.retry_after, coalesce(r.body, '') AS body, {own} FROM @responses r CROSS JOIN k),
    f AS (SELECT *, coalesce({block_signature(d, "lower(body)")}, {extra}) AS sig, {first_marker("lower(body)", ACCESS_MARKERS)} AS acc, {title} AS title, {d.octets("body")} AS size, coalesce(min_body_bytes, 1) AS least,
      status BETWEEN 200 AND 299 AS good FROM c),
    g AS (SELECT *, good AND {want} <> '' AND position({want} IN {declared}) = 0 AND position({kind} IN {want}) = 0 AND position({want} IN {kind}) = 0 AS mistyped,
      good AND (coalesce(json_paths, '') <> '' OR position('json' IN {want}) > 0) AS asks_json FROM f),
    h AS (SELECT *, asks_json AND NOT {d.whole_json("body")} AS no_json FROM g),
    i AS (SELECT *, CASE WHEN asks_json AND NOT no_json THEN {lost} ELSE FALSE END AS no_path, good AND {unseen} AS unseen FROM h),
    j AS (SELECT *, CASE WHEN unseen THEN {csr_shell(d)} ELSE FALSE END AS shell FROM i),
    v AS (SELECT *, CASE WHEN transport_error IS NOT NULL OR status IS NULL THEN CASE WHEN source = 'provider' THEN 'PROVIDER_ERROR' ELSE 'ORIGIN_DOWN' END
      WHEN source = 'provider' AND (status IN (400, 401, 403, 404, 407, 429) OR status >= 500) OR status = 407 THEN 'PROVIDER_ERROR'
      WHEN status = 304 THEN 'NOT_MODIFIED' WHEN status IN (404, 410) THEN 'DEAD_URL' WHEN status IN (401, 402) THEN 'AUTH_REQUIRED' WHEN status = 429 THEN 'RATE_LIMITED'
      WHEN status = 403 THEN CASE WHEN sig IS NULL AND acc IS NOT NULL THEN 'ACCESS_DENIED' ELSE 'BLOCKED' END
      WHEN status >= 500 THEN CASE WHEN sig IS NOT NULL THEN 'BLOCKED' ELSE 'ORIGIN_DOWN' END
      WHEN good THEN CASE WHEN sig IS NOT NULL THEN 'SOFT_BLOCK' WHEN acc IS NOT NULL THEN 'ACCESS_DENIED' WHEN size < least THEN 'THIN_CONTENT' WHEN mistyped OR no_json OR no_path THEN 'PARSE_FAIL'
        WHEN unseen THEN CASE WHEN shell THEN 'CSR_REQUIRED' ELSE 'PARSE_FAIL' END ELSE 'OK' END
      ELSE 'PARSE_FAIL' END AS verdict FROM j)
    SELECT page_id, url, url_class, verdict, CASE WHEN transport_error IS NOT NULL THEN concat('transport: ', transport_error) WHEN status IS NULL THEN 'no status' WHEN verdict = 'RATE_LIMITED' AND retry_after IS NOT NULL THEN concat('HTTP 429, wait ', retry_after)
        WHEN verdict = 'THIN_CONTENT' THEN concat('under ', CAST(least AS STRING), ' bytes') WHEN NOT good THEN concat('HTTP ', CAST(status AS STRING)) WHEN verdict <> 'PARSE_FAIL' THEN lower(verdict)
        WHEN mistyped THEN concat('not ', expected_type) WHEN no_json THEN 'no JSON' WHEN no_path THEN 'JSON path missing' ELSE 'canary missing' END AS reason,
      CASE WHEN transport_error IS NULL AND status IS NOT NULL THEN coalesce(sig, acc) END AS signature, title, CAST(size AS BIGINT) AS body_bytes, verdict IN ('BLOCKED', 'SOFT_BLOCK') AS pays FROM v"""


@operator("triage_responses", "add_content_kind", "responses")
def validate_contracts(d):
    """PRJ-13: accepted bodies with their kind and hash; everything else, and what cannot be read, is refused."""
    return f"""SELECT t.page_id, t.verdict = 'OK' AND k.content_kind IN ('HTML', 'JSON', 'TEXT') AS accepted, k.content_kind, {d.sha("r.body")} AS body_sha256
    FROM @triage_responses t JOIN @add_content_kind k ON t.page_id = k.page_id JOIN @responses r ON t.page_id = r.page_id"""


@operator("triage_responses")
def fingerprint_failures(d):
    """PRJ-14: a digest of what a failure looks like, without its site."""
    return f"""WITH f AS (SELECT page_id, url, verdict, concat_ws('/', verdict, CASE WHEN body_bytes = 0 THEN 'empty' WHEN body_bytes < 1024 THEN 'tiny' WHEN body_bytes < 10240 THEN 'small' ELSE 'large' END, coalesce(signature, 'none')) AS label FROM @triage_responses WHERE verdict NOT IN ('OK', 'NOT_MODIFIED'))
    SELECT page_id, verdict, label, substring({d.sha("label")}, 1, 16) AS digest FROM f"""


@operator("triage_responses")
def triage_report(d):
    """AGG-04 by class: totals, resolved, coverage and distinct titles."""
    return """SELECT coalesce(url_class, 'unclassified') AS url_class, count(*) AS total, count_if(verdict IN ('OK', 'NOT_MODIFIED')) AS resolved,
      round(count_if(verdict IN ('OK', 'NOT_MODIFIED')) / count(*), 6) AS coverage, count(DISTINCT CASE WHEN verdict = 'OK' THEN title END) AS titles
    FROM @triage_responses GROUP BY coalesce(url_class, 'unclassified')"""


@operator("attempts")
def schedule_retries(d):
    """PRJ-15: when a transient failure may be tried again."""
    return f"""SELECT attempt_id, {d.epoch("attempted_at")} + CASE verdict WHEN 'RATE_LIMITED' THEN 1800 ELSE 7200 END AS not_before FROM @attempts WHERE verdict IN ('RATE_LIMITED', 'ORIGIN_DOWN')"""
