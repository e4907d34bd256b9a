"""Datasets: staging, schema snapshots, drift, promotion, availability, profile health."""

from __future__ import annotations

from tidemill.operators.base import operator

#: How far each extraction source is trusted, best first.
SOURCES = (("structured_api", 0), ("json_path", 0), ("json_ld", 1), ("app_state", 2), ("microdata", 3), ("meta", 4), ("css", 5), ("xpath", 5), ("heuristic", 6))
FIELDS = ("lang", "source", "n_chars", "quality")


@operator("records")
def record_fields(d):
    """One row per record and field: its value and JSON type; an absent field is null. The records are read once."""
    parts = [(f"'{f}'", d.json("data", "$." + f), d.json_type("data", f)) for f in FIELDS]
    if d.duck:
        each = "unnest([" + ", ".join(f"struct_pack(field := {f}, value := {v}, type := {t})" for f, v, t in parts) + "])"
    else:
        each = "explode(array(" + ", ".join(f"struct({f} AS field, {v} AS value, {t} AS type)" for f, v, t in parts) + "))"
    return f"SELECT side, natural_key, url_class, lang_source, f.field AS field, f.value AS value, f.type AS type FROM (SELECT side, natural_key, url_class, lang_source, {each} AS f FROM @records) r"


@operator("record_fields")
def schema_snapshot(d):
    """AGG-33: per side and field: types seen, null rate, rows."""
    return f"""SELECT side, field, {d.joined("CASE WHEN type <> 'null' THEN type END", True)} AS types, round(count_if(value IS NULL OR value = '') / count(*), 6) AS null_rate, count(*) AS records FROM @record_fields GROUP BY side, field"""


@operator("schema_snapshot")
def drift_findings(d):
    """AGG-34: what changed from the published to the staged side, and how bad it is."""
    return """WITH p AS (SELECT c.field, c.types AS t0, s.types AS t1, c.null_rate AS n0, s.null_rate AS n1, c.records AS r0, s.records AS r1 FROM (SELECT * FROM @schema_snapshot WHERE side = 'clean') c JOIN (SELECT * FROM @schema_snapshot WHERE side = 'staging') s ON c.field = s.field)
    SELECT field, 'field_gone' AS finding, CASE WHEN field IN ('lang', 'source') THEN 'block' ELSE 'warn' END AS severity FROM p WHERE n0 < 1 AND n1 = 1 UNION ALL SELECT field, 'field_added', 'info' FROM p WHERE n0 = 1 AND n1 < 1
    UNION ALL SELECT field, 'type_changed', CASE WHEN field IN ('lang', 'source') THEN 'block' ELSE 'warn' END FROM p WHERE t0 <> t1 AND n0 < 1 AND n1 < 1
    UNION ALL SELECT field, 'null_growth', CASE WHEN field IN ('lang', 'source') THEN 'block' ELSE 'warn' END FROM p WHERE n1 < 1 AND n1 > 2 * n0 AND n1 - n0 >= 0.05
    UNION ALL SELECT 'records', 'record_collapse', 'block' FROM p WHERE field = 'lang' AND r1 < 0.7 * r0"""


@operator("schema_snapshot")
def fields_added_removed(d):
    """SET-01: fields that only one side has."""
    side = lambda s: f"SELECT field FROM @schema_snapshot WHERE side = '{s}' AND null_rate < 1"
    return f"SELECT field, 'added' AS change FROM (({side('staging')}) EXCEPT ({side('clean')})) a UNION ALL SELECT field, 'removed' FROM (({side('clean')}) EXCEPT ({side('staging')})) r"


@operator("records", "schema_snapshot")
def validate_staging(d):
    """AGG-35: the first rule that staging breaks."""
    return """WITH s AS (SELECT count(*) AS staged FROM @records WHERE side = 'staging'), n AS (SELECT max(CASE WHEN side = 'staging' THEN null_rate END) AS worst, max(CASE WHEN side = 'clean' THEN null_rate END) AS base FROM @schema_snapshot WHERE field IN ('lang', 'source'))
    SELECT staged, worst, CASE WHEN staged = 0 THEN 'nothing staged' WHEN worst > 0.5 THEN 'completeness' WHEN base > 0 AND worst > 2 * base THEN 'null growth' ELSE 'ok' END AS reason FROM s, n"""


@operator("records")
def stage_records(d):
    """PUB-01: the last write of each key on each side, whole, and whether its writes disagree."""
    pair = "struct_pack(url_class := url_class, data := data)" if d.duck else "struct(url_class, data)"
    return f"""WITH l AS (SELECT side, natural_key, max_by({pair}, staged_at) AS w, count(DISTINCT data) > 1 AS conflict FROM @records GROUP BY side, natural_key)
    SELECT side, natural_key, w.url_class AS url_class, {d.sha("w.data")} AS data_sha, conflict FROM l"""


@operator("stage_records", "drift_findings", "validate_staging")
def promote(d):
    """PUB-02: staged records override published ones unless a gate blocks; then nothing changes.

    The published side goes along as the last known good copy of each key.
    """
    return """WITH g AS (SELECT (SELECT count(*) FROM @drift_findings WHERE severity = 'block') = 0 AND (SELECT max(reason) FROM @validate_staging) = 'ok' AS pass),
    c AS (SELECT * FROM @stage_records WHERE side = 'clean'), s AS (SELECT * FROM @stage_records WHERE side = 'staging')
    SELECT coalesce(s.natural_key, c.natural_key) AS natural_key, CASE WHEN g.pass THEN coalesce(s.data_sha, c.data_sha) ELSE c.data_sha END AS data_sha, c.data_sha AS last_known_good, CASE WHEN s.data_sha IS NOT NULL AND g.pass THEN 'staging' ELSE 'clean' END AS origin
    FROM c FULL OUTER JOIN s ON c.natural_key = s.natural_key CROSS JOIN g WHERE g.pass OR c.natural_key IS NOT NULL"""


@operator("records")
def read_clean(d):
    """PUB-03: published rows with typed columns."""
    return f"SELECT natural_key, url_class, {d.json('data', '$.lang')} AS lang, CAST({d.json('data', '$.n_chars')} AS BIGINT) AS n_chars FROM @records WHERE side = 'clean'"


@operator("advance_queue", "observations")
def attach_availability(d):
    """JOIN-05: fresh, not modified, stale or unavailable, by the latest verdict and the age of the last good copy."""
    return f"""WITH o AS (SELECT url, max(observed_at) AS seen FROM @observations GROUP BY url), l AS (SELECT max(observed_at) AS now_ FROM @observations)
    SELECT q.url, CASE WHEN q.verdict = 'NOT_MODIFIED' THEN 'NOT_MODIFIED' WHEN q.verdict = 'OK' THEN 'FRESH' WHEN o.seen IS NULL THEN 'UNAVAILABLE' WHEN {d.epoch("now_")} - {d.epoch("seen")} <= 604800 THEN 'STALE_LKG' ELSE 'UNAVAILABLE' END AS availability,
      round(({d.epoch("now_")} - {d.epoch("seen")}) / 3600, 4) AS age_hours FROM @advance_queue q LEFT JOIN o ON q.url = o.url CROSS JOIN l"""


@operator("attach_availability")
def availability_slo(d):
    """AGG-36: shares of each state, per site and over all."""
    return f"""WITH a AS (SELECT {d.ext("url", "//([^/]*)", 1)} AS site, availability, age_hours FROM @attach_availability)
    SELECT coalesce(site, '*') AS site, count(*) AS total, count_if(availability = 'FRESH') AS fresh, count_if(availability = 'NOT_MODIFIED') AS not_modified, count_if(availability = 'STALE_LKG') AS stale, count_if(availability = 'UNAVAILABLE') AS unavailable, max(age_hours) AS oldest_hours,
      round(count_if(availability IN ('FRESH', 'NOT_MODIFIED')) / count(*), 6) AS fresh_ratio FROM a GROUP BY ROLLUP (site)"""


@operator("run_samples")
def profile_health(d):
    """AGG-37: mean rates of the last nine runs of a site, and the worst grade they give."""
    return """WITH r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY run_day DESC) AS k FROM @run_samples),
    m AS (SELECT domain, count(*) AS runs, avg(1 - critical_fields_found / critical_fields_expected) AS missing, avg(quorum_conflicts / quorum_comparisons) AS conflicts, avg(paid_escalations / urls) AS escalations FROM r WHERE k <= 9 GROUP BY domain)
    SELECT domain, runs, round(missing, 6) AS missing, round(conflicts, 6) AS conflicts, round(escalations, 6) AS escalations, CASE WHEN runs < 3 THEN 'INSUFFICIENT' WHEN missing > 0.2 OR conflicts > 0.2 THEN 'CRITICAL' WHEN missing > 0.1 OR conflicts > 0.1 THEN 'DEGRADED' WHEN missing > 0.02 OR conflicts > 0.02 OR escalations > 0.2 THEN 'WATCH' ELSE 'HEALTHY' END AS grade FROM m"""
