"""Reliability of routes and providers, from the attempt log."""

from __future__ import annotations

from tidemill.operators.base import operator
from tidemill.operators.dims import VERDICT_DIM, wilson

ROUTE = "domain, url_class, strategy, level"
#: The bound that a route has to reach, and the square of the interval's z.
GATE, Z2 = 0.8, 1.96**2


@operator("attempts")
def route_stats(d):
    """AGG-05: per route: attempts, scored, successes, blocks, credits, rate and Wilson bound."""
    return f"""WITH s AS (SELECT {ROUTE}, count(*) AS attempts, count_if(route_neutral = 0) AS scored, count_if(route_success = 1) AS successes, count_if(a.verdict = 'BLOCKED') AS blocks, count_if(a.verdict = 'SOFT_BLOCK') AS soft_blocks,
      CAST(sum(cost_credits) AS DOUBLE) AS credits, max(CASE WHEN route_success = 1 THEN attempted_at END) AS last_success, max(CASE WHEN route_success = 0 AND route_neutral = 0 THEN attempted_at END) AS last_failure
      FROM @attempts a JOIN {VERDICT_DIM} v ON a.verdict = v.verdict GROUP BY {ROUTE})
    SELECT *, round(CASE WHEN scored > 0 THEN successes / scored END, 6) AS rate, round({wilson("successes", "scored")}, 6) AS bound FROM s"""


def _averages(keys: str, success: str, neutral: str, alpha: float) -> str:
    """Exponential averages of success and latency per key, in order of time, as weighted sums.

    A key's log is summed by day first; the days before then shrink by what came after
    them, so a busy key is as many groups as it has days. Success starts from 0; latency
    starts from the first attempt, which weighs 1 there.
    """
    late = f"OVER (PARTITION BY {keys}, day ORDER BY attempted_at DESC, attempt_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    after = f"OVER (PARTITION BY {keys} ORDER BY day DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    keep = 1 - alpha
    return f"""l AS (SELECT {keys}, CAST(attempted_at AS DATE) AS day, attempted_at, attempt_id, latency_ms, {success} AS x, 1 - {neutral} AS told FROM @attempts a JOIN {VERDICT_DIM} v ON a.verdict = v.verdict),
    w AS (SELECT *, sum(told) {late} - told AS r, count(latency_ms) {late} - 1 AS q, row_number() OVER (PARTITION BY {keys}, day ORDER BY attempted_at, attempt_id) AS i FROM l),
    t AS (SELECT {keys}, day, sum(told) AS scored, count(latency_ms) AS timed, sum(CASE WHEN told = 1 THEN {alpha} * power({keep}, r) * x ELSE 0 END) AS s, sum(CASE WHEN latency_ms IS NOT NULL THEN {alpha} * power({keep}, q) * latency_ms ELSE 0 END) AS m,
      sum(CASE WHEN i = 1 AND latency_ms IS NOT NULL THEN {keep} * power({keep}, q) * latency_ms ELSE 0 END) AS first_m FROM w GROUP BY {keys}, day),
    u AS (SELECT *, coalesce(sum(scored) {after}, 0) AS scored_after, coalesce(sum(timed) {after}, 0) AS timed_after, row_number() OVER (PARTITION BY {keys} ORDER BY day) AS d FROM t),
    averages AS (SELECT {keys}, sum(power({keep}, scored_after) * s) AS ewma, sum(power({keep}, timed_after) * (m + CASE WHEN d = 1 THEN first_m ELSE 0 END)) AS latency_ms, CAST(sum(scored) AS BIGINT) AS scored FROM u GROUP BY {keys})"""


@operator("attempts")
def ewma_signals(d):
    """AGG-06: exponential averages of success and latency of each route, the newest attempt 0.25."""
    return f"WITH {_averages(ROUTE, 'route_success', 'route_neutral', 0.25)} SELECT {ROUTE}, round(ewma, 6) AS ewma, round(latency_ms, 6) AS latency_ms, scored FROM averages"


@operator("attempts")
def strategy_stats(d):
    """AGG-07: the provider form: OK alone succeeds, a provider error counts, the newest attempt weighs 0.3."""
    keys = "provider, strategy"
    return f"""WITH {_averages(keys, "vendor_success", "vendor_neutral", 0.3)},
    s AS (SELECT {keys}, count(*) AS attempts, count_if(vendor_success = 1) AS successes, count_if(a.verdict IN ('BLOCKED', 'SOFT_BLOCK')) AS blocks, count_if(a.verdict = 'PROVIDER_ERROR') AS provider_errors, count_if(vendor_neutral = 1) AS neutral, CAST(sum(cost_credits) AS DOUBLE) AS credits,
      count_if(cost_certainty = 'UNKNOWN') AS unknown_calls, max(CASE WHEN vendor_success = 1 THEN attempted_at END) AS last_success, max(CASE WHEN vendor_success = 0 AND vendor_neutral = 0 THEN attempted_at END) AS last_failure
      FROM @attempts a JOIN {VERDICT_DIM} v ON a.verdict = v.verdict WHERE provider IS NOT NULL GROUP BY {keys})
    SELECT s.*, e.scored, round(e.ewma, 6) AS ewma, round(e.latency_ms, 6) AS latency_ms, round(CASE WHEN unknown_calls = 0 AND successes > 0 THEN credits / successes END, 6) AS cost_per_valid, round({wilson("successes", "scored")}, 6) AS bound
    FROM s JOIN averages e ON s.provider = e.provider AND s.strategy = e.strategy"""


@operator("route_stats", "ewma_signals")
def merge_stats(d):
    """AGG-08: records of one class add up: counters and credits, the later times, success averages by what was scored and latency by attempts."""
    same = " AND ".join(f"r.{c.strip()} = e.{c.strip()}" for c in ROUTE.split(","))
    return f"""SELECT r.domain, r.url_class, CAST(sum(attempts) AS BIGINT) AS attempts, CAST(sum(r.scored) AS BIGINT) AS scored, CAST(sum(successes) AS BIGINT) AS successes, CAST(sum(blocks) AS BIGINT) AS blocks, CAST(sum(soft_blocks) AS BIGINT) AS soft_blocks,
      round(coalesce(sum(credits), 0), 4) AS credits, max(last_success) AS last_success, max(last_failure) AS last_failure, round(CASE WHEN sum(r.scored) > 0 THEN sum(ewma * r.scored) / sum(r.scored) ELSE 0 END, 4) AS ewma, round(sum(latency_ms * attempts) / sum(attempts), 4) AS latency_ms,
      round(CASE WHEN sum(r.scored) > 0 THEN sum(successes) / sum(r.scored) END, 4) AS rate
    FROM @route_stats r JOIN @ewma_signals e ON {same} GROUP BY r.domain, r.url_class"""


@operator("route_stats")
def wilson_bound(d):
    """PRJ-29: the bound, and how many clean successes a gate needs: n / (n + z2) >= gate holds from n = gate * z2 / (1 - gate) on."""
    return f"SELECT domain, url_class, strategy, level, bound, bound >= {GATE} AS passes, CAST(ceil(round({GATE * Z2} / (1.0 - {GATE}), 9)) AS BIGINT) AS clean_successes_needed FROM @route_stats"


@operator("route_stats", "attempts")
def decay_evidence(d):
    """PRJ-30: successes and trials lose half their weight every 30 days."""
    age = f"(((SELECT max({d.epoch('attempted_at')}) FROM @attempts) - {d.epoch('coalesce(last_success, last_failure)')}) / 86400.0)"
    return f"""WITH w AS (SELECT domain, url_class, strategy, level, successes * power(0.5, {age} / 30.0) AS s, scored * power(0.5, {age} / 30.0) AS n FROM @route_stats WHERE scored > 0)
    SELECT domain, url_class, strategy, level, round(n, 4) AS weight, round({wilson("s", "n")}, 4) AS bound FROM w"""


@operator("attempts")
def breaker_streaks(d):
    """WIN-02: runs of one hard verdict per domain, and whether they opened the breaker.

    Runs are found within days; only a day's first and last run can go on in another day,
    and these few are joined over the days of a domain.
    """
    return """WITH o AS (SELECT domain, CAST(attempted_at AS DATE) AS day, verdict, row_number() OVER (PARTITION BY domain, CAST(attempted_at AS DATE) ORDER BY attempted_at, attempt_id) AS i, row_number() OVER (PARTITION BY domain, CAST(attempted_at AS DATE), verdict ORDER BY attempted_at, attempt_id) AS j FROM @attempts),
    r AS (SELECT domain, day, verdict, min(i) AS first_i, max(i) AS last_i, count(*) AS n FROM o GROUP BY domain, day, verdict, i - j),
    m AS (SELECT domain, day, max(last_i) AS rows_of_day FROM r GROUP BY domain, day),
    p AS (SELECT r.*, first_i = 1 AS opens_day, last_i = rows_of_day AS ends_day FROM r JOIN m ON r.domain = m.domain AND r.day = m.day),
    e AS (SELECT *, CASE WHEN opens_day AND lag(verdict) OVER (PARTITION BY domain ORDER BY day, first_i) = verdict THEN 0 ELSE 1 END AS fresh FROM p WHERE opens_day OR ends_day),
    g AS (SELECT domain, verdict, n, sum(fresh) OVER (PARTITION BY domain ORDER BY day, first_i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM e),
    s AS (SELECT domain, verdict, sum(n) AS streak FROM g GROUP BY domain, verdict, island UNION ALL SELECT domain, verdict, n FROM p WHERE NOT (opens_day OR ends_day))
    SELECT domain, verdict, CAST(max(streak) AS BIGINT) AS longest, count(*) AS streaks, count_if(streak >= 5) AS opened FROM s WHERE verdict IN ('BLOCKED', 'ORIGIN_DOWN') GROUP BY domain, verdict"""


@operator("attempts")
def fingerprint_memory(d):
    """AGG-09: per failure: first and last seen, count, levels, and recoveries."""
    return f"""WITH f AS (SELECT substring({d.sha("concat(verdict, '/', reason)")}, 1, 16) AS digest, url, attempted_at, level FROM @attempts WHERE verdict NOT IN ('OK', 'NOT_MODIFIED')),
    ok AS (SELECT url, max(attempted_at) AS ok_at FROM @attempts WHERE verdict = 'OK' GROUP BY url)
    SELECT digest, min(attempted_at) AS first_seen, max(attempted_at) AS last_seen, count(*) AS n, {d.joined("level", True)} AS levels, count_if(ok_at > attempted_at) AS recoveries FROM f LEFT JOIN ok ON f.url = ok.url GROUP BY digest"""


@operator("attempts")
def recovery_hints(d):
    """JOIN-10: the level that most often came right after a failure and succeeded."""
    return f"""WITH n AS (SELECT verdict, reason, lead(verdict) OVER w AS next_verdict, lead(level) OVER w AS next_level FROM @attempts WINDOW w AS (PARTITION BY url ORDER BY attempted_at, attempt_id)),
    c AS (SELECT substring({d.sha("concat(verdict, '/', reason)")}, 1, 16) AS digest, next_level, count(*) AS n, count_if(next_verdict = 'OK') AS ok FROM n WHERE verdict NOT IN ('OK', 'NOT_MODIFIED') AND next_level IS NOT NULL GROUP BY 1, 2)
    SELECT digest, next_level AS route, ok AS successes, n AS observations FROM (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY ok DESC, next_level) AS r FROM c) x WHERE r = 1"""


#: Scored attempts from which a route's own history counts, the lead that displaces the declared route, and the share of classes that probe.
LEAST_SCORED, LEAD, PROBES = 8, 0.1, 0.05
#: Latency from which a route loses points, and the most that it loses.
SLOW_MS, MOST_PENALTY = 2000.0, 0.15
#: Changes which classes probe; a run takes its own.
PROBE_SEED = 0


@operator("declared_routes", "route_stats", "ewma_signals")
def rank_routes(d):
    """WIN-06: the free routes of each class by evidence, with the declared order where there is little of it.

    Evidence is the bound, a preference for cheap levels and a penalty for slow ones. The
    declared first route stays in front unless another leads clearly, or is cheaper and no
    less reliable. In a few classes, by a hash, the cheapest observed route below the
    leader's level goes first, to be tried again.
    """
    same = lambda t: " AND ".join(f"r.{c.strip()} = {t}.{c.strip()}" for c in ROUTE.split(","))
    whole = "OVER (PARTITION BY domain, url_class)"
    first = lambda x: f"max(CASE WHEN place = 1 THEN {x} END) {whole}"
    own = lambda x: f"max(CASE WHEN position = 0 THEN {x} END) {whole}"
    drawn = d.hex_number(f"substring({d.sha(f"concat(domain, '/', url_class, '/{PROBE_SEED}')")}, 1, 8)")
    return f"""WITH r AS (SELECT r.*, CAST(substring(r.level, 2) AS INT) AS lvl, s.scored, s.bound, e.latency_ms FROM @declared_routes r LEFT JOIN @route_stats s ON {same("s")} LEFT JOIN @ewma_signals e ON {same("e")}),
    k AS (SELECT *, CASE WHEN coalesce(scored, 0) >= {LEAST_SCORED} THEN bound ELSE 0.0 END AS confidence, CASE WHEN coalesce(scored, 0) >= {LEAST_SCORED} THEN bound + 0.2 * (4 - lvl) / 5.0 - least({MOST_PENALTY}, 0.05 * greatest(0.0, latency_ms - {SLOW_MS}) / {SLOW_MS})
      WHEN position = 0 THEN 0.9 ELSE 0.7 - 0.05 * lvl END AS score FROM r WHERE lvl < 3),
    o AS (SELECT *, row_number() OVER (PARTITION BY domain, url_class ORDER BY round(score, 9) DESC, position) AS place FROM k),
    l AS (SELECT *, {first("position")} AS lead_position, {first("lvl")} AS lead_lvl, {first("confidence")} AS lead_confidence, {first("score")} AS lead_score, {own("lvl")} AS own_lvl, {own("confidence")} AS own_confidence, {own("score")} AS own_score FROM o),
    h AS (SELECT *, coalesce(lead_position <> 0 AND NOT (lead_lvl < own_lvl AND lead_confidence >= own_confidence AND lead_confidence > 0) AND lead_score - own_score < {LEAD}, FALSE) AS holds FROM l),
    f AS (SELECT *, CASE WHEN holds AND position = 0 THEN 0 ELSE place END AS turn, CASE WHEN holds THEN own_lvl ELSE lead_lvl END AS front_lvl, {drawn} % 1000 < {int(PROBES * 1000)} AS probes FROM h),
    p AS (SELECT *, row_number() OVER (PARTITION BY domain, url_class ORDER BY CASE WHEN scored IS NOT NULL AND lvl < front_lvl THEN 0 ELSE 1 END, lvl, turn) = 1 AND scored IS NOT NULL AND lvl < front_lvl AND probes AS shadow_probe FROM f)
    SELECT domain, url_class, strategy, level, round(score, 6) AS score, round(confidence, 6) AS confidence, holds AND position = 0 AS held, shadow_probe, CAST(row_number() OVER (PARTITION BY domain, url_class ORDER BY CASE WHEN shadow_probe THEN 0 ELSE 1 END, turn) AS BIGINT) AS rnk FROM p"""
