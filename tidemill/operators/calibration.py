"""Comparing provider strategies over recorded outcomes."""

from __future__ import annotations

from tidemill.operators.base import operator
from tidemill.operators.dims import wilson

#: Credits and US dollars per call of the fixture's strategies.
TARIFFS = "(SELECT * FROM (VALUES ('s0', 1, 0.0001), ('s1', 5, 0.0005), ('s2', 10, 0.001), ('s3', 25, 0.0025)) v(strategy, credits, usd))"


@operator("provider_outcomes")
def read_outcome_sessions(d):
    """SRC-04: sessions by their latest outcome."""
    return "SELECT session, max(recorded_at) AS latest, count(*) AS outcomes FROM @provider_outcomes GROUP BY session"


@operator("provider_outcomes")
def settle_costs(d):
    """JOIN-09: reported credits are exact, the tariff is provisional, and the rest stays unknown."""
    return f"""SELECT outcome_id, CAST(CASE WHEN NOT attempted THEN NULL WHEN reported_credits IS NOT NULL THEN reported_credits WHEN o.provider <> 'vendor2' THEN t.credits END AS DOUBLE) AS credits,
      CASE WHEN NOT attempted THEN 'EXACT' WHEN reported_credits IS NOT NULL THEN 'EXACT' WHEN o.provider <> 'vendor2' THEN 'PROVISIONAL' ELSE 'UNKNOWN' END AS certainty,
      CAST(CASE WHEN NOT attempted THEN NULL WHEN reported_credits IS NOT NULL THEN reported_credits * 0.0001 WHEN o.provider <> 'vendor2' THEN t.usd END AS DOUBLE) AS usd FROM @provider_outcomes o LEFT JOIN {TARIFFS} t ON o.strategy = t.strategy"""


def _metrics(keys: str) -> str:
    return f"""WITH m AS (SELECT {keys}, count_if(attempted) AS attempts, count_if(attempted AND verdict IN ('OK', 'BLOCKED', 'PARSE_FAIL') AND error_kind IS NULL) AS scored, count_if(verdict = 'OK' AND error_kind IS NULL) AS validated, count_if(verdict = 'BLOCKED') AS blocks,
      count_if(error_kind IS NOT NULL) AS errors, count_if(NOT eligible) AS ineligible, count_if(attempted AND target_status = expected_status) AS faithful, CAST(sum(CASE WHEN certainty = 'EXACT' THEN usd END) AS DOUBLE) AS exact_usd,
      CAST(sum(CASE WHEN certainty = 'PROVISIONAL' THEN usd END) AS DOUBLE) AS provisional_usd, count_if(certainty = 'UNKNOWN') AS unknown_calls FROM @provider_outcomes o JOIN @settle_costs c ON o.outcome_id = c.outcome_id GROUP BY {keys})
    SELECT {keys}, attempts, scored, validated, blocks, errors, ineligible, faithful, round(exact_usd, 6) AS exact_usd, round(provisional_usd, 6) AS provisional_usd, unknown_calls, round({wilson("validated", "scored")}, 6) AS bound,
      round(CASE WHEN unknown_calls = 0 AND validated > 0 THEN (coalesce(exact_usd, 0) + coalesce(provisional_usd, 0)) / validated END, 8) AS usd_per_validated FROM m"""


@operator("provider_outcomes", "settle_costs")
def strategy_metrics(d):
    """AGG-12: per strategy and kind of target: outcomes, fidelity, spend by certainty."""
    return _metrics("provider, strategy, target_kind")


@operator("provider_outcomes", "settle_costs")
def session_totals(d):
    """AGG-14: one row per session."""
    return _metrics("session")


@operator("provider_outcomes", "settle_costs")
def vendor_concentration(d):
    """AGG-15: calls and spend per provider, and their shares."""
    return """WITH p AS (SELECT provider, count_if(attempted) AS calls, coalesce(sum(usd), 0) AS spend FROM @provider_outcomes o JOIN @settle_costs c ON o.outcome_id = c.outcome_id GROUP BY provider)
    SELECT provider, calls, round(spend, 6) AS spend, round(calls / sum(calls) OVER (), 6) AS call_share, round(spend / sum(spend) OVER (), 6) AS spend_share FROM p"""


@operator("provider_outcomes")
def wins_by_defence(d):
    """AGG-16: which strategies ever beat a defence."""
    return f"""WITH w AS (SELECT coalesce(block_signature, 'none') AS defence, concat(provider, '/', strategy) AS s, count(*) AS n, count_if(verdict = 'OK') AS ok FROM @provider_outcomes WHERE attempted GROUP BY 1, 2)
    SELECT defence, CAST(sum(n) AS BIGINT) AS attempts, CAST(sum(ok) AS BIGINT) AS validated, {d.joined("CASE WHEN ok > 0 THEN s END")} AS winners FROM w GROUP BY defence"""


@operator("provider_outcomes")
def fidelity_by_provider(d):
    """AGG-17: how often the reported status is the site's own."""
    return "SELECT provider, count_if(target_status = expected_status) AS correct, count(*) AS checked, round(count_if(target_status = expected_status) / count(*), 6) AS rate FROM @provider_outcomes WHERE attempted GROUP BY provider"


@operator("provider_outcomes")
def status_fidelity(d):
    """JOIN-17: reported against expected status per outcome."""
    return "SELECT outcome_id, target_status = expected_status AS faithful FROM @provider_outcomes WHERE attempted"


@operator("provider_outcomes")
def discovery_yield(d):
    """AGG-18: domains and validated pages per strategy."""
    return f"SELECT strategy, count(*) AS pages, count_if(verdict = 'OK') AS validated, {d.joined('domain', True)} AS domains FROM @provider_outcomes WHERE attempted GROUP BY strategy"


@operator("provider_outcomes")
def check_fairness(d):
    """AGG-19: whether each provider was offered every domain."""
    return "WITH a AS (SELECT count(DISTINCT domain) AS n FROM @provider_outcomes) SELECT provider, count(DISTINCT domain) AS offered, count(DISTINCT domain) = max(n) AS fair FROM @provider_outcomes, a GROUP BY provider"


@operator("provider_outcomes")
def early_stop_flags(d):
    """WIN-07: outcomes that come after three validated ones of the same provider and kind."""
    return """SELECT outcome_id, coalesce(sum(CASE WHEN verdict = 'OK' THEN 1 ELSE 0 END) OVER (PARTITION BY provider, target_kind ORDER BY outcome_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= 3 AND target_kind IN ('ssr_html', 'listing', 'dead_url', 'csr_shell') AS would_skip FROM @provider_outcomes"""


@operator("strategy_metrics")
def rank_strategies(d):
    """TOP-03: those that pass the gate first, then by price, then by bound."""
    return """SELECT provider, strategy, target_kind, scored >= 3 AND bound >= 0.5 AS passes, CAST(row_number() OVER (ORDER BY CASE WHEN scored >= 3 AND bound >= 0.5 THEN 0 ELSE 1 END, usd_per_validated ASC NULLS LAST, bound DESC, provider, strategy, target_kind) AS BIGINT) AS rnk FROM @strategy_metrics WHERE attempts > 0"""


@operator("rank_strategies")
def segment_winners(d):
    """TOP-04: per kind the winner, which passed, and the leader, which is ahead."""
    return "SELECT target_kind, min_by(concat(provider, '/', strategy), CASE WHEN passes THEN rnk END) AS winner, min_by(concat(provider, '/', strategy), rnk) AS leader FROM @rank_strategies GROUP BY target_kind"


@operator("provider_outcomes")
def plan_matrix(d):
    """JOIN-11: every strategy for every kind of target, the cheapest first."""
    return f"""SELECT p.provider, t.strategy, k.target_kind, NOT (k.target_kind = 'csr_shell' AND t.strategy = 's0') AS applicable FROM (SELECT DISTINCT provider FROM @provider_outcomes) p, {TARIFFS} t, (SELECT DISTINCT target_kind FROM @provider_outcomes) k"""


@operator("strategy_metrics")
def assess_strategies(d):
    """JOIN-16: whether a strategy may be tried, and what a valid result is expected to cost."""
    return f"""SELECT m.provider, m.strategy, m.target_kind, CASE WHEN scored < 3 THEN 'COLD_START' WHEN bound >= 0.8 THEN 'ELIGIBLE' WHEN bound >= 0.5 THEN 'MARGINAL' ELSE 'REJECTED' END AS verdict,
      round(CAST(t.usd AS DOUBLE) / greatest(CASE WHEN scored > 0 THEN validated / scored ELSE 0.5 END, 0.02), 8) AS expected_usd FROM @strategy_metrics m JOIN {TARIFFS} t ON m.strategy = t.strategy"""


@operator("assess_strategies")
def choose_strategy(d):
    """TOP-05: the first strategy per kind by eligibility and expected cost."""
    return """SELECT target_kind, provider, strategy, verdict FROM (SELECT *, row_number() OVER (PARTITION BY target_kind ORDER BY CASE verdict WHEN 'ELIGIBLE' THEN 0 WHEN 'MARGINAL' THEN 1 WHEN 'COLD_START' THEN 2 ELSE 3 END, expected_usd, provider, strategy) AS r FROM @assess_strategies) x WHERE r = 1"""


@operator("strategy_metrics", "strategy_stats")
def promotion_preview(d):
    """JOIN-13: calibrated strategies: new to production, or merging with its record."""
    return "SELECT m.provider, m.strategy, CAST(sum(m.scored) AS BIGINT) AS scored, CASE WHEN max(s.attempts) IS NULL THEN 'new' ELSE 'merging' END AS action FROM @strategy_metrics m LEFT JOIN @strategy_stats s ON m.provider = s.provider AND m.strategy = s.strategy GROUP BY m.provider, m.strategy HAVING sum(m.scored) >= 3"


@operator("provider_outcomes")
def corpus_fingerprint(d):
    """AGG-41: one hash of all targets, whatever their order: of the count and the sums of the parts of each target's hash."""
    part = lambda k: f"CAST(sum(CAST(conv_part{k} AS BIGINT)) AS BIGINT)"
    hexes = d.sha("concat(domain, '|', target_kind, '|', CAST(expected_status AS VARCHAR(5)))")
    parts = ", ".join(f"{d.hex_number(f'substring(h, {1 + 8 * k}, 8)')} AS conv_part{k}" for k in range(4))
    joined = ", '|', ".join(f"CAST({part(k)} AS VARCHAR(20))" for k in range(4))
    return f"""WITH t AS (SELECT DISTINCT {hexes} AS h FROM @provider_outcomes), p AS (SELECT {parts} FROM t)
    SELECT {d.sha(f"concat(CAST(count(*) AS VARCHAR(20)), '|', {joined})")} AS fingerprint FROM p"""
