"""Spend: ledgers, budgets, anomalies, estimates. Unknown costs stay null and are counted beside every sum."""

from __future__ import annotations

from tidemill.operators.base import operator
from tidemill.operators.calibration import TARIFFS


@operator("attempts")
def spend_report(d):
    """AGG-20: paid calls, validated results, known spend, and cost per valid result if all is known."""
    return """WITH p AS (SELECT provider, count(*) AS paid_calls, count_if(verdict = 'OK') AS validated, CAST(sum(cost_credits) AS DOUBLE) AS known_credits, count_if(cost_certainty = 'UNKNOWN') AS unknown_calls FROM @attempts WHERE provider IS NOT NULL GROUP BY provider),
    t AS (SELECT count(DISTINCT url) AS total_urls FROM @attempts)
    SELECT provider, paid_calls, validated, known_credits, unknown_calls, round(paid_calls / total_urls, 6) AS share_of_urls, round(CASE WHEN unknown_calls = 0 AND validated > 0 THEN known_credits / validated END, 6) AS cost_per_valid FROM p, t"""


@operator("spend_report")
def counterfactual_savings(d):
    """AGG-21: what a fixed policy would have cost on the same calls, less the actual spend."""
    return "SELECT provider, policy, round(CASE WHEN unknown_calls = 0 THEN paid_calls * cost - known_credits END, 6) AS saved, CAST(paid_calls * cost AS DOUBLE) AS policy_cost FROM @spend_report, (SELECT * FROM (VALUES ('always_premium', 10), ('always_basic', 1)) v(policy, cost)) x"


@operator("spend_report")
def cost_anomalies(d):
    """AGG-22: spend that deserves a look."""
    return """SELECT provider, 'unknown_spend' AS anomaly FROM @spend_report WHERE unknown_calls > 0 UNION ALL SELECT provider, 'paid_share' FROM @spend_report WHERE share_of_urls > 0.3
    UNION ALL SELECT s.provider, 'cost_per_valid' FROM @spend_report s, (SELECT avg(cost_per_valid) AS a FROM @spend_report) b WHERE s.cost_per_valid > 1.5 * a"""


@operator("reservation_events")
def reservation_states(d):
    """AGG-26: the state of each reservation; what was submitted and never settled is UNKNOWN."""
    return """WITH s AS (SELECT reservation_id, max(provider) AS provider, max(CAST(event_at AS DATE)) AS day, max_by(event, seq) AS last_event, CAST(max(CASE WHEN event = 'created' THEN credits END) AS DOUBLE) AS held, CAST(max(CASE WHEN event = 'settled' THEN credits END) AS DOUBLE) AS actual FROM @reservation_events GROUP BY reservation_id)
    SELECT reservation_id, provider, day, held, actual, CASE last_event WHEN 'created' THEN 'RELEASED' WHEN 'submitted' THEN 'UNKNOWN' ELSE 'SETTLED' END AS state, coalesce(actual > held, FALSE) AS overspent FROM s"""


@operator("reservation_states")
def daily_usage(d):
    """AGG-23: credits and requests per day and provider."""
    return "SELECT day, provider, count(*) AS requests, coalesce(sum(actual), 0) AS credits, count_if(state = 'UNKNOWN') AS unknown_calls FROM @reservation_states GROUP BY day, provider"


@operator("reservation_states")
def budget_state(d):
    """AGG-25: per provider: unknown spend first, then overspend, exhaustion and warning."""
    return """WITH b AS (SELECT provider, count_if(state = 'UNKNOWN') AS unknown_calls, count_if(overspent) AS overspends, coalesce(sum(actual), 0) AS committed, coalesce(sum(CASE WHEN state = 'UNKNOWN' THEN held END), 0) AS held FROM @reservation_states GROUP BY provider)
    SELECT provider, committed, held, CASE WHEN unknown_calls > 0 THEN 'UNKNOWN_SPEND' WHEN overspends > 0 THEN 'OVERSPENT' WHEN committed + held >= 1000000 THEN 'EXHAUSTED' WHEN committed + held >= 800000 THEN 'WARNING' ELSE 'OK' END AS state FROM b"""


@operator("reservation_events")
def dedupe_charges(d):
    """AGG-24: one charge per request; another amount for the same request is a conflict."""
    return "SELECT reservation_id, CAST(min_by(credits, seq) AS DOUBLE) AS credits, count(*) AS events, count(DISTINCT credits) > 1 AS conflict FROM @reservation_events WHERE credits IS NOT NULL GROUP BY reservation_id"


@operator("attempts")
def paid_attempt_summary(d):
    """AGG-27: paid URLs by certainty of their cost."""
    return "SELECT cost_certainty, count(DISTINCT url) AS urls, count(*) AS calls, CAST(sum(cost_credits) AS DOUBLE) AS credits FROM @attempts WHERE level = 'L3' GROUP BY cost_certainty"


@operator("select_phase")
def estimate_run_cost(d):
    """AGG-28: per phase: URLs, expected and reserved credits, and whether the hold is cheap."""
    return f"""SELECT phase, count(*) AS urls, CAST(count(*) * CASE WHEN phase = 'C' THEN 5 ELSE 0 END AS DOUBLE) AS expected_credits, CAST(count(*) * CASE WHEN phase = 'C' THEN (SELECT max(credits) FROM {TARIFFS} t) ELSE 0 END AS DOUBLE) AS reserved_credits FROM @select_phase GROUP BY phase"""


@operator("provider_outcomes")
def tariff_watch(d):
    """AGG-29: charges above the documented ceiling."""
    return f"SELECT o.strategy, count(*) AS charges, count_if(reported_credits > t.credits) AS above_ceiling, CAST(max(reported_credits) AS DOUBLE) AS most FROM @provider_outcomes o JOIN {TARIFFS} t ON o.strategy = t.strategy WHERE reported_credits IS NOT NULL GROUP BY o.strategy"


@operator("attempts", "advance_queue")
def judge_canaries(d):
    """AGG-40: the verdict on a sample per class: neutral outcomes excluded, none scored warns."""
    return """WITH s AS (SELECT url_class, count_if(verdict NOT IN ('DEAD_URL', 'ORIGIN_DOWN', 'RATE_LIMITED', 'AUTH_REQUIRED', 'ACCESS_DENIED', 'PROVIDER_ERROR')) AS scored, count_if(verdict IN ('OK', 'NOT_MODIFIED')) AS ok FROM @attempts GROUP BY url_class)
    SELECT url_class, scored, ok, CASE WHEN scored = 0 THEN 'WARN' WHEN ok / scored < 0.5 THEN 'BLOCK' WHEN ok / scored < 0.8 THEN 'WARN' ELSE 'PASS' END AS judgement FROM s"""
