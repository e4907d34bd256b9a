"""Samples, retention and admission: what is looked at, kept or paid for."""

from __future__ import annotations

from tidemill.operators.base import operator

#: Credits that a session, and one provider within it, may spend in a replay.
SESSION_CAP, PROVIDER_CAP, WORST_CASE = 3000, 1200, 4


@operator("attempts")
def stratified_sample(d):
    """TOP-06: up to three URLs of each stratum, the class or 'unstable', by the hash of the URL."""
    return f"""WITH u AS (SELECT url, url_class, verdict, row_number() OVER (PARTITION BY url ORDER BY attempted_at DESC, attempt_id DESC) AS latest FROM @attempts),
    s AS (SELECT url, CASE WHEN verdict IN ('CSR_REQUIRED', 'BLOCKED') THEN 'unstable' ELSE url_class END AS stratum FROM u WHERE latest = 1),
    r AS (SELECT stratum, url, row_number() OVER (PARTITION BY stratum ORDER BY {d.sha("url")}, url) AS place FROM s)
    SELECT stratum, url, CAST(place AS BIGINT) AS place FROM r WHERE place <= 3"""


@operator("fingerprint_memory")
def prune_evidence(d):
    """SNK-06: failures seen in the last 90 days, and older ones that something recovered from."""
    age = f"(((SELECT max({d.epoch('last_seen')}) FROM @fingerprint_memory) - {d.epoch('last_seen')}) / 86400.0)"
    return f"SELECT digest, last_seen, n, recoveries FROM @fingerprint_memory WHERE {age} <= 90 OR recoveries > 0"


@operator("provider_outcomes")
def admit_under_caps(d):
    """WIN-08: calls admitted in order; the first one whose worst case exceeds a cap ends its scope.

    Before a scope's first refusal all its calls were admitted, so running sums decide:
    first within each provider of a session, then among what the providers admit. A call
    of unknown cost keeps its worst case.
    """
    spent = f"coalesce(reported_credits, {WORST_CASE})"

    def admitted(table: str, scope: str, cap: int) -> str:
        return f"""SELECT * FROM (SELECT t.*, coalesce(max(CASE WHEN before_ + {WORST_CASE} > {cap} THEN 1 ELSE 0 END) OVER (PARTITION BY {scope} ORDER BY recorded_at, outcome_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS stopped
          FROM (SELECT outcome_id, recorded_at, session, provider, credits, sum(credits) OVER (PARTITION BY {scope} ORDER BY recorded_at, outcome_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - credits AS before_ FROM {table}) t) x WHERE stopped = 0"""

    return f"""WITH calls AS (SELECT outcome_id, recorded_at, session, provider, {spent} AS credits FROM @provider_outcomes WHERE attempted AND eligible),
    own AS ({admitted("calls", "session, provider", PROVIDER_CAP)}), both_ AS ({admitted("own", "session", SESSION_CAP)})
    SELECT c.outcome_id, c.session, c.provider, CASE WHEN b.outcome_id IS NOT NULL THEN 'ADMITTED' WHEN o.outcome_id IS NULL THEN 'PROVIDER_CAP' ELSE 'SESSION_CAP' END AS decision
    FROM calls c LEFT JOIN own o ON c.outcome_id = o.outcome_id LEFT JOIN both_ b ON c.outcome_id = b.outcome_id"""


@operator("infer_url_class", "responses", "classify_rendering")
def draft_url_classes(d):
    """AGG-43: per inferred class: pages, a sample, whether scripts are needed, and the least body size."""
    return f"""SELECT i.inferred_class AS url_class, count(*) AS pages, min(r.url) AS sample_url, max(CASE WHEN c.rendering = 'csr' THEN 1 ELSE 0 END) = 1 AS needs_scripts,
      CAST(greatest(500, floor(min({d.octets("r.body")}) / 4.0)) AS BIGINT) AS min_body_bytes
    FROM @responses r JOIN @infer_url_class i ON r.page_id = i.page_id JOIN @classify_rendering c ON r.page_id = c.page_id GROUP BY i.inferred_class"""
