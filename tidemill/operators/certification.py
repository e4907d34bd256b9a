"""Whether a profile may go live: mutations judged, checks, and a verdict of four."""

from __future__ import annotations

from tidemill.operators.base import operator
from tidemill.operators.bodies import SECRET_TESTS

#: Mutation, what a truthful profile does about it, whether only survival will do, and whether it is a mere finding.
EXPECTED = (
    ("remove_optional_field", "WARNS", 0, 1),
    ("remove_critical_field", "FAILS", 0, 0),
    ("rename_css_class", "SURVIVES", 1, 0),
    ("wrap_dom_node", "SURVIVES", 1, 0),
    ("move_element", "SURVIVES", 1, 0),
    ("rename_json_key", "DRIFT", 0, 1),
    ("empty_collection", "EMPTY", 0, 1),
    ("change_field_type", "DRIFT", 0, 1),
    ("remove_pagination_cursor", "INCOMPLETE", 0, 0),
)
#: How loud a reaction is; a louder one than asked for passes.
LOUDNESS = (("SURVIVES", 0), ("WARNS", 1), ("EMPTY", 2), ("INCOMPLETE", 2), ("DRIFT", 2), ("FAILS", 3))
#: Pages on which an API has to be seen, and disagreements that a quorum may have.
LEAST_PAGES, MOST_CONFLICTS = 3, 0.02


def _dimension(rows, names: str) -> str:
    cells = ", ".join("(" + ", ".join(repr(x) for x in row) + ")" for row in rows)
    return f"(SELECT * FROM (VALUES {cells}) v({names}))"


@operator("mutation_runs")
def judge_mutations(d):
    """AGG-39: what was expected of each mutation, whether the reaction will do, and whether a failure is advice only.

    A mutation to survive has to be survived; an optional field that another source still
    gives will do; else a reaction at least as loud as the expected one passes.
    """
    return f"""SELECT r.domain, r.kind, r.target, e.expected, r.observed, r.observed = e.expected OR (e.survival = 0 AND ((e.expected = 'WARNS' AND r.observed = 'SURVIVES') OR o.loud >= x.loud)) AS passed, e.advisory = 1 AS advisory
    FROM @mutation_runs r JOIN {_dimension(EXPECTED, "kind, expected, survival, advisory")} e ON r.kind = e.kind JOIN {_dimension(LOUDNESS, "reaction, loud")} o ON r.observed = o.reaction JOIN {_dimension(LOUDNESS, "reaction, loud")} x ON e.expected = x.reaction"""


@operator("judge_mutations")
def mutation_summary(d):
    """Mutations by kind: runs, failures that block, and failures that advise."""
    return "SELECT domain, kind, count(*) AS runs, count_if(NOT passed AND NOT advisory) AS blocking, count_if(NOT passed AND advisory) AS advice FROM @judge_mutations GROUP BY domain, kind"


@operator("profile_classes", "profile_fields", "case_outcomes", "case_fields", "excused_kinds", "extractor_grades", "api_routes", "mutation_summary", "profile_texts")
def certification_checks(d):
    """AGG-38's checks: ``(domain, url_class, name, passed, severity)``, one for each question that applies.

    A profile is asked for cases that pass, one that says no, critical fields declared and
    found on every good page, few quorum conflicts, pagination tested or excused, policies,
    sturdy sources of critical fields, validated APIs, mutations noticed, and no secrets.
    """
    row = lambda name, passed, severity, source: f"SELECT domain, url_class, '{name}' AS name, {passed} AS passed, {severity} AS severity FROM {source}"
    secret = " OR ".join(d.rx("text", p) for _, x, p in SECRET_TESTS if x == "text")
    judged = "(SELECT * FROM c WHERE ran > 0)"
    return f"""WITH o AS (SELECT domain, url_class, count(*) AS ran, count_if(NOT passed) AS failed, count_if(negative OR verdict <> 'OK') AS says_no, sum(comparisons) AS comparisons, sum(conflicts) AS conflicts, count_if(kind = 'pagination') AS paged, count_if(kind = 'pagination' AND NOT passed) AS paged_failed FROM @case_outcomes GROUP BY domain, url_class),
    w AS (SELECT domain, url_class, count(*) AS critical FROM @profile_fields WHERE importance = 'critical' GROUP BY domain, url_class),
    g AS (SELECT DISTINCT o.domain, o.url_class FROM @case_outcomes o JOIN @profile_fields f ON o.domain = f.domain AND o.url_class = f.url_class AND f.importance = 'critical' LEFT JOIN @case_fields n ON o.case_id = n.case_id AND f.field = n.field WHERE NOT o.negative AND o.verdict = 'OK' AND n.field IS NULL),
    x AS (SELECT DISTINCT domain, url_class FROM @excused_kinds WHERE kind = 'pagination'),
    c AS (SELECT p.*, coalesce(o.ran, 0) AS ran, o.failed, o.says_no, o.comparisons, o.conflicts, o.paged, o.paged_failed, coalesce(w.critical, 0) AS critical, g.domain IS NOT NULL AS field_lost, x.domain IS NOT NULL AS excused FROM @profile_classes p
      LEFT JOIN o ON p.domain = o.domain AND p.url_class = o.url_class LEFT JOIN w ON p.domain = w.domain AND p.url_class = w.url_class LEFT JOIN g ON p.domain = g.domain AND p.url_class = g.url_class LEFT JOIN x ON p.domain = x.domain AND p.url_class = x.url_class),
    s AS (SELECT domain, field, count_if(grade <> 'FRAGILE') AS sturdy FROM @extractor_grades WHERE importance = 'critical' GROUP BY domain, field),
    t AS (SELECT domain, count_if(sturdy = 0) AS unsupported FROM s GROUP BY domain),
    m AS (SELECT domain, sum(runs) AS runs, sum(blocking) AS blocking, sum(advice) AS advice FROM @mutation_summary GROUP BY domain),
    k AS (SELECT DISTINCT domain FROM w),
    y AS (SELECT k.domain, '' AS url_class, m.runs, m.blocking, m.advice FROM k LEFT JOIN m ON k.domain = m.domain)
    {row("cases_run", "ran > 0", "'BLOCKER'", "c")}
    UNION ALL {row("cases_pass", "failed = 0", "'BLOCKER'", judged)}
    UNION ALL {row("negative_case", "says_no > 0", "'BLOCKER'", judged)}
    UNION ALL {row("critical_fields_declared", "critical > 0", "'BLOCKER'", judged)}
    UNION ALL {row("critical_fields_present", "NOT field_lost", "'BLOCKER'", "(SELECT * FROM c WHERE ran > 0 AND critical > 0)")}
    UNION ALL {row("quorum_conflicts", f"comparisons > 0 AND conflicts <= {MOST_CONFLICTS} * comparisons", "CASE WHEN comparisons > 0 THEN 'BLOCKER' ELSE 'WARNING' END", judged)}
    UNION ALL {row("pagination", "NOT has_pagination OR (CASE WHEN paged > 0 THEN paged_failed = 0 ELSE excused END)", "CASE WHEN NOT has_pagination OR (paged = 0 AND excused) THEN 'INFO' ELSE 'BLOCKER' END", judged)}
    UNION ALL {row("freshness_policy", "has_freshness", "'WARNING'", judged)}
    UNION ALL {row("promotion_policy", "has_promotion", "'WARNING'", judged)}
    UNION ALL SELECT domain, '', 'selector_fragility', unsupported = 0, CASE WHEN unsupported = 0 THEN 'INFO' ELSE 'BLOCKER' END FROM t
    UNION ALL SELECT domain, url_class, 'api_route_validated', distinct_pages >= {LEAST_PAGES} AND schema_stable AND state = 'VALIDATED', CASE WHEN distinct_pages >= {LEAST_PAGES} AND schema_stable AND state = 'VALIDATED' THEN 'INFO' ELSE 'BLOCKER' END FROM @api_routes
    UNION ALL SELECT domain, url_class, 'mutation_coverage', coalesce(runs > 0 AND blocking + advice = 0, FALSE), CASE WHEN coalesce(blocking, 0) > 0 THEN 'BLOCKER' WHEN runs IS NULL OR advice > 0 THEN 'WARNING' ELSE 'INFO' END FROM y
    UNION ALL SELECT domain, '', 'no_secrets', NOT ({secret}), 'BLOCKER' FROM @profile_texts"""


@operator("profile_classes", "case_outcomes", "certification_checks")
def certify_profiles(d):
    """AGG-38: CERTIFIED, CERTIFIED_WITH_WARNINGS, NOT_CERTIFIED, or INSUFFICIENT_EVIDENCE where no case was run at all."""
    return """WITH p AS (SELECT domain, count(*) AS classes FROM @profile_classes GROUP BY domain), o AS (SELECT domain, count(*) AS cases FROM @case_outcomes GROUP BY domain),
    k AS (SELECT domain, count(*) AS checks, count_if(NOT passed AND severity = 'BLOCKER') AS blockers, count_if(NOT passed AND severity = 'WARNING') AS warnings FROM @certification_checks GROUP BY domain)
    SELECT p.domain, p.classes, coalesce(o.cases, 0) AS cases, CASE WHEN o.cases IS NULL THEN 0 ELSE k.checks END AS checks, CASE WHEN o.cases IS NULL THEN 0 ELSE k.blockers END AS blockers, CASE WHEN o.cases IS NULL THEN 0 ELSE k.warnings END AS warnings,
      CASE WHEN o.cases IS NULL THEN 'INSUFFICIENT_EVIDENCE' WHEN k.blockers > 0 THEN 'NOT_CERTIFIED' WHEN k.warnings > 0 THEN 'CERTIFIED_WITH_WARNINGS' ELSE 'CERTIFIED' END AS verdict
    FROM p LEFT JOIN o ON p.domain = o.domain LEFT JOIN k ON p.domain = k.domain"""
