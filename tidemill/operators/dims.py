"""Policy as small tables: verdicts, playbook, phases."""

from __future__ import annotations

#: Verdict, then whether it is a success, neutral for routes, a success and neutral for
#: providers, whether it pays, and whether another free route may be tried.
VERDICTS = (
    ("OK", 1, 0, 1, 0, 0, 0),
    ("NOT_MODIFIED", 1, 0, 0, 1, 0, 0),
    ("BLOCKED", 0, 0, 0, 0, 1, 1),
    ("SOFT_BLOCK", 0, 0, 0, 0, 1, 1),
    ("CSR_REQUIRED", 0, 0, 0, 0, 0, 1),
    ("PARSE_FAIL", 0, 0, 0, 0, 0, 0),
    ("THIN_CONTENT", 0, 0, 0, 0, 0, 0),
    ("DEAD_URL", 0, 1, 0, 1, 0, 0),
    ("ORIGIN_DOWN", 0, 1, 0, 1, 0, 0),
    ("RATE_LIMITED", 0, 1, 0, 1, 0, 0),
    ("AUTH_REQUIRED", 0, 1, 0, 1, 0, 0),
    ("ACCESS_DENIED", 0, 1, 0, 1, 0, 0),
    ("PROVIDER_ERROR", 0, 1, 0, 0, 0, 0),
)
#: What a verdict tells a person who looks into a run.
CAUSES = (
    ("ORIGIN_DOWN", "the server behind the site gave no usable answer"),
    ("DEAD_URL", "nothing is published at this address any more"),
    ("RATE_LIMITED", "requests follow each other too closely"),
    ("BLOCKED", "a defence against robots answered instead of the page"),
    ("SOFT_BLOCK", "the status looks fine but a defence wrote the body"),
    ("ACCESS_DENIED", "the site lets this visitor see nothing"),
    ("AUTH_REQUIRED", "only signed-in visitors get the page"),
    ("PARSE_FAIL", "a page came, without what was looked for"),
    ("CSR_REQUIRED", "the text is filled in by scripts after loading"),
    ("THIN_CONTENT", "too little came to be the page"),
    ("PROVIDER_ERROR", "the service in between failed"),
)


def _values(rows, names: str) -> str:
    cells = ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in row) + ")" for row in rows)
    return f"(SELECT * FROM (VALUES {cells}) v({names}))"


VERDICT_DIM = _values(VERDICTS, "verdict, route_success, route_neutral, vendor_success, vendor_neutral, pays, free_escalates")
PLAYBOOK = _values(CAUSES, "verdict, cause")
PHASES = _values([("B", v) for v in ("ORIGIN_DOWN", "RATE_LIMITED", "PROVIDER_ERROR")] + [("C", v) for v in ("BLOCKED", "SOFT_BLOCK")] + [("A", v[0]) for v in VERDICTS if v[0] not in ("DEAD_URL", "AUTH_REQUIRED", "ACCESS_DENIED", "OK")], "phase, verdict")


def wilson(successes: str, trials: str, z: float = 1.96) -> str:
    """Lower bound of the 95 % Wilson interval; 0 without trials."""
    s, n = f"CAST({successes} AS DOUBLE)", f"CAST({trials} AS DOUBLE)"
    z2 = z * z
    p = f"({s} / {n})"
    return f"CASE WHEN {trials} > 0 THEN greatest(0.0, ({p} + {z2 / 2} / {n} - {z} * sqrt(({p} * (1 - {p}) + {z2 / 4} / {n}) / {n})) / (1 + {z2} / {n})) ELSE 0.0 END"
