"""Route and provider memory as a stream: counters and averages that events fold into.

A route's state is a summary of its events, and summaries of consecutive events can be
joined: averages are kept as ``factor * before + value``. A batch of events becomes one
summary by array arithmetic, is joined to the state, and the state goes out once a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tidemill.operators.dims import VERDICT_DIM

COUNTERS = ("attempts", "scored", "successes", "blocks", "soft_blocks", "unknown_calls")
STATE = ", ".join(f"{c} long" for c in COUNTERS) + ", credits double, last_success double, last_failure double, ewma double, ewma_factor double, latency double, latency_factor double, latency_after double"
FIELDS = tuple(c.split()[0] for c in STATE.split(", "))
OUTPUT = ", ".join(f"{c} long" for c in COUNTERS) + ", credits double, last_success double, last_failure double, ewma double, latency_ms double"


def summary(events: pd.DataFrame, alpha: float) -> dict:
    """The summary of events in their order: success, told, latency_ms, verdict, cost_credits, unknown and at (seconds)."""
    told, timed = events.told.to_numpy(bool), events.latency_ms.notna().to_numpy()
    success = events.success.to_numpy(bool)
    keep = 1 - alpha

    def folded(values: np.ndarray) -> tuple[float, float]:
        """Value and factor of an average over these values alone."""
        powers = keep ** np.arange(len(values) - 1, -1, -1)
        return float((alpha * powers * values).sum()), float(keep ** len(values))

    ewma, ewma_factor = folded(success[told].astype(float))
    latencies = events.latency_ms.to_numpy(float)[timed]
    after, latency_factor = folded(latencies)
    # a latency of the very first event is where the average starts
    first = after + keep * keep ** (len(latencies) - 1) * latencies[0] if len(timed) and timed[0] else after
    at = events["at"].to_numpy(float)
    return {
        "attempts": len(events), "scored": int(told.sum()), "successes": int(success.sum()), "blocks": int((events.verdict == "BLOCKED").sum()), "soft_blocks": int((events.verdict == "SOFT_BLOCK").sum()),
        "unknown_calls": int(events.unknown.sum()), "credits": float(events.cost_credits.astype(float).fillna(0).sum()),
        "last_success": float(at[success].max()) if success.any() else None, "last_failure": float(at[told & ~success].max()) if (told & ~success).any() else None,
        "ewma": ewma, "ewma_factor": ewma_factor, "latency": first, "latency_factor": latency_factor, "latency_after": after,
    }


def joined(before: dict | None, then: dict) -> dict:
    """The summary of the events of both, ``then`` being the later ones."""
    if before is None:
        return then
    out = {c: before[c] + then[c] for c in (*COUNTERS, "credits")}
    for c in ("last_success", "last_failure"):
        out[c] = max((x for x in (before[c], then[c]) if x is not None), default=None)
    out["ewma"] = then["ewma_factor"] * before["ewma"] + then["ewma"]
    out["ewma_factor"] = before["ewma_factor"] * then["ewma_factor"]
    out["latency"] = then["latency_factor"] * before["latency"] + then["latency_after"]
    out["latency_after"] = then["latency_factor"] * before["latency_after"] + then["latency_after"]
    out["latency_factor"] = before["latency_factor"] * then["latency_factor"]
    return out


class RouteMemory(StatefulProcessor):
    """STR-04: the state of one route, forgotten ``ttl_ms`` after its last event (0: never)."""

    def __init__(self, keys: tuple[str, ...], alpha: float, ttl_ms: int = 0):
        self._keys, self._alpha, self._ttl = keys, alpha, ttl_ms

    def init(self, handle) -> None:
        self._state = handle.getValueState("route", STATE, ttlDurationMs=self._ttl or None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = dict(zip(FIELDS, self._state.get(), strict=True)) if self._state.exists() else None
        batch = pd.concat(list(rows)).sort_values(["at", "attempt_id"], kind="stable")
        held = joined(held, summary(batch, self._alpha))
        self._state.update(tuple(held[f] for f in FIELDS))
        values = [held[c] for c in (*COUNTERS, "credits", "last_success", "last_failure", "ewma", "latency")]
        yield pd.DataFrame([[*key, *values]], columns=[*self._keys, *(c.split()[0] for c in OUTPUT.split(", "))])

    def close(self) -> None:
        pass


def told_by(attempts: DataFrame, form: str = "route") -> DataFrame:
    """Attempts with ``success`` and ``told`` (the verdict says something) of the route or the vendor form, and their time in seconds."""
    verdicts = attempts.sparkSession.sql(f"SELECT verdict AS _v, {form}_success = 1 AS success, {form}_neutral = 0 AS told FROM {VERDICT_DIM}")
    seconds = (F.unix_micros(F.col("attempted_at").cast("timestamp")) / 1e6).alias("at")
    known = attempts.join(F.broadcast(verdicts), F.col("verdict") == F.col("_v"))
    return known.select("*", seconds, (F.col("cost_certainty") == "UNKNOWN").alias("unknown")).drop("_v")


def route_memory(attempts: DataFrame, keys: tuple[str, ...] = ("domain", "url_class", "strategy", "level"), form: str = "route", alpha: float = 0.25, ttl_ms: int = 0) -> DataFrame:
    """The memory of each route after each batch of a stream of attempts.

    ``form="vendor"`` with the keys provider and strategy and ``alpha=0.3`` is the
    provider form. Within a batch attempts fold in order of time and attempt_id; the row
    with the most attempts is a route's latest. Needs the RocksDB state store.
    """
    fields = {f.name: f.dataType.simpleString() for f in attempts.schema}
    schema = ", ".join(f"{k} {fields[k]}" for k in keys) + ", " + OUTPUT
    told = told_by(attempts.dropna(subset=list(keys)), form)
    # no timers, so no watermark is asked for; processing time only serves the TTL
    mode = "ProcessingTime" if ttl_ms else "None"
    return told.groupBy(*keys).transformWithStateInPandas(RouteMemory(keys, alpha, ttl_ms), schema, "Update", mode)
