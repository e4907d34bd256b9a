"""Streams with a state of their own, and the same folds replayed over a table.

A fold takes a state and one event and gives the state after it. ``stream`` keeps the
states in Structured Streaming, ``replay`` runs over a whole log, sorted within keys.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tidemill.operators.base import OPERATORS

#: Provider faults that count against a strategy, or open the whole provider; verdicts that say nothing.
AGAINST_STRATEGY = ("PROVIDER_FAULT", "TIMEOUT", "TRANSPORT", "MALFORMED_RESPONSE")
AGAINST_PROVIDER = ("AUTH", "QUOTA")
NEEDS_HUMAN = ("AUTH",)
NEUTRAL = ("DEAD_URL", "ORIGIN_DOWN", "AUTH_REQUIRED", "ACCESS_DENIED", "RATE_LIMITED")
COOLDOWN, MOST_COOLDOWN, QUOTA_COOLDOWN = 60.0, 900.0, 3600.0


class Breakers:
    """STR-05: gates before a provider and before each of its strategies.

    A gate remembers failures in a row, how often it has shut, until when it is shut, and
    since when a trial is under way. It is shut before that time and on trial after it,
    until a success forgets it; so states need no step of their own. Events have strategy,
    at (seconds) and action: ``outcome`` (the default) brings error_kind or verdict,
    ``admit`` asks whether one call may go out, ``release`` gives a trial back that was
    never made, ``clear`` is a person's. A gate on trial lets one call through at a time; a
    trial that nobody ends within ``patience`` seconds is given up.
    """

    key = "provider"
    order = ("at", "event_id")
    schema = "provider string, event_id long, strategy string, state string, trips int, cooldown double, allowed boolean, why string"
    HUMAN = float("inf")

    def __init__(self, threshold: int = 5, patience: float = 300.0):
        self.threshold, self.patience = threshold, patience

    def start(self) -> dict:
        return {}

    @staticmethod
    def view(gate: dict | None, at: float) -> str:
        if not gate or gate["until"] is None:
            return "CLOSED"
        return "OPEN" if at < gate["until"] else "HALF_OPEN"

    @staticmethod
    def _shut(gate: dict, at: float, wait: float | None = None) -> None:
        gate["trips"] += 1
        gate["wait"] = min(COOLDOWN * 2 ** (gate["trips"] - 1), MOST_COOLDOWN) if wait is None else wait
        gate["until"], gate["trial"] = at + gate["wait"], None

    def _admitted(self, whole: dict, own: dict, at: float) -> tuple[bool, str]:
        for gate, name in ((whole, "provider"), (own, "strategy")):
            if self.view(gate, at) == "OPEN":
                return False, f"{name} is shut" + (" until a person clears it" if gate["until"] == self.HUMAN else "")
        on_trial = [g for g in (whole, own) if self.view(g, at) == "HALF_OPEN"]
        if any(g["trial"] is not None and at - g["trial"] < self.patience for g in on_trial):
            return False, "a trial is under way"
        for gate in on_trial:
            gate["trial"] = at
        return True, "trial" if on_trial else "open to all"

    def _outcome(self, state: dict, event) -> None:
        whole, own = state[""], state[event.strategy]
        kind, verdict = event.error_kind, event.verdict
        failed = isinstance(kind, str)
        if failed and kind in AGAINST_PROVIDER:
            whole["failures"] += 1
            self._shut(whole, event.at, self.HUMAN if kind in NEEDS_HUMAN else QUOTA_COOLDOWN)
        elif kind not in AGAINST_STRATEGY if failed else verdict in NEUTRAL:
            whole["trial"] = own["trial"] = None
        elif not failed and verdict == "OK":
            state[""], state[event.strategy] = self._gate(), self._gate()
        else:
            own["failures"] += 1
            if self.view(own, event.at) == "HALF_OPEN" or own["failures"] >= self.threshold:
                self._shut(own, event.at)

    @staticmethod
    def _gate() -> dict:
        return {"failures": 0, "trips": 0, "until": None, "wait": 0.0, "trial": None}

    def fold(self, state: dict, event) -> tuple:
        for name in ("", event.strategy):
            state.setdefault(name, self._gate())
        allowed = why = None
        action = getattr(event, "action", None) or "outcome"
        if action == "admit":
            allowed, why = self._admitted(state[""], state[event.strategy], event.at)
        elif action == "release":
            state[""]["trial"] = state[event.strategy]["trial"] = None
        elif action == "clear":
            state[""], state[event.strategy] = self._gate(), self._gate()
        else:
            self._outcome(state, event)
        whole, own = state[""], state[event.strategy]
        shown = "OPEN" if self.view(whole, event.at) == "OPEN" else self.view(own, event.at)
        return event.provider, event.event_id, event.strategy, shown, own["trips"], max(own["wait"], whole["wait"]), allowed, why


class Freshness:
    """STR-06: whether a page changed, and when it is due again.

    Events have at (seconds), not_modified and content_hash (null without a body).
    """

    key = "url"
    order = ("at", "event_id")
    schema = "url string, event_id long, changed boolean, interval_s double"
    LEAST, MOST = 900.0, 30 * 86400.0

    def start(self) -> dict:
        return {"seen": False, "hash": None, "interval": self.LEAST}

    def fold(self, state: dict, event) -> tuple:
        has_body = isinstance(event.content_hash, str)
        changed = not event.not_modified and (not has_body or not state["seen"] or event.content_hash != state["hash"])
        if changed or not state["seen"]:
            state["interval"] = self.LEAST
        else:
            state["interval"] = min(state["interval"] * 1.5, self.MOST)
        if has_body and not event.not_modified:
            state["hash"] = event.content_hash
        state["seen"] = True
        return event.url, event.event_id, bool(changed), state["interval"]


def _columns(fold) -> list[str]:
    return [c.split()[0] for c in fold.schema.split(", ")]


def replay(events: DataFrame, fold) -> DataFrame:
    """The fold over a whole log. A key's events are one sorted run, read batch by batch."""
    ordered = events.repartition(fold.key).sortWithinPartitions(fold.key, *fold.order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for batch in batches:
            out = []
            for event in batch.itertuples(index=False):
                if state is None or getattr(event, fold.key) != key:
                    key, state = getattr(event, fold.key), fold.start()
                out.append(fold.fold(state, event))
            yield pd.DataFrame(out, columns=_columns(fold))

    return ordered.mapInPandas(run, fold.schema)


def stream(events: DataFrame, fold) -> DataFrame:
    """The fold over a stream; events fold in the order in which they arrive, sorted within a batch."""

    def step(key, batches, state):
        held = json.loads(state.get[0]) if state.exists else fold.start()
        batch = pd.concat(list(batches)).sort_values(list(fold.order))
        out = [fold.fold(held, event) for event in batch.itertuples(index=False)]
        state.update((json.dumps(held),))
        yield pd.DataFrame(out, columns=_columns(fold))

    return events.groupBy(fold.key).applyInPandasWithState(step, fold.schema, "state string", "append", "NoTimeout")


GATE = "failures int, trips int, until double, wait double, trial double"


class BreakerProcessor(StatefulProcessor):
    """The breakers of one provider; a timer for each shut gate says when it goes on trial."""

    def __init__(self, fold: Breakers):
        self._fold = fold

    def init(self, handle) -> None:
        self._handle = handle
        self._gates = handle.getMapState("gates", "name string", GATE)

    def _held(self) -> dict:
        return {key[0]: dict(zip(("failures", "trips", "until", "wait", "trial"), value, strict=True)) for key, value in self._gates.iterator()}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self._held()
        batch = pd.concat(list(rows)).sort_values(list(self._fold.order))
        out = [self._fold.fold(held, event) for event in batch.itertuples(index=False)]
        for name, gate in held.items():
            self._gates.updateValue((name,), tuple(gate.values()))
            if gate["until"] is not None and gate["until"] != Breakers.HUMAN:
                self._handle.registerTimer(int(gate["until"] * 1000))
        yield pd.DataFrame(out, columns=_columns(self._fold))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        # a gate that a success or a later failure has moved since is not due
        out = [(key[0], None, name, "HALF_OPEN", gate["trips"], gate["wait"], None, "the wait is over") for name, gate in self._held().items() if gate["until"] is not None and gate["until"] != Breakers.HUMAN and int(gate["until"] * 1000) == due]
        yield pd.DataFrame(out, columns=_columns(self._fold)).astype({"event_id": "Int64"})

    def close(self) -> None:
        pass


def breakers(events: DataFrame, fold: Breakers | None = None, late: str = "0 seconds") -> DataFrame:
    """STR-05 as a stream with timers in event time: the rows of the replay, and one without event_id, of strategy ``""`` for
    the whole provider, whenever a wait is over. Needs the RocksDB state store."""
    fold = fold or Breakers()
    timed = events.withColumn("event_time", F.timestamp_micros((F.col("at") * 1e6).cast("long"))).withWatermark("event_time", late)
    return timed.groupBy(fold.key).transformWithStateInPandas(BreakerProcessor(fold), fold.schema, "Append", "EventTime")


def triage(responses: DataFrame, rules: DataFrame) -> DataFrame:
    """STR-01: the verdict of every response of a stream; it keeps no state."""
    return OPERATORS["triage_responses"](responses.sparkSession, responses=responses, rules=rules)
