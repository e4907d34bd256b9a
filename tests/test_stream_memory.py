"""Streams with state: what they hold at the end is what the batch operators find in the whole log."""

import math

import pytest
from pyspark.sql import functions as F

from tidemill.plans import registry
from tidemill.streaming import memory

SF = "/root/testdata/sf0.001"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture(scope="module")
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def attempts_of(spark, tmp_path, days=(10, 20, 31)):
    """The attempt log in three files by day, as a stream reads them one after the other."""
    log = registry._table(spark, SF, "attempts", {})
    low = 0
    for high in days:
        part = log.where(f"day(attempted_at) > {low} AND day(attempted_at) <= {high}").coalesce(1)
        part.write.mode("append").parquet(f"{tmp_path}/in")
        low = high
    return spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def drained(stream, tmp_path, name, mode="update"):
    found = []

    def keep(batch, batch_id):
        found.extend((batch_id, r) for r in batch.collect())

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{tmp_path}/cp_{name}").foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    return found


def latest(found, keys):
    out = {}
    for _, r in found:
        key = tuple(r[k] for k in keys)
        if key not in out or r.attempts > out[key].attempts:
            out[key] = r
    return out


def test_summaries_join_like_one_log(spark):
    log = memory.told_by(registry._table(spark, SF, "attempts", {})).toPandas().sort_values(["at", "attempt_id"])
    log.loc[log.index[::7], "latency_ms"] = float("nan")
    for size in (1, 2, 9, 60):
        some = log.head(size)
        ewma = latency = seen = 0
        for r in some.itertuples():
            ewma = 0.25 * r.success + 0.75 * ewma if r.told else ewma
            if not math.isnan(r.latency_ms):
                latency = r.latency_ms if not seen else 0.25 * r.latency_ms + 0.75 * latency
            seen += 1
        held = None
        for at in range(0, size, 4):
            held = memory.joined(held, memory.summary(some.iloc[at : at + 4], 0.25))
        whole = memory.summary(some, 0.25)
        assert held["attempts"] == size and math.isclose(held["ewma"], ewma, abs_tol=1e-12) and math.isclose(held["latency"], latency, abs_tol=1e-9)
        assert all(held[k] == whole[k] or math.isclose(held[k], whole[k], abs_tol=1e-9) for k in held if held[k] is not None)


def test_route_memory_is_the_whole_log(rocks, tmp_path):
    found = drained(memory.route_memory(attempts_of(rocks, tmp_path)), tmp_path, "routes")
    assert len({b for b, _ in found}) == 3
    keys = ("domain", "url_class", "strategy", "level")
    held = latest(found, keys)
    stats = {tuple(r[k] for k in keys): r for r in registry.queries()["route_stats"](rocks, SF).collect()}
    signals = {tuple(r[k] for k in keys): r for r in registry.queries()["ewma_signals"](rocks, SF).collect()}
    assert held.keys() == stats.keys() == signals.keys() and len(held) > 50
    for key, r in held.items():
        s, e = stats[key], signals[key]
        assert (r.attempts, r.scored, r.successes, r.blocks, r.soft_blocks) == (s.attempts, s.scored, s.successes, s.blocks, s.soft_blocks)
        assert math.isclose(r.ewma, e.ewma, abs_tol=1e-6) and math.isclose(r.latency_ms, e.latency_ms, abs_tol=1e-5) and math.isclose(r.credits, s.credits or 0, abs_tol=1e-9)
        assert (r.last_success is None or math.isnan(r.last_success)) == (s.last_success is None)


def test_provider_memory_is_the_whole_log(rocks, tmp_path):
    found = drained(memory.route_memory(attempts_of(rocks, tmp_path), ("provider", "strategy"), "vendor", 0.3), tmp_path, "vendors")
    held = latest(found, ("provider", "strategy"))
    stats = {(r.provider, r.strategy): r for r in registry.queries()["strategy_stats"](rocks, SF).collect()}
    assert held.keys() == stats.keys()
    for key, r in held.items():
        s = stats[key]
        assert (r.attempts, r.scored, r.successes, r.unknown_calls) == (s.attempts, s.scored, s.successes, s.unknown_calls)
        assert math.isclose(r.ewma, s.ewma, abs_tol=1e-6) and math.isclose(r.latency_ms, s.latency_ms, abs_tol=1e-5)


def test_averages_by_hand(spark):
    """The newest of six attempts weighs a quarter; latency starts from the first one."""
    rows = [(k, f"2024-01-0{1 + k // 2} 0{k % 2}:00:00", v, 100.0 * (k + 1)) for k, v in enumerate(["OK", "BLOCKED", "OK", "DEAD_URL", "OK", "THIN_CONTENT"])]
    log = spark.createDataFrame([(*r, "d", "c", "s", "L1", None, None, "EXACT") for r in rows], "attempt_id int, t string, verdict string, latency_ms double, domain string, url_class string, strategy string, level string, provider string, cost_credits double, cost_certainty string").withColumn("attempted_at", F.to_timestamp("t"))
    from tidemill.operators.base import OPERATORS

    got = OPERATORS["ewma_signals"](spark, attempts=log).first()
    ewma, latency = 0.0, 100.0
    for k, (ok, told) in enumerate([(1, 1), (0, 1), (1, 1), (0, 0), (1, 1), (0, 1)]):
        ewma = 0.25 * ok + 0.75 * ewma if told else ewma
        latency = latency if not k else 0.25 * 100 * (k + 1) + 0.75 * latency
    assert (got.ewma, got.latency_ms, got.scored) == (round(ewma, 6), round(latency, 6), 5)
    streaks = [("OK", 1), ("BLOCKED", 3), ("BLOCKED", 4), ("OK", 1), ("BLOCKED", 6), ("DEAD_URL", 1), ("ORIGIN_DOWN", 2)]
    flat = [v for v, n in streaks for _ in range(n)]
    # two attempts a day, so that runs go over days
    log = spark.createDataFrame([(k, "d", v, f"2024-01-{1 + k // 2:02d} 0{k % 2}:00:00") for k, v in enumerate(flat)], "attempt_id int, domain string, verdict string, t string").withColumn("attempted_at", F.to_timestamp("t"))
    found = {r.verdict: (r.longest, r.streaks, r.opened) for r in OPERATORS["breaker_streaks"](spark, attempts=log).collect()}
    assert found == {"BLOCKED": (7, 2, 2), "ORIGIN_DOWN": (2, 1, 0)}


def requests_of(spark):
    return registry._table(spark, SF, "observed_requests", {})


def test_discovery_stream_is_the_whole_log(spark, tmp_path):
    from tidemill.sources.versions import VersionedTable
    from tidemill.streaming import evidence

    log = requests_of(spark)
    for low, high in ((0, 9), (9, 10), (10, 31)):
        log.where(f"day(observed_at) > {low} AND day(observed_at) <= {high}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    table = VersionedTable(spark, f"{tmp_path}/evidence")
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    evidence.discover(stream, table, f"{tmp_path}/cp").awaitTermination()
    columns = ["identity", "domain", "requests", "runs", "validated", "rejected", "changes", "pages", "first_seen", "last_seen", "state"]
    rows = lambda df: sorted(map(tuple, df.select(*columns).collect()))
    batch = registry.queries()["endpoint_evidence"](spark, SF)
    assert rows(table.read()) == rows(batch) and len(table.history()) == 3
    # a batch that comes again changes nothing
    evidence.merge_into(table)(log.where("day(observed_at) > 10"), 2)
    assert len(table.history()) == 3 and rows(table.read()) == rows(batch)


def test_evidence_states(spark):
    """Pages make an endpoint valid, a new shape takes that back, and a refused run refuses it."""
    from tidemill.streaming import evidence

    day = lambda k: f"2024-01-{k:02d}"
    schema = "identity string, domain string, run string, requests long, signature string, pages string, rejection string, validated boolean"
    run = lambda k, sig, pages, no=None: spark.createDataFrame([("e", "d", day(k), 2, sig, pages, no, no is None)], schema).withColumn("run", F.to_date("run"))
    held, states = None, []
    for args in ((1, "a", "p1,p2"), (2, "a", "p2,p3"), (3, "b", "p4"), (4, "b", "p4"), (5, None, "p4", "REJECTED_STATUS"), (6, "c", "p5")):
        held = evidence.fold(held, run(*args))
        states.append(tuple(held.select("state", "changes", "pages", "requests").first()))
    assert states == [("PROMISING", 0, 2, 2), ("VALIDATED", 0, 3, 4), ("REVALIDATION_REQUIRED", 1, 4, 6), ("VALIDATED", 1, 4, 8), ("REJECTED", 1, 4, 10), ("VALIDATED", 1, 5, 12)]
    full = spark.createDataFrame([(f"e{k:03d}", "d", day(1), 1, "a", "p", None, False) for k in range(120)], schema).withColumn("run", F.to_date("run"))
    kept = evidence.fold(None, full)
    assert kept.count() == 100 and evidence.fold(kept, run(2, "a", "q")).count() == 100


def test_versions(spark, tmp_path):
    from tidemill.sources.versions import VersionedTable, publish

    table = VersionedTable(spark, f"{tmp_path}/t")
    rows = lambda: sorted(map(tuple, table.read().collect()))
    frame = lambda *r: spark.createDataFrame(list(r), "k string, v int")
    assert table.read() is None and table.history() == []
    assert publish(table, frame(("a", 1), ("b", 1)), "k", True) and rows() == [("a", 1), ("b", 1)]
    assert not publish(table, frame(("a", 9)), "k", False) and rows() == [("a", 1), ("b", 1)]
    before = table.read()
    assert publish(table, frame(("b", 2), ("c", 2)), "k", True) and rows() == [("a", 1), ("b", 2), ("c", 2)]
    assert sorted(map(tuple, before.collect())) == [("a", 1), ("b", 1)]  # who reads keeps the version
    table.rollback()
    assert rows() == [("a", 1), ("b", 1)]
    assert table.commit(frame(("z", 0)), batch_id=7) and table.commit(frame(("y", 0)), batch_id=7) is None and rows() == [("z", 0)]
