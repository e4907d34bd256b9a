"""Threads, profiles, retention and stateful folds against known answers."""

import json

import pytest
from pyspark.sql import functions as F

from tidemill.operators import profiles, threads
from tidemill.plans import page_queries, registry
from tidemill.streaming import state

SF = "/root/testdata/sf0.001"


def comment(i, *replies, author="a", body="b"):
    return {"kind": "t1", "data": {"id": i, "author": author, "body": body, "replies": {"data": {"children": list(replies)}} if replies else ""}}


def test_threads(spark):
    forest = [comment("c1", comment("c2", comment("c3", comment("c4")), author="[deleted]"), {"kind": "more", "data": {"count": 0, "children": ["x", "y"]}}), comment("c5", body="[removed]"), comment(""), {"kind": "more", "data": {"count": 7}}]
    doc = json.dumps([{"data": {"children": [{"kind": "t3", "data": {"id": "p", "author": "op", "selftext": "post"}}]}}, {"data": {"children": forest}}])
    df = spark.createDataFrame([(1, doc), (2, "{broken"), (3, None), (4, '[{"data":{"children":[]}}]')], "conv long, doc string")
    rows = threads.flatten_threads(df, "doc", "conv", most_depth=3)
    found = sorted((r.kind, r.id or "", r.parent_id or "", r.depth, r.author, r.text, r.more) for r in rows.collect())
    assert found == sorted([("POST", "p", "", 0, "op", "post", 0), ("COMMENT", "c1", "p", 1, "a", "b", 0), ("REPLY", "c2", "c1", 2, None, "b", 0), ("REPLY", "c3", "c2", 3, "a", "b", 0), ("UNRESOLVED", "c4", "c3", 4, None, None, 0), ("COMMENT", "c5", "p", 1, "a", "", 0), ("MORE", "", "p", 1, None, None, 7), ("MORE", "", "c1", 2, None, None, 2)], key=lambda r: (r[0], r[1], r[2], r[3]))
    whole = threads.completeness(rows, "conv").first()
    assert (whole.loaded, whole.more_nodes, whole.unresolved, whole.complete, whole.reason) == (5, 9, 1, False, "depth limit")


def test_fragility(spark):
    cases = [("css", "#main", 3, "STABLE"), ("css", "article h1", 1, "MEDIUM"), ("css", ".price", 2, "MEDIUM"), ("css", "div:nth-child(2)", -4, "FRAGILE"), ("css", "div .css-1a2b3c", -4, "FRAGILE"), ("css", "a b c d e", -2, "FRAGILE"), ("css", "ul > li > a", -1, "FRAGILE"), ("css", "[data-testid=x]", 4, "STABLE"), ("json", "a.b", 2, "MEDIUM"), ("json", "rows[*].name", 3, "STABLE"), ("json", "rows.0.name", -1, "FRAGILE"), ("json", "a.b.c.d.e.f.g", 1, "MEDIUM"), ("heuristic", "", -2, "FRAGILE"), ("json_ld", "", 4, "STABLE"), ("css", "", -100, "FRAGILE"), ("css", None, -100, "FRAGILE"), ("css", ".a.b", 2, "MEDIUM"), ("css", "main > section > ul:nth-of-type(2n + 1)", -4, "FRAGILE"), ("css", "[itemprop='price'] span", 3, "STABLE"), ("css", "div .card-3f9ab", -4, "FRAGILE"), ("css", "header .title", 1, "MEDIUM"), ("css", ".button_primary", 2, "MEDIUM")]
    df = spark.createDataFrame([(k, locator, "critical", n) for n, (k, locator, _, _) in enumerate(cases)], "kind string, locator string, importance string, n int")
    found = {r.n: (r.score, r.grade, r.blocks_certification) for r in profiles.score_fragility(df).collect()}
    assert found == {n: (score, grade, grade == "FRAGILE") for n, (_, _, score, grade) in enumerate(cases)}


def test_acceptance(spark):
    cases = spark.createDataFrame([(1, "f1", "OK", ["t"], ["x"]), (2, "f2", "OK", None, None), (3, "f3", "OK", [], []), (4, "f1", "OK", ["t", "u", "v"], []), (5, "f1", "OK", [], ["t"])], "case_id int, fixture string, verdict string, expected array<string>, forbidden array<string>")
    triaged = spark.createDataFrame([("f1", "OK"), ("f2", "BLOCKED")], "fixture string, verdict string")
    fields = spark.createDataFrame([("f1", "t")], "fixture string, field string")
    assert {r.case_id: r.reason for r in profiles.run_acceptance_cases(cases, triaged, fields).collect()} == {1: None, 2: "verdict BLOCKED", 3: "no fixture", 4: "missing u,v", 5: "forbidden t"}


def test_retention_skips_what_does_not_fit(spark):
    day = 86400.0
    shots = [("s", "new", 10 * day, 50), ("s", "big", 9 * day, 80), ("s", "small", 8 * day, 40), ("s", "last", 7 * day, 20), ("s", "old", 0.0, 1), ("t", "only", 9 * day, 100), ("t", "more", 8 * day, 1)]
    df = spark.createDataFrame(shots, "store string, path string, saved_at double, bytes long")
    gone = lambda **k: {r.path for r in profiles.prune_snapshots(df, 10 * day, **k).collect()}
    assert gone(most_days=5, most_bytes=100) == {"old", "big", "last", "more"}
    assert gone(most_days=5) == {"old"} and gone() == set()


BREAKER = "provider string, event_id long, strategy string, at double, error_kind string, verdict string"


def test_breakers(spark, tmp_path):
    log = [("v", k, "s", float(k), "TIMEOUT", None) for k in range(2)] + [("v", 2, "s", 2.0, None, "DEAD_URL"), ("v", 3, "s", 3.0, "BAD_REQUEST", None), ("v", 4, "s", 4.0, None, "BLOCKED"), ("v", 5, "s", 65.0, "TIMEOUT", None), ("v", 6, "s", 190.0, None, "OK"), ("v", 7, "t", 200.0, "QUOTA", None), ("v", 8, "s", 300.0, None, "DEAD_URL"), ("v", 9, "s", 3800.0, None, "OK"), ("v", 10, "s", 3900.0, "AUTH", None), ("v", 11, "s", 99999.0, None, "DEAD_URL"), ("w", 12, "s", 5.0, None, "BLOCKED")]
    wanted = ["CLOSED", "CLOSED", "CLOSED", "CLOSED", "OPEN", "OPEN", "CLOSED", "OPEN", "OPEN", "CLOSED", "OPEN", "OPEN", "CLOSED"]
    events = spark.createDataFrame(log, BREAKER)
    fold = state.Breakers(threshold=3)
    found = {r.event_id: (r.state, r.trips, r.cooldown) for r in state.replay(events, fold).collect()}
    assert [found[k][0] for k in range(13)] == wanted
    assert found[4][1:] == (1, 60.0) and found[5][1:] == (2, 120.0) and found[7][2] == 3600.0
    # the stream keeps its state over restarts
    for part, until in ((0, 5), (1, 13)):
        events.where((F.col("event_id") >= part * 5) & (F.col("event_id") < until)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        query = state.stream(spark.readStream.schema(BREAKER).parquet(f"{tmp_path}/in"), fold).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
        query.awaitTermination()
    assert {r.event_id: (r.state, r.trips, r.cooldown) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == found


def test_one_trial_at_a_time(spark):
    """A gate on trial admits one call; the slot comes back by release, by a neutral verdict, or when nobody ends the trial."""
    log = [(0, 0.0, "outcome", "TIMEOUT", None), (1, 1.0, "admit", None, None), (2, 59.0, "admit", None, None), (3, 60.0, "admit", None, None), (4, 61.0, "admit", None, None), (5, 62.0, "release", None, None), (6, 63.0, "admit", None, None), (7, 64.0, "outcome", None, "DEAD_URL"), (8, 65.0, "admit", None, None), (9, 66.0, "admit", None, None), (10, 500.0, "admit", None, None), (11, 501.0, "outcome", "TIMEOUT", None), (12, 600.0, "admit", None, None), (13, 700.0, "admit", None, None), (14, 701.0, "outcome", None, "OK"), (15, 702.0, "admit", None, None), (16, 703.0, "admit", None, None), (17, 704.0, "outcome", "AUTH", None), (18, 99999.0, "admit", None, None), (19, 99999.5, "clear", None, None), (20, 99999.6, "admit", None, None)]
    events = spark.createDataFrame([("v", k, "s", at, a, e, v) for k, at, a, e, v in log], "provider string, event_id long, strategy string, at double, action string, error_kind string, verdict string")
    found = {r.event_id: (r.allowed, r.why) for r in state.replay(events, state.Breakers(threshold=1)).collect() if r.allowed is not None}
    assert {k: v[0] for k, v in found.items()} == {1: False, 2: False, 3: True, 4: False, 6: True, 8: True, 9: False, 10: True, 12: False, 13: True, 15: True, 16: True, 18: False, 20: True}
    assert found[3][1] == "trial" and found[4][1] == "a trial is under way" and "person" in found[18][1] and found[15][1] == "open to all"


def test_breaker_stream_with_timers(spark, tmp_path):
    """The stream gives the replay's rows, and says by a timer when a wait is over."""
    log = [("v", k, "s", 1000.0 + k, "TIMEOUT", None) for k in range(3)] + [("v", 3, "t", 1040.0, None, "OK"), ("v", 4, "s", 1100.0, "TIMEOUT", None), ("v", 5, "t", 1150.0, "QUOTA", None), ("w", 6, "s", 9000.0, None, "BLOCKED")]
    events = spark.createDataFrame(log, BREAKER)
    fold = state.Breakers(threshold=3)
    found = {r.event_id: tuple(r) for r in state.replay(events, fold).collect()}
    for part in ((0, 3), (4,), (5,), (6,)):
        events.where(F.col("event_id").isin([k for k in range(part[0], part[-1] + 1)])).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(BREAKER).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        query = state.breakers(stream, fold).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    assert {r.event_id: tuple(r) for r in rows if r.event_id is not None} == found
    # the first wait of s ended in a failure before a timer saw it; that of 120 s and the provider's hour ran out
    assert sorted((r.strategy, r.cooldown) for r in rows if r.event_id is None) == [("", 3600.0), ("s", 120.0)]


def test_freshness_replay_is_the_window(spark):
    window = {r.obs_id: (r.changed, r.interval_s) for r in registry.queries()["freshness_state"](spark, SF).collect()}
    fold = {r.event_id: (r.changed, round(r.interval_s, 6)) for r in state.replay(_log(spark), state.Freshness()).collect()}
    assert fold == window


def _log(spark):
    from tidemill.plans.registry import _table

    seen = _table(spark, SF, "observations", {})
    body = F.trim(F.regexp_replace("body", r"\s+", " "))
    return seen.select("url", F.col("obs_id").alias("event_id"), (F.unix_micros(F.col("observed_at").cast("timestamp")) / 1e6).alias("at"), "not_modified", F.when(~F.col("not_modified"), F.sha2(body, 256)).alias("content_hash"))


def test_triage_of_a_stream(spark, tmp_path):
    from tidemill.plans.registry import _table

    responses = _table(spark, SF, "responses", {})
    responses.write.parquet(f"{tmp_path}/in")
    rules = _table(spark, SF, "rules", {})
    found = state.triage(spark.readStream.schema(responses.schema).parquet(f"{tmp_path}/in"), rules)
    found.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").option("path", f"{tmp_path}/out").trigger(availableNow=True).start().awaitTermination()
    batch = {r.page_id: r.verdict for r in registry.queries()["triage_responses"](spark, SF).collect()}
    assert {r.page_id: r.verdict for r in spark.read.parquet(f"{tmp_path}/out").collect()} == batch


@pytest.mark.parametrize("name", sorted(page_queries.QUERIES))
def test_queries_run(spark, name):
    assert page_queries.QUERIES[name](spark, SF).count() >= 0


def test_threads_of_the_tables_are_whole(spark):
    rows = page_queries.flatten_threads(spark, SF)
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    deep = turns.where("turn > 9").count()
    assert rows.where("kind in ('POST', 'COMMENT', 'REPLY', 'UNRESOLVED')").count() == turns.count() - deep
