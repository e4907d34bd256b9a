"""Files, JSON paths and streams against plain versions."""

import json

from pyspark.sql import functions as F

from tidemill.operators import json_paths
from tidemill.plans import registry
from tidemill.sources import files
from tidemill.streaming import folds

SF = "/root/testdata/sf0.001"


def test_snapshots(spark, tmp_path):
    for k, body in enumerate((b"<html>\xff</html>", None)):
        folder = tmp_path / f"k{k}"
        folder.mkdir()
        (folder / "0.meta.json").write_text(json.dumps({"url": f"https://x.test/{k}", "status": 200, "headers": {"a": "b"}, "verdict": "OK"}, indent=1))
        if body:
            (folder / "0.body").write_bytes(body)
    found = {r.url: bytes(r.body) for r in files.read_snapshots(spark, str(tmp_path)).collect()}
    assert found == {"https://x.test/0": b"<html>\xff</html>", "https://x.test/1": b""}


def test_sinks_and_rules(spark, tmp_path):
    rows = spark.createDataFrame([("d", "OK", "x"), ("d", "BLOCKED", None)], "day string, verdict string, body string")
    files.write_snapshots(rows, str(tmp_path / "s"))
    files.append_log(rows, str(tmp_path / "l"), "day")
    files.append_log(rows, str(tmp_path / "l"), "day")
    files.write_report(rows, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "s")).where("body_sha256 = sha2('x', 256)").count() == 1
    assert spark.read.parquet(str(tmp_path / "l")).count() == 4
    assert spark.read.json(str(tmp_path / "r")).count() == 2
    (tmp_path / "p.json").write_text(json.dumps({"defaults": {"canary": "<main", "stop_signatures": ["no bots"]}, "classes": [{"name": "a", "match": "/a/"}, {"name": "b", "match": "/b/", "min_body_bytes": 9, "canary": "", "canaries": ["x", "y"], "expected_content_type": "json", "required_json_paths": ["a.b", "c"], "stop_signatures": []}]}))
    assert [tuple(r) for r in files.read_rules(spark, str(tmp_path / "p.json")).orderBy("position").collect()] == [(1, "a", "/a/", 500, "<main", "", "", "no bots"), (2, "b", "/b/", 9, "x;y", "json", "a.b;c", "")]


def test_json_paths(spark):
    docs = [(1, '{"a":{"b":1,"c":[{"d":1},{"e":2},{"f":3},{"g":4}]},"x":[]}'), (2, None), (3, "{broken"), (4, '{"Full-Name":"n"}')]
    df = spark.createDataFrame(docs, "k int, body string")
    paths = json_paths.json_leaf_paths(df, "body", "k")
    assert sorted(map(tuple, paths.collect())) == [(1, "a.b"), (1, "a.c[].d"), (1, "a.c[].e"), (1, "a.c[].f"), (1, "x"), (4, "Full-Name")]
    wanted = spark.createDataFrame([("full_name",)], "field string")
    assert [tuple(r) for r in json_paths.locate_fields(paths, wanted).collect()] == [("full_name", "Full-Name", 1)]
    now = json_paths.json_leaf_paths(spark.createDataFrame([(1, '{"z":{"b":1},"x":[]}')], "k int, body string"), "body", "k")
    lost = {tuple(r) for r in json_paths.lost_json_paths(paths, now, "k").collect()}
    assert lost == {(1, "a.b", "z.b"), (1, "a.c[].d", None), (1, "a.c[].e", None), (1, "a.c[].f", None)}
    assert {r.k: r.signature for r in json_paths.schema_signatures(df, "body", "k").collect()}[3] is None


def test_json_queries(spark):
    found = {name: q(spark, SF).collect() for name, q in registry.PLAIN.items()}
    records = registry._table(spark, SF, "records", {}).collect()
    side = {s: {r.natural_key: set(json.loads(r.data)) for r in records if r.side == s} for s in ("clean", "staging")}
    lost = {(k, p) for k, p_ in side["clean"].items() if k in side["staging"] for p in p_ - side["staging"][k]}
    assert {(r.natural_key, r.path) for r in found["lost_json_paths"]} == lost and lost
    assert {(r.field, r.path, r.n) for r in found["locate_fields"]} == {(f, p, len(side["clean"])) for f, p in (("nChars", "n_chars"), ("lang", "lang"))}
    assert found["json_leaf_paths"] and found["schema_signatures"]


def test_admission_is_the_fold(spark):
    from tidemill.operators import sampling

    rows = [r for r in registry._table(spark, SF, "provider_outcomes", {}).where("attempted and eligible").collect()]
    spent, stopped, expected = {}, set(), {}
    for r in sorted(rows, key=lambda r: (r.recorded_at, r.outcome_id)):
        s, p = (r.session,), (r.session, r.provider)
        for scope, cap, name in ((p, sampling.PROVIDER_CAP, "PROVIDER_CAP"), (s, sampling.SESSION_CAP, "SESSION_CAP")):
            if scope in stopped or spent.get(scope, 0) + sampling.WORST_CASE > cap:
                stopped.add(scope)
                expected[r.outcome_id] = name
                break
        else:
            expected[r.outcome_id] = "ADMITTED"
            for scope in (p, s):
                spent[scope] = spent.get(scope, 0) + (r.reported_credits if r.reported_credits is not None else sampling.WORST_CASE)
    found = {r.outcome_id: r.decision for r in registry.queries()["admit_under_caps"](spark, SF).collect()}
    assert {k for k, v in found.items() if v == "ADMITTED"} == {k for k, v in expected.items() if v == "ADMITTED"} and found.keys() == expected.keys()


def test_streams(spark, tmp_path):
    rows = [(f"2024-01-0{d} 0{h}:00:00", v, c) for d in (1, 2) for h in (1, 2) for v, c in (("OK", 1), ("BLOCKED", None))] + [("2024-01-09 00:00:00", "OK", 9)]
    log = spark.createDataFrame(rows, "t string, verdict string, cost_credits int").select(F.to_timestamp("t").alias("attempted_at"), "verdict", "cost_credits")
    log.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "in"))
    folds.drain(folds.verdict_counts(stream), str(tmp_path / "out"), str(tmp_path / "c1"))
    found = {(str(r.day)[:10], r.verdict): (r.attempts, r.credits) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert found == {(f"2024-01-0{d}", v): (2, c) for d in (1, 2) for v, c in (("OK", 2), ("BLOCKED", None))}
    charges = spark.createDataFrame([("a", 1), ("b", 2), ("a", 1)], "request_id string, usd int").withColumn("event_at", F.to_timestamp(F.lit("2024-01-01")))
    charges.write.parquet(str(tmp_path / "in2"))
    folds.drain(folds.dedupe_charges(spark.readStream.schema(charges.schema).parquet(str(tmp_path / "in2"))), str(tmp_path / "out2"), str(tmp_path / "c2"))
    assert sorted(r.request_id for r in spark.read.parquet(str(tmp_path / "out2")).collect()) == ["a", "b"]
