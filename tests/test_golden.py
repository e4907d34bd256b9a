"""Operators against known answers, apart from their own text."""

import datetime as dt

from tidemill.operators import load
from tidemill.operators.base import OPERATORS

load()


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def at(minute):
    return dt.datetime(2026, 1, 1, 0, minute)


def test_freshness_compares_with_the_last_stored_body(spark):
    log = [(1, "u", at(0), False, "a  b"), (2, "u", at(1), True, None), (3, "u", at(2), False, " a b "), (4, "u", at(3), False, "c"), (5, "u", at(4), True, None), (6, "u", at(5), False, None), (7, "u", at(6), False, "c"), (8, "v", at(0), True, None)]
    found = OPERATORS["freshness_state"](spark, observations=spark.createDataFrame(log, "obs_id long, url string, observed_at timestamp, not_modified boolean, body string"))
    assert rows(found, "obs_id", "changed", "interval_s") == [(1, True, 900.0), (2, False, 1350.0), (3, False, 2025.0), (4, True, 900.0), (5, False, 1350.0), (6, True, 900.0), (7, False, 1350.0), (8, False, 900.0)]
    last = {r.obs_id: r.last_changed for r in found.collect()}
    assert last[3] == at(0) and last[5] == at(3) and last[7] == at(5) and last[8] == at(0)


def test_accounting_counts_urls_once(spark):
    queue = spark.createDataFrame([("a", "DONE"), ("b", "RETRY"), ("c", "IN_PROGRESS"), ("d", "ODD")], "url string, status string")
    missing = OPERATORS["missing_seeds"](spark, seeds=spark.createDataFrame([("a",), ("x",), ("x",), ("y",), (None,)], "url string"), advance_queue=queue)
    assert {r.url for r in missing.collect()} == {"x", "y", None}
    found = OPERATORS["url_accounting"](spark, advance_queue=queue, missing_seeds=missing).first()
    assert (found.input_urls, found.settled, found.carried, found.lost, found.missing, found.unaccounted, found.complete) == (4, 2, 1, 1, 2, 2, False)
    whole = OPERATORS["url_accounting"](spark, advance_queue=queue.where("url <> 'c'"), missing_seeds=missing.limit(0)).first()
    assert whole.complete and whole.unaccounted == 0


def test_queue_takes_each_canonical_url_once(spark):
    urls = spark.createDataFrame([(1, "https://a/"), (2, "https://a/"), (3, "https://b/"), (4, "https://c/")], "page_id long, canonical_url string")
    found = OPERATORS["enqueue_new_urls"](spark, canonicalize_urls=urls, queued_pages=spark.createDataFrame([(2,), (4,)], "page_id long"))
    assert rows(found, "url", "outcome") == [("https://a/", "skipped"), ("https://b/", "added"), ("https://c/", "skipped")]


RECORDS = "side string, staged_at long, natural_key string, url_class string, data string, lang_source string"


def test_last_write_wins_whole_and_promotion_keeps_one_row_a_key(spark):
    records = spark.createDataFrame([("staging", 1, "k", "z", '{"v":9}', "m"), ("staging", 2, "k", "a", '{"v":1}', "m"), ("clean", 0, "k", "c", '{"v":0}', "m"), ("clean", 0, "k", "c", '{"v":0}', "m"), ("clean", 0, "old", "c", '{"v":5}', "m"), ("staging", 1, "new", "c", '{"v":7}', "m")], RECORDS)
    staged = OPERATORS["stage_records"](spark, records=records)
    assert rows(staged, "side", "natural_key", "url_class", "conflict") == [("clean", "k", "c", False), ("clean", "old", "c", False), ("staging", "k", "a", True), ("staging", "new", "c", False)]
    findings = spark.createDataFrame([("f", "x", "warn")], "field string, finding string, severity string")
    verdict = spark.createDataFrame([(1, 0.0, "ok")], "staged long, worst double, reason string")
    sha = {(r.side, r.natural_key): r.data_sha for r in staged.collect()}
    passed = OPERATORS["promote"](spark, stage_records=staged, drift_findings=findings, validate_staging=verdict)
    assert rows(passed, "natural_key", "origin", "data_sha") == sorted([("k", "staging", sha["staging", "k"]), ("new", "staging", sha["staging", "new"]), ("old", "clean", sha["clean", "old"])])
    assert {r.natural_key: r.last_known_good for r in passed.collect()}["k"] == sha["clean", "k"]
    blocked = OPERATORS["promote"](spark, stage_records=staged, drift_findings=findings.selectExpr("field", "finding", "'block' AS severity"), validate_staging=verdict)
    assert rows(blocked, "natural_key", "origin") == [("k", "clean"), ("old", "clean")]


def test_types_do_not_hang_on_white_space(spark):
    records = spark.createDataFrame([("clean", 0, "k", "c", '{"lang": "en","source" :"s","n_chars": 4,"quality":1.5}', "m")], RECORDS)
    assert rows(OPERATORS["record_fields"](spark, records=records), "field", "type") == [("lang", "str"), ("n_chars", "int"), ("quality", "float"), ("source", "str")]


def test_numbers_by_the_last_separator(spark):
    texts = ["$1,234.50", "1.234,50 EUR", "-12", "sold out", "1,234,567", "12,5", ""]
    found = OPERATORS["normalize_numbers"](spark, price_texts=spark.createDataFrame(list(enumerate(texts)), "text_id long, raw string"))
    assert {r.text_id: r.value for r in found.collect()} == {0: 1234.5, 1: 1234.5, 2: -12.0, 3: None, 4: None, 5: 12.5, 6: None}


def test_repairs_follow_the_field(spark):
    lost = spark.createDataFrame([(1, "price", "lost"), (1, "title", "lost"), (2, "h2", "lost"), (2, "h1", "gained")], "page_id long, field string, change string")
    routes = spark.createDataFrame([("GET a", "VALIDATED"), ("GET b", "PROMISING")], "identity string, state string")
    fields = spark.createDataFrame([("GET a", "price"), ("GET b", "h2")], "identity string, field string")
    values = spark.createDataFrame([(7, "title", 1, "meta", "x")], "page_id long, field string, position int, source string, value string")
    found = OPERATORS["propose_repairs"](spark, diff_fields=lost, endpoint_candidates=routes, endpoint_fields=fields, extractor_values=values)
    assert rows(found, "page_id", "field", "proposal") == [(1, "price", "MIGRATE"), (1, "title", "ADD_QUORUM_SOURCE"), (2, "h2", "NEEDS_INVESTIGATION")]


def test_percentile_is_the_element_at_the_cut_index(spark):
    log = [("a", float(x)) for x in (5, 1, 3, 3, 9, 7)] + [("b", 2.0), ("c", None)]
    found = OPERATORS["latency_percentiles"](spark, attempts=spark.createDataFrame(log, "domain string, latency_ms double"))
    assert rows(found, "domain", "p50", "p95", "p99", "most") == [("a", 5.0, 9.0, 9.0, 9.0), ("b", 2.0, 2.0, 2.0, 2.0)]


def test_one_spelling_of_an_address(spark):
    cases = {
        "HTTPS://Example.COM:443/a/../b/?utm_source=x&z=1&a=2#frag": "https://example.com/b/?a=2&z=1",
        "http://x.example:8080/p": "http://x.example:8080/p",
        "http://u:p@X.example:80": "http://x.example/",
        "https://x.example/./a//../b/./c/..": "https://x.example/a//b",
        "https://x.example/../..": "https://x.example/",
        " https://x.example/p?b=&a&Ref=1&c=x,y+z%2fq&&b=1 ": "https://x.example/p?a=&b=&b=1&c=x%2Cy+z%2Fq",
        "https://x.example/p?q=%C3%A9~*&q=A": "https://x.example/p?q=A&q=%C3%A9~%2A",
        "https://x.example?gclid=1": "https://x.example/",
    }
    rows = spark.createDataFrame(list(enumerate(cases)), "page_id long, url string")
    assert {r.page_id: r.canonical_url for r in OPERATORS["canonicalize_urls"](spark, responses=rows).collect()} == dict(enumerate(cases.values()))


def test_routes_by_evidence(spark):
    """The declared order without evidence; the declared route held within its lead; cheaper and as reliable wins; slow loses; paid is no matter."""
    declared, stats, signals = [], [], []

    def group(name, *routes):
        for position, (level, scored, bound, latency) in enumerate(routes):
            declared.append((name, "c", position, "s", level))
            if scored is not None:
                stats.append((name, "c", "s", level, scored, bound))
                signals.append((name, "c", "s", level, latency))

    group("thin", ("L2", 7, 0.1, 1.0), ("L1", None, None, None), ("L0", 3, 0.9, 1.0))
    group("held", ("L1", 20, 0.5, 1.0), ("L2", 20, 0.6, 1.0))
    group("beaten", ("L1", 20, 0.5, 1.0), ("L2", 20, 0.7, 1.0))
    group("cheap", ("L1", 20, 0.5, 1.0), ("L0", 20, 0.5, 1.0))
    group("weak", ("L1", 20, 0.52, 1.0), ("L0", 20, 0.5, 1.0))
    group("slow", ("L1", 20, 0.9, 60000.0), ("L2", 20, 0.9, 2000.0), ("L0", 20, 0.1, 1.0))
    group("paid", ("L3", 20, 0.9, 1.0), ("L1", 20, 0.2, 1.0), ("L0", 20, 0.1, 1.0))
    keys = "domain string, url_class string"
    tables = {
        "declared_routes": spark.createDataFrame(declared, f"{keys}, position int, strategy string, level string"),
        "route_stats": spark.createDataFrame(stats, f"{keys}, strategy string, level string, scored long, bound double"),
        "ewma_signals": spark.createDataFrame(signals, f"{keys}, strategy string, level string, latency_ms double"),
    }
    rows = OPERATORS["rank_routes"](spark, **tables).collect()
    order, scores = {}, {(r.domain, r.level): r.score for r in rows}
    for r in sorted(rows, key=lambda r: (r.domain, r.rnk)):
        if not r.shadow_probe:
            order.setdefault(r.domain, []).append(r.level)
    probing = {r.domain for r in rows if r.shadow_probe}
    wanted = {"thin": ["L2", "L0", "L1"], "held": ["L1", "L2"], "beaten": ["L2", "L1"], "cheap": ["L0", "L1"], "weak": ["L1", "L0"], "slow": ["L2", "L1", "L0"], "paid": ["L1", "L0"]}
    assert {k: v for k, v in order.items() if k not in probing} == {k: v for k, v in wanted.items() if k not in probing} and len(probing) <= 2
    assert scores["slow", "L1"] == 0.87 and scores["held", "L1"] == 0.62 and scores["thin", "L2"] == 0.9 and scores["thin", "L0"] == 0.7
    assert {r.domain for r in rows if r.held} == {"held", "weak"}
