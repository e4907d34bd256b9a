"""Damaged pages, reactions, certification, posts and corpora against known answers."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemill.operators import mutations, posts
from tidemill.operators.base import OPERATORS
from tidemill.plans import page_queries, registry
from tidemill.sources import corpora

PAGE = """<html><head><script type="application/ld+json">{"@type":"Article","headline":"H","author":{"name":"Ann"}}</script></head>
<body><h1 class="article title" id="t">One <b>two</b></h1><br><ul><li>a<li class="x">b</li></ul><p class='lead'>lead</p></body></html>"""
ROWS = '[{"score": 3, "note": "n", "tags": ["x"], "in": {"score": "deep"}}]'


def damaged(kind, target, text=PAGE):
    return (mutations.damage_json if text[:1] in "[{" else mutations.damage_markup)(text, kind, target)


def test_markup_is_cut_at_its_elements():
    gone = damaged("remove_critical_field", "title")
    assert "<h1" not in gone and "headline" not in gone and "two" not in gone and '"author": {}' in gone and "<p class='lead'>lead</p>" in gone
    renamed = damaged("rename_css_class", "lead")
    assert "class='lead-v2'" in renamed and "headline" in renamed and damaged("rename_css_class", "lea") == PAGE
    wrapped = damaged("wrap_dom_node", "lead")
    assert """<div class="layout-wrapper"><p class='lead'>lead</p></div></body>""" in wrapped
    assert '<ul><li class="x">b</li><li>a</ul>' in damaged("move_element", "li")
    assert damaged("move_element", "h1") == PAGE and damaged("remove_optional_field", "absent") == PAGE and damaged("rename_json_key", "title") == PAGE
    assert damaged("remove_optional_field", "br", "<p>x<br class=br>y</p>") == "<p>xy</p>"


def test_json_is_edited_everywhere():
    read = lambda kind, target="", text=ROWS: json.loads(damaged(kind, target, text))
    assert read("rename_json_key", "score") == [{"score_v2": 3, "note": "n", "tags": ["x"], "in": {"score_v2": "deep"}}]
    assert read("change_field_type", "score") == [{"score": "3", "note": "n", "tags": ["x"], "in": {"score": {"value": "deep"}}}]
    assert read("remove_critical_field", "note")[0].keys() == {"score", "tags", "in"}
    assert read("empty_collection") == [] and read("empty_collection", "a", '{"a":[1],"b":[2]}') == {"a": [], "b": [2]} and read("empty_collection", "", '{"a":[1],"b":[2],"c":3}') == {"a": [], "b": [], "c": 3}
    assert read("remove_pagination_cursor", "", '{"items":[1],"next_cursor":"p2","meta":{"after":1,"n":2}}') == {"items": [1], "meta": {"n": 2}}
    assert damaged("empty_collection", "", "{broken") == "{broken" and damaged("rename_css_class", "note") == PAGE


def test_mutated_pages(spark):
    docs = spark.createDataFrame([(1, PAGE, "HTML"), (2, ROWS, "JSON"), (3, "a\0", "BINARY"), (4, None, "UNKNOWN"), (5, "", "UNKNOWN")], "id int, body string, content_kind string")
    chosen = mutations.default_mutations({"title": "critical", "note": "optional"}, ["lead"], True, False) + [("rename_json_key", "score")]
    assert [k for k, _ in chosen] == ["remove_critical_field", "remove_optional_field", "rename_css_class", "wrap_dom_node", "move_element", "remove_pagination_cursor", "rename_json_key"]
    found = {(r.id, r.kind): r for r in mutations.mutate_pages(docs, chosen, "id").collect()}
    assert len(found) == 35 and {k for k, r in found.items() if r.changed} == {(1, "remove_critical_field"), (1, "rename_css_class"), (1, "wrap_dom_node"), (1, "move_element"), (2, "remove_optional_field"), (2, "rename_json_key")}
    assert mutations.default_mutations({"a": "critical"}, ["x"], False, True) == [("remove_critical_field", "a"), ("rename_json_key", "a"), ("change_field_type", "a"), ("empty_collection", "")]
    with pytest.raises(ValueError):
        mutations.mutate_pages(docs, [("shake", "")], "id")


def test_reactions_of_a_profile(spark):
    rules = spark.createDataFrame([(1, "page", "/p/", 1, "", "", "", ""), (2, "api", "/api/", 1, "", "json", "items.0.score;next", "")], "position int, url_class string, pattern string, min_body_bytes int, canary string, expected_type string, json_paths string, signatures string")
    docs = spark.createDataFrame([(1, "https://s.test/p/1", PAGE, "HTML"), (2, "https://s.test/api/1", '{"items":[{"score":1}],"next":"c"}', "JSON")], "id int, url string, body string, content_kind string")
    extractors = [{"kind": "json_ld", "type": "Article", "fields": ["title"]}, {"kind": "css", "fields": {"title": ".title", "lead": ".lead"}}, {"kind": "json", "fields": {"title": "items.0.score", "lead": "next"}}]
    each = [("remove_critical_field", "title"), ("remove_optional_field", "lead"), ("rename_css_class", "title"), ("rename_css_class", "lead"), ("rename_json_key", "score"), ("empty_collection", ""), ("remove_pagination_cursor", ""), ("change_field_type", "items")]
    broken = mutations.mutate_pages(docs, each, "id", "url")
    seen = mutations.profile_reactions(broken, rules, extractors, {"title": "critical", "lead": "optional"}, "id", "url")
    found = {(r.id, r.kind, r.target): r.observed for r in seen.collect()}
    assert {k[1:]: v for k, v in found.items() if k[0] == 1} == {("remove_critical_field", "title"): "FAILS", ("remove_optional_field", "lead"): "WARNS", ("rename_css_class", "title"): "SURVIVES", ("rename_css_class", "lead"): "WARNS", ("rename_json_key", "score"): "SURVIVES", ("empty_collection", ""): "SURVIVES", ("remove_pagination_cursor", ""): "SURVIVES", ("change_field_type", "items"): "SURVIVES"}
    assert {k[1]: v for k, v in found.items() if k[0] == 2 and k[1] in ("rename_json_key", "empty_collection", "remove_pagination_cursor", "change_field_type")} == {"rename_json_key": "DRIFT", "empty_collection": "EMPTY", "remove_pagination_cursor": "INCOMPLETE", "change_field_type": "DRIFT"}


def test_reactions_are_judged_by_loudness(spark):
    cases = [("rename_css_class", "SURVIVES", True, False), ("rename_css_class", "FAILS", False, False), ("rename_json_key", "FAILS", True, True), ("rename_json_key", "SURVIVES", False, True), ("remove_optional_field", "SURVIVES", True, True), ("remove_critical_field", "WARNS", False, False), ("remove_critical_field", "FAILS", True, False), ("empty_collection", "DRIFT", True, True), ("remove_pagination_cursor", "WARNS", False, False), ("move_element", "WARNS", False, False)]
    runs = spark.createDataFrame([("d", k, str(n), o) for n, (k, o, _, _) in enumerate(cases)], "domain string, kind string, target string, observed string")
    assert {int(r.target): (r.passed, r.advisory) for r in OPERATORS["judge_mutations"](spark, mutation_runs=runs).collect()} == {n: (p, a) for n, (_, _, p, a) in enumerate(cases)}


def test_an_evaluator_may_fail_on_a_page(spark):
    docs = spark.createDataFrame([(1, "ab"), (2, None), (3, "")], "id int, body string")

    def size(page):
        return {"size": len(page["body"]), "first": page["body"][0]}

    found = {r.id: tuple(r)[1:] for r in mutations.evaluate_pages(docs, size, "size long, first string", "id").collect()}
    assert found[1] == (2, "a", None) and found[2][0] is None and "TypeError" in found[2][2] and "IndexError" in found[3][2]


TABLES = {
    "profile_classes": ("domain string, url_class string, has_freshness boolean, has_promotion boolean, has_pagination boolean", [("d", "c", True, True, False)]),
    "profile_fields": ("domain string, url_class string, field string, importance string", [("d", "c", "title", "critical")]),
    "case_outcomes": ("case_id int, domain string, url_class string, kind string, negative boolean, verdict string, passed boolean, comparisons int, conflicts int", [(1, "d", "c", "normal", False, "OK", True, 50, 1), (2, "d", "c", "not_found", True, "DEAD_URL", True, 0, 0)]),
    "case_fields": ("case_id int, field string", [(1, "title")]),
    "excused_kinds": ("domain string, url_class string, kind string", []),
    "extractor_grades": ("domain string, url_class string, field string, importance string, grade string", [("d", "c", "title", "critical", "FRAGILE"), ("d", "c", "title", "critical", "MEDIUM")]),
    "api_routes": ("domain string, url_class string, route_id string, distinct_pages long, schema_stable boolean, state string", []),
    "mutation_summary": ("domain string, kind string, runs long, blocking long, advice long", [("d", "k", 3, 0, 0)]),
    "profile_texts": ("domain string, text string", [("d", "match: /x/")]),
}
CASE = TABLES["case_outcomes"][1]


@pytest.mark.parametrize(
    ("changes", "verdict", "failing"),
    [
        ({}, "CERTIFIED", set()),
        ({"case_outcomes": []}, "INSUFFICIENT_EVIDENCE", None),
        ({"case_outcomes": CASE[:1]}, "NOT_CERTIFIED", {"negative_case"}),
        ({"case_outcomes": [(*CASE[0][:6], False, 50, 1), CASE[1]]}, "NOT_CERTIFIED", {"cases_pass"}),
        ({"case_outcomes": [(*CASE[0][:7], 50, 2), CASE[1]]}, "NOT_CERTIFIED", {"quorum_conflicts"}),
        ({"case_outcomes": [(*CASE[0][:7], 0, 0), CASE[1]]}, "CERTIFIED_WITH_WARNINGS", {"quorum_conflicts"}),
        ({"case_fields": [(1, "lead")]}, "NOT_CERTIFIED", {"critical_fields_present"}),
        ({"profile_fields": [("d", "c", "title", "optional")], "extractor_grades": []}, "NOT_CERTIFIED", {"critical_fields_declared"}),
        ({"profile_classes": [("d", "c", False, True, False)]}, "CERTIFIED_WITH_WARNINGS", {"freshness_policy"}),
        ({"profile_classes": [("d", "c", True, True, True)]}, "NOT_CERTIFIED", {"pagination"}),
        ({"profile_classes": [("d", "c", True, True, True)], "excused_kinds": [("d", "c", "pagination")]}, "CERTIFIED", set()),
        ({"profile_classes": [("d", "c", True, True, True)], "case_outcomes": [*CASE, (3, "d", "c", "pagination", False, "EMPTY", True, 0, 0)]}, "CERTIFIED", set()),
        ({"profile_classes": [("d", "c", True, True, False), ("d", "other", True, True, False)]}, "NOT_CERTIFIED", {"cases_run"}),
        ({"extractor_grades": [("d", "c", "title", "critical", "FRAGILE")]}, "NOT_CERTIFIED", {"selector_fragility"}),
        ({"api_routes": [("d", "c", "r", 3, True, "VALIDATED")]}, "CERTIFIED", set()),
        ({"api_routes": [("d", "c", "r", 2, True, "VALIDATED")]}, "NOT_CERTIFIED", {"api_route_validated"}),
        ({"api_routes": [("d", "c", "r", 9, False, "VALIDATED")]}, "NOT_CERTIFIED", {"api_route_validated"}),
        ({"mutation_summary": []}, "CERTIFIED_WITH_WARNINGS", {"mutation_coverage"}),
        ({"mutation_summary": [("d", "k", 3, 0, 1)]}, "CERTIFIED_WITH_WARNINGS", {"mutation_coverage"}),
        ({"mutation_summary": [("d", "k", 3, 1, 1)]}, "NOT_CERTIFIED", {"mutation_coverage"}),
        ({"profile_texts": [("d", "api_key: abcdefgh12")]}, "NOT_CERTIFIED", {"no_secrets"}),
    ],
)
def test_certification(spark, changes, verdict, failing):
    tables = {name: spark.createDataFrame(changes.get(name, rows), schema) for name, (schema, rows) in TABLES.items()}
    checks = OPERATORS["certification_checks"](spark, **tables)
    whole = OPERATORS["certify_profiles"](spark, profile_classes=tables["profile_classes"], case_outcomes=tables["case_outcomes"], certification_checks=checks)
    assert [r.verdict for r in whole.collect()] == [verdict]
    if failing is not None:
        assert {r.name for r in checks.where("NOT passed").collect()} == failing


def test_posts(spark):
    nested = '{"rest_id":"1","core":{"user":{"rest_id":"9"}},"legacy":{"full_text":"a \\"q\\" {x} https://t.example/a"},"quoted":{"rest_id":"2","legacy":{"full_text":"inner"}}}'
    rows = [(1, f"<script>d={nested};</script> /bob/status/77"), (2, "<a href='/ann/status/5'><a href=\"/ann/status/5\"><a href='https://x.com/bob/status/6?s=1'>"), (3, '{"rest_id":"3","legacy":{"full_text":"cut'), (4, None), (5, "<p>nothing</p>")]
    found = [tuple(r) for r in posts.parse_social_pages(spark.createDataFrame(rows, "id int, body string"), "id").orderBy("id", "place").collect()]
    assert found == [(1, 0, "1", "x:1", None, 'a "q" {x} https://t.example/a', ["https://t.example/a"], "data"), (1, 1, "2", "x:2", None, "inner", [], "data"), (2, 0, "5", "x:5", "ann", "", [], "link"), (2, 1, "6", "x:6", "bob", "", [], "link")]


def test_corpora(spark, tmp_path):
    good = {"name": "fleet", "targets": [{"url": "https://a.test/x", "kind": "listing", "expected": {"canaries": ["<li"], "target_status": 404, "content_kind": "json"}}, {"url": "https://b.test/", "domain": "b", "kind": "lising"}, "text", {"expected": {}}, {"url": "u", "expected": {"target_status": "soon"}}]}
    (tmp_path / "1.json").write_text(json.dumps(good, indent=2))
    (tmp_path / "2.json").write_text("{not json")
    (tmp_path / "3.json").write_text('{"name": "none"}')
    rows = corpora.load_corpus(spark, str(tmp_path)).withColumn("f", F.regexp_extract("file", "([0-9]).json", 1)).orderBy("f", "place").collect()
    assert [(r.f, r.place, r.error) for r in rows] == [("1", 1, None), ("1", 2, "unknown kind lising"), ("1", 3, "the target is no mapping"), ("1", 4, "the target has no url"), ("1", 5, "a number is expected"), ("2", None, "the file is no JSON"), ("3", None, "the manifest needs a list of targets")]
    first = rows[0]
    assert (first.corpus, first.domain, first.url_class, first.content_kind, first.target_status, first.min_body_bytes, first.canaries, first.json_paths) == ("fleet", "a.test", "page", "JSON", 404, 500, ["<li"], [])
    (tmp_path / "c").mkdir()
    (tmp_path / "c/k.json").write_text(json.dumps({"domain": "d", "cases": [{"id": "a", "fixture": "f", "expect_fields": ["t"]}, {"id": "b", "kind": "not_found", "expect_verdict": "DEAD_URL"}, {"kind": "odd"}], "not_applicable": [{"url_class": "c", "kind": "pagination", "reason": "one page"}]}))
    cases = corpora.load_cases(spark, str(tmp_path / "c")).orderBy("place").collect()
    assert [(r.case_id, r.kind, r.negative, r.verdict, r.expected, r.error) for r in cases] == [("a", "normal", False, "OK", ["t"], None), ("b", "not_found", True, "DEAD_URL", [], None), ("", "odd", False, "OK", [], "unknown kind odd")]
    assert [tuple(r) for r in corpora.load_excuses(spark, str(tmp_path / "c")).collect()] == [("d", "c", "pagination", "one page", None)]


def test_chain_on_the_tables(spark):
    """Every kind of mutation meets a page that it damages, and each reaction has been judged."""
    judged = page_queries.judge_reactions(spark, "/root/testdata/sf0.001").cache()
    assert judged.count() == 50 * len(page_queries.MUTATIONS) or judged.count() % len(page_queries.MUTATIONS) == 0
    assert judged.where("passed IS NULL").count() == 0 and judged.select("observed").distinct().count() >= 2
    assert registry.queries()["parse_social_pages"](spark, "/root/testdata/sf0.001").count() > 0


def test_pages_are_damaged_and_judged_once(spark):
    """A page that comes twice has two reactions to each mutation, one parse makes all copies, and what has not changed is not read."""
    rules = spark.createDataFrame([(1, "page", "/p/", 1, "", "", "", "")], "position int, url_class string, pattern string, min_body_bytes int, canary string, expected_type string, json_paths string, signatures string")
    docs = spark.createDataFrame([(1, "https://s.test/p/1", PAGE, "HTML"), (1, "https://s.test/p/1", PAGE, "HTML"), (None, "https://s.test/p/2", PAGE, "HTML"), (3, None, None, "UNKNOWN")], "id int, url string, body string, content_kind string")
    each = [("remove_critical_field", "title"), ("rename_css_class", "lead"), ("remove_pagination_cursor", "")]
    seen = mutations.profile_reactions(mutations.mutate_pages(docs, each, "id", "url"), rules, [{"kind": "css", "fields": {"title": ".title", "lead": ".lead"}}], {"title": "critical", "lead": "optional"}, "id", "url")
    found = Counter((r.id, r.kind, r.changed, r.observed) for r in seen.collect())
    assert found == {(1, each[0][0], True, "FAILS"): 2, (1, each[1][0], True, "WARNS"): 2, (1, each[2][0], False, "SURVIVES"): 2, (None, each[0][0], True, "FAILS"): 1, (None, each[1][0], True, "WARNS"): 1, (None, each[2][0], False, "SURVIVES"): 1} | {(3, kind, False, "SURVIVES"): 1 for kind, _ in each}
    for extractors, lost in (([{"kind": "json_ld", "type": "Article", "fields": ["title"]}], {each[0]}), ([{"kind": "css", "fields": {"title": ".title"}}], {each[0], ("rename_css_class", "title")}), ([{"kind": "heuristic"}, {"kind": "meta", "fields": {"title": None}}], {each[0]})):
        some = mutations.mutate_pages(docs.limit(1), [*each, ("rename_css_class", "title")], "id", "url")
        assert {(r.kind, r.target) for r in mutations.profile_reactions(some, rules, extractors, {"title": "critical"}, "id", "url").where("observed <> 'SURVIVES'").collect()} == lost
    mutations._elements.cache_clear()
    for kind, target in (("remove_critical_field", "title"), ("wrap_dom_node", "lead"), ("move_element", "li")):
        assert damaged(kind, target) != PAGE
    assert mutations._elements.cache_info().misses == 1


def test_pages_are_read_once_and_dealt_out(spark):
    judged = page_queries.judge_reactions(spark, "/root/testdata/sf0.01")
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and plan.count("MapInArrow") == 1 and plan.count("REPARTITION_BY_NUM") == 1 and "SortMergeJoin" not in plan
    # a row group goes to one task, the pages in it to all cores
    assert judged.select(F.spark_partition_id().alias("p")).distinct().count() > spark.sparkContext.defaultParallelism
