"""Extraction from whole pages against known answers."""

import pytest
from pyspark.sql import functions as F

from tidemill.operators import pages

PAGE = """<html><head><title>Plain &amp; title</title><link rel="canonical" href="/a/1"><link rel=alternate type="application/rss+xml" href="feed.xml">
<meta property="og:title" content="OG title"><meta name="description" content="first"><meta name="description" content="second"><meta content='img.png' property='twitter:image'>
<script type="application/ld+json">[{"@type":"WebPage","name":"no"},{"@graph":[{"@type":["Thing","Article"],"headline":"LD title","author":{"name":"Ann"},"image":["i1","i2"],"offers":{"price":12.5}}]}]</script>
<script type="application/ld+json">{broken</script><script id="__NEXT_DATA__" type="application/json">{"props":{"items":[{"t":"state title"},{"t":"other"}]}}</script></head>
<body><div class="card big" id="x"><p class="lead">Hello <b>bold</b><script>skip()</script> world<ul><li>one<li>two</ul></div><a class="more" href="/next?p=2">next</a><h1> Head  line </h1>
<script>fetch("/api/v1/items?page=2"); fetch("https://api.other.org/api/x"); fetch('https://data.site.org/api/y#f')</script></body></html>"""


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "https://www.site.org/a/1?x=1", PAGE, "HTML"), (2, "https://site.org/j", '{"a":{"b":[1,null,{"c":"z"}]},"n":null,"e":[],"0":"zero"}', "JSON"), (3, "u", "\x00bin <h1>x</h1>", "BINARY"), (4, "u", None, "UNKNOWN"), (5, "u", "<h1>", "HTML")]
    return spark.createDataFrame(rows, "id long, url string, body string, content_kind string")


def test_json_paths(docs):
    paths = ["a.b.0", "a.b.-1.c", "a.b[*]", "a.b[*].c", "n", "e", "missing.x", "0", "e[*]", "a.b.7"]
    found = {r.path: (r.value, r.present) for r in pages.read_json_values(docs.where("id = 2"), "body", paths, "id").collect()}
    assert found == {"a.b.0": ("1", True), "a.b.-1.c": ('"z"', True), "a.b[*]": ('[1,null,{"c":"z"}]', True), "a.b[*].c": ('[null,null,"z"]', True), "n": ("null", False), "e": ("[]", False), "missing.x": (None, False), "0": ('"zero"', True), "e[*]": ("[]", False), "a.b.7": (None, False)}
    assert not any(r.present for r in pages.read_json_values(docs.where("id in (4, 5)"), "body", paths, "id").collect())
    for bad in ("", "a..b", "a[0]", "a[*].b[*].c[*]", "a[*][*]"):
        with pytest.raises(ValueError):
            pages.check_path(bad)


def test_broken_json_is_no_json(spark):
    """What follows the first value counts: such a text is no JSON, for paths as for linked data."""
    texts = ['{"a":1}', ' {"a":1}\n', '{"a":1}{"a":2} junk', '{"a":1} junk', "12 apples", "12", "[1,2]", "1,2", "1] [2", "1} {2", '"x","v":3', "", None, "nul", "null", '{"a":}', '{"a":1},{"a":2}', "<p>{}</p>"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, body string")
    good = {r.id for r in rows.where(pages.whole_json(F.col("body")).isNotNull()).collect()}
    assert good == {0, 1, 5, 6, 14}
    assert {r.id for r in pages.read_json_values(rows, "body", ["a"], "id").where("present").collect()} == {0, 1}
    ld = "<script type='application/ld+json'>{\"name\":\"t\"}%s</script>"
    docs = spark.createDataFrame([(1, ld % ""), (2, ld % " {}"), (3, ld % ";")], "id int, body string")
    assert [r.id for r in pages.extract_json_ld(docs, None, ["title"], "id").collect()] == [1]


def test_state_ends_at_its_brace(spark):
    codes = ['window.__INITIAL_STATE__ = {"a":{"b":"}; x"}}; var z = {"a": {"b": 2}};', "__NUXT__={\"a\":{\"b\":1}}", "__APOLLO_STATE__ = {broken}", "window.__PRELOADED_STATE__=[1]"]
    docs = spark.createDataFrame([(k, f"<script>{c}</script>") for k, c in enumerate(codes)], "id int, body string")
    assert {(r.id, r.value) for r in pages.extract_state_fields(docs, {"f": "a.b"}, "id").collect()} == {(0, "}; x"), (1, "1")}


def test_dates_and_numbers(spark):
    dates = {"2026-01-02": "2026-01-02T00:00:00+00:00", "2026-01-02T03:04:05.250-01:30": "2026-01-02T04:34:05.250000+00:00", "2 Jan 2026 03:04:05 +0100": "2026-01-02T02:04:05+00:00", "Fri, 02 Jan 2026 03:04:05 GMT": "2026-01-02T03:04:05+00:00", "2026-01-02 03:04": "2026-01-02T03:04:00+00:00", "7 apples": "7 apples", "": ""}
    numbers = {"1,234.5 kg": "1234.5", "1.234,5": "1234.5", "12,5": "12.5", "-3": "-3.0", "1,2,3": None, "none": None, "$1,000": None}
    df = spark.createDataFrame([("d", k) for k in dates] + [("n", k) for k in numbers], "field string, value string").coalesce(1)
    found = [r.value for r in pages.normalize_values(df, {"n": "number", "d": "date"}).collect()]
    assert found == [*dates.values(), *[("1.0" if k == "$1,000" else v) for k, v in numbers.items()]]


def test_wildcards_stop_at_the_limit(spark):
    many = spark.createDataFrame([(1, "[" + ",".join(map(str, range(1200))) + "]")], "id long, body string")
    assert pages.read_json_values(many, "body", ["[*]"], "id").first().value.count(",") == 999


def test_linked_data_meta_state_and_selectors(docs):
    one = docs.where("id = 1")
    as_dict = lambda df: {r.field: r.value for r in df.collect()}
    assert as_dict(pages.extract_json_ld(one, "Article", ["title", "author", "image", "price", "published_at"], "id")) == {"title": "LD title", "author": "Ann", "image": "i1", "price": "12.5"}
    assert as_dict(pages.extract_json_ld(one, None, ["title"], "id")) == {"title": "no"}
    assert pages.extract_json_ld(one, "Recipe", ["title"], "id").count() == 0
    assert as_dict(pages.extract_meta_fields(one, pages.META_NAMES, "id")) == {"title": "OG title", "description": "first", "image": "img.png"}
    assert as_dict(pages.extract_state_fields(one, {"title": "props.items.0.t", "none": "props.x"}, "id")) == {"title": "state title"}
    css = {"lead": "div.card .lead::text", "second": "ul li::text", "link": "a.more::attr(href)", "none": "div#y", "deep": "#x.big b", "cls": "div::attr(class)"}
    assert as_dict(pages.extract_css(one, css, "id")) == {"lead": "Hello worldboldonetwo", "second": "onetwo", "link": "/next?p=2", "deep": "bold", "cls": "card big"}
    for bad in ("", "a > b", "a::html", "::text"):
        with pytest.raises(ValueError):
            pages.Selector(bad)


def test_all_extractors_in_order(docs):
    profile = [{"kind": "json", "fields": {"title": "a.b.2.c"}}, {"kind": "json_ld", "type": "Article", "fields": ["title", "author"]}, {"kind": "meta", "fields": {"title": None, "description": "description"}}, {"kind": "css", "fields": {"title": "h1", "author": "b"}}, {"kind": "heuristic"}]
    values = pages.extractor_values(docs, profile, "id").cache()
    assert sorted(tuple(r) for r in pages.first_values(values, "id").collect()) == [(1, "author", "Ann", "json_ld"), (1, "description", "first", "meta"), (1, "title", "LD title", "json_ld"), (2, "title", "z", "json_path")]
    assert sorted(tuple(r) for r in pages.page_fields(docs, profile, "id").collect()) == sorted(tuple(r) for r in pages.first_values(values, "id").collect())
    agreed = {(r.id, r.field): (r.agreement, r.sources) for r in pages.page_quorum(docs, profile, ["title", "author", "description", "price"], "id").collect()}
    assert docs.sparkSession is not None and pages.page_quorum(docs, profile, ["title"], "id")._jdf.queryExecution().executedPlan().toString().count("Exchange") == 0
    assert agreed[1, "title"] == ("conflict", 4) and agreed[1, "author"] == ("conflict", 2) and agreed[1, "description"] == ("medium", 1) and agreed[1, "price"] == ("missing", 0) and agreed[3, "title"] == ("missing", 0)


def test_values_by_kind(spark):
    rows = [("t", " a&nbsp;&amp; ​b\n c "), ("n", "1.234,50 EUR"), ("u", " ../x?q=1 "), ("d", "Wed, 12 Aug 2026 09:30:00 GMT"), ("d", "2026-08-12T11:30:00+02:00"), ("d", "2026-08-12T09:30:00Z"), ("d", "soon"), ("r", " raw "), ("t", None)]
    df = spark.createDataFrame([(f, v, "https://h.org/a/b") for f, v in rows], "field string, value string, page string").coalesce(1)
    found = [r.value for r in pages.normalize_values(df, {"n": "number", "u": "url", "d": "date", "r": "raw"}, "page").collect()]
    moment = "2026-08-12T09:30:00+00:00"
    assert found == ["a & b c", "1234.5", "https://h.org/x?q=1", moment, moment, moment, "soon", " raw ", None]


def test_facts(docs):
    one = pages.page_facts(docs, "id").where("id = 1").first()
    assert (one.canonical, one.feeds, one.amp) == ("https://www.site.org/a/1", ["https://www.site.org/a/feed.xml"], None)
    assert (one.types, one.open_graph, one.state) == (["Article", "Thing", "WebPage"], ["og:title"], ["NEXT_DATA"])
    assert one.api_hints == ["https://data.site.org/api/y", "https://www.site.org/api/v1/items"]
    assert pages.page_facts(docs, "id").count() == 5
