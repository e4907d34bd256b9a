"""Triage, content kinds and pagination row by row, against known answers."""

import pytest
from pyspark.sql import functions as F

from tidemill.operators.base import OPERATORS, SPARK
from tidemill.operators.bodies import content_kind, next_by
from tidemill.plans import registry  # noqa: F401 - registers the operators

RULES = [
    (1, "api", "/api/", 2, "", "json", "rows[*].id;meta.0.n", ""),
    (2, "strict", "/strict/", 20, "<article;price", "html", "", "nothing to see"),
    (3, "plain", "/plain/", 50, "", "", "", ""),
]
FINE = "<html><body><article>all here, price 3</article></body></html>"
SHELL = "<html><head><script src='/a.js'></script><script>" + "x();" * 200 + "</script></head><body><div id='root'></div></body></html>"
#: url, status, content type, mitigated, source, transport, retry after, body; then verdict, signature, reason.
ROWS = [
    ("/plain/", 200, "text/html", None, "target", "timed out", None, None, "ORIGIN_DOWN", None, "transport: timed out"),
    ("/plain/", 200, "text/html", None, "provider", "refused", None, FINE, "PROVIDER_ERROR", None, "transport: refused"),
    ("/plain/", None, None, None, "target", None, None, None, "ORIGIN_DOWN", None, "no status"),
    ("/plain/", 404, "text/html", None, "provider", None, None, "", "PROVIDER_ERROR", None, "HTTP 404"),
    ("/plain/", 502, "text/html", None, "provider", None, None, "", "PROVIDER_ERROR", None, "HTTP 502"),
    ("/plain/", 407, "text/html", None, "target", None, None, "", "PROVIDER_ERROR", None, "HTTP 407"),
    ("/plain/", 304, None, None, "target", None, None, None, "NOT_MODIFIED", None, "HTTP 304"),
    ("/plain/", 410, None, None, "target", None, None, None, "DEAD_URL", None, "HTTP 410"),
    ("/plain/", 402, None, None, "target", None, None, None, "AUTH_REQUIRED", None, "HTTP 402"),
    ("/plain/", 429, None, None, "target", None, "30", None, "RATE_LIMITED", None, "HTTP 429, wait 30"),
    ("/plain/", 403, None, None, "target", None, None, "Verify you are HUMAN", "BLOCKED", "verify you are human", "HTTP 403"),
    ("/plain/", 403, None, None, "target", None, None, "Login required", "ACCESS_DENIED", "login required", "HTTP 403"),
    ("/plain/", 403, None, None, "target", None, None, "no", "BLOCKED", None, "HTTP 403"),
    ("/plain/", 503, None, None, "target", None, None, "cloudflare ray id", "BLOCKED", "cloudflare ray id", "HTTP 503"),
    ("/plain/", 500, None, None, "target", None, None, "oops", "ORIGIN_DOWN", None, "HTTP 500"),
    ("/plain/", 200, "text/html", "challenge", "target", None, None, FINE, "SOFT_BLOCK", "cf-mitigated: challenge", "soft_block"),
    ("/plain/", 200, "text/html", None, "target", None, None, "Permission denied", "ACCESS_DENIED", "permission denied", "access_denied"),
    ("/plain/", 200, "text/html", None, "target", None, None, "<p>short</p>", "THIN_CONTENT", None, "under 50 bytes"),
    ("/plain/", 200, "text/html", None, "target", None, None, FINE, "OK", None, "ok"),
    ("/plain/", 302, "text/html", None, "target", None, None, FINE, "PARSE_FAIL", None, "HTTP 302"),
    ("/none/", 200, "text/html", None, "target", None, None, "x", "OK", None, "ok"),
    ("/strict/", 200, "text/html", None, "target", None, None, FINE, "OK", None, "ok"),
    ("/strict/", 200, "text/plain", None, "target", None, None, FINE, "OK", None, "ok"),  # the body knows better than its label
    ("/strict/", 200, "text/plain", None, "target", None, None, "plain words, nothing else", "PARSE_FAIL", None, "not html"),
    ("/strict/", 200, "text/html", None, "target", None, None, "<html>Nothing to see here, move on please</html>", "SOFT_BLOCK", "nothing to see", "soft_block"),
    ("/strict/", 200, "text/html", None, "target", None, None, "<html><article>no tag of what it costs</article>" + "word " * 100, "PARSE_FAIL", None, "canary missing"),
    ("/strict/", 200, "text/html", None, "target", None, None, "<html><script>'<article price'</script>" + "word " * 100, "PARSE_FAIL", None, "canary missing"),
    ("/strict/", 200, "text/html", None, "target", None, None, SHELL, "CSR_REQUIRED", None, "csr_required"),
    ("/api/", 200, "application/json", None, "target", None, None, '{"rows":[{"id":1}],"meta":[{"n":0}]}', "OK", None, "ok"),
    ("/api/", 200, "text/html", None, "target", None, None, ' {"rows":[{"id":1}],"meta":[{"n":"x"}]}', "OK", None, "ok"),
    ("/api/", 200, "application/json", None, "target", None, None, '{"rows":[],"meta":[{"n":1}]}', "PARSE_FAIL", None, "JSON path missing"),
    ("/api/", 200, "application/json", None, "target", None, None, '{"rows":[{"id":1}],"meta":[]}', "PARSE_FAIL", None, "JSON path missing"),
    ("/api/", 200, "application/json", None, "target", None, None, '{"rows":[{"id":1}],"meta":[{"n":null}]}', "PARSE_FAIL", None, "JSON path missing"),
    ("/api/", 200, "application/json", None, "target", None, None, '{"rows":[{"id":1}],"meta":[{"n":1}]} tail', "PARSE_FAIL", None, "no JSON"),
    ("/api/", 200, "text/html", None, "target", None, None, FINE, "PARSE_FAIL", None, "not json"),
]


def test_every_rung(spark):
    names = "page_id int, url string, status int, content_type string, cf_mitigated string, source string, transport_error string, retry_after string, body string"
    responses = spark.createDataFrame([(k, "https://s.test" + r[0], *r[1:8]) for k, r in enumerate(ROWS)], names)
    rules = spark.createDataFrame(RULES, "position int, url_class string, pattern string, min_body_bytes int, canary string, expected_type string, json_paths string, signatures string")
    found = {r.page_id: (r.verdict, r.signature, r.reason) for r in OPERATORS["triage_responses"](spark, responses=responses, rules=rules).collect()}
    assert found == {k: r[8:] for k, r in enumerate(ROWS)}


@pytest.mark.parametrize(
    ("body", "declared", "kind"),
    [
        (None, "text/html", "UNKNOWN"), ("", "text/html", "UNKNOWN"), ("%PDF-1.7", "text/html", "BINARY"), ("GIF89a..", None, "BINARY"), ("PK\x03\x04zip", "", "BINARY"), ("RIFF....", "", "BINARY"), ("a\0b", "text/plain", "BINARY"),
        ("plain", "image/png", "BINARY"), ("plain", "application/pdf; x=1", "BINARY"), ("  <!DOCTYPE html><p>", "application/json", "HTML"), ("﻿<HTML>", "", "HTML"), ("<!-- c --><p>", "text/plain", "HTML"),
        ('{"a":1}', "text/html", "JSON"), ("[1,2]", None, "JSON"), ('﻿ {"a":1}', "", "JSON"), ('{"a":1} x', "text/html", "HTML"), ('{"a":', "application/json; charset=utf-8", "JSON"), ('{"a":', "", "TEXT"), ("words", "application/json", "TEXT"), ("12", "text/json", "JSON"),
        ("<p>", "text/html", "HTML"), ("<p>", "application/xhtml+xml", "HTML"), ("<p>", "text/css", "TEXT"), ("<p>", None, "TEXT"),
    ],
)
def test_content_kinds(spark, body, declared, kind):
    row = spark.createDataFrame([(body, declared)], "body string, declared string")
    assert row.select(F.expr(content_kind(SPARK, "body", "declared"))).first()[0] == kind


def test_how_listings_go_on(spark):
    cases = [
        ("https://h.test/list", '{"items":[1],"next_cursor":"abc"}', "CURSOR"), ("https://h.test/list", '{"items":[1],"next_cursor":""}', "NONE"), ("https://h.test/list?page=2", '{"next_page": 3}', "CURSOR"), ("https://h.test/a/page/3/", "", "PATH_PAGE"), ("https://h.test/a/page-12.html?x=1", "", "PATH_PAGE"),
        ("https://h.test/p/2", "", "PATH_PAGE"), ("https://h.test/shop/2", "", "NONE"), ("https://h.test/page/two", "", "NONE"), ("https://h.test/a?After=x", "", "CURSOR"), ("https://h.test/a?q=1&start=20", "", "OFFSET"), ("https://h.test/a?P=2", "", "PAGE_NUMBER"), ("https://h.test/a?xpage=2", "", "NONE"),
        ("https://h.test/a", "<link href='/b' rel=\"prev next\">", "NEXT_LINK"), ("https://h.test/a", "<script>new IntersectionObserver(f)</script>", "INFINITE_SCROLL"), ("https://h.test/a", "<script>w.addEventListener( 'scroll', f)</script>", "INFINITE_SCROLL"),
        ("https://h.test/a", "<li class='pager next'><a href=2>", "NEXT_LINK"), ("https://h.test/a", "<a href=2> Next &raquo; </a>", "NEXT_LINK"), ("https://h.test/a", "<p>the next page</p><i class='nextish'>", "NONE"), (None, None, "NONE"),
    ]
    rows = spark.createDataFrame([(k, u, b) for k, (u, b, _) in enumerate(cases)], "k int, url string, body string")
    found = {r.k: r.how for r in rows.selectExpr("k", f"{next_by(SPARK, 'url', 'body')} AS how").collect()}
    assert found == {k: how for k, (_, _, how) in enumerate(cases)}


def test_shells(spark):
    cases = [
        ("<div id='app'>\n</div>", "text/html", True), ("<section class=x id=\"__next\"></section>", "TEXT/HTML", True), ("<div id='app'></div>", "application/json", False), ("<div id='app'>x</div>", "text/html", False), ("<div id='other'></div>", "text/html", False), ("<span id='app'></span>", "text/html", False),
        ("<div id='app'></div>" + "word " * 100, "text/html", False), ("<script src='a'></script><script defer src=b></script>__NUXT__", "text/html", True), ("<script src='a'></script>__NUXT__" + "w" * 90, "text/html", False), ("<p>t</p><script>" + "y" * 600 + "</script>", "text/html", True),
    ]
    rows = spark.createDataFrame([(k, b, t) for k, (b, t, _) in enumerate(cases)], "page_id int, body string, content_type string")
    assert {r.page_id: r.is_csr_shell for r in OPERATORS["flag_csr_shells"](spark, responses=rows).collect()} == {k: x for k, (_, _, x) in enumerate(cases)}
