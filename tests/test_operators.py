"""Every operator against its oracle on the smallest tables, and the fixed verdict cases."""

import math
import os

import duckdb
import pandas as pd
import pytest

from tidemill.operators.base import OPERATORS
from tidemill.plans import registry

SF = "/root/testdata/sf0.001"


def plain(v):
    if v is None or v is pd.NaT:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "isoformat"):
        return str(pd.Timestamp(v).tz_localize(None))
    return v.item() if hasattr(v, "item") else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS FROM '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_matches_oracle(spark, duck, name):
    mine = registry.queries()[name](spark, SF)
    columns = sorted(mine.columns)
    theirs = duck.sql(registry.oracle_sql()[name])
    assert sorted(theirs.columns) == columns
    a = sorted((tuple(plain(r[c]) for c in columns) for r in mine.collect()), key=repr)
    b = sorted((tuple(plain(dict(zip(theirs.columns, r, strict=True))[c]) for c in columns) for r in theirs.fetchall()), key=repr)
    assert a == b


PAGE = "<html><head><title>t</title></head><body><article>" + "<p>word word word word</p>" * 40 + "</article></body></html>"
CASES = [
    ("success", 200, "text/html", None, PAGE, "OK"),
    ("redesigned", 200, "text/html", None, PAGE.replace("article", "section"), "PARSE_FAIL"),
    ("csr", 200, "text/html", None, '<html><body><div id="root"></div><script>' + "x();" * 60 + "</script></body></html>", "CSR_REQUIRED"),
    ("soft", 200, "text/html", None, PAGE + "Verify you are human", "SOFT_BLOCK"),
    ("blocked", 403, "text/html", "challenge", "x", "BLOCKED"),
    ("dead", 404, "text/html", None, "x", "DEAD_URL"),
    ("limited", 429, "text/html", None, "x", "RATE_LIMITED"),
    ("down", 503, "text/html", None, "x", "ORIGIN_DOWN"),
    ("null", None, "text/html", None, None, "ORIGIN_DOWN"),
]


def test_verdicts(spark):
    rows = [(k, f"https://x.test/en/{name}", status, kind, cf, body) for k, (name, status, kind, cf, body, _) in enumerate(CASES)]
    responses = spark.createDataFrame(rows, "page_id long, url string, status int, content_type string, cf_mitigated string, body string").selectExpr("*", "'target' AS source", "CAST(NULL AS STRING) AS transport_error", "CAST(NULL AS STRING) AS retry_after")
    known = {"responses": responses}
    found = {r.page_id: r.verdict for r in registry._table(spark, SF, "triage_responses", known).collect()}
    assert [found[k] for k in range(len(CASES))] == [c[-1] for c in CASES]


def test_known_values(spark):
    from tidemill.operators.dims import wilson

    row = spark.sql(f"SELECT {wilson('3', '3')} AS a, {wilson('4', '4')} AS b, {wilson('15', '15')} AS c, {wilson('16', '16')} AS d, {wilson('0', '0')} AS e").first()
    assert [round(x, 4) for x in row] == [0.4385, 0.5101, 0.7961, 0.8064, 0.0]


def test_canonical_url(spark):
    url = "HTTP://User@Example.com:80/a?utm_source=x&b=2&a=1#frag"
    responses = spark.createDataFrame([(1, url), (2, "https://x.test")], "page_id long, url string")
    found = {r.page_id: r.canonical_url for r in OPERATORS["canonicalize_urls"](spark, responses=responses).collect()}
    assert found == {1: "http://example.com/a?a=1&b=2", 2: "https://x.test/"}
