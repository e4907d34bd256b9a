"""Queries of the operators that are functions: their inputs come from the test tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import mutations, pages, posts, profiles, threads
from tidemill.operators.base import OPERATORS, SPARK
from tidemill.operators.bodies import content_kind
from tidemill.streaming import state

#: The fields of the test pages and how they are looked for, in order of trust.
PROFILE = [
    {"kind": "json", "fields": {"title": "items.0.title"}},
    {"kind": "json_ld", "type": None, "fields": ["title", "published_at"]},
    {"kind": "app_state", "fields": {"title": "props.title"}},
    {"kind": "meta", "fields": {"title": None, "description": None}},
    {"kind": "css", "fields": {"title": "article h1", "lead": "article p", "link": "a::attr(href)"}},
    {"kind": "heuristic"},
]
FIELDS = ["title", "published_at", "description", "lead", "link"]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The addresses that the pages below hint at, and their feed.
HINTS = """<link rel="canonical" href="/c/%s"><link rel="alternate" type="application/rss+xml" href="feed.xml"><script>fetch("/api/v1/items/%s?x=1")</script>"""


def _dealt(df: DataFrame, *keys: str) -> DataFrame:
    """The rows over all cores. A file's row group is read by one task, which is too few where a row costs far more than its read."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *keys)


def _pages(spark, sf_dir, dealt: bool = False) -> DataFrame:
    """Pages as responses, with their kind. A fifth each carries its title as linked data, as meta tags, or as state, and a
    fifth has a feed and an API beside it; every twentieth answers with JSON."""
    title = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
    number = F.col("page_id").cast("string")
    linked = F.concat(F.lit('<script type="application/ld+json">'), F.to_json(F.struct(F.lit("Article").alias("@type"), F.concat(F.lit("LD "), title).alias("headline"), F.lit("2026-01-02T03:04:05Z").alias("datePublished"), F.struct(F.concat(F.lit("Ann "), number).alias("name")).alias("author"))), F.lit("</script>"))
    meta = F.concat(F.lit('<meta property="og:title" content="OG '), number, F.lit('"><meta name="description" content="about '), number, F.lit('">'))
    state = F.concat(F.lit("<script>window.__INITIAL_STATE__ = "), F.to_json(F.struct(F.struct(F.concat(F.lit("State "), number).alias("title")).alias("props"))), F.lit("; start();</script>"))
    hints = F.concat(*[x for k, part in enumerate(HINTS.split("%s")) for x in ([F.lit(part)] if k == 0 else [number, F.lit(part)])])
    kind = F.col("page_id") % 5
    extra = F.when(kind == 0, linked).when(kind == 1, meta).when(kind == 2, state).when(kind == 3, hints).otherwise("")
    body = F.when(F.col("page_id") % 20 == 19, F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("JSON "), number).alias("title"))).alias("items"), F.lit("c1").alias("next")))).otherwise(F.replace("html", F.lit("</title>"), F.concat(F.lit("</title>"), extra)))
    found = _read(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = (_dealt(found, "page_id", "url") if dealt else found).select("page_id", "url", body.alias("body"))
    return found.withColumn("content_kind", F.expr(content_kind(SPARK, "body", "''")))


def extract_json_ld(spark, sf_dir):
    return pages.extract_json_ld(_pages(spark, sf_dir), None, ["title", "author", "published_at", "description"], "page_id")


def extract_css(spark, sf_dir):
    return pages.extract_css(_pages(spark, sf_dir), {"title": "article h1", "lead": "article p", "link": "a::attr(href)"}, "page_id")


def extract_page_fields(spark, sf_dir):
    return pages.page_fields(_pages(spark, sf_dir), PROFILE, "page_id")


def quorum_page_fields(spark, sf_dir):
    return pages.page_quorum(_pages(spark, sf_dir), PROFILE, FIELDS, "page_id")


def normalize_values(spark, sf_dir):
    found = _pages(spark, sf_dir)
    values = pages.extract_css(found, {"title": "h1", "link": "a::attr(href)"}, "page_id", "url")
    return pages.normalize_values(values, {"link": "url"}, "url").select("page_id", "field", "value")


def page_facts(spark, sf_dir):
    return pages.page_facts(_pages(spark, sf_dir), "page_id")


def read_json_values(spark, sf_dir):
    events = _read(spark, sf_dir, "events").select("event_id", F.concat(F.lit('{"data":{"props":['), F.coalesce("props", F.lit("null")), F.lit("]}}")).alias("body"))
    return pages.read_json_values(events, "body", ["data.props.0", "data.props[*].k", "data.props.-1.k", "data.none"], "event_id")


def flatten_threads(spark, sf_dir):
    return threads.flatten_threads(_threads(spark, sf_dir), "doc", "conv_id")


def thread_rows_complete(spark, sf_dir):
    return threads.completeness(flatten_threads(spark, sf_dir), "conv_id")


def _threads(spark, sf_dir) -> DataFrame:
    """Each conversation as a platform sends it: the first turn is the post, every other turn a reply to the one before."""
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text")), asc=False)
    data = lambda x: F.concat(F.lit('"data":{"id":"'), x["turn"].cast("string"), F.lit('","author":'), F.to_json(F.array(x["role"])).substr(F.lit(2), F.length(F.to_json(F.array(x["role"]))) - 2), F.lit(',"body":'), F.to_json(F.array(F.coalesce(x["text"], F.lit("")))).substr(F.lit(2), F.length(F.to_json(F.array(F.coalesce(x["text"], F.lit(""))))) - 2))
    node = lambda acc, x: F.concat(F.lit('{"kind":"t1",'), data(x), F.lit(',"replies":'), F.when(acc == "", F.lit('""')).otherwise(F.concat(F.lit('{"data":{"children":['), acc, F.lit("]}}"))), F.lit("}}"))
    grouped = _read(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("turns"))
    replies = F.aggregate(F.slice("turns", F.lit(1), F.size("turns") - 1), F.lit(""), node)
    doc = F.concat(F.lit('[{"data":{"children":[{"kind":"t3",'), data(F.element_at("turns", -1)), F.lit('}}]}},{"data":{"children":['), replies, F.lit("]}}]"))
    return grouped.select("conv_id", doc.alias("doc"))


def provider_breakers(spark, sf_dir):
    return state.replay(_outcomes(spark, sf_dir), state.Breakers())


def _outcomes(spark, sf_dir) -> DataFrame:
    events = _read(spark, sf_dir, "events")
    kind = F.when(F.col("event_id") % 97 == 0, "QUOTA").when(F.col("event_id") % 991 == 0, "AUTH").when(F.col("event_type") == "error", "TIMEOUT")
    verdict = F.when(F.col("event_type") == "signup", "DEAD_URL").when(F.col("value") < 20, "BLOCKED").otherwise("OK")
    provider = F.concat(F.lit("vendor"), (F.col("user_id") % 50).cast("string"))
    return events.select(provider.alias("provider"), "event_id", F.concat(F.lit("s"), (F.col("event_id") % 3).cast("string")).alias("strategy"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), kind.alias("error_kind"), verdict.alias("verdict"))


def freshness_replay(spark, sf_dir):
    events = _read(spark, sf_dir, "events")
    body = F.concat(F.lit("v"), F.floor(F.col("value") / 40).cast("string"))
    unchanged = (F.col("event_type") == "signup") & (F.col("event_id") % 2 == 0)
    log = events.select(F.concat(F.lit("https://site.example/item/"), F.col("user_id").cast("string")).alias("url"), "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), unchanged.alias("not_modified"), F.when(~unchanged, F.sha2(body, 256)).alias("content_hash"))
    return state.replay(log, state.Freshness())


def score_fragility(spark, sf_dir):
    """The selectors that name the elements of the test pages: their classes, and their places below their parents."""
    pair = F.regexp_extract_all("html", F.lit(r"""(?i)<([a-z0-9]+)[^<>]*\bclass=["']([^"'<>]+)"""), F.lit(1))
    marks = F.regexp_extract_all("html", F.lit(r"""(?i)<([a-z0-9]+)[^<>]*\bclass=["']([^"'<>]+)"""), F.lit(2))
    classed = F.transform(F.arrays_zip(pair.alias("t"), marks.alias("m")), lambda x: F.concat(F.lower(x["t"]), F.lit("."), F.regexp_replace(F.trim(x["m"]), r"\s+", ".")))
    inside = F.regexp_extract_all("html", F.lit(r"(?i)<([a-z0-9]+)[^<>]*>\s*<[a-z0-9]+"), F.lit(1))
    child = F.regexp_extract_all("html", F.lit(r"(?i)<[a-z0-9]+[^<>]*>\s*<([a-z0-9]+)"), F.lit(1))
    nested = F.transform(F.arrays_zip(inside.alias("p"), child.alias("c")), lambda x: F.concat(F.lower(x["p"]), F.lit(" > "), F.lower(x["c"])))
    locators = _read(spark, sf_dir, "pages").select(F.explode(F.concat(classed, nested)).alias("locator")).distinct()
    return profiles.score_fragility(locators.select(F.lit("css").alias("kind"), "locator", F.lit("critical").alias("importance")))


def prune_snapshots(spark, sf_dir):
    """The pages as a store of each language, a snapshot an hour, within a day and a budget."""
    shots = _read(spark, sf_dir, "pages").select(F.regexp_extract("url", "//[^/]*/([a-z]*)", 1).alias("store"), F.col("url").alias("path"), (F.col("page_id") * 3600.0).alias("saved_at"), F.coalesce(F.octet_length("html"), F.lit(0)).cast("long").alias("bytes"))
    newest = shots.agg(F.max("saved_at")).scalar()
    return profiles.prune_snapshots(shots, newest, most_days=7, most_bytes=100_000)


def _responses(spark, sf_dir) -> DataFrame:
    from tidemill.plans.registry import _table

    return _table(spark, sf_dir, "responses", {})


def _rules(spark, sf_dir) -> DataFrame:
    from tidemill.plans.registry import _table

    return _table(spark, sf_dir, "rules", {})


def run_acceptance_cases(spark, sf_dir):
    """Every saved response is a fixture that has to be fine, to give a title and to give no price."""
    fixtures = _responses(spark, sf_dir).withColumnRenamed("page_id", "fixture")
    cases = fixtures.select(F.col("fixture").alias("case_id"), "fixture", F.lit("OK").alias("verdict"), F.array(F.lit("title")).alias("expected"), F.array(F.lit("price")).alias("forbidden"))
    return profiles.acceptance(cases, fixtures, _rules(spark, sf_dir), PROFILE)


IMPORTANCE = {"title": "critical", "lead": "optional"}
MUTATIONS = [*mutations.default_mutations(IMPORTANCE, ["lead"], True, False), ("rename_json_key", "title"), ("change_field_type", "items"), ("empty_collection", "")]


def mutate_pages(spark, sf_dir):
    damaged = mutations.mutate_pages(_pages(spark, sf_dir), MUTATIONS, "page_id")
    return damaged.select("page_id", "mutation", "kind", "target", "changed", F.sha2("body", 256).alias("body_sha256"))


def judge_reactions(spark, sf_dir):
    """EXT-11, PRJ-12, EXT-07 and AGG-39 as one chain: every page is damaged, and the profile's reaction judged."""
    found = _pages(spark, sf_dir, dealt=True)
    damaged = mutations.mutate_pages(found, MUTATIONS, "page_id", "url")
    observed = mutations.profile_reactions(damaged, _rules(spark, sf_dir), PROFILE, IMPORTANCE, "page_id", "url")
    site = F.regexp_extract("url", "//([^/]*)", 1)
    return OPERATORS["judge_mutations"](spark, mutation_runs=observed.select(site.alias("domain"), "kind", "target", "observed"))


def evaluate_pages(spark, sf_dir):
    """A user's function over every page; it fails on pages that are no markup."""

    def longest_heading(page: dict) -> dict:
        heads = re.findall(r"<h[1-3][^>]*>(.*?)</h[1-3]>", page["body"], re.S)
        return {"headings": len(heads), "longest": max(map(len, heads))}

    return mutations.evaluate_pages(_pages(spark, sf_dir), longest_heading, "headings long, longest long", "page_id")


def _social_pages(spark, sf_dir) -> DataFrame:
    """A page for each conversation: its turns as data inside the page, or, for odd ones, only as links, some of them twice."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    post = lambda x: F.concat(F.lit('{"rest_id":"'), F.col("conv_id").cast("string"), F.lpad(x["turn"].cast("string"), 4, "0"), F.lit('","core":{"user":{"rest_id":"7","name":"u"}},"legacy":'), F.to_json(F.struct(F.concat(F.coalesce(x["text"], F.lit("")), F.lit(" https://a.example/"), x["turn"].cast("string"), F.lit(" https://x.com/b")).alias("full_text"))), F.lit("}"))
    link = lambda x: F.concat(F.lit('<a href="/'), x["role"], F.lit("/status/"), F.col("conv_id").cast("string"), F.lpad((x["turn"] - x["turn"] % 2).cast("string"), 4, "0"), F.lit('">more</a>'))
    inside = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("<script>var data = ["), F.array_join(F.transform("turns", post), ","), F.lit("];</script>"))).otherwise(F.array_join(F.transform("turns", link), " "))
    grouped = _read(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("turns"))
    return grouped.select("conv_id", F.concat(F.lit("<html><body>"), inside, F.lit("</body></html>")).alias("body"))


def parse_social_pages(spark, sf_dir):
    found = posts.parse_social_pages(_social_pages(spark, sf_dir), "conv_id")
    return found.select("conv_id", "place", "post_id", "natural_key", "author_name", "text", F.array_join("links", " ").alias("links"), "origin")


ORACLE_SQL = {
    "parse_social_pages": """
WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place FROM conversations),
l AS (SELECT conv_id, conv_id::VARCHAR || lpad((turn - turn % 2)::VARCHAR, 4, '0') AS post_id, min(turn) AS turn FROM t WHERE conv_id % 2 = 1 GROUP BY 1, 2)
SELECT conv_id, place::INTEGER AS place, conv_id::VARCHAR || lpad(turn::VARCHAR, 4, '0') AS post_id, 'x:' || conv_id || lpad(turn::VARCHAR, 4, '0') AS natural_key, NULL::VARCHAR AS author_name,
  coalesce(text, '') || ' https://a.example/' || turn || ' https://x.com/b' AS text, 'https://a.example/' || turn AS links, 'data' AS origin FROM t WHERE conv_id % 2 = 0
UNION ALL SELECT l.conv_id, (row_number() OVER (PARTITION BY l.conv_id ORDER BY l.turn) - 1)::INTEGER, l.post_id, 'x:' || l.post_id, t.role, '', '', 'link' FROM l JOIN t ON l.conv_id = t.conv_id AND l.turn = t.turn
""",
}

QUERIES = {f.__name__: f for f in (extract_json_ld, extract_css, extract_page_fields, quorum_page_fields, normalize_values, page_facts, read_json_values, flatten_threads, thread_rows_complete, provider_breakers, freshness_replay, score_fragility, prune_snapshots, run_acceptance_cases, mutate_pages, judge_reactions, evaluate_pages, parse_social_pages)}
