"""Comment trees into rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.operators.pages import whole_json

GONE = ("[deleted]", "[removed]")


def _text(node: Column, *path: str) -> Column:
    return F.try_variant_get(node, "$" + "".join(f"['{p}']" for p in path), "string")


def _list(node: Column, *path: str) -> Column:
    items = F.try_variant_get(node, "$" + "".join(f"['{p}']" for p in path), "array<variant>")
    return F.coalesce(items, F.array().cast("array<variant>"))


def flatten_threads(docs: DataFrame, column: str, *keys: str, most_depth: int = 8) -> DataFrame:
    """EXT-10: rows of a nested conversation: the post, comments at depth 1, replies below.

    ``column`` holds the platform's JSON: a list of two listings, the post and its forest.
    Returns the keys and kind (POST, COMMENT, REPLY, MORE, UNRESOLVED), id, parent_id,
    depth, author, text and more (how many entities the platform did not send). A node
    deeper than ``most_depth`` is UNRESOLVED, and what lies under it is not read. Nodes
    without an id and broken documents give nothing. Each level is one step for all
    documents.
    """
    parsed = docs.select(*keys, whole_json(F.col(column)).alias("doc"))
    listings = F.coalesce(F.try_variant_get("doc", "$", "array<variant>"), F.array("doc"))
    parsed = parsed.where("doc is not null").withColumn("_l", listings)
    post = F.get(_list(F.get("_l", 0), "data", "children"), 0)
    posts = parsed.withColumn("node", post).withColumn("root", _text(F.col("node"), "data", "id")).where("root is not null")

    def rows(df: DataFrame, kind: Column, depth: int) -> DataFrame:
        node = F.col("node")
        author = _text(node, "data", "author")
        body = F.coalesce(F.nullif(_text(node, "data", "selftext"), F.lit("")), _text(node, "data", "body"), F.lit(""))
        sent = F.size(_list(node, "data", "children"))
        more = F.when(kind == "MORE", F.greatest(F.coalesce(F.nullif(F.try_variant_get(node, "$.data.count", "int"), F.lit(0)), sent), F.lit(1))).otherwise(0)
        own = lambda c, other=None: F.when(kind.isin("MORE", "UNRESOLVED"), other).otherwise(c)
        return df.select(*keys, kind.alias("kind"), _text(node, "data", "id").alias("id"), F.col("parent").alias("parent_id"), F.lit(depth).alias("depth"), own(F.when(~author.isin(*GONE), author)).alias("author"), own(F.when(body.isin(*GONE), "").otherwise(body)).alias("text"), more.cast("int").alias("more"))

    out = rows(posts.withColumn("parent", F.lit(None).cast("string")), F.lit("POST"), 0)
    level = posts.select(*keys, F.col("root").alias("parent"), F.explode(_list(F.get("_l", 1), "data", "children")).alias("node"))
    for depth in range(1, most_depth + 2):
        is_more = F.coalesce(_text(F.col("node"), "kind") == "more", F.lit(False))
        name = "UNRESOLVED" if depth > most_depth else "COMMENT" if depth == 1 else "REPLY"
        has_id = F.coalesce(_text(F.col("node"), "data", "id"), F.lit("")) != ""
        out = out.unionByName(rows(level.where(is_more | has_id), F.when(is_more, "MORE").otherwise(name), depth))
        children = F.explode(_list(F.col("node"), "data", "replies", "data", "children"))
        level = level.where(~is_more & has_id).select(*keys, _text(F.col("node"), "data", "id").alias("parent"), children.alias("node"))
    return out


def completeness(rows: DataFrame, *keys: str) -> DataFrame:
    """AGG-42: per conversation: entities loaded, nodes not sent, branches not resolved, and whether it is whole."""
    out = rows.groupBy(*keys).agg(F.count_if(F.col("kind").isin("POST", "COMMENT", "REPLY")).alias("loaded"), F.sum("more").alias("more_nodes"), F.count_if(F.col("kind") == "UNRESOLVED").alias("unresolved"))
    reason = F.when(F.col("unresolved") > 0, "depth limit").when(F.col("more_nodes") > 0, "nodes not sent")
    return out.withColumn("reason", reason).withColumn("complete", reason.isNull())
