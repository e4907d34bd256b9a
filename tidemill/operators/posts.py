"""EXT-09: posts out of the pages of a social network."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

POST = T.StructType([T.StructField("post_id", T.StringType()), T.StructField("text", T.StringType())])
#: How a post starts in a page's data, where its text is, and how a page links to it.
OPENING, TEXT = re.compile(r'\{\s*"rest_id"\s*:\s*"[0-9]+"'), "full_text"
STATUS = r"/([^/\s\"'<>]+)/status/([0-9]+)"
OUTSIDE = r"https?://(?!x\.com|twitter\.com)[^\s\"'<>]+"


def _nearest_text(post: dict) -> str | None:
    """The text of a post itself: the one with the fewest levels above it that lies in no other post."""
    level = [post]
    while level:
        below = []
        for node in level:
            if isinstance(node, dict):
                if isinstance(node.get(TEXT), str):
                    return node[TEXT]
                below += [v for v in node.values() if not (isinstance(v, dict) and "rest_id" in v)]
            elif isinstance(node, list):
                below += node
        level = below
    return None


@F.pandas_udf(T.ArrayType(POST))
def embedded_posts(bodies: pd.Series) -> pd.Series:
    """Posts in a page's data, in order: each starts at its opening and ends where its brace closes."""
    decoder = json.JSONDecoder()

    def of(body):
        found = []
        for m in OPENING.finditer(body or ""):
            try:
                post, _ = decoder.raw_decode(body, m.start())
            except (ValueError, RecursionError):
                continue
            text = _nearest_text(post)
            if text is not None:
                found.append({"post_id": post["rest_id"], "text": text})
        return found

    return bodies.map(of)


def parse_social_pages(df: DataFrame, *keys: str) -> DataFrame:
    """``(keys, place, post_id, natural_key, author_name, text, links, origin)`` of the posts on each page (``body``).

    The data inside a page comes first. Only a page without any falls back to its links to
    posts, each post once, which give an author and no text. ``links`` are the addresses in
    the text that lead elsewhere. Null bodies and pages without posts have no rows.
    """
    link = F.arrays_zip(F.regexp_extract_all("body", F.lit(STATUS), F.lit(1)).alias("author"), F.regexp_extract_all("body", F.lit(STATUS), F.lit(2)).alias("post_id"))
    read = df.select(*keys, embedded_posts("body").alias("_data"), link.alias("_links"))
    ids = F.transform("_links", lambda x: x["post_id"])
    once = F.filter("_links", lambda x, i: F.array_position(ids, x["post_id"]) == i + 1)
    data = F.transform("_data", lambda x: F.struct(x["post_id"].alias("post_id"), F.lit(None).cast("string").alias("author_name"), x["text"].alias("text"), F.lit("data").alias("origin")))
    linked = F.transform(once, lambda x: F.struct(x["post_id"].alias("post_id"), x["author"].alias("author_name"), F.lit("").alias("text"), F.lit("link").alias("origin")))
    rows = read.select(*keys, F.posexplode(F.when(F.size("_data") > 0, data).otherwise(linked)).alias("place", "p"))
    return rows.select(*keys, "place", "p.post_id", F.concat(F.lit("x:"), "p.post_id").alias("natural_key"), "p.author_name", "p.text", F.regexp_extract_all("p.text", F.lit(OUTSIDE), F.lit(0)).alias("links"), "p.origin")
