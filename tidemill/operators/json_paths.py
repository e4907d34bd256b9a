"""Leaf paths of JSON documents, and what follows from them. Arrow batches; every row is read whole."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.operators.pages import whole_json

DEPTH, ITEMS = 8, 3


def leaves(value, path: str = "", depth: int = 0) -> Iterator[str]:
    """Paths of a document's leaves: ``[]`` for a list, of which the first items count."""
    if depth < DEPTH and isinstance(value, dict) and value:
        for key, inner in value.items():
            yield from leaves(inner, f"{path}.{key}" if path else str(key), depth + 1)
    elif depth < DEPTH and isinstance(value, list) and value:
        for inner in value[:ITEMS]:
            yield from leaves(inner, f"{path}[]", depth + 1)
    elif path:
        yield path


class LeafPaths:
    """UDTF-01: one row for each distinct leaf path of a JSON text; null or broken JSON has none."""

    def eval(self, text: str):
        try:
            found = sorted(set(leaves(json.loads(text))))
        except (TypeError, ValueError, RecursionError):
            return
        for path in found:
            yield (path,)


def json_leaf_paths(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """PRJ-20: ``(keys, path)`` for each leaf of ``column``; null or broken JSON has none."""
    leaf_paths = F.udtf(LeafPaths, returnType="path string", useArrow=True)
    return df.select(*keys, column).lateralJoin(leaf_paths(F.col(column).outer())).select(*keys, "path")


def schema_signatures(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """PRJ-21: the type tree of each document; of lists, the schema of all items."""
    return df.select(*keys, F.schema_of_variant(whole_json(F.col(column))).alias("signature"))


def locate_fields(paths: DataFrame, wanted: DataFrame) -> DataFrame:
    """PRJ-22: paths whose last name, without case or marks, is a wanted ``field``; how many rows have it."""
    plain = lambda c: F.lower(F.regexp_replace(c, "[^A-Za-z0-9]", ""))
    last = plain(F.element_at(F.split("path", r"\."), -1))
    named = wanted.select("field", plain("field").alias("leaf")).distinct()
    return paths.groupBy("path").agg(F.count("*").alias("n")).withColumn("leaf", last).join(named, "leaf").select("field", "path", "n")


def lost_json_paths(baseline: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """JOIN-08: ``(key, path)`` of the baseline that are gone, and the shortest current path with the same leaf."""
    leaf = F.element_at(F.split("path", r"\."), -1)
    both = baseline.join(current.select(key).distinct(), key, "left_semi")
    lost = both.join(current, [key, "path"], "left_anti").withColumn("leaf", leaf)
    hints = current.withColumn("leaf", leaf).groupBy(key, "leaf").agg(F.min_by("path", F.struct(F.length("path"), F.col("path"))).alias("hint"))
    return lost.join(hints, [key, "leaf"], "left").select(key, "path", "hint")
