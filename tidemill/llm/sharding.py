"""Sharding by sampled splitters.

A size-weighted sample of the record keys gives quantile boundaries; every record is
dealt to the range between two boundaries; ranges that turn out overfull are split
again by a sample of their own rows. Exact byte counts of the ranges then place the
shard boundaries, so that shards differ by about one record in bytes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import checkpointed, locate, utf8_size

KEY = ("_k", "_d", "_t")


def _sample(light: DataFrame, total: int, wanted: int, seed: int) -> pd.DataFrame:
    """About ``wanted`` rows, each kept with a chance in proportion to its size.

    A row of at least total / wanted bytes is always kept, with its whole size as its
    weight; there are at most ``wanted`` of those, so the sample is bounded.
    """
    step = total / wanted
    draw = F.pmod(F.xxhash64(F.lit(seed), *KEY), F.lit(1 << 30)) / F.lit(float(1 << 30))
    kept = light.where(draw < F.col("size") / F.lit(step))
    return kept.select(*KEY, F.greatest(F.col("size").cast("double"), F.lit(step)).alias("w")).toPandas()


def _cuts(sample: pd.DataFrame, parts: int) -> pd.DataFrame:
    """Keys at the weighted quantiles 1/parts, 2/parts, ..."""
    s = sample.sort_values(list(KEY), kind="stable")
    mass = s.w.cumsum().to_numpy()
    if not len(s):
        return s[list(KEY)]
    at = np.searchsorted(mass, mass[-1] * np.arange(1, parts) / parts)
    return s.iloc[np.unique(np.minimum(at, len(s) - 1))][list(KEY)]


def _in_ranges(light: DataFrame, cuts: pd.DataFrame) -> DataFrame:
    splitters = [cuts[c].to_numpy(np.int64) for c in KEY]

    @F.pandas_udf("int")
    def range_of(k: pd.Series, d: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series(locate([k.to_numpy(np.int64), d.to_numpy(np.int64), t.to_numpy(np.int64)], splitters).astype(np.int32))

    return light.withColumn("_r", range_of(*KEY) if len(cuts) else F.lit(0))


def shard_by_bytes(docs: DataFrame, shards: int = 8, ranges: int = 256, sample_per_range: int = 40, overfull: float = 1.5, rounds: int = 6, seed: int = 17) -> DataFrame:
    """Deal ``docs`` (doc_id, text) into ``shards`` shards of nearly equal bytes.

    Returns doc_id, size (UTF-8 bytes + 1; a null text has 1), text_crc32 (null for a
    null text), law, shard, slot (gapless from 0 in each shard), grown_shard (null).
    Rows are ordered by (hash of the text, doc_id, row): equal texts are neighbours and
    are split only where a boundary falls into their group. Repeated rows and null ids
    each get a slot of their own; an empty table gives an empty result; other columns
    of ``docs`` are not read. ``ranges`` should grow with the executors; what the
    driver holds is ``ranges * sample_per_range`` keys.
    """
    light = checkpointed(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), (utf8_size() + 1).alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
            F.xxhash64("text").alias("_k"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("_d"), F.monotonically_increasing_id().alias("_t"),
        )
    )
    total = light.agg(F.sum("size")).first()[0] or 0
    if not total:
        return light.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    cuts = _cuts(_sample(light, total, ranges * sample_per_range, seed), ranges)
    for turn in range(rounds):
        dealt = _in_ranges(light, cuts)
        sizes = dealt.groupBy("_r").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.max("size").alias("most")).toPandas().sort_values("_r")
        # a range that one record fills can't be split further
        over = sizes[(sizes.b > overfull * total / ranges) & (sizes.b - sizes.most > overfull * total / ranges / 2)]
        if over.empty or turn == rounds - 1:
            break
        again = _sample(dealt.where(F.col("_r").isin(over._r.tolist())), int(over.b.sum()), max(1, len(over)) * 4 * sample_per_range, seed + turn + 1)
        again["_r"] = locate([again[c].to_numpy(np.int64) for c in KEY], [cuts[c].to_numpy(np.int64) for c in KEY]) if len(cuts) else 0
        more = [_cuts(part, int(np.ceil(2 * over.b[over._r == r].iloc[0] * ranges / total))) for r, part in again.groupby("_r")]
        cuts = pd.concat([cuts, *more]).drop_duplicates().sort_values(list(KEY))
    sizes["before"] = sizes.b.cumsum() - sizes.b
    sizes["rows_before"] = sizes.n.cumsum() - sizes.n

    # the ranges are bounded in number, so these expressions are too
    spark = docs.sparkSession
    table = F.broadcast(spark.createDataFrame(sizes[["_r", "before", "rows_before"]].astype("int64"), "_r long, before long, rows_before long"))
    by_key = Window.partitionBy("_r").orderBy(*KEY)
    placed = (
        dealt.withColumn("_cum", F.sum("size").over(by_key.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_n", F.row_number().over(by_key))
        .join(table, "_r")
        # a record belongs to the shard in which its middle byte falls
        .withColumn("shard", F.least(F.lit(shards - 1), F.floor((F.col("before") + F.col("_cum") - F.col("size") / 2) * F.lit(shards) / F.lit(total))).cast("int"))
        .withColumn("_row", F.col("rows_before") + F.col("_n") - 1)
        .select("doc_id", "size", "text_crc32", "shard", "_row")
    )
    placed = checkpointed(placed)
    firsts = F.broadcast(placed.groupBy("shard").agg(F.min("_row").alias("_first")))
    return placed.join(firsts, "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_row") - F.col("_first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
