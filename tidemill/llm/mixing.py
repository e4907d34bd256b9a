"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

The documents of a source are dealt into blocks by a hash; a permutation of the blocks,
repeated as often as the target asks, gives the source's exact quota of blocks: those of
its full rounds, and those of the last round that hold what is left of the target. The
quotas of all sources are split over the output shards by a binary tree: each node
draws, without replacement, which of its blocks go left (a multivariate hypergeometric
draw), so every shard is a fair sample of the mix. Each shard then takes its own run of
the permuted blocks, disjoint from all others, and shuffles its documents locally. What
a document counts in the mix is the sum over its draws.

The driver holds one row per source (names, sums, quotas); blocks and documents stay in
Spark, and the main path is made of DataFrame functions only.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import checkpointed, small_table

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in their order, repeating.
WEIGHTS = (5, 2, 1)


def words(text="text"):
    """Number of maximal runs of characters other than ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def target_shares(sizes: list[int], weights: list[float], most: float) -> list[float]:
    """Shares of the whole by weight; what exceeds ``most`` times a size is reshared."""
    targets, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while open_:
        unit = left / sum(weights[k] for k in open_)
        above = [k for k in open_ if unit * weights[k] > most * sizes[k]]
        if not above:
            for k in open_:
                targets[k] = unit * weights[k]
            break
        for k in above:
            targets[k] = most * float(sizes[k])
            left -= targets[k]
            open_.discard(k)
    return targets


def split_quotas(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Deal each source's quota of blocks over the shards; rows are shards."""
    if shards == 1:
        return quotas[None, :]
    left = shards // 2
    total = int(quotas.sum())
    drawn = rng.multivariate_hypergeometric(quotas, total * left // shards, method="marginals") if total else quotas
    return np.vstack([split_quotas(drawn, left, rng), split_quotas(quotas - drawn, shards - left, rng)])


def mix(docs: DataFrame, weights: tuple = WEIGHTS, most: int = 3, shards: int = 8, rows_per_block: int = 2000, least_blocks: int = 64, seed: int = 29, also: tuple = ()) -> tuple[DataFrame, DataFrame]:
    """``(digest, draws)`` of ``docs`` (doc_id, text, source).

    ``draws`` has a row per document and time it is taken: doc_id, row (the document's
    row), source, size, copy, shard, position. ``digest`` has a row per document: doc_id,
    size (words; a null text has none), source_size, target (its source's), taken (words
    of its draws), row, draws (copy, shard and position of each, at most ``most``). Both keep the columns named in ``also``.
    Whole documents are taken, up to the target and then those that close the gap best.
    Where the rows lie in files and partitions does not matter. Null sources form one source, sorted last; repeated rows are documents of their own; an empty table gives
    empty results; a source without words takes nothing.
    """
    spark = docs.sparkSession
    light = checkpointed(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", words().alias("size"), F.monotonically_increasing_id().alias("row"), F.xxhash64(F.lit(seed), "doc_id", "source", "text").alias("_h"), *also)
    )
    sources = light.groupBy("source").agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect()
    sources.sort(key=lambda r: (r.source is None, [ord(c) for c in r.source or ""]))
    sizes = [int(r.s) for r in sources]
    targets = target_shares(sizes, [float(weights[k % len(weights)]) for k in range(len(sizes))], most)
    blocks = [max(least_blocks, -(-int(r.n) // rows_per_block)) for r in sources]
    # one row per source: the driver holds these rows already
    plan = small_table(spark, [(r.source, k, s, t, b) for k, (r, s, t, b) in enumerate(zip(sources, sizes, targets, blocks, strict=True))], "_src string, _k int, source_size long, target double, _blocks int")

    # permuted order inside a source: block, then a hash of what the document says; the row number, which
    # follows the files' layout, only parts equal rows, and these stand for each other
    dealt = light.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("_src"))).drop("_src")
    dealt = dealt.withColumn("_block", F.pmod(F.col("_h"), F.col("_blocks")).cast("int"))
    dealt = checkpointed(dealt)
    permuted = Window.partitionBy("_k").orderBy(F.xxhash64(F.lit(seed + 1), "_k", "_block"), "_block")
    per_block = dealt.select("_k", "_block").distinct().withColumn("_rank", F.row_number().over(permuted) - 1)
    per_block = checkpointed(per_block.select(F.col("_k").alias("_bk"), F.col("_block").alias("_bb"), "_rank"))

    rounds = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.floor(F.col("target") / F.col("source_size")).cast("int"))).otherwise(0)
    rest = F.when(F.col("_rounds") < most, F.col("target") - F.col("_rounds") * F.col("source_size")).otherwise(0.0)
    placed = dealt.join(per_block, (F.col("_k") == F.col("_bk")) & (F.col("_block") == F.col("_bb"))).drop("_bk", "_bb").withColumn("_rounds", rounds).withColumn("_rest", rest)
    placed = checkpointed(placed)
    placed = checkpointed(_filled(spark, placed))

    draws = checkpointed(_drawn(spark, placed, len(sources), shards, seed, also))
    drawn = draws.groupBy(F.col("row").alias("_drow")).agg(F.sum("size").alias("_taken"), F.array_sort(F.collect_list(F.struct("copy", "shard", "position"))).alias("_draws"))
    digest = placed.join(drawn, F.col("row") == F.col("_drow"), "left")
    digest = digest.select("doc_id", "size", "source_size", "target", F.coalesce("_taken", F.lit(0)).cast("long").alias("taken"), "row", F.coalesce("_draws", F.array().cast("array<struct<copy:int,shard:int,position:bigint>>")).alias("draws"), *also)
    return digest, draws


#: What a turn of the prefix step took of a source: documents of at most ``gap`` words up to a place in its permuted order.
TURN = "gap double, rank int, h long, row long"
#: A place before all documents of a block.
NOWHERE = (-(2**63), -1)


def _before(turn) -> F.Column:
    """Whether a document lies up to the place where a turn ended."""
    inside = (F.col("_h") < turn["h"]) | ((F.col("_h") == turn["h"]) & (F.col("row") <= turn["row"]))
    return (F.col("_rank") < turn["rank"]) | ((F.col("_rank") == turn["rank"]) & inside)


def _filled(spark, placed: DataFrame) -> DataFrame:
    """``placed`` with ``_last``: whether the last round of its source takes a document.

    Each turn takes documents in the permuted order until one would pass the rest of the
    target, from those that fit what is left of it. Turns end when no document fits; then
    the smallest one left is taken if that brings the sum nearer. A turn is kept as its
    gap and the place where it ended, so the driver holds a row per source and turn.
    """
    turns: dict[int, list[dict]] = {}
    gaps = {r._k: float(r.g or 0.0) for r in placed.groupBy("_k").agg(F.first("_rest").alias("g")).collect()}
    open_ = {k for k, g in gaps.items() if g > 0}
    by_rank = Window.partitionBy("_k").orderBy("_rank").rowsBetween(Window.unboundedPreceding, 0)
    inside = Window.partitionBy("_k").orderBy("_h", "row").rowsBetween(Window.unboundedPreceding, 0)

    def left(ks) -> DataFrame:
        state = F.broadcast(small_table(spark, [(k, gaps[k], turns.get(k, [])) for k in ks], f"_gk int, _gap double, _turns array<struct<{TURN}>>"))
        spare = placed.where("size > 0").join(state, F.col("_k") == F.col("_gk"))
        return spare.where(~F.exists("_turns", lambda t: (F.col("size") <= t["gap"]) & _before(t)))

    while open_:
        fit = left(open_).where("size <= _gap")
        sums = fit.groupBy("_k", "_rank", "_gap").agg(F.sum("size").alias("s")).withColumn("_upto", F.sum("s").over(by_rank))
        whole = F.col("_upto") <= F.col("_gap")
        ends = sums.groupBy("_k").agg(F.coalesce(F.max(F.when(whole, F.col("_upto"))), F.lit(0)).alias("s"), F.min(F.when(~whole, F.col("_rank"))).alias("rank")).collect()
        cut = [(r._k, r.rank, int(r.s)) for r in ends if r.rank is not None]
        at = {}
        if cut:
            # the block in which the sum passes the gap: some thousand documents of a source
            block = fit.join(F.broadcast(small_table(spark, cut, "_ck int, _crank int, _cs long")), (F.col("_k") == F.col("_ck")) & (F.col("_rank") == F.col("_crank")))
            taken = block.withColumn("_upto", F.col("_cs") + F.sum("size").over(inside)).where("_upto <= _gap")
            at = {r._k: r.m for r in taken.groupBy("_k").agg(F.max(F.struct("_h", "row", "_upto")).alias("m")).collect()}
        for r in ends:
            m = at.get(r._k)
            h, row = (m._h, m.row) if m else NOWHERE
            turns.setdefault(r._k, []).append({"gap": gaps[r._k], "rank": 2**31 - 1 if r.rank is None else r.rank, "h": h, "row": row})
            gaps[r._k] -= m._upto if m else r.s
        open_ = {r._k for r in ends if r.rank is not None and gaps[r._k] > 0}

    near = {}
    wide = [k for k, g in gaps.items() if g > 0]
    if wide:
        close = left(wide).where("size < 2 * _gap").groupBy("_k").agg(F.min(F.struct("size", "_h", "row")).alias("m")).collect()
        near = {r._k: r.m.row for r in close}
    state = small_table(spark, [(k, turns.get(k, []), near.get(k)) for k in gaps], f"_gk int, _turns array<struct<{TURN}>>, _near long")
    found = placed.join(F.broadcast(state), F.col("_k") == F.col("_gk"))
    taken = F.exists("_turns", lambda t: (F.col("size") <= t["gap"]) & _before(t)) | F.col("row").eqNullSafe(F.col("_near"))
    return found.withColumn("_last", (F.col("size") > 0) & taken).drop("_gk", "_turns", "_near")


def _drawn(spark, placed: DataFrame, n_sources: int, shards: int, seed: int, also: tuple) -> DataFrame:
    """Draws: the splitting tree's shard for each block of the quotas, and a place in that shard.

    The quota of a source is a row of block numbers: its blocks once for every full
    round, then those with documents of the last round. A shard owns a run of it.
    """
    per_block = placed.groupBy("_k", "_rank").agg(F.max("_rounds").alias("_r"), F.max(F.col("_last").cast("int")).alias("_l"))
    by_rank = Window.partitionBy("_k").orderBy("_rank").rowsBetween(Window.unboundedPreceding, 0)
    numbered = checkpointed(per_block.withColumn("_full", F.count("*").over(by_rank) - 1).withColumn("_part", F.sum("_l").over(by_rank) - F.col("_l")))
    quotas = np.zeros(n_sources, np.int64)
    firsts = np.zeros(n_sources, np.int64)
    for r in numbered.groupBy("_k").agg(F.count("*").alias("n"), F.max("_r").alias("r"), F.sum("_l").alias("l")).collect():
        firsts[r._k] = r.r * r.n
        quotas[r._k] = firsts[r._k] + r.l
    counts = split_quotas(quotas, shards, np.random.default_rng(seed)) if n_sources else np.zeros((shards, 0), np.int64)
    ends = counts.cumsum(0)
    runs = small_table(spark, [(k, int(firsts[k]), [int(e) for e in ends[:, k]]) for k in range(n_sources)], "_rk int, _first long, _ends array<long>")
    numbers = numbered.select(F.col("_k").alias("_nk"), F.col("_rank").alias("_nr"), "_full", "_part", F.count("*").over(Window.partitionBy("_k")).alias("_n"))
    times = F.col("_rounds") + F.col("_last").cast("int")
    copies = placed.where((F.col("size") > 0) & (times > 0)).join(numbers, (F.col("_k") == F.col("_nk")) & (F.col("_rank") == F.col("_nr")))
    copies = copies.withColumn("copy", F.explode(F.sequence(F.lit(0), times - 1))).join(F.broadcast(runs), F.col("_k") == F.col("_rk"))
    at = F.when(F.col("copy") < F.col("_rounds"), F.col("copy") * F.col("_n") + F.col("_full")).otherwise(F.col("_first") + F.col("_part"))
    drawn = copies.withColumn("_at", at).withColumn("shard", F.size(F.filter("_ends", lambda e: e <= F.col("_at")))).where(F.col("shard") < shards)
    return drawn.select("doc_id", "row", "source", "size", "copy", "shard", F.xxhash64(F.lit(seed + 2), "_h", "copy", "shard").alias("position"), *also)
