"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected to a few dimensions in several ways; each projection is shifted
and ordered along a Hilbert curve, and the order is cut into tiles of equal rows. A query
meets the rows of its own tile and of the tiles around it on every curve; the results
merge and are ranked by the exact inner product. The query's own tile on the first curve
comes first: its k-th best score is a floor, below which no other tile answers. How many
tiles around is calibrated: a bounded sample of queries is compared with all rows, and
the narrowest window that reaches the wanted recall on that sample is used.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import checkpointed, hash_sample
from tidemill.llm.topk import matrix, usable


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points with coordinates below ``2 ** bits``.

    The usual transposed form: undo the rotations of each level from the top, then Gray
    encode, then interleave the bits of the axes.
    """
    x = points.astype(np.int64).T.copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):
        high, low = 1 << level, (1 << level) - 1
        for axis in range(n):
            inverts = (x[axis] & high) != 0
            swap = np.where(inverts, 0, (x[0] ^ x[axis]) & low)
            x[0] = np.where(inverts, x[0] ^ low, x[0] ^ swap)
            x[axis] ^= swap
    for axis in range(1, n):
        x[axis] ^= x[axis - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[n - 1] & (1 << level), (1 << level) - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for axis in range(n):
            key = (key << 1) | ((x[axis] >> level) & 1)
    return key


class Curves:
    """Several projections, each with its own shift and quantile scale, and their tiles."""

    def __init__(self, sample: np.ndarray, largest: float, curves: int, axes: int, bits: int, seed: int):
        rng = np.random.default_rng(seed)
        self.largest, self.bits = largest, bits
        lifted = self.lift(sample)
        self.bases = [np.linalg.qr(rng.standard_normal((lifted.shape[1], min(axes, lifted.shape[1]))))[0] for _ in range(curves)]
        self.scales = [np.sort(lifted @ b, axis=0) for b in self.bases]
        self.shifts = [rng.random(b.shape[1]) / 4 for b in self.bases]
        self.cuts = [np.zeros(0, np.int64)] * curves

    def cut(self, keys: np.ndarray, tiles: int) -> None:
        """Borders of tiles of equal rows, from the keys of some rows: a column for each curve."""
        at = (np.arange(1, tiles) * len(keys)) // max(tiles, 1)
        self.cuts = [np.unique(np.sort(keys[:, c])[at]) for c in range(keys.shape[1])]

    def lift(self, x: np.ndarray) -> np.ndarray:
        """Data vectors on the unit sphere, so that the largest inner product is nearest."""
        scaled = x / self.largest
        return np.hstack([scaled, np.sqrt(np.maximum(0, 1 - (scaled**2).sum(1, keepdims=True)))])

    @staticmethod
    def aim(x: np.ndarray) -> np.ndarray:
        return np.hstack([x / np.sqrt((x**2).sum(1, keepdims=True)), np.zeros((len(x), 1))])

    def key(self, lifted: np.ndarray, c: int) -> np.ndarray:
        """Curve place: coordinates by quantile of the sample, moved by the shift, in 4/5 of the cube."""
        points = lifted @ self.bases[c]
        share = np.stack([np.searchsorted(self.scales[c][:, a], points[:, a]) for a in range(points.shape[1])], 1) / max(1, len(self.scales[c]))
        return hilbert(((share + self.shifts[c]) * 0.8 * ((1 << self.bits) - 1)).astype(np.int64), self.bits)

    def tile(self, lifted: np.ndarray, c: int) -> np.ndarray:
        return np.searchsorted(self.cuts[c], self.key(lifted, c), "right")


def _vectors(vectors: DataFrame) -> DataFrame:
    data = usable(vectors).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    return data.where(F.exists("v", lambda x: x != 0))


def exact_best(q: np.ndarray, x: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, column, score)`` of each query's k best; ``ids`` ascend, and ties go to smaller ids.

    A matrix product may give equal vectors scores that differ in the last bits, so what
    comes near the k-th best is scored again by sums in one order.
    """
    scores = q @ x.T
    slack = 1e-12 * np.sqrt((q**2).sum(1)) * np.sqrt((x**2).sum(1).max(initial=0))
    first, last = np.searchsorted(ids, own, "left"), np.searchsorted(ids, own, "right")
    rows, cols, best = [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0)]
    for r, row in enumerate(scores):
        row[first[r] : last[r]] = -np.inf
        n = len(row) - (last[r] - first[r])
        low = np.partition(row, len(row) - k)[len(row) - k] - slack[r] if n > k else -np.inf
        at = np.flatnonzero((row >= low) & np.isfinite(row))
        again = (q[r] * x[at]).sum(1)
        order = np.lexsort((ids[at], -again))[:k]
        rows.append(np.full(len(order), r))
        cols.append(at[order])
        best.append(again[order])
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(best)


def _scan(data: DataFrame, asked: pd.DataFrame, dim: int, k: int) -> pd.DataFrame:
    """Exact answers for a bounded set of queries: each task ranks its own rows."""
    own, q = asked.vec_id.to_numpy(), matrix(asked.v, dim)

    def best(batches):
        for batch in batches:
            batch = batch.sort_values("vec_id")
            ids, x = batch.vec_id.to_numpy(), matrix(batch.v, dim)
            r, c, score = exact_best(q, x, own, ids, k)
            yield pd.DataFrame({"query_id": own[r], "vec_id": ids[c], "score": score, "v": list(x[c])})

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = data.mapInPandas(best, "query_id long, vec_id long, score double, v array<double>")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).toPandas()


def neighbours(vectors: DataFrame, every: int = 20, k: int = 20, curves: int = 8, axes: int = 6, bits: int = 10, tile_rows: int = 4096, sample: int = 8192, probes: int = 64, recall: float = 0.96, seed: int = 23) -> DataFrame:
    """The ``k`` largest inner products found for each row whose id ``every`` divides.

    Returns query_id, rank, vec_id, score. Rows that share the query's id are not its
    candidates; a query id that occurs more than once is asked once, with its smallest
    vector. Shorter vectors end in zeros. Rows with a null id, and null, zero or
    non-finite vectors take no part. An empty table, or one row, gives an empty result.
    A query with fewer than ``k`` rows around it gets those.
    The driver holds ``sample`` vectors, which scale the curves, and the places of four
    rows a tile on each curve (256 bytes a tile), which cut them.
    """
    spark = vectors.sparkSession
    data = _vectors(vectors)
    facts = data.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("largest")).first()
    if not facts.n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, tiles = facts.dim, max(1, round(facts.n / tile_rows))
    known = hash_sample(data, facts.n, sample, seed, "vec_id", "v").toPandas()
    index = Curves(matrix(known.v, dim), facts.largest, curves, axes, bits, seed)

    def places(batches):
        for batch in batches:
            lifted = index.lift(matrix(batch.v, dim))
            yield pd.DataFrame({"keys": list(np.stack([index.key(lifted, c) for c in range(curves)], 1))})

    if tiles > 1:
        some = hash_sample(data, facts.n, max(sample, 4 * tiles), seed + 3, "vec_id", "v")
        index.cut(np.stack(some.mapInPandas(places, "keys array<long>").toPandas()["keys"].to_numpy()), tiles)
    queries = data.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min("v").alias("v"))

    probe = hash_sample(queries, -(-facts.n // every), probes, seed + 1, "vec_id").limit(probes).toPandas()
    reach = 0
    if tiles > 1 and len(probe):
        truth = _scan(data, probe, dim, k)
        place = {q: n for n, q in enumerate(probe.vec_id)}
        at = truth.query_id.map(place).to_numpy()
        aimed, lifted = Curves.aim(matrix(probe.v, dim)), index.lift(matrix(truth.v, dim))
        apart = np.min([np.abs(index.tile(aimed, c)[at] - index.tile(lifted, c)) for c in range(curves)], axis=0)
        reach = int(np.quantile(apart, recall, method="higher")) if len(apart) else 0

    def data_tiles(batches):
        for batch in batches:
            lifted = index.lift(matrix(batch.v, dim))
            for c in range(curves):
                yield pd.DataFrame({"curve": np.int32(c), "tile": index.tile(lifted, c).astype(np.int32), "vec_id": batch.vec_id, "v": batch.v})

    def query_tiles(widths):
        def around(batches):
            for batch in batches:
                aimed = Curves.aim(matrix(batch.v, dim))
                for c, width in enumerate(widths):
                    tile = index.tile(aimed, c)
                    for step in range(-width, width + 1):
                        ok = (tile + step >= 0) & (tile + step <= len(index.cuts[c]))
                        yield pd.DataFrame({"curve": np.int32(c), "tile": (tile + step)[ok].astype(np.int32), "query_id": batch.vec_id[ok], "q": batch.v[ok], "floor": batch.floor[ok]})

        return around

    # equal vectors share a tile, however many they are: a tile is solved by parts
    part = lambda column, n: F.pmod(F.xxhash64(F.lit(seed + 2), column), n).cast("int")
    rows = checkpointed(data.mapInPandas(data_tiles, "curve int, tile int, vec_id long, v array<double>"))
    sizes = rows.groupBy("curve", "tile").agg(F.ceil(F.count("*") / (2 * tile_rows)).cast("int").alias("parts"))
    right = rows.join(sizes, ["curve", "tile"]).withColumn("part", part("vec_id", F.col("parts"))).drop("parts")

    def solve(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(x):
            x = x.sort_values("vec_id")
            ids, values = x.vec_id.to_numpy(), matrix(x.v, dim)
            for at in range(0, len(q), 256):
                some = q.iloc[at : at + 256]
                own = some.query_id.to_numpy()
                r, c, score = exact_best(matrix(some.q, dim), values, own, ids, k)
                high = score >= some.floor.to_numpy()[r]
                out.append(pd.DataFrame({"query_id": own[r[high]], "vec_id": ids[c[high]], "score": score[high]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})

    def solved(asked: DataFrame, data_rows: DataFrame, widths: list[int]) -> DataFrame:
        left = asked.mapInPandas(query_tiles(widths), "curve int, tile int, query_id long, q array<double>, floor double").join(sizes, ["curve", "tile"])
        left = left.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        key = ["curve", "tile", "part"]
        return left.groupBy(*key).cogroup(data_rows.groupBy(*key)).applyInPandas(solve, "query_id long, vec_id long, score double")

    def ranked(found: DataFrame) -> DataFrame:
        # the same row may come from several curves
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        return once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    lowest = queries.withColumn("floor", F.lit(float("-inf")))
    first = checkpointed(ranked(solved(lowest, right.where("curve = 0"), [0])))
    if not len(index.cuts[0]):
        return first  # one tile holds all rows
    floors = first.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count("*") == k, F.min("score")).alias("f"))
    asked = queries.join(floors, "vec_id", "left").select("vec_id", "v", F.coalesce("f", F.lit(float("-inf"))).alias("floor"))
    return ranked(solved(asked, right, [reach] * curves).union(first.drop("rank")))
