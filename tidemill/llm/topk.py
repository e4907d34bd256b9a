"""Exact top-k search as a Voronoi kNN join.

Pivots cut the data into cells; a summary of each cell (rows, radius, largest norm)
bounds the scores that its rows can have for a query. A query's own lower bound is the
k-th best score over a bounded sample of the rows. Data rows go only to the groups of
queries that their cell's bound admits, and each group is solved locally, by blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import checkpointed, hash_sample

FIXED = "vec_id long, v array<long>"


def usable(vectors: DataFrame) -> DataFrame:
    """Rows with an id and a vector of finite numbers only."""
    ok = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return vectors.where(ok & F.coalesce(finite, F.lit(False)))


def matrix(rows, dim: int, kind=np.float64) -> np.ndarray:
    """Vectors as a matrix; shorter ones end in zeros."""
    out = np.zeros((len(rows), dim), kind)
    for k, row in enumerate(rows):
        out[k, : len(row)] = row
    return out


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products; in doubles where those hold them exactly."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if most < 2.0**53:
        return q.astype(np.float64) @ x.astype(np.float64).T
    return q @ x.T


def best_rows(scores: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of each row's k best scores; ``ids`` ascend, so ties go to smaller ids."""
    rows, cols = [], []
    first, last = np.searchsorted(ids, own, "left"), np.searchsorted(ids, own, "right")
    for r, row in enumerate(scores):
        allowed = np.ones(len(ids), bool)
        allowed[first[r] : last[r]] = False
        if (n := int(allowed.sum())) > k:
            cut = np.partition(row[allowed], n - k)[n - k]
            allowed &= row >= cut
        at = np.flatnonzero(allowed)
        at = at[np.argsort(-row[at], kind="stable")][:k]
        rows.append(np.full(len(at), r))
        cols.append(at)
    return np.concatenate(rows or [np.zeros(0, int)]), np.concatenate(cols or [np.zeros(0, int)])


def topk(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256, pivots: int = 64, sample: int = 1024, block_rows: int = 8192, block_queries: int = 2048, seed: int = 7) -> DataFrame:
    """The ``k`` highest integer inner products of each row whose id ``every`` divides.

    Components become floor(scale * x). Returns query_id, rank, vec_id, score. Rows that
    share the query's id are not its candidates; a query id that occurs more than once is
    asked once, with its smallest vector; repeated rows are candidates of their own.
    Vectors of other lengths are compared as if they ended in zeros. Rows with a null id
    take no part. Components have to stay within 64 bits after scaling, and scores too. An
    empty table, or one row, gives an empty result.
    """
    spark = vectors.sparkSession
    data = usable(vectors).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))
    facts = data.agg(F.max(F.size("v")).alias("dim"), F.count("*").alias("n")).first()
    dim = facts.dim or 0
    sampled = hash_sample(data, facts.n, sample, seed, "vec_id", "v").select("vec_id", "v").collect()
    known, known_ids = matrix([r.v for r in sampled], dim, np.int64), np.array([r.vec_id for r in sampled], np.int64)
    centres = known[:pivots].astype(np.float64)
    if not len(centres):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    def cells(batches):
        half = (centres**2).sum(1) / 2
        for batch in batches:
            x = matrix(batch.v, dim)
            cell = (x @ centres.T - half).argmax(1)
            yield pd.DataFrame({"vec_id": batch.vec_id, "v": batch.v, "cell": cell.astype(np.int32), "far": np.sqrt(((x - centres[cell]) ** 2).sum(1)), "norm": np.sqrt((x**2).sum(1))})

    placed = checkpointed(data.mapInPandas(cells, FIXED + ", cell int, far double, norm double"))
    summary = {r.cell: r for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far"), F.max("norm").alias("norm")).collect()}
    queries = placed.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min(F.struct("v", "cell")).alias("s")).select("vec_id", "s.v", "s.cell")
    asked = {r.cell: r.n for r in queries.groupBy("cell").agg(F.count("*").alias("n")).collect()}

    # query groups: neighbouring cells together until a block is full, and large cells cut
    group_of, group, size = {}, 0, 0
    for cell in sorted(asked, key=lambda c: tuple(centres[c])):
        if size and size + asked[cell] > block_queries:
            group, size = group + 1, 0
        parts = -(-asked[cell] // block_queries)
        group_of[cell] = (group, parts)
        group, size = (group + parts, 0) if parts > 1 else (group, size + asked[cell])
    cell_plan = [(c, -(-int(s.n) // block_rows)) for c, s in summary.items()]
    order = sorted(summary)
    radius, norms = np.array([summary[c].far for c in order]), np.array([summary[c].norm for c in order])

    def needs(batches):
        for batch in batches:
            q = matrix(batch.v, dim, np.int64)
            seen = np.asarray(_products(q, known), np.float64)
            # rows that share the query's id are no candidates, however many of them the sample holds
            seen[batch.vec_id.to_numpy()[:, None] == known_ids[None, :]] = -np.inf
            floor = np.partition(seen, -k, 1)[:, -k] if seen.shape[1] >= k else np.full(len(q), -np.inf)
            length = np.sqrt((q.astype(np.float64) ** 2).sum(1))
            most = np.minimum(q @ centres[order].T + length[:, None] * radius, length[:, None] * norms)
            admitted = most * (1 + 1e-9) + 1e-6 >= floor[:, None]
            yield pd.DataFrame({"query_id": batch.vec_id, "v": batch.v, "cell": batch.cell, "need": [[order[c] for c in np.flatnonzero(row)] for row in admitted]})

    groups = F.broadcast(spark.createDataFrame([(c, g, p) for c, (g, p) in group_of.items()], "cell int, g int, parts int"))
    parts = F.broadcast(spark.createDataFrame(cell_plan, "cell int, blocks int"))
    asking = queries.mapInPandas(needs, "query_id long, v array<long>, cell int, need array<int>")
    asking = checkpointed(asking.join(groups, "cell").withColumn("g", F.col("g") + F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int")).drop("cell", "parts"))
    pairs = asking.select("g", F.explode("need").alias("cell")).distinct().join(parts, "cell")
    left = asking.select("g", "query_id", F.col("v").alias("q")).join(pairs.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks"), "g")
    right = placed.select("cell", "vec_id", "v").join(pairs, "cell").withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "vec_id", "v"), F.col("blocks")).cast("int")).drop("blocks")

    def solve(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(x):
            x = x.sort_values("vec_id")
            ids, values = x.vec_id.to_numpy(), matrix(x.v, dim, np.int64)
            for at in range(0, len(q), 256):
                part = q.iloc[at : at + 256]
                scores = _products(matrix(part.q, dim, np.int64), values)
                own = part.query_id.to_numpy()
                r, c = best_rows(scores, own, ids, k)
                out.append(pd.DataFrame({"query_id": own[r], "vec_id": ids[c], "score": scores[r, c].astype(np.int64)}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")

    key = ["g", "cell", "block"]
    # fresh column identities: both sides come from the same pairs
    left, right = left.toDF(*left.columns), right.toDF(*right.columns)
    local = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(solve, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
