"""From raw documents to packed training sequences.

Each stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and read
again as the next stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import jaccard, mixing, packing, quality, secrets
from tidemill.llm.common import checkpointed, id_filter, shared_folder, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Draws (id, key, shard, position) that may go to every executor: 28 bytes each.
BROADCAST_ROWS = 1_000_000


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; null and empty texts are scored by the bias alone.

    Repeated rows are judged alike; without labels nothing is accepted.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).where("quality_label = 1").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    Near copies share 80 of 100 five-word shingles; op9's own query has another rule.
    Rows with a null id stay; of rows that repeat an id, the smallest by its columns stays.
    """
    linked = checkpointed(jaccard.link(docs, percent=80, width=5))
    copies = linked.where("component_id <> doc_id").select("doc_id").distinct()
    several = linked.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    # each row passes one filter, and so one Python worker
    repeated, _ = id_filter(docs, several.join(copies, "doc_id", "left_anti"))
    _, single = id_filter(docs, copies.union(several).distinct())
    docs = docs.select(*COLUMNS)
    smallest = repeated(docs).groupBy("doc_id").agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*")
    return single(docs).unionByName(smallest)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their secrets masked; n_chars follows the text. Null and empty texts stay as they are."""
    masked = secrets.redacted(docs)
    return masked.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The drawn documents, one row for each draw, in the order of shard and position.

    Rows that agree in all columns stand for each other.
    """
    keyed = docs.select(*COLUMNS).withColumn("_key", F.xxhash64(*COLUMNS))
    digest, draws = mixing.mix(keyed, also=("_key",))
    repeats = checkpointed(digest.groupBy("_key").count().where("count > 1").select("_key"))
    draws = draws.select(F.col("doc_id").alias("_id"), "_key", "shard", "position")
    repeats, draws = (F.broadcast(t) if t.count() <= BROADCAST_ROWS else t for t in (repeats, draws))
    once = keyed.join(repeats, "_key", "left_anti").unionByName(keyed.join(repeats, "_key", "left_semi").dropDuplicates(COLUMNS))
    taken = once.join(draws, "_key").where(F.col("doc_id").eqNullSafe(F.col("_id")))
    return taken.orderBy("shard", "position").select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed into sequences; null and empty texts hold id 0 only, repeated rows are packed one by one."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("secret scans", mask_secrets),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: No SQL trains the classifier or finds the packing; tests hold the near-copy stage against brute force and the mixing stage
#: against its draws, but neither ``run`` nor the classifier's and the packing stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; tables between stages go to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
