"""Helpers that several operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Some rows that the driver holds; structs are dicts.

    Lists of rows pass through Python workers on the executors, of another kind than those
    of functions, so that both kinds stay there; an Arrow table needs none.
    """
    kinds = T.StructType.fromDDL(schema)
    return spark.createDataFrame(pa.Table.from_pylist([dict(zip(kinds.names, r, strict=True)) for r in rows], to_arrow_schema(kinds)), kinds)


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which the driver and all executors share.

    A folder of this machine is set only where the session has none, as in tests.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="tidemill-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with files that outlive the executors that wrote them."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


class Scratch:
    """Tables in the shared folder that cut the lineage, for loops, and that can be let go.

    A checkpoint keeps the size that was estimated for its plan, and joins multiply
    sizes: over some rounds that number alone fills the driver. A written table has the
    size of its files.
    """

    def __init__(self, spark: SparkSession):
        self._spark, self._folder, self._kept = spark, f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}", {}

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self._folder}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self._spark.read.schema(df.schema).parquet(path)
        self._kept[id(out)] = (out, path)
        return out

    def keep_in_buckets(self, df: DataFrame, *keys: str) -> DataFrame:
        """As ``keep``, in buckets of ``keys``: joins on all of them do not move the table again.

        ``df`` should be dealt by ``keys`` already, or each task writes into every bucket.
        """
        name, parts = f"tidemill_{uuid.uuid4().hex}", int(self._spark.conf.get("spark.sql.shuffle.partitions"))
        path = f"{self._folder}/{name}"
        df.write.bucketBy(parts, *keys).format("parquet").option("path", path).saveAsTable(name)
        out = self._spark.table(name)
        self._kept[id(out)] = (out, path)
        return out

    def together(self, tables: list[DataFrame], schema: str) -> DataFrame:
        """The rows of some kept tables, as one scan however many they are."""
        if not tables:
            return small_table(self._spark, [], schema)
        return self._spark.read.schema(schema).parquet(*[self._kept[id(t)][1] for t in tables])

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more; no job is run for it."""
        jvm, conf = self._spark._jvm, self._spark._jsc.hadoopConfiguration()
        for table_ in tables:
            _, path = self._kept.pop(id(table_))
            name = path.rsplit("/", 1)[1]
            if name.startswith("tidemill_"):
                self._spark.sql(f"DROP TABLE {name}")
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)


def stored(df: DataFrame) -> DataFrame:
    """A table in the shared folder that stays."""
    return Scratch(df.sparkSession).keep(df)


def utf8_size(text="text"):
    """UTF-8 bytes of a text; a null text has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def ranked_in_group(df: DataFrame, group: str, salt_key, rank: str, rows_per_part: int = 20_000) -> DataFrame:
    """Number the rows of each group from 0, gapless, without a task per group.

    A group is dealt over sub-buckets in proportion to its count; each sub-bucket is
    numbered by itself and shifted by the rows of the sub-buckets before it. ``df`` is
    read three times, so it should be checkpointed. ``salt_key`` is a deterministic
    column.
    """
    from pyspark.sql import Window

    counts = df.groupBy(group).agg(F.count("*").alias("_n"))
    parts = counts.select(F.col(group).alias("_g"), F.greatest(F.lit(1), F.ceil(F.col("_n") / rows_per_part)).cast("int").alias("_parts"))
    sub = df.join(parts, F.col(group).eqNullSafe(F.col("_g"))).withColumn("_sub", F.pmod(F.xxhash64(salt_key), F.col("_parts")).cast("int")).drop("_g", "_parts")
    before = sub.groupBy(group, "_sub").agg(F.count("*").alias("_m"))
    before = before.select(F.col(group).alias("_g"), F.col("_sub").alias("_s"), (F.sum("_m").over(Window.partitionBy(group).orderBy("_sub")) - F.col("_m")).alias("_before"))
    own = sub.withColumn("_own", F.row_number().over(Window.partitionBy(group, "_sub").orderBy(salt_key)) - 1)
    joined = own.join(before, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_sub") == F.col("_s")))
    return joined.withColumn(rank, F.col("_own") + F.col("_before")).drop("_g", "_s", "_sub", "_own", "_before")


def hash_sample(df: DataFrame, total: int, rows: int, seed: int, *columns: str) -> DataFrame:
    """Some ``rows`` of a table of ``total`` rows, by a hash of ``columns``.

    A cut-off of the hash comes before the order, so no task is sent more than it needs.
    """
    if total <= rows:
        return df
    place = F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 30))
    return df.where(place < int((1.3 * rows + 100) / total * (1 << 30))).orderBy(place, *columns).limit(rows)


def arrow_texts(batch, rows: int = 500):
    """Pieces of an Arrow batch with the texts of each: ids stay what they are beside nulls."""
    for at in range(0, batch.num_rows, rows):
        piece = batch.slice(at, rows)
        yield piece, piece.column("text").to_pylist()
    release()


def release() -> None:
    """Give back what is freed: a worker is used again, and Arrow and the C library would keep it."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def text_udf(f, kind: str):
    """A column function that computes ``f`` of each text; a batch's texts are Python strings some at a time."""
    out = {"string": pa.string(), "double": pa.float64()}[kind]

    @F.arrow_udf(kind)
    def computed(texts: pa.Array) -> pa.Array:
        found = pa.concat_arrays([pa.array([f(t) for t in texts.slice(at, 500).to_pylist()], out) for at in range(0, max(1, len(texts)), 500)])
        release()
        return found

    return computed


def ids_within(docs: DataFrame, ids: DataFrame, most: int = 2_000_000, outside: bool = False):
    """``docs`` and a filter of its Arrow batches, for functions that read only the rows with ``ids`` (distinct), or without if ``outside``.

    As ``id_filter``, but inside the function that reads the texts, which saves a Python
    worker to each task. A null doc_id is outside.
    """
    some = ids.select("doc_id").where("doc_id is not null").limit(most + 1).toPandas().doc_id.to_numpy(np.int64)
    if len(some) > most:
        return docs.join(ids, "doc_id", "left_anti" if outside else "left_semi"), lambda batch: batch
    known = docs.sparkSession.sparkContext.broadcast(np.sort(some))

    def keep(batch):
        own = batch.column("doc_id")
        values, ids_ = own.fill_null(0).to_numpy(zero_copy_only=False), known.value
        ok = np.zeros(len(values), bool)
        if len(ids_):
            ok = (ids_[np.minimum(np.searchsorted(ids_, values), len(ids_) - 1)] == values) & own.is_valid().to_numpy(zero_copy_only=False)
        return batch.filter(pa.array(ok != outside))

    return docs, keep


def locate(columns: list[np.ndarray], splitters: list[np.ndarray]) -> np.ndarray:
    """How many splitters are at or below each row, by lexicographic binary search."""
    n, m = len(columns[0]), len(splitters[0])
    lo, hi = np.zeros(n, np.int64), np.full(n, m, np.int64)
    while (open_ := lo < hi).any():
        mid = np.minimum((lo + hi) // 2, m - 1)
        below, equal = np.zeros(n, bool), np.ones(n, bool)
        for column, splitter in zip(columns, splitters, strict=True):
            cut = splitter[mid]
            below |= equal & (cut < column)
            equal &= cut == column
        below |= equal
        lo, hi = np.where(open_ & below, mid + 1, lo), np.where(open_ & ~below, mid, hi)
    return lo


def id_filter(docs: DataFrame, ids: DataFrame, most: int = 2_000_000):
    """``(inside, outside)``: filters of tables by whether doc_id is in ``ids`` (distinct).

    Up to ``most`` ids go to the tasks as one sorted array of at most 16 MB, and no row
    is shuffled; more ids are joined. A null doc_id is outside.
    """
    some = ids.select("doc_id").where("doc_id is not null").limit(most + 1).toPandas().doc_id.to_numpy(np.int64)
    if len(some) > most:
        return (lambda df: df.join(ids, "doc_id", "left_semi")), (lambda df: df.join(ids, "doc_id", "left_anti"))
    known = docs.sparkSession.sparkContext.broadcast(np.sort(some))

    @F.pandas_udf(T.BooleanType())
    def there(doc_id: pd.Series) -> pd.Series:
        own = doc_id.to_numpy(np.int64)
        if not len(known.value):
            return pd.Series(np.zeros(len(own), bool))
        at = np.minimum(np.searchsorted(known.value, own), len(known.value) - 1)
        return pd.Series(known.value[at] == own)

    # a null among ids would make them floats on their way to Python
    inside = F.col("doc_id").isNotNull() & there(F.coalesce("doc_id", F.lit(0)).cast("long"))
    return (lambda df: df.where(inside)), (lambda df: df.where(~inside))
