"""Queries that run a stream to its end: the log arrives in parts, and each part is drained into a versioned table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.sources.versions import VersionedTable, shared_folder
from tidemill.streaming import evidence, memory

#: The last day of the month of each part.
PARTS = (10, 20, 31)
ROUTE = ("domain", "url_class", "strategy", "level")
STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _in_parts(log: DataFrame, when: str, folder: str, drain: Callable[[DataFrame], None]) -> None:
    """Append the log to a folder part by part, and drain the stream of that folder after each."""
    spark, low = log.sparkSession, 0
    for high in PARTS:
        log.where((F.dayofmonth(when) > low) & (F.dayofmonth(when) <= high)).write.mode("append").parquet(f"{folder}/in")
        drain(spark.readStream.schema(log.schema).parquet(f"{folder}/in"))
        low = high


def _latest(table: VersionedTable, keys: tuple[str, ...]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that keeps the last state of each key, once for each batch."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        if table.has_batch(batch_id):
            return
        held = table.read()
        rest = batch if held is None else held.join(batch.select(*keys), list(keys), "left_anti").unionByName(batch)
        table.commit(rest, batch_id)

    return merge


def stream_route_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-04 over the whole attempt log."""
    from tidemill.plans.registry import _table

    folder = shared_folder(spark)
    table, before = VersionedTable(spark, f"{folder}/routes"), spark.conf.get(STORE, None)

    def drain(stream: DataFrame) -> None:
        memory.route_memory(stream, ROUTE).writeStream.outputMode("update").option("checkpointLocation", f"{folder}/cp").foreachBatch(_latest(table, ROUTE)).trigger(availableNow=True).start().awaitTermination()

    spark.conf.set(STORE, ROCKS)
    try:
        _in_parts(_table(spark, sf_dir, "attempts", {}), "attempted_at", folder, drain)
    finally:
        spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)
    return table.read().select(*ROUTE, "attempts", "scored", "successes", "blocks", "soft_blocks", F.round(F.round("ewma", 6), 4).alias("ewma"), F.round(F.round("latency_ms", 6), 3).alias("latency_ms"))


def stream_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-07 over all observed requests."""
    from tidemill.plans.registry import _table

    folder = shared_folder(spark)
    table = VersionedTable(spark, f"{folder}/evidence")
    _in_parts(_table(spark, sf_dir, "observed_requests", {}), "observed_at", folder, lambda stream: evidence.discover(stream, table, f"{folder}/cp").awaitTermination())
    return table.read().select("identity", "domain", "requests", "runs", "validated", "rejected", "changes", "pages", "first_seen", "last_seen", "state")


QUERIES = {f.__name__: f for f in (stream_route_memory, stream_discovery)}


def oracle_sql(oracle: Callable[[str], str]) -> dict[str, str]:
    """The batch operators that the streams have to equal."""
    return {
        "stream_route_memory": f"""SELECT s.domain, s.url_class, s.strategy, s.level, s.attempts, s.scored, s.successes, s.blocks, s.soft_blocks, round(e.ewma, 4) AS ewma, round(e.latency_ms, 3) AS latency_ms
FROM ({oracle("route_stats")}) s JOIN ({oracle("ewma_signals")}) e ON s.domain = e.domain AND s.url_class = e.url_class AND s.strategy = e.strategy AND s.level = e.level""",
        "stream_discovery": oracle("endpoint_evidence"),
    }
