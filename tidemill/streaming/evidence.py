"""STR-07: evidence on endpoints, folded batch by batch into a versioned table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.operators.base import OPERATORS
from tidemill.sources.versions import VersionedTable

#: Pages kept of an endpoint, and endpoints of a domain; more are not stored (limits of the evidence table itself).
MOST_PAGES, MOST_PER_DOMAIN = 64, 100
COUNTS = ("requests", "runs", "validated", "rejected", "changes")


def runs_of(requests: DataFrame) -> DataFrame:
    """What each run (a day) in a batch of observed requests saw of each endpoint."""
    spark = requests.sparkSession
    screened = OPERATORS["screen_observed_requests"](spark, observed_requests=requests)
    identity = OPERATORS["endpoint_identity"](spark, observed_requests=requests)
    return OPERATORS["endpoint_runs"](spark, observed_requests=requests, screen_observed_requests=screened, endpoint_identity=identity)


def fold(evidence: DataFrame | None, runs: DataFrame, least_pages: int = 3) -> DataFrame:
    """Evidence after some more runs; a run has to come whole, and later than those before.

    A shape that differs from the run before asks for a new validation, a refused last run
    refuses the endpoint, ``least_pages`` distinct pages validate it. New endpoints of a
    domain that is full are left out.
    """
    runs = runs.select("identity", "domain", "run", F.lit(False).alias("held"), "requests", F.lit(1).cast("long").alias("runs"), F.col("validated").cast("long").alias("validated"), F.col("rejection").isNotNull().cast("long").alias("rejected"), F.lit(0).cast("long").alias("changes"), "signature", F.split("pages", ",").alias("pages"), F.col("run").alias("first_seen"), F.col("run").alias("last_seen"))
    if evidence is not None:
        known = evidence.select("identity", "domain", F.lit(None).cast("date").alias("run"), F.lit(True).alias("held"), "requests", "runs", "validated", "rejected", "changes", "signature", F.split("page_hashes", ",").alias("pages"), "first_seen", "last_seen")
        runs = known.unionByName(runs)
    by_run = Window.partitionBy("identity").orderBy(F.col("run").asc_nulls_first())
    moved = ~F.col("held") & (F.col("rejected") == 0) & (F.lag("signature").over(by_run) != F.col("signature"))
    rows = runs.withColumn("moved", F.coalesce(moved, F.lit(False)).cast("long"))
    order = F.coalesce("run", F.lit("0001-01-01").cast("date"))
    last = F.max_by(F.struct("rejected", "moved", "signature"), order)
    found = rows.groupBy("identity").agg(
        F.max("domain").alias("domain"), F.max("held").alias("held"), *(F.sum(c).alias(c) for c in COUNTS[:-1]), (F.sum("changes") + F.sum("moved")).alias("changes"),
        F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("pages")))), 1, MOST_PAGES).alias("pages"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), last.alias("last"),
    )
    domain = Window.partitionBy("domain").orderBy(F.desc("held"), "first_seen", "identity")
    found = found.withColumn("place", F.row_number().over(domain)).where(F.col("held") | (F.col("place") <= MOST_PER_DOMAIN))
    state = F.when(F.col("last.rejected") > 0, "REJECTED").when(F.col("last.moved") == 1, "REVALIDATION_REQUIRED").when(F.size("pages") >= least_pages, "VALIDATED").otherwise("PROMISING")
    return found.select("identity", "domain", *COUNTS, F.size("pages").cast("long").alias("pages"), F.array_join("pages", ",").alias("page_hashes"), "first_seen", "last_seen", F.col("last.signature").alias("signature"), state.alias("state"))


def merge_into(table: VersionedTable) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: a batch of observed requests becomes the table's next version, once."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        if not table.has_batch(batch_id):
            table.commit(fold(table.read(), runs_of(batch)), batch_id)

    return merge


def discover(requests: DataFrame, table: VersionedTable, checkpoint: str):
    """The running query over a stream of observed requests."""
    return requests.writeStream.option("checkpointLocation", checkpoint).foreachBatch(merge_into(table)).trigger(availableNow=True).start()
