"""Files in and out: saved responses, snapshots, append-only logs and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

META = "url string, status int, headers map<string,string>, verdict string, attempt_index int"


def read_snapshots(spark: SparkSession, root: str) -> DataFrame:
    """SRC-01, SRC-02: each ``*.meta.json`` below ``root`` with the ``.body`` beside it; no body file is an empty body."""
    stem = lambda path, end: F.regexp_replace(path, end, "")
    meta = spark.read.schema(META).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.meta.json").json(root)
    meta = meta.select("*", stem(F.col("_metadata.file_path"), r"\.meta\.json$").alias("stem"))
    body = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.body").load(root)
    # both sides name a file as a URI, which may differ in the slashes after its scheme
    body = body.select(stem(F.col("_metadata.file_path"), r"\.body$").alias("stem"), "content")
    return meta.join(body, "stem", "left").withColumn("body", F.coalesce("content", F.lit(b""))).drop("content", "stem")


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """SRC-05: one row per URL class of a profile, in declared order; what a class leaves out is the profile's, then the default.

    Columns are those of the rules of triage: position, url_class, pattern,
    min_body_bytes, canary, expected_type, json_paths and signatures; lists are joined by
    semicolons. ``canary`` and ``canaries`` of a class count together.
    """
    own = "min_body_bytes:int, canary:string, canaries:array<string>, expected_content_type:string, required_json_paths:array<string>, stop_signatures:array<string>"
    schema = f"defaults struct<{own}>, classes array<struct<name:string, match:string, {own}>>"
    found = spark.read.schema(schema).option("multiLine", True).json(path).select("defaults", F.posexplode("classes").alias("at", "c"))
    none = F.array().cast("array<string>")
    of = lambda name, otherwise: F.coalesce(f"c.{name}", f"defaults.{name}", otherwise)
    joined = lambda x: F.array_join(F.filter(x, lambda v: v.isNotNull() & (v != "")), ";")
    canaries = F.concat(F.array(of("canary", F.lit(""))), of("canaries", none))
    return found.select(
        (F.col("at") + 1).alias("position"), F.col("c.name").alias("url_class"), F.col("c.match").alias("pattern"), of("min_body_bytes", F.lit(500)).alias("min_body_bytes"), joined(canaries).alias("canary"),
        of("expected_content_type", F.lit("")).alias("expected_type"), joined(of("required_json_paths", none)).alias("json_paths"), joined(of("stop_signatures", none)).alias("signatures"),
    )


def write_snapshots(redacted: DataFrame, path: str) -> None:
    """SNK-01: redacted responses (day, verdict, body, ...) with the hash of the body, by day and verdict."""
    redacted.withColumn("body_sha256", F.sha2(F.col("body").cast("binary"), 256)).write.partitionBy("day", "verdict").mode("append").parquet(path)


def append_log(rows: DataFrame, path: str, by: str) -> None:
    """SNK-02: rows of an attempt or outcome log, added by day or session."""
    rows.write.partitionBy(by).mode("append").parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    """SNK-03: one JSON line for each row of a run's report."""
    report.write.mode("append").json(path)
