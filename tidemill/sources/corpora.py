"""SRC-06: corpora as tables: calibration targets, and acceptance cases with what excuses them.

A manifest is one nested JSON file. Every entry becomes a row: what it leaves out gets its
default, and what is wrong with it is named in ``error`` beside its place, so that a typo
shows and does not turn a probe into another test. A file that is no JSON is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds of targets, of contents and of cases; those that prove a profile can say no.
TARGET_KINDS = ("ssr_html", "csr_shell", "hard_block", "dead_url", "json_endpoint", "listing", "large_html", "cross_origin_data")
CONTENT_KINDS = ("HTML", "JSON", "TEXT", "BINARY", "UNKNOWN")
CASE_KINDS = ("normal", "different_entity", "new_page", "old_page", "pagination", "empty_result", "not_found", "redirect", "large_response", "layout_variant", "csr_variant")
NEGATIVE_KINDS = ("empty_result", "not_found", "layout_variant")


def _manifests(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """One row a file, with its path and, if it is broken, its text in ``_broken``."""
    reader = spark.read.schema(f"{columns}, _broken string").option("multiLine", True).option("columnNameOfCorruptRecord", "_broken")
    return reader.json(path).select(F.col("_metadata.file_path").alias("file"), "*")


def _entries(manifests: DataFrame, column: str) -> DataFrame:
    """The entries of a list with their places from 1; a file without the list is one row without an entry."""
    return manifests.select("*", F.posexplode_outer(column).alias("_at", "_entry")).withColumn("place", F.col("_at") + 1)


def _text(name: str, otherwise: str | None) -> Column:
    value = F.try_variant_get("_entry", f"$.{name}", "string")
    return value if otherwise is None else F.coalesce(value, F.lit(otherwise))


def _number(name: str, otherwise: int | None) -> Column:
    return F.coalesce(F.try_variant_get("_entry", f"$.{name}", "int"), F.lit(otherwise).cast("int"))


def _texts(name: str) -> Column:
    return F.coalesce(F.try_variant_get("_entry", f"$.{name}", "array<string>"), F.array().cast("array<string>"))


def _first_of(*tests: tuple[Column, Column | str]) -> Column:
    """The message of the first test that holds; null if none does."""
    return F.coalesce(*[F.when(test, message) for test, message in tests])


def _wrong_number(name: str) -> Column:
    there = F.try_variant_get("_entry", f"$.{name}", "variant")
    return there.isNotNull() & ~F.is_variant_null(there) & F.try_variant_get("_entry", f"$.{name}", "int").isNull()


def load_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Calibration targets of the manifests at ``path``, with ``error`` (null: none)."""
    rows = _entries(_manifests(spark, path, "name string, description string, targets array<variant>"), "targets")
    is_map = F.schema_of_variant("_entry").startswith("OBJECT")
    url, kind, content = _text("url", ""), _text("kind", "ssr_html"), F.upper(_text("expected.content_kind", "HTML"))
    error = _first_of(
        (F.col("_broken").isNotNull(), F.lit("the file is no JSON")), (F.col("targets").isNull(), F.lit("the manifest needs a list of targets")), (F.col("_entry").isNotNull() & ~is_map, F.lit("the target is no mapping")),
        (F.col("_entry").isNotNull() & (url == ""), F.lit("the target has no url")), (~kind.isin(*TARGET_KINDS), F.concat(F.lit("unknown kind "), kind)), (~content.isin(*CONTENT_KINDS), F.concat(F.lit("unknown content kind "), content)),
        (_wrong_number("expected.target_status") | _wrong_number("expected.min_body_bytes"), F.lit("a number is expected")),
    )
    rows = rows.where("_entry is not null or targets is null")
    return rows.select(
        "file", F.coalesce("name", F.lit("corpus")).alias("corpus"), "place", url.alias("url"), F.coalesce(F.nullif(_text("domain", ""), F.lit("")), F.regexp_extract(url, "^[A-Za-z]+://([^/?#]*)", 1)).alias("domain"), _text("url_class", "page").alias("url_class"), kind.alias("kind"), content.alias("content_kind"),
        _number("expected.target_status", 200).alias("target_status"), _number("expected.min_body_bytes", 500).alias("min_body_bytes"), _texts("expected.canaries").alias("canaries"), _texts("expected.json_paths").alias("json_paths"), _texts("expected.critical_fields").alias("critical_fields"), _text("notes", "").alias("notes"), error.alias("error"),
    )


def load_cases(spark: SparkSession, path: str) -> DataFrame:
    """Acceptance cases of the manifests at ``path``, in the columns of ``run_acceptance_cases``, with ``error``."""
    rows = _entries(_manifests(spark, path, "domain string, cases array<variant>"), "cases")
    is_map, kind = F.schema_of_variant("_entry").startswith("OBJECT"), _text("kind", "normal")
    error = _first_of(
        (F.col("_broken").isNotNull(), F.lit("the file is no JSON")), (F.col("cases").isNull(), F.lit("the corpus needs a list of cases")), (F.col("_entry").isNotNull() & ~is_map, F.lit("the case is no mapping")),
        (~kind.isin(*CASE_KINDS), F.concat(F.lit("unknown kind "), kind)), (_wrong_number("expect_min_records"), F.lit("a number is expected")),
    )
    rows = rows.where("_entry is not null or cases is null")
    return rows.select(
        "file", F.coalesce("domain", F.lit("")).alias("domain"), "place", _text("id", "").alias("case_id"), _text("url_class", "").alias("url_class"), kind.alias("kind"), kind.isin(*NEGATIVE_KINDS).alias("negative"), _text("fixture", "").alias("fixture"), _text("url", "").alias("url"),
        _text("expect_verdict", "OK").alias("verdict"), _texts("expect_fields").alias("expected"), _texts("expect_absent_fields").alias("forbidden"), _number("expect_min_records", None).alias("least_records"), _text("notes", "").alias("notes"), error.alias("error"),
    )


def load_excuses(spark: SparkSession, path: str) -> DataFrame:
    """What the corpora at ``path`` call not applicable: domain, url_class, kind and the reason."""
    rows = _entries(_manifests(spark, path, "domain string, not_applicable array<variant>"), "not_applicable").where("_entry is not null")
    return rows.select(F.coalesce("domain", F.lit("")).alias("domain"), _text("url_class", "").alias("url_class"), _text("kind", "normal").alias("kind"), _text("reason", "").alias("reason"), F.when(~_text("kind", "normal").isin(*CASE_KINDS), "unknown kind").alias("error"))
