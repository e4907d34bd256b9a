"""Name → query and name → oracle SQL for the collection engine."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from tidemill.operators import json_paths, load
from tidemill.operators.base import DUCK, OPERATORS
from tidemill.plans import page_queries, stream_queries
from tidemill.plans.fixtures import BASES, FIXTURES

load()


def _table(spark: SparkSession, sf_dir: str, name: str, known: dict[str, DataFrame]) -> DataFrame:
    """A base table, a derived fixture, or another operator's result."""
    if name not in known:
        if name in OPERATORS:
            op = OPERATORS[name]
            known[name] = op(spark, **{n: _table(spark, sf_dir, n, known) for n in op.inputs})
        elif name in FIXTURES:
            sql = FIXTURES[name]
            for base in BASES:
                if re.search(rf"\b(FROM|JOIN) {base}\b", sql):
                    view = f"_{base}_base"
                    spark.read.parquet(f"{sf_dir}/{base}.parquet").createOrReplaceTempView(view)
                    sql = re.sub(rf"\b(FROM|JOIN) {base}\b", rf"\1 {view}", sql)
            known[name] = spark.sql(sql)
        else:
            known[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return known[name]


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, name, {})


def _oracle(name: str) -> str:
    """One WITH per input, innermost first."""
    ctes: dict[str, str] = {}

    def need(n: str) -> None:
        if n in ctes or n not in OPERATORS and n not in FIXTURES:
            return
        if n in OPERATORS:
            for i in OPERATORS[n].inputs:
                need(i)
            ctes[n] = re.sub(r"@(\w+)", r"\1", OPERATORS[n].text(DUCK))
        else:
            ctes[n] = FIXTURES[n]

    need(name)
    last = ctes.pop(name)
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({s})" for n, s in ctes.items()) + f"\nSELECT * FROM ({last}) result" if ctes else last


def _records(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    rows = _table(spark, sf_dir, "records", {}).where(f"side = '{side}'")
    return json_paths.json_leaf_paths(rows, "data", "natural_key")


def json_leaf_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return json_paths.json_leaf_paths(_table(spark, sf_dir, "observed_requests", {}), "body", "req_id")


def schema_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return json_paths.schema_signatures(_table(spark, sf_dir, "observed_requests", {}), "body", "req_id")


def locate_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.sql("SELECT explode(array('nChars', 'lang', 'k')) AS field")
    return json_paths.locate_fields(_records(spark, sf_dir, "clean"), wanted)


def lost_json_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return json_paths.lost_json_paths(_records(spark, sf_dir, "clean"), _records(spark, sf_dir, "staging"), "natural_key")


#: Queries that no SQL of the oracle expresses; tests hold them against known values.
PLAIN = {f.__name__: f for f in (json_leaf_paths, schema_signatures, locate_fields, lost_json_paths)}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: partial(run, name) for name in OPERATORS} | PLAIN | page_queries.QUERIES | stream_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return {name: _oracle(name) for name in OPERATORS} | page_queries.ORACLE_SQL | stream_queries.oracle_sql(_oracle)
