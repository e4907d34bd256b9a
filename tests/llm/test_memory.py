"""What executors hold: a Python worker to a task, and none for the driver's small tables."""

import re

import numpy as np

import corpus_pipeline
from tidemill.llm import secrets, suffix_dedup
from tidemill.llm.common import small_table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PYTHON = "ArrowEvalPython|MapInArrow|MapInPandas|FlatMap(?:Co)?Groups\\w+"


def most_workers(df) -> int:
    """Most Python functions that a row passes between two shuffles, by the indents of the plan."""
    most, path = 0, []
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        if "Initial Plan" in line:
            break
        depth = len(re.match(r"[\s:+*|-]*", line)[0])
        path = [x for x in path if x[0] < depth]
        above = path[-1][1] if path else 0
        path.append((depth, 0 if "Exchange" in line else above + bool(re.search(PYTHON, line))))
        most = max(most, path[-1][1])
    return most


def texts(spark):
    rng = np.random.default_rng(8)
    part = "".join(rng.choice(list("abcdef "), 300))
    rows = [(k, f"{k} " + "".join(rng.choice(list("ghijkl "), 200)) + (part[k : k + 150] if k % 2 else ""), "en", "s", 10) for k in range(12)]
    return spark.createDataFrame([*rows, (50, rows[3][1], "en", "s", 10), (3, "again", "en", "t", 5), (None, part, "en", None, 1)], SCHEMA)


def test_small_tables_need_no_worker(spark):
    schema = "k int, name string, turns array<struct<gap double, row long>>"
    rows = [(1, "a", [{"gap": 0.5, "row": 2**60 + 1}]), (2, None, [])]
    df = small_table(spark, rows, schema)
    assert "LocalRelation" in df._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.k, r["name"], [t.asDict() for t in r.turns]) for r in df.collect()] == rows
    assert small_table(spark, [], schema).collect() == []


def test_texts_pass_one_worker(spark):
    docs = texts(spark)
    assert most_workers(suffix_dedup.remove_repeats(docs)) == 1
    assert most_workers(corpus_pipeline.drop_near_copies(spark, docs, "")) == 1


def test_masked_pieces_keep_the_columns(spark):
    rows = [(k if k % 3 else None, f"text {k}" if k % 5 else None, None, "s", k) for k in range(1203)] + [(2**60 + 1, "password = hunter2hunter2x9", "en", "s", 3)]
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    masked = secrets.redacted(docs)
    # batches of rows do not wait for their texts
    assert "ArrowEvalPython" not in masked._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in masked.collect()] == rows[:-1] + [(2**60 + 1, "[SECRET]", "en", "s", 3)]
