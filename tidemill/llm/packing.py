"""Packing of tokenised documents into sequences by a configuration linear program.

The program has a variable for each way (configuration) to fill one sequence with
lengths and asks for the fewest sequences that cover the length histogram. Multiplicative
weights solve it: lengths that are still badly covered get a larger weight, a knapsack
dynamic program finds the configuration of the largest weight, and the average of the
configurations found is the fractional solution. Rounded down it places nearly all
pieces; the rest are placed by best fit. All of this works on the histogram, whose size
is the capacity; the pieces themselves stay in Spark.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import arrow_texts, checkpointed, ranked_in_group
from tidemill.llm.tokens import word_tokenizer

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces_of(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None) -> DataFrame:
    """One row per piece of at most ``capacity`` ids; only longer documents are cut."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_tokenizer(tokenizer).encode
        for batch in batches:
            for piece, texts in arrow_texts(batch, 400):
                row, rows = [], []
                for n, ids in enumerate(encode(texts)):
                    ids += b"\0\0\0\0"
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        row.append(n)
                        rows.append((k, at // 4, len(part) // 4, zlib.crc32(part)))
                k, start, length, crc = zip(*rows, strict=True)
                columns = [piece.column("doc_id").take(pa.array(row)), pa.array(k, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def _knapsack(weight: np.ndarray, lengths: np.ndarray, capacity: int) -> dict[int, int]:
    """The multiset of lengths that fits the capacity and has the largest weight."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(int(lengths[0]), capacity + 1):
        upto = np.searchsorted(lengths, c, "right")
        value = best[c - lengths[:upto]] + weight[:upto]
        k = int(value.argmax())
        best[c], pick[c] = value[k], k
    config: dict[int, int] = {}
    c = capacity
    while c >= lengths[0] and pick[c] >= 0:
        k = int(pick[c])
        config[k] = config.get(k, 0) + 1
        c -= int(lengths[k])
    return config


def _fractional(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int, step: float) -> dict[tuple, float]:
    """Configurations and how often to use each, by multiplicative weights."""
    weight, used = np.ones(len(lengths)), {}
    covered = np.zeros(len(lengths))
    for _ in range(rounds):
        config = _knapsack(weight / counts, lengths, capacity)
        key = tuple(sorted(config.items()))
        rows = np.fromiter(config, int)
        gain = np.fromiter(config.values(), float) / counts[rows]
        # as often as covers a share `step` of the length that it covers best
        times = step / gain.max()
        used[key] = used.get(key, 0.0) + times
        covered[rows] += gain * times
        weight[rows] *= np.exp(-gain * times)
        weight /= weight.max()
    scale = max(covered.min(), covered.mean() / 2)
    return {k: v / scale for k, v in used.items()}


def _best_fit(lengths: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Fill sequences from the longest piece left, each time with the longest that fits.

    A filling is used as many times as the pieces left allow, so the steps follow the
    number of lengths and not the number of pieces.
    """
    plan, left = [], left.copy()
    while left.any():
        room, config = capacity, {}
        k = len(lengths) - 1
        while k >= 0:
            k = min(k, int(np.searchsorted(lengths, room, "right")) - 1)
            while k >= 0 and left[k] == 0:
                k -= 1
            if k < 0:
                break
            fit = int(min(left[k], room // lengths[k]))
            if fit:
                config[k] = fit
                room -= fit * int(lengths[k])
            k -= 1
        times = int(min(left[k] // n for k, n in config.items()))
        for k, n in config.items():
            left[k] -= times * n
        plan.append((config, times))
    return plan


def plan_sequences(histogram: dict[int, int], capacity: int = 2048, rounds: int = 400, step: float = 0.05) -> list[tuple[dict[int, int], int]]:
    """``(lengths of one sequence, how many such sequences)`` that place every piece once."""
    if not histogram:
        return []
    full = histogram.get(capacity, 0)
    lengths = np.array(sorted(x for x in histogram if x != capacity), np.int64)
    plan = [({capacity: 1}, full)] if full else []
    if not len(lengths):
        return plan
    counts = np.array([histogram[int(x)] for x in lengths], np.int64)
    left = counts.copy()
    found = _fractional(lengths, counts.astype(float), capacity, rounds, step)
    for key, times in sorted(found.items(), key=lambda x: -x[1]):
        whole = min([int(times), *(int(left[k] // n) for k, n in key)])
        if whole > 0:
            for k, n in key:
                left[k] -= whole * n
            plan.append(({int(lengths[k]): n for k, n in key}, whole))
    plan += [({int(lengths[k]): n for k, n in c.items()}, t) for c, t in _best_fit(lengths, left, capacity)]
    return plan


def pack(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None) -> DataFrame:
    """Place every piece of ``docs`` (doc_id, text) into a sequence of at most ``capacity`` ids.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null or
    empty text is one piece that holds id 0 only. Repeated rows and null ids are
    packed one by one; ties between pieces of one length go by (doc_id, piece); an
    empty table gives an empty result; other columns are not read.
    """
    pieces = checkpointed(pieces_of(docs, capacity, tokenizer).withColumn("_t", F.monotonically_increasing_id()))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    first = 0
    for config, times in plan_sequences(histogram, capacity):
        offset = 0
        for length in sorted(config, reverse=True):
            slots.setdefault(length, []).append((config[length], times, first, offset))
            offset += length * config[length]
        first += times
    by_length = {}
    for length, rows in slots.items():
        a = np.array(rows, np.int64)
        by_length[length] = (np.concatenate([[0], np.cumsum(a[:, 0] * a[:, 1])]), *a.T)

    @F.pandas_udf("struct<sequence_id long, offset long>")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(length), 2), np.int64)
        length, rank = length.to_numpy(), rank.to_numpy()
        order = np.argsort(length, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
            n = int(length[rows[0]])
            begins, copies, _, base, offset = by_length[n]
            k = np.searchsorted(begins, rank[rows], "right") - 1
            within = rank[rows] - begins[k]
            out[rows, 0] = base[k] + within // copies[k]
            out[rows, 1] = offset[k] + within % copies[k] * n
        return pd.DataFrame(out, columns=["sequence_id", "offset"])

    ranked = ranked_in_group(pieces, "length", F.struct("doc_id", "piece", "_t"), "_rank")
    return ranked.withColumn("_p", place("length", "_rank")).select("doc_id", "piece", "start", "length", "ids_crc32", "_p.sequence_id", "_p.offset")
