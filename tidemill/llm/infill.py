"""Fill-in-middle examples: texts cut at units and put into another order.

A text is cut into fixed blocks of bytes. Each block's numbers of ended lines and of
code points go into a Fenwick tree; the block that holds a cut is found by descending
the tree with binary lifting, and the cut itself by looking at that block alone. A text
is never split into a list of its lines, so the memory beside the text follows its
blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARKS = ("<P>", "<S>", "<M>")
#: Bytes of a block.
BLOCK = 4096
#: Texts of at most so many bytes are handed back at once (a longer text by itself).
PIECE_BYTES = 32 << 20
COLUMNS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
NEWLINE = 10


class BlockTree:
    """Prefix sums of (lines ended, code points) over the blocks of one text, as a Fenwick tree."""

    def __init__(self, data: np.ndarray, block: int = BLOCK):
        self._data, self._block = data, block
        at = np.arange(0, len(data), block)
        lines = np.add.reduceat(data == NEWLINE, at, dtype=np.int64) if len(at) else at
        points = np.add.reduceat((data & 0xC0) != 0x80, at, dtype=np.int64) if len(at) else at
        self.ended, self.points = int(lines.sum()), int(points.sum())
        self.lines = self.ended + int(len(data) > 0 and data[-1] != NEWLINE)
        self._size = len(at)
        self._tree = [(0, 0), *zip(lines.tolist(), points.tolist(), strict=True)]
        for k in range(1, self._size + 1):
            above = k + (k & -k)
            if above <= self._size:
                (a, b), (c, d) = self._tree[above], self._tree[k]
                self._tree[above] = (a + c, b + d)

    def _descend(self, lines: int) -> tuple[int, int, int]:
        """The block in which line ``lines`` ends, and the lines and code points before it."""
        at, ended, points = 0, 0, 0
        step = 1 << self._size.bit_length()
        while step:
            if at + step <= self._size and ended + self._tree[at + step][0] < lines:
                at += step
                ended, points = ended + self._tree[at][0], points + self._tree[at][1]
            step >>= 1
        return at, ended, points

    def cut(self, lines: int) -> tuple[int, int]:
        """Byte and code point after so many lines."""
        if lines <= 0:
            return 0, 0
        if lines > self.ended:
            return len(self._data), self.points
        block, ended, points = self._descend(lines)
        own = self._data[block * self._block : (block + 1) * self._block]
        end = int(np.flatnonzero(own == NEWLINE)[lines - ended - 1]) + 1
        return block * self._block + end, points + int(((own[:end] & 0xC0) != 0x80).sum())


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have at most ``PIECE_BYTES`` bytes, or one row."""
    size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size, dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + PIECE_BYTES, "right")))
        yield batch.slice(at, to - at)
        at = to


def _transform(piece: pa.RecordBatch, rate: int, spm_rate: int, block: int) -> pa.RecordBatch:
    marks = [m.encode() for m in MARKS]
    prefix_mark, suffix_mark, middle_mark = marks
    h = [piece.column(f"h{k}").to_pylist() for k in (1, 2, 3, 4)]
    rows = []
    for text, h1, h2, h3, h4 in zip(piece.column("text").cast(pa.binary()), *h, strict=True):
        raw = memoryview(text.as_buffer()) if text.is_valid else memoryview(b"")
        tree = BlockTree(np.frombuffer(raw, np.uint8), block)
        whole = bytes(raw)
        if not whole or h3 % 100 >= rate or any(m in whole for m in marks):
            rows.append((tree.lines, "plain", None, None, whole))
            continue
        first, second = sorted((h1 % (tree.lines + 1), h2 % (tree.lines + 1)))
        (a, a_points), (b, b_points) = tree.cut(first), tree.cut(second)
        prefix, middle, suffix = raw[:a], raw[a:b], raw[b:]
        if h4 % 100 < spm_rate:
            form, parts = "spm", (suffix_mark, suffix, prefix_mark, prefix, middle_mark, middle)
        else:
            form, parts = "psm", (prefix_mark, prefix, suffix_mark, suffix, middle_mark, middle)
        rows.append((tree.lines, form, a_points, b_points - a_points, b"".join(parts)))
    n, form, prefix, middle, output = zip(*rows, strict=True)
    columns = [piece.column("doc_id"), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm_rate: int = 50, block: int = BLOCK) -> DataFrame:
    """Reorder each text of ``docs`` (doc_id, text) around a middle of whole lines.

    ``rate`` of 100 texts are transformed, ``spm_rate`` of 100 of these in the order
    suffix, prefix, middle and the others in the order prefix, suffix, middle; what
    happens to a text follows from ``seed`` and its doc_id. Returns doc_id, n (lines),
    form, prefix_chars, middle_chars and output. A null or empty text, and one that
    holds a mark, stays plain; a null doc_id counts as an id without digits; repeated
    rows are each transformed alike; an empty table gives an empty result; other columns
    are not read. Nothing is shuffled.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    drawn = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _pieces(batch):
                yield _transform(piece, rate, spm_rate, block)
            pa.default_memory_pool().release_unused()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *drawn).mapInArrow(cut, COLUMNS)


def restored(form="form", output="output"):
    """The text that was transformed, from the output and its form alone."""
    parts = F.split(output, "<[PSM]>")
    part = lambda k: F.element_at(parts, k)
    return F.when(F.col(form) == "psm", F.concat(part(2), part(4), part(3))).when(F.col(form) == "spm", F.concat(part(3), part(4), part(2))).otherwise(F.col(output))


def digests(docs: DataFrame) -> DataFrame:
    """Digests of outputs and of the texts rebuilt from them, in place of both."""
    return fill_in_middle(docs).select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))


ORACLE = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS lines,
    sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
drawn AS (
  SELECT *, len(lines) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM cut),
placed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (
  SELECT doc_id, n, form, text, array_to_string(lines[1:a], '') AS prefix, array_to_string(lines[a + 1:b], '') AS middle, array_to_string(lines[b + 1:], '') AS suffix FROM placed)
SELECT doc_id, n::BIGINT AS n, form,
  CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""
