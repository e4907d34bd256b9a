"""Repair of the turn structure of conversations by a run-length dynamic program.

A conversation is in order when its roles read: nothing, or a system turn if any and then
user and assistant in turns. Four states say how far a reading has come. What one row may
become is a min-plus matrix over the states, and equal rows in a row (a run) are one
power of that matrix, built from cached binary powers. The cheapest repair is found from
the last run to the first; its choices are unrolled by halving each run, from its start
state, so the memory follows the runs. Texts are no part of this: they are only read
once more, as a stream, to be written in their new order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: States: nothing read, system read, user read, assistant read.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after the one role that an insertion or a change may give in a state.
GIVEN = (USER, USER, ASSISTANT, USER)
#: Row symbols: class of the role's initial times two, plus one if truncated; or one to be deleted.
CLASSES = "sua"
OTHER, DELETED = len(CLASSES), 8
KEPT = ({START: SYSTEM}, {START: USER, SYSTEM: USER, ASSISTANT: USER}, {USER: ASSISTANT}, {})
DELETE, INSERT, REROLE = 3, 2, 2
NEVER = 1 << 40
#: Cost of ending in each state: what is missing is inserted.
ENDS = (0, 2 * INSERT, INSERT, 0)
AUDITS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
ROWS = "conv_id long, position long, role string, text string"
SPACE = r"\x20\x09-\x0D"


@lru_cache(maxsize=4096)
def _power(symbol: int, bit: int) -> np.ndarray:
    """Cheapest ways from state to state over 2 ** bit rows of one symbol."""
    if bit:
        half = _power(symbol, bit - 1)
        return (half[:, :, None] + half[None, :, :]).min(1)
    one = np.full((4, 4), NEVER, np.int64)
    for state in range(4):
        one[state, state] = DELETE
        if symbol != DELETED:
            truncated = symbol % 2
            one[state, GIVEN[state]] = min(one[state, GIVEN[state]], REROLE + truncated)
            if state in KEPT[symbol // 2]:
                to = KEPT[symbol // 2][state]
                one[state, to] = min(one[state, to], truncated)
    insert = np.full((4, 4), NEVER, np.int64)
    for state in range(4):
        insert[state, state], insert[state, GIVEN[state]] = 0, INSERT
    inserts = (insert[:, :, None] + insert[None, :, :]).min(1)
    return (inserts[:, :, None] + one[None, :, :]).min(1)


def _before(symbol: int, rows: int, after: np.ndarray) -> np.ndarray:
    """Costs to the end before ``rows`` rows of a symbol, from those after them."""
    bit = 0
    while rows:
        if rows & 1:
            after = (_power(symbol, bit) + after).min(1)
        rows, bit = rows >> 1, bit + 1
    return after


def _step(symbol: int, state: int, after: np.ndarray, audit: list[str]) -> int:
    """Choose the edits of one row, the smallest letters among the cheapest, and say which state follows."""
    here = (_power(symbol, 0) + after).min(1)
    while True:
        if here[state] == DELETE + after[state]:
            audit.append("D")
            return state
        if here[state] == INSERT + here[GIVEN[state]]:
            audit.append("I")
            state = GIVEN[state]
            continue
        to = KEPT[symbol // 2].get(state)
        if to is not None and here[state] == symbol % 2 + after[to]:
            audit.append("K")
            return to
        audit.append("R")
        return GIVEN[state]


def _unroll(symbol: int, rows: int, state: int, after: np.ndarray, audit: list[str]) -> int:
    if rows == 1:
        return _step(symbol, state, after, audit)
    late = rows // 2
    state = _unroll(symbol, rows - late, state, _before(symbol, late, after), audit)
    return _unroll(symbol, late, state, after, audit)


@lru_cache(maxsize=20_000)
def repair_runs(runs: tuple[tuple[int, int], ...]) -> tuple[int, str]:
    """Cost and audit of the cheapest repair of a conversation given as runs (symbol, rows).

    Of the cheapest repairs the one whose audit comes first in ASCII order is taken.
    """
    after = [np.array(ENDS, np.int64)]
    for symbol, rows in reversed(runs):
        after.append(_before(symbol, rows, after[-1]))
    audit: list[str] = []
    state = START
    for k, (symbol, rows) in enumerate(runs):
        state = _unroll(symbol, rows, state, after[len(runs) - 1 - k], audit)
    audit.append("I" * (ENDS[state] // INSERT))
    return int(after[-1][START]), "".join(audit)


def damaged(conversations: DataFrame, kinds: int = 20) -> DataFrame:
    """Conversations (conv_id, turn, role, text) with faults put in by a checksum of conv_id and turn.

    Of ``kinds`` remainders, 0 drops the row, 1 empties its text, 2 removes marks that end
    sentences, 3 repeats it and 4 sets the role user. A null counts as one space.
    """
    written = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    fault = F.crc32(F.concat_ws(":", *written[:2])) % kinds
    role = F.when(fault == 4, F.lit("user")).otherwise(written[2])
    text = F.when(fault == 1, F.lit("")).when(fault == 2, F.translate(written[3], ".!?", "")).otherwise(written[3])
    copies = F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), copies.alias("_n"))
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.col("_n").cast("int"))).alias("_copy")).drop("_copy")


def _plain(rows: DataFrame) -> DataFrame:
    """The four columns with nulls as one space, and the digest that orders rows of one turn and role."""
    text = F.coalesce("text", F.lit(" "))
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"))


class _Conversation:
    """Counts and runs of one conversation whose rows pass by in order."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.runs: list[list[int]] = []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.last_class = None

    def _run(self, symbol: int, rows: int) -> None:
        if self.runs and self.runs[-1][0] == symbol:
            self.runs[-1][1] += rows
        else:
            self.runs.append([symbol, rows])

    def add(self, turn: int | None, kind: int, n: int, blank: bool, seen: bool, truncated: bool) -> None:
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        if self.last_class is not None:
            self.illegal += (self.last_class, kind) not in ((0, 1), (1, 2), (2, 1))
        self.illegal += n - 1
        self.last_class = kind
        if blank:
            self.blank += n
            self._run(DELETED, n)
            return
        if not seen:
            self.truncated += truncated
            self._run(2 * kind + truncated, 1)
            n -= 1
        self.duplicate += n
        if n:
            self._run(DELETED, n)

    def row(self) -> tuple:
        cost, audit = repair_runs(tuple(map(tuple, self.runs)))
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit


def _batch(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def _audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, types = [c.split()[0] for c in AUDITS.split(", ")], [pa.int64()] * 7 + [pa.string()]
    now = None
    for batch in batches:
        done = []
        for conv_id, turn, kind, n, blank, seen, truncated in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    done.append(now.row())
                now = _Conversation(conv_id)
            now.add(turn, kind, n, blank, seen, truncated)
        yield _batch(done, names, types)
    if now is not None:
        yield _batch([now.row()], names, types)


def audits(rows: DataFrame) -> DataFrame:
    """Faults, cost and audit of the cheapest repair of each conversation in ``rows``.

    ``rows`` has conv_id, turn, role and text; nulls of role and text count as one space,
    a null conv_id is a conversation, null turns come first. Rows of one turn follow each
    other by role and by the digest of their text. The faults of a row are blank (it has no
    visible character), duplicate (role and text came before in the conversation) and
    truncated (it does not end a sentence); the first one counts. Repeated rows meet as one
    row with a count, before the shuffle where they can. Texts are not shuffled; what meets
    in one task for a conversation are some bytes a row, as its audit, a single value, has
    to. An empty table gives an empty result, other columns are not read.
    """
    found = F.instr(F.lit(CLASSES), F.substring("role", 1, 1))
    kind = F.when((F.length("role") > 0) & (found > 0), found - 1).otherwise(OTHER).cast("int")
    blank = ~F.col("text").rlike(f"[^{SPACE}]")
    truncated = ~F.col("text").rlike(rf"[.!?][{SPACE}]*\z")
    light = _plain(rows).select("conv_id", "turn", "role", "digest", kind.alias("kind"), blank.alias("blank"), truncated.alias("truncated"))
    counted = light.groupBy("conv_id", "turn", "role", "digest").agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("kind", "blank", "truncated")))
    same = Window.partitionBy("conv_id", "role", "digest").orderBy("turn")
    flagged = counted.repartition("conv_id").withColumn("seen", F.row_number().over(same) > 1)
    ordered = flagged.sortWithinPartitions("conv_id", "turn", "role", "digest")
    return ordered.select("conv_id", "turn", "kind", "n", "blank", "seen", "truncated").mapInArrow(_audited, AUDITS)


class _Editor:
    """Applies an audit to the rows of its conversation as they pass by."""

    def __init__(self, conv_id, audit: str):
        self.conv_id, self._audit, self._at, self._state = conv_id, audit, 0, START

    def _given(self) -> str:
        self._state = GIVEN[self._state]
        return "user" if self._state == USER else "assistant"

    def _inserts(self) -> Iterator[tuple[str, str]]:
        while self._at < len(self._audit) and self._audit[self._at] == "I":
            self._at += 1
            yield self._given(), ""

    def row(self, role: str, text: str, n: int) -> Iterator[tuple[str, str]]:
        for _ in range(n):
            yield from self._inserts()
            edit = self._audit[self._at]
            self._at += 1
            if edit == "K":
                self._state = KEPT[CLASSES.index(role[0])][self._state]
                yield role, text
            elif edit == "R":
                yield self._given(), text

    def rest(self) -> Iterator[tuple[str, str]]:
        return self._inserts()


def _edited(rows: DataFrame, audited: DataFrame) -> DataFrame:
    """Each conversation's audit and then its rows in order, in the task that edits it."""
    counted = _plain(rows).groupBy("conv_id", "turn", "role", "text", "digest").agg(F.count("*").alias("n"))
    own = counted.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "digest", "text", "n")
    heads = audited.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit(None).cast("binary").alias("digest"), F.col("audit").alias("text"), F.lit(0).cast("long").alias("n"))
    both = own.unionByName(heads).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "digest")
    return both.select("conv_id", "kind", "role", "text", "n")


def _events(batch: pa.RecordBatch, editor: _Editor | None) -> Iterator[tuple[_Editor, str | None, str | None]]:
    """(editor, role, text) of the repaired rows; a new conversation starts with (editor, None, None)."""
    for conv_id, kind, role, text, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        if not kind:
            if editor is not None:
                for r, t in editor.rest():
                    yield editor, r, t
            editor = _Editor(conv_id, text)
            yield editor, None, None
        else:
            for r, t in editor.row(role, text, n):
                yield editor, r, t


def repaired(rows: DataFrame, audited: DataFrame) -> DataFrame:
    """The rows of all repaired conversations: conv_id, position, role, text."""
    names, types = [c.split()[0] for c in ROWS.split(", ")], [pa.int64(), pa.int64(), pa.string(), pa.string()]

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        editor, position = None, 0
        for batch in batches:
            out = []
            for editor, role, text in _events(batch, editor):
                if role is None:
                    position = 0
                else:
                    out.append((editor.conv_id, position, role, text))
                    position += 1
            yield _batch(out, names, types)
        if editor is not None:
            yield _batch([(editor.conv_id, position + k, r, t) for k, (r, t) in enumerate(editor.rest())], names, types)

    return _edited(rows, audited).mapInArrow(edit, ROWS)


def repaired_digests(rows: DataFrame, audited: DataFrame) -> DataFrame:
    """conv_id and the digest of each repaired conversation's ``role:text``, joined by newlines, made as the rows pass by."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        editor, sha, lines = None, None, 0
        for batch in batches:
            done, last = [], editor
            for editor, role, text in _events(batch, editor):
                if role is None:
                    if last is not None:
                        done.append((last.conv_id, sha.hexdigest()))
                    last, sha, lines = editor, hashlib.sha256(), 0
                    continue
                sha.update(f"{'\n' if lines else ''}{role}:{text}".encode())
                lines += 1
            yield _batch(done, ["conv_id", "repaired_sha256"], [pa.int64(), pa.string()])
        if editor is not None:
            for role, text in editor.rest():
                sha.update(f"{'\n' if lines else ''}{role}:{text}".encode())
                lines += 1
            yield _batch([(editor.conv_id, sha.hexdigest())], ["conv_id", "repaired_sha256"], [pa.int64(), pa.string()])

    return _edited(rows, audited).mapInArrow(digest, "conv_id long, repaired_sha256 string")


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """Damage all conversations and repair them; a row for each conv_id, also where no row is left after the damage."""
    rows = damaged(conversations)
    audited = audits(rows)
    digests = repaired_digests(rows, audited)
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    # all three have one row a conversation, and none is near the size of the texts
    empty = {c: F.lit(0).cast("long") for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    empty |= {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(""), 256)}
    joined = every.alias("e")
    for name, other in (("a", audited), ("d", digests)):
        joined = joined.join(other.alias(name), F.col("e.conv_id").eqNullSafe(F.col(f"{name}.conv_id")), "left")
    return joined.select("e.conv_id", *(F.coalesce(c, otherwise).alias(c) for c, otherwise in empty.items()))


ORACLE = r"""
WITH RECURSIVE bits AS (
  SELECT i, i::UBIGINT AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS tab FROM bits WHERE k = 8),
src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::UBIGINT) AS key FROM conversations),
summed AS (
  SELECT src.*, xor(list_reduce(list_prepend(4294967295::UBIGINT, key), lambda c, b: xor(c >> 8, tab[((xor(c, b) & 255) + 1)::BIGINT])), 4294967295::UBIGINT) % 20 AS f FROM src, crc),
dam AS (
  SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE WHEN f = 1 THEN '' WHEN f = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM summed, range(2) t(k) WHERE f <> 0 AND (k = 0 OR f = 3)),
numbered AS (
  SELECT *, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS g, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM dam),
seen AS (SELECT *, row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 AS dup, lag(role[1]) OVER (PARTITION BY g ORDER BY i) || role[1] AS pair FROM numbered),
flags AS (
  SELECT g, conv_id, turn, role, text, i, pair, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, NOT blank AND dup AS dupl,
    NOT blank AND NOT dup AND NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS trunc FROM seen),
counts AS (
  SELECT g, any_value(conv_id) AS conv_id, max(i) AS m, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(blank::INT) AS blank, sum(dupl::INT) AS duplicate,
    sum(trunc::INT) AS truncated, sum((pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au'))::INT) AS illegal FROM flags GROUP BY g),
best AS (
  SELECT g, m AS i, {'c': 0, 'a': '', 'r': ''} AS s0, {'c': 4, 'a': 'II', 'r': E'user:\nassistant:\n'} AS s1, {'c': 2, 'a': 'I', 'r': E'assistant:\n'} AS s2, {'c': 0, 'a': '', 'r': ''} AS s3 FROM counts
  UNION ALL
  SELECT g, i, least(w0, {'c': 2 + w2.c, 'a': 'I' || w2.a, 'r': E'user:\n' || w2.r}, {'c': 4 + w3.c, 'a': 'II' || w3.a, 'r': E'user:\nassistant:\n' || w3.r}),
    least(w1, {'c': 2 + w2.c, 'a': 'I' || w2.a, 'r': E'user:\n' || w2.r}, {'c': 4 + w3.c, 'a': 'II' || w3.a, 'r': E'user:\nassistant:\n' || w3.r}),
    least(w2, {'c': 2 + w3.c, 'a': 'I' || w3.a, 'r': E'assistant:\n' || w3.r}), least(w3, {'c': 2 + w2.c, 'a': 'I' || w2.a, 'r': E'user:\n' || w2.r})
  FROM (
    SELECT g, i,
      least({'c': 3 + s0.c, 'a': 'D' || s0.a, 'r': s0.r}, {'c': ks + s1.c, 'a': 'K' || s1.a, 'r': line || s1.r}, {'c': ku + s2.c, 'a': 'K' || s2.a, 'r': line || s2.r}, {'c': re + s2.c, 'a': 'R' || s2.a, 'r': 'user:' || body || s2.r}) AS w0,
      least({'c': 3 + s1.c, 'a': 'D' || s1.a, 'r': s1.r}, {'c': ku + s2.c, 'a': 'K' || s2.a, 'r': line || s2.r}, {'c': re + s2.c, 'a': 'R' || s2.a, 'r': 'user:' || body || s2.r}) AS w1,
      least({'c': 3 + s2.c, 'a': 'D' || s2.a, 'r': s2.r}, {'c': ka + s3.c, 'a': 'K' || s3.a, 'r': line || s3.r}, {'c': re + s3.c, 'a': 'R' || s3.a, 'r': 'assistant:' || body || s3.r}) AS w2,
      least({'c': 3 + s3.c, 'a': 'D' || s3.a, 'r': s3.r}, {'c': ku + s2.c, 'a': 'K' || s2.a, 'r': line || s2.r}, {'c': re + s2.c, 'a': 'R' || s2.a, 'r': 'user:' || body || s2.r}) AS w3
    FROM (
      SELECT b.g, b.i - 1 AS i, s0, s1, s2, s3, role || ':' || text || E'\n' AS line, text || E'\n' AS body, CASE WHEN blank OR dupl THEN 1000000 ELSE trunc::INT END AS t,
        CASE WHEN role[1] = 's' THEN t ELSE 1000000 END AS ks, CASE WHEN role[1] = 'u' THEN t ELSE 1000000 END AS ku, CASE WHEN role[1] = 'a' THEN t ELSE 1000000 END AS ka, 2 + t AS re
      FROM best b JOIN flags f ON f.g = b.g AND f.i = b.i))),
done AS (SELECT c.*, s0.c AS cost, s0.a AS audit, sha256(left(s0.r, greatest(length(s0.r) - 1, 0))) AS sha FROM counts c JOIN best b ON b.g = c.g AND b.i = 0)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) e LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM e.conv_id
"""
