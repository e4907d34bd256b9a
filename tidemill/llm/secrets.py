"""Secret scans: fixed forms, and a guess-cost estimate for values in a credential context.

A value that follows a credential word is cut into the segments that make it cheapest
to guess: words, dates, repeats, keyboard walks, sequences, or single characters tried
by force. A dynamic program finds the cheapest cut; a value that still costs at least
``2 ** bits`` guesses is a secret. Words are those that guessers try first, and then
the commonest of all documents, by rank.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import arrow_texts, stored

ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
#: A run of at least 18 or 16 characters starts where the shorter pattern's match would.
ACCESS = re.compile("AKIA[A-Z0-9]{14,}")
HEX = re.compile("[0-9a-f]{16,}")
CONTEXT = re.compile(r"""(?i:pass(?:word|wd|phrase|code)|pwd|secret|token|credentials?|api[_-]?key|(?:access|private|client|signing)[_-]?key|auth)[\w-]{0,16}["']?(?:\x20*[:=]+\x20*|\x20+is\x20+)["']?([^\s"'<>,;]+)""")

#: Words that guessers try first, in the order in which they try them.
WORDS = "password pass admin secret token key login letmein welcome monkey dragon master qwerty abc user test root changeme example default access private public api app the and you for with love hello world sun star blue red cat dog one two four summer winter spring autumn".split()
#: Words of the documents that go to the tasks: the commonest, some 4 MB at most.
MOST_WORDS = 50_000
#: Whole words of 3 to 24 letters, in lower case.
WORD = r"(?<![\p{L}\p{N}_])\p{Ll}{3,24}(?![\p{L}\p{N}_])"
#: Ends of a sentence or bracket that are not part of a value.
TAIL = ".:?)]}\u2026"
KEYBOARD = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890", "abcdefghijklmnopqrstuvwxyz")
DATE = re.compile(r"(?:19|20)\d\d[-/.]?(?:0?[1-9]|1[0-2])[-/.]?(?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])[-/.]?(?:0?[1-9]|1[0-2])[-/.]?(?:19|20)\d\d|(?:19|20)\d\d")
LEET = str.maketrans("4301$57@", "aeoissta")


class Ranks:
    """Words by the order in which guessers try them: the fixed ones, then ``more``."""

    def __init__(self, more=()):
        self.of = {w: k + 1 for k, w in enumerate(dict.fromkeys([*WORDS, *more]))}
        self.longest = max(map(len, self.of))


FIXED = Ranks()


def common_words(docs: DataFrame, most: int = MOST_WORDS) -> list[str]:
    """The ``most`` commonest words of all texts, without values in a credential context.

    A word that stands only once is none: it may be a secret. Words that are as common as
    the first one past the bound are left out with it, so that no sort is needed and the
    driver sees no more than the bound and the distinct counts.
    """
    context = CONTEXT.pattern.replace("(?i:", "(?:", 1)
    plain = F.regexp_replace("text", f"(?i){context}", " ")
    counts = docs.select(F.explode(F.regexp_extract_all(F.lower(plain), F.lit(WORD), F.lit(0))).alias("word")).groupBy("word").count()
    counts = stored(counts.where("count > 1"))
    least, total = None, 0
    for r in sorted(counts.groupBy("count").agg(F.count("*").alias("n")).collect(), reverse=True):
        if (total := total + r.n) > most:
            break
        least = r[0]
    if least is None:
        return []
    return [r.word for r in sorted(counts.where(F.col("count") >= least).collect(), key=lambda r: (-r[1], r.word))]


def _ranks(docs: DataFrame):
    """Ranks with the words of ``docs``: a function for the tasks, which builds them once in a worker."""
    words = docs.sparkSession.sparkContext.broadcast(common_words(docs))
    key = uuid.uuid4().hex
    return lambda: _built(key, words)


_BUILT: dict[str, Ranks] = {}


def _built(key: str, words) -> Ranks:
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Ranks(words.value)
    return _BUILT[key]


def _walks(value: str, start: int) -> int:
    """End of the keyboard row or alphabet run, in either direction, that starts here."""
    end = start + 1
    for row in KEYBOARD:
        at = row.find(value[start])
        for step in (1, -1) if at >= 0 else ():
            k, p = start + 1, at + step
            while k < len(value) and 0 <= p < len(row) and value[k] == row[p]:
                k, p = k + 1, p + step
            end = max(end, k)
    return end


def _alphabet(value: str) -> int:
    sizes = ((str.isdigit, 10), (str.islower, 26), (str.isupper, 26))
    return max(10, sum(n for f, n in sizes if any(map(f, value))) + 33 * any(not c.isalnum() for c in value))


#: Repeated units are looked for up to this many characters.
LONGEST_UNIT = 8


@lru_cache(maxsize=4096)
def guess_bits(value: str, ranks: Ranks = FIXED) -> float:
    """Log2 of the guesses for the cheapest segmentation of ``value``.

    ``best[k]`` is the cheapest cost of the first k characters; a segment costs the
    guesses of its kind, and one bit for being another segment.
    """
    low, n = value.lower(), len(value)
    plain = low.translate(LEET)
    each = log2(_alphabet(value))
    best = [0.0] + [float("inf")] * n
    repeats = [(unit, _repeats(value, unit)) for unit in range(1, min(LONGEST_UNIT, n // 2) + 1)]
    followed: dict[tuple[int, int, int], int] = {}

    def reach(start: int, end: int, bits: float) -> None:
        best[end] = min(best[end], best[start] + bits + 1)

    for i in range(n):
        best[i + 1] = min(best[i + 1], best[i] + each)
        for j in range(i + 3, min(n, i + ranks.longest) + 1):
            if rank := ranks.of.get(plain[i:j]) or ranks.of.get(low[i:j]):
                upper = sum(c.isupper() for c in value[i:j])
                reach(i, j, log2(rank + 1) + (0 if not upper else 1 if upper in (1, j - i) else upper) + (plain[i:j] != low[i:j] and low[i:j] not in ranks.of))
        if m := DATE.match(value, i):
            reach(i, m.end(), log2(365 * 120 if m.end() - i > 4 else 120))
        if (end := _walks(low, i)) - i >= 3:
            for j in range(i + 3, end + 1):
                reach(i, j, log2(len(KEYBOARD) * 26 * 2 * (j - i)))
        for unit, ends in repeats:
            if (end := ends[i]) - i < max(3, 2 * unit):
                continue
            # a start further on in a repetition that has been followed already gains nothing if it costs more than the length it saves
            begun = followed.get((unit, end, i % unit))
            if begun is not None and best[i] - best[begun] >= log2((i - begun) / (2 * unit) + 1):
                continue
            followed[unit, end, i % unit] = i
            for j in range(i + 2 * unit, end + 1, unit):
                reach(i, j, unit * each + log2((j - i) // unit))
    return best[n]


def _repeats(value: str, unit: int) -> list[int]:
    """Up to where ``value`` goes on in steps of ``unit`` characters, from each place."""
    n = len(value)
    ends = [n] * n
    for i in range(n - unit - 1, -1, -1):
        ends[i] = ends[i + 1] if value[i] == value[i + unit] else i + unit
    return ends


def spans_of(text: str | None, bits: float = 45.0, least: int = 8, ranks: Ranks = FIXED) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` in code points, end exclusive, by start and then kind."""
    text = text or ""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    for m in CONTEXT.finditer(text):
        value = m[1].rstrip(TAIL)
        if len(value) >= least and guess_bits(value, ranks) >= bits:
            found.append(("guess", m.start(1), m.start(1) + len(value)))
    order = {"assign": 0, "access": 1, "hex": 2, "guess": 3}
    return sorted(found, key=lambda s: (s[1], order[s[0]], s[2]))


def _joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame, bits: float = 45.0) -> DataFrame:
    """Secrets of every whole text of ``docs`` (doc_id, text).

    Returns doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_guess. Spans are
    whole matches for the fixed forms and the value alone for ``guess``. A null or empty
    text has none; repeated rows are scanned alike; other columns are not read.
    """
    ranks = _ranks(docs)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, texts in arrow_texts(batch):
                rows = []
                for text in texts:
                    spans = spans_of(text, bits, ranks=ranks())
                    base = [s for s in spans if s[0] != "guess"]
                    kinds = [s[0] for s in spans]
                    rows.append((kinds.count("assign"), kinds.count("access"), kinds.count("hex"), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), kinds.count("guess")))
                assign, access, hexes, digest, spans, guess = zip(*rows, strict=True)
                counts = [pa.array(x, pa.int64()) for x in (assign, access, hexes)]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *counts, pa.array(digest), pa.array(spans), pa.array(guess, pa.int64())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess"])

    kinds = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scanned, kinds)


def redact(text: str | None, bits: float = 45.0, mark: str = "[SECRET]", ranks: Ranks = FIXED) -> str | None:
    """The text with every span replaced by a mark; overlapping spans are one."""
    if not text:
        return text
    out, at = [], 0
    for _, start, end in spans_of(text, bits, ranks=ranks):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, bits: float = 45.0) -> DataFrame:
    """``docs`` with secrets masked in ``text``; texts without secrets stay as they are."""
    ranks = _ranks(docs)

    def masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, texts in arrow_texts(batch):
                out = pa.array([redact(text, bits, ranks=ranks()) for text in texts], pa.string())
                yield pa.RecordBatch.from_arrays([out if name == "text" else piece.column(name) for name in piece.schema.names], names=piece.schema.names)

    return docs.mapInArrow(masked, docs.schema)
