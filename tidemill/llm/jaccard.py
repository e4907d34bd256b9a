"""Similarity join of shingle sets by vertical partitioning.

Shingles have one global order (of their hashes), which is cut into fragments at the
same places for all sets of comparable size. Overlaps are partial: in each fragment the
sets that agree on it have its size in common, these partial overlaps are summed per
pair, and the fragments are so many that two sets over the threshold agree on one. The
pair with the largest sum is settled first: its tokens are counted in wide fragments
separately and summed. Before that a first fragment of each set drops the sets that
have too few tokens in it that any other set has.

Equal sets are one class from the start. In a round each set is compared with one other
set at most, the best among those that this round's hash puts first in its fragments;
later rounds compare only sets that are still in different components, so a group of
copies is never expanded into its pairs. Before all that are still apart meet, they meet
some chosen sets of their fragments, and one pair for each two components is compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, exp, floor, log, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm.common import Scratch, arrow_texts, ids_within
from tidemill.llm.components import components

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
A, B, C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
#: Ratio of the largest to the smallest set in one size band.
BAND = 1.4
#: Orders that are tried for a set with many empty fragments.
ORDERS = 8
#: Wide fragments in which overlaps are counted.
WIDE_BITS = 2
#: Numbers of 64 bits in the smallest parity bitmap, for sets of up to 1024 shingles.
PARITY_LONGS = 8


def mixed(x: np.ndarray) -> np.ndarray:
    """Each 64-bit number scrambled."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int = 3) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams of a whole text."""
    return digested(text, width)[0]


def digested(text: str | None, width: int = 3) -> tuple[np.ndarray, int, int]:
    """``(shingles, two halves of a digest)``; equal sets have equal digests of 128 bits."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64), 0, 0
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(width, len(words))
    total = np.full(len(h) - width + 1, np.uint64(width))
    for k in range(width):
        total = mixed(total * A + h[k : len(h) - width + 1 + k] * B + C)
    tokens = np.unique(total)
    # a set of one shingle is known by its words
    whole = xxhash.xxh3_128_intdigest(b" ".join(words[:width]) if len(tokens) == 1 else tokens.tobytes())
    signed = np.array([whole >> 64, whole & (1 << 64) - 1], np.uint64).view(np.int64)
    return tokens, int(signed[0]), int(signed[1])


def _parts(hi: int, percent: int) -> tuple[int, int]:
    """``(fragments, spare ones)`` for sets of up to ``hi`` shingles; none if only equal sets link.

    Two such sets over the threshold t differ in at most 2 hi (1 - t) / (1 + t) shingles.
    With one fragment more than that and some spare ones they agree on more fragments
    than are likely to be empty.
    """
    most = 2 * hi * (100 - percent) // (100 + percent)
    if not most:
        return 0, 0
    spare = 0
    for _ in range(4):
        m = most + 1 + spare
        empty = m * exp(-hi / BAND / m)
        spare = min(most + 8, ceil(empty + 2 * sqrt(empty)))
    return most + 1 + spare, spare


def fragments(tokens: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(signature, size, order)`` of the fragments by which sets that reach the threshold meet.

    A set joins the band of its size, and the next band if a partner may be there. Sets
    that agree on nothing but empty fragments have more of them than there are spare
    ones, both; such sets are cut again by another order, and in the last one their
    empty fragments count as well. In the next band a set is a guest, with orders below
    zero (-1 - order): two guests are of one band, and meet there.
    """
    n, found, turns = len(tokens), [], []
    band, top = (floor(log(x) / log(BAND) + 1e-9) for x in (n, n * 100 / percent))
    for b in range(band, top + 1):
        m, spare = _parts(ceil(BAND ** (b + 1)), percent)
        for turn in range(ORDERS if m else 0):
            order = tokens if not turn else np.sort(mixed(tokens * B + np.uint64(turn)))
            part = ((order >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
            starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            tag = np.array([b * ORDERS + turn], np.uint64)
            sums = np.add.reduceat(mixed(order + A), starts)
            found.append((mixed(sums + part[starts] * B + tag * C), np.diff(np.append(starts, n))))
            turns.append(int(tag[0]) if b == band else -1 - int(tag[0]))
            if m - len(starts) <= spare:
                break
            if turn == ORDERS - 1:
                none = np.setdiff1d(np.arange(m, dtype=np.uint64), part[starts])
                found.append((mixed(mixed(none + C) + tag * A), np.zeros(len(none), int)))
                turns.append(turns[-1])
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, int), np.zeros(0, int)
    return np.concatenate([s for s, _ in found]), np.concatenate([w for _, w in found]), np.repeat(turns, [len(s) for s, _ in found])


def parity(tokens: np.ndarray) -> np.ndarray:
    """For each value of the lowest bits, whether an odd number of tokens has it.

    A token that only one of two sets has changes one bit, so the bitmaps of two sets
    differ in at most as many bits as the sets differ in tokens. Bitmaps grow with sets;
    the halves of one that is twice as long, XORed, are one of half its length.
    """
    longs = PARITY_LONGS << max(0, ceil(log(max(1, len(tokens)) / 1024, 2)))
    odd = np.bincount((tokens % np.uint64(64 * longs)).astype(np.int64), minlength=64 * longs) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _apart(left: F.Column, right: F.Column) -> tuple[F.Column, F.Column]:
    """Whether two parity bitmaps can be compared, and in how many bits they differ."""

    def folded(longer, size):
        return F.zip_with(F.slice(longer, F.lit(1), size), F.slice(longer, size + 1, size), lambda x, y: x.bitwiseXOR(y))

    least = F.least(F.size(left), F.size(right))
    fit = lambda x: F.when(F.size(x) == 2 * least, folded(x, least)).otherwise(x)
    apart = F.aggregate(F.zip_with(fit(left), fit(right), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return F.greatest(F.size(left), F.size(right)) <= 2 * least, apart


def _may_link(percent: int) -> F.Column:
    """Whether sizes and parity bitmaps allow the sets ``l`` and ``r`` to reach the threshold.

    Sets of na and nb tokens over it differ in at most (na + nb) (1 - t) / (1 + t).
    """
    na, nb, k = F.col("l.n"), F.col("r.n"), F.lit(percent)
    comparable, apart = _apart(F.col("l.parity"), F.col("r.parity"))
    return (na * 100 >= nb * k) & (nb * 100 >= na * k) & (~comparable | (apart * (k + 100) <= (na + nb) * (F.lit(100) - k)))


SETS = "doc_id long, n long, s1 long, s2 long"
FIRSTS = "sig long, s1 long"
SIGNED = "sig long, size int, turn int, s1 long, s2 long"


def _columns(schema: str, columns: list) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """Size and digest of each document's set."""

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, texts in arrow_texts(batch):
                found = [digested(t, width) for t in texts]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *_columns("n long, s1 long, s2 long", [[len(s) for s, _, _ in found], [a for _, a, _ in found], [b for _, _, b in found]]).columns], names=["doc_id", "n", "s1", "s2"])

    return docs.mapInArrow(described, SETS)


def _signature_rows(docs: DataFrame, ids: DataFrame, width: int, percent: int) -> DataFrame:
    docs, keep = ids_within(docs, ids)

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = set()
            for _, texts in arrow_texts(keep(batch)):
                out = []
                for text in texts:
                    tokens, *key = digested(text, width)
                    if len(tokens) and tuple(key) not in seen:
                        seen.add(tuple(key))
                        sig, size, turn = fragments(tokens, percent)
                        out.append((sig.view(np.int64), size, turn, *(np.full(len(sig), k) for k in key)))
                if out:
                    yield _columns(SIGNED, [np.concatenate(c) for c in zip(*out, strict=True)])

    return docs.select("doc_id", "text").mapInArrow(signed, SIGNED)


def first_tokens(tokens: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """Tokens of the set's first fragment, and how many of them a partner has to have.

    A set of n tokens has at most n - ceil(t n) that a partner over the threshold t lacks.
    """
    n = len(tokens)
    lacking, need = n - -(-percent * n // 100), max(1, n // 20)
    return tokens[: lacking + need], min(need, n - lacking)


def _first_rows(docs: DataFrame, width: int, percent: int) -> DataFrame:
    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = set()
            for _, texts in arrow_texts(batch):
                out = []
                for text in texts:
                    tokens, *key = digested(text, width)
                    if len(tokens) and tuple(key) not in seen:
                        seen.add(tuple(key))
                        some, _ = first_tokens(tokens, percent)
                        out.append((some.view(np.int64), np.full(len(some), key[0])))
                if out:
                    yield _columns(FIRSTS, [np.concatenate(c) for c in zip(*out, strict=True)])

    return docs.select("text").mapInArrow(firsts, FIRSTS)


def _hopeful(firsts: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Ids of the classes that have as many first tokens of other sets as a partner needs.

    A token's row holds no more than the first half of its set's digest, and moves once.
    """
    of_sig = Window.partitionBy("sig")
    several = firsts.withColumns({"lo": F.min("s1").over(of_sig), "hi": F.max("s1").over(of_sig)}).where("lo <> hi")
    known = several.groupBy("s1").agg(F.count("*").alias("known"))
    # as in first_tokens
    need = F.expr(f"least(greatest(1, n div 20), ({percent} * n + 99) div 100)")
    return classes.join(known, "s1").where(F.col("known") >= need).select(F.col("rep").alias("doc_id")).distinct()


def _shared(signed: DataFrame) -> DataFrame:
    """``(sig, size, turn, s1, s2)``: members of the fragments that more than one set has, and not only guests.

    Fragments that the same sets have stand as one, the smallest, with the sum of their
    sizes, so a pair that agrees on most of its fragments has two rows for all of them.
    Groups of sets are known by two sums (XOR) of hashes of their members, 128 bits.
    """
    of_sig = Window.partitionBy("sig")
    rows = signed.repartition("sig").dropDuplicates(["sig", "s1", "s2"])
    sums = {f"d{k}": F.bit_xor(F.xxhash64(F.lit(k), "s1", "s2")).over(of_sig) for k in (1, 2)}
    marked = rows.withColumns({"sets": F.count("*").over(of_sig), "home": F.max("turn").over(of_sig) >= 0} | sums).where("sets > 1 and home").drop("sets", "home")
    return marked.repartition("s1", "s2").groupBy("s1", "s2", "d1", "d2", "turn").agg(F.min("sig").alias("sig"), F.sum("size").alias("size")).drop("d1", "d2")


WIDE = "s1 long, s2 long, wide int, tokens binary"


#: Meetings for each set and fragment that are taken to cost no more than a round.
MEETINGS = 4
#: Rounds by which copies are together, and pairs for each link that later rounds may try.
SOME_ROUNDS, FEW_LINKS = 3, 20
#: Signatures that a set brings into the last join.
FIRSTS_KEPT = 8


def _wide(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """Shingles of the documents in ``ids`` by wide fragment, and parity bitmaps at fragment -1; sets may repeat."""
    docs, keep = ids_within(docs, ids)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in arrow_texts(keep(batch), 100):
                rows = []
                for text in texts:
                    tokens, s1, s2 = digested(text, width)
                    part = (tokens >> np.uint64(64 - WIDE_BITS)).astype(int)
                    rows += [(s1, s2, int(f), tokens[part == f].tobytes()) for f in np.unique(part)]
                    rows.append((s1, s2, -1, parity(tokens).tobytes()))
                if rows:
                    yield _columns(WIDE, list(zip(*rows, strict=True)))

    return docs.select("doc_id", "text").mapInArrow(cut, WIDE)


@F.pandas_udf(T.LongType())
def _overlap(a: pd.Series, b: pd.Series) -> pd.Series:
    both = (np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True) for x, y in zip(a, b, strict=True))
    return pd.Series([len(x) for x in both], dtype="int64")


@F.pandas_udf(T.ArrayType(T.LongType()))
def _longs(x: pd.Series) -> pd.Series:
    return x.map(lambda b: np.frombuffer(b, np.int64))


def _with_parity(tokens: DataFrame, sizes: DataFrame) -> DataFrame:
    """Size and parity bitmap of each class."""
    return sizes.select("cls", "n").join(tokens.where("wide = -1").select("cls", _longs("tokens").alias("parity")), "cls")


def _verified(wide: DataFrame, pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that reach the threshold, by overlaps summed over wide fragments.

    Tokens are read only for pairs whose sizes and parity bitmaps allow it.
    """
    k, side = F.lit(percent), F.struct("n", "parity")
    both = pairs.join(sets.select(F.col("cls").alias("a"), side.alias("l")), "a").join(sets.select(F.col("cls").alias("b"), side.alias("r")), "b")
    sized = both.where(_may_link(percent)).select("a", "b", F.col("l.n").alias("na"), F.col("r.n").alias("nb"))
    pieces = sized.withColumn("wide", F.explode(F.array(*map(F.lit, range(1 << WIDE_BITS)))))
    left = pieces.join(wide.toDF("a", "wide", "at"), ["a", "wide"])
    both = left.join(wide.toDF("b", "wide", "bt"), ["b", "wide"])
    sums = both.withColumn("o", _overlap("at", "bt")).groupBy("a", "b", "na", "nb").agg(F.sum("o").alias("o"))
    return sums.where(F.col("o") * 100 >= k * (F.col("na") + F.col("nb") - F.col("o"))).select("a", "b")


def _best_partners(apart: DataFrame, tested: DataFrame, turn: int) -> DataFrame:
    """For each set the untested pair with the largest summed overlap, among the firsts of its fragments, which are no guests."""
    first = apart.groupBy("sig").agg(F.min_by(F.struct("cls", "component"), F.struct(F.col("turn") < 0, F.xxhash64(F.lit(turn), "cls"))).alias("p"))
    met = apart.join(first, "sig").where("component <> p.component")
    pair = [F.least("cls", "p.cls").alias("a"), F.greatest("cls", "p.cls").alias("b")]
    partial = met.groupBy("cls", *pair, "turn").agg(F.sum("size").alias("o")).groupBy("cls", "a", "b").agg(F.max("o").alias("o"))
    fresh = partial.join(tested, ["a", "b"], "left_anti")
    return fresh.groupBy("cls").agg(F.max_by(F.struct("a", "b"), F.struct("o", "a", "b")).alias("p")).select("p.a", "p.b").distinct()


def _open(left: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of the fragments whose sets are still in different components."""
    placed = left.select("sig", "cls", "size", "turn").join(labels, "cls")
    open_ = placed.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("sig")
    return placed.join(open_, "sig")


def _meetings(left: DataFrame) -> int:
    """Pairs that meet if all sets of each fragment do, but for its guests among themselves."""
    n, guests = F.col("n"), F.col("guests")
    return left.groupBy("sig").agg(F.count("*").alias("n"), F.count_if(F.col("turn") < 0).alias("guests")).agg(F.sum((n * (n - 1) - guests * (guests - 1)) / 2)).first()[0] or 0


def _that_may_link(left: DataFrame, tokens: DataFrame, sizes: DataFrame, percent: int, some: bool = False) -> DataFrame:
    """Sets ``l`` and ``r`` that meet in a fragment; what can't reach the threshold never leaves the join.

    A set brings the smallest signatures of its band along. Where two sets have some of
    these in common, the smallest is the first fragment that both have, and the pair
    leaves there only; a pair without any leaves from each of its fragments, so pairs
    may repeat. With ``some``, sets meet only those that a hash chooses, in a fragment of
    n sets about the root of n.
    """
    guest, smallest = F.col("turn") < 0, lambda where: F.slice(F.sort_array(F.collect_set(F.when(where, F.col("sig")))), 1, FIRSTS_KEPT)
    # a pair passes in one band only: their own, or that of the larger set, where the smaller is a guest
    firsts, chosen = [smallest(~guest).alias("own"), smallest(guest).alias("others")], F.lit(True)
    if some:
        left = left.withColumn("sets", F.count("*").over(Window.partitionBy("sig")))
        firsts.append(F.max("sets").alias("most"))
        chosen = F.pmod(F.xxhash64(F.lit(-1), "cls"), F.ceil(F.sqrt("most"))) == 0
    sets = _with_parity(tokens, sizes).join(left.groupBy("cls").agg(*firsts).withColumn("chosen", chosen), "cls")
    known = left.join(sets, "cls").select("sig", "cls", "component", "n", "parity", "chosen", guest.alias("guest"), F.when(guest, F.col("others")).otherwise(F.col("own")).alias("firsts"))
    meet = (F.col("l.sig") == F.col("r.sig")) & (F.col("l.component") != F.col("r.component")) & ~(F.col("l.guest") & F.col("r.guest"))
    order = (F.col("l.cls") < F.col("r.cls")) | ~F.col("l.chosen")
    once = F.coalesce(F.array_min(F.array_intersect("l.firsts", "r.firsts")), "l.sig") == F.col("l.sig")
    return known.alias("l").join(known.where("chosen").alias("r"), meet & order & _may_link(percent) & once)


def _all_that_may_link(left: DataFrame, tokens: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Pairs of sets of different components that meet in a fragment and may link."""
    return _that_may_link(left, tokens, sizes, percent).select(F.col("l.cls").alias("a"), F.col("r.cls").alias("b"))


def _nearest_of_components(left: DataFrame, tokens: DataFrame, sizes: DataFrame, percent: int, tested: DataFrame) -> DataFrame:
    """For each two components the untested pair with the nearest bitmaps, if all sets meet the chosen ones.

    A set that links with a part f of a family of n is missed by all of them with a
    chance of (1 - f) to the number of those chosen, so that hardly more than the root
    of n is left to each set when all meet.
    """
    of_l, of_r = F.col("l.cls"), F.col("r.cls")
    comparable, apart = _apart(F.col("l.parity"), F.col("r.parity"))
    between = [F.least("l.component", "r.component").alias("lo"), F.greatest("l.component", "r.component").alias("hi")]
    met = _that_may_link(left, tokens, sizes, percent, some=True).select(*between, F.least(of_l, of_r).alias("a"), F.greatest(of_l, of_r).alias("b"), F.when(comparable, apart / (F.col("l.n") + F.col("r.n"))).otherwise(1.0).alias("apart"))
    fresh = met.join(tested, ["a", "b"], "left_anti")
    return fresh.groupBy("lo", "hi").agg(F.min_by(F.struct("a", "b"), F.struct("apart", "a", "b")).alias("p")).select("p.a", "p.b")


def _relabelled(labels: DataFrame, found: DataFrame) -> DataFrame:
    """``labels`` after new links, by two hops: equal labels are connected, others may be."""
    of_a, of_b = labels.toDF("a", "la"), labels.toDF("b", "lb")
    steps = found.join(of_a, "a").join(of_b, "b").where("la <> lb").select(F.greatest("la", "lb").alias("hi"), F.least("la", "lb").alias("lo"))
    hop = steps.groupBy("hi").agg(F.min("lo").alias("lo"))
    twice = hop.join(hop.toDF("lo", "lower"), "lo", "left").select(F.col("hi").alias("component"), F.coalesce("lower", "lo").alias("to"))
    return labels.join(twice, "component", "left").select("cls", F.coalesce("to", "component").alias("component"))


def link(docs: DataFrame, percent: int = 90, width: int = 3, rounds: int = 10) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text).

    Texts link when their word shingles have a Jaccard similarity of at least
    ``percent`` / 100 (75 at least); a text with fewer words than ``width`` has all of
    them as its one shingle. A text without words links with nothing. Rows with a null
    doc_id link with nothing and have a null component. Rows that repeat a doc_id are
    rows of their own. Sets are known by 128-bit digests, shingles within a pair by 64
    bits. Other columns are not read.

    ``rounds`` bounds how often a set meets one other set only, before all that are still
    apart meet; rounds also end when those would be few meetings, or when they hardly find
    links. All this changes the cost and not the result.
    """
    if percent < 75:
        raise ValueError("fragments would mostly be empty below 75 percent")
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    light = scratch.keep(_sets(docs, width))
    linked = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    classes = light.where(linked).groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"))
    classes = scratch.keep(classes.withColumn("cls", F.monotonically_increasing_id()))
    # a set whose first tokens are mostly its own has no partner
    hopeful = scratch.keep(_hopeful(_first_rows(docs.where("doc_id is not null"), width, percent), classes, percent))
    members = _shared(_signature_rows(docs, hopeful, width, percent))
    shared = scratch.keep(members.join(classes.select("s1", "s2", "cls"), ["s1", "s2"]).select("sig", "cls", "size", "turn"))
    scratch.drop(hopeful)
    met = scratch.keep(classes.join(shared.select("cls").distinct(), "cls", "left_semi"))
    tokens = _wide(docs, met.select(F.col("rep").alias("doc_id")).distinct(), width).join(met.select("s1", "s2", "cls"), ["s1", "s2"])
    # the pairs go to the tokens, not the tokens to the pairs of each round
    tokens = scratch.keep_in_buckets(tokens.select("cls", "wide", "tokens").dropDuplicates(["cls", "wide"]), "cls", "wide")
    wide, sets = tokens.where("wide >= 0"), scratch.keep(_with_parity(tokens, met))

    pair = "a bigint, b bigint"
    tested, links, whole = [], [], None
    labels = met.select("cls", F.col("cls").alias("component"))
    left, held = shared, [met, sets]
    few = False
    for turn in range(rounds + 1):
        before, left = left, scratch.keep(_open(left, labels))
        scratch.drop(before)
        if left.isEmpty():
            break
        # copies are together after some rounds; of what finds no links then, or where few share a fragment, all may as well meet
        cheap = False
        last = turn == rounds or turn >= SOME_ROUNDS and few or (cheap := turn > 0 and _meetings(left) <= MEETINGS * left.count())
        if not last:
            pairs = scratch.keep(_best_partners(left, scratch.together(tested, pair), turn))
            held.append(pairs)
            tried = pairs.count()
            last = not tried
        if last:
            if not cheap:
                # families whose sets mostly link come together by some of their sets, not by all their pairs
                pairs = scratch.keep(_nearest_of_components(left, tokens, met, percent, scratch.together(tested, pair)))
                found = scratch.keep(_verified(wide, pairs, sets, percent))
                held += [pairs, found]
                tested.append(pairs)
                links.append(found)
            # two hops leave parts of a component apart: now whole components count
            whole = components(scratch.together(links, pair), scratch)
            labels = met.select("cls").join(whole.toDF("cls", "component"), "cls", "left").select("cls", F.coalesce("component", "cls").alias("component"))
            before, left = left, scratch.keep(_open(left, labels))
            scratch.drop(before)
            pairs = scratch.keep(_all_that_may_link(left, tokens, met, percent).distinct().join(scratch.together(tested, pair), ["a", "b"], "left_anti"))
            held.append(pairs)
        found = scratch.keep(_verified(wide, pairs, sets, percent))
        held.append(found)
        new = found.count()
        if new:
            links.append(found)
            whole = None
            if not last:
                labels = scratch.keep(_relabelled(labels, found))
                held.append(labels)
        if last:
            break
        few = new * FEW_LINKS < tried
        tested.append(pairs)

    whole = whole or components(scratch.together(links, pair), scratch)
    named = classes.join(whole.toDF("cls", "component"), "cls", "left").select("s1", "s2", "rep", F.coalesce("component", "cls").alias("component"))
    firsts = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = scratch.keep(named.join(firsts, "component").select("s1", "s2", "component_id"))
    scratch.drop(classes, left, tokens, *held)
    out = light.join(named, (light.s1 == named.s1) & (light.s2 == named.s2) & linked, "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(linked, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


#: DuckDB SQL for ``link`` with its defaults on ``documents``, whose ids are distinct.
ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
shingled AS (
  SELECT DISTINCT doc_id, array_to_string(w[k : k + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS k FROM words WHERE len(w) > 0) t),
sized AS (SELECT doc_id, count(*) AS n FROM shingled GROUP BY doc_id),
meets AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM shingled a JOIN shingled b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM meets JOIN sized x ON x.doc_id = a JOIN sized y ON y.doc_id = b WHERE 100 * o >= 90 * (x.n + y.n - o)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM reached r JOIN both_ways l ON r.b = l.a)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, least(d.doc_id, coalesce(r.least_id, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sized s ON s.doc_id = d.doc_id LEFT JOIN (SELECT a, min(b) AS least_id FROM reached GROUP BY a) r ON r.a = d.doc_id
"""
