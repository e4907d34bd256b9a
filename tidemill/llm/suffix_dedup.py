"""Removal of byte strings that repeat across documents, by suffix order in shards.

1. Exact copies of a text are settled by their digest.
2. Anchors: of every run of ``length`` bytes, the k-gram with the smallest hash is its
   anchor, so equal runs have equal anchors. One shuffle of packed hashes finds the
   anchors that documents share. Where the bytes of all runs of an anchor (its context)
   are the same, by a 64-bit digest, as in a document with a smaller id, they are settled.
3. Contexts that differ around a shared anchor are the borders of repeats: their bytes go
   to the shard of the anchor's hash, where equal runs meet.
   An anchor with very many contexts sends each of its runs by itself, to the shard of
   the run's hash.
4. Each shard leaves out runs whose hash no other document has, sorts the suffixes of the
   rest by external induced sorting and reads off, from the common prefixes, which runs
   also start in a document with a smaller id.
5. The runs found are removed from their documents and the rest is hashed.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import arrow_texts, checkpointed, id_filter, ids_within, release
from tidemill.llm.induced import suffixes
from tidemill.llm.jaccard import mixed

GRAM = 16
#: Shards of contexts to a bucket of texts.
SHARDS = 1
#: Kinds of what comes out of the meeting of anchors: settled, open, and open at an anchor with many contexts.
SETTLED, OPEN, HOT = 0, 1, 3
#: Open contexts of one anchor that may go to one shard.
MOST_CONTEXTS = 20_000


def _grams(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k-gram, by doubling."""
    h = {1: mixed(data.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))}
    size = 1
    while size * 2 <= k:
        a = h[size]
        h[size * 2] = (a[:-size] * np.uint64(0xD6E8FEB86659FD93)) ^ (a[size:] * np.uint64(0xA0761D6478BD642F) + np.uint64(size))
        h[size * 2] ^= h[size * 2] >> np.uint64(29)
        size *= 2
    out, have = h[size], size
    while have < k:
        part = max(s for s in h if s <= k - have)
        n = len(data) - have - part + 1
        out = (out[:n] * np.uint64(0xE7037ED1A0B428DB)) ^ (h[part][have : have + n] * np.uint64(0x8EBC6AF09C88C6E3) + np.uint64(have))
        have += part
    return mixed(out)


def _anchors(h: np.ndarray, window: int) -> np.ndarray:
    """Position of the first smallest hash of every window."""
    value, pos = h, np.arange(len(h), dtype=np.int32)
    size = 1

    def merged(value, pos, step, n):
        right = value[step : step + n] < value[:n]
        return np.where(right, value[step : step + n], value[:n]), np.where(right, pos[step : step + n], pos[:n])

    while size * 2 <= window:
        value, pos = merged(value, pos, size, len(value) - size)
        size *= 2
    if size < window:
        value, pos = merged(value, pos, window - size, len(value) - (window - size))
    return pos


def segments(data: np.ndarray, length: int, at_once: int = 1 << 17) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(hash, context digest, first run, end of runs)``: the runs of ``length`` bytes of each anchor.

    Long texts are read in windows of ``at_once`` runs, which bounds the memory. The last
    anchor of a window may have more runs after it, so the next window starts with it.
    """
    runs, begin, parts = len(data) - length + 1, 0, []
    while begin < runs:
        stop = min(runs, begin + at_once)
        h, context, first, end = _window_segments(data[begin : stop + length - 1], length)
        keep = len(first) if stop == runs else len(first) - 1
        parts.append((h[:keep], context[:keep], first[:keep] + begin, end[:keep] + begin))
        begin = runs if stop == runs else begin + int(first[-1])
    if not parts:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none
    return parts[0] if len(parts) == 1 else tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _window_segments(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    h = _grams(data, GRAM)
    at = _anchors(h, length - GRAM + 1)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    end = np.append(first[1:], len(at))
    anchor = at[first].astype(np.int64)
    up, down = _powers(len(h))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up)])
    last = end + length - GRAM  # grams of the context
    context = mixed((sums[last] - sums[first]) * down[first] + (anchor - first).astype(np.uint64) * BASE + (last - first).astype(np.uint64))
    return h[anchor], context, first, end


#: An odd number and its inverse modulo 2 ** 64.
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


@cache
def _powers_upto(n: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, x, np.uint64))]) for x in (BASE, INVERSE))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for n places."""
    up, down = _powers_upto(1 << max(10, (n - 1).bit_length()))
    return up[:n], down[:n]


def _bytes(text) -> np.ndarray:
    return np.frombuffer((text or "").encode(), np.uint8)


def zipped(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``doc_id`` and the compressed bytes of ``text`` of the rows with ``ids``: texts that move weigh less than half.

    Filter and compression are one function, so a task has one Python worker.
    """
    docs, keep = ids_within(docs, ids)

    def compressed(batches):
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for piece, texts in arrow_texts(keep(batch)):
                small = pa.array([None if t is None else pack.compress(t.encode()) for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), small], names=["doc_id", "zipped"])

    return docs.select("doc_id", "text").mapInArrow(compressed, "doc_id long, zipped binary")


def _unzipped(packed: bytes | None) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(packed) if packed else b"", np.uint8)


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the runs of equal values in a sorted array."""
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
    return starts, np.diff(np.append(starts, len(key)))


def _judged(h: np.ndarray, context: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by (anchor, context, document): the three, and what each row is.

    2: the first document with its context, and the anchor has no other context; OPEN or
    HOT: the same, but it has; SETTLED: a smaller document has the same context.
    """
    order = np.lexsort((doc, context, h))
    h, context, doc = h[order], context[order], doc[order]
    new_h = np.concatenate([[True], h[1:] != h[:-1]])
    new_context = new_h | np.concatenate([[True], context[1:] != context[:-1]])
    starts, sizes = np.flatnonzero(new_context), np.diff(np.append(np.flatnonzero(new_context), len(h)))
    settled = doc > np.repeat(doc[starts], sizes)
    # open only if the anchor has several contexts, and in several documents
    anchors = np.flatnonzero(new_h)
    several = (np.add.reduceat(new_context.astype(np.int64), anchors) > 1) & (np.minimum.reduceat(doc, anchors) != np.maximum.reduceat(doc, anchors))
    sizes = np.diff(np.append(anchors, len(h)))
    many = np.repeat(np.where(several, np.where(np.add.reduceat((~settled).astype(np.int64), anchors) > MOST_CONTEXTS, HOT, OPEN), 2), sizes)
    return h, context, doc, np.where(settled, SETTLED, many)


def _by_doc(doc: np.ndarray, context: np.ndarray, kind: int) -> list:
    order = np.argsort(doc, kind="stable")
    doc, context = doc[order], context[order]
    return [(int(doc[a]), kind, context[a : a + n].tobytes()) for a, n in zip(*_groups(doc), strict=True)]


PACKED = {"bucket": pa.int32(), "base": pa.int64(), "wide": pa.int32(), "h": pa.binary(), "context": pa.binary(), "doc": pa.binary()}


def _packed_anchors(docs: DataFrame, copies: DataFrame, length: int, buckets: int, bytes_at_once: int = 4 << 20) -> DataFrame:
    """Anchors and contexts of all documents but ``copies``, packed by bucket of the anchor's hash.

    A row holds the upper 32 bits of the hashes, the context digests, and the documents
    as offsets to ``base`` of ``wide`` bytes. What is settled among the documents that are read together
    has a negative bucket, and only the first document stands for a context.
    """
    low = np.uint64(0xFFFFFFFF)
    docs, keep = ids_within(docs, copies, outside=True)

    def rows_of(bucket, h, context, doc) -> list:
        order = np.argsort(bucket, kind="stable")
        bucket, h, context, doc = bucket[order], h[order], context[order], doc[order]
        out = []
        for a, n in zip(*_groups(bucket), strict=True):
            own = doc[a : a + n]
            base = int(own.min())
            reach = int(own.max()) - base
            wide = 2 if reach < 1 << 16 else 4 if reach < 1 << 32 else 8
            out.append((int(bucket[a]), base, wide, h[a : a + n].tobytes(), context[a : a + n].tobytes(), (own - base).astype(f"<u{wide}").tobytes()))
        return out

    def rows(held: list) -> list:
        h, context, doc = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        if not len(h):
            return []
        h, context, doc, kind = _judged(h, context, doc)
        sent = kind != SETTLED
        bucket = ((h & low) % np.uint64(buckets)).astype(np.int64)
        code = (h >> np.uint64(32)).astype(np.uint32)
        local = -1 - (mixed(doc.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        return rows_of(bucket[sent], code[sent], context[sent], doc[sent]) + rows_of(local[~sent], code[~sent], context[~sent], doc[~sent])

    def packed(batches):
        for batch in batches:
            held, size = [], 0
            for piece, texts in arrow_texts(keep(batch)):
                for doc_id, text in zip(piece.column("doc_id").to_pylist(), texts, strict=True):
                    data = _bytes(text)
                    h, context, _, _ = segments(data, length)
                    held.append((h, context, np.full(len(h), doc_id, np.int64)))
                    size += len(data)
                    if size >= bytes_at_once:
                        yield batch_of(rows(held))
                        size = 0
            if held:
                yield batch_of(rows(held))

    def batch_of(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(PACKED.values())], names=list(PACKED))

    return docs.select("doc_id", "text").mapInArrow(packed, "bucket int, base long, wide int, h binary, context binary, doc binary")


def _shared_anchors(docs: DataFrame, copies: DataFrame, length: int, buckets: int) -> DataFrame:
    """``(doc_id, kind, contexts)``: digests of contexts that are settled, open or hot, without ``copies``."""

    def meet(key: tuple[object, ...], rows: pd.DataFrame) -> pd.DataFrame:
        context = np.concatenate([np.frombuffer(x, np.uint64) for x in rows.context])
        doc = np.concatenate([np.frombuffer(d, f"<u{w}").astype(np.int64) + b for b, w, d in zip(rows.base, rows.wide, rows.doc, strict=True)])
        if key[0] < 0:
            out = _by_doc(doc, context, SETTLED)
        else:
            h = np.concatenate([np.frombuffer(x, np.uint32) for x in rows.h])
            _, context, doc, kind = _judged(h, context, doc)
            out = [r for k in (SETTLED, OPEN, HOT) for r in _by_doc(doc[kind == k], context[kind == k], k)]
        release()
        return pd.DataFrame(out, columns=["doc_id", "kind", "contexts"])

    return _packed_anchors(docs, copies, length, buckets).groupBy("bucket").applyInPandas(meet, "doc_id long, kind int, contexts binary")


def _packed(places) -> bytes:
    return np.asarray(places, "<i4").tobytes()


def _contexts(docs: DataFrame, shared: DataFrame, length: int, buckets: int) -> DataFrame:
    """For each open context its bytes, to the shard of its anchor; for the settled ones their runs, to negative shards."""
    deal = F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int").alias("deal")

    shards = np.uint64(buckets * SHARDS)

    def cut(texts: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        of = {}
        for doc_id, kind, c in zip(known.doc_id, known.kind, known.contexts, strict=True):
            of.setdefault((doc_id, kind), []).append(np.frombuffer(c, np.uint64))
        out = []
        for doc_id, packed in zip(texts.doc_id, texts.zipped, strict=True):
            own = {k: np.concatenate(of[doc_id, k]) for k in (SETTLED, OPEN, HOT) if (doc_id, k) in of}
            if not own:
                continue
            data = _unzipped(packed)
            h, context, first, end = segments(data, length)
            raw, which = data.tobytes(), xxhash.xxh3_64_intdigest(data.tobytes()) - (1 << 63)
            if SETTLED in own:
                at = np.flatnonzero(np.isin(context, own[SETTLED]))
                # neighbouring runs are one range
                cuts = np.flatnonzero(np.concatenate([[True], first[at[1:]] != end[at[:-1]]])) if len(at) else at
                ends = np.append(cuts[1:], len(at)) - 1
                out += [(-1 - doc_id % buckets, doc_id, which, _packed(a), b, None) for a, b in zip(first[at[cuts]].tolist(), (end[at[ends]] if len(at) else at).tolist(), strict=True)]
            if OPEN in own:
                at = np.flatnonzero(np.isin(context, own[OPEN]))
                order = at[np.argsort(context[at], kind="stable")]
                # a context that the document repeats is sent once, with all its places
                for a, n in zip(*_groups(context[order]), strict=True):
                    k = order[a]
                    out.append((int(h[k] % shards), doc_id, which, _packed(first[order[a : a + n]]), int(end[k] - first[k]), raw[first[k] : end[k] + length - 1]))
            if HOT in own:
                at = np.flatnonzero(np.isin(context, own[HOT]))
                runs = {}
                for p in np.concatenate([np.arange(first[k], end[k]) for k in at]).tolist() if len(at) else []:
                    runs.setdefault(raw[p : p + length], []).append(p)
                out += [(xxhash.xxh3_64_intdigest(run) % int(shards), doc_id, which, _packed(p), 1, run) for run, p in runs.items()]
        found = pd.DataFrame(out, columns=["shard", "doc_id", "which", "places", "runs", "context"])
        out.clear()
        release()
        return found

    left, right = zipped(docs, shared.select("doc_id").distinct()).withColumn("deal", deal), shared.withColumn("deal", deal)
    pairs = left.groupBy("deal").cogroup(right.groupBy("deal"))
    return pairs.applyInPandas(cut, "shard int, doc_id long, which long, places binary, runs int, context binary")


def _shared_runs(doc: np.ndarray, contexts: list[bytes], length: int, at_once: int = 1 << 21) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(context, lo, hi)``: ranges of runs whose hash runs of other documents have as well."""
    size = np.array([len(c) for c in contexts], np.int64)
    count = size - length + 1
    before, k = np.cumsum(count) - count, 0
    h = np.empty(count.sum(), np.uint64)
    while k < len(contexts):
        # some contexts after the other; runs that cross a border are left out
        stop = max(k + 1, int(np.searchsorted(np.cumsum(size[k:]), at_once)) + k)
        data = np.frombuffer(b"".join(contexts[k:stop]), np.uint8)
        # a context has length - 1 runs less than bytes
        ahead = np.arange(stop - k) * (length - 1)
        first, n = before[k], int(count[k:stop].sum())
        h[first : first + n] = _grams(data, length)[np.arange(n) + np.repeat(ahead, count[k:stop])]
        k = stop
    order = np.argsort(h)
    h.sort()
    starts, sizes = _groups(h)
    del h
    who = np.repeat(np.unique(doc, return_inverse=True)[1].astype(np.int32), count)[order]
    shared = np.empty(len(order), bool)
    shared[order] = np.repeat(np.minimum.reduceat(who, starts) != np.maximum.reduceat(who, starts), sizes)
    del order, who
    at = np.flatnonzero(shared)
    if not len(at):
        return at, at, at
    own = np.searchsorted(before, at, "right") - 1
    place = at - before[own]
    cuts = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (place[1:] != place[:-1] + 1)]))
    ends = np.append(cuts[1:], len(at)) - 1
    return own[cuts], place[cuts], place[ends] + 1


def repeated_runs(doc: np.ndarray, contexts: list[bytes], length: int, memory: int = 32 << 20) -> tuple[np.ndarray, np.ndarray]:
    """``(context, offset)`` of each run that also starts in a document with a smaller id."""
    which, lo, hi = _shared_runs(doc, contexts, length)
    if not len(which):
        return which, which
    found, offset = _sorted_runs(doc[which], [contexts[k][a : b + length - 1] for k, a, b in zip(which.tolist(), lo.tolist(), hi.tolist(), strict=True)], length, memory)
    return which[found], lo[found] + offset


def _sorted_runs(doc: np.ndarray, contexts: list[bytes], length: int, memory: int) -> tuple[np.ndarray, np.ndarray]:
    """The same, of all runs, by their suffix order."""
    size = np.array([len(c) for c in contexts], np.int64)
    begin = np.cumsum(size + 1) - size - 1
    text = np.frombuffer(b"\0".join([*contexts, b""]), np.uint8).astype(np.uint16) + 1
    text[begin + size] = 0  # ends a context
    owner = np.repeat(np.arange(len(contexts), dtype=np.int32), size + 1)
    runs = np.arange(len(text), dtype=np.int32) <= np.repeat((begin + size - length).astype(np.int32), size + 1)
    found, open_doc, open_pos = [], [], []

    def settle(docs: np.ndarray, pos: np.ndarray, starts: np.ndarray) -> None:
        least = np.repeat(np.minimum.reduceat(docs, starts), np.diff(np.append(starts, len(docs))))
        found.append(pos[docs > least])

    for pos, lcp in suffixes(text, length, memory):
        # runs that agree on `length` bytes are neighbours; a chunk may end inside a group
        whole = runs[pos]
        starts = np.flatnonzero(lcp < length)
        pos_kept, group = pos[whole], (np.searchsorted(starts, np.arange(len(pos)), "right"))[whole]
        if len(starts) and open_pos:
            ahead = group == 0
            open_doc.append(doc[owner[pos_kept[ahead]]])
            open_pos.append(pos_kept[ahead])
            docs, at = np.concatenate(open_doc), np.concatenate(open_pos)
            if len(docs):
                settle(docs, at, np.array([0]))
            open_doc, open_pos = [], []
            pos_kept, group = pos_kept[~ahead], group[~ahead]
        if not len(pos_kept):
            continue
        last = group == len(starts)
        docs = doc[owner[pos_kept]]
        if (~last).any():
            settle(docs[~last], pos_kept[~last], _groups(group[~last])[0])
        open_doc.append(docs[last])
        open_pos.append(pos_kept[last])
    if open_pos and sum(map(len, open_pos)):
        settle(np.concatenate(open_doc), np.concatenate(open_pos), np.array([0]))
    pos = np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return owner[pos], pos - begin[owner[pos]]


def _ranges(contexts: DataFrame, length: int) -> DataFrame:
    """``(doc_id, which, lo, hi)``: runs that start in [lo, hi) of the text with the hash ``which`` go."""

    def solve(key: tuple[object, ...], rows: pd.DataFrame) -> pd.DataFrame:
        doc, text = rows.doc_id.to_numpy(np.int64), rows.which.to_numpy(np.int64)
        places = [np.frombuffer(x, "<i4") for x in rows.places]
        if key[0] < 0:
            first = np.array([p[0] for p in places], np.int64)
            return pd.DataFrame({"doc_id": doc, "which": text, "lo": first, "hi": rows.runs.to_numpy(np.int64)})
        at, offset = repeated_runs(doc, list(rows.context), length)
        release()
        if not len(at):
            return pd.DataFrame({"doc_id": [], "which": [], "lo": [], "hi": []}, dtype="int64")
        fresh = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (offset[1:] != offset[:-1] + 1)]))
        after = offset[np.append(fresh[1:], len(at)) - 1] + 1
        lo, hi, at = offset[fresh], after, at[fresh]
        times = np.array([len(places[k]) for k in at])
        first = np.concatenate([places[k] for k in at]).astype(np.int64)
        return pd.DataFrame({"doc_id": np.repeat(doc[at], times), "which": np.repeat(text[at], times), "lo": first + np.repeat(lo, times), "hi": first + np.repeat(hi, times)})

    return contexts.groupBy("shard").applyInPandas(solve, "doc_id long, which long, lo int, hi int")


def _removed(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int) -> tuple[int, int, str]:
    """Bytes removed, maximal removed runs, and the digest of what is left."""
    edge = np.zeros(len(data) + 1, np.int64)
    np.add.at(edge, lo, 1)
    np.add.at(edge, np.minimum(hi - 1 + length, len(data)), -1)
    gone = np.cumsum(edge[:-1]) > 0
    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
    return int(gone.sum()), spans, hashlib.sha256(data[~gone].tobytes()).hexdigest()


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove_repeats(docs: DataFrame, length: int = 50, bytes_per_bucket: int = 6 << 20) -> DataFrame:
    """Remove each byte covered by a ``length``-byte string that also starts in a document with a smaller id.

    Works on the UTF-8 bytes of whole texts; a null text is empty. Returns doc_id,
    n_bytes, n_removed, n_spans, kept_sha256 for every row of ``docs`` (doc_id, text).
    Rows with a null doc_id neither lose bytes nor cause losses. Rows that repeat a
    doc_id are one document for each other: they cause no losses among themselves.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    light = checkpointed(docs.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), size.cast("long").alias("n")))
    total = light.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, -(-int(total) // bytes_per_bucket))
    usable = (F.col("n") >= length) & F.col("doc_id").isNotNull()
    firsts = light.where(usable).groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("c")).where("c > 1")
    copies = light.where(usable).join(firsts.select("digest", "least").where("least <> most"), "digest").where("doc_id > least").select("doc_id").distinct()
    # an id that repeats with other texts isn't a mere copy
    repeated = light.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id")
    copies = checkpointed(copies.join(repeated, "doc_id", "left_anti"))
    inside, _ = id_filter(docs, copies)

    texts = docs.where(F.col("doc_id").isNotNull() & (size >= length))
    shared = checkpointed(_shared_anchors(texts, copies, length, buckets))
    ranges = checkpointed(_ranges(_contexts(texts, shared, length, buckets), length))
    # no copy is shared or hit
    hit = ranges.select("doc_id").distinct()
    _, outside = id_filter(docs, copies.union(hit))

    empty = hashlib.sha256(b"").hexdigest()
    whole = inside(docs).where("doc_id is not null").select("doc_id", size.cast("long").alias("n_bytes"), size.cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(empty).alias("kept_sha256"))
    kept_hash = F.sha2(F.coalesce(F.col("text").cast("binary"), F.lit(b"")), 256)
    untouched = outside(docs).select("doc_id", size.cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), kept_hash.alias("kept_sha256"))

    def cut(texts: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values("doc_id")
        ids, lo, hi, which = (found[c].to_numpy(np.int64) for c in ("doc_id", "lo", "hi", "which"))
        out = []
        for doc_id, packed in zip(texts.doc_id, texts.zipped, strict=True):
            a, b = np.searchsorted(ids, [doc_id, doc_id + 1])
            data = _unzipped(packed)
            # rows that share an id may have different texts
            ok = which[a:b] == xxhash.xxh3_64_intdigest(data.tobytes()) - (1 << 63)
            out.append((doc_id, len(data), *_removed(data, lo[a:b][ok], hi[a:b][ok], length)))
        release()
        return pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    deal = F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")
    left, right = zipped(docs, hit).withColumn("deal", deal), ranges.withColumn("deal", deal)
    touched = left.groupBy("deal").cogroup(right.groupBy("deal")).applyInPandas(cut, RESULT)
    return whole.unionByName(untouched).unionByName(touched)
