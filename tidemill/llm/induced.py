"""Suffix order with common prefixes by external induced sorting.

The S*-suffixes (seeds) are sorted first; the order of all other suffixes follows from
them: going up through the characters, each sorted suffix passes its left neighbour to
the queue of that neighbour's character (L-suffixes); going down, the same for
S-suffixes. A queue hands its tuples out in the order of (character, rank of the suffix
that induced them), which makes it a priority queue with first-in, first-out buckets.
Tuples carry the position and the common prefix with the tuple before; the common prefix
of two neighbours in a queue is one more than the least common prefix between the two
suffixes that induced them.

Queues, the two halves of the order and the seeds go to disk beyond a memory limit, and
so do the text and its types. Only the first ``depth`` characters count, so seeds are not
named and solved as a shorter text: they are distributed by one character after the
other, recursively, until a part fits in memory.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np


#: Places that are handled at once.
GROUP = 1 << 18


class DiskChunks:
    """Chunks of (position, common prefix) under a character, on disk beyond a limit."""

    def __init__(self, memory: int, places: type = np.int32):
        self._memory, self._held, self._chunks, self._file, self._places = memory, 0, {}, None, places

    def push(self, char: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        pos, lcp = pos.astype(self._places), lcp.astype(np.int16)
        size = pos.nbytes + lcp.nbytes
        if self._held + size > self._memory:
            if self._file is None:
                self._file = tempfile.TemporaryFile()
            at = self._file.seek(0, 2)
            self._file.write(pos.tobytes() + lcp.tobytes())
            self._chunks.setdefault(char, []).append((at, len(pos)))
        else:
            self._held += size
            self._chunks.setdefault(char, []).append((pos, lcp))

    def _read(self, chunk) -> tuple[np.ndarray, np.ndarray]:
        if isinstance(chunk[1], int):
            self._file.seek(chunk[0])
            wide = np.dtype(self._places).itemsize
            raw = self._file.read((wide + 2) * chunk[1])
            chunk = np.frombuffer(raw, self._places, chunk[1]), np.frombuffer(raw, np.int16, chunk[1], wide * chunk[1])
        return chunk[0].astype(np.int64), chunk[1].astype(np.int64)

    @staticmethod
    def _grouped(chunks: list) -> Iterator[list]:
        """Small chunks together, so that each step works on many places."""
        some, size = [], 0
        for chunk in chunks:
            n = chunk[1] if isinstance(chunk[1], int) else len(chunk[0])
            if some and size + n > GROUP:
                yield some
                some, size = [], 0
            some.append(chunk)
            size += n
        if some:
            yield some

    def _joined(self, chunks: list) -> tuple[np.ndarray, np.ndarray]:
        pos, lcp = zip(*map(self._read, chunks), strict=True)
        return (pos[0], lcp[0]) if len(pos) == 1 else (np.concatenate(pos), np.concatenate(lcp))

    def drain(self, char: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """What is queued, in order; what is pushed meanwhile comes after it."""
        while chunks := self._chunks.pop(char, None):
            for some in self._grouped(chunks):
                self._held -= sum(c[0].nbytes + c[1].nbytes for c in some if not isinstance(c[1], int))
                yield self._joined(some)

    def read(self, char: int, back: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The chunks of a character, which stay; from the last one on if ``back``."""
        chunks = self._chunks.get(char, [])
        for some in self._grouped(chunks[::-1] if back else chunks):
            yield self._joined(some[::-1] if back else some)

    def __contains__(self, char: int) -> bool:
        return char in self._chunks

    def close(self) -> None:
        if self._file is not None:
            self._file.close()


def _on_disk(x: np.ndarray) -> np.ndarray:
    with tempfile.TemporaryFile() as file:
        x.tofile(file)
        file.flush()
        return np.memmap(file, x.dtype, "r", shape=x.shape)


def _is_s(text: np.ndarray, at_once: int = 1 << 20) -> np.ndarray:
    """Whether each suffix is smaller than the next one; the last one is not."""
    n = len(text)
    out, after = np.zeros(n, bool), False
    for stop in range(n - 1, 0, -at_once):
        start = max(0, stop - at_once)
        here, there = text[start:stop], text[start + 1 : stop + 1]
        # an equal neighbour has the type of the next suffix
        at = np.where(here != there, np.arange(stop - start, dtype=np.int32), np.int32(stop - start))
        at = np.minimum.accumulate(at[::-1])[::-1]
        out[start:stop] = np.append(here < there, after)[at]
        after = out[start]
    return out


def _run(text: np.ndarray, pos: int, most: int) -> int:
    """Length of the run of one character that starts here, ``most`` at most."""
    part = text[pos : pos + most]
    other = np.flatnonzero(part != part[0])
    return int(other[0]) if len(other) else len(part)


#: Characters of up to 9 bits to a 64-bit word.
PER_WORD = 7


#: Seeds that are sorted at once.
AT_ONCE = 1 << 19


def sorted_seeds(text: np.ndarray, seeds: np.ndarray, depth: int, at: int = 0, at_once: int = AT_ONCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Chunks of seeds, by their characters from ``at`` on, with the common prefixes of neighbours.

    The seeds agree on their first ``at`` characters. Too many for memory are dealt by
    the next character, and each part is sorted by itself.
    """
    if at >= depth:
        yield seeds, np.full(len(seeds), depth)
    elif len(seeds) > at_once:
        char = text[np.minimum(seeds + at, len(text) - 1)]
        for c in np.unique(char):
            fresh = True
            for part, lcp in sorted_seeds(text, seeds[char == c], depth, at + 1, at_once):
                if fresh:
                    lcp[0] = at  # with the last one under the character before
                fresh = False
                yield part, lcp
    elif len(seeds):
        seeds, lcp = _sorted_at_once(text, seeds, depth, at)
        lcp[0] = at
        yield seeds, lcp


def _sorted_at_once(text: np.ndarray, seeds: np.ndarray, depth: int, at: int) -> tuple[np.ndarray, np.ndarray]:
    """Two words settle most seeds; the rest of the words orders those that tie."""
    words, end = -(-(depth - at) // PER_WORD), len(text) - 1
    packed = []
    for w in range(words):
        word = np.zeros(len(seeds), np.uint64)
        for k in range(PER_WORD):
            place = seeds + (at + PER_WORD * w + k)
            char = text[np.minimum(place, end)].astype(np.uint64)
            if place[-1] > end:
                char[place > end] = 0
            word = (word << np.uint64(9)) | char
        packed.append(word)
    order = np.lexsort([-seeds, *packed[:2][::-1]])  # at the end of the text the shorter suffix is smaller
    head = [w[order] for w in packed[:2]]
    fresh = np.ones(len(seeds), bool)
    fresh[1:] = np.logical_or.reduce([w[1:] != w[:-1] for w in head])
    tied = ~fresh | ~np.append(fresh[1:], True)
    if tied.any():
        own, group = order[tied], np.cumsum(fresh)[tied]
        order[tied] = own[np.lexsort([-seeds[own], *[w[own] for w in packed[2:][::-1]], group])]
    lcp, open_ = np.full(len(seeds), at, np.int64), np.arange(1, len(seeds))
    for word in packed:
        word = word[order]
        apart = word[open_] ^ word[open_ - 1]
        same = np.full(len(open_), PER_WORD)
        for k in range(PER_WORD - 1, -1, -1):
            same[apart >> np.uint64(9 * (PER_WORD - 1 - k)) != 0] = k
        lcp[open_] += same
        open_ = open_[same == PER_WORD]
    seeds = seeds[order]
    lcp[1:] = np.minimum(lcp[1:], np.minimum(len(text) - np.maximum(seeds[1:], seeds[:-1]), depth))
    return seeds, lcp


class _Pass:
    """One direction of the induction."""

    def __init__(self, text: np.ndarray, wanted: np.ndarray, queues: DiskChunks, depth: int):
        self.text, self.wanted, self.queues, self.depth = text, wanted, queues, depth
        self.since = np.zeros(int(text.max()) + 1, np.int64)  # least common prefix since the last push

    def emit(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        """``pos`` comes next in the order; its left neighbours go to their queues."""
        inside = np.flatnonzero(pos > 0)
        inside = inside[self.wanted[pos[inside] - 1]]
        chars = self.text[pos[inside] - 1]
        overall = lcp.min()
        order = np.argsort(chars, kind="stable")
        inside, chars = inside[order], chars[order]
        cuts = np.flatnonzero(np.diff(chars)) + 1
        pushed = []
        for at in np.split(inside, cuts) if len(inside) else []:
            char = int(self.text[pos[at[0]] - 1])
            starts = np.concatenate([[0], at[:-1] + 1])
            least = np.minimum.reduceat(lcp[: at[-1] + 1], starts)
            least[0] = min(least[0], self.since[char])
            pushed.append((char, lcp[at[-1] + 1 :].min(initial=1 << 40)))
            self.queues.push(char, pos[at] - 1, np.minimum(least + 1, self.depth))
        self.since = np.minimum(self.since, overall)
        for char, after in pushed:
            self.since[char] = after


def suffixes(text: np.ndarray, depth: int, memory: int = 64 << 20, at_once: int = AT_ONCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Chunks of (position, common prefix with the suffix before), in suffix order.

    ``text`` is a non-empty array of uint16 below 512. The order and the common prefixes are those
    of the first ``depth`` characters; longer common prefixes are given as ``depth``.
    ``memory`` is the limit of each of the four stores, in bytes.
    """
    s = _is_s(text)
    if text.nbytes > memory:
        text, s = _on_disk(text), _on_disk(s)
    places = np.int32 if len(text) < 1 << 31 else np.int64
    chars = np.unique(text).tolist()
    seeds, queues, large, small = (DiskChunks(memory, places) for _ in range(4))
    for start in range(0, len(text), 1 << 22):
        part = s[max(0, start - 1) : start + (1 << 22)]
        at = np.flatnonzero(part[1:] & ~part[:-1]) + max(0, start - 1) + 1
        first = text[at]
        for c in np.unique(first).tolist():
            own = at[first == c]
            seeds.push(c, own, np.zeros(len(own)))

    def between(a: int, b: int) -> int:
        """Common prefix of the last L-suffix and the first S-suffix of a character."""
        return min(_run(text, a, depth), _run(text, b, depth))

    up = _Pass(text, ~s, queues, depth)
    queues.push(int(text[-1]), np.array([len(text) - 1]), np.array([0]))
    for c in chars:
        last = -1
        for pos, lcp in queues.drain(c):
            if last < 0:
                lcp = np.concatenate([[0], lcp[1:]])
            large.push(c, pos, lcp)
            up.emit(pos, lcp)
            last = pos[-1]
        if c in seeds:
            own = np.concatenate([pos for pos, _ in seeds.drain(c)])
            fresh = True
            for pos, lcp in sorted_seeds(text, own, depth, 1, at_once):
                if fresh:
                    lcp[0] = between(last, pos[0]) if last >= 0 else 0
                fresh = False
                up.emit(pos, np.minimum(lcp, depth))

    down = _Pass(text, s, queues, depth)
    for c in chars[::-1]:
        last = -1
        for pos, lcp in queues.drain(c):
            if last < 0:
                lcp = np.concatenate([[0], lcp[1:]])
            small.push(c, pos, lcp)
            down.emit(pos, lcp)
            last = pos[-1]
        after = None
        for pos, lcp in large.read(c, back=True):
            if after is None:
                after = between(pos[-1], last) if last >= 0 else 0
            down.emit(pos[::-1], np.concatenate([[after], lcp[1:][::-1]]))
            after = lcp[0]

    for c in chars:
        last = -1
        for pos, lcp in large.read(c):
            yield pos, lcp
            last = pos[-1]
        before = None
        for pos, lcp in small.read(c, back=True):
            pos, lcp = pos[::-1], lcp[::-1]
            if before is None:
                before = between(last, pos[0]) if last >= 0 else 0
            # going down, a common prefix stood with the larger suffix; going up it stands with the smaller one
            yield pos, np.concatenate([[before], lcp[:-1]])
            before = lcp[-1]
    for store in (seeds, queues, large, small):
        store.close()
