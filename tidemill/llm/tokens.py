"""Token ids of whole texts by a public tokenizer."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from functools import cache

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: A letter or digit before marks, which are then a token group of their own.
BEFORE_MARKS = re.compile(rb"([a-z0-9]|\xc3[\x9f-\xb6\xb8-\xbf])(?=[.,;:!?#$%&*])")
#: Longer parts are not kept.
LONGEST = 24


class WordTokenizer:
    """Token ids of texts as little-endian unsigned 32-bit bytes.

    The vocabulary lower-cases, drops white space and joins neither across white space
    nor across the border of letters and marks, so the ids of a text are those of its
    parts. Its markers, as <|endoftext|>, are known in lower case only, before it
    lower-cases the rest. A part of letters alone is one word, whose last token alone
    has the suffix of a word's end: many such parts are encoded as one text and cut at
    these tokens. The first ``kept`` short parts that are seen stay in a table; others
    are encoded once for each group of texts.
    """

    def __init__(self, path: str | None = None, kept: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        import public_tokenizers
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path or public_tokenizers.path("word_bpe_49k.json"))
        self._kept, self._parts = kept, {}
        vocabulary = self._tokenizer.get_vocab()
        self._ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self._ends[[k for token, k in vocabulary.items() if token.endswith("</w>")]] = True

    def _ids(self, parts: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Parts and their ids; what an encoding holds beside its ids is large, so 2000 are encoded at once."""
        import numpy as np

        words, single = [], []
        for part, text in zip(parts, b"\n".join(parts).decode().split("\n"), strict=True):
            (words if text.isalpha() else single).append((part, text))
        for k in range(0, len(words), 2000):
            some = words[k : k + 2000]
            got = np.array(self._tokenizer.encode_batch_fast([" ".join([t for _, t in some])], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self._ends[got]) + 1
            if len(ends) != len(some):  # a letter became a letter and a mark, so a part has two words
                single += some
                continue
            raw, at = got.tobytes(), 0
            for (part, _), end in zip(some, (4 * ends).tolist(), strict=True):
                yield part, raw[at:end]
                at = end
        for k in range(0, len(single), 2000):
            some = single[k : k + 2000]
            for (part, _), e in zip(some, self._tokenizer.encode_batch_fast([t for _, t in some], add_special_tokens=False), strict=True):
                yield part, np.array(e.ids, "<u4").tobytes()

    def encode(self, texts: Iterable[str | None], at_once: int = 400) -> Iterator[bytes]:
        texts = list(texts)
        for k in range(0, len(texts), at_once):
            yield from self._encode(texts[k : k + at_once])

    def _encode(self, texts: list[str | None]) -> Iterator[bytes]:
        split = []
        for text in texts:
            raw = (text or "").encode()
            split.append(raw.split() if b"<|" in raw else BEFORE_MARKS.sub(rb"\1 ", raw.translate(LOWER)).split())
        known = self._parts
        here, fresh = {}, []
        for p in set().union(*split):
            if (ids := known.get(p)) is None:
                fresh.append(p)
            else:
                here[p] = ids
        room = self._kept - len(known)
        for p, ids in self._ids(fresh) if fresh else ():
            here[p] = ids
            if room > 0 and len(p) <= LONGEST:
                known[p] = ids
                room -= 1
        for parts in split:
            yield b"".join([here[p] for p in parts])


@cache
def word_tokenizer(path: str | None = None) -> WordTokenizer:
    """One tokenizer for all tasks of a Python worker."""
    return WordTokenizer(path)
