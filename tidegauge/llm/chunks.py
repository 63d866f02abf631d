"""Whole-text tokenisation through a cache of space-separated chunks.

Both tokenizer families used here match a pattern from left to right and apply merges to each match
alone. No match crosses the border between a non-space character and a following space, and the
patterns' only look-ahead concerns the white space that starts a chunk. A text cut at every space
that follows a non-space character therefore encodes to the concatenation of its chunks' encodings,
so each distinct chunk is encoded once per worker and looked up afterwards.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

#: A space that doesn't follow other white space. Python's \s is a superset of the tokenizers' \s.
_CUT = re.compile(r"(?<!\s) ")

#: Chunks longer than this many characters are encoded but never kept.
LONGEST_KEPT = 24


class TwoAges:
    """A bounded mapping that keeps what is used: when the young half is full it becomes the old one."""

    def __init__(self, entries: int):
        self.entries = entries
        self.young: dict[str, object] = {}
        self.old: dict[str, object] = {}

    def get(self, key: str):
        value = self.young.get(key)
        if value is None:
            value = self.old.get(key)
            if value is not None:
                self.put(key, value)
        return value

    def put(self, key: str, value):
        if len(self.young) >= self.entries // 2:
            self.old, self.young = self.young, {}
        self.young[key] = value
        return value


class ChunkCache:
    """Maps texts to lists of encoded chunks. encode_many: list of strings -> list of values.

    entries bounds the memory; what is forgotten is encoded again, with the same result.
    """

    def __init__(self, encode_many: Callable[[list[str]], list], entries: int):
        self.encode_many = encode_many
        self.inner = TwoAges(entries)

    def encode(self, texts: Iterable[str]) -> list[list]:
        """One list of chunk values per text, in order; an empty text has the values of ''."""
        cut = [t.split(" ") for t in texts]  # chunks without the space that starts each but the first
        get, old = self.inner.young.get, self.inner.old
        out, again, missing = [], {}, set()
        for k, parts in enumerate(cut):
            got = list(map(get, parts))
            gaps = _gaps(got)
            if any(_unsafe(parts[i]) for i in gaps):  # such chunks are never kept, so they show here
                cut[k] = parts = _CUT.split(" ".join(parts))
                got = list(map(get, parts))
                gaps = _gaps(got)
            for i in gaps:
                p = parts[i]
                if p not in again and p not in missing:
                    if (v := old.get(p)) is not None:
                        again[p] = v
                    else:
                        missing.add(p)
            out.append((got, gaps))
        if missing:
            names = list(missing)
            again.update(zip(names, self.encode_many([" " + p for p in names]), strict=True))
        put = self.inner.put
        for p, v in again.items():
            if len(p) <= LONGEST_KEPT and not _unsafe(p):
                put(p, v)
        firsts = self.encode_many([parts[0] for parts in cut])
        for parts, (got, gaps), first in zip(cut, out, firsts, strict=True):
            for i in gaps:
                got[i] = again[parts[i]]
            got[0] = first  # no space before it
        return [got for got, _ in out]


def _unsafe(part: str) -> bool:
    """Whether the space behind this part follows other white space."""
    return not part or part[-1].isspace()


def _gaps(got: list) -> list[int]:
    gaps, i = [], -1
    try:
        while True:
            i = got.index(None, i + 1)
            gaps.append(i)
    except ValueError:
        return gaps
