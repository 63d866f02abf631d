"""Byte-level BPE by ranks: a hierarchical-bitmap rank queue over a linked list of positions.

Every merge rank has a bucket of list positions; a two-level bitmap of ranks with buckets in use gives
the next rank by find-first-set in constant time, whatever the piece's length. Merges leave stale
entries behind, which are skipped when popped. Very long pieces therefore take time in proportion to
their length times the logarithm of the fullest bucket.

Cases: a null text counts as empty; an empty text has no ids; an empty table gives an empty result;
repeated rows are encoded each; columns other than doc_id and text are dropped by encode(), others than
doc_id and ids by decode(); a text of any length is encoded whole and decoded in slices.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidegauge.llm.chunks import ChunkCache, TwoAges
from tidegauge.llm.common import blob_lists, kept, lean, slices

#: Signs that the pattern never joins to letters before them.
_ENDS = frozenset(".,!?;:")
#: Ranks to a word of the lower level; the upper level has one word.
WIDE = 512
_BITS = [1 << i for i in range(WIDE)]


class RankEncoder:
    """encode(texts) -> per text the little-endian uint32 ids as bytes; tokens[id] are the bytes of an id."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, entries: int = 1_200_000):
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        most = max(ranks.values(), default=0)
        if most >= WIDE * WIDE:
            raise ValueError(f"ranks of {WIDE * WIDE} and more")
        self.buckets: dict[int, list[int]] = {}  # heaps of positions by rank
        self.words = [0] * (most // WIDE + 1)  # bitmap of the ranks in use
        self.cache = ChunkCache(self._many, entries)
        self.pieces = TwoAges(entries // 8)
        size = max(ranks.values(), default=-1) + 1
        self.tokens = [b""] * size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)]).astype(np.int64)
        self.blob = np.frombuffer(b"".join(self.tokens), np.uint8)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece: always the leftmost pair of the least rank is merged next.

        The queue stands inline, as calls would cost more than its work: a rank's bit is rank % WIDE of word
        rank // WIDE in `words`, and `top` has a bit for each word that isn't zero. All are empty at the end.
        """
        ranks, n, get = self.ranks, len(piece), self.ranks.get
        if (whole := get(piece)) is not None:
            return [whole]
        buckets, words, bits, top = self.buckets, self.words, _BITS, 0
        after = list(range(1, n + 2))  # after[i]: start of the part that follows the part at i
        before = list(range(-1, n))
        now = list(map(get, [piece[i : i + 2] for i in range(n - 1)], repeat(-1)))  # rank of the pair that starts at i
        new = [(r, i) for i, r in enumerate(now) if r >= 0]
        now += (-1, -1)
        while True:
            for r, i in new:  # push
                if r in buckets:
                    heappush(buckets[r], i)
                    continue
                buckets[r] = [i]
                k = r // WIDE
                if not words[k]:
                    top |= bits[k]
                words[k] |= bits[r % WIDE]
            if not top:
                break
            k = (top & -top).bit_length() - 1  # pop: find the first bit on both levels
            word = words[k]
            first = word & -word
            r = k * WIDE + first.bit_length() - 1
            bucket = buckets[r]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                del buckets[r]
                i = bucket[0]
                words[k] = word = word ^ first
                if not word:
                    top ^= bits[k]
            new = ()
            if now[i] != r:
                continue  # stale
            gone = after[i]
            end = after[gone]
            after[i] = end
            now[gone] = -1
            if end < n:
                before[end] = i
                now[i] = r = get(piece[i : after[end]], -1)
                if r >= 0:
                    new = ((r, i),)
            else:
                now[i] = -1
            left = before[i]
            if left >= 0:
                now[left] = r = get(piece[left:end], -1)
                if r >= 0:
                    new = (*new, (r, left))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def _ids(self, piece: str) -> bytes:
        return array("I", self.merge(piece.encode())).tobytes()

    def _piece(self, piece: str) -> bytes:
        return self.pieces.get(piece) or self.pieces.put(piece, self._ids(piece))

    def _word(self, chunk: str) -> bytes:
        """A chunk of letters, which may be known without the sign that followed it."""
        return (self.cache.inner.get(chunk[1:]) if chunk[0] == " " else None) or self._ids(chunk)

    def _chunk(self, chunk: str) -> bytes:
        bare = chunk[1:] if chunk[:1] == " " else chunk
        if bare.isascii():  # letters of other scripts are left to the pattern's own tables
            if bare.isalpha():
                return self._ids(chunk)
            if bare[-1:] in _ENDS and bare[:-1].isalpha():
                return self._word(chunk[:-1]) + self._piece(chunk[-1])
        return b"".join(map(self._piece, self.find(chunk)))

    def _many(self, chunks: list[str]) -> list[bytes]:
        return list(map(self._chunk, chunks))

    def encode(self, texts: list[str]) -> list[bytes]:
        return [b"".join(v) for v in self.cache.encode(texts)]

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of ids, gathered from the vocabulary's bytes laid end to end."""
        out = []
        for a in range(0, len(ids), 1 << 18):  # the index takes 16 bytes for each byte of a slice
            some = ids[a : a + (1 << 18)]
            lengths = self.lengths[some]
            ends = np.cumsum(lengths)
            index = np.repeat(self.starts[some] - (ends - lengths), lengths)
            index += np.arange(ends[-1])
            out.append(self.blob[index].tobytes())
        return b"".join(out)


def encoder(path: str, pattern: str) -> RankEncoder:
    """One for each worker process and rank file (base64 of the bytes, a space, the rank)."""

    def make() -> RankEncoder:
        with open(path, "rb") as lines:
            return RankEncoder({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)

    return kept(("ranks", path), make)


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, ids array<int>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(ranks_path, pattern)
        for batch in slices(batches, "text"):
            ids = own.encode([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), blob_lists(ids, pa.int32(), 4)], ["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType
    return docs.select("doc_id", "text").mapInArrow(lean(run, ("ranks", ranks_path)), T.StructType([T.StructField("doc_id", kind), T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """encoded(doc_id, ids) -> doc_id, ids, data binary: the bytes that the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(ranks_path, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                lists = batch.column("ids")
                flat, offsets = np.asarray(lists.values), np.asarray(lists.offsets)
                data = [own.decode(flat[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array(data, pa.binary())], ["doc_id", "ids", "data"])

    return encoded.mapInArrow(lean(run, ("ranks", ranks_path)), T.StructType([*encoded.select("doc_id", "ids").schema.fields, T.StructField("data", T.BinaryType())]))
