"""Vector code compression: product codes from integer k-means, nearest entries by annular norm pruning.

Components become integers, vectors are cut into equal consecutive parts, and every part position has a
codebook that starts as that part of the vectors with the least ids. A codebook's entries are sorted by norm.
For a part, the entry whose norm is nearest gives a first distance r; only entries whose norm differs from the
part's by at most r can be as near, so a binary search gives their interval, and just this annulus is evaluated,
in exact integers, outward from the first entry; each better distance narrows it again.

Each round reads the vectors once where they lie. Tasks send sums and counts of their parts, which Spark adds up; the
driver holds the codebooks alone (entries x length of a vector). No vector is shuffled; a task that runs again
sends the same sums. Sums are exact at any size: they travel in limbs of 30 bits.

Cases: vectors that are null or hold null or non-finite components are dropped; rows that repeat an id all count, in
order of id (null last) and vector; with fewer vectors than entries there are fewer entries; a length that the parts don't
divide gives parts that differ by one; vectors of another length than the first one's get neither code nor error and train
nothing; components of any size are exact, errors beyond 64 bits are null, and so is a label's sum then; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import dropped, lean, written

Entries = list[list[int]]
LIMB = 30


class Codebook:
    """The entries of one part position, in order of norm."""

    def __init__(self, entries: Entries) -> None:
        self.entries = entries
        self.norms = sorted((math.isqrt(sum(y * y for y in e)), i) for i, e in enumerate(entries))
        self.most = math.isqrt(2**62 // max(1, len(entries[0]))) // 2  # squares of parts below this stay in 64 bits
        self.small = all(abs(y) < self.most for e in entries for y in e)
        if self.small:
            exact = np.array(entries, np.int64).reshape(len(entries), -1)
            square = (exact * exact).sum(1)
            self.order = np.lexsort((np.arange(len(entries)), square))
            self.sorted, self.radii = exact[self.order], np.sqrt(square[self.order].astype(float))

    def nearest(self, x: list[int]) -> tuple[int, int]:
        """(squared distance, entry) of one part of any size."""
        n = math.isqrt(sum(v * v for v in x))
        far = lambda k: (sum((v - y) ** 2 for v, y in zip(x, self.entries[k], strict=True)), k)
        at = min(bisect_left(self.norms, (n, -1)), len(self.norms) - 1)
        best = far(self.norms[at][1])
        lo, hi = self.interval(n, best[0])
        for step in range(1, len(self.norms)):
            for k in (at + step, at - step):
                if lo <= k < hi and (found := far(self.norms[k][1])) < best:
                    best = found
                    lo, hi = self.interval(n, best[0])
        return best

    def interval(self, norm: int, square: int) -> tuple[int, int]:
        """Entries whose norm can differ from a part's by no more than a distance; norms are rounded down, hence the 2."""
        r = math.isqrt(square) + 2
        return bisect_left(self.norms, (norm - r, -1)), bisect_right(self.norms, (norm + r, len(self.norms)))

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entries and squared distances of the rows of x, all components of which are below `most` in size."""
        n = np.sqrt((x * x).sum(1).astype(float))
        at = np.clip(np.searchsorted(self.radii, n), 0, len(self.radii) - 1)
        before = np.maximum(at - 1, 0)
        at = np.where(n - self.radii[before] < self.radii[at] - n, before, at)
        best, entry = ((x - self.sorted[at]) ** 2).sum(1), self.order[at].copy()

        def interval(rows: np.ndarray | slice) -> tuple[np.ndarray, np.ndarray]:
            r = np.sqrt(best[rows].astype(float))
            r += 1e-9 * (1 + r + n[rows])  # more than rounding can take away
            return np.searchsorted(self.radii, n[rows] - r, "left"), np.searchsorted(self.radii, n[rows] + r, "right")

        lo, hi = interval(slice(None))
        for step in range(1, len(self.radii)):
            for k in (at + step, at - step):
                rows = np.flatnonzero((lo <= k) & (k < hi))
                if not len(rows):
                    continue
                d, e = ((x[rows] - self.sorted[k[rows]]) ** 2).sum(1), self.order[k[rows]]
                won = (d < best[rows]) | ((d == best[rows]) & (e < entry[rows]))
                rows = rows[won]
                best[rows], entry[rows] = d[won], e[won]
                lo[rows], hi[rows] = interval(rows)
        return entry, best


def edges(d: int, parts: int) -> list[int]:
    return [k * d // parts for k in range(parts + 1)]


def whole(x: float, factor: int) -> int:
    """floor(factor * x) of any finite number."""
    return int(x) * factor if abs(x) >= 2**53 else math.floor(x * factor)


class Vectors:
    """The vectors of a batch that have the length d, as integers: `small` rows in 64 bits, the others as Python's."""

    def __init__(self, lists: pa.Array, d: int, factor: int, most: int) -> None:
        ends = np.cumsum(lengths := np.asarray(lists.value_lengths()))
        self.rows = np.flatnonzero(lengths == d)
        flat = np.asarray(lists.flatten(), float)
        real = flat[(ends[self.rows] - d)[:, None] + np.arange(d)] if len(self.rows) else np.zeros((0, d))
        self.fits = (np.abs(real) < most // (2 * factor)).all(1)
        self.small = np.floor(factor * real[self.fits]).astype(np.int64)
        self.wide = [[whole(x, factor) for x in v] for v in real[~self.fits].tolist()]


def valid(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col(column).isNotNull() & ~F.coalesce(bad, F.lit(False)))


def parts_of(found: Vectors, books: list[Codebook], cuts: list[int]) -> Iterator[tuple[np.ndarray, list[list[int]], list[int], list[int]]]:
    """For each part position: its small rows, its other rows, and entries and squared distances of both, small rows first."""
    for book, a, b in zip(books, cuts, cuts[1:], strict=False):
        x, wide = found.small[:, a:b], [v[a:b] for v in found.wide]
        if not book.small:
            wide, x = x.tolist() + wide, x[:0]
        entry, square = book.assign(x) if len(x) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        others = [book.nearest(v) for v in wide]
        yield x, wide, entry.tolist() + [k for _, k in others], square.tolist() + [s for s, _ in others]


def fit(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, factor: int = 4096) -> list[Entries]:
    """vectors(vec_id, embedding) -> codebooks by part position; empty without vectors. The table is read once a round."""
    kept = valid(vectors).select("vec_id", "embedding")
    first = [r["embedding"] for r in kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).collect()]
    if not first:
        return []
    d = len(first[0])
    cuts = edges(d, parts)
    start = [[whole(x, factor) for x in v] for v in first if len(v) == d]
    books = [[v[a:b] for v in start] for a, b in zip(cuts, cuts[1:], strict=False)]
    for _ in range(rounds):
        means = _means(kept, books, cuts, factor)
        renewed = [[means.get((p, k), e) for k, e in enumerate(book)] for p, book in enumerate(books)]
        if renewed == books:
            break  # the rounds left would change nothing
        books = renewed
    return books


def _means(kept: DataFrame, books: list[Entries], cuts: list[int], factor: int) -> dict[tuple[int, int], list[int]]:
    """Componentwise floor(sum / count) of the parts that each entry is nearest to."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [Codebook(b) for b in books]
        sums: dict[tuple[int, int, int], int] = defaultdict(int)  # position -1 holds counts
        for batch in batches:
            found = Vectors(batch.column(0), cuts[-1], factor, min(t.most for t in tables))
            for p, (x, wide, entry, _) in enumerate(parts_of(found, tables, cuts)):
                for k in set(entry[: len(x)]):
                    rows = x[np.array(entry[: len(x)]) == k]
                    sums[p, k, -1] += len(rows)
                    for j, s in enumerate(rows.sum(0).tolist()):
                        sums[p, k, j] += s
                for k, v in zip(entry[len(x) :], wide, strict=True):
                    sums[p, k, -1] += 1
                    for j, s in enumerate(v):
                        sums[p, k, j] += s
        limbs = [(*key, i, part) for key, s in sums.items() for i, part in enumerate(split_limbs(s))]
        if limbs:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*limbs, strict=True)], ["p", "k", "j", "i", "s"])

    totals: dict[tuple[int, int, int], int] = defaultdict(int)
    for r in kept.select("embedding").mapInArrow(lean(add), "p long, k long, j long, i long, s long").groupBy("p", "k", "j", "i").agg(F.sum("s").alias("s")).collect():
        totals[r["p"], r["k"], r["j"]] += r["s"] << (LIMB * r["i"])
    widths = [b - a for a, b in zip(cuts, cuts[1:], strict=False)]
    return {(p, k): [totals[p, k, j] // n for j in range(widths[p])] for (p, k, at), n in list(totals.items()) if at == -1}


def split_limbs(s: int) -> list[int]:
    sign, s, out = (-1 if s < 0 else 1), abs(s), []
    while s or not out:
        out.append(sign * (s & ((1 << LIMB) - 1)))
        s >>= LIMB
    return out


def encode(vectors: DataFrame, books: list[Entries], factor: int = 4096) -> DataFrame:
    """vectors(vec_id, label, embedding) -> vec_id, label, code (indexes in part order, two hex digits each), error."""
    d = sum(len(b[0]) for b in books)
    cuts = edges(d, len(books)) if books else []

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [Codebook(b) for b in books]
        for batch in batches:
            found = Vectors(batch.column("embedding"), d, factor, min(t.most for t in tables))
            order = np.concatenate([found.rows[found.fits], found.rows[~found.fits]])
            codes, errors = [[None] * batch.num_rows for _ in range(2)]
            said, total = [[] for _ in order], [0] * len(order)
            for _, _, entry, square in parts_of(found, tables, cuts):
                for i, (k, s) in enumerate(zip(entry, square, strict=True)):
                    said[i].append(k)
                    total[i] += s
            for row, ks, s in zip(order.tolist(), said, total, strict=True):
                codes[row], errors[row] = "".join(f"{k:02x}" for k in ks), s if s < 2**63 else None
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(codes, pa.string()), pa.array(errors, pa.int64())], ["vec_id", "label", "code", "error"])

    kept = valid(vectors).select("vec_id", "label", "embedding")
    types = dict(kept.dtypes)
    return kept.mapInArrow(lean(code), f"vec_id {types['vec_id']}, label {types['label']}, code string, error long") if books else kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))


def with_label_errors(coded: DataFrame) -> DataFrame:
    """Adds label_error, the error summed over equal labels; null labels are together. The sums are written, so that their
    size is known when Spark chooses how to join them; equal labels are one row there, so that a hot label can be split."""
    coded = written(coded, "codes")
    wide = F.bool_or(F.col("code").isNotNull() & F.col("error").isNull())
    sums = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("s"), wide.alias("wide"))
    sums = written(sums.select(F.col("label").alias("_l"), F.when(~F.col("wide"), F.col("s").try_cast("long")).alias("label_error")), "label_errors")
    return coded.join(sums, coded["label"].eqNullSafe(sums["_l"]), "left").drop("_l")


def digest(books: list[Entries]) -> str:
    """Of all entries' components by part, entry and position."""
    return hashlib.sha256(",".join(str(y) for book in books for e in book for y in e).encode()).hexdigest()
