"""N-gram Jaccard join: which texts share at least a given part of their word n-grams, exactly.

1. A count sketch of all n-grams (fixed width, so its size doesn't grow) orders n-grams rare first; the
   order decides the work, never the result.
2. A text's profile: number of distinct n-grams, a hash of the set, its prefix (the first of its n-grams in
   that order, as many as guarantee a common one in any linked pair) and a histogram of n-gram hashes.
   Equal sets collapse into one row by aggregation.
3. Texts are joined on prefix n-grams. Groups of texts with the same n-gram and the same members (equal size,
   sum of 40-bit hashes and xor of other 64-bit hashes of the members) are kept once. In a group, pairs must
   pass the length filter, the positional filter and a bound from the histograms. A search over the group writes a spanning
   forest of the pairs that pass, never the pairs; groups above `block` members are dealt out as pairs of blocks.
   Linked texts always end up in one cluster of that forest, so a cluster is a part of the join that one task can do.
4. In a cluster, now with whole sets in the same order, texts meet on prefix n-grams only: a pair is looked at
   once, at its first common n-gram, must pass the length, positional and suffix filters, and is then verified
   unless the search has joined it before. Large clusters (by members or by n-grams) go out as pairs of blocks; a
   pair inside a block is looked at in one of them.
5. Components of verified links, mapped back to all rows.

A set's hash has 64 bits: among a billion different texts two count as equal with a chance of some 3 %.

Cases: null text counts as empty; a text with fewer words than n has its whole word sequence as its one
n-gram; a text without words has an empty set and links with nothing; repeated rows have equal sets and link; an
empty table gives no rows; null ids keep their rows and never name a component; texts of any length are handled
whole (a text above PART bytes stands alone in its slice); other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import dropped, lean, slices, written
from tidegauge.llm.components import components, starred

_RANDOM = np.random.default_rng(20250310)
_BYTE = _RANDOM.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_BASE = int(_RANDOM.integers(2**62, 2**63)) | 1
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
#: Slots of each of the two rows of the sketch; buckets of a histogram; bytes of text handled at once.
SLOTS, BUCKETS, PART, STRIPES = 1 << 19, 256, 1_000_000, 16


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, pow(_BASE, -1, 2**64)):
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps))
    return out[0], out[1]


def shingles(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's word n-grams."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    sizes = np.array([len(t) + 1 for t in texts])
    firsts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    gap = _GAP[data]
    edge = np.flatnonzero(np.diff(gap, prepend=True))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return [np.zeros(0, np.uint64) for _ in texts]
    power, inverse = _powers(1 << max(PART.bit_length(), len(data).bit_length()))
    total = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[data] * power[: len(data)])])
    words = _mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    first_word = np.searchsorted(starts, firsts)
    counts = np.diff(np.append(first_word, len(starts)))
    h = np.zeros(len(words), np.uint64)
    for k in range(min(n, len(words))):
        h[: len(words) - k] = h[: len(words) - k] * np.uint64(_BASE) + words[k:]
    h = _mix(h)
    out = []
    for a, m in zip(first_word.tolist(), counts.tolist(), strict=True):
        if m >= n:
            out.append(np.unique(h[a : a + m - n + 1]))
        elif m:
            whole = np.uint64(m)
            with np.errstate(over="ignore"):
                for w in words[a : a + m]:
                    whole = whole * np.uint64(_BASE) + w
            out.append(_mix(np.array([whole], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _slots(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (h & np.uint64(SLOTS - 1)).astype(np.int64), (h >> np.uint64(40) & np.uint64(SLOTS - 1)).astype(np.int64)


def sketch(docs: DataFrame, n: int) -> np.ndarray:
    """Count sketch of all texts' distinct n-grams: 2 x SLOTS counts, whatever the input's size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for batch in slices(batches, "text", PART):
            h = np.concatenate(shingles([(t or "").encode() for t in batch.column("text").to_pylist()], n))
            got = np.stack([np.bincount(x, minlength=SLOTS) for x in _slots(h)]).astype(np.uint32)
            sums = got if sums is None else sums + got
        if sums is not None:
            parts = sums.reshape(2 * STRIPES, -1)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], ["stripe", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(batch.column("stripe").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                got = np.frombuffer(x, np.uint32).astype(np.uint64)
                sums[k] = sums[k] + got if k in sums else got
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([np.minimum(v, 2**32 - 1).astype(np.uint32).tobytes() for v in sums.values()], pa.binary())], ["stripe", "counts"])

    kind = "stripe long, counts binary"
    rows = docs.select("text").mapInArrow(lean(count), kind).repartition(2 * STRIPES, "stripe").mapInArrow(lean(add), kind).collect()  # 4 MB in all
    out = np.zeros((2 * STRIPES, SLOTS // STRIPES), np.uint32)
    for r in rows:
        out[r["stripe"]] = np.frombuffer(r["counts"], np.uint32)
    return out.reshape(2, SLOTS)


def histogram(s: np.ndarray) -> np.ndarray:
    """Counts of hashes by bucket, held at 255: distances of two such histograms are never above the sets' distance."""
    return np.minimum(np.bincount((s >> np.uint64(34)).astype(np.int64) % BUCKETS, minlength=BUCKETS), 255).astype(np.uint8)


class Order:
    """Rare first: a key whose high bits are the estimated frequency's class and whose others come from the hash."""

    def __init__(self, counts: np.ndarray):
        self.classes = np.minimum(4 * np.log2(counts.astype(np.float64) + 1), 62).astype(np.uint8)

    def keys(self, h: np.ndarray) -> np.ndarray:
        a, b = _slots(h)
        return np.minimum(self.classes[0][a], self.classes[1][b]).astype(np.uint64) << np.uint64(57) | h >> np.uint64(7)


def blocks(rows: DataFrame, count: Column, member: str) -> DataFrame:
    """Deals the rows of a group to `count` blocks. Adds o, the row's block; i and j: (0, 0) for one block, else every pair of
    blocks that o is in; own: whether (i, j) is where pairs inside o are looked at."""
    n = F.greatest(count.cast("int"), F.lit(1))
    dealt = rows.withColumn("_n", n).withColumn("o", F.when(F.col("_n") > 1, F.pmod(F.xxhash64(member), F.col("_n")).cast("int")).otherwise(0))
    other = F.explode(F.when(F.col("_n") > 1, F.filter(F.sequence(F.lit(0), F.col("_n") - 1), lambda x: x != F.col("o"))).otherwise(F.array(F.lit(0))))
    dealt = dealt.withColumn("_p", other).withColumn("i", F.least("o", "_p")).withColumn("j", F.greatest("o", "_p"))
    return dealt.withColumn("own", F.expr("i = j OR (o = i AND j = i + 1) OR (o = j AND i = _n - 2 AND j = _n - 1)")).drop("_n", "_p")


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Rows with equal first `keys` columns, one group after another; a group holds two blocks at most."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[-1][:keys] != row[:keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _forest(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> Iterator[tuple[int, int]]:
    """Links of a spanning forest; near(i, others) tells which of the others i links with."""
    left = np.arange(n)
    while len(left) > 1:
        todo, left = [int(left[0])], left[1:]
        while todo and len(left):
            i = todo.pop()
            hit = near(i, left)
            for k in left[hit].tolist():
                yield i, k
                todo.append(k)
            left = left[~hit]


def _pairs(links: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*links, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after another."""
    sizes = ends - starts
    return np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())


class Join:
    """Whole sets of one cluster, joined on prefix n-grams. block and own: each set's block, and whether pairs inside it are looked at here."""

    PROBES = 7

    def __init__(self, sets: list[np.ndarray], order: Order, percent: int, block: np.ndarray, own: np.ndarray):
        self.percent, self.block, self.own = percent, block, own
        self.size = size = np.array([len(s) for s in sets])
        known, at = np.unique(np.concatenate(sets), return_inverse=True)
        rank = np.empty(len(known), np.int64)
        rank[np.lexsort((known, order.keys(known)))] = np.arange(len(known))
        self.width = width = len(known)
        owner = np.repeat(np.arange(len(sets)), size)
        self.code = owner * width + rank[at]  # n-grams numbered rare first, each set's own in a row
        self.code.sort()
        self.first = np.concatenate([[0], np.cumsum(size)])
        self.prefix = size - -(-percent * size // 100) + 1
        live = _ranges(self.first[:-1], self.first[:-1] + self.prefix)
        gram = self.code[live] - owner[live] * width
        by = np.argsort(gram, kind="stable")
        self.who, self.at = owner[live][by], (live - self.first[owner[live]])[by]
        self.starts = np.searchsorted(gram[by], np.arange(width + 1))
        self.wanted, self.mark = np.zeros(len(sets), bool), np.zeros(width, np.int32)
        self.verified: list[tuple[int, int]] | None = None  # a list here is told every pair that is verified

    def ids(self, i: int) -> np.ndarray:
        return self.code[self.first[i] : self.first[i + 1]] - i * self.width

    def near(self, i: int, others: np.ndarray) -> np.ndarray:
        grams = self.ids(i)[: self.prefix[i]]
        a, b = self.starts[grams], self.starts[grams + 1]
        met = _ranges(a, b)
        who, first = np.unique(self.who[met], return_index=True)  # rare first, so the first place is that of the first common n-gram
        p, q = np.repeat(np.arange(len(grams)), b - a)[first], self.at[met][first]
        self.wanted[others if self.own[i] else others[self.block[others] != self.block[i]]] = True
        ok = self.wanted[who]
        self.wanted[others] = False
        small, large = np.minimum(self.size[who], self.size[i]), np.maximum(self.size[who], self.size[i])
        need = -(-self.percent * (small + large) // (100 + self.percent))
        ok &= 100 * small >= self.percent * large
        rest, rest_other = self.size[i] - p - 1, self.size[who] - q - 1
        ok &= 1 + np.minimum(rest, rest_other) >= need
        some = np.flatnonzero(ok)
        ok[some] = self._apart(i, who[some], p[some], q[some]) <= (rest + rest_other - 2 * (need - 1))[some]
        some = np.flatnonzero(ok)
        if self.verified is not None:
            self.verified += [(i, k) for k in who[some].tolist()]
        ok[some] = self._common(i, who[some]) >= need[some]
        self.wanted[who[ok]] = True
        linked = self.wanted[others]
        self.wanted[who[ok]] = False
        return linked

    def _apart(self, i: int, who: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Suffix filter: a lower bound of the distance between what follows the common n-gram in both sets. n-grams of
        set i at even steps cut both suffixes; parts of different sizes can't have all their n-grams in common."""
        own = self.ids(i)
        at = np.unique(np.linspace(0, len(own) - 1, self.PROBES + 2).astype(int)[1:-1])
        there = np.searchsorted(self.code, who[:, None] * self.width + own[at]) - self.first[who][:, None]
        here = np.concatenate([p[:, None] + 1, np.maximum(at, p[:, None] + 1), np.full((len(who), 1), self.size[i])], 1)
        there = np.concatenate([q[:, None] + 1, np.maximum(there, q[:, None] + 1), self.size[who][:, None]], 1)
        return np.abs(np.diff(here, axis=1) - np.diff(there, axis=1)).sum(1)

    def _common(self, i: int, who: np.ndarray) -> np.ndarray:
        """Number of n-grams that i has in common with each of the others."""
        own, out = self.ids(i), []
        self.mark[own] = 1
        for a in range(0, len(who), 500):
            some = who[a : a + 500]
            places = _ranges(self.first[some], self.first[some + 1])
            ends = np.cumsum(self.size[some])
            out.append(np.add.reduceat(self.mark[self.code[places] - np.repeat(some, self.size[some]) * self.width], ends - self.size[some]))
        self.mark[own] = 0
        return np.concatenate(out) if out else np.zeros(0, int)


def classes(docs: DataFrame, n: int = 4, percent: int = 85, block: int = 4000) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id (the least doc_id reachable by links), text_hash and label: a
    number that the texts of a component have in common, whatever their ids; null for texts without words."""
    key = docs.schema["doc_id"].dataType.simpleString()
    order = Order(sketch(docs, n))

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", PART):
            sets = shingles([(t or "").encode() for t in batch.column("text").to_pylist()], n)
            sizes, marks, hists, grams = [], [], [], []
            for s in sets:
                size = len(s)
                sizes.append(size)
                if not size:
                    marks.append(None), hists.append(None), grams.append([])
                    continue
                marks.append(int(_mix(s * np.uint64(_BASE) + np.uint64(size)).sum(dtype=np.uint64).view(np.int64)))
                hists.append(histogram(s).tobytes())
                prefix = size - -(-percent * size // 100) + 1
                keys = order.keys(s)
                grams.append(np.sort(np.partition(keys, prefix - 1)[:prefix] if prefix < size else keys)[:prefix].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(sizes, pa.int64()), pa.array(marks, pa.int64()), pa.array(hists, pa.binary()), pa.array(grams, pa.list_(pa.int64()))], ["doc_id", "h", "n", "mark", "hist", "grams"])

    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    profiles = written(hashed.mapInArrow(lean(profile), f"doc_id {key}, h long, n long, mark long, hist binary, grams array<long>"), "profiles")
    sets = written(profiles.where("n > 0").groupBy("mark").agg(F.first("n").alias("n"), F.first("hist").alias("hist"), F.first("grams").alias("grams"), F.min("doc_id").alias("doc_id"), F.min(F.struct("doc_id", "h")).alias("own")), "sets")
    rows = sets.select("mark", "n", F.posexplode("grams").alias("at", "gram"))
    groups = rows.groupBy("gram").agg(F.count("*").alias("m"), F.min("n").alias("n0"), F.max("n").alias("n1"), F.sum(F.pmod(F.xxhash64("mark"), F.lit(2**40))).alias("who"), F.bit_xor(F.xxhash64(F.lit(1), "mark")).alias("also")).where("m > 1")
    kept = written(groups.groupBy("m", "who", "also").agg(F.min("gram").alias("gram")).select("gram", "m"), "groups")
    live = written(rows.join(kept.hint("merge"), "gram"), "live")  # both sides deal their keys out, at every size; large keys are split
    dealt = blocks(live.join(sets.select("mark", "hist"), "mark").select("gram", "mark", "n", "at", "m", "hist"), F.ceil(F.col("m") / F.lit(float(block))), "mark")
    dealt = dealt.select("gram", "i", "j", "mark", "n", "at", "hist", "o", "own").repartition("gram", "i", "j").sortWithinPartitions("gram", "i", "j")

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for group in _runs(batches, 3):
            if len(group) < 2:
                continue
            marks = [r[3] for r in group]
            size = np.array([r[4] for r in group])
            at = np.array([r[5] for r in group])
            hist = np.frombuffer(b"".join(r[6] for r in group), np.uint8).reshape(len(group), BUCKETS).astype(np.int16)
            part, own = np.array([r[7] for r in group]), [r[8] for r in group]

            def near(i: int, others: np.ndarray) -> np.ndarray:
                small, large = np.minimum(size[others], size[i]), np.maximum(size[others], size[i])
                need = -(-percent * (size[others] + size[i]) // (100 + percent))
                ok = 100 * small >= percent * large
                if not own[i]:
                    ok &= part[others] != part[i]
                ok &= np.minimum(at[others], at[i]) + np.minimum(size[others] - at[others], size[i] - at[i]) >= need
                some = np.flatnonzero(ok)
                ok[some] = np.abs(hist[others[some]] - hist[i]).sum(1, dtype=np.int32) <= (size[others] + size[i] - 2 * need)[some]
                return ok

            out += [(marks[a], marks[b]) for a, b in _forest(len(group), near)]
            if len(out) > 50_000:
                yield _pairs(out)
                out = []
        if out:
            yield _pairs(out)

    clusters = written(components(dealt.mapInArrow(lean(starred(candidates)), "a long, b long"), stars=False), "clusters")
    dropped(kept, live)
    members = clusters.withColumnRenamed("node", "mark").join(sets.select("mark", F.col("own.doc_id").alias("_id"), F.col("own.h").alias("_h"), "n"), "mark")
    sizes = written(members.groupBy("component").agg(F.count("*").alias("m"), F.sum("n").alias("total")), "sizes")
    wanted = blocks(members.join(sizes, "component"), F.greatest(F.ceil(F.col("m") / F.lit(float(block))), F.ceil(F.col("total") / F.lit(250.0 * block))), "mark")
    wanted = wanted.groupBy("_id", "_h").agg(F.collect_list(F.struct("component", "i", "j", "o", "own", "mark")).alias("x"))  # the blocks of one set

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", PART):
            rows = []
            for s, items in zip(shingles([(t or "").encode() for t in batch.column("text").to_pylist()], n), batch.column("x").to_pylist(), strict=True):
                mark = int(_mix(s * np.uint64(_BASE) + np.uint64(len(s))).sum(dtype=np.uint64).view(np.int64))
                rows += [(x["component"], x["i"], x["j"], x["o"], x["own"], mark, s.tobytes()) for x in items if x["mark"] == mark]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.binary()), strict=True)], ["c", "i", "j", "o", "own", "mark", "s"])

    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h"))).select("text", "x")  # ids repeat, null ones above all
    shipped = texts.mapInArrow(lean(ship), "c long, i int, j int, o int, own boolean, mark long, s binary").repartition("c", "i", "j").sortWithinPartitions("c", "i", "j", "mark")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _runs(batches, 3):
            group = [r for k, r in enumerate(group) if not k or r[5] != group[k - 1][5]]
            join = Join([np.frombuffer(r[6], np.uint64) for r in group], order, percent, np.array([r[3] for r in group]), np.array([r[4] for r in group]))
            out = [(group[a][5], group[b][5]) for a, b in _forest(len(group), join.near)]
            if out:
                yield _pairs(out)

    found = written(components(shipped.mapInArrow(lean(starred(verify)), "a long, b long"), stars=False), "classes")
    dropped(clusters, sizes)
    labelled = sets.select("mark", "doc_id").join(found, F.col("mark") == F.col("node"), "left").select("mark", "doc_id", F.coalesce("component", "mark").alias("label"))
    named = written(labelled.groupBy("label").agg(F.min("doc_id").alias("least")), "named")  # tables by themselves: a hot label or set can then be split
    names = written(labelled.join(named, "label").select(F.col("mark").alias("_mark"), "least", "label"), "names")
    dropped(sets, found, named)
    shown = ("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"), F.col("h").alias("text_hash"), "label")
    texts = profiles.where("n > 0").join(names, F.col("mark") == F.col("_mark"), "left").select(*shown)
    return texts.unionByName(profiles.where("n = 0").withColumns({"least": F.col("doc_id"), "label": F.lit(None).cast("long")}).select(*shown))
