"""Exact removal of repeated byte strings with a sparse suffix array, sorted deep-shallow.

A string of `length` bytes that occurs twice holds the same anchor at the same place both times: the gram
of `gram` bytes with the least hash among those inside it. Only anchors are therefore indexed, about one
in sixty bytes, and only anchors whose gram occurs again are looked at:

1. Anchors carry a hash of their gram and one of their whole context (all strings that own the anchor).
2. Contexts that occur twice are covered as a whole; copies in any number cost one aggregation.
3. Where different contexts share a gram, one task sorts a gram's suffixes and, reversed, its prefixes:
   multikey quicksort over 8-byte symbols to a shallow depth, then a blind trie for each group that still
   agrees. Groups of common suffixes are merged from the longest common prefix down, the smaller into the
   larger, and each suffix meets only its neighbours in the order of the prefixes: linear times two
   logarithms, without pairs. Each suffix learns how far strings of `length` reach to both sides.
4. A gram with more than `hot` different contexts is split by the bytes that follow or precede it before it is
   sorted: a string that owns the gram reaches either `mid` bytes to the right or `length + 1 - mid` to the left,
   so contexts that share one share those bytes and meet in one of two smaller groups. Groups that are still
   too large are split again, until at the last their whole strings agree; a few rounds settle any skew.
5. Covered runs go back to their documents, whose remaining bytes are joined.

Strings are judged on the input; matches never cross documents. Hashes have 64 bits for grams and 128 for
contexts with their gram; bytes decide everything that is sorted.

Cases: null text counts as empty; texts under `length` bytes are kept whole; repeated rows (same id and
text) are removed from both; ids that repeat with other texts are told apart by a hash of the text; an
empty table gives no rows; texts above two parts are indexed in overlapping parts, with the same anchors;
other columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm.common import dropped, lean, slices, written

_RANDOM = np.random.default_rng(20240917)
_BYTE = _RANDOM.integers(0, 2**63, 257, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_RANDOM.integers(2**62, 2**63)) | 1
_WORD = 2**64 - 1
#: Bytes hashed at once; longer texts are cut with an overlap of two strings.
PART = 2_000_000
#: Low bits of a gram's order that give way to its place, always as many: the same bytes have the same anchors in every batch.
BITS = np.uint64(23)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


class Anchors:
    """Content-chosen anchors of texts."""

    def __init__(self, length: int, gram: int):
        if gram & (gram - 1) or not gram < length:
            raise ValueError("gram must be a power of two below length")
        self.length, self.gram, self.back = length, gram, length - gram

    def find(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text number, position, hash of the gram and hash of the context of each anchor."""
        length, gram, back = self.length, self.gram, self.back
        keep = [i for i, t in enumerate(texts) if len(t) >= length]
        if not keep:
            z = np.zeros(0, np.int64)
            return z, z, z, z
        sizes = np.array([len(texts[i]) for i in keep])
        starts = length + np.concatenate([[0], np.cumsum(sizes + length)[:-1]])
        symbols = np.full(int(starts[-1] + sizes[-1] + length), 256, np.uint16)  # 256 stands between texts
        for i, a, n in zip(keep, starts.tolist(), sizes.tolist(), strict=True):
            symbols[a : a + n] = np.frombuffer(texts[i], np.uint8)
        h, base, m = _BYTE[symbols], _BASE, 1
        while m < gram:
            h = h[:-m] * np.uint64(base) + h[m:]
            base, m = base * base & _WORD, 2 * m
        order = _mix(h)
        if len(order) >> int(BITS):
            raise ValueError(f"{len(order)} bytes at once")
        least, m, n_grams = (order >> BITS << BITS) | np.arange(len(order), dtype=np.uint64), 1, back + 1
        while m * 2 <= n_grams:
            least, m = np.minimum(least[:-m], least[m:]), 2 * m
        if n_grams > m:
            least = np.minimum(least[: len(least) - (n_grams - m)], least[n_grams - m :])
        inside = np.zeros(len(least) + 1, np.int8)
        inside[starts] += 1
        inside[starts + sizes - length + 1] -= 1
        chosen = least[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)] & ((np.uint64(1) << BITS) - np.uint64(1))
        at = chosen[np.concatenate([[True], chosen[1:] != chosen[:-1]])].astype(np.int64)
        own = np.searchsorted(starts, at, side="right") - 1
        context = np.zeros(len(at), np.uint64)
        for offset in [*range(-back, back, gram), back]:
            context = _mix(context * np.uint64(_BASE) + h[at + offset])
        return np.array(keep)[own], at - starts[own], order[at].view(np.int64), context.view(np.int64)

    def find_long(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Position, gram and context hash for a text of any length; contexts are the same as those of the whole text."""
        step, margin, found = PART, 2 * self.length, {}
        for a in range(0, len(text), step):
            low, high = max(0, a - margin), min(len(text), a + step + margin)
            _, at, g, c = self.find([text[low:high]])
            for p, x, y in zip((at + low).tolist(), g.tolist(), c.tolist(), strict=True):
                if a <= p < a + step:
                    found[p] = (x, y)
        at = sorted(found)
        return np.array(at, np.int64), np.array([found[p][0] for p in at], np.int64), np.array([found[p][1] for p in at], np.int64)


def common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


class BlindTrie:
    """Orders strings that agree for long: nodes keep a depth and one symbol per branch, never the text between."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: list | None = None

    @staticmethod
    def _symbol(s: bytes, depth: int) -> int:
        return s[depth] if depth < len(s) else -1

    def insert(self, i: int) -> None:
        """A node is [depth, {symbol: node}]; a leaf is [-1, members], whose strings are equal."""
        s = self.strings[i]
        if self.root is None:
            self.root = [-1, [i]]
            return
        node = self.root
        while node[0] >= 0:  # blind: any branch where the symbol has none
            node = node[1].get(self._symbol(s, node[0])) or next(iter(node[1].values()))
        other = self.strings[node[1][0]]
        depth = common(s, other)
        if depth == len(s) == len(other):
            node[1].append(i)
            return
        above, node = None, self.root
        while 0 <= node[0] < depth:
            above, node = node, node[1][self._symbol(s, node[0])]
        if node[0] == depth:
            node[1][self._symbol(s, depth)] = [-1, [i]]
            return
        split = [depth, {self._symbol(other, depth): node, self._symbol(s, depth): [-1, [i]]}]
        if above is None:
            self.root = split
        else:
            above[1][self._symbol(s, above[0])] = split

    def ordered(self) -> tuple[list[int], list[int]]:
        """Members in order, and the common prefix of each with the one before it."""
        out, shared, todo = [], [], [(self.root, 0)]
        while todo:
            node, lcp = todo.pop()
            if node[0] < 0:
                for k, i in enumerate(node[1]):
                    out.append(i)
                    shared.append(len(self.strings[i]) if k else lcp)
            else:
                todo += [(child, node[0] if k else lcp) for k, (_, child) in reversed(list(enumerate(sorted(node[1].items()))))]
        return out, shared


def deep_shallow(strings: list[bytes], depth: int = 0, shallow: int = 32) -> tuple[list[int], list[int]]:
    """Order of strings and common prefixes of neighbours; the first `depth` bytes are known to agree."""
    out, todo, stop = [], [(list(range(len(strings))), depth)], depth + shallow
    while todo:
        group, at = todo.pop()
        if len(group) == 1:
            out.append(group[0])
        elif at >= stop or len(group) < 5:
            trie = BlindTrie(strings)
            for i in group:
                trie.insert(i)
            out += trie.ordered()[0]
        else:  # one step of multikey quicksort over symbols of eight bytes; shorter symbols end their strings
            keys = [strings[i][at : at + 8] for i in group]
            pivot = sorted((keys[0], keys[len(keys) // 2], keys[-1]))[1]
            less, same, more = [], [], []
            for i, k in zip(group, keys, strict=True):
                (less if k < pivot else more if k > pivot else same).append(i)
            todo += [(x, y) for x, y in ((more, at), (same, at + 8 if len(pivot) == 8 else stop), (less, at)) if x]
    return out, [0, *(common(strings[a], strings[b]) for a, b in zip(out, out[1:], strict=False))]


def reaches(lefts: list[bytes], rights: list[bytes], length: int, gram: int) -> list[tuple[int, int] | None]:
    """For different contexts of one gram, how far strings of `length` that another context also has reach to the
    left and right of the anchor; None where there is no such string. lefts are reversed; rights start with the gram."""
    n = len(rights)
    best: list[tuple[int, int] | None] = [None] * n

    def meet(x: int, y: int, right: int) -> None:
        left = common(lefts[x], lefts[y])
        if left + right >= length:
            for i in (x, y):
                old = best[i]
                best[i] = (left, right) if old is None else (max(old[0], left), max(old[1], right))

    if n == 2:
        meet(0, 1, common(rights[0], rights[1]))
        return best
    order, shared = deep_shallow(rights, gram if len({r[:gram] for r in rights}) == 1 else 0)
    rank = [0] * n
    for k, i in enumerate(deep_shallow(lefts)[0]):
        rank[i] = k
    by_rank = [0] * n
    for i, k in enumerate(rank):
        by_rank[k] = i
    sets: list[list[int] | None] = [[rank[i]] for i in order]
    root = list(range(n))

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = k = root[root[k]]
        return k

    for k in sorted(range(1, n), key=lambda k: -shared[k]):
        if shared[k] < gram:
            break
        a, b = top(k - 1), top(k)
        if len(sets[a]) < len(sets[b]):
            a, b = b, a
        large, small = sets[a], sets[b]
        for x in small:
            at = bisect.bisect(large, x)
            if at:
                meet(by_rank[large[at - 1]], by_rank[x], shared[k])
            if at < len(large):
                meet(by_rank[large[at]], by_rank[x], shared[k])
            large.insert(at, x)
        root[b], sets[b] = a, None
    return best


Finish = Callable[[list[str], list[list[dict]]], dict[str, pa.Array]]


def repeats(docs: DataFrame, length: int = 200, gram: int = 64, hot: int = 50_000, carry: tuple[str, ...] = (), finish: tuple[str, Finish] | None = None) -> DataFrame:
    """docs(doc_id, text) -> doc_id, text, runs array<struct<start, end>> (maximal repeated runs in bytes of the UTF-8
    text) and the columns in carry. finish, a schema and a function of texts and runs, gives other columns in the place
    of text and runs, in the same pass: a second one would take another Python worker for each task."""
    others = [F.col(c).alias(f"_{i}") for i, c in enumerate(carry)]
    all_texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *others)
    texts = all_texts.select("doc_id", "text")
    finder, back = Anchors(length, gram), length - gram
    version = F.hash("text")
    key = docs.schema["doc_id"].dataType.simpleString()

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", PART):
            data = [t.encode() for t in batch.column("text").to_pylist()]
            if len(data) == 1 and len(data[0]) > 2 * PART:
                at, g, c = finder.find_long(data[0])
                own = np.zeros(len(at), np.int64)
            else:
                own, at, g, c = finder.find(data)
            rows = pa.array(own)
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(c), batch.column("doc_id").take(rows), batch.column("v").take(rows), pa.array(at.astype(np.int32))], ["g", "c", "doc_id", "v", "at"])

    found = texts.withColumn("v", version).mapInArrow(lean(anchors), f"g long, c long, doc_id {key}, v int, at int")
    again = written(found.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g"), "again")
    shared = written(found.join(again, "g"), "shared")
    dropped(again)
    contexts = written(shared.groupBy("g", "c").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "v", "at")).alias("w")), "contexts")
    several = written(contexts.groupBy("g").agg(F.count("*").alias("m")).where("m > 1"), "several")  # a table by itself: a hot gram's contexts can then be split
    whole = contexts.where("n > 1").select("g", "c", F.lit(back).alias("left"), F.lit(length).alias("right"))
    places = contexts.join(several, "g").select(F.col("w.doc_id").alias("doc_id"), F.col("w.v").alias("v"), F.struct("g", "c", "n", "m", "w.at").alias("x"))
    places = places.groupBy("doc_id", "v").agg(F.collect_list("x").alias("x"))  # as many as the text has anchors

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = []
            for text, items in zip(batch.column("text").to_pylist(), batch.column("x").to_pylist(), strict=True):
                data = text.encode()
                for x in items:
                    at = x["at"]
                    rows.append((x["g"], x["c"], x["n"], x["m"], data[max(0, at - back) : at][::-1], data[at : at + length]))
            if rows:
                g, c, n, m, a, b = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (g, c, n, m)), pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["g", "c", "n", "m", "lefts", "rights"])

    located = _join(texts.withColumn("v", version), places, "inner").select("text", "x")
    strings = located.mapInArrow(lean(cut), "g long, c long, n long, m long, lefts binary, rights binary").withColumn("k", F.col("g"))
    if several.where(F.col("m") > hot).limit(1).count():
        strings = written(strings, "strings")
        calm, extra = _split(strings.where(F.col("m") > hot), length, gram, hot)
        strings = strings.where(F.col("m") <= hot).select(*calm.columns).unionByName(calm)
    else:
        extra = None

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            out = [(g, c, r[0], r[1]) for (_, g, c, n, *_), r in zip(rows, reaches([x[4] for x in rows], [x[5] for x in rows], length, gram), strict=True) if r and n == 1]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["g", "c", "left", "right"])

    ready = strings.select("k", "g", "c", "n", "lefts", "rights").repartition("k").sortWithinPartitions("k")
    sorted_out = ready.mapInArrow(lean(sort), "g long, c long, left int, right int")
    covers = whole.unionByName(sorted_out)
    covers = written(covers if extra is None else covers.unionByName(extra), "covers")
    dropped(contexts, several)
    runs = shared.join(covers, ["g", "c"]).select("doc_id", "v", F.struct(F.greatest(F.col("at") - F.col("left"), F.lit(0)).alias("start"), (F.col("at") + F.col("right")).alias("end")).alias("r"))
    runs = runs.groupBy("doc_id", "v").agg(F.array_sort(F.collect_set("r")).alias("r"))  # as many as the text has anchors

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in slices(batches, "text"):
            out, texts = [], batch.column("text").to_pylist()
            for text, items in zip(texts, batch.column("r").to_pylist(), strict=True):
                merged: list[dict] = []
                size = len(text.encode()) if items else 0
                for x in items or ():
                    if merged and x["start"] <= merged[-1]["end"]:
                        merged[-1]["end"] = max(merged[-1]["end"], min(x["end"], size))
                    else:
                        merged.append({"start": x["start"], "end": min(x["end"], size)})
                out.append(merged)
            made = make(texts, out) if finish else {"text": batch.column("text"), "runs": pa.array(out, kind)}
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(batch.column(f"_{i}") for i in range(len(carry))), *made.values()], ["doc_id", *(f"_{i}" for i in range(len(carry))), *made])

    schema, make = finish or ("text string, runs array<struct<start:int,end:int>>", None)
    names = ["doc_id", *(f"_{i}" for i in range(len(carry)))]
    joined = _join(all_texts.withColumn("v", version), runs, "left").select(*names, "text", "r")
    made = T._parse_datatype_string(schema)
    merged = joined.mapInArrow(lean(merge), T.StructType([*all_texts.select(*names).schema.fields, *made.fields]))
    return merged.select("doc_id", *(f.name for f in made.fields), *(F.col(f"_{i}").alias(c) for i, c in enumerate(carry)))


def _join(texts: DataFrame, other: DataFrame, how: str) -> DataFrame:
    """By id, null ids included, and by version of the text."""
    other = other.withColumnsRenamed({"doc_id": "_id", "v": "_v"})
    return texts.join(other, texts["doc_id"].eqNullSafe(other["_id"]) & (texts["v"] == other["_v"]), how)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows of one group after another; `hot` bounds their number."""
    rows: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
            if rows and rows[-1][0] != row[0]:
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def _split(rows: DataFrame, length: int, gram: int, hot: int) -> tuple[DataFrame, DataFrame | None]:
    """Splits the contexts of hot grams: groups (k) of at most `hot` contexts to sort, and covers of contexts whose groups can't get smaller.

    lo and hi: a group's strings reach lo to hi - 1 bytes to the right of the anchor, so members share lo bytes there and length + 1 - hi before it.
    """
    rows = rows.selectExpr("k", "g", "c", "n", "lefts", "rights", f"{gram} AS lo", f"{length + 1} AS hi")
    calm, covers = [], []
    while True:
        mid = "CAST((lo + hi) DIV 2 AS INT)"
        near = rows.where(f"length(lefts) >= {length + 1} - {mid}").selectExpr(f"xxhash64(k, 0, substring(lefts, 1, {length + 1} - {mid})) AS k", "g", "c", "n", "lefts", "rights", "lo", f"{mid} AS hi")
        far = rows.where(f"length(rights) >= {mid}").selectExpr(f"xxhash64(k, 1, substring(rights, 1, {mid})) AS k", "g", "c", "n", "lefts", "rights", f"{mid} AS lo", "hi")
        both = written(near.unionByName(far), "split")
        sizes = written(both.groupBy("k").agg(F.count("*").alias("m")).where("m > 1"), "sizes")
        both = both.join(sizes, "k")
        calm.append(both.where(F.col("m") <= hot).drop("lo", "hi"))
        equal = both.where((F.col("m") > hot) & (F.col("hi") - F.col("lo") == 1))  # lo bytes after and length - lo before: whole strings agree
        covers.append(equal.where("n = 1").select("g", "c", (F.lit(length) - F.col("lo")).alias("left"), F.col("lo").alias("right")))
        rows = both.where((F.col("m") > hot) & (F.col("hi") - F.col("lo") > 1)).drop("m")
        if not sizes.where(F.col("m") > hot).limit(1).count() or not rows.limit(1).count():
            break
    return functools.reduce(DataFrame.unionByName, calm), functools.reduce(DataFrame.unionByName, covers)


def without_repeats(docs: DataFrame, **options) -> DataFrame:
    """docs with repeated strings cut out of text; a character that loses a byte goes as a whole. n_chars, if there, follows."""

    def finish(texts: list[str], runs: list[list[dict]]) -> dict[str, pa.Array]:
        return {"_text": pa.array([_kept(t.encode(), r).decode("utf-8", "ignore") if r else t for t, r in zip(texts, runs, strict=True)], pa.string())}

    names = [c for c in docs.columns if c not in ("doc_id", "text")]
    cuts = repeats(docs, carry=tuple(names), finish=("_text string", finish), **options)
    cuts = cuts.toDF("doc_id", "text", *names).select(*docs.columns)
    return cuts.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cuts


def _kept(data: bytes, runs: list[dict]) -> bytes:
    cuts = [0, *(x for r in runs for x in (r["start"], r["end"])), len(data)]
    return b"".join(data[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))


def removed(docs: DataFrame, **options) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes)."""

    def finish(texts: list[str], runs: list[list[dict]]) -> dict[str, pa.Array]:
        data = [t.encode() for t in texts]
        counts = {"n_bytes": map(len, data), "n_removed": (sum(x["end"] - x["start"] for x in r) for r in runs), "n_spans": map(len, runs)}
        return {k: pa.array(list(v), pa.int64()) for k, v in counts.items()} | {"kept": pa.array([_kept(d, r) for d, r in zip(data, runs, strict=True)], pa.binary())}

    return repeats(docs, finish=("n_bytes long, n_removed long, n_spans long, kept binary", finish), **options)
