"""Best-fit packing of token pieces into fixed-length sequences by exact-complement hashing.

Only the number of pieces of each length matters for the packing, and there are at most `capacity`
lengths. The plan is therefore made on the driver from that histogram alone, whatever the corpus size:
lengths are taken from the longest; its gap is looked up among single lengths, then in an index of pair
sums, then as a length plus an indexed pair; a combination that fills the gap exactly is consumed as
often as its availability allows. What no combination completes is packed best-fit, longest first, in
groups of equal bins. Pieces then get their rank within their length from bucketed counts, and the rank
gives sequence and offset.

Cases: null text counts as empty and still carries the end id; an empty table gives no rows; repeated
documents and equal lengths are each placed once, in order of id; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import lean, slices, written
from tidegauge.llm.library_tokens import ENTRIES, encoder, encoder_key


def pieces(docs: DataFrame, tokenizer: str, pattern: str, end_id: int = 2, capacity: int = 1024, entries: int = ENTRIES) -> DataFrame:
    """entries bounds the encoder's cache in a worker, not the result. doc_id, piece, start, length, ids_crc32 of each document's pieces; only the first may be short of a cut document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer, "byte", pattern, entries).encode, end_id.to_bytes(4, "little")
        for batch in slices(batches, "text"):
            rows = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode([t or "" for t in batch.column("text").to_pylist()]), strict=True):
                ids += end
                n = len(ids) // 4
                first = n % capacity or min(n, capacity)
                cuts = [0, *range(first, n + 1, capacity)]
                rows += [(doc_id, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
            a, b, c, d, e = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int32()), *(pa.array(x, pa.int64()) for x in (c, d, e))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(lean(run, encoder_key(tokenizer)), "doc_id long, piece int, start long, length long, ids_crc32 long")


class Complements:
    """Combinations of one, two or three available lengths by their sum."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.counts = counts
        self.pairs: dict[int, list[tuple[int, int]]] = defaultdict(list)
        lengths = sorted(k for k, v in counts.items() if v and k < capacity)
        for i, a in enumerate(lengths):
            for b in lengths[i:]:
                if a + b >= capacity:
                    break
                self.pairs[a + b].append((a, b))
        self.lengths = lengths

    def _fits(self, combination: tuple[int, ...]) -> bool:
        return all(self.counts[x] >= combination.count(x) for x in combination)

    def pair(self, total: int, less: int = 0) -> tuple[int, int] | None:
        """The most unequal available pair; pairs that have run out are dropped for good."""
        found = self.pairs.get(total)
        while found:
            a, b = found[0]
            if self._fits((a, b)):
                return found[0]
            found.pop(0)
        return None

    def filling(self, gap: int, longest: int) -> tuple[int, ...] | None:
        """Lengths that fill the gap exactly beside a piece of the given length, which is taken already."""
        if self.counts.get(gap, 0):
            return (gap,)
        if two := self.pair(gap):
            return two
        for c in reversed(self.lengths):
            if c < gap and self.counts[c] and (two := self.pair(gap - c)) and self._fits((c, *two)):
                return (c, *two)
        return None


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Patterns as ((length, copies), ...) with the number of sequences that follow each."""
    counts = defaultdict(int, {k: v for k, v in histogram.items() if v})
    made: list[tuple[tuple[tuple[int, int], ...], int]] = []
    rest: dict[int, int] = {}
    index = Complements(counts, capacity)
    for longest in sorted(histogram, reverse=True):
        if longest == capacity:
            if counts[longest]:
                made.append((((longest, 1),), counts[longest]))
                counts[longest] = 0
            continue
        while counts[longest]:
            counts[longest] -= 1
            others = index.filling(capacity - longest, longest)
            counts[longest] += 1
            if others is None:
                rest[longest] = counts[longest]
                counts[longest] = 0
                break
            whole = (longest, *others)
            times = min(counts[x] // whole.count(x) for x in set(whole))
            made.append((tuple((x, whole.count(x)) for x in sorted(set(whole), reverse=True)), times))
            for x in whole:
                counts[x] -= times
    bins: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = defaultdict(list)
    for length in sorted(rest, reverse=True):
        left = rest[length]
        while left:
            free = min((f for f, groups in bins.items() if f >= length and groups), default=None)
            if free is None:
                each = min(left, capacity // length)
                n = left // each
                bins[capacity - each * length].append((((length, each),), n))
                left -= n * each
                continue
            pattern, n = bins[free].pop()
            each = min(left, free // length)
            used = min(n, left // each)
            bins[free - each * length].append(((*pattern, (length, each)), used))
            left -= used * each
            if n > used:
                bins[free].append((pattern, n - used))
    return made + [group for groups in bins.values() for group in groups]


def slot_runs(patterns: list[tuple[tuple[tuple[int, int], ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, copies in each, offset of the first copy) by length and rank."""
    rank, sequence, runs = defaultdict(int), 0, []
    for pattern, n in patterns:
        offset = 0
        for length, copies in pattern:
            runs.append((length, rank[length], rank[length] + n * copies, sequence, copies, offset))
            rank[length] += n * copies
            offset += length * copies
        sequence += n
    return runs


def pack(table: DataFrame, capacity: int = 1024, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Adds sequence_id and offset to rows with a length of 1 to capacity. table is read twice: pass a written one."""
    spark = table.sparkSession
    histogram = {r["length"]: r["n"] for r in table.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    if bad := [k for k in histogram if k is None or not 1 <= k <= capacity]:
        raise ValueError(f"lengths outside 1 to {capacity}: {bad[:3]}")
    runs = slot_runs(plan(histogram, capacity))
    slots = spark.createDataFrame(runs, "length long, r0 long, r1 long, s0 long, copies long, o0 long")
    if len(runs) <= 100_000:  # 48 bytes each; the plan has a few runs for each of at most `capacity` lengths
        slots = F.broadcast(slots)
    buckets = max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = table.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    own = Window.partitionBy("_b", "length")
    counts = dealt.groupBy("_b", "length").agg(F.count("*").alias("_n"))
    base = counts.select("_b", "length", (F.sum("_n").over(Window.partitionBy("length").orderBy("_b")) - F.col("_n")).alias("_base"))
    ranked = dealt.withColumn("_k", F.row_number().over(own.orderBy(*order)) - 1).join(base, ["_b", "length"]).withColumn("_k", F.col("_k") + F.col("_base"))
    at = F.col("_k") - F.col("r0")
    return (
        ranked.withColumnRenamed("length", "_length").join(slots, (F.col("_length") == F.col("length")) & (F.col("_k") >= F.col("r0")) & (F.col("_k") < F.col("r1")))
        .select(*(F.col(c) if c != "length" else F.col("_length").alias("length") for c in table.columns), (F.col("s0") + F.floor(at / F.col("copies"))).cast("long").alias("sequence_id"), (F.col("o0") + at % F.col("copies") * F.col("_length")).cast("long").alias("offset"))
    )


def pack_documents(docs: DataFrame, tokenizer: str, pattern: str, end_id: int = 2, capacity: int = 1024, entries: int = ENTRIES) -> DataFrame:
    """Pieces of every document with their sequence and place."""
    return pack(written(pieces(docs, tokenizer, pattern, end_id, capacity, entries), "pieces"), capacity)
