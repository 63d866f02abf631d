"""Near-duplicate vectors: random-hyperplane signs in several tables, exact cosines, distributed components.

Equal vectors collapse into one class by aggregation. Every class gets, for each of `tables` tables, the
signs about `bits` random hyperplanes; classes with equal signs in a table share a bucket and are compared
exactly, in double precision, a block against a block. A pair is taken in the first table that joins it,
so nothing is counted twice and no pair is emitted: a bucket gives each class its number of linked vectors
and a spanning forest of its links. A bucket with more than `block` classes goes out as pairs of blocks.

With 8 bits and 27 tables a pair at cosine 0.9 is met with probability 1 - (1 - 0.8564**8)**27 = 0.9999,
a closer pair more surely; what is met is exact. The bits follow the number of classes (two more for each
fourfold input), as bucket sizes would otherwise grow with it, and the tables follow the bits: 8 bits and 27
tables up to 92,000 classes, 12 and 55 at 1 million, 22 and 274 at 1 billion, so shuffled bytes grow with the
classes to the power of about 1.25.

Cases: vectors that are null, zero or empty, or hold null or non-finite components link with nothing and
keep their rows; vectors of different lengths never link; repeated ids and rows count as vectors of their
own; ties need no rule; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import lean, written
from tidegauge.llm.components import components, roots
from tidegauge.llm.jaccard import blocks


def planes(dimensions: int, bits: int, tables: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng([seed, dimensions]).standard_normal((dimensions, tables * bits))


def signs(vectors: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Bucket number of each vector in each table."""
    on = vectors @ planes(vectors.shape[1], bits, tables) >= 0
    return (on.reshape(len(vectors), tables, bits) * (1 << np.arange(bits))).sum(2)


def chosen(classes: int, cosine: float, recall: float = 0.9999) -> tuple[int, int]:
    """Bits and tables for a number of classes: some 256 classes in a bucket if vectors were random, and the stated recall."""
    bits = min(48, max(8, round(math.log2(max(classes, 1) / 256))))
    meet = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - meet))


def near_duplicates(rows: DataFrame, cosine: float = 0.9, block: int = 2000) -> DataFrame:
    """rows(vec_id, embedding) -> vec_id, n_links, component_id, kept."""
    usable = "embedding IS NOT NULL AND size(embedding) > 0 AND NOT exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity')) AND exists(embedding, x -> x <> 0)"
    base = rows.selectExpr("vec_id", f"CASE WHEN {usable} THEN embedding END AS v")
    kind = base.schema["v"].dataType.simpleString()
    marked = base.withColumn("h", F.when(F.col("v").isNotNull(), F.xxhash64("v"))).withColumn("h2", F.when(F.col("v").isNotNull(), F.hash("v")))
    groups = marked.where("v IS NOT NULL").groupBy("h", "h2").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"), F.first("v").alias("v"))
    groups = written(groups.select(F.xxhash64("h", "h2").alias("c"), "h", "h2", "n", "least", "v"), "vectors")
    bits, tables = chosen(groups.count(), cosine)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 2000):
                batch = whole.slice(a, 2000)
                v = batch.column("v")
                lengths = np.asarray(pc.list_value_length(v))
                flat, ends = np.asarray(v.flatten()).astype(np.float64), np.cumsum(lengths)
                out = np.zeros((batch.num_rows, tables), "<i8")
                for d in np.unique(lengths).tolist():
                    own = np.flatnonzero(lengths == d)
                    out[own] = signs(np.stack([flat[ends[i] - d : ends[i]] for i in own]), bits, tables)
                yield pa.RecordBatch.from_arrays([batch.column("c"), batch.column("n"), pa.array(lengths, pa.int32()), v, pa.array([x.tobytes() for x in out.astype("<u2" if bits <= 16 else "<u8")], pa.binary()), pa.array(list(out), pa.list_(pa.int64()))], ["c", "n", "d", "v", "packed", "signs"])

    signed = written(groups.select("c", "n", "v").mapInArrow(lean(deal), f"c long, n long, d int, v {kind}, packed binary, signs array<long>"), "signs")
    places = signed.select("c", "d", F.posexplode("signs").alias("t", "s"))
    full = places.groupBy("t", "s", "d").agg(F.count("*").alias("m")).where("m > 1")
    met = blocks(places.join(full, ["t", "s", "d"]), F.ceil(F.col("m") / F.lit(float(block))), "c")
    met = met.join(signed.select("c", "n", "v", "packed"), "c").select("t", "s", "d", "i", "j", "m", "o", "own", "c", "n", "v", "packed")
    met = met.repartition("t", "s", "d", "i", "j").sortWithinPartitions("t", "s", "d", "i", "j")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, n, v, packed, o, own, t in _buckets(batches):
            v = v / np.abs(v).max(1, keepdims=True)
            v /= np.linalg.norm(v, axis=1, keepdims=True)
            sign = np.frombuffer(b"".join(packed), "<u2" if bits <= 16 else "<u8").reshape(len(c), tables)[:, :t]
            linked, low = np.zeros(len(c)), []
            for a in range(0, len(c), 500):
                ok = v[a : a + 500] @ v.T >= cosine
                ok[np.arange(len(ok)), np.arange(a, a + len(ok))] = False
                ok &= (o[a : a + 500, None] != o[None]) | own[None]  # pairs inside a block count once
                p, q = np.nonzero(ok)
                if t and len(p):
                    fresh = ~(sign[p + a] == sign[q]).any(1)
                    p, q = p[fresh], q[fresh]
                linked += np.bincount(p + a, n[q], len(c))
                low.append((p + a, q))
            p, q = (np.concatenate(x) for x in zip(*low, strict=True))
            if len(p):
                nodes, least = roots(c[p], c[q])
                links = linked[np.argsort(c)][np.searchsorted(np.sort(c), nodes)].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(links), pa.array(least)], ["c", "links", "root"])

    counted = written(met.mapInArrow(lean(compare), "c long, links long, root long"), "links")
    joined = components(counted.select(F.col("c").alias("a"), F.col("root").alias("b")))
    sums = counted.groupBy("c").agg(F.sum("links").alias("links"))
    labels = groups.join(joined, F.col("c") == F.col("node"), "left").select("c", "h", "h2", "n", "least", F.coalesce("component", "c").alias("label"))
    named = written(labels.groupBy("label").agg(F.min("least").alias("component_id")), "named")  # tables by themselves: hot labels and copies can then be split
    known = labels.join(named, "label").join(sums, "c", "left").select("h", "h2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"), "component_id")
    known = written(known, "known")
    out = marked.where("v IS NOT NULL").select("vec_id", "h", "h2").join(known, ["h", "h2"], "left").select("vec_id", "n_links", F.coalesce("component_id", "vec_id").alias("component_id"))
    out = out.unionByName(marked.where("v IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _buckets(batches: Iterator[pa.RecordBatch]):
    """One bucket (or pair of blocks) after another; two blocks of classes at most are held."""
    held: list[pa.RecordBatch] = []

    def out():
        whole = pa.Table.from_batches(held).combine_chunks()
        v = np.asarray(whole.column("v").combine_chunks().flatten()).astype(np.float64).reshape(whole.num_rows, -1)
        return np.asarray(whole.column("c")), np.asarray(whole.column("n")), v, whole.column("packed").to_pylist(), np.asarray(whole.column("o")), np.asarray(whole.column("own")), whole.column("t")[0].as_py()

    last = None
    for batch in batches:
        keys = np.stack([np.asarray(batch.column(k)).astype(np.int64) for k in ("t", "s", "d", "i", "j")], 1)
        cuts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, [len(keys)]])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if a == b:
                continue
            if last is not None and (keys[a] != last).any():
                yield out()
                held = []
            held.append(batch.slice(a, b - a))
            last = keys[a]
    if held:
        yield out()
