"""Exact top-k inner products with vector-approximation files.

Components become integers. Every block of vectors is written once, as a file in the shared folder: ids, the
grid (the block's range of each dimension in CELLS intervals), the cells, one byte a component, and after them
the exact vectors. A task takes a block of queries and a run of files. Of each file it reads the cells, scans
them for upper bounds of every inner product, then reads single exact vectors in the order of their bounds
until the k-th best exact score, carried on from file to file, is above every bound that is left. Partial
results (k rows for each query and run) merge by aggregation. Vectors aren't shuffled and nothing grows with
the data but the number of files; the pairs of query blocks and files are the query set times all rows, as the
search asks for.

Cases: vectors that are null or empty, or hold null or non-finite components, take no part; vectors of
other lengths than the query's don't match it; ties go to the smaller id; a query never finds rows of its
own id; repeated ids are separate candidates, and separate queries with a list each (their place in a file of queries tells them apart); fewer than k candidates give them all; an empty table gives
no rows; other columns are ignored. Scores are exact integers: pairs with a vector that has a component beyond
2**24 are scored one by one in Python's integers. Ranks are exact for every finite component of type float; a
score beyond 64 bits, which its column can't hold, shows as null.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from operator import mul

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import file_system, lean, shared_dir, written

CELLS = 64
#: Vectors with larger components have no cells. What scores are subtracted from to sort as bytes.
LARGEST, TOP, WIDTH = 2**24, 2**311, 40


class VectorFile:
    """ids, which vectors are wide, low and width of the grid, cells, exact vectors: sections of fixed size, one after another."""

    @staticmethod
    def write(stream, ids: np.ndarray, vectors: np.ndarray) -> None:
        wide = np.abs(vectors).max(1) > LARGEST
        small = vectors[~wide] if not wide.all() else np.zeros((1, vectors.shape[1]))
        low = small.min(0)
        width = np.maximum(1, np.ceil((small.max(0) - low + 1) / CELLS))
        cells = np.where(wide[:, None], 0, (vectors - low) // width).astype(np.uint8)
        for part in (ids.astype("<i8"), wide, low.astype("<f8"), width.astype("<f8"), cells, vectors.astype("<f8")):
            stream.write(part.tobytes())

    def __init__(self, source, n: int, d: int):
        self.source, self.n, self.d = source, n, d
        head = source.read(9 * n + 16 * d + n * d)
        self.ids, self.wide = np.frombuffer(head, "<i8", n), np.frombuffer(head, bool, n, 8 * n)
        self.low, self.width = np.frombuffer(head, "<f8", 2 * d, 9 * n).reshape(2, d)
        self.cells = np.frombuffer(head, np.uint8, n * d, 9 * n + 16 * d).reshape(n, d)
        self.at = len(head)
        self.vectors, self.have = np.empty((n, d)), np.zeros(n, bool)

    def exact(self, rows: np.ndarray) -> np.ndarray:
        """Exact vectors; those that no query has asked for yet are read from the file, neighbours at once."""
        new = np.sort(rows[~self.have[rows]])
        for part in np.split(new, np.flatnonzero(np.diff(new) > 1) + 1) if len(new) else ():
            self.source.seek(self.at + 8 * self.d * int(part[0]))
            self.vectors[part] = np.frombuffer(self.source.read(8 * self.d * len(part)), "<f8").reshape(-1, self.d)
        self.have[new] = True
        return self.vectors[rows]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Upper bound of each query's inner product with each vector, from cells alone, with room for rounding."""
        base = queries @ self.low + np.where(queries > 0, queries * (self.width - 1), 0).sum(1)
        room = np.abs(queries) @ (np.abs(self.low) + CELLS * self.width) * self.d * 2.0**-51
        return (base + room)[:, None] + (queries * self.width) @ self.cells.T.astype(np.float64)

    def search(self, query: np.ndarray, own: int, bound: np.ndarray, best: list[tuple[int, int]], k: int, batch: int = 32) -> list[tuple[int, int]]:
        """best, the k best (-score, id) so far, with the vectors that have cells: they are read in the order of their bounds."""
        usable = ~self.wide & (self.ids != own)
        if len(best) >= k:
            usable &= bound >= -best[k - 1][0]
        rows = np.flatnonzero(usable)
        while len(rows):
            near = np.argpartition(-bound[rows], min(len(rows) - 1, 4 * batch))[: 4 * batch + 1]
            part = rows[near[np.argsort(-bound[rows[near]], kind="stable")]]
            for a in range(0, len(part), batch):
                read = part[a : a + batch]
                if len(best) >= k and -best[k - 1][0] > bound[read[0]]:
                    return best
                scores = self.exact(read).astype(np.int64) @ query
                best = sorted([*best, *zip((-scores).tolist(), self.ids[read].tolist(), strict=True)])[:k]
            rows = np.delete(rows, near)
            if len(best) >= k:
                rows = rows[bound[rows] >= -best[k - 1][0]]
        return best


def integers(rows: DataFrame, factor: int = 256) -> DataFrame:
    """vec_id, v array<double>: floor(factor * x) of usable vectors; doubles from 2**52 on are whole numbers."""
    usable = "embedding IS NOT NULL AND size(embedding) > 0 AND NOT exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity'))"

    def whole(y):
        return F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y)

    return rows.where(usable).select("vec_id", F.transform("embedding", lambda x: whole(x.cast("double") * F.lit(float(factor)))).alias("v"))


def write_files(rows: DataFrame, block: int) -> DataFrame:
    """Vector files of rows(vec_id, v): a written manifest of file, n (vectors) and d (components)."""
    folder = shared_dir(rows.sparkSession) + "/vectors"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = file_system(folder)
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
        sizes: dict[int, int] = defaultdict(int)

        def out(d: int) -> pa.RecordBatch:
            ids, vectors = (np.concatenate(x) for x in zip(*held.pop(d), strict=True))
            name = f"{uuid.uuid4().hex}.vec"
            with files.open_output_stream(f"{path}/{name}") as stream:
                VectorFile.write(stream, ids, vectors)
            del sizes[d]
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(ids)], pa.int64()), pa.array([d], pa.int32())], ["file", "n", "d"])

        for batch in batches:
            if not batch.num_rows:
                continue
            files.create_dir(path, recursive=True)
            lists, ids = batch.column("v"), np.asarray(batch.column("vec_id"))
            lengths, flat = np.asarray(pc.list_value_length(lists)), np.asarray(lists.flatten())
            ends = np.cumsum(lengths)
            for d in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == d)
                held[d].append((ids[own], flat[(ends[own] - d)[:, None] + np.arange(d)]))
                sizes[d] += len(own)
                if sizes[d] >= block:
                    yield out(d)
            while sum(n * d for d, n in sizes.items()) > 256 * block:  # vectors of very many lengths
                yield out(max(sizes, key=lambda d: sizes[d] * d))
        for d in list(held):
            yield out(d)

    return written(rows.select("vec_id", "v").mapInArrow(lean(write), "file string, n long, d int"), "manifest")


def search(queries: DataFrame, vectors: DataFrame, k: int = 5, query_block: int = 512, block: int = 16_384) -> DataFrame:
    """queries and vectors (vec_id, v array<double> of whole numbers) -> query_id, rank (from 1), vec_id, score."""
    spark = vectors.sparkSession

    def stored(rows: DataFrame, size: int) -> DataFrame:
        return write_files(rows.coalesce(max(1, -(-rows.count() // size))), size)  # small input splits share a file

    asked, files = stored(queries, query_block), stored(vectors, block)
    n_asked, n_files, parts = asked.count(), files.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    run = max(1, min(16, n_asked * n_files // parts))  # files to a task
    runs = files.withColumn("run", F.pmod(F.xxhash64("file"), F.lit(max(1, n_files // run)))).groupBy("d", "run").agg(F.collect_list(F.struct("file", "n")).alias("files"))
    # A row for each block of queries and run of files. All vectors may have one length, so runs are dealt by their number, too.
    dealt = runs.withColumn("part", F.pmod("run", F.lit(parts)))
    tasks = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).join(dealt, ["d", "part"]).select("file", "n", "d", "files")
    tasks = tasks.repartition(max(1, min(10_000, max(parts, n_asked * n_files // run))))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for task in batch.to_pylist():
                with _open(task["file"]) as source:
                    q = VectorFile(source, task["n"], task["d"])
                    wanted = q.exact(np.arange(q.n))
                best: list[list[tuple[int, int]]] = [[] for _ in range(q.n)]
                for f in task["files"]:
                    with _open(f["file"]) as source:
                        _merge(q, wanted, VectorFile(source, f["n"], task["d"]), best, k)
                found = [(int(i), row, j, s) for row, (i, x) in enumerate(zip(q.ids, best, strict=True)) for s, j in x]
                if found:
                    a, row, b, s = zip(*found, strict=True)
                    block = [task["file"].rpartition("/")[2]] * len(a)
                    keys, scores = [(TOP + x).to_bytes(WIDTH, "big") for x in s], [-x if -(2**63) <= -x < 2**63 else None for x in s]
                    yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(row, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(keys, pa.binary()), pa.array(scores, pa.int64())], ["block", "row", "query_id", "vec_id", "key", "score"])

    partial = tasks.mapInArrow(lean(scan), "block string, row int, query_id long, vec_id long, key binary, score long")
    best = partial.groupBy("block", "row", "query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("key", "vec_id", "score"))), 1, k).alias("x"))  # k rows for each run of files
    return best.select("query_id", F.posexplode("x").alias("at", "r")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("r.vec_id").alias("vec_id"), F.col("r.score").alias("score"))


def _open(uri: str):
    files, path = file_system(uri)
    return files.open_input_file(path)


def _merge(q: VectorFile, wanted: np.ndarray, file: VectorFile, best: list[list[tuple[int, int]]], k: int) -> None:
    """Brings the best of each query up to date with one file."""
    wide = np.flatnonzero(file.wide)
    singly = range(file.n) if q.wide.any() else wide.tolist()
    vectors = file.exact(np.array(singly, np.int64)) if len(singly) else []
    whole = {j: list(map(int, x)) for j, x in zip(singly, vectors, strict=True)}
    for a in range(0, q.n, 128):
        part = np.where(q.wide[a : a + 128, None], 0, wanted[a : a + 128])
        for i, (query, bound) in enumerate(zip(part.astype(np.int64), file.bounds(part), strict=True), a):
            if q.wide[i]:
                others = range(file.n)
            else:
                best[i] = file.search(query, q.ids[i], bound, best[i], k)
                others = wide.tolist()
            if len(others):
                exact = list(map(int, wanted[i].tolist()))
                best[i] = sorted([*best[i], *((-sum(map(mul, exact, whole[j])), int(file.ids[j])) for j in others if file.ids[j] != q.ids[i])])[:k]
