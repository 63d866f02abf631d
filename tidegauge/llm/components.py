"""Connected components of a graph given by its links, distributed.

Each partition first replaces its links by those of a spanning star; then large-star and small-star steps
alternate (each node hands its larger, then its smaller neighbours the least node it knows) until nothing
changes. Minima are partial aggregates and the joins are splittable, so a hub costs no single task. Links
and labels stay in tables; the driver sees two numbers a round.

Cases: null ends are dropped, self-links and repeated links are harmless, no links give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import dropped, lean, written


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the given links and the least node reachable from each."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = np.arange(len(nodes))
    x, y = at[: len(a)], at[len(a) :]
    while True:
        least = root.copy()
        np.minimum.at(least, root[x], root[y])
        np.minimum.at(least, root[y], root[x])
        while (deeper := least[least]).tolist() != least.tolist() if len(least) < 64 else not np.array_equal(deeper := least[least], least):
            least = deeper
        new = least[root]
        if np.array_equal(new, root):
            return nodes, nodes[root]
        root = new


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def star() -> tuple[np.ndarray, np.ndarray]:
        node, root = roots(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
        return node[node != root], root[node != root]

    for batch in batches:
        held.append((np.asarray(batch.column(0)), np.asarray(batch.column(1))))
        size += batch.num_rows
        if size > 2_000_000:  # bounded memory: a longer partition leaves more than one star
            u, v = star()
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["a", "b"])
            held, size = [], 0
    if held:
        u, v = star()
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["a", "b"])


def starred(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that gives the stars of the links that run gives, in the same Python worker."""
    return lambda batches: _stars(run(batches))


def components(links: DataFrame, rounds: int = 60, stars: bool = True) -> DataFrame:
    """links(a long, b long) -> node, component (the least node reachable), for nodes with a link to another. stars: whether
    links are yet to be replaced by those of spanning stars; otherwise starred() did so."""
    clean = links.select(F.col("a").cast("long").alias("u"), F.col("b").cast("long").alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    now = written((clean.mapInArrow(lean(_stars), "a long, b long").toDF("u", "v") if stars else clean).distinct(), "stars")
    before, rounds = None, rounds if now.limit(1).count() else 0
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()  # every link now leads from a node to a lesser one
        down = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
        small = large.join(down, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select(F.col("w").alias("u"), F.col("m").alias("v")))
        last, now = now, written(small.where("u <> v").distinct(), "links")
        dropped(last)
        said = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
        if said == before or not said["n"]:
            break
        before = said
    else:
        if rounds:
            raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
