"""Stateful estimators over long series: blocks of a series stream in, and what the estimator knows goes from block to block.

A recursion has to follow its series in order, so a series is one key; but no task holds more of it than a block, and the
state that is kept is the estimator's numbers, the next block's number and the blocks that came too early. Blocks may come in
any order and more than once; a query started again from its checkpoint goes on with the numbers it had.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidegauge.streaming.holes import run_available
from tidegauge.tables import folder_for

BLOCKS = "series long, block long, idx array<long>, x array<double>"
ESTIMATES = "series long, idx long, estimate double"


class Estimator(Protocol):
    """All it knows is in a list of numbers, so that it can be stored."""

    def start(self) -> list[float]:
        """At the beginning of a series."""
        ...

    def gap(self, state: list[float], first: int, last: int) -> list[float]:
        """Indices first to last are missing."""
        ...

    def step(self, state: list[float], x: np.ndarray) -> tuple[list[float], np.ndarray]:
        """Takes values of consecutive indices; gives an estimate for each."""
        ...


@dataclass(frozen=True)
class ExponentialMean:
    """m = weight x + (1 - weight) m, beginning at the first value; gaps longer than `bridge` begin anew."""

    weight: float
    bridge: int = 0

    def start(self) -> list[float]:
        return []

    def gap(self, state: list[float], first: int, last: int) -> list[float]:
        return state if last - first + 1 <= self.bridge else []

    def step(self, state: list[float], x: np.ndarray) -> tuple[list[float], np.ndarray]:
        out, m = np.empty(len(x)), state[0] if state else x[0]
        for k, v in enumerate(x):
            m += self.weight * (v - m)
            out[k] = m
        return [float(m)], out


def series_blocks(rows: DataFrame, size: int) -> DataFrame:
    """rows(series, idx >= 0, value) -> BLOCKS: block b has the indices from b size on; blocks without a row, up to the series'
    last, are there and empty. Null values count as missing; of a repeated index the smallest value counts."""
    dealt = rows.where("value IS NOT NULL").groupBy("series", "idx").agg(F.min("value").alias("value")).withColumn("block", F.floor(F.col("idx") / F.lit(size)).cast("long"))
    held = dealt.groupBy("series", "block").agg(F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("r"))
    every = held.groupBy("series").agg(F.max("block").alias("top")).select("series", F.explode(F.sequence(F.lit(0).cast("long"), "top")).alias("block"))
    full = every.join(held, ["series", "block"], "left").withColumn("r", F.coalesce("r", F.array().cast("array<struct<idx:bigint,value:double>>")))
    return full.select(F.col("series").cast("long").alias("series"), "block", F.transform("r", lambda x: x["idx"].cast("long")).alias("idx"), F.transform("r", lambda x: x["value"].cast("double")).alias("x"))


class BlockProcessor(StatefulProcessor):
    """One series."""

    def __init__(self, estimator: Estimator) -> None:
        self.estimator = estimator

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "block long, last long, numbers array<double>")
        self.early = handle.getMapState("early", "block long", "idx array<long>, x array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        block, last, numbers = self.known.get() if self.known.exists() else (0, -1, self.estimator.start())
        numbers = list(numbers)
        for part in rows:
            for b, idx, x in part[["block", "idx", "x"]].itertuples(index=False):
                if b > block:
                    self.early.updateValue((int(b),), ([int(i) for i in idx], [float(v) for v in x]))
                if b != block:
                    continue
                last, numbers, out = self.follow(last, numbers, idx, x)
                yield self.named(key, out)
                block += 1
                while self.early.containsKey((block,)):
                    last, numbers, out = self.follow(last, numbers, *self.early.getValue((block,)))
                    self.early.removeKey((block,))
                    yield self.named(key, out)
                    block += 1
        self.known.update((block, last, numbers))

    def named(self, key, out: list[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
        idx, found = (np.concatenate([o[k] for o in out] or [np.empty(0)]) for k in (0, 1))
        return pd.DataFrame({"series": np.full(len(idx), key[0], np.int64), "idx": idx.astype(np.int64), "estimate": found.astype(float)})

    def follow(self, last: int, numbers: list[float], idx, x) -> tuple[int, list[float], list[tuple[np.ndarray, np.ndarray]]]:
        """One block: runs of consecutive indices, gaps between them. Before a series' first row there is no gap."""
        idx, x, out = np.asarray(idx, np.int64), np.asarray(x, float), []
        for run in np.split(np.arange(len(idx)), np.flatnonzero(np.diff(idx) != 1) + 1) if len(idx) else []:
            if 0 <= last < idx[run[0]] - 1:
                numbers = list(self.estimator.gap(numbers, last + 1, int(idx[run[0]]) - 1))
            numbers, found = self.estimator.step(numbers, x[run])
            last = int(idx[run[-1]])
            out.append((idx[run], found))
        return last, list(numbers), out


def follow_estimates(blocks: DataFrame, estimator: Estimator) -> DataFrame:
    """blocks(BLOCKS), streaming -> ESTIMATES, for each block once all before it have come."""
    return blocks.groupBy("series").transformWithStateInPandas(BlockProcessor(estimator), ESTIMATES, "append", "none")


def run_estimates(folder: str, session, estimator: Estimator) -> DataFrame:
    """Streams what is below folder/in and wasn't taken yet, a file at a time, and returns all estimates so far."""
    stream = session.readStream.schema(BLOCKS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    run_available(session, follow_estimates(stream, estimator).writeStream.format("parquet").option("path", f"{folder}/out"), f"{folder}/state")
    return session.read.schema(ESTIMATES).parquet(f"{folder}/out")


def estimates_once(rows: DataFrame, estimator: Estimator, size: int, batches: int = 2) -> DataFrame:
    """rows(series, idx, value), finished, in blocks of `size` indices and `batches` files -> ESTIMATES."""
    folder = folder_for(rows.sparkSession)
    series_blocks(rows, size).repartition(batches).write.parquet(f"{folder}/in")
    return run_estimates(folder, rows.sparkSession, estimator)
