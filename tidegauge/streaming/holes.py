"""Live delivery with holes, and live ordered commit, as stateful processors over event time.

The feed carries arrivals and declarations in one stream, in any order within `delay` of mission time. Events wait in
state until the watermark has passed them and then count in the order instant, hole, arrival, batch, so that the rows are
those of the batch plan (operators/holes.py) for any order of delivery. A `final` event says that the record is final.

follow_holes() keys the feed by groups of neighbouring windows; a group's state holds the live rows of its stretches as
disjoint intervals, the rows that holes took, and the windows that are still open. What it emits in a micro-batch are all
windows that the mission time up to then settles; Commit releases them by increasing index. Its queue of held windows is a
table with a version for each micro-batch, and the border (the first window that isn't settled, and the latest
instant before it) goes from one micro-batch to the next, so that no task holds a series and a repeated micro-batch gives the
same files.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from datetime import datetime

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidegauge.operators import holes
from tidegauge.operators.holes import cause_rank
from tidegauge.tables import folder_for

FEED = "kind string, at timestamp, batch long, row_start long, row_end long, cause string"
SETTLED = "window long, complete_at timestamp, completing_batch long, coverage double, dead_at timestamp, cause string"
EPOCH = datetime(1970, 1, 1)
#: What a group emits, instants in microseconds.
EMITTED = Row("window", "complete", "completing_batch", "coverage", "dead", "cause")


class Rows:
    """Disjoint, sorted intervals of rows, inclusive."""

    def __init__(self, pairs: list[tuple[int, int]]) -> None:
        self.pairs = pairs

    def add(self, a: int, b: int) -> None:
        kept = [(x, y) for x, y in self.pairs if y < a - 1 or x > b + 1]
        met = [(x, y) for x, y in self.pairs if not (y < a - 1 or x > b + 1)]
        kept.insert(bisect_left(kept, (a, b)), (min([a, *(x for x, _ in met)]), max([b, *(y for _, y in met)])))
        self.pairs = kept

    def take(self, a: int, b: int) -> None:
        self.pairs = [p for x, y in self.pairs for p in ((x, min(y, a - 1)), (max(x, b + 1), y)) if p[0] <= p[1]]

    def within(self, a: int, b: int) -> list[tuple[int, int]]:
        return [(max(x, a), min(y, b)) for x, y in self.pairs if x <= b and y >= a]

    def count(self, a: int, b: int) -> int:
        return sum(y - x + 1 for x, y in self.within(a, b))


class HoleProcessor(StatefulProcessor):
    """One group of windows. Its state is one value, since each look at a state variable is a message between Spark and the worker:
    the events that wait until the watermark has passed them, the instant of the timer for the earliest of them (milliseconds), the
    live rows, those that holes took, and the open windows (null before the first event counts)."""

    EVENT = ("instant", "way", "rank", "a", "b", "cause")
    STATE = "instant array<long>, way array<int>, rank array<long>, a array<long>, b array<long>, cause array<string>, timer long, live_a array<long>, live_b array<long>, gone_a array<long>, gone_b array<long>, open array<long>"

    def __init__(self, size: int, step: int, context: int, rows: int, min_coverage: float, group: int) -> None:
        self.size, self.step, self.context, self.rows, self.min_coverage, self.group = size, step, context, rows, min_coverage, group

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getValueState("held", self.STATE)

    def read(self) -> tuple[list[tuple], int | None, Rows, Rows, list[int] | None]:
        found = self.held.get()
        if found is None:
            return [], None, Rows([]), Rows([]), None
        pairs = lambda a, b: Rows(list(zip(a, b, strict=True)))
        return list(zip(*found[:6], strict=True)), found[6], pairs(*found[7:9]), pairs(*found[9:11]), found[11]

    def write(self, waiting: list[tuple], timer: int | None, live: Rows, gone: Rows, waits: list[int] | None) -> None:
        """Timers fire, in the micro-batch itself, where the watermark has passed their instant."""
        earliest = -(-min(e[0] for e in waiting) // 1000) if waiting else None
        if earliest is not None and (timer is None or earliest < timer):
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(earliest)
            timer = earliest
        split = lambda r: ([x for x, _ in r.pairs], [y for _, y in r.pairs])
        self.held.update((*([e[k] for e in waiting] for k in range(6)), timer, *split(live), *split(gone), waits))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        fresh = [tuple(r[c] for c in self.EVENT) for r in rows if r["way"] is not None]
        if fresh:
            waiting, *rest = self.read()
            self.write(waiting + fresh, *rest)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        waiting, _, live, gone, waits = self.read()
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        due = sorted((e for e in waiting if e[0] <= passed), key=lambda e: (*e[:5], e[5] is None, e[5] or ""))
        first = key[0] * self.group + 1
        last = min((self.rows - self.size) // self.step + 1, first + self.group - 1)
        still, out = set(range(first, last + 1) if waits is None else waits), []
        reach = self.context * self.size
        for at, kind, rank, a, b, cause in due:
            if kind == 1:
                arrived = Rows([(a, b)])
                for x, y in gone.within(a, b):
                    arrived.take(x, y)
                for x, y in arrived.pairs:
                    live.add(x, y)
            else:
                live.take(a, b)
                gone.add(a, b)
            for w in range(max(first, -(-(a - reach - self.size) // self.step) + 1), min(last, (b + reach - 1) // self.step + 1) + 1):  # those whose stretch the event meets
                if w in still and (settled := self.settled(w, live, gone, kind, a, b)) is not None:
                    still.remove(w)
                    out.append(EMITTED(w, at, rank, settled, None, None) if kind == 1 else EMITTED(w, None, None, None, at, cause))
        self.write([e for e in waiting if e[0] > passed], None, live, gone, sorted(still))
        return iter(out)

    def settled(self, w: int, live: Rows, gone: Rows, kind: int, a: int, b: int) -> float | None:
        """What an event on rows a to b makes of an open window: its coverage if it is complete, -1 if it is dead, None if it waits."""
        f, l = (w - 1) * self.step + 1, (w - 1) * self.step + self.size
        x, y = max(1, f - self.context * self.size), min(self.rows, l + self.context * self.size)
        if b < x or a > y:
            return None
        need = math.ceil(round((y - x + 1) * self.min_coverage, 6))
        if kind == 0:
            return -1.0 if gone.count(f, l) or gone.count(x, y) > y - x + 1 - need else None
        covered = live.count(x, y)
        return covered / (y - x + 1) if covered >= need and live.count(f, l) == self.size else None


def follow_holes(feed: DataFrame, *, size: int, step: int, context: int, rows: int, per_batch: int, min_coverage: float = 1.0, delay: str = "1 hour", group: int = 64) -> DataFrame:
    """feed(FEED), streaming, holes widened already -> SETTLED, a row for each window once it is complete or dead."""
    count = max(0, (rows - size) // step + 1)
    low, high = F.when(F.col("kind") == "arrival", (F.col("batch") - 1) * per_batch + 1).otherwise(F.col("row_start")), F.when(F.col("kind") == "arrival", F.col("batch") * per_batch).otherwise(F.col("row_end"))
    first = F.greatest(F.ceil((low - size - context * size) / F.lit(step)) + 1, F.lit(1))
    last = F.least(F.floor((high + context * size - 1) / F.lit(step)) + 1, F.lit(count))
    cell = lambda c: F.floor((c - 1) / F.lit(group)).cast("long")
    cells = F.when(F.col("kind") == "final", F.array(F.lit(0).cast("long"))).when(first <= last, F.sequence(cell(first), cell(last))).otherwise(F.array().cast("array<bigint>"))
    came, told = F.col("kind") == "arrival", F.col("kind") == "hole"
    event = [F.unix_micros("at").alias("instant"), F.when(came, 1).when(told, 0).alias("way"), F.when(came, F.col("batch")).otherwise(cause_rank(F.col("cause"))).alias("rank"), low.alias("a"), F.when(came, F.least(high, F.lit(rows))).otherwise(high).alias("b"), "cause"]
    dealt = feed.withWatermark("at", delay).select("at", *event, F.explode(cells).alias("g"))
    made = HoleProcessor(size, step, context, rows, min_coverage, group)
    settled = dealt.groupBy("g").transformWithState(made, "window long, complete long, completing_batch long, coverage double, dead long, cause string", "append", "eventTime")
    return settled.select("window", F.timestamp_micros("complete").alias("complete_at"), "completing_batch", "coverage", F.timestamp_micros("dead").alias("dead_at"), "cause")


class Commit:
    """Ordered release of a stream of settled windows: take() is for foreachBatch, finish() for the end of the feed, table() reads what
    came out: window, state, settled_at, cause, release_at, complete_at. A window that was given up and completes after that has
    two rows, `gap` first, then `late`; only() keeps the last."""

    COLUMNS = ("window", "state", "settled_at", "cause", "release_at", "complete_at")

    def __init__(self, spark: SparkSession, folder: str, windows: int, horizon_seconds: float | None = None, late_policy: str = "skip", block: int = 100_000) -> None:
        self.spark, self.folder, self.windows, self.horizon, self.refuses, self.block = spark, folder, windows, horizon_seconds, holes.refusing(late_policy), block

    def _at(self, kind: str, version: int) -> str:
        return f"{self.folder}/{kind}/v={version}"

    def _border(self, version: int) -> tuple[int, datetime | None, datetime | None]:
        """The first window that isn't settled, the latest release before it, and the mission time of a version."""
        if version < 0:
            return 1, None, None
        return tuple(self.spark.read.schema("border long, latest timestamp, until timestamp").parquet(self._at("border", version)).first())

    def take(self, batch: DataFrame, version: int) -> None:
        self._advance(batch.select(*(c.split()[0] for c in SETTLED.split(", "))), version, None)

    def finish(self, end_at: datetime) -> None:
        """After the last micro-batch: windows that wait are undelivered."""
        last = self.spark.read.parquet(f"{self.folder}/border").agg(F.max("v")).first()[0]
        self._advance(self.spark.createDataFrame([], SETTLED), last + 1, end_at)

    def _advance(self, fresh: DataFrame, version: int, end_at: datetime | None) -> None:
        border, latest, until = self._border(version - 1)
        fresh = fresh.persist()
        try:
            until = max(filter(None, [until, fresh.agg(F.max(F.coalesce("complete_at", "dead_at"))).first()[0]]), default=None)
            behind = fresh.where((F.col("window") < border) & F.col("complete_at").isNotNull())
            if self.refuses:
                holes.refuse(behind)
            held = fresh.where(F.col("window") >= border)
            if version > 0:
                held = held.unionByName(self.spark.read.schema(SETTLED).parquet(self._at("held", version - 1)))
            top = self.windows if end_at else held.agg(F.max("window")).first()[0] or 0
            every = self.spark.range(border, max(border, top + 1)).withColumnRenamed("id", "window").join(held, "window", "left")
            now = F.lit(end_at or until or EPOCH).cast("timestamp")
            marked = holes.judged(every, now, self.horizon, end_at is not None, self.block).persist()
            first_open = marked.where("state = 'open'").agg(F.min("window")).first()[0] or max(border, top + 1)
            done = marked.where(F.col("window") < first_open)
            if self.refuses:
                holes.refuse(done.where("state = 'late'"))
            out = holes.released(done, self.block, F.lit(latest).cast("timestamp"))
            skipped = behind.select("window", F.lit("late").alias("state"), F.lit(None).cast("timestamp").alias("settled_at"), F.lit("horizon").alias("cause"), F.lit(None).cast("timestamp").alias("release_at"), "complete_at")
            out.select(*self.COLUMNS).unionByName(skipped).write.mode("overwrite").parquet(self._at("out", version))
            held.where(F.col("window") >= first_open).write.mode("overwrite").parquet(self._at("held", version))
            latest = max(filter(None, [latest, done.agg(F.max("settled_at")).first()[0]]), default=None)
            border_row = self.spark.createDataFrame([(first_open, latest, until)], "border long, latest timestamp, until timestamp")
            border_row.coalesce(1).write.mode("overwrite").parquet(self._at("border", version))
            marked.unpersist()
        finally:
            fresh.unpersist()

    def table(self) -> DataFrame:
        kinds = "window long, state string, settled_at timestamp, cause string, release_at timestamp, complete_at timestamp, v int"
        return self.spark.read.schema(kinds).parquet(f"{self.folder}/out").drop("v")

    def only(self) -> DataFrame:
        """One row a window: late where it was given up and came after that, with the instant at which it was given up."""
        rows = self.table().groupBy("window").agg(F.max("state").alias("last"), *(F.max(c).alias(c) for c in self.COLUMNS[2:]), F.count("*").alias("n"))
        return rows.select("window", F.when(F.col("n") > 1, "late").otherwise(F.col("last")).alias("state"), *self.COLUMNS[2:])


def run_available(spark: SparkSession, sink, checkpoint: str) -> None:
    name, old = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        sink.option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, old)


def _stream(feed: DataFrame, batches: int, folder: str) -> DataFrame:
    """A finished feed as a stream of so many micro-batches, each in files for all tasks at once: no task writes or reads all of it."""
    files = feed.sparkSession.sparkContext.defaultParallelism
    feed.repartition(batches * files).write.parquet(f"{folder}/in")
    return feed.sparkSession.readStream.schema(FEED).option("maxFilesPerTrigger", files).parquet(f"{folder}/in")


def follow_holes_once(feed: DataFrame, batches: int = 1, **geometry) -> DataFrame:
    """Streams a finished feed, in `batches` micro-batches, through follow_holes() and returns what it emitted, as a table."""
    spark, folder = feed.sparkSession, folder_for(feed.sparkSession)
    live = follow_holes(_stream(feed, batches, folder), **geometry)
    run_available(spark, live.writeStream.format("parquet").option("path", f"{folder}/out"), f"{folder}/state")
    return spark.read.schema(SETTLED).parquet(f"{folder}/out")


def commit_once(feed: DataFrame, end_at: datetime, batches: int = 1, horizon_seconds: float | None = None, late_policy: str = "skip", **geometry) -> Commit:
    """Streams a finished feed through follow_holes() and the ordered commit."""
    spark, folder = feed.sparkSession, folder_for(feed.sparkSession)
    commit = Commit(spark, f"{folder}/commit", max(0, (geometry["rows"] - geometry["size"]) // geometry["step"] + 1), horizon_seconds, late_policy)
    live = follow_holes(_stream(feed, batches, folder), **geometry)
    run_available(spark, live.writeStream.foreachBatch(commit.take), f"{folder}/state")
    commit.finish(end_at)
    return commit
