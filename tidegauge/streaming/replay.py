"""Live delivery: a stream of batch arrivals becomes a stream of completed windows, the same rows as the batch plan.

Windows are keyed by groups of neighbours, so state spreads over the cluster; a group keeps the arrival of
each batch its stretches need and emits a window once, at the arrival that completes it. There is no
watermark: windows that are never delivered stay open, as in the batch plan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidegauge.tables import folder_for


def follow(arrivals: DataFrame, *, size: int, step: int, context: int, rows: int, per_batch: int, group: int = 64) -> DataFrame:
    """arrivals(batch long, arrived_at double), streaming -> window, complete_at."""
    count = max(0, (rows - size) // step + 1)

    def stretch(w: int) -> tuple[int, int]:
        first, last = max(1, (w - 1) * step + 1 - context * size), min(rows, (w - 1) * step + size + context * size)
        return (first - 1) // per_batch + 1, (last - 1) // per_batch + 1

    low = F.greatest(F.ceil(((F.col("batch") - 1) * per_batch + 1 - size - context * size) / F.lit(step)) + 1, F.lit(1))
    high = F.least(F.floor((F.col("batch") * per_batch + context * size - 1) / F.lit(step)) + 1, F.lit(count))
    cell = lambda c: F.floor((c - 1) / F.lit(group)).cast("long")
    dealt = arrivals.withColumn("g", F.explode(F.when(low <= high, F.sequence(cell(low), cell(high))).otherwise(F.array().cast("array<bigint>"))))

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, done = ({}, set()) if not state.exists else (dict(zip(state.get[0], state.get[1], strict=True)), set(state.get[2]))
        for rows_ in batches:
            for b, t in zip(rows_["batch"], rows_["arrived_at"], strict=True):
                seen[int(b)] = min(float(t), seen.get(int(b), float("inf")))
        out = []
        for w in range(key[0] * group + 1, min(count, (key[0] + 1) * group) + 1):
            if w not in done:
                a, b = stretch(w)
                if all(k in seen for k in range(a, b + 1)):
                    out.append((w, max(seen[k] for k in range(a, b + 1))))
                    done.add(w)
        state.update((list(seen), list(seen.values()), sorted(done)))
        yield pd.DataFrame(out, columns=["window", "complete_at"])

    return dealt.groupBy("g").applyInPandasWithState(update, "window long, complete_at double", "batches array<long>, times array<double>, done array<long>", "append", GroupStateTimeout.NoTimeout)


def each_window(scored: DataFrame, callback: Callable[[DataFrame, dict], None], checkpoint: str, every: int = 100, log: Callable[[str], None] = print):
    """Starts a stream of scored(window, decision, ...) that hands every micro-batch to callback with the counts so far, and
    logs them each `every` windows. The counts behind a micro-batch are a table of its number below the checkpoint, so a query
    started again goes on from them, and a micro-batch that runs again counts once; its callback is called again."""
    spark, place = scored.sparkSession, lambda version: f"{checkpoint.rstrip('/')}/counts/v={version}"

    def take(batch: DataFrame, version: int) -> None:
        got = batch.agg(F.count("*").alias("n"), F.coalesce(F.sum("decision"), F.lit(0)).alias("a")).first()
        before = spark.read.schema("windows long, alarms long").parquet(place(version - 1)).first() if version else {"windows": 0, "alarms": 0}
        counts = {"windows": before["windows"] + got["n"], "alarms": before["alarms"] + got["a"]}
        callback(batch, dict(counts))
        spark.createDataFrame([tuple(counts.values())], "windows long, alarms long").coalesce(1).write.mode("overwrite").parquet(place(version))
        if counts["windows"] // every > before["windows"] // every:
            log(f"{counts['windows']} windows scored, {counts['alarms']} alarms")

    return scored.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def follow_once(arrivals: DataFrame, **geometry) -> DataFrame:
    """Streams a finished feed through follow() and returns what it emitted, as a table."""
    spark = arrivals.sparkSession
    folder = folder_for(spark)
    arrivals.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(arrivals.schema).parquet(f"{folder}/in")
    query = follow(stream, **geometry).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema("window long, complete_at double").parquet(f"{folder}/out")
