"""Delivery of a record in batches: coverage, holes, and the instant at which each window can be scored.

Batch k carries rows (k-1)*p+1 to k*p. A window is complete when its own rows have arrived and its stretch
(the window with context on both sides) is covered to the asked part; a permanent hole that is declared by
then keeps it from ever being scored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.operators.intervals import islands


def batch_rows(batch: Column, per_batch: int) -> tuple[Column, Column]:
    return (batch - 1) * per_batch + 1, batch * per_batch


def batch_of_row(row: Column, per_batch: int) -> Column:
    return F.floor((row - 1) / F.lit(per_batch)).cast("long") + 1


def rows_per_batch(rate: float, segment_seconds: float, segments: int) -> int:
    rows = rate * segment_seconds * segments
    if abs(rows - round(rows)) > 1e-9 or rows < 1:
        raise ValueError(f"{rows} rows in a batch")
    return round(rows)


def batch_number(name: Column) -> Column:
    """k of LIVE_batch_k; null for another name."""
    return F.when(name.rlike(r"^\w+_batch_\d+$"), F.regexp_extract(name, r"_batch_(\d+)$", 1).cast("long"))


def row_time(row: Column, start: Column, rate: float) -> Column:
    """Instant of a row: start + (row - 1) / rate."""
    return F.timestamp_micros(F.unix_micros(start) + F.round((row - 1) * F.lit(1e6 / rate)).cast("long"))


def stretch_batches(windows: DataFrame, size: int, step: int, context: int, rows: int, per_batch: int) -> DataFrame:
    """windows(window) -> window, batch, own (whether the batch holds rows of the window itself), weight (stretch rows in it)."""
    own_first, own_last = (F.col("window") - 1) * step + 1, (F.col("window") - 1) * step + size
    first, last = F.greatest(own_first - context * size, F.lit(1)), F.least(own_last + context * size, F.lit(rows))
    each = windows.select("window", own_first.alias("a"), own_last.alias("b"), first.alias("f"), last.alias("l"))
    each = each.withColumn("batch", F.explode(F.sequence(batch_of_row(F.col("f"), per_batch), batch_of_row(F.col("l"), per_batch))))
    low, high = batch_rows(F.col("batch"), per_batch)
    return each.select("window", "batch", ((low <= F.col("b")) & (high >= F.col("a"))).alias("own"), (F.least(high, F.col("l")) - F.greatest(low, F.col("f")) + 1).alias("weight"))


def completion(stretches: DataFrame, arrivals: DataFrame) -> DataFrame:
    """window, complete_at for windows whose whole stretch arrived; arrivals(batch, arrived_at), one a batch."""
    met = stretches.join(arrivals.groupBy("batch").agg(F.min("arrived_at").alias("arrived_at")), "batch", "left")
    whole = met.groupBy("window").agg(F.max("arrived_at").alias("complete_at"), F.count("*").alias("n"), F.count("arrived_at").alias("got"))
    return whole.where("n = got").select("window", "complete_at")


def completion_partial(stretches: DataFrame, arrivals: DataFrame, min_coverage: float) -> DataFrame:
    """The same where a part of the stretch is enough: the later of the own batches' last arrival and the arrival that
    reaches the asked number of rows. Without holes both only grow, so the first instant that meets them is theirs."""
    met = stretches.join(arrivals.groupBy("batch").agg(F.min("arrived_at").alias("arrived_at")), "batch", "left")
    need = met.groupBy("window").agg(F.ceil(F.sum("weight") * F.lit(min_coverage)).alias("need"), F.max(F.when(F.col("own"), F.col("arrived_at"))).alias("own_at"), F.sum(F.col("own").cast("int")).alias("n_own"), F.sum((F.col("own") & F.col("arrived_at").isNotNull()).cast("int")).alias("got_own"))
    order = Window.partitionBy("window").orderBy("arrived_at", "batch")  # the batches of one stretch
    so_far = met.where("arrived_at IS NOT NULL").withColumn("rows", F.sum("weight").over(order)).join(need, "window")
    reached = so_far.where("rows >= need").groupBy("window").agg(F.min("arrived_at").alias("k_at"))
    return need.where("n_own = got_own").join(reached, "window").select("window", F.greatest("own_at", "k_at").alias("complete_at"))


def eroded(holes: DataFrame, margin: int) -> DataFrame:
    """Permanent holes widened by the dilation margin, from their declaration on."""
    return holes.withColumns({"row_start": F.greatest(F.col("row_start") - margin, F.lit(1)), "row_end": F.col("row_end") + margin})


def dilation_rows(seconds: float, rate: float) -> int:
    return math.ceil(seconds * rate)


def kept_windows(complete: DataFrame, holes: DataFrame, size: int, step: int, context: int, rows: int, bin_rows: int = 10_000) -> DataFrame:
    """Anti-join: windows whose stretch meets a hole declared by their completion never count. Holes are widened already;
    both sides are keyed by bins of rows, so no nested loop arises."""
    first = F.greatest((F.col("window") - 1) * step + 1 - context * size, F.lit(1))
    last = F.least((F.col("window") - 1) * step + size + context * size, F.lit(rows))
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / bin_rows).cast("long"), F.floor(b / bin_rows).cast("long")))
    left = complete.withColumns({"_f": first, "_l": last})
    hit = left.withColumn("bin", bins(F.col("_f"), F.col("_l"))).join(holes.withColumn("bin", bins(F.col("row_start"), F.col("row_end"))), "bin")
    hit = hit.where((F.col("row_start") <= F.col("_l")) & (F.col("row_end") >= F.col("_f")) & (F.col("declared_at") <= F.col("complete_at"))).select("window").distinct()
    return complete.join(hit, "window", "left_anti")


def coverage(arrivals: DataFrame, per_batch: int) -> DataFrame:
    """Disjoint row intervals that have arrived: start, end."""
    runs = islands(arrivals.select(F.lit(0).alias("series"), F.col("batch").alias("idx")).distinct())
    return runs.select(((F.col("start") - 1) * per_batch + 1).alias("start"), (F.col("end") * per_batch).alias("end"))


def ordered_release(windows: DataFrame, block: int = 100_000) -> DataFrame:
    """release_at: a window is released when it and all before it are settled. Blocks of windows pass on their maxima,
    so no task holds all windows. windows(window, settled_at); a window that never settles blocks those after it."""
    dealt = windows.withColumn("b", F.floor(F.col("window") / block)).withColumn("open", F.col("settled_at").isNull().cast("int"))
    sums = dealt.groupBy("b").agg(F.max("settled_at").alias("m"), F.max("open").alias("o"))
    across = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # a row per block
    before = sums.select("b", F.max("m").over(across).alias("m"), F.coalesce(F.max("o").over(across), F.lit(0)).alias("o"))
    inside = Window.partitionBy("b").orderBy("window").rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.withColumns({"mine": F.max("settled_at").over(inside), "stuck": F.max("open").over(inside)}).join(before, "b")
    return out.select("window", "settled_at", F.when(F.greatest("stuck", "o") == 0, F.greatest("mine", "m")).alias("release_at"))


def gap_events(windows: DataFrame, scored: DataFrame) -> DataFrame:
    """Runs of windows that were never scored: start, end, n."""
    missing = windows.select("window").join(scored.select("window"), "window", "left_anti")
    return islands(missing.select(F.lit(0).alias("series"), F.col("window").alias("idx"))).drop("series")


def scheduled_record(record: DataFrame, batches: DataFrame, per_batch: int) -> DataFrame:
    """One run's delivery applied to another record: its rows with the arrival of their batch."""
    return record.withColumn("batch", batch_of_row(F.col("row"), per_batch)).join(batches, "batch")


def disagreements(record: DataFrame, carried: DataFrame, column: str) -> DataFrame:
    """Rows that a run carries and that differ from the record; a schedule applies only if there are none."""
    other = carried.select("row", F.col(column).alias("_carried"))
    return record.join(other, "row").where(~F.col(column).eqNullSafe(F.col("_carried")))


def mark_late(events: DataFrame, horizon_seconds: float) -> DataFrame:
    """events(window, complete_at, next_at): late when it completes more than the horizon after its successor did."""
    late = F.unix_micros("complete_at") > F.unix_micros("next_at") + F.lit(int(horizon_seconds * 1e6))
    return events.withColumn("late", F.coalesce(late, F.lit(False)))


def mission_day(window: Column, step: int, rate: float, first_window: int = 1) -> Column:
    """Day at which a window starts; first_window is the record index of the table's window 1 (1 where the table carries record indices)."""
    return (F.lit(first_window - 2) + window) * F.lit(step / rate / 86_400.0) if first_window != 1 else (window - 1) * F.lit(step / rate / 86_400.0)


def replay_geometry(windows: DataFrame) -> DataFrame:
    """windows(window, row_start, row_end, content_start, content_end) -> interval (seconds a row) and epoch (instant of row 1), from the first window."""
    first = windows.agg(F.min_by(F.struct("row_start", "row_end", "content_start", "content_end"), "window").alias("w")).select("w.*").where("row_end > row_start")
    micros = (F.unix_micros("content_end") - F.unix_micros("content_start")) / (F.col("row_end") - F.col("row_start"))
    epoch = F.timestamp_micros(F.unix_micros("content_start") - F.round(micros * (F.col("row_start") - 1)).cast("long"))
    return first.select((micros / F.lit(1e6)).alias("interval"), epoch.alias("epoch"))


def scored_at() -> Column:
    return F.coalesce("release_at", "complete_at")
