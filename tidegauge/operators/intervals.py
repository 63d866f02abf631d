"""Islands of consecutive indices, unions of intervals, and running sums that no single task has to hold.

Each operator works within blocks of the index first and then on what touches block borders, which is
smaller by the block's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.tables import written


def islands(rows: DataFrame, block: int = 1_000_000) -> DataFrame:
    """rows(series, idx), distinct -> series, start, end, n for each run of consecutive indices."""
    dealt = rows.select("series", "idx", F.floor(F.col("idx") / F.lit(block)).alias("b"))
    place = F.row_number().over(Window.partitionBy("series", "b").orderBy("idx"))
    parts = dealt.withColumn("g", F.col("idx") - place).groupBy("series", "b", "g").agg(F.min("idx").alias("start"), F.max("idx").alias("end"))
    edge = (F.col("start") == F.col("b") * block) | (F.col("end") == (F.col("b") + 1) * block - 1)
    inner = parts.where(~edge).select("series", "start", "end")
    by_series = Window.partitionBy("series").orderBy("start")  # two parts for each block at most
    new = (F.col("start") != F.lag("end").over(by_series) + 1) | F.lag("end").over(by_series).isNull()
    joined = parts.where(edge).select("series", "start", "end").withColumn("new", new.cast("int")).withColumn("k", F.sum("new").over(by_series))
    outer = joined.groupBy("series", "k").agg(F.min("start").alias("start"), F.max("end").alias("end")).select("series", "start", "end")
    return inner.unionByName(outer).withColumn("n", F.col("end") - F.col("start") + 1)


def union_intervals(intervals: DataFrame, block: int = 1_000_000) -> DataFrame:
    """intervals(series, start, end), inclusive -> maximal covered intervals. Blocks of starts are merged on their own, knowing
    the furthest end of the blocks before; then the first and last parts of blocks are merged, two for each block at most."""
    longest = intervals.groupBy("series", "start").agg(F.max("end").alias("end")).withColumn("b", F.floor(F.col("start") / F.lit(block)))
    before = Window.partitionBy("series").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    carried = longest.groupBy("series", "b").agg(F.max("end").alias("far")).select("series", "b", F.max("far").over(before).alias("far"))
    order = Window.partitionBy("series", "b").orderBy("start")
    reach = F.greatest(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.col("far"))  # greatest() skips nulls
    marked = longest.join(carried, ["series", "b"]).withColumn("new", F.coalesce((F.col("start") > reach + 1).cast("int"), F.lit(1)))
    parts = marked.withColumn("k", F.sum("new").over(order)).groupBy("series", "b", "k").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    parts = parts.withColumn("edge", (F.col("k") == 0) | (F.col("k") == F.max("k").over(Window.partitionBy("series", "b"))))
    by_series = Window.partitionBy("series").orderBy("b", "k")
    joined = parts.where("edge").withColumn("o", F.sum((F.col("k") > 0).cast("int")).over(by_series))
    outer = joined.groupBy("series", "o").agg(F.min("start").alias("start"), F.max("end").alias("end")).select("series", "start", "end")
    return parts.where("NOT edge").select("series", "start", "end").unionByName(outer)


def dilated(first: Column, last: Column, margin: int) -> tuple[Column, Column]:
    return F.greatest(first - margin, F.lit(1)), last + margin


def touching(windows: DataFrame, spans: DataFrame, bin_rows: int = 10_000) -> DataFrame:
    """Pairs of windows(row_start, row_end) and spans(start, end) that overlap, joined by bins of rows instead of a nested loop."""
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bin_rows).cast("long"), F.floor(F.col(b) / bin_rows).cast("long")))
    left, right = windows.withColumn("bin", bins("row_start", "row_end")), spans.withColumn("bin", bins("start", "end"))
    met = left.join(right, "bin").where((F.col("start") <= F.col("row_end")) & (F.col("end") >= F.col("row_start")))
    return met.where(F.col("bin") == F.floor(F.greatest("start", "row_start") / bin_rows)).drop("bin")


def ranges(rows: DataFrame, key: str, parts: int | None = None, descending: bool = True) -> DataFrame:
    """rows as a table with _b, the number of a range of the key; ranges are about equally full whatever the keys' spread
    (Spark's range partitioning), in the key's order, and as many as `parts` or the session's shuffle partitions."""
    count = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(rows.repartitionByRange(count, F.desc(key) if descending else F.asc(key)).withColumn("_b", F.spark_partition_id()))


def running_sums(rows: DataFrame, key: str, sums: dict[str, str], parts: int | None = None, descending: bool = True) -> DataFrame:
    """rows(key, distinct) with running sums; ranges of the key are summed first, so a task holds one range. A null key comes
    last in descending order, first in ascending order."""
    dealt = ranges(rows, key, parts, descending)
    totals = dealt.groupBy("_b").agg(*(F.sum(v).alias(f"_{k}") for k, v in sums.items()))
    across = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    before = totals.select("_b", *(F.coalesce(F.sum(f"_{k}").over(across), F.lit(0)).alias(f"_{k}") for k in sums))
    inside = Window.partitionBy("_b").orderBy(F.desc(key) if descending else F.asc(key))
    out = dealt.withColumns({k: F.sum(v).over(inside) for k, v in sums.items()}).join(F.broadcast(before), "_b")
    return out.withColumns({k: F.col(k) + F.col(f"_{k}") for k in sums}).drop("_b", *(f"_{k}" for k in sums))
