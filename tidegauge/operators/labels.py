"""Labels from a signal's strength: spans, onsets, peaks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.operators.intervals import union_intervals


def fixed_spans(events: DataFrame, before_s: float, after_s: float, rate: float, rows: int) -> DataFrame:
    """event, start, end: rows from before_s before to after_s after the event, cut to the record."""
    at = F.col("merger_time_s")
    return events.select("event", F.greatest(F.floor((at - before_s) * rate).cast("long") + 1, F.lit(1)).alias("start"), F.least(F.floor((at + after_s) * rate).cast("long") + 1, F.lit(rows)).alias("end"))


def detectable_spans(strength: DataFrame, threshold: float, size: int, step: int) -> DataFrame:
    """strength(event, window, snr) -> rows from the first to the last window at or above the threshold."""
    found = strength.where(F.col("snr") >= threshold).groupBy("event").agg(F.min("window").alias("a"), F.max("window").alias("b"))
    return found.select("event", ((F.col("a") - 1) * step + 1).alias("start"), ((F.col("b") - 1) * step + size).alias("end"))


def span_labels(spans: DataFrame) -> DataFrame:
    """Overlapping or adjacent spans merge into one label run."""
    return union_intervals(spans.select(F.lit(0).alias("series"), "start", "end")).drop("series")


def row_labels(record: DataFrame, spans: DataFrame, bin_rows: int = 10_000) -> DataFrame:
    """record(row) with label 1 inside a span; spans are keyed by bins of rows."""
    runs = span_labels(spans)
    keyed = runs.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start") / bin_rows).cast("long"), F.floor(F.col("end") / bin_rows).cast("long"))))
    inside = record.select("row").withColumn("_bin", F.floor(F.col("row") / bin_rows)).join(keyed, "_bin").where("row BETWEEN start AND end").select("row", F.lit(1).alias("label"))
    return record.join(inside, "row", "left").withColumn("label", F.coalesce("label", F.lit(0)))


def signal_onsets(strength: DataFrame, spans: DataFrame, threshold: float, size: int, step: int) -> DataFrame:
    """event, onset: first row of the first window inside the span, and past the preceding span, at or above the threshold."""
    order = Window.orderBy("event")  # a row per event
    bounds = spans.withColumn("past", F.coalesce(F.lag("end").over(order), F.lit(0)))
    row = (F.col("window") - 1) * step + 1
    met = strength.join(bounds, "event").where((F.col("snr") >= threshold) & (row + size - 1 >= F.col("start")) & (row <= F.col("end")) & (row > F.col("past")))
    return met.groupBy("event").agg(F.min(row).alias("onset"))


def network(a: Column, e: Column) -> Column:
    """Strength over two channels: the root of summed squares."""
    return F.sqrt(a * a + e * e)


def snr_peaks(strength: DataFrame, threshold: float, separation: int, ratio: float, block: int = 1_000_000) -> DataFrame:
    """strength(window, snr) -> peaks: local maxima at or above the threshold; of two closer than `separation` the greater
    stays; an earlier peak below `ratio` of the next within it merges into the later. Only maxima reach the greedy pass."""
    before, after = (strength.select((F.col("window") + k).alias("window"), F.col("snr").alias(n)) for k, n in ((1, "b"), (-1, "a")))
    top = strength.join(before, "window", "left").join(after, "window", "left").where((F.col("snr") >= threshold) & (F.col("snr") > F.coalesce("b", F.lit(float("-inf")))) & (F.col("snr") >= F.coalesce("a", F.lit(float("-inf")))))

    def keep(rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, float]] = []
        for w, s in rows.sort_values("window")[["window", "snr"]].itertuples(index=False):
            if out and w - out[-1][0] < separation:
                if out[-1][1] < s or out[-1][1] < ratio * s:
                    out[-1] = (w, s)
                continue
            out.append((w, s))
        return pd.DataFrame(out, columns=["window", "snr"])

    # Groups of maxima closer than the separation are independent, so each is a group of its own. Blocks of windows
    # number their groups alone and pass on their last maximum and their number of groups, a row for each block.
    dealt = top.select("window", "snr", F.floor(F.col("window") / block).alias("block"))
    inside, across = Window.partitionBy("block").orderBy("window"), Window.orderBy("block")
    near = dealt.withColumn("new", (F.col("window") - F.lag("window").over(inside) >= separation).cast("int"))
    ends = near.groupBy("block").agg(F.min("window").alias("low"), F.max("window").alias("high"), F.coalesce(F.sum("new"), F.lit(0)).alias("more"))
    first = F.coalesce((F.col("low") - F.lag("high").over(across) >= separation).cast("int"), F.lit(1))
    ends = ends.withColumn("first", first).select("block", "first", (F.sum(F.col("first") + F.col("more")).over(across) - F.col("more")).alias("base"))
    grouped = near.join(ends, "block").withColumn("g", F.col("base") + F.coalesce(F.sum("new").over(inside), F.lit(0))).select("window", "snr", "g")
    return grouped.groupBy("g").applyInPandas(keep, "window long, snr double")
