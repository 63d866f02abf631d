"""Count-based sliding windows, blocks of windows and gap-free stretches.

Rows and windows are numbered from 1; window w holds rows (w-1)*step+1 to (w-1)*step+size.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.operators.intervals import islands


@dataclass(frozen=True)
class Range:
    """Inclusive range of windows; empty when last < first."""

    first: int
    last: int

    def __len__(self) -> int:
        return max(0, self.last - self.first + 1)

    def holds(self, index: Column) -> Column:
        return index.between(self.first, self.last)


def window_count(rows: int, size: int, step: int) -> int:
    if not 0 < step <= size:
        raise ValueError("step must be 1 to the window size")
    return max(0, (rows - size) // step + 1)


def edge_margin(windows: int, size: int, step: int) -> int:
    """Windows to drop at each end for a margin of so many window lengths."""
    return round(windows * size / step)


def windows_of_row(row: Column, size: int, step: int, count: int | Column) -> Column:
    """Array of the windows that hold a row; empty outside the last window."""
    count = F.lit(count) if isinstance(count, int) else count
    low = F.greatest(F.lit(1), F.ceil((row - size) / F.lit(step)) + 1).cast("long")
    high = F.least(count.cast("long"), F.floor((row - 1) / F.lit(step)) + 1).cast("long")
    return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))


def sliding(record: DataFrame, size: int, step: int, rows: int) -> DataFrame:
    """record(row, ...) -> one row for each row and window that holds it; no shuffle."""
    return record.withColumn("window", F.explode(windows_of_row(F.col("row"), size, step, window_count(rows, size, step))))


def window_table(record_windows: DataFrame, size: int, step: int) -> DataFrame:
    return record_windows.withColumns({"row_start": (F.col("window") - 1) * step + 1, "row_end": (F.col("window") - 1) * step + size})


def window_labels(labelled: DataFrame, size: int, step: int, rows: int) -> DataFrame:
    """A window is positive if any labelled row lies inside."""
    return sliding(labelled, size, step, rows).groupBy("window").agg(F.max("label").alias("label"))


def conditioning_rows(window: Column, size: int, step: int, context: int, rows: int) -> tuple[Column, Column]:
    """A window's rows with context window lengths on both sides, cut to the record."""
    first, last = (window - 1) * step + 1 - context * size, (window - 1) * step + size + context * size
    return F.greatest(first, F.lit(1)), F.least(last, F.lit(rows))


def buffer_windows(size: int, step: int) -> int:
    return math.ceil(size / step)


def chronological_split(n: int, train: float, validation: float, buffer: int) -> dict[str, Range]:
    """Blocks in time order with a buffer between them; the test block ends with the record."""
    a, b = math.floor(train * n), math.floor((train + validation) * n)
    blocks = {"train": Range(1, a), "validation": Range(a + buffer + 1, b), "test": Range(b + buffer + 1, n)}
    if empty := [k for k, r in blocks.items() if not len(r)]:
        raise ValueError(f"empty blocks: {', '.join(empty)}")
    return blocks


def calibration_split(n: int, fraction: float, buffer: int) -> dict[str, Range]:
    a = math.floor(fraction * n)
    blocks = {"calibration": Range(1, a), "evaluation": Range(a + buffer + 1, n)}
    if empty := [k for k, r in blocks.items() if not len(r)]:
        raise ValueError(f"empty blocks: {', '.join(empty)}")
    return blocks


def threshold_rows(blocks: dict[str, Range], which: str) -> Range:
    """The block on which a threshold is fitted; held_out is contiguous and includes the inner buffer."""
    if which == "held_out":
        return Range(blocks["validation"].first, blocks["test"].last)
    return blocks[which]


def block_column(index: Column, blocks: dict[str, Range]) -> Column:
    out = F.lit(None).cast("string")
    for name, block in blocks.items():
        out = F.when(block.holds(index), F.lit(name)).otherwise(out)
    return out


def restrict(df: DataFrame, blocks: dict[str, Range], name: str, index: str = "window") -> DataFrame:
    if name == "all":
        return df
    if name not in blocks:
        raise ValueError(f"unknown block {name}; known: all, {', '.join(blocks)}")
    return df.where(blocks[name].holds(F.col(index)))


def finite_stretches(record: DataFrame, value: str = "value", block: int = 1_000_000) -> DataFrame:
    """stretch_start, stretch_end of maximal runs of rows with a finite value."""
    ok = record.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))).select(F.lit(0).alias("series"), F.col("row").alias("idx"))
    return islands(ok, block).select(F.col("start").alias("stretch_start"), F.col("end").alias("stretch_end"))


def stretch_windows(stretches: DataFrame, size: int, step: int) -> DataFrame:
    """Record window index of every window that lies inside one stretch."""
    first = F.ceil((F.col("stretch_start") - 1) / F.lit(step)) + 1
    last = F.floor((F.col("stretch_end") - size) / F.lit(step)) + 1
    return stretches.where(first <= last).select("stretch_start", F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("window"))
