"""Conditioning of single windows from what a delivery covers, and strength of windows of a whitened signal."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions import psd as densities
from tidegauge.functions import spectral
from tidegauge.operators.windows import conditioning_rows, sliding


def edge_rows(periods: float, rate: float, cutoff: float) -> int:
    """Rows that the high-pass rings over at each end of a delivered run; none without a high-pass."""
    return round(periods * rate / cutoff) if cutoff > 0 else 0


def within_payload(windows: DataFrame, size: int, step: int, ingested_rows: int) -> DataFrame:
    """Windows whose rows all lie before the payload's end; later ones are never scored."""
    return windows.where((F.col("window") - 1) * step + size <= ingested_rows)


def contiguous_clips(windows: DataFrame, covered: DataFrame, size: int, step: int, context: int, rows: int, bin_rows: int = 10_000) -> DataFrame:
    """windows(window), covered(start, end), disjoint -> window, first, last: the stretch that conditions a window, cut to the
    covered interval that holds the window; windows that no interval holds have no row. Intervals meet windows by bins of rows."""
    low, high = conditioning_rows(F.col("window"), size, step, context, rows)
    own = windows.select("window", ((F.col("window") - 1) * step + 1).alias("a"), ((F.col("window") - 1) * step + size).alias("b"), low.alias("f"), high.alias("l"))
    cell = lambda c: F.floor((F.col(c) - 1) / F.lit(bin_rows)).cast("long")
    keyed = covered.withColumn("_bin", F.explode(F.sequence(cell("start"), cell("end"))))
    met = own.withColumn("_bin", cell("a")).join(keyed, "_bin").where("start <= a AND end >= b")
    return met.select("window", F.greatest("f", "start").alias("first"), F.least("l", "end").alias("last"))


def condition_windows(record: DataFrame, clips: DataFrame, size: int, step: int, rate: float, knots: list[tuple[float, float]] | None, cutoff: float = 0.0, order: int = 8, bin_rows: int = 1000) -> DataFrame:
    """record(row, value) or (row, channel, value), clips(window, first, last[, f, s]) -> window[, channel], x: the stretch is
    conditioned as a whole and the window cut from it, by the knots given or by a window's own (arrays f and s, null for
    the given). A window is the unit: its stretch holds a few window lengths."""
    own_density = "f" in clips.columns
    key = ["window", *(["channel"] if "channel" in record.columns else [])]
    cell = lambda c: F.floor((F.col(c) - 1) / F.lit(bin_rows)).cast("long")
    dealt = clips.select("window", "first", "last").withColumn("_bin", F.explode(F.sequence(cell("first"), cell("last"))))
    rows = record.withColumn("_bin", cell("row")).join(dealt, "_bin").where("row BETWEEN first AND last")
    whole = rows.groupBy(*key, "first").agg(F.array_sort(F.collect_list(F.struct("row", "value"))).alias("r"))
    if own_density:
        whole = whole.join(clips.select("window", "f", "s"), "window")
    f, s = (np.array(x) for x in zip(*knots, strict=True)) if knots else (None, None)

    @F.pandas_udf("array<double>")
    def cut(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for xs, at, *own in batches:
            each = zip(*own, strict=True) if own else ((None, None) for _ in xs)
            done = (spectral.condition(np.asarray(x, float), rate, *((s, f) if of is None else (np.asarray(os, float), np.asarray(of, float))), cutoff, order) for x, (of, os) in zip(xs, each, strict=True))
            yield pd.Series([x[a : a + size] for x, a in zip(done, at, strict=True)], dtype=object)

    at = (F.col("window") - 1) * step + 1 - F.col("first")
    return whole.select(*key, cut(F.transform("r", lambda x: x["value"]), at.cast("long"), *(["f", "s"] if own_density else [])).alias("x"))


def window_strength(record: DataFrame, size: int, step: int, rows: int) -> DataFrame:
    """record(row, value), a signal whitened to unit variance of noise -> window, snr: the norm of each window."""
    return sliding(record.select("row", "value"), size, step, rows).groupBy("window").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("snr"))


def density_from_sidecar(sidecar: dict) -> Column | list[tuple[float, float]] | None:
    """The whitening density that a product's sidecar records: a Column of f for analytic kinds, knots for estimates, None for "none"."""
    if "psd" not in sidecar:
        raise ValueError("the sidecar records no kind of density")
    kind, f = sidecar["psd"], F.col("f")
    if kind == "none":
        return None
    if kind in ("model", "channel"):
        return (densities.sensitivity_psd if kind == "model" else densities.channel_psd)(f)
    needed = {"ldc": ("position", "test_mass", "second"), "welch": ("frequencies", "values"), "trailing": ("frequencies", "values")}.get(kind)
    if needed is None:
        raise ValueError(f"unknown density {kind}")
    if missing := [k for k in needed if k not in sidecar]:
        raise ValueError(f"the sidecar of a {kind} density lacks {', '.join(missing)}")
    if kind == "ldc":
        return densities.delay_psd(f, F.lit(float(sidecar["position"])), F.lit(float(sidecar["test_mass"])), bool(sidecar["second"]))
    return list(zip(map(float, sidecar["frequencies"]), map(float, sidecar["values"]), strict=True))
