"""Detectors: scorers as plain objects, the trailing density estimate, payload export and signal placement."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions import spectral
from tidegauge.operators import conditioning, delivery, models, scaler


class WindowScorer(Protocol):
    """A method for one window: its samples (rows x channels) in, a score out. stateful scorers ask for ordered windows."""

    stateful: bool

    def window_score(self, samples: np.ndarray) -> float: ...


@dataclass(frozen=True)
class ClassifierScorer:
    """Features of a conditioned window, encoded and classified; features maps samples to numbers."""

    model: models.Classifier
    scale: scaler.FeatureScaler
    features: object = field(default=None)
    stateful: bool = False

    @property
    def label(self) -> str:
        return self.model.label

    def window_score(self, samples: np.ndarray) -> float:
        return float(self.window_scores([samples])[0])

    def window_scores(self, windows: list[np.ndarray]) -> np.ndarray:
        """All windows of a batch in one simulation."""
        if not windows:
            return np.zeros(0)
        x = np.array([(self.features or default_features)(w) for w in windows], float)
        low, high = np.array(self.scale.lower), np.array(self.scale.upper)
        return score_array(self.model, (np.clip(x, low, high) - low) / (high - low) * self.scale.span)


@dataclass(frozen=True)
class StreamingDetector:
    """A model, its scaler and threshold, and the geometry and conditioning of the windows that it scores."""

    model: models.Classifier
    scale: scaler.FeatureScaler | None
    threshold: float
    size: int
    step: int
    rate: float
    context: int = 2
    knots: tuple[tuple[float, float], ...] | None = None
    cutoff: float = 0.0
    order: int = 8
    features: object = field(default=None)

    def __post_init__(self):
        if not 1 <= self.step <= self.size:
            raise ValueError(f"step {self.step} outside 1 to the window size {self.size}")
        scaler.require_scaler(self.scale)

    def detect(self, record: DataFrame, covered: DataFrame, windows: DataFrame, rows: int) -> DataFrame:
        """record(row, value), covered(start, end) and windows(window) -> window, probability, decision; each window is
        conditioned in the covered stretch around it, windows that aren't wholly covered have no row."""
        clips = conditioning.contiguous_clips(windows, covered, self.size, self.step, self.context, rows)
        x = conditioning.condition_windows(record, clips, self.size, self.step, self.rate, list(self.knots) if self.knots else None, self.cutoff, self.order)
        out = x.select("window", _scored(ClassifierScorer(self.model, self.scale, self.features))("x").alias("probability"))
        return out.withColumn("decision", models.decide(F.col("probability"), self.threshold))


def default_features(samples: np.ndarray) -> list[float]:
    """Raw-window set: entropy of the periodogram and log10 of its mean, spread and maximum."""
    p = spectral.tapered_periodogram(np.asarray(samples, float).reshape(len(samples), -1)[:, 0])
    share = p / p.sum()
    return [float(-(share[share > 0] * np.log(share[share > 0])).sum() / math.log(len(p))), math.log10(p.mean()), math.log10(p.std(ddof=1)), math.log10(p.max())]


def score_array(model: models.Classifier, x: np.ndarray) -> np.ndarray:
    n, w = model.features, np.array(model.params, float)
    if model.kind == "circuit":
        return models.Circuit(n, model.size).probability(x, models.circuit_params(model))
    if model.kind == "harmonic":
        z = np.cos(x) @ w[:n] + np.sin(x) @ w[n : 2 * n] + w[2 * n]
    elif model.size:
        m = model.size
        z = np.tanh(x / model.span @ w[: m * n].reshape(n, m) + w[m * n : m * (n + 1)]) @ w[m * (n + 1) : m * (n + 2)] + w[-1]
    else:
        z = x / model.span @ w[:n] + w[n]
    return 1 / (1 + np.exp(-z))


def score_windows(samples: DataFrame, scorer: WindowScorer) -> DataFrame:
    """samples(window, row, value) -> window, probability; windows are independent of one another."""
    if getattr(scorer, "stateful", False):
        raise ValueError("a stateful scorer takes windows in order; use score_in_order")

    return spectral.window_arrays(samples).select("window", _scored(scorer)("x").alias("probability"))


def _scored(scorer: WindowScorer):
    """Pandas UDF of a scorer over arrays of samples; a scorer with window_scores takes a batch at once."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            arrays = [np.asarray(x, float) for x in batch]
            yield pd.Series(scorer.window_scores(arrays) if hasattr(scorer, "window_scores") else [scorer.window_score(x) for x in arrays], dtype=float)

    return score


def score_in_order(samples: DataFrame, scorer: WindowScorer, series: str = "series") -> DataFrame:
    """samples(series, window, row, value): one series after another in order of windows; reset() starts a series, gap() marks a jump."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        if hasattr(scorer, "reset"):
            scorer.reset()
        out, last = [], None
        for w, part in rows.sort_values(["window", "row"]).groupby("window"):
            if last is not None and w != last + 1 and hasattr(scorer, "gap"):
                scorer.gap(last + 1, w - 1)
            out.append((rows[series].iloc[0], w, scorer.window_score(part["value"].to_numpy(float))))
            last = w
        return pd.DataFrame(out, columns=[series, "window", "probability"])

    return samples.groupBy(series).applyInPandas(run, f"{series} long, window long, probability double")


def trailing_welch(record: DataFrame, segment: int, rate: float, trailing_rows: int, refresh_rows: int, edge_rows: int = 0) -> DataFrame:
    """record(run, row, value) -> psd_row, bin, f, psd: at every refresh the median Welch estimate of the delivered rows in the
    trailing span behind it, with edge_rows cut from both ends of each run; a refresh without a segment has no rows, and
    epoch_in_force() then keeps the one before. A row takes part in trailing_rows / refresh_rows estimates."""
    ends = record.groupBy("run").agg(F.min("row").alias("r0"), F.max("row").alias("r1"))
    inner = record.join(ends, "run").where((F.col("row") >= F.col("r0") + edge_rows) & (F.col("row") <= F.col("r1") - edge_rows)).select("run", "row", "value")
    first = F.floor(F.col("row") / refresh_rows) + 1
    last = F.floor((F.col("row") + trailing_rows) / refresh_rows)
    dealt = inner.where(first <= last).withColumn("k", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    top = record.agg(F.floor(F.max("row") / refresh_rows).alias("top"))
    dealt = dealt.join(F.broadcast(top)).where("k <= top").drop("top")
    half = segment // 2
    place = dealt.join(dealt.groupBy("k", "run").agg(F.min("row").alias("r0"), F.count("*").alias("n")), ["k", "run"]).withColumn("j", F.col("row") - F.col("r0"))
    low, high = F.greatest(F.lit(0), F.ceil((F.col("j") - segment + 1) / half)), F.least(F.floor((F.col("n") - segment) / half), F.floor(F.col("j") / half))
    cut = place.where(low <= high).withColumn("s", F.explode(F.sequence(low.cast("long"), high.cast("long"))))
    arrays = cut.groupBy("k", "run", "s").agg(F.array_sort(F.collect_list(F.struct("row", "value"))).alias("r")).select("k", F.transform("r", lambda x: x["value"]).alias("x"))
    each = arrays.select("k", F.posexplode(spectral.periodogram("x")).alias("bin", "p"))
    out = each.groupBy("k", "bin").agg(F.percentile("p", F.lit(0.5)).alias("m"))
    return out.select((F.col("k") * refresh_rows).alias("psd_row"), "bin", (F.col("bin") * (rate / segment)).alias("f"), (F.col("m") * (2 / rate / math.log(2))).alias("psd"))


def epoch_in_force(windows: DataFrame, estimates: DataFrame, refresh_rows: int) -> DataFrame:
    """windows(window, row_start) with psd_row: the latest refresh at or before the stretch that has an estimate, or null."""
    at = (F.floor(F.col("row_start") / refresh_rows) * refresh_rows).cast("long")
    asked = windows.select(at.alias("at")).distinct()  # a row per refresh, as the estimates'
    both = asked.select("at", F.lit(None).cast("long").alias("psd_row")).unionByName(estimates.select(F.col("psd_row").cast("long").alias("at"), F.col("psd_row").cast("long").alias("psd_row")).distinct())
    last = F.max("psd_row").over(Window.orderBy("at").rangeBetween(Window.unboundedPreceding, 0))
    known = both.withColumn("epoch", last).where("psd_row IS NULL").select("at", F.col("epoch").alias("psd_row")).distinct()
    return windows.withColumn("at", at).join(known, "at").drop("at")


def export_payload(record: DataFrame, per_batch: int, rows: int, events: DataFrame) -> DataFrame:
    """record(row, A[, E]) as payload columns with their batch: one column is named Amplitude. Refuses a part batch at the end
    and events outside the record."""
    if rows % per_batch:
        raise ValueError(f"{rows} rows are no whole number of batches of {per_batch}")
    outside = events.where((F.col("label_start_index") < 1) | (F.col("label_end_index") > rows)).limit(1).count()
    if outside:
        raise ValueError("an event lies outside the record")
    names = [c for c in ("A", "E") if c in record.columns]
    columns = [F.col("A").alias("Amplitude")] if names == ["A"] else [F.col(c) for c in names]
    return record.select(delivery.batch_of_row(F.col("row"), per_batch).alias("batch"), "row", *columns)


def scale_to_snr(signal: DataFrame, found: float, wanted: float) -> DataFrame:
    if not found > 0:
        raise ValueError("a signal without strength can't be scaled")
    return signal.withColumn("value", F.col("value") * (wanted / found))


def place_signal(record: DataFrame, signal: DataFrame, peak_row: int | Column) -> DataFrame:
    """record(row, value) plus signal(k, value), its largest sample at peak_row; what falls outside the record is cut."""
    top = signal.agg(F.max_by("k", F.struct(F.abs("value"), -F.col("k"))).alias("k0"))
    at = peak_row if isinstance(peak_row, Column) else F.lit(peak_row)
    moved = signal.join(F.broadcast(top)).select((F.col("k") - F.col("k0") + at).alias("row"), F.col("value").alias("_s"))
    return record.join(moved, "row", "left").withColumn("value", F.col("value") + F.coalesce("_s", F.lit(0.0))).drop("_s")
