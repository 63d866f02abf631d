"""From the samples of a delivered record to scored windows: what was there when a window became complete conditions it, the
density in force whitens it, its features are encoded and classified. Everything but the Fourier transforms is Columns.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.functions import spectral
from tidegauge.operators import conditioning, delivery, holes, models, scaler
from tidegauge.tables import written

#: What the sidecar of a feature table must record for a detector to condition windows alike.
CONDITIONING_KEYS = ("sample_rate", "window_size", "step_size", "highpass_cutoff_hz", "highpass_order")
BAND_KEYS = ("low_band_hz", "high_band_hz", "band_edges_hz")


@dataclass(frozen=True)
class FeatureMap:
    """Which features a window has: whitened (four of two bands), bands (one for each band, entropy, spread) or paper (four of
    the raw window), and how those of several channels become one set: max by feature, or mean of the periodograms."""

    feature_set: str = "whitened"
    low_band: tuple[float, float] = (1e-3, 5e-3)
    high_band: tuple[float, float] = (5e-3, 1e-1)
    edges: tuple[float, ...] = (1e-3, 5e-3, 1e-1)
    combination: str = "max"

    def __post_init__(self) -> None:
        if self.feature_set not in ("whitened", "bands", "paper") or self.combination not in ("max", "mean"):
            raise ValueError(f"unknown features {self.feature_set} or combination {self.combination}")

    @classmethod
    def of(cls, sidecar: dict) -> FeatureMap:
        if missing := [k for k in BAND_KEYS if k not in sidecar]:
            raise ValueError(f"the sidecar doesn't record {', '.join(missing)}")
        pair = lambda k: tuple(map(float, sidecar[k]))
        return cls(sidecar.get("feature_set", "whitened"), pair("low_band_hz"), pair("high_band_hz"), pair("band_edges_hz"), sidecar.get("channel_combination", "max"))

    def of_arrays(self, arrays: DataFrame, rate: float, size: int) -> DataFrame:
        """arrays(window[, channel], x) -> window and the features."""
        several = "channel" in arrays.columns
        power = arrays.select(*(c for c in arrays.columns if c != "x"), spectral.periodogram("x").alias("power"))
        if several and self.combination == "mean":
            bins = spectral.combine_mean(power).groupBy("window").agg(F.array_sort(F.collect_list(F.struct("bin", "p"))).alias("b"))
            power, several = bins.select("window", F.transform("b", lambda x: x["p"]).alias("power")), False
        if several:  # features know windows alone, so channels stand beside each other until they are combined
            power = power.withColumn("window", F.struct("window", "channel"))
        if self.feature_set == "paper":
            found = spectral.paper_features(power)
        elif self.feature_set == "bands":
            found = spectral.band_features(power, list(self.edges), rate, size)
        else:
            found = spectral.whitened_features(power, self.low_band, self.high_band, rate, size)
        if not several:
            return found
        names = [c for c in found.columns if c != "window"]
        return spectral.combine_max(found.withColumn("window", F.col("window.window")), [c for c in names if c != "spectral_entropy"], ["spectral_entropy"])


@dataclass(frozen=True)
class RunDetector:
    """What a training run left behind to score windows of another record with."""

    model: models.Classifier
    scale: scaler.FeatureScaler
    columns: tuple[str, ...]
    threshold: float
    size: int
    step: int
    rate: float
    cutoff: float
    order: int
    features: FeatureMap
    knots: tuple[tuple[float, float], ...] | None
    context: int = 4
    channels: str = "A"

    def score(self, record: DataFrame, clips: DataFrame) -> DataFrame:
        """record(row[, channel], value), clips(window, first, last[, f, s]) -> window, probability, decision."""
        raw = self.features.feature_set == "paper"
        x = conditioning.condition_windows(record, clips, self.size, self.step, self.rate, None if raw or not self.knots else list(self.knots), 0.0 if raw else self.cutoff, self.order)
        found = self.features.of_arrays(x, self.rate, self.size)
        coded = scaler.encode_features(found, list(self.columns), self.scale)
        scored = models.predict_all(coded, list(self.columns), self.model).select("window", "probability")
        return scored.withColumn("decision", models.decide(F.col("probability"), self.threshold))


def sampled_density(spark: SparkSession, sidecar: dict, rate: float, rows: int) -> tuple[tuple[float, float], ...] | None:
    """A sidecar's density as knots: its own, or the values of an analytic one at the frequencies of a whole stretch of `rows`."""
    found = conditioning.density_from_sidecar(sidecar)
    if found is None or isinstance(found, list):
        return tuple(found) if found else None
    grid = spark.range(1, rows // 2 + 1).select((F.col("id") * F.lit(rate / rows)).alias("f"))
    return tuple(tuple(r) for r in grid.select("f", found.alias("s")).orderBy("f").collect())  # as many as half a stretch has rows


def detector_of(spark: SparkSession, model: models.Classifier, scale: scaler.FeatureScaler | None, columns: list[str], threshold: float, sidecar: dict, psd_sidecar: dict | None = None, context: int = 4) -> RunDetector:
    """A run's model, scaler and threshold with the conditioning and features that the sidecar of its feature table records;
    psd_sidecar gives another record's density in place of the run's own."""
    if missing := [k for k in CONDITIONING_KEYS if k not in sidecar]:
        raise ValueError(f"the sidecar doesn't record {', '.join(missing)}")
    trained = sidecar.get("channels", "A")
    if psd_sidecar is not None and psd_sidecar.get("channels", "A") != trained:
        raise ValueError(f"the whitening sidecar describes channels {psd_sidecar.get('channels', 'A')}; the model was trained on {trained}")
    size, step, rate = int(sidecar["window_size"]), int(sidecar["step_size"]), float(sidecar["sample_rate"])
    if size < 2 or not 1 <= step <= size or rate <= 0:
        raise ValueError(f"window size {size}, step {step}, sample rate {rate}")
    knots = sampled_density(spark, psd_sidecar or sidecar, rate, size * (2 * context + 1))
    return RunDetector(model, scaler.require_scaler(scale), tuple(columns), float(threshold), size, step, rate, float(sidecar["highpass_cutoff_hz"]), int(sidecar["highpass_order"]), FeatureMap.of(sidecar), knots, context, trained)


def causal_densities(record: DataFrame, clips: DataFrame, settled: DataFrame, arrivals: DataFrame, gone: DataFrame, per_batch: int, segment: int, rate: float, trailing_rows: int, refresh_rows: int, edge_rows: int) -> DataFrame:
    """clips(window, first, last) with psd_row, f, s: the median Welch estimate of the rows in the trailing span behind the
    last refresh before a window's stretch, as they were known when the first window of that refresh was complete. Windows
    before any estimate have psd_row 0 and nulls. gone(batch, lo, hi, gone_at) are holes.batch_parts()."""
    k = F.floor((F.col("first") - 1) / refresh_rows)
    dealt = clips.withColumn("k", k)
    asked = dealt.join(settled.select("window", "complete_at"), "window").groupBy("k").agg(F.min("complete_at").alias("known_at"))
    came = arrivals.groupBy("batch").agg(F.min("arrived_at").alias("arrived_at"))
    lost = gone.where("gone_at IS NOT NULL").select(F.col("batch").alias("_b"), "lo", "hi", "gone_at")
    rows = record.withColumn("batch", delivery.batch_of_row(F.col("row"), per_batch)).join(came, "batch")
    rows = rows.join(lost, (F.col("batch") == F.col("_b")) & F.col("row").between(F.col("lo"), F.col("hi")), "left").select("row", "value", "arrived_at", "gone_at")
    first, last = F.floor((F.col("row") - 1) / refresh_rows) + 1, F.floor((F.col("row") - 1 + trailing_rows) / refresh_rows)
    copies = rows.where(first <= last).withColumn("k", F.explode(F.sequence(first.cast("long"), last.cast("long")))).join(asked, "k")
    known = copies.where((F.col("arrived_at") <= F.col("known_at")) & (F.col("gone_at").isNull() | (F.col("gone_at") > F.col("known_at"))))
    order = Window.partitionBy("k").orderBy("row")  # the rows of a trailing span, which the settings bound
    runs = known.withColumn("run", F.col("row") - F.row_number().over(order))
    ends = runs.groupBy("k", "run").agg((F.min("row") + edge_rows).alias("a"), (F.max("row") - edge_rows).alias("b"))
    inner = runs.join(ends, ["k", "run"]).where(F.col("row").between(F.col("a"), F.col("b"))).withColumn("j", F.col("row") - F.col("a"))
    half = max(1, segment // 2)
    n = F.col("b") - F.col("a") + 1
    low, high = F.greatest(F.lit(0), F.ceil((F.col("j") - segment + 1) / half)), F.least(F.floor((n - segment) / half), F.floor(F.col("j") / half))
    cut = inner.where(low <= high).withColumn("seg", F.explode(F.sequence(low.cast("long"), high.cast("long"))))
    arrays = cut.groupBy("k", "run", "seg").agg(F.array_sort(F.collect_list(F.struct("row", "value"))).alias("r")).select("k", F.transform("r", lambda x: x["value"]).alias("x"))
    bins = arrays.select("k", F.posexplode(spectral.periodogram("x")).alias("bin", "p")).groupBy("k", "bin").agg(F.percentile("p", F.lit(0.5)).alias("m"))
    knots = bins.groupBy("k").agg(F.array_sort(F.collect_list(F.struct((F.col("bin") * (rate / segment)).alias("f"), (F.col("m") * (2 / rate / math.log(2))).alias("s")))).alias("d"))
    # A refresh without an estimate keeps the one before; one row for each refresh.
    held = asked.select("k").join(knots, "k", "left").withColumn("e", F.max(F.when(F.col("d").isNotNull(), F.col("k"))).over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)))
    knots = knots.select(F.col("k").alias("e"), F.transform("d", lambda x: x["f"]).alias("f"), F.transform("d", lambda x: x["s"]).alias("s"))
    out = dealt.join(held.select("k", "e"), "k").join(knots, "e", "left")
    return out.select("window", "first", "last", F.coalesce(F.col("e") * refresh_rows, F.lit(0)).cast("long").alias("psd_row"), "f", "s")


def replay(record: DataFrame, arrivals: DataFrame, gone: DataFrame, windows: DataFrame, det: RunDetector, rows: int, per_batch: int, min_coverage: float, trailing: tuple[int, int, int, int] | None = None) -> DataFrame:
    """record(row[, channel], value), arrivals(batch, arrived_at), gone(row_start, row_end, declared_at[, cause]), widened ->
    every window with what holes.settle() says and, where it is complete, probability, decision, psd_row, stretch_first and
    stretch_last. trailing: segment, trailing, refresh and edge rows of a causal density; that of channel A serves both channels,
    which have the same noise by their construction. Settled windows, stretches and scores are written tables, as several steps read them."""
    geometry = (det.size, det.step, det.context, rows, per_batch)
    parts = holes.deliveries(windows, arrivals, gone, *geometry)
    settled = written(holes.settle(windows, arrivals, gone, *geometry, min_coverage))
    clips = written(holes.clips(settled, parts, det.size, det.step))
    if trailing:
        one = record.where(F.col("channel") == "A").drop("channel") if "channel" in record.columns else record
        segment, span, refresh, edge = trailing
        clips = written(causal_densities(one, clips, settled, arrivals, holes.batch_parts(gone, arrivals, per_batch), per_batch, segment, det.rate, span, refresh, edge))
    else:
        clips = clips.withColumn("psd_row", F.lit(0).cast("long"))
    scored = written(det.score(record, clips)).join(clips.select("window", "psd_row", F.col("first").alias("stretch_first"), F.col("last").alias("stretch_last")), "window")
    return settled.join(scored, "window", "left")
