"""Spectral kernels in NumPy and their grouped or vectorised forms: the only Python on the data path.

A stretch's Fourier transform can't be split, so a gap-free stretch is the unit of whole-record
conditioning; windows and segments are independent of one another.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.operators.order import quantiles


def hann(n: int) -> np.ndarray:
    """Periodic Hann taper."""
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def tapered_periodogram(x: np.ndarray) -> np.ndarray:
    """|FFT(x v)|^2 / (n mean(v^2)) of the last axis."""
    n = x.shape[-1]
    v = hann(n)
    return np.abs(np.fft.rfft(x * v)) ** 2 / (n * np.mean(v**2))


def highpass_gains(f: np.ndarray, cutoff: float, order: int) -> np.ndarray:
    if cutoff <= 0:
        return np.ones_like(f)
    with np.errstate(divide="ignore"):
        return np.where(f > 0, 1 / np.sqrt(1 + (cutoff / np.where(f > 0, f, 1)) ** (2 * order)), 0.0)


def condition(x: np.ndarray, rate: float, psd: np.ndarray | None = None, psd_f: np.ndarray | None = None, cutoff: float = 0.0, order: int = 8) -> np.ndarray:
    """High-pass, then whitening by a sampled one-sided density; circular over the given samples."""
    f = np.fft.rfftfreq(len(x), 1 / rate)
    gain = highpass_gains(f, cutoff, order)
    if psd is not None:
        s = np.interp(f, psd_f, psd)
        gain = gain * np.sqrt(2 / (rate * s))
        gain[0] = 0.0
    return np.fft.irfft(np.fft.rfft(x) * gain, len(x))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def periodogram(xs: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Tapered periodograms of equally long arrays of samples."""
    for s in xs:
        lengths, out = s.map(len).to_numpy(), np.empty(len(s), object)
        for n in np.unique(lengths):  # one transform for all arrays of a length
            own = np.flatnonzero(lengths == n)
            for i, p in zip(own, tapered_periodogram(np.stack(s.iloc[own].to_numpy()).astype(float)), strict=True):
                out[i] = p
        yield pd.Series(out, dtype=object)


def window_arrays(samples: DataFrame) -> DataFrame:
    """samples(window, row, value) -> window, x: a window's samples in order."""
    return samples.groupBy("window").agg(F.array_sort(F.collect_list(F.struct("row", "value"))).alias("r")).select("window", F.transform("r", lambda x: x["value"]).alias("x"))


def bins(power: Column, rate: float, n: int) -> Column:
    """Array of (bin, f, p) structs of a periodogram."""
    return F.transform(power, lambda p, k: F.struct(k.cast("int").alias("bin"), (k * F.lit(rate / n)).alias("f"), p.alias("p")))


def band_features(periodograms: DataFrame, edges: list[float], rate: float, n: int) -> DataFrame:
    """periodograms(window, power) -> mean power in each band (the first closed on both sides, others open below), entropy
    of the bins in all bands over its greatest value, and the log10 spread of their power (n - 1)."""
    parts = F.filter(bins(F.col("power"), rate, n), lambda b: (b["f"] >= edges[0]) & (b["f"] <= edges[-1]))
    rows = periodograms.select("window", parts.alias("b"))

    def mean(a: float, b: float, first: bool) -> Column:
        own = F.filter("b", lambda x: (x["f"] >= a if first else x["f"] > a) & (x["f"] <= b))
        return F.try_divide(F.aggregate(own, F.lit(0.0), lambda s, x: s + x["p"]), F.size(own))

    total = F.aggregate("b", F.lit(0.0), lambda s, x: s + x["p"])
    share = lambda x: x["p"] / F.col("total")
    entropy = F.aggregate("b", F.lit(0.0), lambda s, x: s - F.when(x["p"] > 0, share(x) * F.log(share(x))).otherwise(0.0)) / F.log(F.size("b"))
    m = F.col("total") / F.size("b")
    spread = F.sqrt(F.aggregate("b", F.lit(0.0), lambda s, x: s + (x["p"] - m) * (x["p"] - m)) / (F.size("b") - 1))
    return rows.withColumn("total", total).select("window", *(mean(a, b, k == 0).alias(f"band_{k + 1}") for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))), entropy.alias("spectral_entropy"), F.log10(spread).alias("log_power_std"))


def whitened_features(periodograms: DataFrame, low: tuple[float, float], high: tuple[float, float], rate: float, n: int) -> DataFrame:
    """The four-feature set: p_low, p_high, spectral_entropy, log_power_std."""
    out = band_features(periodograms, [low[0], low[1], high[1]], rate, n)
    return out.select("window", F.col("band_1").alias("p_low"), F.col("band_2").alias("p_high"), "spectral_entropy", "log_power_std")


def paper_features(periodograms: DataFrame) -> DataFrame:
    """Entropy and log10 mean, spread and maximum of a raw window's periodogram."""
    p = F.col("power")
    total, n = F.aggregate(p, F.lit(0.0), lambda s, x: s + x), F.size(p)
    rows = periodograms.select("window", "power", total.alias("total"))
    share = lambda x: x / F.col("total")
    entropy = F.aggregate("power", F.lit(0.0), lambda s, x: s - F.when(x > 0, share(x) * F.log(share(x))).otherwise(0.0)) / F.log(n)
    m = F.col("total") / n
    spread = F.sqrt(F.aggregate("power", F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / (n - 1))
    return rows.select("window", entropy.alias("spectral_entropy"), F.log10(m).alias("log_mean"), F.log10(spread).alias("log_std"), F.log10(F.array_max("power")).alias("log_max"))


def combine_max(per_channel: DataFrame, largest: list[str], smallest: list[str]) -> DataFrame:
    """Per feature over channels: larger power and spread, smaller entropy."""
    return per_channel.groupBy("window").agg(*(F.max(c).alias(c) for c in largest), *(F.min(c).alias(c) for c in smallest))


def combine_mean(per_channel: DataFrame) -> DataFrame:
    """Periodogram averaged over channels, by bin."""
    each = per_channel.select("window", F.posexplode("power").alias("bin", "p"))
    return each.groupBy("window", "bin").agg(F.avg("p").alias("p"))


def welch_psd(samples: DataFrame, segment: int, rate: float) -> DataFrame:
    """samples(run, row, value), gap-free within a run -> bin, f, psd: median over half-overlapping Hann segments of all
    runs, none across a gap, over ln 2 for the median's bias."""
    half = segment // 2
    place = samples.join(samples.groupBy("run").agg(F.min("row").alias("r0"), F.count("*").alias("n")), "run").withColumn("k", F.col("row") - F.col("r0"))
    last = F.floor((F.col("n") - segment) / half)
    low, high = F.greatest(F.lit(0), F.ceil((F.col("k") - segment + 1) / half)), F.least(last, F.floor(F.col("k") / half))
    cut = place.where(low <= high).withColumn("s", F.explode(F.sequence(low.cast("long"), high.cast("long"))))
    arrays = cut.groupBy("run", "s").agg(F.array_sort(F.collect_list(F.struct("row", "value"))).alias("r")).select(F.transform("r", lambda x: x["value"]).alias("x"))
    each = arrays.select(F.posexplode(periodogram("x")).alias("bin", "p"))
    scale = 2 / rate / math.log(2)
    return quantiles(each, ["bin"], "p", [0.5]).select("bin", (F.col("bin") * (rate / segment)).alias("f"), (F.col("q") * scale).alias("psd"))


def smooth_psd(psd: DataFrame, sigma_dex: float, per_decade: int = 20) -> DataFrame:
    """Gaussian weights over log10 f on log10 psd; a band of five sigma, joined by bins of log f."""
    points = psd.where("f > 0 AND psd > 0").select(F.log10("f").alias("x"), F.log10("psd").alias("y"), "bin", "f")
    width = 5 * sigma_dex
    cell = points.withColumn("c", F.floor(F.col("x") / width).cast("long"))
    near = cell.select("x", "y", F.explode(F.array(F.col("c") - 1, F.col("c"), F.col("c") + 1)).alias("c")).withColumnsRenamed({"x": "x2", "y": "y2"})
    met = cell.join(near, "c").where(F.abs(F.col("x") - F.col("x2")) <= width)
    w = F.exp(-F.lit(0.5) * F.pow((F.col("x") - F.col("x2")) / F.lit(sigma_dex), F.lit(2)))
    return met.groupBy("bin", "f").agg(F.pow(F.lit(10.0), F.sum(w * F.col("y2")) / F.sum(w)).alias("psd"))


def interpolated_psd(psd: DataFrame, at: DataFrame) -> DataFrame:
    """at(f) with s interpolated linearly between samples of psd(f, psd); the samples' table is small and goes to one array."""
    knots = psd.agg(F.array_sort(F.collect_list(F.struct("f", "psd"))).alias("k"))
    below, above = F.filter("k", lambda x: x["f"] <= F.col("f")), F.filter("k", lambda x: x["f"] > F.col("f"))
    lo, hi = F.try_element_at(below, F.lit(-1)), F.try_element_at(above, F.lit(1))
    s = lo["psd"] + (hi["psd"] - lo["psd"]) * (F.col("f") - lo["f"]) / (hi["f"] - lo["f"])
    return at.join(F.broadcast(knots)).select("f", F.coalesce(s, lo["psd"], hi["psd"]).alias("s"))


def whiten_record(record: DataFrame, rate: float, psd: list[tuple[float, float]] | None, cutoff: float = 0.0, order: int = 8) -> DataFrame:
    """record(stretch, row, value) conditioned stretch by stretch; psd as (f, s) knots."""
    f, s = (np.array(x) for x in zip(*psd, strict=True)) if psd else (None, None)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row")
        return rows.assign(value=condition(rows["value"].to_numpy(float), rate, s, f, cutoff, order))[["stretch", "row", "value"]]

    return record.select("stretch", "row", "value").groupBy("stretch").applyInPandas(run, "stretch long, row long, value double")


def synthesize_noise(psd: np.ndarray, n: int, rate: float, f_min: float, seed: int) -> np.ndarray:
    """Gaussian noise of a one-sided density on the rFFT grid: E|X|^2 = S fs n / 2, bins below f_min empty."""
    rng, f = np.random.default_rng(seed), np.fft.rfftfreq(n, 1 / rate)
    x = (rng.standard_normal(len(f)) + 1j * rng.standard_normal(len(f))) * np.sqrt(psd * rate * n / 4)
    x[(f < f_min) | (f == 0)] = 0
    return np.fft.irfft(x, n)
