"""Channel combinations, spectral-density models and gains as Column functions of frequency."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the instrument model.
ARM = 2.5e9
LIGHT = 299_792_458.0
TRANSFER = LIGHT / (2 * math.pi * ARM)
OMS = 1.5e-11
ACCELERATION = 3e-15


def channels(x: Column, y: Column, z: Column) -> dict[str, Column]:
    """Orthogonal combinations A, E, T."""
    return {"a": (z - x) / F.lit(math.sqrt(2)), "e": (x - F.lit(2.0) * y + z) / F.lit(math.sqrt(6)), "t": (x + y + z) / F.lit(math.sqrt(3))}


def sensitivity_psd(f: Column) -> Column:
    """Instrument sensitivity: position and acceleration noise over the averaged response."""
    oms = F.lit(OMS**2) * (F.lit(1.0) + F.pow(F.lit(2e-3) / f, F.lit(4)))
    acc = F.lit(ACCELERATION**2) * (F.lit(1.0) + F.pow(F.lit(0.4e-3) / f, F.lit(2))) * (F.lit(1.0) + F.pow(f / F.lit(8e-3), F.lit(4)))
    motion = F.lit(2.0) * (F.lit(1.0) + F.pow(F.cos(f / F.lit(TRANSFER)), F.lit(2))) * acc / F.pow(F.lit(2 * math.pi) * f, F.lit(4))
    return F.lit(10 / (3 * ARM**2)) * (oms + motion) * (F.lit(1.0) + F.lit(0.6) * F.pow(f / F.lit(TRANSFER), F.lit(2)))


def confusion_psd(f: Column, amplitude: float, alpha: float, beta: float, kappa: float, gamma: float, knee: float) -> Column:
    """Unresolved foreground; its parameters belong to an observation time and are the caller's."""
    shape = F.exp(-F.pow(f, F.lit(alpha)) + F.lit(beta) * f * F.sin(F.lit(kappa) * f))
    return F.lit(amplitude) * F.pow(f, F.lit(-7 / 3)) * shape * (F.lit(1.0) + F.tanh(F.lit(gamma) * (F.lit(knee) - f)))


def channel_psd(f: Column) -> Column:
    return F.lit(0.3) / (F.lit(1.0) + F.lit(0.6) * F.pow(f / F.lit(TRANSFER), F.lit(2))) * sensitivity_psd(f)


def delay_psd(f: Column, position: Column, test_mass: Column, second: bool = False) -> Column:
    """Analytic density of a delay-combined channel; `second` for the doubled combination."""
    x = F.lit(2 * math.pi * ARM / LIGHT) * f
    base = F.lit(8.0) * F.pow(F.sin(x), F.lit(2)) * (F.lit(2.0) * test_mass * (F.lit(3.0) + F.lit(2.0) * F.cos(x) + F.cos(F.lit(2.0) * x)) + position * (F.lit(2.0) + F.cos(x)))
    return base * F.lit(4.0) * F.pow(F.sin(F.lit(2.0) * x), F.lit(2)) if second else base


def highpass_gain(f: Column, cutoff: float, order: int) -> Column:
    """Magnitude of a Butterworth high-pass; a cutoff of 0 leaves all."""
    if cutoff <= 0:
        return F.lit(1.0)
    return F.when(f > 0, F.lit(1.0) / F.sqrt(F.lit(1.0) + F.pow(F.lit(cutoff) / f, F.lit(2 * order)))).otherwise(F.lit(0.0))


def whitening_gain(psd: Column, rate: float) -> Column:
    return F.sqrt(F.lit(2.0 / rate) / psd)


def matched_filter_snr(bins: DataFrame, df: float) -> DataFrame:
    """bins(re, im, psd) -> snr."""
    return bins.agg(F.sqrt(F.lit(4.0 * df) * F.sum((F.col("re") ** 2 + F.col("im") ** 2) / F.col("psd"))).alias("snr"))
