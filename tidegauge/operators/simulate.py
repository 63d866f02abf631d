"""Simulated records: seeded coloured noise by blocks, merger waveforms and the constellation's response as Columns."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions.psd import LIGHT, TRANSFER
from tidegauge.functions.spectral import synthesize_noise

#: Solar mass in seconds, astronomical unit and year.
SUN, UNIT, YEAR = 4.925490947e-6, 1.495978707e11, 31_557_600.0
#: Ajith et al., Phys. Rev. D 77, 104017 (2008), Table I; a eta^2 + b eta + c.
TRANSITIONS = {"merge": (2.9740e-1, 4.4810e-2, 9.5560e-2), "ring": (5.9411e-1, 8.9794e-2, 1.9111e-1), "width": (5.0801e-1, 7.7515e-2, 2.2369e-2), "cut": (8.4845e-1, 1.2848e-1, 2.7299e-1)}
PHASE = {
    0: (1.7516e-1, 7.9483e-2, -7.2390e-2), 2: (-5.1571e1, -1.7595e1, 1.3253e1), 3: (6.5866e2, 1.7803e2, -1.5972e2),
    4: (-3.9031e3, -7.7493e2, 8.8195e2), 6: (-2.4874e4, -1.4892e3, 4.4588e3), 7: (2.5196e4, 3.3970e2, -3.9573e3),
}


def _quadratic(c: tuple[float, float, float], eta: Column) -> Column:
    return F.lit(c[0]) * eta * eta + F.lit(c[1]) * eta + F.lit(c[2])


def mass_ratio_eta(q: Column) -> Column:
    """Symmetric mass ratio of q = m1 / m2."""
    return q / ((F.lit(1.0) + q) * (F.lit(1.0) + q))


def transitions(mass: Column, eta: Column) -> dict[str, Column]:
    """Merger, ringdown, width and cut frequencies (Hz) of a total mass in solar masses."""
    return {k: _quadratic(c, eta) / (F.lit(math.pi * SUN) * mass) for k, c in TRANSITIONS.items()}


def amplitude(f: Column, mass: Column, eta: Column) -> Column:
    """Unit amplitude of inspiral, merger and ringdown at f; nothing from the cut on."""
    t = transitions(mass, eta)
    x = f / t["merge"]
    peak = F.lit(math.pi / 2) * t["width"] * F.pow(t["ring"] / t["merge"], F.lit(-2 / 3))
    line = t["width"] / F.lit(2 * math.pi) / ((f - t["ring"]) * (f - t["ring"]) + t["width"] * t["width"] / 4)
    return F.when(f < t["merge"], F.pow(x, F.lit(-7 / 6))).when(f < t["ring"], F.pow(x, F.lit(-2 / 3))).when(f < t["cut"], peak * line).otherwise(F.lit(0.0))


def physical_amplitude(mass: Column, eta: Column, distance_seconds: Column) -> Column:
    """Factor of the unit amplitude for a face-on source; the distance as light travel time."""
    merge = transitions(mass, eta)["merge"]
    chirp = F.lit(SUN) * mass * F.pow(eta, F.lit(0.6))
    return F.lit(math.sqrt(5 / 24) * math.pi ** (-2 / 3)) * F.pow(chirp, F.lit(5 / 6)) * F.pow(merge, F.lit(-7 / 6)) / distance_seconds


def delay_factors(eta: Column) -> Column:
    """Array of what the terms of group_delay() take from the mass ratio alone; as a column of its own it is made once a source."""
    return F.array(*(_quadratic(c, eta) / eta * F.lit((k - 5) / 3) for k, c in PHASE.items() if k != 5))


def group_delay(f: Column, mass: Column, eta: Column, factors: Column | None = None) -> Column:
    """Derivative of the phase over 2 pi, in seconds; factors: a column of delay_factors()."""
    m = F.lit(math.pi * SUN) * mass
    out = F.lit(0.0)
    for at, k in enumerate(k for k in PHASE if k != 5):
        factor = _quadratic(PHASE[k], eta) / eta * F.lit((k - 5) / 3) if factors is None else F.get(factors, F.lit(at))
        out = out + factor * F.pow(m * f, F.lit((k - 5) / 3)) / f
    return out / F.lit(2 * math.pi)


def arrival_delay(f: Column, mass: Column, eta: Column) -> Column:
    """Seconds before the coalescence at which f is emitted; zero through merger and ringdown."""
    ring = transitions(mass, eta)["ring"]
    return delay_before(f, mass, eta, ring, group_delay(ring, mass, eta))


def delay_before(f: Column, mass: Column, eta: Column, ring: Column, at_ring: Column, factors: Column | None = None) -> Column:
    """arrival_delay() of many f of one source, with columns of its ring frequency, of the group delay there and of its factors."""
    return F.when(f < ring, F.greatest(at_ring - group_delay(f, mass, eta, factors), F.lit(0.0))).otherwise(F.lit(0.0))


def roll_off(f: Column) -> Column:
    """Long-wavelength transfer of the constellation."""
    return F.lit(1.0) / F.sqrt(F.lit(1.0) + F.lit(0.6) * F.pow(f / F.lit(TRANSFER), F.lit(2)))


def doppler_phase(f: Column, t: Column, longitude: Column, latitude: Column, orbit: float = 0.0) -> Column:
    return F.lit(2 * math.pi * UNIT / LIGHT) * f * F.cos(latitude) * F.cos(F.lit(2 * math.pi / YEAR) * t + F.lit(orbit) - longitude)


def antenna(t: Column, longitude: Column, latitude: Column, psi: Column, orbit: float = 0.0, cartwheel: float = 0.0) -> tuple[Column, Column]:
    """Long-wavelength plus and cross patterns of one Michelson channel on circular, equal-arm orbits."""
    a, lam, theta, phi = F.lit(2 * math.pi / YEAR) * t + F.lit(orbit), F.lit(cartwheel), F.lit(math.pi / 2) - latitude, longitude
    plus = F.lit(math.sqrt(3) / 64) * (
        F.lit(-36.0) * F.pow(F.sin(theta), F.lit(2)) * F.sin(2 * a - 2 * lam)
        + (F.lit(3.0) + F.cos(2 * theta)) * (F.cos(2 * phi) * (9 * F.sin(2 * lam) - F.sin(4 * a - 2 * lam)) + F.sin(2 * phi) * (F.cos(4 * a - 2 * lam) - 9 * F.cos(2 * lam)))
        - F.lit(4 * math.sqrt(3)) * F.sin(2 * theta) * (F.sin(3 * a - 2 * lam - phi) - 3 * F.sin(a - 2 * lam + phi))
    )
    cross = F.lit(1 / 16) * (
        F.lit(math.sqrt(3)) * F.cos(theta) * (9 * F.cos(2 * lam - 2 * phi) - F.cos(4 * a - 2 * lam - 2 * phi))
        - 6 * F.sin(theta) * (F.cos(3 * a - 2 * lam - phi) + 3 * F.cos(a - 2 * lam + phi))
    )
    c, s = F.cos(2 * psi), F.sin(2 * psi)
    return (c * plus - s * cross) / 2, (s * plus + c * cross) / 2


def tone(t: Column, amplitude_: Column, f: Column, phase: Column, drift: Column | float = 0.0) -> Column:
    """A binary's sinusoid; drift in Hz a second makes it a chirp."""
    d = drift if isinstance(drift, Column) else F.lit(float(drift))
    return amplitude_ * F.cos(F.lit(2 * math.pi) * (f * t + d * t * t / 2) + phase)


def coloured_noise(spark: SparkSession, rows: int, rate: float, knots: list[tuple[float, float]], f_min: float = 0.0, seed: int = 0, block: int = 65_536) -> DataFrame:
    """row, value: Gaussian noise of a one-sided density given at knots (f, s). Segments of two blocks overlap by half under a
    sine taper, which keeps the power; every segment follows from the seed and its number, so blocks are made anywhere, again and alike."""
    f, s = (np.array(x) for x in zip(*knots, strict=True))
    taper = np.sin(np.pi * (np.arange(2 * block) + 0.5) / (2 * block))
    density = np.interp(np.fft.rfftfreq(2 * block, 1 / rate), f, s)

    def make(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for b in part["id"]:
                before, after = (synthesize_noise(density, 2 * block, rate, f_min, (seed, int(k))) * taper for k in (b, b + 1))
                row = np.arange(b * block + 1, min((b + 1) * block, rows) + 1)
                yield pd.DataFrame({"row": row, "value": (before[block:] + after[:block])[: len(row)]})

    n = -(-rows // block)
    return spark.range(0, n, 1, min(n, 10_000)).mapInPandas(make, "row long, value double")


def generate_record(spark: SparkSession, rows: int, rate: float, knots: list[tuple[float, float]], binaries: list[tuple[float, float, float, float]] = (), spans: DataFrame | None = None, **noise) -> DataFrame:
    """row, t, value, label: noise, a list of (amplitude, f, phase, drift) tones, and labels from spans(start, end)."""
    from tidegauge.operators.labels import row_labels

    out = coloured_noise(spark, rows, rate, knots, **noise).withColumn("t", (F.col("row") - 1) / F.lit(rate))
    for a, f, phase, drift in binaries:
        out = out.withColumn("value", F.col("value") + tone(F.col("t"), F.lit(a), F.lit(f), F.lit(phase), drift))
    out = row_labels(out, spans) if spans is not None else out.withColumn("label", F.lit(0))
    return out.select("row", "t", "value", "label")
