"""Feature scaling: exact quantile bounds, encoding to phases, and matching of a new record's noise."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.operators import order


@dataclass(frozen=True)
class FeatureScaler:
    lower: tuple[float, ...]
    upper: tuple[float, ...]
    span: float = math.pi

    def __post_init__(self):
        if len(self.lower) != len(self.upper):
            raise ValueError("bounds of different length")
        if any(not a < b for a, b in zip(self.lower, self.upper, strict=True)):
            raise ValueError("upper bounds must be above lower ones")
        if not 0 < self.span <= 2 * math.pi:
            raise ValueError("span must lie in (0, 2 pi]")


def quantiles(df: DataFrame, columns: list[str], at: tuple[float, ...]) -> list[list[float]]:
    """Exact interpolated quantiles, one row of numbers for each column; nulls where a column has no value."""
    long = df.select(F.inline(F.array(*(F.struct(F.lit(k).alias("column"), F.col(c).cast("double").alias("v")) for k, c in enumerate(columns)))))
    got = {(r["column"], r["i"]): r["q"] for r in order.quantiles(long, ["column"], "v", list(at)).collect()}  # columns x at
    return [[got.get((k, i)) for i in range(len(at))] for k in range(len(columns))]


def fit_scaler(df: DataFrame, columns: list[str], low: float = 0.005, high: float = 0.995, span: float = math.pi) -> FeatureScaler:
    got = quantiles(df, columns, (low, high))
    if any(a is None or not a < b for a, b in got):
        raise ValueError("a feature is constant or has no value")
    return FeatureScaler(tuple(a for a, _ in got), tuple(b for _, b in got), span)


def encoded(column: Column, lower: float, upper: float, span: float) -> Column:
    return (F.least(F.greatest(column, F.lit(lower)), F.lit(upper)) - F.lit(lower)) / F.lit(upper - lower) * F.lit(span)


def encode_features(df: DataFrame, columns: list[str], scaler: FeatureScaler) -> DataFrame:
    if len(columns) != len(scaler.lower):
        raise ValueError(f"{len(columns)} features for a scaler of {len(scaler.lower)}")
    return df.withColumns({c: encoded(F.col(c), a, b, scaler.span) for c, a, b in zip(columns, scaler.lower, scaler.upper, strict=True)})


def match_scaler(reference: FeatureScaler, reference_noise: DataFrame, new_noise: DataFrame, columns: list[str], at: tuple[float, float] = (0.5, 0.99)) -> FeatureScaler:
    """Bounds under which the new noise's two quantiles get the unclamped angles that the reference's have."""
    lower, upper = [], []
    for (a, b), (c, d), low, high in zip(quantiles(reference_noise, columns, at), quantiles(new_noise, columns, at), reference.lower, reference.upper, strict=True):
        if a is None or c is None:
            raise ValueError("a feature has no value")
        p, q = (a - low) / (high - low), (b - low) / (high - low)
        if not q > p or not d > c:
            raise ValueError("a feature's noise quantiles coincide")
        width = (d - c) / (q - p)
        lower.append(c - p * width)
        upper.append(c - p * width + width)
    return FeatureScaler(tuple(lower), tuple(upper), reference.span)


def require_scaler(scaler: FeatureScaler | None) -> FeatureScaler:
    if scaler is None:
        raise ValueError("the model has no scaler")
    return scaler
