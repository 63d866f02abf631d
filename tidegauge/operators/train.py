"""Training of small classifiers: gradients as aggregates, mini-batches by Adam, early stopping.

A control's batch gradient is a sum of Column expressions. A circuit's comes in chunks of rows from a
vectorised kernel and is added in the order of the chunks, so partitions don't change a bit of it.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.operators.evaluate import weighted_bce, weighted_bce_derivative
from tidegauge.operators.models import Circuit, Classifier, circuit_params, probability


def control_gradient(df: DataFrame, columns: list[str], model: Classifier, weight: float = 1.0) -> DataFrame:
    """One row: loss, rows and the mean gradient g0, g1, ... of a logistic or harmonic control over a batch."""
    x = [F.col(c) for c in columns]
    p = probability(model, x)
    slope = weighted_bce_derivative(p, F.col("label"), weight) * p * (F.lit(1.0) - p)
    if model.kind == "logistic":
        inputs = [*(c / F.lit(model.span) for c in x), F.lit(1.0)]
    elif model.kind == "harmonic":
        inputs = [*(F.cos(c) for c in x), *(F.sin(c) for c in x), F.lit(1.0)]
    else:
        raise ValueError("columns give the gradient of logistic and harmonic controls")
    return df.agg(F.avg(weighted_bce(p, F.col("label"), weight)).alias("loss"), F.count("*").alias("rows"), *(F.avg(slope * c).alias(f"g{i}") for i, c in enumerate(inputs)))


def circuit_gradient(df: DataFrame, columns: list[str], model: Classifier, weight: float = 1.0, chunk: int = 256) -> np.ndarray:
    """Mean gradient of a circuit over df(row_id, features, label), the same for every partitioning."""
    circuit, params = Circuit(model.features, model.size), circuit_params(model)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row_id")
        x, y = rows[columns].to_numpy(float), rows["label"].to_numpy(float)
        p = np.clip(circuit.probability(x, params), 1e-7, 1 - 1e-7)
        slope = -(weight * y / p - (1 - y) / (1 - p))
        return pd.DataFrame({"chunk": [key[0]], "rows": [len(rows)], "g": [circuit.gradient(x, params, slope).reshape(-1).tolist()]})

    dealt = df.select(F.floor(F.col("row_id") / chunk).cast("long").alias("chunk"), "row_id", "label", *columns)
    parts = dealt.groupBy("chunk").applyInPandas(run, "chunk long, rows long, g array<double>")

    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("chunk")
        return pd.DataFrame({"chunk": [key[0]], "rows": [rows["rows"].sum()], "g": [sum(map(np.array, rows["g"])).tolist()]})

    parts = parts.groupBy(F.floor(F.col("chunk") / 4096).alias("part")).applyInPandas(add, "chunk long, rows long, g array<double>").orderBy("chunk").collect()  # a row for a million rows
    return sum((np.array(r["g"]) for r in parts), np.zeros(len(model.params))) / sum(r["rows"] for r in parts)


def gradient_tasks(rows: int, chunk: int = 256) -> int:
    """Independent tasks of an adjoint gradient over a batch."""
    return -(-rows // chunk)


def gradient_arrays(model: Classifier, x: np.ndarray, y: np.ndarray, weight: float) -> tuple[float, np.ndarray]:
    """Loss and mean gradient of a batch in memory, for every kind."""
    n, span = model.features, model.span
    w = np.array(model.params, float)
    if model.kind == "circuit":
        circuit, params = Circuit(n, model.size), circuit_params(model)
        p = circuit.probability(x, params)
    elif model.kind == "harmonic":
        design = np.concatenate([np.cos(x), np.sin(x), np.ones((len(x), 1))], 1)
        p = 1 / (1 + np.exp(-(design @ w)))
    elif model.size:
        m = model.size
        first, bias, out = w[: m * n].reshape(n, m), w[m * n : m * (n + 1)], w[m * (n + 1) : m * (n + 2)]
        hidden = np.tanh(x / span @ first + bias)
        p = 1 / (1 + np.exp(-(hidden @ out + w[-1])))
    else:
        design = np.concatenate([x / span, np.ones((len(x), 1))], 1)
        p = 1 / (1 + np.exp(-(design @ w)))
    q = np.clip(p, 1e-7, 1 - 1e-7)
    loss = float(np.mean(-(weight * y * np.log(q) + (1 - y) * np.log(1 - q))))
    slope = np.where(q == p, -(weight * y / q - (1 - y) / (1 - q)), 0)
    if model.kind == "circuit":
        return loss, circuit.gradient(x, params, slope).reshape(-1) / len(x)
    z = slope * p * (1 - p)
    if model.kind == "perceptron" and model.size:
        back = z[:, None] * out * (1 - hidden**2)
        return loss, np.concatenate([((x / span).T @ back / len(x)).reshape(-1), back.mean(0), hidden.T @ z / len(x), [z.mean()]])
    return loss, design.T @ z / len(x)


class Adam:
    """Adam with the usual constants (0.9, 0.999, 1e-8)."""

    def __init__(self, size: int):
        self.m, self.v, self.t = np.zeros(size), np.zeros(size), 0

    def step(self, params: np.ndarray, gradient: np.ndarray, rate: float) -> np.ndarray:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * gradient
        self.v = 0.999 * self.v + 0.001 * gradient**2
        return params - rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def train(
    model: Classifier, train_rows: DataFrame, validation: DataFrame, columns: list[str], *, epochs: int = 100, batch: int = 32, rate: float = 0.01, decay: float = 1.0, patience: int = 10,
    weight: float = 1.0, seed: int = 42, most_rows: int = 2_000_000, on_epoch: Callable[[dict], None] | None = None,
) -> tuple[Classifier, list[dict]]:
    """The model of the least validation loss and the history of epochs.

    Mini-batch steps follow one another, so training and validation rows come to the driver once, up to most_rows of each; more are
    refused, not sampled. A permutation per epoch; the last batch may be short; the epoch's loss is the mean over batches.
    """
    for name, rows in (("training", train_rows), ("validation", validation)):
        if (n := rows.count()) > most_rows:
            raise ValueError(f"{n} {name} rows; the limit is {most_rows}")
    load = lambda df: (lambda t: (t[columns].to_numpy(float), t["label"].to_numpy(float)))(df.select(*columns, "label").toPandas())
    x, y = load(train_rows.orderBy("window"))
    vx, vy = load(validation)
    rng, adam = np.random.default_rng(seed), Adam(len(model.params))
    best, history, waited = None, [], 0
    for epoch in range(1, epochs + 1):
        order, losses = rng.permutation(len(x)), []
        for a in range(0, len(x), batch):
            loss, gradient = gradient_arrays(model, x[order[a : a + batch]], y[order[a : a + batch]], weight)
            losses.append(loss)
            model = replace(model, params=tuple(adam.step(np.array(model.params), gradient, rate * decay ** (epoch - 1)).tolist()))
        val_loss, _ = gradient_arrays(model, vx, vy, weight)
        history.append({"epoch": epoch, "train_loss": float(np.mean(losses)), "val_loss": val_loss})
        if on_epoch:
            on_epoch(history[-1])
        if math.isfinite(val_loss) and (best is None or val_loss < best[0]):
            best, waited = (val_loss, model), 0
        else:
            waited += 1
            if waited >= patience:
                break
    if best is None:
        raise RuntimeError("no epoch gave a finite validation loss")
    return best[1], history
