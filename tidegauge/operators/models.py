"""Classifiers: three controls as Column expressions, and a simulated parameterised circuit.

The circuit of n qubits and L layers applies, in each layer, a Hadamard gate and a phase rotation by the
feature's angle on every qubit, then trained Y and Z rotations and a ring of controlled NOTs; the output
is (1 - mean Z expectation) / 2. Batches of rows advance together as one array of amplitudes.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Classifier:
    """kind: logistic, perceptron, harmonic or circuit; size: hidden units or layers."""

    kind: str
    features: int
    params: tuple[float, ...]
    size: int = 0
    span: float = math.pi
    threshold: float | None = field(default=None)

    def __post_init__(self):
        if len(self.params) != parameter_count(self.kind, self.features, self.size):
            raise ValueError(f"{len(self.params)} parameters; {parameter_count(self.kind, self.features, self.size)} are needed")

    @property
    def label(self) -> str:
        return {"logistic": "logistic control", "perceptron": f"perceptron control, {self.size} hidden", "harmonic": "harmonic control", "circuit": f"circuit, {self.features} qubits, {self.size} layers"}[self.kind]


def parameter_count(kind: str, features: int, size: int = 0) -> int:
    if kind == "circuit":
        if features < 2 or size < 1:
            raise ValueError("a circuit needs two qubits and one layer at least")
        return 2 * features * size
    if kind == "harmonic" and size:
        raise ValueError("a harmonic control has no hidden units")
    counts = {"logistic": features + 1, "perceptron": size * (features + 2) + 1, "harmonic": 2 * features + 1}
    if kind not in counts:
        raise ValueError(f"unknown kind {kind}")
    return counts["logistic"] if kind == "perceptron" and not size else counts[kind]


def build_classifier(kind: str, features: int, size: int = 0, span: float = math.pi, seed: int = 42) -> Classifier:
    n = parameter_count(kind, features, size)
    return Classifier(kind, features, tuple(np.random.default_rng(seed).normal(0, 0.5, n).tolist()), size, span)


def _sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _dot(weights, columns: list[Column]) -> Column:
    out = F.lit(0.0)
    for w, c in zip(weights, columns, strict=True):
        out = out + F.lit(float(w)) * c
    return out


def probability(model: Classifier, columns: list[Column]) -> Column:
    """Probability of a control, or of a one-layer circuit in closed form."""
    n, p = model.features, model.params
    if len(columns) != n:
        raise ValueError(f"{len(columns)} features for a model of {n}")
    scaled = [c / F.lit(model.span) for c in columns]
    if model.kind == "logistic" or model.kind == "perceptron" and not model.size:
        return _sigmoid(_dot(p[:n], scaled) + F.lit(p[n]))
    if model.kind == "perceptron":
        m = model.size
        first = np.array(p[: m * n]).reshape(n, m)  # a hidden unit's weights stand m apart
        hidden = [F.tanh(_dot(first[:, j], scaled) + F.lit(p[m * n + j])) for j in range(m)]
        return _sigmoid(_dot(p[m * (n + 1) : m * (n + 2)], hidden) + F.lit(p[m * (n + 2)]))
    if model.kind == "harmonic":
        return _sigmoid(_dot(p[:n], [F.cos(c) for c in columns]) + _dot(p[n : 2 * n], [F.sin(c) for c in columns]) + F.lit(p[2 * n]))
    if model.size == 1:
        z = [F.lit(-math.sin(p[i])) * F.cos(c) for i, c in enumerate(columns)]
        total, prefix, tail = F.lit(0.0), z[0], F.lit(1.0)
        for k in range(1, n):
            prefix = prefix * z[k]
            total = total + prefix
            tail = tail * z[k]
        return (F.lit(1.0) - (total + tail) / F.lit(float(n))) / F.lit(2.0)
    raise ValueError("a deeper circuit has no closed form; use predict_circuit")


def _rotations(params: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return params[:, 0], params[:, 1]


class Circuit:
    """State vectors of a batch, amplitudes[batch, 2**n]; qubit 1 is the lowest bit."""

    def __init__(self, qubits: int, layers: int):
        self.n, self.layers = qubits, layers
        index = np.arange(1 << qubits)
        ones = np.zeros(len(index), int)
        for q in range(qubits):
            ones += index >> q & 1
        self.mean_z = (qubits - 2 * ones) / qubits
        self.ring = []
        for q in range(qubits):
            target = (q + 1) % qubits
            self.ring.append(np.where(index >> q & 1, index ^ (1 << target), index))

    def _pairs(self, state: np.ndarray, q: int) -> np.ndarray:
        return state.reshape(len(state), -1, 2, 1 << q)

    def _real(self, state: np.ndarray, q: int, a, b, c, d) -> np.ndarray:
        x = self._pairs(state, q)
        return np.stack([a * x[:, :, 0] + b * x[:, :, 1], c * x[:, :, 0] + d * x[:, :, 1]], 2).reshape(state.shape)

    def _phase(self, state: np.ndarray, q: int, angle) -> np.ndarray:
        half = np.asarray(angle, float).reshape(-1, 1, 1) / 2
        x = self._pairs(state, q)
        return np.stack([x[:, :, 0] * np.exp(-1j * half), x[:, :, 1] * np.exp(1j * half)], 2).reshape(state.shape)

    def hadamard(self, state, q):
        r = math.sqrt(0.5)
        return self._real(state, q, r, r, r, -r)

    def turn_y(self, state, q, angle):
        c, s = math.cos(angle / 2), math.sin(angle / 2)
        return self._real(state, q, c, -s, s, c)

    def forward(self, x: np.ndarray, params: np.ndarray) -> np.ndarray:
        """Final states for angles x[batch, n]; params[layers, 2, n] are Y, then Z angles."""
        state = np.zeros((len(x), 1 << self.n), complex)
        state[:, 0] = 1
        for layer in range(self.layers):
            for q in range(self.n):
                state = self._phase(self.hadamard(state, q), q, x[:, q])
            for q in range(self.n):
                state = self.turn_y(state, q, params[layer, 0, q])
            for q in range(self.n):
                state = self._phase(state, q, params[layer, 1, q])
            for q in range(self.n):
                state = state[:, self.ring[q]]
        return state

    def probability(self, x: np.ndarray, params: np.ndarray) -> np.ndarray:
        return (1 - (np.abs(self.forward(x, params)) ** 2) @ self.mean_z) / 2

    def gradient(self, x: np.ndarray, params: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Sum over rows of weight times the probability's gradient, by running the circuit backwards."""
        state = self.forward(x, params)
        bra = state * self.mean_z
        out = np.zeros_like(params)
        for layer in reversed(range(self.layers)):
            for q in reversed(range(self.n)):
                state, bra = state[:, self.ring[q]], bra[:, self.ring[q]]  # its own inverse
            for q in reversed(range(self.n)):
                z = self._pairs(state, q) * np.array([-0.5j, 0.5j])[:, None]
                out[layer, 1, q] = np.sum(weight * -np.real(np.sum(np.conj(self._pairs(bra, q)) * z, axis=(1, 2, 3))))
                state, bra = self._phase(state, q, -params[layer, 1, q]), self._phase(bra, q, -params[layer, 1, q])
            for q in reversed(range(self.n)):
                p = self._pairs(state, q)
                y = np.stack([-0.5 * p[:, :, 1], 0.5 * p[:, :, 0]], 2)
                out[layer, 0, q] = np.sum(weight * -np.real(np.sum(np.conj(self._pairs(bra, q)) * y, axis=(1, 2, 3))))
                state, bra = self.turn_y(state, q, -params[layer, 0, q]), self.turn_y(bra, q, -params[layer, 0, q])
            for q in reversed(range(self.n)):
                state = self.hadamard(self._phase(state, q, -x[:, q]), q)
                bra = self.hadamard(self._phase(bra, q, -x[:, q]), q)
        return out


def circuit_params(model: Classifier) -> np.ndarray:
    return np.array(model.params, float).reshape(model.size, 2, model.features)


def predict_circuit(df: DataFrame, columns: list[str], model: Classifier, rows_at_once: int = 4096) -> DataFrame:
    """df with a column probability; memory is rows_at_once * 2**qubits amplitudes."""
    params, circuit = circuit_params(model), Circuit(model.features, model.size)
    chunk = max(1, min(rows_at_once, (1 << 22) >> model.features))

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for batch in batches:
            x = np.stack([c.to_numpy(float) for c in batch], 1)
            yield pd.Series(np.concatenate([circuit.probability(x[a : a + chunk], params) for a in range(0, len(x), chunk)] or [np.zeros(0)]))

    return df.withColumn("probability", score(*(F.col(c) for c in columns)))


def predict_all(df: DataFrame, columns: list[str], model: Classifier) -> DataFrame:
    if model.kind == "circuit" and model.size > 1:
        return predict_circuit(df, columns, model)
    return df.withColumn("probability", probability(model, [F.col(c) for c in columns]))


def decide(p: Column, threshold: float) -> Column:
    return (p >= F.lit(threshold)).cast("int")


def check_memory(kind: str, qubits: int, layers: int, batch: int, most_gib: float = 16.0, warn_gib: float = 8.0, method: str = "adjoint") -> float:
    """The estimate; a warning above warn_gib, a refusal above most_gib."""
    need = memory_estimate_gib(kind, qubits, layers, batch, method)
    if need > most_gib:
        raise MemoryError(f"a batch gradient needs about {need:.1f} GiB; the limit is {most_gib}")
    if need > warn_gib:
        warnings.warn(f"a batch gradient needs about {need:.1f} GiB", stacklevel=2)
    return need


def memory_estimate_gib(kind: str, qubits: int, layers: int, batch: int, method: str = "adjoint") -> float:
    """Registers of a batch gradient: two for each chunk of four rows, or a tape of every gate."""
    cells = 2 * math.ceil(batch / 4) if method == "adjoint" else 2 * batch * layers * 5 * qubits
    return cells * 2**qubits * 8 / 2**30 if kind == "circuit" else 0.0
