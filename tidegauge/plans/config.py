"""Settings: TOML files, defaults, bounds."""

from __future__ import annotations

import math
import tomllib
from dataclasses import dataclass, fields
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    """Defaults apply where a file has no key."""

    kind: str = "circuit"
    qubits: int = 4
    layers: int = 4
    hidden: int = 6
    epochs: int = 100
    batch: int = 32
    rate: float = 0.01
    decay: float = 0.95
    patience: int = 12
    seed: int = 42
    class_weight: str = "auto"
    train_fraction: float = 0.7
    validation_fraction: float = 0.15
    window_size: int = 1000
    step_size: int = 100
    sample_rate: float = 0.2
    span: float = math.pi
    low_quantile: float = 0.005
    high_quantile: float = 0.995
    criterion: str = "far"
    threshold_block: str = "validation"
    target_far_per_30d: float = 3.0
    target_fpr: float = 0.05
    min_episodes: int = 5
    calibration_fraction: float = 0.3
    scaler_rule: str = "match"
    min_coverage: float = 1.0
    context_windows: int = 2
    persistence: int = 3
    confirmation: int = 0
    crediting: str = "signal"
    test_mode_samples: int = 0
    channels: str = "A"
    highpass_cutoff: float = 0.0005
    highpass_order: int = 8
    edge_margin: float = 0.0
    tail_candidates: int = 200
    most_memory_gib: float = 16.0
    warn_memory_gib: float = 8.0
    gap_dilation_s: float = 0.0
    processing_hours: float = 0.0
    psd_mode: str = "sidecar"
    psd_trailing_days: float = 30.0
    psd_refresh_days: float = 1.0
    psd_segment: int = 65_536
    psd_edge_periods: float = 3.0
    order_horizon_s: float = math.inf
    late_policy: str = "skip"

    def __post_init__(self):
        one_of = {
            "kind": ("circuit", "logistic", "perceptron", "harmonic"), "class_weight": ("auto", "none"), "criterion": ("far", "fpr", "youden"), "threshold_block": ("validation", "held_out"),
            "scaler_rule": ("match", "refit", "keep"), "crediting": ("signal", "label"), "channels": ("A", "AE"), "psd_mode": ("sidecar", "trailing"), "late_policy": ("skip", "refuse"),
        }
        within = {
            "qubits": (2, 24), "layers": (1, 64), "hidden": (0, 4096), "epochs": (1, 10**6), "batch": (1, 10**6), "patience": (1, 10**6), "train_fraction": (1e-9, 1 - 1e-9),
            "validation_fraction": (1e-9, 1 - 1e-9), "window_size": (2, 10**9), "step_size": (1, self.window_size), "sample_rate": (1e-12, 1e12), "span": (1e-9, 2 * math.pi),
            "calibration_fraction": (1e-9, 1 - 1e-9), "min_coverage": (1e-9, 1.0), "context_windows": (0, 10**6), "persistence": (1, 10**6), "target_far_per_30d": (0, 1e9), "target_fpr": (0, 1),
            "gap_dilation_s": (0, 1e12), "processing_hours": (0, 1e6), "psd_trailing_days": (1e-9, 1e9), "psd_refresh_days": (1e-9, 1e9), "psd_segment": (2, 10**9), "psd_edge_periods": (0, 1e9), "order_horizon_s": (0, math.inf),
        }
        for name, allowed in one_of.items():
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} = {getattr(self, name)!r}; allowed: {', '.join(allowed)}")
        for name, (low, high) in within.items():
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} = {getattr(self, name)}; allowed: {low} to {high}")
        if self.train_fraction + self.validation_fraction >= 1:
            raise ValueError("nothing is left for the test block")
        if self.kind == "harmonic" and self.hidden not in (0, 6):  # the default says nothing
            raise ValueError("a harmonic control has no hidden units")


    @property
    def units(self) -> int:
        """Layers of a circuit, hidden units of a perceptron; other kinds have no size."""
        return {"circuit": self.layers, "perceptron": self.hidden}.get(self.kind, 0)


#: Keys of a settings file by section, and the setting that each gives.
KEYS = {
    "model": {"n_qubits": "qubits", "n_layers": "layers", "kind": "kind", "hidden_units": "hidden"},
    "training": {
        "epochs": "epochs", "batch_size": "batch", "learning_rate": "rate", "lr_decay": "decay", "patience": "patience", "train_fraction": "train_fraction", "validation_fraction": "validation_fraction",
        "class_weight": "class_weight", "threshold_criterion": "criterion", "threshold_block": "threshold_block", "target_far_per_30d": "target_far_per_30d", "target_fpr": "target_fpr",
        "min_fit_episodes": "min_episodes", "phase_span": "span", "seed": "seed",
    },
    "preprocessing": {"window_size": "window_size", "step_size": "step_size", "sample_rate": "sample_rate", "highpass_cutoff_hz": "highpass_cutoff", "highpass_order": "highpass_order", "edge_margin": "edge_margin"},
    "calibration": {"block_fraction": "calibration_fraction", "scaler": "scaler_rule", "tail_candidates": "tail_candidates"},
    "tdi": {"channels": "channels"},
    "resources": {"max_memory_gib": "most_memory_gib", "warn_memory_gib": "warn_memory_gib"},
    "telemetry": {
        "min_coverage": "min_coverage", "context_windows": "context_windows", "alert_persistence": "persistence", "alert_confirmation": "confirmation", "alert_confirmation_persistence": "confirmation", "alert_crediting": "crediting",
        "tdi_gap_dilation_sec": "gap_dilation_s", "processing_latency_hours": "processing_hours", "psd_mode": "psd_mode", "psd_trailing_days": "psd_trailing_days", "psd_refresh_days": "psd_refresh_days",
        "psd_segment_length": "psd_segment", "psd_edge_periods": "psd_edge_periods", "order_horizon_sec": "order_horizon_s", "late_policy": "late_policy",
    },
}


def load_config(path: str) -> Settings:
    """Keys of the sections above, or settings by their own names. Other keys of a known section, and other sections (paths,
    sources, sinks), are left to the stages that read them; keys outside any section must be settings. Integers are taken
    where numbers are asked for; phase_span counts in pi; class_weight "balanced" is "auto"; test_mode_samples only counts under its own name."""
    data = tomllib.loads(Path(path).read_text())
    known, flat = {f.name: f.type for f in fields(Settings)}, {}
    for name, section in data.items():
        if not isinstance(section, dict):
            if name not in known:
                raise ValueError(f"unknown key: {name}")
            flat[name] = section
            continue
        keys = KEYS.get(name, {})
        own = {k: v for k, v in section.items() if k in known and k not in ("channels", "test_mode_samples") and k not in keys and name in KEYS}
        found = {keys[k]: v for k, v in section.items() if k in keys}
        if name == "training" and "phase_span" in section:
            found["span"] = section["phase_span"] * math.pi
        if name == "training" and "scaler_quantiles" in section:
            found["low_quantile"], found["high_quantile"] = map(float, section["scaler_quantiles"])
        if found.get("class_weight") == "balanced":
            found["class_weight"] = "auto"
        if name in ("model", "training") and (odd := sorted(set(section) - set(keys) - set(own) - OTHER)):
            raise ValueError(f"unknown keys in [{name}]: {', '.join(odd)}")
        flat |= own | found
    return Settings(**{k: float(v) if known[k] == "float" and isinstance(v, int) else v for k, v in flat.items()})


#: Keys of [model] and [training] that name files or how another engine runs.
OTHER = {"train_features", "train_labels", "scaler_quantiles", "test_mode_samples", "test_mode_epochs", "threaded", "gradient_method"}
