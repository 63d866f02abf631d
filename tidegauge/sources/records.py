"""Records, feature and label tables, event catalogues: readers with explicit schemas, writers that never overwrite."""

from __future__ import annotations

import hashlib
import json
import os
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.functions.psd import channels
from tidegauge.operators.models import Classifier
from tidegauge.operators.scaler import FeatureScaler

SCHEMAS = {
    "record": "row long, t double, X double, Y double, Z double",
    "truth": "t double, X double, Y double, Z double",
    "events": "event int, merger_time_s double, label_start_index long, label_end_index long, signal_start_index long, signal_start_index_ae long",
    "arrivals": "sim_time timestamp_ntz, batch string, event string, value long",
    "batches": "batch long, row_start long, row_end long, state string",
    "holes": "row_start long, row_end long, cause string, declared_at timestamp_ntz",
}


def read_table(spark: SparkSession, path: str, kind: str | T.StructType) -> DataFrame:
    """Parquet or CSV by the path's ending, under an explicit schema."""
    reader = spark.read.schema(SCHEMAS[kind] if isinstance(kind, str) else kind)
    return reader.csv(path, header=True) if re.search(r"\.csv(\.gz)?/?$", path) else reader.parquet(path)


def component_sum(parts: list[DataFrame]) -> DataFrame:
    """Sum of component streams by row; a row that a component lacks counts as nothing there."""
    whole = parts[0].select("row", "X", "Y", "Z")
    for p in parts[1:]:
        whole = whole.unionByName(p.select("row", "X", "Y", "Z"))
    return whole.groupBy("row").agg(*(F.sum(c).alias(c) for c in "XYZ"))


def channel_record(record: DataFrame, mode: str) -> DataFrame:
    """row, channel, value for mode A or AE."""
    if mode not in ("A", "AE"):
        raise ValueError(f"unknown channel mode {mode}")
    c = channels(F.col("X"), F.col("Y"), F.col("Z"))
    pairs = F.array(*(F.struct(F.lit(k.upper()).alias("channel"), c[k].alias("value")) for k in mode.lower()))
    return record.select("row", F.explode(pairs).alias("p")).select("row", "p.channel", "p.value")


def drop_leading(record: DataFrame, first_row: int, rows: int) -> DataFrame:
    """Rows from first_row on, numbered anew."""
    if not 1 <= first_row <= rows:
        raise ValueError(f"first row {first_row} outside 1 to {rows}")
    return record.where(F.col("row") >= first_row).withColumn("row", F.col("row") - (first_row - 1))


def check_rate(found: float, wanted: float) -> None:
    if abs(found - wanted) > 1e-9 * abs(wanted):
        raise ValueError(f"sample rate {found}; {wanted} is wanted")


def served_columns(carried: set[str], mode: str, from_record: bool) -> set[str] | None:
    """Payload columns to read: None for a single-column run's own, A where one channel is enough, else the wanted set."""
    wanted = set(mode)
    if from_record or mode == "A" and "A" in carried:
        return {"A"}
    if len(carried) == 1 and mode == "A":
        return None
    if not wanted <= carried:
        raise ValueError(f"the run carries {sorted(carried)}; {sorted(wanted)} are wanted")
    return wanted


def run_columns(payload: DataFrame) -> list[str]:
    """Payload columns that a run carries, in order; batch, row and time are its keys."""
    return [c for c in payload.columns if c not in ("batch", "row", "t", "sim_time")]


def check_channels(model_metadata: dict, table_metadata: dict) -> str:
    """The channel mode of a model, which the features it scores must share; what records none is of mode A."""
    trained, scored = model_metadata.get("channels", "A"), table_metadata.get("channels", "A")
    if trained != scored:
        raise ValueError(f"the model was trained on channels {trained}; the table holds those of {scored}")
    return trained


def load_data(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Features and labels joined on the window index; snr is 0 where the labels have none."""
    labels = labels if "snr" in labels.columns else labels.withColumn("snr", F.lit(0.0))
    return features.join(labels.select("window", "label", "snr"), "window")


def content_digest(path: str) -> str:
    h = hashlib.sha256()
    for p in sorted(Path(path).rglob("*")) if os.path.isdir(path) else [Path(path)]:
        if p.is_file():
            with p.open("rb") as f:
                while data := f.read(1 << 20):
                    h.update(data)
    return h.hexdigest()


def parameter_digest(parameters: dict) -> str:
    return hashlib.sha256(json.dumps(parameters, sort_keys=True).encode()).hexdigest()


def backup_existing(path: str) -> None:
    """Renames what stands at path to <stem>_#k<ending>."""
    p = Path(path)
    if p.exists():
        k = 1
        while (other := p.with_name(f"{p.stem}_#{k}{p.suffix}")).exists():
            k += 1
        p.rename(other)


def write_json(path: str, value: dict) -> None:
    backup_existing(path)
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(value, indent=1, default=str))


def write_csv(df: DataFrame, path: str) -> None:
    backup_existing(path)
    df.write.csv(path, header=True)


def reusable(sidecar: str, parameters: dict, inputs: dict[str, str]) -> bool:
    """Whether a product's sidecar has the same parameters and input digests."""
    if not os.path.exists(sidecar):
        return False
    had = json.loads(Path(sidecar).read_text())
    return had.get("parameters") == parameter_digest(parameters) and had.get("inputs") == {k: content_digest(v) for k, v in inputs.items()}


def save_model(path: str, model: Classifier, scaler: FeatureScaler | None = None, metadata: dict | None = None) -> None:
    write_json(path, {"kind": model.kind, "features": model.features, "size": model.size, "span": model.span, "params": list(model.params), "scaler": scaler and {"lower": scaler.lower, "upper": scaler.upper, "span": scaler.span}, "metadata": metadata or {}})


def load_model(path: str) -> tuple[Classifier, FeatureScaler | None, dict]:
    """Artifacts without a kind are circuits; unknown kinds and controls without a span are refused."""
    x = json.loads(Path(path).read_text())
    kind = x.get("kind", "circuit")
    if kind not in ("circuit", "logistic", "perceptron", "harmonic"):
        raise ValueError(f"unknown kind {kind}")
    if "span" not in x and kind != "circuit":
        raise ValueError("a control needs the span it was trained on")
    scaler = x.get("scaler") and FeatureScaler(tuple(x["scaler"]["lower"]), tuple(x["scaler"]["upper"]), x["scaler"]["span"])
    return Classifier(kind, x["features"], tuple(x["params"]), x.get("size", 0), x.get("span", 3.141592653589793)), scaler, x.get("metadata", {})
