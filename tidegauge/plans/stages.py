"""Stages: train, evaluate, calibrate, replay. Each reads tables, writes a run directory and returns what it found."""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable
from dataclasses import asdict, replace
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge import tables
from tidegauge.operators import alerts, conditioning, delivery, evaluate, labels, models, replay, scaler, train, windows
from tidegauge.operators import holes as hole_rules
from tidegauge.operators.intervals import touching
from tidegauge.plans.config import Settings
from tidegauge.sources import records


def _blocks(n: int, s: Settings) -> dict[str, windows.Range]:
    return windows.chronological_split(n, s.train_fraction, s.validation_fraction, windows.buffer_windows(s.window_size, s.step_size))


def fit_threshold(scored: DataFrame, s: Settings, tail: int = 0) -> dict:
    """Threshold and what it was fitted on."""
    sweep = evaluate.threshold_sweep(scored, evaluate.candidates(scored, tail=tail), s.step_size, s.sample_rate).cache()
    got = evaluate.select_threshold(sweep, s.criterion, s.target_far_per_30d, s.target_fpr).first()
    at = sweep.where(F.col("threshold") == got["threshold"]).first()
    counts = scored.agg(F.count("*").alias("n"), F.sum((F.col("label") == 1).cast("int")).alias("p")).first()
    episodes = at["episodes"] if at else 0
    return {
        "value": got["threshold"], "criterion": got["criterion"], "auc": evaluate.roc_auc(scored).first()["auc"], "fit_windows": counts["n"], "fit_positive_windows": counts["p"] or 0,
        "fit_false_alarm_episodes": episodes, "fit_false_alarms_per_30d": at["false_alarms_per_30d"] if at else None, "target_far_per_30d": s.target_far_per_30d,
        "relative_error_percent": evaluate.warn_fit_episodes(episodes, s.min_episodes), "sweep": [r.asDict() for r in sweep.orderBy("threshold").collect()],
    }


def train_classifier(data: DataFrame, columns: list[str], s: Settings, out: str, run_id: str | None = None, on_epoch: Callable[[dict], None] | None = None, sidecar: dict | None = None) -> dict:
    """data(window, features, label), windows 1 to n in time order without gaps; sidecar: what the feature table was made with."""
    folder = Path(out) / (run_id or uuid.uuid4().hex[:12])
    bounds = data.agg(F.min("window").alias("a"), F.max("window").alias("b"), F.count("*").alias("n")).first()
    if not bounds["n"] or bounds["b"] - bounds["a"] + 1 != bounds["n"]:
        raise ValueError("training takes consecutive windows without gaps")
    if s.kind == "circuit" and len(columns) != s.qubits:
        raise ValueError(f"{len(columns)} features for {s.qubits} qubits")
    models.check_memory(s.kind, s.qubits, s.layers, s.batch, s.most_memory_gib, s.warn_memory_gib)
    data = data.withColumn("window", F.col("window") - (bounds["a"] - 1))
    n = min(bounds["n"], s.test_mode_samples) if s.test_mode_samples else bounds["n"]
    blocks = _blocks(n, s)
    own = {k: windows.restrict(data, blocks, k) for k in blocks}
    scale = scaler.fit_scaler(own["train"], columns, s.low_quantile, s.high_quantile, s.span)
    coded = {k: scaler.encode_features(v, columns, scale) for k, v in own.items()}
    weight = evaluate.class_counts(own["train"]).first()["class_weight"] if s.class_weight == "auto" else 1.0
    model = models.build_classifier(s.kind, len(columns), s.units, s.span, s.seed)
    model, history = train.train(model, coded["train"], coded["validation"], columns, epochs=s.epochs, batch=s.batch, rate=s.rate, decay=s.decay, patience=s.patience, weight=weight, seed=s.seed, on_epoch=on_epoch)
    held = windows.threshold_rows(blocks, s.threshold_block)
    fitted = fit_threshold(models.predict_all(scaler.encode_features(data.where(held.holds(F.col("window"))), columns, scale), columns, model), s)
    test = models.predict_all(coded["test"], columns, model)
    metrics = evaluate.window_metrics(test, fitted["value"]).first().asDict() | evaluate.event_metrics(test, fitted["value"], s.step_size, s.sample_rate).first().asDict()
    fitted |= {"block": s.threshold_block, "fitted_on": "training record", "fitted_at": _now()}
    records.save_model(str(folder / "model.json"), model, scale, {"columns": columns, "channels": s.channels})
    _tables(data.sparkSession, str(folder), sweep=fitted["sweep"], history=history)
    if sidecar is not None:
        records.write_json(str(folder / "features.json"), sidecar)
    for name, value in {"config": asdict(s), "split": {k: [r.first, r.last] for k, r in blocks.items()}, "history": {"epochs": history}, "threshold": fitted, "metrics": metrics}.items():
        records.write_json(str(folder / f"{name}.json"), value)
    return {"run": str(folder), "model": model, "scaler": scale, "threshold": fitted["value"], "history": history, "metrics": metrics}


def load_run(folder: str) -> tuple[models.Classifier, scaler.FeatureScaler, list[str], float, dict]:
    model, scale, metadata = records.load_model(f"{folder}/model.json")
    threshold = json.loads(Path(folder, "threshold.json").read_text())
    return model, scaler.require_scaler(scale), metadata["columns"], threshold["value"], json.loads(Path(folder, "split.json").read_text())


def inference_table(scored: DataFrame, threshold: float) -> DataFrame:
    """Window, Probability, Detection and, where scored has them, Label and SNR."""
    more = [F.col(a).alias(b) for a, b in (("label", "Label"), ("snr", "SNR")) if a in scored.columns]
    return scored.select(F.col("window").alias("Window"), F.col("probability").alias("Probability"), models.decide(F.col("probability"), threshold).alias("Detection"), *more)


def outside(out: str, run: str) -> None:
    """Outputs never go into the run that they were made from."""
    a, b = Path(out).resolve(), Path(run).resolve()
    if a == b or b in a.parents:
        raise ValueError(f"{out} lies inside the run {run}")


def evaluate_classifier(data: DataFrame, folder: str, s: Settings, block: str = "all", out: str | None = None, first_window: int = 1, metadata: dict | None = None) -> dict:
    """Scores a table under a run's model; metrics where there are labels; tables and a snapshot below out."""
    model, scale, columns, threshold, split = load_run(folder)
    if metadata is not None:
        records.check_channels(records.load_model(f"{folder}/model.json")[2], metadata)
    own = windows.restrict(data, {k: windows.Range(*v) for k, v in split.items()}, block)
    scored = models.predict_all(scaler.encode_features(own, columns, scale), columns, model)
    scored = scored.withColumns({"decision": models.decide(F.col("probability"), threshold), "day": delivery.mission_day(F.col("window"), s.step_size, s.sample_rate, first_window)})
    found = {"scored": scored, "threshold": threshold}
    if "label" in data.columns:
        found |= {"auc": evaluate.roc_auc(scored).first()["auc"], **evaluate.window_metrics(scored, threshold).first().asDict(), **evaluate.event_metrics(scored, threshold, s.step_size, s.sample_rate).first().asDict()}
    if out:
        records.write_csv(inference_table(scored, threshold), f"{out}/inference_probabilities")
        if "label" in data.columns:
            records.write_csv(evaluate.threshold_sweep(scored, evaluate.candidates(scored), s.step_size, s.sample_rate).orderBy("threshold"), f"{out}/threshold_sweep")
        records.write_json(f"{out}/snapshot.json", {"model": folder, "block": block, "settings": asdict(s), "metrics": {k: v for k, v in found.items() if k != "scored"}})
    return found


def calibrate_classifier(data: DataFrame, reference: DataFrame, folder: str, s: Settings, out: str) -> dict:
    """A new threshold, and scaler by rule, on the first part of a new record; the parameters never change."""
    model, scale, columns, parent, _ = load_run(folder)
    n = data.agg(F.max("window")).first()[0]
    blocks = windows.calibration_split(n, s.calibration_fraction, windows.buffer_windows(s.window_size, s.step_size))
    own = windows.restrict(data, blocks, "calibration")
    noise = lambda df: df.where("label = 0") if "label" in df.columns else df
    if s.scaler_rule == "match":
        scale = scaler.match_scaler(scale, noise(reference), noise(own), columns)
    elif s.scaler_rule == "refit":
        scale = scaler.fit_scaler(own, columns, s.low_quantile, s.high_quantile, scale.span)
    quiet = noise(own)
    if not quiet.limit(1).count():
        raise ValueError("no noise windows to calibrate on")
    scored = models.predict_all(scaler.encode_features(quiet, columns, scale), columns, model).withColumn("label", F.lit(0))
    fitted = fit_threshold(scored, replace(s, criterion="far" if s.criterion == "youden" else s.criterion), tail=s.tail_candidates) | {"block": "calibration", "fitted_at": _now(), "parent_threshold": parent, "parent_model": folder, "fitted_on": "calibration"}
    records.save_model(f"{out}/model.json", model, scale, {"columns": columns})
    records.write_json(f"{out}/threshold.json", fitted)
    records.write_json(f"{out}/split.json", {k: [r.first, r.last] for k, r in blocks.items()})
    records.write_json(f"{out}/config.json", asdict(s))
    records.write_json(f"{out}/scaler.json", {"rule": s.scaler_rule, "lower": scale.lower, "upper": scale.upper, "span": scale.span})
    _tables(data.sparkSession, out, sweep=fitted["sweep"])
    evaluation = windows.restrict(data, blocks, "evaluation")
    after = models.predict_all(scaler.encode_features(evaluation, columns, scale), columns, model)
    records.write_csv(inference_table(after, fitted["value"]), f"{out}/inference_probabilities")
    return {"run": out, "threshold": fitted["value"], "scaler": scale, "blocks": blocks, "noise_windows": fitted["fit_windows"]}


def replay_classifier(scored: DataFrame, arrivals: DataFrame, events: DataFrame, holes: DataFrame | None, s: Settings, rows: int, per_batch: int, epoch, out: str | None = None, run: str | None = None, ingested_rows: int | None = None, ordered: bool = False, end_at=None) -> dict:
    """Scored windows as a delivery completes them, with alerts: windows, latency table and false alarms of the stream; tables and a
    snapshot below out, which must lie outside the run. holes(row_start, row_end, declared_at[, cause]) are widened here."""
    if out and run:
        outside(out, run)
    if ingested_rows is not None:
        scored = conditioning.within_payload(scored, s.window_size, s.step_size, ingested_rows)
    settled = hole_rules.settle(scored.select("window"), arrivals, widened(holes, scored, s, rows), s.window_size, s.step_size, s.context_windows, rows, per_batch, s.min_coverage)
    return _replayed(settled.join(scored, "window"), arrivals, events, s, rows, per_batch, epoch, out, run, ordered, end_at)


def widened(holes: DataFrame | None, like: DataFrame, s: Settings, rows: int) -> DataFrame:
    """Holes with the dilation margin, cut to the record; an empty table for none."""
    if holes is None:
        return like.sparkSession.createDataFrame([], "row_start long, row_end long, declared_at timestamp, cause string")
    return delivery.eroded(holes, delivery.dilation_rows(s.gap_dilation_s, s.sample_rate)).withColumn("row_end", F.least("row_end", F.lit(rows)))


def replay_record(record: DataFrame, arrivals: DataFrame, events: DataFrame, holes: DataFrame | None, detector: replay.RunDetector, s: Settings, rows: int, per_batch: int, epoch, out: str | None = None, run: str | None = None, ingested_rows: int | None = None, ordered: bool = False, end_at=None) -> dict:
    """The same from samples, record(row[, channel], value): windows are conditioned by what was there at their completion, under the
    detector's density or, in trailing mode, the causal estimate in force, and scored by the detector."""
    if out and run:
        outside(out, run)
    if (detector.channels == "AE") != ("channel" in record.columns):
        raise ValueError(f"the model was trained on channels {detector.channels}; the record doesn't carry them as it should")
    n = windows.window_count(rows, detector.size, detector.step)
    ids = record.sparkSession.range(1, n + 1).withColumnRenamed("id", "window")
    if ingested_rows is not None:
        ids = conditioning.within_payload(ids, detector.size, detector.step, ingested_rows)
    trailing = None
    if s.psd_mode == "trailing":
        day = 86_400 * detector.rate
        trailing = (s.psd_segment, max(1, round(s.psd_trailing_days * day)), max(1, round(s.psd_refresh_days * day)), conditioning.edge_rows(s.psd_edge_periods, detector.rate, detector.cutoff))
    found = replay.replay(record, arrivals, widened(holes, record, s, rows), ids, detector, rows, per_batch, s.min_coverage, trailing)
    s = replace(s, window_size=detector.size, step_size=detector.step, sample_rate=detector.rate, context_windows=detector.context, channels=detector.channels)
    return _replayed(found, arrivals, events, s, rows, per_batch, epoch, out, run, ordered, end_at)


def _replayed(settled: DataFrame, arrivals: DataFrame, events: DataFrame, s: Settings, rows: int, per_batch: int, epoch, out: str | None, run: str | None, ordered: bool, end_at) -> dict:
    """What a replay gives, from every window with settle()'s columns and its score: a stateful scorer's windows are released in
    order and alarm then, a stateless one's at their completion."""
    if end_at is None:
        end_at = F.lit(settled.agg(F.max(F.greatest("complete_at", "dead_at"))).first()[0]).cast("timestamp")
    horizon = None if math.isinf(s.order_horizon_s) else s.order_horizon_s
    committed = hole_rules.ordered_commit(settled, end_at, horizon if ordered else None, s.late_policy)
    more = [c for c in settled.columns if c not in committed.columns]
    whole = tables.written(committed.join(settled.select("window", *more), "window"))  # every output reads it
    if not ordered:
        whole = whole.withColumn("release_at", F.lit(None).cast("timestamp"))
    start, end = (F.col("window") - 1) * s.step_size + 1, (F.col("window") - 1) * s.step_size + s.window_size
    live = whole.where("state = 'scored'").drop("state", "settled_at", "dead_at", "cause").withColumns({
        "row_start": start, "row_end": end, "content_start": delivery.row_time(start, epoch, s.sample_rate), "content_end": delivery.row_time(end, epoch, s.sample_rate), "scored_at": delivery.scored_at(),
    })
    spans = alerts.credited_spans(alerts.mode_events(events, s.channels), s.crediting)
    found = {
        "windows": live, "gaps": hole_rules.gap_table(whole), "latency": alerts.alert_latency(alerts.alert_runs(live, s.persistence), spans, s.window_size, s.step_size, epoch, s.processing_hours),
        "confirmations": alerts.confirmations(live, s.persistence, s.confirmation, s.window_size, s.step_size), "false_alarms": alerts.streamed_false_alarms(live, spans, s.window_size, s.step_size, s.sample_rate, s.persistence),
        "spans": alerts.credited_span_times(spans, epoch, s.sample_rate),
    }
    if out:
        records.write_csv(live.orderBy("window"), f"{out}/telemetry_windows")
        records.write_csv(found["gaps"].orderBy("start", "cause"), f"{out}/telemetry_gaps")
        records.write_csv(found["latency"].orderBy("event"), f"{out}/alert_latency")
        records.write_json(f"{out}/snapshot.json", {"run": run, "settings": asdict(s), "rows": rows, "per_batch": per_batch, "ordered": ordered, "false_alarms": found["false_alarms"].first().asDict()})
    return found


def detector_from_run(spark: SparkSession, folder: str, psd_sidecar: str | None = None, context: int = 4) -> replay.RunDetector:
    """The detector of a training run: model, scaler and threshold, and the sidecar of its feature table (features.json)."""
    model, scale, columns, threshold, _ = load_run(folder)
    side = Path(folder, "features.json")
    if not side.is_file():
        raise ValueError(f"the run {folder} has no sidecar of its features")
    if psd_sidecar is not None and not Path(psd_sidecar).is_file():
        raise ValueError(f"no whitening sidecar at {psd_sidecar}")
    read = lambda path: json.loads(Path(path).read_text())
    return replay.detector_of(spark, model, scale, columns, threshold, read(side), psd_sidecar and read(psd_sidecar), context)


def label_truth_stream(strength: DataFrame, catalogue: DataFrame | None, s: Settings, rows: int, out: str, span: str = "fixed", before_s: float = 345_600.0, after_s: float = 1620.0, threshold: float = 3.0, merger: float = 8.0, separation_s: float = 86_400.0, ratio: float = 0.1, step: int = 10) -> dict:
    """Labels of a signal-only record: strength(window, snr) of windows at `step`, catalogue(event, merger_time_s) or, without one,
    mergers from peaks. Writes label runs, events and spans."""
    if catalogue is None:
        peaks = labels.snr_peaks(strength, merger, round(separation_s * s.sample_rate / step), ratio)
        order = F.row_number().over(Window.orderBy("window")).cast("int")  # a row per merger
        catalogue = peaks.select(order.alias("event"), (((F.col("window") - 1) * step + s.window_size / 2) / s.sample_rate).alias("merger_time_s"))
    spans = labels.fixed_spans(catalogue, before_s, after_s, s.sample_rate, rows)
    rows_of = windows.window_table(strength, s.window_size, step)
    owned = touching(rows_of, spans).select("event", "window", "snr")
    if span == "detectable":
        spans = labels.detectable_spans(owned, threshold, s.window_size, step)
    events = catalogue.join(spans.withColumnsRenamed({"start": "label_start_index", "end": "label_end_index"}), "event")
    events = events.join(labels.signal_onsets(owned, spans, threshold, s.window_size, step).withColumnRenamed("onset", "signal_start_index"), "event", "left")
    runs = labels.span_labels(spans)
    paths = {k: f"{out}/{k}" for k in ("labels", "events", "spans")}
    for name, table in (("labels", runs), ("events", events), ("spans", spans)):
        records.write_csv(table, paths[name])
    n = runs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("end") - F.col("start") + 1), F.lit(0)).alias("rows")).first()
    return {"events": events, "n_label_runs": n["n"], "positive_fraction": n["rows"] / rows, "label_path": paths["labels"], "events_path": paths["events"], "spans_path": paths["spans"]}


def _now() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="seconds")


def _tables(spark: SparkSession, folder: str, **tables: list[dict]) -> None:
    for name, rows in tables.items():
        if rows:
            whole = [k for k in rows[0] if all(isinstance(r[k], int) for r in rows)]
            kinds = ", ".join(f"{k} {'long' if k in whole else 'double'}" for k in rows[0])
            records.write_csv(spark.createDataFrame([tuple(r[k] if k in whole or r[k] is None else float(r[k]) for k in rows[0]) for r in rows], kinds), f"{folder}/{name}")
