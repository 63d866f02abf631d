"""Alerts: runs of alarmed windows, their credit to known events, latencies and false-alarm rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.operators.delivery import row_time
from tidegauge.operators.intervals import islands, touching


def alert_runs(windows: DataFrame, persistence: int) -> DataFrame:
    """windows(window, decision, scored_at) -> start, end, n, t_alarm of runs of `persistence` alarmed windows at least;
    the alert is raised by the arrival that completes the first such stretch of the run in time."""
    alarmed = windows.where("decision = 1")
    runs = islands(alarmed.select(F.lit(0).alias("series"), F.col("window").alias("idx"))).drop("series").where(F.col("n") >= persistence)
    inside = alarmed.join(runs.select("start", "end", "n", F.explode(F.sequence("start", "end")).alias("window")), "window")
    back = Window.partitionBy("start").orderBy("window").rowsBetween(-(persistence - 1), 0)  # one run
    raised = inside.withColumns({"m": F.count("*").over(back), "t": F.max("scored_at").over(back)}).where(F.col("m") == persistence)
    return raised.groupBy("start").agg(F.first("end").alias("end"), F.first("n").alias("n"), F.min("t").alias("t_alarm"))


def confirmations(windows: DataFrame, persistence: int, confirm: int, size: int, step: int) -> DataFrame:
    if not confirm:
        return alert_runs(windows, 1).limit(0)
    if confirm <= max(persistence, size // step):
        raise ValueError("a confirmation takes more windows than an alert and than share one row")
    return alert_runs(windows, confirm)


def credited_spans(events: DataFrame, crediting: str) -> DataFrame:
    """events -> event, merger_time_s, start, end: from the onset (signal) or the label's start (label) to the label's end."""
    columns = {"signal": "signal_start_index", "label": "label_start_index"}
    if crediting not in columns:
        raise ValueError(f"unknown crediting {crediting}")
    if columns[crediting] not in events.columns:
        raise ValueError("labels without onsets can't be credited from the signal on")
    return events.select("event", "merger_time_s", F.col(columns[crediting]).alias("start"), F.col("label_end_index").alias("end"))


def credited_span_times(spans: DataFrame, epoch: Column, rate: float) -> DataFrame:
    """Spans in mission time: start_at and end_at."""
    return spans.withColumns({"start_at": row_time(F.col("start"), epoch, rate), "end_at": row_time(F.col("end"), epoch, rate)})


def mode_events(events: DataFrame, channels: str) -> DataFrame:
    """Two-channel mode takes its own onsets."""
    return events.withColumn("signal_start_index", F.col("signal_start_index_ae")) if channels == "AE" else events


def alert_latency(runs: DataFrame, spans: DataFrame, size: int, step: int, epoch: Column, processing_hours: float = 0.0) -> DataFrame:
    """Per event the earliest alert that touches its span: detected, t_alarm, latencies in hours, and whether it also
    touches the span of an earlier event."""
    rows = runs.select("start", "t_alarm", ((F.col("start") - 1) * step + 1).alias("row_start"), ((F.col("end") - 1) * step + size).alias("row_end")).withColumnRenamed("start", "run")
    met = touching(rows, spans.select("event", "start", "end"))
    first = met.groupBy("event").agg(F.min_by("run", F.struct("t_alarm", "run")).alias("run"), F.min("t_alarm").alias("t_alarm"))
    owner = met.groupBy("run").agg(F.min("event").alias("owner"))
    merger = F.timestamp_micros(F.unix_micros(epoch) + F.round(F.col("merger_time_s") * 1e6).cast("long"))
    out = spans.join(first, "event", "left").join(owner, "run", "left").withColumn("t_merger", merger)
    hours = (F.unix_micros("t_alarm") - F.unix_micros("t_merger")) / F.lit(3.6e9)
    return out.select("event", "merger_time_s", "t_merger", F.col("t_alarm").isNotNull().cast("int").alias("detected"), "t_alarm", hours.alias("latency_data_h"), (hours + processing_hours).alias("latency_total_h"), F.coalesce(F.col("owner") < F.col("event"), F.lit(False)).alias("shared"))


def streamed_false_alarms(windows: DataFrame, spans: DataFrame, size: int, step: int, rate: float, persistence: int) -> DataFrame:
    """Runs of alarmed windows outside every credited span, of the alerting length, per 30 scored days."""
    rows = windows.select("window", "decision", ((F.col("window") - 1) * step + 1).alias("row_start"), ((F.col("window") - 1) * step + size).alias("row_end"))
    inside = touching(rows.where("decision = 1"), spans.select("start", "end")).select("window").distinct()
    outside = rows.where("decision = 1").join(inside, "window", "left_anti")
    runs = islands(outside.select(F.lit(0).alias("series"), F.col("window").alias("idx"))).where(F.col("n") >= persistence).agg(F.count("*").alias("episodes"))
    days = windows.agg((F.count("*") * (step / rate / 86_400.0)).alias("scored_days"))
    return runs.join(F.broadcast(days)).withColumn("false_alarms_per_30d", F.col("episodes") / F.col("scored_days") * 30.0)
