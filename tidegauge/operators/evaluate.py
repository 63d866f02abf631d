"""Metrics of scored windows, threshold sweeps and criteria, events and false-alarm episodes.

Scores lie in 0..1. Nothing here joins candidates with windows: counts above a threshold come from running
sums over scores, and an alarm run above a threshold starts at every window that is above it while its
neighbour before isn't, so episodes are the difference of two such counts.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.operators import order
from tidegauge.operators.intervals import islands, running_sums

DAY = 86_400.0


def weighted_bce(p: Column, y: Column, weight: Column | float = 1.0) -> Column:
    """Loss of a row with p clamped to [1e-7, 1 - 1e-7]."""
    weight = weight if isinstance(weight, Column) else F.lit(float(weight))
    q = F.least(F.greatest(p, F.lit(1e-7)), F.lit(1 - 1e-7))
    return -(weight * y * F.log(q) + (F.lit(1.0) - y) * F.log(F.lit(1.0) - q))


def weighted_bce_derivative(p: Column, y: Column, weight: Column | float = 1.0) -> Column:
    weight = weight if isinstance(weight, Column) else F.lit(float(weight))
    inside = (p >= F.lit(1e-7)) & (p <= F.lit(1 - 1e-7))
    return F.when(inside, -(weight * y / p - (F.lit(1.0) - y) / (F.lit(1.0) - p))).otherwise(F.lit(0.0))


def class_counts(df: DataFrame) -> DataFrame:
    """n_pos, n_neg and the weight of a positive (their ratio, or 1 without positives)."""
    counts = df.agg(F.sum((F.col("label") == 1).cast("long")).alias("n_pos"), F.sum((F.col("label") == 0).cast("long")).alias("n_neg"))
    return counts.withColumn("class_weight", F.when(F.col("n_pos") > 0, F.col("n_neg") / F.col("n_pos")).otherwise(F.lit(1.0)))


def epoch_validation(df: DataFrame, weight: float = 1.0) -> DataFrame:
    """Mean loss, and accuracy at a strict 0.5."""
    right = ((F.col("probability") > 0.5) == (F.col("label") == 1)).cast("double")
    return df.agg(F.avg(weighted_bce(F.col("probability"), F.col("label"), weight)).alias("loss"), F.avg(right).alias("accuracy"))


def window_metrics(df: DataFrame, threshold: float) -> DataFrame:
    """Confusion counts and ratios in one pass; a ratio without cases is null."""
    hit = F.col("probability") >= threshold
    count = lambda c: F.sum(c.cast("long"))
    pos, neg = F.col("label") == 1, F.col("label") == 0
    base = df.agg(count(hit & pos).alias("tp"), count(hit & neg).alias("fp"), count(~hit & pos).alias("fn"), count(~hit & neg).alias("tn"))
    part = lambda a, b: F.try_divide(F.col(a).cast("double"), b)
    out = base.withColumns({"precision": part("tp", F.col("tp") + F.col("fp")), "recall": part("tp", F.col("tp") + F.col("fn")), "fpr": part("fp", F.col("fp") + F.col("tn"))})
    return out.withColumns({"f1": F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), "balanced_accuracy": (F.col("recall") + 1.0 - F.col("fpr")) / 2})


def roc_curve(df: DataFrame) -> DataFrame:
    """threshold, tpr, fpr at every distinct score, inclusive."""
    by_score = df.groupBy(F.col("probability").alias("threshold")).agg(F.sum((F.col("label") == 1).cast("long")).alias("p"), F.sum((F.col("label") == 0).cast("long")).alias("n"))
    sums = running_sums(by_score, "threshold", {"tp": "p", "fp": "n"})
    total = by_score.agg(F.sum("p").alias("all_pos"), F.sum("n").alias("all_neg"))
    return sums.join(F.broadcast(total)).select("threshold", F.try_divide(F.col("tp").cast("double"), "all_pos").alias("tpr"), F.try_divide(F.col("fp").cast("double"), "all_neg").alias("fpr"))


def roc_auc(df: DataFrame) -> DataFrame:
    """Share of (positive, negative) pairs in the right order, ties counting half."""
    by_score = df.groupBy("probability").agg(F.sum((F.col("label") == 1).cast("long")).alias("p"), F.sum((F.col("label") == 0).cast("long")).alias("n"))
    sums = running_sums(by_score, "probability", {"below": "n"}, descending=False)
    won = F.sum(F.col("p") * (F.col("below") - F.col("n") / 2.0))
    return sums.agg(F.try_divide(won, F.sum("p").cast("double") * F.sum("n")).alias("auc"))


def observation_days(windows: Column, step: int, rate: float) -> Column:
    return windows * F.lit(step / rate / DAY)


def _neighbour(df: DataFrame) -> DataFrame:
    """Adds what the window just before in record index has; an equi-join, so a long record stays spread out."""
    before = df.select((F.col("window") + 1).alias("window"), F.col("probability").alias("_p"), F.col("label").alias("_l"))
    return df.join(before, "window", "left")


def events(df: DataFrame, threshold: float) -> DataFrame:
    """Runs of positive windows, consecutive in record index, and whether any window of each alarms."""
    runs = islands(df.where("label = 1").select(F.lit(0).alias("series"), F.col("window").alias("idx")))
    inside = df.where("label = 1").select("window", "probability").join(
        runs.select("start", F.explode(F.sequence("start", "end")).alias("window")), "window"
    )
    return inside.groupBy("start").agg(F.max("window").alias("end"), F.max("probability").alias("best")).withColumn("detected", (F.col("best") >= threshold).cast("int"))


def false_alarm_episodes(df: DataFrame, threshold: float) -> DataFrame:
    """Runs of alarmed windows outside label runs: start, end, n."""
    alarmed = df.where((F.col("label") == 0) & (F.col("probability") >= threshold))
    return islands(alarmed.select(F.lit(0).alias("series"), F.col("window").alias("idx"))).drop("series")


def event_metrics(df: DataFrame, threshold: float, step: int, rate: float) -> DataFrame:
    found = events(df, threshold).agg(F.count("*").alias("n_events"), F.coalesce(F.sum("detected"), F.lit(0)).alias("n_detected"))
    alarms = false_alarm_episodes(df, threshold).agg(F.count("*").alias("episodes"))
    days = df.agg(observation_days(F.count("*"), step, rate).alias("days"))
    out = found.join(F.broadcast(alarms)).join(F.broadcast(days))
    return out.withColumn("event_recall", F.try_divide(F.col("n_detected").cast("double"), "n_events")).withColumn("false_alarms_per_30d", F.col("episodes") / F.col("days") * 30.0)


def candidates(df: DataFrame, count: int = 401, tail: int = 0) -> list[float]:
    """Thresholds: quantiles of the scores, and order statistics at log-spaced numbers of windows above."""
    n = df.count()
    at = [i / (count - 1) for i in range(count)]
    if tail and n > 1:
        ranks = {max(1, round(n ** (k / tail))) for k in range(tail)}
        at += [1 - (r - 1) / (n - 1) for r in sorted(ranks)]
    return sorted({r["q"] for r in order.quantiles(df, [], "probability", at).collect()})


def _above(values: DataFrame, thresholds: list[float], columns: list[str]) -> DataFrame:
    """For each threshold, the sums of columns over rows with v >= threshold; as many rows as thresholds."""
    spark = values.sparkSession
    marks = spark.createDataFrame([(t,) for t in thresholds], "v double").withColumns({c: F.lit(0) for c in columns}).withColumn("mark", F.lit(1))
    both = values.where("v IS NOT NULL").select("v", *columns, F.lit(0).alias("mark")).unionByName(marks)
    by_value = both.groupBy("v").agg(*(F.sum(c).alias(f"s_{c}") for c in columns), F.max("mark").alias("mark"))
    return running_sums(by_value, "v", {c: f"s_{c}" for c in columns}).where("mark = 1").select(F.col("v").alias("threshold"), *columns)


def threshold_sweep(df: DataFrame, thresholds: list[float], step: int, rate: float) -> DataFrame:
    """A row per candidate: events found, window recall and false-positive rate, episodes and their rate."""
    counts = ["tp", "fp", "joined", "found", "n"]
    one, none = F.lit(1), F.lit(0)
    pos, neg = (F.coalesce((F.col("label") == k).cast("int"), none) for k in (1, 0))
    own = F.struct(F.coalesce(F.col("probability"), F.lit(-1.0)).alias("v"), pos.alias("tp"), neg.alias("fp"), none.alias("joined"), none.alias("found"), one.alias("n"))
    pair = F.struct(F.least("probability", "_p").alias("v"), none.alias("tp"), none.alias("fp"), one.alias("joined"), none.alias("found"), none.alias("n"))
    both = (F.col("label") == 0) & (F.col("_l") == 0) & F.col("probability").isNotNull() & F.col("_p").isNotNull()
    rows = _neighbour(df).select(F.inline(F.when(both, F.array(own, pair)).otherwise(F.array(own))))
    peaks = events(df, 0.0).select(F.coalesce("best", F.lit(-1.0)).alias("v"), none.alias("tp"), none.alias("fp"), none.alias("joined"), one.alias("found"), none.alias("n"))
    sums = _above(rows.unionByName(peaks), [-2.0, *thresholds], counts)  # below every score: the totals
    total = sums.where("threshold = -2").select(F.col("tp").alias("all_pos"), F.col("fp").alias("all_neg"), F.col("found").alias("n_events"), F.col("n").alias("all"))
    out = sums.where("threshold > -2").drop("n").join(F.broadcast(total.withColumnRenamed("all", "n")))  # one row
    return out.select(
        "threshold", F.col("n_events").cast("long").alias("n_events"), F.try_divide(F.col("found").cast("double"), "n_events").alias("event_recall"), F.try_divide(F.col("tp").cast("double"), "all_pos").alias("window_recall"),
        F.try_divide(F.col("fp").cast("double"), "all_neg").alias("window_fpr"), (F.col("fp") - F.col("joined")).cast("long").alias("episodes"), ((F.col("fp") - F.col("joined")) / observation_days(F.col("n"), step, rate) * 30.0).alias("false_alarms_per_30d"),
    )


def select_threshold(sweep: DataFrame, criterion: str, target_far: float = 3.0, target_fpr: float = 0.05) -> DataFrame:
    """One row (threshold, criterion). far: from the top, the lowest candidate before the first that isn't admissible;
    fpr: the lowest with at most the target rate; youden: the greatest recall less false-positive rate. far without an
    admissible candidate, and youden without one of the classes, fall back to fpr."""
    low = F.col("window_fpr") <= target_fpr
    by_fpr = sweep.where(low).agg(F.min("threshold").alias("f"))
    if criterion == "far":
        ok = ((F.col("false_alarms_per_30d") <= target_far) & low).cast("int")
        down = Window.orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)  # a row per candidate
        best = sweep.withColumn("ok", F.min(ok).over(down)).where("ok = 1").agg(F.min("threshold").alias("t"))
    elif criterion == "youden":
        best = sweep.where("window_recall IS NOT NULL AND window_fpr IS NOT NULL").agg(F.max_by("threshold", F.struct(F.col("window_recall") - F.col("window_fpr"), -F.col("threshold"))).alias("t"))
    elif criterion == "fpr":
        best = by_fpr.select(F.col("f").alias("t"))
    else:
        raise ValueError(f"unknown criterion {criterion}")
    out = best.join(F.broadcast(by_fpr))
    return out.select(F.coalesce("t", "f").alias("threshold"), F.when(F.col("t").isNotNull(), F.lit(criterion)).otherwise(F.lit("fpr")).alias("criterion"))


def warn_fit_episodes(episodes: int, least: int = 10) -> float:
    """Relative error of a fitted rate in percent; warns when few episodes carry it."""
    error = 100 / math.sqrt(episodes) if episodes else math.inf
    if episodes < least:
        warnings.warn(f"the threshold rests on {episodes} false-alarm episodes: {error:.0f} % relative error", stacklevel=2)
    return error


def score_histogram(df: DataFrame, bins: int = 20) -> DataFrame:
    at = F.least(F.floor(F.col("probability") * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(at.alias("bin"), "label").agg(F.count("*").alias("n"))


def sensitivity_by_snr(df: DataFrame, threshold: float, width: float) -> DataFrame:
    at = F.floor(F.col("snr") / width).cast("int")
    return df.where("snr > 0").groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg((F.col("probability") >= threshold).cast("double")).alias("detected"))


def seed_summary(runs: DataFrame) -> DataFrame:
    """runs(config, seed, far, auc, events, n_events): finite runs only; medians, ranges and whether every run found all."""
    ok = runs.where(F.col("far").isNotNull() & ~F.isnan("far") & (F.abs("far") != float("inf")) & F.col("auc").isNotNull() & ~F.isnan("auc"))
    return ok.groupBy("config").agg(
        F.count("*").alias("runs"), F.percentile("far", F.lit(0.5)).alias("far_median"), F.min("far").alias("far_min"), F.max("far").alias("far_max"),
        F.percentile("auc", F.lit(0.5)).alias("auc_median"), F.min((F.col("events") == F.col("n_events")).cast("int")).alias("full_recall"), F.min("events").alias("events_min"), F.max("events").alias("events_max"),
    )


def best_run(runs: DataFrame) -> DataFrame:
    """Among runs with full recall: fewest validation episodes (within a Poisson error of the fewest), then AUC, then size."""
    full = runs.where("events = n_events")
    least = full.agg(F.min("episodes").alias("least"))
    tied = full.join(F.broadcast(least)).where(F.col("episodes") <= F.col("least") + F.sqrt("least"))
    return tied.orderBy(F.desc("auc"), "qubits", "params", "config").limit(1).drop("least")


def best_epoch(history: DataFrame) -> DataFrame:
    return history.agg(F.min_by("epoch", "val_loss").alias("epoch"), F.min("val_loss").alias("val_loss"))


def loss_survival(p: Column, stretch_batches: Column | int) -> Column:
    """Chance that a stretch of batches is complete when each is lost with probability p; its knee is at 1 / stretch."""
    return F.pow(F.lit(1.0) - p, stretch_batches if isinstance(stretch_batches, Column) else F.lit(float(stretch_batches)))


def gap_summary(missions: DataFrame, reference: str) -> DataFrame:
    """missions(mission, windows, events, n_events, far): windows as a fraction of the reference mission's."""
    odd = missions.where("windows < 0 OR events > n_events").limit(1).count()
    if odd:
        raise ValueError("a mission with fewer than no windows, or more events found than there are")
    ref = missions.where(F.col("mission") == reference).select(F.col("windows").alias("_w"))
    return missions.join(F.broadcast(ref)).select("mission", (F.col("windows") / F.col("_w")).alias("fraction"), "events", "n_events", F.when(F.col("windows") > 0, F.col("far")).otherwise(F.lit(None)).alias("far"))
