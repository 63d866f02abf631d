"""Scorers, trailing estimates, payloads and signal placement."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.functions import spectral
from tidegauge.operators import detector, models, scaler, windows


@pytest.fixture(scope="module")
def record(spark):
    x = np.random.default_rng(0).normal(size=400)
    return x, spark.createDataFrame([(0, i + 1, float(v)) for i, v in enumerate(x)], "run long, row long, value double")


def test_scorer_is_the_direct_value(spark, record):
    x, df = record
    scorer = detector.ClassifierScorer(models.build_classifier("circuit", 4, 2), scaler.FeatureScaler((0.0, -2.0, -2.0, -2.0), (1.0, 2.0, 2.0, 2.0)))
    got = dict(map(tuple, detector.score_windows(windows.sliding(df.select("row", "value"), 40, 20, 400).repartition(5), scorer).collect()))
    assert got == {w + 1: pytest.approx(scorer.window_score(x[20 * w : 20 * w + 40])) for w in range(19)}


def test_stateful_scorer_sees_order_and_gaps(spark):
    class Count:
        stateful = True

        def reset(self):
            self.n, self.gaps = 0, 0

        def gap(self, first, last):
            self.gaps += last - first + 1

        def window_score(self, samples):
            self.n += 1
            return float(self.n + 100 * self.gaps)

    df = spark.createDataFrame([(s, w, 1, 0.0) for s in (0, 1) for w in (3, 1, 2, 6)], "series long, window long, row long, value double")
    got = sorted(map(tuple, detector.score_in_order(df, Count()).collect()))
    assert got == [(s, w, v) for s in (0, 1) for w, v in ((1, 1.0), (2, 2.0), (3, 3.0), (6, 204.0))]
    with pytest.raises(ValueError):
        detector.score_windows(df, Count())


def test_trailing_welch(spark, record):
    x, df = record
    got = detector.trailing_welch(df, 20, 1.0, 100, 50)
    have = {(r["psd_row"], r["bin"]): r["psd"] for r in got.collect()}
    part = x[199:299]  # rows 200 to 299 stand behind the refresh at 300
    p = np.stack([spectral.tapered_periodogram(part[a : a + 20]) for a in range(0, 81, 10)])
    assert [have[300, b] for b in range(11)] == pytest.approx((np.median(p, 0) * 2 / np.log(2)).tolist())
    w = spark.createDataFrame([(1, 1), (2, 60), (3, 399)], "window long, row_start long")
    assert {r["window"]: r["psd_row"] for r in detector.epoch_in_force(w, got, 50).collect()} == {1: None, 2: 50, 3: 350}


def test_payload_and_placement(spark, record):
    _, df = record
    events = spark.createDataFrame([(1, 5, 50)], "event int, label_start_index long, label_end_index long")
    out = detector.export_payload(df.select("row", F.col("value").alias("A")), 50, 400, events)
    assert out.columns == ["batch", "row", "Amplitude"] and out.agg(F.max("batch")).first()[0] == 8
    for bad in ((30, events), (50, events.withColumn("label_end_index", F.lit(500)))):
        with pytest.raises(ValueError):
            detector.export_payload(df.withColumn("A", F.col("value")), bad[0], 400, bad[1])
    flat = spark.range(1, 6).select(F.col("id").alias("row"), F.lit(0.0).alias("value"))
    signal = spark.createDataFrame([(0, 1.0), (1, -3.0), (2, 2.0)], "k long, value double")
    placed = detector.place_signal(flat, detector.scale_to_snr(signal, 1.0, 2.0), 5)
    assert [r["value"] for r in placed.orderBy("row").collect()] == [0, 0, 0, 2.0, -6.0]
