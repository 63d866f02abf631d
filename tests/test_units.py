"""Published values, closed forms and invariances."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.functions import spectral
from tidegauge.operators import conditioning, delivery, detector, evaluate, labels, models, scaler, simulate, train, windows
from tidegauge.operators.intervals import islands, running_sums
from tidegauge.plans import stages
from tidegauge.plans.config import Settings, load_config
from tidegauge.sources import records
from tidegauge.streaming import replay


def test_counts():
    assert windows.window_count(6000, 1000, 100) == 51
    assert windows.window_count(3000, 1000, 100) == 21
    assert windows.window_count(6_307_200, 1000, 100) == 63_063
    blocks = windows.calibration_split(600, 0.3, windows.buffer_windows(1000, 100))
    assert (blocks["calibration"].last, blocks["evaluation"].first, blocks["evaluation"].last) == (180, 191, 600)
    with pytest.raises(ValueError):
        windows.calibration_split(10, 0.05, 20)
    held = windows.threshold_rows(windows.chronological_split(62_863, 0.7, 0.15, 10), "held_out")
    assert len(held) == 18_849
    assert [models.parameter_count("logistic", 8), models.parameter_count("perceptron", 8, 6), models.parameter_count("perceptron", 8, 9), models.parameter_count("harmonic", 8)] == [9, 61, 91, 17]
    assert models.memory_estimate_gib("circuit", 4, 4, 64) == 2 * 16 * 2**4 * 8 / 2**30


def test_logistic_value(spark):
    m = models.Classifier("logistic", 2, (1.0, -2.0, 0.5))
    got = spark.createDataFrame([(math.pi / 2, math.pi / 4)], "a double, b double").select(models.probability(m, [F.col("a"), F.col("b")])).first()[0]
    assert got == pytest.approx(0.6224593312018546, abs=1e-12)


def test_bce(spark):
    df = spark.range(1).select(evaluate.weighted_bce(F.lit(0.5), F.lit(1.0)), evaluate.weighted_bce(F.lit(0.5), F.lit(0.0)), evaluate.weighted_bce(F.lit(0.5), F.lit(1.0), 3.0))
    assert list(df.first()) == pytest.approx([math.log(2), math.log(2), 3 * math.log(2)])


def test_match_scaler(spark):
    ref = spark.range(0, 101).select((F.col("id") / 10.0).alias("x"))
    got = scaler.match_scaler(scaler.FeatureScaler((0.0,), (10.0,)), ref, ref.select((F.col("x") * 2 + 3).alias("x")), ["x"])
    assert got.lower + got.upper == pytest.approx((3.0, 23.0))
    with pytest.raises(ValueError):
        scaler.fit_scaler(spark.range(5).select(F.lit(1.0).alias("x")), ["x"])


@pytest.mark.parametrize("n", [2, 3, 4])
def test_circuit_closed_form_and_gradient(spark, n):
    rng = np.random.default_rng(n)
    model = models.Classifier("circuit", n, tuple(rng.normal(size=2 * n)), 1)
    x = rng.uniform(0, math.pi, (5, n))
    circuit = models.Circuit(n, 1)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"x{k} double" for k in range(n)))
    closed = [r[0] for r in df.select(models.probability(model, [F.col(f"x{k}") for k in range(n)])).collect()]
    assert closed == pytest.approx(circuit.probability(x, models.circuit_params(model)).tolist(), abs=1e-12)
    deep, layers = models.Circuit(n, 3), 3
    params, weight = rng.normal(size=(layers, 2, n)), rng.normal(size=5)
    g = deep.gradient(x, params, weight)
    for at in np.ndindex(params.shape):
        up, down = params.copy(), params.copy()
        up[at] += 1e-5
        down[at] -= 1e-5
        assert g[at] == pytest.approx(weight @ (deep.probability(x, up) - deep.probability(x, down)) / 2e-5, abs=1e-7)


@pytest.mark.parametrize("kind,size", [("logistic", 0), ("perceptron", 3), ("harmonic", 0), ("circuit", 2)])
def test_gradient_is_finite_difference(kind, size):
    from dataclasses import replace

    rng = np.random.default_rng(1)
    model = models.build_classifier(kind, 3, size)
    x, y = rng.uniform(0, math.pi, (7, 3)), rng.integers(0, 2, 7).astype(float)
    _, g = train.gradient_arrays(model, x, y, 2.0)
    for k in range(len(g)):
        losses = []
        for d in (1e-5, -1e-5):
            p = list(model.params)
            p[k] += d
            losses.append(train.gradient_arrays(replace(model, params=tuple(p)), x, y, 2.0)[0])
        assert g[k] == pytest.approx((losses[0] - losses[1]) / 2e-5, abs=1e-6)


def test_circuit_gradient_ignores_partitions(spark):
    rng = np.random.default_rng(0)
    rows = [(i, *map(float, rng.uniform(0, 3, 2)), int(i % 3 == 0)) for i in range(50)]
    df = spark.createDataFrame(rows, "row_id long, a double, b double, label int")
    model = models.build_classifier("circuit", 2, 2)
    one, two = (train.circuit_gradient(df.repartition(k), ["a", "b"], model, chunk=8) for k in (1, 5))
    assert one.tolist() == two.tolist()


@pytest.mark.parametrize("block", [3, 1000])
def test_islands(spark, block):
    idx = [1, 2, 3, 5, 6, 9, 11, 12, 13, 14, 15, 16, 20]
    got = sorted((r["start"], r["end"]) for r in islands(spark.createDataFrame([(0, i) for i in idx], "series int, idx long"), block).collect())
    assert got == [(1, 3), (5, 6), (9, 9), (11, 16), (20, 20)]
    assert not islands(spark.createDataFrame([], "series int, idx long"), block).count()


def test_running_sums(spark):
    df = spark.createDataFrame([(k / 50, k) for k in range(51)], "p double, n long")
    got = {round(r["p"] * 50): r["s"] for r in running_sums(df, "p", {"s": "n"}, parts=7).collect()}
    assert got == {k: sum(range(k, 51)) for k in range(51)}


def test_far_scans_from_the_top(spark):
    sweep = spark.createDataFrame([(0.1, 0.0, 0.0), (0.2, 9.0, 0.0), (0.3, 1.0, 0.0), (0.4, 0.0, 0.0)], "threshold double, false_alarms_per_30d double, window_fpr double")
    assert evaluate.select_threshold(sweep, "far", 2.0, 0.5).first()["threshold"] == 0.3
    assert tuple(evaluate.select_threshold(sweep, "far", -1.0, 0.5).first()) == (0.1, "fpr")


def test_gap_splits_an_event(spark):
    df = spark.createDataFrame([(w, 0.9, 1) for w in range(1, 11)] + [(20, 0.1, 0)], "window long, probability double, label int")
    assert evaluate.event_metrics(df, 0.5, 100, 0.2).first()["n_events"] == 1
    assert evaluate.event_metrics(df.where("window <> 5"), 0.5, 100, 0.2).first()["n_events"] == 2


def test_whitening_has_unit_variance():
    n, rate = 20_000, 0.2
    f = np.fft.rfftfreq(n, 1 / rate)
    s = 1 + 100 * f
    x = spectral.synthesize_noise(s, n, rate, 0.0, 1)
    assert np.std(spectral.condition(x, rate, s, f)) == pytest.approx(1, abs=0.05)


def test_stream_equals_batch(spark, tmp_path):
    size, step, context, rows, per = 20, 5, 1, 400, 25
    rng = np.random.default_rng(2)
    feed = [(int(b), float(t)) for t, b in enumerate(rng.permutation(np.arange(1, 17))) if b != 9]
    for k in range(3):
        spark.createDataFrame(feed[k::3], "batch long, arrived_at double").coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k}"))
    stream = spark.readStream.schema("batch long, arrived_at double").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = replay.follow(stream, size=size, step=step, context=context, rows=rows, per_batch=per, group=16)
    out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    live = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    ids = spark.range(1, windows.window_count(rows, size, step) + 1).withColumnRenamed("id", "window")
    batch = delivery.completion(delivery.stretch_batches(ids, size, step, context, rows, per), spark.createDataFrame(feed, "batch long, arrived_at double"))
    assert live == sorted(map(tuple, batch.collect())) and live


def test_run_directory_source(spark, tmp_path):
    from tidegauge.shipping import ship
    from tidegauge.sources.run_directory import RunDirectory

    ship(spark)
    (tmp_path / "arrivals.jsonl").write_text("".join(json.dumps({"sim_time": k / 2, "batch": k, "event": "ingested"}) + "\n" for k in range(5)))
    spark.dataSource.register(RunDirectory)
    df = spark.read.format("run_directory").option("path", str(tmp_path)).option("linesPerPartition", 2).load()
    assert sorted(r["batch"] for r in df.collect()) == [0, 1, 2, 3, 4]


def test_stages(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(w, float(rng.normal() + 3 * (w % 60 < 6)), float(rng.normal()), int(w % 60 < 6)) for w in range(1, 601)]
    data = spark.createDataFrame(rows, "window long, a double, b double, label int")
    s = Settings(kind="logistic", epochs=5, rate=0.1, window_size=20, step_size=5, sample_rate=1.0, target_far_per_30d=1e5)
    run = stages.train_classifier(data, ["a", "b"], s, str(tmp_path), "run")
    again = stages.evaluate_classifier(data, run["run"], s, "test")
    assert again["tp"] == run["metrics"]["tp"] and again["auc"] > 0.8
    moved = data.select("window", (F.col("a") * 2 + 3).alias("a"), (F.col("b") * 0.5 - 1).alias("b"), "label")
    cal = stages.calibrate_classifier(moved, data, run["run"], s, str(tmp_path / "cal"))
    assert cal["noise_windows"] == sum(1 for w in range(1, 181) if w % 60 >= 6)
    model, scale, _ = records.load_model(f"{run['run']}/model.json")
    assert model == run["model"] and scale == run["scaler"]
    with pytest.raises(ValueError):
        stages.train_classifier(data.where("window <> 7"), ["a", "b"], s, str(tmp_path))
    with pytest.raises(ValueError):
        windows.restrict(data, {}, "nowhere")


def test_config(tmp_path):
    (tmp_path / "c.toml").write_text("[model]\nkind = 'harmonic'\nqubits = 4\n[training]\nrate = 1\n")
    assert load_config(str(tmp_path / "c.toml")).rate == 1.0
    (tmp_path / "d.toml").write_text("[model]\nkinds = 'x'\n")
    with pytest.raises(ValueError):
        load_config(str(tmp_path / "d.toml"))
    with pytest.raises(ValueError):
        Settings(kind="harmonic", hidden=3)


def test_peaks_over_block_borders(spark):
    for at in (999_998, 1_000_498):
        df = spark.createDataFrame([(at - 1, 1.0), (at, 5.0), (at + 1, 1.0), (at + 3, 9.0), (at + 4, 1.0), (at + 20, 6.0), (at + 21, 1.0)], "window long, snr double")
        assert sorted(map(tuple, labels.snr_peaks(df, 2.0, 12, 0.5).collect())) == [(at + 3, 9.0), (at + 20, 6.0)]
        assert sorted(map(tuple, labels.snr_peaks(df, 2.0, 12, 0.5, block=4).collect())) == [(at + 3, 9.0), (at + 20, 6.0)]
    assert labels.snr_peaks(spark.createDataFrame([], "window long, snr double"), 2.0, 12, 0.5).count() == 0


def test_coloured_noise(spark):
    knots = [(0.0, 4.0), (0.25, 4.0), (0.2500001, 1.0), (0.5, 1.0)]
    noise = [simulate.coloured_noise(spark, 40_000, 1.0, knots, seed=5, block=4096).repartition(k).orderBy("row").toPandas() for k in (1, 7)]
    assert noise[0].equals(noise[1]) and noise[0]["row"].tolist() == list(range(1, 40_001))
    p = np.abs(np.fft.rfft(noise[0]["value"])) ** 2 * 2 / 40_000
    assert p[100:9000].mean() == pytest.approx(4.0, rel=0.05) and p[11_000:19_000].mean() == pytest.approx(1.0, rel=0.05)


def test_antenna_average(spark):
    rng = np.random.default_rng(1)
    rows = [(float(a), float(b), float(c), float(d)) for a, b, c, d in zip(rng.uniform(0, 2 * np.pi, 20_000), np.arcsin(rng.uniform(-1, 1, 20_000)), rng.uniform(0, np.pi, 20_000), rng.uniform(0, 3e7, 20_000))]
    plus, cross = simulate.antenna(F.col("t"), F.col("lon"), F.col("lat"), F.col("psi"))
    assert spark.createDataFrame(rows, "lon double, lat double, psi double, t double").select(F.avg(plus * plus + cross * cross)).first()[0] == pytest.approx(0.3, rel=0.03)


def test_detector_and_conditioning(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal(400)
    record = spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(x) if not 150 <= i < 160], "row long, value double")
    covered = spark.createDataFrame([(1, 150), (161, 400)], "start long, end long")
    ids = spark.range(1, windows.window_count(400, 40, 10) + 1).withColumnRenamed("id", "window")
    clips = conditioning.contiguous_clips(ids, covered, 40, 10, 2, 400, bin_rows=64)
    rows = {r["window"]: (r["first"], r["last"]) for r in clips.collect()}
    assert rows[12] == (31, 150) and 13 not in rows and 16 not in rows and rows[17] == (161, 280)
    got = {r["window"]: np.array(r["x"]) for r in conditioning.condition_windows(record, clips, 40, 10, 1.0, None, 0.05, 4, bin_rows=64).collect()}
    for w, (a, b) in rows.items():
        at = (w - 1) * 10 + 1 - a
        assert np.allclose(got[w], spectral.condition(x[a - 1 : b], 1.0, cutoff=0.05, order=4)[at : at + 40])
    model, scale = models.build_classifier("circuit", 4, 2, seed=1), scaler.FeatureScaler((0.0,) * 4, (1.0,) * 4)
    with pytest.raises(ValueError):
        detector.StreamingDetector(model, scale, 0.5, 40, 50, 1.0)
    with pytest.raises(ValueError):
        detector.StreamingDetector(model, None, 0.5, 40, 10, 1.0)
    found = detector.StreamingDetector(model, scale, 0.5, 40, 10, 1.0, cutoff=0.05, order=4).detect(record, covered, ids, 400).collect()
    one = detector.ClassifierScorer(model, scale)
    assert {r["window"] for r in found} == set(rows) and all(r["probability"] == pytest.approx(one.window_score(got[r["window"]])) for r in found)
    assert conditioning.edge_rows(8, 0.2, 0.0005) == 3200 and conditioning.edge_rows(8, 0.2, 0) == 0
    assert conditioning.density_from_sidecar({"psd": "none"}) is None and conditioning.density_from_sidecar({"psd": "welch", "frequencies": [0, 1], "values": [2, 3]}) == [(0.0, 2.0), (1.0, 3.0)]
    for odd in ({}, {"psd": "welch"}, {"psd": "x"}):
        with pytest.raises(ValueError):
            conditioning.density_from_sidecar(odd)


def test_limits_and_channels(spark, tmp_path):
    assert models.check_memory("circuit", 4, 4, 64) < 0.01 and train.gradient_tasks(1000) == 4
    with pytest.raises(MemoryError):
        models.check_memory("circuit", 30, 4, 64)
    assert records.check_channels({}, {"channels": "A"}) == "A"
    with pytest.raises(ValueError):
        records.check_channels({"channels": "AE"}, {})
    with pytest.raises(ValueError):
        stages.outside(str(tmp_path / "run" / "out"), str(tmp_path / "run"))
    (tmp_path / "own.toml").write_text('[paths]\ninputs = "x"\n[model]\nn_qubits = 5\nkind = "perceptron"\n[training]\nlearning_rate = 1\nscaler_quantiles = [0.1, 0.9]\nphase_span = 0.5\nclass_weight = "balanced"\n[calibration]\nscaler = "keep"\n[telemetry]\nbatch_size = 10\n')
    s = load_config(str(tmp_path / "own.toml"))
    assert (s.qubits, s.units, s.rate, s.low_quantile, s.span, s.class_weight, s.scaler_rule, s.decay, s.patience) == (5, 6, 1.0, 0.1, np.pi / 2, "auto", "keep", 0.95, 12)


def test_replay_and_label_outputs(spark, tmp_path):
    s = Settings(window_size=20, step_size=5, sample_rate=1.0, persistence=2, context_windows=1)
    scored = spark.createDataFrame([(w, 0.9 if 20 <= w <= 26 else 0.1, int(20 <= w <= 26)) for w in range(1, 60)], "window long, probability double, label int").withColumn("decision", (F.col("probability") > 0.5).cast("int"))
    arrivals = spark.createDataFrame([(b, b * 60) for b in range(1, 14) if b != 9], "batch long, s long").select("batch", F.timestamp_seconds("s").alias("arrived_at"))
    events = spark.createDataFrame([(1, 110.0, 90, 150, 95)], "event int, merger_time_s double, label_start_index long, label_end_index long, signal_start_index long")
    out = str(tmp_path / "out")
    found = stages.replay_classifier(scored, arrivals, events, None, s, 320, 25, F.lit("1970-01-01").cast("timestamp"), out, str(tmp_path / "run"), ingested_rows=300)
    assert found["latency"].first()["detected"] == 1 and spark.read.csv(f"{out}/telemetry_windows", header=True).count() == found["windows"].count() < 57
    assert spark.read.csv(f"{out}/alert_latency", header=True).count() == 1
    strength = spark.createDataFrame([(w, 9.0 - abs(w - 30)) for w in range(1, 60)], "window long, snr double")
    made = stages.label_truth_stream(strength, None, s, 600, str(tmp_path / "labels"), before_s=50, after_s=20, separation_s=100)
    assert made["n_label_runs"] == 1 and made["events"].count() == 1 and 0 < made["positive_fraction"] < 0.2


def test_waveform_grids_are_dealt_out(spark, data):
    """A small file of sources is no single task, and columns of the source give the delays of the plain operator."""
    from tidegauge import mission_queries

    for query in (mission_queries.waveform_arrival, mission_queries.waveform_amplitude):
        sizes = [r["count"] for r in query(spark, data).groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) >= 4 and max(sizes) * 2 < sum(sizes)
    f, mass, eta = F.col("f"), F.col("mass"), F.col("eta")
    rows = spark.createDataFrame([(k / 8, 10.0**m, e) for k in range(1, 10) for m in (5, 6, 7) for e in (0.25, 0.1)], "part double, mass double, eta double")
    rows = rows.withColumns({"factors": simulate.delay_factors(eta), "ring": simulate.transitions(mass, eta)["ring"]}).withColumn("f", F.col("ring") * F.col("part")).withColumn("at_ring", simulate.group_delay(F.col("ring"), mass, eta))
    pairs = [(simulate.group_delay(f, mass, eta), simulate.group_delay(f, mass, eta, F.col("factors"))), (simulate.arrival_delay(f, mass, eta), simulate.delay_before(f, mass, eta, F.col("ring"), F.col("at_ring"), F.col("factors")))]
    got = rows.select(*(c.alias(f"c{i}{j}") for i, pair in enumerate(pairs) for j, c in enumerate(pair))).collect()
    assert all(r[0] == r[1] != 0 and r[2] == r[3] for r in got)
