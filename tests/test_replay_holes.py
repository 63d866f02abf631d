"""Replays with holes, in batch and live, against an event-by-event simulation; ordered commit; replay from samples."""

import json
import math
from datetime import datetime, timedelta
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidegauge.functions import spectral
from tidegauge.operators import delivery, holes, models, replay, scaler
from tidegauge.plans import stages
from tidegauge.plans.config import Settings
from tidegauge.sources import records
from tidegauge.streaming import holes as live

SIZE, STEP, CONTEXT, PER = 20, 5, 1, 25
START = datetime(2035, 1, 1)
HOLES = "row_start long, row_end long, declared_at timestamp, cause string"


def at(minutes):
    return START + timedelta(minutes=minutes)


def random_feed(seed, batches=12):
    draw = np.random.default_rng(seed)
    arrivals = [(int(b), int(t)) for t, b in enumerate(draw.permutation(np.arange(1, batches + 1))) if b != 4]
    arrivals[3] = (arrivals[3][0], arrivals[2][1])  # two of one instant
    found = []
    for cause in ("lost", "scheduled", "recorder", "stream"):
        a = int(draw.integers(1, batches * PER - 4))
        found.append((a, a + int(draw.integers(0, 9)), int(draw.integers(0, batches)), cause))
    return arrivals, [*found, (found[0][0], found[0][0], found[0][2], "recorder")]  # a second hole of one instant


def simulated(arrivals, gaps, rows, coverage):
    """window -> (complete minute, batch, coverage) or (dead minute, cause)."""
    events = [(t, 0, holes.CAUSES.index(c), a, b, c) for a, b, t, c in gaps] + [(t, 1, b, (b - 1) * PER + 1, b * PER, None) for b, t in arrivals]
    alive, taken, out = np.zeros(rows + 2, bool), np.zeros(rows + 2, bool), {}
    for t, kind, rank, a, b, cause in sorted(events, key=lambda e: e[:3]):
        b = min(b, rows)
        if kind == 1:
            alive[a : b + 1] = ~taken[a : b + 1]
        else:
            taken[a : b + 1], alive[a : b + 1] = True, False
        for w in range(1, (rows - SIZE) // STEP + 2):
            f, l = (w - 1) * STEP + 1, (w - 1) * STEP + SIZE
            x, y = max(1, f - CONTEXT * SIZE), min(rows, l + CONTEXT * SIZE)
            need = math.ceil(round((y - x + 1) * coverage, 6))
            if w in out or b < x or a > y:
                continue
            if kind == 1 and alive[f : l + 1].all() and alive[x : y + 1].sum() >= need:
                out[w] = (at(t), rank, alive[x : y + 1].sum() / (y - x + 1), None, None)
            if kind == 0 and (taken[f : l + 1].any() or taken[x : y + 1].sum() > y - x + 1 - need):
                out[w] = (None, None, None, at(t), cause)
    return out


def tables(spark, arrivals, gaps):
    return spark.createDataFrame([(b, at(t)) for b, t in arrivals], "batch long, arrived_at timestamp"), spark.createDataFrame([(a, b, at(t), c) for a, b, t, c in gaps], HOLES)


def ids(spark, rows):
    return spark.range(1, (rows - SIZE) // STEP + 2).withColumnRenamed("id", "window")


def feed_of(arrivals, gaps):
    rows = [("arrival", at(t), b, None, None, None) for b, t in arrivals] + [("hole", at(t), None, a, b, c) for a, b, t, c in gaps]
    return [*rows, ("final", at(100_000), None, None, None, None)]


@pytest.mark.parametrize("coverage", [1.0, 0.75, 0.5])
def test_holes_against_simulation(spark, coverage):
    for seed in (1, 2):
        arrivals, gaps = random_feed(seed)
        wanted = simulated(arrivals, gaps, 300, coverage)
        got = holes.settle(ids(spark, 300), *tables(spark, arrivals, gaps), SIZE, STEP, CONTEXT, 300, PER, coverage).collect()
        assert {r[0]: tuple(r)[1:] for r in got if r["complete_at"] or r["dead_at"]} == {w: tuple(None if v is None else v for v in x) for w, x in wanted.items()}
        assert len(got) == 57 and len({x[4] for x in wanted.values()}) > 1


def test_a_hole_takes_the_windows_it_touches(spark):
    rows = 295
    arrivals = [(b, b) for b in range(1, 13)]
    got = holes.settle(ids(spark, rows), *tables(spark, arrivals, [(150, 151, 0, "lost")]), SIZE, STEP, 2, rows, PER, 0.5).collect()
    assert len(got) == 56 and {r["window"] for r in got if r["complete_at"] is None} == {w for w in range(1, 57) if (w - 1) * STEP + 1 <= 151 and (w - 1) * STEP + SIZE >= 150}
    none = holes.settle(ids(spark, rows), *tables(spark, arrivals, []), SIZE, STEP, 2, rows, PER, 0.5)
    assert none.where("complete_at IS NULL").count() == 0
    plain = delivery.completion_partial(delivery.stretch_batches(ids(spark, rows), SIZE, STEP, 2, rows, PER), tables(spark, arrivals, [])[0], 0.5)
    assert sorted(map(tuple, none.select("window", "complete_at").collect())) == sorted(map(tuple, plain.collect()))


def test_live_in_any_order(spark):
    arrivals, gaps = random_feed(3)
    wanted = simulated(arrivals, gaps, 300, 0.6)
    feed = feed_of(arrivals, gaps)
    for seed in range(3):
        mixed = [feed[k] for k in np.random.default_rng(seed).permutation(len(feed))]
        got = live.follow_holes_once(spark.createDataFrame(mixed, live.FEED), 2, size=SIZE, step=STEP, context=CONTEXT, rows=300, per_batch=PER, min_coverage=0.6, delay="30 days", group=16).collect()
        assert {r[0]: tuple(r)[1:] for r in got} == wanted and len(got) == len(wanted)


def test_live_events_behind_the_final_word(spark, tmp_path):
    """The final word in the first file and all else in the second: each group still emits its windows, in that micro-batch."""
    arrivals, gaps = random_feed(3)
    *feed, final = feed_of(arrivals, gaps)
    for k, rows in enumerate(([final], feed)):
        spark.createDataFrame(rows, live.FEED).coalesce(1).write.parquet(f"{tmp_path}/in/f{k}")
    stream = spark.readStream.schema(live.FEED).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    made = live.follow_holes(stream, size=SIZE, step=STEP, context=CONTEXT, rows=300, per_batch=PER, min_coverage=0.6, delay="30 days", group=16)
    live.run_available(spark, made.writeStream.format("parquet").option("path", f"{tmp_path}/out"), f"{tmp_path}/state")
    got = spark.read.schema(live.SETTLED).parquet(f"{tmp_path}/out").collect()
    assert {r[0]: tuple(r)[1:] for r in got} == simulated(arrivals, gaps, 300, 0.6) and len(got) > 0


class Looks:
    """A handle that counts what goes between a processor and Spark, an element of a list state as one."""

    def __init__(self):
        self.n, self.value = 0, None

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def get(self):
        self.n += 1
        return self.value

    def update(self, value):
        self.n, self.value = self.n + 1, value

    def registerTimer(self, at):  # noqa: N802
        self.n += 1

    def deleteTimer(self, at):  # noqa: N802
        self.n += 1


def test_a_group_looks_at_its_state_once(spark):
    """However many events a group has, a micro-batch costs it one look, one update and its timer, and an event tries only the windows it meets."""
    rows, events = 5000, [(b, b) for b in range(1, 201)]
    handle, tried = Looks(), []
    made = live.HoleProcessor(SIZE, STEP, CONTEXT, rows, 1.0, 1000)
    made.init(handle)
    made.settled = lambda w, *rest: tried.append(w) or live.HoleProcessor.settled(made, w, *rest)
    micros = lambda t: t * 60_000_000
    fed = [Row(instant=micros(t), way=1, rank=b, a=(b - 1) * PER + 1, b=b * PER, cause=None) for b, t in events]
    for part in (fed[100:], fed[:100]):
        assert list(made.handleInputRows((0,), iter(part), None)) == []
    assert handle.n == 3 + 4  # the second part has the earlier timer
    clock = SimpleNamespace(getCurrentWatermarkInMs=lambda: 1_000_000_000)
    out = list(made.handleExpiredTimer((0,), clock, None))
    assert handle.n == 9 and handle.value[0] == [] and handle.value[11] == []
    assert {r["window"]: r["completing_batch"] for r in out} == {w: (min(rows, (w - 1) * STEP + SIZE * (1 + CONTEXT)) - 1) // PER + 1 for w in range(1, 998)}
    assert len(tried) <= len(events) * 18


def test_no_file_of_a_stream_holds_the_feed(spark, tmp_path):
    rows = [("arrival", at(t), t, None, None, None) for t in range(400)]
    stream, sizes = live._stream(spark.createDataFrame(rows, live.FEED), 2, str(tmp_path)), []
    stream.writeStream.foreachBatch(lambda part, version: sizes.append(part.count())).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    files = [r["count"] for r in spark.read.parquet(str(tmp_path / "in")).groupBy(F.input_file_name()).count().collect()]
    assert len(files) == 8 and max(files) <= 100 and len(sizes) == 2 and sum(sizes) == 400


def commit_in_steps(spark, folder, feed, policy="skip", horizon=180.0):
    """A feed in order of time, a file each few events, in two runs of the stream with one checkpoint."""
    feed = sorted(feed, key=lambda r: r[1])
    cut = [feed[k : k + 5] for k in range(0, len(feed), 5)]
    commit = live.Commit(spark, f"{folder}/commit", 57, horizon, policy, block=7)
    for part in (cut[:2], cut[2:]):
        for rows in part:
            k = cut.index(rows)
            spark.createDataFrame(rows, live.FEED).coalesce(1).write.parquet(f"{folder}/in/f{k:03d}")
        stream = spark.readStream.schema(live.FEED).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        made = live.follow_holes(stream, size=SIZE, step=STEP, context=CONTEXT, rows=300, per_batch=PER, min_coverage=0.6, delay="30 seconds", group=16)
        live.run_available(spark, made.writeStream.foreachBatch(commit.take), f"{folder}/state")
    commit.finish(at(90_000))
    return commit


def test_ordered_commit(spark, tmp_path):
    arrivals, gaps = random_feed(5)
    settled = holes.settle(ids(spark, 300), *tables(spark, arrivals, gaps), SIZE, STEP, CONTEXT, 300, PER, 0.6).persist()
    end, horizon = F.lit(at(90_000)), 180.0
    got = {r["window"]: r for r in holes.ordered_commit(settled, end, horizon, block=10).collect()}
    known = {r["window"]: r for r in settled.collect()}
    latest = START
    for w in range(1, 58):
        later = min((known[v]["complete_at"] for v in range(w + 1, 58) if known[v]["complete_at"]), default=None)
        own, limit = known[w]["complete_at"] or known[w]["dead_at"], later and later + timedelta(seconds=horizon)
        ends = min(limit or at(90_000), at(90_000))
        fine = own is not None and own <= ends
        state = "scored" if fine and known[w]["complete_at"] else "late" if known[w]["complete_at"] else "gap"
        cause = known[w]["cause"] if fine else "horizon" if limit else "undelivered"
        latest = max(latest, own if fine else ends)
        assert (got[w]["state"], got[w]["settled_at"], got[w]["cause"], got[w]["release_at"]) == (state, own if fine else ends, cause, latest if state == "scored" else None)
    assert {r["state"] for r in got.values()} == {"scored", "gap", "late"} and {"horizon"} < {r["cause"] for r in got.values()}
    with pytest.raises(ValueError, match="beyond the horizon"):
        holes.ordered_commit(settled, end, horizon, "refuse")
    with pytest.raises(ValueError, match="unknown late policy"):
        holes.ordered_commit(settled, end, horizon, "wait")
    gaps_found = holes.gap_table(holes.ordered_commit(settled, end, horizon), block=10).collect()
    assert sum(r["n"] for r in gaps_found) == sum(r["state"] != "scored" for r in got.values())

    commit = commit_in_steps(spark, str(tmp_path / "skip"), feed_of(arrivals, gaps))
    assert spark.read.parquet(str(tmp_path / "skip" / "commit" / "border")).count() > 4  # versions: the border was handed on
    live_rows = {r["window"]: r for r in commit.only().collect()}
    assert {w: (r["state"], r["settled_at"], r["cause"], r["release_at"]) for w, r in live_rows.items()} == {w: (r["state"], r["settled_at"], r["cause"], r["release_at"]) for w, r in got.items()}
    strict = live.Commit(spark, str(tmp_path / "refuse"), 4, horizon, "refuse")
    done = lambda w, m: spark.createDataFrame([(w, at(m), 1, 1.0, None, None)], live.SETTLED)
    strict.take(done(2, 0).unionByName(done(3, 9)), 0)  # window 1 is given up at minute 3
    strict.take(done(4, 10), 1)
    with pytest.raises(ValueError, match="window 1 completes beyond the horizon"):
        strict.take(done(1, 11), 2)


SIDECAR = {
    "sample_rate": 0.2, "window_size": SIZE, "step_size": STEP, "highpass_cutoff_hz": 0.002, "highpass_order": 4, "low_band_hz": [0.01, 0.04], "high_band_hz": [0.04, 0.1], "band_edges_hz": [0.01, 0.04, 0.1],
    "feature_set": "whitened", "channels": "A", "psd": "model",
}


def run_folder(path, sidecar=SIDECAR):
    model = models.Classifier("logistic", 4, (0.9, 0.6, -0.8, 0.7, -0.4))
    records.save_model(f"{path}/model.json", model, scaler.FeatureScaler((0.0, 0.0, 0.0, -1.0), (3.0, 3.0, 1.0, 1.0)), {"columns": ["p_low", "p_high", "spectral_entropy", "log_power_std"], "channels": "A"})
    records.write_json(f"{path}/threshold.json", {"value": 0.42})
    records.write_json(f"{path}/split.json", {})
    if sidecar is not None:
        records.write_json(f"{path}/features.json", sidecar)
    return str(path)


def test_detector_from_run(spark, tmp_path):
    d = stages.detector_from_run(spark, run_folder(tmp_path / "run"), context=1)
    assert (d.threshold, d.size, d.context, d.order, d.features.low_band) == (0.42, SIZE, 1, 4, (0.01, 0.04)) and len(d.knots) == 30
    (tmp_path / "other.json").write_text(json.dumps(SIDECAR | {"psd": "none"}))
    assert stages.detector_from_run(spark, str(tmp_path / "run"), str(tmp_path / "other.json")).knots is None
    (tmp_path / "two.json").write_text(json.dumps(SIDECAR | {"channels": "AE"}))
    for bad in (tmp_path / "absent.json", tmp_path / "two.json"):
        with pytest.raises(ValueError):
            stages.detector_from_run(spark, str(tmp_path / "run"), str(bad))
    for k, lacks in enumerate(("highpass_order", "band_edges_hz", "psd", None)):
        with pytest.raises(ValueError):
            stages.detector_from_run(spark, run_folder(tmp_path / f"bad{k}", {a: b for a, b in SIDECAR.items() if a != lacks} if lacks else None))


def features_of(x, rate=0.2):
    p = spectral.tapered_periodogram(x)
    f = np.arange(len(p)) * rate / len(x)
    low, high = p[(f >= 0.01) & (f <= 0.04)], p[(f > 0.04) & (f <= 0.1)]
    both = np.concatenate([low, high])
    share = both / both.sum()
    return low.mean(), high.mean(), -(share * np.log(share)).sum() / np.log(len(both)), np.log10(both.std(ddof=1))


def scored(x):
    low, high = np.array([0, 0, 0, -1.0]), np.array([3, 3, 1, 1.0])
    z = (np.clip(features_of(x), low, high) - low) / (high - low)
    return 1 / (1 + np.exp(-(z @ np.array([0.9, 0.6, -0.8, 0.7]) - 0.4)))


@pytest.mark.parametrize("mode", ["sidecar", "trailing"])
def test_replay_from_samples(spark, tmp_path, mode):
    x = np.random.default_rng(8).normal(size=300)
    x[140:180] *= 6
    arrivals, gaps = [(b, 10 * b) for b in range(1, 13) if b != 11], [(60, 61, 5, "lost")]
    record = spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(x)], "row long, value double")
    s = Settings(min_coverage=0.75, persistence=2, psd_mode=mode, psd_segment=16, psd_trailing_days=50 / 17_280, psd_refresh_days=50 / 17_280, psd_edge_periods=0.0, gap_dilation_s=5.0)
    d = stages.detector_from_run(spark, run_folder(tmp_path / "run"), context=1)
    d = replay.RunDetector(**{**d.__dict__, "knots": tuple((k / 100, 2.0 + k) for k in range(11))})
    came, gone = tables(spark, arrivals, gaps)
    events = spark.createDataFrame([(1, 700.0, 120, 190, 200, 130)], "event int, merger_time_s double, label_start_index long, label_end_index long, signal_start_index_ae long, signal_start_index long")
    out = str(tmp_path / "out")
    found = stages.replay_record(record, came, events, gone, d, s, 300, PER, F.lit(START), out, str(tmp_path / "run"), ordered=True, end_at=F.lit(at(5000)))
    rows = {r["window"]: r for r in found["windows"].collect()}
    known = simulated(arrivals, [(59, 62, 5, "lost")], 300, 0.75)
    assert set(rows) == {w for w, v in known.items() if v[0]} and 0 < len(rows) < 57
    epochs = {}
    for w, r in rows.items():
        first, last = r["stretch_first"], r["stretch_last"]
        assert not first <= 60 <= last and r["complete_at"] == known[w][0] and r["release_at"] >= r["complete_at"] and r["scored_at"] == r["release_at"]
        epochs.setdefault((first - 1) // 50, []).append((w, first, last))
    held = None
    for k in sorted(epochs):
        if mode == "trailing":
            when = min(rows[w]["complete_at"] for w, _, _ in epochs[k])
            there = [i for i in range(max(1, 50 * k - 49), 50 * k + 1) if not 59 <= i <= 62 and any(b == (i - 1) // PER + 1 and at(t) <= when for b, t in arrivals)]
            runs = np.split(np.array(there, int), np.flatnonzero(np.diff(there) > 1) + 1) if there else []
            cuts = [x[run[0] - 1 + a : run[0] - 1 + a + 16] for run in runs for a in range(0, len(run) - 15, 8)]
            if cuts:
                held = (50 * k, np.median([spectral.tapered_periodogram(c) for c in cuts], 0) * 2 / 0.2 / np.log(2), np.arange(9) * 0.2 / 16)
        for w, first, last in epochs[k]:
            psd_row, density, f = held or (0, np.array([v for _, v in d.knots]), np.array([v for v, _ in d.knots]))
            done = spectral.condition(x[first - 1 : last], 0.2, density, f, 0.002, 4)
            a = (w - 1) * STEP + 1 - first
            assert rows[w]["psd_row"] == psd_row and rows[w]["probability"] == pytest.approx(scored(done[a : a + SIZE]), abs=1e-9)
    gaps_found = {(r["start"], r["end"]): r["cause"] for r in found["gaps"].collect()}
    assert "lost" in gaps_found.values() and "undelivered" in gaps_found.values()
    written = [int(r["window"]) for r in spark.read.csv(f"{out}/telemetry_windows", header=True).collect()]
    assert written == sorted(rows) and found["latency"].count() == 1
    with pytest.raises(ValueError):
        stages.replay_record(record.withColumn("channel", F.lit("A")), came, events, gone, d, s, 300, PER, F.lit(START))


def test_two_channels(spark):
    x = np.random.default_rng(9).normal(size=(2, 40))
    arrays = spark.createDataFrame([(1, "AE"[k], x[k].tolist()) for k in range(2)], "window long, channel string, x array<double>")
    each = np.array([features_of(v) for v in x])
    spec = dict(low_band=(0.01, 0.04), high_band=(0.04, 0.1), edges=(0.01, 0.04, 0.1))
    got = replay.FeatureMap("whitened", **spec).of_arrays(arrays, 0.2, 40).first()
    assert got["p_low"] == pytest.approx(each[:, 0].max()) and got["spectral_entropy"] == pytest.approx(each[:, 2].min())
    mean = replay.FeatureMap("bands", **spec, combination="mean").of_arrays(arrays, 0.2, 40).first()
    p = np.mean([spectral.tapered_periodogram(v) for v in x], 0)
    f = np.arange(21) * 0.2 / 40
    assert mean["band_1"] == pytest.approx(p[(f >= 0.01) & (f <= 0.04)].mean()) and mean["window"] == 1
    assert replay.FeatureMap("paper").of_arrays(arrays.where("channel = 'A'").drop("channel"), 0.2, 40).columns == ["window", "spectral_entropy", "log_mean", "log_std", "log_max"]
