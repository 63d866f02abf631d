"""Further queries over the driver's tables: simulated sources, geometry, clips, strength, outputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.functions import psd
from tidegauge.operators import alerts, conditioning, delivery, simulate, windows
from tidegauge.operators.simulate import PHASE, SUN, TRANSITIONS
from tidegauge.plans import stages
from tidegauge.queries import ARR, EV, LIVE, MERGERS, PER_BATCH, RATE, SCORED, SIZE, STEP, _table, arrivals, known_events, n_rows, query, record, rounded, scored
from tidegauge.sources import records

# --- sources: a binary for each part, its mass from the key and its ratio from the size ----------------------------

BINARY = "src AS (SELECT p_partkey AS key, pow(10, 5 + p_partkey % 100 / 50.0) AS mass, p_size::DOUBLE AS q, p_size / pow(1.0 + p_size, 2) AS eta FROM part)"


def _quadratic(c) -> str:
    return f"({c[0]!r} * eta * eta + {c[1]!r} * eta + {c[2]!r})"


SOURCES = f"{BINARY}, tr AS (SELECT *, " + ", ".join(f"{_quadratic(c)} / (pi() * {SUN!r} * mass) AS {k}" for k, c in (("fm", TRANSITIONS["merge"]), ("fr", TRANSITIONS["ring"]), ("fw", TRANSITIONS["width"]), ("fc", TRANSITIONS["cut"]))) + " FROM src)"
GRID = SOURCES + ", grid AS (SELECT tr.*, k::INT AS k, fr * (k - 0.5) / 8.0 AS f FROM tr, range(1, 13) t(k))"


def _sources(spark, sf_dir):
    key = F.col("p_partkey")
    rows = _table(spark, sf_dir, "part").select(key.alias("key"), F.pow(F.lit(10.0), 5 + key % 100 / 50.0).alias("mass"), F.col("p_size").cast("double").alias("q"))
    return rows.withColumn("eta", simulate.mass_ratio_eta(F.col("q")))


def _grid(spark, sf_dir, **of_source):
    """Twelve frequencies for each source, beside columns of the source. A file of sources is small and read by few tasks, or by one, so sources are dealt out first."""
    dealt = _sources(spark, sf_dir).repartition(4 * spark.sparkContext.defaultParallelism, "key").withColumn("ring", simulate.transitions(F.col("mass"), F.col("eta"))["ring"])
    for name, c in of_source.items():
        dealt = dealt.withColumn(name, c)
    return dealt.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(12)))).withColumn("f", F.col("ring") * (F.col("k") - 0.5) / 8.0)


@query(f"WITH {SOURCES} SELECT key, round(fm, 9) AS merge, round(fr, 9) AS ring, round(fw, 9) AS width, round(fc, 9) AS cut FROM tr")
def waveform_transitions(spark, sf_dir):
    t = simulate.transitions(F.col("mass"), F.col("eta"))
    return _sources(spark, sf_dir).select("key", *(F.round(c, 9).alias(k) for k, c in t.items()))


@query(f"WITH {GRID} SELECT key, k, round(CASE WHEN f < fm THEN pow(f / fm, -7 / 6.0::DOUBLE) WHEN f < fr THEN pow(f / fm, -2 / 3.0::DOUBLE) WHEN f < fc THEN pi() / 2 * fw * pow(fr / fm, -2 / 3.0::DOUBLE) * fw / (2 * pi()) / (pow(f - fr, 2) + fw * fw / 4) ELSE 0 END, 6) AS amplitude FROM grid")
def waveform_amplitude(spark, sf_dir):
    return _grid(spark, sf_dir).select("key", "k", F.round(simulate.amplitude(F.col("f"), F.col("mass"), F.col("eta")), 6).alias("amplitude"))


@query(f"WITH {SOURCES} SELECT key, round(log10(sqrt(5 / 24.0::DOUBLE) * pow(pi(), -2 / 3.0::DOUBLE) * pow({SUN!r} * mass * pow(eta, 0.6), 5 / 6.0::DOUBLE) * pow(fm, -7 / 6.0::DOUBLE) / 1e17), 8) AS log_amplitude FROM tr")
def waveform_scale(spark, sf_dir):
    return _sources(spark, sf_dir).select("key", F.round(F.log10(simulate.physical_amplitude(F.col("mass"), F.col("eta"), F.lit(1e17))), 8).alias("log_amplitude"))


def _delay_sql(f: str) -> str:
    return "(" + " + ".join(f"{_quadratic(c)} / eta * ({(k - 5)!r} / 3.0::DOUBLE) * pow(pi() * {SUN!r} * mass * {f}, {(k - 5)!r} / 3.0::DOUBLE) / {f}" for k, c in PHASE.items()) + ") / (2 * pi())"


@query(f"WITH {GRID}, d AS (SELECT key, k, CASE WHEN f < fr THEN greatest({_delay_sql('fr')} - {_delay_sql('f')}, 0) ELSE 0 END AS s FROM grid) SELECT key, k, round(log10(1 + s), 6) AS log_delay FROM d")
def waveform_arrival(spark, sf_dir):
    f, mass, eta, ring, factors = (F.col(c) for c in ("f", "mass", "eta", "ring", "factors"))
    grid = _grid(spark, sf_dir, factors=simulate.delay_factors(eta), at_ring=simulate.group_delay(ring, mass, eta, factors))
    s = simulate.delay_before(f, mass, eta, ring, F.col("at_ring"), factors)
    return grid.select("key", "k", F.round(F.log10(1 + s), 6).alias("log_delay"))


SKY = "sky AS (SELECT s_suppkey AS key, s_suppkey * 0.7 AS lon, asin((s_suppkey * 37 % 199) / 100.0 - 0.99) AS lat, s_suppkey * 1.3 AS psi, s_suppkey * 86400.0 AS t FROM supplier)"


def _sky(spark, sf_dir):
    k = F.col("s_suppkey")
    return _table(spark, sf_dir, "supplier").select(k.alias("key"), (k * 0.7).alias("lon"), F.asin(k * 37 % 199 / 100.0 - 0.99).alias("lat"), (k * 1.3).alias("psi"), (k * 86400.0).alias("t"))


@query(f"WITH {SKY} SELECT key, round(2 * pi() * {simulate.UNIT!r} / {psd.LIGHT!r} * 0.01 * cos(lat) * cos(2 * pi() / {simulate.YEAR!r} * t - lon), 6) AS doppler, round(1 / sqrt(1 + 0.6 * pow(0.001 * key / {psd.TRANSFER!r}, 2)), 9) AS roll_off FROM sky")
def constellation_doppler(spark, sf_dir):
    d = simulate.doppler_phase(F.lit(0.01), F.col("t"), F.col("lon"), F.col("lat"))
    return _sky(spark, sf_dir).select("key", F.round(d, 6).alias("doppler"), F.round(simulate.roll_off(0.001 * F.col("key")), 9).alias("roll_off"))


@query(f"""WITH {SKY}, x AS (SELECT *, 2 * pi() / {simulate.YEAR!r} * t AS a, pi() / 2 - lat AS th FROM sky), d AS (SELECT key, psi,
sqrt(3) / 64 * (-36 * pow(sin(th), 2) * sin(2 * a) + (3 + cos(2 * th)) * (cos(2 * lon) * (-sin(4 * a)) + sin(2 * lon) * (cos(4 * a) - 9)) - 4 * sqrt(3) * sin(2 * th) * (sin(3 * a - lon) - 3 * sin(a + lon))) AS p,
(sqrt(3) * cos(th) * (9 * cos(-2 * lon) - cos(4 * a - 2 * lon)) - 6 * sin(th) * (cos(3 * a - lon) + 3 * cos(a + lon))) / 16 AS c FROM x)
SELECT key, round((cos(2 * psi) * p - sin(2 * psi) * c) / 2, 6) AS plus, round((sin(2 * psi) * p + cos(2 * psi) * c) / 2, 6) AS cross_ FROM d""")
def constellation_response(spark, sf_dir):
    plus, cross = simulate.antenna(F.col("t"), F.col("lon"), F.col("lat"), F.col("psi"))
    return _sky(spark, sf_dir).select("key", F.round(plus, 6).alias("plus"), F.round(cross, 6).alias("cross_"))


@query(f"WITH {EV}, {MERGERS} SELECT row, round(2.5 * cos(2 * pi() * (0.013 * (row - 1) + 1e-6 * pow(row - 1, 2) / 2) + 0.4), 6) AS value, EXISTS (SELECT 1 FROM sp WHERE row BETWEEN s0 AND s1)::INT AS label FROM ev")
def generated_record(spark, sf_dir):
    """Tones and labels of a generated record whose noise has no power."""
    spans = alerts.credited_spans(known_events(spark, sf_dir), "label").select("start", "end")
    made = simulate.generate_record(spark, n_rows(record(spark, sf_dir)), RATE, [(0.0, 0.0), (1.0, 0.0)], [(2.5, 0.013, 0.4, 1e-6)], spans, block=4096)
    return rounded(made.select("row", "value", "label"), "value")


# --- geometry, clips, strength, outputs ------------------------------------------------------------------------


@query("SELECT * FROM (VALUES (0, 'value')) t(place, column_name)")
def run_columns(spark, sf_dir):
    payload = record(spark, sf_dir).select(delivery.batch_of_row(F.col("row"), PER_BATCH).alias("batch"), "row", "value")
    return spark.createDataFrame(list(enumerate(records.run_columns(payload))), "place int, column_name string")


@query(f"WITH {EV} SELECT row, batch, value, twice FROM (SELECT row, (row - 1) // 25 + 1 AS batch, value, 2 * value AS twice FROM ev) WHERE batch IN (SELECT batch FROM (SELECT (row - 1) // 25 + 1 AS batch FROM ev) WHERE batch % 53 <> 0)")
def multi_column_payload(spark, sf_dir):
    wide = record(spark, sf_dir).select("row", "value", (2 * F.col("value")).alias("twice"))
    return delivery.scheduled_record(wide, arrivals(spark, sf_dir).select("batch"), PER_BATCH).select("row", "batch", "value", "twice")


@query(f"WITH {EV} SELECT window FROM (SELECT unnest(range(1, nw + 1)) AS window, n FROM size) WHERE (window - 1) * 5 + 20 <= n - 137")
def payload_end(spark, sf_dir):
    n = n_rows(record(spark, sf_dir))
    ids = spark.range(1, windows.window_count(n, SIZE, STEP) + 1).withColumnRenamed("id", "window")
    return conditioning.within_payload(ids, SIZE, STEP, n - 137)


COVERED = ARR + ", cg AS (SELECT batch, batch - row_number() OVER (ORDER BY batch) AS g FROM arr), cov AS (SELECT (min(batch) - 1) * 25 + 1 AS s, max(batch) * 25 AS e FROM cg GROUP BY g), clip AS (SELECT w.window, greatest(greatest((w.window - 1) * 5 + 1 - 40, 1), s) AS first, least(least((w.window - 1) * 5 + 60, n), e) AS last FROM (SELECT unnest(range(1, nw + 1)) AS window, n FROM size) w JOIN cov ON s <= (w.window - 1) * 5 + 1 AND e >= (w.window - 1) * 5 + 20)"


def _clips(spark, sf_dir):
    n = n_rows(record(spark, sf_dir))
    ids = spark.range(1, windows.window_count(n, SIZE, STEP) + 1).withColumnRenamed("id", "window")
    covered = delivery.coverage(arrivals(spark, sf_dir), PER_BATCH)
    return conditioning.contiguous_clips(ids, covered, SIZE, STEP, 2, n, bin_rows=500)


@query(f"WITH {COVERED} SELECT window, first, last FROM clip")
def contiguous_clip(spark, sf_dir):
    return _clips(spark, sf_dir)


CONDITIONED = COVERED + """, st AS (SELECT window, first, row - first AS j, last - first + 1 AS m, value FROM clip JOIN ev ON row BETWEEN first AND last),
fq AS (SELECT window, any_value(m) AS m, k, sum(value * cos(2 * pi() * k * j / m)) AS a, -sum(value * sin(2 * pi() * k * j / m)) AS b FROM st, range(1, 51) t(k) WHERE k <= m // 2 GROUP BY window, k),
gn AS (SELECT *, 1 / sqrt(1 + pow(0.05 / (k / m::DOUBLE), 8)) * sqrt(2 / (50 + 40 * k / m::DOUBLE)) * CASE WHEN 2 * k = m THEN 1 ELSE 2 END / m AS g FROM fq)"""


@query(f"WITH {CONDITIONED} SELECT s.window, (first + j - (s.window - 1) * 5 - 1)::INT AS place, round(sum(g * (a * cos(2 * pi() * k * j / s.m) - b * sin(2 * pi() * k * j / s.m))), 6) AS value FROM st s JOIN gn ON gn.window = s.window WHERE first + j BETWEEN (s.window - 1) * 5 + 1 AND (s.window - 1) * 5 + 20 GROUP BY s.window, first, j")
def condition_window(spark, sf_dir):
    knots = [(k / 40, 50.0 + k) for k in range(21)]
    x = conditioning.condition_windows(record(spark, sf_dir).select("row", "value"), _clips(spark, sf_dir), SIZE, STEP, RATE, knots, 0.05, 4)
    return rounded(x.select("window", F.posexplode("x").alias("place", "value")), "value")


@query("WITH ev AS (SELECT event_id + 1 AS row, value FROM events), w AS (SELECT unnest(range(1, (max(row) - 100) // 10 + 2)) AS window FROM ev) SELECT window, round(sqrt(sum(value * value)), 6) AS snr FROM w JOIN ev ON row BETWEEN (window - 1) * 10 + 1 AND (window - 1) * 10 + 100 GROUP BY window")
def window_strength(spark, sf_dir):
    rec = record(spark, sf_dir)
    return rounded(conditioning.window_strength(rec, 100, 10, n_rows(rec)), "snr")


@query(f"WITH {EV} SELECT window, round((14 + window) * 5 / 1.0 / 86400.0, 9) AS day FROM (SELECT unnest(range(1, nw + 1)) AS window FROM size)")
def mission_day(spark, sf_dir):
    ids = spark.range(1, windows.window_count(n_rows(record(spark, sf_dir)), SIZE, STEP) + 1).withColumnRenamed("id", "window")
    return ids.select("window", F.round(delivery.mission_day(F.col("window"), STEP, RATE, 16), 9).alias("day"))


@query(f"WITH {EV}, {MERGERS} SELECT event, epoch_us(TIMESTAMP '2035-01-01' + to_microseconds(((s0 - 1) * 5000000)::BIGINT)) AS start_us, epoch_us(TIMESTAMP '2035-01-01' + to_microseconds(((s1 - 1) * 5000000)::BIGINT)) AS end_us FROM sp")
def credited_span_times(spark, sf_dir):
    spans = alerts.credited_spans(known_events(spark, sf_dir), "signal")
    out = alerts.credited_span_times(spans, F.lit("2035-01-01 00:00:00").cast("timestamp"), 0.2)
    return out.select("event", F.unix_micros("start_at").alias("start_us"), F.unix_micros("end_at").alias("end_us"))


@query("SELECT 5.0::DOUBLE AS interval_s, epoch_us(TIMESTAMP '2035-01-01')::BIGINT AS epoch_us")
def replay_geometry(spark, sf_dir):
    start = F.lit("2035-01-01 00:00:00").cast("timestamp")
    ids = spark.range(3, windows.window_count(n_rows(record(spark, sf_dir)), SIZE, STEP) + 1).withColumnRenamed("id", "window")
    w = windows.window_table(ids, SIZE, STEP).withColumns({"content_start": delivery.row_time(F.col("row_start"), start, 0.2), "content_end": delivery.row_time(F.col("row_end"), start, 0.2)})
    return delivery.replay_geometry(w).select(F.round("interval", 9).alias("interval_s"), F.unix_micros("epoch").alias("epoch_us"))


@query(f'WITH {SCORED} SELECT window AS "Window", probability AS "Probability", (probability >= 0.85)::INT AS "Detection", label AS "Label", snr AS "SNR" FROM scored')
def inference_probabilities(spark, sf_dir):
    return stages.inference_table(scored(spark, sf_dir), 0.85)


@query(f"WITH {LIVE} SELECT count(*) AS windows, sum(decision)::BIGINT AS alarms FROM live")
def streamed_counts(spark, sf_dir):
    """Windows and alarms counted by a per-window callback of a stream."""
    from tidegauge.streaming import replay

    folder, seen = replay.folder_for(spark), {}
    live = scored(spark, sf_dir).select("window", (F.col("probability") >= 0.6).cast("int").alias("decision"))
    live.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(live.schema).parquet(f"{folder}/in")
    replay.each_window(stream, lambda batch, counts: seen.update(counts), f"{folder}/state", log=lambda text: None).awaitTermination()
    return spark.createDataFrame([(seen.get("windows", 0), seen.get("alarms", 0))], "windows long, alarms long")
