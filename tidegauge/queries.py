"""Queries on the detection operators over the driver's tables, each with the SQL that DuckDB answers alike.

`events`, numbered by event_id, is the record: value is its sample, ts the arrival of its rows. Windows
of 20 rows step by 5; a window is positive if it holds a value above 250; its score is a fixed function of
its mean, in steps of 1e-4 so that both engines meet the same thresholds.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.functions import psd, spectral
from tidegauge.operators import alerts, delivery, detector, evaluate, labels, models, scaler, train, windows
from tidegauge.operators.intervals import islands
from tidegauge.sources import records
from tidegauge.streaming import replay

SIZE, STEP, RATE, HIGH = 20, 5, 1.0, 250.0
PER_BATCH, CONTEXT = 25, 2
THRESHOLD = 0.85

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = re.sub(r"\bwindow\b", '"window"', sql)  # a keyword there, a column here
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --- the record and its scored windows --------------------------------------------------------------------

EV = "ev AS (SELECT event_id + 1 AS row, value, ts FROM events), size AS (SELECT max(row) AS n, (max(row) - 20) // 5 + 1 AS nw FROM ev)"
WIN = EV + ", win AS (SELECT w.window, ev.row, ev.value, ev.ts FROM (SELECT unnest(range(1, nw + 1)) AS window FROM size) w JOIN ev ON ev.row BETWEEN (w.window - 1) * 5 + 1 AND (w.window - 1) * 5 + 20)"
SCORED = WIN + ", scored AS (SELECT window, round(1 / (1 + exp(-(avg(value) - 60) / 9)), 4) AS probability, max((value > 250)::INT) AS label, max(ts) AS last_ts, round(max(value) / 100, 4) AS snr FROM win GROUP BY window)"
SWEEP = SCORED + """, cand AS (SELECT unnest(range(1, 100)) / 100.0 AS threshold),
noise AS (SELECT window, probability FROM scored WHERE label = 0), pos AS (SELECT window, probability, window - row_number() OVER (ORDER BY window) AS g FROM scored WHERE label = 1),
ev_best AS (SELECT g, max(probability) AS best FROM pos GROUP BY g),
ep AS (SELECT c.threshold, count(DISTINCT a.window - 0) FILTER (b.window IS NULL) AS episodes FROM cand c JOIN noise a ON a.probability >= c.threshold LEFT JOIN noise b ON b.window = a.window - 1 AND b.probability >= c.threshold GROUP BY c.threshold),
sweep AS (SELECT c.threshold::DOUBLE AS threshold, (SELECT count(*) FROM ev_best) AS n_events, (SELECT count(*) FILTER (best >= c.threshold) / count(*)::DOUBLE FROM ev_best) AS event_recall,
  (SELECT count(*) FILTER (probability >= c.threshold) / count(*)::DOUBLE FROM pos) AS window_recall, (SELECT count(*) FILTER (probability >= c.threshold) / count(*)::DOUBLE FROM noise) AS window_fpr,
  coalesce(ep.episodes, 0) AS episodes, coalesce(ep.episodes, 0) / ((SELECT count(*) FROM scored) * 5 / 86400.0) * 30 AS false_alarms_per_30d FROM cand c LEFT JOIN ep ON ep.threshold = c.threshold)"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("row"), "value", "ts")


def n_rows(rec: DataFrame) -> int:
    return rec.agg(F.max("row")).first()[0]


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec = record(spark, sf_dir)
    win = windows.sliding(rec, SIZE, STEP, n_rows(rec))
    p = F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.avg("value") - 60) / 9)), 4)
    return win.groupBy("window").agg(p.alias("probability"), F.max((F.col("value") > HIGH).cast("int")).alias("label"), F.max("ts").alias("last_ts"), F.round(F.max("value") / 100, 4).alias("snr"))


def sweep_of(df: DataFrame) -> DataFrame:
    return evaluate.threshold_sweep(df, [k / 100 for k in range(1, 100)], STEP, RATE)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows, features, scaler, logistic score, threshold by false-alarm budget, episodes per 30 days."""
    rec = record(spark, sf_dir)
    n = n_rows(rec)
    win = windows.sliding(rec, SIZE, STEP, n).groupBy("window").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("spread"), F.max("value").alias("top"), F.max((F.col("value") > HIGH).cast("int")).alias("label"))
    blocks = windows.chronological_split(windows.window_count(n, SIZE, STEP), 0.6, 0.2, windows.buffer_windows(SIZE, STEP))
    columns = ["mean", "spread", "top"]
    scale = scaler.fit_scaler(windows.restrict(win, blocks, "train"), columns)
    coded = models.predict_all(scaler.encode_features(win, columns, scale), columns, models.Classifier("logistic", 3, (2.0, 1.0, 4.0, -4.0)))
    coded = coded.withColumn("probability", F.round("probability", 6))
    fitted = evaluate.select_threshold(evaluate.threshold_sweep(windows.restrict(coded, blocks, "validation"), [k / 200 for k in range(1, 200)], STEP, RATE), "far", 500.0, 0.2).first()["threshold"]
    return evaluate.event_metrics(windows.restrict(coded, blocks, "test"), fitted, STEP, RATE).withColumn("threshold", F.lit(fitted))


# --- windows, blocks, stretches -----------------------------------------------------------------------------


@query(f"WITH {WIN} SELECT window, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS spread, max(value) AS top FROM win GROUP BY window")
def window_features(spark, sf_dir):
    rec = record(spark, sf_dir)
    win = windows.sliding(rec, SIZE, STEP, n_rows(rec))
    return rounded(win.groupBy("window").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("spread"), F.max("value").alias("top")), "mean", "spread")


@query(f"WITH {WIN} SELECT window, max((value > 250)::INT) AS label FROM win GROUP BY window")
def window_labels(spark, sf_dir):
    rec = record(spark, sf_dir)
    return windows.window_labels(rec.withColumn("label", (F.col("value") > HIGH).cast("int")), SIZE, STEP, n_rows(rec))


BLOCKS = "SELECT window, CASE WHEN window <= floor(0.7 * nw) THEN 'train' WHEN window BETWEEN floor(0.7 * nw) + 5 AND floor(0.85 * nw) THEN 'validation' WHEN window >= floor(0.85 * nw) + 5 THEN 'test' END AS block FROM (SELECT unnest(range(1, nw + 1)) AS window, nw FROM size)"


def _window_ids(spark, sf_dir):
    n = windows.window_count(n_rows(record(spark, sf_dir)), SIZE, STEP)
    return spark.range(1, n + 1).withColumnRenamed("id", "window"), n


@query(f"WITH {EV} {BLOCKS}")
def chronological_blocks(spark, sf_dir):
    ids, n = _window_ids(spark, sf_dir)
    return ids.withColumn("block", windows.block_column(F.col("window"), windows.chronological_split(n, 0.7, 0.15, windows.buffer_windows(SIZE, STEP))))


@query(f"WITH {EV} SELECT min(window) AS first, max(window) AS last, count(*) AS n FROM (SELECT unnest(range(1, nw + 1)) AS window, nw FROM size) WHERE window >= floor(0.7 * nw) + 5")
def held_out_block(spark, sf_dir):
    ids, n = _window_ids(spark, sf_dir)
    held = windows.threshold_rows(windows.chronological_split(n, 0.7, 0.15, windows.buffer_windows(SIZE, STEP)), "held_out")
    return ids.where(held.holds(F.col("window"))).agg(F.min("window").alias("first"), F.max("window").alias("last"), F.count("*").alias("n"))


@query(f"WITH {EV} SELECT CASE WHEN window <= floor(0.3 * nw) THEN 'calibration' ELSE 'evaluation' END AS block, min(window) AS first, max(window) AS last FROM (SELECT unnest(range(1, nw + 1)) AS window, nw FROM size) WHERE window <= floor(0.3 * nw) OR window >= floor(0.3 * nw) + 5 GROUP BY 1")
def calibration_blocks(spark, sf_dir):
    ids, n = _window_ids(spark, sf_dir)
    named = ids.withColumn("block", windows.block_column(F.col("window"), windows.calibration_split(n, 0.3, windows.buffer_windows(SIZE, STEP))))
    return named.where("block IS NOT NULL").groupBy("block").agg(F.min("window").alias("first"), F.max("window").alias("last"))


@query(f"WITH {EV} SELECT window, greatest((window - 1) * 5 + 1 - 40, 1) AS row_start, least((window - 1) * 5 + 20 + 40, n) AS row_end FROM (SELECT unnest(range(1, nw + 1)) AS window, n FROM size)")
def conditioning_rows(spark, sf_dir):
    ids, _ = _window_ids(spark, sf_dir)
    a, b = windows.conditioning_rows(F.col("window"), SIZE, STEP, CONTEXT, n_rows(record(spark, sf_dir)))
    return ids.select("window", a.alias("row_start"), b.alias("row_end"))


GAPPED = "ok AS (SELECT row, row - row_number() OVER (ORDER BY row) AS g FROM ev WHERE row % 997 <> 0 AND row NOT BETWEEN 2000 AND 2100), st AS (SELECT min(row) AS stretch_start, max(row) AS stretch_end FROM ok GROUP BY g)"


def _gapped(spark, sf_dir):
    rec = record(spark, sf_dir)
    return windows.finite_stretches(rec.withColumn("value", F.when((F.col("row") % 997 != 0) & ~F.col("row").between(2000, 2100), F.col("value"))), block=1000)


@query(f"WITH {EV}, {GAPPED} SELECT * FROM st")
def finite_stretches(spark, sf_dir):
    return _gapped(spark, sf_dir)


@query(f"WITH {EV}, {GAPPED} SELECT stretch_start, w.window FROM (SELECT unnest(range(1, nw + 1)) AS window FROM size) w JOIN st ON (w.window - 1) * 5 + 1 >= stretch_start AND (w.window - 1) * 5 + 20 <= stretch_end")
def gapped_window_indices(spark, sf_dir):
    return windows.stretch_windows(_gapped(spark, sf_dir), SIZE, STEP)


@query(f"WITH {EV} SELECT window FROM (SELECT unnest(range(1, nw + 1)) AS window, nw FROM size) WHERE window BETWEEN 1 + 8 AND nw - 8 ORDER BY window")
def edge_margin(spark, sf_dir):
    ids, n = _window_ids(spark, sf_dir)
    m = windows.edge_margin(2, SIZE, STEP)
    return ids.where(F.col("window").between(1 + m, n - m))


# --- channels, sources --------------------------------------------------------------------------------------

XYZ = "l AS (SELECT l_orderkey AS row, sum(l_quantity) AS x, sum(l_extendedprice) / 1000 AS y, sum(l_discount) * 100 AS z FROM lineitem GROUP BY l_orderkey)"


def _xyz(spark, sf_dir):
    return _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("row")).agg(F.sum("l_quantity").alias("X"), (F.sum("l_extendedprice") / 1000).alias("Y"), (F.sum("l_discount") * 100).alias("Z"))


@query(f"WITH {XYZ} SELECT row, round((z - x) / sqrt(2), 4) AS a, round((x - 2 * y + z) / sqrt(6), 4) AS e, round((x + y + z) / sqrt(3), 4) AS t FROM l")
def channel_projection(spark, sf_dir):
    return rounded(_xyz(spark, sf_dir).select("row", *(c.alias(k) for k, c in psd.channels(F.col("X"), F.col("Y"), F.col("Z")).items())), "a", "e", "t", digits=4)


@query(f"WITH {XYZ} SELECT row, 'A' AS channel, round((z - x) / sqrt(2), 4) AS value FROM l UNION ALL SELECT row, 'E', round((x - 2 * y + z) / sqrt(6), 4) FROM l")
def channel_record(spark, sf_dir):
    return rounded(records.channel_record(_xyz(spark, sf_dir), "AE"), "value", digits=4)


@query("SELECT l_orderkey AS row, round(sum(l_quantity), 4) AS x, round(sum(l_extendedprice), 2) AS y, round(sum(l_discount), 4) AS z FROM lineitem GROUP BY l_orderkey")
def component_sum(spark, sf_dir):
    lines = _table(spark, sf_dir, "lineitem").select("l_linenumber", F.col("l_orderkey").alias("row"), F.col("l_quantity").alias("X"), F.col("l_extendedprice").alias("Y"), F.col("l_discount").alias("Z"))
    parts = [lines.where(F.col("l_linenumber") % 3 == k) for k in range(3)]
    whole = records.component_sum(parts)
    return whole.select("row", F.round("X", 4).alias("x"), F.round("Y", 2).alias("y"), F.round("Z", 4).alias("z"))


PER_CHANNEL = WIN + ", chan AS (SELECT window, row % 2 AS c, avg(value) AS power, stddev_samp(value) AS spread, min(value) AS entropy FROM win GROUP BY window, row % 2)"


def _per_channel(spark, sf_dir):
    rec = record(spark, sf_dir)
    win = windows.sliding(rec, SIZE, STEP, n_rows(rec))
    return win.groupBy("window", (F.col("row") % 2).alias("c")).agg(F.avg("value").alias("power"), F.stddev_samp("value").alias("spread"), F.min("value").alias("entropy"))


@query(f"WITH {PER_CHANNEL} SELECT window, round(max(power), 6) AS power, round(max(spread), 6) AS spread, round(min(entropy), 6) AS entropy FROM chan GROUP BY window")
def channel_combine_max(spark, sf_dir):
    return rounded(spectral.combine_max(_per_channel(spark, sf_dir), ["power", "spread"], ["entropy"]), "power", "spread", "entropy")


@query(f"WITH {PER_CHANNEL} SELECT window, b.bin::INT AS bin, round(avg(CASE b.bin WHEN 0 THEN power ELSE spread END), 6) AS p FROM chan, (VALUES (0), (1)) b(bin) GROUP BY window, b.bin")
def channel_combine_mean(spark, sf_dir):
    return rounded(spectral.combine_mean(_per_channel(spark, sf_dir).select("window", F.array("power", "spread").alias("power"))), "p")


@query(f"WITH {EV} SELECT row - 100 AS row, value FROM ev WHERE row > 100")
def record_offset(spark, sf_dir):
    rec = record(spark, sf_dir)
    return records.drop_leading(rec, 101, n_rows(rec)).select("row", "value")


@query(f"WITH {SCORED} SELECT s.window, s.probability, s.label FROM scored s JOIN (SELECT window FROM scored WHERE window % 3 = 0) o ON o.window = s.window")
def positional_join(spark, sf_dir):
    df = scored(spark, sf_dir)
    return records.load_data(df.select("window", "probability"), df.where("window % 3 = 0").select("window", "label", "snr")).select("window", "probability", "label")


# --- scaling and models ------------------------------------------------------------------------------------

FEATURES = ["x1", "x2", "x3", "x4"]
EMB = "e AS (SELECT vec_id, embedding[1]::DOUBLE AS x1, embedding[2]::DOUBLE AS x2, embedding[3]::DOUBLE AS x3, embedding[4]::DOUBLE AS x4, (label < 3)::INT AS label FROM embeddings)"
ENC = EMB + ", q AS (SELECT quantile_cont(x1, [0.005, 0.995]) AS q1, quantile_cont(x2, [0.005, 0.995]) AS q2, quantile_cont(x3, [0.005, 0.995]) AS q3, quantile_cont(x4, [0.005, 0.995]) AS q4 FROM e), c AS (SELECT vec_id, label, " + ", ".join(
    f"(least(greatest(x{k}, q{k}[1]), q{k}[2]) - q{k}[1]) / (q{k}[2] - q{k}[1]) * pi() AS x{k}" for k in range(1, 5)
) + " FROM e, q)"
LOGISTIC = models.Classifier("logistic", 4, (1.0, -2.0, 0.5, 1.5, 0.25))
PERCEPTRON = models.Classifier("perceptron", 4, tuple(0.1 * k - 0.6 for k in range(13)), 2)
HARMONIC = models.Classifier("harmonic", 4, tuple(0.2 * k - 0.8 for k in range(9)))
CIRCUIT = models.Classifier("circuit", 4, tuple(0.15 * k - 0.5 for k in range(8)), 1)
DEEP = models.build_classifier("circuit", 4, 3, seed=3)


def _num(x: float) -> str:
    return repr(float(x)) + "::DOUBLE"


def _sum(terms) -> str:
    return " + ".join(terms)


def logistic_sql(m=LOGISTIC) -> str:
    return "1 / (1 + exp(-(" + _sum(f"{_num(m.params[k])} * x{k + 1} / pi()" for k in range(4)) + f" + {_num(m.params[4])})))"


def perceptron_sql(m=PERCEPTRON) -> str:
    h = m.size
    hidden = [f"tanh({_sum(f'{_num(m.params[k * h + j])} * x{k + 1} / pi()' for k in range(4))} + {_num(m.params[4 * h + j])})" for j in range(h)]
    return f"1 / (1 + exp(-({_sum(f'{_num(m.params[5 * h + j])} * {hidden[j]}' for j in range(h))} + {_num(m.params[6 * h])})))"


def harmonic_sql(m=HARMONIC) -> str:
    return "1 / (1 + exp(-(" + _sum([f"{_num(m.params[k])} * cos(x{k + 1})" for k in range(4)] + [f"{_num(m.params[4 + k])} * sin(x{k + 1})" for k in range(4)]) + f" + {_num(m.params[8])})))"


def circuit_sql(m=CIRCUIT) -> str:
    z = [f"(-sin({_num(m.params[k])}) * cos(x{k + 1}))" for k in range(4)]
    return f"(1 - ({z[0]} * {z[1]} + {z[0]} * {z[1]} * {z[2]} + {z[0]} * {z[1]} * {z[2]} * {z[3]} + {z[1]} * {z[2]} * {z[3]}) / 4) / 2"


def vectors(spark, sf_dir):
    return _table(spark, sf_dir, "embeddings").select("vec_id", *(F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate(FEATURES)), (F.col("label") < 3).cast("int").alias("label"))


def coded(spark, sf_dir):
    df = vectors(spark, sf_dir)
    return scaler.encode_features(df, FEATURES, scaler.fit_scaler(df, FEATURES))


@query(f"WITH {EMB} SELECT f AS feature, round(quantile_cont(v, 0.005), 9) AS lower, round(quantile_cont(v, 0.995), 9) AS upper FROM (UNPIVOT (SELECT x1, x2, x3, x4 FROM e) ON x1, x2, x3, x4 INTO NAME f VALUE v) GROUP BY f")
def fit_scaler(spark, sf_dir):
    s = scaler.fit_scaler(vectors(spark, sf_dir), FEATURES)
    return rounded(spark.createDataFrame(list(zip(FEATURES, s.lower, s.upper, strict=True)), "feature string, lower double, upper double"), "lower", "upper", digits=9)


@query(f"WITH {ENC} SELECT vec_id, " + ", ".join(f"round(x{k}, 6) AS x{k}" for k in range(1, 5)) + " FROM c")
def encode_features(spark, sf_dir):
    return rounded(coded(spark, sf_dir).select("vec_id", *FEATURES), *FEATURES)


MATCH = SCORED + """, f AS (SELECT *, avg_v FROM (SELECT window, avg(value) AS avg_v FROM win GROUP BY window) JOIN scored USING (window)), r AS (SELECT quantile_cont(avg_v, [0.005, 0.995]) AS b FROM f WHERE window <= 100),
rn AS (SELECT quantile_cont(avg_v, [0.5, 0.99]) AS a FROM f WHERE window <= 100 AND label = 0), nn AS (SELECT quantile_cont(2 * avg_v + 3, [0.5, 0.99]) AS n FROM f WHERE window > 100 AND label = 0),
w AS (SELECT (n[2] - n[1]) / ((a[2] - b[1]) / (b[2] - b[1]) - (a[1] - b[1]) / (b[2] - b[1])) AS width, n[1] AS n1, (a[1] - b[1]) / (b[2] - b[1]) AS p FROM r, rn, nn)"""


@query(f"WITH {MATCH} SELECT round(n1 - p * width, 5) AS lower, round(n1 - p * width + width, 5) AS upper FROM w")
def match_scaler(spark, sf_dir):
    rec = record(spark, sf_dir)
    df = windows.sliding(rec, SIZE, STEP, n_rows(rec)).groupBy("window").agg(F.avg("value").alias("m"), F.max((F.col("value") > HIGH).cast("int")).alias("label"))
    first = df.where("window <= 100")
    got = scaler.match_scaler(scaler.fit_scaler(first, ["m"]), first.where("label = 0"), df.where("window > 100 AND label = 0").withColumn("m", F.col("m") * 2 + 3), ["m"])
    return rounded(spark.createDataFrame([(got.lower[0], got.upper[0])], "lower double, upper double"), "lower", "upper", digits=5)


@query(f"WITH {SCORED} SELECT count(*) AS n, round(avg(probability), 6) AS mean FROM scored WHERE label = 0 AND window <= (SELECT floor(0.3 * nw) FROM size)")
def noise_filter(spark, sf_dir):
    df = scored(spark, sf_dir)
    n = windows.window_count(n_rows(record(spark, sf_dir)), SIZE, STEP)
    own = windows.restrict(df, windows.calibration_split(n, 0.3, windows.buffer_windows(SIZE, STEP)), "calibration").where("label = 0")
    return rounded(own.agg(F.count("*").alias("n"), F.avg("probability").alias("mean")), "mean")


def _score(spark, sf_dir, model):
    return rounded(models.predict_all(coded(spark, sf_dir), FEATURES, model).select("vec_id", "probability"), "probability")


@query(f"WITH {ENC} SELECT vec_id, round({logistic_sql()}, 6) AS probability FROM c")
def score_logistic(spark, sf_dir):
    return _score(spark, sf_dir, LOGISTIC)


@query(f"WITH {ENC} SELECT vec_id, round({perceptron_sql()}, 6) AS probability FROM c")
def score_perceptron(spark, sf_dir):
    return _score(spark, sf_dir, PERCEPTRON)


@query(f"WITH {ENC} SELECT vec_id, round({harmonic_sql()}, 6) AS probability FROM c")
def score_harmonic(spark, sf_dir):
    return _score(spark, sf_dir, HARMONIC)


@query(f"WITH {ENC} SELECT vec_id, round({circuit_sql()}, 6) AS probability FROM c")
def score_circuit_1layer(spark, sf_dir):
    return _score(spark, sf_dir, CIRCUIT)


def state_sql(source: str, m, keep: str = "vec_id") -> tuple[str, str]:
    """CTEs of the state vector of a circuit over source(x1, ...), one per gate, and the probability over the last one, z."""
    n, size = m.features, 1 << m.features
    params, ctes, last = models.circuit_params(m), [], source
    order, step = list(range(size)), 0
    re_, im = ["1.0::DOUBLE"] + ["0.0::DOUBLE"] * (size - 1), ["0.0::DOUBLE"] * size

    def emit(re_new: list[str], im_new: list[str]) -> tuple[list[str], list[str]]:
        nonlocal last, step
        name = f"z{step}"
        xs = ", ".join(f"x{k + 1}" for k in range(n))
        ctes.append(f"{name} AS (SELECT {keep}, {xs}, " + ", ".join(f"{a} AS r{i}, {b} AS i{i}" for i, (a, b) in enumerate(zip(re_new, im_new, strict=True))) + f" FROM {last})")
        last, step = name, step + 1
        return [f"r{i}" for i in range(size)], [f"i{i}" for i in range(size)]

    def turned(q: int, gate) -> None:
        nonlocal re_, im
        a, b = list(re_), list(im)
        for i in range(size):
            if not i >> q & 1:
                j = i | 1 << q
                (a[i], b[i]), (a[j], b[j]) = gate((re_[i], im[i]), (re_[j], im[j]))
        re_, im = emit(a, b)

    def phase(z: tuple[str, str], angle: str, sign: str) -> tuple[str, str]:
        c, s = f"cos(({angle}) / 2)", f"({sign}sin(({angle}) / 2))"
        return f"({z[0]}) * {c} - ({z[1]}) * {s}", f"({z[0]}) * {s} + ({z[1]}) * {c}"

    for layer in range(m.size):
        for q in range(n):
            def spread(z0, z1, angle=f"x{q + 1}"):
                plus, minus = tuple(f"({a} + {b}) * sqrt(0.5)" for a, b in zip(z0, z1, strict=True)), tuple(f"({a} - {b}) * sqrt(0.5)" for a, b in zip(z0, z1, strict=True))
                return phase(plus, angle, "-"), phase(minus, angle, "")

            turned(q, spread)
        for q in range(n):
            c, s, angle = _num(math.cos(params[layer, 0, q] / 2)), _num(math.sin(params[layer, 0, q] / 2)), _num(params[layer, 1, q])

            def turn(z0, z1, c=c, s=s, angle=angle):
                low, high = tuple(f"{c} * {a} - {s} * {b}" for a, b in zip(z0, z1, strict=True)), tuple(f"{s} * {a} + {c} * {b}" for a, b in zip(z0, z1, strict=True))
                return phase(low, angle, "-"), phase(high, angle, "")

            turned(q, turn)
        order = list(range(size))
        for q in range(n):
            order = [order[i ^ (1 << (q + 1) % n) if i >> q & 1 else i] for i in range(size)]
        re_, im = [re_[i] for i in order], [im[i] for i in order]
    weight = [(n - 2 * bin(i).count("1")) / n for i in range(size)]
    return ", ".join(ctes) + f", z AS (SELECT * FROM {last})", "(1 - (" + " + ".join(f"{_num(w)} * (pow({a}, 2) + pow({b}, 2))" for w, a, b in zip(weight, re_, im, strict=True)) + ")) / 2"


DEEP_CTES, DEEP_P = state_sql("c", DEEP)


@query(f"WITH {ENC}, {DEEP_CTES} SELECT vec_id, round({DEEP_P}, 6) AS probability FROM z")
def score_circuit_deep(spark, sf_dir):
    return _score(spark, sf_dir, DEEP)


@query(f"WITH {ENC} SELECT vec_id, (({logistic_sql()}) >= 0.6)::INT AS decision FROM c")
def decision(spark, sf_dir):
    return models.predict_all(coded(spark, sf_dir), FEATURES, LOGISTIC).select("vec_id", models.decide(F.col("probability"), 0.6).alias("decision"))


BCE = "-(3 * label * ln(least(greatest(p, 1e-7), 1 - 1e-7)) + (1 - label) * ln(1 - least(greatest(p, 1e-7), 1 - 1e-7)))"


@query(f"WITH {ENC}, s AS (SELECT vec_id, label, {logistic_sql()} AS p FROM c) SELECT vec_id, round({BCE}, 6) AS loss, round(-(3 * label / p - (1 - label) / (1 - p)), 5) AS slope FROM s")
def weighted_bce(spark, sf_dir):
    df = models.predict_all(coded(spark, sf_dir), FEATURES, LOGISTIC)
    p, y = F.col("probability"), F.col("label")
    return df.select("vec_id", F.round(evaluate.weighted_bce(p, y, 3.0), 6).alias("loss"), F.round(evaluate.weighted_bce_derivative(p, y, 3.0), 5).alias("slope"))


@query(f"WITH {EMB} SELECT count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label = 0) AS n_neg, round(count(*) FILTER (label = 0) / count(*) FILTER (label = 1)::DOUBLE, 6) AS class_weight FROM e")
def class_weight(spark, sf_dir):
    return rounded(evaluate.class_counts(vectors(spark, sf_dir)), "class_weight")


@query(f"WITH {ENC}, s AS (SELECT label, {logistic_sql()} AS p FROM c) SELECT round(avg({BCE}), 6) AS loss, round(avg(((p > 0.5) = (label = 1))::INT), 6) AS accuracy FROM s")
def epoch_validation(spark, sf_dir):
    return rounded(evaluate.epoch_validation(models.predict_all(coded(spark, sf_dir), FEATURES, LOGISTIC), 3.0), "loss", "accuracy")


GRAD = "-(3 * label / p - (1 - label) / (1 - p)) * p * (1 - p)"


@query(f"WITH {ENC}, s AS (SELECT *, {logistic_sql()} AS p FROM c) SELECT round(avg({BCE}), 6) AS loss, count(*) AS rows, " + ", ".join(f"round(avg({GRAD} * x{k + 1} / pi()), 6) AS g{k}" for k in range(4)) + f", round(avg({GRAD}), 6) AS g4 FROM s")
def gradient_logistic(spark, sf_dir):
    return rounded(train.control_gradient(coded(spark, sf_dir), FEATURES, LOGISTIC, 3.0), "loss", *(f"g{k}" for k in range(5)))


@query(f"WITH {ENC}, s AS (SELECT *, {harmonic_sql()} AS p FROM c) SELECT round(avg({BCE}), 6) AS loss, count(*) AS rows, " + ", ".join([f"round(avg({GRAD} * cos(x{k + 1})), 6) AS g{k}" for k in range(4)] + [f"round(avg({GRAD} * sin(x{k + 1})), 6) AS g{4 + k}" for k in range(4)]) + f", round(avg({GRAD}), 6) AS g8 FROM s")
def gradient_harmonic(spark, sf_dir):
    return rounded(train.control_gradient(coded(spark, sf_dir), FEATURES, HARMONIC, 3.0), "loss", *(f"g{k}" for k in range(9)))


@query()
def gradient_circuit(spark, sf_dir):
    g = train.circuit_gradient(coded(spark, sf_dir).withColumn("row_id", F.col("vec_id")), FEATURES, DEEP, 3.0)
    return spark.createDataFrame([(k, round(float(x), 9)) for k, x in enumerate(g)], "parameter int, gradient double")


@query()
def train_logistic(spark, sf_dir):
    df = coded(spark, sf_dir).withColumn("window", F.col("vec_id"))
    _, history = train.train(models.build_classifier("logistic", 4), df.where("vec_id % 5 < 4"), df.where("vec_id % 5 = 4"), FEATURES, epochs=8, patience=4, weight=2.0)
    return spark.createDataFrame([(h["epoch"], h["train_loss"], h["val_loss"]) for h in history], "epoch int, train_loss double, val_loss double")


# --- evaluation ---------------------------------------------------------------------------------------------


@query(f"WITH {SCORED}, g AS (SELECT probability AS threshold, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM scored GROUP BY 1) SELECT threshold, round(sum(p) OVER w / sum(p) OVER ()::DOUBLE, 6) AS tpr, round(sum(n) OVER w / sum(n) OVER ()::DOUBLE, 6) AS fpr FROM g WINDOW w AS (ORDER BY threshold DESC)")
def roc_curve(spark, sf_dir):
    return rounded(evaluate.roc_curve(scored(spark, sf_dir)), "tpr", "fpr")


@query(f"WITH {SCORED} SELECT round(avg(CASE WHEN a.probability > b.probability THEN 1.0 WHEN a.probability = b.probability THEN 0.5 ELSE 0 END), 6) AS auc FROM (SELECT * FROM scored WHERE label = 1) a, (SELECT * FROM scored WHERE label = 0) b")
def roc_auc(spark, sf_dir):
    return rounded(evaluate.roc_auc(scored(spark, sf_dir)), "auc")


@query(f"WITH {SCORED}, c AS (SELECT count(*) FILTER (probability >= 0.85 AND label = 1) AS tp, count(*) FILTER (probability >= 0.85 AND label = 0) AS fp, count(*) FILTER (probability < 0.85 AND label = 1) AS fn, count(*) FILTER (probability < 0.85 AND label = 0) AS tn FROM scored) SELECT tp, fp, fn, tn, round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / (tp + fn)::DOUBLE, 6) AS recall, round(fp / (fp + tn)::DOUBLE, 6) AS fpr, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1, round((tp / (tp + fn)::DOUBLE + 1 - fp / (fp + tn)::DOUBLE) / 2, 6) AS balanced_accuracy FROM c")
def window_metrics(spark, sf_dir):
    return rounded(evaluate.window_metrics(scored(spark, sf_dir), THRESHOLD), "precision", "recall", "fpr", "f1", "balanced_accuracy")


RATES = ("event_recall", "window_recall", "window_fpr", "false_alarms_per_30d")


@query(f"WITH {SWEEP} SELECT threshold, n_events, round(event_recall, 6) AS event_recall, round(window_recall, 6) AS window_recall, round(window_fpr, 6) AS window_fpr, episodes, round(false_alarms_per_30d, 4) AS false_alarms_per_30d FROM sweep")
def threshold_sweep(spark, sf_dir):
    return rounded(rounded(sweep_of(scored(spark, sf_dir)), *RATES[:3]), RATES[3], digits=4)


@query(f"WITH {SWEEP}, bad AS (SELECT coalesce(max(threshold), -1) AS b FROM sweep WHERE false_alarms_per_30d > 6000 OR window_fpr > 0.25) SELECT min(threshold) AS threshold, 'far' AS criterion FROM sweep, bad WHERE threshold > b")
def threshold_far(spark, sf_dir):
    return evaluate.select_threshold(sweep_of(scored(spark, sf_dir)), "far", 6000.0, 0.25)


@query(f"WITH {SWEEP} SELECT min(threshold) AS threshold, 'fpr' AS criterion FROM sweep WHERE window_fpr <= 0.05")
def threshold_fpr(spark, sf_dir):
    return evaluate.select_threshold(sweep_of(scored(spark, sf_dir)), "fpr", target_fpr=0.05)


@query(f"WITH {SWEEP} SELECT threshold, 'youden' AS criterion FROM sweep ORDER BY window_recall - window_fpr DESC, threshold LIMIT 1")
def threshold_youden(spark, sf_dir):
    return evaluate.select_threshold(sweep_of(scored(spark, sf_dir)), "youden")


EVENTS = ", a AS (SELECT window, probability, label, window - row_number() OVER (PARTITION BY label ORDER BY window) AS g FROM s), e AS (SELECT g, max((probability >= 0.85)::INT) AS hit FROM a WHERE label = 1 GROUP BY g), f AS (SELECT window, window - row_number() OVER (ORDER BY window) AS g FROM s WHERE label = 0 AND probability >= 0.85), m AS (SELECT (SELECT count(*) FROM e) AS n_events, (SELECT coalesce(sum(hit), 0)::BIGINT FROM e) AS n_detected, (SELECT count(DISTINCT g) FROM f) AS episodes, (SELECT count(*) FROM s) * 5 / 86400.0 AS days) SELECT n_events, n_detected, episodes, round(days, 6) AS days, round(n_detected / n_events::DOUBLE, 6) AS event_recall, round(episodes / days * 30, 4) AS false_alarms_per_30d FROM m"


def _event_metrics(df):
    return rounded(rounded(evaluate.event_metrics(df, THRESHOLD, STEP, RATE), "days", "event_recall"), "false_alarms_per_30d", digits=4)


@query(f"WITH {SCORED}, s AS (SELECT * FROM scored){EVENTS}")
def event_metrics(spark, sf_dir):
    return _event_metrics(scored(spark, sf_dir))


@query(f"WITH {SCORED}, s AS (SELECT * FROM scored WHERE window NOT BETWEEN 300 AND 340 AND window % 101 <> 0){EVENTS}")
def event_metrics_gapped(spark, sf_dir):
    return _event_metrics(scored(spark, sf_dir).where("window NOT BETWEEN 300 AND 340 AND window % 101 <> 0"))


@query(f'WITH {SCORED}, f AS (SELECT window, window - row_number() OVER (ORDER BY window) AS g FROM scored WHERE label = 0 AND probability >= 0.85) SELECT min(window) AS start, max(window) AS "end", count(*) AS n FROM f GROUP BY g')
def false_alarm_episodes(spark, sf_dir):
    return evaluate.false_alarm_episodes(scored(spark, sf_dir), THRESHOLD)


@query('WITH f AS (SELECT event_id, event_id - row_number() OVER (ORDER BY event_id) AS g FROM events WHERE value > 100) SELECT min(event_id) AS start, max(event_id) AS "end", count(*) AS n FROM f GROUP BY g')
def value_islands(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").where("value > 100").select(F.lit(0).alias("series"), F.col("event_id").alias("idx"))
    return islands(rows, block=256).drop("series")


@query(f"WITH {SCORED} SELECT least(floor(probability * 20), 19)::INT AS bin, label, count(*) AS n FROM scored GROUP BY 1, 2")
def score_histogram(spark, sf_dir):
    return evaluate.score_histogram(scored(spark, sf_dir))


@query(f"WITH {SCORED} SELECT floor(snr / 0.5)::INT AS bin, count(*) AS n, round(avg((probability >= 0.85)::INT), 6) AS detected FROM scored WHERE snr > 0 GROUP BY 1")
def sensitivity_by_snr(spark, sf_dir):
    return rounded(evaluate.sensitivity_by_snr(scored(spark, sf_dir), THRESHOLD, 0.5), "detected")


RUNS = "r AS (SELECT event_type AS config, user_id % 7 AS seed, round(avg(value), 6) AS far, round(avg(value) / 100, 6) AS auc, (count(*) % 3)::INT AS events, 2 AS n_events FROM events GROUP BY 1, 2)"


def _runs(spark, sf_dir):
    df = _table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("config"), (F.col("user_id") % 7).alias("seed"))
    return df.agg(F.round(F.avg("value"), 6).alias("far"), F.round(F.avg("value") / 100, 6).alias("auc"), (F.count("*") % 3).cast("int").alias("events"), F.lit(2).alias("n_events"))


@query(f"WITH {RUNS} SELECT config, count(*) AS runs, round(quantile_cont(far, 0.5), 6) AS far_median, min(far) AS far_min, max(far) AS far_max, round(quantile_cont(auc, 0.5), 6) AS auc_median, min((events = n_events)::INT) AS full_recall, min(events) AS events_min, max(events) AS events_max FROM r GROUP BY config")
def seed_summary(spark, sf_dir):
    return rounded(evaluate.seed_summary(_runs(spark, sf_dir)), "far_median", "auc_median")


@query(f"WITH {RUNS} SELECT config, seed FROM r WHERE events = n_events AND far <= (SELECT min(far) + sqrt(min(far)) FROM r WHERE events = n_events) ORDER BY auc DESC, config LIMIT 1")
def model_selection(spark, sf_dir):
    runs = _runs(spark, sf_dir).withColumns({"episodes": F.col("far"), "qubits": F.lit(4), "params": F.lit(32)})
    return evaluate.best_run(runs).select("config", "seed")


@query(f"WITH {RUNS} SELECT min_by(seed, far) AS epoch, min(far) AS val_loss FROM r WHERE config = (SELECT min(config) FROM r)")
def best_epoch(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    first = runs.agg(F.min("config")).first()[0]
    return evaluate.best_epoch(runs.where(F.col("config") == first).select(F.col("seed").alias("epoch"), F.col("far").alias("val_loss")))


@query("SELECT k::BIGINT AS k, round(pow(1 - k / 10000.0, 50), 9) AS survival FROM range(0, 200) t(k)")
def loss_survival(spark, sf_dir):
    return spark.range(200).select(F.col("id").alias("k"), F.round(evaluate.loss_survival(F.col("id") / 10000.0, 50), 9).alias("survival"))


@query(f"WITH {RUNS}, m AS (SELECT config AS mission, count(*) * 10 AS windows, max(events) AS events, 2 AS n_events, round(avg(far), 4) AS far FROM r GROUP BY 1) SELECT mission, round(windows / (SELECT windows FROM m ORDER BY mission LIMIT 1)::DOUBLE, 6) AS fraction, events, n_events, far FROM m")
def gap_study(spark, sf_dir):
    m = _runs(spark, sf_dir).groupBy(F.col("config").alias("mission")).agg((F.count("*") * 10).alias("windows"), F.max("events").alias("events"), F.lit(2).alias("n_events"), F.round(F.avg("far"), 4).alias("far"))
    return rounded(evaluate.gap_summary(m, m.agg(F.min("mission")).first()[0]), "fraction")


# --- delivery ------------------------------------------------------------------------------------------------

ARR = EV + ", arr AS (SELECT (row - 1) // 25 + 1 AS batch, max(ts) + INTERVAL 1 SECOND * (((row - 1) // 25 + 1) * 7919 % 3600) AS arrived_at FROM ev WHERE ((row - 1) // 25 + 1) % 53 <> 0 GROUP BY (row - 1) // 25 + 1)"
STRETCH = ARR + ", str AS (SELECT w.window, b.batch, (b.batch - 1) * 25 + 1 <= (w.window - 1) * 5 + 20 AND b.batch * 25 >= (w.window - 1) * 5 + 1 AS own, least(b.batch * 25, least((w.window - 1) * 5 + 60, n)) - greatest((b.batch - 1) * 25 + 1, greatest((w.window - 1) * 5 - 39, 1)) + 1 AS weight FROM (SELECT unnest(range(1, nw + 1)) AS window, n FROM size) w JOIN (SELECT DISTINCT (row - 1) // 25 + 1 AS batch FROM ev) b ON b.batch BETWEEN (greatest((w.window - 1) * 5 - 39, 1) - 1) // 25 + 1 AND (least((w.window - 1) * 5 + 60, n) - 1) // 25 + 1)"
DONE = STRETCH + ", done AS (SELECT str.window, max(arrived_at) AS complete_at FROM str LEFT JOIN arr USING (batch) GROUP BY 1 HAVING count(*) = count(arrived_at))"


def arrivals(spark, sf_dir):
    rec = record(spark, sf_dir).withColumn("batch", delivery.batch_of_row(F.col("row"), PER_BATCH)).where("batch % 53 <> 0")
    return rec.groupBy("batch").agg(F.max("ts").alias("t")).select("batch", F.timestamp_micros(F.unix_micros(F.col("t").cast("timestamp")) + F.col("batch") * 7919 % 3600 * 1_000_000).alias("arrived_at"))


def _stretches(spark, sf_dir):
    ids, _ = _window_ids(spark, sf_dir)
    return delivery.stretch_batches(ids, SIZE, STEP, CONTEXT, n_rows(record(spark, sf_dir)), PER_BATCH)


def _seconds(c):
    return (F.unix_micros(c) / 1e6).cast("long")


@query(f"WITH {EV} SELECT DISTINCT (row - 1) // 25 + 1 AS batch, ((row - 1) // 25) * 25 + 1 AS row_start, ((row - 1) // 25 + 1) * 25 AS row_end FROM ev")
def batch_rows(spark, sf_dir):
    b = record(spark, sf_dir).select(delivery.batch_of_row(F.col("row"), PER_BATCH).alias("batch")).distinct()
    low, high = delivery.batch_rows(F.col("batch"), PER_BATCH)
    return b.select("batch", low.alias("row_start"), high.alias("row_end"))


@query("SELECT event_id, regexp_extract('LIVE_batch_' || event_id, '_batch_([0-9]+)$', 1)::BIGINT AS batch FROM events")
def batch_names(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", delivery.batch_number(F.concat(F.lit("LIVE_batch_"), F.col("event_id"))).alias("batch"))


@query(f"WITH {ARR}, g AS (SELECT batch, batch - row_number() OVER (ORDER BY batch) AS g FROM arr) SELECT (min(batch) - 1) * 25 + 1 AS start, max(batch) * 25 AS \"end\" FROM g GROUP BY g")
def coverage_islands(spark, sf_dir):
    return delivery.coverage(arrivals(spark, sf_dir), PER_BATCH)


HOLES = "holes AS (SELECT greatest(row - 3, 1) AS row_start, row + 4 + 3 AS row_end, ts + INTERVAL 2 HOUR AS declared_at FROM ev WHERE row % 777 = 0)"


def _holes(spark, sf_dir):
    h = record(spark, sf_dir).where("row % 777 = 0").select(F.col("row").alias("row_start"), (F.col("row") + 4).alias("row_end"), F.expr("timestampadd(HOUR, 2, ts)").alias("declared_at"))
    return delivery.eroded(h, delivery.dilation_rows(2.5, RATE))


@query(f"WITH {EV}, {HOLES} SELECT row_start, row_end, epoch(date_trunc('second', declared_at))::BIGINT AS declared_s FROM holes")
def hole_dilation(spark, sf_dir):
    return _holes(spark, sf_dir).select("row_start", "row_end", _seconds(F.col("declared_at").cast("timestamp")).alias("declared_s"))


@query(f"WITH {DONE} SELECT window, epoch(complete_at)::BIGINT AS complete_s FROM (SELECT window, date_trunc('second', complete_at) AS complete_at FROM done)")
def window_completion(spark, sf_dir):
    return delivery.completion(_stretches(spark, sf_dir), arrivals(spark, sf_dir)).select("window", _seconds("complete_at").alias("complete_s"))


@query(f"WITH {STRETCH}, need AS (SELECT str.window, ceil(sum(weight) * 0.6) AS need, max(arrived_at) FILTER (own) AS own_at, count(*) FILTER (own) AS a, count(arrived_at) FILTER (own) AS b FROM str LEFT JOIN arr USING (batch) GROUP BY 1), sofar AS (SELECT str.window, arrived_at, sum(weight) OVER (PARTITION BY str.window ORDER BY arrived_at, batch) AS rows FROM str JOIN arr USING (batch)), k AS (SELECT s.window, min(arrived_at) AS k_at FROM sofar s JOIN need n ON n.window = s.window AND s.rows >= n.need GROUP BY 1) SELECT need.window, epoch(date_trunc('second', greatest(own_at, k_at)))::BIGINT AS complete_s FROM need JOIN k USING (window) WHERE a = b")
def window_completion_partial(spark, sf_dir):
    return delivery.completion_partial(_stretches(spark, sf_dir), arrivals(spark, sf_dir), 0.6).select("window", _seconds("complete_at").alias("complete_s"))


@query(f"WITH {DONE}, {HOLES} SELECT window FROM done, size WHERE NOT EXISTS (SELECT 1 FROM holes h WHERE h.row_start <= least((window - 1) * 5 + 60, n) AND h.row_end >= greatest((window - 1) * 5 - 39, 1) AND h.declared_at <= complete_at)")
def hole_exclusion(spark, sf_dir):
    done = delivery.completion(_stretches(spark, sf_dir), arrivals(spark, sf_dir))
    holes = _holes(spark, sf_dir).withColumn("declared_at", F.col("declared_at").cast("timestamp"))
    return delivery.kept_windows(done, holes, SIZE, STEP, CONTEXT, n_rows(record(spark, sf_dir)), bin_rows=100).select("window")


@query(f"WITH {DONE} SELECT window, epoch(date_trunc('second', max(complete_at) OVER (ORDER BY window)))::BIGINT AS release_s FROM done")
def ordered_release(spark, sf_dir):
    done = delivery.completion(_stretches(spark, sf_dir), arrivals(spark, sf_dir)).withColumnRenamed("complete_at", "settled_at")
    return delivery.ordered_release(done, block=300).select("window", _seconds("release_at").alias("release_s"))


@query(f'WITH {DONE}, miss AS (SELECT window, window - row_number() OVER (ORDER BY window) AS g FROM (SELECT unnest(range(1, nw + 1)) AS window FROM size) WHERE window NOT IN (SELECT window FROM done)) SELECT min(window) AS start, max(window) AS "end", count(*) AS n FROM miss GROUP BY g')
def gap_events(spark, sf_dir):
    ids, _ = _window_ids(spark, sf_dir)
    return delivery.gap_events(ids, delivery.completion(_stretches(spark, sf_dir), arrivals(spark, sf_dir)))


@query(f"WITH {ARR} SELECT ev.row, batch, value FROM ev JOIN arr ON arr.batch = (row - 1) // 25 + 1")
def scheduled_record(spark, sf_dir):
    return delivery.scheduled_record(record(spark, sf_dir), arrivals(spark, sf_dir), PER_BATCH).select("row", "batch", "value")


@query(f"WITH {DONE} SELECT window, epoch(date_trunc('second', complete_at))::BIGINT AS complete_s FROM done")
def streaming_replay(spark, sf_dir):
    feed = arrivals(spark, sf_dir).select("batch", (F.unix_micros("arrived_at") / 1e6).alias("arrived_at"))
    out = replay.follow_once(feed, size=SIZE, step=STEP, context=CONTEXT, rows=n_rows(record(spark, sf_dir)), per_batch=PER_BATCH)
    return out.select("window", F.floor("complete_at").cast("long").alias("complete_s"))


@query(f'WITH {EV} SELECT (row - 1) // 25 + 1 AS batch, row, value AS "Amplitude" FROM ev')
def payload_export(spark, sf_dir):
    rec = record(spark, sf_dir)
    return detector.export_payload(rec.select("row", F.col("value").alias("A")), PER_BATCH, n_rows(rec), known_events(spark, sf_dir).where(F.col("label_end_index") <= n_rows(rec)))


# --- alerts --------------------------------------------------------------------------------------------------

LIVE = SCORED + ", live AS (SELECT window, (probability >= 0.6)::INT AS decision, last_ts AS scored_at FROM scored), runs0 AS (SELECT window, scored_at, window - row_number() OVER (ORDER BY window) AS g FROM live WHERE decision = 1), lens AS (SELECT g, min(window) AS start, max(window) AS \"end\", count(*) AS n FROM runs0 GROUP BY g)"


def alert_sql(k: int) -> str:
    return LIVE + f", al AS (SELECT g, count(*) OVER w AS m, max(scored_at) OVER w AS t FROM runs0 WINDOW w AS (PARTITION BY g ORDER BY window ROWS {k - 1} PRECEDING)), alert AS (SELECT l.start, l.\"end\", l.n, min(t) AS t_alarm FROM al JOIN lens l USING (g) WHERE m = {k} AND l.n >= {k} GROUP BY 1, 2, 3)"


MERGERS = "ms AS (SELECT row, lag(row) OVER (ORDER BY row) AS p FROM ev WHERE value > 250), sp AS (SELECT (row_number() OVER (ORDER BY row))::INT AS event, (row - 1)::DOUBLE AS merger_time_s, greatest(row - 60, 1) AS s0, row + 40 AS s1 FROM ms)"


def live(spark, sf_dir):
    return scored(spark, sf_dir).select("window", models.decide(F.col("probability"), 0.6).alias("decision"), F.col("last_ts").alias("scored_at"))


def known_events(spark, sf_dir):
    rec = record(spark, sf_dir).where(F.col("value") > HIGH)
    e = rec.select(F.rank().over(Window.orderBy("row")).cast("int").alias("event"), (F.col("row") - 1).cast("double").alias("merger_time_s"), F.greatest(F.col("row") - 60, F.lit(1)).alias("label_start_index"), (F.col("row") + 40).alias("label_end_index"))
    return e.withColumn("signal_start_index", F.col("label_start_index"))


@query(f'WITH {alert_sql(3)} SELECT start, "end", n, epoch(date_trunc(\'second\', t_alarm))::BIGINT AS alarm_s FROM alert')
def alert_runs(spark, sf_dir):
    return alerts.alert_runs(live(spark, sf_dir), 3).select("start", "end", "n", _seconds(F.col("t_alarm").cast("timestamp")).alias("alarm_s"))


@query(f'WITH {alert_sql(6)} SELECT start, "end", n, epoch(date_trunc(\'second\', t_alarm))::BIGINT AS alarm_s FROM alert')
def alert_confirmations(spark, sf_dir):
    return alerts.confirmations(live(spark, sf_dir), 3, 6, SIZE, STEP).select("start", "end", "n", _seconds(F.col("t_alarm").cast("timestamp")).alias("alarm_s"))


@query(f"WITH {alert_sql(3)}, {MERGERS}, met AS (SELECT event, a.start, t_alarm FROM sp JOIN alert a ON (a.start - 1) * 5 + 1 <= s1 AND (a.\"end\" - 1) * 5 + 20 >= s0), own AS (SELECT start, min(event) AS owner FROM met GROUP BY 1), f AS (SELECT event, arg_min(start, (t_alarm, start)) AS start, min(t_alarm) AS t_alarm FROM met GROUP BY 1) SELECT sp.event, merger_time_s, (f.event IS NOT NULL)::INT AS detected, round((epoch_us(t_alarm) - epoch_us(TIMESTAMP '2024-01-01') - merger_time_s * 1e6) / 3.6e9, 4) AS latency_data_h, coalesce(owner < sp.event, false) AS shared FROM sp LEFT JOIN f ON f.event = sp.event LEFT JOIN own ON own.start = f.start")
def alert_latency(spark, sf_dir):
    runs = alerts.alert_runs(live(spark, sf_dir).withColumn("scored_at", F.col("scored_at").cast("timestamp")), 3)
    spans = alerts.credited_spans(known_events(spark, sf_dir), "signal")
    out = alerts.alert_latency(runs, spans, SIZE, STEP, F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return rounded(out.select("event", "merger_time_s", "detected", "latency_data_h", "shared"), "latency_data_h", digits=4)


@query(f"WITH {LIVE}, {MERGERS}, o AS (SELECT window, window - row_number() OVER (ORDER BY window) AS g FROM live WHERE decision = 1 AND NOT EXISTS (SELECT 1 FROM sp WHERE (window - 1) * 5 + 1 <= s1 AND (window - 1) * 5 + 20 >= s0)), c AS (SELECT count(*) AS episodes FROM (SELECT g FROM o GROUP BY g HAVING count(*) >= 3)) SELECT episodes, round((SELECT count(*) FROM live) * 5 / 86400.0, 6) AS scored_days, round(episodes / ((SELECT count(*) FROM live) * 5 / 86400.0) * 30, 4) AS false_alarms_per_30d FROM c")
def streamed_far(spark, sf_dir):
    spans = alerts.credited_spans(known_events(spark, sf_dir), "label")
    return rounded(rounded(alerts.streamed_false_alarms(live(spark, sf_dir), spans, SIZE, STEP, RATE, 3), "scored_days"), "false_alarms_per_30d", digits=4)


# --- labels --------------------------------------------------------------------------------------------------


@query(f"WITH {EV}, {MERGERS} SELECT event, greatest(floor(merger_time_s - 50)::BIGINT + 1, 1) AS start, least(floor(merger_time_s + 30)::BIGINT + 1, n) AS \"end\" FROM sp, size")
def fixed_spans(spark, sf_dir):
    return labels.fixed_spans(known_events(spark, sf_dir), 50, 30, RATE, n_rows(record(spark, sf_dir)))


@query(f"WITH {EV}, {MERGERS}, u AS (SELECT s0, s1, max(s1) OVER (ORDER BY s0, s1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM sp), k AS (SELECT s0, s1, sum((r IS NULL OR s0 > r + 1)::INT) OVER (ORDER BY s0, s1) AS k FROM u) SELECT min(s0) AS start, max(s1) AS \"end\" FROM k GROUP BY k")
def span_labels(spark, sf_dir):
    return labels.span_labels(alerts.credited_spans(known_events(spark, sf_dir), "label"))


@query(f"WITH {EV}, {MERGERS} SELECT row, EXISTS (SELECT 1 FROM sp WHERE row BETWEEN s0 AND s1)::INT AS label FROM ev")
def row_labels(spark, sf_dir):
    return labels.row_labels(record(spark, sf_dir).select("row"), alerts.credited_spans(known_events(spark, sf_dir), "label"), bin_rows=500)


STRENGTH = SCORED + f", {MERGERS}, strength AS (SELECT event, window, snr FROM scored JOIN sp ON (window - 1) * 5 + 1 <= s1 AND (window - 1) * 5 + 20 >= s0)"


def _strength(spark, sf_dir):
    from tidegauge.operators.intervals import touching

    spans = alerts.credited_spans(known_events(spark, sf_dir), "label")
    w = windows.window_table(scored(spark, sf_dir).select("window", "snr"), SIZE, STEP)
    return touching(w, spans.select("event", "start", "end"), bin_rows=500).select("event", "window", "snr"), spans


@query(f"WITH {STRENGTH} SELECT event, (min(window) - 1) * 5 + 1 AS start, (max(window) - 1) * 5 + 20 AS \"end\" FROM strength WHERE snr >= 1.5 GROUP BY event")
def detectable_spans(spark, sf_dir):
    return labels.detectable_spans(_strength(spark, sf_dir)[0], 1.5, SIZE, STEP)


@query(f"WITH {STRENGTH}, b AS (SELECT event, s0, s1, coalesce(lag(s1) OVER (ORDER BY event), 0) AS past FROM sp) SELECT event, min((window - 1) * 5 + 1) AS onset FROM strength JOIN b USING (event) WHERE snr >= 1.5 AND (window - 1) * 5 + 20 >= s0 AND (window - 1) * 5 + 1 <= s1 AND (window - 1) * 5 + 1 > past GROUP BY event")
def signal_onsets(spark, sf_dir):
    strength, spans = _strength(spark, sf_dir)
    return labels.signal_onsets(strength, spans, 1.5, SIZE, STEP)


@query(f"""WITH RECURSIVE {SCORED}, top AS (SELECT window AS w, snr AS s, row_number() OVER (ORDER BY window) AS k FROM (SELECT window, snr, lag(snr) OVER (ORDER BY window) AS b, lead(snr) OVER (ORDER BY window) AS a FROM scored)
WHERE snr >= 2.0 AND snr > coalesce(b, -1e300) AND snr >= coalesce(a, -1e300)), st AS (SELECT k, w, s, 1 AS g FROM top WHERE k = 1 UNION ALL
SELECT t.k, CASE WHEN t.w - st.w >= 12 OR st.s < t.s OR st.s < 0.5 * t.s THEN t.w ELSE st.w END, CASE WHEN t.w - st.w >= 12 OR st.s < t.s OR st.s < 0.5 * t.s THEN t.s ELSE st.s END, st.g + (t.w - st.w >= 12)::INT FROM st JOIN top t ON t.k = st.k + 1)
SELECT arg_max(w, k) AS window, arg_max(s, k) AS snr FROM st GROUP BY g""")
def snr_peaks(spark, sf_dir):
    return labels.snr_peaks(scored(spark, sf_dir).select("window", "snr"), 2.0, 12, 0.5)


# --- spectra -------------------------------------------------------------------------------------------------

FREQ = "fr AS (SELECT k::BIGINT AS k, k * 1e-4 AS f FROM range(1, 500) t(k))"
L = f"{psd.ARM!r}"
SENS = f"(10 / (3 * pow({L}, 2)) * (pow(1.5e-11, 2) * (1 + pow(2e-3 / f, 4)) + 2 * (1 + pow(cos(f / {psd.TRANSFER!r}), 2)) * pow(3e-15, 2) * (1 + pow(0.4e-3 / f, 2)) * (1 + pow(f / 8e-3, 4)) / pow(2 * pi() * f, 4)) * (1 + 0.6 * pow(f / {psd.TRANSFER!r}, 2)))"


def _freq(spark):
    return spark.range(1, 500).select(F.col("id").alias("k"), (F.col("id") * F.lit(1e-4)).alias("f"))


@query(f"WITH {FREQ} SELECT k, round(log10({SENS}), 8) AS sensitivity, round(log10(0.3 / (1 + 0.6 * pow(f / {psd.TRANSFER!r}, 2)) * {SENS}), 8) AS channel FROM fr")
def psd_model(spark, sf_dir):
    f = F.col("f")
    return _freq(spark).select("k", F.round(F.log10(psd.sensitivity_psd(f)), 8).alias("sensitivity"), F.round(F.log10(psd.channel_psd(f)), 8).alias("channel"))


@query(f"WITH {FREQ} SELECT k, round(log10(9e-45 * pow(f, -7 / 3.0) * exp(-pow(f, 0.138) - 221 * f * sin(521 * f)) * (1 + tanh(1680 * (0.00113 - f))) + 1e-60), 6) AS confusion FROM fr")
def confusion_model(spark, sf_dir):
    c = psd.confusion_psd(F.col("f"), 9e-45, 0.138, -221.0, 521.0, 1680.0, 0.00113)
    return _freq(spark).select("k", F.round(F.log10(c + F.lit(1e-60)), 6).alias("confusion"))


@query(f"WITH {FREQ}, x AS (SELECT k, f, 2 * pi() * {L} / {psd.LIGHT!r} * f AS x FROM fr) SELECT k, round(8 * pow(sin(x), 2) * (2 * 2.0 * (3 + 2 * cos(x) + cos(2 * x)) + 3.0 * (2 + cos(x))), 8) AS first, round(8 * pow(sin(x), 2) * (2 * 2.0 * (3 + 2 * cos(x) + cos(2 * x)) + 3.0 * (2 + cos(x))) * 4 * pow(sin(2 * x), 2), 8) AS second FROM x")
def delay_model(spark, sf_dir):
    f = F.col("f")
    return _freq(spark).select("k", F.round(psd.delay_psd(f, F.lit(3.0), F.lit(2.0)), 8).alias("first"), F.round(psd.delay_psd(f, F.lit(3.0), F.lit(2.0), True), 8).alias("second"))


@query(f"WITH {FREQ} SELECT k, round(1 / sqrt(1 + pow(5e-4 / f, 16)), 9) AS gain, round(sqrt(2 / 0.2 / f), 6) AS white FROM fr")
def highpass_gain(spark, sf_dir):
    f = F.col("f")
    return _freq(spark).select("k", F.round(psd.highpass_gain(f, 5e-4, 8), 9).alias("gain"), F.round(psd.whitening_gain(f, 0.2), 6).alias("white"))


@query(f"WITH {FREQ} SELECT round(sqrt(4 * 1e-4 * sum((pow(cos(k), 2) + pow(sin(2 * k), 2)) / (f + 1e-3))), 6) AS snr FROM fr")
def matched_filter_snr(spark, sf_dir):
    b = _freq(spark).select(F.cos("k").alias("re"), F.sin(F.col("k") * 2).alias("im"), (F.col("f") + F.lit(1e-3)).alias("psd"))
    return rounded(psd.matched_filter_snr(b, 1e-4), "snr")


DFT = WIN + ", tap AS (SELECT window, (row - 1) - (window - 1) * 5 AS j, value * (0.5 - 0.5 * cos(2 * pi() * ((row - 1) - (window - 1) * 5) / 20)) AS x FROM win), dft AS (SELECT window, b.bin::INT AS bin, (pow(sum(x * cos(2 * pi() * b.bin * j / 20)), 2) + pow(sum(x * sin(2 * pi() * b.bin * j / 20)), 2)) / (20 * 0.375) AS p FROM tap, range(0, 11) b(bin) GROUP BY 1, 2)"


def periodograms(spark, sf_dir):
    rec = record(spark, sf_dir)
    win = windows.sliding(rec.select("row", "value"), SIZE, STEP, n_rows(rec))
    return spectral.window_arrays(win).select("window", spectral.periodogram("x").alias("power"))


@query(f"WITH {DFT} SELECT window, bin, round(p, 4) AS p FROM dft")
def periodogram(spark, sf_dir):
    return rounded(periodograms(spark, sf_dir).select("window", F.posexplode("power").alias("bin", "p")), "p", digits=4)


BANDS = ", b AS (SELECT window, bin, bin / 20.0 AS f, p FROM dft WHERE bin / 20.0 BETWEEN 0.04 AND 0.51), t AS (SELECT window, sum(p) AS t, count(*) AS n FROM b GROUP BY 1)"


@query(f"WITH {DFT}{BANDS} SELECT window, round(avg(p) FILTER (f <= 0.16), 4) AS band_1, round(avg(p) FILTER (f > 0.16 AND f <= 0.31), 4) AS band_2, round(avg(p) FILTER (f > 0.31), 4) AS band_3, round(-sum(CASE WHEN p > 0 THEN p / t * ln(p / t) ELSE 0 END) / ln(any_value(n)), 6) AS spectral_entropy, round(log10(stddev_samp(p)), 6) AS log_power_std FROM b JOIN t USING (window) GROUP BY window")
def band_features(spark, sf_dir):
    out = spectral.band_features(periodograms(spark, sf_dir), [0.04, 0.16, 0.31, 0.51], RATE, SIZE)
    return rounded(rounded(out, "band_1", "band_2", "band_3", digits=4), "spectral_entropy", "log_power_std")


@query(f"WITH {DFT}, t AS (SELECT window, sum(p) AS t, count(*) AS n FROM dft GROUP BY 1) SELECT window, round(-sum(CASE WHEN p > 0 THEN p / t * ln(p / t) ELSE 0 END) / ln(any_value(n)), 6) AS spectral_entropy, round(log10(any_value(t) / any_value(n)), 6) AS log_mean, round(log10(stddev_samp(p)), 6) AS log_std, round(log10(max(p)), 6) AS log_max FROM dft JOIN t USING (window) GROUP BY window")
def spectral_entropy(spark, sf_dir):
    return rounded(spectral.paper_features(periodograms(spark, sf_dir)), "spectral_entropy", "log_mean", "log_std", "log_max")


WELCH = EV + ", smp AS (SELECT (row - 1) // 1000 AS run, (row - 1) % 1000 AS k, value FROM ev WHERE row % 1000 <> 0), len AS (SELECT run, count(*) AS n FROM smp GROUP BY 1), seg AS (SELECT l.run, s.s FROM len l, range(0, 100) s(s) WHERE s.s <= (l.n - 40) // 20), tap AS (SELECT g.run, g.s, k - 20 * s AS j, value * (0.5 - 0.5 * cos(2 * pi() * (k - 20 * s) / 40)) AS x FROM seg g JOIN smp ON smp.run = g.run AND k BETWEEN 20 * s AND 20 * s + 39), dft AS (SELECT run, s, b.bin::INT AS bin, (pow(sum(x * cos(2 * pi() * b.bin * j / 40)), 2) + pow(sum(x * sin(2 * pi() * b.bin * j / 40)), 2)) / (40 * 0.375) AS p FROM tap, range(0, 21) b(bin) GROUP BY 1, 2, 3), psd AS (SELECT bin, bin / 40.0::DOUBLE AS f, quantile_cont(p, 0.5) * 2 / ln(2) AS psd FROM dft GROUP BY 1)"


def _welch(spark, sf_dir):
    rec = record(spark, sf_dir).where("row % 1000 <> 0").select(F.floor((F.col("row") - 1) / 1000).alias("run"), "row", "value")
    return spectral.welch_psd(rec, 40, RATE)


@query(f"WITH {WELCH} SELECT bin, round(f, 6) AS f, round(psd, 3) AS psd FROM psd")
def welch_psd(spark, sf_dir):
    return rounded(rounded(_welch(spark, sf_dir), "f"), "psd", digits=3)


@query(f"WITH {WELCH} SELECT a.bin, round(pow(10, sum(exp(-0.5 * pow((log10(a.f) - log10(b.f)) / 0.1, 2)) * log10(b.psd)) / sum(exp(-0.5 * pow((log10(a.f) - log10(b.f)) / 0.1, 2)))), 3) AS psd FROM psd a JOIN psd b ON a.f > 0 AND b.f > 0 AND abs(log10(a.f) - log10(b.f)) <= 0.5 GROUP BY a.bin")
def smooth_psd(spark, sf_dir):
    return rounded(spectral.smooth_psd(_welch(spark, sf_dir), 0.1).select("bin", "psd"), "psd", digits=3)


@query(f"WITH {WELCH}, pts AS (SELECT k / 97.0::DOUBLE AS f FROM range(0, 48) t(k)), j AS (SELECT pts.f, arg_max(a.f, a.f) AS f0, arg_max(a.psd, a.f) AS s0 FROM pts JOIN psd a ON a.f <= pts.f GROUP BY pts.f), u AS (SELECT pts.f, min(b.f) AS f1, arg_min(b.psd, b.f) AS s1 FROM pts JOIN psd b ON b.f > pts.f GROUP BY pts.f) SELECT round(j.f, 6) AS f, round(coalesce(s0 + (s1 - s0) * (j.f - f0) / (f1 - f0), s0), 3) AS s FROM j LEFT JOIN u ON u.f = j.f")
def interpolated_psd(spark, sf_dir):
    at = spark.range(48).select((F.col("id") / F.lit(97.0)).alias("f"))
    return rounded(rounded(spectral.interpolated_psd(_welch(spark, sf_dir), at), "f"), "s", digits=3)


TRAILING = EV + """, smp AS (SELECT (row - 1) // 1000 AS run, row, value FROM ev WHERE row % 1000 <> 0), ends AS (SELECT run, min(row) AS a, max(row) AS b FROM smp GROUP BY 1),
inn AS (SELECT run, row, value FROM smp JOIN ends USING (run) WHERE row >= a + 5 AND row <= b - 5), ks AS (SELECT k FROM range(1, 100000) t(k) WHERE k <= (SELECT max(row) FROM smp) // 200),
del AS (SELECT k, run, row, value FROM ks JOIN inn ON row BETWEEN k * 200 - 600 AND k * 200 - 1), bnd AS (SELECT k, run, min(row) AS r0, count(*) AS n FROM del GROUP BY 1, 2),
seg AS (SELECT k, run, r0, s FROM bnd, range(0, 100) t(s) WHERE s <= floor((n - 40) / 20.0)), tap AS (SELECT g.k, g.run, g.s, row - r0 - 20 * s AS j, value * (0.5 - 0.5 * cos(2 * pi() * (row - r0 - 20 * s) / 40)) AS x FROM seg g JOIN del d ON d.k = g.k AND d.run = g.run AND row - r0 BETWEEN 20 * s AND 20 * s + 39),
dft AS (SELECT k, run, s, b.bin::INT AS bin, (pow(sum(x * cos(2 * pi() * b.bin * j / 40)), 2) + pow(sum(x * sin(2 * pi() * b.bin * j / 40)), 2)) / (40 * 0.375) AS p FROM tap, range(0, 21) b(bin) GROUP BY 1, 2, 3, 4)"""


@query(f"WITH {TRAILING} SELECT k * 200 AS psd_row, bin, round(bin / 40.0::DOUBLE, 6) AS f, round(quantile_cont(p, 0.5) * 2 / ln(2), 3) AS psd FROM dft GROUP BY k, bin")
def trailing_welch(spark, sf_dir):
    rec = record(spark, sf_dir).where("row % 1000 <> 0").select(F.floor((F.col("row") - 1) / 1000).alias("run"), "row", "value")
    return rounded(rounded(detector.trailing_welch(rec, 40, RATE, 600, 200, 5), "psd", digits=3), "f")


SAMPLE_FEATURES = DFT + """, t AS (SELECT window, sum(p) AS t, count(*) AS n FROM dft GROUP BY 1), fe AS (SELECT window, -sum(CASE WHEN p > 0 THEN p / t * ln(p / t) ELSE 0 END) / ln(any_value(n)) AS x1, log10(any_value(t) / any_value(n)) AS x2, log10(stddev_samp(p)) AS x3, log10(max(p)) AS x4 FROM dft JOIN t USING (window) GROUP BY window),
an AS (SELECT window, least(greatest(x1, 0), 1) * pi() AS x1, least(greatest(x2, 0), 6) / 6 * pi() AS x2, least(greatest(x3, 0), 6) / 6 * pi() AS x3, least(greatest(x4, 0), 6) / 6 * pi() AS x4 FROM fe)"""
SAMPLE_CTES, SAMPLE_P = state_sql("an", DEEP, "window")


@query(f"WITH {SAMPLE_FEATURES}, {SAMPLE_CTES} SELECT window, round({SAMPLE_P}, 6) AS probability FROM z")
def score_samples(spark, sf_dir):
    rec = record(spark, sf_dir).select("row", "value")
    scale = scaler.FeatureScaler((0.0, 0.0, 0.0, 0.0), (1.0, 6.0, 6.0, 6.0))
    return rounded(detector.score_windows(windows.sliding(rec, SIZE, STEP, n_rows(rec)), detector.ClassifierScorer(DEEP, scale)), "probability")


WHITEN = EV + """, smp AS (SELECT (row - 1) // 1000 AS stretch, row, row - min(row) OVER (PARTITION BY (row - 1) // 1000) AS j, count(*) OVER (PARTITION BY (row - 1) // 1000) AS n, value FROM ev WHERE row % 1000 <> 0),
fr AS (SELECT stretch, any_value(n) AS n, k, sum(value * cos(2 * pi() * k * j / n)) AS a, -sum(value * sin(2 * pi() * k * j / n)) AS b FROM smp, range(0, 501) t(k) WHERE k <= n // 2 GROUP BY stretch, k),
gn AS (SELECT *, CASE WHEN k = 0 THEN 0 ELSE 1 / sqrt(1 + pow(0.01 / (k / n::DOUBLE), 8)) * sqrt(2 / (50 + 40 * k / n::DOUBLE)) * CASE WHEN 2 * k = n THEN 1 ELSE 2 END / n END AS g FROM fr)"""


@query(f"WITH {WHITEN} SELECT s.stretch, s.row, round(sum(g * (a * cos(2 * pi() * k * j / s.n) - b * sin(2 * pi() * k * j / s.n))), 6) AS value FROM smp s JOIN gn ON gn.stretch = s.stretch GROUP BY s.stretch, s.row")
def whiten_stretch(spark, sf_dir):
    rec = record(spark, sf_dir).where("row % 1000 <> 0").select(F.floor((F.col("row") - 1) / 1000).alias("stretch"), "row", "value")
    knots = [(k / 40, 50.0 + k) for k in range(21)]
    return rounded(spectral.whiten_record(rec, RATE, knots, 0.01, 4), "value")


def queries() -> dict[str, Query]:
    from tidegauge import mission_queries, replay_queries  # noqa: F401  register their own

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(ORACLE)
