"""Quantiles by rounds of counting, running sums over equally full ranges, unions of intervals over blocks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.functions import spectral
from tidegauge.operators import evaluate, order
from tidegauge.operators.intervals import ranges, running_sums, union_intervals

ODD = [0.0, -0.0, 5e-324, -5e-324, 1.0, 1.0, 1.0, -1.0, 1e308, -1e308, 1 + 2**-52, 1 - 2**-53, 3.5, -2.25, float("inf"), float("-inf")]


def test_bits_sort_as_doubles(spark):
    values = sorted(ODD) + [float("nan")]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", "v", order.ordered_bits(F.col("v")).alias("o")).withColumn("back", order.double_of(F.col("o"))).orderBy("i").collect()
    assert [r["o"] for r in got] == sorted(r["o"] for r in got)
    assert all(r["back"] == r["v"] or r["v"] != r["v"] and r["back"] != r["back"] for r in got)


@pytest.mark.parametrize("whole", [1, 40, 100_000])
def test_quantiles(spark, whole):
    rng = np.random.default_rng(1)
    groups = {0: rng.normal(size=301), 1: np.round(rng.normal(size=200) * 2), 2: np.full(50, 7.5), 3: np.array([-4.0]), 4: 1 + rng.random(150) * 1e-13}
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [(0, None), (9, None), (None, 1.0)]
    random.Random(0).shuffle(rows)
    at = [0.0, 0.005, 0.25, 0.5, 0.5, 0.99, 1.0]
    got = {(r["g"], r["i"]): r["q"] for r in order.quantiles(spark.createDataFrame(rows, "g int, v double").repartition(5), ["g"], "v", at, whole).collect()}
    assert len(got) == 5 * len(at)
    assert got == {(g, i): pytest.approx(float(np.quantile(x, p)), rel=1e-14, abs=1e-14) for g, x in groups.items() for i, p in enumerate(at)}


def test_quantiles_without_keys_and_of_nothing(spark):
    df = spark.createDataFrame([(v,) for v in ODD if abs(v) < float("inf")], "probability double")
    assert evaluate.candidates(df, 3) == [-1e308, pytest.approx(float(np.median([v for v in ODD if abs(v) < float("inf")]))), 1e308]
    assert evaluate.candidates(df.limit(0), 3) == []
    assert not order.quantiles(df.limit(0).withColumn("g", F.lit(1)), ["g"], "probability", [0.5]).count()


def test_welch_has_no_buffer_of_values(spark):
    df = spark.range(200).select(F.lit(0).alias("run"), (F.col("id") + 1).alias("row"), F.sin("id").alias("value"))
    out = spectral.welch_psd(df, 20, 1.0)
    assert "percentile" not in out._jdf.queryExecution().toString() and out.count() == 11


@pytest.mark.parametrize("descending", [True, False])
def test_running_sums_of_crowded_scores(spark, descending):
    n = 20_000
    df = spark.range(n).select((F.lit(0.999) + F.col("id") * F.lit(0.0001 / n)).alias("p"), F.col("id").alias("n")).repartition(7)
    sizes = [r["count"] for r in ranges(df, "p", 8, descending).groupBy("_b").count().collect()]
    assert len(sizes) == 8 and max(sizes) <= 2 * n / 8
    got = running_sums(df, "p", {"s": "n"}, 8, descending).orderBy("n").collect()
    s = np.cumsum(np.arange(n)[::-1])[::-1] if descending else np.cumsum(np.arange(n))
    assert [r["s"] for r in got] == s.tolist()


def test_null_scores_come_last(spark):
    df = spark.createDataFrame([(None, 1), (0.2, 1), (0.9, 0), (0.5, 0)], "probability double, label int")
    assert {r["threshold"]: (r["tpr"], r["fpr"]) for r in evaluate.roc_curve(df).collect()} == {0.9: (0, 0.5), 0.5: (0, 1), 0.2: (0.5, 1), None: (1, 1)}


@pytest.mark.parametrize("block", [1, 3, 1_000_000])
def test_union_of_intervals(spark, block):
    rng = random.Random(block)
    rows = [(s, a, a + rng.choice([0, 0, 1, 2, 9, 40])) for s in range(3) for a in [rng.randrange(-20, 400) for _ in range(60)]] + [(3, 5, 900), (3, 7, 8), (3, 901, 901), (3, 903, 903)]
    want = []
    for s in range(4):
        covered = sorted({i for t, a, b in rows if t == s for i in range(a, b + 1)})
        cuts = [i for i in range(len(covered)) if not i or covered[i] != covered[i - 1] + 1] + [len(covered)]
        want += [(s, covered[i], covered[j - 1]) for i, j in zip(cuts, cuts[1:])]
    df = spark.createDataFrame(rows, "series int, start long, end long")
    assert sorted(map(tuple, union_intervals(df, block).collect())) == want
    assert not union_intervals(df.limit(0), block).count()
