"""Estimators whose state goes from block to block of a series, and counts that outlive a restart."""

import numpy as np
import pytest

from tidegauge.streaming import estimator, replay
from tidegauge.tables import folder_for

MEAN = estimator.ExponentialMean(0.2, bridge=1)


def rows_of(missing=frozenset({40, 97, 98, 99, 100, 101, 102, 103, 104, 105, 106, 107, 108, 109, 110})):
    rng = np.random.default_rng(4)
    return [(s, i, float(rng.normal() + s)) for s in (0, 7) for i in range(3, 200) if i not in missing]


def by_hand(rows):
    out, known = {}, {}
    for s, i, v in sorted(rows):
        last, m = known.get(s, (i - 1, v))
        if i - last - 1 > 1:
            m = v
        m += 0.2 * (v - m)
        known[s] = i, m
        out[s, i] = pytest.approx(m)
    return out


def test_blocks_in_any_order_and_again_after_a_restart(spark):
    rows = rows_of()
    blocks = estimator.series_blocks(spark.createDataFrame([*rows, rows[5], (0, 40, None)], "series long, idx long, value double"), 10).collect()
    assert len(blocks) == 40 and sum(not b["idx"] for b in blocks) == 2
    folder = folder_for(spark)

    def feed(part):
        spark.createDataFrame(part, estimator.BLOCKS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        return {(r["series"], r["idx"]): r["estimate"] for r in estimator.run_estimates(folder, spark, MEAN).collect()}

    rest = [b for b in blocks if not (b["series"] == 0 and b["block"] == 4)]
    got = feed(rest[::-2])
    assert not any(s == 0 and i >= 40 for s, i in got)
    got = feed(rest[1::2] + rest[:3])  # three come again
    want = by_hand(rows)
    assert got == {k: v for k, v in want.items() if k[0] == 7 or k[1] < 40}
    assert feed([b for b in blocks if b not in rest]) == want


def test_no_rows(spark):
    assert not estimator.series_blocks(spark.createDataFrame([], "series long, idx long, value double"), 10).count()


def test_counts_outlive_a_restart_and_a_failed_micro_batch(spark):
    folder, seen, said, fails = folder_for(spark), [], [], [True]

    def callback(batch, counts):
        if len(seen) == 1 and fails:
            fails.clear()
            raise RuntimeError("lost")
        seen.append((counts["windows"], counts["alarms"]))

    def run(first, last):
        spark.range(first, last).selectExpr("id AS window", "int(id % 4 = 0) AS decision").coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema("window long, decision int").parquet(f"{folder}/in")
        replay.each_window(stream, callback, f"{folder}/state", 10, said.append).awaitTermination()

    run(0, 8)
    with pytest.raises(Exception, match="lost"):
        run(8, 20)
    run(20, 21)
    assert seen == [(8, 2), (20, 5), (21, 6)]
    assert said == ["20 windows scored, 5 alarms"]
