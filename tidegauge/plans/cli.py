"""python -m tidegauge.plans.cli STAGE CONFIG.toml --data TABLE [--run FOLDER] [--out FOLDER] [--block NAME]"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidegauge.operators import detector
from tidegauge.plans import stages
from tidegauge.plans.config import load_config


def main(argv: list[str] | None = None) -> dict:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("stage", choices=("train", "evaluate", "calibrate", "replay", "label", "export"))
    p.add_argument("config")
    p.add_argument("--data", required=True)
    p.add_argument("--reference")
    p.add_argument("--columns")
    p.add_argument("--run")
    p.add_argument("--out", default="runs")
    p.add_argument("--block", default="all")
    for name in ("arrivals", "events", "holes"):
        p.add_argument(f"--{name}", help="table of the delivery")
    p.add_argument("--rows", type=int)
    p.add_argument("--per-batch", type=int)
    p.add_argument("--epoch", default="2035-01-01 00:00:00")
    a = p.parse_args(argv)
    spark, s = SparkSession.builder.getOrCreate(), load_config(a.config)
    data = spark.read.parquet(a.data)
    if a.stage == "train":
        found = stages.train_classifier(data, a.columns.split(","), s, a.out)
    elif a.stage == "evaluate":
        found = stages.evaluate_classifier(data, a.run, s, a.block, a.out)
    elif a.stage == "replay":
        read = lambda path: path and spark.read.parquet(path)
        found = stages.replay_classifier(data, read(a.arrivals), read(a.events), read(a.holes), s, a.rows, a.per_batch, F.lit(a.epoch).cast("timestamp"), a.out, a.run)
    elif a.stage == "label":
        found = stages.label_truth_stream(data, a.events and spark.read.parquet(a.events), s, a.rows, a.out)
    elif a.stage == "export":
        detector.export_payload(data, a.per_batch, a.rows, spark.read.parquet(a.events)).write.parquet(f"{a.out}/payload")
        found = {"payload": f"{a.out}/payload"}
    else:
        found = stages.calibrate_classifier(data, spark.read.parquet(a.reference), a.run, s, a.out)
    print(json.dumps({k: v for k, v in found.items() if isinstance(v, (int, float, str))}))
    return found


if __name__ == "__main__":
    main()
