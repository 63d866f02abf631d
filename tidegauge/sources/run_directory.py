"""Run directories of a producer as a Spark data source: arrivals.jsonl, holes.jsonl and a descriptor.

spark.dataSource.register(RunDirectory); spark.read.format("run_directory").option("path", ...).load() gives
the arrival feed; option("table", "holes") the declared holes. The same format streams: each trigger reads
the lines that were added since the last.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

SCHEMAS = {"arrivals": "sim_time double, batch long, event string", "holes": "row_start long, row_end long, cause string, declared_at double"}
FIELDS = {"arrivals": ("sim_time", "batch", "event"), "holes": ("row_start", "row_end", "cause", "declared_at")}


def rows_of(path: str, table: str, start: int = 0, end: int | None = None) -> Iterator[tuple]:
    file = os.path.join(path, f"{table}.jsonl")
    if os.path.exists(file):
        with open(file) as lines:
            for k, line in enumerate(lines):
                if k >= start and (end is None or k < end) and line.endswith("\n"):
                    x = json.loads(line)
                    yield tuple(x.get(f) for f in FIELDS[table])


class Span(InputPartition):
    def __init__(self, start: int, end: int | None):
        self.start, self.end = start, end


class RunReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.table = options["path"], options.get("table", "arrivals")
        self.lines = int(options.get("linesPerPartition", 1_000_000))

    def partitions(self):
        n = sum(1 for _ in rows_of(self.path, self.table))
        return [Span(a, a + self.lines) for a in range(0, max(n, 1), self.lines)]

    def read(self, partition):
        yield from rows_of(self.path, self.table, partition.start, partition.end)


class RunStreamReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.table = options["path"], options.get("table", "arrivals")

    def initialOffset(self):
        return {"line": 0}

    def read(self, start):
        rows = list(rows_of(self.path, self.table, start["line"]))
        return iter(rows), {"line": start["line"] + len(rows)}

    def readBetweenOffsets(self, start, end):
        return rows_of(self.path, self.table, start["line"], end["line"])


class RunDirectory(DataSource):
    @classmethod
    def name(cls):
        return "run_directory"

    def schema(self):
        return SCHEMAS[self.options.get("table", "arrivals")]

    def reader(self, schema):
        return RunReader(self.options)

    def simpleStreamReader(self, schema):
        return RunStreamReader(self.options)


def record_final(path: str) -> bool:
    """A run is final once its descriptor says so."""
    file = os.path.join(path, "run.json")
    return os.path.exists(file) and bool(json.load(open(file)).get("final"))
