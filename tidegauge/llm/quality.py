"""Quality rules scored by an isolation forest.

One pass over the texts gives each document's rule statistics: words, characters in words, symbols, repeated lines,
words in repeated three-word windows, and shares made of them. Plain rules reject the documents they are sure of. For the
others an isolation forest, fitted on labelled rows of good quality, gives path lengths over random splits: the shorter the mean
path, the more anomalous the document. The threshold comes from all labelled rows: counts of good and bad rows by score are added up in Spark, and
the cut with the best share of bad rows caught is taken among those that lose at most `most_lost` of the good ones.

The statistics are written once (some 100 bytes a document), the text isn't shuffled. What reaches the driver is bounded: at most
`fit_rows` labelled rows for the forest (those with the least hash of their id) and the counts by score (BUCKETS + 1 rows).

Cases: a null text has no words and fails the plain rules; a null id is scored and never labelled; labels that contradict each
other for one id, or are null, don't count; rows that repeat an id are scored each by its own text; without labelled rows of
both kinds the threshold drops nothing; an empty table gives no rows; other columns are ignored. A text of any length is
taken in slices, but for its lines, which are hashed as a whole.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import lean, slices, written

#: Fixed values of the rules.
SPACE, SYMBOLS = b" \t\n\r\x0b\x0c", b"#*$%&|<>"
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
FEATURES = ("word_length", "symbols", "dup_lines", "repeats")
BUCKETS = 1000
EULER = 0.5772156649015329


def word_ids(text: bytes, piece: int = 1 << 22) -> tuple[np.ndarray, int]:
    """Numbers of the words in order, the same for equal words, and how many there are; split in pieces of some 4 MB."""
    seen: defaultdict[bytes, int] = defaultdict(count().__next__)
    found, at = [], 0
    while at < len(text):
        end = min(len(text), at + piece)
        while end < len(text) and text[end] not in SPACE:
            end += 1
        words = text[at:end].split()
        found.append(np.fromiter(map(seen.__getitem__, words), np.int64, len(words)))
        at = end
    return (np.concatenate(found) if found else np.zeros(0, np.int64)), len(seen)


def repeated(ids: np.ndarray, distinct: int) -> int:
    """Words covered by three-word windows that occur twice or more."""
    if len(ids) < 4:
        return 0
    pairs = ids[:-1] * distinct + ids[1:]
    if distinct > 2_000_000:  # numbers of triples would leave 64 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    triples = pairs[:-1] * distinct + ids[2:]
    order = np.argsort(triples, kind="stable")
    same = np.diff(triples[order]) == 0
    again = np.zeros(len(triples) + 1, bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    again = again[:-1]
    if not again.any():
        return 0
    covered = np.zeros(len(ids), bool)
    for k in range(3):
        covered[k : k + len(again)] |= again
    return int(covered.sum())


def statistics_of(text: str | None) -> tuple[int, ...]:
    raw = (text or "").encode()
    ids, distinct = word_ids(raw)
    number = lambda chars: len(raw) - len(raw.translate(None, chars))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return len(ids), len(text or "") - number(SPACE), number(SYMBOLS), len(lines) - len(set(lines)), repeated(ids, distinct), len(lines)


def statistics(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id and STATISTICS of each row."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = zip(*(statistics_of(x.as_py()) for x in batch.column("text")), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in found)], ["doc_id", *STATISTICS])

    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(lean(measure), f"doc_id {dict(docs.dtypes)['doc_id']}, " + ", ".join(f"{x} long" for x in STATISTICS))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))


def features(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    """FEATURES of each row: the logarithm of a word's mean length, square roots of shares, so that few and many stand apart."""
    words, chars, symbols, dup_lines, repeats, lines = (np.asarray(batch.column(c), float) for c in STATISTICS)
    share = lambda a, b: np.sqrt(a / np.maximum(b, 1))
    return np.stack([np.log(np.maximum(chars, 1) / np.maximum(words, 1)), share(symbols, chars), share(dup_lines, lines), share(repeats, words)], 1)


def usual_path(n: int) -> float:
    """Mean path length of an unsuccessful search in a binary tree of n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + EULER) - 2 * (n - 1) / n


class Forest:
    """Trees as arrays: the feature split by (-1: leaf), the value, the left child (the right one follows), the path length of leaves.

    A split is drawn from the box of its node, which starts as `box` and is halved by the splits above, whether or not rows of
    the sample lie on both sides: what no sample row has (symbols, where all are clean) is so cut off, too, after a short path."""

    def __init__(self, rows: np.ndarray, box: np.ndarray, trees: int = 100, sample: int = 256, seed: int = 42) -> None:
        draw = np.random.default_rng(seed)
        self.size = min(sample, len(rows))
        self.deepest = math.ceil(math.log2(max(2, self.size)))
        self.trees = [self._grown(rows[draw.choice(len(rows), self.size, replace=False)], box, draw) for _ in range(trees)]

    def _grown(self, rows: np.ndarray, box: np.ndarray, draw: np.random.Generator) -> tuple[np.ndarray, ...]:
        nodes: list[list[float]] = [[-1, 0.0, 0, 0.0]]
        todo = [(0, rows, 0, box)]
        while todo:
            at, own, depth, (low, high) = todo.pop()
            choices = np.flatnonzero(low < high)
            if depth >= self.deepest or len(own) < 2 or not len(choices):
                nodes[at][3] = depth + usual_path(len(own))
                continue
            feature = int(draw.choice(choices))
            value = draw.uniform(low[feature], high[feature])
            nodes[at][:3] = [feature, value, len(nodes)]
            left, cut = own[:, feature] <= value, np.arange(len(low)) == feature
            for part, half in ((own[left], (low, np.where(cut, value, high))), (own[~left], (np.where(cut, value, low), high))):
                todo.append((len(nodes), part, depth + 1, half))
                nodes.append([-1, 0.0, 0, 0.0])
        return tuple(np.array(c, t) for c, t in zip(zip(*nodes, strict=True), (np.int64, float, np.int64, float), strict=True))

    def paths(self, rows: np.ndarray) -> np.ndarray:
        """Mean path length of each row."""
        total, every = np.zeros(len(rows)), np.arange(len(rows))
        for feature, value, left, path in self.trees:
            at = np.zeros(len(rows), np.int64)
            while (inner := feature[at] >= 0).any():
                f = feature[at]
                at = np.where(inner, left[at] + (rows[every, f] > value[at]), at)
            total += path[at]
        return total / len(self.trees)

    def buckets(self, rows: np.ndarray) -> np.ndarray:
        """floor(BUCKETS * score), the score being 2 to the power of -(mean path / usual path): near 1 for anomalies, below a half for usual rows."""
        return np.floor(BUCKETS * 2.0 ** (-self.paths(rows) / (usual_path(self.size) or 1.0))).astype(np.int64)


def labelled(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of stats that the plain rules pass, with `good`: whether the one quality that labels give their id is 1."""
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("lo"), F.max("quality").alias("hi"))
    known = known.where("lo = hi").select("_id", (F.col("lo") == 1).alias("good"))
    return stats.where(~base_failed()).join(known, F.col("doc_id") == F.col("_id")).drop("_id")


def fit(rows: DataFrame, fit_rows: int = 20_000, trees: int = 100, sample: int = 256, seed: int = 42) -> Forest | None:
    """A forest of good rows of labelled(); its box holds the bad ones, too. None without rows of both kinds."""
    some = rows.select("good", *STATISTICS).orderBy(F.xxhash64("doc_id"), *STATISTICS).limit(fit_rows)
    found = some.toArrow()
    x, good = features(found), np.asarray(found.column("good"), bool)
    return Forest(x[good], np.stack([x.min(0), x.max(0)]), trees, sample, seed) if good.any() and not good.all() else None


def scored(stats: DataFrame, forest: Forest) -> DataFrame:
    """Adds bucket, the anomaly score in thousandths."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(forest.buckets(features(batch)), pa.int64())], [*batch.schema.names, "bucket"])

    return stats.mapInArrow(lean(score), ", ".join(f"{n} {t}" for n, t in stats.dtypes) + ", bucket long")


def threshold(counts: list[tuple[int, int, int]], most_lost: float) -> int:
    """(bucket, good, bad) rows -> the bucket above which rows are dropped: the largest share of bad ones less that of good ones."""
    good, bad = sum(g for _, g, _ in counts), sum(b for _, _, b in counts)
    best, at, lost, caught = 0.0, BUCKETS, 0, 0
    for bucket, g, b in sorted(counts, reverse=True):
        if good and bad and lost <= most_lost * good and caught / bad - lost / good > best:
            best, at = caught / bad - lost / good, bucket
        lost, caught = lost + g, caught + b
    return at


def judged(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000, most_lost: float = 0.01) -> DataFrame:
    """docs(doc_id, text), labels(doc_id, quality) -> doc_id, STATISTICS, base_failed, bucket (null without a forest), kept."""
    stats = written(statistics(docs), "statistics")
    rows = written(labelled(stats, labels), "labelled")
    forest = fit(rows, fit_rows)
    if forest is None:
        return stats.select("*", base_failed().alias("base_failed"), F.lit(None).cast("long").alias("bucket"), (~base_failed()).alias("kept"))
    counts = scored(rows, forest).groupBy("bucket").agg(F.count_if("good").alias("g"), F.count_if(~F.col("good")).alias("b")).collect()
    most = threshold([tuple(r) for r in counts], most_lost)
    return scored(stats, forest).select("*", base_failed().alias("base_failed"), (~base_failed() & (F.col("bucket") <= most)).alias("kept"))
