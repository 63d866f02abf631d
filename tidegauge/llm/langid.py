"""Language identification: script ranges narrow candidates, Viterbi with a switching penalty labels spans.

A model of letters (each letter given the two before it, within words, smoothed towards pairs and single
letters) scores every word under every language. A word's script restricts its candidates to languages
that use the script in training. Viterbi over the words of a text, with a penalty for each switch, labels
spans of mixed-language text; the language with most letters in its spans is the text's, and its share of
the letters of all words is the score.

Training reads at most `per_language` documents of each language, the first in order of a hash of the
document's id, and of them so many characters that all languages together stay below about `most_chars`: stated
bounds, alike at every input size. Every language and every letter that occur there are learned. Texts to be labelled are read whole.

Cases: null text or one without a letter gives `und`, score 0 and no spans; letters of scripts that no
language uses leave the most frequent language with score 0; an empty table gives no rows; without any
labelled document all texts are `und`; repeated rows are labelled each; of languages with equal scores the first by
name wins, in spans as for texts; a very long text is scored in slices cut between words, and its words are labelled
in blocks that advance together, which gives the same best path; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm.common import lean, slices

#: First code points of the script ranges; a range ends where the next one starts.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "other"), (0x0B80, "tamil"), (0x0C00, "other"), (0x0E00, "thai"), (0x0E80, "other"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"),
    (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD800, "other"), (0x20000, "han"), (0x2FA20, "other"),
)
#: Up to so many symbols and languages a table has all triples of letters, beyond them those that occur.
SYMBOLS, TABLED = 64, 60
#: Characters scored at once.
SLICE = 1_000_000
NAMES = tuple(dict.fromkeys(name for _, name in SCRIPTS))


@functools.lru_cache(maxsize=1)
def letters() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: its lower-case letter (0 for what is no letter) and the number of its script."""
    lower = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        if (c := chr(i)).isalpha():
            lower[i] = ord(c.lower()[0])
    script = np.zeros(0x110000, np.uint8)
    for start, name in SCRIPTS:
        script[start:] = NAMES.index(name)
    return lower, script


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


class Triples:
    """One language's counts of the triples that occur; logs() gives any triple's log-probability, as the full table does."""

    def __init__(self, index: np.ndarray, k: int, smooth: float):
        self.k, self.smooth = k, smooth
        self.three, self.two, self.before = (np.unique(x, return_counts=True) for x in (index, index % k**2, index // k))
        self.one, self.first = (np.bincount(x, minlength=k) for x in (index % k, index // k % k))

    @staticmethod
    def _count(known: tuple[np.ndarray, np.ndarray], wanted: np.ndarray) -> np.ndarray:
        keys, counts = known
        if not len(keys):
            return np.zeros(len(wanted), int)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, counts[at], 0)

    def logs(self, index: np.ndarray) -> np.ndarray:
        k, smooth = self.k, self.smooth
        p1 = (self.one[index % k] + 0.5) / (self.one.sum() + 0.5 * k)
        p2 = (self._count(self.two, index % k**2) + smooth * p1) / (self.first[index // k % k] + smooth)
        return np.log((self._count(self.three, index) + smooth * p2) / (self._count(self.before, index // k) + smooth)).astype(np.float32)


class Model:
    """Letter statistics of each language; scores() gives the log-probability of every word."""

    def __init__(self, texts: dict[str, list[str]], smooth: float = 2.0, least_share: float = 0.01):
        self.languages = sorted(texts)
        lower, script = letters()
        points = {k: code_points(" ".join(["", *v, ""])) for k, v in texts.items()}
        counts = sum((Counter(dict(zip(*map(np.ndarray.tolist, np.unique(lower[p], return_counts=True)), strict=True))) for p in points.values()), Counter())
        counts.pop(0, None)
        known = [c for c, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))]
        symbol = {c: i + 2 for i, c in enumerate(known)}  # 0: no letter, 1: a letter without a place in training
        self.known = known
        table = self._table(symbol)
        self.k = k = max(SYMBOLS, len(known) + 2)
        full = k == SYMBOLS and len(texts) <= TABLED
        tables, self.sparse, self.uses = [], None if full else [], np.zeros((len(NAMES), len(self.languages)), bool)
        for j, name in enumerate(self.languages):
            s = table[points[name]].astype(np.int64)
            index, live = _triples(s, k)
            if full:
                c3 = np.bincount(index[live], minlength=k**3).reshape(k, k, k).astype(float)
                c2, c1 = c3.sum(0), c3.sum((0, 1))
                p1 = (c1 + 0.5) / (c1.sum() + 0.5 * k)
                p2 = (c2 + smooth * p1) / (c2.sum(1, keepdims=True) + smooth)
                tables.append(np.log((c3 + smooth * p2[None]) / (c3.sum(2, keepdims=True) + smooth)))
            else:
                self.sparse.append(Triples(index[live], k, smooth))
            seen = np.bincount(script[points[name]][lower[points[name]] > 0], minlength=len(NAMES))
            self.uses[:, j] = seen >= least_share * max(1, seen.sum())
        self.logs = np.stack(tables, -1).reshape(-1, len(self.languages)).astype(np.float32) if tables else None
        self.usual = int(np.argmax([len(points[x]) for x in self.languages])) if texts else -1

    @staticmethod
    def _table(symbol: dict[int, int]) -> np.ndarray:
        lower, _ = letters()
        by_letter = np.ones(0x110000, np.uint8 if len(symbol) < 254 else np.uint32)
        by_letter[0] = 0
        for c, i in symbol.items():
            by_letter[c] = i
        return by_letter[lower]

    def words(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of every word (a run of letters) and its scores; points must end with no letter."""
        if not hasattr(self, "table"):
            self.table = self._table({c: i + 2 for i, c in enumerate(self.known)})
        step = max(1, min(SLICE, 8 * SLICE // max(1, len(self.languages))))  # scores take a number for each letter and language
        found, a = [], 0
        while a < len(points) or not found:
            b = min(a + step, len(points))
            while b < len(points) and self.table[points[b - 1]]:
                more = self.table[points[b : b + 4096]] == 0
                b += int(more.argmax()) + 1 if more.any() else len(more)
            starts, ends, scores = self._words(points[a:b])
            found.append((starts + a, ends + a, scores))
            a = b
        return found[0] if len(found) == 1 else tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _words(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        s = self.table[points]
        is_letter = s > 0
        edge = np.flatnonzero(np.diff(is_letter, prepend=False))
        starts, ends = edge[::2], edge[1::2]
        if not len(starts) or not self.languages:
            return starts[:0], ends[:0], np.zeros((0, len(self.languages)), np.float32)
        index, live = _triples(s.astype(np.int32 if self.k == SYMBOLS else np.int64), self.k)
        if self.sparse is None:
            logs = self.logs[index]
        else:
            known, at = np.unique(index, return_inverse=True)
            logs = np.stack([x.logs(known) for x in self.sparse], -1)[at]
        logs[~live] = 0
        scores = np.add.reduceat(logs, starts, axis=0)
        allowed = self.uses[letters()[1][points[starts]]]
        none = ~allowed.any(1)
        scores = np.where(allowed, scores, np.float32(-1e4))
        scores[none] = 0
        return starts, ends, scores


def _triples(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of each symbol with the two before it inside its word, and where a letter or a word's end stands."""
    one = np.concatenate([[0], s[:-1]]).astype(s.dtype)
    two = np.concatenate([[0], one[:-1]]).astype(s.dtype)
    two[one == 0] = 0
    return (two * k + one) * k + s, (s > 0) | (one > 0)


def viterbi(scores: np.ndarray, counts: np.ndarray, penalty: float, block: int = 256) -> np.ndarray:
    """Best label of every word; texts stand one after another with the given numbers of words.

    Texts are cut into blocks, and all blocks of all texts advance together: first from every label at once, to learn
    what a full block makes of the values before it, then from those values; backwards likewise. The path is that of
    a walk over the whole text.
    """
    labels = np.zeros(len(scores), np.int32)
    if not len(scores):
        return labels
    k, parts = scores.shape[1], -(-counts // block)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = np.repeat(np.cumsum(counts) - counts, parts) + nth * block
    left = np.repeat(counts, parts) - nth * block
    inner, later = np.flatnonzero(left > block), np.flatnonzero(nth)  # blocks with another one after them, and before them
    before = np.zeros((len(begin), k))
    by_place = np.split(later[np.argsort(nth[later], kind="stable")], np.cumsum(np.bincount(nth[later])[1:])[:-1]) if len(later) else []
    if len(inner):
        through = np.broadcast_to(np.where(np.eye(k, dtype=bool), 0.0, -np.inf), (len(inner), k, k))
        for t in range(block):
            through = np.maximum(through, through.max(2, keepdims=True) - penalty) + scores[begin[inner] + t][:, None]
        place = np.zeros(len(begin), int)
        place[inner] = np.arange(len(inner))
        for rows in by_place:  # second blocks of all texts, then third ones, ...
            before[rows] = (before[rows - 1][:, :, None] + through[place[rows - 1]]).max(1)
    size = np.minimum(left, block)
    order = np.argsort(-size, kind="stable")
    live = len(order) - np.searchsorted(size[order][::-1], np.arange(size[order[0]]), side="right")
    at, value = begin[order], before[order]
    moved, source = np.zeros((len(live), len(order), k), bool), np.zeros((len(live), len(order)), np.int16)
    for t, m in enumerate(live.tolist()):
        v = value[:m]
        source[t, :m] = v.argmax(1)
        other = v.max(1, keepdims=True) - penalty
        np.less(v, other, out=moved[t, :m])
        value[:m] = np.maximum(v, other) + scores[at[:m] + t]
    end, rank = np.zeros(len(order), np.int64), np.arange(len(order))
    end[order] = value.argmax(1)
    if len(later):
        state = np.tile(np.arange(k), (len(order), 1))  # label before the block for each label at its end
        for t in range(len(live) - 1, -1, -1):
            m = live[t]
            state[:m] = np.where(np.take_along_axis(moved[t, :m], state[:m], 1), source[t, :m, None], state[:m])
        rank[order] = np.arange(len(order))
        for rows in by_place[::-1]:
            end[rows - 1] = state[rank[rows], end[rows]]
    now, rows = end[order], np.arange(len(order))
    for t in range(len(live) - 1, -1, -1):
        m = live[t]
        labels[at[:m] + t] = now[:m]
        now[:m] = np.where(moved[t, rows[:m], now[:m]], source[t, :m], now[:m])
    return labels


def held_out(doc_id: Column | str) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0 if isinstance(doc_id, str) else doc_id


def training_rows(docs: DataFrame, per_language: int = 400, most_chars: int = 40_000_000) -> DataFrame:
    """lang, h, text of docs(doc_id, text, lang) that aren't held out and have a language: at most most_chars characters in all and
    per_language texts of each language, those with the least hash of their id. With very many languages there are fewer
    texts of each first, then shorter ones."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.coalesce(~held_out("doc_id"), F.lit(False))).select("lang", "text", F.xxhash64("doc_id").alias("h"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()}  # ids; a row for each language
    if not counts:
        return rows.limit(0)
    per = max(1, min(per_language, int((most_chars / 1000 / len(counts) - 20) / 1.5)))
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 1.5 * per / n + 20 / n))])
    each = int(most_chars / (1.5 * per + 20) / len(counts))
    near = rows.select("lang", "h", F.substring("text", 1, each).alias("text")).where((F.col("h") / F.lit(2.0**64) + 0.5) < F.coalesce(F.try_element_at(share, F.col("lang")), F.lit(0.0)))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))  # rows of some 1.5 per + 20 ids of each language, and each task sends the first ones only
    return near.withColumn("place", place).where(F.col("place") <= per).select("lang", "h", "text")


def train(docs: DataFrame, per_language: int = 400, most_chars: int = 40_000_000) -> Model:
    """Learns from training_rows(). The model has a table for each language."""
    texts: dict[str, list] = {}
    for r in training_rows(docs, per_language, most_chars).collect():
        texts.setdefault(r["lang"], []).append((r["h"], r["text"]))
    return Model({k: [x for _, x in sorted(v)] for k, v in texts.items()})


def label(docs: DataFrame, model: Model, penalty: float = 14.0, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs(doc_id, text) -> the columns in carry, lang_pred, score, spans array<struct<start, end, lang>> (characters)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
        names = np.array([*model.languages, "und"], object)
        for batch in slices(batches, "_text", SLICE):
            texts = [t or "" for t in batch.column("_text").to_pylist()]
            sizes = np.array([len(t) for t in texts])
            firsts = np.concatenate([[0], np.cumsum(sizes + 1)])
            starts, ends, scores = model.words(code_points("\n".join([*texts, ""])))
            owner = np.searchsorted(firsts, starts, side="right") - 1
            counts = np.bincount(owner, minlength=len(texts))
            if not model.languages:
                counts[:] = 0
                starts, ends, scores, owner = starts[:0], ends[:0], scores[:0], owner[:0]
            labels = viterbi(scores, counts, penalty)
            n = len(model.languages)
            scored = scores.any(1) if n else np.zeros(0, bool)
            weight = np.bincount(owner * max(n, 1) + labels, (ends - starts) * scored, minlength=len(texts) * max(n, 1)).reshape(len(texts), -1)
            total = np.bincount(owner, ends - starts, minlength=len(texts))
            best = weight.argmax(1)
            score = weight[np.arange(len(texts)), best] / np.maximum(total, 1)
            best = np.where(counts > 0, np.where(weight.sum(1) > 0, best, model.usual), n)
            new = np.ones(len(labels), bool)
            new[1:] = (owner[1:] != owner[:-1]) | (labels[1:] != labels[:-1])
            at = np.flatnonzero(new)
            last = np.append(at[1:], len(labels))[: len(at)] - 1
            begin, finish = starts[at] - firsts[owner[at]], ends[last] - firsts[owner[at]]
            offsets = np.concatenate([[0], np.cumsum(np.bincount(owner[at], minlength=len(texts)))]).astype(np.int32)
            items = pa.StructArray.from_arrays([pa.array(begin, pa.int32()), pa.array(finish, pa.int32()), pa.array(names[labels[at]], pa.string())], ["start", "end", "lang"])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(carry))), pa.array(names[best], pa.string()), pa.array(score, pa.float64()), pa.ListArray.from_arrays(pa.array(offsets), items).cast(kind)], [*carry, "lang_pred", "score", "spans"])

    rows = docs.select(*carry, F.col("text").alias("_text"))
    kind = T.StructType([*rows.schema.fields[:-1], *T._parse_datatype_string("lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>").fields])
    return rows.mapInArrow(lean(run), kind)


def accepted(docs: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """Rows of docs whose text is in a learned language for at least the given share of its letters."""
    names = docs.columns
    numbered = docs.select(*(F.col(c).alias(f"_{i}") for i, c in enumerate(names)), "text")
    kept = label(numbered, model, carry=tuple(f"_{i}" for i in range(len(names)))).where((F.col("lang_pred") != "und") & (F.col("score") >= least))
    return kept.select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(names)))
