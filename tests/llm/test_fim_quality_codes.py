"""Fill-in-the-middle, quality rules, vector codes: against brute force, with nulls, ties, repeats, long texts and clashing columns."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.llm import fim, quality, queries, vector_codes

ODD = ["", None, " ", "\n\t x", "a", "a b  c\r\n", "x <P> y", "<S>", "<M", "<P <S> >", "naïve \U0001f600 b c", "é " * 70, "z" * 3000, "w x y " * 60, "\x00a\x01 b", "<<P>>"]
DOCS = "doc_id long, text string, u string, n int, form string, good string, bucket int"


def docs_of(spark, texts, first=0):
    rows = [(first + i, t, "clash", 7, "plain", "no", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + [rows[3], (None, "a b c d", "", 0, "", "", 0), (None, None, None, None, None, None, None)], DOCS).repartition(3)


def test_fill_in_middle(spark):
    long = " ".join(f"w{i}" for i in range(60_000)) + "  \n"
    texts = ODD * 6 + [long]
    got = fim.transformed(docs_of(spark, texts)).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(texts) + 3
    forms = Counter(r["form"] for r in got)
    assert forms["plain"] > 40 and forms["spm"] > 10 and forms["psm"] > 2
    for r in got:
        text = r["text"]
        assert r["back"] == text
        units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
        digits = hashlib.sha256(f"42:{'' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest()
        h = [int(digits[8 * k : 8 * k + 8], 16) for k in range(4)]
        n = len(units)
        a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        form = "plain" if text == "" or re.search("<[PSM]>", text) or h[2] % 100 >= 50 else "spm" if h[3] % 100 < 80 else "psm"
        output = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        assert (r["n"], r["form"], r["output"]) == (n, form, output)
        assert (r["prefix_chars"], r["middle_chars"]) == ((None, None) if form == "plain" else (len(p), len(m)))
    assert fim.transformed(docs_of(spark, ODD).limit(0)).count() == 0
    every = fim.transformed(docs_of(spark, ODD), percent=100, percent_spm=0)
    assert {r["form"] for r in every.where("text NOT RLIKE '<[PSM]>' AND text <> ''").collect()} == {"psm"}


def statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", "".join(words))), dup, len(covered)


def test_statistics(spark):
    draw = np.random.default_rng(3)
    texts = ODD + ["".join(draw.choice(list("ab# \n é"), 200)) for _ in range(30)] + ["a\n a\na\n\n\n a  \n "]
    got = quality.statistics(docs_of(spark, texts)).collect()
    wanted = sorted(statistics(t) for t in [*texts, texts[3], "a b c d", None])
    assert sorted(tuple(r)[1:6] for r in got) == wanted
    long = " ".join(f"v{i % 70_001}" for i in range(200_000))
    assert quality.word_ids(long.encode(), 1000)[0].tolist() == [i % 70_001 for i in range(200_000)]
    assert quality.statistics_of(long)[4] == 200_000
    ids = np.array([0, 1, 2, 9, 0, 1, 2])
    assert quality.repeated(ids, 10) == quality.repeated(ids, 3_000_000) == 6


def clean_and_junk(draw, n):
    good = lambda: "\n".join(" ".join("".join(draw.choice(list("etaoins"), draw.integers(2, 9))) for _ in range(12)) for _ in range(12))
    texts = [good() for _ in range(n)]
    return [(i, re.sub(r"(\w) ", r"\1*** ", t) if i % 6 == 0 else t) for i, t in enumerate(texts)]


def test_verdicts(spark):
    rows = clean_and_junk(np.random.default_rng(1), 600)
    docs = spark.createDataFrame([(i, t, "x", 1, "", "", 1) for i, t in rows] + [(None, rows[0][1], "", 0, "", "", 0), (5000, "short", "", 0, "", "", 0)], DOCS)
    labels = spark.createDataFrame([(i, int(i % 6 > 0), 0) for i in range(300)] + [(7, 0, 0), (8, None, 0), (None, 0, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.judged(docs, labels).collect()
    assert len(got) == 602
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert not kept[None] and not kept[5000]
    assert np.mean([kept[i] for i in range(300, 600) if i % 6]) > 0.98 and not any(kept[i] for i in range(300, 600, 6))
    again = {r["doc_id"]: r["bucket"] for r in quality.judged(docs.repartition(7), labels.repartition(2)).collect()}
    assert again == {r["doc_id"]: r["bucket"] for r in got}
    one_kind = quality.judged(docs, labels.where("quality = 1")).collect()
    assert all(r["kept"] != r["base_failed"] and r["bucket"] is None for r in one_kind)
    assert quality.judged(docs.limit(0), labels).count() == 0 and quality.judged(docs, labels.limit(0)).count() == 602


def test_forest():
    draw = np.random.default_rng(2)
    x = np.concatenate([draw.normal(0, 1, (300, 3)), draw.normal(8, 1, (9, 3))])
    forest = quality.Forest(x[:300], np.stack([x.min(0), x.max(0)]), trees=20, sample=64)

    def path(tree, row, at=0):
        feature, value, left, length = tree
        return length[at] if feature[at] < 0 else path(tree, row, left[at] + int(row[feature[at]] > value[at]))

    assert np.allclose(forest.paths(x), [np.mean([path(t, row) for t in forest.trees]) for row in x])
    assert forest.buckets(x)[300:].min() > np.quantile(forest.buckets(x)[:300], 0.99)
    one = np.zeros((1, 2))
    assert quality.Forest(one, np.stack([one[0], one[0]])).buckets(one) == [1000]
    assert math.isclose(quality.usual_path(256), 10.244770920)  # as published
    counts = [(500, 90, 1), (600, 9, 2), (700, 1, 7), (800, 0, 5)]
    assert [quality.threshold(counts, q) for q in (0, 0.01, 0.1)] == [700, 600, 500]
    assert quality.threshold([], 0.1) == quality.threshold([(3, 5, 0)], 0.1) == quality.BUCKETS


def test_quality_query(spark, data):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = queries.op12_isolation_forest_rules(spark, data).collect()
    assert len(got) == len(docs)
    for r in got:
        n_words, chars, symbols, dup, repeat = statistics(docs[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n_words, chars, symbols, dup, repeat)
        assert r["base_failed"] == (n_words < 50 or 100 * repeat > 50 * n_words) and not (r["kept"] and r["base_failed"])


def test_quality_held_out(spark):
    """Labels of a fifth of the documents take no part; of them, junk that the plain rules pass goes and good documents stay."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    rows = quality.judged(docs, labels.where(~held)).join(labels.where(held), "doc_id").where("NOT base_failed").collect()
    good, bad = ([r["kept"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert len(good) > 80 and np.mean(good) >= 0.97
    assert len(bad) > 4 and 1 - np.mean(bad) >= 0.8


@pytest.mark.parametrize("scale", [1.0, 3e7, 1e300])
def test_vector_codes(spark, scale):
    draw = np.random.default_rng(4)
    base = draw.standard_normal((12, 20))
    rows = [(int(i), [float(x) * scale for x in np.round(base[draw.integers(12)] + draw.choice([0, 0.1]) * draw.standard_normal(20), 3)], int(i) % 3 if i % 7 else None) for i in draw.permutation(150)]
    if scale == 3e7:
        rows = [(i, v if i % 5 else [x / scale for x in v], c) for i, v, c in rows]  # sums in 64 bits and beyond, side by side
    rows += [(200, None, 0), (201, [float("nan")] + [0.0] * 19, 0), (202, [None] + [0.0] * 19, 0), (203, [float("-inf")] * 20, 1), (204, [1.0] * 19, 1), (205, [], 1), (20, rows[0][1], 2), (None, rows[0][1], None)]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "vec_id long, embedding array<double>, label int, code int, error string").repartition(3)
    books = vector_codes.fit(df, parts=3, entries=5, rounds=4, factor=16)
    got = vector_codes.with_label_errors(vector_codes.encode(df, books, factor=16)).collect()

    whole = lambda x: math.floor(16 * x) if abs(x) < 2**53 else 16 * int(x)
    kept = [(i, [whole(x) for x in v], c) for i, v, c in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    full = sorted((r for r in kept if len(r[1]) == 20), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cuts = [0, 6, 13, 20]
    cut = lambda v: [v[a:b] for a, b in zip(cuts, cuts[1:])]
    mine = [[cut(v)[p] for _, v, _ in full[:5]] for p in range(3)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, y)), k) for k, y in enumerate(book))
    for _ in range(4):
        for p in range(3):
            groups = [[cut(v)[p] for _, v, _ in full if near(cut(v)[p], mine[p])[1] == k] for k in range(5)]
            mine[p] = [[sum(c) // len(g) for c in zip(*g)] if g else mine[p][k] for k, g in enumerate(groups)]
    assert books == mine and vector_codes.digest(books) == hashlib.sha256(",".join(str(y) for b in mine for e in b for y in e).encode()).hexdigest()
    wanted, sums = [], {}
    for i, v, c in kept:
        best = [near(x, b) for x, b in zip(cut(v), mine)] if len(v) == 20 else None
        error = best and sum(d for d, _ in best)
        sums.setdefault(c, []).append(error)
        wanted.append((i, best and "".join(f"{k:02x}" for _, k in best), error if error is not None and error < 2**63 else None, c))
    total = {c: None if any(e is not None and e >= 2**63 for e in es) or sum(e or 0 for e in es) >= 2**63 else sum(e or 0 for e in es) for c, es in sums.items()}
    key = lambda r: tuple(map(str, r))
    assert sorted(((r["vec_id"], r["code"], r["error"], r["label"], r["label_error"]) for r in got), key=key) == sorted(((*w, total[w[3]]) for w in wanted), key=key)


def test_vector_code_cases(spark):
    schema = "vec_id long, embedding array<float>, label string"
    none = spark.createDataFrame([], schema)
    assert vector_codes.fit(none) == [] and vector_codes.with_label_errors(vector_codes.encode(none, [])).count() == 0
    ties = spark.createDataFrame([(i, [float(i % 2)] * 8, None) for i in range(40)], schema)  # entries repeat: the lower index wins
    books = vector_codes.fit(ties)
    got = vector_codes.encode(ties, books).collect()
    assert {r["code"] for r in got} == {"00" * 8, "01" * 8} and {r["error"] for r in got} == {0}
    short = spark.createDataFrame([(1, [0.5, -0.5], "a"), (2, [], "b")], schema)
    books = vector_codes.fit(short)
    assert [len(b) for b in books] == [1] * 8 and {r["vec_id"]: r["code"] for r in vector_codes.encode(short, books).collect()} == {1: "00" * 8, 2: None}


def test_annulus_is_exact():
    draw = np.random.default_rng(9)
    for spread in (3, 400, 2**20):
        entries = draw.integers(-spread, spread, (16, 4))
        entries[5] = entries[2]
        book = vector_codes.Codebook(entries.tolist())
        x = draw.integers(-2 * spread, 2 * spread, (300, 4))
        entry, square = book.assign(x)
        all_squares = ((x[:, None] - entries) ** 2).sum(2)
        assert (entry == all_squares.argmin(1)).all() and (square == all_squares.min(1)).all()
        assert [book.nearest(v) for v in x[:40].tolist()] == list(zip(square[:40].tolist(), entry[:40].tolist()))
