"""Language ID, Jaccard join, chat, main text, suffix dedup and the pipeline: brute force, round trips, held-out accuracy."""

import hashlib
import random
import re
import time
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from layouts import layouts
from tidegauge.llm import chat, html, jaccard, langid, queries, suffix


def test_language_id(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = langid.train(docs)
    rows = {r["doc_id"]: r for r in langid.label(docs, model).collect()}
    held = [(r["lang"], rows[r["doc_id"]]) for r in docs.where(langid.held_out("doc_id")).collect()]
    assert len(rows) == 200 and sum(a == b["lang_pred"] for a, b in held) >= 0.95 * len(held)
    texts = {r["lang"]: r["text"] for r in docs.where("lang IN ('en', 'fr')").collect()}
    odd = [(1, None, "a"), (2, "", "b"), (3, "12 34 !?", "c"), (4, "Ωμέγα κείμενο", "d"), (5, texts["en"] + " " + texts["fr"], "e"), (5, texts["en"], "f")]
    got = sorted(map(tuple, langid.label(spark.createDataFrame(odd, "doc_id long, text string, lang_pred string"), model).collect()))
    assert [g[1:3] for g in got[:3]] == [("und", 0.0)] * 3 and got[3][1] in model.languages and got[3][2] == 0.0
    mixed = next(g for g in got if len(g[3]) > 1)
    assert [s["lang"] for s in mixed[3]][0] == "en" and mixed[3][-1]["lang"] == "fr" and 0 < mixed[2] < 1
    assert langid.label(docs.limit(0), model).count() == 0
    nothing = langid.train(docs.where("false"))
    assert {r["lang_pred"] for r in langid.label(docs.limit(3), nothing).collect()} == {"und"}
    assert langid.accepted(spark.createDataFrame(odd, "doc_id long, text string, score string"), model).columns == ["doc_id", "text", "score"]


@pytest.mark.parametrize("languages", [3, 1000])
def test_training_rows_are_bounded(spark, languages):
    docs = spark.range(languages * 30).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab c "), 500).alias("text"), F.concat(F.lit("l"), F.col("id") % languages).alias("lang"))
    docs = docs.unionByName(docs.where("doc_id = 1").select(F.lit(1).cast("long").alias("doc_id"), "text", F.explode(F.array_repeat("lang", 2000)).alias("lang")))  # one id, one language
    got = langid.training_rows(docs, per_language=10, most_chars=300_000).select("lang", F.length("text").alias("n")).groupBy("lang").agg(F.count("*").alias("k"), F.sum("n").alias("n")).collect()
    assert len(got) == languages and sum(r["n"] for r in got) <= 300_000 and max(r["k"] for r in got) <= 10
    assert min(r["k"] for r in got) >= (5 if languages == 3 else 1)


def test_every_language_and_letter(spark):
    rng = random.Random(6)
    own = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(63)]
    rows = [(100 * k + j, " ".join([w] * 5), f"l{k:02}") for k, w in enumerate(own) for j in range(20 if k < 62 else 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r["lang"]: r["lang_pred"] for r in langid.label(df, langid.train(df), carry=("lang",)).collect()} == {f"l{k:02}": f"l{k:02}" for k in range(63)}
    many = " ".join(chr(c) for c in (*range(0x61, 0x7B), *range(0x3B1, 0x3CA), *range(0x430, 0x450))) + " "
    texts = {"a": [many * 20], "b": ["აბგდ ბაგა გადა"], "c": ["ჰჯხჭ ჯაჰა ხაჭა"]}
    model = langid.Model(texts)
    odd = spark.createDataFrame([("b", "გადა ბაგა"), ("c", "ჭახა ჰაჯა"), ("a", "a b c")], "lang string, text string")
    assert all(r["lang"] == r["lang_pred"] for r in langid.label(odd, model, carry=("lang",)).collect())
    s = np.array([0, 2, 3, 2, 0, 3, 3, 2, 0])
    index, live = langid._triples(s, langid.SYMBOLS)
    table = langid.Model({"x": ["aba bba"]})
    assert np.array_equal(langid.Triples(index[live], langid.SYMBOLS, 2.0).logs(np.arange(64**3)), table.logs[:, 0])


@pytest.mark.parametrize("block", [1, 2, 3, 256])
def test_viterbi_is_best_path(block):
    rng = np.random.default_rng(0)
    scores = rng.normal(size=(7, 3)).astype(np.float32)
    labels = langid.viterbi(scores, np.array([3, 0, 4]), 0.7, block)
    for a, n in ((0, 3), (3, 4)):
        cost = lambda p: sum(scores[a + i, x] for i, x in enumerate(p)) - 0.7 * sum(x != y for x, y in zip(p, p[1:]))  # noqa: B023,E731
        assert cost(labels[a : a + n]) == pytest.approx(max(cost(p) for p in np.ndindex(*[3] * n)))


def test_viterbi_blocks():
    rng = np.random.default_rng(1)
    counts = np.array([1, 1023, 0, 1024, 5000, 3])
    n = counts.sum()
    scores = (rng.normal(size=(n, 4)) + np.repeat(rng.normal(size=(n // 50 + 1, 4)), 50, 0)[:n]).astype(np.float32)
    whole = langid.viterbi(scores, counts, 3.0, 10_000)
    assert len(set(whole)) == 4 and all(np.array_equal(whole, langid.viterbi(scores, counts, 3.0, b)) for b in (7, 256, 1024))
    assert langid.viterbi(np.zeros((3000, 3), np.float32), np.array([3000]), 1.0).tolist() == [0] * 3000  # ties: the first label


def test_very_long_text(spark, data, monkeypatch):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = langid.train(docs)
    texts = {r["lang"]: r["text"] for r in docs.where("lang IN ('en', 'fr')").collect()}
    long = (texts["en"] + " ") * 800 + texts["fr"] * 100 + " " + "x" * 5000
    points = langid.code_points(long + "\n")
    monkeypatch.setattr(langid, "SLICE", 10**9)
    whole = model.words(points)
    monkeypatch.setattr(langid, "SLICE", 10_000)
    starts, ends, scores = model.words(points)
    assert np.array_equal(whole[0], starts) and np.array_equal(whole[1], ends) and np.allclose(whole[2], scores, 1e-5)
    (row,) = langid.label(spark.createDataFrame([(1, long)], "doc_id long, text string"), model).collect()
    assert row["lang_pred"] == "en" and row["spans"][0]["lang"] == "en" and "fr" in {x["lang"] for x in row["spans"][-3:]}


def brute_jaccard(docs, n, percent):
    word, sets = re.compile(b"[^\x20\x09-\x0d]+"), []
    for _, t in docs:
        w = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in word.findall((t or "").encode())]
        sets.append(frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    parent = list(range(len(docs)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            least[top(k)] = min(least.get(top(k), 10**9), i)
    key = lambda x: -1 if x is None else x
    return sorted((key(i), len(sets[k]), key(least.get(top(k))) if sets[k] else key(i)) for k, (i, _) in enumerate(docs))


@pytest.mark.parametrize("n,percent,block", [(4, 85, 4000), (5, 80, 5)])
def test_jaccard(spark, n, percent, block):
    rng = random.Random(n)
    words, docs = ["w%d" % i for i in range(300)] + ["É", "Word,"], []
    for _ in range(8):
        base = [rng.choice(words) for _ in range(rng.choice([3, 8, 40, 120]))]
        for _ in range(rng.choice([2, 15])):
            w = list(base)
            for _ in range(rng.randrange(0, 6)):
                w[rng.randrange(len(w))] = rng.choice(words)
            docs.append((len(docs), rng.choice([" ", "\n", "  "]).join(w)))
    k = len(docs)
    docs += [(k, None), (k + 1, ""), (k + 2, " \n"), (k + 3, docs[0][1].upper()), (0, docs[0][1]), (None, docs[1][1]), (3, "other text altogether here now")]
    df = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, n int").repartition(4)
    key = lambda x: -1 if x is None else x
    assert sorted((key(r[0]), r[1], key(r[2])) for r in jaccard.classes(df, n, percent, block).collect()) == brute_jaccard(docs, n, percent)
    assert jaccard.classes(df.limit(0), n, percent).count() == 0


@pytest.mark.parametrize("n", [4, 5])
def test_few_words_alone(spark, n):
    for m in range(1, n + 2):
        text = " ".join(map(str, range(m))).encode()
        assert [len(s) for s in jaccard.shingles([b"", text, b"\n"], n)] == [0, max(1, m - n + 1), 0]
    docs = [(k, " ".join("abc"[:m])) for k, m in enumerate((1, 2, 3, 2, 3))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartitionByRange(5, "doc_id")  # each alone in its partition
    assert sorted(tuple(r)[:3] for r in jaccard.classes(df, n).collect()) == brute_jaccard(docs, n, 85)


def test_groups_whose_hash_sums_agree(spark):
    docs = [(k, f"a{i} b{i} {x}{i}") for k, (i, x) in enumerate((i, x) for i in (382245, 1761634, 96361, 1945964) for x in "cd")]  # found by search
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(tuple(r)[:3] for r in jaccard.classes(df, 1, 50).collect()) == brute_jaccard(docs, 1, 50)


def test_many_texts_under_one_id(spark):
    draw = np.random.default_rng(6)
    base = [" ".join(f"w{draw.integers(10**6)}" for _ in range(12)) for _ in range(8000)]
    rows = [(None, t) for t in base] + [(None, t + " more") for t in base[:500]] + [(7, t + " most") for t in base[:300]]
    got = jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), n=4, percent=75)
    sizes = Counter(r["n"] for r in got.groupBy("label").agg(F.count("*").alias("n")).collect())
    assert sizes == {3: 300, 2: 200, 1: 7500}


def test_each_pair_verified_once(spark):
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**63, (6, 90), dtype=np.uint64)
    sets = []
    for k in range(120):
        s = base[k % 6].copy()
        change = rng.random(90) < rng.choice([0.01, 0.04, 0.09])
        s[change] = rng.integers(0, 2**63, change.sum(), dtype=np.uint64)
        sets.append(np.unique(np.concatenate([s, rng.integers(0, 2**63, rng.integers(0, 9), dtype=np.uint64)])))
    counts = np.zeros((2, jaccard.SLOTS), np.uint32)
    for s in sets:
        for row, slot in zip(counts, jaccard._slots(s)):
            np.add.at(row, slot, 1)
    order = jaccard.Order(counts)
    linked = {(a, b) for b in range(120) for a in range(b) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 85 * len(np.union1d(sets[a], sets[b]))}
    dealt = jaccard.blocks(spark.range(120).withColumn("c", F.lit(1)), F.lit(4), "id")
    tasks, seen, forest = {}, [], []
    for r in dealt.orderBy("id").collect():
        tasks.setdefault((r["i"], r["j"]), []).append(r)
    assert len(tasks) == 6
    for rows in tasks.values():
        join = jaccard.Join([sets[r["id"]] for r in rows], order, 85, np.array([r["o"] for r in rows]), np.array([r["own"] for r in rows]))
        join.verified = []
        forest += [tuple(sorted((rows[a]["id"], rows[b]["id"]))) for a, b in jaccard._forest(len(rows), join.near)]
        seen += [tuple(sorted((rows[a]["id"], rows[b]["id"]))) for a, b in join.verified]
        join.verified = None
        for i in range(len(rows)):  # filters lose no link
            wanted = [k != i and (rows[k]["o"] != rows[i]["o"] or rows[i]["own"]) and tuple(sorted((rows[i]["id"], rows[k]["id"]))) in linked for k in range(len(rows))]
            assert np.flatnonzero(wanted).tolist() == [k for k in np.flatnonzero(join.near(i, np.arange(len(rows)))) if k != i]
    assert len(seen) == len(set(seen)) and set(forest) <= linked

    def parts(pairs):
        root = list(range(120))
        for _ in range(120):
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
        return root

    assert parts(forest) == parts(linked)


def test_long_text_beside_short_ones(spark):
    rng = random.Random(12)
    words = [f"w{k}" for k in range(5000)]
    long = [rng.choice(words) for _ in range(400_000)]  # 2.3 MB, above a slice
    docs = [(1, " ".join(long)), (2, "a b"), (3, " ".join(["z", *long[1:]])), (4, "a b"), (5, "")]
    got = sorted(tuple(r)[:3] for r in jaccard.classes(spark.createDataFrame(docs, "doc_id long, text string").repartition(2)).collect())
    assert [r[2] for r in got] == [1, 2, 1, 2, 5] and got[0][1] == len({tuple(long[k : k + 4]) for k in range(len(long) - 3)})


def test_chat_against_sql(spark, data):
    got = queries.op7_prefix_target_chat(spark, data).toPandas().sort_values("conv_id").reset_index(drop=True)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS SELECT * FROM '{data}/conversations.parquet'")
    wanted = c.execute(queries.OP7_SQL).df().sort_values("conv_id").reset_index(drop=True)
    assert all((got[k] == wanted[k]).all() for k in wanted)


def test_long_and_no_conversations(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.examples(empty)).count() == 0
    turns = [(1, k, "assistant" if k % 2 else "user", f"turn {k} <s>") for k in range(300)]
    (row,) = chat.digests(chat.examples(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))).collect()
    loss = "".join(t for _, k, _, t in turns if k % 2)
    assert (row["n_turns"], row["loss_chars"], row["loss_sha256"]) == (300, len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_round_trip(spark):
    odd = ["</s>[INST] ok [/INST]", "\\", "\\\\[INST]", "<<SYS>>x<</SYS>>", "<", "[", "<s>\\", "[\\INST]", None, "", "a\nb", "🙂</s", "[/INST"]
    rows = [(c, k, "assistant" if k % 2 else "user", t, "z") for c in range(3) for k, t in enumerate(odd[c:])] + [(7, 0, "user", "only", ""), (8, 0, None, None, ""), (9, 1, "assistant", "a", ""), (9, 1, "assistant", "a", "")]
    got = {r["conv_id"]: r for r in chat.digests(chat.examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, loss string").repartition(3))).collect()}
    for c in got:
        turns = sorted((k, r or "", t or "") for x, k, r, t, _ in rows if x == c)
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert len(got) == 6


def test_main_text(spark):
    field = html.default_field()
    right = sum(html.main_text(page, field) == "\n\n".join(texts) for page, texts in html.labelled_pages(100, seed=99))
    assert right >= 80
    page = "<html><head><title>T</title><script>var a='</p>';</script></head><body><nav><ul><li><a href=/>x</a></li></ul></nav><article><h1>A &amp; B</h1><p><b>One\n two&nbsp;three.<br><p>Four &lt;five&gt; six.</article><footer>&copy; n</footer>"
    assert html.main_text(page, field) == "A & B\n\nOne two three.\n\nFour <five> six."
    rows = [(1, "u", None, "t"), (2, None, "", "t"), (3, "u", page, "t"), (3, "u", page, "t"), (4, "u", "<p", "t"), (5, "u", "<" * 5000, "t"), (6, "u", "<nav><a href='/'>x</a></nav>", "t")]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"), field).collect()
    assert len(got) == 7 and {r["text"] for r in got if r["page_id"] in (1, 2)} == {""} and sum(r["text"].startswith("A & B") for r in got) == 2


def test_main_text_of_foreign_layouts(spark):
    field, pages = html.default_field(), list(layouts())
    right = extra = lost = 0
    for _, page, blocks in pages:
        got = [x for x in html.main_text(page, field).split("\n\n") if x]
        right += sum(x in blocks for x in got)
        extra += sum(x not in blocks for x in got)
        lost += sum(x not in got for x in blocks)
    assert right / (right + extra) >= 0.95 and right / (right + lost) >= 0.98  # blocks: precision, recall
    empty = spark.createDataFrame([], "page_id long, url string, html string, text string")
    assert html.extract(empty, field).count() == 0


BROKEN = {
    "unclosed": "<a " * 330_000, "names": "<a<a" * 250_000, "nested": "<div>ab" * 140_000, "own names": "".join(f"<x{k}>y" for k in range(100_000)), "ends of nothing": "<div>" * 100_000 + "</p>x" * 100_000,
    "raw text": "<svg>x" * 160_000, "open quotes": "<a '>' x" * 120_000 + '"', "behind a barrier": "<p><section>" + "<b>" * 100_000 + "<hr>x" * 100_000, "comments": "<!-- " * 200_000,
}


@pytest.mark.parametrize("name", sorted(BROKEN))
def test_broken_pages_take_linear_time(name):
    def seconds(page):
        began = time.process_time()
        html.leaf_blocks(page)
        return time.process_time() - began

    whole = BROKEN[name]
    assert len(whole) > 700_000 and seconds(whole) < 5
    assert "".join(b.text for b in html.leaf_blocks("<p>one</p>" + whole[:3000])).startswith("one")


def test_digits_of_whole_block():
    rows = html.features([html.Block(t, 0, "p", ("p",), ()) for t in ("12 " * 70 + "words " * 500, "word " * 50 + "1234 " * 200, "1 2")])
    assert ["digits" in r for r in rows] == [False, True, True]


def brute_repeats(docs, length):
    seen = {}
    for k, (_, t) in enumerate(docs):
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            seen.setdefault(b[p : p + length], []).append((k, p))
    cover = [bytearray(len((t or "").encode())) for _, t in docs]
    for places in seen.values():
        if len(places) > 1:
            for k, p in places:
                cover[k][p : p + length] = b"\1" * length
    out = []
    for (i, t), c in zip(docs, cover):
        b = (t or "").encode()
        out.append((-1 if i is None else i, len(b), sum(c), sum(1 for j in range(len(c)) if c[j] and (not j or not c[j - 1])), bytes(x for x, y in zip(b, c) if not y)))
    return sorted(out)


@pytest.mark.parametrize("length,gram,hot", [(40, 16, 50_000), (40, 16, 2), (24, 8, 50_000), (24, 8, 5)])
def test_repeats(spark, length, gram, hot):
    rng = random.Random(length + hot)
    base = ["".join(rng.choice("ab é") for _ in range(rng.choice([5, 30, 60, 200]))) for _ in range(12)]
    docs = [(k, "".join(rng.choice(base) for _ in range(rng.randrange(0, 8)))) for k in range(40)]
    docs += [(100, None), (101, ""), (102, "a" * 500), (103, "a" * 490), (None, docs[3][1]), (5, docs[5][1]), (5, "zz" + docs[5][1]), (104, "ab" * 300)]
    df = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, runs int").repartition(3)
    got = suffix.removed(df, length=length, gram=gram, hot=hot).collect()
    assert sorted((-1 if r[0] is None else r[0], *r[1:4], bytes(r[4])) for r in got) == brute_repeats(docs, length)


def test_same_anchors_in_any_batch():
    rng = random.Random(9)
    text = "".join(rng.choice("abc") for _ in range(3000)).encode()
    finder = suffix.Anchors(200, 64)
    _, at, g, c = finder.find([text])
    own, at2, g2, c2 = finder.find([bytes(rng.randrange(256) for _ in range(20_000)) for _ in range(40)] + [text])
    assert [x[own == 40].tolist() for x in (at2, g2, c2)] == [x.tolist() for x in (at, g, c)]


def test_repeats_empty_and_carried(spark):
    df = spark.createDataFrame([(1, "x" * 300, 5, "k"), (2, None, 6, "k")], "doc_id long, text string, n_chars long, v string")
    assert suffix.removed(df.limit(0)).count() == 0 and suffix.repeats(df).columns == ["doc_id", "text", "runs"]
    assert sorted(map(tuple, suffix.without_repeats(df).collect())) == [(1, "", 0, "k"), (2, "", 0, "k")]


def test_long_text_in_parts(monkeypatch):
    monkeypatch.setattr(suffix, "PART", 5000)
    rng = random.Random(2)
    text = "".join(rng.choice("abcd") for _ in range(23_000)).encode()
    finder = suffix.Anchors(200, 64)
    _, at, g, c = finder.find([text])
    assert [x.tolist() for x in finder.find_long(text)] == [x.tolist() for x in (at, g, c)]


def test_deep_shallow():
    rng = random.Random(3)
    strings = ["".join(rng.choice("ab") for _ in range(rng.randrange(0, 60))).encode() for _ in range(200)] + [b"a" * 50 + bytes([k % 3]) * (k % 7) for k in range(60)]
    for shallow in (0, 8, 32):
        order, shared = suffix.deep_shallow(strings, 0, shallow)
        assert [strings[i] for i in order] == sorted(strings)
        assert shared[1:] == [suffix.common(strings[a], strings[b]) for a, b in zip(order, order[1:])]


def test_pipeline_keeps_one_of_texts_with_one_id(spark, data):
    import corpus_pipeline as pipeline

    words = [f"w{k}" for k in range(60)]
    near = [" ".join(words), " ".join([*words[:-1], "x"]), " ".join(["y", *words[1:]])]
    rows = [(5, near[0], "a"), (5, near[1], "a"), (5, near[0], "a"), (7, near[2], "b"), (5, "other words stand here alone", "a"), (None, near[0], "c"), (8, "!", None), (None, "alone too but without any id", None), (9, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label string")
    got = sorted(map(tuple, pipeline.ngram_jaccard_join(spark, df, data).collect()), key=str)
    assert len(got) == 5 and sum(r[0] == 5 and r[1] in near for r in got) == 1 and not [r for r in got if r[0] == 7]
    assert {r[1] for r in got if r[0] != 5} == {"!", "alone too but without any id", None}
    assert pipeline.ngram_jaccard_join(spark, df.limit(0), data).count() == 0


def test_pipeline(spark, data, tmp_path):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet").limit(60)
    extra = spark.createDataFrame([(9001, None, None, None, None), (9002, "12 !!", "en", "s", 5)], docs.schema)
    docs, kept = docs.unionByName(extra).unionByName(docs.limit(1)), None
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, data).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        if k < 3:
            assert docs.columns == before.columns
        if k == 0:
            assert not docs.where("doc_id IN (9001, 9002)").count() and docs.count() == 61
        if k == 1:
            rows = [(r["doc_id"], r["text"]) for r in before.collect()]
            assert {r["doc_id"] for r in docs.collect()} == {i for i, _, c in brute_jaccard(rows, 5, 80) if i == c}
        if k == 2:
            wanted = {r[0]: r[4].decode("utf-8", "ignore") for r in brute_repeats([(r["doc_id"], r["text"]) for r in before.collect()], 200)}
            assert {r["doc_id"]: r["text"] for r in docs.collect()} == wanted
            kept = docs.count()
    assert docs.select("doc_id").distinct().count() == kept
