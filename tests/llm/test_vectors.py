"""Hyperplane near-dedup, exact top-k, components: against brute force, with nulls, ties, repeats and clashing columns."""

import numpy as np
import pytest

from tidegauge.llm import components, nearvec, topk


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    base = rng.standard_normal((20, 16))
    out = []
    for k in range(250):
        v = base[rng.integers(20)] + rng.standard_normal(16) * rng.choice([0, 0.1, 0.25])
        out.append((k, [float(np.float32(x)) for x in v], "x", k % 3))
    return out + [(300, None, "n", 0), (301, [0.0] * 16, None, 0), (302, [float("nan")] + [1.0] * 15, "", 1), (303, [None] + [1.0] * 15, "", 1), (350, out[1][1], "", 2), (350, out[1][1][:8], "", 2), (400, [], "", 0), (450, out[0][1], "", 0)]


SCHEMA = "vec_id long, embedding array<float>, c string, n int"


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v)


def test_near_duplicates(spark, rows):
    good = [(i, np.array(v, float)) for i, v, *_ in rows if usable(v) and any(v)]
    links, parent = {}, {i: i for i, *_ in rows}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, v) in enumerate(good):
        for j, w in good[:a]:
            if len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.9 and i != j:
                links[i], links[j] = links.get(i, 0) + 1, links.get(j, 0) + 1
                parent[max(top(i), top(j))] = min(top(i), top(j))
    wanted = sorted((i, links.get(i, 0), top(i)) for i, *_ in rows if i != 350)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for block in (2000, 20):
        got = nearvec.near_duplicates(df, block=block)
        assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
        have = sorted((r[0], r[1], r[2]) for r in got.where("vec_id <> 350").collect())
        assert have == wanted  # a pair at cosine 0.9 is missed once in 10,000 times
    assert nearvec.near_duplicates(df.limit(0)).count() == 0


def test_topk(spark, rows):
    v = [(i, np.floor(256 * np.array(x, float)).astype(int)) for i, x, *_ in rows if usable(x)]
    wanted = []
    for i, q in v:
        if i % 50 == 0:
            best = sorted((-int(q @ w), j) for j, w in v if j != i and len(w) == len(q))[:5]
            wanted += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    df = topk.integers(spark.createDataFrame(rows, SCHEMA).repartition(3))
    for q, b in ((512, 8192), (3, 40)):
        got = topk.search(df.where("vec_id % 50 = 0 AND vec_id <> 350"), df, 5, q, b)
        assert sorted(map(tuple, got.collect())) == sorted(r for r in wanted if r[0] != 350)
    assert topk.search(df.limit(0), df, 5).count() == 0


def test_repeated_queries_have_a_list_each(spark):
    draw = np.random.default_rng(12)
    rows = [(i, [float(x) for x in draw.integers(-9, 9, 4)]) for i in (50, 50, 50, 100, 1, 2, 3, 3, 4, 5)]
    rows[2] = rows[1]  # one of them twice
    df = topk.integers(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3), factor=1)
    wanted = []
    for i, q in rows:
        if i % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in rows if j != i)[:5]
            wanted += [(i, k + 1, j, int(-s)) for k, (s, j) in enumerate(best)]
    for q, b in ((512, 8192), (1, 2)):
        assert sorted(map(tuple, topk.search(df.where("vec_id % 50 = 0"), df, 5, q, b).collect())) == sorted(wanted)


def test_vector_file_reads_few_vectors():
    import io

    rng = np.random.default_rng(3)
    v = rng.integers(-300, 300, (3000, 16)).astype(float)
    out = io.BytesIO()
    topk.VectorFile.write(out, np.arange(3000), v)
    q = rng.integers(-300, 300, (20, 16)).astype(float)
    for x in q:
        file = topk.VectorFile(io.BytesIO(out.getvalue()), 3000, 16)
        bound = file.bounds(x[None])[0]
        assert (bound >= v @ x).all()
        best = file.search(x.astype(np.int64), 7, bound, [], 5)
        scores = sorted((-int(s), i) for i, s in enumerate(v @ x) if i != 7)[:5]
        assert best == scores and file.have.sum() < 600
        assert file.search(x.astype(np.int64), 7, bound, [(-(10**9), -1)] * 5, 5) == [(-(10**9), -1)] * 5


def test_topk_wide(spark):
    big = float(np.float32(3e38))
    rows = [(0, [1.0, 2.0]), (1, [70000.0, -1.5]), (2, [0.5, 0.25]), (3, [-big, 1.0]), (50, [2.0**40, 3.0]), (51, [2.0**40, 3.0]), (52, [-1.0, 9.0]), (100, [big, big])]
    v = [(i, [int(np.floor(256 * x)) for x in e]) for i, e in rows]
    df = topk.integers(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(2))
    for q, b in ((512, 8192), (1, 3)):
        wanted = []
        for i, x in v:
            if i % 50 == 0:
                best = sorted((-sum(a * c for a, c in zip(x, y)), j) for j, y in v if j != i)[:4]
                wanted += [(i, k + 1, j, -s if abs(s) < 2**63 else None) for k, (s, j) in enumerate(best)]
        assert sorted(map(tuple, topk.search(df.where("vec_id % 50 = 0"), df, 4, q, b).collect())) == wanted


def test_components(spark):
    links = [(5, 4), (4, 3), (3, 2), (9, 8), (7, 7), (2, 2), (4, 5), (None, 1), (20, 30), (30, 10)] + [(100, k) for k in range(101, 140)]
    got = dict(map(tuple, components.components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()))
    assert got == {2: 2, 3: 2, 4: 2, 5: 2, 8: 8, 9: 8, 10: 10, 20: 10, 30: 10} | {k: 100 for k in range(100, 140)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
