"""Id files, rank-queue BPE and packing: against the libraries and exact round trips."""

import io
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from tidegauge.llm import bpe, packing, token_files
from tidegauge.llm.library_tokens import LibraryEncoder

ODD = [
    None, "", " ", "  a  b ", "\n\n x\ty", "don't I'LL  we’ll", "日本語 テスト é́  ẞ Σας ΟΔΟΣ", "1234 ²³ ½ <|endoftext|>", "a\xa0b c d", "x  \n  y", "\x1c \x1d a", "'s 's'S", "naïve—dash “q”", "🙂🙂 ok",
    " lead", "trail ", "İI", "<|endoftext|>", "a <|endoftext|> b", "A<|EndOfText|>b  <|startoftext|>x<|endoftext|><|endoftext|>  y", " <|endoftext|> ", "a\x85b \x85 c", "a" * 3000, "ab" * 2000 + " !!!??", "word, Word. WORD; word", "</s>[INST] ok",
]


@pytest.fixture(scope="module")
def texts(spark, data):
    return ODD + [r[0] for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect()]


def packed(ids):
    return np.array(ids, "<u4").tobytes()


@pytest.mark.parametrize("file,kind", [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_library_encoder(texts, file, kind):
    whole = Tokenizer.from_file(P.path(file))
    plain = [t or "" for t in texts]
    wanted = [packed(e.ids) for e in whole.encode_batch(plain, add_special_tokens=False)]
    own = LibraryEncoder(P.path(file), kind, P.PATTERN, entries=500)  # small: everything is forgotten and met again
    assert own.encode(plain) == wanted
    assert [own.encode([t])[0] for t in plain[:60]] == wanted[:60]


def test_word_ids_of_mixed_signs():
    """Letters, signs and white space in any order, as the library's plain call gives them."""
    parts, draw = ["a", "B", "É", "İ", "Σ", "œ", "ß", "ª", "日", "e\u0301", "1", "²", "_", '"', "\x1c", "\x85", "\xa0", " ", "\n", "\n\n", "\r\n", "\t", ".", ". ", ", ", "! ", "?! ", "...  ", ": ", "'s", "'S ", "<|endoftext|>"], random.Random(5)
    mixed = ["".join(draw.choices(parts, k=draw.randint(0, 14))) for _ in range(20_000)]
    path = P.path("word_bpe_49k.json")
    want = [np.array(x.ids, "<u4").tobytes() for x in Tokenizer.from_file(path).encode_batch(mixed, add_special_tokens=False)]
    assert LibraryEncoder(path, "word", "").encode(mixed) == want


def test_rank_queue(texts):
    own = bpe.encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    rng = random.Random(1)
    made = ["".join(rng.choice(["a", "b", "th", "e ", " ", "the", "ing", "é", "日", "!", "\n", "1", ".", "aaaa", "'s"]) for _ in range(rng.randrange(40))) for _ in range(500)]
    plain = [t or "" for t in texts] + made + ["x" * 20_000, "".join(rng.choice("abcdef") for _ in range(20_000))]
    got = own.encode(plain)
    assert got == [packed(ref.encode_ordinary(t)) for t in plain]
    assert [own.decode(np.frombuffer(b, "<u4")) for b in got] == [t.encode() for t in plain]


def test_rank_queue_frame(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "the end", 6), (2, "the end", 6)], "doc_id long, text string, ids int")
    path = P.path("byte_bpe_50k.tiktoken")
    out = bpe.decode(bpe.encode(df, path, P.PATTERN), path, P.PATTERN).collect()
    assert sorted((r["doc_id"], bytes(r["data"])) for r in out) == [(1, b""), (2, b"the end"), (2, b"the end")]
    assert bpe.encode(df.limit(0), path, P.PATTERN).count() == 0


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_planes(kind):
    rng = np.random.default_rng(0)
    for n in (1, 7, 8, 1000):
        for high in (1, 2, 300, 2**32):
            ids = rng.integers(0, high, n, dtype=np.uint64).astype(np.uint32)
            assert token_files.from_planes(token_files.to_planes(ids, kind), n, kind).tolist() == ids.tolist()
    docs = [(k, packed(rng.integers(0, 50_000, rng.integers(0, 400)))) for k in range(30)]
    out = io.BytesIO()
    out.close_really, out.close = out.close, lambda: None
    w = token_files.PlaneWriter(out, kind, block=64)
    for d in docs:
        w.add(*d)
    w.close()
    source = io.BytesIO(out.getvalue())
    source.size = lambda: len(out.getvalue())
    assert list(token_files.PlaneReader(source).documents()) == docs


def test_id_files(spark, texts):
    rows = [(1000 - k, t, k) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(3)
    got = sorted(map(tuple, token_files.write_and_read(df, P.path("word_bpe_49k.json"), kind="word", block=512).collect()))
    whole, at, wanted = Tokenizer.from_file(P.path("word_bpe_49k.json")), 0, []
    for doc_id, t, _ in sorted(rows, key=lambda r: r[0]):
        ids = packed([*whole.encode(t or "", add_special_tokens=False).ids, 2])
        wanted.append((doc_id, at, len(ids) // 4, ids))
        at += len(ids) // 4
    assert [(a, b, c, bytes(d)) for a, b, c, d in got] == wanted
    assert token_files.write_and_read(df.limit(0), P.path("word_bpe_49k.json")).count() == 0
    same = spark.createDataFrame([(7, f"w {k % 50}") for k in range(4000)] + [(8, None)], "doc_id long, text string").repartition(4)
    manifest = token_files.write_id_files(same, P.path("word_bpe_49k.json"), file_ids=500)
    assert manifest.where("n_docs > 1500").count() == 0  # one id in many files
    rows = sorted(token_files.read_id_files(manifest).collect(), key=lambda r: r["start"])
    ends = [r["start"] + r["n_tokens"] for r in rows]
    assert len(rows) == 4001 and [r["start"] for r in rows] == [0, *ends[:-1]] and rows[-1]["doc_id"] == 8


def check_packing(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing(spark, texts):
    df = spark.createDataFrame([(k % 90, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, length int").repartition(3)
    rows = packing.pack_documents(df, P.path("byte_bpe_50k.json"), P.PATTERN).collect()
    whole = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    wanted = []
    for k, t in enumerate(texts):
        ids = packed([*whole.encode(t or "", add_special_tokens=False).ids, 2])
        n = len(ids) // 4
        cuts = [0, *range(n % 1024 or min(n, 1024), n + 1, 1024)]
        wanted += [(k % 90, p, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for p, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted(tuple(r)[:5] for r in rows) == sorted(wanted)
    assert check_packing(rows, 1024) <= 1.1 * sum(w[3] for w in wanted) / 1024 + 1
    assert packing.pack_documents(df.limit(0), P.path("byte_bpe_50k.json"), P.PATTERN).count() == 0


def test_plan_places_everything():
    rng = random.Random(4)
    for _ in range(30):
        capacity = rng.choice([8, 20, 64])
        histogram = {rng.randint(1, capacity): rng.randint(1, 40) for _ in range(rng.randint(0, 12))}
        used = defaultdict(int)
        for pattern, n in packing.plan(histogram, capacity):
            assert n > 0 and sum(a * b for a, b in pattern) <= capacity
            for length, copies in pattern:
                used[length] += copies * n
        assert used == histogram
    assert sum(n for _, n in packing.plan({6: 10, 4: 10, 3: 5, 2: 5, 5: 5}, 10)) == 15
