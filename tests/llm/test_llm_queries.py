"""Registered queries run over whole tables and give DuckDB's rows where SQL can express them, brute force elsewhere."""

import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from tidegauge.llm import queries

TABLES = ("documents", "embeddings", "pages", "conversations")


def rows(names, found):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted(tuple(str(r[k]) for k in order) for r in found)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(name, spark, data):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    got, wanted = queries.queries()[name](spark, data), c.execute(queries.oracle_sql()[name])
    assert rows(got.columns, got.collect()) == rows([x[0] for x in wanted.description], wanted.fetchall())


def test_token_queries(spark, data):
    docs = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect())
    word, byte = (Tokenizer.from_file(P.path(f)) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))
    at, wanted = 0, []
    for i, t in docs:
        ids = np.array([*word.encode(t, add_special_tokens=False).ids, 2], "<u4")
        wanted.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = queries.op2_bit_plane_files(spark, data).collect()
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got) == wanted
    packed = {(r["doc_id"], r["piece"]): r for r in queries.op6_exact_complement_packing(spark, data).collect()}
    n = 0
    for i, t in docs:
        ids = [*byte.encode(t, add_special_tokens=False).ids, 2]
        cuts = [0, *range(len(ids) % 1024 or min(len(ids), 1024), len(ids) + 1, 1024)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
            r, n = packed[i, p], n + 1
            assert (r["start"], r["length"], r["ids_crc32"]) == (a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))
    assert n == len(packed)


def test_other_queries(spark, data):
    docs, pages = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "pages"))
    got = queries.op4_viterbi_language_id(spark, data).toPandas()
    assert len(got) == docs.count() and got["score"].between(0, 1).all() and got["held_out"].any()
    got = queries.op8_crf_main_text(spark, data).toPandas()
    assert len(got) == pages.count() and (got["n_chars"] == got["text"].str.len()).all()
    assert queries.op3_rank_queue_bpe(spark, data).count() == docs.count()
