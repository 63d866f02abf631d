"""One query opN_<name> for each operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm import bpe, chat, fim, html, jaccard, langid, nearvec, packing, quality, suffix, token_files, topk, vector_codes
from tidegauge.llm.common import table


def op1_hyperplane_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearvec.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.9)


def op2_bit_plane_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = token_files.write_and_read(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), kind="word")
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_rank_queue_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    decoded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path, pattern), path, pattern)
    said = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(said.cast("binary"), 256).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256"))


def op4_viterbi_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labelled = langid.label(docs, langid.train(docs))
    return labelled.select("doc_id", F.coalesce(langid.held_out("doc_id"), F.lit(False)).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"), n=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op6_exact_complement_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op7_prefix_target_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.sql("SELECT -1L AS conv_id, t AS turn, r AS role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS x(t, r)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.digests(chat.examples(turns))


OP7_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
), m AS (
  SELECT *, role = 'assistant' AS target,
    length('[INST]' || regexp_replace(regexp_replace(replace(role, '\', '\\'), '<(/?s>|</?SYS>>)', '<\\\1', 'g'), '\[(/?INST\])', '[\\\1', 'g') || '[/INST]'
      || regexp_replace(regexp_replace(replace(text, '\', '\\'), '<(/?s>|</?SYS>>)', '<\\\1', 'g'), '\[(/?INST\])', '[\\\1', 'g') || '</s>') AS size,
    row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
), c AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM m)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (target), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (target), '')) AS loss_sha256,
  sum(upto) FILTER (target OR k = n)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""


def op8_crf_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_va_file_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integers(table(spark, sf_dir, "embeddings"), factor=256)
    return topk.search(vectors.where("vec_id % 50 = 0"), vectors, k=5)


OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CASE WHEN embedding IS NULL OR len(embedding) = 0 OR len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) > 0
    OR len(list_filter(embedding, lambda x: x <> 0)) = 0 THEN NULL ELSE embedding::DOUBLE[] END AS e FROM embeddings
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9
), r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.c AS component_id, c.c = v.vec_id AS kept
FROM v JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) c ON c.a = v.vec_id LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) n ON n.a = v.vec_id
"""

OP9_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.row, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
)
SELECT query_id, (row_number() OVER w)::INTEGER AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY row ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
"""


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.removed(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT DISTINCT k, md5(CASE WHEN len(w) >= 4 THEN array_to_string(w[i:i + 3], ' ') ELSE array_to_string(w, ' ') END) AS g
  FROM (SELECT k, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1)) + 1)) AS i FROM w)
), n AS (SELECT k, count(*) AS n FROM g GROUP BY k),
met AS (SELECT a.k AS a, b.k AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.k <> b.k GROUP BY 1, 2),
l AS (SELECT a, b FROM met JOIN n x ON x.k = a JOIN n y ON y.k = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT k AS a, k AS b FROM w UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.c, w.doc_id) AS component_id
FROM w LEFT JOIN n ON n.k = w.k JOIN (SELECT r.a, min(d.doc_id) AS c FROM r JOIN w d ON d.k = r.b GROUP BY r.a) c ON c.a = w.k
"""

OP10_SQL = """
WITH d AS (SELECT row_number() OVER () AS k, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
piece AS (SELECT k, a, substr(x, 2 * a + 1, 2 * 1223) AS p, length(x) // 2 AS n FROM (SELECT k, x, unnest(range(0, length(x) // 2, 1024)) AS a FROM d)),
place AS (SELECT k, a + i AS s, md5(substr(p, 2 * i + 1, 400)) AS h FROM (SELECT k, a, p, unnest(range(0, greatest(least(1024, n - 199 - a), 0))) AS i FROM piece)),
hit AS (SELECT k, s FROM place WHERE h IN (SELECT h FROM place GROUP BY h HAVING count(*) > 1)),
new AS (SELECT k, s, (s > lag(s) OVER w + 200)::INT AS new FROM hit WINDOW w AS (PARTITION BY k ORDER BY s)),
run AS (SELECT k, g, min(s) AS s, max(s) + 200 AS e FROM (SELECT k, s, sum(coalesce(new, 0)) OVER (PARTITION BY k ORDER BY s) AS g FROM new) GROUP BY 1, 2),
gap AS (SELECT d.k, string_agg(substr(d.x, 2 * r.f + 1, 2 * (r.t - r.f)), '' ORDER BY r.f) AS kept FROM d JOIN (
  SELECT k, coalesce(lag(e) OVER w, 0) AS f, s AS t FROM run WINDOW w AS (PARTITION BY k ORDER BY s) UNION ALL SELECT run.k, max(e), length(any_value(d.x)) // 2 FROM run JOIN d USING (k) GROUP BY run.k
) r ON r.k = d.k GROUP BY d.k)
SELECT d.doc_id, (length(d.x) // 2)::BIGINT AS n_bytes, coalesce(t.removed, 0)::BIGINT AS n_removed, coalesce(t.spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(gap.kept, d.x))) AS kept_sha256
FROM d LEFT JOIN gap ON gap.k = d.k LEFT JOIN (SELECT k, sum(e - s) AS removed, count(*) AS spans FROM run GROUP BY k) t ON t.k = d.k
"""


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transformed(table(spark, sf_dir, "documents"), seed=42)
    back = fim.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(back.cast("binary"), 256).alias("restored_sha256"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (
  SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
    ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d
), c AS (
  SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u
), p AS (
  SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m, coalesce(array_to_string(u[b + 1:n], ''), '') AS s FROM c
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""


def op12_isolation_forest_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "bucket")


def op13_annular_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    books = vector_codes.fit(vectors, parts=8, entries=16, rounds=6, factor=4096)
    coded = vector_codes.with_label_errors(vector_codes.encode(vectors, books, factor=4096))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))


def _op13_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """One pair of expressions a round: parts with their nearest entries, then the entries' new means."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT rn, part, arg_min(entry, d * {entries} + entry) AS entry, min(d) AS d
  FROM (SELECT p.rn, p.part, c.entry, (list_inner_product(x, x) - 2 * list_inner_product(x, y) + list_inner_product(y, y))::HUGEINT AS d FROM p JOIN c{r} c USING (part)) GROUP BY rn, part
)""")
        if r < rounds:
            steps.append(f"""m{r} AS (
  SELECT part, entry, list(m ORDER BY i) AS y FROM (
    SELECT part, entry, i, floor(sum(x[i])::DOUBLE / count(*)) AS m FROM a{r} JOIN p USING (rn, part), range(1, len(x) + 1) t(i) GROUP BY part, entry, i
  ) GROUP BY part, entry
), c{r + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(m.y, c.y) AS y FROM c{r} c LEFT JOIN m{r} m USING (part, entry))""")
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS rn, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (SELECT rn, part, e[part * (len(e) // {parts}) + 1:(part + 1) * (len(e) // {parts})] AS x FROM v, range({parts}) t(part)),
c0 AS (SELECT part, rn - 1 AS entry, x AS y FROM p WHERE rn <= {entries}), {", ".join(steps)},
h AS (SELECT sha256(string_agg(array_to_string(list_transform(y, lambda z: z::BIGINT), ','), ',' ORDER BY part, entry)) AS h FROM c{rounds}),
r AS (SELECT rn, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY rn)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM v JOIN r USING (rn), h
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op1_hyperplane_near_dedup": OP1_SQL, "op5_ngram_jaccard_join": OP5_SQL, "op10_suffix_array_dedup": OP10_SQL, "op9_va_file_topk": OP9_SQL, "op7_prefix_target_chat": OP7_SQL, "op11_fill_in_middle": OP11_SQL, "op13_annular_vector_codes": _op13_sql()}
