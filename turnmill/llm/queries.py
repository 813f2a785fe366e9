"""The queries of this subpackage, over whole tables with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, backoff, minhash, mixing, negatives, packing, parity, pii, resample, topk, toxicity, wavelet, whitening
from .common import saved, shared_dir, table


def op1_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/turnmill-wavelet-{uuid.uuid4().hex}"
    wavelet.write_shards(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return wavelet.documents_from_shards(spark, path)


def op2_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op3_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.scored(docs, model)
    return scored.select("row.doc_id", toxicity.held_out(F.col("row.doc_id")).alias("held_out"), "score", "predicted")


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.annotated(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", pii.listed(F.col("_spans")).alias("spans"))


def op6_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff.scores(table(spark, sf_dir, "documents"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op8_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = audio.store(table(spark, sf_dir, "documents"))
    return audio.described(saved(audio.decoded(files), "pcm", audio.LEVEL))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    digest = cut.select("doc_id", "piece", "start", "length", "part", "nth", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(digest).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.searched(table(spark, sf_dir, "embeddings"))


def op11_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity.joined(table(spark, sf_dir, "documents"), width=4, percent=85)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mined(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_wavelet_tokens, op2_minhash_near_duplicates, op3_importance_resampling, op4_subword_toxicity, op5_personal_data,
        op6_stupid_backoff, op7_source_mixing, op8_telephony_audio, op9_best_fit_packing, op10_top_k,
        op11_parity_join, op12_embedding_whitening, op13_hard_negatives,
    )
}

SQL: dict[str, str] = {
    "op6_stupid_backoff": r"""
WITH words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
tokens AS (SELECT doc_id, unnest(w) AS w, unnest([NULL] || w[1:len(w) - 1]) AS v FROM words WHERE len(w) > 0),
one AS (SELECT w, count(*) AS c FROM tokens GROUP BY w),
pair AS (SELECT v, w, count(*) AS c FROM tokens WHERE v IS NOT NULL GROUP BY v, w),
n AS (SELECT count(*) AS n FROM tokens),
scored AS (
  SELECT t.doc_id, count(*) AS k, sum(ln(CASE WHEN t.v IS NULL THEN a.c / n.n WHEN p.c >= 2 THEN p.c / b.c ELSE 0.4 * a.c / n.n END)) AS s
  FROM tokens t JOIN one a ON t.w = a.w LEFT JOIN one b ON t.v = b.w LEFT JOIN pair p ON p.v = t.v AND p.w = t.w CROSS JOIN n
  GROUP BY t.doc_id)
SELECT d.doc_id, coalesce(k, 0) AS n_words, round(coalesce(s, 0), 4) AS log_score, round(s / k, 6) AS mean_score
FROM words d LEFT JOIN scored USING (doc_id)""",
    "op10_top_k": r"""
WITH ready AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM ready q JOIN ready c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 10""",
    "op13_hard_negatives": r"""
WITH ready AS (
  SELECT row_number() OVER () AS row_no, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, c.row_no, a.label = c.label AS same, CAST(list_sum(list_transform(list_zip(a.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM ready a JOIN ready c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
positives AS (SELECT anchor_id, vec_id, row_no, score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.row_no ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY rank <= 10""",
    "op2_minhash_near_duplicates": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
  FROM words),
held AS (SELECT doc_id, len(s) AS n, unnest(s) AS v FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM held a JOIN held b ON a.v = b.v AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.b) AS component_id, s.doc_id = min(r.b) AS kept
FROM sets s JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, len(s.s)""",
    "op11_parity_join": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
  FROM words),
held AS (SELECT doc_id, len(s) AS n, unnest(s) AS v FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM held a JOIN held b ON a.v = b.v AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.b) AS component_id
FROM sets s JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, len(s.s)""",
}
