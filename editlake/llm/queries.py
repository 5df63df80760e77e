"""Registered queries of this subpackage: one ``opN_<name>`` per operator, over
its whole table, with production parameters, and the DuckDB text of those that
SQL can express. A query derives its digest columns from the operator's rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (backoff, byte_bpe, edit_counts, hard_negatives, language, licenses, mixing, neighbours, packing, periodic, quality,
               simhash, wavelet)
from .common import documents, new_folder

Query = Callable[[SparkSession, str], DataFrame]


#: Vocabulary files of the queries; operators take them as parameters.
BYTE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language.learn(docs, language.may_learn())
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("row.doc_id", "language").select("doc_id", language.held_out("doc_id").alias("held_out"), "language.*")


def op2_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "wavelet")
    wavelet.write(documents(spark, sf_dir), folder, WORD_TOKENIZER, end_id=1)
    return wavelet.documents_of(wavelet.read(spark, folder))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(documents(spark, sf_dir).select("doc_id", "text"))
    return judged.select("row.doc_id", "quality.*").drop("rejected_by")


def op4_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    revised = edit_counts.revisions(documents(spark, sf_dir).select("doc_id", "text"))
    return edit_counts.count(revised, BYTE_RANKS, public_tokenizers.PATTERN).select("row.doc_id", "counts.*")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir), shingle=4, max_bits=4, seed=42)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(documents(spark, sf_dir), BYTE_RANKS, public_tokenizers.PATTERN)


def op7_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = backoff.score(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", F.round("log_score", 6).alias("log_score"))


OP7_SQL = """
WITH t AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT r, i, w[i] AS b, CASE WHEN i > 1 THEN w[i - 1] END AS a
      FROM t, unnest(generate_series(1, len(w))) AS u(i)),
uni AS (SELECT b, count(*) AS c FROM g GROUP BY b),
his AS (SELECT a, count(*) AS c FROM g GROUP BY a),
bi AS (SELECT a, b, count(*) AS c FROM g GROUP BY a, b),
n AS (SELECT count(*) AS n FROM g),
s AS (SELECT g.r, count(*) AS n_words,
             sum(CASE WHEN bi.c >= 2 THEN ln(bi.c::DOUBLE / his.c) ELSE ln(0.4 * uni.c / n.n) END) AS s
      FROM g JOIN bi ON g.a IS NOT DISTINCT FROM bi.a AND g.b = bi.b
             JOIN his ON g.a IS NOT DISTINCT FROM his.a JOIN uni ON g.b = uni.b CROSS JOIN n
      GROUP BY g.r)
SELECT t.doc_id, coalesce(s.n_words, 0)::BIGINT AS n_words, round(coalesce(s.s, 0), 6)::DOUBLE AS log_score
FROM t LEFT JOIN s ON t.r = s.r
"""


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.search(documents(spark, sf_dir).select("doc_id", "text")).select("row.doc_id", "found.*")
    base, spans = F.col("base"), F.col("spans")
    both = F.array_union(F.transform(base, lambda b: b["label"]), F.transform(spans, lambda s: s["label"]))
    listed = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        "doc_id", "n_words", F.size(base).cast("bigint").alias("n_base"),
        F.array_min(F.transform(base, lambda b: b["word"])).alias("first_word"),
        F.array_max(F.transform(base, lambda b: b["word"])).alias("last_word"),
        listed(F.transform(base, lambda b: b["label"])).alias("base_labels"), listed(both).alias("labels"),
        F.when(F.size(base) > 0, F.lit(1.0)).otherwise(
            F.coalesce(F.array_max(F.transform(spans, lambda s: s["score"])), F.lit(0.0))).alias("score"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda i: i % 20 == 0, k=20)


OP9_SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score
      FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).drop("copies")


OP10_SQL = """
WITH d AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS k, md5(text) AS t
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
             row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS rnk FROM d GROUP BY source),
w AS (SELECT *, CASE rnk % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 3 * source_size AS cap FROM s),
f AS (SELECT *, cap::DOUBLE / w AS full_at FROM w),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0))::BIGINT AS num,
             (sum(w) OVER () - coalesce(sum(w) OVER o, 0))::BIGINT AS den
      FROM f WINDOW o AS (ORDER BY full_at, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lev AS (SELECT num, den FROM l WHERE full_at > num::DOUBLE / den ORDER BY full_at, rnk LIMIT 1),
tg AS (SELECT f.source, f.source_size, coalesce(least(f.cap::DOUBLE, f.w * lev.num::DOUBLE / lev.den), f.cap::DOUBLE) AS target
       FROM f LEFT JOIN lev ON true),
r AS (SELECT d.*, tg.source_size, tg.target,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id NULLS FIRST, d.t NULLS FIRST
                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS cum
      FROM d JOIN tg ON d.source IS NOT DISTINCT FROM tg.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0::BIGINT
            ELSE (size * (floor(target)::BIGINT // source_size
                  + CASE WHEN 2 * cum - size <= 2 * (floor(target)::BIGINT % source_size) THEN 1 ELSE 0 END))::BIGINT
       END AS taken
FROM r
"""


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("bigint")
    label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives.mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda i: i % 50 == 0, label=label)


OP11_SQL = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r, a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score
      FROM v a JOIN v c ON a.r <> c.r WHERE a.vec_id % 50 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS nth FROM s WHERE same),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.r, p.nth ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
      FROM p JOIN s ON p.r = s.r AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
      WHERE p.nth <= 5)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = periodic.with_echoes(documents(spark, sf_dir).select("doc_id", "text"))
    return periodic.digests(periodic.periodic_runs(planted))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(documents(spark, sf_dir), BYTE_TOKENIZER, end_id=0, max_length=1024, keep_ids=False)
    return packed.select("doc_id", "start", F.col("length").cast("bigint").alias("length"), "ids_crc32", "doc_tokens",
                         "sequence_id", "offset")


QUERIES: dict[str, Query] = {
    "op1_language": op1_language,
    "op2_wavelet": op2_wavelet,
    "op3_quality": op3_quality,
    "op4_edit_counts": op4_edit_counts,
    "op5_simhash": op5_simhash,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_backoff": op7_backoff,
    "op8_licenses": op8_licenses,
    "op9_neighbours": op9_neighbours,
    "op10_mixing": op10_mixing,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_periodic": op12_periodic,
    "op13_packing": op13_packing,
}
ORACLES: dict[str, str] = {"op7_backoff": OP7_SQL, "op9_neighbours": OP9_SQL, "op10_mixing": OP10_SQL,
                           "op11_hard_negatives": OP11_SQL}
