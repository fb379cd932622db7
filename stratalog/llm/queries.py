"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers as tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, licenses, mixing, neardup, pii, quality, rules, shards, urls
from .common import read


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"), keep=["doc_id"]).select("doc_id", "mix.*")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    model = quality.fit(documents, read(spark, sf_dir, "labels"))
    scored = quality.classify(documents, model)
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents"), tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(read(spark, sf_dir, "documents"), keep=["doc_id"])
    count = lambda kind: F.size(F.filter("pii.base", lambda s: s["rank"] == list(pii.PATTERNS).index(kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, pii.PATTERNS), F.sha2(pii.shown(F.col("pii.base")), 256).alias("base_sha256"), pii.shown(F.col("pii.spans")).alias("spans"))


def op5_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shards.new_folder(spark)
    manifest = shards.write_shards(read(spark, sf_dir, "documents"), tokenizers.path("word_bpe_49k.json"), folder)
    return shards.read_shards(manifest, folder)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_filter(read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.quality_rules(read(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged.select("doc_id", *[f"rules.{x}" for x in names])


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


QUERIES = {
    f.__name__: f
    for f in (
        op1_mix_sources,
        op2_quality_classifier,
        op3_byte_bpe,
        op4_personal_data,
        op5_token_shards,
        op6_url_filter,
        op7_license_scan,
        op8_quality_rules,
        op9_nearest_neighbours,
        op10_near_duplicates,
    )
}
# Literals with exponents are doubles; others would be decimals.
MIX_SQL = r"""
WITH D AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
S AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM D GROUP BY source),
W AS (SELECT *, 2e0 * source_size AS most,
  CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 3e0 WHEN 1 THEN 1e0 ELSE 2e0 END AS w FROM S),
C AS (SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total,
  coalesce(sum(most) OVER (ORDER BY most / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS before_,
  sum(w) OVER (ORDER BY most / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM W),
T AS (SELECT source, source_size, least(most, max((15e-1 * total - before_) / rest) OVER () * w) AS target FROM C),
P AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS passes FROM T),
H AS (SELECT source, h, CAST(sum(size) AS BIGINT) AS n FROM D GROUP BY ALL),
U AS (SELECT *, CAST(sum(n) OVER (PARTITION BY source ORDER BY h) AS BIGINT) - n AS below FROM H)
SELECT D.doc_id, D.size, P.source_size, P.target,
  CAST(D.size * (P.passes + CASE WHEN U.below + U.n / 2e0 <= P.target - P.passes * P.source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM D JOIN P ON D.source IS NOT DISTINCT FROM P.source JOIN U ON U.source IS NOT DISTINCT FROM D.source AND U.h = D.h
"""

# Character classes as the operator tells them apart, with what is left of the text when the others are taken out.
RULES_SQL = r"""
WITH D AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t FROM documents),
W AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM D),
M AS (SELECT r, doc_id, lang, w, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
  [length(regexp_replace(t, '[^A-Z]+', '', 'g')), length(regexp_replace(t, '[^0-9]+', '', 'g')), length(regexp_replace(t, '[^.,;:''\x22()?-]+', '', 'g')),
    length(regexp_replace(t, '[^!#*$%&|<>@_~^=+\x5C/\x5B\x5D{}\x60]+', '', 'g')), length(t) - length(array_to_string(w, '')), length(regexp_replace(t, '[^a-z]+', '', 'g')), length(t)] AS c FROM W),
V AS (SELECT r, i, array_to_string(w[i : i + 7], ' ') AS k FROM M, unnest(range(1, len(w) - 6)) u(i)),
S AS (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS j FROM (SELECT *, count(*) OVER (PARTITION BY r, k) AS n FROM V) WHERE n > 1),
P AS (SELECT r, CAST(sum(least(8, coalesce(j - i, 8))) AS BIGINT) AS n_repeat_words FROM S GROUP BY r),
L AS (SELECT D.r, D.lang, unnest(regexp_extract_all(lower(t), '[^\x20\x09-\x0D]+')) AS word FROM D),
C AS (SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word) AS place FROM L GROUP BY lang, word QUALIFY place <= 30),
H AS (SELECT L.r, coalesce(C.place, 0) AS i, CAST(count(*) AS DOUBLE) AS n FROM L LEFT JOIN C ON C.lang IS NOT DISTINCT FROM L.lang AND C.word = L.word GROUP BY ALL),
K AS (SELECT r, lang, 'c' AS kind, i, CAST(CASE WHEN i < 7 THEN c[i] ELSE c[7] - list_sum(c[1:6]) END AS DOUBLE) AS n FROM M, unnest(range(1, 8)) u(i)
  UNION ALL SELECT M.r, M.lang, 'w', G.i, coalesce(H.n, 0) FROM M JOIN (SELECT lang, place AS i FROM C UNION ALL SELECT DISTINCT lang, 0 FROM C) G ON G.lang IS NOT DISTINCT FROM M.lang LEFT JOIN H ON H.r = M.r AND H.i = G.i),
Q AS (SELECT lang, kind, i, sum(n) AS q FROM K GROUP BY ALL), T AS (SELECT lang, kind, sum(q) AS tq FROM Q GROUP BY ALL),
X AS (SELECT K.r, K.kind, K.n / nullif(sum(K.n) OVER (PARTITION BY K.r, K.kind), 0) AS p, Q.q / nullif(T.tq, 0) AS q FROM K JOIN Q ON Q.lang IS NOT DISTINCT FROM K.lang AND Q.kind = K.kind AND Q.i = K.i JOIN T ON T.lang IS NOT DISTINCT FROM K.lang AND T.kind = K.kind),
J AS (SELECT r, kind, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)) AS js FROM X WHERE p IS NOT NULL AND q IS NOT NULL GROUP BY ALL),
F AS (SELECT r, max(CASE WHEN kind = 'c' THEN js END) AS jc, max(CASE WHEN kind = 'w' THEN js END) AS jw FROM J GROUP BY r),
R AS (SELECT lang, sum(n_words) AS total FROM M GROUP BY lang),
A AS (SELECT M.doc_id, M.n_words, M.word_chars, M.n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(P.n_repeat_words, 0) AS n_repeat_words,
  M.n_words < 20 OR 100 * coalesce(P.n_repeat_words, 0) > 30 * M.n_words AS base_failed,
  M.n_words >= 40 AND R.total >= 2000 AND (coalesce(F.jc, 0) > 0.30 OR coalesce(F.jw, 0) > 0.42) AS far
  FROM M JOIN R ON R.lang IS NOT DISTINCT FROM M.lang LEFT JOIN P USING (r) LEFT JOIN F USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT far AS kept FROM A
"""

ORACLE_SQL: dict[str, str] = {"op1_mix_sources": MIX_SQL, "op8_quality_rules": RULES_SQL}
