"""The ``opN_*`` queries: thin digests of the operators over their whole tables, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronlake.llm import audio, bpe, jaccard, langid, licenses, lm, mixing, quality, secrets, urls
from heronlake.llm.common import crc_of, table, words_column

URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


@lru_cache(maxsize=1)
def vocabulary() -> tuple[str, str]:
    """The path of the rank file and the pattern of the public tokenizer."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), words_column(F.col("text")))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    owner = F.substring_index("source", "/", 1)
    found = secrets.scan_owned(table(spark, sf_dir, "documents"), F.col("source"), owner)
    base = F.filter("spans", lambda s: ~s["kind"].isin("owned", "shared"))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(secrets.digest(base).cast("binary"), 256).alias("base_sha256"), secrets.digest(F.col("spans")).alias("spans"), F.array_join(F.transform("spans", lambda s: s["status"]), ",").alias("statuses"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["license"]))), ",")
    return found.select("doc_id", F.size("spans").cast("long").alias("n_matches"), names.alias("licenses"), licenses.digest(F.col("spans")).alias("spans"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = urls.train(urls.labelled_urls(spark))
    return urls.judge(table(spark, sf_dir, "pages"), weights, URL_RULES).select("page_id", "host", "path", "rule", "verdict", F.round("score", 6).alias("score"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), *vocabulary())


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_of(F.col("doc_id")) % 7 == 2
    return lm.score(table(spark, sf_dir, "documents"), held_out)


def op9_audio_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "text")
    media = audio.store_texts(docs).drop("text")
    read = audio.media_features(media, keep=("doc_id", "n_bytes"))
    feature = F.concat_ws(":", F.size("fingerprints").cast("string"), F.lower(F.hex(F.xxhash64("fingerprints"))))
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", crc_of(F.col("doc_id")) % 4 == 2)
    model = langid.train(docs.where(~F.col("held_out")), F.col("lang"))
    return langid.predict(docs, model, keep=("doc_id", "held_out"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_quality_rules, op2_jaccard_join, op3_source_mix, op4_secret_scan, op5_license_scan, op6_url_filter, op7_byte_bpe, op8_lm_score, op9_audio_columns, op10_language_id)
    return {f.__name__: f for f in own}


_JACCARD_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
links AS (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b
  WHERE 100 * p.c >= 85 * (na.n + nb.n - p.c)),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) m ON m.doc_id = d.doc_id
"""

_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?"""
_SECRET_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(source, chr(0)) AS repo, coalesce(split_part(source, '/', 1), chr(0)) AS owner, coalesce(text, '') AS t FROM documents),
m AS (
  SELECT doc_id, repo, owner, 'assign' AS kind, 1 AS rank, regexp_extract_all(t, '{_ASSIGN}[A-Za-z0-9+/_.=-]+') AS ms, regexp_split_to_array(t, '{_ASSIGN}[A-Za-z0-9+/_.=-]+') AS ps FROM d
  UNION ALL SELECT doc_id, repo, owner, 'access', 2, regexp_extract_all(t, 'AKIA[A-Z0-9]{{12,}}'), regexp_split_to_array(t, 'AKIA[A-Z0-9]{{12,}}') FROM d
  UNION ALL SELECT doc_id, repo, owner, 'hex', 3, regexp_extract_all(t, '[0-9a-f]{{32,}}'), regexp_split_to_array(t, '[0-9a-f]{{32,}}') FROM d
  UNION ALL SELECT doc_id, repo, owner, 'owned', 4, regexp_extract_all(t, '[A-Za-z0-9+/_=-]{{20,}}'), regexp_split_to_array(t, '[A-Za-z0-9+/_=-]{{20,}}') FROM d),
f AS (
  SELECT doc_id, repo, owner, kind, rank, ms[i] AS v,
    CAST(list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS b
  FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM m)),
c AS (SELECT *, b + length(v) AS e, CASE kind WHEN 'assign' THEN regexp_extract(v, '^{_ASSIGN}([A-Za-z0-9+/_.=-]+)$', 1) ELSE v END AS secret FROM f),
g AS (SELECT * FROM c WHERE kind <> 'assign' OR length(secret) >= 8),
o AS (
  SELECT * FROM g WHERE kind <> 'owned'
  UNION ALL SELECT * FROM g x WHERE kind = 'owned' AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[0-9]')
    AND NOT EXISTS (SELECT 1 FROM g y WHERE y.doc_id = x.doc_id AND y.kind <> 'owned' AND y.b < x.e AND x.b < y.e)),
w AS (SELECT secret, CASE WHEN count(DISTINCT owner) <= 1 THEN 'owned' WHEN count(DISTINCT owner) >= 3 OR count(DISTINCT repo) >= 5 THEN 'copied' ELSE 'shared' END AS status FROM o GROUP BY secret),
k AS (SELECT o.*, status, concat_ws(':', CASE kind WHEN 'owned' THEN status ELSE kind END, b, e) AS s FROM o JOIN w USING (secret) WHERE kind <> 'owned' OR status <> 'copied')
SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(s, ',' ORDER BY b, rank) FILTER (kind <> 'owned'), '')) AS base_sha256, coalesce(string_agg(s, ',' ORDER BY b, rank), '') AS spans,
  coalesce(string_agg(status, ',' ORDER BY b, rank), '') AS statuses
FROM d LEFT JOIN k ON k.doc_id = d.doc_id GROUP BY d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_jaccard_join": _JACCARD_SQL, "op4_secret_scan": _SECRET_SQL}
