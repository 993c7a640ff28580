"""One query for each corpus operator, with production parameters over whole tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_repair, decontamination, jaccard_join, language_id, lm_scoring, nearest, pii, piece_sampling, quality_rules, ranked_search, suffix_dedup, token_counts, toxicity
from .common import crc_residue, load

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
#: The key of the pseudonyms in queries; real runs bring their own.
PII_KEY = b"wavemill query key"


def _query(f):
    _QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


@_query
def op1_token_counts(spark: SparkSession, root: str) -> DataFrame:
    return token_counts.token_counts(load(spark, root, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@_query
def op2_decontamination(spark: SparkSession, root: str) -> DataFrame:
    judged = decontamination.decontaminate(load(spark, root, "documents"), load(spark, root, "benchmark"))
    return judged.select(
        "doc_id",
        F.col("doc_n_words").alias("n_words"),
        F.col("doc_n_hit").alias("n_hit"),
        F.size("doc_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("doc_items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


_SQL["op2_decontamination"] = r"""
WITH bench AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, list_slice(w, i, i + least(len(w), 13) - 1) AS x
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM bench WHERE len(w) > 0)),
docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
occ AS (
  SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS x
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT doc_id, occ.n, i, item_id FROM occ JOIN win ON occ.x = win.x AND occ.n = win.n),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@_query
def op8_quality_rules(spark: SparkSession, root: str) -> DataFrame:
    return quality_rules.quality_rules(load(spark, root, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@_query
def op6_toxicity(spark: SparkSession, root: str) -> DataFrame:
    scored = toxicity.toxicity(load(spark, root, "documents").select("doc_id", "text", "lang"), load(spark, root, "labels"))
    return scored.select("doc_id", (crc_residue("doc_id") == 0).alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"))


@_query
def op10_language_id(spark: SparkSession, root: str) -> DataFrame:
    return language_id.language_id(load(spark, root, "documents"))


@_query
def op7_lm_scoring(spark: SparkSession, root: str) -> DataFrame:
    return lm_scoring.lm_scores(load(spark, root, "documents"))


@_query
def op5_jaccard_join(spark: SparkSession, root: str) -> DataFrame:
    return jaccard_join.jaccard_join(load(spark, root, "documents")).select("doc_id", "class_id", "copy_id", "n_links")


@_query
def op3_pii_pseudonyms(spark: SparkSession, root: str) -> DataFrame:
    done = pii.pseudonymise(load(spark, root, "documents").select("doc_id", "text"), PII_KEY)
    count = lambda kind: F.coalesce(F.try_element_at("pii_counts", F.lit(kind)), F.lit(0)).alias(f"n_{kind}")
    return done.select("doc_id", *(count(k) for k in pii.KINDS), F.sha2(F.col("text"), 256).alias("text_sha256"))


@_query
def op9_piece_sampling(spark: SparkSession, root: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    coded = piece_sampling.decode(piece_sampling.encode(load(spark, root, "documents").select("doc_id", "text"), model), model)
    return coded.select("doc_id", F.coalesce(F.size("pieces"), F.lit(0)).cast("bigint").alias("n_pieces"), F.xxhash64("pieces").alias("pieces_hash"), F.col("text").eqNullSafe(F.col("decoded")).alias("lossless"))


@_query
def op4_suffix_dedup(spark: SparkSession, root: str) -> DataFrame:
    done = suffix_dedup.remove_repeats(load(spark, root, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", suffix_dedup.kept_digest(F.col("kept")).alias("kept_sha256"))


@_query
def op13_conversation_repair(spark: SparkSession, root: str) -> DataFrame:
    talks = load(spark, root, "conversations")
    return conversation_repair.repair_report(talks, conversation_repair.damaged(talks))


# An inserted turn costs 5; deleting its partner and, where nothing is left, a system turn costs 4 at most, so the
# cheapest repair never inserts and the recursion leaves insertions out.
_SQL["op13_conversation_repair"] = r"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) AS r(i)),
raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS c
  FROM conversations, crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN k = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM (SELECT *, c % 20 AS k FROM raw) WHERE k <> 0),
seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS again,
    rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body
  FROM damaged),
faults AS (
  SELECT *, CASE WHEN body = '' THEN 'blank' WHEN again > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM seen),
placed AS (
  SELECT *, row_number() OVER w AS i, lag(left(role, 1)) OVER w AS before FROM faults
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again)),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
  FROM placed GROUP BY conv_id),
edits AS (
  SELECT conv_id, i, role, text, p AS was, CASE WHEN e = 'D' THEN p WHEN e = 'K' THEN left(role, 1) WHEN p = 'u' THEN 'a' ELSE 'u' END AS now, e,
    CASE e WHEN 'D' THEN 2 WHEN 'K' THEN 0 ELSE 1 END + CASE WHEN e <> 'D' AND fault = 'truncated' THEN 5 ELSE 0 END AS cost
  FROM placed, (SELECT unnest(['0', 's', 'u', 'a']) AS p), (SELECT unnest(['D', 'K', 'R']) AS e)
  WHERE e = 'D' OR (fault NOT IN ('blank', 'duplicate')
    AND (e = 'R' OR (left(role, 1) = 's' AND p = '0') OR (left(role, 1) = 'u' AND p <> 'u') OR (left(role, 1) = 'a' AND p = 'u')))),
steps AS (
  SELECT conv_id, 0::BIGINT AS i, '0' AS state, {'cost': 0::BIGINT, 'audit': ''::VARCHAR, 'lines': []::VARCHAR[]} AS best FROM counts
  UNION ALL
  SELECT s.conv_id, e.i, e.now, min({'cost': s.best.cost + e.cost, 'audit': s.best.audit || e.e,
    'lines': CASE WHEN e.e = 'D' THEN s.best.lines WHEN e.e = 'K' THEN list_append(s.best.lines, e.role || ':' || e.text)
      ELSE list_append(s.best.lines, CASE e.now WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || e.text) END})
  FROM steps s JOIN edits e ON s.conv_id IS NOT DISTINCT FROM e.conv_id AND e.i = s.i + 1 AND e.was = s.state
  GROUP BY s.conv_id, e.i, e.now),
best AS (
  SELECT c.conv_id, min(s.best) AS b FROM counts c JOIN steps s ON c.conv_id IS NOT DISTINCT FROM s.conv_id AND s.i = c.n
  WHERE s.state IN ('0', 'a') GROUP BY c.conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b.cost, 0)::BIGINT AS cost,
  coalesce(b.audit, '') AS audit, sha256(coalesce(array_to_string(b.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON o.conv_id IS NOT DISTINCT FROM c.conv_id
  LEFT JOIN best ON o.conv_id IS NOT DISTINCT FROM best.conv_id
"""


@_query
def op12_nearest(spark: SparkSession, root: str) -> DataFrame:
    vectors = load(spark, root, "embeddings")
    return nearest.nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0))


@_query
def op11_ranked_search(spark: SparkSession, root: str) -> DataFrame:
    return ranked_search.search(load(spark, root, "documents"), load(spark, root, "benchmark"))


_SQL["op11_ranked_search"] = r"""
WITH terms AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
asked AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY item_id, term),
tf AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY doc_id, term),
len AS (SELECT doc_id, count(*) AS n FROM terms GROUP BY doc_id),
totals AS (SELECT count(*) AS nn, sum(n)::BIGINT AS ll FROM len),
weights AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), totals),
scores AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // ll))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN tf USING (term) JOIN len USING (doc_id), totals GROUP BY item_id, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 20
"""
