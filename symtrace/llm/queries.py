"""The queries of this subpackage, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _util as u
from . import aq, bpe, html, linededup, lm, minhash, packing, pii, quality, reshard


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(u.read(spark, sf_dir, "documents"))


def op2_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(u.read(spark, sf_dir, "documents"))


def op3_skip_chain_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(u.read(spark, sf_dir, "documents"))


def op4_flow_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = reshard.plan(u.read(spark, sf_dir, "documents"))
    return planned.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("old").alias("old_shard"))


def op5_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.ledger(u.read(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("failed").bitwiseAND(quality.BASE) != 0).alias("base_failed"),
        quality.verdict().alias("kept"),
        F.col("failed").cast("long").alias("failed_rules"),
    )


def op6_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aq.search(u.read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_digest(u.read(spark, sf_dir, "documents"))


def op8_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(u.read(spark, sf_dir, "pages"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_digest(u.read(spark, sf_dir, "documents"), k=2)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(u.read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_class_lm": op2_class_lm,
    "op3_skip_chain_crf": op3_skip_chain_crf,
    "op4_flow_reshard": op4_flow_reshard,
    "op5_quality_ledger": op5_quality_ledger,
    "op6_additive_quantisation": op6_additive_quantisation,
    "op7_line_dedup": op7_line_dedup,
    "op8_text_density": op8_text_density,
    "op9_minhash": op9_minhash,
    "op10_bpe": op10_bpe,
}

_WORDS = r"""regexp_extract_all(t, '[^\x20\x09-\x0D]+')"""

SQL: dict[str, str] = {
    "op5_quality_ledger": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, {_WORDS} AS ws, string_split(t, chr(10)) AS ls FROM d),
p AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM w),
tri AS (SELECT r, i, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM p WINDOW o AS (PARTITION BY r ORDER BY i)),
c AS (SELECT r, i, w3 IS NOT NULL AND count(*) OVER (PARTITION BY r, w, w2, w3) > 1 AS twice FROM tri),
cov AS (SELECT r, twice OR coalesce(lag(twice, 1) OVER o, false) OR coalesce(lag(twice, 2) OVER o, false) AS covered FROM c WINDOW o AS (PARTITION BY r ORDER BY i)),
rep AS (SELECT r, count(*) FILTER (covered) AS n FROM cov GROUP BY r),
l AS (SELECT r, unnest(ls) AS l FROM w),
ln AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup FROM l WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN rep USING (r) LEFT JOIN ln USING (r)),
f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (100 * n_symbols > 10 * n_words)::INT
    + 8 * (100 * n_dup_lines > 50 * n_lines)::INT + 16 * (word_chars < 2 * n_words OR word_chars > 15 * n_words)::INT AS BIGINT) AS failed_rules
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, failed_rules = 0 AS kept, failed_rules FROM f
""",
    "op7_line_dedup": r"""
WITH l AS (
  SELECT doc_id, i, l, translate(regexp_replace(l, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
s AS (SELECT k, min(doc_id) AS first FROM l WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
j AS (SELECT l.doc_id, l.i, l.l, s.k IS NOT NULL AND l.doc_id <> s.first AS gone FROM l LEFT JOIN s USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
""",
    "op9_minhash": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) = 1 THEN ws[1] ELSE ws[i] || ' ' || ws[i + 1] END AS sh
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws), 2))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b USING (sh) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 80 * (a.n + b.n - i)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT doc_id AS id, doc_id AS reach FROM d UNION SELECT r.id, e.y FROM r JOIN e ON r.reach = e.x),
c AS (SELECT id, min(reach) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d JOIN c ON c.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
""",
}
