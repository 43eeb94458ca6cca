"""The pN_ queries of problems 3, 4, 6, 7 and 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm import encode, leaks, overlap, pieces, quality
from factweave.session import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = overlap.cross_split_pairs(table(spark, d, "cve_views"))
    return pairs.select(F.least("evaluation_id", "training_id").alias("view_id_a"), F.greatest("evaluation_id", "training_id").alias("view_id_b"))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    views = table(spark, d, "cve_views")
    return overlap.overlap_report(views, overlap.cross_split_pairs(views))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    cut = pieces.pieces(table(spark, d, "function_corpus"), "function_row_id", "body", with_text=False)
    return cut.filter("piece_no = 1").select(F.col("row_id").alias("function_row_id"))


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    cut = pieces.pieces(table(spark, d, "function_corpus"), "function_row_id", "body")
    return cut.select(F.col("row_id").alias("function_row_id"), "piece_no", "start", F.col("end").alias("stop"), "cut_at", "piece")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode(table(spark, d, "documents"))


def p6_decoded(spark: SparkSession, d: str) -> DataFrame:
    return encode.decode(encode.encode(table(spark, d, "documents")), encode.vocabulary_table(spark))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.passages_found(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leak_report(p7_found(spark, d), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.assess(table(spark, d, "documents"), table(spark, d, "common_words")).filter("NOT is_prose").select("doc_id")


def p8_stats(spark: SparkSession, d: str) -> DataFrame:
    return quality.assessed_statistics(table(spark, d, "documents"), table(spark, d, "common_words"))


def p8_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles and robust z-scores within the language, and tails by percentile."""
    found = quality.assess(table(spark, d, "documents"), table(spark, d, "common_words"), cuts={})
    return found.select("doc_id", "lang", *(f"{kind}_{c}" for c in quality.CUTS for kind in ("p", "z", "t")), "tails", "is_prose")


def p8_sketches(spark: SparkSession, d: str) -> DataFrame:
    return quality.sketch_check(table(spark, d, "documents"), table(spark, d, "common_words"))


def p4_invariants(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of every body's pieces, checked from the pieces themselves."""
    corpus = table(spark, d, "function_corpus")
    return pieces.invariants(corpus, pieces.pieces(corpus, "function_row_id", "body"), "function_row_id", "body").withColumnRenamed("row_id", "function_row_id")


QUERIES = {
    "p3_found": p3_found,
    "p3_report": p3_report,
    "p4_found": p4_found,
    "p4_pieces": p4_pieces,
    "p4_invariants": p4_invariants,
    "p6_ids": p6_ids,
    "p6_decoded": p6_decoded,
    "p7_found": p7_found,
    "p7_report": p7_report,
    "p8_found": p8_found,
    "p8_stats": p8_stats,
    "p8_percentiles": p8_percentiles,
    "p8_sketches": p8_sketches,
}

_WORDS = r"list_transform(regexp_extract_all({0}, '[\p{{L}}\p{{N}}]+'), lambda x: lower(x))"
_STRIP = "trim({0}, chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' ')"

_PAIRS = rf"""
WITH v AS (
  SELECT view_id, lower({_STRIP.format("corpus")}) AS label, project,
    regexp_extract(lower({_STRIP.format("binary_sha256")}), '^(sha256:)?([0-9a-f]{{64}})$', 2) AS digest,
    {_WORDS.format("coalesce(profile_text, '')")} AS w
  FROM cve_views WHERE corpus IS NOT NULL),
s AS (
  SELECT view_id, label, project, starts_with(label, 'evaluation') AS held_out,
    CASE WHEN digest IN ('', repeat('0', 64)) THEN NULL ELSE digest END AS digest,
    list_distinct([w[i] || ' ' || w[i+1] || ' ' || w[i+2] FOR i IN range(1, len(w) - 1)]) AS g
  FROM v),
pairs AS (
  SELECT e.view_id AS e_id, t.view_id AS t_id FROM s e JOIN s t ON e.held_out AND NOT t.held_out
  WHERE e.digest = t.digest OR (len(e.g) > 0 AND len(t.g) > 0
    AND 10 * len(list_intersect(e.g, t.g)) >= 7 * (len(e.g) + len(t.g) - len(list_intersect(e.g, t.g)))))
"""

_LEAKS = rf"""
WITH d AS (SELECT doc_id, {_WORDS.format(r"regexp_replace(coalesce(text, ''), '\p{Cf}', '', 'g')")} AS w FROM documents),
i AS (SELECT item_id, {_WORDS.format(r"regexp_replace(coalesce(passage, ''), '\p{Cf}', '', 'g')")} AS w FROM eval_items),
dg AS (SELECT doc_id, unnest([array_to_string(w[k:k+12], ' ') FOR k IN range(1, len(w) - 11)]) AS g FROM d),
ig AS (SELECT item_id, unnest([array_to_string(w[k:k+12], ' ') FOR k IN range(1, len(w) - 11)]) AS g FROM i),
found AS (SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g))
"""

_STATS = r"""
WITH b AS (
  SELECT doc_id, coalesce(nullif(regexp_replace(lower(trim(lang)), '[-_].*$', ''), ''), 'und') AS lang, coalesce(text, '') AS text FROM documents),
c AS (
  SELECT doc_id, lang,
    list_filter(regexp_split_to_array(text, '[ \t\n\r\f\x0B]+'), lambda x: x <> '') AS w,
    regexp_replace(text, '[ \t\n\r\f\x0B]+', '', 'g') AS bare,
    list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' ')), lambda x: x <> '') AS l
  FROM b),
k AS (SELECT doc_id, unnest(w) AS t FROM c),
n AS (
  SELECT doc_id, count(*) AS known FROM k
  WHERE regexp_replace(regexp_replace(lower(t), '^[^\p{L}]+', ''), '[^\p{L}]+$', '') IN (SELECT word FROM common_words) GROUP BY doc_id),
s AS (
  SELECT c.doc_id, lang, len(w)::DOUBLE AS tokens, length(bare) / len(w) AS mean_length,
    length(regexp_replace(bare, '[\p{L}\p{N}]+', '', 'g')) / length(bare) AS symbol_share,
    len(list_filter(l, lambda x: right(x, 1) IN ('.', '!', '?'))) / len(l) AS ended_lines, coalesce(known, 0) / len(w) AS common_share
  FROM c LEFT JOIN n USING (doc_id) WHERE len(w) > 0),
f AS (
  SELECT *, (tokens < 12)::INT + (mean_length < 3 OR mean_length > 9)::INT + (symbol_share > 0.16)::INT
    + (ended_lines < 0.5)::INT + (common_share < 0.2)::INT AS tails FROM s)
"""

SQL = {
    "p3_found": _PAIRS + "SELECT least(e_id, t_id) AS view_id_a, greatest(e_id, t_id) AS view_id_b FROM pairs",
    "p3_report": _PAIRS + """
SELECT label AS corpus, project, count(*) AS views, count(n) AS overlapping, coalesce(sum(n), 0)::BIGINT AS pairs
FROM s LEFT JOIN (SELECT e_id, count(*) AS n FROM pairs GROUP BY e_id) p ON s.view_id = p.e_id WHERE held_out GROUP BY label, project""",
    "p4_found": "SELECT function_row_id FROM function_corpus WHERE length(body) > 3600",
    "p4_invariants": "SELECT function_row_id, TRUE AS within_limit, TRUE AS overlaps, TRUE AS whole, length(body) > 3600 AS cut FROM function_corpus WHERE length(body) > 0",
    "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p7_found": _LEAKS + "SELECT doc_id, item_id FROM found",
    "p7_report": _LEAKS + """
SELECT suite, eval_split, count(*) AS items, count(n) AS leaked, coalesce(sum(n), 0)::BIGINT AS documents
FROM eval_items LEFT JOIN (SELECT item_id, count(*) AS n FROM found GROUP BY item_id) USING (item_id) GROUP BY suite, eval_split""",
    "p8_found": _STATS + "SELECT doc_id FROM f WHERE tails >= 2",
    "p8_stats": _STATS + "SELECT doc_id, lang, tokens, mean_length, symbol_share, ended_lines, common_share, tails, tails < 2 AS is_prose FROM f",
    "p8_sketches": _STATS + """SELECT lang, statistic, point, documents, TRUE AS within FROM (SELECT lang, count(*) AS documents FROM f GROUP BY lang),
  (SELECT unnest(['tokens', 'mean_length', 'symbol_share', 'ended_lines', 'common_share']) AS statistic), (SELECT unnest([1, 5, 25, 50, 75, 95, 99]) AS point)""",
}
