"""Per-document text quality (problem 8).

Five statistics of each text are computed in the JVM, and summed up per language in mergeable KLL
quantile sketches (partial sketches per task, merged on shuffle, so a language that holds most of the
corpus costs no more than another). The sketches turn each value into a percentile and a robust z-score
of its language. A document's value lies in a tail if its percentile is beyond that of the statistic's cut:
a cut is a fixed value (below) or a share of the language's documents. A value in the same percentile as a fixed cut is
compared with the cut itself, so such tails are exact though a sketch is not. A text is natural prose if it has fewer
than two values in the tails.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.functions.text import stripped
from factweave.llm.common import bounded_broadcast
from factweave.session import checkpoint

#: Blanks, and the cuts of the tails (low, high) of each statistic.
BLANKS = " \t\n\r\f\x0b"
CUTS: dict[str, tuple[float | None, float | None]] = {
    "tokens": (12, None),
    "mean_length": (3, 9),
    "symbol_share": (None, 0.16),
    "ended_lines": (0.5, None),
    "common_share": (0.2, None),
}
#: Percentile points kept of each sketch; sketches of this k are off by under 1.33 % of the rank.
POINTS = 100
SKETCH_K = 200
#: The most distinct common words that are kept in the plan, and languages whose summary is broadcast.
MOST_WORDS, MOST_LANGUAGES = 50_000, 10_000


def common_word_list(words: DataFrame, word_col: str = "word") -> list[str]:
    """The distinct common words of all languages, NULL left out; the table must be small, which is checked."""
    found = [r[0] for r in words.select(word_col).filter(F.col(word_col).isNotNull()).distinct().take(MOST_WORDS + 1)]
    if len(found) > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} common words")
    return sorted(found)


def statistics(docs: DataFrame, common: list[str], id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, lang, tokens, mean_length, symbol_share, ended_lines, common_share) of each text with a token.

    lang is stripped, lower-cased and without region ('en-GB' is 'en'); NULL and blank are 'und'.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    tokens = F.filter(F.split(text, r"[ \t\n\r\f\x0B]+"), lambda t: t != "")
    bare = F.regexp_replace(text, r"[ \t\n\r\f\x0B]+", "")
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS))), lambda x: x != "")
    core = lambda t: F.regexp_replace(F.lower(t), r"^[^\p{L}]+|[^\p{L}]+$", "")
    known = F.size(F.filter("words", lambda t: core(t).isin(common))) if common else F.lit(0)
    lang = F.split(F.lower(stripped(F.col(lang_col))), "[-_]", 2)[0]
    held = docs.filter(text.rlike(r"[^ \t\n\r\f\x0B]")).select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.nullif(lang, F.lit("")), F.lit("und")).alias("lang"), tokens.alias("words"),
        F.length(bare).alias("chars"), F.length(F.regexp_replace(bare, r"[\p{L}\p{N}]+", "")).alias("symbols"), lines.alias("lines"),
    )
    ended = F.size(F.filter("lines", lambda x: F.right(x, F.lit(1)).isin(".", "!", "?")))
    n = F.size("words")
    return held.select(
        "doc_id", "lang", n.cast("double").alias("tokens"), (F.col("chars") / n).alias("mean_length"),
        (F.col("symbols") / F.col("chars")).alias("symbol_share"), (ended / F.size("lines")).alias("ended_lines"), (known / n).alias("common_share"),
    )


def sketches(stats: DataFrame) -> DataFrame:
    """(lang, documents, one KLL sketch per statistic); tables of different batches merge with kll_merge_agg_double."""
    return stats.groupBy("lang").agg(F.count("*").alias("documents"), *(F.kll_sketch_agg_double(c, SKETCH_K).alias(c) for c in CUTS))


def summaries(sketched: DataFrame) -> DataFrame:
    """(lang, documents, and per statistic the quantiles q_<name> at 0, 1/POINTS .. 1)."""
    at = F.array(*(F.lit(i / POINTS) for i in range(POINTS + 1)))
    return sketched.select("lang", "documents", *(F.kll_sketch_get_quantile_double(c, at).alias(f"q_{c}") for c in CUTS))


def _points_under(points: Column, v: Column) -> Column:
    """How many of the points are at or under v."""
    return F.size(F.filter(points, lambda x: x <= v))


def cut_places(summary: DataFrame, cuts: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """The summaries with, per statistic and fixed cut, the points at or under it (low_<name>, high_<name>)."""
    found = {}
    for c, (low, high) in cuts.items():
        for side, cut in (("low", low), ("high", high)):
            if cut is not None:
                found[f"{side}_{c}"] = _points_under(F.col(f"q_{c}"), F.lit(float(cut)))
    return summary.withColumns(found) if found else summary


def assess(docs: DataFrame, words: DataFrame, cuts: dict[str, tuple[float | None, float | None]] | None = None, tail: float = 0.01) -> DataFrame:
    """Statistics, percentiles (p_), robust z-scores (z_), tail flags (t_), tails and is_prose of each document.

    cuts gives fixed cuts (by default CUTS); for a statistic without cuts the tails are the percentiles
    under `tail` and over 1 - tail of the language. A percentile is the share of the language's quantile
    points at or under the value; a z-score is the distance from the median over the interquartile range /
    1.349, NULL where that is 0. Texts without a token (NULL, empty, blank) have no row; repeated rows give
    repeated rows; very long texts count whole. Empty tables give an empty result; without common words every
    common_share is 0. Other columns are not looked at.
    """
    cuts = CUTS if cuts is None else cuts
    stats = checkpoint(statistics(docs, common_word_list(words)))
    # a row per language: kept, as it is counted and joined
    summary = checkpoint(cut_places(summaries(sketches(stats)), cuts))
    joined = stats.join(bounded_broadcast(summary, MOST_LANGUAGES), "lang").withColumns({f"n_{c}": _points_under(F.col(f"q_{c}"), F.col(c)) for c in CUTS})
    columns: list[Column] = []
    flags = []
    for c in CUTS:
        q, v, n = F.col(f"q_{c}"), F.col(c), F.col(f"n_{c}")
        share = n / F.lit(POINTS + 1)
        spread = (F.element_at(q, POINTS * 3 // 4 + 1) - F.element_at(q, POINTS // 4 + 1)) / F.lit(1.349)
        low, high = cuts.get(c, (None, None))
        if c in cuts:
            # a point between value and cut tells them apart; with none between, they are compared
            tests = []
            if low is not None:
                tests.append((n < F.col(f"low_{c}")) | ((n == F.col(f"low_{c}")) & (v < low)))
            if high is not None:
                tests.append((n > F.col(f"high_{c}")) | ((n == F.col(f"high_{c}")) & (v > high)))
            flag = reduce(lambda a, b: a | b, tests, F.lit(False))
        else:
            flag = (share <= tail) | (share > 1 - tail)
        columns += [share.alias(f"p_{c}"), F.when(spread != 0, (v - F.element_at(q, POINTS // 2 + 1)) / spread).alias(f"z_{c}"), flag.alias(f"t_{c}")]
        flags.append(f"t_{c}")
    flagged = joined.select("doc_id", "lang", *CUTS, *columns)
    tails = reduce(add, (F.col(f).cast("int") for f in flags))
    return flagged.withColumn("tails", tails).withColumn("is_prose", F.col("tails") < 2)


def assessed_statistics(docs: DataFrame, words: DataFrame) -> DataFrame:
    """The columns of assess that don't depend on a sketch's random choices."""
    return assess(docs, words).select("doc_id", "lang", *CUTS, "tails", "is_prose")


def sketch_check(docs: DataFrame, words: DataFrame, points: tuple[int, ...] = (1, 5, 25, 50, 75, 95, 99), error: float = 0.0266) -> DataFrame:
    """Whether the sketches' quantiles hold: (lang, statistic, point, documents, within), a row per language, statistic and point.

    within: the true ranks of the quantile (shares of values under it, and at or under it) lie about point / 100,
    give or take `error` (by default twice the sketch's rank error at SKETCH_K) and one document.
    """
    stats = checkpoint(statistics(docs, common_word_list(words)))
    summary = bounded_broadcast(checkpoint(summaries(sketches(stats))), MOST_LANGUAGES)
    counts = [F.count_if(F.col(c) < F.element_at(f"q_{c}", p + 1)).alias(f"u_{c}_{p}") for c in CUTS for p in points] + [F.count_if(F.col(c) <= F.element_at(f"q_{c}", p + 1)).alias(f"a_{c}_{p}") for c in CUTS for p in points]
    counted = stats.join(summary.drop("documents"), "lang").groupBy("lang").agg(F.count("*").alias("documents"), *counts)
    slack = F.lit(error) + F.lit(1) / F.col("documents")
    rows = [
        F.struct(
            F.lit(c).alias("statistic"), F.lit(p).alias("point"),
            ((F.col(f"u_{c}_{p}") / F.col("documents") <= p / 100 + slack) & (F.col(f"a_{c}_{p}") / F.col("documents") >= p / 100 - slack)).alias("within"),
        )
        for c in CUTS for p in points
    ]
    return counted.select("lang", "documents", F.explode(F.array(*rows)).alias("r")).select("lang", "documents", "r.*")
