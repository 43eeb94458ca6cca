"""Matching found rows to expected ones."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.operators.joins import best_match


def normalised(c: Column | str) -> Column:
    """Lower case without any white space; '' for NULL."""
    return F.lower(F.regexp_replace(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), r"\s+", ""))


def checked_patterns(df: DataFrame, column: str) -> DataFrame:
    """df with a pattern that can't be compiled replaced by one that never matches: a bad pattern is no match."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            def fine(p):
                try:
                    return p if p is None else re.compile(p) and p
                except re.error:
                    return "(?!)"

            yield b.assign(**{column: [fine(p) for p in b[column]]})

    return df.mapInPandas(run, df.schema)


def site_matches(expression: Column, callee: Column, expected_callee: Column, contains_all: Column, contains_any: Column, pattern: Column, site: Column | None = None, site_pattern: Column | None = None) -> Column:
    """Whether a site is the expected one: equal callees, all and any of the fragments, and the patterns of expression and site, where given."""
    text = normalised(expression)
    every = F.forall(F.coalesce(contains_all, F.array().cast("array<string>")), lambda t: text.contains(normalised(t)))
    any_ = F.when(F.size(F.coalesce(contains_any, F.array().cast("array<string>"))) == 0, True).otherwise(F.exists(contains_any, lambda t: text.contains(normalised(t))))
    of_site = F.lit(True) if site_pattern is None else site_pattern.isNull() | F.rlike(F.coalesce(site, F.lit("")), F.coalesce(site_pattern, F.lit("")))
    return F.coalesce((expected_callee.isNull() | (callee == expected_callee)) & every & any_ & of_site & (pattern.isNull() | F.rlike(F.coalesce(expression, F.lit("")), F.coalesce(pattern, F.lit("")))), F.lit(False))


def labels_compatible(expected: Column, found: Column) -> Column:
    """An expected label that isn't given fits every one."""
    return F.coalesce((expected.isNull()) | (expected == "") | (expected == found), F.lit(False))


def match_expected(expected: DataFrame, found: DataFrame, on: Sequence[str], id_col: str, confirmed: Column, ordinal: Sequence[str], fits: Column | None = None) -> DataFrame:
    """Each expected row with its first match, confirmed ones before candidates, and CONFIRMED, CANDIDATE or MISS."""
    pairs = expected.join(found, list(on))
    if fits is not None:
        pairs = pairs.filter(fits)
    best = best_match(pairs.withColumn("__confirmed", confirmed), id_col, F.when(F.col("__confirmed"), 0).otherwise(1), ordinal)
    kept = best.select(id_col, *(c for c in best.columns if c not in expected.columns))
    out = expected.join(kept, id_col, "left")
    state = F.when(F.col("__confirmed").isNull(), "MISS").when(F.col("__confirmed"), "CONFIRMED").otherwise("CANDIDATE")
    return out.withColumn("match", state).drop("__confirmed")


def token_hits(texts: DataFrame, id_col: str, text_col: str, tokens: DataFrame, token_col: str) -> DataFrame:
    """(id, token) where a forbidden token occurs as a word of the text.

    Texts are cut into their distinct words, so this is an equi-join; it finds whole words, where a search
    for substrings would need all pairs.
    """
    words = texts.select(id_col, F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce(text_col, F.lit("")), F.lit(r"[A-Za-z0-9_]+"), F.lit(0)))).alias("token"))
    held = tokens.select(F.col(token_col).alias("token")).filter(F.col("token").isNotNull()).distinct()
    return words.join(held, "token").select(id_col, "token")


#: Tokens that one pass over the texts looks for.
PASS_TOKENS = 100_000


def substring_hits(texts: DataFrame, id_col: str, text_col: str, tokens: DataFrame, token_col: str, per_pass: int = PASS_TOKENS) -> DataFrame:
    """(id, token) where a forbidden token occurs anywhere in the text, within words, too.

    One automaton finds all tokens of a pass; more tokens than one pass holds take more passes, so none is left out. NULL and empty
    tokens and texts hit nothing.
    """
    held = tokens.select(F.col(token_col).cast("string").alias("token")).filter("token <> ''").distinct()
    passes = max(1, -(-held.count() // per_pass) * 2) if held.limit(per_pass + 1).count() > per_pass else 1
    kind = dict(texts.dtypes)[id_col]
    found = []
    for n in range(passes):
        # a pass's share of the tokens: half of per_pass on average
        part = [r[0] for r in held.filter(F.pmod(F.xxhash64("token"), F.lit(passes)) == n).collect()]
        found.append(texts.select(id_col, F.col(text_col).cast("string").alias("text")).filter("text <> ''").mapInArrow(_finder(part, id_col), f"`{id_col}` {kind}, token string"))
    return reduce(DataFrame.unionByName, found)


def _finder(tokens: list[str], name: str):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for t in tokens:
            automaton.add_word(t, t)
        if tokens:
            automaton.make_automaton()
        for batch in source:
            at, hits = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for token in sorted({t for _, t in automaton.iter(text)}) if tokens else ():
                    at.append(i)
                    hits.append(token)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), pa.array(hits, pa.string())], names=[name, "token"])

    return run
