"""Routing rows by reasons: every row is admitted or told why not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_reasons(df: DataFrame, rules: list[tuple[str, Column]], column: str = "reasons") -> DataFrame:
    """df with the array of all failing rules' names, in the rules' order; a NULL condition does not fail."""
    marks = F.array(*(F.when(condition, F.lit(name)) for name, condition in rules))
    return df.withColumn(column, F.array_compact(marks))


def admit(df: DataFrame, rules: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """(admitted rows, rejects with one row per failing reason). One scan marks both sides."""
    marked = with_reasons(df, rules)
    good = marked.filter(F.size("reasons") == 0).drop("reasons")
    return good, marked.select("*", F.explode("reasons").alias("reason")).drop("reasons")


def first_reason(df: DataFrame, rules: list[tuple[str, Column]], column: str = "reason") -> DataFrame:
    """df with the first failing rule's name, NULL if none fails: for ordered checks that stop at the first."""
    return df.withColumn(column, F.coalesce(*(F.when(condition, F.lit(name)) for name, condition in rules)))


def route(df: DataFrame, routes: list[tuple[str, Column]], rest: str, column: str = "route") -> DataFrame:
    """df with the name of the first route whose condition holds, else rest."""
    return df.withColumn(column, F.coalesce(*(F.when(condition, F.lit(name)) for name, condition in routes), F.lit(rest)))


def first_missing(blockers: Column, priorities: list[tuple[str, tuple[str, ...]]], other: str = "UNCLASSIFIED_RELATION") -> Column:
    """The first category, in order, of which a marker occurs in a blocker, with the blockers that have it.

    NULL without blockers; the given name if no category fits.
    """
    held = F.array_sort(F.array_distinct(F.filter(blockers, lambda b: b.isNotNull() & (b != ""))))

    def hits(markers: tuple[str, ...]) -> Column:
        def some(b: Column) -> Column:
            found = F.lit(False)
            for m in markers:
                found = found | b.contains(m)
            return found

        return F.filter(held, some)

    options = [F.when(F.size(hits(m)) > 0, F.struct(F.lit(name).alias("relation"), hits(m).alias("blockers"))) for name, m in priorities]
    return F.coalesce(*options, F.when(F.size(held) > 0, F.struct(F.lit(other).alias("relation"), held.alias("blockers"))))
