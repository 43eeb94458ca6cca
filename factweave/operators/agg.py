"""Aggregates and keyed deduplication. All but the windows combine map-side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unique_or_null(c: Column | str) -> Column:
    """A1: the value if the group has exactly one distinct known one, else NULL."""
    return F.when(F.min(c).eqNullSafe(F.max(c)), F.min(c))


def unanimous(c: Column | str) -> Column:
    """A1 for merges of flows: as unique_or_null, but a single NULL spoils it."""
    return F.when((F.count(c) == F.count(F.lit(1))) & (F.min(c) == F.max(c)), F.min(c))


def prefixed_sums(columns: Sequence[str], prefix: str) -> list[Column]:
    """A3: sums of counters, missing ones as 0, under prefixed names."""
    return [F.sum(F.coalesce(F.col(c), F.lit(0))).alias(f"{prefix}{c}") for c in columns]


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key, the first in a total order; which one wins never depends on the plan."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def keep_by(df: DataFrame, keys: Sequence[str], order: Column, last: bool = False) -> DataFrame:
    """As keep_first, as a min_by (max_by) that combines map-side: for hot keys and total orders."""
    rest = [c for c in df.columns if c not in set(keys)]
    whole = F.struct(*rest)
    best = (F.max_by if last else F.min_by)(whole, order)
    return df.groupBy(*keys).agg(best.alias("__row")).select(*keys, "__row.*")


def rates(hit: Column, total: Column | None = None) -> Column:
    """A5: the share of rows for which hit holds; NULL for none."""
    return F.try_divide(F.count_if(hit), F.count(F.lit(1)) if total is None else total)


def precision_recall(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """Precision, recall and F1; NULL on a zero denominator."""
    return {
        "precision": F.try_divide(tp, tp + fp),
        "recall": F.try_divide(tp, tp + fn),
        "f1": F.try_divide(2 * tp, 2 * tp + fp + fn),
    }


def multi_label(df: DataFrame, labels: list[Column], name: str = "label") -> DataFrame:
    """A10: each row once per label it belongs to; NULL labels are left out."""
    return df.withColumn(name, F.explode(F.array_distinct(F.array_compact(F.array(*labels)))))


def representatives(df: DataFrame, keys: Sequence[str], order: Column, counts: dict[str, Column]) -> DataFrame:
    """The first row of each group in the order, as columns, and aggregates of the whole group."""
    rest = [c for c in df.columns if c not in set(keys)]
    g = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("__row"), *(c.alias(n) for n, c in counts.items()))
    return g.select(*keys, "__row.*", *counts)


def merge_lists(df: DataFrame, keys: Sequence[str], lists: dict[str, tuple[str, str]], unions: Sequence[str]) -> DataFrame:
    """Per key, lists of structs with one entry per id (the last by a version field) and sorted unions of id lists.

    lists: column -> (id field, version field); unions: columns of arrays.
    """
    base = df.groupBy(*keys).agg(
        *(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce(F.col(u), F.array().cast(df.schema[u].dataType)))))).alias(u) for u in unions)
    )
    for column, (entry, version) in lists.items():
        fields = [f.name for f in df.schema[column].dataType.elementType.fields]
        entries = df.select(*keys, F.explode(column).alias("e")).groupBy(*keys, F.col(f"e.{entry}").alias("__id"))
        last = entries.agg(F.max_by("e", F.struct(F.col(f"e.{version}"), *(F.col(f"e.{f}") for f in fields))).alias("e"))
        one = last.groupBy(*keys).agg(F.sort_array(F.collect_list("e")).alias(column))
        base = base.join(one, list(keys), "left")
    return base


def in_all_groups(df: DataFrame, scope: Sequence[str], group: str, key: str, value: str) -> DataFrame:
    """(scope, key, value) for keys that occur in every group of their scope with one agreeing value."""
    every = df.groupBy(*scope).agg(F.count_distinct(group).alias("__groups"))
    held = df.filter(F.col(value).isNotNull()).groupBy(*scope, key).agg(
        F.count_distinct(group).alias("__in"), unique_or_null(value).alias(value), F.count_distinct(value).alias("__values")
    )
    return held.join(every, list(scope)).filter("__in = __groups AND __values = 1").select(*scope, key, value)


def supported(df: DataFrame, keys: Sequence[str], member: str, least: int) -> DataFrame:
    """Groups with at least `least` distinct members."""
    return df.groupBy(*keys).agg(F.count_distinct(member).alias("support")).filter(F.col("support") >= least)


def complete_sum(c: Column, present: Column) -> Column:
    """The sum, or NULL if a part of the group is not present."""
    return F.when(F.bool_and(present), F.sum(c))


def threshold_gate(df: DataFrame, keys: Sequence[str], implementation: str, label: str, positive: str, least: int, precision: float) -> DataFrame:
    """Per key, labels counted once per distinct implementation, conflicts, precision and the unmet thresholds.

    An implementation that carries both labels is a conflict and counts for neither.
    """
    one = df.groupBy(*keys, implementation).agg(F.count_distinct(label).alias("labels"), F.min(label).alias(label))
    gate = one.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("implementations"), F.count_if(F.col("labels") > 1).alias("conflicts"),
        F.count_if((F.col("labels") == 1) & (F.col(label) == positive)).alias("positives"), F.count_if(F.col("labels") == 1).alias("judged"),
    )
    share = F.try_divide(F.col("positives"), F.col("judged"))
    unmet = F.array_compact(
        F.array(
            F.when(F.col("judged") < least, "too_few_implementations"),
            F.when(F.coalesce(share, F.lit(0.0)) < precision, "precision_under_threshold"),
            F.when(F.col("conflicts") > 0, "conflicting_labels"),
        )
    )
    return gate.withColumn("precision", share).withColumn("unmet", F.concat_ws(",", unmet))


def strongest(df: DataFrame, keys: Sequence[str], rank: Column) -> DataFrame:
    """The rows of the strongest evidence per key, distinct; rows that conflict at that rank are all kept."""
    ranked = df.distinct().withColumn("__rank", rank)
    best = ranked.groupBy(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys))).agg(F.min("__rank").alias("__best"))
    same = F.col("__rank") == F.col("__best")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return ranked.join(best, same, "left_semi").drop("__rank")


def classes(df: DataFrame, fingerprint: Column, id_col: str) -> tuple[DataFrame, DataFrame]:
    """(representatives, membership): each content once, its least id first, and (id, representative id)."""
    marked = df.withColumn("__f", fingerprint)
    first = marked.groupBy("__f").agg(F.min(id_col).alias("representative"), F.count(F.lit(1)).alias("copies"))
    membership = marked.select("__f", id_col).join(first, "__f").select(id_col, "representative")
    return first.select("representative", "copies"), membership
