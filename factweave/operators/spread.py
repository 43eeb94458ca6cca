"""Joins that neither broadcast what is too large nor gather what is too many."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounded_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """df marked for broadcast if it has at most so many rows (they are counted), else df itself.

    Counting runs df's plan: hand over a table, a checkpoint or what is cheap.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def paired(left: DataFrame, right: DataFrame, key: str | Sequence[str], row: str, block: int = 20_000, most_hot: int = 100_000) -> DataFrame:
    """Inner join on key, with the right rows of a hot key cut into blocks of about `block` rows.

    row is a column of right that tells its rows apart. Each block is joined in its own place, with the left
    rows of the key repeated per block. A key is hot beyond `block` right rows, so there are at most
    rows/block of them; their list is broadcast if that is no more than most_hot. Rows are counted by key only if
    there are more than `block` in all. right is read more than once: hand over a table, a checkpoint or what is cheap.
    """
    keys = [key] if isinstance(key, str) else list(key)
    if right.limit(block + 1).count() <= block:
        return left.join(right, keys)
    hot = right.groupBy(*keys).count().filter(F.col("count") > block).select(*keys, F.ceil(F.col("count") / F.lit(block)).cast("int").alias("__blocks"))
    hot = bounded_broadcast(hot, most_hot)
    cut = right.join(hot, keys, "left").withColumn("__block", F.pmod(F.xxhash64(row), F.coalesce("__blocks", F.lit(1)))).drop("__blocks")
    spread = left.join(hot, keys, "left").withColumn("__block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("__blocks", F.lit(1)) - F.lit(1).cast("bigint")))).drop("__blocks")
    return spread.join(cut, [*keys, "__block"]).drop("__block")
