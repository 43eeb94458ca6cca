"""Semi-naive fixed points over DataFrames.

Each round joins only the states that are new, drops those known, and appends the rest. What is known is a list of
checkpointed rounds: of it a round looks only at the keys that have come up, so while those are few they are broadcast and the known
states are read, but neither moved nor written again; every few rounds the list is merged. Lineage is cut with
a checkpoint in the shared folder, so a lost executor costs a re-read and no recomputation. Rounds
are bounded; a run that is cut off says so instead of looking complete.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.session import checkpoint


@dataclass(frozen=True)
class Result:
    """rows: the fixed point; complete: whether it was reached within the rounds; rounds: how many were run."""

    rows: DataFrame
    complete: bool
    rounds: int


#: Rounds that are kept apart before they are merged.
MERGE = 16


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def closure(seeds: DataFrame, step: Callable[[DataFrame], DataFrame], rounds: int) -> Result:
    """The distinct rows reachable from seeds by step; step takes the new rows and returns rows of their shape."""
    columns = seeds.columns
    delta = checkpoint(seeds.distinct())
    parts = [delta]
    for n in range(rounds):
        grown = checkpoint(step(delta).select(columns).distinct())
        met = _union(parts).join(grown, columns, "left_semi")
        delta = checkpoint(grown.join(met, columns, "left_anti"))
        if delta.isEmpty():
            return Result(_union(parts), True, n)
        parts.append(delta)
        if len(parts) > MERGE:
            parts = [checkpoint(_union(parts).repartition(*columns))]
    return Result(_union(parts), False, rounds)


def relaxation(seeds: DataFrame, step: Callable[[DataFrame], DataFrame], keys: Sequence[str], cost: Sequence[str], rounds: int, carried: Sequence[str] = ()) -> Result:
    """Per key the least cost (compared as a tuple), with the carried columns of the least row.

    A state enters a round only if it strictly improves its key, as in shortest paths or dominance by
    (depth, precision); ties take the least carried values. Step sees improved rows only.
    """
    columns = [*keys, *cost, *carried]

    def best(df: DataFrame) -> DataFrame:
        order = F.struct(*cost, *carried)
        return df.select(columns).groupBy(*keys).agg(F.min(order).alias("b")).select(*keys, "b.*")

    delta = checkpoint(best(seeds))
    parts = [delta]
    for n in range(rounds):
        new = checkpoint(best(step(delta)))
        met = _union(parts).join(new.select(*keys), list(keys), "left_semi").groupBy(*keys).agg(F.min(F.struct(*cost)).alias("__old"))
        delta = checkpoint(new.join(met, list(keys), "left").filter(F.col("__old").isNull() | (F.struct(*cost) < F.col("__old"))).drop("__old"))
        if delta.isEmpty():
            return Result(checkpoint(best(_union(parts))), True, n)
        parts.append(delta)
        if len(parts) > MERGE:
            parts = [checkpoint(best(_union(parts)))]
    return Result(checkpoint(best(_union(parts))), False, rounds)


def alternate(state: DataFrame, outer: Callable[[DataFrame], DataFrame], rounds: int) -> Result:
    """Grow a set by whole passes of outer until a pass adds nothing: G6's alternation of several operators."""
    columns = state.columns
    seen = checkpoint(state.distinct())
    size = seen.count()
    for n in range(rounds):
        seen = checkpoint(seen.unionByName(outer(seen).select(columns)).distinct())
        now = seen.count()
        if now == size:
            return Result(seen, True, n)
        size = now
    return Result(seen, False, rounds)


def status(result: Result) -> Column:
    """COMPLETE or ANALYSIS_BUDGET_EXHAUSTED as a literal, to stand beside the rows."""
    return F.lit("COMPLETE" if result.complete else "ANALYSIS_BUDGET_EXHAUSTED")


def whole(result: Result) -> DataFrame:
    """The rows of a search that reached its fixed point; one that its budget cut off raises instead of looking complete."""
    if not result.complete:
        raise RuntimeError(f"ANALYSIS_BUDGET_EXHAUSTED after {result.rounds} rounds")
    return result.rows
