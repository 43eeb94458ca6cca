"""References to records that are missing, deleted or late (problem 5).

References and parent rows are brought together by key, sorted by time, and merged in one linear
pass. A parent's life [start, end) is two events, +1 and -1; the running sum at a reference says
whether any row of its key is alive. A key is cut into time slices, and what a slice needs of the
earlier ones is two numbers per (key, slice), found beforehand with map-side sums. So a key that holds
a third of all rows is spread over its slices and never sits in one task, on either side. A slice that is
hot itself (a bulk export in one day, or references without a time) is cut again: its parent events are summed up per
instant and cut into seconds, its references are dealt out, and each deal merges with the events of its second.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions.text import key
from factweave.operators.spread import bounded_broadcast
from factweave.session import checkpoint

#: Seconds of a time slice, and rows beyond which a slice of a key is cut again. They decide how rows are
#: spread, never the result. The list of hot slices is broadcast up to MOST_HOT rows.
SLICE_SECONDS, BLOCK, MOST_HOT = 86_400, 1_000_000, 100_000


@dataclass(frozen=True)
class Reference:
    """One checked column: table (its name in the result), its rows' key, time and parent.

    keys: pairs (column of the referring table, column of the parent table).
    """

    rows: DataFrame
    table: str
    column: str
    row_key: str
    time: str
    keys: tuple[tuple[str, str], ...]
    parent: DataFrame
    start: str
    end: str


def _micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def _events(references: list[Reference]) -> DataFrame:
    """All references and parent events as (family, k, us, kind, delta, known, table, column, ref_key).

    kind orders rows of one instant: ends, then starts, then references.
    """
    parts, seen = [], set()
    names: dict[tuple, int] = {}
    for ref in references:
        who = (id(ref.parent), tuple(p for _, p in ref.keys), ref.start, ref.end)
        family = names.setdefault(who, len(names))
        k = F.array(*(key(F.col(c).cast("string")) for c, _ in ref.keys))
        rows = ref.rows.select(
            F.lit(family).alias("family"), k.alias("k"), _micros(ref.time).alias("us"), F.lit(2).alias("kind"),
            F.lit(0).cast("bigint").alias("delta"), F.lit(0).cast("bigint").alias("known"),
            F.lit(ref.table).alias("ref_table"), F.lit(ref.column).alias("ref_column"), F.col(ref.row_key).cast("string").alias("ref_key"),
        )
        parts.append(rows.filter(~F.exists("k", F.isnull)))
        if family in seen:
            continue
        seen.add(family)
        pk = F.array(*(key(F.col(p).cast("string")) for _, p in ref.keys))
        start, end = _micros(ref.start), _micros(ref.end)
        lives = ref.parent.select(pk.alias("k"), start.alias("s"), end.alias("e")).filter(~F.exists("k", F.isnull))
        # a life that never holds (no start, or an end not after it) still makes the key known
        holds = F.col("s").isNotNull() & (F.col("e").isNull() | (F.col("e") > F.col("s")))
        turns = F.when(
            holds & F.col("e").isNotNull(),
            F.array(F.struct(F.col("s").alias("us"), F.lit(1).alias("kind"), F.lit(1).alias("d")), F.struct(F.col("e").alias("us"), F.lit(0).alias("kind"), F.lit(-1).alias("d"))),
        ).when(holds, F.array(F.struct(F.col("s").alias("us"), F.lit(1).alias("kind"), F.lit(1).alias("d")))).otherwise(
            F.array(F.struct(F.col("s").alias("us"), F.lit(1).alias("kind"), F.lit(0).alias("d")))
        )
        parts.append(
            lives.select("k", F.explode(turns).alias("t")).select(
                F.lit(family).alias("family"), "k", F.col("t.us").alias("us"), F.col("t.kind").alias("kind"),
                F.col("t.d").cast("bigint").alias("delta"), F.when(F.col("t.kind") == 1, 1).otherwise(0).cast("bigint").alias("known"),
                F.lit(None).cast("string").alias("ref_table"), F.lit(None).cast("string").alias("ref_column"), F.lit(None).cast("string").alias("ref_key"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


_CASE = ("ref_table", "ref_column", "ref_key")


def _merged(rows: DataFrame, place: list[str]) -> DataFrame:
    """The references among rows that no parent is alive for, by one running merge of each place.

    rows: the place's columns, us, kind (-1 for the place's carry, whose delta, known and ever are what precedes it), delta, known, ever and the case.
    """
    merge = (
        Window.partitionBy(*place)
        .orderBy((F.col("kind") >= 0).asc(), F.col("us").asc_nulls_first(), "kind")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    run = rows.select(
        "kind", "us", *_CASE, F.sum("delta").over(merge).alias("alive"), F.sum("known").over(merge).alias("started"), F.sum("ever").over(merge).alias("ever")
    ).filter("kind = 2 AND (alive = 0 OR us IS NULL)")
    reason = F.when(F.col("ever") == 0, "missing").when((F.col("started") == 0) | F.col("us").isNull(), "late").otherwise("deleted")
    return run.select(*_CASE, F.timestamp_micros("us").cast("timestamp_ntz").alias("referred_at"), reason.alias("reason"))


def _carries(carried: DataFrame, place: list[str]) -> DataFrame:
    """The carry of each place as its first row, so that no join is needed."""
    return carried.select(
        *place, F.lit(None).cast("bigint").alias("us"), F.lit(-1).alias("kind"), F.col("alive0").alias("delta"), F.col("started0").alias("known"), F.col("known_ever").alias("ever"),
        *(F.lit(None).cast("string").alias(c) for c in _CASE),
    )


def _hot_orphans(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """The orphans among the rows of hot slices. hot: family, k, slice, alive0, started0, known_ever, deals."""
    at = ["family", "k", "slice"]
    own = rows.join(hot.select(*at, "deals"), at).withColumn("sub", F.coalesce(F.floor(F.col("us") / F.lit(1_000_000)), F.lit(-(2**62))))
    # events of an instant are one row, so a second has at most a million of each kind
    events = own.filter("kind < 2").groupBy(*at, "deals", "sub", "us", "kind").agg(F.sum("delta").alias("delta"), F.sum("known").alias("known"))
    sums = events.groupBy(*at, "sub").agg(F.sum("delta").alias("d"), F.sum(F.when(F.col("us").isNotNull(), F.col("known"))).alias("n"))
    asked = own.filter("kind = 2").select(*at, "sub").distinct().withColumns({"d": F.lit(0).cast("bigint"), "n": F.lit(0).cast("bigint")})
    both = sums.unionByName(asked).groupBy(*at, "sub").agg(F.sum("d").alias("d"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    # at most a slice's seconds in a window
    before = Window.partitionBy(*at).orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    earlier = both.select(*at, "sub", F.coalesce(F.sum("d").over(before), F.lit(0)).alias("d0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"))
    dealt = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("deals") - 1)).alias("deal")
    carried = earlier.join(hot, at).select(*at, "sub", dealt, (F.col("alive0") + F.col("d0")).alias("alive0"), (F.col("started0") + F.col("n0")).alias("started0"), "known_ever")
    place = [*at, "sub", "deal"]
    none = [F.lit(None).cast("string").alias(c) for c in _CASE]
    references = own.filter("kind = 2").select(*at, "sub", F.pmod(F.xxhash64(*_CASE), F.col("deals")).alias("deal"), "us", "kind", "delta", "known", *_CASE)
    spread = references.unionByName(events.select(*at, "sub", dealt, "us", "kind", "delta", "known", *none)).withColumn("ever", F.lit(None).cast("bigint"))
    return _merged(spread.unionByName(_carries(carried, place)), place)


def orphans(references: list[Reference], slice_seconds: int = SLICE_SECONDS, block: int = BLOCK) -> DataFrame:
    """Orphan references: (ref_table, ref_column, ref_key, referred_at, reason), one row per distinct case and time.

    A reference is an orphan if no parent row of its key has start <= time and (end NULL or time < end).
    reason: 'missing' (the key has no parent row at all), 'late' (its parents all start later),
    'deleted' (one had started, none is alive). Keys are compared stripped and lower-cased; a reference
    with a NULL or blank key part is no reference; one with a NULL time is an orphan of a known key
    ('late') or of an unknown one ('missing'). Parent rows with NULL key parts are left out; a parent
    without a start is never alive. Repeated rows give one case. Empty tables give an empty result (or,
    for empty parents, every reference as 'missing'). Other columns are not looked at.
    """
    per = slice_seconds * 1_000_000
    rows = _events(references).withColumn("slice", F.coalesce(F.floor(F.col("us") / F.lit(per)), F.lit(-(2**62))))
    by_key = Window.partitionBy("family", "k").orderBy("slice")
    before = by_key.rowsBetween(Window.unboundedPreceding, -1)
    always = Window.partitionBy("family", "k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = rows.groupBy("family", "k", "slice").agg(
        F.sum("delta").alias("d"), F.sum("known").alias("n"), F.sum(F.when(F.col("us").isNotNull(), F.col("known"))).alias("started"),
        F.max("kind").alias("refs"), F.count("*").alias("rows"), F.count_if(F.col("kind") == 2).alias("asked"),
    )
    # a row per key and slice that is referred to: read for the carries and for the hot slices
    carried = checkpoint(
        sums.select(
            "family", "k", "slice", "refs", "rows", F.greatest(F.lit(1), F.ceil(F.col("asked") / F.lit(block))).cast("bigint").alias("deals"),
            F.coalesce(F.sum("d").over(before), F.lit(0)).alias("alive0"),
            F.coalesce(F.sum("started").over(before), F.lit(0)).alias("started0"),
            F.sum("n").over(always).alias("known_ever"),
        ).filter((F.col("refs") == 2) | (F.col("rows") > block))
    )
    place = ["family", "k", "slice"]
    hot = carried.filter(F.col("rows") > block)
    calm = rows
    if not hot.isEmpty():
        hot = bounded_broadcast(hot, MOST_HOT)
        calm = rows.join(hot.select(*place), place, "left_anti")
        carried = carried.filter(F.col("rows") <= block)
        hot = hot.filter("refs = 2").drop("refs", "rows")
    found = _merged(calm.withColumn("ever", F.lit(None).cast("bigint")).unionByName(_carries(carried, place)), place)
    return (found if calm is rows else found.unionByName(_hot_orphans(rows, hot))).distinct()


def orphan_report(found: DataFrame) -> DataFrame:
    """Counts per table, column, month and reason; a reference without a time counts under a NULL month."""
    month = F.date_trunc("month", F.col("referred_at")).cast("timestamp_ntz")
    return found.groupBy("ref_table", "ref_column", month.alias("month"), "reason").agg(F.count_distinct("ref_key").alias("orphans"))
