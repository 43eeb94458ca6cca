"""Joins that Spark has no operator for, composed of equi-joins and windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions.ids import alias_keys, literal_integer
from factweave.operators.spread import paired
from factweave.session import checkpoint


def alias_join(left: DataFrame, right: DataFrame, left_object: str, right_object: str, left_id: str, right_id: str) -> DataFrame:
    """Distinct (left_id, right_id) whose object ids share an alias.

    Both sides are brought to distinct (object id, alias) first, so rows of a hot object meet only after
    the object ids have been matched.
    """
    lo = left.select(F.col(left_object).alias("__lo")).distinct()
    ro = right.select(F.col(right_object).alias("__ro")).distinct()
    la = lo.select("__lo", F.explode(alias_keys("__lo")).alias("__alias"))
    ra = ro.select("__ro", F.explode(alias_keys("__ro")).alias("__alias"))
    same = la.join(ra, "__alias").select("__lo", "__ro").distinct()
    l2 = left.select(F.col(left_object).alias("__lo"), left_id)
    r2 = right.select(F.col(right_object).alias("__ro"), right_id).filter("__ro IS NOT NULL").distinct()
    # a hot object's right rows are joined in blocks
    return paired(same.join(l2, "__lo").select("__ro", left_id).distinct(), r2, "__ro", right_id).select(left_id, right_id).distinct()


def _level(length: Column, width: int) -> Column:
    """How often `width` must be doubled to hold the length."""
    return F.greatest(F.lit(0), F.ceil(F.log2(length / F.lit(width)))).cast("int")


def _levels(df: DataFrame, column: str) -> list[int]:
    return sorted(r[0] for r in df.select(column).distinct().collect())  # at most 64


def _placed(level: Column, low: Column, high: Column, width: int, levels: list[int]) -> Column:
    """(level, first, bucket) of an interval [low, high) on its own level and those above it, at most two buckets each."""
    at = lambda x, n: F.floor(x / F.lit(width * 2**n)).cast("bigint")
    each = [F.when(level <= n, F.transform(F.sequence(at(low, n), at(high - 1, n)), lambda b: F.struct(F.lit(n).alias("level"), at(low, n).alias("first"), b.alias("bucket")))) for n in levels]
    return F.explode(F.flatten(F.array_compact(F.array(*each))))


def interval_overlaps(left: DataFrame, right: DataFrame, keys: Sequence[str], start: str, end: str, width: int, suffixes: tuple[str, str] = ("_l", "_r")) -> DataFrame:
    """Pairs of distinct half-open intervals of equal keys that overlap, with the shared range.

    Rows are first brought to distinct (keys, start, end) with a count of the rows behind each (rows_l,
    rows_r): copies are never multiplied out, and membership is an equi-join on the three. An interval has the level
    of its length (`width` doubled as often as it takes) and lies in the buckets, at most two each, of its level and of those above it that occur. A pair
    is taken on the coarser of its levels, in the first bucket both touch; so a hot key is spread over its buckets, and a
    long interval is not cut into many. NULL keys or bounds and empty intervals match nothing.
    """
    sl, sr = suffixes

    def classes(df: DataFrame, s: str) -> DataFrame:
        held = df.filter(F.col(start) < F.col(end)).groupBy(*keys, F.col(start).alias(f"start{s}"), F.col(end).alias(f"end{s}")).agg(F.count(F.lit(1)).alias(f"rows{s}"))
        return held.withColumn(f"__own{s}", _level(F.col(f"end{s}") - F.col(f"start{s}"), width))

    given = lambda df: df.filter(F.col(start) < F.col(end)).select(_level(F.col(end) - F.col(start), width).alias("__l"))
    levels = _levels(given(left).unionByName(given(right)), "__l")

    def placed(df: DataFrame, s: str) -> DataFrame:
        if not levels:
            return df.withColumns({"__level": F.lit(0), f"__first{s}": F.lit(0), "__bucket": F.lit(0)})
        at = df.withColumn("__p", _placed(F.col(f"__own{s}"), F.col(f"start{s}"), F.col(f"end{s}"), width, levels))
        return at.withColumns({"__level": F.col("__p.level"), f"__first{s}": F.col("__p.first"), "__bucket": F.col("__p.bucket")}).drop("__p")

    l, r = placed(classes(left, sl), sl), placed(classes(right, sr), sr)  # noqa: E741
    overlap = F.greatest(f"start{sl}", f"start{sr}") < F.least(f"end{sl}", f"end{sr}")
    once = (F.col("__bucket") == F.greatest(f"__first{sl}", f"__first{sr}")) & (F.col("__level") == F.greatest(f"__own{sl}", f"__own{sr}"))
    return l.join(r, [*keys, "__level", "__bucket"]).filter(overlap & once).select(
        *keys, f"start{sl}", f"end{sl}", f"rows{sl}", f"start{sr}", f"end{sr}", f"rows{sr}",
        F.greatest(f"start{sl}", f"start{sr}").alias("shared_start"), F.least(f"end{sl}", f"end{sr}").alias("shared_end"),
    )


def tightest_container(points: DataFrame, intervals: DataFrame, keys: Sequence[str], point: str, start: str, end: str, name: str, width: int) -> DataFrame:
    """Each point with the smallest (length, start, name) half-open interval of its keys that covers it.

    Points in no interval keep a NULL name. Distinct points are looked up once, on each level of length that occurs; of intervals of
    equal bounds only the least name is joined; an interval lies in the buckets of its own level only, at most two.
    """
    least = F.min(F.struct(F.col(name).alias("name"))).alias("__least")  # a NULL name is the least
    distinct = intervals.filter(F.col(start) < F.col(end)).groupBy(*keys, start, end).agg(least).select(*keys, start, end, F.col("__least.name").alias(name))
    own = checkpoint(distinct.withColumn("__l", _level(F.col(end) - F.col(start), width)))
    levels = _levels(own, "__l") or [0]
    bucket = lambda x: F.coalesce(*(F.when(F.col("__l") == n, F.floor(x / F.lit(width * 2**n)).cast("bigint")) for n in levels))
    held = own.select(*keys, F.col(start).alias("__s"), F.col(end).alias("__e"), F.col(name).alias("__n"), "__l", F.explode(F.sequence(bucket(F.col(start)), bucket(F.col(end) - 1))).alias("__bucket"))
    asked = points.select(*keys, F.col(point).alias("__p")).distinct().withColumn("__l", F.explode(F.array(*(F.lit(n) for n in levels))))
    asked = asked.withColumn("__bucket", bucket(F.col("__p")))
    best = (
        asked.join(held, [*keys, "__l", "__bucket"]).filter("__p >= __s AND __p < __e").groupBy(*keys, "__p")
        .agg(F.min(F.struct((F.col("__e") - F.col("__s")).alias("length"), F.col("__s").alias("start"), F.col("__n").alias("name"))).alias("__b"))
    )
    found = best.select(*keys, F.col("__p").alias(point), F.col("__b.name").alias("container"), F.col("__b.length").alias("container_length"))
    return points.join(found, [*keys, point], "left")


def last_before(df: DataFrame, keys: Sequence[str], order: Sequence[str], is_write: Column, value: Column, name: str = "last_write") -> DataFrame:
    """Every row with the value of the last write of its key strictly before it in the order."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.last(F.when(is_write, value), ignorenulls=True).over(w))


def reaching_definitions(df: DataFrame, keys: Sequence[str], order: Sequence[str], kind: str, define: str, use: str, kill: str) -> DataFrame:
    """Uses whose last definition is not killed between: rows of `use` with def_at, the order columns' struct of the definition.

    One pass over each key's rows in order instead of an anti-join of all pairs.
    """
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    event = F.when(F.col(kind).isin(define, kill), F.struct(F.col(kind).alias("kind"), *order))
    seen = df.withColumn("__last", F.last(event, ignorenulls=True).over(w))
    return seen.filter((F.col(kind) == use) & (F.col("__last.kind") == define)).withColumn("def_at", F.struct(*(F.col(f"__last.{o}").alias(o) for o in order))).drop("__last")


def windows_between(df: DataFrame, keys: Sequence[str], order: Sequence[str], opens: Column) -> DataFrame:
    """Each row with the number of its window (from 1; 0 before the first opening row) of its key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("window_no", F.sum(F.when(opens, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def bind_arguments(calls: DataFrame, formals: DataFrame, callee: str, arguments: str, site: str) -> DataFrame:
    """Actual arguments with the formal of the same callee and slot: (site, slot, actual, formal).

    formals: callee column, slot, formal. Slots without a formal are left out.
    """
    actuals = calls.select(site, callee, F.posexplode(arguments).alias("slot", "actual"))
    return actuals.join(formals, [callee, "slot"]).select(site, callee, "slot", "actual", "formal")


def bind_returns(calls: DataFrame, returns: DataFrame, site: str, target: str, function: str) -> DataFrame:
    """Call outputs with the values their callee returns, for sites with exactly one target.

    calls: site, target, output; returns: function, value. (site, output, value).
    """
    sole = calls.groupBy(site).agg(F.min(target).alias("__t"), F.max(target).alias("__u"), F.min("output").alias("output")).filter("__t = __u")
    return sole.join(returns.select(F.col(function).alias("__t"), "value"), "__t").select(site, "output", "value")


def tiered(df: DataFrame, id_col: str, tiers: list[tuple[DataFrame, Column | Sequence[str]]], value: str) -> DataFrame:
    """Per row the value of the first tier that knows it, if that tier names just one; (id, tier, value).

    A tier is a table and the columns to join it on. A first known tier that is ambiguous stays unresolved
    (value NULL); rows that no tier knows have tier NULL.
    """
    parts = []
    for n, (side, on) in enumerate(tiers):
        parts.append(df.select("*").join(side, on).select(id_col, F.lit(n).alias("tier"), value))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    per = found.groupBy(id_col, "tier").agg(F.when(F.min(value) == F.max(value), F.min(value)).alias(value))
    best = per.groupBy(id_col).agg(F.min(F.struct("tier", value)).alias("b")).select(id_col, "b.*")
    return df.select(id_col).distinct().join(best, id_col, "left")


def best_match(pairs: DataFrame, id_col: str, tier: Column, ordinal: Sequence[str]) -> DataFrame:
    """Per id the row of the least (tier, ordinal); rows with a NULL tier do not match."""
    rest = [c for c in pairs.columns if c != id_col]
    return pairs.filter(tier.isNotNull()).groupBy(id_col).agg(F.min_by(F.struct(*rest), F.struct(tier, *ordinal)).alias("__b")).select(id_col, "__b.*")


def reconcile(expected: DataFrame, actual: DataFrame, keys: Sequence[str], fingerprint: Column) -> DataFrame:
    """Every key with its state: 'missing', 'unexpected', 'duplicate', 'conflict' or 'ok'.

    A key delivered more than once is a duplicate if all deliveries have one fingerprint, else a conflict.
    """
    have = actual.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(fingerprint).alias("kinds"))
    want = expected.select(*keys).distinct().withColumn("wanted", F.lit(True))
    state = (
        F.when(F.col("n").isNull(), "missing").when(F.col("wanted").isNull(), "unexpected")
        .when(F.col("kinds") > 1, "conflict").when(F.col("n") > 1, "duplicate").otherwise("ok")
    )
    return want.join(have, list(keys), "full_outer").select(*keys, state.alias("state"), F.coalesce("n", F.lit(0)).cast("bigint").alias("deliveries"))


def replace_by_key(base: DataFrame, new: DataFrame, keys: Sequence[str], must_replace: DataFrame | None = None) -> DataFrame:
    """Rows of base without those that new replaces, and new.

    With must_replace, the keys of new must be exactly those; else this raises (it runs one small job).
    """
    if must_replace is not None:
        a, b = new.select(*keys).distinct(), must_replace.select(*keys).distinct()
        odd = a.join(b, list(keys), "left_anti").unionByName(b.join(a, list(keys), "left_anti"))
        if not odd.isEmpty():
            raise ValueError("the replacements are not exactly the rows to replace")
    return base.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def covering_blocks(points: DataFrame, blocks: DataFrame, point: str, start: str, end: str) -> DataFrame:
    """Points with the disjoint half-open block that covers each, NULL outside; no range join.

    Blocks' starts are merged into the order of the points and carried forward, one shuffle by page.
    """
    cut = 1 << 16
    b = blocks.filter(F.col(start) < F.col(end)).select(F.col(start).alias("__s"), F.col(end).alias("__e"), "*")
    paged = b.withColumn("__page", F.explode(F.sequence(F.floor(F.col("__s") / cut), F.floor((F.col("__e") - 1) / cut))))
    p = points.withColumn("__page", F.floor(F.col(point) / cut))
    hit = p.join(paged, (p["__page"] == paged["__page"]) & (F.col(point) >= F.col("__s")) & (F.col(point) < F.col("__e")), "left")
    return hit.drop(p["__page"]).drop(paged["__page"]).drop("__s", "__e")


def display_binding(candidates: DataFrame, left: str, right: str, score: str) -> DataFrame:
    """(left, right) pairs that are each other's sole best by score; ties bind nothing."""
    lw, rw = Window.partitionBy(left), Window.partitionBy(right)
    top = candidates.filter(F.col(score).isNotNull()).withColumn("__lm", F.max(score).over(lw)).withColumn("__rm", F.max(score).over(rw))
    best = top.filter((F.col(score) == F.col("__lm")) & (F.col(score) == F.col("__rm")))
    alone = best.withColumn("__ln", F.count(F.lit(1)).over(lw)).withColumn("__rn", F.count(F.lit(1)).over(rw))
    return alone.filter("__ln = 1 AND __rn = 1").select(left, right, score)


def object_for_address(points: DataFrame, ranges: DataFrame, symbols: DataFrame, point: str, width: int = 4096) -> DataFrame:
    """Each distinct address with its object: (address, base, name, identity).

    ranges: start, end (both within), name, the tightest of which counts; else the least symbol (address, name) at the address itself; else the address.
    """
    asked = points.select(F.col(point).cast("bigint").alias("address")).filter("address IS NOT NULL").distinct()
    held = ranges.select(F.col("start").cast("bigint").alias("start"), (F.col("end") + 1).cast("bigint").alias("end"), F.struct("start", "name").alias("held"))
    tight = tightest_container(asked, held, [], "address", "start", "end", "held", width)
    exact = symbols.groupBy(F.col("address").cast("bigint").alias("address")).agg(F.min("name").alias("exact"))
    both = tight.join(exact, "address", "left")
    identity = F.when(F.col("container").isNotNull(), "ELF_OBJECT_SYMBOL_RANGE").when(F.col("exact").isNotNull(), "ELF_SYMBOL_EXACT_ADDRESS").otherwise("EXACT_ADDRESS")
    return both.select("address", F.coalesce("container.start", "address").alias("base"), F.coalesce("container.name", "exact", F.lit("")).alias("name"), identity.alias("identity"))


#: What an argument's text scores beside an actual, and the least score that binds.
SAME_CONSTANT, LONE_LITERAL, SAME_NAME, SAME_SLOT, BOTH_FREE, LEAST_SCORE = 12, -4, 6, 5, 1, 5


def display_scores(ops: DataFrame, texts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, site, text_no, score) of the calls and texts of a group that may be the same: as many arguments, and no two numbers that differ.

    ops: keys, site, actuals array<struct<constant, name, slot>>; texts: keys, text_no, arguments array<string>. Calls of one function to one callee are few.
    """
    both = ops.select(*keys, "site", "actuals").join(texts.select(*keys, "text_no", "arguments"), list(keys)).filter(F.size("actuals") == F.size("arguments"))

    def item(argument: Column, actual: Column) -> Column:
        number = literal_integer(argument)
        plain = lambda c: F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", ""))
        words = F.transform(F.regexp_extract_all(argument, F.lit(r"[A-Za-z_]\w*"), F.lit(0)), F.lower)
        name = plain(actual["name"])
        named = (name != "") & ((name == plain(argument)) | F.array_contains(words, name))
        slot = F.coalesce(F.array_contains(words, F.concat(F.lit("arg"), actual["slot"].cast("string"))), F.lit(False))
        free = F.when(named, SAME_NAME).otherwise(0) + F.when(slot, SAME_SLOT).otherwise(0) + F.when(actual["constant"].isNull(), BOTH_FREE).otherwise(0)
        return F.when(number.isNull(), free).when(actual["constant"].isNull(), LONE_LITERAL).when(number == actual["constant"], SAME_CONSTANT)

    scores = F.zip_with(F.transform("arguments", lambda a: F.trim(F.coalesce(a, F.lit("")))), "actuals", item)
    scored = both.withColumn("scores", scores).filter(~F.exists("scores", F.isnull))
    return scored.select(*keys, "site", "text_no", F.aggregate("scores", F.lit(0), lambda a, x: a + x).alias("score"))


def bind_displays(ops: DataFrame, texts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, site, text_no): calls bound to their texts where the evidence tells, round by round; what stays ambiguous is bound to nothing.

    In a round each call and text that are each other's only best, with at least LEAST_SCORE, are bound; a call and a text that
    are the last of their group are bound unless they contradict each other.
    """
    scores = checkpoint(display_scores(ops, texts, keys))
    calls, lines = checkpoint(ops.select(*keys, "site").distinct()), checkpoint(texts.select(*keys, "text_no").distinct())
    bound = None
    while True:
        left, right, open_ = calls, lines, scores
        if bound is not None:
            left, right = left.join(bound, [*keys, "site"], "left_anti"), right.join(bound, [*keys, "text_no"], "left_anti")
            open_ = open_.join(bound, [*keys, "site"], "left_anti").join(bound, [*keys, "text_no"], "left_anti")
        last = left.groupBy(*keys).agg(F.count("*").alias("__n")).filter("__n = 1").join(right.groupBy(*keys).agg(F.count("*").alias("__m")).filter("__m = 1"), list(keys)).select(*keys)
        lone = open_.join(last, list(keys), "left_semi").select(*keys, "site", "text_no")
        lw, rw = Window.partitionBy(*keys, "site"), Window.partitionBy(*keys, "text_no")
        top = open_.withColumns({"__lm": F.max("score").over(lw), "__rm": F.max("score").over(rw)})
        top = top.withColumns({"__ln": F.count_if(F.col("score") == F.col("__lm")).over(lw), "__rn": F.count_if(F.col("score") == F.col("__rm")).over(rw)})
        best = top.filter(f"score >= {LEAST_SCORE} AND score = __lm AND score = __rm AND __ln = 1 AND __rn = 1").join(last, list(keys), "left_anti").select(*keys, "site", "text_no")
        found = checkpoint(lone.unionByName(best).distinct())
        if found.isEmpty():
            return scores.select(*keys, "site", "text_no").filter("false") if bound is None else bound
        bound = found if bound is None else checkpoint(bound.unionByName(found))
