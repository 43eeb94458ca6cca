"""Shared-object mining over typed accesses (G26), without meeting all writes with all reads.

Writes and reads of an object are first brought to classes: distinct (function, certain context, region).
A class counts once, however often it was accessed, and a region pair is found through buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.functions.region import EXACT, MAY, fixed
from factweave.operators.joins import interval_overlaps
from factweave.session import checkpoint


def overlapping_regions(accesses: DataFrame, keys: Sequence[str], width: int = 64) -> DataFrame:
    """R4 pairs of distinct write and read regions of an object: keys, both regions, their rows and the shared range.

    accesses: keys, edge_kind, region_offset, region_extent, selector_terms. Only certain regions take part.
    """
    held = accesses.filter(fixed(F.col("region_offset"), F.col("region_extent"), F.col("selector_terms")))
    spans = held.withColumn("start", F.col("region_offset")).withColumn("end", F.col("region_offset") + F.col("region_extent"))
    return interval_overlaps(spans.filter("edge_kind = 'WRITE'"), spans.filter("edge_kind = 'READ'"), keys, "start", "end", width, ("_w", "_r"))


def shared_regions(accesses: DataFrame, object_key: Sequence[str], width: int = 64) -> DataFrame:
    """G26 among certain regions only: per write region of an object, whether another function reads it, and how certainly.

    Selector-based accesses take no part; shared_accesses has them.

    Returns object_key, start, end, writers, readers (distinct functions), relation and admitted; a region
    that isn't admitted has a reason: no read at all, only disjoint reads, only reads by its own writers.
    """
    held = accesses.filter("function_id IS NOT NULL")
    for k in object_key:
        held = held.filter(F.col(k).isNotNull())
    certain = fixed(F.col("region_offset"), F.col("region_extent"), F.col("selector_terms"))
    typed = held.filter(certain).withColumn("start", F.col("region_offset")).withColumn("end", F.col("region_offset") + F.col("region_extent"))
    one = F.array_distinct(F.coalesce("deterministic_context_ids", F.array().cast("array<string>")))
    typed = typed.withColumn("context", F.when(F.size(one) == 1, one[0]))
    writes, reads = typed.filter("edge_kind = 'WRITE'"), typed.filter("edge_kind = 'READ'")
    pairs = interval_overlaps(writes, reads, object_key, "start", "end", width, ("_w", "_r"))
    per_read = reads.groupBy(*object_key, F.col("start").alias("start_r"), F.col("end").alias("end_r")).agg(
        F.collect_set("function_id").alias("rf"), F.collect_set(F.struct("function_id", "context")).alias("rc")
    )
    regions = writes.groupBy(*object_key, F.col("start").alias("start_w"), F.col("end").alias("end_w")).agg(
        F.collect_set("function_id").alias("wf"), F.collect_set(F.struct("function_id", "context")).alias("wc")
    )
    near = pairs.join(per_read, [*object_key, "start_r", "end_r"]).groupBy(*object_key, "start_w", "end_w").agg(
        F.array_distinct(F.flatten(F.collect_list("rf"))).alias("rf"), F.array_distinct(F.flatten(F.collect_list("rc"))).alias("rc")
    )
    any_read = held.filter("edge_kind = 'READ'").select(*object_key, F.lit(True).alias("read")).distinct()
    full = regions.join(near, [*object_key, "start_w", "end_w"], "left").join(any_read, list(object_key), "left")
    # another function reads: not all readers and writers are one and the same function
    other = (F.size(F.array_union("wf", "rf")) > 1) & F.col("rf").isNotNull()
    sure = F.exists("wc", lambda w: F.exists("rc", lambda r: (w["function_id"] != r["function_id"]) & (w["context"] != r["context"])))
    reason = (
        F.when(F.col("read").isNull(), "object_has_no_read").when(F.col("rf").isNull(), "only_disjoint_reads").when(~other, "only_same_function_reads")
    )
    return full.select(
        *object_key, F.col("start_w").alias("start"), F.col("end_w").alias("end"), F.size("wf").cast("bigint").alias("writers"), F.coalesce(F.size("rf"), F.lit(0)).cast("bigint").alias("readers"),
        F.when(reason.isNull(), F.when(F.coalesce(sure, F.lit(False)), "DISTINCT_DETERMINISTIC_CONTEXT").otherwise("DISTINCT_FUNCTION_HEURISTIC_CONTEXT")).alias("relation"),
        reason.isNull().alias("admitted"), reason.alias("reason"),
    )


def shared_accesses(accesses: DataFrame, object_key: Sequence[str], width: int = 64) -> DataFrame:
    """G26 over all accesses by R2: per write class of an object, whether another function reads it, and how certainly.

    A class is a fixed region, all selector-based accesses of the object together ('dynamic'), or a region
    without certain bounds ('unknown'). Fixed regions meet by overlap; a dynamic side meets every access of
    the object as MAY_OVERLAP; an unknown side without a dynamic one meets nothing. Instead of meeting pairs,
    dynamic sides meet a summary per object: by context the least and greatest function, of which any two
    sets differ unless both are one and the same function.

    Returns object_key, region, region_offset, region_extent (NULL if dynamic), writers, readers,
    region_relation, relation, admitted and reason, the last three as in shared_regions.
    """
    keys, at = list(object_key), ["region", "region_offset", "region_extent"]
    held = accesses.filter("function_id IS NOT NULL AND edge_kind IN ('WRITE', 'READ')")
    for k in keys:
        held = held.filter(F.col(k).isNotNull())
    dynamic = F.size(F.coalesce("selector_terms", F.array())) > 0
    region = F.when(dynamic, "dynamic").when(fixed(F.col("region_offset"), F.col("region_extent"), F.col("selector_terms")), "fixed").otherwise("unknown")
    one = F.array_distinct(F.coalesce("deterministic_context_ids", F.array().cast("array<string>")))
    typed = checkpoint(
        held.select(
            *keys, "edge_kind", "function_id", F.when(F.size(one) == 1, one[0]).alias("context"), region.alias("region"),
            *(F.when(~dynamic, F.col(c)).alias(c) for c in at[1:]),
        )
    )
    writes, reads = typed.filter("edge_kind = 'WRITE'"), typed.filter("edge_kind = 'READ'")
    lo, hi = F.min("function_id").alias("lo"), F.max("function_id").alias("hi")
    spread = lambda a, b: F.collect_list(F.when(F.col(a).isNotNull(), F.struct("context", F.col(a).alias("lo"), F.col(b).alias("hi"))))

    by_function = reads.groupBy(*keys, "function_id").agg(F.bool_or(F.col("region") == "dynamic").alias("may"))
    counts = by_function.groupBy(*keys).agg(F.count(F.lit(1)).alias("all_n"), F.count_if("may").alias("may_n"))
    may_f = F.when(F.col("region") == "dynamic", F.col("function_id"))
    objects = reads.groupBy(*keys, "context").agg(lo, hi, F.min(may_f).alias("may_lo"), F.max(may_f).alias("may_hi"))
    objects = objects.groupBy(*keys).agg(spread("lo", "hi").alias("all_r"), spread("may_lo", "may_hi").alias("may_r")).join(counts, keys)

    wide = lambda df: df.filter("region = 'fixed'").withColumn("start", F.col("region_offset")).withColumn("end", F.col("region_offset") + F.col("region_extent"))
    pairs = interval_overlaps(wide(writes), wide(reads), keys, "start", "end", width, ("_w", "_r")).select(*keys, "start_w", "end_w", "start_r", "end_r")
    readers = wide(reads).join(by_function, [*keys, "function_id"]).select(*keys, F.col("start").alias("start_r"), F.col("end").alias("end_r"), "function_id", "context", "may")
    near = pairs.join(readers, [*keys, "start_r", "end_r"]).groupBy(*keys, "start_w", "end_w", "context").agg(lo, hi, F.collect_set(F.when(~F.col("may"), F.col("function_id"))).alias("f"))
    near = near.groupBy(*keys, "start_w", "end_w").agg(spread("lo", "hi").alias("near_r"), F.size(F.array_distinct(F.flatten(F.collect_list("f")))).alias("near_n"))
    near = near.select(*keys, F.lit("fixed").alias("region"), F.col("start_w").alias("region_offset"), (F.col("end_w") - F.col("start_w")).alias("region_extent"), "near_r", "near_n")

    # by a null-safe grouping, as an unknown region may lack either bound
    classes = writes.groupBy(*keys, *at, "context").agg(lo, hi, F.collect_set("function_id").alias("f")).groupBy(*keys, *at).agg(
        spread("lo", "hi").alias("w"), F.size(F.array_distinct(F.flatten(F.collect_list("f")))).alias("writers")
    )
    full = classes.join(near, [*keys, *at], "left").join(objects, keys, "left")
    none = F.array().cast(objects.schema["all_r"].dataType)
    whole = F.col("region") == "dynamic"
    full = full.withColumn("may", F.coalesce(F.when(whole, F.col("all_r")).otherwise(F.col("may_r")), none)).withColumn("r", F.concat("may", F.coalesce("near_r", none)))
    full = full.withColumn("readers", F.coalesce(F.when(whole, F.col("all_n")).otherwise(F.col("may_n")), F.lit(0)) + F.coalesce("near_n", F.lit(0)))
    differ = lambda x, y: F.least(x["lo"], y["lo"]) != F.greatest(x["hi"], y["hi"])
    other = lambda r: F.exists("w", lambda x: F.exists(r, lambda y: differ(x, y)))
    sure = F.coalesce(F.exists("w", lambda x: F.exists("r", lambda y: differ(x, y) & (x["context"] != y["context"]))), F.lit(False))
    reason = F.when(F.col("all_n").isNull(), "object_has_no_read").when(F.size("r") == 0, "only_disjoint_reads").when(~other("r"), "only_same_function_reads")
    return full.select(
        *keys, *at, F.col("writers").cast("bigint").alias("writers"), F.col("readers").cast("bigint").alias("readers"),
        F.when(reason.isNull(), F.when(other("may"), MAY).otherwise(EXACT)).alias("region_relation"),
        F.when(reason.isNull(), F.when(sure, "DISTINCT_DETERMINISTIC_CONTEXT").otherwise("DISTINCT_FUNCTION_HEURISTIC_CONTEXT")).alias("relation"),
        reason.isNull().alias("admitted"), reason.alias("reason"),
    )
