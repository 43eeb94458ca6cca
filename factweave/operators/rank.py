"""Rankings, top-k and subsumption with total orders."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def global_rank(df: DataFrame, order: Sequence[Column], name: str = "rank", parts: int | None = None) -> DataFrame:
    """Ranks from 1 over the whole table without one task holding it all.

    Rows are range-partitioned by the order; each partition counts its rows, and starts at the sum of
    those before it. The counts (one per partition) are all that is gathered. There are as many partitions as the
    session shuffles into, so their size is what its settings make it.
    """
    from factweave.session import checkpoint

    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    spread = checkpoint(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()))
    sizes = sorted((r[0], r[1]) for r in spread.groupBy("__part").count().collect())
    starts, total = [], 0
    for part, n in sizes:
        starts.append((part, total))
        total += n
    offsets = df.sparkSession.createDataFrame(starts or [(0, 0)], "__part int, __from bigint")
    w = Window.partitionBy("__part").orderBy(*order)
    ranked = spread.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__from") + F.row_number().over(w))
    return ranked.drop("__part", "__from")


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """Every row of a group with its place, and selected for the first k: both halves are results."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("place", F.row_number().over(w).cast("bigint")).withColumn("selected", F.col("place") <= k)


def diverse_top_k(df: DataFrame, keys: Sequence[str], boundary: str, order: Sequence[Column], k: int) -> DataFrame:
    """Top k per group, the best row of every boundary first, then by rank; a NULL boundary only fills up."""
    inner = Window.partitionBy(*keys, boundary).orderBy(*order)
    seen = df.withColumn("__again", (F.row_number().over(inner) > 1) | F.col(boundary).isNull())
    w = Window.partitionBy(*keys).orderBy(F.col("__again").asc(), *order)
    return seen.withColumn("place", F.row_number().over(w).cast("bigint")).filter(F.col("place") <= k).drop("__again")


def diverse_sets(df: DataFrame, keys: Sequence[str], id_col: str, sites: str, rank: str, limit: int) -> DataFrame:
    """Per group the ids chosen greedily, a row if it adds an uncovered site, then filled by rank.

    Returns keys, id, place, selected_for. The greedy choice is sequential, so a group is one task's; its
    rows enter as (id, sites, rank) only.
    """
    held = df.select(*keys, F.col(id_col).cast("string").alias("id"), F.col(sites).alias("sites"), F.col(rank).alias("rank"))
    keyed = ", ".join(f"{k} {t}" for k, t in held.select(*keys).dtypes)

    def choose(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values(["rank", "id"], kind="stable")
        covered: set = set()
        first, rest = [], []
        for row_id, own in zip(rows["id"], rows["sites"]):
            own = set() if own is None else set(own)
            if own - covered and len(first) < limit:
                covered |= own
                first.append(row_id)
            else:
                rest.append(row_id)
        chosen = [(x, "DISTINCT_SINK_CALLSITE") for x in first] + [(x, "ADDITIONAL_SOURCE_LINEAGE") for x in rest]
        return pd.DataFrame([(*key, x, n, why) for n, (x, why) in enumerate(chosen[:limit], 1)], columns=[*keys, "id", "place", "selected_for"])

    return held.groupBy(*keys).applyInPandas(choose, f"{keyed}, id string, place bigint, selected_for string")


def exact_dedup(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], id_col: str) -> tuple[DataFrame, DataFrame]:
    """(canonical rows with represented ids, merged ids with their canonical one), by a map-side minimum."""
    rest = [c for c in df.columns if c not in set(group)]
    g = df.groupBy(*group).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r"), F.array_sort(F.collect_set(id_col)).alias("represented_ids"))
    canonical = g.select(*group, "__r.*", "represented_ids")
    merged = canonical.select(F.col(id_col).alias("canonical_id"), F.explode("represented_ids").alias("duplicate_id")).filter("canonical_id <> duplicate_id")
    return canonical, merged


def subsumption(df: DataFrame, group: Sequence[str], id_col: str, items: str, weight: Column) -> DataFrame:
    """(group, id, parent): the first representative whose set lies within the row's; NULL for representatives.

    A row is a representative if no earlier one in (set size, -weight, id) has a subset of its set. Rows of
    equal sets are one class, decided at once. A set's possible subsets are found over its least item: a
    subset's least-frequent item is among the row's items, so classes meet by an equi-join on (group,
    rarest item) and not all with all. The empty set is a subset of every one.
    """
    ranked = df.select(*group, F.col(id_col).alias("id"), F.array_sort(F.array_distinct(F.coalesce(F.col(items), F.array().cast(df.schema[items].dataType)))).alias("s"), weight.alias("w"))
    first = F.struct((-F.col("w")).alias("nw"), F.col("id").alias("id"))
    sets = ranked.groupBy(*group, "s").agg(F.min(first).alias("f"))
    order = F.struct(F.size("s").alias("n"), F.col("f.nw").alias("nw"), F.col("f.id").alias("id"))
    sets = sets.select(*group, "s", order.alias("o"))
    often = sets.select(*group, F.explode("s").alias("i")).groupBy(*group, "i").count()
    rare = sets.select(*group, "s", F.explode("s").alias("i")).join(often, [*group, "i"]).groupBy(*group, "s").agg(F.min_by("i", F.struct("count", "i")).alias("i"))
    small = sets.join(rare, [*group, "s"]).select(*group, "i", F.col("s").alias("s2"), F.col("o").alias("o2"))
    empty = sets.filter(F.size("s") == 0).select(*group, F.lit(True).alias("none"), F.col("o").alias("o2"))
    within = (
        sets.select(*group, "s", "o", F.explode("s").alias("i")).join(small, [*group, "i"])
        .filter((F.col("o2") < F.col("o")) & (F.size(F.array_except("s2", "s")) == 0)).select(*group, "s", "o2")
    )
    within = within.unionByName(sets.filter(F.size("s") > 0).join(empty, list(group)).select(*group, "s", "o2"))
    parent = within.groupBy(*group, "s").agg(F.min("o2").alias("p"))
    heads = sets.join(parent, [*group, "s"], "left").select(*group, "s", F.coalesce("p.id", "o.id").alias("head"))
    return ranked.join(heads, [*group, "s"]).select(*group, "id", F.when(F.col("head") != F.col("id"), F.col("head")).alias("parent"))


def last_items(array: Column | str, n: int) -> Column:
    """The last n items of an array."""
    a = F.col(array) if isinstance(array, str) else array
    return F.when(F.size(a) > n, F.slice(a, F.size(a) - (n - 1), n)).otherwise(a)


def context_pairs(objects: DataFrame, k: int) -> DataFrame:
    """Per object its best k pairs of a producer and a consumer context: (object, src, dst, score, place).

    objects: object, ordinal, producers, consumers (arrays), confidence, quality, ambiguity, dma_buffer. A pair has two contexts, is not from
    DMA or ISR straight to TASK, and has no unknown one unless DMA produces. The score is 0.55 confidence + 0.35 quality - 0.15 ambiguity, with 0.1
    for DMA and 0.05 for its buffers, each at most 1 in all. Ties go to the earlier producer, then consumer. A pair that occurs again for
    the same object, in a later row by ordinal, is dropped after the cut. An object's contexts are few.
    """
    src, dst = F.col("src"), F.col("dst")
    each = objects.select("object", "ordinal", F.posexplode("producers").alias("i", "src"), "consumers", "confidence", "quality", "ambiguity", "dma_buffer").withColumns({"d": F.explode(F.arrays_zip(F.transform("consumers", lambda _, n: n).alias("j"), F.col("consumers").alias("dst")))})
    pair = each.select("object", "ordinal", "i", F.col("d.j").alias("j"), "src", F.col("d.dst").alias("dst"), "confidence", "quality", "ambiguity", "dma_buffer")
    pair = pair.filter((src != dst) & ~(src.isin("DMA", "ISR") & (dst == "TASK")) & ((src == "DMA") | ((src != "UNKNOWN") & (dst != "UNKNOWN"))))
    base = 0.55 * F.col("confidence") + 0.35 * F.col("quality") - 0.15 * F.col("ambiguity")
    dma = F.when(src == "DMA", F.least(F.lit(1.0), base + 0.10)).otherwise(base)
    score = F.when(F.col("dma_buffer"), F.least(F.lit(1.0), dma + 0.05)).otherwise(dma)
    best = top_k(pair.withColumn("score", score), ["object", "ordinal"], [F.desc("score"), F.asc("i"), F.asc("j")], k).filter("selected")
    first = best.groupBy("object", "src", "dst").agg(F.min_by(F.struct("score", "place"), F.col("ordinal")).alias("b"))
    return first.select("object", "src", "dst", F.round("b.score", 4).alias("score"), F.col("b.place").alias("place"))
