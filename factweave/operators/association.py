"""Where values of sources may be, by rules over facts, and the channels that carry them on.

A state says that a lineage's data is a value of a function (VALUE), the content of a region (MEMORY_CONTENT), or pointed at by
a value or a region (OBJECT_REFERENCE). The rules move states to states; each round joins only what is new or better with the facts.
Per state the least depth is kept, then exact over may. Depth counts channel hops, which only the alternation adds.

- an operation, argument or return: a value's data is in the output; a reference only passes copies, casts and pointer
  sums, and a merge only if every input refers to the same object for the same lineage;
- a load through a value that is or refers to the data: the loaded value (through a plain value: may);
- a store of the value: the region stored to;
- a call that writes the value out: the region at its actual;
- a read of a region: the value read, exact only where the regions surely share bytes;
- a primitive copy from the object: the region copied to;
- an argument at the object: a reference.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.operators.fixpoint import MERGE
from factweave.operators.graph import MAX_CHANNEL_DEPTH
from factweave.session import checkpoint

#: Operations through which a reference passes.
REFERENCE_OPERATIONS = ("CAST", "COPY", "MULTIEQUAL", "PTRADD", "PTRSUB")
#: What stands for an unknown start or end of a region.
UNKNOWN = -1

KEYS = ("lineage", "state", "function", "atom", "object", "start", "end", "pointee")
_COST = ("depth", "may")


@dataclass(frozen=True)
class Flows:
    """The tables of the rules; ids that are missing are '', starts and ends that are unknown -1, may is 0 or 1.

    moves: function, atom, to_function, to_atom, mnemonic, site (operations, arguments and returns). merges: function,
    to_atom, atom (each input of a merge). loads: function, address_atom, atom, site. writes, reads: function, atom, object, start, end,
    may, site. outputs: function, atom (the value), caller, actual_atom, object, start, end, may, site. copies: source (an
    object), function, atom, object, start, end, may, site. actuals: root (an object), function, atom, object, site. accesses: writes and reads with their edge_kind (WRITE or READ), where both
    are of one table.
    """

    moves: DataFrame
    merges: DataFrame
    loads: DataFrame
    writes: DataFrame
    reads: DataFrame
    outputs: DataFrame
    copies: DataFrame
    actuals: DataFrame
    accesses: DataFrame | None = None


def _best(df: DataFrame) -> DataFrame:
    """Per state the least cost, with the relation and site that it came by, the least of equals."""
    order = F.struct(*_COST, "relation", "site")
    return df.groupBy(*KEYS).agg(F.min(order).alias("b")).select(*KEYS, "b.*")


def _state(df: DataFrame, state: str | Column, relation: str | Column, may: Column, **columns: str) -> DataFrame:
    """States of df, which has a state's lineage and depth under their names; columns name the rest, '' where absent."""
    at = {"function": "", "atom": "", "object": "", "pointee": "", "site": "site", **columns}
    text = lambda c: F.coalesce(F.col(at[c]), F.lit("")).alias(c) if at[c] else F.lit("").alias(c)
    number = lambda c: F.coalesce(F.col(at[c]), F.lit(UNKNOWN)).cast("bigint").alias(c) if at.get(c) else F.lit(UNKNOWN).cast("bigint").alias(c)
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return df.select("lineage", lit(state).alias("state"), text("function"), text("atom"), text("object"), number("start"), number("end"), text("pointee"), F.col("depth"), may.cast("int").alias("may"), lit(relation).alias("relation"), text("site"))


def apply_rules(delta: DataFrame, seen: DataFrame, flows: Flows) -> DataFrame:
    """One round: the states that the rules make of delta, given all that is seen (with delta)."""
    d = delta.select("lineage", "depth", F.col("may").alias("d_may"), F.col("state").alias("d_state"), F.col("function").alias("d_function"), F.col("atom").alias("d_atom"), F.col("object").alias("d_object"), F.col("start").alias("d_start"), F.col("end").alias("d_end"), F.col("pointee").alias("d_pointee"))
    value, reference, content = (F.col("d_state") == s for s in ("VALUE", "OBJECT_REFERENCE", "MEMORY_CONTENT"))
    may = F.col("d_may")
    live = d.filter((value | reference) & (F.col("d_function") != "") & (F.col("d_atom") != ""))
    here = lambda t, atom="atom": live.join(t, (F.col("d_function") == F.col("function")) & (F.col("d_atom") == F.col(atom)))

    moved = here(flows.moves)
    passes = value | F.col("mnemonic").isin(*[m for m in REFERENCE_OPERATIONS if m != "MULTIEQUAL"])
    plain = moved.filter(passes)
    # a merge passes a reference that every input has
    asked = moved.filter(reference & (F.col("mnemonic") == "MULTIEQUAL") & (F.col("d_pointee") != ""))
    held = seen.filter("state = 'OBJECT_REFERENCE'").select("lineage", F.col("pointee").alias("d_pointee"), F.col("function").alias("m_function"), F.col("atom").alias("m_atom")).distinct()
    inputs = flows.merges.select(F.col("function").alias("m_function"), F.col("to_atom").alias("m_to"), F.col("atom").alias("m_atom")).distinct()
    lacking = (
        asked.select("lineage", "d_pointee", F.col("function").alias("m_function"), F.col("to_atom").alias("m_to")).distinct()
        .join(inputs, ["m_function", "m_to"]).join(held, ["lineage", "d_pointee", "m_function", "m_atom"], "left_anti").select("lineage", "d_pointee", F.col("m_function").alias("function"), F.col("m_to").alias("to_atom")).distinct()
    )
    merged = asked.join(inputs.select(F.col("m_function").alias("function"), F.col("m_to").alias("to_atom")).distinct(), ["function", "to_atom"], "left_semi").join(lacking, ["lineage", "d_pointee", "function", "to_atom"], "left_anti")
    columns = [F.col(c) for c in plain.columns]
    steps = [_state(plain.unionByName(merged.select(*columns)), F.col("d_state"), "OPERATION_TRANSFER", may, function="to_function", atom="to_atom", pointee="d_pointee")]

    through = here(flows.loads, "address_atom")
    steps.append(_state(through, "VALUE", F.when(reference, "LOAD_THROUGH_SOURCE_OBJECT_REFERENCE").otherwise("LOAD_THROUGH_SOURCE_VALUE_POINTER"), F.when(reference, may).otherwise(1), function="function", atom="atom"))

    kept = F.when(reference, F.lit("OBJECT_REFERENCE")).otherwise(F.lit("MEMORY_CONTENT"))
    region = dict(object="object", start="start", end="end", pointee="d_pointee")
    steps.append(_state(here(flows.writes), kept, F.when(reference, "CONCRETE_STORE_REFERENCE").otherwise("CONCRETE_STORE_VALUE"), F.greatest(may, F.col("may")), function="function", atom="atom", **region))
    steps.append(_state(here(flows.outputs).filter("object <> ''"), kept, "CALL_OUTPUT_EFFECT", F.greatest(may, F.col("may")), function="caller", atom="actual_atom", **region))

    # a state's objects: its own and the one it refers to
    roots = d.filter(content | reference).withColumn("root", F.explode(F.array_distinct(F.filter(F.array("d_object", "d_pointee"), lambda x: x != ""))))
    known = (F.col("d_start") >= 0) & (F.col("d_end") >= 0) & (F.col("start") >= 0) & (F.col("end") >= 0)
    apart = known & ~((F.col("d_start") < F.col("end")) & (F.col("start") < F.col("d_end")))
    read = roots.filter(content).join(flows.reads, F.col("root") == F.col("object")).filter(~apart & (F.col("atom") != ""))
    steps.append(_state(read, "VALUE", "CONCRETE_LOAD_FROM_SOURCE_MEMORY", F.greatest(may, F.col("may"), F.when(known, 0).otherwise(1)), function="function", atom="atom"))
    copied = roots.join(flows.copies, F.col("root") == F.col("source")).filter("object <> '' AND atom <> ''")
    steps.append(_state(copied, "MEMORY_CONTENT", "PROVED_PRIMITIVE_MEMORY_EFFECT", F.greatest(may, F.col("may")), function="function", atom="atom", object="object", start="start", end="end"))
    actual = roots.filter(content).withColumn("pointed", F.coalesce(F.nullif("d_object", F.lit("")), "d_pointee")).withColumnRenamed("root", "d_root").join(flows.actuals, F.col("d_root") == F.col("root"))
    steps.append(_state(actual, "OBJECT_REFERENCE", "SOURCE_ASSOCIATED_CALL_ACTUAL", may, function="function", atom="atom", object="object", pointee="pointed"))
    return reduce(DataFrame.unionByName, steps)


def _seeded(seeds: DataFrame) -> DataFrame:
    have = set(seeds.columns)
    text = lambda c: (F.coalesce(F.col(c), F.lit("")) if c in have else F.lit("")).alias(c)
    number = lambda c, none: (F.coalesce(F.col(c), F.lit(none)) if c in have else F.lit(none)).alias(c)
    return seeds.select(
        "lineage", "state", text("function"), text("atom"), text("object"), number("start", UNKNOWN).cast("bigint"), number("end", UNKNOWN).cast("bigint"), text("pointee"),
        number("depth", 0).cast("int"), number("may", 0).cast("int"), (F.coalesce("relation", F.lit("SEED")) if "relation" in have else F.lit("SEED")).alias("relation"), text("site"),
    )


@dataclass(frozen=True)
class Associations:
    """rows: lineage, state, function, atom, object, start, end, pointee, depth, may, relation, site. rejects: seeds past the depth limit. complete: whether the fixed point was reached."""

    rows: DataFrame
    rejects: DataFrame
    complete: bool


def _spread(seen: DataFrame | None, start: DataFrame, flows: Flows, rounds: int) -> tuple[DataFrame, bool]:
    """seen with start and all that the rules make of it, and whether the rounds sufficed."""

    def improved(new: DataFrame, parts: list[DataFrame]) -> DataFrame:
        new = checkpoint(new)
        met = reduce(DataFrame.unionByName, parts).join(new.select(*KEYS), list(KEYS), "left_semi").groupBy(*KEYS).agg(F.min(F.struct(*_COST)).alias("__old"))
        return checkpoint(new.join(met, list(KEYS), "left").filter(F.col("__old").isNull() | (F.struct(*_COST) < F.col("__old"))).drop("__old"))

    delta = checkpoint(_best(start)) if seen is None else improved(_best(start), [seen])
    parts = [delta] if seen is None else [seen, delta]
    whole = lambda: checkpoint(_best(reduce(DataFrame.unionByName, parts)))
    for _ in range(rounds):
        if delta.isEmpty():
            return whole(), True
        delta = improved(_best(apply_rules(delta, reduce(DataFrame.unionByName, parts), flows)), parts)
        parts.append(delta)
        if len(parts) > MERGE:
            parts[:] = [whole()]
    return whole(), delta.isEmpty()


def _limited(start: DataFrame, max_depth: int) -> tuple[DataFrame, DataFrame]:
    over = start.filter(F.col("depth") > max_depth).select(*KEYS, "depth", F.lit("source_association_channel_depth_limit_reached").alias("reason"))
    return start.filter(F.col("depth") <= max_depth), over


def associate(flows: Flows, seeds: DataFrame, max_depth: int = MAX_CHANNEL_DEPTH, rounds: int = 1000) -> Associations:
    """The fixed point of the rules from the seeds (lineage, state and any of a state's other columns).

    Seeds past max_depth are rejects, not dropped. Repeated seeds and facts change nothing; empty tables give an empty
    result; a search that the rounds cut off says so in complete.
    """
    start, over = _limited(_seeded(seeds), max_depth)
    rows, complete = _spread(None, start, flows, rounds)
    return Associations(rows, over.distinct(), complete)


def channels(rows: DataFrame, flows: Flows) -> DataFrame:
    """The channels that the associations show: seeds one hop on, where another function reads what a lineage's data was written to."""
    w = rows.filter("state = 'MEMORY_CONTENT' AND object <> ''").select("lineage", "depth", F.col("may").alias("d_may"), F.col("function").alias("writer"), F.col("object").alias("w_object"), F.col("start").alias("w_start"), F.col("end").alias("w_end"))
    known = (F.col("w_start") >= 0) & (F.col("w_end") >= 0) & (F.col("start") >= 0) & (F.col("end") >= 0)
    meets = ~known | ((F.col("w_start") < F.col("end")) & (F.col("start") < F.col("w_end")))
    met = w.join(flows.reads, F.col("w_object") == F.col("object")).filter(meets & (F.col("writer") != F.col("function")) & (F.col("atom") != ""))
    hop = met.withColumn("depth", F.col("depth") + 1)
    # the content that is read, as the reader refers to it
    return _state(hop, "OBJECT_REFERENCE", "CHANNEL_RELATION_TRANSFER", F.greatest("d_may", "may", F.when(known, 0).otherwise(1)), function="function", atom="atom", object="object", pointee="object")


def alternate(flows: Flows, seeds: DataFrame, max_depth: int = MAX_CHANNEL_DEPTH, outer: int = 9, rounds: int = 1000) -> Associations:
    """Associations, the channels they show, and associations from those, until neither grows.

    Channels are mined again from all associations in each outer round. complete is false where `outer` rounds or the rules' rounds end it.
    """
    start, over = _limited(_seeded(seeds), max_depth)
    rows, complete = _spread(None, start, flows, rounds)
    rejects = [over]
    for _ in range(outer):
        start, over = _limited(channels(rows, flows), max_depth)
        rejects.append(over)
        before = rows.agg(F.count("*"), F.sum("depth"), F.sum("may")).first()
        rows, inner = _spread(rows, start, flows, rounds)
        complete = complete and inner
        if rows.agg(F.count("*"), F.sum("depth"), F.sum("may")).first() == before:
            return Associations(rows, checkpoint(reduce(DataFrame.unionByName, rejects).distinct()), complete)
    return Associations(rows, reduce(DataFrame.unionByName, rejects).distinct(), False)
