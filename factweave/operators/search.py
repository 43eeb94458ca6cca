"""Backward reaching definitions over program facts, every search at once.

A search starts at a sink's argument and walks definitions backwards, level by level: each level is a few joins of the
new states with the tables of facts, one per rule, and their union. A state is (value, object, depth of calls entered,
call edges entered); it is expanded once, by its least path, so the work is bounded by states and not by paths.
The rules, in the order in which they hold:

- a read of shared memory that defines the value, or at the sink's own site (then nothing else of the state but aliases is
  followed, as the bytes matter and not the pointer): the writers of overlapping regions;
- a formal parameter: the actuals of its callers, or of the one caller through which the search came;
- a primitive copy into the value or its object, each effect once a path;
- a container alias, a MAY step, each once a path;
- a call's result: the returns of its one target, within limits;
- a load without a known read: call outputs and stores at its address, and the address itself;
- any other operation: its inputs that are no constants;
- an object without any of these: the writers of it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.session import checkpoint

#: The limits of entering calls.
MAX_CALL_DEPTH, MAX_ALTERNATIVES = 3, 8

_KEY = ("search", "atom", "object", "call_depth", "context")
STEP = "struct<kind:string,site:string>"


@dataclass(frozen=True)
class Facts:
    """The tables a search reads; ids that are missing are ''. Regions are [start, end), NULL where unknown.

    definitions: atom, function, site, mnemonic, address_atom, address_object, inputs (array of (atom, object) that are no
    constants), operands (how many inputs there are). reads: edge, site, atom, object, start, end. writes: edge, site,
    function, target, start, end, atom, object (what is written where). formals: atom, function, slot. actuals: edge, site,
    function, slot, atom, object (what a call passes to a function). targets: site, edge, function. returns: function,
    atom, object. effects: effect, site, out_atom, target, atom, object, may (copies into a value or an object). aliases: alias,
    site, atom, root_atom, root_object. outputs: effect, site, target, start, end, atom, object (what a call writes).
    """

    definitions: DataFrame
    reads: DataFrame
    writes: DataFrame
    formals: DataFrame
    actuals: DataFrame
    targets: DataFrame
    returns: DataFrame
    effects: DataFrame
    aliases: DataFrame
    outputs: DataFrame


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def overlapping(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Whether two regions of one object may share a byte; an unknown end or start shares with all."""
    return F.coalesce((a_start < b_end) & (b_start < a_end), F.lit(True))


def _moved(df: DataFrame, kind: str | Column, site: str | Column, atom: str, obj: str, context: str = "keep", may: Column | None = None, used: str | None = None) -> DataFrame:
    """The states that a rule leads to: df has a state's columns and what the rule joined.

    context: 'keep' it, 'leave' all calls, 'back' through the last one, or 'enter' the call edge in column edge.
    """
    contexts = {
        "keep": (F.col("call_depth"), F.col("context")),
        "leave": (F.lit(0), F.array().cast("array<string>")),
        "back": (
            F.when(F.size("context") > 0, F.greatest(F.lit(0), F.col("call_depth") - 1)).otherwise(F.col("call_depth")),
            F.when(F.size("context") > 0, F.slice("context", 1, F.greatest(F.lit(0), F.size("context") - 1))).otherwise(F.col("context")),
        ),
        "enter": (F.col("call_depth") + 1, F.concat("context", F.array("edge"))),
    }
    depth, stack = contexts[context]
    step = F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), F.coalesce(F.col(site) if isinstance(site, str) else site, F.lit("")).alias("site"))
    return df.select(
        *(F.col(f"s.{c}").alias(f"from_{c}") for c in _KEY), "search", "sink",
        F.coalesce(F.col(atom), F.lit("")).alias("atom"), F.coalesce(F.col(obj), F.lit("")).alias("object"), depth.cast("int").alias("call_depth"), stack.alias("context"),
        (F.concat("used", F.array(used)) if used else F.col("used")).alias("used"), (F.col("may") | may if may is not None else F.col("may")).alias("may"),
        F.concat("path", F.array(step)).alias("path"),
    )


def _states(df: DataFrame) -> DataFrame:
    """States with their key as one struct s, under names that no table of facts has."""
    return df.withColumn("s", F.struct(*_KEY)).withColumnsRenamed({"atom": "at", "object": "of"})


def _written(read: DataFrame, facts: Facts, kind: str) -> tuple[DataFrame, DataFrame]:
    """(steps, blockers) of states joined with a region to read (r_site, r_object, r_start, r_end)."""
    w = facts.writes.select("target", "site", "atom", "object", F.col("start").alias("w_start"), F.col("end").alias("w_end"))
    near = read.join(w, F.col("r_object") == F.col("target"))
    meets = overlapping(F.col("r_start"), F.col("r_end"), F.col("w_start"), F.col("w_end"))
    steps = _moved(near.filter(meets & ((F.col("atom") != "") | (F.col("object") != ""))), kind, "site", "atom", "object", "leave")
    told = near.groupBy("s", "r_site").agg(F.bool_or(meets).alias("met"), F.bool_or(meets & (F.col("atom") == "") & (F.col("object") == "")).alias("unbound"))
    blocked = told.select("s", F.explode(F.array_compact(F.array(F.when(~F.col("met"), F.lit("no_overlapping_channel_write_region")), F.when(F.col("unbound"), F.lit("missing_channel_store_operand_binding"))))).alias("blocker"))
    return steps, blocked


def sink_reads(states: DataFrame, facts: Facts) -> tuple[DataFrame, DataFrame]:
    """Memory that is read at the sink's site itself."""
    r = facts.reads.select(F.col("site").alias("r_site"), F.col("atom").alias("r_atom"), F.col("object").alias("r_object"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    same = F.when(F.col("r_atom") != "", F.col("r_atom") == F.col("at")).otherwise((F.col("of") != "") & (F.col("r_object") == F.col("of")))
    return _written(states.join(r, F.col("sink") == F.col("r_site")).filter(same), facts, "SINK_READ")


def channel_reads(states: DataFrame, facts: Facts) -> tuple[DataFrame, DataFrame]:
    """G7a, G7g: reads that name the value, or that lie at the site of the load that defines it and name none."""
    r = facts.reads.select(F.col("site").alias("r_site"), F.col("atom").alias("r_atom"), F.col("object").alias("r_object"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    named = states.join(r.filter("r_atom <> ''"), F.col("at") == F.col("r_atom"))
    loads = facts.definitions.filter("mnemonic = 'LOAD'").select(F.col("atom").alias("d_atom"), F.col("site").alias("d_site"))
    bare = states.join(loads, F.col("at") == F.col("d_atom")).drop("d_atom").join(r.filter("r_atom = ''"), F.col("d_site") == F.col("r_site")).drop("d_site")
    return _written(named.unionByName(bare), facts, "CHANNEL")


def formal_actuals(states: DataFrame, facts: Facts) -> DataFrame:
    """What callers pass for a formal; only the entering caller where the search came through one."""
    f = facts.formals.select(F.col("atom").alias("f_atom"), "function", "slot")
    met = states.join(f, F.col("at") == F.col("f_atom")).join(facts.actuals, ["function", "slot"])
    own = (F.size("context") == 0) | (F.element_at("context", -1) == F.col("edge"))
    return _moved(met.filter(own & ((F.col("atom") != "") | (F.col("object") != ""))), "ACTUAL_FORMAL", "site", "atom", "object", "back")


def copy_effects(states: DataFrame, facts: Facts) -> DataFrame:
    """G7d: what a primitive copied into the value or its object; an effect once a path."""
    e = facts.effects.withColumnRenamed("may", "e_may")
    by_value = states.join(e.filter("out_atom <> ''"), F.col("at") == F.col("out_atom"))
    by_object = states.join(e.filter("target <> ''"), F.col("of") == F.col("target"))
    met = by_value.unionByName(by_object).filter(~F.array_contains("used", F.col("effect")) & ((F.col("atom") != "") | (F.col("object") != "")))
    return _moved(met, "PRIMITIVE_MEMORY_EFFECT", "site", "atom", "object", may=F.col("e_may"), used="effect")


def container_aliases(states: DataFrame, facts: Facts) -> DataFrame:
    """G7e: the root of a container that a value may come from; an alias once a path."""
    a = facts.aliases.withColumnRenamed("atom", "a_atom")
    met = states.join(a, F.col("at") == F.col("a_atom")).filter(~F.array_contains("used", F.col("alias")) & (F.col("alias") != "") & ((F.col("root_atom") != "") | (F.col("root_object") != "")))
    return _moved(met, "BOUNDED_CONTAINER_ALIAS", "site", "root_atom", "root_object", may=F.lit(True), used="alias")


def call_returns(defined: DataFrame, facts: Facts, max_depth: int = MAX_CALL_DEPTH, max_alternatives: int = MAX_ALTERNATIVES) -> tuple[DataFrame, DataFrame]:
    """G7f: the returns of a call's one target, or the blocker. defined: states with their definition (d_ columns)."""
    calls = defined.filter(F.col("d_mnemonic").isin("CALL", "CALLIND"))
    one = facts.targets.groupBy("site").agg(F.count_distinct("function").alias("targets"), F.min("function").alias("target"), F.min("edge").alias("edge"))
    count = facts.returns.filter("atom <> '' OR object <> ''").groupBy(F.col("function").alias("target")).agg(F.count("*").alias("returns"))
    met = calls.join(one, F.col("d_site") == F.col("site"), "left").join(count, "target", "left")
    blocker = (
        F.when(F.col("call_depth") >= max_depth, "function_resolution_depth_exhausted")
        .when(F.coalesce("targets", F.lit(0)) == 0, F.when(F.col("d_mnemonic") == "CALLIND", "unresolved_indirect_call_target").otherwise("unresolved_call_return_summary"))
        .when(F.col("targets") > 1, "ambiguous_call_target")
        .when(F.col("returns").isNull(), "unresolved_call_return_summary")
        .when(F.col("returns") > max_alternatives, "function_summary_alternative_budget_exhausted")
    )
    told = met.withColumn("blocker", blocker)
    into = told.filter("blocker IS NULL").drop("site").join(facts.returns.withColumnRenamed("function", "target"), "target").filter("atom <> '' OR object <> ''")
    return _moved(into, "CALL_RETURN", "d_site", "atom", "object", "enter"), told.filter("blocker IS NOT NULL").select("s", "blocker")


def loads(defined: DataFrame, facts: Facts, read: DataFrame) -> tuple[DataFrame, DataFrame]:
    """G7g: of a load without a known read (read: the keys of states that have one) call outputs and other functions' stores at its address, and the address."""
    bare = defined.filter("d_mnemonic = 'LOAD'").join(read, "s", "left_anti")
    outputs = bare.join(facts.outputs, F.col("d_address_object") == F.col("target")).filter((F.col("atom") != "") | (F.col("object") != ""))
    stores = bare.join(facts.writes, F.col("d_address_object") == F.col("target")).filter((F.col("function") != F.col("d_function")) & ((F.col("atom") != "") | (F.col("object") != "")))
    known = (F.col("d_address_atom") != "") | (F.col("d_address_object") != "")
    steps = [_moved(outputs, "CALL_OUTPUT", "site", "atom", "object", "leave"), _moved(stores, "EXACT_STORE", "site", "atom", "object", "leave"), _moved(bare.filter(known), "LOAD_ADDRESS", "d_site", "d_address_atom", "d_address_object")]
    return _union(steps), bare.filter(~known).select("s", F.lit("unresolved_load_address").alias("blocker"))


def local_inputs(defined: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """G7h, G7i: (steps, leaves, blockers) of operations that are neither calls nor loads."""
    plain = defined.filter(~F.col("d_mnemonic").isin("CALL", "CALLIND", "LOAD"))
    each = plain.withColumn("i", F.explode("d_inputs")).withColumns({"atom": F.col("i.atom"), "object": F.col("i.object")})
    none = plain.filter(F.size("d_inputs") == 0)
    unbound = each.filter("atom = '' AND object = ''").select("s", F.lit("missing_backend_atom_binding").alias("blocker"))
    steps = _moved(each.filter("atom <> '' OR object <> ''"), "LOCAL_DEF_USE", "d_site", "atom", "object")
    return steps, none.filter("d_operands > 0").select("s"), none.filter("d_operands = 0").select("s", F.lit("unmodeled_origin").alias("blocker")).unionByName(unbound)


def object_writers(states: DataFrame, facts: Facts) -> tuple[DataFrame, DataFrame]:
    """The writers of an object that no other rule tells anything of, whatever their region."""
    read = states.filter("of <> ''").withColumns({"r_site": F.lit(""), "r_object": F.col("of"), "r_start": F.lit(None).cast("bigint"), "r_end": F.lit(None).cast("bigint")})
    return _written(read, facts, "OBJECT_WRITE")


@dataclass(frozen=True)
class Level:
    """What one level found: steps (new states with from_ columns), leaves (s) and blockers (s, blocker)."""

    steps: DataFrame
    leaves: DataFrame
    blockers: DataFrame


def expand(states: DataFrame, facts: Facts, max_call_depth: int = MAX_CALL_DEPTH, max_alternatives: int = MAX_ALTERNATIVES) -> Level:
    """One level of all rules. states: search, sink (the sink's site), atom, object, call_depth, context, used, may, path."""
    held = _states(states)
    explicit, b_explicit = sink_reads(held, facts)
    explicit = checkpoint(explicit)
    pointed = explicit.select(F.struct(*(F.col(f"from_{c}").alias(c) for c in _KEY)).alias("s")).distinct()
    rest = checkpoint(held.join(pointed, "s", "left_anti"))
    channel, b_channel = channel_reads(rest, facts)
    loads_read = facts.reads.select("site").distinct()
    d = facts.definitions.select(*(F.col(c).alias(f"d_{c}") for c in ("atom", "function", "site", "mnemonic", "address_atom", "address_object", "inputs", "operands")))
    defined = rest.join(d, F.col("at") == F.col("d_atom")).drop("d_atom")
    returned, b_returned = call_returns(defined, facts, max_call_depth, max_alternatives)
    read = defined.filter("d_mnemonic = 'LOAD'").join(loads_read, F.col("d_site") == F.col("site"), "left_semi").select("s").distinct()
    loaded, b_loaded = loads(defined, facts, read)
    local, leaves, b_local = local_inputs(defined)
    first = checkpoint(_union([explicit, channel, formal_actuals(rest, facts), copy_effects(rest, facts), container_aliases(held, facts), returned, loaded, local]))
    moved = first.select(F.struct(*(F.col(f"from_{c}").alias(c) for c in _KEY)).alias("s")).distinct()
    # what has no definition: constants end a path, objects lead to their writers, the rest is unexplained
    idle = checkpoint(rest.join(defined.select("s").distinct(), "s", "left_anti").join(moved, "s", "left_anti"))
    constant = F.col("at").startswith("const:") | F.col("of").startswith("const:")
    last, b_last = object_writers(idle.filter(~constant), facts)
    last = checkpoint(last)
    reached = last.select(F.struct(*(F.col(f"from_{c}").alias(c) for c in _KEY)).alias("s")).distinct()
    told = checkpoint(_union([b_explicit, b_channel, b_returned, b_loaded, b_local, b_last]).distinct())
    lost = idle.filter(~constant).join(reached, "s", "left_anti").join(told.select("s").distinct(), "s", "left_anti")
    formal = facts.formals.select(F.col("atom").alias("at")).distinct().withColumn("formal", F.lit(True))
    unknown = lost.join(formal, "at", "left").select("s", F.when(F.col("formal"), "unresolved_formal_parameter").otherwise("unmodeled_origin").alias("blocker"))
    return Level(first.unionByName(last), leaves.unionByName(idle.filter(constant).select("s")), told.unionByName(unknown))


@dataclass(frozen=True)
class Found:
    """paths: search, atom, source, may, path. leaves, blockers: per search. complete: whether the levels sufficed."""

    paths: DataFrame
    leaves: DataFrame
    blockers: DataFrame
    complete: bool


def backward(facts: Facts, sources: DataFrame, starts: DataFrame, levels: int = 64, max_call_depth: int = MAX_CALL_DEPTH, max_alternatives: int = MAX_ALTERNATIVES) -> Found:
    """Every path from the starts back to their first source, with what ends the others.

    sources: atom, source. starts: search, sink, atom, object. A path stops at its first source. Per state the least path
    (fewest steps, then by their text) is kept, so results don't depend on order. leaves: search, atom, object of constants
    and operations on constants only; blockers: search, blocker, atom, object. A search that the levels cut off has the
    blocker ANALYSIS_BUDGET_EXHAUSTED for each state it still had to expand. Missing ids are ''; NULLs in starts count as ''.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    frontier = starts.select(
        "search", text("sink"), text("atom"), text("object"), F.lit(0).alias("call_depth"), F.array().cast("array<string>").alias("context"),
        F.array().cast("array<string>").alias("used"), F.lit(False).alias("may"), F.array().cast(f"array<{STEP}>").alias("path"),
    ).filter("atom <> '' OR object <> ''").dropDuplicates(["search", "atom", "object"])
    frontier = checkpoint(frontier)
    seen = frontier.select(*_KEY)
    paths, leaves, blockers = [], [], []
    s = [F.col(f"s.{c}").alias(c) for c in ("search", "atom", "object")]
    complete = False
    for _ in range(levels):
        ended = frontier.join(sources.select("atom", "source").distinct(), "atom")
        paths.append(ended.select("search", "atom", "source", "may", "path"))
        live = frontier.join(sources.select("atom").distinct(), "atom", "left_anti")
        level = expand(live, facts, max_call_depth, max_alternatives)
        leaves.append(level.leaves.select(*s))
        blockers.append(level.blockers.select(s[0], "blocker", *s[1:]))
        rest = [c for c in frontier.columns if c not in _KEY]
        least = level.steps.groupBy(*_KEY).agg(F.min(F.struct(F.size("path").alias("n"), "path", "may", "used", "sink")).alias("m")).select(*_KEY, *(F.col(f"m.{c}").alias(c) for c in rest))
        frontier = checkpoint(least.join(seen, list(_KEY), "left_anti"))
        if frontier.isEmpty():
            complete = True
            break
        seen = seen.unionByName(frontier.select(*_KEY))
    if not complete:
        blockers.append(frontier.select("search", F.lit("ANALYSIS_BUDGET_EXHAUSTED").alias("blocker"), "atom", "object"))
    return Found(_union(paths), _union(leaves).distinct(), _union(blockers).distinct(), complete)
