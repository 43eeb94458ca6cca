"""Pattern operators over value flow: effects, constants, aliases, loop and capacity rules as joins.

All take relations keyed by function (`keys`), so every function of every program is handled in one plan.
Ordered rules name the first test that fails; nothing is dropped without a reason.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.operators.cfg import TRANSPARENT, affine_terms
from factweave.operators.fixpoint import Result, closure, whole
from factweave.operators.rejects import first_reason
from factweave.session import checkpoint

#: Labels of sinks whose capacity can be proved, and roles that are lengths.
CAPACITY_LABELS = ("COPY_SINK", "MEMSET_SINK", "STRING_COPY_SINK")
LENGTH_ROLES = ("len", "length", "size", "count", "amount")


def fixed_effects(inputs: DataFrame, stores: DataFrame, formals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stores at a formal plus a constant: (keys, site, slot, offset, value).

    inputs as in affine_terms; stores: keys, site, address, value; formals: keys, slot, node. An address of
    other or several terms is no fixed effect.
    """
    roots = stores.select(*keys, F.col("address").alias("root")).distinct()
    terms = affine_terms(inputs, roots, keys)
    total = terms.groupBy(*keys, "root").agg(F.count_if(F.col("node").isNotNull() & (F.col("stride") != 0)).alias("n"), F.max_by("node", F.col("node").isNotNull() & (F.col("stride") == 1)).alias("node"), F.max(F.when(F.col("node").isNotNull(), F.col("stride"))).alias("stride"), F.sum("offset").alias("offset"))
    sole = total.filter("n = 1 AND stride = 1").join(formals, [*keys, "node"])
    return stores.join(sole.select(*keys, F.col("root").alias("address"), "slot", "offset"), [*keys, "address"]).select(*keys, "site", "slot", "offset", "value")


def bind_effects(effects: DataFrame, calls: DataFrame, max_alternatives: int = 8) -> tuple[DataFrame, DataFrame]:
    """Effects at the objects that calls pass: (call_site, object, offset, value, effect_site), and blockers.

    effects: function, site, slot, offset, value; calls: call_site, callee, slot, object. A call with more
    alternatives of one object and offset than allowed binds none of them and is a blocker.
    """
    bound = calls.join(effects.withColumnRenamed("function", "callee"), ["callee", "slot"]).select("call_site", "object", "offset", "value", F.col("site").alias("effect_site")).distinct()
    many = bound.groupBy("call_site", "object", "offset").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max_alternatives)
    blockers = many.select("call_site", "object", "offset", F.lit("output_effect_alternative_exhausted").alias("reason"))
    return bound.join(many.drop("n"), ["call_site", "object", "offset"], "left_anti"), blockers


def resolve_constants(inputs: DataFrame, keys: Sequence[str], rounds: int = 1000) -> DataFrame:
    """(keys, value, number) of outputs that fold to one number.

    Copies, sums, differences, products, masks and shifts of known numbers fold; a merge only if all its
    inputs are known and agree. Unknown inputs leave the output out. inputs as in affine_terms. Raises if rounds don't suffice.
    """
    known = checkpoint(inputs.filter("constant IS NOT NULL").select(*keys, F.col("input").alias("value"), F.col("constant").alias("number")).groupBy(*keys, "value").agg(F.min("number").alias("number")))
    live = checkpoint(inputs.select(*keys, "output", "input", "pos", "mnemonic").distinct())
    done = known
    for _ in range(rounds):
        have = live.join(known.withColumnRenamed("value", "input"), [*keys, "input"], "left").groupBy(*keys, "output", "mnemonic").agg(
            F.count(F.lit(1)).alias("n"), F.count("number").alias("k"), F.min("number").alias("low"), F.max("number").alias("high"), F.min_by("number", "pos").alias("a"), F.max_by("number", "pos").alias("b")
        ).filter("n = k")
        m, a, b = F.col("mnemonic"), F.col("a"), F.col("b")
        two = F.col("n") == 2
        number = (
            F.when(m.isin(*TRANSPARENT), a).when(m == "MULTIEQUAL", F.when(F.col("low") == F.col("high"), a)).when(two & m.isin("INT_ADD", "PTRSUB"), a + b).when(two & (m == "INT_SUB"), a - b)
            .when(two & (m == "INT_MULT"), F.try_multiply(a, b)).when(two & (m == "INT_AND"), a.bitwiseAND(b)).when(two & (m == "INT_OR"), a.bitwiseOR(b))
            .when(two & (m == "INT_LEFT") & b.between(0, 62), F.call_function("shiftleft", a, b.cast("int")))
        )
        new = have.select(*keys, F.col("output").alias("value"), number.alias("number")).filter("number IS NOT NULL").join(known.select(*keys, "value"), [*keys, "value"], "left_anti")
        new = checkpoint(new.groupBy(*keys, "value").agg(F.min("number").alias("number"), F.max("number").alias("__h")).filter("number = __h").drop("__h"))
        if new.isEmpty():
            break
        known = checkpoint(known.unionByName(new))
    else:
        raise RuntimeError(f"ANALYSIS_BUDGET_EXHAUSTED after {rounds} rounds")
    return known.join(done.select(*keys, "value"), [*keys, "value"], "left_anti")


def propagate_regions(seeds: DataFrame, copies: DataFrame, rounds: int = 32) -> Result:
    """(lineage, object, start, end) carried by copies of byte ranges.

    seeds: lineage, object, start, end; copies: src, src_start, src_end, dst, dst_start. The part of a region
    that a copy reads arrives at the shifted place; regions are half-open.
    """
    c = copies.select(F.col("src").alias("object"), "src_start", "src_end", "dst", "dst_start")

    def step(delta: DataFrame) -> DataFrame:
        met = delta.join(c, "object").filter(F.greatest("start", "src_start") < F.least("end", "src_end"))
        low, high = F.greatest("start", "src_start"), F.least("end", "src_end")
        return met.select("lineage", F.col("dst").alias("object"), (low - F.col("src_start") + F.col("dst_start")).alias("start"), (high - F.col("src_start") + F.col("dst_start")).alias("end"))

    return closure(seeds.select("lineage", "object", "start", "end"), step, rounds)


def container_aliases(inputs: DataFrame, formals: DataFrame, keys: Sequence[str], most: int = 16) -> DataFrame:
    """Merges that walk a list from one formal: (keys, phi, slot, place, kept).

    One input of the merge is loaded from exactly one formal, another is loaded from an address that depends on the merge
    itself. place numbers a function's aliases by their merge; kept is false past `most`, so nothing is hidden.
    """
    flow = inputs.filter("constant IS NULL").select(*keys, F.col("input").alias("node"), F.col("output").alias("next"), (F.col("mnemonic") == "LOAD").alias("load"), (F.col("mnemonic") == "MULTIEQUAL").alias("merge")).distinct()
    flow = checkpoint(flow)
    phis = inputs.filter("mnemonic = 'MULTIEQUAL'").select(*keys, F.col("output").alias("phi"), "input").distinct()

    def spread(seeds: DataFrame) -> DataFrame:
        edge = flow.filter("NOT merge").drop("merge")
        step = lambda d: d.join(edge, [*keys, "node"]).select(*keys, "root", F.col("next").alias("node"), (F.col("loaded") | F.col("load")).alias("loaded"))
        return whole(closure(seeds, step, 10_000))

    first = spread(formals.select(*keys, F.col("slot").cast("string").alias("root"), "node", F.lit(False).alias("loaded")))
    again = spread(phis.select(*keys, F.col("phi").alias("root"), F.col("phi").alias("node"), F.lit(False).alias("loaded")).distinct())
    initial = phis.join(first.filter("loaded").select(*keys, F.col("node").alias("input"), F.col("root").alias("slot")), [*keys, "input"]).groupBy(*keys, "phi").agg(F.min("slot").alias("slot"), F.count_distinct("slot").alias("n")).filter("n = 1")
    back = again.filter("loaded").select(*keys, F.col("root").alias("phi"), F.col("node").alias("input")).join(phis, [*keys, "phi", "input"], "left_semi").select(*keys, "phi").distinct()
    w = Window.partitionBy(*keys).orderBy("phi")
    out = initial.join(back, [*keys, "phi"]).select(*keys, "phi", F.col("slot").cast("int").alias("slot"), F.row_number().over(w).alias("place"))
    return out.withColumn("kept", F.col("place") <= most)


def counted_ranges(stores: DataFrame, loops: DataFrame, recurrences: DataFrame, bounds: DataFrame, progressions: DataFrame, loads: DataFrame, invariants: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each store in a loop as COPY, FILL or the first test it fails: (keys, site, header, kind, reason).

    stores: keys, site, block, address, value; loops: keys, header, block; recurrences: keys, header, phi,
    step; bounds: keys, header; progressions: keys, header, node, stride (addresses of fixed stride);
    loads: keys, value, load_address, external; invariants: keys, header, value. All but stores are distinct
    facts, and each is joined on (keys, header), so there is no pair that isn't of one loop.
    """
    at = stores.join(loops.select(*keys, "header", "block").distinct(), [*keys, "block"])
    has = lambda df, name: df.select(*keys, "header").distinct().withColumn(name, F.lit(True))
    stride = progressions.groupBy(*keys, "header", "node").agg(F.min("stride").alias("stride"))
    row = (
        at.join(has(recurrences, "moving"), [*keys, "header"], "left").join(has(bounds, "bounded"), [*keys, "header"], "left")
        .join(stride.withColumnsRenamed({"node": "address", "stride": "to"}), [*keys, "header", "address"], "left")
        .join(loads.groupBy(*keys, "value").agg(F.min("load_address").alias("load_address"), F.bool_or("external").alias("external")), [*keys, "value"], "left")
        .join(stride.withColumnsRenamed({"node": "load_address", "stride": "from"}), [*keys, "header", "load_address"], "left")
        .join(invariants.select(*keys, "header", "value").distinct().withColumn("same", F.lit(True)), [*keys, "header", "value"], "left")
    )
    copy = F.col("external").isNotNull()
    rules = [
        ("counted_range_no_fixed_stride_recurrence", F.col("moving").isNull()), ("counted_range_no_recurrence_bound_exit", F.col("bounded").isNull()),
        ("malformed_store_operands", F.col("address").isNull() | F.col("value").isNull()), ("counted_range_destination_not_fixed_stride", F.col("to").isNull()),
        ("excluded_external_input_source", copy & F.col("external")), ("counted_range_copy_source_not_fixed_stride", copy & F.col("from").isNull()),
        ("counted_range_source_destination_stride_mismatch", copy & (F.col("from") != F.col("to"))), ("counted_range_fill_value_not_invariant", ~copy & F.col("same").isNull()),
    ]
    judged = first_reason(row, rules)
    return judged.select(*keys, "site", "header", F.when(F.col("reason").isNull(), F.when(copy, "COPY").otherwise("FILL")).alias("kind"), "reason")


def sentinel_copies(stores: DataFrame, loops: DataFrame, progressions: DataFrame, loads: DataFrame, exit_tests: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stores of an unchanged load with equal fixed strides in a loop that ends on the loaded value; (keys, site, header, reason)."""
    at = stores.join(loops.select(*keys, "header", "block").distinct(), [*keys, "block"])
    stride = progressions.groupBy(*keys, "header", "node").agg(F.min("stride").alias("stride"))
    row = (
        at.join(loads.groupBy(*keys, "value").agg(F.min("load_address").alias("load_address")), [*keys, "value"], "left")
        .join(stride.withColumnsRenamed({"node": "address", "stride": "to"}), [*keys, "header", "address"], "left")
        .join(stride.withColumnsRenamed({"node": "load_address", "stride": "from"}), [*keys, "header", "load_address"], "left")
        .join(exit_tests.select(*keys, "header", "value").distinct().withColumn("tested", F.lit(True)), [*keys, "header", "value"], "left")
    )
    rules = [
        ("sentinel_value_not_an_unchanged_load", F.col("load_address").isNull()), ("sentinel_destination_not_fixed_stride", F.col("to").isNull()), ("sentinel_source_not_fixed_stride", F.col("from").isNull()),
        ("sentinel_stride_mismatch", F.col("to") != F.col("from")), ("sentinel_exit_does_not_test_the_value", F.col("tested").isNull()),
    ]
    return first_reason(row, rules).select(*keys, "site", "header", "reason")


def capacity_proofs(sinks: DataFrame, checks: DataFrame, destinations: DataFrame) -> DataFrame:
    """Per sink whether a dominating check bounds its length within its destination: (sink, status, reason, remaining, maximum).

    sinks: sink, label, lengths (number of lengths that aren't constant), and, where they are known, index (of the length), bound (whether it is
    the sink's argument) and placed (whether the destination is); checks: sink, mnemonic, relation, bound, equivalent and, where it is
    known, ordinal; destinations: sink, extent, offset. The first test that fails is the reason. The first check on the same value
    is judged, by ordinal, then by least bound: only an unsigned upper bound by a constant proves anything, whatever later checks say.
    """
    order = F.struct(*([F.col("ordinal")] if "ordinal" in checks.columns else []), "bound", "relation", "mnemonic")
    first = F.min_by(F.struct("mnemonic", "relation", "bound"), F.when(F.col("equivalent"), order))
    judged = checks.groupBy("sink").agg(F.count(F.lit(1)).alias("n"), F.bool_or("equivalent").alias("same"), first.alias("c"))
    unsigned = F.col("c.mnemonic") == "INT_LESS"
    maximum = F.when(F.col("c.relation") == "LT", F.col("c.bound") - 1).when(F.col("c.relation") == "LE", F.col("c.bound"))
    c = judged.select("sink", "n", "same", unsigned.alias("unsigned"), F.col("c.bound").isNotNull().alias("fixed"), maximum.alias("maximum"))
    has = {n: n in sinks.columns for n in ("index", "bound", "placed")}
    sinks = sinks.select("sink", "label", "lengths", *((F.col(n) if has[n] else F.lit(None).cast("boolean")).alias(n) for n in has))
    row = sinks.join(c, "sink", "left").join(destinations.groupBy("sink").agg(F.min("extent").alias("extent"), F.min("offset").alias("offset")), "sink", "left").withColumn("remaining", F.col("extent") - F.col("offset"))
    no = lambda name: ~F.coalesce(F.col(name), F.lit(False))
    rules = [
        ("sink_label_not_supported_by_capacity_proof", ~F.col("label").isin(*CAPACITY_LABELS)), ("non_unique_nonconstant_length_parameter", F.col("lengths") != 1),
        ("length_parameter_index_missing", F.lit(has["index"]) & F.col("index").isNull()), ("length_parameter_not_bound_to_sink_argument", F.lit(has["bound"]) & no("bound")),
        ("no_parameter_bounded_check", F.col("n").isNull()), ("checked_value_not_equivalent_to_sink_length", no("same")), ("signed_comparison_not_capacity_proof", no("unsigned")),
        ("capacity_bound_not_constant", no("fixed")), ("unsupported_capacity_bound_relation", F.col("maximum").isNull()), ("destination_argument_not_bound", F.lit(has["placed"]) & no("placed")), ("static_destination_object_unresolved", F.col("extent").isNull()),
        ("destination_extent_or_offset_invalid", (F.col("extent") <= 0) | (F.col("offset") < 0) | (F.col("offset") > F.col("extent"))),
        ("check_bound_exceeds_remaining_destination_capacity", (F.col("maximum") < 0) | (F.col("maximum") > F.col("remaining"))),
    ]
    judged = first_reason(row, rules)
    return judged.select("sink", F.when(F.col("reason").isNull(), "CAPACITY_SAFE").otherwise("NOT_PROVED").alias("status"), "reason", "remaining", "maximum")


def parser_reads(df: DataFrame, dynamic_source: Column, controlled_loop: Column, shared_lengths: Column) -> DataFrame:
    """The path by which a read is admitted, or why none holds.

    dynamic_source: a term or the width has a source lineage; controlled_loop: a source controls the loop;
    shared_lengths: how many lengths share a source definition with the base buffer, of which there must be one.
    """
    path = F.when(dynamic_source, "DYNAMIC_TERM").when(controlled_loop, "SOURCE_CONTROLLED_LOOP").when(shared_lengths == 1, "SHARED_SOURCE_LENGTH")
    reason = F.when(path.isNull(), F.when(F.coalesce(shared_lengths, F.lit(0)) > 1, "available_length_ambiguous").when(shared_lengths == 0, "available_length_missing").otherwise("no_source_relation"))
    return df.withColumn("path", path).withColumn("reason", reason)


def variable_stores(df: DataFrame) -> DataFrame:
    """Stores to a variable address with the first test that fails, NULL for candidates.

    df: complete, writable (booleans), offset_kind ('formal', 'source' or another), trackable.
    """
    no = lambda name: ~F.coalesce(F.col(name), F.lit(False))
    kinds = ~F.coalesce(F.col("offset_kind").isin("formal", "source"), F.lit(False))
    return first_reason(df, [("address_not_complete", no("complete")), ("base_not_proved_writable", no("writable")), ("offset_neither_formal_nor_source", kinds), ("no_trackable_parameter", no("trackable"))])


def container_summaries(stores: DataFrame, returns: DataFrame) -> DataFrame:
    """INSERT and REMOVE summaries: (function, kind, container_slot, value_slot, offset).

    stores: function, value_slot (formal the value comes from), address_slot, offset; returns: function,
    values (number of values returned that are no constant), address_slot, offset (of the load it comes from).
    """
    i = stores.filter("value_slot IS NOT NULL AND address_slot IS NOT NULL AND value_slot <> address_slot").select("function", F.lit("INSERT").alias("kind"), F.col("address_slot").alias("container_slot"), "value_slot", "offset")
    r = returns.filter("values = 1 AND address_slot IS NOT NULL").select("function", F.lit("REMOVE").alias("kind"), F.col("address_slot").alias("container_slot"), F.lit(None).cast("int").alias("value_slot"), "offset")
    return i.unionByName(r).distinct()


def event_queues(writes: DataFrame, reads: DataFrame, pointer_sizes: Sequence[int] = (4, 8)) -> DataFrame:
    """Objects into which a writer stores at least two pointer-size formals and from which a reader dispatches two of them.

    writes: function, object, offset, size; reads: function, object, offset, dispatched. Returns object,
    writer, reader, offsets (two or more that both know, sorted).
    """
    w = writes.filter(F.col("size").isin(*pointer_sizes)).groupBy("object", F.col("function").alias("writer")).agg(F.collect_set("offset").alias("stored")).filter(F.size("stored") >= 2)
    r = reads.filter("dispatched").groupBy("object", F.col("function").alias("reader")).agg(F.collect_set("offset").alias("read")).filter(F.size("read") >= 2)
    both = w.join(r, "object").filter("writer <> reader").withColumn("offsets", F.array_sort(F.array_intersect("stored", "read")))
    return both.filter(F.size("offsets") >= 2).select("object", "writer", "reader", "offsets")


def callback_registrations(stored: DataFrame, forwards: DataFrame, max_depth: int = 5, most: int = 32) -> tuple[DataFrame, DataFrame]:
    """(registrations, rejects): function targets that reach a stored slot directly or through formals.

    stored: function, slot (formal that a function stores as a callback); forwards: caller, callee, slot,
    caller_slot (a formal passed on) and target (a function passed), one of them NULL. Functions with more
    targets than `most` are rejects as a whole.
    """
    f = forwards.select(F.col("callee").alias("function"), "slot", "caller", "caller_slot", "target")
    up = f.filter("caller_slot IS NOT NULL")
    reach = closure(stored.select("function", "slot"), lambda d: d.join(up, ["function", "slot"]).select(F.col("caller").alias("function"), F.col("caller_slot").alias("slot")), max_depth).rows
    found = reach.join(f.filter("target IS NOT NULL"), ["function", "slot"]).select("caller", "function", "slot", "target").distinct()
    many = found.groupBy("function", "slot").agg(F.count_distinct("target").alias("n")).filter(F.col("n") > most)
    return found.join(many, ["function", "slot"], "left_anti"), many.select("function", "slot", F.lit("callback_target_budget_exhausted").alias("reason"))


def source_candidates(df: DataFrame) -> DataFrame:
    """The rule by which a source candidate is admitted, NULL with a reason otherwise.

    df: binding_status, object_id, value_id, argument_facts, argument_text, length_from_return, receive_like.
    """
    bound = (F.col("binding_status") == "BOUND") & (F.coalesce(F.col("object_id"), F.lit("")) != F.lit("")) | (F.coalesce(F.col("value_id"), F.lit("")) != "") & (F.col("binding_status") == "BOUND")
    yes = lambda name: F.coalesce(F.col(name), F.lit(False))
    rule = F.when(yes("argument_facts"), "ARGUMENT_WRITTEN_BY_FACTS").when(yes("argument_text"), "ARGUMENT_WRITTEN_BY_BODY").when(yes("length_from_return"), "RETURN_DRIVES_LENGTH").when(yes("receive_like"), "RECEIVE_LIKE")
    ok = F.coalesce(bound, F.lit(False))
    return df.withColumn("rule", F.when(ok, rule)).withColumn("reason", F.when(~ok, "binding_incomplete").when(rule.isNull(), "no_rule_holds"))


def route_registers(df: DataFrame, role: Column, table_reason: Column) -> DataFrame:
    """SOURCE for roles of external input, RAW with a reason for status, control and transmit registers and unresolved tables."""
    raw = role.isin("STATUS", "CONTROL", "TX_DATA")
    return df.withColumn("route", F.when(table_reason.isNotNull() | raw | role.isNull(), "RAW").otherwise("SOURCE")).withColumn(
        "reason", F.when(table_reason.isNotNull(), table_reason).when(role.isNull(), "register_role_unresolved").when(raw, F.concat(F.lit("register_role_"), F.lower(role)))
    )


def rank_metadata(scores: Column, hints: Column, priority: Sequence[str]) -> tuple[Column, Column]:
    """D3: (best score within 0..1 to four places, 0 for none; the first hint in the priority, the last of them by default)."""
    best = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.array_max(scores), F.lit(0.0)))), 4)
    return best, F.coalesce(*(F.when(F.array_contains(hints, p), F.lit(p)) for p in priority), F.lit(priority[-1]))


def best_chains(expected: DataFrame, chains: DataFrame, sink: str) -> DataFrame:
    """Each expected sink with its best chain, or SINK_MISS (no such sink) or CHAIN_MISS (no chain).

    expected: sink, matched; chains: sink, chain, source_matched, status. The best has a matched source,
    then reaches one, then is incomplete rather than internal; ties go to the least chain id.
    """
    s = F.col("status")
    key = F.struct((~F.col("source_matched")).alias("a"), (~F.startswith(s, F.lit("SOURCE_REACHED"))).alias("b"), (s != "GRAPH_INCOMPLETE").alias("c"), (s == "PROVEN_INTERNAL_ONLY").alias("d"), F.col("chain"))
    best = chains.groupBy(sink).agg(F.min_by(F.struct("chain", "status", "source_matched"), key).alias("b")).select(sink, "b.*")
    out = expected.join(best, sink, "left")
    return out.withColumn("result", F.when(~F.col("matched"), "SINK_MISS").when(F.col("chain").isNull(), "CHAIN_MISS").otherwise(s))


def in_place_swaps(transfers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pairs of loop transfers that exchange two places of one buffer: (keys, header, base, site_a, site_b).

    transfers: keys, header, site, base, dst, src (location keys of fixed stride). One writes where the other
    reads and the reverse, so the pair is found by an equi-join; unknown places and bases match nothing.
    """
    a = transfers.filter("dst <> src").select(*keys, "header", "base", "dst", "src", F.col("site").alias("site_a"))
    b = transfers.select(*keys, "header", "base", F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("site").alias("site_b"))
    return a.join(b, [*keys, "header", "base", "dst", "src"]).filter("site_a < site_b").select(*keys, "header", "base", "site_a", "site_b").distinct()


def buffer_reservations(updates: DataFrame, returns: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Field updates that reserve room at the old end of a buffer: (keys, site, base, field, return_site, pointer_field, reason).

    updates: keys, site, base, field, old_value, direction ('add' or another); returns: keys, return_site,
    base, pointer_field, value (a value the returned address depends on). The address returned must depend on
    the field's old value and on another field of the same base. The least such return counts.
    """
    r = returns.select(*keys, "base", F.col("value").alias("old_value"), "return_site", "pointer_field")
    met = updates.join(r, [*keys, "base", "old_value"], "left")
    fit = F.when(F.col("pointer_field").isNotNull() & (F.col("pointer_field") != F.col("field")), F.struct("return_site", "pointer_field"))
    g = met.groupBy(*keys, "site", "base", "field", "old_value", "direction").agg(F.min(fit).alias("r"), F.count("return_site").alias("n"))
    reason = (
        F.when(F.coalesce(F.col("direction") != "add", F.lit(True)), "reservation_update_does_not_add").when(F.col("old_value").isNull(), "reservation_old_value_unknown")
        .when(F.col("n") == 0, "reservation_return_does_not_depend_on_old_value").when(F.col("r").isNull(), "reservation_pointer_is_the_updated_field")
    )
    return g.select(*keys, "site", "base", "field", "r.return_site", "r.pointer_field", reason.alias("reason"))


def stateful_loop_writes(stores: DataFrame, loops: DataFrame, loads: DataFrame, states: DataFrame, slots: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Loop stores of an unchanged load whose destination moves through state in memory: (keys, site, header, source_slot, destination_slot, state, reason).

    stores: keys, site, block, address, value; loops: keys, header, block; loads: keys, value, load_site, load_address, external; states: keys, header,
    address, state, update_site (the state's value and where it is updated); slots: keys, node, slot (formals in a node's lineage). A store without
    such a load or state is no candidate; an external load is a reject, and so is a source that isn't of exactly one formal. The
    destination has a slot only if it is of one formal. Of several states the one updated first, by site, counts.
    """
    held = slots.groupBy(*keys, "node").agg(F.count_distinct("slot").alias("n"), F.min("slot").alias("slot"))
    first = states.groupBy(*keys, "header", "address").agg(F.min_by("state", F.struct("update_site", "state")).alias("state"))
    one = loads.groupBy(*keys, "value").agg(F.min_by(F.struct("load_address", "external"), F.col("load_site")).alias("l")).select(*keys, "value", "l.*")
    at = stores.join(loops.select(*keys, "header", "block").distinct(), [*keys, "block"]).join(one, [*keys, "value"]).join(first, [*keys, "header", "address"], "left")
    row = at.join(held.select(*keys, F.col("node").alias("load_address"), F.col("n").alias("s_n"), F.col("slot").alias("s_slot")), [*keys, "load_address"], "left").join(
        held.select(*keys, F.col("node").alias("address"), F.col("n").alias("d_n"), F.col("slot").alias("d_slot")), [*keys, "address"], "left"
    )
    external = F.coalesce(F.col("external"), F.lit(False))
    reason = F.when(external, "excluded_external_input_mmio_to_buffer_source").when(F.coalesce("s_n", F.lit(0)) != 1, "stateful_loop_source_not_uniquely_formal_bound")
    told = row.withColumn("reason", reason).filter(external | F.col("state").isNotNull())
    fine = F.col("reason").isNull()
    return told.select(*keys, "site", "header", F.when(fine, F.col("s_slot")).alias("source_slot"), F.when(fine & (F.col("d_n") == 1), F.col("d_slot")).alias("destination_slot"), F.when(fine, F.col("state")).alias("state"), "reason")


def resolve_objects(terms: DataFrame, bases: DataFrame, merges: DataFrame, keys: Sequence[str], rounds: int = 100) -> DataFrame:
    """(keys, root, object, offset, dynamic, reason) of each address: the object and offset it surely has, or why none.

    terms as affine_terms gives them, for the addresses and for the inputs of merges; bases: keys, node, object, at (values known to
    point to a place of an object); merges: keys, output, input. An address with one base, once, keeps its object; other terms make
    its offset unknown (dynamic), and nothing is guessed. A sum of numbers only is an absolute address, an object of its own. A merge points
    to a place if all its inputs point to that same place. Raises if rounds don't suffice.
    """
    known = checkpoint(bases.groupBy(*keys, "node").agg(F.min("object").alias("object"), F.min("at").alias("at"), F.count_distinct("object", "at").alias("__n")).filter("__n = 1").drop("__n"))
    live = F.col("node").isNotNull() & (F.col("stride") != 0)

    def resolved(known: DataFrame) -> DataFrame:
        m = terms.join(known, [*keys, "node"], "left")
        base = live & F.col("object").isNotNull()
        g = m.groupBy(*keys, "root").agg(
            F.count_if(base).alias("n"), F.count_if(live & F.col("object").isNull()).alias("others"), F.max(F.when(base, F.struct("object", "at", "stride"))).alias("b"), F.sum("offset").alias("offset")
        )
        why = F.when((F.col("n") == 0) & (F.col("others") > 0), "address_has_no_known_base").when(F.col("n") > 1, "address_has_several_bases").when((F.col("n") == 1) & (F.col("b.stride") != 1), "address_scales_its_base")
        told = g.withColumn("reason", why).withColumn("fine", F.col("reason").isNull())
        object_ = F.when(F.col("n") == 1, F.col("b.object")).otherwise(F.concat(F.lit("obj:ram:"), F.lpad(F.lower(F.hex("offset")), 8, "0")))
        offset = F.when(F.col("n") == 0, 0).when(F.col("others") == 0, F.col("b.at") + F.col("offset")).cast("bigint")
        return told.select(*keys, "root", F.when(F.col("fine"), object_).alias("object"), F.when(F.col("fine"), offset).alias("offset"), (F.col("fine") & (F.col("others") > 0)).alias("dynamic"), "reason")

    wanted = merges.select(*keys, "output", "input").distinct()
    for _ in range(rounds):
        at = resolved(known).filter("object IS NOT NULL AND NOT dynamic").select(*keys, F.col("root").alias("input"), "object", "offset")
        direct = known.select(*keys, F.col("node").alias("input"), "object", F.col("at").alias("offset"))
        place = wanted.join(at.unionByName(direct).distinct(), [*keys, "input"], "left").groupBy(*keys, "output").agg(
            F.count_if(F.col("object").isNull()).alias("lost"), F.count_distinct("object", "offset").alias("places"), F.min("object").alias("object"), F.min("offset").alias("at")
        )
        new = place.filter("lost = 0 AND places = 1").select(*keys, F.col("output").alias("node"), "object", "at").join(known.select(*keys, "node"), [*keys, "node"], "left_anti")
        new = checkpoint(new)
        if new.isEmpty():
            return resolved(known)
        known = checkpoint(known.unionByName(new))
    raise RuntimeError(f"ANALYSIS_BUDGET_EXHAUSTED after {rounds} rounds")
