"""Recursive operators on the unified graph and on value flow."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.operators.agg import keep_first
from factweave.operators.fixpoint import Result, alternate, closure, relaxation, whole
from factweave.session import checkpoint

#: Budgets of the searches.
MAX_HOPS, MAX_CHANNEL_DEPTH, MAX_TARGETS, MAX_WRAPPER_DEPTH = 8, 8, 32, 5


def min_hops(edges: DataFrame, starts: DataFrame, max_hops: int = MAX_HOPS, rounds: int = 1000) -> Result:
    """G1: per (search, node) the least number of channel hops from the start, walking edges backwards.

    edges: src, dst, cost (0 or 1); starts: search, node. All searches run at once. A node within the hop
    budget has the same allowed set as the literal breadth-first search (a shortest path repeats no edge),
    so no path is carried.
    """
    seeds = starts.select("search", "node", F.lit(0).alias("hops"))

    def step(delta: DataFrame) -> DataFrame:
        walked = delta.join(edges, delta["node"] == edges["dst"])
        return walked.select("search", F.col("src").alias("node"), (F.col("hops") + F.col("cost")).cast("int").alias("hops")).filter(F.col("hops") <= max_hops)

    return relaxation(seeds, step, ["search", "node"], ["hops"], rounds)


def allowed_edges(edges: DataFrame, reached: DataFrame, calls: Column) -> DataFrame:
    """G1: per search the edges into reached nodes, and the call edges out of them, which are recorded but not walked."""
    into = reached.select("search", F.col("node").alias("dst")).join(edges, "dst")
    out = reached.select("search", F.col("node").alias("src")).join(edges.filter(calls), "src")
    return into.select("search", *edges.columns).unionByName(out.select("search", *edges.columns)).distinct()


def reachable(edges: DataFrame, starts: DataFrame, rounds: int = 1000) -> Result:
    """(start, node) reachable along edges (src, dst); a start reaches itself."""
    seeds = starts.select("start", F.col("start").alias("node"))

    def step(delta: DataFrame) -> DataFrame:
        return delta.join(edges.select(F.col("src").alias("node"), F.col("dst").alias("next")), "node").select("start", F.col("next").alias("node"))

    return closure(seeds, step, rounds)


def propagate_labels(edges: DataFrame, roots: DataFrame, rounds: int = 1000) -> Result:
    """(label, node) where labels of roots (label, node) flow along edges (src, dst)."""

    def step(delta: DataFrame) -> DataFrame:
        return delta.join(edges.select(F.col("src").alias("node"), F.col("dst").alias("next")), "node").select("label", F.col("next").alias("node"))

    return closure(roots.select("label", "node"), step, rounds)


def value_provenance(inputs: DataFrame, seeds: DataFrame, rounds: int = 32) -> Result:
    """(value, label) carried forward through operations.

    inputs: output, input, mode ('any': a label of any input; 'all': only a label that every non-constant
    input carries), constant. seeds: value, label. Monotone, so the order of rounds doesn't matter. Only
    operations with an input that has just gained a label are looked at again.
    """
    live = checkpoint(inputs.filter(~F.coalesce(F.col("constant"), F.lit(False))).select("output", "input", "mode").distinct())
    needed = live.filter("mode = 'all'").groupBy("output").agg(F.count(F.lit(1)).alias("needed"))
    seen = checkpoint(seeds.select("value", "label").distinct())
    delta = seen
    for n in range(rounds):
        touched = delta.join(live, delta["value"] == live["input"])
        free = touched.filter("mode = 'any'").select(F.col("output").alias("value"), "label")
        again = touched.filter("mode = 'all'").select("output", "label").distinct()
        counted = again.join(live.filter("mode = 'all'"), "output").join(seen.select(F.col("value").alias("input"), "label"), ["input", "label"])
        every = counted.groupBy("output", "label").agg(F.count(F.lit(1)).alias("have")).join(needed, "output").filter("have = needed")
        grown = free.unionByName(every.select(F.col("output").alias("value"), "label")).distinct().join(seen, ["value", "label"], "left_anti")
        delta = checkpoint(grown)
        if delta.isEmpty():
            return Result(seen, True, n)
        seen = checkpoint(seen.unionByName(delta))
    return Result(seen, False, rounds)


def associate(seeds: DataFrame, transfers: DataFrame, max_depth: int = MAX_CHANNEL_DEPTH, rounds: int = 200) -> tuple[DataFrame, DataFrame, bool]:
    """Dominant associations, rejects past the depth limit, and whether the fixed point was reached.

    seeds: lineage, state, node, depth, may (0 exact, 1 may); transfers: src_state, src, dst_state, dst,
    hop (channel hops of the transfer), may. Per (lineage, state, node) the least depth is kept, then exact
    over may. A transfer that would pass max_depth is a reject, not silently dropped.
    """
    t = transfers.select(F.col("src_state").alias("state"), F.col("src").alias("node"), "dst_state", "dst", "hop", F.col("may").alias("t_may"))
    keys = ["lineage", "state", "node"]

    def move(delta: DataFrame) -> DataFrame:
        return delta.join(t, ["state", "node"]).select(
            "lineage", F.col("dst_state").alias("state"), F.col("dst").alias("node"),
            (F.col("depth") + F.col("hop")).cast("int").alias("depth"), F.greatest("may", "t_may").cast("int").alias("may"),
        )

    start = seeds.select(*keys, F.col("depth").cast("int").alias("depth"), F.col("may").cast("int").alias("may"))
    done = relaxation(start.filter(F.col("depth") <= max_depth), lambda d: move(d).filter(F.col("depth") <= max_depth), keys, ["depth", "may"], rounds)
    over = move(done.rows).unionByName(start).filter(F.col("depth") > max_depth)
    rejects = over.select(*keys, "depth", F.lit("source_association_channel_depth_limit_reached").alias("reason")).distinct()
    return done.rows, rejects, done.complete


def alternating_channels(seeds: DataFrame, local: DataFrame, channels: DataFrame, rounds: int = 9) -> Result:
    """(lineage, node) by whole local closures (edges src, dst) alternated with single channel steps (writer, reader)."""

    def outer(state: DataFrame) -> DataFrame:
        moved = state.join(channels, state["node"] == channels["writer"]).select("lineage", F.col("reader").alias("node"))
        edge = local.select(F.col("src").alias("node"), F.col("dst").alias("next"))
        inner = closure(state.unionByName(moved), lambda d: d.join(edge, "node").select("lineage", F.col("next").alias("node")), 1000)
        return whole(inner)

    return alternate(seeds.select("lineage", "node"), outer, rounds)


def backward_search(definitions: DataFrame, sources: DataFrame, starts: DataFrame, max_steps: int = 32, max_path: int = 64) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(paths, leaves, blockers) of a backward reaching-definition search of every start at once.

    definitions: value, input (NULL for a definition without inputs), rule, site, constant. sources: value,
    source. starts: search, value. A path stops at its first source; constants and 'const:' values are
    internal leaves; a value without a definition is a blocker, and so is a value where the steps or the
    path length end. A state (search, value) is expanded once, by its least path (fewest steps, then
    sites), so the work is bounded by states and not by paths. paths: search, value, source, steps (sites).
    """
    empty = F.array().cast("array<string>")
    delta = starts.select("search", "value", empty.alias("steps")).distinct()
    seen = checkpoint(delta)
    delta = seen
    known = definitions.select("value", "input", "rule", "site", F.coalesce("constant", F.lit(False)).alias("constant"))
    src = sources.select("value", "source")
    paths, leaves, blockers = [], [], []
    for _ in range(max_steps):
        paths.append(delta.join(src, "value").select("search", "value", "source", "steps"))
        rest = delta.join(src.select("value"), "value", "left_anti")
        leaf = F.col("value").startswith("const:")
        leaves.append(rest.filter(leaf).select("search", "value"))
        open_ = rest.filter(~leaf)
        step = open_.join(known, "value", "left")
        blockers.append(step.filter("rule IS NULL").select("search", "value", F.lit("unmodeled_origin").alias("reason")))
        inner = step.filter(F.col("rule").isNotNull() & (F.col("constant") | F.col("input").isNull()))
        leaves.append(inner.select("search", F.coalesce("input", "value").alias("value")))
        moved = step.filter(F.col("rule").isNotNull() & ~F.col("constant") & F.col("input").isNotNull())
        full = F.size("steps") >= max_path
        blockers.append(moved.filter(full).select("search", "value", F.lit("path_budget_exhausted").alias("reason")))
        grown = moved.filter(~full).select("search", F.col("input").alias("value"), F.concat("steps", F.array(F.concat_ws(":", "rule", "site"))).alias("steps"))
        first = grown.groupBy("search", "value").agg(F.min(F.struct(F.size("steps").alias("n"), F.col("steps"))).alias("b")).select("search", "value", F.col("b.steps").alias("steps"))
        delta = checkpoint(first.join(seen.select("search", "value"), ["search", "value"], "left_anti"))
        if delta.isEmpty():
            break
        seen = seen.unionByName(delta)
    else:
        blockers.append(delta.select("search", "value", F.lit("search_budget_exhausted").alias("reason")))
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    return union(paths), union(leaves).distinct(), union(blockers).distinct()


#: The order of a parameter's and a chain's states, the strongest first.
STATUS_ORDER = ["SOURCE_REACHED_DETERMINISTIC", "SOURCE_REACHED_HEURISTIC", "ANALYSIS_BUDGET_EXHAUSTED", "GRAPH_INCOMPLETE", "PROVEN_INTERNAL_ONLY"]


def parameter_status(deterministic: Column, heuristic: Column, budget: Column, blocked: Column, leaves: Column) -> Column:
    """The state of a parameter by what its search found: a path is existential, the rest is said after it."""
    return (
        F.when(deterministic, "SOURCE_REACHED_DETERMINISTIC").when(heuristic, "SOURCE_REACHED_HEURISTIC").when(budget, "ANALYSIS_BUDGET_EXHAUSTED")
        .when(blocked, "GRAPH_INCOMPLETE").when(leaves, "PROVEN_INTERNAL_ONLY").otherwise("GRAPH_INCOMPLETE")
    )


def chain_status_strict(status: Column) -> Column:
    """G8 (strict): the state of a chain over its parameters' states, as an aggregate: the strongest state wins.

    No parameter, and any unknown state below a budget, is GRAPH_INCOMPLETE.
    """
    has = lambda s: F.coalesce(F.bool_or(status == s), F.lit(False))
    odd = F.coalesce(F.bool_or(status.isNull() | ~status.isin("SOURCE_REACHED_DETERMINISTIC", "PROVEN_INTERNAL_ONLY")), F.lit(True))
    return F.when(has(STATUS_ORDER[0]), STATUS_ORDER[0]).when(has(STATUS_ORDER[1]), STATUS_ORDER[1]).when(has(STATUS_ORDER[2]), STATUS_ORDER[2]).when(odd, STATUS_ORDER[3]).otherwise(STATUS_ORDER[4])


def chain_status_all(status: Column) -> Column:
    """G8 (not strict): over the parameters that are not internal, all reached, some reached, or why not."""
    dynamic = F.when(status != "PROVEN_INTERNAL_ONLY", status)
    reached = dynamic.isin("SOURCE_REACHED_DETERMINISTIC", "SOURCE_REACHED_HEURISTIC")
    return (
        F.when(F.count(F.lit(1)) == 0, "GRAPH_INCOMPLETE").when(F.count(dynamic) == 0, "PROVEN_INTERNAL_ONLY")
        .when(F.bool_and(dynamic == "SOURCE_REACHED_DETERMINISTIC"), "SOURCE_REACHED_DETERMINISTIC").when(F.bool_and(reached), "SOURCE_REACHED_HEURISTIC")
        .when(F.bool_or(reached), "PARTIAL_SOURCE_REACHABILITY").when(F.bool_or(dynamic == "GRAPH_INCOMPLETE"), "GRAPH_INCOMPLETE")
        .when(F.bool_or(dynamic == "SOURCE_NOT_RESOLVED"), "SOURCE_NOT_RESOLVED").otherwise("PROVEN_INTERNAL_ONLY")
    )


def bounded_lineage(inputs: DataFrame, starts: DataFrame, mnemonics: Sequence[str], max_values: int, rounds: int = 1000) -> DataFrame:
    """Per start its def-use closure over the given operations, by (level, value), with truncated flags past max_values.

    inputs: output, input, mnemonic. Returns start, value, level, truncated. The budget counts values in
    (level, value) order, so it doesn't depend on the plan.
    """
    from pyspark.sql import Window

    kept = inputs.filter(F.col("mnemonic").isin(*mnemonics)).select(F.col("output").alias("value"), F.col("input").alias("next"))
    seeds = starts.select("start", F.col("start").alias("value"), F.lit(0).alias("level"))

    def step(delta: DataFrame) -> DataFrame:
        return delta.join(kept, "value").select("start", F.col("next").alias("value"), (F.col("level") + 1).cast("int").alias("level"))

    rows = whole(relaxation(seeds, step, ["start", "value"], ["level"], rounds))
    w = Window.partitionBy("start").orderBy("level", "value")
    numbered = rows.withColumn("__n", F.row_number().over(w)).withColumn("truncated", F.max("__n").over(Window.partitionBy("start")) > max_values)
    return numbered.filter(F.col("__n") <= max_values).drop("__n")


def expand_lineage(seeds: DataFrame, calls: DataFrame, helpers: DataFrame, depth: int, rounds: int = 1000, both: bool = False) -> Result:
    """(lineage, node, helpers) reached along calls (caller, callee), with `both` against them, too, and through helpers (function, helper) at most `depth` deep.

    A node is kept with the fewest helpers that lead to it.
    """
    edges = calls.select(F.col("caller").alias("node"), F.col("callee").alias("next"), F.lit(0).alias("cost")).unionByName(
        helpers.select(F.col("function").alias("node"), F.col("helper").alias("next"), F.lit(1).alias("cost"))
    )
    if both:
        edges = edges.unionByName(calls.select(F.col("callee").alias("node"), F.col("caller").alias("next"), F.lit(0).alias("cost")))
    edges = checkpoint(edges.distinct())

    def step(delta: DataFrame) -> DataFrame:
        moved = delta.join(edges, "node").select("lineage", F.col("next").alias("node"), (F.col("helpers") + F.col("cost")).cast("int").alias("helpers"))
        return moved.filter(F.col("helpers") <= depth)

    return relaxation(seeds.select("lineage", "node", F.lit(0).alias("helpers")), step, ["lineage", "node"], ["helpers"], rounds)


def wrapper_summaries(primitives: DataFrame, calls: DataFrame, max_depth: int = MAX_WRAPPER_DEPTH) -> DataFrame:
    """(function, label, depth, roles) of functions that pass their formals on to all roles of a summary.

    primitives: function, label, roles map<string,int> (role -> formal slot). calls: site, caller, callee,
    slots map<int,int> (callee slot -> caller formal), linear (whether the caller is a body of that one
    call). A role that the caller binds to no formal ends the summary. The least depth of a (function, label) is kept.
    """
    held = primitives.select("function", "label", F.lit(0).alias("depth"), F.array_sort(F.map_entries("roles")).alias("entries"))

    def step(delta: DataFrame) -> DataFrame:
        up = delta.join(calls.filter("linear"), delta["function"] == calls["callee"]).filter(F.col("depth") < max_depth)
        bound = F.transform("entries", lambda e: F.struct(e["key"].alias("key"), F.try_element_at("slots", e["value"]).alias("value")))
        return up.select(F.col("caller").alias("function"), "label", (F.col("depth") + 1).cast("int").alias("depth"), bound.alias("entries")).filter(F.forall("entries", lambda e: e["value"].isNotNull()))

    return whole(relaxation(held, step, ["function", "label"], ["depth"], max_depth + 1, ["entries"]))


def instantiate(summaries: DataFrame, calls: DataFrame) -> DataFrame:
    """Each call of a summarised function with its roles' actual arguments: (site, caller, label, role, actual).

    calls: site, caller, callee, arguments array<string> (by slot).
    """
    bound = calls.join(summaries, calls["callee"] == summaries["function"]).select("site", "caller", "label", "arguments", F.explode("entries").alias("e"))
    return bound.select("site", "caller", "label", F.col("e.key").alias("role"), F.get("arguments", F.col("e.value")).alias("actual"))


def indirect_targets(candidates: DataFrame, site: str, target: str, strategy: str, limit: int = MAX_TARGETS) -> DataFrame:
    """Per site the targets of the first strategy that names any: (site, strategy, resolution, targets).

    One target is 'resolved', up to `limit` 'ambiguous'; more stay 'unresolved' with no targets, never cut off.
    """
    per = candidates.filter(F.col(target).isNotNull()).groupBy(site, strategy).agg(F.count_distinct(target).alias("n"), F.array_sort(F.collect_set(target)).alias("targets"))
    best = per.groupBy(site).agg(F.min(F.struct(strategy, "n", "targets")).alias("b")).select(site, "b.*")
    state = F.when(F.col("n") == 1, "resolved").when(F.col("n") <= limit, "ambiguous").otherwise("unresolved")
    return best.select(site, strategy, state.alias("resolution"), F.when(F.col("n") <= limit, F.col("targets")).otherwise(F.array().cast("array<string>")).alias("targets"))


def enumerate_table(lookups: DataFrame, table: DataFrame, max_entries: int = 256) -> DataFrame:
    """Per lookup (id, base, stride, count) all entries of an initialised table, or unresolved as a whole.

    table: address, value. Domains over max_entries or with an unknown entry are unresolved, never partial.
    """
    small = (F.col("count") > 0) & (F.col("count") <= max_entries)
    wanted = lookups.filter(small).select("id", "count", F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("i"), "base", "stride").withColumn("address", F.col("base") + F.col("i") * F.col("stride"))
    found = wanted.join(table, "address").groupBy("id", "count").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("value")).alias("values")).filter(F.col("n") == F.col("count"))
    return lookups.select("id").join(found.select("id", "values"), "id", "left").withColumn("resolution", F.when(F.col("values").isNull(), "unresolved").otherwise("resolved"))


def container_pairs(inserts: DataFrame, removes: DataFrame, region: Sequence[str]) -> DataFrame:
    """Insert and remove summaries of one container region, full outer: unmatched ones carry a reason.

    Per region one row with its sorted insert and remove sites, so a hot container isn't multiplied out.
    """
    i = inserts.groupBy(*region).agg(F.array_sort(F.collect_set("site")).alias("insert_sites"))
    r = removes.groupBy(*region).agg(F.array_sort(F.collect_set("site")).alias("remove_sites"))
    both = i.join(r, list(region), "full_outer")
    reason = F.when(F.col("remove_sites").isNull(), "insert_without_remove").when(F.col("insert_sites").isNull(), "remove_without_insert")
    return both.withColumn("reason", reason)


def merge_nodes(nodes: DataFrame, id_col: str, ordinal: str) -> DataFrame:
    """One node per id, each attribute from the latest row that has it."""
    attributes = [c for c in nodes.columns if c not in (id_col, ordinal)]
    return nodes.groupBy(id_col).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(ordinal))).alias(c) for c in attributes))


def assemble_edges(families: list[DataFrame], id_col: str = "edge_id") -> DataFrame:
    """The union of edge families, the first family and row of an id winning."""
    parts = [f.withColumn("__family", F.lit(n)) for n, f in enumerate(families)]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    others = [c for c in union.columns if c != id_col]
    return keep_first(union, [id_col], ["__family", *sorted(c for c in others if c != "__family")]).drop("__family")


def classify_objects(accesses: DataFrame, object_col: str, kind: str) -> DataFrame:
    """Objects with their reads and writes; shared if there is at least one of each by different functions."""
    g = accesses.filter(F.col(object_col).isNotNull()).groupBy(object_col).agg(
        F.count_if(F.col(kind) == "WRITE").alias("writes"), F.count_if(F.col(kind) == "READ").alias("reads"), F.count_distinct("function_id").alias("functions")
    )
    return g.withColumn("shared", (F.col("writes") > 0) & (F.col("reads") > 0) & (F.col("functions") > 1))


#: Parts of names of functions that look like a task's entry.
TASK_NAMES = ("task", "thread", "worker", "work_q")


def execution_contexts(functions: DataFrame, calls: DataFrame, explicit: DataFrame | None = None, deterministic: bool = False, rounds: int = 10_000) -> DataFrame:
    """(function, contexts, provenance) of every function: the contexts that reach it along calls, sorted, and where they come from.

    functions: function, name, interrupt, entry; calls: caller, callee, mnemonic; explicit: function, context, provenance (rows that are proved).
    Roots are interrupt entries and main; without `deterministic` names that look like a task's, and only direct calls are
    followed; with it program entries and explicit rows, and resolved indirect calls are followed, too, as a hop of their own kind.
    A function that nothing reaches is 'ctx:unknown', or has no context if deterministic. Per context the provenance of the
    fewest hops counts, the least of equals.
    """
    f = functions.select("function", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("interrupt", F.lit(False)).alias("interrupt"), F.coalesce("entry", F.lit(False)).alias("entry"))
    root = lambda when, context, source: F.when(when, F.struct(context.alias("context"), F.lit(source).alias("provenance")))
    of = lambda kind: F.concat(F.lit(f"ctx:{kind}:"), F.col("function").cast("string"))
    looks = reduce(lambda a, b: a | b, (F.lower("name").contains(t) for t in TASK_NAMES))
    if deterministic:
        roots = [root(F.col("interrupt"), of("isr"), "DETERMINISTIC_VECTOR_ISR"), root(F.col("name") == "main", F.lit("ctx:main"), "DETERMINISTIC_MAIN_SYMBOL"), root(F.col("entry"), of("entry"), "DETERMINISTIC_PROGRAM_ENTRY")]
    else:
        roots = [root(F.col("interrupt"), of("isr"), "CALLGRAPH_FROM_VECTOR_ISR"), root(F.col("name") == "main", F.lit("ctx:main"), "CALLGRAPH_FROM_MAIN"), root(looks, of("task"), "CALLGRAPH_FROM_HEURISTIC_TASK_ENTRY")]
    seeds = f.select("function", F.explode(F.array_compact(F.array(*roots))).alias("r")).select("function", "r.*")
    if deterministic and explicit is not None:
        seeds = seeds.unionByName(explicit.select("function", "context", F.coalesce("provenance", F.lit("DETERMINISTIC_EXPLICIT_CONTEXT")).alias("provenance")).filter("context <> ''").join(f.select("function"), "function", "left_semi"))
    followed = calls.filter(F.col("mnemonic").isin("CALL", "CALLIND") if deterministic else F.col("mnemonic") == "CALL")
    known = f.select(F.col("function").alias("callee")).distinct()
    edges = followed.join(known, "callee", "left_semi").groupBy("caller", "callee").agg(F.bool_and(F.col("mnemonic") == "CALLIND").alias("indirect"))
    edges = checkpoint(edges.select(F.col("caller").alias("function"), F.col("callee").alias("next"), F.when(F.col("indirect"), "+EXACT_CALLIND").otherwise("+DIRECT_CALL").alias("hop")))

    def step(delta: DataFrame) -> DataFrame:
        moved = delta.join(edges, "function")
        source = F.concat("provenance", "hop") if deterministic else F.col("provenance")
        return moved.select(F.col("next").alias("function"), "context", (F.col("hops") + 1).cast("int").alias("hops"), source.alias("provenance"))

    found = whole(relaxation(seeds.withColumn("hops", F.lit(0)), step, ["function", "context"], ["hops"], rounds, ["provenance"]))
    told = found.groupBy("function").agg(F.array_sort(F.collect_set("context")).alias("contexts"), F.array_join(F.array_sort(F.collect_set("provenance")), "+").alias("provenance"))
    none = (F.array().cast("array<string>"), "NO_DETERMINISTIC_EXECUTION_CONTEXT") if deterministic else (F.array(F.lit("ctx:unknown")), "UNKNOWN_EXECUTION_CONTEXT")
    return f.select("function").distinct().join(told, "function", "left").select("function", F.coalesce("contexts", none[0]).alias("contexts"), F.coalesce("provenance", F.lit(none[1])).alias("provenance"))


#: Operations whose output carries what any input carries, and those whose output carries what all inputs carry.
TRANSPARENT_OPERATIONS = ("COPY", "CAST", "INDIRECT", "INT_ZEXT", "INT_SEXT", "SUBPIECE")
COMPUTE_OPERATIONS = (
    "PIECE", "INT_ADD", "INT_SUB", "INT_MULT", "INT_DIV", "INT_SDIV", "INT_REM", "INT_SREM", "INT_AND", "INT_OR", "INT_XOR", "INT_LEFT", "INT_RIGHT", "INT_SRIGHT", "INT_EQUAL", "INT_NOTEQUAL",
    "INT_LESS", "INT_SLESS", "INT_LESSEQUAL", "INT_SLESSEQUAL", "BOOL_NEGATE", "BOOL_AND", "BOOL_OR", "BOOL_XOR", "PTRADD", "PTRSUB",
)


def provenance_inputs(flow: DataFrame, formals: DataFrame, actuals: DataFrame, targets: DataFrame, returns: DataFrame) -> DataFrame:
    """The inputs of value_provenance that facts give: (output, input, mode, constant).

    flow: output, input, mnemonic, site, constant; formals: atom, function, slot; actuals: function, slot, atom; targets: site, function; returns:
    function, atom. Transparent operations take any input's labels, computing ones and merges those of all; a formal takes any
    actual's, the output of a call any of what its targets return. Other operations carry nothing.
    """
    mode = F.when(F.col("mnemonic").isin(*TRANSPARENT_OPERATIONS), "any").when(F.col("mnemonic").isin(*COMPUTE_OPERATIONS, "MULTIEQUAL"), "all")
    own = flow.withColumn("mode", mode).filter("mode IS NOT NULL").select("output", "input", "mode", F.coalesce("constant", F.lit(False)).alias("constant"))
    to = lambda df, output, value: df.select(F.col(output).alias("output"), F.col(value).alias("input"), F.lit("any").alias("mode"), F.col(value).startswith("const:").alias("constant"))
    passed = to(formals.withColumnRenamed("atom", "formal").join(actuals, ["function", "slot"]), "formal", "atom")
    calls = flow.filter(F.col("mnemonic").isin("CALL", "CALLIND")).select("output", "site").distinct()
    back = to(calls.join(targets, "site").join(returns, "function"), "output", "atom")
    return own.unionByName(passed).unionByName(back).filter("output <> '' AND input <> ''").distinct()
