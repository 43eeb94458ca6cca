"""Control-flow operators. A function's graph is small and its work sequential, so each
is solved as one row; graphs never meet, and a batch holds many of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.operators.fixpoint import closure, whole

#: Operations that pass a value on unchanged.
TRANSPARENT = ("COPY", "CAST", "INT_ZEXT", "INT_SEXT", "SUBPIECE", "INDIRECT")


def _order(succ: dict[str, list[str]], entry: str) -> list[str]:
    """The reachable blocks in reverse postorder."""
    seen, out, stack = {entry}, [], [(entry, iter(succ.get(entry, ())))]
    while stack:
        block, rest = stack[-1]
        for nxt in rest:
            if nxt not in seen:
                seen.add(nxt)
                stack.append((nxt, iter(succ.get(nxt, ()))))
                break
        else:
            out.append(block)
            stack.pop()
    return out[::-1]


def immediate_dominators(edges: Sequence[tuple[str, str]], entry: str) -> dict[str, str | None]:
    """Each reachable block's immediate dominator, None for the entry, found by meeting paths in the dominator tree."""
    succ: dict[str, list[str]] = {}
    pred: dict[str, list[str]] = {}
    for a, b in sorted(set(edges)):
        succ.setdefault(a, []).append(b)
        pred.setdefault(b, []).append(a)
    order = _order(succ, entry)
    place = {b: i for i, b in enumerate(order)}
    up: dict[str, str] = {entry: entry}
    changed = True
    while changed:
        changed = False
        for b in order[1:]:
            new = None
            for p in pred.get(b, ()):
                if p not in up:
                    continue
                if new is None:
                    new = p
                    continue
                a, c = p, new
                while a != c:
                    if place[a] > place[c]:
                        a = up[a]
                    else:
                        c = up[c]
                new = a
            if new is not None and up.get(b) != new:
                up[b], changed = new, True
    return {b: None if b == entry else up[b] for b in order}


def _per_graph(edges: DataFrame, keys: Sequence[str], entry: str, solve: Callable, fields: list[tuple[str, pa.DataType, str]]) -> DataFrame:
    """solve(edge pairs, entry) -> rows, for each group of edges; many groups share an Arrow batch."""
    pair = F.struct(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"))
    graphs = edges.groupBy(*keys).agg(F.collect_set(pair).alias("edges"), F.min(F.col(entry).cast("string")).alias("entry"))
    at = len(keys)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            index, rows = [], []
            for n, (pairs, start) in enumerate(zip(batch.column(at).to_pylist(), batch.column(at + 1).to_pylist())):
                found = solve(sorted((p["src"], p["dst"]) for p in pairs if p["dst"] is not None), start)
                index += [n] * len(found)
                rows += found
            columns = [batch.column(i).take(pa.array(index, pa.int64())) for i in range(at)]
            columns += [pa.array([r[i] for r in rows], kind) for i, (_, kind, _) in enumerate(fields)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, *(name for name, _, _ in fields)])

    keyed = [f"{k} {t}" for k, t in edges.select(*keys).dtypes]
    return graphs.mapInArrow(run, ", ".join([*keyed, *(f"{name} {sql}" for name, _, sql in fields)]))


def _dominator_rows(pairs: list[tuple[str, str]], entry: str) -> list[tuple]:
    up = immediate_dominators(pairs, entry)
    rows = []
    for block in up:
        at: str | None = block
        while at is not None:
            rows.append((block, at))
            at = up[at]
    return rows


def dominators(edges: DataFrame, keys: Sequence[str], entry: str) -> DataFrame:
    """(keys, block, dominator) of every reachable block, itself included.

    edges: keys, src, dst (NULL dst for a block without successor) and a column with the group's entry, the
    least of which counts. Repeated edges change nothing; an empty table gives an empty one.
    """
    return _per_graph(edges, keys, entry, _dominator_rows, [("block", pa.string(), "string"), ("dominator", pa.string(), "string")])


def with_roots(edges: DataFrame, keys: Sequence[str], every: bool = False) -> DataFrame:
    """edges (keys, src, dst) with the entry that their form tells: the least block without a predecessor, else the least block.

    With every, all blocks without a predecessor are entries: they follow a block '' that is the entry.
    """
    e = edges.select(*keys, "src", "dst").distinct()
    reached = e.filter("dst IS NOT NULL").select(*keys, F.col("dst").alias("src")).distinct()
    roots = e.select(*keys, "src").distinct().join(reached, [*keys, "src"], "left_anti")
    least = e.groupBy(*keys).agg(F.min("src").alias("least"))
    if not every:
        entry = least.join(roots.groupBy(*keys).agg(F.min("src").alias("root")), list(keys), "left").select(*keys, F.coalesce("root", "least").alias("entry"))
        return e.join(entry, list(keys))
    rootless = least.join(roots.select(*keys).distinct(), list(keys), "left_anti").select(*keys, F.col("least").alias("src"))
    first = roots.unionByName(rootless).select(*keys, F.lit("").alias("src"), F.col("src").alias("dst"))
    return e.unionByName(first).withColumn("entry", F.lit(""))


def root_dominators(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Dominators where every block without a predecessor is an entry: d dominates b if no entry leads to b without d."""
    return dominators(with_roots(edges, keys, every=True), keys, "entry").filter("block <> '' AND dominator <> ''")


def _loop_rows(pairs: list[tuple[str, str]], entry: str) -> list[tuple]:
    up = immediate_dominators(pairs, entry)
    pred: dict[str, set[str]] = {}
    for a, b in pairs:
        pred.setdefault(b, set()).add(a)

    def dominates(d: str, b: str | None) -> bool:
        while b is not None:
            if b == d:
                return True
            b = up[b]
        return False

    loops: dict[str, tuple[set[str], set[str]]] = {}
    for tail, head in pairs:
        if tail not in up or not dominates(head, tail):
            continue
        tails, body = loops.setdefault(head, (set(), {head}))
        tails.add(tail)
        todo = [tail]
        while todo:
            b = todo.pop()
            if b not in body:
                body.add(b)
                todo.extend(pred.get(b, ()))
    return [(h, sorted(t), sorted(body), sorted(f"{a}>{b}" for a, b in pairs if a in body and b not in body)) for h, (t, body) in sorted(loops.items())]


def natural_loops(edges: DataFrame, keys: Sequence[str], entry: str) -> DataFrame:
    """(keys, header, tails, blocks, exits), one row per header; a self-loop is its header alone.

    A back edge runs to a dominator of its start; the body is what reaches the start without the header.
    exits are 'source>target'.
    """
    lists = [(n, pa.list_(pa.string()), "array<string>") for n in ("tails", "blocks", "exits")]
    return _per_graph(edges, keys, entry, _loop_rows, [("header", pa.string(), "string"), *lists])


def recurrences(inputs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, phi, initial, update, step) of phis with one update by a constant non-zero step and one initial value.

    inputs: keys, output, input, pos, mnemonic, constant (the input's number, NULL if it is none). Transparent
    operations between phi and update are looked through with one closure over all functions.
    """
    passes = inputs.filter(F.col("mnemonic").isin(*TRANSPARENT) & F.col("constant").isNull()).select(*keys, F.col("input").alias("node"), F.col("output").alias("next")).distinct()
    phis = inputs.filter("mnemonic = 'MULTIEQUAL'")
    seeds = phis.select(*keys, F.col("output").alias("phi"), F.col("output").alias("node")).distinct()
    same = whole(closure(seeds, lambda d: d.join(passes, [*keys, "node"]).select(*keys, "phi", F.col("next").alias("node")), 10_000))
    sums = inputs.filter(F.col("mnemonic").isin("INT_ADD", "INT_SUB"))
    one = sums.groupBy(*keys, "output", "mnemonic").agg(
        F.count("*").alias("n"), F.count("constant").alias("constants"), F.max("constant").alias("step"), F.max_by("pos", F.col("constant").isNotNull()).alias("at"),
        F.max(F.when(F.col("constant").isNull(), F.col("input"))).alias("node"),
    ).filter("n = 2 AND constants = 1 AND (mnemonic = 'INT_ADD' OR at = 1)")
    steps = one.select(*keys, F.col("output").alias("update"), "node", F.when(F.col("mnemonic") == "INT_SUB", -F.col("step")).otherwise(F.col("step")).alias("step")).filter("step <> 0")
    updates = steps.join(same, [*keys, "node"]).select(*keys, "phi", F.col("update").alias("input"), "step")
    marked = phis.select(*keys, F.col("output").alias("phi"), "input", "pos").join(updates, [*keys, "phi", "input"], "left")
    g = marked.groupBy(*keys, "phi").agg(
        F.count("step").alias("updates"), F.count_if(F.col("step").isNull()).alias("initials"), F.max("step").alias("step"),
        F.max(F.when(F.col("step").isNotNull(), F.col("input"))).alias("update"), F.max(F.when(F.col("step").isNull(), F.col("input"))).alias("initial"),
    )
    return g.filter("updates = 1 AND initials = 1").select(*keys, "phi", "initial", "update", "step")


def branch_gates(edges: DataFrame, targets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, branch, target) where some but not all successors of the branch reach the target.

    edges: keys, src, dst; targets: keys, target. One backward closure from the targets serves all branches.
    """
    seeds = targets.select(*keys, "target", F.col("target").alias("node"))
    back = edges.select(*keys, F.col("dst").alias("node"), F.col("src").alias("prev")).distinct()
    reach = whole(closure(seeds, lambda d: d.join(back, [*keys, "node"]).select(*keys, "target", F.col("prev").alias("node")), 10_000))
    out = edges.select(*keys, "src", "dst").distinct()
    fan = out.groupBy(*keys, "src").agg(F.count("*").alias("n")).filter("n > 1")
    hit = out.join(reach.withColumnRenamed("node", "dst"), [*keys, "dst"]).groupBy(*keys, "src", "target").agg(F.count("*").alias("k"))
    return hit.join(fan, [*keys, "src"]).filter("k < n").select(*keys, F.col("src").alias("branch"), "target")


def exclusive_arms(edges: DataFrame, pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pairs (keys, left, right) of blocks that are explicit sibling arms: of one branch, and neither reaches the other."""
    fork = edges.select(*keys, "src", F.col("dst").alias("left")).distinct().join(edges.select(*keys, "src", F.col("dst").alias("right")).distinct(), [*keys, "src"])
    siblings = fork.filter("left <> right").select(*keys, "left", "right").distinct()
    asked = pairs.select(*keys, "left", "right").distinct().join(siblings, [*keys, "left", "right"], "left_semi")
    seeds = asked.select(*keys, F.col("left").alias("start"), F.col("left").alias("node")).unionByName(asked.select(*keys, F.col("right").alias("start"), F.col("right").alias("node"))).distinct()
    step = edges.select(*keys, F.col("src").alias("node"), F.col("dst").alias("next")).distinct()
    reach = whole(closure(seeds, lambda d: d.join(step, [*keys, "node"]).select(*keys, "start", F.col("next").alias("node")), 10_000))
    lr = reach.select(*keys, F.col("start").alias("left"), F.col("node").alias("right"))
    rl = reach.select(*keys, F.col("start").alias("right"), F.col("node").alias("left"))
    return asked.join(lr, [*keys, "left", "right"], "left_anti").join(rl, [*keys, "left", "right"], "left_anti")


def paired_updates(updates: DataFrame, keys: Sequence[str], exclusive: DataFrame | None = None) -> DataFrame:
    """Self-join of field updates of one base: (keys, base, site_a, site_b, reason), reason NULL for a pair.

    updates: keys, base, field, lineage, direction (1 or -1), site. A pair has different fields, one delta
    lineage and opposite directions and, where exclusive (keys, left, right: sites on exclusive arms) is given, no exclusive sites;
    the reason is the first test that fails. Updates meet only within (keys, base), of which a function has few.
    """
    b = updates.select(*keys, "base", *(F.col(c).alias(f"{c}_b") for c in ("field", "lineage", "direction", "site")))
    both = updates.join(b, [*keys, "base"]).filter("site < site_b")
    reason = F.when(F.col("field") == F.col("field_b"), "same_field").when(F.col("lineage") != F.col("lineage_b"), "different_delta").when(F.col("direction") == F.col("direction_b"), "same_direction")
    if exclusive is not None:
        arms = exclusive.select(*keys, F.least("left", "right").alias("site"), F.greatest("left", "right").alias("site_b")).distinct().withColumn("apart", F.lit(True))
        both = both.join(arms, [*keys, "site", "site_b"], "left")
        reason = reason.when(F.col("apart"), "exclusive_arms")
    return both.select(*keys, "base", F.col("site").alias("site_a"), "site_b", reason.alias("reason"))


def unpaired_bases(updates: DataFrame, pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The summary reject of each base with updates and no compatible pair: (keys, base, updates, reason)."""
    good = pairs.filter("reason IS NULL").select(*keys, "base").distinct()
    return updates.groupBy(*keys, "base").agg(F.count("*").alias("updates")).join(good, [*keys, "base"], "left_anti").withColumn("reason", F.lit("no_compatible_pair"))


def affine_terms(inputs: DataFrame, roots: DataFrame, keys: Sequence[str], depth: int = 12) -> DataFrame:
    """(keys, root, node, stride, offset): roots as sums of stride * node + offset over additions and multiplications.

    inputs: keys, output, input, pos, mnemonic, constant. A node that is no sum or scaled value is a term;
    two terms of one node add up. Multiplications scale only by a constant; other operations end a term.
    """
    wide = inputs.groupBy(*keys, "output", "mnemonic").agg(
        F.count("*").alias("n"), F.sum("constant").alias("c"), F.count("constant").alias("constants"), F.collect_list(F.when(F.col("constant").isNull(), F.struct("pos", "input"))).alias("vs")
    )
    linear = wide.filter("(mnemonic IN ('INT_ADD', 'INT_SUB') AND n = 2 AND NOT (mnemonic = 'INT_SUB' AND constants = 2)) OR (mnemonic IN ('INT_MULT', 'INT_LEFT') AND n = 2 AND constants = 1)")
    minus = F.when((F.col("mnemonic") == "INT_SUB"), -1).otherwise(1)
    scale = F.when(F.col("mnemonic") == "INT_MULT", F.col("c")).when(F.col("mnemonic") == "INT_LEFT", F.expr("shiftleft(CAST(1 AS BIGINT), CAST(least(c, 62) AS INT))")).otherwise(1)
    parts = linear.select(*keys, F.col("output").alias("node"), "mnemonic", scale.alias("scale"), F.when(F.col("mnemonic").isin("INT_ADD", "INT_SUB"), F.coalesce(F.col("c") * minus, F.lit(0))).otherwise(0).alias("add"), F.col("vs"))
    current = roots.select(*keys, F.col("root"), F.col("root").alias("node"), F.lit(1).cast("bigint").alias("stride"), F.lit(0).cast("bigint").alias("offset"))
    done = None
    from factweave.session import checkpoint

    for _ in range(depth):
        step = current.join(parts, [*keys, "node"], "left")
        ended = step.filter("scale IS NULL").select(*current.columns)
        done = ended if done is None else done.unionByName(ended)
        grown = step.filter("scale IS NOT NULL").select(*keys, "root", "stride", "offset", "scale", "add", "mnemonic", F.posexplode_outer("vs").alias("i", "v"))
        sign = F.when((F.col("mnemonic") == "INT_SUB") & (F.col("v.pos") == 1), -1).otherwise(1)
        current = checkpoint(
            grown.select(*keys, "root", F.col("v.input").alias("node"), (F.col("stride") * F.col("scale") * sign).cast("bigint").alias("stride"), (F.when(F.coalesce("i", F.lit(0)) == 0, F.col("offset") + F.col("stride") * F.col("add")).otherwise(0)).cast("bigint").alias("offset"))
        )
        if current.isEmpty():
            break
    return done.unionByName(current).groupBy(*keys, "root", "node").agg(F.sum("stride").alias("stride"), F.sum("offset").alias("offset"))


def address_progressions(terms: DataFrame, recurrences: DataFrame, invariants: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, root, phi, stride, reason) of each address that is a sum: the bytes by which it moves a turn, or why it moves by no fixed number.

    terms as affine_terms gives them; recurrences: keys, phi, step; invariants: keys, value. An address progresses if exactly one of its terms is a
    recurrence and all others stay the same in the loop.
    """
    phis = recurrences.groupBy(*keys, F.col("phi").alias("node")).agg(F.min("step").alias("step"))
    same = invariants.select(*keys, F.col("value").alias("node")).distinct().withColumn("same", F.lit(True))
    marked = terms.join(phis, [*keys, "node"], "left").join(same, [*keys, "node"], "left")
    live = F.col("node").isNotNull() & (F.col("stride") != 0)
    g = marked.groupBy(*keys, "root").agg(
        F.count_if(live & F.col("step").isNotNull()).alias("moving"), F.count_if(live & F.col("step").isNull() & F.col("same").isNull()).alias("unknown"),
        F.max(F.when(live & F.col("step").isNotNull(), F.struct(F.col("node").alias("phi"), (F.col("stride") * F.col("step")).cast("bigint").alias("stride")))).alias("m"),
    )
    reason = F.when(F.col("moving") == 0, "address_does_not_move").when(F.col("moving") > 1, "address_moves_by_several_recurrences").when(F.col("unknown") > 0, "address_has_a_varying_term")
    told = g.withColumn("reason", reason)
    fine = F.col("reason").isNull()
    return told.select(*keys, "root", F.when(fine, F.col("m.phi")).alias("phi"), F.when(fine, F.col("m.stride")).alias("stride"), "reason")


def loop_bounds(tests: DataFrame, recurrences: DataFrame, invariants: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, phi, bound, mnemonic, swapped) of exit tests that compare a recurrence, before or after its update, with what stays the same.

    tests: keys, site, mnemonic, left, right and, for numbers, left_constant, right_constant. swapped: whether the recurrence stands on the right.
    """
    phi = recurrences.select(*keys, "phi", F.explode(F.array("phi", "update")).alias("value")).distinct()
    sides = tests.select(*keys, "site", "mnemonic", F.explode(F.array(
        F.struct(F.col("left").alias("value"), F.col("right").alias("bound"), F.col("right_constant").alias("number"), F.lit(False).alias("swapped")),
        F.struct(F.col("right").alias("value"), F.col("left").alias("bound"), F.col("left_constant").alias("number"), F.lit(True).alias("swapped")),
    )).alias("s")).select(*keys, "site", "mnemonic", "s.*")
    same = invariants.select(*keys, F.col("value").alias("bound")).distinct().withColumn("same", F.lit(True))
    met = sides.join(phi, [*keys, "value"]).join(same, [*keys, "bound"], "left").filter("number IS NOT NULL OR same")
    return met.select(*keys, "phi", "site", "bound", "mnemonic", "swapped").distinct()
