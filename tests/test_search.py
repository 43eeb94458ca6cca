"""The backward search against cases and against one loop over dictionaries."""

import random

import pytest

from factweave.operators import search

SHAPES = {
    "definitions": "atom string, function string, site string, mnemonic string, address_atom string, address_object string, inputs array<struct<atom:string,object:string>>, operands int",
    "reads": "edge string, site string, atom string, object string, start bigint, end bigint",
    "writes": "edge string, site string, function string, target string, start bigint, end bigint, atom string, object string",
    "formals": "atom string, function string, slot int",
    "actuals": "edge string, site string, function string, slot int, atom string, object string",
    "targets": "site string, edge string, function string",
    "returns": "function string, atom string, object string",
    "effects": "effect string, site string, out_atom string, target string, atom string, object string, may boolean",
    "aliases": "alias string, site string, atom string, root_atom string, root_object string",
    "outputs": "effect string, site string, target string, start bigint, end bigint, atom string, object string",
}


def facts(spark, **rows):
    return search.Facts(**{n: spark.createDataFrame(rows.get(n, []), s) for n, s in SHAPES.items()})


def run(spark, rows, sources, starts, **kw):
    f = facts(spark, **rows)
    found = search.backward(f, spark.createDataFrame(sources, "atom string, source string"), spark.createDataFrame(starts, "search string, sink string, atom string, object string"), **kw)
    paths = sorted((r.search, r.atom, r.source, r.may, tuple((s.kind, s.site) for s in r.path)) for r in found.paths.collect())
    return paths, sorted(map(tuple, found.leaves.collect())), sorted(map(tuple, found.blockers.collect()))


def op(atom, function, site, mnemonic, *inputs, address=("", ""), operands=None):
    return atom, function, site, mnemonic, *address, list(inputs), len(inputs) if operands is None else operands


READ = [("channel:read", "site:load", "", "obj:shared", 0, 4)]
LOADED = op("loaded", "reader", "site:load", "LOAD", address=("p", "obj:shared"))


def write(edge, atom, start=0, function="writer"):
    return edge, f"site:{edge}", function, "obj:shared", start, start + 4, atom, ""


def test_a_channel_leads_to_the_source(spark):
    rows = {"definitions": [LOADED, op("source", "writer", "site:source", "LOAD")], "reads": READ, "writes": [write("w", "source")]}
    paths, leaves, blockers = run(spark, rows, [("source", "S")], [("K", "site:sink", "loaded", "")])
    assert paths == [("K", "source", "S", False, (("CHANNEL", "site:w"),))] and not leaves and not blockers
    # a writer elsewhere in the object
    paths, _, blockers = run(spark, {**rows, "writes": [write("w", "source", 8)]}, [("source", "S")], [("K", "site:sink", "loaded", "")])
    assert not paths and blockers == [("K", "no_overlapping_channel_write_region", "loaded", "")]
    # a constant writer beside it is a leaf of its own
    paths, leaves, _ = run(spark, {**rows, "writes": [write("w", "source"), write("c", "const:0:4", function="initializer")]}, [("source", "S")], [("K", "site:sink", "loaded", "")])
    assert [p[2] for p in paths] == ["S"] and leaves == [("K", "const:0:4", "")]
    # the region of the read is unknown
    paths, _, _ = run(spark, {**rows, "reads": [("r", "site:load", "", "obj:shared", None, None)]}, [("source", "S")], [("K", "site:sink", "loaded", "")])
    assert len(paths) == 1


def test_a_read_at_the_sink_comes_before_the_pointer(spark):
    rows = {"definitions": [op("ptr", "f", "site:add", "INT_ADD", ("index", ""))], "reads": [("r", "site:sink", "ptr", "obj:shared", 0, 4)], "writes": [write("w", "bytes")]}
    paths, _, _ = run(spark, rows, [("index", "I"), ("bytes", "B")], [("K", "site:sink", "ptr", "")])
    assert paths == [("K", "bytes", "B", False, (("SINK_READ", "site:w"),))]
    paths, _, _ = run(spark, rows, [("index", "I"), ("bytes", "B")], [("K", "site:elsewhere", "ptr", "")])
    assert {p[2] for p in paths} == {"I", "B"}


def test_a_call_returns_to_its_own_caller(spark):
    rows = {
        "definitions": [op("r1", "main", "site:c1", "CALL"), op("r2", "main", "site:c2", "CALL")],
        "targets": [("site:c1", "e1", "id"), ("site:c2", "e2", "id")], "returns": [("id", "formal", "")], "formals": [("formal", "id", 0)],
        "actuals": [("e1", "site:c1", "id", 0, "a1", ""), ("e2", "site:c2", "id", 0, "a2", "")],
    }
    paths, _, _ = run(spark, rows, [("a1", "S1"), ("a2", "S2")], [("K", "k", "r1", "")])
    assert paths == [("K", "a1", "S1", False, (("CALL_RETURN", "site:c1"), ("ACTUAL_FORMAL", "site:c1")))]
    # without a context every caller counts
    paths, _, _ = run(spark, rows, [("a1", "S1"), ("a2", "S2")], [("K", "k", "formal", "")])
    assert [p[2] for p in paths] == ["S1", "S2"]


def test_blockers_of_calls(spark):
    def one(**more):
        rows = {"definitions": [op("r", "main", "site:c", "CALL")], **more}
        return run(spark, rows, [], [("K", "k", "r", "")], max_alternatives=2)[2]

    assert one() == [("K", "unresolved_call_return_summary", "r", "")]
    assert one(definitions=[op("r", "main", "site:c", "CALLIND")]) == [("K", "unresolved_indirect_call_target", "r", "")]
    assert one(targets=[("site:c", "e", "f"), ("site:c", "e2", "g")]) == [("K", "ambiguous_call_target", "r", "")]
    assert one(targets=[("site:c", "e", "f")], returns=[("f", x, "") for x in "abc"]) == [("K", "function_summary_alternative_budget_exhausted", "r", "")]
    # recursion ends at the depth of calls
    rows = {"definitions": [op("r", "f", "site:c", "CALL")], "targets": [("site:c", "e", "f")], "returns": [("f", "r", "")]}
    assert run(spark, rows, [], [("K", "k", "r", "")])[2] == [("K", "function_resolution_depth_exhausted", "r", "")]


def test_copies_and_aliases_hold_once_a_path(spark):
    rows = {"effects": [("x", "site:x", "", "obj:a", "", "obj:b", False), ("y", "site:y", "", "obj:b", "", "obj:a", True)], "aliases": [("al", "site:al", "v", "v2", ""), ("al2", "site:al2", "v2", "v", "obj:a")]}
    paths, _, blockers = run(spark, rows, [], [("K", "k", "", "obj:a"), ("L", "k", "v", "")])
    assert not paths and {b[1] for b in blockers} == {"unmodeled_origin"}
    paths, _, _ = run(spark, {**rows, "effects": [("x", "site:x", "v", "", "s", "", True)]}, [("s", "S"), ("v2", "A")], [("L", "k", "v", "")])
    assert paths == [("L", "s", "S", True, (("PRIMITIVE_MEMORY_EFFECT", "site:x"),)), ("L", "v2", "A", True, (("BOUNDED_CONTAINER_ALIAS", "site:al"),))]


def test_a_load_without_a_known_read(spark):
    rows = {
        "definitions": [op("v", "f", "site:l", "LOAD", address=("p", "obj:s")), op("u", "f", "site:m", "LOAD")],
        "outputs": [("o", "site:o", "obj:s", 0, 4, "out", "")], "writes": [("w", "site:w", "g", "obj:s", 0, 4, "other", ""), ("w2", "site:w2", "f", "obj:s", 0, 4, "own", "")],
    }
    paths, _, blockers = run(spark, rows, [("out", "O"), ("other", "W"), ("own", "X"), ("p", "P")], [("K", "k", "v", ""), ("L", "k", "u", "")])
    assert [(p[2], p[4][0][0]) for p in paths] == [("W", "EXACT_STORE"), ("O", "CALL_OUTPUT"), ("P", "LOAD_ADDRESS")]
    assert blockers == [("L", "unresolved_load_address", "u", "")]


def test_levels_that_do_not_suffice_and_empty_facts(spark):
    rows = {"definitions": [op(f"v{i}", "f", f"s{i}", "COPY", (f"v{i + 1}", "")) for i in range(6)]}
    paths, _, blockers = run(spark, rows, [("v6", "S")], [("K", "k", "v0", "")], levels=3)
    assert not paths and blockers == [("K", "ANALYSIS_BUDGET_EXHAUSTED", "v3", "")]
    assert run(spark, {}, [], [("K", None, "v", None)]) == ([], [], [("K", "unmodeled_origin", "v", "")])
    assert run(spark, {}, [], []) == ([], [], [])


def brute(rows, sources, starts, max_call_depth=3, max_alternatives=8):
    """The rules as a breadth-first loop, one state at a time."""
    meets = lambda a, b: a[0] is None or b[0] is None or a[0] < b[1] and b[0] < a[1]
    get = lambda n: rows.get(n, [])
    defs = {d[0]: d for d in get("definitions")}
    paths, leaves, blockers = set(), set(), set()
    for name, sink, atom, obj in starts:
        level = {(atom, obj, 0, ()): ((), False, ())}
        seen = set(level)
        while level:
            grown = {}

            def push(state, path, may, used, level=grown):
                if state not in level or (len(path), path, may, used) < (len(level[state][0]), *level[state]):
                    level[state] = (path, may, used)

            for (at, of, depth, context), (path, may, used) in level.items():
                hit = {s for a, s in sources if a == at and a}
                if hit:
                    paths |= {(name, at, s, may, path) for s in hit}
                    continue
                steps, told = [], set()

                def region(r, kind, steps=steps, told=told, path=path, may=may, used=used):
                    near = [w for w in get("writes") if w[3] == r[0]]
                    over = [w for w in near if meets(r[1:], w[4:6])]
                    if near and not over:
                        told.add("no_overlapping_channel_write_region")
                    for w in over:
                        if w[6] or w[7]:
                            steps.append(((w[6], w[7], 0, ()), (*path, (kind, w[1])), may, used))
                        else:
                            told.add("missing_channel_store_operand_binding")

                def alias(steps=steps, at=at, depth=depth, context=context, path=path, used=used):
                    for a in get("aliases"):
                        if a[2] == at and a[0] not in used and (a[3] or a[4]):
                            steps.append(((a[3], a[4], depth, context), (*path, ("BOUNDED_CONTAINER_ALIAS", a[1])), True, (*used, a[0])))

                leaf = False
                for r in get("reads"):
                    if r[1] == sink and (r[2] == at if r[2] else of and r[3] == of):
                        region(r[3:], "SINK_READ")
                explicit = bool(steps)
                alias()
                d = None
                if not explicit:
                    d = defs.get(at) if at else None
                    for r in get("reads"):
                        if r[2] and r[2] == at or not r[2] and d and d[3] == "LOAD" and d[2] == r[1]:
                            region(r[3:], "CHANNEL")
                    for f in get("formals"):
                        for a in get("actuals"):
                            if f[0] == at and (a[2], a[3]) == (f[1], f[2]) and (not context or context[-1] == a[0]) and (a[4] or a[5]):
                                steps.append(((a[4], a[5], max(0, depth - 1) if context else depth, context[:-1]), (*path, ("ACTUAL_FORMAL", a[1])), may, used))
                    for e in get("effects"):
                        if e[0] not in used and (e[2] and e[2] == at or e[3] and e[3] == of) and (e[4] or e[5]):
                            steps.append(((e[4], e[5], depth, context), (*path, ("PRIMITIVE_MEMORY_EFFECT", e[1])), may or e[6], (*used, e[0])))
                    if d and d[3] in ("CALL", "CALLIND"):
                        to = {(t[2], t[1]) for t in get("targets") if t[0] == d[2]}
                        names = {t for t, _ in to}
                        back = [r for r in get("returns") if r[0] in names and (r[1] or r[2])]
                        if depth >= max_call_depth:
                            told.add("function_resolution_depth_exhausted")
                        elif not names:
                            told.add("unresolved_indirect_call_target" if d[3] == "CALLIND" else "unresolved_call_return_summary")
                        elif len(names) > 1:
                            told.add("ambiguous_call_target")
                        elif not back:
                            told.add("unresolved_call_return_summary")
                        elif len(back) > max_alternatives:
                            told.add("function_summary_alternative_budget_exhausted")
                        else:
                            edge = min(e for _, e in to)
                            steps += [((r[1], r[2], depth + 1, (*context, edge)), (*path, ("CALL_RETURN", d[2])), may, used) for r in back]
                    elif d and d[3] == "LOAD":
                        if not any(r[1] == d[2] for r in get("reads")):
                            steps += [((o[5], o[6], 0, ()), (*path, ("CALL_OUTPUT", o[1])), may, used) for o in get("outputs") if o[2] == d[5] and (o[5] or o[6])]
                            steps += [((w[6], w[7], 0, ()), (*path, ("EXACT_STORE", w[1])), may, used) for w in get("writes") if w[3] == d[5] and w[2] != d[1] and (w[6] or w[7])]
                            if d[4] or d[5]:
                                steps.append(((d[4], d[5], depth, context), (*path, ("LOAD_ADDRESS", d[2])), may, used))
                            else:
                                told.add("unresolved_load_address")
                    elif d:
                        steps += [((i, o, depth, context), (*path, ("LOCAL_DEF_USE", d[2])), may, used) for i, o in d[6] if i or o]
                        if any(not i and not o for i, o in d[6]):
                            told.add("missing_backend_atom_binding")
                        if not d[6]:
                            if d[7]:
                                leaf = True
                            else:
                                told.add("unmodeled_origin")
                    elif not steps and (at.startswith("const:") or of.startswith("const:")):
                        leaf = True
                    elif not steps:
                        if of:
                            region((of, None, None), "OBJECT_WRITE")
                        if not steps and not told:
                            told.add("unresolved_formal_parameter" if any(f[0] == at for f in get("formals")) else "unmodeled_origin")
                if leaf:
                    leaves.add((name, at, of))
                blockers |= {(name, b, at, of) for b in told}
                for state, p, m, u in steps:
                    push(state, p, m, u)
            level = {k: v for k, v in grown.items() if k not in seen}
            seen |= set(level)
    return sorted(paths), sorted(leaves), sorted(blockers)


def random_facts(rng):
    atoms, objects, functions, sites, edges = [f"v{i}" for i in range(9)] + ["const:1"], ["", "", "obj:a", "obj:b"], ["f", "g", "h"], [f"s{i}" for i in range(6)], ["e1", "e2", "e3"]
    some = lambda xs: rng.choice(xs)
    span = lambda: (None, None) if rng.random() < 0.2 else ((s := rng.choice([0, 4, 8])), s + 4)
    maybe = lambda xs: some([*xs, "", ""])
    n = lambda: range(rng.randint(0, 3))
    definitions = []
    for a in atoms[:-1]:
        if rng.random() < 0.8:
            mnemonic = some(["COPY", "INT_ADD", "LOAD", "CALL", "CALLIND"])
            inputs = [(some(atoms), some(objects)) for _ in range(rng.randint(0, 2))]
            definitions.append((a, some(functions), some(sites), mnemonic, maybe(atoms), some(objects), inputs, len(inputs) + rng.randint(0, 1)))
    return {
        "definitions": definitions,
        "reads": [(some(edges), some(sites), maybe(atoms), some(objects[2:]), *span()) for _ in n()],
        "writes": [(f"w{i}", f"ws{i}", some(functions), some(objects[2:]), *span(), maybe(atoms), some(objects)) for i in n()],
        "formals": list({a: (a, some(functions), rng.randint(0, 1)) for a in rng.sample(atoms[:-1], 2)}.values()),
        "actuals": [(some(edges), f"as{i}", some(functions), rng.randint(0, 1), some(atoms), some(objects)) for i in range(4)],
        "targets": list({(s := some(sites), f := some(functions)): (s, some(edges), f) for _ in range(5)}.values()),
        "returns": list({(some(functions), maybe(atoms), some(objects)) for _ in range(3)}),
        "effects": [(f"x{i}", f"xs{i}", maybe(atoms), some(objects), maybe(atoms), some(objects), rng.random() < 0.5) for i in n()],
        "aliases": [(f"al{i}", f"als{i}", some(atoms), maybe(atoms), some(objects)) for i in n()],
        "outputs": [(f"o{i}", f"os{i}", some(objects[2:]), 0, 4, maybe(atoms), some(objects)) for i in n()],
    }


@pytest.mark.parametrize("seed", range(2))
def test_against_a_loop(spark, seed):
    rng = random.Random(seed)
    rows = random_facts(rng)
    starts = [(f"K{i}", rng.choice(["s0", "s1", "none"]), f"v{i}", rng.choice(["", "obj:a"])) for i in range(5)]
    sources = [("v7", "S7"), ("v8", "S8"), ("v8", "S9")]
    assert run(spark, rows, sources, starts) == brute(rows, sources, starts)
