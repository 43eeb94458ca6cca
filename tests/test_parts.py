"""Searches within the tasks of a graph's parts, against loops and against the rounds of joins."""

import random

import pytest

from factweave.operators import association, graph, parts
from factweave.plans import association_queries, graph_queries


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def accesses(spark, monkeypatch, edges, sources=()):
    """Has the queries read these edges (src, dst, kind) and sources (function_id, source_id), and fail where they walk in rounds of joins."""
    cost = {"CHANNEL_WRITE": 0, "CHANNEL_READ": 1}
    e = spark.createDataFrame([(a, b, k, cost[k], a.split("|")[0]) for a, b, k in edges], "src string, dst string, kind string, cost int, binary_sha256 string")
    s = spark.createDataFrame([(*f.split("|"), i) for f, i in sources], "binary_sha256 string, function_id string, source_id string")
    monkeypatch.setattr(graph_queries, "access_graph", lambda spark, d: e)
    monkeypatch.setattr(graph_queries, "table", lambda spark, d, t: s)
    for name in ("min_hops", "reachable", "backward_search"):
        monkeypatch.setattr(graph_queries.graph, name, lambda *a, **k: pytest.fail("walked in rounds"))
    return e, s


def hot(seed):
    """A part with more searches than a slice has, and small ones."""
    rng = random.Random(seed)
    e = {("hot|f%d" % rng.randrange(560), "hot|o%d" % rng.randrange(60), "CHANNEL_WRITE") for _ in range(500)} | {("hot|o%d" % rng.randrange(60), f"hot|f{n}", "CHANNEL_READ") for n in range(560)}
    for p in ("", "p", "q"):
        e |= {(f"{p}|{rng.randrange(4)}", f"{p}|{rng.randrange(4)}", rng.choice(["CHANNEL_WRITE", "CHANNEL_READ"])) for _ in range(7)}
    return sorted(e)


def within(edges, most):
    """{search: {node: hops}} of a loop over 0-1 costs against the edges."""
    into = {}
    for a, b, k in edges:
        into.setdefault(b, []).append((a, int(k == "CHANNEL_READ")))
    found = {}
    for s in {b for _, b, k in edges if k == "CHANNEL_READ"}:
        best, todo = {s: 0}, [s]
        while todo:
            x = todo.pop(0)
            for a, c in into.get(x, []):
                if best[x] + c <= most and best[x] + c < best.get(a, most + 1):
                    best[a] = best[x] + c
                    todo.append(a)
        found[s] = best
    return found


def test_hops_of_a_hot_part(spark, monkeypatch):
    edges = hot(1)
    accesses(spark, monkeypatch, [*edges, edges[0]])
    want = [(s, n, h) for s, best in within(edges, graph.MAX_HOPS).items() for n, h in best.items()]
    assert len({s for s, _, _ in want}) > parts.SLICE and len(want) > parts.BLOCK
    assert rows(graph_queries.g1_reach_hops(spark, ""), "search", "node", "hops") == sorted(want, key=str)


def test_hops_end_at_their_budget(spark, monkeypatch):
    chain = [x for n in range(12) for x in ((f"b|f{n}", f"b|o{n}", "CHANNEL_WRITE"), (f"b|o{n}", f"b|f{n + 1}", "CHANNEL_READ"))]
    accesses(spark, monkeypatch, chain)
    got = [r for r in rows(graph_queries.g1_reach_hops(spark, ""), "search", "node", "hops") if r[0] == "b|f12"]
    assert sorted(got, key=lambda r: (r[2], r[1])) == [("b|f12", "b|f12", 0), *(("b|f12", f"b|{x}{12 - n}", n) for n in range(1, 9) for x in "fo")]


def test_reach_of_a_hot_part(spark, monkeypatch):
    # longer than the rounds of joins have a budget for
    chain = [x for n in range(600) for x in ((f"c|f{n}", f"c|o{n}", "CHANNEL_WRITE"), (f"c|o{n}", f"c|f{n + 1}", "CHANNEL_READ"))]
    edges = hot(2) + [x for x in chain if x[1] in ("c|f1", "c|f2") or x[2] == "CHANNEL_WRITE"] + [(a.replace("f", "g"), b.replace("f", "g"), "CHANNEL_WRITE") for a, b, k in chain]
    edges += [("c|z", "c|g0", "CHANNEL_READ")]
    accesses(spark, monkeypatch, edges)
    out, want = {}, []
    for a, b, _ in edges:
        out.setdefault(a, set()).add(b)
    for s in {b for _, b, k in edges if k == "CHANNEL_READ"}:
        seen, todo = set(), [s]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += out.get(x, ())
        want += [(s, x) for x in seen]
    assert sum(s == "c|g0" for s, _ in want) > 1000
    assert rows(graph_queries.g2_reachable(spark, ""), "start", "node") == sorted(want, key=str)


def test_edges_of_a_hot_part(spark, monkeypatch):
    edges = hot(3)
    accesses(spark, monkeypatch, edges)
    want = [(s, *e) for s, best in within(edges, graph.MAX_HOPS).items() for e in edges if e[1] in best]
    assert rows(graph_queries.g1_allowed_edges(spark, ""), "search", "src", "dst", "kind") == sorted(want, key=str)


def backward(spark, monkeypatch):
    """What the rounds of joins give for parts with sources, leaves and a chain past the budget; the queries read the same."""
    chain = [x for n in range(20) for x in ((f"c|f{n}", f"c|o{n}", "CHANNEL_WRITE"), (f"c|o{n}", f"c|f{n + 1}", "CHANNEL_READ"))]
    edges = [x for x in hot(4) if not x[0].startswith("hot")] + chain + [("const:x|f", "const:x|o", "CHANNEL_WRITE"), ("const:x|o", "const:x|g", "CHANNEL_READ"), ("b|f", "b|o", "CHANNEL_WRITE"), ("b|o", "b|g", "CHANNEL_READ")]
    sources = [("p|1", "s2"), ("p|1", "s1"), ("c|f2", "s3"), ("q|nowhere", "s4"), ("|2", "s5")]
    walk = graph.backward_search
    accesses(spark, monkeypatch, edges, sources)
    with monkeypatch.context() as m:
        m.setattr(graph, "backward_search", walk)
        paths, _, blockers = graph_queries._backward(spark, "")
    return paths.selectExpr("search", "value", "source", "size(steps) AS steps"), blockers


def test_paths_within_parts_are_those_of_rounds(spark, monkeypatch):
    want = rows(backward(spark, monkeypatch)[0], "search", "value", "source", "steps")
    assert ("c|f15", "c|f2", "s3", 26) in want
    assert rows(graph_queries.g7_backward_paths(spark, ""), "search", "value", "source", "steps") == want


def test_blockers_within_parts_are_those_of_rounds(spark, monkeypatch):
    want = rows(backward(spark, monkeypatch)[1], "search", "value", "reason")
    assert ("b|g", "b|f", "unmodeled_origin") in want and ("c|f20", "c|f4", "search_budget_exhausted") in want
    assert rows(graph_queries.g7_blockers(spark, ""), "search", "value", "reason") == want


def test_associations_within_parts_are_those_of_rounds(spark, monkeypatch):
    rng = random.Random(6)
    n = lambda k: rng.randrange(k)
    access = "function string, atom string, object string, start bigint, end bigint, may int, site string"
    made = lambda: [(f"b|f{n(4)}", f"v{n(3)}", f"b|o{n(4)}", s, s if s < 0 else s + 1 + n(6), n(2), "s") for s in rng.choices([-1, 0, 3, 6], k=14)]
    writes, reads = made(), made()
    seeds = [(f"L{n(6)}", *rng.choice([("VALUE", f"b|f{n(4)}", f"v{n(3)}", None), ("MEMORY_CONTENT", f"b|f{n(4)}", None, f"b|o{n(4)}")])) for _ in range(12)] + [("L0", "VALUE", 'c|"|x', "1", None)]
    w, r = spark.createDataFrame([*writes, ('c|"|x', "1", "c|\\|y", 0, 4, 0, "s")], access), spark.createDataFrame([*reads, ("c|z", "é", "c|\\|y", 2, 3, 0, "s")], access)
    none = lambda shape: spark.createDataFrame([], shape)
    flows = association.Flows(
        moves=none("function string, atom string, to_function string, to_atom string, mnemonic string, site string"), merges=none("function string, to_atom string, atom string"), loads=none("function string, address_atom string, atom string, site string"),
        writes=w, reads=r, outputs=none("function string, atom string, caller string, actual_atom string, object string, start bigint, end bigint, may int, site string"),
        copies=none("source string, function string, atom string, object string, start bigint, end bigint, may int, site string"), actuals=none("root string, function string, atom string, object string, site string"),
    )
    s = spark.createDataFrame(sorted(set(seeds), key=str), "lineage string, state string, function string, atom string, object string")
    columns = ["lineage", "state", "function", "atom", "object", "start", "end", "may"]
    want = rows(association.associate(flows, s).rows, *columns)
    assert {x[-1] for x in want} == {0, 1} and ("L0", "VALUE", "c|z", "é", "", -1, -1, 0) in want
    monkeypatch.setattr(association_queries, "_inputs", lambda spark, d: (flows, s))
    monkeypatch.setattr(association, "associate", lambda *a: pytest.fail("walked in rounds"))
    assert rows(association_queries.g5_rule_associations(spark, ""), *columns) == want
