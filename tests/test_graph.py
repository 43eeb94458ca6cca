import json
import random

import pytest
from pyspark.sql import functions as F

from factweave.operators import cfg, graph
from factweave.plans import graph_queries


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def random_edges(rng, n, m):
    return sorted({(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}", rng.randint(0, 1)) for _ in range(m)})


def test_min_hops_against_shortest_paths(spark):
    rng = random.Random(1)
    for _ in range(3):
        edges = random_edges(rng, 12, 24)
        got = graph.min_hops(spark.createDataFrame(edges, "src string, dst string, cost int"), spark.createDataFrame([("s", "n0")], "search string, node string"), 2)
        best = {"n0": 0}
        for _ in range(40):
            for a, b, c in edges:
                if b in best and best[b] + c <= 2 and best[b] + c < best.get(a, 99):
                    best[a] = best[b] + c
        assert got.complete and rows(got.rows, "node", "hops") == sorted(best.items())


def test_a_budget_is_reported(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(9)], "src string, dst string")
    starts = spark.createDataFrame([("n0",)], "start string")
    cut, whole = graph.reachable(edges, starts, 3), graph.reachable(edges, starts)
    assert (cut.complete, cut.rows.count(), whole.complete, whole.rows.count()) == (False, 4, True, 10)


def test_provenance_unions_and_intersections(spark):
    rng = random.Random(4)
    data = [(f"v{o}", f"v{rng.randrange(o)}", mode) for o in range(3, 25) for mode in [rng.choice(["any", "all"])] for _ in range(2)]
    modes = {}
    data = [(o, i, modes.setdefault(o, m)) for o, i, m in data]
    seeds = [("v0", "A"), ("v1", "B"), ("v2", "A"), ("v2", "B")]
    got = graph.value_provenance(spark.createDataFrame([(*x, False) for x in data] + [("v5", "c", modes["v5"], True)], "output string, input string, mode string, constant boolean"), spark.createDataFrame(seeds, "value string, label string"))
    have = {}
    for v, lab in seeds:
        have.setdefault(v, set()).add(lab)
    for _ in range(30):
        for o in modes:
            ins = [have.get(i, set()) for i in {i for x, i, _ in data if x == o}]
            have.setdefault(o, set()).update(set.union(*ins) if modes[o] == "any" else set.intersection(*ins))
    assert got.complete and rows(got.rows, "value", "label") == sorted((v, x) for v, s in have.items() for x in s)


def test_associations_are_dominated_and_stop_at_the_depth(spark):
    t = spark.createDataFrame([("VALUE", "a", "MEMORY_CONTENT", "o", 0, 1), ("VALUE", "a", "MEMORY_CONTENT", "o", 1, 0), ("MEMORY_CONTENT", "o", "VALUE", "b", 1, 0)], "src_state string, src string, dst_state string, dst string, hop int, may int")
    seeds = lambda d: spark.createDataFrame([("L", "VALUE", "a", d, 0)], "lineage string, state string, node string, depth int, may int")
    done, over, complete = graph.associate(seeds(0), t)
    assert complete and rows(done, "state", "node", "depth", "may") == [("MEMORY_CONTENT", "o", 0, 1), ("VALUE", "a", 0, 0), ("VALUE", "b", 1, 1)] and over.count() == 0
    done, over, _ = graph.associate(seeds(9), t)
    assert done.count() == 0 and rows(over, "depth", "reason") == [(9, "source_association_channel_depth_limit_reached")]


def test_backward_search_stops_at_sources_and_tells_why_not(spark):
    definitions = [("sink", "m", "LOAD", "s1", False), ("m", "w1", "WRITE", "s2", False), ("m", "const:0:1", "WRITE", "s3", False), ("m", "w2", "WRITE", "s4", False), ("w1", "deep", "COPY", "s5", False)]
    d = spark.createDataFrame(definitions, "value string, input string, rule string, site string, constant boolean")
    s = spark.createDataFrame([("w1", "SRC"), ("deep", "NEVER")], "value string, source string")
    paths, leaves, blockers = graph.backward_search(d, s, spark.createDataFrame([("q", "sink")], "search string, value string"))
    assert rows(paths, "source", "steps") == [("SRC", ["LOAD:s1", "WRITE:s2"])]
    assert rows(leaves, "value") == [("const:0:1",)] and rows(blockers, "value", "reason") == [("w2", "unmodeled_origin")]


def test_status_lattices(spark):
    d, h, i, g = "SOURCE_REACHED_DETERMINISTIC", "SOURCE_REACHED_HEURISTIC", "PROVEN_INTERNAL_ONLY", "GRAPH_INCOMPLETE"
    cases = {"a": [d, g], "b": [i, i], "c": [h, i], "d": [i, g], "e": [d, i], "f": ["ANALYSIS_BUDGET_EXHAUSTED", g], "g": [d, h], "h": [i, "SOURCE_NOT_RESOLVED"]}
    df = spark.createDataFrame([(k, s) for k, v in cases.items() for s in v], "k string, s string")
    got = rows(df.groupBy("k").agg(graph.chain_status_strict(F.col("s")).alias("x"), graph.chain_status_all(F.col("s")).alias("y")), "k", "x", "y")
    assert got == [
        ("a", d, "PARTIAL_SOURCE_REACHABILITY"), ("b", i, i), ("c", h, h), ("d", g, g), ("e", d, d), ("f", "ANALYSIS_BUDGET_EXHAUSTED", g), ("g", d, h), ("h", g, "SOURCE_NOT_RESOLVED"),
    ]


def test_indirect_targets_are_never_cut_off(spark):
    c = spark.createDataFrame([("s", 1, "f"), ("s", 0, None), ("t", 0, "f"), ("t", 0, "g"), ("t", 1, "h"), *[("u", 0, f"f{i}") for i in range(40)]], "site string, strategy int, target string")
    assert rows(graph.indirect_targets(c, "site", "target", "strategy"), "site", "strategy", "resolution", "targets") == [("s", 1, "resolved", ["f"]), ("t", 0, "ambiguous", ["f", "g"]), ("u", 0, "unresolved", [])]


def test_tables_are_enumerated_whole_or_not(spark):
    t = spark.createDataFrame([(100, 1), (104, 2), (108, 2)], "address bigint, value bigint")
    look = spark.createDataFrame([("a", 100, 4, 3), ("b", 100, 4, 4), ("c", 100, 4, 0), ("d", 100, 4, 300)], "id string, base bigint, stride bigint, count int")
    assert rows(graph.enumerate_table(look, t), "id", "values", "resolution") == [("a", [1, 2], "resolved"), ("b", None, "unresolved"), ("c", None, "unresolved"), ("d", None, "unresolved")]


def test_wrappers_need_all_roles(spark):
    p = spark.createDataFrame([("memcpy", "COPY", {"dst": 0, "len": 2})], "function string, label string, roles map<string,int>")
    calls = spark.createDataFrame(
        [("s1", "w1", "memcpy", {0: 1, 2: 0}, True), ("s2", "w2", "w1", {1: 0, 0: 3}, True), ("s3", "bad", "memcpy", {0: 0}, True), ("s4", "loop", "memcpy", {0: 0, 2: 1}, False)],
        "site string, caller string, callee string, slots map<int,int>, linear boolean",
    )
    got = graph.wrapper_summaries(p, calls)
    assert rows(got, "function", "depth") == [("memcpy", 0), ("w1", 1), ("w2", 2)]
    sites = spark.createDataFrame([("c1", "main", "w2", ["A", "B", "C", "D"])], "site string, caller string, callee string, arguments array<string>")
    assert rows(graph.instantiate(got, sites), "role", "actual") == [("dst", "A"), ("len", "D")]


def test_lineage_budget(spark):
    i = spark.createDataFrame([(f"v{n}", f"v{n + 1}", "COPY") for n in range(9)] + [("v0", "x", "CALL")], "output string, input string, mnemonic string")
    out = graph.bounded_lineage(i, spark.createDataFrame([("v0",), ("v7",)], "start string"), ["COPY"], 4)
    assert rows(out, "start", "value", "truncated") == [("v0", f"v{n}", True) for n in range(4)] + [("v7", f"v{n}", False) for n in (7, 8, 9)]


def reach(edges, entry, without=None):
    seen, todo = set(), [entry] if entry != without else []
    while todo:
        b = todo.pop()
        if b not in seen:
            seen.add(b)
            todo += [d for s, d in edges if s == b and d != without]
    return seen


def test_dominators_and_loops_against_node_removal(spark):
    rng = random.Random(6)
    data, graphs = [], {}
    for g in range(25):
        edges = sorted({(f"b{rng.randrange(7)}", f"b{rng.randrange(7)}") for _ in range(10)} | {("b0", "b1")})
        graphs[g] = edges
        data += [(g, a, b, "b0") for a, b in edges]
    df = spark.createDataFrame(data, "g int, src string, dst string, entry string")
    want, loops = set(), set()
    for g, edges in graphs.items():
        live = reach(edges, "b0")
        dom = {b: {d for d in live if b not in reach(edges, "b0", d)} for b in live}
        want |= {(g, b, d) for b in live for d in dom[b]}
        heads = {}
        for t, h in edges:
            if t in live and h in dom[t]:
                body = {h} | {b for b in {x for e in edges for x in e} if b != h and t != h and t in reach([e for e in edges if e[1] != h], b, h)}
                heads.setdefault(h, set()).update(body)
        loops |= {(g, h, ",".join(sorted(b))) for h, b in heads.items()}
    assert rows(cfg.dominators(df, ["g"], "entry"), "g", "block", "dominator") == sorted(want, key=str)
    assert rows(cfg.natural_loops(df, ["g"], "entry"), "g", "header", F.array_join("blocks", ",")) == sorted(loops, key=str)


def test_recurrences(spark):
    shape = "f int, output string, input string, pos int, mnemonic string, constant bigint"
    data = [
        (1, "i", "zero", 0, "MULTIEQUAL", None), (1, "i", "i2", 1, "MULTIEQUAL", None), (1, "c", "i", 0, "COPY", None), (1, "i2", "c", 0, "INT_ADD", None), (1, "i2", "4", 1, "INT_ADD", 4),
        (2, "j", "a", 0, "MULTIEQUAL", None), (2, "j", "b", 1, "MULTIEQUAL", None),
        (3, "k", "n", 0, "MULTIEQUAL", None), (3, "k", "k2", 1, "MULTIEQUAL", None), (3, "k2", "k", 0, "INT_SUB", None), (3, "k2", "1", 1, "INT_SUB", 1),
        (4, "m", "n", 0, "MULTIEQUAL", None), (4, "m", "m2", 1, "MULTIEQUAL", None), (4, "m2", "1", 0, "INT_SUB", 1), (4, "m2", "m", 1, "INT_SUB", None),
    ]
    got = rows(cfg.recurrences(spark.createDataFrame(data, shape), ["f"]), "f", "phi", "initial", "update", "step")
    assert got == [(1, "i", "zero", "i2", 4), (3, "k", "n", "k2", -1)]


def test_branch_gates_and_exclusive_arms(spark):
    e = spark.createDataFrame([(1, "a", "b"), (1, "a", "c"), (1, "b", "t"), (1, "c", "x"), (2, "a", "b"), (2, "a", "c"), (2, "b", "t"), (2, "c", "t"), (3, "a", "b"), (3, "a", "c"), (3, "b", "c")], "f int, src string, dst string")
    assert rows(cfg.branch_gates(e, spark.createDataFrame([(1, "t"), (2, "t")], "f int, target string"), ["f"]), "f", "branch", "target") == [(1, "a", "t")]
    pairs = spark.createDataFrame([(1, "b", "c"), (3, "b", "c"), (1, "b", "x")], "f int, left string, right string")
    assert rows(cfg.exclusive_arms(e, pairs, ["f"]), "f", "left", "right") == [(1, "b", "c")]


def test_affine_terms(spark):
    shape = "f int, output string, input string, pos int, mnemonic string, constant bigint"
    data = [
        (1, "a", "b", 0, "INT_ADD", None), (1, "a", "m", 1, "INT_ADD", None), (1, "m", "i", 0, "INT_MULT", None), (1, "m", "4", 1, "INT_MULT", 4),
        (1, "b", "base", 0, "INT_ADD", None), (1, "b", "8", 1, "INT_ADD", 8), (1, "base", "q", 0, "LOAD", None), (1, "s", "a", 0, "INT_SUB", None), (1, "s", "i", 1, "INT_SUB", None),
    ]
    got = cfg.affine_terms(spark.createDataFrame(data, shape), spark.createDataFrame([(1, "a"), (1, "s")], "f int, root string"), ["f"])
    assert rows(got, "root", "node", "stride", "offset") == [("a", "base", 1, 8), ("a", "i", 4, 0), ("s", "base", 1, 8), ("s", "i", 3, 0)]


def test_every_reading_function_is_searched(spark, monkeypatch):
    e = [("b|f1", "b|o", "CHANNEL_WRITE", 0), ("b|o", "b|f2", "CHANNEL_READ", 1), ("b|o", "b|f3", "CHANNEL_READ", 1), ("b|f3", "b|p", "CHANNEL_WRITE", 0), ("b|p", "b|f4", "CHANNEL_READ", 1)]
    edges = spark.createDataFrame([(*x, "b") for x in e], "src string, dst string, kind string, cost int, binary_sha256 string")
    monkeypatch.setattr(graph_queries, "access_graph", lambda spark, d: edges)
    sources = spark.createDataFrame([("ACCEPT_HEURISTIC", "b", "none", "s")], "decision string, binary_sha256 string, function_id string, source_id string")
    monkeypatch.setattr(graph_queries, "table", lambda spark, d, t: sources)
    starts = {f"b|f{n}" for n in (2, 3, 4)}

    def walk(start, forward=False):
        seen, todo = set(), [start]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += [(b if forward else a) for a, b, _, _ in e if (a if forward else b) == x]
        return seen

    want = sorted((s, x) for s in starts for x in walk(s))
    assert rows(graph_queries.g1_reach_hops(spark, ""), "search", "node") == want
    assert rows(graph_queries.g1_allowed_edges(spark, ""), "search", "src", "dst") == sorted((s, a, b) for s in starts for a, b, _, _ in e if b in walk(s))
    assert rows(graph_queries.g2_reachable(spark, ""), "start", "node") == sorted((s, x) for s in starts for x in walk(s, True))
    assert rows(graph_queries.g7_blockers(spark, ""), "search", "value") == sorted((s, "b|f1") for s in starts)


def test_provenance_of_a_long_history(spark, monkeypatch):
    rng = random.Random(8)
    events = [(n, u, n, rng.choice(["signup", "error"]) if n % 60 == u else rng.choice(["view", "view", "purchase"])) for u in (1, 2) for n in range(100 * u, 100 * u + 90)]
    monkeypatch.setattr(graph_queries, "table", lambda spark, d, t: spark.createDataFrame(events, "event_id bigint, user_id bigint, ts bigint, event_type string"))
    have = {}
    for n, u, _, kind in events:
        ins = [have[i] for i in (n - 1, n - 2) if i >= 100 * u]
        have[n] = ({kind} if kind in ("signup", "error") else set()) | ((set.intersection if kind == "purchase" else set.union)(*ins) if ins else set())
    want = sorted(((n, x) for n, s in have.items() for x in s), key=str)
    assert len(want) > 60 and rows(graph_queries.g4_value_provenance(spark, ""), "value", "label") == want


def test_every_lineage_of_the_facts(spark, monkeypatch):
    value = lambda v: {"value_id": v, "space": "register"}

    def fn(name, *calls, returns=False):
        ops = [{"site_id": f"s{n}", "mnemonic": "CALL", "output": value(f"o{n}"), "call": {"kind": "CALL", "target_function_id": c, "argument_value_ids": a}} for n, (c, a) in enumerate(calls)]
        return {"function_id": name, "pcode_ops": ops + [{"site_id": "r", "mnemonic": "RETURN", "inputs": [value("v")]}] * returns}

    doc = {"functions": [fn("a", ("b", ["x"]), ("h", [])), fn("b", ("c", ["x"])), fn("c"), fn("h", ("i", []), returns=True), fn("i", ("j", []), ("k", []), returns=True), fn("j", returns=True), fn("k")]}
    monkeypatch.setattr(graph_queries, "table", lambda spark, d, t: spark.createDataFrame([(1, json.dumps(doc))], "record_id bigint, facts string"))
    passed, helped = {("a", "b"), ("b", "c")}, {("a", "h"), ("h", "i"), ("i", "j")}
    want = {}
    for s in "abchijk":
        best = {s: 0}
        for _ in range(9):
            for edges, cost in ((passed, 0), (helped, 1)):
                for x, y in edges:
                    if x in best and best[x] + cost <= 2:
                        best[y] = min(best[x] + cost, best.get(y, 9))
        want |= {(f"1|{s}", f"1|{n}"): h for n, h in best.items()}
    assert rows(graph_queries.g14_every_lineage(spark, ""), "lineage", "node", "helpers") == sorted(((*k, h) for k, h in want.items()), key=str)


def test_wrappers_of_the_facts_pass_their_formals_on(spark, monkeypatch):
    node = lambda v, obj: {"value_id": v, "object_id": obj, "space": "register"}

    def fn(name, *ops):
        return {"function_id": name, "parameters": [{"index": n, "object_id": f"param:{name}:{n}"} for n in (0, 1)], "pcode_ops": list(ops)}

    def call(site, target, *arguments):
        nodes = [node(v, o) for v, o in arguments]
        return {"site_id": site, "mnemonic": "CALL", "inputs": nodes, "call": {"kind": "CALL", "target_function_id": target, "argument_value_ids": [v for v, _ in arguments]}}

    x, y, local = ("x", "param:f:1"), ("y", "param:f:0"), ("l", "register:1")
    copied = {"site_id": "c", "mnemonic": "COPY", "inputs": [node(*y)], "output": node("t", "unique:1")}
    doc = {"functions": [
        fn("wrap", call("1", "prim", x, y)), fn("upper", copied, call("2", "wrap", x, ("t", "unique:1"))), fn("half", call("3", "prim", x, local)),
        fn("none", call("4", "prim", local, local)), fn("two", call("5", "prim", x, y), call("6", "", x)), fn("branch", {"site_id": "b", "mnemonic": "CBRANCH"}, call("7", "prim", x, y)),
    ]}
    monkeypatch.setattr(graph_queries, "table", lambda spark, d, t: spark.createDataFrame([(1, json.dumps(doc))], "record_id bigint, facts string"))
    want = [("1|prim", "1|prim", 0), ("1|upper", "1|prim", 2), ("1|upper", "1|wrap", 1), ("1|wrap", "1|prim", 1), ("1|wrap", "1|wrap", 0)]
    assert rows(graph_queries.g16_wrapper_summaries(spark, ""), "function", "label", "depth") == want


def test_long_channels_are_not_cut_off_unseen(spark, monkeypatch):
    hops = [("VALUE", f"f{n}", "MEMORY_CONTENT", f"o{n}", 0, 0) for n in range(12)] + [("MEMORY_CONTENT", f"o{n}", "VALUE", f"f{n + 1}", 1, 0) for n in range(12)]
    moves = spark.createDataFrame(hops, "src_state string, src string, dst_state string, dst string, hop int, may int")
    seeds = spark.createDataFrame([("L", "VALUE", "f0", 0, 0)], "lineage string, state string, node string, depth int, may int")
    monkeypatch.setattr(graph_queries, "_association_inputs", lambda spark, d: (seeds, moves))
    with pytest.raises(RuntimeError, match="ANALYSIS_BUDGET_EXHAUSTED"):
        graph_queries.g6_alternating_channels(spark, "")
    assert rows(graph_queries.g5_depth_rejects(spark, ""), "node", "depth") == [("f9", 9)]
