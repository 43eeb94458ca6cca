"""Associations by rules against cases and against a loop."""

import random

import pytest

from factweave.operators import association as a

SHAPES = {
    "moves": "function string, atom string, to_function string, to_atom string, mnemonic string, site string",
    "merges": "function string, to_atom string, atom string",
    "loads": "function string, address_atom string, atom string, site string",
    "writes": "function string, atom string, object string, start bigint, end bigint, may int, site string",
    "reads": "function string, atom string, object string, start bigint, end bigint, may int, site string",
    "outputs": "function string, atom string, caller string, actual_atom string, object string, start bigint, end bigint, may int, site string",
    "copies": "source string, function string, atom string, object string, start bigint, end bigint, may int, site string",
    "actuals": "root string, function string, atom string, object string, site string",
}
SEED = "lineage string, state string, function string, atom string, object string, start bigint, end bigint, pointee string, depth int, may int"


def flows(spark, rows):
    return a.Flows(**{n: spark.createDataFrame(rows.get(n, []), s) for n, s in SHAPES.items()})


def seed(lineage="S", state="VALUE", function="f", atom="v", obj="", start=-1, end=-1, pointee="", depth=0, may=0):
    return lineage, state, function, atom, obj, start, end, pointee, depth, may


def run(spark, rows, seeds, how=a.associate, **kw):
    found = how(flows(spark, rows), spark.createDataFrame(seeds, SEED), **kw)
    return found, {tuple(r[c] for c in a.KEYS): (r.depth, r.may) for r in found.rows.collect()}


def test_a_copy_and_a_store_reach_memory(spark):
    rows = {"moves": [("a", "source", "a", "copied", "COPY", "s1")], "writes": [("a", "copied", "obj:ram:20000000", 0, 4, 0, "s2")]}
    found, got = run(spark, rows, [seed(function="a", atom="source")])
    assert ("S", "MEMORY_CONTENT", "a", "copied", "obj:ram:20000000", 0, 4, "") in got and len(got) == 3
    assert {r.relation for r in found.rows.filter("state = 'MEMORY_CONTENT'").collect()} == {"CONCRETE_STORE_VALUE"}
    assert found.rejects.count() == 0 and found.complete


def test_past_the_depth_limit_is_a_reject(spark):
    found, got = run(spark, {}, [seed(depth=9)])
    assert not got and [r.reason for r in found.rejects.collect()] == ["source_association_channel_depth_limit_reached"]


def test_a_reference_does_not_cross_a_comparison_and_merges_must_agree(spark):
    rows = {
        "moves": [("f", "v", "f", "flag", "INT_EQUAL", "s1"), ("f", "v", "f", "p", "PTRADD", "s2"), ("f", "p", "f", "m", "MULTIEQUAL", "s3"), ("f", "q", "f", "m", "MULTIEQUAL", "s3")],
        "merges": [("f", "m", "p"), ("f", "m", "q")], "loads": [("f", "p", "loaded", "s4")],
    }
    ref = seed(state="OBJECT_REFERENCE", pointee="o")
    _, got = run(spark, rows, [ref])
    assert {k[3] for k in got} == {"v", "p", "loaded"}
    _, got = run(spark, rows, [ref, seed(state="OBJECT_REFERENCE", atom="q", pointee="o")])
    assert {k[3] for k in got} == {"v", "p", "loaded", "q", "m"}
    _, got = run(spark, rows, [ref, seed(state="OBJECT_REFERENCE", atom="q", pointee="other")])
    assert "m" not in {k[3] for k in got}
    _, got = run(spark, rows, [seed()])
    assert {(k[3], v[1]) for k, v in got.items()} == {("v", 0), ("flag", 0), ("p", 0), ("m", 0), ("loaded", 1)}


def test_memory_is_read_copied_and_passed(spark):
    content = seed(state="MEMORY_CONTENT", atom="", obj="o", start=0, end=4)
    rows = {
        "reads": [("g", "near", "o", 2, 6, 0, "r1"), ("g", "far", "o", 8, 9, 0, "r2"), ("g", "any", "o", -1, -1, 0, "r3")],
        "copies": [("o", "h", "dst", "o2", 0, 8, 1, "c")], "actuals": [("o", "k", "arg", "o", "x")], "outputs": [("g", "near", "main", "act", "o3", 0, 1, 0, "y")],
    }
    _, got = run(spark, rows, [content])
    small = {(k[1], k[3], k[4], k[7]): v[1] for k, v in got.items()}
    assert small == {
        ("MEMORY_CONTENT", "", "o", ""): 0, ("VALUE", "near", "", ""): 0, ("VALUE", "any", "", ""): 1, ("MEMORY_CONTENT", "dst", "o2", ""): 1, ("OBJECT_REFERENCE", "arg", "o", "o"): 0, ("MEMORY_CONTENT", "act", "o3", ""): 0,
    }


def test_channels_alternate_until_nothing_grows(spark):
    rows = {"writes": [(f"f{i}", f"v{i}", f"o{i}", 0, 4, 0, f"w{i}") for i in range(4)], "reads": [(f"f{i + 1}", f"v{i + 1}", f"o{i}", 0, 4, 0, f"r{i}") for i in range(4)]}
    found, got = run(spark, rows, [seed(function="f0", atom="v0")], a.alternate)
    depths = {k[3]: v[0] for k, v in got.items() if k[1] == "OBJECT_REFERENCE" and k[4] == k[7]}
    assert found.complete and depths["v1"] == 1 and "v4" in depths
    found, _ = run(spark, rows, [seed(function="f0", atom="v0")], a.alternate, max_depth=0)
    assert found.rejects.count() > 0
    assert not run(spark, rows, [seed(function="f0", atom="v0")], a.alternate, outer=1)[0].complete
    assert not run(spark, rows, [seed(function="f0", atom="v0")], rounds=1)[0].complete


def brute(rows, seeds, max_depth=8):
    get = lambda n: rows.get(n, [])
    best = {}
    work = []

    def add(key, cost):
        if key not in best or cost < best[key]:
            best[key] = cost
            work.append(key)

    for s in seeds:
        if s[8] <= max_depth:
            add(s[:8], s[8:])
    while work:
        # whenever anything changes all states are looked at again
        work.clear()
        for key in list(best):
            line, state, fn, at, obj, s, e, pointee = key
            depth, may = best[key]
            if state != "MEMORY_CONTENT" and fn and at:
                for m in get("moves"):
                    if m[:2] == (fn, at):
                        if state == "OBJECT_REFERENCE" and m[4] == "MULTIEQUAL":
                            needed = [x[2] for x in get("merges") if x[:2] == (m[0], m[3])]
                            if not pointee or not needed or any(not any(k[0] == line and k[1] == "OBJECT_REFERENCE" and k[2] == fn and k[3] == n and k[7] == pointee for k in best) for n in needed):
                                continue
                        elif state == "OBJECT_REFERENCE" and m[4] not in a.REFERENCE_OPERATIONS:
                            continue
                        add((line, state, m[2], m[3], "", -1, -1, pointee), (depth, may))
                for x in get("loads"):
                    if x[:2] == (fn, at):
                        add((line, "VALUE", fn, x[2], "", -1, -1, ""), (depth, may if state == "OBJECT_REFERENCE" else 1))
                kept = "OBJECT_REFERENCE" if state == "OBJECT_REFERENCE" else "MEMORY_CONTENT"
                for w in get("writes"):
                    if w[:2] == (fn, at):
                        add((line, kept, fn, at, w[2], w[3], w[4], pointee), (depth, max(may, w[5])))
                for o in get("outputs"):
                    if o[:2] == (fn, at) and o[4]:
                        add((line, kept, o[2], o[3], o[4], o[5], o[6], pointee), (depth, max(may, o[7])))
            if state != "VALUE":
                roots = {obj, pointee} - {""}
                for r in get("reads"):
                    known = min(s, e, r[3], r[4]) >= 0
                    if state == "MEMORY_CONTENT" and r[2] in roots and r[1] and not (known and not (s < r[4] and r[3] < e)):
                        add((line, "VALUE", r[0], r[1], "", -1, -1, ""), (depth, max(may, r[5], 0 if known else 1)))
                for c in get("copies"):
                    if c[0] in roots and c[3] and c[2]:
                        add((line, "MEMORY_CONTENT", *c[1:6], ""), (depth, max(may, c[6])))
                for x in get("actuals"):
                    if state == "MEMORY_CONTENT" and x[0] in roots:
                        add((line, "OBJECT_REFERENCE", x[1], x[2], x[3], -1, -1, obj or pointee), (depth, may))
    return best


@pytest.mark.parametrize("number", range(3))
def test_against_a_loop(spark, number):
    rng = random.Random(number)
    fn, at, ob = (lambda: rng.choice("fg")), (lambda: rng.choice(["v0", "v1", "v2", "v3", "v4"])), (lambda: rng.choice(["o1", "o2"]))
    span = lambda: rng.choice([(0, 4), (4, 8), (-1, -1)])
    may = lambda: rng.randint(0, 1)
    moves = [(fn(), at(), fn(), at(), rng.choice(["COPY", "INT_ADD", "MULTIEQUAL"]), f"m{i}") for i in range(5)]
    rows = {
        "moves": moves, "merges": [(m[0], m[3], x) for m in moves if m[4] == "MULTIEQUAL" for x in {m[1], at()}],
        "loads": [(fn(), at(), at(), f"l{i}") for i in range(2)], "writes": [(fn(), at(), ob(), *span(), may(), f"w{i}") for i in range(2)],
        "reads": [(fn(), at(), ob(), *span(), may(), f"r{i}") for i in range(2)], "outputs": [(fn(), at(), fn(), at(), ob(), *span(), may(), "o")],
        "copies": [(ob(), fn(), at(), ob(), *span(), may(), "c")], "actuals": [(ob(), fn(), at(), ob(), "a")],
    }
    seeds = [seed("A", "VALUE", fn(), at()), seed("B", "OBJECT_REFERENCE", fn(), at(), "", pointee="o1", may=1), seed("B", "OBJECT_REFERENCE", fn(), at(), "", pointee="o1"), seed("C", "MEMORY_CONTENT", fn(), "", ob(), *span(), depth=2)]
    assert run(spark, rows, seeds)[1] == brute(rows, seeds)
