"""What stores and reads carry on, within tasks: against loops, against SQL, and where stores times reads are many."""

import random

import duckdb
import pyarrow as pa
import pytest

from factweave.operators import association, carried, parts
from factweave.plans import association_queries

COLUMNS = ["lineage", "state", "function", "atom", "object", "start", "end", "may"]
ACCESS = "function string, atom string, object string, start bigint, end bigint, may int, site string"


def flows(spark, writes, reads):
    none = lambda shape: spark.createDataFrame([], shape)
    return association.Flows(
        moves=none("function string, atom string, to_function string, to_atom string, mnemonic string, site string"), merges=none("function string, to_atom string, atom string"), loads=none("function string, address_atom string, atom string, site string"),
        writes=spark.createDataFrame(writes, ACCESS), reads=spark.createDataFrame(reads, ACCESS), outputs=none("function string, atom string, caller string, actual_atom string, object string, start bigint, end bigint, may int, site string"),
        copies=none("source string, function string, atom string, object string, start bigint, end bigint, may int, site string"), actuals=none("root string, function string, atom string, object string, site string"),
    )


def test_many_stores_and_reads_of_one_object_stay_within_tasks(spark, monkeypatch):
    """Entries grow with stores and reads, not with their pairs: 9,000 pairs here, and parts of at most 1,000 entries."""
    writes = [("b|f", "v", "b|o", n, n + 1, 0, "s") for n in range(90)] + [("b|g", f"r{n}", "b|p", -1, -1, 1, "s") for n in range(100)]
    reads = [("b|g", f"r{n}", "b|o", -1, -1, 0, "s") for n in range(100)] + [("b|h", "w", "b|p", 4, 8, 0, "s")]
    seeds = spark.createDataFrame([("L", "VALUE", "b|f", "v", None), ("M", "MEMORY_CONTENT", "b|f", None, "b|p")], "lineage string, state string, function string, atom string, object string")
    monkeypatch.setattr(association_queries, "_inputs", lambda spark, d: (flows(spark, writes, reads), seeds))
    monkeypatch.setattr(association, "associate", lambda *a: pytest.fail("walked in rounds"))
    monkeypatch.setattr(parts, "MOST", 1000)
    got = [tuple(r) for r in association_queries.g5_rule_associations(spark, "").select(*COLUMNS).collect()]
    assert len(got) == len(set(got)) == 1 + 90 + 100 + 100 + 1 + 2
    assert ("L", "VALUE", "b|g", "r7", "", -1, -1, 1) in got and ("L", "VALUE", "b|h", "w", "", -1, -1, 1) in got and ("M", "VALUE", "b|h", "w", "", -1, -1, 1) in got


def loop(entries):
    """{(lineage, content, part, function, atom, object, start, end): may} by the rules, one state at a time."""
    best = {}
    todo = [((x, k == carried.CONTENT, p, f, v, o, -1, -1), 0) for p, k, f, v, o, _, _, _, x in entries if k >= carried.VALUE]
    while todo:
        state, may = todo.pop()
        if best.get(state, 2) <= may:
            continue
        best[state] = may
        x, content, p, f, v, o, s, e = state
        for q, k, g, w, r, t, u, m, _ in entries:
            if not content and k == carried.WRITE and (q, g, w) == (p, f, v):
                todo.append(((x, True, q, g, w, r, t, u), max(may, m)))
            if content and k == carried.READ and (q, r) == (p, o) and (min(s, e, t, u) < 0 or (s < u and t < e)):
                todo.append(((x, False, q, g, w, "", -1, -1), max(may, m, int(min(s, e, t, u) < 0))))
    return best


@pytest.mark.parametrize("size, limits", [(1000, {}), (7, {"CHUNK": 1}), (5, {"CHUNK": 40}), (50, {"BITS": 1, "PAIRS": 3}), (1000, {"BLOCK": 4}), (13, {"STATES": 2, "CHUNK": 60})])
def test_walks_are_those_of_loops(monkeypatch, size, limits):
    for name, value in limits.items():
        monkeypatch.setattr(carried, name, value)
    rng = random.Random(8)
    n = rng.randrange
    entries = []
    for p in ["a", "b", "c", "d", *(f"e{i}" for i in range(9))]:
        few = len(p) > 1
        for k in rng.choices([carried.WRITE, carried.READ], k=3 if few else 60):
            s = rng.choice([-1, n(20), n(20)])
            entries.append((p, k, f"|f{n(4)}", f"v{n(6)}", f"|o{n(4)}", s, s if s < 0 else s + 1 + rng.choice([n(3), n(15)]), n(2), ""))
        for _ in range(n(2) if few else 90 if p == "a" else 6):
            entries.append((p, carried.VALUE, f"|f{n(4)}", f"v{n(8)}", "", -1, -1, 0, f"L{n(80)}") if n(2) else (p, carried.CONTENT, f"|f{n(4)}", "", f"|o{n(5)}", -1, -1, 0, f"L{n(80)}"))
    entries += [("z", carried.READ, "|f", "v", "|o", 1, 2, 0, "")]
    shape = pa.schema([("part", pa.string()), ("what", pa.int8()), ("function", pa.string()), ("atom", pa.string()), ("object", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("may", pa.int8()), ("lineage", pa.string())])
    table = pa.Table.from_pylist([dict(zip(shape.names, e)) for e in entries], shape)
    got = {}
    for batch in carried._walked(iter(table.to_batches(max_chunksize=size))):
        for row in batch.to_pylist():
            for group in row["groups"]:
                for x in group["xs"]:
                    for y in group["ys"]:
                        state = (x, *(y[c] for c in ("content", "part", "function", "atom", "object", "start", "end")))
                        assert state not in got
                        got[state] = row["level"]
    want = loop(entries)
    assert got == want and set(want.values()) == {0, 1}


def test_repeated_deliveries_and_outputs_without_a_kind(spark, tmp_path, monkeypatch):
    rng = random.Random(9)
    n = rng.randrange
    terms = lambda: rng.choice(["NULL", "[]", "[]", "[{'selector_value_id': 'x'}]"])
    rows = []
    for i in range(240):
        at, extent = rng.choice([("NULL", "4"), (str(n(16)), str(1 + n(6))), (str(n(16)), str(n(3)))])
        rows.append(f"('e{i if n(8) else n(i + 1)}', '{rng.choice(['READ', 'WRITE'])}', 's{n(3)}', ' B{n(2)} ', 'f{n(3)}', 'p', {rng.choice(['NULL', repr(' ')] + [repr(f'o{n(4)}')] * 8)}, 'v{n(5)}', {at}, {extent}, {terms()}, TIMESTAMP '2026-01-0{1 + n(9)} 00:00:00', TIMESTAMP '2026-01-01 00:00:{10 + i % 50}')")
    outputs = lambda: "[" + ", ".join(f"{{'kind': {rng.choice(['NULL', repr('value'), repr('memory_object')])}, 'object_id': 'o{n(4)}', 'value_id': 'v{n(5)}'}}" for _ in range(2)) + "]"
    con = duckdb.connect()
    con.execute("CREATE TABLE accesses (edge_id VARCHAR, edge_kind VARCHAR, site_id VARCHAR, binary_sha256 VARCHAR, function_id VARCHAR, object_id VARCHAR, base_object_id VARCHAR, value_id VARCHAR, region_offset BIGINT, region_extent BIGINT, selector_terms STRUCT(selector_value_id VARCHAR)[], exported_at TIMESTAMP, ingested_at TIMESTAMP, access_width INTEGER, field_path VARCHAR[], storage_kind VARCHAR, candidate_class VARCHAR, deterministic_context_ids VARCHAR[], context_ids VARCHAR[])")
    con.execute(f"INSERT INTO accesses (edge_id, edge_kind, site_id, binary_sha256, function_id, object_id, base_object_id, value_id, region_offset, region_extent, selector_terms, exported_at, ingested_at) VALUES {', '.join(rows)}")
    con.execute("CREATE TABLE sources (source_id VARCHAR, binary_sha256 VARCHAR, function_id VARCHAR, outputs STRUCT(kind VARCHAR, object_id VARCHAR, value_id VARCHAR)[])")
    con.execute("INSERT INTO sources VALUES " + ", ".join(f"('s{i}', 'b{n(2)}', 'F{n(3)}', {outputs()})" for i in range(12)))
    for t in ("accesses", "sources"):
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    order = lambda found: sorted(map(tuple, found), key=str)
    want = order(con.execute(association_queries.SQL["g5_rule_associations"]).fetchall())
    assert {w[-1] for w in want} == {0, 1}
    for most in (association_queries.MOST_REPEATED, 3):
        monkeypatch.setattr(association_queries, "MOST_REPEATED", most)
        assert order(association_queries.g5_rule_associations(spark, str(tmp_path)).select(*COLUMNS).collect()) == want
    # and in rounds of joins
    monkeypatch.setattr(parts, "MOST", 1)
    assert order(association_queries.g5_rule_associations(spark, str(tmp_path)).select(*COLUMNS).collect()) == want
