import json
import random

from factweave.operators import drift

SHAPE = "file_id bigint, campaign string, artifact string, schema_version string, payload string, version_no string, change string"


def files(spark, rows):
    """rows: (campaign, version, payload); the last two columns clash with the result's."""
    return spark.createDataFrame([(i, c, "sources", v, p, "x", "y") for i, (c, v, p) in enumerate(rows)], SHAPE)


def payload(rows, section="source_sites"):
    return json.dumps({section: rows})


def changed(spark, rows):
    return sorted(tuple(r)[3:] for r in drift.changes(files(spark, rows)).collect())


def test_each_kind_of_change(spark):
    rows = [
        ("c", "v1", payload([{"id": 1, "a": "x", "b": 1, "gone": 2, "none": None}, {"id": 2, "a": "y"}])),
        ("c", "v3", payload([{"id": 1, "a2": "x", "b": "1", "new": [1]}, {"id": 2, "a2": "y"}])),
    ]
    assert changed(spark, rows) == [(3, "added", "new", ""), (3, "removed", "gone", ""), (3, "renamed", "a", "a2"), (3, "retyped", "b", "")]


def test_a_renaming_needs_a_common_id_and_equal_values(spark):
    rows = [("c", "v1", payload([{"id": 1, "a": 1}, {"id": 2, "b": 5}, {"z": 1}])), ("c", "v2", payload([{"id": 1, "a2": 2}, {"id": 3, "b2": 5}]))]
    got = [c for c in changed(spark, rows) if c[1] == "renamed"]
    assert got == []


def test_unreadable_late_and_repeated_files(spark):
    one, two = payload([{"id": 1, "a": 1}]), payload([{"id": 1, "a": 1, "b": True}])
    rows = [("c", "v2", two), ("c", "v10", two), ("c", "v2", two), ("c", "v1", one), ("c", "v3", "{"), ("c", "v4", None), ("c", "none", two), (None, None, ""), ("c", "v5", '{"source_sites": null}'), ("c", "v6", "[]")]
    # v5 is readable and has no fields; v3, v4 and v6 are not readable
    fields = ["a", "b", "id"]
    want = [(2, "added", "b", ""), *((5, "removed", f, "") for f in fields), *((10, "added", f, "") for f in fields)]
    assert changed(spark, rows) == sorted(want)


def test_empty_table(spark):
    assert drift.changes(files(spark, [("c", "v1", "{}")]).filter("false")).count() == 0


def brute(rows):
    versions = {}
    for c, v, p in rows:
        versions.setdefault(c, {}).setdefault(int(v[1:]), []).append(json.loads(p))
    kind = lambda v: "string" if isinstance(v, str) else "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "array" if isinstance(v, list) else "object"
    out = set()
    for vs in versions.values():
        names = sorted(vs)
        data = {v: [r for d in vs[v] for r in d.get("source_sites") or []] for v in names}
        fields = {v: {} for v in names}
        for v in names:
            for r in data[v]:
                for k, x in r.items():
                    if x is not None:
                        fields[v].setdefault(k, set()).add(kind(x))
        for a, b in zip(names, names[1:]):
            gone, new = set(fields[a]) - set(fields[b]), set(fields[b]) - set(fields[a])
            moved = set()
            for g in gone:
                for n in new:
                    same = [json.dumps(x[g]) == json.dumps(y[n]) for x in data[a] for y in data[b] if x["id"] == y["id"] and x.get(g) is not None and y.get(n) is not None]
                    if same and all(same):
                        moved.add((g, n))
            out |= {(b, "renamed", g, n) for g, n in moved}
            out |= {(b, "removed", g, "") for g in gone - {g for g, _ in moved}} | {(b, "added", n, "") for n in new - {n for _, n in moved}}
            out |= {(b, "retyped", k, "") for k in set(fields[a]) & set(fields[b]) if fields[a][k] != fields[b][k]}
    return sorted(out)


def test_against_brute_force(spark):
    rng = random.Random(3)
    values = ["x", "y", 1, 2, True, [1], {"k": 1}, None]
    for _ in range(6):
        rows = [("c", f"v{rng.randint(1, 6)}", payload([{"id": i, **{f"f{rng.randint(0, 7)}": rng.choice(values) for _ in range(3)}} for i in range(3)])) for _ in range(8)]
        assert changed(spark, rows) == brute(rows)


def test_consistent_table(spark):
    rows = [
        ("c", "v1", payload([{"id": "r", "n": "12", "a": 1}])),
        ("c", "v2", payload([{"id": "r", "n": 12, "b": 1}])),
        ("c", "v3", payload([{"id": "r", "n": 13, "c": 1, "t": True}])),
    ]
    f = files(spark, rows)
    cells = drift.consistent_cells(f, drift.casts(drift.catalogue(f), drift.changes(f))).collect()
    got = sorted((c.version_no, c.name, c.value, c.as_number, c.as_boolean) for c in cells if c.name != "id")
    assert got == [(1, "c", "1", 1.0, None), (1, "n", "12", 12.0, None), (2, "c", "1", 1.0, None), (2, "n", "12", 12.0, None), (3, "c", "1", 1.0, None), (3, "n", "13", 13.0, None), (3, "t", "true", None, True)]


def test_wide_table_loses_nothing(spark):
    rows = [
        ("c", "v1", payload([{"id": "r", "n": "12", "Section": "s", "a": 1}, {}])),
        ("c", "v2", payload([{"id": "r", "n": 12, "b": 1, "n2": "x"}])),
        ("c", "v3", payload([{"id": "r", "n": 10**400, "b": 1, "t": True, "deep": [[1]], "zz": {"k": 1}}])),
        ("d", "v1", payload([{"id": 5, "n": "no"}])),
    ]
    f = files(spark, rows)
    casting = drift.casts(drift.catalogue(f), drift.changes(f))
    table = {(r.campaign, r.version_no, r.row_no): r for r in drift.consistent_table(f, casting).collect()}
    assert set(table) == {("c", 1, 0), ("c", 1, 1), ("c", 2, 0), ("c", 3, 0), ("d", 1, 0)}
    first, third = table["c", 1, 0], table["c", 3, 0]
    # 'Section' is a fixed column's name; producers disagree on n, so it is text
    assert first.rest == {"Section": "s"} and first.n == "12" and first.b == 1.0 and first.row_id == "r"
    assert third.t is True and third.deep == "[[1]]" and third.zz == '{"k":1}' and third.n == str(10**400)
    assert table["d", 1, 0].row_id == "5"
    small = {(r.campaign, r.version_no, r.row_no): r for r in drift.consistent_table(f, casting, most=1).collect()}
    for at, r in table.items():
        given = {**{k: v for k, v in r.asDict().items() if k not in {n for n, _ in drift._ROW} | {"rest"} and v is not None}, **r.rest}
        assert len(given) == len(small[at].rest) + (small[at].id is not None)


def test_numbers_that_are_none(spark):
    f = files(spark, [("c", "v1", payload([{"id": 1, "n": "x"}, {"id": 2, "n": True}])), ("c", "v2", payload([{"id": 1, "n": 10**400}]))])
    rows = drift.consistent_table(f, drift.casts(drift.catalogue(f), drift.changes(f))).collect()
    assert sorted((r.version_no, r.row_no, r.n, r.rest.get("n")) for r in rows) == [(1, 0, None, "x"), (1, 1, None, "true"), (2, 0, None, str(10**400))]


def test_rejects_and_deep_payloads(spark):
    deep = '{"source_sites": [{"id": 1, "a": ' + "[" * 100_000 + "]" * 100_000 + "}]}"
    two = payload([{"id": 1, "b": 1}])
    rows = [("c", "v1", deep), ("c", "v2", two), (None, "v1", two), ("c", "none", two), ("c", None, two), ("c", "v3", None), ("c", "v3", ""), ("c", "v3", "{"), ("c", "v3", "[]")]
    f = files(spark, rows)
    want = [(2, "NO_CAMPAIGN"), (3, "NO_VERSION"), (4, "NO_VERSION"), (5, "NO_PAYLOAD"), (6, "NO_PAYLOAD"), (7, "UNREADABLE"), (8, "NOT_AN_OBJECT")]
    assert sorted(map(tuple, drift.rejects(f).collect())) == want
    assert changed(spark, rows) == [(2, "added", "b", ""), (2, "removed", "a", "")]
    assert drift.rejects(f.filter("false")).count() == 0
