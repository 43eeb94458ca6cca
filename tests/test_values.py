from pyspark.sql import functions as F

from factweave.functions import ids, region
from factweave.functions.text import key, stripped


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_integer_dialects(spark):
    rows = [("0x1f",), ("1f",), ("zz",), (" 12 ",), ("-0x10",), ("017",), ("0b101",), ("-8",), ("",), (None,), ("0",)]
    got = values(spark, rows, "s string", ids.hex_address("s"), ids.literal_integer("s"), ids.decimal_or_hex("s"))
    assert got == [(31, 31, 31), (31, None, None), (None, None, None), (18, 12, 12), (None, -16, None), (23, None, 17), (45313, 5, None), (None, -8, -8), (None, None, None), (None, None, None), (0, 0, 0)]


def test_signed_constants(spark):
    rows = [(255, 1), (127, 1), (0x8000, 2), (2**32 - 1, 4), (2**55, 7), (-5, 8), (3, 9), (300, 1)]
    assert [x for (x,) in values(spark, rows, "v bigint, n int", ids.signed_constant("v", "n"))] == [-1, 127, -32768, -1, -(2**55), -5, None, 44]


def test_alias_keys(spark):
    rows = [("obj:symbol:20000180:ring",), ("ram:0020000180",), ("obj:x",), ("source-object:q",), ("",), (None,), ("ram:0",)]
    got = [set(x) for (x,) in values(spark, rows, "o string", ids.alias_keys("o"))]
    assert got[0] == {"obj:symbol:20000180:ring", "symbol:20000180:ring", "address:20000180"}
    assert "address:20000180" in got[1] and got[2] == {"obj:x", "x"} and got[3] == {"source-object:q", "obj:source-object:q", "q"}
    assert got[4] == got[5] == set() and "address:0" in got[6]


def test_access_path_offsets(spark):
    rows = [(["field_offset:4", "deref", "byte_offset:8", "field_offset:0x10"],), (["deref"],), ([],), (["byte_offset:x"],), (["index:3"],), (None,), (["index:3", "deref", "byte_offset:2"],)]
    assert [x for (x,) in values(spark, rows, "p array<string>", ids.access_path_offset("p"))] == [24, 0, 0, None, None, None, 2]


def test_stable_ids_count_missing_parts_as_empty(spark):
    a, b = values(spark, [("x", None), ("x", "")], "a string, b string", ids.stable_id("p:", "a", "b"))
    assert a == b and len(a[0]) == 22


def test_keys(spark):
    assert values(spark, [("\t A　",), (" ",), (None,)], "s string", stripped(F.col("s")), key(F.col("s"))) == [("A", "a"), ("", None), (None, None)]


R = "o1 bigint, x1 bigint, s1 array<string>, o2 bigint, x2 bigint, s2 array<string>"


def test_access_relations_of_the_fixture(spark):
    rows = [(0, 4, [], 2, 4, []), (0, 4, [], 16, 1, None), (0, 4, [], None, 1, ["tail*1"]), (0, 4, [], None, None, []), (0, 4, [], 4, 1, [])]
    c = [F.col(x) for x in ("o1", "x1", "s1", "o2", "x2", "s2")]
    assert [x for (x,) in values(spark, rows, R, region.access_relation(*c))] == ["EXACT_OVERLAP", "DISJOINT", "MAY_OVERLAP", "DISJOINT", "DISJOINT"]
    assert [x for (x,) in values(spark, rows, R, region.read_relation(c[0], c[1], c[3], c[4], c[5]))] == ["EXACT_OVERLAP", "DISJOINT", "MAY_OVERLAP", "MAY_OVERLAP", "DISJOINT"]
    assert [x and tuple(x) for (x,) in values(spark, rows, R, region.shared_range(c[0], c[1], c[3], c[4]))] == [(2, 4), None, None, None, None]


def test_search_overlap_has_inclusive_ends_and_moves_relative_sides(spark):
    rows = [(0, 4, 4, 8, False, False, None), (0, 3, 4, 8, False, False, None), (None, 3, 4, 8, False, False, None), (0, 4, 100, 104, True, False, 100), (0, 4, 200, 204, True, False, 100), (0, 4, 200, 204, True, False, None)]
    c = [F.col(x) for x in "abcdefg"]
    got = values(spark, rows, "a bigint, b bigint, c bigint, d bigint, e boolean, f boolean, g bigint", region.search_overlap(*c))
    assert [x for (x,) in got] == [True, False, True, True, False, True]


def test_contexts(spark):
    rows = [("f", ["isr"], "f", ["task"]), ("f", ["isr"], "g", ["task"]), ("f", ["isr"], "g", ["isr"]), ("f", None, "g", ["isr"]), ("f", ["a", "b"], "g", ["isr"])]
    c = [F.col(x) for x in "abcd"]
    got = [x for (x,) in values(spark, rows, "a string, b array<string>, c string, d array<string>", region.different_context(*c))]
    assert got == ["SAME_FUNCTION", "DISTINCT_DETERMINISTIC_CONTEXT", *["DISTINCT_FUNCTION_HEURISTIC_CONTEXT"] * 3]
