from pyspark.sql import functions as F

from factweave.operators import selection
from factweave.sources import detectors


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_operations_as_accesses(spark):
    ops = [(1, "s1", "LOAD", ["space", "a"], "v", None), (1, "s2", "STORE", ["space", "a", "v"], None, None), (1, "s3", "CALL", ["f"], "r", "fn"), (1, "s4", "COPY", ["x"], "y", None), (1, "s5", "LOAD", [], "v", None), (1, "s6", "STORE", ["v"], None, None)]
    got = selection.op_accesses(spark.createDataFrame(ops, "f int, site string, mnemonic string, inputs array<string>, output string, callee string"), ["f"])
    assert rows(got, "site", "kind", "address", "value", "callee") == [("s1", "READ", "a", "v", None), ("s2", "WRITE", "a", "v", None), ("s3", "CALL", None, None, "fn"), ("s5", "READ", None, "v", None), ("s6", "WRITE", None, "v", None)]


def test_contract_normalisation_and_strictness(spark):
    df = spark.createDataFrame([(1, "k", "x"), (2, "k", "x"), (3, "k", None)], "id int, k string, v string")
    good, bad = selection.contract(df, [("no_v", F.col("v").isNull())], ["k", "v"], ["id"])
    assert rows(good, "id") == [(1,)] and rows(bad, "id", "reason") == [(3, "no_v")]
    e = selection.normalise_edges(spark.createDataFrame([("", "b"), ("a", None), (None, " ")], "atom string, other string"), ["atom"], {"atom": ["other"]})
    assert rows(e, "atom", "traversable", F.array_join("blockers", ",")) == [("a", True, ""), ("b", True, ""), (None, False, "atom_missing")]
    s = spark.createDataFrame([("exact", None, None), ("legacy edge", None, None), (None, "x", True)], "a string, b string, f boolean")
    assert [r[0] for r in s.select(selection.strict_reject(["a", "b"], [F.col("f")])).collect()] == [False, True, True]


def test_roles_ablation_and_compatibility(spark):
    df = spark.createDataFrame([([("len", False), ("fmt", True), ("dst", None)],)], "p array<struct<role:string,constant:boolean>>")
    assert [x.role for x in df.select(selection.risky_roles(F.col("p")).alias("r")).first().r] == ["len", "dst"]
    fam = spark.createDataFrame([("a",), ("b",), (None,)], "f string")
    assert selection.ablated(fam, F.col("f"), ["a"]).count() == 2 and selection.ablated(fam, F.col("f"), []).count() == 3
    acc = spark.createDataFrame([(["r"], ["w"], ["r"]), ([], ["w"], ["w"]), (None, ["w"], ["r"]), (["r"], ["w"], None)], "d array<string>, e array<string>, o array<string>")
    assert [r[0] for r in acc.select(selection.access_compatible(F.col("d"), F.col("e"), F.col("o"))).collect()] == [True, True, False, False]


def test_outermost_boundaries_and_partitions(spark):
    df = spark.createDataFrame([("e", "outer", 2, ["outer", "mid", "inner"]), ("e", "mid", 1, ["mid", "inner"]), ("e", "inner", 0, ["inner"]), ("g", "b", 0, ["b"]), ("g", "a", 0, None)], "k string, site string, depth int, proof array<string>")
    assert rows(selection.outermost(df, ["k"], "site", "depth", "proof"), "k", "site") == [("e", "outer"), ("g", "a")]
    i = spark.createDataFrame([("a",), ("b",), ("c",)], "x string")
    g = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2), ("d", 1), (None, 1)], "x string, g int")
    assert rows(selection.partition_faults(i, g, "x", "g"), "x", "reason") == [("b", "in_several_groups"), ("c", "in_no_group"), ("d", "not_an_item")]


def test_text_hints():
    text = """void f(byte *param_1)
{
  iVar1 = *(byte *)(param_1 + 4);
  for (i = 0; i < n; i++) {
    buf[i] = x; /* buf[j] = y; */
  }
  while (*p) p++;
  a[0] = 1;
  *(int *)(s + 8) = *(int *)(s + 8) - 4;
  (**(code **)(t + 0x10))(q);
  if (a[1] == 2) g("while (*p) b[0] = 1");
}
"""
    got = [(rule, line) for rule, line, _ in detectors.hints(text)]
    assert got == [("PARSER_LOAD", 3), ("LOOP_WRITE", 5), ("UNBOUNDED_WALK", 7), ("FIELD_UPDATE", 9), ("DISPATCH", 10)]
    for odd in ("", "for (", "while (x) {", "for (;;) a[0] = 1"):
        list(detectors.hints(odd))
