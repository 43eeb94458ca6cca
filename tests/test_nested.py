import json

from factweave.operators import nested


def doc(functions, **more):
    return json.dumps({"schema_version": "v", "functions": functions, **more})


def found(spark, docs):
    df = spark.createDataFrame(list(enumerate(docs)), "record_id bigint, facts string")
    rows = nested.emit_tagged(df).collect()
    return sorted((r.record_id, r.tag, r.function_id, r.site_id, r.pos) for r in rows)


NODE = {"object_id": "o", "value_id": "v", "size": 4}


def test_shapes_of_lists(spark):
    op = {"site_id": "s1", "mnemonic": "COPY", "inputs": [NODE, None, NODE], "output": NODE}
    array = doc([{"function_id": "f1", "pcode_ops": [op]}])
    keyed = doc({"f1": {"entry": "0x10", "pcode_ops": {"s1": {"mnemonic": "COPY", "inputs": {"0": NODE, "1": None, "2": NODE}, "output": [NODE]}}}})
    single = doc({"function_id": "f1", "cfg": {"pcode_ops": json.dumps(op)}})
    text = doc(json.dumps([json.dumps({"function_id": "f1", "pcode_ops": [{**op, "inputs": json.dumps([NODE, None, NODE])}]})]))
    want = [("function", "f1", "", -1), ("input", "f1", "s1", 0), ("input", "f1", "s1", 2), ("op", "f1", "s1", -1), ("output", "f1", "s1", 0)]
    assert found(spark, [array, keyed, single, text]) == [(i, *w) for i in range(4) for w in want]


def test_missing_ids_and_empty_elements(spark):
    d = doc([{"name": "a", "entry": "0x8020afc"}, None, {}, {"name": "b", "entry": 4096, "pcode_ops": [{"mnemonic": "STORE", "inputs": [], "output": {}}, None, {}]}])
    assert found(spark, [d]) == [(0, "function", "fn:00001000", "", -1), (0, "function", "fn:08020afc", "", -1), (0, "op", "fn:00001000", "", -1)]


def test_unreadable_documents(spark):
    good = doc([{"function_id": "f", "name": "\ud800x"}])
    assert found(spark, [None, "", "  ", "{", "[]", "3", "null", doc(None), json.dumps({}), "[" * 100_000, good]) == [(10, "function", "f", "", -1)]


def test_parents_payload_and_empty_table(spark, tmp_path):
    d = doc([{"function_id": "f", "is_thunk": True, "pcode_ops": [{"site_id": "s", "op_order": 3, "mnemonic": "CALL", "call": {"kind": "CALL"}, "inputs": [NODE]}]}])
    df = spark.createDataFrame([(7, d, "x", "y")], "record_id bigint, facts string, tag string, pos string")
    tagged = nested.emit_tagged(df)
    nested.write_tagged(tagged, str(tmp_path / "t"))
    op = nested.read_table(spark, str(tmp_path / "t"), "op").first()
    value = nested.read_table(spark, str(tmp_path / "t"), "input").first()
    fn = nested.read_table(spark, str(tmp_path / "t"), "function").first()
    assert (op.mnemonic, op.op_order, json.loads(op.call)) == ("CALL", 3, {"kind": "CALL"})
    assert (value.parent_no, op.parent_no, fn.parent_no) == (op.node_no, fn.node_no, None)
    assert fn.is_thunk and value.size == 4
    assert nested.emit_tagged(df.filter("false")).count() == 0


def test_a_very_large_document(spark):
    ops = [{"site_id": f"s{i}", "mnemonic": "COPY", "inputs": [NODE] * 2, "output": NODE} for i in range(15_000)]
    df = spark.createDataFrame([(1, doc([{"function_id": "f", "pcode_ops": ops}]))], "record_id bigint, facts string")
    assert nested.emit_tagged(df, payload=False).count() == 1 + 4 * 15_000


def test_depth_makes_no_document_unreadable(spark):
    deep = "[" * 100_000 + "]" * 100_000
    d = '{"functions": [{"function_id": "f", "pcode_ops": [{"site_id": "s", "call": ' + deep + "}]}], \"other\": " + deep + "}"
    df = spark.createDataFrame([(1, d)], "record_id bigint, facts string")
    rows = {r.tag: r for r in nested.emit_tagged(df, rejects=True).collect()}
    assert set(rows) == {"function", "op"}
    assert json.loads(rows["op"].payload)["call"] == deep


def test_unreadable_documents_are_rejects(spark):
    docs = [None, "", "{", "[]", "3", "[" * 100_000, doc([{"function_id": "f"}])]
    df = spark.createDataFrame(list(enumerate(docs)), "record_id bigint, facts string")
    got = sorted((r.record_id, r.reason) for r in nested.flat_table(nested.emit_tagged(df, rejects=True), "reject").collect())
    assert got == [(0, "NO_DOCUMENT"), (1, "NO_DOCUMENT"), (2, "UNREADABLE"), (3, "NOT_AN_OBJECT"), (4, "NOT_AN_OBJECT"), (5, "UNREADABLE")]


def test_tables_of_nothing(spark, tmp_path):
    df = spark.createDataFrame([], "record_id bigint, facts string")
    nested.write_tagged(nested.emit_tagged(df, rejects=True), str(tmp_path / "t"))
    for tag in (*nested.NODES, "reject"):
        assert nested.read_table(spark, str(tmp_path / "t"), tag).count() == 0
