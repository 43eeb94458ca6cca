import json
import struct

import pytest
from pyspark.sql import functions as F

from factweave.operators import match, trace
from factweave.sources import binary, ctext, documents, traces, writers

CODE = '''/* f(x) */
int helper(int a, char *b)

{
  // g(1);
  if (a) {
    copy(b, ")", other(a, 1), 'x');
  }
  printf("%d (%s\\")", a,
    b);
  open(
}

void second(void)
{
  done();
}
'''


def test_functions_and_calls_of_c_text():
    assert [(n, p) for n, p, _, _ in ctext.functions("void a(void)\n{\n f(1);\n}\nint b(int x, int y)\n{\n}\n")] == [("a", ["void"]), ("b", ["int x", "int y"])]
    calls = list(ctext.call_sites(CODE.replace("  open(\n", "")))
    assert [(c, line, args) for c, _, line, args in calls] == [("copy", 7, ["b", '")"', "other(a, 1)", "'x'"]), ("other", 7, ["a", "1"]), ("printf", 9, ['"%d (%s\\")"', "a", "b"]), ("done", 15, [])]
    assert all(CODE.replace("  open(\n", "")[at:].startswith(c) for c, at, _, _ in calls)


def test_masks_keep_offsets_and_unclosed_text_is_survived():
    for text in (CODE, '"', "/* open", "'\\", "f((", "}}{", "", "é" * 10 + "f(1)"):
        assert len(ctext.masked(text)) == len(text)
        list(ctext.call_sites(text))
        list(ctext.functions(text))


def test_scans_of_dirty_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "void f(void)\n{\n g(1,2);\n}\n", "x"), (None, "h(3)", "x"), (5, "k();" * 20_000, "x")], "rid bigint, body string, callee string")
    out = ctext.scan_calls(df, "rid", "body")
    assert sorted((r.row_id or 0, r.callee, len(r.arguments)) for r in out.filter("row_id IS NULL OR row_id < 5").collect()) == [(0, "h", 1), (3, "g", 2)]
    assert out.filter("row_id = 5").count() == 20_000
    assert ctext.scan_functions(df.filter("false"), "rid", "body").count() == 0


def test_expressions(spark):
    df = spark.createDataFrame([("(int)  x +\ty", "%d"), ("(uint8_t *)buf", "100%%"), ("(a)", "%5.2lf")], "e string, f string")
    got = df.select(ctext.clean_expression("e"), ctext.has_conversion("f"), ctext.without_casts("e"), F.array_join(ctext.identifiers("e"), ",")).collect()
    assert [tuple(r) for r in got] == [("(int) x + y", True, "x +\ty", "int,x,y"), ("(uint8_t *)buf", False, "buf", "buf,uint8_t"), ("(a)", True, "(a)", "a")]


def test_headers():
    text = """typedef struct { __IO uint32_t SR; __IO uint16_t DR; uint16_t RESERVED0; __IO uint32_t CR[2]; uint8_t X; } USART_TypeDef;
typedef struct {
  RwReg UART_CR; /**< (Uart Offset: 0x0000) Control */
  RwReg UART_MR; /**< (Uart Offset: 0x0004) Mode */
} Uart;
#define PERIPH_BASE (0x40000000U)
#define USART2_BASE (PERIPH_BASE + 0x4400U)
#define USART2 ((USART_TypeDef *) USART2_BASE)
#define UART ((Uart *)0x400E0800U)
#define NOTHING ((Uart *)UNKNOWN_BASE)
"""
    assert sorted(ctext.header_fields(text)) == [("USART_TypeDef", "CR", 8), ("USART_TypeDef", "DR", 4), ("USART_TypeDef", "SR", 0), ("USART_TypeDef", "X", 16), ("Uart", "UART_CR", 0), ("Uart", "UART_MR", 4)]
    assert sorted(ctext.header_bases(text)) == [("UART", "Uart", 0x400E0800), ("USART2", "USART_TypeDef", 0x40004400)]


TRACE = "001a: 8001235 fffffff9 r 4 64 4 0x40094008:7c6e5ef4\n\n001b 8001200 3\r\n727f4: 8008950 8001355 w 1 0x2000334c:0\nnonsense\n728ae: 800ab40 8001cc7 r 4 0x2000334c:0"


def test_trace_lines_and_the_causal_fault(spark):
    df = spark.createDataFrame([("r", TRACE), ("none", None), ("empty", "")], "run string, text string")
    lined = traces.lines(df, "run", "text")
    events, bad = traces.parse(lined, "run")
    assert [(r.kind, r.event_id) for r in events.orderBy("event_id").collect()] == [("mmio", 0x1A), ("bb", 0x1B), ("ram", 0x727F4), ("ram", 0x728AE)]
    assert [(r.line_no, r.line) for r in bad.collect()] == [(5, "nonsense")]
    with pytest.raises(Exception, match="malformed trace line 5"):
        traces.parse(lined, "run", strict=True)[0].collect()
    fault = spark.createDataFrame([("r", 0x800AB42, 0x800AB40, 0x800AB4C)], "run string, fault_pc bigint, start bigint, end bigint")
    for low, bound in ((0x8008900, 1), (0x8007000, 0)):
        effect = spark.createDataFrame([("r", low, low + 0x56)], "run string, effect_start bigint, effect_end bigint")
        assert trace.causal_fault(trace.causal_reads(events, ["run"]), fault, effect, ["run"]).count() == bound


def test_blocks_replays_and_mappings(spark):
    e = spark.createDataFrame([("r", 0x8001208), ("r", 0x8001210)], "run string, pc bigint")
    i = spark.createDataFrame([("r", 0x8001200, 0x8001210, "f")], "run string, start bigint, end bigint, name string")
    assert sorted((r.pc, r.name) for r in trace.blocks_covering(e, i, ["run"], "pc").collect()) == [(0x8001208, "f"), (0x8001210, None)]
    runs = [("p", True, True, "x"), ("p", True, True, " x"), ("q", True, True, "x"), ("q", True, True, "y"), ("s", True, True, "x"), ("t", True, True, None), ("t", True, True, "x"), ("u", True, False, "x"), ("u", True, True, "x")]
    df = spark.createDataFrame(runs, "k string, a boolean, b boolean, sig string")
    got = {r.k: r.v for r in df.groupBy("k").agg(trace.replay_agreement(F.col("a"), F.col("b"), F.col("sig")).alias("v")).collect()}
    assert got == {"p": "POC", **dict.fromkeys("qstu", "INCONCLUSIVE")}


def elf32(symbols=((b"main", 0x8000101, 4),), words=(1, 2, 0xDEADBEEF)):
    content = struct.pack("<3I", *words)
    names, entries = b"\0", struct.pack("<IIIBBH", 0, 0, 0, 0, 0, 0)
    for name, address, size in symbols:
        entries += struct.pack("<IIIBBH", len(names), address, size, 2, 0, 1)
        names += name + b"\0"
    at = 52 + 32
    sections = struct.pack("<10I", *[0] * 10) + struct.pack("<10I", 0, 2, 0, 0, at + 12, len(entries), 2, 0, 4, 16) + struct.pack("<10I", 0, 3, 0, 0, at + 12 + len(entries), len(names), 0, 0, 1, 0)
    shoff = at + 12 + len(entries) + len(names)
    head = b"\x7fELF\x01\x01\x01" + b"\0" * 9 + struct.pack("<HHIIIIIHHHHHH", 2, 40, 1, 0x8000101, 52, shoff, 0, 52, 32, 1, 40, 3, 0)
    return head + struct.pack("<8I", 1, at, 0x8000100, 0, 12, 16, 6, 4) + content + entries + names + sections


def test_elf_files(spark, tmp_path):
    (tmp_path / "a.elf").write_bytes(elf32())
    (tmp_path / "bad.elf").write_bytes(b"\x7fELF\x01\x01short")
    (tmp_path / "empty.elf").write_bytes(b"")
    f = binary.files(spark, str(tmp_path / "*.elf"))
    assert [(r.start, r.end, r.writable, r.executable) for r in binary.segments(f).collect()] == [(0x8000100, 0x8000110, True, False)]
    assert [(r.name, r.address, r.type) for r in binary.symbols(f).collect()] == [("main", 0x8000101, 2)]
    assert sorted((r.address, r.value) for r in binary.words(f).collect()) == [(0x8000100, 1), (0x8000104, 2), (0x8000108, 0xDEADBEEF)]
    assert binary.identity_symbols(f).first().addresses == [0x8000100]


def test_documents_and_registries(spark, tmp_path):
    for sample, status in (("s1", "OK"), ("s2", "FAILED")):
        (tmp_path / "per_sample" / sample).mkdir(parents=True)
        (tmp_path / "per_sample" / sample / "public_match.json").write_text(json.dumps({"status": status, "n": 1}))
    assert [r.sample for r in documents.read_samples(spark, str(tmp_path), "status string, n int").collect()] == ["s1"]
    (tmp_path / "bad.json").write_text("{")
    assert documents.read_json(spark, str(tmp_path / "bad.json"), "n int").first()._corrupt_record is not None
    raw = spark.createDataFrame(
        [("v2", [("memcpy", ["memmove", " memcpy "], "copy", "COPY", None, {"len": 2}), ("off", None, "copy", "X", False, None)]), ("v9", [("no", None, "copy", "X", True, None)])],
        "version string, patterns array<struct<name:string,names:array<string>,kind:string,label:string,enabled:boolean,roles:map<string,int>>>",
    )
    assert sorted(r.name for r in documents.sink_registry(raw).collect()) == ["memcpy", "memmove"]
    pack = spark.createDataFrame([("p", [("read", False, [("scalar_value", 0)]), ("odd", True, [("memory_object", 1)])])], "pack string, summaries array<struct<function:string,compatibility:boolean,outputs:array<struct<kind:string,slot:int>>>>")
    assert documents.summary_pack(pack).count() == 1 and documents.summary_pack(pack, True).count() == 2
    facts = spark.createDataFrame([("a", "v4"), ("b", "v3")], "binary_sha256 string, schema_version string")
    reuse, export = documents.cached_facts(facts, spark.createDataFrame([("a",), ("b",), ("c",)], "binary_sha256 string"), "v4")
    assert [r.binary_sha256 for r in reuse.collect()] == ["a"] and sorted(r.binary_sha256 for r in export.collect()) == ["b", "c"]
    edges, bad = documents.normalise_cfg(spark.createDataFrame([("f", "b0", ["b1", "b9"]), ("f", "b1", None)], "function_id string, block_id string, successor_block_ids array<string>"))
    assert [r.target_block_id for r in edges.collect()] == ["b1"] and [r.target_block_id for r in bad.collect()] == ["b9"]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 1), (None, 2)], "name string, n int")
    assert writers.markdown(df.orderBy("n")) == "| name | n |\n|---|---|\n| a\\|b | 1 |\n| N/A | 2 |"
    writers.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2
    writers.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    assert writers.stage_report({"in": df, "out": df.filter("n > 1")}) == "[1] in: 2 rows\n[2] out: 1 rows"
    with pytest.raises(ValueError):
        writers.corpus_text(spark.createDataFrame([("f", " ")], "func_name string, body string"), str(tmp_path / "t"))
    assert tuple(writers.graph_artifact(df, df.limit(1), df.limit(0), str(tmp_path / "g")).first()) == (2, 1, 0)
    assert [r[0] for r in df.select(writers.percent("n", F.lit(8))).orderBy("n").collect()] == ["12.5%", "25.0%"]


def test_matching(spark):
    expected = spark.createDataFrame([(1, "memcpy", ["a ,"], None, None), (2, "memcpy", None, ["zz"], None), (3, "memcpy", None, None, "("), (4, None, None, None, r"cpy\(.*\)")], "id int, callee string, every array<string>, any array<string>, pattern string")
    found = spark.createDataFrame([("s", "memcpy", "memcpy(a, b)", 7)], "k string, got string, expr string, n int")
    pairs = match.checked_patterns(expected, "pattern").crossJoin(found)
    hit = match.site_matches(F.col("expr"), F.col("got"), F.col("callee"), F.col("every"), F.col("any"), F.col("pattern"))
    assert sorted(r.id for r in pairs.filter(hit).collect()) == [1, 4]
    e = spark.createDataFrame([(1, "k1"), (2, "k2"), (3, "k3")], "id int, k string")
    f = spark.createDataFrame([("k1", 5, False), ("k1", 9, True), ("k2", 2, False), ("k2", 1, False)], "k string, n int, sure boolean")
    out = match.match_expected(e, f, ["k"], "id", F.col("sure"), ["n"])
    assert sorted((r.id, r.n, r.match) for r in out.collect()) == [(1, 9, "CONFIRMED"), (2, 1, "CANDIDATE"), (3, None, "MISS")]
    assert [r[0] for r in spark.createDataFrame([(None, "a"), ("", "a"), ("a", "a"), ("b", "a")], "e string, f string").select(match.labels_compatible(F.col("e"), F.col("f"))).collect()] == [True, True, True, False]
