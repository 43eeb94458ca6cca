"""Queries of operators whose own inputs no table carries: their inputs are derived from whole tables by plain projections.

The SQL derives the same inputs and states the operator's rule over them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.operators import cfg, graph, patterns, rank, selection
from factweave.operators.fixpoint import whole
from factweave.session import scratch, table
from factweave.sources import binary, ctext, documents, writers

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- sources and writers


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def w1_json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Orders as JSON lines and back."""
    path = scratch(spark, "json")
    writers.write_json(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), path)
    return spark.read.schema("o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double").json(path)


@query("""SELECT '{"p_brand":"' || p_brand || '","p_partkey":' || p_partkey || ',"p_size":' || p_size || ',"void":null}' AS value FROM part""")
def w2_sorted_json(spark: SparkSession, d: str) -> DataFrame:
    """Parts as JSON lines with sorted keys and NULLs."""
    path = scratch(spark, "json")
    writers.write_sorted_json(table(spark, d, "part").select("p_size", "p_partkey", F.lit(None).cast("string").alias("void"), "p_brand"), path, ["p_partkey"])
    return spark.read.text(path)


@query("SELECT row_number() OVER (ORDER BY p_size, p_partkey) AS place, p_partkey FROM part")
def r11_ordered_output(spark: SparkSession, d: str) -> DataFrame:
    """Parts written in order of size: their places as the files, one after another, have them."""
    path = scratch(spark, "ordered")
    writers.write_sorted_json(table(spark, d, "part").select("p_size", "p_partkey"), path, ["p_size", "p_partkey"])
    rows = spark.read.schema("p_partkey bigint, p_size int").json(path).withColumns({"file": F.col("_metadata.file_name"), "at": F.monotonically_increasing_id()})
    return rank.global_rank(rows, [F.col("file"), F.col("at")], "place").select("place", "p_partkey")


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def w3_csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "csv")
    writers.write_csv(table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal"), path)
    return spark.read.schema("s_suppkey bigint, s_name string, s_acctbal double").option("header", True).csv(path)


@query(
    """SELECT 0 AS line_no, '| r_name | nations |' AS line UNION ALL SELECT 1, '|---|---|'
UNION ALL SELECT 1 + row_number() OVER (ORDER BY r_name), '| ' || r_name || ' | ' || count(n_nationkey) || ' |' FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name"""
)
def w4_markdown(spark: SparkSession, d: str) -> DataFrame:
    """A report of regions as lines of markdown."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    report = r.join(n, r["r_regionkey"] == n["n_regionkey"], "left").groupBy("r_name").agg(F.count("n_nationkey").alias("nations")).orderBy("r_name")
    return spark.createDataFrame(list(enumerate(writers.markdown(report).split("\n"))), "line_no int, line string")


@query("SELECT 1 AS stage, '[1] orders: ' || count(*) || ' rows' AS line FROM orders UNION ALL SELECT 2, '[2] urgent: ' || count(*) || ' rows' FROM orders WHERE o_orderpriority LIKE '1%'")
def w5_stage_report(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    lines = writers.stage_report({"orders": o, "urgent": o.filter("o_orderpriority LIKE '1%'")}).split("\n")
    return spark.createDataFrame(list(enumerate(lines, 1)), "stage int, line string")


@query(
    """SELECT '/* ' || coalesce(func_name, '?') || ' */' AS line, count(*) AS functions FROM function_corpus
WHERE trim(coalesce(body, '')) <> '' AND NOT regexp_matches(coalesce(func_name, ''), '[\\r\\n]') GROUP BY 1"""
)
def w6_corpus_text(spark: SparkSession, d: str) -> DataFrame:
    """The corpus as text: how often each function's headline occurs in what was written."""
    path, f = scratch(spark, "corpus"), table(spark, d, "function_corpus").filter(~F.coalesce(F.col("func_name"), F.lit("")).rlike(r"[\r\n]"))
    writers.corpus_text(f, path)
    names = f.filter("trim(coalesce(body, '')) <> ''").select(F.concat(F.lit("/* "), F.coalesce("func_name", F.lit("?")), F.lit(" */")).alias("line")).distinct()
    return spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("functions")).join(names, "line")


@query("SELECT (SELECT count(*) FROM nation) AS nodes, (SELECT count(*) FROM customer) AS edges, (SELECT count(*) FROM customer WHERE c_acctbal < 0) AS rejects")
def w7_graph_artifact(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    edges = c.select("c_custkey", "c_nationkey")
    return writers.graph_artifact(table(spark, d, "nation").select("n_nationkey"), edges, c.filter("c_acctbal < 0").select("c_custkey"), scratch(spark, "graph"))


@query("SELECT 'sample=' || c_nationkey || '-' || c_custkey % 64 AS sample, c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING'")
def s2_samples(spark: SparkSession, d: str) -> DataFrame:
    """Customers as documents in folders, read back as samples; one segment has a status that isn't OK."""
    path = scratch(spark, "samples")
    c = table(spark, d, "customer").select(F.concat_ws("-", "c_nationkey", F.col("c_custkey") % 64).alias("sample"), "c_custkey", F.when(F.col("c_mktsegment") == "BUILDING", "FAILED").otherwise("OK").alias("status"))
    c.groupBy("sample").agg(F.to_json(F.collect_list(F.struct("c_custkey", "status"))).alias("value")).write.partitionBy("sample").text(path)
    return documents.read_samples(spark, path, "c_custkey bigint, status string", "sample=*/part-*").select("sample", "c_custkey")


@query("SELECT s_suppkey, s_name, FALSE AS corrupt FROM supplier UNION ALL SELECT NULL, NULL, TRUE FROM supplier WHERE s_suppkey = (SELECT min(s_suppkey) FROM supplier)")
def s1_json_documents(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as one document in an array, and a broken document beside it."""
    path, s = scratch(spark, "documents"), table(spark, d, "supplier")
    parts = s.groupBy((F.col("s_suppkey") % 64).alias("part")).agg(F.to_json(F.collect_list(F.struct("s_suppkey", "s_name"))).alias("value"))
    parts.unionByName(s.agg(F.min("s_suppkey").alias("k")).filter("k IS NOT NULL").select(F.lit(-1).cast("bigint").alias("part"), F.lit('[{"s_suppkey": ').alias("value"))).write.partitionBy("part").text(path)
    rows = documents.read_json(spark, f"{path}/part=*", "s_suppkey bigint, s_name string")
    return rows.select("s_suppkey", "s_name", F.col("_corrupt_record").isNotNull().alias("corrupt"))


_IMAGE = "134217728 + s_suppkey * 64"


def _images(spark: SparkSession, d: str) -> DataFrame:
    """An ELF file of each supplier: its numbers as words, its name as a symbol."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("path"), F.expr(_IMAGE).alias("address"), F.array(*(F.col(c).cast("bigint") for c in ("s_suppkey", "s_nationkey"))).alias("words"), "s_name")
    return binary.images(s, "path", "address", "words", "s_name")


@query(f"SELECT s_suppkey::VARCHAR AS path, {_IMAGE} AS start, {_IMAGE} + 8 AS \"end\", FALSE AS writable, TRUE AS executable FROM supplier")
def s3_segments(spark: SparkSession, d: str) -> DataFrame:
    return binary.segments(_images(spark, d))


@query(f"SELECT s_suppkey::VARCHAR AS path, {_IMAGE} AS address, s_suppkey AS value FROM supplier UNION ALL SELECT s_suppkey::VARCHAR, {_IMAGE} + 4, s_nationkey FROM supplier")
def s4_words(spark: SparkSession, d: str) -> DataFrame:
    return binary.words(_images(spark, d))


@query(f"SELECT s_suppkey::VARCHAR AS path, s_name AS name, ({_IMAGE})::VARCHAR AS addresses FROM supplier")
def s5_identity_symbols(spark: SparkSession, d: str) -> DataFrame:
    return binary.identity_symbols(_images(spark, d)).withColumn("addresses", F.array_join(F.col("addresses").cast("array<string>"), ","))


@query(
    """WITH h AS (SELECT p_partkey, p_size FROM part)
SELECT p_partkey AS row_id, 0 AS row_no, 'field' AS kind, 'Regs' AS type, 'CTRL' AS name, 0 AS value FROM h UNION ALL SELECT p_partkey, 1, 'field', 'Regs', 'DATA', 4 + p_size * 4 FROM h
UNION ALL SELECT p_partkey, 2, 'base', 'Regs', 'UNIT', 1073741824 + p_size * 16 FROM h"""
)
def s8_headers(spark: SparkSession, d: str) -> DataFrame:
    """A header of each part: a struct with a reserved stretch and an instance at an address."""
    text = F.format_string("typedef struct {\n  uint32_t CTRL;\n  uint32_t RESERVED[%d];\n  uint32_t DATA;\n} Regs;\n#define UNIT_BASE (0x40000000UL + 0x%x0)\n#define UNIT ((Regs *) UNIT_BASE)\n", "p_size", "p_size")
    return ctext.scan_headers(table(spark, d, "part").select("p_partkey", text.alias("text")), "p_partkey", "text")


@query("SELECT n_name AS name, r_name AS kind, 'L' AS label, CASE WHEN r_regionkey % 2 = 0 THEN 'v1' ELSE 'v2' END AS version FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 7 <> 0 AND r_regionkey <> 4")
def s10_sink_registry(spark: SparkSession, d: str) -> DataFrame:
    """Regions as registries of nations, one of an unknown version and some rows disabled."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    p = F.struct(
        F.concat(F.lit(" "), "n_name").alias("name"), F.array("n_name").alias("names"), F.col("r_name").alias("kind"), F.lit("L").alias("label"),
        F.when(F.col("n_nationkey") % 7 == 0, False).alias("enabled"), F.lit(None).cast("map<string,int>").alias("roles"),
    )
    raw = r.join(n, r["r_regionkey"] == n["n_regionkey"]).groupBy("r_regionkey").agg(F.collect_list(p).alias("patterns"))
    version = F.when(F.col("r_regionkey") == 4, "v9").when(F.col("r_regionkey") % 2 == 0, "v1").otherwise("v2")
    return documents.sink_registry(raw.select(version.alias("version"), "patterns")).select("name", "kind", "label", "version")


@query(
    """SELECT source_id AS pack, function_id AS function, k - 1 AS output_no, o.kind AS kind, k - 1 AS slot FROM (
  SELECT source_id, function_id, unnest(outputs) AS o, generate_subscripts(outputs, 1) AS k FROM sources WHERE NOT coalesce(source_kind = 'serial', FALSE))"""
)
def s11_summary_pack(spark: SparkSession, d: str) -> DataFrame:
    """Each source's outputs as a pack; those of one kind only on demand."""
    outputs = F.transform("outputs", lambda o, i: F.struct(o["kind"].alias("kind"), i.alias("slot")))
    s = F.array(F.struct(F.col("function_id").alias("function"), F.coalesce(F.col("source_kind") == "serial", F.lit(False)).alias("compatibility"), outputs.alias("outputs")))
    return documents.summary_pack(table(spark, d, "sources").select(F.col("source_id").alias("pack"), s.alias("summaries")))


@query(
    """SELECT DISTINCT p_brand AS profile_id, 1073741824 + p_size * 4 AS address, p_type AS role FROM part WHERE p_brand NOT LIKE '%3'"""
)
def s12_hardware_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Parts as registers of their brands' profiles; some brands are of one binary only."""
    r = F.struct(
        F.lit("UNIT").alias("peripheral_instance"), F.when(F.col("p_size") % 2 == 0, F.format_string("0x%x", F.lit(1073741824) + F.col("p_size") * 4)).alias("address"), F.lit("0x40000000").alias("instance_base"),
        (F.col("p_size") * 4).cast("string").alias("field_offset"), F.col("p_type").alias("role"), F.array(F.lit("read")).alias("access"),
    )
    # a profile of each part, so that a brand's parts are never gathered
    raw = table(spark, d, "part").select(F.col("p_brand").alias("profile_id"), F.when(F.col("p_brand").like("%3"), "binary").alias("scope"), F.array(r).alias("registers"))
    return documents.hardware_profiles(raw).select("profile_id", "address", "role")


_BLOCKS = "SELECT DISTINCT o_custkey AS f, o_orderkey AS b FROM orders"


@query(
    f"""WITH k AS ({_BLOCKS}), r AS (SELECT f, b, b + 1 AS t FROM k UNION SELECT f, b, b + f % 3 FROM k)
SELECT f AS function_id, b AS source_block_id, t AS target_block_id, CASE WHEN (f, t) NOT IN (SELECT f, b FROM k) THEN 'unresolved_block' END AS reason FROM r"""
)
def s14_normalised_cfg(spark: SparkSession, d: str) -> DataFrame:
    """Customers as functions and orders as blocks, whose successors may be unknown."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("function_id"), F.col("o_orderkey").alias("block_id"))
    edges, unknown = documents.normalise_cfg(o.withColumn("successor_block_ids", F.array(F.col("block_id") + 1, F.col("block_id") + F.col("function_id") % 3)))
    return edges.withColumn("reason", F.lit(None).cast("string")).unionByName(unknown.select(*edges.columns, "reason"))


@query(
    """WITH u AS (SELECT DISTINCT binary_sha256 FROM program_facts WHERE schema_version = 'program-facts-v4' AND binary_sha256 IS NOT NULL), w AS (SELECT DISTINCT binary_sha256 FROM function_corpus WHERE binary_sha256 IS NOT NULL)
SELECT 'reuse' AS step, binary_sha256, count(*) AS n FROM program_facts WHERE schema_version = 'program-facts-v4' AND binary_sha256 IN (SELECT * FROM w) GROUP BY 2 UNION ALL SELECT 'export', binary_sha256, 1 FROM w WHERE binary_sha256 NOT IN (SELECT * FROM u)"""
)
def s16_cached_facts(spark: SparkSession, d: str) -> DataFrame:
    """Which binaries of the corpus have facts of the version, and which are to be exported."""
    wanted = table(spark, d, "function_corpus").select("binary_sha256").filter("binary_sha256 IS NOT NULL").distinct()
    reuse, export = documents.cached_facts(table(spark, d, "program_facts").select("binary_sha256", "schema_version"), wanted, "program-facts-v4")
    both = reuse.select(F.lit("reuse").alias("step"), "binary_sha256").unionByName(export.select(F.lit("export").alias("step"), "binary_sha256"))
    return both.groupBy("step", "binary_sha256").agg(F.count("*").alias("n"))


# --- relational rules


@query(
    """WITH x AS (SELECT l_orderkey, l_linenumber AS site, l_quantity, CASE WHEN l_quantity > 25 THEN l_linenumber + 1 END AS inner_site FROM lineitem),
k AS (SELECT * FROM x WHERE NOT EXISTS (SELECT 1 FROM x y WHERE y.l_orderkey = x.l_orderkey AND y.inner_site = x.site))
SELECT l_orderkey, site FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, site) AS n FROM k) WHERE n = 1"""
)
def u4_outermost(spark: SparkSession, d: str) -> DataFrame:
    """Lines as proofs that may contain the next line."""
    n = F.col("l_linenumber")
    proof = F.when(F.col("l_quantity") > 25, F.array(n, n + 1)).otherwise(F.array(n))
    return selection.outermost(table(spark, d, "lineitem").select("l_orderkey", n.alias("site"), "l_quantity", proof.alias("proof")), ["l_orderkey"], "site", "l_quantity", "proof").select("l_orderkey", "site")


@query("SELECT row_number() OVER (ORDER BY w DESC, p_partkey) AS rank, p_partkey FROM (SELECT p_partkey, CASE WHEN p_type LIKE 'PROMO%' THEN 0.6 WHEN p_type LIKE 'ECONOMY%' THEN 0.5 ELSE 0 END AS w FROM part)")
def r2_weight_rank(spark: SparkSession, d: str) -> DataFrame:
    """Parts by the weight of their type's family, those of no family last."""
    w = F.when(F.col("p_type").like("PROMO%"), 0.6).when(F.col("p_type").like("ECONOMY%"), 0.5).otherwise(0)
    return rank.global_rank(table(spark, d, "part").select("p_partkey", w.alias("w")), [F.desc("w"), F.asc("p_partkey")]).select("rank", "p_partkey")


@query(
    """SELECT l_orderkey, round(least(1, greatest(0, max(l_discount * 12))), 4) AS best, CASE WHEN bool_or(l_returnflag = 'R') THEN 'R' WHEN bool_or(l_returnflag = 'A') THEN 'A' ELSE 'N' END AS hint FROM lineitem GROUP BY l_orderkey"""
)
def d3_rank_metadata(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_discount") * 12).alias("scores"), F.collect_set("l_returnflag").alias("hints"))
    best, hint = patterns.rank_metadata(F.col("scores"), F.col("hints"), ["R", "A", "N"])
    return g.select("l_orderkey", best.alias("best"), hint.alias("hint"))


# --- flow rules


@query(
    """WITH s AS (SELECT 'R' AS f, 'ret' AS label, 'len' AS role, 0 AS slot UNION ALL SELECT 'R', 'ret', 'dst', 2 UNION ALL SELECT 'A', 'acc', 'len', 5)
SELECT l_orderkey || '/' || l_linenumber AS site, l_suppkey AS caller, label, role, CASE slot WHEN 0 THEN l_partkey::VARCHAR WHEN 2 THEN l_orderkey::VARCHAR END AS actual FROM lineitem JOIN s ON f = l_returnflag"""
)
def g17_instantiated(spark: SparkSession, d: str) -> DataFrame:
    """Lines as calls of functions with summaries; one role asks for an argument that isn't passed."""
    s = spark.createDataFrame([("R", "ret", [("len", 0), ("dst", 2)]), ("A", "acc", [("len", 5)])], "function string, label string, entries array<struct<key:string,value:int>>")
    c = table(spark, d, "lineitem").select(
        F.concat_ws("/", "l_orderkey", "l_linenumber").alias("site"), F.col("l_suppkey").alias("caller"), F.col("l_returnflag").alias("callee"), F.array(*(F.col(x).cast("string") for x in ("l_partkey", "l_suppkey", "l_orderkey"))).alias("arguments")
    )
    return graph.instantiate(s, c)


@query(
    """WITH e AS (SELECT n_regionkey AS f, n_nationkey AS site, n_nationkey % 2 AS slot, n_nationkey % 3 AS off, n_name AS value FROM nation), b AS (SELECT DISTINCT s_suppkey AS call_site, 'o' AS object, off, value, site FROM supplier JOIN e ON f = s_nationkey % 5 AND slot = s_suppkey % 2),
n AS (SELECT *, count(*) OVER (PARTITION BY call_site, object, off) AS n FROM b)
SELECT call_site, object, off AS "offset", value, CASE WHEN FALSE THEN '' END AS reason FROM n WHERE n <= 1 UNION ALL SELECT DISTINCT call_site, object, off, NULL, 'output_effect_alternative_exhausted' FROM n WHERE n > 1"""
)
def g18_bound_effects(spark: SparkSession, d: str) -> DataFrame:
    """Nations as effects of their regions, at the objects that suppliers pass."""
    e = table(spark, d, "nation").select(F.col("n_regionkey").alias("function"), F.col("n_nationkey").alias("site"), (F.col("n_nationkey") % 2).alias("slot"), (F.col("n_nationkey") % 3).alias("offset"), F.col("n_name").alias("value"))
    c = table(spark, d, "supplier").select(F.col("s_suppkey").alias("call_site"), (F.col("s_nationkey") % 5).alias("callee"), (F.col("s_suppkey") % 2).cast("int").alias("slot"), F.lit("o").alias("object"))
    bound, blocked = patterns.bind_effects(e, c, 1)
    return bound.select("call_site", "object", "offset", "value", F.lit(None).cast("string").alias("reason")).unionByName(blocked.select("call_site", "object", "offset", F.lit(None).cast("string").alias("value"), "reason"))


@query("SELECT o_orderkey AS f, 's' AS site, (o_custkey % 4)::INT AS slot, 4 + o_orderkey % 5 AS \"offset\", 'v' AS value FROM orders WHERE o_orderstatus <> 'F'")
def g18_fixed_effects(spark: SparkSession, d: str) -> DataFrame:
    """Orders as functions that store at a formal plus a constant, or (status F) at the formal twice over."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("f"), (F.col("o_orderstatus") == "F").alias("twice"), (F.col("o_custkey") % 4).cast("int").alias("slot"), (F.lit(4) + F.col("o_orderkey") % 5).alias("k"))
    op = lambda pos, name, number: F.struct(F.lit("a").alias("output"), name.alias("input"), F.lit(pos).alias("pos"), F.lit("INT_ADD").alias("mnemonic"), number.cast("bigint").alias("constant"))
    inputs = o.select("f", F.explode(F.array(op(0, F.lit("p"), F.lit(None)), F.when(F.col("twice"), op(1, F.lit("p"), F.lit(None))).otherwise(op(1, F.lit("k"), F.col("k"))))).alias("i")).select("f", "i.*")
    stores = o.select("f", F.lit("s").alias("site"), F.lit("a").alias("address"), F.lit("v").alias("value"))
    return patterns.fixed_effects(inputs, stores, o.select("f", "slot", F.lit("p").alias("node")), ["f"])


@query(
    """WITH s AS (SELECT p_partkey AS lineage, 'p' || p_partkey AS object, 0 AS s, p_size AS e FROM part), c AS (SELECT 'p' || l_partkey AS src, l_linenumber AS a, l_linenumber + 10 AS b, 's' || l_suppkey AS dst, l_linenumber * 2 AS t FROM lineitem)
SELECT lineage, object, s AS start, e AS "end" FROM s UNION SELECT lineage, dst, greatest(s, a) - a + t, least(e, b) - a + t FROM s JOIN c ON src = object AND greatest(s, a) < least(e, b)"""
)
def g19_propagated_regions(spark: SparkSession, d: str) -> DataFrame:
    """Parts as regions that lines copy to suppliers."""
    big = lambda c: F.col(c).cast("bigint")
    seeds = table(spark, d, "part").select(F.col("p_partkey").alias("lineage"), F.concat(F.lit("p"), "p_partkey").alias("object"), F.lit(0).cast("bigint").alias("start"), big("p_size").alias("end"))
    n = big("l_linenumber")
    copies = table(spark, d, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("src"), n.alias("src_start"), (n + 10).alias("src_end"), F.concat(F.lit("s"), "l_suppkey").alias("dst"), (n * 2).alias("dst_start")).distinct()
    return whole(patterns.propagate_regions(seeds, copies))


def _flow(o: DataFrame, *rows: tuple) -> DataFrame:
    """inputs (f, output, input, pos, mnemonic, constant) of each row of o; what is given as a Column is the row's own."""
    as_column = lambda x, kind: (F.lit(x) if not hasattr(x, "alias") else x).cast(kind)
    kinds = (("output", "string"), ("input", "string"), ("pos", "int"), ("mnemonic", "string"), ("constant", "bigint"))
    return o.select("f", F.explode(F.array(*(F.struct(*(as_column(x, k).alias(n) for x, (n, k) in zip(r, kinds))) for r in rows))).alias("i")).select("f", "i.*")


@query(
    """SELECT o_orderkey AS f, 'i' AS phi, 'init' AS initial, 'u' AS "update", CASE WHEN o_orderstatus = 'F' THEN -(o_orderkey % 7 - 3) ELSE o_orderkey % 7 - 3 END AS step
FROM orders WHERE o_orderkey % 7 <> 3 AND NOT (o_orderstatus = 'P')"""
)
def g12_order_recurrences(spark: SparkSession, d: str) -> DataFrame:
    """Orders as loops that count by a step; with status P the step is subtracted from, which is no recurrence."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("f"), "o_orderstatus")
    s, step = F.col("o_orderstatus"), F.col("f") % 7 - 3
    first = F.when(s == "P", "c").otherwise("w")
    flow = _flow(
        o, ("i", "init", 0, "MULTIEQUAL", None), ("i", "u", 1, "MULTIEQUAL", None), ("w", "i", 0, "COPY", None), ("u", first, 0, F.when(s == "O", "INT_ADD").otherwise("INT_SUB"), F.when(s == "P", step)),
        ("u", F.when(s == "P", "w").otherwise("c"), 1, F.when(s == "O", "INT_ADD").otherwise("INT_SUB"), F.when(s != "P", step)),
    )
    return cfg.recurrences(flow, ["f"])


@query("SELECT o_orderkey AS f, 'it' AS phi, (o_custkey % 3)::INT AS slot, 1 AS place, TRUE AS kept FROM orders WHERE o_orderstatus = 'O'")
def g24_order_aliases(spark: SparkSession, d: str) -> DataFrame:
    """Orders as loops over a list from a formal (status O), or over an array."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("f"), "o_orderstatus", (F.col("o_custkey") % 3).cast("int").alias("slot"))
    again = F.when(F.col("o_orderstatus") == "O", "LOAD").otherwise("INT_ADD")
    flow = _flow(o, ("head", "p", 0, "LOAD", None), ("it", "head", 0, "MULTIEQUAL", None), ("it", "next", 1, "MULTIEQUAL", None), ("next", "it", 0, again, None))
    return patterns.container_aliases(flow, o.select("f", "slot", F.lit("p").alias("node")), ["f"])


@query("""SELECT o_orderkey AS f, 'l' AS "left", 'r' AS "right" FROM orders WHERE o_orderstatus <> 'F'""")
def d9_order_arms(spark: SparkSession, d: str) -> DataFrame:
    """Orders as branches with two arms; with status F one leads to the other."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("f"), "o_orderstatus")
    edge = lambda a, b: F.struct(F.lit(a).alias("src"), F.lit(b).alias("dst"))
    edges = o.select("f", F.explode(F.array_compact(F.array(edge("b", "l"), edge("b", "r"), edge("l", "j"), F.when(F.col("o_orderstatus") == "F", edge("r", "l")).otherwise(edge("r", "j"))))).alias("e")).select("f", "e.*")
    return cfg.exclusive_arms(edges, o.select("f", F.lit("l").alias("left"), F.lit("r").alias("right")), ["f"])


_LOOPS = """WITH x AS (SELECT l_orderkey AS f, l_linenumber::VARCHAR AS site, l_linestatus AS block, l_partkey % 4 AS a, l_suppkey % 4 AS v FROM lineitem)"""


def _stores(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return table(spark, d, "lineitem").select(c("l_orderkey").alias("f"), c("l_linenumber").cast("string").alias("site"), c("l_linestatus").alias("block"), (c("l_partkey") % 4).alias("address"), (c("l_suppkey") % 4).alias("value"))


@query(
    _LOOPS + """, j AS (SELECT *, CASE WHEN f % 3 = 0 THEN 'counted_range_no_fixed_stride_recurrence' WHEN f % 5 = 0 THEN 'counted_range_no_recurrence_bound_exit' WHEN a = 3 THEN 'counted_range_destination_not_fixed_stride' WHEN v = 2 THEN 'excluded_external_input_source'
  WHEN v = 0 AND a = 2 OR v = 1 AND a <> 2 THEN 'counted_range_source_destination_stride_mismatch' WHEN v = 3 AND f % 2 = 1 THEN 'counted_range_fill_value_not_invariant' END AS reason FROM x WHERE block = 'O')
SELECT f, site, 'h' AS header, CASE WHEN reason IS NULL THEN CASE WHEN v < 3 THEN 'COPY' ELSE 'FILL' END END AS kind, reason FROM j"""
)
def d6_counted_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Lines as stores of a loop per order: node 0 and 1 move by 4, 2 by 8, 3 doesn't; values 0 to 2 are loads, 2 an external one."""
    s = _stores(spark, d)
    f = s.select("f").distinct()
    head = lambda df: df.withColumn("header", F.lit("h"))
    many = lambda df, rows, *names: df.select("f", *(["header"] if "header" in df.columns else []), F.explode(F.array(*(F.struct(*(F.lit(x).alias(n) for x, n in zip(r, names))) for r in rows))).alias("e")).select("f", *(["header"] if "header" in df.columns else []), "e.*")
    moving = head(f).filter("f % 3 <> 0").withColumns({"phi": F.lit("i"), "step": F.lit(4)})
    return patterns.counted_ranges(
        s, head(f).withColumn("block", F.lit("O")), moving, head(f).filter("f % 5 <> 0"), many(head(f), [(0, 4), (1, 4), (2, 8)], "node", "stride"),
        many(f, [(0, 0, False), (1, 2, False), (2, 0, True)], "value", "load_address", "external"), head(f).filter("f % 2 = 0").withColumn("value", F.lit(3)), ["f"],
    )


@query(
    _LOOPS + """SELECT f, site, 'h' AS header, CASE WHEN v = 3 THEN 'sentinel_value_not_an_unchanged_load' WHEN a = 3 THEN 'sentinel_destination_not_fixed_stride' WHEN v = 2 THEN 'sentinel_source_not_fixed_stride'
  WHEN (v = 1) <> (a = 2) THEN 'sentinel_stride_mismatch' WHEN f % 2 = 1 THEN 'sentinel_exit_does_not_test_the_value' END AS reason FROM x WHERE block = 'O'"""
)
def d7_sentinel_copies(spark: SparkSession, d: str) -> DataFrame:
    s = _stores(spark, d)
    h = s.select("f").distinct().withColumn("header", F.lit("h"))
    rows = lambda df, held, *names: df.withColumn("e", F.explode(F.array(*(F.struct(*(F.lit(x).alias(n) for x, n in zip(r, names))) for r in held)))).select(*df.columns, "e.*")
    tested = rows(h.filter("f % 2 = 0"), [(0,), (1,), (2,)], "value")
    return patterns.sentinel_copies(s, h.withColumn("block", F.lit("O")), rows(h, [(0, 4), (1, 4), (2, 8)], "node", "stride"), rows(h.drop("header"), [(0, 0), (1, 2), (2, 3)], "value", "load_address"), tested, ["f"])


@query(
    """SELECT edge_id, path, CASE WHEN path IS NULL THEN CASE WHEN n > 1 THEN 'available_length_ambiguous' WHEN n = 0 THEN 'available_length_missing' ELSE 'no_source_relation' END END AS reason, count(*) AS times FROM (
  SELECT edge_id, len(context_ids) AS n, CASE WHEN len(selector_terms) > 0 THEN 'DYNAMIC_TERM' WHEN region_extent > 4 THEN 'SOURCE_CONTROLLED_LOOP' WHEN len(context_ids) = 1 THEN 'SHARED_SOURCE_LENGTH' END AS path FROM accesses WHERE edge_kind = 'READ') GROUP BY ALL"""
)
def d10_parser_reads(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "accesses").filter("edge_kind = 'READ'").select("edge_id", "selector_terms", "region_extent", "context_ids")
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c))
    return patterns.parser_reads(a, size("selector_terms") > 0, F.col("region_extent") > 4, size("context_ids")).groupBy("edge_id", "path", "reason").agg(F.count("*").alias("times"))


@query(
    """SELECT DISTINCT l_orderkey AS function, 'INSERT' AS kind, (l_partkey % 3)::INT AS container_slot, l_linenumber % 3 AS value_slot, l_linenumber * 4 AS "offset" FROM lineitem WHERE l_partkey % 3 <> l_linenumber % 3
UNION SELECT l_orderkey, 'REMOVE', (l_suppkey % 3)::INT, NULL, l_linenumber * 4 FROM lineitem WHERE l_returnflag = 'R'"""
)
def d12_container_summaries(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    n = F.col("l_linenumber").cast("int")
    stores = li.select(F.col("l_orderkey").alias("function"), (n % 3).alias("value_slot"), (F.col("l_partkey") % 3).cast("int").alias("address_slot"), (n * 4).alias("offset"))
    returns = li.select(F.col("l_orderkey").alias("function"), F.when(F.col("l_returnflag") == "R", 1).otherwise(2).alias("values"), (F.col("l_suppkey") % 3).cast("int").alias("address_slot"), (n * 4).alias("offset"))
    return patterns.container_summaries(stores, returns)


@query(
    """WITH w AS (SELECT l_partkey AS object, l_suppkey AS writer, list(DISTINCT l_linenumber) AS stored FROM lineitem WHERE l_quantity > 10 GROUP BY ALL HAVING count(DISTINCT l_linenumber) > 1),
r AS (SELECT l_partkey AS object, l_suppkey AS reader, list(DISTINCT l_linenumber) AS seen FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL HAVING count(DISTINCT l_linenumber) > 1)
SELECT object, writer, reader, array_to_string(list_sort(list_intersect(stored, seen)), ',') AS offsets FROM w JOIN r USING (object) WHERE writer <> reader AND len(list_intersect(stored, seen)) > 1"""
)
def d14_event_queues(spark: SparkSession, d: str) -> DataFrame:
    """Parts as queues between suppliers: which line numbers one stores and another dispatches."""
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("function"), F.col("l_partkey").alias("object"), F.col("l_linenumber").cast("bigint").alias("offset"), F.when(F.col("l_quantity") > 10, 4).otherwise(1).alias("size"), (F.col("l_returnflag") != "N").alias("dispatched"))
    return patterns.event_queues(li.drop("dispatched"), li.drop("size")).withColumn("offsets", F.array_join(F.col("offsets").cast("array<string>"), ","))


@query(
    """WITH f AS (SELECT 'r' || n_regionkey AS function, 'n' || n_nationkey AS caller FROM nation), t AS (SELECT 's' || s_suppkey AS caller, 'n' || s_nationkey AS function, s_name AS target FROM supplier WHERE s_acctbal > 0 UNION ALL SELECT 's' || s_suppkey, 'r' || s_nationkey % 5, s_name FROM supplier WHERE s_acctbal <= 0),
found AS (SELECT DISTINCT caller, function, target FROM t WHERE function IN (SELECT caller FROM f) OR function IN (SELECT function FROM f)), n AS (SELECT function, count(DISTINCT target) AS n FROM found GROUP BY 1)
SELECT caller, function, target, NULL AS reason FROM found JOIN n USING (function) WHERE n <= 4 UNION ALL SELECT NULL, function, NULL, 'callback_target_budget_exhausted' FROM n WHERE n > 4"""
)
def d15_callback_registrations(spark: SparkSession, d: str) -> DataFrame:
    """Regions store callbacks, nations forward theirs to their region, suppliers pass one to their nation or to a region."""
    n, s = table(spark, d, "nation"), table(spark, d, "supplier")
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string") if isinstance(c, str) else c.cast("string"))
    stored = n.select(name("r", "n_regionkey").alias("function"), F.lit(0).alias("slot")).distinct()
    up = n.select(name("n", "n_nationkey").alias("caller"), name("r", "n_regionkey").alias("callee"), F.lit(0).alias("slot"), F.lit(0).alias("caller_slot"), F.lit(None).cast("string").alias("target"))
    passed = s.select(name("s", "s_suppkey").alias("caller"), F.when(F.col("s_acctbal") > 0, name("n", "s_nationkey")).otherwise(name("r", F.col("s_nationkey") % 5)).alias("callee"), F.lit(0).alias("slot"), F.lit(None).cast("int").alias("caller_slot"), F.col("s_name").alias("target"))
    good, many = patterns.callback_registrations(stored, up.unionByName(passed), most=4)
    return good.select("caller", "function", "target", F.lit(None).cast("string").alias("reason")).unionByName(many.select(F.lit(None).cast("string").alias("caller"), "function", F.lit(None).cast("string").alias("target"), "reason"))


@query("SELECT l_orderkey AS f, 'h' AS header, l_partkey AS base, least(l_linenumber, 100) AS site_a, l_linenumber + 100 AS site_b FROM lineitem WHERE l_returnflag = 'R'")
def g28_in_place_swaps(spark: SparkSession, d: str) -> DataFrame:
    """Lines as two transfers of a loop; with return flag R they exchange their places."""
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("f"), F.col("l_partkey").alias("base"), F.col("l_linenumber").alias("n"), F.col("l_returnflag").alias("flag"))
    place = lambda p: F.concat(F.lit(p), F.col("n").cast("string"))
    one = F.struct(F.col("n").alias("site"), place("x").alias("dst"), place("y").alias("src"))
    two = F.struct((F.col("n") + 100).alias("site"), F.when(F.col("flag") == "R", place("y")).otherwise(place("z")).alias("dst"), place("x").alias("src"))
    t = li.select("f", F.lit("h").alias("header"), "base", F.explode(F.array(one, two)).alias("t")).select("f", "header", "base", "t.*")
    return patterns.in_place_swaps(t, ["f"])


@query(
    """SELECT l_orderkey AS f, l_linenumber AS site, CASE WHEN l_returnflag = 'N' THEN 'reservation_update_does_not_add' WHEN l_returnflag = 'A' THEN 'reservation_return_does_not_depend_on_old_value' WHEN l_linestatus = 'O' THEN 'reservation_pointer_is_the_updated_field' END AS reason, count(DISTINCT (l_partkey, l_suppkey, l_returnflag, l_linestatus)) AS n FROM lineitem GROUP BY ALL"""
)
def g28_buffer_reservations(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("f"), F.col("l_linenumber").alias("site"), F.lit("b").alias("base"), F.lit(0).alias("field"), F.concat_ws("/", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus").alias("old_value"), "l_returnflag", "l_linestatus")
    updates = li.select("f", "site", "base", "field", "old_value", F.when(F.col("l_returnflag") != "N", "add").otherwise("sub").alias("direction"))
    returns = li.filter("l_returnflag <> 'A'").select("f", F.col("site").alias("return_site"), "base", F.when(F.col("l_linestatus") == "O", 0).otherwise(1).alias("pointer_field"), F.col("old_value").alias("value")).distinct()
    return patterns.buffer_reservations(updates, returns, ["f"]).groupBy("f", "site", "reason").agg(F.count("*").alias("n"))


@query(
    """SELECT o_orderkey AS f, 'a' AS root, CASE WHEN r IS NULL THEN 'i' END AS phi, CASE WHEN r IS NULL THEN 4 * (o_orderkey % 7 - 3) END AS stride, r AS reason FROM (
  SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 3 THEN 'address_does_not_move' WHEN o_orderstatus = 'F' THEN 'address_moves_by_several_recurrences' WHEN o_custkey % 2 = 1 THEN 'address_has_a_varying_term' END AS r FROM orders)"""
)
def g12_address_progressions(spark: SparkSession, d: str) -> DataFrame:
    """Orders as loops over an address base + 4 i + 12, with j (status F) or a base that varies (odd customers)."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("f"), "o_orderstatus", "o_custkey")
    other = F.when(F.col("o_orderstatus") == "F", "j").otherwise("base")
    flow = _flow(o, ("m", "i", 0, "INT_MULT", None), ("m", "4", 1, "INT_MULT", 4), ("s", other, 0, "INT_ADD", None), ("s", "m", 1, "INT_ADD", None), ("a", "s", 0, "INT_ADD", None), ("a", "12", 1, "INT_ADD", 12))
    step = (F.col("f") % 7 - 3).cast("bigint")
    phis = o.filter("f % 7 <> 3").select("f", F.explode(F.array(F.lit("i"), F.lit("j"))).alias("phi"), step.alias("step"))
    terms = cfg.affine_terms(flow, o.select("f", F.lit("a").alias("root")), ["f"])
    return cfg.address_progressions(terms, phis, o.filter("o_custkey % 2 = 0").select("f", F.lit("base").alias("value")), ["f"])


@query(
    """SELECT l_orderkey AS f, 'i' AS phi, l_linenumber AS site, CASE WHEN l_returnflag = 'A' THEN '9' ELSE 'n' END AS bound, 'INT_LESS' AS mnemonic, l_linestatus = 'O' AS swapped FROM lineitem
WHERE l_returnflag = 'A' OR (l_returnflag = 'R' AND l_orderkey % 2 = 0) GROUP BY ALL"""
)
def g12_loop_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Lines as exit tests of i or its update against a number (flag A) or n, which stays the same in even orders; other tests are of k."""
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("f"), F.col("l_linenumber").alias("site"), "l_returnflag", "l_linestatus")
    flag, swapped = F.col("l_returnflag"), F.col("l_linestatus") == "O"
    value = F.when(flag == "N", "k").when(F.col("site") % 2 == 0, "u").otherwise("i")
    bound, number = F.when(flag == "A", "9").otherwise("n"), F.when(flag == "A", F.lit(9))
    tests = li.select(
        "f", "site", F.lit("INT_LESS").alias("mnemonic"), F.when(swapped, bound).otherwise(value).alias("left"), F.when(swapped, value).otherwise(bound).alias("right"), F.when(swapped, number).alias("left_constant"), F.when(~swapped, number).alias("right_constant")
    )
    f = li.select("f").distinct()
    return cfg.loop_bounds(tests, f.select("f", F.lit("i").alias("phi"), F.lit("u").alias("update")), f.filter("f % 2 = 0").select("f", F.lit("n").alias("value")), ["f"])


@query(
    _LOOPS + """, j AS (SELECT *, CASE WHEN v = 2 THEN 'excluded_external_input_mmio_to_buffer_source' WHEN v = 1 THEN 'stateful_loop_source_not_uniquely_formal_bound' END AS reason FROM x WHERE block = 'O' AND v < 3 AND (v = 2 OR a < 2))
SELECT f, site, 'h' AS header, CASE WHEN reason IS NULL THEN 5 END AS source_slot, CASE WHEN reason IS NULL AND a = 0 THEN 7 END AS destination_slot, CASE WHEN reason IS NULL THEN 's' || a END AS state, reason FROM j"""
)
def g28_stateful_loop_writes(spark: SparkSession, d: str) -> DataFrame:
    """Lines as stores of a loop per order: addresses 0 and 1 move through state; values 0 to 2 are loads, 2 an external one, 1 of two formals."""
    s = _stores(spark, d)
    f = s.select("f").distinct()
    h = f.withColumn("header", F.lit("h"))
    rows = lambda df, held, *names: df.withColumn("e", F.explode(F.array(*(F.struct(*(F.lit(x).alias(n) for x, n in zip(r, names))) for r in held)))).select(*df.columns, "e.*")
    loads = rows(f, [(0, "l0", 10, False), (1, "l1", 11, False), (2, "l2", 10, True)], "value", "load_site", "load_address", "external")
    states = rows(h, [(0, "s0", "u1"), (0, "s9", "u2"), (1, "s1", "u1")], "address", "state", "update_site")
    slots = rows(f, [(10, 5), (11, 5), (11, 6), (0, 7)], "node", "slot")
    return patterns.stateful_loop_writes(s, h.withColumn("block", F.lit("O")), loads, states, slots, ["f"])


@query(
    """SELECT o_orderkey AS f, 'a' AS root, CASE k WHEN 0 THEN 'obj:b' WHEN 1 THEN 'obj:b' WHEN 4 THEN 'obj:ram:20000010' WHEN 5 THEN 'obj:b' END AS object, CASE k WHEN 0 THEN 12 WHEN 4 THEN 0 WHEN 5 THEN 20 END AS "offset", k = 1 AS dynamic,
  CASE k WHEN 2 THEN 'address_has_several_bases' WHEN 3 THEN 'address_scales_its_base' WHEN 6 THEN 'address_has_no_known_base' END AS reason FROM (SELECT o_orderkey, o_orderkey % 7 AS k FROM orders)"""
)
def g20_resolved_objects(spark: SparkSession, d: str) -> DataFrame:
    """Orders as addresses: base + 8, base + i, base + base', 2 base, a number, a merge of two equal places + 4, a merge of two places + 4."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("f"), (F.col("o_orderkey") % 7).alias("k"))
    k = F.col("k")
    left = F.when(k.isin(0, 1, 2), "b").when(k == 3, "m").when(k == 4, "n0").otherwise("p")
    right = F.when(k == 0, "8").when(k == 1, "i").when(k == 2, "c").when(k == 3, "0").when(k == 4, "n1").otherwise("4")
    number = F.when(k == 0, 8).when(k == 3, 0).when(k == 4, 16).when(k > 4, 4)
    flow = _flow(o, ("a", left, 0, "INT_ADD", F.when(k == 4, 536870912)), ("a", right, 1, "INT_ADD", number), ("m", "b", 0, "INT_MULT", None), ("m", "2", 1, "INT_MULT", 2), ("x", "b", 0, "INT_ADD", None), ("x", "12", 1, "INT_ADD", 12), ("y", F.when(k == 6, "c").otherwise("b"), 0, "INT_ADD", None), ("y", "12", 1, "INT_ADD", 12))
    roots = o.select("f", F.explode(F.array(F.lit("a"), F.lit("x"), F.lit("y"))).alias("root"))
    bases = o.select("f", F.explode(F.array(F.struct(F.lit("b").alias("node"), F.lit("obj:b").alias("object")), F.struct(F.lit("c").alias("node"), F.lit("obj:c").alias("object")))).alias("e")).select("f", "e.*", F.lit(4).cast("bigint").alias("at"))
    merges = o.select("f", F.lit("p").alias("output"), F.explode(F.array(F.lit("x"), F.lit("y"))).alias("input"))
    return patterns.resolve_objects(cfg.affine_terms(flow, roots, ["f"]), bases, merges, ["f"]).filter("root = 'a'")
