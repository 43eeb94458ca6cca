"""Queries of scalar and graph rules over whole tables, some over inputs derived from them by projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factweave.functions import text
from factweave.operators import graph, joins, json_columns, match, nested, rank, selection, trace
from factweave.operators.fixpoint import whole
from factweave.plans.corpus_sql import nodes_cte
from factweave.session import scratch, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_PARTS = "CASE p_size % 6 WHEN 0 THEN 'compat:' || lower(p_brand) || '_x' WHEN 1 THEN 'a.b.Handle_' || p_size || '(x)' WHEN 2 THEN ' Mod.get_NVRAM_' || p_size WHEN 3 THEN 'recv_from(' || p_size || ')' WHEN 4 THEN '' END"


@query(
    f"""WITH t AS (SELECT p_partkey, {_PARTS} AS t, p_partkey % 2 = 0 AS x FROM part)
SELECT p_partkey, CASE WHEN t IS NULL OR t = '' THEN '' WHEN t LIKE 'compat:%' THEN regexp_extract(t, 'compat:([a-z0-9_]+)', 1) WHEN t LIKE '%NVRAM%' THEN 'nvram' WHEN t LIKE 'recv%' THEN 'recv' WHEN x THEN regexp_extract(t, 'Handle_([0-9]+)', 1) ELSE lower(split_part(t, '(', 1)) END AS name FROM t"""
)
def f_provenance_names(spark: SparkSession, d: str) -> DataFrame:
    t = F.expr(_PARTS)
    return table(spark, d, "part").select("p_partkey", text.provenance_name(t, "compat", F.col("p_partkey") % 2 == 0).alias("name"))


_TIMES = "CASE o_orderkey % 5 WHEN 0 THEN o_custkey || 's' WHEN 1 THEN o_custkey || 'm' WHEN 2 THEN (o_custkey % 24) || ':' || (o_custkey % 60) || ':30.5' WHEN 3 THEN (o_custkey % 60) || ':07' ELSE 'soon' END"


@query(
    """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN o_custkey::DOUBLE WHEN 1 THEN o_custkey * 60.0 WHEN 2 THEN (o_custkey % 24) * 3600.0 + (o_custkey % 60) * 60.0 + 30.5 WHEN 3 THEN (o_custkey % 60) * 60.0 + 7 END AS seconds FROM orders"""
)
def f_duration_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", text.seconds(F.expr(_TIMES)).alias("seconds"))


@query(
    """SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL ELSE '{"k":' || (props->>'k') || ',"x":' || (event_id % 16) || '}' END AS object, CASE event_id % 4 WHEN 0 THEN 'STRICT' WHEN 3 THEN 'UNREADABLE' ELSE 'REPAIRED' END AS how FROM events"""
)
def f_json_repair(spark: SparkSession, d: str) -> DataFrame:
    """Events as answers: bare objects, fenced ones, ones with text around and hex numbers, and broken ones."""
    k, x = F.get_json_object("props", "$.k"), F.col("event_id") % 16
    bare = F.concat(F.lit('{"x": '), x.cast("string"), F.lit(', "k": '), k, F.lit("}"))
    hexed = F.concat(F.lit('Here: {"x": 0x'), F.lower(F.hex(x)), F.lit(', "k": '), k, F.lit("} so"))
    n = F.col("event_id") % 4
    answer = F.when(n == 0, bare).when(n == 1, F.concat(F.lit("```json\n"), bare, F.lit("\n```"))).when(n == 2, hexed).otherwise(F.lit('{"x": '))
    return json_columns.json_objects(table(spark, d, "events").select("event_id", answer.alias("answer")), "event_id", "answer").select(F.col("row_id").alias("event_id"), "object", "how")


@query(
    """SELECT file_id, count(*) AS strings, min(s) AS least, max(s) AS greatest FROM (SELECT file_id, t.atom->>'$' AS s FROM artifact_files, json_tree(payload) t WHERE json_valid(payload) AND t.type = 'VARCHAR') GROUP BY file_id"""
)
def f_json_strings(spark: SparkSession, d: str) -> DataFrame:
    """The strings of every artifact file, at any depth."""
    s = json_columns.json_strings(table(spark, d, "artifact_files"), "file_id", "payload")
    return s.groupBy(F.col("row_id").alias("file_id")).agg(F.count("*").alias("strings"), F.min("value").alias("least"), F.max("value").alias("greatest"))


@query(
    f"""{nodes_cte()},
val AS (SELECT record_id, fi, oi, node_kind, CASE WHEN node->>'space' = 'const' THEN 'c' || coalesce(nullif(node->>'value_id', ''), node->>'object_id', '') ELSE coalesce(node->>'size', '') END AS sig, pos, vi FROM n WHERE node_kind IN ('input', 'output')),
side AS (SELECT record_id, fi, oi, coalesce(string_agg(sig, ',' ORDER BY pos, vi) FILTER (WHERE node_kind = 'input'), '') AS ins, coalesce(string_agg(sig, ',' ORDER BY pos, vi) FILTER (WHERE node_kind = 'output'), '') AS outs FROM val GROUP BY ALL),
shaped AS (SELECT n.record_id, n.fi, sha256(string_agg((node->>'mnemonic') || '(' || coalesce(ins, '') || ')' || coalesce(outs, ''), ';' ORDER BY n.oi)) AS shape FROM n LEFT JOIN side s ON s.record_id = n.record_id AND s.fi = n.fi AND s.oi = n.oi WHERE node_kind = 'op' GROUP BY n.record_id, n.fi)
SELECT shape, count(*) AS functions, count(DISTINCT record_id) AS records FROM shaped GROUP BY shape"""
)
def f_body_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Classes of functions whose operations have the same shape, whatever their addresses."""
    path = scratch(spark, "facts")
    nested.write_tagged(nested.emit_tagged(table(spark, d, "program_facts")), path)
    return nested.body_shapes(*(nested.read_table(spark, path, t) for t in ("op", "input", "output"))).groupBy("shape").agg(F.count("*").alias("functions"), F.count_distinct("record_id").alias("records"))


_TREE = "WITH f AS (SELECT s_suppkey AS k FROM supplier), c AS (SELECT k AS caller, k * 2 AS callee, CASE WHEN k % 3 = 0 THEN 'CALLIND' ELSE 'CALL' END AS m FROM f WHERE k > 0 AND k * 2 IN (SELECT k FROM f) UNION ALL SELECT k, k * 2 + 1, 'CALL' FROM f WHERE k > 0 AND k * 2 + 1 IN (SELECT k FROM f))"


def _tree(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers as functions of a call tree: k calls 2k, indirectly if 3 divides k, and 2k + 1."""
    k = F.col("s_suppkey")
    s = table(spark, d, "supplier")
    names = F.when(k == 3, "main").when(k % 29 == 0, "net_Worker").otherwise("FUN")
    f = s.select(k.alias("function"), names.alias("name"), (k % 17 == 0).alias("interrupt"), (k % 23 == 0).alias("entry"))
    c = s.filter(k > 0).select(k.alias("caller"), F.explode(F.array(F.struct((k * 2).alias("callee"), F.when(k % 3 == 0, "CALLIND").otherwise("CALL").alias("mnemonic")), F.struct((k * 2 + 1).alias("callee"), F.lit("CALL").alias("mnemonic")))).alias("c")).select("caller", "c.*")
    return f, c


@query(
    _TREE.replace("WITH f", "WITH RECURSIVE f") + """, r AS (SELECT k, 'ctx:isr:' || k AS ctx, 'CALLGRAPH_FROM_VECTOR_ISR' AS p FROM f WHERE k % 17 = 0 UNION SELECT k, 'ctx:main', 'CALLGRAPH_FROM_MAIN' FROM f WHERE k = 3
  UNION SELECT k, 'ctx:task:' || k, 'CALLGRAPH_FROM_HEURISTIC_TASK_ENTRY' FROM f WHERE k % 29 = 0 AND k <> 3 UNION SELECT c.callee, r.ctx, r.p FROM r JOIN c ON c.caller = r.k AND m = 'CALL')
SELECT k AS function, coalesce((SELECT string_agg(DISTINCT ctx, ',' ORDER BY ctx) FROM r WHERE r.k = f.k), 'ctx:unknown') AS contexts, coalesce((SELECT string_agg(DISTINCT p, '+' ORDER BY p) FROM r WHERE r.k = f.k), 'UNKNOWN_EXECUTION_CONTEXT') AS provenance FROM f"""
)
def g3_execution_contexts(spark: SparkSession, d: str) -> DataFrame:
    return graph.execution_contexts(*_tree(spark, d)).withColumn("contexts", F.array_join("contexts", ","))


@query(
    _TREE.replace("WITH f", "WITH RECURSIVE f") + """, r AS (SELECT k, 'ctx:isr:' || k AS ctx, 'DETERMINISTIC_VECTOR_ISR' AS p FROM f WHERE k % 17 = 0 UNION SELECT k, 'ctx:main', 'DETERMINISTIC_MAIN_SYMBOL' FROM f WHERE k = 3
  UNION SELECT k, 'ctx:entry:' || k, 'DETERMINISTIC_PROGRAM_ENTRY' FROM f WHERE k % 23 = 0 UNION SELECT k, 'ctx:task:1', 'GIVEN' FROM f WHERE k = 5 UNION SELECT c.callee, r.ctx, r.p || CASE m WHEN 'CALLIND' THEN '+EXACT_CALLIND' ELSE '+DIRECT_CALL' END FROM r JOIN c ON c.caller = r.k)
SELECT k AS function, coalesce((SELECT string_agg(DISTINCT ctx, ',' ORDER BY ctx) FROM r WHERE r.k = f.k), '') AS contexts, coalesce((SELECT string_agg(DISTINCT p, '+' ORDER BY p) FROM r WHERE r.k = f.k), 'NO_DETERMINISTIC_EXECUTION_CONTEXT') AS provenance FROM f"""
)
def g3_deterministic_contexts(spark: SparkSession, d: str) -> DataFrame:
    given = spark.createDataFrame([(5, "ctx:task:1", "GIVEN"), (-1, "ctx:task:2", "GIVEN")], "function bigint, context string, provenance string")
    return graph.execution_contexts(*_tree(spark, d), explicit=given, deterministic=True).withColumn("contexts", F.array_join("contexts", ","))


@query(
    """WITH p AS (SELECT DISTINCT p_partkey AS a FROM part), r AS (SELECT s_suppkey * 17 AS s, s_suppkey * 17 + s_nationkey AS e, s_name AS n FROM supplier), t AS (SELECT a, arg_min(s, (e - s, s, n)) AS s, arg_min(n, (e - s, s, n)) AS n FROM p JOIN r ON a BETWEEN s AND e GROUP BY a),
x AS (SELECT c_custkey AS a, min(c_name) AS n FROM customer WHERE c_custkey % 3 = 0 GROUP BY 1)
SELECT a AS address, coalesce(t.s, a) AS base, coalesce(t.n, x.n, '') AS name, CASE WHEN t.s IS NOT NULL THEN 'ELF_OBJECT_SYMBOL_RANGE' WHEN x.n IS NOT NULL THEN 'ELF_SYMBOL_EXACT_ADDRESS' ELSE 'EXACT_ADDRESS' END AS identity FROM p LEFT JOIN t USING (a) LEFT JOIN x USING (a)"""
)
def j5_object_for_address(spark: SparkSession, d: str) -> DataFrame:
    """Parts as addresses, suppliers as sized symbols, some customers as bare ones."""
    s, c = table(spark, d, "supplier"), table(spark, d, "customer")
    ranges = s.select((F.col("s_suppkey") * 17).alias("start"), (F.col("s_suppkey") * 17 + F.col("s_nationkey")).alias("end"), F.col("s_name").alias("name"))
    return joins.object_for_address(table(spark, d, "part"), ranges, c.filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("address"), F.col("c_name").alias("name")), "p_partkey")


@query(
    r"""SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_size % 5 = 0 THEN 'missing_format_parameter' WHEN p_size % 5 IN (1, 2) THEN 'literal_format' WHEN p_partkey % 2 = 0 THEN 'readonly_format_object' END AS reason FROM part"""
)
def sel_format_exclusions(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_size") % 5
    e = F.when(n == 1, '"%s\\n"').when(n == 2, F.concat(F.lit('"a\\"b" "'), "p_type", F.lit('"'))).when(n == 3, F.concat(F.lit('"'), "p_brand", F.lit('" + x'))).otherwise("fmt")
    return table(spark, d, "part").select("p_partkey", selection.format_exclusion(F.col("p_partkey") % 7 != 0, n != 0, e, F.col("p_partkey") % 2 == 0).alias("reason"))


@query("SELECT edge_id, candidate_class, coalesce(candidate_class IN (SELECT candidate_class FROM accesses WHERE candidate_class LIKE '%A%'), FALSE) OR coalesce(access_width = 1, FALSE) AS audit_only, count(*) AS n FROM accesses GROUP BY ALL")
def sel_audit_partition(spark: SparkSession, d: str) -> DataFrame:
    """Accesses of audit-only classes, and those that say so themselves."""
    a = table(spark, d, "accesses").select("edge_id", "candidate_class", (F.col("access_width") == 1).alias("audit_only"))
    specs = a.select(F.col("candidate_class").alias("id"), F.col("candidate_class").like("%A%").alias("audit_only")).filter("id IS NOT NULL").distinct()
    return selection.audit_partition(a, specs, "candidate_class").groupBy("edge_id", "candidate_class", "audit_only").agg(F.count("*").alias("n"))


@query(
    """SELECT source_id, coalesce(source_kind = 'mmio' AND regexp_matches(coalesce(source_label, ''), '_[0-9a-f]*[13579]') AND regexp_matches(coalesce(site_id, ''), ':[0-9]+$'), FALSE) AS fits, count(*) AS n FROM sources GROUP BY ALL"""
)
def sel_site_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Sources against an expected kind, a pattern of the label and one of the site."""
    none = F.lit(None).cast("array<string>")
    fits = match.site_matches(F.col("source_label"), F.col("source_kind"), F.lit("mmio"), none, none, F.lit("_[0-9a-f]*[13579]"), F.col("site_id"), F.lit(":[0-9]+$"))
    return table(spark, d, "sources").select("source_id", fits.alias("fits")).groupBy("source_id", "fits").agg(F.count("*").alias("n"))


@query("WITH t AS (SELECT DISTINCT word AS token FROM common_words WHERE word IS NOT NULL AND length(word) > 5) SELECT DISTINCT doc_id, token FROM documents JOIN t ON contains(text, token)")
def sel_substring_audit(spark: SparkSession, d: str) -> DataFrame:
    """Documents that contain a longer common word anywhere, within words, too."""
    tokens = table(spark, d, "common_words").filter("length(word) > 5")
    return match.substring_hits(table(spark, d, "documents"), "doc_id", "text", tokens, "word").distinct()


@query(
    """SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'INVALID_WRITE:pc=0x' || lower(to_hex(o_custkey)) || ':addr=0x20' WHEN 1 THEN 'UC_ERR_MAP' WHEN 2 THEN 'SIGNAL:11' WHEN 3 THEN 'SIGNAL:' || (o_custkey % 60) WHEN 4 THEN 'SIGNAL:9' WHEN 5 THEN 'CRASH_DETECTED' END AS signature FROM orders"""
)
def t5_fault_signatures(spark: SparkSession, d: str) -> DataFrame:
    """Orders as runs with a log and an exit code."""
    n, c = F.col("o_orderkey") % 7, F.col("o_custkey")
    access = F.concat(F.lit("[0x0001] INVALID READ: addr= 0x10\n[ 0x000"), F.lower(F.hex(c)), F.lit(" ] invalid write: addr=0x0020 UC_ERR_MAP"))
    log = F.when(n == 0, access).when(n == 1, "uc_err_read UC_ERR_MAP UC_ERR_OK").when(n == 2, "Emulation crashed with signal 7, Emulation crashed with signal 011").when(n == 5, "** crash detected **").otherwise("done")
    code = F.when(n == 3, -(c % 60)).when(n == 4, 137).when(n == 2, -6).otherwise(1)
    code = F.when((n == 3) & (c % 60 == 0), 128).otherwise(code)
    return table(spark, d, "orders").select("o_orderkey", trace.fault_signature(log, code).alias("signature"))


@query(
    """WITH o AS (SELECT user_id AS object, event_id AS ordinal, event_id % 11 / 10 AS confidence, event_id % 7 / 6 AS quality, event_id % 5 / 4 AS ambiguity, event_id % 4 = 0 AS buffer, CASE event_id % 3 WHEN 0 THEN ['DMA', 'ISR'] WHEN 1 THEN ['ISR', 'MAIN', 'UNKNOWN'] ELSE ['MAIN'] END AS p, CASE WHEN event_id % 2 = 0 THEN ['MAIN', 'TASK'] ELSE ['TASK', 'UNKNOWN', 'DMA'] END AS c FROM events),
x AS (SELECT *, unnest(p) AS src, generate_subscripts(p, 1) AS i FROM o), y AS (SELECT *, unnest(c) AS dst, generate_subscripts(c, 1) AS j FROM x),
z AS (SELECT *, 0.55 * confidence + 0.35 * quality - 0.15 * ambiguity AS base FROM y WHERE src <> dst AND NOT (src IN ('DMA', 'ISR') AND dst = 'TASK') AND (src = 'DMA' OR (src <> 'UNKNOWN' AND dst <> 'UNKNOWN'))),
s AS (SELECT *, CASE WHEN src = 'DMA' THEN least(1, base + 0.1) ELSE base END AS dma FROM z), w AS (SELECT *, CASE WHEN buffer THEN least(1, dma + 0.05) ELSE dma END AS score FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY object, ordinal ORDER BY score DESC, i, j) AS place FROM w QUALIFY place <= 2)
SELECT object, src, dst, round(arg_min(score, ordinal), 4) AS score, arg_min(place, ordinal) AS place FROM k GROUP BY object, src, dst"""
)
def d2_scored_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Events as rows of their users' objects, with contexts and scores by their numbers."""
    n = F.col("event_id")
    words = lambda *w: F.array(*(F.lit(x) for x in w))
    producers = F.when(n % 3 == 0, words("DMA", "ISR")).when(n % 3 == 1, words("ISR", "MAIN", "UNKNOWN")).otherwise(words("MAIN"))
    consumers = F.when(n % 2 == 0, words("MAIN", "TASK")).otherwise(words("TASK", "UNKNOWN", "DMA"))
    o = table(spark, d, "events").select(
        F.col("user_id").alias("object"), n.alias("ordinal"), producers.alias("producers"), consumers.alias("consumers"), (n % 11 / 10).alias("confidence"), (n % 7 / 6).alias("quality"), (n % 5 / 4).alias("ambiguity"), (n % 4 == 0).alias("dma_buffer")
    )
    return rank.context_pairs(o, 2)


@query(
    """SELECT edge_id, coalesce(access_width = 1, FALSE) OR regexp_matches(upper(concat_ws(' ', edge_id, object_id, candidate_class, storage_kind, base_object_id, edge_kind, site_id, value_id)), 'HEURISTIC|LEGACY|FALLBACK|CLUSTER|MAY_ALIAS|APPROX') AS rejected, count(*) AS n FROM accesses GROUP BY ALL"""
)
def sel_heuristic_edges(spark: SparkSession, d: str) -> DataFrame:
    """Accesses that strict analysis rejects, by eight texts and a flag; the narrowest say that they aren't deterministic."""
    texts = [F.col(c) for c in ("edge_id", "object_id", "candidate_class", "storage_kind", "base_object_id", "edge_kind", "site_id", "value_id")]
    rejected = selection.heuristic_edge(texts, F.col("access_width") != 1, F.lit(None).cast("boolean"))
    return table(spark, d, "accesses").select("edge_id", rejected.alias("rejected")).groupBy("edge_id", "rejected").agg(F.count("*").alias("n"))


@query(
    """WITH c AS (SELECT l_partkey || '/' || l_suppkey AS candidate, CASE WHEN l_partkey % 9 = 0 THEN '' ELSE 'o' || l_partkey % 50 END AS object_id, list(DISTINCT CASE WHEN l_returnflag = 'N' THEN '' ELSE l_returnflag END) AS lineage, count(*) FILTER (WHERE l_linestatus = 'O') AS writers,
  count(*) FILTER (WHERE l_linestatus = 'F') AS readers, coalesce(bit_xor(l_linenumber) FILTER (WHERE l_linestatus = 'O'), 0) AS wp, coalesce(bit_xor(l_linenumber) FILTER (WHERE l_linestatus = 'F'), 0) AS rp, l_suppkey % 5 AS k FROM lineitem GROUP BY l_partkey, l_suppkey),
r AS (SELECT *, list_sort(list_filter(lineage, lambda x: x <> '')) AS ls, CASE k WHEN 4 THEN 'NONE' WHEN 3 THEN 'OBJECT_REFERENCE' ELSE 'MEMORY_CONTENT' END AS t FROM c),
w AS (SELECT *, concat_ws(',', CASE WHEN object_id = '' THEN 'shared_object_identity_missing' END, CASE WHEN len(ls) = 0 THEN 'shared_object_has_no_source_association' END, CASE WHEN writers = 0 THEN 'shared_object_has_no_writer' END, CASE WHEN readers = 0 THEN 'shared_object_has_no_reader' END,
  CASE WHEN t = 'NONE' THEN 'shared_object_transfer_semantics_unknown' END, CASE WHEN k = 0 THEN 'source_derived_stack_local_not_shared' END) AS reasons FROM r),
f AS (SELECT min(candidate) AS first FROM w WHERE reasons = '' GROUP BY object_id, t, ls, writers, wp, readers, rp)
SELECT candidate, reasons, reasons = '' AND candidate IN (SELECT first FROM f) AS admitted, reasons = '' AND candidate NOT IN (SELECT first FROM f) AS duplicate FROM w"""
)
def sel_shared_contract(spark: SparkSession, d: str) -> DataFrame:
    """Parts of suppliers as shared objects: open lines write, finished ones read, returns are their lineage."""
    n, status = F.col("l_linenumber"), F.col("l_linestatus")
    prints = lambda s: F.coalesce(F.bit_xor(F.when(status == s, n)), F.lit(0))
    g = table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(
        F.collect_set(F.when(F.col("l_returnflag") == "N", "").otherwise(F.col("l_returnflag"))).alias("lineage"), F.count_if(status == "O").alias("writers"), F.count_if(status == "F").alias("readers"), prints("O").alias("writer_print"), prints("F").alias("reader_print")
    )
    k = F.col("l_suppkey") % 5
    c = g.select(
        F.concat_ws("/", "l_partkey", "l_suppkey").alias("candidate"), F.when(F.col("l_partkey") % 9 == 0, "").otherwise(F.concat(F.lit("o"), F.col("l_partkey") % 50)).alias("object_id"), "lineage", "writers", "readers", "writer_print", "reader_print",
        F.when(k == 4, "NONE").when(k == 3, "OBJECT_REFERENCE").otherwise("MEMORY_CONTENT").alias("transfer"), F.when(k == 0, "STACK_LOCAL").otherwise("STATIC_WRITABLE_DATA").alias("storage_kind"),
    )
    return selection.shared_contract(c).withColumn("reasons", F.array_join("reasons", ","))


@query("SELECT props AS document, count(*) AS times FROM (SELECT json(props)::VARCHAR AS props FROM events) GROUP BY 1")
def u2_distinct_documents(spark: SparkSession, d: str) -> DataFrame:
    """Distinct documents of the events by their canonical JSON, with how often each occurs."""
    return table(spark, d, "events").groupBy(text.canonical_json(F.col("props")).alias("document")).agg(F.count("*").alias("times"))


@query(
    """WITH r AS (SELECT user_id, event_id, ts, lag(event_id) OVER w AS write_id, lag(event_id * 4) OVER w AS write_pc FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
f AS (SELECT user_id, max(event_id) * 4 + 6 AS fault_pc, max(event_id) * 4 - 400 AS s, max(event_id) * 4 + 4 AS t, min(event_id) * 4 AS es, max(event_id) * 4 - 40 AS et FROM events GROUP BY 1),
h AS (SELECT r.user_id, event_id, event_id * 4 AS pc, write_id, write_pc FROM r JOIN f USING (user_id) WHERE write_id IS NOT NULL AND event_id * 4 >= s AND event_id * 4 < t AND (fault_pc & ~1) - event_id * 4 BETWEEN 0 AND 8 AND write_pc >= es AND write_pc < et)
SELECT user_id, max(event_id) AS event_id, arg_max(pc, event_id) AS pc, arg_max(write_id, event_id) AS write_id, arg_max(write_pc, event_id) AS write_pc FROM h GROUP BY 1"""
)
def t3_causal_faults(spark: SparkSession, d: str) -> DataFrame:
    """Users as runs whose last event reads what the one before wrote and then fails."""
    e = table(spark, d, "events").select("user_id", "event_id")
    w = Window.partitionBy("user_id").orderBy("event_id")
    reads = e.select("user_id", "event_id", F.lit(0).alias("line_no"), (F.col("event_id") * 4).alias("pc"), F.lit(0).alias("address"), F.lag("event_id").over(w).alias("write_id"), F.lag(F.col("event_id") * 4).over(w).alias("write_pc")).filter("write_id IS NOT NULL")
    g = e.groupBy("user_id").agg((F.max("event_id") * 4).alias("last"), (F.min("event_id") * 4).alias("first"))
    faults = g.select("user_id", (F.col("last") + 6).alias("fault_pc"), (F.col("last") - 400).alias("start"), (F.col("last") + 4).alias("end"))
    effects = g.select("user_id", F.col("first").alias("effect_start"), (F.col("last") - 40).alias("effect_end"))
    return trace.causal_fault(reads, faults, effects, ["user_id"]).select("user_id", "event_id", "pc", "write_id", "write_pc")


@query(
    """WITH RECURSIVE e AS (SELECT s_suppkey AS a, s_suppkey * 2 AS b, 0 AS cost FROM supplier WHERE s_suppkey % 2 = 1 UNION ALL SELECT s_suppkey * 2, s_suppkey, 0 FROM supplier WHERE s_suppkey % 2 = 1 UNION ALL SELECT s_suppkey, s_suppkey + 1, 1 FROM supplier WHERE s_nationkey % 3 = 0),
r AS (SELECT s_suppkey AS lineage, s_suppkey AS node, 0 AS helpers FROM supplier UNION SELECT lineage, b, helpers + cost FROM r JOIN e ON a = node WHERE helpers + cost <= 2) SELECT lineage, node, min(helpers) AS helpers FROM r GROUP BY 1, 2"""
)
def g14_two_way_lineage(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as functions: odd ones call their double, and some return through the next; lineages run along and against calls."""
    k, s = F.col("s_suppkey"), table(spark, d, "supplier")
    calls = s.filter(k % 2 == 1).select(k.alias("caller"), (k * 2).alias("callee"))
    helpers = s.filter("s_nationkey % 3 = 0").select(k.alias("function"), (k + 1).alias("helper"))
    return whole(graph.expand_lineage(s.select(k.alias("lineage"), k.alias("node")), calls, helpers, 2, both=True))
