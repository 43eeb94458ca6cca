"""Queries of the scanners, control-flow, trace and matching operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factweave.functions.ids import hex_address, page
from factweave.functions.text import WHITE_SPACE, key
from factweave.operators import cfg, match, rank, trace
from factweave.plans.fact_queries import _D, _KEY, delivered
from factweave.plans.graph_queries import op_values
from factweave.session import checkpoint, table
from factweave.sources import ctext, egress, ingress, traces

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query()
def s6_functions(spark: SparkSession, d: str) -> DataFrame:
    """Functions in the corpus' bodies; tests hold the scanner against texts written for it."""
    return ctext.scan_functions(table(spark, d, "function_corpus"), "function_row_id", "body").withColumn("parameters", F.array_join("parameters", ","))


@query()
def s7_call_sites(spark, d):
    """Call sites in the corpus' bodies; tests hold the scanner against texts written for it."""
    return ctext.scan_calls(table(spark, d, "function_corpus"), "function_row_id", "body").withColumn("arguments", F.array_join("arguments", ","))


_LINES = r"""l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1)::INT AS line_no FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, line_no, trim(raw, '§§') AS line FROM l),
k AS (SELECT *, CASE WHEN regexp_matches(line, '^[0-9a-fA-F]+:\s+(0x)?[0-9a-fA-F]+\s+(0x)?[0-9a-fA-F]+\s+[rw]\s+[0-9]+\s+[0-9]+\s+[0-9]+\s+0x[0-9a-fA-F]+:(0x)?[0-9a-fA-F]+$') THEN 'mmio'
  WHEN regexp_matches(line, '^[0-9a-fA-F]+:\s+(0x)?[0-9a-fA-F]+\s+(0x)?[0-9a-fA-F]+\s+[rw]\s+[0-9]+\s+0x[0-9a-fA-F]+:(0x)?[0-9a-fA-F]+(\s+(0x)?[0-9a-fA-F]+)?$') THEN 'ram'
  WHEN regexp_matches(line, '^[0-9a-fA-F]+\s+(0x)?[0-9a-fA-F]+\s+[0-9]+$') THEN 'bb' END AS kind FROM n WHERE line <> ''),
e AS (SELECT doc_id, line_no, kind, ('0x' || regexp_extract(line, '^([0-9a-fA-F]+)', 1))::BIGINT AS event_id, ('0x' || regexp_extract(line, '^[0-9a-fA-F]+:?\s+(?:0x)?([0-9a-fA-F]+)', 1))::BIGINT AS pc,
  CASE WHEN kind <> 'bb' THEN regexp_extract(line, '\s([rw])\s', 1) END AS mode, CASE WHEN kind <> 'bb' THEN ('0x' || regexp_extract(line, '0x([0-9a-fA-F]+):', 1))::BIGINT END AS address,
  CASE WHEN kind <> 'bb' THEN ('0x' || regexp_extract(line, '0x[0-9a-fA-F]+:(?:0x)?([0-9a-fA-F]+)', 1))::BIGINT END AS value FROM k WHERE kind IS NOT NULL)""".replace("§§", WHITE_SPACE)


def _events(spark, d):
    return traces.parse(traces.lines(table(spark, d, "documents"), "doc_id", "text"), "doc_id")


@query(f"WITH {_LINES} SELECT doc_id, line_no, kind, event_id, pc, mode, address, value FROM e")
def s9_trace_events(spark, d):
    return _events(spark, d)[0].select("doc_id", "line_no", "kind", "event_id", "pc", "mode", "address", "value")


@query(f"WITH {_LINES} SELECT doc_id, count(*) AS unread FROM k WHERE kind IS NULL GROUP BY 1")
def s9_trace_rejects(spark, d):
    return _events(spark, d)[1].groupBy("doc_id").agg(F.count("*").alias("unread"))


@query(f"WITH {_LINES} SELECT doc_id, bool_or(coalesce(mode = 'r' AND address BETWEEN 1073741824 AND 1073758207, false)) AS source_observed, count(*) AS events FROM e GROUP BY 1")
def t1_source_observed(spark, d):
    hit = (F.col("mode") == "r") & F.col("address").between(0x40000000, 0x40003FFF)
    return _events(spark, d)[0].groupBy("doc_id").agg(trace.observed(hit).alias("source_observed"), F.count("*").alias("events"))


@query(
    f"""WITH {_LINES}, f AS (SELECT DISTINCT func_name AS name, ('0x' || ltrim(addr, '0x'))::BIGINT AS s, ('0x' || ltrim(end_addr, '0x'))::BIGINT AS t FROM function_corpus
  WHERE regexp_matches(addr, '^0x[0-9a-f]+$') AND regexp_matches(end_addr, '^0x[0-9a-f]+$') AND func_name IS NOT NULL)
SELECT e.doc_id, e.line_no, e.pc, f.name FROM e LEFT JOIN f ON (e.pc & ~1) >= f.s AND (e.pc & ~1) < f.t WHERE kind = 'bb'"""
)
def t2_blocks_in_functions(spark, d):
    f = table(spark, d, "function_corpus").select(F.lit(1).alias("k"), F.col("func_name").alias("name"), hex_address("addr").alias("start"), hex_address("end_addr").alias("end")).filter("name IS NOT NULL AND start IS NOT NULL AND end IS NOT NULL").distinct()
    e = _events(spark, d)[0].filter("kind = 'bb'").withColumn("k", F.lit(1))
    return trace.blocks_covering(e, f, ["k"], "pc").select("doc_id", "line_no", "pc", "name")


@query(
    f"""WITH {_LINES}, w AS (SELECT *, last_value(CASE WHEN mode = 'w' THEN {{'i': event_id, 'p': pc}} END IGNORE NULLS) OVER (PARTITION BY doc_id, address & ~255 ORDER BY event_id, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS w FROM e WHERE mode IS NOT NULL)
SELECT doc_id, event_id, line_no, pc, address & ~255 AS address, w.i AS write_id, w.p AS write_pc FROM w WHERE mode = 'r' AND w IS NOT NULL"""
)
def t3_reaching_writes(spark, d):
    """Reads with the last write to their 256-byte page before them."""
    return trace.causal_reads(_events(spark, d)[0].withColumn("address", page("address", 8)), ["doc_id"])


@query(
    f"""WITH {_LINES}, i AS (SELECT *, coalesce(max(kind = 'bb') OVER (PARTITION BY doc_id ORDER BY event_id, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS inside FROM e),
g AS (SELECT doc_id, min(event_id) FILTER (WHERE kind = 'bb') AS entered_at, bool_or(inside AND coalesce(mode = 'w', false)) AS overwritten, bool_or(inside AND coalesce(mode = 'r', false)) AS returned FROM i GROUP BY 1)
SELECT *, entered_at IS NOT NULL AND overwritten AND NOT returned AS bound FROM g"""
)
def t4_nonreturning(spark, d):
    e = _events(spark, d)[0]
    m = F.coalesce("mode", F.lit(""))
    return trace.nonreturning(e, ["doc_id"], F.col("kind") == "bb", m == "r", m == "w")


@query(
    r"""SELECT doc_id, CASE WHEN regexp_matches(text, 'version \d+\.\d+') THEN 'release' WHEN regexp_matches(text, 'at (0x[0-9a-f]{8})') THEN 'address' WHEN regexp_matches(text, '`(\w+)`') THEN 'symbol' END AS kind,
CASE WHEN regexp_matches(text, 'version \d+\.\d+') THEN regexp_extract(text, 'version (\d+\.\d+)', 1) WHEN regexp_matches(text, 'at (0x[0-9a-f]{8})') THEN regexp_extract(text, 'at (0x[0-9a-f]{8})', 1)
  WHEN regexp_matches(text, '`(\w+)`') THEN regexp_extract(text, '`(\w+)`', 1) END AS found FROM documents WHERE text IS NOT NULL"""
)
def t5_signatures(spark, d):
    s = trace.first_pattern(F.col("text"), [("release", r"version (\d+\.\d+)"), ("address", r"at (0x[0-9a-f]{8})"), ("symbol", r"`(\w+)`")])
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", s.alias("s")).select("doc_id", F.col("s.kind").alias("kind"), F.col("s.text").alias("found"))


@query(
    """SELECT user_id, event_type, CASE WHEN count(*) >= 2 AND bool_and(value > 0.5 AND trim(props) <> '') AND min(length(props)) = max(length(props)) THEN 'POC' ELSE 'INCONCLUSIVE' END AS verdict FROM events GROUP BY 1, 2"""
)
def t6_replay_agreement(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(trace.replay_agreement(F.col("value") > 0.5, F.trim("props") != "", F.length("props").cast("string")).alias("verdict"))


@query(
    f"""SELECT plan_id, bool_and({_KEY.format("evidence_ref")} IS NOT NULL AND {_KEY.format("evidence_ref")} IN (SELECT {_KEY.format("evidence_id")} FROM evidence_items WHERE {_KEY.format("evidence_id")} IS NOT NULL)) AS observed
FROM plan_fields WHERE plan_id IS NOT NULL GROUP BY 1"""
)
def t7_mapping_observed(spark, d):
    p = table(spark, d, "plan_fields").filter("plan_id IS NOT NULL").select("plan_id", key(F.col("evidence_ref")).alias("e"))
    return trace.all_observed(p, table(spark, d, "evidence_items").select(key(F.col("evidence_id")).alias("e")), ["plan_id"], ["e"])


_DAYS = """b AS (SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS day, event_type AS src, lead(event_type) OVER w AS dst, first_value(event_type) OVER w AS entry FROM events WINDOW w AS (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id)),
g AS (SELECT DISTINCT user_id, day, src, dst, entry FROM b)"""


def day_graphs(spark, d):
    """A flow graph per user and day: event types are blocks, each leads to the next one's."""
    e = table(spark, d, "events").withColumn("day", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    w = Window.partitionBy("user_id", "day").orderBy("ts", "event_id")
    return e.select("user_id", "day", F.col("event_type").alias("src"), F.lead("event_type").over(w).alias("dst"), F.first("event_type").over(w).alias("entry")).distinct()


@query(
    f"""WITH RECURSIVE {_DAYS}, t AS (SELECT DISTINCT user_id, day, src AS without FROM g UNION SELECT DISTINCT user_id, day, '' FROM g),
r AS (SELECT DISTINCT g.user_id, g.day, t.without, g.entry AS node FROM g JOIN t USING (user_id, day) WHERE g.entry <> t.without
  UNION SELECT r.user_id, r.day, r.without, g.dst FROM r JOIN g ON g.user_id = r.user_id AND g.day = r.day AND g.src = r.node WHERE g.dst IS NOT NULL AND g.dst <> r.without),
n AS (SELECT user_id, day, node AS block FROM r WHERE without = '')
SELECT n.user_id, n.day, n.block, t.without AS dominator FROM n JOIN t USING (user_id, day) WHERE t.without <> '' AND NOT EXISTS (SELECT 1 FROM r WHERE r.user_id = n.user_id AND r.day = n.day AND r.without = t.without AND r.node = n.block)"""
)
def g10_dominators(spark, d):
    return cfg.dominators(day_graphs(spark, d), ["user_id", "day"], "entry")


#: Registries that stand in for those no table carries: classes of expressions, and tokens of names.
CLASSES = [("DATA", r"\bDAT_\w*[0-7]\b"), ("UNKNOWN_MMIO", r"\b_?DAT_")]
TOKENS = ["read", "recv", "rx", "parse", "probe", "handle"]


def _program_text(spark, d):
    return ingress.Text(table(spark, d, "function_corpus"), "function_row_id", "body")


_ROOTS = f"""{_DAYS}, e AS (SELECT DISTINCT user_id, day, src, dst FROM g), root AS (SELECT DISTINCT user_id, day, src AS b FROM e WHERE NOT EXISTS (SELECT 1 FROM e x WHERE x.user_id = e.user_id AND x.day = e.day AND x.dst = e.src)),
start AS (SELECT * FROM root UNION SELECT user_id, day, min(src) FROM e GROUP BY 1, 2 HAVING NOT bool_or((user_id, day) IN (SELECT user_id, day FROM root)))"""


@query(
    f"""WITH RECURSIVE {_ROOTS}, t AS (SELECT DISTINCT user_id, day, src AS without FROM e UNION SELECT DISTINCT user_id, day, '' FROM e),
r AS (SELECT DISTINCT t.user_id, t.day, t.without, s.b AS node FROM start s JOIN t USING (user_id, day) WHERE s.b <> t.without
  UNION SELECT r.user_id, r.day, r.without, e.dst FROM r JOIN e ON e.user_id = r.user_id AND e.day = r.day AND e.src = r.node WHERE e.dst IS NOT NULL AND e.dst <> r.without),
n AS (SELECT user_id, day, node AS block FROM r WHERE without = '')
SELECT n.user_id, n.day, n.block, t.without AS dominator FROM n JOIN t USING (user_id, day) WHERE t.without <> '' AND NOT EXISTS (SELECT 1 FROM r WHERE r.user_id = n.user_id AND r.day = n.day AND r.without = t.without AND r.node = n.block)"""
)
def g10_root_dominators(spark, d):
    """Dominators of the day graphs with every block without a predecessor as an entry."""
    return cfg.root_dominators(day_graphs(spark, d), ["user_id", "day"])


@query()
def src_rule_scans(spark, d):
    """Every rule of ingress over the corpus, with registries by tokens of names; tests hold the rules against cases."""
    t = _program_text(spark, d)
    names = t.calls.select("callee").distinct()
    api = names.filter("callee LIKE '%store%'").select("callee", F.lit(0).alias("buffer_arg"), F.lit(1).alias("length_arg"), F.lit("BYTE_STREAM_INGRESS").alias("label"))
    returns = names.filter("callee LIKE '%check%'").select("callee", F.lit("BYTE_STREAM_INGRESS").alias("label"))
    framework = t.functions.filter("function LIKE '%handle%'").select("function", F.lit(0).alias("buffer_param"), F.lit("BYTE_STREAM_INGRESS").alias("label")).distinct()
    summaries = checkpoint(ingress.body_summaries(t, CLASSES))
    parts = [
        ingress.api_sources(t, api), ingress.return_sources(t, returns), ingress.framework_sources(t, framework), ingress.register_sources(t, CLASSES), ingress.body_derived_sources(t, summaries),
        ingress.complex_bodies(t, CLASSES), ingress.callsite_candidates(t, TOKENS), ingress.function_candidates(t, TOKENS),
    ]
    return reduce(DataFrame.unionByName, parts)


@query()
def snk_rule_scans(spark, d):
    """Every text rule of sinks over the corpus; tests hold the rules against cases."""
    t = _program_text(spark, d)
    return egress.loop_writes(t, egress.scan_loops(table(spark, d, "function_corpus"), "function_row_id", "body")).unionByName(egress.parser_stores(t)).unionByName(egress.field_updates(t))


@query()
def g11_natural_loops(spark, d):
    """Loops of the day graphs; tests hold them against a definition by node removal."""
    out = cfg.natural_loops(day_graphs(spark, d), ["user_id", "day"], "entry")
    return out.select("user_id", "day", "header", *(F.array_join(c, ",").alias(c) for c in ("tails", "blocks", "exits")))


@query()
def g12_recurrences(spark, d):
    """Induction values of the program facts; tests hold the rule against cases."""
    v = op_values(spark, d).withColumn("k", F.lit(1))
    number = F.when(F.col("constant"), hex_address(F.regexp_extract("input", r"const:([0-9a-f]{1,15}):", 1)))
    return cfg.recurrences(v.withColumn("constant", number), ["k"]).drop("k")


@query(
    f"""WITH RECURSIVE {_DAYS}, e AS (SELECT DISTINCT user_id, day, src, dst FROM g WHERE dst IS NOT NULL), r AS (SELECT DISTINCT user_id, day, 'purchase' AS target, 'purchase' AS node FROM e WHERE src = 'purchase' OR dst = 'purchase'
  UNION SELECT r.user_id, r.day, r.target, e.src FROM r JOIN e ON e.user_id = r.user_id AND e.day = r.day AND e.dst = r.node),
f AS (SELECT user_id, day, src, count(*) AS n FROM e GROUP BY ALL HAVING count(*) > 1),
h AS (SELECT e.user_id, e.day, e.src, r.target, count(*) AS k FROM e JOIN r ON e.user_id = r.user_id AND e.day = r.day AND e.dst = r.node GROUP BY ALL)
SELECT user_id, day, src AS branch, target FROM h JOIN f USING (user_id, day, src) WHERE k < n"""
)
def g15_branch_gates(spark, d):
    e = day_graphs(spark, d).filter("dst IS NOT NULL").select("user_id", "day", "src", "dst")
    t = e.filter("src = 'purchase' OR dst = 'purchase'").select("user_id", "day", F.lit("purchase").alias("target")).distinct()
    return cfg.branch_gates(e, t, ["user_id", "day"])


@query(
    """WITH u AS (SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS day, event_type AS field, event_id AS site, (props->>'k')::BIGINT % 3 AS lineage, CASE WHEN value > 10 THEN 1 ELSE -1 END AS direction FROM events)
SELECT a.user_id, a.day, a.site AS site_a, b.site AS site_b, CASE WHEN a.field = b.field THEN 'same_field' WHEN a.lineage <> b.lineage THEN 'different_delta' WHEN a.direction = b.direction THEN 'same_direction' END AS reason
FROM u a JOIN u b ON a.user_id = b.user_id AND a.day = b.day AND a.site < b.site"""
)
def d8_paired_updates(spark, d):
    e = table(spark, d, "events").select(
        "user_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), F.lit(0).alias("base"), F.col("event_type").alias("field"), F.col("event_id").alias("site"),
        (F.get_json_object("props", "$.k").cast("bigint") % 3).alias("lineage"), F.when(F.col("value") > 10, 1).otherwise(-1).alias("direction"),
    )
    return cfg.paired_updates(e, ["user_id", "day"]).drop("base")


@query(
    """WITH u AS (SELECT user_id, event_type AS field, event_id AS site, (props->>'k')::BIGINT % 3 AS lineage, CASE WHEN value > 10 THEN 1 ELSE -1 END AS direction, date_trunc('day', ts)::TIMESTAMP AS base FROM events)
SELECT user_id, base, count(*) AS updates, 'no_compatible_pair' AS reason FROM u a WHERE NOT EXISTS (SELECT 1 FROM u x JOIN u y ON x.user_id = a.user_id AND y.user_id = a.user_id AND x.base = a.base AND y.base = a.base
  AND x.site < y.site AND x.field <> y.field AND x.lineage = y.lineage AND x.direction <> y.direction) GROUP BY ALL"""
)
def d8_unpaired_bases(spark, d):
    e = table(spark, d, "events").select(
        "user_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("base"), F.col("event_type").alias("field"), F.col("event_id").alias("site"),
        (F.get_json_object("props", "$.k").cast("bigint") % 3).alias("lineage"), F.when(F.col("value") > 10, 1).otherwise(-1).alias("direction"),
    )
    return cfg.unpaired_bases(e, cfg.paired_updates(e, ["user_id"]), ["user_id"])


@query(
    """WITH f AS (SELECT e.evidence_id, e.alert_id, arg_min(plan_field_id, (CASE WHEN field_role = 'len' THEN 0 ELSE 1 END, plan_field_id, planned_at)) AS plan_field_id, min(CASE WHEN field_role = 'len' THEN 0 ELSE 1 END) AS tier
  FROM (SELECT DISTINCT evidence_id, alert_id FROM evidence_items WHERE evidence_id IS NOT NULL) e JOIN plan_fields p USING (alert_id) WHERE plan_field_id IS NOT NULL GROUP BY 1, 2)
SELECT e.evidence_id, e.alert_id, f.plan_field_id, CASE f.tier WHEN 0 THEN 'CONFIRMED' WHEN 1 THEN 'CANDIDATE' ELSE 'MISS' END AS match
FROM (SELECT evidence_id, min(alert_id) AS alert_id FROM evidence_items WHERE evidence_id IS NOT NULL GROUP BY 1) e LEFT JOIN f USING (evidence_id, alert_id)"""
)
def j14_expected_matches(spark, d):
    expected = table(spark, d, "evidence_items").filter("evidence_id IS NOT NULL").groupBy("evidence_id").agg(F.min("alert_id").alias("alert_id"))
    found = table(spark, d, "plan_fields").filter("plan_field_id IS NOT NULL").select("alert_id", "plan_field_id", "planned_at", "field_role")
    out = match.match_expected(expected, found, ["alert_id"], "evidence_id", F.coalesce(F.col("field_role") == "len", F.lit(False)), ["plan_field_id", "planned_at"])
    return out.select("evidence_id", "alert_id", "plan_field_id", "match")


@query(
    """WITH t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_]+')) AS token FROM documents) SELECT doc_id, token FROM t WHERE token IN (SELECT func_name FROM function_corpus WHERE func_name IS NOT NULL)"""
)
def sel_token_audit(spark, d):
    return match.token_hits(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "function_corpus"), "func_name")


@query(
    """SELECT function_row_id, len(list_distinct(regexp_extract_all(coalesce(body, ''), '[A-Za-z_][A-Za-z0-9_]*')))::BIGINT AS identifiers, regexp_matches(coalesce(body, ''), 'memcpy|memset|strcpy|printf') AS primitive,
  length(trim(regexp_replace(coalesce(signature, ''), '[ \t\n\r\f\v]+', ' ', 'g'))) AS signature_length FROM function_corpus"""
)
def sel_token_tests(spark, d):
    f = table(spark, d, "function_corpus")
    return f.select(
        "function_row_id", F.size(ctext.identifiers("body")).cast("bigint").alias("identifiers"), F.coalesce("body", F.lit("")).rlike("memcpy|memset|strcpy|printf").alias("primitive"),
        F.length(ctext.clean_expression(F.coalesce("signature", F.lit("")))).alias("signature_length"),
    )


@query(
    f"""WITH {_D}, c AS (SELECT binary_sha256, base_object_id, edge_kind, unnest(CASE WHEN len(coalesce(context_ids, [])) = 0 THEN ['UNKNOWN'] ELSE context_ids END) AS ctx FROM d WHERE binary_sha256 IS NOT NULL AND base_object_id IS NOT NULL),
p AS (SELECT binary_sha256, base_object_id, ctx AS src, count(*) AS stores FROM c WHERE edge_kind = 'WRITE' GROUP BY ALL), q AS (SELECT binary_sha256, base_object_id, ctx AS dst, count(*) AS loads FROM c WHERE edge_kind = 'READ' GROUP BY ALL),
s AS (SELECT *, least(stores, loads) - CASE WHEN dst = 'UNKNOWN' OR src = 'UNKNOWN' THEN 1 ELSE 0 END AS score FROM p JOIN q USING (binary_sha256, base_object_id) WHERE src <> dst AND NOT (src = 'ctx:isr' AND dst = 'ctx:task'))
SELECT binary_sha256, base_object_id, src, dst, score, row_number() OVER (PARTITION BY binary_sha256, base_object_id ORDER BY score DESC, src, dst) AS place FROM s QUALIFY place <= 2"""
)
def d2_context_pairs(spark, d):
    """Producer and consumer contexts of an object, of which there are few, scored and cut to the best two."""
    a = delivered(spark, d, "binary_sha256", "base_object_id", "edge_kind", "context_ids").filter("binary_sha256 IS NOT NULL AND base_object_id IS NOT NULL")
    ctx = F.when(F.size(F.coalesce("context_ids", F.array())) == 0, F.array(F.lit("UNKNOWN"))).otherwise(F.col("context_ids"))
    c = a.select("binary_sha256", "base_object_id", "edge_kind", F.explode(ctx).alias("ctx"))
    p = c.filter("edge_kind = 'WRITE'").groupBy("binary_sha256", "base_object_id", F.col("ctx").alias("src")).agg(F.count("*").alias("stores"))
    q = c.filter("edge_kind = 'READ'").groupBy("binary_sha256", "base_object_id", F.col("ctx").alias("dst")).agg(F.count("*").alias("loads"))
    s = p.join(q, ["binary_sha256", "base_object_id"]).filter("src <> dst AND NOT (src = 'ctx:isr' AND dst = 'ctx:task')")
    s = s.withColumn("score", F.least("stores", "loads") - F.when(F.expr("src = 'UNKNOWN' OR dst = 'UNKNOWN'"), 1).otherwise(0))
    best = rank.top_k(s, ["binary_sha256", "base_object_id"], [F.desc("score"), F.asc("src"), F.asc("dst")], 2).filter("selected")
    return best.select("binary_sha256", "base_object_id", "src", "dst", "score", "place")
