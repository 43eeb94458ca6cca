"""Queries of the projections, predicates and remaining set and order rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factweave.functions.ids import known
from factweave.functions.text import key
from factweave.operators import cfg, joins, nested, rank, selection
from factweave.plans.fact_queries import _D, _KEY, delivered
from factweave.plans.text_queries import _DAYS, day_graphs
from factweave.session import table
from factweave.sources import ctext, detectors

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
def sel_op_accesses(spark, d):
    """Reads, writes and calls of the program facts' operations; tests hold the rule against cases."""
    tagged = nested.emit_tagged(table(spark, d, "program_facts"))
    name = F.coalesce(known("value_id"), known("object_id"))
    i = nested.flat_table(tagged, "input").groupBy("record_id", "parent_no").agg(F.array_sort(F.collect_list(F.struct("pos", name.alias("v"))))["v"].alias("inputs"))
    o = nested.flat_table(tagged, "output").groupBy("record_id", "parent_no").agg(F.min(name).alias("output"))
    ops = nested.flat_table(tagged, "op").select("record_id", F.col("node_no").alias("parent_no"), F.col("site_id").alias("site"), "mnemonic", F.get_json_object("call", "$.target_function_id").alias("callee"))
    rows = ops.join(i, ["record_id", "parent_no"], "left").join(o, ["record_id", "parent_no"], "left")
    return selection.op_accesses(rows.withColumn("inputs", F.coalesce("inputs", F.array().cast("array<string>"))), ["record_id"])


@query(
    f"""WITH {_D}, g AS (SELECT * FROM d WHERE NOT (coalesce(trim(site_id), '') = '' OR function_id IS NULL) AND NOT (storage_kind IS NULL OR storage_kind NOT IN ('STATIC_WRITABLE_DATA', 'ABSOLUTE_SRAM')))
SELECT edge_id, site_id, object_id FROM (SELECT *, row_number() OVER (PARTITION BY site_id, object_id ORDER BY edge_id) AS n FROM g) WHERE n = 1"""
)
def sel_contract(spark, d):
    rules = [("no_identity", known("site_id").isNull() | F.col("function_id").isNull()), ("no_object", F.col("storage_kind").isNull() | ~F.col("storage_kind").isin("STATIC_WRITABLE_DATA", "ABSOLUTE_SRAM"))]
    return selection.contract(delivered(spark, d, "site_id", "object_id", "function_id", "storage_kind"), rules, ["site_id", "object_id"], ["edge_id"])[0].select("edge_id", "site_id", "object_id")


@query(
    f"""WITH {_D}, n AS (SELECT edge_id, coalesce(CASE WHEN trim(object_id) <> '' THEN object_id END, base_object_id) AS object_id, CASE WHEN trim(value_id) <> '' THEN value_id END AS value_id FROM d)
SELECT *, concat_ws(',', CASE WHEN object_id IS NULL THEN 'object_id_missing' END, CASE WHEN value_id IS NULL THEN 'value_id_missing' END) AS blockers, object_id IS NOT NULL AND value_id IS NOT NULL AS traversable FROM n"""
)
def sel_normalised_edges(spark, d):
    e = selection.normalise_edges(delivered(spark, d, "object_id", "base_object_id", "value_id").select("edge_id", "object_id", "base_object_id", "value_id"), ["object_id", "value_id"], {"object_id": ["base_object_id"]})
    return e.select("edge_id", "object_id", "value_id", F.array_join("blockers", ",").alias("blockers"), "traversable")


@query(
    "SELECT source_id, regexp_matches(upper(concat_ws(' ', decision, evidence_level, source_label)), 'HEURISTIC|LEGACY|SYMBOL_ONLY|NAME_ONLY|UNRESOLVED') OR coalesce(len(outputs) = 0, false) AS rejected, count(*) AS n FROM sources GROUP BY ALL"
)
def sel_strict_rejects(spark, d):
    s = table(spark, d, "sources")
    hit = selection.strict_reject(["decision", "evidence_level", "source_label"], [F.size("outputs") == 0])
    return s.select("source_id", hit.alias("rejected")).groupBy("source_id", "rejected").agg(F.count("*").alias("n"))


@query(
    """SELECT plan_id, array_to_string(list_sort(list(DISTINCT field_name) FILTER (WHERE field_name IS NOT NULL AND NOT coalesce(len(candidates) = 1, false))), ',') AS risky FROM plan_fields WHERE plan_id IS NOT NULL GROUP BY 1
HAVING count(*) FILTER (WHERE field_name IS NOT NULL AND NOT coalesce(len(candidates) = 1, false)) > 0"""
)
def sel_risky_roles(spark, d):
    p = table(spark, d, "plan_fields").filter("plan_id IS NOT NULL AND field_name IS NOT NULL")
    g = p.groupBy("plan_id").agg(F.collect_set(F.struct(F.col("field_name").alias("role"), F.coalesce(F.size("candidates") == 1, F.lit(False)).alias("constant"))).alias("parameters"))
    r = g.select("plan_id", selection.risky_roles(F.col("parameters")).alias("r")).filter(F.size("r") > 0)
    return r.select("plan_id", F.array_join(F.array_sort(F.array_distinct(F.col("r.role"))), ",").alias("risky"))


@query("SELECT source_kind, count(*) AS n FROM sources WHERE source_label IS NULL OR source_label NOT IN ('UNKNOWN_INPUT', 'SOFTWARE_INTERFACE') GROUP BY 1")
def sel_ablation(spark, d):
    return selection.ablated(table(spark, d, "sources"), F.col("source_label"), ["UNKNOWN_INPUT", "SOFTWARE_INTERFACE"]).groupBy("source_kind").agg(F.count("*").alias("n"))


@query(
    f"""WITH {_D} SELECT edge_id, coalesce(list_has_any(CASE WHEN len(coalesce(deterministic_context_ids, [])) > 0 THEN deterministic_context_ids ELSE ['ctx:task'] END, context_ids), false) AS compatible FROM d"""
)
def sel_access_compatible(spark, d):
    c = selection.access_compatible(F.col("deterministic_context_ids"), F.array(F.lit("ctx:task")), F.col("context_ids"))
    return delivered(spark, d, "deterministic_context_ids", "context_ids").select("edge_id", c.alias("compatible"))


@query(
    """WITH g AS (SELECT alert_id, count(DISTINCT evidence_kind) AS n FROM evidence_items WHERE alert_id IS NOT NULL GROUP BY 1), i AS (SELECT DISTINCT alert_id, true AS item FROM plan_fields WHERE alert_id IS NOT NULL)
SELECT alert_id, reason FROM (SELECT alert_id, CASE WHEN item IS NULL THEN 'not_an_item' WHEN n IS NULL THEN 'in_no_group' WHEN n > 1 THEN 'in_several_groups' END AS reason FROM i FULL OUTER JOIN g USING (alert_id)) WHERE reason IS NOT NULL"""
)
def u8_partition_faults(spark, d):
    return selection.partition_faults(table(spark, d, "plan_fields"), table(spark, d, "evidence_items"), "alert_id", "evidence_kind")


@query(
    """SELECT user_id, event_id AS third, following FROM (SELECT user_id, event_id, row_number() OVER w AS n, lead(event_id) OVER w AS following FROM events WHERE event_type = 'purchase' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE n = 3"""
)
def r10_kth_and_next(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").filter("event_type = 'purchase'").select("user_id", "event_id", F.row_number().over(w).alias("n"), F.lead("event_id").over(w).alias("following"))
    return e.filter("n = 3").select("user_id", F.col("event_id").alias("third"), "following")


@query("SELECT event_id, (extract(hour FROM ts) * 3600 + extract(minute FROM ts) * 60 + extract(second FROM ts))::BIGINT AS seconds FROM events")
def f_durations(spark, d):
    """'h:mm:ss' and 'mm:ss' texts as seconds."""
    text = F.date_format("ts", "H:mm:ss")
    p = F.split(text, ":")
    return table(spark, d, "events").select("event_id", F.aggregate(p, F.lit(0).cast("bigint"), lambda a, x: a * 60 + x.cast("bigint")).alias("seconds"))


@query()
def j12_registry_calls(spark, d):
    """Calls of primitives in the corpus' bodies with their rule; tests hold the scanner against texts."""
    #: Primitives, their kind and the slot of their length.
    rules = spark.createDataFrame([("memcpy", "COPY", 2), ("memset", "FILL", 2), ("strcpy", "STRING_COPY", None), ("printf", "FORMAT", None)], "callee string, kind string, length_slot int")
    calls = ctext.scan_calls(table(spark, d, "function_corpus"), "function_row_id", "body")
    return calls.join(F.broadcast(rules), "callee").select("row_id", "call_no", "callee", "kind", F.get("arguments", F.col("length_slot")).alias("length"))


@query()
def s12_text_hints(spark, d):
    """Hints in the corpus' bodies; tests hold the detectors against texts."""
    return detectors.scan_hints(table(spark, d, "function_corpus"), "function_row_id", "body")


@query(
    """WITH c AS (SELECT l_orderkey AS site, o_orderpriority AS callee, l_partkey AS actual, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS slot FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
f AS (SELECT DISTINCT o_orderpriority AS callee, o_shippable AS slot, o_orderpriority || '#' || o_shippable AS formal FROM (SELECT o_orderpriority, unnest([0, 1, 3]) AS o_shippable FROM orders))
SELECT site, callee, slot::INT AS slot, actual, formal FROM c JOIN f USING (callee, slot)"""
)
def j10_argument_binding(spark, d):
    """Order lines as the arguments of a call by priority, bound to the slots that the callee declares."""
    l, o = table(spark, d, "lineitem"), table(spark, d, "orders")  # noqa: E741
    rows = l.join(o, l["l_orderkey"] == o["o_orderkey"]).select(F.col("l_orderkey").alias("site"), F.col("o_orderpriority").alias("callee"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("a"))
    calls = rows.groupBy("site", "callee").agg(F.array_sort(F.collect_list("a"))["l_partkey"].alias("arguments"))
    formals = o.select(F.col("o_orderpriority").alias("callee")).distinct().select("callee", F.explode(F.array(F.lit(0), F.lit(1), F.lit(3))).alias("slot"))
    return joins.bind_arguments(calls, formals.withColumn("formal", F.concat_ws("#", "callee", F.col("slot").cast("string"))), "callee", "arguments", "site")


@query(
    f"""WITH c AS (SELECT site_id, min({_KEY.format("function_id")}) AS t, max({_KEY.format("function_id")}) AS u, min(source_id) AS output FROM sources WHERE site_id IS NOT NULL AND {_KEY.format("function_id")} IS NOT NULL GROUP BY 1),
r AS (SELECT DISTINCT {_KEY.format("function_id")} AS f, func_name AS value FROM function_corpus WHERE func_name IS NOT NULL) SELECT site_id, output, value FROM c JOIN r ON c.t = r.f WHERE t = u"""
)
def j11_return_binding(spark, d):
    """Sites with one target function only, bound to the names that the function returns."""
    calls = table(spark, d, "sources").select("site_id", key(F.col("function_id")).alias("target"), F.col("source_id").alias("output")).filter("site_id IS NOT NULL AND target IS NOT NULL")
    returns = table(spark, d, "function_corpus").select(key(F.col("function_id")).alias("f"), F.col("func_name").alias("value")).filter("value IS NOT NULL").distinct()
    return joins.bind_returns(calls, returns, "site_id", "target", "f")


@query(
    """WITH a AS (SELECT alert_id, count(*) FILTER (WHERE evidence_kind = 'CALL_PATH') AS sure, count(*) AS paths, count(*) FILTER (WHERE withdrawn_at IS NOT NULL) AS blockers FROM evidence_items WHERE alert_id IS NOT NULL GROUP BY 1),
r AS (SELECT alert_id, row_number() OVER (ORDER BY sure DESC, paths DESC, blockers, alert_id) AS rank FROM a) SELECT alert_id, rank, CASE WHEN rank > 50 THEN 'EXECUTION_BUDGET' END AS deferred FROM r"""
)
def r3_validation_rank(spark, d):
    """Alerts by certain evidence, evidence and withdrawals; those past the budget are named as deferred."""
    e = table(spark, d, "evidence_items").filter("alert_id IS NOT NULL")
    a = e.groupBy("alert_id").agg(F.count_if(F.col("evidence_kind") == "CALL_PATH").alias("sure"), F.count("*").alias("paths"), F.count_if(F.col("withdrawn_at").isNotNull()).alias("blockers"))
    ranked = rank.global_rank(a, [F.desc("sure"), F.desc("paths"), F.asc("blockers"), F.asc("alert_id")])
    return ranked.select("alert_id", "rank", F.when(F.col("rank") > 50, "EXECUTION_BUDGET").alias("deferred"))


@query("SELECT event_id, json(props)::VARCHAR AS canonical FROM events")
def f_canonical_json(spark, d):
    """JSON text with sorted keys and no blanks."""
    return table(spark, d, "events").select("event_id", F.to_json(F.try_parse_json("props")).alias("canonical"))


@query(
    f"""WITH RECURSIVE {_DAYS}, e AS (SELECT DISTINCT user_id, day, src, dst FROM g WHERE dst IS NOT NULL),
p AS (SELECT DISTINCT a.user_id, a.day, a.dst AS l, b.dst AS r FROM e a JOIN e b ON a.user_id = b.user_id AND a.day = b.day AND a.src = b.src AND a.dst < b.dst),
q AS (SELECT DISTINCT user_id, day, l AS start, l AS node FROM p UNION SELECT DISTINCT user_id, day, r, r FROM p UNION SELECT q.user_id, q.day, q.start, e.dst FROM q JOIN e ON e.user_id = q.user_id AND e.day = q.day AND e.src = q.node)
SELECT user_id, day, l AS "left", r AS "right" FROM p WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.user_id = p.user_id AND q.day = p.day AND ((q.start = p.l AND q.node = p.r) OR (q.start = p.r AND q.node = p.l)))"""
)
def d9_exclusive_arms(spark, d):
    """Blocks of the day graphs that are arms of one branch and don't lead to each other."""
    e = day_graphs(spark, d).filter("dst IS NOT NULL").select("user_id", "day", "src", "dst")
    on = ["user_id", "day", "src"]
    pairs = e.withColumnRenamed("dst", "left").join(e.withColumnRenamed("dst", "right"), on).filter("left < right").select("user_id", "day", "left", "right")
    return cfg.exclusive_arms(e, pairs, ["user_id", "day"])
