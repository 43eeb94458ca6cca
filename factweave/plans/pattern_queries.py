"""Queries of the pattern and streaming operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.functions.ids import hex_address, known
from factweave.operators import nested, patterns
from factweave.plans.fact_queries import _D, delivered
from factweave.session import checkpoint, table
from factweave.streaming import events as streams

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def fact_inputs(spark: SparkSession, d: str) -> DataFrame:
    """Value flow of the program facts per record: record_id, output, input, pos, mnemonic, constant."""
    tagged = nested.emit_tagged(table(spark, d, "program_facts"))
    ops = nested.flat_table(tagged, "op").select("record_id", F.col("node_no").alias("parent_no"), "mnemonic")
    name = F.coalesce(known("value_id"), known("object_id"))
    i = nested.flat_table(tagged, "input").select("record_id", "parent_no", name.alias("input"), "pos", F.when(F.col("space") == "const", hex_address(F.regexp_extract(name, r"^const:([0-9a-f]{1,15}):", 1))).alias("constant"))
    o = nested.flat_table(tagged, "output").select("record_id", "parent_no", name.alias("output"))
    return checkpoint(i.join(o, ["record_id", "parent_no"]).join(ops, ["record_id", "parent_no"]).filter("input IS NOT NULL AND output IS NOT NULL").select("record_id", "output", "input", "pos", "mnemonic", "constant"))


@query()
def g20_constants(spark, d):
    """Outputs of the facts that fold to a number; tests hold the rules against cases."""
    return patterns.resolve_constants(fact_inputs(spark, d), ["record_id"])


@query()
def g21_affine_addresses(spark, d):
    """The facts' sums as scaled terms and offsets; tests hold the rules against cases."""
    from factweave.operators.cfg import affine_terms

    i = fact_inputs(spark, d)
    roots = i.filter("mnemonic IN ('INT_ADD', 'PTRSUB', 'INT_SUB', 'INT_MULT')").select("record_id", F.col("output").alias("root")).distinct()
    return affine_terms(i, roots, ["record_id"])


@query()
def g24_container_aliases(spark, d):
    """Merges of the facts that walk a list from a formal; tests hold the rules against cases."""
    i = fact_inputs(spark, d)
    formals = i.filter("input LIKE 'param:%'").select("record_id", F.regexp_extract("input", r":(\d{1,9})$", 1).cast("int").alias("slot"), F.col("input").alias("node")).filter("slot IS NOT NULL").distinct()
    return patterns.container_aliases(i, formals, ["record_id"])


@query(
    """WITH s AS (SELECT DISTINCT alert_id AS sink FROM plan_fields WHERE alert_id IS NOT NULL), l AS (SELECT alert_id AS sink, count(DISTINCT plan_field_id) FILTER (WHERE field_role = 'len') AS lengths, max(field_size) AS extent, min(field_offset) AS off FROM plan_fields WHERE alert_id IS NOT NULL GROUP BY 1),
q AS (SELECT alert_id AS sink, evidence_kind, length(detail) % 64 AS bound, row_number() OVER (PARTITION BY alert_id, evidence_kind <> 'CALL_PATH' ORDER BY evidence_id NULLS FIRST, recorded_at NULLS FIRST, length(detail) % 64 NULLS FIRST, evidence_kind = 'MMIO_READ') AS k FROM evidence_items WHERE alert_id IS NOT NULL AND evidence_kind IS NOT NULL),
c AS (SELECT sink, count(*) AS n, bool_or(evidence_kind <> 'CALL_PATH') AS same, bool_or(evidence_kind <> 'MMIO_READ') FILTER (WHERE evidence_kind <> 'CALL_PATH' AND k = 1) AS uns, bool_or(bound IS NOT NULL) FILTER (WHERE evidence_kind <> 'CALL_PATH' AND k = 1) AS fix,
  min(bound - 1) FILTER (WHERE evidence_kind <> 'CALL_PATH' AND k = 1) AS maximum FROM q GROUP BY 1),
r AS (SELECT s.sink, CASE WHEN l.lengths <> 1 THEN 'non_unique_nonconstant_length_parameter' WHEN c.n IS NULL THEN 'no_parameter_bounded_check' WHEN NOT same THEN 'checked_value_not_equivalent_to_sink_length' WHEN NOT uns THEN 'signed_comparison_not_capacity_proof'
  WHEN NOT fix THEN 'capacity_bound_not_constant' WHEN maximum IS NULL THEN 'unsupported_capacity_bound_relation' WHEN extent IS NULL THEN 'static_destination_object_unresolved' WHEN extent <= 0 OR off < 0 OR off > extent THEN 'destination_extent_or_offset_invalid'
  WHEN maximum < 0 OR maximum > extent - off THEN 'check_bound_exceeds_remaining_destination_capacity' END AS reason FROM s JOIN l USING (sink) LEFT JOIN c USING (sink))
SELECT sink, CASE WHEN reason IS NULL THEN 'CAPACITY_SAFE' ELSE 'NOT_PROVED' END AS status, reason FROM r"""
)
def g29_capacity(spark, d):
    """The capacity rule over plans as sinks and their evidence as checks."""
    p = table(spark, d, "plan_fields").filter("alert_id IS NOT NULL")
    sinks = p.groupBy(F.col("alert_id").alias("sink")).agg(F.count_distinct(F.when(F.col("field_role") == "len", F.col("plan_field_id"))).alias("lengths")).withColumn("label", F.lit("COPY_SINK"))
    dest = p.groupBy(F.col("alert_id").alias("sink")).agg(F.max("field_size").alias("extent"), F.min("field_offset").alias("offset"))
    e = table(spark, d, "evidence_items").filter("alert_id IS NOT NULL AND evidence_kind IS NOT NULL")
    k = F.col("evidence_kind")
    checks = e.select(F.col("alert_id").alias("sink"), F.when(k == "MMIO_READ", "INT_SLESS").otherwise("INT_LESS").alias("mnemonic"), F.lit("LT").alias("relation"), (F.length("detail") % 64).alias("bound"), (k != "CALL_PATH").alias("equivalent"), F.struct("evidence_id", "recorded_at").alias("ordinal"))
    return patterns.capacity_proofs(sinks, checks, dest).select("sink", "status", "reason")


@query(
    """WITH s AS (SELECT source_id, unnest(CASE WHEN len(outputs) > 0 THEN outputs ELSE [NULL] END) AS o, decision, source_kind FROM sources)
SELECT source_id, CASE WHEN ok THEN rule END AS rule, CASE WHEN NOT ok THEN 'binding_incomplete' WHEN rule IS NULL THEN 'no_rule_holds' END AS reason, count(*) AS n FROM (
  SELECT source_id, coalesce(decision LIKE 'ACCEPT%' AND (coalesce(o.object_id, '') <> '' OR coalesce(o.value_id, '') <> ''), false) AS ok,
    CASE WHEN o.kind = 'memory_object' THEN 'ARGUMENT_WRITTEN_BY_FACTS' WHEN source_kind = 'serial' THEN 'ARGUMENT_WRITTEN_BY_BODY' WHEN o.kind = 'scalar_value' AND source_kind = 'mmio' THEN 'RETURN_DRIVES_LENGTH' WHEN source_kind = 'radio' THEN 'RECEIVE_LIKE' END AS rule FROM s) GROUP BY ALL"""
)
def d4_source_candidates(spark, d):
    s = table(spark, d, "sources").select("source_id", F.explode_outer("outputs").alias("o"), "decision", "source_kind")
    k, o = F.col("source_kind"), F.col("o.kind")
    c = s.select(
        "source_id", F.when(F.col("decision").like("ACCEPT%"), "BOUND").alias("binding_status"), F.col("o.object_id").alias("object_id"), F.col("o.value_id").alias("value_id"),
        (o == "memory_object").alias("argument_facts"), (k == "serial").alias("argument_text"), ((o == "scalar_value") & (k == "mmio")).alias("length_from_return"), (k == "radio").alias("receive_like"),
    )
    return patterns.source_candidates(c).groupBy("source_id", "rule", "reason").agg(F.count("*").alias("n"))


@query(
    """SELECT source_definition_id, CASE WHEN channel = 'unknown' OR proof_kind = 'register_profile' OR proof_kind = 'dma_descriptor' OR proof_kind IS NULL THEN 'RAW' ELSE 'SOURCE' END AS route,
  CASE WHEN channel = 'unknown' THEN 'channel_unknown' WHEN proof_kind IS NULL THEN 'register_role_unresolved' WHEN proof_kind = 'register_profile' THEN 'register_role_status' WHEN proof_kind = 'dma_descriptor' THEN 'register_role_control' END AS reason, count(*) AS n
FROM source_definitions GROUP BY ALL"""
)
def d5_register_routes(spark, d):
    p = F.col("proof_kind")
    role = F.when(p == "register_profile", "STATUS").when(p == "dma_descriptor", "CONTROL").otherwise(p)
    out = patterns.route_registers(table(spark, d, "source_definitions"), role, F.when(F.col("channel") == "unknown", "channel_unknown"))
    return out.groupBy("source_definition_id", "route", "reason").agg(F.count("*").alias("n"))


@query(
    f"""WITH {_D} SELECT edge_id, CASE WHEN region_offset IS NULL AND len(coalesce(selector_terms, [])) = 0 THEN 'address_not_complete' WHEN storage_kind IS NULL OR storage_kind NOT IN ('STATIC_WRITABLE_DATA', 'ABSOLUTE_SRAM') THEN 'base_not_proved_writable'
  WHEN len(coalesce(selector_terms, [])) = 0 THEN 'offset_neither_formal_nor_source' WHEN value_id IS NULL OR trim(value_id) = '' THEN 'no_trackable_parameter' END AS reason FROM d WHERE edge_kind = 'WRITE'"""
)
def d11_variable_stores(spark, d):
    w = delivered(spark, d, "edge_kind", "region_offset", "selector_terms", "storage_kind", "value_id").filter("edge_kind = 'WRITE'")
    dynamic = F.size(F.coalesce("selector_terms", F.array())) > 0
    c = w.select("edge_id", (F.col("region_offset").isNotNull() | dynamic).alias("complete"), F.col("storage_kind").isin("STATIC_WRITABLE_DATA", "ABSOLUTE_SRAM").alias("writable"), F.when(dynamic, "source").alias("offset_kind"), known("value_id").isNotNull().alias("trackable"))
    return patterns.variable_stores(c).select("edge_id", "reason")


@query(
    """WITH c AS (SELECT p.alert_id AS sink, e.evidence_id AS chain, e.evidence_kind = 'CHECK_SLICE' AS m, CASE e.evidence_kind WHEN 'CALL_PATH' THEN 'SOURCE_REACHED_HEURISTIC' WHEN 'MMIO_READ' THEN 'PROVEN_INTERNAL_ONLY' ELSE 'GRAPH_INCOMPLETE' END AS status
  FROM (SELECT DISTINCT alert_id FROM plan_fields WHERE alert_id IS NOT NULL) p JOIN evidence_items e USING (alert_id) WHERE e.evidence_id IS NOT NULL AND e.evidence_kind IS NOT NULL),
b AS (SELECT sink, chain, status, row_number() OVER (PARTITION BY sink ORDER BY NOT m, NOT starts_with(status, 'SOURCE_REACHED'), status <> 'GRAPH_INCOMPLETE', status = 'PROVEN_INTERNAL_ONLY', chain) AS n FROM c)
SELECT s.sink, b.chain, CASE WHEN NOT s.matched THEN 'SINK_MISS' WHEN b.chain IS NULL THEN 'CHAIN_MISS' ELSE b.status END AS result
FROM (SELECT alert_id AS sink, bool_or(field_role IS NOT NULL) AS matched FROM plan_fields WHERE alert_id IS NOT NULL GROUP BY 1) s LEFT JOIN b ON s.sink = b.sink AND n = 1"""
)
def j15_best_chains(spark, d):
    p = table(spark, d, "plan_fields").filter("alert_id IS NOT NULL")
    expected = p.groupBy(F.col("alert_id").alias("sink")).agg(F.bool_or(F.col("field_role").isNotNull()).alias("matched"))
    e = table(spark, d, "evidence_items").filter("evidence_id IS NOT NULL AND evidence_kind IS NOT NULL AND alert_id IS NOT NULL")
    k = F.col("evidence_kind")
    chains = e.select(F.col("alert_id").alias("sink"), F.col("evidence_id").alias("chain"), (k == "CHECK_SLICE").alias("source_matched"), F.when(k == "CALL_PATH", "SOURCE_REACHED_HEURISTIC").when(k == "MMIO_READ", "PROVEN_INTERNAL_ONLY").otherwise("GRAPH_INCOMPLETE").alias("status"))
    return patterns.best_chains(expected, chains, "sink").select("sink", "chain", "result")


@query(
    """SELECT time_bucket(INTERVAL '1 hour', ts)::TIMESTAMP AS opened, event_type, count(*) AS n, max(value) AS most FROM events
GROUP BY 1, 2 HAVING time_bucket(INTERVAL '1 hour', min(ts)) + INTERVAL '1 hour' <= (SELECT max(ts) FROM events) - INTERVAL '10 minutes'"""
)
def stream_windowed_counts(spark, d):
    """Hourly counts of a stream over the events, those windows that the watermark has closed."""
    return streams.run_to_table(streams.windowed_counts(streams.read_events(spark, d)), spark)


@query(
    """SELECT event_id, user_id, last_write FROM (SELECT event_id, user_id, event_type, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS)
  OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_write FROM events) WHERE event_type = 'view'"""
)
def stream_last_writes(spark, d):
    """The stateful form of the reaching write."""
    return streams.run_to_table(streams.last_writes(streams.read_events(spark, d)), spark)
