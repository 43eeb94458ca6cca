"""Queries of the aggregate, join, ranking, set and routing operators on the fact tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.functions import ids, region
from factweave.functions.text import key
from factweave.operators import agg, joins, rank, rejects, shared
from factweave.operators.graph import classify_objects
from factweave.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with its DuckDB text."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_TRIM = "trim({0}, chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' ')"
_KEY = f"nullif(lower({_TRIM}), '')"

_LATEST = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY edge_id ORDER BY ingested_at DESC NULLS LAST, exported_at DESC NULLS LAST, site_id DESC NULLS LAST, function_id DESC NULLS LAST, object_id DESC NULLS LAST) AS n
FROM accesses WHERE edge_id IS NOT NULL) WHERE n = 1"""


_ORDER = ["ingested_at", "exported_at", "site_id", "function_id", "object_id"]


def delivered(spark: SparkSession, d: str, *columns: str, only: Callable[[DataFrame], DataFrame] = lambda a: a, repeated: bool = True) -> DataFrame:
    """The named columns of accesses with repeated deliveries removed, the latest kept, and keys normalised.

    The latest row is a maximum that combines map-side, so an id with very many deliveries is no single
    task's. What isn't named isn't read, but for the columns of the order. `only` takes some of the ids; where none of them is delivered
    twice, repeated=False leaves the rows where they are.
    """
    wanted = list(dict.fromkeys(["edge_id", *_ORDER, *columns]))
    a = only(table(spark, d, "accesses").select(*wanted).filter("edge_id IS NOT NULL"))
    last = agg.keep_by(a, ["edge_id"], F.struct(*_ORDER), last=True) if repeated else a
    for c in ("function_id", "binary_sha256"):
        if c in wanted:
            last = last.withColumn(c, key(F.col(c)))
    return last.withColumn("base_object_id", ids.known("base_object_id")) if "base_object_id" in wanted else last


_D = f"""
d AS (SELECT edge_id, edge_kind, site_id, {_KEY.format("binary_sha256")} AS binary_sha256, {_KEY.format("function_id")} AS function_id, object_id,
  CASE WHEN trim(base_object_id) <> '' THEN base_object_id END AS base_object_id, value_id, access_width, region_offset, region_extent, selector_terms, field_path,
  storage_kind, candidate_class, deterministic_context_ids, context_ids, exported_at, ingested_at FROM ({_LATEST}))"""
_FIXED = "(coalesce(len(selector_terms), 0) = 0 AND region_offset >= 0 AND region_extent > 0)"


@query(f"WITH {_D} SELECT edge_id, site_id, function_id, object_id FROM d")
def u3_latest_delivery(spark, d):
    return delivered(spark, d, "site_id", "function_id", "object_id").select("edge_id", "site_id", "function_id", "object_id")


@query(
    f"""WITH {_D}, r AS (SELECT edge_id, unnest(list_filter([
  CASE WHEN site_id IS NULL OR trim(site_id) = '' OR function_id IS NULL THEN 'concrete_access_identity_missing' END,
  CASE WHEN object_id IS NULL OR trim(object_id) = '' THEN 'concrete_access_object_missing' END,
  CASE WHEN value_id IS NULL OR trim(value_id) = '' THEN 'concrete_access_value_atom_missing' END,
  CASE WHEN coalesce(len(selector_terms), 0) = 0 AND region_offset IS NULL THEN 'concrete_access_region_offset_missing' END,
  CASE WHEN coalesce(region_extent, access_width, 0) <= 0 THEN 'concrete_access_region_extent_missing' END,
  CASE storage_kind WHEN 'STACK_LOCAL' THEN 'ineligible_stack_object' WHEN 'CALL_RESULT_OBJECT' THEN 'ineligible_call_result_object'
    WHEN 'STATIC_WRITABLE_DATA' THEN NULL WHEN 'ABSOLUTE_SRAM' THEN NULL ELSE 'unresolved_memory_object' END], lambda x: x IS NOT NULL)) AS reason FROM d)
SELECT reason, count(*) AS rejects, count(DISTINCT edge_id) AS edges FROM r GROUP BY reason"""
)
def sel_admission_rejects(spark, d):
    k = F.col("storage_kind")
    empty = lambda c: ids.known(c).isNull()
    rules = [
        ("concrete_access_identity_missing", empty("site_id") | F.col("function_id").isNull()),
        ("concrete_access_object_missing", empty("object_id")),
        ("concrete_access_value_atom_missing", empty("value_id")),
        ("concrete_access_region_offset_missing", (F.size(F.coalesce("selector_terms", F.array())) == 0) & F.col("region_offset").isNull()),
        ("concrete_access_region_extent_missing", F.coalesce("region_extent", "access_width", F.lit(0)) <= 0),
        ("ineligible_stack_object", k == "STACK_LOCAL"),
        ("ineligible_call_result_object", k == "CALL_RESULT_OBJECT"),
        ("unresolved_memory_object", k.isNull() | ~k.isin("STACK_LOCAL", "CALL_RESULT_OBJECT", "STATIC_WRITABLE_DATA", "ABSOLUTE_SRAM")),
    ]
    _, out = rejects.admit(delivered(spark, d, "site_id", "function_id", "object_id", "value_id", "selector_terms", "region_offset", "region_extent", "access_width", "storage_kind"), rules)
    return out.groupBy("reason").agg(F.count("*").alias("rejects"), F.count_distinct("edge_id").alias("edges"))


@query(
    f"""WITH {_D}, w AS (SELECT binary_sha256, base_object_id, region_offset AS s, region_offset + region_extent AS e, edge_kind, count(*) AS n FROM d
  WHERE {_FIXED} AND binary_sha256 IS NOT NULL AND base_object_id IS NOT NULL GROUP BY ALL)
SELECT a.binary_sha256, a.base_object_id, a.s AS start_w, a.e AS end_w, a.n AS rows_w, b.s AS start_r, b.e AS end_r, b.n AS rows_r,
  greatest(a.s, b.s) AS shared_start, least(a.e, b.e) AS shared_end
FROM w a JOIN w b USING (binary_sha256, base_object_id) WHERE a.edge_kind = 'WRITE' AND b.edge_kind = 'READ' AND greatest(a.s, b.s) < least(a.e, b.e)"""
)
def j4_region_overlaps(spark, d):
    return shared.overlapping_regions(delivered(spark, d, "binary_sha256", "base_object_id", "edge_kind", "region_offset", "region_extent", "selector_terms"), ["binary_sha256", "base_object_id"])


@query(
    f"""WITH {_D}, t AS (SELECT *, region_offset AS s, region_offset + region_extent AS e,
    CASE WHEN len(list_distinct(deterministic_context_ids)) = 1 THEN list_distinct(deterministic_context_ids)[1] END AS ctx FROM d
  WHERE {_FIXED} AND function_id IS NOT NULL AND binary_sha256 IS NOT NULL AND base_object_id IS NOT NULL),
w AS (SELECT DISTINCT binary_sha256, base_object_id, s, e, function_id, ctx FROM t WHERE edge_kind = 'WRITE'),
r AS (SELECT DISTINCT binary_sha256, base_object_id, s, e, function_id, ctx FROM t WHERE edge_kind = 'READ'),
p AS (SELECT w.binary_sha256, w.base_object_id, w.s, w.e, r.function_id AS rf, (r.function_id <> w.function_id) AS other,
    (r.function_id <> w.function_id AND r.ctx <> w.ctx) AS sure FROM w JOIN r ON w.binary_sha256 = r.binary_sha256 AND w.base_object_id = r.base_object_id
    AND greatest(w.s, r.s) < least(w.e, r.e)),
g AS (SELECT binary_sha256, base_object_id, s, e, count(DISTINCT rf) AS readers, bool_or(other) AS other, bool_or(sure) AS sure FROM p GROUP BY ALL),
k AS (SELECT binary_sha256, base_object_id, s, e, count(DISTINCT function_id) AS writers FROM w GROUP BY ALL),
a AS (SELECT DISTINCT binary_sha256, base_object_id, true AS has_read FROM d WHERE edge_kind = 'READ' AND function_id IS NOT NULL AND binary_sha256 IS NOT NULL AND base_object_id IS NOT NULL),
f AS (SELECT k.*, coalesce(readers, 0) AS readers, sure,
    CASE WHEN has_read IS NULL THEN 'object_has_no_read' WHEN readers IS NULL THEN 'only_disjoint_reads' WHEN NOT other THEN 'only_same_function_reads' END AS reason
  FROM k LEFT JOIN g USING (binary_sha256, base_object_id, s, e) LEFT JOIN a USING (binary_sha256, base_object_id))
SELECT binary_sha256, base_object_id, s AS start, e AS "end", writers, readers,
  CASE WHEN reason IS NULL THEN CASE WHEN coalesce(sure, false) THEN 'DISTINCT_DETERMINISTIC_CONTEXT' ELSE 'DISTINCT_FUNCTION_HEURISTIC_CONTEXT' END END AS relation,
  reason IS NULL AS admitted, reason FROM f"""
)
def g26_shared_regions(spark, d):
    return shared.shared_regions(delivered(spark, d, "binary_sha256", "base_object_id", "edge_kind", "function_id", "region_offset", "region_extent", "selector_terms", "deterministic_context_ids"), ["binary_sha256", "base_object_id"])


@query(
    f"""WITH {_D}, t AS (SELECT DISTINCT binary_sha256, base_object_id, edge_kind, function_id AS f, CASE WHEN len(list_distinct(deterministic_context_ids)) = 1 THEN list_distinct(deterministic_context_ids)[1] END AS ctx,
    CASE WHEN len(coalesce(selector_terms, [])) > 0 THEN 'dynamic' WHEN {_FIXED} THEN 'fixed' ELSE 'unknown' END AS region,
    CASE WHEN len(coalesce(selector_terms, [])) = 0 THEN region_offset END AS s, CASE WHEN len(coalesce(selector_terms, [])) = 0 THEN region_extent END AS x
  FROM d WHERE function_id IS NOT NULL AND binary_sha256 IS NOT NULL AND base_object_id IS NOT NULL),
k AS (SELECT binary_sha256, base_object_id, region, s, x, count(DISTINCT f) AS writers FROM t WHERE edge_kind = 'WRITE' GROUP BY ALL),
p AS (SELECT w.binary_sha256, w.base_object_id, w.region, w.s, w.x, r.f AS rf, r.f <> w.f AS other, r.f <> w.f AND r.ctx <> w.ctx AS sure, r.f <> w.f AND (w.region = 'dynamic' OR r.region = 'dynamic') AS may
  FROM t w JOIN t r USING (binary_sha256, base_object_id) WHERE w.edge_kind = 'WRITE' AND r.edge_kind = 'READ'
    AND (w.region = 'dynamic' OR r.region = 'dynamic' OR (w.region = 'fixed' AND r.region = 'fixed' AND greatest(w.s, r.s) < least(w.s + w.x, r.s + r.x)))),
g AS (SELECT binary_sha256, base_object_id, region, s, x, count(DISTINCT rf) AS readers, bool_or(other) AS other, bool_or(sure) AS sure, bool_or(may) AS may FROM p GROUP BY ALL),
a AS (SELECT DISTINCT binary_sha256, base_object_id, true AS has_read FROM t WHERE edge_kind = 'READ'),
f AS (SELECT k.*, coalesce(g.readers, 0) AS readers, g.sure, g.may,
    CASE WHEN has_read IS NULL THEN 'object_has_no_read' WHEN g.readers IS NULL THEN 'only_disjoint_reads' WHEN NOT g.other THEN 'only_same_function_reads' END AS reason
  FROM k LEFT JOIN g ON k.binary_sha256 = g.binary_sha256 AND k.base_object_id = g.base_object_id AND k.region = g.region AND k.s IS NOT DISTINCT FROM g.s AND k.x IS NOT DISTINCT FROM g.x
    LEFT JOIN a ON k.binary_sha256 = a.binary_sha256 AND k.base_object_id = a.base_object_id)
SELECT binary_sha256, base_object_id, region, s AS region_offset, x AS region_extent, writers, readers, CASE WHEN reason IS NULL THEN CASE WHEN may THEN 'MAY_OVERLAP' ELSE 'EXACT_OVERLAP' END END AS region_relation,
  CASE WHEN reason IS NULL THEN CASE WHEN coalesce(sure, false) THEN 'DISTINCT_DETERMINISTIC_CONTEXT' ELSE 'DISTINCT_FUNCTION_HEURISTIC_CONTEXT' END END AS relation, reason IS NULL AS admitted, reason FROM f"""
)
def g26_shared_accesses(spark, d):
    """All write classes, selector-based ones too; g26_shared_regions is the part with fixed regions on both sides."""
    return shared.shared_accesses(delivered(spark, d, "binary_sha256", "base_object_id", "edge_kind", "function_id", "region_offset", "region_extent", "selector_terms", "deterministic_context_ids"), ["binary_sha256", "base_object_id"])


@query(
    f"""WITH {_D} SELECT base_object_id, count(*) FILTER (WHERE edge_kind = 'WRITE') AS writes, count(*) FILTER (WHERE edge_kind = 'READ') AS reads,
  count(DISTINCT function_id) AS functions, count(*) FILTER (WHERE edge_kind = 'WRITE') > 0 AND count(*) FILTER (WHERE edge_kind = 'READ') > 0 AND count(DISTINCT function_id) > 1 AS shared
FROM d WHERE base_object_id IS NOT NULL GROUP BY 1"""
)
def g27_object_classes(spark, d):
    return classify_objects(delivered(spark, d, "base_object_id", "edge_kind", "function_id"), "base_object_id", "edge_kind")


@query(
    f"""WITH {_D}, t AS (SELECT object_id, unnest(list_distinct([object_id, CASE WHEN starts_with(object_id, 'obj:') THEN substr(object_id, 5) ELSE 'obj:' || object_id END,
    CASE WHEN regexp_matches(object_id, '^(obj:)?(symbol|global|ram):[0-9a-fA-F]{{1,15}}(:|$)') THEN
      'address:' || coalesce(nullif(ltrim(lower(regexp_extract(object_id, '(symbol|global|ram):([0-9a-fA-F]+)', 2)), '0'), ''), '0') END])) AS alias
  FROM (SELECT DISTINCT object_id FROM d WHERE trim(object_id) <> '')),
o AS (SELECT unnest(list_distinct([object_id, CASE WHEN starts_with(object_id, 'obj:') THEN substr(object_id, 5) ELSE 'obj:' || object_id END,
    CASE WHEN regexp_matches(object_id, '^(obj:)?(symbol|global|ram):[0-9a-fA-F]{{1,15}}(:|$)') THEN
      'address:' || coalesce(nullif(ltrim(lower(regexp_extract(object_id, '(symbol|global|ram):([0-9a-fA-F]+)', 2)), '0'), ''), '0') END])) AS alias, source_id
  FROM (SELECT source_id, unnest(outputs).object_id AS object_id FROM sources) WHERE trim(object_id) <> '')
SELECT DISTINCT source_id, object_id FROM o JOIN t USING (alias) WHERE alias IS NOT NULL AND source_id IS NOT NULL"""
)
def j3_source_object_aliases(spark, d):
    outputs = table(spark, d, "sources").select("source_id", F.explode("outputs").alias("o")).select("source_id", F.col("o.object_id").alias("out_object"))
    objects = delivered(spark, d, "object_id").select("object_id", F.col("object_id").alias("id")).distinct()
    pairs = joins.alias_join(outputs.filter(ids.known("out_object").isNotNull() & F.col("source_id").isNotNull()), objects.filter(ids.known("object_id").isNotNull()), "out_object", "object_id", "source_id", "id")
    return pairs.withColumnRenamed("id", "object_id")


@query(
    f"""WITH {_D} SELECT binary_sha256, function_id, CASE WHEN min(storage_kind) = max(storage_kind) THEN min(storage_kind) END AS storage_kind,
  CASE WHEN count(candidate_class) = count(*) AND min(candidate_class) = max(candidate_class) THEN min(candidate_class) END AS candidate_class FROM d
WHERE function_id IS NOT NULL AND binary_sha256 IS NOT NULL GROUP BY 1, 2"""
)
def a1_unanimous_storage(spark, d):
    return delivered(spark, d, "binary_sha256", "function_id", "storage_kind", "candidate_class").filter("function_id IS NOT NULL AND binary_sha256 IS NOT NULL").groupBy("binary_sha256", "function_id").agg(
        agg.unique_or_null("storage_kind").alias("storage_kind"), agg.unanimous("candidate_class").alias("candidate_class")
    )


@query(f"WITH {_D} SELECT edge_kind, storage_kind, count(*) AS n FROM d GROUP BY ALL")
def a2_kind_histogram(spark, d):
    return delivered(spark, d, "edge_kind", "storage_kind").groupBy("edge_kind", "storage_kind").agg(F.count("*").alias("n"))


@query(f"WITH {_D} SELECT binary_sha256, coalesce(sum(coalesce(access_width, 0)), 0)::BIGINT AS total_access_width, coalesce(sum(coalesce(region_extent, 0)), 0)::BIGINT AS total_region_extent FROM d GROUP BY 1")
def a3_prefixed_sums(spark, d):
    a = delivered(spark, d, "binary_sha256", "access_width", "region_extent").select("binary_sha256", F.col("access_width").cast("bigint").alias("access_width"), "region_extent")
    return a.groupBy("binary_sha256").agg(*agg.prefixed_sums(["access_width", "region_extent"], "total_"))


@query(
    f"""WITH f AS (SELECT {_KEY.format("binary_sha256")} AS b, {_KEY.format("function_id")} AS f, arg_min(length(coalesce(body, '')), (exported_at, function_row_id)) AS chars FROM function_corpus GROUP BY 1, 2)
SELECT b AS binary_sha256, count(*) AS functions, sum(chars)::BIGINT AS chars FROM f WHERE b IS NOT NULL AND f IS NOT NULL GROUP BY 1"""
)
def a4_first_wins_totals(spark, d):
    f = table(spark, d, "function_corpus").select(key(F.col("binary_sha256")).alias("binary_sha256"), key(F.col("function_id")).alias("function_id"), F.length(F.coalesce("body", F.lit(""))).alias("chars"), "exported_at", "function_row_id")
    first = agg.keep_by(f.filter("binary_sha256 IS NOT NULL AND function_id IS NOT NULL"), ["binary_sha256", "function_id"], F.struct("exported_at", "function_row_id"))
    return first.groupBy("binary_sha256").agg(F.count("*").alias("functions"), F.sum("chars").alias("chars"))


@query(
    """SELECT source_label, count(*) AS total, count(*) FILTER (WHERE decision = 'ACCEPT_DETERMINISTIC') AS confirmed,
  count(*) FILTER (WHERE decision = 'ACCEPT_DETERMINISTIC') / nullif(count(*), 0) AS rate FROM sources GROUP BY 1"""
)
def a5_decision_rates(spark, d):
    hit = F.col("decision") == "ACCEPT_DETERMINISTIC"
    return table(spark, d, "sources").groupBy("source_label").agg(F.count("*").alias("total"), F.count_if(hit).alias("confirmed"), agg.rates(hit).alias("rate"))


@query(
    """WITH c AS (SELECT sink_form, count(*) FILTER (WHERE review_status LIKE '%RETAINED' AND NOT ev) AS tp, count(*) FILTER (WHERE review_status = 'REJECTED' AND NOT ev) AS fp,
  count(*) FILTER (WHERE review_status = 'NOT_STATICALLY_REFOUND' AND NOT ev) AS fn FROM (SELECT *, starts_with(lower(trim(coalesce(corpus, ''))), 'evaluation') AS ev FROM cve_views) GROUP BY 1)
SELECT sink_form, tp, fp, fn, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall, 2 * tp / nullif(2 * tp + fp + fn, 0) AS f1 FROM c"""
)
def a6_precision_recall(spark, d):
    training = ~F.startswith(F.lower(F.trim(F.coalesce("corpus", F.lit("")))), F.lit("evaluation"))
    s = F.col("review_status")
    c = table(spark, d, "cve_views").groupBy("sink_form").agg(
        F.count_if(s.like("%RETAINED") & training).alias("tp"), F.count_if((s == "REJECTED") & training).alias("fp"), F.count_if((s == "NOT_STATICALLY_REFOUND") & training).alias("fn")
    )
    return c.select("sink_form", "tp", "fp", "fn", *(v.alias(k) for k, v in agg.precision_recall(F.col("tp"), F.col("fp"), F.col("fn")).items()))


@query(
    f"""WITH o AS (SELECT source_kind, {_KEY.format("function_id")} AS f, count(DISTINCT decision) AS k, min(decision) AS decision FROM sources WHERE decision IS NOT NULL AND {_KEY.format("function_id")} IS NOT NULL GROUP BY 1, 2),
g AS (SELECT source_kind, count(*) AS implementations, count(*) FILTER (WHERE k > 1) AS conflicts, count(*) FILTER (WHERE k = 1 AND decision = 'ACCEPT_DETERMINISTIC') AS positives, count(*) FILTER (WHERE k = 1) AS judged FROM o GROUP BY 1)
SELECT *, positives / nullif(judged, 0) AS precision, concat_ws(',', CASE WHEN judged < 50 THEN 'too_few_implementations' END, CASE WHEN coalesce(positives / nullif(judged, 0), 0) < 0.6 THEN 'precision_under_threshold' END,
  CASE WHEN conflicts > 0 THEN 'conflicting_labels' END) AS unmet FROM g"""
)
def a7_threshold_gate(spark, d):
    s = table(spark, d, "sources").select("source_kind", key(F.col("function_id")).alias("implementation"), "decision").filter("decision IS NOT NULL AND implementation IS NOT NULL")
    return agg.threshold_gate(s, ["source_kind"], "implementation", "decision", "ACCEPT_DETERMINISTIC", 50, 0.6)


@query("SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
def a8_crosstab(spark, d):
    t = table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count()
    return t.select("o_orderpriority", *(F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c.lower()) for c in "FOP"))


@query(f"WITH {_D} SELECT base_object_id, array_to_string(list_sort(list(DISTINCT storage_kind)), ',') AS kinds FROM d WHERE base_object_id IS NOT NULL GROUP BY 1")
def a9_sorted_sets(spark, d):
    a = delivered(spark, d, "base_object_id", "storage_kind").filter("base_object_id IS NOT NULL")
    return a.groupBy("base_object_id").agg(F.array_join(F.sort_array(F.collect_set("storage_kind")), ",").alias("kinds"))


@query(
    """WITH l AS (SELECT c_acctbal, unnest(['all', c_mktsegment, CASE WHEN c_acctbal > 0 THEN 'in_credit' END, CASE WHEN c_acctbal > 0 THEN c_mktsegment || '_in_credit' END]) AS label FROM customer)
SELECT label, count(*) AS n, min(c_acctbal) AS least, max(c_acctbal) AS most FROM l WHERE label IS NOT NULL GROUP BY 1"""
)
def a10_multi_label(spark, d):
    c = table(spark, d, "customer").select("c_acctbal", "c_mktsegment")
    credit = F.col("c_acctbal") > 0
    m = agg.multi_label(c, [F.lit("all"), F.col("c_mktsegment"), F.when(credit, F.lit("in_credit")), F.when(credit, F.concat("c_mktsegment", F.lit("_in_credit")))])
    return m.groupBy("label").agg(F.count("*").alias("n"), F.min("c_acctbal").alias("least"), F.max("c_acctbal").alias("most"))


@query(
    """SELECT alert_id, arg_min(plan_field_id, (CASE WHEN field_size > 0 THEN field_size ELSE 1073741824 END, plan_field_id, planned_at)) AS first_field, count(*) AS fields,
  count(DISTINCT template_id) AS templates, coalesce(sum(field_size) FILTER (WHERE field_role = 'len'), 0)::BIGINT AS len_bytes FROM plan_fields WHERE alert_id IS NOT NULL AND plan_field_id IS NOT NULL GROUP BY 1"""
)
def a11_representatives(spark, d):
    p = table(spark, d, "plan_fields").filter("alert_id IS NOT NULL AND plan_field_id IS NOT NULL").select("alert_id", "plan_field_id", "planned_at", "field_size", "template_id", "field_role")
    order = F.struct(F.when(F.col("field_size") > 0, F.col("field_size")).otherwise(1 << 30), "plan_field_id", "planned_at")
    counts = {"fields": F.count("*"), "templates": F.count_distinct("template_id"), "len_bytes": F.coalesce(F.sum(F.when(F.col("field_role") == "len", F.col("field_size"))), F.lit(0)).cast("bigint")}
    return agg.representatives(p, ["alert_id"], order, counts).select("alert_id", F.col("plan_field_id").alias("first_field"), "fields", "templates", "len_bytes")


@query(
    f"""WITH {_D}, e AS (SELECT binary_sha256, base_object_id, site_id, arg_max(edge_id, (ingested_at, edge_id)) AS edge_id FROM d WHERE binary_sha256 IS NOT NULL AND base_object_id IS NOT NULL AND site_id IS NOT NULL GROUP BY ALL),
u AS (SELECT binary_sha256, base_object_id, array_to_string(list_sort(list_distinct(flatten(list(coalesce(context_ids, []))))), ',') AS contexts FROM d WHERE binary_sha256 IS NOT NULL AND base_object_id IS NOT NULL AND site_id IS NOT NULL GROUP BY ALL)
SELECT binary_sha256, base_object_id, contexts, count(*) AS sites, min(edge_id) AS first_edge FROM e JOIN u USING (binary_sha256, base_object_id) GROUP BY ALL"""
)
def a12_merged_lists(spark, d):
    a = delivered(spark, d, "binary_sha256", "base_object_id", "site_id", "context_ids").filter("binary_sha256 IS NOT NULL AND base_object_id IS NOT NULL AND site_id IS NOT NULL")
    rows = a.select("binary_sha256", "base_object_id", "context_ids", F.array(F.struct("site_id", "ingested_at", "edge_id")).alias("accesses"))
    m = agg.merge_lists(rows, ["binary_sha256", "base_object_id"], {"accesses": ("site_id", "ingested_at")}, ["context_ids"])
    return m.select(
        "binary_sha256", "base_object_id", F.array_join("context_ids", ",").alias("contexts"), F.size("accesses").cast("bigint").alias("sites"),
        F.array_min(F.transform("accesses", lambda e: e["edge_id"])).alias("first_edge"),
    )


@query(
    """WITH n AS (SELECT l_orderkey, count(DISTINCT l_suppkey) AS groups FROM lineitem GROUP BY 1),
k AS (SELECT l_orderkey, l_returnflag, count(DISTINCT l_suppkey) AS within, count(DISTINCT l_linestatus) AS v, min(l_linestatus) AS l_linestatus FROM lineitem WHERE l_linestatus IS NOT NULL GROUP BY 1, 2)
SELECT l_orderkey, l_returnflag, l_linestatus FROM k JOIN n USING (l_orderkey) WHERE within = groups AND v = 1"""
)
def a13_all_groups_agree(spark, d):
    return agg.in_all_groups(table(spark, d, "lineitem"), ["l_orderkey"], "l_suppkey", "l_returnflag", "l_linestatus")


@query("SELECT p_brand, l_suppkey, count(DISTINCT l_partkey) AS support FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2 HAVING count(DISTINCT l_partkey) >= 8")
def a14_minimum_support(spark, d):
    l, p = table(spark, d, "lineitem"), table(spark, d, "part")  # noqa: E741
    return agg.supported(l.join(p, l["l_partkey"] == p["p_partkey"]), ["p_brand", "l_suppkey"], "l_partkey", 8)


@query(
    f"""WITH {_D} SELECT edge_id, len(list_filter(coalesce(selector_terms, []), lambda t: t.stride > 4)) > 0 AS wide_stride,
  len(list_filter(coalesce(context_ids, []), lambda c: NOT starts_with(c, 'ctx:'))) = 0 AS all_contexts, coalesce(list_sum([t.stride FOR t IN coalesce(selector_terms, [])]), 0)::BIGINT AS strides FROM d"""
)
def a15_nested_counts(spark, d):
    terms, contexts = F.coalesce("selector_terms", F.array()), F.coalesce("context_ids", F.array())
    return delivered(spark, d, "selector_terms", "context_ids").select(
        "edge_id", F.coalesce(F.exists(F.col("selector_terms"), lambda t: t["stride"] > 4), F.lit(False)).alias("wide_stride"),
        F.forall(F.coalesce("context_ids", F.array().cast("array<string>")), lambda c: c.startswith("ctx:")).alias("all_contexts"),
        F.coalesce(F.aggregate("selector_terms", F.lit(0).cast("bigint"), lambda a, t: a + F.coalesce(t["stride"], F.lit(0))), F.lit(0)).cast("bigint").alias("strides"),
    )


@query(
    f"""WITH {_D}, b AS (SELECT binary_sha256, regexp_extract(base_object_id, '^obj:ram:([0-9a-f]{{1,15}})$', 1) AS h, function_id, edge_kind FROM d),
a AS (SELECT binary_sha256, (('0x' || h)::BIGINT & ~255) AS bucket, function_id, edge_kind FROM b WHERE h <> ''),
s AS (SELECT binary_sha256, bucket, count(*) FILTER (WHERE edge_kind = 'WRITE') AS stores, count(*) FILTER (WHERE edge_kind = 'READ') AS loads, count(DISTINCT function_id) AS functions FROM a
  WHERE bucket BETWEEN 536870912 AND 1073741823 AND binary_sha256 IS NOT NULL GROUP BY 1, 2)
SELECT binary_sha256, bucket, stores, loads, functions, place FROM (SELECT *, row_number() OVER (PARTITION BY binary_sha256 ORDER BY least(stores, loads) DESC, functions DESC, bucket) AS place FROM s) WHERE place <= 5"""
)
def a16_object_buckets(spark, d):
    h = ids.hex_address(F.nullif(F.regexp_extract("base_object_id", r"^obj:ram:([0-9a-f]{1,15})$", 1), F.lit("")))
    a = delivered(spark, d, "binary_sha256", "base_object_id", "edge_kind", "function_id").withColumn("bucket", ids.page(h, 8)).filter("bucket BETWEEN 536870912 AND 1073741823 AND binary_sha256 IS NOT NULL")
    s = a.groupBy("binary_sha256", "bucket").agg(F.count_if(F.col("edge_kind") == "WRITE").alias("stores"), F.count_if(F.col("edge_kind") == "READ").alias("loads"), F.count_distinct("function_id").alias("functions"))
    return rank.top_k(s, ["binary_sha256"], [F.desc(F.least("stores", "loads")), F.desc("functions"), F.asc("bucket")], 5).filter("selected").drop("selected")


@query("SELECT l_orderkey, CASE WHEN bool_and(l_quantity IS NOT NULL AND l_linenumber > 0) THEN sum(l_quantity) END AS quantity, max(l_linenumber) AS lines FROM lineitem GROUP BY 1")
def a17_complete_sums(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        agg.complete_sum(F.col("l_quantity"), F.col("l_quantity").isNotNull() & (F.col("l_linenumber") > 0)).alias("quantity"), F.max("l_linenumber").alias("lines")
    )


@query(
    f"""WITH s AS (SELECT source_id, {_KEY.format("source_definition_id")} AS k, decision FROM sources), f AS (SELECT DISTINCT {_KEY.format("source_definition_id")} AS k FROM source_definitions)
SELECT source_id, decision, CASE WHEN f.k IS NULL THEN 'contradiction' WHEN decision IS NULL OR NOT starts_with(decision, 'ACCEPT') THEN 'non_alert' ELSE 'alert' END AS route, count(*) AS n FROM s LEFT JOIN f ON s.k = f.k GROUP BY ALL"""
)
def j2_routed_join(spark, d):
    s = table(spark, d, "sources").select("source_id", key(F.col("source_definition_id")).alias("k"), "decision")
    f = table(spark, d, "source_definitions").select(key(F.col("source_definition_id")).alias("k"), F.lit(True).alias("held")).filter("k IS NOT NULL").distinct()
    routed = rejects.route(s.join(f, "k", "left"), [("contradiction", F.col("held").isNull()), ("non_alert", ~F.coalesce(F.startswith(F.col("decision"), F.lit("ACCEPT")), F.lit(False)))], "alert")
    return routed.groupBy("source_id", "decision", "route").agg(F.count("*").alias("n"))


@query(
    """WITH b AS (SELECT p_partkey, p_size, p_size * 2000.0::DOUBLE AS s, p_size * 2000.0::DOUBLE + 5000.0 + 100.0 * (p_partkey % 7) AS e FROM part),
m AS (SELECT o_orderkey, o_totalprice, arg_min(p_partkey, (e - s, s, p_partkey)) AS container, min(e - s) AS container_length FROM orders JOIN b ON o_totalprice >= s AND o_totalprice < e GROUP BY 1, 2)
SELECT o_orderkey, o_totalprice, container, container_length FROM orders LEFT JOIN m USING (o_orderkey, o_totalprice)"""
)
def j5_tightest_container(spark, d):
    p = table(spark, d, "part").selectExpr("1 AS k", "p_partkey", "p_size * 2000.0D AS s", "p_size * 2000.0D + 5000.0D + 100.0D * (p_partkey % 7) AS e")
    o = table(spark, d, "orders").selectExpr("1 AS k", "o_orderkey", "o_totalprice")
    return joins.tightest_container(o, p, ["k"], "o_totalprice", "s", "e", "p_partkey", 2000).select("o_orderkey", "o_totalprice", "container", "container_length")


@query(
    """SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_write
FROM events QUALIFY event_type = 'view'"""
)
def j7_last_write(spark, d):
    e = joins.last_before(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "purchase", F.col("event_id"))
    return e.filter("event_type = 'view'").select("event_id", "user_id", "last_write")


@query(
    """WITH w AS (SELECT event_id, user_id, event_type, last_value(CASE WHEN event_type IN ('signup', 'error') THEN {'k': event_type, 'i': event_id} END IGNORE NULLS)
  OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l FROM events)
SELECT event_id, user_id, l.i AS definition FROM w WHERE event_type = 'click' AND l.k = 'signup'"""
)
def j8_def_use(spark, d):
    e = joins.reaching_definitions(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type", "signup", "click", "error")
    return e.select("event_id", "user_id", F.col("def_at.event_id").alias("definition"))


@query(
    """WITH w AS (SELECT *, sum((event_type = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS window_no FROM events)
SELECT user_id, window_no::BIGINT AS window_no, count(*) FILTER (WHERE event_type = 'view') AS reads, min(ts) AS opened FROM w WHERE window_no > 0 GROUP BY 1, 2"""
)
def j9_event_windows(spark, d):
    w = joins.windows_between(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup").filter("window_no > 0")
    return w.groupBy("user_id", "window_no").agg(F.count_if(F.col("event_type") == "view").alias("reads"), F.min("ts").alias("opened"))


@query(
    f"""WITH {_D}, f AS (SELECT {_KEY.format("binary_sha256")} AS b, {_KEY.format("function_id")} AS f, func_name FROM function_corpus),
t0 AS (SELECT edge_id, 0 AS tier, func_name FROM d JOIN f ON d.binary_sha256 = f.b AND d.function_id = f.f),
t1 AS (SELECT edge_id, 1 AS tier, func_name FROM d JOIN f ON d.function_id = f.f),
u AS (SELECT edge_id, tier, CASE WHEN min(func_name) = max(func_name) THEN min(func_name) END AS func_name FROM (SELECT * FROM t0 UNION ALL SELECT * FROM t1) GROUP BY 1, 2),
v AS (SELECT edge_id, min(tier) AS tier, arg_min(CASE WHEN func_name IS NULL THEN '' ELSE func_name END, tier) AS n FROM u GROUP BY 1)
SELECT d.edge_id, v.tier, nullif(v.n, '') AS func_name FROM d LEFT JOIN v USING (edge_id)"""
)
def j13_tiered_names(spark, d):
    f = table(spark, d, "function_corpus").select(key(F.col("binary_sha256")).alias("binary_sha256"), key(F.col("function_id")).alias("function_id"), "func_name")
    both = f.filter("binary_sha256 IS NOT NULL AND function_id IS NOT NULL").groupBy("binary_sha256", "function_id").agg(F.collect_set("func_name").alias("names"))
    alone = f.filter("function_id IS NOT NULL").groupBy("function_id").agg(F.collect_set("func_name").alias("names"))
    names = lambda t, on: t.select(*on, F.explode("names").alias("func_name"))
    a = delivered(spark, d, "binary_sha256", "function_id").select("edge_id", "binary_sha256", "function_id")
    return joins.tiered(a, "edge_id", [(names(both, ["binary_sha256", "function_id"]), ["binary_sha256", "function_id"]), (names(alone, ["function_id"]), ["function_id"])], "func_name")


@query(
    f"""WITH a AS (SELECT DISTINCT alert_id FROM plan_fields WHERE alert_id IS NOT NULL),
b AS (SELECT alert_id, count(*) AS deliveries, count(DISTINCT coalesce(evidence_kind, '') || '|' || coalesce(detail, '')) AS kinds FROM evidence_items WHERE alert_id IS NOT NULL GROUP BY 1)
SELECT alert_id, CASE WHEN deliveries IS NULL THEN 'missing' WHEN a.alert_id IS NULL THEN 'unexpected' WHEN kinds > 1 THEN 'conflict' WHEN deliveries > 1 THEN 'duplicate' ELSE 'ok' END AS state, coalesce(deliveries, 0) AS deliveries
FROM a FULL OUTER JOIN b USING (alert_id)"""
)
def j17_reconcile(spark, d):
    want = table(spark, d, "plan_fields").filter("alert_id IS NOT NULL").select("alert_id")
    have = table(spark, d, "evidence_items").filter("alert_id IS NOT NULL")
    return joins.reconcile(want, have, ["alert_id"], F.concat(F.coalesce("evidence_kind", F.lit("")), F.lit("|"), F.coalesce("detail", F.lit(""))))


@query(
    """WITH n AS (SELECT o_orderkey, 'R' AS o_orderstatus FROM orders WHERE o_totalprice > 300000)
SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM n) UNION ALL SELECT * FROM n"""
)
def j18_replace_by_key(spark, d):
    o = table(spark, d, "orders")
    new = o.filter("o_totalprice > 300000").select("o_orderkey", F.lit("R").alias("o_orderstatus"))
    return joins.replace_by_key(o.select("o_orderkey", "o_orderstatus"), new, ["o_orderkey"])


@query(
    """WITH s AS (SELECT c_custkey, n_nationkey, (c_custkey * 7919 + n_nationkey * 104729) % 99991 AS score FROM customer, nation WHERE n_regionkey = c_nationkey % 5),
a AS (SELECT *, max(score) OVER (PARTITION BY c_custkey) AS lm, max(score) OVER (PARTITION BY n_nationkey) AS rm FROM s),
b AS (SELECT *, count(*) OVER (PARTITION BY c_custkey) AS ln, count(*) OVER (PARTITION BY n_nationkey) AS rn FROM a WHERE score = lm AND score = rm)
SELECT c_custkey, n_nationkey, score FROM b WHERE ln = 1 AND rn = 1"""
)
def j19_mutual_best(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    s = c.join(n, F.col("n_regionkey") == F.col("c_nationkey") % 5).select("c_custkey", "n_nationkey", ((F.col("c_custkey") * 7919 + F.col("n_nationkey").cast("bigint") * 104729) % 99991).alias("score"))
    return joins.display_binding(s, "c_custkey", "n_nationkey", "score")


@query(
    """SELECT o_orderkey, row_number() OVER (ORDER BY CASE WHEN o_orderpriority LIKE '1%' THEN 0 ELSE 1 END, o_totalprice DESC, o_orderkey) AS rank FROM orders"""
)
def r1_global_rank(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return rank.global_rank(o, [F.when(F.col("o_orderpriority").like("1%"), 0).otherwise(1).asc(), F.desc("o_totalprice"), F.asc("o_orderkey")]).select("o_orderkey", "rank")


@query("SELECT c_custkey, c_mktsegment, row_number() OVER w AS place, row_number() OVER w <= 10 AS selected FROM customer WINDOW w AS (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey)")
def r4_top_k_deferred(spark, d):
    return rank.top_k(table(spark, d, "customer"), ["c_mktsegment"], [F.desc("c_acctbal"), F.asc("c_custkey")], 10).select("c_custkey", "c_mktsegment", "place", "selected")


@query(
    """WITH a AS (SELECT c_custkey, c_mktsegment, c_nationkey, c_acctbal, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_acctbal DESC, c_custkey) > 1 AS again FROM customer),
b AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY again, c_acctbal DESC, c_custkey) AS place FROM a) SELECT c_mktsegment, c_custkey, c_nationkey, place FROM b WHERE place <= 30"""
)
def r5_diverse_top_k(spark, d):
    return rank.diverse_top_k(table(spark, d, "customer"), ["c_mktsegment"], "c_nationkey", [F.desc("c_acctbal"), F.asc("c_custkey")], 30).select("c_mktsegment", "c_custkey", "c_nationkey", "place")


@query()
def r6_diverse_sets(spark, d):
    """Greedy, so without SQL; tests hold it against a plain loop."""
    a = delivered(spark, d, "binary_sha256", "function_id", "base_object_id").filter("binary_sha256 IS NOT NULL AND function_id IS NOT NULL")
    rows = a.groupBy("binary_sha256", "function_id").agg(F.collect_set("base_object_id").alias("sites"), F.count("*").alias("n")).withColumn("rank", -F.col("n"))
    return rank.diverse_sets(rows, ["binary_sha256"], "function_id", "sites", "rank", 20)


@query(
    f"""WITH f AS (SELECT body_hash, arg_min(function_row_id, (exported_at, function_row_id)) AS canonical_id, list_sort(list(DISTINCT function_row_id)) AS r FROM function_corpus WHERE body_hash IS NOT NULL GROUP BY 1)
SELECT * FROM (SELECT canonical_id, unnest(r) AS duplicate_id FROM f) WHERE canonical_id <> duplicate_id"""
)
def r7_exact_duplicates(spark, d):
    f = table(spark, d, "function_corpus").filter("body_hash IS NOT NULL").select("body_hash", "function_row_id", "exported_at")
    return rank.exact_dedup(f, ["body_hash"], ["exported_at", "function_row_id"], "function_row_id")[1]


@query(
    """WITH s AS (SELECT o_custkey AS g, o_orderkey AS id, list_sort(list_distinct(list(l_returnflag || l_linestatus))) AS s, max(o_totalprice) AS w FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2),
c AS (SELECT a.g, a.id, b.id AS p, row_number() OVER (PARTITION BY a.g, a.id ORDER BY len(b.s), -b.w, b.id) AS n FROM s a JOIN s b ON a.g = b.g AND (len(b.s), -b.w, b.id) <= (len(a.s), -a.w, a.id) AND list_has_all(a.s, b.s))
SELECT g AS o_custkey, id, CASE WHEN p <> id THEN p END AS parent FROM c WHERE n = 1"""
)
def r8_subsumption(spark, d):
    o, l = table(spark, d, "orders"), table(spark, d, "lineitem")  # noqa: E741
    s = o.join(l, o["o_orderkey"] == l["l_orderkey"]).groupBy("o_custkey", "o_orderkey").agg(F.collect_set(F.concat("l_returnflag", "l_linestatus")).alias("s"), F.max("o_totalprice").alias("w"))
    return rank.subsumption(s, ["o_custkey"], "o_orderkey", "s", F.col("w"))


@query(f"WITH {_D} SELECT edge_id, array_to_string(list_slice(context_ids, greatest(1, len(context_ids)), len(context_ids)), ',') AS last_context FROM d WHERE context_ids IS NOT NULL")
def r12_last_items(spark, d):
    return delivered(spark, d, "context_ids").filter("context_ids IS NOT NULL").select("edge_id", F.array_join(rank.last_items("context_ids", 1), ",").alias("last_context"))


@query("SELECT function_id, decision FROM sources WHERE decision LIKE 'ACCEPT%' UNION SELECT function_id, edge_kind FROM accesses")
def u1_union_distinct(spark, d):
    s = table(spark, d, "sources").filter("decision LIKE 'ACCEPT%'").select("function_id", "decision")
    return s.unionByName(table(spark, d, "accesses").select("function_id", F.col("edge_kind").alias("decision"))).distinct()


@query(
    f"""WITH n AS (SELECT source_id, site_id, CASE decision WHEN 'ACCEPT_DETERMINISTIC' THEN 0 WHEN 'ACCEPT_HEURISTIC' THEN 1 ELSE 2 END AS r, decision, evidence_level FROM (SELECT DISTINCT source_id, site_id, decision, evidence_level FROM sources))
SELECT source_id, site_id, decision, evidence_level FROM n QUALIFY r = min(r) OVER (PARTITION BY source_id)"""
)
def u5_strongest_evidence(spark, d):
    s = table(spark, d, "sources").select("source_id", "site_id", "decision", "evidence_level")
    return agg.strongest(s, ["source_id"], F.when(F.col("decision") == "ACCEPT_DETERMINISTIC", 0).when(F.col("decision") == "ACCEPT_HEURISTIC", 1).otherwise(2))


@query(
    f"""WITH a AS (SELECT {_KEY.format('function_id')} AS k FROM accesses), f AS (SELECT {_KEY.format('function_id')} AS k FROM function_corpus)
(SELECT k, 'missing' AS side FROM a WHERE k IS NOT NULL EXCEPT SELECT k, 'missing' FROM f) UNION ALL (SELECT k, 'unused' AS side FROM f WHERE k IS NOT NULL EXCEPT SELECT k, 'unused' FROM a)"""
)
def u6_differences(spark, d):
    a, b = (table(spark, d, t).select(key(F.col("function_id")).alias("k")).filter("k IS NOT NULL").distinct() for t in ("accesses", "function_corpus"))
    out = a.join(b, "k", "left_anti").withColumn("side", F.lit("missing"))
    return out.unionByName(b.join(a, "k", "left_anti").withColumn("side", F.lit("unused")))


@query(f"SELECT {_KEY.format('function_id')} AS f FROM sources WHERE {_KEY.format('function_id')} IS NOT NULL INTERSECT SELECT {_KEY.format('function_id')} FROM function_corpus")
def u7_intersection(spark, d):
    a, b = table(spark, d, "sources").select(key(F.col("function_id")).alias("f")), table(spark, d, "function_corpus").select(key(F.col("function_id")).alias("f"))
    return a.filter("f IS NOT NULL").distinct().join(b, "f", "left_semi")


@query(
    """WITH n AS (SELECT doc_id, sha256(regexp_replace(lower(coalesce(text, '')), '[ \t\n\r\f\v]+', ' ', 'g')) AS f FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY f) AS representative FROM n"""
)
def u9_content_classes(spark, d):
    docs = table(spark, d, "documents")
    f = F.sha2(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"[ \t\n\r\f\x0B]+", " "), 256)
    return agg.classes(docs, f, "doc_id")[1]


@query(
    """SELECT plan_field_id, list_contains(['uint_le', 'uint_be'], encoding) AND field_size <= 8 AS numeric, coalesce(field_role, '') IN ('', 'other') AS unknown_role, count(*) AS n FROM plan_fields
WHERE regexp_matches(coalesce(field_name, ''), '^[a-z]+$') AND len(list_filter(coalesce(candidates, []), lambda c: c = '256')) > 0 GROUP BY ALL"""
)
def sel_predicates(spark, d):
    p = table(spark, d, "plan_fields")
    held = p.filter(F.coalesce("field_name", F.lit("")).rlike("^[a-z]+$") & F.exists(F.coalesce("candidates", F.array().cast("array<string>")), lambda c: c == "256"))
    return held.select("plan_field_id", (F.col("encoding").isin("uint_le", "uint_be") & (F.col("field_size") <= 8)).alias("numeric"), F.coalesce("field_role", F.lit("")).isin("", "other").alias("unknown_role")).groupBy("plan_field_id", "numeric", "unknown_role").agg(F.count("*").alias("n"))


@query(
    f"""WITH {_D} SELECT edge_id, 'access:' || substr(sha256(coalesce(site_id, '') || '|' || coalesce(object_id, '') || '|' || coalesce(edge_kind, '')), 1, 20) AS stable_id,
  CASE WHEN regexp_matches(base_object_id, '^obj:ram:[0-9a-f]{{1,15}}$') THEN ('0x' || substr(base_object_id, 9))::BIGINT END AS address,
  'region:' || base_object_id || ':offset:' || region_offset || ':extent:' || region_extent AS region_id FROM d"""
)
def f_ids_and_addresses(spark, d):
    return delivered(spark, d, "site_id", "object_id", "edge_kind", "base_object_id", "region_offset", "region_extent").select(
        "edge_id", ids.stable_id("access:", "site_id", "object_id", "edge_kind").alias("stable_id"),
        ids.hex_address(F.nullif(F.regexp_extract("base_object_id", r"^obj:ram:([0-9a-f]{1,15})$", 1), F.lit(""))).alias("address"),
        ids.region_id("base_object_id", "region_offset", "region_extent").alias("region_id"),
    )


@query("SELECT event_id, CASE WHEN v >= 128 THEN v - 256 ELSE v END AS signed1, CASE WHEN w >= 32768 THEN w - 65536 ELSE w END AS signed2 FROM (SELECT event_id, event_id % 256 AS v, (event_id * 37) % 65536 AS w FROM events)")
def f_signed_constants(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("event_id").alias("v"), (F.col("event_id") * 37).alias("w"))
    return e.select("event_id", ids.signed_constant("v", F.lit(1)).alias("signed1"), ids.signed_constant("w", F.lit(2)).alias("signed2"))


@query("SELECT event_id, (props->>'k')::BIGINT AS k, json_type(props, '$.k') IS NOT NULL AS has_k FROM events")
def f_json_props(spark, d):
    e = table(spark, d, "events")
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return e.select("event_id", k.alias("k"), k.isNotNull().alias("has_k"))


@query(
    f"""WITH {_D} SELECT w.edge_id AS write_id, r.edge_id AS read_id, CASE WHEN w.function_id = r.function_id THEN 'SAME_FUNCTION'
  WHEN len(list_distinct(w.deterministic_context_ids)) = 1 AND len(list_distinct(r.deterministic_context_ids)) = 1 AND w.deterministic_context_ids[1] <> r.deterministic_context_ids[1] THEN 'DISTINCT_DETERMINISTIC_CONTEXT'
  ELSE 'DISTINCT_FUNCTION_HEURISTIC_CONTEXT' END AS context,
  CASE WHEN w.o AND r.o THEN CASE WHEN greatest(w.region_offset, r.region_offset) < least(w.region_offset + w.region_extent, r.region_offset + r.region_extent) THEN 'EXACT_OVERLAP' ELSE 'DISJOINT' END
    WHEN coalesce(len(w.selector_terms), 0) > 0 OR coalesce(len(r.selector_terms), 0) > 0 THEN 'MAY_OVERLAP' ELSE 'DISJOINT' END AS relation
FROM (SELECT *, coalesce({_FIXED}, false) AS o, row_number() OVER (PARTITION BY binary_sha256, base_object_id ORDER BY edge_id) AS n FROM d WHERE binary_sha256 IS NOT NULL AND base_object_id IS NOT NULL AND function_id IS NOT NULL) w
JOIN (SELECT *, coalesce({_FIXED}, false) AS o, row_number() OVER (PARTITION BY binary_sha256, base_object_id ORDER BY edge_id) AS n FROM d WHERE binary_sha256 IS NOT NULL AND base_object_id IS NOT NULL AND function_id IS NOT NULL) r
ON w.binary_sha256 = r.binary_sha256 AND w.base_object_id = r.base_object_id AND r.n = w.n + 1"""
)
def f_region_relations(spark, d):
    """R2 and J16 of each access with the next one of its object: the relation, not all pairs."""
    from pyspark.sql import Window

    w = Window.partitionBy("binary_sha256", "base_object_id").orderBy("edge_id")
    a = delivered(spark, d, "binary_sha256", "base_object_id", "function_id", "region_offset", "region_extent", "selector_terms", "deterministic_context_ids").filter("binary_sha256 IS NOT NULL AND base_object_id IS NOT NULL AND function_id IS NOT NULL")
    part = F.struct("edge_id", "function_id", "region_offset", "region_extent", "selector_terms", "deterministic_context_ids")
    n = a.select("binary_sha256", "base_object_id", "edge_id", part.alias("a"), F.lead(part).over(w).alias("b")).filter("b IS NOT NULL")
    g = lambda s: [F.col(f"{s}.{c}") for c in ("region_offset", "region_extent", "selector_terms")]
    return n.select(
        F.col("a.edge_id").alias("write_id"), F.col("b.edge_id").alias("read_id"),
        region.different_context(F.col("a.function_id"), F.col("a.deterministic_context_ids"), F.col("b.function_id"), F.col("b.deterministic_context_ids")).alias("context"),
        region.access_relation(*g("a"), *g("b")).alias("relation"),
    )
