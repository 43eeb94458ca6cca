"""Queries of the backward search over the program facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.operators import graph, nested, search
from factweave.plans.corpus_sql import nodes_cte
from factweave.session import checkpoint, scratch, table


def _no(spark: SparkSession, shape: str) -> DataFrame:
    # the filter tells the optimizer that there is nothing to join
    return spark.createDataFrame([], shape).filter(F.lit(False))


def document_facts(spark: SparkSession, d: str) -> tuple[search.Facts, DataFrame]:
    """(facts, sinks) of the documents, each a program of its own: ids bear the record's number.

    sinks: search, sink, atom, object, one for each argument of a call and each input of a store. A load's address is its last input; a store's
    is its first, and its last the value, if it has two. Loads and stores at addresses in 'ram' read and write that object.
    No table carries copies, aliases and call outputs for the documents.
    """
    path = scratch(spark, "facts")
    nested.write_tagged(nested.emit_tagged(table(spark, d, "program_facts")), path)
    at = lambda c: F.concat_ws("|", F.col("record_id").cast("string"), c)
    named = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) == "", "").otherwise(at(c))
    call = F.from_json("call", "target_function_id string, argument_value_ids array<string>")
    ops = nested.read_table(spark, path, "op").select("record_id", "node_no", at("function_id").alias("function"), at(F.concat_ws("|", F.col("node_no").cast("string"), "site_id")).alias("site"), "mnemonic", call.alias("c"))

    def values(tag: str) -> DataFrame:
        rows = nested.read_table(spark, path, tag).withColumn("v", F.coalesce(F.nullif("value_id", F.lit("")), "object_id", F.lit("")))
        constant = F.coalesce((F.col("space") == "const") | F.col("is_constant"), F.lit(False)) | F.col("v").startswith("const:")
        return rows.select("record_id", F.col("parent_no").alias("node_no"), "pos", named("v").alias("atom"), named("object_id").alias("object"), F.coalesce("space", F.lit("")).alias("space"), F.coalesce("size", F.lit(1)).alias("size"), constant.alias("constant"), "object_id")

    key = ["record_id", "node_no"]
    i, o = values("input"), values("output")
    one = F.struct("pos", "atom", "object", "space", "size", "constant")
    inputs = i.groupBy(*key).agg(F.array_sort(F.collect_list(one)).alias("i"))  # an operation's inputs
    ops = checkpoint(ops.join(inputs, key, "left").withColumn("i", F.coalesce("i", F.array().cast(dict(inputs.dtypes)["i"]))))
    last, first = F.get(F.col("i"), F.size("i") - 1), F.get(F.col("i"), F.lit(0))
    live = F.transform(F.filter("i", lambda x: ~x["constant"]), lambda x: F.struct(x["atom"].alias("atom"), x["object"].alias("object")))
    made = o.select(*key, "atom", "size").filter("atom <> ''").join(ops, key)
    given = F.struct("site", "function", "mnemonic", F.when(F.col("mnemonic") == "LOAD", last["atom"]).alias("address_atom"), F.when(F.col("mnemonic") == "LOAD", last["object"]).alias("address_object"), live.alias("inputs"), F.size("i").alias("operands"))
    definitions = made.groupBy("atom").agg(F.min(given).alias("g")).select("atom", "g.*").withColumns({c: F.coalesce(c, F.lit("")) for c in ("address_atom", "address_object")})
    ram = lambda x: (x["space"] == "ram") & (x["object"] != "")
    zero = F.lit(0).cast("bigint")
    reads = made.filter((F.col("mnemonic") == "LOAD") & ram(last)).select(F.col("site").alias("edge"), "site", "atom", last["object"].alias("object"), zero.alias("start"), F.col("size").cast("bigint").alias("end"))
    stored = (F.col("mnemonic") == "STORE") & ram(first)
    value = F.when((F.size("i") > 1) & ~last["constant"], last["atom"])
    writes = ops.filter(stored).select(
        F.col("site").alias("edge"), "site", "function", first["object"].alias("target"), zero.alias("start"), first["size"].cast("bigint").alias("end"), F.coalesce(value, F.lit("")).alias("atom"), F.lit("").alias("object")
    )
    slot = lambda c, n: F.regexp_extract(c, "^param:(.+):([0-9]{1,9})$", n)
    formals = i.unionByName(o).filter(slot("object_id", 2) != "").select("atom", F.concat_ws("|", F.col("record_id").cast("string"), F.concat(F.lit("fn:"), slot("object_id", 1))).alias("function"), slot("object_id", 2).cast("int").alias("slot")).distinct()
    calls = ops.filter("c IS NOT NULL")
    target = F.when(F.coalesce("c.target_function_id", F.lit("")) != "", at("c.target_function_id"))
    each = calls.select("record_id", "site", target.alias("function"), F.posexplode("c.argument_value_ids").alias("slot", "v")).withColumn("atom", named("v"))
    actuals = each.filter("function IS NOT NULL").select(F.col("site").alias("edge"), "site", "function", "slot", "atom", F.lit("").alias("object"))
    targets = calls.select("site", F.col("site").alias("edge"), target.alias("function")).filter("function IS NOT NULL")
    returns = ops.filter("mnemonic = 'RETURN'").select("function", F.explode(live).alias("x")).select("function", "x.atom", "x.object").distinct()
    held = [checkpoint(x) for x in (definitions, reads, writes, formals, actuals, targets, returns)]
    nothing = [
        _no(spark, "effect string, site string, out_atom string, target string, atom string, object string, may boolean"),
        _no(spark, "alias string, site string, atom string, root_atom string, root_object string"),
        _no(spark, "effect string, site string, target string, start bigint, end bigint, atom string, object string"),
    ]
    stores = ops.filter("mnemonic = 'STORE'").select("site", F.posexplode(live).alias("slot", "x")).select(F.concat_ws("#", "site", F.col("slot").cast("string")).alias("search"), F.col("site").alias("sink"), "x.atom", F.lit("").alias("object"))
    sinks = stores.unionByName(each.select(F.concat_ws("#", "site", F.col("slot").cast("string")).alias("search"), F.col("site").alias("sink"), "atom", F.lit("").alias("object")))
    return search.Facts(*held, *nothing), sinks


def _plain(c: str) -> Column:
    """An id without its record's number."""
    return F.regexp_replace(c, r"^[0-9]+\|", "")


_FACTS = f"""{nodes_cte()},
x AS (SELECT n.record_id, n.fi, n.oi, n.vi, n.pos, n.node_kind, coalesce(nullif(node->>'value_id', ''), node->>'object_id', '') AS atom, coalesce(node->>'object_id', '') AS object, coalesce(node->>'space', '') AS space,
  coalesce((node->>'size')::BIGINT, 1) AS size, coalesce(node->>'space' = 'const' OR (node->>'is_constant')::BOOLEAN, FALSE) OR coalesce(nullif(node->>'value_id', ''), node->>'object_id', '') LIKE 'const:%' AS constant FROM n WHERE node_kind IN ('input', 'output')),
inp AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY record_id, fi, oi) AS many FROM x WHERE node_kind = 'input' WINDOW w AS (PARTITION BY record_id, fi, oi ORDER BY pos, atom, object)),
ops AS (SELECT record_id, fi, oi, function_id, site_id, node->>'mnemonic' AS mnemonic, node->'call' AS call, row_number() OVER (PARTITION BY record_id ORDER BY fi, oi) AS place FROM n WHERE node_kind = 'op'),
made AS (SELECT DISTINCT ON (record_id, atom) o.record_id, atom, o.size, p.fi, p.oi, function_id, site_id, mnemonic FROM x o JOIN ops p ON o.node_kind = 'output' AND o.record_id = p.record_id AND o.fi = p.fi AND o.oi = p.oi WHERE atom <> '' ORDER BY o.record_id, atom, place),
formals AS (SELECT DISTINCT record_id, atom, 'fn:' || regexp_extract(object, '^param:(.+):([0-9]{{1,9}})$', 1) AS function_id, regexp_extract(object, '^param:(.+):([0-9]{{1,9}})$', 2)::INT AS slot FROM x WHERE regexp_matches(object, '^param:(.+):([0-9]{{1,9}})$')),
calls AS (SELECT record_id, fi, oi, site_id, nullif(call->>'target_function_id', '') AS target, json_extract_string(call, '$.argument_value_ids[*]') AS args FROM ops WHERE json_type(call) = 'OBJECT'),
actuals AS (SELECT record_id, site_id, target, generate_subscripts(args, 1) - 1 AS slot, unnest(args) AS atom FROM calls),
returns AS (SELECT DISTINCT p.record_id, p.function_id, i.atom, i.object FROM ops p JOIN inp i ON i.record_id = p.record_id AND i.fi = p.fi AND i.oi = p.oi AND NOT constant WHERE mnemonic = 'RETURN' AND (atom <> '' OR object <> '')),
many AS (SELECT record_id, function_id, count(*) AS n FROM returns GROUP BY ALL),
reads AS (SELECT m.record_id, m.atom, i.object, 0 AS s, m.size AS e FROM made m JOIN inp i ON i.record_id = m.record_id AND i.fi = m.fi AND i.oi = m.oi AND k = many AND space = 'ram' AND object <> '' WHERE mnemonic = 'LOAD'),
writes AS (SELECT a.record_id, p.function_id, a.object AS target, 0 AS s, a.size AS e, p.site_id, CASE WHEN a.many > 1 AND NOT b.constant THEN b.atom ELSE '' END AS atom
  FROM ops p JOIN inp a ON a.record_id = p.record_id AND a.fi = p.fi AND a.oi = p.oi AND a.k = 1 AND a.space = 'ram' AND a.object <> '' JOIN inp b ON b.record_id = p.record_id AND b.fi = p.fi AND b.oi = p.oi AND b.k = b.many WHERE mnemonic = 'STORE'),
states AS (SELECT DISTINCT record_id, atom FROM x WHERE atom <> ''),
steps AS (
  SELECT s.record_id, s.atom, 'LOCAL_DEF_USE' AS rule, m.site_id AS site, i.atom AS next FROM states s JOIN made m USING (record_id, atom) JOIN inp i ON i.record_id = m.record_id AND i.fi = m.fi AND i.oi = m.oi AND NOT constant AND (i.atom <> '' OR i.object <> '') WHERE mnemonic NOT IN ('CALL', 'CALLIND', 'LOAD')
  UNION SELECT s.record_id, s.atom, 'LOAD_ADDRESS', m.site_id, i.atom FROM states s JOIN made m USING (record_id, atom) JOIN inp i ON i.record_id = m.record_id AND i.fi = m.fi AND i.oi = m.oi AND k = many AND space <> 'ram' AND (i.atom <> '' OR i.object <> '') WHERE mnemonic = 'LOAD'
  UNION SELECT s.record_id, s.atom, 'ACTUAL_FORMAL', a.site_id, a.atom FROM states s JOIN formals f USING (record_id, atom) JOIN actuals a ON a.record_id = f.record_id AND a.target = f.function_id AND a.slot = f.slot AND a.atom <> ''
  UNION SELECT s.record_id, s.atom, 'CALL_RETURN', m.site_id, r.atom FROM states s JOIN made m USING (record_id, atom) JOIN calls c ON c.record_id = m.record_id AND c.fi = m.fi AND c.oi = m.oi JOIN many USING (record_id) JOIN returns r ON r.record_id = c.record_id AND r.function_id = c.target
    WHERE mnemonic IN ('CALL', 'CALLIND') AND many.function_id = c.target AND n <= {search.MAX_ALTERNATIVES}
  UNION SELECT s.record_id, s.atom, 'CHANNEL', w.site_id, w.atom FROM states s JOIN reads USING (record_id, atom) JOIN writes w ON w.record_id = s.record_id AND w.target = reads.object AND reads.s < w.e AND w.s < reads.e AND w.atom <> '')
SELECT record_id, atom, rule, site, next FROM steps"""


def _number(c: str) -> Column:
    return F.substring_index(c, "|", 1).cast("bigint")


def g7_first_steps(spark: SparkSession, d: str) -> DataFrame:
    """One expansion of every value of the documents: where each rule of the search leads."""
    facts, _ = document_facts(spark, d)
    values = facts.definitions.select("atom", F.explode(F.concat(F.array("atom"), F.array("address_atom"), "inputs.atom")).alias("v")).select("v")
    every = _every_value(spark, d).unionByName(values).filter("v <> ''").distinct()
    states = every.select(
        F.col("v").alias("search"), F.lit("").alias("sink"), F.col("v").alias("atom"), F.lit("").alias("object"), F.lit(0).alias("call_depth"), F.array().cast("array<string>").alias("context"),
        F.array().cast("array<string>").alias("used"), F.lit(False).alias("may"), F.array().cast(f"array<{search.STEP}>").alias("path"),
    )
    steps = search.expand(checkpoint(states), facts).steps
    last = F.element_at("path", -1)
    site = F.regexp_replace(last["site"], r"^[0-9]+\|[0-9]+(\||$)", "")
    return steps.select(_number("search").alias("record_id"), _plain("from_atom").alias("atom"), last["kind"].alias("rule"), site.alias("site"), _plain("atom").alias("next")).distinct()


def _every_value(spark: SparkSession, d: str) -> DataFrame:
    tagged = nested.emit_tagged(table(spark, d, "program_facts"))
    rows = [nested.flat_table(tagged, t).select(F.concat_ws("|", F.col("record_id").cast("string"), F.coalesce(F.nullif("value_id", F.lit("")), "object_id")).alias("v"), F.coalesce("value_id", "object_id").alias("x")).filter("x <> ''").select("v") for t in ("input", "output")]
    return rows[0].unionByName(rows[1])


def _search(spark: SparkSession, d: str) -> search.Found:
    """From every call's arguments and every store's inputs back to what indirect calls and loads return, which stands in for sources; no table carries any for the documents."""
    facts, sinks = document_facts(spark, d)
    given = facts.definitions.filter(F.col("mnemonic").isin("CALLIND", "LOAD"))
    return search.backward(facts, checkpoint(given.select("atom", F.col("site").alias("source"))), checkpoint(sinks))


def g7_fact_ends(spark: SparkSession, d: str) -> DataFrame:
    """How each search ends: at sources, constants and blockers, with the number of states."""
    found = _search(spark, d)
    ends = found.paths.select("search", F.lit("SOURCE_REACHED").alias("end")).unionByName(found.leaves.select("search", F.lit("INTERNAL_LEAF").alias("end"))).unionByName(found.blockers.select("search", F.col("blocker").alias("end")))
    return ends.groupBy("search", "end").agg(F.count("*").alias("states"))


def g4_fact_inputs(spark: SparkSession, d: str) -> DataFrame:
    """What the documents' operations, arguments and returns hand on of labels, by their classes."""
    facts, _ = document_facts(spark, d)
    flow = facts.definitions.select(F.col("atom").alias("output"), "mnemonic", "site", F.explode("inputs").alias("i")).select("output", "mnemonic", "site", F.col("i.atom").alias("input"), F.lit(False).alias("constant"))
    calls = facts.definitions.filter(F.col("mnemonic").isin("CALL", "CALLIND")).select(F.col("atom").alias("output"), "mnemonic", "site", F.lit("").alias("input"), F.lit(False).alias("constant"))
    found = graph.provenance_inputs(flow.filter(~F.col("mnemonic").isin("CALL", "CALLIND")).unionByName(calls), facts.formals, facts.actuals, facts.targets, facts.returns)
    return found.select(_number("output").alias("record_id"), _plain("output").alias("output"), _plain("input").alias("input"), "mode")


_quoted = lambda names: ", ".join(f"'{n}'" for n in names)
_MODES = _FACTS.split("SELECT record_id, atom, rule")[0] + f"""
SELECT record_id, output, input, mode FROM (
  SELECT m.record_id, m.atom AS output, i.atom AS input, CASE WHEN mnemonic IN ({_quoted(graph.TRANSPARENT_OPERATIONS)}) THEN 'any' WHEN mnemonic IN ({_quoted((*graph.COMPUTE_OPERATIONS, "MULTIEQUAL"))}) THEN 'all' END AS mode
    FROM made m JOIN inp i ON i.record_id = m.record_id AND i.fi = m.fi AND i.oi = m.oi AND NOT constant
  UNION SELECT f.record_id, f.atom, a.atom, 'any' FROM formals f JOIN actuals a ON a.record_id = f.record_id AND a.target = f.function_id AND a.slot = f.slot
  UNION SELECT m.record_id, m.atom, r.atom, 'any' FROM made m JOIN calls c ON c.record_id = m.record_id AND c.fi = m.fi AND c.oi = m.oi JOIN returns r ON r.record_id = c.record_id AND r.function_id = c.target WHERE mnemonic IN ('CALL', 'CALLIND'))
WHERE mode IS NOT NULL AND output <> '' AND input <> ''"""

QUERIES = {"g7_first_steps": g7_first_steps, "g7_fact_ends": g7_fact_ends, "g4_fact_inputs": g4_fact_inputs}
SQL = {"g7_first_steps": _FACTS, "g4_fact_inputs": _MODES}
