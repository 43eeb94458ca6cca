"""The DuckDB texts of the queries of problems 1 and 2."""

from __future__ import annotations

#: Fields by which an object is one node.
_FIELDS = {
    "function": "['function_id', 'name', 'entry', 'signature', 'pcode_ops', 'cfg', 'parameters', 'is_thunk', 'decompiled_c']",
    "op": "['site_id', 'mnemonic', 'inputs', 'output', 'op_order', 'opcode', 'call']",
    "value": "['object_id', 'value_id', 'atom_id', 'space', 'offset', 'size', 'is_constant', 'def_site_id', 'use_site_ids', 'high']",
}


def _told(x: str) -> str:
    return f"CASE WHEN json_type({x}) = 'VARCHAR' AND json_valid({x}->>'$') THEN ({x}->>'$')::JSON ELSE {x} END"


def _level(name: str, source: str, columns: str, column: str, node: str) -> str:
    """CTEs by which each list of a column, whatever its shape, becomes rows (columns, key, pos, ix, e); ix is the place in the document."""
    single = f"list_has_any(json_keys(x), {_FIELDS[node]})"
    return f"""
{name}_x AS (SELECT {columns}, {_told(column)} AS x FROM {source}),
{name}_e AS (SELECT {columns}, NULL::VARCHAR AS key, generate_subscripts(l, 1) - 1 AS pos, generate_subscripts(l, 1) AS ix, unnest(l) AS e FROM (SELECT {columns}, json_extract(x, '$[*]') AS l FROM {name}_x WHERE json_type(x) = 'ARRAY')
  UNION ALL SELECT {columns}, NULL, 0, 1, x FROM {name}_x WHERE json_type(x) = 'OBJECT' AND {single}
  UNION ALL SELECT {columns}, k, CASE WHEN regexp_full_match(k, '\\d+') THEN k::BIGINT ELSE i - 1 END, i, json_extract(x, '$."' || k || '"')
    FROM (SELECT {columns}, x, unnest(json_keys(x)) AS k, generate_subscripts(json_keys(x), 1) AS i FROM {name}_x WHERE json_type(x) = 'OBJECT' AND NOT {single})),
{name}_d AS (SELECT {columns}, key, pos, ix, {_told('e')} AS e FROM {name}_e),
{name} AS (SELECT * FROM {name}_d WHERE json_type(e) = 'OBJECT' AND len(json_keys(e)) > 0)"""


_NAMED = "CASE WHEN NOT regexp_full_match(key, '\\d+') THEN key END"

_NODES = f"""WITH doc AS (SELECT record_id, json_extract(facts, '$.functions') AS x0 FROM program_facts WHERE json_valid(facts) AND json_type(facts) = 'OBJECT'),
{_level("f", "doc", "record_id", "x0", "function")},
fn AS (SELECT record_id, ix AS fi, e AS node, coalesce(nullif(e->>'function_id', ''), {_NAMED}, 'fn:' || lpad(ltrim(lower(e->>'entry'), '0x'), 8, '0')) AS function_id,
  CASE WHEN coalesce(json_type(e, '$.pcode_ops'), 'NULL') = 'NULL' OR json_array_length(e, '$.pcode_ops') = 0 AND json_type(e, '$.pcode_ops') = 'ARRAY' OR e->>'$.pcode_ops' = '{{}}' THEN e->'$.cfg.pcode_ops' ELSE e->'$.pcode_ops' END AS ops FROM f),
{_level("o", "fn", "record_id, fi, function_id", "ops", "op")},
op AS (SELECT record_id, fi, ix AS oi, e AS node, function_id, coalesce(nullif(e->>'site_id', ''), {_NAMED}, '') AS site_id, e->'inputs' AS i, e->'output' AS o FROM o),
{_level("i", "op", "record_id, fi, oi, function_id, site_id", "i", "value")},
{_level("u", "op", "record_id, fi, oi, function_id, site_id", "o", "value")},
n AS (SELECT record_id, 'function' AS node_kind, function_id, '' AS site_id, -1::BIGINT AS pos, fi, 0 AS oi, 0 AS depth, 0 AS vi, node FROM fn
UNION ALL SELECT record_id, 'op', function_id, site_id, -1, fi, oi, 1, 0, node FROM op
UNION ALL SELECT record_id, 'input', function_id, site_id, pos, fi, oi, 2, ix, e FROM i
UNION ALL SELECT record_id, 'output', function_id, site_id, 0, fi, oi, 3, ix, e FROM u)"""



def nodes_cte() -> str:
    """The WITH clause by which every node of the documents is a row of n."""
    return _NODES


P1_FOUND = f"{_NODES} SELECT record_id, node_kind, function_id, site_id, pos FROM n"


def nodes_sql(kind: str, fields: str) -> str:
    """The table of one kind of node with the numbers of node and parent, counted depth first."""
    parent = {"function": "NULL::BIGINT", "op": "max(node_no) FILTER (depth = 0) OVER (PARTITION BY record_id, fi)"}.get(kind, "max(node_no) FILTER (depth = 1) OVER (PARTITION BY record_id, fi, oi)")
    return f"""{_NODES}, m AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY fi, oi, depth, vi) - 1 AS node_no FROM n),
l AS (SELECT *, {parent} AS parent_no FROM m)
SELECT record_id, node_no, parent_no, function_id, site_id, pos, {fields} FROM l WHERE node_kind = '{kind}'"""


def _texts(*names: str) -> str:
    return ", ".join(f"node->>'{n}' AS {n}" for n in names)


_VALUES = _texts("object_id", "value_id", "atom_id", "space", "offset", "def_site_id", "use_site_ids", "high") + ", (node->>'size')::INT AS size, (node->>'is_constant')::BOOLEAN AS is_constant"
P1_TABLES = {
    "p1_functions": nodes_sql("function", _texts("name", "entry", "signature", "parameters") + ", (node->>'is_thunk')::BOOLEAN AS is_thunk"),
    "p1_ops": nodes_sql("op", _texts("mnemonic", "opcode", "call") + ", (node->>'op_order')::INT AS op_order"),
    "p1_inputs": nodes_sql("input", _VALUES),
    "p1_outputs": nodes_sql("output", _VALUES),
}

P1_REJECTS = """SELECT record_id, CASE WHEN coalesce(facts, '') = '' THEN 'NO_DOCUMENT' WHEN NOT json_valid(facts) THEN 'UNREADABLE' ELSE 'NOT_AN_OBJECT' END AS reason
FROM program_facts WHERE coalesce(facts, '') = '' OR NOT json_valid(facts) OR json_type(facts) <> 'OBJECT'"""

_P2 = r"""
WITH f AS (SELECT campaign, artifact, regexp_extract(schema_version, '(\d+)\s*$', 1)::BIGINT AS v, payload AS j FROM artifact_files
  WHERE regexp_matches(schema_version, '\d+\s*$') AND campaign IS NOT NULL AND artifact IS NOT NULL AND json_valid(payload) AND json_type(payload) = 'OBJECT'),
v AS (SELECT campaign, artifact, v, lag(v) OVER (PARTITION BY campaign, artifact ORDER BY v) AS p FROM (SELECT DISTINCT campaign, artifact, v FROM f)),
r AS (SELECT campaign, artifact, v, 'source_sites' AS section, unnest(json_extract(j, '$.source_sites[*]')) AS r FROM f UNION ALL SELECT campaign, artifact, v, 'confirmed_sources' AS section, unnest(json_extract(j, '$.confirmed_sources[*]')) AS r FROM f UNION ALL SELECT campaign, artifact, v, 'sink_startpoints' AS section, unnest(json_extract(j, '$.sink_startpoints[*]')) AS r FROM f UNION ALL SELECT campaign, artifact, v, 'confirmed_sink_calls' AS section, unnest(json_extract(j, '$.confirmed_sink_calls[*]')) AS r FROM f),
k AS (SELECT campaign, artifact, v, section, json_extract(r, '$.id')::VARCHAR AS id, r, unnest(json_keys(r)) AS field FROM r WHERE json_type(r) = 'OBJECT'),
c AS (SELECT campaign, artifact, v, section, id, field, json_type(r, '$."' || field || '"') AS jt, json_extract(r, '$."' || field || '"')::VARCHAR AS value FROM k),
x AS (SELECT campaign, artifact, v, section, id, field, value, CASE jt WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' ELSE 'number' END AS kind FROM c WHERE jt <> 'NULL'),
l AS (SELECT campaign, artifact, v, section, field, string_agg(DISTINCT kind, '|' ORDER BY kind) AS kinds FROM x GROUP BY ALL),
now AS (SELECT l.*, v.p FROM l JOIN v USING (campaign, artifact, v) WHERE v.p IS NOT NULL),
was AS (SELECT l.campaign, l.artifact, v.v, section, field, kinds, v.p FROM l JOIN v ON l.campaign = v.campaign AND l.artifact = v.artifact AND l.v = v.p),
added AS (SELECT * FROM now WHERE NOT EXISTS (SELECT 1 FROM was WHERE was.campaign = now.campaign AND was.artifact = now.artifact AND was.v = now.v AND was.section = now.section AND was.field = now.field)),
gone AS (SELECT * FROM was WHERE NOT EXISTS (SELECT 1 FROM now WHERE was.campaign = now.campaign AND was.artifact = now.artifact AND was.v = now.v AND was.section = now.section AND was.field = now.field)),
named AS (SELECT g.campaign, g.artifact, g.section, g.v, g.field AS field_name, a.field AS new_name FROM gone g JOIN added a USING (campaign, artifact, section, v)
  JOIN x o ON o.campaign = g.campaign AND o.artifact = g.artifact AND o.section = g.section AND o.v = g.p AND o.field = g.field AND o.id IS NOT NULL AND o.id <> 'null'
  JOIN x n ON n.campaign = g.campaign AND n.artifact = g.artifact AND n.section = g.section AND n.v = g.v AND n.field = a.field AND n.id = o.id
  GROUP BY ALL HAVING bool_and(o.value = n.value))"""

P2_FOUND = _P2 + r"""
SELECT campaign, artifact, section, v AS version_no, 'retyped' AS change, now.field AS field_name, '' AS new_name FROM now JOIN was USING (campaign, artifact, section, v, field) WHERE now.kinds <> was.kinds
UNION ALL SELECT campaign, artifact, section, v, 'renamed', field_name, new_name FROM named
UNION ALL SELECT campaign, artifact, section, v, 'added', field, '' FROM added WHERE (campaign, artifact, section, v, field) NOT IN (SELECT campaign, artifact, section, v, new_name FROM named)
UNION ALL SELECT campaign, artifact, section, v, 'removed', field, '' FROM gone WHERE (campaign, artifact, section, v, field) NOT IN (SELECT campaign, artifact, section, v, field_name FROM named)
"""

P2_LIFESPANS = _P2 + r""", place AS (SELECT campaign, artifact, v, row_number() OVER (PARTITION BY campaign, artifact ORDER BY v) AS n FROM v),
isle AS (SELECT l.*, n - row_number() OVER (PARTITION BY l.campaign, l.artifact, section, field ORDER BY l.v) AS island FROM l JOIN place USING (campaign, artifact, v))
SELECT campaign, artifact, section, field AS field_name, min(v) AS first_no, max(v) AS last_no, count(*) AS versions, max_by(kinds, v) AS types FROM isle GROUP BY campaign, artifact, section, field, island
"""

_CASTS = """, hop AS (SELECT campaign, artifact, section, field_name AS old, v AS since, min(new_name) AS new FROM named GROUP BY ALL),
walk AS (SELECT campaign, artifact, section, field, v, field AS name, v AS since FROM l
  UNION ALL SELECT w.campaign, w.artifact, w.section, w.field, w.v, h.new, h.since FROM walk w JOIN hop h ON h.campaign = w.campaign AND h.artifact = w.artifact AND h.section = w.section AND h.old = w.name AND h.since > w.since
    AND NOT EXISTS (SELECT 1 FROM hop e WHERE e.campaign = w.campaign AND e.artifact = w.artifact AND e.section = w.section AND e.old = w.name AND e.since > w.since AND e.since < h.since)),
last AS (SELECT campaign, artifact, section, field, v, max_by(name, since) AS name FROM walk GROUP BY ALL),
typed AS (SELECT last.*, kinds, max_by(kinds, (v, kinds)) OVER (PARTITION BY campaign, artifact, section, name) AS cast_to FROM last JOIN l USING (campaign, artifact, section, field, v))
"""

P2_CASTS = _P2.replace("WITH f AS", "WITH RECURSIVE f AS", 1) + _CASTS + "SELECT campaign, artifact, section, v AS version_no, field AS field_name, name, kinds AS types, cast_to FROM typed"

P2_REJECTS = r"""SELECT * FROM (SELECT file_id, CASE WHEN campaign IS NULL THEN 'NO_CAMPAIGN' WHEN artifact IS NULL THEN 'NO_ARTIFACT' WHEN NOT coalesce(regexp_matches(schema_version, '\d+\s*$'), FALSE) THEN 'NO_VERSION'
  WHEN coalesce(payload, '') = '' THEN 'NO_PAYLOAD' WHEN NOT json_valid(payload) THEN 'UNREADABLE' WHEN json_type(payload) <> 'OBJECT' THEN 'NOT_AN_OBJECT' END AS reason FROM artifact_files) WHERE reason IS NOT NULL"""

_ROWS = " UNION ALL ".join(
    f"SELECT file_id, campaign, artifact, regexp_extract(schema_version, '(\\d+)\\s*$', 1)::BIGINT AS v, '{s}' AS section, generate_subscripts(json_extract(payload, '$.{s}[*]'), 1) - 1 AS row_no, unnest(json_extract(payload, '$.{s}[*]')) AS r"
    " FROM artifact_files WHERE regexp_matches(schema_version, '\\d+\\s*$') AND campaign IS NOT NULL AND artifact IS NOT NULL AND json_valid(payload) AND json_type(payload) = 'OBJECT'"
    for s in ("source_sites", "confirmed_sources", "sink_startpoints", "confirmed_sink_calls")
)

P2_CELLS = (
    _P2.replace("WITH f AS", "WITH RECURSIVE f AS", 1) + _CASTS + f""", given AS ({_ROWS}),
field AS (SELECT *, unnest(json_keys(r)) AS field FROM given WHERE json_type(r) = 'OBJECT'),
cell AS (SELECT * EXCLUDE (r), r->>'id' AS row_id, json_extract_string(r, '$."' || field || '"') AS value FROM field WHERE json_type(r, '$."' || field || '"') <> 'NULL')
SELECT file_id, campaign, artifact, v AS version_no, section, row_no, row_id, name, value, cast_to, CASE WHEN cast_to = 'number' THEN try_cast(value AS DOUBLE) END AS as_number,
  CASE WHEN cast_to = 'boolean' THEN CASE WHEN lower(value) IN ('true', '1', '1.0') THEN TRUE WHEN lower(value) IN ('false', '0', '0.0') THEN FALSE END END AS as_boolean
FROM cell JOIN typed USING (campaign, artifact, section, v, field)"""
)
