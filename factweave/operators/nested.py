"""Deeply nested program-fact documents as flat tables (problem 1).

One depth-first pass over each JSON document emits tagged rows: the table's tag, the node's own key,
its parent's key and the node's own scalar fields as payload. Written partitioned by tag, each table
is then read alone with its schema. Documents are independent, so there is no shuffle and a document
never meets another in memory. A document of any depth is read; one that can't be is a row of the tag 'reject'.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.functions.json_text import dumps, loads

#: Fields by which an object is one node, not a container keyed by id or position.
NODE_FIELDS = {
    "function": {"function_id", "name", "entry", "signature", "pcode_ops", "cfg", "parameters", "is_thunk", "decompiled_c"},
    "op": {"site_id", "mnemonic", "inputs", "output", "op_order", "opcode", "call"},
    "value": {"object_id", "value_id", "atom_id", "space", "offset", "size", "is_constant", "def_site_id", "use_site_ids", "high"},
}

_VALUE = "object_id string, value_id string, atom_id string, space string, size int, offset string, is_constant boolean, def_site_id string, use_site_ids string, high string"

#: Payload schemas of the tables, applied when a tag is read. Addresses stay text: their spelling varies. Fields
#: that hold lists or objects are JSON text.
PAYLOADS = {
    "function": "name string, entry string, signature string, is_thunk boolean, parameters string",
    "op": "op_order int, mnemonic string, opcode string, call string",
    "input": _VALUE,
    "output": _VALUE,
    "reject": "reason string",
}

#: The tags of nodes.
NODES = ("function", "op", "input", "output")

TAGGED = "record_id bigint, tag string, node_no bigint, parent_no bigint, function_id string, site_id string, pos bigint, payload string"

#: Rows of one Arrow batch of the visitor's output; a very large document is emitted in several.
BATCH_ROWS = 20_000

_KEPT = {tag: [part.split()[0] for part in schema.split(", ")] for tag, schema in PAYLOADS.items()}
_SPELT = {"offset", "entry", "opcode"}


def _decoded(x: Any) -> Any:
    """x, or what its JSON text holds (text within text, too); None for other text."""
    while isinstance(x, str):
        try:
            x = loads(x)
        except ValueError:
            return None
    return x


def _elements(x: Any, node: str) -> Iterator[tuple[str | None, int, Any]]:
    """(key, position, element) of a list in any of its shapes; null and empty elements are left out."""
    x = _decoded(x)
    if isinstance(x, dict):
        if not x:
            return
        if NODE_FIELDS[node] & x.keys():
            yield None, 0, x
            return
        items: Any = [
            (k, int(k) if k.isascii() and k.isdigit() and len(k) <= 18 else n, v) for n, (k, v) in enumerate(x.items())
        ]
    elif isinstance(x, list):
        items = ((None, n, v) for n, v in enumerate(x))
    else:
        return
    for k, n, v in items:
        v = _decoded(v)
        if isinstance(v, dict) and v:
            yield k, n, v


def _text(x: Any) -> str:
    s = x if isinstance(x, str) else dumps(x)
    return s if s.isascii() else s.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _entry_id(entry: Any) -> str:
    if isinstance(entry, str):
        try:
            entry = int(entry.strip(), 16)
        except ValueError:
            return ""
    return f"fn:{entry:08x}" if isinstance(entry, int) and not isinstance(entry, bool) and entry >= 0 else ""


def _payload(tag: str, node: dict) -> str:
    out = {}
    for k in _KEPT[tag]:
        v = node.get(k)
        if v is not None:
            out[k] = dumps(v, ensure_ascii=False, tight=True) if isinstance(v, (dict, list)) else str(v) if k in _SPELT else v
    return _text(dumps(out, ensure_ascii=False))


def fault(text: str | None) -> str | None:
    """Why a document has no nodes whatever it holds: NO_DOCUMENT, UNREADABLE, NOT_AN_OBJECT; None if it is readable."""
    return _document(text)[1]


def _document(text: str | None) -> tuple[dict, str | None]:
    if not text:
        return {}, "NO_DOCUMENT"
    try:
        doc = loads(text)
    except ValueError:
        return {}, "UNREADABLE"
    return (doc, None) if isinstance(doc, dict) else ({}, "NOT_AN_OBJECT")


def visit(text: str | None, payload: bool = True, rejects: bool = False) -> Iterator[tuple]:
    """The tagged rows of one document, parents before children; none, or a reject, for an unreadable one.

    Yields (tag, node_no, parent_no, function_id, site_id, pos, payload).
    """
    doc, reason = _document(text)
    if reason:
        if rejects:
            yield "reject", 0, None, None, None, None, _text(dumps({"reason": reason}))
        return
    number = 0
    for key, _, fn in _elements(doc.get("functions"), "function"):
        given = fn.get("function_id")
        # a key that is a position names no function
        name = given or (key if key and not key.isdigit() else None) or _entry_id(fn.get("entry"))
        fid, parent = _text(name), number
        yield "function", parent, None, fid, "", -1, _payload("function", fn) if payload else None
        number += 1
        ops = fn.get("pcode_ops")
        if not _decoded(ops):
            cfg = _decoded(fn.get("cfg"))
            ops = cfg.get("pcode_ops") if isinstance(cfg, dict) else None
        for op_key, _, op in _elements(ops, "op"):
            site = _text(op.get("site_id") or (op_key if op_key and not op_key.isdigit() else ""))
            at = number
            yield "op", at, parent, fid, site, -1, _payload("op", op) if payload else None
            number += 1
            for _, pos, node in _elements(op.get("inputs"), "value"):
                yield "input", number, at, fid, site, pos, _payload("input", node) if payload else None
                number += 1
            for _, _, node in _elements(op.get("output"), "value"):
                yield "output", number, at, fid, site, 0, _payload("output", node) if payload else None
                number += 1


def _emitter(payload: bool, rejects: bool):
    schema = pa.schema(
        [("record_id", pa.int64()), ("tag", pa.string()), ("node_no", pa.int64()), ("parent_no", pa.int64()),
         ("function_id", pa.string()), ("site_id", pa.string()), ("pos", pa.int64()), ("payload", pa.string())]
    )

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        for batch in batches:
            for record, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for row in visit(text.as_py(), payload, rejects):
                    rows.append((record, *row))
                    if len(rows) >= BATCH_ROWS:
                        yield flush()
        if rows:
            yield flush()

    return emit


def emit_tagged(df: DataFrame, record_col: str = "record_id", doc_col: str = "facts", payload: bool = True, rejects: bool = False) -> DataFrame:
    """Tagged rows of every readable document of df, and with rejects a row for each of the others.

    A node's key is (record_id, node_no); parent_no names its parent in the same record (NULL for a
    function). Lists may be arrays, objects keyed by id or position, a single object, or JSON text of
    these. Null and empty elements are no nodes; an input's pos is its place in the list, so a null
    before it still counts. NULL, empty or unreadable documents and documents that are no object give
    no node, but a 'reject' with its reason; depth makes no document unreadable. An empty table gives an empty table; a document delivered twice gives its rows under each
    record id, and one without a record id under NULL; other columns of df, whatever their names, are not looked at.
    """
    slim = df.select(F.col(record_col).cast("bigint").alias("record_id"), F.col(doc_col).cast("string").alias("doc"))
    return slim.mapInArrow(_emitter(payload, rejects), TAGGED)


def write_tagged(tagged: DataFrame, path: str) -> None:
    """Write tagged rows partitioned by tag, so that each table is read without the others.

    There are as many open files a task as tags, so the rows need not be sorted by tag first.
    """
    conf, name = tagged.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(name, None)
    conf.set(name, str(len(PAYLOADS)))
    try:
        tagged.write.mode("overwrite").partitionBy("tag").parquet(path)
    finally:
        if before is None:
            conf.unset(name)
        else:
            conf.set(name, before)


def flat_table(tagged: DataFrame, tag: str) -> DataFrame:
    """One table of the tagged rows with its payload schema applied; fields a node lacks are NULL."""
    own = tagged.filter(F.col("tag") == tag).withColumn("p", F.from_json("payload", PAYLOADS[tag]))
    return own.select("record_id", "node_no", "parent_no", "function_id", "site_id", "pos", "p.*")


def read_table(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """One table of what write_tagged wrote; the tag's folder alone is read. Empty if no row has the tag."""
    return flat_table(spark.read.schema(TAGGED).parquet(path), tag)


def body_shapes(ops: DataFrame, inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """(record_id, function_id, shape) of every function with operations: a hash of their mnemonics, constants and sizes in order.

    Names and addresses of values don't count, so functions that were only moved have one shape. Takes the tables of the tags.
    """
    value = F.when(F.col("space") == "const", F.concat(F.lit("c"), F.coalesce(F.nullif("value_id", F.lit("")), "object_id", F.lit("")))).otherwise(F.coalesce(F.col("size").cast("string"), F.lit("")))

    def signed(df: DataFrame, name: str) -> DataFrame:
        one = F.array_sort(F.collect_list(F.struct("pos", "node_no", value.alias("sig"))))
        return df.groupBy("record_id", F.col("parent_no").alias("node_no")).agg(F.array_join(F.transform(one, lambda x: x["sig"]), ",").alias(name))

    key = ["record_id", "node_no"]
    all_of = ops.select(*key, "parent_no", "function_id", "mnemonic").join(signed(inputs, "i"), key, "left").join(signed(outputs, "o"), key, "left")
    text = F.concat("mnemonic", F.lit("("), F.coalesce("i", F.lit("")), F.lit(")"), F.coalesce("o", F.lit("")))
    held = all_of.groupBy("record_id", "parent_no", "function_id").agg(F.array_sort(F.collect_list(F.struct("node_no", text.alias("t")))).alias("ts"))  # a function's operations
    return held.select("record_id", "function_id", F.sha2(F.array_join(F.transform("ts", lambda x: x["t"]), ";"), 256).alias("shape"))
