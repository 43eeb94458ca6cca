"""Places where data may do harm, by rules over C text: joins of assignments, loops and parameters.

Each rule gives one row per function or place, with the evidence counted; which of them are sinks is for the fact rules to judge.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.sources.ctext import _scanner, closings, masked
from factweave.sources.ingress import BUFFER_TOKENS, Text, _any_token

_LOOP = re.compile(r"\b(for|while)\s*\(|\bdo\s*\{")
_PERIPHERAL = r"\b_?DAT_[45][0-9A-Fa-f]{7}\b|->(?:DR|RDR|RXDR|FIFO)\b"


def loop_rows(text: str) -> Iterator[tuple[str, int, int]]:
    """(head, line, last line) of the loops of a text, inner ones after the outer; a loop without a block ends at its ';'."""
    code = masked(text)
    parens, blocks = closings(code, "(", ")"), closings(code, "{", "}")
    line = lambda at: text.count("\n", 0, at) + 1
    for m in _LOOP.finditer(code):
        if m[1] is None:
            start = m.end() - 1
            head = "do"
        else:
            close = parens.get(m.end() - 1)
            if close is None:
                continue
            head = " ".join(text[m.start() : close + 1].split())
            start = close + 1 + len(code[close + 1 :]) - len(code[close + 1 :].lstrip())
        end = blocks.get(start)
        if end is None:
            end = code.find(";", start)
        yield head, line(m.start()), line(end if end >= 0 else len(text))


def scan_loops(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row_id, loop_no, head, line, last_line) of every text; NULL and empty ones have none."""
    schema = pa.schema([("row_id", pa.int64()), ("loop_no", pa.int32()), ("head", pa.string()), ("line", pa.int32()), ("last_line", pa.int32())])
    slim = df.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string"))
    return slim.mapInArrow(_scanner(loop_rows, schema), "row_id bigint, loop_no int, head string, line int, last_line int")


def _per_function(found: DataFrame, rule: str, label: Column) -> DataFrame:
    """One row per function: its places in order, the first as evidence."""
    held = found.groupBy("row_id", "function").agg(F.count("*").alias("places"), F.min(F.struct("line", "assignment_no", "lhs", "rhs")).alias("first"), F.max("__a").alias("__a"), F.max("__b").alias("__b"))
    return held.select(F.lit(rule).alias("rule"), "row_id", "function", F.col("first.line").alias("line"), F.concat("first.lhs", F.lit(" = "), "first.rhs").alias("site"), "places", label.alias("label"))


def loop_writes(text: Text, loops: DataFrame) -> DataFrame:
    """Functions that write memory in a loop: COPY_SINK if they copy and read no peripheral there, else LOOP_WRITE_SINK."""
    spans = loops.select("row_id", F.col("line").alias("__from"), F.col("last_line").alias("__to"))
    inside = text.assignments.filter("writes").join(spans, "row_id").filter("line BETWEEN __from AND __to").dropDuplicates(["row_id", "assignment_no"])
    marked = inside.withColumns({"__a": F.col("rhs").rlike(r"\[|\*\s*\(|\*\s*\w|->"), "__b": F.col("rhs").rlike(_PERIPHERAL)})
    return _per_function(marked, "loop_write", F.when(F.col("__a") & ~F.col("__b"), "COPY_SINK").otherwise("LOOP_WRITE_SINK"))


def _field(c: str) -> Column:
    return F.col(c).contains("->") | F.col(c).rlike(r"[A-Za-z_)\]]\.[A-Za-z_]")


def parser_stores(text: Text) -> DataFrame:
    """Functions that set fields from places in a buffer that they are handed: a parameter with a buffer's name or a pointer."""
    name = lambda p: F.regexp_extract(p, r"([A-Za-z_]\w*)\W*$", 1)
    buffers = F.transform(F.filter("parameters", lambda p: _any_token(p, BUFFER_TOKENS) | p.contains("*")), name)
    mentioned = F.exists(F.filter(buffers, lambda b: b != ""), lambda b: F.array_contains(F.regexp_extract_all("rhs", F.lit(r"[A-Za-z_]\w*"), F.lit(0)), b))
    found = text.assignments.filter(_field("lhs") & F.col("rhs").rlike(r"[\[+*]") & mentioned).withColumns({"__a": F.lit(True), "__b": F.lit(False)})
    return _per_function(found, "parser_store", F.lit("STORE_SINK"))


def field_updates(text: Text) -> DataFrame:
    """Stores to fields of values that were copied from a parameter's memory to a local before: a row per store."""
    reads = F.col("rhs").rlike(r"\[|\*\s*\(|\*\s*\w|->")
    words = F.regexp_extract_all("rhs", F.lit(r"[A-Za-z_]\w*"), F.lit(0))
    names = F.transform("parameters", lambda p: F.regexp_extract(p, r"([A-Za-z_]\w*)\W*$", 1))
    copied = text.assignments.filter(~F.col("writes") & reads & F.arrays_overlap(words, F.filter(names, lambda n: n != ""))).select("row_id", "function_no", F.col("base").alias("local"), F.col("assignment_no").alias("__at"))
    stores = text.assignments.filter(_field("lhs")).withColumn("local", F.explode(F.array_distinct(words)))
    met = stores.join(copied, ["row_id", "function_no", "local"]).filter(F.col("__at") < F.col("assignment_no"))
    return met.groupBy("row_id", "function", "line", "assignment_no", "lhs", "rhs").agg(F.min("local").alias("local")).select(
        F.lit("field_update").alias("rule"), "row_id", "function", "line", F.concat("lhs", F.lit(" = "), "rhs").alias("site"), F.lit(1).cast("bigint").alias("places"), F.lit("STORE_SINK").alias("label")
    )
