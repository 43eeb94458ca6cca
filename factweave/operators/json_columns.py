"""Columns of JSON text as relations: their strings at any depth, and objects had from untidy texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.functions.json_text import dumps, loads, repaired, strings

_ROWS = 10_000


def _clean(s: str) -> str:
    return s if s.isascii() else s.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _sent(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= _ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def json_strings(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row_id, string_no, value) of every string in a column of JSON text, at any depth; NULL and unreadable texts have none."""
    schema = pa.schema([("row_id", pa.int64()), ("string_no", pa.int32()), ("value", pa.string())])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in source:
                for row_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    try:
                        value = loads(text) if text else None
                    except ValueError:
                        continue
                    yield from ((row_id, n, _clean(s)) for n, s in enumerate(strings(value)))

        return _sent(rows(), schema)

    return df.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")).mapInArrow(run, "row_id bigint, string_no int, value string")


def json_objects(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row_id, object, how) of every row: the object's JSON text with sorted keys, and how it was had or why not (see repaired)."""
    schema = pa.schema([("row_id", pa.int64()), ("object", pa.string()), ("how", pa.string())])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in source:
                for row_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    value, how = repaired(text)
                    yield row_id, None if value is None else dumps(value, sort_keys=True, tight=True), how

        return _sent(rows(), schema)

    return df.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")).mapInArrow(run, "row_id bigint, object string, how string")
