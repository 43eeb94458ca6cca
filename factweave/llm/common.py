"""What several of these operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from factweave.operators.spread import bounded_broadcast, paired

__all__ = ["batches", "bounded_broadcast", "paired", "word_hashes"]


def word_hashes(c: Column) -> Column:
    """64-bit hashes of the lower-cased runs of Unicode letters and digits of a text, in order; [] for NULL. One pass over the runs."""
    runs = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.transform(runs, lambda w: F.xxhash64(F.lower(w)))


def batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 10_000) -> Iterator[pa.RecordBatch]:
    """Arrow batches of rows, at most `size` each."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
