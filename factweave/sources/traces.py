"""Runtime trace text: three kinds of lines as typed events, and what could not be read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.functions.ids import hex_address
from factweave.functions.text import stripped

#: The grammar of the lines.
_H = "(?:0x)?([0-9a-fA-F]+)"
MMIO = rf"^([0-9a-fA-F]+):\s+{_H}\s+{_H}\s+([rw])\s+([0-9]+)\s+([0-9]+)\s+([0-9]+)\s+0x([0-9a-fA-F]+):{_H}$"
BLOCK = rf"^([0-9a-fA-F]+)\s+{_H}\s+([0-9]+)$"
RAM = rf"^([0-9a-fA-F]+):\s+{_H}\s+{_H}\s+([rw])\s+([0-9]+)\s+0x([0-9a-fA-F]+):{_H}(?:\s+(?:0x)?[0-9a-fA-F]+)?$"


def lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line_no from 1, line) of the lines that aren't blank, trimmed."""
    split = df.select(id_col, F.posexplode_outer(F.split(F.col(text_col), "\n")).alias("n", "line"))
    return split.select(id_col, (F.col("n") + 1).alias("line_no"), stripped(F.col("line")).alias("line")).filter("line <> ''")


def parse(lined: DataFrame, id_col: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(events, rejects). Events: id, line_no, kind (mmio, ram, bb), event_id, pc, lr, mode, access_size, address, value, count.

    Rejects are the lines of no kind; with strict they raise, with line number and text.
    """
    k = F.when(F.col("line").rlike(MMIO), "mmio").when(F.col("line").rlike(RAM), "ram").when(F.col("line").rlike(BLOCK), "bb")
    if strict:
        k = F.coalesce(k, F.raise_error(F.format_string("malformed trace line %d: %s", "line_no", "line")))
    kinds = lined.withColumn("kind", k)

    def part(mmio: int, ram: int, block: int) -> Column:
        pick = lambda p, i: F.regexp_extract("line", p, i) if i else F.lit(None)
        return F.when(F.col("kind") == "mmio", pick(MMIO, mmio)).when(F.col("kind") == "ram", pick(RAM, ram)).when(F.col("kind") == "bb", pick(BLOCK, block))

    events = kinds.filter("kind IS NOT NULL").select(
        id_col, "line_no", "kind", hex_address(part(1, 1, 1)).alias("event_id"), hex_address(part(2, 2, 2)).alias("pc"), hex_address(part(3, 3, 0)).alias("lr"),
        part(4, 4, 0).alias("mode"), part(5, 5, 0).cast("int").alias("access_size"), hex_address(part(8, 6, 0)).alias("address"), hex_address(part(9, 7, 0)).alias("value"),
        part(0, 0, 3).cast("bigint").alias("count"),
    )
    return events, kinds.filter("kind IS NULL").select(id_col, "line_no", "line")
