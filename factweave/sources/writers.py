"""Writers and reports (W1-W7). Reports collect only their own few rows, behind a checked limit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The most rows that a report may have.
REPORT_ROWS = 10_000


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines; the committer replaces the folder as a whole."""
    df.write.mode("overwrite").json(path)


def write_sorted_json(df: DataFrame, path: str, order: Sequence[str] = ()) -> None:
    """JSON lines with the columns in alphabetical order and NULLs kept, the rows ordered over the files."""
    rows = df.orderBy(*order) if order else df
    rows.select(*sorted(df.columns)).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, one file per partition."""
    df.write.mode("overwrite").option("header", True).csv(path)


def markdown(df: DataFrame, columns: Sequence[str] | None = None, missing: str = "N/A") -> str:
    """A markdown table of a small result; bars in cells are escaped, NULL is `missing`."""
    names = list(columns or df.columns)
    rows = df.select(*names).take(REPORT_ROWS + 1)
    if len(rows) > REPORT_ROWS:
        raise ValueError(f"a report has at most {REPORT_ROWS} rows")
    cell = lambda v: missing if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    body = ["| " + " | ".join(cell(v) for v in r) + " |" for r in rows]
    return "\n".join(["| " + " | ".join(names) + " |", "|" + "---|" * len(names), *body])


def stage_report(stages: dict[str, DataFrame]) -> str:
    """The row count of each stage, in order."""
    return "\n".join(f"[{n}] {name}: {df.count()} rows" for n, (name, df) in enumerate(stages.items(), 1))


def corpus_text(functions: DataFrame, path: str) -> None:
    """Functions as text, a line with the name before each body; refuses an empty corpus."""
    held = functions.filter(F.trim(F.coalesce("body", F.lit(""))) != "")
    if held.isEmpty():
        raise ValueError("no function has a body")
    held.select(F.concat(F.lit("/* "), F.coalesce("func_name", F.lit("?")), F.lit(" */\n"), F.col("body"), F.lit("\n")).alias("value")).write.mode("overwrite").text(path)


def graph_artifact(nodes: DataFrame, edges: DataFrame, rejects: DataFrame, path: str) -> DataFrame:
    """Nodes, edges and rejects as tables under path, and one row of their counts, read from what was written."""
    spark = nodes.sparkSession
    for name, df in (("nodes", nodes), ("edges", edges), ("rejects", rejects)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    counts = {n: spark.read.parquet(f"{path}/{n}").count() for n in ("nodes", "edges", "rejects")}
    return spark.createDataFrame([tuple(counts.values())], ", ".join(f"{n} bigint" for n in counts))


def percent(part, whole, missing: str = "N/A"):
    """A share as '12.3%', or `missing` without a whole."""
    p, w = (F.col(x) if isinstance(x, str) else x for x in (part, whole))
    return F.when(F.coalesce(w, F.lit(0)) != 0, F.format_string("%.1f%%", p * 100.0 / w)).otherwise(missing)
