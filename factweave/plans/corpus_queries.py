"""The pN_ queries of the general problems 1, 2 and 5."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.operators import drift, nested
from factweave.operators.orphans import Reference, orphan_report, orphans
from factweave.plans.corpus_sql import P1_FOUND, P1_REJECTS, P1_TABLES, P2_CASTS, P2_CELLS, P2_FOUND, P2_LIFESPANS, P2_REJECTS
from factweave.session import checkpoint, scratch, table


def _facts(spark: SparkSession, d: str) -> str:
    """Where the documents' tagged rows are written, by tag: one pass over the documents."""
    path = scratch(spark, "facts")
    nested.write_tagged(nested.emit_tagged(table(spark, d, "program_facts"), rejects=True), path)
    return path


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    path = _facts(spark, d)
    tables = [nested.read_table(spark, path, tag).select("record_id", F.lit(tag).alias("node_kind"), "function_id", "site_id", "pos") for tag in nested.NODES]
    return reduce(DataFrame.unionByName, tables)


def p1_functions(spark: SparkSession, d: str) -> DataFrame:
    return nested.read_table(spark, _facts(spark, d), "function")


def p1_ops(spark: SparkSession, d: str) -> DataFrame:
    return nested.read_table(spark, _facts(spark, d), "op")


def p1_inputs(spark: SparkSession, d: str) -> DataFrame:
    return nested.read_table(spark, _facts(spark, d), "input")


def p1_outputs(spark: SparkSession, d: str) -> DataFrame:
    return nested.read_table(spark, _facts(spark, d), "output")


def p1_rejects(spark: SparkSession, d: str) -> DataFrame:
    return nested.read_table(spark, _facts(spark, d), "reject").select("record_id", "reason")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.changes(table(spark, d, "artifact_files"))


def p2_lifespans(spark: SparkSession, d: str) -> DataFrame:
    return drift.lifespans(drift.catalogue(table(spark, d, "artifact_files")))


def _casting(files: DataFrame) -> DataFrame:
    # the catalogue and the changes are few and used for each field and its cast; their plans must not be run for every use
    lives = checkpoint(drift.catalogue(files))
    return checkpoint(drift.casts(lives, checkpoint(drift.changes(files, lives))))


def p2_casts(spark: SparkSession, d: str) -> DataFrame:
    return _casting(table(spark, d, "artifact_files"))


def p2_table(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "artifact_files")
    return drift.consistent_table(files, _casting(files))


def p2_cells(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "artifact_files")
    return drift.consistent_cells(files, _casting(files))


def p2_rejects(spark: SparkSession, d: str) -> DataFrame:
    return drift.rejects(table(spark, d, "artifact_files"))


def _references(spark: SparkSession, d: str) -> list[Reference]:
    corpus, definitions, evidence = (table(spark, d, t) for t in ("function_corpus", "source_definitions", "evidence_items"))
    function = (("binary_sha256", "binary_sha256"), ("function_id", "function_id"))
    accesses, sources, plans = (table(spark, d, t) for t in ("accesses", "sources", "plan_fields"))
    return [
        Reference(accesses, "accesses", "function_id", "edge_id", "exported_at", function, corpus, "exported_at", "removed_at"),
        Reference(sources, "sources", "function_id", "source_id", "mined_at", function, corpus, "exported_at", "removed_at"),
        Reference(sources, "sources", "source_definition_id", "source_id", "mined_at", (("source_definition_id", "source_definition_id"),), definitions, "defined_at", "retired_at"),
        Reference(plans, "plan_fields", "evidence_ref", "plan_field_id", "planned_at", (("evidence_ref", "evidence_id"),), evidence, "recorded_at", "withdrawn_at"),
    ]


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans(_references(spark, d)).select("ref_table", "ref_column", "ref_key").distinct()


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(orphans(_references(spark, d)))


_KEY = "nullif(lower(trim({0}, chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' ')), '')"


def _case(table_name: str, column: str, row_key: str, time: str, pairs: list[tuple[str, str]], parent: str, start: str, end: str) -> str:
    given = " AND ".join(f"{_KEY.format('r.' + a)} IS NOT NULL" for a, _ in pairs)
    same = " AND ".join(f"{_KEY.format('p.' + b)} = {_KEY.format('r.' + a)}" for a, b in pairs)
    return (
        f"SELECT '{table_name}' AS ref_table, '{column}' AS ref_column, r.{row_key} AS ref_key, r.{time} AS ref_at, "
        f"(SELECT count(*) FROM {parent} p WHERE {same}) AS known, "
        f"(SELECT count(*) FROM {parent} p WHERE {same} AND p.{start} <= r.{time}) AS started "
        f"FROM {table_name} r WHERE {given} AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE {same} "
        f"AND p.{start} <= r.{time} AND (p.{end} IS NULL OR r.{time} < p.{end}))"
    )


_FUNCTION = [("binary_sha256", "binary_sha256"), ("function_id", "function_id")]
_CASES = " UNION ALL ".join(
    [
        _case("accesses", "function_id", "edge_id", "exported_at", _FUNCTION, "function_corpus", "exported_at", "removed_at"),
        _case("sources", "function_id", "source_id", "mined_at", _FUNCTION, "function_corpus", "exported_at", "removed_at"),
        _case("sources", "source_definition_id", "source_id", "mined_at", [("source_definition_id",) * 2], "source_definitions", "defined_at", "retired_at"),
        _case("plan_fields", "evidence_ref", "plan_field_id", "planned_at", [("evidence_ref", "evidence_id")], "evidence_items", "recorded_at", "withdrawn_at"),
    ]
)

QUERIES = {
    "p1_found": p1_found,
    "p1_functions": p1_functions,
    "p1_ops": p1_ops,
    "p1_inputs": p1_inputs,
    "p1_outputs": p1_outputs,
    "p1_rejects": p1_rejects,
    "p2_found": p2_found,
    "p2_lifespans": p2_lifespans,
    "p2_casts": p2_casts,
    "p2_table": p2_table,
    "p2_cells": p2_cells,
    "p2_rejects": p2_rejects,
    "p5_found": p5_found,
    "p5_report": p5_report,
}

SQL = {
    "p1_found": P1_FOUND,
    **P1_TABLES,
    "p1_rejects": P1_REJECTS,
    "p2_found": P2_FOUND,
    "p2_lifespans": P2_LIFESPANS,
    "p2_casts": P2_CASTS,
    "p2_cells": P2_CELLS,
    "p2_rejects": P2_REJECTS,
    "p5_found": f"SELECT DISTINCT ref_table, ref_column, ref_key FROM ({_CASES})",
    "p5_report": (
        "SELECT ref_table, ref_column, date_trunc('month', ref_at)::TIMESTAMP AS month, "
        "CASE WHEN known = 0 THEN 'missing' WHEN started = 0 THEN 'late' ELSE 'deleted' END AS reason, "
        f"count(DISTINCT ref_key) AS orphans FROM ({_CASES}) GROUP BY ALL"
    ),
}
