"""Compares a query with its DuckDB text over one data directory."""

import os

import duckdb

TABLES = (
    "accesses function_corpus sources source_definitions plan_fields evidence_items program_facts cve_views artifact_files documents "
    "eval_items common_words embeddings region nation customer supplier part orders lineitem events"
).split()
DATA = os.environ.get("FACTWEAVE_TEST_DATA", "/root/testdata/sf0.001")


def _plain(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def rows_of(rows, columns, names):
    return sorted(str([_plain(r[names.index(c)]) for c in columns]) for r in rows)


def check(spark, f, sql):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = c.sql(sql)
    df = f(spark, DATA)
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    assert rows_of([tuple(r) for r in df.collect()], columns, df.columns) == rows_of(want.fetchall(), columns, want.columns)
