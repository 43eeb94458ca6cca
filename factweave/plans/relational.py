"""Standard relational queries on the star schema; Catalyst plans them all."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

from factweave.session import table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

#: One text per query, valid in both engines unless a second one is given.
TEXTS: dict[str, str | tuple[str, str]] = {
    "rel_pricing_summary": """SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS quantity,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DECIMAL(38,4)) AS revenue FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""",
    "rel_grouping_sets": """SELECT c_mktsegment, n_name, count(*) AS n, CAST(grouping(c_mktsegment) AS BIGINT) AS g1, CAST(grouping(n_name) AS BIGINT) AS g2 FROM customer JOIN nation ON c_nationkey = n_nationkey
GROUP BY GROUPING SETS ((c_mktsegment, n_name), (c_mktsegment), (n_name), ())""",
    "rel_rollup": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, max(o_totalprice) AS most FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "rel_cube": "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus, l_linenumber)",
    "rel_window_frames": """SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DECIMAL(38,2)) AS moving,
  lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before, CAST(ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS quarter,
  percent_rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS share FROM orders""",
    "rel_set_operations": """(SELECT c_nationkey AS k, 'both' AS side FROM customer INTERSECT SELECT s_nationkey, 'both' FROM supplier) UNION ALL
(SELECT c_nationkey AS k, 'customer' AS side FROM customer EXCEPT SELECT s_nationkey, 'customer' FROM supplier)""",
    "rel_semi_join": "SELECT p_partkey, p_brand FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49)",
    "rel_anti_join": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')",
    "rel_correlated_subquery": "SELECT l_orderkey, l_linenumber FROM lineitem a WHERE l_quantity < (SELECT avg(l_quantity) * 0.5 FROM lineitem b WHERE b.l_partkey = a.l_partkey)",
    "rel_date_parts": "SELECT date_trunc('month', o_orderdate) AS month, CAST(extract(year FROM o_orderdate) AS BIGINT) AS year, count(*) AS n FROM orders GROUP BY date_trunc('month', o_orderdate), extract(year FROM o_orderdate)",
    "rel_decimal_money": "SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS total, max(CAST(o_totalprice AS DECIMAL(18,2))) AS most FROM orders GROUP BY o_custkey HAVING count(*) > 1",
    "rel_star_join": """SELECT r_name, n_name, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS price FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name""",
    "rel_distinct_aggregates": "SELECT l_suppkey, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_orderkey) AS orders, count(*) AS n FROM lineitem GROUP BY l_suppkey",
    "rel_conditional_counts": "SELECT event_type, count(*) FILTER (WHERE value > 50) AS high, min(ts) AS first, max(ts) AS last FROM events GROUP BY event_type",
    "rel_left_join_coalesce": "SELECT s_suppkey, coalesce(n, 0) AS n FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_suppkey) x ON s_suppkey = l_suppkey",
    "rel_top_orders": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100",
    "rel_sessions": """SELECT user_id, session_no, count(*) AS n, min(ts) AS opened, max(ts) AS closed FROM (SELECT user_id, ts, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_no
  FROM (SELECT user_id, ts, event_id, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= ts - INTERVAL '6' HOUR THEN 0 ELSE 1 END AS fresh FROM events) a) b GROUP BY user_id, session_no""",
}


#: A table after FROM or JOIN, with its alias if it has one of a single letter.
_TABLE = re.compile(rf"\b(FROM|JOIN)\s+({'|'.join(TABLES)})\b(\s+[ab]\b)?")


def _runner(text: str):
    def run(spark: SparkSession, d: str):
        frames = {f"t_{m[1]}": table(spark, d, m[1]) for m in _TABLE.findall(text)}
        return spark.sql(_TABLE.sub(lambda m: f"{m[1]} {{t_{m[2]}}}{m[3] or ' ' + m[2]}", text), **frames)

    return run


QUERIES = {name: _runner(t if isinstance(t, str) else t[0]) for name, t in TEXTS.items()}
SQL = {name: t if isinstance(t, str) else t[1] for name, t in TEXTS.items()}
