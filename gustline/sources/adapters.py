"""Views that give the driver's tables the shape of storm data.

Each is one SQL text that Spark and DuckDB read alike, but for the few places
where the dialects differ: those are written {minutes(n)}, {days(d)}, {hour(t)} and
{real(x)}, a literal by which one divides as doubles, which Spark would take as a decimal.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    # one of 8 cells by customer, a step a day; every 97th scan is missing, a cell without orders has no data
    "v_scans": """SELECT s.t0 AS ts, c.cell AS cell, r.rate AS rate FROM
        (SELECT DISTINCT step, {minutes(step)} AS t0 FROM (SELECT {days(o_orderdate)} AS step FROM orders) q WHERE step % 97 <> 0) s
        CROSS JOIN (SELECT DISTINCT CAST(o_custkey % 8 AS INT) AS cell FROM orders) c
        LEFT JOIN (SELECT {days(o_orderdate)} AS step, CAST(o_custkey % 8 AS INT) AS cell, SUM(o_totalprice) / 1e5 AS rate FROM orders GROUP BY 1, 2) r ON r.step = s.step AND r.cell = c.cell""",
    "v_hours": "SELECT {hour(ts)} AS t, cell, MAX(rate) AS value FROM v_scans GROUP BY 1, 2",
    "v_gauge_obs": "SELECT user_id AS station_id, ts, CASE WHEN event_type = 'error' THEN NULL ELSE value / 100 END AS precip FROM events",
    "v_gates": """SELECT l_orderkey AS id, l_linenumber AS line, CASE WHEN l_partkey % 23 = 0 THEN NULL ELSE l_quantity + 10 END AS dbz,
        CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_discount * 40 - 0.2 END AS zdr, 1 - l_tax * 3 AS rhohv, l_quantity / 12 AS kdp FROM lineitem""",
    "v_field_a": "SELECT CAST(l_partkey % 32 AS INT) AS row, CAST(l_suppkey % 32 AS INT) AS col, CASE WHEN (l_partkey % 32 + l_suppkey % 32) % 13 = 0 THEN NULL ELSE AVG(l_quantity) END AS v FROM lineitem WHERE l_returnflag IN ('A', 'N') GROUP BY l_partkey % 32, l_suppkey % 32",
    "v_field_b": "SELECT CAST(l_partkey % 32 AS INT) AS row, CAST(l_suppkey % 32 AS INT) AS col, AVG(l_quantity) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_partkey % 32, l_suppkey % 32",
    # a 32 x 32 grid of 0.01 degree from 119.75 W, 39.60 N, and points in and around it
    "v_points": "SELECT s_suppkey AS id, -119.75 + ((s_suppkey * 7919) % 1000) * 0.00033 + 0.000011 AS lon, 39.60 - ((s_suppkey * 104729) % 1000) * 0.00033 - 0.000013 AS lat, CASE WHEN s_acctbal < 0 THEN 0 ELSE s_acctbal / 100 END AS val, CAST(s_suppkey % 70 AS DOUBLE) AS report_min FROM supplier",
    "v_radars": "SELECT n_nationkey AS id, CAST(-119.80 + (n_nationkey * 37 % 25) * 0.017 AS DOUBLE) AS lon, CAST(39.65 - (n_nationkey * 11 % 25) * 0.017 AS DOUBLE) AS lat, CAST(1400 + n_nationkey * 10 AS DOUBLE) AS elev_m FROM nation",
    "v_flow": "SELECT o_custkey % 20 AS site, o_orderkey AS seq, o_orderdate AS time, MAX(o_totalprice / 1000) AS cfs, MAX(o_totalprice / 50000) AS stage FROM orders GROUP BY 1, 2, 3",
    "v_sites": "SELECT s_suppkey - 1 AS site, s_name AS name, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_suppkey * 2.5 END AS drain_km2 FROM supplier WHERE s_suppkey <= 25",
    "v_scenes": """SELECT CONCAT('Fire-', CAST(o_custkey % 40 AS VARCHAR(9)), CASE WHEN o_custkey % 3 = 0 THEN '' ELSE '-NV' END, CASE WHEN o_custkey % 4 = 0 THEN '-prelim' ELSE '' END,
        CASE WHEN o_custkey % 17 = 0 THEN '-SBS_' ELSE '-dNBR_' END, REPLACE(SUBSTR(CAST(o_orderdate AS VARCHAR(30)), 1, 10), '-', ''), '_235959.tif') AS filename FROM orders""",
    "v_dnbr": "SELECT l_orderkey AS id, l_linenumber AS line, CASE WHEN l_suppkey % 9 = 0 THEN NULL ELSE l_discount * 12 - 0.2 + l_tax / 7 END AS v FROM lineitem",
    "v_mines": """SELECT p_partkey AS id, CASE p_partkey % 12 WHEN 0 THEN 'Mine Dump' WHEN 1 THEN 'Adit' WHEN 2 THEN 'Tailings - Pond' WHEN 3 THEN 'Prospect Pit' WHEN 4 THEN ' gravel pit ' WHEN 5 THEN 'Quarry - Rock'
        WHEN 6 THEN 'Mill Site' WHEN 7 THEN NULL WHEN 8 THEN 'Mine Shaft' WHEN 9 THEN 'Something' WHEN 10 THEN 'Trench' ELSE 'Strip Mine' END AS ftr_type,
        (p_partkey * 7919) % 9973 * 1.7 AS x, (p_partkey * 104729) % 9973 * 1.3 AS y FROM part""",
    "v_pf": """SELECT n_nationkey AS point, a.ari AS ari, 18 * POWER(a.ari, 0.27) * (1 + n_nationkey / {real(50.0)}) AS i FROM nation CROSS JOIN
        (SELECT CAST(1 AS DOUBLE) AS ari UNION ALL SELECT 2.0 UNION ALL SELECT 5.0 UNION ALL SELECT 10.0 UNION ALL SELECT 25.0 UNION ALL SELECT 50.0 UNION ALL SELECT 100.0 UNION ALL SELECT 200.0 UNION ALL SELECT 500.0 UNION ALL SELECT 1000.0) a""",
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "pages")
_SPARK = {"minutes": lambda x: f"timestampadd(MINUTE, ({x}) * 2, TIMESTAMP_NTZ'2024-01-01 00:00:00')", "days": lambda x: f"datediff(CAST({x} AS DATE), DATE'1995-01-01')", "hour": lambda x: f"CAST(DATE_TRUNC('hour', {x}) AS TIMESTAMP_NTZ)", "real": lambda x: f"{x}D"}
_DUCKDB = {"minutes": lambda x: f"TIMESTAMP '2024-01-01' + to_minutes(CAST(({x}) * 2 AS BIGINT))", "days": lambda x: f"date_diff('day', DATE '1995-01-01', CAST({x} AS DATE))", "hour": lambda x: f"date_trunc('hour', {x})", "real": lambda x: x}


def _written(sql: str, dialect: dict) -> str:
    return re.sub(r"\{(\w+)\(([^)]*)\)\}", lambda m: dialect[m[1]](m[2]), sql)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view as a DataFrame over the Parquet files of sf_dir."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = _written(VIEWS[name], _SPARK)
    used = [n for n in (*VIEWS, *TABLES) if n != name and re.search(rf"\b(?:FROM|JOIN) {n}\b", sql)]
    for n in used:
        sql = re.sub(rf"\b(FROM|JOIN) {n}\b", rf"\1 {{{n}}}", sql)
    return spark.sql(sql, **{n: view(spark, sf_dir, n) for n in used})


def with_views(sql: str) -> str:
    """DuckDB SQL with the views that it uses put before it."""
    need: list[str] = []

    def add(text: str) -> None:
        for n in VIEWS:
            if re.search(rf"\b{n}\b", text) and n not in need:
                add(VIEWS[n])
                need.append(n)

    add(sql)
    if not need:
        return sql
    ctes = ", ".join(f"{n} AS ({_written(VIEWS[n], _DUCKDB)})" for n in need)
    return f"WITH {ctes}, {sql[5:]}" if sql.startswith("WITH ") else f"WITH {ctes} {sql}"
