"""Views derived from the star schema; the same SQL runs in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
_SCORE = "(CAST(l_quantity AS INT) + 10 * CAST(round(l_discount * 100) AS INT)) / CAST(160 AS DOUBLE)"
_ORDER = "(51 - CAST(l_quantity AS INT) + 10 * CAST(round(l_discount * 100) AS INT)) / CAST(160 AS DOUBLE)"
_TAX = "(CAST(l_quantity AS INT) + 10 * CAST(round(l_tax * 100) AS INT)) / CAST(140 AS DOUBLE)"

SQL = {
    "scored_grid": f"SELECT {KEYS}, l_returnflag AS grp, CAST(l_quantity > 30 AS INT) AS y, {_SCORE} AS p FROM lineitem",
    "scored_cont": "SELECT event_id, user_id, CAST(event_type = 'purchase' AS INT) AS y, value / CAST(500 AS DOUBLE) AS p FROM events",
    "scored_findings": f"SELECT 'bulk' AS finding, {KEYS}, CAST(l_quantity > 30 AS INT) AS y, {_SCORE} AS p FROM lineitem "
    f"UNION ALL SELECT 'returned', {KEYS}, CAST(l_returnflag = 'R' AS INT), {_TAX} FROM lineitem "
    f"UNION ALL SELECT 'open', {KEYS}, CAST(l_linestatus = 'O' AS INT), {_ORDER} FROM lineitem",
    "cohort": "SELECT concat(CASE o_orderkey % 4 WHEN 0 THEN 'im_' WHEN 1 THEN 'ref_' WHEN 2 THEN 'iom_' ELSE 'pan_' END, CAST(o_orderkey AS VARCHAR(20))) AS id, "
    "n_name AS exam_country, r_name AS region, CAST(o_orderdate AS DATE) AS exam_date, DATE '1930-01-01' + CAST((o_custkey * 37) % 25000 AS INT) AS date_of_birth, "
    "c_mktsegment AS panel_site, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE CAST(o_orderstatus <> 'O' AS INT) END AS abnormal, "
    "CAST(o_orderstatus = 'F' AND o_orderkey % 3 = 0 AS INT) AS infiltrate, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderstatus = 'F' AND o_orderkey % 5 = 0 AS INT) END AS nodule "
    "FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
}
#: The same rows from one scan, which only Spark's dialect can say.
ONE_SCAN = {
    "scored_findings": f"SELECT u.finding, {KEYS}, u.y, u.p FROM lineitem LATERAL VIEW inline(array("
    f"named_struct('finding', 'bulk', 'y', CAST(l_quantity > 30 AS INT), 'p', {_SCORE}), "
    f"named_struct('finding', 'returned', 'y', CAST(l_returnflag = 'R' AS INT), 'p', {_TAX}), "
    f"named_struct('finding', 'open', 'y', CAST(l_linestatus = 'O' AS INT), 'p', {_ORDER}))) u AS finding, y, p",
}
TABLES = {"scored_grid": ["lineitem"], "scored_cont": ["events"], "scored_findings": ["lineitem"], "cohort": ["orders", "customer", "nation", "region"]}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = ONE_SCAN.get(name, SQL[name])
    for t in TABLES[name]:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t} ", f"JOIN {{{t}}} AS {t} ").replace(f"FROM {{{t}}}", f"FROM {{{t}}} AS {t}")
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in TABLES[name]})


def with_views(sql: str, *names: str) -> str:
    """sql with the named views in front as common table expressions."""
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names) + (", " + sql[5:] if sql.startswith("WITH ") else " " + sql)
