"""Queries on kept runs, on joins of sorted buckets and on files in batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import bucketed
from ..operators import resample as R
from ..sources import batches, files, images, results
from ..sources.scratch import new_path
from .catalog import hashed, query, r
from .catalog_cohort import boot_ctes, diff_sql
from .catalog_inference import CI, FINDINGS, between
from .views import table, view

REPS, SEED = 20, 10221983

# ---- runs that are kept


def _runs_sql() -> str:
    """Percentile intervals of both findings' panels, as runs of two models."""
    ctes, rows = [], []
    for tag, (name, source) in zip(("_a", "_b"), FINDINGS.items()):
        ctes.append(boot_ctes(source, tag, REPS, SEED, None))
        ctes.append(f"jn{tag} AS (SELECT metric, any_value(p.value) AS stat, list(l.value) AS t FROM rl{tag} l JOIN pl{tag} p USING (metric) GROUP BY metric)")
        note = "'first'" if name == "bulk" else "NULL"
        ends = f"{r('stat', 6)} AS stat, {r(between('2.5'), 6)} AS lower, {r(between('97.5'), 6)} AS upper"
        rows.append(f"SELECT 'run-{name}' AS run, '{name}' AS model, {note} AS site, metric, {ends} FROM jn{tag}")
    return f"WITH {', '.join(ctes)} {' UNION ALL '.join(rows)}"


def kept_runs(spark: SparkSession, d: str) -> str:
    """A store of both findings' runs; that of the first was run before, with fewer replicates."""
    path = new_path(spark, "runs")
    rows = view(spark, d, "scored_findings").where(F.col("finding").isin(*FINDINGS))
    old = R.bootstrap(rows.where(F.col("finding") == "bulk"), 3, "pct", draws=R.bootstrap_weights)
    results.save_run(old, path, "run-bulk", "bulk", site="old")
    both = R.bootstraps(rows, "finding", REPS, "pct")
    results.save_run(both["bulk"], path, "run-bulk", "bulk", site="first")
    results.save_run(both["open"], path, "run-open", "open")
    return path


@query("s10_kept_intervals", _runs_sql(), "scored_findings")
def s10(spark: SparkSession, d: str) -> DataFrame:
    kept = results.read_intervals(spark, kept_runs(spark, d), list(FINDINGS))
    return kept.select("run", "model", "site", "metric", *[S.half_even(c, 6).alias(c) for c in CI])


@query("s10_difference_of_kept_runs", diff_sql(0), "scored_findings")
def s10d(spark: SparkSession, d: str) -> DataFrame:
    """The difference of two runs from what is kept of them; nothing is drawn again."""
    path = kept_runs(spark, d)
    out = R.difference(*[results.read_run(spark, path, f"run-{f}") for f in FINDINGS], "pct")
    return out.select("metric", *[S.half_even(c, 6).alias(c) for c in ("ref", "comp", "d", "lower", "upper")])


# ---- joins without an exchange

LINES = "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS quantity, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


def lines_and_orders(spark: SparkSession, d: str) -> bucketed.Pair:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("quantity"))
    return bucketed.lay_out(lines, table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "l_orderkey", "o_orderkey", 16)


@query("j02_sorted_buckets", LINES)
def j02(spark: SparkSession, d: str) -> DataFrame:
    return lines_and_orders(spark, d).join()


@query("j02_joined_twice", f"SELECT l_orderkey, sum(quantity)::BIGINT AS quantity, count(*) AS lines, max(o_orderstatus) AS status FROM ({LINES}) WHERE quantity > 25 GROUP BY l_orderkey")
def j02t(spark: SparkSession, d: str) -> DataFrame:
    """Two joins of one layout: totals of the lines joined, and the status, by order."""
    pair = lines_and_orders(spark, d)
    many = bucketed.Pair(pair.left.where("quantity > 25"), pair.right, pair.key, pair.piece)
    total = many.join().groupBy(pair.key).agg(F.sum("quantity").alias("quantity"), F.count(F.lit(1)).alias("lines"))
    return total.join(many.join().groupBy(pair.key).agg(F.max("o_orderstatus").alias("status")), pair.key)


# ---- files in batches

MOST, SHARDS = 4096, 4
#: Files of very different lengths, one for each supplier.
COPIES = "(1 + s_suppkey % 13 + CASE WHEN s_suppkey % 40 = 3 THEN 200 ELSE 0 END)"
FILE = "concat('s', s_suppkey, '.png')"
BATCHED = f"""
WITH f AS (SELECT s_suppkey, {FILE} AS file, repeat(s_name, CAST({COPIES} AS INT)) AS content, {hashed(f"concat('5:', {FILE})")} AS h FROM supplier WHERE s_suppkey % 4 <> 0),
l AS (SELECT *, strlen(content) AS length, strlen(content) <= {MOST // 2} AS small FROM f),
w AS (SELECT *, h % {SHARDS} AS shard, coalesce(sum(CASE WHEN small THEN length ELSE 0 END) OVER b, 0) AS before, coalesce(sum(CASE WHEN small THEN 0 ELSE 1 END) OVER b, 0) AS large
      FROM l WINDOW b AS (PARTITION BY h % {SHARDS} ORDER BY h, file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT s_suppkey, file, length::BIGINT AS length, shard::INT AS shard, md5(content) AS md5,
       CASE WHEN small THEN 2 * floor(before / {MOST // 2}) ELSE 2 * large + 1 END::BIGINT AS batch
FROM w
"""


def supplier_files(spark: SparkSession, d: str) -> str:
    s = table(spark, d, "supplier").select(F.expr(FILE).alias("name"), F.expr(f"CAST(repeat(s_name, CAST({COPIES} AS INT)) AS BINARY)").alias("content"))
    path = new_path(spark, "files")
    images.write_images(s, path)
    return path


@query("s08_label_batches", BATCHED)
def s08(spark: SparkSession, d: str) -> DataFrame:
    """Files of all suppliers, of which three in four have a label; one label in seven names no file."""
    path = supplier_files(spark, d)
    k = F.col("s_suppkey")
    labels = table(spark, d, "supplier").select("s_suppkey", F.expr(FILE).alias("file")).where(k % 4 != 0)
    labels = labels.union(table(spark, d, "supplier").where(k % 7 == 0).select("s_suppkey", F.concat(F.lit("no_"), F.expr(FILE))))
    rows = batches.batched(batches.matched(labels, files.list_files(spark, path)), MOST, SHARDS, 5)
    return batches.with_content(rows, SHARDS).select("s_suppkey", "file", "length", "shard", F.md5("content").alias("md5"), "batch")


@query("s08_unmatched", f"SELECT {FILE} AS name, 'files' AS side FROM supplier WHERE s_suppkey % 4 = 0 UNION ALL SELECT concat('no_', {FILE}), 'labels' FROM supplier WHERE s_suppkey % 7 = 0")
def s08u(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    s = table(spark, d, "supplier").select("s_suppkey", F.expr(FILE).alias("file"))
    labels = s.where(k % 4 != 0).union(s.where(k % 7 == 0).withColumn("file", F.concat(F.lit("no_"), "file")))
    return batches.unmatched(labels, files.list_files(spark, supplier_files(spark, d)))


@query("s09_labelled_folders", "SELECT concat('c_mktsegment=', c_mktsegment) AS label, (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::INT AS class, count(*) AS n FROM customer GROUP BY c_mktsegment")
def s09(spark: SparkSession, d: str) -> DataFrame:
    """A folder of customers for each segment; the rows of its files are counted under the folder's class."""
    path = new_path(spark, "folders")
    table(spark, d, "customer").select("c_custkey", "c_mktsegment").repartition(4, "c_custkey").write.partitionBy("c_mktsegment").csv(path)
    listed = batches.labelled_folders(spark, path).where(F.col("file_name").endswith(".csv"))
    lines = batches.with_content(batches.batched(listed.withColumnRenamed("file_name", "file").drop("id"), shards=SHARDS), SHARDS)
    return lines.groupBy("label", "class").agg(F.sum(F.size(F.split(F.col("content").cast("string"), "\n")) - 1).alias("n"))
