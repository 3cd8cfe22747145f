"""Queries on cohorts, tables, samples and images; importing this adds them to the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import cohort as C
from ..operators import confusion as M
from ..operators import image as I
from ..operators import panel as P
from ..operators import resample as R
from ..operators import roc
from ..operators import tables as T
from .catalog import CELLS, curve_sql, hashed, query, r
from .views import table, view, with_views

SOURCES = [("pan_", "pan"), ("iom_", "iom"), ("ref_", "ref"), ("im_", "im")]
SOURCE = "CASE WHEN contains(id, 'im_') THEN 'im' WHEN contains(id, 'ref_') THEN 'ref' WHEN contains(id, 'iom_') THEN 'iom' WHEN contains(id, 'pan_') THEN 'pan' ELSE '' END"
AGE = "date_sub('year', date_of_birth, exam_date)"
GOOD = ["AUTOMOBILE", "BUILDING"]
FLAGGED = f"SELECT *, CAST(coalesce(infiltrate, 0) + coalesce(nodule, 0) > 0 AS INT) AS abnormal_tb, {SOURCE} AS source FROM cohort"
AGE_BINS = ("CASE WHEN {a} > 15 AND {a} <= 25 THEN '15-24' WHEN {a} > 25 AND {a} <= 35 THEN '25-34' WHEN {a} > 35 AND {a} <= 45 THEN '35-44' WHEN {a} > 45 AND {a} <= 55 THEN '45-54' WHEN {a} > 55 AND {a} <= 65 THEN '55-64' WHEN {a} > 65 AND {a} <= 99 THEN '>=65' ELSE 'nan' END").replace("{a}", AGE)
EDGES, LABELS = [15, 25, 35, 45, 55, 65, 99], ["15-24", "25-34", "35-44", "45-54", "55-64", ">=65"]


def cohort(spark: SparkSession, d: str) -> DataFrame:
    """The cohort with source, abnormal_tb and age_years."""
    c = view(spark, d, "cohort").withColumn("source", S.contains_map("id", SOURCES))
    return C.add_flags(c, ["infiltrate"], ["nodule"]).withColumn("age_years", S.completed_years("date_of_birth", "exam_date"))


@query("p01_project_rename", "SELECT id, exam_country AS country, abnormal FROM cohort", "cohort")
def p01(spark, d):
    c = view(spark, d, "cohort").select(F.col("id"), F.col("exam_country").alias("exam country"), F.col("region").alias("DS_Region"), "abnormal", F.lit(9).alias("DS_ChestXrayFinding"))
    return C.rename_first_wins(c, {"examcountry": "country", "DS_ChestXrayFinding": "abnormal"}).select("id", "country", "abnormal")


@query("p04_prefix", "SELECT concat('pan_', CAST(o_orderkey AS VARCHAR)) AS id, 'na' AS sex FROM orders")
def p04(spark, d):
    return table(spark, d, "orders").select(F.concat(F.lit("pan_"), F.col("o_orderkey").cast("string")).alias("id"), F.lit("na").alias("sex"))


@query("p06_any_positive", f"SELECT id, abnormal_tb FROM ({FLAGGED})", "cohort")
def p06(spark, d):
    return cohort(spark, d).select("id", "abnormal_tb")


@query("p07_p08_drop_fill", "SELECT id, abnormal, coalesce(nodule, 0) AS nodule FROM cohort WHERE abnormal IS NOT NULL", "cohort")
def p08(spark, d):
    return view(spark, d, "cohort").na.drop(subset=["abnormal"]).na.fill(0, subset=["nodule"]).select("id", "abnormal", "nodule")


@query("p09_source_map", f"SELECT id, {SOURCE} AS source FROM cohort", "cohort")
def p09(spark, d):
    return cohort(spark, d).select("id", "source")


@query("p10_membership", f"SELECT id FROM ({FLAGGED}) WHERE source IN ('iom', 'pan') AND region = 'ASIA'", "cohort")
def p10(spark, d):
    return cohort(spark, d).where(F.col("source").isin("iom", "pan") & (F.col("region") == "ASIA")).select("id")


@query("p11_coercing_date", "SELECT o_orderkey, try_cast(CASE WHEN o_orderkey % 5 = 0 THEN 'unknown' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS DATE) AS d FROM orders")
def p11(spark, d):
    text = F.when(F.col("o_orderkey") % 5 == 0, "unknown").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, d, "orders").select("o_orderkey", F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date").alias("d"))


@query("p12_age_years", f"SELECT id, {AGE}::INT AS age_years FROM cohort", "cohort")
def p12(spark, d):
    return cohort(spark, d).select("id", "age_years")


@query("p13_age_days", "SELECT id, (exam_date - date_of_birth)::INT AS age_days, (exam_date - date_of_birth) >= 5475 AS adult FROM cohort", "cohort")
def p13(spark, d):
    days = F.datediff("exam_date", "date_of_birth")
    return view(spark, d, "cohort").select("id", days.alias("age_days"), (days >= 15 * 365).alias("adult"))


@query("p14_adults_kids", f"SELECT CASE WHEN {AGE} >= 15 THEN 'adults' ELSE 'kids' END AS part, count(*) AS n FROM cohort GROUP BY part", "cohort")
def p14(spark, d):
    return cohort(spark, d).groupBy(F.when(F.col("age_years") >= 15, "adults").otherwise("kids").alias("part")).agg(F.count(F.lit(1)).alias("n"))


@query("p15_age_group", f"SELECT id, {AGE_BINS} AS age_group FROM cohort", "cohort")
def p15(spark, d):
    return cohort(spark, d).select("id", S.cut("age_years", EDGES, LABELS).alias("age_group"))


RECODE = {"UNITED STATES": "USA", "UNITED KINGDOM": "UK", "VIETNAM": "VIET NAM", "RUSSIA": "RUSSIAN FEDERATION"}


@query("p16_recode", "SELECT n_nationkey, CASE upper(n_name) WHEN 'UNITED STATES' THEN 'USA' WHEN 'UNITED KINGDOM' THEN 'UK' WHEN 'VIETNAM' THEN 'VIET NAM' WHEN 'RUSSIA' THEN 'RUSSIAN FEDERATION' ELSE upper(n_name) END AS name FROM nation")
def p16(spark, d):
    return table(spark, d, "nation").select("n_nationkey", S.recode("n_name", RECODE).alias("name"))


@query("p17_kind", f"SELECT id, CASE WHEN abnormal_tb = 1 THEN 'TB' WHEN abnormal = 1 AND abnormal_tb = 0 THEN 'no TB' ELSE 'normal' END AS ab_kind FROM ({FLAGGED})", "cohort")
def p17(spark, d):
    return cohort(spark, d).select("id", C.kind(F.col("abnormal"), F.col("abnormal_tb")).alias("ab_kind"))


@query("p18_reference_flags", f"SELECT count(*) FILTER (WHERE panel_site IN ('AUTOMOBILE', 'BUILDING')) AS good_any, count(*) FILTER (WHERE source IN ('pan', 'iom') OR panel_site IN ('AUTOMOBILE', 'BUILDING')) AS pref_reads, count(*) FILTER (WHERE source IN ('pan', 'iom') AND abnormal = 1) AS ref_abn, count(*) FILTER (WHERE panel_site IN ('AUTOMOBILE', 'BUILDING') AND abnormal = 0) AS ref_nrm FROM ({FLAGGED})", "cohort")
def p18(spark, d):
    f = C.reference_flags(cohort(spark, d), GOOD)
    return f.agg(*[F.count_if(F.col(c)).alias(c) for c in ("good_any", "pref_reads", "ref_abn", "ref_nrm")])


TRIM = "CASE WHEN length(split_part(f, '_', 3)) > 6 THEN concat('pan_12_', right(split_part(f, '_', 3), 6)) ELSE f END"


@query("p21_trim_zeroes", f"SELECT o_orderkey, {TRIM} AS name FROM (SELECT o_orderkey, concat('pan_12_', lpad(CAST(o_orderkey AS VARCHAR), 3 + CAST(o_orderkey % 7 AS INT), '0')) AS f FROM orders)")
def p21(spark, d):
    f = F.expr("concat('pan_12_', lpad(cast(o_orderkey as string), 3 + cast(o_orderkey % 7 as int), '0'))")
    return table(spark, d, "orders").withColumn("f", f).select("o_orderkey", S.trim_zeroes("f").alias("name"))


@query("p22_extension", "SELECT page_id, CASE WHEN instr(url, '.') > 0 THEN substr(url, instr(url, '.')) END AS ext FROM pages")
def p22(spark, d):
    return table(spark, d, "pages").select("page_id", S.first_dot_extension("url").alias("ext"))


@query("p23_strip_extension", "SELECT page_id, regexp_replace(url, '\\.[^.]+$', '') AS stem FROM pages")
def p23(spark, d):
    return table(spark, d, "pages").select("page_id", S.strip_extension("url").alias("stem"))


@query("p25_p26_intervals", f"SELECT grp AS model, 'sens' AS metric, concat(printf('%.4f', s), ' (', printf('%.4f', s - 0.01), ', ', printf('%.4f', s + 0.01), ')') AS ci FROM (SELECT grp, {r('tp::DOUBLE / (tp + fn)')} AS s FROM (SELECT grp, {CELLS} FROM scored_grid GROUP BY grp))", "scored_grid")
def p25(spark, d):
    c = M.counts(view(spark, d, "scored_grid"), ("grp",), "y", M.threshold("p", 0.5)).select("grp", F.lit("sens").alias("metric"), S.half_even(M.Rates().sens).alias("stat"))
    c = c.withColumns({"lower": F.col("stat") - 0.01, "upper": F.col("stat") + 0.01})
    return T.merge_intervals([(g, c.where(F.col("grp") == g)) for g in ("A", "N", "R")])


@query("p28_onehot", "SELECT event_id, (lower(event_type) = 'cart')::INT AS cart, (lower(event_type) = 'click')::INT AS click, (lower(event_type) = 'purchase')::INT AS purchase, (lower(event_type) = 'view')::INT AS view FROM events")
def p28(spark, d):
    return T.onehot(table(spark, d, "events"), "event_id", "event_type", ["view", "click", "cart", "purchase"])


@query("p30_prevalence", f"SELECT finding, sum(y)::BIGINT AS n_pos, {r('sum(y)::DOUBLE / count(*)')} AS prevalence, {r('sum(y)::DOUBLE / count(*)', 2)} AS prevalence_2 FROM scored_findings GROUP BY finding", "scored_findings")
def p30(spark, d):
    f = view(spark, d, "scored_findings")
    return T.prevalence(f, ("finding",)).join(T.prevalence(f, ("finding",), digits=2).select("finding", F.col("prevalence").alias("prevalence_2")), "finding")


@query("j01_labels_predictions", "SELECT id, abnormal, (o % 1000) / 1000.0::DOUBLE AS p FROM (SELECT *, CAST(split_part(id, '_', 2) AS BIGINT) AS o FROM cohort) WHERE o % 3 <> 0", "cohort")
def j01(spark, d):
    preds = table(spark, d, "orders").where(F.col("o_orderkey") % 3 != 0).select("o_orderkey", (F.col("o_orderkey") % 1000 / 1000).alias("p"))
    c = view(spark, d, "cohort").withColumn("o_orderkey", F.element_at(F.split("id", "_"), 2).cast("long"))
    return c.join(preds, "o_orderkey").select("id", "abnormal", "p")


@query("j03_has_image", "SELECT o_orderkey FROM orders INTERSECT SELECT l_orderkey FROM lineitem")
def j03(spark, d):
    kept, _ = C.match_files(table(spark, d, "orders").select(F.col("o_orderkey").alias("id")), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id")))
    return kept.select(F.col("id").alias("o_orderkey"))


@query("j04_orphans", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def j04(spark, d):
    _, orphans = C.match_files(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id")), table(spark, d, "orders").select(F.col("o_orderkey").alias("id")))
    return orphans.select(F.col("id").alias("o_orderkey"))


@query("j06_semi", "SELECT o_orderkey, o_orderstatus FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def j06(spark, d):
    lines = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").join(lines, "o_orderkey", "left_semi").select("o_orderkey", "o_orderstatus")


@query("j07_region_lookup", "SELECT id, CASE WHEN exam_country = 'CHINA' THEN 'NA' ELSE cast(n_regionkey AS VARCHAR) END AS n_regionkey FROM cohort LEFT JOIN nation ON exam_country = n_name", "cohort")
def j07(spark, d):
    c = view(spark, d, "cohort").withColumn("key", F.when(F.col("exam_country") == "CHINA", "nan").otherwise(F.col("exam_country")))
    n = table(spark, d, "nation").select("n_name", F.col("n_regionkey").cast("string").alias("n_regionkey"))
    return C.lookup(c, n, "key", "n_name", "n_regionkey").select("id", "n_regionkey")


@query("j10_outer_align", f"SELECT coalesce(a.exam_country, b.exam_country) AS exam_country, a.n AS ab_n, b.n AS tb_n FROM (SELECT exam_country, count(*) AS n FROM cohort WHERE abnormal = 1 AND region <> 'ASIA' GROUP BY 1) a FULL JOIN (SELECT exam_country, count(*) AS n FROM ({FLAGGED}) WHERE abnormal_tb = 1 AND region <> 'AFRICA' GROUP BY 1) b ON a.exam_country = b.exam_country", "cohort")
def j10(spark, d):
    c = cohort(spark, d)
    n = lambda x: x.groupBy("exam_country").agg(F.count(F.lit(1)).alias("n"))
    return T.outer_align({"ab": n(c.where("abnormal = 1 and region <> 'ASIA'")), "tb": n(c.where("abnormal_tb = 1 and region <> 'AFRICA'"))}, "exam_country")


@query("j11_cross", "SELECT r_name, rep::BIGINT AS rep FROM region, range(5) t(rep)")
def j11(spark, d):
    return table(spark, d, "region").select("r_name").crossJoin(spark.range(5).select(F.col("id").alias("rep")))  # five rows for each region, as asked


@query("a01_a02_crosstab", f"SELECT source, count(*) AS n, count(*) FILTER (WHERE abnormal = 0) AS abnormal_0, count(*) FILTER (WHERE abnormal = 1) AS abnormal_1 FROM ({FLAGGED}) GROUP BY source", "cohort")
def a02(spark, d):
    c = cohort(spark, d)
    return c.groupBy("source").agg(F.count(F.lit(1)).alias("n")).join(T.crosstab(c, "source", "abnormal", [0, 1]), "source")


@query("a03_flow_table", f"SELECT source, count(*) AS n, count(*) FILTER (WHERE abnormal = 1) AS ab, {r('count(*) FILTER (WHERE abnormal = 1)::DOUBLE / count(*)', 6)} AS pct_ab, sum(abnormal_tb)::BIGINT AS abtb, {r('sum(abnormal_tb)::DOUBLE / count(*)', 6)} AS pct_abtb FROM ({FLAGGED}) GROUP BY source", "cohort")
def a03(spark, d):
    return T.flow_table(cohort(spark, d)).withColumns({c: S.half_even(c, 6) for c in ("pct_ab", "pct_abtb")})


SPLIT = f"CASE WHEN {hashed('''concat('2022:', id)''')} < {int(0.7 * 2**32)} THEN 'train' ELSE 'val' END"


def describe_sql(variables: dict[str, str], levels: dict[str, list[str]], digits: int = 0) -> str:
    """Table 1 by splits with UNION ALL: variables name SQL expressions."""
    parts = " UNION ALL ".join(f"SELECT '{v}' AS variable, CAST({e} AS VARCHAR) AS level, split FROM s" for v, e in variables.items())
    fixed = " UNION ALL ".join([f"SELECT '{v}' AS variable, '{x}' AS level" for v, xs in levels.items() for x in xs] + [f"SELECT DISTINCT variable, level FROM long WHERE variable = '{v}' AND level IS NOT NULL" for v in variables if v not in levels])
    return (
        f"WITH f AS ({FLAGGED}), b AS (SELECT *, {SPLIT} AS sp FROM f), s AS (SELECT *, 'All' AS split FROM b UNION ALL SELECT *, sp FROM b), long AS ({parts}), lv AS ({fixed}), "
        "rw AS (SELECT variable, split, count(*) AS nrow FROM long GROUP BY ALL), ct AS (SELECT variable, level, split, count(*) AS n FROM long GROUP BY ALL), "
        "g AS (SELECT rw.variable, lv.level, rw.split, coalesce(ct.n, 0) AS n, nrow FROM rw JOIN lv ON rw.variable = lv.variable LEFT JOIN ct ON ct.variable = rw.variable AND ct.level = lv.level AND ct.split = rw.split), "
        "w AS (SELECT *, sum(n) OVER (PARTITION BY variable, split) AS tot, count(*) OVER (PARTITION BY variable, split) AS k FROM g) "
        f"SELECT variable, level, split, n, {r('(100 * coalesce(n::DOUBLE / nullif(CASE WHEN k = 1 THEN nrow ELSE tot END, 0), 0))', digits)} AS pct FROM w"
    )


def split_cohort(spark: SparkSession, d: str) -> DataFrame:
    return R.hash_split(cohort(spark, d)).withColumn("age_group", S.cut("age_years", EDGES, LABELS))


@query("a05_table1", describe_sql({"region": "region"}, {"region": ["AFRICA", "ASIA", "NOWHERE"]}), "cohort")
def a05(spark, d):
    return T.describe(split_cohort(spark, d), {"region": ["AFRICA", "ASIA", "NOWHERE"]})


@query("a06_demographics", describe_sql({"age_group": AGE_BINS, "region": "region", "source": "source", "panel_site": "panel_site"}, {}), "cohort")
def a06(spark, d):
    return T.describe(split_cohort(spark, d), {"age_group": None, "region": None, "source": None, "panel_site": None})


@query("a07_outcomes", describe_sql({"abnormal": "abnormal", "infiltrate": "infiltrate", "nodule": "nodule", "abnormal_tb": "abnormal_tb"}, {v: ["1"] for v in ("abnormal", "infiltrate", "nodule", "abnormal_tb")}, 1), "cohort")
def a07(spark, d):
    return T.describe(split_cohort(spark, d), {v: ["1"] for v in ("abnormal", "infiltrate", "nodule", "abnormal_tb")}, digits=1)


@query("a08_a09_sums_levels", "SELECT region, sum(infiltrate)::BIGINT AS infiltrate, sum(coalesce(nodule, 0))::BIGINT AS nodule FROM cohort GROUP BY region", "cohort")
def a08(spark, d):
    return view(spark, d, "cohort").groupBy("region").agg(F.sum("infiltrate").alias("infiltrate"), F.sum(F.coalesce("nodule", F.lit(0))).alias("nodule"))


@query("a10_dedupe_first", "SELECT id, min(src_ord) AS src_ord FROM (SELECT concat('x', substr(id, 4)) AS id, 0 AS src_ord FROM cohort WHERE region = 'ASIA' UNION ALL SELECT concat('x', substr(id, 4)), 1 FROM cohort) GROUP BY id", "cohort")
def a10(spark, d):
    c = view(spark, d, "cohort").withColumn("id", F.expr("substring(id, 4)"))
    both = C.stack_sources([(c.where("region = 'ASIA'"), "x"), (c, "x")], ["id"])
    return C.dedupe_first(both, "id", ["src_ord"])


@query("a11_max_prob", f"SELECT vec_id, {r('list_max(e)', 6)} AS top, (list_position(e, list_max(e)) - 1)::INT AS argmax FROM (SELECT vec_id, list_transform(embedding[1:10], lambda x: x::DOUBLE) AS e FROM embeddings)")
def a11(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.slice(F.col("embedding").cast("array<double>"), 1, 10).alias("e"))
    return e.select("vec_id", S.half_even(F.array_max("e"), 6).alias("top"), (F.array_position("e", F.array_max("e")) - 1).cast("int").alias("argmax"))


@query("a13_roc_band", f"{curve_sql('scored_findings', 'finding')}, b AS (SELECT round_even(fps::DOUBLE / nn * 100, 0) / 100 AS fpr, tps::DOUBLE / np AS tpr FROM cum) SELECT fpr, {r('quantile_cont(tpr, 0.025)', 6)} AS lower, {r('quantile_cont(tpr, 0.5)', 6)} AS med, {r('quantile_cont(tpr, 0.975)', 6)} AS upper FROM b GROUP BY fpr", "scored_findings")
def a13(spark, d):
    return roc.band(roc.curve(view(spark, d, "scored_findings"), ("finding",))).withColumns({c: S.half_even(c, 6) for c in ("lower", "med", "upper")})


@query("a15_harmonic_p", f"SELECT user_id, {r('count(*)::DOUBLE / sum(1 / (value / 500 + 1e-7))', 6)} AS p_avg, {r('1 / sum((event_id % 5 + 1) / (value / 500 + 1e-7))', 8)} AS p_weighted, {r('count(*)::DOUBLE / sum(1 / (value / 500))', 6)} AS p_plain, {r('-2 * sum(ln(value / 500 + 1e-7))')} AS fisher FROM events WHERE value > 0 GROUP BY user_id")
def a15(spark, d):
    e = table(spark, d, "events").where("value > 0").withColumns({"p": F.col("value") / 500, "w": F.col("event_id") % 5 + 1})
    return e.groupBy("user_id").agg(S.half_even(T.harmonic_p(), 6).alias("p_avg"), S.half_even(T.harmonic_p(w="w"), 8).alias("p_weighted"), S.half_even(T.harmonic_p(smooth=None), 6).alias("p_plain"), S.half_even(T.fisher_statistic()).alias("fisher"))


@query("t01_t03_sort_limit", "SELECT id, exam_country FROM cohort ORDER BY id LIMIT 100", "cohort")
def t03(spark, d):
    return view(spark, d, "cohort").orderBy("id").limit(100).select("id", "exam_country")


@query("u01_u04_set_operations", "SELECT 'except' AS op, count(*) AS n FROM (SELECT o_custkey FROM orders EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') UNION ALL SELECT 'intersect', count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') UNION ALL SELECT 'union', 2 * count(*) FROM orders")
def u01(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderstatus")
    f = o.where("o_orderstatus = 'F'").select("o_custkey")
    n = lambda name, x: x.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("op"), "n")
    out = n("except", o.select("o_custkey").subtract(f)).unionByName(n("intersect", o.where("o_orderstatus = 'O'").select("o_custkey").intersect(f)))
    return out.unionByName(n("union", o.unionByName(o.drop("o_orderstatus"), allowMissingColumns=True)))


NUMBERED = "SELECT *, concat(l_orderkey, ':', l_linenumber, ':', l_partkey, ':', l_suppkey) AS id FROM scored_grid"


@query("r02_resample", f"WITH g AS ({NUMBERED}), k AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY {hashed('''concat('2022:', id)''')}, id) AS rn, count(*) OVER () AS n FROM g) SELECT id, y FROM k WHERE y = 0 OR rn <= CAST(floor(n * 0.12) AS BIGINT)", "scored_grid")
def r02(spark, d):
    g = view(spark, d, "scored_grid").withColumn("id", F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    return R.resample_prevalence(g, 0.12).select("id", "y")


STRATUM = "CASE WHEN source IN ('pan', 'iom') AND abnormal = 1 THEN 'abn' WHEN panel_site IN ('AUTOMOBILE', 'BUILDING') AND abnormal = 0 THEN 'nrm' END"


@query("r11_split", f"WITH f AS ({FLAGGED}), k AS (SELECT *, {STRATUM} AS st FROM f), q AS (SELECT *, row_number() OVER (PARTITION BY st ORDER BY {hashed('''concat('2022:', id)''')}, id) AS rn FROM k) SELECT id, CASE WHEN st IS NULL OR rn > 80 THEN 'train' WHEN rn <= 40 THEN 'val' ELSE 'test' END AS split FROM q", "cohort")
def r11(spark, d):
    c = C.reference_flags(cohort(spark, d), GOOD)
    return R.fixed_split(c, F.when(F.col("ref_abn"), "abn").when(F.col("ref_nrm"), "nrm"), 80).select("id", "split")


@query("r12_scenario_split", f"WITH f AS ({FLAGGED}), k AS (SELECT *, panel_site IN ('AUTOMOBILE', 'BUILDING') AS good, source IN ('pan', 'iom') OR panel_site IN ('AUTOMOBILE', 'BUILDING') AS pref, CASE WHEN abnormal_tb = 1 THEN 'tb' WHEN abnormal = 1 THEN 'no_tb' WHEN abnormal = 0 THEN 'normal' END AS kd FROM f WHERE source IN ('im', 'ref')), ct AS (SELECT good, count(*) FILTER (WHERE kd = 'tb') AS tb, count(*) FILTER (WHERE kd = 'no_tb') AS nt FROM k GROUP BY good), sz AS (SELECT good, CASE WHEN tb <= nt THEN 20 ELSE 2 * CAST(floor(tb::DOUBLE / nt * 10) AS BIGINT) END AS tb, CASE WHEN tb <= nt THEN 2 * CAST(floor(nt::DOUBLE / tb * 10) AS BIGINT) ELSE 20 END AS nt FROM ct), one AS (SELECT max(tb) FILTER (WHERE good) AS htb, max(nt) FILTER (WHERE good) AS hnt, max(tb) FILTER (WHERE NOT good) AS ltb, max(nt) FILTER (WHERE NOT good) AS lnt FROM sz), rk AS (SELECT id, kd, row_number() OVER (PARTITION BY kd ORDER BY {hashed('''concat('2022:', id)''')}, id) AS rn FROM k WHERE kd IS NOT NULL AND (pref OR kd = 'no_tb')), q AS (SELECT id, rn, CASE kd WHEN 'tb' THEN htb WHEN 'no_tb' THEN hnt ELSE 20 END AS h, CASE kd WHEN 'tb' THEN ltb WHEN 'no_tb' THEN lnt ELSE 20 END AS w FROM rk, one) SELECT k.id, CASE WHEN rn <= h / 2.0 THEN 'val' WHEN rn <= h THEN 'test_high' WHEN rn - h <= w / 2.0 THEN 'val' WHEN rn <= h + w THEN 'test_low' ELSE 'train' END AS split FROM k LEFT JOIN q USING (id)", "cohort")
def r12(spark, d):
    c = cohort(spark, d).where(F.col("source").isin("im", "ref"))
    good = F.col("panel_site").isin(GOOD)
    return R.scenario_split(c, good, F.col("source").isin("pan", "iom") | good, 10).select("id", "split")


def boot_ctes(source: str, tag: str, reps: int, seed: int, p_adj: float | None) -> str:
    """Common table expressions rl{tag} (rep, metric, value) and pl{tag} (metric, value): the
    panel of each replicate and of all rows; rows are numbered by score, draws are by hash."""
    from .catalog import panel_sql

    key = lambda what: hashed(f"concat('{seed}:', rep, ':', {what}, ':', k)")
    if p_adj:
        trials = f"SELECT rep, n, count(*) FILTER (WHERE {key(chr(39) + 'p' + chr(39))} < {int(p_adj * 2**32)})::DOUBLE / n AS pr FROM (SELECT rep, n, unnest(range(n)) AS k FROM (SELECT sum(n)::BIGINT AS n FROM sz{tag}), range({reps}) t(rep)) GROUP BY rep, n"
        sizes = f"pv{tag} AS ({trials}), dz{tag} AS (SELECT rep, y, sz.n, CAST(floor((CASE WHEN y = 1 THEN pr ELSE 1 - pr END) * pv.n) AS BIGINT) AS m FROM pv{tag} pv, sz{tag} sz)"
    else:
        sizes = f"dz{tag} AS (SELECT rep, y, n, n AS m FROM sz{tag}, range({reps}) t(rep))"
    long = lambda src, b: " UNION ALL ".join(f"SELECT {b}'{m}' AS metric, {m}::DOUBLE AS value FROM {src}" for m in R.METRICS)
    return (
        f"g{tag} AS (SELECT y, p, row_number() OVER (PARTITION BY y ORDER BY p) - 1 AS i FROM {source}), sz{tag} AS (SELECT y, count(*) AS n FROM g{tag} GROUP BY y), {sizes}, "
        f"d{tag} AS (SELECT y, n, rep, unnest(range(m)) AS k FROM dz{tag}), dr{tag} AS (SELECT rep, y, {key('y')} % n AS i FROM d{tag}), "
        f"bs{tag} AS (SELECT rep, g.y, g.p FROM dr{tag} dr JOIN g{tag} g ON g.y = dr.y AND g.i = dr.i), "
        f"pr{tag} AS ({panel_sql('bs' + tag, 'rep')}), po{tag} AS ({panel_sql('g' + tag, '', p_adj)}), rl{tag} AS ({long('pr' + tag, 'rep, ')}), pl{tag} AS ({long('po' + tag, '')})"
    )


def near(values: str, q: float) -> str:
    return f"list_sort({values})[CAST(round_even({q} / 100 * (len({values}) - 1), 0) AS INT) + 1]"


def boot_sql(method: str, p_adj: float | None = None, reps: int = 20, seed: int = 10221983) -> str:
    """Bootstrap intervals of the panel; percentiles are nearest values."""
    ends = {
        "pct": (near("t", 2.5), near("t", 97.5)),
        "emp": ("stat - 1.959963984540054 * sd", "stat + 1.959963984540054 * sd"),
        "diff": ("stat + " + near("df", 2.5), "stat + " + near("df", 97.5)),
    }[method]
    return (
        f"WITH {boot_ctes('scored_grid', '', reps, seed, p_adj)}, "
        "jn AS (SELECT metric, any_value(pl.value) AS stat, list(rl.value) AS t, list(pl.value - rl.value) AS df, stddev_samp(rl.value) AS sd FROM rl JOIN pl USING (metric) GROUP BY metric) "
        f"SELECT metric, {r('stat', 6)} AS stat, {r(f'({ends[0]})', 6)} AS lower, {r(f'({ends[1]})', 6)} AS upper FROM jn"
    )


def diff_sql(p_adj: float, reps: int = 20, seed: int = 10221983) -> str:
    """Percentile intervals of the difference of two findings' panels, replicates paired by number."""
    two = [boot_ctes(f"(SELECT y, p FROM scored_findings WHERE finding = '{f}')", t, reps, seed, p_adj) for f, t in (("bulk", "_a"), ("open", "_b"))]
    return (
        f"WITH {', '.join(two)}, jn AS (SELECT metric, list(b.value - a.value) AS t FROM rl_a a JOIN rl_b b USING (rep, metric) GROUP BY metric) "
        f"SELECT metric, {r('a.value', 6)} AS ref, {r('b.value', 6)} AS comp, {r('(b.value - a.value)', 6)} AS d, {r('(' + near('t', 2.5) + ')', 6)} AS lower, {r('(' + near('t', 97.5) + ')', 6)} AS upper "
        "FROM jn JOIN pl_a a USING (metric) JOIN pl_b b USING (metric) WHERE metric <> 'true_prev'"
    )


def boot(spark: SparkSession, d: str, method: str, n: int = 20, draws=R.bootstrap_weights, p_adj: float | None = None, boot_mean: bool = False) -> DataFrame:
    out = R.bootstrap(view(spark, d, "scored_grid"), n, method, draws=draws, p_adj=p_adj, boot_mean=boot_mean).cis
    return out.select("metric", *[S.half_even(c, 6).alias(c) for c in ("stat", "lower", "upper")])


for _n, _m, _p in (("r05_boot_pct", "pct", None), ("r06_boot_emp", "emp", 0.12), ("r07_boot_diff", "diff", None), ("r04_boot_padj", "pct", 0.12)):
    query(_n, boot_sql(_m, _p), "scored_grid")(lambda spark, d, m=_m, p=_p: boot(spark, d, m, p_adj=p))


@query("r09_diff_padj", diff_sql(0.12), "scored_findings")
def r09p(spark, d):
    f = view(spark, d, "scored_findings").where(F.col("finding").isin("bulk", "open"))
    both = R.bootstraps(f, "finding", 20, "pct", p_adj=0.12)
    return R.difference(both["bulk"], both["open"], "pct").select("metric", *[S.half_even(c, 6).alias(c) for c in ("ref", "comp", "d", "lower", "upper")])


UNSTRATIFIED = hashed("concat('7:', rep, ':', k)")


@query("r01_unstratified", "WITH g AS (SELECT y, p, row_number() OVER (ORDER BY y, p) - 1 AS i, count(*) OVER () AS n FROM scored_grid), d AS (SELECT rep, unnest(range(5000)) AS k FROM range(3) t(rep)), " f"dr AS (SELECT rep, {UNSTRATIFIED} % (SELECT max(n) FROM g) AS i FROM d) SELECT rep::BIGINT AS rep, g.y, g.p, count(*) AS n FROM dr JOIN g ON g.i = dr.i GROUP BY ALL", "scored_grid")
def r01u(spark, d):
    return R.bootstrap_weights(R.cells(view(spark, d, "scored_grid")), 3, 7, size=5000, stratified=False)


@query("r01_bootstrap_draws", "WITH g AS (SELECT y, p, row_number() OVER (PARTITION BY y ORDER BY p) - 1 AS i FROM scored_grid), sz AS (SELECT y, count(*) AS n FROM g GROUP BY y), d AS (SELECT y, n, rep, unnest(range(n)) AS k FROM sz, range(3) t(rep)), " f"dr AS (SELECT rep, d.y, {hashed('''concat('10221983:', rep, ':', d.y, ':', k)''')} % n AS i FROM d) SELECT rep::BIGINT AS rep, g.y, g.p, count(*) AS n FROM dr JOIN g ON g.y = dr.y AND g.i = dr.i GROUP BY ALL", "scored_grid")
def r01(spark, d):
    return R.bootstrap_weights(R.cells(view(spark, d, "scored_grid")), 3)


LEFT_OUT = "WITH k AS (SELECT y, p, count(*) AS n FROM scored_grid GROUP BY ALL), o AS (SELECT y AS oy, p AS op, n AS weight FROM k), l AS (SELECT oy, op, weight, y, p, n - CAST(y = oy AND p = op AS INT) AS n FROM k, o)"


def jack_sql() -> str:
    """Rates without one row, by the cell that the row is in."""
    cells = ", ".join(f"sum(n) FILTER (WHERE y = {y} AND {h}p >= 0.5) AS {c}" for c, y, h in (("tp", 1, ""), ("fp", 0, ""), ("tn", 0, "NOT "), ("fn", 1, "NOT ")))
    from .catalog import NV, PV, SE, SP

    metrics = {"sens": r("se"), "spec": r("sp"), "ppv": r("pv"), "npv": r("nv"), "j": r(f"({r('se')} + {r('sp')} - 1)"), "f1": r("coalesce(2.0 * se * pv / nullif(pv + se, 0), 0)")}
    return (
        f"{LEFT_OUT}, c AS (SELECT oy, op >= 0.5 AS hit, op, weight, {cells} FROM l GROUP BY ALL), q AS (SELECT oy, hit, any_value(tp) AS tp, any_value(fp) AS fp, any_value(tn) AS tn, any_value(fn) AS fn, sum(weight)::BIGINT AS weight FROM c GROUP BY oy, hit), "
        f"z AS (SELECT *, {SE} AS se, {SP} AS sp, {PV} AS pv, {NV} AS nv FROM q) " + " UNION ALL ".join(f"SELECT oy AS y, hit, '{m}' AS metric, {e} AS value, weight FROM z" for m, e in metrics.items())
    )


@query("r03_jackknife", jack_sql(), "scored_grid")
def r03(spark, d):
    out = R.jackknife(R.cells(view(spark, d, "scored_grid")))
    return out.where(F.col("metric").isin("sens", "spec", "ppv", "npv", "j", "f1"))


@query("r03_jackknife_brier", f"{LEFT_OUT} SELECT oy AS y, op AS p, {r('sum(n * pow(p - y, 2)) / sum(n)')} AS brier, weight FROM l GROUP BY oy, op, weight", "scored_grid")
def r03b(spark, d):
    return R.jackknife_brier(R.cells(view(spark, d, "scored_grid")))


@query("r03_jackknife_auc", f"{LEFT_OUT}, w AS (SELECT a.oy, a.op, a.weight, sum(a.n * b.n * CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0.0 END) AS wins, sum(a.n * b.n) AS pairs FROM l a JOIN l b ON a.oy = b.oy AND a.op = b.op AND a.y = 1 AND b.y = 0 GROUP BY ALL) SELECT oy AS y, op AS p, {r('wins / pairs', 8)} AS auc, weight FROM w", "scored_grid")
def r03a(spark, d):
    return R.jackknife_auc(R.cells(view(spark, d, "scored_grid"))).withColumn("auc", S.half_even("auc", 8))


@query("r10_boot_roc", None)
def r10(spark, d):
    return roc.band(R.bootstrap_curves(view(spark, d, "scored_cont"), 20))


@query("r13_hash_split", f"SELECT id, {SPLIT} AS split FROM cohort", "cohort")
def r13(spark, d):
    return R.hash_split(view(spark, d, "cohort")).select("id", "split")


@query("r14_power", None)
def r14(spark, d):
    """Margins for further samples, at the sensitivity, specificity and prevalence that the table shows."""
    g = view(spark, d, "scored_grid")
    seen, share = P.panel(g, only=["sens", "spec"]).first(), T.prevalence(g).first()["prevalence"]
    return R.margins(R.power_simulation(spark, seen["sens"], seen["spec"], (share, share / 2)))


@query("s17_add_new_only", "SELECT id, CASE WHEN o % 4 = 0 THEN 'train' ELSE 'val' END AS split, CASE WHEN o % 4 = 0 THEN 2 ELSE 1 END AS batch FROM (SELECT id, CAST(split_part(id, '_', 2) AS BIGINT) AS o FROM cohort) WHERE o % 4 <> 0 OR o % 3 = 0", "cohort")
def s17(spark, d):
    c = view(spark, d, "cohort").select("id", F.element_at(F.split("id", "_"), 2).cast("long").alias("o"))
    old = c.where("o % 4 <> 0").select("id", F.lit("val").alias("split"), F.lit(1).alias("batch"))
    return C.add_new_only(old, c.select("id"), c.where("o % 4 <> 0 or o % 3 = 0").select("id")).select("id", "split", "batch")


PIX = "list_transform(embedding, lambda x: CAST(round_even((x::DOUBLE + 1) * 100, 0) AS INT))"


def pixels(spark: SparkSession, d: str) -> DataFrame:
    """Each embedding as an 8 x 8 image of whole numbers."""
    pix = F.transform("embedding", lambda x: F.rint((x.cast("double") + 1) * 100).cast("int"))
    return table(spark, d, "embeddings").select("vec_id", pix.alias("pix"))


@query("i01_rescale", f"SELECT vec_id, array_to_string(list_transform(pix, lambda x: CAST(floor(greatest(x, 0) / list_max(pix)::DOUBLE * 255) AS INT)), ',') AS pix FROM (SELECT vec_id, {PIX} AS pix FROM embeddings)")
def i01(spark, d):
    return pixels(spark, d).select("vec_id", F.concat_ws(",", I.rescale("pix").cast("array<string>")).alias("pix"))


@query("i02_brightness", f"SELECT vec_id, CAST(floor(list_avg(pix)) AS INT) AS mean, floor(list_avg(pix)) >= 100 AND floor(list_avg(pix)) < 215 AS ok FROM (SELECT vec_id, {PIX} AS pix FROM embeddings)")
def i02(spark, d):
    return pixels(spark, d).select("vec_id", I.mean_brightness("pix").alias("mean"), I.good_brightness("pix", 100, 215).alias("ok"))


@query("i03_trim_box", f"SELECT vec_id, min(CAST(floor(i / 8) AS INT)) AS top, min(i % 8) AS left_, max(CAST(floor(i / 8) AS INT)) + 1 AS bottom, max(i % 8) + 1 AS right_ FROM (SELECT vec_id, v, f, CAST(i AS INT) AS i FROM (SELECT vec_id, pix[1] AS f, unnest(pix) AS v, unnest(range(64)) AS i FROM (SELECT vec_id, {PIX} AS pix FROM embeddings))) WHERE v <> f GROUP BY vec_id")
def i03(spark, d):
    return pixels(spark, d).select("vec_id", I.trim_box("pix", 8).alias("b")).where("b is not null").select("vec_id", F.col("b.top").alias("top"), F.col("b.left").cast("int").alias("left_"), F.col("b.bottom").alias("bottom"), F.col("b.right").cast("int").alias("right_"))


@query("i04_invert", f"SELECT vec_id, array_to_string(list_transform(pix, lambda x: 255 - x), ',') AS pix FROM (SELECT vec_id, {PIX} AS pix FROM embeddings)")
def i04(spark, d):
    return pixels(spark, d).select("vec_id", F.concat_ws(",", I.invert("pix").cast("array<string>")).alias("pix"))


@query("i05_percentile_mask", f"SELECT vec_id, {r('list_sum(list_transform(pix, lambda x: CASE WHEN x > list_aggregate(pix, $$quantile_cont$$, 0.7) THEN x::DOUBLE / 255 ELSE 0 END))', 6)} AS kept FROM (SELECT vec_id, {PIX} AS pix FROM embeddings)")
def i05(spark, d):
    masked = I.percentile_mask("pix", "pix", 70)
    return pixels(spark, d).select("vec_id", S.half_even(F.aggregate(masked, F.lit(0.0), lambda a, x: a + x), 6).alias("kept"))


@query("i07_text_gate", "SELECT doc_id, len(list_filter(w, lambda x: length(x) > 12)) > 0 AS long_word, len(w) > 300 AS many_words FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)")
def i07(spark, d):
    w = F.split("text", " ")
    return table(spark, d, "documents").select("doc_id", I.has_long_word(w, 12).alias("long_word"), I.too_many_words(w, 300).alias("many_words"))


GRAY = f"""
SELECT vec_id, list_transform(range(21), lambda i: {r('0.2125 * pix[3 * i + 1] + 0.7154 * pix[3 * i + 2] + 0.0721 * pix[3 * i + 3]', 6)})::VARCHAR AS gray,
       list_transform(range(16), lambda i: pix[(i // 4) * 2 * 8 + (i % 4) * 2 + 1])::VARCHAR AS small
FROM (SELECT vec_id, {PIX} AS pix FROM embeddings)
"""


@query("i10_gray_resize", GRAY)
def i10(spark, d):
    """The first 63 values as 21 pixels of three colours, and the image at half its width."""
    p = pixels(spark, d)
    text = lambda c: F.concat(F.lit("["), F.array_join(c, ", "), F.lit("]"))
    gray = F.transform(I.to_gray(F.slice("pix", 1, 63)), lambda x: S.half_even(x, 6).cast("string"))
    return p.select("vec_id", text(gray).alias("gray"), text(F.transform(I.resize_nearest("pix", 8, 8, 4), lambda x: x.cast("string"))).alias("small"))