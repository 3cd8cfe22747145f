"""Round trips through the sources and sinks; importing this adds them to the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import cohort as C
from ..operators import resample as R
from ..sources import files
from ..sources.scratch import new_path
from .catalog import hashed, query
from .views import table, view

NATION = "n_nationkey int, n_name string, n_regionkey int"


@query("s01_s11_csv", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def s01(spark, d):
    path = new_path(spark, "csv")
    files.write_csv(table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), path)
    return files.read_labels(spark, path, NATION).drop("file_name")


@query("s02_latin1_csv", "SELECT p_partkey, concat(p_brand, ' é ñ ü') AS name FROM part")
def s02(spark, d):
    path = new_path(spark, "latin1")
    named = table(spark, d, "part").select("p_partkey", F.concat("p_brand", F.lit(" é ñ ü")).alias("name"))
    named.write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return files.read_labels(spark, path, "p_partkey long, name string", latin1=True).drop("file_name")


@query("s03_multi_file", "SELECT n_regionkey, count(*) AS n, 1::BIGINT AS files FROM nation GROUP BY n_regionkey")
def s03(spark, d):
    path = new_path(spark, "parts")
    table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").repartition(5, "n_regionkey").write.option("header", True).csv(path)
    got = files.read_labels(spark, path, NATION)
    return got.groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("file_name").alias("files"))


@query("s04_s19_listing", "SELECT count(DISTINCT c_mktsegment) AS files, true AS same_bytes FROM customer")
def s04(spark, d):
    """A file for each segment's customers, listed."""
    path = new_path(spark, "list")
    table(spark, d, "customer").repartition("c_mktsegment").write.partitionBy("c_mktsegment").parquet(path)
    listed = files.list_files(spark, path, True)
    whole = files.folder_size(spark, path)
    parquet = listed.where(F.col("file_name").endswith(".parquet")).agg(F.count(F.lit(1)).alias("files"))
    size = listed.agg(F.sum("length").alias("sum")).crossJoin(whole)  # one row on either side
    return parquet.crossJoin(size.select(((F.col("sum") > 0) & (F.col("sum") == F.col("bytes"))).alias("same_bytes")))


@query("s05_file_filter", "SELECT id FROM (SELECT concat('f', o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '_PR' ELSE '' END, CASE o_orderkey % 2 WHEN 0 THEN '.dcm' ELSE '.txt' END) AS id FROM orders) WHERE contains(id, 'dcm') AND NOT contains(id, '_PR')")
def s05(spark, d):
    k = F.col("o_orderkey")
    name = F.concat(F.lit("f"), k.cast("string"), F.when(k % 3 == 0, "_PR").otherwise(""), F.when(k % 2 == 0, ".dcm").otherwise(".txt"))
    return files.image_files(table(spark, d, "orders").select(name.alias("file_name"))).select(F.col("file_name").alias("id"))


@query("s12_append_or_create", "SELECT n_nationkey, n_regionkey FROM nation UNION ALL SELECT n_nationkey, NULL FROM nation")
def s12(spark, d):
    path, n = new_path(spark, "stats"), table(spark, d, "nation")
    for part in (n.select("n_nationkey", "n_regionkey"), n.select("n_nationkey")):
        files.append_stats(part, path)
    return files.read_stats(spark, path)


@query("s13_upsert_column", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey + 0.5::DOUBLE END AS prob FROM nation")
def s13(spark, d):
    n = table(spark, d, "nation").select("n_nationkey")
    new = n.where("n_nationkey % 2 = 0").select("n_nationkey", F.array(F.lit(0.0), F.col("n_nationkey") + F.lit(0.5)).alias("value"))
    return files.upsert_columns(n, new, "n_nationkey", "prob")


@query("s16_split_manifest", f"SELECT id, CASE WHEN {hashed('''concat('2022:', id)''')} < {int(0.7 * 2**32)} THEN 'train' ELSE 'val' END AS split FROM cohort", "cohort")
def s16(spark, d):
    path = new_path(spark, "manifest")
    files.write_split_manifest(R.hash_split(view(spark, d, "cohort").select("id")), path)
    return spark.read.parquet(path)


@query("s18_reuse", "SELECT r_regionkey, r_name FROM region")
def s18(spark, d):
    path = new_path(spark, "reuse")
    for _ in range(2):
        out = files.reuse_or_make(spark, path, lambda: table(spark, d, "region").select("r_regionkey", "r_name"))
    return out


@query("s20_valid_names", "SELECT page_id, regexp_matches(lower(concat(url, CASE WHEN page_id % 2 = 0 THEN '.PNG' ELSE '.gif' END)), '\\.(png|jpe?g)$') AS ok FROM pages")
def s20(spark, d):
    name = F.concat("url", F.when(F.col("page_id") % 2 == 0, ".PNG").otherwise(".gif"))
    return table(spark, d, "pages").select("page_id", files.valid_image_name(name).alias("ok"))


@query("j05_not_converted", "SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0")
def j05(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"))
    done = o.where("cast(id as long) % 3 = 0").select(F.concat(F.lit("new_"), F.col("id")).alias("id"))
    return files.not_converted(o, done, "new_").select(F.col("id").cast("long").alias("o_orderkey"))


@query("i08_header_flags", "SELECT o_orderkey, o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 3 <> 0 AS ok FROM orders")
def i08(spark, d):
    from ..operators.image import header_flags

    k = F.col("o_orderkey")
    flags = header_flags(F.when(k % 5 != 0, F.when(k % 7 == 0, "bad").otherwise("fine")), F.lit("M"), F.lit(True), k % 3 != 0, ["bad"])
    return table(spark, d, "orders").select("o_orderkey", flags["ok"].alias("ok"))


GATED = """
SELECT 'g' AS "group", concat('v', vec_id) AS file_name, 0 AS no_TS_ID, 0 AS unsupported_TS_ID, 0 AS missing_pixels,
       0 AS corrupt_pixels, 0 AS inverted_colors, 1 AS brightness_issues
FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(round_even((x::DOUBLE + 1) * 100, 0) AS INT)) AS pix FROM embeddings)
WHERE NOT (floor(list_avg(pix)) >= 50 AND floor(list_avg(pix)) < 101)
"""


@query("i09_gate_report", GATED)
def i09(spark, d):
    """The images that the gate turns away, appended to a report and read again."""
    from ..operators import image
    from .catalog_cohort import pixels

    shown = pixels(spark, d).select(F.lit("g").alias("grp"), F.concat(F.lit("v"), F.col("vec_id")).alias("file_name"), F.col("pix").alias("pixels"))
    _, errors = image.gate(shown, limits=(50, 101))
    path = new_path(spark, "bad_files")
    files.append_stats(errors, path)
    return spark.read.parquet(path)


KEPT = GATED.replace("SELECT 'g' AS \"group\", concat('v', vec_id) AS file_name, 0 AS no_TS_ID, 0 AS unsupported_TS_ID, 0 AS missing_pixels,\n       0 AS corrupt_pixels, 0 AS inverted_colors, 1 AS brightness_issues", "SELECT vec_id, list_sum(pix)::BIGINT AS total").replace("WHERE NOT", "WHERE")


@query("i09_gate_kept", KEPT)
def i09k(spark, d):
    from ..operators import image
    from .catalog_cohort import pixels

    kept, _ = image.gate(pixels(spark, d).withColumns({"grp": F.lit("g"), "file_name": F.lit("f"), "pixels": F.col("pix")}), limits=(50, 101))
    return kept.select("vec_id", F.aggregate("pixels", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


def linear_scorer():
    """Two scores from the mean and the first pixel: stands for a trained model."""
    import numpy as np

    return lambda x: 1 / (1 + np.exp(-np.stack([x.mean(axis=1) - 100, (x[:, 0] - 100) / 10], axis=1)))


SCORED = """
SELECT vec_id, round_even(1 / (1 + exp(-(list_sum(pix)::DOUBLE / 64 - 100))) * 1e6, 0) / 1e6 AS a_prob,
       round_even(1 / (1 + exp(-(pix[1] - 100) / 10.0::DOUBLE)) * 1e6, 0) / 1e6 AS b_prob
FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(round_even((x::DOUBLE + 1) * 100, 0) AS INT)) AS pix FROM embeddings)
"""


@query("x03_batch_scores", SCORED)
def x03(spark, d):
    """Images scored in batches; the scores go out as CSV and are read again."""
    from ..operators.scoring import score_batches
    from .catalog_cohort import pixels

    path = new_path(spark, "scores")
    scored = score_batches(pixels(spark, d).withColumn("pixels", F.col("pix")), linear_scorer, ["a", "b"])
    files.write_csv(scored.select("vec_id", "a_prob", "b_prob"), path)
    back = files.read_labels(spark, path, "vec_id long, a_prob double, b_prob double")
    return back.select("vec_id", *[(F.rint(F.col(c) * 1e6) / 1e6).alias(c) for c in ("a_prob", "b_prob")])


TURNED = """
SELECT vec_id, hit AS was_inverted, list_sum(list_transform(pix, lambda x: CASE WHEN hit THEN 255 - x ELSE x END))::BIGINT AS total
FROM (SELECT vec_id, pix, round_even(1 / (1 + exp(-(pix[1] - 100) / 10.0::DOUBLE)), 0) = 1 AS hit
      FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(round_even((x::DOUBLE + 1) * 100, 0) AS INT)) AS pix FROM embeddings))
"""


@query("x08_inverted_images", TURNED)
def x08(spark, d):
    from ..operators.scoring import score_batches, turn_inverted
    from .catalog_cohort import pixels

    scored = score_batches(pixels(spark, d).withColumn("pixels", F.col("pix")), linear_scorer, ["mean", "inverted"])
    out = turn_inverted(scored, "inverted_prob")
    return out.select("vec_id", "was_inverted", F.aggregate("pixels", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("p20_membership_flag", "SELECT o_orderkey, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AS known FROM orders")
def p20(spark, d):
    ids = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k"), F.lit(True).alias("hit")).distinct()
    return table(spark, d, "orders").join(ids, F.col("o_orderkey") == F.col("k"), "left").select("o_orderkey", F.coalesce("hit", F.lit(False)).alias("known"))


@query("p02_p03_p24_rename", "SELECT id, infiltrate AS infiltrate_prob FROM cohort", "cohort")
def p02(spark, d):
    c = view(spark, d, "cohort").select("id", F.col("infiltrate").alias("infil trate"), F.col("nodule").alias("DS_Other"))
    c = C.rename_first_wins(c, {"DS_Other": "infiltrate"})
    return c.select("id", *[F.col(x).alias(f"{x}_prob") for x in c.columns if x != "id"])


@query("p29_percent", "SELECT user_id, round_even(avg(value / 500) * 100 * 100, 0) / 100 AS pct FROM events GROUP BY user_id")
def p29(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(S.half_even(F.avg(F.col("value") / 500) * 100, 2).alias("pct"))
