"""Cohort building, tables, image arrays, files and the streaming extension."""

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import cohort as C
from cohortlens.operators import image as I
from cohortlens.operators import resample as R
from cohortlens.operators import tables as T
from cohortlens.sources import files
from cohortlens.streaming.incremental import append_new


def test_rename_and_dedupe(spark, rows):
    df = spark.createDataFrame([(1, 2, 3)], "`a b` int, x int, y int")
    assert C.rename_first_wins(df, {"x": "t", "y": "t"}).columns == ["ab", "t"]
    a, b = (spark.createDataFrame(r, "id int, v string") for r in ([(1, "a"), (2, "a")], [(2, "b"), (3, "b")]))
    both = C.stack_sources([(a, "im_"), (b, "im_")], ["id", "v", "extra"])
    assert rows(C.dedupe_first(both, "id", ["src_ord"]).select("id", "v", "extra")) == [("im_1", "a", None), ("im_2", "a", None), ("im_3", "b", None)]


def test_files_and_records(spark, rows):
    rec, f = (spark.createDataFrame([(x,) for x in xs], "id string") for xs in ("ab", "bbc"))
    kept, orphans = C.match_files(rec, f)
    assert rows(kept) == [("b",)] and rows(orphans) == [("c",)]


def test_lookup(spark, rows):
    df = spark.createDataFrame([("x",), ("nan",), (None,)], "k string")
    t = spark.createDataFrame([("x", "R")], "name string, region string")
    assert sorted(map(str, (r["region"] for r in C.lookup(df, t, "k", "name", "region").collect()))) == ["NA", "NA", "R"]
    with pytest.raises(Exception, match="no entry for y"):
        C.lookup(spark.createDataFrame([("y",)], "k string"), t, "k", "name", "region").collect()


def test_describe(spark):
    df = spark.createDataFrame([("a", 1, "t"), ("a", None, "v"), (None, 0, "t")], "g string, o int, split string")
    got = {(r["variable"], r["level"], r["split"]): (r["n"], r["pct"]) for r in T.describe(df, {"g": ["a", "b"], "o": ["1"]}).collect()}
    assert got["g", "a", "All"] == (2, 100.0) and got["g", "b", "All"] == (0, 0.0)
    assert got["o", "1", "All"] == (1, 33.0) and got["o", "1", "v"] == (0, 0.0)


def test_p_values(spark):
    df = spark.createDataFrame([(0.01,), (0.04,), (0.2,)], "p double")
    r = df.agg(T.harmonic_p().alias("h"), T.fisher_statistic().alias("f")).first()
    assert round(r["h"], 7) == 0.0230771 and round(r["f"], 7) == 18.8669418
    with pytest.raises(Exception, match="no row reaches"):
        df.agg(T.best_x("p", "p", 2.0)).collect()


def test_splits(spark):
    df = spark.range(200).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 2 == 0, "e").alias("s"))
    got = {r["split"]: r["n"] for r in R.fixed_split(df, F.col("s"), 40).groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert got == {"val": 20, "test": 20, "train": 160}
    with pytest.raises(ValueError):
        R.fixed_split(df, F.col("s"), 101)
    y = df.withColumn("y", (F.col("id").cast("int") % 2))
    got = R.resample_prevalence(y, 0.1)
    assert got.where("y = 1").count() == 20 and got.where("y = 0").count() == 100


def test_images(spark):
    one = lambda *c: spark.range(1).select(*c).first()
    a = F.array(*map(F.lit, [5, 5, 5, 5, 7, 5, 5, 5, 9]))
    assert tuple(one(I.trim_box(a, 3).alias("b"))["b"]) == (1, 1, 3, 3)
    assert one(I.crop(a, 3, I.trim_box(a, 3)))[0] == [7, 5, 5, 9]
    flat = F.array(F.lit(1), F.lit(1))
    assert one(I.trim_box(flat, 1))[0] is None and one(I.crop(flat, 1, I.trim_box(flat, 1)))[0] == [1, 1]
    assert one(I.rescale(F.array(F.lit(0), F.lit(-5), F.lit(10))))[0] == [0, 0, 255]
    assert one(I.rescale(F.array(F.lit(0))))[0] is None
    assert one(I.invert(a))[0][0] == 250 and one(I.good_brightness(a))[0] is False
    assert one(I.percentile_of(F.array(*map(F.lit, [1, 2, 3, 4])), 50))[0] == 2.5
    assert len(one(I.to_gray(F.array(*map(F.lit, [1, 2, 3, 4, 5, 6]))))[0]) == 2
    assert one(I.resize_nearest(F.array(*map(F.lit, [1, 2, 3, 4])), 2, 2, 1))[0] == [1]
    assert max(one(I.overlay(F.array(F.lit(0.1), F.lit(0.5)), F.array(F.lit(0.0), F.lit(1.0))))[0]) == 1.0
    f = one(I.header_flags(F.lit(None).cast("string"), F.lit("M"), F.lit(True), F.lit(True), ["u"]))[0]
    assert f["no_ts"] == 1 and not f["ok"]
    df = spark.createDataFrame([("g", "f1", [100, 100]), ("g", "f2", [1, 1])], "grp string, file_name string, pixels array<int>")
    ok, errors = I.gate(df)
    assert ok.count() == 1 and errors.first()["file_name"] == "f2" and len(errors.columns) == 8


def test_sources(spark, rows, tmp_path):
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv" / "a.csv").write_bytes("id,name\n1,Jos\xe9\n".encode("latin-1"))
    got = files.read_labels(spark, str(tmp_path / "csv"), "id int, name string", latin1=True)
    assert rows(got) == [(1, "José", "a.csv")]
    img = tmp_path / "img"
    (img / "sub").mkdir(parents=True)
    for n in ("x.dcm", "y_PR.dcm", "z.txt", "sub/w.png"):
        (img / n).write_bytes(b"12345")
    listing = files.list_files(spark, str(img))
    assert rows(files.image_files(listing).select("id")) == [("x",)]
    assert files.folder_size(spark, str(img)).first()["bytes"] == 20
    done = spark.createDataFrame([("new_x",)], "id string")
    assert files.not_converted(files.image_files(listing), done, "new_").count() == 0
    (img / "p.png").write_bytes(bytes.fromhex("89504E470D0A1A0A00"))
    ok = spark.read.format("binaryFile").load(str(img)).select(files.valid_image_content().alias("ok"), files.valid_image_name("path").alias("n"))
    assert ok.where("ok and n").count() == 1
    stats = spark.createDataFrame([(1, 0.5)], "a int, b double")
    for part in (stats, stats.drop("b")):
        files.append_stats(part, str(tmp_path / "stats"))
    assert rows(files.read_stats(spark, str(tmp_path / "stats"))) == [(1, 0.5), (1, None)]
    made = []
    for _ in range(2):
        files.reuse_or_make(spark, str(tmp_path / "kept"), lambda: made.append(1) or stats)
    assert len(made) == 1
    preds = spark.createDataFrame([(1, [0.1, 0.7])], "a int, value array<double>")
    assert files.upsert_columns(stats, preds, "a", "prob").first()["prob"] == 0.7
    files.write_csv(stats, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 1
    files.write_split_manifest(stats.withColumn("split", F.lit("val")), str(tmp_path / "man"))
    assert spark.read.parquet(str(tmp_path / "man")).first()["split"] == "val"


def test_add_new_only_and_stream(spark, rows, tmp_path):
    old = spark.createDataFrame([("a", "val", 1)], "id string, split string, batch int")
    new, f = (spark.createDataFrame([(x,) for x in xs], "id string") for xs in ("abc", "ab"))
    assert rows(C.add_new_only(old, new, f).select("id", "split", "batch")) == [("a", "val", 1), ("b", "train", 2)]
    src = str(tmp_path / "in")
    for part in ("ab", "bc"):
        spark.createDataFrame([(x,) for x in part], "id string").coalesce(1).write.mode("append").parquet(src)
        q = append_new(spark.readStream.schema("id string").parquet(src), str(tmp_path / "table"), str(tmp_path / "state"))
        q.awaitTermination(120)
    assert rows(spark.read.parquet(str(tmp_path / "table")).select("id")) == [("a",), ("b",), ("c",)]


def test_columns_of_the_users_keep_their_values(spark):
    """Names that the library uses on the way may be the user's."""
    names = ["_n", "_key", "_range", "_before", "rank", "_rank", "_id", "_split", "_stratum", "_k", "_b", "_new"]
    df = spark.range(60).select("id", (F.col("id") % 2).alias("y"), *[F.concat(F.lit(n), F.col("id")).alias(n) for n in names])

    def whole(out):
        got = out.collect()
        assert got and all(r[n] == f"{n}{r['id']}" for r in got for n in names)
        return got

    assert len(whole(R.resample_prevalence(df, 0.25))) == 30 + 15
    assert len(whole(R.smallest_keys(df, 7, 1, rank="place"))) == 7
    split = whole(R.fixed_split(df, F.col("y"), 10))
    assert sum(r["split"] != "train" for r in split) == 20 and len(split) == 60
    assert len(whole(C.dedupe_first(df.union(df), "id", ["_n"]))) == 60
    assert len(whole(C.lookup(df, spark.createDataFrame([("a", "b")], "name string, code string"), "_n", "name", "code", strict=False))) == 60
    assert len(whole(files.upsert_columns(df, df.select("id", F.lit(1.0).alias("value")), "id", "prob"))) == 60
    assert len(whole(C.add_new_only(df.withColumn("batch", F.lit(1)).where("id < 50"), df, df))) == 60


def test_first_row_of_a_frequent_key(spark, rows):
    df = spark.range(1000).select(F.when(F.col("id") % 3 > 0, 1).when(F.col("id") < 10, None).otherwise(F.col("id")).alias("k"), F.when(F.col("id") != 500, 1000 - F.col("id")).alias("o"), "id")
    out = C.dedupe_first(df, "k", ["o"])
    assert out.columns == df.columns
    got = {r["k"]: r["id"] for r in out.collect()}
    assert got[1] == 500 and got[None] == 9 and len(got) == 332  # a null comes first
