"""Kept runs, joins of sorted buckets, and files in batches."""

import io
from collections import defaultdict
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import bucketed
from cohortlens.operators.resample import Intervals
from cohortlens.sources import batches, files, results


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


# ---- runs


def made(spark, stat, n=3):
    cis = spark.createDataFrame([("auc", stat, stat - 0.1, stat + 0.1), ("mcc", None, None, None)], "metric string, stat double, lower double, upper double")
    reps = spark.createDataFrame([(i, "auc", stat + i / 100) for i in range(n)], "rep long, metric string, value double")
    return Intervals(cis, reps)


def test_a_rerun_replaces_its_run_only(spark, tmp_path):
    path = str(tmp_path / "runs")
    results.save_run(made(spark, 0.5), path, "007", "a")
    results.save_run(made(spark, 0.6), path, "7", "b", site="s")
    for stat in (0.7, 0.8):
        results.save_run(made(spark, stat, 5), path, "007", "a", year=2024)
    got = results.read_intervals(spark, path).orderBy("run", "metric").collect()
    assert [(r["run"], r["model"], r["metric"], r["stat"], r["site"], r["year"]) for r in got] == [
        ("007", "a", "auc", 0.8, None, 2024),
        ("007", "a", "mcc", None, None, 2024),
        ("7", "b", "auc", 0.6, "s", None),
        ("7", "b", "mcc", None, "s", None),
    ]
    assert results.read_run(spark, path, "007").scores.count() == 5
    assert results.read_run(spark, path, "7").scores.count() == 3
    assert results.read_intervals(spark, path, ["b"]).count() == 2
    text = results.interval_table(results.read_intervals(spark, path), ["auc", "mcc"]).orderBy("run").collect()
    assert [(r["auc"], r["mcc"]) for r in text] == [("0.80 (0.70, 0.90)", None), ("0.60 (0.50, 0.70)", None)]


def test_only_the_run_asked_for_is_read(spark, tmp_path):
    path = str(tmp_path / "runs")
    for run in ("a", "b"):
        results.save_run(made(spark, 0.5), path, run, "m")
    text = plan(results.read_intervals(spark, path, runs=["a"]))
    assert "PartitionFilters" in text and "xa" in text.split("PartitionFilters")[1].splitlines()[0]


def test_runs_that_cannot_be_kept(spark, tmp_path):
    path = str(tmp_path / "runs")
    results.save_run(made(spark, 0.5), path, "a", "m")
    with pytest.raises(ValueError):
        results.save_run(made(spark, 0.5), path, "../a", "m")
    with pytest.raises(ValueError):
        results.save_run(made(spark, 0.5), path, "b", "m", Stat=1)
    none = made(spark, 0.5)
    none.cis = none.cis.where("false")
    with pytest.raises(ValueError):
        results.save_run(none, path, "a", "m")
    with pytest.raises(KeyError):
        results.read_run(spark, path, "b")
    assert results.read_intervals(spark, path).count() == 2


# ---- joins


def test_joins_of_a_layout_have_no_exchange(spark, rows):
    left = spark.range(1000).select((F.col("id") % 300).alias("k"), F.col("id").alias("a"))
    right = spark.range(400).select(F.col("id").alias("other"), (F.col("id") * 2).alias("b"))
    pair = bucketed.lay_out(left, right, "k", "other", 8)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for df in (pair.join(), bucketed.Pair(pair.left.where("a > 5"), pair.right, pair.key, pair.piece).join()):
            text = plan(df)
            assert "SortMergeJoin" in text and "Exchange" not in text
        assert rows(pair.join()) == rows(left.join(right.withColumnRenamed("other", "k"), "k"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert [r["k"] for r in pair.join(ordered=True).collect()] == sorted(r["k"] for r in left.collect())


@pytest.mark.parametrize("hot_left,hot_right", [(True, False), (False, True), (True, True)])
def test_frequent_keys_are_dealt_in_pieces(spark, rows, hot_left, hot_right):
    def side(n, hot, name):
        key = F.when((F.col("id") % 2 == 0) & F.lit(hot), 7).when(F.col("id") % 31 == 0, None).otherwise(F.col("id") % 50)
        return spark.range(n).select(key.cast("long").alias("k"), F.col("id").alias(name), F.lit("x").alias(f"_piece{name}"))

    left, right = side(600, hot_left, "a"), side(400, hot_right, "b")
    pair = bucketed.lay_out(left, right, "k", buckets=8)
    assert rows(pair.join()) == rows(left.join(right, "k"))
    if hot_left:
        most = max(r["count"] for r in pair.left.groupBy("k", pair.piece).count().collect())
        assert most < 150  # of 300 rows with the key


def test_buckets_grow_with_the_tables(spark, rows, monkeypatch):
    monkeypatch.setattr(bucketed, "ROWS_MOST", 100)
    left = spark.range(1500).select((F.col("id") % 300).alias("k"), F.col("id").alias("a"))
    right = spark.range(300).select(F.col("id").alias("k"), (F.col("id") * 2).alias("b"))
    # a coalesce to one task would also count all keys in that task
    monkeypatch.setattr(type(left), "coalesce", lambda *_: pytest.fail("one task would do all the work"))
    pair = bucketed.lay_out(left, right, "k", buckets=2)
    monkeypatch.undo()
    assert rows(pair.join()) == rows(left.join(right, "k"))
    for df in (pair.left, pair.right):
        files_ = [r["count"] for r in df.groupBy(F.input_file_name()).count().collect()]
        assert len(files_) == 16 and max(files_) < 200  # of 1500 and 300 rows


def test_layouts_of_odd_tables(spark, rows):
    t = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "k long, _piece string")
    o = spark.createDataFrame([(1, 2.0), (1, 2.0), (None, 1.0)], "k long, v double")
    assert len(rows(bucketed.lay_out(t, o, "k", buckets=2).join())) == 4  # repeated rows stay repeated, nulls join nothing
    assert rows(bucketed.lay_out(t.where("false"), o, "k", buckets=2).join()) == []
    with pytest.raises(TypeError):
        bucketed.lay_out(t, o.withColumn("k", F.col("k").cast("string")), "k")
    with pytest.raises(ValueError):
        bucketed.lay_out(t, o.withColumn("_piece", F.lit(1)), "k")


# ---- files


@pytest.fixture
def folder(tmp_path):
    sizes = {f"f{i} é.png": (i * 37) % 400 + (5000 if i % 29 == 3 else 0) for i in range(1, 120)}
    (tmp_path / "img").mkdir()
    for n, k in sizes.items():
        (tmp_path / "img" / n).write_bytes(n.encode()[:2] * (k // 2) + b"z" * (k % 2))
    return str(tmp_path / "img"), {n: k for n, k in sizes.items() if k}


def test_batches_hold_bounded_bytes_and_every_file(spark, folder):
    path, sizes = folder
    labels = spark.createDataFrame([(n, i, "extra") for i, n in enumerate(sizes)] + [("gone.png", 1, "x"), (None, 2, "x")], "file string, y int, _order string")
    rows = batches.batched(batches.matched(labels, files.list_files(spark, path)), 1000, 3)
    seen, bytes_of, members = {}, defaultdict(int), defaultdict(int)
    for r in batches.with_content(rows, 2).collect():
        assert len(r["content"]) == r["length"] == sizes[r["file"]]
        seen[r["file"]] = r["_order"]
        bytes_of[r["shard"], r["batch"]] += r["length"]
        members[r["shard"], r["batch"]] += 1
    assert seen == dict.fromkeys(sizes, "extra")
    assert all(b <= 1000 or members[k] == 1 for k, b in bytes_of.items())
    assert len(bytes_of) <= 3 + 2 * sum(min(k, 1000) for k in sizes.values()) / 500  # batches are not nearly empty


def test_a_function_sees_whole_batches(spark, folder):
    import pyarrow as pa

    path, sizes = folder
    labels = spark.createDataFrame([(n,) for n in sizes], "file string")
    rows = batches.batched(batches.matched(labels, files.list_files(spark, path)), 1000, 3)

    def measure(t):
        assert len(set(zip(t.column("shard").to_pylist(), t.column("batch").to_pylist()))) == 1
        return pa.table({"files": pa.array([t.num_rows], pa.int64()), "bytes": pa.array([sum(len(x) for x in t.column("content").to_pylist())], pa.int64())})

    chunk = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)  # batches do not follow Arrow's
    try:
        got = batches.map_batches(rows, measure, "files long, bytes long", 2).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", chunk)
    assert len(got) == rows.select("shard", "batch").distinct().count()
    assert sum(r["files"] for r in got) == len(sizes) and sum(r["bytes"] for r in got) == sum(sizes.values())


def test_batches_do_not_depend_on_partitions(spark, folder, rows):
    path, sizes = folder
    labels = spark.createDataFrame([(n, i) for n in sizes for i in (0, 1, 1)], "file string, y int")  # a file may have many rows
    found = batches.matched(labels, files.list_files(spark, path))
    got = rows(batches.batched(found, 900, 4, "s"))
    assert got == rows(batches.batched(found.repartition(7), 900, 4, "s")) and len(got) == 3 * len(sizes)
    by_name = batches.batched(found.where("y = 0"), 900, 1, shuffle=False).where("length <= 450").orderBy("file").collect()
    assert [r["batch"] for r in by_name] == sorted(r["batch"] for r in by_name)


def test_batches_of_nothing_and_of_clashing_columns(spark, folder):
    path, _ = folder
    listing = files.list_files(spark, path)
    none = spark.createDataFrame([], "file string")
    assert batches.with_content(batches.batched(batches.matched(none, listing)), 2).count() == 0
    with pytest.raises(ValueError):
        batches.matched(spark.createDataFrame([("a", 1)], "file string, Length int"), listing)
    with pytest.raises(ValueError):
        batches.batched(batches.matched(none, listing), 1)


def test_content_is_read_only_for_labelled_files(spark, folder):
    path, sizes = folder
    labels = spark.createDataFrame([(n,) for n in list(sizes)[:5]], "file string")
    found = batches.matched(labels, files.list_files(spark, path))
    assert "content" not in plan(found).split("ReadSchema")[1].splitlines()[0]
    assert batches.with_content(batches.batched(found), 2).count() == 5


def test_classes_of_folders(spark, tmp_path):
    for label in ("cat", "ant", "bee"):
        (tmp_path / "d" / label).mkdir(parents=True)
        for i in range(2):
            (tmp_path / "d" / label / f"{i}.png").write_bytes(b"x")
    got = batches.labelled_folders(spark, str(tmp_path / "d"))
    assert sorted((r["label"], r["class"], r["file_name"]) for r in got.collect()) == [(n, k, f"{i}.png") for k, n in enumerate(("ant", "bee", "cat")) for i in range(2)]
    with pytest.raises(ValueError):
        batches.labelled_folders(spark, str(tmp_path / "d"), 2)
