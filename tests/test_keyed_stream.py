"""Keys in the state store: each row once, state that is let go, batches that are run again."""

import datetime as dt
import os
import shutil

from cohortlens.streaming import keyed

KIND = "id long, ts timestamp, v string"


def put(spark, folder, rows):
    """One file of rows at the folder's end."""
    path = os.path.join(folder, f"part{len(os.listdir(folder)):03d}")
    spark.createDataFrame([(i, None if t is None else dt.datetime(2024, 1, 1) + dt.timedelta(hours=t), v) for i, t, v in rows], KIND).coalesce(1).write.parquet(path)


def run(spark, tmp_path, within="10 hours"):
    query = keyed.append_once(keyed.read_files(spark, str(tmp_path / "in"), KIND), str(tmp_path / "out"), str(tmp_path / "check"), within=within)
    query.awaitTermination()
    assert query.exception() is None
    return query


def found(spark, tmp_path):
    return sorted(((r["id"], r["v"], r["split"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()), key=repr)


def test_each_key_once_over_runs(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put(spark, tmp_path / "in", [(1, 0, "a"), (2, 1, "b"), (2, 1, "b")])
    put(spark, tmp_path / "in", [(1, 2, "again"), (3, 2, "c")])
    run(spark, tmp_path)
    assert found(spark, tmp_path) == [(1, "a", "train"), (2, "b", "train"), (3, "c", "train")]
    put(spark, tmp_path / "in", [(3, 3, "again"), (4, 3, "d"), (None, 3, "n"), (None, 3, "n")])
    run(spark, tmp_path)
    all_of = [(1, "a", "train"), (2, "b", "train"), (3, "c", "train"), (4, "d", "train"), (None, "n", "train")]
    assert found(spark, tmp_path) == all_of  # a null key is a key
    run(spark, tmp_path)
    assert found(spark, tmp_path) == all_of


def test_state_is_let_go_and_late_rows_dropped(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put(spark, tmp_path / "in", [(i, 0, "old") for i in range(50)])
    put(spark, tmp_path / "in", [(100, 100, "new")])
    put(spark, tmp_path / "in", [(101, 101, "new")])
    put(spark, tmp_path / "in", [(102, 102, "new"), (200, 5, "late")])
    query = run(spark, tmp_path)
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(held) >= 50 and held[-1] <= 3
    assert {r[0] for r in found(spark, tmp_path)} == {*range(50), 100, 101, 102}


def test_a_batch_run_again_replaces_its_rows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put(spark, tmp_path / "in", [(1, 0, "a"), (2, 0, "b")])
    run(spark, tmp_path)
    for name in os.listdir(tmp_path / "check" / "commits"):  # as if the batch had been written but not noted
        if name.strip(".").startswith("0"):
            os.remove(tmp_path / "check" / "commits" / name)
    run(spark, tmp_path)
    assert found(spark, tmp_path) == [(1, "a", "train"), (2, "b", "train")]
    shutil.rmtree(tmp_path / "check")
