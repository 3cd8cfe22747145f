"""How draws are dealt to tasks, and the keys that they are made of."""

import hashlib

import numpy as np
import pytest

from cohortlens.functions.numbered import numbered_keys
from cohortlens.operators import resample as R


def dealt(spark, monkeypatch, rows, reps=2):
    """The runs that bootstrap_weights deals out for so many rows."""
    caught, drawn = [], R._drawn
    monkeypatch.setattr(R, "_drawn", lambda runs, *rest: caught.append(runs) or drawn(runs, *rest))
    c = spark.createDataFrame([(0, 0.2, rows // 2), (1, 0.7, rows - rows // 2)], "y int, p double, n long")
    R.bootstrap_weights(c, reps, 7)
    return caught[0]


def test_a_task_has_draws_enough_to_be_worth_its_start(spark, monkeypatch):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        assert dealt(spark, monkeypatch, 100_000).rdd.getNumPartitions() == 4  # one for each core
        many = dealt(spark, monkeypatch, 12_000_000)  # 24 million draws
        assert many.rdd.getNumPartitions() == 8
        assert many.selectExpr("sum(last - first)").first()[0] == 24_000_000
        assert dealt(spark, monkeypatch, 300_000_000).rdd.getNumPartitions() == 50  # and no more than a shuffle has
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


@pytest.mark.parametrize("prefix", ["1:", "abc:", "10221983:3:1:", "10221983:13:p:", "x" * 48 + ":"])
@pytest.mark.parametrize("first", [0, 9_990, 99_985, 1_234_567, 9_999_985, 4_300_000_000])
def test_keys_are_those_of_md5(prefix, first):
    want = [int.from_bytes(hashlib.md5(f"{prefix}{k}".encode()).digest()[:4], "big") for k in range(first, first + 30)]
    assert np.concatenate(list(numbered_keys(prefix, first, first + 30))).tolist() == want


def test_arrays_of_keys_are_not_written_again():
    kept = list(numbered_keys("10221983:3:1:", 100_000, 250_000))
    assert [k.tolist() for k in kept] == [k.copy().tolist() for k in numbered_keys("10221983:3:1:", 100_000, 250_000)]
