"""Fill-in-the-middle against a row-by-row version, and exact round trips."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from llm_cases import ODD
from oracle import duck, same
from pyspark.sql import functions as F

from cohortlens.llm import fill_in_middle as fim

UNITS = {"line": r"[^\n]*\n|[^\n]+", "word": r"[^\t-\r ]+[\t-\r ]*|[\t-\r ]+", "char": r"(?s:.)"}


def plainly(doc_id, text, unit="line", sentinels=fim.SENTINELS, fim_percent=100, spm_percent=50, seed=7):
    """The transformation of one text, written plainly."""
    text = text or ""
    units = re.findall(UNITS[unit], text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    p, s, m = sentinels
    if not text or any(x in text for x in sentinels) or h[2] % 100 >= fim_percent:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < spm_percent:
        return doc_id, n, "spm", len(prefix), len(middle), s + suffix + p + prefix + m + middle
    return doc_id, n, "psm", len(prefix), len(middle), p + prefix + s + suffix + m + middle


def made(count, seed):
    rng = random.Random(seed)
    letters = ["a", "b", " ", "\n", "\n", "é", "日", "😀", "\t", "<", "P", "S", "M", ">", "\r", "\x0b"]
    return ["".join(rng.choices(letters, k=rng.choice([0, 1, 2, 5, 30, 200]))) for _ in range(count)]


def same_rows(got, want):
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("unit", sorted(UNITS))
def test_random_texts(spark, docs, unit):
    rows = [(i, t, "a") for i, t in enumerate(made(400, 3))]
    out = fim.fill_in_middle(docs(rows), unit=unit, fim_percent=80, spm_percent=30)
    same_rows(out.collect(), [plainly(i, t, unit, fim_percent=80, spm_percent=30) for i, t, _ in rows])
    back = {r["doc_id"]: r["restored"] for r in fim.restore(out).collect()}
    assert back == {i: t for i, t, _ in rows}


def test_odd_rows(spark, docs):
    more = [(20, "ends with a sign <", "a"), (21, "<S", "a"), (22, "P>x\n<", "a"), (23, "has <M> inside", "a"), (24, "\n\n\n", "a"), (25, "x" * 3_000_000 + "\ny", "a"), (26, "a\n" * 1_000_000, "a")]
    rows = [*ODD, *more]
    table = docs(rows).withColumn("output", F.lit(1)).withColumn("form", F.lit("x")).withColumn("h1", F.lit(2))
    out = fim.fill_in_middle(table)
    same_rows(out.collect(), [plainly(i, t) for i, t, _ in rows])
    same_rows(fim.restore(out).select("doc_id", "restored").collect(), [(i, t or "") for i, t, _ in rows])
    same_rows(fim.fill_in_middle(docs(rows).repartition(5)).collect(), out.collect())
    assert fim.restore(fim.fill_in_middle(docs([]))).count() == 0


def test_other_sentinels_and_kernel_slices(spark, docs, monkeypatch):
    marks = ("<|prefix|>", "<|suffix|>", "<|mid|>")
    rows = [(i, t, "a") for i, t in enumerate(made(200, 9))]
    same_rows(fim.fill_in_middle(docs(rows), sentinels=marks).collect(), [plainly(i, t, sentinels=marks) for i, t, _ in rows])
    for bad in (("<P>", "<P>", "<M>"), ("<P>", "", "<M>"), ("ab", "bc", "xy"), ("<P>", "x<P>y", "<M>"), ("aa", "b", "c")):
        with pytest.raises(ValueError):
            fim.check_sentinels(bad)
    monkeypatch.setattr(fim, "SLICE_BYTES", 7)
    batch = pa.RecordBatch.from_arrays([pa.array(["abc", "", "defg", "h", "i" * 20, "", "j"])], ["text"])
    assert [x.column("text").to_pylist() for x in fim.slices(batch, "text")] == [["abc", "", "defg"], ["h"], ["i" * 20], ["", "j"]]


def test_restoring_needs_whole_outputs(spark):
    rows = [("<P>a<S>c<M>b", "psm", "abc"), ("<S>c<P>a<M>b", "spm", "abc"), ("<S>c<P>a<M>b", "psm", None), ("<P>a<S>c", "psm", None), ("as it is <M>", "plain", "as it is <M>"), (None, "psm", None), ("x", None, None), ("<P><S><M>", "psm", "")]
    df = spark.createDataFrame(rows, "output string, form string, restored string")
    assert [r["_restored"] for r in fim.restore(df).collect()] == [r[2] for r in rows]


def test_a_sliced_column():
    column = pa.array(["xx", "ab\nc", "", "d"]).slice(1)
    data, offsets = fim.utf8(column)
    assert data.tobytes() == b"ab\ncd" and offsets.tolist() == [0, 4, 4, 5]
    _, _, n = fim.count_units(data, offsets, "line")
    assert n.tolist() == [2, 0, 1] and fim.strings(data, offsets, np.array([True, False, True])).to_pylist() == ["ab\nc", None, "d"]


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    same(fim.op11_fill_in_middle(spark, sf), duck(sf), fim.ORACLE_SQL["op11_fill_in_middle"])
