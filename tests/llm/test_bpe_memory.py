"""What a task of the tokenizer's first step holds at a time."""

import tracemalloc
import weakref

import numpy as np
import pyarrow as pa

from cohortlens.llm import bpe


class Caught:
    """Stands in for a table and keeps the function that Spark would run."""

    def mapInArrow(self, run, schema):
        self.run = run


class Task:
    @staticmethod
    def get():
        return Task

    @staticmethod
    def partitionId():
        return 0


def test_a_batch_is_let_go_before_the_next_is_read(spark, monkeypatch):
    caught, held = Caught(), []
    monkeypatch.setattr(bpe, "shipped", lambda df: caught)
    monkeypatch.setattr(bpe, "TaskContext", Task)
    bpe.chunks(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), 4, "doc_id", "text")

    def source():
        for k in range(3):
            held.append(sum(ref() is not None for ref in alive))
            batch = pa.RecordBatch.from_arrays([pa.array([k]), pa.array(["a b a"])], ["id", "text"])
            alive.append(weakref.ref(batch))
            yield batch
            del batch

    alive = []
    out = list(caught.run(source()))
    assert [r for b in out for r in b.column("ids").to_pylist()] == [[0, 1, 2]]
    assert held == [0, 0, 0]


def test_a_chunk_is_put_together_without_an_object_for_each_word():
    words, each = 200_000, 3  # distinct words, all of them once, and ids of a word
    ids = np.arange(words * each, dtype="<u4") % 50
    places, order = bpe._pack_places(np.arange(words, dtype=np.uint32), words)
    assert order.tolist() == list(range(words))
    owners = np.zeros(words, np.uint32)
    coded = [{"part": 0, "lengths": bpe._planes(np.full(words, each, np.uint32)), "codes": bpe._planes(ids)}]
    row = {"ids": [7, None, 9], "counts": [150_000, 0, 50_000], "places": places, "owners": bpe._planes(owners), "coded": coded}
    pieces = np.array([f" {k}" for k in range(50)], dtype=object)
    tracemalloc.start()
    try:
        batches = list(bpe._coded_texts(row, pieces))
        out = [r for b in batches for r in zip(*(b.column(c) for c in ("doc_id", "n_tokens", "ids", "decoded")))]
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    cut = 150_000 * each
    want = [(7, ids[:cut]), (None, ids[:0]), (9, ids[cut:])]
    assert [tuple(x.as_py() for x in r) for r in out] == [(i, len(x), x.tobytes(), " ".join(str(k) for k in x)) for i, x in want]
    assert most < 230 * words  # 286 with an object for each word and its text
    assert [b.num_rows for b in batches] == [1, 2]  # the first text alone has more than 2 MB of ids and text
