"""Encoding with byte spans against the sentencepiece library, with the model as it is and with other character maps."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from llm_cases import ODD
from pyspark.sql import functions as F

from cohortlens.llm import piece_spans as ps

LETTERS = [*"ab  ▁\t\n\x0b\x00", "ｱ", "ﬁ", "é", "é", "́", "日", "😀", "㍿", "¨", "​", "ﾞ", "ｶ", "ﷺ", "　", "가", "ᄀ", "ᅡ", "½", "<s>", "<0x41>", "the", "ing"]


@pytest.fixture(scope="module")
def raw():
    with open(ps.vocabulary_path(), "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def compiled():
    """The library's own map for NFKC and some more."""
    whole = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()
    return next(dict(ps.fields(v))[2] for k, v in ps.fields(whole) if k == 3)


def made(count, seed, longest=14):
    rng = random.Random(seed)
    return ["".join(rng.choices(LETTERS, k=rng.randint(0, longest))) for _ in range(count)]


def held(texts, m):
    """Ids, spans and normalised texts against the library, which gives offsets in bytes."""
    for text, (ids, starts, ends) in zip(texts, ps.encode_batch(texts, m), strict=True):
        assert ps.normalise(text, m)[0] == m.library.normalize(text), text
        assert ids.tolist() == m.library.encode(text), text
        pieces = m.library.encode(text, return_type="proto").pieces
        assert list(zip(starts.tolist(), ends.tolist())) == [(p.begin, p.end) for p in pieces], text


def test_the_given_model(raw):
    m = ps.Model(raw)
    assert m.cuts and not m.rules
    held(made(3000, 1), m)
    held(made(30, 2, 3000), m)


@pytest.mark.parametrize("squeeze", [0, 1])
@pytest.mark.parametrize("prefix", [0, 1])
@pytest.mark.parametrize("escape", [0, 1])
def test_other_maps_and_flags(raw, compiled, squeeze, prefix, escape):
    spec = b"".join(ps.field(i, v) for i, v in ((2, compiled), (3, prefix), (4, squeeze), (5, escape)))
    held(made(1000, 3), ps.Model(raw + ps.field(3, spec)))


def test_rules_are_those_of_the_map(compiled):
    rules = ps.rules_of(compiled)
    n = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=False, escape_whitespaces=False, remove_extra_whitespaces=False)
    some = random.Random(4).sample(sorted(rules), 3000)
    assert len(rules) > 200_000 and all(rules[k] == n.normalize(k) for k in some)
    assert ps.rules_of(b"") == {}


def test_pieces_of_the_user_and_signs_behind_words(raw):
    mine = ps.field(1, ps.field(1, "<fim>".encode()) + ps.field(3, ps.USER_DEFINED)) + ps.field(1, ps.field(1, "é x".encode()) + ps.field(3, ps.USER_DEFINED))
    m = ps.Model(raw + mine)
    assert m.kept == {"<fim>", "é x"} and m.cuts
    rng = random.Random(5)
    texts = ["".join(rng.choices(["<fim>", "é x", "<", "fim", ">", " ", "é", "x", "word"], k=rng.randint(0, 12))) for _ in range(500)]
    for text, (ids, _, _) in zip(texts, ps.encode_batch(texts, m), strict=True):
        assert m.library.decode(ids.tolist()) == m.library.decode(m.library.encode(text))
        assert [ids.tolist().count(i) for i in (32000,)] == [m.library.encode(text).count(32000)], text
    crossing = ps.Model(raw + ps.field(1, ps.field(1, "s▁the".encode())))
    assert not crossing.cuts
    held([*made(200, 6), "ones the thes the"], crossing)


def test_letters_unknown_without_bytes(raw):
    """Without pieces for bytes, letters out of the vocabulary come out as one unknown piece."""
    kinds = [ps.field(1, v) if dict(ps.fields(v)).get(3, 1) != ps.BYTE else ps.field(1, v + ps.field(3, 5)) for k, v in ps.fields(raw) if k == 1]
    rest = b"".join(ps.field(k, v + ps.field(35, 0) if k == 2 else v) for k, v in ps.fields(raw) if k != 1)
    held([*made(500, 7), "ﷺﷺ a ﷺ㍿b"], ps.Model(b"".join(kinds) + rest))


def test_the_whole_job(spark, docs):
    rows = [*ODD, (30, "no end " * 100_000, "a"), (31, "x" * 300_000, "a"), (32, "日本語" * 50_000, "a"), (33, "   ", "a"), (34, "\x00 é ▁▁", "a")]
    table = docs(rows).withColumn("ids", F.lit(1)).withColumn("decoded", F.lit(1))
    library = sentencepiece.SentencePieceProcessor(model_file=ps.vocabulary_path())
    got = ps.encode_documents(table)
    want = [(i, library.encode(t or ""), library.decode(library.encode(t or ""))) for i, t, _ in rows]
    assert sorted(((r["doc_id"], r["ids"], r["decoded"]) for r in got.collect()), key=repr) == sorted(want, key=repr)
    text = {i: (t or "").encode() for i, t, _ in rows if i is not None and i != 2}
    for r in got.collect():
        if r["doc_id"] in text:
            joined = b"".join(text[r["doc_id"]][a:b] for a, b in zip(r["starts"], r["ends"]))
            assert joined == text[r["doc_id"]] and all(a <= b for a, b in zip(r["starts"], r["ends"]))
    back = ps.decode_ids(got.select("doc_id", "ids"))
    assert sorted(map(repr, back.collect())) == sorted(map(repr, got.select("doc_id", "decoded").collect()))
    assert ps.encode_documents(docs([])).count() == 0


def test_batches_do_not_matter(spark, docs, monkeypatch, raw):
    texts = made(300, 8, 60)
    m = ps.Model(raw)
    whole = [x[0].tolist() for x in ps.encode_batch(texts, m)]
    monkeypatch.setattr(ps, "KNOWN_WORDS", 10)
    assert whole == [x[0].tolist() for k in range(0, 300, 7) for x in ps.encode_batch(texts[k : k + 7], m)]
    assert list(ps.encode_batch([], m)) == [] and [x.tolist() for x in next(ps.encode_batch([""], m))] == [[], [], []]


def test_bytes_that_are_not_utf8(spark):
    df = spark.sql("SELECT 1L AS doc_id, CAST(X'61FF20C3' AS STRING) AS text")
    [row] = ps.encode_documents(df).collect()
    assert row["decoded"] == "a� �"


def test_query_against_the_library(spark):
    sf = "/root/testdata/sf0.001"
    library = sentencepiece.SentencePieceProcessor(model_file=ps.vocabulary_path())
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = library.encode(r["text"] or "")
        want.append((r["doc_id"], len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids))))
    assert sorted(map(tuple, ps.op12_piece_spans(spark, sf).collect())) == sorted(want)


def test_piece_lengths_of_bytes(raw):
    m = ps.Model(raw)
    ids = np.array(m.library.encode("a😀é㍿ﷺ"))
    assert ps.piece_lengths(ids, m).sum() == len("▁a😀é㍿ﷺ")
