"""Cases in which unrelated texts, copies in millions or numbers without a check digit once did harm."""

import random
import re
import time
from collections import defaultdict

import pytest

from cohortlens.llm import mixing, pii, simhash


def repeated(rng, own):
    """A text of which one repeated shingle has most positions, with words of its own."""
    return " ".join(["x"] * 200 + [f"{own}{rng.randint(0, 10**9)}" for _ in range(90)])


def test_equal_fingerprints_do_not_make_texts_alike(spark, docs):
    rng = random.Random(1)
    rows = [(i, repeated(rng, f"w{i}"), "a") for i in range(6)]
    near = rows[0][1].replace("x x x x", "x x x y", 1)
    rows += [(10, rows[1][1], "b"), (11, near, "b"), (12, rows[0][1] + " more", "b")]
    prints = simhash.fingerprints(docs(rows), "doc_id", "text", 5, 42, True)
    assert prints.select("fp").distinct().count() < len(rows) - 3
    kept = sorted(r["doc_id"] for r in simhash.keep_one(docs(rows)).collect())
    assert kept == [0, 1, 2, 3, 4, 5]


def test_near_fingerprints_are_candidates_without_a_band(spark, docs, monkeypatch):
    monkeypatch.setattr(simhash, "bands", lambda shingles: [])
    words = [f"w{i}" for i in range(600)]
    unlike = ["x"] * 900  # its one shingle has most positions in both of the last two, whose fingerprints agree
    rows = [(4, " ".join(words), "a"), (2, " ".join([*words[:300], "other", *words[301:]]), "a"), (5, " ".join(f"v{i}" for i in range(600)), "b")]
    rows += [(6, " ".join(unlike + [f"p{i}" for i in range(200)]), "b"), (7, " ".join(unlike + [f"q{i}" for i in range(200)]), "b")]
    fp = {i: simhash.fingerprint(t, 5) for i, t, _ in rows}
    assert 0 < (fp[4] ^ fp[2]).bit_count() <= 4 and (fp[6] ^ fp[7]).bit_count() <= 4
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs(rows)).collect()) == [2, 5, 6, 7]


def test_names_that_the_stage_uses_itself(spark, docs):
    from pyspark.sql import functions as F

    rows = [(1, "a b c d e f g", "a"), (2, "a b c d e f g", "a"), (3, "another text", "b")]
    table = docs(rows).withColumns({"_dup_id": F.lit(1), "_DUP_KEY": F.lit("k"), "_dup_text": F.lit(2.0)})
    out = simhash.keep_one(table)
    assert out.columns == table.columns and sorted(r["doc_id"] for r in out.collect()) == [1, 3]


def by_rounds(groups, quota, most, rounds):
    """Words sent after each round of repetitions, every round run by itself: the least cost, as costs rise by rounds."""
    patterns, sources = sorted({g[0] for g in groups}), list(quota)
    once = {p: max(d for q, _, _, d in groups if q == p) for p in patterns}
    flow = mixing.Flow(2 + len(patterns) + len(sources))
    into = {p: flow.arc(0, 2 + i, 0) for i, p in enumerate(patterns)}
    for p, x, w, _ in groups:
        flow.arc(2 + patterns.index(p), 2 + len(patterns) + sources.index(x), most * w)
    for i, x in enumerate(sources):
        flow.arc(2 + len(patterns) + i, 1, quota[x])
    sent, out = 0, []
    for _ in range(rounds):
        for p in patterns:
            flow.cap[into[p]] += once[p]
        sent += flow.run(0, 1)
        out.append(sent)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_rounds_passed_over_cost_nothing(seed):
    rng = random.Random(seed)
    for _ in range(60):
        sources, groups = rng.randint(1, 4), []
        for p in range(rng.randint(1, 5)):
            d = rng.randint(1, 6)
            groups += [(p, f"s{x}", d * rng.randint(1, rng.choice([1, 3, 30])), d) for x in rng.sample(range(sources), rng.randint(1, sources))]
        held = defaultdict(int)
        for _, x, w, _ in groups:
            held[x] += w
        quota = {x: rng.randint(0, 3 * h) if rng.random() < 0.8 else 3 * h for x, h in held.items()}
        sent, once, used = mixing.route(groups, quota), {}, defaultdict(int)
        for p, x, w, d in groups:
            assert 0 <= sent[p, x] <= 3 * w
            once[p] = max(once.get(p, 0), d)
            used[p] += sent[p, x]
        # in every round as much goes out as can; that is the least convex cost
        assert [sum(min(used[p], k * once[p]) for p in once) for k in range(1, 101)] == by_rounds(groups, quota, 3, 100)


def test_a_million_copies_beside_thousands_of_patterns():
    rng = random.Random(1)
    groups = [(10 + p, f"s{x}", rng.randint(500, 5000), rng.randint(200, 500)) for p in range(4096) for x in rng.sample(range(20), rng.randint(2, 4))]
    groups += [(1, "s0", 3_000_000, 3), (1, "s1", 3000, 3)]
    held = defaultdict(int)
    for _, x, w, _ in groups:
        held[x] += w
    total = sum(held.values())
    quota = {x: min(3 * h, total * w // 53) for (x, h), w in zip(sorted(held.items()), [5, 2, 1] * 7)}
    began = time.time()
    sent = mixing.route(groups, quota)
    assert sum(sent.values()) == sum(quota.values()) and time.time() - began < 60


def test_no_card_without_its_check_digit(spark):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    cards = [(t[s:e]) for t in texts for s, k, e in pii.candidates(t or "") if pii.KINDS[k] == "card"]
    assert all(pii.luhn(re.sub("[^0-9]", "", c)) for c in cards)
    rng = random.Random(2)
    for text, (s, k, e), _ in pii.examples(1500, 3):
        if pii.KINDS[k] == "card":
            assert pii.luhn(re.sub("[^0-9]", "", text[s:e]))
    wrong = ["card 4111 1111 1111 1112", "visa: 5500-0000-0000-0005", "pay 4111111111111112 now"]
    right = ["card 4111 1111 1111 1111", "visa: 5500.0000.0000.0004"]
    for texts, wanted in ((wrong, False), (right, True)):
        for (base, added), text in zip(pii.chosen(texts, *pii.model()), texts, strict=True):
            assert any(pii.KINDS[k] == "card" for _, k, _ in base + added) == wanted, (text, rng)
