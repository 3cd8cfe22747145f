"""SimHash, BPE, licences, personal data, toxicity: against brute force, and odd rows."""

import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest
import xxhash
from llm_cases import ODD
from pyspark.sql import functions as F

from cohortlens.llm import bpe, license_scan, pii, simhash, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def brute_print(t, k=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))] if w else []
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, links):
    label = dict(zip(ids, ids))
    while True:
        new = dict(label)
        for a, b in links:
            new[a] = new[b] = min(new[a], new[b])
        if new == label:
            return label
        label = new


def test_op7_against_brute_force(spark, texts):
    prints = {i: brute_print(t) for i, t in texts.items()}
    ids = sorted(texts)
    label = brute_components(ids, [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 4])
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op7_simhash(spark, SF).collect()}
    assert got == {i: (f"{prints[i]:016x}", label[i]) for i in ids}


def near_prints(n, seed=5):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)) for _ in range(n)], dtype=np.uint64)
    return np.unique(base[rng.integers(0, 40, n)] ^ flips)


@pytest.mark.parametrize("at_once", [1 << 21, 3000])
def test_trees_join_every_pair(monkeypatch, at_once):
    monkeypatch.setattr(simhash, "PAIRS_AT_ONCE", at_once)
    values = near_prints(400)
    n = len(values)
    a, b = simhash._search(values, np.zeros(n, int), np.full(n, n), 4)
    want = [(i, j) for i in range(n) for j in range(i + 1, n) if int(values[i] ^ values[j]).bit_count() <= 4]
    got = list(zip(a.tolist(), b.tolist()))
    assert {(min(x), max(x)) for x in got} <= set(want) and len(got) < n
    assert brute_components(range(n), got) == brute_components(range(n), want)


@pytest.mark.parametrize("radius", [0, 3, 4, 7, 12])
def test_shards_miss_no_link(radius):
    rng = random.Random(radius)
    for k in range(1, 5):
        masks = simhash.shard_masks(radius, k)
        for _ in range(300):
            x = sum(1 << b for b in rng.sample(range(64), radius))
            assert any(not x & m for m in masks)
    chosen = [simhash.bands_agreed(4, n) for n in (0, 10**5, 10**7, 10**9, 10**11)]
    assert chosen == sorted(chosen) and chosen[0] == 1 and chosen[-1] > 2


@pytest.mark.parametrize(("radius", "k", "most"), [(4, 1, 1 << 17), (4, 2, 20), (4, 3, 5), (6, 1, 20), (6, 2, 50)])
def test_links_of_split_shards(spark, monkeypatch, radius, k, most):
    monkeypatch.setattr(simhash, "bands_agreed", lambda radius, rows: k)
    monkeypatch.setattr(simhash, "SHARD_MOST", most)
    values = near_prints(300).view(np.int64).tolist()
    want = [(x, y) for x in values for y in values if x < y and ((x ^ y) & (2**64 - 1)).bit_count() <= radius]
    got = [tuple(r) for r in simhash.near_links(spark.createDataFrame([(v,) for v in values], "fp long"), radius).collect()]
    assert {(min(x), max(x)) for x in got} <= set(want)
    assert brute_components(values, got) == brute_components(values, want)


def test_split_rows_still_meet(spark):
    held = spark.createDataFrame([(i, 1) for i in range(200)] + [(i, 2) for i in range(9)], "k long, shard long")
    cells = {}
    for r in simhash.split_large(held, "k", 40).collect():
        cells.setdefault(r["shard"], []).append(r["k"])
    assert sorted(cells[2]) == list(range(9)) and 1 not in cells
    met = {(x, y) for c, members in cells.items() if c != 2 for x in members for y in members if x < y}
    assert len(met) == 199 * 100 and max(map(len, cells.values())) < 80


@pytest.mark.parametrize("most", [1 << 13, 2])
def test_similar_links_and_keep_one(spark, docs, monkeypatch, most):
    monkeypatch.setattr(simhash, "SETS_MOST", most)
    words = [f"w{i}" for i in range(200)]
    near = words[:]
    near[100] = "other"
    far = words[:100] + [f"v{i}" for i in range(100)]
    made = docs([(5, " ".join(words), "a"), (3, " ".join(near), "a"), (9, " ".join(far), "b"), (9, "same id, another text here now", "b"), (7, " ".join(words), "b"), (7, " ".join(words), "b")])
    got = sorted((r["doc_id"], r["text"][:9]) for r in simhash.keep_one(made).collect())
    assert got == [(3, "w0 w1 w2 "), (9, "same id, "), (9, "w0 w1 w2 ")]


def test_simhash_odd_rows(spark, docs):
    out = simhash.near_duplicates(docs(ODD)).collect()
    assert len(out) == len(ODD)
    group = {r["id"]: r["component_id"] for r in out}
    assert group[1] == group[2] == 1 and group[3] == group[4] == group[5] == 3
    assert simhash.near_duplicates(docs([])).count() == 0 and simhash.keep_one(docs([])).count() == 0
    kept = [r["doc_id"] for r in simhash.keep_one(docs(ODD).withColumn("component_id", F.lit("x"))).collect()]
    assert sorted(kept, key=str) == sorted([1, 3, None, 6, 7], key=str)


@pytest.mark.parametrize("known", [256 << 20, 1 << 12])
def test_op4_round_trip(spark, texts, monkeypatch, known):
    monkeypatch.setattr(bpe, "KNOWN_BYTES", known)
    monkeypatch.setattr(bpe, "WORDS", 400_000 if known > 1 << 12 else 500)
    t = bpe.tokenizer(bpe.vocabulary_path())
    for r in bpe.op4_bpe(spark, SF).collect():
        ids = t.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_odd_rows(spark, docs):
    t = bpe.tokenizer(bpe.vocabulary_path())
    made = [*ODD, (8, "a <|endoftext|>b ́c <|start\tof", "a")]
    out = bpe.encode_documents(docs(made).withColumn("ids", F.lit(1)))
    got = sorted((str(r["doc_id"]), bytes(r["ids"]), r["decoded"]) for r in out.collect())
    want = []
    for i, text, _ in made:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.append((str(i), struct.pack(f"<{len(ids)}I", *ids), t.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want)
    again = {str(r["doc_id"]): r["decoded"] for r in bpe.decode_ids(out).collect()}
    assert again == {i: d for i, _, d in got}
    assert bpe.encode_documents(docs([])).count() == 0


@pytest.mark.parametrize("n,m", [(1, 0), (5, 9), (300, 2000), (70000, 0), (20000, 90000)])
def test_places_come_back(n, m):
    rng = np.random.default_rng(n)
    z = np.concatenate([np.arange(n), rng.zipf(1.3, m) % n])
    _, first, inverse = np.unique(z, return_index=True, return_inverse=True)
    flat = np.argsort(np.argsort(first))[inverse].astype(np.uint32)
    blob, order = bpe._pack_places(flat, n)
    assert (order[bpe._unpack_places(blob)] == flat).all()


def test_op9_against_brute_force(spark, texts):
    phrases = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
    for r in license_scan.op9_license_scan(spark, SF).collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(texts[r["doc_id"]]))
        at = sorted((i, x) for p, x in phrases for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None)
        assert r["base_labels"] == ",".join(sorted({x for _, x in at})) and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1


def test_license_templates_and_odd_rows(spark, docs):
    made = [(i, f"some words before. {notice} and after", "a") for i, (_, notice, _) in enumerate(license_scan.TEMPLATES)]
    got = {r["doc_id"]: r["labels"] for r in license_scan.scan(docs(made)).collect()}
    assert all(label in got[i] for i, (label, _, _) in enumerate(license_scan.TEMPLATES))
    plain = license_scan.scan(docs([(1, "this is the license of software and of copies", "a"), (2, "cc by mail", "a")])).collect()
    assert all(r["labels"] == [] for r in plain)
    assert license_scan.scan(docs(ODD)).count() == len(ODD) and license_scan.scan(docs([])).count() == 0


def brute_pii(x):
    luhn = lambda s: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10 == 0
    digits = lambda s: re.sub("[^0-9]", "", s)
    rules = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True), (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(digits(s)) <= 19 and luhn(digits(s))), (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(digits(s)) <= 15),
    ]
    return sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(rules) for m in re.finditer(p, x) if ok(m[0]))


TRICKY = ["a@b@c.de", "x.y@mail.example.com.", "@no.one", "a@b.c@d.e", "1.2.3.4.5.6.7.8", "256.1.1.1 0255.01.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (714) 555-9345", "+12", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "v1.2.3.4@x.io 4111111111111111+4915112345678", "éa@b.co ١٢٣٤@b.co"]


def test_base_spans():
    for t in TRICKY:
        assert pii.base_spans(t) == brute_pii(t), t


def test_op10_against_brute_force(spark, texts):
    for r in pii.op10_pii(spark, SF).collect():
        base = brute_pii(texts[r["doc_id"]])
        line = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert set(filter(None, line.split(","))) <= set(r["spans"].split(","))
        assert [r[f"n_{k}"] for k in pii.KINDS[:4]] == [sum(b[1] == k for b in base) for k in range(4)]


def test_boosted_candidates_hold_out():
    trees, limits = pii.model()
    rows = pii.examples(1500, 123)
    p = trees.predict(np.array([pii.features(t, c) for t, c, _ in rows]))
    assert np.mean((p > 0.5) == np.array([y for *_, y in rows])) > 0.97
    (base, added), (_, none) = pii.chosen(['mail a (at) b.org, token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"', "see page 12 of version 3.4.5, order 1234 5678 9012"], trees, limits)
    assert {pii.KINDS[k] for _, k, _ in added} == {"email", "secret"} and none == []


def test_redaction_and_odd_rows(spark, docs):
    made = docs([*ODD, (20, "call +1 (714) 555-9345 or a.b@mail.example.com now", "a")])
    out = {r["doc_id"]: r for r in pii.redact(made.withColumn("spans", F.lit(1))).collect()}
    assert out[20]["text"] == "call <PHONE> or <EMAIL> now" and out[20]["n_chars"] == 27
    assert out[3]["text"] is None and out[6]["text"] == ODD[7][1]
    assert pii.find(docs(ODD)).count() == len(ODD) and pii.redact(docs([])).count() == 0


def test_grammar_scores_clauses():
    r = toxicity.Reader({})
    names = dict(zip(toxicity.FEATURES, range(20)))
    f = lambda t: toxicity.clause_counts(t, r)
    plain = f("He is an idiot.")
    assert plain[names["aimed"]] > 0 and plain[names["insult"]] == 0
    assert f("such an idiot came")[names["insult"]] > 0
    assert f("he is not an idiot")[names["denied"]] > 0 and f("he is not an idiot")[names["worst"]] == 0
    assert f('she said "idiot" again')[names["quoted"]] > 0
    assert f("I will kill you")[names["threat"]] + f("you, I will kill")[names["aimed"]] > 0
    assert f("I kill time")[names["threat"]] == 0
    assert f("not now. an idiot")[names["denied"]] == 0  # scopes end with the clause
    assert f("a calm sentence") == [0.0] * len(toxicity.FEATURES)


def test_composed_machine_is_the_four_in_turn():
    """Each machine reads the whole output of the one before it."""
    rng = random.Random(2)
    for _ in range(3000):
        line = [rng.randrange(toxicity.INPUTS) for _ in range(rng.randint(1, 25))]
        want = line
        for make in toxicity.MACHINES.values():
            machine, state, out = make(), 0, []
            for symbol in want:
                state, symbol = machine.step(state, symbol)
                out.append(symbol)
            want = out
        state, got = 0, []
        for symbol in line:
            got.append(toxicity.OUT[state][symbol])
            state = toxicity.NEXT[state][symbol]
        assert got == want


@pytest.mark.parametrize(
    "text, kind",
    [
        ('she said: "you are an idiot"', "quoted"), ('she said: "No. You are an idiot." Then', "quoted"), ("he said that you are an idiot", "quoted"), ("they called her an idiot", "quoted"),
        ("you won't be an idiot", "denied"), ("he ain't an idiot", "denied"), ("il n'est pas stupid", "denied"), ("er ist kein clown", "denied"), ("I will not kill you", "denied"),
        ("idiot, you", "aimed"), ("what an idiot he is", "aimed"), ("I'll hurt them", "aimed"), ("ich werde dich schlagen", "aimed"), ("an idiot came", "insult"), ("said he. an idiot came", "insult"),
    ],
)
def test_grammar_sets_clauses_apart(text, kind):
    got = dict(zip(toxicity.FEATURES, toxicity.clause_counts(text, toxicity.Reader({}))))
    assert [k for k in ("insult", "threat", "aimed", "denied", "quoted") if got[k] > 0] == [kind]


def test_held_out_recall(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(r["predicted"], labels[r["doc_id"]]) for r in toxicity.op1_toxicity(spark, sf).where("held_out").collect() if r["doc_id"] in labels]
    toxic, clean = [p for p, y in held if y == 1], [p for p, y in held if y == 0]
    assert len(toxic) > 80 and sum(toxic) / len(toxic) > 0.8 and sum(clean) / len(clean) < 0.01


def test_columns_of_the_user_stay(spark, docs):
    mine = docs([(1, "plain words", "a"), (2, None, "a")]).withColumns({"score": F.lit("mine"), "x": F.lit(7), "toxic_score": F.lit("own"), "_text": F.lit("t")})
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    got = toxicity.reject_toxic(mine, labels)
    assert got.columns == mine.columns and {(r["score"], r["x"], r["toxic_score"], r["_text"]) for r in got.collect()} == {("mine", 7, "own", "t")}


def test_copies_of_a_labelled_row_train_once(spark, docs):
    rows = [(1, "you idiot", "a")] * 300 + [(2, "plain words", "a")]
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    assert toxicity.train(docs(rows), labels) == toxicity.train(docs(rows[-2:]), labels)


def test_op1_learns(spark):
    sf = "/root/testdata/sf0.01"
    out = {r["doc_id"]: r for r in toxicity.op1_toxicity(spark, sf).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(out) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in out.items())
    for held in (True, False):
        hits = [out[i]["predicted"] == y for i, y in labels.items() if out[i]["held_out"] == held]
        assert sum(hits) / len(hits) > 0.93


def test_toxicity_odd_rows(spark, docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    few = spark.createDataFrame([(1, 1), (1, None), (2, 0), (None, 1)], "doc_id long, toxic int")
    for labels in (none, few):
        assert toxicity.score_documents(docs(ODD).withColumn("score", F.lit("x")), labels).count() == len(ODD)
        assert toxicity.reject_toxic(docs([]), labels).count() == 0


def jaccard_words(rng, n, change):
    """Two texts of n words that differ in `change` words, each in five shingles of its own."""
    base = [f"w{rng.integers(10**9)}" for _ in range(n)]
    other = base[:]
    for i in 6 + rng.choice(n // 6 - 3, change, replace=False) * 6:
        other[i] = f"v{rng.integers(10**9)}"
    return " ".join(base), " ".join(other)


def test_candidates_are_checked_before_the_forest():
    base = np.arange(100, dtype=np.uint32)
    # b and c are alike, a is like neither but nearer to both than nothing: every pair must be looked at
    a, b, c = base, np.arange(20, 120, dtype=np.uint32), np.arange(22, 122, dtype=np.uint32)
    for order in ([a, b, c], [b, a, c], [c, b, a]):
        got = simhash.confirmed(order, 0.8)
        assert [{len(np.intersect1d(order[i], order[j]))} for i, j in got] == [{98}]
    rng = np.random.default_rng(4)
    sets = [np.unique(np.concatenate([base[rng.random(100) < 0.93], rng.integers(1000, 9999, rng.integers(0, 9)).astype(np.uint32)])) for _ in range(60)]
    pairs = [(i, j) for i in range(60) for j in range(i) if (n := len(np.intersect1d(sets[i], sets[j]))) >= 0.85 * (len(sets[i]) + len(sets[j]) - n)]
    assert brute_components(range(60), pairs) == brute_components(range(60), simhash.confirmed(sets, 0.85))


def test_pairs_near_the_similarity_are_found(spark, docs):
    rng, rows = np.random.default_rng(9), []
    for i in range(300):  # 4 of 184 words replaced change 20 of 180 shingles: a Jaccard of 0.8; 5: 0.756
        one, two = jaccard_words(rng, 184, 4 if i < 200 else 5)
        rows += [(2 * i, one, "a"), (2 * i + 1, two, "a")]
    sets = {i: simhash.fingerprint(t, 5, 42, True)[1] for i, t, _ in rows}
    wanted = {2 * i for i in range(300) if (n := len(np.intersect1d(sets[2 * i], sets[2 * i + 1]))) >= 0.8 * (len(sets[2 * i]) + len(sets[2 * i + 1]) - n)}
    assert wanted == set(range(0, 400, 2))
    kept = {r["doc_id"] for r in simhash.keep_one(docs(rows)).collect()}
    assert kept >= {i + 1 for i in range(400, 600, 2)}  # no pair below goes
    assert sum(i + 1 in kept for i in wanted) <= 4  # 0.5 of 200 expected
