"""Cases that a bound or a hint once cut off."""

import random

from cohortlens.llm import license_scan, mixing, pii, simhash

NOTICE = {label: notice for label, notice, _ in license_scan.TEMPLATES}


def test_two_notices_in_one_text(spark, docs):
    plain = [(i, f"plain words number {i} here", "a") for i in range(200)]
    bsd = [(1000 + i, f"header {i}. {license_scan.TEMPLATES[8][1]}", "a") for i in range(15)]  # under a tenth, but commoner than the grant
    both = [(5000, f"{license_scan.TEMPLATES[1][1]}. And then. {license_scan.TEMPLATES[8][1]}", "a")]
    got = {r["doc_id"]: r["labels"] for r in license_scan.scan(docs(plain + bsd + both)).collect()}
    assert got[5000] == ["bsd", "mit"] and all(got[1000 + i] == ["bsd"] for i in range(15)) and all(not got[i] for i in range(200))


def test_notices_far_apart_in_a_long_text():
    fill = [b"plain", b"words", b"of", b"the", b"library"] * 1000
    words = [w for _, notice, _ in license_scan.PARSED for w in (*notice, *fill)]
    labels, best = license_scan.match_templates(words, license_scan.build_index(1000, {}))
    assert labels == {label for label, _, _ in license_scan.PARSED} and best > 1 - 1e-9


def test_a_notice_in_a_third_of_all_texts(spark, docs):
    for n in (90, 300):
        made = [(i, f"text {i}. " + [NOTICE["bsd"], "Licensed under CC BY-NC 4.0.", "nothing of the kind"][i % 3], "a") for i in range(n)]
        got = {r["doc_id"]: r["labels"] for r in license_scan.scan(docs(made)).collect()}
        assert got == {i: [["bsd"], ["cc-by-nc"], []][i % 3] for i in range(n)}


def test_generators_need_no_sign_their_matches_lack():
    for text, kind, span in [("password: S3cr3tPass9", "secret", "S3cr3tPass9"), ("token 'ab12cd34ef'", "secret", "ab12cd34ef"), ("john AT example DOT com", "email", "john AT example DOT com"), ("john (AT) example.com", "email", "john (AT) example.com")]:
        for t in (text, text + " and x = y, at a dot b"):
            assert (t.index(span), pii.KINDS.index(kind), t.index(span) + len(span)) in pii.candidates(t), t
    [(base, added)] = pii.chosen(["my password: S3cr3tPass9"], *pii.model())
    assert not base and added == [(13, pii.KINDS.index("secret"), 24)]


def test_generators_do_not_depend_on_the_rest_of_the_text():
    rng = random.Random(1)
    for text, span, _ in pii.examples(300, rng.randint(0, 99)):
        assert span in pii.candidates(text + " = @ : at  dot ") and span in pii.candidates(text)


def test_small_patterns_keep_their_repetition_cost(spark, docs, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_PATTERNS", 1)
    seen = []
    monkeypatch.setattr(mixing, "route", lambda groups, *a, real=mixing.route: seen.extend(groups) or real(groups, *a))
    rows = [(i, f"own text of row number {i}", "abc"[i % 3]) for i in range(60)]
    rows += [(100 + 10 * i + j, f"shared text {i} in big pattern", s) for i in range(6) for j, s in enumerate("ab")]
    rows += [(200 + 10 * i + j, f"shared text {i} small", s) for i in range(3) for j, s in enumerate("ac")]
    rows += [(300 + i, "copies of one text", "b") for i in range(50)]
    assert len({r["doc_id"] for r in mixing.mix(docs(rows)).collect()}) == len(rows)
    own = {x: (w, once) for (kind, _), x, w, once in seen if kind == "s"}
    assert own == {"a": (120, 120), "b": (120 + 200, 120 + 4), "c": (120, 120)}
    shared = sorted((x, w, once) for (kind, _), x, w, once in seen if kind == "p")
    assert shared == [("a", 12, 12), ("a", 36, 36), ("b", 36, 36), ("c", 12, 12)]


def test_one_row_of_a_group_without_ids_stays(spark, docs):
    words = [f"w{i}" for i in range(200)]
    near, with_id = [*words[:100], "other", *words[101:]], [f"v{i}" for i in range(200)]
    rows = [(None, " ".join(words), "a"), (None, " ".join(words), "b"), (None, " ".join(near), "a"), (None, "a text of its own", "a"), (None, " ".join(with_id), "a"), (4, " ".join(with_id), "a"), (6, " ".join(with_id), "b")]
    kept = sorted((str(r["doc_id"]), r["text"][:2]) for r in simhash.keep_one(docs(rows)).collect())
    assert kept == [("4", "v0"), ("None", "a "), ("None", "w0")]
