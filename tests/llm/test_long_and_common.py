"""Long inputs take time in line with their length, and common notices are found like rare ones."""

import random
import re
import time

import pytest

from cohortlens.llm import html_text, license_scan, pii

FIVE = ["mit", "bsd", "isc", "mpl", "unlicense"]
NOTICE = {label: notice for label, notice, _ in license_scan.TEMPLATES}


@pytest.mark.parametrize("n", [50, 101, 5000])
@pytest.mark.parametrize("share", [0.01, 0.3, 1.0])
def test_notices_are_found_however_common_they_are(spark, docs, n, share):
    k = max(1, round(n * share))
    rows = [(i, f"text number {i} of the library. {NOTICE['mit'] if i < k else 'plain words'}", "a") for i in range(n)]
    got = {r["doc_id"]: r["labels"] for r in license_scan.scan(docs(rows).repartition(4)).collect()}
    assert got == {i: ["mit"] if i < k else [] for i in range(n)}


@pytest.mark.parametrize("n", [1, 400])
def test_five_notices_in_one_text(spark, docs, n):
    rows = [(i, f"the {i}. " + " Words between them. ".join(NOTICE[x] for x in FIVE), "a") for i in range(n)]
    assert all(r["labels"] == sorted(FIVE) for r in license_scan.scan(docs(rows)).collect())


def heaviest(notice, words, index):
    """The heaviest common subsequence, written plainly."""
    table = [[0.0] * (len(words) + 1) for _ in range(len(notice) + 1)]
    for i, w in enumerate(notice):
        for j, x in enumerate(words):
            table[i + 1][j + 1] = table[i][j] + index.weight[w] if w == x else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_alignment_against_brute_force():
    rng = random.Random(5)
    for _ in range(150):
        t = rng.randrange(len(license_scan.PARSED))
        notice = license_scan.PARSED[t][1][:40]
        words = [w for w in notice if rng.random() > 0.2 for w in ([w] if rng.random() > 0.2 else [w, rng.choice(notice)])]
        index = license_scan.build_index(999, {w: rng.choice([0, 1, 40, 999]) for w in license_scan.VOCABULARY})
        assert abs(license_scan._rows(notice, words, index)[-1] - heaviest(notice, words, index)) < 1e-9
        weight, start, end = license_scan.aligned(words, t, index)
        whole = license_scan.PARSED[t][1]
        assert abs(weight - heaviest(whole, words, index)) < 1e-9 and abs(heaviest(whole, words[start:end], index) - weight) < 1e-9


def test_no_place_in_line_is_passed_over():
    """The best share is at least that of every template at every single offset, and a lone notice gets its label."""
    rng = random.Random(5)
    for _ in range(60):
        words = []
        for _ in range(rng.randint(1, 6)):
            notice = rng.choice(license_scan.PARSED)[1]
            lo = rng.randint(0, len(notice) // 3)
            words += [w if rng.random() > 0.1 else b"other" for w in notice[lo : rng.randint(lo + 2, len(notice)) if rng.random() < 0.4 else len(notice)]]
            words += rng.choices([b"the", b"software", b"plain", b"license", b"by"], k=rng.randint(0, 9))
        index = license_scan.build_index(999, {w: rng.choice([0, 1, 40, 500, 999]) for w in license_scan.VOCABULARY})
        best = 0.0
        for t, (_, notice, _) in enumerate(license_scan.PARSED):
            for start in range(-len(notice) + 1, len(words)):
                low, high = max(0, -start), min(len(notice), len(words) - start)
                best = max(best, sum(index.weight[a] for a, b in zip(notice[low:high], words[start + low : start + high]) if a == b) / index.total[t])
        _, got = license_scan.match_templates(words, index)
        assert got >= best - 1e-9 if best >= license_scan.JUDGED else True


@pytest.mark.parametrize("t", range(len(license_scan.PARSED)))
def test_notices_wrapped_prefixed_and_changed(t):
    """Each template alone: as it is, with a word put in, with a comment word before each line, and with words changed outside of its phrases."""
    label, notice, phrases = license_scan.PARSED[t]
    kin = {label, "gpl"}  # what the base phrase would say of lgpl and agpl is not at stake
    index, rng = license_scan.build_index(10_000, {}), random.Random(t)
    around = [b"plain", b"words", b"of", b"a", b"file"] * 30
    lines = [notice[i : i + 10] for i in range(0, len(notice), 10)]
    forms = {"as it is": notice, "one more": [*notice[: len(notice) // 2], b"really", *notice[len(notice) // 2 :]], "prefixed": [w for line in lines for w in (b"dnl", *line)]}
    if len(notice) >= 20:
        held = {w for p in phrases for w in p}
        forms["changed"] = [w if w in held or rng.random() > 0.1 else b"other" for w in notice]
        forms["both"] = [w for i, w in enumerate(forms["changed"]) for w in ([b"rem", w] if i % 12 == 0 else [w])]
    for name, words in forms.items():
        labels, best = license_scan.match_templates([*around, *words, *around], index)
        assert label in labels and labels <= kin and best >= license_scan.COVER, (name, label, labels, best)


def test_plain_texts_and_repeated_words_get_no_label():
    index, rng = license_scan.build_index(10_000, {}), random.Random(1)
    words = [rng.choice([*license_scan.VOCABULARY, b"x", b"y"]) for _ in range(30_000)]
    assert license_scan.match_templates(words, index)[0] == set()
    began = time.time()
    assert license_scan.match_templates([b"unencumbered", b"merchantability"] * 150_000, index)[0] == set() and time.time() - began < 60


@pytest.mark.parametrize("text", ["a" * 5_000_000, "1" * 5_000_000, "1." * 2_500_000, "a@" * 2_500_000, "a:" * 2_500_000 + "=", "+1" * 2_500_000, "a at " * 1_000_000], ids=["letters", "digits", "ips", "signs", "colons", "plus", "at"])
def test_personal_data_in_five_million_characters(text):
    began = time.time()
    [(base, added)] = pii.chosen([text], *pii.model())
    assert time.time() - began < 90 and not added
    assert len(base) == (625_000 if text.startswith("1.") else 0)


def test_addresses_of_four_numbers_as_the_pattern_finds_them():
    rng, pattern = random.Random(3), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    for _ in range(4000):
        t = "".join(rng.choice(["1", "22", "255", "256", "0007", ".", ".", "..", " ", "x"]) for _ in range(rng.randint(1, 30)))
        want = [m.span() for m in pattern.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
        assert [(s, e) for s, k, e in pii.base_spans(t) if k == 1] == want, t


@pytest.mark.parametrize("page, blocks", [("<div>x" * 50_000, 50_000), ("<div>" * 50_000 + "</p>" * 50_000 + "x", 1), ("<a " * 100_000 + '" >x', 1), ("<script>" + "</script" * 200_000, 0), ("<li><ul>" + "<blockquote>" * 50_000 + "<li>x</li>" * 50_000, 50_000), ("<p>word" * 100_000, 100_000)], ids=["deep", "closing", "tags", "script", "lists", "many"])
def test_deep_and_long_pages(page, blocks):
    began = time.time()
    got = html_text.leaf_blocks(page)
    assert len(got) == blocks and time.time() - began < 30


def test_long_pages_are_labelled_as_whole_ones(monkeypatch):
    page = html_text.leaf_blocks("".join(html_text.example_page(random.Random(i)) for i in range(12)))
    model = html_text.labeller()
    whole = html_text.label_pages([page], model)[0]
    monkeypatch.setattr(html_text, "STEPS_AT_ONCE", 50)
    assert abs(html_text.label_pages([page], model)[0] - whole).max() < 1e-9


def test_kept_columns_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "mine", "<p>x</p>", "b", "s")], "page_id long, text string, html string, base string, spans string")
    assert html_text.extract(df, ["page_id", "text", "html"]).columns == ["page_id", "html", "text"]
    got = pii.find(df, "page_id", keep=["page_id", "base", "text"])
    assert got.columns == ["page_id", "text", "base", "spans"] and got.count() == 1
