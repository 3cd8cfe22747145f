"""Personal data by candidate gradient boosting.

Four fixed patterns give the base spans, which always stay. Beside them,
generators with high recall propose overlapping spans (written-out addresses,
numbers without a plus, keys and tokens); boosted trees judge each from its
format and its surroundings; of those above their kind's threshold, the best
that overlap nothing chosen are added. The trees learn from examples written by
rule with a fixed seed, and thresholds are set on a part held back.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import shipped
from ._util import free_name, give_back, read_table
from .boosting import BoostedTrees

KINDS = ["email", "ip", "card", "phone", "ssn", "iban", "secret"]
CANDIDATES_AT_ONCE = 20_000
BASE = 4  # the first four have base patterns

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
NUMBER = re.compile(r"[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

#: Kind, what the text must contain (0: any of the ten digits) as every match does, pattern. All patterns
#: are bounded or cannot start inside their own run, so a text is read in time linear in its length.
GENERATORS = [
    ("ip", ":", re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:{1,2}){2,7}[0-9A-Fa-f]{1,4}(?![\w:])")),
    ("card", "0", re.compile(r"(?<![\w.])[0-9]{4}(?:[ .-]?[0-9]{4}){2,3}(?:[ .-]?[0-9]{1,3})?(?![\w.])")),
    ("phone", "0", re.compile(r"(?<![\w.+])(?:00[1-9][0-9]{0,2}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,5})[ .-][0-9]{2,5}(?:[ .-][0-9]{2,5}){1,3}(?![\w])")),
    ("phone", "0", re.compile(r"(?<![\w.+])[0-9]{10,11}(?![\w.])")),
    ("ssn", "0", re.compile(r"(?<![\w-])[0-9]{3}[ -][0-9]{2}[ -][0-9]{4}(?![\w-])")),
    ("iban", "0", re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")),
]
#: Written-out addresses are found by their sign: what stands for @, with the first word after it, and what may follow.
SIGNS = [
    (re.compile(r" ?@ ?(?=[\w-])"), re.compile(r"[\w-]+(?: ?\. ?[\w-]+)+")),
    (re.compile(r" ?[(\[{<] ?at ?[)\]}>] ?(?=[\w-])", re.I), re.compile(r"[\w-]+(?: ?(?:\.|[(\[{<] ?dot ?[)\]}>]) ?[\w-]+)+", re.I)),
    (re.compile(r" at (?=[\w-])", re.I), re.compile(r"[\w-]+(?: dot [\w-]+)+", re.I)),
]
NOT_NAME = re.compile(r"[^\w.%+-]")
RUN_END = re.compile(r"[A-Za-z0-9_/+=-]{20,}")
PLAIN_RUN = re.compile(r"[^\s\"'=]{8,}")
KEYWORDS = {
    "email": "mail email contact write address".split(),
    "ip": "ip host server client addr login ipv6".split(),
    "card": "card visa mastercard credit debit payment pay".split(),
    "phone": "phone tel call mobile fax cell whatsapp sms".split(),
    "ssn": "ssn social security taxpayer".split(),
    "iban": "iban account bank transfer".split(),
    "secret": "token key secret password passwd pwd apikey credential auth bearer".split(),
    "other": "order version isbn page build commit invoice ticket serial sha md5 hash id ref date item chapter lot model".split(),
}


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _octet(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, sorted; matches that fail their check are dropped."""
    out = []
    if "@" in text:
        last = 0
        for m in DOMAIN.finditer(text):
            start = m.start()
            while start > last and text[start - 1] in LOCAL:
                start -= 1
            if start < m.start():
                out.append((start, 0, last := m.end()))
    if DIGIT.search(text):
        for m in CHAIN.finditer(text):  # a match is four numbers, the next starts with the fifth
            if m[0].count(".") >= 3:
                ends = [x.span() for x in NUMBER.finditer(text, m.start(), m.end())]
                for i in range(3, len(ends), 4):
                    if all(_octet(text[lo:hi]) for lo, hi in ends[i - 3 : i + 1]):
                        out.append((ends[i - 3][0], 1, ends[i][1]))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(out)


def _addresses(text: str, out: set) -> None:
    """From each sign outward: the name before it, and the words and dots after it."""
    for sign, after in SIGNS:
        last = 0
        for m in sign.finditer(text):
            start = m.start()
            while start > last and not NOT_NAME.match(text, start - 1):
                start -= 1
            if start < m.start() and (rest := after.match(text, m.end())):
                out.add((start, 0, rest.end()))
            last = m.end()  # a name ends where the sign before it ended, so no letter is passed twice


def _secrets(text: str, digits: bool, out: set) -> None:
    """Runs that hold a digit and a letter: of 20 characters of keys, or of 8 up to a blank or quote after a sign or blank."""
    k = KINDS.index("secret")
    mixed = lambda s: any(c.isdigit() for c in s) and any(c.isalpha() for c in s)
    if not digits and text.isascii():
        return
    for m in RUN_END.finditer(text):
        lo, hi = m.span()
        if (lo == 0 or not (text[lo - 1].isalnum() or text[lo - 1] in "_/+")) and (hi == len(text) or not (text[hi].isalnum() or text[hi] in "_/+")) and mixed(m[0]):
            out.add((lo, k, hi))
    for m in PLAIN_RUN.finditer(text):
        lo, hi = m.span()
        if lo == 0:  # nothing before it: the part after its first colon
            lo = text.find(":", 0, hi) + 1 or hi
        if hi - lo >= 8 and (hi == len(text) or text[hi] != "=") and mixed(text[lo:hi]):
            out.add((lo, k, hi))


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all that the generators propose; they may overlap."""
    digits = DIGIT.search(text) is not None
    out: set[tuple[int, int, int]] = set()
    for kind, hint, pattern in GENERATORS:
        if digits if hint == "0" else hint in text:
            k = KINDS.index(kind)
            found = ((m.start(), k, m.end()) for m in pattern.finditer(text))
            # a number that fails its check digit is no card
            out.update(found if kind != "card" else (x for x in found if luhn("".join(c for c in text[x[0] : x[2]] if "0" <= c <= "9"))))
    _addresses(text, out)
    _secrets(text, digits, out)
    return sorted(out)


def features(text: str, span: tuple[int, int, int]) -> list[float]:
    start, kind, end = span
    s = text[start:end]
    n = len(s)
    digits = "".join(c for c in s if "0" <= c <= "9")
    counts = Counter(s)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    before = re.findall(r"[a-z0-9]+", text[max(0, start - 40) : start].lower())
    near = {k: max([0.0, *(1 / (1 + i) for i, w in enumerate(reversed(before)) if w in ws)]) for k, ws in KEYWORDS.items()}
    groups = re.findall(r"[0-9]+", s)
    own = near.pop(KINDS[kind])
    other = near.pop("other")
    return [
        kind, n, len(digits), sum(c.isalpha() for c in s), sum(c in " -." for c in s), len(groups), len(max(groups, key=len, default="")), entropy,
        float(len(digits) >= 13 and luhn(digits)), float(digits[:1] in ("3", "4", "5", "6")), len(set(digits)), own, other, max(near.values(), default=0.0),
        float(text[max(0, start - 2) : start].strip(" ") in ("=", '="', '"', ":", "='")), float(all(c in "0123456789abcdefABCDEF" for c in s)), float("(" in s or "[" in s),
        float("@" in s), float(s[:2] == "00"), s.count(":"), float(any(c.isupper() for c in s) and any(c.islower() for c in s)), float(text[max(0, start - 1) : start] in ("$", "#", "/", "v")),
    ]


def examples(n: int, seed: int) -> list[tuple[str, tuple[int, int, int], int]]:
    """(text, candidate, is it personal): candidates in lines written by rule."""
    rng = random.Random(seed)
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice(["er", "th", "an", "in", "re", "on", "ou", "la", "de", "st", "ö", "é"]) for _ in range(rng.randint(1, 4)))
    hexes = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    mixed = lambda k: "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz0123456789") for _ in range(k))

    def card() -> str:
        d = rng.choice("3456") + num(15 - 1)
        d = next(d + c for c in "0123456789" if luhn(d + c))
        return rng.choice(["", "", " ", "-", "."]).join(d[i : i + 4] for i in range(0, 16, 4))

    def email() -> str:
        a, b = f"{word()}.{word()}{num(2)}", word()
        return rng.choice([f"{a} (at) {b} (dot) com", f"{a}[at]{b}.org", f"{a} at {b} dot net", f"{a} @ {b}.com", f"{a}(at){b}.com"])

    def phone() -> str:
        return rng.choice([f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}", f"00{rng.choice('1347')}{num(1)} {num(3)} {num(3)} {num(3)}", f"0{num(3)} {num(3)} {num(4)}"])

    cue = lambda k: rng.choice(KEYWORDS[k]) + rng.choice([": ", " ", " = ", " is "]) if rng.random() < 0.45 else ""
    good = [
        ("email", lambda: cue("email") + "{" + email() + "}"), ("card", lambda: cue("card") + "{" + card() + "}"), ("phone", lambda: cue("phone") + "{" + phone() + "}"),
        ("ssn", lambda: cue("ssn") + "{" + f"{rng.randint(100, 899)}-{num(2)}-{num(4)}" + "}"), ("iban", lambda: cue("iban") + "{" + rng.choice(["DE", "FR", "ES", "GB"]) + num(2) + " " + " ".join(num(4) for _ in range(4)) + " " + num(2) + "}"),
        ("secret", lambda: rng.choice(KEYWORDS["secret"]) + rng.choice([' = "', "=", ': "', ": "]) + "{" + rng.choice([hexes(rng.choice([32, 40, 48])), mixed(rng.randint(20, 48)), mixed(rng.randint(10, 16))]) + '}"'),
        ("ip", lambda: cue("ip") + "{" + ":".join(hexes(4) for _ in range(8)) + "}"), ("phone", lambda: rng.choice(KEYWORDS["phone"]) + " {" + num(10) + "}"),
    ]
    bad = [
        lambda: f"{rng.choice(KEYWORDS['other'])} {num(rng.choice([10, 11, 12, 16]))}", lambda: f"19{num(2)}-{num(2)}-{num(2)} {num(2)}", lambda: f"isbn 978-{num(1)}-{num(4)}-{num(4)}-{num(1)}",
        lambda: f"{num(2)} {num(2)} {num(2)} {num(3)}", lambda: f"{rng.choice(['commit', 'sha', 'md5', 'hash'])} {hexes(40)}", lambda: f"{word()} at {word()} dot {word()}",
        lambda: f"{num(2)}:{num(2)}:{num(2)}", lambda: f"page {num(3)}-{num(3)} {num(3)}", lambda: f"{word()}{word()}{word()}{word()}{word()}-{word()}{word()}{num(1)}{word()}{word()}",
        lambda: f"= {word()}{num(1)}{word()}{word()}{word()}", lambda: f"$ {num(3)} {num(3)} {num(3)}", lambda: f"version {num(2)}.{num(3)}.{num(4)}", lambda: f"{num(10)}", lambda: f"AB{num(2)} {num(4)} lot {num(4)}", lambda: f"order {num(4)}-{num(4)}-{num(4)}-{num(4)}", lambda: f"{rng.choice(KEYWORDS['other'])} {rng.choice(['', 'no ', '# '])}{card()}", lambda: f"0{num(3)} {num(3)} {num(3)} {num(3)} {num(3)} {num(3)}",
    ]
    out = []
    while len(out) < n:
        kind, make = rng.choice(good)
        wanted = rng.random() < 0.5
        line = make() if wanted else rng.choice(bad)()
        left, right = " ".join(word() for _ in range(rng.randint(0, 6))), " ".join(word() for _ in range(rng.randint(0, 4)))
        text = f"{left} {line} {right}"
        lo, hi = text.find("{"), text.find("}") - 1
        text = text.replace("{", "").replace("}", "")
        for c in candidates(text):
            same = wanted and KINDS[c[1]] == kind and c[0] <= lo + 1 and c[2] >= hi - 1 and c[2] - c[0] <= hi - lo + 2
            out.append((text, c, int(same)))
    return out


@cache
def model(n: int = 6000, seed: int = 7, precision: float = 0.95) -> tuple[BoostedTrees, np.ndarray]:
    """Trees, and for each kind the lowest threshold from 0.5 that keeps the precision on examples held back."""
    seen, kept = examples(n, seed), examples(n // 2, seed + 1)
    table = lambda rows: (np.array([features(t, c) for t, c, _ in rows]), np.array([y for *_, y in rows], float))
    trees = BoostedTrees().fit(*table(seen))
    x, y = table(kept)
    p, limits = trees.predict(x), np.full(len(KINDS), 0.5)
    for k in range(len(KINDS)):
        own = x[:, 0] == k
        for t in np.arange(0.5, 0.99, 0.02):
            limits[k] = t
            hit = own & (p >= t)
            if not hit.any() or y[hit].mean() >= precision:
                break
    return trees, limits


def chosen(texts: list[str], trees: BoostedTrees, limits: np.ndarray) -> Iterator[tuple[list, list]]:
    """(base spans, added spans) of each text, both as (start, kind, end).

    Texts go in runs of about CANDIDATES_AT_ONCE candidates, of which features are held at a time.
    """
    run: list = []
    held = 0
    for t in texts:
        run.append((t, base_spans(t), candidates(t)))
        held += 1 + len(run[-1][2])
        if held > CANDIDATES_AT_ONCE:
            yield from _judged(run, trees, limits)
            run, held = [], 0
    yield from _judged(run, trees, limits)


def _judged(run: list, trees: BoostedTrees, limits: np.ndarray) -> Iterator[tuple[list, list]]:
    every = ((t, c) for t, _, cs in run for c in cs)
    p: list[float] = []
    while part := list(islice(every, CANDIDATES_AT_ONCE)):
        p += trees.predict(np.array([features(t, c) for t, c in part])).tolist()
    at = iter(p)
    for t, base, cs in run:
        ranked = sorted((-q, c) for q, c in [(next(at), c) for c in cs] if q >= limits[c[1]])
        added, taken = [], bytearray(len(t) if ranked else 0)
        for s, _, e in base if ranked else ():
            taken[s:e] = b"1" * (e - s)
        for _, (s, k, e) in ranked:
            if taken.find(b"1", s, e) < 0:
                added.append((s, k, e))
                taken[s:e] = b"1" * (e - s)
        yield base, sorted(added)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (or id_col) with base and spans: arrays of (kind, start, end) by start, then kind.

    start and end count code points, end exclusive. Null texts count as empty
    and have no spans; null ids, repeated rows and other columns pass; kept
    columns named base or spans give way to the result's; an empty table gives
    an empty result. A text is read in time linear in its length.
    """
    keep = [c for c in keep or [id_col] if c not in ("base", "spans")]
    trees, limits = model()
    text = free_name("text", keep)
    slim = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias(text))
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    ddl = "array<struct<kind: string, start: int, end: int>>"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema if f.name != text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = lambda spans: [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans]
        for b in batches:
            found = chosen(b.column(text).to_pylist(), trees, limits)
            both = [(named(x), named(sorted(x + y))) for x, y in found]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array([x for x, _ in both], span), pa.array([y for _, y in both], span)], [*keep, "base", "spans"])

    return shipped(slim).mapInArrow(run, f"{schema}, base {ddl}, spans {ddl}")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span of its text replaced by <KIND>; overlapping spans become one mark, of the first.

    A column n_chars, where there is one, gets the new number of code points.
    A null text stays null, an empty one empty; repeated rows are masked alike;
    an empty table gives an empty result; other columns pass whatever their names.
    """
    trees, limits = model()
    fields = docs.schema.fields
    at = docs.columns.index(text_col)
    types = [f.dataType.simpleString() for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            new = []
            for t, (base, added) in zip(texts, chosen([t or "" for t in texts], trees, limits)):
                parts, last = [], 0
                for s, k, e in sorted(base + added):
                    if s >= last:
                        parts += [t[last:s], f"<{KINDS[k].upper()}>"]
                    last = max(last, e)
                new.append("".join([*parts, t[last:]]) if last else t)
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if i == at else b.column(i) for i in range(len(fields))], [f.name for f in fields])
            del texts, new
        give_back()

    out = shipped(docs).mapInArrow(run, ", ".join(f"`{f.name}` {t}" for f, t in zip(fields, types)))
    return out.withColumn("n_chars", F.when(F.col(text_col).isNotNull(), F.char_length(text_col)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find(read_table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    line = lambda c: F.concat_ws(",", F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    return out.select("doc_id", *map(count, KINDS[:BASE]), F.sha2(line("base"), 256).alias("base_sha256"), line("spans").alias("spans"))


QUERIES = {"op10_pii": op10_pii}
