"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols (insult, harm, will, target, negation, report, that, quote,
clause end). Four transducers rewrite the symbols and are composed into one
machine: threats join "will" and a harm, negation cancels insults in its scope,
reported speech (in quotes, after "that", or named as in "called her an ...") sets
insults apart as quoted, and a target before or right after an insult makes it
aimed. The counts of what the clauses of a text come to are weighed by a
logistic model. Insults are learned as words and stems from labelled rows, in
whatever language these are, and added to a short list; the other classes are
closed ones, listed for the four languages of the corpus.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import shipped
from ._util import free_name, give_back, read_table, staged

OTHER, INSULT, HARM, WILL, TARGET, NEG, REPORT, THAT, QUOTE, END = range(10)
THREAT, AIMED, DENIED, QUOTED, AIMED_BACK = range(10, 15)  # what transducers write beside these
INPUTS, SYMBOLS = 10, 15

#: English, German, French and Spanish words of each class.
WORDS = {
    INSULT: "idiot idiots moron morons stupid pathetic disgusting worthless scum trash loser losers clown imbecile vermin",
    HARM: "kill hurt beat destroy smash stab shoot punish attack töten umbringen schlagen zerstören erschießen verletzen tuer frapper détruire blesser attaquer matar golpear destruir herir atacar",
    WILL: "will gonna shall ll werde wirst wird werden werdet vais vas va allons allez vont voy vamos van",
    TARGET: "you your u they them he she him her this these those du dich dir euch ihr tu te toi vous tú ti usted ustedes vosotros",
    NEG: "not no never nobody cannot without neither nor nicht kein keine keinen nie niemals weder ne n pas jamais non ni aucun aucune nunca jamás ningún ninguna tampoco",
    REPORT: "said says say call called calls wrote claims claimed told according quoted sagte sagt nannte schrieb behauptete laut dit disait appelé écrit prétend selon dijo dice llamó escribió según afirmó",
    THAT: "that dass que qu",
}
ENDS = frozenset(".!?;")
QUOTES = frozenset("\"“”„«»")
PARTS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?;\"“”„«»]")
STEMS = (4, 5, 6, 7, 8)
GIVEN = 1.5  # weight of the words listed above
#: At most so many labelled rows, taken in the order of a hash of their id, fit lexicon and weights.
TRAIN_ROWS = 8000
CACHE = 1 << 17
PLAIN = ((OTHER, 0.0),)


class Transducer:
    """arcs: (state, symbol) -> (next state, symbol out); any other symbol passes and leads to rest(state)."""

    def __init__(self, arcs: dict, rest=lambda s: s):
        self.arcs, self.rest = arcs, rest

    def step(self, state, symbol):
        return self.arcs.get((state, symbol)) or (self.rest(state), symbol)


def _machine(arcs: dict, states: tuple, rest) -> Transducer:
    """The arcs, and a clause's end leading back to the start where they do not say otherwise."""
    return Transducer({(s, END): (0, END) for s in states} | arcs, rest)


def threats() -> Transducer:
    """will, and a harm within three words."""
    arcs = {(0, WILL): (3, WILL)}
    for s in (1, 2, 3):
        arcs |= {(s, HARM): (0, THREAT), (s, WILL): (3, WILL)}
    return _machine(arcs, (0, 1, 2, 3), lambda s: max(0, s - 1))


def negation() -> Transducer:
    """A negation denies insults and threats within the next three words."""
    arcs = {(0, NEG): (3, NEG)}
    for s in (1, 2, 3):
        arcs |= {(s, NEG): (3, NEG), (s, INSULT): (s - 1, DENIED), (s, THREAT): (s - 1, DENIED)}
    return _machine(arcs, (0, 1, 2, 3), lambda s: max(0, s - 1))


def reported() -> Transducer:
    """After a verb of saying: insults within four words are quoted; a quote within
    four words opens a stretch up to the next quote, over ends of clauses; "that"
    opens one up to the end of the clause."""
    near, quote, clause = (1, 2, 3, 4), 5, 6
    arcs = {(0, REPORT): (4, REPORT), (quote, QUOTE): (0, QUOTE), (quote, END): (quote, END)}
    for s in near:
        arcs |= {(s, REPORT): (4, REPORT), (s, QUOTE): (quote, QUOTE), (s, THAT): (clause, THAT), (s, INSULT): (s - 1, QUOTED), (s, THREAT): (s - 1, QUOTED)}
    for s in (quote, clause):
        arcs |= {(s, INSULT): (s, QUOTED), (s, THREAT): (s, QUOTED)}
    return _machine(arcs, (0, *near, quote, clause), lambda s: s - 1 if s in near else s)


def target() -> Transducer:
    """An insult or threat after a target in the clause, or up to two words before one, is aimed."""
    arcs = {(0, TARGET): (1, TARGET), (1, INSULT): (1, AIMED), (1, THREAT): (1, AIMED)}
    for s in (0, 2, 3):
        arcs |= {(s, INSULT): (3, INSULT), (s, THREAT): (3, THREAT)}
    for s in (2, 3):
        arcs[s, TARGET] = (1, AIMED_BACK)
    return _machine(arcs, (0, 1, 2, 3), lambda s: {3: 2, 2: 0}.get(s, s))


def compose(machines: list[Transducer]) -> tuple[np.ndarray, np.ndarray]:
    """Tables next[state, symbol] and out[state, symbol] of the machines in a row; state 0 starts."""
    states, todo, nexts, outs = {(0,) * len(machines): 0}, [(0,) * len(machines)], [], []
    while todo:
        state = todo.pop(0)
        row, out = [], []
        for symbol in range(INPUTS):
            now, to = symbol, []
            for m, s in zip(machines, state):
                s, now = m.step(s, now)
                to.append(s)
            if (to := tuple(to)) not in states:
                states[to] = len(states)
                todo.append(to)
            row.append(states[to])
            out.append(now)
        nexts.append(row)
        outs.append(out)
    return np.array(nexts), np.array(outs)


MACHINES = {"threats": threats, "negation": negation, "reported": reported, "target": target}
NEXT, OUT = (t.tolist() for t in compose([m() for m in MACHINES.values()]))


class Reader:
    """Symbols of raw tokens (what stands between white space), remembered for CACHE tokens.

    insults: weights of words, and of stems written "stem*", which stand for any longer word.
    """

    def __init__(self, insults: dict[str, float]):
        self.words = {w: (s, GIVEN) for s, ws in WORDS.items() for w in ws.split()}
        self.words |= {w: (INSULT, x) for w, x in insults.items() if not w.endswith("*")}
        self.stems = {w[:-1]: x for w, x in insults.items() if w.endswith("*")}
        self.known: dict[str, tuple] = {}

    def word(self, w: str) -> tuple[int, float]:
        symbol, weight = self.words.get(w, (OTHER, 0.0))
        stem = max((self.stems.get(w[:k], 0.0) for k in STEMS if len(w) > k), default=0.0)
        return (INSULT, max(stem, weight)) if stem and symbol in (OTHER, INSULT) else (symbol, weight)

    def token(self, raw: str) -> tuple:
        """(symbol, weight) of a token's words, quotes and clause ends, in order."""
        if len(self.known) > CACHE:
            self.known.clear()
        out = []
        for part in PARTS.findall(raw.lower()):
            if part in ENDS:
                out.append((END, 0.0))
            elif part in QUOTES:
                out.append((QUOTE, 0.0))
            elif part.endswith(("n't", "n’t")):
                out.append((NEG, 0.0))
            else:
                out += [self.word(w) for w in re.split("['’]", part)]
        self.known[raw] = out = PLAIN if out == [(OTHER, 0.0)] else tuple(out)
        return out


FEATURES = ["clauses", "insult", "threat", "aimed", "denied", "quoted", "worst", "distinct"]


def clause_counts(text: str, reader: Reader, tables: tuple = (NEXT, OUT)) -> list[float]:
    """log(1 + x) of: the clauses that match, the weight of each kind of match,
    the weight of the worst clause, and the distinct tokens that match."""
    sums, clauses, worst, tokens, last = [0.0] * SYMBOLS, 0, 0.0, set(), (INSULT, 0.0)
    (nexts, outs), known, token = tables, reader.known, reader.token
    for line in text.split("\n"):
        state, hits = 0, 0.0
        for raw in line.split():
            for symbol, weight in known.get(raw) or token(raw):
                if symbol or state:
                    out = outs[state][symbol]
                    state = nexts[state][symbol]
                    if symbol == END:
                        clauses, worst, hits = clauses + (hits > 0), max(worst, hits), 0.0
                    elif out == AIMED_BACK:  # the match before was of this target
                        sums[last[0]] -= last[1]
                        sums[AIMED] += last[1]
                    elif out == INSULT or out >= THREAT:
                        sums[out] += weight
                        if out in (INSULT, THREAT):
                            last = out, weight
                        if out != DENIED:
                            hits += weight
                            tokens.add(raw)
        clauses, worst = clauses + (hits > 0), max(worst, hits)
    return [math.log1p(max(0.0, x)) for x in (clauses, sums[INSULT], sums[THREAT], sums[AIMED], sums[DENIED], sums[QUOTED], worst, len(tokens))]


def clause_features(docs: DataFrame, insults: dict[str, float], keep: list[str], text_col: str = "text", to: str = "x") -> DataFrame:
    """The columns `keep` and `to`, the features of clause_counts; a null text counts as empty."""
    own = free_name("text", [*keep, to])
    slim = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias(own))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in slim.schema if f.name != own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(insults)
        for b in batches:
            x = pa.array([clause_counts(t.as_py(), reader) for t in b.column(own)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), x], [*keep, to])
        reader.known.clear()
        give_back()

    return shipped(slim).mapInArrow(run, f"{schema}`{to}` array<double>")


def held_out(id_col: str = "doc_id") -> Column:
    """Rows kept from learning: crc32 of the id as text is divisible by 5 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _grams(words: list[str]) -> set[str]:
    return {w[:k] + "*" for w in words for k in STEMS if len(w) > k} | {w for w in words if w}


def learn_insults(rows: Callable[[], Iterable[tuple[list[str], int]]]) -> dict[str, float]:
    """Weights of words, and of stems as "stem*", that mark label 1, from (distinct words, label) rows.

    Kept are those that most rows with them share label 1, and that are in more
    such rows than chance explains: the odds against it must exceed 20 times the
    number of candidates (a likelihood ratio against the base rate). Copies of a
    text say nothing new, so rows with the same least word hash count once. The
    weight is a third of the log odds over the base odds. rows() is gone through
    twice, so that only counts are held.
    """
    seen, total, n_rows = Counter(), 0, 0
    for words, y in rows():
        n_rows, total = n_rows + 1, total + y
        if y:
            seen.update(_grams(words))
    if not total or total == n_rows:
        return {}
    marks = {g: (set(), set()) for g, n in seen.items() if n >= 3}
    del seen
    neg = Counter()
    for words, y in rows():
        found = _grams(words) & marks.keys()
        if y:
            own = [min((zlib.crc32(w.encode(), salt) for w in words if w), default=0) for salt in (1, 2)]
            for g in found:
                for known, mark in zip(marks[g], own):
                    known.add(mark)
        else:
            neg.update(found)
    candidates = {g: n for g, both in marks.items() if (n := min(map(len, both))) >= 3}
    rate, need, out = total / n_rows, math.log(20 * max(1, len(candidates))), {}
    for g, n in candidates.items():
        p = n / (n + neg[g])
        ratio = n * math.log(p / rate) + (neg[g] * math.log((1 - p) / (1 - rate)) if neg[g] else 0)
        if p > 0.5 and ratio > need:
            out[g] = math.log((n + 0.5) / (neg[g] + 0.5) * (1 - rate) / rate) / 3
    return dict(sorted(out.items()))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Weights and intercept by Newton steps with a small ridge; without both labels only the base rate."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    if len(y) == 0 or y.min() == y.max():
        w[-1] = 0.0 if len(y) == 0 else (4.0 if y[0] else -4.0)
        return w
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty), a.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAIN_ROWS) -> tuple[dict[str, float], list[float]]:
    """Insults and weights from at most `rows` labelled rows that are not held out.

    Labels that are null are left out; an id labelled more than once counts as
    its largest label, one with several texts as the text of the least hash. Only lists of distinct words and feature rows of the
    bounded sample reach the driver.
    """
    given = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_y"))
    chosen = given.orderBy(F.xxhash64("_id"), "_id").limit(rows)
    text = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sample = text.join(F.broadcast(chosen), "_id").groupBy("_id", "_y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    sample = staged(sample, "toxic-sample")
    words = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))
    listed = staged(sample.select(words.alias("w"), "_y"), "toxic-words")
    insults = learn_insults(lambda: ((r["w"], r["_y"]) for r in listed.toLocalIterator()))
    found = clause_features(sample, insults, ["_y"]).collect()
    x, y = np.array([r["x"] for r in found]).reshape(len(found), len(FEATURES)), np.array([r["_y"] for r in found], float)
    return insults, fit_logistic(x, y).tolist()


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", keep: list[str] | None = None) -> DataFrame:
    """docs (or only its columns `keep`) with score (0 to 1, higher: likelier toxic) and the clause counts as x.

    Null and empty texts get the score of a text without matches; repeated rows
    get equal scores. An empty table gives an empty result; without usable labels
    only the fixed list counts and every score is one half or the base rate.
    Columns of docs called x or score give way to the result's.
    """
    keep = [c for c in keep or docs.columns if c.lower() not in ("x", "score")]
    return _scored(docs, labels, id_col, text_col, label_col, keep, "x", "score")


def _scored(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, keep: list[str], x: str, score: str) -> DataFrame:
    insults, w = train(docs, labels, id_col, text_col, label_col)
    out = clause_features(docs, insults, keep, text_col, x)
    z = sum((F.col(x)[i] * wi for i, wi in enumerate(w[:-1])), F.lit(w[-1]))
    return out.withColumn(score, 1 / (1 + F.exp(-z)))


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score below the threshold; all their columns stay as they
    are, whatever their names. Null and empty texts stay; repeated rows share their
    fate; an empty table gives an empty result."""
    x, score = (free_name(f"toxic_{n}", docs.columns) for n in ("counts", "score"))
    return _scored(docs, labels, "doc_id", "text", "toxic", docs.columns, x, score).where(F.col(score) < threshold).drop(x, score)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_documents(docs, read_table(spark, sf_dir, "labels"), keep=["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op1_toxicity": op1_toxicity}
