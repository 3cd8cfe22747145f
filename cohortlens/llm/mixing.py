"""Mixing overlapping sources to target weights by min-cost flow.

Texts that stand in several sources overlap them: each distinct text has a
pattern, the set of its sources. Documents are aggregated by (pattern, source);
a min-cost flow on the driver routes the words of the patterns to the quotas of
the sources, at a cost that rises with every repetition of a pattern's words
(convex), so that quotas are met with as little repetition as possible; then
documents are selected within each (pattern, source) in a seeded order. Targets
are found in Spark. What reaches the driver are patterns and the sources that
they overlap, MAX_CELLS pairs at most, and neither documents nor sources that
share no text.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._util import free_name, read_table, small_side, staged

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: Patterns kept apart, largest first. Smaller ones are folded by their first two
#: sources into at most MAX_FOLDS patterns, whose distinct words are those of all
#: their texts. Should patterns and folds overlap more than MAX_CELLS sources in
#: sum, the smallest of them count as texts of each of their sources alone.
MAX_PATTERNS = 4096
MAX_FOLDS = 4096
MAX_CELLS = 200_000
BITS = 10  # of the seeded order, at each of two refinements of the range in which a quota is reached
SETTLED = 2  # documents that may be taken once more or less to come nearer to a source's target
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_REPEATS) -> DataFrame:
    """sizes, a row (source, source_size) for each source, with its target.

    Sources by code point, null last, get the weights in turn and share the sum
    of all sizes; a target stops at `most` times its source's size, and the
    excess is shared again by weight among the others until none is above. So
    target = min(most * size, level * weight); the level rises round by round,
    and each round is one aggregate over the sources.
    """
    sizes = staged(sizes, "sizes")
    place = _numbered(sizes.where("source is not null"))
    last = sizes.where("source is null").withColumn("n", F.lit(sizes.where("source is not null").count()).cast("long"))
    weight = F.array(*[F.lit(w) for w in weights])[(F.col("n") % len(weights)).cast("int")]
    weighed = staged(place.unionByName(last).withColumns({"weight": weight, "full": F.col("source_size") * most}), "weights")
    level, total = 0.0, weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    while True:
        full = F.col("full") <= level * F.col("weight")
        row = weighed.agg(F.coalesce(F.sum(F.when(full, F.col("full"))), F.lit(0)).alias("used"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        if row["open"] is None or (new := (total - row["used"]) / row["open"]) <= level * (1 + 1e-12):
            break
        level = new
    return weighed.select("source", "source_size", F.least(F.col("full").cast("double"), level * F.col("weight")).alias("target"))


def _numbered(sizes: DataFrame) -> DataFrame:
    """sizes with n, the place of each source from 0: sorted in ranges, counts of the ranges added."""
    ranged = staged(sizes.orderBy("source").withColumns({"range": F.spark_partition_id(), "i": F.monotonically_increasing_id() % (1 << 33)}), "ranges")
    before = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("k")).withColumn("before", F.sum("k").over(W.orderBy("range")) - F.col("k"))  # a row for each partition
    return ranged.join(before.select("range", "before"), "range").select("source", "source_size", (F.col("before") + F.col("i")).alias("n"))


class Flow:
    """Max-flow by blocking flows on level graphs; capacities may be raised between runs."""

    def __init__(self, n: int):
        self.head, self.to, self.cap = [[] for _ in range(n)], [], []

    def arc(self, a: int, b: int, cap: int) -> int:
        for x, y, c in ((a, b, cap), (b, a, 0)):
            self.head[x].append(len(self.to))
            self.to.append(y)
            self.cap.append(c)
        return len(self.to) - 2

    def run(self, s: int, t: int) -> int:
        sent = 0
        while amount := self._block(s, t):
            sent += amount
        return sent

    def _block(self, s: int, t: int) -> int:
        level, queue = {s: 0}, [s]
        for u in queue:
            for e in self.head[u]:
                if self.cap[e] > 0 and self.to[e] not in level:
                    level[self.to[e]] = level[u] + 1
                    queue.append(self.to[e])
        if t not in level:
            return 0
        at, sent, path = [0] * len(self.head), 0, []
        u = s
        while True:
            if u == t:
                amount = min(self.cap[e] for e in path)
                for e in path:
                    self.cap[e] -= amount
                    self.cap[e ^ 1] += amount
                sent += amount
                u, path = s, []
            elif at[u] < len(self.head[u]):
                e = self.head[u][at[u]]
                v = self.to[e]
                if self.cap[e] > 0 and level.get(v) == level[u] + 1:
                    path.append(e)
                    u = v
                else:
                    at[u] += 1
            elif path:
                u = self.to[path.pop() ^ 1]
                at[u] += 1
            else:
                return sent


def route(groups: list[tuple[int, str | None, int, int]], quota: dict[str | None, int], most: int = MAX_REPEATS) -> dict[tuple[int, str | None], int]:
    """Words that each (pattern, source) gives to its source, at least cost.

    groups: (pattern, source, words of its rows, words of the pattern's distinct
    texts). A pattern's distinct words may go out once at cost 0, a second time
    at 1, and so on; an arc to a source carries at most `most` times the words
    that its rows have. Only the arcs into patterns cost, so shortest paths come
    in rounds: round k opens every pattern for its k-th repetition and sends all
    that can be sent, which is the min-cost flow. Quotas that are `most` times
    all of a source's words fill its arcs in any flow, and are sent beforehand.

    Rounds in which nothing changes are passed over. What k rounds send is the
    least cut of a network whose capacities grow evenly with k (but where a
    pattern's first words were sent beforehand, which are stops): concave in k
    and straight between the few k at which another cut becomes the least. So
    if d rounds together send d times what one does, no cut changes in them, and
    each open pattern has filled every one of them. d is found by doubling.
    """
    words, once, held = {(p, x): w for p, x, w, _ in groups}, {}, defaultdict(int)
    for p, x, w, d in groups:
        once[p] = max(once.get(p, 0), d)
        held[x] += w
    out = {k: most * w if quota[k[1]] >= most * held[k[1]] else 0 for k, w in words.items()}
    used = defaultdict(int)
    for (p, _), f in out.items():
        used[p] += f
    sources = [x for x in quota if held[x] and quota[x] < most * held[x]]
    cells = [(p, x) for p, x, w, _ in groups if w and quota[x] < most * held[x]]
    patterns = sorted({p for p, _ in cells})
    flow, s, t = Flow(2 + len(patterns) + len(sources)), 0, 1
    place = {x: 2 + len(patterns) + i for i, x in enumerate(sources)}
    into = {p: flow.arc(s, 2 + i, 0) for i, p in enumerate(patterns)}
    arcs = {(p, x): flow.arc(into[p] // 2 + 2, place[x], most * words[p, x]) for p, x in cells}
    for x in sources:
        flow.arc(place[x], t, quota[x])
    sum_of = defaultdict(int)
    for p, x in cells:
        sum_of[p] += words[p, x]
    left, k = sum(quota[x] for x in sources), 0
    opened = dict.fromkeys(patterns, 0)  # capacity so far
    full = max((-(-(most * sum_of[p] + used[p]) // once[p]) for p in patterns if once[p]), default=0)  # rounds after which all is open
    stops = sorted({used[p] // once[p] for p in patterns if once[p]} | {full})

    def advance(d: int) -> int:
        for p in patterns:
            cap = max(0, (k + d) * once[p] - used[p])
            flow.cap[into[p]] += cap - opened[p]
            opened[p] = cap
        return flow.run(s, t)

    while left > 0 and k < full:
        gain = advance(1)
        left, k = left - gain, k + 1
        at = bisect_right(stops, k - 1)
        bound = stops[at] - k if k < full and stops[max(0, at - 1)] != k - 1 else 0  # no capacity bends from k - 1 to the next stop
        step = 1
        while left > 0 and 0 < step <= bound:
            before = flow.cap[:], opened.copy()
            if advance(step) != step * gain:
                flow.cap, opened = before
                break
            left, k, bound, step = left - step * gain, k + step, bound - step, min(2 * step, max(1, bound - step))
    return {c: f + (flow.cap[arcs[c] ^ 1] if c in arcs else 0) for c, f in out.items()}


def word_count(text: str) -> Column:
    return F.when(F.col(text).isNull(), 0).otherwise(F.regexp_count(F.col(text), F.lit(WORD))).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_REPEATS, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, passes, taken, key) for each row of docs.

    taken = size * passes, passes from 0 to `most`; key is a hash of the text. A
    null text has size 0 and nothing to take; a null source is a source of its
    own, last in order; repeated rows are documents of their own, of which some
    may be taken and others not; an empty table gives an empty result; other
    columns are not read.
    """
    slim = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text_col).alias("size"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit("")), F.lit(seed)).alias("key"),
    )
    slim = staged(slim.withColumns({"u": F.xxhash64("doc_id", "key", "source", F.lit(seed)), "row": F.monotonically_increasing_id()}), "mix")
    quota = staged(targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "targets")
    slim = staged(slim.join(small_side(_patterns(slim), "patterns"), "key", "left").withColumn("p", F.coalesce("p", F.lit(0))), "mix")
    plan = small_side(_routed(slim, quota, most), "plan")
    return _select(slim, plan, most).select("doc_id", "source", "size", "source_size", "target", "passes", (F.col("size") * F.col("passes")).alias("taken"), "key")


def _patterns(slim: DataFrame) -> DataFrame:
    """(key, p) for the texts that stand in several sources; p numbers the pattern."""
    name = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    held = slim.where("size > 0").groupBy("key", "source").agg(F.max("size").alias("size"))
    shared = held.groupBy("key").agg(F.array_sort(F.collect_set(name)).alias("pattern"), F.max("size").alias("size")).where(F.size("pattern") > 1)
    fold = 1 + F.pmod(F.xxhash64(F.col("pattern")[0], F.col("pattern")[1]), F.lit(MAX_FOLDS))
    shared = staged(shared.select("key", "size", F.size("pattern").alias("k"), F.xxhash64("pattern").alias("own"), fold.alias("fold")), "shared")
    big = shared.groupBy("own").agg(F.sum("size").alias("w")).orderBy(F.desc("w"), "own").limit(MAX_PATTERNS).select("own", F.lit(True).alias("big"))
    return shared.join(big, "own", "left").select("key", F.when(F.col("big"), F.col("own")).otherwise(F.col("fold")).alias("p"))


def _routed(slim: DataFrame, quota: DataFrame, most: int) -> DataFrame:
    """(p, source, source_size, target, base, rest) for each (pattern, source): all its rows
    go out `base` times, and rows of `rest` words once more. p is 0 for texts of one source."""
    spark = slim.sparkSession
    sums = staged(slim.groupBy("p", "source").agg(F.sum("size").alias("words")), "sums")
    # distinct words: by pattern, and for the texts of one source alone by source
    fresh = slim.groupBy("p", F.when(F.col("p") == 0, F.col("source")).alias("source"), "key").agg(F.max("size").alias("size"))
    once = staged(fresh.groupBy("p", "source").agg(F.sum("size").alias("once")), "once")
    ranked = sums.where("p != 0").groupBy("p").agg(F.sum("words").alias("w"), F.count(F.lit(1)).alias("k")).orderBy(F.desc("w"), "p").collect()  # MAX_PATTERNS + MAX_FOLDS rows
    chosen, cells = [], 0
    for r in ranked:
        if (cells := cells + r["k"]) > MAX_CELLS:
            break
        chosen.append(r["p"])
    kept = sums.where("p != 0").join(F.broadcast(spark.createDataFrame([(p,) for p in chosen], "p long")), "p")
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    overlapped = staged(kept.select("source").distinct(), "overlapped")
    # texts of one source, and those of patterns that are not kept apart, which count as such
    rest = sums.alias("a").join(kept.alias("b"), (F.col("a.p") == F.col("b.p")) & same("a", "b"), "left_anti").groupBy("source").agg(F.sum("words").alias("words"))
    alone = quota.alias("q").join(rest.alias("a"), same("q", "a")).join(once.where("p = 0").alias("o"), same("q", "o"), "left").selectExpr("q.source", "q.source_size", "q.target", "a.words", "greatest(coalesce(o.once, a.words), 1) as once")
    here = kept.alias("k").join(once.select("p", "once").alias("o"), "p").join(quota.alias("q"), same("k", "q")).selectExpr("p", "q.source", "q.source_size", "q.target", "k.words", "o.once")
    own = alone.alias("a").join(overlapped.alias("b"), same("a", "b"), "left_semi").select(F.lit(0).cast("long").alias("p"), "a.*")
    rows = here.unionByName(own).collect()  # MAX_CELLS rows of patterns, and one for each source in them
    name = {x: -1 - i for i, x in enumerate(dict.fromkeys(r["source"] for r in rows))}  # the texts of one source alone, a pattern of its own
    groups = [(("p", r["p"]) if r["p"] else ("s", name[r["source"]]), r["source"], r["words"], r["once"]) for r in rows]
    sent = route(groups, {r["source"]: round(r["target"]) for r in rows}, most)
    given = [sent[g[0], g[1]] for g in groups]
    columns = [[r[c] for r in rows] for c in ("p", "source", "source_size", "target", "words")] + [given]
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
    flowed = spark.createDataFrame(pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], ["p", "source", "source_size", "target", "words", "given"]))
    free = alone.alias("a").join(overlapped.alias("b"), same("a", "b"), "left_anti").select(F.lit(0).cast("long").alias("p"), "source", "source_size", "target", "words", F.rint("target").cast("long").alias("given"))
    split = lambda op: F.when(F.col("words") > 0, F.expr(f"given {op} words")).otherwise(0)
    return flowed.unionByName(free).select("p", "source", "source_size", "target", split("div").alias("base"), split("%").alias("rest"))


def _select(slim: DataFrame, plan: DataFrame, most: int) -> DataFrame:
    """slim with passes, source_size and target.

    Every document of a (pattern, source) gets `base` passes, and the first in
    the seeded order one more, up to the document with which their words come
    nearest to `rest`. Words are summed for ranges of the order, and again for
    parts of the one range in which `rest` is reached; only such a part, a
    millionth of its (pattern, source), is put in order row by row. What a source
    misses or has too much in the end is settled by SETTLED single documents.
    """
    known = small_side(plan.select("p", F.lit(True).alias("known")).distinct(), "known")
    slim = slim.join(known, "p", "left").withColumn("p", F.when(F.col("known"), F.col("p")).otherwise(0)).drop("known")
    on = F.expr("a.p = b.p and a.source <=> b.source")
    all_ = slim.alias("a").join(plan.alias("b"), on).selectExpr("a.*", "b.source_size", "b.target", "b.base", "b.rest", "0L as before")
    part = lambda i: F.expr(f"cast(shiftrightunsigned(u, {64 - BITS * (i + 1)}) & {(1 << BITS) - 1} as int)")
    edge, clear = all_, []
    for i in range(2):
        ranges = edge.groupBy("p", "source", part(i).alias("range")).agg(F.sum("size").alias("n"), F.first("rest").alias("rest"), F.first("before").alias("start"))
        ranges = ranges.withColumn("before", F.col("start") + F.sum("n").over(W.partitionBy("p", "source").orderBy("range")) - F.col("n"))
        cut = small_side(ranges.where("rest >= before and rest < before + n").select("p", "source", "range", "before"), "cut")
        met = edge.drop("before").withColumn("range", part(i)).alias("a").join(cut.alias("b"), on, "left").selectExpr("a.*", "b.range as cut", "b.before")
        clear.append(met.where("cut is null or range != cut").withColumn("more", F.coalesce(F.col("range") < F.col("cut"), F.lit(False))).drop("range", "cut", "before"))
        edge = met.where("range = cut").drop("range", "cut")
    before = F.coalesce(F.sum("size").over(W.partitionBy("p", "source").orderBy("u", "row").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + F.col("before")
    edge = edge.withColumn("more", 2 * before + F.col("size") <= 2 * F.col("rest")).drop("before")
    out = clear[0].unionByName(clear[1]).unionByName(edge)
    passes = F.when(F.col("size") > 0, F.least(F.col("base") + F.col("more").cast("long"), F.lit(most))).otherwise(0)
    out = staged(out.withColumn("passes", passes.cast("int")), "picked")
    for _ in range(SETTLED):
        out = _settled(out, most)
    return out


def _settled(out: DataFrame, most: int) -> DataFrame:
    """out with one pass more or less of that document of each source which brings its words nearest to the target."""
    gap = small_side(out.groupBy("source").agg((F.max("target") - F.sum(F.col("size") * F.col("passes"))).alias("gap")), "gap")
    each = out.alias("d").join(gap.alias("g"), F.expr("d.source <=> g.source")).where("d.size > 0").selectExpr("d.source", "d.size", "d.u", "d.row", "d.passes", "g.gap")
    step = F.when((F.col("gap") > 0) & (F.col("passes") < most), 1).when((F.col("gap") < 0) & (F.col("passes") > 0), -1)
    left = F.abs(F.col("gap") - step * F.col("size"))
    best = each.withColumns({"step": step, "left": left}).where(F.col("left") < F.abs("gap")).groupBy("source").agg(F.min(F.struct("left", "u", "row", "step")).alias("b"))
    best = small_side(best.select("b.row", "b.step"), "best")
    return out.join(best, "row", "left").withColumn("passes", F.col("passes") + F.coalesce("step", F.lit(0))).drop("step")


def take_mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: rows of docs as often as they are taken; the columns of docs, whatever their names.

    Rows are matched by (id, text, source); rows alike in all three go out
    together as often as the mix says for all of them. Texts without words are
    never taken; an empty table gives an empty result.
    """
    id_col, text_col, source_col, seed = (options.get(k, d) for k, d in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source"), ("seed", 42)))
    i, x, k, n, rank, passes, one = (free_name(c, docs.columns) for c in ("mix_id", "mix_source", "mix_key", "mix_rows", "mix_rank", "mix_passes", "mix_pass"))
    plan = mix(docs, **options).where("size > 0").groupBy(F.col("doc_id").alias(i), F.col("source").alias(x), F.col("key").alias(k)).agg(F.sum("passes").alias(passes), F.count(F.lit(1)).alias(n))
    plan = staged(plan.where(F.col(passes) > 0), "taken")
    own = free_name("mix_text", docs.columns)
    keyed = docs.withColumn(own, F.xxhash64(F.coalesce(F.col(text_col), F.lit("")), F.lit(seed)))
    same = F.col(id_col).cast("long").eqNullSafe(F.col(i)) & F.col(source_col).cast("string").eqNullSafe(F.col(x)) & (F.col(own) == F.col(k))
    both = keyed.join(plan.where(F.col(n) == 1), same)
    if plan.where(F.col(n) > 1).limit(1).count():
        many = keyed.join(plan.where(F.col(n) > 1), same).withColumn(rank, F.row_number().over(W.partitionBy(i, x, k).orderBy(k)))
        share = F.expr(f"`{passes}` div `{n}`") + (F.col(rank) <= F.col(passes) % F.col(n)).cast("int")
        both = both.unionByName(many.withColumn(passes, share).drop(rank).where(F.col(passes) > 0))
    return both.withColumn(one, F.explode(F.sequence(F.lit(1).cast("long"), F.col(passes)))).select(*docs.columns)


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "passes")


QUERIES = {"op2_mix": op2_mix}
