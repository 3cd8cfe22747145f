"""Sharding, mixing, vectors, pages, the pipeline."""

import random
import zlib

import numpy as np
import pytest
from llm_cases import ODD
from pyspark.sql import functions as F

from cohortlens.llm import ann, html_text, mixing, near_dup_vectors, sharding
from cohortlens.llm._util import connected_components

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_permutation(spark, n):
    df = spark.range(n).select(F.col("id").alias("p"))
    got = [r["p"] for r in sharding.permuted(df, n, 42).collect()]
    assert sorted(got) == list(range(n))


@pytest.mark.parametrize("n", [5, 97, 1000])
def test_places_against_a_plain_feistel(spark, n):
    """The place of each row number, walked one by one in Python, gives its shard and slot."""
    seed, shards = 42, 24
    a, b = sharding.domain(n)
    keys = sharding.round_keys(seed)
    sides = sorted({(x, k) for x in range(max(a, b)) for k in keys})
    rows = spark.createDataFrame(sides, "x long, k long").select("x", "k", F.xxhash64("x", "k").alias("h")).collect()
    hashed = {(r["x"], r["k"]): r["h"] for r in rows}

    def once(p):
        left, right = divmod(p, b)
        for i, k in enumerate(keys):
            if i % 2 == 0:
                left = (left + hashed[right, k] % a) % a
            else:
                right = (right + hashed[left, k] % b) % b
        return left * b + right

    def place(p):
        p = once(p)
        while p >= n:
            p = once(p)
        return p

    numbered = spark.range(n).select(F.col("id").alias("row"), F.col("id").alias("p"))
    got = {r["row"]: r["p"] for r in sharding.permuted(numbered, n, seed).collect()}
    assert got == {i: place(i) for i in range(n)}
    assert sorted((p % shards, p // shards) for p in got.values()) == sorted((i % shards, i // shards) for i in range(n))


def laws(rows, shards):
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    counts = [len(slots.get(s, [])) for s in range(shards)]
    assert max(counts) - min(counts) <= 1 and all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_op3(spark):
    out = sharding.op3_feistel_shards(spark, SF).collect()
    text = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    laws(out, 24)
    assert all(r["size"] == len(text[r["doc_id"]]) + 8 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]]) and r["law"] == "rows" and r["grown_shard"] is None for r in out)
    again = sharding.op3_feistel_shards(spark, SF).collect()
    key = lambda rows: sorted((r["doc_id"], r["shard"], r["slot"]) for r in rows)
    assert key(out) == key(again)


def test_shards_odd_rows(spark, docs):
    rows = sharding.shard_documents(docs(ODD).withColumn("p", F.lit(1)), 4).collect()
    assert len(rows) == len(ODD)
    laws(rows, 4)
    assert sharding.shard_documents(docs([]), 4).count() == 0
    other = sharding.shard_documents(docs(ODD).repartition(3), 4).collect()
    key = lambda rows: sorted((str(r["doc_id"]), r["text_crc32"], r["shard"], r["slot"]) for r in rows)
    assert key(rows) == key(other)


def test_targets(spark):
    def of(sizes):
        return {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}

    assert of([("a", 100), ("b", 100), (None, 100)]) == pytest.approx({"a": 187.5, "b": 75.0, None: 37.5})
    got = of([("a", 10), ("b", 100), ("c", 100)])
    assert got["a"] == 30 and sum(got.values()) == pytest.approx(210)
    assert of([]) == {} and of([("a", 0)]) == {"a": 0}
    rng = random.Random(1)
    sizes = {s: rng.choice([0, 1, 50, 4000]) for s in {chr(rng.randrange(65, 0x3000)) * rng.randint(1, 3) for _ in range(300)}}
    left, open_, want = float(sum(sizes.values())), sorted(sizes), {}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(open_)}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = [s for s in open_ if share[s] > 3 * sizes[s]]
        want |= {s: 3.0 * sizes[s] for s in full} if full else share
        left -= sum(3 * sizes[s] for s in full)
        open_ = [s for s in open_ if s not in want]
    assert of(list(sizes.items())) == pytest.approx(want)


def brute_cost(groups, quota, sent):
    """Cost of repeating: the k-th pass over a pattern's distinct words costs k - 1 each (up to 4 passes)."""
    total = 0
    for p in {g[0] for g in groups}:
        once, out, cost = max(g[3] for g in groups if g[0] == p), sum(f for (q, _), f in sent.items() if q == p), 0
        while out > 0:
            total += min(out, once) * cost
            out, cost = out - once, cost + 1
    return total


@pytest.mark.parametrize("seed", range(6))
def test_flow_is_cheapest(seed):
    rng = random.Random(seed)
    groups = [(0, "a", w := rng.randint(1, 4), w), (1, "b", v := rng.randint(1, 4), v), (2, "a", x := rng.randint(1, 3), x), (2, "b", x, x)]
    room = {s: 3 * sum(g[2] for g in groups if g[1] == s) for s in "ab"}
    quota = {s: rng.randint(0, min(room[s], 9)) for s in "ab"}
    sent = mixing.route(groups, quota)
    for s in "ab":
        assert sum(f for (_, q), f in sent.items() if q == s) == quota[s]
    assert all(0 <= f <= 3 * next(g[2] for g in groups if g[:2] == k) for k, f in sent.items())
    best = min(
        brute_cost(groups, quota, {(0, "a"): i, (2, "a"): quota["a"] - i, (1, "b"): j, (2, "b"): quota["b"] - j})
        for i in range(3 * groups[0][2] + 1) for j in range(3 * groups[1][2] + 1)
        if 0 <= quota["a"] - i <= 3 * groups[2][2] and 0 <= quota["b"] - j <= 3 * groups[3][2]
    )
    assert brute_cost(groups, quota, sent) == best


def test_op2(spark):
    out = mixing.op2_mix(spark, "/root/testdata/sf0.01").collect()
    source = {r["doc_id"]: r["source"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    taken, target = {}, {}
    for r in out:
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[source[r["doc_id"]]] = taken.get(source[r["doc_id"]], 0) + r["taken"]
        target[source[r["doc_id"]]] = r["target"]
    assert len(out) == 1000 and all(abs(taken[s] - t) <= 0.03 * t for s, t in target.items())
    again = {r["doc_id"]: r["taken"] for r in mixing.op2_mix(spark, "/root/testdata/sf0.01").collect()}
    assert again == {r["doc_id"]: r["taken"] for r in out}


def near_targets(out):
    """Taken words and targets by source; no source may miss by more than half its largest document."""
    taken, target, largest = {}, {}, {}
    for r in out:
        s = r["source"]
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["size"] * r["passes"]
        taken[s], target[s], largest[s] = taken.get(s, 0) + r["taken"], r["target"], max(largest.get(s, 0), r["size"])
    assert sum(target.values()) == pytest.approx(sum(r["size"] for r in out))
    for s, t in target.items():
        assert abs(taken[s] - t) <= largest[s] / 2 + 1, (s, taken[s], t)
    return taken


def test_mix_of_repeated_rows(spark, docs):
    rows = [(7, "three words here", "a")] * 300 + [(i, f"own {i} text of some words {'x ' * (i % 9)}", "ab"[i % 2]) for i in range(100)] + [(1000 + i, "a copy in both sources", "ab"[i % 2]) for i in range(400)]
    near_targets(mixing.mix(docs(rows)).collect())
    got = mixing.take_mix(docs(rows)).groupBy("doc_id").count().collect()
    plan = {}
    for r in mixing.mix(docs(rows)).collect():
        plan[r["doc_id"]] = plan.get(r["doc_id"], 0) + r["passes"]
    assert {r["doc_id"]: r["count"] for r in got} == {i: n for i, n in plan.items() if n}


@pytest.mark.parametrize("cells", [200_000, 50])
def test_mix_of_thousands_of_patterns(spark, monkeypatch, docs, cells):
    monkeypatch.setattr(mixing, "MAX_CELLS", cells)
    monkeypatch.setattr(mixing, "MAX_PATTERNS", 1500)
    rng = random.Random(3)
    pairs = [(a, b) for a in range(64) for b in range(a)][:2000]
    rows = [(2 * i + j, f"shared text number {i} " + "w " * (i % 7), f"s{x:02}") for i, p in enumerate(pairs) for j, x in enumerate(p)]
    rows += [(10_000 + i, f"own text {i} " + "v " * rng.randint(0, 40), f"s{rng.randrange(64):02}") for i in range(3000)]
    near_targets(mixing.mix(docs(rows)).collect())


def test_mix_of_many_sources(spark, docs):
    made = spark.range(100_000).selectExpr("id as doc_id", "concat('text ', id, repeat(' w', int(id % 5))) as text", "concat('s', id) as source")
    row = mixing.mix(made).selectExpr("sum(size) as size", "sum(target) as target", "sum(int(abs(taken - target) > size / 2 + 1)) as far", "sum(int(taken > 3 * size)) as over", "count(*) as n").first()
    assert row["n"] == 100_000 and row["far"] == 0 and row["over"] == 0 and row["target"] == pytest.approx(row["size"])


def test_flow_of_copies_in_thousands():
    groups = [("p", "a", 3000, 1), ("p", "b", 3000, 1), ("s", "a", 100, 100), ("t", "b", 5000, 5000)]
    quota = {"a": 3 * 3100, "b": 4000}
    sent = mixing.route(groups, quota)
    assert sent == {("p", "a"): 9000, ("s", "a"): 300, ("p", "b"): 0, ("t", "b"): 4000}


def test_mix_odd_rows(spark, docs):
    out = mixing.mix(docs(ODD).withColumn("passes", F.lit("x"))).collect()
    assert len(out) == len(ODD) and all(r["taken"] <= 3 * r["size"] for r in out)
    assert mixing.mix(docs([])).count() == 0 and mixing.take_mix(docs([])).count() == 0
    made = docs([(i, f"word{i} and more", "ab"[i % 2]) for i in range(200)] + [(500 + i, "the same text in both", "ab"[i % 2]) for i in range(20)])
    got = mixing.take_mix(made)
    assert got.columns == made.columns
    plan = {r["doc_id"]: r["passes"] for r in mixing.mix(made).collect()}
    seen = {r["doc_id"]: r["n"] for r in got.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert seen == {i: n for i, n in plan.items() if n}


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)]
    label = {i: i for ab in links for i in ab if ab[0] != ab[1]}
    for _ in range(100):
        for a, b in links:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == label


def blobs(seed, n, dim=16):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(12, dim))
    x = centers[rng.integers(0, 12, n)] + rng.normal(size=(n, dim)) * rng.choice([0.05, 0.3], n)[:, None]
    x[5] = x[4]
    return x.astype(np.float32)


def vec_frame(spark, x):
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    odd = [(1000, None, 0), (1001, [0.0] * x.shape[1], 0), (1002, [float("nan")] * x.shape[1], 0), (1003, [None] * x.shape[1], 0), (1004, [1.0], 0), (1005, [], 0)]
    return spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")


def unit(x):
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("cell,block", [(2048, 4096), (40, 16)])
def test_vector_links_against_brute_force(spark, monkeypatch, cell, block):
    monkeypatch.setattr(near_dup_vectors, "CELL_ROWS", cell)
    monkeypatch.setattr(near_dup_vectors, "BLOCK", block)
    x = blobs(1, 400)
    s = unit(x) @ unit(x).T
    link = (s >= 0.9) & ~np.eye(len(x), dtype=bool)
    label = np.arange(len(x))
    while not np.array_equal(new := np.minimum(label, np.where(link, label[None, :], 10**6).min(axis=1)), label):
        label = new
    got = {r["id"]: (r["n_links"], r["component_id"]) for r in near_dup_vectors.near_duplicates(vec_frame(spark, x)).collect()}
    assert {i: got[i] for i in range(len(x))} == {i: (int(link[i].sum()), int(label[i])) for i in range(len(x))}
    assert all(got[i] == (0, i) for i in range(1000, 1006))


def test_vectors_empty(spark):
    none = vec_frame(spark, blobs(1, 10)).where("vec_id >= 1000 and vec_id != 1004")
    assert near_dup_vectors.near_duplicates(none).count() == 5 and near_dup_vectors.near_duplicates(none.limit(0)).count() == 0
    assert ann.search(none, F.col("id") % 2 == 0).count() == 0


def test_search_recall(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 64)
    x = blobs(2, 1200)
    df = vec_frame(spark, x).where("vec_id < 1000 or vec_id > 1005")
    ids = [i for i in range(1200) if i < 1000 or i > 1005]
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], 0) for i in ids], df.schema).unionByName(vec_frame(spark, x[:1]).where("vec_id >= 1000"))
    got = {}
    for r in ann.search(df, F.col("id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    u, hit = unit(x), 0
    for q in (i for i in ids if i % 50 == 0):
        s = {i: float(u[q] @ u[i]) for i in ids if i != q}
        best = sorted(s, key=lambda i: (-s[i], i))[:5]
        assert len(got[q]) == 5 and all(abs(s[i] - v) < 1e-12 for i, v in got[q])
        hit += len(set(best) & {i for i, _ in got[q]})
    assert hit >= 0.9 * 5 * len(got) and 1000 not in {i for v in got.values() for i, _ in v}


def test_search_ties_and_few(spark):
    df = spark.createDataFrame([(50, [1.0, 0.0]), (3, [0.0, 1.0]), (2, [0.0, 2.0]), (None, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = [(r["rank"], r["vec_id"]) for r in ann.search(df, F.col("id") % 50 == 0).orderBy("rank").collect()]
    assert got == [(1, None), (2, 2), (3, 3)]


def test_repeated_queries_and_ids(spark):
    near, far = [1.0, 0.0, 0.0], [0.0, 0.0, 1.0]
    df = spark.createDataFrame([(50, near), (50, [0.9, 0.1, 0.0]), (1, [0.5, 0.5, 0.0]), (1, [0.5, 0.5, 0.0]), (2, far)], "vec_id long, embedding array<double>")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.search(df, F.col("id") % 50 == 0).collect()]
    assert sorted(got) == sorted(2 * [(50, 1, 50), (50, 2, 1), (50, 3, 1), (50, 4, 2)])


def test_router_prunes_where_vectors_have_groups(spark):
    rng = np.random.default_rng(7)
    centre = rng.normal(size=(40, 24))
    x = unit(centre[rng.integers(0, 40, 6000)] + 0.15 * rng.normal(size=(6000, 24)))
    router, share = ann.fit_router(x[:4000], ann.part_count(6000, 4000), 5, 0.97)
    order, before = router.parts_of(x)
    size = np.bincount(order[:, 0], minlength=router.parts)
    asked = np.arange(0, 6000, 50)
    visits = [order[q][before[q] <= share] for q in asked]
    s = x[asked] @ x.T
    s[np.arange(len(asked)), asked] = -2
    hit = [order[j, 0] in v for v, row in zip(visits, s) for j in np.argsort(-row)[:5]]
    assert np.mean(hit) >= 0.9 and np.mean([size[v].sum() for v in visits]) < 0.25 * 6000
    assert size.max() < 2 * size.mean()


def test_recall_on_the_table(spark):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").toArrow()
    ids, x = rows.column("vec_id").to_pylist(), unit(np.array(rows.column("embedding").to_pylist(), float))
    got = {}
    for r in ann.op6_ann(spark, sf).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    asked = [i for i, v in enumerate(ids) if v % 50 == 0]
    s = x[asked] @ x.T
    s[np.arange(len(asked)), asked] = -2
    hit = [ids[j] in got[ids[i]] for i, row in zip(asked, s) for j in np.argsort(-row)[:5]]
    assert len(got) == len(asked) and np.mean(hit) >= 0.9
    assert ann.part_count(len(ids), len(ids)) > 20


def test_blocks():
    page = '<html><body><nav><ul><li><a href="/">x</a></ul></nav><script>var t="</p>";</script><article><h1>T&amp;C</h1><p><b>one\n two<br><p>three &lt;b&gt;<!-- no --></article><p>un<b>clo</b>sed'
    assert [b.text for b in html_text.leaf_blocks(page)] == ["x", "T&C", "one two", "three <b>", "unclosed"]
    for broken in ("", "<", "<p", "<!-- ", "<script>", "</p></p>", "a<b", "<div class='x", "&amp &#65; &nope;"):
        html_text.leaf_blocks(broken)
    assert html_text.leaf_blocks("1 < 2 &amp &#65;")[0].text == "1 < 2 & A"


def test_lstm_gradient():
    rng = np.random.default_rng(0)
    m = html_text.BiLstm(4, 3, 1)
    x, y, lengths = rng.normal(size=(2, 5, 4)), rng.integers(0, 2, (2, 5)).astype(float), np.array([5, 3])
    mask = (np.arange(5)[None, :] < lengths[:, None]).astype(float)

    def loss():
        p = m.forward(x, lengths)
        return -(mask * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / mask.sum()

    traces = []
    p = m.forward(x, lengths, traces)
    one, two, both, _ = traces
    d = ((p - y) * mask / mask.sum())[:, :, None]
    back = d @ m.w[2].T
    grads = [m._back(m.w[0], x, one, back[:, :, :3]), m._back(m.w[1], x[:, ::-1], two, back[:, ::-1, 3:6]), (both * d).sum(axis=(0, 1))[:, None]]
    for k, g in enumerate(grads):
        for at in [(0, 0), (g.shape[0] - 1, g.shape[1] - 1), (g.shape[0] // 2, 0)]:
            old = m.w[k][at]
            m.w[k][at] = old + 1e-6
            up = loss()
            m.w[k][at] = old - 1e-6
            down = loss()
            m.w[k][at] = old
            assert (up - down) / 2e-6 == pytest.approx(g[at], abs=1e-6)


def test_labeller_holds_out():
    model, rng, right, total = html_text.labeller(), random.Random(77), 0, 0
    for _ in range(150):
        blocks = html_text.leaf_blocks(html_text.example_page(rng))
        y = np.array(["@@" in b.text for b in blocks])
        p = html_text.label_pages([[b._replace(text=b.text.replace("@@", "") or "-") for b in blocks]], model)[0] >= 0.5
        right, total = right + (p == y).sum(), total + len(y)
    assert right / total > 0.98


def test_op8_and_odd_pages(spark):
    import html as h
    import re

    out = {r["page_id"]: r for r in html_text.op8_html_text(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inner = r["html"][r["html"].index("<article>") : r["html"].index("</article>")]
        blocks = [re.sub(r"\s+", " ", h.unescape(re.sub(r"<[^>]+>", " ", q))).strip() for q in re.split(r"<(?:p|h1)>", inner)]
        want = "\n".join(b for b in blocks if b)
        assert out[r["page_id"]]["text"] == want and out[r["page_id"]]["n_chars"] == len(want)
    pages = spark.createDataFrame([(1, None, None), (2, "u", ""), (2, "u", ""), (None, "u", "<p"), (3, "u", "<article><p>" + "long text. " * 20000 + "</article>")], "page_id long, text string, html string")
    got = html_text.extract(pages.withColumnRenamed("text", "url"), ["page_id", "url"]).collect()
    assert len(got) == 5 and sorted(len(r["text"]) for r in got)[-1] > 200000
    assert html_text.extract(pages.limit(0).withColumnRenamed("text", "url"), ["page_id"]).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as pipe

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen, left = docs, docs.count()
    for name, stage in pipe.STAGES[:-1]:
        path = str(tmp_path / name)
        stage(spark, seen, SF).write.parquet(path)
        seen = spark.read.parquet(path)
        assert seen.columns == docs.columns
        assert name == "mixing" or 0.5 * left < seen.count() <= left
        left = seen.count()
    assert pipe.STAGES[-1][1](spark, seen, SF).count() == left
    assert pipe.run(spark, SF).count() == left
    odd = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in ODD], docs.schema)
    for name, stage in pipe.STAGES:
        assert stage(spark, odd.limit(0), SF).count() == 0
        stage(spark, odd, SF).collect()
