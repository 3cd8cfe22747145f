"""SimHash near-duplicates found with BK-trees.

A text gets a 64-bit fingerprint from its word shingles. Equal fingerprints are
merged first. Of radius + k bands of bits two fingerprints within `radius`
differing bits agree on at least k, so the values of any k bands name a shard:
all fingerprints with these values, kept as one BK-tree (children keyed by the
integer Hamming distance to the parent). k is chosen by the number of
fingerprints, so that shards stay small in large tables; no link is missed for
any k. A fingerprint asks the trees of its own shards and follows only edges
whose key is within the radius of its distance to the node. Broadcast trees
would have to pass through the driver with the fingerprints of all documents:
instead each shard's tree is built in the task to which the shuffle deals its
shard, and its queries are dealt to the same task. A shard of more than
SHARD_MOST fingerprints is dealt as pairs of blocks, so no task holds a group
without bound.

For a wanted similarity (Jaccard of the shingle sets) the texts that the trees
join are candidates, and every pair of such a group that is not joined yet is held
against the whole shingle sets before it counts. Texts may be that similar and yet
differ in more bits than the radius; these are looked for besides, in shards named
by bands of MinHash values: the chance that a pair is seen there depends on its
similarity alone, not on the number of texts. Only confirmed links of a group are
reduced to a forest. Groups of more than SETS_MOST sets are dealt as pairs of blocks.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import shipped
from ._util import connected_components, free_name, give_back, numpy_components, read_table, small_side, staged

SHINGLES_AT_ONCE = 1 << 18
PAIRS_AT_ONCE = 1 << 21
BANDS, BAND_ROWS = 20, 6  # MinHash bands: of pairs at a similarity of 0.8 the share (1 - 0.8**6)**20 = 0.0023 meets in none
SHARD_MOST = 1 << 17  # fingerprints of a shard that are searched in one piece
SETS_MOST = 1 << 13  # shingle sets of a shard that are compared in one piece
KEY_COST = 64  # dealing a fingerprint to one more shard costs as much as so many steps in a tree


_draw = random.Random(0)
_TIMES, _PLUS = (np.array([_draw.getrandbits(64) | odd for _ in range(BANDS * BAND_ROWS)], np.uint64)[:, None] for odd in (1, 0))


def fingerprint(text: str | None, words_per_shingle: int = 4, seed: int = 42, shingles: bool = False) -> int | tuple[int, np.ndarray]:
    """The fingerprint, 0 for a text without words; a bit is 1 if it is set in over half the shingle hashes.

    With shingles also the distinct upper halves of all the hashes, sorted.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # ASCII case and ASCII white space only
    if not words:
        return (0, np.empty(0, "<u4")) if shingles else 0
    n = max(1, len(words) - words_per_shingle + 1)
    joined = b" ".join(words)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends[: n - 1])]
    ends = ends[words_per_shingle - 1 :] or ends[-1:]
    ones, hashed, parts = np.zeros(64, np.int64), xxhash.xxh64_intdigest, []
    for i in range(0, n, SHINGLES_AT_ONCE):
        h = np.array([hashed(joined[s:e], seed) for s, e in zip(starts[i : i + SHINGLES_AT_ONCE], ends[i : i + SHINGLES_AT_ONCE])], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        if shingles:
            parts.append((h >> np.uint64(32)).astype("<u4"))
    fp = int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])
    return (fp, np.unique(np.concatenate(parts))) if shingles else fp


def bands(shingles: np.ndarray) -> list[int]:
    """A signed key for each band of MinHash values; none for an empty set."""
    if not len(shingles):
        return []
    least, wide = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64), shingles.astype(np.uint64)
    for i in range(0, len(wide), 4096):
        least = np.minimum(least, (wide[i : i + 4096] * _TIMES + _PLUS).min(axis=1))
    keys = [xxhash.xxh64_intdigest(v.tobytes(), i) for i, v in enumerate(least.reshape(BANDS, BAND_ROWS))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 4, seed: int = 42, shingles: bool = False) -> DataFrame:
    """(id, text_key, fp): the fingerprint as a signed long; text_key tells equal texts. Null texts count as empty.

    With shingles also (set_key, bands, shingles): set_key tells equal shingle sets.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("text_key"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signed = lambda x: pa.array(np.array(x, dtype=np.uint64).view(np.int64))
        for b in batches:
            found = [fingerprint(t.as_py(), words_per_shingle, seed, shingles) for t in b.column("text")]
            fps, more, sets, raw = found, [], [], []
            if shingles:
                fps, sets = [f for f, _ in found], [x for _, x in found]
                raw = [x.tobytes() for x in sets]
                more = [signed([xxhash.xxh64_intdigest(x) for x in raw]), pa.array([bands(x) for x in sets], pa.list_(pa.int64())), pa.array(raw, pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("text_key"), signed(fps), *more], ["id", "text_key", "fp", *["set_key", "bands", "shingles"][: len(more)]])
            del found, more, sets, raw
        if shingles:
            give_back()

    return shipped(slim).mapInArrow(run, "id long, text_key long, fp long" + ", set_key long, bands array<long>, shingles binary" * shingles)


def _forest(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """BK-trees of all shards at once, level by level.

    values: fingerprints sorted by shard; first[i]: the place of the first
    fingerprint of i's shard, the root. Returns the edges as sorted keys
    65 * parent + distance and the children's places.
    """
    item, node = np.arange(len(values)), first.copy()
    item, node = item[item != node], node[item != node]
    keys, children = [], []
    while len(item):
        key = node * 65 + np.bitwise_count(values[item] ^ values[node])
        key_set, at, inverse = np.unique(key, return_index=True, return_inverse=True)
        keys.append(key_set)
        children.append(item[at])
        node = item[at][inverse]
        item, node = item[item != node], node[item != node]
    if not keys:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    key, child = np.concatenate(keys), np.concatenate(children)
    by = np.argsort(key, kind="stable")
    return key[by], child[by]


def _search(values: np.ndarray, first: np.ndarray, size: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), i < j, of one shard that join what all pairs within the radius join; found by walking the trees.

    Queries go in runs whose shard sizes sum to PAIRS_AT_ONCE, and of a run's
    pairs a forest is kept that joins what earlier runs did not: what is held at
    a time is bounded, however many pairs there are.
    """
    keys, child = _forest(values, first)
    names, at = np.unique(values, return_inverse=True)
    label, kept = np.arange(len(names)), [(first[:0], first[:0])]
    run = np.cumsum(size) // PAIRS_AT_ONCE
    for lo, hi in zip(*(lambda cut: (cut[:-1], cut[1:]))(np.concatenate([[0], np.flatnonzero(np.diff(run)) + 1, [len(values)]]))):
        q, node, found = np.arange(lo, hi), first[lo:hi], []
        while len(q):
            d = np.bitwise_count(values[q] ^ values[node]).astype(np.int64)
            hit = (d <= radius) & (q < node) & (label[at[q]] != label[at[node]])
            found.append((q[hit], node[hit]))
            low = np.searchsorted(keys, node * 65 + np.maximum(d - radius, 0))
            high = np.searchsorted(keys, node * 65 + np.minimum(d + radius, 64), side="right")
            n = high - low
            offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            q, node = np.repeat(q, n), child[np.repeat(low, n) + offset]
        a, b = (np.concatenate(x) for x in zip(*found))
        pick = spanning_forest(len(names), label[at[a]], label[at[b]])
        if len(pick):
            kept.append((a[pick], b[pick]))
            label = numpy_components(len(names), label[at[a[pick]]], label[at[b[pick]]])[label]
    return tuple(np.concatenate(x) for x in zip(*kept))


def spanning_forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of links that join what all the links a[i]-b[i] join, n - 1 at most (Boruvka's rounds)."""
    label, kept, place = np.arange(n), [np.empty(0, np.int64)], np.arange(len(a))
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return np.concatenate(kept)
        a, b, la, lb, place = a[apart], b[apart], la[apart], lb[apart], place[apart]
        first = np.full(n, len(a))
        np.minimum.at(first, la, np.arange(len(a)))
        np.minimum.at(first, lb, np.arange(len(a)))
        pick = np.unique(first[first < len(a)])
        kept.append(place[pick])
        label = numpy_components(n, la[pick], lb[pick])[label]


def bands_agreed(radius: int, rows: int) -> int:
    """The number k of bands, of radius + k, whose values name a shard: the cheapest for so many fingerprints.

    A fingerprint is in comb(radius + k, k) shards, and k / (radius + k) of its
    bits name one.
    """
    cost = lambda k: math.comb(radius + k, k) * (KEY_COST + rows / 2.0 ** (64 * k // (radius + k)))
    return min(range(1, max(2, min(8, 65 - radius))), key=cost)


def shard_masks(radius: int, k: int) -> list[int]:
    """The bits that name shards, a mask for each choice of k among radius + k bands: within the radius one agrees at least."""
    cuts = [round(64 * i / (radius + k)) for i in range(radius + k + 1)]
    band = [(1 << hi) - (1 << lo) for lo, hi in zip(cuts, cuts[1:])]
    return [sum(chosen) for chosen in combinations(band, k)]


def split_large(held: DataFrame, key: str, most: int) -> DataFrame:
    """held (key, shard) with every shard of more than `most` rows replaced by smaller ones in which any two of its rows still meet.

    Rows fall into blocks by hash of the key, and every two blocks are a shard.
    """
    sizes = held.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    large = small_side(sizes.select("shard", F.ceil(2 * F.col("n") / most).cast("int").alias("blocks")), "large")
    own = F.pmod(F.xxhash64(key, F.lit(1)), "blocks").cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: j != F.col("own"))
    cells = F.transform(others, lambda j: F.xxhash64("shard", F.least("own", j), F.greatest("own", j)))
    dealt = held.join(large, "shard", "left").withColumn("own", own)
    return dealt.select(key, F.explode(F.when(F.col("blocks").isNull(), F.array("shard")).otherwise(cells)).alias("shard"))


def near_links(distinct: DataFrame, radius: int = 4) -> DataFrame:
    """Links (a, b) that join what all links of at most `radius` differing bits between the fingerprints of column fp join.

    A task's pairs are reduced to a spanning forest, so at most one link for
    each fingerprint and run of shards comes out.
    """
    masks = shard_masks(radius, bands_agreed(radius, distinct.count()))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    shard = F.transform(F.array(*[F.lit(signed(m)) for m in masks]), lambda m, i: F.xxhash64(i, F.col("fp").bitwiseAND(m)))
    held = distinct.select("fp", F.explode(shard).alias("shard"))
    dealt = split_large(held, "fp", SHARD_MOST).repartition("shard").sortWithinPartitions("shard")

    def linked(shards: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        start = np.flatnonzero(np.concatenate([[True], shards[1:] != shards[:-1]]))
        size = np.diff(np.concatenate([start, [len(shards)]]))
        first, each = np.repeat(start, size), np.repeat(size, size)
        kept = each > 1
        if kept.any():
            moved = np.cumsum(kept) - 1
            values = fps[kept].view(np.uint64)
            a, b = _search(values, moved[first[kept]], each[kept], radius)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(values[x].view(np.int64)) for x in (a, b)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, fps = np.empty(0, np.int64), np.empty(0, np.int64)
        for b in batches:
            shards, fps = np.concatenate([shards, b.column("shard").to_numpy()]), np.concatenate([fps, b.column("fp").to_numpy()])
            if len(shards) > SHARD_MOST:  # whole shards go; the last one may not be complete
                cut = int(np.searchsorted(shards, shards[-1]))
                if cut:
                    yield from linked(shards[:cut], fps[:cut])
                shards, fps = shards[cut:], fps[cut:]
        if len(shards):
            yield from linked(shards, fps)
        shards = fps = None
        give_back()

    return shipped(dealt).mapInArrow(run, "a long, b long")


def confirmed(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Places (i, j) of sets, len(sets) - 1 at most, that join what all pairs of at least the similarity join.

    A pair is left out only if its sets are joined already or if their sizes
    rule it out. Sets go in runs of about PAIRS_AT_ONCE values.
    """
    size = np.array([len(x) for x in sets])
    label, links = np.arange(len(sets)), []
    for i in range(len(sets) - 1):
        low, high = np.minimum(size[i + 1 :], size[i]), np.maximum(size[i + 1 :], size[i])
        rest = i + 1 + np.flatnonzero((label[i + 1 :] != label[i]) & (low >= similarity * high))
        if not len(rest):
            continue
        run = np.cumsum(size[rest]) // PAIRS_AT_ONCE
        for others in np.split(rest, np.flatnonzero(np.diff(run)) + 1):
            flat = np.concatenate([sets[j] for j in others])
            at = np.minimum(np.searchsorted(sets[i], flat), size[i] - 1)
            both = np.add.reduceat((sets[i][at] == flat).astype(np.int64), np.cumsum(size[others]) - size[others])
            hit = others[both >= similarity * (size[i] + size[others] - both)]
            joined, first = np.unique(label[hit], return_index=True)
            links += [(i, int(j)) for j, g in zip(hit[first], joined) if g != label[i]]
            label[np.isin(label, joined)] = label[i]
    return links


def tree_groups(distinct: DataFrame, radius: int) -> DataFrame:
    """(shard, set_key): the shingle sets whose fingerprints the BK-trees join, equal ones included.

    Any two fingerprints within the radius are in one group, so no such pair is left out.
    """
    links = near_links(distinct.select("fp").distinct(), radius)
    root = connected_components(links).select(F.col("node").alias("fp"), "root")
    return distinct.join(root, "fp", "left").select(F.xxhash64(F.lit("tree"), F.coalesce("root", "fp")).alias("shard"), "set_key")


def similar_links(prints: DataFrame, distinct: DataFrame, similarity: float, radius: int = 4) -> DataFrame:
    """Links (a, b) between set_keys that join the shingle sets of at least the similarity (Jaccard).

    distinct: (set_key, fp, row), row one in prints that has the set.
    Sets that the trees join are a shard, and so are those that share a band; of
    shards with the same members one is taken. Shards come sorted, so a task
    holds the sets of one at a time, and of a shard with more than SETS_MOST sets
    those of two blocks.
    """
    banded = prints.select(F.explode("bands").alias("shard"), "set_key")
    held = tree_groups(distinct, radius).unionByName(banded).repartition("shard").distinct()
    members = held.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("set_key")).alias("x"), F.bit_xor(F.xxhash64("set_key", F.lit(1))).alias("y"))
    taken = members.where("n > 1").groupBy("n", "x", "y").agg(F.min("shard").alias("shard"))
    shards = staged(held.join(taken.select("shard"), "shard", "left_semi"), "shards")
    wanted = distinct.join(shards.select("set_key").distinct(), "set_key", "left_semi").groupBy("set_key").agg(F.min("row").alias("row"))
    sets = prints.select("row", "set_key", "shingles").join(wanted.select("row"), "row", "left_semi").drop("row")
    dealt = split_large(shards, "set_key", SETS_MOST).join(sets, "set_key").repartition("shard").sortWithinPartitions("shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(keys: list[int], raw: list[bytes]) -> tuple[list[int], list[int]]:
            pairs = confirmed([np.frombuffer(x, "<u4") for x in raw], similarity)
            return [keys[i] for i, _ in pairs], [keys[j] for _, j in pairs]

        shard, keys, raw = None, [], []
        for batch in (whole.slice(i, 512) for whole in batches for i in range(0, whole.num_rows, 512)):
            a, b = [], []
            for s, k, x in zip(*(batch.column(c).to_pylist() for c in ("shard", "set_key", "shingles"))):
                if s != shard:
                    for out, new in zip((a, b), linked(keys, raw)):
                        out += new
                    shard, keys, raw = s, [], []
                keys.append(k)
                raw.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in linked(keys, raw)], ["a", "b"])
        keys, raw = [], []
        give_back()

    return shipped(dealt).mapInArrow(run, "a long, b long")


def _grouped(docs: DataFrame, radius: int, id_col: str, text_col: str, words_per_shingle: int, seed: int, similarity: float | None) -> DataFrame:
    """(id, text_key, fp, root, component_id) for each row of docs; root names the component."""
    prints = staged(fingerprints(docs, id_col, text_col, words_per_shingle, seed, similarity is not None).withColumn("row", F.monotonically_increasing_id()), "prints")
    node = "fp" if similarity is None else "set_key"
    distinct = staged(prints.groupBy(*{node, "fp"}).agg(F.min("id").alias("least"), F.min("row").alias("row")), "distinct")
    if similarity is None:
        links = near_links(distinct.select("fp"), radius)
    else:
        links = similar_links(prints, distinct, similarity, radius)
    root = connected_components(links).select(F.col("node").alias(node), "root")
    named = distinct.groupBy(node).agg(F.min("least").alias("least")).join(root, node, "left").withColumn("root", F.coalesce("root", node))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(named.select(node, "root").join(least, "root"), node).select("id", "text_key", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, radius: int = 4, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 4, seed: int = 42, similarity: float | None = None) -> DataFrame:
    """(id, text_key, fp, component_id) for each row of docs.

    component_id: the smallest id reachable over links of at most `radius`
    differing bits or, if a similarity is given, over links of at least the
    similarity, among all pairs that the trees join at the radius and those that
    share a band; without a similarity rows with equal fingerprints are linked. Null and empty texts have fingerprint 0 and are linked like any
    other. A null id takes part and gets its component's smallest id that is not
    null (null if there is none). Repeated rows give repeated results; an empty
    table gives none; other columns are not read.
    """
    return _grouped(docs, radius, id_col, text_col, words_per_shingle, seed, similarity).select("id", "text_key", "fp", "component_id")


def keep_one(docs: DataFrame, similarity: float = 0.8, words_per_shingle: int = 5, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, radius: int = 4) -> DataFrame:
    """docs without near-duplicates: of each group the row with the smallest id stays.

    Groups are those of near_duplicates: fingerprints within `radius` bits are
    found by the trees, and only texts of at least the similarity are linked.

    Of a group whose rows all have a null id, one of the rows with the least text
    key stays. Of rows alike in id and text one stays; rows that share an id but
    not the group are judged each by itself. All columns of docs pass, whatever
    their names.
    """
    dup_id, dup_key, dup_text = (free_name(n, docs.columns) for n in ("_dup_id", "_dup_key", "_dup_text"))
    found = _grouped(docs, radius, id_col, text_col, words_per_shingle, seed, similarity)
    found = staged(found.select(F.col("id").alias(dup_id), F.col("text_key").alias(dup_key), "component_id", "root"), "groups")
    nameless = found.where("component_id is null").groupBy("root").agg(F.min(dup_key).alias("least"))
    others = found.where("component_id is null").join(nameless, "root").where(F.col(dup_key) != F.col("least"))
    later = found.where(F.col("component_id").isNotNull() & ~F.col(dup_id).eqNullSafe(F.col("component_id")))
    gone = later.select(dup_id, dup_key).unionByName(others.select(dup_id, dup_key)).distinct()
    keyed = docs.withColumn(dup_text, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    same = F.col(id_col).cast("long").eqNullSafe(F.col(dup_id)) & (F.col(dup_text) == F.col(dup_key))
    kept = keyed.join(gone, same, "left_anti")
    if found.groupBy(dup_id, dup_key).count().where("count > 1").limit(1).count():
        kept = kept.dropDuplicates([id_col, dup_text])
    return kept.select(*docs.columns)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op7_simhash": op7_simhash}
