"""BPE encoding and decoding through a distinct-word table.

Texts are cut at spaces, tabs and line breaks, where no token can cross, into
words. A chunk (some MB of texts read by one task) lists its distinct words and
stores each text as places in that list. The chunks' words are dealt by hash, so
that all that chunks ask about a word meets in one task, which encodes each
distinct word once and holds a bounded number of them. The ids go back to the chunk, there to the texts by
position; an id-to-piece table, joined in memory, turns ids back into text.
Chunks are staged in buckets, so the texts' places are never shuffled.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import shipped
from ._util import give_back, read_table, staged_buckets

TEXT_CHARS = 24 << 20  # a chunk ends beyond so many characters ...
WORDS = 250_000  # ... or distinct words, but holds a text at least
OUT_BYTES = 2 << 20
WORDS_AT_ONCE = 1 << 17  # words of a text whose ids are gathered at a time
KNOWN_BYTES = 256 << 20  # a task that holds encoded words beyond this lets go of those not asked about just now
MOST_PARTS = 4096
MID = 128 + 64 * 256  # places from here take three bytes
LONG = MID + 64 * 65536  # and beyond this all are written plainly

_tokenizers: dict = {}


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer(path: str):
    """The tokenizer of a file without truncation and padding, loaded once in a process."""
    if path not in _tokenizers:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _tokenizers[path] = t
    return _tokenizers[path]


def split_words(text: str) -> list[str]:
    """Pieces between spaces, tabs and line breaks; an empty one has no ids. Other white space stays inside words."""
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


def _pack(x: bytes | np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(x if isinstance(x, bytes) else x.tobytes())


def _unpack(x: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(x)


def _planes(x: np.ndarray) -> bytes:
    """32-bit numbers by byte planes, which pack better."""
    return _pack(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T))


def _from_planes(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_unpack(x), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _pack_places(flat: np.ndarray, n: int) -> tuple[bytes, np.ndarray]:
    """Places of n words packed, and the order that the words must get.

    Words that occur once (most of them) are all written 0, as they come in
    order; the others are numbered from 1 by falling count and written in one
    to three bytes, each in a plane of its own.
    """
    counts = np.bincount(flat, minlength=n)
    often, once = np.flatnonzero(counts > 1), np.flatnonzero(counts == 1)
    often = often[np.argsort(-counts[often], kind="stable")]
    rank = np.zeros(n, np.int32)
    rank[often] = np.arange(1, len(often) + 1)
    f, order = rank[flat], np.concatenate([often, once])
    head = np.array([len(often), len(flat)], "<u8").tobytes()
    if len(often) >= LONG:
        return head + _planes(f), order
    mid = f >= 128
    second, head_byte = f[mid], f.astype(np.uint8)
    long = second >= MID
    third = second[long] - MID
    lead = (128 + (second - 128 >> 8)).astype(np.uint8)
    lead[long] = 192 + (third >> 16)
    head_byte[mid] = lead
    low = (second - 128).astype(np.uint8)
    low[long] = (third >> 8).astype(np.uint8)
    packed = [_pack(x) for x in (head_byte, low, third.astype(np.uint8))]
    return head + b"".join(np.array([len(x)], "<u8").tobytes() + x for x in packed), order


def _unpack_places(blob: bytes) -> np.ndarray:
    often, n = (int(x) for x in np.frombuffer(blob[:16], "<u8"))
    if often >= LONG:
        f = _from_planes(blob[16:]).astype(np.int32)
    else:
        planes, at = [], 16
        for _ in range(3):
            size = int(np.frombuffer(blob[at : at + 8], "<u8")[0])
            planes.append(np.frombuffer(_unpack(blob[at + 8 : at + 8 + size]), np.uint8))
            at += 8 + size
        f = planes[0].astype(np.int32)
        mid = planes[0] >= 128
        lead, low = f[mid], planes[1].astype(np.int32)
        second, long = 128 + (lead - 128 << 8) + low, lead >= 192
        second[long] = MID + (lead[long] - 192 << 16) + (low[long] << 8) + planes[2]
        f[mid] = second
    once = np.flatnonzero(f == 0)
    f[once] = np.arange(often + 1, often + 1 + len(once))
    f -= 1
    return f


def _words_blob(words: list[str]) -> bytes:
    """Words hold no line breaks, so these can divide them."""
    return _pack("\n".join(words).encode("utf-8", "surrogatepass"))


def chunks(docs: DataFrame, parts: int, id_col: str, text_col: str) -> DataFrame:
    """(chunk, ids, counts, places, owners, asked): texts as places in their
    chunk's list of words; for each place the part that its word is dealt to;
    and for each part its words in order of place."""
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    asked = pa.list_(pa.struct([("part", pa.int32()), ("words", pa.binary())]))
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary(), asked]
    names = ["chunk", "ids", "counts", "places", "owners", "asked"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32

        def flush() -> pa.RecordBatch:
            words, flat = list(place), np.concatenate(places)
            place.clear()  # neither is needed further, and both are large
            places.clear()
            packed, order = _pack_places(flat, len(words))
            del flat
            words = [words[i] for i in order.tolist()]
            owner = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) % parts for w in words), np.uint32, len(words))
            lists = [{"part": int(p), "words": _words_blob([words[i] for i in np.flatnonzero(owner == p)])} for p in np.unique(owner)]
            row = [chunk, ids, counts, packed, _planes(owner), lists]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], names)

        def fresh() -> tuple:
            return defaultdict(count().__next__), [], [], [], 0

        place, ids, counts, places, held = fresh()
        for batch in batches:
            for i, t in zip(batch.column("id"), batch.column("text")):
                text = t.as_py()
                if ids and (held + len(text) > TEXT_CHARS or len(place) > WORDS):
                    yield flush()
                    (place, ids, counts, places, held), chunk = fresh(), chunk + 1
                    give_back()
                words = split_words(text)
                places.append(np.fromiter(map(place.__getitem__, words), np.uint32, len(words)))
                ids.append(i.as_py())
                counts.append(len(words))
                held += len(text)
            batch = i = t = text = words = None  # else this batch is held while the next is read
        if ids:
            yield flush()
        place, places = None, None
        give_back()

    return shipped(slim).mapInArrow(run, "chunk long, ids array<long>, counts array<int>, places binary, owners binary, asked array<struct<part: int, words: binary>>")


def encode_words(asked: DataFrame, path: str) -> DataFrame:
    """(chunk, part, lengths, codes) for (chunk, part, words) dealt by part: a
    task remembers its distinct words, up to KNOWN_BYTES, and encodes each of
    them once (one that it had to let go, once more when it is asked about again)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, known, held = tokenizer(path), {}, 0
        for b in batches:
            for at in range(b.num_rows):
                words = _unpack(b.column("words")[at].as_py()).decode("utf-8", "surrogatepass").split("\n")
                if held > KNOWN_BYTES:
                    known = {w: known[w] for w in words if w in known}
                    held = sum(200 + len(w) + len(c) for w, c in known.items())
                new = [w for w in words if w not in known]
                for k in range(0, len(new), 4000):
                    part = new[k : k + 4000]
                    known.update(zip(part, (np.array(x.ids, "<u4").tobytes() for x in t.encode_batch_fast(part, add_special_tokens=False))))
                codes = [known[w] for w in words]
                held += sum(200 + len(w) + len(known[w]) for w in new)
                lengths = np.fromiter(map(len, codes), np.uint32, len(codes)) // 4
                row = [b.column("chunk").slice(at, 1), b.column("part").slice(at, 1), pa.array([_planes(lengths)], pa.binary()), pa.array([_planes(np.frombuffer(b"".join(codes), "<u4"))], pa.binary())]
                yield pa.RecordBatch.from_arrays(row, ["chunk", "part", "lengths", "codes"])
        known = new = codes = None
        give_back()

    return shipped(asked).mapInArrow(run, "chunk long, part int, lengths binary, codes binary")


def id_to_piece(path: str) -> list[str]:
    """The piece of each id of a vocabulary file; as long as the vocabulary."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    piece = {i: p for p, i in data["model"]["vocab"].items()} | {x["id"]: x["content"] for x in data["added_tokens"]}
    return [piece.get(i, "") for i in range(max(piece) + 1)]


def _coded_texts(row: dict, pieces: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(doc_id, n_tokens, ids, decoded) of a chunk's texts, OUT_BYTES or a text at a time.

    Ids are gathered from the chunk's one array by where each word's begin, so no
    word has an object of its own; a text is gathered WORDS_AT_ONCE words at a time.
    """
    places, out, held, at = _unpack_places(row["places"]), [], 0, 0  # first, as it takes most on the way
    order = np.argsort(_from_planes(row["owners"]), kind="stable")
    lengths = np.concatenate([_from_planes(x["lengths"]) for x in row["coded"]])
    flat = np.concatenate([_from_planes(x["codes"]) for x in row["coded"]])
    size, begin = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
    size[order] = lengths
    begin[order] = np.cumsum(lengths, dtype=np.int64) - lengths
    del order, lengths
    for i, k in zip(row["ids"], row["counts"]):
        code, text = [], []
        for first in range(at, at + k, WORDS_AT_ONCE):
            p = places[first : min(first + WORDS_AT_ONCE, at + k)]
            n = size[p]
            ids = flat[np.arange(n.sum()) + np.repeat(begin[p] - np.cumsum(n) + n, n)]
            code.append(ids.tobytes())
            text.append("".join(pieces[ids].tolist()))
        at += k
        code, text = b"".join(code), "".join(text)[1:]
        out.append((i, len(code) // 4, code, text))
        held += len(code) + len(text)
        if held > OUT_BYTES:
            yield _batch_of(out)
            out, held = [], 0
    if out:
        yield _batch_of(out)


def _batch_of(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.string()))], ["doc_id", "n_tokens", "ids", "decoded"])


def encode_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) for each row of docs.

    ids: little-endian unsigned 32-bit integers, one after the other; decoded:
    the text that they decode to, pieces joined by single spaces as the library
    does for a vocabulary file without a decoder. A null or empty text has no ids
    and decodes to the empty text. Null ids, repeated rows and other columns do
    no harm: texts are told apart by position, and only the two named columns
    are read. An empty table gives an empty result.
    """
    spark, path = docs.sparkSession, path or vocabulary_path()
    parts = min(MOST_PARTS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    held = staged_buckets(chunks(docs, parts, id_col, text_col), "chunks", "chunk", parts)
    asked = held.select("chunk", F.explode("asked").alias("a")).select("chunk", "a.part", "a.words")
    back = encode_words(asked.repartition(parts, "part"), path)
    lists = back.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("part", "lengths", "codes"))).alias("coded"))
    both = held.drop("asked").join(lists.hint("merge"), "chunk").select("ids", "counts", "places", "owners", "coded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = np.array([f" {p}" for p in id_to_piece(path)], dtype=object)
        for batch in batches:
            for at in range(batch.num_rows):
                yield from _coded_texts(batch.slice(at, 1).to_pylist()[0], pieces)
                give_back()

    return shipped(both).mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")


def decode_ids(coded: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded) for ids as little-endian 32-bit integers; null ids decode to the empty text.

    The id-to-piece table is as long as the vocabulary and goes to every task.
    """
    path = path or vocabulary_path()
    slim = coded.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(ids_col), F.lit(b"")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = np.array(id_to_piece(path), dtype=object)
        for b in batches:
            text = [" ".join(pieces[np.frombuffer(x.as_py(), "<u4")]) for x in b.column("ids")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(text, pa.string())], ["doc_id", "decoded"])

    return shipped(slim).mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, decoded string")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_documents(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


QUERIES = {"op4_bpe": op4_bpe}
