"""SentencePiece encoding that keeps every piece's place in the original bytes.

A text is normalised by the longest prefixes that the model's compiled character
map holds, and each normalised code point remembers the byte at which its source
began. The normalised text is cut where no piece of the vocabulary can cross;
each distinct word of a batch is merged once, by the model's own merges without
further normalisation, and the pieces, laid side by side over the normalised
text, are projected to byte spans of the original.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import shipped
from ._util import give_back, read_table

BATCH_CHARS = 4 << 20  # texts whose distinct words are looked up together, one text at least
OUT_TOKENS = 1 << 20  # tokens in a batch that is handed on, one text at least
KNOWN_WORDS = 400_000  # words that a process remembers from batch to batch
SPACE, SIGN = 0x20, 0x2581  # a blank, and the sign that stands for it in pieces
UNKNOWN, USER_DEFINED, BYTE = 2, 4, 6  # kinds of piece in the model file
BPE = 2

_models: dict = {}


def vocabulary_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _number(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value, shift, at = value | (byte & 127) << shift, shift + 7, at + 1
        if byte < 128:
            return value, at


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a message in protocol buffers' wire format; later fields override earlier ones."""
    at = 0
    while at < len(data):
        key, at = _number(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _number(data, at)
        else:
            size, at = _number(data, at) if kind == 2 else (8 if kind == 1 else 4, at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def field(number: int, value: int | bytes) -> bytes:
    """One field in wire format: a small whole number, or bytes."""

    def varint(x: int) -> bytes:
        out = bytearray()
        while x > 127:
            out.append(x & 127 | 128)
            x >>= 7
        return bytes([*out, x])

    return varint(number << 3) + varint(value) if isinstance(value, int) else varint(number << 3 | 2) + varint(len(value)) + value


def rules_of(compiled: bytes) -> dict[str, str]:
    """{source: replacement} of a compiled character map.

    The map is the size of a double-array trie, the trie's 32-bit units, and
    replacements that end in a zero byte. The trie is read level by level, all
    256 bytes of all its nodes at once.
    """
    if not compiled:
        return {}
    size = int.from_bytes(compiled[:4], "little")
    units, texts = np.frombuffer(compiled[4 : 4 + size], "<u4").astype(np.int64), compiled[4 + size :]
    step = (units >> 10) << ((units & 512) >> 6)
    places, keys, out = np.array([0]) ^ step[:1], [b""], {}
    while len(places):
        target = places[:, None] ^ np.arange(1, 256)[None, :]
        fits = target < len(units)
        fits &= (units[np.where(fits, target, 0)] & 0x800000FF) == np.arange(1, 256)[None, :]
        node, byte = np.nonzero(fits)
        at = target[node, byte]
        places, keys = at ^ step[at], [keys[n] + bytes([b + 1]) for n, b in zip(node.tolist(), byte.tolist())]
        for i in np.flatnonzero(units[at] >> 8 & 1).tolist():
            start = int(units[places[i]] & 0x7FFFFFFF)
            out[keys[i].decode()] = texts[start : texts.index(b"\0", start)].decode()
    return out


class Model:
    """A model file taken apart: normalisation rules and flags, pieces, and an
    encoder that leaves normalised text as it is."""

    def __init__(self, data: bytes):
        import sentencepiece

        pieces, trainer, spec = [], {}, {}
        for number, value in fields(data):
            if number == 1:
                pieces.append(dict(fields(value)))
            elif number == 2:
                trainer |= dict(fields(value))
            elif number == 3:
                spec |= dict(fields(value))
        self.rules = rules_of(spec.get(2, b""))
        self.prefix, self.squeeze, self.escape = (bool(spec.get(i, 1)) for i in (3, 4, 5))
        self.as_suffix = bool(trainer.get(24, 0))
        names, kinds = [p[1].decode() for p in pieces], np.array([p.get(3, 1) for p in pieces])
        # what a user defined stays as it is, and goes before the map's own rules
        self.kept = {n for n, k in zip(names, kinds) if k == USER_DEFINED}
        self.rules |= {n: n for n in self.kept}
        self.longest: dict[str, int] = {}
        for key in self.rules:
            self.longest[key[0]] = max(len(key), self.longest.get(key[0], 0))
        self.starts = np.zeros(0x110000, bool)
        self.starts[[ord(c) for c in self.longest]] = True
        self.lengths = np.array([len(n) for n in names])
        self.byte = np.array([int(n[3:5], 16) if k == BYTE else -1 for n, k in zip(names, kinds)])
        self.unknown = np.flatnonzero(kinds == UNKNOWN)
        # no merge crosses from another letter to a following sign if no piece does
        self.cuts = trainer.get(3, 1) == BPE and not any(re.search(f"[^{chr(SIGN)}]{chr(SIGN)}", n) for n in names)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=data)
        as_it_is = b"".join(field(i, v) for i, v in ((2, b""), (3, 0), (4, 0), (5, 0)))
        self.merger = sentencepiece.SentencePieceProcessor(model_proto=data + field(3, as_it_is))
        self.known: dict[str, list[int]] = {}


def model_of(path: str) -> Model:
    """The model of a file, read once in a process."""
    if path not in _models:
        with open(path, "rb") as f:
            _models[path] = Model(f.read())
    return _models[path]


def _replaced(text: str, points: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points after the rules, and for each where (in source code points) what it stands for began and ended."""
    hits = np.flatnonzero(m.starts[points]) if m.rules else ()
    parts, sources, ends, at = [], [], [], 0
    for i in map(int, hits):
        if i < at:
            continue
        found = [text[i : i + k] for k in range(min(m.longest[text[i]], len(text) - i), 0, -1)]
        key = next((k for k in found if k in m.kept), None) or next((k for k in found if k in m.rules), None)
        if key is None:
            continue
        new = np.frombuffer(m.rules[key].encode("utf-32-le"), "<u4")
        parts += [points[at:i], new]
        sources += [np.arange(at, i), np.full(len(new), i)]
        ends += [np.arange(at + 1, i + 1), np.full(len(new), i + len(key))]
        at = i + len(key)
    if not parts:
        return points, np.arange(len(points)), np.arange(1, len(points) + 1)
    rest = np.arange(at, len(points))
    return np.concatenate([*parts, points[at:]]), np.concatenate([*sources, rest]), np.concatenate([*ends, rest + 1])


def _after_blanks(points: np.ndarray, source: np.ndarray, ends: np.ndarray) -> int:
    """The source code point behind all that stands for single blanks at the start."""
    alone = (np.diff(source, prepend=-1) != 0) & (np.diff(source, append=-1) != 0)
    joined = source == np.concatenate([[0], ends[:-1]])  # nothing that was dropped lies between
    other = np.flatnonzero(~((points == SPACE) & alone & joined))
    k = int(other[0]) if len(other) else len(points)
    return int(ends[k - 1]) if k else 0


def _squeezed(points: np.ndarray, source: np.ndarray) -> np.ndarray:
    """Which code points stay when blanks at the start and blanks behind blanks
    go. Of blanks within one replacement only those go that lead it."""
    n = len(points)
    blank = points == SPACE
    index = np.arange(n)
    run = np.maximum.accumulate(np.where(blank, -1, index)) + 1  # where the run of blanks around each began
    own = np.searchsorted(source, source)  # where its replacement began
    return ~(blank & ((run < own) | (run == 0)))


def normalise(text: str, m: Model) -> tuple[str, np.ndarray]:
    """(normalised text, spans): spans[i] is the original byte at which the
    source of normalised code point i starts, and spans[-1] where the last ends."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    bytes_at = np.concatenate([[0], np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000))])
    new, source, ends = _replaced(text, points, m)
    begin, end = 0, len(points)
    if m.squeeze:
        begin = _after_blanks(new, source, ends)
        stay = _squeezed(new, source)
        new, source = new[stay], source[stay]
    if begin == end:  # nothing but blanks
        return "", bytes_at[-1:]
    if m.escape:
        new = np.where(new == SPACE, SIGN, new)
    space = SIGN if m.escape else SPACE
    if m.prefix and not m.as_suffix:
        new, source = np.concatenate([[space], new]), np.concatenate([[begin], source])
    if m.squeeze:
        last = np.flatnonzero(new != space)
        k = int(last[-1]) + 1 if len(last) else 0
        end = int(source[k]) if k < len(new) else end
        new, source = new[:k], source[:k]
    if m.prefix and m.as_suffix:
        new, source = np.append(new, space), np.append(source, end)
    return new.astype("<u4").tobytes().decode("utf-32-le"), bytes_at[np.append(source, end)]


def words_of(text: str, m: Model) -> list[str]:
    """A normalised text cut before each sign that follows something else; whole where pieces could cross there."""
    if not text:
        return []
    sign = chr(SIGN)
    if not m.cuts:
        return [text]
    parts = text.split(sign)
    if "" not in parts[1:]:
        return ([parts[0]] if parts[0] else []) + [sign + p for p in parts[1:]]
    return re.findall(f"{sign}*[^{sign}]+|{sign}+", text)


def piece_lengths(ids: np.ndarray, m: Model) -> np.ndarray:
    """Code points that each piece covers; of a code point spelt in bytes the last byte has it."""
    out, byte = m.lengths[ids], m.byte[ids]
    if (byte >= 0).any():
        goes_on = np.append((byte[1:] >= 0x80) & (byte[1:] < 0xC0), False)
        out = np.where(byte >= 0, np.where(goes_on, 0, 1), out)
    return out


def _merged(words: list[str], m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pieces of each word, all ids, code points of each piece) of normalised words; looked up where they are known."""
    if len(m.known) > KNOWN_WORDS:
        m.known.clear()
    new = [w for w in words if w not in m.known]
    for k in range(0, len(new), 4096):
        m.known.update(zip(new[k : k + 4096], m.merger.encode(new[k : k + 4096], num_threads=1)))
    table = [m.known[w] for w in words]
    sizes = np.fromiter(map(len, table), np.int64, len(table))
    flat = np.fromiter(chain.from_iterable(table), np.int32, int(sizes.sum()))
    covers = piece_lengths(flat, m)
    # what stands for letters that the model does not know covers as many as the library says
    first = np.cumsum(sizes) - sizes
    for i in np.unique(np.searchsorted(first + sizes, np.flatnonzero(np.isin(flat, m.unknown)), "right")).tolist():
        covers[first[i] : first[i] + sizes[i]] = [len(p) for p in m.merger.encode(words[i], out_type=str)]
    return sizes, flat, covers


def encode_batch(texts: list[str], m: Model) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, first bytes, end bytes) for each text; each distinct word is merged once."""
    place, indices, spans = defaultdict(count().__next__), [], []
    for text in texts:
        normal, at = normalise(text, m)
        words = words_of(normal, m)
        indices.append(np.fromiter(map(place.__getitem__, words), np.int64, len(words)))
        spans.append(at)
    sizes, flat, covers = _merged(list(place), m)
    first = np.cumsum(sizes) - sizes
    for index, at in zip(indices, spans):
        size = sizes[index]
        where = np.repeat(first[index] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        ends = np.cumsum(covers[where])
        yield flat[where], at[ends - covers[where]].astype(np.int32), at[ends].astype(np.int32)


def encode_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, starts, ends, decoded) for each row of docs.

    ids: as the library encodes the whole text, without begin and end ids.
    starts, ends: the bytes of the original UTF-8 text that each piece stands
    for, ends exclusive; a piece that stands for nothing in the text (the sign
    put in front; all bytes but the last of a code point spelt in bytes) has an
    empty span. decoded: the library's text for the ids. A null or empty text
    has no ids and decodes to the empty text; bytes that are not UTF-8 are read
    as U+FFFD, and spans then count the text so mended; repeated rows give rows
    of their own; an empty table gives an empty one; other columns are not read.
    """
    path = path or vocabulary_path()
    text = F.make_valid_utf8(F.coalesce(F.col(text_col), F.lit("")))
    slim = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    numbers = pa.list_(pa.int32())

    def handed(batch: pa.RecordBatch, m: Model) -> Iterator[pa.RecordBatch]:
        rows, held, first = [], 0, 0

        def ready(to: int) -> pa.RecordBatch:
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(r[0]) for r in rows])]), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([r[i] for r in rows]), pa.int32())).cast(numbers) for i in range(3)]
            decoded = pa.array([m.library.decode(r[0].tolist()) for r in rows], pa.string())
            return pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, to - first), *lists, decoded], ["doc_id", "ids", "starts", "ends", "decoded"])

        for i, row in enumerate(encode_batch(batch.column("text").to_pylist(), m)):
            if rows and held + len(row[0]) > OUT_TOKENS:
                yield ready(i)
                rows, held, first = [], 0, i
            rows.append(row)
            held += len(row[0])
        if rows:
            yield ready(batch.num_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model_of(path)
        for batch in batches:
            size = pa.compute.utf8_length(batch.column("text")).to_numpy()
            at, ends = 0, np.cumsum(size, dtype=np.int64)
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BATCH_CHARS, "right")))
                yield from handed(batch.slice(at, to - at), m)
                at = to
        m.known.clear()
        give_back()

    kind = slim.schema["doc_id"].dataType.simpleString()
    return shipped(slim).mapInArrow(run, f"doc_id {kind}, ids array<int>, starts array<int>, ends array<int>, decoded string")


def decode_ids(coded: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded) for arrays of ids; null arrays and null ids in them stand for no piece."""
    path = path or vocabulary_path()
    ids = F.filter(F.coalesce(F.col(ids_col).cast("array<int>"), F.array().cast("array<int>")), lambda x: x.isNotNull())
    slim = coded.select(F.col(id_col).alias("doc_id"), ids.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model_of(path)
        for b in batches:
            decoded = pa.array([m.library.decode(x.as_py()) for x in b.column("ids")], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), decoded], ["doc_id", "decoded"])

    return shipped(slim).mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, decoded string")


def op12_piece_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_documents(read_table(spark, sf_dir, "documents"))
    n, ids = F.size("ids").cast("long"), F.concat_ws(",", F.col("ids").cast("array<string>"))
    return out.select("doc_id", n.alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


QUERIES = {"op12_piece_spans": op12_piece_spans}
