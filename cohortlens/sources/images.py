"""Image files: reading PNG to pixels, checking PNG and JPEG to their last byte, and a sink that commits as a whole.

Files are listed and read by Spark (so in any store that Spark knows) and decoded
in the tasks, batch by batch; nothing but the columns asked for leaves a task.
"""

from __future__ import annotations

import contextlib
import hashlib
import struct
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..shipping import shipped

PNG_SIGN = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}  # fixed values: samples of a pixel by PNG colour type
DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}  # fixed values: bits of a sample


class Broken(ValueError):
    """A file that does not hold what its kind demands; the message says what."""


# ---- PNG


def png_chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(kind, body) of each chunk up to IEND; checksums, order of the ends and lengths are checked."""
    if data[:8] != PNG_SIGN:
        raise Broken("no PNG signature")
    at, kind = 8, b""
    while kind != b"IEND":
        if at + 12 > len(data):
            raise Broken("the file ends within a chunk")
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if at + 12 + size > len(data):
            raise Broken("the file ends within a chunk")
        if zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise Broken(f"checksum of {kind.decode('latin-1')}")
        if at == 8 and kind != b"IHDR":
            raise Broken("the first chunk is no header")
        yield kind, body
        at += 12 + size


@dataclass
class PngHeader:
    width: int
    height: int
    depth: int
    colour: int
    interlaced: int

    @classmethod
    def of(cls, body: bytes) -> PngHeader:
        if len(body) != 13:
            raise Broken("the header has another length")
        width, height, depth, colour, packing, filtering, interlaced = struct.unpack(">IIBBBBB", body)
        if not width or not height or colour not in DEPTHS or depth not in DEPTHS[colour] or packing or filtering or interlaced > 1:
            raise Broken("the header has values that PNG does not know")
        return cls(width, height, depth, colour, interlaced)

    def passes(self) -> list[tuple[int, int, int, int, int, int]]:
        """(first column, column step, first row, row step, width, height) of each pass over the image."""
        if not self.interlaced:
            return [(0, 1, 0, 1, self.width, self.height)]
        grid = [(0, 8, 0, 8), (4, 8, 0, 8), (0, 4, 4, 8), (2, 4, 0, 4), (0, 2, 2, 4), (1, 2, 0, 2), (0, 1, 1, 2)]  # fixed values: Adam7
        sized = [(x, dx, y, dy, -(-(self.width - x) // dx), -(-(self.height - y) // dy)) for x, dx, y, dy in grid]
        return [p for p in sized if p[4] > 0 and p[5] > 0]

    def row_bytes(self, width: int) -> int:
        return -(-width * CHANNELS[self.colour] * self.depth // 8)


def _unfiltered(kind: int, row: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """A row of bytes from its differences: to nothing, to the left, above, their mean, or the nearest of three."""
    if kind == 0:
        return row
    if kind == 2:
        return row + above
    if kind == 1:
        wide = np.zeros(-(-len(row) // step) * step, np.uint8)
        wide[: len(row)] = row
        return np.cumsum(wide.reshape(-1, step), axis=0, dtype=np.uint8).ravel()[: len(row)]
    if kind not in (3, 4):
        raise Broken(f"row filter {kind}")
    out, up, raw = [0] * len(row), above.tolist(), row.tolist()
    for i, x in enumerate(raw):
        a, b = (out[i - step] if i >= step else 0), up[i]
        if kind == 3:
            guess = a + b >> 1
        else:
            c = up[i - step] if i >= step else 0
            pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            guess = a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c
        out[i] = x + guess & 255
    return np.array(out, np.uint8)


def _samples(row: np.ndarray, depth: int, n: int) -> np.ndarray:
    """n samples of a row of bytes."""
    if depth == 8:
        return row[:n]
    if depth == 16:
        return row.view(">u2")[:n]
    bits = np.unpackbits(row).reshape(-1, depth)
    return (bits @ (1 << np.arange(depth)[::-1])).astype(np.uint8)[:n]


def decode_png(data: bytes, pixels: bool = True) -> tuple[PngHeader, np.ndarray | None]:
    """The header, and an array (height, width, channels) of samples; with a palette
    its colours. Without pixels the whole file is checked all the same, down to the
    number of bytes that its rows have, but rows are not undone."""
    header, packed, palette = None, [], None
    for kind, body in png_chunks(data):
        if kind == b"IHDR":
            header = PngHeader.of(body)
        elif kind == b"PLTE":
            if not body or len(body) % 3:
                raise Broken("the palette has another length")
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
    if header.colour == 3 and palette is None:
        raise Broken("there is no palette")
    passes = header.passes()
    want = sum((1 + header.row_bytes(w)) * h for *_, w, h in passes)
    unpacker = zlib.decompressobj()
    try:
        raw = unpacker.decompress(b"".join(packed), want + 1)  # no more than one byte too many is ever unpacked
    except zlib.error as e:
        raise Broken("pixel data cannot be unpacked") from e
    if len(raw) != want:
        raise Broken("pixel data have another length")
    stream, at, channels = np.frombuffer(raw, np.uint8), 0, CHANNELS[header.colour]
    if not pixels:
        for *_, w, h in passes:
            kinds = stream[at : at + (1 + header.row_bytes(w)) * h : 1 + header.row_bytes(w)]
            if (kinds > 4).any():
                raise Broken(f"row filter {int(kinds.max())}")
            at += (1 + header.row_bytes(w)) * h
        return header, None
    out = np.zeros((header.height, header.width, channels), np.uint16 if header.depth == 16 else np.uint8)
    step = max(1, channels * header.depth // 8)
    for x, dx, y, dy, w, h in passes:
        above = np.zeros(header.row_bytes(w), np.uint8)
        for i in range(h):
            above = _unfiltered(int(stream[at]), stream[at + 1 : at + 1 + len(above)], above, step)
            out[y + i * dy, x::dx] = _samples(above, header.depth, w * channels).reshape(w, channels)
            at += 1 + len(above)
    if header.colour == 3:
        if out.max() >= len(palette):
            raise Broken("a pixel is beyond the palette")
        out = palette[out[:, :, 0]]
    return header, out


def encode_png(pixels: np.ndarray, filters: tuple[int, ...] = (2,)) -> bytes:
    """A PNG of an array (height, width[, 1, 3 or 4]) of 8 or 16 bits; rows take the filters in turn."""
    x = pixels if pixels.ndim == 3 else pixels[:, :, None]
    height, width, channels = x.shape
    colour = {1: 0, 2: 4, 3: 2, 4: 6}[channels]
    depth = 16 if x.dtype.itemsize == 2 else 8
    flat = np.ascontiguousarray(x.astype(">u2") if depth == 16 else x.astype(np.uint8)).reshape(height, -1).view(np.uint8)
    step, rows, above = channels * depth // 8, [], np.zeros(flat.shape[1], np.uint8)
    for i, row in enumerate(flat):
        left, corner = (np.concatenate([np.zeros(step, np.uint8), r[:-step]]) for r in (row, above))
        a, b, c = (v.astype(np.int32) for v in (left, above, corner))
        near = np.select([(abs(b - c) <= abs(a - c)) & (abs(b - c) <= abs(a + b - 2 * c)), abs(a - c) <= abs(a + b - 2 * c)], [a, b], c)
        kind = filters[i % len(filters)]
        rows.append(bytes([kind]) + (row - np.array([np.zeros_like(a), a, b, a + b >> 1, near][kind]).astype(np.uint8)).tobytes())
        above = row
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, 0)
    return PNG_SIGN + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(rows))) + chunk(b"IEND", b"")


# ---- JPEG

FRAMES = {*range(0xC0, 0xD0)} - {0xC4, 0xC8, 0xCC}  # fixed values: markers that start a frame
ALONE = {0x01, *range(0xD0, 0xD8)}  # fixed values: markers without a body


def walk_jpeg(data: bytes) -> tuple[int, int, int]:
    """(width, height, channels) of a JPEG whose segments are whole, from its start to the end-of-image marker.

    Entropy-coded data are passed over up to the next marker; they are not decoded.
    """
    if data[:2] != b"\xff\xd8":
        raise Broken("no JPEG signature")
    at, frame, scans, tables = 2, None, 0, set()
    while True:
        if at >= len(data) or data[at] != 0xFF:
            raise Broken("no marker where one must stand" if at < len(data) else "the file ends before its end marker")
        while at < len(data) and data[at] == 0xFF:  # fill bytes
            at += 1
        if at >= len(data):
            raise Broken("the file ends before its end marker")
        marker, at = data[at], at + 1
        if marker == 0xD9:
            break
        if marker in ALONE:
            continue
        if marker in (0x00, 0xD8):
            raise Broken(f"marker {marker:02x} out of place")
        size = int.from_bytes(data[at : at + 2], "big")
        if size < 2 or at + size > len(data):
            raise Broken("the file ends within a segment")
        body, at = data[at + 2 : at + size], at + size
        if marker in FRAMES:
            if frame or len(body) < 6 or len(body) != 6 + 3 * body[5]:
                raise Broken("the frame header is not right")
            frame = int.from_bytes(body[3:5], "big"), int.from_bytes(body[1:3], "big"), body[5]
            if not frame[0] or not frame[2]:
                raise Broken("the frame is empty")
        elif marker in (0xC4, 0xDB):
            tables.add(marker)
        elif marker == 0xDA:
            if frame is None or 0xDB not in tables or not body or len(body) != 4 + 2 * body[0]:
                raise Broken("a scan without its frame or tables")
            scans, start = scans + 1, at
            at = data.find(b"\xff", at)
            while at >= 0 and at + 1 < len(data) and (data[at + 1] == 0 or 0xD0 <= data[at + 1] <= 0xD7):
                at = data.find(b"\xff", at + 2)
            if at < 0 or at + 1 >= len(data):
                raise Broken("the file ends within a scan")
            if at == start:
                raise Broken("a scan without data")
    if frame is None or not scans:
        raise Broken("no image before the end marker")
    return frame


# ---- reading


def examine(data: bytes | None, pixels: bool) -> dict:
    """What read_images says of one file."""
    out = dict.fromkeys(("kind", "width", "height", "channels", "pixels", "error"))
    try:
        if data is None:
            raise Broken("no content")
        if data[:8] == PNG_SIGN:
            out["kind"] = "png"
            header, x = decode_png(data, pixels)
            out |= {"width": header.width, "height": header.height, "channels": 3 if header.colour == 3 else CHANNELS[header.colour]}
            out["pixels"] = None if x is None else x.ravel().astype(np.int32)
        elif data[:2] == b"\xff\xd8":
            out["kind"] = "jpeg"
            out["width"], out["height"], out["channels"] = walk_jpeg(data)
        else:
            raise Broken("neither PNG nor JPEG")
    except Broken as e:
        out["error"] = str(e)
    return out


READ = "path string, length long, kind string, width int, height int, channels int, pixels array<int>, valid boolean, error string"


def read_images(spark: SparkSession, path: str, pixels: bool = True, glob: str = "*") -> DataFrame:
    """(path, length, kind, width, height, channels, pixels, valid, error) for each file below path
    that has a byte (Spark's readers pass over the others).

    Every file is read to its end and checked: PNG by signature, order and
    checksum of its chunks, the unpacked length and row filters; JPEG by its
    segments up to the end marker, without decoding its scans. What fails is not
    valid, with the reason in error. pixels: samples of PNG row by row, channels
    side by side; null for JPEG, for broken files, and if not asked for.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", "length", "content")
    names = [f.split(" ")[0] for f in READ.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.bool_(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # an image at a time, so memory is bounded by the largest
                found = examine(batch.column("content")[i].as_py(), pixels)
                row = {"path": batch.column("path")[i].as_py(), "length": batch.column("length")[i].as_py(), **found, "valid": found["error"] is None}
                yield pa.RecordBatch.from_arrays([pa.array([row[n]], k) for n, k in zip(names, kinds)], names)

    return shipped(files).mapInArrow(run, READ)


def encoded(df: DataFrame, pixels: str = "pixels", width: str = "width", height: str = "height", to: str = "content", channels: int = 1, bits: int = 8) -> DataFrame:
    """df with a PNG of each row's pixels (whole numbers, row by row) in a new column; null
    where pixels are null or are not as many as the size says."""
    kind = np.uint16 if bits == 16 else np.uint8
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    x, w, h = (df.columns.index(c) for c in (pixels, width, height))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, 16) for i in range(0, whole.num_rows, 16)):
                out = []
                for values, across, down in zip(batch.column(x), batch.column(w).to_pylist(), batch.column(h).to_pylist()):
                    flat = values.values.to_numpy(zero_copy_only=False) if values.is_valid else None
                    fits = flat is not None and across and down and len(flat) == across * down * channels
                    out.append(encode_png(flat.astype(kind).reshape(down, across, channels)) if fits else None)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, to])

    return shipped(df).mapInArrow(run, f"{schema}, `{to}` binary")


# ---- sink


@dataclass
class Written(WriterCommitMessage):
    folder: str


class ImageFiles(DataSource):
    """Sink `cohortlens_images`: a file for each row (name, content) of a DataFrame.

    A task writes into a folder of its own below <path>/_started/<job>. Only when
    all tasks are through does the driver move their files to path, and then puts
    _SUCCESS there; if one fails, what the others wrote is removed and path is as
    before. Names must be new: mode append refuses names that are there, mode
    overwrite replaces them, and neither takes a name twice. A null content or
    name is an error. The driver lists the folders one by one, and holds eight
    bytes for each file.
    """

    @classmethod
    def name(cls) -> str:
        return "cohortlens_images"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> ImageWriter:
        return ImageWriter(self.options["path"], overwrite, schema)


class ImageWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool, schema: StructType):
        missing = {"name", "content"} - set(schema.names)
        if missing:
            raise ValueError(f"columns {sorted(missing)} are missing")
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex

    def _store(self) -> tuple[pa.fs.FileSystem, str]:
        return pa.fs.FileSystem.from_uri(self.path) if ":/" in self.path else (pa.fs.LocalFileSystem(), self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = self._store()
        folder, seen = f"{root}/_started/{self.job}/{uuid.uuid4().hex}", set()
        store.create_dir(folder, recursive=True)
        try:
            for batch in iterator:
                for name, content in zip(batch.column("name").to_pylist(), batch.column("content")):
                    if not name or not content.is_valid or "/" in name or name.startswith(("_", ".")) or name in seen:
                        raise ValueError(f"{name!r} cannot be written")
                    with store.open_output_stream(f"{folder}/{name}") as f:
                        f.write(content.as_buffer())
                    seen.add(name)
        except BaseException:
            store.delete_dir(folder)
            raise
        return Written(folder)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = self._store()
        folders = [m.folder for m in messages if m is not None]
        names = lambda folder: [x.base_name for x in store.get_file_info(pa.fs.FileSelector(folder))]
        marks, there = [], []
        for folder in folders:
            own = names(folder)
            marks.append(np.array([int.from_bytes(hashlib.blake2b(n.encode(), digest_size=8).digest(), "big") for n in own], np.uint64))
            if not self.overwrite and own:
                there += [x.base_name for x in store.get_file_info([f"{root}/{n}" for n in own]) if x.type != pa.fs.FileType.NotFound]
        mark, count = np.unique(np.concatenate(marks) if marks else np.empty(0, np.uint64), return_counts=True)
        twice = []
        if (count > 1).any():
            many = Counter(n for f, m in zip(folders, marks) if np.isin(m, mark[count > 1]).any() for n in names(f))
            twice = [n for n, k in many.items() if k > 1]
        if there or twice:
            self.abort(messages)
            raise ValueError(f"names that are there already: {sorted(there)[:5]}, or twice: {sorted(twice)[:5]}")
        for folder in folders:
            for n in names(folder):
                store.move(f"{folder}/{n}", f"{root}/{n}")
        self._clear(store, root)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/_SUCCESS"):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*self._store())

    def _clear(self, store: pa.fs.FileSystem, root: str) -> None:
        """Remove what this job started; other jobs' folders stay."""
        if store.get_file_info(f"{root}/_started/{self.job}").type == pa.fs.FileType.Directory:
            store.delete_dir(f"{root}/_started/{self.job}")
        if not store.get_file_info(pa.fs.FileSelector(f"{root}/_started", allow_not_found=True)):
            with contextlib.suppress(OSError):
                store.delete_dir(f"{root}/_started")


def write_images(df: DataFrame, path: str, mode: str = "append") -> None:
    """A file for each row (name, content) of df at path; see ImageFiles."""
    shipped(df).sparkSession.dataSource.register(ImageFiles)
    df.select("name", "content").write.format(ImageFiles.name()).mode(mode).save(path)
