"""DICOM files: headers and stored pixel values by a walk over the file's elements.

Files are listed and read by Spark and walked in the tasks. Explicit and implicit
little-endian data sets are read, with or without the leading meta block; the
walk stops at the pixels, and takes their values only if they are asked for.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..shipping import shipped

# Fixed values of the standard: element numbers and value kinds of the header fields that can be asked for.
FIELDS = {
    "study_date": (0x00080020, "DA"), "modality": (0x00080060, "CS"), "series_description": (0x0008103E, "LO"),
    "patient_id": (0x00100020, "LO"), "patient_birth_date": (0x00100030, "DA"), "patient_sex": (0x00100040, "CS"),
    "body_part": (0x00180015, "CS"), "view_position": (0x00185101, "CS"), "image_comments": (0x00204000, "LT"),
    "samples_per_pixel": (0x00280002, "US"), "photometric": (0x00280004, "CS"), "planar": (0x00280006, "US"), "frames": (0x00280008, "IS"),
    "rows": (0x00280010, "US"), "columns": (0x00280011, "US"), "bits_allocated": (0x00280100, "US"), "bits_stored": (0x00280101, "US"),
    "signed": (0x00280103, "US"), "window_center": (0x00281050, "DS"), "window_width": (0x00281051, "DS"), "intercept": (0x00281052, "DS"), "slope": (0x00281053, "DS"),
}
SQL_KINDS = {"US": "int", "IS": "int", "DS": "double"}
PIXELS, SYNTAX = 0x7FE00010, 0x00020010
IMPLICIT, EXPLICIT = "1.2.840.10008.1.2", "1.2.840.10008.1.2.1"
UNSUPPORTED = ("1.2.840.10008.1.2.4.53", "1.2.840.10008.1.2.4.55")  # reported apart from other syntaxes that cannot be decoded
LONG_KINDS = {b"OB", b"OD", b"OF", b"OL", b"OV", b"OW", b"SQ", b"UC", b"UN", b"UR", b"UT", b"SV", b"UV"}
ITEM, ITEM_END, SEQUENCE_END, OPEN = 0xFFFEE000, 0xFFFEE00D, 0xFFFEE0DD, 0xFFFFFFFF


class Cut(ValueError):
    """The file ends within an element, or what stands there is none."""


def _element(data: memoryview, at: int, explicit: bool) -> tuple[int, bytes, int, int]:
    """(tag, kind, length, place of the value) of the element at a place."""
    if at + 8 > len(data):
        raise Cut("an element's head is cut")
    group, number = struct.unpack_from("<HH", data, at)
    tag, kind = group << 16 | number, bytes(data[at + 4 : at + 6])
    if tag >> 16 == 0xFFFE or not explicit:
        return tag, b"", struct.unpack_from("<I", data, at + 4)[0], at + 8
    if not kind.isalpha() or not kind.isupper():
        raise Cut("an element without its kind")
    if kind in LONG_KINDS:
        if at + 12 > len(data):
            raise Cut("an element's head is cut")
        return tag, kind, struct.unpack_from("<I", data, at + 8)[0], at + 12
    return tag, kind, struct.unpack_from("<H", data, at + 6)[0], at + 8


def _past(data: memoryview, at: int, explicit: bool, end: int) -> int:
    """The place behind an open sequence or item, whatever is nested in it, that `end` closes."""
    closes = [end]
    while closes:
        tag, _, size, at = _element(data, at, explicit)
        if tag == closes[-1]:
            closes.pop()
        elif size == OPEN:
            closes.append(ITEM_END if tag == ITEM else SEQUENCE_END)
        else:
            at += size  # an item of known length is passed over whole
    return at


def elements(data: memoryview, at: int, explicit: bool, until: int | None = None) -> Iterator[tuple[int, int, int]]:
    """(tag, place, length) of each element of a data set; the pixels' comes last, and their length may be open."""
    while at < len(data):
        if until is not None and bytes(data[at : at + 2]) != struct.pack("<H", until):
            return
        tag, _, size, begin = _element(data, at, explicit)
        yield tag, begin, size
        if tag == PIXELS:
            return
        at = _past(data, begin, explicit, SEQUENCE_END) if size == OPEN else begin + size
        if at > len(data):
            raise Cut("an element's value is cut")


def _value(raw: bytes, kind: str):
    """The first value of an element; null if it is empty or no number where one must stand."""
    if kind == "US":
        return int.from_bytes(raw[:2], "little") if len(raw) >= 2 else None
    text = raw.decode("utf-8", "replace").rstrip("\0 ").lstrip(" ")
    if kind not in ("DS", "IS"):
        return text or None
    try:
        return (float if kind == "DS" else int)(text.split("\\")[0])
    except ValueError:
        return None


def parse(content: bytes, pixels: bool = False) -> dict:
    """Header fields, transfer_syntax, has_pixels, decodable, values (stored pixel values, frame by frame) and error of a file.

    A file without the meta block is read as a data set from its first byte. What
    was read before an error stays.
    """
    data = memoryview(content)
    out = dict.fromkeys((*FIELDS, "transfer_syntax", "values", "error")) | {"has_pixels": False, "decodable": False}
    by_tag = {tag: (name, kind) for name, (tag, kind) in FIELDS.items()}
    try:
        at = 0
        if bytes(data[128:132]) == b"DICM":
            at = 132
            for tag, begin, size in elements(data, at, True, 0x0002):
                at = begin + size
                if tag == SYNTAX:
                    out["transfer_syntax"] = _value(bytes(data[begin : begin + size]), "UI")
        syntax = out["transfer_syntax"]
        explicit = syntax != IMPLICIT if syntax else bytes(data[at + 4 : at + 6]).isalpha()
        if not len(data):
            raise Cut("no content")
        for tag, begin, size in elements(data, at, explicit):
            if tag == PIXELS:
                out["has_pixels"] = True
                _take_pixels(out, data, begin, size, pixels)
            elif tag in by_tag:
                name, kind = by_tag[tag]
                out[name] = _value(bytes(data[begin : begin + size]), kind)
    except Cut as e:
        out["error"] = str(e)
    return out


def _take_pixels(out: dict, data: memoryview, begin: int, size: int, pixels: bool) -> None:
    """Whether the pixels' bytes fit what the header says and, if asked for, their values."""
    if out["transfer_syntax"] not in (None, IMPLICIT, EXPLICIT) or size == OPEN:
        out["error"] = "compressed pixels are not decoded"
        return
    bits, frames = out["bits_allocated"], out["frames"] or 1
    if bits not in (8, 16, 32) or not out["rows"] or not out["columns"]:
        out["error"] = "the header does not describe the pixels"
        return
    count = frames * out["rows"] * out["columns"] * (out["samples_per_pixel"] or 1)
    want = count * bits // 8
    if size < want or begin + want > len(data):
        out["error"] = "pixels are cut"
        return
    out["decodable"] = True
    if pixels:
        x = np.frombuffer(data[begin : begin + want], f"<{'i' if out['signed'] else 'u'}{bits // 8}")
        samples = out["samples_per_pixel"] or 1
        if samples > 1 and out["planar"] == 1:
            x = x.reshape(frames, samples, -1).transpose(0, 2, 1).ravel()
        out["values"] = x.astype(np.int64)


def read_dicom(spark: SparkSession, path: str, fields: tuple[str, ...] = tuple(FIELDS), pixels: bool = False, glob: str = "*") -> DataFrame:
    """(path, length, transfer_syntax, the fields asked for, no_ts, unsupported_ts,
    missing_pixels, corrupt_pixels, error[, values]) for each file below path
    that has a byte (Spark's readers pass over the others).

    The four flags, 0 or 1, come from the bytes: no transfer syntax in the meta
    block; one of UNSUPPORTED; no pixels or no photometric interpretation; pixels
    that are cut, compressed or not described. values: stored values, rows of
    frames one after the other, samples side by side; null where a flag is up
    that keeps them from being read. A file that is none gives nulls and an error.
    """
    unknown = set(fields) - set(FIELDS)
    if unknown:
        raise ValueError(f"no fields {sorted(unknown)}")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", "length", "content")
    flags = ["no_ts", "unsupported_ts", "missing_pixels", "corrupt_pixels"]
    schema = ["path string", "length long", "transfer_syntax string"] + [f"{n} {SQL_KINDS.get(FIELDS[n][1], 'string')}" for n in fields]
    schema += [f"{n} int" for n in flags] + ["error string"] + ["values array<long>"] * pixels
    names = [s.split(" ")[0] for s in schema]
    types = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "array<long>": pa.list_(pa.int64())}
    kinds = [types[s.split(" ")[1]] for s in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a file at a time, so memory is bounded by the largest
                found = parse(batch.column("content")[i].as_py() or b"", pixels)
                missing = not found["has_pixels"] or found["photometric"] is None
                raised = (found["transfer_syntax"] is None, found["transfer_syntax"] in UNSUPPORTED, missing, found["has_pixels"] and not found["decodable"])
                row = {"path": batch.column("path")[i].as_py(), "length": batch.column("length")[i].as_py()} | found | dict(zip(flags, map(int, raised)))
                yield pa.RecordBatch.from_arrays([pa.array([row[n]], k) for n, k in zip(names, kinds)], names)

    return shipped(files).mapInArrow(run, ", ".join(schema))


def build(fields: dict, values: np.ndarray | None = None, syntax: str | None = EXPLICIT, preamble: bool = True) -> bytes:
    """A DICOM file of header fields and stored values (frames, rows, columns[, samples]) of 8, 16 or 32 bits.

    syntax: written to the meta block (None: not written); the data set is
    implicit for IMPLICIT, else explicit. Without preamble there is no meta block.
    """
    explicit = syntax != IMPLICIT

    def element(tag: int, kind: str, raw: bytes, named: bool) -> bytes:
        raw += b"\0" * (len(raw) % 2) if kind in ("UI", "OB", "OW") else b" " * (len(raw) % 2)
        head = struct.pack("<HH", tag >> 16, tag & 0xFFFF)
        if not named:
            return head + struct.pack("<I", len(raw)) + raw
        long = kind.encode() in LONG_KINDS
        return head + kind.encode() + (struct.pack("<HI", 0, len(raw)) if long else struct.pack("<H", len(raw))) + raw

    fields = dict(fields)
    if values is not None:
        bits = values.dtype.itemsize * 8
        sized = {"rows": values.shape[1], "columns": values.shape[2], "frames": values.shape[0], "samples_per_pixel": values.shape[3] if values.ndim == 4 else 1}
        fields = {"photometric": "MONOCHROME2", "bits_allocated": bits, "bits_stored": bits, "signed": int(values.dtype.kind == "i")} | sized | fields
    body = b""
    for name, value in sorted(fields.items(), key=lambda kv: FIELDS[kv[0]][0]):
        tag, kind = FIELDS[name]
        if value is not None:
            body += element(tag, kind, struct.pack("<H", value) if kind == "US" else str(value).encode(), explicit)
    if values is not None:
        body += element(PIXELS, "OW" if values.dtype.itemsize > 1 else "OB", np.ascontiguousarray(values).astype(values.dtype.newbyteorder("<")).tobytes(), explicit)
    if not preamble:
        return body
    meta = element(SYNTAX, "UI", syntax.encode(), True) if syntax else b""
    meta = element(0x00020000, "UL", struct.pack("<I", len(meta)), True) + meta
    return b"\0" * 128 + b"DICM" + meta + body
