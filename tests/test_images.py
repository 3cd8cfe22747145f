"""PNG, JPEG and DICOM files against plain versions; broken files; a sink that commits as a whole."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.sources import dicom, images

SHAPES = [((5, 7), np.uint8), ((6, 3, 3), np.uint8), ((4, 9, 4), np.uint8), ((5, 5), np.uint16), ((3, 8, 2), np.uint8), ((9, 11, 3), np.uint16), ((1, 1), np.uint8)]


def made(shape, kind, seed=1):
    return np.random.default_rng(seed).integers(0, np.iinfo(kind).max + 1, shape).astype(kind)


@pytest.mark.parametrize("filters", [(0,), (1,), (2,), (3,), (4,), (0, 1, 2, 3, 4)])
def test_png_round_trip(filters):
    for shape, kind in SHAPES:
        x = made(shape, kind)
        header, y = images.decode_png(images.encode_png(x, filters))
        assert np.array_equal(y.reshape(x.shape), x) and (header.width, header.height) == (shape[1], shape[0])


def png(header, rows, extra=()):
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return images.PNG_SIGN + chunk(b"IHDR", struct.pack(">IIBBBBB", *header)) + b"".join(chunk(*c) for c in extra) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_png_of_few_bits_palettes_and_interlacing():
    _, x = images.decode_png(png((5, 2, 1, 0, 0, 0, 0), b"\0\xa8\0\x50"))
    assert x[:, :, 0].tolist() == [[1, 0, 1, 0, 1], [0, 1, 0, 1, 0]]
    palette = (b"PLTE", bytes([1, 2, 3, 40, 50, 60]))
    _, x = images.decode_png(png((3, 1, 2, 3, 0, 0, 0), b"\0\x10", [palette]))
    assert x.tolist() == [[[1, 2, 3], [40, 50, 60], [1, 2, 3]]]
    full = made((9, 10), np.uint8, 3)
    rows = b"".join(b"\0" + full[y::dy, x::dx][i].tobytes() for x, dx, y, dy in [(0, 8, 0, 8), (4, 8, 0, 8), (0, 4, 4, 8), (2, 4, 0, 4), (0, 2, 2, 4), (1, 2, 0, 2), (0, 1, 1, 2)] for i in range(len(full[y::dy, x::dx])))
    _, x = images.decode_png(png((10, 9, 8, 0, 0, 0, 1), rows))
    assert np.array_equal(x[:, :, 0], full)
    with pytest.raises(images.Broken, match="palette"):
        images.decode_png(png((3, 1, 2, 3, 0, 0, 0), b"\0\x10"))
    with pytest.raises(images.Broken, match="beyond"):
        images.decode_png(png((3, 1, 2, 3, 0, 0, 0), b"\0\x30", [palette]))


def test_every_cut_and_flip_of_a_png_is_seen():
    good = images.encode_png(made((6, 5), np.uint8), (0, 1, 2, 3, 4))
    for pixels in (True, False):
        for n in range(len(good)):
            assert images.examine(good[:n], pixels)["error"], n
        for n in range(8, len(good)):
            bad = bytearray(good)
            bad[n] ^= 0x10
            assert images.examine(bytes(bad), pixels)["error"], n
    for rows in (b"\0\xa8", b"\0\xa8\0\x50\0", b"\5\xa8\0\x50"):
        assert images.examine(png((5, 2, 1, 0, 0, 0, 0), rows), False)["error"]
    assert images.examine(png((5, 2, 3, 0, 0, 0, 0), b""), True)["error"] and images.examine(None, True)["error"] == "no content"
    bomb = png((2, 2, 8, 0, 0, 0, 0), b"\0" * 50_000_000)
    assert "length" in images.examine(bomb, True)["error"]


def jpeg(scan=b"\x12\xff\x00\x34\xff\xd0\x56"):
    part = lambda marker, body: bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body
    frame = part(0xC0, struct.pack(">BHHB", 8, 32, 48, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
    return b"\xff\xd8" + part(0xE0, b"JFIF\0") + part(0xDB, bytes(65)) + part(0xC4, bytes(20)) + frame + part(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + scan + b"\xff\xd9"


def test_jpeg_walk():
    assert images.walk_jpeg(jpeg()) == (48, 32, 3)
    assert images.examine(jpeg() + b"trailing", True)["error"] is None
    for n in range(2, len(jpeg())):
        with pytest.raises(images.Broken):
            images.walk_jpeg(jpeg()[:n])
    with pytest.raises(images.Broken):
        images.walk_jpeg(jpeg(b""))


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path / "out")


def written(spark, rows, path, mode="append", parts=3):
    df = spark.createDataFrame(rows, "name string, content binary").repartition(parts, "name")
    images.write_images(df, path, mode)


def test_sink_and_source(spark, folder, tmp_path):
    x = [made((4, 6), np.uint8, i) for i in range(7)]
    rows = [(f"i{i}.png", images.encode_png(x[i])) for i in range(7)] + [("cut.png", images.encode_png(x[0])[:-9]), ("j.jpg", jpeg()), ("t.txt", b"text"), ("e.png", b"")]
    written(spark, rows, folder)
    got = {r["path"].rpartition("/")[2]: r for r in images.read_images(spark, folder, glob="*.*").collect()}
    assert set(got) == {n for n, _ in rows} - {"e.png"}  # Spark's readers pass over files without a byte
    assert all(got[f"i{i}.png"]["pixels"] == x[i].ravel().tolist() and got[f"i{i}.png"]["valid"] for i in range(7))
    assert [got[n]["valid"] for n in ("cut.png", "j.jpg", "t.txt")] == [False, True, False]
    assert (got["j.jpg"]["width"], got["j.jpg"]["height"], got["j.jpg"]["pixels"]) == (48, 32, None)
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")) == sorted([n for n, _ in rows] + ["_SUCCESS"])


def test_nothing_stays_of_a_job_that_fails(spark, folder, tmp_path):
    written(spark, [("a.png", b"1")], folder)
    before = sorted(p.name for p in (tmp_path / "out").iterdir())
    for rows in ([("b.png", b"2"), ("c.png", b"3"), ("bad/name", b"4")], [("b.png", b"2"), ("c.png", None)], [("b.png", b"2"), ("a.png", b"5")]):
        with pytest.raises(Exception, match="written|already|twice"):
            written(spark, rows, folder)
        assert sorted(p.name for p in (tmp_path / "out").iterdir()) == before
    twice = spark.createDataFrame([("d.png", bytes([i])) for i in range(2)], "name string, content binary").repartition(2)
    with pytest.raises(Exception, match="twice|written"):
        images.write_images(twice, folder)
    written(spark, [("a.png", b"9"), ("b.png", b"2")], folder, "overwrite")
    assert (tmp_path / "out" / "a.png").read_bytes() == b"9" and (tmp_path / "out" / "b.png").exists()


def test_dicom_round_trip():
    for kind in (np.uint8, np.uint16, np.int16, np.int32):
        x = np.random.default_rng(2).integers(np.iinfo(kind).min, np.iinfo(kind).max, (2, 3, 5)).astype(kind)
        for syntax in (dicom.EXPLICIT, dicom.IMPLICIT):
            head = {"patient_id": "p 1", "modality": "CR", "window_center": "40.5", "image_comments": "é " + "x" * 99}
            got = dicom.parse(dicom.build(head, x, syntax), True)
            assert got["values"].tolist() == x.ravel().tolist() and got["error"] is None and got["transfer_syntax"] == syntax
            assert (got["rows"], got["columns"], got["frames"], got["window_center"], got["patient_id"]) == (3, 5, 2, 40.5, "p 1")
            assert got["image_comments"].startswith("é x") and got["modality"] == "CR"
            assert dicom.parse(dicom.build(head, x, syntax))["values"] is None
    plain = dicom.parse(dicom.build({"modality": "DX"}, made((1, 2, 2), np.uint16), preamble=False), True)
    assert plain["transfer_syntax"] is None and plain["modality"] == "DX" and len(plain["values"]) == 4


def test_dicom_colours_and_nested_elements():
    x = made((1, 2, 3, 3), np.uint8)
    assert dicom.parse(dicom.build({}, x), True)["values"].tolist() == x.ravel().tolist()
    planes = np.ascontiguousarray(x.transpose(0, 3, 1, 2)).reshape(x.shape)
    assert dicom.parse(dicom.build({"planar": 1}, planes), True)["values"].tolist() == x.ravel().tolist()
    whole = dicom.build({"modality": "CR", "patient_id": "p"}, made((1, 2, 2), np.uint16))
    at = whole.index(b"\x10\x00\x20\x00LO")
    leaf = struct.pack("<HH", 0x8, 0x60) + b"CS" + struct.pack("<H", 2) + b"XX"
    open_item = struct.pack("<HHI", 0xFFFE, 0xE000, 0xFFFFFFFF) + leaf + struct.pack("<HH", 0x8, 0x1140) + b"SQ\0\0" + struct.pack("<I", 0xFFFFFFFF)
    open_item += struct.pack("<HHI", 0xFFFE, 0xE000, len(leaf)) + leaf + struct.pack("<HHI", 0xFFFE, 0xE0DD, 0) + struct.pack("<HHI", 0xFFFE, 0xE00D, 0)
    nested = struct.pack("<HH", 0x8, 0x1140) + b"SQ\0\0" + struct.pack("<I", 0xFFFFFFFF) + open_item + struct.pack("<HHI", 0xFFFE, 0xE0DD, 0)
    got = dicom.parse(whole[:at] + nested + whole[at:], True)
    assert got["modality"] == "CR" and got["patient_id"] == "p" and got["values"] is not None


def test_dicom_cut_anywhere_never_fails_unseen():
    whole = dicom.build({"modality": "CR", "patient_id": "p"}, made((1, 4, 4), np.uint16))
    for n in range(len(whole)):
        got = dicom.parse(whole[:n], True)
        assert got["values"] is None and (got["error"] or not got["has_pixels"]), n
    rng = np.random.default_rng(1)
    for _ in range(300):
        bad = bytearray(whole)
        for i in rng.integers(132, len(bad), 3):
            bad[i] = rng.integers(256)
        dicom.parse(bytes(bad), True)


def test_dicom_flags(spark, folder):
    x = made((1, 2, 2), np.uint16)
    rows = [
        ("fine", dicom.build({}, x)), ("no_ts", dicom.build({}, x, None)), ("bad_ts", dicom.build({}, x, dicom.UNSUPPORTED[0])), ("none", dicom.build({"modality": "CR"})),
        ("cut", dicom.build({}, x)[:-1]), ("text", b"this is no image at all"), ("unnamed", dicom.build({"photometric": None}, x)),
    ]
    written(spark, rows, folder)
    df = dicom.read_dicom(spark, folder, ("modality", "rows"), pixels=True, glob="[a-z]*")
    got = {r["path"].rpartition("/")[2]: r for r in df.collect()}
    flags = lambda n: tuple(got[n][f] for f in ("no_ts", "unsupported_ts", "missing_pixels", "corrupt_pixels"))
    assert {n: flags(n) for n in got} == {
        "fine": (0, 0, 0, 0), "no_ts": (1, 0, 0, 0), "bad_ts": (0, 1, 0, 1), "none": (0, 0, 1, 0), "cut": (0, 0, 0, 1), "text": (1, 0, 1, 0), "unnamed": (0, 0, 1, 0),
    }
    assert got["fine"]["values"] == x.ravel().tolist() and got["none"]["modality"] == "CR" and got["fine"]["rows"] == 2
    assert dicom.read_dicom(spark, folder, (), glob="fine").columns == ["path", "length", "transfer_syntax", "no_ts", "unsupported_ts", "missing_pixels", "corrupt_pixels", "error"]
    with pytest.raises(ValueError):
        dicom.read_dicom(spark, folder, ("nothing",))
    assert df.where(F.col("error").isNull()).count() >= 2
