"""Queries on image files and on the arithmetic of images, with SQL that works the pixels out by definition."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import conversion
from ..operators import pixels as X
from ..shipping import shipped
from ..sources import dicom, images
from ..sources.scratch import new_path
from .catalog import query
from .views import table

SIDE, STACK = 8, 64
#: Embeddings of 64 numbers as 8 x 8 images of 16 bits.
PIXELS = "list_transform(embedding, lambda x: CAST(floor((greatest(least(x::DOUBLE, 1), -1) + 1) * 1000) AS BIGINT))"
WHOLE = "len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = 64"
IMAGES = f"im AS (SELECT vec_id, {PIXELS} AS a FROM embeddings WHERE {WHOLE})"


def vectors_as_images(spark: SparkSession, d: str) -> DataFrame:
    """(vec_id, a): a of 64 whole numbers from 0 to 2000."""
    fine = (F.size("embedding") == 64) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    a = F.transform("embedding", lambda x: F.floor((F.greatest(F.least(x.cast("double"), F.lit(1.0)), F.lit(-1.0)) + 1) * 1000))
    return table(spark, d, "embeddings").where(fine).select("vec_id", a.alias("a"))


def text(values, digits: int = 3):
    """An array as whole thousandths, joined by commas."""
    return F.array_join(F.transform(values, lambda x: F.rint(x * 10**digits).cast("long").cast("string")), ",")


def text_sql(values: str, digits: int = 3) -> str:
    return f"array_to_string(list_transform({values}, lambda x: CAST(round_even(x * {10**digits}, 0) AS BIGINT)), ',')"


# ---- files


def stacks(spark: SparkSession, d: str) -> DataFrame:
    """(stack, items): up to 64 images by number, in order."""
    stack = F.floor(F.col("vec_id") / STACK)
    return vectors_as_images(spark, d).groupBy(stack.alias("stack")).agg(F.sort_array(F.collect_list(F.struct("vec_id", "a"))).alias("items"))


def built(df: DataFrame, make) -> DataFrame:
    """(name, content) by make(row) for each row."""

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                name, content = make(row)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([content], pa.binary())], ["name", "content"])

    return shipped(df).mapInArrow(run, "name string, content binary")


def stack_file(row: dict) -> tuple[str, bytes]:
    """All images of a stack as frames of a file; every second one with implicit kinds. The comment names them."""
    values = np.array([x["a"] for x in row["items"]], np.uint16).reshape(-1, SIDE, SIDE)
    head = {"patient_id": row["stack"], "modality": "OT", "image_comments": ",".join(str(x["vec_id"]) for x in row["items"])}
    return f"s{row['stack']}.dcm", dicom.build(head, values, dicom.IMPLICIT if row["stack"] % 2 else dicom.EXPLICIT)


@query("s06_dicom_pixels", f"WITH {IMAGES} SELECT vec_id, (vec_id // 64)::VARCHAR AS patient_id, array_to_string(a, ',') AS pixels FROM im")
def s06(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "dicom")
    images.write_images(built(stacks(spark, d), stack_file), path)
    got = dicom.read_dicom(spark, path, ("patient_id", "image_comments", "rows", "columns"), pixels=True, glob="*.dcm")
    size = (F.col("rows") * F.col("columns")).alias("n")
    frames = got.select("patient_id", size, "values", F.posexplode(F.split("image_comments", ",")).alias("k", "vec_id"))
    frame = F.slice("values", F.col("k") * F.col("n") + 1, F.col("n"))
    return frames.select(F.col("vec_id").cast("long").alias("vec_id"), "patient_id", F.array_join(frame.cast("array<string>"), ",").alias("pixels"))


FLAGGED = """
SELECT s_suppkey, (s_suppkey % 6 = 2)::INT AS no_ts, (s_suppkey % 6 = 3)::INT AS unsupported_ts, (s_suppkey % 6 = 4)::INT AS missing_pixels,
       (s_suppkey % 6 IN (3, 5))::INT AS corrupt_pixels, 'n' || s_nationkey AS body_part
FROM supplier
"""


def flawed(row: dict) -> tuple[str, bytes]:
    """A file with the flaw that its number names: none, implicit kinds, no syntax, one that is not decoded, no pixels, cut."""
    k = row["s_suppkey"]
    x = (np.arange(20).reshape(1, 4, 5) * k % 4096).astype(np.uint16)
    head, syntax = {"patient_id": k, "body_part": f"n{row['s_nationkey']}"}, [dicom.EXPLICIT, dicom.IMPLICIT, None, dicom.UNSUPPORTED[k % 2], dicom.EXPLICIT, dicom.EXPLICIT][k % 6]
    content = dicom.build(head, None if k % 6 == 4 else x, syntax)
    return f"{k}.dcm", content[:-3] if k % 6 == 5 else content


@query("i08_header_flags_of_files", FLAGGED)
def i08f(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "headers")
    images.write_images(built(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), flawed), path)
    got = dicom.read_dicom(spark, path, ("patient_id", "body_part"), glob="*.dcm")
    return got.select(F.col("patient_id").cast("long").alias("s_suppkey"), "no_ts", "unsupported_ts", "missing_pixels", "corrupt_pixels", "body_part")


@query("s07_s15_png_pixels", f"WITH {IMAGES} SELECT vec_id // 64 AS stack, row_number() OVER (PARTITION BY vec_id // 64 ORDER BY vec_id) - 1 AS line, array_to_string(a, ',') AS pixels FROM im")
def s07(spark: SparkSession, d: str) -> DataFrame:
    """An image of 16 bits for each stack, a line for each of its vectors: written, and read again."""
    flat = stacks(spark, d).select("stack", F.flatten(F.transform("items", lambda x: x["a"])).alias("pixels"), F.lit(64).alias("width"), F.size("items").alias("height"))
    path = new_path(spark, "png")
    named = images.encoded(flat, bits=16).select(F.concat(F.lit("s"), F.col("stack"), F.lit(".png")).alias("name"), "content")
    images.write_images(named, path)
    got = images.read_images(spark, path, glob="*.png").where("valid")
    stack = F.regexp_extract("path", r"s(-?\d+)\.png$", 1).cast("long").alias("stack")
    lines = got.select(stack, "width", "pixels", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("line"))
    line = F.slice("pixels", F.col("line") * F.col("width") + 1, F.col("width"))
    return lines.select("stack", F.col("line").cast("long").alias("line"), F.array_join(line.cast("array<string>"), ",").alias("pixels"))


def damaged(row: dict) -> tuple[str, bytes]:
    """A PNG: whole, cut, with a bit turned, or something else under its name."""
    k = row["s_suppkey"]
    content = bytearray(images.encode_png((np.arange(30).reshape(5, 6) * k % 251).astype(np.uint8), (0, 1, 2, 3, 4)))
    if k % 4 == 1:
        content = content[: len(content) - 1 - k % 40]
    elif k % 4 == 2:
        content[8 + k % (len(content) - 8)] ^= 1 << k % 8
    elif k % 4 == 3:
        content = b"row " * (1 + k % 9)
    return f"{k}.png", bytes(content)


@query("s20_valid_content", "SELECT s_suppkey, s_suppkey % 4 = 0 AS valid, CASE WHEN s_suppkey % 4 = 3 THEN 'none' ELSE 'png' END AS kind FROM supplier")
def s20(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "damaged")
    images.write_images(built(table(spark, d, "supplier").select("s_suppkey"), damaged), path)
    key = F.regexp_extract("path", r"(\d+)\.png$", 1).cast("long").alias("s_suppkey")
    return images.read_images(spark, path, pixels=False, glob="*.png").select(key, "valid", F.coalesce("kind", F.lit("none")).alias("kind"))


# ---- arithmetic

WINDOWED = "list_transform(a, lambda x: CASE WHEN x <= 999.5 - 149.5 THEN 0 WHEN x > 999.5 + 149.5 THEN 255 ELSE ((x - 999.5) / 299.0 + 0.5) * 255 END)"


@query("i09_window", f"WITH {IMAGES} SELECT vec_id, {text_sql(WINDOWED)} AS pixels FROM im")
def i09w(spark: SparkSession, d: str) -> DataFrame:
    return vectors_as_images(spark, d).select("vec_id", text(X.window("a", F.lit(1000.0), F.lit(300.0))).alias("pixels"))


def bilinear_sql(a: str, w: int, h: int, nw: int, nh: int, channels: int = 1) -> str:
    """Each new value from the four around its centre."""
    c, i = f"(i % {channels})", f"(i // {channels})"
    x, y = (f"greatest(least(({o} + 0.5) * {n} / {m}.0 - 0.5, {n} - 1), 0)" for o, n, m in ((f"({i} % {nw})", w, nw), (f"({i} // {nw})", h, nh)))
    value = lambda px, py: f"({a})[CAST(({py}) * {w} + ({px}) AS INT) * {channels} + {c} + 1]"
    lo = lambda z: f"floor({z})"
    up = lambda z, n: f"least(floor({z}) + 1, {n - 1})"
    across = lambda py: f"({value(lo(x), py)} * (1 - ({x} - floor({x}))) + {value(up(x, w), py)} * ({x} - floor({x})))"
    return f"list_transform(range({nw * nh * channels}), lambda i: {across(lo(y))} * (1 - ({y} - floor({y}))) + {across(up(y, h))} * ({y} - floor({y})))"


def area_sql(a: str, w: int, h: int, nw: int, nh: int) -> str:
    """Each new value from all old ones, by the part of it that they cover."""
    part = lambda o, n, m, j: f"greatest(least(({o} + 1) * {n} / {m}.0, {j} + 1) - greatest({o} * {n} / {m}.0, {j}), 0)"
    cover = f"{part(f'(i % {nw})', w, nw, f'(j % {w})')} * {part(f'(i // {nw})', h, nh, f'(j // {w})')}"
    return f"list_transform(range({nw * nh}), lambda i: list_sum(list_transform(range({w * h}), lambda j: ({a})[j + 1] * {cover})) / {w * h / nw / nh!r})"


for _name, _how, _w, _h in (("i09_resize_up", "bilinear", 11, 13), ("i11_resize_bilinear", "bilinear", 5, 3), ("i11_resize_area", "area", 5, 3)):
    _sql = bilinear_sql("a", 8, 8, _w, _h) if _how == "bilinear" else area_sql("a", 8, 8, _w, _h)
    query(_name, f"WITH {IMAGES} SELECT vec_id, {text_sql(_sql, 6)} AS pixels FROM im")(
        lambda spark, d, how=_how, w=_w, h=_h: vectors_as_images(spark, d).select("vec_id", text(X.resize("a", 8, 8, w, h, how), 6).alias("pixels"))
    )


def turbo_sql() -> str:
    each = []
    for row in X.TURBO:
        power = " + ".join(f"{c!r} * pow(k / 255.0::DOUBLE, {e})" for e, c in enumerate(row))
        each.append(f"CAST(round_even(greatest(least({power}, 1), 0) * 255, 0) AS INT)")
    return f"flatten(list_transform(range(256), lambda k: [{', '.join(each)}]))"


OVERLAID = f"""
WITH {IMAGES}, tb AS (SELECT {turbo_sql()} AS t),
ht AS (SELECT vec_id, a, list_transform(a[1:16], lambda x: CAST(floor(x / 2000.0 * 255) AS INT)) AS k FROM im),
cl AS (SELECT vec_id, a, list_transform(range(48), lambda i: t[k[i // 3 + 1] * 3 + i % 3 + 1]) AS c FROM ht, tb),
st AS (SELECT vec_id, a, list_transform(c, lambda x: coalesce((x - list_min(c))::DOUBLE / nullif(list_max(c) - list_min(c), 0), 0) * 255) AS s FROM cl),
lg AS (SELECT vec_id, a, {bilinear_sql('s', 4, 4, 8, 8, 3)} AS l FROM st),
mx AS (SELECT vec_id, list_transform(range(192), lambda i: l[i + 1] * 0.4 + a[i // 3 + 1]) AS m FROM lg)
SELECT vec_id, {text_sql('list_transform(m, lambda x: x / list_max(m))', 4)} AS pixels FROM mx
"""


@query("i06_colour_overlay", OVERLAID)
def i06(spark: SparkSession, d: str) -> DataFrame:
    """The first sixteen values as a heat map of 4 x 4 in colours over the image."""
    heat = F.transform(F.slice("a", 1, 16), lambda x: x / 2000.0)
    return vectors_as_images(spark, d).select("vec_id", text(X.colour_overlay("a", heat, (8, 8), (4, 4), channels=1), 4).alias("pixels"))


def factor_sql(what: str, low: float, high: float, seed: int = 5) -> str:
    return f"(CAST('0x' || substr(md5(concat('{seed}:{what}:', vec_id)), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE * ({high - low!r}) + ({low!r}))"


def perturbed_sql() -> str:
    m = X.turned("co", "si")
    mean = lambda c: f"list_sum(list_transform(range(20), lambda i: a[i * 3 + {c + 1}])) / 20.0::DOUBLE"
    raised = lambda c: f"((a[q * 3 + {c + 1}] - m{c}) * con + m{c})"
    mixed = ", ".join(f"greatest(least({' + '.join(f'{raised(c)} * {m[r][c]}' for c in range(3))} + sh, 2000), 0)" for r in range(3))
    angle = f"({factor_sql('hue', -0.1, 0.1)} * {2 * math.pi!r})"
    return (
        f"WITH {IMAGES}, fa AS (SELECT vec_id, a, {factor_sql('contrast', 0.5, 2.0)} AS con, {factor_sql('saturation', 0.7, 1.25)} AS sa, {angle} AS an, "
        f"{factor_sql('brightness', -0.2, 0.2)} * 2000 AS sh, {factor_sql('flip', 0.0, 1.0)} < 0.5 AS fl, {mean(0)} AS m0, {mean(1)} AS m1, {mean(2)} AS m2 FROM im), "
        "fb AS (SELECT *, cos(an) * sa AS co, sin(an) * sa AS si, list_transform(range(20), lambda i: CASE WHEN fl THEN i // 5 * 5 + 4 - i % 5 ELSE i END) AS ats FROM fa) "
        f"SELECT vec_id, {text_sql(f'flatten(list_transform(ats, lambda q: [{mixed}]))', 2)} AS pixels FROM fb"
    )


@query("i12_perturb", perturbed_sql())
def i12(spark: SparkSession, d: str) -> DataFrame:
    """The first sixty values as 5 x 4 pixels of three colours."""
    out = X.perturb(F.slice("a", 1, 60), 5, 4, "vec_id", top=2000.0, seed=5)
    return vectors_as_images(spark, d).select("vec_id", text(out, 2).alias("pixels"))


PADDED = f"""
WITH {IMAGES}, fa AS (SELECT vec_id, a, CAST(floor(8 * ([0.7, 0.85, 1.15, 1.3])[1 + CAST('0x' || substr(md5(concat('5:scale:', vec_id)), 1, 8) AS BIGINT) % 4]) AS INT) AS n FROM im),
fb AS (SELECT vec_id, a, n, CASE WHEN n < 8 THEN -((8 - n) // 2) ELSE (n - 8) // 2 END AS o FROM fa)
SELECT vec_id, n AS side, array_to_string(list_transform(range(n * n), lambda i: CASE WHEN i % n - o BETWEEN 0 AND 7 AND i // n - o BETWEEN 0 AND 7
    THEN a[(i // n - o) * 8 + i % n - o + 1] ELSE 0 END), ',') AS pixels
FROM fb
"""


@query("i13_crop_or_pad", PADDED)
def i13(spark: SparkSession, d: str) -> DataFrame:
    """Each image cut or padded to a size that its number draws from four."""
    from ..functions.scalar import hash_key

    drawn = F.array(*[F.lit(x) for x in (0.7, 0.85, 1.15, 1.3)])[(hash_key("5:scale", "vec_id") % 4).cast("int")]
    sized = vectors_as_images(spark, d).withColumn("side", F.floor(8 * drawn).cast("int"))
    out = X.crop_or_pad("a", 8, 8, F.col("side"), F.col("side"))
    return sized.select("vec_id", "side", F.array_join(out.cast("array<string>"), ",").alias("pixels"))


# ---- the whole flow


def photographed(row: dict) -> tuple[str, bytes]:
    """A file of 9 x 7 pixels with a border: every second one with a window, every third with low values for white, every fifth cut."""
    k, i = row["s_suppkey"], np.arange(63)
    inside = (i % 9 > 0) & (i % 9 < 8) & (i // 9 > 0) & (i // 9 < 6)
    x = np.where(inside, (k * 31 + i * 17 + i * i) % 400 + 1, 0).astype(np.uint16).reshape(1, 7, 9)
    head = {"photometric": "MONOCHROME1" if k % 3 == 0 else "MONOCHROME2"} | ({"window_center": 200, "window_width": 300} if k % 2 == 0 else {})
    content = dicom.build(head, x)
    return f"i{k}.dcm", content[:-9] if k % 5 == 0 else content


FLOW = f"""
WITH r AS (SELECT s_suppkey AS k, list_transform(range(63), lambda i: CASE WHEN i % 9 BETWEEN 1 AND 7 AND i // 9 BETWEEN 1 AND 5 THEN (s_suppkey * 31 + i * 17 + i * i) % 400 + 1 ELSE 0 END) AS a
    FROM supplier WHERE s_suppkey % 5 <> 0),
w AS (SELECT k, CASE WHEN k % 2 = 0 THEN list_transform(a, lambda x: CASE WHEN x <= 50 THEN 0 WHEN x > 349 THEN 255 ELSE ((x - 199.5) / 299.0 + 0.5) * 255 END) ELSE list_transform(a, lambda x: x::DOUBLE) END AS a FROM r),
s AS (SELECT k, list_transform(a, lambda x: CAST(floor(greatest(x, 0) / list_max(a) * 255) AS INT)) AS a FROM w),
u AS (SELECT k, a, [i FOR i IN range(63) IF a[i + 1] <> a[1]] AS u FROM s),
b AS (SELECT k, a, list_min([i // 9 FOR i IN u]) AS y0, list_max([i // 9 FOR i IN u]) + 1 AS y1, list_min([i % 9 FOR i IN u]) AS x0, list_max([i % 9 FOR i IN u]) + 1 AS x1 FROM u),
c AS (SELECT k, x1 - x0 AS w, y1 - y0 AS h, [a[i + 1] FOR i IN range(63) IF i // 9 >= y0 AND i // 9 < y1 AND i % 9 >= x0 AND i % 9 < x1] AS a FROM b),
n AS (SELECT k, w, h, a, CAST(floor(10.0 / w * h) AS INT) AS nh FROM c),
p AS (SELECT *, list_transform(range(10 * nh), lambda i: greatest(least((i % 10 + 0.5) * w / 10.0 - 0.5, w - 1), 0)) AS px, list_transform(range(10 * nh), lambda i: greatest(least((i // 10 + 0.5) * h / nh::DOUBLE - 0.5, h - 1), 0)) AS py FROM n),
z AS (SELECT k, nh, list_transform(range(10 * nh), lambda i: CAST(round_even(round((a[CAST(floor(py[i + 1]) * w + floor(px[i + 1]) AS INT) + 1] * (1 - (px[i + 1] - floor(px[i + 1]))) + a[CAST(floor(py[i + 1]) * w + least(floor(px[i + 1]) + 1, w - 1) AS INT) + 1] * (px[i + 1] - floor(px[i + 1]))) * (1 - (py[i + 1] - floor(py[i + 1])))
    + (a[CAST(least(floor(py[i + 1]) + 1, h - 1) * w + floor(px[i + 1]) AS INT) + 1] * (1 - (px[i + 1] - floor(px[i + 1]))) + a[CAST(least(floor(py[i + 1]) + 1, h - 1) * w + least(floor(px[i + 1]) + 1, w - 1) AS INT) + 1] * (px[i + 1] - floor(px[i + 1]))) * (py[i + 1] - floor(py[i + 1])), 6), 0) AS INT)) AS a FROM p),
v AS (SELECT k, nh, CASE WHEN k % 3 = 0 THEN list_transform(a, lambda x: 255 - x) ELSE a END AS a FROM z)
"""


def converted(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "flow")
    images.write_images(built(table(spark, d, "supplier").select("s_suppkey"), photographed), path)
    files = dicom.read_dicom(spark, path, conversion.FIELDS, pixels=True, glob="*.dcm")
    return conversion.judged(conversion.shown(files, 10), (100, 150))


@query("i09_dicom_to_png", f"{FLOW} SELECT 'x_i' || k || '.png' AS name, 10 AS width, nh AS height, array_to_string(a, ',') AS pixels FROM v WHERE floor(list_avg(a)) >= 100 AND floor(list_avg(a)) < 150")
def i09d(spark: SparkSession, d: str) -> DataFrame:
    """DICOM files to PNG files, read again."""
    kept = converted(spark, d).where("kept").select(conversion.png_name(prefix="x_").alias("name"), F.col("shown").alias("pixels"), F.col("shown_width").alias("width"), F.col("shown_height").alias("height"))
    path = new_path(spark, "converted")
    images.write_images(images.encoded(kept), path)
    got = images.read_images(spark, path, glob="*.png").where("valid")
    return got.select(F.element_at(F.split("path", "/"), -1).alias("name"), "width", "height", F.array_join(F.col("pixels").cast("array<string>"), ",").alias("pixels"))


REPORTED = f"""
{FLOW}, f AS (SELECT s_suppkey AS k, s_suppkey % 5 = 0 AS cut FROM supplier),
g AS (SELECT f.k, cut::INT AS corrupt_pixels, (NOT cut AND f.k % 3 = 0)::INT AS inverted_colors,
    (NOT cut AND NOT (floor(list_avg(a)) >= 100 AND floor(list_avg(a)) < 150))::INT AS brightness_issues FROM f LEFT JOIN v USING (k))
SELECT 'x' AS "group", 'i' || k || '.dcm' AS file_name, 0 AS "no_TS_ID", 0 AS "unsupported_TS_ID", 0 AS missing_pixels, corrupt_pixels, inverted_colors, brightness_issues
FROM g WHERE corrupt_pixels + inverted_colors + brightness_issues > 0
"""


@query("i09_dicom_report", REPORTED)
def i09r(spark: SparkSession, d: str) -> DataFrame:
    return conversion.report(converted(spark, d), "x")
