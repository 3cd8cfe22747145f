"""From DICOM files to PNG files, with a report of those that are left out or inverted."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import shipped
from . import image, pixels

FLAGS = {"no_ts": "no_TS_ID", "unsupported_ts": "unsupported_TS_ID", "missing_pixels": "missing_pixels", "corrupt_pixels": "corrupt_pixels"}
GRAY = np.array([0.2125, 0.7154, 0.0721])  # fixed values: luminance of red, green, blue
ISSUES = [*FLAGS.values(), "inverted_colors", "brightness_issues"]
FIELDS = ("photometric", "samples_per_pixel", "rows", "columns", "frames", "window_center", "window_width", "intercept", "slope")


def resampled(x: np.ndarray, width: int, height: int) -> np.ndarray:
    """An image (rows, columns) at another size, by the weights of pixels.taps."""

    def along(x: np.ndarray, new: int) -> np.ndarray:
        out = np.zeros((new, x.shape[1]))
        for o, (lo, w) in enumerate(pixels.taps(len(x), new, "bilinear")):
            out[o] = np.asarray(w) @ x[lo : lo + len(w)]
        return out

    return along(along(x.T, width).T, height)


def develop(values: np.ndarray, row: dict, width: int | None, modality: bool, voi: bool) -> np.ndarray | None:
    """The image (rows, columns) of a file's first frame, from 0 to 255; None if no value is above 0."""
    high, across, samples = row["rows"], row["columns"], row["samples_per_pixel"] or 1
    x = values[: high * across * samples].astype(float).reshape(high, across, samples)
    x = x @ GRAY if samples == 3 else x[:, :, 0]
    if modality:
        x = x * (1.0 if row["slope"] is None else row["slope"]) + (row["intercept"] or 0.0)
    center, span = row["window_center"], row["window_width"]
    if voi and center is not None and span is not None and span >= 1:
        at = x - (center - 0.5)
        x = np.where(at <= 0, 0.0, 255.0) if span == 1 else np.clip((at / (span - 1) + 0.5) * 255, 0, 255)
    if not x.size or x.max() <= 0:
        return None
    x = np.floor(np.maximum(x, 0) / x.max() * 255)
    inside = np.argwhere(x != x[0, 0])
    if len(inside):
        (top, left), (bottom, right) = inside.min(axis=0), inside.max(axis=0) + 1
        x = x[top:bottom, left:right]
    if width:
        x = np.rint(np.round(resampled(x, width, max(1, int(width / x.shape[1] * x.shape[0]))), 6))  # sums that differ in their last bits round alike
    return 255 - x if row["photometric"] == "MONOCHROME1" else x


def shown(files: DataFrame, width: int | None = 1024, modality: bool = False, voi: bool = True) -> DataFrame:
    """files (as read_dicom gives them, with FIELDS and values) with shown (the image in
    whole numbers from 0 to 255, row by row), shown_width and shown_height; null
    where a flag is up or no pixel is above 0.

    The first frame is made gray; modality applies slope and intercept, voi the
    header's window; values are scaled to 255, borders of the first pixel's value
    trimmed, the image brought to `width` with its aspect kept (None: not), and
    inverted where low values stand for white. Images are developed one by one.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
    needed = [*FIELDS, *FLAGS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                row = {n: one.column(n)[0].as_py() for n in needed}
                values = one.column("values")[0]
                fine = values.is_valid and not any(row[f] for f in FLAGS)
                x = develop(values.values.to_numpy(zero_copy_only=False), row, width, modality, voi) if fine else None
                size = (None, None) if x is None else x.shape
                flat = pa.array([None if x is None else x.ravel().astype(np.int32)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*one.columns, flat, pa.array([size[1]], pa.int32()), pa.array([size[0]], pa.int32())], [*one.schema.names, "shown", "shown_width", "shown_height"])

    return shipped(files).mapInArrow(run, f"{schema}, shown array<int>, shown_width int, shown_height int")


def judged(files: DataFrame, limits: tuple[int, int] = (50, 215)) -> DataFrame:
    """What shown gives, with the report's ISSUES (0 or 1) and kept: no flag, and a mean
    brightness within limits. An inverted image is reported and kept. An image without a
    pixel above 0 has a brightness issue."""
    fine = F.coalesce(image.good_brightness("shown", *limits), F.lit(False))
    whole = F.lit(True)
    for f in FLAGS:
        whole &= F.col(f) == 0
    issues = {name: F.col(f) for f, name in FLAGS.items()}
    issues["inverted_colors"] = (whole & (F.col("photometric") == "MONOCHROME1")).cast("int")
    issues["brightness_issues"] = (whole & ~fine).cast("int")
    return files.withColumns(issues).withColumn("kept", whole & fine)


def report(files: DataFrame, prefix: str = "") -> DataFrame:
    """(group, file_name, ISSUES) of the images that have an issue."""
    any_issue = F.greatest(*[F.col(c) for c in ISSUES]) == 1
    name = F.element_at(F.split("path", "/"), -1)
    return files.where(any_issue).select(F.lit(prefix).alias("group"), name.alias("file_name"), *ISSUES)


def png_name(path: str = "path", prefix: str = ""):
    """The file's name with dcm, or else dicom, replaced by png, behind the prefix."""
    name = F.element_at(F.split(path, "/"), -1)
    known = F.when(F.contains(name, F.lit("dcm")), F.replace(name, F.lit("dcm"), F.lit("png"))).otherwise(F.replace(name, F.lit("dicom"), F.lit("png")))
    return F.concat(F.lit(prefix), known)
