"""Array math on images held as flat, row-major arrays; codecs are not part of it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scalar import col


def _once(value: Column, use) -> Column:
    """use(value) with value computed once for a row, not once for each element."""
    return F.transform(F.array(value), use)[0]


def rescale(pixels: str | Column, new_max: int = 255) -> Column:
    """max(x, 0) / max * new_max, cut to whole numbers; an image without positive pixels becomes null."""
    a = col(pixels)
    scaled = _once(F.array_max(a), lambda top: F.transform(a, lambda x: (F.try_divide(F.greatest(x, F.lit(0)), top) * new_max).cast("int")))
    return F.when(F.array_max(a) > 0, scaled)


def mean_brightness(pixels: str | Column) -> Column:
    a = col(pixels)
    return (F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)).cast("int")


def good_brightness(pixels: str | Column, low: int = 50, high: int = 215) -> Column:
    m = mean_brightness(pixels)
    return (m >= low) & (m < high)


def invert(pixels: str | Column) -> Column:
    return F.transform(col(pixels), lambda x: 255 - x)


def percentile_of(pixels: str | Column, q: float) -> Column:
    """Linear interpolation between the sorted values around q/100 * (n - 1)."""

    def between(s: Column) -> Column:
        at = F.lit(q / 100) * (F.size(s) - 1)
        lo = F.floor(at).cast("int")
        low, high = F.element_at(s, lo + 1), F.element_at(s, F.least(lo + 2, F.size(s)))
        return low + (high - low) * (at - lo)

    return _once(F.array_sort(col(pixels).cast("array<double>")), between)


def percentile_mask(image: str | Column, mask: str | Column, level: float = 70, scale: bool = True) -> Column:
    """Pixels stay where the mask is above its percentile, else become 0."""
    kept = lambda limit: F.zip_with(col(image), col(mask), lambda x, m: F.when(m > limit, x / 255 if scale else x.cast("double")).otherwise(0.0))
    return _once(percentile_of(mask, level), kept)


def trim_box(pixels: str | Column, width: int) -> Column:
    """(top, left, bottom, right), ends exclusive, of the pixels unlike the first one; null if there are none."""
    a = col(pixels)
    at = F.filter(F.transform(a, lambda x, i: F.when(x != a[0], i)), lambda i: i.isNotNull())
    rows, cols = F.transform(at, lambda i: (i / width).cast("int")), F.transform(at, lambda i: i % width)
    return F.when(F.size(at) > 0, F.struct(F.array_min(rows).alias("top"), F.array_min(cols).alias("left"), (F.array_max(rows) + 1).alias("bottom"), (F.array_max(cols) + 1).alias("right")))


def crop(pixels: str | Column, width: int, box: Column) -> Column:
    """The pixels inside a box of trim_box; all of them where it is null."""
    a = col(pixels)
    keep = F.filter(a, lambda x, i: (i >= box["top"] * width) & (i < box["bottom"] * width) & (i % width >= box["left"]) & (i % width < box["right"]))
    return F.when(box.isNull(), a).otherwise(keep)


def to_gray(pixels: str | Column) -> Column:
    """Luminance of interleaved red, green, blue."""
    a = col(pixels)
    starts = F.sequence(F.lit(1), F.size(a) - 2, F.lit(3))
    return F.transform(starts, lambda i: 0.2125 * F.element_at(a, i) + 0.7154 * F.element_at(a, i + 1) + 0.0721 * F.element_at(a, i + 2))


def has_long_word(words: str | Column, limit: int = 3) -> Column:
    """A word of more than `limit` characters; by_count of too_many_words is the other reading."""
    return F.exists(col(words), lambda w: F.length(w) > limit)


def too_many_words(words: str | Column, limit: int = 3) -> Column:
    return F.size(col(words)) > limit


def header_flags(transfer_syntax: Column, photometric: Column, has_pixels: Column, decodable: Column, unsupported: list[str]) -> Column:
    """no_ts, unsupported_ts, missing_pixels, corrupt_pixels and ok of an image header."""
    flags = {"no_ts": transfer_syntax.isNull(), "unsupported_ts": F.coalesce(transfer_syntax.isin(unsupported), F.lit(False)), "missing_pixels": ~has_pixels | photometric.isNull(), "corrupt_pixels": ~decodable}
    bad = flags["no_ts"] | flags["unsupported_ts"] | flags["missing_pixels"] | flags["corrupt_pixels"]
    return F.struct(*[v.cast("int").alias(k) for k, v in flags.items()], (~bad).alias("ok"))


def gate(df, pixels: str = "pixels", group: str = "grp", file_name: str = "file_name", limits: tuple[int, int] = (50, 215)):
    """(kept, errors): images that pass the brightness gate, and a report row for each that does not."""
    ok = good_brightness(pixels, *limits)
    errors = df.where(~F.coalesce(ok, F.lit(False))).select(F.col(group).alias("group"), F.col(file_name).alias("file_name"), *[F.lit(0).alias(c) for c in ("no_TS_ID", "unsupported_TS_ID", "missing_pixels", "corrupt_pixels", "inverted_colors")], F.lit(1).alias("brightness_issues"))
    return df.where(ok), errors


def resize_nearest(pixels: str | Column, width: int, height: int, new_width: int) -> Column:
    """Nearest-pixel resize to new_width, keeping the aspect."""
    a, new_height = col(pixels), int(new_width / width * height)
    return F.transform(F.sequence(F.lit(0), F.lit(new_height * new_width - 1)), lambda i: F.element_at(a, ((F.floor(i / new_width) * height / new_height).cast("int") * width + (i % new_width * width / new_width).cast("int") + 1).cast("int")))


def overlay(image: str | Column, heat: str | Column, alpha: float = 0.4) -> Column:
    """image + alpha * heat (0..1), scaled to a maximum of 1."""
    raw = F.zip_with(col(image), col(heat), lambda x, h: x + (F.rint(255 * h) * alpha))
    return _once(raw, lambda r: _once(F.array_max(r), lambda top: F.transform(r, lambda v: F.try_divide(v, top))))


def brightness_contrast(pixels: str | Column, contrast: float = 1.0, brightness: float = 0.0) -> Column:
    a = col(pixels)
    mean = F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    return F.transform(a, lambda x: F.least(F.greatest((x - mean) * contrast + mean + brightness, F.lit(0.0)), F.lit(255.0)))
