"""Resampling, windows, colour overlays and seeded perturbation of flat, row-major images, all as column expressions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scalar import col, hash_key
from .image import _once


def _at(a: Column, i: Column) -> Column:
    return F.element_at(a, (i + 1).cast("int"))


# ---- windows


def window(pixels: str | Column, center: str | Column, width: str | Column, top: float = 255.0) -> Column:
    """Stored values through a linear window: 0 up to its lower end, `top` from its
    upper end on, straight between (the standard's LINEAR function, whose ends lie half a
    step off centre). Where center or width is null or width is below 1 the values stay."""
    c, w = col(center).cast("double") - 0.5, col(width).cast("double") - 1
    line = lambda x: F.when(w == 0, F.when(x <= c, 0.0).otherwise(top)).otherwise(F.least(F.greatest(((x - c) / w + 0.5) * top, F.lit(0.0)), F.lit(top)))
    shown = F.transform(col(pixels), lambda x: line(x.cast("double")))
    return F.when((w >= 0) & c.isNotNull(), shown).otherwise(F.transform(col(pixels), lambda x: x.cast("double")))


# ---- resampling


def taps(size: int, new: int, how: str) -> list[tuple[int, list[float]]]:
    """For each of `new` places the first of `size` places that it reads, and their weights (which sum to 1).

    bilinear: the two places around its centre, the edge beyond the edge; area:
    all places that it covers, each by the part that is covered.
    """
    out, step = [], size / new
    for o in range(new):
        if how == "bilinear":
            at = min(max((o + 0.5) * step - 0.5, 0.0), size - 1.0)
            lo = min(int(at), max(0, size - 2))
            weights = [1 - (at - lo), at - lo] if size > 1 else [1.0]
        elif how == "area":
            lo, hi = int(o * step), math.ceil((o + 1) * step - 1e-12)
            weights = [(min((o + 1) * step, i + 1) - max(o * step, i)) / step for i in range(lo, min(hi, size))]
        else:
            raise ValueError(f"no way {how} to resize")
        out.append((lo, weights))
    return out


def _taps(size: int | Column, new: int | Column, how: str) -> Column:
    """taps as an array of (lo, w): a literal for whole numbers, worked out in each row for columns."""
    if isinstance(size, int) and isinstance(new, int):
        return F.array(*[F.struct(F.lit(lo).cast("int").alias("lo"), F.lit(w).alias("w")) for lo, w in taps(size, new, how)])
    size, new = (F.lit(x) if isinstance(x, int) else x for x in (size, new))
    step = size / new

    def bilinear(o: Column) -> Column:
        at = F.least(F.greatest((o + 0.5) * step - 0.5, F.lit(0.0)), size - 1.0)
        lo = F.least(F.floor(at), F.greatest(size - 2, F.lit(0))).cast("int")
        return F.struct(lo.alias("lo"), F.when(size > 1, F.array(1 - (at - lo), at - lo)).otherwise(F.array(F.lit(1.0))).alias("w"))

    def area(o: Column) -> Column:
        lo, hi = F.floor(o * step).cast("int"), F.least(F.ceil((o + 1) * step - 1e-12), size).cast("int")
        covered = lambda i: (F.least((o + 1) * step, i + 1.0) - F.greatest(o * step, i * 1.0)) / step
        return F.struct(lo.alias("lo"), F.transform(F.sequence(lo, hi - 1), covered).alias("w"))

    if how not in ("bilinear", "area"):
        raise ValueError(f"no way {how} to resize")
    return F.transform(F.sequence(F.lit(0), (new - 1).cast("int")), bilinear if how == "bilinear" else area)


def resize(
    pixels: str | Column, width: int | Column, height: int | Column, new_width: int | Column, new_height: int | Column, how: str = "bilinear", channels: int = 1
) -> Column:
    """The image at another size; channels lie side by side. Sizes are whole numbers or columns of
    such. Rows are resampled first and columns then, each by the few places that taps names, so work
    is the sum of both and not their product."""
    if any(isinstance(x, int) and x < 1 for x in (width, height, new_width, new_height, channels)):
        raise ValueError("sizes must be at least 1")
    up_to = lambda n: F.sequence(F.lit(0), (F.lit(n) - 1 if isinstance(n, int) else n - 1).cast("int"))

    def along(a: Column, t: Column, base: Column, step: int) -> Column:
        each = F.zip_with(t["w"], F.sequence(F.lit(0), F.size(t["w"]) - 1), lambda w, k: w * _at(a, base + (t["lo"] + k) * step))
        return F.aggregate(each, F.lit(0.0), lambda s, x: s + x)

    def rows(a: Column) -> Column:
        place = lambda r, t: F.transform(up_to(channels), lambda c: along(a, t, r * width * channels + c, channels))
        whole = lambda table: F.flatten(F.transform(up_to(height), lambda r: F.flatten(F.transform(table, lambda t: place(r, t)))))
        return _once(_taps(width, new_width, how), whole)

    def columns(a: Column) -> Column:
        line = lambda t: F.transform(up_to(new_width * channels), lambda x: along(a, t, x, new_width * channels))
        return _once(_taps(height, new_height, how), lambda table: F.flatten(F.transform(table, line)))

    return _once(_once(F.transform(col(pixels), lambda x: x.cast("double")), rows), columns)


# ---- colours

#: A published polynomial of the turbo colour map, red, green, blue, lowest power first.
TURBO = (
    (0.13572138, 4.61539260, -42.66032258, 132.13108234, -152.94239396, 59.28637943),
    (0.09140261, 2.19418839, 4.84296658, -14.18503333, 4.27729857, 2.82956604),
    (0.10667330, 12.64194608, -60.58204836, 110.36276771, -89.90310912, 27.34824973),
)


def colour_table(name: str = "turbo") -> list[int]:
    """256 colours of 8 bits, red, green, blue side by side: turbo (by its polynomial), jet or gray."""
    x = np.arange(256) / 255
    if name == "turbo":
        table = [sum(c * x**k for k, c in enumerate(row)) for row in TURBO]
    elif name == "jet":
        table = [1.5 - abs(4 * x - k) for k in (3, 2, 1)]
    elif name == "gray":
        table = [x, x, x]
    else:
        raise ValueError(f"no colour table {name}")
    return np.rint(np.clip(np.stack(table, axis=1), 0, 1) * 255).astype(int).ravel().tolist()


def colour_overlay(
    image: str | Column, heat: str | Column, size: tuple[int, int], heat_size: tuple[int, int], alpha: float = 0.4, table: str = "turbo", scale: bool = True, channels: int = 3
) -> Column:
    """A heat map (values 0 to 1) in colours over an image, red, green, blue side by side.

    size, heat_size: (width, height). The heat's colours are stretched to 0..255
    over the image, brought to its size between pixels, and alpha of them is added
    to the image (of one or three channels); scale divides by the largest value.
    """
    (w, h), (hw, hh) = size, heat_size
    picked = F.flatten(F.transform(col(heat), lambda v: F.slice(F.lit(colour_table(table)), (F.least(F.greatest(F.floor(v * 255), F.lit(0)), F.lit(255)) * 3 + 1).cast("int"), 3)))
    stretched = _once(picked, lambda p: F.transform(p, lambda x: F.coalesce(F.try_divide(x - F.array_min(p), (F.array_max(p) - F.array_min(p)).cast("double")), F.lit(0.0)) * 255))
    large = resize(stretched, hw, hh, w, h, "bilinear", 3)
    under = lambda i: _at(col(image), i if channels == 3 else F.floor(i / 3))
    mixed = F.transform(large, lambda x, i: x * alpha + under(i))
    return _once(mixed, lambda m: _once(F.array_max(m), lambda top: F.transform(m, lambda x: F.try_divide(x, top)))) if scale else mixed


# ---- perturbation

TO_YIQ = np.array([[0.299, 0.587, 0.114], [0.5959, -0.2746, -0.3213], [0.2115, -0.5227, 0.3112]])  # fixed values: brightness and two colour axes
FROM_YIQ = np.linalg.inv(TO_YIQ)


def turned(cos: Column | str, sin: Column | str) -> list[list]:
    """The 3 x 3 matrix, as expressions of text or columns, that keeps brightness and turns
    and stretches the two colour axes: hue by the angle, saturation by the length of (cos, sin)."""
    base = np.outer(FROM_YIQ[:, 0], TO_YIQ[0])
    by_cos = np.outer(FROM_YIQ[:, 1], TO_YIQ[1]) + np.outer(FROM_YIQ[:, 2], TO_YIQ[2])
    by_sin = np.outer(FROM_YIQ[:, 2], TO_YIQ[1]) - np.outer(FROM_YIQ[:, 1], TO_YIQ[2])
    make = (lambda b, c, s: f"({b!r} + {c!r} * ({cos}) + {s!r} * ({sin}))") if isinstance(cos, str) else (lambda b, c, s: F.lit(b) + cos * c + sin * s)
    return [[make(float(base[i, j]), float(by_cos[i, j]), float(by_sin[i, j])) for j in range(3)] for i in range(3)]


def factor(what: str, low: float, high: float, seed: int, id_col: str) -> Column:
    """A number in [low, high) that follows from seed, id and what it is for."""
    return hash_key(f"{seed}:{what}", id_col) / F.lit(2.0**32) * (high - low) + low


def perturb(
    pixels: str | Column, width: int, height: int, id_col: str, contrast: tuple[float, float] = (0.5, 2.0), hue: float = 0.1, saturation: tuple[float, float] = (0.7, 1.25),
    brightness: float = 0.2, flip: bool = True, top: float = 255.0, seed: int = 0,
) -> Column:
    """An image of three channels with contrast, hue, saturation and brightness changed by factors of its own, and maybe mirrored.

    The factors come from hashes of seed and id: the same in every run and under
    any partitioning. Contrast works around each channel's mean; hue is a turn by
    up to `hue` of a circle; brightness adds up to that part of `top`. Values are
    cut to 0..top at the end.
    """
    n = width * height
    scale = factor("contrast", *contrast, seed, id_col)
    angle, length = factor("hue", -hue, hue, seed, id_col) * (2 * math.pi), factor("saturation", *saturation, seed, id_col)
    shift = factor("brightness", -brightness, brightness, seed, id_col) * top
    mirrored = F.lit(flip) & (factor("flip", 0.0, 1.0, seed, id_col) < 0.5)
    matrix = turned(F.cos(angle) * length, F.sin(angle) * length)
    a = col(pixels)
    mean = lambda c: F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), F.lit(0.0), lambda s, i: s + _at(a, i * 3 + c)) / n
    settings = F.struct(
        F.array(*[mean(c) for c in range(3)]).alias("means"), F.array(*[x for row in matrix for x in row]).alias("m"), scale.alias("scale"), shift.alias("shift"), mirrored.alias("mirrored"),
    )

    def image(s: Column) -> Column:
        def pixel(i: Column) -> Column:
            at = F.when(s["mirrored"], F.floor(i / width) * width + (width - 1 - i % width)).otherwise(i)
            raised = [(_at(a, at * 3 + c) - s["means"][c]) * s["scale"] + s["means"][c] for c in range(3)]
            mixed = [raised[0] * s["m"][3 * r] + raised[1] * s["m"][3 * r + 1] + raised[2] * s["m"][3 * r + 2] + s["shift"] for r in range(3)]
            return F.array(*[F.least(F.greatest(x, F.lit(0.0)), F.lit(float(top))) for x in mixed])

        return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), pixel))

    return F.when(F.size(a) == 3 * n, _once(settings, image))


def crop_or_pad(pixels: str | Column, width: int, height: int, new_width: Column, new_height: Column, channels: int = 1) -> Column:
    """The middle of the image, or the image in the middle of zeros, at a size that may differ from row to row."""
    a = col(pixels)
    left, up = F.floor((new_width - width) / 2), F.floor((new_height - height) / 2)
    left, up = F.when(new_width < width, -F.floor((width - new_width) / 2)).otherwise(left), F.when(new_height < height, -F.floor((height - new_height) / 2)).otherwise(up)

    def value(i: Column) -> Column:
        x, y, c = F.floor(i / channels) % new_width - left, F.floor(F.floor(i / channels) / new_width) - up, i % channels
        inside = (x >= 0) & (x < width) & (y >= 0) & (y < height)
        return F.when(inside, _at(a, (y * width + x) * channels + c)).otherwise(0)

    return F.when((new_width > 0) & (new_height > 0), F.transform(F.sequence(F.lit(0), (new_width * new_height * channels - 1).cast("int")), value))
