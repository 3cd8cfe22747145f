"""Column functions that the operators share; all stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def half_even(x: ColumnLike, digits: int = 4) -> Column:
    """Round half to even, as array libraries do; Spark's round goes half up."""
    return F.rint(col(x) * 10.0**digits) / 10.0**digits


def ratio(a: ColumnLike, b: ColumnLike, undefined: float | None = 0.0) -> Column:
    """a / b, and `undefined` where b is 0 (null stays null for undefined=None)."""
    out = F.try_divide(col(a).cast("double"), col(b).cast("double"))
    return out if undefined is None else F.coalesce(out, F.lit(float(undefined)))


def nan_to_null(x: ColumnLike) -> Column:
    return F.when(~F.isnan(col(x)), col(x))


def hash_key(seed: int | str, *parts: ColumnLike) -> Column:
    """A uniform number in [0, 2^32) from md5 of "seed:part:..."; any SQL engine can recompute it."""
    text = F.concat_ws(":", F.lit(str(seed)), *[col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def any_positive(*flags: ColumnLike) -> Column:
    """1 if a flag is above 0, nulls counting as 0."""
    return (reduce(lambda a, b: a + b, [F.coalesce(col(f), F.lit(0)) for f in flags]) > 0).cast("int")


def completed_years(start: ColumnLike, end: ColumnLike) -> Column:
    return (F.months_between(col(end), col(start)) / 12).cast("int")


def contains_map(x: ColumnLike, pairs: list[tuple[str, str]], default: str = "") -> Column:
    """The label of the last pair whose needle is in x: later pairs override earlier ones."""
    out = F.lit(default)
    for needle, label in pairs:
        out = F.when(F.contains(col(x), F.lit(needle)), F.lit(label)).otherwise(out)
    return out


def cut(x: ColumnLike, edges: list[float], labels: list[str], right: bool = True, missing: str = "nan") -> Column:
    """Label of the bin that holds x; bins are (a, b] or, with right=False, [a, b)."""
    out = None
    for lo, hi, label in zip(edges, edges[1:], labels):
        hit = (col(x) > lo) & (col(x) <= hi) if right else (col(x) >= lo) & (col(x) < hi)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(missing)


def recode(x: ColumnLike, mapping: dict[str, str]) -> Column:
    """Upper case, then the mapping's value where it has one."""
    up = F.upper(col(x))
    return F.coalesce(F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv])[up], up) if mapping else up


def trim_zeroes(x: ColumnLike, width: int = 6) -> Column:
    """What follows the second underscore loses leading characters beyond the last `width`; shorter tails stay."""
    head, tail = F.substring_index(col(x), "_", 2), F.expr(f"substring({x}, length(substring_index({x}, '_', 2)) + 2)")
    return F.when(F.length(tail) > width, F.concat(head, F.lit("_"), F.right(tail, F.lit(width)))).otherwise(col(x))


def first_dot_extension(x: ColumnLike) -> Column:
    """From the first dot on; null without one."""
    at = F.instr(col(x), ".")
    return F.when(at > 0, F.substring(col(x), at, F.length(col(x))))


def strip_extension(x: ColumnLike) -> Column:
    return F.regexp_replace(col(x), r"\.[^.]+$", "")


def format_interval(stat: ColumnLike, lower: ColumnLike, upper: ColumnLike, digits: int = 4) -> Column:
    """stat (lower, upper); null where one of them is."""
    f = lambda c: F.when(col(c).isNotNull(), F.format_string(f"%.{digits}f", half_even(c, digits)))
    return F.concat(f(stat), F.lit(" ("), f(lower), F.lit(", "), f(upper), F.lit(")"))


def nearest_percentile(values: ColumnLike, q: ColumnLike) -> Column:
    """Of an array the element at rint(q/100 * (n-1)) of its sorted, non-null values."""
    s = F.array_sort(F.filter(col(values), lambda v: v.isNotNull() & ~F.isnan(v)))
    return F.try_element_at(s, F.rint(col(q) / 100 * (F.size(s) - 1)).cast("int") + 1)
