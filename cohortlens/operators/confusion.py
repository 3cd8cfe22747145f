"""Counts of a 2x2 table by group, and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import col, half_even, ratio


def threshold(p: str | Column, cut: float | Column = 0.5) -> Column:
    """1 where p >= cut."""
    return (col(p) >= cut).cast("int")


def counts(df: DataFrame, by: tuple[str, ...] = (), y: str | Column = "y", yhat: str | Column = "yhat") -> DataFrame:
    """n, tp, fp, tn, fn for each group: one aggregation with partial sums, no Python."""
    y, yhat = col(y), col(yhat)
    one = lambda c: F.count_if(c)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), one((y == 1) & (yhat == 1)).alias("tp"), one((y == 0) & (yhat == 1)).alias("fp"), one((y == 0) & (yhat == 0)).alias("tn"), one((y == 1) & (yhat == 0)).alias("fn")
    )


class Rates:
    """Rates as columns over count columns tp, fp, tn, fn; undefined ones are 0."""

    def __init__(self, tp: str | Column = "tp", fp: str | Column = "fp", tn: str | Column = "tn", fn: str | Column = "fn"):
        tp, fp, tn, fn = map(col, (tp, fp, tn, fn))
        self.sens, self.spec = ratio(tp, tp + fn), ratio(tn, tn + fp)
        self.ppv, self.npv = ratio(tp, tp + fp), ratio(tn, tn + fn)
        self.markedness = self.ppv + self.npv - 1
        defined = ((tp + fn) > 0) & ((tn + fp) > 0)
        predicted = ((tp + fp) > 0) & ((tn + fn) > 0)
        self._j = F.when(defined, self.sens + self.spec - 1)
        self._j_of_prediction = F.when(predicted, self.ppv + self.npv - 1)  # roles of label and prediction exchanged
        self._m_of_prediction = self.sens + self.spec - 1

    def youden(self, a: float = 1.0, b: float = 1.0) -> Column:
        """Weighted J; null where a class is empty."""
        wa, wb = 2 * a / (a + b), 2 * b / (a + b)
        return self._j if wa == wb == 1 else F.when(self._j.isNotNull(), wa * self.sens + wb * self.spec - 1)

    def f_score(self, b: float = 1.0) -> Column:
        return ratio((1 + b * b) * self.sens * self.ppv, b * b * self.ppv + self.sens)

    def abs_mcc(self) -> Column:
        """The fourth root of J, J with roles exchanged, and both markednesses: the size of the
        correlation without its sign; null where a J is undefined."""
        product = self._j * self._j_of_prediction * self.markedness * self._m_of_prediction
        return F.when(product == 0, 0.0).otherwise(F.pow(product, 0.25))


def counts_from_rates(se: Column, sp: Column, p: Column, n: Column) -> dict[str, Column]:
    """tp, fp, tn, fn rebuilt from rates; each is rounded half to even, so they need not add up."""
    pos = F.rint(p * n)
    neg = n - pos
    return {k: F.rint(x).cast("long") for k, x in (("tp", se * pos), ("fp", (1 - sp) * neg), ("tn", sp * neg), ("fn", (1 - se) * pos))}


def ppv_from_rates(se: Column, sp: Column, p: Column | float) -> Column:
    return ratio(se * p, se * p + (1 - sp) * (1 - p), None)


def npv_from_rates(se: Column, sp: Column, p: Column | float) -> Column:
    return ratio(sp * (1 - p), sp * (1 - p) + (1 - se) * p, None)


def abs_mcc_from_rates(se: Column, sp: Column, p: Column | float) -> Column:
    """An extension: the size of the correlation that rates and prevalence imply."""
    ppv, npv = ppv_from_rates(se, sp, p), npv_from_rates(se, sp, p)
    return F.sqrt(F.abs((se + sp - 1) * (ppv + npv - 1)))


def mcnemar(df: DataFrame, corrected: bool = True) -> DataFrame:
    """b (label 0, prediction 1), c (label 1, prediction 0) and the chi-square statistic of count rows."""
    b, c = F.col("fp"), F.col("fn")
    top = F.pow(F.abs(b - c) - 1, 2) if corrected else F.pow((b - c).cast("double"), 2)
    return df.withColumns({"b": b, "c": c, "stat": ratio(top, b + c, None)})


def observations(cells: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (y, yhat, at) for count rows: true negatives first, then fn, fp, tp.

    Each cell is unfolded in runs of 10,000, so no row carries a long array.
    """
    parts = F.array(*[F.struct(F.lit(i).alias("o"), F.lit(y).alias("y"), F.lit(h).alias("yhat"), F.col(c).alias("k")) for i, (c, y, h) in enumerate((("tn", 0, 0), ("fn", 1, 0), ("fp", 0, 1), ("tp", 1, 1)))])
    cell = cells.select(*keep, "tn", "fn", "fp", F.explode(parts).alias("e")).where("e.k > 0")
    before = F.when(F.col("e.o") >= 1, F.col("tn")).otherwise(0) + F.when(F.col("e.o") >= 2, F.col("fn")).otherwise(0) + F.when(F.col("e.o") >= 3, F.col("fp")).otherwise(0)
    runs = cell.withColumn("before", before).withColumn("run", F.explode(F.expr("sequence(0L, (e.k - 1) div 10000)")))
    at = F.explode(F.expr("sequence(run * 10000, least(e.k, (run + 1) * 10000) - 1)"))
    return runs.withColumn("i", at).select(*keep, F.col("e.y").alias("y"), F.col("e.yhat").alias("yhat"), (F.col("before") + F.col("i")).cast("long").alias("at"))


def brier(y: str | Column = "y", p: str | Column = "p") -> Column:
    return F.avg(F.pow(col(p) - col(y), 2))


def brier_multiclass(label: str | Column, probs: str | Column) -> Column:
    """Mean over rows of the squared distance of an array of probabilities to the one-hot label (from 0)."""
    return F.avg(F.aggregate(F.transform(col(probs), lambda p, i: F.pow(p - (i == col(label)).cast("double"), 2)), F.lit(0.0), lambda a, b: a + b))


def rounded(df: DataFrame, names: list[str], digits: int = 4) -> DataFrame:
    return df.withColumns({n: half_even(n, digits) for n in names})
