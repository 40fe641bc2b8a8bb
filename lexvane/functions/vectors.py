"""Vector functions, in double precision. Vectors are stored raw; scaling is the reader's choice."""

from __future__ import annotations

from math import log, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLOOR = 1e-12


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(l2(a) * l2(b), F.lit(FLOOR))


def resolve_scale(scale, d: int, absent: str = "none") -> float | None:
    """None, 'raw' and 'none' leave vectors as they are; 'sqrt_d_model' is sqrt(d); a number is itself. absent='sqrt' makes None sqrt(d)."""
    if scale is None:
        return sqrt(d) if absent == "sqrt" else None
    if scale in ("raw", "none"):
        return None
    return sqrt(d) if scale == "sqrt_d_model" else float(scale)


def normalize(v: Column, scale: float | Column | None) -> Column:
    """v with L2 norm scale, as array<double>; a zero vector stays zero; no scale: as it is."""
    if scale is None:
        return F.transform(v, lambda x: x.cast("double"))
    factor = (F.lit(scale) if isinstance(scale, (int, float)) else scale) / F.greatest(l2(v), F.lit(FLOOR))
    return F.transform(F.array(factor), lambda f: F.transform(v, lambda x: x.cast("double") * f))[0]  # the norm once a row


def pair_mse(pred: Column, gold: Column, scale: float | None = None) -> Column:
    """Mean squared difference of the scaled vectors; from norms and a dot product, so no scaled copy is made.

    Without a scale, of the raw vectors. Vectors of different lengths give null.
    """
    n = F.size(gold)
    if scale is None:
        value = F.aggregate(F.zip_with(pred, gold, lambda x, y: x.cast("double") - y.cast("double")), F.lit(0.0), lambda s, x: s + x * x)
    else:
        np_, ng = l2(pred), l2(gold)
        kept = lambda m: F.when(m > FLOOR, 1.0).otherwise(m * m / FLOOR**2)
        value = scale**2 * (kept(np_) + kept(ng) - 2 * dot(pred, gold) / (F.greatest(np_, F.lit(FLOOR)) * F.greatest(ng, F.lit(FLOOR))))
    return F.when(F.size(pred) == n, F.greatest(value, F.lit(0.0)) / n)


def digest(vector: Column) -> Column:
    """A whole number that depends on every component and its place, the same in every engine: the sum of floor(x * 2**20) times the place, from 1."""
    parts = F.transform(vector, lambda x, i: F.floor(x.cast("double") * 1048576.0) * (i + 1))
    return F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + x)


def reward(mse: Column, status: Column, log_mode: bool = False) -> Column:
    """-mse, or -ln(max(mse, 1e-8)); a row that isn't COMPLETED or has no mse gets -2 (-ln 2), below any success."""
    good = (status == "COMPLETED") & mse.isNotNull()
    return F.when(good, -F.log(F.greatest(mse, F.lit(1e-8))) if log_mode else -mse).otherwise(F.lit(-log(2.0) if log_mode else -2.0))


def mismatch(train: Column, rollout: Column, mask: Column) -> Column:
    """struct(n, ratio, abs_ratio, k3): means over the masked places of r, |r - 1| and (r - 1) - ln r, with r = exp(train - rollout).

    Arrays of different lengths give null; without masked places n is 0 and the means are null.
    """
    deltas = F.filter(F.zip_with(F.zip_with(train, rollout, lambda t, s: t - s), mask, lambda d, m: F.when(m == 1, d)), lambda d: d.isNotNull())
    n = F.size(deltas)
    mean = lambda f: F.when(n > 0, F.aggregate(deltas, F.lit(0.0), lambda s, d: s + f(d)) / n)
    whole = F.struct(n.alias("n"), mean(F.exp).alias("ratio"), mean(lambda d: F.abs(F.exp(d) - 1)).alias("abs_ratio"), mean(lambda d: F.exp(d) - 1 - d).alias("k3"))
    return F.when((F.size(train) == F.size(rollout)) & (F.size(train) == F.size(mask)), whole)


def assert_width(df: DataFrame, column: str, d: int) -> DataFrame:
    """df with column as array<float>; a row of another width than d is an error, told before anything is written."""
    low, high = df.agg(F.min(F.size(column)), F.max(F.size(column))).first()
    if low is not None and (low != d or high != d):
        raise ValueError(f"{column} is {low} to {high} wide, not {d}")
    return df.withColumn(column, F.col(column).cast("array<float>"))
