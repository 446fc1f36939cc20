"""Linear-model functionals from moments: covariances, regression coefficients and biases of adjustment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def covariance(rows: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """group, a, b, cov for each pair of columns with a <= b, in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    found = rows.groupBy(group).agg(*[F.covar_samp(a, b).alias(f"{a}|{b}") for a, b in pairs])
    listed = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}|{b}").alias("cov")) for a, b in pairs])
    return found.select(group, F.explode(listed).alias("z")).select(group, "z.a", "z.b", "z.cov")


def _cov(a: str, b: str) -> Column:
    return F.covar_samp(a, b)


def effect(x: str, y: str, adjust: str | None = None) -> Column:
    """Aggregate: the coefficient of x in the regression of y on x and, if given, one more column."""
    if adjust is None:
        return _cov(x, y) / F.var_samp(x)
    z = adjust
    return (_cov(x, y) * F.var_samp(z) - _cov(z, y) * _cov(x, z)) / (F.var_samp(x) * F.var_samp(z) - _cov(x, z) * _cov(x, z))


def adjustment_shift(rows: DataFrame, group: str, x: str, y: str, z: str) -> DataFrame:
    """group, plain, adjusted, shift: how far adjusting for z moves the effect of x on y."""
    found = rows.groupBy(group).agg(effect(x, y).alias("plain"), effect(x, y, z).alias("adjusted"))
    return found.withColumn("shift", F.col("plain") - F.col("adjusted"))
