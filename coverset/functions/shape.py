"""Shape of a point cloud from its second moments."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def symmetric_eigenvalues(a: Column, b: Column, c: Column, d: Column, e: Column, f: Column) -> Column:
    """Ascending eigenvalues of ``[[a, d, e], [d, b, f], [e, f, c]]`` in closed form."""
    mean = (a + b + c) / 3.0
    off = d * d + e * e + f * f
    spread = F.sqrt(((a - mean) * (a - mean) + (b - mean) * (b - mean) + (c - mean) * (c - mean) + 2.0 * off) / 6.0)
    x, y, z = a - mean, b - mean, c - mean
    determinant = x * (y * z - f * f) - d * (d * z - f * e) + e * (d * f - y * e)
    scale = F.when(spread > 0, spread).otherwise(F.lit(1.0))
    ratio = F.least(F.greatest(determinant / (2.0 * scale * scale * scale), F.lit(-1.0)), F.lit(1.0))
    angle = F.acos(ratio) / 3.0
    high = mean + 2.0 * spread * F.cos(angle)
    low = mean + 2.0 * spread * F.cos(angle + F.lit(2.0 * math.pi / 3.0))
    return F.array(low, 3.0 * mean - high - low, high)


def point_shape(df: DataFrame, id_col: str = "id", x: str = "x", y: str = "y", z: str = "z") -> DataFrame:
    """``(id, moment_1..3, sphericity, asphericity)`` per group of points.

    Moments are the ascending principal second moments about the mean. The two
    ratios are null unless all three moments are above zero.
    """
    sums = df.groupBy(F.col(id_col).alias("id")).agg(
        F.var_pop(x).alias("a"), F.var_pop(y).alias("b"), F.var_pop(z).alias("c"),
        F.covar_pop(x, y).alias("d"), F.covar_pop(x, z).alias("e"), F.covar_pop(y, z).alias("f"),
    )
    moments = sums.select("id", symmetric_eigenvalues(*[F.col(k) for k in "abcdef"]).alias("m"))
    # Rounding noise of a flat or straight cloud counts as zero.
    noise = F.abs(F.get("m", F.lit(2))) * 1e-12
    clean = F.transform("m", lambda v: F.when(v > noise, v).otherwise(F.lit(0.0)))
    split = moments.select("id", clean.alias("m")).select("id", *[F.get("m", F.lit(k)).alias(f"moment_{k + 1}") for k in range(3)])
    m1, m2, m3 = (F.col(f"moment_{k}") for k in (1, 2, 3))
    solid = (m1 > 0) & (m2 > 0) & (m3 > 0)
    return split.withColumn("sphericity", F.when(solid, m1 / m3)).withColumn(
        "asphericity", F.when(solid, (m3 - (m1 + m2) / 2.0) / m3)
    )
