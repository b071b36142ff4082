"""Exact order statistics that never gather a column in one task."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Up to here Spark's own exact percentile holds its values comfortably.
SMALL_ROWS = 1_000_000
BINS = 1024


def _narrow(df: DataFrame, targets: DataFrame) -> DataFrame:
    """One counting pass: shrink every target's interval to one of its bins.

    ``targets`` is ``(grp, rank, below, lo, hi)``: the wanted 0-based rank, the
    rows under ``lo``, and the closed interval known to hold it.
    """
    # Each bound is divided first, as their difference may overflow. A width of zero (neighbouring numbers) parts
    # the least value from the rest, so that every pass makes progress.
    width = F.col("hi") / BINS - F.col("lo") / BINS
    step = F.when(width > 0, F.least(F.floor(F.col("x") / width - F.col("lo") / width), F.lit(BINS - 1)))
    at = F.when(F.col("x") == F.col("lo"), 0).otherwise(F.greatest(F.coalesce(step, F.lit(1)), F.lit(1)))
    binned = (
        df.join(F.broadcast(targets), "grp")
        .filter(F.col("x").between(F.col("lo"), F.col("hi")))
        .groupBy("grp", "rank", "below", F.coalesce(at, F.lit(0)).cast("int").alias("bin"))
        .agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    )
    before = Window.partitionBy("grp", "rank").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    counted = binned.withColumn("below", F.col("below") + F.coalesce(F.sum("n").over(before), F.lit(0)))
    inside = (F.col("rank") >= F.col("below")) & (F.col("rank") < F.col("below") + F.col("n"))
    return counted.filter(inside).select("grp", "rank", "below", "lo", "hi")


def order_statistics(df: DataFrame, ranks: DataFrame, extremes: DataFrame) -> list:
    """Rows ``(grp, rank, value)`` for the 0-based ``(grp, rank)`` wanted.

    The value range of each target is cut into ``BINS`` parts and re-counted
    until a single value is left: a few map-side-combined passes over ``(grp,
    x)``, whatever its size. ``grp`` has few values (features, or one).
    """
    spark = df.sparkSession
    schema = "grp long, rank long, below long, lo double, hi double"
    targets = ranks.join(extremes, "grp").select("grp", "rank", F.lit(0).cast("long").alias("below"), "lo", "hi")
    open_rows, done = [tuple(r) for r in targets.distinct().collect()], []
    while open_rows:
        done += [(g, r, lo) for g, r, _, lo, hi in open_rows if lo == hi]
        open_rows = [t for t in open_rows if t[3] < t[4]]
        if open_rows:
            open_rows = [tuple(r) for r in _narrow(df, spark.createDataFrame(open_rows, schema)).collect()]
    return done


def quantiles(df: DataFrame, probs: list[float], small_rows: int = SMALL_ROWS) -> dict:
    """Interpolated quantiles of ``(grp, x)``: ``{grp: [value per probability]}``."""
    stats = df.groupBy("grp").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    counts = {r["grp"]: r["n"] for r in stats.collect()}
    if not counts:
        return {}
    if sum(counts.values()) <= small_rows:
        rows = df.groupBy("grp").agg(F.percentile("x", F.lit(probs)).alias("q")).collect()
        return {r["grp"]: list(r["q"]) for r in rows}
    wanted = set()
    for grp, n in counts.items():
        for p in probs:
            wanted |= {(grp, math.floor(p * (n - 1))), (grp, math.ceil(p * (n - 1)))}
    ranks = df.sparkSession.createDataFrame(sorted(wanted), "grp long, rank long")
    found = {(g, r): v for g, r, v in order_statistics(df, ranks, stats)}
    out = {}
    for grp, n in counts.items():
        values = []
        for p in probs:
            lo = math.floor(p * (n - 1))
            a, b = found[grp, lo], found[grp, math.ceil(p * (n - 1))]
            values.append(a + (b - a) * (p * (n - 1) - lo))
        out[grp] = values
    return out


def ranked_values(df: DataFrame, column: str, ranks: list[int], n: int, small_rows: int = SMALL_ROWS) -> list[float]:
    """Values at 0-based ``ranks`` of the sorted column of ``n`` non-null rows."""
    if n <= small_rows:
        exprs = [
            F.expr(f"percentile_disc({(k + 0.5) / n!r}D) WITHIN GROUP (ORDER BY `{column}`)").alias(f"q{i}")
            for i, k in enumerate(ranks)
        ]
        return list(df.agg(*exprs).first())
    long = df.select(F.lit(0).cast("long").alias("grp"), F.col(column).cast("double").alias("x"))
    extremes = long.groupBy("grp").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    wanted = df.sparkSession.createDataFrame([(0, k) for k in sorted(set(ranks))], "grp long, rank long")
    found = {r: v for _, r, v in order_statistics(long, wanted, extremes)}
    return [found[k] for k in ranks]
