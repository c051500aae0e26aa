"""Blends of scores, and what tells two score vectors apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import avg_rank, pct_rank, quantiles, top_n_cut
from ..functions.stats import spearman


def rank_blend(df: DataFrame, a: str, b: str, weight: float, out: str = "blend") -> DataFrame:
    """weight * r_a + (1 - weight) * r_b over percentile ranks."""
    both = pct_rank(pct_rank(df, a, "__ra"), b, "__rb")
    return both.withColumn(out, weight * F.col("__ra") + (1 - weight) * F.col("__rb")).drop("__ra", "__rb")


def weighted_rank_average(df: DataFrame, columns: list[str], weights: list[float], out: str = "blend") -> DataFrame:
    for i, c in enumerate(columns):
        df = avg_rank(df, c, f"__r{i}")
    total = sum(F.col(f"__r{i}") * w for i, w in enumerate(weights)) / sum(weights)
    return df.withColumn(out, total).drop(*[f"__r{i}" for i in range(len(columns))])


def probability_blend(df: DataFrame, columns: list[str], weights: list[float], n: int, key: str) -> DataFrame:
    """Weighted sum of scores, and 1 for its n highest rows."""
    blended = df.withColumn("blend", sum(F.col(c) * w for c, w in zip(columns, weights)))
    return top_n_cut(blended, "blend", key, n, "predicted")


def disagreement(df: DataFrame, a: str, b: str, limit: float = 0.5) -> DataFrame:
    """One row: Spearman, median, 90 and 99 % quantiles of both, and the rows whose percentile ranks differ by more than ``limit``."""
    both = pct_rank(pct_rank(df.select(a, b), a, "ra"), b, "rb")
    q = lambda c, name: F.broadcast(quantiles(df, c, [0.5, 0.9, 0.99]).withColumnRenamed("q", name))
    agg = both.agg(F.sum((F.abs(F.col("ra") - F.col("rb")) > limit).cast("long")).alias("strong"), F.avg((F.abs(F.col("ra") - F.col("rb")) > limit).cast("double")).alias("strong_share"))
    cells = [F.col(f"q{x}")[i].alias(f"{x}_{n}") for x in "ab" for i, n in enumerate(("q50", "q90", "q99"))]
    return agg.join(q(a, "qa"), F.lit(True), "left").join(q(b, "qb"), F.lit(True), "left").crossJoin(spearman(df, a, b)).select("spearman", *cells, "strong", "strong_share")


def aligned(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: keys that only one side has, and whether there are none."""
    x, y = a.select(F.col(key).alias("x")), b.select(F.col(key).alias("y"))
    lost = x.join(y, F.col("x") == F.col("y"), "full_outer").agg(F.sum((F.col("x").isNull() | F.col("y").isNull()).cast("long")).alias("unmatched"))
    return lost.select("unmatched", (F.col("unmatched") == 0).alias("aligned"))


def borda(df: DataFrame, columns: list[str], out: str = "blend") -> DataFrame:
    return weighted_rank_average(df, columns, [1.0] * len(columns), out)


def geometric_blend(df: DataFrame, columns: list[str], out: str = "blend") -> DataFrame:
    logs = sum(F.ln(F.greatest(F.col(c), F.lit(1e-12))) for c in columns)
    return df.withColumn(out, F.exp(logs / len(columns)))


def max_blend(df: DataFrame, columns: list[str], out: str = "blend") -> DataFrame:
    return df.withColumn(out, F.greatest(*columns))
