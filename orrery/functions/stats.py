"""Descriptive statistics as DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import avg_rank, quantiles, running_total


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def mode_share(df: DataFrame, column: str) -> DataFrame:
    """One row: the most frequent value (ties: the smallest), its share, and the number of values."""
    n = value_counts(df, column)
    top = n.agg(F.min_by(column, F.struct(-F.col("n"), F.col(column))).alias("top"), F.max("n").alias("most"), F.sum("n").alias("total"), F.count(F.lit(1)).alias("n_values"))
    return top.select("top", (F.col("most") / F.col("total")).alias("share"), "n_values")


def top_other(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """Counts of the n most frequent values, and of all others together as (other)."""
    counts = value_counts(df, column)
    top = counts.orderBy(F.col("n").desc(), column).limit(n).select(F.col(column).alias("__t"))
    named = counts.join(F.broadcast(top), F.col(column) == F.col("__t"), "left")
    return named.groupBy(F.coalesce("__t", F.lit("(other)")).alias(column)).agg(F.sum("n").alias("n"))


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, count, mean, std, min, q25, q50, q75, max), quantiles interpolated."""
    parts = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])))
    agg = parts.groupBy("column").agg(F.count("x").alias("count"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))
    both = agg.join(quantiles(parts, "x", [0.25, 0.5, 0.75], ["column"]), "column", "left")
    return both.select("column", "count", "mean", "std", "min", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"), "max")


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """(bin, low, n) over equal widths between the extremes; the last bin is closed."""
    lim = F.broadcast(df.agg(F.min(column).alias("lo"), F.max(column).alias("hi")))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(width > 0, F.least(F.floor((F.col(column) - F.col("lo")) / width), F.lit(bins - 1))).otherwise(F.lit(0)).cast("long")
    return df.crossJoin(lim).select(at.alias("bin"), (F.col("lo") + at * width).alias("low")).groupBy("bin").agg(F.min("low").alias("low"), F.count(F.lit(1)).alias("n"))


def ccdf(df: DataFrame, column: str) -> DataFrame:
    """(column, n, ccdf): share of rows at or above each value."""
    counts = value_counts(df, column)
    total = counts.agg(F.sum("n")).first()[0] or 0
    upto = running_total(counts, [F.col(column).desc()], "n", "__upto")
    return upto.select(column, "n", (F.col("__upto") / F.lit(float(total))).alias("ccdf"))


def pearson_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x, y, corr) of every ordered pair of columns, in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{k}") for k, (a, b) in enumerate(pairs)])
    cells = [F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"c{k}").alias("corr")) for k, (a, b) in enumerate(pairs) for x, y in {(a, b), (b, a)}]
    return one.select(F.inline(F.array(*cells)))


def ranked(df: DataFrame, columns: list[str]) -> DataFrame:
    return reduce(lambda d, c: avg_rank(d, c, f"__r_{c}").drop(c).withColumnRenamed(f"__r_{c}", c), columns, df)


def spearman_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    return pearson_matrix(ranked(df.select(*columns), columns), columns)


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    return ranked(df.select(a, b), [a, b]).agg(F.corr(a, b).alias("spearman"))


def strongest(matrix: DataFrame, left: list[str], right: list[str]) -> DataFrame:
    """The pair of a left and a right column with the largest absolute correlation."""
    block = matrix.where(F.col("x").isin(left) & F.col("y").isin(right))
    return block.orderBy(F.abs("corr").desc(), "x", "y").limit(1)


def auc(df: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve from average ranks (Mann-Whitney), by group; null without both labels."""
    by = by or []
    counts = df.groupBy(*by, score).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("double")).alias("pos"))
    upto = running_total(counts, [F.col(c) for c in [*by, score]], "n", "upto")  # over all groups: each begins at its end less its rows
    ranks = F.sum(F.col("pos") * (F.col("upto") - (F.col("n") - 1) / 2))
    out = upto.groupBy(*by).agg(ranks.alias("r"), F.sum("pos").alias("p"), F.sum("n").alias("t"), F.max("upto").alias("end"))
    p, q = F.col("p"), F.col("t") - F.col("p")
    out = out.withColumn("r", F.col("r") - p * (F.col("end") - F.col("t")))
    return out.select(*by, F.when((p > 0) & (q > 0), (F.col("r") - p * (p + 1) / 2) / (p * q)).alias("auc"))
