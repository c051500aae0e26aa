"""Global order without a single task: row numbers, running totals, ranks, cuts."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, width

#: A value of more than 1 in HOT rows is joined by broadcast.
HOT = 1024


def running_total(df: DataFrame, order: list[Column], value: str | None, out: str, keep: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """Add the running sum of ``value`` (None: rows) in the global order of ``order``.

    Rows are range partitioned and summed by partition; a partition then adds the total of
    those before it.  Only one total a partition meets in one place.  ``keep`` materialises the
    partitions, ``stored`` with less disk than ``cut``.
    """
    ranged = keep(df.repartitionByRange(width(df), *order).withColumn("__part", F.spark_partition_id()))
    amount = F.lit(1).cast("long") if value is None else F.col(value)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("__part").agg(F.sum(amount).alias("__total")).select("__part", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return ranged.join(F.broadcast(offsets), "__part").withColumn(out, F.sum(amount).over(within) + F.col("__before")).drop("__part", "__before")


def row_numbers(df: DataFrame, order: list[Column], out: str = "rn", keep: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """Number all rows from 1 in a global order that must be total."""
    return running_total(df, order, None, out, keep)


def value_ranks(df: DataFrame, column: str) -> DataFrame:
    """(column, avg_rank): the rank of each distinct value that is not null, ties averaged."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("__n"))
    running = running_total(counts, [F.col(column)], "__n", "__upto")
    return running.select(column, (F.col("__upto") - (F.col("__n") - 1) / 2).cast("double").alias("avg_rank"), "__n")


def avg_rank(df: DataFrame, column: str, out: str) -> DataFrame:
    """Add the average-tie rank of ``column``; a null has none.

    Values of more than 1 in HOT of the rows, HOT values at most, find their rows by broadcast;
    those rows and nulls go to any task of the join for the others.
    """
    ranks = cut(value_ranks(df, column).select(F.col(column).alias("__v"), F.col("avg_rank").alias(out), F.col("__n")))
    rows = ranks.agg(F.sum("__n")).first()[0] or 0
    hot = F.broadcast(ranks.where(F.col("__n") * HOT > rows).select(F.col("__v").alias("__h"), F.col(out).alias("__hot")))
    near = df.join(hot, F.col(column) == F.col("__h"), "left").drop("__h")
    lone = F.when(F.col("__hot").isNotNull() | F.col(column).isNull(), F.monotonically_increasing_id()).otherwise(F.lit(-1))
    every = ranks.select(F.col("__v"), F.lit(-1).cast("long").alias("__s"), F.col(out))
    spread = near.withColumn("__l", lone)
    joined = spread.join(every, (F.col("__l") == F.col("__s")) & F.when(F.col("__l") < 0, F.col(column)).eqNullSafe(F.col("__v")), "left")
    return joined.withColumn(out, F.coalesce("__hot", out)).drop("__l", "__s", "__v", "__hot")


def pct_rank(df: DataFrame, column: str, out: str) -> DataFrame:
    """Average-tie rank divided by the number of values that are not null, in (0, 1]."""
    rows = df.where(F.col(column).isNotNull()).count()
    return avg_rank(df, column, out).withColumn(out, F.col(out) / F.lit(float(rows)))


def top_n_cut(df: DataFrame, score: str, key: str, n: int, out: str) -> DataFrame:
    """1 for the n rows of highest score (ties to the smaller key; a null score is the lowest), else 0.

    The n-th row is found with a bounded sort; the rest is a filter expression.
    """
    last = df.orderBy(F.col(score).desc_nulls_last(), F.col(key)).limit(n).agg(F.min_by(F.struct(score, key), F.struct(F.col(score), -F.col(key))).alias("x")).first()["x"]
    if last is None:
        return df.withColumn(out, F.lit(0))
    s, k = F.lit(last[score]), F.lit(last[key])
    above = F.col(score).isNotNull() if last[score] is None else F.coalesce(F.col(score) > s, F.lit(False))
    return df.withColumn(out, (above | (F.col(score).eqNullSafe(s) & (F.col(key) <= k))).cast("int"))


def quantiles(df: DataFrame, value: str, shares: list[float], by: list[str] | None = None) -> DataFrame:
    """(by..., q): the interpolated quantiles of ``value`` (double, nulls left out) of each group, in order of
    ``shares``, exactly and without a task that holds a group: distinct values are numbered in
    a global order, and a quantile lies on the values that cover its two places."""
    by = by or []
    own = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("__x"))
    counts = own.groupBy(*by, "__x").agg(F.count(F.lit(1)).alias("__n"))
    upto = running_total(counts, [F.col(c) for c in [*by, "__x"]], "__n", "__upto")
    group = upto.groupBy(*by).agg(F.sum("__n").alias("__rows"), F.max("__upto").alias("__end"))
    if by:
        keys = [F.col(f"__g{i}").eqNullSafe(F.col(c)) for i, c in enumerate(by)]
        group = group.select(*[F.col(c).alias(f"__g{i}") for i, c in enumerate(by)], "__rows", "__end")
        placed = upto.join(group, reduce(lambda a, b: a & b, keys))
    else:
        placed = upto.crossJoin(F.broadcast(group))
    last = F.col("__upto") - (F.col("__end") - F.col("__rows"))
    each = placed.select(*by, "__x", (last - F.col("__n")).alias("__from"), last.alias("__to"), "__rows", F.posexplode(F.array(*[F.lit(float(s)) for s in shares])).alias("__i", "__share"))
    place = F.col("__share") * (F.col("__rows") - 1)
    low, part = F.floor(place), place - F.floor(place)
    holds = lambda at: (at >= F.col("__from")) & (at < F.col("__to"))
    ends = each.groupBy(*by, "__i").agg(F.max(F.when(holds(low), F.col("__x"))).alias("a"), F.max(F.when(holds(F.least(low + 1, F.col("__rows") - 1)), F.col("__x"))).alias("b"), F.first(part).alias("p"))
    q = ends.select(*by, "__i", (F.col("a") + (F.col("b") - F.col("a")) * F.col("p")).alias("q"))
    return q.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", "q"))), lambda x: x["q"]).alias("q"))
