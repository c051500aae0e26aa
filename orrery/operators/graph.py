"""Edges, degrees, indexes and weights."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import row_numbers

#: Edges of a graph that a single task takes whole, at most; larger graphs go by joins.
IN_TASK = 3 << 20
#: Rows of a node table that joins broadcast, at most; that tasks hold as arrays.
SMALL, HELD = 1 << 18, 1 << 22


def canonical(edges: DataFrame) -> DataFrame:
    """Undirected simple edges (a < b) of (src, dst)."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of undirected (a, b), as (src, dst)."""
    return edges.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionAll(edges.select(F.col("b").alias("src"), F.col("a").alias("dst")))


def nodes(edges: DataFrame) -> DataFrame:
    """Distinct ends of an edge table, as id."""
    x, y = edges.columns[:2]
    return edges.select(F.col(x).alias("id")).union(edges.select(F.col(y).alias("id"))).distinct()


def degrees(sym: DataFrame) -> DataFrame:
    """(id, degree) of symmetric edges."""
    return sym.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))


def directed_degrees(edges: DataFrame) -> DataFrame:
    """(id, out_degree, in_degree) of every end; one shuffle of both directions together."""
    both = edges.select(F.col("src").alias("id"), F.lit(1).cast("long").alias("o"), F.lit(0).cast("long").alias("i")).unionAll(
        edges.select(F.col("dst").alias("id"), F.lit(0).cast("long"), F.lit(1).cast("long"))
    )
    return both.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def dense_index(edges: DataFrame) -> DataFrame:
    """(id, idx): nodes numbered from 0 in order."""
    return row_numbers(nodes(edges), [F.col("id")], "idx").select("id", (F.col("idx") - 1).alias("idx"))


def contiguity(ids: DataFrame, column: str) -> DataFrame:
    """One row: n, lowest, highest, and whether the ids are exactly 0..n-1."""
    agg = ids.agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("lowest"), F.max(column).alias("highest"), F.count_distinct(column).alias("different"))
    good = (F.col("lowest") == 0) & (F.col("highest") == F.col("n") - 1) & (F.col("different") == F.col("n"))
    return agg.select("n", "lowest", "highest", good.alias("contiguous"))


def transition(sym: DataFrame) -> DataFrame:
    """(src, dst, w): uniform steps, w = 1 / degree of src."""
    deg = degrees(sym)
    return sym.join(deg, sym["src"] == deg["id"]).select("src", "dst", (F.lit(1.0) / F.col("degree")).alias("w"))


def density(edges: DataFrame) -> DataFrame:
    """One row: vertices, edges, mean and highest degree, density (null for fewer than two vertices)."""
    deg = degrees(symmetric(edges)).agg(F.count(F.lit(1)).alias("vertices"), F.sum("degree").alias("ends"), F.max("degree").alias("max_degree"))
    n, m = F.col("vertices"), F.col("ends") / 2
    return deg.select(
        "vertices", m.cast("long").alias("edges"), (F.col("ends") / n).alias("mean_degree"), "max_degree",
        F.when(n > 1, 2 * m / (n * (n - 1)).cast("double")).alias("density"),
    )


def linked(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest node that each of n nodes reaches over x, y (both directions)."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, x, low[y])
        new = new[new]
        if (new == low).all():
            return low
        low = new


def in_one_task(edges: DataFrame, ends: tuple[str, str], solve: Callable[[np.ndarray, np.ndarray, np.ndarray], dict], kinds: str) -> DataFrame:
    """``solve`` (ids, places of the first ends, of the second) of a graph of at most IN_TASK edges; its columns after id."""

    def run(table: pa.Table) -> pa.Table:
        a, b = (table.column(c).to_numpy() for c in ends)
        ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        return pa.table({"id": ids, **solve(ids, at[: len(a)], at[len(a) :])})

    kind = edges.schema[ends[0]].dataType.simpleString()
    return edges.select(*ends, F.lit(0).alias("whole")).groupBy("whole").applyInArrow(run, f"id {kind}, {kinds}")


def held(nodes: DataFrame) -> dict[str, np.ndarray] | None:
    """The columns of a node table as arrays in order of its id, for tasks to look up; None where it has more than
    HELD rows or ids that are no whole numbers."""
    if nodes.schema["id"].dataType.typeName() not in ("long", "integer") or nodes.count() > HELD:
        return None
    table = nodes.toArrow()
    order = np.argsort(table.column("id").to_numpy())
    return {c: table.column(c).to_numpy()[order] for c in table.column_names}


def small(nodes: DataFrame) -> DataFrame:
    """A materialised table of nodes, marked for broadcast where it has at most SMALL rows."""
    return F.broadcast(nodes) if nodes.count() <= SMALL else nodes
