"""Triangles, clustering, components and short distances."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import FOLDERS, cut, dropped, let_go, stored
from . import graph
from .graph import degrees, in_one_task, linked, symmetric

#: Edges after which a task links what it has read.
CHUNK = 1 << 20


def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c) of every triangle of undirected simple (a, b), once.

    Edges point from the smaller (degree, id) to the larger, so that no node has more than
    sqrt(2 m) edges out and hubs don't blow up the two-path join.
    """
    deg = degrees(symmetric(edges))
    ends = edges.join(deg.select(F.col("id").alias("a"), F.col("degree").alias("da")), "a").join(deg.select(F.col("id").alias("b"), F.col("degree").alias("db")), "b")
    a, b = (F.struct(F.col(f"d{e}").alias("d"), F.col(e).alias("n")) for e in "ab")
    out = cut(ends.select(F.least(a, b)["n"].alias("x"), F.greatest(a, b)["n"].alias("y")))
    two = out.alias("p").join(out.alias("q"), F.col("p.x") == F.col("q.x")).where("p.y < q.y").select(F.col("p.x").alias("x"), F.col("p.y").alias("y"), F.col("q.y").alias("z"))
    closing = out.select(F.least("x", "y").alias("y"), F.greatest("x", "y").alias("z"))
    return two.join(closing, ["y", "z"]).select(F.col("x").alias("a"), F.col("y").alias("b"), F.col("z").alias("c"))


def node_triangles(edges: DataFrame) -> DataFrame:
    """(id, degree, triangles) of every node."""
    each = triangles(edges).select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("triangles"))
    return degrees(symmetric(edges)).join(each, "id", "left").fillna(0, ["triangles"])


def local_clustering(edges: DataFrame) -> DataFrame:
    """(id, degree, triangles, clustering); nodes of degree below 2 have 0."""
    d = F.col("degree")
    return node_triangles(edges).withColumn("clustering", F.when(d > 1, 2.0 * F.col("triangles") / (d * (d - 1))).otherwise(0.0))


def transitivity(edges: DataFrame) -> DataFrame:
    """One row: triangles, connected triples, transitivity and mean local clustering (0 without triples)."""
    agg = local_clustering(edges).agg((F.sum("triangles") / 3).cast("long").alias("triangles"), F.sum(F.col("degree") * (F.col("degree") - 1) / 2).cast("long").alias("triples"), F.avg("clustering").alias("avg_clustering"))
    return agg.select("triangles", "triples", F.when(F.col("triples") > 0, 3.0 * F.col("triangles") / F.col("triples")).otherwise(0.0).alias("transitivity"), "avg_clustering")


def stars(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours linked with the smallest of the node and its neighbours;
    of (a, b) with a > b, once each."""
    ends = edges.select(F.col("a").alias("id"), F.col("b").alias("other")).unionAll(edges.select("b", "b"))
    least = ends.groupBy(F.col("id").alias("b")).agg(F.min("other").alias("low"))
    return edges.join(least, "b").select("a", F.col("low").alias("b")).distinct()


def small_stars(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours linked with the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high"))
    more = edges.join(least.where("low < high").select("a", "low"), "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return least.select("a", F.col("low").alias("b")).unionAll(more).distinct()


def spanning(edges: DataFrame, tasks: int) -> DataFrame:
    """(a, b): each end of the edges that a task reads with the smallest one that it reaches over them.  A task holds
    the links of about ``graph.IN_TASK`` ends and sends them when there are more."""
    kind, most = edges.schema["a"].dataType, graph.IN_TASK

    def run(batches: Iterator[pa.RecordBatch]):
        ends, held, n = (np.zeros(0, np.int64), np.zeros(0, np.int64)), [], 0

        def put():
            a, b = (np.concatenate([ends[i], *[e[i] for e in held]]) for i in (0, 1))
            ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            x, y = at[: len(a)], at[len(a) :]
            return ids, ids[linked(len(ids), np.r_[x, y], np.r_[y, x])]

        def sent():
            for s in range(0, len(ends[0]), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(e[s : s + (1 << 17)]).cast(whole) for e in ends], names=["a", "b"])

        whole = pa.int64() if kind.typeName() == "long" else pa.int32()
        for batch in batches:
            held.append([batch.column(i).to_numpy() for i in (0, 1)])
            n += batch.num_rows
            if n >= CHUNK:
                ends, held, n = put(), [], 0
                if len(ends[0]) > most:
                    yield from sent()
                    ends = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if n:
            ends = put()
        yield from sent()

    return edges.select("a", "b").coalesce(tasks).mapInArrow(run, f"a {kind.simpleString()}, b {kind.simpleString()}")


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over (a, b); ends of loops are their own.

    A graph of at most ``graph.IN_TASK`` edges is linked in one task.  Of a larger one each task first replaces its edges by
    a link for each of their ends, until a task takes them all.  Where the links do not become fewer, rounds of joins
    turn neighbourhoods into stars around their smallest node (large-star and small-star steps), so links
    shrink to one a node; they end where the links no longer change.
    """
    kind = edges.schema["a"].dataType
    simple = kind.simpleString()
    solve = lambda ids, a, b: {"b": ids[linked(len(ids), np.r_[a, b], np.r_[b, a])]}
    if kind.typeName() in ("long", "integer"):
        own = edges if edges in FOLDERS else stored(edges.select("a", "b"))
        links, n = own, own.count()
        while n > graph.IN_TASK:
            fewer = cut(spanning(links, max(1, n // max(1, 2 * graph.IN_TASK))))
            before, n = n, fewer.count()
            if 4 * n > 3 * before and n > graph.IN_TASK:
                break
            links = fewer
        if n <= graph.IN_TASK:
            found = cut(in_one_task(links, ("a", "b"), solve, f"b {simple}")).withColumnRenamed("b", "component")
            if own is not edges:
                dropped(own)
            return found
        edges = links
    nodes = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    apart = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    apart, before = cut(apart), None
    if apart.count() <= graph.IN_TASK:
        now = cut(in_one_task(apart, ("a", "b"), solve, f"b {simple}")).withColumnRenamed("id", "a")
        return nodes.join(now.withColumnRenamed("a", "id"), "id", "left").select("id", F.coalesce("b", "id").alias("component"))
    let_go(edges.sparkSession)
    now = cut(small_stars(apart))
    del apart  # its checkpoint and the shuffle files of each step go before the next one
    while True:
        let_go(edges.sparkSession)
        now = cut(stars(now))
        let_go(edges.sparkSession)
        now = cut(small_stars(now))
        seen = tuple(now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
        if seen == before:
            break
        before = seen
    return nodes.join(now.withColumnRenamed("a", "id"), "id", "left").select("id", F.coalesce("b", "id").alias("component"))


def short_path(pairs: DataFrame, sym: DataFrame, hide: bool = False, exact: bool = False) -> DataFrame:
    """Add short_path: 0 for one node, 1 adjacent, 2 with a common neighbour, else 4 at distance 3 and 5
    beyond; ``exact`` gives 3 for distance 3, 4 for distance 4 and 5 beyond.

    ``hide`` leaves the pair's own edge out.  Distances meet in the middle: the search is
    the neighbours of both ends and an edge (or a two-step path) between them.
    """
    base = pairs.select("pair_id", "u", "v")
    own = sym.select(F.col("src").alias("u"), F.col("dst").alias("v"))
    one = base.join(own, ["u", "v"], "left_semi").select("pair_id", F.lit(1).alias("d"))
    nu = base.join(sym.select(F.col("src").alias("u"), F.col("dst").alias("x")), "u")
    nv = base.join(sym.select(F.col("src").alias("v"), F.col("dst").alias("y")), "v")
    if hide:
        nu, nv = nu.where("x <> v"), nv.where("y <> u")
    nu, nv = nu.select("pair_id", "x"), nv.select("pair_id", "y")
    two = nu.join(nv, (nu["pair_id"] == nv["pair_id"]) & (F.col("x") == F.col("y"))).select(nu["pair_id"], F.lit(2).alias("d"))
    near = two if hide else two.unionAll(one)
    settled = cut(near.select("pair_id").unionAll(base.where("u = v").select("pair_id")).distinct())
    nu, nv = nu.join(settled, "pair_id", "left_anti"), nv.join(settled, "pair_id", "left_anti")
    next_ = nu.join(sym.select(F.col("src").alias("x"), F.col("dst").alias("y")), "x").select("pair_id", "y").distinct()
    three = next_.join(nv, ["pair_id", "y"]).select("pair_id", F.lit(3 if exact else 4).alias("d"))
    found = ([] if hide else [one]) + [two, three]
    if exact:
        back = nv.join(sym.select(F.col("src").alias("y"), F.col("dst").alias("z")), "y").select("pair_id", F.col("z").alias("y")).distinct()
        found.append(next_.join(back, ["pair_id", "y"]).select("pair_id", F.lit(4).alias("d")))
    every = found[0]
    for f in found[1:]:
        every = every.unionAll(f)
    best = every.groupBy("pair_id").agg(F.min("d").alias("__d"))
    return pairs.join(best, "pair_id", "left").withColumn("short_path", F.when(F.col("u") == F.col("v"), 0).otherwise(F.coalesce("__d", F.lit(5)))).drop("__d")
