"""Partition quality, profiles and agreement; Louvain and Leiden detection."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import quantiles, row_numbers
from ..session import FOLDERS, cut, dropped, let_go, settled, stored
from .cohesion import components
from .graph import degrees, held, linked, nodes, symmetric
from .pairs import looked_up

#: Undirected edges that a task detects communities of at most; beyond, by joins.
IN_TASK = 3 << 20
#: Edges, both ways, of a block of a larger graph, about; how they are compressed.
BLOCK, PACKED = 1 << 20, "zstd"


def community_edges(edges: DataFrame, labels: DataFrame, table: dict[str, np.ndarray] | None = None) -> DataFrame:
    """(ca, cb) of both ends of every undirected edge; ``labels`` is (id, community), ``table`` the same as ``held``."""
    if table is not None:
        named = looked_up(edges.select("a", "b"), labels, table, ("a", "b"), ["community"])
        return named.select(F.col("community_a").alias("ca"), F.col("community_b").alias("cb")).where("ca is not null and cb is not null")
    a = labels.select(F.col("id").alias("a"), F.col("community").alias("ca"))
    b = labels.select(F.col("id").alias("b"), F.col("community").alias("cb"))
    return edges.join(a, "a").join(b, "b").select("ca", "cb")


def volumes(edges: DataFrame, labels: DataFrame, table: dict[str, np.ndarray] | None = None) -> DataFrame:
    """(community, internal, vol): edges inside, and the sum of degrees, of every community."""
    ends = community_edges(edges, labels, table).select(F.explode(F.array("ca", "cb")).alias("community"), (F.col("ca") == F.col("cb")).cast("long").alias("same"))
    return ends.groupBy("community").agg((F.sum("same") / 2).cast("long").alias("internal"), F.count(F.lit(1)).alias("vol"))


def modularity(edges: DataFrame, labels: DataFrame, table: dict[str, np.ndarray] | None = None) -> DataFrame:
    """One row: Newman-Girvan modularity."""
    vol = volumes(edges, labels, table)
    m = F.broadcast(vol.agg((F.sum("vol") / 2).alias("m")))
    return vol.crossJoin(m).agg(F.sum(F.col("internal") / F.col("m") - F.pow(F.col("vol") / (2 * F.col("m")), F.lit(2.0))).alias("modularity"))


def coverage(edges: DataFrame, labels: DataFrame) -> DataFrame:
    return community_edges(edges, labels).agg(F.avg((F.col("ca") == F.col("cb")).cast("double")).alias("coverage"))


def conductance(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(community, conductance): cut over the smaller side's volume, 0 where that is 0."""
    vol = volumes(edges, labels)
    m2 = F.broadcast(vol.agg(F.sum("vol").alias("m2")))
    every = labels.select("community").distinct().join(vol, "community", "left").fillna(0, ["internal", "vol"]).crossJoin(m2)
    small = F.least(F.col("vol"), F.col("m2") - F.col("vol"))
    return every.select("community", F.when(small > 0, (F.col("vol") - 2 * F.col("internal")).cast("double") / small).otherwise(0.0).alias("conductance"))


def partition_sizes(labels: DataFrame) -> DataFrame:
    """One row: communities, largest, median and single ones."""
    sizes = labels.groupBy("community").agg(F.count(F.lit(1)).alias("n"))
    one = sizes.agg(F.count(F.lit(1)).alias("communities"), F.max("n").alias("largest"), F.sum((F.col("n") == 1).cast("long")).alias("singletons"))
    middle = F.broadcast(quantiles(sizes, "n", [0.5]))
    return one.join(middle, F.lit(True), "left").select("communities", "largest", F.col("q")[0].alias("median_size"), "singletons")


def profile(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """(community, size, dominant_language, language_purity, affiliate_rate, median_views)."""
    named = nodes.join(labels, "id")
    lang = named.groupBy("community", "language").agg(F.count(F.lit(1)).alias("n"))
    top = lang.groupBy("community").agg(F.min_by("language", F.struct(-F.col("n"), F.col("language"))).alias("dominant_language"), F.max("n").alias("most"))
    rest = named.groupBy("community").agg(F.count(F.lit(1)).alias("size"), F.avg("affiliate").alias("affiliate_rate"))
    middle = quantiles(named, "views", [0.5], ["community"]).select("community", F.col("q")[0].cast("long").alias("median_views"))
    rest = rest.join(middle, "community", "left")
    return rest.join(top, "community").select("community", "size", "dominant_language", (F.col("most") / F.col("size")).alias("language_purity"), "affiliate_rate", "median_views")


def top_coverage(profiled: DataFrame, n: int = 10) -> DataFrame:
    """One row: share of nodes in the n largest communities and their mean purity."""
    total = F.broadcast(profiled.agg(F.sum("size").alias("total")))
    top = profiled.orderBy(F.col("size").desc(), "community").limit(n).crossJoin(total)
    return top.agg((F.sum("size") / F.first("total")).alias("coverage"), F.avg("language_purity").alias("mean_purity"))


def language_shares(nodes: DataFrame, labels: DataFrame, n: int = 10) -> DataFrame:
    """(community, language, share) within the n largest communities."""
    named = nodes.join(labels, "id")
    top = named.groupBy("community").agg(F.count(F.lit(1)).alias("size")).orderBy(F.col("size").desc(), "community").limit(n)
    counts = named.join(F.broadcast(top), "community").groupBy("community", "language", "size").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("community", "language", (F.col("n") / F.col("size")).alias("share"))


def nmi(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: normalised mutual information with the arithmetic mean of the entropies (1 if both are constant)."""
    cell = df.groupBy(x, y).agg(F.count(F.lit(1)).alias("n"))
    total = F.broadcast(cell.agg(F.sum("n").alias("t")))

    def entropy(by: list[str], out: str) -> DataFrame:
        p = F.col("c") / F.col("t")
        return cell.groupBy(*by).agg(F.sum("n").alias("c")).crossJoin(total).agg(F.sum(-p * F.ln(p)).alias(out))

    hx, hy, hxy = entropy([x], "hx"), entropy([y], "hy"), entropy([x, y], "hxy")
    both = hx.crossJoin(hy).crossJoin(hxy)
    mean = F.col("hx") + F.col("hy")
    return both.select(F.when(mean > 0, 2 * (mean - F.col("hxy")) / mean).otherwise(1.0).alias("nmi"))


def sorted_baseline(df: DataFrame, label: str, other: str, key: str) -> DataFrame:
    """NMI of the sorted labels against ``other`` in the order of ``key``."""
    left = row_numbers(df.select(F.col(label).alias("x"), F.col(key).alias("__k")), [F.col("x"), F.col("__k")], "rn").select("rn", "x")
    right = row_numbers(df.select(F.col(other).alias("y"), F.col(key).alias("__k")), [F.col("__k")], "rn").select("rn", "y")
    return nmi(left.join(right, "rn"), "x", "y")


def verdict(value):
    return F.when(value >= 0.5, "strong").when(value >= 0.2, "moderate").otherwise("weak")


def weighted_modularity(w: DataFrame, labels: DataFrame, copies: int = 1) -> dict[int, float]:
    """Modularity of symmetric weighted (src, dst, w), self-loops counted twice as w on the diagonal, for each of
    ``copies`` graphs side by side: a node of the k-th has k as its remainder."""
    s = labels.select(F.col("id").alias("src"), F.col("community").alias("cs"))
    d = labels.select(F.col("id").alias("dst"), F.col("community").alias("cd"))
    by = w.join(s, "src").join(d, "dst").groupBy("cs").agg(F.sum("w").alias("vol"), F.sum(F.when(F.col("cs") == F.col("cd"), F.col("w")).otherwise(0.0)).alias("inside"))
    rows = by.groupBy(F.pmod("cs", F.lit(copies)).alias("run")).agg(F.sum("vol").alias("m2"), F.sum("inside").alias("i"), F.sum(F.col("vol") * F.col("vol")).alias("v2")).collect()
    return {r["run"]: r["i"] / r["m2"] - r["v2"] / r["m2"] ** 2 if r["m2"] else 0.0 for r in rows}


def summed(key: np.ndarray, w: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(keys in order, the sum of w of each); without w their numbers."""
    order = None if w is None else np.argsort(key)
    key = np.sort(key) if w is None else key[order]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    sums = np.diff(np.r_[starts, len(key)]).astype(float) if w is None else np.add.reduceat(w[order], starts) if len(key) else np.zeros(0)
    return key[starts], sums


def moved_in_task(a: np.ndarray, b: np.ndarray, w: np.ndarray, m2: float, seed: int, refine: bool, least: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """(ids, community) of undirected weighted edges, each once, in a graph of total strength ``m2``; loops weigh w
    on the diagonal.  The rounds of ``local_moving`` and the levels of ``louvain`` on arrays."""
    ids, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, n = ends[: len(a)], ends[len(a) :], len(ids)
    apart, draws, of = x != y, np.random.default_rng([seed, int(ids[0]) & 0x7FFFFFFF]), np.arange(n)
    loops = np.bincount(x[~apart], w[~apart], n)
    x, y, w = np.r_[x[apart], y[apart]], np.r_[y[apart], x[apart]], np.r_[w[apart], w[apart]]
    if (w == 1).all():
        w = None
    while True:
        k = np.bincount(x, w, n) + loops
        labels, best, best_q, stalled, least_q = np.arange(n), None, -np.inf, -1, least * k.sum() / m2
        while True:
            tot, home = np.bincount(labels, k, n), labels[x] == labels[y]
            inside = np.bincount(x[home], None if w is None else w[home], n)
            q = (inside.sum() + loops.sum()) / m2 - ((tot / m2) ** 2).sum()
            stalled = 0 if q > best_q + least_q else stalled + 1
            if q > best_q:
                best, best_q = labels, q
            if stalled >= 2:
                break
            active = draws.random(n) < 0.5
            out = active[x] & ~home
            key, kin = summed(x[out] * n + labels[y[out]], None if w is None else w[out])
            row, to = key // n, key % n
            gain = np.round(kin - k[row] * tot[to] / m2, 9)
            starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else row
            if not len(row):
                stalled += 1
                continue
            top = np.maximum.reduceat(gain, starts)
            first = np.minimum.reduceat(np.where(gain == np.repeat(top, np.diff(np.r_[starts, len(row)])), to, n), starts)
            own = row[starts]
            moves = top > np.round(inside[own] - k[own] * (tot[labels[own]] - k[own]) / m2, 9)
            labels = labels.copy()
            labels[own[moves]] = first[moves]
        if refine:
            same = best[x] == best[y]
            best = linked(n, x[same], y[same])
        names, part = np.unique(best, return_inverse=True)
        of = part[of]
        if len(names) == n:
            break
        loops, same = np.bincount(part, loops, len(names)), part[x] == part[y]
        loops += np.bincount(part[x[same]], None if w is None else w[same], len(names))
        n, out = len(names), ~same
        key, w = summed(part[x[out]] * n + part[y[out]], None if w is None else w[out])
        x, y = key // n, key % n
    low = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(low, of, ids)
    return ids, low[of]


def detected_in_tasks(w: DataFrame, m2: float, seed: int, refine: bool) -> DataFrame:
    """(id, community) of undirected weighted (part, a, b, w), each part, which shares no node with another, in one task.
    Without w each edge weighs 1."""

    def detect(table):
        a, b = (table.column(c).to_numpy() for c in "ab")
        ids, community = moved_in_task(a, b, table.column("w").to_numpy() if "w" in table.column_names else np.ones(len(a)), m2, seed, refine)
        return pa.table({"id": ids, "community": community})

    return cut(w.groupBy("part").applyInArrow(detect, "id long, community long"))


def local_moving(w: DataFrame, seed: int, rounds: int | None = None, least: float = 1e-4, copies: int = 1, m2: float | None = None) -> DataFrame:
    """(id, community): nodes move to the neighbouring community of the largest modularity gain.

    All nodes decide at once, so only a hashed half of them moves in a round, and the labels of
    a round are kept only while modularity rises.  Without ``rounds`` it ends where two rounds on end
    raise it by less than ``least``.  Of ``copies`` equal graphs side by side each keeps its own best labels.
    """
    strength = cut(w.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k")))
    m2 = m2 or strength.agg(F.sum("k")).first()[0] or 1.0
    labels = strength.select("id", F.col("id").alias("community"))
    best, best_q, stalled = labels, weighted_modularity(w, labels, copies), 0
    for r in count() if rounds is None else range(rounds):
        named = strength.join(labels, "id")
        tot = named.groupBy("community").agg(F.sum("k").alias("tot"))
        to = w.where("src <> dst").join(labels.select(F.col("id").alias("dst"), "community"), "dst").groupBy(F.col("src").alias("id"), "community").agg(F.sum("w").alias("kin"))
        stay = named.select("id", "community", F.lit(0.0).alias("kin"))
        option = to.unionAll(stay).groupBy("id", "community").agg(F.sum("kin").alias("kin"))
        option = option.join(tot, "community").join(named.select("id", "k", F.col("community").alias("own")), "id")
        home = F.col("community") == F.col("own")
        gain = F.col("kin") - copies * F.col("k") * (F.col("tot") - F.when(home, F.col("k")).otherwise(0.0)) / m2
        choice = option.withColumn("gain", F.round(gain, 9)).groupBy("id", "own").agg(F.max_by("community", F.struct("gain", home.cast("int"), -F.col("community"))).alias("new"))
        active = F.pmod(F.xxhash64("id", F.lit(seed), F.lit(r)), F.lit(2)) == 0
        labels = cut(choice.select("id", F.when(active, F.col("new")).otherwise(F.col("own")).alias("community")))
        q = weighted_modularity(w, labels, copies)
        better = [run for run, x in q.items() if x > best_q[run]]
        stalled = 0 if any(q[run] > best_q[run] + least for run in better) else stalled + 1
        if len(better) == len(q):
            best = labels
        elif better:
            own = F.pmod("id", F.lit(copies)).isin(better)
            best = cut(labels.where(own).unionByName(best.where(~own)))
        best_q |= {run: q[run] for run in better}
        if stalled == 2:
            break
    return best


def louvain(edges: DataFrame, seed: int = 42, levels: int | None = None, refine: bool = False, rounds: int | None = None, copies: int = 1) -> DataFrame:
    """(id, community), community named by its smallest node; ``refine`` divides a level's communities
    into their connected parts before they are contracted (Leiden's guarantee).  Without ``levels`` it
    ends where a level merges nothing.

    A graph, or else a component, of at most IN_TASK edges is detected in one task, with the modularity
    of the whole graph; larger ones by rounds of joins until contraction has made them as small.  ``edges`` may be
    ``placed_edges``, which several detections share.
    """
    if levels is not None or rounds is not None:
        return joined_louvain(cut(symmetric(edges).withColumn("w", F.lit(1.0))), seed, levels, refine, rounds, copies)
    placed = edges if "part" in edges.columns else placed_edges(edges, copies)
    m2 = 2.0 * max(placed.count(), 1) / copies
    large = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > IN_TASK).select("part")
    large = F.broadcast(cut(large))
    if large.isEmpty():
        return detected_in_tasks(placed, m2, seed, refine)
    found = detected_in_tasks(placed.join(large, "part", "left_anti"), m2, seed, refine)
    return found.unionByName(joined_louvain(placed.join(large, "part", "left_semi").select("a", "b"), seed, None, refine, None, copies, m2))


def placed_edges(edges: DataFrame | Callable[[], DataFrame], copies: int = 1) -> DataFrame:
    """Stored (a, b, part) of undirected (a, b), or of what makes them: the part is the copy where a copy has at most IN_TASK
    edges, else the component."""
    given = edges
    edges = settled(lambda: (given() if callable(given) else given).select("a", "b"))
    if edges.count() <= IN_TASK * copies:
        out = edges.withColumn("part", F.pmod("a", F.lit(copies)))
        FOLDERS[out] = FOLDERS[edges]
        return out
    own = cut(components(edges).select("id", F.col("component").cast("long").alias("part")))
    out = stored(looked_up(edges, own, held(own), ("a",), ["part"]).withColumnRenamed("part_a", "part"))
    dropped(edges)
    let_go(edges.sparkSession)
    return out


def joined_louvain(w: DataFrame, seed: int, levels: int | None, refine: bool, rounds: int | None, copies: int, m2: float | None = None) -> DataFrame:
    """``louvain`` of symmetric weighted (src, dst, w), or of undirected (a, b), by rounds of joins; with ``m2``, the strength of a
    whole copy, levels of at most IN_TASK edges a copy are finished in tasks.  A graph (a, b) of at most ``graph.HELD`` nodes
    goes by ``swept_louvain``, unless refined or in copies."""
    if "a" in w.columns:
        if not refine and copies == 1 and (own := held(cut(nodes(w)))) is not None:
            return swept_louvain(w, own["id"], seed, m2)
        w = cut(symmetric(w).withColumn("w", F.lit(1.0)))
    members = w.select(F.col("src").alias("id")).distinct().withColumn("node", F.col("id"))
    last = None
    for level in count() if levels is None else range(levels):
        moved = local_moving(w, seed + 100 * level, rounds, copies=copies, m2=m2 and m2 * copies)
        if refine:
            s, d = (moved.select(F.col("id").alias(c), F.col("community").alias(f"c_{c}")) for c in ("src", "dst"))
            inside = w.where("src < dst").join(s, "src").join(d, "dst").where("c_src = c_dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))
            part = components(inside)
            moved = moved.select("id").join(part, "id", "left").select("id", F.coalesce("component", "id").alias("community"))
        members = cut(members.join(moved.withColumnRenamed("id", "node"), "node").select("id", F.col("community").alias("node")))
        n = members.select("node").distinct().count()
        if n == last:
            break
        last = n
        s, d = (moved.select(F.col("id").alias(c), F.col("community").alias(f"c_{c}")) for c in ("src", "dst"))
        w = cut(w.join(s, "src").join(d, "dst").groupBy(F.col("c_src").alias("src"), F.col("c_dst").alias("dst")).agg(F.sum("w").alias("w")))
        if m2 and w.where("src <= dst").count() <= IN_TASK * copies:
            left = w.where("src <= dst").select(F.pmod("src", F.lit(copies)).alias("part"), F.col("src").alias("a"), F.col("dst").alias("b"), "w")
            moved = detected_in_tasks(left, m2, seed + 100 * level + 100, refine)
            members = members.join(moved.withColumnRenamed("id", "node"), "node").select("id", F.col("community").alias("node"))
            break
    name = members.groupBy("node").agg(F.min("id").alias("community"))
    return members.join(name, "node").select("id", "community")


def in_blocks(rows: DataFrame, read: Callable[[pa.RecordBatch], Iterator[tuple]], n: int, blocks: int) -> DataFrame:
    """Stored (block, m, x, y, w) of the edges x, y of weight w, both ways, that ``read`` gives for batches: those of the nodes x of a
    remainder by ``blocks``, in order of x and y, each once with the sum of its weights.  Loops are among them."""
    kinds, pack = "block int, m int, x binary, y binary, w binary", lambda c: pa.compress(np.ascontiguousarray(c, np.int32), PACKED, asbytes=True)

    def send(batches: Iterator[pa.RecordBatch]):
        waiting, size = [], 0

        def put():
            x, y, w = (np.concatenate(c) for c in zip(*waiting))
            of = (x % blocks).astype(np.int32)
            order = np.argsort(of, kind="stable")
            starts = np.searchsorted(of[order], np.arange(blocks + 1))
            there = np.flatnonzero(np.diff(starts))
            cells = [[pack(c[order[starts[i] : starts[i + 1]]]) for i in there] for c in (x, y, w)]
            yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(np.diff(starts)[there], pa.int32()), *[pa.array(c, pa.binary()) for c in cells]], names=["block", "m", "x", "y", "w"])

        for batch in batches:
            for some in read(batch):
                waiting.append(some)
                size += len(some[0])
                if size >= BLOCK:
                    yield from put()
                    waiting, size = [], 0
        if size:
            yield from put()

    def join(table: pa.Table) -> pa.Table:
        x, y, w = (np.concatenate(c) for c in zip(*opened(table)))
        key, w = summed(x.astype(np.int64) * n + y, w)
        return pa.table({"block": table.column("block").slice(0, 1), "m": pa.array([len(key)], pa.int32()), **{c: pa.array([pack(v)], pa.binary()) for c, v in (("x", key // n), ("y", key % n), ("w", w))}})

    return stored(rows.mapInArrow(send, kinds).groupBy("block").applyInArrow(join, kinds))


def opened(table: pa.Table | pa.RecordBatch) -> Iterator[list[np.ndarray]]:
    """x, y and w of each row of ``in_blocks``."""
    for m, *cells in zip(*(table.column(c).to_pylist() for c in ("m", "x", "y", "w"))):
        yield [np.frombuffer(pa.decompress(c, 4 * m, PACKED), np.int32) for c in cells]


def best_moves(x: np.ndarray, y: np.ndarray, w: np.ndarray, labels: np.ndarray, tot: np.ndarray, active: np.ndarray, m2: float, blocks: int) -> tuple[float, np.ndarray, np.ndarray]:
    """(strength inside communities, nodes that move, their new labels) of a block of ``in_blocks``: the round of ``moved_in_task``."""
    n, at = len(labels), x // blocks
    lx, ly = labels[x], labels[y]
    home, apart, none = lx == ly, x != y, np.zeros(0, np.int32)
    total = float(w[home].sum())
    rows = int(at[-1]) + 1
    k, inside = np.bincount(at, w, rows), np.bincount(at[home & apart], w[home & apart], rows)
    out = active[x] & ~home
    if not out.any():
        return total, none, none
    key, kin = summed(at[out].astype(np.int64) * n + ly[out], None if (w == 1).all() else w[out])
    row, to = key // n, key % n
    gain = np.round(kin - k[row] * tot[to] / m2, 9)
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    top = np.maximum.reduceat(gain, starts)
    first = np.minimum.reduceat(np.where(gain == np.repeat(top, np.diff(np.r_[starts, len(row)])), to, n), starts)
    own = row[starts]
    node = own * blocks + int(x[0]) % blocks
    moves = top > np.round(inside[own] - k[own] * (tot[labels[node]] - k[own]) / m2, 9)
    return total, node[moves].astype(np.int32), first[moves].astype(np.int32)


def swept_louvain(edges: DataFrame, ids: np.ndarray, seed: int, m2: float, least: float = 1e-4) -> DataFrame:
    """(id, community) of undirected (a, b) among ``ids``, which are in order: the rounds and levels of ``moved_in_task``, each round
    a job over blocks of edges.  Tasks hold the labels of all nodes and send those that change; levels of at most
    IN_TASK edges are finished in a task."""
    spark, context = edges.sparkSession, edges.sparkSession.sparkContext
    n, of, shared = len(ids), np.arange(len(ids)), context.broadcast(ids)

    def first(batch: pa.RecordBatch):
        a, b = (np.searchsorted(shared.value, batch.column(c).to_numpy()).astype(np.int32) for c in (0, 1))
        yield np.r_[a, b], np.r_[b, a], np.ones(2 * len(a), np.int32)

    size = 2 * edges.count()
    blocks = max(1, -(-size // BLOCK))
    graph = in_blocks(edges.select("a", "b"), first, n, blocks)
    shared.destroy()
    for level in count():
        labels, best, best_q, stalled, k = np.arange(n, dtype=np.int32), None, -np.inf, -1, None
        draws = np.random.default_rng([seed, level])
        tot = strengths(graph, n)
        k, least_q = tot, least * tot.sum() / m2
        while True:
            held_ = context.broadcast((labels, tot, draws.random(n) < 0.5))

            def sweep(batches: Iterator[pa.RecordBatch]):
                for batch in batches:
                    for x, y, w in opened(batch):
                        total, node, to = best_moves(x, y, w, *held_.value, m2, blocks)
                        yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([node.tobytes()], pa.binary()), pa.array([to.tobytes()], pa.binary())], names=["q", "node", "label"])

            found = graph.mapInArrow(sweep, "q double, node binary, label binary").toArrow()
            held_.destroy()
            q = sum(found.column("q").to_pylist()) / m2 - ((tot / m2) ** 2).sum()
            stalled = 0 if q > best_q + least_q else stalled + 1
            if q > best_q:
                best, best_q = labels, q
            if stalled >= 2:
                break
            node, to = (np.frombuffer(b"".join(found.column(c).to_pylist()), np.int32) for c in ("node", "label"))
            if not len(node):
                stalled += 1
                continue
            labels = labels.copy()
            labels[node] = to
            tot = np.bincount(labels, k, n)
        names, part = np.unique(best, return_inverse=True)
        of = part[of]
        if len(names) == n:
            break
        n, last, shared = len(names), graph, context.broadcast(part.astype(np.int32))

        def contracted(batch: pa.RecordBatch):
            for x, y, w in opened(batch):
                x, y = shared.value[x], shared.value[y]
                key, w = summed(x.astype(np.int64) * n + y, w)
                yield key // n, key % n, w

        blocks = max(1, min(blocks, n))
        graph = in_blocks(last, contracted, n, blocks)
        shared.destroy()
        dropped(last)
        size = graph.agg(F.sum("m")).first()[0]
        if size <= 2 * IN_TASK:
            def pairs(batches: Iterator[pa.RecordBatch]):
                for batch in batches:
                    for x, y, w in opened(batch):
                        some = x <= y
                        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(some.sum(), np.int32)), pa.array(x[some].astype(np.int64)), pa.array(y[some].astype(np.int64)), pa.array(w[some].astype(float))], names=["part", "a", "b", "w"])

            table = detected_in_tasks(graph.mapInArrow(pairs, "part int, a long, b long, w double"), m2, seed + 100 * level + 100, False).toArrow()
            part = np.arange(n)
            part[table.column("id").to_numpy()] = table.column("community").to_numpy()
            of = part[of]
            break
    dropped(graph)
    low = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(low, of, ids)
    shared = context.broadcast((ids, low[of]))

    def named(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            at = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(c[at].astype(np.int64)) for c in shared.value], names=["id", "community"])

    out = cut(spark.range(len(ids)).mapInArrow(named, "id long, community long"))
    shared.destroy()
    return out


def strengths(graph: DataFrame, n: int) -> np.ndarray:
    """The strength of each node of ``in_blocks``."""

    def add(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for x, _, w in opened(batch):
                starts = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
                yield pa.RecordBatch.from_arrays([pa.array([x[starts].tobytes()], pa.binary()), pa.array([np.add.reduceat(w.astype(float), starts).tobytes()], pa.binary())], names=["x", "k"])

    found, k = graph.mapInArrow(add, "x binary, k binary").toArrow(), np.zeros(n)
    x, w = (np.frombuffer(b"".join(found.column(c).to_pylist()), t) for c, t in (("x", np.int32), ("k", float)))
    k[x] = w
    return k


def louvain_runs(edges: DataFrame, runs: int = 8, seed: int = 42) -> DataFrame:
    """(run, id, community) of ``runs`` detections, each with draws of its own.

    All run at once on as many copies of the graph: a copy's nodes have names of their own, gains and
    modularity are those of a copy alone, and each keeps its own best labels.
    """
    run = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(runs - 1).cast("long")))
    copies = edges.withColumn("run", run).select(*[(F.col(e) * runs + F.col("run")).alias(e) for e in "ab"])
    found = louvain(copies, seed, copies=runs)
    return found.select(F.pmod("id", F.lit(runs)).cast("int").alias("run"), F.floor(F.col("id") / runs).cast("long").alias("id"), F.floor(F.col("community") / runs).cast("long").alias("community"))


def leiden(edges: DataFrame, seed: int = 42, levels: int | None = None, rounds: int | None = None) -> DataFrame:
    return louvain(edges, seed, levels, refine=True, rounds=rounds)


def configuration_null(edges: DataFrame, seed: int = 1) -> DataFrame:
    """(a, b): a simple graph of the same degrees but for dropped loops and duplicates; stubs are dealt to blocks by a
    hash, put in a drawn order there and neighbours in it are joined; so are the last ones of odd blocks."""
    degree = cut(degrees(symmetric(edges)))
    blocks = max(1, -(-(degree.agg(F.sum("degree")).first()[0] or 0) // BLOCK))

    def deal(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for s in range(0, batch.num_rows, BLOCK >> 4):
                ids, many = (batch.column(c).slice(s, BLOCK >> 4).to_numpy() for c in ("id", "degree"))
                stub = np.repeat(ids, many)
                h = stub.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (np.arange(len(stub)) - np.repeat(np.cumsum(many) - many, many) + 1).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64(seed)
                for by, shift in ((0xBF58476D1CE4E5B9, 30), (0x94D049BB133111EB, 27)):
                    h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
                of = ((h ^ (h >> np.uint64(31))) % np.uint64(blocks)).astype(np.int32)
                order = np.argsort(of, kind="stable")
                starts = np.searchsorted(of[order], np.arange(blocks + 1))
                there = np.flatnonzero(np.diff(starts))
                cells = [pa.compress(stub[order[starts[i] : starts[i + 1]]], PACKED, asbytes=True) for i in there]
                yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(np.diff(starts)[there], pa.int32()), pa.array(cells, pa.binary())], names=["block", "m", "ids"])

    def matched(stub: np.ndarray, block: int) -> pa.Table:
        stub = np.random.default_rng([seed, block]).permutation(np.sort(stub))
        x, y = stub[: len(stub) // 2 * 2].reshape(-1, 2).T
        a, b, last = np.minimum(x, y), np.maximum(x, y), stub[len(stub) // 2 * 2 :]
        some = a < b
        return pa.table({"a": np.r_[a[some], last], "b": pa.array(np.r_[b[some], last], mask=np.r_[np.zeros(some.sum(), bool), np.ones(len(last), bool)])})

    def join(table: pa.Table) -> pa.Table:
        stub = [np.frombuffer(pa.decompress(c, 8 * m, PACKED), np.int64) for m, c in zip(*(table.column(c).to_pylist() for c in ("m", "ids")))]
        return matched(np.concatenate(stub), table.column("block")[0].as_py())

    whole = degree.select(F.col("id").cast("long").alias("id"), F.col("degree").cast("long").alias("degree"))
    pair = stored(whole.mapInArrow(deal, "block int, m int, ids binary").groupBy("block").applyInArrow(join, "a long, b long"))
    left = pair.where("b is null").select("a", F.lit(0).alias("whole")).groupBy("whole").applyInArrow(lambda t: matched(t.column("a").to_numpy(), blocks), "a long, b long")
    return pair.unionByName(left).where("b is not null").distinct()
