"""Approximate nearest neighbours: a small-world graph per shard, results merged."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import U64, cut, mix64

#: Neighbours of a node on upper levels and on the ground, and the widths of searches.
LINKS, GROUND_LINKS = 12, 24
BUILD_WIDTH, SEARCH_WIDTH = 64, 96
#: Distinct vectors of a shard, queries that a task holds, and nodes searched for at once.
SHARD_ROWS, QUERY_ROWS, BATCH = 16384, 65536, 256
EXPAND = 4
#: Cells at most, rows and bytes of the sample their centres are fitted on, and cells that a query visits first.
CELLS, SAMPLE_ROWS, SAMPLE_BYTES, FIRST = 256, 8192, 32 << 20, 4
#: What rounding may add to an angle.
SLACK = 1e-5


def node_levels(names: np.ndarray) -> np.ndarray:
    """Level of each node, geometric by a hash of its name."""
    u = (mix64(names.astype(np.int64).view(U64)) >> U64(11)).astype(float) / 2.0**53
    return np.minimum(-np.log(np.maximum(u, 1e-18)) / np.log(LINKS), 8).astype(np.int64)


def search_level(x: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Beam search for all rows of ``q`` at once over flat neighbour arrays.

    ``entry`` has start nodes for each query, -1 for none.  Each round expands the EXPAND
    nearest nodes not expanded yet, until none of the ``width`` nearest is left.
    Returns node numbers and similarities, the nearest first, -1 and -inf where there are no more.
    """
    n = len(q)
    seen = np.zeros((n, len(x) + 1), bool)
    seen[:, -1] = True
    rows = np.arange(n)[:, None]

    def similar(ids: np.ndarray, own: np.ndarray) -> np.ndarray:
        return np.where(ids >= 0, np.einsum("qkd,qd->qk", x[ids], q[own]), -np.inf)

    def fresh(ids: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Node numbers not seen before, once each, else -1; they count as seen now."""
        ids = np.sort(ids, axis=1)
        ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
        ids = np.where(seen[own[:, None], ids], -1, ids)
        seen[own[:, None], ids] = True
        return ids

    every = np.arange(n)
    ids = fresh(entry.copy(), every)
    pad = max(0, width - ids.shape[1])
    ids = np.pad(ids, ((0, 0), (0, pad)), constant_values=-1)
    near = similar(ids, every)
    order = np.argsort(-near, axis=1, kind="stable")[:, :width]
    ids, near, done = ids[rows, order], near[rows, order], np.zeros((n, width), bool)
    active = every
    while len(active):
        open_ = (ids[active] >= 0) & ~done[active]
        rank = np.cumsum(open_, axis=1)
        active, open_, rank = active[rank[:, -1] > 0], open_[rank[:, -1] > 0], rank[rank[:, -1] > 0]
        if not len(active):
            break
        pick = open_ & (rank <= EXPAND)
        chosen = np.full((len(active), EXPAND), -1)
        r, c = np.nonzero(pick)
        chosen[r, rank[r, c] - 1] = ids[active[r], c]
        done[active[r], c] = True
        around = np.where(chosen[:, :, None] >= 0, links[chosen], -1).reshape(len(active), -1)
        new = fresh(around, active)
        ids2 = np.hstack([ids[active], new])
        near2 = np.hstack([near[active], similar(new, active)])
        done2 = np.hstack([done[active], np.zeros(new.shape, bool)])
        order = np.argsort(-near2, axis=1, kind="stable")[:, :width]
        own = np.arange(len(active))[:, None]
        ids[active], near[active], done[active] = ids2[own, order], near2[own, order], done2[own, order]
    return ids, near


def choose_links(x: np.ndarray, ids: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
    """Diverse neighbours of each node from candidates sorted by similarity: one is taken if it
    is nearer to the node than to any taken before; free places go to the nearest left."""
    n, k = ids.shape
    v = x[ids]
    between = np.einsum("qid,qjd->qij", v, v)
    taken, closest, number = np.zeros((n, k), bool), np.full((n, k), -np.inf), np.zeros(n, int)
    for j in range(k):
        good = (ids[:, j] >= 0) & (near[:, j] > closest[:, j]) & (number < most)
        taken[:, j] = good
        number += good
        closest = np.where(good[:, None], np.maximum(closest, between[:, j]), closest)
    order = np.argsort(np.where(taken, 0, np.where(ids >= 0, 1, 2)), axis=1, kind="stable")[:, :most]
    out = ids[np.arange(n)[:, None], order]
    return np.pad(out, ((0, 0), (0, max(0, most - k))), constant_values=-1)


def add_back_links(x: np.ndarray, links: np.ndarray, new: np.ndarray) -> None:
    """Link the neighbours of nodes ``new`` back to them, choosing anew where there are too many."""
    most = links.shape[1]
    to, back = links[new].ravel(), np.repeat(new, most)
    to, back = to[to >= 0], back[to >= 0]
    order = np.argsort(to, kind="stable")
    to, back = to[order], back[order]
    first = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]) if len(to) else np.zeros(0, int)
    nodes, count = to[first], np.diff(np.r_[first, len(to)])
    for a in range(0, len(nodes), BATCH):
        own, extra = nodes[a : a + BATCH], int(count[a : a + BATCH].max())
        more = np.full((len(own), extra), -1)
        for i, (f, c) in enumerate(zip(first[a : a + BATCH], count[a : a + BATCH])):
            more[i, :c] = back[f : f + c]
        ids = np.sort(np.hstack([links[own], more]), axis=1)
        ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
        near = np.where(ids >= 0, np.einsum("qkd,qd->qk", x[ids], x[own]), -np.inf)
        by = np.argsort(-near, axis=1, kind="stable")
        rows = np.arange(len(own))[:, None]
        links[own] = choose_links(x, ids[rows, by], near[rows, by], most)


def build(x: np.ndarray, levels: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(nodes, links) of each level from the top down: ``links`` holds node numbers, a row for
    every node of the shard (-1: none).

    A level's first nodes are linked by comparing all; the rest join in batches no larger than what is
    there, found by a search from the level above, and see the other nodes of their batch.
    """
    graph: list[tuple[np.ndarray, np.ndarray]] = []
    for level in range(int(levels.max()), -1, -1):
        nodes, most = np.flatnonzero(levels >= level), GROUND_LINKS if level == 0 else LINKS
        links = np.full((len(x) + 1, most), -1)
        nodes = nodes[np.argsort(-levels[nodes], kind="stable")]
        at = 0
        while at < len(nodes):
            batch = nodes[at : at + (BATCH if at else min(BATCH, 64))]
            batch = batch[: max(at, 64)]
            inside = x[batch] @ x[batch].T
            np.fill_diagonal(inside, -np.inf)
            ids, near = np.broadcast_to(batch, (len(batch), len(batch))).copy(), inside
            ids[np.eye(len(batch), dtype=bool)] = -1
            if at:
                found, close = search_level(x, links, x[batch], descend(x, graph, x[batch], nodes[0]), BUILD_WIDTH)
                ids, near = np.hstack([found, ids]), np.hstack([close, near])
            order = np.argsort(-near, axis=1, kind="stable")[:, :BUILD_WIDTH]
            rows = np.arange(len(batch))[:, None]
            links[batch] = choose_links(x, ids[rows, order], near[rows, order], most)
            add_back_links(x, links, batch)
            at += len(batch)
        graph.append((nodes, links))
    return graph


def descend(x: np.ndarray, graph: list, q: np.ndarray, start: int, width: int = 4) -> np.ndarray:
    """Entry nodes for the level below ``graph``'s last, by narrow searches from the top."""
    entry = np.full((len(q), 1), start)
    for nodes, links in graph:
        first = np.full((len(q), 1), nodes[0])
        entry = search_level(x, links, q, np.hstack([entry, first]), max(width, entry.shape[1] + 1))[0][:, :width]
    return np.hstack([entry, np.full((len(q), 1), start)])


def search(x: np.ndarray, graph: list, q: np.ndarray, width: int = SEARCH_WIDTH) -> np.ndarray:
    """Numbers of the nodes found nearest to each row of ``q`` (-1: no more), over all levels."""
    if not len(x):
        return np.full((len(q), 0), -1)
    out = [np.full((0, width), -1)]
    for a in range(0, len(q), BATCH):
        part = q[a : a + BATCH]
        entry = descend(x, graph[:-1], part, graph[-1][0][0])
        out.append(search_level(x, graph[-1][1], part, entry, width)[0])
    return np.vstack(out)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows in double precision, divided by the power of two that brings their largest component below 1:
    exact, so cosines are those of the rows, and no square is too large or small."""
    x = x.astype(float)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return (x / np.sqrt((x**2).sum(axis=1, keepdims=True))).astype(np.float32)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of rows in double precision."""
    a, b = scaled(a), scaled(b)
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def fit_centres(x: np.ndarray, cells: int, rounds: int = 12) -> np.ndarray:
    """Centres of ``cells`` cells by spherical k-means on unit rows, from evenly spaced rows."""
    centres = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)].copy()
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        for c in range(len(centres)):
            total = x[own == c].sum(axis=0)
            size = np.sqrt((total**2).sum())
            if size > 0:
                centres[c] = total / size
    return centres


def angles(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x.astype(float) @ centres.T.astype(float), -1, 1))


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the rows whose vector has only finite components, not all zero."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    some = F.exists(v, lambda c: c != 0)
    good = F.col(id_col).isNotNull() & v.isNotNull() & finite & some
    return rows.where(F.coalesce(good, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


INDEX = "dim int, cell int, sub int, n int, ids binary, vectors binary, counts binary, levels binary, links binary"


class Cells:
    """The cells of vectors by length: centres, and of each cell the largest angle of a member
    and its number of shards.  At most CELLS a length, so small enough for every task."""

    def __init__(self, centres: dict[int, np.ndarray]) -> None:
        self.centres, self.wide, self.shards = centres, {}, {}

    def place(self, dim: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each unit row, and its angle to the centre."""
        if dim not in self.centres:
            return np.zeros(len(x), int), np.full(len(x), np.pi)
        away = angles(x, self.centres[dim])
        cell = away.argmin(axis=1)
        return cell, away[np.arange(len(x)), cell]

    def visits(self, dim: int, x: np.ndarray, worst: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell): the FIRST nearest cells of each unit row; with ``worst``, the angle of each row's last
        neighbour so far, the other cells that may hold a nearer one."""
        cells = np.array(sorted(c for d, c in self.wide if d == dim), int)
        away = angles(x, self.centres[dim][cells]) if dim in self.centres else np.zeros((len(x), len(cells)))
        near = np.argsort(away, axis=1, kind="stable")
        rank = np.empty_like(near)
        np.put_along_axis(rank, near, np.arange(len(cells))[None, :], axis=1)
        if worst is None:
            row, at = np.nonzero(rank < FIRST)
        else:
            wide = np.array([self.wide[dim, c] for c in cells.tolist()])
            row, at = np.nonzero((rank >= FIRST) & (away - wide[None, :] <= worst[:, None] + SLACK))
        return row, cells[at]


def by_length(rows: list) -> dict[int, np.ndarray]:
    """Positions of the rows of each length."""
    found: dict[int, list] = {}
    for i, v in enumerate(rows):
        found.setdefault(len(v), []).append(i)
    return {d: np.array(i) for d, i in found.items()}


def build_index(rows: DataFrame, keep: int) -> tuple[DataFrame, Cells]:
    """The index of (id, v): a row per shard with its vectors and flat neighbour arrays, and the cells.

    Equal vectors are one node, which names its ``keep`` smallest ids: a search for
    fewer than ``keep`` neighbours can return no others.  Centres of cells are fitted on a sample of at most
    SAMPLE_ROWS vectors, by a hash; every vector is indexed in the cell of its nearest centre.  A
    cell of more than SHARD_ROWS nodes is several shards, by a hash of the vector.
    """
    equal = Window.partitionBy("v").orderBy("id")
    named = rows.withColumn("__r", F.row_number().over(equal)).where(F.col("__r") <= keep).drop("__r")
    nodes = cut(named.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    number = nodes.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()
    centres, scale = {}, 1 << 30
    for r in number:
        cells = min(CELLS, -(-r.n // SHARD_ROWS))
        most = min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * r.dim))
        if cells > 1:
            drawn = F.pmod(F.xxhash64("v", F.lit("sample")), F.lit(scale))
            some = nodes.where((F.size("v") == r.dim) & (drawn < int(scale * min(1.0, most / r.n)))).select("v").orderBy(F.xxhash64("v"), "v").limit(2 * most).collect()
            if some:
                centres[r.dim] = fit_centres(unit(np.array([x.v for x in some])), cells)
    cells = Cells(centres)

    def place(batches):
        for batch in batches:
            vectors = batch.column("v").to_pylist()
            cell, away = np.zeros(len(vectors), np.int32), np.zeros(len(vectors))
            for dim, at in by_length(vectors).items():
                cell[at], away[at] = cells.place(dim, unit(np.array([vectors[i] for i in at])))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(away)], names=["v", "ids", "cell", "away"])

    placed = cut(nodes.mapInArrow(place, "v array<double>, ids array<long>, cell int, away double").withColumn("dim", F.size("v")))
    for r in placed.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("wide")).collect():
        cells.wide[r.dim, r.cell], cells.shards[r.dim, r.cell] = r.wide, -(-r.n // SHARD_ROWS)
    sub = F.pmod(F.xxhash64("v"), per_cell(cells.shards)).cast("int")
    dealt = placed.select("v", "ids", "dim", "cell", sub.alias("sub"))

    def make(key, rows):
        rows = rows.assign(__i=[x[0] for x in rows["ids"]]).sort_values("__i", kind="stable")
        original = np.vstack(rows["v"].to_numpy())
        x, ids = unit(original), rows["ids"].to_list()
        graph = build(x, node_levels(rows["__i"].to_numpy()))
        flat = np.concatenate([links[:-1].ravel() for _, links in graph]).astype("<i4")
        levels = np.concatenate([np.r_[len(nodes), nodes, links.shape[1]] for nodes, links in graph]).astype("<i4")
        return pd.DataFrame(
            {
                "dim": [int(key[0])], "cell": [int(key[1])], "sub": [int(key[2])], "n": [len(x)], "ids": [np.concatenate(ids).astype("<i8").tobytes()],
                "vectors": [original.astype("<f8").tobytes()], "counts": [np.array([len(i) for i in ids], "<i4").tobytes()],
                "levels": [levels.tobytes()], "links": [flat.tobytes()],
            }
        )

    return cut(dealt.groupBy("dim", "cell", "sub").applyInPandas(make, INDEX)), cells


def per_cell(numbers: dict[tuple[int, int], int]):
    """The number of a row's (dim, cell), 1 where there is none."""
    if not numbers:
        return F.lit(1)
    table = F.create_map(*[x for (d, c), n in sorted(numbers.items()) for x in (F.lit(f"{d}/{c}"), F.lit(n))])
    return F.coalesce(F.try_element_at(table, F.concat_ws("/", "dim", "cell")), F.lit(1))


def unpack(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """(ids, counts, vectors, graph) of a row of the index."""
    n = int(row["n"])
    levels, links = np.frombuffer(row["levels"], "<i4"), np.frombuffer(row["links"], "<i4")
    graph, a, b = [], 0, 0
    while a < len(levels):
        size = int(levels[a])
        nodes, most = levels[a + 1 : a + 1 + size].astype(np.int64), int(levels[a + 1 + size])
        graph.append((nodes, np.vstack([links[b : b + n * most].reshape(n, most), np.full((1, most), -1)]).astype(np.int64)))
        a, b = a + size + 2, b + n * most
    vectors = np.frombuffer(row["vectors"], "<f8").reshape(n, int(row["dim"]))
    return np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["counts"], "<i4"), vectors, graph


def routed(queries: DataFrame, cells: Cells, worst: bool) -> DataFrame:
    """(id, v, dim, cell) of the cells that queries (id, v) visit first, or with ``worst`` then."""

    def route(batches):
        for batch in batches:
            vectors = batch.column("v").to_pylist()
            last = batch.column("worst").to_numpy(zero_copy_only=False) if worst else None
            rows, found = [], []
            for dim, at in by_length(vectors).items():
                row, cell = cells.visits(dim, unit(np.array([vectors[i] for i in at])), last[at] if worst else None)
                rows.append(at[row])
                found.append(cell)
            at = np.concatenate(rows) if rows else np.zeros(0, int)
            cell = np.concatenate(found) if rows else np.zeros(0, int)
            part = batch.select(["id", "v"]).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32))], names=["id", "v", "cell"])

    return queries.mapInArrow(route, "id long, v array<double>, cell int").withColumn("dim", F.size("v"))


def meet(visits: DataFrame, index: DataFrame, cells: Cells, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k best of each shard that a query visits, scored exactly.

    A task has one shard and at most about QUERY_ROWS of its queries; an index goes out once for so many.
    """
    visits = cut(visits)
    number = {(r.dim, r.cell): r.n for r in visits.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    blocks = per_cell({at: -(-n // QUERY_ROWS) for at, n in number.items()})
    left = visits.withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn("sub", F.explode(F.sequence(F.lit(0), per_cell(cells.shards) - 1)))
    right = index.withColumn("block", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))))
    by = ["dim", "cell", "sub", "block"]

    def ask(asked, index):
        out = []
        if len(asked) and len(index):
            ids, counts, vectors, graph = unpack(index.iloc[0])
            v, names = np.vstack(asked["v"].to_numpy()), asked["id"].to_numpy()
            at = np.cumsum(counts) - counts
            found = search(unit(vectors), graph, unit(v))
            q, c = np.nonzero(found >= 0)
            node = found[q, c]
            score = cosine(v[q], vectors[node])
            times = counts[node]
            q, score = np.repeat(q, times), np.repeat(score, times)
            own = ids[np.repeat(at[node], times) + np.arange(len(q)) - np.repeat(np.cumsum(times) - times, times)]
            other = own != names[q]
            q, score, own = q[other], score[other], own[other]
            order = np.lexsort((own, -score, q))
            q, score, own = q[order], score[order], own[order]
            first = np.searchsorted(q, q, side="left")
            best = np.arange(len(q)) - first < k
            out = [names[q[best]], own[best], score[best]]
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), out or [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)])))

    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(ask, "query_id long, vec_id long, score double")


def best_of(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all shards, ties to the smaller id."""
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_index(index: DataFrame, cells: Cells, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each query (id, v), itself left out.

    A query visits the FIRST cells with the nearest centres, and then every other cell that may hold a
    vector nearer than the last of its k so far: one whose centre is no further away than that
    vector's angle and the cell's largest.  So routing loses nothing that a visit to all would find.
    """
    queries = cut(queries)
    found = meet(routed(queries, cells, False), index, cells, k)
    dims = [d for d, _ in cells.wide]
    if any(dims.count(d) > FIRST for d in set(dims)):
        found = cut(best_of(found, k).drop("rank"))
        last = found.groupBy("query_id").agg(F.min("score").alias("score"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
        angle = F.coalesce(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "score"))), F.lit(4.0))
        rest = queries.join(last.withColumnRenamed("query_id", "id"), "id", "left").select("id", "v", angle.alias("worst"))
        found = found.unionByName(meet(routed(rest, cells, True), index, cells, k)).distinct()
    return best_of(found, k)


def nearest(rows: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k rows of largest cosine that the index finds for each query, nearest first.

    Vectors that are null, all zero, or hold a null or non-finite component take no part,
    nor do null ids.  Vectors are compared with those of their own length only.  Ids are
    taken to be unique; of rows repeated in full one is returned for each.
    """
    index, cells = build_index(usable(rows, id_col, vector_col), k + 1)
    return search_index(index, cells, usable(queries, id_col, vector_col), k)


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(rows, rows.where(F.col("vec_id") % 50 == 0))
