"""Features of candidate node pairs (pair_id, u, v), all in one join chain."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import cut, let_go, stored
from .cohesion import components
from .graph import degrees, held, small

#: Neighbours (both ways) of a component that a block of its nodes has at most, about.
CELL = 1 << 20
CELLS = ("__part", "__bu", "__bv")
DEGREES = ("out_degree", "in_degree", "und_degree")
#: Counts, then sums over common neighbours.
OVERLAPS = ("oo", "oi", "io", "ii", "und", "aa_und", "aa_dir", "ra_dir")


def ratio(a: Column, b: Column, none: float = 0.0) -> Column:
    """a / b, and ``none`` where b is 0."""
    return F.when(b != 0, a.cast("double") / b).otherwise(F.lit(none))


def lookup(pairs: DataFrame, values: DataFrame, key: str, default_u=0, default_v=None) -> DataFrame:
    """Add each column of ``values`` (key, ...) for both ends as name_u and name_v."""
    default_v = default_u if default_v is None else default_v
    out = pairs
    for end, default in (("u", default_u), ("v", default_v)):
        cols = [c for c in values.columns if c != key]
        side = values.select(F.col(key).alias("__k"), *[F.col(c).alias(f"{c}_{end}") for c in cols])
        out = out.join(side, F.col(end) == F.col("__k"), "left").drop("__k").fillna(default, [f"{c}_{end}" for c in cols])
    return out


def fewer(pairs: DataFrame, degree: str) -> DataFrame:
    """(pair_id, x, y, turned): the ends of pairs with ``degree``_u and ``degree``_v, x with the smaller; turned where it is v."""
    turned = F.col(f"{degree}_v") < F.col(f"{degree}_u")
    return pairs.select("pair_id", F.when(turned, F.col("v")).otherwise(F.col("u")).alias("x"), F.when(turned, F.col("u")).otherwise(F.col("v")).alias("y"), turned.alias("turned"))


def linked_pairs(edges: DataFrame) -> DataFrame:
    """(a, b, f, r): each pair of linked nodes once, a <= b, with f edges a->b and r edges b->a (loops have r = f)."""
    s, d = F.col("src"), F.col("dst")
    return edges.groupBy(F.least(s, d).alias("a"), F.greatest(s, d).alias("b")).agg(F.sum((s <= d).cast("long")).alias("f"), F.sum((s >= d).cast("long")).alias("r"))


def looked_up(rows: DataFrame, nodes: DataFrame, table: dict[str, np.ndarray] | None, keys: Sequence[str], columns: list[str]) -> DataFrame:
    """Add each of ``columns`` of ``nodes`` (id, ...) for the keys, as name_key, null where unknown: in tasks that hold ``table``,
    else by joins."""
    if table is None:
        out = rows
        for k in keys:
            out = out.join(nodes.select(F.col("id").alias("__k"), *[F.col(c).alias(f"{c}_{k}") for c in columns]), F.col(k) == F.col("__k"), "left").drop("__k")
        return out
    ids, values = table["id"], [table[c] for c in columns]

    def look(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            found = []
            for k in keys:
                key = batch.column(k).to_numpy(zero_copy_only=False)
                at = np.minimum(np.searchsorted(ids, key), max(len(ids) - 1, 0))
                none = ids[at] != key if len(ids) else np.ones(len(key), bool)
                found += [pa.array(v[at] if len(ids) else np.zeros(len(key), v.dtype), mask=none) for v in values]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], names=[*batch.schema.names, *[f"{c}_{k}" for k in keys for c in columns]])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + [f"`{c}_{k}` {nodes.schema[c].dataType.simpleString()}" for k in keys for c in columns]
    return rows.mapInArrow(look, ", ".join(kinds))


def cells(size: Column) -> Column:
    """Blocks of nodes into which a component of ``size`` neighbours is divided; a cell is a pair of them."""
    return F.greatest(F.lit(1), F.ceil(F.sqrt(size / F.lit(float(CELL))))).cast("int")


def met_in_task(n: int, own: tuple, other: tuple, u: np.ndarray, v: np.ndarray) -> Iterator[tuple]:
    """(pairs, neighbour, bits of u's neighbour, bits of v's) wherever a neighbour of u is one of v, some pairs at
    a time.  ``own`` and ``other`` are (keys x * n + w in order, bits)."""
    key, bits = other
    shift = np.uint64(64 - max(10, int(16 * len(key)).bit_length()))
    place = lambda k: (k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> shift
    there = np.zeros(1 << (64 - int(shift)), bool)
    there[place(key)] = True
    start, end = (np.searchsorted(own[0], (u + k) * n) for k in (0, 1))
    upto = np.cumsum(end - start)
    stops = np.unique(np.r_[0, np.searchsorted(upto, np.arange(1 << 20, (upto[-1] if len(upto) else 0) + 1, 1 << 20)), len(u)])
    for i, j in zip(stops, stops[1:]):
        many = end[i:j] - start[i:j]
        pair = np.repeat(np.arange(i, j), many)
        at = np.arange(len(pair)) + np.repeat(start[i:j] - (np.cumsum(many) - many), many)
        w = own[0][at] - u[pair] * n
        ask = v[pair] * n + w
        maybe = np.flatnonzero(there[place(ask)])
        to = np.minimum(np.searchsorted(key, ask[maybe]), len(key) - 1)
        hit = key[to] == ask[maybe]
        maybe, to = maybe[hit], to[hit]
        yield pair[maybe], w[maybe], own[1][at[maybe]], bits[to]


def overlapped_in_task(near: pa.Table, far: pa.Table) -> pa.Table:
    """The degrees, sums of ``directed_overlaps`` and edge flags of a cell's pairs; ``far`` has its neighbour rows of u (role
    0) and of v (role 1) and the nodes with their degrees (role 3: x, und, out, in), or each linked pair of a whole
    component once (role 2)."""
    role, x, w, o, i = (far.column(c).to_numpy() for c in ("role", "x", "w", "o", "i"))
    if (role == 2).any():  # a whole component: its degrees are its edges'
        ids, at = np.unique(np.concatenate([x, w]), return_inverse=True)
        a, b, n = at[: len(x)], at[len(x) :], len(ids)
        apart = a != b
        out = np.bincount(a, o, n) + np.bincount(b[apart], i[apart], n)
        in_ = np.bincount(a, i, n) + np.bincount(b[apart], o[apart], n)
        und, out, in_ = (np.bincount(a, minlength=n) + np.bincount(b[apart], minlength=n)), out.astype(np.int64), in_.astype(np.int64)
        key = np.concatenate([a * n + b, b[apart] * n + a[apart]])
        order = np.argsort(key)
        of_u = of_v = key[order], np.concatenate([(o > 0) + 2 * (i > 0), ((i > 0) + 2 * (o > 0))[apart]]).astype(np.int8)[order]
    else:
        node = role == 3
        order = np.argsort(x[node])
        ids, und, out, in_ = (c[node][order] for c in (x, w, o, i))
        n = len(ids)

        def side(k: int):
            some = role == k
            key = np.searchsorted(ids, x[some]) * n + np.searchsorted(ids, w[some])
            order = np.argsort(key)
            return key[order], ((o[some] > 0) + 2 * (i[some] > 0)).astype(np.int8)[order]

        of_u, of_v = side(0), side(1)
    u, v = (np.searchsorted(ids, near.column(c).to_numpy()) for c in "uv")
    total, m = (out + in_).astype(float), len(u)
    with np.errstate(divide="ignore"):
        weigh_und = np.where(und > 1, 1 / np.log(und + 1e-9), 0.0)
        weigh_dir, weigh_out = np.where(total > 1, 1 / np.log(total), 0.0), np.where(out > 0, 1.0 / np.maximum(out, 1), 0.0)
    sums = {c: np.zeros(m) for c in OVERLAPS}
    turned = und[v] < und[u]
    for turn in (False, True):
        some = np.flatnonzero(turned == turn)
        some = some[np.argsort((u if turn else v)[some], kind="stable")]
        ends = (v[some], u[some]) if turn else (u[some], v[some])
        if not len(some) or not len(of_u[0]) or not len(of_v[0]):
            continue
        for pair, w_, mine, its in met_in_task(n, *((of_v, of_u) if turn else (of_u, of_v)), *ends):
            a, b = (its, mine) if turn else (mine, its)
            at, oi = some[pair], (a & 1) & (b >> 1)
            low = at.min() if len(at) else 0
            for c, value in (("oo", a & b & 1), ("oi", oi), ("io", (a >> 1) & b & 1), ("ii", (a >> 1) & (b >> 1)), ("und", None), ("aa_und", weigh_und[w_]), ("aa_dir", weigh_dir[w_] * oi), ("ra_dir", weigh_out[w_] * oi)):
                got = np.bincount(at - low, value)
                sums[c][low : low + len(got)] += got
    ask, (key, bits) = u * n + v, of_u
    to = np.minimum(np.searchsorted(key, ask), len(key) - 1)
    edge = np.where(key[to] == ask, bits[to], 0) if len(key) else np.zeros(m, np.int8)
    flags = {"forward": (edge & 1).astype(np.int32), "backward": (edge >> 1 & 1).astype(np.int32)}
    whole = {c: x.astype(np.int64) if c in OVERLAPS[:5] else x for c, x in sums.items()}
    ends = {f"{c}_{e}": d[at] for e, at in (("u", u), ("v", v)) for c, d in zip(DEGREES, (out, in_, und))}
    return pa.table({**{c: near.column(c) for c in near.schema.names if c not in CELLS}, **ends, **whole, **flags})


def directed_overlaps(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs with counts of common neighbours by direction and sums over them, degrees of both ends, forward and backward.

    oo, oi, io, ii: w in out/in of u and out/in of v; und: in either of both.  aa_und weighs by
    ln of the undirected degree + 1e-9 (degree over 1), aa_dir and ra_dir are over w in
    out(u) and in(v), by ln of the total degree and by the out-degree.  forward and backward (0, 1) are edges
    u->v and v->u.  Only ends in one component can meet.  A component's nodes are dealt to blocks, and
    each pair of blocks is a task's, with the neighbours of both; the end with fewer of them is the one whose
    list a pair meets in full.
    """
    linked = stored(linked_pairs(edges))
    a, b, f, r = (F.col(c) for c in "abfr")
    loop = a == b
    both = lambda x, y, o, i: F.struct(x.alias("x"), y.alias("w"), o.alias("o"), i.alias("i"))
    ends = linked.select(F.explode(F.when(loop, F.array(both(a, b, f, f))).otherwise(F.array(both(a, b, f, r), both(b, a, r, f)))).alias("n")).select("n.*")
    nodes = ends.groupBy(F.col("x").alias("id")).agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), F.count(F.lit(1)).alias("und_degree"))
    nodes = cut(nodes)
    if (nodes.agg(F.sum("und_degree")).first()[0] or 0) <= CELL:
        nodes = nodes.withColumn("part", F.lit(0).cast("long")).withColumn("g", F.lit(1))
    else:
        own = components(linked.where("a < b").select("a", "b"))
        nodes = nodes.join(own.select("id", F.col("component").cast("long").alias("part")), "id", "left").withColumn("part", F.coalesce("part", "id"))
        parts = nodes.groupBy("part").agg(cells(F.sum("und_degree")).alias("g"))
        nodes = cut(nodes.join(parts, "part"))
        del own, parts
        let_go(edges.sparkSession)
    block = lambda c: F.pmod(F.xxhash64(c), F.col("g")).cast("int")
    table = held(nodes)
    placed = looked_up(pairs, nodes, table, ("u", "v"), ["part", "g"])
    met = F.coalesce(F.col("part_u") == F.col("part_v"), F.lit(False))
    near = placed.where(met).withColumn("g", F.col("g_u")).select(*pairs.columns, F.col("part_u").alias("__part"), block("u").alias("__bu"), block("v").alias("__bv"))
    apart = looked_up(placed.where(~met).select(*pairs.columns), nodes, table, ("u", "v"), list(DEGREES)).fillna(0, [f"{c}_{e}" for e in "uv" for c in DEGREES])
    every = F.sequence(F.lit(0), F.col("g") - 1)
    zero = F.lit(0).cast("int")
    whole = looked_up(linked, nodes, table, ("a",), ["part", "g"]).where("g_a = 1")
    roles = [whole.select(F.col("part_a").alias("__part"), zero.alias("__bu"), zero.alias("__bv"), F.lit(2).alias("role"), a.alias("x"), b.alias("w"), f.alias("o"), r.alias("i"))]
    if nodes.where("g > 1").limit(1).count():
        rows = looked_up(ends, nodes, table, ("x",), ["part", "g"]).where("g_x > 1").withColumn("g", F.col("g_x")).select(F.col("part_x").alias("part"), "g", "x", "w", "o", "i", block("x").alias("__b"))
        roles += [
            rows.select("part", F.col("__b"), F.explode(every), F.lit(0), "x", "w", "o", "i"),
            rows.select("part", F.explode(every).alias("__bu"), F.col("__b"), F.lit(1), "x", "w", "o", "i"),
            nodes.where("g > 1").withColumn("__bu", F.explode(every)).select("part", "__bu", F.explode(every), F.lit(3), "id", "und_degree", "out_degree", "in_degree"),
        ]
    far = reduce(DataFrame.unionAll, roles)
    keys = list(CELLS)
    kinds = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in apart.schema] + [f"{c} {'long' if c in OVERLAPS[:5] else 'double'}" for c in OVERLAPS] + ["forward int", "backward int"])

    def solve(a: pa.Table, b: pa.Table) -> pa.Table:
        return overlapped_in_task(a, b) if a.num_rows else pa.table({c: pa.array([], t) for c, t in empty})

    empty = [(f.name, f.type) for f in to_arrow_schema(StructType.fromDDL(kinds))]
    found = near.groupBy(*keys).cogroup(far.groupBy(*keys)).applyInArrow(solve, kinds)
    none = [F.lit(0).cast("long").alias(c) for c in OVERLAPS[:5]] + [F.lit(0.0).alias(c) for c in OVERLAPS[5:]] + [F.lit(0).alias(c) for c in ("forward", "backward")]
    return found.unionByName(apart.select("*", *none))


def edge_flags(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Add forward (u->v) and backward (v->u) as 0 or 1."""
    fwd = edges.select(F.col("src").alias("u"), F.col("dst").alias("v"), F.lit(1).alias("forward"))
    back = edges.select(F.col("dst").alias("u"), F.col("src").alias("v"), F.lit(1).alias("backward"))
    return pairs.join(fwd, ["u", "v"], "left").join(back, ["u", "v"], "left").fillna(0, ["forward", "backward"])


def model_a_features(pairs: DataFrame, edges: DataFrame, exclude_self_edge: bool = False, keep: Sequence[str] = (), overlaps: DataFrame | None = None) -> DataFrame:
    """Nineteen structural features.  ``reciprocal`` holds the pair's own edge, as trained on;
    ``exclude_self_edge`` leaves the forward edge out of it and of the degrees.  Columns of ``keep`` stay; ``overlaps`` are the pairs'
    ``directed_overlaps`` where they are there already."""
    f = directed_overlaps(pairs, edges) if overlaps is None else overlaps
    c = F.col
    out_u, in_v, und_u, und_v = c("out_degree_u"), c("in_degree_v"), c("und_degree_u"), c("und_degree_v")
    if exclude_self_edge:
        lone = F.when((c("forward") == 1) & (c("backward") == 0), 1).otherwise(0)
        out_u, in_v, und_u, und_v = out_u - c("forward"), in_v - c("forward"), und_u - lone, und_v - lone
    both = c("backward") if exclude_self_edge else F.greatest("forward", "backward")
    return f.select(
        "pair_id", *keep, out_u.alias("out_u"), c("in_degree_u").alias("in_u"), c("out_degree_v").alias("out_v"), in_v.alias("in_v"),
        c("oo").alias("cn_out_out"), c("oi").alias("cn_out_in"), c("io").alias("cn_in_out"), c("ii").alias("cn_in_in"), c("und").alias("cn_und"),
        ratio(c("und"), und_u + und_v - c("und")).alias("jaccard"), c("aa_und").alias("adamic_adar"),
        (out_u * in_v).alias("pref_attach"), (und_u * und_v).alias("pref_attach_und"),
        both.cast("int").alias("reciprocal"), c("backward").alias("v_follows_u"), c("oi").alias("path2"),
        (out_u / (c("in_degree_u") + 1)).alias("hub_u"), (c("out_degree_v") / (in_v + 1)).alias("hub_v"), (c("oo") / (out_u + 1)).alias("katz_proxy"),
    )


def model_b_features(pairs: DataFrame, edges: DataFrame, scores: DataFrame | None = None, communities: DataFrame | None = None, keep: Sequence[str] = (), overlaps: DataFrame | None = None) -> DataFrame:
    """Twenty local features, and with ``scores`` (id, pagerank, hub, authority) and ``communities``
    (id, community) the seven global ones.  ``keep`` and ``overlaps`` are as for Model A."""
    f = directed_overlaps(pairs, edges) if overlaps is None else overlaps
    extra = []
    if scores is not None:
        f = lookup(f, small(scores), "id", 0.0)
        extra += [f"{c}_{e}" for c in scores.columns if c != "id" for e in "uv"]
    if communities is not None:
        f = common_labels(f, small(communities), "community", "same_community")
        extra.append("same_community")
    c = F.col
    total_u, total_v = c("out_degree_u") + c("in_degree_u"), c("out_degree_v") + c("in_degree_v")
    return f.select(
        "pair_id", *keep, c("oi").alias("out_in_common"), c("io").alias("in_out_common"), c("oo").alias("common_succ"), c("ii").alias("common_pred"),
        ratio(c("oi"), c("out_degree_u") + c("in_degree_v") - c("oi")).alias("jaccard_out_in"), c("aa_dir").alias("adamic_adar"), c("ra_dir").alias("resource_alloc_dir"),
        ratio(c("oi"), c("out_degree_u")).alias("triadic_closure"), c("backward").alias("reverse_exists"), (c("oi") + c("io") + c("oo") + c("ii")).alias("common_all"),
        c("out_degree_u").alias("out_deg_u"), c("in_degree_u").alias("in_deg_u"), c("out_degree_v").alias("out_deg_v"), c("in_degree_v").alias("in_deg_v"),
        total_u.alias("total_u"), total_v.alias("total_v"), (c("out_degree_u") * c("in_degree_v")).alias("pref_attach"), (total_u * total_v).alias("pref_attach_total"),
        (c("out_degree_u") / (c("in_degree_u") + 1)).alias("u_follow_ratio"), (c("out_degree_v") / (c("in_degree_v") + 1)).alias("v_follow_ratio"), *extra,
    )


def undirected_overlaps(pairs: DataFrame, sym: DataFrame) -> DataFrame:
    """Pairs with cn, aa (degree over 1), ra, degrees of both ends (0: unknown), and adjacent (0/1); the
    neighbours of the end with fewer are looked up among the other's."""
    deg = degrees(sym)
    nb = sym.join(deg, sym["dst"] == deg["id"]).select(F.col("src").alias("x"), F.col("dst").alias("w"), "degree")
    few = fewer(lookup(pairs.select("pair_id", "u", "v"), deg, "id"), "degree")
    met = few.join(nb, "x").join(sym.select(F.col("src").alias("y"), F.col("dst").alias("w")), ["y", "w"])
    agg = met.groupBy("pair_id").agg(
        F.count(F.lit(1)).alias("cn"), F.sum(F.when(F.col("degree") > 1, 1 / F.ln(F.col("degree").cast("double")))).alias("aa"), F.sum(F.lit(1.0) / F.col("degree")).alias("ra")
    )
    near = sym.select(F.col("src").alias("u"), F.col("dst").alias("v"), F.lit(1).alias("adjacent"))
    out = pairs.join(agg, "pair_id", "left").join(near, ["u", "v"], "left").fillna(0, ["cn", "adjacent"]).fillna(0.0, ["aa", "ra"])
    return lookup(out, deg, "id")


def common_labels(pairs: DataFrame, labels: DataFrame, column: str, out: str) -> DataFrame:
    """Add 1 where both ends have the same label, else 0; an unknown node matches none."""
    named = labels.select("id", F.col(column).alias("__l"))
    u = named.select(F.col("id").alias("u"), F.col("__l").alias("__lu"))
    v = named.select(F.col("id").alias("v"), F.col("__l").alias("__lv"))
    return pairs.join(u, "u", "left").join(v, "v", "left").withColumn(out, F.coalesce((F.col("__lu") == F.col("__lv")).cast("int"), F.lit(0))).drop("__lu", "__lv")


def consensus_share(pairs: DataFrame, partitions: DataFrame) -> DataFrame:
    """Add consensus: the share of runs of (run, id, community) that put both ends together.

    A node's labels of all runs travel as one array.  Both joins are merged: the planner takes the labels
    for as small as the table their nodes came from and would broadcast them all.
    """
    own = partitions.where(F.col("community").isNotNull()).groupBy("id").agg(F.collect_set(F.struct("run", "community")).alias("__c"))
    u, v = (own.select(F.col("id").alias(f"__{e}"), F.col("__c").alias(f"__c{e}")).hint("merge") for e in "uv")
    runs = F.broadcast(partitions.agg(F.count_distinct("run").alias("__runs")))
    met = pairs.join(u, F.col("u") == F.col("__u"), "left").join(v, F.col("v") == F.col("__v"), "left").crossJoin(runs)
    same = F.coalesce(F.size(F.array_intersect("__cu", "__cv")), F.lit(0))
    return met.withColumn("consensus", F.when(F.col("__cu").isNull() | F.col("__cv").isNull(), 0).otherwise(same) / F.col("__runs")).drop("__u", "__v", "__cu", "__cv", "__runs")


def tuned_features(pairs: DataFrame, sym: DataFrame, same: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """cn, jaccard, adamic_adar, log_pa and a flag for each (labels, column, name) of ``same``;
    all zero where an end is unknown."""
    f = undirected_overlaps(pairs, sym)
    for labels, column, name in same:
        f = common_labels(f, labels, column, name)
    du, dv = F.col("degree_u"), F.col("degree_v")
    known = (du > 0) & (dv > 0)
    flags = [F.when(known, F.col(n)).otherwise(0).alias(n) for _, _, n in same]
    return f.select(
        "pair_id", "cn", ratio(F.col("cn"), du + dv - F.col("cn")).alias("jaccard"), F.col("aa").alias("adamic_adar"),
        F.when(known, F.ln(F.greatest(du * dv, F.lit(1)).cast("double"))).otherwise(0.0).alias("log_pa"), *flags,
    )


def hidden_edge_features(pairs: DataFrame, sym: DataFrame, same: list[tuple[DataFrame, str, str]], distance: DataFrame, hide: bool = False) -> DataFrame:
    """As the tuned ones with ra, short_path and log degrees.  ``hide`` leaves the pair's own edge out
    of degrees and neighbour sets (common neighbours cannot change)."""
    f = undirected_overlaps(pairs, sym)
    for labels, column, name in same:
        f = common_labels(f, labels, column, name)
    f = f.join(distance.select("pair_id", "short_path"), "pair_id", "left")
    off = F.col("adjacent") if hide else F.lit(0)
    du, dv = F.col("degree_u") - off, F.col("degree_v") - off
    return f.select(
        "pair_id", "cn", ratio(F.col("cn"), du + dv - F.col("cn")).alias("jaccard"), F.col("aa").alias("adamic_adar"), F.col("ra").alias("resource_alloc"),
        F.ln(F.greatest(du * dv, F.lit(1)).cast("double")).alias("log_pa"), "short_path", *[n for _, _, n in same],
        F.ln(du + 1.0).alias("log_deg_u"), F.ln(dv + 1.0).alias("log_deg_v"),
    )
