"""Mixing sources to target weights: balanced sampling by the cube method."""

from __future__ import annotations

import itertools
from fractions import Fraction

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents

#: Rows of a block in the flight phase; a block leaves at most two rows undecided.
BLOCK = 2048
EDGE = 1e-9
#: Sources whose table is broadcast; more of them are joined.
STRATA = 100_000


def word_targets(sizes: dict, weights: tuple = (5, 2, 1), most: int = 3) -> dict:
    """Each source's target: its weight's share of all words, at most ``most`` times
    its own; what is over is shared again by weight among those not at that limit.
    Exact fractions.  Sources are weighted in order of code points, null last."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: Fraction(weights[i % len(weights)]) for i, s in enumerate(order)}
    left, open_, target = Fraction(sum(sizes.values())), set(order), {s: Fraction(0) for s in order}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if unit * weight[s] >= most * sizes[s]}
        for s in full or open_:
            target[s] = Fraction(most * sizes[s]) if full else unit * weight[s]
        if not full:
            break
        left -= sum(target[s] for s in full)
        open_ -= full
    return target


def flight(size: np.ndarray, p: np.ndarray, draw) -> np.ndarray:
    """Move inclusion probabilities until at most two lie strictly between 0 and 1.

    Each step takes three undecided units and moves along a vector u with
    sum(u) = 0 and sum(u * size) = 0, so the expected numbers of documents and of
    words stay; the direction is drawn so that each unit's expectation stays.
    Two undecided units of equal size are moved against each other.  Given in order of
    falling size, the units left at the end are mostly small.
    """
    p = p.copy()
    live: list[int] = []

    def move(units, u) -> None:
        ahead = min((1 - p[i]) / v if v > 0 else p[i] / -v for i, v in zip(units, u) if v)
        back = min(p[i] / v if v > 0 else (1 - p[i]) / -v for i, v in zip(units, u) if v)
        step = ahead if draw() * (ahead + back) < back else -back
        for i, v in zip(units, u):
            p[i] += step * v
            p[i] = 0.0 if p[i] < EDGE else 1.0 if p[i] > 1 - EDGE else p[i]

    sizes = size.astype(float).tolist()
    for i in range(len(p)):
        if EDGE <= p[i] <= 1 - EDGE:
            live.append(i)
        while len(live) == 3:
            a, b, c = live
            u = (sizes[b] - sizes[c], sizes[c] - sizes[a], sizes[a] - sizes[b])
            top = max(map(abs, u))
            move(live, [x / top for x in u] if top else (1.0, -1.0, 0.0))
            live = [k for k in live if 0 < p[k] < 1]
    if len(live) == 2 and sizes[live[0]] == sizes[live[1]]:
        move(live, (1.0, -1.0))
    return p


def landing(size: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Round the few undecided units so that words, then documents, come nearest."""
    p = p.copy()
    live = [i for i in range(len(p)) if EDGE <= p[i] <= 1 - EDGE]
    words, rows = sum(p[i] * size[i] for i in live), sum(p[i] for i in live)
    best = min(
        itertools.product((0.0, 1.0), repeat=len(live)),
        key=lambda x: (abs(sum(a * size[i] for a, i in zip(x, live)) - words), abs(sum(x) - rows), x),
    )
    for i, x in zip(live, best):
        p[i] = x
    return p


def flown_block(seed: int, level: int, last: bool):
    def fly(key, rows):
        rows = rows.sort_values(["size", "id", "copy"], ascending=[False, True, True], na_position="last", kind="stable").reset_index(drop=True)
        name = f"{seed}/{level}/{'/'.join(str(int(k)) for k in key)}"
        draw = np.random.Generator(np.random.PCG64(xxhash.xxh64_intdigest(name))).random
        size = rows["size"].to_numpy()
        p = flight(size, rows["p"].to_numpy(), draw)
        return rows.assign(p=landing(size, p) if last else p).drop(columns="block")

    return fly


def by_stratum(df: DataFrame, table: list[tuple], schema: str) -> DataFrame:
    """``df`` with the columns of ``table``, a row for each stratum ``s``; broadcast up to STRATA rows."""
    made = df.sparkSession.createDataFrame(table, schema)
    return df.join(F.broadcast(made) if len(table) <= STRATA else made, "s")


def balanced_sample(df: DataFrame, counts: dict[int, int], seed: int = 0) -> DataFrame:
    """Decide column ``p`` of (id, copy, s, size, p) to 0 or 1, by stratum ``s``; ``copy`` tells equal rows apart.

    ``counts`` has each stratum's rows.  Flights run in blocks of about BLOCK rows,
    dealt by a hash of the row; the two rows that each leaves undecided are gathered in
    blocks again until one block a stratum is left, which lands.  No task ever has
    more than a block.  Draws depend on the seed, stratum and block alone.
    """
    schema = "id long, copy long, s int, size long, p double"
    undecided = (F.col("p") > 0) & (F.col("p") < 1)
    blocks = {s: max(1, -(-n // BLOCK)) for s, n in counts.items()}
    done = df.where(~undecided)
    todo = df.where(undecided)
    level = 0
    while blocks:
        last = all(n == 1 for n in blocks.values())
        dealt = by_stratum(todo, sorted(blocks.items()), "s int, blocks long")
        key = F.pmod(F.xxhash64("id", "size", "copy", F.lit(level)), F.col("blocks")).alias("block")
        flown = cut(dealt.select("id", "copy", "s", "size", "p", key).groupBy("s", "block").applyInPandas(flown_block(seed, level, last), schema))
        done = done.unionByName(flown.where(~undecided))
        todo = flown.where(undecided)
        if last:
            break
        blocks = {s: max(1, -(-2 * b // BLOCK)) if b > 1 else 1 for s, b in blocks.items()}
        level += 1
    return done


def each_copy(counted: DataFrame) -> DataFrame:
    """A row with ``copy`` from 0 for each of column n; many copies are dealt to several tasks in runs of BLOCK."""
    some = counted.withColumn("__run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / BLOCK))))
    first = F.col("__run") * BLOCK
    dealt = some.repartition("id", "__run")
    return dealt.withColumn("copy", F.explode(F.sequence(first, F.least(first + BLOCK, F.col("n")) - 1))).drop("__run", "n")


def mix_sources(
    docs: DataFrame, weights: tuple = (5, 2, 1), most: int = 3, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """How often each document is taken so that each source's words meet its target.

    Returns ``id_col``, source, size, source_size, target, times (how often the document
    is taken, at most ``most``) and taken (size times that).  A source whose target is r
    times its words takes every document floor(r) times, and once more those that a
    balanced sample with equal probabilities r - floor(r) holds, so that words and
    documents both come out at the target but for the last one or two documents.

    Size is the number of words; null and empty texts have size 0 and take nothing.
    A null source is a source of its own, the last.  Rows with equal ids are
    separate rows; rows equal in id, source and size are counted, and dealt to blocks
    one by one.  The table of sources goes to the driver, which reshares targets among them.
    """
    words = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    sized = cut(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words.alias("size")))
    totals = {r.source: (r.words, r.n) for r in sized.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")).collect()}
    target = word_targets({s: w for s, (w, _) in totals.items()}, weights, most)
    rows = []
    for i, s in enumerate(target):
        ratio = target[s] / totals[s][0] if totals[s][0] else Fraction(0)
        rows.append((i, s, totals[s][0], float(target[s]), int(ratio), float(ratio - int(ratio))))
    counted = sized.groupBy("id", "source", "size").agg(F.count(F.lit(1)).alias("n"))
    table = docs.sparkSession.createDataFrame([(i, s, part) for i, s, *_, part in rows], "s int, of string, p double")
    named = counted.join(F.broadcast(table) if len(rows) <= STRATA else table, F.col("source").eqNullSafe(F.col("of")))
    units = each_copy(named.select("id", "s", "size", "p", "n"))
    chosen = balanced_sample(units, {i: totals[s][1] for i, s, *_, part in rows if part}, seed)
    return (
        by_stratum(chosen, [r[:5] for r in rows], "s int, source string, source_size long, target double, times int")
        .select(
            F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target",
            (F.col("times") + F.col("p").cast("int")).alias("times"),
        )
        .withColumn("taken", F.col("size") * F.col("times"))
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")
