"""Sharding: best-fit-decreasing bin packing of indivisible groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, gapless_rank

#: Sizes from 2**PRECISION on are rounded up to PRECISION significant bits, so the
#: plan has at most 2**PRECISION size classes an octave, whatever the input.
PRECISION = 12
#: A group of more than 1 in HOT rows is broadcast to them.
HOT = 1024


class FitTree:
    """Balanced search tree (AA tree) of (remaining capacity, bin) pairs."""

    __slots__ = ("root",)

    def __init__(self) -> None:
        self.root = None  # a node is [key, level, left, right]

    def tightest(self, size: int):
        """The smallest pair whose remaining capacity holds ``size``."""
        node, best, key = self.root, None, (size, -1)
        while node:
            if node[0] >= key:
                best, node = node[0], node[2]
            else:
                node = node[3]
        return best

    def add(self, key) -> None:
        self.root = self._add(self.root, key)

    def remove(self, key) -> None:
        self.root = self._remove(self.root, key)

    @staticmethod
    def _skew(node):
        left = node[2]
        if left and left[1] == node[1]:
            node[2], left[3] = left[3], node
            return left
        return node

    @staticmethod
    def _split(node):
        right = node[3]
        if right and right[3] and right[3][1] == node[1]:
            node[3], right[2] = right[2], node
            right[1] += 1
            return right
        return node

    def _add(self, node, key):
        if node is None:
            return [key, 1, None, None]
        side = 2 if key < node[0] else 3
        node[side] = self._add(node[side], key)
        return self._split(self._skew(node))

    def _remove(self, node, key):
        if node is None:
            return None
        if key != node[0]:
            side = 2 if key < node[0] else 3
            node[side] = self._remove(node[side], key)
        elif not node[2] and not node[3]:
            return None
        else:
            near, far = (3, 2) if node[3] else (2, 3)
            heir = node[near]
            while heir[far]:
                heir = heir[far]
            node[0] = heir[0]
            node[near] = self._remove(node[near], heir[0])
        low = min(node[2][1] if node[2] else 0, node[3][1] if node[3] else 0) + 1
        if low < node[1]:
            node[1] = low
            if node[3] and node[3][1] > low:
                node[3][1] = low
        node = self._skew(node)
        if node[3]:
            node[3] = self._skew(node[3])
            if node[3][3]:
                node[3][3] = self._skew(node[3][3])
        node = self._split(node)
        if node[3]:
            node[3] = self._split(node[3])
        return node


def best_fit_decreasing(classes: list[tuple[int, int]], capacity: int, bins: int | None = None):
    """Place ``count`` equal items of each ``(size, count)``, largest first, each in
    the bin with the least remaining capacity that holds it.

    ``bins`` opens that many from the start and allows no more; None opens bins as
    needed.  Returns (runs, number of bins), a run being (size, first, count, bin)
    over the ranks of a size's items, or None if ``bins`` do not hold them all.
    Equal items follow each other into one bin until it has no room, which is
    what placing them one at a time does.
    """
    tree, runs, opened = FitTree(), [], bins or 0
    for b in range(opened):
        tree.add((capacity, b))
    for size, count in sorted(classes, reverse=True):
        first = 0
        while count:
            found = tree.tightest(size)
            if found is None:
                if bins is not None:
                    return None
                found = (max(capacity, size), opened)  # an item above capacity has a bin of its own
                opened += 1
            else:
                tree.remove(found)
            room, b = found
            n = min(count, room // size) if size else count
            runs.append((size, first, n, b))
            tree.add((room - n * size, b))
            first, count = first + n, count - n
    return runs, opened


def plan_shards(classes: list[tuple[int, int]], shards: int):
    """The runs (size, first, count, bin) of all items over ``shards`` bins.

    An item that is larger than an even share of what is left has a bin of its own, the
    largest first; the others go best-fit-decreasing into the other bins, at the smallest tried
    capacity at which they hold all.
    """
    left, runs, used = dict(classes), [], 0
    total = sum(s * n for s, n in classes)
    for size in sorted(left, reverse=True):
        while left[size] and used < shards - 1 and size * (shards - used) > total:
            runs.append((size, runs[-1][1] + 1 if runs and runs[-1][0] == size else 0, 1, used))
            left[size], total, used = left[size] - 1, total - size, used + 1
        if left[size]:
            break
    alone = {size: sum(r[0] == size for r in runs) for size in {r[0] for r in runs}}
    rest = [(size, n) for size, n in left.items() if n]
    fair = -(-total // (shards - used))
    for k in range(60):
        done = best_fit_decreasing(rest, fair + int(fair * 2.0**k / 65536) + (k > 0), shards - used)
        if done:
            return runs + [(s, first + alone.get(s, 0), n, b + used) for s, first, n, b in done[0]]
    raise AssertionError("no capacity holds the items")


def shard_documents(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """Deal documents into ``shards`` of nearly equal bytes, equal texts together.

    Returns ``id_col``, size, text_crc32, law ('bytes'), shard, slot and grown_shard
    (null: the law is not ``key``), one row per row of ``docs``.

    A group is all rows with one text; null and empty texts are one group of size
    ``overhead`` a row.  Groups are never divided: one above an even share has a shard of its own,
    and the other shards are equal among themselves.  Repeated rows and null ids are
    rows like any other.  An empty table gives none.

    The plan is made on the driver from a histogram of group sizes, which has a
    fixed bound (see PRECISION): groups of one class are interchangeable, so a
    group's rank in its class says which run, and so which shard, it is in.  Groups of more
    than 1 in HOT of the rows, HOT groups at most, find their rows by broadcast.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = cut(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + overhead).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.unhex(F.md5(text.cast("binary"))).alias("g"),
        )
    )
    spark = docs.sparkSession
    units = base.groupBy("g").agg(F.sum("size").alias("unit"), F.count(F.lit(1)).alias("n"))
    step = F.pow(F.lit(2.0), F.greatest(F.lit(0), F.floor(F.log2(F.greatest("unit", F.lit(1)))) - PRECISION)).cast("long")
    units = cut(units.withColumn("class", (F.ceil(F.col("unit") / step) * step).cast("long")))
    histogram = units.groupBy("class").agg(F.count(F.lit(1)).alias("units"), F.sum("n").alias("rows")).collect()
    runs = plan_shards([(r["class"], r["units"]) for r in histogram], shards) if histogram else []
    plan = spark.createDataFrame([(s, a, a + n, b) for s, a, n, b in runs], "class long, first long, last long, shard int")
    placed = cut(gapless_rank(units, ["class"], ["g"], "__rank").alias("u").join(
        F.broadcast(plan.alias("p")),
        (F.col("u.class") == F.col("p.class")) & (F.col("__rank") >= F.col("first")) & (F.col("__rank") < F.col("last")),
    ).select("g", "n", "shard"))
    hot = F.broadcast(placed.where(F.col("n") * HOT > sum(r["rows"] for r in histogram)).select("g", "shard"))
    dealt = base.join(hot, "g", "left_anti").join(placed.select("g", "shard"), "g").unionByName(base.join(hot, "g"))
    slotted = gapless_rank(cut(dealt.drop("g")), ["shard"], ["doc_id", "text_crc32"], "slot")
    return slotted.select(
        F.col("doc_id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir))
