"""N-gram Jaccard join with signature trees."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, U64, UPPER, WordHasher, cut, documents, fan_out, mix64, slices, window_hashes
from .components import components

SHINGLE = 5
#: Documents link at this similarity or more: NUMERATOR / DENOMINATOR.
NUMERATOR, DENOMINATOR = 75, 100
#: Counters of the shingle counts that put rare shingles first, and those of a row of them.
COUNTERS, SPAN = 1 << 22, 1 << 16
#: A prefix has a set's size / SPARE shingles more than one shared shingle needs, so sets that link share more.
SPARE = 20
#: A shingle is hot if its counter has HOT_TEXTS texts and HOT_TIMES the mean.
HOT_TEXTS, HOT_TIMES = 1 << 16, 4
#: Bits of a token bitmap and children of a tree node.
BITS, FAN = 2048, 8
#: Shingles of a block of hubs; a hub above is divided into chunks.
BLOCK_SHINGLES = 1 << 20
#: Node pairs that a traversal holds at once.
FRONTIER = 1 << 15
#: Sets a side of a tile of pairs; pairs from which a tile is counted as one product, and tokens of a part of it.
TILE, DENSE, PART = 128, 512, 4096
FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())


def shingles(text: str, hasher: WordHasher) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles of the whole text; a text of
    fewer words is one shingle, one without words has none."""
    words = text.encode("utf-8", "replace").translate(FOLD).split()
    if not words:
        return np.empty(0, U64)
    h = hasher.of(words)
    if len(h) < SHINGLE:
        return window_hashes(h, len(h), seed=100 * len(h))
    return np.unique(window_hashes(h, SHINGLE))


def shingle_levels(docs: DataFrame) -> np.ndarray:
    """About four times the binary logarithm of how many texts hold a shingle, by COUNTERS hashed
    counters over all of (id, text).  A table of fixed size, whatever the input: shingles that share
    a counter share a level, which costs time, not links."""

    def count(batches):
        hasher, held = WordHasher(), np.zeros(COUNTERS, np.uint32)
        for batch in batches:
            for part in slices(batch):
                each = [shingles(t, hasher) for t in part.column(1).to_pylist() if t]
                held += np.bincount((np.concatenate(each) % U64(COUNTERS)).astype(np.int64), minlength=COUNTERS).astype(np.uint32) if each else 0
        zip_ = zstandard.ZstdCompressor(level=1)
        for k in range(0, COUNTERS, SPAN):
            if held[k : k + SPAN].any():
                yield pa.RecordBatch.from_arrays([pa.array([k // SPAN], pa.int32()), pa.array([zip_.compress(held[k : k + SPAN].tobytes())])], names=["span", "held"])

    def add(batches):
        total, unzip = {}, zstandard.ZstdDecompressor()
        for batch in batches:
            for k, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sum_ = total.setdefault(k, np.zeros(SPAN, np.uint64))
                sum_ += np.frombuffer(unzip.decompress(held), np.uint32)
        for k, sum_ in total.items():
            level = np.minimum(4 * np.log2(1.0 + sum_), 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([level.tobytes()])], names=["span", "levels"])

    spans = docs.mapInArrow(count, "span int, held binary").repartition(COUNTERS // SPAN, "span").mapInArrow(add, "span int, levels binary")
    out = np.zeros(COUNTERS, np.uint8)
    for r in spans.collect():
        out[r.span * SPAN : (r.span + 1) * SPAN] = np.frombuffer(r.levels, np.uint8)
    return out


def hot_level(levels: np.ndarray) -> int:
    """The level from which shingles are hot."""
    mean = float((2.0 ** (levels / 4.0)).mean())
    return int(np.ceil(4 * np.log2(max(HOT_TEXTS, HOT_TIMES * mean))))


def prefix(sets: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The rarest shingles of a set, so many that two sets that link share ``least_shared`` of them.

    All sets order shingles alike, by level and then by hash.  A link needs an overlap of
    at least NUMERATOR / DENOMINATOR of either set, so what lies beyond either prefix is too
    little for one: the first of the common shingles are in both prefixes.
    """
    n = len(sets)
    most = n - -(-NUMERATOR * n // DENOMINATOR) + 1 + n // SPARE
    order = (levels[(sets % U64(COUNTERS)).astype(np.int64)].astype(U64) << U64(56)) | (mix64(sets) >> U64(8))
    return sets[np.argpartition(order, most - 1)[:most]] if most < n else sets


def least_shared(n: Column) -> Column:
    """How many shingles of its prefix a set of n shares with any that it links with."""
    return F.least(F.floor(n / SPARE) + 1, F.ceil(n * NUMERATOR / DENOMINATOR))


def identity(sets: np.ndarray) -> tuple[int, int]:
    """128 bits of a shingle set."""
    return tuple(int(mix64(sets + U64(k)).sum(dtype=U64).view(np.int64)) for k in (1, 2))


def signatures(docs: DataFrame) -> DataFrame:
    """(id, n, h1, h2, keys, hot) of (id, text): set size, 128-bit identity of the set, its prefix without
    and with hot shingles only."""
    found = shingle_levels(docs)
    table, hot = docs.sparkSession.sparkContext.broadcast(found), hot_level(found)

    def run(batches):
        hasher, levels = WordHasher(), table.value
        for batch in batches:
            for part in slices(batch):
                rows = []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    s = shingles(text or "", hasher)
                    if len(s):
                        keys = prefix(s, levels)
                        often = levels[(keys % U64(COUNTERS)).astype(np.int64)] >= hot
                        rows.append((doc, len(s), *identity(s), keys[~often].view(np.int64), keys[often].view(np.int64)))
                    else:
                        rows.append((doc, 0, 0, 0, None, None))
                kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())] * 2
                names = ["id", "n", "h1", "h2", "keys", "hot"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return docs.mapInArrow(run, "id long, n long, h1 long, h2 long, keys array<long>, hot array<long>")


def token_sets(docs: DataFrame) -> DataFrame:
    """(first, h1, h2, tokens) of (id, text): the shingle set's identity, and itself as bytes."""

    def run(batches):
        hasher = WordHasher()
        for batch in batches:
            for part in slices(batch):
                texts = [(i, shingles(t, hasher)) for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) if t]
                rows = [(i, *identity(s), s.tobytes()) for i, s in texts if len(s)]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                columns = zip(*rows) if rows else [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["first", "h1", "h2", "tokens"])

    return docs.mapInArrow(run, "first long, h1 long, h2 long, tokens binary")


class SignatureTree:
    """Sets in order of size, under nodes of FAN children.  A node holds the OR of its
    sets' token bitmaps, their size range, and the most tokens of a set beyond its
    own bits (tokens that share a bit)."""

    def __init__(self, ids: np.ndarray, sets: list[np.ndarray]) -> None:
        size = np.array([len(s) for s in sets], np.int64)
        sketch = np.array([s[0] if len(s) else 0 for s in sets], U64)
        order = np.lexsort((ids, sketch, (np.log2(np.maximum(size, 1)) * 4).astype(int)))
        self.ids, self.sets = ids[order], [sets[i] for i in order]
        size = size[order]
        bitmap = np.zeros((len(sets), BITS // 8), np.uint8)
        for i, s in enumerate(self.sets):
            bit = (mix64(s) & U64(BITS - 1)).astype(np.int64)
            flags = np.zeros(BITS, bool)
            flags[bit] = True
            bitmap[i] = np.packbits(flags)
        bitmap = bitmap.view(U64)
        beyond = size - np.bitwise_count(bitmap).sum(axis=1, dtype=np.int64)
        self.levels = [(bitmap, size, size, beyond)]
        while len(self.levels[-1][1]) > 1:
            bitmap, low, high, beyond = self.levels[-1]
            at = np.arange(0, len(low), FAN)
            self.levels.append((np.bitwise_or.reduceat(bitmap, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(beyond, at)))


def possible(a: SignatureTree, b: SignatureTree, la: int, lb: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether any set under node x of ``a`` may link with any under node y of ``b``.

    A set's tokens outside the other node's bitmap can't be shared, so an overlap is at most
    the common bits plus the tokens beyond bits, of either side, and at most the larger size of
    either node.  A link needs overlap * (D + N) >= N * (sum of sizes).
    """
    (ma, lowa, higha, moreA), (mb, lowb, highb, moreB) = a.levels[la], b.levels[lb]
    need = -(-NUMERATOR * (lowa[x] + lowb[y]) // (NUMERATOR + DENOMINATOR))
    good = np.minimum(higha[x], highb[y]) >= need
    good &= (DENOMINATOR * higha[x] >= NUMERATOR * lowb[y]) & (DENOMINATOR * highb[y] >= NUMERATOR * lowa[x])
    at = np.flatnonzero(good)
    common = np.bitwise_count(ma[x[at]] & mb[y[at]]).sum(axis=1, dtype=np.int64)
    good[at] = common + np.minimum(moreA[x[at]], moreB[y[at]]) >= need[at]
    return good


class Union:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Exact test on two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    common = int((b[at] == a).sum())
    return len(a) > 0 and DENOMINATOR * common >= NUMERATOR * (len(a) + len(b) - common)


def linked_pairs(a: SignatureTree, b: SignatureTree, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact test of the pairs of set x of ``a`` and set y of ``b``; the overlaps of a tile that
    holds many of them are one matrix product over the tokens that both of its sides hold."""
    out = np.zeros(len(x), bool)
    tile = x // TILE * (len(b.ids) // TILE + 1) + y // TILE
    order = np.argsort(tile, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(tile[order])) + 1):
        if len(at) < DENSE:
            out[at] = [linked(a.sets[i], b.sets[j]) for i, j in zip(x[at].tolist(), y[at].tolist())]
            continue
        (u, i), (v, j) = (np.unique(z[at], return_inverse=True) for z in (x, y))
        left, right = [a.sets[k] for k in u.tolist()], [b.sets[k] for k in v.tolist()]
        shared = np.intersect1d(np.concatenate(left), np.concatenate(right))
        common = np.zeros((len(u), len(v)), np.float32)
        for k in range(0, len(shared), PART):
            part = shared[k : k + PART]
            common += incidence(left, part) @ incidence(right, part).T
        c, total = common[i, j].astype(np.int64), np.array(list(map(len, left)))[i] + np.array(list(map(len, right)))[j]
        out[at] = (c > 0) & (DENOMINATOR * c >= NUMERATOR * (total - c))
    return out


def incidence(sets: list[np.ndarray], tokens: np.ndarray) -> np.ndarray:
    """0 or 1 for every set and every one of the sorted ``tokens``."""
    out = np.zeros((len(sets), len(tokens)), np.float32)
    for row, s in zip(out, sets):
        own = s[np.searchsorted(s, tokens[0]) : np.searchsorted(s, tokens[-1], "right")]
        at = np.searchsorted(tokens, own)
        row[at[tokens[at] == own]] = 1
    return out


def tree_links(a: SignatureTree, b: SignatureTree, itself: bool, elsewhere=None):
    """Every pair of sets of two trees (or of one with ``itself``) that links, once, as arrays
    of positions in a and in b.

    Node pairs are taken from a stack in parts of FRONTIER; a pair that can't link is dropped, else
    its children's pairs follow.  ``elsewhere`` tells for arrays of ids which pairs of
    them are another block's.
    """
    top = (len(a.levels) - 1, len(b.levels) - 1)
    stack = [(*top, np.zeros(1, np.int64), np.zeros(1, np.int64))] if len(a.ids) and len(b.ids) else []
    while stack:
        la, lb, x, y = stack.pop()
        if len(x) > FRONTIER:
            stack.append((la, lb, x[FRONTIER:], y[FRONTIER:]))
            x, y = x[:FRONTIER], y[:FRONTIER]
        if itself and la == 0 and lb == 0:
            keep = x < y
            x, y = x[keep], y[keep]
        good = possible(a, b, la, lb, x, y)
        x, y = x[good], y[good]
        if la == 0 and lb == 0:
            if elsewhere:
                keep = ~elsewhere(a.ids[x], b.ids[y])
                x, y = x[keep], y[keep]
            good = linked_pairs(a, b, x, y)
            yield x[good], y[good]
            continue
        if la >= lb:
            x, y = expand(x, y, len(a.levels[la - 1][1]))
            la -= 1
        if lb and (lb > la):
            y, x = expand(y, x, len(b.levels[lb - 1][1]))
            lb -= 1
        if itself and la == lb:
            keep = (x < y) if la == 0 else (x <= y)
            x, y = x[keep], y[keep]
        if len(x):
            for k in range(len(x) // FRONTIER * FRONTIER, -1, -FRONTIER):
                if len(x[k : k + FRONTIER]):
                    stack.append((la, lb, x[k : k + FRONTIER], y[k : k + FRONTIER]))


def hook(up: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Connect every i with its j; ``up`` has each position's root before and after."""
    while len(i):
        i, j = up[i], up[j]
        apart = i != j
        i, j = i[apart], j[apart]
        np.minimum.at(up, np.maximum(i, j), np.minimum(i, j))
        while (up[up] != up).any():
            up[:] = up[up]


def count_links(a: SignatureTree, b: SignatureTree, itself: bool, elsewhere=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, first, n) of every set of the two trees: the smallest id of its connected group and its number of links."""
    ids, shift = (a.ids, 0) if itself else (np.concatenate([a.ids, b.ids]), len(a.ids))
    up, n = np.arange(len(ids)), np.zeros(len(ids), np.int64)
    for i, j in tree_links(a, b, itself, elsewhere):
        n += np.bincount(i, minlength=len(ids)) + np.bincount(j + shift, minlength=len(ids))
        hook(up, i, j + shift)
    first = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(first, up, ids)
    return ids, first[up], n


def join_trees(a: SignatureTree, b: SignatureTree, itself: bool) -> list[tuple[int, int]]:
    """Connected groups of the links between two trees (or in one): every other id with its group's smallest."""
    ids, first, _ = count_links(a, b, itself)
    return [(i, f) for i, f in zip(ids.tolist(), first.tolist()) if i != f]


def expand(x: np.ndarray, y: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the children of x with y."""
    child = (x[:, None] * FAN + np.arange(FAN)).ravel()
    other = np.repeat(y, FAN)
    return child[child < below], other[child < below]


def block_trees(side: np.ndarray, ids: np.ndarray, tokens: list[bytes]) -> tuple[SignatureTree, SignatureTree, bool] | None:
    """The trees a block joins, and whether they are one; None if only one of its two sides is there."""
    ids, once = np.unique(ids, return_index=True)
    side, sets = side[once], [np.frombuffer(tokens[i], U64) for i in once]
    part = lambda s: SignatureTree(ids[side == s], [sets[i] for i in np.flatnonzero(side == s)])
    if (side == 0).all():
        tree = part(0)
        return tree, tree, True
    return (part(1), part(2), False) if (side != side[0]).any() else None


def met_before(ids: np.ndarray, earlier: list):
    """For arrays of ids, which pairs also meet in an earlier unit: both have it in their ``earlier`` units."""
    kinds = {}
    kind = np.array([kinds.setdefault(tuple(sorted(e)), len(kinds)) for e in earlier], np.int64)
    names = sorted({u for k in kinds for u in k})
    has = np.zeros((len(kinds), len(names)), np.float32)
    for k, i in kinds.items():
        has[i, np.searchsorted(names, k)] = 1
    share = (has @ has.T) > 0
    order = np.argsort(ids)
    at = lambda x: kind[order[np.searchsorted(ids, x, sorter=order)]]
    return (lambda x, y: share[at(x), at(y)]) if share.any() else None


def shared_keys(keyed: DataFrame) -> DataFrame:
    """(id, hub): for each key of two sets or more, each of them and the smallest."""
    first = keyed.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub < last").select("key", "hub")
    return keyed.join(first, "key").select("id", "hub")


def hub_members(classes: DataFrame) -> DataFrame:
    """(id, hub, n): sets at the hubs where they may link: a hub is the smallest set with a prefix shingle.

    Two sets that link share least_shared shingles of their prefixes, and so a hub with that number over the
    number of either one's hubs; sets stay at hubs where they share so many, and hubs of one set go.
    Hot shingles are counted and joined with partial sums and split tasks; the others are dealt
    by shingle once, for both.
    """
    keys, hot = (classes.select("id", F.explode(c).alias("key")) for c in ("keys", "hot"))
    met = shared_keys(keys.repartition("key")).unionAll(shared_keys(hot)).groupBy("id", "hub").agg(F.count(F.lit(1)).alias("c"))
    members = cut(met.join(classes.select("id", "n"), "id"))
    for _ in range(2):
        hubs = F.count(F.lit(1)).over(Window.partitionBy("id"))
        strong = members.withColumn("hubs", hubs).where(F.col("c") * F.col("hubs") >= least_shared(F.col("n"))).drop("hubs")
        several = strong.groupBy("hub").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("hub")
        members = cut(strong.join(several, "hub", "left_semi"))
    return members.select("id", "hub", "n")


def deal_blocks(members: DataFrame) -> DataFrame:
    """(id, block, side, earlier): the sets that blocks join, of (id, hub, n).

    Whole hubs are dealt to units of about BLOCK_SHINGLES, each a block; a larger hub is a unit
    of its own and divided into chunks, and every pair of its chunks is a block with two sides
    (1, 2).  Blocks of whole hubs and single chunks are side 0, joined with itself.
    ``earlier`` are a set's units below this one: a pair counts in the first unit that both have.
    """
    size = cut(members.groupBy("hub").agg(F.sum("n").alias("total")))
    small = size.where(F.col("total") <= BLOCK_SHINGLES).agg(F.sum("total")).first()[0] or 0
    blocks = max(fan_out(members), -(-small // BLOCK_SHINGLES))
    chunks = F.when(F.col("total") > BLOCK_SHINGLES, F.ceil(2 * F.col("total") / BLOCK_SHINGLES)).otherwise(F.lit(1))
    unit = F.when(F.col("total") > BLOCK_SHINGLES, F.col("hub")).otherwise(-1 - F.pmod(F.xxhash64("hub"), F.lit(blocks)))
    placed = members.join(size, "hub").select("id", unit.alias("unit"), chunks.alias("k")).distinct()
    units = placed.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("unit", "k"))).alias("units"))
    each = units.select("id", "units", F.explode("units").alias("u")).select("id", "u.unit", "u.k", F.filter(F.col("units.unit"), lambda x: x < F.col("u.unit")).alias("earlier"))
    each = each.withColumn("c", F.pmod(F.xxhash64("id"), F.col("k")))
    pairs = each.withColumn("d", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    name = F.concat_ws("-", "unit", F.least("c", "d"), F.greatest("c", "d"))
    side = F.when(F.col("c") == F.col("d"), 0).when(F.col("c") < F.col("d"), 1).otherwise(2)
    return pairs.select("id", name.alias("block"), side.alias("side"), "earlier")


BLOCK_COUNTS, BLOCK_LINKS = "id long, first long, n long", "a long, b long"


def numbered_classes(sets: DataFrame) -> DataFrame:
    """(id, n, h1, h2, first, keys, hot): the classes of equal sets under numbers of their own, each with its smallest document."""
    classes = sets.groupBy("n", "h1", "h2").agg(F.min("id").alias("first"), F.first("keys").alias("keys"), F.first("hot").alias("hot"))
    return cut(classes.withColumn("id", F.monotonically_increasing_id()))


def in_blocks(named: DataFrame, classes: DataFrame, run, schema: str) -> DataFrame:
    """``run`` on the sets of every block: each set travels once to each of its blocks, by class and side."""
    placed = cut(deal_blocks(hub_members(classes)).join(classes.select("id", "first", "h1", "h2"), "id"))
    tokens = token_sets(named.join(placed.select(F.col("first").alias("id")).distinct(), "id", "left_semi"))
    return cut(placed.join(tokens, ["first", "h1", "h2"]).select("block", "side", "id", "earlier", "tokens").groupBy("block").applyInArrow(run, schema))


def trees_of(table) -> tuple | None:
    """The two trees of a block, whether they are one, and which pairs are another block's; None without pairs."""
    ids = table.column("id").to_numpy()
    trees = block_trees(table.column("side").to_numpy(), ids, table.column("tokens").to_pylist())
    return trees and (*trees, met_before(ids, table.column("earlier").to_pylist()))


def named_sets(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, text) of ``docs``, their signatures, and those of rows that can link."""
    named = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = cut(signatures(named))
    return named, signed, signed.where("n > 0 and id is not null")


def class_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a, b): every link between two classes of equal sets, once, each class as its class_id in
    ``count_document_links``.  The rows grow with the square of a group of near copies; where only
    groups or numbers of links are asked for, ``count_document_links`` has them in a row per document."""
    named, _, sets = named_sets(docs, id_col, text_col)
    classes = numbered_classes(sets)

    def run(table):
        trees, found = trees_of(table), [(np.empty(0, np.int64), np.empty(0, np.int64))]
        if trees:
            found += [(trees[0].ids[i], trees[1].ids[j]) for i, j in tree_links(*trees)]
        return pa.table({k: np.concatenate(v) for k, v in zip("ab", zip(*found))})

    links = in_blocks(named, classes, run, BLOCK_LINKS)
    for end in "ab":
        links = links.join(classes.select(F.col("id").alias(end), F.col("first").alias(f"first_{end}")), end)
    return links.select(F.least("first_a", "first_b").alias("a"), F.greatest("first_a", "first_b").alias("b"))


def count_document_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col``, n_shingles, component_id, the smallest id
    reachable by links (its own, where there are none), class_id, the smallest id with an equal
    set, and n_links, the number of other classes that the row's set links with.

    Words are lower-cased A-Z and cut at ASCII white space; a document's set are its distinct
    five-word shingles.  Null and empty texts, and those without words, have no shingles and
    link with nothing.  Rows with a null id take no part and have a null component, class and
    number.  Rows with one id are one document in components, linked through its id; class and number are
    those of the row's own text.

    Equal sets are one class.  Classes that share one of their rarest shingles meet at the hub of
    that shingle, the smallest class that has it (see ``prefix``: no link is lost); hubs share
    blocks, which join their sets exactly with signature trees.  No closure of candidates is formed.
    Every link is tested and counted in one block; a block gives each class its number of links
    and the smallest class of its group, so the rows grow with the classes, not with the links.
    """
    named, signed, sets = named_sets(docs, id_col, text_col)
    classes = numbered_classes(sets)

    def run(table):
        trees = trees_of(table)
        columns = count_links(*trees) if trees else [np.empty(0, np.int64)] * 3
        linked = columns[2] > 0
        return pa.table({k: c[linked] for k, c in zip(("id", "first", "n"), columns)})

    counted = in_blocks(named, classes, run, BLOCK_COUNTS)
    links = counted.where("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b"))
    own = cut(sets.select(F.col("id").alias("doc"), "n", "h1", "h2").distinct().join(classes.drop("keys", "hot"), ["n", "h1", "h2"]).select("doc", "id", "first"))
    shared = own.groupBy("doc").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("doc", "low")
    links = links.union(own.join(shared, "doc").where("id <> low").select("id", "low"))
    found = components(links).join(classes.select("id", "first"), "id")
    name = found.groupBy("component").agg(F.min("first").alias("name"))
    groups = found.join(name, "component").select("id", "name")
    component = own.join(groups, "id", "left").groupBy("doc").agg(F.min(F.coalesce("name", "first")).alias("component"))
    numbers = counted.groupBy("id").agg(F.sum("n").alias("links"))
    each = classes.join(numbers, "id", "left").select("n", "h1", "h2", F.col("first").alias("class"), F.coalesce("links", F.lit(0)).alias("links"))
    there = F.col("id").isNotNull()
    out = signed.select("id", "n", "h1", "h2").join(component.withColumnRenamed("doc", "id"), "id", "left").join(each, ["n", "h1", "h2"], "left")
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(there, F.coalesce("component", "id")).alias("component_id"),
        F.when(there, F.coalesce("class", "id")).alias("class_id"), F.when(there, F.coalesce("links", F.lit(0))).alias("n_links"),
    )


def link_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The first three columns of ``count_document_links``."""
    return count_document_links(docs, id_col, text_col).drop("class_id", "n_links")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(documents(spark, sf_dir))


def op1_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1_jaccard_join with each document's class and number of links, which that query's SQL has not."""
    return count_document_links(documents(spark, sf_dir))


OP1_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (
  SELECT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
                             WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id WHERE r.c < e.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT id, min(c) AS c FROM r GROUP BY id) m ON m.id = d.doc_id
"""
