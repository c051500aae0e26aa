"""Substring dedup: windows of words, counted exactly in super-k-mer partitions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, documents, fan_out, mix64, slices, window_hashes

WINDOW = 13
#: Words of the m-mers among which a window's minimiser is chosen.
MMER = 3
#: Bytes of text that a map task works on at once, and bytes of runs meant for a partition.
BLOCK_BYTES = 6 << 20
PART_BYTES = 16 << 20
#: Hashed counters of minimisers, which tell the frequent ones.
COUNTERS = 1 << 16
#: Packed bytes a byte of text: a run of windows shares its words.
BLOW_UP = 3.0


def cut_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(data, ends, counts): the words of all texts as bytes, each with a space behind; where each
    ends, its space included; and how many each text has."""
    raw = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    space = SPACES[raw]
    behind = space.copy()
    behind[1:] &= ~space[:-1]
    behind[:1] = False
    keep = ~space | behind
    data = raw[keep]
    ends = np.flatnonzero(behind[keep]) + 1
    data[ends - 1] = 32
    upto = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return data, ends, np.diff(np.searchsorted(np.flatnonzero(behind), upto), prepend=0)


def word_ids(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exact dense number of each word of ``cut_words``, and the distinct words as (data, ends)."""
    offsets = np.r_[0, ends].astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
    coded = words.dictionary_encode()
    _, at, held = coded.dictionary.buffers()
    n = len(coded.dictionary)
    bounds = np.frombuffer(at, np.int64, n + 1) if n else np.zeros(1, np.int64)
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.frombuffer(held or b"", np.uint8)[: bounds[-1]], bounds[1:]


def word_hashes(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each of the words (data, ends); words that share one also share their minimisers, no more."""
    begin = np.r_[0, ends[:-1]].astype(np.int64)
    place = (np.arange(len(data)) - np.repeat(begin, ends - begin)) % len(PLACES)
    return mix64(np.add.reduceat((data.astype(U64) + U64(1)) * PLACES[place], begin)) if len(ends) else np.zeros(0, U64)


def equal_windows(ids: np.ndarray, starts: np.ndarray, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(order, group): positions in ``starts`` sorted by their window's words, and the
    number of each sorted window's group of equal windows.  Order within a group is that of ``starts``.

    Windows are sorted by a hash of their word numbers; neighbours of equal hash are then
    compared word by word, and a hash shared by different windows is sorted by the words.
    """
    h = window_hashes(mix64(ids.astype(U64) + U64(1)), width)[starts]
    order = np.argsort(h, kind="stable")
    new = np.ones(len(h), bool)
    new[1:] = h[order][1:] != h[order][:-1]
    twin = np.flatnonzero(~new)
    a, b = starts[order[twin]], starts[order[twin - 1]]
    same = np.ones(len(twin), bool)
    for k in range(width):
        same &= ids[a + k] == ids[b + k]
    if not same.all():
        group = np.cumsum(new) - 1
        for g in np.unique(group[twin[~same]]):
            own = np.flatnonzero(group == g)
            rows = ids[starts[order[own]][:, None] + np.arange(width)]
            _, kind = np.unique(rows, axis=0, return_inverse=True)
            by = np.argsort(kind.ravel(), kind="stable")
            order[own] = order[own][by]
            new[own[1:]] = np.diff(kind.ravel()[by]) != 0
    return order, np.cumsum(new) - 1


def later_copies(ids: np.ndarray, starts: np.ndarray, docs: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """For each window, whether a smaller document holds the same words."""
    if not len(starts):
        return np.zeros(0, bool)
    order, group = equal_windows(ids, starts, width)
    first = np.minimum.reduceat(docs[order], np.flatnonzero(np.r_[True, np.diff(group) > 0]))
    out = np.zeros(len(starts), bool)
    out[order] = docs[order] > first[group]
    return out


def starts_of(counts: np.ndarray, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which a window fits into texts of so many words, one after the other, and each one's text."""
    ends = np.cumsum(counts)
    text = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(text))
    fits = at + width <= ends[text] if len(text) else np.zeros(0, bool)
    return at[fits], text[fits]


def runs(doc: np.ndarray, key: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc, key, first, count) of the runs of consecutive positions of a document and key."""
    order = np.lexsort((start, key, doc))
    doc, key, start = doc[order], key[order], start[order]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]) | (start[1:] != start[:-1] + 1)]
    at = np.flatnonzero(new)
    return doc[at], key[at], start[at], np.diff(np.r_[at, len(start)])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
PLACES = mix64(np.arange(1, 1025, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
FOUND = pa.schema([("part", pa.int32()), ("packed", pa.binary()), ("places", pa.binary())])


def pack_places(doc: np.ndarray, key: np.ndarray, first: np.ndarray, count: np.ndarray) -> bytes:
    """Columns of places as bytes; documents by their differences, which compress."""
    parts = np.diff(doc, prepend=np.int64(0)), key, first.astype(np.int32), count.astype(np.int32)
    return b"".join(x.tobytes() for x in parts)


def unpack_places(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = len(blob) // 24
    long, short = np.frombuffer(blob, np.int64, 2 * n), np.frombuffer(blob, np.int32, offset=16 * n).astype(np.int64)
    return np.cumsum(long[:n]), long[n:], short[:n], short[n:]


def minimisers(data: np.ndarray, ends: np.ndarray, width: int, mmer: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, first, second): numbers of the words, and at each place the least hash of the m-mers of the
    window that begins there, in two orders of m-mers."""
    ids, *distinct = word_ids(data, ends)
    m = window_hashes(word_hashes(*distinct)[ids], mmer, seed=99)
    span = width - mmer + 1
    return ids, *(sliding_min(x, span) if len(m) >= span else np.zeros(0, U64) for x in (m, mix64(m + U64(1))))


def blocks_of(batches, width: int):
    """Lists of (id, key, text) of about BLOCK_BYTES, without texts too short for a window."""
    rows, size = [], 0
    for batch in batches:
        for part in slices(batch):
            for doc, key, text in zip(*[c.to_pylist() for c in part.columns]):
                if len(text) >= 2 * width - 1:
                    rows.append((doc, key, text))
                    size += len(text)
                if size >= BLOCK_BYTES:
                    yield rows
                    rows, size = [], 0
    if rows:
        yield rows


def divisions(docs: DataFrame, parts: int, width: int, mmer: int) -> np.ndarray:
    """Into how many a minimiser's windows are divided, for each counter: 1 unless it has more windows
    than a partition is meant for (or, with more partitions than counters, than four even counters)."""

    def count(batches):
        held = np.zeros(COUNTERS, np.int64)
        for rows in blocks_of(batches, width):
            data, ends, counts = cut_words([r[2] for r in rows])
            first = minimisers(data, ends, width, mmer)[1]
            held += np.bincount((first[starts_of(counts, width)[0]] % U64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], names=["counter", "n"])

    held = np.zeros(COUNTERS, np.int64)
    for r in docs.mapInArrow(count, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).collect():
        held[r.counter] = r.n
    meant = max(1.0, held.sum() / parts, 4 * held.sum() / COUNTERS)
    return np.ceil(np.maximum(held, 1) / meant).astype(np.int64)


class Splitter:
    """Cuts blocks of documents into super-k-mers by partition."""

    def __init__(self, parts: int, width: int, mmer: int, ways: np.ndarray) -> None:
        self.parts, self.width, self.mmer, self.ways = parts, width, mmer, ways.astype(U64)
        self.zip = zstandard.ZstdCompressor(level=6)

    def __call__(self, rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        """A row per partition for a block of (id, key, text).

        A window that a smaller document of the block also holds is a copy already: only
        its place is passed on (packed is null).  The others are sent, as the words of
        the runs of consecutive windows that share a minimiser; so a passage that
        most documents hold is sent once a block.  Windows of a frequent minimiser are
        divided by another, so runs of theirs share both.
        """
        width = self.width
        rows.sort(key=lambda r: (r[0], r[1]))
        data, ends, counts = cut_words([r[2] for r in rows])
        begin = np.cumsum(counts) - counts
        doc, key = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
        ids, least, other = minimisers(data, ends, width, self.mmer)
        starts, text = starts_of(counts, width)
        copy = later_copies(ids, starts, doc[text], width)
        out = []
        if copy.any():
            t = text[copy]
            own = runs(doc[t], key[t], starts[copy] - begin[t])
            out.append((int(doc[0] % self.parts), None, self.zip.compress(pack_places(*own))))
        starts, text = starts[~copy], text[~copy]
        if len(starts):
            least = least[starts]
            least = mix64(least + mix64(other[starts] % self.ways[(least % U64(COUNTERS)).astype(np.int64)]))
            at = np.flatnonzero(np.r_[True, (starts[1:] != starts[:-1] + 1) | (text[1:] != text[:-1]) | (least[1:] != least[:-1])])
            n = np.diff(np.r_[at, len(starts)])
            first, text, part = starts[at], text[at], (least[at] % U64(self.parts)).astype(np.int64)
            blob = data.tobytes()
            order = np.argsort(part, kind="stable")
            first, text, part, n = first[order], text[order], part[order], n[order]
            lo, hi = np.r_[0, ends][first].tolist(), ends[first + n + width - 2].tolist()
            bounds = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]).tolist()
            for a, b in zip(bounds, bounds[1:]):
                packed = self.zip.compress(b"".join([blob[x:y] for x, y in zip(lo[a:b], hi[a:b])]))
                own = doc[text[a:b]], key[text[a:b]], first[a:b] - begin[text[a:b]], n[a:b]
                out.append((int(part[a]), packed, self.zip.compress(pack_places(*own))))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), FOUND)] if out else [pa.array([], f.type) for f in FOUND], schema=FOUND)


def split(docs: DataFrame, parts: int, width: int = WINDOW, mmer: int = MMER) -> DataFrame:
    """Super-k-mers of (id, key, text as bytes), packed by partition."""
    ways = divisions(docs, parts, width, mmer)

    def run(batches):
        splitter = Splitter(parts, width, mmer, ways)
        for rows in blocks_of(batches, width):
            yield splitter(rows)

    return docs.mapInArrow(run, "part int, packed binary, places binary")


def count_windows(table: pa.Table, width: int = WINDOW) -> pa.Table:
    """The copies among a partition's windows, as runs (id, key, first, count)."""
    unzip = zstandard.ZstdDecompressor()

    def places(rows):
        each = [unpack_places(unzip.decompress(x)) for x in rows["places"].to_pylist()]
        return [np.concatenate(c) if each else np.zeros(0, np.int64) for c in zip(*each or [[[]] * 4])]

    sent = table.filter(table["packed"].is_valid())
    out = [[c] for c in places(table.filter(table["packed"].is_null()))]
    if sent.num_rows:
        doc, key, first, n = places(sent)
        data = np.frombuffer(b"".join([unzip.decompress(x) for x in sent["packed"].to_pylist()]), np.uint8)
        ids = word_ids(data, np.flatnonzero(data == 32) + 1)[0]
        starts, text = starts_of(n + width - 1, width)
        copy = later_copies(ids, starts, doc[text], width)
        if copy.any():
            place = first[text] + starts - (np.cumsum(n + width - 1) - (n + width - 1))[text]
            text, place = text[copy], place[copy]
            for c, x in zip(out, runs(doc[text], key[text], place)):
                c.append(x)
    columns = [np.concatenate(c) for c in out]
    return pa.table({k: pa.array(c, pa.int64()) for k, c in zip(("id", "key", "first", "count"), columns)})


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW, mmer: int = MMER, parts: int | None = None) -> DataFrame:
    """Remove every word covered by a window of ``width`` words that a document with a
    smaller id holds as well; windows are those of the input.

    Returns ``id_col``, n_words, n_removed and the kept words joined by one space, one row
    per row of ``docs``.  Words are cut at ASCII white space.  Null and empty texts have none.
    Rows with a null id keep all words and count for none.  Rows with one id are
    one document: they don't remove each other's words.

    One partition is meant to hold PART_BYTES of runs, so their number follows the input.  A
    minimiser has ``mmer`` words; the windows around a frequent one are dealt to partitions by a
    second minimiser, so equal windows still meet.  Copies that a block of a map task
    knows are not sent at all.
    """

    def count(table):
        return count_windows(table, width)

    text = F.coalesce(F.col(text_col), F.lit(""))
    ids = docs.select(F.col(id_col).cast("long").alias("id")).where("id is not null")
    repeated = ids.groupBy("id").count().where("count > 1").limit(1).count() > 0
    key = F.xxhash64(text) if repeated else F.lit(0).cast("long")  # tells rows of one id apart
    named = docs.select(F.col(id_col).cast("long").alias("id"), key.alias("key"), text.cast("binary").alias("text"))
    if parts is None:
        size = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = max(fan_out(docs), int(size * BLOW_UP / PART_BYTES) + 1)
    found = split(named.where(F.col("id").isNotNull()), parts, width, mmer).groupBy("part").applyInArrow(count, "id long, key long, first long, count long")
    marks = found.groupBy("id", "key").agg(F.collect_set(F.struct("first", "count")).alias("runs"))
    joined = named.join(marks, ["id", "key"], "left").select("id", "text", "runs.first", "runs.count")

    def apply(batches):
        for batch in batches:
            for part in slices(batch):
                out = []
                for doc, text, first, count in zip(*[c.to_pylist() for c in part.columns]):
                    words = text.split()
                    n = len(words)
                    if first:
                        edge = np.zeros(n + 1, np.int64)
                        np.add.at(edge, np.array(first), 1)
                        np.add.at(edge, np.array(first) + np.array(count) + width - 1, -1)
                        words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
                    out.append((doc, n, n - len(words), b" ".join(words)))
                names = ["id", "n_words", "n_removed", "kept"]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    kept = joined.mapInArrow(apply, "id long, n_words long, n_removed long, kept binary")
    return kept.select(F.col("id").alias(id_col), "n_words", "n_removed", F.col("kept").cast("string").alias("kept"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_copies(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13),
t AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS win FROM g),
m AS (SELECT win, min(doc_id) AS first_doc FROM t GROUP BY win),
c AS (SELECT DISTINCT t.doc_id, unnest(range(t.i, t.i + 13)) AS p FROM t JOIN m ON t.win = m.win WHERE m.first_doc < t.doc_id),
a AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
k AS (SELECT a.doc_id, count(*) AS n_words, count(c.p) AS n_removed, string_agg(a.word, ' ' ORDER BY a.p) FILTER (WHERE c.p IS NULL) AS kept
      FROM a LEFT JOIN c ON a.doc_id = c.doc_id AND a.p = c.p GROUP BY a.doc_id)
SELECT d.doc_id, coalesce(k.n_words, 0) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id
"""
