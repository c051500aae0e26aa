"""Quality rules: hashed n-gram log-likelihood ratio of trusted and raw text."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, WordHasher, cut, documents, fan_out, slices, window_hashes

#: Buckets of the hashed byte n-grams, and the n-gram's length.
BUCKETS = 1 << 15
GRAM = 4
#: Pieces of the counts that tasks send.
CHUNKS = 16
#: One labelled id in HELD tells the threshold, the others the trusted target.
HELD = 4
#: Bits of the filter of trusted ids: so many an id, and at most.  More ids let more texts through to the join.
ID_BITS, MOST_BITS = 16, 1 << 28
SYMBOLS = "#*$%&|<>"
REPEAT_WINDOW = 8
#: Share of trusted labelled rows that the threshold may reject at most.
TRUSTED_LOSS = 0.005
#: Error shares by which a cut may be worse than the best one for a wider gap.
SLACK = 0.02


def grams(text: str) -> np.ndarray:
    """Bucket of each byte n-gram of the whole text (shorter texts: padded with spaces)."""
    b = np.frombuffer(text.encode("utf-8", "replace").ljust(GRAM), np.uint8).astype(np.uint32)
    n = len(b) - GRAM + 1
    code = b[:n].copy()
    for k in range(1, GRAM):
        code = (code << np.uint32(8)) | b[k : k + n]
    return (code * np.uint32(0x9E3779B1)) >> np.uint32(33 - BUCKETS.bit_length())


def repeated_words(words: np.ndarray, width: int = REPEAT_WINDOW) -> int:
    """Words covered by windows of ``width`` words found twice or more in the text."""
    h = window_hashes(words, width)
    if len(h) < 2:
        return 0
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def base_counts(text: str, hasher: WordHasher) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode("utf-8", "replace").split()
    chars = len(text) - sum(text.count(c) for c in SPACE)
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    repeats = repeated_words(hasher.of(words)) if len(words) > REPEAT_WINDOW else 0
    return len(words), chars, sum(text.count(c) for c in SYMBOLS), len(lines) - len(set(lines)), repeats


def gram_counts(texts: DataFrame) -> list[tuple[int, int]]:
    """(bucket, n): n-gram counts of all texts (text); a task sends CHUNKS rows at most."""
    own = BUCKETS // CHUNKS

    def count(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in slices(batch):
                for text in part.column(0).to_pylist():
                    if text:
                        total += np.bincount(grams(text), minlength=BUCKETS)
        some = np.flatnonzero(total.reshape(CHUNKS, own).any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([total[c * own : (c + 1) * own].tobytes() for c in some], pa.binary())], names=["chunk", "counts"])

    def add(table):
        total = sum(np.frombuffer(c, np.int64) for c in table.column("counts").to_pylist())
        return pa.table({"chunk": table.column("chunk").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

    each = texts.mapInArrow(count, kinds := "chunk int, counts binary").groupBy("chunk").applyInArrow(add, kinds)
    return [(r.chunk * own + k, int(n)) for r in each.collect() for k, n in enumerate(np.frombuffer(r.counts, np.int64)) if n]


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(text) of the rows of (doc_id, text) whose id is in ``ids`` (__id, distinct).

    A bitmap of hashed ids keeps most other texts out of the join's shuffle; the join decides.
    """
    n = ids.count()
    bits = min(MOST_BITS, 1 << max(15, math.ceil(math.log2(max(1, n * ID_BITS)))))
    place = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(bits))
    words = ids.select(place("__id").alias("p")).groupBy(F.shiftright("p", 15).alias("w")).agg(F.bitmap_construct_agg(F.col("p").bitwiseAND(F.lit((1 << 15) - 1))).alias("b"))
    bitmap = np.zeros(bits >> 3, np.uint8)
    for w, b in words.collect():
        bitmap[w << 12 : w + 1 << 12] = np.frombuffer(b, np.uint8)

    def pick(batches):
        for batch in batches:
            at = batch.column(2).to_numpy()
            yield batch.select([0, 1]).filter(pa.array((bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))

    near = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", place("doc_id").alias("place")).mapInArrow(pick, "doc_id long, text string")
    return near.join(ids.hint("shuffle_hash"), F.col("doc_id") == F.col("__id")).select("text")


def log_ratio(raw_counts: list[tuple[int, int]], target_counts: list[tuple[int, int]]) -> np.ndarray:
    """ln P(bucket | trusted) - ln P(bucket | raw), both smoothed by one raw share of
    1 in BUCKETS; zeros where there is no trusted text."""
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for into, counts in ((raw, raw_counts), (target, target_counts)):
        for b, n in counts:
            into[b] = n
    if not target.sum():
        return np.zeros(BUCKETS)
    smooth = lambda c: np.log((c + 1.0) / (c.sum() + BUCKETS))
    return smooth(target) - smooth(raw)


def scores(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """doc_id, base counts and the mean log ratio a byte n-gram, of (doc_id, text)."""
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr"]

    def score(batches):
        hasher = WordHasher()
        for batch in batches:
            for part in slices(batch):
                texts = [t or "" for t in part.column(1).to_pylist()]
                base = [base_counts(t, hasher) for t in texts]
                llr = [float(ratio[grams(t)].mean()) if t else 0.0 for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, pa.int64()) for c in zip(*base)], pa.array(llr, pa.float64())], names=names)

    kinds = " long, ".join(names[:-1]) + " long, llr double"
    return docs.mapInArrow(score, kinds)


def threshold(good: list[float], bad: list[float]) -> float:
    """The score below which documents go: the middle of the widest gap between labelled scores
    among the cuts that separate them nearly best (sum of both error shares within SLACK of the
    least) and reject no more than TRUSTED_LOSS of the trusted rows.  Without labels of
    both kinds nothing goes."""
    if not good or not bad:
        return float("-inf")
    g, b = np.sort(good), np.sort(bad)
    cuts = np.unique(np.r_[g, b])
    lost = np.searchsorted(g, cuts, side="left") / len(g)
    left = 1 - np.searchsorted(b, cuts, side="left") / len(b)
    error = np.where(lost <= TRUSTED_LOSS, lost + left, np.inf)
    gap = np.where(error <= error.min() + SLACK, np.diff(cuts, prepend=cuts[0]), -1.0)
    k = int(gap.argmax())
    return float(cuts[k] - max(gap[k], 0.0) / 2)


def labelled_threshold(known: DataFrame) -> float:
    """``threshold`` of (llr, good, bad) with flags, found over ranges of the scores: a task holds no whole
    column and the driver one row a range."""
    counts = known.where("good or bad").groupBy("llr").agg(F.sum(F.col("good").cast("long")).alias("g"), F.sum(F.col("bad").cast("long")).alias("b"))
    ranged = cut(counts.repartitionByRange(fan_out(known), "llr").withColumn("part", F.spark_partition_id()))
    all_good, all_bad = ranged.agg(F.sum("g"), F.sum("b")).first()
    if not all_good or not all_bad:
        return float("-inf")
    parts = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy("part").agg(F.sum("g").alias("g"), F.sum("b").alias("b"), F.max("llr").alias("high"))
    before = before.select("part", *[F.coalesce(F.sum(c).over(parts), F.lit(0)).alias(f"{c}0") for c in "gb"], F.max("high").over(parts).alias("high0"))
    inside = Window.partitionBy("part").orderBy("llr")
    upto = inside.rowsBetween(Window.unboundedPreceding, -1)
    below = lambda c: F.coalesce(F.sum(c).over(upto), F.lit(0)) + F.col(f"{c}0")
    gap = F.col("llr") - F.coalesce(F.lag("llr").over(inside), F.col("high0"), F.col("llr"))
    cuts = ranged.join(F.broadcast(before), "part").select("llr", gap.alias("gap"), (below("g") / F.lit(float(all_good))).alias("lost"), (F.lit(1.0) - below("b") / F.lit(float(all_bad))).alias("left"))
    cuts = cut(cuts.where(F.col("lost") <= TRUSTED_LOSS).withColumn("error", F.col("lost") + F.col("left")))
    least = cuts.agg(F.min("error")).first()[0]
    at, wide = cuts.where(F.col("error") <= least + SLACK).agg(F.max_by(F.struct("llr", "gap"), F.struct(F.col("gap"), -F.col("llr")))).first()[0]
    return at - wide / 2


def rate_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, llr and kept for each row of ``docs``.

    ``labels`` (doc_id, quality, toxic) names trusted rows (quality 1, not toxic) and
    poor ones (quality 0); all of its ids count.  The threshold is fitted on ids that the trusted
    counts have not seen.  Raw counts are over all documents.  Null texts have no words.  Rows with equal
    ids are rated each (the threshold sees the worst of them); a null id is never labelled.
    """
    ids = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    ids = cut(ids.select(F.col("doc_id").alias("__id"), (F.col("quality") == 1).alias("good"), ((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).alias("trusted"), (F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(HELD)) == 0).alias("held")))
    docs = docs.select("doc_id", "text")
    ratio = log_ratio(gram_counts(docs.select("text")), gram_counts(texts_of(docs, ids.where("trusted and not held").select("__id"))))
    rated = cut(scores(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ratio))
    rated = rated.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    known = rated.where(~F.col("base_failed")).join(ids.where("held"), F.col("doc_id") == F.col("__id"))
    known = known.groupBy("__id").agg(F.min("llr").alias("llr"), F.first("trusted").alias("trusted"), F.first("good").alias("good"))
    limit = labelled_threshold(known.select("llr", F.coalesce("trusted", F.lit(False)).alias("good"), F.coalesce(~F.col("good"), F.lit(False)).alias("bad")))
    return rated.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= F.lit(limit)))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rate_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
