"""Packing, sharding and mixing against plain versions and their own laws."""

import random
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from orrery.llm import mixing, packing, sharding
from orrery.llm.common import cut, gapless_rank

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "a", "a", "\n\n x", "wörd 日本   end ", "<|endoftext|>", "don't  stop\t now", "x " * 3000, "z" * 5000]


def docs(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or ["s"] * len(texts))[i], 7, 3) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, shard int, size int")


def test_encoder_equals_the_tokenizer():
    encode = packing.Encoder(TOKENIZER)
    r = random.Random(3)
    signs = [*"ab .,'\n\n\t  é1_-!　 日\x1c\x85\x00", "'s", "'ll", " the", "<|endoftext|>"]
    for _ in range(3000):
        text = "".join(r.choice(signs) for _ in range(r.randint(0, 25)))
        assert encode([text]) == encode.whole([text]), repr(text)


def test_piece_bounds():
    assert packing.piece_bounds(5, 4) == [(0, 1), (1, 5)]
    assert packing.piece_bounds(8, 4) == [(0, 4), (4, 8)]
    assert packing.piece_bounds(1, 4) == [(0, 1)]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), max_size=6), st.integers(1, 40))
def test_fullest_is_the_fullest(counts, room):
    got = packing.fullest(counts, room)
    items = [x for x, n in counts.items() for _ in range(n)]
    sums = {0}
    for x in items:
        sums |= {s + x for s in sums if s + x <= room}
    assert sum(got) == max(sums)
    assert all(got.count(x) <= counts[x] for x in got)


def test_minimum_bin_slack_uses_every_length_once():
    r = random.Random(1)
    histogram = {r.randint(1, 1024): r.randint(1, 50) for _ in range(200)}
    plan = packing.minimum_bin_slack(histogram)
    used = {}
    for lengths, times in plan:
        assert sum(lengths) <= 1024
        for x in lengths:
            used[x] = used.get(x, 0) + times
    assert used == histogram
    total = sum(k * v for k, v in histogram.items())
    assert sum(t for _, t in plan) <= -(-total // 1024) * 1.03


def test_pack_documents(spark):
    texts = ODD * 3
    rows = packing.pack_documents(docs(spark, texts), TOKENIZER).collect()
    encode = packing.Encoder(TOKENIZER)
    tokens = {i: np.frombuffer(encode.whole([t or ""])[0], "<u4").tolist() + [2] for i, t in enumerate(texts)}
    seen = {}
    for r in rows:
        own = tokens[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(np.array(own, "<u4").tobytes()) == r.ids_crc32
        seen.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seen.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert sum(r.length for r in rows) == sum(map(len, tokens.values()))


def test_pack_repeated_and_null_ids(spark):
    rows = [(None, "some words"), (5, "some words"), (5, "other words here"), (5, None)] * 40
    df = cut(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))
    got = packing.pack_documents(df, TOKENIZER).collect()
    assert len(got) == 160 and sum(r.doc_id is None for r in got) == 40 and {r.piece for r in got} == {0}
    places = sorted((r.sequence_id, r.offset, r.length) for r in got)
    assert all(a[0] != b[0] or a[1] + a[2] == b[1] for a, b in zip(places, places[1:])) and len(set(p[:2] for p in places)) == 160
    ranked = gapless_rank(df.withColumn("k", F.lit(1)), ["k"], ["doc_id", "text"], "r").withColumn("p", F.spark_partition_id()).collect()
    assert sorted(r.r for r in ranked) == list(range(160))


def test_pack_empty_table(spark):
    assert packing.pack_documents(docs(spark, ["x"]).limit(0), TOKENIZER).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=60), st.integers(50, 80))
def test_best_fit_decreasing_equals_one_by_one(sizes, capacity):
    classes = [(s, sizes.count(s)) for s in set(sizes)]
    runs, bins = sharding.best_fit_decreasing(classes, capacity)
    room = []
    for s in sorted(sizes, reverse=True):
        fit = [(r, i) for i, r in enumerate(room) if r >= s]
        if fit:
            room[min(fit)[1]] -= s
        else:
            room.append(capacity - s)
    assert bins == len(room)
    left = [capacity] * bins
    for s, _, n, b in runs:
        left[b] -= s * n
    assert sorted(left) == sorted(room)


def test_fit_tree_is_an_ordered_set():
    r = random.Random(2)
    tree, own = sharding.FitTree(), set()
    for _ in range(2000):
        key = (r.randint(0, 60), r.randint(0, 20))
        if key in own and r.random() < 0.7:
            tree.remove(key)
            own.discard(key)
        elif key not in own:
            tree.add(key)
            own.add(key)
        size = r.randint(0, 70)
        assert tree.tightest(size) == min((k for k in own if k[0] >= size), default=None)


def test_shards_keep_groups_and_sizes(spark):
    r = random.Random(4)
    texts = ["".join(r.choice("abc") for _ in range(r.randint(0, 200))) for _ in range(600)] + [None, "", None] + ["same text"] * 90 + ["y" * 3000]
    r.shuffle(texts)
    rows = sharding.shard_documents(docs(spark, texts), shards=8).collect()
    assert len(rows) == len(texts) and {r.law for r in rows} == {"bytes"}
    assert len({r.shard for r in rows if texts[r.doc_id] == "same text"}) == 1
    by = {}
    for row in rows:
        assert row.size == len((texts[row.doc_id] or "").encode()) + 16
        assert row.text_crc32 == zlib.crc32((texts[row.doc_id] or "").encode())
        by.setdefault(row.shard, []).append(row)
    assert all(sorted(x.slot for x in v) == list(range(len(v))) for v in by.values())
    total = [sum(x.size for x in v) for v in by.values()]
    assert max(total) <= 1.05 * sum(total) / 8


def test_a_group_above_a_shard_stays_whole(spark):
    texts = ["same text"] * 300 + [f"other {i:03}" for i in range(210)] + ["big " * 9] * 40
    rows = sharding.shard_documents(docs(spark, texts), shards=8).collect()
    size, held = {}, {}
    for r in rows:
        size[r.shard] = size.get(r.shard, 0) + r.size
        held.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert len(rows) == len(texts) and all(len(v) == 1 for v in held.values())
    small = [n for s, n in size.items() if s not in held["same text"] | held["big " * 9]]
    assert len(small) == 6 and max(small) <= 1.05 * sum(small) / 6 and size[min(held["same text"])] == 300 * 25


def test_shards_with_null_and_repeated_ids(spark):
    rows = [(None, "a"), (None, "a"), (5, "b"), (5, "b"), (5, "c"), (None, None)] * 30
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), shards=3).collect()
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert len(got) == 180 and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert len({(r.text_crc32, r.shard) for r in got}) == 4


def test_shard_empty_table(spark):
    assert sharding.shard_documents(docs(spark, ["x"]).limit(0)).count() == 0


def test_word_targets():
    got = mixing.word_targets({"a": 10, "b": 100, None: 100, "c": 0})
    assert got["a"] == 30 and got["c"] == 0
    assert got["b"] + got[None] == 180 and got["b"] == Fraction(180) * 2 / 7
    assert mixing.word_targets({}) == {}


def test_flight_keeps_sums_and_leaves_two():
    r = np.random.default_rng(0)
    size, p = r.integers(0, 500, 400), np.full(400, 0.37)
    out = mixing.flight(size, p, r.random)
    assert (((out > 0) & (out < 1)).sum()) <= 2
    assert out.sum() == pytest.approx(p.sum()) and (out * size).sum() == pytest.approx((p * size).sum())


def test_inclusion_is_fair():
    size = np.array([1, 5, 9, 14, 30, 2])
    got = np.mean([mixing.landing(size, mixing.flight(size, np.full(6, 0.5), np.random.default_rng(i).random)) for i in range(600)], axis=0)
    assert np.abs(got - 0.5).max() < 0.2


def test_mix_meets_targets_and_reruns_agree(spark):
    r = random.Random(5)
    texts = [" ".join(["w"] * r.randint(0, 60)) for _ in range(3000)] + [None, "", "\x0b\x0c"]
    sources = [r.choice(["a", "a", "a", "b", "c", None]) for _ in texts]
    df = docs(spark, texts, sources)
    rows = mixing.mix_sources(df).collect()
    assert len(rows) == len(texts)
    taken, target = {}, {}
    for x in rows:
        assert x.size == len((texts[x.doc_id] or "").split()) and 0 <= x.taken <= 3 * x.size
        taken[x.source] = taken.get(x.source, 0) + x.taken
        target[x.source] = x.target
    assert all(abs(taken[s] - target[s]) <= 120 for s in target)
    again = {x.doc_id: x.taken for x in mixing.mix_sources(df.repartition(7)).collect()}
    assert again == {x.doc_id: x.taken for x in rows}
    assert mixing.mix_sources(df.limit(0)).count() == 0


def test_equal_rows_are_dealt_to_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 64)
    rows = [(None, "w " * 7, "a")] * 2000 + [(i, "w " * 9, "b") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    counted = df.groupBy("doc_id").count().where("doc_id is null").select(F.col("doc_id").alias("id"), F.lit(0).alias("s"), F.lit(7).cast("long").alias("size"), F.lit(0.5).alias("p"), F.col("count").alias("n"))
    units = mixing.each_copy(counted)
    assert sorted(r["copy"] for r in units.collect()) == list(range(2000))
    sizes = units.groupBy(F.pmod(F.xxhash64("id", "size", "copy", F.lit(0)), F.lit(32))).count().collect()
    assert len(sizes) == 32 and max(r["count"] for r in sizes) < 130
    got = mixing.mix_sources(df).collect()
    again = mixing.mix_sources(df.repartition(5)).collect()
    key = lambda r: (r.doc_id or -1, r.size, r.taken)
    assert len(got) == 2500 and sorted(map(key, got)) == sorted(map(key, again))
    for s in "ab":
        assert abs(sum(r.taken for r in got if r.source == s) - next(r.target for r in got if r.source == s)) <= 9
