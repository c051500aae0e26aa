"""Nearest neighbours against brute force; the pipeline's stages."""

import random

import numpy as np
import public_tokenizers
import pytest
import tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from orrery.llm import hnsw, mixing
from orrery.llm.common import cut
from orrery.llm.registry import ORACLE_SQL, QUERIES


def test_recall_against_brute_force():
    r = np.random.default_rng(0)
    centre = r.normal(size=(20, 32))
    x = hnsw.unit(centre[r.integers(0, 20, 5000)] + 0.6 * r.normal(size=(5000, 32)))
    graph = hnsw.build(x, hnsw.node_levels(np.arange(5000)))
    q = x[::50]
    found = hnsw.search(x, graph, q)
    best = np.argsort(-(q @ x.T), axis=1)[:, :6]
    assert np.mean([len(set(a[:6]) & set(b)) / 6 for a, b in zip(found, best)]) > 0.95


def test_nearest_with_odd_vectors(spark):
    r = np.random.default_rng(1)
    rows = [(i, r.normal(size=4).tolist()) for i in range(300)]
    rows += [(400 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(60)] + [(500, [2.0, 4.0, 6.0, 8.0])]
    rows += [(600, None), (650, [0.0] * 4), (651, [float("nan"), 1.0, 1.0, 1.0]), (652, [None, 1.0, 1.0, 1.0]), (653, [float("inf"), 1.0, 1.0, 1.0]), (None, [1.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = hnsw.nearest(df, df.where("vec_id % 50 = 0")).collect()
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows[:361]]
    ids, x = np.array([i for i, _ in good]), np.array([v for _, v in good])
    for q in [i for i in ids if i % 50 == 0]:
        s = hnsw.cosine(np.repeat(x[ids == q], len(x), axis=0), x)
        order = [k for k in np.lexsort((ids, -s)) if ids[k] != q][:5]
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r.vec_id for r in own] == ids[order].tolist()
        assert [r.score for r in own] == s[order].tolist()
    assert {r.query_id for r in got} == {int(i) for i in ids if i % 50 == 0}


def true_nearest(ids, x, k=5):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i in np.flatnonzero(ids % 50 == 0):
        s = u @ u[i]
        s[i] = -np.inf
        out[int(ids[i])] = set(ids[np.lexsort((ids, -s))[:k]].tolist())
    return out


@pytest.mark.parametrize(("spread", "first", "rows"), [(0.05, 2, 100), (0.05, 4, 100), (3.0, 2, 100), (3.0, 2, 16384)])
def test_nearest_over_many_shards(spark, monkeypatch, spread, first, rows):
    """Near groups and spread ones; cells of several shards; queries that must visit further cells."""
    monkeypatch.setattr(hnsw, "SHARD_ROWS", rows)
    monkeypatch.setattr(hnsw, "CELLS", 7)
    monkeypatch.setattr(hnsw, "FIRST", first)
    monkeypatch.setattr(hnsw, "QUERY_ROWS", 9)
    r = np.random.default_rng(5)
    centre = r.normal(size=(12, 8))
    x = (centre[r.integers(0, 12, 1500)] + spread * r.normal(size=(1500, 8))).astype(np.float32)
    ids = r.permutation(1500)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<float>")
    got = hnsw.nearest(df, df.where("vec_id % 50 = 0")).collect()
    found = {}
    for row in got:
        found.setdefault(row.query_id, []).append((row["rank"], row.vec_id, row.score))
    want = true_nearest(ids, x.astype(float))
    assert set(found) == set(want) and all([a for a, *_ in sorted(v)] == [1, 2, 3, 4, 5] for v in found.values())
    assert np.mean([len({b for _, b, _ in found[q]} & want[q]) / 5 for q in want]) >= 0.98


def test_nearest_of_huge_and_tiny_components(spark):
    rows = [(0, [1e200, 2e200]), (1, [1e-200, 2.1e-200]), (2, [1e-310, 0.0]), (3, [3.0, 1.0]), (50, [1.0, 2.0]), (50, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = hnsw.nearest(df, df.where("vec_id = 0")).collect()
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"])][:3] in ([50, 50, 1], [50, 1, 3])
    assert all(0 < r.score <= 1.0000001 for r in got)


def test_nearest_of_empty_and_tiny_tables(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r["rank"], r.vec_id) for r in hnsw.nearest(df, df.where("vec_id = 0")).collect()] == [(0, 1, 1)]
    assert hnsw.nearest(df.limit(0), df.limit(0)).count() == 0


def test_registry_has_ten_operators():
    assert [k.split("_")[0] for k in QUERIES] == [f"op{n}" for n in range(1, 11)]
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_pipeline_stages(spark, tmp_path):
    line = "a shared line that many documents hold in full"
    text = lambda i: " ".join(f"the w{i}x{k} of and" for k in range(20))
    rows = [(i, f"{text(i // 2)} tail{i}\n{line}", "en", f"src{i % 3}", 0) for i in range(60)] + [(90, "12345 --", "en", "src0", 8), (91, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = df
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, None).write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
        if name != "packing":
            assert docs.columns == df.columns
    assert {r.doc_id for r in out["language_id"].collect()} == set(range(60))
    assert out["line_dedup"].where(F.col("text").contains(line)).count() == 1
    assert out["line_dedup"].where("n_chars <> char_length(text)").count() == 0
    assert sorted(r.doc_id for r in out["near_duplicates"].collect()) == list(range(0, 60, 2))
    packed = out["packing"].groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert packed.where("n > 1024").count() == 0


def test_pipeline_run_on_an_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_keeps_columns_of_clashing_names(spark):
    rows = [(i, f"the w{i} of and that one thing", "en", "s", 9, "own", 0.5, True) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, score double, times boolean")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, None)
        assert out.columns == df.columns, name
        assert {(r.lang_pred, r.score, r.times) for r in out.collect()} <= {("own", 0.5, True)}


def test_pipeline_keeps_rows_without_an_id_and_with_a_shared_one(spark):
    text = lambda i: " ".join(f"the w{i}x{k} of and" for k in range(20))
    ids = [None, None, None, 7, 7, 7, 8, 9]
    texts = [text(0), text(1), text(2), text(3), text(4), text(3), text(0), text(5)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in zip(ids, texts)], "doc_id long, text string, lang string, source string, n_chars long")
    once = cut(corpus_pipeline.near_duplicates(spark, df, None))
    got = sorted(((r.doc_id, r.text) for r in once.collect()), key=str)
    assert got == sorted([(8, text(0)), (None, text(1)), (None, text(2)), (7, text(3)), (7, text(4)), (9, text(5))], key=str)
    mixed = sorted(((r.doc_id, r.text) for r in corpus_pipeline.source_mix(spark, once, None).collect()), key=str)
    assert mixed == got


def test_pipeline_end_to_end_against_brute_force(spark, tmp_path):
    """Every stage's rows held to a plain computation on what the stage before kept, and run() to the stages."""
    from test_text_operators import brute_components, brute_lines, language_texts

    r = random.Random(12)
    texts, langs = language_texts(7, 160)
    texts = [f"{t} " + " ".join(f"w{i}x{k}" for k in range(30)) for i, t in enumerate(texts)]
    for i in range(0, 60, 3):
        words = texts[i].split(" ")
        words[r.randrange(len(words))] = "edited"
        texts.append(" ".join(words) if i % 2 else texts[i])
        langs.append(langs[i])
    for i in range(0, 160, 8):
        texts[i] += "\nA footer that many texts hold\n" + f"and a line of its own {i}"
    texts += ["12345 ...", "", None]
    langs += ["aa", "bb", None]
    rows = [(i, t, k, r.choice(["s1", "s2", None]), len(t or "")) for i, (t, k) in enumerate(zip(texts, langs))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.collect()
    told = {x.doc_id: x.text for x in kept["language_id"]}
    assert all(texts[i] == t for i, t in told.items()) and not {len(texts) - 3, len(texts) - 2, len(texts) - 1} & set(told) and len(told) > 0.9 * len(texts)
    ids = sorted(told)
    lines = {ids[i]: t for i, _, _, t in brute_lines([told[i] for i in ids])}
    assert {x.doc_id: x.text for x in kept["line_dedup"]} == lines and all(x.n_chars == len(x.text) for x in kept["line_dedup"])
    firsts = {c for _, _, c in brute_components([lines[i] for i in ids], ids)}
    once = {x.doc_id: x for x in kept["near_duplicates"]}
    assert set(once) == firsts and len(once) == len(kept["near_duplicates"]) < len(lines)
    words = lambda t: len((t or "").split())
    target = mixing.word_targets({s: sum(words(x.text) for x in once.values() if x.source == s) for s in {x.source for x in once.values()}})
    for s, want in target.items():
        taken = sum(words(x.text) for x in kept["source_mix"] if x.source == s)
        assert abs(taken - want) <= 120 and all(x.text == once[x.doc_id].text for x in kept["source_mix"])
    encoder = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    size = sorted((x.doc_id, len(encoder.encode(x.text, add_special_tokens=False).ids) + 1) for x in kept["source_mix"])
    pieces = {}
    for x in kept["packing"]:
        pieces.setdefault(x.sequence_id, []).append((x.offset, x.length))
    assert sorted((x.doc_id, x.length) for x in kept["packing"]) == size  # none is longer than a sequence
    for v in pieces.values():
        assert [a for a, _ in sorted(v)] == [sum(n for _, n in sorted(v)[:k]) for k in range(len(v))] and sum(n for _, n in v) <= 1024
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert {x.doc_id for x in whole.collect()} <= firsts and whole.columns == docs.columns
