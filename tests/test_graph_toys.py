"""Formulas on graphs small enough to check by hand."""

import hashlib
import math
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.functions import ordering, stats
from orrery.operators import blend, cohesion, community, graph, linalg, ml, pairs, powerlaw, sampling, walks
from orrery.plans import networks
from orrery.session import cut

TRIANGLE = [(1, 2), (2, 3), (1, 3)]
PATH7 = [(i, i + 1) for i in range(1, 7)]
BRIDGE = [(1, 2), (2, 3), (1, 3), (4, 5), (5, 6), (4, 6), (3, 4)]


def und(spark, edges):
    return spark.createDataFrame(edges, "a long, b long")


def directed(spark, edges):
    return spark.createDataFrame(edges, "src long, dst long")


def pair_frame(spark, rows):
    return spark.createDataFrame([(i, u, v) for i, (u, v) in enumerate(rows)], "pair_id long, u long, v long")


def one(df):
    return df.first().asDict()


def by(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def test_canonical_drops_loops_and_duplicates(spark):
    rows = graph.canonical(directed(spark, [(1, 1), (1, 2), (2, 1)])).collect()
    assert [(r.a, r.b) for r in rows] == [(1, 2)]


def test_triangle(spark):
    t = one(cohesion.transitivity(und(spark, TRIANGLE)))
    assert t == {"triangles": 1, "triples": 3, "transitivity": 1.0, "avg_clustering": 1.0}


def test_path_has_no_triangles_and_degree_one_has_no_clustering(spark):
    assert one(cohesion.transitivity(und(spark, PATH7)))["triangles"] == 0
    assert by(cohesion.local_clustering(und(spark, PATH7)), "id", "clustering")[1] == 0.0


@pytest.mark.parametrize(("exact", "expected"), [(False, [2, 4, 5, 5, 0, 1, 5]), (True, [2, 3, 4, 5, 0, 1, 5])])
def test_short_path_is_late_by_one_beyond_two(spark, exact, expected):
    p = pair_frame(spark, [(1, 3), (1, 4), (1, 5), (1, 7), (2, 2), (1, 2), (1, 99)])
    got = by(cohesion.short_path(p, graph.symmetric(und(spark, PATH7)), exact=exact), "pair_id", "short_path")
    assert [got[i] for i in range(7)] == expected


def test_hidden_edge(spark):
    sym, p = graph.symmetric(und(spark, TRIANGLE)), pair_frame(spark, [(1, 2)])
    near = cohesion.short_path(p, sym, hide=True)
    f = one(pairs.hidden_edge_features(p, sym, [], near, hide=True))
    assert (f["cn"], f["short_path"], f["jaccard"]) == (1, 2, 1.0)
    assert f["log_deg_u"] == pytest.approx(math.log(2))


def test_star(spark):
    sym = graph.symmetric(und(spark, [(0, i) for i in range(1, 5)]))
    assert by(graph.degrees(sym), "id", "degree") == {0: 4, 1: 1, 2: 1, 3: 1, 4: 1}
    f = one(pairs.tuned_features(pair_frame(spark, [(1, 2)]), sym, []))
    assert f["jaccard"] == 1.0 and f["adamic_adar"] == pytest.approx(1 / math.log(4))


def test_components(spark):
    assert by(cohesion.components(und(spark, [*PATH7, (10, 11)])), "id", "component") == {**{i: 1 for i in range(1, 8)}, 10: 10, 11: 10}


def test_pagerank(spark):
    got = by(walks.pagerank(directed(spark, [(1, 2), (2, 3), (3, 1)]), rounds=10), "id", "pagerank")
    assert list(got.values()) == pytest.approx([1 / 3] * 3)
    dangling = by(walks.pagerank(directed(spark, [(1, 2)]), rounds=60), "id", "pagerank")
    assert sum(dangling.values()) == pytest.approx(1.0)
    assert dangling[2] == pytest.approx(dangling[1] * 1.85, rel=1e-6)


def test_ppr_mass_and_unknown_ends(spark):
    sym = graph.symmetric(und(spark, TRIANGLE))
    p = pair_frame(spark, [(1, 2), (1, 99)])
    state = walks.ppr(sym, p.select(F.explode(F.array("u", "v")).alias("id")), rounds=20)
    assert by(state.groupBy("source").agg(F.sum("r").alias("m")), "source", "m") == pytest.approx({1: 1.0, 2: 1.0})
    assert by(walks.pair_scores(p, state), "pair_id", "score")[1] == 0.0


def test_hits(spark):
    got = {r.id: (r.hub, r.authority) for r in walks.hits(directed(spark, [(1, 3), (2, 3)]), rounds=4).collect()}
    assert got == {1: (0.5, 0.0), 2: (0.5, 0.0), 3: (0.0, 1.0)}


def test_partition_quality(spark):
    e = und(spark, BRIDGE)
    labels = spark.createDataFrame([(i, 1 + (i > 3)) for i in range(1, 7)], "id long, community int")
    assert one(community.modularity(e, labels))["modularity"] == pytest.approx(6 / 7 - 1 / 2)
    assert one(community.coverage(e, labels))["coverage"] == pytest.approx(6 / 7)
    assert by(community.conductance(e, labels), "community", "conductance") == pytest.approx({1: 1 / 7, 2: 1 / 7})
    whole = labels.withColumn("community", F.lit(1))
    assert one(community.modularity(e, whole))["modularity"] == pytest.approx(0.0)
    assert by(community.conductance(e, whole), "community", "conductance") == {1: 0.0}


@pytest.mark.parametrize("detect", [community.louvain, community.leiden])
def test_detection_finds_the_two_triangles(spark, detect):
    got = by(detect(und(spark, BRIDGE)), "id", "community")
    assert got[1] == got[2] == got[3] and got[4] == got[5] == got[6] and got[1] != got[4]


def test_nmi(spark):
    df = spark.createDataFrame([(i, i % 3, "abc"[i % 3], i % 2) for i in range(12)], "id long, x int, y string, z int")
    assert one(community.nmi(df, "x", "y"))["nmi"] == pytest.approx(1.0)
    assert one(community.nmi(df, "x", "z"))["nmi"] == pytest.approx(0.0)


def test_ranks(spark):
    df = spark.createDataFrame([(0, 0.1, 1.0), (1, 0.5, 1.0), (2, 0.3, 2.0), (3, 0.2, 3.0)], "id long, p double, q double")
    assert by(ordering.avg_rank(df, "p", "r"), "id", "r") == {0: 1.0, 1: 4.0, 2: 3.0, 3: 2.0}
    assert by(ordering.avg_rank(df, "q", "r"), "id", "r") == {0: 1.5, 1: 1.5, 2: 3.0, 3: 4.0}
    assert by(ordering.top_n_cut(df, "q", "id", 3, "c"), "id", "c") == {0: 1, 1: 0, 2: 1, 3: 1}


def test_auc(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1)], "s double, y int")
    assert one(stats.auc(df, "s", "y"))["auc"] == pytest.approx(0.75)
    assert one(stats.auc(df.withColumn("s", F.lit(1.0)), "s", "y"))["auc"] == pytest.approx(0.5)


def test_reciprocal_edge_and_self_edge_option(spark):
    e = directed(spark, [(1, 2), (2, 1), (1, 3)])
    p = pair_frame(spark, [(1, 2), (1, 3)])
    f = {r.pair_id: r for r in pairs.model_a_features(p, e).collect()}
    assert (f[0].reciprocal, f[0].v_follows_u, f[1].reciprocal) == (1, 1, 1)
    g = {r.pair_id: r for r in pairs.model_a_features(p, e, exclude_self_edge=True).collect()}
    assert (g[0].reciprocal, g[1].reciprocal, g[1].out_u) == (1, 0, 1)


def test_unknown_nodes_never_share_a_label(spark):
    labels = spark.createDataFrame([(1, 5)], "id long, community int")
    assert by(pairs.common_labels(pair_frame(spark, [(98, 99), (1, 1)]), labels, "community", "s"), "pair_id", "s") == {0: 0, 1: 1}


def test_svd_matches_dense(spark):
    r = np.random.default_rng(0)
    a = (r.random((12, 12)) < 0.3).astype(float)
    e = directed(spark, [(int(i), int(j)) for i, j in zip(*np.nonzero(a))])
    s, left, right = linalg.svd(e, k=4)
    assert s == pytest.approx(np.linalg.svd(a)[1][:4], rel=1e-4)
    u, v = ({x.id: np.array(x.x) for x in d.collect()} for d in (left, right))
    full = np.linalg.svd(a)
    approx = (full[0][:, :4] * full[1][:4]) @ full[2][:4]
    for i in u:
        for j in v:
            assert float(u[i] @ v[j]) == pytest.approx(approx[i, j], abs=1e-3)


def test_configuration_null_keeps_degrees_at_most(spark):
    e = und(spark, BRIDGE)
    null = community.configuration_null(e)
    assert null.where("a >= b").count() == 0
    own, other = (by(graph.degrees(graph.symmetric(x)), "id", "degree") for x in (e, null))
    assert all(other[i] <= own[i] for i in other)


def test_negatives_are_no_edges(spark):
    e = directed(spark, [(i, (i + 1) % 30) for i in range(30)])
    for rows in (sampling.random_negatives(e, 20), sampling.hard_negatives(e, 40), sampling.mixed_negatives(e, 20)):
        got = [(r.u, r.v) for r in rows.collect()]
        assert all(u != v and v != (u + 1) % 30 for u, v in got)
    assert sampling.hard_negatives(e, 40).count() == 40


def test_powerlaw_alpha(spark):
    r = np.random.default_rng(1)
    x = np.floor((5 - 0.5) * (1 - r.random(20000)) ** (-1 / 1.5) + 0.5).astype(int)
    values, counts = np.unique(x[x < 5000], return_counts=True)
    h = spark.createDataFrame([(int(v), int(c)) for v, c in zip(values, counts)], "degree long, n long")
    fit = one(powerlaw.alpha_ks(h).where("xmin = 5"))
    assert fit["alpha"] == pytest.approx(2.5, abs=0.1)


def test_folds_are_stratified(spark):
    df = spark.range(100).withColumn("label", (F.col("id") % 4 == 0).cast("int"))
    got = ml.stratified_folds(df, "label", "id", 5).groupBy("label", "fold").count().collect()
    assert {(r.label, r["count"]) for r in got} == {(0, 15), (1, 5)}


def test_blends(spark):
    df = spark.createDataFrame([(0, 0.2, 0.9), (1, 0.8, 0.1)], "id long, a double, b double")
    assert by(blend.rank_blend(df, "a", "b", 0.8), "id", "blend") == pytest.approx({0: 0.6, 1: 0.9})
    assert by(blend.max_blend(df, ["a", "b"]), "id", "blend") == {0: 0.9, 1: 0.8}
    assert by(blend.geometric_blend(df, ["a", "b"]), "id", "blend")[0] == pytest.approx(math.sqrt(0.18))


def test_empty_graph(spark):
    e = directed(spark, [])
    assert walks.pagerank(e).count() == 0
    assert cohesion.components(und(spark, [])).count() == 0


def test_registered_detection_runs_until_it_stalls(spark, monkeypatch):
    cliques = [(5 * c + i, 5 * c + j) for c in range(40) for i in range(5) for j in range(i)]
    edges = cut(und(spark, [*cliques, *((5 * c, (5 * c + 9) % 200) for c in range(40))]))
    t = SimpleNamespace(spark=spark, e_und=edges, e_sparse=edges.limit(3))
    own = spark.createDataFrame([(i, i // 5) for i in range(200)], "id long, community long")
    best = community.modularity(edges, own).first()[0]
    labels = cut(networks.louvain(t))
    assert labels.count() == 200 and community.modularity(edges, labels).first()[0] >= 0.9 > best
    seen, null = [], community.configuration_null
    monkeypatch.setattr(community, "louvain", lambda edges, *a: own)
    monkeypatch.setattr(community, "configuration_null", lambda edges, seed=1: (seen.append(seed), null(edges, seed))[1])
    row = networks.config_null_q(t).first()
    assert seen == [1, 2, 3] and row.q == best and abs(row.ratio - row.q / row.null_q) < 1e-12


def test_every_candidate_pair_is_scored(spark):
    edges = [*PATH7, (1, 4), (2, 6), (10, 11)]
    t = SimpleNamespace(spark=spark, e_sparse=und(spark, edges), pairs=pair_frame(spark, [(u, v) for u in range(1, 13) for v in (3, 6, 11, 99)]))
    p = np.zeros((12, 12))
    for a, b in edges:
        p[a, b] = p[b, a] = 1
    p = p / np.maximum(p.sum(axis=1, keepdims=True), 1)
    there = p.sum(axis=1) > 0
    state = np.diag(there.astype(float))
    for _ in range(networks.PPR_ROUNDS):
        state = networks.ALPHA * state @ p + (1 - networks.ALPHA) * np.diag(there.astype(float))
    mean = lambda u, v: (state[u, v] + state[v, u]) / 2 if max(u, v) < 12 else 0.0
    for scored in (networks.ppr_all_pair_scores(t), walks.blocked_pair_scores(t.pairs, graph.symmetric(t.e_sparse), block=3)):
        rows = scored.collect()
        assert len(rows) == 48 and all(abs(r.score - mean(r.u, r.v)) < 1e-8 for r in rows)
    assert networks.ppr_all_topn_predict(t).where("predicted = 1").count() == networks.TOP_PAIRS


def test_ranks_quantiles_and_cuts_with_nulls_and_hot_values(spark, monkeypatch):
    import numpy as np

    from orrery.functions import ordering

    monkeypatch.setattr(ordering, "HOT", 4)
    rows = [(i, None if i % 5 == 0 else float(i % 7 if i % 3 else 2)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, x double")
    got = {r.id: r.r for r in ordering.avg_rank(df, "x", "r").collect()}
    known = sorted(x for _, x in rows if x is not None)
    assert len(got) == 60
    for i, x in rows:
        assert got[i] == (None if x is None else np.mean([k + 1 for k, y in enumerate(known) if y == x]))
    q = ordering.quantiles(df, "x", [0.0, 0.25, 0.5, 0.9, 1.0]).first()["q"]
    assert np.allclose(q, np.quantile(known, [0, 0.25, 0.5, 0.9, 1.0]))
    by = {r.g: r.q for r in ordering.quantiles(df.withColumn("g", F.col("id") % 3), "x", [0.1, 0.5], ["g"]).collect()}
    for g in range(3):
        assert np.allclose(by[g], np.quantile([x for i, x in rows if x is not None and i % 3 == g], [0.1, 0.5]))
    cut = {r.id: r.top for r in ordering.top_n_cut(df, "x", "id", 50, "top").collect()}
    assert sum(cut.values()) == 50 and all(cut[i] == 1 for i, x in rows if x is not None)


def test_louvain_runs_detect_in_every_copy(spark):
    from orrery.operators import community, pairs

    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (4, 5), (5, 6), (4, 6), (3, 4)], "a long, b long")
    found = community.louvain_runs(edges, 4)
    by = {}
    for r in found.collect():
        by.setdefault(r.run, {})[r.id] = r.community
    assert sorted(by) == [0, 1, 2, 3] and all(sorted(v) == [1, 2, 3, 4, 5, 6] for v in by.values())
    whole = [(1, 2), (2, 3), (1, 3), (4, 5), (5, 6), (4, 6), (3, 4)]
    for v in by.values():  # a run may stop at a partition a little below the best, of modularity 5/14
        vol = {}
        for e in whole:
            for x in e:
                vol[v[x]] = vol.get(v[x], 0) + 1
        assert sum(v[a] == v[b] for a, b in whole) / 7 - sum((x / 14) ** 2 for x in vol.values()) > 0.1
    asked = spark.createDataFrame([(0, 1, 2), (1, 1, 6), (2, 1, 99)], "pair_id long, u long, v long")
    got = {r.pair_id: r.consensus for r in pairs.consensus_share(asked, found).collect()}
    assert got == {0: sum(v[1] == v[2] for v in by.values()) / 4, 1: sum(v[1] == v[6] for v in by.values()) / 4, 2: 0.0}


def test_components_of_chains_and_loops(spark):
    from orrery.operators import cohesion

    edges = spark.createDataFrame([(i, i + 1) for i in range(2000)] + [(5000, 5000)], "a long, b long")
    got = {r.id: r.component for r in cohesion.components(edges).collect()}
    assert all(got[i] == 0 for i in range(2001)) and got[5000] == 5000


def test_training_on_all_rows_ranks_and_averages(spark):
    from orrery.operators import linalg, ml

    rows = [(i, i % 10 / 10.0, int(i % 10 >= 5)) for i in range(200)]
    train = spark.createDataFrame(rows, "pair_id long, x double, label int")
    test = spark.createDataFrame([(1, 0.05), (2, 0.95), (3, 0.06)], "pair_id long, x double")
    got = {r.pair_id: r.p for r in ml.train_all(train, test, ["x"], [ml.gbt(3, 2, 0.3, 1.0, "all", 1), ml.forest(5, 1, 3)], "pair_id", [2.0, 1.0]).collect()}
    assert got[2] == 1.0 and got[1] == got[3] < got[2]
    folded = ml.stratified_folds(train, "label", "pair_id", 2)
    oof, scored = ml.out_of_fold(folded, test, ["x"], ml.gbt(3, 2, 0.3, 1.0, "all", 1), "pair_id", 2)
    assert oof.count() == 200 and {r.pair_id: r.p > 0.5 for r in scored.collect()} == {1: False, 2: True, 3: False}
    vectors = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.5, -1.0])], "id long, x array<double>")
    f = {r.pair_id: r for r in linalg.svd_pair_features(spark.createDataFrame([(7, 1, 2), (8, 1, 99)], "pair_id long, u long, v long"), vectors, vectors, 2).collect()}
    assert f[7].dot == -1.5 and f[7].had_0 == 0.5 and f[7].had_1 == -2.0 and f[8].dot == 0.0


def test_consensus_share_broadcasts_no_labels(spark):
    rows = [(r, i, i % (r + 2)) for r in range(4) for i in range(30)] + [(0, 40, None), (1, 40, 1)]
    parts = spark.createDataFrame(rows, "run int, id long, community long")
    got = pairs.consensus_share(pair_frame(spark, [(0, 2), (0, 1), (3, 3), (7, 99), (40, 1), (4, 16)]), parts)
    assert by(got, "pair_id", "consensus") == {0: 0.25, 1: 0.0, 2: 1.0, 3: 0.0, 4: 0.25, 5: 0.75}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in plan


@pytest.mark.parametrize("n", [1, 40, 100_000])
def test_hard_negatives_are_the_first_of_all_two_step_pairs(spark, n):
    ends = [(i, (i * k + k) % 60) for i in range(60) for k in (1, 7, 11)] + [(i, 0) for i in range(1, 60)] + [(0, i) for i in range(1, 30)]
    own = {(a, b) for a, b in ends if a != b}
    two = {(a, d) for a, b in own for c, d in own if b == c and a != d} - own
    drawn = lambda u, v: int(hashlib.md5(f"42_{u}_{v}".encode()).hexdigest()[:8], 16)
    expected = sorted((drawn(u, v), u, v) for u, v in two)[:n]
    rows = sampling.hard_negatives(directed(spark, sorted(own)), min(n, len(two)))
    assert sorted((r.k, r.u, r.v) for r in rows.collect()) == expected


def test_hard_negatives_leave_out_most_pairs_before_they_meet(spark):
    e = cut(directed(spark, [(i, (i + d) % 500) for i in range(500) for d in range(1, 9)]))
    seen, stored = [], sampling.stored
    sampling.stored = lambda df: (seen.append(df), stored(df))[1]
    try:
        assert sampling.hard_negatives(e, 100).count() == 100
    finally:
        sampling.stored = stored
    assert len(seen) <= 3 and sum(f.count() for f in seen) < 1000


@pytest.mark.parametrize("refine", [False, True])
def test_detection_in_tasks_and_by_joins_find_the_same_cliques(spark, monkeypatch, refine):
    cliques = [(6 * c + i, 6 * c + j) for c in range(12) for i in range(6) for j in range(i)]
    ring = [(6 * c, (6 * c + 7) % 36 + 36 * (c // 6)) for c in range(12)]  # two components of six cliques
    edges = und(spark, sorted({(min(e), max(e)) for e in [*cliques, *ring] if e[0] != e[1]}))
    joins, joined = [], community.joined_louvain
    monkeypatch.setattr(community, "joined_louvain", lambda *a: (joins.append(1), joined(*a))[1])
    for most, by_joins in ((1 << 22, 0), (110, 0), (90, 1)):
        monkeypatch.setattr(community, "IN_TASK", most)
        joins.clear()
        labels = cut(community.louvain(edges, refine=refine))
        got = by(labels, "id", "community")
        assert len(got) == 72 and len(joins) == by_joins and all(got[c] <= i for i, c in got.items())
        assert all(got[i] // 36 == i // 36 for i in got) and one(community.modularity(edges, labels))["modularity"] > 0.7


def test_a_graph_of_cliques_without_links_ends_in_a_task():
    a, b = np.array([1, 2, 1, 7]), np.array([2, 3, 3, 8])
    ids, found = community.moved_in_task(a, b, np.ones(4), 8.0, 1, False)
    assert ids.tolist() == [1, 2, 3, 7, 8] and found.tolist() == [1, 1, 1, 7, 7]


def test_stability_runs_detect_side_by_side(spark, monkeypatch):
    import threading

    meet, own = threading.Barrier(3, timeout=60), community.louvain  # breaks unless three detections run at once
    monkeypatch.setattr(community, "louvain", lambda edges, *seed: (meet.wait(), own(edges, *seed))[1])
    row = networks.louvain_stability(SimpleNamespace(spark=spark, e_und=und(spark, BRIDGE))).first()
    assert 0.1 < row.lowest <= row.highest < 0.36 and row.std_q <= row.highest - row.lowest


def test_walks_in_tasks_and_by_joins_agree_and_stay_in_a_component(spark, monkeypatch):
    edges = [*PATH7, (1, 4), (2, 6), (10, 11), (11, 12), (12, 13)]
    sym = cut(graph.symmetric(und(spark, edges)))
    asked = pair_frame(spark, [(u, v) for u in (1, 2, 5, 10, 12, 50) for v in (3, 5, 11, 13, 99)])
    plain = by(walks.pair_scores(asked, walks.ppr(sym, spark.range(60).select("id"))), "pair_id", "score")
    walked, joined = [], walks.joined_pair_scores
    monkeypatch.setattr(walks, "joined_pair_scores", lambda pairs, *a: (walked.extend(pairs.select("u", "v").collect()), joined(pairs, *a))[1])
    for most, alone in ((1 << 18, 0), (10, 6), (0, 10)):
        monkeypatch.setattr(walks, "IN_TASK", most)
        walked.clear()
        got = by(walks.blocked_pair_scores(asked, sym, block=3), "pair_id", "score")
        assert got == pytest.approx(plain, abs=1e-12) and len(walked) == alone


def test_trees_find_interactions_side_by_side(spark, monkeypatch):
    from pyspark.sql import DataFrame

    from orrery.operators import trees

    draws, levels, collect = np.random.default_rng(3), [], DataFrame.collect
    rows = [(k, float(a), float(b), float(c), int((a > 0.5) != (b > 0.5))) for k, (a, b, c) in enumerate(draws.random((3000, 3)))]
    frame = ml.stratified_folds(spark.createDataFrame(rows, "pair_id long, a double, b double, c double, label int").withColumn("pair_id", F.col("pair_id") * 7), "label", "pair_id", 3)
    monkeypatch.setattr(DataFrame, "collect", lambda df: levels.append(1) or collect(df))
    monkeypatch.setattr(trees, "KEEP", 4)
    test = frame.select("pair_id", "a", "b", "c")
    for factory in (ml.gbt(9, 4, 0.3, 0.9, "all", 5), ml.forest(20, 5, 8)):
        levels.clear()
        oof, p = ml.out_of_fold(frame, test, ["a", "b", "c"], factory, "pair_id", 3)
        assert len(levels) <= 9 * 4 + 1  # three models' trees grow in the same jobs
        found = {r.pair_id: r for r in oof.toLocalIterator()}
        assert len(found) == 3000 and all(found[7 * k].label == y for k, _, _, _, y in rows)
        assert {r.pair_id: r.fold for r in frame.toLocalIterator()} == {k: r.fold for k, r in found.items()}
        assert np.mean([(r.oof > 0.5) == r.label for r in found.values()]) > 0.93
        assert np.mean([(r.p > 0.5) == found[r.pair_id].label for r in p.toLocalIterator()]) > 0.93


def test_boosted_trees_are_those_of_the_plain_rule(spark):
    rows = [(k, float(k % 10), int(k % 10 > 6)) for k in range(200)]
    p = ml.seed_ensemble(spark.createDataFrame(rows, "pair_id long, x double, label int"), spark.createDataFrame([(1, 2.0), (2, 9.0), (3, None)], "pair_id long, x double"), ["x"], ml.gbt(2, 1, 0.3, 1.0, "all", 1), "pair_id", 2)
    step = 4 / (1 + math.exp(2))  # the residual after a first tree that is right everywhere
    high = 1 / (1 + math.exp(-2 * (1 + 0.3 * step)))
    assert {r.pair_id: round(r.p, 12) for r in p.collect()} == {1: round(1 - high, 12), 2: round(high, 12), 3: round(high, 12)}


def test_one_task_and_joins_rank_and_factor_alike(spark, monkeypatch):
    draws = np.random.default_rng(11)
    rows = sorted({(int(a), int(b)) for a, b in draws.integers(0, 60, (400, 2)) ** 2 if a != b} | {(9000, 9001)})
    e = directed(spark, rows)
    seen = []
    for bound in (graph.IN_TASK, -1):
        monkeypatch.setattr(graph, "IN_TASK", bound)
        ranks = {r.id: r.pagerank for r in walks.pagerank(e).collect()}
        scores = {r.id: (r.hub, r.authority) for r in walks.hits(e).collect()}
        s, left, right = linalg.svd(e, k=4)
        x, y = ({r.id: np.array(r.x) for r in v.collect()} for v in (left, right))
        parts = {r.id: r.component for r in cohesion.components(graph.canonical(e)).collect()}
        seen.append((ranks, scores, s, x, y, parts))
    a, b = seen
    assert a[5] == b[5] and a[0].keys() == b[0].keys() and all(abs(a[0][i] - b[0][i]) < 1e-12 for i in a[0])
    assert a[1].keys() == b[1].keys() and all(np.abs(np.subtract(a[1][i], b[1][i])).max() < 1e-12 for i in a[1])
    assert np.allclose(a[2], b[2]) and a[3].keys() == b[3].keys() and a[4].keys() == b[4].keys()
    assert all(abs(a[3][u] @ a[4][v] - b[3][u] @ b[4][v]) < 1e-8 for u, v in rows[:50])


def test_small_graphs_are_ranked_in_few_jobs(spark):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("ranked", "")
    walks.pagerank(directed(spark, [(i, (i * 7 + 3) % 50) for i in range(50)])).collect()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(tracker.getJobIdsForGroup("ranked")) < 12


def test_overlaps_in_cells_agree_with_sets(spark, monkeypatch):
    draws = np.random.default_rng(2)
    rows = sorted({(int(a) + 100 * c, int(b) + 100 * c) for c in range(3) for a, b in draws.integers(0, 40, (300, 2)) if a != b})
    asked = [(int(a), int(b)) for a, b in draws.integers(0, 260, (300, 2))] + rows[:100] + [(5, 5), (999, 1)]
    out, in_ = ({x: {p[1 - k] for p in rows if p[k] == x} for x in range(1000)} for k in (0, 1))
    near = {x: out[x] | in_[x] for x in out}
    frame = pair_frame(spark, asked).withColumn("name", F.lit("kept"))
    for bound in (1 << 20, 150):  # 150: components of several blocks
        monkeypatch.setattr(pairs, "CELL", bound)
        got = {r.pair_id: r for r in pairs.directed_overlaps(frame, directed(spark, rows)).collect()}
        assert len(got) == len(asked)
        for k, (u, v) in enumerate(asked):
            r = got[k]
            assert (r.oo, r.oi, r.io, r.ii, r.und) == (len(out[u] & out[v]), len(out[u] & in_[v]), len(in_[u] & out[v]), len(in_[u] & in_[v]), len(near[u] & near[v]))
            assert (r.forward, r.backward, r.name) == ((u, v) in rows, (v, u) in rows, "kept")
            assert (r.out_degree_u, r.in_degree_v, r.und_degree_v) == (len(out[u]), len(in_[v]), len(near[v]))
            assert abs(r.aa_und - sum(1 / math.log(len(near[w]) + 1e-9) for w in near[u] & near[v] if len(near[w]) > 1)) < 1e-9
            assert abs(r.aa_dir - sum(1 / math.log(len(out[w]) + len(in_[w])) for w in out[u] & in_[v])) < 1e-9
            assert abs(r.ra_dir - sum(1 / len(out[w]) for w in out[u] & in_[v])) < 1e-9


def test_overlaps_send_no_neighbour_lists_by_pair(spark):
    plan = pairs.directed_overlaps(pair_frame(spark, [(1, 2)]), directed(spark, [(1, 3), (3, 2)]))._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInArrow" in plan


def test_lowest_numbers_without_a_sort(spark, monkeypatch):
    numbers = sorted({(k * 37) % 1009 + 1 for k in range(0, 900, 2)})
    df = spark.createDataFrame([(k,) for k in numbers], "k long")
    monkeypatch.setattr(sampling, "RANGES", 7)
    for n in (0, 1, 5, 200, len(numbers), len(numbers) + 9):
        assert sorted(r.k for r in sampling.lowest(df, "k", n, 1009).collect()) == numbers[:n]
    e = directed(spark, [(a, b) for a in range(12) for b in range(12) if a != b and (a * b) % 5])
    every = [r for r in sampling.candidates(e, 200, "42").collect() if r.u != r.v]
    edges = {(r.src, r.dst) for r in e.collect()}
    free = sorted(r.k for r in every if (r.u, r.v) not in edges)
    got = sampling.random_negatives(e, 100).collect()  # a dense graph: the first draws are too few
    assert sorted(r.k for r in got) == free[:100] and {(r.k, r.u, r.v) for r in got} <= {tuple(r) for r in every}
    monkeypatch.setattr(graph, "HELD", -1)
    assert {tuple(r) for r in sampling.candidates(e, 200, "42").collect() if r.u != r.v} == {tuple(r) for r in every}


def test_training_rows_leave_only_their_bins(spark):
    import os

    from orrery.session import shared_folder, stored

    folder = shared_folder(spark).removeprefix("file:")
    there = lambda: {f for f in os.listdir(folder) if f.startswith("stored-")}
    rows = spark.createDataFrame([(k, float(k % 10), float(k % 7), int(k % 10 > 6), k % 3) for k in range(300)], "pair_id long, x double, y double, label int, fold int")
    before = there()
    oof = ml.out_of_fold(lambda: stored(stored(rows)), None, None, ml.gbt(2, 3, 0.3, 1.0, "all", 1), "pair_id", 3)[0]
    assert len(there() - before) == 1 and oof.count() == 300


def test_smaller_children_and_pairs_of_bins_give_the_nodes_means(spark):
    draws = np.random.default_rng(4)
    rows = [(k, *map(float, x), int(x[0] * x[1] > x[2] / 2)) for k, x in enumerate(draws.random((2000, 3)))]
    frame = spark.createDataFrame(rows, "pair_id long, a double, b double, c double, label int")
    p = {r.pair_id: r.p for r in ml.seed_ensemble(frame, frame, ["a", "b", "c"], ml.gbt(1, 4, 0.3, 1.0, "all", 5), "pair_id", 1).collect()}
    leaves = {}
    for k, *_, label in rows:
        leaves.setdefault(round(p[k], 12), []).append(2 * label - 1)
    assert len(leaves) > 8 and all(abs(1 / (1 + math.exp(-2 * np.mean(y))) - q) < 1e-9 for q, y in leaves.items())


def test_held_and_joined_vectors_agree(spark, monkeypatch):
    left = spark.createDataFrame([(k, [k + 0.5, -k / 3.0]) for k in range(5)], "id long, x array<double>")
    right = spark.createDataFrame([(k, [1.0 / (k + 1), k * 2.0]) for k in range(3, 9)], "id long, x array<double>")
    asked = pair_frame(spark, [(0, 3), (4, 8), (1, 1), (99, 4)])
    seen = []
    for bound in (graph.SMALL, -1):
        monkeypatch.setattr(graph, "SMALL", bound)
        seen.append({r.pair_id: r for r in linalg.svd_pair_features(asked, left, right, 2).collect()})
    assert seen[0] == seen[1] and len(seen[0]) == 4


def test_cross_partition_negatives_are_not_sorted(spark):
    rows = [(a, a + 1) for a in range(60)]
    sym = graph.symmetric(spark.createDataFrame(rows, "a long, b long"))
    own = spark.createDataFrame([(i, 0) for i in range(61)], "id long, component long")
    brand = spark.createDataFrame([(i, i % 3) for i in range(61)], "id long, community long")
    got = sampling.cross_partition_negatives(sym, own, brand, 30)
    assert "rangepartitioning" not in got._jdf.queryExecution().toString()
    every = sampling.cross_partition_negatives(sym, own, brand, 120, attempts=1).collect()  # the same draws, all kept
    assert sorted(r.k for r in got.collect()) == sorted(r.k for r in every)[:30]
    assert all(r.u % 3 != r.v % 3 and abs(r.u - r.v) > 1 for r in every)


def test_training_pairs_are_whole_and_leave_one_table(spark):
    import os

    from orrery.plans import models
    from orrery.session import shared_folder

    draws = np.random.default_rng(8)
    rows = sorted({(int(a), int(b)) for a, b in draws.integers(0, 50, (150, 2)) if a != b})
    folder = shared_folder(spark).removeprefix("file:")
    there = lambda: {f for f in os.listdir(folder) if f.startswith("stored-")}
    before = there()
    got = models.link_overlaps(directed(spark, rows)).collect()
    assert len(there() - before) == 1
    assert sorted((r.u, r.v) for r in got if r.label) == rows and len(got) == 2 * len(rows) == len({r.pair_id for r in got})
    assert not {(r.u, r.v) for r in got if not r.label} & set(rows)
    sizes = [sum(r.label == y and r.fold == f for r in got) for y in (0, 1) for f in range(3)]
    assert max(sizes) - min(sizes) <= 1


def test_binned_rows_are_compressed_and_replace_what_they_came_from(spark):
    import os
    from concurrent.futures import ThreadPoolExecutor

    from orrery.operators import ml, trees
    from orrery.session import FOLDERS, settled, taken_over

    rows = spark.range(4000).selectExpr("id", "cast(id % 2 as int) as label", "cast(id % 3 as int) as fold", "cast(id % 5 as double) as x", "0.5 as y")
    with ThreadPoolExecutor(1) as pool:
        made = pool.submit(lambda: settled(lambda: rows)).result()
    folder = FOLDERS[made].removeprefix("file:")
    assert os.path.isdir(folder)
    blocks, limits, names = ml.prepared(lambda: taken_over(made), ["x", "y"], "id", 3, keyed=False)
    assert not os.path.exists(folder)
    found = blocks.collect()
    assert not any(r.keys for r in found) and sum(len(r.labels) for r in found) == 4000
    assert sum(len(r.bins) for r in found) < 4000  # a byte a row would be 8,000
    seen = [b for batch in blocks.toArrow().to_batches() for _, _, _, _, bins, _ in trees.opened(batch, 2) for b in bins[0]]
    assert np.bincount(seen).tolist() == [800] * 5


def test_rank_ensemble_keeps_rows_in_place_and_agrees_with_joins(spark, monkeypatch):
    from orrery.functions.stats import auc
    from orrery.operators import graph, ml

    draws = np.random.default_rng(3)
    rows = [(i, int(draws.integers(2)), float(draws.integers(9)) / 8 - 0.0, float(draws.random()) if i % 50 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, label int, s0 double, s1 double").repartition(4).cache()
    parts = [df.selectExpr("id", "label", f"{s} as oof") for s in ("s0", "s1")]
    held = {r.id: r.blend for r in ml.rank_ensemble(parts, "id").collect()}
    plan = ml.blended(df, ["s0", "s1"], "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Repartition" not in plan.split("InMemoryRelation")[0]
    monkeypatch.setattr(graph, "HELD", 5)
    joined = {r.id: r.blend for r in ml.rank_ensemble(parts, "id").collect()}
    assert held == joined and len(held) == 300 and sum(x is None for x in held.values()) == 6
    w = [auc(p, "oof", "label").first()["auc"] for p in parts]
    known = [sorted(r[2 + k] for r in rows if r[2 + k] is not None) for k in (0, 1)]
    rank = lambda k, x: known[k].index(x) + (known[k].count(x) + 1) / 2
    for i, _, a, b in rows:
        if b is not None:
            assert abs(held[i] - (rank(0, a) * w[0] + rank(1, b) * w[1]) / sum(w)) < 1e-9


def test_components_by_joins_free_each_step(spark, monkeypatch):
    from orrery.operators import cohesion, graph

    monkeypatch.setattr(graph, "IN_TASK", 0)
    freed = []
    monkeypatch.setattr(cohesion, "let_go", freed.append)
    edges = spark.createDataFrame([(i, i + 1) for i in range(20) if i != 9], "a long, b long")
    got = {r.id: r.component for r in cohesion.components(edges).collect()}
    assert got == {i: 0 if i < 10 else 10 for i in range(21)} and len(freed) >= 3


def test_components_of_more_edges_than_a_task_takes_need_no_joins(spark, monkeypatch):
    from orrery.operators import cohesion, graph

    def joined(_):
        raise AssertionError("the links of 60 nodes fit a task")

    monkeypatch.setattr(cohesion, "small_stars", joined)
    monkeypatch.setattr(graph, "IN_TASK", 70)
    monkeypatch.setattr(cohesion, "CHUNK", 50)
    draws = np.random.default_rng(4)
    rows = [*((20 * c, 20 * c + 1 + i) for c in range(3) for i in range(19)), *((20 * int(c) + int(x), 20 * int(c) + int(y)) for c, x, y in draws.integers(0, [3, 20, 20], (600, 3))), (99, 99)]
    for kind in ("long", "int"):
        edges = spark.createDataFrame(rows, f"a {kind}, b {kind}").repartition(5)
        found = cohesion.components(edges)
        assert by(found, "id", "component") == {i: i if i == 99 else i // 20 * 20 for i in [*range(60), 99]}
        assert [f.dataType.simpleString() for f in found.schema] == [edges.schema["a"].dataType.simpleString()] * 2


def test_stability_places_edges_once_and_scores_without_joins(spark, monkeypatch):
    placed, own = [], community.placed_edges
    monkeypatch.setattr(community, "placed_edges", lambda *a: (placed.append(1), own(*a))[1])
    edges = und(spark, [*BRIDGE, (7, 8)])
    row = networks.louvain_stability(SimpleNamespace(spark=spark, e_und=edges)).first()
    assert len(placed) == 1 and 0.1 < row.lowest <= row.highest
    labels = spark.createDataFrame([(i, i // 4) for i in range(1, 8)], "id long, community long")  # 8 is unknown
    scored = community.modularity(edges, labels, graph.held(labels))
    assert one(scored) == one(community.modularity(edges, labels)) and "Join Inner, (id" not in scored._jdf.queryExecution().optimizedPlan().toString()


def test_a_large_component_is_detected_in_blocks_without_joins(spark, monkeypatch):
    monkeypatch.setattr(community, "IN_TASK", 60)
    monkeypatch.setattr(community, "BLOCK", 50)
    monkeypatch.setattr(community, "local_moving", None)
    cliques = [(7 + 6 * c + j, 7 + 6 * c + i) for c in range(12) for i in range(6) for j in range(i)]
    ring = [tuple(sorted((7 + 6 * c, 7 + (6 * c + 7) % 72))) for c in range(12)]
    edges = und(spark, [*cliques, *ring, (1, 2), (2, 3)])
    got = by(labels := cut(community.louvain(edges)), "id", "community")
    assert sorted(got) == [1, 2, 3, *range(7, 79)] and got[1] == 1 and max(got[2], got[3]) <= 3
    assert all(got[i] == min(k for k, c in got.items() if c == got[i]) for i in got) and one(community.modularity(edges, labels))["modularity"] > 0.7


def test_stubs_of_all_blocks_are_joined(spark, monkeypatch):
    monkeypatch.setattr(community, "BLOCK", 16)
    rows = [(i, j) for i in range(40) for j in range(i + 1, 40) if (i * j) % 7 == 1]
    null = [tuple(r) for r in community.configuration_null(und(spark, rows), 2).collect()]
    ends = lambda edges: np.bincount(np.array(edges).ravel(), minlength=40)
    assert (ends(null) <= ends(rows)).all() and 0.6 * len(rows) < len(set(null)) == len(null) and all(a < b for a, b in null)
    stored_ = community.configuration_null(und(spark, [(1, 2), (3, 4), (5, 6), (7, 8)]), 3).collect()
    assert len(stored_) >= 2 and [tuple(r) for r in stored_] != [(1, 2), (3, 4), (5, 6), (7, 8)]


def test_scores_and_vectors_read_stored_edges_where_they_lie(spark, monkeypatch):
    from orrery import session

    edges, copied = session.stored(directed(spark, [(1, 2), (2, 3), (3, 1), (3, 4)])), []
    own = session.stored
    monkeypatch.setattr(session, "stored", lambda df: (copied.append(df.columns), own(df))[1])
    for module in (walks, linalg):
        monkeypatch.setattr(module, "cut", lambda df: (copied.append(df.columns), cut(df))[1])
    walks.pagerank(edges), walks.hits(edges), linalg.svd(edges, 2)
    assert ["src", "dst"] not in copied
    walks.hits(edges.where("src < 9"))
    assert copied.count(["src", "dst"]) == 1
