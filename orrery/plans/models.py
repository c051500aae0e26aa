"""Vectors, folds and trained models."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from ..functions import stats
from ..operators import cohesion, community, graph, linalg, ml, pairs, sampling
from ..session import cut, let_go, settled, stored, taken_over
from .basics import digits
from .links import brands
from .networks import node_scores
from .registry import query

VECTOR_PAIRS = "& vp AS MATERIALIZED (SELECT x.vec_id AS pair_id, x.embedding AS a, y.embedding AS b FROM embeddings x JOIN embeddings y ON y.vec_id = (x.vec_id * 7 + 13) % (SELECT count(*) FROM embeddings)), hd AS MATERIALIZED (SELECT pair_id, generate_subscripts(a, 1) - 1 AS i, unnest(a)::double AS x, unnest(b)::double AS y FROM vp) "


def vector_pairs(t):
    e = t.read("embeddings")
    n = e.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    y = e.select(F.col("vec_id").alias("__y"), F.col("embedding").alias("b"))
    return e.select(F.col("vec_id").alias("pair_id"), F.col("embedding").alias("a"), ((F.col("vec_id") * 7 + 13) % n).alias("__y")).join(y, "__y").drop("__y")


@query(VECTOR_PAIRS + """SELECT pair_id, round(dot, 6) + 0::double AS dot, round(sqrt(greatest(sn * sn + dn * dn - 2 * dot, 0)), 6) AS l2, round(dot / (sn * dn + 1e-10::double), 6) + 0::double AS cosine, round(sn, 6) AS src_norm, round(dn, 6) AS dst_norm, round(hm, 6) + 0::double AS had_mean, round(hs, 6) AS had_std, round(ham, 6) AS had_abs_mean, round(hax, 6) AS had_abs_max FROM
(SELECT pair_id, sum(x * y) AS dot, sqrt(sum(x * x)) AS sn, sqrt(sum(y * y)) AS dn, avg(x * y) AS hm, stddev_pop(x * y) AS hs, avg(abs(x * y)) AS ham, max(abs(x * y)) AS hax FROM hd GROUP BY pair_id)""")
def embedding_pair_features(t):
    f = linalg.vector_pair_features(vector_pairs(t)).drop("a", "b")
    return digits(f, *[c for c in f.columns if c != "pair_id"], places=6)


@query(VECTOR_PAIRS + "SELECT pair_id, CAST(i AS INT) AS i, round(x * y, 8) + 0::double AS product FROM hd")
def hadamard_long(t):
    return digits(linalg.hadamard_long(vector_pairs(t), "pair_id"), "product")


FOLDS = "& fo AS MATERIALIZED (SELECT id, p1, p2, label, CAST((row_number() OVER (PARTITION BY label ORDER BY md5(CAST(id AS VARCHAR)), id) - 1) % 5 AS INT) AS fold FROM scores) "


def auc_sql(source: str, by: str = "") -> str:
    part = f"PARTITION BY {by}" if by else ""
    own = f"{by}, " if by else ""
    return f"""SELECT {own}round((sum(CASE WHEN label = 1 THEN r ELSE 0 END) - sum(label) * (sum(label) + 1) / 2.0::double) / (sum(label) * (count(*) - sum(label))), 8) AS auc FROM
(SELECT {own}label, rank() OVER ({part} ORDER BY p1) + (count(*) OVER (PARTITION BY {own}p1) - 1) / 2.0::double AS r FROM {source}) {f'GROUP BY {by}' if by else ''}"""


def folds(t):
    return ml.stratified_folds(t.scores, "label", "id", 5)


@query(FOLDS + "SELECT id, label, fold FROM fo")
def stratified_folds(t):
    return folds(t).select("id", "label", "fold")


@query(FOLDS + auc_sql("fo", "fold"))
def auc_by_fold(t):
    return digits(ml.fold_auc(folds(t).withColumnRenamed("p1", "oof")), "auc")


@query(FOLDS + auc_sql("fo"))
def oof_auc(t):
    return digits(stats.auc(t.scores, "p1", "label"), "auc")


@query(FOLDS + f"SELECT round(avg(auc), 6) AS mean_auc, round(stddev_pop(auc), 6) AS std_auc FROM ({auc_sql('fo', 'fold')})")
def cv_auc(t):
    return digits(ml.cv_auc(folds(t).withColumnRenamed("p1", "oof")), "mean_auc", "std_auc", places=6)


@query(FOLDS + "SELECT label, round(avg(m), 6) AS fold_average FROM (SELECT label, fold, avg(p1) AS m FROM fo GROUP BY label, fold) GROUP BY label")
def fold_average(t):
    each = folds(t).groupBy("label", "fold").agg(F.avg("p1").alias("m"))
    return digits(each.groupBy("label").agg(F.avg("m").alias("fold_average")), "fold_average", places=6)


@query()
def svd_embeddings(t):
    _, left, right = linalg.svd(t.e_dir, k=16)
    one = left.select("id", F.lit("source").alias("side"), "x")
    return one.unionByName(right.select("id", F.lit("target").alias("side"), "x"))


#: Trees of the registered queries; the factories' defaults are the large models'.
QUICK = {"rounds": 10, "depth": 4, "rate": 0.3, "subsample": 1.0, "columns": "all", "least": 5}
DETECTED = ["same_leiden", "same_louvain", "same_component"]
HIDDEN = ["cn", "jaccard", "adamic_adar", "resource_alloc", "log_pa", "short_path", *DETECTED, "consensus", "log_deg_u", "log_deg_v"]
TUNED = ["cn", "jaccard", "adamic_adar", "log_pa", *DETECTED]
#: Dimensions of Model B's vectors in the registered queries.
FACTORS = 16


def pair_name():
    return F.xxhash64("u", "v")


def link_rows(edges):
    """(u, v, label, fold) of every directed edge and as many random non-edges; the fold is by the pair's hash."""
    both = sampling.training_union(edges.toDF("u", "v"), sampling.random_negatives(edges, edges.count(), distinct=True))
    return ml.stratified_folds(both, "label", pair_name(), 3)


def link_overlaps(edges):
    """``directed_overlaps`` of the training rows with their pair_id, label and fold; only they stay stored."""
    return stored_overlaps(edges).withColumn("pair_id", pair_name())


def stored_overlaps(edges):
    return settled(lambda: pairs.directed_overlaps(settled(lambda: link_rows(edges)), edges))


def link_frame(t):
    """Training rows of Model A."""
    return pairs.model_a_features(None, None, exclude_self_edge=True, keep=["label", "fold"], overlaps=link_overlaps(stored(t.e_dir)))


def trained(t, factory):
    return ml.out_of_fold(lambda: link_frame(t), None, None, factory, "pair_id", 3)[0]


@query()
def gbt_link_prediction(t):
    return trained(t, ml.gbt(**QUICK))


@query()
def rf_link_prediction(t):
    return trained(t, ml.forest(trees=20, depth=8))


@query()
def oof_rank_ensemble(t):
    return ml.oof_ensemble(lambda: link_frame(t), None, [ml.gbt(**QUICK), ml.forest(trees=20, depth=8)], "pair_id", 3)


def sparse_rows(t):
    """(edges, components, both ways, training rows) of the sparse graph: its edges against pairs of other
    brands in one component."""
    edges = stored(t.e_sparse)
    own = cut(cohesion.components(edges))
    sym = graph.symmetric(edges)
    negative = sampling.cross_partition_negatives(sym, own, brands(t), edges.count())
    both = sampling.training_union(edges.toDF("u", "v"), negative).distinct()
    return edges, own, sym, cut(both.withColumn("pair_id", F.xxhash64("u", "v")))


def detected(edges, own):
    """The runs of Louvain, and (labels, column, name) of each partition of the sparse graph."""
    runs = cut(community.louvain_runs(edges))
    parts = cut(community.leiden(edges)), cut(runs.where("run = 0").select("id", "community")), own.withColumnRenamed("component", "community")
    return runs, [(p, "community", n) for p, n in zip(parts, DETECTED)]


@query()
def gbt_tuned_ensemble(t):
    edges, own, sym, rows = sparse_rows(t)
    _, named = detected(edges, own)
    train = lambda: stored(pairs.tuned_features(rows, sym, named).join(rows.select("pair_id", "label"), "pair_id"))
    test = pairs.tuned_features(t.pairs, sym, named)
    return ml.seed_ensemble(train, test, TUNED, ml.gbt(**{**QUICK, "subsample": 0.8}), "pair_id", members=8)


@query()
def gbt_hidden_ensemble(t):
    edges, own, sym, rows = sparse_rows(t)
    runs, named = detected(edges, own)

    def near(p, hide):
        f = pairs.hidden_edge_features(p, sym, named, cohesion.short_path(p, sym, hide), hide)
        return f.join(pairs.consensus_share(p, runs).select("pair_id", "consensus"), "pair_id")

    train = lambda: stored(near(rows, True).join(rows.select("pair_id", "label"), "pair_id"))
    return ml.seed_ensemble(train, near(t.pairs, False), HIDDEN, ml.gbt(**{**QUICK, "subsample": 0.8}), "pair_id", members=6)


def model_b(t, edges):
    """The functions that give Model B's columns for pairs: 27 of the graph; and to those nine of the vectors and their products.
    Then what tasks add these by, None where the vectors are too many.  Two parts of the work go side by side."""
    und = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    with ThreadPoolExecutor(2) as pool:
        parts = [pool.submit(f) for f in (lambda: node_scores(t, edges), lambda: cut(community.louvain(und)), lambda: [cut(x) for x in linalg.svd(edges, k=FACTORS)[1:]])]
        scores, named, (left, right) = (p.result() for p in parts)
    let_go(t.spark)

    def local(p, keep=(), overlaps=None):
        return pairs.model_b_features(p, edges, scores, named, ["u", "v", *keep], overlaps)

    return local, lambda f: linalg.svd_pair_features(f, left, right, FACTORS).drop("u", "v"), linalg.Vectors.held(left, right, FACTORS)


def model_b_frames(t):
    """(what gives the training rows with label and fold, candidate pairs, columns, what tasks add) of Model B.  The
    candidates' columns are made beside the training rows' overlaps, which go when the rows are binned."""
    edges = stored(t.e_dir)
    with ThreadPoolExecutor(1) as pool:
        made = pool.submit(stored_overlaps, edges)
        local, whole, more = model_b(t, edges)
        test = settled(lambda: local(t.pairs))
        overlaps = made.result()
    add = whole if more is None else lambda f: f
    train = lambda: add(local(None, ["label", "fold"], taken_over(overlaps).withColumn("pair_id", pair_name())))
    test = add(test)
    return train, test, [c for c in test.columns if c not in ("pair_id", "u", "v")], more


@query()
def model_b_features(t):
    """All columns of Model B for the candidate pairs; Louvain and the vectors' signs are beyond SQL."""
    local, whole, _ = model_b(t, stored(t.e_dir))
    return whole(local(t.pairs))


@query()
def gbt_model_b(t):
    """Candidate pairs scored by the models of all folds, averaged."""
    train, test, columns, more = model_b_frames(t)
    return ml.out_of_fold(train, test, columns, ml.gbt(**QUICK), "pair_id", 3, more=more)[1]


@query()
def rank_average_predict(t):
    """Model B's columns: boosted trees and a forest trained on all rows, ranks averaged."""
    train, test, columns, more = model_b_frames(t)
    return ml.train_all(train, test, columns, [ml.gbt(**QUICK), ml.forest(trees=20, depth=8)], "pair_id", more=more)
