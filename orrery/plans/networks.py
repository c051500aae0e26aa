"""Cohesion, walks, partitions and power laws."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from ..functions import stats
from ..functions.ordering import top_n_cut
from ..operators import cohesion, community, graph, pairs, powerlaw, walks
from ..session import cut, dropped, let_go, stored
from .basics import CLUSTERING, DEGREES, digits, und_degree
from .links import LABELS, REACH, brands
from .registry import query

PAGERANK_ROUNDS, HITS_ROUNDS, PPR_ROUNDS, ALPHA, TOP_PAIRS = 100, 100, 20, 0.85, 10


@query(CLUSTERING + "SELECT count(*) AS triangles FROM tri")
def triangle_count(t):
    return cohesion.triangles(t.e_und).agg(F.count(F.lit(1)).alias("triangles"))


@query(CLUSTERING + "SELECT CAST(sum(triangles) / 3 AS BIGINT) AS triangles, CAST(sum(degree * (degree - 1) / 2) AS BIGINT) AS triples, round(sum(triangles)::double / sum(degree * (degree - 1) / 2), 8) AS transitivity, round(avg(clustering), 8) AS avg_clustering FROM lc")
def global_transitivity(t):
    return digits(cohesion.transitivity(t.e_und), "transitivity", "avg_clustering")


@query(CLUSTERING + "SELECT id, degree, triangles, round(clustering, 8) AS clustering FROM lc")
def local_clustering(t):
    return digits(cohesion.local_clustering(t.e_und), "clustering")


@query(CLUSTERING + "SELECT round(avg(clustering), 8) AS avg_clustering, round((sum(triangles)::double / sum(degree * (degree - 1) / 2)) / (sum(degree) / (count(*) * (count(*) - 1))::double), 6) AS ratio FROM lc")
def avg_clustering_ratio(t):
    both = cohesion.transitivity(t.e_und).crossJoin(graph.density(t.e_und))
    return both.select(F.round("avg_clustering", 8).alias("avg_clustering"), F.round(F.col("transitivity") / F.col("density"), 6).alias("ratio"))


@query(DEGREES + "SELECT s.src, s.dst, round(1.0::double / degree, 10) AS w FROM s_und s JOIN d ON d.id = s.src")
def transition_matrix(t):
    return digits(graph.transition(graph.symmetric(t.e_und)), "w", places=10)


def pagerank_sql() -> str:
    head = "& nd AS MATERIALIZED (SELECT id, CAST(sum(o) AS BIGINT) AS od FROM (SELECT src AS id, 1 AS o FROM e_dir UNION ALL SELECT dst, 0 FROM e_dir) GROUP BY id), nn AS (SELECT count(*)::double AS n FROM nd), p0 AS MATERIALIZED (SELECT id, 1.0::double / n AS r FROM nd, nn)"
    rounds = "".join(f""", p{k} AS MATERIALIZED (SELECT nd.id, {1 - ALPHA}::double / n + {ALPHA}::double * (coalesce(g.got, 0) + coalesce((SELECT sum(r) FROM p{k - 1} x JOIN nd y ON y.id = x.id WHERE y.od = 0), 0) / n) AS r
FROM nd CROSS JOIN nn LEFT JOIN (SELECT e.dst AS id, sum(p.r / nd.od) AS got FROM e_dir e JOIN p{k - 1} p ON p.id = e.src JOIN nd ON nd.id = e.src GROUP BY e.dst) g ON g.id = nd.id)""" for k in range(1, PAGERANK_ROUNDS + 1))
    return f"{head}{rounds} SELECT id, round(r, 9) AS pagerank FROM p{PAGERANK_ROUNDS}"


@query(pagerank_sql())
def pagerank(t):
    return digits(walks.pagerank(t.e_dir, ALPHA, PAGERANK_ROUNDS), "pagerank", places=9)


def hits_sql() -> str:
    sql = "& ids AS MATERIALIZED (SELECT src AS id FROM e_dir UNION SELECT dst FROM e_dir), h0 AS MATERIALIZED (SELECT id, 1.0::double AS x FROM ids)"
    norm = lambda name, frm, to, prev: f", {name} AS MATERIALIZED (SELECT id, g / sum(g) OVER () AS x FROM (SELECT ids.id, coalesce(sum(p.x), 0) AS g FROM ids LEFT JOIN e_dir e ON e.{to} = ids.id LEFT JOIN {prev} p ON p.id = e.{frm} GROUP BY ids.id))"
    for k in range(1, HITS_ROUNDS + 1):
        sql += norm(f"a{k}", "src", "dst", f"h{k - 1}") + norm(f"h{k}", "dst", "src", f"a{k}")
    return f"{sql} SELECT h.id, round(h.x, 9) AS hub, round(a.x, 9) AS authority FROM h{HITS_ROUNDS} h JOIN a{HITS_ROUNDS} a ON a.id = h.id"


@query(hits_sql())
def hits(t):
    return digits(walks.hits(t.e_dir, HITS_ROUNDS), "hub", "authority", places=9)


GLOBAL = pagerank_sql().rsplit(" SELECT ", 1)[0] + ", " + hits_sql().removeprefix("& ").rsplit(" SELECT ", 1)[0] + ", lab AS (SELECT id, language AS community FROM node_attr) "


@query(GLOBAL + f"""SELECT p.pair_id, round(coalesce(pu.r, 0), 9) AS pagerank_u, round(coalesce(pv.r, 0), 9) AS pagerank_v, round(coalesce(hu.x, 0), 9) AS hub_u, round(coalesce(hv.x, 0), 9) AS hub_v, round(coalesce(au.x, 0), 9) AS authority_u, round(coalesce(av.x, 0), 9) AS authority_v,
coalesce(CAST(lu.community = lv.community AS INT), 0) AS same_community FROM pairs p LEFT JOIN p{PAGERANK_ROUNDS} pu ON pu.id = p.u LEFT JOIN p{PAGERANK_ROUNDS} pv ON pv.id = p.v LEFT JOIN h{HITS_ROUNDS} hu ON hu.id = p.u LEFT JOIN h{HITS_ROUNDS} hv ON hv.id = p.v
LEFT JOIN a{HITS_ROUNDS} au ON au.id = p.u LEFT JOIN a{HITS_ROUNDS} av ON av.id = p.v LEFT JOIN lab lu ON lu.id = p.u LEFT JOIN lab lv ON lv.id = p.v""")
def model_b_global_features(t):
    """Model B's seven global features, with brands in place of detected communities, as SQL can't detect."""
    named = ["pagerank_u", "pagerank_v", "hub_u", "hub_v", "authority_u", "authority_v"]
    return digits(pairs.model_b_features(t.pairs, t.e_dir, node_scores(t), brands(t)).select("pair_id", *named, "same_community"), *named, places=9)


def node_scores(t, edges=None):
    """(id, pagerank, hub, authority) of the directed graph."""
    edges = edges or stored(t.e_dir)
    return cut(walks.pagerank(edges, ALPHA, PAGERANK_ROUNDS).join(walks.hits(edges, HITS_ROUNDS), "id"))


def ppr_sql() -> str:
    head = "& dg AS MATERIALIZED (SELECT src AS id, count(*) AS d FROM s_sparse GROUP BY src), src AS MATERIALIZED (SELECT DISTINCT id FROM (SELECT u AS id FROM seed_pairs UNION SELECT v FROM seed_pairs) JOIN dg USING (id)), q0 AS MATERIALIZED (SELECT id AS source, id AS node, 1.0::double AS r FROM src)"
    rounds = "".join(f", q{k} AS MATERIALIZED (SELECT source, node, sum(r) AS r FROM (SELECT q.source, s.dst AS node, q.r * (1.0::double / d) * {ALPHA}::double AS r FROM q{k - 1} q JOIN s_sparse s ON s.src = q.node JOIN dg ON dg.id = q.node UNION ALL SELECT id, id, {1 - ALPHA}::double FROM src) GROUP BY source, node)" for k in range(1, PPR_ROUNDS + 1))
    return head + rounds


PPR = ppr_sql()
PPR_SCORE = PPR + f", sc AS MATERIALIZED (SELECT p.pair_id, p.u, p.v, round((coalesce(a.r, 0) + coalesce(b.r, 0)) / 2, 9) AS score FROM seed_pairs p LEFT JOIN q{PPR_ROUNDS} a ON a.source = p.u AND a.node = p.v LEFT JOIN q{PPR_ROUNDS} b ON b.source = p.v AND b.node = p.u) "


def ppr_state(t):
    ends = t.seed_pairs.select(F.explode(F.array("u", "v")).alias("id"))
    return walks.ppr(graph.symmetric(t.e_sparse), ends, ALPHA, PPR_ROUNDS)


@query(PPR + f" SELECT source, node, round(r, 9) AS r FROM q{PPR_ROUNDS}")
def ppr_vectors(t):
    return digits(ppr_state(t), "r", places=9)


@query(PPR_SCORE + "SELECT pair_id, u, v, score FROM sc")
def ppr_pair_score(t):
    return digits(walks.pair_scores(t.seed_pairs, ppr_state(t)).select("pair_id", "u", "v", "score"), "score", places=9)


@query(PPR_SCORE + f"SELECT pair_id, CAST(row_number() OVER (ORDER BY score DESC, pair_id) <= {TOP_PAIRS} AS INT) AS predicted FROM sc")
def ppr_topn_predict(t):
    return top_n_cut(cut(ppr_pair_score(t)), "score", "pair_id", TOP_PAIRS, "predicted").select("pair_id", "predicted")


@query()
def ppr_all_pair_scores(t):
    """All candidate pairs; the three queries above, as their SQL, take two parts of each brand."""
    scored = walks.blocked_pair_scores(t.pairs, cut(graph.symmetric(t.e_sparse)), ALPHA, PPR_ROUNDS)
    return digits(scored.select("pair_id", "u", "v", "score"), "score", places=9)


@query()
def ppr_all_topn_predict(t):
    return top_n_cut(cut(ppr_all_pair_scores(t)), "score", "pair_id", TOP_PAIRS, "predicted").select("pair_id", "predicted")


QUALITY = LABELS + """ce AS MATERIALIZED (SELECT x.community AS ca, y.community AS cb FROM e_und e JOIN lab x ON x.id = e.a JOIN lab y ON y.id = e.b),
vol AS MATERIALIZED (SELECT community, CAST(sum(same) / 2 AS BIGINT) AS internal, count(*) AS vol FROM (SELECT unnest([ca, cb]) AS community, CAST(ca = cb AS INT) AS same FROM ce) GROUP BY community), m AS (SELECT sum(vol) / 2.0::double AS m FROM vol) """


@query(QUALITY + "SELECT round(sum(internal / m - (vol / (2 * m)) * (vol / (2 * m))), 8) AS modularity FROM vol, m")
def modularity(t):
    return digits(community.modularity(t.e_und, brands(t)), "modularity")


@query(QUALITY + "SELECT round(avg(CAST(ca = cb AS INT)), 8) AS coverage FROM ce")
def coverage(t):
    return digits(community.coverage(t.e_und, brands(t)), "coverage")


@query(QUALITY + "SELECT c.community, round(CASE WHEN least(coalesce(vol, 0), 2 * m - coalesce(vol, 0)) > 0 THEN (vol - 2 * internal) / least(vol, 2 * m - vol) ELSE 0 END, 8) AS conductance FROM (SELECT DISTINCT community FROM lab) c CROSS JOIN m LEFT JOIN vol ON vol.community = c.community")
def conductance(t):
    return digits(community.conductance(t.e_und, brands(t)), "conductance")


PROFILE = LABELS + """ln0 AS (SELECT language AS community, life_time, count(*) AS n FROM node_attr GROUP BY ALL), pf AS MATERIALIZED (SELECT a.life_time AS community, a.size, l.dominant_language, l.most::double / a.size AS language_purity, a.affiliate_rate, a.median_views FROM
(SELECT life_time, count(*) AS size, avg(affiliate) AS affiliate_rate, CAST(trunc(median(views)) AS BIGINT) AS median_views FROM node_attr GROUP BY life_time) a JOIN
(SELECT life_time, first(community ORDER BY n DESC, community) AS dominant_language, max(n) AS most FROM ln0 GROUP BY life_time) l ON l.life_time = a.life_time) """


def by_size(t):
    return t.node_attr.select("id", F.col("life_time").alias("community"))


@query("& z AS (SELECT life_time, count(*) AS n FROM node_attr GROUP BY life_time) SELECT count(*) AS communities, max(n) AS largest, median(n) AS median_size, count(*) FILTER (WHERE n = 1) AS singletons FROM z")
def partition_sizes(t):
    return community.partition_sizes(by_size(t))


@query(PROFILE + "SELECT community, size, dominant_language, round(language_purity, 8) AS language_purity, round(affiliate_rate, 8) AS affiliate_rate, median_views FROM pf")
def community_profile(t):
    return digits(community.profile(t.node_attr, by_size(t)), "language_purity", "affiliate_rate")


@query(PROFILE + "SELECT round(sum(size)::double / (SELECT count(*) FROM node_attr), 8) AS coverage, round(avg(language_purity), 8) AS mean_purity FROM (SELECT * FROM pf ORDER BY size DESC, community LIMIT 10)")
def topn_coverage_purity(t):
    return digits(community.top_coverage(community.profile(t.node_attr, by_size(t))), "coverage", "mean_purity")


@query(PROFILE + "SELECT l.life_time AS community, l.community AS language, round(l.n::double / p.size, 8) AS share FROM ln0 l JOIN (SELECT * FROM pf ORDER BY size DESC, community LIMIT 10) p ON p.community = l.life_time")
def language_shares(t):
    return digits(community.language_shares(t.node_attr, by_size(t)), "share")


def nmi_sql(source: str, x: str, y: str) -> str:
    h = lambda by: f"(SELECT -sum(n / t * ln(n / t)) FROM (SELECT count(*)::double AS n, sum(count(*)) OVER () AS t FROM {source} GROUP BY {by}))"
    return f"SELECT {h(x)} AS hx, {h(y)} AS hy, {h(f'{x}, {y}')} AS hxy"


NMI = "round(CASE WHEN hx + hy > 0 THEN 2 * (hx + hy - hxy) / (hx + hy) ELSE 1 END, 8)"


@query(f"SELECT {NMI} AS nmi FROM ({nmi_sql('node_attr', 'life_time', 'language')})")
def nmi(t):
    return digits(community.nmi(t.node_attr, "life_time", "language"), "nmi")


@query(f"& sx AS (SELECT life_time AS x, row_number() OVER (ORDER BY life_time, id) AS rn FROM node_attr), sy AS (SELECT language AS y, row_number() OVER (ORDER BY id) AS rn FROM node_attr), sb AS MATERIALIZED (SELECT x, y FROM sx JOIN sy USING (rn)) SELECT {NMI} AS nmi FROM ({nmi_sql('sb', 'x', 'y')})")
def nmi_sorted_baseline(t):
    return digits(community.sorted_baseline(t.node_attr, "life_time", "language", "id"), "nmi")


@query(f"SELECT {NMI} AS nmi, CASE WHEN {NMI} >= 0.5 THEN 'strong' WHEN {NMI} >= 0.2 THEN 'moderate' ELSE 'weak' END AS verdict FROM ({nmi_sql('node_attr', 'life_time', 'language')})")
def nmi_verdict(t):
    return nmi(t).withColumn("verdict", community.verdict(F.col("nmi")))


RUNS = " UNION ALL ".join(f"SELECT {r} AS run, id, (id * {2 * r + 3} + {r}) % 5 AS community FROM node_attr" for r in range(8))


def runs(t):
    """Eight made partitions, as an ensemble of detections would give."""
    each = t.node_attr.select("id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("run"))
    return each.select("run", "id", ((F.col("id") * (2 * F.col("run") + 3) + F.col("run")) % 5).alias("community"))


@query(f"& pt AS MATERIALIZED ({RUNS}) SELECT p.pair_id, coalesce(sum(CAST(x.community = y.community AS INT)), 0) / 8.0::double AS consensus FROM pairs p LEFT JOIN pt x ON x.id = p.u LEFT JOIN pt y ON y.id = p.v AND y.run = x.run GROUP BY p.pair_id")
def consensus_share(t):
    return pairs.consensus_share(t.pairs, runs(t)).select("pair_id", "consensus")


POWER = DEGREES + """, hg AS MATERIALIZED (SELECT degree::double AS x, count(*)::double AS c FROM d GROUP BY degree), ft AS MATERIALIZED (SELECT a.x AS xmin, sum(b.c) AS tail, 1 + sum(b.c) / sum(b.c * ln(b.x / (a.x - 0.5::double))) AS alpha FROM hg a JOIN hg b ON b.x >= a.x GROUP BY a.x HAVING sum(b.c) >= 10),
gp AS (SELECT xmin, tail, alpha, x, sum(c) OVER (PARTITION BY xmin ORDER BY x DESC) AS above FROM ft JOIN hg ON x >= xmin),
pl AS MATERIALIZED (SELECT xmin, tail, alpha, max(abs(above / tail - pow((x - 0.5::double) / (xmin - 0.5::double), 1 - alpha))) AS ks FROM gp GROUP BY ALL) """


@query(POWER + "SELECT xmin, tail, round(alpha, 6) AS alpha, round(ks, 6) AS ks FROM pl ORDER BY ks, xmin LIMIT 1")
def powerlaw_alpha_ks(t):
    return digits(powerlaw.best_fit(powerlaw.alpha_ks(stats.value_counts(und_degree(t), "degree"))), "alpha", "ks", places=6)


@query(POWER + "SELECT round(alpha, 6) AS alpha, (alpha > 2 AND alpha < 3) AS scale_free FROM pl ORDER BY ks, xmin LIMIT 1")
def powerlaw_verdict(t):
    fit = powerlaw.best_fit(powerlaw.alpha_ks(stats.value_counts(und_degree(t), "degree")))
    return fit.select(F.round("alpha", 6).alias("alpha"), ((F.col("alpha") > 2) & (F.col("alpha") < 3)).alias("scale_free"))


@query()
def powerlaw_vs_lognormal(t):
    h = cut(stats.value_counts(und_degree(t), "degree"))
    fit = powerlaw.best_fit(powerlaw.alpha_ks(h)).first()
    r, p = powerlaw.against_lognormal(h, fit["xmin"]) if fit else (0.0, 1.0)
    return h.sparkSession.createDataFrame([(r, p, not (r < 0 and p < 0.05))], "r double, p double, not_rejected boolean")


@query()
def scale_free_verdict(t):
    """Whether the exponent is between 2 and 3 and a lognormal is not clearly better."""
    h = cut(stats.value_counts(und_degree(t), "degree"))
    fit = powerlaw.best_fit(powerlaw.alpha_ks(h)).first()
    r, p = powerlaw.against_lognormal(h, fit["xmin"]) if fit else (0.0, 1.0)
    return h.sparkSession.createDataFrame([(bool(fit) and 2 < fit["alpha"] < 3 and not (r < 0 and p < 0.05),)], "scale_free boolean")


@query()
def louvain_consensus(t):
    """Share of eight detections of the sparse graph that put both ends of a pair together."""
    return pairs.consensus_share(t.pairs, cut(community.louvain_runs(t.e_sparse))).select("pair_id", "consensus")


@query()
def louvain(t):
    return community.louvain(t.e_und)


@query()
def leiden(t):
    return community.leiden(t.e_sparse)


def detected_q(edges, *seed):
    """Modularity of a detection; those of one query run side by side, as each waits for a single task most of the time."""
    labels = cut(community.louvain(edges, *seed))
    return community.modularity(edges, labels, graph.held(labels)).first()[0]


@query()
def louvain_stability(t):
    edges = community.placed_edges(t.e_und)
    with ThreadPoolExecutor(3) as beside:
        q = list(beside.map(lambda seed: detected_q(edges, seed), (42, 43, 44)))
    rows = t.spark.createDataFrame([(i, x) for i, x in enumerate(q)], "run int, q double")
    return rows.agg(F.min("q").alias("lowest"), F.max("q").alias("highest"), F.stddev_pop("q").alias("std_q"))


@query()
def config_null_q(t):
    """Modularity, its mean over three null graphs, and their ratio."""
    edges = community.placed_edges(t.e_und)
    real, nulls = detected_q(edges), []
    for seed in (1, 2, 3):  # one after the other: the files of one go before the next one
        let_go(t.spark)
        nulls.append(detected_q(null := community.placed_edges(lambda: community.configuration_null(edges, seed))))
        dropped(null)
    q = sum(nulls) / 3 if None not in nulls else None
    return t.spark.createDataFrame([(real, q, real / q if q else None)], "q double, null_q double, ratio double")
