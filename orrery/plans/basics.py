"""Scans, projections, degrees and descriptive statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats
from ..functions.ordering import avg_rank as add_avg_rank
from ..functions.ordering import pct_rank as add_pct_rank
from ..functions.ordering import quantiles as exact_quantiles
from ..functions.ordering import top_n_cut
from ..operators import blend, cohesion, graph, walks
from ..session import cut
from .registry import query

ATTRIBUTES = ["views", "life_time", "affiliate", "dead_account", "mature"]
DEGREES = "& d AS (SELECT src AS id, count(*) AS degree FROM s_und GROUP BY src) "


def digits(df, *columns: str, places: int = 8):
    return df.withColumns({c: F.round(F.col(c), places) for c in columns})


@query("SELECT *, round(ln(1 + views), 8) AS log_views FROM node_attr")
def node_scan_log1p(t):
    return t.node_attr.withColumn("log_views", F.round(F.log1p("views"), 8))


@query("SELECT src, dst FROM e_dir")
def edge_scan_distinct(t):
    return t.e_dir


@query("SELECT src, dst FROM steps WHERE src <> dst")
def self_loop_filter(t):
    return t.steps.where("src <> dst").select("src", "dst")


@query("SELECT pair_id, u, v FROM pairs")
def pair_scan(t):
    return t.pairs


@query("SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM steps WHERE src <> dst")
def edge_canonical(t):
    return graph.canonical(t.steps)


@query("SELECT src, dst FROM s_und")
def symmetric_edges(t):
    return graph.symmetric(t.e_und)


@query("SELECT id, row_number() OVER (ORDER BY id) - 1 AS idx FROM (SELECT DISTINCT src AS id FROM s_und)")
def dense_index(t):
    return graph.dense_index(t.e_und)


@query("SELECT count(*) AS n, min(p_partkey) AS lowest, max(p_partkey) AS highest, (min(p_partkey) = 0 AND max(p_partkey) = count(*) - 1 AND count(DISTINCT p_partkey) = count(*)) AS contiguous FROM part", views=False)
def contiguity_check(t):
    return graph.contiguity(t.read("part"), "p_partkey")


@query("SELECT (SELECT count(DISTINCT src) FROM s_und) AS vertices, (SELECT count(*) FROM e_und) AS edges, (SELECT count(*) FROM e_dir) AS directed_edges")
def graph_counts(t):
    n = graph.nodes(t.e_und).agg(F.count(F.lit(1)).alias("vertices"))
    return n.crossJoin(t.e_und.agg(F.count(F.lit(1)).alias("edges"))).crossJoin(t.e_dir.agg(F.count(F.lit(1)).alias("directed_edges")))


@query("SELECT id, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (SELECT src AS id, 1 AS o, 0 AS i FROM e_dir UNION ALL SELECT dst, 0, 1 FROM e_dir) GROUP BY id")
def out_in_degree(t):
    return graph.directed_degrees(t.e_dir)


@query(DEGREES + "SELECT id, degree FROM d")
def und_degree(t):
    return graph.degrees(graph.symmetric(t.e_und))


@query(DEGREES + "SELECT degree, count(*) AS n FROM d GROUP BY degree")
def degree_histogram(t):
    return stats.value_counts(und_degree(t), "degree")


@query(DEGREES + "SELECT degree, n, round(sum(n) OVER (ORDER BY degree DESC) / sum(n) OVER (), 8) AS ccdf FROM (SELECT degree, count(*) AS n FROM d GROUP BY degree)")
def degree_ccdf(t):
    return digits(stats.ccdf(und_degree(t), "degree"), "ccdf")


@query(DEGREES + "SELECT count(*) AS vertices, CAST(sum(degree) / 2 AS BIGINT) AS edges, round(sum(degree) / count(*), 8) AS mean_degree, max(degree) AS max_degree, round(sum(degree) / (count(*) * (count(*) - 1))::double, 8) AS density FROM d")
def density_mean_max(t):
    return digits(graph.density(t.e_und), "mean_degree", "density")


@query("SELECT round(avg(affiliate), 8) AS affiliate_rate, round(avg(dead_account), 8) AS churn_rate, round(avg(mature), 8) AS mature_rate FROM node_attr")
def flag_rates(t):
    return t.node_attr.agg(*[F.round(F.avg(c), 8).alias(n) for c, n in (("affiliate", "affiliate_rate"), ("dead_account", "churn_rate"), ("mature", "mature_rate"))])


@query("SELECT language, count(*) AS n FROM node_attr GROUP BY language")
def value_counts(t):
    return stats.value_counts(t.node_attr, "language")


@query("SELECT language AS top, round(n / sum(n) OVER (), 8) AS share, count(*) OVER () AS n_values FROM (SELECT language, count(*) AS n FROM node_attr GROUP BY language) ORDER BY n DESC, language LIMIT 1")
def dominant_share(t):
    return digits(stats.mode_share(t.node_attr, "language"), "share")


@query("SELECT CASE WHEN r <= 10 THEN language ELSE '(other)' END AS language, CAST(sum(n) AS BIGINT) AS n FROM (SELECT language, n, row_number() OVER (ORDER BY n DESC, language) AS r FROM (SELECT language, count(*) AS n FROM node_attr GROUP BY language)) GROUP BY 1")
def top10_other(t):
    return stats.top_other(t.node_attr, "language", 10)


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c})::double AS min, round(quantile_cont({c}::double, 0.25), 6) AS q25, round(quantile_cont({c}::double, 0.5), 6) AS q50, round(quantile_cont({c}::double, 0.75), 6) AS q75, max({c})::double AS max FROM node_attr" for c in ATTRIBUTES))
def describe_numeric(t):
    return digits(stats.describe(t.node_attr, ATTRIBUTES), "mean", "std", "q25", "q50", "q75", places=6)


@query("SELECT round(quantile_cont(p1, 0.5), 6) AS p1_q50, round(quantile_cont(p1, 0.9), 6) AS p1_q90, round(quantile_cont(p1, 0.99), 6) AS p1_q99, round(quantile_cont(p2, 0.5), 6) AS p2_q50, round(quantile_cont(p2, 0.9), 6) AS p2_q90, round(quantile_cont(p2, 0.99), 6) AS p2_q99 FROM scores")
def quantiles(t):
    one, two = (exact_quantiles(t.scores, p, [0.5, 0.9, 0.99]).select(*[F.round(F.col("q")[i], 6).alias(f"{p}_q{n}") for i, n in enumerate((50, 90, 99))]) for p in ("p1", "p2"))
    return one.crossJoin(F.broadcast(two))


CLUSTERING = """& d AS MATERIALIZED (SELECT src AS id, count(*) AS degree FROM s_und GROUP BY src),
tri AS MATERIALIZED (SELECT x.a, x.b, y.b AS c FROM e_und x JOIN e_und y ON x.b = y.a JOIN e_und z ON z.a = x.a AND z.b = y.b),
nt AS (SELECT id, count(*) AS t FROM (SELECT unnest([a, b, c]) AS id FROM tri) GROUP BY id),
lc AS MATERIALIZED (SELECT d.id, d.degree, coalesce(nt.t, 0) AS triangles, CASE WHEN degree > 1 THEN 2.0::double * coalesce(nt.t, 0) / (degree * (degree - 1)) ELSE 0::double END AS clustering FROM d LEFT JOIN nt ON nt.id = d.id) """


def histogram_sql(source: str, column: str, bins: int) -> str:
    return f"""SELECT bin, round(min(low), 8) AS low, count(*) AS n FROM (SELECT CAST(CASE WHEN w > 0 THEN least(floor((x - lo) / w), {bins - 1}) ELSE 0 END AS BIGINT) AS bin, lo + bin * w AS low
FROM (SELECT {column} AS x, lo, (hi - lo) / {bins}::double AS w FROM {source}, (SELECT min({column}) AS lo, max({column}) AS hi FROM {source}))) GROUP BY bin"""


@query(CLUSTERING + histogram_sql("lc", "clustering", 50))
def histogram_50(t):
    return digits(stats.histogram(cohesion.local_clustering(t.e_und), "clustering", 50), "low")


@query("& lv AS (SELECT log10(views) AS lv FROM node_attr WHERE views > 0) " + histogram_sql("lv", "lv", 60))
def histogram_60_log10(t):
    return digits(stats.histogram(t.node_attr.where("views > 0").select(F.log10("views").alias("lv")), "lv", 60), "low")


@query("SELECT median(views) AS median_views, median(life_time) AS median_life_time FROM node_attr")
def exact_median(t):
    one, two = (exact_quantiles(t.node_attr, c, [0.5]).select(F.col("q")[0].alias(f"median_{c}")) for c in ("views", "life_time"))
    return one.crossJoin(F.broadcast(two))


STRUCTURAL, MEASURED = ["degree", "pagerank", "local_clustering"], ["log_views", "affiliate", "life_time"]
CORRELATED = STRUCTURAL + MEASURED
#: Rounds of the PageRank in SQL; on these graphs later rounds change no shown digit.
SQL_ROUNDS = 40
UNDIRECTED_RANK = "nn AS (SELECT count(*)::double AS n FROM d), pr0 AS MATERIALIZED (SELECT id, 1.0::double / n AS r FROM d, nn)" + "".join(
    f", pr{k} AS MATERIALIZED (SELECT d.id, 0.15::double / n + 0.85::double * coalesce(g.got, 0) AS r FROM d CROSS JOIN nn LEFT JOIN (SELECT s.dst AS id, sum(p.r / d.degree) AS got FROM s_und s JOIN pr{k - 1} p ON p.id = s.src JOIN d ON d.id = s.src GROUP BY s.dst) g ON g.id = d.id)"
    for k in range(1, SQL_ROUNDS + 1)
)
METRICS = f"""{CLUSTERING}, {UNDIRECTED_RANK}, mt AS MATERIALIZED (SELECT lc.id, lc.degree::double AS degree, round(pr{SQL_ROUNDS}.r, 9) AS pagerank, round(lc.clustering, 8) AS local_clustering,
ln(1 + views) AS log_views, affiliate::double AS affiliate, life_time::double AS life_time FROM lc JOIN pr{SQL_ROUNDS} ON pr{SQL_ROUNDS}.id = lc.id JOIN node_attr n ON n.id = lc.id) """


def metrics(t):
    """Each node's degree, PageRank and local clustering on the undirected graph beside its attributes."""
    sym = cut(graph.symmetric(t.e_und))
    rank = walks.pagerank(sym).select("id", F.round("pagerank", 9).alias("pagerank"))
    local = cohesion.local_clustering(t.e_und).select("id", "degree", F.round("clustering", 8).alias("local_clustering"))
    both = local.join(rank, "id").join(t.node_attr, "id").withColumn("log_views", F.log1p("views"))
    return cut(both.select("id", *[F.col(c).cast("double").alias(c) for c in CORRELATED]))


@query(METRICS + "SELECT id, degree, pagerank, local_clustering, round(log_views, 8) AS log_views, affiliate, life_time FROM mt")
def node_metrics(t):
    return digits(metrics(t), "log_views")


def matrix_sql(source: str) -> str:
    return " UNION ALL ".join(f"SELECT '{x}' AS x, '{y}' AS y, round(corr({x}, {y}), 6) + 0::double AS corr FROM {source}" for x in CORRELATED for y in CORRELATED)


def ranked_sql(source: str) -> str:
    cols = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::double AS {c}" for c in CORRELATED)
    return f", rk AS MATERIALIZED (SELECT {cols} FROM {source}) "


@query(METRICS + matrix_sql("mt"))
def pearson_matrix(t):
    return digits(stats.pearson_matrix(metrics(t), CORRELATED), "corr", places=6)


@query(METRICS + ranked_sql("mt") + matrix_sql("rk"))
def spearman_matrix(t):
    return digits(stats.spearman_matrix(metrics(t), CORRELATED), "corr", places=6)


RANKS = "& r AS MATERIALIZED (SELECT id, p1, p2, label, rank() OVER (ORDER BY p1) + (count(*) OVER (PARTITION BY p1) - 1) / 2.0::double AS r1, rank() OVER (ORDER BY p2) + (count(*) OVER (PARTITION BY p2) - 1) / 2.0::double AS r2, count(*) OVER () AS n FROM scores) "


@query(RANKS + "SELECT round(corr(r1, r2), 8) + 0::double AS spearman FROM r")
def spearman_pair(t):
    return digits(stats.spearman(t.scores, "p1", "p2"), "spearman")


BLOCK = f"x IN ({', '.join(map(repr, STRUCTURAL))}) AND y IN ({', '.join(map(repr, MEASURED))})"


@query(METRICS + ranked_sql("mt") + ", mx AS (" + matrix_sql("rk") + f") SELECT x, y, corr FROM mx WHERE {BLOCK} ORDER BY abs(corr) DESC, x, y LIMIT 1")
def strongest_pair(t):
    return stats.strongest(spearman_matrix(t), STRUCTURAL, MEASURED)


RANKS = "& r AS MATERIALIZED (SELECT id, p1, p2, label, rank() OVER (ORDER BY p1) + (count(*) OVER (PARTITION BY p1) - 1) / 2.0::double AS r1, rank() OVER (ORDER BY p2) + (count(*) OVER (PARTITION BY p2) - 1) / 2.0::double AS r2, count(*) OVER () AS n FROM scores) "


@query(RANKS + "SELECT round(corr(r1, r2), 8) + 0::double AS spearman FROM r")
def spearman_pair(t):
    return digits(stats.spearman(t.scores, "p1", "p2"), "spearman")


@query(METRICS + ranked_sql("mt") + ", mx AS (" + matrix_sql("rk") + ") SELECT x, y, corr FROM mx WHERE x = 'degree' AND y <> 'degree' ORDER BY abs(corr) DESC, x, y LIMIT 1")
def strongest_pair(t):
    return stats.strongest(spearman_matrix(t), ["degree"], CORRELATED[1:])


@query(RANKS + "SELECT id, r1, r2 FROM r")
def avg_rank(t):
    return add_avg_rank(add_avg_rank(t.scores, "p1", "r1"), "p2", "r2").select("id", "r1", "r2")


@query(RANKS + "SELECT id, round(r1 / n, 8) AS r1, round(r2 / n, 8) AS r2 FROM r")
def pct_rank(t):
    return digits(add_pct_rank(add_pct_rank(t.scores, "p1", "r1"), "p2", "r2").select("id", "r1", "r2"), "r1", "r2")


@query("SELECT id, CAST(row_number() OVER (ORDER BY p2 DESC, id) <= 40 AS INT) AS predicted FROM scores")
def topn_cut(t):
    return top_n_cut(t.scores, "p2", "id", 40, "predicted").select("id", "predicted")


@query(RANKS + "SELECT round(corr(r1, r2), 8) AS spearman, quantile_cont(p1, 0.5) AS a_q50, round(quantile_cont(p1, 0.9), 6) AS a_q90, round(quantile_cont(p1, 0.99), 6) AS a_q99, quantile_cont(p2, 0.5) AS b_q50, round(quantile_cont(p2, 0.9), 6) AS b_q90, round(quantile_cont(p2, 0.99), 6) AS b_q99, count(*) FILTER (WHERE abs(r1 / n - r2 / n) > 0.5::double) AS strong, round(avg(CAST(abs(r1 / n - r2 / n) > 0.5::double AS INT)), 8) AS strong_share FROM r")
def rank_disagreement(t):
    return digits(digits(blend.disagreement(t.scores, "p1", "p2"), "spearman", "strong_share"), "a_q90", "a_q99", "b_q90", "b_q99", places=6)


@query(RANKS + "SELECT id, round(0.8::double * (r1 / n) + 0.2::double * (r2 / n), 8) AS blend FROM r")
def rank_blend_80_20(t):
    return digits(blend.rank_blend(t.scores, "p1", "p2", 0.8).select("id", "blend"), "blend")


@query(RANKS + "SELECT id, round(0.9::double * (r1 / n) + 0.1::double * (r2 / n), 8) AS blend FROM r")
def rank_blend_90_10(t):
    return digits(blend.rank_blend(t.scores, "p1", "p2", 0.9).select("id", "blend"), "blend")


@query(RANKS + "SELECT id, round((r1 * 3 + r2 * 1) / 4, 8) AS blend FROM r")
def weighted_rank_avg(t):
    return digits(blend.weighted_rank_average(t.scores, ["p1", "p2"], [3, 1]).select("id", "blend"), "blend")


@query("& b AS (SELECT id, p1 * 0.3::double + p2 * 0.7::double AS blend FROM scores) SELECT id, round(blend, 6) AS blend, CAST(row_number() OVER (ORDER BY blend DESC, id) <= 40 AS INT) AS predicted FROM b")
def prob_blend_topn(t):
    return digits(blend.probability_blend(t.scores, ["p1", "p2"], [0.3, 0.7], 40, "id").select("id", "blend", "predicted"), "blend", places=6)


@query("SELECT min(p1) AS lowest, max(p1) AS highest, round(avg(p1), 6) AS mean, CAST(sum(CAST(p1 > 1000 AS INT)) AS BIGINT) AS positives, round(avg(CAST((p1 > 1000) = (label = 1) AS INT)), 8) AS accuracy FROM scores")
def score_summary(t):
    positive = F.col("p1") > 1000
    return t.scores.agg(
        F.min("p1").alias("lowest"), F.max("p1").alias("highest"), F.round(F.avg("p1"), 6).alias("mean"),
        F.sum(positive.cast("long")).alias("positives"), F.round(F.avg((positive == (F.col("label") == 1)).cast("double")), 8).alias("accuracy"),
    )


@query("SELECT count(*) FILTER (WHERE l.doc_id IS NULL OR d.doc_id IS NULL) AS unmatched, (count(*) FILTER (WHERE l.doc_id IS NULL OR d.doc_id IS NULL)) = 0 AS aligned FROM labels l FULL JOIN documents d ON l.doc_id = d.doc_id", views=False)
def id_alignment(t):
    return blend.aligned(t.read("labels"), t.read("documents"), "doc_id")
