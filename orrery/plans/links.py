"""Pair features and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cohesion, graph, pairs, sampling
from ..session import stored
from .basics import digits
from .registry import query

#: Deterministic labels that stand for detected communities: the node's brand and size.
LABELS = "& lab AS (SELECT id, language AS community FROM node_attr), lab2 AS (SELECT id, CAST(life_time AS VARCHAR) AS community FROM node_attr), "


def brands(t):
    return t.node_attr.select("id", F.col("language").alias("community"))


def sizes(t):
    return t.node_attr.select("id", F.col("life_time").cast("string").alias("community"))


DIRECTED = """& nb AS MATERIALIZED (SELECT x, w, max(o) AS o, max(i) AS i FROM (SELECT src AS x, dst AS w, 1 AS o, 0 AS i FROM e_dir UNION ALL SELECT dst, src, 0, 1 FROM e_dir) GROUP BY x, w),
dg AS MATERIALIZED (SELECT x AS id, CAST(sum(o) AS BIGINT) AS od, CAST(sum(i) AS BIGINT) AS ind, count(*) AS ud FROM nb GROUP BY x),
ov AS (SELECT p.pair_id, CAST(sum(a.o * b.o) AS BIGINT) AS oo, CAST(sum(a.o * b.i) AS BIGINT) AS oi, CAST(sum(a.i * b.o) AS BIGINT) AS io, CAST(sum(a.i * b.i) AS BIGINT) AS ii, count(*) AS und,
  sum(CASE WHEN ud > 1 THEN 1 / ln(ud + 1e-9::double) END) AS aa_und, sum(CASE WHEN a.o * b.i = 1 AND od + ind > 1 THEN 1 / ln((od + ind)::double) END) AS aa_dir, sum(CASE WHEN a.o * b.i = 1 AND od > 0 THEN 1.0::double / od END) AS ra_dir
  FROM pairs p JOIN nb a ON a.x = p.u JOIN nb b ON b.x = p.v AND b.w = a.w JOIN dg ON dg.id = a.w GROUP BY p.pair_id),
f AS MATERIALIZED (SELECT p.pair_id, p.u, p.v, coalesce(oo, 0) AS oo, coalesce(oi, 0) AS oi, coalesce(io, 0) AS io, coalesce(ii, 0) AS ii, coalesce(und, 0) AS und, coalesce(aa_und, 0) AS aa_und, coalesce(aa_dir, 0) AS aa_dir, coalesce(ra_dir, 0) AS ra_dir,
  coalesce(du.od, 0) AS ou, coalesce(du.ind, 0) AS iu, coalesce(du.ud, 0) AS nu, coalesce(dv.od, 0) AS ov, coalesce(dv.ind, 0) AS iv, coalesce(dv.ud, 0) AS nv,
  CAST(e1.src IS NOT NULL AS INT) AS fwd, CAST(e2.src IS NOT NULL AS INT) AS back
  FROM pairs p LEFT JOIN ov ON ov.pair_id = p.pair_id LEFT JOIN dg du ON du.id = p.u LEFT JOIN dg dv ON dv.id = p.v
  LEFT JOIN e_dir e1 ON e1.src = p.u AND e1.dst = p.v LEFT JOIN e_dir e2 ON e2.src = p.v AND e2.dst = p.u) """


@query(DIRECTED + "SELECT pair_id, oo, oi, io, ii FROM f")
def common_neighbours_dir(t):
    return pairs.directed_overlaps(t.pairs, t.e_dir).select("pair_id", "oo", "oi", "io", "ii")


def und(name: str, edges: str) -> str:
    """Overlaps of pairs in the undirected graph ``edges``, as table f."""
    return f"""{name} dg AS MATERIALIZED (SELECT src AS id, count(*) AS d FROM {edges} GROUP BY src),
ov AS (SELECT p.pair_id, count(*) AS cn, sum(CASE WHEN d > 1 THEN 1 / ln(d::double) END) AS aa, sum(1.0::double / d) AS ra FROM pairs p JOIN {edges} a ON a.src = p.u JOIN {edges} b ON b.src = p.v AND b.dst = a.dst JOIN dg ON dg.id = a.dst GROUP BY p.pair_id),
f AS MATERIALIZED (SELECT p.pair_id, p.u, p.v, coalesce(cn, 0) AS cn, coalesce(aa, 0) AS aa, coalesce(ra, 0) AS ra, coalesce(du.d, 0) AS du, coalesce(dv.d, 0) AS dv, CAST(e.src IS NOT NULL AS INT) AS adj
  FROM pairs p LEFT JOIN ov ON ov.pair_id = p.pair_id LEFT JOIN dg du ON du.id = p.u LEFT JOIN dg dv ON dv.id = p.v LEFT JOIN {edges} e ON e.src = p.u AND e.dst = p.v) """


def overlaps(t):
    return pairs.undirected_overlaps(t.pairs, graph.symmetric(t.e_und))


@query(und("&", "s_und") + "SELECT pair_id, cn FROM f")
def common_neighbours_und(t):
    return overlaps(t).select("pair_id", "cn")


JACCARD = "CASE WHEN du + dv - cn <> 0 THEN cn::double / (du + dv - cn) ELSE 0 END"


@query(und("&", "s_und") + f"SELECT pair_id, round({JACCARD}, 8) AS jaccard FROM f")
def jaccard(t):
    c = F.col
    return overlaps(t).select("pair_id", F.round(pairs.ratio(c("cn"), c("degree_u") + c("degree_v") - c("cn")), 8).alias("jaccard"))


@query(und("&", "s_und") + "SELECT pair_id, round(aa, 8) AS adamic_adar FROM f")
def adamic_adar(t):
    return overlaps(t).select("pair_id", F.round("aa", 8).alias("adamic_adar"))


@query(und("&", "s_und") + "SELECT pair_id, round(ra, 8) AS resource_alloc FROM f")
def resource_alloc(t):
    return overlaps(t).select("pair_id", F.round("ra", 8).alias("resource_alloc"))


@query(und("&", "s_und") + "SELECT pair_id, du * dv AS pref_attach FROM f")
def pref_attach(t):
    return overlaps(t).select("pair_id", (F.col("degree_u") * F.col("degree_v")).alias("pref_attach"))


@query(DIRECTED + "SELECT pair_id, fwd AS forward, back AS backward, greatest(fwd, back) AS reciprocal FROM f")
def reciprocity(t):
    return pairs.edge_flags(t.pairs, t.e_dir).select("pair_id", "forward", "backward", F.greatest("forward", "backward").alias("reciprocal"))


@query(DIRECTED + """SELECT pair_id, ou AS out_u, iu AS in_u, ov AS out_v, iv AS in_v, oo AS cn_out_out, oi AS cn_out_in, io AS cn_in_out, ii AS cn_in_in, und AS cn_und,
round(CASE WHEN nu + nv - und <> 0 THEN und::double / (nu + nv - und) ELSE 0 END, 8) AS jaccard, round(aa_und, 8) AS adamic_adar, ou * iv AS pref_attach, nu * nv AS pref_attach_und, greatest(fwd, back) AS reciprocal, back AS v_follows_u, oi AS path2,
round(ou / (iu + 1), 8) AS hub_u, round(ov / (iv + 1), 8) AS hub_v, round(oo / (ou + 1), 8) AS katz_proxy FROM f""")
def model_a_features(t):
    return digits(pairs.model_a_features(t.pairs, t.e_dir), "jaccard", "adamic_adar", "hub_u", "hub_v", "katz_proxy")


@query(DIRECTED + """SELECT pair_id, oi AS out_in_common, io AS in_out_common, oo AS common_succ, ii AS common_pred, round(CASE WHEN ou + iv - oi <> 0 THEN oi::double / (ou + iv - oi) ELSE 0 END, 8) AS jaccard_out_in,
round(aa_dir, 8) AS adamic_adar, round(ra_dir, 8) AS resource_alloc_dir, round(CASE WHEN ou <> 0 THEN oi::double / ou ELSE 0 END, 8) AS triadic_closure, back AS reverse_exists, oi + io + oo + ii AS common_all,
ou AS out_deg_u, iu AS in_deg_u, ov AS out_deg_v, iv AS in_deg_v, ou + iu AS total_u, ov + iv AS total_v, ou * iv AS pref_attach, (ou + iu) * (ov + iv) AS pref_attach_total, round(ou / (iu + 1), 8) AS u_follow_ratio, round(ov / (iv + 1), 8) AS v_follow_ratio FROM f""")
def model_b_local_features(t):
    return digits(pairs.model_b_features(t.pairs, t.e_dir), "jaccard_out_in", "adamic_adar", "resource_alloc_dir", "triadic_closure", "u_follow_ratio", "v_follow_ratio")



def flag_joins(*labels: str) -> str:
    return "".join(f" LEFT JOIN {n} {n}u ON {n}u.id = f.u LEFT JOIN {n} {n}v ON {n}v.id = f.v" for n in labels)


def same(n: str) -> str:
    return f"coalesce(CAST({n}u.community = {n}v.community AS INT), 0)"


SPARSE = und(LABELS, "s_sparse")


@query(SPARSE + f"""SELECT pair_id, cn, round({JACCARD}, 8) AS jaccard, round(aa, 8) AS adamic_adar, round(CASE WHEN du > 0 AND dv > 0 THEN ln(greatest(du * dv, 1)::double) ELSE 0 END, 8) AS log_pa,
CASE WHEN du > 0 AND dv > 0 THEN {same('lab')} ELSE 0 END AS same_brand, CASE WHEN du > 0 AND dv > 0 THEN {same('lab2')} ELSE 0 END AS same_size FROM f""" + flag_joins("lab", "lab2"))
def tuned_features(t):
    f = pairs.tuned_features(t.pairs, graph.symmetric(t.e_sparse), [(brands(t), "community", "same_brand"), (sizes(t), "community", "same_size")])
    return digits(f, "jaccard", "adamic_adar", "log_pa")


DISTANCE = """, nu AS (SELECT p.pair_id, s.dst AS x FROM pairs p JOIN s_sparse s ON s.src = p.u), nv AS (SELECT p.pair_id, s.dst AS y FROM pairs p JOIN s_sparse s ON s.src = p.v),
hit AS (SELECT p.pair_id, 1 AS d FROM pairs p JOIN s_sparse s ON s.src = p.u AND s.dst = p.v UNION ALL SELECT nu.pair_id, 2 FROM nu JOIN nv ON nu.pair_id = nv.pair_id AND x = y
  UNION ALL SELECT nu.pair_id, 4 FROM nu JOIN s_sparse s ON s.src = nu.x JOIN nv ON nv.pair_id = nu.pair_id AND nv.y = s.dst),
sp AS MATERIALIZED (SELECT p.pair_id, CASE WHEN p.u = p.v THEN 0 ELSE coalesce(m.d, 5) END AS short_path FROM pairs p LEFT JOIN (SELECT pair_id, min(d) AS d FROM hit GROUP BY pair_id) m ON m.pair_id = p.pair_id) """


@query(SPARSE + DISTANCE + "SELECT p.pair_id, p.u, p.v, short_path FROM pairs p JOIN sp ON sp.pair_id = p.pair_id")
def capped_distance(t):
    return cohesion.short_path(t.pairs, graph.symmetric(t.e_sparse)).select("pair_id", "u", "v", "short_path")


@query(SPARSE + DISTANCE + f"""SELECT f.pair_id, cn, round({JACCARD}, 8) AS jaccard, round(aa, 8) AS adamic_adar, round(ra, 8) AS resource_alloc, round(ln(greatest(du * dv, 1)::double), 8) AS log_pa, short_path,
{same('lab')} AS same_brand, {same('lab2')} AS same_size, round(ln(du + 1.0::double), 8) AS log_deg_u, round(ln(dv + 1.0::double), 8) AS log_deg_v FROM f JOIN sp ON sp.pair_id = f.pair_id""" + flag_joins("lab", "lab2"))
def hidden_edge_features(t):
    sym = graph.symmetric(t.e_sparse)
    f = pairs.hidden_edge_features(t.pairs, sym, [(brands(t), "community", "same_brand"), (sizes(t), "community", "same_size")], cohesion.short_path(t.pairs, sym))
    return digits(f, "jaccard", "adamic_adar", "resource_alloc", "log_pa", "log_deg_u", "log_deg_v")


@query("SELECT pair_id, u, v FROM pairs p WHERE u <> v AND NOT EXISTS (SELECT 1 FROM e_dir e WHERE e.src = p.u AND e.dst = p.v)")
def non_edges_anti(t):
    edge = t.e_dir.select(F.col("src").alias("u"), F.col("dst").alias("v"))
    return t.pairs.where("u <> v").join(edge, ["u", "v"], "left_anti").select("pair_id", "u", "v")


def drawn(*key: str) -> str:
    return "CAST(('0x' || substr(md5(" + " || '_' || ".join(f"CAST({k} AS VARCHAR)" for k in key) + "), 1, 8)) AS BIGINT)"


def negatives(n: str, seed: str, name: str) -> str:
    """Tables of the first n random non-edges of two draws a row."""
    size = "(SELECT count(*) FROM idx)"
    return f"""{name}c AS MATERIALIZED (SELECT k, {drawn(f"'{seed}'", "'u'", "k")} % {size} AS iu, {drawn(f"'{seed}'", "'v'", "k")} % {size} AS iv FROM (SELECT unnest(range(1, CAST(2 * {n} + 1 AS BIGINT))) AS k)),
{name} AS MATERIALIZED (SELECT u, v, k FROM (SELECT a.id AS u, b.id AS v, k, row_number() OVER (ORDER BY k) AS rn FROM {name}c JOIN idx a ON a.idx = iu JOIN idx b ON b.idx = iv
  WHERE a.id <> b.id AND NOT EXISTS (SELECT 1 FROM e_dir e WHERE e.src = a.id AND e.dst = b.id)) WHERE rn <= {n})"""


INDEX = "& idx AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id) - 1 AS idx FROM (SELECT src AS id FROM e_dir UNION SELECT dst FROM e_dir)), "
EDGES = "(SELECT count(*) FROM e_dir)"
HARD = f"""h AS MATERIALIZED (SELECT u, v, k FROM (SELECT u, v, k, row_number() OVER (ORDER BY k, u, v) AS rn FROM (SELECT u, v, {drawn("'42'", "u", "v")} AS k FROM (
  SELECT DISTINCT x.src AS u, y.dst AS v FROM e_dir x JOIN e_dir y ON x.dst = y.src WHERE x.src <> y.dst) p WHERE NOT EXISTS (SELECT 1 FROM e_dir e WHERE e.src = p.u AND e.dst = p.v))) WHERE rn <= CAST(floor({EDGES} * 0.3::double) AS BIGINT))"""


@query(INDEX + negatives(EDGES, "42", "r") + " SELECT u, v, k FROM r")
def random_negatives(t):
    return sampling.random_negatives(t.e_dir, t.e_dir.count())


@query(INDEX + HARD + " SELECT u, v, k FROM h")
def hard_negatives(t):
    edges = stored(t.e_dir)
    return sampling.hard_negatives(edges, int(edges.count() * 0.3))


@query(INDEX + HARD + ", " + negatives(f"({EDGES} - CAST(floor({EDGES} * 0.3::double) AS BIGINT))", "43", "r") + " SELECT u, v, 1 AS hard FROM h UNION ALL SELECT u, v, 0 FROM r")
def mixed_negatives(t):
    edges = stored(t.e_dir)
    return sampling.mixed_negatives(edges, edges.count())


COMPONENTS = """cc AS MATERIALIZED (SELECT id, min(c) AS component FROM reach GROUP BY id) """
REACH = "& reach AS (SELECT src AS id, src AS c FROM s_sparse UNION SELECT s.dst, r.c FROM reach r JOIN s_sparse s ON s.src = r.id WHERE r.c < s.dst), " + COMPONENTS


def cross(n: str) -> str:
    return f""", big AS MATERIALIZED (SELECT component, size, row_number() OVER (ORDER BY component) - 1 AS c FROM (SELECT component, count(*) AS size FROM cc GROUP BY component) WHERE size >= 50),
mem AS MATERIALIZED (SELECT c, row_number() OVER (PARTITION BY cc.component ORDER BY id) - 1 AS i, id FROM cc JOIN big ON big.component = cc.component),
dr AS (SELECT k, d.c, {drawn("'42'", "'u'", "k")} % size AS iu, {drawn("'42'", "'v'", "k")} % size AS iv FROM (SELECT k, {drawn("'42'", "'c'", "k")} % (SELECT count(*) FROM big) AS c FROM (SELECT unnest(range(1, CAST(4 * {n} + 1 AS BIGINT))) AS k)) d JOIN big ON big.c = d.c)
SELECT u, v, k FROM (SELECT a.id AS u, b.id AS v, k, row_number() OVER (ORDER BY k) AS rn FROM dr JOIN mem a ON a.c = dr.c AND a.i = iu JOIN mem b ON b.c = dr.c AND b.i = iv JOIN node_attr x ON x.id = a.id JOIN node_attr y ON y.id = b.id
WHERE a.id <> b.id AND x.language <> y.language AND NOT EXISTS (SELECT 1 FROM s_sparse s WHERE s.src = a.id AND s.dst = b.id)) WHERE rn <= {n}"""


@query(REACH + "SELECT id, component FROM cc")
def connected_components(t):
    return cohesion.components(t.e_sparse)


@query(REACH + cross("(SELECT count(*) FROM e_sparse)"))
def cross_partition_negatives(t):
    sym = graph.symmetric(t.e_sparse)
    return sampling.cross_partition_negatives(sym, cohesion.components(t.e_sparse), brands(t), t.e_sparse.count())


@query(f"& o AS (SELECT a, b, row_number() OVER (ORDER BY {drawn(chr(39) + '42' + chr(39), 'a', 'b')}, a, b) AS rn FROM e_sparse) SELECT a, b, CAST(rn > 60 AS INT) AS hidden FROM o WHERE rn <= 120")
def pos_visible_hidden(t):
    seen, hidden = sampling.sample_edges(t.e_sparse, 60), sampling.sample_edges(t.e_sparse, 60, skip=60)
    return seen.withColumn("hidden", F.lit(0)).unionAll(hidden.withColumn("hidden", F.lit(1)))


@query(INDEX + negatives(EDGES, "42", "r") + " SELECT src AS u, dst AS v, 1 AS label FROM e_dir UNION ALL SELECT u, v, 0 FROM r")
def train_union(t):
    return sampling.training_union(t.e_dir.toDF("u", "v"), sampling.random_negatives(t.e_dir, t.e_dir.count()))


@query(REACH + ", f AS (SELECT * FROM pairs) SELECT pair_id, coalesce(CAST(x.component = y.component AS INT), 0) AS same_component FROM f LEFT JOIN cc x ON x.id = f.u LEFT JOIN cc y ON y.id = f.v")
def same_component_flag(t):
    return pairs.common_labels(t.pairs, cohesion.components(t.e_sparse), "component", "same_component").select("pair_id", "same_component")
