"""Tables of a folder and the graphs derived from them."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Tables:
    """Parquet tables of ``folder`` by name, and views of them as graphs.

    ``steps`` are consecutive items of an order; ``e_dir`` their directed simple graph,
    ``e_und`` its undirected projection; ``e_sparse`` is undirected over steps between two
    returned and finished lines, with many components.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def steps(self) -> DataFrame:
        along = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")
        lost = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")
        return self.read("lineitem").select(
            "l_orderkey", F.col("l_partkey").alias("src"), F.lead("l_partkey").over(along).alias("dst"),
            (lost & F.lead(lost).over(along)).alias("returned"),
        ).where("dst is not null")

    @cached_property
    def e_dir(self) -> DataFrame:
        return self.steps.where("src <> dst").select("src", "dst").distinct()

    @cached_property
    def e_und(self) -> DataFrame:
        return self.steps.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()

    @cached_property
    def e_sparse(self) -> DataFrame:
        return self.steps.where("src <> dst and returned").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()

    @cached_property
    def node_attr(self) -> DataFrame:
        size = F.col("p_size")
        return self.read("part").select(
            F.col("p_partkey").alias("id"), F.col("p_brand").alias("language"), F.floor("p_retailprice").cast("long").alias("views"),
            size.alias("life_time"), (size > 25).cast("int").alias("affiliate"), (size % 10 == 0).cast("int").alias("dead_account"),
            (F.col("p_partkey") % 2).cast("int").alias("mature"),
        )

    @cached_property
    def pairs(self) -> DataFrame:
        part = self.read("part")
        rows = part.agg(F.count(F.lit(1)).alias("n"))
        n = rows.first()["n"] + 50
        key = F.col("p_partkey")
        return part.select(key.alias("pair_id"), key.alias("u"), ((key * 7 + 13) % F.lit(n)).alias("v"))

    @cached_property
    def seed_pairs(self) -> DataFrame:
        """For each brand its two cheapest parts, as a pair."""
        cheap = Window.partitionBy("p_brand").orderBy("p_retailprice", "p_partkey")
        two = self.read("part").withColumn("r", F.row_number().over(cheap)).where("r <= 2")
        pair = two.groupBy("p_brand").agg(F.min("p_partkey").alias("u"), F.max("p_partkey").alias("v")).where("u < v")
        return pair.select(F.col("u").alias("pair_id"), "u", "v")

    @cached_property
    def scores(self) -> DataFrame:
        labels = self.read("labels").select("doc_id", "quality")
        return self.read("documents").select("doc_id", "n_chars").join(labels, "doc_id").select(
            F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("p1"),
            ((F.col("doc_id") * 7919) % 101).cast("double").alias("p2"), F.col("quality").alias("label"),
        )


#: The same views for an SQL engine, as the head of a query.
VIEWS = """
WITH RECURSIVE steps AS (
  SELECT * FROM (SELECT l_orderkey, l_partkey AS src, lead(l_partkey) OVER o AS dst,
    (l_returnflag = 'R' AND l_linestatus = 'F' AND lead(l_returnflag = 'R' AND l_linestatus = 'F') OVER o) AS returned
  FROM lineitem WINDOW o AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus)) WHERE dst IS NOT NULL),
e_dir AS MATERIALIZED (SELECT DISTINCT src, dst FROM steps WHERE src <> dst),
e_und AS MATERIALIZED (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e_dir),
e_sparse AS MATERIALIZED (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM steps WHERE src <> dst AND returned),
s_und AS (SELECT a AS src, b AS dst FROM e_und UNION ALL SELECT b, a FROM e_und),
s_sparse AS (SELECT a AS src, b AS dst FROM e_sparse UNION ALL SELECT b, a FROM e_sparse),
node_attr AS (SELECT p_partkey AS id, p_brand AS language, CAST(floor(p_retailprice) AS BIGINT) AS views, p_size AS life_time,
  CAST(p_size > 25 AS INT) AS affiliate, CAST(p_size % 10 = 0 AS INT) AS dead_account, CAST(p_partkey % 2 AS INT) AS mature FROM part),
pairs AS (SELECT p_partkey AS pair_id, p_partkey AS u, (p_partkey * 7 + 13) % ((SELECT count(*) FROM part) + 50) AS v FROM part),
seed_pairs AS (SELECT min(p_partkey) AS pair_id, min(p_partkey) AS u, max(p_partkey) AS v FROM (
  SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS r FROM part) WHERE r <= 2
  GROUP BY p_brand HAVING min(p_partkey) < max(p_partkey)),
scores AS (SELECT d.doc_id AS id, CAST(d.n_chars AS DOUBLE) AS p1, CAST((d.doc_id * 7919) % 101 AS DOUBLE) AS p2, l.quality AS label
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
"""
