"""Typed CSV sources and CSV and report sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODE_SCHEMA = T.StructType(
    [
        T.StructField("views", T.LongType()), T.StructField("mature", T.ByteType()), T.StructField("life_time", T.IntegerType()),
        T.StructField("created_at", T.DateType()), T.StructField("updated_at", T.DateType()), T.StructField("numeric_id", T.IntegerType()),
        T.StructField("dead_account", T.ByteType()), T.StructField("language", T.StringType()), T.StructField("affiliate", T.ByteType()),
    ]
)
EDGE_SCHEMA = "numeric_id_1 int, numeric_id_2 int"


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """Attributed nodes with log_views added."""
    return spark.read.schema(NODE_SCHEMA).option("header", True).csv(path).withColumn("log_views", F.log1p("views"))


def read_edges(spark: SparkSession, path: str, schema: str = EDGE_SCHEMA, drop_loops: bool = False) -> DataFrame:
    """(src, dst) of the first two columns as long; duplicates stay, self-loops on request go."""
    raw = spark.read.schema(schema).option("header", True).csv(path)
    edges = raw.select(F.col(raw.columns[0]).cast("long").alias("src"), F.col(raw.columns[1]).cast("long").alias("dst"))
    return edges.where("src <> dst") if drop_loops else edges


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(pair_id, u, v) of a test file with Id, Node1, Node2; pairs of one node stay."""
    return spark.read.schema("pair_id long, u long, v long").option("header", True).csv(path)


def write_predictions(df: DataFrame, path: str, key: str, value: str, header: tuple[str, str] = ("Id", "Category"), crlf: bool = True) -> None:
    """One CSV file in order of the key."""
    out = df.select(F.col(key).alias(header[0]), F.col(value).alias(header[1])).orderBy(header[0])
    writer = out.coalesce(1).write.mode("overwrite").option("header", True)
    (writer.option("lineSep", "\r\n") if crlf else writer).csv(path)


def fill_template(template: DataFrame, scored: DataFrame, key: str, value: str) -> DataFrame:
    """The template's rows with the score joined on the key, never by position."""
    return template.select(key).join(scored.select(key, value), key, "left")


def write_table(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def cell(x) -> str:
    if isinstance(x, float):
        return f"{x:,.4f}"
    return f"{x:,}" if isinstance(x, int) and not isinstance(x, bool) else "" if x is None else str(x)


def markdown_table(df: DataFrame, most: int = 100) -> str:
    """A result as a markdown table; where it has more than ``most`` rows, a last line says how many are left out."""
    rows = df.limit(most + 1).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    lines += ["| " + " | ".join(map(cell, r)) + " |" for r in rows[:most]]
    return "\n".join(lines + [f"({df.count() - most:,} rows more)"] * (len(rows) > most))


def percent(share: float, places: int = 1) -> str:
    return f"{100 * share:.{places}f}%"


def markdown_report(title: str, sections: list[tuple[str, str | DataFrame | dict]]) -> str:
    """A report of sections (heading, body): text as it is, a table from a DataFrame, a list from a dict of
    figures, where shares in a name's place ending in % are given in percent."""
    parts = [f"# {title}"]
    for heading, body in sections:
        if isinstance(body, DataFrame):
            body = markdown_table(body)
        elif isinstance(body, dict):
            body = "\n".join(f"- {k.removesuffix('%').strip()}: {percent(v) if k.endswith('%') else cell(v)}" for k, v in body.items())
        parts.append(f"## {heading}\n\n{body}")
    return "\n\n".join(parts) + "\n"


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One UTF-8 file at any path that Spark's file systems reach."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(target, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def write_blend(df: DataFrame, path: str, key: str, value: str, header: tuple[str, str] = ("ID", "Label")) -> tuple[float, float]:
    """A blend as ``write_predictions`` writes it; gives the range of its values."""
    write_predictions(df, path, key, value, header)
    return tuple(df.agg(F.min(value), F.max(value)).first())


def load_cached(spark: SparkSession, path: str, build, rebuild: bool = False) -> DataFrame:
    """The table that ``build()`` makes, from the Parquet folder ``path`` where it was written before."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    if rebuild or not folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(folder):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def checked_range(name: str, value: float, low: float, high: float) -> float:
    """``value``, if it lies strictly between the bounds; else an error names it."""
    if not low < value < high:
        raise ValueError(f"{name} is {value}, not between {low} and {high}")
    return value


def read_inferred(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header, its types found from the file."""
    return spark.read.option("header", True).option("inferSchema", True).csv(path)
