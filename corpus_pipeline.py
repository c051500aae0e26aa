"""A corpus pipeline: five stages from raw documents to packed sequences."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.common import fresh, shared_folder
from orrery.llm.jaccard import link_documents
from orrery.llm.langid import identify
from orrery.llm.line_dedup import dedup_lines
from orrery.llm.mixing import mix_sources
from orrery.llm.packing import pack_documents

#: Language ID learns from the rows themselves, so SQL can't express the pipeline.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those without letters or with an ambiguous one go."""
    found = identify(docs, names=("__lang", "__share", "__ambiguous"), held="__held")
    return found.where((F.col("__lang") != "und") & ~F.col("__ambiguous")).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier one holds; n_chars follows the text."""
    return dedup_lines(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


#: Folders that stages wrote for themselves; run() removes them once the next stage is written.
OWN: list[str] = []


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a key of its own for each row, and the key's name; written to the shared folder as
    compressed Parquet, so the keys stay the same, whatever is read or run again."""
    key, path = fresh(docs, "key"), f"{shared_folder(docs.sparkSession)}/keyed-{uuid.uuid4().hex}"
    docs.withColumn(key, F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(path)
    OWN.append(path)
    return docs.sparkSession.read.parquet(path), key


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest row of each group of linked ones, by doc_id (null last), then text; rows
    that share an id or have none are rows of their own."""
    rows, key = keyed(docs)
    group = link_documents(rows, key).select(F.col(key).alias("key"), F.col("component_id").alias("group"))
    order = F.struct(F.col("doc_id").isNull(), F.coalesce(F.col("doc_id"), F.lit(0)), F.xxhash64("text"), F.col(key))
    ranked = rows.select(F.col(key).alias("key"), order.alias("order"))
    first = ranked.join(group, "key").groupBy("group").agg(F.min_by("key", "order").alias(key)).select(key)
    return rows.join(first, key, "left_semi").select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as many times as its source's target takes it, also those that share an id or have none."""
    rows, key = keyed(docs)
    often, copy = fresh(rows, "often"), fresh(rows, "copy")
    times = mix_sources(rows, id_col=key).where(F.col("times") > 0).select(key, F.col("times").alias(often))
    return rows.join(times, key).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(often)))).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the mix and the sequence that each is in."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("source_mix", source_mix),
    ("packing", packing),
]


def remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows.  What stages pass on is written to the shared folder and
    removed once the next stage is written; the last one cuts its own lineage first."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        for done in [*OWN, *filter(None, [before])]:
            remove(spark, done)
        OWN.clear()
        before = path
    packed = STAGES[-1][1](spark, docs, sf_dir)
    remove(spark, before)
    return packed
