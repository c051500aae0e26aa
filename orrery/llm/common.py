"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The white space that separates words: space, and tab to carriage return.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word hasher forgets its words beyond this number, so a worker's memory is bounded.
HASHER_WORDS = 400_000
U64 = np.uint64


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a folder of our own is set only where none
    is and the master is local (single-machine tests): elsewhere executors could not see it."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="orrery-checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage.

    The size estimate of the old plan goes too: a checkpoint hands it on, and the joins of a
    loop multiply it, so its digits would double in a round.  Adaptive execution sees real sizes.
    """
    spark = df.sparkSession
    shared_folder(spark)
    done = df.checkpoint(eager=True)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(done.queryExecution().toRdd(), done.schema(), False), spark)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a name made from it that no column of ``df`` has."""
    there = {c.lower() for c in df.columns}
    while name.lower() in there:
        name = f"_{name}"
    return name


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def fan_out(df: DataFrame) -> int:
    """The session's shuffle width, as the number of salts for a hot key."""
    return max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def gapless_rank(df: DataFrame, keys: list[str], order: list[str], out: str, salts: int | None = None) -> DataFrame:
    """Number the rows of each key from 0 without gaps, as column ``out``.

    A key's rows are dealt over ``salts`` tasks by a hash of ``order`` and of the partition they
    lie in; each task ranks its own rows and adds the rows of the salts before it, so a key that
    holds most rows is never gathered in one task, nor are rows equal in ``order``.  ``df`` is
    read twice: cut it first.  Keys must not be null.
    """
    salts = salts or fan_out(df)
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*order, F.spark_partition_id()), F.lit(salts)))
    before = Window.partitionBy(*keys).orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        salted.groupBy(*keys, "__salt").agg(F.count(F.lit(1)).alias("__n"))
        .select(*keys, "__salt", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    )
    within = Window.partitionBy(*keys, "__salt").orderBy(*order)
    ranked = salted.withColumn("__row", F.row_number().over(within).cast("long") - 1)
    return (
        ranked.join(offsets, [*keys, "__salt"])
        .withColumn(out, F.col("__row") + F.col("__before"))
        .drop("__salt", "__row", "__before")
    )


class WordHasher(dict):
    """64-bit hash of each word (bytes), kept for words seen before."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > HASHER_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), U64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def window_hashes(words: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hash of every run of ``width`` consecutive word hashes."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, U64)
    total = np.zeros(n, U64)
    odd = mix64(np.arange(1 + seed, width + 1 + seed, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
    for j in range(width):
        total += words[j : j + n] * odd[j]
    return mix64(total)


def slices(batch, rows: int = 256):
    """A record batch in pieces of a few rows, so Python objects stay few."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)
