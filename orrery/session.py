"""Sessions, and the shared folder that cuts the lineage of loops."""

from __future__ import annotations

import gc
import tempfile
import threading
import uuid
from collections.abc import Callable
from weakref import WeakKeyDictionary

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession


def session(app: str = "orrery", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; ``conf`` names have _ for dots."""
    builder = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    for name, value in conf.items():
        builder = builder.config(name.replace("_", "."), value)
    return builder.getOrCreate()


def width(df: DataFrame) -> int:
    """The session's shuffle width."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of our own only where none is named and the master is local
    (single-machine runs)."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="orrery-checkpoint-"))
    return context.getCheckpointDir()


def without_size(done: JavaObject, spark: SparkSession) -> DataFrame:
    """The rows of a materialised plan without its size estimate."""
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(done.queryExecution().toRdd(), done.schema(), False), spark)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the session's ``spark.checkpoint.dir`` and cut its lineage.

    The size estimate of the old plan goes too: a checkpoint hands it on, and a loop's joins multiply
    it, so its digits double in a round and planning takes longer than the work.
    """
    spark = df.sparkSession
    shared_folder(spark)
    return without_size(df.checkpoint(eager=True)._jdf, spark)


def stored(df: DataFrame) -> DataFrame:
    """As ``cut``, but as compressed Parquet: for large tables, of which a checkpoint keeps every row as it
    is in memory.  Their small files must not let the planner broadcast them, so the estimate goes here too."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    if open_ := getattr(WRITTEN, "open", None):
        open_[-1].append(folder)
    out = without_size(spark.read.schema(df.schema).parquet(folder)._jdf, spark)
    FOLDERS[out] = folder
    return out


#: The folder of each table that ``stored`` gave.
FOLDERS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
#: The folders that ``stored`` wrote in each ``settled`` that a thread is in.
WRITTEN = threading.local()


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """``stored`` rows of ``make()``.  What this thread stored on the way to them is deleted, and the shuffle files and
    checkpoints that nothing refers to any more are let go."""
    if not hasattr(WRITTEN, "open"):
        WRITTEN.open = []
    WRITTEN.open.append([])
    try:
        out = stored(make())
    finally:
        *over, last = WRITTEN.open.pop() or [None]
    spark = out.sparkSession
    for folder in over:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if WRITTEN.open:
        WRITTEN.open[-1].append(last)
    let_go(spark)
    return out


def taken_over(df: DataFrame) -> DataFrame:
    """What another thread ``stored``; the ``settled`` that this thread is in deletes it."""
    if open_ := getattr(WRITTEN, "open", None):
        open_[-1].append(FOLDERS[df])
    return df


def laid(df: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of a table that ``stored`` wrote where it lies, of others ``stored``."""
    return df if df in FOLDERS and df.columns == list(columns) else stored(df.select(*columns))


def dropped(df: DataFrame) -> None:
    """Delete a table that ``stored`` wrote and that nothing reads any more."""
    spark, path = df.sparkSession, df.sparkSession._jvm.org.apache.hadoop.fs.Path(FOLDERS.pop(df))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def let_go(spark: SparkSession) -> None:
    """Free the shuffle files and checkpoints that nothing refers to any more; else they stay until the driver's heap is full."""
    gc.collect()
    spark._jvm.System.gc()
