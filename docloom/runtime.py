"""Session helpers: shared scratch folder, lineage cuts, input parallelism."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    Taken from ``spark.checkpoint.dir``.  Only a local session (tests, a laptop)
    that names none gets a temporary folder; on a cluster that is an error, as
    executors don't share a machine's folders.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="docloom-"))
        named = sc.getCheckpointDir()
    return named.rstrip("/")


def _own_folder(spark: SparkSession) -> str:
    """This application's folder in the shared one; removed when its JVM ends."""
    path = f"{shared_dir(spark)}/docloom/{spark.sparkContext.applicationId}"
    if path not in _MADE:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        system = place.getFileSystem(spark._jsc.hadoopConfiguration())
        system.mkdirs(place)
        system.deleteOnExit(place)
        _MADE.add(path)
    return path


_MADE: set[str] = set()


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back.

    One computation (``checkpoint()`` would do two), columnar and compressed;
    the table survives the loss of executors.
    """
    spark = df.sparkSession
    path = f"{_own_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession) -> None:
    """Remove every table that :func:`written` left for this application; what was
    built on them can't be read any more.  For sessions of many queries."""
    path = _own_folder(spark)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    _MADE.discard(path)


def spread(df: DataFrame, per_core: int = 1) -> DataFrame:
    """Give a scan of few input splits at least one task per core.

    A file smaller than one split would otherwise send all of a Python stage
    through a single task.  Larger inputs pass through without a shuffle.
    """
    want = df.sparkSession.sparkContext.defaultParallelism * per_core
    return df if df.rdd.getNumPartitions() >= min(want, 4) else df.repartition(want)


def tasks(spark: SparkSession) -> int:
    """How many tasks a step that is expensive per row gets."""
    return max(spark.sparkContext.defaultParallelism * 2, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_out(df: DataFrame) -> DataFrame:
    """Even tasks for an expensive step per row behind a shuffle.

    Adaptive execution merges partitions by their bytes, which says little where
    a few kilobytes cost seconds; an explicit number stays.
    """
    return df.repartition(tasks(df.sparkSession))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def one_row_per(df: DataFrame, key: str) -> DataFrame:
    """One row for each key; among rows that repeat it the smallest by all
    other columns (so that the choice doesn't depend on the partitioning).
    Null keys are dropped."""
    rest = [c for c in df.columns if c != key]
    best = F.min(F.struct(*rest)).alias("_row") if rest else F.count("*").alias("_row")
    out = df.where(F.col(key).isNotNull()).groupBy(key).agg(best)
    return out.select(key, *[F.col("_row")[c].alias(c) for c in rest])
