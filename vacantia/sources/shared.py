"""Tables written to the folder that all machines share, and joins whose broadcast side is of a checked size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a small table up to which it is broadcast.
SMALL = 50_000

_own: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a local one only where the setting is absent and driver and tasks are one machine."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = _own.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="vacantia-"))
    return named.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """`df` as a table that no lost executor can take away, so that it is computed once."""
    path = f"{folder(df.sparkSession)}/vacantia/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """A table of short rows, marked for broadcast if it has at most `rows`; else Spark joins it by its keys."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spread(df: DataFrame, bytes_a_task: int = 128 << 20) -> DataFrame:
    """`df` dealt over all cores where its files are so few and small that a scan leaves cores idle; else `df` itself.

    For costly work behind small tables. What is shuffled is less than `bytes_a_task` for each core; of larger or more files Spark makes
    enough tasks by itself.
    """
    spark, files = df.sparkSession, df.inputFiles()
    cores = spark.sparkContext.defaultParallelism
    if not 0 < len(files) < cores:
        return df
    return df.repartition(cores) if _held(spark, files) < bytes_a_task * cores else df


def _held(spark: SparkSession, files: list[str]) -> int:
    conf, path = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    return sum(path(f).getFileSystem(conf).getFileStatus(path(f)).getLen() for f in files)


#: Bytes of input files whose rows one task sorts, in `dealt`.
DEALT_BYTES = 2 << 20


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """`rows` dealt by `keys` to tasks whose number grows with the files that they come from; else `rows` itself.

    For many short rows that are sorted by key: their shuffled bytes are few, so Spark would put ever more of them into a task.
    """
    spark, files = rows.sparkSession, rows.inputFiles()
    n = max(spark.sparkContext.defaultParallelism, -(-_held(spark, files) // DEALT_BYTES)) if files else 0
    return rows.repartition(n, *keys) if n else rows


def joined(rows: DataFrame, table: DataFrame, on: str, hot: DataFrame) -> DataFrame:
    """`rows` with `table`, which has one row a key: keys in `hot` (at most `SMALL`) by broadcast, the others by a shuffle."""
    hot = F.broadcast(hot.select(on))
    few = F.broadcast(table.join(hot, on, "left_semi"))
    rest = rows.join(hot, on, "left_anti").join(table.join(hot, on, "left_anti"), on)
    return rest.unionByName(rows.join(few, on))
