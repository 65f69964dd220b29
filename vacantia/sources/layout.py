"""The observation feed as a table by source and time, so that readers open only the files that they need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds of time folders.
GRAINS = {"day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}


def period(at: Column, grain: str) -> Column:
    return F.date_format(at, GRAINS[grain])


def write_observations(rows: DataFrame, folder: str, grain: str = "day", source: str = "source_code", at: str = "collected_at") -> None:
    """Writes `rows` below `folder` by source and period; the periods of a source that `rows` has replace those there.

    Spark balances the files: a hot source and period is split into several, small ones of a task stay together. Written
    again, the same rows give the same table. A null source or time has a folder of its own.
    """
    dealt = rows.withColumn("period", period(F.col(at), grain)).hint("rebalance", source, "period")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(source, "period").parquet(folder)


def read_observations(spark: SparkSession, folder: str, sources: list[str] | None = None, since: str | None = None, before: str | None = None, only: DataFrame | None = None, source: str = "source_code") -> DataFrame:
    """The table of a folder, or the part of it from `sources` (upper-cased), of periods from `since` and before `before`.

    These choose folders before any file is opened. With `only`, a table with the source and, if it likes, the period, just the
    folders that it names are read: Spark finds them at run time from its rows. Periods are texts, as the grain writes them.
    """
    rows = spark.read.option("basePath", folder).parquet(folder).withColumns({source: F.col(source).cast("string"), "period": F.col("period").cast("string")})
    if sources is not None:
        rows = rows.filter(F.col(source).isin([s.strip().upper() for s in sources]))
    if since is not None:
        rows = rows.filter(F.col("period") >= since)
    if before is not None:
        rows = rows.filter(F.col("period") < before)
    if only is not None:
        on = [c for c in (source, "period") if c in only.columns]
        rows = rows.join(only.select(*on).distinct(), on, "left_semi")
    return rows
