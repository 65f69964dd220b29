"""Written tables in the folder that driver and executors share.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir`` and reading it back: the files outlive executors,
and they are compressed, which RDD checkpoints are not.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a folder of our own only where the setting is absent and driver and tasks are one machine."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = _OWN.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="vacantia-"))
    return named.rstrip("/")


#: Tables written inside the innermost `temporary` block, by path.
_made: list[list[str]] = []


def written(df: DataFrame, label: str) -> DataFrame:
    """`df` as a table that no lost executor can take away."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/vacantia/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _made:
        _made[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def dropped(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables that `written` made and nothing reads any more."""
    for p in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def temporary(spark: SparkSession):
    """Tables written inside are deleted at the end, but for those passed to what this gives.

    A result that isn't written yet must read no others. After an error all stay, for a look.
    """
    made: list[str] = []
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._written_at)
        return df

    _made.append(made)
    try:
        yield keep
    finally:
        _made.pop()
    dropped(spark, [p for p in made if p not in kept])
    if _made:
        _made[-1] += [p for p in made if p in kept]


def sized(df: DataFrame, rows: int = 50_000) -> DataFrame:
    """A written table of short rows, marked for broadcast if it has at most `rows`; else Spark joins it by its keys."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def free_name(df: DataFrame, name: str) -> str:
    """A column name that `df` doesn't have, in any case of letters, and that no name of `df` begins with."""
    taken = [c.lower() for c in df.columns]
    out = f"_{name}"
    while any(c.startswith(out) for c in taken):
        out = "_" + out
    return out


#: Rows up to which a table of keys is broadcast whole; a key with more than this share of all rows is hot.
SMALL, HOT = 50_000, 1e-4


def joined(rows: DataFrame, table: DataFrame, on: list[str], how: str, total: int) -> DataFrame:
    """`rows` with `table`, which has one row per key and in `n` how many of the `total` rows have it.

    A small table is broadcast. Of a large one the hot keys are, of which there are at most 1 / HOT; the others are
    joined by shuffling, where no key is hot.
    """
    from pyspark.sql import functions as F

    if table.limit(SMALL + 1).count() <= SMALL:
        return rows.join(F.broadcast(table.drop("n")), on, how)
    hot = F.broadcast(table.filter(F.col("n") > total * HOT).drop("n"))
    rest = rows.join(hot.select(*on), on, "left_anti").join(table.filter(F.col("n") <= total * HOT).drop("n"), on, how)
    return rest.unionByName(rows.join(hot, on))


def opened(folder: str):
    """The file system of a folder's URI and the folder's path there; `file:` with any number of slashes is local."""
    from pyarrow import fs

    if folder.startswith("file:") or "://" not in folder:
        path = folder.removeprefix("file:")
        return fs.LocalFileSystem(), "/" + path.lstrip("/")
    return fs.FileSystem.from_uri(folder)
