"""The query surface: pages of rows, newest rows, point look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.operators.keyed import ranks


#: Rows before a page up to which it is cut from the first rows of all; pages behind are found by ranks.
DEEP = 10_000


def list_page(rows: DataFrame, filters: dict[str, object], order: list[Column], page: int = 0, size: int = 20, codes: tuple[str, ...] = ("source_code",), deep: int = DEEP) -> DataFrame:
    """A page of the filtered rows in order, with the total and number of pages; size is kept between 1 and 100.

    Filters without a value don't count; values of `codes` are trimmed and upper-cased, as those columns are. A page behind
    more than `deep` rows comes from ranks that are counted by ranges (`keyed.ranks`), so no task holds the rows before it.
    """
    size, page = max(1, min(100, size)), max(0, page)
    for name, value in filters.items():
        if name in codes and isinstance(value, str):
            value = value.strip().upper() or None
        if value is not None:
            rows = rows.filter(F.col(name) == F.lit(value))
    total = rows.agg(F.count("*").alias("total"))
    if page * size <= deep:
        out = rows.orderBy(*order).offset(page * size).limit(size)
    else:
        out = ranks(rows, order).filter(F.col("_rank").between(page * size + 1, (page + 1) * size)).drop("_rank").orderBy(*order)
    return out.crossJoin(F.broadcast(total)).withColumn("pages", F.ceil(F.col("total") / size))


def latest(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    return rows.orderBy(*order).limit(max(1, min(100, n)))


def by_key(rows: DataFrame, name: str, value) -> DataFrame:
    return rows.filter(F.col(name) == F.lit(value))


def latest_by_key(rows: DataFrame, name: str, value, order: list[Column]) -> DataFrame:
    """The newest row of a key; no row where there is none."""
    return by_key(rows, name, value).orderBy(*order).limit(1)
