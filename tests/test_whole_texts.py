"""Whole-length forms of C5, D15 and D16: nothing is cut below the reference's limits."""

import glob
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import SF
from test_queries import plain
from vacantia.functions import text
from vacantia.operators import jobs

WHOLE = ("c5_norm_document_whole", "d15_job_text_query_whole", "d16_job_text_passage_whole")


@pytest.mark.parametrize("name", WHOLE)
def test_whole_query(spark, name):
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    got = entry.queries()[name](spark, SF).toPandas()
    assert plain(got) == plain(con.sql(entry.oracle_sql()[name]).df())
    assert name != WHOLE[0] or got.value.str.len().max() > 2000


def test_limits(spark):
    rows = spark.createDataFrame([("x" * 200_000,), ("y" * 200_001,)], "t string")
    value, warnings = text.norm_document(F.col("t"))
    got = rows.select(F.length(value).alias("n"), F.array_join(warnings, ",").alias("w")).collect()
    assert [(r.n, r.w) for r in got] == [(200_000, ""), (200_000, "TEXT_TRUNCATED")]
    long = spark.createDataFrame([("t" * 1500, "c" * 1500, "s")], "t string, c string, s string")
    query = jobs.text_query({"Title": (F.col("t"), 2400), "Company": (F.col("c"), 2400), "Skills": (F.col("s"), 2400)})
    passage = jobs.text_passage({"Title": F.col("t"), "Company": F.col("c"), "Skills": F.col("s")})
    r = long.select(query.alias("q"), passage.alias("p")).first()
    assert r.q.startswith("query: Title: " + "t" * 1500 + "\nCompany: ccc") and r.q.endswith("…") and len(r.q) <= 2400
    assert r.p.startswith("passage: Title: " + "t" * 1500) and r.p.endswith("…") and len(r.p) == 2400
