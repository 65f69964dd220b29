"""Repair of broken encodings: texts, their scores and what is read from them, written down; and the queries against their SQL."""

import glob
import os

import __spark_entry__ as entry
from conftest import SF
from pyspark.sql import functions as F
from test_queries import plain
from vacantia.functions import text

# text, score, what comes of it
TEXTS = [
    ("déjà vu", 0, "déjà vu"),
    ("dÃ©jÃ  vu", 6, "déjà vu"),
    ("Nguyá»\u0085n", 8, "Nguyễn"),
    ("Ká»¹ sÆ°", 7, "Kỹ sư"),
    ("a â€“ b", 4, "a – b"),  # cp1252
    ("5 â‚¬ or 6 â‚¬", 8, "5 € or 6 €"),
    ("ð\u009f\u0098\u0080", 16, "😀"),
    ("lost �", 5, "lost �"),
    ("Ã", 0, "Ã"),
    ("\u0085\u0085", 8, "\u0085\u0085"),  # no UTF-8 behind it
    ("ééé dÃ©", 3, "ééé dÃ©"),  # sound letters beside broken ones: not of one encoding
    ("— Huệ\na â€“ b\ntail", 4, "— Huệ\na – b\ntail"),  # by lines
    ("— Huệ\r\ndÃ©jÃ \r\nx", 6, "— Huệ\r\ndéjà\r\nx"),
    ("— Huệ\rKá»¹\x0bsÆ°", 7, "— Huệ\rKỹ\x0bsư"),
    ("— Huệ a â€“ b", 4, "— Huệ a â€“ b"),  # one line of both
    ("dÃ©\nâ€“", 7, "dé\n–"),  # each line by its own encoding
    ("plain", 0, "plain"),
    ("", 0, ""),
]


def test_scores_and_repairs(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(TEXTS)] + [(-1, None)], "i int, t string")
    got = {r.i: (r.s, r.v) for r in rows.select("i", text.mojibake_score(F.col("t")).alias("s"), text.repair_mojibake(F.col("t")).alias("v")).collect()}
    assert got.pop(-1)[1] is None
    for i, (t, score, value) in enumerate(TEXTS):
        assert got[i] == (score, value), ascii(t)


def test_repairs_query(spark):
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    for name in ("c6_mojibake_repairs", "c6_mojibake", "c6_mojibake_scores"):
        assert plain(entry.queries()[name](spark, SF).toPandas()) == plain(con.sql(entry.oracle_sql()[name]).df())
    assert con.sql(f"SELECT min(score) FROM ({entry.oracle_sql()['c6_mojibake_scores']})").fetchall()[0][0] > 0


def test_lines_and_signs_are_those_of_the_plain_way(spark):
    import re

    plain_lines = re.compile("(?<=[\n\x0b\x0c\x1c-\x1e\u0085  ])|(?<=\r)(?!\n)")
    some = ["", "a", "\n", "a\r\nb\rc\n\nd\x0b\x0ce\x1cf\u0085g h ", "\r\r\n\n\r", "á\n»Ã\u0081", "á º áº Ã© â\u0080\u0093 â x€\u0085�", "abc é dÃ©", "x" * 50 + "Ã" + "y\u0081", "ê a\U0001f600" * 50_000 + "\nx"]
    rows = spark.createDataFrame(list(enumerate(some)), "i int, t string")
    got = rows.select("i", F.regexp_extract_all("t", F.lit(text._LINE), F.lit(0)).alias("l"), text._signs(F.col("t")).alias("s"), text._broken(F.col("t")).alias("a"), text._broken(text._signs(F.col("t"))).alias("b")).collect()
    for r in got:
        assert r.l == [x for x in plain_lines.split(some[r.i]) if x], ascii(some[r.i])
        assert r.a == r.b and len(r.s) <= len(some[r.i])
