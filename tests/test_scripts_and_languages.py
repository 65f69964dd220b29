"""Folding over scripts, compatibility forms, and languages told apart."""

import unicodedata

from pyspark.sql import functions as F

from vacantia.functions import text
from vacantia.operators import docs

from conftest import SF


def test_folding_equals_decomposition_in_every_script(spark):
    """Every lower-case letter with marks of the first planes, by the library's own decomposition, and words of several scripts."""
    letters = [c for c in map(chr, range(0xC0, 0x2000)) if unicodedata.category(c)[0] == "L" and c == c.lower()]
    rows = spark.createDataFrame([(c,) for c in letters], "c string")
    want = {c: "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x)[0] != "M") for c in letters} | {"đ": "d", "ø": "o"}
    assert {r.c: r.f for r in rows.select("c", text.fold(F.col("c")).alias("f")).collect()} == want
    words = {"ΆΛΦΑ  ή": "αλφα η", "Ёлка Й": "елка и", "Trường Đại": "truong dai", "été": "ete", "PLAIN  Ascii\t\n x": "plain ascii x", "": "", "ǅ": "ǆ", "각": "각", "a​b é": "ab e"}
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", text.fold(F.col("w")).alias("f"))
    assert {r.w: r.f for r in got.collect()} == words


def test_compatibility_forms_are_part_of_documents_and_matching(spark):
    words = ["ﬁn Ａ１ ① ½ …", "Straße ΣΑΣ ς", "é", None, "", "　x　"]
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string")
    got = {r.i: (r.d, r.m) for r in rows.select("i", text.norm_document(F.col("w"))[0].alias("d"), text.norm_match(F.col("w")).alias("m")).collect()}
    for i, w in enumerate(words):
        n = w and unicodedata.normalize("NFKC", w)
        assert got[i] == ((None, None) if w is None else (n.strip(), " ".join(n.casefold().split())))


def test_items_once_each_in_order_however_many(spark):
    items = [f"Item {i % 700}" if i % 3 else f" ÍTEM  {i % 700}" for i in range(4000)] + [" ", None]
    got = spark.createDataFrame([(items,)], "x array<string>").select(text.stable_unique(F.col("x")).alias("u"), text.stable_unique(F.col("x"), 5).alias("f")).first()
    want, seen = [], set()
    for x in items:
        x = x and " ".join(x.split())
        if x and (k := "".join(c for c in unicodedata.normalize("NFD", x.lower()) if unicodedata.category(c) != "Mn")) not in seen:
            seen.add(k)
            want.append(x)
    assert got.u == want and got.f == want[:5] and len(want) == 700


def test_neighbouring_languages_are_told_apart(spark):
    rows = spark.read.parquet(SF.replace("sf0.001", "sf0.01") + "/documents.parquet").select("lang", docs.detect_language(F.col("text")).alias("l")).collect()
    for lang in ("en", "fr", "de", "es"):
        own = [r.l for r in rows if r.lang == lang and r.l != "UNKNOWN"]
        assert own.count(lang) >= 0.97 * len(own) and own.count("MIXED") <= 0.02 * len(own) and "vi" not in own
    assert sum(r.l == "UNKNOWN" for r in rows) < 0.05 * len(rows)
    two = spark.createDataFrame([("Kỹ năng và kinh nghiệm làm việc với khách hàng của công ty",), ("Work experience and skills in the management of a company",), ("Skills: quản lý khách hàng và management of customer business with the company tại công ty and training",), ("short text",)], "t string")
    assert [r.l for r in two.select(docs.detect_language(F.col("t"), {k: docs.COMMON[k] for k in ("vi", "en")}).alias("l")).collect()] == ["vi", "en", "MIXED", "UNKNOWN"]
