"""Texts that are clean take a short way with the same result."""

from pyspark.sql import functions as F

from vacantia.functions import text as t


def test_the_short_way_gives_the_same(spark):
    some = ["", " ", "a", "A b", " a", "a ", "a  b", "a\tb", "a\nb", "a\n", "\n", "a\n\n\nb", "a\r\nb", "x\x7fy", "a\u00a0b", "Đà Nẵng", "Đà  Nẵng", "a\u200bb", "ỹ\u0301 Q", "e\u0301", "ÀB", "\u1680a", "a\u2003b", "İ", "ß", "a\x0bb", None]
    rows = spark.createDataFrame([(x,) for x in some], "x string")
    pairs = ((t.norm_inline, t._norm_inline), (t.norm_multiline, t._norm_multiline), (t.fold, t._fold))
    for r in rows.select("x", *(F.struct(f(F.col("x")).alias("a"), g(F.col("x")).alias("b")).alias(f.__name__) for f, g in pairs)).collect():
        for f, _ in pairs:
            assert r[f.__name__].a == r[f.__name__].b, (f.__name__, r.x)


def test_only_texts_beyond_ascii_are_composed_and_in_parts(spark):
    import unicodedata

    import pyarrow as pa

    texts = ["", "ABC", None, "e\u0301", "\ufb01X", "Stra\u00dfe", "\u03a3\u0391\u03a3", "a" * 3000 + "\u00c9", "I\u0307"]
    batch = pa.array(texts * 1000, pa.string())
    parts = list(t._parts(batch))
    assert pa.concat_arrays(parts).equals(batch) and len(parts) > 2 and max(p.nbytes for p in parts) < 2 * t.PART_BYTES and not list(t._parts(pa.array([], pa.string())))
    rows = spark.createDataFrame(list(enumerate(texts * 3)), "i int, x string")
    for form, casefold in (("NFC", False), ("NFKC", True)):
        for r in rows.select("x", t.composed(F.col("x"), form, casefold).alias("v")).collect():
            want = None if r.x is None else unicodedata.normalize(form, r.x)
            assert r.v == (want.casefold() if casefold and want is not None else want)
