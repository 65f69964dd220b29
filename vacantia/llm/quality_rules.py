"""Quality rules whose cut-offs follow each language and source: quantile sketches, fences, and a joined filter.

Only DataFrame functions. Quartiles come from KLL sketches, one per (lang, source) and metric; sketches of small groups
are merged into their language's, and those of small languages into the whole corpus's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import written

#: metric: (least spread, fence in spreads above the third quartile, fence below the first or None).
FENCES: dict[str, tuple[float, float, float | None]] = {
    "symbol_share": (0.01, 4.0, None),
    "upper_share": (0.03, 4.0, None),
    "repeat_share": (0.1, 4.0, None),
    "dup_line_share": (0.15, 4.0, None),
    "word_length": (0.8, 4.0, 4.0),
}
#: Rows below which a group takes the quartiles of its language, and a language those of all rows.
LEAST = 200
#: Size of a sketch: exact up to about as many values.
SKETCH = 4096
#: Groups up to which the thresholds are broadcast (under 100 bytes each); beyond, an ordinary join.
BROADCAST_GROUPS = 50_000

_POS = (1 << 24) - 1


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, also where `body` uses it in another lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(positions: Column) -> Column:
    """Words in the windows of three that begin at the sorted `positions`."""
    n = F.size(positions)
    gaps = lambda p, i: F.when(i + 1 < F.size(positions), F.least(F.lit(3), (F.get(positions, i + 1) - p).cast("int"))).otherwise(3)
    return F.when(n == 0, F.lit(0)).otherwise(F.aggregate(F.transform(positions, gaps), F.lit(0), lambda a, x: a + x))


def _by_packing(hashes: Column) -> Column:
    """Words covered by repeated windows, from one sort of longs: the upper 40 bits of a hash, then its position.

    Null where two different hashes share their upper bits, or a position doesn't fit.
    """
    packed = F.sort_array(F.transform(hashes, lambda h, i: h.bitwiseAND(F.lit(~_POS)).bitwiseOR(i.cast("long"))))

    def repeated(p: Column) -> Column:
        same = lambda x, y: F.shiftright(x, 24) == F.shiftright(y, 24)
        return F.filter(p, lambda x, i: F.coalesce(same(x, F.get(p, i + 1)), F.lit(False)) | F.coalesce(same(x, F.get(p, i - 1)), F.lit(False)))

    def count(c: Column) -> Column:
        at = lambda x: F.get(hashes, x.bitwiseAND(F.lit(_POS)).cast("int"))
        clash = F.exists(F.transform(c, lambda x, i: (F.shiftright(x, 24) == F.shiftright(F.get(c, i + 1), 24)) & (at(x) != at(F.get(c, i + 1)))), lambda x: F.coalesce(x, F.lit(False)))
        return F.when(~clash, _let(F.sort_array(F.transform(c, lambda x: x.bitwiseAND(F.lit(_POS)))), _covered))

    return F.when(F.size(hashes) <= _POS, _let(_let(packed, repeated), count))


def _by_pairs(hashes: Column) -> Column:
    """The same from a sort of (hash, position) pairs: slower, without conditions."""
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(p: Column) -> Column:
        return F.filter(p, lambda x, i: F.coalesce(x["h"] == F.get(p, i + 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(p, i - 1)["h"], F.lit(False)))

    return _let(F.sort_array(F.transform(_let(pairs, repeated), lambda x: x["i"])), _covered)


def measured(docs: DataFrame) -> DataFrame:
    """`docs` with `_q`, a struct of the counts and metrics of its text (null: empty)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.withColumns({"_w": words, "_lines": lines})
    windows = F.transform(F.sequence(F.lit(0), F.size("_w") - 3), lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)))
    out = out.withColumn("_h", F.when(F.size("_w") > 2, windows).otherwise(F.array().cast("array<bigint>")))
    out = out.withColumn("_some", F.size(F.array_distinct("_h")) < F.size("_h"))
    fast = F.when(F.col("_some"), _by_packing(F.col("_h")))
    out = out.withColumn("_fast", fast)
    repeat = F.when(~F.col("_some"), F.lit(0)).when(F.col("_fast").isNotNull(), F.col("_fast")).otherwise(_by_pairs(F.col("_h")))
    n, chars = F.size("_w").cast("long"), F.length(text).cast("long")
    gone = lambda marks: chars - F.length(F.translate(text, marks, ""))
    out = out.withColumn(
        "_q",
        F.struct(
            n.alias("n_words"),
            F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
            gone("#*$%&|<>").cast("long").alias("n_symbols"),
            (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
            repeat.cast("long").alias("n_repeat_words"),
            F.size("_lines").cast("long").alias("n_lines"),
            F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
        ),
    ).drop("_w", "_lines", "_h", "_some", "_fast")
    q = F.col("_q")
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    metrics = {
        "symbol_share": share(q["n_symbols"], q["word_chars"]),
        "upper_share": share(q["n_upper"], q["word_chars"]),
        "repeat_share": share(q["n_repeat_words"], q["n_words"]),
        "dup_line_share": share(q["n_dup_lines"], q["n_lines"]),
        "word_length": share(q["word_chars"], q["n_words"]),
    }
    out = out.withColumn("_m", F.struct(*(v.alias(k) for k, v in metrics.items())))
    q = F.col("_q")
    return out.withColumn("_base", (q["n_words"] < 50) | (100 * q["n_repeat_words"] > 50 * q["n_words"]))


def _group(df: DataFrame) -> dict[str, Column]:
    """lang and source as group keys; a table without such a column, or a null, has the empty name."""
    return {f"_{c}": F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("") for c in ("lang", "source")}


def thresholds(measured_rows: DataFrame, least: int = LEAST) -> DataFrame:
    """_lang, _source and for each metric its bounds `<metric>_hi`, `<metric>_lo` from rows that pass the base rules."""
    rows = measured_rows.filter(~F.col("_base")).select("_lang", "_source", "_m.*")
    sketch = rows.groupBy("_lang", "_source").agg(F.count("*").alias("n"), *(F.kll_sketch_agg_double(m, F.lit(SKETCH)).alias(m) for m in FENCES))
    sketch = written(sketch, "sketches")
    merged = [F.sum("n").alias("n"), *(F.kll_merge_agg_double(m, F.lit(SKETCH)).alias(m) for m in FENCES)]
    by_lang = sketch.groupBy("_lang").agg(*merged)
    pick = lambda df, p: df.withColumnsRenamed({c: p + c for c in ("n", *FENCES)})
    both = pick(sketch, "a_").join(pick(by_lang, "b_"), "_lang", "left").crossJoin(F.broadcast(pick(sketch.agg(*merged), "c_")))
    out = {}
    for m, (narrow, above, below) in FENCES.items():
        own = F.when(F.col("a_n") >= least, F.col("a_" + m)).when(F.col("b_n") >= least, F.col("b_" + m)).otherwise(F.col("c_" + m))
        at = F.kll_sketch_get_quantile_double(own, F.array(F.lit(0.25), F.lit(0.75)))
        q1, q3 = F.get(at, F.lit(0)), F.get(at, F.lit(1))
        spread = F.greatest(q3 - q1, F.lit(narrow))
        out[m + "_hi"] = F.round(q3 + above * spread, 6)
        out[m + "_lo"] = F.round(q1 - below * spread, 6) if below is not None else F.lit(float("-inf"))
    return both.select("_lang", "_source", *(v.alias(k) for k, v in out.items()))


def _judged(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """`rows` with `_kept`: base rules passed and each metric inside the fences of its language and source."""
    limits = written(limits.withColumnsRenamed({f"{m}_{e}": f"_{m}_{e}" for m in FENCES for e in ("hi", "lo")}), "thresholds")
    limits = F.broadcast(limits) if limits.count() <= BROADCAST_GROUPS else limits
    inside = F.lit(True)
    for m in FENCES:
        inside = inside & (F.col("_m")[m] <= F.col(f"_{m}_hi")) & (F.col("_m")[m] >= F.col(f"_{m}_lo"))
    return rows.join(limits, ["_lang", "_source"], "left").withColumn("_kept", ~F.col("_base") & F.coalesce(inside, F.lit(True)))


def quality_rules(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Per row of `docs`: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and the metrics.

    `docs` has doc_id and text, and lang and source where known; other columns aren't read. A null text is an empty
    one and fails the base rule, as any text under 50 words. Null languages and sources form a group of their own.
    Repeated rows and ids, null ids too, each give a row. Groups under `least` rows that pass the base rules take
    the quartiles of their language, or of all rows. Quartiles are exact up to `SKETCH` values of a group and those of a
    sketch beyond, as the comparison SQL's exact ones then needn't be. An empty table gives no rows.
    """
    rows = measured(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), *(v.alias(k) for k, v in _group(docs).items())))
    rows = written(rows.select("doc_id", "_lang", "_source", "_q", "_m", "_base"), "measured")
    out = _judged(rows, thresholds(rows, least))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return out.select("doc_id", *(F.col("_q")[c].alias(c) for c in counts), F.col("_base").alias("base_failed"), F.col("_kept").alias("kept"), *(F.col("_m")[m].alias(m) for m in FENCES))


def kept_documents(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """The rows of `docs` that the rules keep, with its own columns, whatever their names."""
    rows = measured(docs.select(F.struct(*docs.columns).alias("row"), F.col("text").alias("text"), *(v.alias(k) for k, v in _group(docs).items())))
    rows = written(rows.select("row", "_lang", "_source", "_m", "_base"), "measured")
    return _judged(rows, thresholds(rows, least)).filter("_kept").select("row.*")


def _oracle() -> str:
    """The same rules in SQL, with exact quantiles (which the sketches are up to SKETCH values)."""
    fence = lambda m, e, at, sign, n: f"round(q{at}_{m} {sign} {n}::DOUBLE * greatest(q3_{m} - q1_{m}, {FENCES[m][0]}::DOUBLE), 6) AS {m}_{e}"
    quartiles = ", ".join(f"quantile_disc({m}, 0.25) AS q1_{m}, quantile_disc({m}, 0.75) AS q3_{m}" for m in FENCES)
    limits = ", ".join([fence(m, "hi", 3, "+", a) for m, (_, a, _) in FENCES.items()] + [fence(m, "lo", 1, "-", b) for m, (_, _, b) in FENCES.items() if b is not None])
    inside = " AND ".join([f"{m} <= {m}_hi" for m in FENCES] + [f"{m} >= {m}_lo" for m, (_, _, b) in FENCES.items() if b is not None])
    return rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
g AS (SELECT r, unnest(range(1, len(w) - 1)) AS p, w FROM w WHERE len(w) > 2), h AS (SELECT r, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS x FROM g),
d AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, x) AS n FROM h) WHERE n > 1),
c AS (SELECT r, count(DISTINCT p + k) AS n FROM d, (VALUES (0), (1), (2)) AS o(k) GROUP BY r),
q AS (SELECT w.r, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars, CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, len(l) AS n_lines, length(regexp_replace(text, '[^\p{{Lu}}]+', '', 'g')) AS n_upper FROM w LEFT JOIN c ON c.r = w.r),
m AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0 END AS symbol_share, CASE WHEN word_chars > 0 THEN n_upper / word_chars ELSE 0 END AS upper_share,
  CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END AS repeat_share, CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_share, CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS word_length FROM q),
ok AS (SELECT * FROM m WHERE NOT base_failed),
a AS (SELECT lang, source, count(*) AS n, {quartiles} FROM ok GROUP BY lang, source), b AS (SELECT lang, count(*) AS n, {quartiles} FROM ok GROUP BY lang), z AS (SELECT {quartiles} FROM ok),
k AS (SELECT a.lang, a.source, u.* FROM a JOIN b ON b.lang = a.lang, LATERAL (SELECT a.* EXCLUDE (lang, source, n) WHERE a.n >= {LEAST} UNION ALL SELECT b.* EXCLUDE (lang, n) WHERE a.n < {LEAST} AND b.n >= {LEAST} UNION ALL SELECT z.* FROM z WHERE a.n < {LEAST} AND b.n < {LEAST}) u),
f AS (SELECT lang, source, {limits} FROM k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce({inside}, true) AS kept, {', '.join(FENCES)} FROM m LEFT JOIN f ON f.lang = m.lang AND f.source = m.source
"""


ORACLE = _oracle()
