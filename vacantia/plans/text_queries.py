"""C: text normalisation over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from vacantia.functions import text as t
from vacantia.plans import base
from vacantia.sources.feed import table
from vacantia.sources.shared import spread

_docs = lambda make: lambda spark, d: spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", *make(F.col("text")))
_BLANK = r"[\s\x00-\x1f\x7f\x{a0}]+"

# Lines that are put below each document and broken: by Latin-1 with the whole text, by Latin-1 and by cp1252 alone.
_SOUND = ("Trường Đại học Công nghệ, déjà vu", "Kỹ sư phần mềm", "déjà vu – ‘été’ 5 €")
_KEPT = "Nguyễn — Huệ"


def _broken_rows(spark, d):
    """Documents with broken lines, and what is repaired of them."""
    x, kind = F.col("text"), F.col("doc_id") % 3
    latin = lambda y: F.decode(F.encode(y, "UTF-8"), "ISO-8859-1")
    whole = latin(F.concat_ws("\n", x, F.lit(_SOUND[0])))
    lines = [F.concat_ws("\n", x, F.lit(_KEPT), F.lit(y)) for y in (_SOUND[1].encode().decode("latin-1"), _SOUND[2].encode().decode("cp1252"))]
    rows = spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.when(kind == 0, whole).when(kind == 1, lines[0]).otherwise(lines[1]).alias("text"))
    return rows.select("doc_id", t.repair_mojibake(x).alias("value"))


#: A line in forms that look alike: ligature, full width, circled, half, ellipsis, decomposed; and its NFKC.
_ALIKE, _NFKC = "\ufb01n \uff21\uff11 \u2460 \u00bd \u2026 e\u0301 \u01c5", "fin A1 1 1\u20442 ... \u00e9 D\u017e"
#: Letters of several scripts, with marks and without.
_SCRIPTS = "\u1f08\u03b8\u1fc6\u03bd\u03b1\u03b9 \u0401\u043b\u043a\u0430 \u0439 \u1eaf \u01fb \u0160 \u0130 e\u0301 \u00d8re"


def _with(spark, d, line: str):
    """Documents with a line more."""
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.concat_ws("\n", "text", F.lit(line)).alias("text"))


def _broken_texts(spark, d):
    """The broken documents as they are, with their scores."""
    x = F.col("text")
    latin = F.decode(F.encode(F.concat_ws("\n", x, F.lit(_SOUND[0])), "UTF-8"), "ISO-8859-1")
    return table(spark, d, "documents").select("doc_id", t.mojibake_score(F.concat(latin, F.lit("\ufffd\u00e2\u20ac\u2122"))).cast("long").alias("score"))


QUERIES = {
    "c3_fold_scripts": lambda spark, d: _with(spark, d, _SCRIPTS).select("doc_id", t.fold(F.col("text")).alias("value"), t.compact_key(F.lit(_SCRIPTS)).alias("key")),
    "c5_norm_document_forms": lambda spark, d: _with(spark, d, _ALIKE).select("doc_id", t.norm_document(F.col("text"))[0].alias("value")),
    "c6_mojibake_scores": _broken_texts,
    "c7_norm_match_forms": lambda spark, d: _with(spark, d, _ALIKE + " Stra\u00dfe \u03a3\u0391\u03a3").select("doc_id", t.norm_match(F.col("text")).alias("value")),
    "c1_norm_inline": _docs(lambda x: [t.norm_inline(x).alias("value")]),
    "c1_norm_inline_composed": _docs(lambda x: [t.norm_inline(t.composed(F.replace(F.replace(x, F.lit("é"), F.lit("e\u0301")), F.lit("ü"), F.lit("u\u0308")))).alias("value")]),
    "c2_norm_multiline": _docs(lambda x: [t.norm_multiline(x).alias("value")]),
    "c3_fold": _docs(lambda x: [t.fold(x).alias("value")]),
    "c4_compact_key": _docs(lambda x: [t.compact_key(x).alias("value")]),
    "c5_norm_document": _docs(lambda x: [t.norm_document(x)[0].alias("value"), F.array_join(t.norm_document(x)[1], ",").alias("warnings")]),
    "c5_norm_document_whole": _docs(lambda x: [t.norm_document(x)[0].alias("value"), F.array_join(t.norm_document(x)[1], ",").alias("warnings")]),
    "c6_mojibake": _docs(lambda x: [t.mojibake_score(x).cast("long").alias("score"), t.repair_mojibake(x).alias("value")]),
    "c6_mojibake_repairs": _broken_rows,
    "c7_norm_match": _docs(lambda x: [t.norm_match(x).alias("value")]),
    "c8_truncate_marked": _docs(lambda x: [t.truncate_marked(x, 120).alias("value")]),
    "c9_stable_unique": _docs(lambda x: [F.array_join(t.stable_unique(F.split(x, "\n"), 20), "\n").alias("value")]),
    "c10_redact_error": _docs(lambda x: [t.redact(x).alias("value")]),
    "c11_text_hash": _docs(lambda x: [t.text_hash(x).alias("value")]),
}

_of = lambda x, rest="": f"SELECT doc_id, {x} AS value{rest} FROM documents"
_LINES = r"list_transform(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda x: {})"
_document = "regexp_replace(regexp_replace(array_to_string(" + _LINES.format(r"regexp_replace(trim(regexp_replace(x, '[ \t\x0b\x0c\x{a0}]+', ' ', 'g')), '^[•●▪*·] ?', '- ')") + r", chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '^\n+|\n+$', '', 'g')"

#: Signs of broken text in this engine's pattern language, with their weights.
_SIGNS = ((r"[\x{80}-\x{9f}]", 4), (r"[ÃÂÄÅÆÐÑ][\x{80}-\x{bf}]", 3), ("á[º»]", 4), (rf"â[\x{{80}}-\x{{bf}}{t.CP1252}]", 4), (r"ð[\x{80}-\x{bf}]", 4), (r"\x{fffd}", 5))
_SCORE = "CAST(" + " + ".join(f"{w} * len(regexp_extract_all({{x}}, '{p.replace('{', '{{').replace('}', '}}')}'))" for p, w in _SIGNS) + " AS BIGINT)"
_EXTRA = "text || chr(10) || '{}'"

ORACLES = {
    "c3_fold_scripts": f"SELECT doc_id, {base.fold(_EXTRA.format(_SCRIPTS))} AS value, {base.compact(repr(_SCRIPTS))} AS key FROM documents",
    "c5_norm_document_forms": f"SELECT doc_id, {_document.replace('text', '(' + _EXTRA.format(_NFKC) + ')')} AS value FROM documents",
    "c7_norm_match_forms": _of(rf"trim(regexp_replace(replace(lower({_EXTRA.format(_NFKC + ' Strasse')}), 'ß', 'ss'), '\s+', ' ', 'g') || ' σασ')"),
    "c1_norm_inline": _of(rf"nullif(trim(regexp_replace(text, '{_BLANK}', ' ', 'g')), '')"),
    "c1_norm_inline_composed": _of(rf"nullif(trim(regexp_replace(nfc_normalize(text), '{_BLANK}', ' ', 'g')), '')"),
    "c2_norm_multiline": _of("nullif(regexp_replace(regexp_replace(array_to_string(" + _LINES.format(rf"trim(regexp_replace(x, '{_BLANK}', ' ', 'g'))") + r", chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '^\n+|\n+$', '', 'g'), '')"),
    "c3_fold": _of(base.fold("text")),
    "c4_compact_key": _of(base.compact("text")),
    "c5_norm_document": f"SELECT doc_id, substring(v, 1, 200000) AS value, array_to_string(list_filter([CASE WHEN length(v) > 200000 THEN 'TEXT_TRUNCATED' END, CASE WHEN v = '' THEN 'TEXT_EMPTY' END], lambda w: w IS NOT NULL), ',') AS warnings FROM (SELECT doc_id, {_document} AS v FROM documents)",
    "c5_norm_document_whole": f"SELECT doc_id, substring(v, 1, 200000) AS value, array_to_string(list_filter([CASE WHEN length(v) > 200000 THEN 'TEXT_TRUNCATED' END, CASE WHEN v = '' THEN 'TEXT_EMPTY' END], lambda w: w IS NOT NULL), ',') AS warnings FROM (SELECT doc_id, {_document} AS v FROM documents)",
    "c6_mojibake": f"SELECT doc_id, {_SCORE.format(x='text')} AS score, text AS value FROM documents",
    "c6_mojibake_scores": f"SELECT doc_id, {_SCORE.format(x='t')} AS score FROM (SELECT doc_id, array_to_string(list_transform(regexp_split_to_array(regexp_replace(hex(encode(text || chr(10) || '{_SOUND[0]}')), '(..)', '\\1 ', 'g'), ' '), lambda b: CASE WHEN b <> '' THEN chr(CAST('0x' || b AS INTEGER)) ELSE '' END), '') || chr(65533) || chr(226) || chr(8364) || chr(8482) AS t FROM documents)",
    "c6_mojibake_repairs": f"SELECT doc_id, text || CASE doc_id % 3 WHEN 0 THEN chr(10) || '{_SOUND[0]}' WHEN 1 THEN chr(10) || '{_KEPT}' || chr(10) || '{_SOUND[1]}' ELSE chr(10) || '{_KEPT}' || chr(10) || '{_SOUND[2]}' END AS value FROM documents",
    "c7_norm_match": _of(r"trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\s+', ' ', 'g'))"),
    "c8_truncate_marked": _of("CASE WHEN length(text) > 120 THEN rtrim(substring(text, 1, 119)) || '…' ELSE text END"),
    "c9_stable_unique": f"""WITH l AS (SELECT doc_id, i, nullif(trim(regexp_replace(x, '{_BLANK}', ' ', 'g')), '') AS x FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
f AS (SELECT doc_id, min_by(x, i) AS x, min(i) AS i FROM l WHERE x IS NOT NULL GROUP BY doc_id, {base.fold('x')}),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM f)
SELECT documents.doc_id, coalesce(string_agg(x, chr(10) ORDER BY i), '') AS value FROM documents LEFT JOIN (SELECT * FROM r WHERE r <= 20) s ON s.doc_id = documents.doc_id GROUP BY documents.doc_id""",
    "c10_redact_error": _of(r"substring(regexp_replace(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '(?i)(bearer )[a-z0-9._~+/=-]+', '\1***', 'g'), '(?i)((?:token|password|secret)=)[^ &;,]+', '\1***', 'g'), 1, 500)"),
    "c11_text_hash": _of("sha256(text)"),
}
