"""Text normalisation as Column functions: all built-in expressions, so they stay inside generated code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _plain_letters() -> tuple[str, str]:
    """Lower-case letters of all scripts that are another letter with marks, and that letter; and `đ`, `ø`, whose stroke isn't a mark."""
    import unicodedata

    pairs = [("đ", "d"), ("ø", "o")]
    for c in map(chr, range(0x80, 0x30000)):
        parts = unicodedata.normalize("NFD", c)
        if parts != c and c == c.lower() and all(unicodedata.category(x)[0] == "M" for x in parts[1:]):
            pairs.append((c, parts[0]))
    return "".join(c for c, _ in pairs), "".join(p for _, p in pairs)


ACCENTED, PLAIN = _plain_letters()
_INVISIBLE = "[​‌‍⁠﻿]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once; long ladders over one value stay small in generated code."""
    return F.element_at(F.transform(F.array(value), body), 1)


def composed(x: Column, form: str = "NFC", casefold: bool = False) -> Column:
    """Unicode normalisation (NFC, NFKC, …), which no built-in function has: an Arrow function over whole batches.

    With `casefold` the full folding of case follows, which `lower` isn't. Put it once in front of the others where texts
    may hold decomposed letters or compatibility forms. Texts of ASCII alone don't leave for Python, and of the others a
    function holds about `PART_BYTES` as objects at once, whatever a batch has.
    """
    import pyarrow as pa

    def run(batch: pa.Array) -> pa.Array:
        import unicodedata

        def one(t: str) -> str:
            t = unicodedata.normalize(form, t)
            return t.casefold() if casefold else t

        made = [pa.array([t if t is None else one(t) for t in part.to_pylist()], pa.string()) for part in _parts(batch)]
        out = pa.concat_arrays(made) if made else batch
        pa.default_memory_pool().release_unused()
        return out

    run.__annotations__ = {"batch": pa.Array, "return": pa.Array}
    plain = F.octet_length(x) == F.length(x)
    return F.when(plain, F.lower(x) if casefold else x).otherwise(F.arrow_udf(run, "string")(F.when(~plain, x)))


#: Bytes of texts that a function of Arrow arrays makes objects of at once; one longer text is a part of its own.
PART_BYTES = 1 << 20


def _parts(batch):
    """An Arrow array of texts in slices of about `PART_BYTES`."""
    import numpy as np
    import pyarrow.compute as pc

    group = np.cumsum(pc.fill_null(pc.binary_length(batch), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // PART_BYTES
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(batch)] if len(batch) else [0]
    for a, b in zip(edges, edges[1:], strict=False):
        yield batch.slice(a, b - a)


def blank_to_null(x: Column) -> Column:
    return F.when(x != "", x)


def _clean(x: Column, kept: str = " -~") -> Column:
    """Whether a text is of `kept` characters and single spaces between words, which no normaliser changes but for case."""
    return ~(x.rlike(f"[^{kept}]") | F.contains(x, F.lit("  ")) | F.startswith(x, F.lit(" ")) | F.endswith(x, F.lit(" ")))


#: Visible ASCII and the letters that follow, as far as the Vietnamese ones; none is white space to the patterns below.
_LETTERS = " -~À-ỹ"


def norm_inline(x: Column) -> Column:
    """One line: zero-width characters go, control and white space collapse to single spaces; blank is null.

    What is clean, as most texts are, costs one look. So it is in `norm_multiline` and `fold`.
    """
    clean = _clean(x, _LETTERS) & (x != "")
    return F.when(clean, x).otherwise(_norm_inline(x))


def _norm_inline(x: Column) -> Column:
    x = F.regexp_replace(x, _INVISIBLE, "")
    return blank_to_null(F.trim(F.regexp_replace(x, r"[\s\x00-\x1f\x7f ]+", " ")))


def norm_multiline(x: Column) -> Column:
    """As `norm_inline` for each line; at most one empty line in a row."""
    return F.when(_clean(x, _LETTERS) & (x != ""), x).otherwise(_norm_multiline(x))


def _norm_multiline(x: Column) -> Column:
    x = F.regexp_replace(F.regexp_replace(x, _INVISIBLE, ""), "\r\n?", "\n")
    lines = F.transform(F.split(x, "\n"), lambda y: F.trim(F.regexp_replace(y, r"[\s\x00-\x1f\x7f ]+", " ")))
    return blank_to_null(F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"), r"^\n+|\n+$", ""))


def fold(x: Column) -> Column:
    """Lower case without marks in any script (đ is d), single spaces. Texts of ASCII alone take a short way."""
    return F.when(_clean(x), F.lower(x)).otherwise(_fold(x))


def _fold(x: Column) -> Column:
    plain = F.translate(F.lower(F.regexp_replace(x, _INVISIBLE, "")), ACCENTED, PLAIN)
    whole = F.regexp_replace(plain, r"\p{M}+", "")
    return F.trim(F.regexp_replace(F.when(F.octet_length(x) == F.length(x), F.lower(x)).otherwise(whole), r"\s+", " "))


def compact_key(x: Column) -> Column:
    return F.regexp_replace(fold(x), "[^a-z0-9+#]+", "")


def norm_match(x: Column) -> Column:
    """NFKC, case folded in full, with single spaces."""
    return F.trim(F.regexp_replace(composed(x, "NFKC", casefold=True), r"\s+", " "))


def norm_document(x: Column, most: int = 200_000) -> tuple[Column, Column]:
    """The document's lines in NFKC, bullets as `- `, at most one empty line in a row, cut at `most`; and its warnings."""
    lines = F.transform(F.split(F.regexp_replace(F.regexp_replace(composed(x, "NFKC"), "\r\n?", "\n"), "[\x00-\x08\x0e-\x1f\x7f]", ""), "\n"), lambda y: F.regexp_replace(F.trim(F.regexp_replace(y, r"[ \t\x0b\x0c ]+", " ")), "^[•●▪*·] ?", "- "))
    text = F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"), r"^\n+|\n+$", "")
    warnings = F.filter(F.array(F.when(F.length(text) > most, "TEXT_TRUNCATED"), F.when(text == "", "TEXT_EMPTY")), lambda w: w.isNotNull())
    return F.substring(text, 1, most), warnings


def truncate_marked(x: Column, n: int) -> Column:
    """At most n characters; what is cut ends in an ellipsis."""
    return F.when(F.length(x) > n, F.concat(F.rtrim(F.substring(x, 1, n - 1)), F.lit("…"))).otherwise(x)


def stable_unique(items: Column, most: int | None = None) -> Column:
    """Cleaned items, the first of each folded form, in order. Each is folded once; the first of a form stands first when sorted."""
    clean = F.filter(F.transform(items, norm_inline), lambda y: y.isNotNull())
    marked = F.array_sort(F.transform(clean, lambda y, i: F.struct(fold(y).alias("k"), i.alias("i"), y.alias("y"))))

    def first(ps: Column) -> Column:
        own = F.filter(ps, lambda p, i: (i == 0) | (F.get(ps, i - 1)["k"] != p["k"]))
        return F.transform(F.array_sort(F.transform(own, lambda p: F.struct(p["i"].alias("i"), p["y"].alias("y")))), lambda p: p["y"])

    out = let(marked, first)
    return F.slice(out, 1, most) if most else out


def redact(x: Column, most: int = 500) -> Column:
    """Bearer tokens and values of token, password and secret are masked, blanks collapse, the end is cut."""
    x = F.regexp_replace(F.trim(F.regexp_replace(x, r"\s+", " ")), r"(?i)(bearer )[a-z0-9._~+/=-]+", "$1***")
    return F.substring(F.regexp_replace(x, r"(?i)((?:token|password|secret)=)[^ &;,]+", "$1***"), 1, most)


# What broken encodings look like, and how much each counts; the characters of cp1252 for bytes 80 to 9F, and
# the same bytes in Latin-1.
CP1252 = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
_BYTES = CP1252.encode("cp1252").decode("latin-1")
MOJIBAKE = (("[\u0080-\u009f]", 4), ("[ÃÂÄÅÆÐÑ][\u0080-¿]", 3), ("á[º»]", 4), (f"â[\u0080-¿{CP1252}]", 4), ("ð[\u0080-¿]", 4))
_ANY = "|".join(p for p, _ in MOJIBAKE)
_ENDS = "\n\r\x0b\x0c\x1c-\x1e\u0085  "
#: All other characters, by ranges: fast, and a run of them is one loop however long a line is.
_BODY = r"[\x1f-\x84\x86-‧‪-\x{10ffff}\x00-\x09\x0e-\x1b]"
#: A line with its end.
_LINE = f"{_BODY}*+(?:\r\n|[{_ENDS}])|{_BODY}++"


def _signs(x: Column) -> Column:
    """What signs are looked for in: a text whose runs of ASCII are a space each, since signs are of other characters that touch."""
    return F.regexp_replace(x, "[\\x00-\\x7f]+", " ")


def _broken(signs: Column) -> Column:
    return sum((F.regexp_count(signs, F.lit(p)) * w for p, w in MOJIBAKE), F.lit(0))


def mojibake_score(x: Column) -> Column:
    """Signs of text that was read in a wrong encoding, and lost characters."""
    return let(_signs(x), lambda s: _broken(s) + F.regexp_count(s, F.lit("�")) * 5)


def _read_again(x: Column, signs: Column) -> Column:
    """Latin-1 or cp1252 text with signs that was UTF-8 is read again, where that lowers the score; no text can be of both."""
    high = F.regexp_replace(signs, "[\u0000-ÿ]+", "")  # what Latin-1 lacks
    fits = let(high, lambda h: (h == "") | (~h.rlike(f"[^{CP1252}]") & ~signs.rlike("[\u0080-\u009f]")))
    raw = F.encode(F.when(fits, F.when(high != "", F.translate(x, CP1252, _BYTES)).otherwise(x)), "ISO-8859-1").cast("string")
    better = lambda again: again.isNotNull() & (let(_signs(again), _broken) < _broken(signs))
    return let(F.when(F.is_valid_utf8(raw), raw), lambda again: F.when(better(again), again).otherwise(x))


def repair_mojibake(x: Column) -> Column:
    """The whole text read again if that helps, else each of its lines for which it helps. Only what has signs is looked at."""
    line = lambda y: F.when(y.rlike(_ANY), let(_signs(y), lambda s: _read_again(y, s))).otherwise(y)
    lines = lambda t: F.array_join(F.transform(F.regexp_extract_all(t, F.lit(_LINE), F.lit(0)), line), "")
    whole = lambda v: let(_read_again(v["x"], v["s"]), lambda w: F.when(w != v["x"], w).otherwise(lines(v["x"])))
    return let(F.struct(x.alias("x"), _signs(x).alias("s")), lambda v: F.when(v["s"].rlike(_ANY), whole(v)).otherwise(v["x"]))


def text_hash(x: Column) -> Column:
    return F.sha2(x.cast("binary"), 256)
