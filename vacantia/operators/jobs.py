"""Field normalisers of job postings. Scalar ones are Column functions; list ones explode and join small tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.functions.text import blank_to_null, compact_key, fold, let, norm_inline, norm_multiline, stable_unique, truncate_marked
from vacantia.sources import taxonomy
from vacantia.sources.shared import sized, written

_DEC = "decimal(38,6)"


def parse_number(x: Column) -> Column:
    """A number with `.` or `,` as decimal or grouping mark: the last of two kinds is the decimal mark; one mark before
    three digits, and repeated marks, group thousands."""
    dots, commas = F.length(x) - F.length(F.translate(x, ".", "")), F.length(x) - F.length(F.translate(x, ",", ""))
    plain = (
        F.when((dots > 0) & (commas > 0), F.when(F.instr(F.reverse(x), ".") < F.instr(F.reverse(x), ","), F.translate(x, ",", "")).otherwise(F.translate(F.translate(x, ".", ""), ",", ".")))
        .when((dots + commas > 1) | x.rlike(r"^\d+[.,]\d{3}$"), F.translate(x, ".,", ""))
        .otherwise(F.translate(x, ",", "."))
    )
    return plain.try_cast(_DEC)


#: Amounts from here on are no salary; without a bound one such text would end the whole job by overflow.
_FAR = 10**15
_AMOUNT = r"(\d+(?:[.,]\d+)*)\s*(trieu|tr|ty|k)?(?![a-z0-9])"


def salary(text: Column) -> Column:
    """struct(salary_min, salary_max, currency) of a salary text."""
    return let(F.coalesce(fold(text), F.lit("")), _salary)


def _salary(f: Column) -> Column:
    numbers = F.transform(F.regexp_extract_all(f, F.lit(_AMOUNT), F.lit(1)), lambda x: let(let(x, parse_number), lambda v: F.when(v < _FAR, v)))
    scale = F.transform(F.regexp_extract_all(f, F.lit(_AMOUNT), F.lit(2)), lambda u: F.when(u.isin("trieu", "tr"), 1_000_000).when(u == "ty", 1_000_000_000).when(u == "k", 1000).otherwise(1))
    return let(F.struct(numbers.alias("n"), scale.alias("s")), lambda v: _salary_of(f, v["n"], v["s"]))


def _salary_of(f: Column, numbers: Column, scale: Column) -> Column:
    usd, vnd = f.rlike(r"\$|\busd\b|\bdollars?\b"), f.rlike(r"₫|\b(vnd|dong)\b|\d\s*d\b|\d\s*(trieu|tr|ty)\b")
    a, b, sa, sb = F.get(numbers, F.lit(0)), F.get(numbers, F.lit(1)), F.get(scale, F.lit(0)), F.get(scale, F.lit(1))
    spread = lambda v, own, other: v * F.when((own == 1) & (other > 1) & (v < 100_000), other).otherwise(own)
    low, high, n = spread(a, sa, sb), spread(b, sb, sa), F.size(numbers)
    one = a * sa
    between = f.rlike(r"\d\s*(?:trieu|tr|ty|k|usd|vnd|d|\$)*\s*(?:-|–|—|~|\bto\b|\bden\b)\s*\$?\s*\d")
    upper, lower = f.rlike(r"\b(up to|upto|toi da|len den|max|under|duoi)\b"), f.rlike(r"\b(from|tu|tren|over|min|at least|toi thieu)\b|\d\s*(?:trieu|tr|ty|k|usd|vnd)?\s*\+")
    none = (usd & vnd) | f.rlike(r"\b(thoa thuan|negotiable|competitive|canh tranh|thuong luong)\b") | (f == "")
    whole = lambda v: F.round(v, 0).try_cast("bigint")
    lo = F.when(none, None).when(between & (n >= 2), F.least(low, high)).when(n > 1, None).when(upper, None).otherwise(one)
    hi = F.when(none, None).when(between & (n >= 2), F.greatest(low, high)).when(n > 1, None).when(upper, one).when(lower, None).otherwise(one)
    return F.struct(whole(lo).alias("salary_min"), whole(hi).alias("salary_max"), F.when(usd & vnd, None).when(usd, "USD").when(vnd, "VND").alias("currency"))


_SPAN = r"(\d+(?:[.,]\d+)?)\s*\+?\s*(years?|yrs?|nam|months?|thang)?"


def experience(text: Column) -> Column:
    """struct(experience_min, experience_max) in years of an experience text."""
    return let(F.coalesce(fold(text), F.lit("")), _experience)


def _experience(f: Column) -> Column:
    nums = F.transform(F.regexp_extract_all(f, F.lit(_SPAN), F.lit(1)), lambda v: F.translate(v, ",", ".").try_cast("double"))
    units = F.transform(F.regexp_extract_all(f, F.lit(_SPAN), F.lit(2)), lambda u: F.when(u.rlike("^(month|thang)"), 12).when(u != "", 1).otherwise(0))
    return let(F.struct(nums.alias("n"), units.alias("u")), lambda v: _experience_of(f, v["n"], v["u"]))


def _experience_of(f: Column, nums: Column, units: Column) -> Column:
    n, known = F.size(nums), F.array_max(units)
    year = lambda i: F.get(nums, F.lit(i)) / F.when(F.get(units, F.lit(i)) > 0, F.get(units, F.lit(i))).otherwise(F.get(units, F.lit(1 - i)))
    both = n >= 2
    between = f.rlike(r"\d\s*(?:years?|yrs?|nam|months?|thang)?\s*(?:-|–|~|\bto\b|\bden\b)\s*\d")
    joined = both & ~between & (F.get(units, F.lit(0)) == 1) & (F.get(units, F.lit(1)) == 12)
    upper = f.rlike(r"\b(under|up to|less than|duoi|toi da|max)\b")
    lower = f.rlike(r"\d\s*\+|\b(over|at least|more than|tren|from|tu|min|toi thieu)\b")
    months = (n == 1) & (F.get(units, F.lit(0)) == 12)
    free = f.rlike(r"\b(no experience|khong yeu cau|khong can kinh nghiem|chua co kinh nghiem|fresher)\b")
    x = F.when(joined, year(0) + year(1)).otherwise(F.get(nums, F.lit(0)) / F.nullif(F.get(units, F.lit(0)), F.lit(0)))
    unknown = (n == 0) | (known == 0) | (both & ~between & ~joined)
    lo = F.when(free, 0.0).when(unknown, None).when(between & both, F.least(year(0), year(1))).when(upper, 0.0).otherwise(x)
    hi = F.when(free, None).when(unknown, None).when(between & both, F.greatest(year(0), year(1))).when(upper, x).when(lower | months, None).otherwise(x)
    return F.struct(F.round(lo, 2).alias("experience_min"), F.round(hi, 2).alias("experience_max"))


def classify_seniority(text: Column) -> Column:
    """The highest level whose rule fits; a rule that is excluded and not allowed again passes on to the next."""
    return let(F.coalesce(fold(text), F.lit("")), _level)


def _level(f: Column) -> Column:
    out = F.lit("UNKNOWN")
    for level, _, pattern, exclude, allow in reversed(taxonomy.SENIORITY):
        fits = f.rlike(pattern)
        if exclude:
            fits = fits & (~f.rlike(exclude) | (f.rlike(allow) if allow else F.lit(False)))
        out = F.when(fits, level).otherwise(out)
    return out


def resolve_seniority(explicit: Column, title: Column, low: Column, high: Column) -> Column:
    """The explicit text's level, else the title's, else one by years; the lower bound comes first, negatives don't count."""
    by_years = lambda years: F.when(years < 0.5, "ENTRY_LEVEL").when(years < 2, "JUNIOR").when(years < 5, "MID").when(years >= 5, "SENIOR")
    known = lambda x: let(classify_seniority(x), lambda v: F.when(v != "UNKNOWN", v))
    return F.coalesce(known(explicit), known(title), let(F.coalesce(F.when(low >= 0, low), F.when(high >= 0, high)), by_years), F.lit("UNKNOWN"))


def classify_job_type(text: Column, title: Column) -> Column:
    def one(x: Column) -> Column:
        def ladder(f: Column) -> Column:
            out = F.lit(None).cast("string")
            for kind, pattern in reversed(taxonomy.JOB_TYPES):
                out = F.when(f.rlike(pattern), kind).otherwise(out)
            return out

        return let(F.coalesce(F.translate(fold(x), "_", " "), F.lit("")), ladder)

    return F.coalesce(one(text), one(title), F.lit("UNKNOWN"))


ZONE = "Asia/Ho_Chi_Minh"


def _day(as_of: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(as_of, ZONE))


def _dates(text: Column) -> Column:
    return F.coalesce(*(F.to_date(F.try_to_timestamp(text, F.lit(p))) for p in ("yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy")))


def _instants(text: Column) -> Column:
    """ISO instants with an offset as they are; local times are of the domain's zone."""
    local = F.coalesce(*(F.try_to_timestamp(text, F.lit(p)) for p in ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "dd/MM/yyyy HH:mm", "HH:mm dd/MM/yyyy")))
    return F.coalesce(F.try_to_timestamp(F.when(text.rlike(r"(Z|[+-]\d\d:?\d\d)$"), text)), F.to_utc_timestamp(local, ZONE))


def _ago(f: Column, unit: str) -> Column:
    return F.regexp_extract(f, rf"^(\d{{1,6}})\s*(?:{unit})\s*(?:ago|truoc)$", 1).try_cast("int")  # more would leave the calendar


def posted_at(text: Column, as_of: Column) -> Column:
    """When a posting appeared (UTC): exact times, hours or minutes ago, or the start of a day in the domain's zone."""
    return let(F.struct(fold(text).alias("f"), text.alias("t"), as_of.alias("a"), _day(as_of).alias("d")), lambda v: _posted(v["f"], v["t"], v["a"], v["d"]))


def _posted(f: Column, text: Column, as_of: Column, day: Column) -> Column:
    start = lambda d: F.to_utc_timestamp(d.cast("timestamp"), ZONE)
    minutes = F.coalesce(_ago(f, "minutes?|phut"), _ago(f, "hours?|gio") * 60)
    days = F.when(f.rlike("^(today|hom nay)$"), 0).when(f.rlike("^(yesterday|hom qua)$"), 1).otherwise(F.coalesce(_ago(f, "days?|ngay"), _ago(f, "weeks?|tuan") * 7))
    return F.coalesce(_instants(text), as_of - F.make_dt_interval(F.lit(0), F.lit(0), minutes), start(F.date_sub(day, days)), start(F.add_months(day, -_ago(f, "months?|thang"))), start(_dates(text)))


def deadline_at(text: Column, as_of: Column) -> Column:
    """When a posting ends (UTC): exact times, or the last microsecond of a day in the domain's zone."""
    return let(F.struct(fold(text).alias("f"), text.alias("t"), _day(as_of).alias("d")), lambda v: _deadline(v["f"], v["t"], v["d"]))


def _deadline(f: Column, text: Column, day: Column) -> Column:
    end = lambda d: F.to_utc_timestamp(F.date_add(d, 1).cast("timestamp"), ZONE) - F.expr("interval 1 microsecond")
    ahead = F.coalesce(*(F.regexp_extract(f, p, 1).try_cast("int") for p in (r"^in (\d{1,6}) days?$", r"^(\d{1,6}) days? left$", r"^con (\d{1,6}) ngay( nua)?$")))
    ahead = F.when(f.rlike("^(today|hom nay)$"), 0).when(f.rlike("^(tomorrow|ngay mai)$"), 1).otherwise(ahead)
    back = F.when(f.rlike("^(yesterday|hom qua)$"), 1).otherwise(F.coalesce(_ago(f, "days?|ngay"), _ago(f, "weeks?|tuan") * 7))
    return F.coalesce(_instants(text), end(F.date_add(day, ahead)), end(F.date_sub(day, back)), end(_dates(text)))


def apply_target(apply_url: Column, raw_type: Column, detail_url: Column) -> Column:
    """struct(apply_url, apply_type): only http(s) and mailto targets; others and missing ones are the detail page."""
    origin = lambda u: F.lower(F.regexp_extract(u, r"^(https?://[^/?#]+)", 1))
    port = lambda u: F.regexp_replace(F.regexp_replace(origin(u), r"^(http://[^:]+):80$", "$1"), r"^(https://[^:]+):443$", "$1")
    safe = F.when(apply_url.rlike(r"(?i)^(https?://[^/?#@\s]+|mailto:[^@\s]+@[^@\s]+)"), apply_url).when(
        apply_url.rlike("^/[^/]") & (origin(detail_url) != ""), F.concat(origin(detail_url), apply_url)
    )
    out = F.coalesce(safe, detail_url)
    by = F.when(out.rlike("(?i)^mailto:"), "EMAIL").when(out == detail_url, "DETAIL_PAGE").when(port(out) == port(detail_url), "APPLY_BUTTON").otherwise("EXTERNAL")
    kind = F.when(out.isNull(), "UNKNOWN").when(by == "EMAIL", "EMAIL").when((by == "EXTERNAL") & (raw_type.isNull() | (raw_type == "DETAIL_PAGE")), "EXTERNAL").otherwise(F.coalesce(raw_type, by))
    return F.struct(out.alias("apply_url"), kind.alias("apply_type"))


def content_hash(fields: dict[str, Column], skills: Column | None = None) -> Column:
    """SHA-256 over `name=length:value` lines; null is -1 and lengths are code points."""
    line = lambda name, v: F.concat(F.lit(name + "="), F.coalesce(F.length(v), F.lit(-1)).cast("string"), F.lit(":"), F.coalesce(v, F.lit("")))
    lines = [line(k, norm_multiline(v)) for k, v in fields.items()]
    if skills is not None:
        lines.append(F.array_join(F.transform(skills, lambda s, i: F.concat(F.lit("skills["), i.cast("string"), F.lit("]="), F.length(s).cast("string"), F.lit(":"), s)), "\n"))
    return F.sha2(F.concat_ws("\n", *lines).cast("binary"), 256)


def format_experience(low: Column, high: Column) -> Column:
    lo, hi = F.when((low >= 0) & ~F.isnan(low), low), F.when((high >= 0) & ~F.isnan(high), high)
    n = lambda v: F.regexp_replace(F.regexp_replace(v.cast("decimal(10,2)").cast("string"), r"0+$", ""), r"\.$", "")
    return F.when(lo == hi, F.concat(n(lo), F.lit(" years"))).when(lo.isNotNull() & hi.isNotNull(), F.concat(n(lo), F.lit(" - "), n(hi), F.lit(" years"))).when(
        lo.isNotNull(), F.concat(F.lit("From "), n(lo), F.lit(" years"))
    ).when(hi.isNotNull(), F.concat(F.lit("Up to "), n(hi), F.lit(" years")))


def join_stable(items: Column) -> Column:
    """Cleaned items once each by folded form, in the order of (folded, item), comma-joined."""
    clean = F.filter(F.transform(items, norm_inline), lambda x: x.isNotNull())
    pairs = F.array_sort(F.transform(clean, lambda x: F.struct(fold(x).alias("f"), x.alias("v"))))
    first = let(pairs, lambda ps: F.filter(ps, lambda p, i: (i == 0) | (F.get(ps, i - 1)["f"] != p["f"])))
    return F.array_join(F.transform(first, lambda p: p["v"]), ", ")


def text_passage(sections: dict[str, Column], most: int = 2400) -> Column:
    """`passage: ` and the sections that have a value, one per line, cut at `most`."""
    lines = [F.when(v.isNotNull(), F.concat(F.lit(k + ": "), v)) for k, v in sections.items()]
    return let(F.concat(F.lit("passage: "), F.concat_ws("\n", *lines)), lambda x: truncate_marked(x, most))


def text_query(sections: dict[str, tuple[Column, int]], most: int = 2400) -> Column:
    """`query: ` and labelled sections, each cut to its own limit and to what is left of the whole budget.

    Where all of them fit, as they mostly do, they are just joined; else they are added one by one.
    """
    cut = {k: truncate_marked(blank_to_null(v), n) for k, (v, n) in sections.items()}
    parts = F.filter(F.array(*(F.struct(F.lit(k + ": ").alias("k"), v.alias("v")) for k, v in cut.items())), lambda p: p["v"].isNotNull())

    def add(text: Column, p: Column) -> Column:
        left = most - F.length(text) - F.length(p["k"]) - 1
        return F.when(left > 1, F.concat(text, F.when(text == "query: ", "").otherwise("\n"), p["k"], F.when(F.length(p["v"]) > left, F.concat(F.rtrim(F.substring(p["v"], F.lit(1), left - 1)), F.lit("…"))).otherwise(p["v"]))).otherwise(text)

    whole = F.concat(F.lit("query: "), F.concat_ws("\n", *(F.concat(F.lit(k + ": "), v) for k, v in cut.items())))
    return let(whole, lambda x: F.when(F.length(x) < most - 1, x).otherwise(F.aggregate(parts, F.lit("query: "), add)))


def split_list(x: Column, marks: str = r"[,;|\n]") -> Column:
    return F.filter(F.transform(F.split(x, marks), norm_inline), lambda y: y.isNotNull())


def skill_list(rows: DataFrame, key: str, text: str, aliases: DataFrame) -> DataFrame:
    """key, skills: the parts of `text` by their canonical names, each once by folded form, in order."""
    each = rows.select(key, F.posexplode(split_list(F.col(text))).alias("pos", "raw")).withColumn("k", compact_key(F.col("raw")))
    known = aliases.select(compact_key(F.col("alias")).alias("k"), "canonical").dropDuplicates(["k"])
    named = each.join(sized(known), "k", "left").withColumn("skill", F.coalesce("canonical", "raw"))
    return named.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "skill"))), lambda s: s["skill"]).alias("all")).select(key, stable_unique(F.col("all")).alias("skills"))


#: First words of aliases up to which they are literals of the plan; more are joined.
HEADS = 2000


def phrase_hits(docs: DataFrame, aliases: DataFrame, key: str, text: str) -> DataFrame:
    """key, at, n, alias and the columns of `aliases` (alias: folded words) for every run of words that is an alias.

    Runs are as long as the longest alias. Only words that begin some alias start one, with no more words behind them than
    that, so an alias costs one hash lookup, no pattern is tried, and the work grows with the words of a text.
    """
    heads = aliases.groupBy(F.element_at(F.split("alias", " "), 1).alias("w")).agg(F.max(F.size(F.split("alias", " "))).alias("words"))
    few = heads.limit(HEADS + 1).collect()
    words = max((r.words for r in few), default=1) if len(few) <= HEADS else heads.agg(F.max("words")).first()[0]
    tokens = docs.select(key, _tokens(F.col(text)).alias("t"))
    if len(few) <= HEADS:  # few words begin an alias: only their places leave the array
        starts = F.filter(F.transform("t", lambda w, i: F.when(w.isin([r.w for r in few]), i)), lambda i: i.isNotNull())
        each = tokens.select(key, "t", F.explode(starts).alias("at"))
        each = each.select(key, "at", F.slice("t", F.col("at") + 1, words).alias("t"))
    else:
        runs = tokens.select(key, "t", F.posexplode("t").alias("at", "w")).join(sized(heads.select("w")), "w", "left_semi")
        each = runs.select(key, "at", F.slice("t", F.col("at") + 1, words).alias("t"))
    found = each.select(key, "at", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("t")), lambda n: F.array_join(F.slice("t", F.lit(1), n), " "))).alias("n", "alias"))
    return found.withColumn("n", F.col("n") + 1).join(sized(aliases), "alias")


def phrase_list(text: Column, known: dict[str, str]) -> Column:
    """The hits of `phrase_hits` as an array within the row: at, n, alias and the name that `known` has for it, in the order of at and n.

    For few aliases (folded words: name), which become a literal map.
    """
    heads, words = sorted({a.split(" ")[0] for a in known}), max((len(a.split(" ")) for a in known), default=1)
    if not known:
        return F.array().cast("array<struct<at:int,n:int,alias:string,canonical:string>>")
    names = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))

    def hits(t: Column) -> Column:
        starts = F.filter(F.transform(t, lambda w, i: F.when(w.isin(heads), i)), lambda i: i.isNotNull())
        run = lambda i, n: let(F.array_join(F.slice(t, i + 1, n), " "), lambda a: F.struct(i.alias("at"), n.alias("n"), a.alias("alias"), F.try_element_at(names, a).alias("canonical")))
        runs = F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(words), F.size(t) - i)), lambda n: run(i, n)))
        return F.filter(F.flatten(runs), lambda x: x["canonical"].isNotNull())

    return let(_tokens(text), hits)


def _tokens(text: Column) -> Column:
    """Folded words; a point is of a word if a letter or digit follows, else it parts words by itself."""
    plain = F.regexp_replace(fold(text), "[^a-z0-9+#.]+", " ")  # in two steps: a pattern of both would try each place twice
    return F.split(F.trim(let(plain, lambda x: F.when(F.contains(x, F.lit(".")), F.regexp_replace(x, r"\.(?![a-z0-9])", " ")).otherwise(x))), " ")


def prose_skills(rows: DataFrame, key: str, text: str, aliases: DataFrame) -> DataFrame:
    """key, at, n, alias, canonical: alias phrases in a text; ambiguous aliases never count, ones under three letters only if listed."""
    long = (F.length("alias") > 2) | F.col("alias").isin(*taxonomy.SHORT)
    known = aliases.select(fold(F.col("alias")).alias("alias"), "canonical").filter(long & ~F.col("alias").isin(*taxonomy.AMBIGUOUS))
    return phrase_hits(rows, known.dropDuplicates(["alias"]), key, text)


def merge_skills(raw: Column, found: Column, rich: int = 2) -> Column:
    """The raw list alone if it is rich, else both, each skill once."""
    return F.when(F.size(F.coalesce(raw, F.array())) >= rich, raw).otherwise(stable_unique(F.concat(F.coalesce(raw, F.array()), F.coalesce(found, F.array()))))


def locations(rows: DataFrame, key: str, text: str, aliases: DataFrame) -> DataFrame:
    """key, locations: parts of `text` by canonical names; ambiguous ones stay as they are, what is no place goes."""
    each = rows.select(key, F.posexplode(split_list(F.col(text), r"[,;|/\n]")).alias("pos", "raw")).withColumn("k", compact_key(F.col("raw")))
    known = aliases.select(compact_key(F.col("alias")).alias("k"), "canonical").dropDuplicates(["k"])
    gone = [k.replace("/", "").replace(" ", "").replace(".", "") for k in taxonomy.NOT_PLACES]
    kept = each.filter(~F.col("k").isin(*gone)).join(sized(known), "k", "left")
    name = F.when(F.col("k").isin(*taxonomy.AMBIGUOUS_PLACES), F.col("raw")).otherwise(F.coalesce("canonical", "raw"))
    return kept.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", name.alias("v")))), lambda s: s["v"]).alias("all")).select(key, stable_unique(F.col("all")).alias("locations"))


#: Texts that decide a posting's scalar fields, and those that decide its times.
FIELDS, TIMES = ("salary_text", "experience_text", "title", "job_type_text"), ("posted_text", "deadline_text", "collected_at")


def _looked_up(rows: DataFrame, keys: tuple[str, ...], made: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`rows` with what `made` adds to the distinct values of `keys`: texts repeat, so each is parsed once."""
    known = made(rows.select(*keys).distinct()).withColumnsRenamed({k: f"_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rows.join(known, same, "left").drop(*(f"_{k}" for k in keys))


def _scalars(rows: DataFrame) -> DataFrame:
    out = rows.withColumns({"_s": salary(F.col("salary_text")), "_e": experience(F.col("experience_text"))})
    out = out.withColumns({"salary_min": F.col("_s.salary_min"), "salary_max": F.col("_s.salary_max"), "currency": F.col("_s.currency"), "experience_min": F.col("_e.experience_min"), "experience_max": F.col("_e.experience_max")})
    out = out.withColumn("seniority", resolve_seniority(F.lit(None).cast("string"), F.col("title"), F.col("experience_min"), F.col("experience_max")))
    return out.withColumn("job_type", classify_job_type(F.col("job_type_text"), F.col("title"))).drop("_s", "_e")


def _times(rows: DataFrame) -> DataFrame:
    at = F.col("collected_at").cast("timestamp")
    return rows.withColumns({"posted_at": posted_at(F.col("posted_text"), at), "deadline_at": deadline_at(F.col("deadline_text"), at)})


def faults(raw: DataFrame, key: str) -> Column:
    """array<struct<field, reason>> of what a row can't be normalised for: a blank key, no time of observation, amounts out of range.

    The normalisers give null there; nothing of this ends a job.
    """
    have = lambda n: F.coalesce(fold(F.col(n)), F.lit("")) if n in raw.columns else F.lit("")
    rules = (
        (key, "BLANK", F.trim(F.coalesce(F.col(key).cast("string"), F.lit(""))) == ""),
        ("collected_at", "NO_TIME", F.col("collected_at").isNull() if "collected_at" in raw.columns else F.lit(False)),
        ("salary_text", "OUT_OF_RANGE", F.regexp_replace(have("salary_text"), "[.,]", "").rlike(r"\d{16,}")),
        ("experience_text", "OUT_OF_RANGE", have("experience_text").rlike(r"\d{16,}")),
        ("posted_text", "OUT_OF_RANGE", have("posted_text").rlike(r"^\d{7,}\s*\w+ (ago|truoc)$")),
        ("deadline_text", "OUT_OF_RANGE", have("deadline_text").rlike(r"^(in |con )?\d{7,} (days?|ngay)\b")),
    )
    each = F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(field).alias("field"), F.lit(reason).alias("reason"))) for field, reason, bad in rules))
    return F.filter(each, lambda x: x.isNotNull())


def checked(raw: DataFrame, key: str) -> DataFrame:
    """`raw` with `errors` (`faults`) and `error`: their text, null for a row that can be normalised."""
    out = raw.withColumn("errors", faults(raw, key))
    return out.withColumn("error", blank_to_null(F.array_join(F.transform("errors", lambda x: F.concat(x["field"], F.lit(": "), x["reason"])), "; ")))


def quarantine(rows: DataFrame, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of `checked` that can be normalised, and the others, which are a table of their own in `folder` if one is given."""
    good, bad = rows.filter("error IS NULL").drop("errors", "error"), rows.filter("error IS NOT NULL")
    if folder:
        bad.write.mode("append").parquet(folder)
    return good, bad


def normalized(raw: DataFrame, version: str = "rule-v2", repeated: bool = True) -> DataFrame:
    """Rows of the observation feed with their scalar fields and times.

    With `repeated` each distinct text is parsed once and joined back, which reads `raw` three times: a table, or a cheap
    plan. Without, rows are parsed as they come, in one pass: for few rows behind a costly plan.
    """
    out = _looked_up(_looked_up(raw, FIELDS, _scalars), TIMES, _times) if repeated else _times(_scalars(raw))
    return out.withColumn("normalization_version", F.lit(version))


#: Raw fields that the content hash covers, by kind of cleaning, in its order; the skills stand behind the inline ones.
HASHED_INLINE = ("title", "company_name", "salary_text", "location_text", "experience_text", "seniority_text", "job_type_text", "deadline_text", "posted_text")
HASHED_MULTILINE = ("description_text", "requirements_text", "benefits_text")
HASHED_LAST = ("detail_url", "apply_url", "apply_type")
#: Most characters of a section of the passage, and of the whole.
SECTIONS, PASSAGE = {"Requirements": 4000, "Description": 6000, "Benefits": 2000}, 2400


def raw_hash(fields: dict[str, Column], skills: Column) -> Column:
    """SHA-256 over `name=length:value` lines of the 16 raw fields and the listed skills; null is -1, lengths are code points."""
    return _hash_of({k: (norm_multiline if k in HASHED_MULTILINE else norm_inline)(fields[k]) for k in (*HASHED_INLINE, *HASHED_MULTILINE, *HASHED_LAST)}, skills)


def _hash_of(clean: dict[str, Column], skills: Column) -> Column:
    """`raw_hash` of fields that are clean already."""
    line = lambda name: F.concat(F.lit(name + "="), F.coalesce(F.length(clean[name]), F.lit(-1)).cast("string"), F.lit(":"), F.coalesce(clean[name], F.lit("")))
    listed = F.transform(skills, lambda s, i: F.concat(F.lit("skills["), i.cast("string"), F.lit("]="), F.length(s).cast("string"), F.lit(":"), s))
    lines = [*map(line, HASHED_INLINE), blank_to_null(F.array_join(listed, "\n")), *map(line, HASHED_MULTILINE), *map(line, HASHED_LAST)]
    return F.sha2(F.concat_ws("\n", *lines).cast("binary"), 256)


def taxonomy_order(found: DataFrame, key: str, aliases: DataFrame) -> DataFrame:
    """key, found: the skills of `prose_skills` once each, in the order of the taxonomy's first alias of each."""
    place = aliases.groupBy("canonical").agg(F.min("place").alias("place"))
    return found.select(key, "canonical").distinct().join(sized(place), "canonical").groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "canonical"))), lambda x: x["canonical"]).alias("_found"))


#: Texts of a posting itself, whenever and wherever it was seen.
POSTING = (*FIELDS, "company_name", "skills_text", "seniority_text", "requirements_text", "description_text", "benefits_text")


def _of_posting(raw: DataFrame, own: list[str], digest: Column, skills: DataFrame) -> DataFrame:
    """`_k`, the texts `own` and what they alone decide, each distinct set of them once: scalars, skills, and the cleaned texts as `_<name>`."""
    have = lambda n: F.col(n) if n in own else F.lit(None).cast("string")
    out = _scalars(raw.select(*own).distinct()).withColumn("_k", digest)
    level = let(classify_seniority(have("seniority_text")), lambda v: F.when(v != "UNKNOWN", v))
    clean = {f"_{k}": (norm_multiline if k in HASHED_MULTILINE else norm_inline)(have(k)) for k in POSTING if k != "skills_text"}
    out = written(out.withColumns({"seniority": F.coalesce(level, "seniority"), "_listed": split_list(F.coalesce("skills_text", F.lit("")), r"[,;|\n]"), **clean}), "postings")
    none = F.array().cast("array<string>")
    out = out.join(skill_list(out.filter("skills_text IS NOT NULL"), "_k", "skills_text", skills).withColumnRenamed("skills", "_raw"), "_k", "left")
    prose = out.filter(F.size(F.coalesce("_raw", none)) < 2).select("_k", F.concat_ws("\n", "title", have("requirements_text"), have("description_text")).alias("_prose"))
    ordered = skills if "place" in skills.columns else skills.withColumn("place", F.col("alias"))
    out = out.join(taxonomy_order(prose_skills(prose, "_k", "_prose", skills), "_k", ordered), "_k", "left")
    out = out.withColumn("skills", merge_skills(F.coalesce("_raw", none), F.coalesce("_found", none))).drop("_raw", "_found")
    return out.withColumn("_skills", blank_to_null(join_stable(F.col("skills"))))


def normalize_jobs(raw: DataFrame, key: str, skills: DataFrame, places: DataFrame, version: str = "rule-v2", as_of: Column | None = None) -> DataFrame:
    """Whole normalised jobs, one per row of `raw`, which has one row per `key`; give a table, as it is read several times.

    Scalars and times as `normalized`, the level by the explicit text first; skills: the listed ones by canonical name and,
    where the list is poor, those that title, requirements and description name, in the order of `skills` (column place, else
    of the alias); locations; apply_url and apply_type; the hash of all 16 raw fields and the listed skills; the texts for
    queries and passages with all ten sections (null for a job without any); version and time of normalisation; `errors`
    and `error` (`checked`). `raw` may lack seniority_text, requirements_text, description_text, benefits_text, apply_url and
    apply_type.

    Sources show a posting's texts again, so each distinct set of them is worked on once, and only its digest is dealt with a row.
    """
    own = [k for k in POSTING if k in raw.columns]
    # a length in front of each text, so that no two sets give the same bytes
    digest = F.unhex(F.sha2(F.concat(*(F.coalesce(F.concat(F.length(k).cast("string"), F.lit(":"), F.col(k)), F.lit("-")) for k in own)).cast("binary"), 256))
    rows = _looked_up(raw.withColumn("_k", digest).drop(*own), TIMES, _times)
    by_place = locations(raw.filter("location_text IS NOT NULL").select("location_text").distinct(), "location_text", "location_text", places)
    rows = rows.join(sized(by_place.withColumn("_locations", blank_to_null(join_stable(F.col("locations"))))), "location_text", "left")
    out = rows.join(_of_posting(raw, own, digest, skills), "_k").withColumn("normalization_version", F.lit(version))
    out = checked(out.withColumn("locations", F.coalesce("locations", F.array().cast("array<string>"))), key)
    have = lambda n: F.col(n) if n in raw.columns else F.lit(None).cast("string")
    clean = {k: F.col(f"_{k}") if k in POSTING else norm_inline(have(k)) for k in (*HASHED_INLINE, *HASHED_MULTILINE, *HASHED_LAST)}
    shown_name = lambda x: F.concat(F.substring(x, 1, 1), F.lower(F.translate(F.substring(x, 2, 100), "_", " ")))
    known = lambda c: F.when(F.col(c) != "UNKNOWN", shown_name(F.col(c)))
    shown = {
        "Title": F.col("_title"), "Company": F.col("_company_name"), "Skills": F.col("_skills"), "Seniority": known("seniority"),
        "Experience": format_experience(F.col("experience_min"), F.col("experience_max")), "Locations": F.col("_locations"), "Job type": known("job_type"),
        **{k: truncate_marked(F.col(f"_{k.lower()}_text"), n) for k, n in SECTIONS.items()},
    }
    names = {k: f"s{i}" for i, k in enumerate(shown)}

    def texts(v: Column) -> Column:
        sections = {k: v[n] for k, n in names.items()}
        some = F.coalesce(*sections.values()).isNotNull()
        return F.struct(F.when(some, text_passage(sections, PASSAGE)).alias("passage"), F.when(some, text_query({k: (x, SECTIONS.get(k, 1200)) for k, x in sections.items()})).alias("query"))

    out = out.withColumns(
        {
            "_target": apply_target(have("apply_url"), have("apply_type"), F.col("detail_url")),
            "content_hash": _hash_of(clean, F.col("_listed")),
            "_texts": let(F.struct(*(v.alias(names[k]) for k, v in shown.items())), texts),
            "normalized_at": F.current_timestamp() if as_of is None else as_of,
        }
    ).withColumns({"apply_url": F.col("_target.apply_url"), "apply_type": F.col("_target.apply_type"), "passage": F.col("_texts.passage"), "query": F.col("_texts.query")})
    return out.drop("_k", "_target", "_texts", "_listed", "_skills", "_locations", *(f"_{k}" for k in POSTING if k != "skills_text"))
