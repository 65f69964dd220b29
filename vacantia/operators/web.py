"""Web-page extraction over a pages table: links, ids, visible text, embedded job records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia.functions.text import blank_to_null, norm_inline, stable_unique
from vacantia.sources.shared import sized

_ORIGIN = r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)"


def canonical_url(url: Column) -> Column:
    return F.regexp_replace(url, "[?#].*$", "")


def absolute(base: Column, link: Column) -> Column:
    """A link as the page at `base` means it: absolute, scheme-relative, rooted, or beside the page."""
    origin, folder = F.regexp_extract(base, _ORIGIN, 1), F.regexp_replace(canonical_url(base), "[^/]*$", "")
    return (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(F.startswith(link, F.lit("//")), F.concat(F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*:)", 1), link))
        .when(F.startswith(link, F.lit("/")), F.concat(origin, link))
        .when(F.startswith(link, F.lit("#")), F.concat(canonical_url(base), link))
        .otherwise(F.concat(F.when(folder.rlike("^[^:]+://[^/]*/"), folder).otherwise(F.concat(origin, F.lit("/"))), link))
    )


# Entities that are spelt out.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
#: A tag's attributes: quoted values may hold anything, `>` too.
_ATTRIBUTES = r"""((?:[^'">]++|"[^"]*+"|'[^']*+')*+)"""
#: What hides everything inside it: comments, and elements whose content isn't markup; open ones reach to the end.
_HIDDEN = r"""<!--.*?(?:--!?>|\z)|<(script|style|textarea|noscript)(?=[\s/>])(?:[^'">]++|"[^"]*+"|'[^']*+')*+>.*?(?:</\1(?=[\s/>])[^>]*+>|\z)"""
#: Any tag, whole.
_TAG = r"""<[/!?a-z](?:[^'">]++|"[^"]*+"|'[^']*+'|["'])*+(?:>|\z)"""
#: A value behind an attribute's name: in double quotes, in single ones, or bare.
_VALUE = r"""([^\s"'>/=][^\s"'>/=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'=<>`]++)))?"""


def _character(code: Column) -> Column:
    """The character of a code point; the replacement character for none."""
    fine = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.decode(F.unhex(F.lpad(F.hex(F.when(fine, code).otherwise(0xFFFD)), 8, "0")), "UTF-32")


def unescape(x: Column) -> Column:
    """Named (`ENTITIES`) and numeric entities, decimal or hexadecimal, as characters; each is spelt out once."""
    digits = lambda m: F.regexp_extract(m, r"(?i)^&#x?([0-9a-f]+);$", 1)
    code = lambda m: F.coalesce(F.when(F.length(digits(m)) <= 8, F.when(F.lower(m).startswith("&#x"), F.conv(digits(m), 16, 10)).otherwise(digits(m)).try_cast("bigint")), F.lit(0))
    numeric = F.array_distinct(F.regexp_extract_all(x, F.lit(r"(?i)(&#(?:x[0-9a-f]+|[0-9]+);)"), F.lit(1)))
    x = F.when(F.contains(x, F.lit("&#")), F.aggregate(numeric, x, lambda text, m: F.replace(text, m, F.when(code(m) == 38, "&amp;").otherwise(_character(code(m)))))).otherwise(x)
    for mark, char in ENTITIES:
        x = F.replace(x, F.lit(mark), F.lit(char))
    return x


def extract_links(pages: DataFrame) -> DataFrame:
    """page_id, pos, link of every `a` tag's href that isn't blank, as a browser reads it.

    One pass over the tokens of a page: tags in any case, with attributes in any order, over lines, in double, single or no
    quotes; what stands in comments, scripts and styles is no tag. Entities in the value are spelt out.
    """
    tags = F.regexp_extract_all(F.coalesce(F.col("html"), F.lit("")), F.lit(rf"(?is){_HIDDEN}|<a(?=[\s/]){_ATTRIBUTES}>|{_TAG}"), F.lit(2))
    names = lambda t: F.transform(F.regexp_extract_all(t, F.lit(_VALUE), F.lit(1)), F.lower)
    value = lambda t, k: F.get(F.regexp_extract_all(t, F.lit(_VALUE), F.lit(k)), F.array_position(names(t), "href").cast("int") - 1)
    href = lambda t: F.when(F.lower(t).contains("href"), F.concat(value(t, 2), value(t, 3), value(t, 4)))
    found = F.filter(F.transform(F.filter(tags, lambda t: t != ""), href), lambda h: h.isNotNull() & (h != ""))
    each = pages.select("page_id", "url", F.posexplode(found).alias("pos", "href")).withColumn("href", F.trim(unescape(F.col("href")))).filter("href <> ''")
    return each.select("page_id", "pos", absolute(F.col("url"), F.col("href")).alias("link"))


def match_source_links(links: DataFrame, sources: DataFrame, subdomains: bool = False) -> DataFrame:
    """Links whose host is a source's (or, with `subdomains`, below it) and whose path fits its pattern, once each.

    Hosts are joined by equality; with `subdomains` each link has a row for every ending of its host.
    """
    host = F.lower(F.regexp_extract("link", r"^[^:]+://([^/?#:]*)", 1))
    path = F.regexp_extract("link", r"^[^:]+://[^/?#]*([^?#]*)", 1)
    rows = links.select(canonical_url(F.col("link")).alias("link"), host.alias("host"), path.alias("_p")).distinct()
    if subdomains:
        labels = F.split("host", r"\.")
        rows = rows.withColumn("host", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))))
    hit = rows.join(sized(sources), "host").filter(F.expr("_p rlike path_regex"))
    return hit.select("source_code", "link").distinct()


def cap_links(links: DataFrame, source: str, order: list[str], most: int) -> DataFrame:
    w = Window.partitionBy(source).orderBy(*order)
    return links.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most).drop("_r")


def source_job_id(url: Column, id_regex: str) -> Column:
    """The pattern's group in the last path segment, else the segment."""
    last = F.element_at(F.split(F.regexp_replace(canonical_url(url), "/+$", ""), "/"), -1)
    return F.coalesce(blank_to_null(F.regexp_extract(last, id_regex, 1)), blank_to_null(last))


def html_to_text(html: Column) -> Column:
    """Visible text: no comments, scripts, styles or tags, in one pass over a page's tokens; entities spelt out; blanks collapsed; blank is null.

    A `<` that begins no tag stays. Quoted attributes may hold `>`; a tag that isn't closed reaches to the end.
    """
    return norm_inline(unescape(F.regexp_replace(html, rf"(?is){_HIDDEN}|{_TAG}", " ")))


def job_posting(pages: DataFrame) -> DataFrame:
    """page_id and the first JSON-LD object of type JobPosting (variant), also inside arrays and `@graph`; bad JSON is skipped."""
    blocks = F.regexp_extract_all("html", F.lit(r'(?is)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'), F.lit(1))
    each = pages.select("page_id", F.posexplode(blocks).alias("b", "json")).withColumn("v", F.try_parse_json("json")).filter("v IS NOT NULL")
    as_array = lambda path: F.expr(f"try_variant_get(v, '{path}', 'array<variant>')")
    items = each.select("page_id", "b", F.posexplode(F.coalesce(as_array('$["@graph"]'), as_array("$"), F.array("v"))).alias("i", "v"))
    kinds = F.coalesce(F.expr("try_variant_get(v, '$[\"@type\"]', 'array<string>')"), F.array(F.expr("try_variant_get(v, '$[\"@type\"]', 'string')")))
    hit = items.filter(F.array_contains(kinds, "JobPosting")).select("page_id", "b", "i", F.to_json("v").alias("posting"))
    return hit.groupBy("page_id").agg(F.min_by("posting", F.struct("b", "i")).alias("posting")).select("page_id", F.try_parse_json("posting").alias("posting"))


def _at(path: str) -> Column:
    return blank_to_null(F.expr(f"try_variant_get(posting, '{path}', 'string')"))


def posting_salary() -> Column:
    """`min - max`, else the value, then currency and unit, of a `posting` column."""
    low, high, one = _at("$.baseSalary.value.minValue"), _at("$.baseSalary.value.maxValue"), F.coalesce(_at("$.baseSalary.value.value"), F.when(_at("$.baseSalary.value.minValue").isNull(), _at("$.baseSalary.value.maxValue")), _at("$.baseSalary.value.minValue"))
    amount = F.when(low.isNotNull() & high.isNotNull(), F.concat(low, F.lit(" - "), high)).otherwise(one)
    return blank_to_null(F.concat_ws(" ", amount, _at("$.baseSalary.currency"), _at("$.baseSalary.value.unitText")))


def posting_locations() -> Column:
    """`region - locality` of each place unless one contains the other, each once, comma-joined."""
    region, town = "try_variant_get(p, '$.address.addressRegion', 'string')", "try_variant_get(p, '$.address.addressLocality', 'string')"
    one = f"CASE WHEN {region} IS NULL OR contains(lower({town}), lower({region})) THEN {town} WHEN {town} IS NULL OR contains(lower({region}), lower({town})) THEN {region} ELSE {region} || ' - ' || {town} END"
    lists = "coalesce(try_variant_get(posting, '$.jobLocation', 'array<variant>'), array(try_variant_get(posting, '$.jobLocation', 'variant')))"
    return blank_to_null(F.expr(f"array_join(array_distinct(filter(transform({lists}, p -> {one}), x -> x IS NOT NULL)), ', ')"))


def section_between(text: Column, heading: str, stops: list[str]) -> Column:
    """The text behind a heading up to the nearest of the stops, without regard to case; null without the heading."""
    at = F.instr(F.lower(text), heading.lower())
    rest = F.substr(text, at + len(heading))
    places = [F.nullif(F.instr(F.lower(rest), s.lower()), F.lit(0)) for s in stops]
    end = F.least(*places) if len(places) > 1 else places[0]
    return F.when(at > 0, norm_inline(F.when(end.isNotNull(), F.substr(rest, F.lit(1), end - 1)).otherwise(rest)))


def split_tags(x: Column) -> Column:
    return stable_unique(F.split(x, "[,;]"))


CAREER_PATHS = ("/careers", "/jobs", "/tuyen-dung", "/recruitment")


def propose_career_urls(domains: DataFrame) -> DataFrame:
    """Each domain with each of the common paths; the domain without scheme, closing slashes and capitals."""
    clean = F.lower(F.regexp_replace(F.regexp_replace(F.trim("domain"), r"^[A-Za-z]+://", ""), "/+$", ""))
    rows = domains.select(clean.alias("domain")).filter("domain <> ''").distinct()
    return rows.select("domain", F.explode(F.array(*map(F.lit, CAREER_PATHS))).alias("path")).select("domain", F.concat(F.lit("https://"), "domain", "path").alias("url"))
