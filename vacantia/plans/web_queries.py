"""B: pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from vacantia.operators import web
from vacantia.plans import base
from vacantia.sources import feed, taxonomy

c = F.col
pages = lambda spark, d: feed.table(spark, d, "pages")


def b3(spark, d):
    links = web.extract_links(pages(spark, d)).select("link").unionByName(pages(spark, d).select(c("url").alias("link")))
    return web.match_source_links(links, taxonomy.sources(spark), subdomains=True)


def b3_hosts(spark, d):
    """Sources are the hosts of the pages themselves, so that a host and what lies below it are told apart."""
    host = lambda x: F.lower(F.regexp_extract(x, r"^[^:]+://([^/?#:]*)", 1))
    own = pages(spark, d).select(host(c("url")).alias("host")).filter("host <> ''").groupBy("host").count().filter("count > 1")
    sources = own.select(F.concat(F.lit("S:"), "host").alias("source_code"), "host", F.lit("^/en/").alias("path_regex"))
    return web.match_source_links(pages(spark, d).select(c("url").alias("link")).unionByName(pages(spark, d).select(F.replace("url", F.lit("://"), F.lit("://below.")).alias("link"))), sources)


def b4(spark, d):
    links = web.extract_links(pages(spark, d))
    return web.cap_links(links.withColumn("source", c("page_id") % 7), "source", ["page_id", "pos"], 40).select("source", "page_id", "pos", "link")


_POSTING = '{"@graph":[{"@type":"Thing"},{"@type":["JobPosting","X"],"title":"T%d","baseSalary":{"currency":"USD","value":{"minValue":10,"maxValue":%d,"unitText":"MONTH"}},"jobLocation":[{"address":{"addressRegion":"R","addressLocality":"L%d"}},{"address":{"addressLocality":"Solo"}}]}]}'


def _postings(spark, d):
    """Each page with an embedded record, as the given pages have none."""
    block = F.format_string('<script type="application/ld+json">' + _POSTING + "</script>", "page_id", c("page_id") + 20, "page_id")
    return web.job_posting(pages(spark, d).select("page_id", F.concat(F.lit('<script type="application/ld+json">{bad</script>'), "html", block).alias("html")))


#: Records in other shapes, by page: alone with one place, in a list with a lower bound only, without a type that counts.
_SHAPES = (
    '{"@type":"JobPosting","title":"One %d","baseSalary":{"currency":"EUR","value":{"value":15,"unitText":"HOUR"}},"jobLocation":{"address":{"addressRegion":"Region","addressLocality":"Town %d"}}}',
    '[{"@type":"Person"},{"@type":["X","JobPosting"],"title":"Two %d","baseSalary":{"value":{"minValue":10,"unitText":"YEAR"}},"jobLocation":[{"address":{"addressRegion":"Hanoi","addressLocality":"Hanoi City %d"}},{"address":{"addressRegion":"Hue"}}]}]',
    '{"@graph":[{"@type":"Jobs","title":"None %d"},{"title":"%d"}]}',
)


def _shaped(spark, d):
    kind = c("page_id") % 3
    record = F.when(kind == 0, F.format_string(_SHAPES[0], "page_id", "page_id")).when(kind == 1, F.format_string(_SHAPES[1], "page_id", "page_id")).otherwise(F.format_string(_SHAPES[2], "page_id", "page_id"))
    block = F.concat(F.lit("<SCRIPT id=x type=\"application/ld+json\">\n"), record, F.lit("</SCRIPT>"))
    found = web.job_posting(pages(spark, d).select("page_id", F.concat("html", block).alias("html")))
    return found.select("page_id", F.expr("try_variant_get(posting, '$.title', 'string')").alias("title"), web.posting_salary().alias("salary"), web.posting_locations().alias("locations"))


#: Six ways to write a link, by page: as it is, upper case with more blanks, single quotes, over lines behind an attribute that looks like it, bare, and in a comment.
_FORMS = (None, r'<A class=x HREF = "$1"', "<a href='$1'", '<a\n data-x=\'<a href="/no">\'\n\thref="$1"', r"<a href=$1", r'<!-- <a href="$1"> --><b title="<a href=no>"')


def _varied(spark, d):
    html = c("html")
    for k, form in enumerate(_FORMS):
        if form:
            html = F.when(c("page_id") % 6 == k, F.regexp_replace("html", r'<a href="([^" ]+)"', form)).otherwise(html)
    return pages(spark, d).withColumn("html", html)


def _marked(spark, d):
    """Texts with entities, hidden parts and signs that aren't tags, made from each page's url."""
    url = F.concat(F.lit("<p title='a > b'>1 < 2 &amp;&#38;#39; "), c("url"), F.lit(" &#233;&#x1F600;&#xe9;&#0;</p><!-- <p>no</p> --><SCRIPT>if (a < b) '</p>'</SCRIPT ><style>no</style><img alt=\"x>y\">end<br"))
    return pages(spark, d).select("page_id", web.html_to_text(url).alias("value"))


QUERIES = {
    "b1_extract_links_forms": lambda spark, d: web.extract_links(_varied(spark, d)),
    "b6_html_to_text_forms": _marked,
    "b7_b8_b9_jsonld_shapes": _shaped,
    "b1_extract_links": lambda spark, d: web.extract_links(pages(spark, d)),
    "b2_canonical_url": lambda spark, d: pages(spark, d).select("page_id", web.canonical_url(c("url")).alias("value")),
    "b3_match_source_links": b3,
    "b3_match_source_links_hosts": b3_hosts,
    "b4_cap_links": b4,
    "b5_source_job_id": lambda spark, d: pages(spark, d).select("page_id", web.source_job_id(c("url"), r"(\d+)").alias("value")),
    "b6_html_to_text": lambda spark, d: pages(spark, d).select("page_id", web.html_to_text(c("html")).alias("value")),
    "b7_jsonld_job_posting": lambda spark, d: _postings(spark, d).select("page_id", F.expr("try_variant_get(posting, '$.title', 'string')").alias("title")),
    "b8_jsonld_salary_text": lambda spark, d: _postings(spark, d).select("page_id", web.posting_salary().alias("value")),
    "b9_jsonld_location_text": lambda spark, d: _postings(spark, d).select("page_id", web.posting_locations().alias("value")),
    "b10_section_between_headings": lambda spark, d: pages(spark, d).select("page_id", web.section_between(c("html"), "<h1>", ["</h1>", "<p>"]).alias("value")),
    "b11_split_tags": lambda spark, d: feed.table(spark, d, "part").select("p_partkey", F.array_join(web.split_tags(F.concat_ws(",", "p_type", "p_name", "p_type")), "|").alias("value")),
    "b12_propose_career_urls": lambda spark, d: web.propose_career_urls(pages(spark, d).select(F.regexp_extract("url", "^([^/]+//[^/]+/?)", 1).alias("domain"))),
}

_ABS = r"""CASE WHEN regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN h WHEN h LIKE '//%' THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*:)', 1) || h WHEN h LIKE '/%' THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || h
 WHEN h LIKE '#%' THEN regexp_replace(url, '[?#].*$', '') || h ELSE regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', '') || h END"""
_LINKS = rf"""l0 AS (SELECT page_id, url, trim(unnest(x)) AS h, generate_subscripts(x, 1) - 1 AS pos FROM (SELECT page_id, url, regexp_extract_all(html, '<a [^>]*?href="([^"]+)"', 1) AS x FROM pages)), links AS (SELECT page_id, CAST(pos AS INTEGER) AS pos, {_ABS} AS link FROM l0 WHERE h <> '')"""
_TEXT = r"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"
for _mark, _char in web.ENTITIES:
    _TEXT = f"replace({_TEXT}, '{_mark}', '{_char.replace(chr(39), chr(39) * 2)}')"

ORACLES = {
    "b1_extract_links": f"WITH {_LINKS} SELECT * FROM links",
    "b1_extract_links_forms": f"WITH {_LINKS} SELECT * FROM links WHERE page_id % 6 <> 5",
    "b6_html_to_text_forms": "SELECT page_id, '1 < 2 &&#39; ' || trim(replace(url, '&amp;', '&')) || ' é😀é\ufffd end' AS value FROM pages",
    "b7_b8_b9_jsonld_shapes": "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'One ' ELSE 'Two ' END || page_id AS title, CASE page_id % 3 WHEN 0 THEN '15 EUR HOUR' ELSE '10 YEAR' END AS salary, CASE page_id % 3 WHEN 0 THEN 'Region - Town ' || page_id ELSE 'Hanoi City ' || page_id || ', Hue' END AS locations FROM pages WHERE page_id % 3 < 2",
    "b2_canonical_url": "SELECT page_id, regexp_replace(url, '[?#].*$', '') AS value FROM pages",
    "b3_match_source_links_hosts": r"""WITH p AS (SELECT regexp_replace(url, '[?#].*$', '') AS link, lower(regexp_extract(url, '^[^:]+://([^/?#:]*)', 1)) AS h, regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1) AS p FROM pages),
s AS (SELECT h AS host FROM p WHERE h <> '' GROUP BY h HAVING count(*) > 1) SELECT DISTINCT 'S:' || host AS source_code, link FROM p JOIN s ON h = host WHERE p LIKE '/en/%'""",
    "b3_match_source_links": rf"""WITH {_LINKS}, u AS (SELECT DISTINCT regexp_replace(link, '[?#].*$', '') AS link FROM (SELECT link FROM links UNION ALL SELECT url FROM pages)), p AS (SELECT link, lower(regexp_extract(link, '^[^:]+://([^/?#:]*)', 1)) AS h, regexp_extract(link, '^[^:]+://[^/?#]*([^?#]*)', 1) AS p FROM u)
SELECT DISTINCT source_code, link FROM p JOIN {taxonomy.values(taxonomy.SOURCES, "s(source_code, host, path_regex, id_regex)")} ON (h = host OR h LIKE '%.' || host) AND regexp_matches(p, path_regex)""",
    "b4_cap_links": f"WITH {_LINKS} SELECT source, page_id, pos, link FROM (SELECT page_id % 7 AS source, *, row_number() OVER (PARTITION BY page_id % 7 ORDER BY page_id, pos) AS r FROM links) WHERE r <= 40",
    "b5_source_job_id": r"WITH s AS (SELECT page_id, regexp_extract(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', ''), '([^/]*)$', 1) AS x FROM pages) SELECT page_id, coalesce(nullif(regexp_extract(x, '(\d+)', 1), ''), nullif(x, '')) AS value FROM s",
    "b6_html_to_text": rf"SELECT page_id, nullif(trim(regexp_replace({_TEXT}, '[\s\x00-\x1f\x7f\x{{a0}}]+', ' ', 'g')), '') AS value FROM pages",
    "b7_jsonld_job_posting": "SELECT page_id, 'T' || page_id AS title FROM pages",
    "b8_jsonld_salary_text": "SELECT page_id, '10 - ' || (page_id + 20) || ' USD MONTH' AS value FROM pages",
    "b9_jsonld_location_text": "SELECT page_id, 'R - L' || page_id || ', Solo' AS value FROM pages",
    "b10_section_between_headings": r"WITH s AS (SELECT page_id, CASE WHEN strpos(lower(html), '<h1>') > 0 THEN substring(html, strpos(lower(html), '<h1>') + 4) END AS r FROM pages) SELECT page_id, nullif(trim(regexp_replace(CASE WHEN least(nullif(strpos(lower(r), '</h1>'), 0), nullif(strpos(lower(r), '<p>'), 0)) IS NULL THEN r ELSE substring(r, 1, least(nullif(strpos(lower(r), '</h1>'), 0), nullif(strpos(lower(r), '<p>'), 0)) - 1) END, '[\s\x00-\x1f\x7f\x{a0}]+', ' ', 'g')), '') AS value FROM s",
    "b11_split_tags": f"SELECT p_partkey, CASE WHEN {base.fold('p_type')} = {base.fold('p_name')} THEN p_type ELSE p_type || '|' || p_name END AS value FROM part",
    "b12_propose_career_urls": r"SELECT DISTINCT d AS domain, 'https://' || d || p AS url FROM (SELECT DISTINCT lower(regexp_replace(regexp_replace(regexp_extract(url, '^([^/]+//[^/]+/?)', 1), '^[A-Za-z]+://', ''), '/+$', '')) AS d FROM pages), (VALUES ('/careers'), ('/jobs'), ('/tuyen-dung'), ('/recruitment')) AS t(p) WHERE d <> ''",
}
