"""Links and visible text as a browser reads them."""

from vacantia.operators import web

FORMS = """<a href="/1">x</a><A HREF=/2>y</A><a class='c' href='/3'>z</a><a
 title="href='/no' >" href = "/4">
<!-- <a href="/no"> --><script>var x = '<a href="/no">';</script><STYLE>a:before{content:'<a href="/no">'}</STYLE ><b title='<a href="/no">'><abbr href="/no">
<a name="top"><a href=""><a href="  "><a href="/5?a=1&amp;b=2&#38;c=&#x263A;"/><a data-href="/no" HREF='#f'><a href>"""


def pages(spark, *html):
    return spark.createDataFrame([(i, "https://x.example/a/b?q", h) for i, h in enumerate(html)], "page_id long, url string, html string")


def test_links_in_every_form(spark):
    got = [(r.pos, r.link) for r in web.extract_links(pages(spark, FORMS)).orderBy("pos").collect()]
    assert [x for _, x in got] == [f"https://x.example/{i}" for i in (1, 2, 3, 4)] + ["https://x.example/5?a=1&b=2&c=☺", "https://x.example/a/b#f"]
    assert [p for p, _ in got] == [0, 1, 2, 3, 5, 6]  # the blank one has a place


def test_links_of_odd_pages(spark):
    odd = pages(spark, None, "", "no tag < a href=x", "<a href='/open", "<!-- open <a href='/no'>", "<script>open <a href='/no'>", "<a " + "x='y' " * 5000 + "href=/far>", "<a href='/q'" + "\"" + "><a href=/r>")
    got = {(r.page_id, r.link) for r in web.extract_links(odd).collect()}
    assert (6, "https://x.example/far") in got and not {p for p, _ in got} & {0, 1, 2, 3, 4, 5}


def test_visible_text(spark):
    rows = pages(spark, "<p title='a > b'>1 < 2 &amp;lt; &#233;&#xE9;&#128512;&nbsp;x</p><!-- <p>no</p> --><SCRIPT>if (a<b) '</p>'</SCRIPT ><style>no</style>end<br", None, "<p></p>", "&#0;&#1114112;&#99999999999999999999;&#x;", "a <3 b <- c", "<!-- open")
    got = {r.page_id: r.v for r in rows.select("page_id", web.html_to_text(rows.html).alias("v")).collect()}
    assert got == {0: "1 < 2 &lt; éé😀 x end", 1: None, 2: None, 3: "�" * 3 + "&#x;", 4: "a <3 b <- c", 5: None}
