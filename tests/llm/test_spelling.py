"""Spelling variants against all pairs, compared letter by letter."""

import collections
import re
import zlib

from vacantia.llm import spelling
from vacantia.llm.queries import op11_spelling, oracle_sql

from conftest import SF

SCHEMA = "doc_id long, text string, word string, key string, n long"


def low(t):
    return "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in t)


def counted(docs, least=3, every=97):
    c = collections.Counter()
    for d, t in docs:
        for w in map(low, re.findall("[A-Za-zÀ-ÿ]+", t or "")):
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if every and h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            c[w] += 1
    return {w: n for w, n in c.items() if len(w) >= 5 and n >= least}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(v):
    near = {w: [x for x in v if one_apart(w, x)] for w in v}
    form = {}
    for w in v:
        best = min(near[w], key=lambda x: (-v[x], x), default=None)
        form[w] = best if best is not None and v[best] >= 2 * v[w] else None
    out = {}
    for w in v:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, v[w], len(near[w]), v[form[w]] if form[w] else None)
    return out


def rows(df):
    got = df.collect()
    assert len({r.word for r in got}) == len(got)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got}


WORDS = "house hause houses housee housé mouse mousse shouse ouses aaaaa aaaaaa aaaab baaaa abaaa ààààà Ààààà x×yz÷w xyz÷w four five5".split()


def test_odd_rows_and_all_pairs(spark):
    texts = [(i, " ".join(w for k, w in enumerate(WORDS) if (i + k) % (2 + k % 5)) + " " + WORDS[i % len(WORDS)].upper()) for i in range(60)]
    texts += [(None, "house mouse"), (1, "zebra " * 3 + "zebru " * 6 + "zobru " * 12), (7, None), (7, ""), (8, "  \n"), (9, "house-HOUSE.hOuSe"), (9, "house-HOUSE.hOuSe"), (10, "q" * 700 + " " + "q" * 701), (11, "q" * 700 + " " + "q" * 701), (12, "q" * 700 + " " + "q" * 701)]
    docs = spark.createDataFrame([(*r, "w", "k", 1) for r in texts], SCHEMA)
    for every, most in ((97, 4096), (3, 3), (0, 1)):
        want = brute(counted(texts, every=every))
        assert rows(spelling.variants(docs, every=every, most=most)) == want
    assert want["zebra"][:2] == ("zebru", "zobru")


def test_groups_are_split_and_batches_cut(spark, monkeypatch):
    """Groups of all sizes, over many batches, on the vocabulary of the smallest table."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    v = counted([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    words = spark.createDataFrame(list(v.items()), "word string, n long")
    monkeypatch.setattr(spelling, "ROWS", 100)  # batches of the driver's copy only; the next line covers those of tasks
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")
    try:
        for most in (4096, 8):
            got = {r.word: r.n_near for r in spelling.near_words(words, most=most).collect()}
            groups = spelling.grouped(words, 5, most)
            assert groups.filter("b - a > 1").groupBy("key").count().filter(f"count > {most}").isEmpty()
            assert got == {w: x[3] for w, x in brute_fast(v).items()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def brute_fast(v):
    """Near words by deleted letters, a way of its own."""
    near, cut = collections.defaultdict(set), collections.defaultdict(set)
    for w in v:
        for i in range(len(w)):
            x = w[:i] + w[i + 1 :]
            cut[x, i].add(w)
            if x in v:
                near[w].add(x)
                near[x].add(w)
    for g in cut.values():
        for w in g:
            near[w] |= g - {w}
    return {w: (None, None, v[w], len(near[w]), None) for w in v}


def test_empty_table_and_query(spark):
    import duckdb

    assert spelling.variants(spark.createDataFrame([], SCHEMA)).collect() == []
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    sql = con.sql(oracle_sql()["op11_spelling"])
    want = {(r := dict(zip(sql.columns, x, strict=True)))["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for x in sql.fetchall()}
    assert rows(op11_spelling(spark, SF)) == want
