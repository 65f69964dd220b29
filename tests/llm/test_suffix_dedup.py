"""Repeated passages against all windows, and the interval expansion against plain comparison."""

import hashlib

import numpy as np
import pytest

from vacantia.llm import bwt, suffix_dedup
from vacantia.llm.queries import op12_suffix_dedup, oracle_sql

from conftest import SF

SCHEMA = "doc_id long, text string, p long, b int, key string"


def brute(rows, length=50):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1 if d is not None else 0):
            first[b[i : i + length]] = min(d, first.get(b[i : i + length], d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1 if d is not None else 0):
            if first[b[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        out.append((-1 if d is None else d, len(b), sum(gone), sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def rows(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def test_query_against_every_window(spark):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    docs = con.sql("SELECT doc_id, text FROM documents").fetchall()
    sql = con.sql(f"SELECT doc_id, n_bytes, n_removed, n_spans, kept_sha256 FROM ({oracle_sql()['op12_suffix_dedup']})")
    assert rows(op12_suffix_dedup(spark, SF)) == brute(docs) == sorted(sql.fetchall())


@pytest.mark.parametrize("kw", [{}, {"slice_bytes": 400, "keys": 60, "hot": 1, "sorted_at_once": 300}])
def test_odd_rows(spark, kw):
    random = np.random.default_rng(5)
    word = lambda n: "".join(random.choice(list("abcé☃ "), n))
    passage, line = word(120), "=" * 200
    texts = [(9, passage), (3, word(70) + passage + word(30)), (4, passage[:49]), (5, passage[:50]), (6, word(20) + passage[10:61] + word(9)), (7, line), (8, line * 3 + "x" + line), (1, None), (2, ""), (None, passage), (None, None)]
    texts += [(20, "aé" * 200), (21, "éa" * 200), (22, passage + passage), (22, passage + "!"), (22, passage + passage), (30, passage[:60] + passage[60:110]), (31, passage[:50] + word(5) + passage[60:110])]
    texts += [(100 + k, word(40) + passage[k : k + 55] + word(40)) for k in range(60)]  # one passage in many contexts
    docs = spark.createDataFrame([(*r, 1, 2, "k") for r in texts], SCHEMA)
    assert rows(suffix_dedup.repeated_passages(docs, **kw)) == brute(texts)
    kept = suffix_dedup.repeated_passages(docs, texts=True, **kw).collect()
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed for r in kept)


@pytest.mark.parametrize("length", [1, 2, 5, 33])
def test_other_lengths(spark, length):
    random = np.random.default_rng(length)
    texts = [(int(i), "".join(random.choice(list("ab"), int(random.integers(0, 60))))) for i in range(40)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert rows(suffix_dedup.repeated_passages(docs, length=length, slice_bytes=300)) == brute(texts, length)


def test_empty_table(spark):
    assert suffix_dedup.repeated_passages(spark.createDataFrame([], SCHEMA)).collect() == []


def test_interval_expansion():
    random = np.random.default_rng(0)
    for trial in range(150):
        n, depth = int(random.integers(0, 160)), int(random.integers(1, 12))
        text = random.integers(97, 97 + int(random.integers(1, 5)), n).astype(np.uint8)
        if n > 50 and trial % 2:
            text[30:50] = text[5:25]
        order, first = bwt.shared_prefixes(text, depth)
        assert sorted(order.tolist()) == list(range(n + 1)) and first[0]
        raw = text.tobytes()
        for j in range(1, n + 1):
            a, b = order[j - 1], order[j]
            assert (not first[j]) == (max(a, b) + depth <= n and raw[a : a + depth] == raw[b : b + depth])


def test_window_keys_depend_on_the_window_only():
    random = np.random.default_rng(2)
    data = random.integers(97, 100, 3 * suffix_dedup.BLOCK).astype(np.uint8)
    keys = suffix_dedup.window_keys(data, 50)
    for i in random.integers(0, len(keys), 50).tolist() + [0, suffix_dedup.BLOCK - 1, suffix_dedup.BLOCK, len(keys) - 1]:
        assert suffix_dedup.window_keys(data[i : i + 50], 50)[0] == keys[i]
