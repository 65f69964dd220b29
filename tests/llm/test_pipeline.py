"""The pipeline's stages against plain versions of them, each on the rows that the stage before kept."""

import re
from collections import Counter, defaultdict

import corpus_pipeline
import __spark_entry__ as entry

from conftest import SF
from vacantia.llm import mixing, quality_classifier, quality_rules
from vacantia.llm.queries import _piece_model


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def unlike(rows):
    """The smallest id of each component of texts whose five-word shingles overlap by 0.8 or more, by all pairs that share one."""
    sets = {i: frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w := words(t)) >= 5 else frozenset({tuple(w)} - {()}) for i, t in rows}
    holders, root = defaultdict(list), {i: i for i in sets}

    def top(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, s in sets.items():
        for g in s or {None}:
            holders[g].append(i)
    for i, s in sets.items():
        for j, n in Counter(j for g in s or {None} for j in holders[g] if j < i).items():
            if not s or n / (len(s) + len(sets[j]) - n) >= 0.8:
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return {top(i) for i in sets}


def test_pipeline(spark):
    import duckdb
    import sentencepiece

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    stages, ids = dict(corpus_pipeline.STAGES), lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    assert list(stages) == ["quality_rules", "quality_classifier", "near_duplicates", "mixture", "piece_ids"]

    rules = stages["quality_rules"](spark, docs, SF).cache()
    assert rules.columns == docs.columns and ids(rules) == sorted(r[0] for r in con.sql(f"SELECT doc_id FROM ({quality_rules.ORACLE}) WHERE kept").fetchall())
    good = stages["quality_classifier"](spark, rules, SF).cache()
    assert good.columns == docs.columns and ids(good) == ids(quality_classifier.classify(rules, labels).filter("predicted = 1"))
    known = {r.doc_id: r.quality for r in labels.collect()}
    assert all(known.get(i, 1) == 1 for i in ids(good))
    single = stages["near_duplicates"](spark, good, SF).cache()
    assert single.columns == docs.columns and ids(single) == sorted(unlike([(r.doc_id, r.text) for r in good.collect()])) and len(ids(single)) < len(ids(good))
    mixed = stages["mixture"](spark, single, SF).cache()
    plan = mixing.mix_table(single, share=0.95, epochs=1).toPandas()
    assert mixed.columns == docs.columns and ids(mixed) == sorted(plan[plan.copies > 0].doc_id)
    for _, leaf in plan.groupby(["domain", "lang", "source"]):
        assert (leaf.n_tokens * leaf.copies).sum() <= leaf.budget.iloc[0]
    sp, whole = sentencepiece.SentencePieceProcessor(model_file=_piece_model()), {r.doc_id: r.text for r in mixed.collect()}
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == ids(mixed)
    assert all(list(r.ids) == sp.encode(whole[r.doc_id]) and r.n_tokens == len(r.ids) and r.parity and r.decodes for r in got)


def test_stages_take_odd_rows(spark):
    rows = [(None, None, None, None, 0), (1, "", "en", "src0", 0), (1, "", "en", "src0", 0), (2, "x" * 50_000, "en", None, 0), (3, "one two three four five six " * 2000, None, "src1", 0)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{SF}/documents.parquet").schema)
    for name, stage in corpus_pipeline.STAGES:
        for some in (docs, docs.limit(0)):
            out = stage(spark, some, SF)
            assert out.count() <= some.count() and (name == "piece_ids" or out.columns == docs.columns), name


def test_registered():
    names = list(entry.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names


def test_blocks_of_near_copies_give_a_forest_of_exact_links():
    """A group of variants around 0.8: what the pairs of two blocks connect, in fewer rows than members."""
    import numpy as np
    import pyarrow as pa

    from vacantia.llm import near_copies as nc

    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 60, 120)
    sets = [np.unique(np.concatenate([rng.choice(base, 120 - k % 17, replace=False), rng.integers(0, 1 << 60, k % 17)])) for k in range(160)]
    # signatures as the operator makes them
    a, b = (np.random.default_rng(44).integers(1, 1 << 63, nc.SIGNED, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
    signed = [np.array([nc._mixed(np.array([(s.view(np.uint64) * x + y).min()]))[0] & np.uint64(255) for x, y in zip(a, b, strict=True)], dtype=np.uint8).tobytes() for s in sets]
    jaccard = lambda s, t: len(np.intersect1d(s, t)) / len(np.union1d(s, t))
    n = len(sets)
    left = np.arange(n) % 2 == 0
    for right in (~left, left):
        table = pa.table({"node": pa.array(np.arange(n)), "root": pa.array(np.where(np.arange(n) < 6, 0, np.arange(n))), "signed": pa.array(signed, pa.binary()), "shingles": pa.array([s.tolist() for s in sets], pa.list_(pa.int64())), "left": pa.array(left), "right": pa.array(right)})
        got = nc._in_blocks(0.8)(table).to_pylist()
        assert all(jaccard(sets[r["x"]], sets[r["y"]]) >= 0.8 and left[r["x"]] and right[r["y"]] for r in got) and len(got) < n

        def components(pairs):
            up = {k: 0 if k < 6 else k for k in range(n)}
            for x, y in pairs:
                u, v = up[x], up[y]
                for k, w in up.items():
                    up[k] = min(u, v) if w in (u, v) else w
            return up

        pairs = [(x, y) for x in range(n) if left[x] for y in range(n) if right[y] and y < x and jaccard(sets[x], sets[y]) >= 0.8]
        assert components([(r["x"], r["y"]) for r in got]) == components(pairs) and len(pairs) > 2 * len(got)
