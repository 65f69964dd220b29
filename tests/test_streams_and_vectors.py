"""Replays and restarts of the streaming operators, odd vectors, and search by buckets."""

import datetime

import numpy as np
from pyspark.sql import functions as F

from vacantia.operators import vectors
from vacantia.streaming import streams

from conftest import SF


def batch(spark, *rows):
    at = lambda m: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
    return spark.createDataFrame([(f, at(m), d, i) for i, (f, m, d) in enumerate(rows)], "fingerprint string, ts timestamp, digest string, event_id long")


def test_changed_feed_emits_the_same_on_replay_and_goes_on_after_a_restart(spark, tmp_path):
    out = {}
    run = lambda: streams.changed_feed(streams.digests(f"file://{tmp_path}/d"), lambda df, e: out.__setitem__(e, sorted((r.fingerprint, r.action) for r in df.collect())))
    first, second = batch(spark, ("a", 0, "x"), ("b", 1, "y")), batch(spark, ("a", 2, "x"), ("b", 3, "z"), ("c", 4, "w"))
    for function in (run(), run()):
        for _ in range(2):
            function(first, 0)
            assert out[0] == [("a", "CREATED"), ("b", "CREATED")]
    for _ in range(2):
        run()(second, 1)
        assert out[1] == [("b", "UPDATED"), ("c", "CREATED")]
    run()(batch(spark, ("b", 1, "old")), 2)
    assert out[2] == []  # older than what is stored
    run()(batch(spark), 3)
    assert out[3] == []


def test_deltas_are_merged_over_snapshots(spark, tmp_path):
    table = streams.digests(f"file://{tmp_path}/s")
    table.snapshots = 3
    for e in range(8):
        for _ in range(2):
            table.put(batch(spark, (f"k{e % 2}", e, f"d{e}")).select("fingerprint", "digest", "ts"), e)
    assert sorted((r.fingerprint, r.digest) for r in table.table(spark).collect()) == [("k0", "d6"), ("k1", "d7")]
    assert sorted((r.fingerprint, r.digest) for r in table.table(spark, 4).collect()) == [("k0", "d2"), ("k1", "d3")]


def test_seen_table_in_batches_is_that_of_all_rows(spark, tmp_path):
    parts = [batch(spark, ("a", 5, "x"), ("a", 1, "w")), batch(spark, ("a", 3, "v"), ("b", 2, "u")), batch(spark, ("a", 9, "t"))]
    table, run = streams.seen_table(f"file://{tmp_path}/t", parts[0], ("digest",), ("ts", "event_id"))
    for e, p in enumerate([*parts, parts[2]]):
        run(p, min(e, 2))
    got = {r.fingerprint: (r.digest, r.first_seen_at.minute, r.last_seen_at.minute, r.sightings) for r in streams.seen(table, spark).collect()}
    assert got == {"a": ("t", 1, 9, 4), "b": ("u", 2, 2, 1)}


def test_intake_over_batches_adds_up(spark, tmp_path):
    rows = [("a", 0, "x"), ("a", 1, "x"), ("b", 2, "y"), ("a", 3, "z"), ("b", 4, "y"), ("c", 5, "q")]
    whole = streams.intake_kinds(batch(spark, *rows).withColumn("by", F.lit("k")), "by", ("ts", "event_id")).collect()[0]
    got = []
    run = streams.intake(streams.digests(f"file://{tmp_path}/i"), lambda df, e: got.append(df.collect()), "by", ("ts", "event_id"))
    for e in range(3):
        run(batch(spark, *rows[2 * e : 2 * e + 2]).withColumn("by", F.lit("k")), e)
    sums = [sum(r[c] for g in got for r in g) for c in ("new", "changed", "reseen")]
    assert sums == [whole.new, whole.changed, whole.reseen] == [3, 1, 2]


def test_search_leaves_unusable_vectors_out(spark):
    rows = [(0, [1.0, 0.0], "v1"), (1, None, "v1"), (2, [float("nan"), 1.0], "v1"), (3, [0.0, 0.0], "v1"), (4, [0.9, 0.1], "v2"), (5, [0.5, 0.5], "v1"), (6, [1.0, 0.0, 0.0], "v1"), (7, [None, 1.0], "v1")]
    p = spark.createDataFrame(rows, "point_id long, embedding array<double>, version string")
    q = p.withColumnRenamed("point_id", "query_id")
    got = vectors.top_k_cosine(q, p, 5, dim=2, versions={"version": "v1"}).collect()
    assert sorted((r.query_id, r.point_id, r["rank"]) for r in got) == [(0, 0, 1), (0, 5, 2), (5, 0, 2), (5, 5, 1)]
    assert vectors.top_k_cosine(q.limit(0), p, 5, dim=2).count() == 0


def test_ties_and_blocks_of_the_exact_search(spark, monkeypatch):
    monkeypatch.setattr(vectors, "QUERIES", 3)
    monkeypatch.setattr(vectors, "POINTS", 7)
    monkeypatch.setattr(vectors, "BROADCAST_ROWS", 10)
    x = np.random.default_rng(0).integers(-2, 3, (60, 3)).astype(float) + 0.01
    p = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "point_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): r.point_id for r in vectors.top_k_cosine(p.withColumnRenamed("point_id", "query_id").filter("query_id < 25"), p, 4).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(25):
        want = sorted(range(60), key=lambda j: (-round(float(u[i] @ u[j]), 6), j))[:4]
        assert [got[i, k + 1] for k in range(4)] == want


def test_buckets_prune_where_vectors_cluster(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 64))
    x = np.repeat(centres, 25, axis=0) + 0.25 * rng.normal(size=(1000, 64))
    p = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "point_id long, embedding array<double>")
    q = p.withColumnRenamed("point_id", "query_id").filter("query_id % 50 = 0")
    exact = {(r.query_id, r.point_id) for r in vectors.top_k_cosine(q, p, 10).collect()}
    near = {(r.query_id, r.point_id) for r in vectors.top_k_lsh(q, p, 10, bits=10, tables=12, block=20).collect()}
    share = vectors.compared_share(q, p, bits=10, tables=12).agg(F.avg("share")).first()[0]
    assert len(exact & near) >= 0.9 * len(exact) and share < 0.25


def test_a_late_row_does_not_overwrite_a_newer_sighting(spark, tmp_path):
    """Day 1 says d1, day 10 says d1 again, then day 5 comes late and says d2: day 10 knows better."""
    state, told = streams.digests(f"{tmp_path}/state"), {}
    run = streams.changed_feed(state, lambda df, epoch: told.__setitem__(epoch, sorted((r.fingerprint, r.action) for r in df.collect())))
    batches = [[("A", 1, "d1")], [("A", 10, "d1"), ("B", 3, "x")], [("A", 5, "d2"), ("B", 4, "y")], [("A", 11, "d2")]]
    for epoch, rows in enumerate(batches):
        run(spark.createDataFrame([(f, datetime.datetime(2024, 1, day), d) for f, day, d in rows], "fingerprint string, ts timestamp, digest string"), epoch)
    assert told == {0: [("A", "CREATED")], 1: [("B", "CREATED")], 2: [("B", "UPDATED")], 3: [("A", "UPDATED")]}
    run(spark.createDataFrame([("A", datetime.datetime(2024, 1, 5), "d2"), ("B", datetime.datetime(2024, 1, 4), "y")], "fingerprint string, ts timestamp, digest string"), 2)
    assert told[2] == [("B", "UPDATED")]


def test_stream_queries_equal_their_batch_forms(spark):
    """All four actions occur over several batches, and gaps are those that a batch query finds."""
    from collections import Counter

    import __spark_entry__ as entry

    actions = Counter(r.action for r in entry.queries()["j2_stream_versions"](spark, SF).collect())
    assert sum(actions.values()) == spark.read.parquet(f"{SF}/events.parquet").count() and set(actions) == {"CREATED", "UPDATED", "UNCHANGED", "LATE"}
    gaps = Counter(r.stage for r in entry.queries()["e10_stream_reconciliation"](spark, SF).collect())
    assert set(gaps) == {"raw_without_normalized", "normalized_without_vector"}


def test_old_deltas_go_once_two_snapshots_hold_them(spark, tmp_path):
    import os

    table = streams.Deltas(f"file://{tmp_path}/d", "k long, n long", lambda rows: rows.groupBy("k").agg(F.sum("n").alias("n")), snapshots=3)
    for epoch in range(8):
        table.put(spark.createDataFrame([(epoch % 2, 1), (7, 1)], "k long, n long"), epoch)
    got = lambda before=None: sorted(map(tuple, table.table(spark, before).collect()))
    assert got() == [(0, 4), (1, 4), (7, 8)]
    assert sorted(os.listdir(tmp_path / "d/delta")) == [f"epoch={e}" for e in (3, 4, 5, 6, 7)] and sorted(os.listdir(tmp_path / "d/snapshot")) == ["epoch=2", "epoch=5"]
    assert got(5) == [(0, 3), (1, 2), (7, 5)]  # an epoch that is run again
    table.put(spark.createDataFrame([(1, 1), (7, 1)], "k long, n long"), 5)
    assert got() == [(0, 4), (1, 4), (7, 8)]


def test_texts_are_embedded_once_by_a_provider_loaded_once_a_task(spark, tmp_path):
    """Hot, empty and null texts; a loaded provider; rows keep their columns."""
    texts = ["same"] * 40 + ["", None] * 10 + [f"t{i}" for i in range(30)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").repartition(3)
    log = f"{tmp_path}/calls"

    def load():
        with open(log, "a") as f:
            f.write("load\n")

        def make(batch):
            with open(log, "a") as f:
                f.writelines(f"{len(x)}\n" for x in batch)
            return [[float(len(x)), 1.0] for x in batch]

        return make

    for hot in (5, 100_000):
        got = vectors.embed_batch(rows, "t", load=load, hot=hot).collect()
        assert len(got) == len(texts) and all(r.embedding == [float(len(r.t or "")), 1.0] for r in got)
    lines = open(log).read().split()
    assert sum(x != "load" for x in lines) == 2 * 32  # null is the empty text: 32 distinct ones in each run
