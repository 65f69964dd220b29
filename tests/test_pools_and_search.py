"""Skill pools against all pairs; search by blocks and by cells against the exact one."""

import itertools
import math
import random

from pyspark.sql import functions as F

from vacantia.operators import pools, quantiser, vectors


def test_pools_against_all_pairs(spark):
    rng = random.Random(3)
    names = [f"s{i}" for i in range(14)] + ["hot"]
    have = [(i, rng.sample(names[:-1], rng.randint(0, 6)) + ["hot"] * (i % 3 > 0), "x") for i in range(60)] + [(60, None, "x"), (61, ["s1", None, "s1"], "x"), (62, ["s1"], "x")]
    need = [(i, rng.sample(names, rng.randint(0, 5)), 1) for i in range(50)] + [(50, None, 1), (51, ["nobody"], 1), (52, ["nobody", "hot", None, "hot"], 1), (53, ["hot"], 1)]
    a = spark.createDataFrame(have, "candidate_id long, have array<string>, need string")
    b = spark.createDataFrame(need, "job_id long, need array<string>, part int")
    for least, most in ((0.5, 20_000), (0.5, 4), (1.0, 4), (0.34, 7)):
        want = {}
        for (c, h, _), (j, n, _) in itertools.product(have, need):
            h, n = {x for x in h or [] if x}, {x for x in n or [] if x}
            if n and len(h & n) >= math.ceil(least * len(n) - 1e-9) and h & n:
                want[c, j] = (len(h & n), len(n))
        got = pools.skill_pools(a, b, least, most).collect()
        assert len(got) == len(want) and {(r.candidate_id, r.job_id): (r.matched, r.needed) for r in got} == want
        assert all(r.skill_score == r.matched / r.needed for r in got)
    assert pools.skill_pools(a.limit(0), b).isEmpty() and pools.skill_pools(a, b.limit(0)).isEmpty()


def test_pools_deal_pairs_and_the_index_once(spark):
    """Equal sets in groups of a few rows give the same pairs, and no pair is shuffled behind the join of the index."""
    a = spark.createDataFrame([(i, ["a", "b"] if i % 3 else ["c", f"x{i}"]) for i in range(30)], "candidate_id long, have array<string>")
    b = spark.createDataFrame([(i, ["a", "c"] if i % 2 else ["b", f"x{i}", "c"]) for i in range(20)], "job_id long, need array<string>")
    out = pools.skill_pools(a, b, 0.5, most=4, members=3)
    have, need = {r[0]: set(r[1]) for r in a.collect()}, {r[0]: set(r[1]) for r in b.collect()}
    want = {(c, j): len(h & n) for c, h in have.items() for j, n in need.items() if len(h & n) >= math.ceil(len(n) / 2)}
    got = out.collect()
    assert len(got) == len(want) and {(r.candidate_id, r.job_id): r.matched for r in got} == want
    top = out._jdf.queryExecution().optimizedPlan().toString().split("Join ")[1].splitlines()[0]
    assert "part" in top  # the join of the index is the last one: pairs aren't joined again


def vectors_of(spark, n, around, name, seed=0):
    rng = random.Random(seed)
    middle = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(around)]
    rows = [(i, [m + 0.15 * rng.gauss(0, 1) for m in middle[i % around]]) for i in range(n)]
    return spark.createDataFrame(rows, f"{name} long, embedding array<float>")


def test_blocks_of_both_sides_give_the_exact_neighbours(spark):
    q, p = vectors_of(spark, 70, 9, "query_id"), vectors_of(spark, 300, 9, "point_id")
    p = p.unionByName(spark.createDataFrame([(900, None), (901, [0.0] * 8), (902, [float("nan")] + [1.0] * 7)], p.schema))
    p = p.unionByName(p.filter("point_id < 5").withColumn("point_id", F.col("point_id") + 2000))  # ties
    want = sorted(map(tuple, vectors.top_k_cosine(q, p, 7).collect()))
    assert sorted(map(tuple, vectors.top_k_cosine(q, p, 7, few=0, block=40).collect())) == want and len(want) == 490
    assert vectors.top_k_cosine(q, p.limit(0), 7, few=0, block=40).isEmpty()


def test_cells_find_the_neighbours_and_look_at_few_points(spark):
    q, p = vectors_of(spark, 40, 16, "query_id"), vectors_of(spark, 900, 16, "point_id")
    index = quantiser.Cells(p, cells=24, block=50)
    exact, near = vectors.top_k_cosine(q, p, 10), index.top_k(q, 10, probes=4)
    hits = exact.join(near, ["query_id", "point_id"], "left_semi").count()
    looked = index.looked_at(q, probes=4).agg(F.avg("share"), F.count("*")).first()
    assert hits >= 0.9 * 400 and looked[0] < 0.25 and looked[1] == 40
    both = exact.join(near.select("query_id", "point_id", F.col("score").alias("s")), ["query_id", "point_id"])
    assert both.filter("score <> s").isEmpty() and near.groupBy("query_id").count().filter("count > 10").isEmpty()
    assert index.lists.count() == 900 and index.lists.select("point_id").distinct().count() == 900
    every = index.top_k(q, 10, probes=24)  # all lists: exact
    assert sorted(map(tuple, every.collect())) == sorted(map(tuple, exact.collect()))
    empty = quantiser.Cells(p.limit(0))
    assert empty.top_k(q, 3).isEmpty()


def test_equal_vectors_are_searched_once(spark, monkeypatch):
    """Many rows of few vectors give the neighbours of all pairs, and what is searched is the vectors."""
    v = [[1.0, float(i % 7), float(i % 5)] for i in range(35)]
    q = spark.createDataFrame([(i, v[i % 35]) for i in range(210)], "query_id long, embedding array<float>")
    p = spark.createDataFrame([(1000 - i, v[(3 * i) % 35]) for i in range(400)], "point_id long, embedding array<float>")
    unit = {tuple(x): [c / math.sqrt(sum(d * d for d in x)) for c in x] for x in v}
    at = {r.point_id: unit[tuple(r.embedding)] for r in p.collect()}
    want = set()
    for r in q.collect():
        own = unit[tuple(r.embedding)]
        ordered = sorted((-round(sum(a * b for a, b in zip(own, x, strict=True)), 6), i) for i, x in at.items())[:30]
        want |= {(r.query_id, i, n + 1) for n, (_, i) in enumerate(ordered)}
    sizes, one, two = [], vectors._nearest, vectors._by_blocks
    monkeypatch.setattr(vectors, "_nearest", lambda a, b, k: sizes.append((a.count(), b.count())) or one(a, b, k))
    monkeypatch.setattr(vectors, "_by_blocks", lambda a, b, *k: sizes.append((a.count(), b.count())) or two(a, b, *k))
    for few in (50, 0):
        got = {(r.query_id, r.point_id, r["rank"]) for r in vectors.top_k_cosine(q, p, 30, few=few, block=10).collect()}
        assert got == want
    assert sizes == [(35, 35), (35, 35)]


def test_every_candidate_is_matched(spark):
    """The matches are of all candidates; those of one profile share a pool, which rows of a few members carry."""
    from conftest import SF
    from vacantia.plans import match_queries

    ids = {r[0] for r in spark.read.parquet(f"{SF}/customer.parquet").select("c_custkey").collect()}
    assert {r[0] for r in match_queries.QUERIES["h9_match_results"](spark, SF).select("candidate_id").distinct().collect()} == ids


def test_pools_of_equal_profiles_are_scored_once(spark):
    from vacantia.operators import match

    day = F.lit("2001-12-01").cast("date")
    who = spark.createDataFrame([(i, [1.0, float(i % 2)], ["a", "b"], None if i % 4 > 1 else "SENIOR", []) for i in range(40)], "candidate_id long, embedding array<float>, have array<string>, level string, wanted array<string>")
    jobs = spark.createDataFrame([(i, [1.0, i / 9], ["a", f"x{i}"] if i % 2 else None, "MID", ["Y"], None) for i in range(9)], "job_id long, embedding array<float>, need array<string>, job_level string, places array<string>, place_text string").withColumn("posted_at", day)
    for members in (4096, 3):
        pools = match.pooled(who, jobs, day, match.Ranking(pool=5, limit=3), members)
        assert pools.count() == 4 if members > 3 else pools.count() > 4
        got = match.matches(match.rank_matches(pools, match.Ranking(pool=5, limit=3))).collect()
        assert sorted((r.candidate_id, r["rank"]) for r in got) == [(i, n) for i in range(40) for n in (1, 2, 3)]
        for r in got:
            near = sorted(((-round((1 + (r.candidate_id % 2) * j / 9) / math.sqrt(1 + r.candidate_id % 2) / math.sqrt(1 + (j / 9) ** 2), 6), j) for j in range(9)))[:5]
            full = sorted((-round(-s * 0.5 + 0.5 * 0.3 + (0.5 if r.candidate_id % 4 > 1 else 0.7) * 0.1 + 0.5 * 0.05 + 0.05, 8), s, j) for s, j in near)
            assert full[r["rank"] - 1][2] == r.job_id
