"""Matching candidates with postings: component scores, a weighted total, ranks and reasons."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.functions.text import let
from vacantia.operators import vectors
from vacantia.sources import taxonomy
from vacantia.sources.shared import sized, written


@dataclass(frozen=True)
class Ranking:
    """Weights, sizes and versions of a ranking; checked when made."""

    vector: float = 0.50
    skill: float = 0.30
    seniority: float = 0.10
    location: float = 0.05
    freshness: float = 0.05
    pool: int = 100
    limit: int = 20
    fresh_days: int = 7
    stale_days: int = 30
    version: str = "hybrid-v1"
    embedding_version: str = "hash-v1"

    def __post_init__(self):
        weights = (self.vector, self.skill, self.seniority, self.location, self.freshness)
        if min(weights) < 0 or abs(sum(weights) - 1) > 1e-6:
            raise ValueError("weights must not be negative and must add up to 1")
        if self.limit < 1 or self.pool < self.limit:
            raise ValueError("the pool must hold at least as many as the limit")
        if not 0 <= self.fresh_days < self.stale_days:
            raise ValueError("stale days must lie beyond fresh days")


#: For vectors without meaning: skills weigh more.
PLAIN = Ranking(vector=0.10, skill=0.60, seniority=0.15, location=0.10, freshness=0.05, version="hybrid-v1-plain")


def eligible_jobs(jobs: DataFrame, embeddings: DataFrame, as_of: Column, ranking: Ranking = Ranking()) -> DataFrame:
    """Jobs whose deadline hasn't passed, that are fresh enough, and have a ready vector of the ranking's version."""
    ready = embeddings.filter((F.col("status") == "READY") & (F.col("embedding_version") == ranking.embedding_version))
    fine = (F.col("deadline_at").isNull() | (F.col("deadline_at") >= as_of)) & (F.coalesce("posted_at", "normalized_at") >= as_of - F.make_dt_interval(F.lit(ranking.stale_days)))
    return jobs.filter(fine).join(ready.select("job_id"), "job_id", "left_semi")


def vector_score(s: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), s))


def skill_score(have: Column, need: Column) -> Column:
    """Share of needed skills that are there; neutral where none is needed."""
    return F.when(F.size(F.coalesce(need, F.array())) == 0, 0.5).otherwise(F.size(F.array_intersect(F.coalesce(have, F.array().cast("array<string>")), need)) / F.size(need))


def level_place(level: Column) -> Column:
    """A level as a number, places apart as seniority is counted; null if it isn't known."""
    return F.coalesce(*(F.when(level == lv, F.lit(r // 10)) for lv, r, *_ in taxonomy.SENIORITY))


def _seniority(a: Column, b: Column) -> Column:
    return let(F.abs(a - b), lambda d: F.when(d.isNull(), 0.5).when(d == 0, 1.0).when(d == 1, 0.7).when(d == 2, 0.4).otherwise(0.1))


def seniority_score(a: Column, b: Column) -> Column:
    """By places between levels: 1, .7, .4, then .1; unknown is neutral."""
    return _seniority(level_place(a), level_place(b))


def remote(place_text: Column) -> Column:
    return F.coalesce(F.lower(place_text).rlike(r"\b(remote|wfh|work from home)\b"), F.lit(False))


def _location(wanted: Column, places: Column, remote: Column) -> Column:
    return F.when(F.size(F.coalesce(wanted, F.array())) == 0, 0.5).when(remote | F.coalesce(F.arrays_overlap(wanted, places), F.lit(False)), 1.0).otherwise(0.0)


def location_score(wanted: Column, places: Column, place_text: Column) -> Column:
    """Any common place, or a remote posting, is 1; none is 0; without a wish neutral."""
    return _location(wanted, places, remote(place_text))


def freshness_score(posted: Column, as_of: Column, ranking: Ranking = Ranking()) -> Column:
    """1 up to the fresh days, then down in a line to 0 at the stale days."""
    age = F.date_diff(as_of, posted)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.lit(float(ranking.stale_days)) - age) / float(ranking.stale_days - ranking.fresh_days))), 6)


def final_score(ranking: Ranking = Ranking(), of: Callable[[str], Column] = F.col) -> Column:
    """Of columns, or what `of` names so: vector_score, skill_score, seniority_score, location_score and freshness_score."""
    parts = (("vector_score", ranking.vector), ("skill_score", ranking.skill), ("seniority_score", ranking.seniority), ("location_score", ranking.location), ("freshness_score", ranking.freshness))
    total = F.lit(0.0)
    for c, w in parts:
        total = total + of(c) * w
    return F.round(total, 8)


SCORES = ("final_score", "vector_score", "freshness_score", "skill_score", "seniority_score", "location_score")
#: Candidates of one profile that are in a row together; more of them are several rows.
MEMBERS = 4096


def pooled(candidates: DataFrame, jobs: DataFrame, as_of: Column, ranking: Ranking = Ranking(), members: int = MEMBERS) -> DataFrame:
    """candidate_ids, have and `pool`: the nearest postings of candidates with equal profiles, structs of job_id, need and all scores.

    candidates: candidate_id, embedding, have, level, wanted; jobs: job_id, embedding, need, job_level, places, place_text,
    posted_at. Postings are looked up and laid together once for each distinct vector. Candidates who are alike in vector,
    skills, level and wish have the same pool: it is scored once, within its row, so no pair is shuffled.
    """
    profile = ("vector", "have", "level", "wanted")
    asked, found = vectors.search(candidates.select(F.col("candidate_id").alias("query_id"), "embedding", *profile[1:]), jobs.select(F.col("job_id").alias("point_id"), "embedding"), ranking.pool)
    known = jobs.select("job_id", freshness_score(F.col("posted_at"), as_of, ranking).alias("freshness_score"), level_place(F.col("job_level")).alias("place"), remote(F.col("place_text")).alias("remote"), "places", "need")
    near = found.select("vector", F.col("point_id").alias("job_id"), vector_score(F.col("score")).alias("vector_score")).join(known, "job_id")
    pools = near.groupBy("vector").agg(F.collect_list(F.struct("vector_score", *known.columns)).alias("pool"))
    asked = asked.withColumn("_h", F.xxhash64(*profile))
    often = written(asked.groupBy("_h").agg(F.count("*").alias("n")).filter(F.col("n") > members), "profiles")
    part = F.coalesce(F.pmod(F.xxhash64(F.lit(7), "query_id"), F.ceil(F.col("n") / members)), F.lit(0)).alias("g")
    alike = asked.join(sized(often), "_h", "left").select("query_id", *profile, part).groupBy(*profile, "g").agg(F.collect_list("query_id").alias("candidate_ids"))
    spark = candidates.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))  # a profile is few bytes and much work
    alike = alike.withColumn("place", level_place(F.col("level"))).repartition(tasks, "vector")

    def scores(x: Column) -> Column:
        own = {"vector_score": x["vector_score"], "freshness_score": x["freshness_score"], "skill_score": skill_score(F.col("have"), x["need"]), "seniority_score": _seniority(F.col("place"), x["place"]), "location_score": _location(F.col("wanted"), x["places"], x["remote"])}
        total = lambda v: F.struct(x["job_id"].alias("job_id"), final_score(ranking, lambda n: v[n]).alias("final_score"), *(v[n].alias(n) for n in SCORES[1:]), x["need"].alias("need"))
        return let(F.struct(*(v.alias(n) for n, v in own.items())), total)

    return alike.hint("merge").join(pools, "vector").select("candidate_ids", "have", F.transform("pool", scores).alias("pool"))  # sent whole to the few tasks of the pools, profiles would all be scored there


def matches(pools: DataFrame) -> DataFrame:
    """A row for each candidate and posting of its pool, with all scores."""
    rows = pools.select(F.explode("candidate_ids").alias("candidate_id"), "have", "pool")
    rows = rows.select("candidate_id", "have", F.explode_outer("pool").alias("x"))  # behind `explode` Spark would filter by the pool's size and make it twice
    return rows.filter(F.col("x").isNotNull()).select("candidate_id", "have", "x.*")


def rank_matches(pools: DataFrame, ranking: Ranking = Ranking()) -> DataFrame:
    """Pools cut to the best, with `rank`: by total, vector, freshness, then job id. A pool is sorted within its row."""
    first = ("final_score", "vector_score", "freshness_score")
    keyed = F.transform("pool", lambda x: F.struct(*((-x[n]).alias(f"_{n}") for n in first), x["job_id"].alias("_id"), x.alias("x")))
    best = F.slice(F.sort_array(keyed), 1, ranking.limit)  # array_sort would call a function for each pair that it compares
    return pools.withColumn("pool", F.transform(best, lambda k, i: k["x"].withField("rank", i + 1)))


def match_results(ranked: DataFrame, ranking: Ranking = Ranking()) -> DataFrame:
    """Ranked pools with matched and missing skills, reasons and versions of each posting; they are made once for a profile."""
    have = F.col("have")

    def result(x: Column) -> Column:
        both = F.array_sort(F.array_intersect(have, x["need"]))
        reasons = F.array(F.when(x["vector_score"] >= 0.5, "SIMILAR_TEXT"), F.when(F.size(F.array_intersect(have, x["need"])) > 0, "SHARED_SKILLS"), F.when(x["seniority_score"] == 1, "SAME_LEVEL"), F.when(x["location_score"] == 1, "SAME_PLACE"), F.when(x["freshness_score"] == 1, "NEW"))
        more = {"matched_skills": both, "missing_skills": F.array_sort(F.array_except(x["need"], have)), "reasons": F.filter(reasons, lambda r: r.isNotNull()), "ranking_version": F.lit(ranking.version), "embedding_version": F.lit(ranking.embedding_version)}
        for name, value in more.items():
            x = x.withField(name, value)
        return x

    return ranked.withColumn("pool", F.transform("pool", result))
