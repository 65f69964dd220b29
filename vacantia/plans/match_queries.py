"""A5, G, H and I: vectors, matching and the query surface."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.operators import keyed, match, pools, quantiser, query, vectors
from vacantia.plans import base
from vacantia.sources import feed

c = F.col
AS_OF = "2001-12-01"


def _embeddings(spark, d):
    return feed.table(spark, d, "embeddings")


def _numbered(spark, d, name, key):
    """Rows of a table with the vector of `key` modulo the number of vectors."""
    e = _embeddings(spark, d)
    n = e.count()
    return feed.table(spark, d, name).withColumn("vec_id", c(key) % n).join(e.select("vec_id", "embedding"), "vec_id")


def _jobs(spark, d) -> DataFrame:
    p = _numbered(spark, d, "part", "p_partkey")
    level = F.when(c("p_size") % 4 == 0, "SENIOR").when(c("p_size") % 4 == 1, "JUNIOR").when(c("p_size") % 4 == 2, "MID").otherwise("UNKNOWN")
    place = F.when(c("p_size") % 3 == 0, F.array(F.lit("Hà Nội"))).when(c("p_size") % 3 == 1, F.array(F.lit("Hồ Chí Minh"))).otherwise(F.array().cast("array<string>"))
    posted = F.date_sub(F.lit(AS_OF).cast("date"), (c("p_partkey") % 40).cast("int"))
    deadline = F.when(c("p_partkey") % 5 == 0, F.date_add(F.lit(AS_OF).cast("date"), (c("p_partkey") % 7 - 3).cast("int")))
    return p.select(
        c("p_partkey").alias("job_id"), "embedding", F.array(F.initcap("p_type"), F.initcap("p_name")).alias("need"), level.alias("job_level"), place.alias("places"),
        F.when(c("p_size") % 5 == 0, "Remote").alias("place_text"), posted.alias("posted_at"), posted.alias("normalized_at"), deadline.alias("deadline_at"),
    )


def _candidates(spark, d) -> DataFrame:
    p = _numbered(spark, d, "customer", "c_custkey")
    level = F.when(c("c_custkey") % 4 == 0, "SENIOR").when(c("c_custkey") % 4 == 1, "JUNIOR").when(c("c_custkey") % 4 == 2, "MID").otherwise("UNKNOWN")
    wish = F.when(c("c_nationkey") % 3 == 0, F.array(F.lit("Hà Nội"))).when(c("c_nationkey") % 3 == 1, F.array(F.lit("Hồ Chí Minh"))).otherwise(F.array().cast("array<string>"))
    return p.select(c("c_custkey").alias("candidate_id"), "embedding", F.array(F.initcap("c_mktsegment"), F.lit("Small Ring"), F.lit("Promo")).alias("have"), level.alias("level"), wish.alias("wanted"))


def _eligible(spark, d):
    j = _jobs(spark, d)
    status = j.select("job_id", F.when(c("job_id") % 11 == 0, "FAILED").otherwise("READY").alias("status"), F.lit("hash-v1").alias("embedding_version"))
    return match.eligible_jobs(j, status, F.lit(AS_OF).cast("date"))


def _pairs(spark, d):
    """A pair for each order: its customer and the job of its number."""
    n = feed.table(spark, d, "part").count()
    o = feed.table(spark, d, "orders").select("o_orderkey", c("o_custkey").alias("candidate_id"), (c("o_orderkey") % n).alias("job_id"))
    return o.join(_candidates(spark, d).drop("embedding"), "candidate_id").join(_jobs(spark, d).drop("embedding"), "job_id")


def _pooled(spark, d, who=None):
    """Pools of all candidates, or of those that `who` names."""
    own = _candidates(spark, d)
    return match.pooled(own if who is None else own.filter(who), _eligible(spark, d), F.lit(AS_OF).cast("date"))


_SOME = "candidate_id % 50 = 0"


def h9(spark, d):
    """The best postings of every candidate."""
    out = match.matches(match.match_results(match.rank_matches(_pooled(spark, d))))
    return out.select("candidate_id", "job_id", "rank", *(F.array_join(x, ",").alias(x) for x in ("matched_skills", "missing_skills", "reasons")), "ranking_version")


def _points(spark, d):
    e = _embeddings(spark, d)
    return e.filter("vec_id % 50 = 0").select(c("vec_id").alias("query_id"), "embedding"), e.select(c("vec_id").alias("point_id"), "embedding")


def a5(spark, d):
    rows = []
    for name, r in (("hybrid-v1", match.Ranking()), ("hybrid-v1-plain", match.PLAIN)):
        rows.append((name, r.vector, r.skill, r.seniority, r.location, r.freshness, r.pool, r.limit))
    config = spark.createDataFrame(rows, "version string, vector double, skill double, seniority double, location double, freshness double, pool int, n int")
    return config.join(_embeddings(spark, d).agg(F.count("*").alias("vectors")))


def g2(spark, d):
    e = _embeddings(spark, d)
    v = F.when(c("vec_id") % 10 == 0, F.slice("embedding", 1, 10)).when(c("vec_id") % 10 == 1, F.transform("embedding", lambda x: x * 2)).when(c("vec_id") % 10 == 2, None).otherwise(c("embedding"))
    return e.select("vec_id", vectors.vector_fault(v).alias("reason"))


def g6(spark, d):
    """Recall of the approximate search against the exact one, and the share of points that it looks at, repeats included."""
    q, p = _points(spark, d)
    exact, near = vectors.top_k_cosine(q, p, 10), vectors.top_k_lsh(q, p, 10)
    hit = exact.join(near.select("query_id", "point_id").withColumn("hit", F.lit(1)), ["query_id", "point_id"], "left")
    recall = hit.groupBy("query_id").agg(F.round(F.count("hit") / F.count("*"), 4).alias("recall"))
    return recall.join(vectors.compared_share(q, p), "query_id")


def g5_blocks(spark, d):
    """Both sides dealt to blocks, as for query sets of any size."""
    return vectors.top_k_cosine(*_points(spark, d), 10, few=0, block=256).select("query_id", "point_id", "score", "rank")


def g6_cells(spark, d):
    """Recall and share of points looked at, on vectors that lie around every twentieth one."""
    e = _embeddings(spark, d).select("vec_id", "embedding")
    around = e.filter("vec_id < 25").select(c("vec_id").alias("g"), c("embedding").alias("m"))
    rows = e.withColumn("g", c("vec_id") % 25).join(F.broadcast(around), "g").select("vec_id", F.zip_with("m", "embedding", lambda a, b: a + b * 0.6).alias("embedding"))
    q, p = rows.filter("vec_id % 50 = 7").select(c("vec_id").alias("query_id"), "embedding"), rows.select(c("vec_id").alias("point_id"), "embedding")
    index = quantiser.Cells(p)
    exact, near = vectors.top_k_cosine(q, p, 10), index.top_k(q, 10, probes=4)
    hit = exact.join(near.select("query_id", "point_id").withColumn("hit", F.lit(1)), ["query_id", "point_id"], "left")
    recall = hit.groupBy("query_id").agg(F.round(F.count("hit") / F.count("*"), 4).alias("recall"))
    return recall.join(index.looked_at(q, probes=4), "query_id")


def h3_pools(spark, d):
    """Customers and orders: a customer has the parts of all own lines, an order needs those of its lines."""
    lines = feed.table(spark, d, "lineitem").select("l_orderkey", F.concat(F.lit("part "), c("l_partkey").cast("string")).alias("skill"))
    need = lines.groupBy(c("l_orderkey").alias("job_id")).agg(F.collect_list("skill").alias("need"))
    own = feed.table(spark, d, "orders").select(c("o_custkey").alias("candidate_id"), c("o_orderkey").alias("l_orderkey"))
    have = lines.join(own, "l_orderkey").groupBy("candidate_id").agg(F.collect_set("skill").alias("have"))
    return pools.skill_pools(have, need, 0.5, most=500).withColumn("skill_score", _ROUND(c("skill_score")))


def g7(spark, d):
    o = feed.table(spark, d, "orders").select((c("o_custkey") % 97).alias("point_id"), c("o_orderdate").alias("ts"), c("o_orderkey").alias("payload"))
    return keyed.write_keyed(o.filter("payload % 2 = 0"), o.filter("payload % 2 = 1"), ["point_id"], ["ts", "payload"])


def g8(spark, d):
    e = _embeddings(spark, d).withColumn("embedding_version", F.when(c("vec_id") % 7 == 0, "old").otherwise("hash-v1"))
    return vectors.compatibility(e, 64, "hash-v1")


def i1(spark, d):
    o = feed.observations(spark, d)
    return query.list_page(o.select("source_code", "title", "l_orderkey", "l_linenumber", "detail_url", "collected_at"), {"source_code": " bravo", "title": None}, [c("collected_at").desc(), c("l_orderkey").desc(), c("l_linenumber"), c("detail_url")], 2, 20).select("source_code", "title", "l_orderkey", "l_linenumber", "total", "pages")


def _letters():
    """A provider: the shares of five letters in a text."""
    return lambda texts: [[t.count(x) / max(1, len(t)) for x in "aeiou"] for t in texts]


def i1_deep(spark, d):
    """A page in the middle of all rows, by ranks."""
    o = feed.observations(spark, d).select("source_code", "title", "l_orderkey", "l_linenumber", "detail_url", "collected_at")
    return query.list_page(o, {"source_code": None}, [c("collected_at").desc(), c("l_orderkey").desc(), c("l_linenumber"), c("detail_url")], 30, 50, deep=0).select("source_code", "title", "l_orderkey", "l_linenumber", "total", "pages")


_ROUND = lambda x: F.round(x, 6)

QUERIES = {
    "a5_ranking_config": a5,
    "g1_embed_batch_vectors": lambda spark, d: vectors.embed_batch(feed.table(spark, d, "documents").select("doc_id", "text"), "text", load=_letters, hot=3).select("doc_id", F.transform("embedding", lambda x: F.round(x.cast("double") * 10_000).cast("long")).cast("string").alias("vector")),
    "g1_embed_batch": lambda spark, d: vectors.embed_batch(feed.table(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id", "text_hash", _ROUND(vectors.norm(c("embedding"))).alias("norm"), "embedding_version"),
    "g2_validate_vectors": g2,
    "g3_l2_normalize": lambda spark, d: _embeddings(spark, d).select("vec_id", F.round(vectors.norm(vectors.l2_normalize(F.transform("embedding", lambda x: x * 3))), 5).alias("norm")),
    "g4_point_id": lambda spark, d: feed.table(spark, d, "part").select("p_partkey", vectors.point_id(F.concat(c("p_partkey").cast("string"), F.lit(":hash-v1"))).alias("point_id")),
    "g5_top_k_cosine": lambda spark, d: vectors.top_k_cosine(*_points(spark, d), 10).select("query_id", "point_id", "score", "rank"),
    "g5_top_k_cosine_blocks": g5_blocks,
    "g6_top_k_lsh": g6,
    "g6_top_k_cells": g6_cells,
    "g7_upsert_points": g7,
    "g8_compatibility_check": g8,
    "h1_eligible_jobs": lambda spark, d: _eligible(spark, d).select("job_id"),
    "h2_vector_score": lambda spark, d: vectors.top_k_cosine(*_points(spark, d), 20).select("query_id", "point_id", match.vector_score(c("score")).alias("vector_score")),
    "h3_skill_score": lambda spark, d: _pairs(spark, d).select("o_orderkey", _ROUND(match.skill_score(c("have"), c("need"))).alias("score")),
    "h3_skill_pools": h3_pools,
    "h4_seniority_score": lambda spark, d: _pairs(spark, d).select("o_orderkey", match.seniority_score(c("level"), c("job_level")).alias("score")),
    "h5_location_score": lambda spark, d: _pairs(spark, d).select("o_orderkey", match.location_score(c("wanted"), c("places"), c("place_text")).alias("score")),
    "h6_freshness_score": lambda spark, d: _pairs(spark, d).select("o_orderkey", match.freshness_score(c("posted_at"), F.lit(AS_OF).cast("date")).alias("score")),
    "h7_final_score": lambda spark, d: match.matches(_pooled(spark, d, _SOME)).select("candidate_id", "job_id", "final_score"),
    "h8_rank_matches": lambda spark, d: match.matches(match.rank_matches(_pooled(spark, d, _SOME))).select("candidate_id", "job_id", "final_score", "rank"),
    "h9_match_results": h9,
    "i1_list_jobs": i1,
    "i1_list_jobs_deep": i1_deep,
    "i2_latest_raw": lambda spark, d: query.latest(feed.observations(spark, d).select("title", "collected_at", "l_orderkey", "l_linenumber", "detail_url"), [c("collected_at").desc(), c("l_orderkey").desc(), c("l_linenumber"), c("detail_url")], 50),
    "i3_get_latest_embedding": lambda spark, d: query.latest_by_key(feed.table(spark, d, "orders"), "o_custkey", 7, [c("o_orderdate").desc(), c("o_orderkey").desc()]).select("o_custkey", "o_orderkey", "o_orderdate"),
    "i3_get_job": lambda spark, d: query.by_key(keyed.with_fingerprint(feed.observations(spark, d)), "fingerprint", "ALPHA:11").select("fingerprint", "title", "l_orderkey", "l_linenumber"),
    "i4_owner_profiles": lambda spark, d: query.by_key(feed.cv_text(spark, d), "candidate_id", 11).select("candidate_id", "doc_id").orderBy(c("doc_id").desc()),
    "i5_failed_embeddings": lambda spark, d: query.by_key(feed.table(spark, d, "events").select("event_id", "ts", c("event_type").alias("status")), "status", "error").orderBy("ts", "event_id"),
}

_JOBS = """np AS (SELECT count(*) AS n FROM embeddings), jobs AS (SELECT p_partkey AS job_id, e.embedding::DOUBLE[] AS v, p_type, p_name, p_size, DATE '2001-12-01' - CAST(p_partkey % 40 AS INTEGER) AS posted, CASE WHEN p_partkey % 5 = 0 THEN DATE '2001-12-01' + CAST(p_partkey % 7 - 3 AS INTEGER) END AS deadline FROM part, np, embeddings e WHERE e.vec_id = p_partkey % np.n),
elig AS (SELECT * FROM jobs WHERE (deadline IS NULL OR deadline >= DATE '2001-12-01') AND posted >= DATE '2001-12-01' - 30 AND job_id % 11 <> 0),
cand AS (SELECT c_custkey AS candidate_id, e.embedding::DOUBLE[] AS v, c_mktsegment, c_nationkey FROM customer, np, embeddings e WHERE e.vec_id = c_custkey % np.n)"""
_INIT = lambda x: f"array_to_string(list_transform(string_split(lower({x}), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"
_NEED, _HAVE = f"[{_INIT('p_type')}, {_INIT('p_name')}]", f"[{_INIT('c_mktsegment')}, 'Small Ring', 'Promo']"
_SKILL = f"(len(list_filter(list_distinct({_NEED}), lambda x: list_contains({_HAVE}, x))) / 2.0::DOUBLE)"
_RANKS = "CASE {} % 4 WHEN 0 THEN 7 WHEN 1 THEN 5 WHEN 2 THEN 6 END"
_D = f"abs({_RANKS.format('candidate_id')} - {_RANKS.format('p_size')})"
_SEN = f"CASE WHEN {_D} IS NULL THEN 0.5 WHEN {_D} = 0 THEN 1.0 WHEN {_D} = 1 THEN 0.7 ELSE 0.4 END::DOUBLE"
_LOC = "CASE WHEN c_nationkey % 3 = 2 THEN 0.5 WHEN p_size % 5 = 0 OR c_nationkey % 3 = p_size % 3 THEN 1.0 ELSE 0.0 END::DOUBLE"
_FRESH = "round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (30.0::DOUBLE - date_diff('day', posted, DATE '2001-12-01')) / 23.0::DOUBLE)), 6)"
_PAIRS = f"WITH {_JOBS}, pairs AS (SELECT o_orderkey, cand.candidate_id, c_mktsegment, c_nationkey, p_type, p_name, p_size, posted FROM orders, (SELECT count(*) AS k FROM part) t, cand, jobs WHERE cand.candidate_id = o_custkey AND jobs.job_id = o_orderkey % k)"
_COS = "round(list_inner_product({0}, {1}) / sqrt(list_inner_product({0}, {0})) / sqrt(list_inner_product({1}, {1})), 6)"
_TOP = f"q AS (SELECT a.vec_id AS query_id, b.vec_id AS point_id, {_COS.format('a.embedding::DOUBLE[]', 'b.embedding::DOUBLE[]')} AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS rank FROM q)"
_SCORED = f"""WITH {_JOBS}, s0 AS (SELECT c.candidate_id, j.job_id, {_COS.format('c.v', 'j.v')} AS s, c_mktsegment, c_nationkey, p_type, p_name, p_size, posted FROM cand c, elig j WHERE c.candidate_id % 50 = 0), s1 AS (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY s DESC, job_id) AS r FROM s0),
s2 AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, s)) AS v, {_SKILL} AS sk, {_SEN} AS se, {_LOC} AS lo, {_FRESH} AS fr FROM s1 WHERE r <= 100), s3 AS (SELECT *, round(0.0::DOUBLE + v * 0.5::DOUBLE + sk * 0.3::DOUBLE + se * 0.1::DOUBLE + lo * 0.05::DOUBLE + fr * 0.05::DOUBLE, 8) AS final_score FROM s2),
s4 AS (SELECT *, CAST(row_number() OVER (PARTITION BY candidate_id ORDER BY final_score DESC, v DESC, fr DESC, job_id) AS INTEGER) AS rank FROM s3)"""
_W = f"WITH {base.OBS}"

ORACLES = {
    "a5_ranking_config": "SELECT v AS version, a::DOUBLE AS vector, b::DOUBLE AS skill, c::DOUBLE AS seniority, d::DOUBLE AS location, e::DOUBLE AS freshness, 100 AS pool, 20 AS n, (SELECT count(*) FROM embeddings) AS vectors FROM (VALUES ('hybrid-v1', 0.5, 0.3, 0.1, 0.05, 0.05), ('hybrid-v1-plain', 0.1, 0.6, 0.15, 0.1, 0.05)) t(v, a, b, c, d, e)",
    "g1_embed_batch": "SELECT doc_id, sha256(coalesce(text, '')) AS text_hash, 1.0::DOUBLE AS norm, 'hash-v1' AS embedding_version FROM documents",
    "g1_embed_batch_vectors": "SELECT doc_id, '[' || array_to_string(list_transform(['a', 'e', 'i', 'o', 'u'], lambda x: CAST(CAST(round(CAST(CAST((length(text) - length(replace(text, x, ''))) / greatest(1, length(text))::DOUBLE AS FLOAT) AS DOUBLE) * 10000) AS BIGINT) AS VARCHAR)), ', ') || ']' AS vector FROM documents",
    "g2_validate_vectors": "SELECT vec_id, CASE vec_id % 10 WHEN 0 THEN 'WRONG_LENGTH' WHEN 1 THEN 'NOT_UNIT' WHEN 2 THEN 'NULL_VECTOR' END AS reason FROM embeddings",
    "g3_l2_normalize": "SELECT vec_id, 1.0::DOUBLE AS norm FROM embeddings",
    "g4_point_id": "WITH h AS (SELECT p_partkey, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(p_partkey || ':hash-v1')) AS h FROM part) SELECT p_partkey, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', (strpos('0123456789abcdef', h[17]) - 1) % 4 + 1, 1) || h[18:20] || '-' || h[21:32] AS point_id FROM h",
    "g5_top_k_cosine": f"WITH {_TOP} SELECT query_id, point_id, score, CAST(rank AS INTEGER) AS rank FROM t WHERE rank <= 10",
    "g5_top_k_cosine_blocks": f"WITH {_TOP} SELECT query_id, point_id, score, CAST(rank AS INTEGER) AS rank FROM t WHERE rank <= 10",
    "g7_upsert_points": "SELECT point_id, arg_max(ts, (ts, payload)) AS ts, arg_max(payload, (ts, payload)) AS payload FROM (SELECT o_custkey % 97 AS point_id, o_orderdate AS ts, o_orderkey AS payload FROM orders) GROUP BY point_id",
    "g8_compatibility_check": "SELECT CAST(min(len(embedding)) AS INTEGER) AS least, CAST(max(len(embedding)) AS INTEGER) AS most, count(*) FILTER (WHERE len(embedding) <> 64) AS wrong_length, count(*) FILTER (WHERE vec_id % 7 = 0) AS other_version FROM embeddings",
    "h1_eligible_jobs": f"WITH {_JOBS} SELECT job_id FROM elig",
    "h2_vector_score": f"WITH {_TOP} SELECT query_id, point_id, greatest(0.0::DOUBLE, least(1.0::DOUBLE, score)) AS vector_score FROM t WHERE rank <= 20",
    "h3_skill_score": f"{_PAIRS} SELECT o_orderkey, round({_SKILL}, 6) AS score FROM pairs",
    "h3_skill_pools": """WITH need AS (SELECT DISTINCT l_orderkey AS job_id, l_partkey AS skill FROM lineitem), have AS (SELECT DISTINCT o_custkey AS candidate_id, l_partkey AS skill FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
  m AS (SELECT candidate_id, job_id, CAST(count(*) AS INTEGER) AS matched FROM need JOIN have USING (skill) GROUP BY ALL), n AS (SELECT job_id, CAST(count(*) AS INTEGER) AS needed FROM need GROUP BY job_id)
SELECT candidate_id, job_id, matched, needed, round(matched / needed::DOUBLE, 6) AS skill_score FROM m JOIN n USING (job_id) WHERE matched >= 0.5 * needed""",
    "h4_seniority_score": f"{_PAIRS} SELECT o_orderkey, {_SEN} AS score FROM pairs",
    "h5_location_score": f"{_PAIRS} SELECT o_orderkey, {_LOC} AS score FROM pairs",
    "h6_freshness_score": f"{_PAIRS} SELECT o_orderkey, {_FRESH} AS score FROM pairs",
    "h7_final_score": f"{_SCORED} SELECT candidate_id, job_id, final_score FROM s4",
    "h8_rank_matches": f"{_SCORED} SELECT candidate_id, job_id, final_score, rank FROM s4 WHERE rank <= 20",
    "h9_match_results": f"""{_SCORED.replace(" WHERE c.candidate_id % 50 = 0", "")} SELECT candidate_id, job_id, rank, array_to_string(list_sort(list_filter(list_distinct({_NEED}), lambda x: list_contains({_HAVE}, x))), ',') AS matched_skills, array_to_string(list_sort(list_filter(list_distinct({_NEED}), lambda x: NOT list_contains({_HAVE}, x))), ',') AS missing_skills,
  array_to_string(list_filter([CASE WHEN v >= 0.5 THEN 'SIMILAR_TEXT' END, CASE WHEN sk > 0 THEN 'SHARED_SKILLS' END, CASE WHEN se = 1 THEN 'SAME_LEVEL' END, CASE WHEN lo = 1 THEN 'SAME_PLACE' END, CASE WHEN fr = 1 THEN 'NEW' END], lambda x: x IS NOT NULL), ',') AS reasons, 'hybrid-v1' AS ranking_version FROM s4 WHERE rank <= 20""",
    "i1_list_jobs": f"{_W}, f AS (SELECT *, count(*) OVER () AS total FROM obs WHERE source_code = 'BRAVO') SELECT source_code, title, l_orderkey, l_linenumber, total, CAST(ceil(total / 20) AS BIGINT) AS pages FROM f ORDER BY collected_at DESC, l_orderkey DESC, l_linenumber, detail_url LIMIT 20 OFFSET 40",
    "i1_list_jobs_deep": f"{_W} SELECT source_code, title, l_orderkey, l_linenumber, count(*) OVER () AS total, CAST(ceil(count(*) OVER () / 50) AS BIGINT) AS pages FROM obs ORDER BY collected_at DESC, l_orderkey DESC, l_linenumber, detail_url LIMIT 50 OFFSET 1500",
    "i2_latest_raw": f"{_W} SELECT title, collected_at, l_orderkey, l_linenumber, detail_url FROM obs ORDER BY collected_at DESC, l_orderkey DESC, l_linenumber, detail_url LIMIT 50",
    "i3_get_latest_embedding": "SELECT o_custkey, o_orderkey, o_orderdate FROM orders WHERE o_custkey = 7 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1",
    "i3_get_job": f"{_W} SELECT fingerprint, title, l_orderkey, l_linenumber FROM obs WHERE fingerprint = 'ALPHA:11'",
    "i4_owner_profiles": f"WITH {base.CV} SELECT candidate_id, doc_id FROM cv WHERE candidate_id = 11",
    "i5_failed_embeddings": "SELECT event_id, ts, event_type AS status FROM events WHERE event_type = 'error'",
}
