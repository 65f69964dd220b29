"""A, D and E: postings, their normalisers and their life."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from vacantia.functions import text as t
from vacantia.operators import jobs, keyed, tables
from vacantia.plans import base
from vacantia.sources import feed, layout, taxonomy
from vacantia.sources.shared import folder, written

c = F.col
KEYS = ("l_orderkey", "l_linenumber", "collected_at", "source_code", "detail_url")


def _obs(spark, d):
    return keyed.with_fingerprint(feed.observations(spark, d))


def _field(*columns):
    return lambda spark, d: feed.observations(spark, d).select(*KEYS[:2], "detail_url", "collected_at", *columns)


def _distinct(text, make):
    """The distinct texts of a column and what a normaliser makes of each."""
    return lambda spark, d: feed.observations(spark, d).select(text).distinct().select(text, *make(c(text)))


def _struct(text, make):
    return lambda spark, d: feed.observations(spark, d).groupBy(text).count().select(text, "count", make(c(text)).alias("v")).select(text, "count", "v.*")


def d4(spark, d):
    rows = feed.observations(spark, d).select("skills_text").distinct()
    return jobs.skill_list(rows, "skills_text", "skills_text", taxonomy.skills(spark)).select("skills_text", F.array_join("skills", "|").alias("skills"))


def d5(spark, d):
    docs = feed.table(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("prose"))
    return jobs.prose_skills(docs, "p_partkey", "prose", taxonomy.skills(spark)).select("p_partkey", "canonical").distinct()


def d6(spark, d):
    parts = feed.table(spark, d, "part").select("p_partkey", F.when(c("p_size") % 2 == 0, F.concat_ws(",", "p_type", "p_brand")).otherwise(c("p_type")).alias("raw"), "p_name")
    raw = parts.select("p_partkey", "p_name", jobs.split_list(c("raw")).alias("raw"))
    found = jobs.prose_skills(raw.filter(F.size("raw") < 2).select("p_partkey", "p_name"), "p_partkey", "p_name", taxonomy.skills(spark)).groupBy("p_partkey").agg(F.array_sort(F.collect_set("canonical")).alias("found"))
    return raw.join(found, "p_partkey", "left").select("p_partkey", F.array_join(jobs.merge_skills(c("raw"), c("found")), "|").alias("skills"))


def d7(spark, d):
    rows = feed.observations(spark, d).select("location_text").distinct()
    named = jobs.locations(rows, "location_text", "location_text", taxonomy.locations(spark))
    return rows.join(named, "location_text", "left").select("location_text", F.array_join(F.coalesce("locations", F.array().cast("array<string>")), "|").alias("locations"))


def d9(spark, d):
    e = jobs.experience(c("experience_text"))
    rows = feed.observations(spark, d).groupBy("title", "experience_text").count()
    return rows.withColumn("e", e).select("title", "experience_text", "count", jobs.resolve_seniority(F.lit(None).cast("string"), c("title"), c("e.experience_min"), c("e.experience_max")).alias("seniority"))


def d13(spark, d):
    o = feed.observations(spark, d).select("detail_url", "l_linenumber").distinct()
    kind = c("l_linenumber") % 4
    url = F.when(kind == 0, "mailto:jobs@mail.example.com").when(kind == 1, "/apply").when(kind == 2, "ftp://x.example.com/a").otherwise("https://apply.example.org/x")
    return o.withColumn("v", jobs.apply_target(url, F.lit(None).cast("string"), c("detail_url"))).select("detail_url", "l_linenumber", "v.*")


_HASHED = ("source_code", "source_job_id", "detail_url", "title", "company_name", "salary_text", "experience_text", "location_text", "job_type_text", "posted_text", "deadline_text")


def d14(spark, d):
    o = feed.observations(spark, d)
    return o.select(*KEYS[:2], "detail_url", "collected_at", jobs.content_hash({k: c(k) for k in _HASHED}).alias("content_hash"))


def d15_whole(spark, d):
    o = feed.observations(spark, d).select("title", "company_name", "skills_text", "experience_text").distinct()
    return o.select("*", jobs.text_query({"Title": (c("title"), 2400), "Company": (c("company_name"), 2400), "Skills": (c("skills_text"), 2400), "Experience": (c("experience_text"), 2400)}).alias("value"))


def d16_whole(spark, d):
    o = feed.observations(spark, d).select("title", "company_name", "skills_text", "experience_text").distinct()
    return o.select("*", jobs.text_passage({"Title": c("title"), "Company": c("company_name"), "Skills": c("skills_text"), "Experience": c("experience_text")}).alias("value"))


def d17(spark, d):
    o = feed.observations(spark, d).select("experience_text").distinct().withColumn("e", jobs.experience(c("experience_text")))
    return o.select("experience_text", jobs.format_experience(c("e.experience_min"), c("e.experience_max")).alias("value"))


def d18(spark, d):
    return feed.observations(spark, d).select("skills_text").distinct().select("skills_text", jobs.join_stable(F.split("skills_text", "[,;]")).alias("value"))


_NORMAL = ("fingerprint", "l_orderkey", "l_linenumber", "collected_at", "salary_min", "salary_max", "currency", "experience_min", "experience_max", "seniority", "job_type")


def d19(spark, d):
    return jobs.normalized(_obs(spark, d)).select(*_NORMAL)


_WHOLE = ("fingerprint", "salary_min", "salary_max", "currency", "experience_min", "experience_max", "seniority", "job_type", "posted_at", "deadline_at", "skills", "locations", "apply_url", "apply_type", "content_hash", "query", "passage", "normalization_version")


#: Further raw fields, made from those of the feed; the SQL runs unchanged in both engines.
_RICH = {
    "skills_text": "CASE WHEN length(company_name) % 2 = 0 THEN split_part(skills_text, ',', 1) ELSE skills_text END",
    "seniority_text": "CASE WHEN title LIKE 'Head of%' THEN 'Senior level' WHEN length(title) % 4 = 0 THEN 'Fresher' END",
    "requirements_text": "CASE WHEN length(title) % 2 = 0 THEN 'Must know ' || title || ' and sql server' || chr(10) || ' - C++  a plus' END",
    "description_text": "'We make ' || skills_text || '.' || chr(10) || 'Python helps.'",
    "benefits_text": "CASE WHEN length(title) % 3 = 0 THEN ' Lunch ' || chr(10) || '13th  month pay ' END",
    "apply_url": "CASE WHEN length(title) % 5 = 0 THEN 'mailto:jobs@mail.example.com' END",
}


def d19_whole(spark, d):
    """Whole normalised jobs of the newest sighting of each fingerprint, with all sections; the feed is read once."""
    rich = written(_live(spark, d).withColumns({k: F.expr(v) for k, v in _RICH.items()}), "newest")
    out = jobs.normalize_jobs(rich, "fingerprint", taxonomy.skills(spark, placed=True), taxonomy.locations(spark)).select(*_WHOLE)
    out = out.withColumns({x: c(x).cast("timestamp_ntz") for x in ("posted_at", "deadline_at")})
    return out.withColumns({x: F.array_join(x, "|") for x in ("skills", "locations")})


def _stored(spark, d):
    """Yesterday's run and today's: content hashes of the newest sighting by fingerprint. Both in one pass, each hashed once.

    What one source shows of one part is hashed before runs meet by fingerprint, so texts are neither sorted nor shuffled for them.
    """
    fields, rows = ("title", "salary_text", "posted_text"), keyed.with_fingerprint(feed.newest(spark, d, c("l_orderkey") % 3 == 0))
    seen = rows.select("fingerprint", "is_new", "is_past", F.struct(*keyed.ORDER).alias("at"), F.struct("source_code", F.unhex(jobs.content_hash({k: c(k) for k in fields})).alias("digest"), *keyed.ORDER).alias("row"))
    newest = lambda which: F.max_by(F.when(c(which), c("row")), F.when(c(which), c("at")))
    both = written(seen.groupBy("fingerprint").agg(newest("is_new").alias("new"), newest("is_past").alias("old")), "stored-runs")
    of = lambda n: both.filter(c(n).isNotNull()).select("fingerprint", f"{n}.source_code", F.lower(F.hex(f"{n}.digest")).alias("digest"), *(f"{n}.{k}" for k in keyed.ORDER))
    return of("new"), of("old")


def e5(spark, d):
    new, old = _stored(spark, d)
    return keyed.normalization_action(new.select("fingerprint", "digest"), old, ["fingerprint"], "digest").select("fingerprint", "action")


def e7(spark, d):
    return keyed.renormalization_report(e5(spark, d), "fingerprint", 500)


def _broken(spark, d):
    """Raw jobs of which some break a normaliser, and the digests of an earlier run."""
    p, k = feed.table(spark, d, "part"), c("p_partkey")
    salary = F.when(k % 40 == 7, F.concat(F.repeat(F.lit("9"), 20), F.lit(" USD"))).when(k % 40 == 8, "99999999999999999999 tỷ").otherwise("1000 - 2000 USD")
    posted = F.when(k % 50 == 3, "99999999 days ago").when(k % 50 == 4, "999999999 weeks ago").otherwise("hôm qua")
    raw = p.select(F.when(k % 90 != 5, F.lpad(k.cast("string"), 8, "0")).alias("raw_id"), k.alias("p_partkey"), salary.alias("salary_text"), posted.alias("posted_text"), F.when(k % 60 != 1, F.lit("2001-12-01").cast("timestamp")).alias("collected_at"), c("p_name").alias("title"), F.sha2(c("p_name").cast("binary"), 256).alias("digest"))
    old = raw.filter(k % 3 != 0).select("raw_id", F.when(k % 3 == 1, c("digest")).otherwise("other").alias("digest")).filter("raw_id IS NOT NULL")
    lacking = {n: F.lit(None).cast("string") for n in ("experience_text", "job_type_text", "deadline_text")}
    return jobs.checked(jobs.normalized(raw.withColumns(lacking)), "raw_id"), old


def e7_failures(spark, d):
    rows, old = _broken(spark, d)
    return keyed.renormalization_report(keyed.normalization_action(rows, old, ["raw_id"], "digest"), "p_partkey", 500)


def e7_quarantine(spark, d):
    """The rows that failed with why; the others are normalised (salary and time of each)."""
    good, bad = jobs.quarantine(_broken(spark, d)[0])
    failed = bad.select("p_partkey", F.explode("errors").alias("e")).select("p_partkey", "e.field", "e.reason")
    done = good.select("p_partkey", "salary_min", "salary_max", c("posted_at").cast("timestamp_ntz").alias("posted_at"))
    return failed.unionByName(done, allowMissingColumns=True)


def e4(spark, d):
    new, old = _stored(spark, d)
    raw = new.select("fingerprint", c("digest").alias("raw_html"))
    return keyed.purge_payload(raw, old, "fingerprint", ("raw_html",), F.lit("2002-01-01").cast("timestamp")).select("fingerprint", "raw_html", c("raw_payload_purged_at").isNotNull().alias("purged"))


def e8(spark, d):
    v = feed.table(spark, d, "embeddings").select("vec_id")
    items = feed.table(spark, d, "part").select(c("p_partkey").alias("job_id"), F.sha2(c("p_name").cast("binary"), 256).alias("text_hash"), c("p_partkey").alias("point_id"))
    old = F.when(c("p_partkey") % 4 == 1, F.lit("other")).otherwise(F.sha2(c("p_name").cast("binary"), 256))
    status = feed.table(spark, d, "part").filter("p_partkey % 5 <> 0").select(c("p_partkey").alias("job_id"), F.when(c("p_partkey") % 3 == 0, "PROCESSING").otherwise("READY").alias("status"), old.alias("text_hash"), F.when(c("p_partkey") % 2 == 0, F.lit("2024-01-01 00:00:00").cast("timestamp")).otherwise(F.lit("2023-01-01 00:00:00").cast("timestamp")).alias("updated_at"))
    return keyed.embedding_work_queue(items, status, ["job_id"], v.select(c("vec_id").alias("point_id")), F.lit("2024-01-01 00:00:30").cast("timestamp")).select("job_id", "decision")


def e10(spark, d):
    new, old = _stored(spark, d)
    emb = new.filter(F.ascii(F.substring("digest", 1, 1)) % 2 == 0).select("fingerprint")
    return keyed.reconciliation({"raw_without_normalized": (new.select("fingerprint"), old, "fingerprint"), "normalized_without_embedding": (old.select("fingerprint"), emb, "fingerprint"), "embedding_without_job": (emb, old, "fingerprint")})


def a1(spark, d):
    return feed.observations(spark, d).filter(c("source_code") == "ALPHA").select("source_job_id", "detail_url", "title", "l_orderkey", "l_linenumber")


def _new_folder(spark, label: str) -> str:
    return f"{folder(spark)}/vacantia/{label}-{uuid.uuid4().hex}"


def a1_pruned(spark, d):
    """The feed written by source and year, and read back: two sources of some years that a table names."""
    at = _new_folder(spark, "observations")
    layout.write_observations(feed.observations(spark, d), at, "year")
    years = feed.table(spark, d, "orders").filter(c("o_orderdate") < "1996-01-01").select(F.date_format("o_orderdate", "yyyy").alias("period")).distinct()
    rows = layout.read_observations(spark, at, ["alpha", " Delta "], since="1995", only=years)
    return rows.select("source_code", "period", "source_job_id", "detail_url", "title", "l_orderkey", "l_linenumber")


def a3_table(spark, d):
    """Three writes, the newest rows first, to a table in parts; then one of few keys, which leaves the other parts alone."""
    o = written(_obs(spark, d).select("fingerprint", "title", *keyed.ORDER), "sightings")  # the writes read it many times, its four tables once
    table = tables.KeyedTable(spark, _new_folder(spark, "keyed"), o.schema.simpleString().removeprefix("struct<").removesuffix(">"), ["fingerprint"], list(keyed.ORDER), parts=16)
    for k in (2, 0, 1):
        table.write(o.filter(c("l_orderkey") % 3 == k))
    table.write(o.filter("fingerprint = 'ALPHA:11'"))
    return table.read()


def a2(spark, d):
    a = taxonomy.skills(spark).select("alias", "canonical").unionByName(taxonomy.locations(spark).select("alias", "canonical"))
    parts = feed.table(spark, d, "part").select(c("p_name").alias("alias"), c("p_type").alias("canonical"))
    return taxonomy.collisions(parts.unionByName(a), t.compact_key(c("alias")))


def a3(spark, d):
    o = _obs(spark, d).select("fingerprint", "title", *keyed.ORDER)
    return keyed.write_keyed(o.filter("l_orderkey % 3 = 0"), o.filter("l_orderkey % 3 <> 0"), ["fingerprint"], list(keyed.ORDER))


def _live(spark, d, *fields):
    return keyed.upsert_seen(keyed.with_fingerprint(feed.newest(spark, d)), fields=fields or keyed.FIELDS, combined=True)


def flagship(spark, d):
    """Newest live postings per source with salary range and seniority."""
    rows = keyed.live(_live(spark, d, "source_code", *jobs.FIELDS, "posted_text", "deadline_text"), F.lit("1998-01-01").cast("timestamp"))
    w = Window.partitionBy("source_code").orderBy(c("last_seen_at").desc(), "fingerprint")
    top = jobs.normalized(rows.withColumn("rank", F.row_number().over(w)).filter("rank <= 20"), repeated=False)
    return top.select("source_code", "rank", "fingerprint", "title", "salary_min", "salary_max", "currency", "seniority", "job_type", "last_seen_at")


QUERIES = {
    "a1_read_raw_observations": a1,
    "a1_pruned_reads": a1_pruned,
    "a2_load_taxonomy": a2,
    "a3_write_keyed": a3,
    "a3_write_keyed_table": a3_table,
    "a4_read_pages": lambda spark, d: feed.table(spark, d, "pages").select("page_id", "url", F.length("html").alias("n_chars")),
    "d1_normalize_salary": _struct("salary_text", jobs.salary),
    "d2_parse_number_token": lambda spark, d: feed.table(spark, d, "part").select("p_partkey", F.format_number("p_retailprice", 2).alias("token")).select("p_partkey", "token", jobs.parse_number(c("token")).cast("double").alias("value")),
    "d3_normalize_experience": _struct("experience_text", jobs.experience),
    "d4_normalize_skill_list": d4,
    "d5_extract_skills_from_prose": d5,
    "d6_merge_skills": d6,
    "d7_normalize_locations": d7,
    "d8_classify_seniority": _distinct("title", lambda x: [jobs.classify_seniority(x).alias("level")]),
    "d9_resolve_seniority": d9,
    "d10_classify_job_type": lambda spark, d: feed.observations(spark, d).groupBy("title", "job_type_text").count().select("title", "job_type_text", "count", jobs.classify_job_type(c("job_type_text"), c("title")).alias("job_type")),
    "d11_normalize_posted_at": lambda spark, d: feed.observations(spark, d).groupBy("posted_text", "collected_at").count().select("*", jobs.posted_at(c("posted_text"), c("collected_at").cast("timestamp")).cast("timestamp_ntz").alias("posted_at")),
    "d12_normalize_deadline_at": lambda spark, d: feed.observations(spark, d).groupBy("deadline_text", "collected_at").count().select("*", jobs.deadline_at(c("deadline_text"), c("collected_at").cast("timestamp")).cast("timestamp_ntz").alias("deadline_at")),
    "d13_normalize_apply": d13,
    "d14_content_hash": d14,
    "d15_job_text_query": d15_whole,
    "d16_job_text_passage": d16_whole,
    "d15_job_text_query_whole": d15_whole,
    "d16_job_text_passage_whole": d16_whole,
    "d17_format_experience": d17,
    "d18_join_stable": d18,
    "d19_normalize_jobs": d19,
    "d19_normalize_jobs_whole": d19_whole,
    "e1_fingerprint": lambda spark, d: _obs(spark, d).select("l_orderkey", "l_linenumber", "collected_at", "fingerprint"),
    "e2_upsert_seen": lambda spark, d: _live(spark, d, "title", "salary_text", "posted_text").select("fingerprint", "title", "salary_text", "posted_text", "first_seen_at", "last_seen_at", "expires_at", "sightings"),
    "e3_expire_raw": lambda spark, d: keyed.live(_live(spark, d, "source_code"), F.lit("1998-01-01").cast("timestamp")).select("fingerprint", "expires_at"),
    "e4_purge_payload": e4,
    "e5_normalization_action": e5,
    "e6_changed_feed": lambda spark, d: keyed.changed_feed(e5(spark, d)),
    "e7_renormalization_report": e7,
    "e7_renormalization_failures": e7_failures,
    "e7_quarantine": e7_quarantine,
    "e8_embedding_work_queue": e8,
    "e9_latest_per_key": lambda spark, d: keyed.latest_per_key(_obs(spark, d).select("detail_url", "title", "salary_text", *keyed.ORDER), ["detail_url"], list(keyed.ORDER)),
    "e10_pipeline_reconciliation": e10,
    "e11_status_transition_audit": lambda spark, d: keyed.transition_audit(feed.table(spark, d, "events"), "user_id", "event_type", ["ts", "event_id"], (("view", "click"), ("click", "purchase"), ("signup", "view"))),
    "e12_duplicate_content_report": lambda spark, d: keyed.duplicate_content(feed.table(spark, d, "documents"), "doc_id", "text"),
    "e13_version_coverage": lambda spark, d: jobs.normalized(_obs(spark, d)).rollup("source_code", "normalization_version").agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("level")),
    "flagship_live_postings": flagship,
}

# The comparison queries.
_SALARY = """CASE WHEN s LIKE '%$%' AND s LIKE '%triệu%' THEN NULL WHEN s LIKE '% - % USD' THEN {0} WHEN s LIKE '% - % triệu' THEN {1} WHEN s LIKE '$%+' THEN {2} WHEN s LIKE 'Up to %' THEN {3} WHEN s LIKE 'Từ %' THEN {4} WHEN s LIKE '%,000,000 VND' THEN {5} END"""
_n = lambda i: rf"CAST(regexp_extract_all(s, '\d+')[{i}] AS BIGINT)"


def _salary(s: str) -> str:
    low = _SALARY.format(f"least({_n(1)}, {_n(2)})", f"{_n(1)} * 1000000", _n(1), "NULL", f"{_n(1)} * 1000000", f"{_n(1)} * 1000000")
    high = _SALARY.format(f"greatest({_n(1)}, {_n(2)})", f"{_n(2)} * 1000000", "NULL", f"{_n(1)} * 1000", "NULL", f"{_n(1)} * 1000000")
    cur = "CASE WHEN s LIKE '%$%' AND s LIKE '%triệu%' THEN NULL WHEN s LIKE '%USD' OR s LIKE '$%' THEN 'USD' WHEN s LIKE '%triệu' OR s LIKE '%VND' THEN 'VND' END"
    return f"{low} AS salary_min, {high} AS salary_max, {cur} AS currency".replace("(s, ", f"({s}, ").replace("WHEN s LIKE", f"WHEN {s} LIKE").replace("AND s LIKE", f"AND {s} LIKE").replace("OR s LIKE", f"OR {s} LIKE")


_EXP = {"3+ years": (3.0, None), "6 tháng - 1 năm": (0.5, 1.0), "2 - 4 years": (2.0, 4.0), "no experience required": (0.0, None), "18 months": (1.5, None), "under 1 year": (0.0, 1.0)}
_case = lambda x, pairs: f"CASE {x} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in pairs.items() if v is not None) + " END"
_LOW, _HIGH = (_case("experience_text", {k: v[i] for k, v in _EXP.items()}) for i in (0, 1))
_LEVEL = "CASE WHEN lower(title) LIKE 'head of%' THEN 'HEAD' WHEN lower(title) LIKE '%store manager%' THEN 'MANAGER' WHEN lower(title) LIKE 'team lead%' THEN 'LEAD' WHEN lower(title) LIKE 'senior%' THEN 'SENIOR' WHEN lower(title) LIKE 'junior%' THEN 'JUNIOR' WHEN lower(title) LIKE 'intern %' THEN 'INTERN' ELSE 'UNKNOWN' END"
_YEARS = f"CASE WHEN {_LOW} IS NULL AND {_HIGH} IS NULL THEN 'UNKNOWN' WHEN coalesce({_LOW}, {_HIGH}) < 0.5 THEN 'ENTRY_LEVEL' WHEN coalesce({_LOW}, {_HIGH}) < 2 THEN 'JUNIOR' WHEN coalesce({_LOW}, {_HIGH}) < 5 THEN 'MID' ELSE 'SENIOR' END"
_RESOLVED = f"coalesce(nullif({_LEVEL}, 'UNKNOWN'), {_YEARS})"
_TYPE = "CASE WHEN job_type_text = 'Full-time' THEN 'FULL_TIME' WHEN job_type_text = 'Thực tập' THEN 'INTERNSHIP' WHEN job_type_text = 'contract' THEN 'CONTRACT' WHEN title LIKE 'Intern %' THEN 'INTERNSHIP' ELSE 'UNKNOWN' END"
_DAY = "date_trunc('day', collected_at + INTERVAL 7 HOUR)"
_ml = lambda x: f"nullif(trim(regexp_replace({x}, '\\s+', ' ', 'g')), '')"


def _hash(fields) -> str:
    return "sha256(" + " || chr(10) || ".join(f"'{f}=' || coalesce(length({_ml(f)}), -1) || ':' || coalesce({_ml(f)}, '')" for f in fields) + ")"


_SKILLS = taxonomy.values(taxonomy.SKILLS, "k(alias, canonical, category)")
_PLACES = taxonomy.values(taxonomy.LOCATIONS, "k(alias, canonical, kind)")
_ORD = "(collected_at, l_orderkey, l_linenumber)"
_LAST = "ROW_NUMBER() OVER (PARTITION BY fingerprint ORDER BY collected_at DESC, l_orderkey DESC, l_linenumber DESC)"
_STORED = f"h AS (SELECT *, {_hash(('title', 'salary_text', 'posted_text'))} AS digest FROM obs), new AS (SELECT * FROM (SELECT *, {_LAST} AS r FROM h) WHERE r = 1), old AS (SELECT * FROM (SELECT *, {_LAST} AS r FROM h WHERE l_orderkey % 3 = 0) WHERE r = 1)"
_ACTION = "act AS (SELECT new.fingerprint, CASE WHEN old.fingerprint IS NULL THEN 'CREATED' WHEN old.digest IS DISTINCT FROM new.digest THEN 'UPDATED' ELSE 'UNCHANGED' END AS action FROM new LEFT JOIN old ON old.fingerprint = new.fingerprint)"
_UP = f"up AS (SELECT l.*, a.first_seen_at, a.last_seen_at, a.sightings, a.first_seen_at + INTERVAL 30 DAY AS expires_at FROM (SELECT * FROM (SELECT *, {_LAST} AS r FROM obs) WHERE r = 1) l JOIN (SELECT fingerprint, min(collected_at) AS first_seen_at, max(collected_at) AS last_seen_at, count(*) AS sightings FROM obs GROUP BY fingerprint) a ON a.fingerprint = l.fingerprint)"
_W = f"WITH {base.OBS}"


ORACLES = {
    "a1_read_raw_observations": f"{_W} SELECT source_job_id, detail_url, title, l_orderkey, l_linenumber FROM obs WHERE source_code = 'ALPHA'",
    "a2_load_taxonomy": f"SELECT {base.compact('alias')} AS alias_key, count(DISTINCT canonical) AS n FROM (SELECT p_name AS alias, p_type AS canonical FROM part UNION ALL SELECT alias, canonical FROM {_SKILLS} UNION ALL SELECT alias, canonical FROM {_PLACES}) GROUP BY 1 HAVING count(DISTINCT canonical) > 1",
    "a3_write_keyed": f"{_W} SELECT fingerprint, title, collected_at, l_orderkey, l_linenumber FROM (SELECT *, {_LAST} AS r FROM obs) WHERE r = 1",
    "a4_read_pages": "SELECT page_id, url, CAST(length(html) AS INTEGER) AS n_chars FROM pages",
    "d1_normalize_salary": f"{_W} SELECT salary_text, count(*) AS count, {_salary('salary_text')} FROM obs GROUP BY salary_text",
    "d2_parse_number_token": "SELECT p_partkey, format('{:,.2f}', p_retailprice) AS token, CAST(format('{:.2f}', p_retailprice) AS DOUBLE) AS value FROM part",
    "d3_normalize_experience": f"{_W} SELECT experience_text, count(*) AS count, CAST({_LOW} AS DOUBLE) AS experience_min, CAST({_HIGH} AS DOUBLE) AS experience_max FROM obs GROUP BY experience_text",
    "d4_normalize_skill_list": f"""{_W}, k AS (SELECT {base.compact('alias')} AS k, min(canonical) AS canonical FROM {_SKILLS} GROUP BY 1),
p AS (SELECT skills_text, unnest(l) AS raw, generate_subscripts(l, 1) AS pos FROM (SELECT DISTINCT skills_text, list_transform(regexp_split_to_array(skills_text, '[,;|\n]'), lambda x: trim(x)) AS l FROM obs)),
n AS (SELECT skills_text, pos, coalesce(canonical, raw) AS v FROM p LEFT JOIN k ON k.k = {base.compact('raw')}),
f AS (SELECT skills_text, min(pos) AS pos, min_by(v, pos) AS v FROM n GROUP BY skills_text, {base.fold('v')})
SELECT skills_text, string_agg(v, '|' ORDER BY pos) AS skills FROM f GROUP BY skills_text""",
    "d5_extract_skills_from_prose": f"""SELECT DISTINCT p_partkey, canonical FROM part JOIN {_SKILLS} ON length(alias) > 2 AND alias NOT IN ({", ".join(f"'{a}'" for a in taxonomy.AMBIGUOUS)}) AND contains(' ' || {base.fold("p_name || ' ' || p_type")} || ' ', ' ' || alias || ' ')""",
    "d6_merge_skills": f"""WITH r AS (SELECT p_partkey, p_name, CASE WHEN p_size % 2 = 0 THEN [trim(p_type), trim(p_brand)] ELSE [trim(p_type)] END AS raw FROM part),
f AS (SELECT p_partkey, string_agg(DISTINCT canonical, '|' ORDER BY canonical) AS found FROM r JOIN {_SKILLS} ON length(alias) > 2 AND alias NOT IN ({", ".join(f"'{a}'" for a in taxonomy.AMBIGUOUS)}) AND contains(' ' || {base.fold("p_name")} || ' ', ' ' || alias || ' ') WHERE len(raw) < 2 AND {base.fold('canonical')} <> {base.fold('raw[1]')} GROUP BY p_partkey)
SELECT r.p_partkey, array_to_string(raw, '|') || coalesce('|' || found, '') AS skills FROM r LEFT JOIN f ON f.p_partkey = r.p_partkey""",
    "d7_normalize_locations": f"""{_W}, k AS (SELECT {base.compact('alias')} AS k, min(canonical) AS canonical FROM {_PLACES} GROUP BY 1),
p AS (SELECT location_text, unnest(l) AS raw, generate_subscripts(l, 1) AS pos FROM (SELECT DISTINCT location_text, list_filter(list_transform(regexp_split_to_array(location_text, '[,;|/\n]'), lambda x: trim(x)), lambda x: x <> '') AS l FROM obs)),
n AS (SELECT location_text, pos, CASE WHEN {base.compact('raw')} = 'dn' THEN raw ELSE coalesce(canonical, raw) END AS v FROM p LEFT JOIN k ON k.k = {base.compact('raw')} WHERE {base.compact('raw')} NOT IN ('remote', 'wfh', 'workfromhome', 'na', 'hybrid')),
f AS (SELECT location_text, min(pos) AS pos, min_by(v, pos) AS v FROM n GROUP BY location_text, {base.fold('v')})
SELECT o.location_text, coalesce(string_agg(v, '|' ORDER BY pos), '') AS locations FROM (SELECT DISTINCT location_text FROM obs) o LEFT JOIN f ON f.location_text = o.location_text GROUP BY o.location_text""",
    "d8_classify_seniority": f"{_W} SELECT DISTINCT title, {_LEVEL} AS level FROM obs",
    "d9_resolve_seniority": f"{_W} SELECT title, experience_text, count(*) AS count, {_RESOLVED} AS seniority FROM obs GROUP BY title, experience_text",
    "d10_classify_job_type": f"{_W} SELECT title, job_type_text, count(*) AS count, {_TYPE} AS job_type FROM obs GROUP BY title, job_type_text",
    "d11_normalize_posted_at": f"{_W} SELECT posted_text, collected_at, count(*) AS count, CASE WHEN posted_text = '2 days ago' THEN {_DAY} - INTERVAL 55 HOUR WHEN posted_text = 'hôm qua' THEN {_DAY} - INTERVAL 31 HOUR WHEN posted_text = '3 hours ago' THEN collected_at - INTERVAL 3 HOUR WHEN posted_text <> 'soon' THEN CAST(posted_text AS TIMESTAMP) - INTERVAL 7 HOUR END AS posted_at FROM obs GROUP BY posted_text, collected_at",
    "d12_normalize_deadline_at": f"{_W} SELECT deadline_text, collected_at, count(*) AS count, {_DAY} + CASE deadline_text WHEN 'in 3 days' THEN INTERVAL 4 DAY WHEN 'còn 5 ngày nữa' THEN INTERVAL 6 DAY WHEN 'tomorrow' THEN INTERVAL 2 DAY END - INTERVAL 7 HOUR - INTERVAL 1 MICROSECOND AS deadline_at FROM obs GROUP BY deadline_text, collected_at",
    "d13_normalize_apply": f"{_W} SELECT DISTINCT detail_url, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN 'mailto:jobs@mail.example.com' WHEN 1 THEN regexp_extract(detail_url, '^https?://[^/]+') || '/apply' WHEN 2 THEN detail_url ELSE 'https://apply.example.org/x' END AS apply_url, CASE l_linenumber % 4 WHEN 0 THEN 'EMAIL' WHEN 1 THEN 'APPLY_BUTTON' WHEN 2 THEN 'DETAIL_PAGE' ELSE 'EXTERNAL' END AS apply_type FROM obs",
    "d14_content_hash": f"{_W} SELECT l_orderkey, l_linenumber, detail_url, collected_at, {_hash(_HASHED)} AS content_hash FROM obs",
    # Fields are far shorter than 2,400 characters together; a test cuts longer ones.
    "d15_job_text_query_whole": f"{_W} SELECT DISTINCT title, company_name, skills_text, experience_text, v AS value FROM (SELECT *, 'query: ' || concat_ws(chr(10), 'Title: ' || nullif(title, ''), 'Company: ' || nullif(company_name, ''), 'Skills: ' || nullif(skills_text, ''), 'Experience: ' || nullif(experience_text, '')) AS v FROM obs)",
    "d16_job_text_passage_whole": f"{_W} SELECT DISTINCT title, company_name, skills_text, experience_text, CASE WHEN length(v) > 2400 THEN rtrim(substring(v, 1, 2399)) || '…' ELSE v END AS value FROM (SELECT *, 'passage: ' || concat_ws(chr(10), 'Title: ' || title, 'Company: ' || company_name, 'Skills: ' || skills_text, 'Experience: ' || experience_text) AS v FROM obs)",
    "d17_format_experience": f"{_W} SELECT DISTINCT experience_text, {_case('experience_text', dict(zip(_EXP, ("'From 3 years'", "'0.5 - 1 years'", "'2 - 4 years'", "'From 0 years'", "'From 1.5 years'", "'0 - 1 years'"))))} AS value FROM obs",
    "d18_join_stable": f"{_W}, p AS (SELECT skills_text, trim(unnest(regexp_split_to_array(skills_text, '[,;]'))) AS v FROM (SELECT DISTINCT skills_text FROM obs)), f AS (SELECT skills_text, {base.fold('v')} AS f, min(v) AS v FROM p GROUP BY 1, 2) SELECT skills_text, string_agg(v, ', ' ORDER BY f, v) AS value FROM f GROUP BY skills_text",
    "d19_normalize_jobs": f"{_W} SELECT fingerprint, l_orderkey, l_linenumber, collected_at, {_salary('salary_text')}, CAST({_LOW} AS DOUBLE) AS experience_min, CAST({_HIGH} AS DOUBLE) AS experience_max, {_RESOLVED} AS seniority, {_TYPE} AS job_type FROM obs",
    "d19_normalize_jobs_whole": "",
    "e1_fingerprint": f"{_W} SELECT l_orderkey, l_linenumber, collected_at, fingerprint FROM obs",
    "e2_upsert_seen": f"{_W}, {_UP} SELECT fingerprint, title, salary_text, posted_text, first_seen_at, last_seen_at, expires_at, sightings FROM up",
    "e3_expire_raw": f"{_W}, {_UP} SELECT fingerprint, expires_at FROM up WHERE expires_at > TIMESTAMP '1998-01-01'",
    "e4_purge_payload": f"{_W}, {_STORED} SELECT new.fingerprint, CASE WHEN old.fingerprint IS NULL THEN new.digest END AS raw_html, old.fingerprint IS NOT NULL AS purged FROM new LEFT JOIN old ON old.fingerprint = new.fingerprint",
    "e5_normalization_action": f"{_W}, {_STORED}, {_ACTION} SELECT * FROM act",
    "e6_changed_feed": f"{_W}, {_STORED}, {_ACTION} SELECT * FROM act WHERE action <> 'UNCHANGED'",
    "e7_renormalization_report": f"""{_W}, {_STORED}, {_ACTION}, p AS (SELECT *, (ROW_NUMBER() OVER (ORDER BY fingerprint) - 1) // 500 AS page FROM act), g AS (SELECT page, count(*) AS processed, count(*) FILTER (WHERE action = 'CREATED') AS created, count(*) FILTER (WHERE action = 'UPDATED') AS updated, count(*) FILTER (WHERE action = 'UNCHANGED') AS unchanged, CAST(0 AS BIGINT) AS failed FROM p GROUP BY page)
SELECT *, CAST(sum(processed) OVER () AS BIGINT) AS total, max(page) OVER () + 1 AS pages, CASE WHEN page < max(page) OVER () THEN page + 1 END AS next_page FROM g""",
    "e8_embedding_work_queue": "SELECT p_partkey AS job_id, CASE WHEN p_partkey % 5 = 0 OR p_partkey % 4 = 1 THEN 'PROCESS' WHEN p_partkey % 3 <> 0 AND p_partkey IN (SELECT vec_id FROM embeddings) THEN 'SKIP_READY' WHEN p_partkey % 3 = 0 AND p_partkey % 2 = 0 THEN 'SKIP_LEASED' ELSE 'PROCESS' END AS decision FROM part",
    "e9_latest_per_key": f"{_W} SELECT detail_url, title, salary_text, collected_at, l_orderkey, l_linenumber FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY detail_url ORDER BY collected_at DESC, l_orderkey DESC, l_linenumber DESC) AS r FROM obs) WHERE r = 1",
    "e10_pipeline_reconciliation": f"""{_W}, {_STORED}, emb AS (SELECT fingerprint FROM new WHERE ascii(digest[1]) % 2 = 0), g AS (SELECT 'raw_without_normalized' AS stage FROM new ANTI JOIN old USING (fingerprint) UNION ALL SELECT 'normalized_without_embedding' FROM old ANTI JOIN emb USING (fingerprint) UNION ALL SELECT 'embedding_without_job' FROM emb ANTI JOIN old USING (fingerprint))
SELECT stage, count(*) AS missing FROM g GROUP BY stage""",
    "e11_status_transition_audit": "SELECT before, after, count(*) AS n FROM (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, event_type AS after FROM events) WHERE before <> after AND (before, after) NOT IN (('view', 'click'), ('click', 'purchase'), ('signup', 'view')) GROUP BY ALL",
    "e12_duplicate_content_report": "SELECT sha256(coalesce(text, '')) AS digest, count(*) AS n, min(doc_id) AS survivor FROM documents GROUP BY 1 HAVING count(*) > 1",
    "e13_version_coverage": f"{_W} SELECT source_code, v AS normalization_version, count(*) AS n, CAST(grouping_id(source_code, v) AS BIGINT) AS level FROM (SELECT source_code, 'rule-v2' AS v FROM obs) GROUP BY ROLLUP (source_code, v)",
    "flagship_live_postings": f"{_W}, {_UP}, l AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY source_code ORDER BY last_seen_at DESC, fingerprint) AS rank FROM up WHERE expires_at > TIMESTAMP '1998-01-01') SELECT source_code, CAST(rank AS INTEGER) AS rank, fingerprint, title, {_salary('salary_text')}, {_RESOLVED} AS seniority, {_TYPE} AS job_type, last_seen_at FROM l WHERE rank <= 20",
}


def _whole_jobs() -> str:
    """The SQL of the parts over the newest sightings with further fields."""
    part = lambda k: "(WITH " + ORACLES[k].removeprefix(_W + ", ").replace("FROM obs)", "FROM rich)") + ")"
    skills, places = part("d4_normalize_skill_list"), part("d7_normalize_locations")
    years = "CASE WHEN lo = hi THEN lo_t || ' years' WHEN lo IS NOT NULL AND hi IS NOT NULL THEN lo_t || ' - ' || hi_t || ' years' WHEN lo IS NOT NULL THEN 'From ' || lo_t || ' years' WHEN hi IS NOT NULL THEN 'Up to ' || hi_t || ' years' END"
    text = lambda x: rf"regexp_replace(regexp_replace(CAST(CAST({x} AS DECIMAL(10,2)) AS VARCHAR), '0+$', ''), '\.$', '')"
    name = lambda x: f"{x}[1] || lower(replace({x}[2:], '_', ' '))"
    stable = lambda x: f"nullif(array_to_string(list_transform(list_sort(list_transform(list_filter(string_split({x}, '|'), lambda v: v <> ''), lambda v: {{'f': {base.fold('v')}, 'v': v}})), lambda p: p.v), ', '), '')"
    needed, pay = "CASE WHEN requirements_text IS NOT NULL THEN 'Must know ' || title || ' and sql server' || chr(10) || '- C++ a plus' END", "CASE WHEN benefits_text IS NOT NULL THEN 'Lunch' || chr(10) || '13th month pay' END"
    shown = f"""concat_ws(chr(10), 'Title: ' || title, 'Company: ' || company_name, 'Skills: ' || {stable('skills')}, 'Seniority: ' || {name("nullif(seniority, 'UNKNOWN')")}, 'Experience: ' || years, 'Locations: ' || {stable('locations')}, 'Job type: ' || {name("nullif(job_type, 'UNKNOWN')")}, 'Requirements: ' || {needed}, 'Description: ' || description_text, 'Benefits: ' || {pay})"""
    line = lambda n, v: f"'{n}=' || coalesce(length({v}), -1) || ':' || coalesce({v}, '')"
    inline = [line(n, _ml(n)) for n in jobs.HASHED_INLINE]
    listed = "nullif(array_to_string(list_transform(list_filter(list_transform(regexp_split_to_array(skills_text, '[,;|\n]'), lambda x: trim(x)), lambda x: x <> ''), lambda x, i: 'skills[' || (i - 1) || ']=' || length(x) || ':' || x), chr(10)), '')"
    rest = [line("description_text", "description_text"), line("requirements_text", f"({needed})"), line("benefits_text", f"({pay})"), line("detail_url", "detail_url"), line("apply_url", "raw_url"), line("apply_type", "CAST(NULL AS VARCHAR)")]
    times = {k: ORACLES[q].split("count(*) AS count, ")[1].split(f" AS {k} FROM")[0] for k, q in (("posted_at", "d11_normalize_posted_at"), ("deadline_at", "d12_normalize_deadline_at"))}
    aliases = taxonomy.values(tuple((*r, i) for i, r in enumerate(taxonomy.SKILLS)), "k(alias, canonical, category, place)")
    words = f"' ' || trim(regexp_replace(regexp_replace({base.fold('prose')}, '[^a-z0-9+#.]+|\\.( |$)', ' ', 'g'), ' +', ' ', 'g')) || ' '"
    # Each expression sees the feed's own columns, as Spark's do; a later one doesn't see an earlier one's.
    rich = ", ".join(f"{v} AS {k}" for k, v in _RICH.items())
    return f"""{_W}, {_UP}, rich AS (SELECT * EXCLUDE (skills_text, first_), {rich.replace("skills_text", "first_.skills_text").replace("AS first_.skills_text", "AS skills_text")} FROM (SELECT *, {{'skills_text': skills_text}} AS first_ FROM up)),
sk AS (SELECT * FROM {skills}), pl AS (SELECT * FROM {places}),
pr AS (SELECT fingerprint, concat_ws(chr(10), title, requirements_text, description_text) AS prose FROM rich JOIN sk USING (skills_text) WHERE NOT contains(skills, '|')),
fd AS (SELECT fingerprint, string_agg(canonical, '|' ORDER BY place) AS found FROM (SELECT fingerprint, canonical, min(place) AS place FROM (SELECT fingerprint, {words} AS w FROM pr) JOIN {aliases} ON (length(alias) > 2 OR alias IN ({", ".join(f"'{a}'" for a in taxonomy.SHORT)})) AND alias NOT IN ({", ".join(f"'{a}'" for a in taxonomy.AMBIGUOUS)}) AND contains(w, ' ' || alias || ' ') GROUP BY ALL) GROUP BY fingerprint),
mg AS (SELECT fingerprint, CASE WHEN found IS NULL THEN skills WHEN list_contains(string_split({base.fold('found')}, '|'), {base.fold('skills')}) THEN skills || coalesce('|' || nullif(array_to_string(list_filter(string_split(found, '|'), lambda x: {base.fold('x')} <> {base.fold('skills')}), '|'), ''), '') ELSE skills || '|' || found END AS skills FROM rich JOIN sk USING (skills_text) LEFT JOIN fd USING (fingerprint)),
n AS (SELECT rich.* EXCLUDE (apply_url), rich.apply_url AS raw_url, {_salary('salary_text')}, CAST({_LOW} AS DOUBLE) AS lo, CAST({_HIGH} AS DOUBLE) AS hi, CASE seniority_text WHEN 'Senior level' THEN 'SENIOR' WHEN 'Fresher' THEN 'FRESHER' ELSE {_RESOLVED} END AS seniority, {_TYPE} AS job_type, {times["posted_at"]} AS posted_at, {times["deadline_at"]} AS deadline_at, mg.skills, pl.locations
  FROM rich LEFT JOIN mg ON mg.fingerprint = rich.fingerprint LEFT JOIN pl ON pl.location_text = rich.location_text),
t AS (SELECT *, {text('lo')} AS lo_t, {text('hi')} AS hi_t FROM n), y AS (SELECT *, {years} AS years FROM t)
SELECT fingerprint, salary_min, salary_max, currency, lo AS experience_min, hi AS experience_max, seniority, job_type, posted_at, deadline_at, skills, locations, coalesce(raw_url, detail_url) AS apply_url, CASE WHEN raw_url IS NULL THEN 'DETAIL_PAGE' ELSE 'EMAIL' END AS apply_type,
  sha256(concat_ws(chr(10), {", ".join([*inline, listed, *rest])})) AS content_hash, 'query: ' || {shown} AS query, 'passage: ' || {shown} AS passage, 'rule-v2' AS normalization_version FROM y"""


ORACLES["d19_normalize_jobs_whole"] = _whole_jobs()
ORACLES |= {k: ORACLES[f"{k}_whole"] for k in ("d15_job_text_query", "d16_job_text_passage")}
ORACLES["a3_write_keyed_table"] = ORACLES["a3_write_keyed"]
ORACLES["a1_pruned_reads"] = f"{_W} SELECT source_code, strftime(collected_at, '%Y') AS period, source_job_id, detail_url, title, l_orderkey, l_linenumber FROM obs WHERE source_code IN ('ALPHA', 'DELTA') AND year(collected_at) >= 1995 AND year(collected_at) IN (SELECT year(o_orderdate) FROM orders WHERE o_orderdate < DATE '1996-01-01')"

_BROKEN = """raw AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 90 <> 5 THEN lpad(CAST(p_partkey AS VARCHAR), 8, '0') END AS raw_id, p_partkey % 60 <> 1 AS timed, p_partkey % 40 IN (7, 8) AS far, p_partkey % 50 IN (3, 4) AS gone FROM part),
act AS (SELECT *, CASE WHEN raw_id IS NULL OR k % 3 = 0 THEN 'CREATED' WHEN k % 3 = 1 THEN 'UNCHANGED' ELSE 'UPDATED' END AS action, raw_id IS NULL OR NOT timed OR far OR gone AS failed FROM raw)"""
ORACLES["e7_renormalization_failures"] = f"""WITH {_BROKEN}, p AS (SELECT *, (ROW_NUMBER() OVER (ORDER BY k) - 1) // 500 AS page FROM act),
g AS (SELECT page, count(*) AS processed, count(*) FILTER (WHERE action = 'CREATED' AND NOT failed) AS created, count(*) FILTER (WHERE action = 'UPDATED' AND NOT failed) AS updated, count(*) FILTER (WHERE action = 'UNCHANGED' AND NOT failed) AS unchanged, count(*) FILTER (WHERE failed) AS failed FROM p GROUP BY page)
SELECT *, CAST(sum(processed) OVER () AS BIGINT) AS total, max(page) OVER () + 1 AS pages, CASE WHEN page < max(page) OVER () THEN page + 1 END AS next_page FROM g"""
ORACLES["e7_quarantine"] = f"""WITH {_BROKEN}
SELECT k AS p_partkey, field, reason, NULL::BIGINT AS salary_min, NULL::BIGINT AS salary_max, NULL::TIMESTAMP AS posted_at FROM (SELECT k, 'raw_id' AS field, 'BLANK' AS reason FROM act WHERE raw_id IS NULL UNION ALL SELECT k, 'collected_at', 'NO_TIME' FROM act WHERE NOT timed UNION ALL SELECT k, 'salary_text', 'OUT_OF_RANGE' FROM act WHERE far UNION ALL SELECT k, 'posted_text', 'OUT_OF_RANGE' FROM act WHERE gone)
UNION ALL SELECT k, NULL, NULL, 1000, 2000, TIMESTAMP '2001-11-29 17:00:00' FROM act WHERE NOT failed"""
