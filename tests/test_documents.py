"""Rules of the document, text and keyed operators that the comparison queries don't reach."""

import unicodedata

from pyspark.sql import functions as F

from vacantia.functions import text as t
from vacantia.operators import docs, jobs, keyed, query, web
from vacantia.sources import taxonomy


def test_unicode_forms(spark):
    raw = ["é ü", "ﬁ ① Ａ", "plain", None, "Tiếng Việt"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, x string")
    got = {r.i: (r.c, r.k) for r in rows.select("i", t.composed(F.col("x")).alias("c"), t.composed(F.col("x"), "NFKC").alias("k")).collect()}
    assert got == {i: (x and unicodedata.normalize("NFC", x), x and unicodedata.normalize("NFKC", x)) for i, x in enumerate(raw)}
    row = spark.createDataFrame([("a\x00b\x07 Ａ\r\n• x", "Straße ΣΑΣ")], "d string, m string").select(t.norm_document(t.composed(F.col("d"), "NFKC"))[0].alias("d"), t.norm_match(F.col("m")).alias("m")).first()
    assert row.d == "ab A\n- x" and row.m == "Straße ΣΑΣ".casefold()


def test_long_aliases_and_repeats(spark):
    rows = spark.createDataFrame([(1, "we use one two three four five six seven daily, then One Two Three four five six seven"), (2, None), (3, "")], "k long, text string")
    aliases = spark.createDataFrame([("one two three four five six seven", "Long"), ("two three", "Short")], "alias string, canonical string")
    got = sorted((r.k, r.at, r.n, r.canonical) for r in jobs.phrase_hits(rows, aliases, "k", "text").collect())
    assert got == [(1, 2, 7, "Long"), (1, 3, 2, "Short"), (1, 11, 7, "Long"), (1, 12, 2, "Short")]
    assert jobs.phrase_hits(rows, aliases.limit(0), "k", "text").count() == 0


def test_proficiency_needs_whole_words_and_looks_at_all_places(spark):
    rows = spark.createDataFrame([(1, "javascript (advanced), sql"), (2, "Java here; later\nJava: expert level, SQL - basic"), (3, "java, other (advanced)")], "doc_id long, text string")
    got = sorted(map(tuple, docs.skill_proficiency(rows, taxonomy.skills(spark)).collect()))
    assert got == [(1, "JavaScript", "ADVANCED"), (2, "Java", "EXPERT"), (2, "SQL", "BASIC")]


def test_short_aliases_from_the_list_count_in_prose(spark):
    rows = spark.createDataFrame([(1, "c# and js and r")], "k long, text string")
    aliases = spark.createDataFrame([("c#", "C#"), ("js", "JavaScript"), ("xy", "XY")], "alias string, canonical string")
    assert [r.canonical for r in jobs.prose_skills(rows, "k", "text", aliases).collect()] == ["C#"]


def test_languages(spark):
    vi = "Kinh nghiệm làm việc tại công ty với khách hàng và quản lý trong năm nay"
    en = "the work experience of the company and the training for the project in summary"
    rows = spark.createDataFrame([(0, vi), (1, en), (2, vi + " " + en), (3, "the and"), (4, None), (5, "zzz " * 20)], "i int, x string")
    assert {r.i: r.v for r in rows.select("i", docs.detect_language(F.col("x")).alias("v")).collect()} == {0: "vi", 1: "en", 2: "MIXED", 3: "UNKNOWN", 4: "UNKNOWN", 5: "UNKNOWN"}


def test_profile_text_and_recents(spark):
    row = spark.createDataFrame([("Engineer", "s" * 600, ["b", "A", "a", "đ"], ["job one", "j" * 500, "three", "four"], [], ["c1"])], "h string, s string, k array<string>, j array<string>, p array<string>, z array<string>")
    text = row.select(docs.profile_text({"headline": "h", "summary": "s", "skills": "k", "jobs": "j", "projects": "p", "certificates": "z"}).alias("v")).first().v
    parts = dict(x.split(": ", 1) for x in text.removeprefix("query: ").split("\n"))
    assert parts["Skills"] == "A, b, đ" and parts["Experience"] == "job one; " + "j" * 449 + "…; three" and len(parts["Summary"]) == 500 and "Projects" not in parts
    ranked = spark.createDataFrame([(1, 2, "B"), (1, 1, "A"), (1, 3, "a"), (1, 4, "C")], "k long, rank int, title string")
    assert docs.recents(ranked, "k", "title", 2).first()["values"] == ["A", "B"]


def test_years_stated_only(spark):
    rows = spark.createDataFrame([(None, "7 years of experience"), (2.0, "7 years of experience"), (None, "none")], "y double, t string")
    assert [tuple(r.v) for r in rows.select(docs.years_of(F.col("y"), F.col("t")).alias("v")).collect()] == [(7.0, "EXPERIENCE_YEARS_STATED_ONLY"), (2.0, None), (None, None)]


def test_levels_are_checked(spark):
    levels = spark.createDataFrame([("A", 30, 0), ("B", 30, 1), ("C", 20, 2), ("UNKNOWN", 5, 3), ("A", 1, 4)], "level string, rank int, place int")
    got = sorted(map(tuple, taxonomy.rank_faults(levels).collect()))
    assert got == [("AFTER_UNKNOWN", "A"), ("NAME_TWICE", "A"), ("NAME_TWICE", "A"), ("NOT_DESCENDING", "B"), ("RANK_TWICE", "A"), ("RANK_TWICE", "B")]
    own = spark.createDataFrame([(lv, r, i) for i, (lv, r, *_) in enumerate(taxonomy.SENIORITY)], "level string, rank int, place int")
    assert taxonomy.rank_faults(own).count() == 0


def test_purge_is_cleared_by_a_new_observation_and_upgrades_are_legal(spark):
    raw = spark.createDataFrame([("a", "x", 5), ("b", "y", 9), ("c", "z", 1)], "k string, html string, seen int")
    done = spark.createDataFrame([("a", 5), ("b", 7)], "k string, seen int")
    got = {r.k: (r.html, r.raw_payload_purged_at) for r in keyed.purge_payload(raw, done, "k", ("html",), F.lit(3), "seen").collect()}
    assert got == {"a": (None, 3), "b": ("y", None), "c": ("z", None)}
    events = spark.createDataFrame([(1, "PARSED", 1, 1), (1, "PARSING", 2, 2), (2, "PARSED", 1, 1), (2, "PARSING", 2, 1), (3, "PARSED", 1, 1), (3, "FAILED", 2, 2)], "id int, status string, at int, version int")
    assert sorted(map(tuple, keyed.transition_audit(events, "id", "status", ["at"], version="version").collect())) == [("PARSED", "FAILED", 1), ("PARSED", "PARSING", 1)]


def test_tables_are_written_by_key(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(list(x), "k int, at int, v string")
    for part in (rows((1, 1, "a"), (2, 1, "b")), rows((1, 2, "c"), (2, 0, "old")), rows((3, 1, "d"))):
        out = keyed.write_table(f"file://{tmp_path}/t", part, ["k"], ["at"])
    assert sorted((r.k, r.v) for r in out.collect()) == [(1, "c"), (2, "b"), (3, "d")]
    assert len(list((tmp_path / "t").iterdir())) == 2


def test_hosts_and_codes(spark):
    links = spark.createDataFrame([("https://example.com/en/1?x",), ("https://a.example.com/en/2",), ("https://notexample.com/en/3",)], "link string")
    assert [r.link for r in web.match_source_links(links, taxonomy.sources(spark)).collect()] == ["https://example.com/en/1"]
    assert web.match_source_links(links, taxonomy.sources(spark), subdomains=True).count() == 2
    rows = spark.createDataFrame([("ALPHA", 1), ("BRAVO", 2)], "source_code string, v int")
    assert [r.v for r in query.list_page(rows, {"source_code": " alpha "}, [F.col("v")]).collect()] == [1]
    assert query.latest_by_key(rows, "source_code", "NONE", [F.col("v")]).count() == 0


def test_whole_jobs_take_skills_of_the_title_where_the_list_is_poor(spark):
    import datetime

    base = {"source_code": "A", "source_job_id": "1", "detail_url": "https://x.example/1", "company_name": "Co", "salary_text": "10 - 20 triệu", "experience_text": "2 - 4 years", "location_text": "Saigon, remote", "job_type_text": None, "posted_text": "today", "deadline_text": None, "collected_at": datetime.datetime(2024, 1, 2)}
    rows = [base | {"fingerprint": "p", "title": "Python developer", "skills_text": "SQL", "apply_url": "mailto:a@b.example"}, base | {"fingerprint": "r", "title": "Python developer", "skills_text": "sql, js", "apply_url": None}, base | {"fingerprint": "n", "title": None, "skills_text": None, "apply_url": None, "salary_text": None, "experience_text": None, "location_text": None}]
    schema = ", ".join(f"{k} {'timestamp' if k == 'collected_at' else 'string'}" for k in rows[0])
    got = {r.fingerprint: r for r in jobs.normalize_jobs(spark.createDataFrame([tuple(r[k] for k in rows[0]) for r in rows], schema), "fingerprint", taxonomy.skills(spark), taxonomy.locations(spark)).collect()}
    assert got["p"].skills == ["SQL", "Python"] and got["r"].skills == ["SQL", "JavaScript"] and got["n"].skills == [] == got["n"].locations
    assert (got["p"].apply_type, got["r"].apply_type) == ("EMAIL", "DETAIL_PAGE") and got["p"].locations == ["Hồ Chí Minh"]
    assert len({r.content_hash for r in got.values()}) == 3 and got["p"].passage.startswith("passage: Title: Python developer\nCompany: Co\nSkills: Python, SQL\nSeniority: Mid\nExperience: 2 - 4 years")


def _raw(spark, **changes):
    """One raw job for each change of a whole one."""
    import datetime

    one = {"fingerprint": "f", "source_code": "A", "source_job_id": "1", "detail_url": "https://x.example/1", "title": "Builder", "company_name": "Co", "salary_text": "10 - 20 triệu", "experience_text": "2 - 4 years", "location_text": "Saigon", "job_type_text": "full time", "posted_text": "today", "deadline_text": "in 3 days", "skills_text": "SQL", "seniority_text": None, "requirements_text": None, "description_text": None, "benefits_text": None, "apply_url": None, "apply_type": None, "collected_at": datetime.datetime(2024, 1, 2)}
    rows = [one | {"fingerprint": k} | v for k, v in changes.items()]
    return spark.createDataFrame([tuple(r[k] for k in one) for r in rows], ", ".join(f"{k} {'timestamp' if k == 'collected_at' else 'string'}" for k in one))


def test_the_hash_covers_every_raw_field(spark):
    fields = (*jobs.HASHED_INLINE, *jobs.HASHED_MULTILINE, *jobs.HASHED_LAST)
    assert len(fields) + 1 == 16
    changes = {"same": {}, "blanks": {"title": "  Builder ​"}} | {k: {k: "other"} for k in (*fields, "skills_text")} | {f"null_{k}": {k: None} for k in ("title", "benefits_text")}
    got = {r.fingerprint: r.content_hash for r in jobs.normalize_jobs(_raw(spark, **changes), "fingerprint", taxonomy.skills(spark), taxonomy.locations(spark)).select("fingerprint", "content_hash").collect()}
    assert got["same"] == got["blanks"] == got["null_benefits_text"] and len(set(got.values())) == 1 + 16 + 1


def test_sections_levels_and_skills_of_whole_jobs(spark):
    raw = _raw(
        spark,
        all={"title": "Head of things", "seniority_text": "senior", "requirements_text": "Python,\n\n\n sql server ", "description_text": "C++ and python", "benefits_text": " Lunch"},
        long={"requirements_text": "x" * 3000, "skills_text": None},
        none={k: None for k in ("title", "company_name", "salary_text", "experience_text", "location_text", "job_type_text", "skills_text")},
    )
    got = {r.fingerprint: r for r in jobs.normalize_jobs(raw, "fingerprint", taxonomy.skills(spark, placed=True), taxonomy.locations(spark)).collect()}
    assert got["all"].seniority == "SENIOR" and got["all"].skills == ["SQL", "SQL Server", "Python", "C++"]  # listed ones first, then as the taxonomy has them
    assert got["all"].passage == "passage: Title: Head of things\nCompany: Co\nSkills: C++, Python, SQL, SQL Server\nSeniority: Senior\nExperience: 2 - 4 years\nLocations: Hồ Chí Minh\nJob type: Full time\nRequirements: Python,\n\nsql server\nDescription: C++ and python\nBenefits: Lunch"
    assert len(got["long"].passage) == 2400 and got["long"].passage.endswith("x…")
    assert got["none"].passage is None and got["none"].query is None and got["none"].skills == []


def test_rows_that_break_are_set_aside_and_the_others_go_on(spark, tmp_path):
    raw = _raw(spark, ok={}, salary={"salary_text": "9" * 30 + " tỷ"}, far={"posted_text": "999999999 weeks ago", "deadline_text": "in 99999999999 days"}, grouped={"salary_text": "1.000.000.000.000.000.000 triệu"}, time={"collected_at": None}, blank={"fingerprint": " "})
    rows = jobs.checked(jobs.normalized(raw), "fingerprint")
    good, bad = jobs.quarantine(rows, f"file://{tmp_path}/aside")
    assert [(r.fingerprint, r.salary_min) for r in good.collect()] == [("ok", 10_000_000)]
    kept = {r.fingerprint: r.error for r in spark.read.parquet(f"file://{tmp_path}/aside").collect()}
    assert kept == {"salary": "salary_text: OUT_OF_RANGE", "far": "posted_text: OUT_OF_RANGE; deadline_text: OUT_OF_RANGE", "grouped": "salary_text: OUT_OF_RANGE", "time": "collected_at: NO_TIME", " ": "fingerprint: BLANK"}
    assert bad.count() == 5 and {r.fingerprint for r in rows.filter("posted_at IS NULL").collect()} == {"far", "time"}
    report = keyed.renormalization_report(keyed.normalization_action(rows.withColumn("d", F.lit("x")), rows.limit(0).withColumn("d", F.lit("x")), ["fingerprint"], "d"), "fingerprint", 4).collect()
    assert sorted((r.page, r.processed, r.created, r.failed) for r in report) == [(0, 4, 1, 3), (1, 2, 0, 2)]
