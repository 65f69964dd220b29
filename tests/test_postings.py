"""Texts that sources show again are worked on once."""

from pyspark.sql import functions as F

from vacantia.operators import jobs
from vacantia.sources import taxonomy


def test_a_posting_seen_at_several_places_is_searched_once(spark, monkeypatch):
    searched, search = [], jobs.prose_skills
    monkeypatch.setattr(jobs, "prose_skills", lambda rows, *a: searched.append(rows.count()) or search(rows, *a))
    shown = dict(salary_text="1000 - 2000 USD", experience_text="2 - 4 years", title="Senior Small Ring", job_type_text="Full-time", company_name=" A  b", skills_text=None, posted_text="hôm qua", deadline_text=None, collected_at="2001-12-01 00:00:00", source_code="S")
    seen = [{**shown, "raw_id": str(i), "location_text": place, "detail_url": f"https://x.example.com/{i}", "source_job_id": str(i)} for i, place in enumerate(["DN", "TP.HCM", None, "TP.HCM"])]
    seen.append({**seen[0], "raw_id": "4", "title": None, "company_name": "", "salary_text": "2:1"})
    kinds = ", ".join(f"{k} string" for k in seen[0])
    raw = spark.createDataFrame([tuple(r.values()) for r in seen], kinds).withColumn("collected_at", F.col("collected_at").cast("timestamp"))
    out = jobs.normalize_jobs(raw, "raw_id", taxonomy.skills(spark, placed=True), taxonomy.locations(spark))
    got = {r.raw_id: r for r in out.collect()}
    assert searched == [2] and set(raw.columns) < set(out.columns) and not any(c.startswith("_") for c in out.columns)
    assert [list(got[k].skills) for k in "01234"] == [["Small Ring", "Ring"]] * 4 + [[]]
    assert [list(got[k].locations) for k in "0123"] == [["DN"], ["Hồ Chí Minh"], [], ["Hồ Chí Minh"]]
    assert got["1"].passage == "passage: Title: Senior Small Ring\nCompany: A b\nSkills: Ring, Small Ring\nSeniority: Senior\nExperience: 2 - 4 years\nLocations: Hồ Chí Minh\nJob type: Full time"
    assert len({got[k].content_hash for k in "01234"}) == 5 and got["4"].title is None and got["4"].company_name == ""


def test_sections_that_fit_are_joined_as_they_were_added_one_by_one(spark):
    def added(sections, most):
        text = "query: "
        for k, v in sections:
            left = most - len(text) - len(k) - 3
            if v and left > 1:
                text += ("" if text == "query: " else "\n") + k + ": " + (v if len(v) <= left else v[: left - 1].rstrip() + "…")
        return text

    rows = [(a * n, b * m, c) for n in range(0, 12, 3) for m in range(13) for a, b, c in (("x", "y", "zz"), ("é", "", None), ("", "w ", "u"))]
    q = jobs.text_query({k: (F.col(k), 100) for k in "abc"}, 30)
    got = [r.q for r in spark.createDataFrame(rows, "a string, b string, c string").coalesce(1).select(q.alias("q")).collect()]
    assert got == [added(list(zip("abc", r)), 30) for r in rows]
