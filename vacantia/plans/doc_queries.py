"""F: documents and candidate texts."""

from __future__ import annotations

from pyspark.sql import functions as F


from vacantia.operators import docs
from vacantia.plans import base
from vacantia.sources import feed, taxonomy
from vacantia.sources.shared import spread

c = F.col
documents = lambda spark, d: spread(feed.table(spark, d, "documents").select("doc_id", "text", "lang"))
#: The month at which current work ends: December 2001.
AS_OF = 2001 * 12 + 11


def cv(spark, d):
    return spread(feed.cv_text(spark, d))


def cv_lines(spark, d):
    return docs.lines(cv(spark, d))


def cv_sections(spark, d):
    return docs.sections(cv_lines(spark, d), taxonomy.headings(spark))


def f6(spark, d):
    own = documents(spark, d).select("doc_id", F.concat_ws(" ", "text", F.concat(F.lit("see https://www.github.com/u"), "doc_id", F.lit("/x#top, and www.example.com/a. http://localhost/b"))).alias("text"))
    return docs.links_in_text(own)


def f7(spark, d):
    own = feed.table(spark, d, "customer").join(feed.table(spark, d, "nation"), c("c_nationkey") == c("n_nationkey"))
    return docs.find_locations(own.select(c("c_custkey").alias("doc_id"), F.concat_ws(" ", "c_name", "n_name", F.lit("then Ha Noi")).alias("text")), taxonomy.locations(spark))


def _signals(spark, d):
    t = cv(spark, d).select("candidate_id", "doc_id", F.split("text", "\n").alias("l"))
    return t.select("candidate_id", F.get("l", F.lit(1)).alias("text"), F.lit(95).alias("priority"), c("doc_id").alias("recency"))


def _periods(spark, d):
    return docs.periods(cv_lines(spark, d), F.lit(AS_OF))


def f19(spark, d):
    return docs.normalize_title(cv(spark, d).select("doc_id", F.get(F.split("text", "\n"), F.lit(1)).alias("text")), "doc_id", "text", spark.createDataFrame(list(taxonomy.TITLES), "alias string, canonical string"))


_PREFS = "Location: Town %d\nExpected salary: 20 tr\nEnglish (IELTS 7.0) fluent\nNotice period: 30 days"


def _pref_lines(spark, d):
    return docs.lines(feed.table(spark, d, "customer").select(c("c_custkey").alias("doc_id"), F.format_string(_PREFS, "c_custkey").alias("text")))


def f24(spark, d):
    p = feed.periods(spark, d)
    return docs.violations(p, "period_id", {"END_BEFORE_START": ("end_month", c("end_month") < c("start_month")), "TOO_LONG": ("end_month", c("end_month") - c("start_month") > 12), "EARLY": ("start_month", c("start_month") < 1993 * 12)})


#: Warnings by doc_id % 3.
_WARNINGS = ((), ("CV_LANGUAGE_UNKNOWN",), ("UNCLASSIFIED_SECTIONS_PRESENT", "EDUCATION_PARTIALLY_PARSED", "TEXT_LAYOUT_MAY_BE_LOST", "MULTI_COLUMN_LAYOUT_SUSPECTED"))


def _warnings():
    own = lambda ws: F.array(*map(F.lit, ws)).cast("array<string>")
    return F.when(c("doc_id") % 3 == 0, own(_WARNINGS[0])).when(c("doc_id") % 3 == 1, own(_WARNINGS[1])).otherwise(own(_WARNINGS[2]))


def f25(spark, d):
    kinds = cv_sections(spark, d).groupBy("doc_id").agg(F.collect_set("section_type").alias("types"))
    work = F.struct(*(v.alias(k) for k, v in {"title": c("doc_id") % 2 == 0, "company": F.lit(False), "start": F.lit(True), "end": F.lit(True), "duties": c("doc_id") % 7 > 0, "achievements": c("doc_id") % 5 == 0, "skills": F.lit(False)}.items()))
    works = F.when(c("doc_id") % 11 == 0, F.slice(F.array(work), 1, 0)).otherwise(F.array(work))
    have = {"full_name": F.lit(True), "headline": c("doc_id") % 4 < 3, "contact": F.lit(True), "skills": F.lit(True), "works": c("doc_id") % 11 > 0, "educations": c("doc_id") % 3 == 0}
    rows = cv(spark, d).join(kinds, "doc_id")
    return rows.select("doc_id", docs.parse_quality(c("text"), c("types"), works, have, _warnings()).alias("q")).select("doc_id", "q.*")


def f2_forms(spark, d):
    """Headings that are numbered, letter-spaced or closed by marks."""
    form = F.when(c("doc_id") % 4 == 0, "1. SKILLS:").when(c("doc_id") % 4 == 1, "S K I L L S").when(c("doc_id") % 4 == 2, "II) Skills -").otherwise("SKILLS")
    rows = cv(spark, d).withColumn("text", F.replace("text", F.lit("\nSKILLS\n"), F.concat(F.lit("\n"), form, F.lit("\n"))))
    return docs.sections(docs.lines(rows), taxonomy.headings(spark)).select("doc_id", "section_type", "start_at", "end_at", F.length("content").alias("n_chars"))


#: Lines by c_custkey % 3, and the ranges in them: start, end, current, precision of both.
_RANGES = (
    ("01/2019 - 12/2020; then 2021 - present", ((2019 * 12, 2020 * 12 + 11, False, "MONTH", "MONTH"), (2021 * 12, AS_OF, True, "YEAR", None))),
    ("2015-03 to 2016", ((2015 * 12 + 2, 2016 * 12 + 11, False, "MONTH", "YEAR"),)),
    ("Jan 2018 - Feb 2019, 2020 - 2021", ((2018 * 12, 2019 * 12 + 1, False, "MONTH", "MONTH"), (2020 * 12, 2021 * 12 + 11, False, "YEAR", "YEAR"))),
)


def f12_forms(spark, d):
    line = F.when(c("c_custkey") % 3 == 0, _RANGES[0][0]).when(c("c_custkey") % 3 == 1, _RANGES[1][0]).otherwise(_RANGES[2][0])
    rows = feed.table(spark, d, "customer").select(c("c_custkey").alias("doc_id"), line.alias("text"))
    return docs.periods(docs.lines(rows), F.lit(AS_OF)).drop("n")


def f16_signals(spark, d):
    titles = cv(spark, d).select("candidate_id", F.struct(-c("doc_id"), F.get(F.split("text", "\n"), F.lit(1)).alias("t")).alias("x")).groupBy("candidate_id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]).alias("titles"))
    titles = titles.join(docs.experience_years(feed.periods(spark, d), "candidate_id"), "candidate_id", "left")
    rows = titles.withColumns({"headline": F.when(c("candidate_id") % 5 == 0, "Senior Engineer"), "targets": F.array(F.lit("Head of Sales"))}).withColumn("targets", F.when(c("candidate_id") % 7 == 0, c("targets")))
    return docs.resolve_candidates(rows, docs.seniority_signals(rows, "candidate_id", "headline", "titles", "targets"), "candidate_id")


def f21_whole(spark, d):
    k = c("c_custkey") % 3
    text = F.when(k == 0, "Desired location: Ha Noi, Saigon\nWork mode: remote or hybrid\nExpected salary: 20 tr").when(k == 1, "Location: Paris\nEmployment type: full-time, contract").otherwise("Notice period: 30 days\nLocation: Ha Noi")
    return docs.career_preferences(docs.lines(feed.table(spark, d, "customer").select(c("c_custkey").alias("doc_id"), text.alias("text"))), taxonomy.locations(spark)).select("doc_id", *(F.array_join(x, ",").alias(x) for x in ("locations", "work_modes", "employment_types")), "salary_text", "availability")


_PROFILE = {
    "parser_version": "CASE WHEN doc_id % 7 = 0 THEN 'v1' ELSE 'v2' END", "text_length": "length(text) + CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END", "start_date": "CASE WHEN doc_id % 5 = 0 THEN '2001-13' ELSE '1999-05' END",
    "end_date": "CASE WHEN doc_id % 6 = 0 THEN '1998' WHEN doc_id % 6 > 1 THEN '2001-12' END", "current": "doc_id % 4 = 1", "start_offset": "doc_id % 9 - 1", "end_offset": "CASE WHEN doc_id % 8 = 0 THEN length(text) + 1 ELSE 4 END",
    "score": "(doc_id % 12) / 10.0", "years": "doc_id % 110", "months": "doc_id % 1300", "tags": "CASE WHEN doc_id % 10 = 0 THEN array('a', ' ') ELSE array('a') END",
}


def f24_profiles(spark, d):
    rows = cv(spark, d).select("doc_id", "text", *(F.expr(v).alias(k) for k, v in _PROFILE.items()))
    return docs.violations(rows, "doc_id", docs.profile_rules("v2", ("tags",)))


def f26_ambiguous(spark, d):
    return documents(spark, d).select("doc_id", F.array_join(docs.ambiguous_fields(F.concat(_warnings(), F.array(F.lit("SKILL_TAXONOMY_MATCH_LOW"), F.lit("NO_FIELD")))), ",").alias("fields"))


def f20_match(spark, d):
    own = documents(spark, d).select("doc_id", F.when(c("doc_id") % 3 == 0, "Master").when(c("doc_id") % 3 == 1, "a bachelor of science, then college").otherwise("none at all").alias("text"))
    return docs.match_degree(own, taxonomy.degrees(spark), "doc_id", "text")


def f11_levels(spark, d):
    """Evidence with levels, and the share of known skills; every fifth text has mostly skills that aren't known."""
    rows = cv(spark, d).withColumn("text", F.when(c("doc_id") % 5 == 0, F.replace("text", F.lit(", small ring; red bolt"), F.lit(", frobbing, glarking; red bolt"))).otherwise(c("text")))
    out = docs.skill_levels(rows, taxonomy.headings(spark), taxonomy.skills(spark).filter("category <> 'SEGMENT'"))
    return out.select("doc_id", "canonical", "first_source", "level", "share", "warning")


def f26(spark, d):
    row = documents(spark, d).select("doc_id", docs.email(c("text")).alias("email"), docs.phone(c("text")).alias("phone"))
    return row.select("doc_id", F.array_join(docs.missing_fields({"email": c("email"), "phone": c("phone")}), ",").alias("missing"))


def f27(spark, d):
    o = feed.table(spark, d, "orders")
    return o.select("o_orderkey", docs.expired(F.year("o_orderdate"), F.when(c("o_orderkey") % 2 == 0, F.month("o_orderdate")), F.lit("1998-07-01").cast("date")).alias("expired"))


def f28(spark, d):
    t = cv(spark, d).select("doc_id", F.split("text", "\n").alias("l"))
    return t.select("doc_id", docs.candidate_text({"Name": (F.get("l", F.lit(0)), 20), "Title": (F.get("l", F.lit(1)), 30), "Work": (F.get("l", F.lit(5)), 40)}, 2400).alias("value"))


def _language_lines(spark, d):
    """Customers with lines that name languages in several forms, and none."""
    k = c("c_custkey") % 5
    line = F.when(k == 0, F.concat(F.lit("- English: upper intermediate (IELTS 6.5), "), F.initcap("c_mktsegment"), F.lit("; French - basic"))).when(k == 1, "Vietnamese (Native speaker) | Japanese JLPT N2").when(k == 2, "Professional working proficiency in German / Korean").when(k == 3, "DELF B2 español Spanish").otherwise(F.concat(F.lit("Fluent in "), "c_name"))
    return feed.table(spark, d, "customer").select(c("c_custkey").alias("doc_id"), line.alias("line"))


QUERIES = {
    "f1_detect_language": lambda spark, d: documents(spark, d).select("doc_id", docs.detect_language(c("text")).alias("language")),
    "f2_detect_sections": cv_sections,
    "f3_unclassified_headings": lambda spark, d: docs.unclassified_headings(docs.lines(documents(spark, d)), taxonomy.headings(spark)),
    "f4_extract_email": lambda spark, d: documents(spark, d).select("doc_id", docs.email(c("text")).alias("value")),
    "f5_extract_phone": lambda spark, d: documents(spark, d).select("doc_id", docs.phone(c("text")).alias("value")),
    "f6_extract_links_text": f6,
    "f7_find_locations": f7,
    "f8_match_skills": lambda spark, d: docs.match_skills(cv(spark, d), taxonomy.skills(spark)).select("doc_id", "canonical"),
    "f9_unknown_skills": lambda spark, d: docs.unknown_skills(cv_sections(spark, d), taxonomy.skills(spark).filter("category <> 'SEGMENT'")),
    "f10_skill_proficiency": lambda spark, d: docs.skill_proficiency(cv(spark, d), taxonomy.skills(spark)),
    "f11_merge_skill_evidence": lambda spark, d: docs.skill_evidence(cv_sections(spark, d), taxonomy.skills(spark)),
    "f12_extract_periods": lambda spark, d: _periods(spark, d).select("doc_id", "start_month", "end_month", "current"),
    "f13_period_months": lambda spark, d: feed.periods(spark, d).select("period_id", docs.period_months(c("start_month"), c("end_month")).cast("long").alias("months")),
    "f14_experience_years": lambda spark, d: docs.experience_years(feed.periods(spark, d), "candidate_id"),
    "f15_explicit_years": lambda spark, d: feed.table(spark, d, "customer").select("c_custkey", docs.explicit_years(F.concat(F.lit("more than "), c("c_custkey") % 130, F.lit(" years of experience"))).alias("years")),
    "f16_candidate_seniority": lambda spark, d: docs.candidate_seniority(_signals(spark, d), "candidate_id").select("candidate_id", "level"),
    "f17_seniority_conflict": lambda spark, d: docs.seniority_conflict(docs.candidate_seniority(_signals(spark, d), "candidate_id")).select("candidate_id", "conflict"),
    "f18_order_work_history": lambda spark, d: docs.order_work_history(_periods(spark, d).join(cv(spark, d).select("doc_id", "candidate_id"), "doc_id"), "candidate_id", "doc_id").select("candidate_id", "doc_id", "rank"),
    "f19_normalize_job_title": f19,
    "f20_highest_education": lambda spark, d: docs.highest_education(cv(spark, d), taxonomy.degrees(spark)),
    "f21_career_preferences": lambda spark, d: docs.labelled_lines(_pref_lines(spark, d), docs.PREFERENCES),
    "f22_language_skills_forms": lambda spark, d: docs.language_skills(_language_lines(spark, d)),
    "f22_language_skills": lambda spark, d: docs.language_skills(_pref_lines(spark, d)),
    "f23_classify_bullets": lambda spark, d: docs.classify_bullets(cv_lines(spark, d)),
    "f24_validate_profiles": f24,
    "f25_parse_quality": f25,
    "f26_missing_fields": f26,
    "f27_expired_flag": f27,
    "f28_candidate_text": f28,
    "f2_detect_sections_forms": f2_forms,
    "f11_skill_evidence_levels": f11_levels,
    "f12_extract_periods_forms": f12_forms,
    "f16_f17_seniority_by_signals": f16_signals,
    "f20_match_degree": f20_match,
    "f21_career_preferences_whole": f21_whole,
    "f24_validate_profiles_whole": f24_profiles,
    "f26_ambiguous_fields": f26_ambiguous,
}

_W = f"WITH {base.CV}"
_LINES = "lines AS (SELECT candidate_id, doc_id, unnest(x) AS line, generate_subscripts(x, 1) - 1 AS n FROM (SELECT candidate_id, doc_id, string_split(text, chr(10)) AS x FROM cv))"
def _score(k: str) -> str:
    parts = [f"6.0::DOUBLE * len(list_filter(w, lambda x: x IN ({', '.join(map(repr, docs.telling(docs.COMMON)[k]))}))) / len(w)"]
    parts += [f"CASE WHEN contains(t, '{h}') THEN 0.12::DOUBLE ELSE 0 END" for h in docs.LANGUAGE_HEADINGS.get(k, ())]
    parts += [f"least(0.35::DOUBLE, (length(t) - length(regexp_replace(t, '[{docs.VIETNAMESE_ONLY}]', '', 'g'))) / 40.0::DOUBLE)"] if k == "vi" else []
    return f"least(1.0::DOUBLE, {' + '.join(parts)})"


_EMAIL = r"lower(nullif(regexp_extract(text, '(?i)(?:^|[^a-z0-9._%+-])([a-z0-9._%+-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,})', 1), ''))"
_PHONE0 = r"list_filter(list_transform(regexp_extract_all(text, '\+?[0-9][0-9 .()\-]{7,22}[0-9]'), lambda x: (CASE WHEN x LIKE '+%' THEN '+' ELSE '' END) || regexp_replace(x, '[^0-9]', '', 'g')), lambda x: length(replace(x, '+', '')) BETWEEN 9 AND 15)[1]"
_PHONE = f"CASE WHEN {_PHONE0} LIKE '84%' AND length({_PHONE0}) BETWEEN 11 AND 12 THEN '+' || {_PHONE0} ELSE {_PHONE0} END"
_TITLE = "CASE doc_id % 4 WHEN 0 THEN 'SENIOR' WHEN 1 THEN 'JUNIOR' WHEN 2 THEN 'MANAGER' END"
_RANK = "CASE doc_id % 4 WHEN 0 THEN 70 WHEN 1 THEN 50 WHEN 2 THEN 100 END"
_PERIOD = "per AS (SELECT cv.candidate_id, cv.doc_id, CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS INTEGER) AS start_month, 24023 AS end_month, o_orderkey % 5 = 0 AS current FROM cv JOIN orders ON o_orderkey = doc_id)"
_NAME = "(SELECT o_orderkey AS doc_id, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey)"
_N = "length(text)"
_VISIBLE = r"length(regexp_replace(text, '\s', '', 'g'))"
_LET = rf"(length(text) - length(regexp_replace(text, '\p{{L}}', '', 'g'))) / greatest({_VISIBLE}, 1)"
_FULL = "list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')"
_TINY = f"len(list_filter({_FULL}, lambda x: length(trim(x)) <= 2)) / len({_FULL})"
_LAYOUT, _OTHER = "CASE WHEN doc_id % 3 = 2 THEN 0.12::DOUBLE + 0.08::DOUBLE ELSE 0 END", "CASE WHEN doc_id % 3 = 2 THEN 0.12::DOUBLE ELSE 0 END"
_Q = {
    "text": f"CASE WHEN {_N} < 100 THEN 0.15 WHEN {_N} < 300 THEN 0.35 WHEN {_N} < 800 THEN 0.58 ELSE 0.75 END::DOUBLE - CASE WHEN {_LET} < 0.35 THEN 0.25 WHEN {_LET} < 0.5 THEN 0.1 ELSE 0 END::DOUBLE - CASE WHEN {_TINY} >= 0.3 THEN 0.18 WHEN {_TINY} >= 0.15 THEN 0.08 ELSE 0 END::DOUBLE - {_LAYOUT}",
    "sections": f"4 / 6.0::DOUBLE * 0.65::DOUBLE + 3 / 8.0::DOUBLE * 0.35::DOUBLE - {_OTHER}",
    "work": "CASE WHEN doc_id % 11 = 0 THEN 0.05::DOUBLE ELSE 0.34::DOUBLE + CASE WHEN doc_id % 2 = 0 THEN 0.24 ELSE 0 END::DOUBLE + CASE WHEN doc_id % 7 > 0 THEN 0.12 ELSE 0 END::DOUBLE + CASE WHEN doc_id % 5 = 0 THEN 0.06 ELSE 0 END::DOUBLE + 0.08::DOUBLE / 3 END",
    "completeness": "0.5::DOUBLE + CASE WHEN doc_id % 4 < 3 THEN 0.1 ELSE 0 END::DOUBLE + CASE WHEN doc_id % 11 > 0 THEN 0.25 ELSE 0 END::DOUBLE + CASE WHEN doc_id % 3 = 0 THEN 0.15 ELSE 0 END::DOUBLE",
}
_SQL_PROFILE = {k: v.replace("array(", "list_value(") for k, v in _PROFILE.items()}
_DATE_FORM = r"regexp_matches({}, '^\d{{4}}(-(0[1-9]|1[0-2]))?$')"
_RULES = {
    "VERSION_MISMATCH": ("parser_version", "parser_version <> 'v2'"), "TEXT_LENGTH": ("text_length", "text_length <> length(text)"), "START_DATE_FORM": ("start_date", "NOT " + _DATE_FORM.format("start_date")), "END_DATE_FORM": ("end_date", "NOT " + _DATE_FORM.format("end_date")),
    "CURRENT_WITH_END": ("end_date", "current AND end_date IS NOT NULL"), "END_BEFORE_START": ("end_date", "end_date < start_date[1:length(end_date)]"), "OFFSET_NEGATIVE": ("start_offset", "start_offset < 0"), "OFFSET_ORDER": ("end_offset", "end_offset < start_offset"),
    "OFFSET_BEYOND_TEXT": ("end_offset", "end_offset > length(text)"), "SCORE_RANGE": ("score", "score > 1"), "YEARS_RANGE": ("years", "years > 100"), "MONTHS_RANGE": ("months", "months > 1200"), "TAGS_BLANK_ITEM": ("tags", "doc_id % 10 = 0"),
}
_BAND = lambda x: f"CASE WHEN {x} IN ('INTERN', 'TRAINEE', 'FRESHER', 'ENTRY_LEVEL') THEN 0 WHEN {x} = 'JUNIOR' THEN 1 WHEN {x} = 'MID' THEN 2 WHEN {x} = 'SENIOR' THEN 3 END"

ORACLES = {
    "f1_detect_language": f"WITH t AS (SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g') AS t FROM documents), v AS (SELECT *, regexp_extract_all(t, '[\\p{{L}}]+') AS w FROM t), s AS (SELECT doc_id, len(w) AS n, list_sort([{', '.join('{s: -' + _score(k) + f', l: {k!r}' + '}' for k in docs.COMMON)}]) AS s FROM v) SELECT doc_id, CASE WHEN n < 8 OR -s[1].s < 0.16 THEN 'UNKNOWN' WHEN -s[2].s >= 0.22 AND s[2].s - s[1].s <= 0.35 THEN 'MIXED' ELSE s[1].l END AS language FROM s",
    "f2_detect_sections": f"""{_W}, {_LINES}, o AS (SELECT *, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS pos, CASE line WHEN 'SKILLS' THEN 'SKILLS' WHEN 'WORK EXPERIENCE' THEN 'WORK_EXPERIENCE' WHEN 'EDUCATION' THEN 'EDUCATION' WHEN 'CONTACT' THEN 'CONTACT' END AS t FROM lines),
s AS (SELECT *, count(t) OVER (PARTITION BY doc_id ORDER BY n) AS s FROM o)
SELECT doc_id, coalesce(max(t), 'HEADER') AS section_type, min(pos) AS start_at, CAST(max(pos + length(line)) AS INTEGER) AS end_at, coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE t IS NULL), '') AS content FROM s GROUP BY doc_id, s""",
    "f3_unclassified_headings": f"""WITH l AS (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)), f AS (SELECT *, min(n) OVER (PARTITION BY doc_id) AS first FROM l WHERE trim(line) <> ''),
m AS (SELECT *, trim(line) AS x FROM f)
SELECT doc_id, count(*) FILTER (WHERE n > first AND length(x) <= 80 AND len(regexp_split_to_array(x, '\\s+')) BETWEEN 1 AND 8 AND length(regexp_replace(x, '[^A-Za-z]', '', 'g')) >= 3 AND length(regexp_replace(x, '[^A-Z]', '', 'g')) >= 0.85 * length(regexp_replace(x, '[^A-Za-z]', '', 'g')) AND lower(regexp_replace(x, '[:.\\-]+$', '')) NOT IN ({', '.join(repr(h) for h, _ in taxonomy.HEADINGS)})) AS n_headings FROM m GROUP BY doc_id""",
    "f4_extract_email": f"SELECT doc_id, {_EMAIL} AS value FROM documents",
    "f5_extract_phone": f"SELECT doc_id, {_PHONE} AS value FROM documents",
    "f6_extract_links_text": "SELECT doc_id, 'https://www.github.com/u' || doc_id || '/x' AS link, 'GITHUB' AS kind FROM documents UNION ALL SELECT doc_id, 'https://www.example.com/a', 'OTHER' FROM documents",
    "f7_find_locations": f"""WITH t AS (SELECT c_custkey AS doc_id, ' ' || {base.fold("c_name || ' ' || n_name || ' then Ha Noi'")} || ' ' AS t FROM customer JOIN nation ON c_nationkey = n_nationkey), h AS (SELECT doc_id, kind, canonical, strpos(t, ' ' || alias || ' ') AS pos, length(alias) AS n FROM t JOIN {taxonomy.values(taxonomy.LOCATIONS, "k(alias, canonical, kind)")} ON contains(t, ' ' || alias || ' '))
SELECT doc_id, kind, arg_min(canonical, (pos, -n, canonical)) AS canonical FROM h GROUP BY doc_id, kind""",
    "f8_match_skills": f"{_W} SELECT doc_id, s AS canonical FROM (SELECT cv.doc_id, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS s FROM cv JOIN {_NAME} n ON n.doc_id = cv.doc_id UNION ALL SELECT doc_id, 'Small Ring' FROM cv UNION ALL SELECT doc_id, 'Red Bolt' FROM cv)",
    "f9_unknown_skills": f"{_W} SELECT cv.doc_id, c_mktsegment AS skill FROM cv JOIN {_NAME} n ON n.doc_id = cv.doc_id",
    "f10_skill_proficiency": f"{_W} SELECT doc_id, s AS canonical, 'ADVANCED' AS level FROM cv, (VALUES ('Red Bolt'), ('Bolt')) AS t(s)",
    "f11_merge_skill_evidence": f"{_W} SELECT doc_id, s AS canonical, 'SKILLS' AS sources, 'SKILLS' AS first_source FROM (SELECT cv.doc_id, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS s FROM cv JOIN {_NAME} n ON n.doc_id = cv.doc_id UNION ALL SELECT doc_id, 'Small Ring' FROM cv UNION ALL SELECT doc_id, 'Red Bolt' FROM cv)",
    "f12_extract_periods": f"{_W}, {_PERIOD} SELECT doc_id, start_month, end_month, current FROM per",
    "f13_period_months": f"WITH {base.PERIODS} SELECT period_id, CASE WHEN end_month >= start_month THEN CAST(end_month - start_month + 1 AS BIGINT) END AS months FROM periods",
    "f14_experience_years": f"""WITH {base.PERIODS}, m AS (SELECT DISTINCT candidate_id, unnest(generate_series(start_month, end_month)) AS m FROM periods WHERE end_month >= start_month) SELECT candidate_id, count(*) AS months, round(count(*) / 12.0::DOUBLE, 1) AS years FROM m GROUP BY candidate_id""",
    "f15_explicit_years": "SELECT c_custkey, CASE WHEN c_custkey % 130 <= 100 THEN CAST(c_custkey % 130 AS DOUBLE) END AS years FROM customer",
    "f16_candidate_seniority": f"{_W} SELECT candidate_id, arg_max({_TITLE}, doc_id) AS level FROM cv WHERE doc_id % 4 <> 3 GROUP BY candidate_id",
    "f17_seniority_conflict": f"{_W} SELECT candidate_id, max({_RANK}) - min({_RANK}) >= 20 AS conflict FROM cv WHERE doc_id % 4 <> 3 GROUP BY candidate_id",
    "f18_order_work_history": f"{_W}, {_PERIOD} SELECT candidate_id, doc_id, CAST(row_number() OVER (PARTITION BY candidate_id ORDER BY current DESC, end_month DESC, start_month DESC, doc_id) AS INTEGER) AS rank FROM per",
    "f19_normalize_job_title": f"{_W} SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Engineer' WHEN 1 THEN 'Analyst' WHEN 2 THEN 'Store Manager' ELSE 'Analyst' END AS title FROM cv",
    "f20_highest_education": f"{_W} SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'BACHELOR' WHEN 1 THEN 'MASTER' ELSE 'DOCTORATE' END AS level FROM cv",
    "f21_career_preferences": "SELECT c_custkey AS doc_id, f AS field, replace(v, '?', CAST(c_custkey AS VARCHAR)) AS value FROM customer, (VALUES ('LOCATION', 'Town ?'), ('SALARY', '20 tr'), ('AVAILABILITY', '30 days')) AS t(f, v)",
    "f22_language_skills_forms": """SELECT c_custkey AS doc_id, language, framework, score, level FROM customer JOIN (VALUES (0, 'english', 'IELTS', '6.5', 'UPPER_INTERMEDIATE'), (0, 'french', NULL, NULL, 'BASIC'), (1, 'vietnamese', NULL, NULL, 'NATIVE'), (1, 'japanese', 'JLPT', 'n2', NULL),
  (2, 'german', NULL, NULL, 'ADVANCED'), (2, 'korean', NULL, NULL, NULL), (3, 'spanish', 'DELF', NULL, 'B2')) AS v(k, language, framework, score, level) ON c_custkey % 5 = k""",
    "f22_language_skills": "SELECT c_custkey AS doc_id, 'english' AS language, 'IELTS' AS framework, '7.0' AS score, 'FLUENT' AS level FROM customer",
    "f23_classify_bullets": f"{_W}, {_LINES} SELECT doc_id, CAST(n AS INTEGER) AS n, CASE WHEN line LIKE '%\\%%' ESCAPE '\\' THEN 'ACHIEVEMENT' ELSE 'RESPONSIBILITY' END AS kind FROM lines WHERE line LIKE '- %'",
    "f24_validate_profiles": f"WITH {base.PERIODS} SELECT period_id, 'end_month' AS field, 'END_BEFORE_START' AS reason FROM periods WHERE end_month < start_month UNION ALL SELECT period_id, 'end_month', 'TOO_LONG' FROM periods WHERE end_month - start_month > 12 UNION ALL SELECT period_id, 'start_month', 'EARLY' FROM periods WHERE start_month < 23916",
    "f25_parse_quality": f"{_W}, q AS (SELECT doc_id, {', '.join(f'greatest(0.0::DOUBLE, least(1.0::DOUBLE, {v})) AS {k}' for k, v in _Q.items())} FROM cv) SELECT doc_id, round(greatest(0.0::DOUBLE, text * 0.35::DOUBLE + sections * 0.25::DOUBLE + work * 0.25::DOUBLE + completeness * 0.15::DOUBLE - CASE doc_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 0.02 ELSE 0.04 END::DOUBLE), 4) AS overall, {', '.join(f'round({k}, 4) AS {k}' for k in _Q)} FROM q",
    "f26_missing_fields": f"SELECT doc_id, array_to_string(list_filter([CASE WHEN {_EMAIL} IS NULL THEN 'email' END, CASE WHEN {_PHONE0} IS NULL THEN 'phone' END], lambda x: x IS NOT NULL), ',') AS missing FROM documents",
    "f27_expired_flag": "SELECT o_orderkey, last_day(make_date(year(o_orderdate), CASE WHEN o_orderkey % 2 = 0 THEN month(o_orderdate) ELSE 12 END, 1)) < DATE '1998-07-01' AS expired FROM orders",
    "f28_candidate_text": f"{_W} SELECT doc_id, 'query: Name: ' || string_split(text, chr(10))[1] || chr(10) || 'Title: ' || string_split(text, chr(10))[2] || chr(10) || 'Work: ' || string_split(text, chr(10))[6] AS value FROM cv",
    "f11_skill_evidence_levels": f"""{_W}, k AS (SELECT doc_id, unnest(CASE WHEN doc_id % 5 = 0 THEN ['Red Bolt'] ELSE ['Small Ring', 'Red Bolt'] END) AS canonical FROM cv)
SELECT doc_id, canonical, 'SKILLS' AS first_source, CASE WHEN canonical = 'Red Bolt' THEN 'ADVANCED' END AS level, CASE WHEN doc_id % 5 = 0 THEN 0.25::DOUBLE ELSE round(2 / 3.0::DOUBLE, 4) END AS share, CASE WHEN doc_id % 5 = 0 THEN 'SKILL_TAXONOMY_MATCH_LOW' END AS warning FROM k""",
    "f12_extract_periods_forms": f"""SELECT c_custkey AS doc_id, CAST(k AS INTEGER) AS k, CAST(s AS INTEGER) AS start_month, CAST(e AS INTEGER) AS end_month, c AS current, sp AS start_precision, ep AS end_precision FROM customer JOIN (VALUES {', '.join(f"({m}, {k}, {r[0]}, {r[1]}, {r[2]}, '{r[3]}', " + (f"'{r[4]}')" if r[4] else "NULL)") for m, (_, rs) in enumerate(_RANGES) for k, r in enumerate(rs))}) AS t(m, k, s, e, c, sp, ep) ON c_custkey % 3 = m""",
    "f20_match_degree": "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'MASTER' ELSE 'BACHELOR' END AS level FROM documents WHERE doc_id % 3 < 2",
    "f21_career_preferences_whole": """SELECT c_custkey AS doc_id, CASE k WHEN 0 THEN 'Hà Nội,Hồ Chí Minh' WHEN 1 THEN 'Paris' ELSE 'Hà Nội' END AS locations, CASE k WHEN 0 THEN 'REMOTE,HYBRID' ELSE '' END AS work_modes, CASE k WHEN 1 THEN 'CONTRACT,FULL_TIME' ELSE '' END AS employment_types,
  CASE k WHEN 0 THEN '20 tr' END AS salary_text, CASE k WHEN 2 THEN '30 days' END AS availability FROM (SELECT c_custkey, c_custkey % 3 AS k FROM customer)""",
    "f24_validate_profiles_whole": f"{_W}, p AS (SELECT doc_id, text, {', '.join(f'{v} AS {k}' for k, v in _SQL_PROFILE.items())} FROM cv) " + " UNION ALL ".join(f"SELECT doc_id, '{f}' AS field, '{r}' AS reason FROM p WHERE {w}" for r, (f, w) in _RULES.items()),
    "f26_ambiguous_fields": "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'skills' WHEN 1 THEN 'detectedLanguage,skills' ELSE 'sections,educations,rawText.layout,skills' END AS fields FROM documents",
}
ORACLES["f2_detect_sections_forms"] = (
    ORACLES["f2_detect_sections"]
    .replace("string_split(text, chr(10)) AS x FROM cv", "string_split(replace(text, chr(10) || 'SKILLS' || chr(10), chr(10) || CASE doc_id % 4 WHEN 0 THEN '1. SKILLS:' WHEN 1 THEN 'S K I L L S' WHEN 2 THEN 'II) Skills -' ELSE 'SKILLS' END || chr(10)), chr(10)) AS x FROM cv")
    .replace("WHEN 'SKILLS' THEN 'SKILLS'", "WHEN 'SKILLS' THEN 'SKILLS' WHEN '1. SKILLS:' THEN 'SKILLS' WHEN 'S K I L L S' THEN 'SKILLS' WHEN 'II) Skills -' THEN 'SKILLS'")
    .replace("coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE t IS NULL), '') AS content", "CAST(length(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE t IS NULL), '')) AS INTEGER) AS n_chars")
)
ORACLES["f16_f17_seniority_by_signals"] = f"""{_W}, t AS (SELECT candidate_id, doc_id, row_number() OVER (PARTITION BY candidate_id ORDER BY doc_id DESC) - 1 AS i FROM cv), y AS ({ORACLES["f14_experience_years"]}),
g AS (SELECT candidate_id, {_TITLE} AS level, {_RANK} AS rank, 95 AS p, 90 - 5 * i AS r FROM t WHERE doc_id % 4 <> 3 UNION ALL SELECT DISTINCT candidate_id, 'SENIOR', 70, 100, 100 FROM cv WHERE candidate_id % 5 = 0 UNION ALL SELECT DISTINCT candidate_id, 'HEAD', 110, 80, 70 FROM cv WHERE candidate_id % 7 = 0),
b AS (SELECT candidate_id, arg_max(level, (p, r, rank)) AS level, max(rank) FILTER (p >= 95 AND r >= 90) - min(rank) FILTER (p >= 95 AND r >= 90) AS apart FROM g GROUP BY candidate_id),
n AS (SELECT c.candidate_id, b.level, b.apart, CASE WHEN years IS NULL THEN 'UNKNOWN' WHEN years < 0.5 THEN 'ENTRY_LEVEL' WHEN years < 2 THEN 'JUNIOR' WHEN years < 5 THEN 'MID' ELSE 'SENIOR' END AS by_years FROM (SELECT DISTINCT candidate_id FROM cv) c LEFT JOIN b ON b.candidate_id = c.candidate_id LEFT JOIN y ON y.candidate_id = c.candidate_id)
SELECT candidate_id, coalesce(level, by_years) AS level, level IS NOT NULL AND (coalesce(apart, 0) >= 20 OR coalesce(abs({_BAND('level')} - {_BAND('by_years')}) >= 2, false)) AS conflict FROM n"""
