"""Small dimension tables of our own: skills, places, levels, kinds of work, degrees, headings, sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Alias, canonical name, category.
SKILLS = (
    ("small ring", "Small Ring", "PART"), ("red bolt", "Red Bolt", "PART"), ("blue bolt", "Blue Bolt", "PART"), ("bolt", "Bolt", "PART"), ("hot gear", "Hot Gear", "PART"), ("gear", "Gear", "PART"),
    ("ring", "Ring", "PART"), ("promo", "Promo", "TYPE"), ("standard", "Standard", "TYPE"), ("economy", "Economy", "TYPE"), ("large", "Large", "TYPE"), ("medium", "Medium", "TYPE"),
    ("automobile", "Automobile", "SEGMENT"), ("building", "Building", "SEGMENT"), ("furniture", "Furniture", "SEGMENT"), ("household", "Household", "SEGMENT"), ("machinery", "Machinery", "SEGMENT"),
    ("java", "Java", "LANGUAGE"), ("javascript", "JavaScript", "LANGUAGE"), ("js", "JavaScript", "LANGUAGE"), ("sql", "SQL", "DATABASE"), ("sql server", "SQL Server", "DATABASE"), ("mssql", "SQL Server", "DATABASE"),
    ("python", "Python", "LANGUAGE"), ("c++", "C++", "LANGUAGE"), ("c#", "C#", "LANGUAGE"), ("node.js", "Node.js", "FRAMEWORK"), ("spring boot", "Spring Boot", "FRAMEWORK"), ("excel", "Excel", "OFFICE"),
)
#: Aliases that also are common words: never found in prose.
AMBIGUOUS = ("r", "c", "go", "ai", "hr", "js", "ts", "react", "word", "excel")
#: Aliases of one or two letters that are found in prose all the same.
SHORT = ("c#", "qa", "ux")
LOCATIONS = (
    ("tp.hcm", "Hồ Chí Minh", "CITY"), ("tphcm", "Hồ Chí Minh", "CITY"), ("hcmc", "Hồ Chí Minh", "CITY"), ("saigon", "Hồ Chí Minh", "CITY"), ("ho chi minh city", "Hồ Chí Minh", "CITY"), ("ho chi minh", "Hồ Chí Minh", "CITY"),
    ("ha noi", "Hà Nội", "CITY"), ("hanoi", "Hà Nội", "CITY"), ("da nang", "Đà Nẵng", "CITY"), ("vietnam", "Vietnam", "COUNTRY"), ("france", "France", "COUNTRY"), ("germany", "Germany", "COUNTRY"),
)
AMBIGUOUS_PLACES = ("dn",)
NOT_PLACES = ("remote", "wfh", "work from home", "n/a", "hybrid")
# Fixed values, highest first: level, rank, pattern on folded text, pattern that excludes, pattern that allows again.
SENIORITY = (
    ("EXECUTIVE", 130, r"\b(ceo|cto|cfo|chief)\b", None, None),
    ("DIRECTOR", 120, r"\b(director|giam doc)\b", None, None),
    ("HEAD", 110, r"\bhead of\b", None, None),
    ("MANAGER", 100, r"\b(manager|truong phong)\b", r"\b(account manager)\b", r"\bsenior account manager\b"),
    ("LEAD", 90, r"\b(lead|leader|truong nhom)\b", r"\blead generation\b", r"\bteam lead\b"),
    ("PRINCIPAL", 80, r"\b(principal|staff)\b", r"\bstaff accountant\b", None),
    ("SENIOR", 70, r"\b(senior|sr)\b", None, None),
    ("MID", 60, r"\b(middle|mid level|mid-level)\b", None, None),
    ("JUNIOR", 50, r"\b(junior|jr)\b", None, None),
    ("FRESHER", 40, r"\bfresher\b", None, None),
    ("ENTRY_LEVEL", 30, r"\b(entry level|entry-level)\b", None, None),
    ("INTERN", 20, r"\b(intern|internship|thuc tap)\b", r"\binternal\b", r"\bintern\b"),
)
JOB_TYPES = (
    ("INTERNSHIP", r"\b(intern|internship|thuc tap)\b"),
    ("PART_TIME", r"\b(part time|part-time|ban thoi gian)\b"),
    ("FREELANCE", r"\b(freelance|freelancer|tu do)\b"),
    ("TEMPORARY", r"\b(temporary|thoi vu)\b"),
    ("CONTRACT", r"\b(contract|hop dong)\b"),
    ("FULL_TIME", r"\b(full time|full-time|toan thoi gian)\b"),
)
HEADINGS = (("skills", "SKILLS"), ("work experience", "WORK_EXPERIENCE"), ("experience", "WORK_EXPERIENCE"), ("education", "EDUCATION"), ("contact", "CONTACT"), ("projects", "PROJECTS"), ("languages", "LANGUAGES"), ("summary", "SUMMARY"))
DEGREES = (("phd", "DOCTORATE", 5), ("doctor of philosophy", "DOCTORATE", 5), ("master of arts", "MASTER", 4), ("master", "MASTER", 4), ("bachelor of science", "BACHELOR", 3), ("bachelor", "BACHELOR", 3), ("college", "COLLEGE", 2))
TITLES = (("engineer", "Engineer"), ("analyst", "Analyst"), ("store manager", "Store Manager"), ("manager", "Manager"))
# source_code, host, pattern of a detail path, pattern of the id in its last segment.
SOURCES = (("ENGLISH", "example.com", r"^/en/\d+", r"(\d+)"), ("FRENCH", "example.net", r"^/fr/\d+", r"(\d+)"))


def skills(spark: SparkSession, placed: bool = False) -> DataFrame:
    """The skills; with `placed` also their places in the list."""
    rows = [(*r, i) for i, r in enumerate(SKILLS)] if placed else list(SKILLS)
    return spark.createDataFrame(rows, "alias string, canonical string, category string" + (", place int" if placed else ""))


def locations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LOCATIONS), "alias string, canonical string, kind string")


def headings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(HEADINGS), "heading string, section_type string")


def degrees(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(DEGREES), "alias string, level string, rank int")


def sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SOURCES), "source_code string, host string, path_regex string, id_regex string")


def collisions(aliases: DataFrame, key, canonical: str = "canonical") -> DataFrame:
    """Alias keys that mean more than one canonical name; a taxonomy is valid if there are none."""
    from pyspark.sql import functions as F

    return aliases.groupBy(key.alias("alias_key")).agg(F.countDistinct(canonical).alias("n")).filter("n > 1")


def rank_faults(levels: DataFrame, name: str = "level", rank: str = "rank", order: str = "place") -> DataFrame:
    """reason, `name`: levels whose rank isn't below that of the level before, whose rank or name is there twice, or which follow UNKNOWN.

    levels: name, rank, place in the list. A list of levels is valid if this is empty and UNKNOWN, where it is listed, is last.
    """
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    w = Window.orderBy(order)  # a list of levels is short
    rows = levels.select(name, F.lag(rank).over(w).alias("before"), F.col(rank).alias("r"), F.lag(name).over(w).alias("last"), F.count("*").over(Window.partitionBy(rank)).alias("same"), F.count("*").over(Window.partitionBy(name)).alias("twice"))
    reasons = F.array(F.when(F.col("r") >= F.col("before"), "NOT_DESCENDING"), F.when(F.col("same") > 1, "RANK_TWICE"), F.when(F.col("twice") > 1, "NAME_TWICE"), F.when(F.col("last") == "UNKNOWN", "AFTER_UNKNOWN"))
    return rows.select(F.explode(F.filter(reasons, lambda x: x.isNotNull())).alias("reason"), name)


def values(rows: tuple, names: str) -> str:
    """A VALUES table for SQL that runs in both engines."""
    quoted = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows) + f") AS {names}"
