"""Golden rows of the field normalisers."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from vacantia.functions import text
from vacantia.operators import jobs
from vacantia.sources import taxonomy


def one(spark, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string").select("i", make(F.col("x")).alias("y"))
    return [r.y for r in df.orderBy("i").collect()]


SALARIES = {
    "20tr": (20_000_000, 20_000_000, "VND"), "20 triệu/tháng": (20_000_000, 20_000_000, "VND"), "20 triệu VND": (20_000_000, 20_000_000, "VND"), "20.000.000 VNĐ": (20_000_000, 20_000_000, "VND"),
    "15.5tr - 20.5tr": (15_500_000, 20_500_000, "VND"), "15,5 - 20,5 triệu": (15_500_000, 20_500_000, "VND"), "15 - 25 triệu": (15_000_000, 25_000_000, "VND"), "15 đến 25 triệu": (15_000_000, 25_000_000, "VND"),
    "1k - 2k USD": (1000, 2000, "USD"), "$1500+": (1500, None, "USD"), "from $1000": (1000, None, "USD"), "up to $2000": (None, 2000, "USD"), "Lên đến 30 triệu": (None, 30_000_000, "VND"),
    "Thỏa thuận": (None, None, None), "Competitive": (None, None, None), "20 triệu, thưởng 5 triệu": (None, None, "VND"), "$20/hour": (20, 20, "USD"), "$1000 or 20 triệu": (None, None, None), None: (None, None, None), "": (None, None, None),
}


def test_salary(spark):
    got = one(spark, list(SALARIES), jobs.salary)
    assert {k: tuple(v) for k, v in zip(SALARIES, got)} == SALARIES


EXPERIENCE = {
    "1 year 6 months": (1.5, 1.5), "18 months": (1.5, None), "18+ months": (1.5, None), "6 tháng - 1 năm": (0.5, 1.0), "2 - 4 years": (2.0, 4.0), "3+ years": (3.0, None), "fresher": (0.0, None), "about 3": (None, None), None: (None, None),
}


def test_experience(spark):
    got = one(spark, list(EXPERIENCE), jobs.experience)
    assert {k: tuple(v) for k, v in zip(EXPERIENCE, got)} == EXPERIENCE


def test_dates(spark):
    now = F.lit("2026-07-12 03:00:00").cast("timestamp")
    posted = one(spark, ["2 hours ago", "30 phút trước", "2 weeks ago", "1 month ago", "hello", None], lambda x: jobs.posted_at(x, now).cast("timestamp_ntz"))
    assert posted == [datetime(2026, 7, 12, 1), datetime(2026, 7, 12, 2, 30), datetime(2026, 6, 27, 17), datetime(2026, 6, 11, 17), None, None]
    ends = one(spark, ["tomorrow", "còn 3 ngày nữa", "cuối tháng", "2 hours ago"], lambda x: jobs.deadline_at(x, now).cast("timestamp_ntz"))
    assert ends == [datetime(2026, 7, 13, 16, 59, 59, 999999), datetime(2026, 7, 15, 16, 59, 59, 999999), None, None]


def test_locations(spark):
    rows = spark.createDataFrame([("TP.HCM, HCMC, Ho Chi Minh City",), ("WFH",), ("TP.HCM / Remote",), ("DN",)], "t string")
    got = {r.t: list(r.locations) for r in jobs.locations(rows, "t", "t", taxonomy.locations(spark)).collect()}
    assert got == {"TP.HCM, HCMC, Ho Chi Minh City": ["Hồ Chí Minh"], "TP.HCM / Remote": ["Hồ Chí Minh"], "DN": ["DN"]}


def test_seniority(spark):
    assert one(spark, ["Lead Generation Specialist", "Senior Account Manager", "Account Manager", "Head of Data", "Internal Auditor", None], jobs.classify_seniority) == ["UNKNOWN", "MANAGER", "UNKNOWN", "HEAD", "UNKNOWN", "UNKNOWN"]


def test_normalisers_are_idempotent(spark):
    texts = ["  Hồ  Chí\tMinh ", "Đà Nẵng", "a b", "​x", "", None]
    for f in (text.norm_inline, text.fold, text.compact_key, text.norm_match):
        once = one(spark, texts, f)
        assert one(spark, once, f) == once


def test_repair_mojibake(spark):
    broken = "déjà vu".encode().decode("latin-1")
    assert one(spark, [broken, "déjà vu", "plain", None], text.repair_mojibake) == ["déjà vu", "déjà vu", "plain", None]


@pytest.mark.parametrize("make", [jobs.salary, jobs.experience, jobs.classify_seniority])
def test_no_python_in_plans(spark, make):
    plan = spark.createDataFrame([("x",)], "x string").select(make(F.col("x")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
