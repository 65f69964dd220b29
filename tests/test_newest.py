"""The newest sightings are found by keys and times, before texts are made."""

import re

import pytest
from conftest import SF
from pyspark.sql import functions as F

from vacantia.operators import jobs, keyed
from vacantia.plans import job_queries
from vacantia.sources import feed


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Tables with a part, a supplier and sightings twice, and with lines that no part, supplier or time belongs to."""
    at = str(tmp_path_factory.mktemp("odd"))
    for name, key in (("part", "p_partkey"), ("supplier", "s_suppkey"), ("nation", None)):
        t = feed.table(spark, SF, name)
        (t.unionByName(t.filter(F.col(key) % 7 == 1)) if key else t).write.parquet(f"{at}/{name}.parquet")
    t = feed.table(spark, SF, "lineitem")
    lost = t.limit(40).withColumns({"l_partkey": F.when(F.col("l_linenumber") > 2, F.col("l_partkey")), "l_suppkey": F.lit(10**9), "l_shipdate": F.lit(None).cast("timestamp_ntz")})
    t.unionByName(t.filter("l_orderkey % 5 = 0")).unionByName(lost).unionByName(lost.withColumn("l_suppkey", F.lit(1).cast("long"))).write.parquet(f"{at}/lineitem.parquet")
    return at


@pytest.mark.parametrize("which", ["given", "odd"])
def test_the_newest_give_what_all_sightings_give(spark, odd, which):
    d = SF if which == "given" else odd
    want = keyed.upsert_seen(keyed.with_fingerprint(feed.observations(spark, d))).drop("location_text")  # two suppliers of one key may differ in it
    got = job_queries._live(spark, d).drop("location_text")
    assert want.columns == got.columns and want.count() == got.count() > 0
    assert want.exceptAll(got).count() == 0 and got.exceptAll(want).count() == 0


def test_texts_are_made_for_the_newest_sightings_alone(spark):
    """Below the first aggregate the plan holds no text of a posting, and the second holds the fields that are asked for."""
    plan = job_queries.QUERIES["e2_upsert_seen"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    upper, lower = [m.start() for m in re.finditer("Aggregate ", plan)]
    assert "jobs" in plan[upper:lower] and "jobs" not in plan[lower:]
    assert "skills_text" not in plan


@pytest.mark.parametrize("which", ["given", "odd"])
def test_stored_runs_are_those_of_all_sightings(spark, odd, which):
    """Today's newest sighting and yesterday's (a third of the orders), hashed alike; no text of a posting is in their table."""
    d = SF if which == "given" else odd
    rows = keyed.with_fingerprint(feed.observations(spark, d))
    hashed = rows.select("fingerprint", "source_code", jobs.content_hash({k: F.col(k) for k in ("title", "salary_text", "posted_text")}).alias("digest"), *keyed.ORDER)
    for got, seen in zip(job_queries._stored(spark, d), (hashed, hashed.filter("l_orderkey % 3 = 0")), strict=True):
        want = keyed.latest_per_key(seen, ["fingerprint"], list(keyed.ORDER)).select(*got.columns)
        assert want.count() == got.count() > 0 and want.exceptAll(got).count() == 0 and got.exceptAll(want).count() == 0
        assert "title" not in got._jdf.queryExecution().logical().toString()
