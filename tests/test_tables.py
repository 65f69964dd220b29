"""Tables by source and period, and tables whose writes touch only some parts."""

import datetime
import os
import random

from pyspark.sql import functions as F

from vacantia.operators import keyed, tables
from vacantia.sources import layout

SCHEMA = "source_code string, collected_at timestamp, v int"


def feed(spark, rows):
    return spark.createDataFrame([(s, datetime.datetime(2024, 1, d) if d else None, v) for s, d, v in rows], SCHEMA)


def opened(df):
    """Files that a query opens, and its plan."""
    return {os.path.relpath(f, "/") for f in df.select("*", F.input_file_name().alias("_f")).select("_f").distinct().toPandas()["_f"]}, df._jdf.queryExecution().toString()


def test_readers_open_only_the_folders_they_need(spark, tmp_path):
    at = f"file://{tmp_path}/feed"
    rows = [(s, d, 10 * d + k) for k, s in enumerate(("ALPHA", "BRAVO", "CHARLIE")) for d in range(1, 8)] + [(None, 3, 1), ("ALPHA", None, 2)]
    layout.write_observations(feed(spark, rows), at)
    assert layout.read_observations(spark, at).count() == len(rows)
    some = layout.read_observations(spark, at, [" alpha"], since="2024-01-03", before="2024-01-05")
    files, plan = opened(some)
    assert sorted(r.v for r in some.collect()) == [30, 40] and len(files) == 2
    assert plan.split("PartitionFilters: [")[1].startswith("isnotnull") and "DataFilters: []" in plan
    only = spark.createDataFrame([("BRAVO", "2024-01-02"), ("BRAVO", "2024-01-06")], "source_code string, period string").filter(F.length("period") > 3)
    few = layout.read_observations(spark, at, only=only)
    assert sorted(r.v for r in few.collect()) == [21, 61]
    layout.write_observations(feed(spark, [("BRAVO", 2, 99)]), at)  # replaces that day of that source
    assert sorted(r.v for r in layout.read_observations(spark, at, ["BRAVO"]).collect()) == [11, 31, 41, 51, 61, 71, 99]
    layout.write_observations(feed(spark, [("BRAVO", 2, 99)]), at)
    assert layout.read_observations(spark, at).count() == len(rows)


def test_a_joined_table_prunes_folders_at_run_time(spark, tmp_path):
    at = f"file://{tmp_path}/feed"
    layout.write_observations(feed(spark, [(s, d, d) for s in ("A", "B") for d in range(1, 20)]), at)
    only = spark.createDataFrame([("A",)], "source_code string")
    only.write.parquet(f"file://{tmp_path}/only")
    few = layout.read_observations(spark, at, only=spark.read.parquet(f"file://{tmp_path}/only").filter("source_code > ''"))
    assert few.count() == 19 and "dynamicpruning" in few._jdf.queryExecution().toString()


def files(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet") and "/data/" in d + "/"}


def test_a_write_touches_the_parts_of_its_keys_only(spark, tmp_path):
    rng, order = random.Random(1), ["at", "v"]
    make = lambda: tables.KeyedTable(spark, f"file://{tmp_path}/t", "k long, at int, v string", ["k"], order, parts=8)
    frame = lambda rows: spark.createDataFrame(rows, "k long, at int, v string")
    assert make().read().isEmpty()
    all_rows = [(rng.randint(0, 60), rng.randint(0, 9), str(i)) for i in range(200)]
    assert make().write(frame(all_rows)) == 8
    before = files(tmp_path)
    late = [(7, 100, "new"), (7, -1, "old"), (1000, 1, "more")]
    touched = make().write(frame(late))
    after = files(tmp_path)
    assert touched <= 2 and all(after.get(p) == t for p, t in before.items())  # older files stay for readers of the last version
    want = lambda rows: sorted(map(tuple, keyed.latest_per_key(frame(rows), ["k"], order).collect()))
    got = lambda: sorted(map(tuple, make().read().collect()))
    assert got() == want(all_rows + late)
    make().write(frame(late))  # a replay
    assert got() == want(all_rows + late)
    unchanged = {p for p in files(tmp_path) if "version=1/" in p}
    assert len(unchanged) >= 8 - touched - 0 and len(make()._versions()) == 2
    some = make().lookup(spark.createDataFrame([(7,), (5000,)], "k long"))
    assert [tuple(r) for r in some.collect()] == [(7, 100, "new")]
    assert make().write(frame([])) == 0 and got() == want(all_rows + late)
