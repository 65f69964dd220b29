import math

import pytest
from pyspark.sql import functions as F

from vacantia.operators import docs, keyed, match, vectors
from vacantia.sources import taxonomy


def test_experience_union(spark):
    m = lambda y, n: y * 12 + n - 1
    rows = [("a", m(2020, 1), m(2022, 12)), ("a", m(2022, 6), m(2024, 6)), ("b", 5, 4), ("c", 1, 3), ("c", 4, 6), ("c", 2, 2)]
    got = {r.k: (r.months, r.years) for r in docs.experience_years(spark.createDataFrame(rows, "k string, start_month int, end_month int"), "k").collect()}
    assert got == {"a": (54, 4.5), "c": (6, 0.5)}


def test_experience_union_ignores_order(spark):
    rows = [("a", s, s + n) for s, n in ((1, 3), (2, 9), (15, 1), (16, 2), (40, 0))]
    f = lambda r: docs.experience_years(spark.createDataFrame(r, "k string, start_month int, end_month int"), "k").first().months
    assert f(rows) == f(rows[::-1]) == len({m for _, a, b in rows for m in range(a, b + 1)})


def test_explicit_years(spark):
    df = spark.createDataFrame([("more than 5 years of experience",), ("no",)], "t string")
    assert [r[0] for r in df.select(docs.explicit_years(F.col("t"))).collect()] == [5.0, None]


def test_skill_matches(spark):
    df = spark.createDataFrame([(1, "JavaScript"), (2, "SQL Server"), (3, "SQL Server, SQL"), (4, "c++ and C#, node.js.")], "doc_id long, text string")
    got: dict = {}
    for r in docs.match_skills(df, taxonomy.skills(spark)).collect():
        got.setdefault(r.doc_id, set()).add(r.canonical)
    assert got == {1: {"JavaScript"}, 2: {"SQL Server"}, 3: {"SQL Server", "SQL"}, 4: {"C++", "C#", "Node.js"}}


def test_skill_hits_are_dealt_by_the_size_of_their_input(spark, tmp_path):
    """Tasks get no more hits when the input grows: their number does."""
    from vacantia.sources import shared

    text = F.concat(F.lit("SQL Server, red bolt and java "), F.repeat(F.md5(F.col("id").cast("string")), 20))
    tasks = []
    for n in (4_000, 12_000):
        path = str(tmp_path / f"t{n}")
        spark.range(n).select(F.col("id").alias("doc_id"), text.alias("text")).write.parquet(path)
        df = spark.read.parquet(path)
        size = sum(f.stat().st_size for f in (tmp_path / f"t{n}").glob("*.parquet"))
        share, shared.DEALT_BYTES = shared.DEALT_BYTES, 10_000
        try:
            out = docs.match_skills(df, taxonomy.skills(spark))
            tasks.append(out.rdd.getNumPartitions())
        finally:
            shared.DEALT_BYTES = share
        assert tasks[-1] == max(spark.sparkContext.defaultParallelism, -(-size // 10_000))
        assert {r.canonical: r["count"] for r in out.groupBy("canonical").count().collect()} == {"SQL Server": n, "Red Bolt": n, "Java": n}
    assert tasks[1] > 2 * tasks[0] > 2 * spark.sparkContext.defaultParallelism


def test_upsert_does_not_depend_on_order(spark):
    fields = ("title",)
    rows = [("f", i, i % 3, 1, f"t{i}") for i in range(6)]
    make = lambda r: spark.createDataFrame(r, "fingerprint string, d int, l_orderkey int, l_linenumber int, title string").withColumn("collected_at", F.to_timestamp(F.lit("2024-01-01")) + F.make_dt_interval("d"))
    a, b = (keyed.upsert_seen(make(r), fields=fields).collect() for r in (rows, rows[::-1]))
    assert a == b and a[0].title == "t5" and a[0].sightings == 6 and (a[0].expires_at - a[0].first_seen_at).days == 30


def test_ranks(spark):
    df = spark.range(1000).withColumn("v", F.xxhash64("id"))
    got = [r.id for r in keyed.ranks(df, ["v"]).orderBy("_rank").collect()]
    assert got == [r.id for r in df.orderBy("v").collect()]


def test_ranking_config():
    with pytest.raises(ValueError):
        match.Ranking(vector=0.9)
    with pytest.raises(ValueError):
        match.Ranking(pool=5, limit=20)


def test_embedding(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "i int, t string")
    got = {r.i: list(r.embedding) for r in vectors.embed_batch(df, "t").collect()}
    assert got[1] == got[2] != got[3] and all(abs(math.sqrt(sum(x * x for x in v)) - 1) < 1e-5 for v in got.values())


def test_point_id(spark):
    import uuid

    got = spark.range(5).select("id", vectors.point_id(F.concat(F.col("id").cast("string"), F.lit(":v"))).alias("p")).collect()
    assert [r.p for r in got] == [str(uuid.uuid5(uuid.NAMESPACE_URL, f"{r.id}:v")) for r in got]


def test_an_items_expression_is_written_once(spark):
    from pyspark.sql import functions as F

    from vacantia.operators import docs

    body = "- Small  Ring (basic), Frobbing: etc; tools\n• Größe & Maß | sentence with five whole words | " + "x" * 41 + "|  "
    parts = spark.createDataFrame([(1, "SKILLS", body), (2, "HEADER", body), (3, "SKILLS", None)], "doc_id long, section_type string, content string")
    out = docs.unknown_skills(parts, spark.createDataFrame([("small ring",)], "alias string"))
    assert sorted(r.skill for r in out.collect()) == ["Größe & Maß"]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") < 40  # it was 255, more than a generated method holds


def test_levels_by_one_pattern(spark):
    from vacantia.operators import docs

    aliases = spark.createDataFrame([("c++", "C++"), ("red bolt", "Bolt"), ("bolt", "Bolt"), ("a.b", "A.B")], "alias string, canonical string")
    texts = ["C++ (advanced)", "c++, basic; C++: beginner", "xc++ - expert", "bolt " + "y" * 61 + " (basic)", "Red Bolt - expert, bolt (basic)", "bolt then\nred bolt: Advanced", "axb (basic) a.b (experts) a.b -\n expert", "\0bolt (intermediate)", None, "bolt"]
    out = docs.skill_proficiency(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), aliases)
    got = sorted((r.doc_id, r.canonical, r.level) for r in out.collect())
    assert got == [(0, "C++", "ADVANCED"), (1, "C++", "BASIC"), (4, "Bolt", "EXPERT"), (5, "Bolt", "ADVANCED"), (6, "A.B", "EXPERT"), (7, "Bolt", "INTERMEDIATE")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "\\Q" not in plan  # a pattern made of a row's alias is compiled for each row


def test_skill_levels_within_a_row(spark):
    """What is found within a document's row is what the tables give, and no document is shuffled."""
    from vacantia.operators import docs

    skills = spark.createDataFrame([("small ring", "Small Ring"), ("ring", "Ring"), ("c++", "C++"), ("red bolt", "Bolt"), ("bolt", "Bolt"), ("a.b", "A.B"), ("big red bolt set", "Set"), ("node.js", "Node.js")], "alias string, canonical string")
    heads = spark.createDataFrame([("skills", "SKILLS"), ("work experience", "WORK_EXPERIENCE"), ("projects", "PROJECTS")], "heading string, section_type string")
    texts = [
        "Ann\nSKILLS\n- C++, small ring; red bolt (advanced)\nWORK EXPERIENCE\nbig red bolt set, ring - expert\nSKILLS\nnode.js: basic | Größe & Maß | tools", "SKILLS\nbolt", "skills\n\n\nWORK  EXPERIENCE:\nred bolt\nred bolt (basic)",
        "c++ -\n expert foo (basic) a.b\nP R O J E C T S\n.a.b (expert), a.b x (beginner) y", "", None, "none at all\n", "SKILLS", "SKILLS\nunheard, of; things\nfor, you\nring", "big red bolt set bolt: " + "y" * 61 + " - expert\nbig red bolt - basic",
        "1. Skills\n* red bolt big red bolt set ring small ring (intermediate); small ring - advanced\nSkills:\nnothing new", "a.b (experts) a.b -\n\n expert; c++ (expert)\n, c++", "Ring,\nadvanced ring - basic (expert) ring (advanced)",
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    one, two = docs.skill_levels(rows, heads, skills), docs.skill_levels(rows, heads, skills, few=0)
    got = sorted(map(str, one.collect()))
    assert got == sorted(map(str, two.select(*one.columns).collect())) and len(got) == 20
    assert "Exchange" not in one._jdf.queryExecution().executedPlan().toString()
    levels = {(r.doc_id, r.canonical): (r.first_source, r.level) for r in one.collect()}
    assert levels[0, "Ring"] == ("WORK_EXPERIENCE", "EXPERT") and levels[0, "Bolt"] == ("SKILLS", "ADVANCED") and levels[0, "Node.js"] == ("SKILLS", "BASIC")
    assert levels[3, "C++"] == ("HEADER", "EXPERT")
