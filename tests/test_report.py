"""A report deals keys and outcomes only."""

from vacantia.operators import keyed


def test_a_report_deals_keys_and_outcomes_only(spark, monkeypatch):
    dealt, ranks = [], keyed.ranks
    monkeypatch.setattr(keyed, "ranks", lambda rows, *a: dealt.append(rows.columns) or ranks(rows, *a))
    rows = spark.createDataFrame([(1, "CREATED", "wide", None), (2, "UPDATED", "wide", "bad"), (3, "UNCHANGED", "wide", None)], "k int, action string, costly string, error string")
    got = keyed.renormalization_report(rows, "k", 2).orderBy("page").collect()
    assert dealt == [["k", "action", "_failed"]]
    assert [(r.processed, r.created, r.updated, r.unchanged, r.failed) for r in got] == [(2, 1, 0, 0, 1), (1, 0, 0, 1, 0)]


def test_the_keyed_table_reads_its_feed_once(spark, monkeypatch):
    from conftest import SF
    from vacantia.operators import tables
    from vacantia.plans import job_queries

    plans, write = [], tables.KeyedTable.write
    monkeypatch.setattr(tables.KeyedTable, "write", lambda self, new: plans.append(new._jdf.queryExecution().optimizedPlan().toString()) or write(self, new))
    assert job_queries.a3_table(spark, SF).count() > 0
    assert len(plans) == 4 and not any("Join" in p for p in plans)
