"""State of streams: versions over epochs that are run again, and leases whose state is touched once a key."""

import datetime

from vacantia.streaming import streams


def test_versions_over_epochs(spark, tmp_path):
    at = lambda m: datetime.datetime(2001, 1, 1, 0, m)
    batches = [
        [("a", at(5), "x", 1), ("a", at(6), "y", 2), ("b", at(1), "x", 3), (None, at(1), "x", 4)],
        [("a", at(4), "y", 5), ("a", at(6), "y", 6), ("a", at(7), "y", 7), ("b", None, "x", 8), ("c", at(2), None, 9), (None, at(2), "x", 10)],
        [("a", at(5), "x", 11), ("a", at(8), "x", 12), ("c", at(2), None, 13), ("b", at(1), "z", 14)],
    ]
    got = {}
    state = streams.version_table(f"{tmp_path}/seen")
    run = streams.versions(state, lambda df, epoch: got.update({epoch: {r.id: r.action for r in df.collect()}}), more=("id",))
    for again in (False, True):
        for k, rows in enumerate(batches):
            run(spark.createDataFrame(rows, "fingerprint string, ts timestamp, digest string, id int"), k)
            if again:  # an epoch that is run again sees what was before it
                run(spark.createDataFrame(rows, "fingerprint string, ts timestamp, digest string, id int"), k)
        assert got[0] == {1: "CREATED", 2: "UPDATED", 3: "CREATED", 4: "CREATED"}
        assert got[1] == {5: "LATE", 6: "UNCHANGED", 7: "UNCHANGED", 8: "LATE", 9: "CREATED", 10: "UNCHANGED"}
        assert got[2] == {11: "LATE", 12: "UPDATED", 13: "UNCHANGED", 14: "UPDATED"}
    gone = streams.version_table(f"{tmp_path}/seen", keep_days=0)
    assert gone.table(spark).isEmpty() and state.table(spark).filter("fingerprint = 'a'").count() == 2


def test_lease_state_is_touched_once_a_key():
    import pandas as pd

    calls = []

    class Events:
        def groupBy(self, by):
            return self

        def transformWithStateInPandas(self, processor, *rest):
            return processor

    class State:
        value = None

        def getValueState(self, *rest):
            return self

        def __getattr__(self, name):
            def call(*args):
                calls.append(name)
                if name == "exists":
                    return self.value is not None
                if name == "get":
                    return self.value
                if name in ("update", "clear"):
                    self.value = args[0] if args else None

            return call

    lease, state = streams.lease_timeouts(Events(), lease_s=60), State()
    lease.init(state)
    at = lambda *s: pd.DataFrame({"status": ["PROCESSING"] * len(s), "ts": pd.to_datetime(list(s), unit="s")})
    assert [list(x["stuck_since_ms"]) for x in lease.handleInputRows((1,), [at(*range(0, 500, 10))], None)] == []
    assert len(calls) <= 5 and state.value == (490_000,)
    assert [list(x["stuck_since_ms"]) for x in lease.handleInputRows((1,), [at(551, 700)], None)] == [[490_000, 551_000]]
