"""Structured Streaming forms of the keyed operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vacantia.operators import keyed


class Deltas:
    """A keyed table in a folder as what each epoch changed: an epoch is written as often as it is run, and read by later ones.

    `table` merges the epochs before a given one by `merge`, an aggregate that may be applied to its own results, from the
    newest snapshot on; every `snapshots`-th epoch writes one. Nothing is held in memory, so a restart goes on from here.
    What lies before the last snapshot but one is deleted then: an epoch that is run again needs the one before it only.
    """

    def __init__(self, folder: str, schema: str, merge: Callable[[DataFrame], DataFrame], snapshots: int = 16):
        self.folder, self.schema, self.merge, self.snapshots = folder, schema, merge, snapshots

    def _read(self, spark, kind: str, epochs: list[int]) -> DataFrame | None:
        paths = [f"{self.folder}/{kind}/epoch={e}" for e in epochs]
        return spark.read.schema(self.schema).parquet(*paths) if paths else None

    def _epochs(self, spark, kind: str) -> list[int]:
        """Epochs that were written to the end."""
        root = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}")
        fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        done = lambda p: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
        return sorted(int(s.getPath().getName().removeprefix("epoch=")) for s in fs.listStatus(root) if done(s.getPath()))

    def table(self, spark, before: int | None = None) -> DataFrame:
        """The table after the epochs below `before` (all: None)."""
        fits = lambda kind: [e for e in self._epochs(spark, kind) if before is None or e < before]
        base = fits("snapshot")[-1:]
        rest = [e for e in fits("delta") if not base or e > base[0]]
        found = [x for x in (self._read(spark, "snapshot", base), self._read(spark, "delta", rest)) if x is not None]
        if not found:
            return spark.createDataFrame([], self.schema)
        return self.merge(found[0] if len(found) == 1 else found[0].unionByName(found[1]))

    def put(self, df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/delta/epoch={epoch}")
        if epoch % self.snapshots == self.snapshots - 1:
            self.table(df.sparkSession, epoch + 1).write.mode("overwrite").parquet(f"{self.folder}/snapshot/epoch={epoch}")
            self._clean(df.sparkSession)

    def _clean(self, spark) -> None:
        kept = self._epochs(spark, "snapshot")[-2:][:1]
        for kind in ("snapshot", "delta") if kept else ():
            for e in self._epochs(spark, kind):
                if e < kept[0] or (kind == "delta" and e == kept[0]):
                    path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}/epoch={e}")
                    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def seen_table(folder: str, observations: DataFrame, fields: tuple[str, ...], order: tuple[str, ...], days: int = 30) -> tuple[Deltas, Callable[[DataFrame, int], None]]:
    """A table of sightings by fingerprint and the foreachBatch function that keeps it.

    A late sighting can move the first one back but never overwrites newer fields. Each batch is combined by itself and
    merged in the table, so the stream has no state of its own, however many fingerprints there are. observations:
    fingerprint, fields, order columns; the first order column is the event time (timestamp).
    """
    kind = lambda *names: ", ".join(f"{n}: {observations.schema[n].dataType.simpleString()}" for n in names)
    schema = f"fingerprint {observations.schema['fingerprint'].dataType.simpleString()}, n struct<{kind(*fields)}>, o struct<{kind(*order)}>, first_seen_at timestamp, last_seen_at timestamp, sightings bigint"

    def merge(rows: DataFrame) -> DataFrame:
        return rows.groupBy("fingerprint").agg(F.max_by("n", "o").alias("n"), F.max("o").alias("o"), F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"), F.sum("sightings").alias("sightings"))

    table = Deltas(folder, schema, merge)

    def run(batch: DataFrame, epoch: int) -> None:
        one = batch.select("fingerprint", F.struct(*fields).alias("n"), F.struct(*order).alias("o"), F.col(order[0]).alias("first_seen_at"), F.col(order[0]).alias("last_seen_at"), F.lit(1).cast("long").alias("sightings"))
        table.put(merge(one), epoch)

    return table, run


def seen(table: Deltas, spark, days: int = 30) -> DataFrame:
    """Per fingerprint the newest fields, first and last sighting, expiry `days` after the first."""
    return table.table(spark).select("fingerprint", "n.*", "first_seen_at", "last_seen_at", (F.col("first_seen_at") + F.make_dt_interval(F.lit(days))).alias("expires_at"), "sightings")


def digests(folder: str) -> Deltas:
    """The newest digest of each fingerprint."""
    return Deltas(folder, "fingerprint string, digest string, ts timestamp", lambda rows: rows.groupBy("fingerprint").agg(F.max_by(F.struct("digest", "ts"), F.struct("ts", "digest")).alias("n")).select("fingerprint", "n.*"))


def changed_feed(state: Deltas, emit: Callable[[DataFrame, int], None], digest: str = "digest"):
    """A foreachBatch function: rows that are new or differ from the digest stored before the batch go to `emit`.

    A batch that is run again sees the state of the epochs before it, so it emits the same rows again, under the same
    epoch, and `emit` may overwrite. The state gets what was seen last of each fingerprint, changed or not, so that a
    late row is held against the newest sighting; late rows are left out.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        last = batch.groupBy("fingerprint").agg(F.max_by(F.struct(*[c for c in batch.columns if c != "fingerprint"]), F.struct("ts", digest)).alias("n")).select("fingerprint", "n.*")
        old = state.table(batch.sparkSession, epoch).join(last.select("fingerprint"), "fingerprint", "left_semi").select("fingerprint", F.col("digest").alias(digest), F.col("ts").alias("_at"))
        timely = last.join(old.select("fingerprint", "_at"), "fingerprint", "left").filter("_at IS NULL OR ts >= _at").drop("_at")
        actions = keyed.normalization_action(timely, old.drop("_at"), ["fingerprint"], digest).persist()
        emit(keyed.changed_feed(actions), epoch)
        state.put(actions.select("fingerprint", F.col(digest).alias("digest"), "ts"), epoch)
        actions.unpersist()

    return run


def version_table(folder: str, keep_days: int = 30) -> Deltas:
    """When each digest of a fingerprint was last seen; one that isn't seen for `keep_days` of processing time is gone."""

    def merge(rows: DataFrame) -> DataFrame:
        newest = rows.groupBy("fingerprint", "digest").agg(F.max_by(F.struct("ts", "at", "epoch"), "epoch").alias("n")).select("fingerprint", "digest", "n.*")
        return newest.filter(F.col("at") > F.current_timestamp() - F.make_dt_interval(F.lit(keep_days)))

    return Deltas(folder, "fingerprint string, digest string, ts timestamp, at timestamp, epoch bigint", merge)


def versions(state: Deltas, emit: Callable[[DataFrame, int], None], digest: str = "digest", more: tuple[str, ...] = ()):
    """A foreachBatch function that gives fingerprint, ts, `digest`, `more` and action of every row to `emit`: CREATED, UPDATED, UNCHANGED or LATE.

    `state` (`version_table`) holds when each digest was last seen; the newest of a fingerprint is its current version. A row
    older than that is LATE, whatever it says, also where the newer sighting changed nothing. A fingerprint without a version
    is new. Inside a batch rows count in the order of ts and digest, so none is late because of another of its batch, and a
    batch is one join and one window, however many fingerprints it has. rows: fingerprint (string), ts (timestamp), the digest
    (string), `more`.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = batch.select("fingerprint", "ts", digest, *more)
        table = state.table(spark, epoch)
        now = table.groupBy(F.col("fingerprint").alias("_f")).agg(F.max(F.struct("ts", "digest")).alias("_now"))
        marked = rows.join(now, F.col("fingerprint").eqNullSafe(F.col("_f")), "left")
        late = F.col("_now").isNotNull() & F.coalesce(F.col("ts") < F.col("_now.ts"), F.col("ts").isNull())
        w = Window.partitionBy("fingerprint", "_late").orderBy("ts", digest)
        old = F.coalesce(F.lag(F.struct("ts", F.col(digest).alias("digest"))).over(w), "_now")
        action = F.when(F.col("_late"), "LATE").when(F.col("_old").isNull(), "CREATED").when(F.col("_old.digest").eqNullSafe(F.col(digest)), "UNCHANGED").otherwise("UPDATED")
        emit(marked.withColumn("_late", late).withColumn("_old", old).select(*rows.columns, action.alias("action")), epoch)
        seen = rows.groupBy("fingerprint", F.col(digest).alias("digest")).agg(F.max("ts").alias("ts"))
        known = table.select(F.col("fingerprint").alias("_f"), F.col("digest").alias("_d"), F.col("ts").alias("_ts"))
        both = seen.join(known, F.col("fingerprint").eqNullSafe(F.col("_f")) & F.col("digest").eqNullSafe(F.col("_d")), "left")
        newer = both.filter(F.col("_d").isNull() | F.col("_ts").isNull() | (F.col("_ts") < F.col("ts")))
        state.put(newer.select("fingerprint", "digest", "ts", F.current_timestamp().alias("at"), F.lit(epoch).cast("long").alias("epoch")), epoch)

    return run


def missing(stages: dict[str, tuple[DataFrame, DataFrame]], key: str = "key", within: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """stage, key, ts of rows of a first stream that no row of a second one with the same key follows within a time.

    stages: name -> (first, second), each with the key and ts. A gap is told once the watermark, `late` behind the newest
    rows of the slowest stream, has passed the end of its time, so what only comes late isn't told, and state goes with the
    watermark. A null key is never followed.
    """
    out = None
    for name, (first, second) in stages.items():
        a = first.select(F.col(key).alias("key"), "ts").withWatermark("ts", late)
        b = second.select(F.col(key).alias("_key"), F.col("ts").alias("_ts")).withWatermark("_ts", late)
        follows = (F.col("key") == F.col("_key")) & (F.col("_ts") >= F.col("ts")) & (F.col("_ts") <= F.col("ts") + F.expr(f"interval {within}"))
        gaps = a.join(b, follows, "left_outer").filter("_ts IS NULL").select(F.lit(name).alias("stage"), "key", "ts")
        out = gaps if out is None else out.unionByName(gaps)
    return out


def intake_kinds(rows: DataFrame, by: str, order: tuple[str, ...], digest: str = "digest", old: DataFrame | None = None) -> DataFrame:
    """day, `by`, new, changed, reseen: observations by whether their fingerprint is new, or its digest another than before.

    rows: fingerprint, `by`, `ts`, digest and the order columns; `old`: digests (fingerprint, digest) from before.
    """
    w = Window.partitionBy("fingerprint").orderBy("_old", *order)
    fresh = rows.select("fingerprint", by, "ts", F.col(digest).alias("_d"), F.lit(1).alias("_old"), *(c for c in order if c != "ts"))
    if old is not None:
        fresh = fresh.unionByName(old.select("fingerprint", F.col("digest").alias("_d"), F.lit(0).alias("_old")), allowMissingColumns=True)
    kinds = fresh.withColumn("_before", F.lag("_d").over(w)).withColumn("_first", F.row_number().over(w) == 1).filter("_old = 1")
    same = F.col("_before").eqNullSafe(F.col("_d"))
    return kinds.groupBy(F.date_trunc("day", "ts").alias("day"), by).agg(F.count_if("_first").alias("new"), F.count_if(~F.col("_first") & ~same).alias("changed"), F.count_if(~F.col("_first") & same).alias("reseen"))


def intake(state: Deltas, emit: Callable[[DataFrame, int], None], by: str, order: tuple[str, ...], digest: str = "digest"):
    """A foreachBatch function: counts of `intake_kinds` of each batch against the digests stored before it.

    Counts of several epochs add up; an epoch that is run again gives the same ones.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        old = state.table(batch.sparkSession, epoch).join(batch.select("fingerprint").distinct(), "fingerprint", "left_semi")
        emit(intake_kinds(batch, by, order, digest, old), epoch)
        newest = batch.groupBy("fingerprint").agg(F.max_by(F.struct(F.col(digest).alias("digest"), "ts"), F.struct(*order)).alias("n")).select("fingerprint", "n.*")
        state.put(newest, epoch)
        batch.unpersist()

    return run


def dedupe(events: DataFrame, keys: list[str], time: str = "ts", horizon: str = "30 days") -> DataFrame:
    """The first of equal keys inside the horizon."""
    return events.withWatermark(time, horizon).dropDuplicatesWithinWatermark(keys)


def lease_timeouts(events: DataFrame, by: str = "job_id", lease_s: int = 60) -> DataFrame:
    """job_id, stuck_since of work that stays PROCESSING beyond its lease. events: job_id (long), status, ts (watermarked)."""
    from pyspark.sql.streaming import StatefulProcessor

    class Lease(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.since = handle.getValueState("since", "ms bigint")

        def handleInputRows(self, key, rows, timerValues):
            import pandas as pd

            # State is read and written once for all rows of a key, not for each of them.
            late, old = [], self.since.get()[0] if self.since.exists() else None
            since = old
            for status, ts in pd.concat(rows).sort_values("ts")[["status", "ts"]].itertuples(index=False):
                ms = pd.Timestamp(ts).as_unit("ns").value // 1_000_000
                if since is not None and ms > since + lease_s * 1000:  # it was stuck before this came, in whichever batch that is
                    late.append(since)
                since = ms if status == "PROCESSING" else None
            if since != old:
                if old is not None:
                    self.handle.deleteTimer(old + lease_s * 1000)
                if since is None:
                    self.since.clear()
                else:
                    self.since.update((since,))
                    self.handle.registerTimer(since + lease_s * 1000)
            if late:
                yield pd.DataFrame({by: [key[0]] * len(late), "stuck_since_ms": late})

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            import pandas as pd

            if self.since.exists():
                ms = self.since.get()[0]
                self.since.clear()
                yield pd.DataFrame({by: [key[0]], "stuck_since_ms": [ms]})

        def close(self):
            pass

    return events.groupBy(by).transformWithStateInPandas(Lease(), f"{by} bigint, stuck_since_ms bigint", "Append", "EventTime")


def daily_intake(events: DataFrame, by: str, time: str = "ts", late: str = "1 day") -> DataFrame:
    """Events per `by` and day; works on a stream or a table."""
    return events.withWatermark(time, late).groupBy(F.window(time, "1 day").alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), by, "n")


def sessions(events: DataFrame, by: str, gap: str = "30 minutes", time: str = "ts") -> DataFrame:
    return events.groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start_at"), F.col("w.end").alias("end_at"), "n")
