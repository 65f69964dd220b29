"""J: the streaming operators over the events table, each run to the end of what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.sources import feed
from vacantia.streaming import streams

c = F.col


def _shared(spark: SparkSession) -> str:
    """A new folder in the cluster's shared one; without that setting, in a local warehouse if all is one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = spark.conf.get("spark.sql.warehouse.dir")
    return f"{named.rstrip('/')}/streams/{uuid.uuid4().hex}"


def _events(spark: SparkSession, d: str) -> DataFrame:
    one = f"{d}/events.parquet"
    schema = spark.read.parquet(one).schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return rows.withColumn("ts", c("ts").cast("timestamp"))


def _finish(df: DataFrame, mode: str, name: str) -> DataFrame:
    """Runs a stream over what is there into a Parquet table of the shared folder."""
    spark, at = df.sparkSession, _shared(df.sparkSession)

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/epoch={epoch}")

    df.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return spark.read.schema(df.schema.add("epoch", "integer")).parquet(f"{at}/out")


def _sightings(events: DataFrame) -> DataFrame:
    return events.select(F.concat_ws(":", "event_type", c("user_id").cast("string")).alias("fingerprint"), "ts", "event_id", "value")


def j1(spark, d):
    at, rows = _shared(spark), _sightings(_events(spark, d))
    table, run = streams.seen_table(f"{at}/seen", rows, ("value", "event_id"), ("ts", "event_id"))
    rows.writeStream.option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(run).start().awaitTermination()
    return streams.seen(table, spark).select("fingerprint", "value", "event_id", *(c(x).cast("timestamp_ntz").alias(x) for x in ("first_seen_at", "last_seen_at")), "sightings")


def _digested(spark, d):
    return _sightings(_events(spark, d)).withColumn("digest", F.sha2((F.col("event_id") % 3).cast("string").cast("binary"), 256))


def _batches(spark, rows, run, at: str) -> None:
    rows.writeStream.option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(run).start().awaitTermination()


def j2(spark, d):
    at = _shared(spark)
    rows = _sightings(_events(spark, d)).withColumn("digest", F.sha2(F.concat_ws("|", c("value").cast("string")).cast("binary"), 256)).select("fingerprint", "ts", "digest")
    emit = lambda df, epoch: df.write.mode("overwrite").parquet(f"{at}/changed/epoch={epoch}")
    _batches(spark, rows, streams.changed_feed(streams.digests(f"{at}/digests"), emit), at)
    return spark.read.parquet(f"{at}/changed").select("fingerprint", "action")


def _split(spark, d, parts: int = 4):
    """The events as a stream of `parts` files, one a batch, by event_id modulo that; so later batches hold older rows."""
    at = _shared(spark)
    events = feed.table(spark, d, "events").withColumn("ts", c("ts").cast("timestamp"))
    for k in range(parts):
        events.filter(c("event_id") % parts == k).repartition(1).write.parquet(f"{at}/batch={k}")
    return _sightings(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/batch=*"))


def j2_versions(spark, d):
    at = _shared(spark)
    rows = _split(spark, d).withColumn("digest", F.sha2((F.floor("value") % 2).cast("string").cast("binary"), 256))
    emit = lambda df, epoch: df.write.mode("overwrite").parquet(f"{at}/versions/epoch={epoch}")
    _batches(spark, rows, streams.versions(streams.version_table(f"{at}/seen"), emit, more=("event_id",)), at)
    return spark.read.parquet(f"{at}/versions").select("event_id", "fingerprint", "action")


def e10_stream(spark, d):
    """Views without a click, and clicks without a purchase, of the same user within an hour."""
    stage = lambda kind: _events(spark, d).filter(c("event_type") == kind).select(c("user_id").alias("key"), "ts")
    gaps = streams.missing({"raw_without_normalized": (stage("view"), stage("click")), "normalized_without_vector": (stage("click"), stage("purchase"))})
    return _finish(gaps, "append", "missing").select("stage", "key", c("ts").cast("timestamp_ntz").alias("ts"))


def j5_kinds(spark, d):
    at = _shared(spark)
    rows = _digested(spark, d).withColumn("kind", F.split_part("fingerprint", F.lit(":"), F.lit(1)))
    emit = lambda df, epoch: df.write.mode("overwrite").parquet(f"{at}/kinds/epoch={epoch}")
    _batches(spark, rows, streams.intake(streams.digests(f"{at}/digests"), emit, "kind", ("ts", "event_id")), at)
    sums = spark.read.parquet(f"{at}/kinds").groupBy("day", "kind").agg(*(F.sum(x).alias(x) for x in ("new", "changed", "reseen")))
    return sums.withColumn("day", c("day").cast("timestamp_ntz"))


def j3(spark, d):
    rows = _events(spark, d).select("user_id", "event_type", "ts")
    out = _finish(streams.dedupe(rows, ["user_id", "event_type"], horizon="60 days"), "append", "dedupe")
    return out.select("user_id", "event_type")


def j4(spark, d):
    conf, old = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set(conf, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows = _events(spark, d).select(c("user_id").alias("job_id"), F.when(c("event_type") == "click", "PROCESSING").otherwise("DONE").alias("status"), "ts").withWatermark("ts", "1 minute")
        out = _finish(streams.lease_timeouts(rows, "job_id", 60), "append", "lease")
    finally:
        spark.conf.set(conf, old) if old else spark.conf.unset(conf)
    return out.select("job_id", "stuck_since_ms")


def j5(spark, d):
    return _finish(streams.daily_intake(_events(spark, d), "event_type"), "append", "intake").select(c("day").cast("timestamp_ntz").alias("day"), "event_type", "n")


def j5b(spark, d):
    e = feed.table(spark, d, "events").withColumn("ts", c("ts").cast("timestamp"))
    return streams.sessions(e, "user_id", "30 minutes").select("user_id", c("start_at").cast("timestamp_ntz").alias("start_at"), c("end_at").cast("timestamp_ntz").alias("end_at"), "n")


QUERIES = {"j1_stream_upsert_seen": j1, "j2_stream_changed_feed": j2, "j2_stream_versions": j2_versions, "e10_stream_reconciliation": e10_stream, "j3_stream_dedupe": j3, "j4_stream_lease_timeout": j4, "j5_windowed_intake": j5, "j5_intake_kinds": j5_kinds, "j5_sessions": j5b}

ORACLES = {
    # A feed that sees all events in one batch, and in several ones of one fingerprint the newest: each is new once.
    "j2_stream_changed_feed": "SELECT DISTINCT event_type || ':' || user_id AS fingerprint, 'CREATED' AS action FROM events",
    "j2_stream_versions": """WITH e AS (SELECT event_id, event_type || ':' || user_id AS f, ts, event_id % 4 AS b, sha256(CAST(CAST(floor(value) AS BIGINT) % 2 AS VARCHAR)) AS d FROM events),
  m AS (SELECT *, coalesce(ts < max(ts) OVER (PARTITION BY f ORDER BY b, ts, d, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS late FROM e),
  n AS (SELECT *, lag(d) OVER (PARTITION BY f ORDER BY b, ts, d, event_id) AS old FROM m WHERE NOT late)
SELECT event_id, f AS fingerprint, CASE WHEN old IS NULL THEN 'CREATED' WHEN old = d THEN 'UNCHANGED' ELSE 'UPDATED' END AS action FROM n UNION ALL SELECT event_id, f, 'LATE' FROM m WHERE late""",
    "e10_stream_reconciliation": """WITH mark AS (SELECT min(t) - INTERVAL 10 MINUTE AS mark FROM (SELECT max(ts) AS t FROM events WHERE event_type IN ('view', 'click', 'purchase') GROUP BY event_type)),
  s AS (SELECT 'raw_without_normalized' AS stage, 'view' AS a, 'click' AS b UNION ALL SELECT 'normalized_without_vector', 'click', 'purchase')
SELECT stage, e.user_id AS key, e.ts FROM s JOIN events e ON e.event_type = a, mark WHERE e.ts + INTERVAL 1 HOUR < mark AND NOT EXISTS (SELECT 1 FROM events n WHERE n.event_type = b AND n.user_id = e.user_id AND n.ts BETWEEN e.ts AND e.ts + INTERVAL 1 HOUR)""",
    "j4_stream_lease_timeout": """WITH e AS (SELECT user_id AS job_id, event_type, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_ts FROM events),
  m AS (SELECT max(ts) - INTERVAL 1 MINUTE AS mark FROM events)
SELECT job_id, CAST(epoch_us(ts) // 1000 AS BIGINT) AS stuck_since_ms FROM e, m WHERE event_type = 'click' AND (next_ts > ts + INTERVAL 60 SECOND OR (next_ts IS NULL AND ts + INTERVAL 60 SECOND <= mark))""",
    "j5_intake_kinds": """WITH e AS (SELECT event_type AS kind, event_type || ':' || user_id AS f, ts, event_id, event_id % 3 AS d FROM events),
  o AS (SELECT *, lag(d) OVER w AS b, row_number() OVER w AS r FROM e WINDOW w AS (PARTITION BY f ORDER BY ts, event_id))
SELECT date_trunc('day', ts) AS day, kind, count(*) FILTER (r = 1) AS new, count(*) FILTER (r > 1 AND b IS DISTINCT FROM d) AS changed, count(*) FILTER (r > 1 AND b IS NOT DISTINCT FROM d) AS reseen FROM o GROUP BY ALL""",
    "j1_stream_upsert_seen": "SELECT event_type || ':' || user_id AS fingerprint, arg_max(value, (ts, event_id)) AS value, arg_max(event_id, (ts, event_id)) AS event_id, min(ts) AS first_seen_at, max(ts) AS last_seen_at, count(*) AS sightings FROM events GROUP BY event_type, user_id",
    "j3_stream_dedupe": "SELECT DISTINCT user_id, event_type FROM events",
    "j5_windowed_intake": "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events) GROUP BY ALL",
    "j5_sessions": "WITH o AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS f, event_id FROM events), s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM o) SELECT user_id, min(ts) AS start_at, max(ts) + INTERVAL 30 MINUTE AS end_at, count(*) AS n FROM s GROUP BY user_id, s",
}
