"""Keyed, incremental and lifecycle operators over observations, jobs and status tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia.sources.shared import sized, written

FIELDS = ("title", "company_name", "salary_text", "experience_text", "location_text", "job_type_text", "posted_text", "deadline_text", "skills_text", "detail_url", "source_code", "source_job_id")
ORDER = ("collected_at", "l_orderkey", "l_linenumber")


def fingerprint(source: Column, job_id: Column, url: Column, title: Column, company: Column) -> Column:
    """`source:id`, or a digest of source, url, title and company where the id is blank; null parts are spelt `null`."""
    text = lambda c: F.coalesce(c, F.lit("null"))
    digest = F.sha2(F.concat_ws("|", *map(text, (source, url, title, company))).cast("binary"), 256)
    return F.when(F.trim(F.coalesce(job_id, F.lit(""))) != "", F.concat(source, F.lit(":"), job_id)).otherwise(F.concat(source, F.lit(":URL:"), digest))


def with_fingerprint(observations: DataFrame) -> DataFrame:
    c = F.col
    return observations.withColumn("fingerprint", fingerprint(c("source_code"), c("source_job_id"), c("detail_url"), c("title"), c("company_name")))


def upsert_seen(observations: DataFrame, days: int = 30, order: tuple[str, ...] = ORDER, fields: tuple[str, ...] = FIELDS, combined: bool = False) -> DataFrame:
    """One row per fingerprint: the newest fields by observation time, first and last sighting, expiry `days` after the first.

    One aggregate, so a fingerprint of any number of sightings is combined before the shuffle. Rows of `combined` stand for several sightings
    each, the newest of them, with first_seen_at and sightings: where keys alone can tell so much, long fields needn't be made and sorted for
    every sighting.
    """
    newest = F.max_by(F.struct(*fields), F.struct(*order))
    first, n = (F.min("first_seen_at"), F.sum("sightings")) if combined else (F.min(order[0]), F.count("*"))
    out = observations.groupBy("fingerprint").agg(newest.alias("n"), first.alias("first_seen_at"), F.max(order[0]).alias("last_seen_at"), n.alias("sightings"))
    return out.select("fingerprint", "n.*", "first_seen_at", "last_seen_at", F.col("last_seen_at").alias("collected_at"), (F.col("first_seen_at") + F.make_dt_interval(F.lit(days))).alias("expires_at"), "sightings")


def live(rows: DataFrame, as_of: Column) -> DataFrame:
    return rows.filter(F.col("expires_at") > as_of)


def purge_payload(raw: DataFrame, done: DataFrame, key: str, payload: tuple[str, ...], at: Column, seen: str | None = None) -> DataFrame:
    """Payload columns of rows whose key is in `done` become null and are stamped; others keep theirs, unstamped.

    With `seen`, the time of a row's observation, a row that was observed after its key in `done` (its latest `seen`) keeps its
    payload: a new observation clears the stamp.
    """
    gone = F.coalesce("_done", F.lit(False))
    if seen is None:
        hit = raw.join(done.select(key).distinct().withColumn("_done", F.lit(True)), key, "left")
    else:
        hit = raw.join(done.groupBy(key).agg(F.max(seen).alias("_at")), key, "left").withColumn("_done", F.col(seen) <= F.col("_at")).drop("_at")
    return hit.withColumns({c: F.when(~gone, F.col(c)) for c in payload} | {"raw_payload_purged_at": F.when(gone, at)}).drop("_done")


def normalization_action(new: DataFrame, stored: DataFrame, keys: list[str], digest: str, force: bool = False) -> DataFrame:
    """`new` with `action`: CREATED without a stored row, UPDATED if the digest differs or by force, else UNCHANGED."""
    old = stored.select(*keys, F.col(digest).alias("_old"), F.lit(True).alias("_there"))
    action = F.when(F.col("_there").isNull(), "CREATED").when(F.lit(force) | ~F.col("_old").eqNullSafe(F.col(digest)), "UPDATED").otherwise("UNCHANGED")
    return new.join(old, keys, "left").withColumn("action", action).drop("_old", "_there")


def changed_feed(actions: DataFrame) -> DataFrame:
    return actions.filter("action <> 'UNCHANGED'")


def renormalization_report(actions: DataFrame, key: str, size: int = 500) -> DataFrame:
    """Per page of `size` keys in order: rows by outcome, and whether there is a next page. An `error` column marks failures.

    Pages follow ranks that are counted per range first, so no task sorts all rows; only key and outcome are dealt.
    """
    failed = F.col("error").isNotNull() if "error" in actions.columns else F.lit(False)
    ranked, failed = ranks(actions.select(key, "action", failed.alias("_failed")), [key]), F.col("_failed")
    page = F.floor((F.col("_rank") - 1) / size).cast("long")
    count = lambda c: F.count_if(c)
    out = ranked.groupBy(page.alias("page")).agg(F.count("*").alias("processed"), *(count((F.col("action") == a) & ~failed).alias(a.lower()) for a in ("CREATED", "UPDATED", "UNCHANGED")), count(failed).alias("failed"))
    total = F.sum("processed").over(Window.partitionBy())
    pages = F.max("page").over(Window.partitionBy()) + 1
    return out.select("page", "processed", "created", "updated", "unchanged", "failed", total.alias("total"), pages.alias("pages"), F.when(F.col("page") + 1 < pages, F.col("page") + 1).alias("next_page"))


def ranks(rows: DataFrame, keys: list, parts: int | None = None) -> DataFrame:
    """`rows` with `_rank`, the place in the order of `keys` over all rows, without sorting them in one task.

    Rows are dealt by ranges of the keys and written, so that both readings see the same ranges; each range counts its
    rows, and places add what the ranges before hold. There are as many ranges as the session shuffles to, which a cluster
    sets by its data, or `parts`.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(k) if isinstance(k, str) else k for k in keys]
    dealt = written(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "dealt")
    dealt = dealt.withColumn("_in", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    held = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = held.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")
    return dealt.join(F.broadcast(before), "_part").withColumn("_rank", F.col("_in") + F.col("_before")).drop("_part", "_in", "_before")


def embedding_work_queue(items: DataFrame, status: DataFrame, keys: list[str], points: DataFrame, as_of: Column, lease_s: int = 60, force: bool = False) -> DataFrame:
    """`items` (keys, text_hash, point_id) with `decision`: SKIP_READY, SKIP_LEASED or PROCESS."""
    s = status.select(*keys, F.col("status").alias("_status"), F.col("text_hash").alias("_hash"), F.col("updated_at").alias("_at"))
    there = points.select("point_id").distinct().withColumn("_point", F.lit(True))
    same = F.col("_hash").eqNullSafe(F.col("text_hash"))
    ready = (F.col("_status") == "READY") & same & F.col("_point").isNotNull()
    leased = (F.col("_status") == "PROCESSING") & same & (F.col("_at") > as_of - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(max(60, lease_s)).cast("decimal(18,6)")))
    decision = F.when(F.lit(force), "PROCESS").when(ready, "SKIP_READY").when(leased, "SKIP_LEASED").otherwise("PROCESS")
    return items.join(s, keys, "left").join(there, "point_id", "left").withColumn("decision", decision).drop("_status", "_hash", "_at", "_point")


def latest_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row per key, by one aggregate of structs."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_n")).select(*keys, "_n.*")


def write_keyed(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Insert or replace: rows of both by key, the newest of each."""
    return latest_per_key(old.unionByName(new), keys, order)


def write_table(folder: str, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Inserts or replaces the rows of `new` in the table of a shared folder, and gives the table as it is then.

    Each write is a version of its own beside the last one, which readers keep until the new one is whole; versions older
    than that go. `new` has the table's columns.
    """
    spark = new.sparkSession
    path = lambda *p: spark._jvm.org.apache.hadoop.fs.Path(*p)
    root = path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    there = [s.getPath() for s in fs.listStatus(root)] if fs.exists(root) else []
    whole = sorted(int(p.getName().removeprefix("version=")) for p in there if fs.exists(path(p, "_SUCCESS")))
    old = spark.read.schema(new.schema).parquet(f"{folder}/version={whole[-1]}") if whole else new.limit(0)
    at = f"{folder}/version={(whole[-1] if whole else 0) + 1}"
    write_keyed(old, new, keys, order).select(*new.columns).write.mode("overwrite").parquet(at)
    for v in whole[:-1]:
        fs.delete(path(f"{folder}/version={v}"), True)
    return spark.read.schema(new.schema).parquet(at)


def reconciliation(stages: dict[str, tuple[DataFrame, DataFrame, str]]) -> DataFrame:
    """Per named gap how many keys of the first frame the second lacks."""
    parts = [a.join(b.select(key), key, "left_anti").select(F.lit(name).alias("stage")) for name, (a, b, key) in stages.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("stage").agg(F.count("*").alias("missing"))


# The moves of a file's status that are legal.
MOVES = (("UPLOADED", "PARSING"), ("FAILED", "PARSING"), ("PARSING", "PARSED"), ("PARSING", "FAILED"))


def transition_audit(events: DataFrame, key: str, status: str, order: list[str], moves: tuple = MOVES, version: str | None = None, upgrades: tuple = ("PARSED",)) -> DataFrame:
    """Moves that aren't in `moves`, with how often each occurs.

    With `version`, a status in `upgrades` may begin work (the `after` of its first legal move) again where the version rises,
    and only there.
    """
    w = Window.partitionBy(key).orderBy(*order)
    rises = F.lit(False) if version is None else F.coalesce(F.col(version) > F.lag(version).over(w), F.lit(False))
    pairs = events.select(F.lag(status).over(w).alias("before"), F.col(status).alias("after"), rises.alias("rises")).filter("before IS NOT NULL AND before <> after")
    pairs = pairs.filter(~(F.col("rises") & F.col("before").isin(*upgrades) & (F.col("after") == moves[0][1])))
    legal = events.sparkSession.createDataFrame(list(moves), "before string, after string")
    return pairs.groupBy("before", "after").agg(F.count("*").alias("n")).join(F.broadcast(legal), ["before", "after"], "left_anti")


def duplicate_content(rows: DataFrame, key: str, text: str) -> DataFrame:
    digest = F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)
    return rows.groupBy(digest.alias("digest")).agg(F.count("*").alias("n"), F.min(key).alias("survivor")).filter("n > 1")
