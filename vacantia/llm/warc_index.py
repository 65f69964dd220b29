"""WARC archives of pages with a two-level capture index: sorted compressed blocks of keys, and a sparse directory."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import joined, opened, shared_dir, written

#: Compressed bytes of an archive and captures of an index block, about; payload bytes from which repeats are revisits.
ARCHIVE_BYTES, BLOCK_LINES, LEAST_PAYLOAD = 64 << 20, 1024, 1000
#: Neighbouring records that are read at once, in bytes.
READ_BYTES = 1 << 20
#: Directory entries that are broadcast; beyond, blocks are joined by as many ranges as DIRECTORY over STRIDE.
DIRECTORY, STRIDE = 50_000, 16

CAPTURES = "archive string, key string, page_id bigint, offset bigint, length bigint"


def _write(folder: str):
    """Records into .warc.gz files of `folder`; what is passed on are their captures, never the bytes."""

    def run(batches):
        import hashlib
        import uuid

        import pyarrow as pa

        from . import texts, warc
        from .scratch import opened

        system, path = opened(folder)
        names = [x.split()[0] for x in CAPTURES.split(", ")]
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        name, out, at, n = None, None, 0, 0
        for s in texts.slices(batches, "html"):
            found = []
            for page_id, url, html, digest, refers, refers_url in zip(*(s.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to", "refers_url")), strict=True):
                if out is None:
                    name, date = f"pages-{uuid.uuid4().hex}.warc.gz", warc.now()
                    out = system.open_output_stream(f"{path}/{name}", compression=None)
                    head = warc.info(name, date)
                    out.write(head)
                    at, n = len(head), 0
                payload, n = (html or "").encode(), n + 1
                member = warc.page(name, n, date, page_id, url, payload, digest or hashlib.sha1(payload).hexdigest(), refers, refers_url)
                out.write(member)
                found.append((name, warc.surt(url), page_id, at, len(member)))
                at += len(member)
                if at >= ARCHIVE_BYTES:
                    out.close()
                    out = None
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names)
        if out is not None:
            out.close()

    return run


def write_archives(pages: DataFrame, folder: str | None = None) -> tuple[str, DataFrame]:
    """The folder with the .warc.gz files, and the captures in them: archive, key, page_id, offset, length.

    The folder is a new one in the shared folder unless given, as a URI that driver and executors can open. Of equal
    payloads of at least 1000 bytes the one with the largest page_id is a response, the others revisit it. A task that is
    run again writes files of new names; only those of the run that Spark kept have captures.
    """
    if folder is None:
        folder = f"{shared_dir(pages.sparkSession)}/vacantia/archives-{uuid.uuid4().hex}"
    system, path = opened(folder)
    system.create_dir(path, recursive=True)
    raw = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(raw).alias("digest"), F.octet_length(raw).alias("size"))
    newest = F.max_by(F.struct(F.col("page_id").alias("last"), F.col("url").alias("last_url")), F.struct("page_id", "url")).alias("x")
    sums = rows.filter(F.col("size") >= LEAST_PAYLOAD).groupBy("digest", "size").agg(newest, F.count("*").alias("n"))
    last = written(sums.filter("n > 1").select("digest", "size", "x.*", "n"), "repeated-payloads")
    total = last.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = joined(rows, last, ["digest", "size"], "left", total)
    revisit = ~F.col("page_id").eqNullSafe(F.col("last"))
    rows = rows.select("page_id", "url", "html", "digest", F.when(revisit, F.col("last")).alias("refers_to"), F.when(revisit, F.col("last_url")).alias("refers_url"))
    return folder, written(rows.mapInArrow(_write(folder), CAPTURES), "captures")


def _blocks(most: int):
    """Sorted captures as compressed blocks of `most` lines, each with its first and last capture."""

    def run(batches):
        import json
        import uuid
        import zlib

        import pyarrow as pa

        lines: list[tuple] = []

        def out(part):
            text = "\n".join(json.dumps(line) for line in part)
            ends = [pa.array([x[i]], t) for x in (part[0], part[-1]) for i, t in ((0, pa.string()), (1, pa.int64()))]
            return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), *ends, pa.array([zlib.compress(text.encode(), 6)], pa.binary())], ["block", "first_key", "first_id", "last_key", "last_id", "data"])

        for b in batches:
            lines += zip(*(b.column(c).to_pylist() for c in ("key", "page_id", "archive", "offset", "length")), strict=True)
            while len(lines) >= most:
                yield out(lines[:most])
                lines = lines[most:]
        if lines:
            yield out(lines)

    return run


def capture_index(captures: DataFrame, lines: int = BLOCK_LINES) -> DataFrame:
    """Index blocks: captures in the order of (key, page_id), compressed, with the first and last of each block."""
    captures = captures.select(F.coalesce("key", F.lit("")).alias("key"), "page_id", "archive", "offset", "length")
    ordered = captures.repartitionByRange("key", "page_id", "offset").sortWithinPartitions("key", "page_id", "archive", "offset")
    return written(ordered.mapInArrow(_blocks(lines), "block string, first_key string, first_id bigint, last_key string, last_id bigint, data binary"), "index-blocks")


def _order(key: str | None, page_id: int | None) -> tuple:
    """The order of Spark's sort: keys by UTF-8 bytes, null ids first."""
    return (key or "").encode(), page_id is not None, page_id or 0


def _find(directory: list[tuple]):
    """Pairs of a wanted capture and a block that may hold it, by binary search in the directory."""

    def run(batches):
        import bisect

        import pyarrow as pa

        firsts, lasts = [_order(d[1], d[2]) for d in directory], [_order(d[3], d[4]) for d in directory]
        for b in batches:
            keys, ids, blocks = [], [], []
            for k, p in zip(b.column("key").to_pylist(), b.column("page_id").to_pylist(), strict=True):
                want = _order(k, p)
                for i in range(bisect.bisect_left(lasts, want), bisect.bisect_right(firsts, want)):
                    keys.append(k)
                    ids.append(p)
                    blocks.append(directory[i][0])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(ids, pa.int64()), pa.array(blocks, pa.string())], ["key", "page_id", "block"])

    return run


def _in_blocks(batches):
    """The captures of the wanted keys of each block, by binary search in its lines."""
    import bisect
    import json
    import zlib

    import pyarrow as pa

    kinds = (pa.string(), pa.int64(), pa.int64())
    for b in batches:
        rows = []
        for data, wanted in zip(b.column("data").to_pylist(), b.column("wanted").to_pylist(), strict=True):
            lines = [json.loads(x) for x in zlib.decompress(data).split(b"\n")]
            order = [_order(x[0], x[1]) for x in lines]
            for w in wanted:
                want = _order(w["key"], w["page_id"])
                for i in range(bisect.bisect_left(order, want), bisect.bisect_right(order, want)):
                    rows.append(tuple(lines[i][2:]))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else ((), (), ()), kinds, strict=True)], ["archive", "offset", "length"])


def look_up(wanted: DataFrame, blocks: DataFrame) -> DataFrame:
    """archive, offset, length of every capture of the `wanted` (key, page_id), which are made distinct first."""
    wanted = wanted.select(F.coalesce("key", F.lit("")).alias("key"), F.col("page_id").cast("long").alias("page_id")).distinct()
    directory = blocks.select("block", "first_key", "first_id", "last_key", "last_id")
    schema = "key string, page_id bigint, block string"
    if blocks.count() <= DIRECTORY:
        found = wanted.mapInArrow(_find(sorted(map(tuple, directory.collect()), key=lambda d: _order(d[1], d[2]))), schema)
    else:
        found = _by_range(wanted, directory)
    each = found.groupBy("block").agg(F.collect_list(F.struct("key", "page_id")).alias("wanted"))
    return blocks.select("block", "data").join(each, "block").select("data", "wanted").mapInArrow(_in_blocks, "archive string, offset bigint, length bigint")


def _parts(bounds: list[tuple], first: tuple[str, str], last: tuple[str, str] | None, names: list[str]):
    """Rows with `part`, the ranges between `bounds` from their first to their last capture (or that of the first)."""

    def run(batches):
        import bisect

        import pyarrow as pa

        for b in batches:
            at = [bisect.bisect_right(bounds, _order(k, p)) for k, p in zip(b.column(first[0]).to_pylist(), b.column(first[1]).to_pylist(), strict=True)]
            end = at if last is None else [bisect.bisect_right(bounds, _order(k, p)) for k, p in zip(b.column(last[0]).to_pylist(), b.column(last[1]).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array([list(range(x, y + 1)) for x, y in zip(at, end, strict=True)], pa.list_(pa.int32()))], [*names, "parts"])

    return run


def _by_range(wanted: DataFrame, directory: DataFrame) -> DataFrame:
    """The same pairs when the directory is too large to broadcast: blocks and wanted captures meet by ranges of captures.

    Range bounds are a bounded sample of the directory's first captures, ids included, so a hot key has many ranges; a
    block counts for every range that it touches.
    """
    some = directory.orderBy(F.xxhash64("block"), "block").limit(max(1, DIRECTORY // STRIDE)).select("first_key", "first_id").collect()
    bounds = sorted(_order(r.first_key, r.first_id) for r in some)
    names = ["block", "first_key", "first_id", "last_key", "last_id"]
    near = directory.mapInArrow(_parts(bounds, ("first_key", "first_id"), ("last_key", "last_id"), names), "block string, first_key string, first_id bigint, last_key string, last_id bigint, parts array<int>")
    left = wanted.mapInArrow(_parts(bounds, ("key", "page_id"), None, ["key", "page_id"]), "key string, page_id bigint, parts array<int>")
    near, left = (x.withColumn("part", F.explode("parts")).drop("parts") for x in (near, left))
    id_ = lambda c: F.coalesce(F.col(c), F.lit(-(1 << 63)))
    low = (F.col("key") > F.col("first_key")) | ((F.col("key") == F.col("first_key")) & (id_("page_id") >= id_("first_id")))
    high = (F.col("key") < F.col("last_key")) | ((F.col("key") == F.col("last_key")) & (id_("page_id") <= id_("last_id")))
    return left.join(near, "part").filter(low & high).select("key", "page_id", "block")


def _read(folder: str):
    """The records at the ranges of each archive: the file is opened, each run of neighbouring records is sought and read."""

    def run(batches):
        import pyarrow as pa

        from . import warc
        from .scratch import opened

        system, path = opened(folder)
        fields = (("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()), ("date", pa.string()))
        for b in batches:
            for name, ranges in zip(b.column("archive").to_pylist(), b.column("ranges").to_pylist(), strict=True):
                ranges = sorted((r["offset"], r["length"]) for r in ranges)
                with system.open_input_file(f"{path}/{name}") as f:
                    i = 0
                    while i < len(ranges):
                        j, end = i + 1, ranges[i][0] + ranges[i][1]
                        while j < len(ranges) and ranges[j][0] <= end and end - ranges[i][0] < READ_BYTES:
                            end, j = max(end, ranges[j][0] + ranges[j][1]), j + 1
                        f.seek(ranges[i][0])
                        data = memoryview(f.read(end - ranges[i][0]))
                        got = [warc.read(data[o - ranges[i][0] : o - ranges[i][0] + n]) for o, n in ranges[i:j]]
                        yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], t) for k, t in fields], [k for k, _ in fields])
                        i = j

    return run


def read_ranges(folder: str, captures: DataFrame) -> DataFrame:
    """The records at `captures` (archive, offset, length): page_id, url, payload_bytes, payload_digest, type, refers_to, record_id, date."""
    each = captures.groupBy("archive").agg(F.collect_list(F.struct("offset", "length")).alias("ranges"))
    return each.mapInArrow(_read(folder), "page_id bigint, url string, payload_bytes bigint, payload_digest string, type string, refers_to bigint, record_id string, date string")


def archived(pages: DataFrame) -> DataFrame:
    """Pages written to archives, indexed, looked up by key and read back by byte range: one row per page.

    page_id, payload_bytes, payload_digest (hex SHA-1), record_type, refers_to, url. `pages` has page_id, url and html;
    other columns aren't read. A null html is an empty payload; a null url has the empty key. Equal rows each give a
    row; equal payloads under the largest page_id are all responses. A null id counts as below all others. An empty
    table gives no rows.
    """
    folder, captures = write_archives(pages)
    records = read_ranges(folder, look_up(captures.select("key", "page_id"), capture_index(captures)))
    return records.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to", "url")


ORACLE = """
WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS raw FROM pages),
d AS (SELECT page_id, url, CAST(octet_length(raw) AS BIGINT) AS payload_bytes, sha1(raw) AS payload_digest FROM p),
m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS m FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN m IS NULL OR page_id = m THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM m THEN m END AS refers_to, url FROM m
"""
