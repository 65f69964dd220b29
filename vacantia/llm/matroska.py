"""Media columns in Matroska: texts as 8-bit mono samples in a container, and containers as packet tables."""

from __future__ import annotations

import hashlib
import struct
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ebml
from .scratch import written

#: Samples a frame, frames a block, blocks a cluster; samples a second.
FRAME, LACE, BLOCKS, RATE = 192, 8, 32, 8000

PACKETS = "track int, timestamp_ns bigint, duration_ns bigint, offset bigint, size bigint, keyframe boolean, lacing int, cluster int"
TRACKS = "track int, type int, codec string, duration_ns bigint, rate double, channels int, bits int"


def _head() -> bytes:
    e, n = ebml.element, ebml.number
    head = e(ebml.EBML, n(0x4286, 1) + n(0x42F7, 1) + n(0x42F2, 4) + n(0x42F3, 8) + e(0x4282, b"matroska") + n(0x4287, 4) + n(0x4285, 2))
    audio = e(0xE1, e(0xB5, struct.pack(">d", RATE)) + n(0x9F, 1) + n(0x6264, 8))
    track = e(ebml.TRACK_ENTRY, n(ebml.TRACK_NUMBER, 1) + n(0x73C5, 1) + n(0x83, 2) + n(0x9C, 1) + n(ebml.DEFAULT_DURATION, FRAME * 1_000_000_000 // RATE) + e(ebml.CODEC, b"A_PCM/INT/LIT") + audio)
    return head, e(ebml.INFO, n(ebml.TIMESTAMP_SCALE, 1_000_000) + e(0x4D80, b"vacantia") + e(0x5741, b"vacantia")) + e(ebml.TRACKS, track)


_EBML_HEAD, _SEGMENT_HEAD = _head()


def mux(payload: bytes) -> bytes:
    """A container of `payload` (a multiple of 192 bytes): frames of 192 samples in laced blocks, clusters, and a cue for each.

    Blocks take the four kinds of lacing in turn, so that reading back exercises all of them.
    """
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    blocks, at, kind = [], 0, 0
    while at < len(frames):
        lacing = kind % 4
        part = frames[at : at + (1 if lacing == ebml.NONE else LACE)]
        blocks.append((at * FRAME * 1000 // RATE, lacing, part))
        at, kind = at + len(part), kind + 1
    body, cues = [_SEGMENT_HEAD], []
    place = len(_SEGMENT_HEAD)
    for k in range(0, len(blocks), BLOCKS):
        base = blocks[k][0]
        inner = [ebml.number(ebml.TIMESTAMP, base)]
        for time, lacing, part in blocks[k : k + BLOCKS]:
            inner.append(ebml.element(ebml.SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", time - base, 0x80 | lacing << 1) + ebml.laced(part, lacing)))
        cluster = ebml.element(ebml.CLUSTER, b"".join(inner))
        cues.append(ebml.element(ebml.CUE_POINT, ebml.number(ebml.CUE_TIME, base) + ebml.element(ebml.CUE_POSITIONS, ebml.number(ebml.CUE_TRACK, 1) + ebml.number(ebml.CUE_CLUSTER, place))))
        body.append(cluster)
        place += len(cluster)
    body.append(ebml.element(ebml.CUES, b"".join(cues)))
    return _EBML_HEAD + ebml.element(ebml.SEGMENT, b"".join(body))


def padded(text: str | None) -> tuple[bytes, int]:
    """The text's UTF-8 with spaces up to a positive multiple of 192, and its length without them."""
    raw = (text or "").encode()
    return raw + b" " * (max(1, -(-len(raw) // FRAME)) * FRAME - len(raw)), len(raw)


def feature(samples, packets: list, cues: int) -> str:
    """Packets, clusters, cues, end of the last packet, mean, root mean square and zero crossings of 8-bit samples around 128.

    packets: (timestamp, duration, cluster) of each.
    """
    import numpy as np

    x = np.frombuffer(samples, dtype=np.uint8).astype(np.int32) - 128
    total, squares = int(x.sum()), int((x * x).sum())
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    ms = max((t + (d or 0) for t, d, _ in packets), default=0) // 1_000_000
    return f"packets={len(packets)};clusters={len({c for *_, c in packets})};cues={cues};ms={ms};mean={total / max(1, len(x)):.4f};rms={(squares / max(1, len(x))) ** 0.5:.4f};zc={crossings}"


def contained(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and `media`, the container of each text (null: empty), one row for each row of `docs`."""

    def run(batches):
        import pyarrow as pa

        from . import texts

        for s in texts.slices(batches):
            made = [padded(t.as_py()) for t in s.column("text")]
            yield pa.RecordBatch.from_arrays([s.column("doc_id"), pa.array([n for _, n in made], pa.int64()), pa.array([mux(p) for p, _ in made], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n_bytes bigint, media binary")


def parsed(media: DataFrame) -> DataFrame:
    """`media` (doc_id, n_bytes, media) with its packets, tracks and number of cues, or an `error` and nulls."""

    def run(batches):
        import pyarrow as pa

        from . import texts

        lists = [pa.list_(pa.struct([(x.split()[0], {"int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "string": pa.string()}[x.split()[1]]) for x in spec.split(", ")])) for spec in (PACKETS, TRACKS)]
        names = [[x.split()[0] for x in spec.split(", ")] for spec in (PACKETS, TRACKS)]

        def column(rows: list, k: int) -> pa.Array:
            """An array of lists of structs from lists of tuples, built by field."""
            offsets = [0]
            for r in rows:
                offsets.append(offsets[-1] + len(r or ()))
            flat = [x for r in rows for x in r or ()]
            kinds = [lists[k].value_type.field(i).type for i in range(len(names[k]))]
            fields = [pa.array(c, t) for c, t in zip(zip(*flat, strict=True) if flat else [()] * len(kinds), kinds, strict=True)]
            return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, names[k]), mask=pa.array([r is None for r in rows]))

        for s in texts.slices(batches, "media"):
            packets, tracks, cues, errors = [], [], [], []
            for data in s.column("media"):
                try:
                    if not data.is_valid:
                        raise ebml.Malformed("null")
                    p, c, t = ebml.parse(data.as_py())
                    packets.append(p)
                    tracks.append([(x["number"], x["type"], x["codec"], x["duration"], x["rate"], x["channels"], x["bits"]) for x in t.values()])
                    cues.append(len(c))
                    errors.append(None)
                except ebml.Malformed as e:
                    packets.append(None)
                    tracks.append(None)
                    cues.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays(
                [*(s.column(c) for c in ("doc_id", "n_bytes", "media")), column(packets, 0), column(tracks, 1), pa.array(cues, pa.int32()), pa.array(errors, pa.string())],
                ["doc_id", "n_bytes", "media", "packets", "tracks", "cues", "error"],
            )

    inner = lambda spec: ", ".join(x.replace(" ", ": ") for x in spec.split(", "))
    rows = media.select(F.col("doc_id").cast("long").alias("doc_id"), *((F.col(c) if c in media.columns else F.lit(None)).cast(t).alias(c) for c, t in (("n_bytes", "long"), ("media", "binary"))))
    return rows.mapInArrow(run, f"doc_id bigint, n_bytes bigint, media binary, packets array<struct<{inner(PACKETS)}>>, tracks array<struct<{inner(TRACKS)}>>, cues int, error string")


def packet_table(media: DataFrame) -> DataFrame:
    """A row per packet of `media` (doc_id, media): track, codec, time, duration, byte range, keyframe, lacing, cluster.

    A null or malformed container gives one row with `error` and null packet columns; an empty one none.
    """
    rows = parsed(media)
    none = F.array(F.lit(None).cast(rows.schema["packets"].dataType.elementType))
    codec = F.get(F.filter("tracks", lambda t: t["track"] == F.col("p.track")), F.lit(0))["codec"]
    each = rows.select("doc_id", "tracks", "error", F.explode(F.when(F.col("error").isNotNull(), none).otherwise(F.col("packets"))).alias("p"))
    return each.select("doc_id", "p.*", codec.alias("codec"), "error")


def track_table(media: DataFrame) -> DataFrame:
    """A row per track of `media` (doc_id, media): number, type, codec, default duration, and rate, channels, bits of audio."""
    return parsed(media).select("doc_id", F.inline("tracks"))


DIGEST = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, n_packets bigint, n_clusters bigint"


def _digests(batches):
    import pyarrow as pa

    from . import texts

    sha = lambda x: hashlib.sha256(x).hexdigest()
    types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
    names = [x.split()[0] for x in DIGEST.split(", ")]
    for s in texts.slices(batches, "media"):
        lists, rows = s.column("packets"), []
        at, size, time, duration, cluster = (lists.values.field(i).to_pylist() for i in (3, 4, 1, 2, 7))
        ends = lists.offsets.to_pylist()
        for k, (n, data, cues) in enumerate(zip(*(s.column(c).to_pylist() for c in ("n_bytes", "media", "cues")), strict=True)):
            a, b = ends[k], ends[k + 1]
            view = memoryview(data)
            back = b"".join(view[o : o + m] for o, m in zip(at[a:b], size[a:b], strict=True))
            packets = list(zip(time[a:b], duration[a:b], cluster[a:b], strict=True))
            rows.append((n, len(back), sha(back), zlib.crc32(back[-16:]), len(data), sha(data), feature(back, packets, cues), b - a, len(set(cluster[a:b]))))
        yield pa.RecordBatch.from_arrays([s.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], names)


def media_digests(docs: DataFrame) -> DataFrame:
    """Each text stored in a container and read back through its packet table: sizes, digests and a feature string.

    `docs` has doc_id and text; other columns aren't read. The containers are a column of a written table; what is read
    from there is parsed, and payload and feature come from the packets' byte ranges and times alone. A null text is an
    empty one, whose payload is 192 spaces. Each row gives a row, repeated rows and null ids too; equal texts give equal
    values; an empty table gives no rows. No shuffle.
    """
    return parsed(written(contained(docs), "media")).select("doc_id", "n_bytes", "media", "packets", "cues").mapInArrow(_digests, DIGEST)
