"""Passages that documents repeat, byte by byte: suffix sorting of the few windows that may be shared.

Every string of `length` bytes has a key, the least hash of the pieces of `length // 2 - 1` bytes inside it, so equal
strings have equal keys wherever they stand, and neighbouring strings mostly have the same one: a *run*. Texts are dealt
to slices once and written as a bucketed table that later steps read without a shuffle:

1. each slice sends four bytes of each of its keys, and hears by a bit for each which of them another document has;
2. of runs with such keys it sends each distinct text once, with the least and the largest document id that has it;
3. what has the same key meets: `bwt.shared_prefixes` on these texts tells which strings are equal, and each slice hears
   where an earlier document has a string, as far as one of its documents comes after that;
4. slices find their runs again, mark the bytes, and give lengths, spans and digests.

A key that more than `hot` slices have is made longer by the least hash under another seed, so that no group of texts
grows with one frequent piece. What slices send is distinct in the slice; copies, however many, send one text a slice.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bwt import shared_prefixes
from .scratch import shared_dir, written

#: Bytes of text meant for a slice, slices at most; keys meant for a bucket, buckets at most.
SLICE, SLICES, KEYS, BUCKETS = 4 << 20, 1 << 22, 1 << 20, 1 << 16
#: Bytes that are suffix-sorted at once; windows hashed at once; slices from which a key is made longer.
SORTED, BLOCK, HOT = 1_500_000, 1 << 15, 4096
NEVER = np.int64((1 << 63) - 1)


def window_keys(data: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """For each window of `length` bytes of `data` the least hash (unsigned 64 bits) of its pieces."""
    piece = max(1, length // 2 - 1)
    width, total = length - piece + 1, len(data) - length + 1
    out = np.empty(max(0, total), np.uint64)
    base = [pow(0x9E3779B97F4A7C15 + 2 * 0x632BE59BD9B4E019 * seed, 1 << k, 1 << 64) for k in range(piece.bit_length())]
    for a in range(0, total, BLOCK):
        block = data[a : a + BLOCK + length - 1].astype(np.uint64)
        block += np.uint64(1)
        h, have = None, 0
        power = block
        for k in range(piece.bit_length()):  # `power` has the hashes of 2^k bytes
            if piece >> k & 1:
                n = len(block) - (have + (1 << k)) + 1
                h = power[:n].copy() if h is None else h[:n] * np.uint64(base[k]) + power[have : have + n]
                have += 1 << k
            if piece >> (k + 1):
                power = power[: len(power) - (1 << k)] * np.uint64(base[k]) + power[1 << k :]
        h *= np.uint64(0xD6E8FEB86659FD93)
        reach = 1
        while 2 * reach <= width:
            h = np.minimum(h[: len(h) - reach], h[reach:])
            reach *= 2
        rest = width - reach
        out[a : a + BLOCK] = np.minimum(h[: len(h) - rest], h[rest:]) if rest else h
    return out


def _mixed(key: np.ndarray) -> np.ndarray:
    """Least hashes are small numbers; these are spread over all 64 bits."""
    for _ in range(2):
        key = (key ^ (key >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return key ^ (key >> np.uint64(32))


class Slice:
    """The documents of a slice in the order of id and text, and the runs of their windows."""

    def __init__(self, table, length: int):
        import pyarrow as pa
        import pyarrow.compute as pc

        table = table.take(pc.sort_indices(table, [("doc_id", "ascending"), ("text", "ascending")]))
        text = table.column("text").combine_chunks()
        text = text.chunk(0) if isinstance(text, pa.ChunkedArray) else text
        self.table, self.length = table, length
        self.ids = pc.fill_null(table.column("doc_id"), int(NEVER)).to_numpy()
        self.named = table.column("doc_id").is_valid().to_numpy()
        self.size = pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64)
        self.data = np.frombuffer(b"".join(text.to_pylist()), np.uint8)
        self.at = np.cumsum(self.size) - self.size
        self.keys = window_keys(self.data, length)
        self._find(self.keys)

    def _find(self, keys):
        """start, windows, doc, key of each run: windows of one document, side by side, with one key."""
        cut = np.zeros(len(keys) + 1, bool)
        np.not_equal(keys[1:], keys[:-1], out=cut[1:-1]) if len(keys) > 1 else None
        usable = np.flatnonzero(self.named & (self.size >= self.length))
        first, end = self.at[usable], self.at[usable] + self.size[usable] - self.length + 1
        cut[first] = cut[end] = True
        start = np.flatnonzero(cut[: len(keys)])
        doc = usable[np.maximum(np.searchsorted(first, start, side="right") - 1, 0)] if len(usable) else start[:0]
        start = start if len(usable) else start[:0]
        inside = (start >= self.at[doc]) & (start <= self.at[doc] + self.size[doc] - self.length)
        stop = np.append(start[1:], len(keys))[inside] if len(start) else start
        self.start, self.doc = start[inside], doc[inside]
        self.windows = np.minimum(stop, self.at[self.doc] + self.size[self.doc] - self.length + 1) - self.start
        self.key = _mixed(keys[self.start])

    def offered(self) -> np.ndarray:
        """The distinct keys in rising order, twice if more than one document of the slice has them."""
        order = np.argsort(self.key)
        key, doc = self.key[order], self.ids[self.doc[order]]
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else order
        several = np.minimum.reduceat(doc, new) < np.maximum.reduceat(doc, new) if len(key) else new.astype(bool)
        return np.repeat(key[new], 1 + several)

    def answered(self, answers: dict[int, tuple[bytes, bytes]], buckets: int):
        """Only runs whose keys are shared; those of frequent keys by longer keys."""
        offered = self.offered()
        bucket = _bucket(offered, buckets)
        shared, hot = np.zeros(len(offered), bool), np.zeros(len(offered), bool)
        for b, (s, h) in answers.items():
            at = np.flatnonzero(bucket == b)
            shared[at] = np.unpackbits(np.frombuffer(s, np.uint8), count=len(at)).astype(bool)
            hot[at] = np.unpackbits(np.frombuffer(h, np.uint8), count=len(at)).astype(bool)
        if hot.any():
            longer = np.isin(self.key, offered[hot])
            window = np.repeat(self.start[longer] - (np.cumsum(self.windows[longer]) - self.windows[longer]), self.windows[longer]) + np.arange(int(self.windows[longer].sum()))
            keys = self.keys.copy()
            keys[window] = _mixed(keys[window]) ^ window_keys(self.data, self.length, seed=1)[window]
            sharedk = np.concatenate([offered[shared & ~hot], _mixed(np.unique(keys[window]))])
            self._find(keys)
        else:
            sharedk = offered[shared]
        keep = np.isin(self.key, sharedk)
        self.start, self.doc, self.windows, self.key = self.start[keep], self.doc[keep], self.windows[keep], self.key[keep]
        return self

    def texts(self):
        """Distinct texts of the runs, as an Arrow array, and the number of each run's text."""
        import pyarrow as pa

        if not len(self.start):
            return pa.array([], pa.binary()), np.zeros(0, np.int64)
        size = self.windows + self.length - 1
        offsets = np.concatenate([[0], np.cumsum(size)])
        gathered = self.data[np.repeat(self.start - offsets[:-1], size) + np.arange(offsets[-1])]
        coded = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(gathered)]).dictionary_encode()
        return coded.dictionary, coded.indices.to_numpy().astype(np.int64)


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


NOTES = "p bigint, b int, shared binary, hot binary, seg binary, first binary, count binary, source binary"


def _offers(length: int, buckets: int):
    def run(table):
        import pyarrow as pa

        p, offered = table.column("p")[0].as_py(), Slice(table, length).offered()
        bucket = _bucket(offered, buckets)
        some = np.unique(bucket)
        parts = [offered[bucket == b].astype(np.uint32).tobytes() for b in some]
        return pa.table({"p": pa.array([p] * len(some), pa.int64()), "b": pa.array(some.astype(np.int32)), "keys": pa.array(parts, pa.binary())})

    return run


def _answers(hot: int):
    def run(table):
        """Which of a slice's keys come twice in the bucket, and which come from more than `hot` slices."""
        import pyarrow as pa

        slices, b = table.column("p").to_pylist(), table.column("b")[0].as_py()
        parts = [np.frombuffer(x, np.uint32) for x in table.column("keys").to_pylist()]
        every = np.concatenate(parts)
        key, code, times = np.unique(every, return_inverse=True, return_counts=True)
        twice = (times > 1)[code]
        often = (times > hot)[code]
        cuts = np.cumsum([len(x) for x in parts])[:-1]
        packed = lambda flags: [np.packbits(x).tobytes() for x in np.split(flags, cuts)]
        some = [k for k, x in enumerate(np.split(twice, cuts)) if x.any()]
        shared, much = packed(twice), packed(often)
        return pa.table({"p": pa.array([slices[k] for k in some], pa.int64()), "b": pa.array([b] * len(some), pa.int32()), "shared": pa.array([shared[k] for k in some], pa.binary()), "hot": pa.array([much[k] for k in some], pa.binary())})

    return run


def _reached(docs, notes, length: int, buckets: int) -> Slice:
    answers = {b: (s, h) for b, s, h in zip(*(notes.column(c).to_pylist() for c in ("b", "shared", "hot")), strict=True) if s is not None}
    return Slice(docs, length).answered(answers, buckets)


def _ordered(found: Slice, code: np.ndarray, texts: int, buckets: int):
    """Bucket, least and largest document id of each distinct text, and each text's number inside its bucket."""
    least, most, bucket = np.full(texts, NEVER), np.full(texts, -NEVER), np.zeros(texts, np.int64)
    np.minimum.at(least, code, found.ids[found.doc])
    np.maximum.at(most, code, found.ids[found.doc])
    bucket[code] = _bucket(found.key, buckets)
    return bucket, least, most


def _sent(length: int, buckets: int):
    def run(docs, notes):
        import pyarrow as pa

        found = _reached(docs, notes, length, buckets) if docs.num_rows and notes.num_rows else None
        out = {k: [] for k in ("p", "b", "size", "texts", "least", "most", "key")}
        if found is not None and len(found.start):
            texts, code = found.texts()
            bucket, least, most = _ordered(found, code, len(texts), buckets)
            key = np.zeros(len(texts), np.uint64)
            key[code] = found.key
            for b in np.unique(bucket):
                at = np.flatnonzero(bucket == b)
                own = texts.take(pa.array(at)).to_pylist()
                for k, v in zip(out, (docs.column("p")[0].as_py(), int(b), np.array([len(x) for x in own], np.uint32).tobytes(), b"".join(own), least[at].tobytes(), most[at].tobytes(), key[at].tobytes()), strict=True):
                    out[k].append(v)
        return pa.table({"p": pa.array(out["p"], pa.int64()), "b": pa.array(out["b"], pa.int32()), **{k: pa.array(out[k], pa.binary()) for k in ("size", "texts", "least", "most", "key")}})

    return run


def earliest(texts: list[bytes], least: np.ndarray, length: int) -> list[np.ndarray]:
    """For each window of each text the least id among all texts that have it."""
    size = np.array([len(x) for x in texts], np.int64)
    owner, window = np.repeat(least, size), np.concatenate([np.arange(n) for n in size])
    owner = np.where(window + length <= np.repeat(size, size), owner, NEVER)
    order, first = shared_prefixes(np.frombuffer(b"".join(texts), np.uint8), length)
    first = np.flatnonzero(first)
    source = np.minimum.reduceat(np.append(owner, NEVER)[order], first)
    out = np.empty(len(order), np.int64)
    out[order] = np.repeat(source, np.diff(np.append(first, len(order))))
    return [x[: max(0, len(x) - length + 1)] for x in np.split(out[:-1], np.cumsum(size)[:-1])]


def _told(length: int, sorted_at_once: int):
    def run(table):
        import pyarrow as pa

        b, slices = table.column("b")[0].as_py(), table.column("p").to_pylist()
        of = lambda c, kind: [np.frombuffer(x, kind) for x in table.column(c).to_pylist()]
        sizes, least, most, keys = of("size", np.uint32), np.concatenate(of("least", np.int64)), np.concatenate(of("most", np.int64)), np.concatenate(of("key", np.uint64))
        count = np.array([len(x) for x in sizes])
        size = np.concatenate(sizes).astype(np.int64)
        joined = pa.py_buffer(b"".join(table.column("texts").to_pylist()))
        coded = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int64)), joined]).dictionary_encode()
        texts, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        first_id, key = np.full(len(texts), NEVER), np.zeros(len(texts), np.uint64)
        np.minimum.at(first_id, code, least)
        key[code] = keys
        # Texts of one key side by side; as many whole keys at once as fit.
        order = np.argsort(key, kind="stable")
        length_of = np.zeros(len(texts), np.int64)
        length_of[code] = size
        group = np.concatenate([[True], key[order][1:] != key[order][:-1]])
        begin = np.flatnonzero(group)
        bytes_of = np.add.reduceat(length_of[order], begin)
        load = np.cumsum(bytes_of) // sorted_at_once
        edges = [0, *(begin[np.flatnonzero(np.diff(load)) + 1]).tolist(), len(order)]
        # Of each distinct text its stretches of windows with the same earliest document.
        text_of, first, many, source = [], [], [], []
        for lo, hi in zip(edges, edges[1:], strict=False):
            part = order[lo:hi]
            found = earliest(texts.take(pa.array(part)).to_pylist(), first_id[part], length)
            windows = np.array([len(x) for x in found])
            flat, whose = np.concatenate(found), np.repeat(np.arange(len(part)), windows)
            place = np.arange(len(flat)) - np.repeat(np.cumsum(windows) - windows, windows)
            new = np.flatnonzero(np.concatenate([[True], (flat[1:] != flat[:-1]) | (whose[1:] != whose[:-1])]))
            text_of.append(part[whose[new]])
            first.append(place[new])
            many.append(np.diff(np.append(new, len(flat))))
            source.append(flat[new])
        text_of, first, many, source = (np.concatenate(x) for x in (text_of, first, many, source))
        order = np.argsort(text_of, kind="stable")
        first, many, source = first[order], many[order], source[order]
        per_text = np.bincount(text_of, minlength=len(texts))
        start = np.cumsum(per_text) - per_text
        # Every slice's own texts with these stretches, where one of its documents comes later.
        each = per_text[code]
        ref = np.repeat(np.arange(len(code)), each)
        at = np.repeat(start[code] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
        later = source[at] < most[ref]
        ref, at = ref[later], at[later]
        slice_of = np.repeat(np.arange(len(count)), count)[ref]
        number = ref - (np.cumsum(count) - count)[slice_of]
        edges = np.searchsorted(slice_of, np.arange(len(count) + 1))
        some = [k for k in range(len(count)) if edges[k] < edges[k + 1]]
        cut = lambda x, kind: pa.array([x[edges[k] : edges[k + 1]].astype(kind).tobytes() for k in some], pa.binary())
        return pa.table({"p": pa.array([slices[k] for k in some], pa.int64()), "b": pa.array([b] * len(some), pa.int32()), "seg": cut(number, np.uint32), "first": cut(first[at], np.uint32), "count": cut(many[at], np.uint32), "source": cut(source[at], np.int64)})

    return run


RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def _removed(found: Slice, notes, buckets: int) -> np.ndarray:
    """A mask of the bytes to remove."""
    change = np.zeros(len(found.data) + 1, np.int32)
    texts, code = found.texts()
    bucket, _, _ = _ordered(found, code, len(texts), buckets)
    inside = {b: np.flatnonzero(bucket == b) for b in np.unique(bucket)}
    text_of, first, count, source = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for b, seg, f, c, s in zip(*(notes.column(k).to_pylist() for k in ("b", "seg", "first", "count", "source")), strict=True):
        if seg is not None:
            text_of.append(inside[b][np.frombuffer(seg, np.uint32)])
            for to, x, kind in ((first, f, np.uint32), (count, c, np.uint32), (source, s, np.int64)):
                to.append(np.frombuffer(x, kind).astype(np.int64))
    text_of, first, count, source = (np.concatenate(x) for x in (text_of, first, count, source))
    order = np.argsort(text_of, kind="stable")
    first, count, source = first[order], count[order], source[order]
    per_text = np.bincount(text_of, minlength=len(texts))
    start, each = np.cumsum(per_text) - per_text, per_text[code]
    run = np.repeat(np.arange(len(code)), each)
    at = np.repeat(start[code] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
    later = source[at] < found.ids[found.doc[run]]
    run, at = run[later], at[later]
    begin = found.start[run] + first[at]
    np.add.at(change, begin, 1)
    np.add.at(change, begin + count[at] + found.length - 1, -1)
    return np.cumsum(change[:-1]) > 0


def _result(length: int, buckets: int, texts_too: bool):
    def run(docs, notes):
        import hashlib

        import pyarrow as pa

        found = _reached(docs, notes, length, buckets)
        gone = _removed(found, notes, buckets) if len(found.start) else np.zeros(len(found.data), bool)
        new = gone & np.concatenate([[True], ~gone[:-1]]) if len(gone) else gone
        new[found.at[found.size > 0]] = gone[found.at[found.size > 0]]  # spans end with their document
        ends = found.at + found.size
        total = lambda x: np.concatenate([[0], np.cumsum(x)])
        removed, spans = total(gone), total(new)
        kept = [found.data[a:b] if removed[a] == removed[b] else found.data[a:b][~gone[a:b]] for a, b in zip(found.at, ends, strict=True)]
        columns = [found.table.column("doc_id"), pa.array(found.size), pa.array(removed[ends] - removed[found.at]), pa.array(spans[ends] - spans[found.at]), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if texts_too:
            columns.append(pa.array([x.tobytes() for x in kept], pa.binary()))
            names.append("kept")
        return pa.table(dict(zip(names, columns, strict=True)))

    return run


def _dealt(docs: DataFrame, slices: int) -> DataFrame:
    """p, doc_id, text (bytes): a written table whose files each hold whole slices, read without a shuffle."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    rows = rows.withColumn("p", F.pmod(F.xxhash64("doc_id", "text"), F.lit(slices)))
    files, name = min(slices, 50_000), f"suffix_dedup_{uuid.uuid4().hex}"
    rows.repartition(files, "p").write.option("path", f"{shared_dir(spark)}/vacantia/{name}").option("compression", "zstd").bucketBy(files, "p").saveAsTable(name)
    return spark.table(name)


def repeated_passages(docs: DataFrame, length: int = 50, slice_bytes: int = SLICE, keys: int = KEYS, hot: int = HOT, sorted_at_once: int = SORTED, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row, with `texts` also kept (binary).

    A byte is removed if it is covered by a string of `length` bytes that also starts in a row with a smaller doc_id; all
    is judged on the input. `docs` has doc_id and text; other columns aren't read. A null text is empty; a row with a null
    id is neither a source nor cut; repeated ids each give a row and don't cut each other. No rows give no rows.
    """
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    slices, buckets = (max(1, min(most, -(-total // size))) for most, size in ((SLICES, slice_bytes), (BUCKETS, keys * length // 4)))
    table = _dealt(docs, slices)
    by = table.groupBy("p")
    offers = by.applyInArrow(_offers(length, buckets), "p bigint, b int, keys binary")
    answers = written(offers.groupBy("b").applyInArrow(_answers(hot), "p bigint, b int, shared binary, hot binary"), "shared-keys")
    sent = by.cogroup(answers.groupBy("p")).applyInArrow(_sent(length, buckets), "p bigint, b int, size binary, texts binary, least binary, most binary, key binary")
    told = written(sent.groupBy("b").applyInArrow(_told(length, sorted_at_once), "p bigint, b int, seg binary, first binary, count binary, source binary"), "shared-strings")
    notes = answers.unionByName(told, allowMissingColumns=True)
    return by.cogroup(notes.groupBy("p")).applyInArrow(_result(length, buckets, texts), RESULT + (", kept binary" if texts else ""))


#: The same with every window of 50 bytes as a row of its own.
ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS source FROM w) WHERE source < doc_id),
stepped AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM hit),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM stepped) GROUP BY doc_id, g),
gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS kept_from FROM spans),
kept AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * kept_from + 1, 2 * (a - kept_from)), '' ORDER BY a) || substr(first(h), 2 * max(b) + 1) AS k FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
