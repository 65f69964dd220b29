"""SimHash near-duplicates: fingerprints of word shingles, linked by a sharded vantage-point tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import joined, temporary, written

#: Fingerprints from which a tree of shards is made, at most; its shards, at most; fingerprints meant for a shard.
SAMPLE, SHARDS, PER_SHARD = 65_536, 4096, 512
#: Fingerprints beyond which a shard gets a tree of its own, shards that are split in one pass, and their samples.
MOST, SPLIT, SUB_SAMPLE = 32_768, 256, 2048


def _fingerprints(width: int, seed: int, *more: str):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        import xxhash

        from . import texts

        for s in texts.slices(batches):
            flat, counts = texts.words(texts.filled(s.column("text")), lower=True)
            n, bits = len(counts), np.zeros((len(counts), 64), dtype=np.int64)
            each = np.maximum(counts - width + 1, np.minimum(counts, 1))
            full = np.flatnonzero(texts.within(counts, width))
            hashes = np.zeros(int(each.sum()), dtype=np.uint64)
            if len(full):
                at = pa.array(full)
                joined = pc.binary_join_element_wise(*(flat.take(pc.add(at, k)) for k in range(width)), " ").cast(pa.binary())
                place = np.flatnonzero(np.repeat(counts >= width, each))
                hashes[place] = np.fromiter((xxhash.xxh64_intdigest(x, seed) for x in joined.to_pylist()), dtype=np.uint64, count=len(full))
            start, begin = np.cumsum(counts) - counts, np.cumsum(each) - each
            for i in np.flatnonzero((counts > 0) & (counts < width)).tolist():
                hashes[begin[i]] = xxhash.xxh64_intdigest(" ".join(flat.slice(int(start[i]), int(counts[i])).to_pylist()), seed)
            some = np.flatnonzero(each)
            for a in range(0, len(some), 4096):
                part = some[a : a + 4096]
                lo, hi = int(begin[part[0]]), int(begin[part[-1]] + each[part[-1]])
                unpacked = np.unpackbits(hashes[lo:hi].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                bits[part] = np.add.reduceat(unpacked, begin[part] - lo, axis=0, dtype=np.int32)
            set_ = (2 * bits > each[:, None]) & (each[:, None] > 0)
            fp = np.packbits(set_, axis=1, bitorder="little").view(np.int64).reshape(-1)
            yield pa.RecordBatch.from_arrays([s.column("doc_id"), pa.array(fp), *(s.column(c) for c in more)], ["doc_id", "fp", *more])

    return run


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp (long): bit i is set if it is set in over half the XXH64 of the shingles of `width` words, repeats included.

    Texts with fewer words have one shingle, all their words; null texts and texts without a word have 0.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprints(width, seed), "doc_id bigint, fp bigint")


def _routed(trees: dict):
    """Fingerprints of each shard in `trees` through its tree: shards of a tree are numbered below their parent's."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            shard, fp = b.column("shard").to_numpy(), b.column("fp").to_numpy()
            for own in np.unique(shard):
                of = fp[shard == own]
                for a in range(0, len(of), 16_384):
                    part = of[a : a + 16_384]
                    at, sub = trees[int(own)].route(part.view(np.uint64))
                    yield pa.RecordBatch.from_arrays([pa.array(sub.astype(np.int64) + int(own) * (SHARDS * 4) + 1), pa.array(part[at])], ["shard", "fp"])

    return run


def _linked(radius: int):
    def run(table):
        import numpy as np
        import pyarrow as pa

        from . import vptree

        fp = np.unique(table.column("fp").to_numpy())
        found = vptree.forest(fp.view(np.uint64), radius)
        return pa.table({"a": pa.array(fp[found[:, 0]], pa.int64()), "b": pa.array(fp[found[:, 1]], pa.int64())})

    return run


def _tree(rows: DataFrame, most: int, shards: int, radius: int):
    """A tree from the first `most` fingerprints of `rows` in a fixed random order."""
    import numpy as np

    from .vptree import Tree

    sample = [r.fp for r in rows.orderBy(F.xxhash64("fp"), "fp").limit(most).collect()] if shards > 1 else []
    return Tree(np.array(sample, dtype=np.int64).view(np.uint64), shards, radius)


def sharded(distinct: DataFrame, count: int, radius: int, most: int = MOST) -> DataFrame:
    """shard, fp: every fingerprint in its shard, and as a guest in each shard in which it may have a partner.

    One tree, from a bounded sample, makes up to `SHARDS` shards. Shards that hold more than `most` fingerprints get trees
    of their own, and so on, until none is larger or splitting no longer makes them smaller.
    """
    shards = max(1, min(SHARDS, count // PER_SHARD))
    out = distinct.select(F.lit(0).cast("long").alias("shard"), "fp").mapInArrow(_routed({0: _tree(distinct, min(SAMPLE, 32 * shards), shards, radius)}), "shard bigint, fp bigint")
    if count <= most:
        return out
    out, kept = written(out, "shards"), set()
    while True:
        large = out.groupBy("shard").count().filter((F.col("count") > most) & ~F.col("shard").isin(*kept)).orderBy("shard").limit(SPLIT).collect()
        if not large:
            return out
        trees = {r.shard: _tree(out.filter(F.col("shard") == r.shard), SUB_SAMPLE, min(SHARDS, SUB_SAMPLE // 8, max(2, r["count"] // PER_SHARD)), radius) for r in large}
        whole = [k for k, t in trees.items() if t.shards < 2]  # dense beyond any split: compared in blocks by one task
        kept.update(whole)
        trees = {k: t for k, t in trees.items() if t.shards > 1}
        if trees:
            split = F.col("shard").isin(*trees)
            out = written(out.filter(~split).unionByName(out.filter(split).mapInArrow(_routed(trees), "shard bigint, fp bigint")), "shards")


def near_links(distinct: DataFrame, count: int, radius: int = 2) -> DataFrame:
    """Links (a, b) that connect what pairs of `distinct` fingerprints (fp: long) within `radius` bits connect.

    No pair within the radius is missed, whatever the sample that shapes the trees.
    """
    return sharded(distinct, count, radius).groupBy("shard").applyInArrow(_linked(radius), "a bigint, b bigint")


def groups(docs: DataFrame, width: int = 3, radius: int = 2, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable over links of up to `radius` bits.

    A-Z are lower-cased, words are `[^\\x20\\x09-\\x0D]+`. `docs` has doc_id and text; other columns aren't read. Rows with
    equal fingerprints are linked, also those without a word (zero). Repeated rows and ids each give a row; a null id
    gives a row with the component's smallest id, null where the component has none. An empty table gives no rows.
    """
    with temporary(docs.sparkSession) as keep:
        fps = keep(written(fingerprints(docs, width, seed), "fingerprints"))
        distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct-fingerprints")
        count, rows = distinct.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        roots = written(components(near_links(distinct.select("fp"), count, radius), "near-links"), "roots")
        # Only fingerprints with partners of other fingerprints are in `roots`; the others are components of their own.
        each = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
        least = each.groupBy("root").agg(F.min("least").alias("component_id"))
        named = keep(written(each.join(least, "root").select("fp", "n", "component_id"), "components"))
    out = joined(fps, named, ["fp"], "inner", rows)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
