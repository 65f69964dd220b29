"""Near-copies of whole texts: simhash and min-hash candidates, exact shingle overlap, connected components.

The vantage-point tree of `simhash` finds fingerprints within two bits, which is what nearly equal texts have. At a
similarity of 0.8 fingerprints of 64 bits differ in ten bits and more, a distance at which no tree prunes; such pairs meet
in buckets of banded min-hashes instead. Every candidate is then held against the shingles themselves, so neither way
adds a false link.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import free_name, sized, temporary, written
from .simhash import near_links

#: Min-hashes of a band, and bands: a pair of similarity 0.8 shares a bucket with probability 0.995.
ROWS, BANDS = 4, 10
#: Bits in which fingerprints of candidates may differ (0.999 of pairs at 0.8), and shingles below which this isn't asked.
BITS, FEW = 18, 64
#: Members of a bucket that are compared at once, and centres that each bucket has before its other pairs are listed.
BLOCK, ROUNDS = 1024, 4
#: Shingles of a block, at most; one longer text is a block of its own.
HELD = 1 << 20
#: Min-hashes of a byte each by which the pairs of a block are judged, and by how much less than asked may be equal: of pairs
#: at 0.8 a share of 0.997 passes.
SIGNED, SLACK = 256, 0.07
#: Pairs or texts, in rows of under 40 bytes, that are broadcast.
SENT = 200_000

_A, _B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9


def _mixed(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(_B)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(column, width: int, seed: int) -> list:
    """The distinct shingle hashes of each text: words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased; short texts have one shingle."""
    import numpy as np
    import xxhash

    from . import texts

    flat, counts = texts.words(texts.filled(column), lower=True)
    words, codes = texts.indexed(flat)
    each = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words.cast("binary").to_pylist()), dtype=np.uint64, count=len(words))
    h = each[codes] if len(codes) else np.zeros(0, np.uint64)
    factor = np.random.default_rng(seed).integers(1, 1 << 63, width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    rolled = np.zeros(len(h), dtype=np.uint64)
    for k in range(width):
        rolled[: len(h) - k] += h[k:] * factor[k] if k else h * factor[0]
    rolled = _mixed(rolled)
    out, at = [], 0
    for n in counts.tolist():
        if n >= width:
            out.append(np.unique(rolled[at : at + n - width + 1]))
        elif n:
            out.append(_mixed(np.array([(h[at : at + n] * factor[:n]).sum() + np.uint64(n)], dtype=np.uint64)))
        else:
            out.append(rolled[:0])
        at += n
    return out


def _sketched(width: int, seed: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        from . import texts

        rng = np.random.default_rng(seed + 1)
        a, b = (rng.integers(1, 1 << 63, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
        for s in texts.slices(batches):
            sets = shingle_sets(s.column("text"), width, seed)
            size = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
            some = np.flatnonzero(size)
            fp = np.zeros(len(sets), dtype=np.int64)
            bands = np.zeros((len(sets), BANDS), dtype=np.uint64)
            for i in range(0, len(some), 2048):
                part = some[i : i + 2048]
                flat = np.concatenate([sets[k] for k in part])
                first = np.cumsum(size[part]) - size[part]
                votes = np.add.reduceat(np.unpackbits(flat.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), first, axis=0, dtype=np.int32)
                fp[part] = np.packbits(2 * votes > size[part][:, None], axis=1, bitorder="little").view(np.int64).reshape(-1)
                for k in range(BANDS):
                    value = np.full(len(part), k, dtype=np.uint64)
                    for j in range(k * ROWS, k * ROWS + ROWS):
                        value = _mixed(value * np.uint64(_A) + np.minimum.reduceat(flat * a[j] + b[j], first))
                    bands[part, k] = value
            offsets = np.concatenate([[0], np.cumsum((size > 0) * BANDS)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands[some].view(np.int64).reshape(-1)))
            yield pa.RecordBatch.from_arrays([s.column("doc_id"), s.column("key"), pa.array(fp), pa.array(size), lists], ["doc_id", "key", "fp", "size", "bands"])

    return run


def _sets(width: int, seed: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        from . import texts

        rng = np.random.default_rng(seed + 2)
        a, b = (rng.integers(1, 1 << 63, SIGNED, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
        for s in texts.slices(batches):
            sets = shingle_sets(s.column("text"), width, seed)
            size = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
            flat, some = np.concatenate([*sets, np.zeros(0, np.uint64)]), np.flatnonzero(size)
            signed = np.zeros((len(sets), SIGNED), dtype=np.uint8)
            for k in range(SIGNED if len(some) else 0):
                signed[some, k] = _mixed(np.minimum.reduceat(flat * a[k] + b[k], (np.cumsum(size) - size)[some])).astype(np.uint8)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(flat.view(np.int64)))
            yield pa.RecordBatch.from_arrays([s.column("node"), s.column("n"), lists, pa.array([r.tobytes() for r in signed], pa.binary())], ["node", "n", "shingles", "signed"])

    return run


def text_key() -> Column:
    """128 bits of a text; null is the empty text."""
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))


def _id() -> Column:
    return F.col("doc_id").cast("long").alias("doc_id")


def _likely(a: str, b: str, similarity: float) -> Column:
    """What the sizes and fingerprints of two texts allow: no pair of this similarity has sizes further apart."""
    least, most = F.least(f"{a}size", f"{b}size"), F.greatest(f"{a}size", f"{b}size")
    near = F.bit_count(F.col(f"{a}fp").bitwiseXOR(F.col(f"{b}fp"))) <= BITS
    return (least >= most * (similarity - 1e-9)) & (near | (least < FEW))


def _pairs(found: DataFrame) -> DataFrame:
    return found.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def _equal_prints(nodes: DataFrame) -> DataFrame:
    """(x, y): texts of equal fingerprints, and those whose fingerprints the tree links, by one text of each fingerprint."""
    same = written(nodes.groupBy("fp").agg(F.min("node").alias("rep"), F.count("*").alias("n")), "fingerprints-of-texts")
    often = sized(written(same.filter("n > 1").select("fp", "rep"), "repeated-fingerprints"))
    equal = nodes.join(often, "fp").filter("node <> rep").select(F.col("node").alias("x"), F.col("rep").alias("y"))
    links = near_links(same.select("fp"), same.count())
    reps = same.select("fp", "rep")
    return equal.unionByName(links.join(reps.select(F.col("fp").alias("a"), F.col("rep").alias("x")), "a").join(reps.select(F.col("fp").alias("b"), F.col("rep").alias("y")), "b").select("x", "y"))


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose shingle sets overlap by `similarity` or more. A node of many pairs is dealt over blocks of them."""
    often = written(pairs.groupBy("b").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")), "centres")
    left = pairs.join(sized(often, SENT), "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"))
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")).join(sized(written(left, "dealt-pairs"), SENT), "a")
    right = sets.join(sized(often, SENT), sets.node == often.b).select("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    every = F.size("sa") + F.size("sb") - both
    return left.join(right, ["b", "part"]).filter((every == 0) | (both / every >= similarity)).select("a", "b")


def _by_root(buckets: DataFrame, links: DataFrame) -> DataFrame:
    """The members of buckets that hold several components, each with its `root`."""
    roots = components(links)
    named = buckets.join(roots.select("node", F.col("root").alias("r")), "node", "left").withColumn("root", F.coalesce("r", "node")).drop("r")
    named = written(named, "buckets-by-root")
    several = named.groupBy("band").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("band")
    return written(named.join(several, "band"), "open-buckets")


def _around_centres(members: DataFrame, centres: DataFrame | None, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Per bucket a new centre, and pairs (x, y) of it and the members of other components.

    The centre is the member that shares most buckets with most texts, among the components that had no centre there yet.
    """
    left = members if centres is None else members.join(members.join(centres, ["band", "node"]).select("band", "root").distinct(), ["band", "root"], "left_anti")
    best = left.groupBy("band").agg(F.max_by(F.struct("node", "fp", "size", "root"), F.struct("shared", F.xxhash64("node"))).alias("c"))
    best = written(best.select("band", *(F.col(f"c.{c}").alias(f"c_{c}") for c in ("node", "fp", "size", "root"))), "bucket-centres")
    found = members.join(best, "band").filter((F.col("root") != F.col("c_root")) & _likely("", "c_", similarity))
    return best.select("band", F.col("c_node").alias("node")), found.select(F.col("node").alias("x"), F.col("c_node").alias("y"))


def _in_blocks(similarity: float):
    """Links (x, y) of a group's left and right block: a forest that connects what all links between them connect.

    Pairs of different components whose signatures are near are held against their shingles, the nearest first, unless
    links found before already connect them. So a group gives fewer rows than it has members, however many are alike.
    """

    def run(table):
        import numpy as np
        import pyarrow as pa

        least = int(np.ceil((similarity - SLACK) * SIGNED))
        node, root = table.column("node").to_numpy(), table.column("root").to_numpy()
        signed = np.frombuffer(b"".join(table.column("signed").to_pylist()), dtype=np.uint8).reshape(len(node), SIGNED)
        lists = table.column("shingles").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
        left = np.flatnonzero(table.column("left").to_numpy(zero_copy_only=False))
        right = np.flatnonzero(table.column("right").to_numpy(zero_copy_only=False))
        up: dict[int, int] = {}

        def top(k: int) -> int:
            while k in up:
                up[k] = k = up.get(up[k], up[k])
            return k

        x, y = [], []
        for i in range(0, len(left), 16):
            at = left[i : i + 16]
            alike = (signed[at][:, None, :] == signed[right][None, :, :]).sum(axis=2, dtype=np.int16)
            near = (alike >= least) & (root[at][:, None] != root[right][None, :]) & (node[at][:, None] > node[right][None, :])
            a, b = np.nonzero(near)
            for k in np.argsort(-alike[a, b], kind="stable").tolist():
                p, q = int(at[a[k]]), int(right[b[k]])
                u, v = top(int(root[p])), top(int(root[q]))
                if u == v:
                    continue
                one, two = flat[ends[p] : ends[p + 1]], flat[ends[q] : ends[q + 1]]
                if min(len(one), len(two)) < (similarity - 1e-9) * max(len(one), len(two)):
                    continue
                both = len(np.intersect1d(one, two, assume_unique=True))
                if both >= similarity * (len(one) + len(two) - both):
                    up[u] = v
                    x.append(int(node[p]))
                    y.append(int(node[q]))
        return pa.table({"x": pa.array(x, pa.int64()), "y": pa.array(y, pa.int64())})

    return run


def _between(members: DataFrame, centres: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The other links (a, b) inside buckets, in pairs of blocks of at most about `BLOCK` members and `HELD` shingles."""
    rest = members.join(centres, ["band", "node"], "left_anti")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / HELD)).cast("int")
    parts = rest.groupBy("band").agg(F.min("root").alias("u"), F.max("root").alias("v"), blocks.alias("parts")).filter("u <> v").select("band", "parts")
    rows = rest.join(parts, "band").select("band", "node", "root", "parts", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("own"))
    rows = written(rows.join(sets.select("node", "signed", "shingles"), "node"), "members-left")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    each = rows.select("band", "node", "root", "signed", "shingles", "own", other)  # both orders of two blocks are one group each
    of = lambda l, r, left, right: (F.col(l).alias("l"), F.col(r).alias("r"), "node", "root", "signed", "shingles", left.alias("left"), right.alias("right"))
    left = each.select("band", *of("own", "other", F.lit(True), F.col("own") == F.col("other")))
    right = each.filter("own <> other").select("band", *of("other", "own", F.lit(False), F.lit(True)))
    found = left.unionByName(right).groupBy("band", "l", "r").applyInArrow(_in_blocks(similarity), "x bigint, y bigint")
    return _pairs(found)


def _links(slim: DataFrame, nodes: DataFrame, width: int, similarity: float, seed: int) -> DataFrame:
    """Verified links (a, b) between nodes, as many as connect what all links connect.

    In each bucket members are held against one centre after another, which takes one pair a member; what still is of
    different components after that is compared in blocks.
    """
    banded = nodes.select("node", "fp", "size", F.explode("bands").alias("band"))
    members = written(banded.groupBy("band").agg(F.count("*").alias("members")).filter("members > 1"), "shared-bands")
    buckets = written(banded.join(sized(members, SENT), "band"), "bucket-members")
    shared = buckets.groupBy("node").agg(F.sum("members").alias("shared"))
    buckets = written(buckets.join(shared, "node").select("band", "node", "fp", "size", "members", "shared"), "buckets")
    centres, pairs = _around_centres(buckets.withColumn("root", F.col("node")), None, similarity)
    tested = written(_pairs(pairs.unionByName(_equal_prints(nodes))), "candidates")
    some = tested.select(F.explode(F.array("a", "b")).alias("node")).unionByName(buckets.filter("members > 2").select("node")).distinct()
    wanted = sized(written(nodes.join(some, "node").select("node", F.col("key").alias("k"), F.col("doc_id").alias("d"), "n"), "candidate-texts"), SENT)
    texts = slim.join(wanted, (slim.key == wanted.k) & slim.doc_id.eqNullSafe(wanted.d)).select("node", "n", "text")
    sets = texts.mapInArrow(_sets(width, seed), "node bigint, n bigint, shingles array<bigint>, signed binary")
    sets = written(sets, "shingle-sets-of-rows")
    often = sets.filter("n > 1").groupBy("node").agg(F.first(F.struct("shingles", "signed")).alias("s")).select("node", "s.*")
    sets = sets.filter("n = 1").select("node", "shingles", "signed").unionByName(often)
    links = written(_verified(tested, sets, similarity), "links-found")
    buckets = buckets.filter("members > 2")
    for _ in range(ROUNDS - 1):
        open_ = _by_root(buckets, links)
        if open_.isEmpty():
            return links
        new, pairs = _around_centres(open_, centres, similarity)
        pairs = written(_pairs(pairs).join(tested, ["a", "b"], "left_anti"), "candidates")
        tested, centres = tested.unionByName(pairs), centres.unionByName(new)
        links = written(links.unionByName(_verified(pairs, sets, similarity)), "links-found")
    return links.unionByName(written(_between(_by_root(buckets, links), centres, sets, similarity), "links-found"))


def _classes(docs: DataFrame, width: int, similarity: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """(rows: key, doc_id, n of equal rows, root) and (root, key, doc_id of the row that stands for it)."""
    with temporary(docs.sparkSession) as keep:
        slim = docs.select(_id(), "text", text_key().alias("key"))
        sketches = slim.mapInArrow(_sketched(width, seed), "doc_id bigint, key binary, fp bigint, size bigint, bands array<bigint>")
        once = written(sketches.groupBy("key", "doc_id").agg(F.count("*").alias("n"), F.first(F.struct("fp", "size", "bands")).alias("s")), "sketches")
        least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "n")).alias("least")
        nodes = once.groupBy("key").agg(least, F.first("s").alias("s")).select("key", F.col("least.doc_id").alias("doc_id"), F.col("least.n").alias("n"), "s.*")
        nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "texts")
        roots = components(_links(slim, nodes, width, similarity, seed))
        of = written(nodes.join(roots, "node", "left").select("key", "doc_id", F.coalesce("root", "node").alias("root")), "roots-of-texts")
        first = of.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("f")).select("root", "f.key", "f.doc_id")
        rows = once.select("key", "doc_id", "n").join(of.select("key", "root"), "key")
        return keep(written(rows, "rows-of-components")), keep(written(first, "representatives"))


def classes(docs: DataFrame, width: int = 5, similarity: float = 0.8, seed: int = 42) -> DataFrame:
    """doc_id, component_id of each row: the smallest doc_id that links of `similarity` or more between texts reach.

    Similarity is the Jaccard overlap of the distinct shingles of `width` words (A-Z lower-cased); a text with fewer words
    has one shingle, all its words, and texts without a word are alike. Links that join texts are found with the chance
    that `ROWS`, `BANDS`, `BITS` and `SLACK` give; none is false. `docs` has doc_id and text; other columns aren't read. Repeated rows and
    ids each give a row; a component without any id has null. An empty table gives no rows.
    """
    rows, first = _classes(docs, width, similarity, seed)
    named = rows.join(sized(first.select("root", F.col("doc_id").alias("component_id"))), "root")
    return named.select("doc_id", "component_id", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("_i")).drop("_i")


def deduplicated(docs: DataFrame, width: int = 5, similarity: float = 0.8, seed: int = 42) -> DataFrame:
    """One row of `docs`, with its own columns, for each component of `classes`: that with the smallest doc_id.

    Where a component has no id, one of its rows stays; of rows that are equal in doc_id and text one stays. Column names
    of `docs` may be any. Only the rows that go are shuffled or broadcast against `docs`, so texts move only where those
    are too many to broadcast.
    """
    rows, first = _classes(docs, width, similarity, seed)
    stay = first.select("key", F.col("doc_id").alias("d"))
    here = rows.join(stay, (rows.key == stay.key) & rows.doc_id.eqNullSafe(stay.d), "left_semi")
    gone = rows.join(stay, (rows.key == stay.key) & rows.doc_id.eqNullSafe(stay.d), "left_anti").unionByName(here.filter("n > 1"))
    name = free_name(docs, "key")
    keyed = docs.withColumn(name, text_key())
    own = F.col("doc_id").cast("long")

    def of(table: DataFrame, how: str) -> DataFrame:
        table = sized(written(table.select(F.col("key").alias(name + "_k"), F.col("doc_id").alias(name + "_d")), "rows-that-go"))
        return keyed.join(table, (F.col(name) == F.col(name + "_k")) & own.eqNullSafe(F.col(name + "_d")), how)

    kept = of(gone, "left_anti").drop(name)
    often = here.filter("n > 1")
    if often.isEmpty():
        return kept
    return kept.unionByName(of(often, "left_semi").dropDuplicates([name, "doc_id"]).drop(name))
