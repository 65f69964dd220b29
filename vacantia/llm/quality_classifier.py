"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, calibrated probabilities."""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written

#: Hash buckets of words, and of word shapes behind them: the vector table has this size whatever the corpus. Words of one
#: bucket share a vector, which is coarser the more words there are.
WORDS, SHAPES = 12_288, 4_096
DIM, NONZERO = 32, 4
#: Labelled rows from which the network is fit, at most (the first by hash of doc_id), and its width.
SAMPLE, HIDDEN = 20_000, 24

_UPPER, _LOWER, _DIGIT = re.compile(r"[^\W\d_a-zß-öø-ÿ]+"), re.compile(r"[^\W\d_A-ZÀ-ÖØ-Þ]+"), re.compile(r"\d+")


def index_vectors() -> np.ndarray:
    """A sparse ternary vector for each bucket, from a fixed seed."""
    rng = np.random.default_rng(20_250_101)
    n = WORDS + SHAPES
    out = np.zeros((n, DIM), dtype=np.float32)
    at = np.argsort(rng.random((n, DIM)), axis=1)[:, :NONZERO]
    np.put_along_axis(out, at, rng.choice(np.array([-1, 1], dtype=np.float32), (n, NONZERO)), axis=1)
    return out


def shape(word: str) -> str:
    """Letters as x or X, digits as 9, runs of them once; other characters stay."""
    return _DIGIT.sub("9", _LOWER.sub("x", _UPPER.sub("X", word)))


def _buckets(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    word = np.fromiter((zlib.crc32(w.lower().encode()) % WORDS for w in found), dtype=np.int64, count=len(found))
    form = np.fromiter((WORDS + zlib.crc32(shape(w).encode()) % (SHAPES - 1) for w in found), dtype=np.int64, count=len(found))
    return word, form


#: The shape of a word that repeats the word before it.
AGAIN = WORDS + SHAPES - 1


def _streams(batches):
    """Per slice: the batch, words of each text, word buckets and shape buckets."""
    from . import texts

    for s in texts.slices(batches, target=1 << 20):
        flat, counts = texts.words(texts.filled(s.column("text")))
        found, codes = texts.coded(flat)
        word, form = _buckets(found)
        forms = form[codes] if len(codes) else codes
        if len(codes):
            again = np.concatenate([[False], codes[1:] == codes[:-1]])
            again[(np.cumsum(counts) - counts)[counts > 0]] = False
            forms = np.where(again, AGAIN, forms)
        yield s, counts, (word[codes] if len(codes) else codes), forms


def _contexts(batches):
    import pyarrow as pa

    from . import texts

    index, n = index_vectors(), WORDS + SHAPES
    before, after = np.roll(index, 1, axis=1), np.roll(index, -1, axis=1)
    total = np.zeros((n, DIM), dtype=np.float64)
    for _, counts, *streams in _streams(batches):
        ahead = np.flatnonzero(texts.within(counts, 2))
        for stream in streams:
            pair, times = np.unique(stream[ahead] * n + stream[ahead + 1], return_counts=True)
            a, b = pair // n, pair % n
            for own, of, index_of in ((a, b, after), (b, a, before)):
                order = np.argsort(own, kind="stable")
                own, of, w = own[order], of[order], times[order].astype(np.float32)
                first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else own
                for i in range(0, len(first), 512):
                    lo = first[i]
                    hi = first[i + 512] if i + 512 < len(first) else len(own)
                    total[own[first[i : i + 512]]] += np.add.reduceat(index_of[of[lo:hi]] * w[lo:hi, None], first[i : i + 512] - lo, axis=0)
    at = np.flatnonzero(total.any(axis=1))
    if len(at):
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(total[at, k].astype(np.int64)) for k in range(DIM))], ["bucket", *(f"v{k}" for k in range(DIM))])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Context vectors of all buckets over all texts, of unit length; the table's size is fixed (2 MB).

    Index vectors are of -1, 0 and 1, so the sums are whole numbers and don't depend on the order of tasks.
    """
    columns = ", ".join(f"v{k} bigint" for k in range(DIM))
    rows = docs.select("text").mapInArrow(_contexts, f"bucket bigint, {columns}").groupBy("bucket").agg(*(F.sum(f"v{k}").alias(f"v{k}") for k in range(DIM)))
    got = rows.toPandas()
    out = np.zeros((WORDS + SHAPES, DIM), dtype=np.float32)
    if len(got):
        out[got["bucket"].to_numpy()] = got[[f"v{k}" for k in range(DIM)]].to_numpy(dtype=np.float32)
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(size > 0, size, 1)


#: Both pooled vectors and the length of each.
FEATURES = 2 * DIM + 2


def _pooled(vectors: np.ndarray):
    def run(batches):
        import pyarrow as pa

        for s, counts, *streams in _streams(batches):
            parts = []
            for stream in streams:
                n, m = len(counts), WORDS + SHAPES
                row = np.repeat(np.arange(n), counts)
                pair, times = np.unique(row * m + stream, return_counts=True)
                r, b = pair // m, pair % m
                out = np.zeros((n, DIM), dtype=np.float64)
                some = np.flatnonzero(np.bincount(r, minlength=n)) if len(r) else np.zeros(0, np.int64)
                first = np.searchsorted(r, some)
                for i in range(0, len(some), 64):
                    lo, hi = first[i], (first[i + 64] if i + 64 < len(some) else len(r))
                    out[some[i : i + 64]] = np.add.reduceat(vectors[b[lo:hi]] * times[lo:hi, None], first[i : i + 64] - lo, axis=0)
                mean = out / np.maximum(counts, 1)[:, None]
                parts += [mean, np.linalg.norm(mean, axis=1, keepdims=True)]
            flat = np.concatenate(parts, axis=1).astype(np.float32)
            yield pa.RecordBatch.from_arrays([s.column("doc_id"), pa.FixedSizeListArray.from_arrays(pa.array(flat.reshape(-1)), FEATURES).cast(pa.list_(pa.float32()))], ["doc_id", "features"])

    return run


def features(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    """doc_id and the pooled vector of each text; a null or empty text has zeros."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(_pooled(vectors), "doc_id bigint, features array<float>")


class Network:
    """Two layers over standardised features, fit by Adam, with a temperature fit on rows kept back from the weights."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 7, epochs: int = 60):
        self.share = float((y.sum() + 1) / (len(y) + 2))
        self.plain = len(np.unique(y)) < 2 or len(y) < 20
        if self.plain:
            return
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        z = (x - self.mean) / self.scale
        held = np.arange(len(y)) % 6 == 5
        p = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        a, b = z[~held], y[~held].astype(float)
        for _ in range(epochs):
            order = rng.permutation(len(b))
            for i in range(0, len(b), 128):
                at = order[i : i + 128]
                h = np.tanh(a[at] @ p[0] + p[1])
                g = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - b[at]) / len(at)
                back = np.outer(g, p[2]) * (1 - h * h)
                step += 1
                for k, grad in enumerate((a[at].T @ back + 1e-4 * p[0], back.sum(0), h.T @ g + 1e-4 * p[2], np.array([g.sum()]))):
                    m[k] = 0.9 * m[k] + 0.1 * grad
                    v[k] = 0.999 * v[k] + 0.001 * grad * grad
                    p[k] = p[k] - 0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        self.p, self.temperature = p, 1.0
        logit, want = self.logit(x[held]), y[held]
        grid = np.geomspace(0.25, 8, 61)
        self.temperature = float(min(grid, key=lambda t: np.mean(np.logaddexp(0, -np.where(want == 1, 1, -1) * logit / t))))

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3][0]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        if self.plain:
            return np.full(len(x), self.share)
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))


def held_out(doc_id) -> F.Column:
    """Whether crc32 of the id as text is a multiple of 5; a null id isn't held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def known_labels(labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """doc_id, y of at most `sample` labelled ids that aren't held out; of several labels of an id, the least."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter("doc_id IS NOT NULL AND y IN (0, 1)")
    return known.filter(~held_out("doc_id")).groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)


def fit(pooled: DataFrame, known: DataFrame, sample: int = SAMPLE) -> Network:
    """The network from the rows of `pooled` (doc_id, features) with a label in `known`, at most `sample`."""
    got = pooled.join(F.broadcast(known), "doc_id").select("doc_id", "y", "features").orderBy(F.xxhash64("doc_id"), "doc_id", "features").limit(sample).toPandas()
    if not len(got):
        return Network(np.zeros((0, FEATURES)), np.zeros(0, dtype=int))
    return Network(np.stack(got["features"].to_numpy()).astype(float), got["y"].to_numpy())


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, label: str = "quality") -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted (1 if score >= threshold, else 0).

    The vectors come from all texts, the labels only from rows that aren't held out. Only the text decides a score:
    equal texts score alike, and a null or empty text is scored as one without words. Each row gives a row, repeated
    rows and null ids too. Without labels of both kinds (or under 20) every score is the smoothed share of label 1.
    """
    pooled = written(features(docs, word_vectors(docs)), "pooled-vectors")
    net = fit(pooled, known_labels(labels, label))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            x = b.column("features").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, FEATURES).astype(float)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(net.score(x), pa.float64())], ["doc_id", "score"])

    out = pooled.mapInArrow(run, "doc_id bigint, score double")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def calibration(scored: DataFrame, labels: DataFrame, label: str = "quality", bins: int = 10) -> DataFrame:
    """Per bin of scores of held-out rows that have a label: bin, n, mean score, share of label 1."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter("doc_id IS NOT NULL AND y IN (0, 1)").groupBy("doc_id").agg(F.min("y").alias("y"))
    rows = scored.filter("held_out").join(known, "doc_id")
    return rows.groupBy(F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg("score").alias("score"), F.avg("y").alias("share"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, label: str = "quality") -> DataFrame:
    """The rows of `docs`, with its own columns, that `classify` predicts as 1."""
    vectors, known = word_vectors(docs), known_labels(labels, label)
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known.select("doc_id")), "doc_id", "left_semi")
    net = fit(features(some, vectors), known)
    pool = _pooled(vectors)

    def run(batches):
        import pyarrow as pa

        from . import texts

        for s in texts.slices(batches):
            rows = pa.RecordBatch.from_arrays([pa.nulls(s.num_rows, pa.int64()), s.column("text")], ["doc_id", "text"])
            x = np.concatenate([b.column("features").flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES) for b in pool(iter([rows]))])
            yield s.filter(pa.array(net.score(x.astype(float)) >= threshold))

    return docs.mapInArrow(run, docs.schema)
