"""Approximate nearest neighbours by a coarse quantiser: k-means cells, inverted lists, several lists per query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.operators.vectors import _in_bucket, _ranked, _unit, usable
from vacantia.sources.shared import written

#: Points on which the cells are fit, and cells, at most.
SAMPLE, CELLS = 50_000, 4096


def centres(points: DataFrame, cells: int, sample: int = SAMPLE, seed: int = 42) -> list[list[float]]:
    """Unit centres of at most `cells` cells, from `sample` usable points in a fixed random order (all, if there are fewer)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    chosen = usable(points).orderBy(F.xxhash64("point_id"), "point_id").limit(sample)
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    rows = written(chosen.select(F.transform("embedding", lambda x: x.cast("double")).alias("embedding")).withColumn("features", F.transform("embedding", lambda x: x / norm)).select("features"), "cell-sample")
    if rows.isEmpty():
        return []
    model = KMeans(k=max(2, cells), seed=seed, maxIter=15, distanceMeasure="cosine").fit(rows.select(array_to_vector("features").alias("features")))
    return [list(map(float, c)) for c in model.clusterCenters()]


def assigned(rows: DataFrame, name: str, cells: list[list[float]], nearest: int) -> DataFrame:
    """`name`, embedding, cell: each vector with each of its `nearest` cells. The centres go to the tasks; their size is bounded."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        c = np.array(cells)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        n = min(nearest, len(c))
        for b in batches:
            for a in range(0, b.num_rows, 4096):
                part = b.slice(a, 4096)
                score = _unit(part.column("embedding")) @ c.T
                best = np.argsort(-score, axis=1, kind="stable")[:, :n]
                at = pa.array(np.repeat(np.arange(part.num_rows), n))
                yield pa.RecordBatch.from_arrays([part.column(name).take(at), part.column("embedding").take(at), pa.array(best.reshape(-1).astype(np.int32))], [name, "embedding", "cell"])

    return rows.select(F.col(name).cast("long").alias(name), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, f"{name} bigint, embedding array<double>, cell int")


class Cells:
    """Points in the lists of their cells, written once and searched as often as wanted.

    Each point is in one list, so an index is as large as its points. A list is searched in blocks of about `block` points
    and the queries that look into it are sent to each, so a hot cell is many tasks.
    """

    def __init__(self, points: DataFrame, cells: int | None = None, block: int = 4096, dim: int | None = None, sample: int = SAMPLE):
        rows = usable(points, dim)
        n = rows.count()
        self.dim, self.points = dim, n
        self.centres = centres(rows, min(CELLS, cells or max(2, round(n**0.5))), sample)
        lists = assigned(rows, "point_id", self.centres, 1) if self.centres else rows.select(F.col("point_id").cast("long").alias("point_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.lit(0).alias("cell")).limit(0)
        self.lists = written(lists, "cell-lists")
        self.sizes = self.lists.groupBy("cell").agg(F.count("*").alias("held")).withColumn("parts", F.ceil(F.col("held") / block).cast("int"))

    def _asked(self, queries: DataFrame, probes: int) -> DataFrame:
        return assigned(usable(queries, self.dim), "query_id", self.centres or [[1.0]], probes).join(F.broadcast(self.sizes), "cell")

    def top_k(self, queries: DataFrame, k: int, probes: int = 8) -> DataFrame:
        """query_id, point_id, score, rank: the k best points of the `probes` nearest cells; scores are exact, the points approximate."""
        left = self._asked(queries, probes).select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("query_id").alias("id"), "embedding", F.lit(True).alias("is_query"))
        right = self.lists.join(F.broadcast(self.sizes), "cell").select("cell", F.pmod(F.xxhash64("point_id"), F.col("parts")).cast("int").alias("part"), F.col("point_id").alias("id"), "embedding", F.lit(False).alias("is_query"))
        found = left.unionByName(right).groupBy("cell", "part").applyInArrow(_in_bucket(k), "query_id bigint, point_id bigint, score double")
        return _ranked(found, k)

    def looked_at(self, queries: DataFrame, probes: int = 8) -> DataFrame:
        """query_id, share: the points that `top_k` holds against each query, as a share of all."""
        met = self._asked(queries, probes).groupBy("query_id").agg(F.sum("held").alias("n"))
        return met.select("query_id", F.round(F.col("n") / F.lit(max(1, self.points)), 4).alias("share"))
