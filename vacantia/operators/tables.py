"""A keyed table whose writes touch only the parts that hold the new keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.operators.keyed import latest_per_key


class KeyedTable:
    """Insert-or-replace by key in a shared folder, as parts by a hash of the key and a manifest that names the parts.

    A write reads and replaces the parts that its keys fall into, leaves all other files as they are, and then writes a
    manifest; readers see the last whole one. The same rows written again give the same table. The parts that the last two
    manifests don't name are deleted. One writer at a time, as everywhere in this library.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, keys: list[str], order: list[str], parts: int = 256):
        self.spark, self.folder, self.keys, self.order = spark, folder, keys, order
        self.schema = spark.createDataFrame([], schema).schema
        old = self._manifest()
        #: The number of parts is that of the first write.
        self.parts = max(len(old), 1) if old else parts

    def _path(self, *p):
        return self.spark._jvm.org.apache.hadoop.fs.Path(*p)

    def _fs(self):
        return self._path(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        fs, root = self._fs(), self._path(f"{self.folder}/manifest")
        there = [s.getPath() for s in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(int(p.getName().removeprefix("version=")) for p in there if fs.exists(self._path(p, "_SUCCESS")))

    def _manifest(self, version: int | None = None) -> dict[int, str | None]:
        """Part -> folder; a part without rows has none. As many rows as parts."""
        versions = self._versions()
        if not versions:
            return {}
        rows = self.spark.read.parquet(f"{self.folder}/manifest/version={versions[-1] if version is None else version}").collect()
        return {r.part: r.path for r in rows}

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _part(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.parts)).cast("int")

    def read(self) -> DataFrame:
        return self._read([f"{self.folder}/{p}" for p in self._manifest().values() if p])

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of some keys, from the parts that may hold them."""
        there = self._manifest()
        found = [there.get(r.part) for r in keys.select(self._part().alias("part")).distinct().collect()]
        return self._read([f"{self.folder}/{p}" for p in found if p]).join(keys.select(*self.keys).distinct(), self.keys, "left_semi")

    def write(self, new: DataFrame) -> int:
        """Inserts or replaces the rows of `new` (the newest of each key by `order`) and gives how many parts it touched."""
        versions, there = self._versions(), self._manifest()
        version = (versions[-1] if versions else 0) + 1
        new = new.select(*self.schema.names).withColumn("part", self._part())
        touched = sorted(r.part for r in new.select("part").distinct().collect())
        old = self._read([f"{self.folder}/{there[b]}" for b in touched if there.get(b)]).withColumn("part", self._part())
        at = f"data/version={version}"
        merged = latest_per_key(old.unionByName(new), [*self.keys, "part"], self.order).select(*self.schema.names, "part")
        merged.hint("rebalance", "part").write.mode("overwrite").partitionBy("part").parquet(f"{self.folder}/{at}")
        now = {b: there.get(b) for b in range(self.parts)} | {b: f"{at}/part={b}" for b in touched}
        self.spark.createDataFrame(list(now.items()), "part int, path string").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/version={version}")
        self._clean(now, versions)
        return len(touched)

    def _clean(self, now: dict[int, str | None], versions: list[int]) -> None:
        """Deletes the parts and manifests that neither this version nor the one before needs."""
        fs, before = self._fs(), versions[-1:]
        needed = {p for m in (now, self._manifest(before[0]) if before else {}) for p in m.values() if p}
        for old in versions[:-1]:
            for p in self._manifest(old).values():
                if p and p not in needed:
                    fs.delete(self._path(f"{self.folder}/{p}"), True)
            fs.delete(self._path(f"{self.folder}/manifest/version={old}"), True)
