"""Tables of the graph in a folder: write, upsert, read, clear.

Each table is a folder of numbered versions; a version counts once Spark has marked it complete, so
readers never see a half-written table and a failed write can be repeated. A table written with
``upsert`` falls into ``BUCKETS`` by a hash of its keys, each with versions of its own: an upsert
reads and rewrites only the buckets that its rows hit. Works on any file system Spark can
write to.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.graph import latest
from loomgraph.session import cut

#: Buckets of a table with upserts.
BUCKETS = 16


class Store:
    """A folder of tables."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _files(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _versions(self, name: str) -> list[int]:
        fs, path = self._files()
        folder = path(f"{self.root}/{name}")
        if not fs.exists(folder):
            return []
        found = [s.getPath() for s in fs.listStatus(folder)]
        # A version counts once Spark has marked it complete.
        return sorted(int(p.getName()[1:]) for p in found if re.fullmatch("v[0-9]+", p.getName()) and fs.exists(path(f"{p.toString()}/_SUCCESS")))

    def _buckets(self, name: str) -> dict[int, list[int]]:
        """Complete versions of each bucket."""
        fs, path = self._files()
        folder = path(f"{self.root}/{name}")
        if not fs.exists(folder):
            return {}
        found = [s.getPath().getName() for s in fs.listStatus(folder)]
        numbers = [int(x[1:]) for x in found if re.fullmatch("b[0-9]+", x)]
        return {n: v for n in numbers if (v := self._versions(f"{name}/b{n}"))}

    def exists(self, name: str) -> bool:
        return bool(self._versions(name) or self._buckets(name))

    def read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """A table, or some of its buckets."""
        versions, known = self._versions(name), self._buckets(name)
        paths = [f"{self.root}/{name}/b{n}/v{v[-1]}" for n, v in sorted(known.items()) if buckets is None or n in buckets]
        paths += [f"{self.root}/{name}/v{versions[-1]}"] if versions else []
        if not paths:
            raise FileNotFoundError(f"{self.root}/{name}")
        return self.spark.read.option("mergeSchema", len(paths) > 1).parquet(*paths)

    def write(self, name: str, df: DataFrame) -> DataFrame:
        """Replace a table; older versions but the last are removed."""
        versions = self._versions(name)
        number = versions[-1] + 1 if versions else 1
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/v{number}")
        fs, path = self._files()
        for n in self._buckets(name):
            fs.delete(path(f"{self.root}/{name}/b{n}"), True)
        for old in versions[:-1]:
            fs.delete(path(f"{self.root}/{name}/v{old}"), True)
        return self.read(name)

    def upsert(self, name: str, df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
        """Add rows; of each key the last row by ``order`` stays. Rows with a null key are dropped.

        Only buckets with new rows are rewritten, each as a version of its own, so a job that ends
        half-way has some buckets upserted and can be repeated.
        """
        place = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")
        fresh = cut(df.dropna(subset=keys).withColumn("__bucket", place))
        hit = sorted(r["__bucket"] for r in fresh.select("__bucket").distinct().collect())
        whole = self._versions(name)
        if whole:
            # A table written as a whole is dealt out once.
            fresh = self.spark.read.parquet(f"{self.root}/{name}/v{whole[-1]}").withColumn("__bucket", place).unionByName(fresh, allowMissingColumns=True)
            hit = list(range(BUCKETS))
        known = self._buckets(name)
        old = [n for n in hit if n in known]
        if old:
            fresh = self.read(name, old).withColumn("__bucket", place).unionByName(fresh, allowMissingColumns=True) if not whole else fresh
        merged = latest(fresh, keys, order)
        stage = f"{self.root}/{name}/stage"
        merged.repartition("__bucket").write.mode("overwrite").partitionBy("__bucket").parquet(stage)
        fs, path = self._files()
        for n in hit:
            number = known[n][-1] + 1 if n in known else 1
            target = path(f"{self.root}/{name}/b{n}/v{number}")
            source = path(f"{stage}/__bucket={n}")
            if fs.exists(source):
                fs.mkdirs(target.getParent())
                fs.delete(target, True)
                fs.rename(source, target)
                fs.create(path(f"{target.toString()}/_SUCCESS"), True).close()
            for v in known.get(n, [])[:-1]:
                fs.delete(path(f"{self.root}/{name}/b{n}/v{v}"), True)
        fs.delete(path(stage), True)
        for v in whole:
            fs.delete(path(f"{self.root}/{name}/v{v}"), True)
        return self.read(name)

    def assert_unique(self, name: str, keys: list[str]) -> None:
        """Fail if a key occurs twice."""
        if not self.read(name).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            raise ValueError(f"{name}: {keys} is not unique")

    def clear(self, name: str | None = None) -> None:
        fs, path = self._files()
        fs.delete(path(f"{self.root}/{name}" if name else self.root), True)
