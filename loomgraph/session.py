"""Session helpers: table access, lineage cuts and sizes known to the planner."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "loomgraph", cores: str = "*", **conf: str) -> SparkSession:
    """A local session with the settings every operator assumes (UTC, AQE, Arrow)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers of all executors, once for a session."""
    context = spark.sparkContext
    if getattr(context, "_loomgraph_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    base = os.path.join(tempfile.mkdtemp(prefix="loomgraph-code-"), "loomgraph")
    context.addPyFile(shutil.make_archive(base, "zip", root, "loomgraph"))
    context._loomgraph_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    ship_package(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named by ``spark.checkpoint.dir``. A local session (tests, a laptop) without
    one gets a temporary folder; a cluster without one is an error, as no machine's own
    folder outlives its executors."""
    if spark.sparkContext.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="loomgraph-ckpt-"))


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


class Scratch:
    """Tables in the shared checkpoint folder that cut the lineage of iterations.

    Unlike a checkpoint, which keeps the planner's guess of its size, a table read back has its
    true size; guesses would multiply with every join of a loop.
    """

    def __init__(self, spark: SparkSession) -> None:
        ensure_checkpoint_dir(spark)
        self.spark = spark
        self.root = f"{spark.sparkContext.getCheckpointDir()}/scratch-{uuid.uuid4().hex}"
        self.count = 0

    def put(self, df: DataFrame, *replaced: DataFrame | None) -> DataFrame:
        """Write ``df`` and read it back; tables it replaces are deleted."""
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        for old in replaced:
            if getattr(old, "_scratch_path", None):
                self._delete(old._scratch_path)
        return out

    def all(self, tables: list[DataFrame]) -> DataFrame:
        """Tables of one schema as one table, read in one scan."""
        return self.spark.read.schema(tables[0].schema).parquet(*[t._scratch_path for t in tables])

    def drop(self) -> None:
        """Delete all tables; nothing that is still to be computed may read one."""
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def planned_bytes(df: DataFrame) -> int:
    """The planner's size of ``df`` in bytes (files read, no job)."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
