"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def _local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``.

    Only where the session names none and runs in one process (local tests) a
    temporary folder is made and remembered in the session; a cluster without
    that setting is refused, since its machines share no local folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not _local(spark):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


#: Rows of an Arrow batch where the session leaves Spark's default: rows here are whole documents.
BATCH_ROWS = 1000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, and bound what they hold.

    Clusters get the package by ``--py-files`` or in their image; the path
    covers workers that share the driver's file system but not its
    ``sys.path``. Workers return freed memory to the system instead of keeping
    it in pools, and get documents in small batches.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH")) if x)
    env.setdefault("ARROW_DEFAULT_MEMORY_POOL", "system")
    env.setdefault("MALLOC_ARENA_MAX", "2")
    env.setdefault("MALLOC_TRIM_THRESHOLD_", "131072")
    if spark.conf.get(_ROWS) == "10000":
        spark.conf.set(_ROWS, str(BATCH_ROWS))


class Scratch:
    """A folder of Parquet tables that cut lineage between the jobs of one operator.

    A written table is read back from shared storage, so losing an executor
    never loses it and never recomputes non-deterministic columns.
    """

    def __init__(self, spark: SparkSession, tag: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
        self._n = 0
        self._saved: list[str] = []
        ship(spark)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        self._saved.append(path)
        return out

    def _delete(self, path: str) -> None:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        self._saved.remove(path)

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later plan reads."""
        for t in tables:
            self._delete(t._scratch_path)

    def finish(self, result: DataFrame) -> DataFrame:
        """The result as a table of its own; all tables that led to it are deleted."""
        before = list(self._saved)
        out = self.save(result, "result")
        for path in before:
            self._delete(path)
        return out

    def clear(self) -> None:
        """Delete all tables, once what was wanted from them is known."""
        for path in list(self._saved):
            self._delete(path)

    def release(self) -> None:
        """Let Spark's cleaner remove the shuffle files of finished jobs.

        The files go once the driver's garbage is collected; a long operator
        asks for that between its passes so that they do not add up on disk. A
        single process has no need of it.
        """
        if _local(self.spark):
            return
        # one collection drops the plans, the next the shuffles that they held
        for _ in range(2):
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
            time.sleep(0.5)
