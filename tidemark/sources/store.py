"""Versioned Parquet tables with atomic commits.

A table version is a directory that is never changed. A manifest names the
version of every table; a commit writes the new versions first and then creates
the next manifest, which fails if another commit created it before.

A table may be dealt over buckets by a hash of its key. The manifest then names
a directory for each bucket, and a commit that touched some buckets writes only
those: what a small transaction costs does not grow with the table.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import OptimisticConflict
from ..model import AXIS_COLUMNS, Model
from ..operators.keys import Sequence
from ..operators.temporal import is_open
from .catalog import Catalog

BUCKET = "_bucket"


class Bucketed:
    """A committed table in buckets: all of it, or some."""

    def __init__(self, store: Store, entry: dict[str, Any]) -> None:
        self.store, self.key, self.count = store, list(entry["key"]), int(entry["buckets"])
        self.schema = T.StructType.fromJson(entry["schema"])
        self.paths: dict[int, str] = {int(b): p for b, p in entry["paths"].items()}

    def frame(self, buckets: Iterable[int] | None = None) -> DataFrame:
        wanted = self.paths if buckets is None else [b for b in sorted(buckets) if b in self.paths]
        folders = [f"{self.store.root}/{self.paths[b]}" for b in wanted]
        return self.store.spark.read.schema(self.schema).parquet(*folders) if folders else self.store.spark.createDataFrame([], self.schema)

    def number(self) -> Column:
        """The bucket of a row, from its key columns."""
        return bucket_of(self.key, self.count)

    def touched(self, rows: DataFrame) -> set[int]:
        """The buckets of some rows: at most as many numbers as there are buckets."""
        return {r[0] for r in rows.select(self.number()).distinct().collect()}


def bucket_of(key: list[str], count: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(c) for c in key]), F.lit(count)).cast("int")


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._io = jvm.org.apache.commons.io.IOUtils
        self._fs.mkdirs(self._path(f"{self.root}/manifests"))

    def head(self) -> int:
        """The number of the last commit, 0 before the first."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/manifests"))]
        return max((int(n[:-5]) for n in names if n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict[str, Any]:
        n = self.head() if version is None else version
        if not n:
            return {}
        stream = self._fs.open(self._path(f"{self.root}/manifests/{n:08d}.json"))
        try:
            return json.loads(self._io.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def catalog(self, version: int | None = None) -> Catalog:
        """All tables as of a commit."""
        tables, buckets = {}, {}
        for t, p in self.manifest(version).items():
            if t[0] == "#":
                continue
            if isinstance(p, dict):
                buckets[t] = Bucketed(self, p)
                tables[t] = buckets[t].frame
            else:
                tables[t] = lambda p=p: self.spark.read.parquet(f"{self.root}/{p}")
        return Catalog(tables, buckets)

    def _write_buckets(self, name: str, df: DataFrame, path: str, key: list[str], count: int, old: dict[int, str]) -> dict[str, Any]:
        """Write the rows and name the folder of each bucket; ``old`` are those that stay."""
        schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema])
        df.withColumn(BUCKET, bucket_of(key, count)).repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{self.root}/{path}")
        made = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/{path}")) if s.isDirectory()]
        new = {int(n.partition("=")[2]): f"{path}/{n}" for n in made if n.startswith(f"{BUCKET}=")}
        paths = {str(b): p for b, p in sorted((old | new).items())}
        return {"key": key, "buckets": count, "schema": schema.jsonValue(), "paths": paths}

    def commit(
        self,
        tables: dict[str, DataFrame],
        based_on: int | None = None,
        partition_by: dict[str, list[str]] | None = None,
        notes: dict[str, Any] | None = None,
        buckets: dict[str, tuple[int, list[str]]] | None = None,
        touched: dict[str, set[int]] | None = None,
    ) -> int:
        """Write tables and publish them together; the new commit's number.

        ``notes`` are published with them under names that begin with ``#``.
        ``buckets`` deals a table over that many buckets by its key, now and in
        later commits. Of a table in ``touched`` only these buckets are given
        and written; the others stay as they are.

        Raises a conflict if someone committed after ``based_on``; what was
        written then is an unused directory and no version.
        """
        base = self.head() if based_on is None else based_on
        paths = self.manifest(base) | (notes or {})
        for name, df in tables.items():
            path = f"tables/{name}/{base + 1:08d}-{uuid.uuid4().hex}"
            before = paths.get(name)
            if name in (buckets or {}) or isinstance(before, dict):
                count, key = (buckets or {})[name] if name in (buckets or {}) else (before["buckets"], before["key"])
                some = (touched or {}).get(name)
                old = {int(b): p for b, p in before["paths"].items() if int(b) not in some} if some is not None else {}
                paths[name] = self._write_buckets(name, df, path, key, count, old)
                continue
            writer = df.write
            if cols := (partition_by or {}).get(name):
                writer = writer.partitionBy(*cols)
            writer.parquet(f"{self.root}/{path}")
            paths[name] = path
        draft = self._path(f"{self.root}/manifests/{uuid.uuid4().hex}.part")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(paths).encode()))
        out.close()
        target = self._path(f"{self.root}/manifests/{base + 1:08d}.json")
        # rename does not replace an existing file
        if self._fs.exists(target) or not self._fs.rename(draft, target):
            self._fs.delete(draft, False)
            raise OptimisticConflict(f"commit {base + 1} exists already")
        return base + 1


def clustered(model: Model, name: str, df: DataFrame) -> DataFrame:
    """A temporal table with its current rows apart (column ``is_current``) and sorted by key and start.

    Written with ``partition_by={table: ["is_current"]}``, reads of the latest
    state prune the past, and point reads skip row groups by key.
    """
    if "transaction" not in model.axes(name):
        return df
    start, end = AXIS_COLUMNS["transaction"]
    key = [a.column for a in model.primary_key(name)]
    return df.withColumn("is_current", is_open(df[end])).repartition(*key).sortWithinPartitions(*key, start)


class StoredSequence(Sequence):
    """A registry of key blocks that lives in the store's manifests: claims of any process never overlap."""

    def __init__(self, store: Store, name: str, batch: int, increment: int = 1, start: int = 1) -> None:
        super().__init__(batch, increment, start)
        self.store, self.name = store, f"#sequence {name}"

    def claim(self, n: int) -> int:
        while True:
            base = self.store.head()
            self.next = int(self.store.manifest(base).get(self.name, self.next))
            first = super().claim(n)
            try:
                self.store.commit({}, base, notes={self.name: self.next})
                return first
            except OptimisticConflict:
                # someone else committed: claim behind what is there now
                self.next = first
