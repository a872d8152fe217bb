"""Versioned snapshots of a small store (site history, progress of a run), each whole or not there at all.

A snapshot is a table of its own and a pointer file that names it. The pointer is written aside and
renamed to its version's name, which must be free, so that readers see the old or the new snapshot
and of two writers of one version only one succeeds. A version at or below the newest one is turned
away: what comes late or again changes nothing. What a writer leaves behind that ends before its
pointer stands is never read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class SnapshotStore:
    """Snapshots below `folder` that belong to `owner` (a site, a book's URL)."""

    def __init__(self, spark: SparkSession, folder: str, owner: str):
        self.spark, self.folder, self.owner = spark, folder.rstrip("/"), owner
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def versions(self) -> list[int]:
        """Versions with a pointer, newest first."""
        if not self._fs.exists(self._path("pointers")):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path("pointers"))]
        return sorted((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:-5].isdigit()), reverse=True)

    def version(self) -> int:
        """The newest version, -1 if there is none."""
        return next(iter(self.versions()), -1)

    def save(self, df: DataFrame, version: int) -> bool:
        """Makes `df` the snapshot of `version`; false, and nothing is done, if that is not above the newest one. `df` may be
        made from the snapshot before."""
        if version <= self.version():
            return False
        name = f"data/{version:020d}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder}/{name}")
        rows = self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}").count()
        pointer = {"owner": self.owner, "version": version, "data": name, "rows": rows, "schema": df.schema.json()}
        aside = self._path(f"pointers/.{uuid.uuid4().hex}")
        out = self._fs.create(aside, False)
        out.write(json.dumps(pointer).encode())
        out.close()
        jvm = self._jvm.org.apache.hadoop.fs
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm, "Options$Rename"), 0)
        try:
            jvm.FileContext.getFileContext(self._fs.getUri()).rename(aside, self._path(f"pointers/{version:020d}.json"), none)
        except Exception as e:
            self._fs.delete(aside, False)
            if self.version() >= version:  # another writer was first
                return False
            raise e
        return True

    def load(self) -> DataFrame | None:
        """The newest snapshot; none if there is none, if it belongs to another owner, or if its pointer or table is damaged."""
        version = self.version()
        if version < 0:
            return None
        text = "".join(r.value for r in self.spark.read.option("wholetext", True).text(f"{self.folder}/pointers/{version:020d}.json").collect())
        try:
            pointer = json.loads(text)
            schema = StructType.fromJson(json.loads(pointer["schema"]))
            sound = pointer["owner"] == self.owner and pointer["version"] == version and self._fs.exists(self._path(pointer["data"]))
        except (ValueError, KeyError, TypeError):
            return None
        if not sound:
            return None
        df = self.spark.read.schema(schema).parquet(f"{self.folder}/{pointer['data']}")
        try:
            return df if df.count() == pointer["rows"] else None
        except Exception:  # files that are no Parquet
            return None

    def keep(self, newest: int = 3) -> None:
        """Removes all snapshots but the `newest`; only readers that hold none of those may be running."""
        for version in self.versions()[newest:]:
            for f in self._fs.globStatus(self._path(f"data/{version:020d}-*")) or []:
                self._fs.delete(f.getPath(), True)
            self._fs.delete(self._path(f"pointers/{version:020d}.json"), False)


def accumulate(stream: DataFrame, store: SnapshotStore, merge: Callable[[DataFrame | None, DataFrame], DataFrame], checkpoint: str, every: str | None = None):
    """Starts a query that merges each micro-batch into the store's next snapshot: `merge(old or None, batch)`. A batch that
    was merged before a failure is not merged again. With `every` (such as "5 seconds") writes are that far apart;
    without, it takes what is there and ends."""

    def put(batch: DataFrame, number: int) -> None:
        if number > store.version():
            store.save(merge(store.load(), batch), number)
            store.keep()

    out = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()
