"""A keyed table that is brought up to date batch by batch; a batch rewrites only the buckets it touches."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from acreage.session import drop_path, local_frame

BUCKETS = 64
_BUCKET = "_snapshot_bucket"


class Snapshot:
    """Rows by a hash of their key in a fixed number of buckets below one folder.

    Each version is a small list of bucket folders; a new version names new folders for the buckets of the batch and the old ones for all others. It counts once its list is
    written completely, so a batch that dies leaves the version before it, and a batch with a number that has been applied is left out. One writer at a time. The folders of versions before the
    last ``keep`` are deleted, so files do not grow in number with the batches. Choose ``buckets`` so that a bucket fits a task; the hash keeps them even as long as a key has few rows.
    """

    def __init__(self, spark: SparkSession, root: str, key: str, buckets: int = BUCKETS, keep: int = 2):
        self.spark, self.root, self.key, self.buckets, self.keep = spark, root, key, buckets, max(1, keep)

    # ---- reading

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def _versions(self) -> list[int]:
        """Versions whose list is complete."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(os.path.join(self.root, "versions", "*", "_SUCCESS"))
        found = where.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(where)
        return sorted(int(f.getPath().getParent().getName()) for f in found or ())

    def _list(self, version: int) -> list:
        return self.spark.read.parquet(os.path.join(self.root, "versions", str(version))).collect()

    def version(self) -> int | None:
        return max(self._versions(), default=None)

    def folders(self, version: int | None = None) -> dict[int, str]:
        """Where each bucket of a version lies; buckets without rows have no folder."""
        version = self.version() if version is None else version
        return {} if version is None else {r["bucket"]: os.path.join(self.root, r["folder"]) for r in self._list(version) if r["folder"] is not None}

    def _read(self, folders: list[str], schema: str) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*folders)

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version, of the last one by default; null if there is none."""
        version = self.version() if version is None else version
        if version is None:
            return None
        head = self._list(version)[0]
        return self._read(list(self.folders(version).values()), head["schema"])

    # ---- writing

    def apply(self, batch: DataFrame, merge: Callable[[DataFrame | None, DataFrame], DataFrame], number: int | None = None) -> int:
        """A new version from the old rows of the touched buckets and the batch, both of which ``merge`` gets (no old rows: an empty frame, or null before the first version). All its rows must have
        keys of the batch's or the old rows' buckets. ``number`` is the batch's place in a sequence; one that is not above the last is skipped. Returns the version."""
        last = self.version()
        head = self._list(last)[0] if last is not None else None
        if head is not None and number is not None and head["number"] is not None and number <= head["number"]:
            return last
        old_folders = self.folders(last) if last is not None else {}
        touched = [r["b"] for r in batch.select(self.bucket().alias("b")).distinct().collect()]  # at most ``buckets`` numbers
        old = self._read([old_folders[b] for b in touched if b in old_folders], head["schema"]) if head is not None else None
        merged = merge(old, batch)
        version = 0 if last is None else last + 1
        folder = f"data/{version}"
        drop_path(self.spark, os.path.join(self.root, folder))  # left by a batch that died
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in merged.schema.fields)
        merged.withColumn(_BUCKET, self.bucket()).repartition(self.buckets, _BUCKET).write.partitionBy(_BUCKET).parquet(os.path.join(self.root, folder))
        where = self.spark._jvm.org.apache.hadoop.fs.Path(os.path.join(self.root, folder, f"{_BUCKET}=*"))
        made = where.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(where) or ()
        fresh = {int(f.getPath().getName().split("=")[1]): f"{folder}/{f.getPath().getName()}" for f in made}
        if stray := fresh.keys() - set(touched):
            raise ValueError(f"the merge made rows in buckets that the batch does not touch: {sorted(stray)[:5]}")
        kept = {b: os.path.relpath(path, self.root) for b, path in old_folders.items() if b not in touched}
        rows = [(b, path, number, schema) for b, path in (kept | fresh).items()] or [(0, None, number, schema)]
        drop_path(self.spark, os.path.join(self.root, "versions", str(version)))
        local_frame(self.spark, rows, "bucket int, folder string, number long, schema string").coalesce(1).write.parquet(os.path.join(self.root, "versions", str(version)))
        self._clean()
        return version

    def _clean(self) -> None:
        """Drop old versions, and the folders that only they name."""
        versions = self._versions()
        gone, stays = versions[:-self.keep], versions[-self.keep:]
        if not gone:
            return
        needed = {path for v in stays for path in self.folders(v).values()}
        for v in gone:
            for path in self.folders(v).values():
                if path not in needed:
                    drop_path(self.spark, path)
            drop_path(self.spark, os.path.join(self.root, "versions", str(v)))
