"""Versioned tables: a version is a manifest that names folders of rows.

Rows are written first, into folders that no reader knows.  Then the manifest
``<version>.manifest`` is created, never replaced; the current version is the
highest manifest there is.  So at any moment a reader sees a whole version, a
job lost before the last step leaves the table as it was, and of two writers of
one version the second fails.  ``append`` writes only its own rows: the new
manifest names the folders of the last one and the new folder.  A table of more
than ``MAX_PARTS`` folders is written anew as one.  The newest versions are
kept; folders that only older ones name are deleted.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of a version before an append writes the table anew.
MAX_PARTS = 64
END = ".manifest"


class SnapshotStore:
    def __init__(self, spark: SparkSession, root: str, keep: int = 5):
        self.spark, self.root, self.keep = spark, root.rstrip("/"), keep
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))

    def versions(self, table: str) -> list[int]:
        folder = self._path(f"{self.root}/{table}")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[: -len(END)]) for n in names if n.endswith(END) and n[: -len(END)].isdigit())

    def current(self, table: str) -> int | None:
        return max(self.versions(table), default=None)

    def parts(self, table: str, version: int) -> list[str]:
        """The folders of a version."""
        stream = self._fs.open(self._path(f"{self.root}/{table}/{version}{END}"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return text.split()

    def read(self, table: str, version: int | None = None) -> DataFrame | None:
        v = self.current(table) if version is None else version
        return None if v is None else self.spark.read.parquet(*[f"{self.root}/{table}/{p}" for p in self.parts(table, v)])

    def _commit(self, table: str, version: int, parts: list[str]) -> int:
        """Create the manifest by a rename onto a name that must not be there yet."""
        temporary = self._path(f"{self.root}/{table}/.next-{uuid.uuid4().hex}")
        stream = self._fs.create(temporary, True)
        stream.write(bytearray("\n".join(parts).encode()))
        stream.close()
        target = self._path(f"{self.root}/{table}/{version}{END}")
        if self._fs.exists(target) or not self._fs.rename(temporary, target):
            self._fs.delete(temporary, False)
            raise RuntimeError(f"version {version} of {table} was published by another writer")
        self._prune(table)
        return version

    def _prune(self, table: str) -> None:
        versions = self.versions(table)
        old, kept = versions[: -self.keep], versions[-self.keep :]
        used = {p for v in kept for p in self.parts(table, v)}
        for v in old:
            for p in set(self.parts(table, v)) - used:
                self._fs.delete(self._path(f"{self.root}/{table}/{p}"), True)
            self._fs.delete(self._path(f"{self.root}/{table}/{v}{END}"), False)

    def _write(self, table: str, df: DataFrame) -> str:
        part = f"part-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{table}/{part}")
        return part

    def publish(self, table: str, df: DataFrame) -> int:
        """``df`` as the whole table."""
        version = (self.current(table) or 0) + 1
        return self._commit(table, version, [self._write(table, df)])

    def append(self, table: str, df: DataFrame) -> int:
        """The rows of ``df`` beside those of the current version."""
        version = self.current(table)
        if version is None:
            return self.publish(table, df)
        parts = self.parts(table, version)
        if len(parts) >= MAX_PARTS:
            return self.publish(table, self.read(table, version).unionByName(df))
        return self._commit(table, version + 1, [*parts, self._write(table, df)])
