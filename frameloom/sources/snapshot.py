"""A table of immutable parquet parts whose set of current parts is replaced atomically.

Each part value has its own folder of files; a manifest names the folder of
every part, and may hold facts of the parts and of the table. A new version
writes the folders of the parts it changes, then publishes a new manifest by
one rename. A reader sees the old or the new version, never a mixture, and a
writer that dies leaves only unreferenced folders, which :meth:`vacuum`
deletes. Everything lives under one path of a file system that all executors
share, reached through Hadoop's FileSystem.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class SnapshotTable:
    """``part`` is the integer column by which rows are stored and replaced."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, part: str = "part") -> None:
        self.spark, self.root, self.part = spark, root.rstrip("/"), part
        self.schema = schema
        jvm = spark.sparkContext._jvm
        self._jvm, self._path = jvm, jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/manifest"))

    def _versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/manifest"))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    @property
    def version(self) -> int:
        return (self._versions() or [0])[-1]

    def _load(self, version: int | None = None) -> dict:
        version = self.version if version is None else version
        if not version:
            return {"version": 0, "parts": {}, "facts": {}, "meta": {}}
        stream = self._fs.open(self._path(f"{self.root}/manifest/{version:09d}.json"))
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return {"facts": {}, "meta": {}} | json.loads(text)

    def manifest(self) -> dict[str, list[str]]:
        """The folders of every part."""
        return self._load()["parts"]

    def facts(self) -> dict[int, list]:
        """What the writers said of the parts."""
        return {int(k): v for k, v in self._load()["facts"].items()}

    def meta(self) -> dict:
        """What the writers said of the table."""
        return self._load()["meta"]

    def parts(self) -> set[int]:
        return {int(k) for k in self.manifest()}

    def read(self, parts: set[int] | None = None) -> DataFrame:
        """The current rows, of the given parts only if named."""
        paths = [p for k, folders in self.manifest().items() if parts is None or int(k) in parts for p in folders]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def replace(self, rows: DataFrame, affected: set[int] | None = None, *, facts: dict[int, list] | None = None, meta: dict | None = None, extended: set[int] | None = None) -> int:
        """Publish a version in which the affected parts hold exactly ``rows``.

        ``affected`` (default: all present parts) are the parts that are
        emptied first; rows may add parts of their own. The ``extended`` parts
        keep their rows and get further ones. ``facts`` replaces what is known
        of parts, ``meta`` of the table, in the same publication.
        """
        return self.publish(self.write(rows), affected, facts=facts, meta=meta, extended=extended)

    def write(self, rows: DataFrame) -> dict[str, str]:
        """Write rows by part, without publishing them: part -> folder."""
        folder = f"{self.root}/data/{self.version + 1:09d}-{uuid.uuid4().hex[:8]}"
        rows.select(*self.schema.fieldNames(), F.col(self.part).alias("_p")).write.partitionBy("_p").parquet(folder)
        return {s.getPath().getName()[3:]: f"{folder}/{s.getPath().getName()}" for s in self._fs.listStatus(self._path(folder)) if s.getPath().getName().startswith("_p=")}

    def publish(self, written: dict[str, str], affected: set[int] | None = None, *, facts: dict[int, list] | None = None, meta: dict | None = None, extended: set[int] | None = None) -> int:
        """Make written folders current in place of the affected parts."""
        before = self._load()
        kept = lambda d: {k: v for k, v in d.items() if affected is not None and int(k) not in affected}
        parts = kept(before["parts"])
        for k, folder in written.items():
            parts[k] = [*(before["parts"].get(k, []) if int(k) in (extended or ()) else []), folder]
        version = before["version"] + 1
        self._put(version, {"version": version, "parts": parts, "facts": kept(before["facts"]) | {str(k): v for k, v in (facts or {}).items()}, "meta": before["meta"] | (meta or {})})
        return version

    def _put(self, version: int, content: dict) -> None:
        target = self._path(f"{self.root}/manifest/{version:09d}.json")
        draft = self._path(f"{self.root}/manifest/.{version:09d}-{uuid.uuid4().hex}.tmp")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        if self._fs.exists(target) or not self._fs.rename(draft, target):
            raise RuntimeError(f"version {version} of {self.root} was published by another writer")

    def vacuum(self, keep: int = 1) -> int:
        """Delete the manifests before the last ``keep`` and every part folder that none of those names; the number of part folders deleted. Not while a reader of an older version or another writer is at work."""
        versions = self._versions()
        old, live = versions[: max(0, len(versions) - keep)], set()
        for v in versions[len(old) :]:
            live |= {p.rsplit("/data/", 1)[1] for folders in self._load(v)["parts"].values() for p in folders}
        gone = 0
        data = self._path(f"{self.root}/data")
        for folder in self._fs.listStatus(data) if self._fs.exists(data) else []:
            name = folder.getPath().getName()
            parts = [s.getPath().getName() for s in self._fs.listStatus(folder.getPath()) if s.isDirectory()]
            dead = [p for p in parts if f"{name}/{p}" not in live]
            gone += len(dead)
            for p in dead if len(dead) < len(parts) else [""]:
                self._fs.delete(self._path(f"{data}/{name}/{p}".rstrip("/")), True)
        for v in old:
            self._fs.delete(self._path(f"{self.root}/manifest/{v:09d}.json"), False)
        return gone
