"""Line logs, listings and small configuration tables as sources and sinks."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.session import cut
from pyspark.sql import types as T

from frameloom.functions.timefmt import name_parts


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType, *, strict: bool = False, kind: str | None = None) -> DataFrame:
    """JSON rows, one a line (SC1, SC3, SC4).

    ``strict`` fails on a line that can't be read; otherwise such lines are
    left out, and :func:`corrupt_lines` lists them. ``kind`` picks the rows of
    one kind of a log of several.
    """
    reader = spark.read.schema(schema)
    if strict:
        df = reader.option("mode", "FAILFAST").json(path)
    else:
        df = reader.option("mode", "DROPMALFORMED").json(path)
    return df.filter(F.col("kind") == kind) if kind is not None else df


def corrupt_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The lines of a log that don't fit its schema."""
    s = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    parsed = spark.read.text(path).select("value", F.from_json("value", s, {"mode": "PERMISSIVE"}).alias("r"))
    return parsed.filter(F.col("r._corrupt_record").isNotNull()).select("value")


def append_jsonl(rows: DataFrame, path: str) -> None:
    """Append rows as JSON lines (SK6, SK7, SK14)."""
    rows.write.mode("append").json(path)


def list_archive(spark: SparkSession, folder: str, pattern: str, camera: str | None = None) -> DataFrame:
    """Segment files of an archive: camera_id, path, start, mtime, size_bytes (SC5, SC7).

    Files of other names are left out; contents are not read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size_bytes"))
    named = files.withColumn("n", name_parts(F.element_at(F.split("path", "/"), -1), pattern)).filter("n is not null")
    out = named.select(F.col("n.camera_id").alias("camera_id"), "path", F.col("n.start").alias("start"), "mtime", "size_bytes")
    return out.filter(F.col("camera_id") == camera) if camera is not None else out


def list_inbox(spark: SparkSession, folder: str, suffixes=(".mp4", ".mov", ".mkv"), *, quiet_s: float = 0.0) -> DataFrame:
    """Files to import, oldest first (SC13); with ``quiet_s`` only those unchanged for that long (SC14)."""
    files = spark.read.format("binaryFile").load(folder).select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size_bytes"))
    name = F.element_at(F.split("path", "/"), -1)
    ok = F.lit(False)
    for s in suffixes:
        ok = ok | F.lower(name).endswith(s)
    files = files.filter(ok & ~name.startswith("."))
    if quiet_s > 0:
        files = files.filter(F.col("mtime") <= F.current_timestamp() - F.make_dt_interval(secs=F.lit(quiet_s)))
    return files.orderBy("mtime", "path")


def read_segment_list(spark: SparkSession, path: str) -> DataFrame:
    """``file, start, end`` of a segment list, in order of start; rows that can't be read are left out (SC15)."""
    return spark.read.schema("file string, start double, end double").option("mode", "DROPMALFORMED").csv(path).filter("start is not null").orderBy("start")


TASK_SCHEMA = "task_id string, describe_text string, window_s int, action string, cooldown int, active string, enabled boolean"
_REQUIRED = ("task_id", "describe", "window", "action")


def task_rows(items: list[dict]) -> list[tuple]:
    """Checked task rows (SC10, F-V2): a missing required field or a repeated id raises."""
    out, seen = [], set()
    for t in items:
        lost = [k for k in _REQUIRED if t.get(k) in (None, "")]
        if lost:
            raise ValueError(f"task {t.get('task_id')!r} lacks {', '.join(lost)}")
        if t["task_id"] in seen:
            raise ValueError(f"task id {t['task_id']!r} is repeated")
        if int(t["window"]) < 0 or int(t.get("cooldown", 300)) < 0:
            raise ValueError(f"task {t['task_id']!r} has a negative window or cooldown")
        seen.add(t["task_id"])
        out.append((t["task_id"], t["describe"], int(t["window"]), t["action"], int(t.get("cooldown", 300)), t.get("active", "00:00-24:00"), bool(t.get("enabled", True))))
    return out


def load_tasks(spark: SparkSession, seed: str, store: str | None = None) -> DataFrame:
    """Tasks of the store if it is there, else of the seed (SC10, SC11).

    A missing seed is empty; a store that can't be read gives no tasks at all
    and never falls back to the seed. Both are small JSON or YAML files.
    """
    items: list[dict] = []
    if store is not None and Path(store).exists():
        try:
            items = _items(store)
        except (ValueError, KeyError, TypeError):
            items = []
    elif Path(seed).exists():
        items = _items(seed)
    return spark.createDataFrame(task_rows(items), TASK_SCHEMA)


def _items(path: str) -> list[dict]:
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith((".yaml", ".yml")):
        import yaml

        data = yaml.safe_load(text)
    else:
        data = json.loads(text)
    return list((data or {}).get("tasks", []) if isinstance(data, dict) else data)


class LineTail:
    """New rows of one growing line log, from a cursor (SC2, SC3).

    A poll reads from the byte offset where the last one ended, at most
    ``most`` bytes, and leaves an unfinished last line for the next. A file
    that has become shorter was written anew: reading starts over, and
    ``restarts`` counts it, so that a caller drops what it held. A missing file
    gives nothing. ``offset`` may be stored and given back after a restart.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, *, offset: int = 0, most: int = 16_000_000) -> None:
        self.spark, self.path, self.schema, self.offset, self.most, self.restarts = spark, path, schema, offset, most, 0

    def poll(self) -> DataFrame:
        """The rows that are complete since the last poll; lines that can't be read are left out."""
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        lines: list[tuple[str]] = []
        if fs.exists(at):
            size = fs.getFileStatus(at).getLen()
            if size < self.offset:
                self.offset, self.restarts = 0, self.restarts + 1
            source = fs.open(at)
            try:
                source.seek(self.offset)
                block = bytes(source.readNBytes(int(min(self.most, size - self.offset))))
            finally:
                source.close()
            block = block[: block.rfind(b"\n") + 1]
            self.offset += len(block)
            lines = [(x.decode("utf-8", "replace"),) for x in block.split(b"\n") if x.strip()]
        rows = self.spark.createDataFrame(lines, "line string").select(F.from_json("line", f"{self.schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
        return rows.filter("r is not null and r._bad is null").select("r.*").drop("_bad")


class LogView:
    """The rows of a line log that is rewritten as a whole; a torn file keeps the view that was there (SC1)."""

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, path, schema
        self.rows: DataFrame = spark.createDataFrame([], schema)
        self._stamp: tuple | None = None

    def refresh(self) -> bool:
        """Load the log again if it has changed since and every line of it can be read; whether it was loaded."""
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return False
        status = fs.getFileStatus(at)
        stamp = (status.getModificationTime(), status.getLen())
        if stamp == self._stamp:
            return False
        lines = self.spark.read.text(self.path).filter("trim(value) <> ''")
        parsed = lines.select(F.from_json("value", f"{self.schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
        # Written out, so that the view doesn't change under its readers.
        made = cut(parsed)
        after = fs.getFileStatus(at)
        if (after.getModificationTime(), after.getLen()) != stamp or not made.filter("r is null or r._bad is not null").isEmpty():
            return False
        self.rows, self._stamp = made.select("r.*").drop("_bad"), stamp
        return True


def watchlist(tasks: DataFrame, most: int = 8) -> list[str]:
    """Descriptions of enabled tasks, blank ones left out, at most ``most`` (SC12)."""
    rows = tasks.filter("enabled and trim(describe_text) <> ''").select("describe_text").orderBy("task_id").limit(most).collect()
    return [r[0] for r in rows]


def publish(path: str, data) -> None:
    """Write a small JSON document so that readers see the old or the new one (SK8, SK10)."""
    target = Path(path)
    draft = target.with_name(f".{target.name}.tmp")
    draft.write_text(json.dumps(data, ensure_ascii=False, indent=1), encoding="utf-8")
    draft.replace(target)


def lookup(tree: dict, dotted: str, default=None, *, required: bool = False):
    """A value of a configuration tree by dotted path (F-MP2)."""
    at = tree
    for part in dotted.split("."):
        if not isinstance(at, dict) or part not in at:
            if required:
                raise KeyError(dotted)
            return default
        at = at[part]
    return at


def deep_merge(a: dict, b: dict) -> dict:
    """b over a, one level deep (F-MP1)."""
    return {**a, **{k: {**a[k], **v} if isinstance(v, dict) and isinstance(a.get(k), dict) else v for k, v in b.items()}}
