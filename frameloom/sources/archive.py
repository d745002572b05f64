"""Changes of the archive's files and of the index that goes with them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.sources.snapshot import SnapshotTable


def _unlink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import os

    for b in batches:
        deleted, error = [], []
        for path in b.column("path").to_pylist():
            try:
                os.unlink(path.removeprefix("file://"))
                deleted.append(True)
                error.append(None)
            except FileNotFoundError:  # gone already: a plan may be applied twice
                deleted.append(False)
                error.append(None)
            except OSError as e:
                deleted.append(False)
                error.append(e.strerror or str(e))
        yield pa.RecordBatch.from_arrays([b.column("path"), b.column("size_bytes"), pa.array(deleted, pa.bool_()), pa.array(error, pa.string())], names=["path", "size_bytes", "deleted", "error"])


def apply_retention(index: SnapshotTable, plan: DataFrame, doomed: DataFrame) -> DataFrame:
    """Carry out a retention plan: index rows first, then files (SK9).

    ``plan``: path, size_bytes, doomed (see :func:`frameloom.operators.health.retention_plan`);
    ``doomed``: chunk_id of the rows to go. Captions must not outlive their
    footage, so the index is published without the rows before any file goes.
    Only parts of the index that hold such a row are written again. A file that
    can't be deleted is reported and the others go on; one that is gone is no
    error, so a plan may be applied again. Files are on storage that all
    executors share. Returns ``(path, size_bytes, deleted, error)``, one row a
    file, written before it returns.
    """
    from frameloom.session import cut

    ids = cut(doomed.select("chunk_id").distinct())
    parts = {r[0] for r in index.read().join(ids, "chunk_id", "left_semi").select(index.part).distinct().collect()}  # at most the number of parts
    if parts:
        index.replace(index.read(parts).join(ids, "chunk_id", "left_anti"), parts)
    files = plan.filter("doomed").select("path", F.col("size_bytes").cast("long").alias("size_bytes"))
    return cut(files.mapInArrow(_unlink, "path string, size_bytes bigint, deleted boolean, error string"))


def retention_figures(done: DataFrame) -> DataFrame:
    """Files deleted, bytes freed and errors of :func:`apply_retention`."""
    return done.agg(F.count_if("deleted").alias("files_deleted"), F.coalesce(F.sum(F.when(F.col("deleted"), F.col("size_bytes"))), F.lit(0)).alias("bytes_freed"), F.count("error").alias("errors"))
