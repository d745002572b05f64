"""The funnel's brakes and the tail of the chunk log as Structured Streaming."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from frameloom.operators.funnel import US, BrakeState

#: Id of the row that closes a key.
CLOSE = "\uffff"
DECISIONS = "key string, t0 bigint, t1 bigint, id string, act bigint, fired boolean, dedupe boolean, cooldown boolean, brake string, late boolean"


def chunk_tail(spark: SparkSession, path: str, schema: T.StructType, *, files_per_batch: int | None = None, glob: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Chunks as they arrive, each id once within the watermark (SC2, ST15)."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    rows = reader.parquet(path)
    rows = rows.withColumn("t_start", F.col("t_start").cast("timestamp")).withColumn("t_end", F.col("t_end").cast("timestamp"))
    return rows.withWatermark("t_start", delay).dropDuplicatesWithinWatermark(["chunk_id"])


def _decide(pad_us: int, hold_us: int):
    """Requests of a key in order of (t0, id), held back until ``hold_us`` later ones were seen."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, ranges, waiting, done, top = json.loads(state.get[0]) if state.exists else (None, [], [], None, None)
        s = BrakeState(last, [tuple(r) for r in ranges])
        rows = [list(r) for b in batches for r in b[["t0", "t1", "id", "act", "cooldown_us"]].itertuples(index=False)]
        rows = [[int(r[0]), int(r[1]), r[2], int(r[3]), int(r[4])] for r in rows]
        if rows:
            top = max([r[0] for r in rows] + ([] if top is None else [top]))
        late = [] if done is None else [r for r in rows if [r[0], r[2]] <= done]
        fresh = rows if done is None else [r for r in rows if [r[0], r[2]] > done]
        waiting = sorted(waiting + fresh, key=lambda r: (r[0], r[2]))
        flush = any(r[2] == CLOSE for r in rows)
        out = []
        while waiting and (flush or waiting[0][0] <= top - hold_us):
            t0, t1, ident, act, cd = waiting.pop(0)
            if ident == CLOSE:
                continue
            s.forget_before(t0, pad_us)
            d, c = s.decide(act, t0, t1, cd, pad_us)
            done = [t0, ident]
            out.append((key[0], t0, t1, ident, act, not d and not c, d, c, "dedupe" if d else "cooldown" if c else None, False))
        out += [(key[0], r[0], r[1], r[2], r[3], False, False, False, None, True) for r in late]
        state.update((json.dumps([s.last, s.ranges, waiting, done, top]),))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in DECISIONS.split(", ")])

    return run


def stream_brakes(requests: DataFrame, *, pad_s: float = 5.0, hold_s: float = 0.0) -> DataFrame:
    """Decisions of a stream of requests, as :func:`frameloom.operators.funnel.brakes` makes them (ST4).

    Requests may arrive out of order by up to ``hold_s`` of their t0; they are
    held until then and decided in order. One that comes later than that is
    not dropped: it comes out undecided with ``late`` set. A row with the id
    ``CLOSE`` and a t0 after all others closes a key: what is held comes out.
    """
    return requests.groupBy("key").applyInPandasWithState(_decide(int(pad_s * US), int(hold_s * US)), DECISIONS, "s string", "append", GroupStateTimeout.NoTimeout)


def stream_verdicts(actions: DataFrame, jobs: DataFrame, *, delay: str = "10 minutes", deadline: str = "90 seconds") -> DataFrame:
    """Fired actions joined to the verdict of their deep job within a deadline; no verdict leaves null (ST6, ST10, J10).

    ``actions``: job_id, acted_at; ``jobs``: job_id, done_at, verdict.
    """
    a = actions.withWatermark("acted_at", delay).alias("a")
    j = jobs.withWatermark("done_at", delay).alias("j")
    on = (F.col("a.job_id") == F.col("j.job_id")) & (F.col("j.done_at") >= F.col("a.acted_at")) & (F.col("j.done_at") <= F.col("a.acted_at") + F.expr(f"interval {deadline}"))
    return a.join(j, on, "left_outer").select("a.*", F.col("j.done_at").alias("done_at"), F.col("j.verdict").alias("verdict"))


def split_late(batch: DataFrame, seen_until_us: int | None, ts: str = "t_start") -> tuple[DataFrame, DataFrame]:
    """Rows of a micro-batch within and behind the watermark; the latter go to a table of their own."""
    if seen_until_us is None:
        return batch, batch.limit(0)
    late = F.unix_micros(F.col(ts).cast("timestamp")) < seen_until_us
    return batch.filter(~late), batch.filter(late)


def _there(spark: SparkSession, path: str) -> bool:
    """Whether a folder exists; any other fault of the storage is raised."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


class LateSink:
    """``foreachBatch`` sink: on-time rows to one folder, late ones to another, none lost.

    The watermark is the latest event time of earlier batches less the delay.
    Every batch leaves its latest time as a row of its own, so that neither a
    restart nor a batch that is tried again has to read the output, or counts
    itself.
    """

    def __init__(self, folder: str, delay_s: float, ts: str = "t_start") -> None:
        self.main, self.side, self.marks, self.delay_us, self.ts = f"{folder}/main", f"{folder}/late", f"{folder}/marks", int(delay_s * US), ts

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        until = None
        if _there(spark, self.marks):
            top = spark.read.parquet(self.marks).filter(F.col("batch") < batch_id).agg(F.max("top")).head()[0]
            until = None if top is None else top - self.delay_us
        on_time, late = split_late(batch, until, self.ts)
        # A batch that is tried again overwrites its own folders; its mark comes last.
        on_time.write.mode("overwrite").parquet(f"{self.main}/batch={batch_id}")
        late.write.mode("overwrite").parquet(f"{self.side}/batch={batch_id}")
        on_time.agg(F.max(F.unix_micros(F.col(self.ts).cast("timestamp"))).alias("top")).write.mode("overwrite").parquet(f"{self.marks}/batch={batch_id}")


def outbox(folder: str, key: str = "idempotency_key"):
    """``foreachBatch`` sink of messages to push: each key once, whatever is tried again (SK11, ST14)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.dropDuplicates([key])
        if _there(batch.sparkSession, folder):
            rows = rows.join(batch.sparkSession.read.parquet(folder).filter(F.col("batch") != batch_id).select(key), key, "left_anti")
        rows.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return write


class Monitor:
    """One step of watching: read what is new, observe it, tell the listeners, settle what is pending (ST8).

    A read that fails leaves everything as it was and is tried again with the
    next step; a listener that fails does not keep the others from being told.
    ``faults`` holds what went wrong, newest last, at most ``keep``.
    """

    def __init__(self, read, observe, listeners=(), settle=None, *, keep: int = 100) -> None:
        self.read, self.observe, self.listeners, self.settle, self.keep = read, observe, list(listeners), settle, keep
        self.faults: list[tuple[str, str]] = []
        self.steps = 0

    def _note(self, where: str, fault: Exception) -> None:
        self.faults = [*self.faults, (where, f"{type(fault).__name__}: {fault}")][-self.keep :]

    def step(self) -> DataFrame | None:
        """What was observed; None if nothing could be read."""
        self.steps += 1
        try:
            seen = self.observe(self.read())
        except Exception as fault:  # noqa: BLE001  noted, and tried again with the next step
            self._note("read", fault)
            seen = None
        for tell in self.listeners if seen is not None else ():
            try:
                tell(seen)
            except Exception as fault:  # noqa: BLE001  noted; the others are told
                self._note("listener", fault)
        if self.settle is not None:
            try:
                self.settle()
            except Exception as fault:  # noqa: BLE001  noted, and tried again with the next step
                self._note("settle", fault)
        return seen


def run_available(df: DataFrame, folder: str, *, mode: str = "append", sink=None) -> None:
    """Drive a stream over all that is there, with its checkpoint below ``folder``."""
    w = df.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    w = w.foreachBatch(sink) if sink is not None else w.format("parquet").option("path", f"{folder}/out")
    w.start().awaitTermination()
