"""Deep-analysis jobs and the turns that wait for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameloom.operators.health import confidence
from frameloom.operators.timeline import US, covered_seconds, tile_ranges

#: States after which a job does not change any more.
FINAL = ("done", "failed", "timeout")


def request_problems(requests: DataFrame, *, most_s: float = 300.0, least_question: int = 1) -> DataFrame:
    """Requests ``(req, t0, t1, question)`` with ``state`` and ``error`` (F-V5).

    A request without times, with an end not after its start, or without a
    question is refused; one longer than ``most_s`` is a failed job. The others
    are queued.
    """
    length = (F.col("t1") - F.col("t0")) / US
    error = (
        F.when(F.col("t0").isNull() | F.col("t1").isNull(), "a bound is missing")
        .when(F.col("t1") <= F.col("t0"), "the range is empty")
        .when(F.length(F.trim(F.coalesce("question", F.lit("")))) < least_question, "the question is empty")
        .when(length > most_s, F.format_string(f"%.1f seconds are more than the {most_s:g} that one job may take", length))
    )
    return requests.withColumn("error", error).withColumn("state", F.when(error.isNull(), "queued").when(length > most_s, "failed").otherwise("refused"))


def coverage_record(requests: DataFrame, segments: DataFrame) -> DataFrame:
    """What the archive holds of each request ``(req, camera_id, t0, t1)`` (Q23).

    ``requested_s, covered_s, gap_s``, the gaps in order as ``(start_us,
    end_us)``, the files in order of first use, and ``refused`` where nothing
    is covered.
    """
    spans = tile_ranges(requests.select("req", "camera_id", "t0", "t1"), segments)
    holes = F.array_sort(F.collect_list(F.when(F.col("is_gap"), F.struct(F.col("span_start").alias("start_us"), F.col("span_end").alias("end_us")))))
    used = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(~F.col("is_gap"), F.struct("span_start", "path")))), lambda x: x["path"]))
    # A request's spans are the files of a bounded range.
    parts = spans.groupBy("req").agg(holes.alias("gaps"), used.alias("segments"))
    rows = requests.select("req", ((F.col("t1") - F.col("t0")) / US).alias("requested_s")).join(covered_seconds(spans).select("req", "covered_s"), "req", "left").join(parts, "req", "left")
    rows = rows.withColumn("covered_s", F.coalesce("covered_s", F.lit(0.0)))
    return rows.withColumn("gap_s", F.greatest(F.lit(0.0), F.col("requested_s") - F.col("covered_s"))).withColumn("refused", F.col("covered_s") <= 0)


def deep_results(requests: DataFrame, segments: DataFrame, answers: DataFrame, *, fps: float = 1.0, most_s: float = 300.0, hedged: Column | None = None, hedge_factor: float = 0.35) -> DataFrame:
    """The final row of every request (Q22): validated, covered, answered, with its confidence.

    ``answers``: req, answer, decoded (frames). A request that is refused, too
    long, not covered, or of which nothing could be decoded fails with its
    reason; one without an answer row fails as well.
    """
    asked = request_problems(requests, most_s=most_s)
    record = coverage_record(asked.filter("state = 'queued'"), segments)
    rows = asked.join(record, "req", "left").join(answers.select("req", "answer", "decoded"), "req", "left")
    expected = F.ceil(F.col("covered_s") * fps)
    error = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(F.col("refused"), "the archive holds nothing of this range")
        .when(F.coalesce("decoded", F.lit(0)) <= 0, "no frame could be decoded")
        .when(F.col("answer").isNull(), "no answer came back")
    )
    doubt = F.lit(False) if hedged is None else hedged
    sure = confidence(F.col("requested_s"), F.col("covered_s"), F.col("decoded"), expected, doubt, hedge_factor)
    note = F.when(F.col("gap_s") > 0, F.format_string("%.1f of %.1f seconds are not recorded", "gap_s", "requested_s"))
    rows = rows.withColumn("error", error).withColumn("state", F.when(F.col("error").isNull(), "done").otherwise("failed"))
    done = F.col("state") == "done"
    return rows.select("req", "state", "error", F.when(done, F.col("answer")).alias("answer"), F.when(done, sure).alias("confidence"), F.when(done, note).alias("note"), "requested_s", "covered_s", "gap_s", "gaps", "segments")


def settle(events: DataFrame, *, now_us: int, deadline_s: float = 90.0) -> DataFrame:
    """One row per job with exactly one final state (ST10).

    ``events``: job_id, ts, state. The first final event within the deadline,
    counted from the job's first event, stands; later ones are dropped
    (``dropped``). A job without one is timed out once ``now_us`` is past its
    deadline, and stays as it is before.
    """
    limit = int(deadline_s * US)
    first = events.groupBy("job_id").agg(F.min("ts").alias("since"), F.max(F.struct("ts", "state")).alias("latest"))
    ends = events.filter(F.col("state").isin(*FINAL)).join(first.select("job_id", "since"), "job_id")
    best = ends.groupBy("job_id").agg(F.min(F.when(F.col("ts") <= F.col("since") + limit, F.struct("ts", "state"))).alias("end"), F.count(F.lit(1)).alias("n"))
    late = F.lit(now_us) > F.col("since") + limit
    rows = first.join(best, "job_id", "left")
    state = F.when(F.col("end").isNotNull(), F.col("end.state")).when(late, "timeout").otherwise(F.when(F.col("latest.state").isin(*FINAL), "running").otherwise(F.col("latest.state")))
    at = F.when(F.col("end").isNotNull(), F.col("end.ts")).when(late, F.col("since") + limit).otherwise(F.col("latest.ts"))
    return rows.select("job_id", state.alias("state"), at.alias("ts"), (F.coalesce("n", F.lit(0)) - F.when(F.col("end").isNotNull(), 1).otherwise(0)).alias("dropped"))


def worker_counters(jobs: DataFrame) -> DataFrame:
    """Jobs by their last state, and how many are not final (AG17). ``jobs``: job_id, state, one row each."""
    return jobs.agg(F.count(F.lit(1)).alias("submitted"), *[F.count_if(F.col("state") == s).alias(s) for s in FINAL], F.count_if(~F.col("state").isin(*FINAL)).alias("live"))


def latest_turns(turns: DataFrame) -> DataFrame:
    """Each turn once, as its last row says (equal times: by bytes of the answer)."""
    others = [c for c in turns.columns if c != "turn_id"]
    return turns.filter("turn_id is not null").groupBy("turn_id").agg(F.max(F.struct("ts", *[c for c in others if c != "ts"])).alias("r")).select("turn_id", *[F.col(f"r.{c}").alias(c) for c in others])


def answered_turns(turns: DataFrame, jobs: DataFrame) -> DataFrame:
    """Turns with their job's state, the refined answer after their own (J7). ``jobs``: job_id, state, answer, one row each."""
    j = jobs.select("job_id", F.col("state").alias("job_state"), F.col("answer").alias("_refined"))
    refined = (F.col("job_state") == "done") & (F.coalesce("_refined", F.lit("")) != "")
    return turns.join(j, "job_id", "left").withColumn("answer", F.when(refined, F.concat_ws("\n\n", "answer", "_refined")).otherwise(F.col("answer"))).drop("_refined")


def waiting_turns(turns: DataFrame) -> DataFrame:
    """The turns that wait for each job, in order."""
    rows = turns.filter("coalesce(job_id, '') <> ''").groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("ts", "turn_id"))).alias("t"))
    return rows.select("job_id", F.col("t.turn_id").alias("turn_ids"))


def chat_history(turns: DataFrame, jobs: DataFrame, live: DataFrame | None = None, *, most: int = 50) -> DataFrame:
    """The newest turns, oldest first, with their jobs; a live job's state outranks the stored one (Q26)."""
    if live is not None:
        jobs = jobs.join(live.select("job_id"), "job_id", "left_anti").unionByName(live.select(*jobs.columns))
    newest = latest_turns(turns).orderBy(F.desc("ts"), F.desc("turn_id")).limit(most)
    return answered_turns(newest, jobs).orderBy("ts", "turn_id")


def look_back(now_us: int, t_from: int | None = None, t_to: int | None = None, *, widened: bool = False, usual_s: float = 1800, wide_s: float = 86_400) -> tuple[int | None, int | None]:
    """Bounds of a search: the last half hour, or day if widened, unless a bound is given (Q20)."""
    if t_from is not None or t_to is not None:
        return t_from, t_to
    return now_us - int((wide_s if widened else usual_s) * US), now_us


def span_of(hits: DataFrame) -> DataFrame:
    """Number of hits, earliest start and latest end; null without hits (P5, AG22)."""
    return hits.agg(F.count(F.lit(1)).alias("returned"), F.min("t_start").alias("t_start"), F.max("t_end").alias("t_end"))


def newest_per(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of every key."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
