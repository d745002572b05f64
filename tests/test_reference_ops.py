"""Operators of the reference's semantics: boundary rows and goldens."""

from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from frameloom.functions import text as tx
from frameloom.functions import timefmt as tf
from frameloom.functions.vector import cosine, hash_embed, hash_features, l2_normalize, mean_abs_delta
from frameloom.operators import funnel, gate, health, logs, retrieval, scheduling, timeline
from frameloom.plans import data_queries, job_queries, stream_queries, watch_queries
from frameloom.sources import logs as src
from frameloom.streaming import funnel as live
from tests.compare import compare, duck

US = 1_000_000
SF = "/root/testdata/sf0.001"
UTC = dt.timezone.utc

SQL = {**data_queries.ORACLE, **stream_queries.ORACLE, **watch_queries.ORACLE, **job_queries.ORACLE}
RUN = {**data_queries.QUERIES, **stream_queries.QUERIES, **watch_queries.QUERIES, **job_queries.QUERIES}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    ok, what = compare(spark, duck(SF), name, RUN[name], SQL[name], SF)
    assert ok, what


@pytest.mark.parametrize("name", sorted(set(RUN) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert RUN[name](spark, SF).count() >= 0


def one(spark, col, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if None not in values.values() else spark.range(1).select(*[F.lit(v).cast("string").alias(k) for k, v in values.items()])
    return row.select(col.alias("x")).head()["x"]


def test_tokens_and_word_lists(spark):
    assert one(spark, tx.tokenize("t"), t="The van's door-2, ÜBER") == ["the", "van", "s", "door", "2", "ber"]
    assert one(spark, tx.bigrams("t"), t="a b c") == ["a_b", "b_c"]
    assert one(spark, tx.bigrams("t"), t="a") == []
    assert one(spark, tx.yes_no("t"), t=' "Yes", it is') is True
    assert one(spark, tx.yes_no("t"), t="yesterday") is False
    assert one(spark, tx.hedged("t"), t="I CANNOT TELL from here") is True
    assert one(spark, tx.slugify("t"), t="  Loading Dock — blocked! ") == "loading-dock-blocked"
    assert one(spark, tx.clip_text("t", 8), t="one  two\n three") == "one two…"


@pytest.mark.parametrize(
    "text, description, verdicts",
    [
        (None, "", {}),
        ("A van waits.", "A van waits.", {}),
        ("A van. WATCHING:\n- van at dock: present\n- red hat: not visible", "A van.", {"van at dock": "present", "red hat": "absent"}),
        ("Dark floor. **Watching**: a: absent, b c: present.", "Dark floor.", {"a": "absent", "b c": "present"}),
        ("Prose watching: nothing readable here", "Prose watching: nothing readable here", {}),
    ],
)
def test_caption_blocks(spark, text, description, verdicts):
    row = one(spark, tx.split_caption("t"), t=text)
    assert (row.description, row.watching) == (description, verdicts)


def test_captions_with_watch_lists_are_split(spark, tmp_path):
    captions = {
        "a": "A van waits.",
        "b": "A van. WATCHING:\n- van at dock: present\n- red hat: not visible",
        "c": "Dark floor. **Watching**: a: absent, b c: present.",
        "d": "Prose watching: nothing readable here",
        "e": "",
        "f": None,
        "g": "He is watching the door.",
    }
    full = spark.read.parquet(f"{SF}/chunks.parquet")
    rows = spark.createDataFrame(list(captions.items()), "chunk_id string, caption string")
    made = full.limit(0).unionByName(rows, allowMissingColumns=True)
    made.write.parquet(f"{tmp_path}/chunks.parquet")
    got = {r.chunk_id: (r.description, r["items"], r.n_items) for r in stream_queries.caption_verdicts(spark, str(tmp_path)).collect()}
    assert got == {
        "a": ("A van waits.", [], 0),
        "b": ("A van.", ["red hat: absent", "van at dock: present"], 2),
        "c": ("Dark floor.", ["a: absent", "b c: present"], 2),
        "d": (captions["d"], [], 0),
        "g": (captions["g"], [], 0),
    }
    whole = stream_queries.caption_verdicts(spark, SF).collect()
    assert len(whole) == full.filter("caption <> ''").select("chunk_id").distinct().count()
    assert sum(r.n_items > 0 for r in whole) > 0


def test_tasks_that_are_always_active_meet_every_event(spark):
    events = spark.read.parquet(f"{SF}/events.parquet").filter("ts is not null").count()
    always = {r.task_id for r in spark.read.parquet(f"{SF}/tasks.parquet").filter("active = '00:00-24:00'").collect()}
    got = {r.task_id: r["sum(n)"] for r in stream_queries.active_minute_counts(spark, SF).groupBy("task_id").sum("n").collect()}
    assert always and all(got[t] >= events for t in always)


def test_item_verdicts_are_three_valued(spark):
    w = F.create_map(F.lit("a van at the dock"), F.lit("present"), F.lit("red hat"), F.lit("absent"))
    assert one(spark, tx.item_verdict(w, F.col("d")), d="van at dock") is True
    assert one(spark, tx.item_verdict(w, F.col("d")), d="the red hat") is False
    assert one(spark, tx.item_verdict(w, F.col("d")), d="blue cat near gate") is None


@pytest.mark.parametrize(
    "text, grounded, reason",
    [
        ("NO — the door is not in it", False, "the door is not in it"),
        ("**Yes**\nAll terms appear.", True, "All terms appear."),
        ("Well\n- no\n\nThe plate is hidden.", False, "The plate is hidden."),
        ("yes", True, "yes"),
        ("perhaps", None, "perhaps"),
        ("", None, ""),
        (None, None, ""),
    ],
)
def test_grounded_verdicts(spark, text, grounded, reason):
    row = one(spark, tx.grounded_verdict("t"), t=text)
    assert (row.grounded, row.reason) == (grounded, reason)


@pytest.mark.parametrize(
    "text, name, arguments, prose",
    [
        ('Look again. deep(question="open?", why="detail")', "deep", {"question": "open?", "why": "detail"}, "Look again."),
        ("deep{question:<|>open?<|>,why:<|>w<|>}", "deep", {"question": "open?", "why": "w"}, "w"),
        ("so: deep{question:<|'|>a (b)?<|'|>}", "deep", {"question": "a (b)?"}, "so:"),
        ("no call (here)", None, {}, "no call (here)"),
        ("deep(question=\"a\", question='b').", "deep", {"question": "b"}, ""),
        (None, None, {}, ""),
    ],
)
def test_tool_calls(spark, text, name, arguments, prose):
    row = one(spark, tx.tool_call("t"), t=text)
    assert (row["name"], row.arguments, row.prose) == (name, arguments, prose)


def test_vectors(spark):
    assert one(spark, cosine("a", "b"), a=[0.0, 0.0], b=[1.0, 2.0]) == 0.0
    assert one(spark, cosine("a", "b", same_length=True), a=[1.0], b=[1.0, 2.0]) == 0.0
    assert one(spark, l2_normalize("a"), a=[3.0, 4.0]) == [0.6, 0.8]
    v = hash_features(["a", "b", "a"], 32)
    assert math.isclose(sum(x * x for x in v), 1.0) and hash_features([], 8) == [0.0] * 8
    assert one(spark, hash_embed("w", 32), w=["a", "b", "a"]) == v
    assert one(spark, mean_abs_delta("a", "b"), a=bytearray([0, 255]), b=bytearray([255, 255])) == 0.5


def test_times_and_names(spark):
    t = dt.datetime(2026, 1, 5, 10, 0, 0, tzinfo=UTC)
    assert one(spark, tf.iso("t"), t=t) == "2026-01-05T10:00:00Z"
    assert one(spark, tf.iso("t"), t=t.replace(microsecond=5)) == "2026-01-05T10:00:00.000005Z"
    got = one(spark, tf.name_parts("n", "{camera_id}_%Y%m%d_%H%M%S.mp4"), n="dock_1_20260105_100000.mp4")
    assert got.camera_id == "dock_1" and got.start.replace(tzinfo=UTC) == t
    assert one(spark, tf.name_parts("n", "{camera_id}_%Y%m%d_%H%M%S.mp4"), n="stray.tmp") is None
    for bad in ("%H%M.mp4", "%Y%q.mp4"):
        with pytest.raises(ValueError):
            tf.name_pattern(bad)


@pytest.mark.parametrize(
    "spec, utc, inside",
    [
        ("18:00-06:00", (13, 59, 59), True), ("18:00-06:00", (14, 0, 0), False), ("18:00-06:00", (2, 0, 0), True), ("00:00-24:00", (3, 0, 0), True),
        ("07:00-07:00", (3, 0, 0), True), ("24:30-06:00", (3, 0, 0), None), ("18:00–06:00", (3, 0, 0), None), ("08:00-09:00", (16, 59, 0), True), ("08:00-09:00", (17, 0, 0), False),
    ],
)
def test_active_hours(spark, spec, utc, inside):
    t = dt.datetime(2026, 1, 5, *utc, tzinfo=UTC)
    assert one(spark, tf.in_active_window("s", "t", "America/Los_Angeles"), s=spec, t=t) is inside


def test_rerank_and_blend_edges(spark):
    rows = [("a", "red van", 1.0, dt.datetime(2026, 1, 1)), ("b", "blue van", 1.0, dt.datetime(2026, 1, 1)), ("c", "", 1.0, dt.datetime(2026, 1, 1))]
    df = spark.createDataFrame(rows, "chunk_id string, caption string, ann_score double, t_end timestamp")
    r = {x.chunk_id: x.rerank_score for x in retrieval.lexical_rerank(df, ["red", "zebra"], text_col="caption").collect()}
    red, zebra = math.log(1 + 3 / 2), math.log(1 + 3)
    assert r["a"] == pytest.approx(red / (red + zebra)) and r["b"] == r["c"] == 0
    flat = retrieval.recency_blend(df.withColumn("rerank_score", F.lit(0.3)), order=[F.col("chunk_id")], options=retrieval.SearchOptions()).orderBy("rank").collect()
    assert [x.chunk_id for x in flat] == ["a", "b", "c"] and flat[0].combined == pytest.approx(0.4 * 0.5 + 0.6)
    assert retrieval.lexical_rerank(df, [], text_col="caption").filter("rerank_score <> 0").count() == 0


def test_tiling_covers_exactly(spark):
    seg = spark.createDataFrame([("c", "s1", 0, 60 * US), ("c", "s2", 60 * US, 120 * US), ("c", "s3", 200 * US, 260 * US), ("d", "x", 0, 900 * US)], "camera_id string, path string, start_us bigint, eff_end bigint")
    req = spark.createDataFrame([("in", "c", 10 * US, 20 * US), ("gap", "c", 100 * US, 210 * US), ("out", "c", 300 * US, 400 * US), ("all", "c", -10 * US, 1000 * US), ("none", "q", 0, US), ("bad", "c", 5, 5)], "req string, camera_id string, t0 bigint, t1 bigint")
    spans = timeline.tile_ranges(req, seg, bucket_s=50)
    by = {}
    for s in spans.orderBy("span_start").collect():
        by.setdefault(s.req, []).append(s)
    for r in req.collect():
        if r.req == "bad":
            assert "bad" not in by
            continue
        s = by[r.req]
        assert s[0].span_start == r.t0 and s[-1].span_end == r.t1 and all(a.span_end == b.span_start for a, b in zip(s, s[1:]))
    assert [x.path for x in by["gap"]] == ["s2", None, "s3"] and by["gap"][2].pts_out == 10.0
    assert len(timeline.require_complete(spans.filter("req = 'in'")).collect()) == 1
    with pytest.raises(Exception, match="footage is missing"):
        timeline.require_complete(spans.filter("req = 'gap'")).collect()


def test_effective_ends_at_the_drift(spark):
    s = spark.createDataFrame([("c", 0), ("c", 62 * US), ("c", 124 * US + 1)], "camera_id string, start_us bigint")
    got = [(r.eff_end, r.nominal) for r in timeline.effective_ends(s).orderBy("start_us").collect()]
    assert got == [(62 * US, False), (122 * US, True), (184 * US + 1, True)]


def test_window_planning(spark):
    s = spark.createDataFrame([("short", 0, 4 * US), ("exact", 0, 5 * US), ("more", 0, 13 * US)], "k string, start_us bigint, end_us bigint")
    got = timeline.plan_windows(s, 5, 4).groupBy("k").count().collect()
    assert {r.k: r["count"] for r in got} == {"exact": 1, "more": 3}
    with pytest.raises(ValueError):
        timeline.plan_windows(s, 0, 4)


REQ = "key string, t0 bigint, t1 bigint, id string, act bigint, cooldown_us bigint"


def test_brake_boundaries(spark):
    rows = [
        ("pad", 0, 10 * US, "1", 10 * US, 0), ("pad", 15 * US, 16 * US, "2", 16 * US, 0), ("pad", 20 * US, 21 * US, "3", 21 * US, 0),
        ("cool", 0, US, "1", 0, 30 * US), ("cool", 20 * US, 21 * US, "2", 30 * US, 30 * US), ("cool", 40 * US, 41 * US, "3", 59 * US, 30 * US),
        ("both", 0, 10 * US, "1", 10 * US, 60 * US), ("both", 5 * US, 12 * US, "2", 12 * US, 60 * US), (None, 0, 1, "n", 1, 0),
    ]
    got = {(r.key, r.id): (r.fired, r.brake) for r in funnel.brakes(spark.createDataFrame(rows, REQ)).collect()}
    assert got[("pad", "2")] == (True, None) and got[("pad", "3")] == (False, "dedupe")
    assert got[("cool", "2")] == (True, None) and got[("cool", "3")] == (False, "cooldown")
    assert got[("both", "2")] == (False, "dedupe") and got[(None, "n")] == (True, None)
    touch = [("z", 0, 10, "1", 10, 0), ("z", 10, 20, "2", 20, 0)]
    assert funnel.brakes(spark.createDataFrame(touch, REQ), pad_s=0).filter("fired").count() == 2


def test_one_event_fires_once(spark):
    rows = [("k", 0, (5 + 4 * i) * US, f"{i:03d}", (5 + 4 * i) * US, 300 * US) for i in range(180)]  # a run that goes on for 12 minutes
    assert funnel.brakes(spark.createDataFrame(rows, REQ)).filter("fired").count() == 1


def test_sustain_survives_holes_and_breaks_on_misses(spark):
    rows = [("t", i, ok) for i, ok in ((0, True), (4, True), (8, False), (12, True), (4000, True))]
    df = spark.createDataFrame([(t, f"{i:05d}", dt.datetime.fromtimestamp(i, UTC), dt.datetime.fromtimestamp(i + 5, UTC), ok, 9) for t, i, ok in rows], "task_id string, chunk_id string, t_start timestamp, t_end timestamp, ok boolean, window_s int")
    got = sorted((r.chunk_id, r.held_s, r.requests, r.promoted) for r in funnel.sustained(df, funnel.FunnelOptions()).collect())
    assert got == [("00000", 5.0, False, False), ("00004", 9.0, True, True), ("00012", 5.0, False, False), ("04000", 3993.0, True, True)]


def test_stream_equals_batch_out_of_order_and_late(spark, tmp_path):
    import random

    rng = random.Random(4)
    rows = [(k, t * US, (t + rng.randrange(1, 9)) * US, f"{t:05d}", (t + 9) * US, 20 * US) for k in "ab" for t in sorted(rng.sample(range(1000), 80))]
    want = {(r.key, r.id): (r.fired, r.brake) for r in funnel.brakes(spark.createDataFrame(rows, REQ)).collect()}
    late = [("a", -5000 * US, -4999 * US, "late", 0, 0)]
    parts = [[], [], []]
    for r in sorted(rows, key=lambda r: r[1] + rng.randrange(0, 60) * US):
        parts[len([x for x in (300, 650) if r[1] > x * US])].append(r)
    parts[2] += late + [(k, 10**15, 10**15, live.CLOSE, 0, 0) for k in "ab"]
    for i, p in enumerate(parts):
        spark.createDataFrame(p, REQ).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in/{i}")
    src_df = spark.readStream.schema(REQ).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/*")
    live.run_available(live.stream_brakes(src_df, hold_s=120), f"file://{tmp_path}")
    out = spark.read.schema(live.DECISIONS).parquet(f"file://{tmp_path}/out").collect()
    assert {(r.key, r.id): (r.fired, r.brake) for r in out if not r.late} == want
    assert [r.id for r in out if r.late] == ["late"]


def test_gate_reasons(spark):
    quiet, move = [[10] * 32] * 2, [[10] * 32, [200] * 32]
    rows = [("c", 0, quiet), ("c", 1, quiet), ("c", 2, quiet), ("c", 3, move), ("c", 4, None), ("c", 5, [[10] * 32]), ("c", 6, []), ("c", 7, [[0] * 30 + [90, 90], [0] * 32])]
    df = spark.createDataFrame(rows, "camera_id string, w_index int, frames array<array<int>>")
    got = [r.reason for r in gate.decide(df).orderBy("w_index").collect()]
    assert got == ["warmup", "warmup", "still", "motion", "no_footage", "undecodable", "undecodable", "still"]
    assert one(spark, gate.split_frames(F.col("b"), 2), b=bytearray(b"abcde")) == [b"ab", b"cd"]


def test_queue_replay(spark):
    rows = [("q", "i1", 2, 0, 10 * US), ("q", "i2", 2, US, US), ("q", "c1", 0, 2 * US, 10 * US), ("q", "c2", 0, 3 * US, US)]
    got = [(r.id, r.started // US, r.overdue) for r in scheduling.replay(spark.createDataFrame(rows, "queue string, id string, lane int, arrived bigint, service_us bigint")).orderBy("started").collect()]
    assert got == [("i1", 0, False), ("i2", 10, True), ("c1", 11, False), ("c2", 21, False)]


def test_confidence_and_retention_edges(spark):
    lit = F.lit
    c = lambda *a: one(spark, health.confidence(*[lit(x) for x in a]), k=1)
    assert c(10.0, 0.0, 4, 4, False) == 0.0 and c(10.0, 10.0, 9, 4, False) == 1.0 and c(10.0, 5.0, 4, 4, True) == 0.175 and c(10.0, 10.0, 0, 0, False) == 0.0
    assert one(spark, health.expected_frames(lit(6.25), 0.4), k=1) == 2 and one(spark, health.expected_frames(lit(0.1), 0.4), k=1) == 1
    for bad in (10, float("nan"), float("inf")):
        with pytest.raises(ValueError):
            health.retention_age(bad)
    seg = spark.createDataFrame([("c", "old", 0, 60 * US, 60 * US, 5), ("c", "touched", 60 * US, 120 * US, 99_990 * US, 5), ("c", "newest", 120 * US, 180 * US, 180 * US, 5), ("d", "only", 0, 60 * US, 60 * US, 5)], "camera_id string, path string, start_us bigint, eff_end bigint, mtime_us bigint, size_bytes bigint")
    plan = health.retention_plan(seg, now_us=100_000 * US)
    assert {r.path for r in plan.filter("doomed").collect()} == {"old"}
    assert health.retention_totals(plan).head().asDict() == {"bytes": 5, "files": 1, "kept": 3}


def test_logs_and_overlays(spark):
    e = "entry_id string, ts bigint, action string, t_start bigint, t_end bigint, status string, task_id string, reason string, clip_path string, parent_id string, job_id string"
    rows = [("1", 1, "raise_alert", 0, 9, "unverified", "t", "r", None, None, None), ("2", 2, "raise_alert", 0, 9, "verified", "t", "", "clip", "1", "j"), ("3", 3, "raise_alert", 0, 9, "retracted", "t", None, None, "2", None), ("4", 9, "save_clip", 0, 9, "unverified", None, "", None, "gone", None)]
    df = spark.createDataFrame(rows, e)
    got = {r.root: r for r in logs.fold(df).collect()}
    assert got["1"].status == "retracted" and got["1"].clip_path == "clip" and got["1"].reason == "r" and got["1"].n_amendments == 2 and got["4"].status == "unverified"
    change = spark.createDataFrame([("1", "n1", 5, "verified", ""), ("1", "n2", 5, "unverified", ""), ("9", "n3", 5, "verified", "")], "parent_id string, entry_id string, ts bigint, status string, reason string")
    assert [r.entry_id for r in logs.amend(df, change).collect()] == ["n1"]
    assert {r.why for r in logs.rejected_amendments(df, change).collect()} == {"no amending status", "unknown entry"}
    a, b = (spark.createDataFrame(x, "k string, v int") for x in ([("a", 1)], [("a", 2), ("b", 3)]))
    assert {(r.k, r.v) for r in logs.overlay(a, b, "k").collect()} == {("a", 1), ("b", 3)}
    seed = logs.seed_with(b.toDF("task_id", "v"), a.toDF("task_id", "v"), spark.createDataFrame([("b",)], ["task_id"]))
    assert {(r.task_id, r.v) for r in seed.collect()} == {("a", 1)}


def test_sources(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"kind":"turn","id":"1"}\nnot json\n{"kind":"job","id":"2"}\n')
    p = f"file://{tmp_path}/log.jsonl"
    assert [r.id for r in src.read_jsonl(spark, p, "kind string, id string", kind="job").collect()] == ["2"]
    with pytest.raises(Exception):
        src.read_jsonl(spark, p, "kind string, id string", strict=True).collect()
    arch = tmp_path / "archive"
    arch.mkdir()
    (arch / "cam1_20260105_000000.mp4").write_bytes(b"123")
    (arch / "stray.txt").write_text("x")
    rows = src.list_archive(spark, f"file://{arch}", "{camera_id}_%Y%m%d_%H%M%S.mp4").collect()
    assert [(r.camera_id, r.size_bytes) for r in rows] == [("cam1", 3)]
    assert src.list_inbox(spark, f"file://{arch}").count() == 1
    (tmp_path / "list.csv").write_text("b.mp4,60.0,120\na.mp4,0.0,60\nbroken\n")
    assert [r.file for r in src.read_segment_list(spark, f"file://{tmp_path}/list.csv").collect()] == ["a.mp4", "b.mp4"]
    (tmp_path / "seed.yaml").write_text("tasks:\n - {task_id: a, describe: d, window: 5, action: save_clip}\n")
    assert src.load_tasks(spark, str(tmp_path / "seed.yaml")).head().cooldown == 300
    (tmp_path / "store.json").write_text("{broken")
    assert src.load_tasks(spark, str(tmp_path / "seed.yaml"), str(tmp_path / "store.json")).count() == 0
    with pytest.raises(ValueError):
        src.task_rows([{"task_id": "a"}])
    assert src.lookup({"a": {"b": 1}}, "a.b") == 1 and src.deep_merge({"a": {"x": 1}}, {"a": {"y": 2}}) == {"a": {"x": 1, "y": 2}}
    with pytest.raises(KeyError):
        src.lookup({}, "a.b", required=True)


@pytest.mark.parametrize(
    "name, pushed",
    [
        ("select_before_cutoff", ["LessThanOrEqual(t_end,"]),
        ("overlap_filter", ["GreaterThanOrEqual(t_end,", "IsNotNull(t_start)"]),
        ("browse_gated_only", ["EqualTo(gated,true)"]),
        ("browse_oldest_first", ["EqualTo(tier,live)", "IsNotNull(t_start)"]),
        ("hybrid_search", ["EqualTo(tier,live)", "Not(EqualTo(gated,true))"]),
    ],
)
def test_filters_reach_the_scan_of_the_chunks(spark, name, pushed):
    plan = stream_queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "PushedFilters" in line and "chunk_id" in line)
    filters = scan[scan.index("PushedFilters") :]
    assert all(p in filters for p in pushed), filters


def test_the_funnel_meets_the_tasks_once(spark):
    plan = watch_queries.funnel_counters(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("NestedLoopJoin") == 1
    plan = watch_queries.brakes_full(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan  # the pairs were met before, and what is ok was written


def test_late_rows_go_to_their_own_folder_and_a_retry_changes_nothing(spark, tmp_path):
    sink = live.LateSink(f"file://{tmp_path}", 10)
    rows = lambda ts: spark.createDataFrame([(dt.datetime.fromtimestamp(t, UTC),) for t in ts], "t_start timestamp")
    for batch, ts in enumerate([[100, 120], [111, 109, 200], [150]]):
        for _ in range(2):
            sink(rows(ts), batch)
    read = lambda f: sorted(int(r[0].timestamp()) for r in spark.read.parquet(f"file://{tmp_path}/{f}").select("t_start").collect())
    assert read("main") == [100, 111, 120, 200] and read("late") == [109, 150]


def test_an_outbox_sends_each_key_once(spark, tmp_path):
    send = live.outbox(f"file://{tmp_path}/box")
    rows = lambda ks: spark.createDataFrame([(k,) for k in ks], "idempotency_key string")
    for batch, ks in enumerate([["a", "a", "b"], ["b", "c"]]):
        for _ in range(2):
            send(rows(ks), batch)
    assert sorted(r[0] for r in spark.read.parquet(f"file://{tmp_path}/box").select("idempotency_key").collect()) == ["a", "b", "c"]


def test_plans_push_filters_and_avoid_cartesian(spark):
    plan = stream_queries.cosine_topk(spark, SF)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan
    plan = watch_queries.dedupe_collisions_audit(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_engine(spark):
    from frameloom.api import Engine

    e = Engine(stream_queries.chunks(spark, SF, vectors=True).filter(F.size("embedding") == 64), stream_queries.segments(spark, SF), watch_queries.log(spark, SF), watch_queries.latest_jobs(spark, SF))
    row = e.ask("what licence does the crane track have", tier=None).head()
    assert row.escalate and not row.grounded and row.missing == ["licence"]
    assert e.stats().count() == 1
    root = e.log.filter("parent_id is null").select("entry_id").orderBy("entry_id").first()[0]
    assert [r.root for r in e.resolve(root).collect()] == [root]
    assert e.resolved(0, 2**60).count() > 0
    assert e.dispatch("search_index", query="crane track").count() <= 5
    with pytest.raises(KeyError):
        e.dispatch("launch")
