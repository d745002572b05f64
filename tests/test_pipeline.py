"""Ingest, jobs, models, the task store, insertion and retention on files: boundary rows."""

from __future__ import annotations

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frameloom.functions.vector import hash_embed
from frameloom.operators import funnel, ingest, jobs, models, retrieval
from frameloom.sources import archive
from frameloom.sources.logs import LineTail, LogView
from frameloom.sources.registry import TaskStore
from frameloom.sources.snapshot import SnapshotTable
from frameloom.streaming.funnel import Monitor

US = 1_000_000
UTC = dt.timezone.utc
SEG = "camera_id string, path string, start_us bigint, eff_end bigint"


def test_settings_name_every_broken_rule():
    assert ingest.IngestSettings().problems() == []
    bad = ingest.IngestSettings(window_s=4, stride_s=5, threshold=1.5, min_px=2000, prompt=" ", watchlist=True, watchlist_items=0)
    assert len(bad.problems()) == 5
    with pytest.raises(ValueError, match="stride_s must not exceed"):
        bad.checked()


@pytest.mark.parametrize("w, h, want", [(1920, 1080, (910, 512)), (1080, 1920, (512, 910)), (640, 300, (640, 300)), (512, 512, (512, 512)), (300, 301, (300, 300))])
def test_pictures_keep_their_shape_and_are_never_enlarged(spark, w, h, want):
    x = spark.createDataFrame([(w, h)], "w int, h int").select(ingest.scaled_size(F.col("w"), F.col("h"), 512).alias("x")).head()["x"]
    assert (x.width, x.height) == want


def test_windows_resume_after_the_newest_row_and_leave_the_open_file(spark):
    seg = spark.createDataFrame([("a", "1", 0, 60 * US), ("a", "2", 60 * US, 120 * US), ("a", "3", 120 * US, 180 * US), ("b", "x", 0, 60 * US)], SEG)
    rows = spark.createDataFrame([("a", 40 * US, 45 * US), ("a", 44 * US, 49 * US), ("a", 10 * US, 90 * US), ("a", None, 500 * US)], "camera_id string, start_us bigint, end_us bigint")
    points = ingest.resume_points(rows)
    assert [(r.camera_id, r.after_us) for r in points.collect()] == [("a", 49 * US)]
    got = sorted(r.w_start // US for r in ingest.windows_to_do(seg, points, ingest.IngestSettings()).collect())
    assert got == list(range(52, 116, 4))  # none of camera b, whose only file is open
    assert ingest.windows_to_do(seg.limit(0), points, ingest.IngestSettings()).count() == 0


def test_every_window_comes_to_one_end(spark):
    still, move = [[10.0] * 64, [10.0] * 64], [[10.0] * 64, [200.0] * 64]
    frames = {0: still, 1: still, 2: still, 3: move, 4: move, 5: [], 6: move}
    win = spark.createDataFrame([("a", i, i * 4 * US, (i * 4 + 5) * US, f) for i, f in frames.items()], "camera_id string, w_index int, w_start bigint, w_end bigint, frames array<array<double>>")
    seg = spark.createDataFrame([("a", "s1", 0, 22 * US)], SEG)
    cap = spark.createDataFrame([("a", 0, "warm"), ("a", 2, "never asked"), ("a", 3, "A van."), ("a", 4, " "), ("a", 6, "lost")], "camera_id string, w_index int, caption string")
    out = ingest.ingest(win, seg, cap, ingest.IngestSettings(warmup=1))
    got = {r.chunk_id[2:17]: (r.outcome, r.gated, r.caption, r.segment) for r in out.collect()}
    at = lambda s: dt.datetime.fromtimestamp(s, UTC).strftime("%Y%m%dT%H%M%S")
    assert got == {
        at(0): ("captioned", False, "warm", "s1"),
        at(4): ("skipped", True, "", "s1"),
        at(8): ("skipped", True, "", "s1"),
        at(12): ("captioned", False, "A van.", "s1"),
        at(16): ("undecodable", True, "", "s1"),
        at(20): ("undecodable", True, "", "s1"),
        at(24): ("no_footage", True, "", None),
    }
    assert ingest.index_rows(out).count() == 6


def test_imports_end_now_and_never_replace_a_file(spark):
    now = dt.datetime(2026, 1, 5, 12, 0, 0, 900_000, tzinfo=UTC)
    df = spark.createDataFrame([(now, 10.25)], "now timestamp, d double")
    p = df.select(ingest.import_place(F.col("d"), F.col("now")).alias("p")).select(F.unix_micros("p.t_start").alias("a"), F.unix_micros("p.t_end").alias("z")).head()
    base = int(now.replace(microsecond=0).timestamp()) * US
    assert (p.a, p.z) == (base - 10 * US, base + 250_000)
    cuts = spark.createDataFrame([("c", 0, 0.0, 60.04), ("c", 0, 60.04, 90.0), ("c", 0, 90.0, 90.0)], "camera_id string, begin_us bigint, start double, end double")
    name = F.concat("camera_id", F.lit("_"), F.col("start_us"), F.lit(".mp4"))
    got = {r.path: r.refused for r in ingest.slice_plan(cuts, spark.createDataFrame([("c_0.mp4",)], "path string"), name).collect()}
    assert got == {"c_0.mp4": True, "c_60040000.mp4": False}
    f = spark.createDataFrame([(1, "f2"), (0, "f10"), (0, "f9")], "span_index int, name string")
    assert [r.name for r in ingest.frames_in_order(f).collect()] == ["f9", "f10", "f2"]


REQ = "req string, camera_id string, t0 bigint, t1 bigint, question string"


def test_deep_jobs_end_with_a_result_or_a_reason(spark):
    rows = [("ok", "a", 0, 40 * US, "q"), ("half", "a", 30 * US, 90 * US, "q"), ("none", "a", 500 * US, 510 * US, "q"), ("long", "a", 0, 400 * US, "q"), ("back", "a", 9, 3, "q"), ("mute", "a", 0, US, " "), ("lost", "a", 0, US, "q"), ("dark", "a", 0, US, "q"), ("open", "a", None, 3, "q")]
    req = spark.createDataFrame(rows, REQ)
    seg = spark.createDataFrame([("a", "s1", 0, 60 * US)], SEG)
    ans = spark.createDataFrame([("ok", "yes", 40), ("half", "cannot tell", 15), ("none", "x", 3), ("dark", "x", 0)], "req string, answer string, decoded int")
    out = {r.req: r for r in jobs.deep_results(req, seg, ans, hedged=F.col("answer").contains("cannot")).collect()}
    assert len(out) == len(rows)
    assert (out["ok"].state, out["ok"].confidence, out["ok"].note) == ("done", 1.0, None)
    assert (out["half"].state, out["half"].confidence) == ("done", round(0.5 * 0.5 * 0.35, 4)) and out["half"].note == "30.0 of 60.0 seconds are not recorded"
    assert [(g.start_us, g.end_us) for g in out["half"].gaps] == [(60 * US, 90 * US)] and out["half"].segments == ["s1"]
    assert all(out[k].state == "failed" and out[k].error and out[k].confidence is None for k in ("none", "long", "back", "mute", "lost", "dark", "open"))


def test_a_job_settles_once(spark):
    ev = [("a", 0, "queued"), ("a", 5 * US, "done"), ("a", 9 * US, "failed"), ("b", 0, "queued"), ("b", 95 * US, "done"), ("c", 0, "queued"), ("c", US, "running"), ("d", 60 * US, "queued")]
    df = spark.createDataFrame(ev, "job_id string, ts bigint, state string")
    got = {r.job_id: (r.state, r.ts, r.dropped) for r in jobs.settle(df, now_us=100 * US).collect()}
    assert got == {"a": ("done", 5 * US, 1), "b": ("timeout", 90 * US, 1), "c": ("timeout", 90 * US, 0), "d": ("queued", 60 * US, 0)}
    n = jobs.worker_counters(jobs.settle(df, now_us=100 * US)).head()
    assert (n.submitted, n.done, n.timeout, n.failed, n.live) == (4, 1, 2, 0, 1)


def test_turns_with_their_jobs(spark):
    t = [("t1", 1, "first", None), ("t2", 2, "draft", "j1"), ("t2", 3, "second", "j1"), ("t3", 4, "third", "j2"), (None, 9, "x", None), ("t4", 5, None, "j1")]
    turns = spark.createDataFrame(t, "turn_id string, ts bigint, answer string, job_id string")
    j = spark.createDataFrame([("j1", "done", "looked"), ("j2", "running", None)], "job_id string, state string, answer string")
    live = spark.createDataFrame([("j2", "done", "live")], "job_id string, state string, answer string")
    got = [(r.turn_id, r.answer, r.job_state) for r in jobs.chat_history(turns, j, live, most=3).collect()]
    assert got == [("t2", "second\n\nlooked", "done"), ("t3", "third\n\nlive", "done"), ("t4", "looked", "done")]
    assert {r.job_id: r.turn_ids for r in jobs.waiting_turns(jobs.latest_turns(turns)).collect()} == {"j1": ["t2", "t4"], "j2": ["t3"]}
    assert jobs.look_back(86_400 * US) == (84_600 * US, 86_400 * US) and jobs.look_back(86_400 * US, widened=True) == (0, 86_400 * US)
    assert jobs.look_back(9, t_to=5) == (None, 5)
    assert jobs.span_of(spark.createDataFrame([], "t_start bigint, t_end bigint")).head() == (0, None, None)


def test_models_are_found_by_name(spark):
    with pytest.raises(ValueError, match="no kind"):
        models.register("oracle", "x", abs)
    with pytest.raises(ValueError, match="there already"):
        models.register("gate", "motion", abs)
    with pytest.raises(ValueError, match="hashing"):
        models.model("embedder", "nothing")
    assert all(models.names(k) for k in models.KINDS)
    df = spark.createDataFrame([("a van at the dock", "van dock"), (None, "van")], "caption string, want string")
    assert [r[0] for r in df.select(models.model("confirmer", "stub")(F.col("caption"), F.col("want"))).collect()] == [True, False]
    assert len(df.select(models.model("embedder", "hashing")(F.col("want"), 32)).head()[0]) == 32
    assert df.select(models.model("captioner", "stub")(F.col("want"))).head()[0].startswith("scene ")


def test_task_store_refuses_and_keeps(tmp_path):
    s = TaskStore(f"{tmp_path}/tasks.json", actions=("notify",))
    one = {"task_id": "a", "describe": "a van", "window": 5, "action": "notify"}
    assert s.all() == []
    s.register(one)
    for bad in (one, one | {"task_id": "b", "window": -1}, one | {"task_id": "c", "action": "shout"}, one | {"task_id": " "}, {"task_id": "d"}):
        with pytest.raises(ValueError):
            s.register(bad)
    with pytest.raises(ValueError):
        s.update("a", task_id="z")
    with pytest.raises(ValueError):
        s.update("a", window=-3)
    with pytest.raises(KeyError):
        s.remove("none")
    assert s.all() == [one]
    assert s.update("a", describe="a red van") and not s.update("a", window=6)
    s.set_enabled("a", False)
    assert s.enabled() == [] and len(s.all()) == 1
    s.remove("a")
    assert s.all() == []


CHUNK = "chunk_id string, t_start timestamp, t_end timestamp, segment string, gated boolean, caption string, embedding array<double>"


def test_insert_checks_embeds_and_replaces(spark):
    t = lambda s: dt.datetime.fromtimestamp(s, UTC)
    have = spark.createDataFrame([("old", t(0), t(1), "s", False, "was", [1.0] * 8), ("kept", t(0), t(1), "s", True, "", None)], CHUNK)
    rows = [("new", t(0), t(1), "s", False, "A van. WATCHING: red hat: present", []), ("old", t(2), t(3), "s", False, "is", [2.0] * 8), ("old", t(1), t(3), "s", False, "between", [3.0] * 8)]
    rows += [("dark", t(0), t(1), "s", True, "", None), ("bad", t(5), t(1), "s", False, "x", None), ("", t(0), t(1), "s", False, "x", None), (None, t(0), t(1), "s", False, "x", None), ("odd", t(0), t(1), "s", False, "x", [1.0])]
    table, refused = retrieval.insert(have, spark.createDataFrame(rows, CHUNK), lambda c: hash_embed(F.split(F.lower(c), " "), 8), dims=8)
    got = {r.chunk_id: r for r in table.collect()}
    assert set(got) == {"old", "kept", "new", "dark"} and got["old"].caption == "is" and not got["dark"].embedding
    want = spark.range(1).select(hash_embed(F.split(F.lower(F.lit("A van.")), " "), 8)).head()[0]
    assert got["new"].embedding == want  # of the description, without the watch list
    assert {r.chunk_id for r in refused.collect()} == {"bad", "", None, "odd"}


def test_retention_takes_rows_before_files_and_may_be_repeated(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"f{i}").write_bytes(b"x" * (i + 1))
    (tmp_path / "folder").mkdir()
    index = SnapshotTable(spark, f"file://{tmp_path}/index", T.StructType.fromDDL("chunk_id string, part bigint"))
    index.replace(spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "chunk_id string, part bigint"))
    plan = spark.createDataFrame([(f"{tmp_path}/f0", 1, True), (f"file://{tmp_path}/f1", 2, True), (f"{tmp_path}/f2", 3, False), (f"{tmp_path}/gone", 4, True), (f"{tmp_path}/folder", 5, True)], "path string, size_bytes int, doomed boolean")
    ids = spark.createDataFrame([("a",), ("unknown",)], "chunk_id string")
    before = index.manifest()
    n = archive.retention_figures(archive.apply_retention(index, plan, ids)).head()
    assert (n.files_deleted, n.bytes_freed, n.errors) == (2, 3, 1)
    assert sorted(r.chunk_id for r in index.read().collect()) == ["b", "c"] and index.manifest()["2"] == before["2"]
    assert sorted(os.listdir(tmp_path)) == ["f2", "folder", "index"]
    n = archive.retention_figures(archive.apply_retention(index, plan, ids)).head()
    assert (n.files_deleted, n.bytes_freed, n.errors) == (0, 0, 1)


def test_a_tail_leaves_unfinished_lines_and_starts_over_on_a_shorter_file(spark, tmp_path):
    f = tmp_path / "log.jsonl"
    tail = LineTail(spark, f"file://{f}", "k string")
    got = lambda: [r.k for r in tail.poll().collect()]
    assert got() == []
    f.write_text('{"k": "a"}\nbroken\n\n{"k": "b"')
    assert got() == ["a"]
    with f.open("a") as out:
        out.write('}\n{"k": "ü"}\n')
    assert got() == ["b", "ü"] and got() == []
    again = LineTail(spark, f"file://{f}", "k string", offset=tail.offset)
    assert again.poll().count() == 0
    f.write_text('{"k": "new"}\n')
    assert got() == ["new"] and tail.restarts == 1
    small = LineTail(spark, f"file://{f}", "k string", most=5)
    assert small.poll().count() == 0 and small.offset == 0  # no whole line fits


def test_a_torn_log_keeps_the_view(spark, tmp_path):
    f = tmp_path / "chunks.jsonl"
    view = LogView(spark, f"file://{f}", "k string, n int")
    assert not view.refresh() and view.rows.count() == 0
    f.write_text('{"k": "a", "n": 1}\n{"k": "b", "n": 2}\n')
    assert view.refresh() and not view.refresh()
    f.write_text('{"k": "a", "n": 1}\n{"k": "b", "n"')
    assert not view.refresh() and sorted(r.k for r in view.rows.collect()) == ["a", "b"]
    f.write_text('{"k": "c", "n": 3}\n')
    assert view.refresh() and [r.k for r in view.rows.collect()] == ["c"]


def test_rankings_name_candidates_that_are_there(spark):
    c = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "position int, id string")
    rank = lambda rows: retrieval.take_ranked(c, spark.createDataFrame(rows, "index int, score double")).orderBy("rank").collect()
    assert [(r.id, r["rank"]) for r in rank([(2, 0.5), (0, 0.9), (1, 0.5)])] == [("a", 0), ("b", 1), ("c", 2)]
    with pytest.raises(Exception, match="which there is not"):
        rank([(7, 1.0)])
    df = spark.createDataFrame([("x", dt.datetime(2026, 1, 5, tzinfo=UTC), dt.datetime(2026, 1, 5, 0, 0, 5, tzinfo=UTC), None)], CHUNK.replace("segment string, gated boolean, ", "").replace(", embedding array<double>", ""))
    assert df.select(retrieval.context_line()).head()[0] == "[x] 2026-01-05T00:00:00Z .. 2026-01-05T00:00:05Z: "


def test_cards_count_down_and_up(spark):
    df = spark.createDataFrame([(10 * US, 4 * US, 20, 2 * US, 8), (100 * US, None, 20, None, 8), (100 * US, 0, 20, 0, 0)], "now bigint, last bigint, cd int, since bigint, w int")
    got = [(r[0], r[1]) for r in df.select(funnel.cooldown_left(F.col("now"), F.col("last"), F.col("cd")), funnel.sustained_share(F.col("since"), F.col("now"), F.col("w"))).collect()]
    assert got == [(14.0, 1.0), (0.0, 0.0), (0.0, 1.0)]


def test_a_monitor_survives_bad_reads_and_listeners():
    inbox, told, settled = [[1], OSError("torn"), [2, 3]], [], []

    def read():
        x = inbox.pop(0)
        if isinstance(x, Exception):
            raise x
        return x

    def bad(_):
        raise ValueError("deaf")

    m = Monitor(read, lambda rows: [2 * x for x in rows], [bad, told.append], lambda: settled.append(1))
    assert [m.step() for _ in range(3)] == [[2], None, [4, 6]]
    assert told == [[2], [4, 6]] and len(settled) == 3 and [w for w, _ in m.faults] == ["listener", "read", "listener"]
