"""The general training-data operators: edge rows and brute force."""

from __future__ import annotations

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from frameloom.operators.changefeed import apply_feed, standing
from frameloom.operators.coverage import merge_intervals
from frameloom.operators.orphans import count_by_day, find_orphans
from frameloom.operators.sessions import SessionTable
from frameloom.sources.snapshot import SnapshotTable

US = 1_000_000
IV = "src string, camera_id string, start_us bigint, end_us bigint, kind string"


def _brute(rows):
    out = []
    for key in sorted({r[0] for r in rows if r[0] is not None}):
        iv = sorted((a, z) for k, a, z in rows if k == key and a is not None and z is not None and z > a)
        cur = None
        for a, z in iv:
            if cur is None or a > cur[1] + 2 * US:
                if cur:
                    out.append((key, "period", *cur))
                    if a - cur[1] <= 6 * 3600 * US:
                        out.append((key, "gap", cur[1], a))
                cur = [a, z]
            else:
                cur[1] = max(cur[1], z)
        if cur:
            out.append((key, "period", *cur))
    return sorted(out)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(0, 40_000)), st.one_of(st.none(), st.integers(-5, 9_000))), max_size=40))
def test_periods_and_gaps_as_brute_force(spark, raw):
    rows = [(k, None if a is None else a * US, None if a is None or d is None else (a + d) * US) for k, a, d in raw]
    # a column that clashes with a result's name, and repeated rows
    df = spark.createDataFrame([("x", k, a, z, "noise") for k, a, z in rows + rows[:3]], IV)
    got = merge_intervals(df, ["camera_id"], bucket_us=600 * US).collect()
    assert sorted((r.camera_id, r.kind, r.start_us, r.end_us) for r in got) == _brute(rows)


def test_periods_of_an_empty_table_and_the_join_limit(spark):
    assert merge_intervals(spark.createDataFrame([], IV), ["src", "camera_id"]).count() == 0
    rows = [("s", "c", 0, 10 * US, ""), ("s", "c", 12 * US, 13 * US, ""), ("s", "c", 15 * US + 1, 16 * US, ""), ("s", "c", 5, 5, ""), ("s", "c", 9, 3, "")]
    got = sorted((r.kind, r.start_us, r.end_us) for r in merge_intervals(spark.createDataFrame(rows, IV), ["src", "camera_id"]).collect())
    assert got == [("gap", 13 * US, 15 * US + 1), ("period", 0, 13 * US), ("period", 15 * US + 1, 16 * US)]


FEED = "entry_id string, ts bigint, parent_id string, status string, root string"


def _state(rows):
    first = {}
    for e, ts, p, s in rows:
        if e is not None and (e not in first or (ts is not None and (first[e][0] is None or ts < first[e][0]))):
            first[e] = (ts, p, s)

    def root(e):
        seen = set()
        while e in first and e not in seen:
            seen.add(e)
            if first[e][1] is None:
                return e
            e = first[e][1]
        return None

    best = {}
    for e, (ts, _, s) in first.items():
        r = root(e)
        if r is not None:
            k = (-(2**62) if ts is None else ts, e)
            if r not in best or k > best[r][0]:
                best[r] = (k, s)
    return {(r, k[1]) for r, (k, s) in best.items() if s != "retracted"}


def test_feed_with_chains_cycles_repeats_and_ties(spark):
    rng = random.Random(3)
    rows = [("o1", 1, None, "unverified"), ("a1", 2, "o1", "verified"), ("a2", 2, "a1", "retracted"), ("a3", 2, "a2", "verified"), ("o2", None, None, None), ("c1", 1, "c2", "x"), ("c2", 1, "c1", "x"), ("c3", 1, "c1", "x"), ("self", 1, "self", "x"), ("lost", 5, "nowhere", "x"), (None, 1, None, "x"), ("", 1, None, "x"), ("o3", 1, None, "retracted")]
    for i in range(40):  # a long chain
        rows.append((f"d{i}", i, f"d{i - 1}" if i else None, "verified"))
    rows += [("hot", 0, None, "unverified")] + [(f"h{i:04d}", rng.randrange(50), "hot", rng.choice(["verified", "retracted"])) for i in range(500)]
    rows += [(e, None if t is None else t + 7, p, "retracted") for e, t, p, s in rows[:4]]  # sent again later
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "noise") for r in rows], FEED)
    table = apply_feed(df)
    assert {(r[0], r[1]) for r in standing(table).collect()} == _state(rows)
    assert table.read().filter("kind = 1 and root = 'o3'").count() == 1  # the tombstone stays
    assert standing(apply_feed(spark.createDataFrame([], FEED))).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_feed_in_batches_is_the_feed(spark, seed):
    rng = random.Random(seed)
    rows = [("o1", 1, None, "unverified"), ("a1", 2, "o1", "verified"), ("a2", 2, "a1", "retracted"), ("o2", None, None, None), ("c1", 1, "c2", "x"), ("c2", 1, "c1", "x"), ("lost", 5, "nowhere", "x"), ("late", 9, None, "retracted"), ("late", None, None, "verified"), ("n", None, "o2", "verified")]
    rows += [("turn", 9, "o1", "retracted"), ("turn", 3, "o2", "verified"), ("behind", 10, "turn", "retracted"), ("tie", 4, "o1", "verified"), ("tie", 4, "o1", "retracted")]
    rows += [(f"d{i}", i, f"d{i - 1}" if i else None, rng.choice(["verified", "retracted"])) for i in range(15)]
    for i in range(60):
        rows.append((f"h{i:03d}", rng.randrange(50), rng.choice(["d0", "o1", "o2", f"h{max(0, i - 1):03d}"]), rng.choice(["verified", "retracted"])))
    rows += [(e, None if t is None else t + rng.randrange(3), p, s) for e, t, p, s in rng.sample(rows[15:], 20)]  # sent again, some later
    rng.shuffle(rows)
    whole = {(r[0], r[1]) for r in standing(apply_feed(spark.createDataFrame([(*r, "") for r in rows], FEED))).collect()}
    table, parts = None, [rows[:20], rows[20:21], [], rows[21:70], rows[:20], rows[70:]]
    for p in parts:
        table = apply_feed(spark.createDataFrame([(*r, "") for r in p], FEED), table=table, buckets=4)
    assert {(r[0], r[1]) for r in standing(table).collect()} == whole
    version = table.version
    apply_feed(spark.createDataFrame([(*r, "") for r in parts[3]], FEED), table=table)
    assert table.version == version  # a batch that is sent again changes nothing
    assert table.vacuum() > 0 and {(r[0], r[1]) for r in standing(table).collect()} == whole


def test_feed_rewrites_only_touched_buckets_and_grows(spark):
    rows = [(f"e{i:04d}", i, None, "verified", "") for i in range(400)]
    table = apply_feed(spark.createDataFrame(rows, FEED), buckets=16, rows_per_bucket=40)
    before = table.manifest()
    apply_feed(spark.createDataFrame([("x", 50, "e0007", "retracted", "")], FEED), table=table, rows_per_bucket=40)
    assert sum(table.manifest()[k] != before[k] for k in before) == 1
    assert standing(table).count() == 399
    more = [(f"f{i:04d}", i, "e0001", "verified", "") for i in range(3000)]
    apply_feed(spark.createDataFrame(more, FEED), table=table, rows_per_bucket=40)
    assert table.meta()["buckets"] > 16 and standing(table).count() == 399
    assert standing(table).filter("entry_id = 'e0001' and last_entry_id = 'f2999'").count() == 1


def _sessions(events, gap):
    out = []
    for key in {k for k, _, _ in events}:
        ev = sorted({(t, i) for k, t, i in events if k == key})
        cur = [ev[0]]
        for x in ev[1:]:
            if x[0] - cur[-1][0] > gap:
                out.append((key, cur[0][1], cur[-1][1], len(cur)))
                cur = []
            cur.append(x)
        out.append((key, cur[0][1], cur[-1][1], len(cur)))
    return sorted(out)


def test_sessions_of_batches_in_any_order(spark):
    rng = random.Random(1)
    events = [(rng.choice("ab"), rng.randrange(0, 200_000) * US, f"id{i:04d}") for i in range(600)]
    events += [("a", t * US, f"run{t:06d}") for t in range(86_000, 90_000, 50)]  # across a day
    batches = [[], [], []]
    for e in events:
        batches[rng.randrange(3)].append(e)
    batches[2] += rng.sample(batches[0], 30) + [(None, 1, "x"), ("a", None, "y"), ("a", 5, None)]
    table = SessionTable(spark, gap_s=60)
    table.apply(spark.createDataFrame([], "key string, t bigint, id string"))
    for b in batches:
        table.apply(spark.createDataFrame(b, "key string, t bigint, id string").withColumn("first", F.lit("noise")))
    got = sorted((r.key, r.first.id, r.last.id, r.n) for r in table.read().collect())
    assert got == _sessions(events, 60 * US)


def test_a_session_batch_that_fails_may_be_applied_again(spark, monkeypatch):
    table = SessionTable(spark, gap_s=60)
    rows = lambda ts: spark.createDataFrame([("a", t * US, f"id{t}") for t in ts], "key string, t bigint, id string")
    table.apply(rows([0, 30, 200_000]))
    version, put = table.table.version, SnapshotTable._put

    def crash(self, *a):
        raise OSError("lost")

    monkeypatch.setattr(SnapshotTable, "_put", crash)  # all files are written, nothing is published
    with pytest.raises(OSError):
        table.apply(rows([60, 100, 200_030]))
    assert table.table.version == version and table.read().count() == 2
    monkeypatch.setattr(SnapshotTable, "_put", put)
    for _ in range(2):  # the second time changes nothing
        table.apply(rows([60, 100, 200_030]))
        assert sorted((r.first.t // US, r.last.t // US, r.n) for r in table.read().collect()) == [(0, 100, 4), (200_000, 200_030, 2)]
    assert table.table.vacuum() > 0 and table.read().count() == 2


def test_a_session_batch_reads_only_days_in_reach(spark):
    table = SessionTable(spark, gap_s=60)
    rows = lambda ts: spark.createDataFrame([("a", t * US, f"id{t}") for t in ts], "key string, t bigint, id string")
    table.apply(rows([d * 86_400 + 5000 for d in range(6)] + [86_390, 86_410]))
    before = table.table.manifest()
    table.apply(rows([86_430, 5 * 86_400 + 5040]))
    after = table.table.manifest()
    assert {int(k) // 2 for k in before if int(k) % 2 == 0 and before[k] != after[k]} == {0, 1, 5}
    assert sorted((r.first.t // US, r.n) for r in table.read().collect()) == [(5000, 1), (86_390, 3)] + [(d * 86_400 + 5000, 1 + (d == 5)) for d in range(1, 6)]
    for k in range(40):  # the folders of a day are written together now and then
        if k % 20 == 0:
            table.apply(rows([1000 + 100 * j for j in range(k, k + 20)]))
    assert max(len(v) for v in table.table.manifest().values()) <= 17


def test_orphan_states(spark):
    refs = [("s", "job", "r1", "a", 5), ("s", "job", "r2", "b", 5), ("s", "job", "r3", "c", 5), ("s", "job", "r4", "", 5), ("s", "job", "r5", None, 5), ("s", "job", "r6", "d", 5), ("s", "job", "r7", "e", 5), ("s", "job", "r8", "e", 4), ("s", "job", "r9", "late", None), ("s", "job", "r10", "late", 5)]
    refs += [("s", "job", f"hot{i}", "gone", i) for i in range(300)]
    par = [("job", "a", True, False, None, None), ("job", "b", False, True, None, None), ("job", "d", True, True, None, None), ("job", "e", True, False, 5, None), ("job", "late", True, False, None, 9), ("job", "late", True, False, None, 6), ("other", "c", True, False, None, None)]
    r = spark.createDataFrame(refs, "src string, field string, rec_id string, key string, ts bigint")
    p = spark.createDataFrame(par, "field string, key string, present boolean, removed boolean, gone_at bigint, since bigint")
    out = find_orphans(r, p, parents_per_range=2, refs_per_part=50)
    got = {(x.rec_id, x.state) for x in out.collect()}
    want = {("r2", "removed"), ("r3", "missing"), ("r6", "removed"), ("r7", "removed"), ("r10", "late")} | {(f"hot{i}", "missing") for i in range(300)}
    assert got == want
    assert {x.n for x in count_by_day(out).filter("state = 'missing'").collect()} == {301}
    assert find_orphans(r.limit(0), p).count() == 0
    assert find_orphans(r, p.limit(0)).count() == 308


def test_snapshot_versions_are_all_or_nothing(spark, tmp_path):
    from pyspark.sql import types as T

    t = SnapshotTable(spark, f"file://{tmp_path}/t", T.StructType([T.StructField("k", T.StringType()), T.StructField("part", T.LongType())]))
    assert t.read().count() == 0
    t.replace(spark.createDataFrame([("a", 1), ("b", 2)], "k string, part bigint"))
    t.replace(spark.createDataFrame([("c", 2)], "k string, part bigint"), {2})
    assert sorted(r.k for r in t.read().collect()) == ["a", "c"]
    assert [r.k for r in t.read({2}).collect()] == ["c"]
    with pytest.raises(RuntimeError):
        t._put(t.version, {})
