"""The operators for language-model data: brute force, round trips and edge rows."""

from __future__ import annotations

import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.compare import compare, duck

from frameloom.llm import queries, splitting
from frameloom.llm.bpe import DEFAULT_TOKENIZER, automaton, decode_corpus, encode_corpus
from frameloom.llm.graph_search import greedy_search
from frameloom.llm.leakage import LeakOptions, find_leaks
from frameloom.llm.neardup import _Cells, linked_records, similar_texts, words_of_a_pivot
from frameloom.llm.nndescent import GraphOptions, NeighbourGraph, _id_of, _Pivots, close_pairs
from frameloom.llm.runs import event_runs
from frameloom.llm.splitting import Splitter, split_corpus
from frameloom.llm.words import words

US = 1_000_000
SF = "/root/testdata/sf0.001"
needs_vocab = pytest.mark.skipif(not os.path.exists(DEFAULT_TOKENIZER), reason="no vocabulary file")


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    ok, what = compare(spark, duck(SF), name, queries.QUERIES[name], queries.ORACLE[name], SF)
    assert ok, what


@pytest.fixture(scope="module")
def tok():
    return automaton(open(DEFAULT_TOKENIZER, encoding="utf-8").read())


ODD = [None, "", " ", "\n\n\n", "\xa0", "a" * 5000, "漢字" * 700, "🎥" * 600, "<|endoftext|> it's 'tis  \r\n\t don't", "x̧ ß İ \x07\x1c", "naïve — “quotes” 12,345.67"]


@needs_vocab
def test_encoding_equals_the_library_and_decodes(spark, tok):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(DEFAULT_TOKENIZER)
    lib.encode_special_tokens = True
    texts = ODD + [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    df = spark.createDataFrame(list(enumerate(texts)) + [(0, "again")], "doc_id bigint, text string").withColumn("ids", F.lit("noise"))
    enc = encode_corpus(df)
    got = {(r.doc_id, tuple(r.ids)) for r in enc.collect()}
    want = {(i, tuple(lib.encode(t, add_special_tokens=False).ids) if t else ()) for i, t in [*enumerate(texts), (0, "again")]}
    assert got == want
    back = {(r.doc_id, r.text) for r in decode_corpus(enc).collect()}
    assert back == {(i, t or "") for i, t in [*enumerate(texts), (0, "again")]}
    assert encode_corpus(df.limit(0)).count() == 0


@needs_vocab
def test_arcs_are_bpe_itself(tok):
    """A pair of tokens is an arc exactly if merging its bytes by rank gives the pair back."""
    ranks = {k: v for k, v in tok.removed.items()}
    made = {k: i for i, k in ((i, (tok.left[i], tok.right[i])) for i in tok.labels if tok.left[i] >= 0)}
    base = {tok.labels[i]: i for i in tok.labels if tok.left[i] < 0}

    def merge(word: bytes) -> list[int]:
        s = [base[bytes([b])] for b in word]
        while True:
            best = min(((ranks[p], i) for i, p in enumerate(zip(s, s[1:])) if p in ranks), default=None)
            if best is None:
                return s
            pair = (s[best[1]], s[best[1] + 1])
            out, i = [], 0
            while i < len(s):
                if i + 1 < len(s) and (s[i], s[i + 1]) == pair:
                    out.append(made[pair])
                    i += 2
                else:
                    out.append(s[i])
                    i += 1
            s = out

    rng, ids = random.Random(2), sorted(tok.labels)
    for _ in range(3000):
        a, b = rng.choice(ids[:3000]), rng.choice(ids[:3000])
        assert tok.arc(a, b) == (merge(tok.labels[a] + tok.labels[b]) == [a, b])


@needs_vocab
def test_pieces_keep_limit_order_overlap_and_whole_text(spark, tok):
    texts = ODD + [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()] + ["word " * 3000, "A b c. " * 900, "x\n\n" * 2000, ("a" * 300 + " ") * 60, " \n" * 1500 + "end"]
    s = Splitter(tok)
    for t in texts:
        pieces = s.split(t)
        assert [p[0] for p in pieces] == list(range(len(pieces))) and {p[1] for p in pieces} == {len(pieces)}
        if not t:
            assert pieces == [(0, 1, 0, 0, 0, 0, "end", t)]
            continue
        assert pieces[0][2] == 0 and pieces[-1][3] == len(t)
        for p in pieces:
            assert len(tok.encode(p[7])) == p[4] <= 512 and t[p[2] : p[3]] == p[7]
        for a, b in zip(pieces, pieces[1:]):
            assert a[2] < b[2] <= a[3] < b[3] and 32 <= b[5] <= 96
        if len(tok.encode(t)) <= 512:
            assert len(pieces) == 1
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("piece", F.lit("noise"))
    assert split_corpus(df).filter("piece = 0").count() == len(texts)
    assert split_corpus(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        Splitter(tok, 100, 60)


@needs_vocab
def test_chunks_met_before_are_not_pre_split_again(tok, monkeypatch):
    s = Splitter(tok)
    s.split("The van it's parked,\n\nthen the  van leaves. " * 3)
    split, asked = tok.split, []
    monkeypatch.setattr(tok, "split", lambda t: asked.append(t) or split(t))
    text = "The van leaves. The parked,  van it's\n\nthen the" + " parked, the leaves." * 300
    pieces = s.split(text)
    assert asked == [] and len(pieces) > 1 and sum(p[4] - p[5] for p in pieces) == len(tok.encode(text))
    s.split("The bus leaves.")
    assert asked == [" bus"]


@needs_vocab
def test_words_of_chunks_are_those_of_the_text(tok):
    every = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    space = re.compile(f"[{splitting._SPACE}]").match
    assert [c for c in every if space(c)] == [c for c in every if tok._split(f"a{c}{c}b") == ["a", c, f"{c}b" if c == " " else c, "b"][: 3 if c == " " else 4]]
    rng = random.Random(7)
    marks = [*"ab's 19é漢_.,\n\t\r\x1c\x1f\x85\xa0\u2028\u3000\u200b’-🎥²", "'ll", "  ", " \n", "\n "]
    for _ in range(3000):
        t = "".join(rng.choice(marks) for _ in range(rng.randrange(1, 40)))
        assert [w for c in splitting._split_chunks(t) for w in tok.split(c)] == tok.split(t)


@needs_vocab
def test_blocks_of_cuts_give_the_pieces_of_single_cuts(tok, monkeypatch):
    rng = random.Random(9)
    texts = ["".join(rng.choice(["van", " the", " 17", ". ", ", ", "\n", "\n\n", " \n", "漢"]) for _ in range(rng.choice([300, 1200, 4000]))) for _ in range(25)]
    for limits in [(512, 64), (128, 10), (256, 0), (400, 199)]:
        got = []
        for block in (1, 5, 64):
            monkeypatch.setattr(splitting, "_BLOCK", block)
            s = Splitter(tok, *limits)
            got.append([s.split(t) for t in texts])
        assert got[0] == got[1] == got[2] and max(map(len, got[0])) > 5


def _alike(a, b):
    x, y = set(words(a)), set(words(b))
    return bool(x and y) and 10 * len(x & y) >= 7 * len(x | y)


@pytest.mark.parametrize("cell_rows, depth", [(16_384, 3), (4, 3), (2, 2), (3, 1)])
def test_similar_texts_as_brute_force(spark, cell_rows, depth):
    rng = random.Random(cell_rows)
    vocab = [f"w{i}" for i in range(30)] + ["the"] * 20
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 4, 5, 8, 12]))) for _ in range(150)]
    texts += [re.sub(r"w\d+", lambda m: m[0] if rng.random() < 0.9 else "zz", t) for t in texts[:60]]
    texts += ["the the", "THE", "the", "!!", "", None, texts[0].upper(), "İstanbul İz", "istanbul iz"]
    df = spark.createDataFrame([(f"id{i:03d}", t, 1) for i, t in enumerate(texts + texts[:20])], "rec string, text string, a int")
    got = {(r.id_a, r.id_b) for r in linked_records(df, "rec", "text", cell_rows=cell_rows, depth=depth).collect()}
    rows = [(r.rec, r.text) for r in df.collect()]
    want = {(i, j) for i, t in rows for j, u in rows if i < j and t and u and t != u and _alike(t, u)}
    assert got == want
    assert all(r[1].count() == 0 for r in [similar_texts(df.limit(0), "text")])


@pytest.mark.parametrize("at_once, depth", [(0, 2), (0, 3), (40, 4)])
def test_similar_texts_by_pivots_of_several_words(spark, at_once, depth):
    rng = random.Random(depth)
    vocab = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.sample(vocab, rng.choice([1, 2, 3, 5, 8, 11, 15, 16, 22, 34]))) for _ in range(120)]
    texts += [re.sub(r"w\d+", lambda m: rng.choice([m[0]] * 9 + ["", "zz", rng.choice(vocab)]), t) for t in texts for _ in range(2)]
    texts += [t.rsplit(" ", t.count(" ") // 4)[0] for t in texts[:120]]
    # One cell of more texts than are compared at once.
    texts += [" ".join([*vocab[:12], f"x{i}"]) for i in range(120)]
    df = spark.createDataFrame([(f"id{i:03d}", t) for i, t in enumerate(texts)], "rec string, text string")
    got = {(r.id_a, r.id_b) for r in linked_records(df, "rec", "text", at_once=at_once, depth=depth).collect()}
    rows = [(r.rec, r.text) for r in df.collect()]
    assert got == {(i, j) for i, t in rows for j, u in rows if i < j and t != u and _alike(t, u)} and len(got) > 7000


def test_texts_met_in_cells_do_not_grow_with_the_table():
    rng = random.Random(4)
    vocab, times = [f"w{i}" for i in range(1200)], 2000
    texts = [rng.sample(vocab, 34) for _ in range(4000)]
    n = len(texts) * times
    freq = {w: c * times for w, c in Counter(w for t in texts for w in t).items()}
    cells = _Cells(freq, n, 7, 10, 262_144, words_of_a_pivot(freq, n, 7, 10, 16_384, 3), 16_384)
    held = Counter(c for i, t in enumerate(texts) for c in cells.of(" ".join(t), i)[3])
    assert sum(held.values()) <= 25 * len(texts)
    # With cells of one word: about 11 x 0.028 x 8 million.
    assert sum(c * (c - 1) for c in held.values()) / len(texts) * times < 300_000


def _runs(rows, gap=600 * US):
    out = []
    for key in {r[0] for r in rows if r[0] is not None}:
        ev = sorted({(r[1], r[2], r[3], None if r[3] else r[4]) for r in rows if r[0] == key and None not in (r[1], r[2], r[3])}, key=lambda r: r[:2])
        cur = ev[:1]
        for p, e in zip(ev, ev[1:]):
            if e[0] - p[0] <= gap and p[2] == e[2] and (e[2] or _alike(p[3], e[3])):
                cur.append(e)
                continue
            out.append((key, cur[0][1], cur[-1][1], len(cur)))
            cur = [e]
        if cur:
            out.append((key, cur[0][1], cur[-1][1], len(cur)))
    return sorted(r for r in out if r[3] > 1)


EVENTS = "key string, t bigint, id string, gated boolean, caption string, t_end bigint, b string"


@pytest.mark.parametrize("bucket_s, batch", [(3600, 10_000), (60, 10_000), (900, 3)])
def test_runs_as_brute_force(spark, bucket_s, batch):
    rng = random.Random(batch)
    caps = ["a b c d e f g", "a b c d e f h", "a b c d e x y", None, "", "!!", "a b c d e f g"]
    rows, t = [], 0
    for i in range(400):
        t += rng.choice([0, 5, 5, 5, 30, 599, 600, 601, 4000]) * US
        rows.append((rng.choice(["k", "k", "m", None]), t if rng.random() > 0.02 else None, f"i{rng.randrange(10**6):06d}", rng.choice([True, False, False, None]), rng.choice(caps), t + 5 * US, "noise"))
    rows += rng.sample(rows, 30)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = sorted((r.key, r.first_id, r.last_id, r.n) for r in event_runs(spark.createDataFrame(rows, EVENTS), bucket_s=bucket_s).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == _runs([r[:5] for r in rows])
    assert event_runs(spark.createDataFrame([], EVENTS)).count() == 0


def test_leaks_as_brute_force_and_paraphrases(spark):
    rng = random.Random(9)
    vocab = [f"v{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([12, 13, 30, 60])))) for i in range(30)] + [(90, None), (91, ""), (92, "too short"), (None, "v1 " * 20)]
    docs = []
    for d in range(120):
        w = [rng.choice(vocab + ["other"] * 200) for _ in range(rng.choice([0, 5, 40, 200]))]
        if d % 3 == 0:
            src = items[rng.randrange(30)][1].split()
            n = rng.choice([11, 12, 12, 20])
            a, at = rng.randrange(max(1, len(src) - n + 1)), rng.randrange(len(w) + 1)
            w[at:at] = [x.upper() for x in src[a : a + n]]
        docs.append((d, ", ".join(w), "noise"))
    docs += [(500, None, ""), (501, "", ""), (None, items[0][1], ""), (502, items[1][1], ""), (502, items[1][1], "")]
    para = items[5][1].split()
    if len(para) >= 16:
        para[8] = "changed"
    ddf, idf = spark.createDataFrame(docs, "doc_id bigint, text string, item_id string"), spark.createDataFrame(items, "item_id bigint, item_text string")

    def grams(t):
        w = words(t)
        return {tuple(w[k : k + 12]) for k in range(len(w) - 11)}

    want = {(d, i) for d, t, _ in docs if d is not None for i, u in items if i is not None and grams(t) & grams(u)}
    for paraphrases in (False, True):
        r = find_leaks(ddf, idf, LeakOptions(rank=64), paraphrases=paraphrases).collect()
        assert {(x.doc_id, x.item_id) for x in r if x.kind == "exact"} == want
    two = find_leaks(ddf, idf, LeakOptions(item_block=10), paraphrases=False)
    assert {(x.doc_id, x.item_id) for x in two.collect()} == want
    assert find_leaks(ddf.limit(0), idf).count() == 0 and find_leaks(ddf, idf.limit(0)).count() == 0


def test_leaks_between_words_of_other_items(spark):
    rng = random.Random(4)
    vocab = [f"v{i}" for i in range(3000)]
    # Every item repeats a few words of its own; 12 once-only words of it leak between repeated words of others.
    items = []
    for i in range(120):
        own = rng.sample(vocab, 3)
        items.append((i, [rng.choice(vocab) for _ in range(24)] + own * 12))
    docs, want = [], set()
    for d in range(400):
        i, j, k = rng.sample(range(120), 3)
        at = rng.randrange(13)
        w = items[j][1][24:36] + items[i][1][at : at + 12] + items[k][1][30:42]
        docs.append((d, " ".join(["pad"] * rng.randrange(12) + w)))
    ddf = spark.createDataFrame(docs, "doc_id bigint, text string")
    idf = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id bigint, item_text string")
    grams = [{tuple(w[k : k + 12]) for k in range(len(w) - 11)} for _, w in items]
    for d, t in docs:
        w = t.split()
        g = {tuple(w[k : k + 12]) for k in range(len(w) - 11)}
        want |= {(d, i) for i in range(120) if g & grams[i]}
    assert len(want) >= 1200
    for paraphrases in (False, True):
        got = {(r.doc_id, r.item_id) for r in find_leaks(ddf, idf, paraphrases=paraphrases).collect() if r.kind == "exact"}
        assert got == want


def test_paraphrases_of_short_items_and_at_every_offset(spark):
    common = [f"c{k}" for k in range(13)]
    short = common[:9] + ["r1", "r2", "r3"]
    whole = common + ["s1", "s2", "s3"]
    items = spark.createDataFrame([(1, " ".join(short)), (2, " ".join(whole))], "item_id bigint, item_text string")
    swap = lambda w, at: [("other" if k in at else x) for k, x in enumerate(w)]
    docs = [(100 + k, " ".join(common)) for k in range(20)]
    docs += [(0, " ".join(swap(short, [3, 6]))), (1, " ".join(["pad"] * 40 + swap(short, [3, 6]) + ["pad"] * 40)), (2, " ".join(swap(short, [3, 4, 6]))), (3, " ".join(short[:3] + short[4:6] + short[7:]))]
    docs += [(10 + k, " ".join(["pad"] * k + swap(whole, [6, 7, 8]) + ["pad"] * 40)) for k in range(12)]
    got = {(r.doc_id, r.item_id) for r in find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), items).collect() if r.kind == "paraphrase"}
    assert {(0, 1), (1, 1), (3, 1)} <= got and (2, 1) not in got
    assert {(10 + k, 2) for k in range(12)} <= got


def test_planted_paraphrases_are_found_and_little_else(spark):
    rng = random.Random(12)
    vocab = [f"w{i}" for i in range(4000)]
    often = vocab[:60]
    draw = lambda n: [rng.choice(often) if rng.random() < 0.5 else rng.choice(vocab) for _ in range(n)]
    items = [(i, draw(rng.randrange(30, 60))) for i in range(80)]
    docs, planted = [], set()
    for d in range(600):
        w = draw(rng.randrange(40, 160))
        if d % 2 == 0:  # 24 words of an item, two or three of its frequent ones reworded
            i, u = items[rng.randrange(80)]
            at = rng.randrange(len(u) - 24 + 1)
            part = list(u[at : at + 24])
            for k in rng.sample([k for k, x in enumerate(part) if x in often], 3)[: rng.choice([2, 3])]:
                part[k] = f"reworded{k}"
            place = rng.randrange(len(w))
            w[place:place] = part
            planted.add((d, i))
        docs.append((d, " ".join(w)))
    out = find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(i, " ".join(u)) for i, u in items], "item_id bigint, item_text string")).collect()
    found = {(r.doc_id, r.item_id) for r in out}
    recall, precision = len(found & planted) / len(planted), len(found & planted) / len(found)
    print(f"planted paraphrases: recall {recall:.3f}, precision {precision:.3f}")
    assert recall >= 0.95 and precision >= 0.95


def test_neighbours_recall_and_edges(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((900, 16))
    x = np.concatenate([base, base[:200] + rng.standard_normal((200, 16)) * 0.05])
    rows = [(f"r{i:04d}", v.tolist(), 1) for i, v in enumerate(x)]
    rows += rows[:5] + [("n1", None, 1), ("n2", [], 1), ("n3", [0.0] * 16, 1), ("n4", [1.0] * 15, 1), ("n5", [float("nan")] * 16, 1), ("n6", [None] + [1.0] * 15, 1), (None, [1.0] * 16, 1)]
    rows += [(f"same{i:03d}", [1e-200] * 16, 1) for i in range(40)] + [("huge", [1e200] * 16, 1)]
    df = spark.createDataFrame(rows, "rec string, v array<double>, id int")
    g = NeighbourGraph(df, GraphOptions(dims=16, pivot_rows=50, cell_rows=300))
    ids = [r[0] for r in rows[:1100]] + [r[0] for r in rows[-41:]]
    m = np.concatenate([x, np.ones((41, 16))])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    s = m @ m.T
    np.fill_diagonal(s, -2)
    want, hit, total = set(), 0, 0
    found = {}
    for r in g.neighbours().collect():
        found.setdefault(r.a, {})[r.b] = r.cosine
    assert set(found) == set(ids)
    for i in range(1100):
        top = sorted(range(len(ids)), key=lambda j: -s[i, j])[:5]
        hit += sum(ids[j] in found[ids[i]] for j in top)
        total += 5
        want |= {tuple(sorted((ids[i], ids[j]))) for j in top if s[i, j] >= 0.9}
    assert hit / total > 0.9
    got = {(r.a, r.b) for r in close_pairs(g).collect()}
    plain = {p for p in got if p[0][0] == "r" and p[1][0] == "r"}
    assert len(plain & want) >= 0.98 * len(want) and plain <= want
    assert NeighbourGraph(df.limit(0), GraphOptions(dims=16)).neighbours().count() == 0


def test_descent_goes_on_until_the_lists_stay(spark):
    x = np.random.default_rng(5).standard_normal((6000, 64))
    # Small cells, so that the first graph lacks much.
    o = GraphOptions(pivot_rows=100, cells=3, keep=30, forward=30, reverse=30)
    g = NeighbourGraph(spark.createDataFrame([(f"r{i:04d}", v.tolist()) for i, v in enumerate(x)], "rec string, v array<double>"), o)
    assert len(g.changed) > 1 and g.changed[-1] < g.options.least_change and g.changed == sorted(g.changed, reverse=True)
    lists = [np.frombuffer(bytes(r[0]), np.int64) for r in g.lists.select("list").collect()]
    assert all(len(set(_id_of(t[t > 0]))) == (t > 0).sum() for t in lists)
    m = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = m @ m.T
    np.fill_diagonal(s, -2)
    got = {(r.a, r.b) for r in g.neighbours().collect()}
    want = {(f"r{i:04d}", f"r{j:04d}") for i in range(len(x)) for j in np.argpartition(-s[i], 5)[:5]}
    assert len(got & want) >= 0.9 * len(want)


@pytest.mark.parametrize("n", [3, 1000, 5000])
def test_nearest_pivots_of_one_group_are_the_nearest(n):
    rng = np.random.default_rng(n)
    pivots = rng.integers(-127, 128, (n, 64)).astype(np.int8)
    x = rng.standard_normal((300, 64)).astype(np.float32)
    p = _Pivots(None, [pivots], 8)
    want = np.argsort(-(x @ p.groups[0].T), axis=1)[:, :3]
    assert (p.nearest(x, 3) == want).all()


def _recall(g: NeighbourGraph, x: np.ndarray) -> float:
    m = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = m @ m.T
    np.fill_diagonal(s, -2)
    got = {(r.a, r.b) for r in g.neighbours().collect()}
    want = {(f"r{i:04d}", f"r{j:04d}") for i in range(len(x)) for j in np.argpartition(-s[i], 5)[:5]}
    return len(got & want) / len(want)


@pytest.mark.parametrize("options", [{"branch": 8}, {"cell_rows": 300, "cells": 3}, {"branch": 4, "cell_rows": 200}])
def test_two_levels_of_pivots_and_cut_cells_lose_little(spark, options):
    x = np.random.default_rng(8).standard_normal((3000, 16))
    df = spark.createDataFrame([(f"r{i:04d}", v.tolist()) for i, v in enumerate(x)], "rec string, v array<double>")
    g = NeighbourGraph(df, GraphOptions(dims=16, pivot_rows=100, **options))
    assert _recall(g, x) >= 0.9


def test_cell_of_equal_vectors_ends_and_gives_copies(spark):
    x = np.concatenate([np.tile(np.arange(1, 17.0), (700, 1)), np.random.default_rng(8).standard_normal((300, 16))])
    df = spark.createDataFrame([(f"r{i:04d}", v.tolist()) for i, v in enumerate(x)], "rec string, v array<double>")
    rows = NeighbourGraph(df, GraphOptions(dims=16, pivot_rows=100, cell_rows=150)).neighbours().filter("a < 'r0700'").collect()
    assert len(rows) == 3500 and all(r.b < "r0700" and r.cosine > 0.999999 for r in rows)


def test_greedy_search_recall(spark):
    x = np.random.default_rng(3).standard_normal((1500, 16))
    df = spark.createDataFrame([(f"r{i:04d}", v.tolist()) for i, v in enumerate(x)], "rec string, v array<double>")
    out = greedy_search(NeighbourGraph(df, GraphOptions(dims=16, pivot_rows=100)), df.filter("rec like '%00'")).collect()
    m = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = m @ m.T
    np.fill_diagonal(s, -2)
    got = {(r.a, r.b) for r in out}
    want = {(f"r{i:04d}", f"r{j:04d}") for i in range(0, 1500, 100) for j in np.argsort(-s[i])[:5]}
    assert len(got & want) >= 0.9 * len(want)
    assert greedy_search(NeighbourGraph(df.limit(0), GraphOptions(dims=16)), df.limit(1)).count() == 0


def test_search_queries_depend_on_the_record_only(spark):
    c = spark.read.parquet(f"{SF}/chunks.parquet")
    full = c.filter("chunk_id is not null and size(embedding) = 64 and exists(embedding, x -> x <> 0)")
    want = {r[0] for r in full.filter("pmod(xxhash64(chunk_id), 100) = 0").select("chunk_id").collect()}
    assert want and {r.chunk_id for r in queries.p6_search(spark, SF).collect()} == want


@pytest.mark.parametrize("name", ["p6_neighbours", "p6_search"])
def test_recall_of_the_queries_against_brute_force(spark, name):
    sf = SF.replace("0.001", "0.01")
    c = spark.read.parquet(f"{sf}/chunks.parquet").filter("size(embedding) = 64").select("chunk_id", "embedding").dropDuplicates(["chunk_id"]).toPandas()
    x = np.stack(c.embedding.to_list())
    ids, x = c.chunk_id[(x != 0).any(1)].to_list(), x[(x != 0).any(1)]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    at = {k: i for i, k in enumerate(ids)}
    fifth = np.partition(s, -5, axis=1)[:, -5]
    rows = queries.QUERIES[name](spark, sf).collect()
    hit = sum(s[at[r.chunk_id], at[r.neighbour_id]] >= fifth[at[r.chunk_id]] - 1e-9 for r in rows)
    asked = {r.chunk_id for r in rows}
    assert name == "p6_search" or asked == set(ids)
    assert hit >= 0.9 * 5 * len(asked) and asked


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_query_without_sql_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() >= 0
