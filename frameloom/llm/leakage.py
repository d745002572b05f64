"""Evaluation passages that leak into training text, by latent semantic retrieval.

1. Documents are cut into overlapping word windows. Only windows that hold
   enough words of the evaluation items can match one; they are kept as term
   numbers, and the document frequencies of these terms are counted over all
   documents on the way.
2. A distributed randomised SVD of the TF-IDF windows: every task adds up
   A'(A Q) of its windows, sums meet in a tree, and a few such passes give the
   leading right singular vectors. What travels is terms x rank numbers.
3. Windows and item passages are projected and compared by cosine, in blocks;
   pairs above the threshold are candidates. So are, whatever their cosine,
   pairs that share ``run`` consecutive words: other words around them can
   bring the cosine of an exact leak down to any value.
4. Candidates are checked word by word: the longest run of common consecutive
   words, the longest common subsequence, and whether the item's rarest words
   (its answer) are there.

Windows and item passages overlap so far that any ``run`` consecutive words
lie wholly in one of each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.llm.words import words
from frameloom.session import input_cores, materialize

_PASSAGES = "kind int, doc_id bigint, at int, terms binary, n bigint"
LEAKS = "doc_id bigint, item_id bigint, cosine float, run int, lcs int, answer boolean, kind string"


@dataclass(frozen=True)
class LeakOptions:
    """``run``: consecutive words of an exact leak. ``rank``: of the latent space. ``threshold``: least cosine of a candidate. ``lcs``: least share of an item passage in order for a paraphrase."""

    run: int = 12
    rank: int = 128
    passes: int = 3
    threshold: float = 0.45
    lcs: float = 0.8
    item_block: int = 20_000
    seed: int = 7

    @property
    def window(self) -> int:
        return 2 * self.run

    @property
    def item_window(self) -> int:
        return self.run + self.run // 3

    @property
    def item_stride(self) -> int:
        return self.run // 3 + 1

    @property
    def stride(self) -> int:
        """At which every item passage lies wholly in a window of its text."""
        return self.window - self.item_window

    @property
    def least(self) -> int:
        """Item words of the shortest paraphrase."""
        return math.ceil(self.lcs * self.run)


def _windows(n: int, width: int, stride: int, least: int) -> np.ndarray:
    """Starts of the windows of a text of n words; none for a text of fewer than ``least``."""
    return np.arange(0, max(0, n - least + 1), stride)


def _fill(terms: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Windows of term numbers, padded with -1."""
    padded = np.concatenate([terms, np.full(width, -1, terms.dtype)])
    return padded[starts[:, None] + np.arange(width)[None, :]]


class _Items:
    """The item passages of one block and their vocabulary."""

    def __init__(self, rows: list[tuple[int, str]], o: LeakOptions) -> None:
        split = [(i, words(t)) for i, t in rows]
        self.vocab = {w: k for k, w in enumerate(sorted({w for _, ws in split for w in ws}))}
        parts, owner = [], []
        for i, ws in split:
            a = np.array([self.vocab[w] for w in ws], dtype=np.int32)
            s = _windows(len(a), o.item_window, o.item_stride, o.run)
            if len(s):
                parts.append(_fill(a, s, o.item_window))
                owner += [i] * len(s)
        self.passages = np.concatenate(parts) if parts else np.empty((0, o.item_window), np.int32)
        self.owner = np.array(owner, dtype=np.int64)


def _weights(terms: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Weights of the words of windows, such that their sum by term is the unit TF-IDF row of a window; 0 for padding."""
    there = terms >= 0
    w = np.where(there, idf[terms], np.float32(0))
    # A term c times in a window has the weight c x idf, and each of its places the same share of the square.
    times = ((terms[:, :, None] == terms[:, None, :]) & there[:, :, None]).sum(2)
    return w / np.maximum(np.sqrt((times * w * w).sum(1, keepdims=True)), np.float32(1e-9))


def _project(terms: np.ndarray, weights: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Rows of TF-IDF windows times a matrix (terms x columns), by the few terms that each has."""
    return (weights[:, None, :] @ m[np.maximum(terms, 0)])[:, 0]


def _spread(terms: np.ndarray, weights: np.ndarray, y: np.ndarray, total: np.ndarray) -> None:
    """Add the transposed TF-IDF windows times y (windows x columns) to a matrix (terms x columns)."""
    row, _ = np.nonzero(terms >= 0)
    flat, w = terms[terms >= 0], weights[terms >= 0]
    order = np.argsort(flat, kind="stable")
    which, start = np.unique(flat[order], return_index=True)
    if len(which):
        total[which] += np.add.reduceat(w[order, None] * y[row[order]], start, axis=0)


_BITS = np.uint64(1)


def _sketch(terms: np.ndarray, vocab: int) -> np.ndarray:
    """Two words of bits per window, in which each of its terms sets one bit."""
    out = np.zeros((len(terms), 2), np.uint64)
    h = (terms.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(57)
    bit = np.where(terms >= 0, _BITS << (h & np.uint64(63)), np.uint64(0))
    for half in (0, 1):
        out[:, half] = np.bitwise_or.reduce(np.where((h >> np.uint64(6)) == half, bit, np.uint64(0)), axis=1)
    return out


def _unit(a: np.ndarray) -> np.ndarray:
    return a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-9)


def _read(batch: pa.RecordBatch, width: int) -> np.ndarray:
    col = batch.column("terms")
    return np.frombuffer(b"".join(col.to_pylist()), dtype=np.int32).reshape(-1, width)


def _chunks(batches: Iterator[pa.RecordBatch], vocab: int) -> Iterator[pa.RecordBatch]:
    """Slices of batches small enough for a row of ``vocab`` numbers each."""
    rows = max(16, min(1024, 40_000_000 // max(1, vocab)))
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _passages(docs: DataFrame, items: _Items, o: LeakOptions, exact: bool) -> DataFrame:
    """Windows that can hold a leak (kind 0) and partial document frequencies (kind 1)."""
    vocab = docs.sparkSession.sparkContext.broadcast(items.vocab)
    names = [x.split()[0] for x in _PASSAGES.split(", ")]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        cols = zip(*rows)
        b = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64()])], names=names)
        rows.clear()
        return b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocab.value.get
        df = np.zeros(len(vocab.value) + 1, dtype=np.int64)
        rows: list[tuple] = []
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not t:
                    continue
                a = np.array([get(w, -1) for w in words(t)], dtype=np.int32)
                if not len(a):
                    continue
                df[np.unique(a)] += 1  # -1 marks the spare last place
                least = o.run if exact else o.least
                if i is None or len(a) < least:
                    continue
                known = np.concatenate([[0], np.cumsum(a >= 0)])
                starts = _windows(len(a), o.window, o.run if exact else o.stride, least)
                stops = np.minimum(starts + o.window, len(a))
                if exact:  # the window must hold a run of item words
                    full = np.concatenate([[0], np.cumsum(known[o.run :] - known[: -o.run] == o.run)])
                    lasts = np.maximum(stops - o.run + 1, starts)
                    keep = full[lasts] > full[starts]
                else:  # the window must hold that many item words
                    keep = known[stops] - known[starts] >= least
                starts = starts[keep]
                if len(starts):
                    rows += [(0, i, int(s), w.tobytes(), 0) for s, w in zip(starts, _fill(a, starts, o.window))]
                if len(rows) >= 4096:
                    yield out(rows)
        rows += [(1, None, k, None, int(n)) for k, n in enumerate(df[:-1]) if n]
        if rows:
            yield out(rows)

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, _PASSAGES)


def _add_up(parts: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """The sum of the tasks' matrices: in a tree of about root(tasks) branches, then of one row."""
    n = parts.rdd.getNumPartitions()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for x in b.column(0).to_pylist():
                m = np.frombuffer(x, dtype=np.float32)
                total = m.copy() if total is None else total + m
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

    if n > 8:
        parts = parts.repartition(max(1, int(n**0.5))).mapInArrow(add, "m binary")
    rows = parts.repartition(1).mapInArrow(add, "m binary").collect()
    return np.frombuffer(rows[0][0], dtype=np.float32).reshape(shape).astype(np.float64) if rows else np.zeros(shape)


def latent_basis(windows: DataFrame, idf: np.ndarray, extra: np.ndarray, o: LeakOptions) -> np.ndarray:
    """Terms x rank: leading right singular vectors of the TF-IDF windows and the item passages, by randomised subspace iteration."""
    v = len(idf)
    rank = min(o.rank, v)
    q = np.linalg.qr(np.random.default_rng(o.seed).standard_normal((v, min(v, rank + 16))))[0]
    sc = windows.sparkSession.sparkContext
    mine = _weights(extra, idf)
    z = q
    for _ in range(o.passes):
        both = sc.broadcast((idf, q.astype(np.float32)))

        def part(batches: Iterator[pa.RecordBatch], both=both) -> Iterator[pa.RecordBatch]:
            w, m = both.value
            total = np.zeros(m.shape, dtype=np.float32)
            some = False
            for b in _chunks(batches, o.window * m.shape[1]):
                if b.num_rows:
                    terms = _read(b, o.window)
                    weights = _weights(terms, w)
                    _spread(terms, weights, _project(terms, weights, m), total)
                    some = True
            if some:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

        z = _add_up(windows.select("terms").mapInArrow(part, "m binary"), q.shape)
        _spread(extra, mine, _project(extra, mine, q), z)
        held, q = q, np.linalg.qr(z)[0]
    values, turn = np.linalg.eigh(held.T @ z)
    return (held @ turn[:, np.argsort(-values)[:rank]]).astype(np.float32)


def _grams(x: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every ``run`` consecutive terms of rows of terms, and their rows; stretches with a term below 0 are left out."""
    if x.shape[1] < run or not len(x):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    places = x.shape[1] - run + 1
    h, ok = np.zeros((len(x), places), np.uint64), np.ones((len(x), places), bool)
    for k in range(run):
        part = x[:, k : k + places]
        h = (h ^ part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        ok &= part >= 0
    return h[ok], np.nonzero(ok)[0]


def _sharing(x: np.ndarray, known: np.ndarray, owner: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """(row of x, passage) of pairs with an equal gram; ``known`` are the passages' hashes in order, ``owner`` their passages."""
    h, row = _grams(x, run)
    a, z = np.searchsorted(known, h, "left"), np.searchsorted(known, h, "right")
    n = z - a
    at = np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(row, n), owner[at]


def _common_run(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Longest run of common consecutive terms of paired windows."""
    best = np.zeros(len(x), dtype=np.int16)
    row = np.zeros((len(x), y.shape[1] + 1), dtype=np.int16)
    for j in range(x.shape[1]):
        same = (x[:, j, None] == y) & (x[:, j, None] >= 0)
        row[:, 1:] = np.where(same, row[:, :-1] + 1, 0)
        np.maximum(best, row.max(axis=1), out=best)
    return best


def _common_order(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of paired windows."""
    row = np.zeros((len(x), y.shape[1] + 1), dtype=np.int16)
    for j in range(x.shape[1]):
        same = (x[:, j, None] == y) & (x[:, j, None] >= 0)
        new = np.zeros_like(row)
        for k in range(y.shape[1]):
            new[:, k + 1] = np.where(same[:, k], row[:, k] + 1, np.maximum(row[:, k + 1], new[:, k]))
        row = new
    return row[:, -1]


def find_leaks(docs: DataFrame, items: DataFrame, options: LeakOptions | None = None, *, paraphrases: bool = True) -> DataFrame:
    """Rows ``LEAKS``: one for each document and item that leaked into it.

    ``docs``: doc_id, text; ``items``: item_id, item_text. kind ``exact``: at
    least ``run`` consecutive words of the item are consecutive in the
    document. kind ``paraphrase`` (if asked for): an item passage whose words
    come in order, to the share ``lcs``, with its rarest words among them.
    ``cosine``, ``run``, ``lcs`` are the largest of the pair's passages (run
    and lcs are cut off at the passage's length).

    Null, empty and too short texts match nothing; repeated documents and
    items count once by id; rows with a null id take no part; other columns
    are ignored. Without paraphrases only windows with a run of item words are
    kept, which no exact leak can lack. Items are taken in blocks of
    ``item_block`` ids, so what is broadcast is bounded.
    """
    o = options or LeakOptions()
    keyed = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("item_text").cast("string").alias("item_text")).filter("item_id is not null and item_text is not null").distinct()
    n_blocks = max(1, -(-keyed.count() // o.item_block))
    n_docs = max(1, docs.count())
    out = None
    for k in range(n_blocks):
        rows = keyed.filter(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == k).collect()
        part = _block(docs, sorted((r[0], r[1]) for r in rows), n_docs, o, paraphrases)
        if part is not None:
            out = part if out is None else out.unionByName(part)
    if out is None:
        return docs.sparkSession.createDataFrame([], LEAKS)
    exact = F.max(F.col("run")) >= o.run
    return out.groupBy("doc_id", "item_id").agg(F.max("cosine").alias("cosine"), F.max("run").alias("run"), F.max("lcs").alias("lcs"), F.max("answer").alias("answer"), F.when(exact, "exact").otherwise("paraphrase").alias("kind"))


def _block(docs: DataFrame, rows: list[tuple[int, str]], n_docs: int, o: LeakOptions, paraphrases: bool) -> DataFrame | None:
    items = _Items(rows, o)
    if not len(items.owner):
        return None
    sc = docs.sparkSession.sparkContext
    table = materialize(_passages(docs, items, o, not paraphrases), "windows")
    df = np.zeros(len(items.vocab))
    for r in table.filter("kind = 1").groupBy("at").agg(F.sum("n").alias("n")).collect():  # one row a term
        df[r["at"]] = r["n"]
    idf = np.log1p(n_docs / (1 + df)).astype(np.float32)
    windows = table.filter("kind = 0").select("doc_id", "terms")
    if windows.rdd.getNumPartitions() < input_cores(docs.sparkSession):
        # Few small files: spread them over all cores.
        windows = windows.repartition(2 * input_cores(docs.sparkSession))
    basis = latent_basis(windows, idf, items.passages, o)
    latent = _unit(_project(items.passages, _weights(items.passages, idf), basis))
    length = (items.passages >= 0).sum(1)
    # A pair may lack so many of the passage's words: one word in the sketch is one bit at most, so no leak is ruled out.
    spare = length - (np.minimum(o.run, np.ceil(o.lcs * length)) if paraphrases else o.run)
    marks = _sketch(items.passages, len(idf))
    # The answer of a passage: its three rarest words.
    rare = np.sort(np.where(items.passages < 0, np.float32(0), idf[items.passages]), axis=1)[:, -3]
    known, within = _grams(items.passages, o.run)
    order = np.argsort(known, kind="stable")
    both = sc.broadcast((items.passages, items.owner, idf, basis, latent, rare, known[order], within[order], spare, marks))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passages, owner, idf, basis, latent, rare, known, within, spare, marks = both.value
        for b in _chunks(batches, max(len(passages), o.window * basis.shape[1])):
            if not b.num_rows:
                continue
            x = _read(b, o.window)
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            like = _unit(_project(x, _weights(x, idf), basis)) @ latent.T
            near = like >= o.threshold
            near[_sharing(x, known, within, o.run)] = True
            at, to = np.nonzero(near)
            own = _sketch(x, len(idf))
            lacks = np.bitwise_count(marks[to] & ~own[at]).sum(1)
            at, to = at[lacks <= spare[to]], to[lacks <= spare[to]]
            for a in range(0, len(at), 20_000):
                i, j = at[a : a + 20_000], to[a : a + 20_000]
                w, y = x[i], passages[j]
                run = _common_run(w, y)
                hit = run >= o.run
                lcs = np.zeros(len(i), dtype=np.int16)
                answer = np.zeros(len(i), dtype=bool)
                look = np.flatnonzero(hit if not paraphrases else (hit | (((w[:, :, None] == y[:, None, :]) & (w[:, :, None] >= 0)).any(1).sum(1) >= o.lcs * (y >= 0).sum(1))))
                if not len(look):
                    continue
                lcs[look] = _common_order(w[look], y[look])
                there = (w[look, :, None] == y[look, None, :]).any(1)
                wt = np.where(y[look] < 0, np.float32(0), idf[y[look]])
                answer[look] = (there | (wt < rare[j[look], None])).all(1)
                keep = np.flatnonzero(hit | (paraphrases & answer & (lcs >= o.lcs * (y >= 0).sum(1))))
                if len(keep):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[i[keep]], pa.int64()), pa.array(owner[j[keep]], pa.int64()), pa.array(like[i[keep], j[keep]], pa.float32()), pa.array(run[keep].astype(np.int32)), pa.array(lcs[keep].astype(np.int32)), pa.array(answer[keep]), pa.array([""] * len(keep))],
                        names=[c.split()[0] for c in LEAKS.split(", ")],
                    )

    return windows.mapInArrow(search, LEAKS)
