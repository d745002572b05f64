"""All pairs of texts whose word sets have a Jaccard likeness of at least a threshold.

A metric-space join under the Jaccard distance. The pivots are small sets of
words: a text's distance from a pivot {w} is 1 - 1/n if it holds w and 1
otherwise, so all its words tie as nearest pivot; the tie goes to the rarest,
and that is its Voronoi cell. A text within the threshold of another may lie in
another cell, so it is replicated into the cells of its window, which is cut
so that no pair is lost:

Two texts of n and m words are alike only if they share at least
o = ceil(t (n + m) / (1 + t)) words, so at most n - o words of the one are not
in the other. Words stand in order of rarity. A rare word is a pivot by itself;
the frequent ones are dealt to a few groups, and a pivot is ``level`` words of
one group. Of x words of a group, x - level + 1 must go before no pivot of it
is left, so every word beyond the first level - 1 of its group counts as one
unit. Both texts make the pivots within their first n - o + 1 (m - o + 1)
units; let the prefix of one end first: at most n - o of its words are missing
in the other, so in some group level words are common, and as they come before
the end of both prefixes, the two meet in their cell. How deep a prefix goes
depends on the partner's size, so each copy carries the largest partner it is
needed for. The level grows with the number of texts: with the vocabulary
fixed, a cell of one word grows in proportion, and the comparisons as the square.

The groups can take up to groups x (level - 1) words without a unit. Texts
of few words therefore have classes of their own, by the size of the smaller of
a pair, with as many groups as leave units enough; a text that may be the
larger of a pair of a lower class goes to that class as well.

Pivots that are whole texts were measured first and do not work here: nearly
all distances lie between 0.75 and 0.95, so a window of twice the threshold
distance (0.6) replicates every text into every region.

Inside a cell, pairs are pruned by a bound that has no false negatives: the
parity sketches of two sets differ in at most as many bits as the sets differ
in words. Pairs that remain are compared exactly.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.llm.words import words
from frameloom.session import discard, materialize

_TILE = 96
#: Cells of at most so many texts are compared together, larger ones by tiles.
_FEW = 48
#: Rows of cells that are held before they are compared.
_HELD = 200_000
#: Words in at least this share of the texts are counted one by one.
SHARE = 1e-3
#: Sizes of the smaller text of a pair at which the next class begins.
CLASSES = (1, 2, 3, 5, 8, 11, 16)
#: Groups of frequent words, if the class has room for them.
GROUPS = 8
_M = 2**64 - 1


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial document frequencies of a task's texts, emptied from time to time."""
    counts: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        b = pa.RecordBatch.from_arrays([pa.array(list(counts.keys()), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
        counts.clear()
        return b

    for batch in batches:
        for t in batch.column(0).to_pylist():
            counts.update(set(words(t)))
        if len(counts) > 500_000:
            yield out()
    yield out()


def frequent_words(texts: DataFrame, n_texts: int, share: float = SHARE) -> dict[str, int]:
    """Document frequencies, counted over all texts, of the words in at least ``share`` of them.

    There are at most (mean words of a text) / share such words, whatever the
    size of the collection, so they may go to the driver and to all tasks.
    """
    rows = texts.mapInArrow(_count_words, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= share * n_texts)
    return {r["word"]: r["n"] for r in rows.collect()}


def words_of_a_pivot(freq: dict[str, int], n_texts: int, num: int, den: int, at_once: int, depth: int) -> int:
    """Words that make a pivot, as few as leave at most ``at_once`` texts in the usual cell."""
    shares = sorted(c / max(1, n_texts) for c in freq.values())
    reach = (den - num) / den * sum(shares) + 1
    got = usual = 0.0
    for s in shares:
        if got >= reach:
            break
        got += s
        usual += s * s
    usual = usual / got if got else 0.0
    level = 1
    while level < depth and n_texts * usual**level > at_once:
        level += 1
    return level


class _Cells:
    """The cells of a text."""

    def __init__(self, freq: dict[str, int], n_texts: int, num: int, den: int, cell_rows: int, level: int, at_once: int) -> None:
        self.freq, self.n, self.num, self.den, self.cell_rows, self.level = freq, max(1, n_texts), num, den, cell_rows, level
        self.alone = at_once // 2
        self._known: dict[str, tuple] = {}
        self._by_size: dict[int, list[tuple]] = {}

    def _fact(self, w: str) -> tuple:
        """Order, hash, bits of the two sketches, share, whether a pivot by itself, and number of a word."""
        f = self._known.get(w)
        if f is None:
            h = xxhash.xxh3_64_intdigest(w)
            df = self.freq.get(w, 0)
            # A word below the counted share is in at most that share of the texts.
            share = df / self.n if df else SHARE
            f = (f"{df:012d}{w}", h, 1 << (h >> 58), 1 << (h >> 52 & 63), share, not df or df <= self.alone, h >> 20 & 0xFFFF)
            if len(self._known) >= 300_000:
                self._known.clear()
            self._known[w] = f
        return f

    def _classes(self, n: int) -> list[tuple]:
        """``(salt, level, groups, caps)`` of the classes of a text of ``n`` words; ``caps[u]`` is the largest partner for which its unit u is needed."""
        out = self._by_size.get(n)
        if out is None:
            out = self._by_size[n] = []
            num, both = self.num, self.num + self.den
            for i, low in enumerate(CLASSES):
                high = CLASSES[i + 1] - 1 if i + 1 < len(CLASSES) else None
                least = max(low, -(-num * n // self.den))
                most = n * self.den // num if high is None or n <= high else high
                if n < low or least > most:
                    continue
                # Words that may go without a unit and still leave enough.
                room = -(-num * low // self.den) - 1
                level = min(self.level, room + 1)
                groups = min(GROUPS, room // (level - 1)) if level > 1 else 1
                caps = [0]
                while (cap := min(most, (n + 1 - len(caps)) * both // num - n)) >= least:
                    caps.append(cap)
                out.append((xxhash.xxh3_64_intdigest(f"class {i}"), level, groups, caps))
        return out

    def of(self, text: str, salt: int) -> tuple[int, int, int, list[int], list[int]]:
        """Number of words, sketches, cells and caps of a text; ``salt`` picks its block where cells are cut into blocks."""
        facts = sorted({self._fact(w) for w in words(text)})
        n = len(facts)
        lo = hi = 0
        for f in facts:
            lo ^= f[2]
            hi ^= f[3]
        cells: list[int] = []
        caps_out: list[int] = []
        for mark, level, groups, caps in self._classes(n) if n else ():
            need = len(caps) - 1
            # By group: the sets of 1 .. level - 1 words so far, as sum of hashes and product of shares.
            have: list[list[list[tuple[int, float]]]] = [[[] for _ in range(level)] for _ in range(groups)]
            u = 0
            for _, h, _, _, share, alone, number in facts:
                if u >= need:
                    break
                if level == 1 or alone:
                    made = [(h, share)]
                else:
                    sets = have[number % groups]
                    made = [(h + s & _M, share * p) for s, p in sets[level - 1]]
                    for k in range(level - 1, 1, -1):
                        sets[k] += [(h + s & _M, share * p) for s, p in sets[k - 1]]
                    sets[1].append((h, share))
                if not made:
                    continue
                u += 1
                for s, p in made:
                    est = p * self.n
                    if est <= self.cell_rows:
                        cells.append(s + mark & _M)
                        caps_out.append(caps[u])
                    else:
                        # Blocks that meet pairwise.
                        b = int(-(-est // self.cell_rows))
                        mine = salt % b
                        cells += [xxhash.xxh3_64_intdigest(f"{s + mark & _M}#{min(mine, j)}#{max(mine, j)}") for j in range(b)]
                        caps_out += [caps[u]] * b
        return n, lo, hi, cells, caps_out


def _alike(i: np.ndarray, j: np.ndarray, n: np.ndarray, cap: np.ndarray, lo: np.ndarray, hi: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs of rows that the sizes, caps and sketches don't rule out."""
    keep = (cap[i] >= n[j]) & (cap[j] >= n[i])
    i, j = i[keep], j[keep]
    for sketch in (lo, hi):
        keep = np.bitwise_count(sketch[i] ^ sketch[j]) * np.int64(den + num) <= (den - num) * (n[i] + n[j])
        i, j = i[keep], j[keep]
    return i, j


def _pairs_in(n: np.ndarray, cap: np.ndarray, lo: np.ndarray, hi: np.ndarray, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of one cell, sorted by size, by tiles."""
    # Rows that may be the smaller of a pair.
    first = np.flatnonzero(cap >= n)
    for k in range(0, len(first), _TILE):
        i = first[k : k + _TILE]
        top = int(np.searchsorted(n, cap[i].max(), side="right"))
        j = i[0] + np.flatnonzero(cap[i[0] : top] >= n[i[0]])
        mine = lo[i][:, None]
        for q in range(0, len(j), 2048):
            y = j[q : q + 2048]
            bound = (den - num) * (int(n[i[-1]]) + int(n[y[-1]])) // (den + num)
            a, b = np.nonzero(np.bitwise_count(mine ^ lo[y]) <= min(bound, 64))
            a, b = i[a], y[b]
            keep = a < b
            yield _alike(a[keep], b[keep], n, cap, lo, hi, num, den)


def _pairs_of(x: np.ndarray, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of ids of whole cells, sorted by cell and size."""
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(x[0])) + 1, [x.shape[1]]])
    size = np.diff(cuts)
    left = np.repeat(cuts[1:], size) - 1 - np.arange(x.shape[1])
    ids, n, cap, lo, hi = x[1], x[2] >> 32, x[2] & 0xFFFFFFFF, x[3].view(np.uint64), x[4].view(np.uint64)
    # All small cells at once: each row with the next, the one after it, and so on.
    i = np.flatnonzero(np.repeat(size <= _FEW, size) & (left > 0))
    step = 1
    while len(i):
        a, b = _alike(i, i + step, n, cap, lo, hi, num, den)
        yield ids[a], ids[b]
        step += 1
        i = i[left[i] >= step]
    for k in np.flatnonzero(size > _FEW):
        s = slice(cuts[k], cuts[k + 1])
        own = ids[s]
        for a, b in _pairs_in(n[s], cap[s], lo[s], hi[s], num, den):
            yield own[a], own[b]


def _join_cells(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        found: list[np.ndarray] = []
        rows = some = 0
        goal = _HELD

        def flush() -> pa.RecordBatch:
            nonlocal some
            p = np.unique(np.concatenate(found, axis=1), axis=1)
            found.clear()
            some = 0
            return pa.RecordBatch.from_arrays([pa.array(p[0]), pa.array(p[1])], names=["a", "b"])

        def work(x: np.ndarray) -> Iterator[pa.RecordBatch]:
            nonlocal some
            for a, b in _pairs_of(x, num, den):
                keep = a != b
                if keep.any():
                    a, b = a[keep], b[keep]
                    found.append(np.stack([np.minimum(a, b), np.maximum(a, b)]))
                    some += len(a)
                if some > 500_000:
                    yield flush()

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]))
            rows += batch.num_rows
            if rows >= goal:
                x = np.concatenate(held, axis=1)
                # The last cell may go on in the next batch.
                tail = int(np.searchsorted(x[0], x[0, -1], side="left"))
                if tail:
                    yield from work(x[:, :tail])
                held = [x[:, tail:]]
                rows -= tail
                goal = max(_HELD, 2 * rows)
        if held:
            yield from work(np.concatenate(held, axis=1))
        if found:
            yield flush()

    return run


def _check(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, like = [], []
            for s, t in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist()):
                x, y = set(words(s)), set(words(t))
                both = len(x & y)
                either = len(x) + len(y) - both
                keep.append(either > 0 and both * den >= num * either)
                like.append(both / either if either else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(like, pa.float64())], names=["a", "b", "likeness"]).filter(pa.array(keep, pa.bool_()))

    return run


def similar_texts(docs: DataFrame, text_col: str, *, likeness: tuple[int, int] = (7, 10), cell_rows: int = 262_144, depth: int = 3, at_once: int = 16_384) -> tuple[DataFrame, DataFrame]:
    """``(texts, links)``: the distinct texts ``(a, text)`` and their pairs ``(a, b, likeness)``.

    ``likeness`` is the threshold as a fraction. Texts are distinct as
    strings; copies are one text, and texts with equal words are linked with a
    likeness of 1. Null, empty and wordless texts take no part. Exact and
    complete at every size; ``cell_rows``, ``depth`` (most words of a pivot) and
    ``at_once`` (see :func:`words_of_a_pivot`) shape the cells, not the result.
    """
    num, den = likeness
    texts = docs.select(F.col(text_col).cast("string").alias("text")).filter("text is not null and text <> ''").distinct()
    texts = materialize(texts.withColumn("a", F.monotonically_increasing_id()).select("a", "text"), "texts")
    n_texts = texts.count()
    spark = docs.sparkSession
    # Bounded, see frequent_words; words below the share count as equally rare, at most share x n_texts texts each.
    counted = frequent_words(texts.select("text"), n_texts)
    level = words_of_a_pivot(counted, n_texts, num, den, at_once, depth)
    freq = spark.sparkContext.broadcast(counted)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = _Cells(freq.value, n_texts, num, den, cell_rows, level, at_once)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                cell, cap, count, ids, ns, los, his = [], [], [], [], [], [], []
                for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    n, lo, hi, got, caps = c.of(t, i * 0x9E3779B1 >> 7)
                    cell += got
                    cap += caps
                    count.append(len(got))
                    ids.append(i)
                    ns.append(n)
                    los.append(lo)
                    his.append(hi)
                u = lambda v: np.array(v, dtype=np.uint64).view(np.int64)
                each = lambda v: pa.array(np.repeat(v, count))
                sizes = np.repeat(np.array(ns, np.int64), count) << 32 | np.array(cap, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(u(cell)), each(np.array(ids, np.int64)), pa.array(sizes), each(u(los)), each(u(his))], names=["cell", "id", "sizes", "lo", "hi"])

    members = texts.mapInArrow(cells, "cell bigint, id bigint, sizes bigint, lo bigint, hi bigint")
    found = members.repartition("cell").sortWithinPartitions("cell", "sizes").mapInArrow(_join_cells(num, den), "a bigint, b bigint").distinct()
    # Written, as each table is: the shuffles of a step are dropped before the next.
    found = materialize(found, "found")
    other = texts.select(F.col("a").alias("b"), F.col("text").alias("text_b"))
    both = found.join(texts.withColumnRenamed("text", "text_a"), "a").join(other, "b").select("a", "b", "text_a", "text_b")
    links = materialize(both.mapInArrow(_check(num, den), "a bigint, b bigint, likeness double"), "links")
    discard(found)
    return texts, links


def linked_records(docs: DataFrame, id_col: str, text_col: str, **options) -> DataFrame:
    """``(id_a, id_b)`` with id_a < id_b: records whose texts differ as strings and are linked.

    A record id counts once for each text it comes with. Records without
    words take no part; see :func:`similar_texts`.
    """
    texts, links = similar_texts(docs, text_col, **options)
    nodes = links.select("a").union(links.select(F.col("b").alias("a"))).distinct()
    linked = texts.join(nodes, "a")
    owners = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter("id is not null and text <> ''").join(linked, "text").select("id", "a").distinct()
    owners = materialize(owners, "owners")
    pairs = links.join(owners.withColumnRenamed("id", "x"), "a").join(owners.select(F.col("a").alias("b"), F.col("id").alias("y")), "b").filter("x <> y")
    return pairs.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()
