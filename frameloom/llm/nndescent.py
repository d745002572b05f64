"""The k most similar vectors of every vector, by a neighbour graph.

1. Vectors are kept as unit vectors of 8-bit numbers for the search; cosines
   that are reported come from the given numbers.
2. Pivots, the k-means centres of a bounded sample, cut the space into cells;
   every vector goes to the cells of its nearest pivots, and the best
   neighbours within each cell make the first graph. With more than ``branch``
   pivots the centres form a tree of two levels. A cell of more than
   ``cell_rows`` members is cut again by pivots of its own, its members going
   to the two nearest.
3. NN-descent: at every vector, its neighbours and a sample of those that have
   it as neighbour are compared with each other; pairs better than what either
   has enter the graph. Pairs of which neither edge is new since the last round
   are not compared again. Rounds go on until few entries of the lists change.
4. Queries walk the graph greedily, see :mod:`frameloom.llm.graph_search`.

What moves between tasks are messages: rows (part, kind, n, body) whose body
holds n records as columns of fixed width. A part is a hash of the vector or
cell the records are for, so a join of neighbours' neighbours is an exchange
by part and a few array operations, and the JVM sees no row per record.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frameloom.session import cut, discard, input_cores, materialize


@dataclass(frozen=True)
class GraphOptions:
    """Sizes of the graph and of the work on it.

    ``keep``: neighbours held per vector. ``cells``: cells a vector goes to;
    ``cell_keep``: neighbours taken from each. ``pivot_rows``: vectors per
    pivot; ``fit_rows``: sampled vectors per pivot for the k-means;
    ``max_pivots`` bounds both the sample and what is broadcast. ``branch``:
    pivots compared at once. ``beam``: groups of the upper level searched.
    ``forward``, ``reverse``: neighbours compared at a vector. ``slices``:
    parts of a round that are done one after the other, so that its shuffles
    take less disk at a time. ``least_change``: rounds end when a smaller share
    of the list entries is new; ``rounds`` is the most there may be.
    """

    dims: int = 64
    keep: int = 20
    cells: int = 6
    cell_keep: int = 6
    pivot_rows: int = 1000
    fit_rows: int = 128
    max_pivots: int = 262_144
    branch: int = 512
    beam: int = 8
    cell_rows: int = 20_000
    part_rows: int = 20_000
    rounds: int = 30
    least_change: float = 0.01
    forward: int = 6
    reverse: int = 6
    slices: int = 3
    seed: int = 11


# --- Columns of bytes ------------------------------------------------------


def _bytes_of(col: pa.Array, kind, width: int) -> np.ndarray:
    """A binary column of equal lengths as rows of numbers."""
    return np.frombuffer(b"".join(col.to_pylist()), dtype=kind).reshape(-1, width)


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of numbers as a binary column."""
    rows = np.ascontiguousarray(rows)
    width = rows.dtype.itemsize * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(0, (len(rows) + 1) * width, width, dtype=np.int32).tobytes() if width else b""), pa.py_buffer(rows.tobytes())])


def _unit(q: np.ndarray) -> np.ndarray:
    x = q.astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


# --- Messages --------------------------------------------------------------

_MESSAGE = "part int, kind int, n int, body binary"
_BODY = 16_384  # records of one message at most


def _mix(x: np.ndarray) -> np.ndarray:
    """A hash of whole numbers."""
    with np.errstate(over="ignore"):
        h = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(20)


def _part(x: np.ndarray, parts: int) -> np.ndarray:
    return (_mix(x) % np.uint64(parts)).astype(np.int32)


def _send(part: np.ndarray, kind: int, *columns: np.ndarray) -> pa.RecordBatch:
    """Messages of records, those for one part together."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    columns = tuple(np.ascontiguousarray(c[order]) for c in columns)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]]) if len(part) else np.zeros(1, int)
    spans = [(i, min(i + _BODY, z)) for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist()) for i in range(a, z, _BODY)]
    bodies = [b"".join(c[a:z].tobytes() for c in columns) for a, z in spans]
    return pa.RecordBatch.from_arrays(
        [pa.array([int(part[a]) for a, _ in spans], pa.int32()), pa.array([kind] * len(spans), pa.int32()), pa.array([z - a for a, z in spans], pa.int32()), pa.array(bodies, pa.binary())], names=["part", "kind", "n", "body"]
    )


#: Columns of a kind of message: (type, width); width 0 is one number.
Layout = list[tuple[str, int]]


def _receive(batches: Iterator[pa.RecordBatch], layouts: dict[int, Layout]) -> dict[int, list[np.ndarray]]:
    """All records that were sent to a task, as columns by kind."""
    got: dict[int, list[list[np.ndarray]]] = {k: [[] for _ in lay] for k, lay in layouts.items()}
    for b in batches:
        for kind, n, body in zip(b.column("kind").to_pylist(), b.column("n").to_pylist(), b.column("body").to_pylist()):
            at = 0
            for j, (dtype, width) in enumerate(layouts[kind]):
                size = n * max(1, width) * np.dtype(dtype).itemsize
                a = np.frombuffer(body, dtype=dtype, count=n * max(1, width), offset=at)
                got[kind][j].append(a.reshape(n, width) if width else a)
                at += size
    return {k: [np.concatenate(c) if c else np.empty((0, w) if w else 0, dtype=d) for c, (d, w) in zip(cols, layouts[k])] for k, cols in got.items()}


def _exchange(messages: DataFrame, parts: int) -> DataFrame:
    return messages.repartitionById(parts, "part")


def _sorted_by(*keys: tuple[np.ndarray, int]) -> np.ndarray:
    """Order by keys (values of at least 0, number of bits), the first one outermost."""
    if sum(bits for _, bits in keys) <= 63:
        key = np.zeros(len(keys[0][0]), dtype=np.int64)
        for values, bits in keys:
            key = (key << bits) | values.astype(np.int64)
        return np.argsort(key)
    return np.lexsort([values for values, _ in reversed(keys)])


# --- Entries of lists: 15 bits of cosine, 47 of the neighbour, 1 if fresh ----

_ID_BITS = 47
_SCALE = 16_383.0


def _entries(ids: np.ndarray, sims: np.ndarray, fresh: int) -> np.ndarray:
    s = np.clip(np.rint((sims + 1) * _SCALE), 1, 32_767).astype(np.int64)
    return (s << (_ID_BITS + 1)) | (ids.astype(np.int64) << 1) | fresh


def _id_of(e: np.ndarray) -> np.ndarray:
    return (e >> 1) & ((1 << _ID_BITS) - 1)


def _sim15(e: np.ndarray) -> np.ndarray:
    return e >> (_ID_BITS + 1)


def _sim_of(e: np.ndarray) -> np.ndarray:
    return _sim15(e) / np.float32(_SCALE) - 1


def _best_entries(owner: np.ndarray, entry: np.ndarray, keep: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct entries of each owner, best first, at most ``keep``, with their ranks. Of copies the one that is not fresh stays."""
    owners, own = np.unique(owner, return_inverse=True)
    width = max(1, len(owners).bit_length())
    o = _sorted_by((own, width), (_id_of(entry), bits), (entry & 1, 1))
    own, entry = own[o], entry[o]
    if len(own):
        to = _id_of(entry)
        first = np.concatenate([[True], (own[1:] != own[:-1]) | (to[1:] != to[:-1])])
        own, entry = own[first], entry[first]
    o = _sorted_by((own, width), (32_767 - _sim15(entry), 15), (_id_of(entry), bits))
    own, entry = own[o], entry[o]
    start = np.searchsorted(own, np.arange(len(owners)))
    rank = np.arange(len(own)) - start[own]
    m = rank < keep
    return owners[own[m]], entry[m], rank[m]


# --- The vectors -----------------------------------------------------------


def usable(vectors: DataFrame, dims: int) -> DataFrame:
    """``(rec, q)``: each record with a vector of ``dims`` numbers that are not all zero, once, as 8-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 8192):
                part = b.slice(at, 8192)
                if not part.num_rows:
                    continue
                # A null among the numbers comes out as not a number.
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
                ok = np.isfinite(x).all(1) & (x != 0).any(1)
                x = x / np.maximum(np.abs(x).max(1, keepdims=True, initial=0), 1e-300)
                x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
                q = np.rint(x / np.maximum(np.abs(x).max(1, keepdims=True), 1e-300) * 127)
                q = np.nan_to_num(q).astype(np.int8)
                mask = pa.array(ok)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(mask), _binary(q).filter(mask)], names=["rec", "q"])

    full = F.col("v").isNotNull() & (F.size("v") == dims)
    rows = vectors.select(F.col("rec").cast("string").alias("rec"), F.col("v").cast("array<double>").alias("v")).filter(F.col("rec").isNotNull() & full)
    return rows.mapInArrow(run, "rec string, q binary").groupBy("rec").agg(F.min("q").alias("q"))


def _best(d: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest of each row: they lie in the k groups of 16 columns with the largest maxima. A group's columns lie apart, so the maxima are taken over whole rows."""
    n, c = d.shape
    if c <= 16 * k:
        return np.argpartition(d, c - k, axis=1)[:, -k:] if k < c else np.broadcast_to(np.arange(c), (n, c))
    w = c // 16
    tops = d[:, : w * 16].reshape(n, 16, w).max(axis=1)
    g = np.argpartition(tops, w - k, axis=1)[:, -k:]
    cols = (g[:, :, None] + np.arange(16) * w).reshape(n, -1)
    if w * 16 < c:
        cols = np.concatenate([cols, np.broadcast_to(np.arange(w * 16, c), (n, c - w * 16))], axis=1)
    v = np.take_along_axis(d, cols, axis=1)
    return np.take_along_axis(cols, np.argpartition(v, v.shape[1] - k, axis=1)[:, -k:], axis=1)


# --- Pivots ----------------------------------------------------------------


def _centres(x: np.ndarray, k: int, seed: int, steps: int = 6) -> np.ndarray:
    """Spherical k-means of unit rows; 8-bit centres."""
    c = x[np.random.default_rng(seed).permutation(len(x))[:k]]
    for _ in range(steps):
        near = np.concatenate([(x[a : a + 4096] @ c.T).argmax(1) for a in range(0, len(x), 4096)])
        order = np.argsort(near, kind="stable")
        which, start = np.unique(near[order], return_index=True)
        total = np.add.reduceat(x[order], start, axis=0)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = c.copy()
        c[which] = np.where(size > 1e-6, total / np.maximum(size, 1e-9), c[which])
    return np.rint(c / np.maximum(np.abs(c).max(1, keepdims=True), 1e-9) * 127).astype(np.int8)


class _Pivots:
    """Pivots in groups of an upper level; with one group, all are compared."""

    def __init__(self, upper: np.ndarray | None, groups: list[np.ndarray], beam: int) -> None:
        self.upper = None if upper is None else _unit(upper)
        self.groups = [_unit(g) for g in groups]
        self.first = np.concatenate([[0], np.cumsum([len(g) for g in groups])])
        self.beam = beam

    def nearest(self, x: np.ndarray, m: int) -> np.ndarray:
        """Numbers of the m nearest pivots of unit rows, nearest first; -1 where there are fewer."""
        out = np.empty((len(x), m), dtype=np.int32)
        for a in range(0, len(x), 4096):
            out[a : a + 4096] = self._nearest(x[a : a + 4096], m)
        return out

    def _nearest(self, x: np.ndarray, m: int) -> np.ndarray:
        if self.upper is None:
            d, names = x @ self.groups[0].T, None
        else:
            some = _best(x @ self.upper.T, min(self.beam, len(self.groups)))
            width = max(len(g) for g in self.groups)
            d = np.full((len(x), some.shape[1], width), -2, np.float32)
            names = np.full((len(x), some.shape[1], width), -1, np.int64)
            order = np.argsort(some.ravel(), kind="stable")
            which, start = np.unique(some.ravel()[order], return_index=True)
            for g, at in zip(which.tolist(), np.split(order, start[1:])):
                r, s = np.divmod(at, some.shape[1])
                k = len(self.groups[g])
                d[r, s, :k] = x[r] @ self.groups[g].T
                names[r, s, :k] = self.first[g] + np.arange(k)
            d, names = d.reshape(len(x), -1), names.reshape(len(x), -1)
        k = min(m, d.shape[1])
        j = _best(d, k)
        j = np.take_along_axis(j, np.argsort(-np.take_along_axis(d, j, axis=1), axis=1, kind="stable"), axis=1)
        near = j if names is None else np.take_along_axis(names, j, axis=1)
        return np.pad(near, ((0, 0), (0, m - k)), constant_values=-1)


def fit_pivots(nodes: DataFrame, n: int, o: GraphOptions):
    """A broadcast function that makes the pivots of ``n`` nodes (id, q). At most ``max_pivots`` x ``fit_rows`` nodes are sampled."""
    sc = nodes.sparkSession.sparkContext
    want = int(min(o.max_pivots, max(1, -(-n // o.pivot_rows))))
    top = want if want <= o.branch else int(np.ceil(np.sqrt(want)))
    h = F.xxhash64("id", F.lit(o.seed))

    def sample(rows: int) -> DataFrame:
        share = min(1.0, 1.2 * rows / n)
        return nodes.select("id", "q") if share >= 1 else nodes.select("id", "q").filter(F.pmod(h, F.lit(1_000_000)) < int(np.ceil(share * 1_000_000)))

    def unpacked(rows) -> np.ndarray:
        return np.frombuffer(b"".join(bytes(r[0]) for r in rows), dtype=np.int8).reshape(-1, o.dims)

    upper = _centres(_unit(unpacked(sample(top * o.fit_rows).orderBy(h, "id").limit(top * o.fit_rows).select("q").collect())), top, o.seed)
    if want <= o.branch:
        return sc.broadcast((None, [upper], o.beam))
    below = -(-want // top)
    known = sc.broadcast(upper)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = _Pivots(None, [known.value], 1)
        for b in batches:
            if b.num_rows:
                q = _bytes_of(b.column("q"), np.int8, o.dims)
                yield _send(p.nearest(_unit(q), 1)[:, 0], 0, q)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list[bytes]] = {}
        for b in batches:
            for g, body in zip(b.column("part").to_pylist(), b.column("body").to_pylist()):
                by.setdefault(g, []).append(body)
        for g, bodies in by.items():
            q = np.frombuffer(b"".join(bodies), dtype=np.int8).reshape(-1, o.dims)
            yield _send(np.array([g]), 0, _centres(_unit(q), min(below, len(q)), o.seed + g).reshape(1, -1))

    groups = {r["part"]: np.frombuffer(bytes(r["body"]), dtype=np.int8).reshape(-1, o.dims) for r in _exchange(sample(want * o.fit_rows).select("q").mapInArrow(near, _MESSAGE), top).mapInArrow(fit, _MESSAGE).collect()}
    # An upper pivot whose group is empty in the sample is its own only pivot.
    return sc.broadcast((upper, [groups.get(g, upper[g : g + 1]) for g in range(top)], o.beam))


# --- Cells -----------------------------------------------------------------


def _cell_lists(o: GraphOptions, parts: int):
    """Best neighbours of each vector within each cell: messages (id, entries) to the vector's part."""
    lay: Layout = [("i8", 0), ("i8", 0), ("i1", o.dims)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, ids, q = _receive(batches, {0: lay})[0]
        order = np.argsort(cell, kind="stable")
        cell, ids, x = cell[order], ids[order], _unit(q[order])
        del q
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(cell)) + 1, [len(cell)]]) if len(cell) else np.zeros(1, int)
        who, what, held = [], [], 0
        for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            k = min(o.cell_keep, z - a - 1)
            if k < 1:
                continue
            own, vec = ids[a:z], x[a:z]
            for i in range(0, z - a, 256):
                d = vec[i : i + 256] @ vec.T
                r = np.arange(len(d))
                d[r, r + i] = -2
                j = _best(d, k)
                e = np.zeros((len(d), o.cell_keep), np.int64)
                e[:, :k] = _entries(own[j], np.take_along_axis(d, j, axis=1), 1)
                who.append(own[i : i + 256])
                what.append(e)
                held += len(d)
            if held >= 50_000:
                w = np.concatenate(who)
                yield _send(_part(w, parts), 0, w, np.concatenate(what))
                who, what, held = [], [], 0
        if held:
            w = np.concatenate(who)
            yield _send(_part(w, parts), 0, w, np.concatenate(what))

    return run


_LIST = "id bigint, list binary"


def _merge(o: GraphOptions, bits: int, old: bool):
    """Messages (id, entries) and old lists (kind 1) of the vectors of a part to one list of the best, padded with zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lay = {0: [("i8", 0), ("i8", 1 if old else o.cell_keep)]} | ({1: [("i8", 0), ("i8", o.keep)]} if old else {})
        got = _receive(batches, lay)
        owner = np.concatenate([np.repeat(ids, e.shape[1]) for ids, e in got.values()])
        entry = np.concatenate([e.ravel() for _, e in got.values()])
        if not len(owner):
            return
        own = np.unique(owner)
        owner, entry, rank = _best_entries(owner[entry > 0], entry[entry > 0], o.keep, bits)
        out = np.zeros((len(own), o.keep), np.int64)
        out[np.searchsorted(own, owner), rank] = entry
        for a in range(0, len(own), 8192):
            yield pa.RecordBatch.from_arrays([pa.array(own[a : a + 8192]), _binary(out[a : a + 8192])], names=["id", "list"])

    return run


# --- Descent ---------------------------------------------------------------

_EDGE: Layout = [("i8", 0), ("i8", 0), ("i1", 0)]  # centre, member, 1 if fresh, 2 more if the member names the centre


def _edges(o: GraphOptions, parts: int, k: int):
    """Of each list the best ``forward`` entries: messages (centre, member, flags) for both ends as centre, of the centres of slice k."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            e = _bytes_of(b.column("list"), np.int64, o.keep)[:, : o.forward]
            ids = np.repeat(b.column("id").to_numpy(), e.shape[1])
            ids, e = ids[e.ravel() > 0], e.ravel()[e.ravel() > 0]
            nb, fresh = _id_of(e), (e & 1).astype(np.int8)
            centre, member, flag = np.concatenate([ids, nb]), np.concatenate([nb, ids]), np.concatenate([fresh, fresh | 2])
            here = _slice(centre, o.slices) == k
            yield _send(_part(centre[here], parts), 0, centre[here], member[here], flag[here])

    return run


def _slice(x: np.ndarray, slices: int) -> np.ndarray:
    return (_mix(x + 1) >> np.uint64(8)) % np.uint64(slices)


def _requests(o: GraphOptions, parts: int, salt: int):
    """The members compared at each centre that has a fresh one: messages (centre, member, fresh) to the member's part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, member, flag = _receive(batches, {0: _EDGE})[0]
        if not len(centre):
            return
        _, c = np.unique(centre, return_inverse=True)
        # Reverse edges: fresh ones first, then by a hash that changes from round to round.
        back = flag >> 1
        width = max(1, int(c.max()).bit_length())
        o_ = _sorted_by((c, width), (back, 1), (1 - (flag & 1), 1), (_mix(member + salt) & np.uint64((1 << 28) - 1), 28))
        c, centre, member, flag, back = c[o_], centre[o_], member[o_], flag[o_], back[o_]
        group = c * 2 + back
        first = np.concatenate([[True], group[1:] != group[:-1]])
        start = np.flatnonzero(first)
        rank = np.arange(len(group)) - np.repeat(start, np.diff(np.concatenate([start, [len(group)]])))
        ok = (back == 0) | (rank < o.reverse)
        c, centre, member, fresh = c[ok], centre[ok], member[ok], (flag[ok] & 1).astype(np.int8)
        # Two that name each other meet once; the edge is fresh only if both hold it so.
        o_ = np.lexsort((fresh, member, c))
        c, centre, member, fresh = c[o_], centre[o_], member[o_], fresh[o_]
        one = np.concatenate([[True], (c[1:] != c[:-1]) | (member[1:] != member[:-1])])
        c, centre, member, fresh = c[one], centre[one], member[one], fresh[one]
        live = np.bincount(c, weights=fresh, minlength=int(c.max()) + 1)[c] > 0
        for a in range(0, int(live.sum()), 500_000):
            s = np.flatnonzero(live)[a : a + 500_000]
            yield _send(_part(member[s], parts), 0, centre[s], member[s], fresh[s])

    return run


def _vectors(o: GraphOptions, parts: int):
    """Messages (id, q) to the vector's part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ids = b.column("id").to_numpy()
                yield _send(_part(ids, parts), 1, ids, _bytes_of(b.column("q"), np.int8, o.dims))

    return run


def _worsts(o: GraphOptions, parts: int):
    """Messages (id, the cosine that a new neighbour must exceed) to the vector's part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ids = b.column("id").to_numpy()
                yield _send(_part(ids, parts), 2, ids, _sim15(_bytes_of(b.column("list"), np.int64, o.keep)[:, -1]).astype(np.int16))

    return run


def _answers(o: GraphOptions, parts: int):
    """Each requested vector: messages (centre, member, fresh, worst, q) to the centre's part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _receive(batches, {0: _EDGE, 1: [("i8", 0), ("i1", o.dims)], 2: [("i8", 0), ("i2", 0)]})
        centre, member, fresh = got[0]
        ids, q = got[1]
        order = np.argsort(ids)
        ids, q = ids[order], q[order]
        worst = np.zeros(len(ids), np.int16)
        worst[np.searchsorted(ids, got[2][0])] = got[2][1]
        for a in range(0, len(centre), 200_000):
            c, m = centre[a : a + 200_000], member[a : a + 200_000]
            at = np.searchsorted(ids, m)
            yield _send(_part(c, parts), 0, c, m, fresh[a : a + 200_000], worst[at], q[at])

    return run


def _local_join(o: GraphOptions, parts: int, bits: int):
    """Pairs of vectors that met at a centre, one of them by a fresh edge, where they better one's list: messages (owner, entry) to the owner's part."""
    lay: Layout = [("i8", 0), ("i8", 0), ("i1", 0), ("i2", 0), ("i1", o.dims)]
    width = o.forward + o.reverse

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, ids, fresh, worst, q = _receive(batches, {0: lay})[0]
        order = np.argsort(c, kind="stable")
        c, ids, fresh, worst, q = c[order], ids[order], fresh[order], worst[order].astype(np.float32) / np.float32(_SCALE) - 1, q[order]
        start = np.concatenate([[0], np.flatnonzero(np.diff(c)) + 1, [len(c)]]) if len(c) else np.zeros(1, int)
        size = np.diff(start)
        owners, entries, held = [], [], 0

        def out() -> pa.RecordBatch:
            nonlocal held
            # A pair met at several centres is sent once, and of a vector no more than a list.
            w, e, _ = _best_entries(np.concatenate(owners), np.concatenate(entries), o.keep, bits)
            owners.clear()
            entries.clear()
            held = 0
            return _send(_part(w, parts), 0, w, e)

        for a in range(0, len(size), 1024):
            s, n = start[a : a + 1024][: len(size[a : a + 1024])], size[a : a + 1024]
            slot = np.arange(width)[None, :]
            at = np.where(slot < n[:, None], s[:, None] + slot, -1)
            m, v, new = ids[at], _unit(q[at].reshape(-1, o.dims)).reshape(*at.shape, o.dims), fresh[at] > 0
            d = v @ v.transpose(0, 2, 1)
            ok = (d > worst[at][:, :, None]) & (at[:, :, None] >= 0) & (at[:, None, :] >= 0) & (m[:, :, None] != m[:, None, :]) & (new[:, :, None] | new[:, None, :])
            g, i, j = np.nonzero(ok)
            if len(g):
                owners.append(m[g, i])
                entries.append(_entries(m[g, j], d[g, i, j], 1))
                held += len(g)
            if held > 2_000_000:
                yield out()
        if held:
            yield out()

    return run


def _old_lists(o: GraphOptions, parts: int):
    """Messages of the lists to their own parts; the edges that took part are no longer fresh."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                e = _bytes_of(b.column("list"), np.int64, o.keep).copy()
                e[:, : o.forward] &= ~np.int64(1)
                ids = b.column("id").to_numpy()
                yield _send(_part(ids, parts), 1, ids, e)

    return run


def _fresh_count(o: GraphOptions):
    """Fresh edges among those the next round would follow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([int((_bytes_of(b.column("list"), np.int64, o.keep)[:, : o.forward] & 1).sum())], pa.int64())], names=["n"])

    return run


class NeighbourGraph:
    """``nodes`` (id, rec, q, cells) and ``lists`` (id, list), both written to the shared folder."""

    def __init__(self, vectors: DataFrame, options: GraphOptions | None = None) -> None:
        """Build over ``(rec, v)``. Records whose vector is null, of another length, all zero or not finite take no part; a record counts once."""
        o = self.options = options or GraphOptions()
        self.vectors = vectors
        spark = vectors.sparkSession
        raw = materialize(usable(vectors, o.dims).withColumn("m", F.monotonically_increasing_id()), "vectors")
        # Numbers as small as the partitions allow.
        task, row = F.shiftright("m", 33), F.col("m").bitwiseAND(F.lit(2**33 - 1))
        self.n, tasks, rows = raw.agg(F.count(F.lit(1)), F.max(task), F.max(row)).head()
        self.changed: list[float] = []
        self.pivots = None
        if not self.n:
            self.nodes = cut(spark.createDataFrame([], "rec string, q binary, id bigint, cells binary"))
            self.lists = cut(spark.createDataFrame([], _LIST))
            return
        low = max(1, int(rows).bit_length())
        self.bits = low + max(1, int(tasks).bit_length())
        if self.bits > _ID_BITS:
            raise ValueError("more vectors than lists can number")
        raw = raw.select("rec", "q", (F.shiftleft(task, low) + row).alias("id"))
        self.parts = int(max(input_cores(spark), -(-self.n // o.part_rows)))
        self.pivots = fit_pivots(raw, self.n, o)
        self.nodes = materialize(self._with_cells(raw), "nodes")
        discard(raw)
        # In two written steps, so that the vectors' shuffle is gone when the lists are moved.
        found = materialize(_exchange(self._cell_messages(), self.parts).mapInArrow(_cell_lists(o, self.parts), _MESSAGE), "cells")
        single = self.nodes.select("id").mapInArrow(self._nothing(), _MESSAGE).unionByName(found)
        self.lists = materialize(_exchange(single, self.parts).mapInArrow(_merge(o, self.bits, False), _LIST), "graph")
        discard(found)
        for k in range(o.rounds):
            better = [materialize(self._descend(k, s), "better") for s in range(o.slices)]
            found = self.lists.mapInArrow(_old_lists(o, self.parts), _MESSAGE)
            for b in better:
                found = found.unionByName(b)
            before, self.lists = self.lists, materialize(_exchange(found, self.parts).mapInArrow(_merge(o, self.bits, True), _LIST), "graph")
            discard(before)
            for b in better:
                discard(b)
            new = self.lists.select("list").mapInArrow(_fresh_count(o), "n bigint").agg(F.sum("n")).head()[0] or 0
            self.changed.append(new / (self.n * min(o.forward, max(1, self.n - 1))))
            if self.changed[-1] < o.least_change:
                break

    def _nothing(self):
        """An empty list for every vector, so that one alone in its cells has a list, too."""
        o, parts = self.options, self.parts

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    ids = b.column("id").to_numpy()
                    yield _send(_part(ids, parts), 0, ids, np.zeros((len(ids), o.cell_keep), np.int64))

        return run

    def _with_cells(self, raw: DataFrame) -> DataFrame:
        o, pivots = self.options, self.pivots

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            p = None
            for b in batches:
                if b.num_rows:
                    p = p or _Pivots(*pivots.value)
                    near = p.nearest(_unit(_bytes_of(b.column("q"), np.int8, o.dims)), o.cells)
                    yield pa.RecordBatch.from_arrays([b.column("rec"), b.column("q"), b.column("id"), _binary(near)], names=["rec", "q", "id", "cells"])

        return raw.mapInArrow(run, "rec string, q binary, id bigint, cells binary")

    def _cell_messages(self) -> DataFrame:
        """Messages (cell, id, q) of every vector to each of its cells, those of large cells cut again."""
        o, parts = self.options, self.parts

        def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts: dict[int, int] = {}
            for b in batches:
                if b.num_rows:
                    for c, n in zip(*(x.tolist() for x in np.unique(_bytes_of(b.column("cells"), np.int32, o.cells), return_counts=True))):
                        counts[c] = counts.get(c, 0) + n
            yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.int64()), pa.array(counts.values(), pa.int64())], names=["cell", "n"])

        # The number of pivots bounds the rows that come back.
        sizes = {r[0]: r[1] for r in self.nodes.select("cells").mapInArrow(tell, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).filter((F.col("n") > o.cell_rows) & (F.col("cell") >= 0)).collect()}
        large = np.array(sorted(sizes), dtype=np.int64)

        def send(inside: bool) -> Callable:
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    for at in range(0, b.num_rows, 8192):
                        s = b.slice(at, 8192)
                        cells = _bytes_of(s.column("cells"), np.int32, o.cells).astype(np.int64)
                        ok = (cells >= 0) & (np.isin(cells, large) == inside)
                        row = np.nonzero(ok)[0]
                        if len(row):
                            yield _send(_part(cells[ok], parts), 0, cells[ok], s.column("id").to_numpy()[row], _bytes_of(s.column("q"), np.int8, o.dims)[row])

            return run

        source = self.nodes.select("id", "q", "cells")
        out = source.mapInArrow(send(False), _MESSAGE)
        if len(large):
            out = out.unionByName(self._cut_cells(source.mapInArrow(send(True), _MESSAGE), sizes))
        return out

    def _cut_cells(self, messages: DataFrame, sizes: dict[int, int], depth: int = 0) -> DataFrame:
        """Messages of large cells, cut by pivots of their own: each member goes to the two nearest. Cells of equal vectors, which no pivot can cut, become blocks by id, within which all are alike."""
        o, parts, spark = self.options, self.parts, self.nodes.sparkSession
        lay: Layout = [("i8", 0), ("i8", 0), ("i1", o.dims)]
        held = materialize(messages, "large")
        fit_rows = 16 * o.fit_rows
        share = {c: fit_rows / n for c, n in sizes.items()}
        ways = {c: int(min(o.branch, -(-4 * n // o.cell_rows))) for c, n in sizes.items()}

        def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cell, ids, q = _receive(iter([b]), {0: lay})[0]
                rate = np.array([share[c] for c in cell.tolist()])
                ok = (_mix(ids + o.seed) & np.uint64(0xFFFFF)) < rate * 2**20
                if ok.any():
                    yield _send(_part(cell[ok], parts), 0, cell[ok], ids[ok], q[ok])

        def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cell, _, q = _receive(batches, {0: lay})[0]
            for c in np.unique(cell).tolist():
                mine = np.unique(q[cell == c], axis=0)
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()), pa.array([_centres(_unit(mine), min(ways[c], len(mine)), o.seed).tobytes()], pa.binary())], names=["cell", "pivots"])

        # At most 4 pivots for every cell_rows members.
        rows = _exchange(held.mapInArrow(sample, _MESSAGE), parts).mapInArrow(fit, "cell bigint, pivots binary").collect()
        own = spark.sparkContext.broadcast({r[0]: np.frombuffer(bytes(r[1]), dtype=np.int8).reshape(-1, o.dims) for r in rows})
        blocks = {c: -(-n // o.cell_rows) for c, n in sizes.items()}

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cell, ids, q = _receive(iter([b]), {0: lay})[0]
                for c in np.unique(cell).tolist():
                    at = np.flatnonzero(cell == c)
                    pivots = own.value.get(c)
                    if pivots is None or len(pivots) < 2 or depth >= 8:
                        near = (_mix(ids[at]) % np.uint64(blocks[c])).astype(np.int64)[:, None]
                    else:
                        near = _Pivots(None, [pivots], 1).nearest(_unit(q[at]), 2).astype(np.int64)
                    name = (_mix(near.ravel() + 1_000_003 * (c & 0xFFFFFFFF) + 7 * (depth + 1)) | np.uint64(1 << 40)).astype(np.int64)
                    take = np.repeat(at, near.shape[1])
                    yield _send(_part(name, parts), 0, name, ids[take], q[take])

        done = materialize(held.mapInArrow(split, _MESSAGE), "cut")
        discard(held)

        def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                c, n = np.unique(_receive(iter([b]), {0: lay})[0][0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(n.astype(np.int64))], names=["cell", "n"])

        counts = {r[0]: r[1] for r in done.mapInArrow(tell, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).filter(F.col("n") > 2 * o.cell_rows).collect()}
        if not counts or depth >= 8:
            return done
        large = np.array(sorted(counts), dtype=np.int64)

        def pick(inside: bool) -> Callable:
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    cell, ids, q = _receive(iter([b]), {0: lay})[0]
                    ok = np.isin(cell, large) == inside
                    if ok.any():
                        yield _send(_part(cell[ok], parts), 0, cell[ok], ids[ok], q[ok])

            return run

        return done.mapInArrow(pick(False), _MESSAGE).unionByName(self._cut_cells(done.mapInArrow(pick(True), _MESSAGE), counts, depth + 1))

    def _descend(self, k: int, s: int) -> DataFrame:
        """Round k at the centres of slice s: messages of better pairs."""
        o, parts = self.options, self.parts
        asked = _exchange(self.lists.mapInArrow(_edges(o, parts, s), _MESSAGE), parts).mapInArrow(_requests(o, parts, o.seed + k), _MESSAGE)
        known = self.nodes.select("id", "q").mapInArrow(_vectors(o, parts), _MESSAGE).unionByName(self.lists.mapInArrow(_worsts(o, parts), _MESSAGE))
        there = _exchange(asked.unionByName(known), parts).mapInArrow(_answers(o, parts), _MESSAGE)
        return _exchange(there, parts).mapInArrow(_local_join(o, parts, self.bits), _MESSAGE)

    def candidates(self, least: float = -2.0, k: int | None = None, slack: float = 0.0) -> DataFrame:
        """``(a, b, approx)`` by record: the edges of the graph of at least that approximate cosine; with ``k`` those at most ``slack`` below a vector's k-th best."""
        o = self.options

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    e = _bytes_of(b.column("list"), np.int64, o.keep)
                    sim = _sim_of(e)
                    ok = (e > 0) & (sim >= least)
                    if k is not None:
                        ok &= sim >= np.where(e > 0, sim, -2)[:, [min(k, o.keep) - 1]] - slack
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column("id").to_numpy(), o.keep)[ok.ravel()]), pa.array(_id_of(e)[ok]), pa.array(sim[ok].astype(np.float32))], names=["x", "y", "approx"])

        e = self.lists.mapInArrow(run, "x bigint, y bigint, approx float")
        names = self.nodes.select("id", "rec")
        return e.join(names.select(F.col("id").alias("x"), F.col("rec").alias("a")), "x").join(names.select(F.col("id").alias("y"), F.col("rec").alias("b")), "y").select("a", "b", "approx")

    def neighbours(self, k: int = 5, least: float = -2.0) -> DataFrame:
        """``(a, b, rank, cosine)``: the k most similar records of each, with cosines of the given numbers; ties by record."""
        slack = 0.02  # more than the 8-bit numbers can be off
        pairs = cut(self.candidates(least - slack, k, slack).select("a", "b"))
        return top_by_cosine(pairs, self.vectors, self.options.dims, k, least)


# --- Exact cosines -----------------------------------------------------------


def _cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            x, y = (np.stack([np.asarray(v, dtype=np.float64) for v in b.column(c).to_pylist()]) for c in ("va", "vb"))
            # Scaled first, so that neither squares nor products overflow or vanish.
            x, y = (v / np.abs(v).max(1, keepdims=True) for v in (x, y))
            c = (x * y).sum(1) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(c)], names=["a", "b", "cosine"])


def _bitmap(keys: DataFrame, bits: int) -> DataFrame:
    """One row ``bits``: a map of fixed size in which the hashes of all keys are set, joined in a tree."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(bits, dtype=bool)
        for b in batches:
            seen[b.column(0).to_numpy(zero_copy_only=False)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(seen, bitorder="little").tobytes()], pa.binary())], names=["bits"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(bits // 8, dtype=np.uint8)
        for b in batches:
            for x in b.column(0).to_pylist():
                total |= np.frombuffer(x, dtype=np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["bits"])

    maps = keys.select(F.pmod(F.xxhash64("rec"), F.lit(bits)).cast("long")).mapInArrow(mark, "bits binary")
    n = maps.rdd.getNumPartitions()
    if n > 16:
        maps = maps.repartition(int(n**0.5)).mapInArrow(merge, "bits binary")
    return maps.repartition(1).mapInArrow(merge, "bits binary")


#: Most bits of the broadcast map (16 MB).
_MAP_BITS = 1 << 27


def _only_marked(rows: DataFrame, keys: DataFrame, n_keys: int) -> DataFrame:
    """Rows ``(rec, v)`` whose rec may be among the keys, picked before any shuffle by a broadcast map of 8 to 16 bits a key; all rows where that map would be larger than its bound."""
    bits = 1 << max(16, (8 * n_keys - 1).bit_length())
    if bits > _MAP_BITS:
        return rows.select("rec", "v")
    seen = rows.sparkSession.sparkContext.broadcast(bytes(_bitmap(keys, bits).head()[0]))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.frombuffer(seen.value, dtype=np.uint8)
        for b in batches:
            h = b.column(2).to_numpy(zero_copy_only=False)
            yield b.filter(pa.array((marks[h >> 3] >> (h & 7)) & 1 == 1)).select([0, 1])

    marked = rows.select("rec", "v", F.pmod(F.xxhash64("rec"), F.lit(bits)).cast("long").alias("h"))
    return marked.mapInArrow(pick, "rec string, v array<double>")


def top_by_cosine(pairs: DataFrame, vectors: DataFrame, dims: int, k: int, least: float) -> DataFrame:
    """Rank candidate pairs by their exact cosines."""
    ends = materialize(pairs.select(F.col("a").alias("rec")).union(pairs.select(F.col("b").alias("rec"))).distinct(), "ends")
    # Written before the join: Catalyst would move the semi join below the map, and so shuffle all vectors.
    marked = materialize(_only_marked(vectors.select(F.col("rec").cast("string").alias("rec"), F.col("v").cast("array<double>").alias("v")).filter(F.size("v") == dims), ends, max(1, ends.count())), "marked")
    full = materialize(marked.join(ends, "rec", "left_semi").groupBy("rec").agg(F.min("v").alias("v")), "exact")
    discard(marked)
    discard(ends)
    scored = pairs.join(full.select(F.col("rec").alias("a"), F.col("v").alias("va")), "a").join(full.select(F.col("rec").alias("b"), F.col("v").alias("vb")), "b").select("a", "b", "va", "vb").mapInArrow(_cosines, "a string, b string, cosine double")
    w = Window.partitionBy("a").orderBy(F.desc("cosine"), "b")
    return scored.withColumn("rank", F.row_number().over(w)).filter((F.col("rank") <= k) & (F.col("cosine") >= least)).select("a", "b", "rank", "cosine")


def close_pairs(graph: NeighbourGraph, k: int = 5, least: float = 0.9) -> DataFrame:
    """``(a, b)`` with a < b: one is among the other's k most similar and their cosine is at least ``least``."""
    n = graph.neighbours(k, least)
    return n.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
