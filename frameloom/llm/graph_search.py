"""Greedy walks of a neighbour graph for queries that need not be in it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frameloom.llm.nndescent import GraphOptions, NeighbourGraph, _bytes_of, _id_of, _mix, _Pivots, _unit, top_by_cosine, usable
from frameloom.session import cut, discard, materialize


def _neighbours(o: GraphOptions):
    """The entries of the lists: (id, nb)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                e = _bytes_of(b.column("list"), np.int64, o.keep)
                ids = np.repeat(b.column("id").to_numpy(), o.keep)
                yield pa.RecordBatch.from_arrays([pa.array(ids[e.ravel() > 0]), pa.array(_id_of(e[e > 0]))], names=["id", "nb"])

    return run


def _score(o: GraphOptions):
    """Cosine of each query with a candidate: (q, id, sim)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (_unit(_bytes_of(b.column(c), np.int8, o.dims)) for c in ("qv", "q"))
                yield pa.RecordBatch.from_arrays([b.column("query"), b.column("id"), pa.array((x * y).sum(1))], names=["query", "id", "sim"])

    return run


def greedy_search(graph: NeighbourGraph, queries: DataFrame, k: int = 5, *, beam: int = 256, steps: int = 12, entries: int = 64) -> DataFrame:
    """``(a, b, rank, cosine)``: the k nearest records of each query ``(rec, v)``, by walking the graph.

    Every query enters at ``entries`` members of each of the cells of its
    nearest pivots. In each step the neighbours of those records that are new
    among its ``beam`` best are compared with it, until no record is or
    ``steps`` are done. What a step adds is bounded by the beam and the lists,
    so it is a few joins of queries x beam rows. A query never finds itself by
    name.
    """
    o = graph.options
    if not graph.n:
        return graph.vectors.sparkSession.createDataFrame([], "a string, b string, rank int, cosine double")
    asked = materialize(usable(queries, o.dims).select(F.col("rec").alias("query"), F.col("q").alias("qv")), "queries")
    pivots = graph.pivots

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = None
        for b in batches:
            if b.num_rows:
                p = p or _Pivots(*pivots.value)
                near = p.nearest(_unit(_bytes_of(b.column("qv"), np.int8, o.dims)), o.cells)
                row = np.nonzero(near >= 0)[0]
                yield pa.RecordBatch.from_arrays([b.column("query").take(pa.array(row)), pa.array(near[near >= 0])], names=["query", "cell"])

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                near = _bytes_of(b.column("cells"), np.int32, o.cells)
                row = np.nonzero(near >= 0)[0]
                ids = b.column("id").to_numpy()[row]
                h = _mix(ids + o.seed)
                yield pa.RecordBatch.from_arrays([pa.array(near[near >= 0]), pa.array(ids), pa.array((h % np.uint64(entries)).astype(np.int32)), pa.array((h >> np.uint64(8)).astype(np.int64))], names=["cell", "id", "slot", "h"])

    # Of each cell one member of each slot, the one with the least hash.
    doors = graph.nodes.select("id", "cells").mapInArrow(members, "cell int, id bigint, slot int, h bigint").groupBy("cell", "slot").agg(F.min(F.struct("h", "id")).alias("m")).select("cell", "m.id")
    reach = asked.mapInArrow(cells, "query string, cell int").join(doors, "cell").select("query", "id").distinct()
    best = None
    edges = graph.lists.mapInArrow(_neighbours(o), "id bigint, nb bigint")
    top = Window.partitionBy("query").orderBy(F.desc("sim"), "id")
    for _ in range(steps + 1):
        new = reach.join(graph.nodes.select("id", "q", "rec"), "id").join(asked, "query").filter("rec <> query").select("query", "qv", "id", "q").mapInArrow(_score(o), "query string, id bigint, sim float").withColumn("fresh", F.lit(True))
        both = new if best is None else best.withColumn("fresh", F.lit(False)).unionByName(new)
        before, best = best, materialize(both.withColumn("r", F.row_number().over(top)).filter(F.col("r") <= beam).drop("r"), "beam")
        if before is not None:
            discard(before)
        # Only records that are new to the beam are left through their edges.
        going = best.filter("fresh")
        if going.isEmpty():
            break
        reach = going.join(edges, "id").select("query", F.col("nb").alias("id")).distinct().join(best.select("query", "id"), ["query", "id"], "left_anti")
        best = best.drop("fresh")
    found = best.join(graph.nodes.select("id", F.col("rec").alias("b")), "id").select(F.col("query").alias("a"), "b")
    both = graph.vectors.select("rec", "v").unionByName(queries.select("rec", "v"))
    return top_by_cosine(cut(found), both, o.dims, k, -2.0)
