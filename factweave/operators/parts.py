"""Searches from every node of a graph that falls into parts which no edge crosses.

A part's edges are numbered once and handed, with a slice of its searches each, to as many tasks as its result needs. A task walks
all searches of its slice at once, with a bit a search on every node, so a round costs one pass over the edges and not over the states.
Nodes that the same searches reach leave the walk as one row; rows of a search and a node are only made of these by the writer's
own task, so the states are neither shuffled nor checkpointed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.session import checkpoint

#: Edges, starts and sources of a part that one task takes; larger parts are walked in rounds of joins.
MOST = 2_000_000
#: Searches of a slice; rows of the result that one row of a walk stands for, about; rows of the result for one task, about.
SLICE, BLOCK, TASK = 512, 50_000, 3_000_000
#: What an entry is.
FREE, PAID, START, SOURCE = range(4)

_SLICES = "part string, nodes array<string>, src binary, dst binary, what binary, starts binary, searches array<string>, sources array<string>, work bigint"
_FOUND = "searches array<string>, level int, groups array<struct<ys:array<struct<a:string,b:string,c:string>>,xs:array<smallint>>>"


def entries(edges: DataFrame, starts: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """edges: src, dst, cost (0 or 1); starts: search, node; sources: value, source. (part, a, b, what) with nodes as part|rest: no edge may lead from one part to another."""
    part = lambda c: F.substring_index(c, "|", 1)
    rest = lambda c: F.expr(f"substring({c}, length(substring_index({c}, '|', 1)) + 1)")
    e = edges.select(part("src").alias("part"), rest("src").alias("a"), rest("dst").alias("b"), F.when(F.col("cost") > 0, PAID).otherwise(FREE).alias("what"))
    s = starts.select(part("node").alias("part"), rest("node").alias("a"), F.col("search").alias("b"), F.lit(START).alias("what"))
    parts = e.distinct().unionByName(s.distinct())
    if sources is not None:
        parts = parts.unionByName(sources.select(part("value").alias("part"), rest("value").alias("a"), F.col("source").alias("b"), F.lit(SOURCE).alias("what")))
    return checkpoint(parts)


def fit(held: DataFrame) -> bool:
    """Whether every part is small enough for one task."""
    return (held.groupBy("part").count().agg(F.max("count")).first()[0] or 0) <= MOST


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per slice of a part's searches, with the part's numbered graph."""
    for batch in batches:
        for part, held in zip(batch.column(0), batch.column(1)):
            e = held.values
            a, b, what = (e.field(n) for n in range(3))
            what = np.asarray(what.to_numpy(zero_copy_only=False), np.uint8)
            edge, start, source = what <= PAID, what == START, what == SOURCE
            first = a.filter(pa.array(edge | start))
            coded = pa.concat_arrays([first, b.filter(pa.array(edge))]).dictionary_encode()
            at, names = coded.indices.to_numpy().astype(np.int32), coded.dictionary.to_pylist()
            left, right = at[: len(first)], at[len(first) :]
            own = what[edge | start]
            named = b.filter(pa.array(start)).dictionary_encode()
            begun, by = left[own == START], named.indices.to_numpy().astype(np.int32)
            src, dst, kind = left[own != START], right, own[own != START]
            marked = dict(zip(a.filter(pa.array(source)).to_pylist(), b.filter(pa.array(source)).to_pylist()))
            nodes = [part.as_py() + n for n in names]
            sources = [marked.get(n) for n in names]
            for n in range(0, len(named.dictionary), SLICE):
                searches, here = named.dictionary[n : n + SLICE].to_pylist(), (by >= n) & (by < n + SLICE)
                starts = np.stack([begun[here], by[here] - n]).astype(np.int32)
                row = {"part": part.as_py(), "nodes": nodes, "src": src.tobytes(), "dst": dst.tobytes(), "what": kind.tobytes(), "starts": starts.tobytes(), "searches": searches, "sources": sources, "work": len(searches) * len(nodes)}
                kinds = [pa.string(), pa.list_(pa.string()), *[pa.binary()] * 4, *[pa.list_(pa.string())] * 2, pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), kinds)], names=list(row))


class _Steps:
    """Edges by where they lead to; a step takes the searches' bits of nodes along them."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, nodes: int) -> None:
        order = np.argsort(dst, kind="stable")
        self.src, self.dst, self.nodes = src[order], dst[order], nodes

    def __call__(self, bits: np.ndarray) -> np.ndarray:
        out = np.zeros_like(bits)
        live = np.flatnonzero(bits.any(axis=1)[self.src])
        if len(live):
            dst = self.dst[live]
            firsts = np.flatnonzero(np.concatenate([[True], dst[1:] != dst[:-1]]))
            out[dst[firsts]] = np.bitwise_or.reduceat(bits[self.src[live]], firsts, axis=0)
        return out


def _rows(searches: pa.Array, level: int, bits: np.ndarray, ys: Callable[[np.ndarray], pa.StructArray]) -> Iterator[pa.RecordBatch]:
    """Rows of _FOUND for bits, a row of words each y; ys gives the structs of numbered ys."""
    held = np.flatnonzero(bits.any(axis=1))
    if not len(held):
        return
    view = np.ascontiguousarray(bits[held]).view([("", bits.dtype)] * bits.shape[1]).ravel()
    distinct, which = np.unique(view, return_inverse=True)
    which = which.ravel()
    held = held[np.argsort(which, kind="stable")]
    members = np.bincount(which, minlength=len(distinct))
    words = distinct.view(bits.dtype).reshape(len(distinct), -1)
    on = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little")
    per = on.sum(axis=1, dtype=np.int64)
    xs = np.nonzero(on)[1].astype(np.int16)
    # a set of searches and its ys are cut into pieces of about BLOCK rows, and pieces gathered to about as many
    most = np.maximum(1, BLOCK // per)
    pieces = -(-members // most)
    of = np.repeat(np.arange(len(distinct)), pieces)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    low = (np.cumsum(members) - members)[of] + nth * most[of]
    high = np.minimum(low + most[of], np.cumsum(members)[of])
    block = np.cumsum((high - low) * per[of]) // BLOCK
    starts_x = np.cumsum(per) - per
    for b in np.split(np.arange(len(of)), np.flatnonzero(np.diff(block)) + 1):
        n = per[of[b]]
        x_at = np.concatenate([[0], np.cumsum(n)])
        taken = np.repeat(starts_x[of[b]] - x_at[:-1], n) + np.arange(x_at[-1])
        y_at = np.concatenate([[0], np.cumsum(high[b] - low[b])])
        groups = pa.StructArray.from_arrays(
            [pa.ListArray.from_arrays(pa.array(y_at, pa.int32()), ys(held[low[b[0]] : high[b[-1]]])), pa.ListArray.from_arrays(pa.array(x_at, pa.int32()), pa.array(xs[taken]))], ["ys", "xs"]
        )
        one = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)
        yield pa.RecordBatch.from_arrays([one(searches), pa.array([level], pa.int32()), one(groups)], names=["searches", "level", "groups"])


def _walker(mode: str, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                cell = lambda n: batch.column(n)[row]  # noqa: E731, B023
                nodes, searches, sources = (cell(n).values for n in (1, 6, 7))
                src, dst, starts = (np.frombuffer(cell(n).as_py(), np.int32) for n in (2, 3, 5))
                what = np.frombuffer(cell(4).as_py(), np.uint8)
                at, k = starts.reshape(2, -1)
                bits = np.zeros((len(nodes), -(-len(searches) // 64) * 8), np.uint8)
                np.bitwise_or.at(bits, (at, k // 8), (1 << (k % 8)).astype(np.uint8))
                yield from _MODES[mode](nodes, sources, src, dst, what, bits.view(np.uint64), searches, most)

    return walk


def _structs(*columns: pa.Array) -> Callable[[np.ndarray], pa.StructArray]:
    def ys(at: np.ndarray) -> pa.StructArray:
        taken = [c.take(pa.array(at)) for c in columns]
        taken += [pa.nulls(len(at), pa.string())] * (3 - len(taken))
        return pa.StructArray.from_arrays(taken, ["a", "b", "c"])

    return ys


def _levels(src: np.ndarray, dst: np.ndarray, what: np.ndarray, new: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """(level, bits that are new on it), against the edges, by their cost."""
    free, paid = (_Steps(dst[what == w], src[what == w], len(new)) for w in (FREE, PAID))
    seen = np.zeros_like(new)
    for level in range(most + 1):
        front = here = new
        while front.any():
            seen = seen | front
            front = free(front) & ~seen
            here = here | front
        yield level, here
        new = paid(here) & ~seen
        if not new.any():
            return


def _hops(nodes, sources, src, dst, what, bits, searches, most):
    for level, new in _levels(src, dst, what, bits, most):
        yield from _rows(searches, level, new, _structs(nodes))


def _edges(nodes, sources, src, dst, what, bits, searches, most):
    reached = np.zeros_like(bits)
    for _, new in _levels(src, dst, what, bits, most):
        reached = reached | new
    yield from _rows(searches, 0, reached[dst], _structs(nodes.take(pa.array(src)), nodes.take(pa.array(dst)), pa.array(what.astype(str))))


def _forward(nodes, sources, src, dst, what, bits, searches, most):
    step, seen, front = _Steps(src, dst, len(nodes)), bits, bits
    while front.any():
        front = step(front) & ~seen
        seen = seen | front
    yield from _rows(searches, 0, seen, _structs(nodes))


def _backward(nodes, sources, src, dst, what, bits, searches, most):
    """Paths by level, with their source; blockers with the reason as second."""
    named = sources.is_valid().to_numpy(zero_copy_only=False)
    leaf = pc.starts_with(nodes, "const:").to_numpy(zero_copy_only=False)
    known = np.isin(np.arange(len(nodes)), dst)
    step = _Steps(dst, src, len(nodes))
    on = lambda bits, mask: np.where(mask[:, None], bits, np.uint64(0))
    reason = lambda r: _structs(nodes, pa.array([None] * len(nodes), pa.string()), pa.array([r] * len(nodes), pa.string()))
    seen, front = bits, bits
    for level in range(most):
        yield from _rows(searches, level, on(front, named), _structs(nodes, sources))
        yield from _rows(searches, level, on(front, ~named & ~leaf & ~known), reason("unmodeled_origin"))
        front = step(on(front, ~named & ~leaf & known)) & ~seen
        if not front.any():
            return
        seen = seen | front
    yield from _rows(searches, most, front, reason("search_budget_exhausted"))


_MODES = {"hops": _hops, "edges": _edges, "forward": _forward, "backward": _backward}


def walked(held: DataFrame, mode: str, most: int = 0) -> DataFrame:
    """(search, level, a, b, c) of all searches of entries' rows.

    hops: each node (a) that leads to the search's start, with the least cost (level), at most `most`; edges: each edge (a, b, c: its
    cost) into such a node; forward: each node (a) reachable from the start; backward: as graph.backward_search, within
    `most` levels, paths by value (a) and source (b), and blockers by value (a) and reason (c).
    """
    packed = held.groupBy("part").agg(F.collect_list(F.struct("a", "b", "what")).alias("held"))
    slices = checkpoint(packed.mapInArrow(_numbered, _SLICES))
    tasks = max(2 * held.sparkSession.sparkContext.defaultParallelism, (slices.agg(F.sum("work")).first()[0] or 0) // TASK)
    found = slices.repartition(min(tasks, 10_000), "part", F.xxhash64("starts")).mapInArrow(_walker(mode, most), _FOUND)
    each = found.select("searches", "level", F.explode("groups").alias("g")).select("searches", "level", F.col("g.xs").alias("xs"), F.explode("g.ys").alias("y"))
    return each.select("searches", "level", "y", F.explode("xs").alias("x")).select(F.get("searches", F.col("x")).alias("search"), "level", "y.a", "y.b", "y.c")
