"""Where stores and reads carry lineages' data, over accesses that fall into parts which no rule crosses.

A part's accesses and seeds meet in one task, sorted by part, so that a task holds one large part or a few small ones. It walks
all lineages of them at once, with a bit a lineage on every node, in slices of lineages that begin near each other. Nodes are the states and the regions
of stores and of reads: reads of the same region are one node, and a value that one read only gives and nothing stores is no node but follows its region. So
the nodes and edges grow with the accesses and with the regions that meet, not with stores times reads. States that the
same lineages reach leave as one row; rows of a lineage and a state are only made of these by the writer's own task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.operators.association import UNKNOWN, Flows

#: Entries for which small parts are walked together; bytes of the bits of a slice; rows of the result, and states, that one row of a walk stands for, about; pairs of regions compared at once.
CHUNK, BITS, BLOCK, STATES, PAIRS = 20_000, 1 << 24, 200_000, 20_000, 2_000_000
#: What an entry is.
WRITE, READ, VALUE, CONTENT = range(4)

_STATE = "content:boolean,part:string,function:string,atom:string,object:string,start:bigint,end:bigint"
_FOUND = f"level int, groups array<struct<ys:array<struct<{_STATE}>>,xs:array<string>>>"


def entries(flows: Flows, seeds: DataFrame) -> DataFrame:
    """(part, what, function, atom, object, start, end, may, lineage) of the writes and reads of flows and of seeds (lineage, state, function, atom, object); ids without their part."""
    accesses = flows.accesses
    if accesses is None:
        accesses = flows.writes.withColumn("edge_kind", F.lit("WRITE")).unionByName(flows.reads.withColumn("edge_kind", F.lit("READ")))
    what = F.when(F.col("edge_kind") == "WRITE", WRITE).otherwise(READ)
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    seeds = seeds.select(
        F.when(F.col("state") == "VALUE", VALUE).otherwise(CONTENT).alias("what"), "function", text("atom"), text("object"), F.lit(UNKNOWN).alias("start"), F.lit(UNKNOWN).alias("end"), F.lit(0).alias("may"), "lineage"
    )
    rows = accesses.select(what.alias("what"), "function", "atom", "object", "start", "end", "may", F.lit("").alias("lineage")).unionByName(seeds)
    rest = lambda c: F.expr(f"substring({c}, length(substring_index(function, '|', 1)) + 1)").alias(c)
    number = lambda c, kind: F.col(c).cast(kind).alias(c)
    return rows.select(F.substring_index("function", "|", 1).alias("part"), number("what", "byte"), rest("function"), "atom", rest("object"), number("start", "bigint"), number("end", "bigint"), number("may", "byte"), "lineage")


def _numbered(*columns: np.ndarray) -> np.ndarray:
    """Numbers for the distinct rows of columns, in their order."""
    out = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        distinct, c = np.unique(c, return_inverse=True)
        out = np.unique(out * max(1, len(distinct)) + c, return_inverse=True)[1]
    return out


def _meeting(of: np.ndarray, s: np.ndarray, e: np.ndarray, to: np.ndarray, t_s: np.ndarray, t_e: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of the regions [s, e) of objects `of` and [t_s, t_e) of objects `to` that share bytes, as positions."""
    if not len(of) or not len(to):
        return
    order = np.lexsort((t_s, to))
    to, t_s, t_e = to[order], t_s[order], t_e[order]
    longest = np.full(max(of.max(), to.max()) + 1, np.iinfo(np.int64).min)
    np.maximum.at(longest, to, t_e - t_s)
    some = np.flatnonzero(np.isin(of, to))
    of, s, e = of[some], s[some], e[some]
    bounds, at = np.unique(np.concatenate([t_s, s - longest[of], e]), return_inverse=True)
    at = at + np.concatenate([to, of, of]) * len(bounds)
    begin, low, high = np.split(at, np.cumsum([len(to), len(of)]))
    low, high = np.searchsorted(begin, low, "right"), np.searchsorted(begin, high, "left")
    n = np.maximum(high - low, 0)
    for b in np.split(np.arange(len(of)), np.flatnonzero(np.diff(np.cumsum(n) // PAIRS)) + 1):
        first = np.cumsum(n[b]) - n[b]
        left = np.repeat(b, n[b])
        right = np.arange(len(left)) + np.repeat(low[b] - first, n[b])
        shared = s[left] < t_e[right]
        yield some[left[shared]], order[right[shared]]


class _Graph:
    """The nodes and edges of a chunk of parts; states by what node they follow; starts by search, searches by part."""

    def __init__(self, chunk: pa.Table) -> None:
        column = lambda c: chunk[c].combine_chunks()
        number = lambda c: column(c).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = {c: column(c).dictionary_encode() for c in ("part", "function", "atom", "object", "lineage")}
        part, function, atom, object_, lineage = (c.indices.to_numpy().astype(np.int64) for c in coded.values())
        what, start, end, may = (number(c) for c in ("what", "start", "end", "may"))
        value = _numbered(part, function, atom)
        # stores of values that nothing reads or begins with are never reached
        kept = (what != WRITE) | np.isin(value, value[(what == READ) | (what == VALUE)])
        part, function, atom, object_, lineage, what, start, end, may, value = (c[kept] for c in (part, function, atom, object_, lineage, what, start, end, may, value))
        own, region = _numbered(part, object_), _numbered(part, object_, start, end)
        content = _numbered(part, function, atom, region)
        write, read, seed, held = (what == w for w in (WRITE, READ, VALUE, CONTENT))
        held = held | write

        # each value by each region it is read from, surely if any such read is
        r = np.flatnonzero(read)
        r = r[np.lexsort((may[r], value[r], region[r]))]
        r = r[np.concatenate([[True], (value[r][1:] != value[r][:-1]) | (region[r][1:] != region[r][:-1])])[: len(r)]]
        unknown = np.minimum(start, end) < 0
        times = np.bincount(value[r], minlength=value.max() + 1 if len(value) else 0)
        follows = (times[value[r]] == 1) & ~np.isin(value[r], value[write | seed]) & ((may[r] == 0) | unknown[r])

        self.size, self.part_of = 0, []

        def nodes(ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """(node of each id that occurs at a row of `at`, else -1; a row of each node)."""
            distinct, first = np.unique(ids[at], return_index=True)
            node = np.full(ids.max() + 1 if len(ids) else 0, -1)
            node[distinct] = self.size + np.arange(len(distinct))
            self.size += len(distinct)
            self.part_of.append(part[at[first]])
            return node, at[first]

        some = lambda mask: np.flatnonzero(mask)
        contents, content_rows = nodes(content, some(held))
        values, value_rows = nodes(value, np.concatenate([r[~follows], some(write | seed)]))
        sources, source_rows = nodes(region, some(held))
        targets, target_rows = nodes(region, r)
        # of an object: what its unknown regions lead to, and what leads to its unknown reads
        from_unknown, _ = nodes(own, some(held & unknown))
        to_unknown, _ = nodes(own, r[unknown[r]])
        self.part_of = np.concatenate(self.part_of)

        edges = [(values[value[write]], contents[content[write]], may[write]), (contents[content[content_rows]], sources[region[content_rows]], 0), (targets[region[r[~follows]]], values[value[r[~follows]]], may[r[~follows]])]
        vague, any_ = source_rows[unknown[source_rows]], target_rows[from_unknown[own[target_rows]] >= 0]
        edges += [(sources[region[vague]], from_unknown[own[vague]], 1), (from_unknown[own[any_]], targets[region[any_]], 0)]
        vague, any_ = target_rows[unknown[target_rows]], source_rows[to_unknown[own[source_rows]] >= 0]
        edges += [(sources[region[any_]], to_unknown[own[any_]], 1), (to_unknown[own[vague]], targets[region[vague]], 0)]
        s, t = source_rows[~unknown[source_rows]], target_rows[~unknown[target_rows]]
        edges += [(sources[region[s[a]]], targets[region[t[b]]], 0) for a, b in _meeting(own[s], start[s], end[s], own[t], start[t], end[t])]
        self.src, self.dst = (np.concatenate([e[n] for e in edges]) for n in (0, 1))
        self.paid = np.concatenate([np.broadcast_to(e[2], len(e[0])) for e in edges]) > 0

        rows = np.concatenate([content_rows, value_rows, r[follows]])
        self.follow = np.concatenate([contents[content[content_rows]], values[value[value_rows]], targets[region[r[follows]]]])
        none, valued = np.array(-1), np.arange(len(rows)) >= len(content_rows)
        text = lambda c, at: coded[c].dictionary.take(pa.array(at[rows]))
        self.states = [
            pa.array(~valued), text("part", part), text("function", function), text("atom", atom), pc.if_else(pa.array(valued), "", text("object", object_)),
            pa.array(np.where(valued, none, start[rows])), pa.array(np.where(valued, none, end[rows])),
        ]

        # searches of a part by the region that they begin with or first store to, so that a slice's share what they reach
        begun = some(seed | (what == CONTENT))
        node = np.where(seed[begun], values[value[begun]], contents[content[begun]])
        stored = np.full(value.max() + 1 if len(value) else 0, -1)
        stored[value[write]] = some(write)
        via = np.where(seed[begun], stored[value[begun]], begun)
        near, close = (np.where(via < 0, far, c[via]) for far, c in ((np.iinfo(np.int64).max, own), (node, region)))
        by = _numbered(part[begun], lineage[begun])
        order = np.lexsort((close, near, by))
        first = order[np.concatenate([[True], by[order][1:] != by[order][:-1]])[: len(order)]]
        ranked = np.lexsort((close[first], near[first], part[begun][first]))
        place = np.empty(len(first), np.int64)
        place[ranked] = np.arange(len(first))
        self.names = coded["lineage"].dictionary.take(pa.array(lineage[begun][first[ranked]]))
        self.first = np.zeros(part.max() + 1 if len(part) else 0, np.int64)
        counts = np.bincount(part[begun][first], minlength=len(self.first))
        self.first = np.cumsum(counts) - counts
        self.start, self.search = node, place[by] - self.first[part[begun]]


def _emitted(g: _Graph, low: int, level: int, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of _FOUND for a slice's bits; `low` is the slice's first search of each part."""
    on = bits.any(axis=1)
    states = np.flatnonzero(on[g.follow])
    if not len(states):
        return
    nodes, which = np.unique(g.follow[states], return_inverse=True)
    keyed = np.concatenate([g.part_of[nodes].astype(np.uint64)[:, None], bits[nodes]], axis=1)
    sets: dict[bytes, int] = {}
    of = np.array([sets.setdefault(row.tobytes(), len(sets)) for row in keyed])
    first = np.unique(of, return_index=True)[1]
    which = of[which]
    states = states[np.argsort(which, kind="stable")]
    members = np.bincount(which, minlength=len(first))
    ends = np.cumsum(members)
    per = np.zeros(len(first), np.int64)
    xs = []
    for n, node in enumerate(nodes[first]):
        x = np.flatnonzero(np.unpackbits(bits[node].view(np.uint8), bitorder="little")) + (g.first[g.part_of[node]] + low)
        per[n] = len(x)
        xs.append(x)
    # a set of searches and its states are cut into pieces of about BLOCK rows or STATES states, and pieces gathered to about as many
    most = np.clip(BLOCK // per, 1, STATES)
    pieces = -(-members // most)
    of = np.repeat(np.arange(len(first)), pieces)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = (ends - members)[of] + nth * most[of]
    end = np.minimum(begin + most[of], ends[of])
    block = np.cumsum((end - begin) * per[of]) // BLOCK + np.cumsum(end - begin) // STATES
    for b in np.split(np.arange(len(of)), np.flatnonzero(np.diff(block)) + 1):
        at = pa.array(states[begin[b[0]] : end[b[-1]]])
        ys = pa.StructArray.from_arrays([c.take(at) for c in g.states], [c.split(":")[0] for c in _STATE.split(",")])
        taken = [xs[n] for n in of[b]]
        offsets = lambda n: pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
        groups = pa.StructArray.from_arrays(
            [pa.ListArray.from_arrays(offsets(end[b] - begin[b]), ys), pa.ListArray.from_arrays(offsets([len(x) for x in taken]), g.names.take(pa.array(np.concatenate(taken))))], ["ys", "xs"]
        )
        yield pa.RecordBatch.from_arrays([pa.array([level], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(groups)], pa.int32()), groups)], names=["level", "groups"])


class _Steps:
    """Edges by where they lead from; a step takes the bits of some nodes along them, as (nodes, bits)."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, nodes: int) -> None:
        order = np.argsort(src, kind="stable")
        self.dst, self.first = dst[order], np.searchsorted(src[order], np.arange(nodes + 1))

    def __call__(self, at: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.first[at + 1] - self.first[at]
        left = np.repeat(np.arange(len(at)), n)
        dst = self.dst[np.arange(len(left)) + np.repeat(self.first[at] - (np.cumsum(n) - n), n)]
        if not len(dst):
            return dst, bits[:0]
        order = np.argsort(dst, kind="stable")
        dst = dst[order]
        firsts = np.flatnonzero(np.concatenate([[True], dst[1:] != dst[:-1]]))
        return dst[firsts], np.bitwise_or.reduceat(bits[left[order]], firsts, axis=0)


def _walk(chunk: pa.Table) -> Iterator[pa.RecordBatch]:
    g = _Graph(chunk)
    if not len(g.start):
        return
    steps = [_Steps(g.src[e], g.dst[e], g.size) for e in (~g.paid, np.full(len(g.paid), True))]
    wide = max(1, BITS // (8 * g.size)) * 64
    for low in range(0, int(g.search.max()) + 1, wide):
        here = (g.search >= low) & (g.search < low + wide)
        at, k = g.start[here], g.search[here] - low
        if not len(k):
            continue
        bits = np.zeros((g.size, -(-(int(k.max()) + 1) // 64) * 8), np.uint8)
        np.bitwise_or.at(bits, (at, k // 8), (1 << (k % 8)).astype(np.uint8))
        seen = bits.view(np.uint64)
        for level, step in enumerate(steps):
            before = seen.copy()
            at = np.flatnonzero(seen.any(axis=1))
            front = seen[at]
            while len(at):
                at, front = step(at, front)
                front = front & ~seen[at]
                new = front.any(axis=1)
                at, front = at[new], front[new]
                seen[at] |= front
            yield from _emitted(g, low, level, seen & ~before if level else seen)


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of entries sorted by part: whole parts are walked together until they are CHUNK entries."""
    held: list[pa.RecordBatch] = []
    size, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        p = batch.column(0)
        if size + len(p) >= CHUNK:
            new = np.flatnonzero(pc.not_equal(p[1:], p[:-1]).to_numpy(zero_copy_only=False)) + 1
            cut = int(new[-1]) if len(new) else 0
            if held and (cut or p[0].as_py() != last):
                yield from _walk(pa.Table.from_batches([*held, batch[:cut]]))
                held, size, batch = [], 0, batch[cut:]
            elif cut:
                yield from _walk(pa.Table.from_batches([batch[:cut]]))
                batch = batch[cut:]
        held.append(batch)
        size += batch.num_rows
        last = p[len(p) - 1].as_py()
    if held:
        yield from _walk(pa.Table.from_batches(held))


def carried(held: DataFrame) -> DataFrame:
    """(lineage, state, function, atom, object, start, end, may) of entries' rows: every state that a lineage reaches, with the least of the ways' worst precision."""
    spark = held.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = held.repartition("part").sortWithinPartitions("part").mapInArrow(_walked, _FOUND).repartition(tasks)
    each = found.select("level", F.explode("groups").alias("g")).select("level", F.col("g.xs").alias("xs"), F.explode("g.ys").alias("y"))
    whole = lambda c: F.concat("y.part", f"y.{c}").alias(c)
    content = F.col("y.content")
    states = each.select("level", "xs", F.when(content, "MEMORY_CONTENT").otherwise("VALUE").alias("state"), whole("function"), "y.atom", F.when(content, whole("object")).otherwise("").alias("object"), "y.start", "y.end")
    return states.select(F.explode("xs").alias("lineage"), "state", "function", "atom", "object", "start", "end", F.col("level").alias("may"))
