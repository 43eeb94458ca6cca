"""Splitting oversized bodies at natural boundaries (problem 4).

Dynamic programming over boundary positions: the cost of a cut at a boundary is a penalty by its kind, the
cost of a piece its squared deviation from the even size, and the pieces are at most `limit` characters
and share exactly `overlap`. Where a stretch has no boundary within reach, the ends of its blanks are offered, too, and
where it has no blanks either, places all over it, among them those of even pieces. They are taken only by a piece that
can reach no end of a line, statement or block; never between CR and LF or within a
character of several code points, unless one is as long as a piece. So the program always has a choice.
It is linear in the boundaries, with as many predecessors each as lie within one limit, so a
very long body costs its length. Bodies are independent: no shuffle, and those within the limit never
leave the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.llm.common import batches

LIMIT = 3_600
OVERLAP = 200

#: Penalties of a cut at the end of a block, statement or other line; at a brace or semicolon within a
#: line; after blanks; elsewhere; and within a character, which is cut only where it is as long as a piece.
PENALTY = {"block": 0.0, "statement": 0.25, "line": 0.6, "brace": 1.0, "semicolon": 1.25, "blank": 4.0, "hard": 50.0, "split": 500.0, "end": 0.0}
#: The kinds that are offered only where nothing else is within reach.
MADE = ("blank", "hard", "split")
#: Weight of a piece's squared relative deviation from the even size, and the cost of one more piece.
IMBALANCE, PIECE = 2.0, 1.0
#: Characters to one place that is offered where a stretch has no boundary, and that a character is looked for around a place.
GRID, WINDOW = 16, 64

_BREAK = re.compile(r"\r\n|\n|\r")
_INNER = re.compile(r"[};]")
_BLANK = re.compile(r"[^\S\r\n]+")
_CHARACTER = regex.compile(r"\X")
_KINDS = list(PENALTY)


def _between_characters(text: str, place: int) -> int | None:
    """The last place at or before this one that parts no character; None if there is none near it."""
    beside = text[place - 1 : place + 1]
    if beside.isascii() and beside != "\r\n":
        return place
    low = max(0, place - WINDOW)
    found = None
    for m in _CHARACTER.finditer(text, low, min(len(text), place + WINDOW)):
        if m.end() > place:
            return m.start() if m.start() > low else found
        found = m.end()
    return found


def _stretches(places: list[int], length: int, limit: int, overlap: int) -> Iterator[tuple[int, int]]:
    """(start, end) of the stretches between places that no piece can span; the first piece has nothing before it."""
    last = 0
    for b in [*places, length]:
        if b - last > (limit if last == 0 else limit - overlap):
            yield last, b
        last = b


def boundaries(text: str, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, kinds) where a piece may end, in order, the text's end last; kinds index PENALTY."""
    length = len(text)
    at: dict[int, str] = {}
    for m in _INNER.finditer(text):
        at[m.end()] = "brace" if m[0] == "}" else "semicolon"
    for m in _BREAK.finditer(text):
        line = text[max(0, m.start() - 200) : m.start()].rstrip(" \t")
        at[m.end()] = "block" if line.endswith("}") else "statement" if line.endswith(";") else "line"
    at.pop(length, None)
    grid = max(1, min(GRID, (limit - overlap) // 8))
    for start, end in list(_stretches(sorted(at), length, limit, overlap)):
        last = -1
        for m in _BLANK.finditer(text, start, end):
            # the last of each few characters is enough
            if m.end() // grid == last // grid and at.get(last) == "blank":
                del at[last]
            last = m.end()
            at.setdefault(last, "blank")
    at.pop(length, None)
    for start, end in list(_stretches(sorted(at), length, limit, overlap)):
        first = overlap if start == 0 else start
        count = -(-(end - first) // (limit - overlap))
        even = [first + round((end - first) * i / count) for i in range(1, count)]
        for place in [*range(start + grid, end, grid), *even, first + limit - overlap]:
            whole = _between_characters(text, place)
            if whole is not None and start < whole < end:
                at.setdefault(whole, "hard")
    for start, end in list(_stretches(sorted(at), length, limit, overlap)):
        first = overlap if start == 0 else start
        for place in range(first + limit - overlap, end, limit - overlap):
            at.setdefault(place, "split")
    at[length] = "end"
    places = sorted(p for p in at if p > overlap or p == length)
    return np.array(places), np.array([_KINDS.index(at[p]) for p in places])


def cut(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, str]]:
    """(start, end, kind of the cut at its end) of each piece of text, in order."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be less than the limit")
    length = len(text)
    if length <= limit:
        return [(0, length, "end")] if length else []
    places, kinds = boundaries(text, limit, overlap)
    count = -(-(length - overlap) // (limit - overlap))
    even = (length + (count - 1) * overlap) / count
    penalty = np.array(list(PENALTY.values()))[kinds]
    best, back = np.full(len(places), np.inf), np.full(len(places), -1)
    first = np.searchsorted(places, places - (limit - overlap), "left")
    # a piece may end within a line only where it can reach no end of a line, statement or block
    made = np.isin(kinds, [_KINDS.index(k) for k in MADE])
    natural = np.append(places[~made], length + limit)
    bare = np.where(natural[np.searchsorted(natural, places, "right")] - places > limit - overlap, 0.0, np.inf)
    bare_start = natural[0] > limit
    for j, end in enumerate(places):
        cost = ((end - even) / even) ** 2 * IMBALANCE if end <= limit and (bare_start or not made[j]) else np.inf
        i = first[j]
        if i < j:
            before = best[i:j] + IMBALANCE * ((end - places[i:j] + overlap - even) / even) ** 2
            if made[j]:
                before = before + bare[i:j]
            k = int(before.argmin())
            if before[k] < cost:
                cost, back[j] = before[k], i + k
        best[j] = cost + penalty[j] + PIECE
    out, j = [], len(places) - 1
    while j >= 0:
        i = back[j]
        out.append((int(places[i]) - overlap if i >= 0 else 0, int(places[j]), _KINDS[kinds[j]]))
        j = i
    return out[::-1]


def _cutter(limit: int, overlap: int, with_text: bool):
    schema = pa.schema([("row_id", pa.int64()), ("piece_no", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("cut_at", pa.string()), ("piece", pa.string())])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in source:
                for row_id, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                    text = body.as_py()
                    for n, (start, end, kind) in enumerate(cut(text, limit, overlap)):
                        yield row_id, n, start, end, kind, text[start:end] if with_text else None

        return batches(rows(), schema, 2_000)

    return run


def pieces(df: DataFrame, id_col: str, body_col: str, limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = True) -> DataFrame:
    """Pieces of every body: (row_id, piece_no from 0, start, end, cut_at, piece).

    Lengths and positions are in code points. A body within the limit is one piece; NULL and empty bodies
    have none; blanks are characters like others. Pieces of a longer body are at most `limit` long, each
    starts `overlap` before the end of the one before, and the text is their sum. Ties go to the earlier
    boundary. Repeated rows give repeated pieces; an empty table an empty one; other columns are not looked at.
    """
    slim = df.select(F.col(id_col).cast("bigint").alias("row_id"), F.col(body_col).cast("string").alias("body"))
    shape = "row_id bigint, piece_no int, start bigint, end bigint, cut_at string, piece string"
    long = slim.filter(F.length("body") > limit).mapInArrow(_cutter(limit, overlap, with_text), shape)
    whole = slim.filter((F.length("body") <= limit) & (F.length("body") > 0)).select(
        "row_id", F.lit(0).alias("piece_no"), F.lit(0).cast("bigint").alias("start"), F.length("body").cast("bigint").alias("end"), F.lit("end").alias("cut_at"),
        (F.col("body") if with_text else F.lit(None).cast("string")).alias("piece"),
    )
    return long.unionByName(whole)


def invariants(df: DataFrame, cut: DataFrame, id_col: str, body_col: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """What the pieces of each body with a text keep: (row_id, within_limit, overlaps, whole, cut).

    within_limit: no piece is over the limit; overlaps: each starts with the last `overlap` characters of the one
    before; whole: the first and what the others add are the body; cut: there is more than one. Ids must be unique.
    """
    held = cut.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("piece_no", "piece"))).getField("piece").alias("p"))
    rest = F.slice("p", 2, F.greatest(F.lit(0), F.size("p") - 1))
    both = df.select(F.col(id_col).cast("bigint").alias("row_id"), F.col(body_col).cast("string").alias("body")).filter(F.length("body") > 0).join(held, "row_id", "left")
    return both.select(
        "row_id", F.forall("p", lambda x: F.length(x) <= limit).alias("within_limit"),
        F.forall(F.sequence(F.lit(1), F.size("p")), lambda i: (i == 1) | (F.right(F.element_at("p", F.greatest(i - 1, F.lit(1))), F.lit(overlap)) == F.substring(F.element_at("p", i), 1, overlap))).alias("overlaps"),
        (F.concat(F.element_at("p", 1), F.array_join(F.transform(rest, lambda x: F.substring(x, overlap + 1, limit)), "")) == F.col("body")).alias("whole"),
        (F.size("p") > 1).alias("cut"),
    )
