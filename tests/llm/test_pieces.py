import random
import re

import pytest

from factweave.llm import pieces

SHAPE = "fid bigint, body string, piece string, start int"


def check(text, limit, overlap):
    out = pieces.cut(text, limit, overlap)
    assert out[0][0] == 0 and out[-1][1] == len(text)
    for start, end, _ in out:
        assert 0 < end - start <= limit
    for (_, e, _), (s, e2, _) in zip(out, out[1:]):
        assert s == e - overlap and e2 > e
    ends = set(pieces.boundaries(text, limit, overlap)[0].tolist())
    natural = {m.end() for m in re.finditer(r"\r\n|[\n\r;}]", text)}
    last = 0
    for start, end, kind in out[:-1]:
        reach = {n for n in natural if last < n <= start + limit and n > overlap}
        assert kind != "hard" or not reach, "a cut inside a line, though something natural was in reach"
        last = end
    return out, ends


@pytest.mark.parametrize("seed", range(30))
def test_invariants_on_random_text(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(["x", "y ", ";", "}", "\n", "\r\n", "\r", "é", "👩", "abcdefgh" * rng.randint(1, 9)]) for _ in range(rng.randint(60, 400)))
    limit = rng.choice([40, 90])
    overlap = rng.choice([0, 7, 20])
    if len(text) > limit:
        check(text, limit, overlap)


def test_least_cost_against_all_cuts():
    rng = random.Random(4)
    for _ in range(25):
        text = "".join(rng.choice("ab;}\n") for _ in range(rng.randint(25, 34)))
        limit, overlap = 12, 3
        places, kinds = pieces.boundaries(text, limit, overlap)
        names = list(pieces.PENALTY)
        count = -(-(len(text) - overlap) // (limit - overlap))
        even = (len(text) + (count - 1) * overlap) / count
        price = {int(p): pieces.PENALTY[names[k]] for p, k in zip(places, kinds)}

        def best(start, at):
            """The least cost of cutting what follows a piece that starts at start, whose end is after at."""
            costs = []
            for p in price:
                if p > at and p - start <= limit:
                    own = price[p] + pieces.PIECE + pieces.IMBALANCE * ((p - start - even) / even) ** 2
                    costs.append(own if p == len(text) else own + best(p - overlap, p))
            return min(costs, default=float("inf"))

        got = sum(price[e] + pieces.PIECE + pieces.IMBALANCE * ((e - s - even) / even) ** 2 for s, e, _ in pieces.cut(text, limit, overlap))
        assert got == pytest.approx(best(0, 0))


def test_prefers_blocks_and_cuts_long_lines_hard():
    line = "  x = y;\n"
    text = "{\n" + line * 30 + "}\n" + line * 30
    assert pieces.cut(text, 400, 20)[0][1:] == (len("{\n" + line * 30 + "}\n"), "block")
    assert {k for _, _, k in pieces.cut("z" * 1000, 300, 50)} == {"hard", "end"}


def test_operator_on_dirty_rows(spark):
    long = "int f();\n" * 1000
    rows = [(1, None), (2, ""), (3, "short"), (4, "x" * 3600), (5, "x" * 3601), (6, long), (6, long), (None, "é" * 3700), (7, " \n" * 1801)]
    df = spark.createDataFrame([(a, b, "c", 1) for a, b in rows], SHAPE)
    out = pieces.pieces(df, "fid", "body").collect()
    per = {}
    for r in out:
        per.setdefault(r.row_id, []).append(r)
    assert 1 not in per and 2 not in per and [len(per[i]) for i in (3, 4, 5)] == [1, 1, 2]
    assert len(per[6]) == 2 * len(pieces.cut(long)) and len(per[None]) == 2 and len(per[7]) == 2
    assert all(len(r.piece) == r.end - r.start <= 3600 for r in out)
    assert pieces.pieces(df.filter("false"), "fid", "body").count() == 0


def test_a_very_long_body_takes_linear_time():
    text = "".join(f"  value_{i} = other_{i};\n" for i in range(100_000))
    assert len(pieces.cut(text)) == pytest.approx(len(text) / 3400, rel=0.1)


def test_an_overlap_must_be_under_the_limit():
    with pytest.raises(ValueError):
        pieces.cut("abc" * 10, 5, 5)


def test_places_within_a_line_are_even_and_part_no_character(spark):
    text = "a" * 3599 + "\r\n" + "b" * 5000
    out = pieces.cut(text)
    assert [(e - s, k) for s, e, k in out] == [(1900, "hard"), (1901, "line"), (2700, "hard"), (2700, "end")]
    assert [e - s for s, e, _ in pieces.cut("a" * 8601)] == [3000, 3001, 3000]
    family = "\U0001f469\u200d\U0001f469\u200d\U0001f467"
    for unit in ("e\u0301", family, "\r\n", "\U0001f1e9\U0001f1ea"):
        text = "x" + unit * 3000
        starts = {1 + len(unit) * i for i in range(3001)} | {0}
        assert {e for _, e, _ in pieces.cut(text)} <= starts
    # a character longer than a piece
    assert {k for _, _, k in pieces.cut("e" + "\u0301" * 9000)} == {"split", "end"}


def test_blanks_come_before_other_places():
    text = "word " * 3000
    out = pieces.cut(text)
    assert {k for _, _, k in out} == {"blank", "end"} and all(text[e - 1] == " " for _, e, _ in out)


def test_long_lines_take_linear_time():
    assert len(pieces.cut("z" * 1_000_000)) == 295
    assert len(pieces.cut("word " * 200_000)) == 295


def test_invariants_of_pieces(spark):
    rows = [(1, None), (2, ""), (3, "short"), (5, "x" * 3601), (6, "int f();\n" * 1000), (7, "\U0001f469\u200d" * 2500)]
    df = spark.createDataFrame(rows, "fid bigint, body string")
    out = pieces.invariants(df, pieces.pieces(df, "fid", "body"), "fid", "body").collect()
    assert sorted((r.row_id, r.cut) for r in out) == [(3, False), (5, True), (6, True), (7, True)]
    assert all(r.within_limit and r.overlaps and r.whole for r in out)
    short = pieces.pieces(df, "fid", "body").withColumn("piece", __import__("pyspark").sql.functions.expr("left(piece, 3599)"))
    assert not all(r.whole for r in pieces.invariants(df, short, "fid", "body").collect())
