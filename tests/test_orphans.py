import datetime as dt
import random

from factweave.operators.orphans import Reference, orphan_report, orphans

T = lambda n: None if n is None else dt.datetime(2024, 1, 1) + dt.timedelta(hours=n)


def run(spark, refs, parents, slice_seconds=86_400, block=1_000_000):
    r = spark.createDataFrame([(k, f, T(t), "clash") for k, f, t in refs], "rid string, f string, at timestamp_ntz, k string")
    p = spark.createDataFrame([(f, T(s), T(e), 1) for f, s, e in parents], "g string, s timestamp_ntz, e timestamp_ntz, us int")
    found = orphans([Reference(r, "refs", "f", "rid", "at", (("f", "g"),), p, "s", "e")], slice_seconds, block)
    return sorted(((x.ref_key, x.reason) for x in found.collect()), key=str)


def brute(refs, parents):
    norm = lambda x: None if x is None or not x.strip() else x.strip().lower()
    out = set()
    for k, f, t in refs:
        if norm(f) is None:
            continue
        own = [(s, e) for g, s, e in parents if norm(g) == norm(f)]
        if t is not None and any(s is not None and s <= t and (e is None or t < e) for s, e in own):
            continue
        started = t is not None and any(s is not None and s <= t for s, _ in own)
        out.add((k, "missing" if not own else "deleted" if started else "late"))
    return sorted(out, key=str)


def test_reasons_and_bounds(spark):
    parents = [("A", 10, 20), (" a\t", 30, None), ("b", 5, 5), (None, 0, None), ("  ", 0, None)]
    refs = [("r1", "a", 9), ("r2", "A ", 10), ("r3", "a", 19), ("r4", "a", 20), ("r5", "a", 30), ("r6", "x", 1), ("r7", None, 1), ("r8", " ", 1), ("r9", "b", 6), (None, "x", 1), ("r10", "a", None)]
    assert run(spark, refs, parents) == sorted([("r1", "late"), ("r4", "deleted"), ("r6", "missing"), ("r9", "deleted"), (None, "missing"), ("r10", "late")], key=str)


def test_empty_tables_and_repeats(spark):
    assert run(spark, [("r", "a", 1)] * 3, []) == [("r", "missing")]
    assert run(spark, [], [("a", 1, None)]) == []


def test_against_brute_force_over_slices(spark):
    rng = random.Random(1)
    for slice_seconds in (3600, 86_400, 10**7):
        parents = [(rng.choice("abcd"), s := rng.choice([None, *range(0, 90, 7)]), None if s is None else rng.choice([None, s, s - 3, s + 4, s + 40])) for _ in range(14)]
        refs = [(f"r{i}", rng.choice("abcde"), rng.choice([None, *range(0, 100)])) for i in range(120)]
        assert run(spark, refs, parents, slice_seconds) == brute(refs, parents)


def test_hot_slices_against_brute_force(spark):
    rng = random.Random(2)
    for slice_seconds, block in ((10**7, 5), (86_400, 12), (3600, 1)):
        parents = [(rng.choice("ab"), s := rng.choice([None, *range(0, 90, 7)]), None if s is None else rng.choice([None, s, s - 3, s + 4, s + 40])) for _ in range(40)]
        refs = [(f"r{i}", rng.choice("aaabc"), rng.choice([None, 3, 3, 3, *range(0, 100, 5)])) for i in range(150)]
        assert run(spark, refs, parents, slice_seconds, block) == brute(refs, parents)


def test_hot_slice_of_parents_alone(spark):
    assert run(spark, [("r", "a", 100)], [("a", 1, None)] * 20, block=5) == []
    assert run(spark, [("r", "a", 100)], [("a", 1, 2)] * 20, block=5) == [("r", "deleted")]


def test_report(spark):
    r = spark.createDataFrame([("a", "x", T(1)), ("b", "x", T(24 * 40))], "rid string, f string, at timestamp_ntz")
    p = spark.createDataFrame([], "g string, s timestamp_ntz, e timestamp_ntz")
    report = orphan_report(orphans([Reference(r, "refs", "f", "rid", "at", (("f", "g"),), p, "s", "e")])).collect()
    assert sorted((x.month.month, x.reason, x.orphans) for x in report) == [(1, "missing", 1), (2, "missing", 1)]
