import random

import numpy as np

from factweave.llm import overlap
from factweave.llm.common import paired

SHAPE = "view_id bigint, corpus string, binary_sha256 string, profile_text string, class string, tokens string"


def views(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SHAPE)


def pairs(spark, rows):
    return sorted((r.evaluation_id, r.training_id) for r in overlap.cross_split_pairs(views(spark, rows)).collect())


def grams(t):
    import regex

    w = [x.lower() for x in regex.findall(r"[\p{L}\p{N}]+", t or "")]
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}


def brute(rows):
    import re

    def dig(d):
        m = re.fullmatch(r"(?:sha256:)?([0-9a-f]{64})", (d or "").strip().lower())
        return m[1] if m and set(m[1]) != {"0"} else None

    side = lambda c: None if c is None else c.strip().lower().startswith("evaluation")
    out = []
    for a, ca, da, ta in rows:
        for b, cb, db, tb in rows:
            if side(ca) is not True or side(cb) is not False:
                continue
            x, y = grams(ta), grams(tb)
            if (dig(da) and dig(da) == dig(db)) or (x and y and 10 * len(x & y) >= 7 * len(x | y)):
                out.append((a, b))
    return sorted(out)


def test_digests_and_labels(spark):
    d, z = "ab" * 32, "0" * 64
    rows = [
        (1, " Evaluation_x", f" SHA256:{d.upper()}\n", None), (2, "dev", d, ""), (3, None, d, None), (4, "dev", z, None), (5, "evaluation", z, None),
        (6, "evaluation", "n/a", None), (7, "dev", "n/a", " "), (8, "", d, None), (9, "evaluation", None, "a b"), (10, "dev", None, "a b"),
    ]
    assert pairs(spark, rows) == brute(rows) == [(1, 2), (1, 8)]


def test_random_texts_against_all_pairs(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(40)] + ["Über", "naïve", "日本", "x1", "٣"]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 4, 5, 8, 20, 60, 120]))] for _ in range(25)]
    rows = []
    for i in range(220):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
            p = rng.randrange(len(w)) if w else 0
            w[p : p + 1] = rng.choice([[], [rng.choice(vocabulary)], [*w[p : p + 1], rng.choice(vocabulary)]])
        text = rng.choice([" ", ", ", "  ", "\t"]).join(x.upper() if rng.random() < 0.1 else x for x in w)
        rows.append((i, rng.choice(["evaluation", "training", "dev ", None]), None, text or None))
    want = brute(rows)
    assert len(want) > 50
    assert pairs(spark, rows) == want


def test_repeated_rows_hot_texts_and_empty_tables(spark):
    text = "one two three four five"
    rows = [(i, "evaluation" if i % 3 == 0 else "train", "cd" * 32, text) for i in range(60)]
    assert pairs(spark, rows) == brute(rows)
    assert pairs(spark, []) == []
    assert pairs(spark, [(None, "evaluation", "cd" * 32, text), (1, "train", "cd" * 32, text)]) == []
    assert pairs(spark, [(1, "evaluation", None, text)]) == []


def test_very_long_texts(spark, monkeypatch):
    rng = random.Random(8)
    rows = []
    for n, size in enumerate((30, 3_000, 9_000, 40_000)):
        words = [f"{rng.getrandbits(40):x}" for _ in range(size)]
        rows.append((10 * n, "train", None, " ".join(words)))
        for i, share in enumerate((0.02, 0.12, 0.3)):
            rows.append((10 * n + 1 + i, "evaluation", None, " ".join("new" if rng.random() < share / 3 else w for w in words)))
    want = brute(rows)
    assert len(want) > 4 and pairs(spark, rows) == want
    monkeypatch.setattr(overlap, "CELLS", 64)
    assert pairs(spark, rows[:4]) == brute(rows[:4])


def test_paired_cuts_hot_keys_and_loses_nothing(spark):
    left = spark.createDataFrame([(k, i) for k in "ab" for i in range(5)], "k string, l int")
    right = spark.createDataFrame([("a", i) for i in range(97)] + [("b", 1), ("c", 2), (None, 3)], "k string, r int")
    got = sorted(tuple(r) for r in paired(left, right, "k", "r", block=10).select("k", "l", "r").collect())
    assert got == sorted([("a", i, j) for i in range(5) for j in range(97)] + [("b", i, 1) for i in range(5)])


def test_banded_distance_against_full_table():
    rng = random.Random(2)

    def full(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(row[j - 1] if x == y else min(row[j], new[-1]) + 1)
            row = new
        return row[-1]

    a = [np.array([rng.randint(0, 6) for _ in range(rng.randint(0, 12))], dtype=np.int64) for _ in range(300)]
    b = [np.array([rng.randint(0, 6) for _ in range(rng.randint(0, 12))], dtype=np.int64) for _ in range(300)]
    k = np.array([rng.randint(0, 14) for _ in range(300)])
    want = [min(full(x, y), n + 1) for x, y, n in zip(a, b, k)]
    assert overlap.indel_within(a, b, k).tolist() == want


def test_tokens_that_are_often_seen_are_joined_in_blocks(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, rng.choice(["evaluation-a", "train"]), None, " ".join(["all texts begin like this"] + [f"w{rng.randint(0, 6)}" for _ in range(rng.randint(3, 9))])) for i in range(80)]
    df = spark.createDataFrame(rows, "view_id bigint, corpus string, binary_sha256 string, profile_text string")
    plain = sorted((r.evaluation_id, r.training_id) for r in overlap.cross_split_pairs(df).collect())
    near = overlap.near_classes
    monkeypatch.setattr(overlap, "near_classes", lambda classes, counts: near(classes, counts, block=2))
    monkeypatch.setattr(overlap, "MOST_PAIRS", 1)
    assert plain and sorted((r.evaluation_id, r.training_id) for r in overlap.cross_split_pairs(df).collect()) == plain
