import random

import regex

from factweave.llm import leaks


def brute(docs, items, span=13):
    def words(t):
        return [w.lower() for w in regex.findall(r"[\p{L}\p{N}]+", regex.sub(r"\p{Cf}+", "", t or ""))]

    grams = lambda t: {tuple(w[i : i + span]) for w in [words(t)] for i in range(len(w) - span + 1)}
    return sorted((d, i) for d, t in docs for i, p in items if grams(t) & grams(p))


def run(spark, docs, items, **kw):
    d = spark.createDataFrame([(a, b, "h", 1) for a, b in docs], "doc_id bigint, text string, h string, at int")
    i = spark.createDataFrame([(a, b, "h", 1) for a, b in items], "item_id bigint, passage string, h string, dw int")
    return sorted(tuple(r) for r in leaks.passages_found(d, i, **kw).collect())


def test_random_texts_against_all_grams(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(300)] + ["Ä", "ß", "日本"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 60)))) for i in range(30)]
    docs = []
    for n in range(120):
        text = [rng.choice(vocabulary) for _ in range(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 2)):
            words = rng.choice(items)[1].split()
            at, size = rng.randrange(len(words)), rng.randint(10, 16)
            text[rng.randint(0, len(text)) : 0] = words[at : at + size]
        docs.append((n, rng.choice([" ", ", ", "​ ", "\n"]).join(w.upper() if rng.random() < 0.2 else w for w in text)))
    want = brute(docs, items)
    assert len(want) > 15
    assert run(spark, docs, items) == want
    # too many fingerprints to broadcast
    assert run(spark, docs, items, most=1) == want
    assert run(spark, docs, items, span=9, gram=4) == brute(docs, items, 9)


def test_no_text_is_shuffled(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    i = spark.createDataFrame([(1, "a b")], "item_id bigint, passage string")
    plan = leaks.passages_found(d, i)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(doc_id" in plan


def test_thirteen_words_are_found_and_twelve_are_not(spark):
    passage = " ".join(f"q{i}" for i in range(40))
    for at in (0, 5, 27):
        inside = " ".join(f"q{i}" for i in range(at, at + 13))
        short = " ".join(f"q{i}" for i in range(at, at + 12))
        docs = [(1, f"some text {inside} more"), (2, f"some text {short} more"), (3, inside), (4, inside.replace("q", "Q­"))]
        assert run(spark, docs, [(9, passage)]) == [(1, 9), (3, 9), (4, 9)]


def test_repeats_ties_nulls_and_empty_tables(spark):
    same = "a " * 40
    docs = [(1, same), (1, same), (2, None), (3, ""), (4, " \n"), (5, "a " * 12), (None, same)]
    items = [(7, "a " * 13), (7, "a " * 13), (8, None), (9, "")]
    assert set(run(spark, docs, items)) == {(1, 7)}
    assert run(spark, [], items) == [] and run(spark, docs[:2], []) == []


def test_a_very_long_text(spark):
    passage = " ".join(f"z{i}" for i in range(20))
    docs = [(1, "filler words here " * 200_000 + passage + " filler" * 1000)]
    assert run(spark, docs, [(1, passage)]) == [(1, 1)]


def test_text_that_repeats_itself(spark):
    rng = random.Random(3)
    docs, items = [], []
    for n in range(40):
        period = [f"p{rng.randint(0, 3)}" for _ in range(rng.randint(1, 9))]
        body = (period * 400)[: rng.randint(5, 900)]
        for _ in range(rng.randint(0, 3)):
            body[rng.randrange(len(body))] = "odd"
        docs.append((n, " ".join(body)))
        items.append((n, " ".join((period * 9)[rng.randint(0, 5) :][: rng.randint(10, 30)])))
    assert run(spark, docs, items) == brute(docs, items)


def test_fingerprints_of_repeats_are_few():
    import numpy as np

    flat = np.tile(np.arange(5), 100_000)
    row, h, at = leaks.winnow(flat, np.array([len(flat)]), 13, 8)
    assert 0 < len(at) < 40


def test_report(spark):
    items = spark.createDataFrame([(1, "s", "test"), (2, "s", "test")], "item_id bigint, suite string, eval_split string")
    found = spark.createDataFrame([(10, 1), (11, 1)], "doc_id bigint, item_id bigint")
    assert [tuple(r) for r in leaks.leak_report(found, items).collect()] == [("s", "test", 2, 1, 2)]
