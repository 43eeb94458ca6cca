import math

import regex

from factweave.llm import quality

BLANK = " \t\n\r\f\x0b"
COMMON = [("en", "the"), ("en", "is"), ("fr", "été"), (None, None), ("en", "the")]
SHAPE = "doc_id bigint, text string, lang string, tokens string, words string"
TEXTS = [
    "The ring buffer is the only object that is shared. It is read by the task and the handler.",
    "0000 8000ccb 4\n0003: 80000fe 800147a r 4 0x40000e50:c6bf\n0006 80024f4 3", "- a\n- b\n- c", "", None, " \t\n\x0b\x0c\r ", "the", "x" * 5000,
    "Été is ÉTÉ! \"the\" (is) the-is the, the; 日本語 is the.\r\n the is the  \n\n", "a b c d e f g h i j k l.", "the " * 30_000 + ".", "🙂 🙂 the é́.",
]


def expected(text):
    tokens = [t for t in regex.split(r"[ \t\n\r\f\x0b]+", text or "") if t]
    if not tokens:
        return None
    chars = "".join(tokens)
    lines = [x.strip(BLANK) for x in text.split("\n")]
    lines = [x for x in lines if x]
    common = {w for _, w in COMMON if w}
    core = lambda t: regex.sub(r"^[^\p{L}]+|[^\p{L}]+$", "", t.lower())
    stats = (len(tokens), len(chars) / len(tokens), len(regex.sub(r"[\p{L}\p{N}]", "", chars)) / len(chars), sum(x[-1] in ".!?" for x in lines) / len(lines), sum(core(t) in common for t in tokens) / len(tokens))
    n, mean, symbols, ended, share = stats
    return stats, (n < 12) + (mean < 3 or mean > 9) + (symbols > 0.16) + (ended < 0.5) + (share < 0.2)


def run(spark, rows, words=COMMON, **kw):
    docs = spark.createDataFrame([(i, t, lang, "x", "y") for i, (t, lang) in enumerate(rows)], SHAPE)
    return {r.doc_id: r for r in quality.assess(docs, spark.createDataFrame(words, "lang string, word string"), **kw).collect()}


def test_statistics_and_tails(spark):
    got = run(spark, [(t, "en") for t in TEXTS])
    for i, t in enumerate(TEXTS):
        want = expected(t)
        assert (i in got) == (want is not None)
        if want:
            r = got[i]
            assert all(math.isclose(a, b) for a, b in zip((r.tokens, r.mean_length, r.symbol_share, r.ended_lines, r.common_share), want[0])), t[:40]
            assert (r.tails, r.is_prose) == (want[1], want[1] < 2)


def test_languages_percentiles_and_scores(spark):
    rows = [("the word is here. " * n, lang) for n in range(1, 201) for lang in ("en", "EN-gb ", None)]
    got = run(spark, rows)
    assert {r.lang for r in got.values()} == {"en", "und"}
    for r in got.values():
        rank = r.tokens / 800
        assert abs(r.p_tokens - rank) < 0.05
    middle = min(got.values(), key=lambda r: abs(r.tokens - 402))
    assert abs(middle.z_tokens) < 0.1
    assert all(r.z_mean_length is None for r in got.values())


def test_percentile_tails_without_fixed_cuts(spark):
    rows = [("the word is here. " * (1 if n == 0 else 100 + n % 7), "en") for n in range(300)]
    got = run(spark, rows, cuts={})
    assert got[0].t_tokens and sum(r.t_tokens for r in got.values()) < 60


def test_empty_tables(spark):
    assert run(spark, []) == {}
    assert run(spark, [("the word is here", "en")], words=[])[0].common_share == 0
