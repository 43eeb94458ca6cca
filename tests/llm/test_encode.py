import os
import random

import pytest
from tokenizers import Tokenizer

from factweave.llm import encode

ODD = [
    "a　　b  c\x85d\x1ce  f\n\n\ng \r\n h\t", "it's I'LL 'll''s ''ve", "<|endoftext|> x<|endoftext|>", "", " ", "   ", "​‍á ñ 日本語 👩‍🔧 ٣٤ ²½ Ⅷ",
    "\x00\x01 a﻿b", "x" * 30_000, "   z", "12 12.5e-3 0xdeadBEEF __a__",
]


@pytest.fixture(scope="module")
def tokenizer():
    path = os.path.join(encode.FOLDER, f"{encode.VOCABULARY}.json")
    if not os.path.exists(path):
        pytest.skip("no vocabulary files here")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def texts():
    rng = random.Random(5)
    alphabet = "ab'sltve 1²\n\r\t \x0b\x0c\x1c\x85\xa0   ​　.,!é日👩́٣Ⅷ_"
    return ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40))) for _ in range(500)]


def test_ids_and_round_trip(spark, tokenizer, monkeypatch):
    held = texts()
    rows = [(i, t, "w", 1, 2) for i, t in enumerate(held)] + [(-1, None, "w", 1, 2)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, words string, chunk int, bucket int")
    out = encode.encode(df)
    got = {r.doc_id: r.ids for r in out.collect()}
    assert got[-1] == [] and len(got) == len(rows)
    assert [got[i] for i in range(len(held))] == [tokenizer.encode(t, add_special_tokens=False).ids for t in held]
    back = {r.doc_id: r.text for r in encode.decode(out, encode.vocabulary_table(spark)).collect()}
    assert back == {-1: "", **dict(enumerate(held))}


def test_long_texts_are_cut_and_joined(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(encode, "CHUNK_WORDS", 7)
    monkeypatch.setattr(encode, "BUCKET_CHARS", 200)
    held = ["the ring buffer of 12 bytes; " * n for n in (1, 3, 40)] + [""]
    df = spark.createDataFrame(list(enumerate(held)), "doc_id bigint, text string")
    got = {r.doc_id: r.ids for r in encode.encode(df, long=30).collect()}
    assert got == {r.doc_id: r.ids for r in encode.encode(df).collect()}
    assert got == {i: tokenizer.encode(t, add_special_tokens=False).ids for i, t in enumerate(held)}


def test_repeated_rows_and_missing_ids(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(encode, "CHUNK_WORDS", 5)
    long = "the ring buffer of 12 bytes; " * 4
    rows = [(1, long), (1, long), (1, long + "x"), (None, long), (None, "a"), (2, "b"), (2, "b")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = encode.encode(df, long=20).collect()
    want = [(i, tokenizer.encode(t, add_special_tokens=False).ids) for i, t in rows]
    assert sorted(((r.doc_id, r.ids) for r in got), key=str) == sorted(want, key=str)
    assert sorted(((r.doc_id, r.ids) for r in encode.encode(df).collect()), key=str) == sorted(want, key=str)


def test_texts_are_encoded_and_assembled_once(spark, tokenizer):
    df = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    plan = encode.encode(df)._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("Initial Plan")[-1]
    assert plan.count("FlatMapCoGroupsInArrow") == 1 and plan.count("MapInArrow") == 1


def test_empty_table_and_unknown_id(spark, tokenizer):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert encode.encode(df).count() == 0
    part = spark.createDataFrame([(1, [447]), (2, None), (3, [])], "doc_id bigint, ids array<int>")
    assert {r.doc_id: r.text for r in encode.decode(part, encode.vocabulary_table(spark)).collect()} == {1: "\ufffd", 2: "", 3: ""}
    bad = spark.createDataFrame([(1, [99_999_999])], "doc_id bigint, ids array<int>")
    with pytest.raises(Exception, match="no such token"):
        encode.decode(bad, encode.vocabulary_table(spark)).collect()
