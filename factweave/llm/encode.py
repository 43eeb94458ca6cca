"""Encoding a corpus with a public tokenizer over a table of distinct words (problem 6).

Texts are split into the tokenizer's words in Spark, each distinct word of the corpus is encoded once, and
the ids are joined back by position. Texts are first spread over buckets of about equal text; a bucket
asks for each of its words once, so the join carries (bucket, word) pairs, not occurrences, and no word,
however common, weighs more than the number of buckets. Every text goes through one such join: one of ordinary length
whole, a very long one as chunks of words, which lie in different buckets and are put together by their numbers.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.functions.text import WHITE_SPACE
from factweave.session import checkpoint

#: The folder of the tokenizers' vocabulary files; pass another where they lie elsewhere.
FOLDER = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"

#: The pattern that splits text before the merges, with Unicode's white space written out,
#: as Java's \s is only ASCII's.
_WS = "".join(f"\\u{ord(c):04x}" for c in WHITE_SPACE if c not in "\x1c\x1d\x1e\x1f")
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"

#: The most pieces of a vocabulary, which is broadcast.
MOST_PIECES = 1_000_000
#: Characters of text of one bucket, characters beyond which a text is cut into chunks, and words of a chunk.
BUCKET_CHARS = 4_000_000
LONG_CHARS = 1_000_000
CHUNK_WORDS = 100_000


def _words(text: str) -> Column:
    return F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(PATTERN), F.lit(0))


def whole_texts(texts: DataFrame, buckets: int) -> DataFrame:
    """(bucket, doc_id, mark, chunk, chunks, words) of (doc_id, text), a row per text. The texts themselves are spread: their words take five times the room."""
    bucket = F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).cast("int")
    spread = texts.withColumn("bucket", bucket).repartition(max(buckets, texts.sparkSession.sparkContext.defaultParallelism), "bucket")
    return spread.select("bucket", "doc_id", F.lit(0).cast("bigint").alias("mark"), F.lit(0).alias("chunk"), F.lit(1).alias("chunks"), _words("text").alias("words"))


def word_chunks(texts: DataFrame, buckets: int) -> DataFrame:
    """The same of very long texts, a row per chunk of words; the chunks of a text lie in different buckets."""
    split = texts.select("doc_id", F.xxhash64("text").alias("mark"), _words("text").alias("words"))
    numbered = split.withColumn("chunks", F.ceil(F.size("words") / F.lit(CHUNK_WORDS)).cast("int")).withColumn("chunk", F.explode_outer(F.sequence(F.lit(0), F.col("chunks") - 1)))
    part = F.slice("words", F.col("chunk") * CHUNK_WORDS + 1, F.lit(CHUNK_WORDS))
    bucket = F.pmod(F.xxhash64("doc_id", "mark", "chunk"), F.lit(buckets)).cast("int")
    return numbered.select(bucket.alias("bucket"), "doc_id", "mark", "chunk", "chunks", part.alias("words"))


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    """The tokenizer of a file, loaded once per Python worker."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


def _encoder(path: str):
    schema = pa.schema([("word", pa.string()), ("ids", pa.list_(pa.int32()))])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        for batch in source:
            ids = [e.ids for e in _tokenizer(path).encode_batch(batch.column(0).to_pylist(), add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, schema.field(1).type)], schema=schema)

    return run


def _assembled(texts: pa.Table, entries: pa.Table) -> pa.Table:
    """The ids of each chunk, put together by the positions of its words in the bucket's entries."""
    words = texts.column("words").combine_chunks()
    counts = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at = pc.index_in(words.flatten(), value_set=entries.column("word").combine_chunks())
    if at.null_count:
        raise ValueError("a word has no entry")
    pieces = entries.column("ids").combine_chunks().take(at)
    sizes = np.concatenate([[0], np.cumsum(pc.list_value_length(pieces).to_numpy(zero_copy_only=False))])
    offsets = sizes[np.concatenate([[0], np.cumsum(counts)])]
    ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pieces.flatten())
    kept = ["doc_id", "mark", "chunk", "chunks"]
    return pa.table([*(texts.column(c) for c in kept), ids], names=[*kept, "ids"])


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = FOLDER, vocabulary: str = VOCABULARY, long: int | None = None) -> DataFrame:
    """(doc_id, ids) of every row of df: the token ids of its text, without special tokens.

    Strings that spell a special token are ordinary text. NULL and empty texts have the empty list; blank
    texts are encoded like others. Repeated rows and NULL ids give a row each. An empty table gives an empty
    table; other columns, whatever their names, are not looked at. Texts of over `long` characters are encoded in chunks, which
    changes no result.
    """
    long = LONG_CHARS if long is None else long
    slim = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = F.length("text")
    chars, longest, long_chars = slim.agg(F.sum(size), F.max(size), F.sum(F.when(size > long, size))).first()
    path = os.path.join(folder, f"{vocabulary}.json")
    buckets = lambda n: max(1, -(-n // BUCKET_CHARS))
    short = F.coalesce(size <= long, F.lit(True))
    whole = whole_texts(slim.filter(short) if (longest or 0) > long else slim, buckets((chars or 0) - (long_chars or 0)))
    if (longest or 0) <= long:
        asked = _asked(whole)
        return _joined(whole, asked, _table(asked, path), slim).select("doc_id", "ids")
    chunks = word_chunks(slim.filter(~short), buckets(long_chars))
    # one table of distinct words for both
    asked, asked_chunks = _asked(whole), _asked(chunks)
    table = _table(asked.unionByName(asked_chunks), path)
    # a repeated row of several chunks has each of them as often as it occurs
    once = _joined(chunks, asked_chunks, table, slim).groupBy("doc_id", "mark", "chunk").agg(F.any_value("ids").alias("ids"), F.count(F.lit(1)).alias("times"))
    parts = once.groupBy("doc_id", "mark").agg(F.flatten(F.array_sort(F.collect_list(F.struct("chunk", "ids"))).getField("ids")).alias("ids"), F.min("times").cast("int").alias("times"))
    several = parts.select("doc_id", "ids", F.explode(F.sequence(F.lit(1), "times"))).drop("col")
    return _joined(whole, asked, table, slim).select("doc_id", "ids").unionByName(several)


def _asked(placed: DataFrame) -> DataFrame:
    """The distinct (bucket, word), kept: they are read for the table and for the join, and take a fraction of the text's room."""
    # an outer generator, as the filter that an inner one implies would split every text again
    return checkpoint(placed.select("bucket", F.explode_outer("words").alias("word")).filter("word IS NOT NULL").distinct())


def _table(asked: DataFrame, path: str) -> DataFrame:
    """(word, ids) of each distinct word."""
    return asked.select("word").distinct().mapInArrow(_encoder(path), "word string, ids array<int>")


def _joined(placed: DataFrame, asked: DataFrame, table: DataFrame, slim: DataFrame) -> DataFrame:
    entries = asked.join(table, "word").select(F.col("bucket").alias("slot"), "word", "ids")
    return placed.groupBy("bucket").cogroup(entries.groupBy("slot")).applyInArrow(_assembled, f"doc_id {dict(slim.dtypes)['doc_id']}, mark bigint, chunk int, chunks int, ids array<int>")


def vocabulary_table(spark: SparkSession, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, piece) with the bytes of each token, from the rank file; its size is the vocabulary's, not the corpus'."""
    def rows() -> Iterator[tuple[int, bytes]]:
        with open(os.path.join(folder, f"{vocabulary}.tiktoken"), "rb") as f:
            for line in f:
                piece, rank = line.split()
                yield int(rank), base64.b64decode(piece)

    ids, found = zip(*rows())
    return spark.createDataFrame(pa.table({"id": pa.array(ids, pa.int32()), "piece": pa.array(found, pa.binary())}))


def _speller(pieces: Broadcast):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, spelt = (pa.ipc.open_stream(pieces.value).read_all().column(i).combine_chunks() for i in (0, 1))
        for batch in source:
            ids = batch.column(1)
            flat = ids.flatten()
            at = pc.index_in(flat, value_set=known)
            if at.null_count:
                raise ValueError(f"no such token: {flat.filter(at.is_null())[0]}")
            offsets = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))])
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spelt.take(at)), b"")
            try:
                text = joined.cast(pa.string())
            except pa.ArrowInvalid:
                text = pa.array([b.decode("utf-8", "replace") for b in joined.to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), text], names=[batch.schema.names[0], "text"])

    return run


def decode(encoded: DataFrame, pieces: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, text) of (doc_id, ids) by a map-side join of ids with pieces; an empty or NULL list gives ''.

    pieces (id, piece) is a vocabulary, so its size is fixed; it is counted and broadcast. The join keeps the
    ids in their lists, in order, so nothing is shuffled. An id that is no token raises an error, so that no
    text is silently shortened; bytes that are no text become replacement characters.
    """
    held = pieces.select("id", "piece").limit(MOST_PIECES + 1).toArrow()
    if held.num_rows > MOST_PIECES:
        raise ValueError(f"a vocabulary of more than {MOST_PIECES} pieces")
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, held.schema) as out:
        out.write_table(held)
    shared = encoded.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())
    return encoded.select(id_col, "ids").mapInArrow(_speller(shared), f"{id_col} {dict(encoded.dtypes)[id_col]}, text string")
