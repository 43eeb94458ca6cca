"""Evaluation passages leaking into a corpus (problem 7).

Winnowing: of each window of w consecutive k-gram hashes the least (the first of equals) is kept as a
fingerprint with its place. Two texts that share a run of k + w - 1 words share a window, so they share
its fingerprint at the same place of the run: every run of `span` words is found with k + w - 1 = span.
A fingerprint carries the hashes of the words on both sides of it, as far as a run around it can reach. So a hit
is extended where the fingerprints meet, word by word, and no text is read again or moved: what is shuffled is the pairs found.
Test items are few: their fingerprints are counted, given to the readers of the corpus as a list to look in, and broadcast.
Where they are too many, the corpus' fingerprints are joined with them in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.functions.text import without_format_characters
from factweave.llm.common import paired, word_hashes
from factweave.session import checkpoint

#: Words that a leaked passage shares at least, and words of a k-gram.
SPAN = 13
GRAM = 8
#: The most fingerprints of test items that are broadcast; each is a few hundred bytes.
BROADCAST = 200_000


def winnow(flat: np.ndarray, lengths: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, hash, place of the first word from 1) of the fingerprints of texts laid end to end as word hashes."""
    window = span - gram + 1
    if len(flat) < span:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    hashes = flat.astype(np.uint64)
    count = len(flat) - gram + 1
    grams = np.zeros(count, dtype=np.uint64)
    for i in range(gram):
        grams = (grams ^ hashes[i : i + count]) * np.uint64(0x9E3779B97F4A7C15)
        grams ^= grams >> np.uint64(29)
    signed = grams.view(np.int64)
    starts = np.cumsum(lengths) - lengths
    row = np.repeat(np.arange(len(lengths)), lengths)[: count - window + 1]
    place = np.arange(count - window + 1)
    whole = place + span <= (starts + lengths)[row]
    kept = place + np.lib.stride_tricks.sliding_window_view(signed, window).argmin(axis=1)
    row, kept = row[whole], kept[whole]
    # the place of the first least hash never moves back, so repeats lie side by side
    new = np.ones(len(kept), dtype=bool)
    new[1:] = (kept[1:] != kept[:-1]) | (row[1:] != row[:-1])
    row, kept = row[new], kept[new]
    # Places with the same words on both sides, as far as a run can reach, give the same answer: the first will
    # do. So text that repeats itself costs no more than one period of it. A side that the text cuts short is like no other.
    reach = span - gram
    first, last = starts[row], (starts + lengths)[row] - gram
    left = np.where(kept - reach >= first, signed[np.maximum(kept - reach, 0)], ~kept)
    right = np.where(kept + reach <= last, signed[np.minimum(kept + reach, count - 1)], ~kept)
    order = np.lexsort((kept, right, left, signed[kept], row))
    same = np.zeros(len(kept), dtype=bool)
    if len(kept):
        cols = [x[order] for x in (row, signed[kept], left, right)]
        same[1:] = np.logical_and.reduce([c[1:] == c[:-1] for c in cols])
    chosen = np.sort(order[~same])
    row, kept = row[chosen], kept[chosen]
    return row, signed[kept], kept - starts[row] + 1


def reach(flat: np.ndarray, lengths: np.ndarray, row: np.ndarray, at: np.ndarray, span: int, gram: int, beyond: int) -> np.ndarray:
    """Per fingerprint the word hashes from span - gram words before it to as many after it; beyond the text's ends `beyond`."""
    starts = np.cumsum(lengths) - lengths
    wing = span - gram
    place = (starts[row] + at - 1)[:, None] + np.arange(-wing, span)
    inside = (place >= starts[row][:, None]) & (place < (starts + lengths)[row][:, None])
    return np.where(inside, flat[np.clip(place, 0, max(0, len(flat) - 1))], beyond)


def _winnower(span: int, gram: int, beyond: int, sought: Broadcast | None = None):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if sought is None else np.frombuffer(sought.value, dtype=np.int64)
        for batch in source:
            held = batch.column(1)
            flat, lengths = held.flatten().to_numpy(zero_copy_only=False), np.diff(held.offsets.to_numpy()).astype(np.int64)
            row, h, at = winnow(flat, lengths, span, gram)
            if wanted is not None:
                near = np.searchsorted(wanted, h)
                kept = wanted[np.minimum(near, len(wanted) - 1)] == h if len(wanted) else np.zeros(len(h), dtype=bool)
                row, h, at = row[kept], h[kept], at[kept]
            around = reach(flat, lengths, row, at, span, gram, beyond)
            offsets = pa.array(np.arange(len(row) + 1) * (2 * span - gram), pa.int32())
            around = pa.ListArray.from_arrays(offsets, pa.array(around.ravel(), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(h), pa.array(at.astype(np.int32)), around], names=[batch.schema.names[0], "h", "at", "around"])

    return run


def fingerprints(texts: DataFrame, id_col: str, hashes_col: str, span: int = SPAN, gram: int = GRAM, beyond: int = 0, sought: Broadcast | None = None) -> DataFrame:
    """(id, h, at, around) of the winnowed k-grams of each text of word hashes.

    at is the place of the first word, from 1; around the word hashes in reach of it. sought, sorted hashes, leaves out
    all other fingerprints.
    """
    return texts.select(id_col, hashes_col).mapInArrow(_winnower(span, gram, beyond, sought), f"{id_col} {dict(texts.dtypes)[id_col]}, h bigint, at int, around array<bigint>")


def passages_found(
    corpus: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", passage_col: str = "passage", span: int = SPAN, gram: int = GRAM, most: int = BROADCAST
) -> DataFrame:
    """Distinct (doc_id, item_id) where the document holds `span` consecutive words of the item's passage.

    Characters of category Cf are removed first; words are lower-cased runs of letters and digits and are compared by
    64-bit hashes. NULL, empty and shorter texts hold nothing; repeated words, ties of hashes and repeated rows change nothing;
    very long texts are searched whole; rows without an id are left out. Empty tables give an empty result; other columns are not looked at.
    """
    if not 1 <= gram <= span:
        raise ValueError("a k-gram must lie within the span")

    def split(df: DataFrame, key: str, text: str, names: tuple[str, str]) -> DataFrame:
        c = F.col(text).cast("string")
        # so many words take at least so many characters
        held = df.filter((F.length(c) >= 2 * span - 1) & F.col(key).isNotNull())
        return held.select(F.col(key).alias(names[0]), word_hashes(without_format_characters(c)).alias(names[1]))

    item = fingerprints(split(items, item_col, passage_col, ("item_id", "iw")), "item_id", "iw", span, gram, beyond=1)
    # the items are fixed material; kept, as their fingerprints are counted, listed and joined
    item = checkpoint(item.select("item_id", "h", F.col("around").alias("i_around")))
    doc = split(corpus, id_col, text_col, ("doc_id", "dw"))
    if item.limit(most + 1).count() <= most:
        hashes = np.unique(item.select("h").toArrow().column("h").to_numpy()).astype(np.int64)  # at most `most`
        sought = corpus.sparkSession.sparkContext.broadcast(hashes.tobytes())
        met = fingerprints(doc, "doc_id", "dw", span, gram, sought=sought).join(F.broadcast(item), "h")
    else:
        met = paired(item, checkpoint(fingerprints(doc, "doc_id", "dw", span, gram)), "h", "doc_id")
    # the gram lies at the same place of both reaches, so a run around it has the same place, too
    agrees = F.exists(F.sequence(F.lit(1), F.lit(span - gram + 1)), lambda s: F.slice("around", s, span) == F.slice("i_around", s, span))
    return met.filter(agrees).select("doc_id", "item_id").distinct()


def leak_report(found: DataFrame, items: DataFrame) -> DataFrame:
    """Per suite and split of the items: items, those that leaked, and documents that hold one."""
    per = found.groupBy("item_id").agg(F.count("*").alias("documents"))
    return items.join(per, "item_id", "left").groupBy("suite", "eval_split").agg(
        F.count("*").alias("items"), F.count("documents").alias("leaked"), F.coalesce(F.sum("documents"), F.lit(0)).cast("bigint").alias("documents")
    )
