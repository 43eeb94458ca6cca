"""Same or near-same records across splits (problem 3).

Edit-distance segment join. A record's distinct word trigrams, in one global order with the rare ones
first, are a string; two such strings share at least 0.7 of their trigrams exactly if their
insert/delete distance is at most k = a + b - 2o, where o = ceil(7 (a + b) / 17) is the least overlap of
lengths a and b. At most a - o tokens of the evaluation string are then missing from the training string.
So of its first (a - o) + c segments, cut one token long where the string is rare, at least c (or o, if
that is less) occur in the training string, and at allowed positions only: a c-th common token lies at
place a - o + c - 1 or before in one string and b - o + c - 1 or before in the other. Pairs with
enough such hits are verified by banded dynamic programming. Nothing is lost: every step is a bound.

Records of one text are one class and are expanded only at the end. The global order comes from a count
sketch of fixed size; any order is right, a good one is fast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.functions.text import stripped
from factweave.llm.common import batches, bounded_broadcast, paired, word_hashes
from factweave.session import checkpoint

#: The least share of trigrams common to two near-same texts, as a fraction.
SHARE = (7, 10)
#: Words of a shingle.
SHINGLE = 3
#: Segments that must be found in both strings (c above).
HITS = 3
#: Tokens beyond which a pair's distance is counted from its common tokens, and cells of one table of programs.
LONG, CELLS = 4_000, 1 << 20
#: Pairs of classes that are broadcast; more are shuffled.
MOST_PAIRS = 1_000_000
#: Counters of the sketch behind the global order.
SKETCH = 1 << 18


def side(corpus: Column) -> Column:
    """'evaluation', 'training' or NULL."""
    label = F.lower(stripped(corpus))
    return F.when(label.isNull(), None).when(label.startswith("evaluation"), "evaluation").otherwise("training")


def digest(c: Column) -> Column:
    """The 64 hex digits of a digest in lower case; NULL for placeholders and all zeros."""
    found = F.regexp_extract(F.lower(stripped(c)), r"^(?:sha256:)?([0-9a-f]{64})$", 1)
    return F.when(~found.isin("", "0" * 64), found)


def least_overlap(a: Column | str, b: Column | str, share: tuple[int, int] = SHARE) -> Column:
    """The least number of common tokens at which lengths a and b share enough of all."""
    p, q = share
    return F.ceil(F.lit(p) * (F.col(a) + F.col(b)) / F.lit(p + q)).cast("int")


def _numbered(counts: np.ndarray):
    """Rows (name, class, tokens, evaluation, training) with tokens sorted rare first."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            tokens = batch.column(2)
            flat, offsets = tokens.flatten().to_numpy(zero_copy_only=False), tokens.offsets.to_numpy() - tokens.offsets[0].as_py()
            row = np.repeat(np.arange(len(tokens)), np.diff(offsets))
            order = np.lexsort((flat, counts[flat & (len(counts) - 1)], row))
            again = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat[order]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], again, *batch.columns[3:]], names=["name", "class", "tokens", "evaluation", "training"])

    return run


def shingle_tokens(flat: np.ndarray, lengths: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, how many of each text) of texts laid end to end as word hashes: the distinct hashes of n consecutive words, sorted."""
    row = np.repeat(np.arange(len(lengths)), lengths)
    count = max(0, len(flat) - n + 1)
    mixed = np.zeros(count, dtype=np.uint64)
    for i in range(n):
        mixed = (mixed ^ flat[i : i + count].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    inside = row[:count] == row[n - 1 :] if count else np.zeros(0, dtype=bool)
    of, tokens = row[:count][inside], mixed.view(np.int64)[inside]
    order = np.lexsort((tokens, of))
    of, tokens = of[order], tokens[order]
    new = np.ones(len(of), dtype=bool)
    new[1:] = (of[1:] != of[:-1]) | (tokens[1:] != tokens[:-1])
    return tokens[new], np.bincount(of[new], minlength=len(lengths))


def _shingled(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (name, class, tokens, evaluation, training) of rows with word hashes in place of tokens."""
    for batch in source:
        held = batch.column(2)
        tokens, sizes = shingle_tokens(held.flatten().to_numpy(zero_copy_only=False), np.diff(held.offsets.to_numpy()).astype(np.int64))
        made = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(tokens))
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], made, *batch.columns[3:]], names=["name", "class", "tokens", "evaluation", "training"])


_CLASS = "name string, class bigint, tokens array<bigint>, evaluation boolean, training boolean"


def text_classes(named: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(classes, counts) of named(name, view_id, side, hashes).

    classes: name, class (a number: the least view of it), tokens (ordered), evaluation, training (whether it
    has such views). counts: the sketch of the tokens' numbers, by their last bits. Texts of fewer than three words have no trigram and
    belong to no class.
    """
    grouped = named.filter(F.size("hashes") >= SHINGLE).groupBy("name").agg(
        F.min("view_id").cast("bigint").alias("class"), F.any_value("hashes").alias("hashes"), F.bool_or(F.col("side") == "evaluation").alias("evaluation"), F.bool_or(F.col("side") == "training").alias("training")
    )
    classes = checkpoint(grouped.mapInArrow(_shingled, _CLASS))
    sketch = classes.select(F.explode("tokens").alias("t")).groupBy(F.col("t").bitwiseAND(SKETCH - 1).alias("at")).count()
    counted = sketch.toArrow()  # at most SKETCH rows, whatever the input
    counts = np.zeros(SKETCH, dtype=np.int64)
    counts[counted.column("at").to_numpy()] = counted.column("count").to_numpy()
    return checkpoint(classes.mapInArrow(_numbered(counts), _CLASS)), counts


def indel_within(a: list[np.ndarray], b: list[np.ndarray], k: np.ndarray) -> np.ndarray:
    """Insert/delete distances of the pairs (a[i], b[i]); k[i] + 1 where it is more than k[i].

    Dynamic programming over a band of k diagonals on either side, for all pairs at once.
    """
    n, m = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    band, rows = int(k.max(initial=0)), len(a)
    width = 2 * band + 1
    wide_a = np.zeros((rows, max(1, n.max(initial=0))), dtype=np.int64)
    wide_b = np.zeros((rows, m.max(initial=0) + n.max(initial=0) + 2 * width), dtype=np.int64)
    real = np.zeros(wide_b.shape, dtype=bool)
    for i, (x, y) in enumerate(zip(a, b)):
        wide_a[i, : len(x)] = x
        wide_b[i, band : band + len(y)] = y
        real[i, band : band + len(y)] = True
    far = np.int32(1 << 20)
    step = np.arange(width, dtype=np.int32)
    # row 0: place d of the band is column d - band, reached by that many insertions
    row = np.where(step >= band, step - band, far).astype(np.int32) * np.ones((rows, 1), np.int32)
    out = np.where(n == 0, m, far).astype(np.int64)
    for i in range(1, int(n.max(initial=0)) + 1):
        # columns i - band .. i + band; column j compares b[j - 1], which lies at band + j - 1
        same = (wide_b[:, i - 1 : i - 1 + width] == wide_a[:, i - 1 : i]) & real[:, i - 1 : i - 1 + width]
        down = np.concatenate([row[:, 1:], np.full((rows, 1), far, np.int32)], axis=1) + 1
        base = np.where(same, row, down)
        column = i - band + step
        base = np.where((column >= 0) & (column <= m[:, None]), base, far)
        row = np.minimum.accumulate(base - step, axis=1) + step
        ended = np.flatnonzero(n == i)
        at = m[ended] - i + band
        inside = (at >= 0) & (at < width)
        out[ended[inside]] = row[ended[inside], at[inside]]
    return np.where(out <= k, out, k + 1)


def _verified(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    p, q = SHARE
    schema = pa.schema([("class_e", pa.int64()), ("class_t", pa.int64())])

    def rows() -> Iterator[tuple]:
        for batch in source:
            a, b = ([x.values.to_numpy(zero_copy_only=False) for x in batch.column(i)] for i in (2, 3))
            n, m = np.array([len(x) for x in a]), np.array([len(x) for x in b])
            k = n + m - 2 * -(-p * (n + m) // (p + q))
            good = np.zeros(len(batch), dtype=bool)
            size = np.maximum(n, m)
            long = size > LONG
            for i in np.flatnonzero(long):
                # tokens of a string are distinct, so that its distance to another is what they don't share
                good[i] = n[i] + m[i] - 2 * len(np.intersect1d(a[i], b[i], assume_unique=True)) <= k[i]
            order = np.flatnonzero(~long)[np.argsort(size[~long], kind="stable")]
            at = 0
            while at < len(order):
                # as many pairs of like size as fit a table of CELLS places
                most = int(np.searchsorted(np.arange(1, len(order) - at + 1) * size[order[at:]], CELLS // 4, "right"))
                part = order[at : at + max(1, most)]
                good[part] = indel_within([a[i] for i in part], [b[i] for i in part], k[part]) <= k[part]
                at += len(part)
            e, t = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            yield from ((e[i], t[i]) for i in np.flatnonzero(good))

    return batches(rows(), schema)


def _spread_tokens(e: DataFrame, t: DataFrame, counts: np.ndarray, block: int) -> DataFrame:
    """Join of e and t on token, with the training rows of a token that is often seen cut into blocks.

    How often is read from the sketch, so nothing is counted again, and its list of such tokens is bounded.
    """
    often = np.flatnonzero(counts > block)
    if not len(often):
        return e.join(t, "token")
    listed = e.sparkSession.createDataFrame(pa.table({"at": pa.array(often), "blocks": pa.array(-(-counts[often] // block))}))
    at = F.col("token").bitwiseAND(SKETCH - 1)
    left = e.withColumn("at", at).join(F.broadcast(listed), "at", "left").withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("blocks", F.lit(1)) - F.lit(1).cast("bigint")))).drop("at", "blocks")
    right = t.withColumn("at", at).join(F.broadcast(listed), "at", "left").withColumn("block", F.pmod(F.xxhash64("class_t"), F.coalesce("blocks", F.lit(1)))).drop("at", "blocks")
    return left.join(right, ["token", "block"]).drop("block")


def near_classes(classes: DataFrame, counts: np.ndarray, block: int = 20_000) -> DataFrame:
    """Pairs (class_e, class_t) of an evaluation and a training class that share enough trigrams."""
    p, q = SHARE
    size = F.size("tokens")
    # the longest prefix that any partner can ask for
    reach = F.least(size, size - F.ceil(F.lit(p) * size / F.lit(q)).cast("int") + F.lit(HITS))
    segments = classes.withColumn("n", size).withColumn("cut", F.slice("tokens", 1, reach))
    e = segments.filter("evaluation").select(F.col("class").alias("class_e"), F.col("n").alias("a"), F.posexplode("cut").alias("p", "token"))
    t = segments.filter("training").select(F.col("class").alias("class_t"), F.col("n").alias("b"), F.posexplode("cut").alias("q", "token"))
    o = least_overlap("a", "b")
    allowed = (F.col("a") * p <= F.col("b") * q) & (F.col("b") * p <= F.col("a") * q) & (F.col("p") <= F.col("a") - o + (HITS - 1)) & (F.col("q") <= F.col("b") - o + (HITS - 1))
    hits = _spread_tokens(e, t, counts, block).filter(allowed).groupBy("class_e", "class_t").agg(F.count("*").alias("hits"), F.any_value(F.least(F.lit(HITS), o)).alias("least"))
    candidates = checkpoint(hits.filter("hits >= least").select("class_e", "class_t"))
    # only the tokens of classes with a candidate are moved
    seen = bounded_broadcast(candidates, MOST_PAIRS)
    left = classes.select(F.col("class").alias("class_e"), F.col("tokens").alias("tokens_e")).join(seen, "class_e")
    right = classes.select(F.col("class").alias("class_t"), F.col("tokens").alias("tokens_t")).join(seen.select("class_t"), "class_t", "left_semi")
    both = left.join(right, "class_t").select("class_e", "class_t", "tokens_e", "tokens_t")
    return both.mapInArrow(_verified, "class_e bigint, class_t bigint")


def cross_split_pairs(views: DataFrame, id_col: str = "view_id", split_col: str = "corpus", digest_col: str = "binary_sha256", text_col: str = "profile_text") -> DataFrame:
    """Pairs (evaluation_id, training_id, same_digest, near_text) that overlap across the splits, each once.

    Two views overlap if they name the same digest or share at least 0.7 of their distinct word trigrams.
    A NULL split is neither side, a row without an id no view; a missing or placeholder digest and a text of under three words (NULL,
    empty, blank) match nothing; repeated texts and digests give all their pairs, as the result asks for,
    spread in blocks. Empty tables give an empty result; other columns are not looked at.
    """
    v = views.select(F.col(id_col).alias("view_id"), side(F.col(split_col)).alias("side"), digest(F.col(digest_col)).alias("digest"), word_hashes(F.col(text_col)).alias("hashes")).filter("view_id IS NOT NULL AND side IS NOT NULL")
    # texts of the same words are one class; read by the classes, and by every join of their members
    named = checkpoint(v.withColumn("name", F.concat_ws("-", F.hex(F.xxhash64("hashes")), F.hex(F.hash("hashes")), F.size("hashes").cast("string"))))
    told = named.filter("digest IS NOT NULL").select("digest", "view_id", "side")
    by_digest = paired(
        told.filter("side = 'evaluation'").select("digest", F.col("view_id").alias("evaluation_id")),
        told.filter("side = 'training'").select("digest", F.col("view_id").alias("training_id")), "digest", "training_id",
    ).select("evaluation_id", "training_id", F.lit(True).alias("same_digest"), F.lit(False).alias("near_text"))
    classes, counts = text_classes(named)
    near = bounded_broadcast(checkpoint(near_classes(classes, counts)), MOST_PAIRS)
    names = lambda c: classes.select(F.col("class").alias(f"class_{c}"), F.col("name").alias(f"name_{c}"))
    of = near.join(names("e"), "class_e").join(names("t"), "class_t").select("name_e", "name_t")
    e = of.join(named.filter("side = 'evaluation'").select(F.col("name").alias("name_e"), F.col("view_id").alias("evaluation_id")), "name_e").drop("name_e")
    t = named.filter("side = 'training'").select(F.col("name").alias("name_t"), F.col("view_id").alias("training_id"))
    by_text = paired(e, t, "name_t", "training_id").select("evaluation_id", "training_id", F.lit(False).alias("same_digest"), F.lit(True).alias("near_text"))
    return by_digest.unionByName(by_text).groupBy("evaluation_id", "training_id").agg(F.bool_or("same_digest").alias("same_digest"), F.bool_or("near_text").alias("near_text"))


def overlap_report(views: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per corpus label and project of the evaluation views: views, those that overlap, and their pairs.

    Labels are stripped and lower-cased; views without a corpus are left out, a NULL project is a group.
    """
    per = pairs.groupBy(F.col("evaluation_id").alias("view_id")).agg(F.count("*").alias("n"))
    held = views.filter(side(F.col("corpus")) == "evaluation").select("view_id", F.lower(stripped(F.col("corpus"))).alias("corpus"), "project")
    return held.join(per, "view_id", "left").groupBy("corpus", "project").agg(
        F.count("*").alias("views"), F.count("n").alias("overlapping"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("pairs")
    )
