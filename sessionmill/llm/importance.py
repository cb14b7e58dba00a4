"""Target-distribution importance resampling over hashed n-grams, in Arrow kernels.

Texts are lower-cased, split into words and dictionary-encoded; the word numbers, shifted against each other, form n-grams, and each distinct
n-gram of a slice is hashed once. Counts of a bucket in the raw and in the target texts give its gain, a document's weight is
the mean gain of its features, and a Gumbel number drawn from the key turns the highest scores into a sample without
replacement in which a document's chance grows with its weight.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..operators.ordered import global_rank
from .common import keep, shared_dir, slices, whole_text

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"   # after lower-casing A-Z: digits, letters and all beyond ASCII make words
LONGEST, BUCKETS = 1, 10_000
LEAST_WORDS, PERCENT, SEED = 20, 10, 2024


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts one after another, dictionary-encoded, and where each text begins among them (one more than texts)."""
    split = pc.split_pattern_regex(pc.ascii_lower(texts), NOT_WORD)
    flat = pc.list_flatten(split)
    size = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    word = pc.greater(pc.binary_length(flat), 0)          # a text that begins or ends outside a word gives an empty string there
    before = np.concatenate([[0], np.cumsum(word.to_numpy(zero_copy_only=False))])
    return flat.filter(word).dictionary_encode(), before[np.concatenate([[0], np.cumsum(size)])]


def buckets_of(texts: pa.Array, longest: int = LONGEST, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n = 1 to ``longest``: the bucket of each run of n words, and where each text begins among these runs."""
    words, begin = split_words(texts)
    names = [w.encode() for w in words.dictionary.to_pylist()]
    first = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    ids, grams, size = first, names, np.diff(begin)
    for n in range(1, longest + 1):
        if n > 1:
            # a run of n words is a run of n - 1 and the word after it; runs that leave their text are left out
            inside = np.arange(len(first)) + n <= np.repeat(begin[1:], np.diff(begin))
            at = np.flatnonzero(inside)
            both = previous[at] * len(names) + first[at + n - 1]
            distinct, ids = np.unique(both, return_inverse=True)
            grams = [grams[p] + b" " + names[w] for p, w in zip((distinct // len(names)).tolist(), (distinct % len(names)).tolist())]
            size = np.maximum(np.diff(begin) - n + 1, 0)
        hashed = np.fromiter((zlib.crc32(g) % buckets for g in grams), np.int64, len(grams))
        if n < longest:
            previous = np.zeros(len(first), np.int64)
            previous[np.arange(len(first)) if n == 1 else at] = ids
        yield hashed[ids], np.concatenate([[0], np.cumsum(size)])


def bucket_counts(docs: DataFrame, text: str, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall in each bucket. Each task folds its own counts; ``buckets`` rows reach the driver."""
    rows = docs.select(whole_text(F.col(f"`{text}`")).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in slices(batches, "t"):
            for bucket, _ in buckets_of(b.column("t"), longest, buckets):
                total += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])
    out = np.zeros(buckets, np.int64)
    for r in rows.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket floor(1000 ln of the target's share over the raw share), each count with one added."""
    k = len(raw)
    ratio = (target + 1).astype(float) * float(raw.sum() + k) / ((raw + 1).astype(float) * float(target.sum() + k))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weighed(docs: DataFrame, key: str, text: str, gain: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """``k`` (the key), ``n_words``, ``n_features`` and ``weight``, the mean gain rounded down (0 without features), a row for each row."""
    rows = docs.select(F.col(f"`{key}`").alias("k"), whole_text(F.col(f"`{text}`")).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t"):
            words = features = total = np.zeros(b.num_rows, np.int64)
            for n, (bucket, begin) in enumerate(buckets_of(b.column("t"), longest, len(gain))):
                upto = np.concatenate([[0], np.cumsum(gain.take(bucket))])
                total = total + upto[begin[1:]] - upto[begin[:-1]]
                features = features + np.diff(begin)
                words = np.diff(begin) if n == 0 else words
            weight = np.floor_divide(total, np.maximum(features, 1))
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(words), pa.array(features), pa.array(weight)], ["k", "n_words", "n_features", "weight"])
    schema = T.StructType([rows.schema["k"], *[T.StructField(n, T.LongType()) for n in ("n_words", "n_features", "weight")]])
    return rows.mapInArrow(run, schema)


def gumbel(key: Column, seed: int = SEED) -> Column:
    """floor(-1000 ln(-ln u)) with u from the first eight hex digits of the SHA-256 of ``seed:key``; a null key counts as empty text."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", longest: int = LONGEST,
             buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """``key``, ``n_features``, ``weight``, ``score`` and ``rank``: a row for each row of ``docs``, repeated and null keys included.

    Of the N rows with at least ``least_words`` words, the ``percent * N // 100`` highest scores are drawn and numbered from 1, ties to
    the smaller key (null after all others), then to more features and the higher weight; rows equal in all of these are alike. All
    others have a null rank. Null and empty texts have no features and weight 0; with an empty target all weights come from its
    smoothed, even shares. An empty table gives no rows. Other columns are not looked at.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    gain = gains(bucket_counts(docs, text, longest, buckets), bucket_counts(target, target_text, longest, buckets))
    scored = keep(weighed(docs, key, text, gain, longest).withColumn("score", F.col("weight") + gumbel(F.col("k"), seed)), "scored")
    able = F.col("n_words") >= least_words
    # scores are whole numbers of a bounded range, so their histogram is small whatever the table; it gives the least score drawn
    n = scored.filter(able).count()
    drawn = n * percent // 100
    above, least = 0, None
    if drawn:
        for least, n in sorted(map(tuple, scored.filter(able).groupBy("score").count().collect()), reverse=True):
            above += n
            if above >= drawn:
                break
    out = ["k", "n_features", "weight", "score"]
    may = able & (F.col("score") >= least) if drawn else F.lit(False)
    order = [F.desc("score"), F.col("k").asc_nulls_last(), F.desc("n_features"), F.desc("weight")]
    ranked = global_rank(scored.filter(may), order).select(*out, F.when(F.col("rank") <= drawn, F.col("rank")).cast("bigint").alias("rank")) \
        if drawn else scored.limit(0).select(*out, F.lit(None).cast("bigint").alias("rank"))
    rest = scored.filter(~F.coalesce(may, F.lit(False))).select(*out, F.lit(None).cast("bigint").alias("rank"))
    return ranked.unionByName(rest).withColumnRenamed("k", key)
