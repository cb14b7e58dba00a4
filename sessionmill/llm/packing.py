"""Packing of documents into windows: best-fit decreasing over a segment tree of remaining capacities.

Documents longer than a window are cut into full windows first; what is left is shorter than a window, so there are at most
``capacity - 1`` different lengths and only the count of each reaches the packer. It takes lengths from the longest on; a segment
tree indexed by remaining capacity gives the tightest open window, and equal pieces that meet equal windows are placed together.
The plan has a row per such step, not per document, and is joined to the pieces by their rank among pieces of equal length.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from .chunks import default_tokenizer, encoder
from .common import keep, slices, whole_text

CAPACITY = 1024
END_ID = 0
TOKENIZER = "byte_bpe_50k.json"


class OpenWindows:
    """Numbers of open windows by remaining capacity: a segment tree whose nodes hold the sum of their leaves."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.sums = [0] * (2 * self.size)

    def add(self, remaining: int, n: int) -> None:
        i = remaining + self.size
        while i:
            self.sums[i] += n
            i //= 2

    def tightest(self, least: int) -> int | None:
        """The smallest remaining capacity of at least ``least`` that an open window has."""
        i = least + self.size
        if self.sums[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.sums[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.sums[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def best_fit_decreasing(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int, int]]:
    """Rows (length, first, last, per, window, at, step): the pieces of this length with ranks first..last (from 0) go, ``per``
    to a window, into the windows numbered from ``window`` on, the first of each window at offset ``at``."""
    tree, stacks, made, out = OpenWindows(capacity), [[] for _ in range(capacity + 1)], 0, []

    def put(remaining: int, window: int, n: int) -> None:
        if remaining and n:
            stacks[remaining].append((window, n))
            tree.add(remaining, n)

    for length in sorted((k for k, n in counts.items() if n), reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is not between 1 and {capacity}")
        left, rank = counts[length], 0
        while left:
            remaining = tree.tightest(length)
            if remaining is None:   # new windows, each filled before the next is opened
                remaining = capacity
                per = min(capacity // length, left)
                window, n = made, max(1, left // per)
                made += n
            else:
                window, n = stacks[remaining].pop()
                tree.add(remaining, -n)
                per = min(remaining // length, left)
                most = max(1, left // per)
                if n > most:
                    put(remaining, window + most, n - most)
                    n = most
            out.append((length, rank, rank + n * per - 1, per, window, capacity - remaining, len(out)))
            put(remaining - per * length, window, n)
            rank += n * per
            left -= n * per
    return out


def pieces(docs: DataFrame, keys: list[str], tokens: str, capacity: int = CAPACITY) -> DataFrame:
    """A row per piece of each row: ``keys``, ``start``, ``length``; no row for null or no tokens."""
    cut = F.sequence(F.lit(0).cast("bigint"), F.col(tokens) - 1, F.lit(capacity).cast("bigint"))
    return (docs.filter(F.col(tokens) > 0).select(*keys, F.col(tokens).alias("__n"), F.explode(cut).alias("start"))
            .select(*keys, "start", F.least(F.lit(capacity).cast("bigint"), F.col("__n") - F.col("start")).alias("length")))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``.

    Needs ``length`` of 1 to ``capacity``; other columns are kept. The pieces are written once with their place. Pieces of equal length are ranked inside each input partition and
    the partitions' counts, at most ``capacity`` rows each, are carried along, so that a length that a third of all pieces has
    is no hot key. Full windows are numbered after the packed ones.
    """
    spark = pieces.sparkSession
    numbered = keep(pieces.withColumn("__at", F.monotonically_increasing_id()), "pieces").withColumn("__part", F.shiftright("__at", 33))
    counts = keep(numbered.groupBy("length", "__part").agg(F.count(F.lit(1)).alias("n")), "packing-counts")
    totals = {int(r["length"]): r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    full = totals.pop(capacity, 0)
    plan = best_fit_decreasing(totals, capacity)
    made = max((w + (last - first + 1) // per for _, first, last, per, w, _, _ in plan), default=0)
    if full:
        plan.append((capacity, 0, full - 1, 1, made, 0, len(plan)))
    base = counts.select("length", "__part", F.coalesce(F.sum("n").over(
        W.partitionBy("length").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    # rank inside (partition, length) without a shuffle of whole partitions by length: rows carry their own place
    ranked = numbered.withColumn("__r", F.row_number().over(W.partitionBy("__part", "length").orderBy("__at")) - 1)
    ranked = ranked.join(base, ["length", "__part"]).withColumn("__rank", F.col("__base") + F.col("__r"))
    return place(ranked, plan, spark).drop("__at", "__part", "__r", "__base", "__rank")


def place(ranked: DataFrame, plan: list[tuple], spark: SparkSession) -> DataFrame:
    """Join pieces by length and rank to the plan, whose size depends on the capacity alone, not on the number of pieces."""
    by_length: dict[int, list[tuple]] = {}
    for row in plan:
        by_length.setdefault(row[0], []).append(row)
    kind = "length bigint, __steps array<struct<last:bigint,first:bigint,per:int,window:bigint,at:int>>"
    table = spark.createDataFrame([(k, [(r[2], r[1], r[3], r[4], r[5]) for r in rows]) for k, rows in by_length.items()], kind)
    joined = ranked.join(F.broadcast(table), "length")
    return _placed(joined, ranked.columns)


def _placed(joined: DataFrame, cols: list[str]) -> DataFrame:
    kind = T.StructType([*[joined.schema[c] for c in cols], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    step = F.element_at(F.filter("__steps", lambda s: (s["first"] <= F.col("__rank")) & (F.col("__rank") <= s["last"])), 1)
    out = joined.withColumn("__s", step)
    nth = F.col("__rank") - F.col("__s.first")
    return out.select(*cols, (F.col("__s.window") + F.floor(nth / F.col("__s.per"))).cast("bigint").alias("sequence_id"),
                      (F.col("__s.at") + nth % F.col("__s.per") * F.col("length")).cast("bigint").alias("offset")).to(kind)


def encode_pieces(docs: DataFrame, keys: list[str], text: str = "text", tokenizer: str | None = None, end_id: int | None = END_ID,
                  capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Token ids of each text with ``end_id`` after it, cut into pieces: ``keys``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``
    and, if wanted, ``ids``. The cut ids never leave the task unless asked for. Null and empty texts have the end id alone."""
    path = tokenizer or default_tokenizer(TOKENIZER)
    rows = docs.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], whole_text(text).alias("__text"))
    fields = [*rows.schema.fields[:-1], *(T.StructField(n, T.LongType(), False) for n in ("start", "length", "ids_crc32", "doc_tokens"))]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.LongType(), False), False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, True)
        tail = np.array([] if end_id is None else [end_id], dtype="<u4")
        for b in slices(batches, "__text"):
            who, start, length, crc, total, held = [], [], [], [], [], []
            for i, ids in enumerate(enc.texts(b.column("__text"))):
                ids = np.concatenate([ids, tail])
                for a in range(0, len(ids), capacity):
                    part = ids[a:a + capacity]
                    who.append(i)
                    start.append(a)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    total.append(len(ids))
                    if with_ids:
                        held.append(part.astype(np.int64))
            cols = b.select(b.schema.names[:-1]).take(pa.array(who, pa.int64())).columns
            cols += [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
            if with_ids:
                cols.append(pa.array(held, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])
        enc.forget()
    out = rows.mapInArrow(run, T.StructType(fields))
    return out.select(*[F.col(f"__k{i}").alias(k) for i, k in enumerate(keys)], *[f.name for f in fields[len(keys):]])


def padded(fill, capacity: int = CAPACITY):
    """Length of a sequence in a batch: the capacity, but a fill that is a power of two stays as it is."""
    return F.when(F.bit_count(fill) == 1, fill).otherwise(F.lit(capacity).cast("bigint"))


def pack_documents(docs: DataFrame, keys: list[str], text: str = "text", tokenizer: str | None = None, end_id: int | None = END_ID,
                   capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Every id of every row in exactly one piece of one sequence. Repeated and null keys are packed like any row; other columns
    of ``docs`` are not looked at; an empty table gives no rows."""
    return pack(encode_pieces(docs, keys, text, tokenizer, end_id, capacity, with_ids), capacity)


def sequences(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The sequences themselves: ``sequence_id``, ``n_tokens``, ``padded_length``, ``ids``; needs ``ids`` of the pieces. A window is bounded by its capacity."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    out = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("p"))
    return out.select("sequence_id", "n_tokens", padded(F.col("n_tokens"), capacity).alias("padded_length"), F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"))
