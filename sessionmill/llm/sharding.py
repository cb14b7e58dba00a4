"""Sharding by extendible hashing, in DataFrame operations.

A document's hash is 60 bits of its key's MD5. The directory is indexed by leading bits of it; a bucket whose documents exceed the byte
limit is split on its next bit and no other bucket is touched. Buckets that no bit can split, since all their documents have one
hash, are cut by a running sum of bytes. A document larger than the limit is alone in its shard.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.ordered import global_rank, running
from .common import keep, shared_dir, whole_text

LIMIT = 2 << 20   # bytes of a shard
BITS = 60
STEP = 15         # bits by which the directory is looked up at a time: at most 2**15 entries for each bucket that is too large


def hash_of(key: Column) -> Column:
    """60 bits of the MD5 of the key as text; null as empty text."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint")


def prefix(h: str, depth: int) -> Column:
    return F.shiftrightunsigned(h, BITS - depth)


def directory(hashes: DataFrame, limit: int = LIMIT) -> list[DataFrame]:
    """Directory pages: the i-th maps the first ``(i + 1) * STEP`` bits (``entry``) to the ``depth`` of their bucket, null where the bucket is too
    large even at that depth; the next page then goes on below it. ``hashes`` is a stored table of ``h`` and ``bytes``."""
    pages, rest = [], hashes
    for top in range(STEP, BITS + 1, STEP):
        base = top - STEP
        fine = keep(rest.groupBy(prefix("h", top).alias("entry")).agg(F.sum("bytes").alias("bytes")), "entries")
        above = F.explode(F.sequence(F.lit(base if base == 0 else base + 1), F.lit(top)))
        lines = fine.withColumn("depth", above).withColumn("up", F.expr(f"shiftrightunsigned(entry, {top} - depth)"))
        fits = lines.groupBy("depth", "up").agg(F.sum("bytes").alias("sum")).filter(F.col("sum") <= limit)
        found = lines.join(fits, ["depth", "up"]).groupBy("entry").agg(F.min("depth").alias("depth"))
        page = keep(fine.select("entry").join(found, "entry", "left"), "directory")
        pages.append(page)
        if top == BITS or page.filter("depth IS NULL").isEmpty():
            break
        rest = keep(rest.withColumn("entry", prefix("h", top)).join(page.filter("depth IS NULL"), "entry", "left_semi").drop("entry"), "hashes")
    return pages


def assign(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """``key``, ``bytes``, ``depth``, ``prefix`` (the bucket's bits), ``page`` (0 unless a hash is too large): a row for each row.

    Null keys share the hash of empty text and null texts have 0 bytes. Rows that repeat a key have one hash and are cut into
    pages if they exceed the limit together. An empty table gives no rows.
    """
    rows = docs.select(F.col(key).alias("k"), hash_of(F.col(key)).alias("h"), F.octet_length(whole_text(text)).cast("bigint").alias("bytes"))
    rows = keep(rows, "sizes")
    hashes = keep(rows.groupBy("h").agg(F.sum("bytes").alias("bytes")), "hashes")
    open_, placed = rows, []
    pages = directory(hashes, limit)
    for i, page in enumerate(pages):
        entry = prefix("h", (i + 1) * STEP)
        # the first page has a bounded size; those after it have rows only below buckets that were too large
        joined = open_.withColumn("entry", entry).join(F.broadcast(page) if i == 0 else page, "entry").drop("entry")
        placed.append(joined.filter("depth IS NOT NULL").withColumn("page", F.lit(0).cast("bigint")))
        open_ = joined.filter("depth IS NULL").drop("depth")
    if len(pages) * STEP == BITS and not open_.isEmpty():
        placed.append(_pages(open_, limit))
    out = reduce(DataFrame.unionByName, placed)
    bits = F.when(F.col("depth") > 0, F.lpad(F.conv(F.expr(f"shiftrightunsigned(h, {BITS} - depth)").cast("string"), 10, 2), F.col("depth"), F.lit("0"))).otherwise("")
    return out.select(F.col("k").alias(key), "bytes", F.col("depth").cast("int").alias("depth"), bits.alias("prefix"), "page")


def _pages(rows: DataFrame, limit: int) -> DataFrame:
    """Rows of hashes that are too large, cut where the bytes before them pass multiples of half the limit; rows of more than half
    the limit have pages of their own. So no page exceeds the limit unless one document does."""
    shared_dir(rows.sparkSession)
    ranked = global_rank(rows.withColumn("big", F.col("bytes") > limit // 2).withColumn("any", F.rand(7)), [F.col(c) for c in ("h", "big", "k", "bytes", "any")])
    summed = running(keep(ranked, "ranked"), ["h", "big"], "rank", {"upto": ("sum", F.col("bytes")), "nth": ("count", None)})
    small = F.floor((F.col("upto") - F.col("bytes")) / (limit - limit // 2)).cast("bigint")
    return summed.select("k", "h", "bytes", F.lit(BITS).alias("depth"), F.when(F.col("big"), -F.col("nth")).otherwise(small).alias("page"))


def write_shards(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """Write ``docs`` as Parquet, one folder per shard (``shard=<bits>-<page>``), and return the table as read back. Needs distinct keys."""
    where = assign(docs, key, text, limit).select(F.col(key).alias("__k"), F.concat_ws("-", "prefix", "page").alias("shard"))
    rows = docs.join(where, F.col(key).eqNullSafe(F.col("__k"))).drop("__k")
    rows.repartition("shard").write.partitionBy("shard").parquet(folder)
    return docs.sparkSession.read.schema(rows.schema).option("basePath", folder).parquet(folder)
