"""Token-id files with a minimal perfect hash index.

A shard is one binary file: header (magic, documents, ids, bytes of an id, index levels, distinct keys), the raw little-endian unsigned
ids, of two bytes where the vocabulary fits and four where it does not, the documents in file order (key, first id, number of ids), and the index. The index is a minimal perfect hash: level by level, keys that
are alone in their slot of a bit array are settled, the rest go on to the next level; a key's number is the count of bits set before
its own. At that number the index holds a fingerprint of the key and the place of its document, so a lookup takes a few hashes and
one read of the payload, and an absent key is rejected by its fingerprint. Files of a table hold ascending keys; names carry the
shard's place. A file is written under another name and renamed, and has the same bytes when a lost task is run again.
"""
from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .chunks import default_tokenizer, encoder
from .common import fresh_path, keep, make_folder, slices, whole_text

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
SHARD_IDS = 4 << 20       # ids after which a file is closed
PARTITION_ROWS = 8_192    # rows to a range of keys; bounds no result
MAGIC = b"IDSHARD1"
HEADER = struct.Struct("<8sQQIII")
NO_KEY = -(1 << 63)       # the key under which a null key is filed; it cannot be looked up


def _mix(keys: np.ndarray, salt: int) -> np.ndarray:
    """64-bit finaliser over keys and salt."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: ``levels`` are (first slot, number of slots), ``bits`` the settled slots."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.rank = np.concatenate([[0], np.cumsum(bits)]).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> "PerfectHash":
        sizes, levels, left = [], [], keys
        while len(left):
            m = max(2 * len(left), 8)
            slot = (_mix(left, len(sizes) + 1) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(slot, minlength=m) == 1
            sizes.append(m)
            levels.append(alone)
            left = left[~alone[slot]]
        return cls(sizes, np.concatenate(levels) if levels else np.zeros(0, bool))

    def number(self, keys: np.ndarray) -> np.ndarray:
        """0..n-1 for the keys it was built from; any number or -1 for others."""
        out, open_, first = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, m in enumerate(self.sizes):
            slot = first + (_mix(keys[open_], level + 1) % np.uint64(m)).astype(np.int64)
            hit = self.bits[slot]
            out[open_[hit]] = self.rank[slot[hit]]
            open_, first = open_[~hit], first + m
        return out


def shard_bytes(keys: np.ndarray, lengths: np.ndarray, ids: np.ndarray, width: int = 4) -> bytes:
    """One file with ids of ``width`` bytes. Equal keys stand next to each other; the index leads to the first of them."""
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype("<u8") if len(keys) else np.zeros(0, "<u8")
    distinct, place = np.unique(keys, return_index=True)
    mph = PerfectHash.build(distinct)
    at = mph.number(distinct)
    prints, places = np.zeros(len(distinct), "<u4"), np.zeros(len(distinct), "<u4")
    prints[at] = (_mix(distinct, 0) >> np.uint64(32)).astype("<u4")
    places[at] = place
    return b"".join([HEADER.pack(MAGIC, len(keys), len(ids), width, len(mph.sizes), len(distinct)), ids.astype(f"<u{width}").tobytes(),
                     keys.astype("<i8").tobytes(), first.tobytes(), lengths.astype("<u4").tobytes(),
                     np.array(mph.sizes, "<u4").tobytes(), np.packbits(mph.bits).tobytes(), prints.tobytes(), places.tobytes()])


class Shard:
    """A file's bytes: ids of any document by its place or its key."""

    def __init__(self, data):
        magic, docs, n_ids, width, n_levels, n_keys = HEADER.unpack_from(data, 0)
        if magic != MAGIC:
            raise ValueError("not a token-id shard")
        at = HEADER.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out
        self.ids, self.keys, self.first, self.lengths = take(f"<u{width}", n_ids), take("<i8", docs), take("<u8", docs), take("<u4", docs)
        sizes = take("<u4", n_levels).tolist()
        self.mph = PerfectHash(sizes, np.unpackbits(take("u1", -(-sum(sizes) // 8)), count=sum(sizes)).astype(bool))
        self.prints, self.places = take("<u4", n_keys), take("<u4", n_keys)

    def document(self, place: int) -> np.ndarray:
        a = int(self.first[place])
        return self.ids[a:a + int(self.lengths[place])].astype("<u4")

    def first_places(self, keys: np.ndarray) -> np.ndarray:
        """Where the first document of each key lies: the perfect hash gives a slot, its fingerprint tells strangers, the key decides; -1 if absent."""
        if not len(self.places):
            return np.full(len(keys), -1, np.int64)
        slot = self.mph.number(keys)
        known = (slot >= 0) & (self.prints[slot] == (_mix(keys, 0) >> np.uint64(32)).astype("<u4"))
        place = np.where(known, self.places[slot].astype(np.int64), 0)
        return np.where(known & (self.keys[place] == keys), place, -1)

    def get(self, key: int) -> list[np.ndarray]:
        """Ids of the documents with this key; none if the key is absent."""
        if not len(self.places):
            return []
        k = np.array([key], np.int64)
        n = int(self.mph.number(k)[0])
        if n < 0 or int(self.prints[n]) != int(_mix(k, 0)[0] >> np.uint64(32)):
            return []
        place = int(self.places[n])
        if int(self.keys[place]) != key:   # another key of equal fingerprint
            return []
        out = []
        while place < len(self.keys) and int(self.keys[place]) == key:
            out.append(self.document(place))
            place += 1
        return out


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if ":" in folder.split("/")[0] else "file://" + folder)


def write_files(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = END_ID,
                shard_ids: int = SHARD_IDS) -> DataFrame:
    """Write the shards; returns ``name``, ``first_key``, ``last_key``, ``n_docs``, ``n_ids`` and ``base`` (ids in all shards before).

    Keys are whole numbers; rows of one key come in the order of their text's hash, null keys first. Null and empty texts have the
    end id alone. An empty table writes no file. Rows are dealt by ranges of (key, hash of text, a fixed random number), so that
    even one key that a third of all rows have is spread over many tasks.
    """
    path = tokenizer or default_tokenizer(TOKENIZER)
    target = folder
    make_folder(docs.sparkSession, folder)
    rows = docs.select(F.coalesce(F.col(key).cast("bigint"), F.lit(NO_KEY)).alias("k"), F.xxhash64(whole_text(text)).alias("h"),
                       F.rand(9).alias("r"), whole_text(text).alias("t"))
    parts = max(1, rows.sparkSession.sparkContext.defaultParallelism, -(-docs.count() // PARTITION_ROWS))
    dealt = rows.repartitionByRange(parts, "k", "h", "r").sortWithinPartitions("k", "h", "r").select("k", "t", F.spark_partition_id().alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, False)
        store, root = _store(target)
        tail = np.array([end_id], "<u4")
        width = 2 if max(enc.tok.get_vocab_size() - 1, end_id) < 1 << 16 else 4
        keys, held, size, part, made = [], [], 0, 0, 0

        def close():
            nonlocal keys, held, size, made
            lengths = np.array([len(x) for x in held], np.int64)
            name = f"{part:06d}-{made:06d}.ids"
            temp = f"{root}/.{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(temp) as out:
                out.write(shard_bytes(np.array(keys, np.int64), lengths, np.concatenate(held), width))
            store.move(temp, f"{root}/{name}")
            row = pa.RecordBatch.from_arrays([pa.array([x]) for x in (name, keys[0], keys[-1], len(keys), int(lengths.sum()))],
                                             ["name", "first_key", "last_key", "n_docs", "n_ids"])
            keys, held, size, made = [], [], 0, made + 1
            return row
        for b in slices(batches, "t"):
            part = b.column("p")[0].as_py()
            for k, ids in zip(b.column("k").to_pylist(), enc.texts(b.column("t"))):
                keys.append(k)
                held.append(np.concatenate([ids, tail]))
                size += len(ids) + 1
                if size >= shard_ids:
                    yield close()
        if keys:
            yield close()
        enc.forget()
    shards = keep(dealt.mapInArrow(run, "name string, first_key long, last_key long, n_docs long, n_ids long"), "shards")
    # one row per file, thousands of documents each; the running sum is over files only
    base = F.sum("n_ids").over(W.orderBy("name").rowsBetween(W.unboundedPreceding, -1))
    return shards.withColumn("base", F.coalesce(base, F.lit(0)))


def read_files(spark: SparkSession, folder: str, shards: DataFrame) -> DataFrame:
    """A row per document from the files: ``key``, ``start``, ``n_tokens``, ``ids_crc32``, each found by its key through its file's index. Files are read
    by Spark, one to a row."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ids").load(folder).select(
        F.element_at(F.split("path", "/"), -1).alias("name"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column("name"), b.column("content")):
                s = Shard(data.as_buffer())
                # every key is looked up in the index; the documents of a repeated one follow its first
                keys, times = np.unique(s.keys, return_counts=True)
                first = s.first_places(keys)
                if (first < 0).any():
                    raise ValueError(f"{name.as_py()}: the index does not lead to its own keys")
                at = np.repeat(first - np.cumsum(times) + times, times) + np.arange(times.sum())
                crc = [zlib.crc32(s.document(i).tobytes()) for i in at.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name.as_py()] * len(crc), pa.string()), pa.array(np.repeat(keys, times), pa.int64()), pa.array(s.first[at].astype(np.int64)),
                     pa.array(s.lengths[at].astype(np.int64)), pa.array(crc, pa.int64())], ["name", "key", "at", "n_tokens", "ids_crc32"])
    rows = files.mapInArrow(run, "name string, key long, at long, n_tokens long, ids_crc32 long")
    return rows.join(shards.select("name", "base"), "name").select(
        F.when(F.col("key") != NO_KEY, F.col("key")).alias("key"), (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def lookup(folder: str, shards: list, key: int) -> list[np.ndarray]:
    """Ids of the documents with this key, from the one or few shards (rows of ``write_files``) whose range holds it."""
    store, root = _store(folder)
    out = []
    for s in shards:
        if s["first_key"] <= key <= s["last_key"]:
            with store.open_input_file(f"{root}/{s['name']}") as f:
                out += Shard(f.read_buffer()).get(key)
    return out


def round_trip(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write the table's files below the shared folder and read them back."""
    folder = fresh_path(docs.sparkSession, "ids")
    shards = write_files(docs, folder, key, text, tokenizer, end_id)
    return read_files(docs.sparkSession, folder, shards).withColumnRenamed("key", key)
