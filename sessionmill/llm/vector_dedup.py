"""Embedding near-duplicates by randomised-rotation binary codes with stored correction factors.

Vectors are scaled to unit length and rotated at random. The signs of the rotated vector are its code; the stored factor is
``<code, vector>``, the inner product of the vector with the unit vector its code stands for. For a query q the quotient
``<code, q> / factor`` estimates ``<vector, q>`` without bias, and its error has a standard deviation of at most
``sqrt((1 - factor**2) / factor**2 * (1 - <vector, q>**2) / (d - 1))``. A pair whose estimate lies ``SIGMAS`` deviations below the
threshold is dropped; every other pair is recomputed exactly in double precision.

Equal vectors of one label are one class first. Pairs to estimate come from ``BANDS`` groupings of the classes by ``BAND_BITS`` signs
of further random directions: at the threshold two vectors share one grouping's signs with probability (1 - angle / pi) **
BAND_BITS, so a pair escapes all of them with a probability below 1e-4, and a closer pair far more rarely. In a group a
pair counts only in the first grouping that holds both, so links can be summed. Groups leave the task as counts per vector and the
links that keep components together, never as pairs; a large group is dealt in blocks against blocks.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import keep
from .simhash import components, connected

THRESHOLD = 0.98
BANDS, BAND_BITS = 32, 20
SIGMAS = 6.0
SEED = 10
BLOCK = 1_024      # vectors of a block
FEW = 64           # rows of cells whose pairs are listed together
TOGETHER = 16_384  # rows taken together, whole cells


@lru_cache(maxsize=8)
def directions(d: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """The rotation (d x d) and the directions of the groupings (d x BANDS * BAND_BITS)."""
    rng = np.random.default_rng((seed, d))
    rotation, _ = np.linalg.qr(rng.standard_normal((d, d)))
    return rotation, rng.standard_normal((d, BANDS * BAND_BITS))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, first by the largest component so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotated vectors, sign codes (-1 or 1 over sqrt(d)) and factors of unit vectors."""
    rotation, _ = directions(x.shape[1])
    turned = x @ rotation
    signs = np.where(turned >= 0, 1.0, -1.0) / np.sqrt(x.shape[1])
    return turned, signs, (signs * turned).sum(axis=1)


def band_signs(x: np.ndarray) -> np.ndarray:
    """The value of each grouping: n x BANDS."""
    _, more = directions(x.shape[1])
    bits = (x @ more >= 0).reshape(len(x), BANDS, BAND_BITS)
    return bits @ (1 << np.arange(BAND_BITS))


class Coded:
    """Unit vectors with rotated forms, codes, factors, and the least estimate at which a pair may reach the threshold."""

    def __init__(self, x: np.ndarray, threshold: float = THRESHOLD):
        self.x, self.threshold = x, threshold
        self.turned, self.signs, self.factor = codes(x)
        error = np.sqrt(np.maximum(1 - self.factor ** 2, 0) * max(1 - threshold ** 2, 0) / max(x.shape[1] - 1, 1)) / self.factor
        # with one component a code says nothing, so every pair is recomputed
        self.least = threshold - SIGMAS * error - 1e-9 if x.shape[1] > 1 else np.full(len(x), -np.inf)

    def exact(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hit = np.einsum("ij,ij->i", self.x[a], self.x[b]) >= self.threshold
        return a[hit], b[hit]

    def between(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Linked pairs of a row of ``a`` and a row of ``b``."""
        estimate = (self.signs[a] @ self.turned[b].T) / self.factor[a][:, None]
        i, j = np.nonzero(estimate >= self.least[a][:, None])
        return self.exact(a[i], b[j])

    def among(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Linked pairs of the listed ones."""
        estimate = np.einsum("ij,ij->i", self.signs[a], self.turned[b]) / self.factor[a]
        may = estimate >= self.least[a]
        return self.exact(a[may], b[may])


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, d)


def classes(rows: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """A row per distinct vector of a label: ``low`` (least key), ``copies``, ``label``, ``v``. Only vectors that can link."""
    good = F.col(label).isNotNull() & F.col(vector).isNotNull() & F.col(key).isNotNull()
    odd = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    zero = ~F.exists(vector, lambda c: c != 0)
    usable = rows.filter(good & ~odd & ~zero).select(F.col(key).alias("id"), F.col(label).alias("label"), _doubles(vector).alias("v"))
    return usable.groupBy("label", "v").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("copies"))


def _doubles(vector: str):
    """Components as doubles; adding 0 turns -0.0 into 0.0."""
    return F.transform(vector, lambda c: c.cast("double") + F.lit(0.0))


def class_links(cls: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """From stored classes (``cls``, ``copies``, ``label``, ``v``): (``cls``, ``n``) numbers of vectors of other classes that are linked,
    and (``a``, ``b``) links that keep components together."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.array([len(v) for v in b.column("v")], np.int64)
            for d in np.unique(size).tolist():
                some = b.filter(pa.array(size == d))
                band = band_signs(unit(_matrix(some.column("v"), d)))
                n = len(band)
                for k in range(BANDS):
                    yield pa.RecordBatch.from_arrays(
                        [some.column("cls"), some.column("label"), pa.array(np.full(n, d, np.int32)), pa.array(np.full(n, k, np.int32)),
                         pa.array(band[:, k].astype(np.int32))], ["cls", "label", "d", "band", "sign"])
    signs = keep(cls.select("cls", F.col("label").cast("string").alias("label"), "v").mapInArrow(
        deal, "cls long, label string, d int, band int, sign int"), "vector-signs")
    group = ["label", "d", "band", "sign"]
    # groups of one vector have no pairs; a group of many blocks is dealt to (block, block) cells, a row to as many as there are blocks
    counts = keep(signs.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumn(
        "blocks", F.ceil(F.col("n") / BLOCK).cast("int")).drop("n"), "groups")
    own = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
    cell = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(
        F.least(o, F.col("own")).alias("row"), F.greatest(o, F.col("own")).alias("col")))
    cells = keep(signs.join(counts, group).withColumn("own", own).withColumn("cell", F.explode(cell)).select(
        *group, "cls", "own", "cell.row", "cell.col"), "cells")
    keys = [*group, "row", "col"]
    parts = int(cls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = cells.join(cls.select("cls", "copies", "v"), "cls").repartition(parts, *keys).sortWithinPartitions(*keys)

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Whole cells together, about ``TOGETHER`` rows or one larger cell, which has the rows of two blocks."""
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= TOGETHER:
                t = pa.Table.from_batches(held)
                stop = int(_cells(t)[-1])
                if stop:
                    yield t.slice(0, stop)
                held, size = t.slice(stop).to_batches(), t.num_rows - stop
        if size:
            yield pa.Table.from_batches(held)

    def _cells(t: pa.Table) -> np.ndarray:
        """First row of each cell."""
        change = np.ones(t.num_rows, bool)
        same = np.ones(t.num_rows - 1, bool)
        for k in keys:
            c = t.column(k).combine_chunks()
            c = (c.dictionary_encode().indices if k == "label" else c).to_numpy(zero_copy_only=False)
            same &= c[1:] == c[:-1]
        change[1:] = ~same
        return np.flatnonzero(change)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in tables(batches):
            dims = t.column("d").to_numpy()
            for d in np.unique(dims).tolist():
                some = t.filter(pa.array(dims == d)).combine_chunks()
                out = _links(some, _cells(some), d)
                if out is not None:
                    yield out

    def _links(t: pa.Table, first: np.ndarray, d: int) -> pa.RecordBatch | None:
        x = unit(_matrix(t.column("v").combine_chunks(), d))
        coded, sign = Coded(x, threshold), band_signs(x)
        ids, copies, own, row, col, band = (t.column(k).to_numpy() for k in ("cls", "copies", "own", "row", "col", "band"))
        size = np.diff(np.concatenate([first, [len(x)]]))
        n, label = np.zeros(len(x), np.int64), np.arange(len(x))

        def add(a: np.ndarray, b: np.ndarray) -> None:
            nonlocal label
            # a pair counts only in the first grouping that holds both
            early = ((sign[a] == sign[b]) & (np.arange(BANDS) < band[a][:, None])).any(axis=1)
            a, b = a[~early], b[~early]
            np.add.at(n, a, copies[b])
            np.add.at(n, b, copies[a])
            label = components(label, a, b)
        for s in np.unique(size[(size > 1) & (size <= FEW)]).tolist():
            i, j = np.triu_indices(s, 1)
            start = first[size == s]
            step = max(1, 200_000 // len(i))
            for at in range(0, len(start), step):
                a, b = ((start[at:at + step, None] + k).ravel() for k in (i, j))
                fit = (row[a] == col[a]) | (own[a] != own[b])
                add(*coded.among(a[fit], b[fit]))
        for start, s in zip(first[size > FEW].tolist(), size[size > FEW].tolist()):
            rows = np.arange(start, start + s)
            left, right = rows[own[rows] == row[start]], rows[own[rows] == col[start]]
            for i in range(0, len(left), BLOCK):
                for j in range(0, len(right), BLOCK):
                    a, b = coded.between(left[i:i + BLOCK], right[j:j + BLOCK])
                    fit = (a < b) if row[start] == col[start] else np.ones(len(a), bool)
                    add(a[fit], b[fit])
        hit = np.flatnonzero(n > 0)
        if not len(hit):
            return None
        return pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(n[hit]), pa.array(ids[label[hit]])], ["cls", "n", "root"])
    found = keep(spread.mapInArrow(run, "cls long, n long, root long"), "vector-links")
    return found.groupBy("cls").agg(F.sum("n").alias("n")), found.filter("cls <> root").select(F.col("cls").alias("a"), F.col("root").alias("b")).distinct()


def link_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """``key``, ``n_links``, ``component_id``, ``kept``: one row for each row.

    Vectors link when their labels are equal and not null and their cosine is the threshold or more; a null, empty or zero vector, one with
    a null or non-finite component, and one with a null key links with nothing and is its own component. Vectors of different
    lengths do not link. Rows that repeat a key count as vectors of their own. An empty table gives no rows.
    """
    cls = keep(classes(rows, key, vector, label).withColumn("cls", F.monotonically_increasing_id()), "classes")
    counts, links = class_links(cls, threshold)
    roots = connected(links).withColumnRenamed("node", "cls")
    member = keep(cls.select("cls", "low").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls")), "members")
    low = member.groupBy("root").agg(F.min("low").alias("component_id"))
    named = member.join(low, "root").select("cls", "component_id").join(counts, "cls", "left").join(cls, "cls")
    named = keep(named.select("label", F.xxhash64("v").alias("h"), "v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                              "component_id"), "named-classes")
    exact = _doubles(vector)
    own = rows.select(F.col(key).alias("k"), F.col(label).alias("l"), exact.alias("x"), F.xxhash64(exact).alias("g"))
    # above two plain exchanges: rows of one very common vector are split at run time
    out = own.join(named, (F.col("l") == F.col("label")) & (F.col("g") == F.col("h")) & (F.col("x") == F.col("v")) & F.col("k").isNotNull(), "left")
    component = F.coalesce("component_id", "k")
    return out.select(F.col("k").alias(key), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
                      F.col("k").eqNullSafe(component).alias("kept"))
