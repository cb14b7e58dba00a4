"""SimHash near-duplicates by a Gray-order hierarchical index.

Distinct fingerprints are dealt by pigeonhole: of ``RADIUS + 1`` blocks of bits two linked fingerprints share at least one, so a pair
meets in the group of that block's value, and a group with very many fingerprints is dealt again by the blocks of its other bits.
Inside a group fingerprints are sorted by Gray rank, in which neighbours share long bit patterns. Runs of them form nodes, runs of
nodes upper nodes; a node keeps the bits that all its members share and its parent does not have. A query goes down the levels with
its differences so far; a node above the radius is dropped with all its members, and one whose members must all be within the
radius is taken as a whole. Only links that are needed to keep each group's components together leave the task.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import keep, slices, whole_text

BITS, RADIUS, SHINGLE, SEED = 64, 4, 4, 42
FAN = 8                # members of a node
HOT = 50_000           # fingerprints of a group beyond which it is dealt again by other bits
QUERIES = 2_048        # queries that go down the index together
FRONTIER = 1_000_000   # (query, node) pairs held at a time
SIMILARITY = 0.8       # common share of shingles of near copies, where texts are compared
GROUPS, ROWS = 24, 5   # groups of minima: texts of that similarity share one with a probability above 0.9999
SIGMAS = 6.0           # deviations of equal minima below their expected number at which a pair is dropped
BLOCK = 1_024          # texts of a block of a large cell
BLOCK_SHINGLES = 1_000_000   # and their distinct shingles
GATHERED = 1_000_000   # shingles looked up together
PAIRS = 20_000         # pairs whose minima are compared together


def shingle_hashes(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of each word shingle, repeats included; of the whole sequence if it is shorter; none without a word."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: lower A-Z only, split at 0x20 and 0x09-0x0D
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(start[:len(words) - k + 1].tolist(), end[k - 1:].tolist())], dtype=np.uint64)


def majority(h: np.ndarray) -> int:
    """The bits set in over half of the hashes, as an unsigned number."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 65_536):
        ones += np.unpackbits(h[i:i + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def hash_bits(text: str, shingle: int = SHINGLE) -> int:
    """Fingerprint of one text as an unsigned number."""
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, keys: list[str], text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``keys`` and ``fp``, the fingerprint's bits as a signed long. Null and empty texts and texts of white space have 0."""
    rows = docs.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], whole_text(text).alias("__t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "__t"):
            fp = np.array([hash_bits(t, shingle) for t in b.column("__t").to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fp)], [*b.schema.names[:-1], "fp"])
    schema = rows.drop("__t").schema.add("fp", "long")
    return rows.mapInArrow(run, schema).select(*[F.col(f"__k{i}").alias(k) for i, k in enumerate(keys)], "fp")


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray sequence."""
    r = fp.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


class GrayIndex:
    """Index over groups of fingerprints; each group is a tree of its own."""

    def __init__(self, fp: np.ndarray, group: np.ndarray):
        """``group`` numbers the group of each fingerprint, from 0; inside a group fingerprints are distinct."""
        self.order = np.lexsort((gray_rank(fp), group))
        self.fp, g = fp[self.order], group[self.order]
        n = len(fp)
        pattern, shared = self.fp, np.full(n, 2**64 - 1, np.uint64)
        first = last = np.arange(n)
        self.levels = [(pattern, shared, first, last, first, last)]
        while True:  # nodes of the level above: runs of FAN nodes of one group
            start = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if n else np.zeros(0, np.int64)
            if len(start) == len(g):
                break
            within = np.arange(len(g)) - np.repeat(start, np.diff(np.concatenate([start, [len(g)]])))
            head = np.flatnonzero(within % FAN == 0)
            end = np.concatenate([head[1:], [len(g)]])
            shared = np.bitwise_and.reduceat(pattern & shared, head) | np.bitwise_and.reduceat(~pattern & shared, head)
            pattern, first, last, g = pattern[head] & shared, first[head], last[end - 1], g[head]
            self.levels.append((pattern, shared, first, last, head, end))
        self.root = np.repeat(np.arange(len(g)), last - first + 1)

    def links(self, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of positions (in the order given) whose components are those of all pairs within the radius."""
        n = len(self.fp)
        label, top = np.arange(n), len(self.levels) - 1
        free = [BITS - np.bitwise_count(level[1]).astype(np.int64) for level in self.levels]
        for level in range(1, top + 1):   # members of a node with so few free bits are all within the radius of each other
            _, _, first, last, _, _ = self.levels[level]
            close = free[level] <= radius
            for a, b in zip(first[close].tolist(), last[close].tolist()):
                label[a:b + 1] = label[a]
        for q0 in range(0, n, QUERIES):
            q = np.arange(q0, min(q0 + QUERIES, n))
            low = [np.minimum.reduceat(label, level[2]) for level in self.levels]
            high = [np.maximum.reduceat(label, level[2]) for level in self.levels]
            found_a, found_b = [], []
            work = [(top, q, self.root[q], np.zeros(len(q), np.int64), np.zeros(len(q), np.uint64))]
            while work:
                level, q, node, acc, above = work.pop()
                if len(q) > FRONTIER:
                    h = len(q) // 2
                    work += [(level, q[:h], node[:h], acc[:h], above[:h]), (level, q[h:], node[h:], acc[h:], above[h:])]
                    continue
                pattern, shared, first, last, head, end = self.levels[level]
                bits = shared[node]
                acc = acc + np.bitwise_count((self.fp[q] ^ pattern[node]) & bits & ~above)
                # each pair once, from its first member; a node that is one component with the query adds nothing
                live = (acc <= radius) & (last[node] > q) & ((low[level][node] != label[q]) | (high[level][node] != label[q]))
                q, node, acc, bits = q[live], node[live], acc[live], bits[live]
                whole = acc + free[level][node] <= radius   # a leaf, or a node whose members are all within the radius
                found_a.append(q[whole])
                found_b.append(last[node[whole]])
                q, node, acc, bits = q[~whole], node[~whole], acc[~whole], bits[~whole]
                if not len(q):
                    continue
                size = end[node] - head[node]
                total = np.cumsum(size)
                child = np.arange(total[-1]) + np.repeat(head[node] - (total - size), size)
                work.append((level - 1, np.repeat(q, size), child, np.repeat(acc, size), np.repeat(bits, size)))
            label = components(label, np.concatenate(found_a), np.concatenate(found_b))
        joined = np.flatnonzero(label != np.arange(n))
        return self.order[label[joined]], self.order[joined]


def components(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (the least position of each component) after linking a and b."""
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return label
        low, high = np.minimum(x, y), np.maximum(x, y)
        np.minimum.at(label, high, low)
        while (nxt := label[label]).tobytes() != label.tobytes():
            label = nxt
        a, b = a[x != y], b[x != y]


def _block(fp: Column, i: int, blocks: int, bits: int, shift: int = 0) -> Column:
    """Block i of the ``bits`` bits from ``shift`` on."""
    lo, hi = shift + bits * i // blocks, shift + bits * (i + 1) // blocks
    return F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1))


def near_links(fps: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """``a``, ``b``: links between distinct fingerprints (column ``fp``) that keep together what is linked within the radius."""
    blocks = radius + 1
    keyed = fps.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), _block(F.col("fp"), i, blocks, BITS).alias("v")) for i in range(blocks)])).alias("g")).select("fp", "g.i", "g.v")
    # counts per group: at most blocks * 2**13 rows whatever the table
    large = keyed.groupBy("i", "v").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot).select("i", "v", F.lit(True).alias("hot"))
    marked = keyed.join(F.broadcast(large), ["i", "v"], "left")
    # a hot group is dealt again: the bits outside its block have all the differences, so one of their blocks is shared as well
    outside = F.lit(0).cast("bigint")
    for i in range(blocks):
        lo, hi = BITS * i // blocks, BITS * (i + 1) // blocks
        low = F.col("fp").bitwiseAND(F.lit((1 << lo) - 1))
        packed = F.shiftleft(F.shiftrightunsigned("fp", hi), lo).bitwiseOR(low) if hi < BITS else low
        outside = F.when(F.col("i") == i, packed).otherwise(outside)
    rest = BITS - BITS // blocks - 1
    again = F.array(*[F.struct(F.lit(j).alias("j"), _block(F.col("__o"), j, blocks, rest + 1).alias("w")) for j in range(blocks)])
    once = F.array(F.struct(F.lit(-1).alias("j"), F.lit(0).cast("bigint").alias("w")))
    dealt = marked.withColumn("__o", outside).select("fp", "i", "v", F.explode(F.when(F.col("hot"), again).otherwise(once)).alias("s"))
    dealt = dealt.select("fp", "i", "v", "s.j", "s.w")
    parts = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    spread = dealt.repartition(parts, "i", "v", "j", "w").sortWithinPartitions("i", "v", "j", "w")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, names, size = [], None, 0

        def flush(tables, final: bool):
            """Links of the groups that are complete, and the rows of the last group if more may follow."""
            t = pa.Table.from_batches(tables)
            cols = [t.column(c).to_numpy() for c in ("i", "v", "j", "w")]
            change = np.zeros(t.num_rows, bool)
            for c in cols:
                change[1:] |= c[1:] != c[:-1]
            group = np.cumsum(change)
            stop = t.num_rows if final else int(np.searchsorted(group, group[-1]))
            fp = t.column("fp").to_numpy()
            a, b = GrayIndex(fp[:stop].view(np.uint64), group[:stop]).links(radius)
            out = pa.RecordBatch.from_arrays([pa.array(fp[:stop][a]), pa.array(fp[:stop][b])], ["a", "b"])
            return out, [x for x in t.slice(stop).to_batches()]
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= 100_000:
                out, held = flush(held, False)
                size = sum(x.num_rows for x in held)
                yield out
        if size:
            yield flush(held, True)[0]
    return spread.mapInArrow(run, "a long, b long").distinct()


def connected(links: DataFrame, names: tuple[str, str] = ("a", "b")) -> DataFrame:
    """``node``, ``root``: the smallest node of each node's component, by alternating large-star and small-star steps.

    Every step is a grouped minimum with map-side combine; each node hands its neighbours on to the smallest one, and the
    result of a step is written to the shared folder. Links shrink to stars and no node's neighbours are collected. The minima
    are written as well: the joins then stand above plain exchanges, and a large star is split at run time.
    """
    a, b = names
    u, v = F.col("u"), F.col("v")
    edges = keep(links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter(u != v).select(
        F.greatest(u, v).alias("u"), F.least(u, v).alias("v")), "links")
    seen = _content(edges)
    while True:
        # large star: every node links its larger neighbours to the smallest of its neighbours and itself
        both = edges.unionByName(edges.select(v.alias("u"), u.alias("v")))
        low = keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "minima")
        large = keep(both.filter(v > u).join(low, "u").select(v.alias("u"), F.col("m").alias("v")).distinct(), "links")
        # small star: every node links its smaller neighbours and itself to the smallest of them
        least = keep(large.groupBy("u").agg(F.min("v").alias("m")), "minima")
        small = large.join(least, "u").select(v.alias("u"), F.col("m").alias("v")).union(least)
        edges = keep(small.filter(u != v).distinct(), "links")
        now = _content(edges)
        if now == seen:
            return edges.select(u.alias("node"), v.alias("root"))
        seen = now


def _content(edges: DataFrame) -> tuple:
    """Number of links and an order-free digest of them."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def with_components(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``key``, ``fp``, ``component_id``: one row for each row of ``docs``.

    Rows of equal fingerprint are one node of the index, so copies cost nothing there. ``component_id`` is the smallest non-null key
    that links lead to; rows whose component has null keys alone have null. An empty table gives no rows.
    """
    rows = keep(fingerprints(docs, [key], text, shingle), "fingerprints")
    distinct = keep(rows.select("fp").distinct(), "distinct")
    stars = connected(near_links(distinct, radius)).withColumnRenamed("node", "fp")
    member = keep(distinct.join(stars, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "members")
    low = rows.groupBy("fp").agg(F.min(key).alias("low")).join(member, "fp").groupBy("root").agg(F.min("low").alias("component_id"))
    named = keep(member.join(low, "root").select("fp", "component_id"), "components")
    # rows of one hot fingerprint: this join stands alone above its two exchanges, so a large partition of rows is split at run time
    return rows.join(named, "fp").select(key, "fp", "component_id")


def minima(h: np.ndarray) -> np.ndarray:
    """``GROUPS * ROWS`` minima of the hashes under fixed random functions; zeros without a hash."""
    if not len(h):
        return np.zeros(GROUPS * ROWS, np.uint64)
    rng = np.random.default_rng(SEED)
    factor, add = (rng.integers(0, 2**63, GROUPS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
    low = np.full(GROUPS * ROWS, 2**64 - 1, np.uint64)
    with np.errstate(over="ignore"):
        mixed = h ^ (h >> np.uint64(29))
        for i in range(0, len(h), 2_048):
            low = np.minimum(low, (mixed[i:i + 2_048, None] * factor + add).min(axis=0))
        return (low ^ (low >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)


def minima_groups(low: np.ndarray) -> np.ndarray:
    """``GROUPS`` values, each of ``ROWS`` minima."""
    with np.errstate(over="ignore"):
        return (low.reshape(GROUPS, ROWS) * (2 * np.arange(ROWS, dtype=np.uint64) + np.uint64(1))).sum(axis=1, dtype=np.uint64).view(np.int64)


def similarity(a: str, b: str, shingle: int) -> float:
    """Common share of the distinct shingles of two texts; 1 if neither has any."""
    x, y = np.unique(shingle_hashes(a, shingle)), np.unique(shingle_hashes(b, shingle))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) + len(y) else 1.0


class Marks:
    """Numbers of distinct shingles and a byte of each minimum; tells which pairs may be similar enough. Equal minima have equal bytes,
    so a pair is lost only if its equal minima lie ``SIGMAS`` deviations below what its similarity leads to expect."""

    def __init__(self, size: np.ndarray, mark: pa.Array, least: float):
        m = GROUPS * ROWS
        self.size, self.mark, self.least = size, np.frombuffer(b"".join(mark.to_pylist()), np.uint8).reshape(-1, m), least
        self.equal = m * least - SIGMAS * np.sqrt(m * least * (1 - least))

    def may(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which of the listed pairs may be."""
        fit = np.minimum(self.size[a], self.size[b]) + 1e-9 >= self.least * np.maximum(self.size[a], self.size[b])
        fit[fit] = (self.mark[a[fit]] == self.mark[b[fit]]).sum(axis=1) >= self.equal
        return fit


class Shingles:
    """The distinct shingles of texts, numbered, to compare one text with many others at a time."""

    def __init__(self, size: np.ndarray, shingles: pa.ChunkedArray):
        self.size, self.start = size, np.cumsum(size) - size
        names, number = np.unique(np.frombuffer(b"".join(shingles.to_pylist()), np.uint64), return_inverse=True)
        self.number, self.own = number.astype(np.int32), np.zeros(len(names), bool)

    def common_share(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common share of the shingles of each listed pair; 1 if neither has any."""
        out = np.empty(len(a))
        order = np.argsort(a, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(a[order])) + 1):
            if not len(at):
                continue
            x = a[at[0]]
            mine = self.number[self.start[x]:self.start[x] + self.size[x]]
            self.own[mine] = True
            n = self.size[b[at]]
            for some in np.split(at, np.flatnonzero(np.diff(np.cumsum(n) // GATHERED)) + 1):
                n = self.size[b[some]]
                end = np.cumsum(n)
                place = np.arange(end[-1]) + np.repeat(self.start[b[some]] - (end - n), n)
                hits = np.concatenate([[0], np.cumsum(self.own[self.number[place]])])
                both = hits[end] - hits[end - n]
                union = self.size[x] + n - both
                out[some] = np.where(union > 0, both / np.maximum(union, 1), 1.0)
            self.own[mine] = False
        return out


def _sketched(rows: DataFrame, shingle: int) -> DataFrame:
    """``r1``, ``r2``, ``key``, ``t1``, ``t2``, ``fp``, ``groups``, ``size``, ``mark`` from ``r1``, ``r2``, ``key``, ``text``. Two hashes name a row, and two a text."""
    some = rows.select("r1", "r2", "key", F.xxhash64("text").alias("t1"), F.hash("text", F.length("text")).alias("t2"), F.col("text").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t"):
            hashes = [shingle_hashes(t, shingle) for t in b.column("t").to_pylist()]
            fp = np.array([majority(h) for h in hashes], dtype=np.uint64).view(np.int64)
            low = [minima(h) for h in hashes]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(fp), pa.array([minima_groups(m) for m in low], pa.list_(pa.int64())),
                 pa.array([len(np.unique(h)) for h in hashes], pa.int64()), pa.array([(m >> np.uint64(56)).astype(np.uint8).tobytes() for m in low], pa.binary())],
                [*b.schema.names[:-1], "fp", "groups", "size", "mark"])
    return some.mapInArrow(run, some.drop("t").schema.add("fp", "long").add("groups", T.ArrayType(T.LongType())).add("size", "long").add("mark", "binary"))


def _candidates(pairs: DataFrame, live: DataFrame, least: float) -> DataFrame:
    """``a``, ``b``: the distinct pairs of different components whose minima allow the similarity."""
    one = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    side = lambda i: live.select(F.col("id").alias(i), F.struct("root", "size", "mark").alias(f"m{i}"))
    both = one.join(side("a"), "a").join(side("b"), "b").filter("ma.root <> mb.root").select(
        "a", "b", "ma.size", "ma.mark", F.col("mb.size").alias("size2"), F.col("mb.mark").alias("mark2"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                n = np.arange(b.num_rows)
                marks = Marks(np.concatenate([b.column("size").to_numpy(), b.column("size2").to_numpy()]),
                              pa.concat_arrays([b.column("mark"), b.column("mark2")]), least)
                yield b.select(["a", "b"]).filter(pa.array(marks.may(n, n + b.num_rows)))
    return keep(both.mapInArrow(run, "a long, b long"), "pairs")


def _rest_links(live: DataFrame, rows: DataFrame, shingle: int, least: float) -> DataFrame:
    """``a``, ``b``: links between texts of different components, enough to join all that pairs which share a group of minima hold together.

    A cell whose texts are one component has none. In the others the texts of the largest component, in blocks of ``BLOCK``, meet only
    the blocks of the other texts, and these meet each other: a large group of copies costs as much as it has texts outside. A
    pair counts only in the first cell that holds both. Pairs never leave their task: the first pass tells which texts of a block
    have a pair whose minima allow the similarity, and for these alone the second gets the shingles and compares the pairs
    that its links have not joined yet. Both passes give at most a row for each text of a block.
    """
    lines = live.select("id", "root", "size", F.posexplode("groups").alias("g", "v"))
    roots = lines.groupBy("g", "v", "root").agg(F.count(F.lit(1)).alias("m"), F.sum("size").alias("s"))
    most = F.struct("m", "root")
    blocks = lambda n, s: F.ceil(F.greatest(n / BLOCK, s / BLOCK_SHINGLES)).cast("int")
    counts = keep(roots.groupBy("g", "v").agg(F.max_by("root", most).alias("big"), F.max("m").alias("m"), F.sum("m").alias("n"), F.max_by("s", most).alias("s"), F.sum("s").alias("ns"))
                  .filter("m < n").select("g", "v", "big", blocks(F.col("m"), F.col("s")).alias("bigs"),
                                          blocks(F.col("n") - F.col("m"), F.col("ns") - F.col("s")).alias("others")), "cell-sizes")
    upto = lambda n, make: F.transform(F.sequence(F.lit(0), F.col(n) - 1), make)
    cell = lambda row, col: F.struct(row.alias("row"), col.alias("col"))
    large, own = F.col("root") == F.col("big"), F.col("own")
    # blocks of the largest component have negative numbers
    block = F.when(large, -1 - F.pmod(F.xxhash64("id"), F.col("bigs"))).otherwise(F.pmod(F.xxhash64("id"), F.col("others"))).cast("int")
    cells = F.when(large, upto("others", lambda o: cell(own, o))).otherwise(F.concat(
        upto("bigs", lambda o: cell(-1 - o, own)), upto("others", lambda o: cell(F.least(o, own), F.greatest(o, own)))))
    keys = ["g", "v", "row", "col"]
    dealt = keep(lines.join(counts, ["g", "v"]).withColumn("own", block).withColumn("cell", F.explode(cells)).select(
        "id", "root", "own", "g", "v", "cell.row", "cell.col"), "cells")
    parts = int(live.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def listed(first: np.ndarray, n: int, own: np.ndarray, row: np.ndarray, col: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index pairs of each cell, about ``PAIRS`` together."""
        held, size = [], 0
        for start, stop in zip(first.tolist(), [*first[1:].tolist(), n]):
            at = np.arange(start, stop)
            left, right = at[own[at] == row[start]], at[own[at] == col[start]]
            step = max(1, PAIRS // max(1, len(right)))
            for i in range(0, len(left), step):
                a, b = (x.ravel() for x in np.meshgrid(left[i:i + step], right, indexing="ij"))
                if row[start] == col[start]:
                    a, b = a[a < b], b[a < b]
                held.append((a, b))
                size += len(a)
                if size >= PAIRS:
                    yield tuple(np.concatenate(x) for x in zip(*held))
                    held, size = [], 0
        if size:
            yield tuple(np.concatenate(x) for x in zip(*held))

    def allowed(t: pa.Table, label: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The pairs of each cell of different labels whose minima allow the similarity, each in its first cell; a label may change between them."""
        own, row, col, g = (t.column(k).to_numpy() for k in ("own", "row", "col", "g"))
        groups = t.column("groups").combine_chunks().flatten().to_numpy().reshape(-1, GROUPS)
        marks = Marks(t.column("size").to_numpy(), t.column("mark"), least)
        root = np.unique(t.column("root").to_numpy(), return_inverse=True)[1]
        for a, b in listed(_firsts(t, keys), t.num_rows, own, row, col):
            apart = label[root[a]] != label[root[b]]
            a, b = a[apart], b[apart]
            fit = marks.may(a, b)
            a, b = a[fit], b[fit]
            first = ~((groups[a] == groups[b]) & (np.arange(GROUPS) < g[a][:, None])).any(axis=1)
            if first.any():
                yield a[first], b[first]

    def by_cell(find):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size, inside = [], 0, 0
            for b in batches:
                held.append(b)
                size += b.num_rows
                inside += int(pa.compute.sum(b.column("size")).as_py() or 0)
                if size >= 16 * BLOCK or inside >= 2 * BLOCK_SHINGLES:
                    t = pa.Table.from_batches(held)
                    stop = int(_firsts(t, keys)[-1])
                    if stop:
                        yield find(t.slice(0, stop).combine_chunks())
                    rest = t.slice(stop)
                    held, size, inside = rest.to_batches(), rest.num_rows, int(pa.compute.sum(rest.column("size")).as_py() or 0)
            if size:
                yield find(pa.Table.from_batches(held).combine_chunks())
        return run

    def marked(t: pa.Table) -> pa.RecordBatch:
        """The rows of texts that have a pair."""
        hit = np.zeros(t.num_rows, bool)
        for a, b in allowed(t, np.arange(t.num_rows)):
            hit[a] = hit[b] = True
        some = t.select(["id", "root", "own", *keys]).filter(pa.array(hit)).combine_chunks()
        return pa.RecordBatch.from_arrays([c.combine_chunks() for c in some.columns], some.schema.names)

    def linked(t: pa.Table) -> pa.RecordBatch:
        """A link for each component that similar pairs join to another."""
        names, root = np.unique(t.column("root").to_numpy(), return_inverse=True)
        label, held = np.arange(len(names)), Shingles(t.column("size").to_numpy(), t.column("shingles"))
        for a, b in allowed(t, label):
            same = held.common_share(a, b) >= least
            label[:] = components(label, root[a[same]], root[b[same]])
        joined = np.flatnonzero(label != np.arange(len(names)))
        return pa.RecordBatch.from_arrays([pa.array(names[label[joined]]), pa.array(names[joined])], ["a", "b"])
    first = dealt.join(live.select("id", "groups", "size", "mark"), "id").repartition(parts, *keys).sortWithinPartitions(*keys)
    places = keep(first.mapInArrow(by_cell(marked), dealt.select("id", "root", "own", *keys).schema), "places")
    texts = _texts(places.select("id").distinct(), live, rows)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            found = [np.unique(shingle_hashes(t, shingle)).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(found, pa.binary())], ["id", "shingles"])
    sets = live.select("id", "groups", "size", "mark").join(texts.mapInArrow(hashed, "id long, shingles binary"), "id")
    second = places.join(sets, "id").repartition(parts, *keys).sortWithinPartitions(*keys)
    return keep(second.mapInArrow(by_cell(linked), "a long, b long"), "similar")


def _firsts(t: pa.Table, keys: list[str]) -> np.ndarray:
    """First row of each stretch of equal keys."""
    change = np.zeros(t.num_rows, bool)
    change[0] = True
    for k in keys:
        c = t.column(k).to_numpy()
        change[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(change)


def _texts(named: DataFrame, live: DataFrame, rows: DataFrame) -> DataFrame:
    """``id``, ``text`` of the texts with these ids, stored."""
    where = live.select("id", "r1", "r2").join(named, "id", "left_semi")
    return keep(rows.select("r1", "r2", "text").join(where, ["r1", "r2"]).select("id", "text").dropDuplicates(["id"]), "texts")


def _similar(pairs: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """The ``a``, ``b`` of distinct pairs whose texts are similar enough, compared shingle by shingle."""
    left = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    both = left.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "ta"):
            same = [similarity(x, y, shingle) >= least for x, y in zip(b.column("ta").to_pylist(), b.column("tb").to_pylist())]
            yield b.select(["a", "b"]).filter(pa.array(same, pa.bool_()))
    return keep(both.mapInArrow(run, "a long, b long"), "similar")


def _stars(live: DataFrame, anew: bool) -> DataFrame:
    """``a``, ``b``: each text with one text of each group of minima it is in, drawn by a hash. Drawn the same way in all groups, a text
    of a large group of copies meets one other; drawn anew for every group, it meets as many others as there are groups."""
    lines = live.select("id", F.posexplode("groups").alias("g", "v")).withColumn("r", F.xxhash64("id", "g") if anew else F.xxhash64("id"))
    first = keep(lines.groupBy("g", "v").agg(F.min_by("id", "r").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "stars")
    return lines.join(first, ["g", "v"]).filter("a <> id").select("a", F.col("id").alias("b"))


def _joined(live: DataFrame, links: list[DataFrame]) -> DataFrame:
    """``live`` with the ``root`` of each text's component."""
    stars = connected(reduce(DataFrame.unionByName, links)).select(F.col("node").alias("id"), F.col("root").alias("__root"))
    return keep(live.join(stars, "id", "left").withColumn("root", F.coalesce("__root", "id")).drop("__root"), "live")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, radius: int = RADIUS, least: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each group of near copies: the smallest non-null key's, a null key's only if the group has no other,
    and of equal keys that with the smallest hash of all columns. All columns stay; an empty table gives no rows.

    Near copies have ``least`` of their distinct shingles in common, and a group is all that such links reach; a null text is empty, and
    texts without a word are copies of each other. Equal texts are one first. The Gray-order index finds pairs of close
    fingerprints; texts of this similarity can differ in far more bits, so groups of minima of the same hashes find the others. A
    pair whose minima allow the similarity is compared by its shingles. Two searches compare each text with a drawn one of each
    of its cells, which joins most of a large group; then all pairs of every cell are looked at that are not in one component yet. No
    text leaves the search, so what stays does not depend on the draw.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*columns).alias("row"), F.col(f"`{key}`").alias("key"), whole_text(F.col(f"`{text}`")).alias("text"),
                       F.xxhash64(*columns).alias("r1"), F.hash(*columns).alias("r2"))
    order = F.struct(F.col("key").isNull().alias("none"), "key", "r1", "r2")
    one = _sketched(rows, shingle).groupBy("t1", "t2").agg(F.min(F.struct(order.alias("o"), "fp", "groups", "size", "mark")).alias("m"))
    live = keep(one.select("m.o.key", "m.o.r1", "m.o.r2", "m.fp", "m.groups", "m.size", "m.mark").withColumn("id", F.monotonically_increasing_id()), "texts-of-one")
    live = live.withColumn("root", F.col("id"))
    fp = keep(live.groupBy("fp").agg(F.min("id").alias("a")), "distinct")
    near = near_links(fp.select("fp"), radius)
    near = near.join(fp.select(F.col("fp").alias("a"), F.col("a").alias("x")), "a").join(
        fp.select(F.col("fp").alias("b"), F.col("a").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    equal = live.join(fp, "fp").filter("a <> id").select("a", F.col("id").alias("b"))

    def compared(pairs: DataFrame) -> DataFrame:
        named = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
        return _similar(pairs, _texts(named, live, rows), shingle, least)
    links = [compared(_candidates(near.unionByName(equal).unionByName(_stars(live, False)), live, least))]
    live = _joined(live, links)
    links.append(compared(_candidates(_stars(live, True), live, least)))
    live = _joined(live, links)
    links.append(_rest_links(live, rows, shingle, least))
    live = _joined(live, links)
    best = live.groupBy("root").agg(F.min(order).alias("o")).select("o.r1", "o.r2")
    found = rows.select("row", "r1", "r2").join(best, ["r1", "r2"], "left_semi")
    return found.dropDuplicates(["r1", "r2"]).select("row.*")
