"""Periodic runs of words by an online sparse diagonal DP.

A diagonal is a lag: at each word its match length is the number of words up to here that equal the word one lag earlier. A text
is read once; an earlier occurrence of a word opens its lag, every next word that occurs one lag earlier lengthens it, and a diagonal
that ends with ``LEAST`` words and ``PERIODS`` periods is emitted there as a run.

Opening a lag for every pair of equal words would be quadratic, so occurrences count in context. A run of period q matches over
max(``LEAST`` - q, 2 q) words or more, thus over the ``gram`` words of its scale: 16 for lags below 16, 32 for those below 32, and so on.
A scale looks only at grams that the scale before found repeated. Of a gram's earlier occurrences within its own length the nearest, at lag d,
opens a diagonal; those at lags up to gram - d cannot (by Fine and Wilf's theorem a run with such a lag has a smaller period), and
the few beyond open theirs. So few diagonals are active at a time, also where one word is repeated without end. Grams are compared by
hashes, which have no false negatives; the match lengths themselves are counted over words.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from .common import slices, whole_text

LEAST, PERIODS = 24, 3
GRAM = 16                                  # words over which each run of the first scale matches: LEAST * 2 / 3
_FACTOR, _MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93   # odd multipliers of the gram hashes

Run = tuple[int, int, int]                 # start, length, period
_RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))
_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def split_words(texts: pa.Array) -> tuple[pa.ListArray, np.ndarray, np.ndarray]:
    """Lists of words ``[^\\x20\\x09-\\x0D]+`` (an empty string in the list of a text without any), the words as numbers one after
    another, and where each text begins among them (one more than there are texts)."""
    split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.fill_null(texts, "")))
    flat = split.flatten()
    size = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    some = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    first = np.concatenate([[0], np.cumsum(size)])
    begin = np.concatenate([[0], np.cumsum(some)])[first]
    ids = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False)[some].astype(np.int64)
    return split, ids, begin


def openings(ids: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and lags at which a diagonal may open, by position; texts lie one after another and never meet."""
    size = np.diff(begin)
    first, length = np.repeat(begin[:-1], size), np.repeat(size, size)
    with np.errstate(over="ignore"):
        h, power, gram = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(_MIX), np.uint64(_FACTOR), 1
        h ^= h >> np.uint64(32)
        while gram < GRAM:
            longer = h.copy()
            longer[gram:] += h[:-gram] * power
            h, power, gram = longer, power * power, 2 * gram
        h += first.astype(np.uint64) * np.uint64(_MIX)
        at = np.flatnonzero((np.arange(len(ids)) - first >= GRAM - 1) & (length >= LEAST))
        h, low, where, lags = h[at], 1, [], []
        while len(at):
            order = np.argsort(h, kind="stable")
            same = np.concatenate([[False], h[order[1:]] == h[order[:-1]]])
            pos = at[order]
            group = np.cumsum(~same)
            near = np.flatnonzero(same)
            near = near[pos[near] - pos[near - 1] < gram]
            lag = pos[near] - pos[near - 1]
            where.append(pos[near[lag >= low]])
            lags.append(lag[lag >= low])
            # occurrences at lags over gram - d, one after another while they are within the gram
            place = group * (len(ids) + 1) + pos
            j = np.minimum(np.searchsorted(place, place[near] - (gram - lag)) - 1, near - 2)
            while len(near):
                ok = (j >= 0) & (group[j] == group[near])
                ok &= pos[near] - pos[j] < gram
                near, j = near[ok], j[ok]
                far = pos[near] - pos[j]
                where.append(pos[near[far >= low]])
                lags.append(far[far >= low])
                j = j - 1
            # the next scale: twice as many words, both halves repeated
            shared = same.copy()
            shared[:-1] |= same[1:]
            kept = np.sort(order[shared])
            at, h = at[kept], h[kept]
            fit = np.flatnonzero((at - first[at] >= 2 * gram - 1) & (length[at] >= PERIODS * gram))
            k = np.searchsorted(at, at[fit] - gram)
            fit, k = fit[at[k] == at[fit] - gram], k[at[k] == at[fit] - gram]
            at, h = at[fit], h[k] * power + h[fit]
            low, gram, power = gram, 2 * gram, power * power
    if not where:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, lag = np.concatenate(where), np.concatenate(lags)
    order = np.lexsort((i, lag))           # only the first of consecutive positions on a diagonal opens it
    i, lag = i[order], lag[order]
    opens = np.ones(len(i), bool)
    opens[1:] = (lag[1:] != lag[:-1]) | (i[1:] > i[:-1] + 1)
    i, lag = i[opens], lag[opens]
    order = np.lexsort((lag, i))
    return i[order], lag[order]


def smallest(words: list[int], start: int, period: int) -> bool:
    """Whether a run of three periods or more has no smaller one: that would divide it."""
    rest, p = period, 2
    while rest > 1:
        if p * p > rest:
            p = rest
        if rest % p == 0:
            d = period // p
            if words[start:start + period] == words[start + d:start + d + period]:
                return False
            while rest % p == 0:
                rest //= p
        p += 1
    return True


def sweep(words: list[int], at: list[int], lags: list[int]) -> list[Run]:
    """The runs of one text by start, then period, from the positions (of this text, ascending) and lags at which diagonals may open."""
    out: list[Run] = []
    active: dict[int, int] = {}            # lag -> words matched up to here

    def ended(lag: int, matched: int, end: int) -> None:
        length, start = matched + lag, end - matched - lag
        if length >= max(LEAST, PERIODS * lag) and smallest(words, start, lag):
            out.append((start, length, lag))
    i = k = 0
    while active or k < len(at):
        if not active:
            i = at[k]
        if i == len(words):
            break
        word = words[i]
        gone = []
        for lag in active:
            if words[i - lag] == word:
                active[lag] += 1
            else:
                gone.append(lag)
        for lag in gone:
            ended(lag, active.pop(lag), i)
        while k < len(at) and at[k] == i:
            lag, k = lags[k], k + 1
            if lag not in active:
                m = 0
                while i - m >= lag and words[i - m] == words[i - m - lag]:
                    m += 1
                if m:
                    active[lag] = m
        i += 1
    for lag, matched in active.items():
        ended(lag, matched, len(words))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(words: list[str], runs: list[Run]) -> str:
    """The words joined by spaces, without those that a run contains after its first period."""
    drop = bytearray(len(words))
    for start, length, period in runs:
        drop[start + period:start + length] = b"\x01" * (length - period)
    return " ".join(w for w, d in zip(words, drop) if not d)


def find_runs(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys``, ``runs`` (start, length, period by start, then period; words counted from 0) and ``collapsed``, the words joined by one space
    without what a run repeats.

    A run is a stretch of words of smallest period q, at least max(24, 3 q) long, that no neighbouring word extends. One row for each row of
    ``docs``, repeated and null keys included; null and empty texts have no runs and an empty ``collapsed``; an empty table gives no rows.
    Columns other than ``keys`` and ``text`` are not looked at.
    """
    rows = docs.select(*[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)], whole_text(F.col(f"`{text}`")).alias("__t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "__t"):
            split, ids, begin = split_words(b.column("__t"))
            at, lags = openings(ids, begin)
            found: list[list[Run]] = [[]] * b.num_rows
            joined = pc.binary_join(split, pa.scalar(" ", split.type.value_type)).to_pylist()
            owner = np.searchsorted(begin, at, side="right") - 1
            cut = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1], [True]])) if len(at) else np.zeros(1, np.int64)
            for x, y in zip(cut[:-1].tolist(), cut[1:].tolist()):
                n = int(owner[x])
                a, z = int(begin[n]), int(begin[n + 1])
                found[n] = sweep(ids[a:z].tolist(), (at[x:y] - a).tolist(), lags[x:y].tolist())
                if found[n]:
                    joined[n] = collapse(split[n].as_py(), found[n])
            runs = pa.array([[{"start": s, "length": m, "period": p} for s, m, p in f] for f in found], _ARROW)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], runs, pa.array(joined, pa.string())], [*b.schema.names[:-1], "runs", "collapsed"])
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("runs", _RUNS), T.StructField("collapsed", T.StringType())])
    found = rows.mapInArrow(run, schema)
    return found.select(*[F.col(f"__k{i}").alias(k) for i, k in enumerate(keys)], "runs", "collapsed")
