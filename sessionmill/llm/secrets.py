"""Secret scan: three patterns, and a randomness test battery with false-discovery control for other tokens.

A token is a maximal run of ``[A-Za-z0-9+/_-]`` of ``MIN_TOKEN`` or more characters outside the pattern spans. Its encoding is the
smallest alphabet that holds all its characters. Three tests compare it with a uniform source over that alphabet: chi-squared
of the symbol counts, the runs test about the alphabet's middle, and the lag-1 serial correlation. Each must pass at
``TEST_LEVEL``. The sum of the three statistics then gives the evidence against ordinary text: symbols of ordinary text are
uneven, which adds ``length * UNEVEN * (alphabet size)`` to the expected chi-squared, so a p-value gets small only for tokens long
enough to tell. Benjamini-Hochberg over all tokens of the table, separately in each length class, keeps the expected share
of false discoveries below ``fdr``.
"""
from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import keep, slices, whole_text

# The three base patterns with the least length of what counts.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
MIN_ASSIGN = 12

MIN_TOKEN = 20
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}" % MIN_TOKEN)
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALPHABETS = tuple((name, {c: i for i, c in enumerate(chars)}) for name, chars in (
    ("decimal", DIGITS), ("hex_lower", DIGITS + "abcdef"), ("hex_upper", DIGITS + "ABCDEF"), ("base32", UPPER + "234567"),
    ("base36_lower", DIGITS + LOWER), ("base36_upper", DIGITS + UPPER), ("base62", DIGITS + UPPER + LOWER),
    ("base64", UPPER + LOWER + DIGITS + "+/"), ("base64url", UPPER + LOWER + DIGITS + "-_")))
MIXED = ("mixed", {c: i for i, c in enumerate(DIGITS + UPPER + LOWER + "+/-_")})

TEST_LEVEL = 0.001
UNEVEN = 0.03    # by how much the sum of squared symbol shares of ordinary text exceeds that of a uniform source
BINS = 400       # p-values are counted in steps of a tenth of a power of ten
FDR = 0.01
CLASSES = (24, 32, 48, 64, 128)  # length classes are divided at these lengths

_PLACE = [T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]
_FOUND = T.StructType([T.StructField("__base", T.ArrayType(T.StructType(_PLACE))), T.StructField("__tested", T.ArrayType(T.StructType(
    [*_PLACE, T.StructField("encoding", T.StringType()), T.StructField("class", T.IntegerType()), T.StructField("bin", T.IntegerType())])))])


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the three patterns by start, then kind: code points, end exclusive."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def encoding_of(token: str) -> tuple[str, dict[str, int]]:
    """The smallest alphabet that holds the token."""
    chars = set(token)
    return next((a for a in ALPHABETS if chars <= a[1].keys()), MIXED)


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(token: str, alphabet: dict[str, int]) -> tuple[float, float, float]:
    """Chi-squared over the alphabet, and the squared z values of the runs test and of the serial correlation."""
    k, n = len(alphabet), len(token)
    x = [alphabet[c] for c in token]
    counts: dict[int, int] = {}
    for i in x:
        counts[i] = counts.get(i, 0) + 1
    chi = k / n * sum(c * c for c in counts.values()) - n
    high = [2 * i >= k for i in x]
    a = sum(high)
    b = n - a
    runs = 1 + sum(p != q for p, q in zip(high, high[1:]))
    if a and b:
        mean = 1 + 2 * a * b / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        z_runs = (runs - mean) / math.sqrt(var) if var > 0 else 0.0
    else:
        z_runs = math.sqrt(n)
    mid = sum(x) / n
    spread = sum((i - mid) ** 2 for i in x)
    z_serial = (sum((p - mid) * (q - mid) for p, q in zip(x, x[1:])) / spread * math.sqrt(n)) if spread else math.sqrt(n)
    return chi, z_runs ** 2, z_serial ** 2


def p_ordinary(token: str) -> tuple[str, float]:
    """Encoding, and how likely ordinary text of this length gives statistics as small as the token's; 1 if a test fails."""
    name, alphabet = encoding_of(token)
    k, n = len(alphabet), len(token)
    chi, runs, serial = battery(token, alphabet)
    df = k - 1
    z = ((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)) if chi > 0 else -9.0
    if normal_tail(z) < TEST_LEVEL or any(2 * normal_tail(math.sqrt(s)) < TEST_LEVEL for s in (runs, serial)):
        return name, 1.0
    extra = n * UNEVEN * k
    mean, var = df + 2 + extra, 2 * (df + 2) + 4 * extra
    return name, max(normal_tail((mean - (chi + runs + serial)) / math.sqrt(var)), 10.0 ** (-BINS / 10))


def length_class(n: int) -> int:
    return sum(n >= c for c in CLASSES)


def scan_text(text: str) -> tuple[list, list]:
    """(base spans, tested tokens) of one text."""
    base = base_spans(text)
    tested = []
    for m in TOKEN.finditer(text):
        start, end = m.span()
        if any(s < end and start < e for _, s, e in base):
            continue
        name, p = p_ordinary(m[0])
        tested.append({"kind": "random", "start": start, "end": end, "encoding": name, "class": length_class(end - start),
                       "bin": min(BINS, int(-10 * math.log10(p)))})
    return [{"kind": k, "start": s, "end": e} for k, s, e in base], tested


def _scan(text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base_t, test_t = (pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])),
                          pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                                              ("encoding", pa.string()), ("class", pa.int32()), ("bin", pa.int32())])))
        for b in slices(batches, text):
            found = [scan_text(t or "") for t in b.column(text).to_pylist()]
            cols = [c for n, c in zip(b.schema.names, b.columns) if n != text]
            names = [n for n in b.schema.names if n != text]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array([f[0] for f in found], base_t), pa.array([f[1] for f in found], test_t)],
                [*names, "__base", "__tested"])
    return run


def thresholds(tested: DataFrame, fdr: float = FDR) -> dict[int, int]:
    """Per length class the least bin that Benjamini-Hochberg discovers. Only counts per class and bin reach the driver:
    at most ``(len(CLASSES) + 1) * (BINS + 1)`` rows."""
    counts: dict[int, dict[int, int]] = {}
    for r in tested.groupBy("class", "bin").count().collect():
        counts.setdefault(r["class"], {})[r["bin"]] = r["count"]
    out = {}
    for c, bins in counts.items():
        total, above, best = sum(bins.values()), 0, None
        for b in sorted(bins, reverse=True):
            above += bins[b]
            if 10.0 ** (-b / 10) * total / above <= fdr:   # the largest p-value of the bin
                best = b
        if best is not None:
            out[c] = best
    return out


def find_secrets(docs: DataFrame, keys: list[str], text: str = "text", fdr: float = FDR) -> DataFrame:
    """``keys`` and ``base``, ``secrets``: arrays of (kind, start, end), the second with the discovered tokens added.

    One row for each row of ``docs``, repeated and null keys included; a null or empty text has no spans, and an empty table gives
    no rows. Columns other than ``keys`` and ``text`` are not looked at. Spans count code points of the whole text.
    """
    rows = docs.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], whole_text(text).alias("__text"))
    schema = T.StructType([*rows.schema.fields[:-1], *_FOUND.fields])
    found = keep(rows.mapInArrow(_scan("__text"), schema), "secrets")
    least = thresholds(found.select(F.explode("__tested").alias("t")).select("t.class", "t.bin"), fdr)
    hit = found.select("*", F.filter("__tested", lambda t: _meets(t, least)).alias("__hits"))
    order = F.array(*[F.lit(k) for k in KINDS])
    plain = F.transform("__hits", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    both = F.transform(F.array_sort(F.transform(F.concat("__base", plain), lambda s: F.struct(
        s["start"].alias("start"), F.array_position(order, s["kind"]).alias("at"), s["kind"].alias("kind"), s["end"].alias("end")))),
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return hit.select(*[F.col(f"__k{i}").alias(k) for i, k in enumerate(keys)], F.col("__base").alias("base"), both.alias("secrets"))


def _meets(t, least: dict[int, int]):
    out = F.lit(False)
    for c, b in sorted(least.items()):
        out = out | ((t["class"] == c) & (t["bin"] >= b))
    return out


def written(spans) -> F.Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def mask(text: str, spans: list, sign: str = "[SECRET]") -> str:
    """The text with each stretch of overlapping spans replaced."""
    out, at, end = [], 0, 0
    for s in spans:
        if s["start"] >= end:
            out += [text[at:s["start"]], sign]
        end = at = max(end, s["end"])
    return "".join(out) + text[at:]


def mask_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", fdr: float = FDR) -> DataFrame:
    """``docs`` with secrets replaced in the text; all rows and columns stay and a null text stays null."""
    cols = docs.columns
    found = find_secrets(docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("__row"), F.col(f"`{text}`").alias("__t")), ["__row"], "__t", fdr)

    def run(batches):
        for b in batches:
            texts, spans = b.column("t").to_pylist(), b.column("s").to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("r"), pa.array(
                [None if t is None else mask(t, s) if s else t for t, s in zip(texts, spans)], pa.string())], ["r", "t"])
    rows = found.select(F.col("__row").alias("r"), F.col(f"__row.`{text}`").alias("t"), F.col("secrets").alias("s"))
    out = rows.mapInArrow(run, T.StructType([rows.schema["r"], T.StructField("t", T.StringType())]))
    return out.select(*[F.col("t").alias(c) if c == text else F.col(f"r.`{c}`").alias(c) for c in cols])
