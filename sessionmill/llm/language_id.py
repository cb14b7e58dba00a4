"""Language identification: a bidirectional gated recurrent network over bytes.

Both directions read a window of bytes; every position gets language probabilities, and a document's are the mean over all its
positions. The network is trained in numpy by backpropagation through time on windows of a sample: of each language the
``PER_LANG`` learnable documents of least hash, ``WINDOWS`` windows each. Prediction reads every byte of every text.
"""
from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..operators.ordered import ranked
from .common import slices, whole_text

PER_LANG = 400        # documents of a language that the network is fitted on, at most
WINDOWS, LENGTH = 8, 64
HIDDEN, STEPS, BATCH, RATE, SEED = 10, 260, 192, 0.02, 6
READ = 128            # bytes of a window when predicting
TOGETHER = 1_024      # windows read at the same time
UNKNOWN = "und"


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _squash(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|) in place: the network's bounded function for candidates and, moved to 0..1, for gates. Its slope is (1 - |y|)**2.
    Unlike tanh it costs a few additions, which decides the time to read a corpus."""
    d = np.abs(x)
    d += 1
    x /= d
    return x


class BiGru:
    """Per direction: ``e`` 256 x 3H inputs of each byte (update, reset, candidate), ``u`` H x 3H; ``w`` 2H x languages and ``c``."""

    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = SEED):
        rng = np.random.default_rng(seed)
        f = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
        self.langs, self.h = langs, hidden
        self.p = {"ef": f(256, 3 * hidden), "eb": f(256, 3 * hidden), "uf": f(hidden, 3 * hidden), "ub": f(hidden, 3 * hidden),
                  "w": f(2 * hidden, len(langs)), "c": np.zeros(len(langs), np.float32)}

    def _run(self, x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States of direction ``d`` (f or b) over x (time x windows)."""
        e, u, h2 = self.p["e" + d], self.p["u" + d], 2 * self.h
        e1, e2, u1, u2 = (np.ascontiguousarray(m) for m in (e[:, :h2], e[:, h2:], u[:, :h2], u[:, h2:]))
        state = np.zeros((x.shape[1], self.h), np.float32)
        out = np.empty((*x.shape, self.h), np.float32)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            gates = np.take(e1, x[t], axis=0, mode="clip")
            gates += state @ u1
            gates = _squash(gates)
            gates *= 0.5
            gates += 0.5
            z, r = gates[:, :self.h], gates[:, self.h:]
            a = state @ u2
            n = np.take(e2, x[t], axis=0, mode="clip")
            n += r * a
            n = _squash(n)
            if keep is not None:
                keep.append((t, state, z, r, n, a))
            new = np.subtract(state, n, out=out[t])
            new *= z
            new += n
            state = new
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Language probabilities of every position of x (time x windows)."""
        p = self._run(x, "f") @ self.p["w"][:self.h]
        p += self._run(x, "b") @ self.p["w"][self.h:]
        p += self.p["c"]
        np.minimum(p, 80, out=p)   # states are within -1..1, so nothing else can overflow
        np.exp(p, out=p)
        p /= (p @ np.ones((p.shape[2], 1), p.dtype))
        return p

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy over all positions; x time x windows, y a language number per window."""
        caches = {"f": [], "b": []}
        both = np.concatenate([self._run(x, d, caches[d]) for d in "fb"], axis=2)
        p = both @ self.p["w"] + self.p["c"]
        p = np.exp(p - p.max(axis=2, keepdims=True))
        p /= p.sum(axis=2, keepdims=True)
        p[:, np.arange(len(y)), y] -= 1
        p /= p.shape[0] * p.shape[1]
        g = {"w": np.einsum("tnh,tnl->hl", both, p), "c": p.sum(axis=(0, 1))}
        back = p @ self.p["w"].T
        for d, part in (("f", back[:, :, :self.h]), ("b", back[:, :, self.h:])):
            u = self.p["u" + d]
            gu, inputs, dh = np.zeros_like(u), np.empty((*x.shape, 3 * self.h), np.float32), np.zeros((x.shape[1], self.h), np.float32)
            for t, state, z, r, n, a in reversed(caches[d]):
                dh = dh + part[t]
                dn = dh * (1 - z) * (1 - np.abs(n)) ** 2
                # a gate is (1 + y) / 2, so its slope is (1 - |2 gate - 1|)**2 / 2
                dz, dr = dh * (state - n) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2, dn * a * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
                inputs[t] = np.concatenate([dz, dr, dn], axis=1)
                da = np.concatenate([dz, dr, dn * r], axis=1)
                gu += state.T @ da
                dh = dh * z + da @ u.T
            g["u" + d] = gu
            flat, at = inputs.reshape(-1, 3 * self.h), x.ravel()
            g["e" + d] = np.stack([np.bincount(at, flat[:, k], 256) for k in range(3 * self.h)], axis=1).astype(np.float32)
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, seed: int = SEED) -> "BiGru":
        """Adam over random windows (x windows x time), languages drawn equally often."""
        rng = np.random.default_rng(seed)
        by = [np.flatnonzero(y == k) for k in range(len(self.langs))]
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            want = rng.integers(0, len(by), BATCH)
            rows = np.array([by[k][rng.integers(len(by[k]))] for k in want])
            rate = RATE * min(1.0, 2 * (1 - (step - 1) / steps))
            for k, g in self.gradients(x[rows].T, want).items():
                g = np.clip(g, -0.1, 0.1)
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.p[k] -= (rate * m[k] / (1 - 0.9 ** step) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
        return self

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities over all bytes of each text; zeros for an empty one."""
        sums = np.zeros((len(texts), len(self.langs)))
        owner, begin = [], []
        for i, t in enumerate(texts):
            starts = range(0, len(t), READ)
            owner += [i] * len(starts)
            begin += starts
        for a in range(0, len(owner), TOGETHER):
            own, at = owner[a:a + TOGETHER], begin[a:a + TOGETHER]
            raw = [texts[i][s:s + READ] for i, s in zip(own, at)]
            size = np.fromiter(map(len, raw), np.int64, len(raw))
            x = np.frombuffer(b"".join(r.ljust(READ, b" ") for r in raw), np.uint8).reshape(-1, READ).T
            p = self.probabilities(x)
            short = np.flatnonzero(size < READ)
            p[:, short] *= (np.arange(READ)[:, None] < size[short])[:, :, None]
            np.add.at(sums, own, p.sum(axis=0, dtype=np.float64))
        length = np.maximum(np.fromiter(map(len, texts), np.int64, len(texts)), 1)
        return sums / length[:, None]


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, key: str, text: str, lang: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """All languages, windows and their language numbers: ``PER_LANG * WINDOWS`` windows of ``LENGTH`` bytes of each at most, those of the
    rows whose keys have the least hashes; rows of one key follow their texts' hashes. No more reaches the driver."""
    ok = docs.filter(F.col(lang).isNotNull() & F.col(key).isNotNull() & ~held_out(key) & (F.length(whole_text(text)) > 0))
    sizes = {r["l"]: r["n"] for r in ok.groupBy(F.col(lang).alias("l")).agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((0, LENGTH), np.uint8), np.zeros(0, np.int64)
    draw = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(SEED)), F.lit(1 << 30)).cast("long")
    bound = F.element_at(F.create_map(*[F.lit(x) for name, n in sizes.items() for x in (name, int((1 << 30) * min(1.0, (2 * PER_LANG + 40) / n)))]), F.col(lang))
    drawn = ok.select(F.col(lang).alias("l"), draw.alias("d"), whole_text(text).alias("t"), bound.alias("b")).filter("d < b").withColumn("h", F.xxhash64("t"))
    # Spark prunes each partition to PER_LANG rows of a language before the shuffle
    rows = ranked(drawn, ["l"], [F.col("d"), F.col("h")], "place", PER_LANG).select("l", "d", "t")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for d, t in zip(b.column("d").to_pylist(), b.column("t").to_pylist()):
                raw = t.encode("utf-8", "replace")
                at = np.random.default_rng(d).integers(0, max(1, len(raw) - LENGTH), WINDOWS)
                out.append(b"".join(raw[a:a + LENGTH].ljust(LENGTH, b" ") for a in at.tolist()))
            yield pa.RecordBatch.from_arrays([b.column("l"), b.column("d"), pa.array(out, pa.binary())], ["l", "d", "w"])
    got = rows.mapInArrow(cut, T.StructType([T.StructField("l", T.StringType()), T.StructField("d", T.LongType()), T.StructField("w", T.BinaryType())])).collect()
    x, y = [], []
    for k, name in enumerate(langs):
        mine = sorted((r["d"], bytes(r["w"])) for r in got if r["l"] == name)
        x += [w for _, w in mine]
        y += [k] * (WINDOWS * len(mine))
    return langs, np.frombuffer(b"".join(x), np.uint8).reshape(-1, LENGTH), np.array(y, np.int64)


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> BiGru | None:
    """The fitted network, or None if no document can be learned from."""
    langs, x, y = sample(docs, key, text, lang)
    return BiGru(langs).fit(x, y) if len(x) else None


def predict(docs: DataFrame, model: BiGru | None, text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its pooled probability. ``und`` and 0 where the text is null or has no letter, or
    where nothing could be learned. All rows and columns stay."""
    state = pickle.dumps(model)
    # columns go through the task under plain names, whatever they are called
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)], whole_text(F.col(f"`{text}`")).alias("t"))
    kind = T.StructType([*rows.schema.fields[:-1], T.StructField("pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = pickle.loads(state)
        for b in slices(batches, "t", 2 << 20):
            texts = b.column("t").to_pylist()
            some = [net is not None and has_letter(t) for t in texts]
            probs = net.documents([t.encode("utf-8", "replace") if s else b"" for t, s in zip(texts, some)]) if any(some) else np.zeros((len(texts), 1))
            best = probs.argmax(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array([net.langs[k] if s else UNKNOWN for k, s in zip(best, some)], pa.string()),
                 pa.array([float(min(1.0, q[k])) if s else 0.0 for q, k, s in zip(probs, best, some)])], [f.name for f in kind])
    return rows.mapInArrow(run, kind).toDF(*docs.columns, pred, score)


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``key``, ``held_out``, ``lang_pred``, ``score``: one row for each row of ``docs``, repeated and null keys included (a null key is never
    learned from). An empty table gives no rows."""
    model = train(docs, key, text, lang)
    return predict(docs.select(F.col(key), held_out(key).alias("held_out"), whole_text(text).alias("__text")), model, "__text").drop("__text")


def keep_known(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", margin: float = 0.2) -> DataFrame:
    """``docs`` without those the network rejects: no letter in the text, or a pooled probability that is less than ``margin`` of the way
    from chance (one over the languages learned) to certainty. Where nothing could be learned, every text with a letter stays."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("text"))
    model = train(docs, key, text, lang)
    if model is None:
        return rows.filter(F.col("text").rlike(r"\p{L}")).select("row.*")
    chance = 1 / len(model.langs)
    least = chance + margin * (1 - chance) - 1e-3
    out = predict(rows, model, "text", "pred", "score")
    return out.filter((F.col("pred") != UNKNOWN) & (F.col("score") >= least)).select("row.*")
