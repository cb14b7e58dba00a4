"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

The automaton reports, at each character, every piece that ends there by following its output links; each relaxes the best score at that
position from the best score where it starts. A character without a piece of its own costs ``UNKNOWN`` below the worst score and is
written as its bytes. A text gets a space in front and spaces become the vocabulary's sign; no piece crosses from a character
to a later space, so the best segmentation of a text is that of its pre-tokens. Each distinct one of a slice of texts is searched and decoded
once, and not again while it is remembered.
"""
from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from .chunks import default_tokenizer
from .common import Recent, slices, whole_text
from .token_counts import _RUNS, MODEL, SPACE

UNKNOWN = 10.0
_CUT = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n+[^{SPACE}\n]*")
_MODELS: dict[str, "Pieces"] = {}


def pieces_of(path: str) -> "Pieces":
    """The vocabulary, one per Python worker."""
    if path not in _MODELS:
        _MODELS[path] = Pieces(path)
    return _MODELS[path]


class Pieces:
    """Pieces and scores of a sentencepiece model file, and their automaton."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.piece = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_of = {i: bytes([b]) for b, i in enumerate(self.byte)}
        self.score = {i: sp.get_score(i) for i in plain}
        self.unknown = min(self.score.values()) - UNKNOWN
        self.auto = ahocorasick.Automaton()
        for i in plain:
            if "\n" in self.piece[i] or SPACE in self.piece[i].lstrip(SPACE):
                raise ValueError(f"piece {self.piece[i]!r} crosses the border of a pre-token")
            self.auto.add_word(self.piece[i], (len(self.piece[i]), self.score[i], i))
        self.auto.make_automaton()
        self.known = Recent(64 << 20)

    def search(self, text: str) -> tuple[float, list[int]]:
        """Best score and ids of a text in which spaces are signs already. Of equal scores the longer piece at the end wins."""
        best, back = [0.0], [(0, -1)]

        def close(end: int) -> None:
            """Positions up to ``end`` that no piece has reached by itself take the unknown character."""
            while len(best) <= end:
                best.append(best[-1] + self.unknown)
                back.append((1, -1))
        at = -1
        single = False
        for end, (size, score, i) in self.auto.iter(text):
            if end != at:
                close(end)
                best.append(float("-inf"))
                back.append((0, -1))
                at, single = end, False
            total = best[end + 1 - size] + score
            if total > best[-1]:
                best[-1], back[-1] = total, (size, i)
            single = single or size == 1
            if not single and best[end] + self.unknown > best[-1]:
                best[-1], back[-1] = best[end] + self.unknown, (1, -1)
            elif single and back[-1] == (1, -1):
                best[-1], back[-1] = total, (size, i)
        close(len(text))
        ids, pos = [], len(text)
        while pos:
            size, i = back[pos]
            if i < 0:
                ids += [self.byte[b] for b in reversed(text[pos - 1].encode("utf-8", "surrogatepass"))]
            else:
                ids.append(i)
            pos -= size
        return best[-1], ids[::-1]

    def _learn(self, parts: list[str]) -> dict[str, bytes]:
        """Little-endian unsigned 32-bit ids of each part, and a byte that says whether they decode to the part."""
        out = {}
        for p in parts:
            ids = self.search(p)[1]
            out[p] = np.array(ids, "<u4").tobytes() + (b"\x01" if self._written(ids) == p else b"\x00")
        return out

    def encode_slice(self, texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
        """Ids of each text, and whether they decode to it. Each distinct pre-token of the slice is searched and decoded once."""
        texts = pc.fill_null(texts, "")
        odd = pc.or_(pc.match_substring_regex(texts, _RUNS), pc.equal(pc.binary_length(texts), 0)).to_numpy(zero_copy_only=False)
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        coded = split.flatten().dictionary_encode()
        names = [w if w[:1] == "\n" else SPACE + w for w in coded.dictionary.to_pylist()]
        at, n = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        cut = np.concatenate([[0], np.cumsum(n)])
        place, pieces, where = {w: i for i, w in enumerate(names)}, [], np.flatnonzero(odd).tolist()
        for i in where:        # spaces that meet spaces, line feeds or the ends, and texts with signs of their own
            text = texts[i].as_py()
            pieces.append([place.setdefault(p, len(place)) for p in _CUT.findall((" " + text).replace(" ", SPACE))] if text else [])
        got = self.known.get(list(place), self._learn)
        fine = np.fromiter((g[-1] for g in got), np.int64, len(got))
        size = np.fromiter(map(len, got), np.int64, len(got)) // 4
        pool = np.frombuffer(b"".join([g[:-1] for g in got]), "<u4")
        begin = np.concatenate([[0], np.cumsum(size)])[:-1]

        def joined(parts: np.ndarray) -> np.ndarray:
            m = size[parts]
            ends = np.cumsum(m)
            return pool[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin[parts] - ends + m, m)]
        if not len(names):
            return [], np.zeros(0, bool)
        flat, upto = joined(at), np.concatenate([[0], np.cumsum(size[at])])[cut]
        ids = [flat[a:b] for a, b in zip(upto[:-1].tolist(), upto[1:].tolist())]
        good = np.diff(np.concatenate([[0], np.cumsum(fine[at])])[cut]) == n
        for i, parts in zip(where, pieces):
            parts = np.array(parts, np.int64)
            ids[i], good[i] = joined(parts), bool(fine[parts].all())
        return ids, good

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of one text."""
        return self.encode_slice(pa.array([text]))[0][0].tobytes()

    def decode(self, ids: list[int]) -> str:
        """The text of ids; a sign becomes a space and the space put in front goes."""
        return self._written(ids).replace(SPACE, " ")[1:]

    def _written(self, ids: list[int]) -> str:
        """The pieces of ids one after another, bytes put together to characters."""
        out, held = [], b""
        for i in ids:
            b = self.byte_of.get(i)
            if b is not None:
                held += b
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held = b""
            out.append(self.piece[i])
        if held:
            out.append(held.decode("utf-8", "replace"))
        return "".join(out)


def encode_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", model: str | None = None) -> DataFrame:
    """``key`` and ``ids`` of each row. Null and empty texts have no ids; a text's own signs count as spaces; other columns are not looked
    at; repeated and null keys are encoded like any row; an empty table gives no rows."""
    return _over(docs, key, text, model, False)


def decode_documents(rows: DataFrame, key: str = "doc_id", ids: str = "ids", model: str | None = None) -> DataFrame:
    """``key`` and ``text`` of each row; null ids as none."""
    path = model or default_tokenizer(MODEL)
    some = rows.select(F.col(key).alias("k"), F.coalesce(F.col(ids), F.array().cast("array<bigint>")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array([pieces.decode(i) for i in b.column("ids").to_pylist()], pa.string())], ["k", "text"])
    return some.mapInArrow(run, T.StructType([some.schema["k"], T.StructField("text", T.StringType())])).withColumnRenamed("k", key)


def round_trip(docs: DataFrame, key: str = "doc_id", text: str = "text", model: str | None = None) -> DataFrame:
    """``key``, ``n_pieces``, ``ids_crc32``, ``restored`` (decoding gives the text again) of each row."""
    return _over(docs, key, text, model, True)


def _over(docs: DataFrame, key: str, text: str, model: str | None, digest: bool) -> DataFrame:
    path = model or default_tokenizer(MODEL)
    rows = docs.select(F.col(key).alias("k"), whole_text(text).alias("t"))
    more = [T.StructField("n_pieces", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("restored", T.BooleanType())] if digest else [
        T.StructField("ids", T.ArrayType(T.LongType(), False))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(path)
        for b in slices(batches, "t"):
            ids, good = pieces.encode_slice(b.column("t"))
            if digest:
                cols = [pa.array([len(i) for i in ids], pa.int64()), pa.array([zlib.crc32(i.tobytes()) for i in ids], pa.int64()), pa.array(good)]
            else:
                cols = [pa.array([i.astype(np.int64) for i in ids], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column("k"), *cols], ["k", *(f.name for f in more)])
    return rows.mapInArrow(run, T.StructType([rows.schema["k"], *more])).withColumnRenamed("k", key)
