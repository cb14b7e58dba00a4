"""Token ids of many texts at once: texts are cut where no token can cross, each distinct part is encoded by the tokenizers library
once per worker, and numpy puts the ids together. A text in which a cut could change the result goes to the library as a whole,
so the ids are always the library's own.
"""
from __future__ import annotations

import os
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import Recent

JOINED_PARTS = 1_000
MARK = "\x00"
# A cut before each space, line feed, full stop and comma is safe unless white space meets white space or ends a text, a stop
# or comma follows other punctuation, or the text has other white space, the mark or a special string.
_ODD = r"[\x00\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|<\|"
UNSAFE_SPACED = _ODD + r"|[ \n][ \n]|\A[ \n]|[ \n]\z|[^\p{L}\p{N}][.,]|\A[.,]"
UNSAFE_PLAIN = _ODD + r"|[^\s\p{L}\p{N}][.,]"
_ENCODERS: dict[tuple[str, bool], "PartEncoder"] = {}


def _byte_alphabet() -> dict[int, str]:
    """The visible stand-in of each byte in byte-level vocabularies: printable Latin-1 stays, the rest follows from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_BYTES = _byte_alphabet()


def default_tokenizer(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def encoder(path: str, spaced: bool) -> "PartEncoder":
    """One encoder per Python worker."""
    if (path, spaced) not in _ENCODERS:
        _ENCODERS[path, spaced] = PartEncoder(path, spaced)
    return _ENCODERS[path, spaced]


class PartEncoder:
    """``spaced``: byte-level tokens that may start with the space before them; otherwise white space is dropped and letters
    are lower-cased."""

    def __init__(self, path: str, spaced: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok, self.spaced = Tokenizer.from_file(path), spaced
        self.model = self.tok.model
        self.sep = "<|endoftext|>"
        self.sep_id = self.tok.token_to_id(self.sep)
        if self.sep_id is None:
            raise ValueError(f"{path} has no {self.sep}")
        self.recent = Recent(48 << 20)

    def whole(self, text: str) -> np.ndarray:
        """Ids as the library gives them for the text."""
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _word(self, part: str) -> str | None:
        """The part in the model's own alphabet if it is one pre-token of letters, else None."""
        if self.spaced:
            bare = part[1:] if part[:1] == " " else part
            if not bare.isalpha():
                return None
            if part.isascii():
                return part if bare is part else _BYTES[32] + bare
            return part.encode().decode("latin-1").translate(_BYTES)
        if not part.isalpha():
            return None
        if part.isascii():
            return part.lower()
        low = unicodedata.normalize("NFC", part)
        if "Σ" in low or not (low := low.lower()).isalpha():
            return None
        return low.encode().decode("latin-1").translate(_BYTES)

    def _learn(self, parts: list[str]) -> dict[str, bytes]:
        """Letters go to the library's model directly; other parts many in one call, with a special string between them."""
        out, rest, words, ids, ends = {}, [], [], [], [0]
        to_word, tokenize = self._word, self.model.tokenize
        for p in parts:
            word = to_word(p)
            if word is None:
                rest.append(p)
            else:
                words.append(p)
                ids += [t.id for t in tokenize(word)]
                ends.append(4 * len(ids))
        held = np.array(ids, dtype="<u4").tobytes()
        out.update(zip(words, [held[a:b] for a, b in zip(ends, ends[1:])]))
        for i in range(0, len(rest), JOINED_PARTS):
            some = rest[i:i + JOINED_PARTS]
            ids = np.array(self.tok.encode_batch_fast([self.sep.join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = np.flatnonzero(ids == self.sep_id)
            begin = np.concatenate([[0], cuts + 1]).tolist()
            end = np.concatenate([cuts, [len(ids)]]).tolist()
            for part, a, b in zip(some, begin, end, strict=True):
                out[part] = ids[a:b].tobytes()
        return out

    def pool(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts one after another, and each part's number of ids."""
        got = self.recent.get(parts, self._learn)
        return np.frombuffer(b"".join(got), dtype="<u4"), np.fromiter(map(len, got), np.int64, len(got)) // 4

    def forget(self) -> None:
        """At the end of a task."""
        self.recent.clear()

    def texts(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; null as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(texts, UNSAFE_SPACED if self.spaced else UNSAFE_PLAIN).to_numpy(zero_copy_only=False)
        out: list[np.ndarray] = [None] * len(texts)  # type: ignore[list-item]
        for i in np.flatnonzero(odd).tolist():
            out[i] = self.whole(texts[i].as_py())
        plain = np.flatnonzero(~odd)
        if len(plain):
            for i, ids in zip(plain.tolist(), self._cut(texts.take(pa.array(plain)))):
                out[i] = ids
        return out

    def _cut(self, texts: pa.Array) -> list[np.ndarray]:
        if not self.spaced:
            texts = pc.replace_substring(pc.replace_substring(pc.ascii_lower(texts), "\n", MARK), " ", MARK)
        for c in " \n.," if self.spaced else ".,":
            texts = pc.replace_substring(texts, c, MARK + c)
        split = pc.split_pattern(texts, MARK)
        coded = split.flatten().dictionary_encode()
        pool, size = self.pool(coded.dictionary.to_pylist())
        begin = np.concatenate([[0], np.cumsum(size)])[:-1]
        at = coded.indices.to_numpy(zero_copy_only=False)
        offsets = split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
        n = size[at]
        ends = np.cumsum(n)
        # positions fit 32 bits: a slice of texts is far smaller than 2**31 tokens
        place = np.arange(ends[-1] if len(ends) else 0, dtype=np.int32)
        place += np.repeat((begin[at] - ends + n).astype(np.int32), n)
        ids = pool[place]
        cut = np.concatenate([[0], ends])[offsets]
        return [ids[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
