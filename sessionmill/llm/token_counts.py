"""Token counts without token ids: pieces are counted once per distinct pre-token and joined to the documents' pre-token frequencies.

A pre-token is a run of spaces with the characters up to the next space, or a line feed with what follows; no piece of the
vocabulary crosses such a border (checked when the model is loaded), so the pieces of a text are those of its pre-tokens. The
``HEAD`` most frequent pre-tokens of the corpus, of a bounded length each, are joined inside the tasks; all other pre-tokens by a
shuffle, in which none is frequent.
"""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from .chunks import default_tokenizer
from .common import keep, slices, whole_text

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
HEAD = 300_000
HEAD_CHARS = 64
SPACE = "▁"  # the vocabulary's sign for a space
_BREAK = re.compile(r" +[^ \n]*|\n[^ \n]*")
# texts in which spaces meet spaces, line feeds or the ends are cut by the pattern above; all others by plain splitting
_RUNS = r"  | \n|\A | \z|▁|\x00"
_PROCESSORS: dict = {}


def processor(path: str):
    """The sentencepiece model, one per Python worker."""
    if path not in _PROCESSORS:
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        for i in range(sp.get_piece_size()):
            p = sp.id_to_piece(i)
            if "\n" in p or SPACE in p.lstrip(SPACE):
                raise ValueError(f"piece {p!r} crosses the border of a pre-token")
        _PROCESSORS[path] = sp
    return _PROCESSORS[path]


def pretokens(texts: pa.Array) -> list[Counter]:
    """Pre-token frequencies of each text; a pre-token after a space is kept without that space's first character, one after a line
    feed with it, and a text's first pre-token counts as if a space stood before it. Null and empty texts have none."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    odd = pc.match_substring_regex(texts, _RUNS).to_numpy(zero_copy_only=False).tolist()
    split = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
    coded = split.flatten().dictionary_encode()
    names, at = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).tolist()
    ends = split.offsets.to_pylist()
    first, out = ends[0], []
    for i, strange in enumerate(odd):
        if strange:
            text = " " + texts[i].as_py().replace(SPACE, " ")
            out.append(Counter(p[1:] if p[0] == " " else p for p in _BREAK.findall(text)))
        elif ends[i + 1] - ends[i] == 1 and not names[at[ends[i] - first]]:
            out.append(Counter())
        else:
            out.append(Counter(at[ends[i] - first:ends[i + 1] - first]))
            out[-1] = Counter({names[k]: n for k, n in out[-1].items()})
            # a text that begins with a line feed has the pre-token of the space put before it as well
    return out


def count_pieces(sp, words: list[str]) -> list[int]:
    """Pieces of each pre-token."""
    return [(1 if not w else len(ids) - (w[0] == "\n")) for w, ids in zip(words, sp.encode(words, num_threads=1))]


def vocabulary(docs: DataFrame, text: str = "text") -> DataFrame:
    """``word``, ``n``: all pre-tokens of the corpus with their frequency. Each slice of texts gives one row per distinct word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for b in slices(batches, "t"):
            for c in pretokens(b.column("t")):
                held.update(c)
            if len(held) > 300_000:
                yield from batched(held)
                held = Counter()
        yield from batched(held)

    def batched(c: Counter, rows: int = 50_000):
        words, counts = list(c), list(c.values())
        for i in range(0, len(words), rows):
            yield pa.RecordBatch.from_arrays([pa.array(words[i:i + rows], pa.string()), pa.array(counts[i:i + rows], pa.int64())],
                                             ["word", "n"])
    rows = docs.select(whole_text(text).alias("t")).mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def with_pieces(words: DataFrame, model: str) -> DataFrame:
    """``word`` and ``n`` with ``pieces``, each word encoded once."""
    def run(batches):
        sp = processor(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(count_pieces(sp, b.column("word").to_pylist()), pa.int32())],
                                             [*b.schema.names, "pieces"])
    return words.mapInArrow(run, T.StructType([*words.schema.fields, T.StructField("pieces", T.IntegerType())]))


def frequent(words: DataFrame, most: int | None = None) -> dict[str, int]:
    """Pieces of the most frequent words: at most ``most`` of at most ``HEAD_CHARS`` characters, a few megabytes whatever the corpus.

    Words are counted per eighth of a power of two of their frequency; all words above the step at which there would be too many
    are taken, so no task sends more than its share of them.
    """
    most = HEAD if most is None else most
    short = words.filter(F.length("word") <= HEAD_CHARS).withColumn("step", F.floor(F.log2("n") * 8).cast("int"))
    total, least = 0, None
    for r in sorted(short.groupBy("step").count().collect(), key=lambda r: -r["step"]):   # at most 8 * 64 rows
        total += r["count"]
        if total > most:
            break
        least = r["step"]
    if least is None:
        return {}
    return {r["word"]: r["pieces"] for r in short.filter(F.col("step") >= least).select("word", "pieces").collect()}


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", model: str | None = None, limit: int = LIMIT) -> DataFrame:
    """``key``, ``n_bytes``, ``n_tokens``, ``over_limit``: one row for each row of ``docs``, repeated and null keys included.

    Null and empty texts have 0 tokens; other columns are not looked at; an empty table gives no rows.
    """
    path = model or default_tokenizer(MODEL)
    processor(path)
    spark = docs.sparkSession
    words = keep(with_pieces(vocabulary(docs, text), path), "words")
    known = spark.sparkContext.broadcast(frequent(words))
    rows = docs.select(F.col(key).alias("k"), F.xxhash64(whole_text(text)).alias("h"), whole_text(text).alias("t"))
    schema = T.StructType([rows.schema["k"], rows.schema["h"], T.StructField("bytes", T.LongType()), T.StructField("rows", T.LongType()),
                           T.StructField("head", T.LongType()), T.StructField("tail", T.MapType(T.StringType(), T.LongType()))])

    def run(batches):
        have = known.value
        for b in slices(batches, "t"):
            sums, tails = [], []
            for c in pretokens(b.column("t")):
                s, tail = 0, []
                for w, n in c.items():
                    p = have.get(w)
                    if p is None:
                        tail.append((w, n))
                    else:
                        s += n * p
                sums.append(s)
                tails.append(tail)
            yield pa.RecordBatch.from_arrays(
                [b.column("k"), b.column("h"), pc.binary_length(b.column("t")).cast(pa.int64()), pa.array([1] * len(sums), pa.int64()),
                 pa.array(sums, pa.int64()), pa.array(tails, pa.map_(pa.string(), pa.int64()))], schema.names)
    counted = keep(rows.mapInArrow(run, schema), "counted")
    rare = counted.select("k", "h", F.explode("tail").alias("word", "times"))
    rare = rare.join(words.select("word", "pieces"), "word").select("k", "h", (F.col("times") * F.col("pieces")).alias("head"))
    none = F.lit(None).cast("bigint")
    parts = counted.select("k", "h", "bytes", "rows", "head").unionByName(rare.select("k", "h", none.alias("bytes"), none.alias("rows"), "head"))
    # rows that are equal in key and text have equal counts: they are summed as one and given out as often as they occur
    total = parts.groupBy("k", "h").agg(F.max("bytes").alias("n_bytes"), F.sum("rows").alias("rows"), F.sum("head").alias("s"))
    total = total.withColumn("__i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("rows"))))
    n = F.expr("s div rows")
    return total.select(F.col("k").alias(key), "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))
