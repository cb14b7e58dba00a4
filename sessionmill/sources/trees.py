"""Folders listed by tasks, level by level, and files read by tasks where Spark's readers pass them over or would make one row of them
(SC02, SC07).

``tree`` expands a frontier of folders: each level is one job over the folders of the level before, until none is left. A folder that cannot
be read gives a row with the error. Names that begin with ``.`` or ``_`` are listed like any other, symbolic links are not followed.
"""
from __future__ import annotations

import json
import os
import re
import stat
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import variants as V
from ..operators.ordered import scratch_dir

LISTED = "path string, folder boolean, size_bytes bigint, mtime_ms bigint, error string"
ROWS = 10_000                      # rows that a listing or reading task gives at a time
SMALL = 4 << 20                    # files up to this are read whole by tasks; Spark's readers plan and open each file apart
CHUNK = 1 << 20                    # bytes read at a time
LINK = "symbolic link"             # the error of links, which are not followed
# Names that Hadoop's file systems write for themselves, no part of any log.
BOOKKEEPING = r"(?:^|/)(?:\.[^/]*\.crc|_SUCCESS|_temporary(?:/.*)?|_spark_metadata(?:/.*)?)$"


def plain(path: str) -> str:
    """A path without the scheme of local files."""
    return re.sub(r"^file:(?://)?(?=/)", "", path).rstrip("/") or "/"


def _local(path: str) -> bool:
    return path.startswith("/")


def _entries(path: str) -> Iterator[tuple]:
    """What a folder holds, or the file itself."""
    if _local(path):
        info = os.lstat(path)
        if not stat.S_ISDIR(info.st_mode):
            yield path, False, info.st_size, info.st_mtime_ns // 1_000_000, None
            return
        with os.scandir(path) as found:
            for e in found:
                if e.is_symlink():
                    yield e.path, False, 0, 0, LINK
                    continue
                info = e.stat(follow_symlinks=False)
                yield e.path, e.is_dir(follow_symlinks=False), info.st_size, info.st_mtime_ns // 1_000_000, None
        return
    from pyarrow import fs
    store, inner = fs.FileSystem.from_uri(path)
    root = store.get_file_info(inner)
    some = [root] if root.type == fs.FileType.File else store.get_file_info(fs.FileSelector(inner))
    for f in some:
        name = path if f is root else f"{path}/{f.base_name}"
        yield name, f.type == fs.FileType.Directory, f.size or 0, (f.mtime_ns or 0) // 1_000_000, None


def _listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in LISTED.split(", ")]
    held: list[tuple] = []
    for b in batches:
        for path in b["path"]:
            try:
                for row in _entries(path):
                    held.append(row)
                    if len(held) >= ROWS:
                        yield pd.DataFrame(held, columns=names)
                        held = []
            except FileNotFoundError:      # gone since the level above was listed
                continue
            except OSError as e:
                held.append((path, True, 0, 0, f"{type(e).__name__}: {e.strerror or e}"))
    if held:
        yield pd.DataFrame(held, columns=names)


def tree(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Every file and folder below the paths (``LISTED``), stored. Paths may be patterns; a path that is not there gives nothing."""
    roots = []
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        roots += [plain(f.getPath().toString()) for f in at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or []]
    out, level = scratch_dir(spark), 0
    parts = spark.sparkContext.defaultParallelism
    frontier = spark.createDataFrame([(p,) for p in dict.fromkeys(roots)], "path string")
    while True:
        frontier.repartition(parts, "path").mapInPandas(_listed, LISTED).write.parquet(f"{out}/level={level}")
        found = spark.read.schema(LISTED).parquet(f"{out}/level={level}")
        frontier = found.filter("folder AND error IS NULL").select("path")
        if frontier.isEmpty():
            break
        level += 1
    return spark.read.schema(LISTED).option("recursiveFileLookup", "true").parquet(out).filter(~F.col("path").rlike(BOOKKEEPING)).dropDuplicates(["path"])


def files_of(found: DataFrame) -> DataFrame:
    return found.filter("NOT folder AND error IS NULL")


def hidden(name_of: str = "path"):
    """A file or folder that Spark's listing passes over."""
    return F.col(name_of).rlike(r"(?:^|/)[._][^/]*$")


def _chunks(path: str) -> Iterator[str]:
    """A file's text in pieces; bytes that are no UTF-8 are replaced."""
    import codecs
    decode = codecs.getincrementaldecoder("utf-8")("replace").decode
    if _local(path):
        source = open(path, "rb")
    else:
        from pyarrow import fs
        store, inner = fs.FileSystem.from_uri(path)
        source = store.open_input_stream(inner)
    with source:
        while data := source.read(CHUNK):
            yield decode(data)
    yield decode(b"", True)


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows that each cost a file to open or write, dealt over all cores: their bytes are so few that Spark would join them into a task or two."""
    spark = rows.sparkSession
    return rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)


def packed(name_of: str = "path"):
    """A file that Spark's text reader unpacks."""
    return F.col(name_of).rlike(r"(?i)\.(?:gz|bz2|deflate|snappy|lz4|zst)$")


def _whole(path: str) -> tuple[bytes, int, int]:
    """Bytes, size and time of a file as it is now."""
    if _local(path):
        with open(path, "rb") as source:
            info = os.fstat(source.fileno())
            return source.read(), info.st_size, info.st_mtime_ns // 1_000_000
    from pyarrow import fs
    store, inner = fs.FileSystem.from_uri(path)
    info = store.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    with store.open_input_stream(inner, compression=None) as source:
        return source.read(), info.size or 0, (info.mtime_ns or 0) // 1_000_000


def read_texts(files: DataFrame) -> DataFrame:
    """(path, size_bytes, mtime_ms, text) of whole files of a listing, opened by tasks. Size and time are those of the moment of reading; a file
    that is gone or empty gives nothing, as with Spark's reader."""
    names = ["path", "size_bytes", "mtime_ms", "data"]

    def read(batches):
        held, weight = [], 0
        for b in batches:
            for path in b["path"]:
                try:
                    data, size, mtime = _whole(path)
                except FileNotFoundError:
                    continue
                if not data:
                    continue
                held.append((path, size, mtime, data))
                weight += len(data) + 100
                if weight > CHUNK:
                    yield pd.DataFrame(held, columns=names)
                    held, weight = [], 0
        if held:
            yield pd.DataFrame(held, columns=names)
    rows = dealt(files.select("path"), "path").mapInPandas(read, "path string, size_bytes bigint, mtime_ms bigint, data binary")
    return rows.select("path", "size_bytes", "mtime_ms", F.col("data").cast("string").alias("text"))


_CR = re.compile("\r(?=[\r\u0085\u2028\u2029]?\\Z)")      # what Spark's pattern ``\\r$`` takes from a line


def _lines(data: bytes) -> list[str]:
    """The lines of a file as Spark's reader gives them; bytes that are no UTF-8 are replaced."""
    some = data.removeprefix(b"\xef\xbb\xbf").decode("utf-8", "replace").split("\n")
    if not some[-1]:
        some.pop()
    return [_CR.sub("", line) if "\r" in line else line for line in some]


def read_small_lines(files: DataFrame) -> DataFrame:
    """The rows of ``read_lines`` for files that fit a task whole, as Spark's reader gives them."""
    names = ["path", "size_bytes", "mtime_ms", "row_no", "offset", "line"]

    def read(batches):
        held, weight = [], 0
        for b in batches:
            for path in b["path"]:
                try:
                    data, size, mtime = _whole(path)
                except FileNotFoundError:
                    continue
                at = 0
                for n, line in enumerate(_lines(data), 1):
                    held.append((path, size, mtime, n, at, line))
                    at += len(line) + 1
                    weight += len(line) + 100
                    if weight > CHUNK:
                        yield pd.DataFrame(held, columns=names)
                        held, weight = [], 0
        if held:
            yield pd.DataFrame(held, columns=names)
    return dealt(files.select("path"), "path").mapInPandas(read, "path string, size_bytes bigint, mtime_ms bigint, row_no bigint, offset bigint, line string")


def read_lines(files: DataFrame) -> DataFrame:
    """(path, size_bytes, mtime_ms, row_no, offset, line) of files read by tasks, a file in one task, in batches of bounded size."""
    names = ["path", "size_bytes", "mtime_ms", "row_no", "offset", "line"]

    def read(batches):
        for b in batches:
            for path, size, mtime in zip(b["path"], b["size_bytes"], b["mtime_ms"]):
                rest, at, n, held, weight = "", 0, 0, [], 0
                for text in _chunks(path):
                    lines = (rest + text).split("\n")
                    rest = lines.pop()
                    for line in lines:
                        n += 1
                        held.append((path, size, mtime, n, at, line.removesuffix("\r")))
                        at += len(line) + 1 - (line[-1:] == "\r")
                        weight += len(line) + 100
                        if weight > CHUNK:
                            yield pd.DataFrame(held, columns=names)
                            held, weight = [], 0
                if rest:
                    held.append((path, size, mtime, n + 1, at, rest.removesuffix("\r")))
                if held:
                    yield pd.DataFrame(held, columns=names)
    return files.select("path", "size_bytes", "mtime_ms").mapInPandas(read, "path string, size_bytes bigint, mtime_ms bigint, row_no bigint, offset bigint, line string")


# ---- documents larger than a row -----------------------------------------------------------------------------------

_TOKEN = re.compile(r'[ \t\r\n]*("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null|[\[\]{},:])')
_SPACE = re.compile(r"[ \t\r\n]*")


class JsonText:
    """A JSON text read in pieces. ``value`` passes one value and returns its text if wanted; only that text, a token and the stack of open
    brackets are held."""

    def __init__(self, chunks: Iterator[str]):
        self.chunks, self.text, self.at, self.done = chunks, "", 0, False
        self.kept: list[str] | None = None

    def _more(self) -> bool:
        nxt = next(self.chunks, None)
        if nxt is None:
            self.done = True
            return False
        self.text, self.at = self.text[self.at:] + nxt, 0
        return True

    def token(self) -> str:
        """The next token; '' at the end of the text."""
        while True:
            m = _TOKEN.match(self.text, self.at)
            # a token near the end of what was read may go on, as may a number before its exponent
            if m and (m.end() + 4 < len(self.text) or self.done):
                self.at = m.end()
                if self.kept is not None:
                    self.kept.append(m[1])
                return m[1]
            if self.done or not self._more():
                if m:
                    continue
                if _SPACE.fullmatch(self.text, self.at):
                    return ""
                raise ValueError("no JSON")

    def need(self, *wanted: str) -> str:
        t = self.token()
        if t not in wanted:
            raise ValueError("no JSON")
        return t

    def value(self, keep: bool = False, first: str | None = None) -> str | None:
        """Pass one value (whose first token was read already if given)."""
        self.kept = [] if keep else None
        if keep and first is not None:
            self.kept.append(first)
        t = self.token() if first is None else first
        open_: list[str] = []
        while True:
            if t in ("[", "{"):
                open_.append(t)
                t = self.token()
                if (t == "]" and open_[-1] == "[") or (t == "}" and open_[-1] == "{"):
                    open_.pop()
                elif open_[-1] == "{":
                    t = self._key(t)
                    continue
                else:
                    continue
            elif t in ("", "]", "}", ",", ":"):
                raise ValueError("no JSON")
            while open_:                   # a value has ended inside these brackets
                t = self.need(",", "]" if open_[-1] == "[" else "}")
                if t == ",":
                    t = self.token() if open_[-1] == "[" else self._key(self.token())
                    break
                open_.pop()
            else:
                out, self.kept = "".join(self.kept) if keep else None, None
                return out

    def _key(self, t: str) -> str:
        if t[:1] != '"':
            raise ValueError("no JSON")
        self.need(":")
        return self.token()

    def members(self) -> Iterator[str]:
        """Keys of an object whose bracket was read; the caller passes each value."""
        t = self.token()
        while t != "}":
            if t[:1] != '"':
                raise ValueError("no JSON")
            self.need(":")
            yield json.loads(t)
            if self.need(",", "}") == "}":
                return
            t = self.token()
            if t == "}":
                raise ValueError("no JSON")

    def items(self, keep: bool) -> Iterator[str | None]:
        """Items of an array whose bracket was read."""
        t = self.token()
        while t != "]":
            yield self.value(keep, t)
            if self.need(",", "]") == "]":
                return
            t = self.token()
            if t == "]":
                raise ValueError("no JSON")


def _id_of(text: str | None) -> str:
    v = json.loads(text) if text else None
    return v if isinstance(v, str) else ""


def outline(chunks: Iterator[str]) -> tuple[str, str] | None:
    """What a document is (``messages``, ``object`` or ``array``) and its own session id, from one pass; None if it is no JSON document."""
    doc = JsonText(chunks)
    try:
        t, ids, kind = doc.token(), {}, "object"
        if t == "{":
            for key in doc.members():
                t = doc.token()
                if key == "messages" and t == "[":
                    kind = "messages" if sum(1 for _ in doc.items(False)) else "object"
                elif key in ("sessionId", "session_id"):
                    ids[key] = _id_of(doc.value(t[:1] == '"', t))
                else:
                    doc.value(False, t)
        elif t == "[":
            kind = "array"
            for i, item in enumerate(doc.items(True)):
                if i == 0 and item[:1] == "{":
                    first = json.loads(item)
                    ids = {k: v for k, v in first.items() if isinstance(v, str)}
        else:
            return None
        if doc.token():
            return None
    except ValueError:
        return None
    return kind, ids.get("sessionId", "").strip() and ids["sessionId"] or ids.get("session_id", "")


def messages_of(kind: str, chunks: Iterator[str]) -> Iterator[tuple[int, str]]:
    """Place and text of each message of a document that ``outline`` knows, one held at a time."""
    if kind == "object":                   # its own message, as it is written
        yield 0, "".join(chunks)
        return
    doc = JsonText(chunks)
    t, n = doc.token(), -1
    if kind == "array":
        for item in doc.items(True):
            if item[:1] == "{" and item != "{}":
                n += 1
                yield n, item
        return
    for key in doc.members():
        t = doc.token()
        if key == "messages" and t == "[":
            for item in doc.items(True):
                n += 1
                yield n, item
        else:
            doc.value(False, t)


def read_documents(files: DataFrame) -> DataFrame:
    """The rows of ``scan.document_rows`` for files (trace_id, path, size_bytes, mtime_ms) of any size: a document is read twice in pieces,
    and a message is all that is held of it."""
    names = ["trace_id", "path", "size_bytes", "mtime_ms", "doc_session_id", "row_no", "raw", "whole"]

    def read(batches):
        for b in batches:
            for trace, path, size, mtime in zip(b["trace_id"], b["path"], b["size_bytes"], b["mtime_ms"]):
                found = outline(_chunks(path))
                if found is None:
                    continue
                held, weight = [], 0
                for n, raw in messages_of(found[0], _chunks(path)):
                    held.append((trace, path, size, mtime, found[1], n, raw, found[0] == "object"))
                    weight += len(raw) + 200
                    if weight > CHUNK:
                        yield pd.DataFrame(held, columns=names)
                        held, weight = [], 0
                if held:
                    yield pd.DataFrame(held, columns=names)
    rows = files.select("trace_id", "path", "size_bytes", "mtime_ms").mapInPandas(
        read, "trace_id string, path string, size_bytes bigint, mtime_ms bigint, doc_session_id string, row_no bigint, raw string, whole boolean")
    one = F.get(F.from_json(F.concat(F.lit("["), "raw", F.lit("]")), "array<string>"), F.lit(0))
    v = F.try_parse_json("raw")
    return rows.select("trace_id", "path", "size_bytes", "mtime_ms", "doc_session_id", "row_no", (F.col("row_no") * 1000).alias("offset"), F.when(F.col("whole"), F.col("raw")).otherwise(one).alias("raw_json"),
                       F.when(V.is_object(v), v).otherwise(F.parse_json(F.lit("{}"))).alias("v"))
