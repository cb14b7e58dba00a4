"""Helpers of the training-data operators: tables in the shared folder, whole texts, slices of Arrow batches."""
from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SLICE_BYTES = 8 << 20
_MADE: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a folder of our own only on a local master where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        named = spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="run-")
        spark.sparkContext.setCheckpointDir(named)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, removed when the session ends."""
    app = spark.sparkContext.applicationId
    path = f"{shared_dir(spark).rstrip('/')}/llm-{app}/{name}-{uuid.uuid4().hex[:12]}"
    if app not in _MADE:
        _MADE[app] = []
        atexit.register(_remove_all, spark, app)
    _MADE[app].append(path)
    return path


def _remove_all(spark: SparkSession, app: str) -> None:
    for path in _MADE.pop(app, []):
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session has ended already; nothing to do at exit
            return


def make_folder(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def keep(df: DataFrame, name: str) -> DataFrame:
    """The rows written once as a table in the shared folder and read again: a lost executor loses none of it."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def whole_text(col: str | Column = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of the batches whose texts have about ``limit`` bytes, or one longer text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        begin, held = 0, 0
        for i, n in enumerate(lengths.tolist()):
            if i > begin and held + n > limit:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += n
        yield batch.slice(begin)


class Recent:
    """Values by text, those used last: two generations of at most ``limit`` / 2 bytes each, whatever the texts' lengths. For what a task
    remembers; ``clear`` gives the memory back when its rows are done, since Spark keeps Python workers for later tasks."""

    ENTRY = 200        # bytes of an entry besides its text and value

    def __init__(self, limit: int = 32 << 20):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0

    def get(self, texts: list[str], make: Callable[[list[str]], dict[str, bytes]]) -> list[bytes]:
        """The values of distinct texts; ``make`` gives those that are not remembered."""
        new, old = self.new, self.old
        got = [new.get(t) for t in texts]
        fresh, missing = {}, []
        for i, v in enumerate(got):
            if v is None:
                v = old.get(texts[i])
                if v is None:
                    missing.append(i)
                else:
                    fresh[texts[i]] = got[i] = v
        if missing:
            made = make([texts[i] for i in missing])
            fresh.update(made)
            for i in missing:
                got[i] = made[texts[i]]
        for t, v in fresh.items():
            if self.held > self.limit // 2:
                self.old, self.new, self.held = self.new, {}, 0
            self.new[t] = v
            self.held += len(t) + len(v) + self.ENTRY
        return got
