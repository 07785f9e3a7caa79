"""What the corpus operators share: tables, the shared scratch folder, and byte views of Arrow text."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java regular expressions of words and of the ASCII white space that parts them.
SPACE = r"[\x20\x09-\x0D]"
#: Bytes of text that a vectorised kernel handles at once; it bounds the memory of a Python worker.
KERNEL_BYTES = 1 << 22


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns(df: DataFrame) -> list[Column]:
    """The columns of `df`, whatever characters their names have."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def unused(df: DataFrame, n: int) -> list[str]:
    """`n` names that no column of `df` has."""
    taken = {c.lower() for c in df.columns}
    return [x for x in (f"_{i}" for i in range(n + len(taken))) if x not in taken][:n]


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share. Where it is unset, a fresh local one will do if the session has one machine; on a cluster there is no such folder, so that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="stepfold-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Lets Spark remove the shuffle files of a query that has ended.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of an Arrow batch while a table is written: ten thousand whole texts at once would be tens of megabytes for each task.
BATCH_ROWS, BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


class Scratch:
    """Intermediate tables in the shared folder. They survive lost executors; drop() frees their disk, and what is left goes with release() or when the driver ends."""

    _open: list[Scratch] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        if not Scratch._open:
            atexit.register(Scratch.release)
        Scratch._open.append(self)

    @classmethod
    def mark(cls) -> int:
        return len(cls._open)

    @classmethod
    def release(cls, mark: int = 0) -> None:
        """Removes all tables that were made since the mark. Nothing may read them any more."""
        for x in cls._open[mark:]:
            with contextlib.suppress(Exception):  # the session may have ended
                x._delete(x.root)
        del cls._open[mark:]

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        # what led to the table isn't needed once it is written, so Spark may remove its shuffle files then
        old = {SHUFFLE_CLEANUP: self.spark.conf.get(SHUFFLE_CLEANUP, "false"), BATCH_ROWS: self.spark.conf.get(BATCH_ROWS)}
        held = {SHUFFLE_CLEANUP: "true", BATCH_ROWS: str(min(BATCH, int(old[BATCH_ROWS])))}
        for k, v in held.items():
            self.spark.conf.set(k, v)
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            for k, v in old.items():
                self.spark.conf.set(k, v)
        return self.read(path, df)

    def read(self, path: str, like: DataFrame) -> DataFrame:
        out = self.spark.read.schema(like.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            self._delete(df._scratch_path)

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def words_of(text: Column) -> Column:
    """Maximal runs of anything but ASCII white space; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def settled(df: DataFrame, name: str, value: Column) -> DataFrame:
    """`df` with a column that is computed once a row: later filters on what is made of it can't copy its expression, say into a lambda."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column end to end, and where each row starts (one more than rows). Null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_blocks(starts: np.ndarray, limit: int = KERNEL_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes, or of one longer row."""
    row, n = 0, len(starts) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(starts, starts[row] + limit, side="right")) - 1)
        yield row, end
        row = end


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of each range, end to end."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
