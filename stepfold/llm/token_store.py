"""Token-ID output: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

Format. A store is a folder with two Parquet tables, so that any Hadoop file system holds it and Spark's own commit
keeps it whole when tasks are retried:
  ranks   rank, id, n: the token of each rank; rank 0 is the most frequent token of the whole store, ties by id.
  blocks  shard, block, first, doc_ids, counts, control, data: runs of whole documents in ascending doc_id order.
          `first` is the number of ids before the block in its shard. The ids of a block, as ranks, are written as
          their 1 to 4 low bytes in `data`; two bits a value in `control` (lowest first) hold the bytes less one.
Frequent tokens take one byte, others two or three. A control byte gives four lengths by table lookup, so numpy
decodes a block without branching on values.

Null text is an empty document (its end id alone). Rows that repeat a doc_id are documents of their own; ties are
ordered by their number of ids, then by the ids. A null doc_id comes first. An empty table gives an empty store.
A text of any length is one document, in a block of its own if it has more ids than a block. Only doc_id and text are
read, so other columns of any name do not matter. The counts that ranks come from are made while texts are encoded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stepfold.llm.common import Scratch
from stepfold.llm.tokens import SLICE, encoder

#: Ids of a block, unless one document has more.
BLOCK_IDS = 1 << 19
#: Bytes of encoded ids that a shard is planned to hold.
SHARD_BYTES = 64 << 20
_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.int64) + 1
_ENCODED = "doc_id long, n_tokens long, ids binary"
_BLOCKS = "shard int, block int, first long, doc_ids array<long>, counts array<long>, control binary, data binary"


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    v = values.astype(np.uint32)
    extra = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    codes = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    codes[: len(v)] = extra
    control = codes[0::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    ends = np.cumsum(extra.astype(np.int64) + 1)
    first = ends - extra - 1
    data = np.empty(int(ends[-1]) if len(v) else 0, np.uint8)
    data[first] = v & 0xFF
    for k in (1, 2, 3):
        has = np.flatnonzero(extra >= k)
        data[first[has] + k] = (v[has] >> (8 * k)) & 0xFF
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values that pack() wrote."""
    lengths = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    first, data = np.cumsum(lengths) - lengths, np.frombuffer(data, np.uint8)
    out = data[first].astype(np.uint32)
    for k in (1, 2, 3):
        has = np.flatnonzero(lengths > k)
        out[has] |= data[first[has] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def id_type(tokenizer: str) -> str:
    """Two bytes hold the ids of either public vocabulary; larger ones take four."""
    return "<u2" if encoder(tokenizer).tokenizer.get_vocab_size() <= 1 << 16 else "<u4"


def encoded(docs: DataFrame, tokenizer: str, end_id: int, kind: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian, of numpy type `kind`) of each row, the end id included.

    Each task ends with one more row, whose n_tokens is -1 and whose ids say how often it has met each id (64 bits).
    """
    width = np.dtype(kind).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, seen = ["doc_id", "n_tokens", "ids"], np.zeros(0, np.int64)
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                part = batch.slice(at, SLICE)
                ids, counts = encoder(tokenizer).encode(part.column(1))
                ends = np.cumsum(counts)
                ids = np.insert(ids.astype(kind), ends, end_id)
                n = np.bincount(ids)
                if len(n) > len(seen):
                    n, seen = seen, n
                seen[: len(n)] += n
                offsets = np.concatenate([[0], width * np.cumsum(counts + 1)]).astype(np.int32)
                column = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts + 1), column], names)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([-1]), pa.array([seen.astype("<i8").tobytes()])], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _ENCODED)


def token_counts(ids: DataFrame) -> DataFrame:
    """id, n: how often each token occurs in the whole table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                n = np.frombuffer(x.as_buffer(), "<i8")
                found = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(n[found], pa.int64())], ["id", "n"])

    return ids.where("n_tokens = -1").select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_store(spark: SparkSession, docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Encodes every whole text once, ranks the tokens by their count in the whole table, and writes the store."""
    scratch = Scratch(spark, "token-ids")
    kind = id_type(tokenizer)
    ids = scratch.write(encoded(docs, tokenizer, end_id, kind), "ids")
    # the vocabulary bounds this: at most one row for each id of the tokenizer
    counts = sorted(((-n, i) for i, n in token_counts(ids).collect()))
    spark.createDataFrame([(rank, i, -n) for rank, (n, i) in enumerate(counts)] or [], "rank int, id long, n long").coalesce(1).write.parquet(f"{path}/ranks")
    rank = np.zeros(max((i for _, i in counts), default=0) + 1, np.uint32)
    rank[[i for _, i in counts]] = np.arange(len(counts))
    total = int(-np.dtype(kind).itemsize * sum(n for n, _ in counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, first = TaskContext.get().partitionId(), 0, 0
        names, parts, counts, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            control, data = pack(rank[np.concatenate(parts)])
            cells = [shard, block, first, names, counts, control, data]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(cells, kinds, strict=True)], [x.split()[0] for x in _BLOCKS.split(", ")])

        for batch in batches:
            for doc, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                names.append(doc)
                parts.append(np.frombuffer(x.as_buffer(), kind))
                counts.append(len(parts[-1]))
                held += counts[-1]
                if held >= BLOCK_IDS:
                    yield flush()
                    first, block = first + held, block + 1
                    names, parts, counts, held = [], [], [], 0
        if names:
            yield flush()

    shards = max(1, -(-total // SHARD_BYTES), min(ids.rdd.getNumPartitions(), -(-total // (4 << 20))))
    in_order = ids.where("n_tokens >= 0").repartitionByRange(int(shards), "doc_id").sortWithinPartitions("doc_id", "n_tokens", "ids")
    in_order.select("doc_id", "ids").mapInArrow(run, _BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    scratch.drop(ids)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian unsigned 32-bit) of every document of a store."""
    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    ranks = spark.read.parquet(f"{path}/ranks").orderBy("rank").select("id").collect()  # one row for each token
    token = np.array([r.id for r in ranks] or [0], np.uint32)
    # a row for each shard, of tens of megabytes; only the columns of numbers are read
    sizes = blocks.select("shard", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("shard").agg(F.sum("n").alias("n"))
    before = sizes.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                docs, counts = batch.column(0)[row].values, batch.column(1)[row].values.to_numpy()
                ids = token[unpack(batch.column(2)[row].as_py(), batch.column(3)[row].as_py(), int(counts.sum()))].astype("<u4")
                ends = np.cumsum(counts)
                offsets = np.concatenate([[0], 4 * ends]).astype(np.int32)
                column = pa.Array.from_buffers(pa.binary(), len(docs), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([docs, pa.array(batch.column(4)[row].as_py() + ends - counts), pa.array(counts), column], ["doc_id", "start", "n_tokens", "ids"])

    whole = blocks.join(F.broadcast(before), "shard").select("doc_ids", "counts", "control", "data", (F.col("first") + F.col("before")).alias("at"))
    return whole.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def digest(ids: DataFrame) -> DataFrame:
    return ids.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
