"""Best-fit packing of tokenized documents into sequences of at most `capacity` tokens.

Only the length of a piece matters to a packing, and a length is at most the capacity, so the instance is the
table of how many pieces have each length: at most `capacity` numbers, whatever the input. On these
  1. Martello and Toth's dominance reduction fixes sets of one, two or three lengths that can be shown to be as good
     as any other set with the longest one, and shrinks the instance by them;
  2. best-fit decreasing packs the remainder, whole runs of equal sequences at a time.
The plan is a list of (length, first rank, how many, first sequence, offset); the pieces get their ranks within
their length by counting, in parts of bounded size, and look themselves up.

Null text is an empty document: one piece, its end id. Rows that repeat a doc_id are documents of their own.
A document over the capacity is cut into pieces of the full capacity, its first piece takes the rest, however long it
is. Ties of a length are ranked by doc_id, piece and checksum; rows that tie in these are alike. An empty table gives no
rows. Only doc_id and text are read, so other columns of any name do not matter.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stepfold.llm.common import Scratch
from stepfold.llm.tokens import SLICE, encoder

#: Pieces of a part within which ranks are counted by a sort.
PART_ROWS = 200_000
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                part = batch.slice(at, SLICE)
                ids, counts = encoder(tokenizer).encode(part.column(1))
                ids = np.insert(ids, np.cumsum(counts), end_id).astype("<u4")
                sizes = counts + 1
                n = -(-sizes // capacity)
                row = np.repeat(np.arange(len(part)), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                head = (sizes - (n - 1) * capacity)[row]
                start = np.where(piece == 0, 0, head + (piece - 1) * capacity)
                length = np.where(piece == 0, head, capacity)
                begin = (np.cumsum(sizes) - sizes)[row] + start
                view = memoryview(ids).cast("B")
                crc = [zlib.crc32(view[4 * b : 4 * e]) for b, e in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], [x.split()[0] for x in _PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _PIECES)


def _sums(lengths: list[int], least: int, most: int) -> bool:
    """Whether a sum of two or more of these lengths, repeated at will, lies from least to most."""
    reach = one = sum(1 << x for x in lengths)
    span = (1 << (most + 1)) - 1
    total = 0
    while reach:
        longer = 0
        for x in lengths:
            longer |= reach << x
        reach = longer & span & ~total
        total |= reach
    return bool(total >> least) and one > 0


def _third(left: dict[int, int], j: int, room: int) -> tuple[int, ...] | None:
    """The two lengths a >= b that beside j dominate all else, if any do.

    They do if no three items fit beside j, a is the longest that fits alone, b the longest that fits with it, and no
    two lengths between them fit together: then of any two others the longer is at most a and the shorter at most b.
    """
    own = {x: n - (x == j) for x, n in left.items() if x <= room and n > (x == j)}
    lengths = sorted(own)
    least = [x for x in lengths for _ in range(min(own[x], 3))][:3]
    if len(least) == 3 and sum(least) <= room:
        return None
    a = lengths[-1]
    b = max((x for x in lengths if a + x <= room and own[x] > (x == a)), default=None)
    if b is None:
        return None
    between = [x for x in lengths if b < x < a for _ in range(min(own[x], 2))][:2]
    return None if len(between) == 2 and sum(between) <= room else (a, b)


def reduce_instance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Sets that dominance fixes, each with how often, and the counts that remain.

    A set with j dominates every other set with j if it holds, beside j, one item k, and nothing else that fits
    beside j can sum to more than k: whatever another packing puts beside j fits where k was. So does one that holds
    two items, if what another packing puts beside j can be split to fit where these were.
    """
    left = {x: n for x, n in counts.items() if n}
    fixed = []
    for j in sorted(left, reverse=True):
        while left.get(j):
            room = capacity - j
            own = sorted(x for x, n in left.items() if x <= room and n > (x == j))
            if not own:
                fixed.append(((j,), left.pop(j)))
                break
            k = own[-1]
            if k < room and (k + own[0] <= room or _sums([x for x in own if x <= room], k + 1, room)):
                if (two := _third(left, j, room)) is None:
                    break
                held = (j, *two)
            else:
                held = (j, k)
            n = min(left[x] // held.count(x) for x in held)
            fixed.append((held, n))
            for x in held:
                left[x] -= n
            left = {x: n for x, n in left.items() if n}
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing: each item goes to the open sequence with the least room that takes it."""
    rooms: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    order: list[int] = []
    for x in sorted(counts, reverse=True):
        n = counts[x]
        while n:
            at = bisect_left(order, x)
            if at < len(order):
                room = order[at]
                held, many = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room], order[at]
            else:
                room, held, many = capacity, (), n
            each = min(room // x, n)
            full = min(many, n // each)
            if many > full and held:
                rooms.setdefault(room, []).append((held, many - full)) or (room in order or insort(order, room))
            rest = room - each * x
            rooms.setdefault(rest, []).append((held + (x,) * each, full))
            if rest not in order:
                insort(order, rest)
            n -= each * full
    return [s for group in rooms.values() for s in group]


def plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted: a piece takes the last row with its length and a rank not above its own."""
    fixed, left = reduce_instance(counts, capacity)
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for held, many in [*fixed, *best_fit(left, capacity)]:
        offset = 0
        for x in held:
            rows.append((x, used.get(x, 0), sequence, offset))
            used[x] = used.get(x, 0) + many
            offset += x
        sequence += many
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def ranked(found: DataFrame, total: int) -> DataFrame:
    """`found` with rank: the number of a piece among those of its length, from 0, counted in parts."""
    parts = max(1, -(-total // PART_ROWS))
    by = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    dealt = found.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)).cast("int"))
    sizes = dealt.groupBy("length", "part").count()
    before = sizes.select("length", "part", (F.sum("count").over(Window.partitionBy("length").orderBy("part")) - F.col("count")).alias("before"))
    return dealt.withColumn("nth", F.row_number().over(by)).join(before, ["length", "part"]).withColumn("rank", F.col("before") + F.col("nth") - 1).drop("part", "nth", "before")


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 2048) -> DataFrame:
    found = Scratch(spark, "packing").write(pieces(docs, tokenizer, end_id, capacity), "pieces")
    counts = {r.length: r["count"] for r in found.groupBy("length").count().collect()}  # at most `capacity` rows
    rows = plan(counts, capacity)
    key = rows[:, 0] << 44 | rows[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(key, length << 44 | rank, side="right") - 1
            cells = [*(batch.column(x.split()[0]) for x in _PIECES.split(", ")), pa.array(rows[at, 2] + rank - rows[at, 1]), pa.array(rows[at, 3])]
            yield pa.RecordBatch.from_arrays(cells, [*(x.split()[0] for x in _PIECES.split(", ")), "sequence_id", "offset"])

    return ranked(found, sum(counts.values())).mapInArrow(run, _PIECES + ", sequence_id long, offset long")
