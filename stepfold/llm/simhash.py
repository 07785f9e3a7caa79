"""SimHash fingerprints and their near duplicates by bit-sliced comparison.

A bit of a document's fingerprint is 1 if it is set in over half of the hashes of its word shingles. Documents with
one fingerprint are one from the start; only distinct fingerprints are compared. Their 64 bits are cut into
radius + r blocks: two that differ in at most `radius` bits agree in r blocks or more, so each choice of r blocks is a
table of buckets of equal bits, and every link lies in a bucket of some table. r is the least for which a bucket has
few members on average; every r gives the same links.

In a bucket, members stand in blocks of 64 lanes, stored as bit planes: plane k holds bit k of 64 members in one word.
A member is compared with a block by 64 exclusive-ors, whose bits are added by carry-save counters that are bitwise
too; as soon as all lanes of a block exceed the radius, the block is abandoned. Members that are found linked get one
label at once, a block whose lanes all have the label of the member at hand is passed over, and of a bucket only links
that span its components are sent: fewer than it has members. A bucket beyond TILE members is cut into tiles, and each
pair of tiles is compared on its own, so that no task takes in a whole hot bucket. Components then follow from the links.

Words are maximal runs of anything but ASCII white space, A-Z in lower case; a document of fewer words than a shingle
has all of them as one. Null or empty text has no hashes and the fingerprint zero, which is linked like any other. Texts
of any length are taken whole. A bit that is set in exactly half of the hashes is 0. Repeated rows are rows of their
own. A null doc_id is linked as any other row is, but never names a component: rows linked to nothing but such rows have
the component null. Only doc_id and text are read, so other columns of any name do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepfold.llm.common import Scratch, ranges, row_blocks, text_bytes
from stepfold.llm.components import components
from stepfold.llm.wordlists import LOWER, spaced, word_spans

SEED = 42
#: Members of a bucket on average up to which a table has no more bits.
MEMBERS = 2048
#: Members of a tile, of which a task holds two.
TILE = 16_384
#: Pairs of a member and a block that are compared at once.
PAIRS = 1 << 16
#: Bit planes between looks at what can be abandoned.
PLANES = 8
#: Bytes of text whose shingles are hashed at once.
BLOCK = 1 << 20
#: Links that are joined at once.
LINKS = 1 << 20
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _bit_sums(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many of the hashes of each group have each bit set; groups lie end to end and have a hash at least."""
    spread = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8")[:, 0]
    sizes = np.diff(np.concatenate([first, [len(hashes)]]))
    # each byte of a word counts one bit, so 255 hashes are added before the bytes are
    pieces = -(-sizes // 255)
    at = np.repeat(first, pieces) + 255 * ranges(np.zeros(len(sizes), np.int64), pieces)
    of_group = np.cumsum(pieces) - pieces
    octets = np.ascontiguousarray(hashes).astype("<u8").view(np.uint8).reshape(-1, 8)
    sums = np.empty((len(first), 64), np.int64)
    for k in range(8):
        part = np.add.reduceat(spread[octets[:, k]], at)
        sums[:, 8 * k : 8 * k + 8] = np.add.reduceat(part.view(np.uint8).reshape(-1, 8).astype(np.int64), of_group, axis=0)
    return sums


def fingerprints_of(data: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """The fingerprint of each row of a block of texts."""
    first, last, counts = word_spans(data, starts)
    text, at = spaced(LOWER[data], first, last)
    held = memoryview(text.tobytes())
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    begin = ranges(np.cumsum(counts) - counts, n)
    end = begin + np.repeat(np.minimum(counts, size), n)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(held[a:b], SEED) for a, b in zip(at[begin].tolist(), (at[end] - 1).tolist(), strict=True)), np.uint64, len(begin))
    out = np.zeros(len(counts), np.uint64)
    some = n > 0
    if some.any():
        most = 2 * _bit_sums(hashes, (np.cumsum(n) - n)[some]) > n[some, None]
        out[some] = np.packbits(most, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def fingerprints(docs: DataFrame, size: int = 4) -> DataFrame:
    """doc_id, f (the fingerprint as a signed number) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = text_bytes(batch.column(1))
            out = [fingerprints_of(data[starts[a] : starts[b]], starts[a : b + 1] - starts[a], size) for a, b in row_blocks(starts, BLOCK)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([np.zeros(0, np.uint64), *out]).view(np.int64))], ["doc_id", "f"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, f long")


def masks(radius: int, chosen: int) -> list[int]:
    """The bits of each choice of `chosen` of radius + chosen blocks."""
    n = radius + chosen
    cuts = [64 * k // n for k in range(n + 1)]
    blocks = [((1 << b) - 1) & ~((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(c) for c in combinations(blocks, chosen)]


def chosen_for(n: int, radius: int) -> int:
    """The least number of blocks to agree in so that buckets of n even fingerprints have MEMBERS members at most."""
    return next((r for r in range(1, 65 - radius) if n >> min(bin(m).count("1") for m in masks(radius, r)) <= MEMBERS), 8)


def planes_of(members: np.ndarray) -> np.ndarray:
    """Bit planes of blocks of 64 members: row k has bit k of the members of each block."""
    bits = np.unpackbits(members.astype("<u8").view(np.uint8).reshape(-1, 64, 8), axis=2, bitorder="little")
    octets = np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little")
    return np.ascontiguousarray(octets).view("<u8")[:, :, 0]


def within(planes: np.ndarray, member: np.ndarray, block: np.ndarray, lanes: np.ndarray, radius: int) -> np.ndarray:
    """For each pair of a member and a block, the lanes (of those given) that differ from the member in at most `radius` bits."""
    counter = radius.bit_length() + 1
    out = np.zeros(len(member), np.uint64)
    at = np.arange(len(member))
    # the counters begin so high that they overflow beyond the radius: the top bit stays set then
    begin = (1 << (counter - 1)) - 1 - radius
    sums = [np.full(len(member), _ALL if begin >> k & 1 else 0, np.uint64) for k in range(counter - 1)]
    over = ~lanes
    for k in range(64):
        carry = planes[k][block] ^ (np.uint64(0) - ((member >> np.uint64(k)) & np.uint64(1)))
        for i, x in enumerate(sums):
            sums[i], carry = x ^ carry, x & carry
        over |= carry
        if k % PLANES == PLANES - 1:
            live = over != _ALL
            if not live.all():
                member, block, at, over = member[live], block[live], at[live], over[live]
                sums = [x[live] for x in sums]
                if not len(at):
                    return out
    out[at] = ~over
    return out


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Gives the ends of each link one label, the least; labels point at rows that have themselves as label."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


def spanning(values: np.ndarray, bucket: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) of values that join all that are linked in each bucket; buckets are numbers that ascend.

    side 0: a member is compared with those after it. Members of side 1 are compared with those of side 2 alone, which
    come after them in the bucket.
    """
    _, own, sizes = np.unique(bucket, return_inverse=True, return_counts=True)
    several = sizes[own] > 1
    values, side, sizes = values[several], side[several], sizes[sizes > 1]
    n, first = len(values), np.cumsum(sizes) - sizes
    if not n:
        return values, values
    blocks = -(-sizes // 64)
    of_bucket = np.cumsum(blocks) - blocks
    owner = np.repeat(np.arange(len(first)), sizes)
    place = np.arange(n) - first[owner]
    slot = 64 * of_bucket[owner] + place
    padded = np.zeros(64 * int(blocks.sum()), np.uint64)
    padded[slot] = values
    row_at = np.full(len(padded), -1, np.int64)
    row_at[slot] = np.arange(n)
    asked_of = np.zeros(len(padded), bool)
    asked_of[slot] = side != 1
    filled = np.packbits(asked_of.reshape(-1, 64), axis=1, bitorder="little").view("<u8")[:, 0]
    planes = planes_of(padded)
    label = np.arange(n)
    # each member with the blocks from its own on
    asked = np.flatnonzero(side != 2)
    todo = (of_bucket + blocks)[owner[asked]] - slot[asked] // 64
    done = np.concatenate([[0], np.cumsum(todo)])
    begin = 0
    while begin < len(asked):
        end = max(begin + 1, int(np.searchsorted(done, done[begin] + PAIRS, side="right")) - 1)
        rows = np.repeat(asked[begin:end], todo[begin:end])
        block = ranges(slot[asked[begin:end]] // 64, todo[begin:end])
        begin = end
        # blocks of which all lanes have the member's label have nothing to tell
        held = np.where(row_at >= 0, label[np.maximum(row_at, 0)], -1).reshape(-1, 64)
        low = np.where(held < 0, n, held).min(axis=1)
        apart = (low[block] != label[rows]) | (held.max(axis=1)[block] != label[rows])
        rows, block = rows[apart], block[apart]
        own = slot[rows] // 64 == block
        after = (np.uint64(0xFFFFFFFFFFFFFFFE) << (slot[rows] % 64).astype(np.uint64)) * own + _ALL * ~own
        lanes = filled[block] & after
        hits = within(planes, values[rows], block, lanes, radius)
        for a in range(0, len(hits), max(1, LINKS // 64)):
            some = np.flatnonzero(hits[a : a + LINKS // 64]) + a
            pair, lane = np.nonzero(np.unpackbits(hits[some].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            joined(label, rows[some[pair]], row_at[64 * block[some[pair]] + lane])
    linked = np.flatnonzero(label != np.arange(n))
    return values[linked], values[label[linked]]


def _bucket_links(rows: DataFrame, radius: int) -> DataFrame:
    """a, b from rows (t, bucket, i, j, side, f) that are sorted by bucket, tiles and side."""

    def flush(parts: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        key, side, f = (np.concatenate(x) for x in zip(*parts, strict=True))
        a, b = spanning(f, key, side, radius)
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        n, seen, last = 0, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(4)], axis=1)
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]).any(axis=1)
            new[0] = last is None or (keys[0] != last).any()
            last = keys[-1]
            group = seen + np.cumsum(new)
            seen = int(group[-1])
            side, f = batch.column(4).to_numpy(zero_copy_only=False), batch.column(5).to_numpy(zero_copy_only=False).view(np.uint64)
            # whole buckets go as soon as there are many rows; the one at the end of a batch may go on
            cut = int(np.flatnonzero(new)[-1]) if new.any() else 0
            if (cut or new[0]) and n + cut > TILE:
                if cut:
                    held.append([group[:cut], side[:cut], f[:cut]])
                yield from flush(held)
                held, n = [], 0
            else:
                cut = 0
            held.append([group[cut:], side[cut:], f[cut:]])
            n += len(keys) - cut
        if held:
            yield from flush(held)

    return rows.select("t", "bucket", "i", "j", "side", "f").mapInArrow(run, "a long, b long").distinct()


def links(scratch: Scratch, distinct: DataFrame, radius: int = 4, tile: int | None = None) -> DataFrame:
    """a, b of fingerprints (f, each once) so that those linked by chains of at most `radius` differing bits are joined."""
    tile = tile or TILE
    tables = masks(radius, chosen_for(distinct.count(), radius))
    signed = [m - (1 << 64) if m >> 63 else m for m in tables]
    keys = F.array(*(F.struct(F.lit(t).alias("t"), F.col("f").bitwiseAND(F.lit(m)).alias("bucket")) for t, m in enumerate(signed)))
    rows = distinct.select("f", F.explode(keys).alias("k")).select("k.t", "k.bucket", "f")
    large = scratch.write(rows.groupBy("t", "bucket").count().where(F.col("count") > tile).select("t", "bucket", F.ceil(F.col("count") / tile).cast("int").alias("tiles")), "large")
    one = lambda x, kind: F.lit(x).cast(kind)
    if large.isEmpty():
        dealt = rows.select("t", "bucket", one(0, "int").alias("i"), one(0, "int").alias("j"), one(0, "int").alias("side"), "f")
    else:
        sized = rows.join(large, ["t", "bucket"], "left")
        own = F.pmod(F.xxhash64("f", F.lit(1)), F.col("tiles")).cast("int")
        # a tile meets itself and each other one
        pair = lambda x: F.struct(F.least(own, x).alias("i"), F.greatest(own, x).alias("j"), F.when(own == x, 0).when(own < x, 1).otherwise(2).cast("int").alias("side"))
        alone = F.array(F.struct(one(0, "int").alias("i"), one(0, "int").alias("j"), one(0, "int").alias("side")))
        met = F.when(F.col("tiles").isNull(), alone).otherwise(F.transform(F.sequence(F.lit(0), F.coalesce("tiles", F.lit(1)) - 1), pair))
        dealt = sized.select("t", "bucket", "f", F.explode(met).alias("m")).select("t", "bucket", "m.i", "m.j", "m.side", "f")
    sorted_rows = dealt.repartition("t", "bucket", "i", "j").sortWithinPartitions("t", "bucket", "i", "j", "side", "f")
    return _bucket_links(sorted_rows, radius)


def deduplicate(spark: SparkSession, docs: DataFrame, size: int = 4, radius: int = 4, tile: int | None = None) -> DataFrame:
    """doc_id, f and component_id (the least doc_id that links reach) of each row."""
    scratch = Scratch(spark, "simhash")
    found = scratch.write(fingerprints(docs, size), "fingerprints")
    distinct = scratch.write(found.groupBy("f").agg(F.min("doc_id").alias("least")), "distinct")
    edges = scratch.write(links(scratch, distinct.select("f"), radius, tile), "links")
    groups = scratch.write(components(scratch, edges), "groups")
    of = distinct.join(groups, distinct.f == groups.id, "left").select("f", "least", F.coalesce("component", "f").alias("component"))
    least = scratch.write(of.groupBy("component").agg(F.min("least").alias("component_id")), "least")
    named = scratch.write(of.join(least, "component").select(F.col("f").alias("g"), "component_id"), "named")
    return found.join(named, F.col("f") == F.col("g")).select("doc_id", "f", "component_id")


def report(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")
