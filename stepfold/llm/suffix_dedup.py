"""Removal of repeated passages by a sparse suffix array, merged from front-coded sorted runs.

A byte goes if a string of LENGTH bytes that also starts anywhere else covers it. Of the suffixes, those matter that
start at an anchor: the gram of GRAM bytes with the least hash in each window of LENGTH bytes (the first of equals).
Equal windows have equal anchors in equal places, so each repeated string holds an anchor whose gram is repeated;
anchors are one byte in fifty, and those with a gram that occurs once are dropped at once.

What stands around a repeated anchor, its suffix of LENGTH bytes and the LENGTH - GRAM bytes before, decides. Each
task sorts its suffixes into runs, front-codes them (the length of the prefix shared with the one before, then the
rest) and drops repeats within a run. Runs meet by gram; a loser tree merges them and compares two suffixes only from
the prefix that both are known to share with the last one out. The merged order gives the shared prefix of neighbours,
so equal prefixes of any length are ranges of it; with the same for the bytes before, the windows at every offset
around an anchor are pairs of range numbers, and the repeated ones are pairs that occur twice. No two suffixes of a
group are compared for their own sake.

Hashes of 64 bits choose what to compare; a wrong match of them costs time alone. Bytes decide between runs. 128 bits
of hashes decide in two places: which suffixes of one task repeat each other with all that stands around them, and for
a gram that occurs over HOT times, which isn't merged in one place. Its occurrences are first counted by the hash of
what stands around them, one row each; of each distinct surrounding one occurrence sends the hashes of its windows. A
wrong match among n of them has a chance of n * n / 2**129, so 1e-15 for 10**12.

Null text is empty. A text shorter than LENGTH keeps all; longer ones of any length are taken whole. Rows that repeat a
doc_id, or a whole row, are documents of their own, so a long text in two rows goes from both: no copy of a repeated
string is kept, so ties don't arise. Matches never cross documents. Only doc_id and text are read, so other columns of
any name do not matter. An empty table gives no rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepfold.llm.common import Scratch, ranges, row_blocks, text_bytes
from stepfold.llm.textsets import BYTE, mix, prefix_hashes

LENGTH, GRAM = 200, 100
BEFORE = LENGTH - GRAM
#: Occurrences of a gram up to which its suffixes are merged in one place; suffixes of a merge.
HOT, MERGE = 100_000, 60_000
BLOCK = 1 << 20
#: Kinds of the columns of a place.
_PLACE = ("<u4", "<u1", "<i8", "<i8", "<i4")
_OTHER = np.random.default_rng(7).integers(0, 2**64, 256, dtype=np.uint64)


def anchors(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors of all rows of a block, and the hashes of their grams."""
    n = len(data)
    lengths = np.diff(starts)
    if n < LENGTH or not (lengths >= LENGTH).any():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h, down = prefix_hashes(data, BYTE)
    gram = mix((h[GRAM:] - h[:-GRAM]) * down[: n + 1 - GRAM])
    bits = np.uint64(n.bit_length())
    key = (gram >> bits << bits) | np.arange(len(gram), dtype=np.uint64)
    width = BEFORE + 1
    blocks = -(-len(key) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(key)] = key
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    # windows that lie in one row hold only grams of that row
    row = np.flatnonzero(lengths >= LENGTH)
    at = ranges(starts[:-1][row], lengths[row] - LENGTH + 1)
    least = np.minimum(behind[at], ahead[at + BEFORE]) & ((np.uint64(1) << bits) - np.uint64(1))
    chosen = np.zeros(n, bool)
    chosen[least.astype(np.int64)] = True
    places = np.flatnonzero(chosen)
    return places, gram[places]


def anchor_rows(docs: DataFrame) -> DataFrame:
    """k, pos, h of each anchor; k is a hash of the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = text_bytes(batch.column(1))
            keys = batch.column(0).to_numpy()
            for a, b in row_blocks(starts, BLOCK):
                own = starts[a : b + 1] - starts[a]
                places, h = anchors(data[starts[a] : starts[b]], own)
                row = np.searchsorted(own, places, side="right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(keys[a:b][row]), pa.array((places - own[row]).astype(np.int32)), pa.array(h.view(np.int64))], ["k", "pos", "h"])

    return docs.select("k", "text").mapInArrow(run, "k long, pos int, h long")


def _grid(data: np.ndarray, first: np.ndarray, lengths: np.ndarray, width: int, step: int) -> np.ndarray:
    """Bytes from `first` on, forwards or backwards, a row each, padded with zeros."""
    out = np.zeros((len(first), width), np.uint8)
    for k in range(width):
        has = lengths > k
        out[has, k] = data[first[has] + step * k]
    return out


def _shared(grid: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The length of the prefix that each row shares with the one before."""
    out = np.zeros(len(grid), np.int64)
    if len(grid) > 1:
        differ = grid[1:] != grid[:-1]
        same = np.where(differ.any(axis=1), differ.argmax(axis=1), grid.shape[1])
        out[1:] = np.minimum(same, np.minimum(lengths[1:], lengths[:-1]))
    return out


def _order(grid: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    by_length = np.argsort(lengths, kind="stable")
    text = np.ascontiguousarray(grid[by_length]).view(f"S{grid.shape[1]}").ravel()
    return by_length[np.argsort(text, kind="stable")]


def write_run(after: np.ndarray, n_after: np.ndarray, before: np.ndarray, n_before: np.ndarray, twice: np.ndarray, places: tuple[np.ndarray, ...]) -> bytes:
    """A front-coded run of suffixes in ascending order, each with the bytes before it (backwards), and the places of its anchors.

    A place is the number of its suffix in the run, whether its document has an id, the id, the hash of its text and its position.
    """
    shared = _shared(after, n_after)
    mask = np.arange(after.shape[1])
    tails = after[(mask >= shared[:, None]) & (mask < n_after[:, None])]
    lefts = before[np.arange(before.shape[1]) < n_before[:, None]]
    parts = [x.astype(np.uint8).tobytes() for x in (shared, n_after, n_before, twice)]
    spots = [np.ascontiguousarray(x, kind).tobytes() for x, kind in zip(places, _PLACE, strict=True)]
    run = b"".join([struct.pack("<qq", len(shared), len(places[0])), *spots, *parts, tails.tobytes(), lefts.tobytes()])
    return zstandard.compress(run, 3)


def read_run(blob: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
    blob = zstandard.decompress(blob)
    n, m = struct.unpack_from("<qq", blob)
    at, places = 16, []
    for kind in _PLACE:
        places.append(np.frombuffer(blob, kind, m, at))
        at += m * np.dtype(kind).itemsize
    shared, n_after, n_before, twice = (np.frombuffer(blob, np.uint8, n, at + k * n).astype(np.int64) for k in range(4))
    at, out, last = at + 4 * n, [], b""
    for s, e in zip(shared.tolist(), n_after.tolist(), strict=True):
        last = last[:s] + blob[at : at + e - s]
        at += e - s
        out.append(last)
    before = np.zeros((n, BEFORE), np.uint8)
    before[np.arange(BEFORE) < n_before[:, None]] = np.frombuffer(blob, np.uint8, int(n_before.sum()), at)
    return out, shared, n_after, before, n_before, twice, tuple(places)


def merged(runs: list[tuple[list[bytes], np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Run, place in it, and prefix shared with the one before, of all suffixes in ascending order.

    A loser tree. known[i] is the prefix that the head of run i shares with the last suffix out. Of two heads the one
    with the longer known prefix is the smaller; only for equal ones are bytes compared, from there on.
    """
    k = 1 << max(0, (len(runs) - 1).bit_length())
    strings = [r[0] for r in runs] + [[]] * (k - len(runs))
    shares = [r[1].tolist() for r in runs] + [[]] * (k - len(runs))
    place, known = [0] * k, [0] * k
    head: list[bytes | None] = [s[0] if s else None for s in strings]

    def play(a: int, b: int) -> tuple[int, int]:
        x, y = head[a], head[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        p, q = known[a], known[b]
        if p != q:
            return (a, b) if p > q else (b, a)
        n = min(len(x), len(y))
        z = int.from_bytes(x[p:n], "big") ^ int.from_bytes(y[p:n], "big")
        same = n - (z.bit_length() + 7) // 8
        if same == n:
            first = len(x) <= len(y)
        else:
            first = x[same] < y[same]
        winner, loser = (a, b) if first else (b, a)
        known[loser] = same
        return winner, loser

    losers = [0] * k

    def build(node: int) -> int:
        if node >= k:
            return node - k
        winner, losers[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    out_run, out_place, out_shared = [], [], []
    w = build(1)
    while head[w] is not None:
        out_run.append(w)
        out_place.append(place[w])
        out_shared.append(known[w])
        place[w] += 1
        i = place[w]
        if i < len(strings[w]):
            head[w], known[w] = strings[w][i], shares[w][i]
        else:
            head[w] = None
        node = (w + k) >> 1
        while node:
            w, losers[node] = play(w, losers[node])
            node >>= 1
    return np.array(out_run, np.int64), np.array(out_place, np.int64), np.array(out_shared, np.int64)


def repeated_offsets(shared: np.ndarray, n_after: np.ndarray, before: np.ndarray, n_before: np.ndarray, twice: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest number of bytes before its anchor at which a repeated window of each suffix starts; -1 if none does."""
    n = len(shared)
    low, high = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    group = np.cumsum(shared < GRAM)
    order = np.argsort(group[by := _order(before, n_before)], kind="stable")
    left = by[order]
    left_shared = _shared(before[left], n_before[left])
    left_shared[np.concatenate([[True], group[left][1:] != group[left][:-1]])] = -1
    number = np.empty(n, np.int64)
    size = np.bincount(group, minlength=group[-1] + 1 if n else 0)
    live = (size[group] > 1) | (twice > 1)
    for o in range(BEFORE + 1):
        use = np.flatnonzero(live & (n_before >= o) & (n_after >= LENGTH - o))
        if not len(use):
            continue
        number[left] = np.cumsum(left_shared < o)
        pair = number[use] * (n + 1) + np.cumsum(shared < LENGTH - o)[use]
        _, at, count = np.unique(pair, return_inverse=True, return_counts=True)
        hit = use[(count[at] > 1) | (twice[use] > 1)]
        low[hit] = np.where(low[hit] < 0, o, low[hit])
        high[hit] = o
    return low, high


_AROUND = "doc_id long, t long, pos int, s1 long, s2 long, k long, h long"
_WINDOWS = "s1 long, s2 long, k long, start int, o int, c1 long, c2 long"


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Of each block of rows (text, spots): its bytes, and for each anchor its row in the batch, its place in the bytes, in its text, its hash and how many bytes stand before and from it on.

    Spots come by a hash of their row; one that belongs to another row has no such gram here and is left out.
    """
    data, starts = text_bytes(batch.column("text"))
    spots = batch.column("spots")
    ends = np.concatenate([[0], np.cumsum(np.diff(spots.offsets.to_numpy()))])
    flat = spots.flatten()
    every_pos, every_h = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("pos", "h"))
    for a, b in row_blocks(starts, BLOCK):
        row = np.repeat(np.arange(a, b), np.diff(ends[a : b + 1]))
        pos, h = every_pos[ends[a] : ends[b]], every_h[ends[a] : ends[b]]
        fits = np.flatnonzero(starts[row] + pos + GRAM <= starts[row + 1])
        row, pos, h = row[fits], pos[fits], h[fits]
        at, text = starts[row] - starts[a] + pos, data[starts[a] : starts[b]]
        sums, down = prefix_hashes(text, BYTE)
        own = np.flatnonzero(mix((sums[at + GRAM] - sums[at]) * down[at]) == h.view(np.uint64))
        row, pos, h, at = row[own], pos[own], h[own], at[own]
        n_after = np.minimum(starts[row + 1] - starts[row] - pos, LENGTH)
        yield text, row, at, pos, h, np.minimum(pos, BEFORE).astype(np.int64), n_after


def _spans_of(text: np.ndarray, first: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Two hashes of the bytes from each `first` to its `end`."""
    sums = [prefix_hashes(text, table) for table in (BYTE, _OTHER)]
    return [mix((x[end] - x[first]) * u[first]) for x, u in sums]


def _around(text: np.ndarray, at: np.ndarray, n_before: np.ndarray, n_after: np.ndarray) -> list[np.ndarray]:
    """Two hashes of what stands around each anchor and of how much that is."""
    size = (n_before * 1000 + n_after).astype(np.uint64)
    return [mix(x + mix(size)) for x in _spans_of(text, at - n_before, at + n_after)]


def hot_surroundings(flagged: DataFrame) -> DataFrame:
    """From doc_id, t, k, text, spots (pos, h): a row for each anchor, with two hashes of what stands around it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, row, at, pos, h, n_before, n_after in _blocks(batch):
                s1, s2 = _around(text, at, n_before, n_after)
                ids, ts, ks = (batch.column(c).take(pa.array(row)) for c in ("doc_id", "t", "k"))
                yield pa.RecordBatch.from_arrays([ids, ts, pa.array(pos, pa.int32()), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), ks, pa.array(h)], [x.split()[0] for x in _AROUND.split(", ")])

    return flagged.select("doc_id", "t", "k", "text", "spots").mapInArrow(run, _AROUND)


def hot_windows(flagged: DataFrame) -> DataFrame:
    """From k, text, spots (pos, h): all windows around the anchors, o bytes before them, by two hashes, and those of the surroundings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, row, at, pos, _, n_before, n_after in _blocks(batch):
                s1, s2 = _around(text, at, n_before, n_after)
                low = np.maximum(LENGTH - n_after, 0)
                each = np.maximum(n_before - low + 1, 0)
                o, w = ranges(low, each), np.repeat(np.arange(len(at)), each)
                c1, c2 = _spans_of(text, at[w] - o, at[w] - o + LENGTH)
                cells = [pa.array(s1[w].view(np.int64)), pa.array(s2[w].view(np.int64)), batch.column("k").take(pa.array(row[w])), pa.array(pos[w] - o, pa.int32()), pa.array(o, pa.int32()), pa.array(c1.view(np.int64)), pa.array(c2.view(np.int64))]
                yield pa.RecordBatch.from_arrays(cells, [x.split()[0] for x in _WINDOWS.split(", ")])

    return flagged.select("k", "text", "spots").mapInArrow(run, _WINDOWS)


def sorted_runs(flagged: DataFrame, dests: int) -> DataFrame:
    """From doc_id, t, text, spots (pos, h): front-coded runs of the anchors' suffixes, by dest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ts = batch.column("doc_id"), batch.column("t").to_numpy()
            has_id = ids.is_valid().to_numpy(zero_copy_only=False)
            numbers = ids.fill_null(0).to_numpy()
            for text, row, at, pos, h, n_before, n_after in _blocks(batch):
                if not len(at):
                    continue
                c = _around(text, at, n_before, n_after)
                # one of each equal surroundings goes into the run
                order = np.lexsort(c[::-1])
                new = np.concatenate([[True], np.any([x[order][1:] != x[order][:-1] for x in c], axis=0)])
                first = np.flatnonzero(new)
                pick, twice = order[first], np.minimum(np.diff(np.append(first, len(order))), 2)
                dest = (h[pick].view(np.uint64) % np.uint64(dests)).astype(np.int64)
                after = _grid(text, at[pick], n_after[pick], LENGTH, 1)
                before = _grid(text, at[pick] - 1, n_before[pick], BEFORE, -1)
                by = _order(after, n_after[pick])
                by = by[np.argsort(dest[by], kind="stable")]
                cuts = np.append(np.flatnonzero(np.diff(dest[by], prepend=-1)), len(by))
                # the suffix of each anchor, as its number among all runs; anchors in the order of runs
                number = np.empty(len(at), np.int64)
                number[order] = np.argsort(by)[np.cumsum(new) - 1]
                of_run = np.searchsorted(cuts, number, side="right")
                own = np.argsort(of_run, kind="stable")
                member = np.searchsorted(of_run[own], np.arange(1, len(cuts) + 1))
                blobs = []
                for (x, y), (lo, hi) in zip(zip(cuts, cuts[1:], strict=False), zip(member, member[1:], strict=False), strict=True):
                    r, w = by[x:y], own[lo:hi]
                    places = (number[w] - x, has_id[row[w]], numbers[row[w]], ts[row[w]], pos[w])
                    blobs.append(write_run(after[r], n_after[pick][r], before[r], n_before[pick][r], twice[r], places))
                yield pa.RecordBatch.from_arrays([pa.array(dest[by[cuts[:-1]]], pa.int32()), pa.array(blobs, pa.binary())], ["dest", "blob"])

    return flagged.select("doc_id", "t", "text", "spots").mapInArrow(run, "dest int, blob binary")


def judged(runs: DataFrame, dests: int) -> DataFrame:
    """doc_id, t, start, end of what the repeated windows around each anchor cover."""

    def each(blobs: list[bytes]) -> pa.RecordBatch:
        runs = [read_run(b) for b in blobs]
        run, place, shared = merged([(r[0], r[1]) for r in runs])
        base = np.concatenate([[0], np.cumsum([len(r[0]) for r in runs])])
        first = base[run] + place
        n_after, before, n_before, twice = (np.concatenate([r[k] for r in runs])[first] for k in range(2, 6))
        low, high = np.empty((2, len(first)), np.int64)
        low[first], high[first] = repeated_offsets(shared, n_after, before, n_before, twice)
        suffix = np.concatenate([r[6][0] + b for r, b in zip(runs, base, strict=False)])
        has_id, ids, ts, pos = (np.concatenate([r[6][k] for r in runs]) for k in range(1, 5))
        hit = low[suffix] >= 0
        start, end = (pos - high[suffix])[hit], (pos - low[suffix] + LENGTH)[hit]
        cells = [pa.array(ids[hit], pa.int64(), mask=has_id[hit] == 0), pa.array(ts[hit], pa.int64()), pa.array(start, pa.int32()), pa.array(end, pa.int32())]
        return pa.RecordBatch.from_arrays(cells, ["doc_id", "t", "start", "end"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, blobs = None, []
        for batch in batches:
            for dest, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if dest != at and blobs:
                    yield each(blobs)
                    blobs = []
                at = dest
                blobs.append(blob.as_py())
        if blobs:
            yield each(blobs)

    rows = runs.repartition(dests, "dest").sortWithinPartitions("dest")
    return rows.mapInArrow(merge, "doc_id long, t long, start int, end int")


def _flagged(rows: DataFrame, spots: DataFrame) -> DataFrame:
    """The rows that hold any of the anchors, with them."""
    return rows.join(spots.groupBy("k").agg(F.collect_set(F.struct("pos", "h")).alias("spots")), "k")


def _hot_spans(scratch: Scratch, rows: DataFrame, spots: DataFrame) -> DataFrame:
    """doc_id, t, start, end of what the repeated windows around each anchor of a hot gram cover."""
    around = scratch.write(hot_surroundings(_flagged(rows, spots)), "around")
    groups = scratch.write(around.groupBy("s1", "s2").agg(F.min(F.struct("k", "pos", "h")).alias("one"), F.count("*").alias("m")), "surroundings")
    windows = hot_windows(_flagged(rows, groups.select("one.*")))
    # a window of one text that two anchors see counts once; one in surroundings that occur twice is repeated anyhow
    windows = scratch.write(windows.join(groups.select("s1", "s2", "m"), ["s1", "s2"]), "windows")
    seen = windows.select("c1", "c2", "k", "start").distinct().groupBy("c1", "c2").agg(F.count("*").alias("n"))
    several = windows.groupBy("c1", "c2").agg(F.max("m").alias("m")).join(seen, ["c1", "c2"]).where("m > 1 or n > 1").select("c1", "c2")
    # all windows around an anchor hold its gram, so what they cover has no gap
    told = windows.join(scratch.write(several, "several"), ["c1", "c2"]).groupBy("s1", "s2").agg(F.min("o").alias("low"), F.max("o").alias("high"))
    return around.join(scratch.write(told, "told"), ["s1", "s2"]).select("doc_id", "t", (F.col("pos") - F.col("high")).alias("start"), (F.col("pos") - F.col("low") + LENGTH).alias("end"))


def removed_spans(spark: SparkSession, rows: DataFrame, hot: int = HOT, merge: int = MERGE) -> DataFrame:
    """doc_id, t, spans (start, end) of the removed bytes of each row of `rows` (doc_id, t, k, text) that loses any.

    The spans are a table, so that no shuffle file of the search is left when they are used.
    """
    scratch = Scratch(spark, "suffixes")
    found = scratch.write(anchor_rows(rows), "anchors")
    # occurrences add up before they are shuffled, and the join of the two tables splits a frequent gram
    repeated = scratch.write(found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "repeated")
    spots = scratch.write(found.join(repeated, "h").select("k", "pos", "h", (F.col("n") > hot).alias("hot")), "spots")
    scratch.drop(found, repeated)
    cold = spots.where("not hot")
    dests = max(1, -(-cold.count() // merge))
    spans = judged(sorted_runs(_flagged(rows, cold), dests), dests)
    if not spots.where("hot").isEmpty():
        spans = spans.unionByName(_hot_spans(scratch, rows, spots.where("hot")))
    out = scratch.write(spans.groupBy("doc_id", "t").agg(F.collect_set(F.struct("start", "end")).alias("spans")), "spans")
    scratch.drop(spots)
    return out


def deduplicate(spark: SparkSession, docs: DataFrame, hot: int = HOT, merge: int = MERGE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (what is left, as bytes) of each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), F.xxhash64("doc_id", "text").alias("k"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    spans = removed_spans(spark, rows, hot, merge).select(F.col("doc_id").alias("d"), F.col("t").alias("u"), "spans")
    told = rows.join(spans, (F.col("t") == F.col("u")) & F.col("doc_id").eqNullSafe(F.col("d")), "left")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = text_bytes(batch.column(1))
            cells: list[list] = [[], [], [], []]
            for row, spans in enumerate(batch.column(2)):
                text = data[starts[row] : starts[row + 1]]
                gone = np.zeros(len(text) + 1, np.int64)
                if spans.is_valid:
                    flat = spans.values
                    np.add.at(gone, flat.field("start").to_numpy(), 1)
                    np.add.at(gone, flat.field("end").to_numpy(), -1)
                out = np.cumsum(gone)[:-1] > 0
                cells[0].append(len(text))
                cells[1].append(int(out.sum()))
                cells[2].append(int((out & ~np.concatenate([[False], out[:-1]])).sum()))
                cells[3].append(text[~out].tobytes())
            kinds = [pa.int64()] * 3 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cells, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return told.select("doc_id", "text", "spans").mapInArrow(run, schema)
