"""Periodic runs of words by divide and conquer (Main and Lorentz), and texts without their repetitions.

A run is a stretch of consecutive words with smallest period q, so that words q apart are identical, of at least
`least` words and `exponent` periods, that no neighbouring word extends with that period. Words are interned as
numbers. A range of words is halved until it is shorter than `least`; each run crosses the middle of exactly one range
that holds it whole. There at least two of its four periods lie on one side of the middle: on the right, the Z-function
of that side has Z[q] >= q, and on the left that of the reversed side has. Two further Z-functions, of one side within
both, tell how far the repetition goes on across the middle. Intervals that the words next to them extend belong to a
wider range and are dropped, those found twice count once with their smallest period.

Ranges of all texts of a block are screened together: Z-functions are made only where the first words of a period
recur. A text is read whole in one task, in n log n steps for n words; the runs of a text are fewer than its words.

Words are maximal runs of anything but ASCII white space, case kept. Null or empty text has no words and no runs, and
collapses to the empty text. Runs of one text are ordered by start, then period; several may overlap, and a word goes
if any run holds it after that run's first period. Rows in as rows out: repeated rows are treated each for itself. Only
doc_id and text are read, so other columns of any name do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepfold.llm.common import ranges, row_blocks, settled, text_bytes, words_of
from stepfold.llm.wordlists import numbered, spaced, strings, word_spans

#: Words of a period that the screen compares.
SCREENED = 8
_FOUND = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def z_function(s: list[int]) -> list[int]:
    """For each place, how many items from there on equal those at the beginning; the first is the length."""
    n = len(s)
    z = [n] * n
    left = right = 0
    for i in range(1, n):
        k = min(z[i - left], right - i) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _side(near: list[int], far: list[int]) -> list[tuple[int, int, int]]:
    """(period, items on the far side, items on the near side) of each repetition around the middle with two periods on the near side.

    `near` goes away from the middle, and so does `far`.
    """
    own = z_function(near)
    periods = [p for p in range(1, len(near) // 2 + 1) if own[p] >= p]
    if not periods:
        return []
    # the last p items before the end of a period, read back to the middle, go on as `far` does
    back = z_function(far)
    across = z_function([*far, -1, *reversed(near[: periods[-1]])])
    out = []
    for p in periods:
        k = min(across[len(far) + 1 + periods[-1] - p], p, len(far))
        if k == p and p < len(far):
            k += back[p]
        out.append((p, min(k, len(far)), p + own[p]))
    return out


def crossing(words: list[int], mid: int) -> set[tuple[int, int, int]]:
    """(start, end, period) of the repetitions around the middle of a range that have two periods on one side."""
    left, right = words[:mid][::-1], words[mid:]
    found = {(mid - a, mid + b, p) for p, a, b in _side(right, left)}
    return found | {(mid - b, mid + a, p) for p, a, b in _side(left, right)}


def _recurs(ids: np.ndarray, origin: np.ndarray, half: np.ndarray, step: int) -> np.ndarray:
    """Whether the first words of a period from the origin recur after it, for any period of at most `half` words."""
    hit = np.zeros(len(origin), bool)
    node = np.repeat(np.arange(len(origin)), half)
    p = ranges(np.ones(len(half), np.int64), half)
    for k in range(SCREENED):
        at = origin[node] + step * k
        same = ids[at + step * p] == ids[at]
        node, p = node[same], p[same]
        done = p == k + 1
        hit[node[done]] = True
        left = ~(done | hit[node])
        node, p = node[left], p[left]
        if not len(node):
            return hit
    hit[node] = True
    return hit


def find(ids: np.ndarray, counts: np.ndarray, least: int, exponent: int) -> np.ndarray:
    """Rows (row, start, length, period), ordered, of the runs of rows of words that lie end to end."""
    ends = np.cumsum(counts)
    lo, hi, row = ends - counts, ends, np.arange(len(counts))
    from_, to = lo, hi
    found: dict[tuple[int, int, int], int] = {}
    # the run that holds a word, as far as known, and the longest period that another run within it may have: of two
    # runs with periods p < q that share p + q words or more, the longer would have a smaller period than q
    held, within = np.zeros(len(ids), np.int64), [len(ids)]
    while True:
        keep = hi - lo >= max(least, exponent)
        lo, hi, row = lo[keep], hi[keep], row[keep]
        most = np.where(held[lo] == held[hi - 1], np.array(within)[held[lo]], len(ids))
        lo, hi, row, most = (x[most > 0] for x in (lo, hi, row, most))
        if not len(lo):
            break
        mid = (lo + hi) // 2
        hit = _recurs(ids, mid, np.minimum((hi - mid) // 2, most), 1) | _recurs(ids, mid - 1, np.minimum((mid - lo) // 2, most), -1)
        for a, m, b, r in zip(*(x[hit].tolist() for x in (lo, mid, hi, row)), strict=True):
            for s, e, p in sorted(crossing(ids[a:b].tolist(), m - a), key=lambda x: x[2]):
                s, e = s + a, e + a
                whole = (s == from_[r] or ids[s - 1] != ids[s - 1 + p]) and (e == to[r] or ids[e] != ids[e - p])
                if whole and e - s >= max(least, exponent * p):
                    known = found.get((r, s, e))
                    if known is None or p < known:
                        found[r, s, e] = p
                        held[s:e] = len(within)
                        within.append((p - 1) // (exponent - 1))
        lo, hi, row = np.concatenate([lo, mid]), np.concatenate([mid, hi]), np.concatenate([row, row])
    rows = sorted((r, s - int(from_[r]), e - s, p) for (r, s, e), p in found.items())
    return np.array(sorted(rows, key=lambda x: (x[0], x[1], x[3])), np.int64).reshape(-1, 4)


def _collapsed(text: np.ndarray, at: np.ndarray, counts: np.ndarray, runs: np.ndarray) -> pa.Array:
    """Each row's words, one space between them, without those that a run holds after its first period."""
    row, start, length, period = runs.T
    begin = (np.cumsum(counts) - counts)[row] + start
    edges = np.zeros(len(at), np.int64)
    np.add.at(edges, begin + period, 1)
    np.add.at(edges, begin + length, -1)
    kept = np.flatnonzero(np.cumsum(edges)[:-1] == 0)
    owner = np.repeat(np.arange(len(counts)), counts)[kept]
    sizes = np.diff(at)[kept]
    last = np.ones(len(kept), bool)
    last[:-1] = owner[1:] != owner[:-1]
    sizes[last] -= 1
    of_row = np.bincount(owner, weights=sizes, minlength=len(counts)).astype(np.int64)
    return strings(text[ranges(at[kept], sizes)], np.concatenate([[0], np.cumsum(of_row)]), pa.large_string()).cast(pa.string())


def _listed(runs: np.ndarray, rows: int) -> pa.Array:
    offsets = np.searchsorted(runs[:, 0], np.arange(rows + 1))
    parts = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(runs[:, k])) for k in (1, 2, 3)], ["start", "length", "period"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), parts)


def detect(docs: DataFrame, least: int = 6, exponent: int = 4) -> DataFrame:
    """doc_id, n_words, runs (start, length, period, in words from 0) and collapsed, the text without repetitions, of each row."""
    if exponent < 4 or least < 1:
        raise ValueError("a run has four periods at least, and a word")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = text_bytes(batch.column(1))
            for a, b in row_blocks(starts):
                first, last, counts = word_spans(data[starts[a] : starts[b]], starts[a : b + 1] - starts[a])
                text, at = spaced(data[starts[a] : starts[b]], first, last)
                found = find(numbered(text, at)[0], counts, least, exponent)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(counts), _listed(found, b - a), _collapsed(text, at, counts, found)], ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _FOUND)


def planted(docs: DataFrame) -> DataFrame:
    """doc_id, text; every tenth document by a hash of its id goes on from some word in a period of its own words."""
    rows = settled(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("_h", F.crc32(F.col("doc_id").cast("string").cast("binary"))), "_words", F.when(F.col("_h") % 10 == 0, words_of(F.col("text"))))
    g, n, w = F.floor(F.col("_h") / 10), F.size("_words"), F.col("_words")
    rows = rows.withColumn("_n", n).withColumn("_a", F.when(F.col("_n") > 0, (g % F.col("_n")).cast("int"))).withColumn("_p", (1 + F.floor((F.col("_n") - F.col("_a")) / (3 + g % 8))).cast("int"))
    turned = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: F.get(w, F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p"))))
    return rows.select("doc_id", F.when(F.col("_n") > 0, F.array_join(turned, " ")).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """The run of greatest length by period of each row, and hashes of all runs and of the collapsed text."""
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    greater = lambda acc, x: acc.isNull() | (x["length"] * acc["period"] > acc["length"] * x["period"])  # noqa: E731  ordered as ties go: the first stays
    best = F.aggregate("runs", none, lambda acc, x: F.when(greater(acc, x), x).otherwise(acc))
    line = lambda x: F.concat_ws(",", x["start"], x["length"], x["period"])
    lines = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(F.lit("")))
    hashed = lambda c: F.sha2(c.cast("binary"), 256)
    rows = found.withColumn("best", best)
    part = lambda c: F.col(f"best.{c}").alias(c)
    return rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), part("start"), part("length"), part("period"), F.expr("(1000 * best.length) div best.period").alias("exponent_milli"), hashed(lines).alias("runs_sha256"), hashed(F.col("collapsed")).alias("collapsed_sha256"))


#: Equal 5-grams of one text at the same distance, end to end, are a run's: a run of period q has max(6, 4 q) words, so that many less q, five or more, equal those q on.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS o,
  list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM documents),
h AS (SELECT doc_id, o, len(o) AS n, xor(c, 4294967295) AS h FROM d),
a AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n ELSE n END AS a FROM h),
p AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM a),
w AS (SELECT doc_id, n, CASE WHEN a = n THEN o ELSE list_transform(range(n), lambda i: o[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) END AS w FROM p),
g AS (SELECT doc_id, i, list_aggregate(w[i + 1:i + 5], 'string_agg', ' ') AS g FROM (SELECT doc_id, w, unnest(range(n - 4)) AS i FROM w WHERE n > 5)),
e AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM g AS x JOIN g AS y ON x.doc_id = y.doc_id AND x.g = y.g AND x.i < y.i),
s AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM e),
r AS (SELECT doc_id, min(i) AS start, count(*) + 4 + q AS length, q FROM s GROUP BY doc_id, q, k HAVING count(*) + 4 + q >= greatest(6, 4 * q)),
u AS (SELECT doc_id, start, length, min(q) AS period FROM r GROUP BY doc_id, start, length),
t AS (SELECT doc_id, count(*) AS n_runs, first(struct_pack(start := start, length := length, period := period) ORDER BY length / period DESC, start, period) AS b,
  string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM u GROUP BY doc_id),
x AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM u),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM (SELECT doc_id, unnest(w) AS word, unnest(range(n)) AS i FROM w WHERE n > 0) ANTI JOIN x USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, coalesce(n_runs, 0) AS n_runs, b.start AS start, b.length AS length, b.period AS period, 1000 * b.length // b.period AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM w LEFT JOIN t USING (doc_id) LEFT JOIN k USING (doc_id)
"""
