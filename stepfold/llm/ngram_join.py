"""N-gram Jaccard join by parity sketches.

A document is its set of word shingles. Two of Jaccard similarity t or more, of which the smaller has at most s
shingles, differ in at most k = s (1 - t) / t of them. Shingles are hashed to the bits of a sketch by XOR; each bit is
a parity, so the Hamming distance of two sketches is never more than the sets differ by.

Sizes are cut into bands so that a partner lies in the own band or the next, and a document joins as a member of its
own band and, as the larger partner, of the one below. In each band the sketch is k + 1 + r words of 2**32 parities, of
which the 64-bit linear fingerprint is sent: the XOR of a mix of the number of each odd parity. At most k words differ,
so by the pigeonhole principle r + 1 are equal. Equal words bring candidates together; a second, short sketch drops
those whose Hamming distance is over their bound; the rest are compared shingle by shingle.

A word without any parity is no evidence: it would bring all documents together that happen to leave it empty, more the
more there are. So empty words aren't joined. Of two similar documents, one with at most r empty words has a word that
isn't empty among the r + 1 equal ones; r is chosen by band so that nearly all have that few. A document with more goes
on to a further layout, with other words; if both do, the principle holds in that layout again. The last of TURNS
layouts joins empty words too; the chance to get there is that of more than r empty words, TURNS - 1 times over. So no
link is lost at any size.

Documents with equal sets are joined first and go on as one. A bucket of equal words never emits all its pairs: each
member is compared with one leader, that which shares the most words with others (of edited copies, the least edited).
Buckets whose members are not yet in one component are compared again with other leaders. What is then left is compared
by sketch in tiles of bounded size, and only across components: first each member with its nearest, then with all that
their sketches allow. So no link that joins components is lost, and no group costs its square in rows unless its
members really differ.

Words are maximal runs of anything but ASCII white space, A-Z in lower case. Null or empty text has the empty set and
no links; texts of any length are taken whole. Rows that repeat a doc_id are one node, unless `by_text` is set; each row
keeps its own size. A null doc_id is never linked. Ties between leaders go to the row that comes first. Only doc_id and
text are read, so other columns of any name do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stepfold.llm.common import Scratch, row_blocks, text_bytes
from stepfold.llm.components import components
from stepfold.llm.textsets import mix, shingle_sets

#: Share of documents of a band that may have more empty words than it spares.
GOES_ON = 0.05
#: Words of 64 bits of the short sketch.
SHORT = 32
#: Members that one leader is compared with in one place, and members of a tile.
CHUNK, TILE = 256, 2048
#: Further rounds of leaders before buckets are compared by sketch.
ROUNDS = 2
#: Layouts up to which documents with too many empty words go on.
TURNS = 16
#: Rows of a list of copies up to which it is broadcast, 8 bytes each.
BROADCAST_ROWS = 500_000
#: Bytes of text whose words are hashed at once; the numbers of a block take some fifty times as much.
BLOCK = 1 << 18
_SIGNATURE = "doc_id long, t long, u long, n int, f1 long, f2 long, keys array<long>, sketch array<long>"


def _spare(low: int, least: int) -> int:
    """The fewest words beyond `least` so that a set of `low` shingles rarely leaves more than these empty (by Poisson), or where few words make that impossible, the number that does best."""
    tails = []
    for r in range(least + 1):
        mean = (least + r) * math.exp(-low / (least + r))
        tails.append(1 - sum(math.exp(-mean) * mean**i / math.factorial(i) for i in range(r + 1)))
        if tails[-1] <= GOES_ON:
            break
        if r > 100:  # the normal distribution is close, and factorials are large
            break
    return int(np.argmin(tails))


@lru_cache(maxsize=8)
def bands(percent: int, upto: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Largest size, largest size of a partner, words and spare words of each band, as far as the size `upto`."""
    rows, low = [], 1
    while low <= upto:
        high = low * 100 // percent
        k = high * (100 - percent) // percent
        spare = _spare(low, k + 1) if k else 0
        rows.append((high, high * 100 // percent, k + 1 + spare, spare))
        low = high + 1
    return tuple(np.array(x, np.int64) for x in zip(*rows, strict=True))


def _xor(values: np.ndarray, h: np.ndarray, row: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The values of the shingles of each word by XOR, all rows end to end: words[row] words, chosen by the upper half of h."""
    first = np.cumsum(words) - words
    slot = first[row] + ((h >> np.uint64(32)) * words[row].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    out = np.zeros(int(words.sum()), np.uint64)
    np.bitwise_xor.at(out, slot, values)
    return out


def _short(h: np.ndarray, row: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Sketches of words of 64 parities."""
    return _xor(np.uint64(1) << (h & np.uint64(63)), h, row, words)


def _wide(h: np.ndarray, row: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Fingerprints of words of 2**32 parities."""
    return _xor(mix((h & np.uint64(0xFFFFFFFF)) + np.uint64(1)), h, row, words)


def _keys(h: np.ndarray, counts: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the sketch words of each row, grouped by row, and how many each has."""
    high, partner, words, spare = bands(percent, int(counts.max(initial=1)))
    own = np.searchsorted(high, counts)
    row = np.repeat(np.arange(len(counts)), counts)
    keys, owners = [], []
    for below in (0, 1):
        band = np.maximum(own - below, 0)
        use = (counts > 0) & ((own >= 1) & (counts <= partner[band]) if below else True)
        for layout in range(TURNS):
            if not use.any():
                break
            n = np.where(use, words[band], 0)
            pick = use[row]
            sketch = _wide(mix(h[pick] + np.uint64(layout * 0x9E3779B9 + 1)), row[pick], n)
            at = np.arange(len(sketch)) - np.repeat(np.cumsum(n) - n, n)
            seed = mix((np.repeat(band, n) << 40 | layout << 32 | at).astype(np.uint64))
            owner = np.repeat(np.arange(len(counts)), n)
            empty = sketch == 0
            kept = ~empty if layout < TURNS - 1 else np.ones(len(empty), bool)
            keys.append((mix(sketch ^ seed) + seed)[kept])
            owners.append(owner[kept])
            use = use & (np.bincount(owner[empty], minlength=len(counts)) > spare[band])
    keys, owners = np.concatenate(keys) if keys else np.zeros(0, np.uint64), np.concatenate(owners) if owners else np.zeros(0, np.int64)
    return keys[np.argsort(owners, kind="stable")], np.bincount(owners, minlength=len(counts))


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values.view(np.int64)))


def signatures(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, two hashes of the text, n, a 128-bit fingerprint of the set, the keys of its sketch words and a short sketch."""
    names = [x.split()[0] for x in _SIGNATURE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = text_bytes(batch.column(3))
            for a, b in row_blocks(starts, BLOCK):
                h, counts = shingle_sets(data[starts[a] : starts[b]], starts[a : b + 1] - starts[a], size)
                row = np.repeat(np.arange(b - a), counts)
                sums = [np.zeros(b - a, np.uint64) for _ in range(2)]
                for k, total in enumerate(sums):
                    np.add.at(total, row, mix(h + np.uint64(77 + k)))
                keys, n = _keys(h, counts, percent)
                short = _short(mix(h + np.uint64(5)), row, np.full(b - a, SHORT))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in range(3)), pa.array(counts, pa.int32()), *(pa.array(x.view(np.int64)) for x in sums), _lists(keys, n), _lists(short, np.full(b - a, SHORT))], names)

    return docs.select(F.col("doc_id").cast("long"), *text_hashes(), F.col("text").cast("string")).mapInArrow(run, _SIGNATURE)


def text_hashes() -> tuple[Column, Column]:
    """128 bits that tell a text."""
    text = F.col("text").cast("string")
    return F.xxhash64(text).alias("t"), F.xxhash64(F.lit("second"), text).alias("u")


def _distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)


def _near(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and short sketches allow the similarity."""
    left, right = (nodes.select(F.col("id").alias(k), F.col("n").alias(f"n_{k}"), F.col("sketch").alias(f"s_{k}")) for k in "ab")
    known = pairs.join(left, "a").join(right, "b")
    fits = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    return known.where(fits).where(_distance(F.col("s_a"), F.col("s_b")) * (100 + percent) <= (F.col("n_a") + F.col("n_b")) * (100 - percent)).select("a", "b")


def verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have the similarity. A leader's text goes to each chunk of its members once."""
    members = pairs.groupBy("a").agg(F.count("*").alias("m"))
    dealt = pairs.join(members, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("m") / CHUNK)).alias("s"))
    leaders = dealt.select("a", "s", F.col("a").alias("id"), F.lit(0).alias("role")).distinct()
    wanted = leaders.unionByName(dealt.select("a", "s", F.col("b").alias("id"), F.lit(1).alias("role")))
    rows = texts.join(wanted, "id").select("a", "s", "role", "id", "text").repartition("a", "s").sortWithinPartitions("a", "s", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            data, starts = text_bytes(batch.column("text"))
            found_a, found_b = [], []
            cells = [batch.column(c).to_pylist() for c in ("a", "s", "role", "id")]
            for lo, hi in row_blocks(starts, BLOCK):
                h, counts = shingle_sets(data[starts[lo] : starts[hi]], starts[lo : hi + 1] - starts[lo], size)
                ends = np.cumsum(counts)
                for k in range(lo, hi):
                    own = h[ends[k - lo] - counts[k - lo] : ends[k - lo]]
                    a, s, role, i = (x[k] for x in cells)
                    if (a, s) != at:
                        at, held = (a, s), []
                    if role == 0:
                        held.append(own.copy())
                    else:
                        for other in held:
                            both = len(np.intersect1d(own, other, assume_unique=True))
                            if 100 * both >= percent * (len(own) + len(other) - both):
                                found_a.append(a)
                                found_b.append(i)
                                break
            yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long").distinct()


def across(entries: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """Pairs (a, b) of one bucket in different components that the short sketches allow, found tile by tile; or only that with the nearest for each member.

    entries: key, id, component, n, sketch. A bucket of m members has ceil(m / TILE) chunks and a tile for each two of
    them; a row goes to the tiles of its chunk, so no task holds more than two chunks of a bucket at a time.
    """
    sizes = entries.groupBy("key").agg(F.count("*").alias("m"))
    chunks = F.ceil(F.col("m") / TILE).cast("int")
    dealt = entries.join(sizes, "key").withColumn("g", chunks).withColumn("c", F.pmod(F.xxhash64("id"), F.col("g")).cast("int"))
    tiles = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("o"))
    tiles = tiles.select("key", F.least("c", "o").alias("x"), F.greatest("c", "o").alias("y"), "c", "id", "component", "n", "sketch")
    rows = tiles.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")

    def compare(ids, parts, n, sketch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        order = np.argsort(parts, kind="stable")
        ids, parts, n, sketch = ids[order], parts[order], n[order], sketch[order]
        ends = np.searchsorted(parts, parts, side="right")
        for i in range(len(ids)):
            if (e := ends[i]) == len(ids):
                break
            d = np.bitwise_count(sketch[e:] ^ sketch[i]).sum(axis=1, dtype=np.int64)
            small, large = np.minimum(n[e:], n[i]), np.maximum(n[e:], n[i])
            if nearest:
                at = np.argmin(d)
                d, small, large, other = d[at : at + 1], small[at : at + 1], large[at : at + 1], ids[e:][at : at + 1]
            else:
                other = ids[e:]
            ok = np.flatnonzero((100 * small >= percent * large) & (d * (100 + percent) <= (small + large) * (100 - percent)))
            if len(ok):
                other = other[ok]
                yield np.minimum(other, ids[i]), np.maximum(other, ids[i])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "x", "y", "id", "component", "n")]
            sketch = batch.column("sketch").flatten().to_numpy().view(np.uint64).reshape(-1, SHORT)
            new = [*cols, sketch]
            held = new if held is None else [np.concatenate([p, q]) for p, q in zip(held, new, strict=True)]
            tile = np.flatnonzero((np.diff(held[0]) != 0) | (np.diff(held[1]) != 0) | (np.diff(held[2]) != 0)) + 1
            if len(tile):
                yield from emit(held, np.concatenate([[0], tile]))
                held = [x[tile[-1] :] for x in held]
        if held is not None and len(held[0]):
            yield from emit(held, np.array([0, len(held[0])]))

    def emit(held: list[np.ndarray], cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a > 1:
                for left, right in compare(*(x[a:b] for x in held[3:])):
                    yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(right)], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long").distinct()


def join(spark: SparkSession, docs: DataFrame, size: int = 5, percent: int = 80, by_text: bool = False) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of `docs`: the least doc_id that links reach.

    With by_text, rows that share a doc_id are nodes of their own where their texts differ, and t, u (text_hashes) and
    first are returned as well: whether no row of the component comes before this one, by doc_id, then by t and u.
    """
    scratch = Scratch(spark, "ngram-join")
    sets = scratch.write(signatures(docs, size, percent).withColumn("uid", F.monotonically_increasing_id()), "signatures")
    linkable = sets.where("n > 0 and doc_id is not null")
    # each distinct set goes on as one of its rows
    copies = scratch.write(linkable.groupBy("f1", "f2").agg(F.min(F.struct("doc_id", "t", "u", "uid")).alias("x"), F.count("*").alias("m")).select("f1", "f2", "x.*", "m"), "copies")
    chosen = copies.select("uid")
    if not by_text and (repeated := linkable.groupBy("doc_id").agg(F.min("f1").alias("low"), F.max("f1").alias("high")).where("low <> high").select("doc_id")).limit(1).count():
        of_id = linkable.select("doc_id", "f1", "f2").join(repeated, "doc_id").distinct().join(copies.select("f1", "f2", "uid"), ["f1", "f2"])
        pairs = of_id.join(of_id.groupBy("doc_id").agg(F.min("uid").alias("a")), "doc_id").select("a", F.col("uid").alias("b"))
        same = scratch.write(pairs.where("a <> b").distinct(), "same")
    else:
        same = None
    # rows that only repeat a set are left out; their list is broadcast if it is short
    others = linkable.select("uid", "f1", "f2").join(copies.where("m > 1").select("f1", "f2", F.col("uid").alias("one")), ["f1", "f2"]).where("uid <> one").select("uid")
    others = scratch.write(others, "others")
    if others.count() <= BROADCAST_ROWS:
        first = linkable.join(F.broadcast(others), "uid", "left_anti")
    else:
        first = scratch.write(linkable.join(chosen, "uid", "left_semi"), "first")
    entries = first.select(F.col("uid").alias("id"), F.explode("keys").alias("key"))
    # the number of a key's rows adds up before it is shuffled, and the join that follows splits frequent keys
    several = scratch.write(entries.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key"), "several")
    found = scratch.write(entries.join(several, "key"), "shared")
    scratch.drop(several)
    degree = scratch.write(found.groupBy("id").agg(F.count("*").alias("degree")), "degree")
    shared = scratch.write(found.join(degree, "id"), "ranked")
    scratch.drop(found)
    leaders = scratch.write(shared.groupBy("key").agg(F.max_by("id", F.struct("degree", -F.col("id"))).alias("leader")), "leaders")
    nodes = scratch.write(sets.select(F.col("uid").alias("id"), "n", "sketch").join(degree.select("id"), "id"), "nodes")
    members = scratch.write(sets.select("doc_id", "t", "u", "n", "f1", "f2"), "members")
    scratch.drop(sets, *([first] if hasattr(first, "_scratch_path") else []))

    starred = shared.join(leaders, "key").where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    tested = scratch.write(_near(starred, nodes, percent), "pairs")
    scratch.drop(leaders)
    wanted = copies.select(F.col("uid").alias("id"), "doc_id", "t", "u").join(degree.select("id"), "id")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_hashes(), F.col("text").cast("string").alias("text"))
    # rows that repeat an id and its text have one text
    texts = scratch.write(source.join(wanted, ["doc_id", "t", "u"]).select("id", "text").dropDuplicates(["id"]), "texts")
    links = verified(tested, texts, size, percent)
    links = scratch.write(links if same is None else links.unionByName(same), "links")
    parts = scratch.write(components(scratch, links), "components")

    for turn in range(ROUNDS + 2):
        told = shared.join(parts, "id", "left").withColumn("component", F.coalesce("component", "id"))
        # of two members the one pair is tested already
        mixed = scratch.write(told.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("m")).where("low <> high and m > 2").select("key"), "mixed")
        left = scratch.write(told.join(mixed, "key"), "left")
        scratch.drop(mixed)
        if turn < ROUNDS:
            # a member of the component of the most shared one leads those outside it; it is the same in most buckets
            top = left.groupBy("key").agg(F.max_by("component", F.struct("degree", -F.col("component"))).alias("top"))
            told = left.join(top, "key")
            lead = told.where("component = top").groupBy("key").agg(F.max_by("id", F.struct(F.lit(turn) * F.xxhash64("id", F.lit(turn)), "degree", -F.col("id"))).alias("a"))
            more = told.where("component <> top").join(lead, "key").select("a", F.col("id").alias("b")).distinct()
            more = _near(more, nodes, percent)
        else:
            more = across(left.select("key", "id", "component").join(nodes, "id"), percent, nearest=turn == ROUNDS)
        ordered = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        more = scratch.write(ordered(more).distinct().join(ordered(tested), ["a", "b"], "left_anti"), "more")
        scratch.drop(left)
        if more.isEmpty():
            continue
        new = scratch.write(verified(more, texts, size, percent), "links")
        tested = tested.unionByName(more)
        if new.isEmpty():
            continue
        links = links.unionByName(new)
        parts = scratch.write(components(scratch, links), "components")

    scratch.drop(shared, texts, nodes)
    # the first row of each component, of those of each set
    of_set = copies.select("f1", "f2", "uid", F.struct("doc_id", "t", "u").alias("one")).join(parts.withColumnRenamed("id", "uid"), "uid", "left").withColumn("component", F.coalesce("component", "uid"))
    firsts = of_set.groupBy("component").agg(F.min("one").alias("least"))
    labels = scratch.write(of_set.join(firsts, "component").select("f1", "f2", "least"), "labels")
    out = members.join(labels, ["f1", "f2"], "left").withColumn("linked", F.coalesce((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.lit(False)))
    answer = ["doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("linked"), F.col("least.doc_id")).otherwise(F.col("doc_id")).alias("component_id")]
    if by_text:
        answer += ["t", "u", (~F.col("linked") | (F.struct("doc_id", "t", "u") == F.col("least"))).alias("first")]
    return out.select(*answer)


#: The query with three words and a similarity of 0.9, by comparing all documents that share a shingle.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
e AS (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 2, 1) + 1)) AS p FROM d WHERE len(words) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(words[p:p + 2], ' ') AS g FROM e),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b USING (g) GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.c)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(c) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""
