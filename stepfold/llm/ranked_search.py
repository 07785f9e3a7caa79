"""Ranked lexical search over an inverted index whose postings are a term-bucketed table.

The index has a row for each term of each block of documents: which of the block's documents hold it and how often.
A block is a batch of rows, so a term of any number of documents is many rows of bounded size; a row of its own tells
the ids and lengths of its documents. Rows are dealt out by bucket (a hash of the term) and block, sorted by term and
partitioned by bucket: a search reads the buckets of its terms, and a hot term is spread over all files of its bucket.

A search joins the terms of its items to the postings (broadcast up to BROADCAST_ROWS terms, else by shuffle), brings
the postings of a block together, scores each match in integers, adds the scores by item and document, which all lie in
one place by then, and takes the best of each item by a window that keeps only k rows of a task before it shuffles.

The weight of a term is floor(1000 ln((2 N + 2) / (2 df + 1))) for N documents that have a term, df of which have this
one. With L terms in all and n in a document, m = 100 - 50 + (50 n N) div L, and tf occurrences of a term of weight w
count w ((10**9 tf) div (1000 tf + 20 m)).

Terms are maximal runs of ASCII letters and digits and of any character beyond ASCII, with A-Z in lower case. Null or
empty text has no terms and is never found. Texts of any length are taken whole. Every row is a document of its own,
repeated ones too; equal scores go by doc_id, null first, then by place. Items that share an item_id are one item with
the terms of all; a null item_id is an item. An item without terms, or none of whose terms occur, has no rows. Only
doc_id, item_id and text are read, so other columns of any name do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stepfold.llm.common import KERNEL_BYTES, Scratch, row_blocks, text_bytes
from stepfold.llm.wordlists import LOWER, TERM, numbered, spaced, strings, word_spans

#: Buckets of terms.
BUCKETS = 16
#: Rows of a list of terms up to which it is broadcast, some 50 bytes each.
BROADCAST_ROWS = 500_000
#: A Java regular expression of what lies between terms.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_POSTINGS = "block long, term string, hits array<long>, docs array<long>, lengths array<long>"
#: A hit is the place of a document in its block times this, and how often the document holds the term.
PLACE = 1 << 32


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def postings(docs: DataFrame) -> DataFrame:
    """block, term, hits of each term of each block; and of each block docs and lengths (doc_id and number of terms by place)."""
    names = [x.split()[0] for x in _POSTINGS.split(", ")]

    def lists(values: pa.Array, sizes: np.ndarray, held: np.ndarray) -> pa.Array:
        """Lists of these sizes; null where nothing is held."""
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values, mask=pa.array(~held))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            data, starts = text_bytes(batch.column(1))
            for a, b in row_blocks(starts, KERNEL_BYTES):
                lower = LOWER[data[starts[a] : starts[b]]]
                first, last, counts = word_spans(lower, starts[a : b + 1] - starts[a], TERM)
                if not len(first):
                    continue
                text, at = spaced(lower, first, last)
                term, terms = numbered(text, at)
                row = np.repeat(np.arange(b - a), counts)
                key, tf = np.unique(term * (b - a) + row, return_counts=True)
                term, row = key // (b - a), key % (b - a)
                # the space after each term goes
                octets, ends = terms.cast(pa.large_binary()), np.frombuffer(terms.buffers()[1], np.int64)[: len(terms) + 1]
                values = np.frombuffer(octets.buffers()[2], np.uint8)
                keep = np.ones(int(ends[-1]), bool)
                keep[ends[1:] - 1] = False
                named = strings(values[: ends[-1]][keep], ends - np.arange(len(ends)), pa.large_string()).cast(pa.string())
                of_term = np.arange(len(terms) + 1) < len(terms)
                whole = np.where(of_term, 0, b - a)
                columns = [
                    pa.array(np.full(len(terms) + 1, block)),
                    pa.concat_arrays([named, pa.nulls(1, pa.string())]),
                    lists(pa.array(row * PLACE + tf), np.append(np.bincount(term, minlength=len(terms)), 0), of_term),
                    lists(batch.column(0).slice(a, b - a), whole, ~of_term),
                    lists(pa.array(counts), whole, ~of_term),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)
                block += 1

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _POSTINGS)


def write_index(spark: SparkSession, docs: DataFrame, path: str) -> None:
    """Writes the index of `docs` to a folder that all executors share."""
    # the rows of whole blocks have the bucket -1; a bucket is spread over all partitions by its blocks
    bucket = F.when(F.col("term").isNull(), -1).otherwise(bucket_of(F.col("term")))
    salt = F.pmod(F.xxhash64("block"), F.lit(int(spark.conf.get("spark.sql.shuffle.partitions"))))
    rows = postings(docs).withColumn("bucket", bucket).withColumn("salt", salt)
    dealt = rows.repartition("bucket", "salt").drop("salt").sortWithinPartitions("bucket", "term", "block")
    dealt.write.partitionBy("bucket").option("compression", "zstd").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_POSTINGS + ", bucket int").parquet(path)


def terms_of(text: Column) -> Column:
    """The distinct terms of a text, as an array."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.array_distinct(F.array_remove(F.split(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), BETWEEN), ""))


def search(spark: SparkSession, index: DataFrame, items: DataFrame, k: int = 50, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """item_id, rank, doc_id, score of the k best documents of each item."""
    scratch = Scratch(spark, "ranked-search")
    asked = scratch.write(items.select("item_id", F.explode(terms_of(F.col("text"))).alias("term")).distinct(), "asked")
    numbered_items = scratch.write(asked.select("item_id").distinct().select("item_id", F.monotonically_increasing_id().alias("item")), "items")
    small = asked.count() <= broadcast_rows
    bound = lambda df: F.broadcast(df) if small else df
    buckets = [r.b for r in asked.select(bucket_of(F.col("term")).alias("b")).distinct().collect()]  # at most BUCKETS rows
    of_terms = index.where(F.col("bucket").isin(buckets)) if buckets else index.limit(0)
    blocks = index.where("bucket = -1").select("block", "docs", "lengths")
    total = blocks.select(F.explode("lengths").alias("n")).where("n > 0").agg(F.count("n").alias("n"), F.sum("n").alias("l")).first()
    n_docs, n_terms = total.n, total.l or 0
    held = of_terms.join(bound(asked.select("term").distinct()), "term", "left_semi")
    frequency = held.groupBy("term").agg(F.sum(F.size("hits")).alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2 * n_docs + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("long")
    weighed = scratch.write(frequency.select("term", weight.alias("w"), F.monotonically_increasing_id().alias("t")).where("w > 0"), "weights")
    wanted = scratch.write(asked.join(bound(weighed.select("term", "t")), "term").join(bound(numbered_items), asked.item_id.eqNullSafe(numbered_items.item_id)).select("t", "item"), "wanted")
    # all hits of a block come to one place, which serves the join with its documents and the sums
    met = of_terms.join(bound(weighed), "term").select("block", "t", "w", "hits").repartition("block").join(blocks, "block")
    place = lambda hit: F.shiftright(hit, 32).cast("int")
    known = lambda hit: F.struct(place(hit).alias("place"), F.get("docs", place(hit)).alias("doc_id"), F.get("lengths", place(hit)).alias("n"), hit.bitwiseAND(F.lit(PLACE - 1)).alias("tf"))
    # looked up before they are parted, so that no hit takes a copy of its block's documents along
    hits = met.select("block", "t", "w", F.explode(F.transform("hits", known)).alias("hit")).select("block", "t", "w", "hit.*")
    m = f"(50L + (50L * n * {n_docs}L) div {max(n_terms, 1)}L)"
    scored = hits.select("block", "place", "doc_id", "t", F.expr(f"w * ((1000000000L * tf) div (1000L * tf + 20L * {m}))").alias("s"))
    matched = scored.join(bound(wanted), "t").groupBy("block", "place", "doc_id", "item").agg(F.sum("s").alias("score"))
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id", "block", "place")
    best = matched.where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(bound(numbered_items), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
n AS (SELECT count(*) AS n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
b AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
p AS (SELECT r, doc_id, len(w) AS c, t, count(*) AS tf FROM (SELECT r, doc_id, w, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM b) GROUP BY ALL),
f AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * any_value(n.n) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, n GROUP BY t),
s AS (SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * c * n.n) // n.l))))::BIGINT AS score FROM b JOIN p USING (t) JOIN f USING (t), n GROUP BY ALL),
o AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST, r) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM o WHERE rank <= 50
"""
