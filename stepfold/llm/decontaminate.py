"""Benchmark decontamination: a prefix-filtered set join, in DataFrame operations alone.

An item becomes windows of `window` consecutive words (an item of fewer words is one window). A window occurs in a
document only if all of its 3-word shingles do, so one necessary shingle is enough to look for it: its rarest one by
the count over all documents. Documents are joined with these prefix shingles; the place of the shingle in the
window bounds where the window would begin and end in the document, and what remains is compared word by word.

The windows are broadcast while there are at most BROADCAST_ROWS of them, and documents then stay where they are.
With more, shingles and candidates are joined by shuffles, in which adaptive execution splits hot shingles.

Words are runs of ASCII letters and digits and of any character beyond ASCII, with A-Z in lower case. Null or empty
text has no words and no windows. Items that share an item_id are one item; a null item_id is the item 'null'.
Repeated documents are rows of their own: rows in as rows out. With no item, nothing is contaminated. Of shingles that
are equally rare the one with the least hash, then the first of a window leads. Texts of any length are taken whole.
Occurrences go by doc_id and a hash of the text, so that rows with one doc_id and different texts are kept apart. Only
doc_id, item_id and text are read, so other columns of any name do not matter.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stepfold.llm.common import Scratch, settled

BROADCAST_ROWS = 50_000
SHINGLE = 3
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    text = F.coalesce(text.cast("string"), F.lit(""))
    lower = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))
    return F.array_remove(F.split(lower, BETWEEN), "")


def _key(words: Column, at: Column, size: int) -> Column:
    return F.xxhash64(F.lit(size), *(F.get(words, at + k) for k in range(size)))


def windows_of(benchmark: DataFrame, window: int) -> DataFrame:
    """item, w (the words of a window, an array) of each distinct window of each item."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1)))
    return items.select("item", F.explode(F.transform(starts, lambda i: F.slice("words", i, window))).alias("w")).distinct()


def shingles_of(distinct: DataFrame) -> DataFrame:
    """w, size, at, g: the shingles of each window; a window of fewer words than a shingle has one of its size."""
    sized = distinct.withColumn("size", F.least(F.lit(SHINGLE), F.size("w")))
    each = sized.select("w", "size", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("size"))).alias("at"))
    g = F.lit(None).cast("long")
    for k in range(1, SHINGLE + 1):
        g = F.when(F.col("size") == k, _key(F.col("w"), F.col("at"), k)).otherwise(g)
    return each.withColumn("g", g)


def document_shingles(rows: DataFrame, sizes: list[int], *carried: str) -> DataFrame:
    """The carried columns of `rows` (with words), p and g of every shingle of the given sizes."""
    each = rows.select(*carried, "words", F.posexplode("words").alias("p", "word"))
    keys = [_key(F.col("words"), F.col("p"), k) for k in sizes]
    if len(keys) == 1:
        return each.select(*carried, "words", "p", keys[0].alias("g"))
    return each.select(*carried, "words", "p", F.explode(F.array(*keys)).alias("g"))


def find(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = 10, broadcast_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, DataFrame]:
    """(rows, hits): doc_id, t, n_words of each document, and doc_id, t, start, end, w of each occurrence of a window. t is a hash of the text."""
    scratch = Scratch(spark, "decontaminate")
    items = scratch.write(windows_of(benchmark, window), "windows")
    shingles = scratch.write(shingles_of(items.select("w").distinct()), "shingles")
    sizes = sorted(r.size for r in shingles.select("size").distinct().collect()) or [SHINGLE]  # at most SHINGLE rows
    small = shingles.count() <= broadcast_rows
    text = docs.select("doc_id", F.xxhash64("text").alias("t"), F.col("text").cast("string").alias("text"))
    rows = settled(text, "words", words_of(F.col("text"))).select("doc_id", "t", "words")
    bound = lambda df: F.broadcast(df) if small else df
    seen = document_shingles(rows, sizes).select("g").join(bound(shingles.select("g").distinct()), "g")
    counts = seen.groupBy("g").agg(F.count("*").alias("n"))
    ordered = Window.partitionBy("w").orderBy(F.coalesce("n", F.lit(0)), "g", "at")
    # the rarest shingle of a window may be absent from every document: then so is the window
    prefixes = shingles.join(counts, "g", "left").withColumn("nth", F.row_number().over(ordered)).where("nth = 1 and n > 0").select("g", "at", "w")
    prefixes = scratch.write(prefixes, "prefixes")
    fits = (F.col("p") >= F.col("at")) & (F.col("p") - F.col("at") + F.size("w") <= F.col("n_words"))
    place = [(F.col("p") - F.col("at")).alias("start"), (F.col("p") - F.col("at") + F.size("w")).alias("end"), "w"]
    same = F.slice("words", F.col("start") + 1, F.size("w")) == F.col("w")
    if small:
        near = document_shingles(rows, sizes, "doc_id", "t").join(F.broadcast(prefixes), "g")
        found = near.withColumn("n_words", F.size("words")).where(fits).select("doc_id", "t", "words", *place).where(same)
    else:
        near = document_shingles(rows.withColumn("n_words", F.size("words")), sizes, "doc_id", "t", "n_words").drop("words").join(prefixes, "g")
        maybe = near.where(fits).select("doc_id", "t", *place).distinct()
        again = rows.select(F.col("doc_id").alias("d"), F.col("t").alias("u"), "words").dropDuplicates(["d", "u"])
        found = maybe.join(again, (F.col("t") == F.col("u")) & F.col("doc_id").eqNullSafe(F.col("d"))).where(same)
    hits = scratch.write(found.select("doc_id", "t", "start", "end", "w").distinct(), "hits")
    return rows.select("doc_id", "t", F.size("words").cast("long").alias("n_words")), hits.join(items, "w")


def report(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = 10, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, t, n_words, n_hit, n_items, items_sha256, contaminated of each document."""
    rows, hits = find(spark, docs, benchmark, window, broadcast_rows)
    by = ["doc_id", "t"]
    before = F.max("end").over(Window.partitionBy(*by).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    spans = hits.select(*by, "start", "end").distinct().withColumn("from", F.greatest("start", before))
    covered = spans.groupBy(*by).agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.col("from"))).alias("n_hit"))
    items = hits.select(*by, "item").distinct().groupBy(*by).agg(F.count("*").alias("n_items"), F.array_join(F.sort_array(F.collect_list("item")), ",").alias("items"))
    found = covered.join(items, (covered.t == items.t) & covered.doc_id.eqNullSafe(items.doc_id)).select(covered.doc_id.alias("d"), covered.t.alias("u"), "n_hit", "n_items", "items")
    out = rows.join(found, (F.col("t") == F.col("u")) & F.col("doc_id").eqNullSafe(F.col("d")), "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", "t", "n_words", n("n_hit"), n("n_items"), F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
i AS (SELECT item, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS p FROM b WHERE len(words) > 0),
w AS (SELECT DISTINCT item, words[p:p + 9] AS w FROM i),
e AS (SELECT doc_id, words, l, unnest(range(1, len(words) - l + 2)) AS p FROM d, (SELECT DISTINCT len(w) AS l FROM w) WHERE len(words) >= l),
s AS (SELECT doc_id, p, l, words[p:p + l - 1] AS w FROM e),
h AS (SELECT DISTINCT doc_id, p, l, item FROM s JOIN w USING (w)),
c AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + l)) AS x FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
