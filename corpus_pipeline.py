"""The corpus pipeline: five stages, each a table that the next one reads.

Each stage takes (spark, docs, sf_dir), works on all rows it is given and returns the columns of `docs`; the last
returns the pieces of packed sequences. Rows without doc_id pass the filter of near duplicates. Columns of `docs` may
have any names: what a stage adds for itself gets names that are free. Very long texts are taken whole by each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepfold.llm import compression_classifier, decontaminate, ngram_join, packing, pii
from stepfold.llm.common import Scratch, columns, table, unused
from stepfold.llm.queries import tokenizer_path

#: Rows of a list of removed documents up to which it is broadcast, 16 bytes each.
BROADCAST_ROWS = 200_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good; all where there are too few labels to learn from.

    Null and empty texts are scored like others. Repeated rows are judged alike, each for itself.
    """
    model = compression_classifier.fit(compression_classifier.sample_rows(docs, table(spark, sf_dir, "labels")))
    if not model.fitted:
        return docs
    (score,) = unused(docs, 1)
    return compression_classifier.score(docs, model, score).where(F.col(score) >= 0.7).select(*columns(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8): that with the least doc_id.

    Rows go only for what their texts share: those of one doc_id with different texts are documents of their own, and
    of rows that repeat both doc_id and text one stays. Rows without doc_id, and those without a word, all stay.
    """
    scratch = Scratch(spark, "near-duplicates")
    groups = scratch.write(ngram_join.join(spark, docs, size=5, percent=80, by_text=True), "groups")
    names = unused(docs, 3)
    told = docs.select("*", *(c.alias(x) for c, x in zip((F.col("doc_id").cast("long"), *ngram_join.text_hashes()), names, strict=True)))
    listed = groups.where("doc_id is not null and n_shingles > 0").select("first", *(F.col(c).alias(x) for c, x in zip(("doc_id", "t", "u"), names, strict=True)))
    kept = told.join(listed.where("not first").select(*names).distinct(), names, "left_anti")
    again = scratch.write(listed.where("first").groupBy(*names).count().where("count > 1").select(*names), "again")
    if not again.isEmpty():
        single = kept.join(again, names, "left_semi").dropDuplicates(names)
        kept = kept.join(again, names, "left_anti").unionByName(single)
    return kept.select(*columns(docs))


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of ten words of a benchmark item.

    Rows that repeat a doc_id and its text go or stay together; null and empty texts have no window and stay.
    """
    _, hits = decontaminate.find(spark, docs, table(spark, sf_dir, "benchmark"))
    names = unused(docs, 2)
    of = lambda text: [F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), text]
    gone = Scratch(spark, "benchmark-free").write(hits.select(*(c.alias(x) for c, x in zip(of(F.col("t")), names, strict=True))).distinct(), "gone")
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    told = docs.select("*", *(c.alias(x) for c, x in zip(of(F.xxhash64("text")), names, strict=True)))
    return told.join(gone, names, "left_anti").select(*columns(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and what reveals it generalised in their texts; null texts stay null."""
    clean = pii.sanitised(spark, docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens; a null or empty text is its end id alone."""
    return packing.pack(spark, docs, tokenizer_path("byte_bpe_50k.json"), end_id=0, capacity=2048)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("benchmark_free", benchmark_free),
    ("personal_data", personal_data),
    ("packed", packed),
]
#: SQL can't say the classifier, nor the packing; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; of each stage only its table stays, until the next one is written."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        mark = Scratch.mark()
        out = scratch.write(stage(spark, docs, sf_dir), name)
        Scratch.release(mark)
        if k:
            scratch.drop(docs)
        docs = out
    return docs
