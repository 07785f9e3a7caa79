"""The queries of the corpus operators, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepfold.llm import compression_classifier, decontaminate, ngram_join, packing, pii, quality_rules, ranked_search, runs, secrets, simhash, suffix_dedup, token_store, wrappers
from stepfold.llm.common import Scratch, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("t")


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "token-store").path("store")
    token_store.write_store(spark, table(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json"), end_id=1)
    return token_store.digest(token_store.read_store(spark, path))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=0, capacity=2048)


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(spark, table(spark, sf_dir, "documents"), size=3, percent=90)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = quality_rules.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rules.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(spark, table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_dedup.deduplicate(spark, table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a source owns its documents, each of which is a repository
    found = secrets.scan(spark, table(spark, sf_dir, "documents"), owner=["source"], repository=["source", "doc_id"])
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_live", "n_example")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = compression_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(spark, table(spark, sf_dir, "pages"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digest(runs.detect(runs.planted(table(spark, sf_dir, "documents"))))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(simhash.deduplicate(spark, table(spark, sf_dir, "documents"), size=4, radius=4))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "ranked-index").path("index")
    ranked_search.write_index(spark, table(spark, sf_dir, "documents"), path)
    return ranked_search.search(spark, ranked_search.read_index(spark, path), table(spark, sf_dir, "benchmark"), k=50)


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_token_ids": op2_token_ids,
    "op3_ngram_join": op3_ngram_join,
    "op4_quality_rules": op4_quality_rules,
    "op5_packing": op5_packing,
    "op6_pii": op6_pii,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_secrets": op8_secrets,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_html_extraction": op10_html_extraction,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_simhash": op12_simhash,
    "op13_ranked_search": op13_ranked_search,
}
ORACLE_SQL: dict[str, str] = {
    "op1_decontaminate": decontaminate.ORACLE_SQL,
    "op3_ngram_join": ngram_join.ORACLE_SQL,
    "op11_periodic_runs": runs.ORACLE_SQL,
    "op13_ranked_search": ranked_search.ORACLE_SQL,
}
