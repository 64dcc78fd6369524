"""A training corpus from `documents`: quality rules, near-dedup, decontamination, secret scans, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, whatever
else these are called.

Defined cases of every stage: an empty table gives an empty one; texts of any length are taken whole; columns other than doc_id,
text, source (secret scans) and n_chars, which follows a changed text, pass as they are, nulls included; repeated rows
are treated alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import common, decontaminate, minhash_dedup, quality_rules, secret_scan, sentencepiece_codec


SIMILARITY = 80  # percent of common shingles from which two documents are near copies


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule of the policy go; null and empty texts have too few words, so they go."""
    return quality_rules.keep(docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (similarity of SIMILARITY percent or more) the document with the smallest id stays.

    Null and empty texts and rows without an id stay; rows that repeat the id that stays all stay."""
    return minhash_dedup.keep_one(docs, SIMILARITY)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that hold a benchmark window are cut out of their documents; null texts and an empty benchmark change nothing."""
    return decontaminate.remove_spans(docs, common.table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; null texts stay null, and a null source is an empty path."""
    return secret_scan.redact(docs, secret_scan.train(secret_scan.generated_findings(spark)))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document; none for null and empty texts. round_trip: the text decoded from the ids is the text (null: empty)."""
    return sentencepiece_codec.tokenize(docs)


STAGES = [
    ("quality_rules", keep_quality),
    ("minhash_near_dedup", keep_one_of_each),
    ("benchmark_decontamination", cut_benchmark),
    ("secret_scans", redact_secrets),
    ("sentencepiece", encode),
]

#: Near-duplicate classes by MinHash, a trained forest and subword coding are not expressible in SQL: see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
