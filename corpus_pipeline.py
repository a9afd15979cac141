"""The corpus pipeline: toxicity, near-duplicate join, secret scans, mixing and BPE, each stage by its operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, jaccard_join, mixing, secret_scan, toxicity
from tessera.llm.common import discard, materialise, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier, trained on docs and the labels, does not call toxic.

    A null or empty text is scored as one without words; a null id is kept or goes by its text. Repeated rows go together.
    """
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near-duplicates.

    Texts without words and rows without an id stay; rows that repeat the smallest id stay with it.
    """
    return jaccard_join.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by [REDACTED:kind] and n_chars brought up to date; a null text stays null."""
    return secret_scan.redact(docs, secret_scan.scan(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, those of a further epoch once more; a null source is a source of its own."""
    return mixing.sample(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and the digests of ids and decoded text of every document of the mix; a null text has no ids."""
    return bpe.encode_digests(docs, bpe.default_path())


STAGES = [("toxicity", drop_toxic), ("jaccard_join", drop_near_copies), ("secret_scan", redact_secrets), ("mixing", mix_sources), ("bpe", encode_texts)]

#: No SQL trains a classifier or encodes with a tokenizer; tests/llm/test_pipeline.py compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each one's result is written to the shared folder and read again by the next.

    An empty table gives no rows. A stage's input is deleted when its output is written.
    """
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, materialise(stage(spark, docs, sf_dir))
        if i:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
