"""The queries opN_<name> and the SQL of those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, chat_format, jaccard_join, language_id, media, mixing, quality_llr, secret_scan, token_shards, toxicity
from tessera.llm.common import fold, packed, table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, scanned as a history of two versions into a ledger of the run.

    The first version holds the documents of even crc32(doc_id as text), the second all others and null ids; texts that
    the first one held already are not scanned again. The base rules are all rules, so no spans are added to theirs.
    The result is a written table of few files, not one for each task that reads texts.
    """
    docs = table(spark, sf_dir, "documents")
    late = F.coalesce(fold(F.col("doc_id"), 2) == 1, F.lit(True))
    findings = secret_scan.scan_history([docs.where(~late), docs.where(late)], secret_scan.Ledger(spark))
    return packed(secret_scan.summary(docs, findings))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted role and canonical rendering of every turn; see chat_format.parse() for nulls, ties and repeated rows."""
    return chat_format.parse(table(spark, sf_dir, "conversations"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle count and smallest linked id of every document; see jaccard_join.join() for empty, repeated and null rows."""
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text (null: empty) stored as lossless WebP, read back and described; equal texts have equal values."""
    return media.features(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document by a classifier learnt outside the held-out fold; null and empty texts are scored too."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.classify(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main language of every document's estimated mixture; `und` without letters."""
    docs = table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.fit(docs))


def op7_quality_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, score and verdict of every document against the trusted documents (quality 1); null texts fail."""
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    return quality_llr.score(table(spark, sf_dir, "documents"), trusted)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document; see mixing.mix() for null sources, repeated rows and the order."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_token_shards(spark: SparkSession, sf_dir: str, ranks: tuple[str, str] | None = None) -> DataFrame:
    """Every text (null: empty) as records of two-byte ids in training order, read back from shard files; see token_shards.records()."""
    return token_shards.shards(table(spark, sf_dir, "documents"), *(ranks or token_shards.default_ranks()))


def op10_bpe(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Ids and decoding, as digests, of every whole text; a null or empty text has no ids."""
    return bpe.encode_digests(table(spark, sf_dir, "documents"), tokenizer or bpe.default_path())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_secret_scan, op2_chat_format, op3_jaccard_join, op4_media, op5_toxicity, op6_language_id, op7_quality_llr, op8_mixing, op9_token_shards, op10_bpe)
}
ORACLES: dict[str, str] = {"op8_mixing": mixing.MIX_SQL}
