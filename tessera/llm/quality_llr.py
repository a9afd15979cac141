"""Quality rules and a hashed n-gram log-likelihood ratio (native: DataFrame functions only).

Word unigrams and bigrams are hashed into BUCKETS. The trusted multinomial is counted over the trusted documents of all
folds but one, the raw one over all documents; a document scores the mean of log(trusted / raw) over its n-grams. The
trusted documents of the fold left out, of which no count knows, give the threshold: the score that all but LOST of them
reach. Everything about a document is computed in its own row: only BUCKETS counts are shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WORD, discard, few, fold, materialise

BUCKETS, SMOOTH = 1 << 14, 1.0
#: The fold of trusted documents that sets the threshold, of how many, and the share of them that may fall below it.
FOLDS, HELD, LOST, ACCURACY = 4, 3, 0.02, 10_000
SYMBOLS = "[#*$%&|<>]"


def _words(docs: DataFrame) -> DataFrame:
    """docs' doc_id with `text` (null: empty), its words, their hashes, and bigram and trigram hashes."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    return d.withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))


def _grams(h: Column, n: int) -> Column:
    """Hashes of the runs of n words from the words' hashes."""
    return F.when(F.size(h) < n, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.slice(h, 1, F.size(h) - (n - 1)), lambda x, i: F.xxhash64(x, *(F.get(h, i + k) for k in range(1, n))))
    )


def _buckets(h: Column) -> Column:
    return F.transform(h, lambda x: x.bitwiseAND(F.lit(BUCKETS - 1)).cast("int"))


def ratios(docs: DataFrame, trusted: DataFrame) -> list[float]:
    """log(trusted / raw) of each bucket, smoothed; trusted: rows (doc_id), each counted once, none cut off."""
    # Hashes come before the join, which keeps the planner from working them out again for every use.
    d = _words(docs).join(few(trusted.select("doc_id", F.lit(1).alias("t"))), "doc_id", "left").select("h", F.coalesce("t", F.lit(0)).alias("t"))
    grams = d.select("t", F.explode(F.concat(_buckets(F.col("h")), _buckets(_grams(F.col("h"), 2)))).alias("bucket"))
    counts = {r["bucket"]: (r["raw"], r["t"]) for r in grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("t").alias("t")).collect()}
    raw, t = (sum(v[i] for v in counts.values()) + SMOOTH * BUCKETS for i in (0, 1))
    pair = [counts.get(b, (0, 0)) for b in range(BUCKETS)]
    # Without trusted documents nothing is known of any bucket.
    return [math.log((b + SMOOTH) / t) - math.log((a + SMOOTH) / raw) if t > SMOOTH * BUCKETS else 0.0 for a, b in pair]


def _literal(table: list[float]) -> Column:
    """One folded literal in the plan, of BUCKETS numbers."""
    return F.split(F.lit(",".join(map(repr, table))), ",").cast("array<double>")


def _mean(h: Column, b: Column, table: list[float]) -> Column:
    """The mean of the n-grams' ratios; 0 without any."""
    llr = _literal(table)
    add = lambda acc, x: acc + F.get(llr, x.bitwiseAND(F.lit(BUCKETS - 1)).cast("int"))
    return F.aggregate(b, F.aggregate(h, F.lit(0.0), add), add) / F.greatest(F.size(h) + F.size(b), F.lit(1))


def threshold(docs: DataFrame, held: DataFrame, table: list[float], lost: float = LOST) -> float:
    """The score that all but a share of `lost` of the documents of held (doc_id) with 50 words or more reach.

    held must not be among the counts behind the table. Without such documents there is no bound, and none is refused.
    """
    texts = materialise(docs.select("doc_id", "text").join(few(held), "doc_id"))
    d = _words(texts).withColumn("b", _grams(F.col("h"), 2)).select(F.size("h").alias("n"), _mean(F.col("h"), F.col("b"), table).alias("llr"))
    least = d.where("n >= 50").agg(F.percentile_approx("llr", F.lit(lost), F.lit(ACCURACY))).first()[0]
    discard(texts)
    return -math.inf if least is None else least


def repeated_words(placed: Column) -> Column:
    """Words in the 3-word windows that occur twice or more; placed: (window, place) sorted, or null without repeats."""
    twice = F.filter(placed, lambda e, i: (F.get(placed, i - 1)["g"] == e["g"]) | (F.get(placed, i + 1)["g"] == e["g"]))
    at = F.array_sort(F.transform(twice, lambda e: e["i"]))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda acc, i: F.struct((i + 3).alias("end"), (acc["n"] + i + 3 - F.greatest(i, acc["end"])).alias("n"))
    return F.when(placed.isNull(), F.lit(0)).otherwise(F.aggregate(at, zero, step, lambda acc: acc["n"]))


def score(docs: DataFrame, trusted: DataFrame, least_score: float | None = None) -> DataFrame:
    """Rows (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, llr) of every row.

    trusted: rows (doc_id); repeats count once, null ids not at all. Without least_score, threshold() of the fold left
    out is the least score of a kept document. A null or empty text has no words and fails; a document without n-grams
    has the ratio 0. Rows with equal texts get equal values, an empty table gives no rows, other columns are ignored.
    Write the result before filtering by it: a filter that is pushed into its expressions works them out again and again.
    """
    ids = materialise(trusted.where("doc_id is not null").select("doc_id").distinct())
    held = fold(F.col("doc_id"), FOLDS) == HELD
    table = ratios(docs, ids.where(~held))
    if least_score is None:
        least_score = threshold(docs, ids.where(held), table)
    d = _words(docs).withColumn("b", _grams(F.col("h"), 2)).withColumn("g", _grams(F.col("h"), 3))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    pairs = F.transform("g", lambda x, i: F.struct(x.alias("g"), i.alias("i")))
    d = d.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.aggregate("words", F.lit(0).cast("long"), lambda acc, w: acc + F.length(w)).alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.when(F.size(F.array_distinct("g")) < F.size("g"), F.array_sort(pairs)).alias("placed"),
        _mean(F.col("h"), F.col("b"), table).alias("llr"),
    )
    d = d.select(
        *("doc_id", "n_words", "word_chars", "n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("placed")).cast("long").alias("n_repeat_words"),
        "llr",
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return d.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("llr") >= F.lit(least_score)))
