"""Mixing sources to target weights by distributed prefix sums (native: DataFrame functions only).

Every row gets a hash-random key. Within a source the key range is cut into equal ranges; the token totals of
(source, range) pairs, which are few, are summed in order to give each range its offset, and a window inside each range
gives each row its own prefix. No task holds a source: the hottest one is spread over as many ranges as any other.
A source's exact budget then cuts the prefix, going round again (another epoch) where the budget exceeds the source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD, materialise

#: Rows that a key range should hold, and the most ranges that a source is cut into.
ROWS_PER_RANGE, MOST_RANGES = 256, 1 << 16


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(totals: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """Totals (src, source, source_size) with `target`: share * all words by weight, none above cap * its own size.

    Sources in code-point order, null last, take the weights in turn. Resharing the excess until no source is above
    its cap ends at the level L where sum(min(cap_i, L * w_i)) equals the words to share: sort by cap_i / w_i, and
    the first source whose level, with all before it at their caps, is no more than its own ratio gives L.
    """
    one = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(one) - 1) % len(weights) + 1).cast("int"))
    t = totals.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(cap)))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    t = t.withColumn("words", F.sum("source_size").over(every) * F.lit(float(share)))
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = (F.col("words") - before) / F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    t = t.withColumn("n", F.row_number().over(order)).withColumn("level", level)
    t = t.withColumn("level", F.min(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct("n", "level"))).over(every)["level"])
    return t.select("src", "source_size", F.least("cap", F.col("level") * F.col("w")).alias("target"))


def _source(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def _key(doc_id: Column, text: Column, seed: str) -> Column:
    """Rows that share an id, or have none, are told apart by their texts."""
    content = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), content).cast("binary"))


def _taken(docs: DataFrame, weights: tuple[int, ...], share: float, cap: float, seed: str) -> DataFrame:
    d = materialise(
        docs.select("doc_id", F.col("source").cast("string").alias("source"), _source(F.col("source")).alias("src"), word_count(F.col("text")).alias("size"), _key(F.col("doc_id"), F.col("text"), seed).alias("key"))
    )
    rows, ranges = d.count(), 1
    while ranges < MOST_RANGES and ranges * ROWS_PER_RANGE < rows:
        ranges *= 2
    cut = (F.conv(F.substring("key", 1, 4), 16, 10).cast("long") * ranges / 65536).cast("long")
    d = d.withColumn("range", cut)
    sums = d.groupBy("src", "source", "range").agg(F.sum("size").alias("range_size"))
    goal = targets(sums.groupBy("src", "source").agg(F.sum("range_size").alias("source_size")), weights, share, cap)
    so_far = Window.partitionBy("src").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("src", "range", F.coalesce(F.sum("range_size").over(so_far), F.lit(0)).alias("offset")).join(goal, "src")
    inside = Window.partitionBy("src", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    budget = F.floor(F.col("target") + 0.5)
    some = F.col("source_size") > 0
    full = F.when(some, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - F.col("epochs") * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start"))).cast("long")
    return d.join(offsets, ["src", "range"]).withColumn("start", start).withColumn("epochs", full).withColumn("part", part)


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: str = "mix") -> DataFrame:
    """Rows (doc_id, size, source_size, target, taken); needs doc_id, text, source; other columns are ignored.

    size: words of the text (null: 0). taken: words that the mix takes of the row, counting each epoch; the sum over
    a source is its target rounded to the nearest word. Order is by md5(seed:doc_id:md5(text)), then doc_id, size; equal
    rows are interchangeable. A null source is a source of its own; an empty table gives no rows.
    """
    d = _taken(docs, weights, share, cap, seed)
    return d.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"))


def sample(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: str = "mix") -> DataFrame:
    """The mix itself: each row of docs, all columns, as often as it is taken; the row at the cut if half of it is.

    Null ids, texts and sources take part; an empty table gives no rows. The text isn't shuffled: a source's cut is a place in its key order, one row a source, which the rows are held against.
    """
    place = F.struct("key", "doc_id", "size")
    d = _taken(docs, weights, share, cap, seed)
    last = F.max(F.when((F.col("part") > 0) & (2 * F.col("part") >= F.col("size")), place)).alias("last")
    cuts = materialise(d.groupBy("src").agg(F.max("epochs").alias("epochs"), last))
    here = F.struct(_key(F.col("doc_id"), F.col("text"), seed).alias("key"), F.col("doc_id").alias("doc_id"), word_count(F.col("text")).alias("size"))
    rows = docs.select(F.struct("*").alias("row"), _source(F.col("source")).alias("src"), here.alias("here")).join(cuts, "src")
    times = F.col("epochs").cast("int") + F.when(F.col("here") <= F.col("last"), 1).otherwise(0)
    return rows.select("row", times.alias("times")).where("times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


#: The same rules without ranges, for the comparison of results.
MIX_SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS k
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w,
         source_size * CAST(2 AS DOUBLE) AS cap, CAST(sum(source_size) OVER () AS DOUBLE) * CAST(1.5 AS DOUBLE) AS words FROM s
), o AS (
  SELECT *, row_number() OVER q AS n,
         (words - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv
  FROM w WINDOW q AS (ORDER BY cap / w, source NULLS LAST)
), l AS (
  SELECT lv AS level FROM o WHERE lv <= cap / w ORDER BY n LIMIT 1
), t AS (
  SELECT source, source_size, least(cap, (SELECT level FROM l) * w) AS target FROM o
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS budget,
         coalesce(CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size > 0 THEN (budget // source_size) * size + greatest(0, least(size, budget % source_size - start)) ELSE 0 END AS BIGINT) AS taken
FROM p
"""
