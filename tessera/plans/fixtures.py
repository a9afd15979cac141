"""Logical inputs (pictures, frames, palettes, ledgers) derived from the test tables, for Spark and as SQL.

An embedding of 64 numbers is a picture: 8 by 8 grey samples, or 4 by 4 RGBA pixels in row-major order.
"""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A palette whose order is its meaning.
PALETTE = ("#6a1b5a", "#e63946", "#f4e9f1", "#1d3557", "#ffb703", "#2a9d8f")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in (paths := [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]):
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])  # for Python workers on this machine
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sample(v: Column) -> Column:
    """A float of about -0.25..0.25 as a byte."""
    return F.greatest(F.lit(0), F.least(F.lit(255), F.floor(v.cast("double") * 512 + 128 + 0.5))).cast("long")


def grey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, x, y, g) of 8 by 8 grey pictures."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("i", "v"))
    return e.select("image_id", (F.col("i") % 8).cast("long").alias("x"), F.floor(F.col("i") / 8).alias("y"), sample(F.col("v")).alias("g"))


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, action, data) with data the 64 RGBA bytes as an array."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.col("label").cast("long").alias("action"), F.transform("embedding", sample).alias("data"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, action, i, x, y, r, g, b, a) of 4 by 4 RGBA pictures; narrow."""
    at = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda p: F.slice("data", p * 4 + 1, 4))
    d = packed(spark, sf_dir).select("image_id", "action", F.posexplode(at).alias("i", "p"))
    return d.select("image_id", "action", F.col("i").cast("long").alias("i"), (F.col("i") % 4).cast("long").alias("x"), F.floor(F.col("i") / 4).alias("y"), *(F.col("p")[k].alias(c) for k, c in enumerate("rgba")))


#: Ids of a chunk: the frames of an action are put in order a chunk at a time.
CHUNK = 1 << 12


def in_sequence(d: DataFrame, carry: str | None = None) -> DataFrame:
    """d (image_id, action, ...) with frame_ix, its place among its action's frames, and `low`, the frame before's `carry`.

    A window holds a chunk of an action at most, however long the action is; one row a chunk hands its count and its last
    frame on to the next chunk that has frames of the action.
    """
    d = d.withColumn("chunk", F.floor(F.col("image_id") / CHUNK))
    last = F.max_by(F.struct(carry or "image_id"), "image_id")
    ends = d.groupBy(F.col("action").alias("of"), F.col("chunk").alias("at")).agg(F.count("*").alias("n"), last.alias("last"))
    chunks = Window.partitionBy("of").orderBy("at")
    before = F.coalesce(F.sum("n").over(chunks.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = ends.select("of", "at", before.alias("base"), F.lag("last").over(chunks).alias("carried"))
    own = Window.partitionBy("action", "chunk").orderBy("image_id")
    j = d.join(ends, F.col("action").eqNullSafe(F.col("of")) & (F.col("chunk") == F.col("at"))).withColumn("k", F.row_number().over(own))
    if carry:
        j = j.withColumn("low", F.when(F.col("k") == 1, F.col("carried")[carry]).otherwise(F.lag(carry).over(own)))
    return j.withColumn("frame_ix", (F.col("base") + F.col("k") - 1).cast("long")).drop("chunk", "of", "at", "base", "carried", "k")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, action, frame_ix): an action's pictures in order of id."""
    return in_sequence(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.col("label").cast("long").alias("action")))


def palette(spark: SparkSession, colours: tuple[str, ...] = PALETTE) -> DataFrame:
    """(ord, hex, pr, pg, pb) of a palette: one row a colour."""
    rows = [(i, h, *(int(h[k : k + 2], 16) for k in (1, 3, 5))) for i, h in enumerate(colours)]
    return spark.createDataFrame(rows, "ord bigint, hex string, pr bigint, pg bigint, pb bigint")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage calls: (id, run, op, cost (null: unpriced), ok, ts)."""
    e = table(spark, sf_dir, "events")
    bad = F.col("event_type") == "error"
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("run"), F.col("event_type").alias("op"), F.when(~bad, F.col("value")).alias("cost"), (~bad).alias("ok"), "ts")


GREY = """grey AS (
  SELECT vec_id AS image_id, CAST(i % 8 AS BIGINT) AS x, CAST(i // 8 AS BIGINT) AS y,
         CAST(greatest(0, least(255, floor(CAST(embedding[i + 1] AS DOUBLE) * 512 + 128 + 0.5))) AS BIGINT) AS g
  FROM embeddings, (SELECT unnest(range(0, 64)) AS i) t)"""
PIXELS = """smp AS (
  SELECT vec_id AS image_id, CAST(label AS BIGINT) AS action, CAST(k AS BIGINT) AS k,
         CAST(greatest(0, least(255, floor(CAST(embedding[k + 1] AS DOUBLE) * 512 + 128 + 0.5))) AS BIGINT) AS v
  FROM embeddings, (SELECT unnest(range(0, 64)) AS k) t),
pix AS (
  SELECT image_id, action, k // 4 AS i, (k // 4) % 4 AS x, k // 16 AS y,
         max(v) FILTER (k % 4 = 0) AS r, max(v) FILTER (k % 4 = 1) AS g, max(v) FILTER (k % 4 = 2) AS b, max(v) FILTER (k % 4 = 3) AS a
  FROM smp GROUP BY image_id, action, k // 4, (k // 4) % 4, k // 16)"""
FRAMES = """frm AS (
  SELECT vec_id AS image_id, CAST(label AS BIGINT) AS action, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_ix FROM embeddings)"""
PALETTE_SQL = "pal(ord, hex, pr, pg, pb) AS (VALUES " + ", ".join(f"({i}, '{h}', {int(h[1:3], 16)}, {int(h[3:5], 16)}, {int(h[5:], 16)})" for i, h in enumerate(PALETTE)) + ")"
LEDGER = """led AS (
  SELECT event_id AS id, user_id AS run, event_type AS op, CASE WHEN event_type <> 'error' THEN value END AS cost, event_type <> 'error' AS ok, ts FROM events)"""
