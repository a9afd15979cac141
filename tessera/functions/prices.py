"""Dated price tables, in dollars a million tokens, and the cost of a call as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.numbers import half_up

# Fixed values: (model, from, input, output, image output, cached) and (model, size, per image).
RATES = (
    ("gemini-nano-banana-2.1", "2000-01-01", 1.5, 7.5, 30.0, None),
    ("gemini-3.1-flash-image", "2000-01-01", 0.5, 3.0, 60.0, None),
    ("gemini-3.1-flash-lite-image", "2000-01-01", 0.25, 1.5, 30.0, None),
    ("gemini-3-pro-image", "2000-01-01", 2.0, 12.0, 120.0, None),
    ("gemini-3.8-flash", "2000-01-01", 0.75, 3.75, None, 0.075),
    ("gemini-3.8-flash", "2027-01-01", 1.5, 7.5, None, 0.15),
    ("gemini-3.7-flash", "2000-01-01", 0.75, 3.75, None, 0.075),
    ("gemini-3.7-flash", "2027-01-01", 1.5, 7.5, None, 0.15),
    ("gemini-3.5-flash", "2000-01-01", 1.5, 9.0, None, 0.15),
    ("gemini-3.5-flash-lite", "2000-01-01", 0.3, 2.5, None, 0.03),
    ("gemini-3.1-flash-lite", "2000-01-01", 0.25, 1.5, None, 0.025),
)
PER_IMAGE = (
    ("gemini-nano-banana-2.1", "1K", 0.0336), ("gemini-nano-banana-2.1", "2K", 0.0504), ("gemini-nano-banana-2.1", "4K", 0.113),
    ("gemini-3.1-flash-image", "512px", 0.045), ("gemini-3.1-flash-image", "1K", 0.067), ("gemini-3.1-flash-image", "2K", 0.101), ("gemini-3.1-flash-image", "4K", 0.151),
    ("gemini-3.1-flash-lite-image", "1K", 0.0336), ("gemini-3-pro-image", "1K", 0.134), ("gemini-3-pro-image", "2K", 0.134), ("gemini-3-pro-image", "4K", 0.24),
)
THINKING = (("off", 0), ("low", 600), ("medium", 1800), ("high", 3500))


def rates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RATES, 'model string, "from" string, input double, output double, image_output double, cached double'.replace('"from"', "since"))


def rates_sql() -> str:
    null = lambda v: "NULL" if v is None else repr(v)
    return "rate(model, since, input, output, image_output, cached) AS (VALUES " + ", ".join(f"('{m}', '{d}', {i}::DOUBLE, {o}::DOUBLE, {null(p)}::DOUBLE, {null(c)}::DOUBLE)" for m, d, i, o, p, c in RATES) + ")"


def as_struct() -> Column:
    """The table as one array of structs: a constant in the plan, so that a lookup needs no join."""
    num = lambda v, n: F.lit(v).cast("double").alias(n)
    return F.array(*(F.struct(F.lit(m).alias("model"), F.lit(d).alias("since"), num(i, "input"), num(o, "output"), num(p, "image_output"), num(c, "cached")) for m, d, i, o, p, c in RATES))


def price(model: Column, day: Column) -> Column:
    """The price in force: the longest model name that is the id or a dash-ended prefix of it, then the last tier begun by the day, else the first."""
    bare = F.regexp_replace(model, "^models/", "")
    fits = F.filter(as_struct(), lambda r: (bare == r["model"]) | F.startswith(bare, F.concat(r["model"], F.lit("-"))))
    key = F.array_max(F.transform(fits, lambda r: F.length(r["model"])))
    own = F.filter(fits, lambda r: F.length(r["model"]) == key)
    begun = F.filter(own, lambda r: r["since"] <= day)
    last = F.get(F.array_sort(begun, lambda p, q: F.when(p["since"] > q["since"], -1).when(p["since"] < q["since"], 1).otherwise(0)), F.lit(0))
    return F.coalesce(last, F.get(own, F.lit(0)))


def image_cost(price: Column, prompt: Column, candidates: Column, image: Column, thoughts: Column) -> Column:
    spoken = F.greatest(F.lit(0), candidates - image) + thoughts
    return half_up(prompt / 1e6 * price["input"] + image / 1e6 * price["image_output"] + spoken / 1e6 * price["output"], 6)


def text_cost(price: Column, prompt: Column, cached: Column, candidates: Column, thoughts: Column) -> Column:
    fresh = F.greatest(F.lit(0), prompt - cached)
    return half_up(fresh / 1e6 * price["input"] + cached / 1e6 * F.coalesce(price["cached"], price["input"]) + (candidates + thoughts) / 1e6 * price["output"], 6)
