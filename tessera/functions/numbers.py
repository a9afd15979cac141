"""Rounding, medians and sums whose rules differ from SQL's defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, places: int = 0) -> Column:
    """Round half towards positive infinity, as a double."""
    scale = 10.0**places
    return F.floor(x * scale + 0.5).cast("double") / scale


def half_up_sql(x: str, places: int = 0) -> str:
    return f"(CAST(floor(({x}) * {10.0**places} + 0.5) AS DOUBLE) / {10.0**places})"


def upper_median(x: Column) -> Column:
    """Of an even number of values, the larger middle one. An aggregate; for groups of bounded size."""
    s = F.sort_array(F.collect_list(x))
    return F.get(s, F.floor(F.size(s) / 2).cast("int"))


def upper_median_sql(x: str) -> str:
    return f"list_sort(list({x}))[CAST(count({x}) AS BIGINT) // 2 + 1]"


def strict_sum(x: Column) -> Column:
    """A sum that is null as soon as one part is."""
    return F.when(F.count(x) == F.count(F.lit(1)), F.sum(x))


def byte(x: Column) -> Column:
    """Clamp to 0..255 and round half up."""
    return F.greatest(F.lit(0), F.least(F.lit(255), F.floor(x + 0.5))).cast("long")


def byte_sql(x: str) -> str:
    return f"CAST(greatest(0, least(255, floor(({x}) + 0.5))) AS BIGINT)"
