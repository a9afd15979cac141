"""Queries that read outputs back and hold them to their rules; a failure is a row, not an error."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.numbers import byte, byte_sql, half_up, half_up_sql
from tessera.plans import fixtures as X
from tessera.plans.compare import neighbours
from tessera.plans.registry import query
from tessera.plans.stencils import _C1, _H, _NORMAL, _S2, _sobel_sql, heights, normals, pictures, rows_of, slopes, smoothed

_POINTS = "'PackedVector2Array(' || vec_id % 9 || ', 0, ' || CASE WHEN vec_id % 4 = 0 THEN '' ELSE vec_id % 7 || ', ' END || '-' || vec_id % 5 + 1 || ')'"


@query("recheck_points", f"WITH t AS (SELECT vec_id AS image_id, {_POINTS} AS t FROM embeddings), n AS (SELECT image_id, len(string_split(regexp_extract(t, '^PackedVector2Array\\((.*)\\)$', 1), ',')) AS n FROM t) SELECT image_id, n AS numbers, n % 2 = 0 AS ok, CASE WHEN n % 2 = 0 THEN '' ELSE 'an odd number of coordinates' END AS detail FROM n")
def recheck_points(spark, sf):
    """A list of points in text parses into pairs."""
    v = F.col("vec_id")
    t = F.concat(F.lit("PackedVector2Array("), v % 9, F.lit(", 0, "), F.when(v % 4 == 0, "").otherwise(F.concat(v % 7, F.lit(", "))), F.lit("-"), v % 5 + 1, F.lit(")"))
    n = F.size(F.split(F.regexp_extract(t, r"^PackedVector2Array\((.*)\)$", 1), ",")).cast("long")
    d = X.table(spark, sf, "embeddings").select(v.alias("image_id"), n.alias("numbers"))
    ok = F.col("numbers") % 2 == 0
    return d.select("image_id", "numbers", ok.alias("ok"), F.when(ok, "").otherwise("an odd number of coordinates").alias("detail"))


_BYTES = ", ".join(f"{byte_sql(f'round(({e} + 1) * 127.5, 6)')} AS {c}" for c, e in (("r", "-dx / len"), ("g", "dy / len"), ("b", "1 / len")))


@query("recheck_normal", f"WITH {X.GREY}, {_H}, {_C1}, {_sobel_sql(_S2)}, {_NORMAL}, b AS (SELECT image_id, {_BYTES} FROM nm), u AS (SELECT image_id, abs(sqrt(pow(r / 127.5::DOUBLE - 1, 2) + pow(g / 127.5::DOUBLE - 1, 2) + pow(b / 127.5::DOUBLE - 1, 2)) - 1) AS e, b FROM b) SELECT image_id, {half_up_sql('max(e)', 4)} AS worst, max(e) <= 0.12 AND min(b) > 127 AS ok FROM u GROUP BY image_id")
def recheck_normal(spark, sf):
    """The stored bytes of a normal map are of unit length, within what a byte can say, and face outwards."""
    n = normals(pictures(spark, sf)).select("image_id", *(byte(F.round((F.col(c) + 1) * 127.5, 6)).alias(o) for c, o in (("nx", "r"), ("ny", "g"), ("nz", "b"))))
    v = [F.col(c) / 127.5 - 1 for c in "rgb"]
    off = F.abs(F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2]) - 1)
    return n.groupBy("image_id").agg(half_up(F.max(off), 4).alias("worst"), ((F.max(off) <= 0.12) & (F.min("b") > 127)).alias("ok"))


_LIGHTS = ((-0.5, -0.5), (0.5, -0.5), (-0.5, 0.5), (0.5, 0.5))


def _lit_sql(i: int, lx: float, ly: float) -> str:
    return f"SELECT n.image_id, n.x + {9 * i} AS x, n.y, {byte_sql(f'g.g * least(1.6::DOUBLE, 0.35 + 0.65 * greatest(0, (-dx * ({lx})::DOUBLE - dy * ({ly}) + 0.7071::DOUBLE) / len) * 1.6)')} AS lit FROM nm n JOIN grey g ON g.image_id = n.image_id AND g.x = n.x AND g.y = n.y"


@query("lighting_strip", f"WITH {X.GREY}, {_H}, {_C1}, {_sobel_sql(_S2)}, {_NORMAL} " + " UNION ALL ".join(_lit_sql(i, *l) for i, l in enumerate(_LIGHTS)))
def lighting_strip(spark, sf, ambient: float = 0.35):
    """A picture under four corner lights, side by side with a gap of one."""
    d = rows_of(pictures(spark, sf), F.arrays_zip(slopes(smoothed(heights())).alias("s"), F.transform("embedding", X.sample).alias("g")))
    dx, dy = F.col("v")["s"]["gx"] * 8, F.col("v")["s"]["gy"] * 8
    size = F.sqrt(dx * dx + dy * dy + 1)

    def lit(lx, ly):
        facing = F.greatest(F.lit(0.0), (-dx * lx - dy * ly + 0.7071) / size)
        return byte(F.col("v")["g"] * F.least(F.lit(1.6), facing * 1.6 * (1 - ambient) + ambient))

    four = F.array(*(F.struct((F.col("x") + 9 * i).alias("x"), lit(*l).alias("lit")) for i, l in enumerate(_LIGHTS)))
    return d.select("image_id", "y", four.alias("four")).select("image_id", "y", F.inline("four"))


@query("normal_verdict", f"WITH {X.GREY}, {_H}, {_C1}, {_sobel_sql(_S2)}, {_NORMAL}, s AS (SELECT image_id, count(*) FILTER (1 / len > 0.9) / CAST(count(*) AS DOUBLE) AS flat FROM nm GROUP BY image_id) SELECT image_id, CASE WHEN flat > 0.9 THEN 'flat' ELSE 'derived' END AS verdict FROM s")
def normal_verdict(spark, sf):
    n = normals(pictures(spark, sf)).groupBy("image_id").agg((F.count_if(F.col("nz") > 0.9) / F.count("*")).alias("flat"))
    return n.select("image_id", F.when(F.col("flat") > 0.9, "flat").otherwise("derived").alias("verdict"))


_TWO = f"{X.PIXELS}, {X.FRAMES}, n AS (SELECT p.*, f.frame_ix FROM pix p JOIN frm f USING (image_id)), two AS (SELECT t.image_id, abs(t.a - u.a) AS d FROM n t JOIN n u ON t.action = u.action AND t.frame_ix = u.frame_ix + 1 AND t.i = u.i)"


@query("faithful", f"WITH {_TWO} SELECT image_id, max(d) AS worst, count(*) FILTER (d > 8) / CAST(count(*) AS DOUBLE) <= 0.9 AND max(d) <= 180 AS ok FROM two GROUP BY image_id")
def faithful(spark, sf, share: float = 0.9, most: int = 180):
    """Alpha differs from the frame before at few enough pixels, and nowhere by too much."""
    sixteen = F.sequence(F.lit(3), F.lit(63), F.lit(4))
    d = neighbours(spark, sf).select("image_id", F.transform(sixteen, lambda i: F.abs(F.get("data", i) - F.get("low", i))).alias("d"))
    return d.select("image_id", F.array_max("d").alias("worst"), ((F.size(F.filter("d", lambda v: v > 8)) / 16 <= share) & (F.array_max("d") <= most)).alias("ok"))


@query("store_delta", "SELECT vec_id AS image_id, " + half_up_sql("list_sum(list_transform(range(1, 9), lambda i: floor(CAST(embedding[i] AS DOUBLE) * 100) * ((vec_id + i) % 5) / 4.0::DOUBLE))", 4) + " AS delta FROM embeddings")
def store_delta(spark, sf):
    """One item's delta: its delta set weighted by the regions' scalars."""
    eight = F.sequence(F.lit(1), F.lit(8))
    one = lambda acc, i: acc + F.floor(F.get("embedding", i - 1).cast("double") * 100) * ((F.col("vec_id") + i) % 5) / 4.0
    return X.table(spark, sf, "embeddings").select(F.col("vec_id").alias("image_id"), half_up(F.aggregate(eight, F.lit(0.0), one), 4).alias("delta"))


@query("describe_variation", "SELECT p_partkey AS id, 'wght ' || p_partkey % 900 || ', wdth ' || p_size AS text, 'wght' || p_partkey % 900 || '-wdth' || p_size AS slug FROM part")
def describe_variation(spark, sf):
    settings = F.array(F.struct(F.lit("wght").alias("tag"), (F.col("p_partkey") % 900).alias("v")), F.struct(F.lit("wdth").alias("tag"), F.col("p_size").cast("long").alias("v")))
    join = lambda mid, sep: F.array_join(F.transform(settings, lambda s: F.concat(s["tag"], F.lit(mid), s["v"].cast("string"))), sep)
    return X.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), join(" ", ", ").alias("text"), join("", "-").alias("slug"))
