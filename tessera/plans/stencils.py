"""Queries with neighbourhoods: blurs, gradients, normals. A picture is one row; a stencil reads its array at clamped places."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.numbers import byte, byte_sql, half_up, half_up_sql
from tessera.plans import fixtures as X
from tessera.plans.registry import query

SIDE = 8


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is worked out once however often the body reads it (a lambda over an array of one)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def heights() -> Column:
    """The 64 grey samples as heights from 0 to 1."""
    return F.transform("embedding", lambda s: X.sample(s) / 255.0)


def pictures(spark, sf):
    return X.table(spark, sf, "embeddings").withColumn("image_id", F.col("vec_id"))


def rows_of(d, values: Column):
    """(image_id, x, y, v): a row for each place of an array of SIDE * SIDE values."""
    d = d.select("image_id", F.posexplode(values).alias("i", "v"))
    return d.select("image_id", (F.col("i") % SIDE).cast("long").alias("x"), F.floor(F.col("i") / SIDE).alias("y"), "v")


def shifted(v: Column, i: Column, dx: int, dy: int, wrap: bool = False) -> Column:
    """The value at an offset from place i, at clamped or wrapped coordinates."""
    x, y = i % SIDE + dx, F.floor(i / SIDE).cast("int") + dy
    at = lambda c: F.pmod(c, F.lit(SIDE)) if wrap else F.greatest(F.lit(0), F.least(F.lit(SIDE - 1), c))
    return F.get(v, at(y) * SIDE + at(x))


def places() -> Column:
    return F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1))


def separable(v: Column, weights: np.ndarray) -> Column:
    """weights @ picture @ weights.T for a constant (SIDE, SIDE) matrix: along x, then along y."""
    w = F.array(*(F.array(*map(F.lit, map(float, row))) for row in weights))
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda s, t: s * t), F.lit(0.0), lambda acc, t: acc + t)
    row = lambda v, i: F.slice(v, F.floor(i / SIDE).cast("int") * SIDE + 1, SIDE)
    column = lambda v, i: F.transform(F.sequence(F.lit(0), F.lit(SIDE - 1)), lambda k: F.get(v, k * SIDE + i % SIDE))

    def both(w):
        across = lambda v: F.transform(places(), lambda i: dot(row(v, i), F.get(w, i % SIDE)))
        down = lambda v: F.transform(places(), lambda i: dot(column(v, i), F.get(w, F.floor(i / SIDE).cast("int"))))
        return let(let(v, across), down)

    return let(w, both)


def box_weights(radius: int = 1, passes: int = 3) -> np.ndarray:
    """A mean of 2 * radius + 1 clamped neighbours, so many times: passes along x and along y commute."""
    w = np.zeros((SIDE, SIDE))
    for i in range(SIDE):
        for k in range(-radius, radius + 1):
            w[i, min(SIDE - 1, max(0, i + k))] += 1 / (2 * radius + 1)
    return np.linalg.matrix_power(w, passes)


def smoothed(v: Column) -> Column:
    return separable(v, box_weights())


_H = "h0 AS (SELECT image_id, x, y, g / 255.0::DOUBLE AS v FROM grey)"


def _blur_sql(passes: int, radius: int = 1) -> str:
    parts, src = [], "h0"
    for k in range(passes):
        for axis, other in (("x", "y"), ("y", "x")):
            dst = f"h{k}{axis}"
            terms = " + ".join(f"max(q.v) FILTER (q.{axis} = greatest(0, least(7, p.{axis} + ({o}))))" for o in range(-radius, radius + 1))
            parts.append(f"{dst} AS (SELECT p.image_id, p.x, p.y, ({terms}) / {2 * radius + 1} AS v FROM {src} p JOIN {src} q ON p.image_id = q.image_id AND p.{other} = q.{other} GROUP BY p.image_id, p.x, p.y)")
            src = dst
    return ", ".join(parts), src


_B1, _S1 = _blur_sql(3)


@query("box_smooth", f"WITH {X.GREY}, {_H}, {_B1} SELECT image_id, x, y, {half_up_sql('v', 6)} AS v FROM {_S1}")
def box_smooth(spark, sf):
    return rows_of(pictures(spark, sf), smoothed(heights())).withColumn("v", half_up(F.col("v"), 6))


def gradients(v: Column, i: Column, wrap: bool = False) -> tuple[Column, Column]:
    """Sobel / 8."""
    s = lambda dx, dy: shifted(v, i, dx, dy, wrap)
    gx = (s(1, -1) + s(1, 0) * 2 + s(1, 1) - s(-1, -1) - s(-1, 0) * 2 - s(-1, 1)) / 8
    gy = (s(-1, 1) + s(0, 1) * 2 + s(1, 1) - s(-1, -1) - s(0, -1) * 2 - s(1, -1)) / 8
    return gx, gy


def slopes(v: Column) -> Column:
    """The array of (gx, gy) of every place."""
    return let(v, lambda v: F.transform(places(), lambda i: F.struct(*(g.alias(n) for g, n in zip(gradients(v, i), ("gx", "gy"), strict=True)))))


def _sobel_sql(src: str) -> str:
    def at(dx: int, dy: int) -> str:
        return f"max(q.v) FILTER (q.x = greatest(0, least(7, p.x + ({dx}))) AND q.y = greatest(0, least(7, p.y + ({dy}))))"

    gx = f"({at(1, -1)} + 2 * {at(1, 0)} + {at(1, 1)} - {at(-1, -1)} - 2 * {at(-1, 0)} - {at(-1, 1)}) / 8"
    gy = f"({at(-1, 1)} + 2 * {at(0, 1)} + {at(1, 1)} - {at(-1, -1)} - 2 * {at(0, -1)} - {at(1, -1)}) / 8"
    return f"sob AS (SELECT p.image_id, p.x, p.y, {gx} AS gx, {gy} AS gy FROM {src} p JOIN {src} q ON p.image_id = q.image_id AND abs(p.x - q.x) <= 1 AND abs(p.y - q.y) <= 1 GROUP BY p.image_id, p.x, p.y)"


@query("sobel", f"WITH {X.GREY}, {_H}, {_sobel_sql('h0')} SELECT image_id, x, y, {half_up_sql('gx', 6)} AS gx, {half_up_sql('gy', 6)} AS gy FROM sob")
def sobel(spark, sf):
    return rows_of(pictures(spark, sf), slopes(heights())).select("image_id", "x", "y", half_up(F.col("v.gx"), 6).alias("gx"), half_up(F.col("v.gy"), 6).alias("gy"))


_C1, _S2 = _blur_sql(3)
_NORMAL = f"""nm AS (SELECT image_id, x, y, gx * 8 AS dx, gy * 8 AS dy, sqrt(gx * gx * 64 + gy * gy * 64 + 1) AS len FROM sob)"""


def normals(d, strength: float = 1.0):
    """(image_id, x, y, nx, ny, nz): unit normals of the smoothed heights, green up; the slope is eight times the gradient."""
    d = rows_of(d, slopes(smoothed(heights())))
    dx, dy = F.col("v.gx") * strength * 8, F.col("v.gy") * strength * 8
    d = d.select("image_id", "x", "y", dx.alias("dx"), dy.alias("dy"), F.sqrt(dx * dx + dy * dy + 1).alias("len"))
    return d.select("image_id", "x", "y", (-F.col("dx") / F.col("len")).alias("nx"), (F.col("dy") / F.col("len")).alias("ny"), (1 / F.col("len")).alias("nz"))


@query("normal_map", f"WITH {X.GREY}, {_H}, {_C1}, {_sobel_sql(_S2)}, {_NORMAL} SELECT image_id, x, y, {byte_sql('round((-dx / len + 1) * 127.5, 6)')} AS r, {byte_sql('round((dy / len + 1) * 127.5, 6)')} AS g, {byte_sql('round((1 / len + 1) * 127.5, 6)')} AS b FROM nm")
def normal_map(spark, sf):
    n = normals(pictures(spark, sf))
    return n.select("image_id", "x", "y", *(byte(F.round((F.col(c) + 1) * 127.5, 6)).alias(o) for c, o in (("nx", "r"), ("ny", "g"), ("nz", "b"))))


@query("normal_map_facts", f"WITH {X.GREY}, {_H}, {_C1}, {_sobel_sql(_S2)}, {_NORMAL} SELECT image_id, {half_up_sql('count(*) FILTER (1 / len > 0.999) / CAST(count(*) AS DOUBLE)', 3)} AS flat_share, {half_up_sql('max(sqrt(dx * dx + dy * dy))', 3)} AS max_slope FROM nm GROUP BY image_id")
def normal_map_facts(spark, sf):
    n = normals(pictures(spark, sf))
    slope = F.sqrt(F.greatest(F.lit(0.0), 1 / (F.col("nz") * F.col("nz")) - 1))
    return n.groupBy("image_id").agg(half_up(F.count_if(F.col("nz") > 0.999) / F.count("*"), 3).alias("flat_share"), half_up(F.max(slope), 3).alias("max_slope"))


@query("relight", f"WITH {X.GREY}, {_H}, {_C1}, {_sobel_sql(_S2)}, {_NORMAL} SELECT n.image_id, n.x, n.y, {byte_sql('g.g * least(1.6::DOUBLE, 0.35 + 0.65 * greatest(0, (-dx * -0.5::DOUBLE - dy * -0.5 + 0.7071::DOUBLE) / len) * 1.6)')} AS lit FROM nm n JOIN grey g ON g.image_id = n.image_id AND g.x = n.x AND g.y = n.y")
def relight(spark, sf, ambient: float = 0.35, light=(-0.5, -0.5, 0.7071)):
    """Lambert shading of the grey picture by a light from the upper left (y down)."""
    d = rows_of(pictures(spark, sf), F.arrays_zip(slopes(smoothed(heights())).alias("s"), F.transform("embedding", X.sample).alias("g")))
    dx, dy = F.col("v")["s"]["gx"] * 8, F.col("v")["s"]["gy"] * 8
    facing = F.greatest(F.lit(0.0), (-dx * light[0] - dy * light[1] + light[2]) / F.sqrt(dx * dx + dy * dy + 1))
    k = F.least(F.lit(1.6), facing * 1.6 * (1 - ambient) + ambient)
    return d.select("image_id", "x", "y", byte(F.col("v")["g"] * k).alias("lit"))


def _weights(sigma: float) -> list[float]:
    import math

    r = math.ceil(2.5 * sigma)
    w = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-r, r + 1)]
    return [v / sum(w) for v in w]


_W = _weights(0.8)
_R = len(_W) // 2
_GX = " + ".join(f"coalesce(max(q.v) FILTER (q.x = p.x + ({k})), 0) * {w!r}" for k, w in zip(range(-_R, _R + 1), _W, strict=True))
_GY = " + ".join(f"coalesce(max(q.v) FILTER (q.y = p.y + ({k})), 0) * {w!r}" for k, w in zip(range(-_R, _R + 1), _W, strict=True))


@query("gaussian", f"WITH {X.GREY}, {_H}, gx AS (SELECT p.image_id, p.x, p.y, {_GX} AS v FROM h0 p JOIN h0 q ON p.image_id = q.image_id AND p.y = q.y GROUP BY p.image_id, p.x, p.y), gy AS (SELECT p.image_id, p.x, p.y, {_GY} AS v FROM gx p JOIN gx q ON p.image_id = q.image_id AND p.x = q.x GROUP BY p.image_id, p.x, p.y) SELECT image_id, x, y, {half_up_sql('v', 6)} AS v FROM gy")
def gaussian(spark, sf, sigma: float = 0.8):
    """What lies outside counts as zero, and the kernel isn't scaled up at the edges."""
    w = _weights(sigma)
    r = len(w) // 2
    m = np.array([[w[j - i + r] if abs(j - i) <= r else 0.0 for j in range(SIDE)] for i in range(SIDE)])
    return rows_of(pictures(spark, sf), separable(heights(), m)).withColumn("v", half_up(F.col("v"), 6))


_SEAMX = "sx AS (SELECT p.image_id, p.x, p.y, CASE WHEN p.x = 0 THEN " + byte_sql("p.g - (l.g - r.g) * 0.5::DOUBLE") + " WHEN p.x = 7 THEN " + byte_sql("p.g + (l.g - r.g) * 0.5::DOUBLE") + " ELSE p.g END AS g FROM grey p JOIN grey l ON l.image_id = p.image_id AND l.y = p.y AND l.x = 0 JOIN grey r ON r.image_id = p.image_id AND r.y = p.y AND r.x = 7)"
_SEAMY = "sy AS (SELECT p.image_id, p.x, p.y, CASE WHEN p.y = 0 THEN " + byte_sql("p.g - (l.g - r.g) * 0.5::DOUBLE") + " WHEN p.y = 7 THEN " + byte_sql("p.g + (l.g - r.g) * 0.5::DOUBLE") + " ELSE p.g END AS g FROM sx p JOIN sx l ON l.image_id = p.image_id AND l.x = p.x AND l.y = 0 JOIN sx r ON r.image_id = p.image_id AND r.x = p.x AND r.y = 7)"


@query("make_seamless", f"WITH {X.GREY}, {_SEAMX}, {_SEAMY} SELECT image_id, x, y, g FROM sy")
def make_seamless(spark, sf):
    """Opposite edges meet halfway (a band of one pixel at this size), across, then down on the result."""

    def meet(v, along_x: bool):
        def one(i):
            c = i % SIDE if along_x else F.floor(i / SIDE).cast("int")
            o = F.floor(i / SIDE).cast("int") if along_x else i % SIDE
            first, last = (o * SIDE, o * SIDE + SIDE - 1) if along_x else (o, o + SIDE * (SIDE - 1))
            delta = (F.get(v, first) - F.get(v, last)) * 0.5
            return F.when(c == 0, byte(F.get(v, i) - delta)).when(c == SIDE - 1, byte(F.get(v, i) + delta)).otherwise(F.get(v, i))

        return F.transform(places(), one)

    across = let(F.transform("embedding", X.sample), lambda v: meet(v, True))
    return rows_of(pictures(spark, sf), let(across, lambda v: meet(v, False))).withColumnRenamed("v", "g")
