"""Queries that place and resample pictures: mirrors, crops, tilings, packing, scales."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions.numbers import byte, byte_sql, half_up, half_up_sql
from tessera.plans import fixtures as X
from tessera.plans.measure import bounds
from tessera.plans.registry import query

RGBA = "rgba"


@query("mirror", f"WITH {X.PIXELS} SELECT image_id, 3 - x AS x, y, r, g, b, a FROM pix")
def mirror(spark, sf):
    return X.pixels(spark, sf).select("image_id", (3 - F.col("x")).alias("x"), "y", *RGBA)


@query("crop", f"WITH {X.PIXELS}, t AS (SELECT unnest(range(-1, 4)) AS x), u AS (SELECT unnest(range(1, 6)) AS y) SELECT e.vec_id AS image_id, t.x + 1 AS x, u.y - 1 AS y, coalesce(r, 0) AS r, coalesce(g, 0) AS g, coalesce(b, 0) AS b, coalesce(a, 0) AS a FROM embeddings e, t, u LEFT JOIN pix p ON p.image_id = e.vec_id AND p.x = t.x AND p.y = u.y")
def crop(spark, sf, x0: int = -1, y0: int = 1, width: int = 5, height: int = 5):
    """A rectangle that may pass the picture's sides; there it is clear. The source is read at computed places, so nothing joins."""
    at = F.sequence(F.lit(0), F.lit(width * height - 1))
    d = X.packed(spark, sf).select("image_id", "data", F.explode(at).alias("k"))
    x, y = F.col("k") % width, F.floor(F.col("k") / width).cast("int")
    inside = (x + x0).between(0, 3) & (y + y0).between(0, 3)
    p = ((y + y0) * 4 + x + x0) * 4
    return d.select("image_id", x.cast("long").alias("x"), y.cast("long").alias("y"), *(F.when(inside, F.get("data", p + i)).otherwise(0).alias(c) for i, c in enumerate(RGBA)))


@query("tile_repeat", f"WITH {X.PIXELS}, t AS (SELECT unnest(range(0, 3)) AS tx), u AS (SELECT unnest(range(0, 3)) AS ty) SELECT image_id, tx * 4 + x AS x, ty * 4 + y AS y, r, g, b, a FROM pix, t, u")
def tile_repeat(spark, sf, n: int = 3):
    offs = F.array(*(F.struct(F.lit(x * 4).alias("x"), F.lit(y * 4).alias("y")) for x in range(n) for y in range(n)))
    d = X.pixels(spark, sf).select("*", offs.alias("offs")).select("*", F.explode("offs").alias("o"))
    return d.select("image_id", (F.col("o.x") + F.col("x")).alias("x"), (F.col("o.y") + F.col("y")).alias("y"), *RGBA)


@query("blit", f"WITH {X.PIXELS}, {X.FRAMES}, n AS (SELECT p.*, f.frame_ix FROM pix p JOIN frm f USING (image_id)) SELECT t.image_id, t.x, t.y, coalesce(u.r, t.r) AS r, coalesce(u.g, t.g) AS g, coalesce(u.b, t.b) AS b, coalesce(u.a, t.a) AS a FROM n t LEFT JOIN n u ON u.action = t.action AND u.frame_ix = t.frame_ix - 1 AND t.x = u.x + 2 AND t.y = u.y + 1")
def blit(spark, sf, dx: int = 2, dy: int = 1):
    """The frame before copied over each frame at an offset, clipped, without blending."""
    d = X.in_sequence(X.packed(spark, sf), "data").select("image_id", "data", "low", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("k"))
    x, y = F.col("k") % 4, F.floor(F.col("k") / 4).cast("int")
    inside = (x - dx >= 0) & (y - dy >= 0) & F.col("low").isNotNull()
    p = ((y - dy) * 4 + x - dx) * 4
    return d.select("image_id", x.cast("long").alias("x"), y.cast("long").alias("y"), *(F.when(inside, F.get("low", p + i)).otherwise(F.get("data", F.col("k") * 4 + i)).alias(c) for i, c in enumerate(RGBA)))


@query("resize_nearest", f"WITH {X.PIXELS}, t AS (SELECT unnest(range(0, 7)) AS tx), u AS (SELECT unnest(range(0, 3)) AS ty) SELECT image_id, tx AS x, ty AS y, r, g, b, a FROM pix p, t, u WHERE p.x = least(3, CAST(floor((tx + 0.5) * 4 / 7.0::DOUBLE) AS BIGINT)) AND p.y = least(3, CAST(floor((ty + 0.5) * 4 / 3.0::DOUBLE) AS BIGINT))")
def resize_nearest(spark, sf, width: int = 7, height: int = 3):
    d = X.packed(spark, sf).select("image_id", "data", F.explode(F.sequence(F.lit(0), F.lit(width * height - 1))).alias("k"))
    x, y = F.col("k") % width, F.floor(F.col("k") / width).cast("int")
    near = lambda c, n: F.least(F.lit(3), F.floor((c + 0.5) * 4 / n).cast("int"))
    p = (near(y, float(height)) * 4 + near(x, float(width))) * 4
    return d.select("image_id", x.cast("long").alias("x"), y.cast("long").alias("y"), *(F.get("data", p + i).alias(c) for i, c in enumerate(RGBA)))


def _box(n: int, m: int) -> list[tuple[int, int, float]]:
    """(target, source, weight): the share of each source pixel in the area of each target pixel."""
    s = n / m
    return [(i, j, (min((i + 1) * s, j + 1) - max(i * s, j)) / s) for i in range(m) for j in range(n) if min((i + 1) * s, j + 1) - max(i * s, j) > 1e-9]


def _line(n: int, m: int) -> list[tuple[int, int, float]]:
    """(target, source, weight): the two nearest source pixels by distance."""
    out = []
    for i in range(m):
        c = (i + 0.5) * n / m - 0.5
        j = max(0, min(n - 1, int(c // 1)))
        k = min(n - 1, j + 1)
        t = 0.0 if c < 0 else min(1.0, c - j)
        out += [(i, j, 1.0)] if j == k else [(i, j, 1 - t), (i, k, t)]
    return out


def _resize_sql(kind, w: int, h: int) -> str:
    vals = lambda rows: ", ".join(f"({t}, {s}, {v!r}::DOUBLE)" for t, s, v in rows)
    return f"""WITH {X.PIXELS}, wx(t, s, w) AS (VALUES {vals(kind(4, w))}), wy(t, s, w) AS (VALUES {vals(kind(4, h))}),
    m AS (SELECT image_id, wx.t AS x, wy.t AS y, sum(a / 255.0::DOUBLE * wx.w * wy.w) AS k, """ + ", ".join(f"sum({c} * (a / 255.0::DOUBLE) * wx.w * wy.w) AS {c}" for c in "rgb") + f""" FROM pix p JOIN wx ON wx.s = p.x JOIN wy ON wy.s = p.y GROUP BY image_id, wx.t, wy.t)
    SELECT image_id, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, """ + ", ".join(f"CASE WHEN k <= 0 THEN 0 ELSE {byte_sql(f'round({c} / k, 7)')} END AS {c}" for c in "rgb") + f", {byte_sql('round(k * 255, 7)')} AS a FROM m"


def resized(d, kind, width: int, height: int):
    """Rows of pixels of a separable resampling with premultiplied alpha; the weights are constants of the plan."""
    wx, wy = kind(4, width), kind(4, height)
    taps = [(x, y, sy * 4 + sx, v * w) for x, sx, v in wx for y, sy, w in wy]
    some = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.array(*(F.struct(F.lit(p).alias("p"), F.lit(v).alias("w")) for a, b, p, v in taps if (a, b) == (x, y))).alias("taps")) for x in range(width) for y in range(height)))
    d = d.select("image_id", "data", some.alias("some")).select("image_id", "data", F.inline("some"))
    one = lambda f: F.aggregate("taps", F.lit(0.0), lambda acc, t: acc + f(t))
    k = lambda t: F.get("data", t["p"] * 4 + 3) / 255.0 * t["w"]

    def channel(i):
        return one(lambda t: F.get("data", t["p"] * 4 + i) * k(t))

    d = d.select("image_id", "x", "y", one(k).alias("k"), *(channel(i).alias(c) for i, c in enumerate("rgb")))
    return d.select("image_id", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), *(F.when(F.col("k") <= 0, 0).otherwise(byte(F.round(F.col(c) / F.col("k"), 7))).alias(c) for c in "rgb"), byte(F.round(F.col("k") * 255, 7)).alias("a"))


@query("resize_box", _resize_sql(_box, 3, 2))
def resize_box(spark, sf):
    return resized(X.packed(spark, sf), _box, 3, 2)


@query("resize_linear", _resize_sql(_line, 6, 5))
def resize_linear(spark, sf):
    return resized(X.packed(spark, sf), _line, 6, 5)


@query("pack_actions", f"WITH {X.FRAMES}, o AS (SELECT action, row_number() OVER (ORDER BY action) - 1 AS row FROM (SELECT DISTINCT action FROM frm)), n AS (SELECT action, count(*) AS n FROM frm GROUP BY action), f AS (SELECT action, sum(n) OVER (ORDER BY action) - n AS before FROM n) SELECT frm.image_id, CAST(before + frame_ix AS BIGINT) AS index, frame_ix * 6 AS x, row * 6 AS y, CAST(4 AS BIGINT) AS width, CAST(4 AS BIGINT) AS height, CAST(125 AS BIGINT) AS duration_ms FROM frm JOIN o USING (action) JOIN f USING (action)")
def pack_actions(spark, sf, pad: int = 2, fps: int = 8):
    """An action a row, frames in equal cells. The offsets of actions come from their counts, one row an action."""
    f = X.frames(spark, sf)
    n = f.groupBy("action").agg(F.count("*").alias("n"))
    order = Window.orderBy("action")
    at = n.select("action", (F.row_number().over(order) - 1).alias("row"), (F.sum("n").over(order) - F.col("n")).alias("before"))
    j = f.join(at, "action")
    four = lambda n: F.lit(4).cast("long").alias(n)
    return j.select("image_id", (F.col("before") + F.col("frame_ix")).alias("index"), (F.col("frame_ix") * (4 + pad)).alias("x"), (F.col("row") * (4 + pad)).cast("long").alias("y"), four("width"), four("height"), F.lit(1000 // fps).cast("long").alias("duration_ms"))


@query("trim_frames", f"WITH {X.PIXELS}, b AS (SELECT image_id, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM pix WHERE a >= 200 GROUP BY image_id) SELECT e.vec_id AS image_id, CASE WHEN x0 IS NULL THEN 0 ELSE greatest(0, x0 - 1) END AS x, CASE WHEN x0 IS NULL THEN 0 ELSE greatest(0, y0 - 1) END AS y, CASE WHEN x0 IS NULL THEN 1 ELSE least(4, x1 + 2) - greatest(0, x0 - 1) END AS w, CASE WHEN x0 IS NULL THEN 1 ELSE least(4, y1 + 2) - greatest(0, y0 - 1) END AS h, x0 IS NULL AS empty FROM embeddings e LEFT JOIN b ON b.image_id = e.vec_id")
def trim_frames(spark, sf, margin: int = 1):
    """The rectangle to cut, with a margin inside the cell; one texel, flagged, for an empty frame."""
    b = bounds(X.pixels(spark, sf), 200)
    lo = lambda c: F.greatest(F.lit(0), F.col(c) - margin)
    hi = lambda c, n: F.least(F.lit(4), F.col(c) + F.col(n) + margin)
    return b.select("image_id", F.coalesce(F.when(F.col("x0").isNotNull(), lo("x0")), F.lit(0)).alias("x"), F.coalesce(F.when(F.col("y0").isNotNull(), lo("y0")), F.lit(0)).alias("y"), F.when(F.col("x0").isNull(), 1).otherwise(hi("x0", "width") - lo("x0")).alias("w"), F.when(F.col("x0").isNull(), 1).otherwise(hi("y0", "height") - lo("y0")).alias("h"), F.col("x0").isNull().alias("empty"))


@query("fit_into", "WITH p AS (SELECT p_partkey, 3 + p_size % 40 AS w, 3 + p_partkey % 50 AS h FROM part), s AS (SELECT *, least(64 / CAST(w AS DOUBLE), 48 / CAST(h AS DOUBLE)) AS s FROM p), t AS (SELECT *, greatest(1, CAST(floor(w * s + 0.5) AS BIGINT)) AS tw, greatest(1, CAST(floor(h * s + 0.5) AS BIGINT)) AS th FROM s) SELECT p_partkey AS id, tw AS width, th AS height, CAST(floor((64 - tw) / 2.0::DOUBLE) AS BIGINT) AS x, 48 - th AS y FROM t")
def fit_into(spark, sf, width: int = 64, height: int = 48):
    """The place of a rectangle scaled to fit a canvas, centred and standing on its floor."""
    p = X.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (3 + F.col("p_size") % 40).alias("w"), (3 + F.col("p_partkey") % 50).alias("h"))
    s = F.least(width / F.col("w"), height / F.col("h"))
    t = [F.greatest(F.lit(1), F.floor(F.col(c) * s + 0.5)) for c in "wh"]
    return p.select("id", t[0].alias("width"), t[1].alias("height"), F.floor((width - t[0]) / 2.0).alias("x"), (height - t[1]).alias("y"))


@query("cover_into", "WITH p AS (SELECT p_partkey, 3 + p_size % 40 AS w, 3 + p_partkey % 50 AS h FROM part), s AS (SELECT *, greatest(64 / CAST(w AS DOUBLE), 48 / CAST(h AS DOUBLE)) AS s FROM p), t AS (SELECT p_partkey, greatest(64, CAST(floor(w * s + 0.5) AS BIGINT)) AS tw, greatest(48, CAST(floor(h * s + 0.5) AS BIGINT)) AS th FROM s) SELECT p_partkey AS id, tw AS width, th AS height, (tw - 64) // 2 AS cut_x, (th - 48) // 2 AS cut_y FROM t")
def cover_into(spark, sf, width: int = 64, height: int = 48):
    p = X.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (3 + F.col("p_size") % 40).alias("w"), (3 + F.col("p_partkey") % 50).alias("h"))
    s = F.greatest(width / F.col("w"), height / F.col("h"))
    tw, th = (F.greatest(F.lit(n), F.floor(F.col(c) * s + 0.5)) for c, n in (("w", width), ("h", height)))
    return p.select("id", tw.alias("width"), th.alias("height"), F.floor((tw - width) / 2).alias("cut_x"), F.floor((th - height) / 2).alias("cut_y"))


@query("shared_scale", f"WITH {X.PIXELS}, {X.FRAMES}, b AS (SELECT f.action, f.image_id, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h FROM pix p JOIN frm f USING (image_id) WHERE a >= 200 GROUP BY f.action, f.image_id) SELECT action, {half_up_sql('least(32 * 0.9::DOUBLE / greatest(1, max(w)), 48 * 0.9::DOUBLE / greatest(1, max(h)))', 6)} AS scale FROM b GROUP BY action")
def shared_scale(spark, sf, width: int = 32, height: int = 48, fill: float = 0.9):
    b = bounds(X.pixels(spark, sf), 200).where("x0 is not null")
    f = X.packed(spark, sf).select("image_id", "action").join(b, "image_id")
    return f.groupBy("action").agg(half_up(F.least(width * fill / F.greatest(F.lit(1), F.max("width")), height * fill / F.greatest(F.lit(1), F.max("height"))), 6).alias("scale"))


@query("mark_placement", "WITH p AS (SELECT p_partkey, 3 + p_size % 40 AS w, 3 + p_partkey % 50 AS h FROM part), s AS (SELECT *, least(0.6::DOUBLE * 108 / greatest(w, h), 108 / CAST(greatest(w, h) AS DOUBLE)) AS s FROM p), t AS (SELECT *, CASE WHEN p_partkey % 2 = 0 AND s >= 1 THEN floor(s) ELSE s END AS k FROM s) SELECT p_partkey AS id, " + f"{half_up_sql('k', 5)} AS scale, {half_up_sql('(108 - w * k) / 2', 4)} AS ox, {half_up_sql('(108 - h * k) / 2', 4)} AS oy FROM t")
def mark_placement(spark, sf, size: int = 108, box: float = 0.6):
    """Scale and offsets of a mark on a square; a whole number where it is pixel art and is enlarged."""
    p = X.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (3 + F.col("p_size") % 40).alias("w"), (3 + F.col("p_partkey") % 50).alias("h"))
    big = F.greatest("w", "h")
    s = F.least(box * size / big, size / big)
    k = F.when((F.col("id") % 2 == 0) & (s >= 1), F.floor(s).cast("double")).otherwise(s)
    return p.select("id", half_up(k, 5).alias("scale"), half_up((size - F.col("w") * k) / 2, 4).alias("ox"), half_up((size - F.col("h") * k) / 2, 4).alias("oy"))


def strip_shape(n):
    """The aspect of a strip of n frames, as the reference cuts them."""
    return F.when(n <= 1, "1:1").when(n == 2, "3:2").when(n <= 4, "16:9").otherwise("21:9")


_SHAPE = "CASE WHEN n <= 1 THEN '1:1' WHEN n = 2 THEN '3:2' WHEN n <= 4 THEN '16:9' ELSE '21:9' END"


_STRIPS = f"WITH {X.FRAMES}, a AS (SELECT action, count(*) AS n FROM frm GROUP BY action) SELECT action, n, {_SHAPE} AS aspect FROM a"


@query("strip_aspect", _STRIPS)
@query("strip_aspect_all", _STRIPS)
def strip_aspect_all(spark, sf):
    """All frames of each action."""
    a = X.packed(spark, sf).groupBy("action").agg(F.count("*").alias("n"))
    return a.withColumn("aspect", strip_shape(F.col("n")))


@query("strip_aspect_orders", f"WITH a AS (SELECT l_orderkey AS id, count(*) AS n FROM lineitem GROUP BY l_orderkey) SELECT id, n, {_SHAPE} AS aspect FROM a")
def strip_aspect_orders(spark, sf):
    """Short strips: an order's lines as the frames of a strip."""
    a = X.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("n"))
    return a.withColumn("aspect", strip_shape(F.col("n")))
