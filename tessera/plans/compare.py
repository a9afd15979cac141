"""Queries that compare pictures: frames with their neighbours in an action."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import colour as C
from tessera.functions.numbers import half_up, half_up_sql
from tessera.plans import fixtures as X
from tessera.plans.registry import query

_PAIRS = f"{X.PIXELS}, {X.FRAMES}, n AS (SELECT p.*, f.frame_ix FROM pix p JOIN frm f USING (image_id)), two AS (SELECT t.image_id, t.action, t.frame_ix, t.i, t.x, t.y, t.r, t.g, t.b, t.a, u.r AS r2, u.g AS g2, u.b AS b2, u.a AS a2 FROM n t JOIN n u ON t.action = u.action AND t.frame_ix = u.frame_ix + 1 AND t.i = u.i)"


def sixteen():
    return F.sequence(F.lit(0), F.lit(15))


def neighbours(spark, sf):
    """(image_id, action, frame_ix, data, low): each frame's bytes and those of the one before; whole pictures are moved."""
    return X.in_sequence(X.packed(spark, sf), "data").where("low is not null")


def _at(name: str, p, k: int):
    return F.get(name, p * 4 + k)


def _count(test):
    return F.size(F.filter(sixteen(), test)).cast("long")


@query("iou_prev", f"WITH {_PAIRS} SELECT image_id, {half_up_sql('CASE WHEN count(*) FILTER (a >= 128 OR a2 >= 128) = 0 THEN 0 ELSE count(*) FILTER (a >= 128 AND a2 >= 128) / CAST(count(*) FILTER (a >= 128 OR a2 >= 128) AS DOUBLE) END', 3)} AS iou FROM two GROUP BY image_id")
def iou_prev(spark, sf):
    on = lambda n, p: _at(n, p, 3) >= 128
    both, either = _count(lambda p: on("data", p) & on("low", p)), _count(lambda p: on("data", p) | on("low", p))
    return neighbours(spark, sf).select("image_id", half_up(F.when(either == 0, 0.0).otherwise(both / either), 3).alias("iou"))


@query("frame_delta", f"WITH {_PAIRS} SELECT image_id, {half_up_sql('sum(abs(r - r2) + abs(g - g2) + abs(b - b2) + abs(a - a2)) / (64 * 255.0::DOUBLE)', 4)} AS delta FROM two GROUP BY image_id")
def frame_delta(spark, sf):
    total = F.aggregate(F.zip_with("data", "low", lambda p, q: F.abs(p - q)), F.lit(0).cast("long"), lambda acc, v: acc + v)
    return neighbours(spark, sf).select("image_id", half_up(total / (64 * 255.0), 4).alias("delta"))


@query("edit_facts", f"WITH {_PAIRS} SELECT image_id, {half_up_sql('count(*) FILTER (greatest(abs(r - r2), abs(g - g2), abs(b - b2), abs(a - a2)) > 32) / CAST(count(*) AS DOUBLE)', 3)} AS moved FROM two GROUP BY image_id")
def edit_facts(spark, sf):
    moved = _count(lambda p: F.greatest(*(F.abs(_at("data", p, k) - _at("low", p, k)) for k in range(4))) > 32)
    return neighbours(spark, sf).select("image_id", half_up(moved / 16, 3).alias("moved"))


_PRE = "greatest(" + ", ".join(f"abs({c} * a / 255.0::DOUBLE - {c}2 * a2 / 255.0::DOUBLE)" for c in "rgb") + ", abs(a - a2))"


@query("frame_diff", f"WITH {_PAIRS} SELECT image_id, {half_up_sql(f'max({_PRE})', 3)} AS worst, {half_up_sql(f'count(*) FILTER ({_PRE} > 8) / CAST(count(*) AS DOUBLE)', 4)} AS share FROM two GROUP BY image_id")
def frame_diff(spark, sf):
    """The largest difference of premultiplied channels, and the share of pixels past 8."""
    pre = lambda n, p, k: _at(n, p, k) * _at(n, p, 3) / 255.0
    diff = lambda p: F.greatest(*(F.abs(pre("data", p, k) - pre("low", p, k)) for k in range(3)), F.abs(_at("data", p, 3) - _at("low", p, 3)).cast("double"))
    d = neighbours(spark, sf).select("image_id", F.transform(sixteen(), diff).alias("d"))
    return d.select("image_id", half_up(F.array_max("d"), 3).alias("worst"), half_up(F.size(F.filter("d", lambda v: v > 8)) / 16, 4).alias("share"))


@query(
    "fidelity",
    f"""WITH {_PAIRS}, l AS (SELECT *, {C.lab_sql('r', 'g', 'b')} AS lv, {C.lab_sql('r2', 'g2', 'b2')} AS lw FROM two), d AS (SELECT *, {C.distance_sql('lv', 'lw')} AS de FROM l WHERE a >= 128 AND a2 >= 128)
    SELECT image_id, count(*) AS both, {half_up_sql('count(*) FILTER (de <= 15) / CAST(count(*) AS DOUBLE)', 4)} AS kept, {half_up_sql('sum(de) / count(*)', 2)} AS drift FROM d GROUP BY image_id""",
)
def fidelity(spark, sf):
    """Of pixels that are opaque in both: the share within 15 of its colour, and the mean difference."""
    d = neighbours(spark, sf).select("image_id", "data", "low", F.explode(sixteen()).alias("p")).where((_at("data", F.col("p"), 3) >= 128) & (_at("low", F.col("p"), 3) >= 128))
    v, w = (C.lab(*(_at(n, F.col("p"), k) for k in range(3))) for n in ("data", "low"))
    d = d.select("image_id", v.alias("v"), w.alias("w")).select("image_id", C.distance(F.col("v"), F.col("w")).alias("de"))
    return d.groupBy("image_id").agg(F.count("*").alias("both"), half_up(F.count_if(F.col("de") <= 15) / F.count("*"), 4).alias("kept"), half_up(F.sum("de") / F.count("*"), 2).alias("drift"))


@query(
    "smoothness",
    f"WITH {_PAIRS}, q AS (SELECT action, frame_ix, CASE WHEN count(*) FILTER (a >= 128 OR a2 >= 128) = 0 THEN 0 ELSE count(*) FILTER (a >= 128 AND a2 >= 128) / CAST(count(*) FILTER (a >= 128 OR a2 >= 128) AS DOUBLE) END AS iou FROM two GROUP BY action, frame_ix) SELECT action, count(*) AS steps, count(*) FILTER (iou < 0.45) AS jumps, {half_up_sql('min(iou)', 3)} AS worst, {half_up_sql('sum(iou) / count(*)', 3)} AS mean FROM q GROUP BY action",
)
def smoothness(spark, sf):
    on = lambda n, p: _at(n, p, 3) >= 128
    both, either = _count(lambda p: on("data", p) & on("low", p)), _count(lambda p: on("data", p) | on("low", p))
    d = neighbours(spark, sf).select("action", F.when(either == 0, 0.0).otherwise(both / either).alias("iou"))
    return d.groupBy("action").agg(F.count("*").alias("steps"), F.count_if(F.col("iou") < 0.45).alias("jumps"), half_up(F.min("iou"), 3).alias("worst"), half_up(F.sum("iou") / F.count("*"), 3).alias("mean"))


@query(
    "action_measure",
    f"""WITH {X.PIXELS}, {X.FRAMES}, h AS (SELECT f.action, f.frame_ix, coalesce(max(y) FILTER (a >= 160) - min(y) FILTER (a >= 160) + 1, 0) AS h FROM pix p JOIN frm f USING (image_id) GROUP BY f.action, f.frame_ix),
    m AS (SELECT action, list_sort(list(h) FILTER (h > 0))[count(*) FILTER (h > 0) // 2 + 1] AS mid FROM h GROUP BY action)
    SELECT action, frame_ix, h AS height, CASE WHEN h > 0 THEN {half_up_sql('h / CAST(mid AS DOUBLE)', 3)} END AS height_ratio, CASE WHEN h = 0 THEN 'empty' WHEN abs({half_up_sql('h / CAST(mid AS DOUBLE)', 3)} - 1) > 0.15 THEN 'size' ELSE '' END AS flag FROM h JOIN m USING (action)""",
)
def action_measure(spark, sf):
    """Each frame's height against the upper median of its action's, which a percentile of the sorted counts gives in two steps."""
    y = F.when(F.col("a") >= 160, F.col("y"))
    h = X.pixels(spark, sf).groupBy("action", "image_id").agg(F.coalesce(F.max(y) - F.min(y) + 1, F.lit(0)).alias("height"))
    h = X.in_sequence(h)
    # Heights are few, so their counts are: the median comes from those, not from a list of an action's frames.
    n = h.where("height > 0").groupBy("action", "height").agg(F.count("*").alias("n"))
    w = Window.partitionBy("action")
    n = n.withColumn("upto", F.sum("n").over(w.orderBy("height").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(w))
    mid = n.where(F.col("upto") > F.floor(F.col("all") / 2)).groupBy("action").agg(F.min("height").alias("mid"))
    ratio = half_up(F.col("height") / F.col("mid"), 3)
    flag = F.when(F.col("height") == 0, "empty").when(F.abs(ratio - 1) > 0.15, "size").otherwise("")
    return h.join(mid, "action").select("action", "frame_ix", "height", F.when(F.col("height") > 0, ratio).alias("height_ratio"), flag.alias("flag"))


@query(
    "banding",
    f"""WITH {_PAIRS}, l AS (SELECT *, 0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b AS l, 0.299::DOUBLE * r2 + 0.587::DOUBLE * g2 + 0.114::DOUBLE * b2 AS m FROM two),
    s AS (SELECT p.image_id, p.i, max(abs(p.l - q.l)) AS dl, max(abs(p.m - q.m)) AS dm FROM l p JOIN l q ON p.image_id = q.image_id AND abs(p.x - q.x) + abs(p.y - q.y) = 1 WHERE p.x BETWEEN 1 AND 2 AND p.y BETWEEN 1 AND 2 GROUP BY p.image_id, p.i)
    SELECT image_id, {half_up_sql('count(*) FILTER (dl > 40 AND dm < 90) / CAST(count(*) AS DOUBLE)', 3)} AS banding FROM s GROUP BY image_id""",
)
def banding(spark, sf, step: float = 40.0, calm: float = 90.0):
    """Interior pixels that step where the other picture is calm, by the largest of four neighbour differences."""
    d = neighbours(spark, sf).select("image_id", *(F.transform(sixteen(), _luma_of(n)).alias(n) for n in ("data", "low")))
    inner = F.array(*map(F.lit, (5, 6, 9, 10)))
    worst = lambda n, p: F.greatest(*(F.abs(F.get(n, p) - F.get(n, p + o)) for o in (-1, 1, -4, 4)))
    hit = F.size(F.filter(inner, lambda p: (worst("data", p) > step) & (worst("low", p) < calm)))
    return d.select("image_id", half_up(hit / 4, 3).alias("banding"))


def _luma_of(name: str):
    return lambda p: C.luma(*(_at(name, p, k) for k in range(3)))
