"""Queries on time: easings, keyframes, frame times, variation coordinates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions.numbers import half_up, half_up_sql
from tessera.plans import fixtures as X
from tessera.plans.registry import query

# The named cubic Beziers.
BEZIERS = {
    "linear": (0, 0, 1, 1), "ease": (0.25, 0.1, 0.25, 1), "ease-in": (0.42, 0, 1, 1), "ease-out": (0, 0, 0.58, 1), "ease-in-out": (0.42, 0, 0.58, 1),
    "fast-out-slow-in": (0.4, 0, 0.2, 1), "linear-out-slow-in": (0, 0, 0.2, 1), "fast-out-linear-in": (0.4, 0, 1, 1),
}


def _poly(p1, p2, s):
    return s * (1 - s) * (1 - s) * 3 * p1 + s * s * (1 - s) * 3 * p2 + s * s * s


def bezier(p, u, halvings: int = 60):
    """The progress at time u: x is increasing in s, so halving [0, 1] finds x(s) = u; all in the row."""
    zero = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))

    def step(acc, _):
        m = (acc["lo"] + acc["hi"]) / 2
        low = _poly(p["x1"], p["x2"], m) < u
        return F.struct(F.when(low, m).otherwise(acc["lo"]).alias("lo"), F.when(low, acc["hi"]).otherwise(m).alias("hi"))

    s = F.aggregate(F.sequence(F.lit(1), F.lit(halvings)), zero, step, lambda acc: (acc["lo"] + acc["hi"]) / 2)
    return F.when(u <= 0, 0.0).when(u >= 1, 1.0).otherwise(_poly(p["y1"], p["y2"], s))


@query(
    "easing_table",
    "WITH RECURSIVE e(name, x1, y1, x2, y2) AS (VALUES " + ", ".join(f"('{n}', {', '.join(f'{v}::DOUBLE' for v in p)})" for n, p in BEZIERS.items()) + """),
    s AS (SELECT name, x1, y1, x2, y2, k / 20.0::DOUBLE AS u, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, 0 AS n FROM e, (SELECT unnest(range(0, 21)) AS k)
      UNION ALL SELECT name, x1, y1, x2, y2, u, CASE WHEN 3*x1*m*(1-m)*(1-m) + 3*x2*m*m*(1-m) + m*m*m < u THEN m ELSE lo END, CASE WHEN 3*x1*m*(1-m)*(1-m) + 3*x2*m*m*(1-m) + m*m*m < u THEN hi ELSE m END, n + 1 FROM (SELECT *, (lo + hi) / 2 AS m FROM s WHERE n < 60) q)
    SELECT name, u, """ + half_up_sql("CASE WHEN u <= 0 THEN 0 WHEN u >= 1 THEN 1 ELSE 3*y1*((lo+hi)/2)*(1-(lo+hi)/2)*(1-(lo+hi)/2) + 3*y2*((lo+hi)/2)*((lo+hi)/2)*(1-(lo+hi)/2) + ((lo+hi)/2)*((lo+hi)/2)*((lo+hi)/2) END", 6) + " AS v FROM s WHERE n = 60",
)
def easing_table(spark, sf):
    rows = [(n, *map(float, p)) for n, p in BEZIERS.items()]
    e = spark.createDataFrame(rows, "name string, x1 double, y1 double, x2 double, y2 double")
    d = e.select("name", F.struct("x1", "y1", "x2", "y2").alias("p"), F.explode(F.sequence(F.lit(0), F.lit(20))).alias("k")).withColumn("u", F.col("k") / 20.0)
    return d.select("name", "u", half_up(bezier(F.col("p"), F.col("u")), 6).alias("v"))


def interpolators(t):
    """The framework interpolators at their default tensions."""
    over = lambda s, k: s * s * ((k + 1) * s + k)
    back = lambda s, k: s * s * ((k + 1) * s - k)
    s = t * 1.1226
    b = lambda v: v * v * 8
    return {
        "overshoot": over(t - 1, 2.0) + 1,
        "anticipate": back(t, 2.0),
        "anticipate-overshoot": F.when(t < 0.5, back(t * 2, 3.0) * 0.5).otherwise((over(t * 2 - 2, 3.0) + 2) * 0.5),
        "bounce": F.when(s < 0.3535, b(s)).when(s < 0.7408, b(s - 0.54719) + 0.7).when(s < 0.9644, b(s - 0.8526) + 0.9).otherwise(b(s - 1.0435) + 0.95),
        "accelerate": t * t,
        "decelerate": 1 - (1 - t) * (1 - t),
        "accelerate-cubic": t * t * t,
        "decelerate-cubic": 1 - (1 - t) * (1 - t) * (1 - t),
        "accelerate-decelerate": F.cos((t + 1) * 3.141592653589793) / 2 + 0.5,
    }


_INTER = {
    "overshoot": "(t-1)*(t-1)*(3*(t-1)+2)+1", "anticipate": "t*t*(3*t-2)", "anticipate-overshoot": "CASE WHEN t < 0.5 THEN 0.5*(4*t*t*(4*2*t-3)) ELSE 0.5*((2*t-2)*(2*t-2)*(4*(2*t-2)+3)+2) END",
    "bounce": "CASE WHEN t*1.1226 < 0.3535 THEN 8*pow(t*1.1226,2) WHEN t*1.1226 < 0.7408 THEN 8*pow(t*1.1226-0.54719,2)+0.7 WHEN t*1.1226 < 0.9644 THEN 8*pow(t*1.1226-0.8526,2)+0.9 ELSE 8*pow(t*1.1226-1.0435,2)+0.95 END",
    "accelerate": "t*t", "decelerate": "1-(1-t)*(1-t)", "accelerate-cubic": "t*t*t", "decelerate-cubic": "1-pow(1-t,3)", "accelerate-decelerate": "cos((t+1)*pi())/2+0.5",
}


@query("interpolator_table", "WITH g AS (SELECT k / 16.0::DOUBLE AS t FROM (SELECT unnest(range(0, 17)) AS k)) " + " UNION ALL ".join(f"SELECT '{n}' AS name, t, {half_up_sql(e, 6)} AS v FROM g" for n, e in _INTER.items()))
def interpolator_table(spark, sf):
    g = spark.range(0, 17).select((F.col("id") / 16.0).alias("t"))
    rows = F.array(*(F.struct(F.lit(n).alias("name"), half_up(v, 6).alias("v")) for n, v in interpolators(F.col("t")).items()))
    return g.select("t", F.inline(rows))


_SEG = "seg AS (SELECT action, frame_ix, image_id, frame_ix * 100 AS t0, frame_ix * 100 + 60 AS t1, image_id % 50 AS v0, (image_id * 7) % 90 AS v1 FROM frm)"


@query(
    "keyframe_lookup",
    f"""WITH {X.FRAMES}, {_SEG}, a AS (SELECT action, max(t1) AS stop FROM seg GROUP BY action), q AS (SELECT action, unnest(range(0, 41)) * (stop + 80) / 40.0::DOUBLE - 20 AS t FROM a),
    c AS (SELECT q.action, q.t, s.t0, s.t1, s.v0, s.v1 FROM q ASOF LEFT JOIN seg s ON q.action = s.action AND q.t >= s.t0),
    f AS (SELECT action, arg_min(v0, t0) AS v FROM seg GROUP BY action)
    SELECT c.action, c.t, {half_up_sql('CASE WHEN t0 IS NULL THEN f.v WHEN t >= t1 THEN v1 ELSE v0 + (v1 - v0) * ((t - t0) / (t1 - t0)) END', 4)} AS v FROM c JOIN f USING (action)""",
)
def keyframe_lookup(spark, sf):
    """The value of each track at sampled times: held before, between and after its segments.

    An as-of join as one window: samples and segments of a track in time order, the last segment carried on.
    """
    s = X.frames(spark, sf).select("action", (F.col("frame_ix") * 100).alias("t0"), (F.col("frame_ix") * 100 + 60).alias("t1"), (F.col("image_id") % 50).alias("v0"), (F.col("image_id") * 7 % 90).alias("v1"))
    stop = s.groupBy("action").agg(F.max("t1").alias("stop"), F.min_by("v0", "t0").alias("v_first"))
    q = stop.select("action", "v_first", "stop", F.explode(F.sequence(F.lit(0), F.lit(40))).alias("k")).select("action", "v_first", (F.col("k") * (F.col("stop") + 80) / 40.0 - 20).alias("t"))
    seg = F.struct("t0", "t1", "v0", "v1")
    both = s.select("action", F.col("t0").cast("double").alias("at"), F.lit(0).alias("kind"), seg.alias("seg"), F.lit(None).cast("bigint").alias("v_first")).unionByName(
        q.select("action", F.col("t").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("struct<t0:bigint,t1:bigint,v0:bigint,v1:bigint>").alias("seg"), "v_first")
    )
    w = Window.partitionBy("action").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    held = both.withColumn("seg", F.last("seg", ignorenulls=True).over(w)).where("kind = 1")
    t, g = F.col("at"), F.col("seg")
    v = F.when(g.isNull(), F.col("v_first")).when(t >= g["t1"], g["v1"]).otherwise(g["v0"] + (g["v1"] - g["v0"]) * ((t - g["t0"]) / (g["t1"] - g["t0"])))
    return held.select("action", t.alias("t"), half_up(v, 4).alias("v"))


@query("frame_times", "WITH p AS (SELECT d, f, greatest(1, CAST(floor(d * f / 1000.0::DOUBLE + 0.5) AS BIGINT)) AS n FROM (SELECT unnest(range(100, 2100, 250)) AS d), (SELECT unnest([12, 24, 30]) AS f)), k AS (SELECT d, f, n, unnest(range(0, n + 1)) AS k FROM p) SELECT d AS duration, CAST(f AS BIGINT) AS fps, k AS frame, " + half_up_sql("least(d, k * 1000 / CAST(f AS DOUBLE))", 4) + " AS ms FROM k")
def frame_times(spark, sf):
    d = spark.range(100, 2100, 250).select(F.col("id").alias("duration"), F.explode(F.array(*(F.lit(v).cast("long") for v in (12, 24, 30)))).alias("fps"))
    n = F.greatest(F.lit(1), F.floor(F.col("duration") * F.col("fps") / 1000.0 + 0.5))
    k = d.select("duration", "fps", F.explode(F.sequence(F.lit(0).cast("long"), n)).alias("frame"))
    return k.select("duration", "fps", "frame", half_up(F.least(F.col("duration"), F.col("frame") * 1000 / F.col("fps")), 4).alias("ms"))


@query(
    "group_matrix",
    "SELECT vec_id AS image_id, " + ", ".join(f"{half_up_sql(e, 4)} AS {n}" for n, e in (("a", "sx * cos(r)"), ("b", "sx * sin(r)"), ("c", "-sy * sin(r)"), ("d", "sy * cos(r)"), ("e", "tx + px - (sx * cos(r) * px - sy * sin(r) * py)"), ("f", "ty + py - (sx * sin(r) * px + sy * cos(r) * py)")))
    + " FROM (SELECT vec_id, radians(vec_id % 360) AS r, 1 + (vec_id % 5) / 4.0::DOUBLE AS sx, 1 + (vec_id % 3) / 2.0::DOUBLE AS sy, vec_id % 11 AS tx, vec_id % 13 AS ty, vec_id % 17 AS px, vec_id % 19 AS py FROM embeddings) q",
)
def group_matrix(spark, sf):
    """Translate to the pivot and offset, rotate, scale, translate back: the six numbers of the affine map."""
    i = F.col("image_id")
    r, sx, sy = F.radians(i % 360), 1 + i % 5 / 4.0, 1 + i % 3 / 2.0
    tx, ty, px, py = i % 11, i % 13, i % 17, i % 19
    a, b, c, d = sx * F.cos(r), sx * F.sin(r), -sy * F.sin(r), sy * F.cos(r)
    six = zip("abcdef", (a, b, c, d, tx + px - (a * px + c * py), ty + py - (b * px + d * py)), strict=True)
    return X.packed(spark, sf).select("image_id", *(half_up(v, 4).alias(n) for n, v in six))


@query(
    "axis_normalise",
    "WITH v AS (SELECT k, 100 + k * 10 AS val FROM (SELECT unnest(range(0, 91)) AS k)), c AS (SELECT k, least(900, greatest(200, val)) * 65536 AS u FROM v), n AS (SELECT k, CASE WHEN u < 400 * 65536 THEN -floor((400 * 65536 - u) * 65536.0::DOUBLE / (200 * 65536) + 0.5) WHEN u > 400 * 65536 THEN floor((u - 400 * 65536) * 65536.0::DOUBLE / (500 * 65536) + 0.5) ELSE 0 END AS n FROM c) SELECT k, floor((n + 2) / 4) / 16384 AS norm FROM n",
)
def axis_normalise(spark, sf, low: int = 200, default: int = 400, high: int = 900):
    """An axis value clamped, to 16.16 fixed point about its default, and rounded to 2.14."""
    v = F.least(F.lit(high), F.greatest(F.lit(low), F.col("id") * 10 + 100)) * 65536
    d = default * 65536
    n = F.when(v < d, -F.floor((d - v) * 65536.0 / (d - low * 65536) + 0.5)).when(v > d, F.floor((v - d) * 65536.0 / (high * 65536 - d) + 0.5)).otherwise(0)
    return spark.range(0, 91).select(F.col("id").alias("k"), (F.shiftright((n + 2).cast("long"), 2) / 16384.0).alias("norm"))


@query("region_scalar", "WITH v AS (SELECT a, b, (a - 10) / 10.0::DOUBLE AS x, (b - 10) / 10.0::DOUBLE AS y FROM (SELECT unnest(range(0, 21)) AS a), (SELECT unnest(range(0, 21)) AS b)) SELECT a, b, " + half_up_sql("(CASE WHEN x = 0.5 THEN 1 WHEN x <= 0 OR x >= 1 THEN 0 WHEN x < 0.5 THEN x / 0.5 ELSE (1 - x) / 0.5 END) * (CASE WHEN y = -1 THEN 1 WHEN y <= -1 OR y >= 0 THEN 0 ELSE (0 - y) / 1 END)", 6) + " AS scalar FROM v")
def region_scalar(spark, sf, region=((0.0, 0.5, 1.0), (-1.0, -1.0, 0.0))):
    """The tent product over axes; an axis that peaks at its default or is out of order has no say."""
    d = spark.range(0, 21).select(F.col("id").alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(20).cast("long"))).alias("b"))
    out = F.lit(1.0)
    for (start, peak, end), v in zip(region, ((F.col("a") - 10) / 10.0, (F.col("b") - 10) / 10.0), strict=True):
        if start > peak or peak > end or (start < 0 < end and peak) or not peak:
            continue
        up = (v - start) / (peak - start) if peak > start else F.lit(0.0)
        down = (end - v) / (end - peak) if end > peak else F.lit(0.0)
        out = out * F.when(v == peak, 1.0).when((v <= start) | (v >= end), 0.0).when(v < peak, up).otherwise(down)
    return d.select("a", "b", half_up(out, 6).alias("scalar"))
