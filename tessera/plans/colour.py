"""Queries on colours of single pixels and of palettes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import colour as C
from tessera.functions.numbers import byte, byte_sql, half_up, half_up_sql
from tessera.plans import fixtures as X
from tessera.plans.registry import query
from tessera.plans.stencils import let

RGB = tuple("rgb")


def rgb():
    return [F.col(c) for c in RGB]


KEYS = ("#ff00ff", "#00ff00", "#0000ff", "#00ffff", "#ffff00")


def _lab_query(kind):
    def run(spark, sf):
        v = C.lab(*rgb(), kind)
        return X.pixels(spark, sf).select("image_id", "i", *(half_up(v[c], 4).alias(n) for c, n in (("L", "lab_l"), ("a", "lab_a"), ("b", "lab_b"))))

    return run


def _lab_sql(kind):
    return f"WITH {X.PIXELS}, v AS (SELECT image_id, i, {C.lab_sql('r', 'g', 'b', kind)} AS v FROM pix) SELECT image_id, i, " + ", ".join(f"{half_up_sql(f'v.{c}', 4)} AS {n}" for c, n in (("L", "lab_l"), ("a", "lab_a"), ("b", "lab_b"))) + " FROM v"


query("lab_pixels", _lab_sql(C.COARSE))(_lab_query(C.COARSE))
query("to_lab", _lab_sql(C.EXACT))(_lab_query(C.EXACT))


@query("delta_e76", f"WITH {X.PIXELS}, {X.PALETTE_SQL}, v AS (SELECT image_id, i, {C.lab_sql('r', 'g', 'b')} AS v FROM pix), w AS (SELECT hex, {C.lab_sql('pr', 'pg', 'pb')} AS w FROM pal) SELECT image_id, i, hex, {half_up_sql(C.distance_sql('v', 'w'), 3)} AS de FROM v, w")
def delta_e76(spark, sf):
    pal = X.palette(spark).select("hex", C.lab(*(F.col(c) for c in ("pr", "pg", "pb"))).alias("w"))
    # A palette is a constant of a few colours: an array of it in the plan, no join.
    some = F.array(*(F.struct(F.lit(r["hex"]).alias("hex"), F.struct(*(F.lit(r["w"][c]).alias(c) for c in ("L", "a", "b"))).alias("w")) for r in pal.collect()))
    p = X.pixels(spark, sf).select("image_id", "i", C.lab(*rgb()).alias("v"), some.alias("cs")).select("image_id", "i", "v", F.explode("cs").alias("c"))
    return p.select("image_id", "i", "c.hex", half_up(C.distance(F.col("v"), F.col("c.w")), 3).alias("de"))


@query(
    "delta_e2000",
    f"""WITH {X.PIXELS}, v AS (SELECT image_id, i, x, y, {C.lab_sql('r', 'g', 'b', C.EXACT)} AS v FROM pix),
    q AS (SELECT p.image_id, p.i, p.v.L AS l1, p.v.a AS a1, p.v.b AS b1, n.v.L AS l2, n.v.a AS a2, n.v.b AS b2 FROM v p JOIN v n ON p.image_id = n.image_id AND n.y = p.y AND n.x = p.x + 1),
    c AS (SELECT *, sqrt(a1*a1+b1*b1) AS c1, sqrt(a2*a2+b2*b2) AS c2 FROM q),
    k AS (SELECT *, 1 + 0.5 * (1 - sqrt(pow((c1+c2)/2, 7) / (pow((c1+c2)/2, 7) + pow(25.0::DOUBLE, 7)))) AS k FROM c),
    m AS (SELECT *, sqrt(pow(a1*k, 2) + b1*b1) AS m1, sqrt(pow(a2*k, 2) + b2*b2) AS m2,
      CASE WHEN a1*k = 0 AND b1 = 0 THEN 0 WHEN atan2(b1, a1*k) >= 0 THEN degrees(atan2(b1, a1*k)) ELSE degrees(atan2(b1, a1*k)) + 360 END AS h1,
      CASE WHEN a2*k = 0 AND b2 = 0 THEN 0 WHEN atan2(b2, a2*k) >= 0 THEN degrees(atan2(b2, a2*k)) ELSE degrees(atan2(b2, a2*k)) + 360 END AS h2 FROM k),
    d AS (SELECT *, CASE WHEN m1*m2 = 0 THEN 0 WHEN h2-h1 > 180 THEN h2-h1-360 WHEN h2-h1 < -180 THEN h2-h1+360 ELSE h2-h1 END AS dh,
      CASE WHEN m1*m2 = 0 THEN h1+h2 WHEN abs(h1-h2) <= 180 THEN (h1+h2)/2 WHEN h1+h2 < 360 THEN (h1+h2+360)/2 ELSE (h1+h2-360)/2 END AS hm, (m1+m2)/2 AS cm, (l1+l2)/2 - 50 AS o FROM m),
    t AS (SELECT *, 1 - 0.17*cos(radians(hm-30)) + 0.24*cos(radians(2*hm)) + 0.32*cos(radians(3*hm+6)) - 0.2*cos(radians(4*hm-63)) AS t, 2*sqrt(m1*m2)*sin(radians(dh)/2) AS dhh,
      30*exp(-pow((hm-275)/25, 2)) AS th, 2*sqrt(pow(cm, 7)/(pow(cm, 7)+pow(25.0::DOUBLE, 7))) AS rc FROM d),
    f AS (SELECT image_id, i, (l2-l1)/(1 + 0.015*o*o/sqrt(20+o*o)) AS x, (m2-m1)/(1+0.045*cm) AS y, dhh/(1+0.015*cm*t) AS z, -sin(2*radians(th))*rc AS rt FROM t)
    SELECT image_id, i, {half_up_sql('sqrt(x*x+y*y+z*z+rt*y*z)', 3)} AS de FROM f""",
)
def delta_e2000(spark, sf):
    """Of each pixel and its right neighbour; both are in the same row, so the image's array is zipped, not joined."""
    p = X.packed(spark, sf)
    right = F.filter(F.sequence(F.lit(0), F.lit(14)), lambda i: i % 4 != 3)
    at = lambda i: [F.get(F.col("data"), i * 4 + k) for k in range(3)]
    d = p.select("image_id", "data", F.explode(right).alias("i"))
    d = d.select("image_id", F.col("i").cast("long").alias("i"), C.lab(*at(F.col("i")), C.EXACT).alias("v"), C.lab(*at(F.col("i") + 1), C.EXACT).alias("w"))
    return d.select("image_id", "i", half_up(C.ciede2000(F.col("v"), F.col("w")), 3).alias("de"))


@query("chroma", f"WITH {X.PIXELS}, v AS (SELECT image_id, i, {C.lab_sql('r', 'g', 'b', C.EXACT)} AS v FROM pix) SELECT image_id, i, {half_up_sql('sqrt(v.a * v.a + v.b * v.b)', 4)} AS chroma FROM v")
def chroma(spark, sf):
    v = C.lab(*rgb(), C.EXACT)
    return X.pixels(spark, sf).select("image_id", "i", half_up(F.hypot(v["a"], v["b"]), 4).alias("chroma"))


def _seen_sql():
    parts = []
    for kind, m in C.VISION.items():
        lin = [C.linear_sql(c) for c in "rgb"]
        out = []
        for row, n in zip(m, "rgb", strict=True):
            c = f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, {lin[0]} * {row[0]} + {lin[1]} * {row[1]} + {lin[2]} * {row[2]}))"
            out.append(f"CAST(floor((CASE WHEN {c} <= 0.0031308 THEN {c} * 12.92 ELSE pow({c}, 1 / 2.4::DOUBLE) * 1.055 - 0.055 END) * 255 + 0.5) AS BIGINT) AS {n}")
        parts.append(f"SELECT image_id, i, '{kind}' AS kind, {', '.join(out)} FROM pix")
    return f"WITH {X.PIXELS} " + " UNION ALL ".join(parts)


@query("simulate_vision", _seen_sql())
def simulate_vision(spark, sf):
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), *(c.alias(n) for c, n in zip(C.seen_as(*rgb(), k), "rgb", strict=True))) for k in C.VISION))
    return X.pixels(spark, sf).select("image_id", "i", F.explode(kinds).alias("s")).select("image_id", "i", "s.*")


@query("luminance", f"WITH {X.PIXELS} SELECT image_id, i, {half_up_sql(C.luminance_sql('r', 'g', 'b'), 6)} AS luminance FROM pix")
def luminance(spark, sf):
    return X.pixels(spark, sf).select("image_id", "i", half_up(C.luminance(*rgb()), 6).alias("luminance"))


@query("contrast_matrix", f"WITH {X.PALETTE_SQL}, l AS (SELECT hex, {C.luminance_sql('pr', 'pg', 'pb')} AS l FROM pal) SELECT p.hex AS fg, q.hex AS bg, {half_up_sql('(greatest(p.l, q.l) + 0.05) / (least(p.l, q.l) + 0.05)', 4)} AS ratio FROM l p, l q")
def contrast_matrix(spark, sf):
    l = X.palette(spark).select("hex", C.luminance(*(F.col(c) for c in ("pr", "pg", "pb"))).alias("l"))
    both = l.select(F.col("hex").alias("fg"), F.col("l").alias("lf")).crossJoin(F.broadcast(l.select(F.col("hex").alias("bg"), F.col("l").alias("lb"))))
    return both.select("fg", "bg", half_up(C.contrast(F.col("lf"), F.col("lb")), 4).alias("ratio"))


@query("hex_of_pixels", f"WITH {X.PIXELS} SELECT image_id, i, {C.hex_sql('r', 'g', 'b')} AS hex FROM pix")
def hex_of_pixels(spark, sf):
    return X.pixels(spark, sf).select("image_id", "i", C.to_hex(*rgb()).alias("hex"))


#: Rec. 709 weights on the bytes themselves.
def _grey709(r, g, b):
    return byte(r * 0.2126 + g * 0.7152 + b * 0.0722)


@query("grey_of", f"WITH {X.PIXELS} SELECT image_id, i, {byte_sql('r * 0.2126::DOUBLE + g * 0.7152::DOUBLE + b * 0.0722::DOUBLE')} AS grey, a FROM pix")
def grey_of(spark, sf):
    return X.pixels(spark, sf).select("image_id", "i", _grey709(*rgb()).alias("grey"), "a")


@query("silhouette_of", f"WITH {X.PIXELS} SELECT image_id, i, CASE WHEN a > 0 THEN 29 ELSE 0 END AS r, CASE WHEN a > 0 THEN 53 ELSE 0 END AS g, CASE WHEN a > 0 THEN 87 ELSE 0 END AS b, a FROM pix")
def silhouette_of(spark, sf):
    one = [F.when(F.col("a") > 0, v).otherwise(0).alias(n) for v, n in zip((29, 53, 87), "rgb", strict=True)]
    return X.pixels(spark, sf).select("image_id", "i", *one, "a")


@query("harden_alpha", f"WITH {X.PIXELS} SELECT image_id, i, " + ", ".join(f"CASE WHEN a >= 128 THEN {v} ELSE 0 END AS {n}" for v, n in (("r", "r"), ("g", "g"), ("b", "b"), ("255", "a"))) + " FROM pix")
def harden_alpha(spark, sf):
    on = F.col("a") >= 128
    return X.pixels(spark, sf).select("image_id", "i", *(F.when(on, F.col(c)).otherwise(0).alias(c) for c in "rgb"), F.when(on, 255).otherwise(0).alias("a"))


@query("flatten", f"WITH {X.PIXELS} SELECT image_id, i, " + ", ".join(byte_sql(f"{c} * (a / 255.0::DOUBLE) + {v} * (1 - a / 255.0::DOUBLE)") + f" AS {c}" for c, v in zip("rgb", (244, 233, 241), strict=True)) + ", CAST(255 AS BIGINT) AS a FROM pix")
def flatten(spark, sf):
    k = F.col("a") / 255.0
    return X.pixels(spark, sf).select("image_id", "i", *(byte(F.col(c) * k + v * (1 - k)).alias(c) for c, v in zip("rgb", (244, 233, 241), strict=True)), F.lit(255).cast("long").alias("a"))


def _over_sql():
    k, j = "(t.a / 255.0::DOUBLE)", "(u.a / 255.0::DOUBLE)"
    out = f"({k} + {j} * (1 - {k}))"
    cols = ", ".join(f"CASE WHEN {out} = 0 THEN 0 ELSE {byte_sql(f'(t.{c} * {k} + u.{c} * {j} * (1 - {k})) / {out}')} END AS {c}" for c in "rgb")
    return f"WITH {X.PIXELS}, {X.FRAMES}, n AS (SELECT p.*, f.frame_ix FROM pix p JOIN frm f USING (image_id)) SELECT t.image_id, t.i, {cols}, {byte_sql(out + ' * 255')} AS a FROM n t JOIN n u ON t.action = u.action AND t.frame_ix = u.frame_ix + 1 AND t.i = u.i"


@query("over", _over_sql())
def over(spark, sf):
    """Each frame over the one before it: whole pictures are paired, then zipped sample by sample."""
    p = X.in_sequence(X.packed(spark, sf), "data").where("low is not null")
    d = p.select("image_id", "data", "low", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("i"))
    t, u = ({c: F.get(F.col(n), F.col("i") * 4 + k) for k, c in enumerate("rgba")} for n in ("data", "low"))
    k, j = t["a"] / 255.0, u["a"] / 255.0
    out = k + j * (1 - k)
    return d.select("image_id", F.col("i").cast("long").alias("i"), *(F.when(out == 0, 0).otherwise(byte((t[c] * k + u[c] * j * (1 - k)) / out)).alias(c) for c in "rgb"), byte(out * 255).alias("a"))


def _keys_sql():
    vals = ", ".join(f"({i}, '{h}', {int(h[1:3], 16)}, {int(h[3:5], 16)}, {int(h[5:], 16)})" for i, h in enumerate(KEYS))
    return f"""WITH {X.PALETTE_SQL}, k(ord, hex, kr, kg, kb) AS (VALUES {vals}), p AS (SELECT {C.lab_sql('pr', 'pg', 'pb')} AS v FROM pal), q AS (SELECT ord, hex, {C.lab_sql('kr', 'kg', 'kb')} AS w FROM k),
    g AS (SELECT ord, hex, min({C.distance_sql('v', 'w')}) AS gap FROM p, q GROUP BY ord, hex)
    SELECT hex, {half_up_sql('gap', 3)} AS gap FROM g ORDER BY gap DESC, ord LIMIT 1"""


@query("choose_key", _keys_sql())
def choose_key(spark, sf):
    """The candidate farthest from its nearest palette colour; the first of equals."""
    p = X.palette(spark).select(C.lab(*(F.col(c) for c in ("pr", "pg", "pb"))).alias("v"))
    k = X.palette(spark, KEYS).select("ord", "hex", C.lab(*(F.col(c) for c in ("pr", "pg", "pb"))).alias("w"))
    g = k.crossJoin(F.broadcast(p)).groupBy("ord", "hex").agg(F.min(C.distance(F.col("v"), F.col("w"))).alias("gap"))
    return g.orderBy(F.desc("gap"), "ord").limit(1).select("hex", half_up(F.col("gap"), 3).alias("gap"))


_MEAN = f"m AS (SELECT image_id, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM pix WHERE a >= 128 GROUP BY image_id), ml AS (SELECT image_id, {C.luminance_sql('r', 'g', 'b')} AS ml FROM m)"


@query(
    "choose_background",
    f"""WITH {X.PIXELS}, {X.PALETTE_SQL}, {_MEAN}, c AS (SELECT ord, hex, pr, pg, pb FROM pal UNION ALL VALUES (6, '#ffffff', 255, 255, 255), (7, '#0b0b0f', 11, 11, 15)),
    r AS (SELECT image_id, ord, hex, (greatest(ml, l) + 0.05) / (least(ml, l) + 0.05) AS ratio FROM ml, (SELECT ord, hex, {C.luminance_sql('pr', 'pg', 'pb')} AS l FROM c))
    SELECT image_id, coalesce(arg_min(hex, ord) FILTER (ratio >= 3 AND ord < 6), arg_min(hex, [-ratio, ord])) AS background FROM r GROUP BY image_id""",
)
def choose_background(spark, sf):
    """The first palette colour with a contrast of 3 to the mark's mean colour, else the best of all and two neutrals."""
    m = X.pixels(spark, sf).where("a >= 128").groupBy("image_id").agg(*(F.avg(c).alias(c) for c in "rgb"))
    rows = X.palette(spark, (*X.PALETTE, "#ffffff", "#0b0b0f")).select("ord", "hex", C.luminance(*(F.col(c) for c in ("pr", "pg", "pb"))).alias("l")).collect()
    some = F.array(*(F.struct(F.lit(r["ord"]).alias("ord"), F.lit(r["hex"]).alias("hex"), F.lit(r["l"]).alias("l")) for r in rows))
    ml = C.luminance(*rgb())
    d = m.select("image_id", F.transform(some, lambda c: F.struct(c["ord"].alias("ord"), c["hex"].alias("hex"), C.contrast(ml, c["l"]).alias("ratio"))).alias("cs"))
    good = F.get(F.filter("cs", lambda c: (c["ratio"] >= 3) & (c["ord"] < len(X.PALETTE))), F.lit(0))["hex"]
    best = F.array_min(F.transform("cs", lambda c: F.struct((-c["ratio"]).alias("k"), c["ord"].alias("ord"), c["hex"].alias("hex"))))["hex"]
    return d.select("image_id", F.coalesce(good, best).alias("background"))


TOLERANCE = 30.0
_KEY_LAB = f"{C.lab_sql('255', '0', '255')}"


@query(
    "chroma_key",
    f"""WITH {X.PIXELS}, v AS (SELECT *, {C.lab_sql('r', 'g', 'b')} AS lv, {_KEY_LAB} AS lk FROM pix), d AS (SELECT *, {C.distance_sql('lv', 'lk')} AS de FROM v),
    s AS (SELECT image_id, i, r, g, b, CASE WHEN de <= 80 THEN 0 WHEN de >= 160 THEN 255 ELSE CAST(floor(255 * (de - 80) / 80 + 0.5) AS BIGINT) END AS a FROM d)
    SELECT image_id, i, a, """
    + ", ".join(f"CASE WHEN a = 0 THEN 0 WHEN a < 255 THEN {byte_sql(f'({c} - {k} * (1 - a / 255.0::DOUBLE)) / (a / 255.0::DOUBLE)')} ELSE {c} END AS {c}" for c, k in zip("rgb", (255, 0, 255), strict=True))
    + " FROM s",
)
def chroma_key(spark, sf, tolerance: float = 80.0):
    """Alpha 0 up to the tolerance, 255 from twice it, a ramp between with the key's share taken out of the colour."""
    key = F.struct(*(F.lit(v).alias(c) for c, v in zip(("L", "a", "b"), _magenta(spark), strict=True)))
    d = X.pixels(spark, sf).drop("a").withColumn("de", C.distance(C.lab(*rgb()), key))
    a = F.when(F.col("de") <= tolerance, 0).when(F.col("de") >= 2 * tolerance, 255).otherwise(F.floor((F.col("de") - tolerance) * 255 / tolerance + 0.5)).cast("long")
    d = d.withColumn("a", a)
    k = F.col("a") / 255.0
    un = lambda c, v: F.when(F.col("a") == 0, 0).when(F.col("a") < 255, byte((F.col(c) - v * (1 - k)) / k)).otherwise(F.col(c))
    return d.select("image_id", "i", "a", *(un(c, v).alias(c) for c, v in zip("rgb", (255, 0, 255), strict=True)))


def _magenta(spark):
    r = spark.range(1).select(C.lab(*(F.lit(v).cast("long") for v in (255, 0, 255))).alias("k")).first()["k"]
    return r["L"], r["a"], r["b"]


@query(
    "nearest_palette",
    f"""WITH {X.PIXELS}, {X.PALETTE_SQL}, v AS (SELECT DISTINCT r, g, b, {C.lab_sql('r', 'g', 'b')} AS lv FROM pix WHERE a >= 128), w AS (SELECT ord, hex, {C.lab_sql('pr', 'pg', 'pb')} AS lw FROM pal),
    d AS (SELECT r, g, b, ord, hex, {C.distance_sql('lv', 'lw')} AS de FROM v, w) SELECT r, g, b, arg_min(hex, [de, ord]) AS hex, {half_up_sql('min(de)', 3)} AS de FROM d GROUP BY r, g, b""",
)
def nearest_palette(spark, sf):
    """The nearest palette colour of each distinct opaque colour, the first of equals."""
    d = X.pixels(spark, sf).where("a >= 128").select("r", "g", "b").distinct()
    best = _nearest(spark)
    return d.withColumn("best", best).select("r", "g", "b", F.col("best.hex").alias("hex"), half_up(F.col("best.de"), 3).alias("de"))


def _nearest(spark):
    rows = X.palette(spark).select("ord", "hex", C.lab(*(F.col(c) for c in ("pr", "pg", "pb"))).alias("w")).collect()
    some = F.array(*(F.struct(F.lit(r["ord"]).alias("ord"), F.lit(r["hex"]).alias("hex"), *(F.lit(r["w"][c]).alias(c) for c in ("L", "a", "b"))) for r in rows))
    near = lambda v: F.array_min(F.transform(some, lambda w: F.struct(C.distance(v, w).alias("de"), w["ord"].alias("ord"), w["hex"].alias("hex"))))
    return let(C.lab(*rgb()), near)


@query(
    "quantize_drift",
    f"""WITH {X.PIXELS}, {X.PALETTE_SQL}, v AS (SELECT image_id, i, {C.lab_sql('r', 'g', 'b')} AS v FROM pix WHERE a >= 128), w AS (SELECT {C.lab_sql('pr', 'pg', 'pb')} AS w FROM pal),
    d AS (SELECT image_id, i, min({C.distance_sql('v', 'w')}) AS de FROM v, w GROUP BY image_id, i)
    SELECT image_id, count(*) AS mapped, {half_up_sql('sum(de) / count(*)', 2)} AS drift_mean, {half_up_sql('max(de)', 2)} AS drift_max FROM d GROUP BY image_id""",
)
def quantize_drift(spark, sf):
    d = X.pixels(spark, sf).where("a >= 128").withColumn("de", _nearest(spark)["de"])
    return d.groupBy("image_id").agg(F.count("*").alias("mapped"), half_up(F.sum("de") / F.count("*"), 2).alias("drift_mean"), half_up(F.max("de"), 2).alias("drift_max"))
