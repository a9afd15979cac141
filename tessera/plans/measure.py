"""Queries that measure single pictures: bounds, colours, edges, texture."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import colour as C
from tessera.functions.numbers import half_up, half_up_sql, upper_median, upper_median_sql
from tessera.plans import fixtures as X
from tessera.plans.registry import query

_BOX = "min(x) AS x0, min(y) AS y0, max(x) - min(x) + 1 AS width, max(y) - min(y) + 1 AS height"


def box():
    return [F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") - F.min("x") + 1).alias("width"), (F.max("y") - F.min("y") + 1).alias("height")]


def bounds(pixels, least: int):
    """The box of alpha >= least of every picture; nulls for an empty one, which conditional aggregates give without a join."""
    on = F.when(F.col("a") >= least, F.lit(1))
    x, y = F.when(on == 1, F.col("x")), F.when(on == 1, F.col("y"))
    return pixels.groupBy("image_id").agg(F.min(x).alias("x0"), F.min(y).alias("y0"), (F.max(x) - F.min(x) + 1).alias("width"), (F.max(y) - F.min(y) + 1).alias("height"), F.count(on).alias("area"))


@query("alpha_bounds", f"WITH {X.PIXELS}, b AS (SELECT image_id, {_BOX}, count(*) AS area FROM pix WHERE a >= 128 GROUP BY image_id) SELECT e.vec_id AS image_id, x0, y0, width, height, coalesce(area, 0) AS area FROM embeddings e LEFT JOIN b ON b.image_id = e.vec_id")
def alpha_bounds(spark, sf):
    return bounds(X.pixels(spark, sf), 128)


@query("trim_bounds", f"WITH {X.PIXELS}, b AS (SELECT image_id, {_BOX} FROM pix WHERE a >= 200 GROUP BY image_id) SELECT e.vec_id AS image_id, x0, y0, width AS w, height AS h FROM embeddings e LEFT JOIN b ON b.image_id = e.vec_id")
def trim_bounds(spark, sf):
    return bounds(X.pixels(spark, sf), 200).select("image_id", "x0", "y0", F.col("width").alias("w"), F.col("height").alias("h"))


@query("color_count", f"WITH {X.PIXELS} SELECT image_id, count(DISTINCT r * 65536 + g * 256 + b) FILTER (a >= 128) AS colours FROM pix GROUP BY image_id")
def color_count(spark, sf):
    """Exact; a picture's samples are one row, so its distinct colours need no shuffle by colour."""
    d = X.packed(spark, sf)
    at = F.filter(F.sequence(F.lit(0), F.lit(60), F.lit(4)), lambda i: F.get("data", i + 3) >= 128)
    rgb = F.transform(at, lambda i: F.get("data", i) * 65536 + F.get("data", i + 1) * 256 + F.get("data", i + 2))
    return d.select("image_id", F.size(F.array_distinct(rgb)).cast("long").alias("colours"))


@query("exact_colours", f"WITH {X.PIXELS}, c AS (SELECT image_id, r, g, b, count(*) AS n, min(i) AS first FROM pix WHERE a >= 128 GROUP BY image_id, r, g, b) SELECT image_id, r, g, b, n, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, first) AS place FROM c")
def exact_colours(spark, sf):
    c = X.pixels(spark, sf).where("a >= 128").groupBy("image_id", "r", "g", "b").agg(F.count("*").alias("n"), F.min("i").alias("first"))
    w = Window.partitionBy("image_id").orderBy(F.desc("n"), "first")
    return c.select("image_id", "r", "g", "b", "n", F.row_number().over(w).cast("long").alias("place"))


_REGION = "bin AS (SELECT image_id, (r // 16) * 256 + (g // 16) * 16 + b // 16 AS k, count(*) AS n, avg(r) AS r, avg(g) AS g, avg(b) AS b, min(i) AS first FROM pix GROUP BY image_id, (r // 16) * 256 + (g // 16) * 16 + b // 16)"


def region(pixels):
    """Bins of 16 levels a channel: count and mean colour, with the first pixel for ties."""
    k = (F.shiftright("r", 4) * 256 + F.shiftright("g", 4) * 16 + F.shiftright("b", 4)).alias("k")
    return pixels.groupBy("image_id", k).agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in "rgb"), F.min("i").alias("first"))


@query("region_colors", f"WITH {X.PIXELS}, {_REGION} SELECT image_id, k, n, {half_up_sql('r', 4)} AS r, {half_up_sql('g', 4)} AS g, {half_up_sql('b', 4)} AS b, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, first) AS place FROM bin")
def region_colors(spark, sf):
    w = Window.partitionBy("image_id").orderBy(F.desc("n"), "first")
    return region(X.pixels(spark, sf)).select("image_id", "k", "n", *(half_up(F.col(c), 4).alias(c) for c in "rgb"), F.row_number().over(w).cast("long").alias("place"))


@query(
    "dominant_colors",
    f"""WITH {X.PIXELS}, {_REGION}, p AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, first) AS place, sum(n) OVER (PARTITION BY image_id) AS total FROM bin)
    SELECT image_id, place, {C.hex_sql(*(f'CAST(floor({c} + 0.5) AS BIGINT)' for c in 'rgb'))} AS hex, {half_up_sql('n / CAST(total AS DOUBLE)', 3)} AS share FROM p WHERE place <= 6""",
)
def dominant_colors(spark, sf, count: int = 6):
    every = Window.partitionBy("image_id")
    d = region(X.pixels(spark, sf)).withColumn("place", F.row_number().over(every.orderBy(F.desc("n"), "first")).cast("long")).withColumn("total", F.sum("n").over(every))
    return d.where(F.col("place") <= count).select("image_id", "place", C.to_hex(*(F.col(c) for c in "rgb")).alias("hex"), half_up(F.col("n") / F.col("total"), 3).alias("share"))


@query(
    "text_contrast",
    f"""WITH {X.PIXELS}, {_REGION}, l AS (SELECT *, {C.luminance_sql('r', 'g', 'b')} AS l, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, first) AS place, sum(n) OVER (PARTITION BY image_id) AS total FROM bin),
    bg AS (SELECT image_id, l AS bl, n AS bn FROM l WHERE place = 1), up AS (SELECT image_id, n AS un FROM l WHERE place = 2),
    c AS (SELECT l.image_id, l.place, total, bn, (greatest(l, bl) + 0.05) / (least(l, bl) + 0.05) AS ratio FROM l JOIN bg USING (image_id) JOIN up USING (image_id) WHERE place > 1 AND n >= greatest(1, total * 0.02, un * 0.15))
    SELECT image_id, {half_up_sql('max(ratio)', 2)} AS ratio, {half_up_sql('max(bn) / CAST(max(total) AS DOUBLE)', 2)} AS bg_share, max(bn) / CAST(max(total) AS DOUBLE) < 0.35 AS complex FROM c GROUP BY image_id HAVING max(ratio) >= 1.1""",
)
def text_contrast(spark, sf, floor: int = 1):
    """The background is the commonest colour, the text the best contrast among colours that cover enough."""
    every = Window.partitionBy("image_id")
    d = region(X.pixels(spark, sf)).withColumn("l", C.luminance(*(F.col(c) for c in "rgb"))).withColumn("place", F.row_number().over(every.orderBy(F.desc("n"), "first"))).withColumn("total", F.sum("n").over(every))
    pick = lambda p, c: F.max(F.when(F.col("place") == p, F.col(c))).over(every)
    d = d.withColumn("bl", pick(1, "l")).withColumn("bn", pick(1, "n")).withColumn("un", pick(2, "n"))
    d = d.where((F.col("place") > 1) & (F.col("n") >= F.greatest(F.lit(floor), F.col("total") * 0.02, F.col("un") * 0.15)))
    g = d.groupBy("image_id").agg(F.max(C.contrast(F.col("l"), F.col("bl"))).alias("ratio"), F.max(F.col("bn") / F.col("total")).alias("s")).where("ratio >= 1.1")
    return g.select("image_id", half_up(F.col("ratio"), 2).alias("ratio"), half_up(F.col("s"), 2).alias("bg_share"), (F.col("s") < 0.35).alias("complex"))


@query("transparency", f"WITH {X.PIXELS} SELECT image_id, {half_up_sql('count(*) FILTER (a < 255) / CAST(count(*) AS DOUBLE)', 3)} AS soft FROM pix GROUP BY image_id")
def transparency(spark, sf):
    return X.pixels(spark, sf).groupBy("image_id").agg(half_up(F.count_if(F.col("a") < 255) / F.count("*"), 3).alias("soft"))


def _axis_sql(axis: str, other: str) -> str:
    return f"""{axis}d AS (SELECT p.image_id, p.{axis}, avg(abs(p.g - q.g)) AS d FROM grey p JOIN grey q ON p.image_id = q.image_id AND p.{other} = q.{other} AND q.{axis} = (p.{axis} + 1) % 8 GROUP BY p.image_id, p.{axis}),
    {axis}s AS (SELECT image_id, max(d) FILTER ({axis} = 7) AS j, list_sort(list(d) FILTER ({axis} < 7))[4] AS m FROM {axis}d GROUP BY image_id)"""


_RATIO = "CASE WHEN {a}.j <= 0.5 THEN 1 ELSE {a}.j / greatest({a}.m, 0.5) END"
SEAM_SQL = f"""WITH {X.GREY}, {_axis_sql('x', 'y')}, {_axis_sql('y', 'x')}, r AS (SELECT image_id, xs.j AS jx, ys.j AS jy, xs.m AS mx, ys.m AS my, {_RATIO.format(a='xs')} AS rx, {_RATIO.format(a='ys')} AS ry FROM xs JOIN ys USING (image_id))
    SELECT image_id, {half_up_sql('jx', 2)} AS join_x, {half_up_sql('jy', 2)} AS join_y, {half_up_sql('mx', 2)} AS grain_x, {half_up_sql('my', 2)} AS grain_y, {half_up_sql('greatest(rx, ry)', 2)} AS ratio,
    CASE WHEN greatest(rx, ry) <= 1.5 THEN 'seamless' ELSE 'seams' END AS verdict FROM r"""


@query("seam", SEAM_SQL)
def seam(spark, sf):
    """How a picture joins to itself at its edges, against the upper median of its inner steps. One row a picture throughout."""
    d = X.table(spark, sf, "embeddings").select(F.col("vec_id").alias("image_id"), F.transform("embedding", X.sample).alias("v"))
    eight = F.sequence(F.lit(0), F.lit(7))

    def steps(stride: int, across: int):
        one = lambda s: F.aggregate(eight, F.lit(0).cast("long"), lambda acc, o: acc + F.abs(F.get("v", s * stride + o * across) - F.get("v", ((s + 1) % 8) * stride + o * across))) / 8
        return F.transform(eight, one)

    d = d.select("image_id", steps(1, 8).alias("x"), steps(8, 1).alias("y"))
    out = {}
    for axis in "xy":
        j, m = F.get(axis, F.lit(7)), F.get(F.array_sort(F.slice(axis, 1, 7)), F.lit(3))
        out[axis] = j, m, F.when(j <= 0.5, 1.0).otherwise(j / F.greatest(m, F.lit(0.5)))
    ratio = F.greatest(out["x"][2], out["y"][2])
    return d.select(
        "image_id",
        *(half_up(out[a][k], 2).alias(f"{n}_{a}") for n, k in (("join", 0), ("grain", 1)) for a in "xy"),
        half_up(ratio, 2).alias("ratio"),
        F.when(ratio <= 1.5, "seamless").otherwise("seams").alias("verdict"),
    )


@query("mark_radius", f"WITH {X.PIXELS} SELECT image_id, {half_up_sql('max(sqrt(pow(greatest(abs(x - 2), abs(x + 1 - 2)), 2) + pow(greatest(abs(y - 2), abs(y + 1 - 2)), 2)))', 4)} AS radius FROM pix WHERE a >= 16 GROUP BY image_id")
def mark_radius(spark, sf):
    """The farthest reach of a visible pixel's corner from the centre."""
    far = lambda c: F.greatest(F.abs(F.col(c) - 2), F.abs(F.col(c) - 1))
    return X.pixels(spark, sf).where("a >= 16").groupBy("image_id").agg(half_up(F.max(F.hypot(far("x").cast("double"), far("y").cast("double"))), 4).alias("radius"))


@query(
    "otsu",
    f"""WITH {X.GREY}, h AS (SELECT image_id, g, count(*) AS n FROM grey GROUP BY image_id, g),
    c AS (SELECT image_id, g, sum(n) OVER w AS wb, sum(n * g) OVER w AS sb, sum(n) OVER p AS t, sum(n * g) OVER p AS s, lead(g) OVER (PARTITION BY image_id ORDER BY g) AS nxt FROM h WINDOW w AS (PARTITION BY image_id ORDER BY g ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY image_id)),
    v AS (SELECT image_id, g, nxt, wb * (t - wb) * pow(sb / CAST(wb AS DOUBLE) - (s - sb) / CAST(t - wb AS DOUBLE), 2) AS var FROM c WHERE t > wb)
    SELECT image_id, arg_min((g + nxt) // 2, [-round(var, 6), g]) AS threshold, {half_up_sql('max(var)', 2)} AS variance FROM v GROUP BY image_id""",
)
def otsu(spark, sf):
    """The cut with the largest variance between classes (the first of equals), moved to the middle of the empty run."""
    h = X.grey(spark, sf).groupBy("image_id", "g").agg(F.count("*").alias("n"))
    every = Window.partitionBy("image_id")
    run = every.orderBy("g").rowsBetween(Window.unboundedPreceding, 0)
    c = h.select("image_id", "g", F.sum("n").over(run).alias("wb"), F.sum(F.col("n") * F.col("g")).over(run).alias("sb"), F.sum("n").over(every).alias("t"), F.sum(F.col("n") * F.col("g")).over(every).alias("s"), F.lead("g").over(every.orderBy("g")).alias("nxt"))
    step = F.col("sb") / F.col("wb") - (F.col("s") - F.col("sb")) / (F.col("t") - F.col("wb"))
    v = c.where("t > wb").withColumn("var", F.col("wb") * (F.col("t") - F.col("wb")) * F.pow(step, 2.0))
    best = F.min(F.struct((-F.round("var", 6)).alias("k"), "g", F.floor((F.col("g") + F.col("nxt")) / 2).alias("cut")))["cut"]
    return v.groupBy("image_id").agg(best.alias("threshold"), half_up(F.max("var"), 2).alias("variance"))


@query(
    "grid_adherence",
    f"""WITH {X.PIXELS}, m AS (SELECT *, avg(r) OVER w AS mr, avg(g) OVER w AS mg, avg(b) OVER w AS mb, avg(a) OVER w AS ma FROM pix WINDOW w AS (PARTITION BY image_id, x // 2, y // 2)),
    c AS (SELECT image_id, x // 2 AS cx, y // 2 AS cy, max(greatest(abs(r - mr), abs(g - mg), abs(b - mb))) AS d, max(abs(a - ma)) AS da FROM m GROUP BY image_id, x // 2, y // 2)
    SELECT image_id, {half_up_sql('count(*) FILTER (d <= 48 AND da <= 48) / CAST(count(*) AS DOUBLE)', 3)} AS adherence FROM c GROUP BY image_id""",
)
def grid_adherence(spark, sf, tolerance: int = 48):
    """The share of 2 by 2 cells whose samples all stay within the tolerance of the cell's mean."""
    cell = [F.floor(F.col(c) / 2).alias(f"c{c}") for c in "xy"]
    d = X.pixels(spark, sf).groupBy("image_id", *cell).agg(*(F.avg(c).alias(f"m{c}") for c in "rgba"), *(f(c).alias(f"{n}{c}") for c in "rgba" for n, f in (("lo", F.min), ("hi", F.max))))
    off = lambda c: F.greatest(F.col(f"hi{c}") - F.col(f"m{c}"), F.col(f"m{c}") - F.col(f"lo{c}"))
    ok = F.greatest(*(off(c) for c in "rgba")) <= tolerance
    return d.groupBy("image_id").agg(half_up(F.count_if(ok) / F.count("*"), 3).alias("adherence"))


@query("height_field", f"WITH {X.PIXELS}, l AS (SELECT image_id, i, CASE WHEN a >= 128 THEN (0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b) / 255 END AS l FROM pix) SELECT image_id, i, {half_up_sql('coalesce(l, avg(l) OVER (PARTITION BY image_id), 0.5)', 6)} AS height FROM l")
def height_field(spark, sf):
    """Luma of the visible pixels; hidden ones take the mean of the visible."""
    d = X.packed(spark, sf)
    sixteen = F.sequence(F.lit(0), F.lit(15))
    l = F.transform(sixteen, lambda p: F.when(F.get("data", p * 4 + 3) >= 128, C.luma(*(F.get("data", p * 4 + k) for k in range(3))) / 255))
    d = d.select("image_id", l.alias("l"))
    seen = F.filter("l", lambda v: v.isNotNull())
    mean = F.when(F.size(seen) > 0, F.aggregate(seen, F.lit(0.0), lambda acc, v: acc + v) / F.size(seen)).otherwise(0.5)
    d = d.select("image_id", mean.alias("mean"), F.posexplode("l").alias("i", "v"))
    return d.select("image_id", F.col("i").cast("long").alias("i"), half_up(F.coalesce("v", "mean"), 6).alias("height"))


@query("size_spread", f"WITH {X.PIXELS}, {X.FRAMES}, h AS (SELECT f.action, f.image_id, max(y) - min(y) + 1 AS h FROM pix p JOIN frm f USING (image_id) WHERE a >= 160 GROUP BY f.action, f.image_id) SELECT action, min(h) AS smallest, max(h) AS largest, {upper_median_sql('h')} AS mid, {half_up_sql('max(h) / CAST(min(h) AS DOUBLE)', 3)} AS ratio FROM h GROUP BY action HAVING count(*) > 1")
def size_spread(spark, sf):
    h = X.pixels(spark, sf).where("a >= 160").groupBy("action", "image_id").agg((F.max("y") - F.min("y") + 1).alias("h"))
    g = h.groupBy("action").agg(F.min("h").alias("smallest"), F.max("h").alias("largest"), upper_median(F.col("h")).alias("mid"), F.count("*").alias("n")).where("n > 1")
    return g.select("action", "smallest", "largest", "mid", half_up(F.col("largest") / F.col("smallest"), 3).alias("ratio"))


@query(
    "pixel_art",
    f"""WITH {X.PIXELS}, s AS (SELECT image_id, count(DISTINCT r * 65536 + g * 256 + b) FILTER (a >= 128) AS colours, count(*) FILTER (a > 0 AND a < 255) AS soft, count(*) FILTER (a > 0) AS visible FROM pix GROUP BY image_id)
    SELECT image_id, colours, soft, visible, colours <= 64 AND soft / CAST(greatest(visible, 1) AS DOUBLE) <= 0.005 AS is_pixel_art FROM s""",
)
def pixel_art(spark, sf):
    d = X.packed(spark, sf)
    alphas = F.transform(F.sequence(F.lit(3), F.lit(63), F.lit(4)), lambda i: F.get("data", i))
    soft, visible = (F.size(F.filter(alphas, f)).cast("long") for f in (lambda v: (v > 0) & (v < 255), lambda v: v > 0))
    at = F.filter(F.sequence(F.lit(0), F.lit(60), F.lit(4)), lambda i: F.get("data", i + 3) >= 128)
    colours = F.size(F.array_distinct(F.transform(at, lambda i: F.get("data", i) * 65536 + F.get("data", i + 1) * 256 + F.get("data", i + 2)))).cast("long")
    d = d.select("image_id", colours.alias("colours"), soft.alias("soft"), visible.alias("visible"))
    return d.withColumn("is_pixel_art", (F.col("colours") <= 64) & (F.col("soft") / F.greatest("visible", F.lit(1)) <= 0.005))


@query(
    "crisp",
    f"""WITH {X.PIXELS}, n AS (SELECT p.image_id, greatest(abs(p.r - q.r), abs(p.g - q.g), abs(p.b - q.b)) AS d FROM pix p JOIN pix q ON p.image_id = q.image_id AND ((q.x = p.x + 1 AND q.y = p.y) OR (q.x = p.x AND q.y = p.y + 1)) WHERE p.a >= 128 AND q.a >= 128)
    SELECT image_id, count(*) AS pairs, count(*) FILTER (d BETWEEN 1 AND 6) AS near, count(*) FILTER (d BETWEEN 1 AND 6) <= count(*) * 0.001 AS crisp FROM n GROUP BY image_id""",
)
def crisp(spark, sf):
    """Neighbouring opaque pixels that are nearly, not quite, equal."""
    pairs = [(y * 4 + x, y * 4 + x + 1) for y in range(4) for x in range(3)] + [(y * 4 + x, y * 4 + x + 4) for y in range(3) for x in range(4)]
    at = F.array(*(F.struct(F.lit(a).alias("p"), F.lit(b).alias("q")) for a, b in pairs))
    d = X.packed(spark, sf).select("image_id", "data", at.alias("at"))
    sides = F.filter("at", lambda e: (F.get("data", e["p"] * 4 + 3) >= 128) & (F.get("data", e["q"] * 4 + 3) >= 128))
    diffs = F.transform(sides, lambda e: F.greatest(*(F.abs(F.get("data", e["p"] * 4 + k) - F.get("data", e["q"] * 4 + k)) for k in range(3))))
    d = d.select("image_id", diffs.alias("d")).where(F.size("d") > 0)
    near = F.size(F.filter("d", lambda v: (v >= 1) & (v <= 6))).cast("long")
    return d.select("image_id", F.size("d").cast("long").alias("pairs"), near.alias("near"), (near <= F.size("d") * 0.001).alias("crisp"))


@query("centre_is_empty", f"WITH {X.PIXELS} SELECT image_id, count(*) FILTER (a > 40 AND x BETWEEN 1 AND 2 AND y BETWEEN 1 AND 2) = 0 AS empty FROM pix GROUP BY image_id")
def centre_is_empty(spark, sf):
    inside = (F.col("a") > 40) & F.col("x").between(1, 2) & F.col("y").between(1, 2)
    return X.pixels(spark, sf).groupBy("image_id").agg((F.count_if(inside) == 0).alias("empty"))


@query("trimmed_saving", f"WITH {X.PIXELS}, {X.FRAMES}, b AS (SELECT f.action, f.image_id, (max(x) FILTER (a >= 160) - min(x) FILTER (a >= 160) + 1) * (max(y) FILTER (a >= 160) - min(y) FILTER (a >= 160) + 1) AS n FROM pix p JOIN frm f USING (image_id) GROUP BY f.action, f.image_id) SELECT action, sum(coalesce(n, 1))::BIGINT AS after, count(*) * 16 AS before, {half_up_sql('1 - sum(coalesce(n, 1)) / CAST(count(*) * 16 AS DOUBLE)', 3)} AS saving FROM b GROUP BY action")
def trimmed_saving(spark, sf):
    """Texels kept by cutting each frame to its box, an empty frame to one texel."""
    b = bounds(X.pixels(spark, sf), 160).withColumn("n", F.coalesce(F.col("width") * F.col("height"), F.lit(1)))
    f = X.packed(spark, sf).select("image_id", "action").join(b, "image_id")
    return f.groupBy("action").agg(F.sum("n").alias("after"), (F.count("*") * 16).alias("before"), half_up(1 - F.sum("n") / (F.count("*") * 16), 3).alias("saving"))


@query(
    "ink_runs",
    f"""WITH {X.PIXELS}, {X.FRAMES}, s AS (SELECT f.action, f.frame_ix * 4 + x AS sx FROM pix p JOIN frm f USING (image_id) GROUP BY f.action, f.frame_ix * 4 + x HAVING max(a) >= 150 AND min(a) >= 60),
    g AS (SELECT action, sx, CASE WHEN sx - lag(sx) OVER (PARTITION BY action ORDER BY sx) <= 2 THEN 0 ELSE 1 END AS new FROM s), r AS (SELECT action, sx, sum(new) OVER (PARTITION BY action ORDER BY sx ROWS UNBOUNDED PRECEDING) AS run FROM g)
    SELECT action, CAST(run AS BIGINT) AS run, min(sx) AS start, max(sx) + 1 AS stop FROM r GROUP BY action, run""",
)
def ink_runs(spark, sf):
    """Runs of inked columns along an action's strip, gaps of one column bridged (gaps and islands)."""
    p = X.pixels(spark, sf).join(X.frames(spark, sf).select("image_id", "frame_ix"), "image_id")
    s = p.groupBy("action", (F.col("frame_ix") * 4 + F.col("x")).alias("sx")).agg(F.max("a").alias("hi"), F.min("a").alias("lo")).where("hi >= 150 and lo >= 60")
    w = Window.partitionBy("action").orderBy("sx")
    g = s.withColumn("new", F.when(F.col("sx") - F.lag("sx").over(w) <= 2, 0).otherwise(1))
    r = g.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return r.groupBy("action", "run").agg(F.min("sx").alias("start"), (F.max("sx") + 1).alias("stop"))


@query("ink_profile", f"WITH {X.PIXELS} SELECT image_id, x, max(a) >= 200 AS ink FROM pix GROUP BY image_id, x")
def ink_profile(spark, sf):
    return X.pixels(spark, sf).groupBy("image_id", "x").agg((F.max("a") >= 200).alias("ink"))


@query(
    "mono_levels",
    f"""WITH {X.GREY}, h AS (SELECT image_id, g, row_number() OVER (PARTITION BY image_id ORDER BY g, y, x) AS n FROM grey)
    SELECT image_id, k AS level, g AS cut FROM h JOIN (VALUES (1, 16), (2, 32), (3, 48)) AS q(k, nth) ON h.n = q.nth""",
)
def mono_levels(spark, sf):
    """Nested cuts of equal ink: the sample at each quarter of the sorted ones."""
    d = X.table(spark, sf, "embeddings").select(F.col("vec_id").alias("image_id"), F.array_sort(F.transform("embedding", X.sample)).alias("v"))
    d = d.select("image_id", "v", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("level"))
    return d.select("image_id", "level", F.get("v", F.col("level") * 16 - 1).alias("cut"))


@query("verdict_icon", f"""WITH {X.PIXELS}, s AS (SELECT image_id, bool_and(a = 255) AS opaque, bool_or(a < 255) AS has_clear, min(least(r, g, b)) FILTER (a >= 16) AS darkest, max(sqrt(pow(x + 0.5 - 2, 2) + pow(y + 0.5 - 2, 2))) FILTER (a >= 16) AS reach FROM pix GROUP BY image_id)
    SELECT image_id, c.name AS "check", CASE c.name WHEN 'opaque' THEN opaque WHEN 'transparent' THEN has_clear WHEN 'white_only' THEN coalesce(darkest >= 235, true) ELSE coalesce(reach <= 1.6, true) END AS ok FROM s, (VALUES ('opaque'), ('transparent'), ('white_only'), ('safe_zone')) c(name)""")
def verdict_icon(spark, sf):
    """The icon rules on a picture, a row for each check; pixels with alpha below 16 don't count for its shape."""
    seen = F.col("a") >= 16
    s = X.pixels(spark, sf).groupBy("image_id").agg(
        F.bool_and(F.col("a") == 255).alias("opaque"), F.bool_or(F.col("a") < 255).alias("transparent"),
        F.coalesce(F.min(F.when(seen, F.least("r", "g", "b"))) >= 235, F.lit(True)).alias("white_only"),
        F.coalesce(F.max(F.when(seen, F.hypot(F.col("x") - 1.5, F.col("y") - 1.5))) <= 1.6, F.lit(True)).alias("safe_zone"),
    )
    rows = F.array(*(F.struct(F.lit(c).alias("check"), F.col(c).alias("ok")) for c in ("opaque", "transparent", "white_only", "safe_zone")))
    return s.select("image_id", F.inline(rows))
