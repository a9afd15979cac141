"""Queries that write asset texts, place and restore frames, and score attempts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import colour as C
from tessera.functions.numbers import byte, byte_sql, half_up, half_up_sql, upper_median, upper_median_sql
from tessera.plans import fixtures as X
from tessera.plans.compare import neighbours
from tessera.plans.measure import bounds  # registers ink_runs
from tessera.plans.registry import ORACLES, QUERIES, query

_ACT = f"{X.FRAMES}, act AS (SELECT action, count(*) AS n FROM frm GROUP BY action)"


def actions(spark, sf):
    return X.packed(spark, sf).groupBy("action").agg(F.count("*").alias("n"))


def text(*parts):
    """Columns and constants put together as text."""
    return F.concat(*(p.cast("string") if hasattr(p, "cast") else F.lit(str(p)) for p in parts))


@query("write_fnt", "SELECT p_brand AS brand, string_agg('char id=' || p_partkey || ' x=' || p_size || ' xadvance=' || (p_size + 3), chr(10) ORDER BY p_partkey) AS lines, count(*) AS chars FROM part GROUP BY p_brand")
def write_fnt(spark, sf):
    """Every part's line, a text a brand; write_fnt_pages bounds a text's length."""
    p = X.table(spark, sf, "part")
    line = text("char id=", F.col("p_partkey"), " x=", F.col("p_size"), " xadvance=", F.col("p_size") + 3)
    g = p.groupBy(F.col("p_brand").alias("brand")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("l")))).alias("ls"), F.count("*").alias("chars"))
    return g.select("brand", F.array_join(F.transform("ls", lambda e: e["l"]), "\n").alias("lines"), "chars")


@query("write_fnt_pages", "SELECT p_brand AS brand, p_partkey // 6400 AS page, string_agg('char id=' || p_partkey || ' x=' || p_size || ' xadvance=' || (p_size + 3), chr(10) ORDER BY p_partkey) AS lines, count(*) AS chars FROM part GROUP BY p_brand, p_partkey // 6400")
def write_fnt_pages(spark, sf, ids: int = 6400):
    """A text for each brand and run of ids, so that none has more lines than that."""
    p = X.table(spark, sf, "part")
    line = text("char id=", F.col("p_partkey"), " x=", F.col("p_size"), " xadvance=", F.col("p_size") + 3)
    g = p.groupBy(F.col("p_brand").alias("brand"), F.floor(F.col("p_partkey") / ids).alias("page"))
    g = g.agg(F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("l")))).alias("ls"), F.count("*").alias("chars"))
    return g.select("brand", "page", F.array_join(F.transform("ls", lambda e: e["l"]), "\n").alias("lines"), "chars")


@query("write_fnt_xml", "SELECT p_partkey AS id, '<char id=\"' || p_partkey || '\" xadvance=\"' || p_size || '\" letter=\"' || replace(replace(p_name || ' & <b>', '&', '&amp;'), '<', '&lt;') || '\"/>' AS xml FROM part")
def write_fnt_xml(spark, sf):
    esc = F.replace(F.replace(F.concat("p_name", F.lit(" & <b>")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return X.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), text('<char id="', F.col("p_partkey"), '" xadvance="', F.col("p_size"), '" letter="', esc, '"/>').alias("xml"))


@query("atlas_header", f"WITH {_ACT} SELECT action, '#define ACT' || action || '_FRAMES ' || n || chr(10) || '#define ACT' || action || '_MS ' || n * 125 AS text FROM act")
def atlas_header(spark, sf):
    a, n = F.col("action"), F.col("n")
    return actions(spark, sf).select("action", text("#define ACT", a, "_FRAMES ", n, "\n#define ACT", a, "_MS ", n * 125).alias("text"))


@query("sprite_frames", f"WITH {_ACT} SELECT action, '{{\"name\": &\"act' || action || '\", \"speed\": 8.0, \"loop\": ' || CASE WHEN action % 2 = 0 THEN 1 ELSE 0 END || ', \"frames\": ' || n || '}}' AS text FROM act")
def sprite_frames(spark, sf):
    a = F.col("action")
    return actions(spark, sf).select("action", text('{"name": &"act', a, '", "speed": 8.0, "loop": ', F.when(a % 2 == 0, 1).otherwise(0), ', "frames": ', F.col("n"), "}").alias("text"))


_INS = "p_partkey % 7 AS t, p_partkey % 5 AS r, p_partkey % 11 AS b, p_partkey % 3 AS l"


@query("nine_patch_css", "SELECT id, CASE WHEN regexp_matches(name, '^[A-Za-z_]') THEN '.' || name ELSE '.np-' || name END || ' { border-width: ' || t || 'px ' || r || 'px ' || b || 'px ' || l || 'px; border-image: url(\"a.png\") ' || t || ' ' || r || ' ' || b || ' ' || l || ' fill stretch; }' AS css FROM (SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 'n' END || p_partkey AS name, " + _INS + " FROM part) q")
def nine_patch_css(spark, sf):
    """A class never begins with a digit."""
    k = F.col("p_partkey")
    name = F.concat(F.when(k % 2 == 0, "").otherwise("n"), k.cast("string"))
    cls = F.when(name.rlike("^[A-Za-z_]"), F.concat(F.lit("."), name)).otherwise(F.concat(F.lit(".np-"), name))
    t, r, b, l = k % 7, k % 5, k % 11, k % 3
    return X.table(spark, sf, "part").select(k.alias("id"), text(cls, " { border-width: ", t, "px ", r, "px ", b, "px ", l, 'px; border-image: url("a.png") ', t, " ", r, " ", b, " ", l, " fill stretch; }").alias("css"))


@query("style_box", "SELECT id, 'texture_margin_left = ' || l || '.0' || chr(10) || 'texture_margin_top = ' || t || '.0' || chr(10) || 'texture_margin_right = ' || r || '.0' || chr(10) || 'texture_margin_bottom = ' || b || '.0' AS text FROM (SELECT p_partkey AS id, " + _INS + " FROM part) q")
def style_box(spark, sf):
    k = F.col("p_partkey")
    return X.table(spark, sf, "part").select(k.alias("id"), text("texture_margin_left = ", k % 3, ".0\ntexture_margin_top = ", k % 7, ".0\ntexture_margin_right = ", k % 5, ".0\ntexture_margin_bottom = ", k % 11, ".0").alias("text"))


@query("svg_text", f"WITH {X.PALETTE_SQL} SELECT vec_id AS image_id, '<svg viewBox=\"0 0 4 4\">' || string_agg('<path style=\"fill:var(--c' || ord || ',' || hex || ')\" d=\"M' || (vec_id + ord) % 4 || ' 0Z\"/>', '' ORDER BY ord) || '</svg>' AS svg FROM embeddings, pal GROUP BY vec_id")
def svg_text(spark, sf):
    """A path for each palette layer, bottom first; the palette is a constant of the plan."""
    v = F.col("vec_id")
    layers = [text(f'<path style="fill:var(--c{i},{h})" d="M', (v + i) % 4, ' 0Z"/>') for i, h in enumerate(X.PALETTE)]
    return X.table(spark, sf, "embeddings").select(v.alias("image_id"), text('<svg viewBox="0 0 4 4">', *layers, "</svg>").alias("svg"))


@query("android_colours", f"WITH {X.PALETTE_SQL} SELECT ord, '<color name=\"' || lower(regexp_replace('Brand ink-' || ord, '[^a-zA-Z0-9]+', '_', 'g')) || '\">' || upper(hex) || '</color>' AS line FROM pal")
def android_colours(spark, sf):
    name = F.lower(F.regexp_replace(text("Brand ink-", F.col("ord")), "[^a-zA-Z0-9]+", "_"))
    return X.palette(spark).select("ord", text('<color name="', name, '">', F.upper("hex"), "</color>").alias("line"))


@query("nine_patch_render", f"WITH {X.PIXELS}, t AS (SELECT unnest(range(0, 9)) AS tx), u AS (SELECT unnest(range(0, 6)) AS ty), m AS (SELECT tx, ty, CASE WHEN tx + 0.5 < 1 THEN tx + 0.5 WHEN tx + 0.5 >= 8 THEN 4 - (9 - (tx + 0.5)) ELSE 1 + (tx + 0.5 - 1) / 7.0 * 2 END AS mx, CASE WHEN ty + 0.5 < 1 THEN ty + 0.5 WHEN ty + 0.5 >= 5 THEN 4 - (6 - (ty + 0.5)) ELSE 1 + (ty + 0.5 - 1) / 4.0 * 2 END AS my FROM t, u) SELECT image_id, tx AS x, ty AS y, r, g, b, a FROM m JOIN pix p ON p.x = least(3, greatest(0, CAST(floor(mx) AS BIGINT))) AND p.y = least(3, greatest(0, CAST(floor(my) AS BIGINT)))")
def nine_patch_render(spark, sf, width: int = 9, height: int = 6, inset: int = 1):
    """Nearest sampling through three zones an axis: corners kept, the middle stretched."""
    d = X.packed(spark, sf).select("image_id", "data", F.explode(F.sequence(F.lit(0), F.lit(width * height - 1))).alias("k"))

    def source(c, draw):
        p = c + 0.5
        m = F.when(p < inset, p).when(p >= draw - inset, 4 - (draw - p)).otherwise(inset + (p - inset) / (draw - 2 * inset) * (4 - 2 * inset))
        return F.least(F.lit(3), F.greatest(F.lit(0), F.floor(m).cast("int")))

    x, y = F.col("k") % width, F.floor(F.col("k") / width).cast("int")
    p = (source(y, height) * 4 + source(x, width)) * 4
    return d.select("image_id", x.cast("long").alias("x"), y.cast("long").alias("y"), *(F.get("data", p + i).alias(c) for i, c in enumerate("rgba")))


@query("android_nine_patch", f"WITH {X.PIXELS}, t AS (SELECT unnest(range(0, 6)) AS tx), u AS (SELECT unnest(range(0, 6)) AS ty) SELECT e.vec_id AS image_id, tx AS x, ty AS y, coalesce(p.r, 0) AS r, CASE WHEN p.a IS NOT NULL THEN p.a WHEN (ty = 0 OR tx = 0) AND tx + ty BETWEEN 2 AND 3 THEN 255 WHEN (ty = 5 OR tx = 5) AND tx + ty - 5 BETWEEN 1 AND 4 AND NOT (tx = 5 AND ty = 0) AND NOT (tx = 0 AND ty = 5) THEN 255 ELSE 0 END AS a FROM embeddings e, t, u LEFT JOIN pix p ON p.image_id = e.vec_id AND p.x = tx - 1 AND p.y = ty - 1")
def android_nine_patch(spark, sf):
    """The picture in a border of one pixel whose black marks say what stretches (above, left) and where content goes."""
    d = X.packed(spark, sf).select("image_id", "data", F.explode(F.sequence(F.lit(0), F.lit(35))).alias("k"))
    x, y = F.col("k") % 6, F.floor(F.col("k") / 6).cast("int")
    inside = x.between(1, 4) & y.between(1, 4)
    p = ((y - 1) * 4 + x - 1) * 4
    stretch = ((y == 0) & x.between(2, 3)) | ((x == 0) & y.between(2, 3))
    content = ((y == 5) & x.between(1, 4)) | ((x == 5) & y.between(1, 4))
    return d.select("image_id", x.cast("long").alias("x"), y.cast("long").alias("y"), F.when(inside, F.get("data", p)).otherwise(0).alias("r"), F.when(inside, F.get("data", p + 3)).when(stretch | content, 255).otherwise(0).alias("a"))


def _mask_sql(test: str) -> str:
    return f"WITH {X.PIXELS}, c AS (SELECT x, y, count(*) FILTER ({test}) AS n FROM (SELECT x, y, (2 * (x + (i + 0.5::DOUBLE) / 4) / 4 - 1) AS u, (2 * (y + (j + 0.5::DOUBLE) / 4) / 4 - 1) AS v FROM (SELECT unnest(range(0, 4)) AS x), (SELECT unnest(range(0, 4)) AS y), (SELECT unnest(range(0, 4)) AS i), (SELECT unnest(range(0, 4)) AS j)) s GROUP BY x, y) SELECT image_id, p.x, p.y, {byte_sql('a * n / 16.0::DOUBLE')} AS a FROM pix p JOIN c ON p.x = c.x AND p.y = c.y"


def _masked(spark, sf, inside):
    """Alpha times the share of 16 samples of the pixel that lie in the shape; the shares are worked out on the driver, 16 numbers."""
    share = [sum(inside(2 * (x + (i + 0.5) / 4) / 4 - 1, 2 * (y + (j + 0.5) / 4) / 4 - 1) for i in range(4) for j in range(4)) for y in range(4) for x in range(4)]
    k = F.get(F.array(*map(F.lit, share)), F.col("i").cast("int"))
    return X.pixels(spark, sf).select("image_id", "x", "y", byte(F.col("a") * k / 16.0).alias("a"))


@query("mask_circle", _mask_sql("u * u + v * v <= 1"))
def mask_circle(spark, sf):
    return _masked(spark, sf, lambda u, v: u * u + v * v <= 1)


@query("mask_squircle", _mask_sql("pow(abs(u), 4) + pow(abs(v), 4) <= 1"))
def mask_squircle(spark, sf):
    return _masked(spark, sf, lambda u, v: abs(u) ** 4 + abs(v) ** 4 <= 1)


@query("action_scale", f"WITH {X.PIXELS}, {X.FRAMES}, b AS (SELECT f.action, f.image_id, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h FROM pix p JOIN frm f USING (image_id) WHERE a >= 200 GROUP BY f.action, f.image_id) SELECT action, {half_up_sql(f'least(48 * 0.9::DOUBLE / {upper_median_sql(chr(104))}, 48 * 0.98::DOUBLE / max(h), 32 * 0.98::DOUBLE / max(w))', 6)} AS scale FROM b GROUP BY action")
def action_scale(spark, sf, width: int = 32, height: int = 48, fill: float = 0.9):
    b = bounds(X.pixels(spark, sf), 200).where("x0 is not null")
    f = X.packed(spark, sf).select("image_id", "action").join(b, "image_id")
    return f.groupBy("action").agg(half_up(F.least(height * fill / upper_median(F.col("height")), height * 0.98 / F.max("height"), width * 0.98 / F.max("width")), 6).alias("scale"))


@query("place_frames", f"WITH {X.PIXELS}, b AS (SELECT image_id, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h FROM pix WHERE a >= 200 GROUP BY image_id), s AS (SELECT image_id, greatest(1, CAST(floor(w * 7.2::DOUBLE + 0.5) AS BIGINT)) AS tw, greatest(1, CAST(floor(h * 7.2::DOUBLE + 0.5) AS BIGINT)) AS th FROM b) SELECT image_id, tw AS width, th AS height, CAST(floor((32 - tw) / 2.0::DOUBLE) AS BIGINT) AS x, greatest(0, 48 - 2 - th) AS y FROM s")
def place_frames(spark, sf, width: int = 32, height: int = 48, scale: float = 7.2, margin: int = 2):
    """All at one scale, centred on a baseline."""
    b = bounds(X.pixels(spark, sf), 200).where("x0 is not null")
    tw, th = (F.greatest(F.lit(1), F.floor(F.col(c) * scale + 0.5)) for c in ("width", "height"))
    return b.select("image_id", tw.alias("width"), th.alias("height"), F.floor((width - tw) / 2.0).alias("x"), F.greatest(F.lit(0), height - margin - th).alias("y"))


@query("restore_frame", f"WITH {X.PIXELS}, b AS (SELECT image_id, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM pix WHERE a >= 160 GROUP BY image_id) SELECT p.image_id, count(*) FILTER (a > 0 AND (x0 IS NULL OR x < x0 OR x > x1 OR y < y0 OR y > y1)) AS lost, count(*) FILTER (a >= 160 AND (x0 IS NULL OR x < x0 OR x > x1 OR y < y0 OR y > y1)) AS moved, CASE WHEN count(*) FILTER (a > 0 AND (x0 IS NULL OR x < x0 OR x > x1 OR y < y0 OR y > y1)) > 0 THEN 'lossy' ELSE 'exact' END AS verdict FROM pix p LEFT JOIN b USING (image_id) GROUP BY p.image_id")
def restore_frame(spark, sf, least: int = 160):
    """What a frame cut to its box and put back loses against its cell; the box and the test are in the same row."""
    b = bounds(X.pixels(spark, sf), least)
    p = X.pixels(spark, sf).join(b, "image_id")
    out = F.col("x0").isNull() | (F.col("x") < F.col("x0")) | (F.col("x") >= F.col("x0") + F.col("width")) | (F.col("y") < F.col("y0")) | (F.col("y") >= F.col("y0") + F.col("height"))
    lost = F.count_if((F.col("a") > 0) & out)
    return p.groupBy("image_id").agg(lost.alias("lost"), F.count_if((F.col("a") >= least) & out).alias("moved"), F.when(lost > 0, "lossy").otherwise("exact").alias("verdict"))


@query("layer_order", f"WITH {X.GREY}, l AS (SELECT image_id, x, y, CASE WHEN g < 64 THEN -1 ELSE g // 64 END AS l FROM grey), e AS (SELECT p.image_id, p.x, p.y, p.l, p.x IN (0, 7) OR p.y IN (0, 7) OR min(q.l) < 0 AS edge FROM l p JOIN l q ON p.image_id = q.image_id AND abs(p.x - q.x) + abs(p.y - q.y) <= 1 WHERE p.l >= 0 GROUP BY p.image_id, p.x, p.y, p.l), c AS (SELECT image_id, l, count(*) AS area, count(*) FILTER (edge) AS edge FROM e GROUP BY image_id, l) SELECT image_id, l AS label, area, edge, row_number() OVER (PARTITION BY image_id ORDER BY edge DESC, area DESC, l) AS place FROM c")
def layer_order(spark, sf):
    """Labels by pixels on the silhouette's edge, then by area."""
    d = X.table(spark, sf, "embeddings").select(F.col("vec_id").alias("image_id"), F.transform("embedding", lambda s: F.when(X.sample(s) < 64, -1).otherwise(F.floor(X.sample(s) / 64))).alias("v"))
    i = F.col("i")
    x, y = i % 8, F.floor(i / 8).cast("int")
    rim = x.isin(0, 7) | y.isin(0, 7)
    near = F.least(*(F.coalesce(F.get("v", i + o), F.lit(0)) for o in (-1, 1, -8, 8)))
    e = d.select("image_id", "v", F.posexplode("v").alias("i", "l")).where("l >= 0").select("image_id", "l", (rim | (near < 0)).alias("edge"))
    c = e.groupBy("image_id", F.col("l").alias("label")).agg(F.count("*").alias("area"), F.count_if("edge").alias("edge"))
    return c.withColumn("place", F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("edge"), F.desc("area"), "label")).cast("long"))


_STEP = "CASE WHEN count(*) FILTER (a >= 128 OR a2 >= 128) = 0 THEN 0 ELSE count(*) FILTER (a >= 128 AND a2 >= 128) / CAST(count(*) FILTER (a >= 128 OR a2 >= 128) AS DOUBLE) END"


def _steps(spark, sf):
    at = lambda n, p: F.get(n, p * 4 + 3) >= 128
    sixteen = F.sequence(F.lit(0), F.lit(15))
    n = lambda f: F.size(F.filter(sixteen, f))
    both, either = n(lambda p: at("data", p) & at("low", p)), n(lambda p: at("data", p) | at("low", p))
    return neighbours(spark, sf).select("image_id", "action", "frame_ix", F.when(either == 0, 0.0).otherwise(both / either).alias("iou"))


_TWO = f"{X.PIXELS}, {X.FRAMES}, n AS (SELECT p.*, f.frame_ix FROM pix p JOIN frm f USING (image_id)), two AS (SELECT t.image_id, t.action, t.a, u.a AS a2 FROM n t JOIN n u ON t.action = u.action AND t.frame_ix = u.frame_ix + 1 AND t.i = u.i), st AS (SELECT image_id, action, {_STEP} AS iou FROM two GROUP BY image_id, action)"


@query(
    "frame_badness",
    f"WITH f AS (WITH {X.FRAMES} SELECT * FROM frm), i AS ({ORACLES['iou_prev']}), m AS ({ORACLES['action_measure']}) SELECT f.image_id, {half_up_sql('CASE WHEN m.flag <> \'\' THEN 10 ELSE 0 END + coalesce(1 - i.iou, 0) + abs(coalesce(m.height_ratio, 1) - 1)', 4)} AS badness FROM f JOIN m ON m.action = f.action AND m.frame_ix = f.frame_ix LEFT JOIN i ON i.image_id = f.image_id",
)
def frame_badness(spark, sf):
    """Ten for a frame that is empty or the wrong size, what its shape lacks of the one before, and how far its height is off."""
    d = X.frames(spark, sf).join(QUERIES["iou_prev"](spark, sf), "image_id", "left").join(QUERIES["action_measure"](spark, sf), ["action", "frame_ix"])
    bad = F.when(F.col("flag") != "", 10).otherwise(0) + F.coalesce(1 - F.col("iou"), F.lit(0.0)) + F.abs(F.coalesce("height_ratio", F.lit(1.0)) - 1)
    return d.select("image_id", half_up(bad, 4).alias("badness"))


@query(
    "attempt_score",
    f"WITH m AS (SELECT action, count(*) AS frames, count(*) FILTER (flag <> '') AS flagged FROM ({ORACLES['action_measure']}) q GROUP BY action), s AS ({ORACLES['smoothness']}), r AS (SELECT action, count(*) AS runs FROM ({ORACLES['ink_runs']}) q GROUP BY action) SELECT m.action, {half_up_sql('flagged * 10 + coalesce(s.jumps, 0) * 3 + CASE WHEN coalesce(r.runs, 0) = frames THEN 0 ELSE 20 END - coalesce(s.mean, 0)', 3)} AS score FROM m LEFT JOIN s ON s.action = m.action LEFT JOIN r ON r.action = m.action",
)
def attempt_score(spark, sf):
    """Lower is better: flagged frames, jumps, a strip whose inked runs are not one a frame, less the mean overlap of neighbours."""
    m = QUERIES["action_measure"](spark, sf).groupBy("action").agg(F.count("*").alias("frames"), F.count_if(F.col("flag") != "").alias("flagged"))
    runs = QUERIES["ink_runs"](spark, sf).groupBy("action").agg(F.count("*").alias("runs"))
    d = m.join(QUERIES["smoothness"](spark, sf), "action", "left").join(runs, "action", "left")
    apart = F.when(F.coalesce("runs", F.lit(0)) == F.col("frames"), 0).otherwise(20)
    score = F.col("flagged") * 10 + F.coalesce("jumps", F.lit(0)) * 3 + apart - F.coalesce("mean", F.lit(0.0))
    return d.select("action", half_up(score, 3).alias("score"))


@query("compare_frame", f"WITH {_TWO}, h AS (SELECT image_id, max(y) FILTER (a >= 160) - min(y) FILTER (a >= 160) + 1 AS h FROM pix GROUP BY image_id) SELECT st.image_id, {half_up_sql('iou', 3)} AS iou, h AS height, concat_ws(',', CASE WHEN h IS NULL THEN 'empty' END, CASE WHEN {half_up_sql('iou', 3)} < 0.5 THEN 'jump' END, CASE WHEN h < 4 THEN 'size' END) AS flags FROM st JOIN h USING (image_id)")
def compare_frame(spark, sf):
    h = bounds(X.pixels(spark, sf), 160).select("image_id", "height")
    iou = half_up(F.col("iou"), 3)
    flags = F.concat_ws(",", F.when(F.col("height").isNull(), "empty"), F.when(iou < 0.5, "jump"), F.when(F.col("height") < 4, "size"))
    return _steps(spark, sf).join(h, "image_id").select("image_id", iou.alias("iou"), "height", flags.alias("flags"))


@query("reference_view", f"WITH {X.FRAMES} SELECT image_id, v.facing, CASE v.facing WHEN 'front' THEN action * 3 WHEN 'back' THEN action * 3 + 2 ELSE action * 3 + 1 END AS view, v.facing = 'left' AS mirrored FROM frm, (VALUES ('front'), ('back'), ('left'), ('right')) v(facing)")
def reference_view(spark, sf):
    """The sheet's view for a facing; left is the side mirrored."""
    d = X.packed(spark, sf).select("image_id", "action", F.explode(F.array(*map(F.lit, ("front", "back", "left", "right")))).alias("facing"))
    view = F.col("action") * 3 + F.when(F.col("facing") == "front", 0).when(F.col("facing") == "back", 2).otherwise(1)
    return d.select("image_id", "facing", view.alias("view"), (F.col("facing") == "left").alias("mirrored"))


@query("sheet_score", f"WITH {X.FRAMES}, s AS (SELECT action, frame_ix, CASE WHEN image_id % 3 = 0 THEN 0 ELSE 10 END + (image_id % 7) / 7.0::DOUBLE * 5 + (image_id % 50) / 10.0::DOUBLE - (image_id % 101) / 100.0::DOUBLE AS s FROM frm) SELECT action, arg_min(frame_ix, [s, frame_ix::DOUBLE]) AS pick, {half_up_sql('min(s)', 4)} AS score FROM s GROUP BY action")
def sheet_score(spark, sf):
    i = F.col("image_id")
    s = F.when(i % 3 == 0, 0).otherwise(10) + i % 7 / 7.0 * 5 + i % 50 / 10.0 - i % 101 / 100.0
    g = X.frames(spark, sf).groupBy("action").agg(F.min(F.struct(s.alias("s"), "frame_ix")).alias("b"))
    return g.select("action", F.col("b.frame_ix").alias("pick"), half_up(F.col("b.s"), 4).alias("score"))


_LABS = f"v AS (SELECT image_id, i, {C.lab_sql('r', 'g', 'b')} AS lv, {C.hex_sql('r', 'g', 'b')} AS own FROM pix), w AS (SELECT ord, hex, {C.lab_sql('pr', 'pg', 'pb')} AS lw FROM pal)"


@query("brand_colours", f"WITH {X.PIXELS}, {X.PALETTE_SQL}, {_LABS}, d AS (SELECT image_id, i, own, ord, hex, {C.distance_sql('lv', 'lw')} AS de FROM v, w), b AS (SELECT image_id, i, own, arg_min(hex, [de, ord]) AS hex, min(de) AS de FROM d GROUP BY image_id, i, own) SELECT image_id, CASE WHEN de <= 30 THEN hex ELSE own END AS hex, bool_or(de <= 30) AS brand, count(*) AS n FROM b GROUP BY image_id, CASE WHEN de <= 30 THEN hex ELSE own END")
def brand_colours(spark, sf, snap: float = 30.0):
    """Colours near a palette colour become it; the others stay, and equal ones are one."""
    from tessera.plans.colour import _nearest

    p = X.pixels(spark, sf).withColumn("best", _nearest(spark))
    near = F.col("best.de") <= snap
    hexed = F.when(near, F.col("best.hex")).otherwise(C.to_hex(F.col("r"), F.col("g"), F.col("b")))
    return p.select("image_id", hexed.alias("hex"), near.alias("near")).groupBy("image_id", "hex").agg(F.bool_or("near").alias("brand"), F.count("*").alias("n"))


@query("pivots", "SELECT p_partkey AS id, (3 + p_size % 40) / 2.0::DOUBLE AS x, CASE p_partkey % 3 WHEN 0 THEN CAST(h - m AS DOUBLE) WHEN 1 THEN CAST(m AS DOUBLE) ELSE h / 2.0::DOUBLE END AS y FROM (SELECT *, 3 + p_partkey % 50 AS h, CAST(floor((3 + p_partkey % 50) * (1 - 0.9::DOUBLE) / 2 + 0.5) AS BIGINT) AS m FROM part) q")
def pivots(spark, sf, fill: float = 0.9):
    k, h = F.col("p_partkey"), 3 + F.col("p_partkey") % 50
    m = F.floor(h * (1 - fill) / 2 + 0.5)
    y = F.when(k % 3 == 0, (h - m).cast("double")).when(k % 3 == 1, m.cast("double")).otherwise(h / 2.0)
    return X.table(spark, sf, "part").select(k.alias("id"), ((3 + F.col("p_size") % 40) / 2.0).alias("x"), y.alias("y"))


@query("font_metrics", "SELECT p_partkey AS id, CAST(floor(800 * s + 0.5) AS BIGINT) AS base, greatest(1, CAST(floor((800 + 200 + greatest(0, gap)) * s + 0.5) AS BIGINT)) AS line_height FROM (SELECT p_partkey, p_size / 1000.0::DOUBLE AS s, p_partkey % 90 - 30 AS gap FROM part) q")
def font_metrics(spark, sf):
    """Rounded once, at the size."""
    s, gap = F.col("p_size") / 1000.0, F.col("p_partkey") % 90 - 30
    return X.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.floor(800 * s + 0.5).alias("base"), F.greatest(F.lit(1), F.floor((1000 + F.greatest(F.lit(0), gap)) * s + 0.5)).alias("line_height"))


@query("text_advance", "WITH c AS (SELECT p_partkey AS id, unnest(range(0, length(p_name))) AS k, p_name FROM part), g AS (SELECT id, k, ascii(substr(p_name, CAST(k + 1 AS INTEGER), 1)) AS c, CASE WHEN k > 0 THEN ascii(substr(p_name, CAST(k AS INTEGER), 1)) END AS b FROM c) SELECT id, k, c, sum(300 + c % 40 * 5 + 10) OVER (PARTITION BY id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + sum(CASE WHEN (b * 31 + c) % 7 = 0 THEN -20 ELSE 0 END) OVER (PARTITION BY id ORDER BY k ROWS UNBOUNDED PRECEDING) AS pen FROM g QUALIFY k > 0")
def text_advance(spark, sf):
    """Where the pen stands at each letter: advances and tracking before it, kerning up to it, summed in the row."""
    d = X.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.transform(F.split("p_name", ""), F.ascii).alias("cs"))
    d = d.select("id", "cs", F.explode(F.sequence(F.lit(1), F.size("cs") - 1)).alias("k"))
    before = F.aggregate(F.slice("cs", 1, F.col("k")), F.lit(0).cast("long"), lambda acc, c: acc + 310 + c % 40 * 5)
    kern = F.size(F.filter(F.sequence(F.lit(1), F.col("k")), lambda i: (F.get("cs", i - 1) * 31 + F.get("cs", i)) % 7 == 0)) * -20
    return d.select("id", F.col("k").cast("long").alias("k"), F.get("cs", F.col("k")).alias("c"), (before + kern).alias("pen"))


@query("check_times", "WITH p AS (SELECT unnest(range(100, 4100, 250)) AS d), n AS (SELECT d, CAST(floor(d * 24 / 1000.0::DOUBLE + 0.5) AS BIGINT) AS n FROM p), k AS (SELECT d, n, greatest(1, CAST(ceil((n + 1) / 40.0::DOUBLE) AS BIGINT)) AS e, unnest(range(0, n + 1)) AS k FROM n) SELECT d AS duration, " + half_up_sql("least(d, k * 1000 / 24.0::DOUBLE)", 4) + " AS ms FROM k WHERE k % e = 0 UNION SELECT d, CAST(d AS DOUBLE) FROM p")
def check_times(spark, sf, fps: int = 24, most: int = 40):
    """About forty of a timeline's frame times, its end always among them."""
    d = spark.range(100, 4100, 250).select(F.col("id").alias("duration")).withColumn("n", F.floor(F.col("duration") * fps / 1000.0 + 0.5))
    every = F.greatest(F.lit(1), F.ceil((F.col("n") + 1) / float(most)))
    ks = F.filter(F.sequence(F.lit(0).cast("long"), F.col("n")), lambda k: k % every == 0)
    ms = F.transform(ks, lambda k: half_up(F.least(F.col("duration"), k * 1000 / float(fps)), 4))
    return d.select("duration", F.explode(F.array_distinct(F.array_append(ms, F.col("duration").cast("double")))).alias("ms"))


@query("unsettled", f"WITH {X.FRAMES}, e AS (SELECT action, arg_max((image_id * 7) % 90, frame_ix) * 8 AS v FROM frm GROUP BY action) SELECT action, v, ((v % 360) + 540) % 360 - 180 AS off, v % 360 <> 0 AS unsettled FROM e")
def unsettled(spark, sf):
    """Where a rotation ends, a full turn being rest."""
    e = X.frames(spark, sf).groupBy("action").agg((F.max_by(F.col("image_id") * 7 % 90, "frame_ix") * 8).alias("v"))
    return e.select("action", "v", ((F.col("v") % 360 + 540) % 360 - 180).alias("off"), (F.col("v") % 360 != 0).alias("unsettled"))


@query("stroke_coverage", "WITH s AS (SELECT vec_id, vec_id % 7 + 0.5::DOUBLE AS ax, vec_id % 5 + 0.25::DOUBLE AS ay, vec_id % 3 + 4.0::DOUBLE AS ex, vec_id % 6 + 1.5::DOUBLE AS ey FROM embeddings), g AS (SELECT vec_id, ax, ay, ex - ax AS vx, ey - ay AS vy, x, y, x + 0.5::DOUBLE - ax AS px, y + 0.5::DOUBLE - ay AS py FROM s, (SELECT unnest(range(0, 8)) AS x), (SELECT unnest(range(0, 8)) AS y)), t AS (SELECT *, CASE WHEN vx * vx + vy * vy > 1e-12 THEN least(1.0, greatest(0.0, (px * vx + py * vy) / (vx * vx + vy * vy))) ELSE 0 END AS t FROM g) SELECT vec_id AS image_id, " + half_up_sql("sum(least(1.0, greatest(0.0, 1.25 - sqrt(pow(px - t * vx, 2) + pow(py - t * vy, 2)))))", 4) + " AS ink FROM t GROUP BY vec_id")
def stroke_coverage(spark, sf, width: float = 1.5):
    """The ink of a stroked segment on an 8 by 8 raster: a clamp of the distance to it, worked out in the row."""
    v = F.col("vec_id")
    d = X.table(spark, sf, "embeddings").select(v.alias("image_id"), (v % 7 + 0.5).alias("ax"), (v % 5 + 0.25).alias("ay"), (v % 3 + 4.0).alias("bx"), (v % 6 + 1.5).alias("by"))
    d = d.select("image_id", "ax", "ay", (F.col("bx") - F.col("ax")).alias("vx"), (F.col("by") - F.col("ay")).alias("vy"), F.explode(F.sequence(F.lit(0), F.lit(63))).alias("k"))
    px, py = F.col("k") % 8 + 0.5 - F.col("ax"), F.floor(F.col("k") / 8) + 0.5 - F.col("ay")
    vv = F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy")
    t = F.when(vv > 1e-12, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (px * F.col("vx") + py * F.col("vy")) / vv))).otherwise(0.0)
    ink = F.least(F.lit(1.0), F.greatest(F.lit(0.0), width / 2 + 0.5 - F.hypot(px - t * F.col("vx"), py - t * F.col("vy"))))
    return d.select("image_id", ink.alias("c")).groupBy("image_id").agg(half_up(F.sum("c"), 4).alias("ink"))


@query("find_runs", "SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, count(*) AS pages, min(page_id) AS first FROM pages WHERE regexp_matches(url, '/[a-z]{2}/[0-9]+') GROUP BY 1")
def find_runs(spark, sf):
    """Folders with a recognised member."""
    p = X.table(spark, sf, "pages").where(F.col("url").rlike("/[a-z]{2}/[0-9]+"))
    return p.groupBy(F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host")).agg(F.count("*").alias("pages"), F.min("page_id").alias("first"))


@query("html_escape", "SELECT page_id AS id, md5(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')) AS md5 FROM pages")
def html_escape(spark, sf):
    out = F.col("html")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return X.table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.md5(out.cast("binary")).alias("md5"))


@query("polyline_length", "SELECT vec_id AS image_id, " + half_up_sql("list_sum(list_transform(range(1, 32), lambda i: sqrt(pow(CAST(embedding[2 * i + 1] AS DOUBLE) - CAST(embedding[2 * i - 1] AS DOUBLE), 2) + pow(CAST(embedding[2 * i + 2] AS DOUBLE) - CAST(embedding[2 * i] AS DOUBLE), 2))))", 5) + " AS length, " + half_up_sql("list_sum(list_transform(range(0, 32), lambda i: CAST(embedding[2 * i + 1] AS DOUBLE) * CAST(embedding[2 * ((i + 1) % 32) + 2] AS DOUBLE) - CAST(embedding[2 * ((i + 1) % 32) + 1] AS DOUBLE) * CAST(embedding[2 * i + 2] AS DOUBLE))) / 2", 5) + " AS area FROM embeddings")
def polyline_length(spark, sf):
    """Arc length, and the signed area of the closed polygon, of 32 points."""
    at = lambda i: F.get("embedding", i).cast("double")
    total = lambda f, a: F.aggregate(F.sequence(F.lit(a), F.lit(31)), F.lit(0.0), lambda acc, i: acc + f(i))
    length = total(lambda i: F.hypot(at(i * 2) - at(i * 2 - 2), at(i * 2 + 1) - at(i * 2 - 1)), 1)
    area = total(lambda i: at(i * 2) * at((i + 1) % 32 * 2 + 1) - at((i + 1) % 32 * 2) * at(i * 2 + 1), 0)
    return X.table(spark, sf, "embeddings").select(F.col("vec_id").alias("image_id"), half_up(length, 5).alias("length"), half_up(area / 2, 5).alias("area"))


@query("fact_lines", f"WITH {X.PIXELS} SELECT image_id, 'area ' || count(*) FILTER (a >= 128) || ', ' || count(DISTINCT r * 65536 + g * 256 + b) FILTER (a >= 128) || ' colours' AS line FROM pix GROUP BY image_id")
def fact_lines(spark, sf):
    rgb = F.col("r") * 65536 + F.col("g") * 256 + F.col("b")
    p = X.pixels(spark, sf).groupBy("image_id").agg(F.count_if(F.col("a") >= 128).alias("n"), F.size(F.collect_set(F.when(F.col("a") >= 128, rgb))).alias("c"))
    return p.select("image_id", text("area ", F.col("n"), ", ", F.col("c"), " colours").alias("line"))
