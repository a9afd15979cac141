"""Queries that write engine and report texts: tile sets, texture resources, drawables, paths, escapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.numbers import half_up, half_up_sql
from tessera.plans import fixtures as X
from tessera.plans.assets import text
from tessera.plans.registry import query
from tessera.plans.terrain import BIT, NEIGHBOURS, _LEGAL, legal


def short(x: Column) -> Column:
    """Two decimals at most, without trailing zeros or a negative zero."""
    s = F.regexp_replace(F.format_string("%.2f", half_up(x, 2)), r"\.?0+$", "")
    return F.when(s == "-0", "0").otherwise(s)


def short_sql(x: str) -> str:
    s = f"regexp_replace(printf('%.2f', {half_up_sql(x, 2)}), '\\.?0+$', '')"
    return f"CASE WHEN {s} = '-0' THEN '0' ELSE {s} END"


def lines(*parts) -> Column:
    """Constants and columns as lines; a null part is left out."""
    return F.concat_ws("\n", *(p if isinstance(p, Column) else F.lit(p) for p in parts))


# The lines of the engine's resource texts.
_TILES = ('[gd_resource type="TileSet" format=3]', "", '[ext_resource type="Texture2D" path="res://tiles.png" id="1_atlas"]', "")
_SOURCE = ('[sub_resource type="TileSetAtlasSource" id="TileSetAtlasSource_0"]', 'texture = ExtResource("1_atlas")')


def vectors(*xy) -> Column:
    """PackedVector2Array(x, y, ...) of coordinate columns."""
    return F.concat(F.lit("PackedVector2Array("), F.concat_ws(", ", *(short(v) for v in xy)), F.lit(")"))


_GRID = "SELECT p_partkey AS id, p_partkey % 4 + 1 AS c, p_size % 3 + 1 AS r, 7 + p_partkey % 5 AS t, p_partkey % 2 = 0 AS solid FROM part"
_BODY = "'PackedVector2Array(' || " + " || ', ' || ".join(f"({short_sql(v)})" for v in ("-t / 2.0::DOUBLE", "-t / 2.0::DOUBLE", "t / 2.0::DOUBLE", "-t / 2.0::DOUBLE", "t / 2.0::DOUBLE", "t / 2.0::DOUBLE")) + " || ')'"
_CELL = "x || ':' || y || '/0 = 0' || CASE WHEN solid THEN chr(10) || x || ':' || y || '/0/physics_layer_0/polygon_0/points = ' || body ELSE '' END"


@query(
    "tile_set",
    f"WITH g AS ({_GRID}), b AS (SELECT *, {_BODY} AS body FROM g), k AS (SELECT b.*, i % c AS x, i // c AS y, i FROM b, (SELECT unnest(range(0, 12)) AS i) WHERE i < c * r), s AS (SELECT id, any_value(t) AS t, any_value(solid) AS solid, string_agg({_CELL}, chr(10) ORDER BY i) AS cells FROM k GROUP BY id) "
    "SELECT id, '" + "' || chr(10) || '".join(_TILES + _SOURCE) + "' || chr(10) || 'texture_region_size = Vector2i(' || t || ', ' || t || ')' || chr(10) || cells || chr(10) || chr(10) || '[resource]' || chr(10) || 'tile_size = Vector2i(' || t || ', ' || t || ')' || chr(10) || CASE WHEN solid THEN 'physics_layer_0/collision_layer = 1' || chr(10) ELSE '' END || 'sources/0 = SubResource(\"TileSetAtlasSource_0\")' || chr(10) AS text FROM s",
)
def tile_set(spark, sf):
    """Every cell of a sheet of c by r tiles declared; a solid tile has a body, whose points are measured from its centre."""
    k = F.col("p_partkey")
    d = X.table(spark, sf, "part").select(k.alias("id"), (k % 4 + 1).cast("int").alias("c"), (F.col("p_size") % 3 + 1).cast("int").alias("r"), (7 + k % 5).alias("t"), (k % 2 == 0).alias("solid"))
    h = F.col("t") / 2.0
    size = text("Vector2i(", F.col("t"), ", ", F.col("t"), ")")
    d = d.select("id", size.alias("size"), "solid", F.sequence(F.lit(0), F.col("c") * F.col("r") - 1).alias("cells"), "c", vectors(-h, -h, h, -h, h, h).alias("body"))

    def cell(i):
        at = text(i % F.col("c"), ":", F.floor(i / F.col("c")), "/0")
        return F.concat(at, F.lit(" = 0"), F.when(F.col("solid"), F.concat(F.lit("\n"), at, F.lit("/physics_layer_0/polygon_0/points = "), F.col("body"))).otherwise(""))

    cells = F.array_join(F.transform("cells", cell), "\n")
    region, tile = (F.concat(F.lit(f"{n} = "), F.col("size")) for n in ("texture_region_size", "tile_size"))
    layer = F.when(F.col("solid"), "physics_layer_0/collision_layer = 1")
    return d.select("id", lines(*_TILES, *_SOURCE, region, cells, "", "[resource]", tile, layer, 'sources/0 = SubResource("TileSetAtlasSource_0")', "").alias("text"))


def terrain_cells(spark):
    """(k, col, row, lines) of the 47 cells, eight a row, each with the lines that declare it and its neighbours' bits."""
    from pyspark.sql import Window

    k = F.col("k")
    d = spark.range(256).select(F.col("id").alias("k")).where(legal(k))
    d = d.withColumn("i", F.row_number().over(Window.orderBy("k")) - 1).select("k", "i", (F.col("i") % 8).alias("col"), F.floor(F.col("i") / 8).alias("row"))
    at = text(F.col("col"), ":", F.col("row"), "/0")
    bits = [F.when(F.shiftright(k, BIT[n]) % 2 == 1, F.concat(at, F.lit(f"/terrains_peering_bit/{n} = 0"))) for n in NEIGHBOURS]
    return d.select("k", "i", "col", "row", lines(*(F.concat(at, F.lit(e)) for e in (" = 0", "/terrain_set = 0", "/terrain = 0")), *bits).alias("lines"))


_BITS_SQL = " || ".join(f"CASE WHEN (k >> {BIT[n]}) & 1 = 1 THEN chr(10) || a || '/terrains_peering_bit/{n} = 0' ELSE '' END" for n in NEIGHBOURS)
TERRAIN_SQL = f"v AS (SELECT k, row_number() OVER (ORDER BY k) - 1 AS i FROM (SELECT unnest(range(0, 256)) AS k) q WHERE {_LEGAL}), w AS (SELECT k, i, (i % 8) || ':' || (i // 8) || '/0' AS a FROM v), cel AS (SELECT k, i, a || ' = 0' || chr(10) || a || '/terrain_set = 0' || chr(10) || a || '/terrain = 0' || {_BITS_SQL} AS l FROM w)"


@query("tile_set_terrain", f"WITH {TERRAIN_SQL} SELECT i, k, l AS lines FROM cel")
def tile_set_terrain(spark, sf):
    return terrain_cells(spark).select(F.col("i").cast("long").alias("i"), "k", "lines")


@query(
    "canvas_texture",
    "SELECT p_partkey AS id, '[gd_resource type=\"CanvasTexture\" format=3]' || chr(10) || chr(10) || '[ext_resource type=\"Texture2D\" path=\"res://d' || p_partkey || '.png\" id=\"1_diffuse\"]' || chr(10)"
    " || CASE WHEN n THEN '[ext_resource type=\"Texture2D\" path=\"res://n.png\" id=\"2_normal\"]' || chr(10) ELSE '' END || CASE WHEN s THEN '[ext_resource type=\"Texture2D\" path=\"res://s.png\" id=\"' || CASE WHEN n THEN 3 ELSE 2 END || '_specular\"]' || chr(10) ELSE '' END"
    " || chr(10) || '[resource]' || chr(10) || 'diffuse_texture = ExtResource(\"1_diffuse\")' || chr(10) || CASE WHEN n THEN 'normal_texture = ExtResource(\"2_normal\")' || chr(10) ELSE '' END || CASE WHEN s THEN 'specular_texture = ExtResource(\"' || CASE WHEN n THEN 3 ELSE 2 END || '_specular\")' || chr(10) ELSE '' END"
    " || CASE WHEN p_partkey % 5 > 0 THEN 'specular_shininess = ' || (p_size // 10) || '.' || (p_size % 10) || chr(10) ELSE '' END || CASE WHEN p_partkey % 7 > 3 THEN 'texture_filter = 1' || chr(10) ELSE '' END || CASE WHEN p_partkey % 11 > 5 THEN 'texture_repeat = 2' || chr(10) ELSE '' END AS text"
    " FROM (SELECT *, p_partkey % 2 = 0 AS n, p_partkey % 3 = 0 AS s FROM part) q",
)
def canvas_texture(spark, sf):
    """Colour, normal and specular maps bound together; resources are numbered in the order in which there are any. 1 is nearest, 2 is repeat."""
    k = F.col("p_partkey")
    normal, specular = k % 2 == 0, k % 3 == 0
    number = F.when(normal, "3").otherwise("2")
    ext = lambda path, name: text('[ext_resource type="Texture2D" path="res://', path, '.png" id="', name, '"]')
    return X.table(spark, sf, "part").select(
        k.alias("id"),
        lines(
            *('[gd_resource type="CanvasTexture" format=3]', "", ext(F.concat(F.lit("d"), k.cast("string")), "1_diffuse"), F.when(normal, ext("n", "2_normal")), F.when(specular, ext("s", F.concat(number, F.lit("_specular"))))),
            *("", "[resource]", 'diffuse_texture = ExtResource("1_diffuse")', F.when(normal, 'normal_texture = ExtResource("2_normal")'), F.when(specular, text('specular_texture = ExtResource("', number, '_specular")'))),
            *(F.when(k % 5 > 0, F.format_string("specular_shininess = %.1f", F.col("p_size") / 10.0)), F.when(k % 7 > 3, "texture_filter = 1"), F.when(k % 11 > 5, "texture_repeat = 2"), ""),
        ).alias("text"),
    )


@query("import_preset", "SELECT p_partkey AS id, '[params]' || chr(10) || chr(10) || 'compress/mode=0' || chr(10) || 'mipmaps/generate=false' || chr(10) || 'process/fix_alpha_border=' || CASE WHEN p_partkey % 2 = 0 THEN 'false' ELSE 'true' END || chr(10) || 'detect_3d/compress_to=0' || CASE WHEN p_partkey % 3 = 0 THEN chr(10) || 'compress/normal_map=1' || chr(10) || 'process/normal_map_invert_y=false' ELSE '' END || chr(10) AS text FROM part")
def import_preset(spark, sf):
    """Lossless, without mipmaps or 3D detection; borders are not bled for pixel art (even ids), normal maps (thirds) are marked."""
    k = F.col("p_partkey")
    border = F.concat(F.lit("process/fix_alpha_border="), F.when(k % 2 == 0, "false").otherwise("true"))
    normal = [F.when(k % 3 == 0, v) for v in ("compress/normal_map=1", "process/normal_map_invert_y=false")]
    return X.table(spark, sf, "part").select(k.alias("id"), lines("[params]", "", "compress/mode=0", "mipmaps/generate=false", border, "detect_3d/compress_to=0", *normal, "").alias("text"))


POINT_SQL = [f"CAST(embedding[{i}] AS DOUBLE) * 16" for i in range(1, 9)]
OCCLUDER_SQL = "'[gd_resource type=\"OccluderPolygon2D\" format=3]' || chr(10) || chr(10) || '[resource]' || chr(10) || 'polygon = PackedVector2Array(' || " + " || ', ' || ".join(f"({short_sql(p)})" for p in POINT_SQL) + " || ')' || chr(10)"


def occluder() -> Column:
    return lines('[gd_resource type="OccluderPolygon2D" format=3]', "", "[resource]", F.concat(F.lit("polygon = "), vectors(*(F.get("embedding", i).cast("double") * 16 for i in range(8)))), "")


@query("occluder_polygon", f"SELECT vec_id AS image_id, {OCCLUDER_SQL} AS text FROM embeddings")
def occluder_polygon(spark, sf):
    return X.table(spark, sf, "embeddings").select(F.col("vec_id").alias("image_id"), occluder().alias("text"))


_LAYER = "'    <path' || chr(10) || '        android:fillColor=\"' || CASE WHEN vec_id % 3 = 0 THEN '#FFFFFFFF' ELSE '@color/ink_' || ord END || '\"' || chr(10) || '        android:fillType=\"' || CASE WHEN (vec_id + ord) % 2 = 0 THEN 'nonZero' ELSE 'evenOdd' END || '\"' || chr(10) || '        android:pathData=\"M' || ord || ' 0H' || (vec_id % 9) || 'Z\" />'"


@query("android_drawable", f"WITH {X.PALETTE_SQL}, l AS (SELECT vec_id, string_agg({_LAYER}, chr(10) ORDER BY ord) AS p FROM embeddings, pal WHERE (vec_id + ord) % 4 > 0 GROUP BY vec_id), z AS (SELECT vec_id AS image_id, 20 + vec_id % 30 AS w, 30 + vec_id % 7 AS h, p FROM l) SELECT image_id, '<?xml version=\"1.0\" encoding=\"utf-8\"?>' || chr(10) || '<vector xmlns:android=\"http://schemas.android.com/apk/res/android\"' || chr(10) || '    android:width=\"' || CAST(floor(w * (48.0::DOUBLE / greatest(w, h)) + 0.5) AS BIGINT) || 'dp\"' || chr(10) || '    android:height=\"' || CAST(floor(h * (48.0::DOUBLE / greatest(w, h)) + 0.5) AS BIGINT) || 'dp\"' || chr(10) || '    android:viewportWidth=\"' || w || '\"' || chr(10) || '    android:viewportHeight=\"' || h || '\">' || chr(10) || p || chr(10) || '</vector>' || chr(10) AS text FROM z")
def android_drawable(spark, sf, size: int = 48):
    """A drawable of the layers that have a path, in colour resources or, for themed icons (thirds), all white."""
    v = F.col("vec_id")
    w, h = 20 + v % 30, 30 + v % 7
    dp = lambda n: F.floor(n * (float(size) / F.greatest(w, h)) + 0.5)

    def layer(i):
        colour = F.when(v % 3 == 0, "#FFFFFFFF").otherwise(f"@color/ink_{i}")
        rule = F.when((v + i) % 2 == 0, "nonZero").otherwise("evenOdd")
        return F.when((v + i) % 4 > 0, text('    <path\n        android:fillColor="', colour, '"\n        android:fillType="', rule, f'"\n        android:pathData="M{i} 0H', v % 9, 'Z" />'))

    head = text('<vector xmlns:android="http://schemas.android.com/apk/res/android"\n    android:width="', dp(w), 'dp"\n    android:height="', dp(h), 'dp"\n    android:viewportWidth="', w, '"\n    android:viewportHeight="', h, '">')
    return X.table(spark, sf, "embeddings").select(v.alias("image_id"), lines('<?xml version="1.0" encoding="utf-8"?>', head, *map(layer, range(len(X.PALETTE))), "</vector>", "").alias("text"))


def move_path(d: Column, s: Column, tx: Column, ty: Column) -> Column:
    """Path text under x' = s x + tx, y' = s y + ty, in two decimals; null for a command other than M, L, H, V, C and Z.

    The place of a number among its command's says which axis it is of; H and V have one axis only.
    """
    tokens = F.regexp_extract_all(d, F.lit(r"([A-Za-z]|-?[0-9]*\.?[0-9]+)"), F.lit(1))
    zero = F.struct(F.lit("").alias("out"), F.lit("").alias("cmd"), F.lit(0).alias("n"))

    def step(acc, t):
        letter = t.rlike("^[A-Za-z]$")
        down = (acc["cmd"] == "V") | ((acc["cmd"] != "H") & (acc["n"] % 2 == 1))
        number = short(s * t.try_cast("double") + F.when(down, ty).otherwise(tx))
        gap = F.when(acc["n"] > 0, " ").otherwise("")
        out = F.when(letter & ~F.upper(t).isin(*"MLHVCZ"), F.lit(None)).when(letter, F.concat(acc["out"], F.upper(t))).otherwise(F.concat(acc["out"], gap, number))
        return F.struct(out.alias("out"), F.when(letter, F.upper(t)).otherwise(acc["cmd"]).alias("cmd"), F.when(letter, 0).otherwise(acc["n"] + 1).alias("n"))

    return F.aggregate(tokens, zero, step, lambda acc: acc["out"])


_XY = {n: f"({short_sql(f'(0.5::DOUBLE + p_size % 4) * {e} + ' + ('p_partkey % 13' if ax == 'x' else '-3'))})" for n, e, ax in (("a", "(p_partkey % 7)", "x"), ("b", "(-(p_partkey % 5))", "y"), ("c", "(p_size / 4.0::DOUBLE)", "x"), ("d", "2.5::DOUBLE", "y"), ("e", "9", "x"), ("f", "-1", "y"), ("g", "1", "x"), ("h", "2", "y"), ("i", "3", "x"), ("j", "4", "y"), ("k", "5", "x"), ("l", "6", "y"))}


@query("transform_path", "SELECT p_partkey AS id, CASE WHEN p_partkey % 10 = 9 THEN NULL ELSE 'M' || " + " || ' ' || ".join((_XY["a"], _XY["b"])) + " || 'L' || " + " || ' ' || ".join((_XY["c"], _XY["d"])) + " || 'H' || " + _XY["e"] + " || 'V' || " + _XY["f"] + " || 'C' || " + " || ' ' || ".join(_XY[n] for n in "ghijkl") + " || 'Z' END AS d FROM part")
def transform_path(spark, sf):
    k, z = F.col("p_partkey"), F.col("p_size")
    d = text("M", k % 7, " -", k % 5, "L", F.format_string("%.2f", z / 4.0), ",2.5 H9V-1 C1 2 3 4 5 6", F.when(k % 10 == 9, "A").otherwise(""), "z")
    return X.table(spark, sf, "part").select(k.alias("id"), move_path(d, 0.5 + z % 4, (k % 13).cast("double"), F.lit(-3.0)).alias("d"))


def escaped(s: Column) -> Column:
    for c, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        s = F.replace(s, F.lit(c), F.lit(name))
    return F.coalesce(s, F.lit(""))


def relative(start: Column, file: Column) -> Column:
    """The path from one folder to a file, both absolute and without `.` and `..`."""
    a, b = (F.filter(F.split(p, "/"), lambda x: x != "") for p in (start, file))
    both = F.arrays_zip(a.alias("a"), b.alias("b"))
    same = F.aggregate(both, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda acc, p: F.struct((acc["n"] + F.when(acc["on"] & (p["a"] == p["b"]), 1).otherwise(0)).alias("n"), F.coalesce(acc["on"] & (p["a"] == p["b"]), F.lit(False)).alias("on")), lambda acc: acc["n"])
    up = F.array_repeat(F.lit(".."), F.size(a) - same)
    return F.array_join(F.concat(up, F.slice(b, same + 1, F.size(b))), "/")


@query("report_sources", "SELECT p_partkey AS id, CASE WHEN p_partkey % 9 = 0 THEN '' WHEN p_partkey % 5 = p_size % 5 THEN '../img/x.png' ELSE '../../r' || (p_size % 5) || '/img/x.png' END AS src, replace(replace(replace(p_name || ' <&\"''>', '&', '&amp;'), '<', '&lt;'), '>', '&gt;').replace('\"', '&quot;').replace('''', '&#39;') AS label FROM part")
def report_sources(spark, sf):
    """Where a report finds a picture, relative to itself, and a label's escapes; no picture has no source."""
    k = F.col("p_partkey")
    src = F.when(k % 9 == 0, "").otherwise(relative(text("/runs/r", k % 5, "/report"), text("/runs//r", F.col("p_size") % 5, "/img/x.png")))
    return X.table(spark, sf, "part").select(k.alias("id"), src.alias("src"), escaped(F.concat("p_name", F.lit(" <&\"'>"))).alias("label"))


@query("facts_table", f"WITH {X.PIXELS}, f AS (SELECT image_id, count(*) FILTER (a >= 128) / 16.0::DOUBLE AS fill, count(DISTINCT r * 65536 + g * 256 + b) FILTER (a >= 128) AS colours, string_agg(DISTINCT CASE WHEN x = 0 THEN '1left' WHEN y = 0 THEN '2top' WHEN x = 3 THEN '3right' WHEN y = 3 THEN '4bottom' END, '') FILTER (a >= 128) AS s, bool_or(x = 0 AND a >= 128) AS l, bool_or(y = 0 AND a >= 128) AS t, bool_or(x = 3 AND a >= 128) AS r, bool_or(y = 3 AND a >= 128) AS b FROM pix GROUP BY image_id) SELECT image_id, '<table><tr><th>Touches edge</th><td>' || CASE WHEN l OR t OR r OR b THEN concat_ws(', ', CASE WHEN l THEN 'left' END, CASE WHEN t THEN 'top' END, CASE WHEN r THEN 'right' END, CASE WHEN b THEN 'bottom' END) ELSE 'no' END || '</td></tr><tr><th>Fill</th><td>' || CAST(floor(fill * 100 + 0.5) AS BIGINT) || '%</td></tr><tr><th>Colours</th><td>' || colours || '</td></tr></table>' AS html FROM f")
def facts_table(spark, sf, least: int = 128):
    """A picture's measured facts as rows of a table; everything is read off its own array."""
    at = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda p: F.struct(p.alias("p"), F.slice("data", p * 4 + 1, 4).alias("c")))
    d = X.packed(spark, sf).select("image_id", F.filter(at, lambda e: e["c"][3] >= least).alias("on"))
    touch = lambda test: F.exists("on", lambda e: test(e["p"]))
    sides = F.concat_ws(", ", *(F.when(touch(f), n) for n, f in (("left", lambda p: p % 4 == 0), ("top", lambda p: p < 4), ("right", lambda p: p % 4 == 3), ("bottom", lambda p: p >= 12))))
    rows = (("Touches edge", F.when(sides == "", "no").otherwise(sides)), ("Fill", text(F.floor(F.size("on") / 16.0 * 100 + 0.5), "%")), ("Colours", F.size(F.array_distinct(F.transform("on", lambda e: F.slice(e["c"], 1, 3)))).cast("string")))
    return d.select("image_id", text("<table>", *(F.concat(F.lit(f"<tr><th>{n}</th><td>"), escaped(v), F.lit("</td></tr>")) for n, v in rows), "</table>").alias("html"))


@query("thinking_setting", "SELECT id, CASE WHEN budget IS NULL AND (level IS NULL) AND NOT notes THEN NULL ELSE '{' || concat_ws(',', CASE WHEN budget IS NOT NULL THEN '\"thinkingBudget\":' || budget WHEN level = 'off' THEN '\"thinkingBudget\":0' WHEN level IS NOT NULL THEN '\"thinkingLevel\":\"' || level || '\"' END, CASE WHEN notes THEN '\"includeThoughts\":true' END) || '}' END AS setting FROM (SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN p_size END AS budget, CASE p_partkey % 3 WHEN 0 THEN 'off' WHEN 1 THEN 'low' END AS level, p_partkey % 5 = 0 AS notes FROM part) q")
def thinking_setting(spark, sf):
    """A budget beats a level, `off` is a budget of none, and nothing set leaves the model's default."""
    k = F.col("p_partkey")
    budget, level, notes = F.when(k % 4 == 0, F.col("p_size").cast("int")), F.when(k % 3 == 0, "off").when(k % 3 == 1, "low"), F.when(k % 5 == 0, True)
    level = F.when(budget.isNull(), level)
    setting = F.to_json(F.struct(F.coalesce(budget, F.when(level == "off", 0)).alias("thinkingBudget"), F.when(level != "off", level).alias("thinkingLevel"), notes.alias("includeThoughts")))
    return X.table(spark, sf, "part").select(k.alias("id"), F.when(setting != "{}", setting).alias("setting"))


@query("plan_problems", "SELECT p_partkey AS id, concat_ws(',', CASE WHEN subjects < 0 OR subjects <> floor(subjects) THEN 'subjects' END, CASE WHEN n IS NOT NULL AND (n < 1 OR n <> floor(n)) THEN 'count' END, CASE WHEN name = '' THEN 'name' END, CASE WHEN frames < 1 OR frames > 24 OR frames <> floor(frames) THEN 'frames' END) AS problems FROM (SELECT p_partkey, (p_partkey % 9 - 1) / CASE WHEN p_partkey % 7 = 0 THEN 2.0::DOUBLE ELSE 1 END AS subjects, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey % 5 AS DOUBLE) END AS n, CASE WHEN p_partkey % 11 = 0 THEN '' ELSE p_name END AS name, p_size / CASE WHEN p_partkey % 13 = 0 THEN 2.0::DOUBLE ELSE 1 END AS frames FROM part) q")
def plan_problems(spark, sf, most: int = 24):
    """What is wrong with a work plan: whole numbers in range, and actions with a name."""
    k = F.col("p_partkey")
    subjects, n = (k % 9 - 1) / F.when(k % 7 == 0, 2.0).otherwise(1.0), F.when(k % 2 == 0, (k % 5).cast("double"))
    frames, name = F.col("p_size") / F.when(k % 13 == 0, 2.0).otherwise(1.0), F.when(k % 11 == 0, "").otherwise(F.col("p_name"))
    whole = lambda v, low: (v == F.floor(v)) & (v >= low)
    rules = (("subjects", whole(subjects, 0)), ("count", F.coalesce(whole(n, 1), F.lit(True))), ("name", name != ""), ("frames", whole(frames, 1) & (frames <= most)))
    return X.table(spark, sf, "part").select(k.alias("id"), F.concat_ws(",", *(F.when(~ok, r) for r, ok in rules)).alias("problems"))
