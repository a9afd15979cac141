"""Queries that read written texts back and hold them to what was recorded; a failure is a row, not an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.numbers import half_up
from tessera.plans import fixtures as X
from tessera.plans.assets import text
from tessera.plans.exports import lines, vectors
from tessera.plans.registry import ORACLES, QUERIES, query
from tessera.plans.terrain import BIT, CORNERS, NEIGHBOURS, _LEGAL

#: The keys of the set's cells, and of each cell the bits it declares, in order.
KEYS = [k for k in range(256) if all(not k >> b & 1 or k & need == need for b, need in CORNERS.items())]
DECLARED = [[n for n in NEIGHBOURS if k >> BIT[n] & 1] for k in KEYS]


def _cell(i: int, bits: list[str]) -> list[str]:
    """The lines that declare the i-th cell, put it in the terrain and give its bits; eight cells a row."""
    at = f"{i % 8}:{i // 8}/0"
    return [f"{at} = 0", f"{at}/terrain_set = 0", f"{at}/terrain = 0", *(f"{at}/terrains_peering_bit/{b} = 0" for b in bits)]


def terrain_text() -> str:
    """The declarations of a whole terrain set: a constant of some ten kilobytes."""
    return "\n".join(["terrain_set_0/mode = 0", *(line for i, bits in enumerate(DECLARED) for line in _cell(i, bits))]) + "\n"


def _texts(k: Column) -> Column:
    """The terrain text less a cell's first bit, nothing, a cell's terrain or a cell, by k % 4; the cell by k % 47."""
    whole, cuts = "\n" + terrain_text(), []
    for n in range(4 * len(KEYS)):
        cell = _cell(n % len(KEYS), DECLARED[n % len(KEYS)])
        gone = ([*cell, ""][3], "", cell[2], cell[0])[n % 4]
        cuts.append((whole.index(f"\n{gone}\n"), len(gone) + 1) if gone else (0, 0))
    start, size = (F.get(F.lit([cut[j] for cut in cuts]), (k % len(cuts)).cast("int")) for j in (0, 1))
    # Cut as bytes: the text is ASCII, and characters would be counted from its beginning.
    t = F.lit(whole.encode())
    return F.concat(F.substr(t, F.lit(1), start), F.substr(t, start + size + 1, F.lit(len(whole)))).cast("string")


#: How the line that declares a cell ends, and the set's text cut there: each stretch ends in the next cell's place.
DECLARES = "/0 = 0\n"
STRETCHES = f"{terrain_text()}\n".split(DECLARES)


def check_tiles(d: DataFrame) -> DataFrame:
    """(id, tiles, outside, wrong, ok) of the terrain texts of d (id, t).

    A text is cut where it declares a cell. Stretches that are the set's own need no further look; lines of the others,
    and of the set's that are missing, are taken from one another. So a text takes time by its length.
    """
    own, ends = F.lit(STRETCHES), "[\n\r\u0085\u2028\u2029]"
    d = d.select("id", F.split(F.concat("t", F.lit("\n")), DECLARES).alias("cut"))
    # Most stretches are where the set has them and end in a cell's place; the last, which ends in none, goes with the others.
    apart = F.filter(F.arrays_zip(own.alias("own"), F.col("cut")), lambda z: ~z["own"].eqNullSafe(z["cut"]) | (z["own"] == STRETCHES[-1]))
    d = d.select("id", "cut", apart.alias("apart"))
    less, more = (F.array_compact(F.col("apart")[side]) for side in ("own", "cut"))
    d = d.select("id", "cut", (F.greatest(F.size("cut"), F.size(own)) - F.size("apart")).alias("same"), more.alias("other"), F.array_except(less, more).alias("less"), F.array_except(more, less).alias("more"))
    # Another stretch ends in a place too, unless a line ends in another way or only ends like a cell's.
    places = F.col("same") + F.size(F.filter("other", lambda s: F.substring_index(s, "\n", -1).rlike(r"^\d+:\d+$")))
    tiles = F.when(F.array_join("more", "").rlike("[\r\u0085\u2028\u2029]"), F.regexp_count(F.array_join("cut", DECLARES), F.lit(r"(?m)^\d+:\d+/0 = 0$"))).otherwise(places)
    lines = lambda a: F.split(F.concat(F.array_join(a, DECLARES), F.lit(DECLARES)), ends)
    d = d.select("id", tiles.cast("long").alias("tiles"), lines("less").alias("less"), lines("more").alias("more"))
    # Lines of the set that the text lacks, and lines of the text that the set lacks.
    d = d.select("id", "tiles", F.array_except("less", "more").alias("lost"), F.array_except("more", "less").alias("odd"))
    every = F.lit([line for i, bits in enumerate(DECLARED) for line in _cell(i, bits)])
    d = d.withColumn("odd", F.when(F.size("odd") > 0, F.array_except("odd", every)).otherwise(F.col("odd")))

    def at(ls, *of):
        """The cells of those of the lines that are of these kinds."""
        return F.transform(F.filter(ls, lambda s: s.rlike(rf"^\d+:\d+/0({'|'.join(of)}) = 0$")), lambda s: F.substring_index(s, "/", 1))

    painted, bit = ("/terrain_set", "/terrain"), r"/terrains_peering_bit/\w+"
    unpainted = F.array_except(at("odd", ""), F.array_intersect(*(at("odd", of) for of in painted)))
    outside = F.array_union(F.array_except(at("lost", *painted), at("lost", "")), unpainted)
    # Bits of a cell that is not declared count for nothing; a cell of the set that is not declared is wrong as it is.
    cells = F.lit([f"{i % 8}:{i // 8}" for i in range(len(KEYS))])
    wrong = F.array_union(at("lost", "", bit), F.array_intersect(at("odd", bit), F.concat(cells, at("odd", ""))))
    d = d.select("id", "tiles", F.size(outside).cast("long").alias("outside"), F.size(wrong).cast("long").alias("wrong"))
    return d.withColumn("ok", (F.col("tiles") == len(KEYS)) & (F.col("outside") == 0) & (F.col("wrong") == 0))


@query("recheck_tile_set", f"WITH v AS (SELECT row_number() OVER (ORDER BY k) - 1 AS i, bit_count(k) AS n FROM (SELECT unnest(range(0, 256)) AS k) q WHERE {_LEGAL}), p AS (SELECT p_partkey AS id, p_partkey % 4 AS m, p_partkey % 47 AS i FROM part) SELECT id, CASE WHEN m = 3 THEN 46 ELSE 47 END AS tiles, CAST(m = 2 AS BIGINT) AS outside, CAST(CASE m WHEN 0 THEN n > 0 WHEN 3 THEN true ELSE false END AS BIGINT) AS wrong, CASE m WHEN 1 THEN true WHEN 0 THEN n = 0 ELSE false END AS ok FROM p JOIN v USING (i)")
def recheck_tile_set(spark, sf):
    """Every cell of a terrain text is declared, is in the terrain and has the bits of the shape drawn there.

    Of the texts a quarter lack a bit, a quarter are whole, a quarter lack a cell's terrain and a quarter a cell.
    """
    # A million ids are a few megabytes, which are read in a task or two; the texts made of them are ten gigabytes.
    ids = X.table(spark, sf, "part").select(F.col("p_partkey").alias("id")).repartition(4 * spark.sparkContext.defaultParallelism)
    return check_tiles(ids.select("id", _texts(F.col("id")).alias("t")))


def pairs(t: Column) -> Column:
    """The numbers of the first PackedVector2Array of a text; null where there is none or one isn't a number."""
    raw = F.regexp_extract(t, r"(?m)^polygon = PackedVector2Array\(([^)]*)\)$", 1)
    numbers = F.transform(F.split(raw, r",\s*"), lambda s: s.try_cast("double"))
    return F.when((raw != "") & ~F.exists(numbers, lambda n: n.isNull()), numbers)


@query("recheck_occluder", "SELECT vec_id AS image_id, CASE WHEN vec_id % 7 = 0 THEN 0 WHEN vec_id % 5 = 0 THEN 7 ELSE 8 END AS numbers, vec_id % 7 > 0 AND vec_id % 5 > 0 AS parses, vec_id % 7 > 0 AND vec_id % 5 > 0 AND vec_id % 3 > 0 AS matches FROM embeddings")
def recheck_occluder(spark, sf, within: float = 0.01):
    """An occluder's polygon parses into three points or more and is the first shape, within a hundredth.

    Of the texts a seventh have no polygon, a fifth half a point, and a third a point elsewhere.
    """
    v = F.col("vec_id")
    first = F.transform(F.slice("embedding", 1, 8), lambda e: half_up(e.cast("double") * 16, 2))
    moved = [F.get("embedding", i).cast("double") * 16 + (F.when(v % 3 == 0, 0.25).otherwise(0.0) if i == 3 else 0) for i in range(8)]
    polygon = F.when(v % 5 == 0, vectors(*moved[:7])).otherwise(vectors(*moved))
    t = lines('[gd_resource type="OccluderPolygon2D" format=3]', "", "[resource]", F.when(v % 7 > 0, F.concat(F.lit("polygon = "), polygon)), "")
    d = X.table(spark, sf, "embeddings").select(v.alias("image_id"), pairs(t).alias("got"), first.alias("first"))
    parses = F.coalesce((F.size("got") % 2 == 0) & (F.size("got") >= 6), F.lit(False))
    near = F.forall(F.zip_with("got", "first", lambda a, b: F.coalesce(F.abs(a - b) < within, F.lit(False))), lambda ok: ok)
    return d.select("image_id", F.coalesce(F.size("got"), F.lit(0)).cast("long").alias("numbers"), parses.alias("parses"), F.coalesce(parses & near, F.lit(False)).alias("matches"))


@query("recheck_svg", "SELECT p_partkey AS id, p_partkey % 4 > 0 AS size_ok, CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE 2 END AS paths, CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE 3 + p_size % 3 + 4 END AS points, p_partkey % 7 > 0 AND p_partkey % 5 > 0 AS geometry_ok FROM part")
def recheck_svg(spark, sf):
    """A vector file has the size that was recorded and paths that all parse into points.

    Of the texts a quarter have another size, a seventh no paths, and a fifth a command that no path has.
    """
    k, z = F.col("p_partkey"), F.col("p_size")
    more = F.array_join(F.transform(F.sequence(F.lit(1), (z % 3).cast("int")), lambda i: text("L", i, " ", i * 2)), "")
    one = F.concat(F.lit("M0 0L4 0L4 4"), F.when(z % 3 > 0, more).otherwise(""), F.lit("Z"))
    two = F.concat(F.lit("M1,1 L2 1H3V9"), F.when(k % 5 == 0, "Q").otherwise(""), F.lit("Z"))
    paths = F.when(k % 7 > 0, F.concat(F.lit('<path d="'), one, F.lit('"/><path fill="#000" d="'), two, F.lit('"/>'))).otherwise("")
    svg = F.concat(F.lit('<svg viewBox="0 0 '), F.when(k % 4 == 0, "12.5").otherwise("12"), F.lit(' 16">'), paths, F.lit("</svg>"))
    d = X.table(spark, sf, "part").select(k.alias("id"), svg.alias("t"))
    box = [F.regexp_extract("t", r'viewBox="0 0 ([\d.]+) ([\d.]+)"', i).try_cast("double") for i in (1, 2)]
    d = d.select("id", F.coalesce((box[0] == 12) & (box[1] == 16), F.lit(False)).alias("size_ok"), F.regexp_extract_all("t", F.lit(r' d="([^"]*)"'), F.lit(1)).alias("ds"))
    known = F.forall("ds", lambda s: s.rlike(r"^(\s*([MLHVCZz]|-?\d*\.?\d+)[\s,]*)+$"))
    # M and L take two numbers a point, H and V one.
    points = F.aggregate("ds", F.lit(0), lambda acc, s: acc + F.regexp_count(s, F.lit(r"[ML][^A-Za-z]+")) + F.regexp_count(s, F.lit(r"[HV][^A-Za-z]+")))
    return d.select("id", "size_ok", F.size("ds").cast("long").alias("paths"), points.cast("long").alias("points"), (known & (points > 0)).alias("geometry_ok"))


_PIVOT = "map<string,struct<sourceSize:struct<w:double,h:double>,pivot:struct<x:double,y:double>,anchor:struct<x:double,y:double>>>"


@query("recheck_pivot", "SELECT p_partkey AS id, 2 AS frames, CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 0 END AS wrong, p_partkey % 6 > 0 AS header_ok, p_partkey % 4 > 0 AND p_partkey % 6 > 0 AS ok FROM part")
def recheck_pivot(spark, sf):
    """Every frame's pivot and anchor, and the header's, put the frame where the record says; a quarter and a sixth don't."""
    k, z = F.col("p_partkey"), F.col("p_size")
    px, py, h = (k % 31) / 2.0, (z % 40).cast("double"), 40 + z % 9
    share = lambda v, of: half_up(v / of, 4)

    def frame(name, w, off):
        x, y = share(px, w), share(py, h)
        at = lambda a: text('{"x":', a, ',"y":', y, "}")
        return text(f'"{name}":{{"sourceSize":{{"w":', w, ',"h":', h, '},"pivot":', at(x), ',"anchor":', at(x + off), "}")

    json = text('{"frames":{', frame("a0", F.lit(32), F.lit(0.0)), ",", frame("a1", 16 + k % 5, F.when(k % 4 == 0, 0.01).otherwise(0.0)), "}}")
    header = F.concat(F.lit("static const float A_PIVOT_X = "), F.format_string("%.1f", px + F.when(k % 6 == 0, 0.5).otherwise(0.0)), F.lit("f;\nstatic const float A_PIVOT_Y = "), F.format_string("%.1f", py), F.lit("f;"))
    d = X.table(spark, sf, "part").select(k.alias("id"), px.alias("px"), py.alias("py"), json.alias("json"), header.alias("header"))
    d = d.select("*", F.map_values(F.from_json("json", f"frames {_PIVOT}")["frames"]).alias("frames"))
    px, py = F.col("px"), F.col("py")

    def wrong(f):
        x, y = share(px, f["sourceSize"]["w"]), share(py, f["sourceSize"]["h"])
        off = lambda n: F.when((f[n]["x"] == x) & (f[n]["y"] == y), 0).otherwise(1)
        return off("pivot") + off("anchor")

    said = [F.regexp_extract("header", rf"_PIVOT_{a} = ([-\d.]+)f;", 1).try_cast("double") for a in "XY"]
    bad = F.aggregate("frames", F.lit(0), lambda acc, f: acc + wrong(f))
    d = d.select("id", F.size("frames").cast("long").alias("frames"), bad.cast("long").alias("wrong"), F.coalesce((said[0] == half_up(px, 1)) & (said[1] == half_up(py, 1)), F.lit(False)).alias("header_ok"))
    return d.withColumn("ok", (F.col("frames") > 0) & (F.col("wrong") == 0) & F.col("header_ok"))


#: The re-checks of a run: the query, its id column and the columns that have to be true.
CHECKS = (
    ("points", "recheck_points", "image_id", ("ok",)), ("occluder", "recheck_occluder", "image_id", ("parses", "matches")), ("svg", "recheck_svg", "id", ("size_ok", "geometry_ok")),
    ("pivot", "recheck_pivot", "id", ("ok",)), ("tile_set", "recheck_tile_set", "id", ("ok",)), ("normal", "recheck_normal", "image_id", ("ok",)), ("trim", "restore_frame", "image_id", ("verdict <> 'moved'",)),
)


def _run_sql() -> str:
    return " UNION ALL ".join(f"SELECT '{kind}' AS kind, {key} AS id, '{c.split(' ')[0]}' AS check, {c} AS ok FROM ({ORACLES[name]}) q{i}" for i, (kind, name, key, cols) in enumerate(CHECKS) for c in cols)


def _register() -> None:
    from tessera.plans import rechecks  # noqa: F401

    @query("check_run", _run_sql())
    def check_run(spark, sf):
        """Every re-check of a run's outputs, a row each: the gate fails if one does."""
        out = None
        for kind, name, key, cols in CHECKS:
            rows = F.inline(F.array(*(F.struct(F.lit(c.split(" ")[0]).alias("check"), F.expr(c).alias("ok")) for c in cols)))
            d = QUERIES[name](spark, sf).select(F.lit(kind).alias("kind"), F.col(key).alias("id"), rows)
            out = d if out is None else out.unionByName(d)
        return out


_register()
