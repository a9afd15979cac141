"""Queries on terrain sets: the cells, their peering bits and the pairs that can touch."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans.registry import query

#: The eight neighbours in the order in which a cell declares them, by the bit of each in a key.
NEIGHBOURS = ("right_side", "bottom_right_corner", "bottom_side", "bottom_left_corner", "left_side", "top_left_corner", "top_side", "top_right_corner")
#: Sides t, r, b, l are bits 0 to 3; corners tl, tr, br, bl are bits 4 to 7, each needing two sides.
CORNERS = {4: 0b1001, 5: 0b0011, 6: 0b0110, 7: 0b1100}
BIT = {"right_side": 1, "bottom_right_corner": 6, "bottom_side": 2, "bottom_left_corner": 7, "left_side": 3, "top_left_corner": 4, "top_side": 0, "top_right_corner": 5}

_LEGAL = " AND ".join(f"((k >> {b}) & 1 = 0 OR (k & {need}) = {need})" for b, need in CORNERS.items())


def legal(k):
    """A corner counts only with both its sides."""
    out = F.lit(True)
    for b, need in CORNERS.items():
        out = out & ((F.shiftright(k, b) % 2 == 0) | (k.bitwiseAND(F.lit(need)) == need))
    return out


@query("terrain_variants", f"SELECT k, k & 15 AS sides, bit_count(k) AS bits FROM (SELECT unnest(range(0, 256)) AS k) q WHERE {_LEGAL}")
def terrain_variants(spark, sf):
    k = F.col("k")
    return spark.range(256).select(F.col("id").alias("k")).where(legal(k)).select("k", k.bitwiseAND(F.lit(15)).alias("sides"), F.bit_count(k).alias("bits"))


@query("terrain_bits", f"SELECT k, pos, name FROM (SELECT unnest(range(0, 256)) AS k) q, (VALUES {', '.join(f'({i}, {chr(39)}{n}{chr(39)}, {BIT[n]})' for i, n in enumerate(NEIGHBOURS))}) v(pos, name, bit) WHERE {_LEGAL} AND (k >> bit) & 1 = 1")
def terrain_bits(spark, sf):
    names = F.array(*(F.struct(F.lit(i).alias("pos"), F.lit(n).alias("name"), F.lit(BIT[n]).alias("bit")) for i, n in enumerate(NEIGHBOURS)))
    d = spark.range(256).select(F.col("id").alias("k")).where(legal(F.col("k"))).select("k", names.alias("names"))
    on = F.filter("names", lambda n: F.call_function("shiftright", F.col("k"), n["bit"]) % 2 == 1)
    return d.select("k", F.inline(on)).select("k", "pos", "name")


def _window_key_sql(cx: int, cy: int, w: int, h: int, corners: bool = True) -> str:
    def on(dx: int, dy: int) -> str:
        x, y = cx + dx, cy + dy
        return f"((f >> {y * w + x}) & 1)" if 0 <= x < w and 0 <= y < h else "0"

    t, r, b, l = on(0, -1), on(1, 0), on(0, 1), on(-1, 0)
    parts = [t, f"{r} * 2", f"{b} * 4", f"{l} * 8"]
    if corners:
        parts += [f"{on(-1, -1)} * {t} * {l} * 16", f"{on(1, -1)} * {t} * {r} * 32", f"{on(1, 1)} * {b} * {r} * 64", f"{on(-1, 1)} * {b} * {l} * 128"]
    return " + ".join(parts)


def _pairs_sql(corners: bool) -> str:
    parts = []
    for across, (w, h), (bx, by) in ((True, (4, 3), (2, 1)), (False, (3, 4), (1, 2))):
        centre = f"(f >> {w + 1}) & 1 = 1 AND (f >> {by * w + bx}) & 1 = 1"
        parts.append(f"SELECT DISTINCT {str(across).lower()} AS across, {_window_key_sql(1, 1, w, h, corners)} AS a, {_window_key_sql(bx, by, w, h, corners)} AS b FROM (SELECT unnest(range(0, 4096)) AS f) q WHERE {centre}")
    return " UNION ALL ".join(parts)


def window_key(f, cx: int, cy: int, w: int, h: int, corners: bool):
    """The key of the cell at (cx, cy) of the w by h window whose squares are the bits of f."""

    def on(dx: int, dy: int):
        x, y = cx + dx, cy + dy
        return F.shiftright(f, y * w + x) % 2 if 0 <= x < w and 0 <= y < h else F.lit(0)

    t, r, b, l = on(0, -1), on(1, 0), on(0, 1), on(-1, 0)
    key = t + r * 2 + b * 4 + l * 8
    return key + on(-1, -1) * t * l * 16 + on(1, -1) * t * r * 32 + on(1, 1) * b * r * 64 + on(-1, 1) * b * l * 128 if corners else key


def touching(spark, corners: bool):
    """(across, a, b): every pair of cells that some filling of the squares around them puts side by side or one over the other."""
    f = F.col("id")
    out = None
    for across, (w, h), (bx, by) in ((True, (4, 3), (2, 1)), (False, (3, 4), (1, 2))):
        d = spark.range(1 << 12).where((F.shiftright(f, w + 1) % 2 == 1) & (F.shiftright(f, by * w + bx) % 2 == 1))
        d = d.select(F.lit(across).alias("across"), window_key(f, 1, 1, w, h, corners).alias("a"), window_key(f, bx, by, w, h, corners).alias("b")).distinct()
        out = d if out is None else out.unionByName(d)
    return out


@query("terrain_pairs", _pairs_sql(True))
def terrain_pairs(spark, sf):
    return touching(spark, True)


@query("terrain_pairs_sides", _pairs_sql(False))
def terrain_pairs_sides(spark, sf):
    return touching(spark, False)


@query("terrain_map", "WITH m AS (SELECT x, y, CASE WHEN (x * 7919 + y * 104729 + x * y * 31) % 100 < 55 THEN 1 ELSE 0 END AS o FROM (SELECT unnest(range(0, 24)) AS x), (SELECT unnest(range(0, 24)) AS y)), n AS (SELECT p.x, p.y, " + ", ".join(f"coalesce(max(q.o) FILTER (q.x = p.x + ({dx}) AND q.y = p.y + ({dy})), 0) AS {n}" for n, dx, dy in (("t", 0, -1), ("r", 1, 0), ("b", 0, 1), ("l", -1, 0), ("tl", -1, -1), ("tr", 1, -1), ("br", 1, 1), ("bl", -1, 1))) + " FROM m p JOIN m q ON abs(p.x - q.x) <= 1 AND abs(p.y - q.y) <= 1 WHERE p.o = 1 GROUP BY p.x, p.y) SELECT x, y, t + r * 2 + b * 4 + l * 8 + tl * t * l * 16 + tr * t * r * 32 + br * b * r * 64 + bl * b * l * 128 AS k FROM n")
def terrain_map(spark, sf):
    """The cell of every filled square of a map; a square hands its state to its neighbours, so one aggregation does it."""
    x, y = F.col("x"), F.col("y")
    m = spark.range(24).select(F.col("id").alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(23).cast("long"))).alias("y")).where((x * 7919 + y * 104729 + x * y * 31) % 100 < 55)
    # A filled square says so to itself (8) and, as seen from there, to each square around it.
    told = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(bit).alias("bit")) for bit, (dx, dy) in enumerate([(0, 1), (-1, 0), (0, -1), (1, 0), (1, 1), (-1, 1), (-1, -1), (1, -1), (0, 0)])))
    n = m.select("x", "y", told.alias("t")).select("x", "y", F.inline("t")).select((x + F.col("dx")).alias("x"), (y + F.col("dy")).alias("y"), F.call_function("shiftleft", F.lit(1), F.col("bit")).alias("v")).groupBy("x", "y").agg(F.sum("v").alias("v")).where("v >= 256")
    v = F.col("v")
    key = v.bitwiseAND(F.lit(15))
    for b, need in CORNERS.items():
        key = key + F.when((F.shiftright(v, b) % 2 == 1) & (v.bitwiseAND(F.lit(need)) == need), 1 << b).otherwise(0)
    return n.select("x", "y", key.alias("k"))


@query("terrain_layout", f"WITH v AS (SELECT k, row_number() OVER (ORDER BY k) - 1 AS i FROM (SELECT unnest(range(0, 256)) AS k) q WHERE {_LEGAL}) SELECT i AS index, i % 8 AS col, i // 8 AS row, k FROM v")
def terrain_layout(spark, sf, columns: int = 8):
    from pyspark.sql import Window

    v = spark.range(256).select(F.col("id").alias("k")).where(legal(F.col("k")))
    i = (F.row_number().over(Window.orderBy("k")) - 1).cast("long")
    return v.select("k", i.alias("index")).select("index", (F.col("index") % columns).alias("col"), F.floor(F.col("index") / columns).alias("row"), "k")
