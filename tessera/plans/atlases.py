"""Queries on sheets: dominant palettes and their drift, sliced strips, terrain cells and whether they join, colour names."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tessera.functions import colour as C
from tessera.functions.numbers import half_up
from tessera.plans import fixtures as X
from tessera.plans.registry import query
from tessera.plans.terrain import CORNERS, _pairs_sql, touching
from tessera.plans.text import _HEX, brief, section

LAB = "struct<L:double,a:double,b:double>"


def dominant(data: Column, count: int, merge: float = 8.0) -> Column:
    """The main colours of a picture's bytes as (lab, n), most used first, worked out in the row.

    Opaque samples fall into bins of 32 levels a channel; bins, most used first (then the one seen first), join an
    earlier colour within `merge` of them, until three times `count` colours are found.
    """
    at = F.filter(F.sequence(F.lit(0), F.size(data) - 4, F.lit(4)), lambda i: F.get(data, i + 3) >= 128)
    get = lambda i, k: F.get(data, i + k)
    key = lambda i: F.shiftright(get(i, 0), 3) * 1024 + F.shiftright(get(i, 1), 3) * 32 + F.shiftright(get(i, 2), 3)
    keyed = F.transform(at, lambda i: F.struct(key(i).alias("k"), i.alias("i")))

    def bins(ks):
        def one(k):
            own = F.filter(ks, lambda e: e["k"] == k)
            n = F.size(own)
            mean = lambda c: F.floor(F.aggregate(own, F.lit(0).cast("long"), lambda acc, e: acc + get(e["i"], c)) / n + 0.5)
            return F.struct((-n).alias("less"), F.get(own, F.lit(0))["i"].alias("first"), C.lab(mean(0), mean(1), mean(2)).alias("lab"), n.alias("n"))

        return F.array_sort(F.transform(F.array_distinct(F.transform(ks, lambda e: e["k"])), one))

    some = F.array().cast(f"array<struct<lab:{LAB},n:int>>")

    def fold(acc, b):
        near = F.transform(acc, lambda o: C.distance(o["lab"], b["lab"]) < merge)
        hit = F.array_position(near, F.lit(True)).cast("int")
        joined = F.transform(acc, lambda o, i: F.struct(o["lab"].alias("lab"), (o["n"] + F.when(i + 1 == hit, b["n"]).otherwise(0)).alias("n")))
        added = F.array_append(acc, F.struct(b["lab"].alias("lab"), b["n"].alias("n")))
        return F.when(F.size(acc) >= 3 * count, acc).when(hit > 0, joined).otherwise(added)

    found = F.aggregate(F.get(F.transform(F.array(keyed), bins), F.lit(0)), some, fold)
    ranked = F.transform(found, lambda o, i: F.struct((-o["n"]).alias("less"), i.alias("i"), o["lab"].alias("lab"), o["n"].alias("n")))
    return F.slice(F.array_sort(ranked), 1, count)


@query("dominant_palette")
def dominant_palette(spark, sf):
    d = X.packed(spark, sf).select("image_id", F.posexplode(dominant(F.col("data"), 8)).alias("place", "c"))
    return d.select("image_id", "place", *(half_up(F.col(f"c.lab.{n}"), 3).alias(o) for n, o in (("L", "lab_l"), ("a", "lab_a"), ("b", "lab_b"))), "c.n")


@query("palette_delta")
def palette_delta(spark, sf):
    """Each frame's main colours against the nearest of its action's first frame, weighted by cover; null without colours."""
    p = X.packed(spark, sf)
    first = p.groupBy("action").agg(F.min_by("data", "image_id").alias("ref"))  # a picture an action
    d = p.join(first, p["action"].eqNullSafe(first["action"])).select("image_id", "ref", "data")
    d = d.select("image_id", dominant(F.col("data"), 8).alias("mine"), dominant(F.col("ref"), 12).alias("theirs"))
    cost = F.transform("mine", lambda m: F.array_min(F.transform("theirs", lambda t: C.distance(m["lab"], t["lab"]))) * m["n"])
    total = F.aggregate(cost, F.lit(0.0), lambda acc, v: acc + v)
    weight = F.aggregate("mine", F.lit(0), lambda acc, m: acc + m["n"])
    return d.select("image_id", F.when((F.size("mine") > 0) & (F.size("theirs") > 0), half_up(total / weight, 2)).alias("delta"))


@query(
    "slice_strip",
    """WITH smp AS (SELECT vec_id AS image_id, k % 16 AS x, greatest(0, least(255, floor(CAST(embedding[k + 1] AS DOUBLE) * 512 + 128 + 0.5))) AS v FROM embeddings, (SELECT unnest(range(0, 64)) AS k)),
    ink AS (SELECT image_id, x FROM smp GROUP BY image_id, x HAVING max(v) >= 170), g AS (SELECT image_id, x, CASE WHEN x - lag(x) OVER w < 3 THEN 0 ELSE 1 END AS new FROM ink WINDOW w AS (PARTITION BY image_id ORDER BY x)),
    u AS (SELECT image_id, x, sum(new) OVER (PARTITION BY image_id ORDER BY x) AS run FROM g), runs AS (SELECT image_id, run, min(x) AS a, max(x) + 1 AS b FROM u GROUP BY image_id, run), n AS (SELECT image_id, count(*) AS n FROM runs GROUP BY image_id),
    gap AS (SELECT image_id, run, lead(a) OVER (PARTITION BY image_id ORDER BY run) - b AS w FROM runs), cut AS (SELECT image_id, run FROM gap WHERE w IS NOT NULL QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY w DESC, run DESC) <= 2),
    m AS (SELECT r.image_id, (SELECT count(*) FROM cut c WHERE c.image_id = r.image_id AND c.run < r.run) AS cell, r.a, r.b FROM runs r)
    SELECT n.image_id, n AS found, CASE WHEN n = 3 THEN 'gaps' ELSE 'merged' END AS method, cell, min(a) AS start, max(b) AS stop FROM m JOIN n USING (image_id) WHERE n >= 3 GROUP BY n.image_id, n, cell
    UNION ALL SELECT e.vec_id, coalesce(n, 0), 'equal', cell, a, b FROM embeddings e LEFT JOIN n ON n.image_id = e.vec_id, (VALUES (0, 0, 5), (1, 5, 11), (2, 11, 16)) q(cell, a, b) WHERE coalesce(n, 0) < 3""",
)
def slice_strip(spark, sf, count: int = 3):
    """A strip of 16 columns cut into `count` cells: by its gaps, by merging over the narrowest gaps, or into equal parts."""
    ink = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda x: F.exists(F.sequence(F.lit(0), F.lit(3)), lambda y: F.get("data", y * 16 + x) >= 170))
    d = X.packed(spark, sf).select("image_id", ink.alias("ink"))
    zero = F.array().cast("array<struct<a:int,b:int>>")

    def grow(acc, x):
        last = F.element_at(acc, -1)
        longer = F.array_append(F.slice(acc, 1, F.size(acc) - 1), F.struct(last["a"].alias("a"), (x + 1).alias("b")))
        fresh = F.array_append(acc, F.struct(x.alias("a"), (x + 1).alias("b")))
        return F.when(~F.get("ink", x), acc).when((F.size(acc) > 0) & (x - F.get(acc, F.size(acc) - 1)["b"] < 2), longer).otherwise(fresh)

    runs = F.aggregate(F.sequence(F.lit(0), F.lit(15)), zero, grow)
    d = d.select("image_id", runs.alias("runs"))
    # What is merged away are the narrowest gaps, the first of equals: the others are the cuts.
    gaps = F.transform(F.slice("runs", 1, F.size("runs") - 1), lambda r, i: F.struct((F.get("runs", i + 1)["a"] - r["b"]).alias("w"), i.alias("i")))
    kept = F.transform(F.slice(F.reverse(F.array_sort(gaps)), 1, count - 1), lambda g: g["i"])
    kept = F.array_sort(kept)
    starts = F.concat(F.array(F.lit(0)), F.transform(kept, lambda i: i + 1))
    ends = F.concat(kept, F.array(F.size("runs") - 1))
    merged = F.zip_with(starts, ends, lambda s, e: F.struct(F.get("runs", s)["a"].alias("a"), F.get("runs", e)["b"].alias("b")))
    equal = F.array(*(F.struct(F.lit(int(i * 16 / count + 0.5)).alias("a"), F.lit(int((i + 1) * 16 / count + 0.5)).alias("b")) for i in range(count)))
    n = F.size("runs")
    cells = F.when(n == count, F.col("runs")).when(n > count, merged).otherwise(equal)
    method = F.when(n == count, "gaps").when(n > count, "merged").otherwise("equal")
    return d.select("image_id", n.alias("found"), method.alias("method"), F.posexplode(cells).alias("cell", "c")).select("image_id", "found", "method", "cell", F.col("c.a").alias("start"), F.col("c.b").alias("stop"))


def cell_mask(key: int, size: int = 16, margin: int = 5, radius: int = 2) -> np.ndarray:
    """A terrain cell's shape: nine zones by its sides and corners, blurred twice with clamped edges and cut at a half."""
    on = [key >> b & 1 for b in range(8)]
    top, right, bottom, left = on[:4]
    zones = np.array([[on[4], top, on[5]], [left, 1, right], [on[7], bottom, on[6]]], float)
    at = np.digitize(np.arange(size), [margin, size - margin])
    m = zones[np.ix_(at, at)]
    w = np.zeros((size, size))
    for i in range(size):
        for k in range(-radius, radius + 1):
            w[i, min(size - 1, max(0, i + k))] += 1 / (2 * radius + 1)
    w = w @ w
    return w @ m @ w.T >= 0.5 - 1e-9


@query("terrain_atlas")
def terrain_atlas(spark, sf, size: int = 16):
    """(k, x, y) of the solid pixels of the 47 cells; the shapes are constants of the set, 47 small bit rows."""
    keys = [k for k in range(256) if all(not k >> b & 1 or k & need == need for b, need in CORNERS.items())]
    rows = [(k, "".join("1" if v else "0" for v in cell_mask(k, size).ravel())) for k in keys]
    d = spark.createDataFrame(rows, "k bigint, bits string").select("k", "bits", F.explode(F.sequence(F.lit(0), F.lit(size * size - 1))).alias("i"))
    return d.where(F.substring("bits", F.col("i") + 1, F.lit(1)) == "1").select("k", (F.col("i") % size).alias("x"), F.floor(F.col("i") / size).alias("y"))


@query("terrain_joins", f"SELECT across, a, b, true AS joins FROM ({_pairs_sql(True)}) q")
def terrain_joins(spark, sf, size: int = 16):
    """For every pair that can touch, whether the pixels along the shared edge are solid in both or in neither."""
    p = terrain_atlas(spark, sf, size)
    edge = lambda c, n, o: p.where(F.col(c) == n).groupBy("k").agg(F.array_sort(F.collect_list(o)).alias("e"))
    none = F.array().cast("array<bigint>")
    pairs = touching(spark, True)

    def side(across, first, second):
        a, b = (e.withColumn("e", e["e"].cast("array<bigint>")) for e in (first, second))
        t = pairs.where(F.col("across") == across).join(a.select(F.col("k").alias("a"), F.col("e").alias("ea")), "a", "left").join(b.select(F.col("k").alias("b"), F.col("e").alias("eb")), "b", "left")
        return t.select("across", "a", "b", (F.coalesce("ea", none) == F.coalesce("eb", none)).alias("joins"))

    return side(True, edge("x", size - 1, "y"), edge("x", 0, "y")).unionByName(side(False, edge("y", size - 1, "x"), edge("y", 0, "x")))


# Words that name no colour.
FILLER = ("for", "the", "a", "an", "and", "with", "only", "is", "are", "of", "on", "in", "as", "to", "where", "when", "its", "it", "inside", "use", "used", "plus", "or", "both", "any", "all")


_WORDS = "list_filter(regexp_extract_all(lower('Deep ' || p_type), '[a-z][a-z-]*'), lambda w: w NOT IN (" + ", ".join(f"'{w}'" for w in FILLER) + "))"


@query("palette_names", f"SELECT p_partkey AS id, '#' || {_HEX} AS hex, array_to_string(list_slice({_WORDS}, greatest(1, len({_WORDS}) - 1), len({_WORDS})), '-') AS name FROM part UNION ALL SELECT p_partkey, '#aabbcc', 'colour-2' FROM part")
def palette_names(spark, sf):
    """A name for each colour of a brief: the last two words before it, without fillers, within its clause; numbered on repeats."""
    sec = section(brief(), "Palette")
    d = X.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), sec.alias("sec"))
    hexes = F.regexp_extract_all("sec", F.lit(r"#([0-9a-fA-F]{6}|[0-9a-fA-F]{3})\b"), F.lit(1))
    before = F.split("sec", r"#(?:[0-9a-fA-F]{6}|[0-9a-fA-F]{3})\b")
    d = d.select("id", F.posexplode(F.arrays_zip(hexes.alias("h"), F.slice(before, 1, F.size(hexes)).alias("t"))).alias("i", "z")).select("id", "i", "z.*")
    h = F.lower(F.when(F.length("h") == 3, F.regexp_replace("h", "(.)", "$1$1")).otherwise(F.col("h")))
    clause = F.element_at(F.split("t", r"[,;.:\n()]"), -1)
    words = F.filter(F.regexp_extract_all(F.lower(clause), F.lit("[a-z][a-z-]*"), F.lit(0)), lambda w: ~w.isin(*FILLER))
    name = F.array_join(F.slice(words, F.greatest(F.lit(1), F.size(words) - 1), 2), "-")
    name = F.when(name == "", F.concat(F.lit("colour-"), F.col("i") + 1)).otherwise(name)
    d = d.select("id", "i", F.concat(F.lit("#"), h).alias("hex"), name.alias("name"))
    first = Window.partitionBy("id", "hex").orderBy("i")
    d = d.withColumn("n", F.row_number().over(first)).where("n = 1")
    k = F.row_number().over(Window.partitionBy("id", "name").orderBy("i"))
    return d.select("id", "hex", F.when(k == 1, F.col("name")).otherwise(F.concat("name", F.lit("-"), k)).alias("name"))
