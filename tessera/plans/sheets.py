"""Queries on sheets: trimmed atlases put back, padded frames, rows of frames, colour tables, terrain cells."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions.numbers import byte, byte_sql, half_up, half_up_sql
from tessera.operators import outlines
from tessera.plans import fixtures as X
from tessera.plans.atlases import cell_mask
from tessera.plans.measure import bounds
from tessera.plans.registry import query

#: Cells of one atlas: an action's pictures are cut into atlases by id, so that no task holds an action.
CELLS = 256


def trim(cells: np.ndarray, least: int, margin: int = 0, pad: int = 2):
    """(atlas, places): cells (n, h, w, 4) cut to their boxes and packed; a place is (x, y, w, h, from x, from y, empty)."""
    n, h, w = cells.shape[:3]
    boxes = []
    for c in cells:
        ys, xs = np.nonzero(c[..., 3] >= least)
        if not len(xs):
            boxes.append((0, 0, 1, 1, True))  # no engine takes a region of nothing
            continue
        x0, y0 = max(0, int(xs.min()) - margin), max(0, int(ys.min()) - margin)
        boxes.append((x0, y0, min(w, int(xs.max()) + 1 + margin) - x0, min(h, int(ys.max()) + 1 + margin) - y0, False))
    at, wide, tall = outlines.shelf_pack([(b[2], b[3]) for b in boxes], pad, 1 << 14)
    atlas = np.zeros((tall + 2 * pad, wide + 2 * pad, 4), np.uint8)
    places = []
    for c, (bx, by, bw, bh, empty), (x, y) in zip(cells, boxes, at, strict=True):
        x, y = x + pad, y + pad
        if not empty:
            atlas[y : y + bh, x : x + bw] = c[by : by + bh, bx : bx + bw]
        places.append((x, y, bw, bh, bx, by, empty))
    return atlas, places


def restore(atlas: np.ndarray, place, h: int, w: int) -> np.ndarray:
    """A frame in a cell of its source size."""
    x, y, bw, bh, bx, by, empty = place
    out = np.zeros((h, w, 4), np.uint8)
    if not empty:
        out[by : by + bh, bx : bx + bw] = atlas[y : y + bh, x : x + bw]
    return out


def compare(back: np.ndarray, cell: np.ndarray, least: int) -> tuple[int, int, int]:
    """(differing, faint, lost): what the cut may drop is faint, or lost if it was visible; all else differs."""
    want, got = cell[..., 3], back[..., 3]
    same = (got == want) & ((want == 0) | (back[..., :3] == cell[..., :3]).all(axis=2))
    dropped = ~same & (got == 0) & (want < least)
    return int((~same & ~dropped).sum()), int((dropped & (want < 128)).sum()), int((dropped & (want >= 128)).sum())


def _sheets(spark, sf):
    return X.packed(spark, sf).select("action", F.floor(F.col("image_id") / CELLS).alias("sheet"), "image_id", "data")


def _cells(pdf) -> np.ndarray:
    return np.stack([np.asarray(d, np.uint8) for d in pdf["data"]]).reshape(-1, 4, 4, 4)


@query("trim_atlas")
def trim_atlas(spark, sf, least: int = 160):
    """Where each frame's box lies in its atlas, and where in its cell it came from."""

    def run(pdf):
        pdf = pdf.sort_values("image_id")
        atlas, places = trim(_cells(pdf), least)
        cols = list(zip(*places, strict=True))
        out = pdf[["action", "sheet", "image_id"]].assign(**dict(zip(("x", "y", "w", "h", "from_x", "from_y", "empty"), cols, strict=True)))
        return out.assign(atlas_w=atlas.shape[1], atlas_h=atlas.shape[0])

    return _sheets(spark, sf).groupBy("action", "sheet").applyInPandas(run, "action bigint, sheet bigint, image_id bigint, x int, y int, w int, h int, from_x int, from_y int, empty boolean, atlas_w int, atlas_h int")


_OUT = "x0 IS NULL OR x < x0 OR x > x1 OR y < y0 OR y > y1"


@query("verify_trim", f"WITH {X.PIXELS}, b AS (SELECT image_id, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM pix WHERE a >= 160 GROUP BY image_id), c AS (SELECT p.action, p.image_id // {CELLS} AS sheet, p.image_id, count(*) FILTER (a > 0 AND a < 128 AND ({_OUT})) AS faint, count(*) FILTER (a >= 128 AND ({_OUT})) AS lost FROM pix p LEFT JOIN b USING (image_id) GROUP BY p.action, p.image_id) SELECT action, sheet, count(*) AS frames, CAST(0 AS BIGINT) AS moved, CAST(sum(faint) AS BIGINT) AS faint, CAST(sum(lost) AS BIGINT) AS lost, CASE WHEN sum(lost) > 0 THEN 'lossy' ELSE 'exact' END AS verdict FROM c GROUP BY action, sheet")
def verify_trim(spark, sf, least: int = 160):
    """Every frame of every trimmed atlas put back and held against its cell; the SQL works the losses out from the boxes alone."""

    def run(pdf):
        pdf = pdf.sort_values("image_id")
        cells = _cells(pdf)
        atlas, places = trim(cells, least)
        bad, faint, lost = np.array([compare(restore(atlas, p, *c.shape[:2]), c, least) for p, c in zip(places, cells, strict=True)]).T
        verdict = "moved" if bad.any() else "lossy" if lost.any() else "exact"
        return pdf[["action", "sheet"]].head(1).assign(frames=len(pdf), moved=int((bad > 0).sum()), faint=int(faint.sum()), lost=int(lost.sum()), verdict=verdict)

    return _sheets(spark, sf).groupBy("action", "sheet").applyInPandas(run, "action bigint, sheet bigint, frames bigint, moved bigint, faint bigint, lost bigint, verdict string")


def _on(c: str, v: int):
    return byte(F.col(c) * (F.col("a") / 255.0) + v * (1 - F.col("a") / 255.0))


def _on_sql(c: str, v: int) -> str:
    return byte_sql(f"{c} * (a / 255.0::DOUBLE) + {v} * (1 - a / 255.0::DOUBLE)")


@query("on_key", f"WITH {X.PIXELS}, t AS (SELECT i, i % 6 AS tx, i // 6 AS ty FROM (SELECT unnest(range(0, 36)) AS i)) SELECT e.vec_id AS image_id, tx AS x, ty AS y, " + ", ".join(f"CASE WHEN p.a IS NULL THEN {v} ELSE {_on_sql(f'p.{c}', v).replace('(a /', '(p.a /').replace('- a /', '- p.a /')} END AS {c}" for c, v in zip("rgb", (0, 255, 0), strict=True)) + " FROM embeddings e CROSS JOIN t LEFT JOIN pix p ON p.image_id = e.vec_id AND p.x = tx - 1 AND p.y = ty - 1")
def on_key(spark, sf, key=(0, 255, 0), margin: int = 1):
    """A frame of 4 by 4 with a fifth of its side around it, on the key colour."""
    side = 4 + 2 * margin
    d = X.packed(spark, sf).select("image_id", "data", F.explode(F.sequence(F.lit(0), F.lit(side * side - 1))).alias("i"))
    x, y = F.col("i") % side, F.floor(F.col("i") / side).cast("int")
    inside = x.between(margin, margin + 3) & y.between(margin, margin + 3)
    at = ((y - margin) * 4 + x - margin) * 4
    d = d.select("image_id", x.cast("long").alias("x"), y.cast("long").alias("y"), *(F.when(inside, F.get("data", at + k)).otherwise(0).alias(c) for k, c in enumerate("rgba")))
    return d.select("image_id", "x", "y", *(_on(c, v).alias(c) for c, v in zip("rgb", key, strict=True)))


@query("row_on_grey", f"WITH {X.PIXELS}, f AS (SELECT image_id, action, row_number() OVER (PARTITION BY action, image_id // {CELLS} ORDER BY image_id) - 1 AS k FROM (SELECT vec_id AS image_id, CAST(label AS BIGINT) AS action FROM embeddings)), t AS (SELECT i % 9 AS tx, i // 9 AS ty FROM (SELECT unnest(range(0, 90)) AS i)) SELECT f.action, f.image_id // {CELLS} AS sheet, f.k * 9 + tx AS x, ty AS y, " + ", ".join(f"CASE WHEN p.a IS NULL THEN 128 ELSE {_on_sql(f'p.{c}', 128).replace('(a /', '(p.a /').replace('- a /', '- p.a /')} END AS {c}" for c in "rgb") + " FROM f CROSS JOIN t LEFT JOIN pix p ON p.image_id = f.image_id AND tx BETWEEN 1 AND 8 AND ty BETWEEN 1 AND 8 AND p.x = (tx - 1) // 2 AND p.y = (ty - 1) // 2")
def row_on_grey(spark, sf, scale: int = 2, gap: int = 1, grey: int = 128):
    """An atlas's frames in a row on grey, enlarged; each frame brings the gap before it, so a frame's pixels are made in its own row."""
    place = Window.partitionBy("action", "sheet").orderBy("image_id")
    wide, tall = 4 * scale + gap, 4 * scale + 2 * gap
    d = _sheets(spark, sf).withColumn("k", F.row_number().over(place) - 1).select("action", "sheet", "k", "data", F.explode(F.sequence(F.lit(0), F.lit(wide * tall - 1))).alias("i"))
    x, y = F.col("i") % wide, F.floor(F.col("i") / wide).cast("int")
    inside = (x >= gap) & y.between(gap, gap + 4 * scale - 1)
    at = (F.floor((y - gap) / scale) * 4 + F.floor((x - gap) / scale)).cast("int") * 4
    d = d.select("action", "sheet", (F.col("k") * wide + x).cast("long").alias("x"), y.cast("long").alias("y"), *(F.when(inside, F.get("data", at + k)).otherwise(0).alias(c) for k, c in enumerate("rgba")))
    return d.select("action", "sheet", "x", "y", *(_on(c, grey).alias(c) for c in "rgb"))


@query("gif_palette", f"WITH {X.PIXELS}, c AS (SELECT image_id, printf('#%02x%02x%02x', r, g, b) AS h, min(i) AS i FROM pix WHERE a >= 128 GROUP BY image_id, r, g, b) SELECT e.vec_id AS image_id, coalesce(string_agg(h, ' ' ORDER BY i), '') AS colours, count(h) AS n FROM embeddings e LEFT JOIN c ON c.image_id = e.vec_id GROUP BY e.vec_id")
def gif_palette(spark, sf, least: int = 128):
    """The different opaque colours of a picture in the order in which they come; a picture of up to 255 keeps them all."""
    at = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda p: F.slice("data", p * 4 + 1, 4))
    on = F.transform(F.filter(at, lambda c: c[3] >= least), lambda c: F.lower(F.format_string("#%02x%02x%02x", c[0], c[1], c[2])))
    d = X.packed(spark, sf).select("image_id", F.array_distinct(on).alias("c"))
    return d.select("image_id", F.array_join("c", " ").alias("colours"), F.size("c").cast("long").alias("n"))


@query("match_strip_scale", f"WITH {X.PIXELS}, b AS (SELECT image_id, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h FROM pix WHERE a >= 200 GROUP BY image_id), t AS (SELECT image_id, w, h, CASE WHEN image_id % 4 = 0 THEN 0 WHEN image_id % 3 = 0 THEN 40 ELSE 30 + image_id % 20 END AS target FROM b) SELECT image_id, target, CASE WHEN target = 0 OR target = h THEN w ELSE greatest(1, CAST(floor(w * (target / CAST(h AS DOUBLE)) + 0.5) AS BIGINT)) END AS width, CASE WHEN target = 0 OR target = h THEN h ELSE target END AS height FROM t")
def match_strip_scale(spark, sf, median: int = 40):
    """A repainted frame's size: as tall as the frame it replaces, or as the median where that was flagged for its size."""
    i = F.col("image_id")
    old, flagged = F.when(i % 4 == 0, 0).otherwise(30 + i % 20), (i % 3 == 0) & (i % 4 > 0)
    d = bounds(X.pixels(spark, sf), 200).where("x0 is not null").select("image_id", F.col("width").alias("w"), F.col("height").alias("h"), F.when(flagged, median).otherwise(old).alias("target"))
    same = (F.col("target") == 0) | (F.col("target") == F.col("h"))
    wide = F.greatest(F.lit(1), F.floor(F.col("w") * (F.col("target") / F.col("h").cast("double")) + 0.5))
    return d.select("image_id", F.col("target").cast("long").alias("target"), F.when(same, F.col("w")).otherwise(wide).alias("width"), F.when(same, F.col("h")).otherwise(F.col("target")).alias("height"))


@query("normalise_pair", f"WITH {X.PIXELS}, {X.FRAMES}, b AS (SELECT image_id, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h FROM pix WHERE a >= 128 GROUP BY image_id), s AS (SELECT f.image_id, f.action, f.frame_ix, greatest(1, CAST(floor(w * (128.0::DOUBLE / h) + 0.5) AS BIGINT)) AS w FROM frm f JOIN b USING (image_id)) SELECT t.image_id, greatest(t.w, u.w) AS width, (greatest(t.w, u.w) - t.w) // 2 AS x, (greatest(t.w, u.w) - u.w) // 2 AS x_before FROM s t JOIN s u ON t.action = u.action AND t.frame_ix = u.frame_ix + 1")
def normalise_pair(spark, sf, height: int = 128):
    """Where a frame and the one before it lie on a common canvas once both are cut to their art and as tall as each other."""
    b = bounds(X.pixels(spark, sf), 128).where("x0 is not null").select("image_id", F.greatest(F.lit(1), F.floor(F.col("width") * (float(height) / F.col("height")) + 0.5)).alias("w"))
    f = X.packed(spark, sf).select("image_id", "action").join(b, "image_id", "left")
    d = X.in_sequence(f, "w").where("w is not null and low is not null")
    both = F.greatest("w", "low")
    return d.select("image_id", both.alias("width"), F.floor((both - F.col("w")) / 2).alias("x"), F.floor((both - F.col("low")) / 2).alias("x_before"))


@query("fit_fill", f"WITH {X.GREY} SELECT image_id, x // 2 AS x, y // 2 AS y, {byte_sql('avg(g)')} AS g FROM grey GROUP BY image_id, x // 2, y // 2")
def fit_fill(spark, sf):
    """A fill of 8 by 8 scaled into a cell of 4 by 4: areas are averaged, which parts the fill and keeps its wrap."""
    corner = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda p: F.floor(p / 4) * 16 + p % 4 * 2)
    v = lambda at: F.get("data", at.cast("int"))
    mean = F.transform(corner, lambda c: (v(c) + v(c + 1) + v(c + 8) + v(c + 9)) / 4.0)
    d = X.table(spark, sf, "embeddings").select(F.col("vec_id").alias("image_id"), F.transform("embedding", X.sample).alias("data"))
    d = d.select("image_id", F.posexplode(mean).alias("i", "m"))
    return d.select("image_id", (F.col("i") % 4).cast("long").alias("x"), F.floor(F.col("i") / 4).alias("y"), byte(F.col("m")).alias("g"))


def _map_on(x, y, side: int):
    return F.when((x >= 0) & (y >= 0) & (x < side) & (y < side) & ((x * 7919 + y * 104729 + x * y * 31) % 100 < 55), 1).otherwise(0)


@query("bits_from", "WITH m AS (SELECT x, y, CASE WHEN (x * 7919 + y * 104729 + x * y * 31) % 100 < 55 THEN 1 ELSE 0 END AS o FROM (SELECT unnest(range(0, 24)) AS x), (SELECT unnest(range(0, 24)) AS y)), n AS (SELECT p.x, p.y, " + ", ".join(f"coalesce(max(q.o) FILTER (q.x = p.x + ({dx}) AND q.y = p.y + ({dy})), 0) AS {n}" for n, dx, dy in (("t", 0, -1), ("r", 1, 0), ("b", 0, 1), ("l", -1, 0), ("tl", -1, -1), ("tr", 1, -1), ("br", 1, 1), ("bl", -1, 1))) + " FROM m p JOIN m q ON abs(p.x - q.x) <= 1 AND abs(p.y - q.y) <= 1 GROUP BY p.x, p.y) SELECT x, y, t + r * 2 + b * 4 + l * 8 AS sides, t + r * 2 + b * 4 + l * 8 + tl * t * l * 16 + tr * t * r * 32 + br * b * r * 64 + bl * b * l * 128 AS corners FROM n")
def bits_from(spark, sf, side: int = 24):
    """The bits of every square of a map, filled or not, from the squares around it: with sides only, and with corners that need both sides."""
    x, y = F.col("id") % side, F.floor(F.col("id") / side)
    on = lambda dx, dy: _map_on(x + dx, y + dy, side)
    t, r, b, l = on(0, -1), on(1, 0), on(0, 1), on(-1, 0)
    sides = t + r * 2 + b * 4 + l * 8
    corners = on(-1, -1) * t * l * 16 + on(1, -1) * t * r * 32 + on(1, 1) * b * r * 64 + on(-1, 1) * b * l * 128
    return spark.range(side * side).select(x.alias("x"), y.alias("y"), sides.cast("long").alias("sides"), (sides + corners).cast("long").alias("corners"))


def cell_geometry(size: int, margin: int | None = None, radius: int | None = None) -> tuple[int, int]:
    """The margin and rounding of a terrain cell: the rounding goes down until the island keeps its centre and a lone side its middle."""
    m = max(1, min(size // 2 - 1, int(np.floor(size * 0.3 + 0.5)) if margin is None else margin))
    r = max(0, min((m - 1) // 2, m // 2 if radius is None else radius))
    mid = size // 2
    while r and not (cell_mask(0, size, m, r)[mid, mid] and cell_mask(1, size, m, r)[0, mid]):
        r -= 1
    return m, r


@query("cell_geometries")
def cell_geometries(spark, sf):
    """The geometry of every cell size that a sheet may have, at the default margin and at the widest."""
    import pyarrow as pa

    X.table(spark, sf, "part")

    def run(batches):
        for b in batches:
            rows = [(n, *cell_geometry(n), *cell_geometry(n, n)) for n in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 5, names=["size", "margin", "radius", "widest", "widest_radius"])

    return spark.range(4, 65).mapInArrow(run, "size bigint, margin bigint, radius bigint, widest bigint, widest_radius bigint")


def cell_faults(mask: np.ndarray, key: int) -> tuple[bool, bool]:
    """(hollow, misdrawn): no material at the centre; and a side's middle, a corner or a bare side other than the bits say."""
    n = len(mask)
    mid, end = n // 2, n - 1
    top, right, bottom, left, tl, tr, br, bl = (bool(key >> b & 1) for b in range(8))
    points = ((top, 0, mid), (right, mid, end), (bottom, end, mid), (left, mid, 0), (tl, 0, 0), (tr, 0, end), (br, end, end), (bl, end, 0))
    bare = (not top and mask[0].any()) or (not right and mask[:, end].any()) or (not bottom and mask[end].any()) or (not left and mask[:, 0].any())
    return not mask[mid, mid], bool(bare or any(bool(mask[y, x]) != want for want, y, x in points))


@query("terrain_coverage")
def terrain_coverage(spark, sf, size: int = 16):
    """Of each cell of the set whether its centre is hollow, how many gaps the full cell has, and whether it is drawn as declared."""
    from tessera.plans.gates import KEYS

    rows = []
    for k in KEYS:  # 47 constant shapes
        m = cell_mask(k, size)
        rows.append((k, *map(bool, cell_faults(m, k)), int((~m).sum()) if k == 255 else 0))
    return spark.createDataFrame(rows, "k bigint, hollow boolean, misdrawn boolean, gaps bigint")
