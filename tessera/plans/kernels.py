"""Queries that run a kernel on each picture: codecs, regions, outlines, palettes. Narrow Arrow maps; no SQL twin."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.operators import curves, drawing, outlines, quantise, regions, scene
from tessera.plans import fixtures as X
from tessera.plans.registry import query
from tessera.sources import animations, jpeg, png


def each(df, fn, schema: str, side: int = 4, channels: int = 4):
    """fn(picture) -> a tuple for each row of (id, bytes as an array); rows with the id before it."""
    fields = df.sparkSession.createDataFrame([], f"image_id bigint, {schema}").schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(fields)

    def run(batches):
        for b in batches:
            data = b.column(1).values.to_numpy().astype(np.uint8).reshape(b.num_rows, side, side, channels)
            rows = [(i, *fn(d)) for i, d in zip(b.column(0).to_pylist(), data, strict=True)]
            cols = list(zip(*rows, strict=True)) or [()] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    return df.select("image_id", "data").mapInArrow(run, fields)


def grey8(spark, sf):
    return X.table(spark, sf, "embeddings").select(F.col("vec_id").alias("image_id"), F.transform("embedding", X.sample).alias("data"))


def _png(m):
    data = png.encode(m)
    back = png.decode(data)
    return len(data), png.has_alpha(data), bool((back == m).all()), hashlib.sha256(back.tobytes()).hexdigest()


@query("png_round_trip")
def png_round_trip(spark, sf):
    return each(X.packed(spark, sf), _png, "bytes bigint, alpha boolean, same boolean, sha256 string")


def _jpeg(m):
    big = np.repeat(np.repeat(m, 6, 0), 6, 1)
    data = jpeg.encode(big, 92)
    back = jpeg.decode(data)
    return len(data), *jpeg.size(data), int(np.abs(back[..., :3].astype(int) - big[..., :3]).mean() + 0.5)


@query("jpeg_round_trip")
def jpeg_round_trip(spark, sf):
    return each(X.packed(spark, sf), _jpeg, "bytes bigint, width int, height int, mean_error int")


def _anim(m):
    frames = [m, m[::-1], m[:, ::-1]]
    apng = animations.encode_apng(frames, [40, 80, 120])
    palette = quantise.median_cut(m.reshape(-1, 4)[:, :3], 8)
    gif = animations.encode_gif(frames, palette, [40, 80, 120])
    ico = animations.encode_ico([m, np.repeat(np.repeat(m, 64, 0), 64, 1)])
    return len(animations.apng_delays(apng)), sum(animations.apng_delays(apng)), len(animations.gif_frames(gif)), ",".join(f"{e['width']}{e['kind']}" for e in animations.ico_entries(ico))


@query("animation_files")
def animation_files(spark, sf):
    return each(X.packed(spark, sf), _anim, "apng_frames int, apng_ms int, gif_frames int, icons string")


def _trace(m):
    mask = m[..., 0] >= 128
    _, pieces = regions.label(mask)
    solid, bones = regions.filled(mask), regions.thin(mask)
    dist, branch = regions.chamfer(mask), regions.crossings(regions.thin(mask))
    loops = outlines.pixel_loops(mask)
    return pieces, int(mask.sum()), int(solid.sum()), int(bones.sum()), int(dist.max()), int((branch == 1).sum()), len(loops), float(sum(outlines.area(p) for p in loops))


@query("trace_regions")
def trace_regions(spark, sf):
    return each(grey8(spark, sf), _trace, "pieces int, area int, filled int, skeleton int, widest int, ends int, loops int, outline_area double", 8, 1)


def _labels(m):
    bands = (m[..., 0].astype(int) // 64).astype(np.int32)
    clean = regions.despeckle(regions.majority(bands), 3)
    return int((clean != bands).sum()), regions.label(clean == clean[0, 0], regions.AROUND4)[1]


@query("clean_labels")
def clean_labels(spark, sf):
    return each(grey8(spark, sf), _labels, "moved int, pieces int", 8, 1)


def _palette(m):
    p = quantise.median_cut(m.reshape(-1, 4)[:, :3], 4)
    flat, dots = quantise.map_to(m, p), quantise.map_to(m, p, dither=True)
    return ["#%02x%02x%02x" % tuple(c) for c in p.tolist()], int((flat != m).any(axis=2).sum()), int((dots != flat).any(axis=2).sum())


@query("median_cut")
def median_cut(spark, sf):
    return each(X.packed(spark, sf), _palette, "palette array<string>, mapped int, dithered int")


def _path(m):
    v = (m.reshape(-1) / 16.0).round(2).tolist()
    d = f"M{v[0]} {v[1]}L{v[2]},{v[3]} C{v[4]} {v[5]} {v[6]} {v[7]} {v[8]} {v[9]}H{v[10]}V{v[11]}Z"
    polys = outlines.flatten(d)
    pts = np.array(polys[0])
    cover = outlines.coverage(polys, 16, 16)
    return len(pts), float(round(pts[:, 0].min(), 4)), float(round(pts[:, 0].max(), 4)), round(outlines.area(pts), 4), round(float(cover.sum()), 4), len(outlines.simplify(pts, 0.5))


@query("path_geometry")
def path_geometry(spark, sf):
    return each(X.packed(spark, sf), _path, "points int, x0 double, x1 double, area double, ink double, simplified int")


@query("pack_rects")
def pack_rects(spark, sf):
    """The parts of each brand on a sheet; a brand's parts are split into sheets of 256, by key, so that no task holds a brand."""
    p = X.table(spark, sf, "part").select("p_brand", F.floor(F.col("p_partkey") / 6400).alias("sheet"), F.col("p_partkey").alias("id"), (3 + F.col("p_size") % 40).cast("int").alias("w"), (3 + F.col("p_partkey") % 50).cast("int").alias("h"))

    def run(pdf):
        pdf = pdf.sort_values("id")
        at, w, h = outlines.shelf_pack(list(zip(pdf["w"], pdf["h"], strict=True)), 2, 1 << 14)
        return pdf.assign(x=[a for a, _ in at], y=[b for _, b in at], sheet_w=w, sheet_h=h)[["p_brand", "sheet", "id", "x", "y", "w", "h", "sheet_w", "sheet_h"]]

    return p.groupBy("p_brand", "sheet").applyInPandas(run, "p_brand string, sheet bigint, id bigint, x int, y int, w int, h int, sheet_w int, sheet_h int")


def _outline(m):
    field = m[..., 0] / 255.0
    loops = curves.contours(field)
    d = curves.trace(field)
    return len(loops), round(float(sum(outlines.area(p) for p in loops)), 4), d.count("C"), d


@query("trace_outlines")
def trace_outlines(spark, sf):
    """The smooth outline of each grey picture as cubic path text."""
    return each(grey8(spark, sf), _outline, "loops int, area double, curves int, d string", 8, 1)


def _silhouette(m):
    big = np.zeros((32, 32, 4), np.uint8)
    big[..., 3] = np.repeat(np.repeat(m[..., 0], 4, 0), 4, 1)
    loops = drawing.silhouettes(big, budget=16)
    fit = drawing.shape_fit(big, loops)
    return len(loops), max(map(len, loops), default=0), fit["art"], fit["covers"], fit["missed"], fit["extra"], fit["fit"]


@query("silhouette_fit")
def silhouette_fit(spark, sf):
    """Outlines of each grey picture's bright parts, four times its size, in 16 points at most, and how well they fit."""
    return each(grey8(spark, sf), _silhouette, "shapes int, points int, art bigint, covers double, missed double, extra double, fit double", 8, 1)


def _drawn(m):
    v = m.reshape(-1).astype(int).tolist()
    spec = {
        "canvas": (16, 16), "duration": 200, "layers": [{"id": "back", "paths": ["a"]}, {"id": "front", "pivot": (8, 8), "paths": ["b"]}],
        "animate": [{"target": "front", "for": 100, "rotate": (0, v[0] % 90)}, {"target": "back", "for": 200, "translateX": (0, v[1] % 8), "opacity": (1, v[2] / 255)}],
    }
    shapes = {"a": ("M2 2H14V14H2Z", tuple(v[3:6]), 1.0), "b": (f"M4 4L12 {4 + v[6] % 4}C12 8 10 12 4 12Z", tuple(v[7:10]), 0.75)}
    s = scene.build(spec)
    frames = {t: drawing.draw(s, shapes, t) for t in (0, 100, 200)}
    moved = drawing.worst_difference(lambda t: frames[0], frames.get, (100, 200))
    return [hashlib.sha256(f.tobytes()).hexdigest()[:16] for f in frames.values()], int(frames[0][..., 3].sum()), moved["gap"], moved["share"], moved["at"]


@query("scene_frames")
def scene_frames(spark, sf):
    """A scene of two layers drawn at its start, middle and end, and how far it moves from its start."""
    return each(X.packed(spark, sf), _drawn, "frames array<string>, ink bigint, gap int, share double, at int")


def _shared(pdf):
    """One palette over a sheet's frames, from a stride of its opaque pixels where there are very many."""
    p = np.stack([np.asarray(d, np.uint8) for d in pdf.sort_values("image_id")["data"]]).reshape(-1, 4)
    rgb = p[p[:, 3] >= 128][:, :3]
    rgb = rgb[:: max(1, len(rgb) // 60_000)]
    colours = quantise.median_cut(rgb, 8).tolist() if len(rgb) else []
    return pdf[["action", "sheet"]].head(1).assign(palette=[["#%02x%02x%02x" % tuple(c) for c in colours]], frames=len(pdf))


@query("shared_palette")
def shared_palette(spark, sf, cells: int = 256):
    """Eight colours for all frames of a sheet, so that none flickers between them; a sheet is a run of an action's ids."""
    d = X.packed(spark, sf).withColumn("sheet", F.floor(F.col("image_id") / cells))
    return d.groupBy("action", "sheet").applyInPandas(_shared, "action bigint, sheet bigint, palette array<string>, frames bigint")
