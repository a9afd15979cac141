"""Pictures of posed scenes and how far two of them differ; outlines of a picture's shape and how well they fit it."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

import numpy as np

from tessera.operators import curves, outlines, regions
from tessera.operators.scene import Scene, pose

#: A path's shape: its text, its colour (r, g, b) and opacity.
Shape = tuple[str, tuple[int, int, int], float]


def draw(scene: Scene, shapes: dict[str, Shape], t: float, scale: float = 1.0, back: tuple[int, int, int] | None = None) -> np.ndarray:
    """(height, width, 4) samples of the scene at a time: its paths over each other, each by its share of every pixel."""
    w, h = (max(1, math.floor(v * scale + 0.5)) for v in (scene.width, scene.height))
    colour = np.zeros((h, w, 3)) if back is None else np.tile(np.array(back, float), (h, w, 1))
    alpha = np.full((h, w), 0.0 if back is None else 1.0)
    for path, (a, b, c, d, e, f), opacity in pose(scene, t):
        text, rgb, own = shapes[path]
        size = math.sqrt(abs(a * d - b * c)) * scale
        if own * opacity <= 0 or size < 1e-6:
            continue  # nothing of it shows
        # Curves are cut finely enough for the size at which they are drawn.
        polys = outlines.flatten(text, min(1.0, max(0.05, 0.3 / size)))
        moved = [[((a * x + c * y + e) * scale, (b * x + d * y + f) * scale) for x, y in p] for p in polys]
        top = outlines.coverage(moved, w, h) * (own * opacity)
        whole = top + alpha * (1 - top)
        mixed = np.array(rgb, float) * top[..., None] + colour * (alpha * (1 - top))[..., None]
        colour = np.divide(mixed, whole[..., None], out=np.zeros_like(mixed), where=whole[..., None] > 0)
        alpha = whole
    return np.floor(np.dstack([colour, alpha * 255]) + 0.5).clip(0, 255).astype(np.uint8)


def difference(a: np.ndarray, b: np.ndarray, within: int = 8) -> tuple[int, float]:
    """(largest gap of a channel, share of pixels farther apart than `within`); colours count by their opacity."""
    if a.shape != b.shape:
        return 255, 1.0

    def seen(p):
        return np.dstack([p[..., :3] * (p[..., 3:] / 255.0), p[..., 3:]])

    gap = np.floor(np.abs(seen(a.astype(float)) - seen(b.astype(float))).max(axis=2) + 0.5)
    return int(gap.max()), float((gap > within).mean())


def worst_difference(one: Callable[[float], np.ndarray], other: Callable[[float], np.ndarray], times: Iterable[float]) -> dict:
    """The largest gap and share over all times, and the last time that raised one of them."""
    gap, share, at = 0, 0.0, 0
    for t in times:
        g, s = difference(one(t), other(t))
        at = t if g > gap or s > share else at
        gap, share = max(gap, g), max(share, s)
    return {"gap": gap, "share": round(share, 6), "at": math.floor(at + 0.5)}


def silhouettes(picture: np.ndarray, least: int = 128, budget: int = 32, smallest: float = 16, tolerance: float = 0.75, growth: float = 1.6, tries: int = 24) -> list[np.ndarray]:
    """The outer outlines of what a picture encloses, largest first, each in at most `budget` points where `tries` allow.

    A loop simplified too little is simplified more, by a tolerance that grows from try to try. Holes are left out.
    """
    loops = curves.contours(regions.filled(picture[..., 3] >= least).astype(float))
    loops = sorted((loop for loop in loops if abs(outlines.area(loop)) >= smallest), key=lambda loop: -abs(outlines.area(loop)))
    if loops:
        outer = np.sign(outlines.area(loops[0]))  # the largest loop is no hole
        loops = [loop for loop in loops if np.sign(outlines.area(loop)) == outer]
    out = []
    for loop in loops:
        for k in range(tries + 1):
            points = outlines.simplify(loop, tolerance * growth**k)
            if len(points) <= budget:
                break
        if len(points) >= 3:
            out.append(np.asarray(points))
    return out


def shape_fit(picture: np.ndarray, polygons: list, least: int = 128) -> dict:
    """What of the picture's enclosed shape the polygons cover, miss and claim besides, as shares of it; fit is of both together."""
    art = regions.filled(picture[..., 3] >= least)
    claimed = outlines.coverage([list(map(tuple, p)) for p in polygons], picture.shape[1], picture.shape[0]) >= 0.5
    n, both, either = art.sum(), (art & claimed).sum(), (art | claimed).sum()
    share = lambda v, of: math.floor(v / of * 1000 + 0.5) / 1000 if of else 0.0
    return {"art": int(n), "covers": share(both, n), "missed": share(n - both, n), "extra": share(either - n, n), "fit": share(both, either)}
