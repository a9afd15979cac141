"""Palettes: median cut, k-means refinement, mapping with error diffusion."""

from __future__ import annotations

import numpy as np

# sRGB to Lab as colour.lab has it, on whole arrays.
_XYZ = np.array(((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.072175), (0.0193339, 0.119192, 0.9503041)))


def lab(rgb: np.ndarray) -> np.ndarray:
    c = np.asarray(rgb, np.float64) / 255
    lin = np.where(c <= 0.04045, c / 12.92, ((c + 0.055) / 1.055) ** 2.4)
    t = lin @ _XYZ.T / np.array((0.95047, 1.0, 1.08883))
    f = np.where(t > 0.008856, np.cbrt(t), 7.787 * t + 16 / 116)
    return np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], axis=-1)


def median_cut(rgb: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """Up to `count` colours: the box with the widest channel is cut at its middle sample, then k-means settles the means."""
    if not len(rgb):
        return np.empty((0, 3), np.uint8)
    boxes = [np.asarray(rgb, np.int64)]
    while len(boxes) < count:
        spans = [np.ptp(b, axis=0) for b in boxes]
        i = int(np.argmax([s.max() for s in spans]))
        if not spans[i].max():
            break
        b = boxes.pop(i)
        b = b[np.argsort(b[:, int(spans[i].argmax())], kind="stable")]
        boxes += [b[: len(b) // 2], b[len(b) // 2 :]]
    return refine(rgb, np.array([b.mean(axis=0) for b in boxes]), rounds)


def refine(rgb: np.ndarray, centres: np.ndarray, rounds: int = 8) -> np.ndarray:
    """k-means in RGB until the centres move by less than half a level in all; an empty cluster keeps its centre."""
    x = np.asarray(rgb, np.float64)
    for _ in range(rounds):
        near = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        new = np.array([x[near == i].mean(axis=0) if (near == i).any() else c for i, c in enumerate(centres)])
        moved, centres = np.abs(new - centres).sum(), new
        if moved < 0.5:
            break
    return np.floor(centres + 0.5).astype(np.uint8)


def map_to(image: np.ndarray, palette: np.ndarray, dither: bool = False, least: int = 128) -> np.ndarray:
    """Every pixel with alpha of `least` or more takes its nearest palette colour; with dither, errors go on to 4 neighbours."""
    out, labs = image.copy(), lab(palette)
    solid = image[..., 3] >= least
    if not dither:
        near = ((lab(image[solid][:, :3])[:, None] - labs[None]) ** 2).sum(axis=2).argmin(axis=1)
        out[solid, :3] = palette[near]
        return out
    h, w = image.shape[:2]
    err = np.zeros((h + 1, w + 2, 3))
    for y in range(h):
        for x in range(w):
            if not solid[y, x]:
                continue
            want = np.clip(np.floor(image[y, x, :3] + err[y, x + 1] + 0.5), 0, 255)
            got = palette[((lab(want) - labs) ** 2).sum(axis=1).argmin()]
            out[y, x, :3] = got
            e = want - got
            for dx, dy, k in ((1, 0, 7), (-1, 1, 3), (0, 1, 5), (1, 1, 1)):
                err[y + dy, x + 1 + dx] += e * k / 16
    return out
