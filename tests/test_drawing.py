"""Drawn scenes and silhouettes against shapes whose pixels are known."""

import math

import numpy as np
import pytest

from tessera.operators import drawing, outlines, scene

SPEC = {"canvas": (20, 10), "layers": [{"id": "a", "paths": ["p"]}, {"id": "b", "paths": ["q"], "pivot": (15, 5)}], "animate": [{"target": "a", "for": 100, "translateX": (0, 10)}, {"target": "b", "for": 100, "opacity": (1, 0)}]}
SHAPES = {"p": ("M0 0H5V10H0Z", (200, 0, 0), 1.0), "q": ("M0 0H20V5H0Z", (0, 0, 100), 0.5)}


def test_draw():
    s = scene.build(SPEC)
    first, last = drawing.draw(s, SHAPES, 0), drawing.draw(s, SHAPES, 100)
    assert first.shape == (10, 20, 4) and first[9, 2].tolist() == [200, 0, 0, 255] and first[9, 7].tolist() == [0, 0, 0, 0]
    assert first[0, 2].tolist() == [100, 0, 50, 255] and first[0, 12].tolist() == [0, 0, 100, 128]
    assert last[0, 12].tolist() == [200, 0, 0, 255] and last[0, 2, 3] == 0
    half = drawing.draw(s, SHAPES, 5, back=(255, 255, 255))
    assert half[9, 0].tolist() == [228, 128, 128, 255] and half[9, 19].tolist() == [255, 255, 255, 255]
    assert drawing.draw(s, SHAPES, 0, 2).shape == (20, 40, 4)


def test_difference():
    s = scene.build(SPEC)
    at = lambda t: drawing.draw(s, SHAPES, t)
    assert drawing.worst_difference(at, at, range(0, 101, 10)) == {"gap": 0, "share": 0.0, "at": 0}
    moved = drawing.worst_difference(at, lambda t: at(t + 10), (0, 50))
    assert moved["gap"] == 255 and moved["at"] == 0 and 0.5 < moved["share"] < 0.7  # the bar fades by 13 levels over half of the picture
    assert drawing.difference(at(0), at(0)[:5]) == (255, 1.0)
    faint = np.zeros((2, 2, 4), np.uint8)
    faint[0, 0] = 255, 255, 255, 8
    assert drawing.difference(faint, np.zeros_like(faint)) == (8, 0.0)


def disc(n=64, r=24, hole=0):
    y, x = np.mgrid[:n, :n] + 0.5
    d = np.hypot(x - n / 2, y - n / 2)
    p = np.zeros((n, n, 4), np.uint8)
    p[..., 3] = np.where((d <= r) & (d >= hole), 255, 0)
    return p


@pytest.mark.parametrize("budget", [12, 16, 32])
def test_silhouette_fits(budget):
    p = disc(hole=9)
    p[2:5, 2:5, 3] = 255  # less than the smallest shape
    (loop,) = drawing.silhouettes(p, budget=budget)
    assert 3 <= len(loop) <= budget
    assert abs(abs(outlines.area(loop)) / (math.pi * 24**2) - 1) < 0.12
    fit = drawing.shape_fit(p, [loop])
    assert fit["fit"] > 0.85 and fit["covers"] + fit["missed"] == pytest.approx(1, abs=2e-3)
    two = disc()
    two[:20, :20, 3] = 0
    two[:12, :12, 3] = 255
    assert [round(abs(outlines.area(x))) > 100 for x in drawing.silhouettes(two)] == [True, True]
    assert drawing.silhouettes(np.zeros((9, 9, 4), np.uint8)) == []


def test_shape_fit_tells_missed_from_extra():
    p = np.zeros((10, 10, 4), np.uint8)
    p[:, :5, 3] = 255
    assert drawing.shape_fit(p, [[(0, 0), (10, 0), (10, 5), (0, 5)]]) == {"art": 50, "covers": 0.5, "missed": 0.5, "extra": 0.5, "fit": 0.333}
    assert drawing.shape_fit(p * 0, [])["fit"] == 0
