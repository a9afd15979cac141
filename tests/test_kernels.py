"""Codecs by round trips and refusals; region and outline kernels by invariants and brute force."""

import struct
import zlib

import numpy as np
import pytest

from tessera.operators import outlines, quantise, regions
from tessera.sources import animations, images, jpeg, png

RND = np.random.default_rng(7)


def test_png_round_trip():
    m = RND.integers(0, 256, (13, 7, 4)).astype(np.uint8)
    assert np.array_equal(png.decode(png.encode(m)), m) and png.size(png.encode(m)) == (7, 13) and png.has_alpha(png.encode(m))
    flat = png.decode(png.encode(m, alpha=False))
    assert np.array_equal(flat[..., :3], m[..., :3]) and (flat[..., 3] == 255).all()


def _filtered(rows, bpp, kinds):
    out, above = b"", bytes(len(rows[0]))
    for row, kind in zip(rows, kinds, strict=True):
        line = bytearray([kind])
        for i, v in enumerate(row):
            a, b, c = (row[i - bpp] if i >= bpp else 0), above[i], (above[i - bpp] if i >= bpp else 0)
            p = a + b - c
            paeth = min((a, b, c), key=lambda t: (abs(p - t), (a, b, c).index(t)))
            line.append((v - (0, a, b, (a + b) // 2, paeth)[kind]) & 255)
        out += bytes(line)
        above = row
    return out


@pytest.mark.parametrize(("colour", "depth"), [(0, 1), (0, 2), (0, 4), (0, 8), (0, 16), (2, 8), (2, 16), (3, 1), (3, 4), (3, 8), (4, 8), (4, 16), (6, 8), (6, 16)])
def test_png_kinds(colour, depth):
    w, h, n = 11, 5, png.CHANNELS[colour]
    v = RND.integers(0, 1 << depth, (h, w, n))
    if depth == 16:
        raw = v.astype(">u2").tobytes()
    elif depth == 8:
        raw = v.astype(np.uint8).tobytes()
    else:
        bits = ((v.reshape(h, -1, 1) >> np.arange(depth - 1, -1, -1)) & 1).reshape(h, -1).astype(np.uint8)
        raw = np.packbits(bits, axis=1).tobytes()
    stride = len(raw) // h
    rows = [raw[i * stride : (i + 1) * stride] for i in range(h)]
    body = zlib.compress(_filtered(rows, max(1, n * depth // 8), (0, 1, 2, 3, 4)))
    palette = RND.integers(0, 256, (1 << min(depth, 8), 3)).astype(np.uint8)
    data = png.MAGIC + png.chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, 0)) + (png.chunk(b"PLTE", palette.tobytes()) if colour == 3 else b"") + png.chunk(b"IDAT", body) + png.chunk(b"IEND", b"")
    got = png.decode(data)
    level = v >> 8 if depth == 16 else v * (255 // ((1 << depth) - 1)) if colour != 3 else v
    want = palette[v[..., 0]] if colour == 3 else level[..., :3] if n > 2 else np.repeat(level[..., :1], 3, 2)
    assert np.array_equal(got[..., :3], want)
    if n in (2, 4):
        assert np.array_equal(got[..., 3], level[..., -1])


def test_png_refuses():
    good = png.encode(np.zeros((2, 2, 4), np.uint8))
    laced = png.MAGIC + png.chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 2, 8, 6, 0, 0, 1)) + png.chunk(b"IEND", b"")
    for bad in (b"", good[:-20], good.replace(b"IDAT", b"IDAX"), laced):
        with pytest.raises(ValueError):
            png.decode(bad)


@pytest.mark.parametrize("shape", [(8, 8), (17, 23), (40, 9)])
def test_jpeg(shape):
    y, x = np.mgrid[: shape[0], : shape[1]]
    m = np.stack([x * 9 % 256, y * 5 % 256, (x + y) * 3 % 256, np.full(shape, 255)], axis=2).astype(np.uint8)
    smooth = np.stack([x * 4, y * 4, 128 + x - y, np.full(shape, 255)], axis=2).clip(0, 255).astype(np.uint8)
    data = jpeg.encode(smooth, 95)
    assert jpeg.size(data) == shape[::-1]
    assert np.abs(jpeg.decode(data).astype(int) - smooth).max() <= 6
    assert np.abs(jpeg.decode(jpeg.encode(m, 95)).astype(int) - m).mean() < 12
    assert jpeg.decode(jpeg.encode(np.full((9, 9, 4), 255, np.uint8)))[..., :3].min() >= 253
    assert images.decode(data).shape == (*shape, 4)
    with pytest.raises(ValueError):
        jpeg.decode(data.replace(b"\xff\xc0", b"\xff\xc2"))


def test_animations():
    frames = [RND.integers(0, 256, (6, 5, 4)).astype(np.uint8) for _ in range(3)]
    data = animations.encode_apng(frames, [40, 80, 1000])
    assert animations.apng_delays(data) == [40, 80, 1000] and np.array_equal(png.decode(data), frames[0])
    palette = np.array([(0, 0, 0), (255, 0, 0), (0, 255, 0), (9, 9, 200)], np.uint8)
    index = RND.integers(0, 5, (70, 90))
    full = np.zeros((70, 90, 4), np.uint8)
    full[..., :3] = np.vstack([palette, palette[:1]])[index]
    full[..., 3] = np.where(index == 4, 0, 255)
    assert animations.gif_frames(animations.encode_gif([full], palette, [100])) == [index.ravel().tolist()]
    assert animations.gif_frames(data) is None
    ico = animations.encode_ico([np.zeros((256, 256, 4), np.uint8), np.zeros((16, 16, 4), np.uint8)])
    assert [(e["width"], e["kind"]) for e in animations.ico_entries(ico)] == [(16, "bmp"), (256, "png")]
    with pytest.raises(ValueError):
        animations.encode_ico([np.zeros((3, 4, 4), np.uint8)])


def test_regions():
    m = np.array([[int(c) for c in r] for r in ("0111000", "0101011", "0111011", "0000100", "1000000")], bool)
    lab, n = regions.label(m)
    assert n == 2 and lab[0, 1] == 1 and lab[4, 0] == 2 and lab[3, 4] == lab[1, 5] == 1
    assert regions.filled(m)[1, 2] and not regions.filled(m)[0, 0]
    d = regions.chamfer(np.ones((5, 5), bool))
    assert d[2, 2] == 9 and d[0, 0] == 3
    bar = np.zeros((9, 20), bool)
    bar[3:6, 2:18] = True
    bones = regions.thin(bar)
    assert bones.sum() and (bones & ~bar).sum() == 0 and regions.label(bones)[1] == 1 and (regions.crossings(bones) == 1).sum() == 2
    speck = np.zeros((6, 6), np.int32)
    speck[2, 2] = 1
    assert (regions.despeckle(speck, 2) == 0).all() and (regions.majority(speck) == 0).all()


def test_outlines():
    mask = RND.random((12, 15)) < 0.5
    loops = outlines.pixel_loops(mask)
    assert sum(outlines.area(p) for p in loops) == mask.sum()
    assert np.array_equal(outlines.coverage([[(float(x), float(y)) for x, y in p] for p in loops], 15, 12) > 0.5, mask)
    assert outlines.area([(0, 0), (4, 0), (4, 3), (0, 3)]) == 12
    line = [(i, 0.01 * (i % 2)) for i in range(50)]
    assert len(outlines.simplify(line, 0.1)) == 2 and len(outlines.simplify(line, 0.001)) > 2
    square = outlines.flatten("M1 1H5V4H1Z M0,0 C0 1 1 1 1 0")
    assert len(square) == 2 and outlines.coverage(square[:1], 8, 8).sum() == pytest.approx(12)
    for bad in ("m1 1", "M1", "L", "M1 1 A2 2", "1 2"):
        with pytest.raises(ValueError):
            outlines.flatten(bad)


def test_packing():
    sizes = [(int(a), int(b)) for a, b in RND.integers(3, 40, (60, 2))]
    at, w, h = outlines.shelf_pack(sizes, 2)
    grid = np.zeros((h + 2, w + 2), int)
    for (x, y), (a, b) in zip(at, sizes, strict=True):
        assert x + a <= w and y + b <= h
        grid[y : y + b, x : x + a] += 1
    assert grid.max() == 1
    with pytest.raises(ValueError):
        outlines.shelf_pack([(9000, 3)])


def test_palettes():
    rgb = np.array([(10, 10, 10)] * 20 + [(200, 0, 0)] * 20 + [(0, 0, 220)] * 20)
    assert {tuple(c) for c in quantise.median_cut(rgb, 3).tolist()} == {(10, 10, 10), (200, 0, 0), (0, 0, 220)}
    assert len(quantise.median_cut(rgb, 9)) <= 9 and len(quantise.median_cut(rgb[:0], 3)) == 0
    m = np.full((8, 8, 4), 120, np.uint8)
    m[..., 3] = 255
    m[0, 0, 3] = 0
    out = quantise.map_to(m, np.array([(0, 0, 0), (255, 255, 255)], np.uint8), dither=True)
    assert out[0, 0].tolist() == m[0, 0].tolist() and 0.2 < (out[1:, :, 0] == 255).mean() < 0.8


def test_files(spark, tmp_path):
    m = RND.integers(0, 256, (3, 5, 4)).astype(np.uint8)
    (tmp_path / "a.jpg").write_bytes(png.encode(m))
    (tmp_path / "b.png").write_bytes(b"no picture at all")
    rows = {r.path[-5:]: r for r in images.read_images(spark, str(tmp_path)).collect()}
    assert rows["a.jpg"].mime == "image/png" and bytes(rows["a.jpg"].data) == m.tobytes() and rows["b.png"].error
    packed = spark.createDataFrame([(1, 5, 3, bytearray(m.tobytes()))], "image_id bigint, width int, height int, data binary")
    assert np.array_equal(png.decode(bytes(images.encode_column(packed).first().png)), m)
