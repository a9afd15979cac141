"""Trimmed atlases, cell geometry and terrain faults against expected values."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from tessera.plans import gates, sheets
from tessera.plans.atlases import cell_mask


def test_trim_puts_frames_back():
    rnd = np.random.default_rng(2)
    cells = rnd.integers(0, 256, (30, 9, 7, 4)).astype(np.uint8)
    cells[3, ..., 3] = 0
    cells[4, :, :5, 3] = 20
    for least, margin in ((1, 0), (1, 2), (200, 0), (200, 1)):
        atlas, places = sheets.trim(cells, least, margin)
        taken = np.zeros(atlas.shape[:2], int)
        for (x, y, w, h, bx, by, empty), c in zip(places, cells, strict=True):
            taken[y : y + h, x : x + w] += 1
            assert 0 <= bx and bx + w <= 7 and 0 <= by and by + h <= 9
            back = sheets.restore(atlas, (x, y, w, h, bx, by, empty), 9, 7)
            outside = np.ones((9, 7), bool)
            if not empty:
                outside[by : by + h, bx : bx + w] = False
            assert (back[~outside] == c[~outside]).all() and not back[outside].any()
            bad, faint, lost = sheets.compare(back, c, least)
            a = c[..., 3]
            assert (bad, faint, lost) == (0, int((outside & (a > 0) & (a < 128)).sum()), int((outside & (a >= 128)).sum()))
        assert taken.max() == 1 and not taken[:2].any() and not taken[:, :2].any()
    moved = cells[0].copy()
    moved[4, 4] ^= 255
    assert sheets.compare(moved, cells[0], 1)[0] == 1


def test_geometry():
    assert sheets.cell_geometry(32) == (10, 4) and sheets.cell_geometry(16) == (5, 2)
    m, r = sheets.cell_geometry(32, 15)
    assert m == 15 and r < 7 and cell_mask(0, 32, m, r)[16, 16] and cell_mask(1, 32, m, r)[0, 16]


def test_faults():
    good = cell_mask(0b0001, 16)
    assert sheets.cell_faults(good, 1) == (False, False)
    assert sheets.cell_faults(good, 2)[1]
    hole = good.copy()
    hole[8, 8] = False
    assert sheets.cell_faults(hole, 1)[0]
    stray = good.copy()
    stray[15, 3] = True
    assert sheets.cell_faults(stray, 1)[1]


def test_terrain_coverage(spark):
    rows = sheets.terrain_coverage(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 47 and not any(r.hollow or r.misdrawn or r.gaps for r in rows)


def test_terrain_text():
    t = gates.terrain_text()
    assert t.count("/0 = 0\n") == 47 and t.count("peering_bit") == sum(bin(k).count("1") for k in gates.KEYS)


def test_chunks_hand_frames_on(spark, monkeypatch):
    """Actions over many chunks, some of them without a frame of the action: as one window over the action has it."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from tessera.plans import fixtures as X

    d = spark.createDataFrame([(i, a, None if i % 11 == 0 else f"p{i}") for i in range(500) for a in ([1, 2, None][i % 3],) if not 100 < i < 260 or a == 2], "image_id bigint, action bigint, v string")
    w = Window.partitionBy("action").orderBy("image_id")
    want = d.select("image_id", (F.row_number().over(w) - 1).cast("long").alias("frame_ix"), F.lag("v").over(w).alias("low"))
    monkeypatch.setattr(X, "CHUNK", 16)
    got = X.in_sequence(d, "v")
    assert got.columns == ["image_id", "action", "v", "low", "frame_ix"]
    assert sorted(map(tuple, got.select("image_id", "frame_ix", "low").collect())) == sorted(map(tuple, want.collect()))
    assert X.in_sequence(d).columns == ["image_id", "action", "v", "frame_ix"]


def _tiles_by_hand(t):
    """Tiles, cells out of the terrain and wrong cells of a terrain text, line by line."""
    ls = re.split("\r\n|[\n\r\u0085\u2028\u2029]", t)
    of = lambda kind: [m[1] for s in ls if (m := re.fullmatch(rf"([0-9]+:[0-9]+)/0{kind} = 0", s))]
    bits = {(m[1], m[2]) for s in ls if (m := re.fullmatch(r"([0-9]+:[0-9]+)/0/terrains_peering_bit/([A-Za-z0-9_]+) = 0", s))}
    want = {(f"{i % 8}:{i // 8}", b) for i, bs in enumerate(gates.DECLARED) for b in bs}
    cells, ts = {f"{i % 8}:{i // 8}" for i in range(47)}, of("")
    own = {b for b in bits if b[0] in ts}
    return len(ts), len(set(ts) - (set(of("/terrain_set")) & set(of("/terrain")))), len({c for c, _ in own ^ want} | cells - set(ts))


def _odd_texts():
    whole = gates.terrain_text()
    ls = whole.split("\n")
    tile = [i for i, s in enumerate(ls) if re.fullmatch(r"\d+:\d+/0 = 0", s)]
    out = ["", "\n", "0:0/0 = 0", whole, whole[:-1], whole * 2, "\n" + whole, whole.replace("\n", "\r\n"), whole.replace("\n", "\u2028", 9), whole.replace("\n", "\r")]
    out += [whole.replace("\n2:1/0 = 0\n", end) for end in ("\r2:1/0 = 0\n", "\n2:1/0 = 0\r\n", "\u00852:1/0 = 0\n", "\n2:1/0 = 0 \n", "\nx2:1/0 = 0\n", "\n2:1/0 = 1\n")]
    out += [whole + more for more in ("9:9/0 = 0\n", "9:9/0 = 0", "x9:9/0 = 0\n" * 2, "/0 = 0\n", "9:9/0/terrains_peering_bit/top_side = 0\n", "9:9/0 = 0\n9:9/0/terrain = 0\n9:9/0/terrain_set = 0\n")]
    out += [whole + f"{c}/0/terrains_peering_bit/{b} = 0\n" + end for c in ("0:0", "6:5", "9:9") for b in ("top_side", "other") for end in ("", "9:9/0 = 0\n", "9:9/0 = 0\r9:9/0 = 0\n")]
    draw = random.Random(7)
    for _ in range(150):
        a = list(ls)
        for _ in range(draw.randint(1, 4)):
            at, to = draw.choice([draw.choice(tile), draw.randrange(len(a))]), draw.randrange(len(a))
            line = a[at % len(a)]
            match draw.randrange(5):
                case 0: del a[at % len(a)]  # noqa: E701
                case 1: a.insert(to, line)  # noqa: E701
                case 2: a.insert(to, a.pop(at % len(a)))  # noqa: E701
                case 3: a[to] = re.sub(r"^\d", str(draw.randrange(10)), line)  # noqa: E701
                case 4: a[to] += draw.choice(["\r", " ", "\u2028" + line, "\r" + line])  # noqa: E701
        out.append("\n".join(a))
    draw.shuffle(ls)
    return [*out, "\n".join(ls)]


def test_check_tiles_of_odd_texts(spark):
    texts = _odd_texts()
    rows = gates.check_tiles(spark.createDataFrame(list(enumerate(texts)), "id bigint, t string")).collect()
    got = {r.id: (r.tiles, r.outside, r.wrong) for r in rows}
    want = {i: _tiles_by_hand(t) for i, t in enumerate(texts)}
    assert {i: (texts[i][-200:], got[i], want[i]) for i in want if got[i] != want[i]} == {}
    assert all(r.ok == (want[r.id] == (47, 0, 0)) for r in rows) and 1 < sum(r.ok for r in rows) < len(rows)


def test_terrain_texts(spark):
    whole = "\n" + gates.terrain_text()
    for k, t in spark.range(188 * 2).select("id", gates._texts(F.col("id"))).collect():
        at, bits = f"{k % 47 % 8}:{k % 47 // 8}/0", gates.DECLARED[k % 47]
        gone = (f"{at}/terrains_peering_bit/{bits[0] if bits else '-'} = 0\n", "-", f"{at}/terrain = 0\n", f"{at} = 0\n")[k % 4]
        assert t == whole.replace("\n" + gone, "\n"), k


def test_recheck_tile_set_shares_out_its_texts(spark, tmp_path):
    # A table of one row group is read by one task; the texts made of its ids have to be shared out.
    spark.range(188).withColumnRenamed("id", "p_partkey").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    d = gates.recheck_tile_set(spark, str(tmp_path))
    assert d.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert d.where("ok").count() == 48 and d.distinct().count() == 188
