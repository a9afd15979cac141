"""Sheet queries without SQL against plain versions."""

import numpy as np

from tessera.operators.quantise import lab
from tessera.plans import atlases, fixtures

SF = "/root/testdata/sf0.001"


def plain_palette(m, count):
    bins = {}
    for p in m[m[:, 3] >= 128][:, :3].tolist():
        bins.setdefault(tuple(v >> 3 for v in p), []).append(p)
    out = []
    for b in sorted(bins.values(), key=len, reverse=True):
        c = lab(np.floor(np.mean(b, axis=0) + 0.5))
        hit = next((o for o in out if np.linalg.norm(o[0] - c) < 8), None)
        if hit:
            hit[1] += len(b)
        else:
            out.append([c, len(b)])
        if len(out) >= 3 * count:
            break
    return sorted(out, key=lambda o: -o[1])[:count]


def plain_strip(ink, count):
    runs, gap = [], 2
    for x, on in enumerate(ink):
        if on and runs and x - runs[-1][1] < gap:
            runs[-1][1] = x + 1
        elif on:
            runs.append([x, x + 1])
    found = len(runs)
    if found < count:
        return found, "equal", [[int(i * 16 / count + 0.5), int((i + 1) * 16 / count + 0.5)] for i in range(count)]
    while len(runs) > count:
        i = min(range(len(runs) - 1), key=lambda i: runs[i + 1][0] - runs[i][1])
        runs[i : i + 2] = [[runs[i][0], runs[i + 1][1]]]
    return found, "gaps" if found == count else "merged", runs


def test_sheets(spark):
    data = {r.image_id: np.array(r.data) for r in fixtures.packed(spark, SF).collect()}
    got = {}
    for r in atlases.dominant_palette(spark, SF).orderBy("image_id", "place").collect():
        got.setdefault(r.image_id, []).append((r.lab_l, r.lab_a, r.lab_b, r.n))
    strips = {}
    for r in atlases.slice_strip(spark, SF).orderBy("image_id", "cell").collect():
        strips.setdefault(r.image_id, (r.found, r.method, []))[2].append([r.start, r.stop])
    for k, d in data.items():
        want = plain_palette(d.reshape(16, 4), 8)
        assert len(got.get(k, [])) == len(want)
        assert np.allclose([g[:3] for g in got.get(k, [])], [w[0] for w in want], atol=1e-3) if want else True
        assert [g[3] for g in got.get(k, [])] == [w[1] for w in want]
        assert strips[k] == plain_strip((d.reshape(4, 16) >= 170).any(axis=0), 3)
    delta = {r.image_id: r.delta for r in atlases.palette_delta(spark, SF).collect()}
    assert len(delta) == len(data) and min(v for v in delta.values() if v is not None) == 0


def test_terrain(spark):
    joins = atlases.terrain_joins(spark, SF).collect()
    assert len(joins) == 338 and all(r.joins for r in joins)
    alone, solid = atlases.cell_mask(0), atlases.cell_mask(255)
    assert solid.all() and alone[8, 8] and not alone[0].any()


def test_names(spark):
    rows = atlases.palette_names(spark, SF).where("id = 7").collect()
    assert len({r.name for r in rows}) == len(rows) >= 2
