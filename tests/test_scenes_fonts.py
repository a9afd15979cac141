"""Scenes, fonts, settings and service clients."""

import base64
import json
import struct

import numpy as np
import pytest

from tessera.functions import config
from tessera.operators import outlines, scene
from tessera.sources import clients, fonts, png


def tiny_font(kern=-50):
    def glyph(points):
        xs, ys = np.array(points).T
        step = lambda v: struct.pack(f">{len(v)}h", *np.diff(v, prepend=0).tolist())
        return struct.pack(">hhhhhHH", 1, xs.min(), ys.min(), xs.max(), ys.max(), len(points) - 1, 0) + b"\1" * len(points) + step(xs) + step(ys) + b"\0" * (len(points) % 2)

    square, wedge = glyph([(100, 0), (500, 0), (500, 400), (100, 400)]), glyph([(100, 0), (500, 0), (300, 500)])
    both = struct.pack(">hhhhhHHhhHHhh", -1, 0, 0, 0, 0, 0x23, 1, 0, 0, 0x03, 2, 600, 0)
    both += b"\0" * (len(both) % 2)
    ends = np.cumsum([0, 0, len(square), len(wedge), len(both)])
    cmap4 = struct.pack(">HHHHHHH", 4, 32, 0, 4, 0, 0, 0) + struct.pack(">HHHHHHHHH", 67, 0xFFFF, 0, 65, 0xFFFF, (1 - 65) & 0xFFFF, 1, 0, 0)
    tables = {
        "head": bytes(18) + struct.pack(">H", 1000) + bytes(34), "hhea": struct.pack(">Ihhh", 0x10000, 800, -200, 90) + bytes(24) + struct.pack(">H", 1), "maxp": struct.pack(">IH", 0x10000, 4),
        "hmtx": struct.pack(">Hh", 600, 0) + bytes(6), "cmap": struct.pack(">HHHHI", 0, 1, 3, 1, 12) + cmap4, "loca": struct.pack(">5H", *(ends // 2)), "glyf": square + wedge + both,
        "kern": struct.pack(">HHHHHHHHH", 0, 1, 0, 20, 1, 1, 0, 0, 0) + struct.pack(">HHh", 1, 2, kern),
    }
    at, head, body = 12 + 16 * len(tables), struct.pack(">IHHHH", 0x10000, len(tables), 0, 0, 0), b""
    for n, t in tables.items():
        head += n.encode() + struct.pack(">III", 0, at + len(body), len(t))
        body += t + b"\0" * (-len(t) % 4)
    return head + body


def test_font():
    f = fonts.Font(tiny_font())
    assert f.cmap == {65: 1, 66: 2, 67: 3} and f.advance(3) == 600 and f.kern(1, 2) == -50 and f.kern(2, 1) == 0
    assert len(f.contours(1)) == 1 and len(f.contours(3)) == 2 and f.contours(0) == []
    line = fonts.text_path(f, "AB?", 100)
    assert line["missing"] == ["?"] and line["width"] == pytest.approx(115)
    a, b = outlines.flatten(line["d"])
    assert abs(outlines.area(a)) == pytest.approx(1600) and min(x for x, _ in b) == pytest.approx(65)
    ring = [(0, 0, False), (10, 0, False), (10, 10, False), (0, 10, False)]
    assert fonts.contour_path(ring).count("C") == 4
    for bad in (b"", b"OTTO" + bytes(40), tiny_font()[:60]):
        with pytest.raises(ValueError):
            fonts.Font(bad).cmap


SPEC = {
    "canvas": (100, 80), "fps": 20, "layers": [{"id": "root", "pivot": (50, 40), "children": [{"id": "a", "paths": ["p"], "translateX": 3}, {"id": "b", "paths": ["q"], "pivot": (10, 10)}]}],
    "animate": [{"target": "root", "at": 0, "for": 500, "rotate": (0, 360)}, {"target": ["a", "b"], "at": 100, "for": 200, "stagger": 50, "opacity": (0, 1)}, {"target": "b", "at": 0, "for": 400, "scale": (1, 2)}],
}


def test_scene():
    s = scene.build(SPEC)
    assert s.duration == 500 and [n.id for n, _ in scene.walk(s.roots)] == ["root", "a", "b"]
    b = s.roots[0].children[1]
    assert [scene.value(s, b, "opacity", t) for t in (0, 150, 250, 350, 400)] == pytest.approx([0, 0, 0.5, 1, 1])
    (_, m, o), (_, n, _) = scene.pose(s, 125)
    assert m == pytest.approx((0, 1, -1, 0, 90, -7)) and o == pytest.approx(0.125)
    assert n[:4] == pytest.approx((0, 1.3125, -1.3125, 0))
    assert scene.unsettled(s) == ["b.scaleX", "b.scaleY"]
    assert [p[2] for p in scene.pose(s, 0, rest=True)] == [1, 1]
    assert scene.frame_times(500, 20, 100) == [50.0 * k for k in range(11)] + [500, 500]
    text = scene.svg(s, {"p": "M0 0H5V5Z", "q": "M0 0H9V9Z"}, {"p": "#123456"})
    assert text.count("@keyframes") == 2 and "prefers-reduced-motion" in text
    doc = scene.lottie(s)
    assert doc["op"] == 11 and [x["nm"] for x in doc["layers"]] == ["b", "a", "root"] and doc["layers"][0]["parent"] == 1
    json.dumps(doc)


@pytest.mark.parametrize("change", [{"layers": []}, {"duration": 10}, {"fps": 0}, {"animate": [{"target": "no", "for": 1, "rotate": (0, 1)}]}, {"animate": [{"target": "a", "for": 9, "rotate": (0, 1)}] * 2}, {"layers": [{"id": "x", "paths": ["p"]}, {"id": "x"}]}, {"layers": [{"id": "x", "paths": ["p"]}, {"id": "y", "paths": ["p"]}]}, {"layers": [{"id": "x", "paths": ["p"], "children": [{"id": "y"}]}]}])
def test_scene_refuses(change):
    with pytest.raises(ValueError):
        scene.build(SPEC | {"animate": SPEC["animate"] if "layers" not in change else []} | change)


def test_settings(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"key": {"tolerance": 40}, "palette": ["#ABC"], "sizes": ["64", "32x16"], "out": "from-file"}))
    c = config.load(str(tmp_path / "c.json"), {"quantize": True}, {"TESSERA_OUT": "from-env", "TESSERA_BUDGET": "7"})
    assert c["key"] == {"tolerance": 40, "despill": True} and c["palette"] == ["#aabbcc"] and c["sizes"] == [(64, 64), (32, 16)]
    assert c["out"] == "from-env" and c["budget"] == 7 and c["quantize"] and config.DEFAULTS["out"] == "out"
    for bad in ({"size": "3K"}, {"candidates": 9}, {"palette": ["teal"]}, {"key": {"tolerance": 0}}, {"sizes": ["9999"]}, {"pixel": {"grid": 2}}, {"budget": -1}, {"brief": " "}):
        with pytest.raises(ValueError):
            config.load(None, bad, {})


def test_clients():
    picture, waits = png.encode(np.zeros((2, 2, 4), np.uint8)), []
    c = clients.ImageClient(clients.offline(picture), "x", lambda u: u["image"] / 1e6 * 30, estimate=0.04, budget=0.07)
    got = c.generate("a square", [picture])
    assert got["image"] == picture and len(got["turns"]) == 2 and c.spent() == pytest.approx(0.0336)
    with pytest.raises(clients.ServiceError):
        c.generate("one more")
    blocked = clients.ImageClient(lambda u, b: (200, {}), "x", lambda u: None).generate("no")
    assert blocked["image"] is None and blocked["record"]["blocked"] and blocked["record"]["cost"] is None
    answers = iter([(503, {}), (429, {}), (200, {"ok": 1})])
    assert clients.call(lambda u, b: next(answers), "x", {}, waits.append) == {"ok": 1} and waits == [3, 8]
    for status in (400, 500):
        with pytest.raises(clients.ServiceError):
            clients.call(lambda u, b, s=status: (s, {"error": {"message": "no"}}), "x", {}, waits.append)
    asked = []

    def judge(url, body):
        asked.append(body["generationConfig"]["maxOutputTokens"])
        return 200, {"candidates": [{"finishReason": "MAX_TOKENS" if len(asked) < 3 else "STOP", "content": {"parts": [{"text": '{"pick": 2}'}]}}]}

    assert clients.JudgeClient(judge, "x").ask("which?", {}) == {"pick": 2} and asked == [4096, 8192, 16384]
    assert base64.b64decode(clients.image_part(picture)["inlineData"]["data"]) == picture
    assert clients.image_models({"models": [{"name": "models/an-image", "supportedGenerationMethods": ["generateContent"]}, {"name": "models/text"}]}) == ["an-image"]


def test_settings_say_all_that_is_wrong():
    bad = {"aspect": "5:1", "thinking": {"level": "some"}, "judge_thinking": {"budget": -1}, "pixel": {"grid": 32, "colors": 1}, "key": 5, "thresholds": {"jump": 2}, "context": {"files": [""]}, "model": " ", "sizes": ["4x4x4"]}
    _, wrong = config.problems(config.merge(config.DEFAULTS, {}) | bad)
    named = {w.split(":")[0] for w in wrong}
    assert {"aspect", "thinking.level", "judge_thinking.budget", "pixel.colors", "key", "thresholds.jump", "context.files", "model", "sizes"} <= named
    assert config.problems(config.DEFAULTS)[1] == []


def test_scene_says_all_that_is_wrong():
    spec = {"canvas": (9, 9), "fps": 500, "layers": [{"id": "1a", "opacity": 2}, {"id": "b", "scaleX": 3}], "animate": [{"target": "b", "for": 5, "scale": (1, 2)}, {"target": "c", "for": 5, "blur": (1, 2)}, {"target": "b", "at": 4, "for": -1, "rotate": (0, 1)}, {"target": "b", "for": 1}]}
    wrong = scene.complaints(spec, scene.layer_table(spec), scene.segment_table(spec))
    assert len(wrong) == 7
