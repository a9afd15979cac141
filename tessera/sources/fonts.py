"""TrueType fonts: directory, character map, metrics, kerning, outlines and the path of a line of text."""

from __future__ import annotations

import struct
from functools import cached_property

#: Levels of composite glyphs, and points of one glyph, beyond which a font is refused.
DEPTH, POINTS = 5, 1 << 21


def _u16(b: bytes, at: int) -> int:
    return struct.unpack_from(">H", b, at)[0]


def _i16(b: bytes, at: int) -> int:
    return struct.unpack_from(">h", b, at)[0]


def _u32(b: bytes, at: int) -> int:
    return struct.unpack_from(">I", b, at)[0]


class Font:
    """A font from its bytes; what is cut short or missing is a ValueError."""

    def __init__(self, data: bytes):
        self.data = data
        if data[:4] not in (b"\0\1\0\0", b"true"):
            raise ValueError("not a TrueType font")
        try:
            self.tables = {data[12 + 16 * i : 16 + 16 * i].decode("latin1"): (_u32(data, 20 + 16 * i), _u32(data, 24 + 16 * i)) for i in range(_u16(data, 4))}
            head, hhea, maxp = (self.table(n) for n in ("head", "hhea", "maxp"))
            self.units, self.long_loca, self.count = _u16(head, 18), _i16(head, 50) == 1, _u16(maxp, 4)
            self.ascender, self.descender, self.line_gap = (_i16(hhea, i) for i in (4, 6, 8))
            self.metrics = _u16(hhea, 34)
        except struct.error as e:
            raise ValueError("the font ends early") from e
        if not self.units or not self.metrics:
            raise ValueError("a font without units or metrics")

    def table(self, name: str) -> bytes:
        if name not in self.tables:
            raise ValueError(f"a font without {name}")
        at, n = self.tables[name]
        return self.data[at : at + n]

    @cached_property
    def cmap(self) -> dict[int, int]:
        """Glyph of each character: the best Unicode table of formats 12 and 4; a symbol table also answers below 256."""
        t = self.table("cmap")
        order = {(3, 10): 0, (0, 6): 1, (0, 4): 2, (3, 1): 3, (0, 3): 4, (0, 2): 5, (0, 1): 6, (0, 0): 7, (3, 0): 8}
        found = sorted((order[_u16(t, 4 + 8 * i), _u16(t, 6 + 8 * i)], _u32(t, 8 + 8 * i)) for i in range(_u16(t, 2)) if (_u16(t, 4 + 8 * i), _u16(t, 6 + 8 * i)) in order)
        for rank, at in found:
            if _u16(t, at) == 12:
                out = {}
                for i in range(min(_u32(t, at + 12), 1 << 16)):
                    first, last, glyph = struct.unpack_from(">III", t, at + 16 + 12 * i)
                    out.update((c, glyph + c - first) for c in range(first, min(last, 0x10FFFF) + 1))
                return out
            if _u16(t, at) == 4:
                n, out = _u16(t, at + 6), {}
                for i in range(0, n, 2):
                    last, first = _u16(t, at + 14 + i), _u16(t, at + 16 + n + i)
                    delta, offset = _u16(t, at + 16 + 2 * n + i), _u16(t, at + 16 + 3 * n + i)
                    for c in range(first, last + 1):
                        place = at + 16 + 3 * n + i + offset + 2 * (c - first)
                        g = c if not offset else _u16(t, place) if place + 2 <= len(t) else 0
                        g = (g + delta) & 0xFFFF if g or not offset else 0
                        if g:
                            out[c] = g
                if rank == 8:
                    out |= {c & 0xFF: g for c, g in out.items() if 0xF000 <= c <= 0xF0FF}
                return out
        raise ValueError("a font without a character map that is read")

    def advance(self, glyph: int) -> int:
        """From the metrics; glyphs past them have the last."""
        return _u16(self.table("hmtx"), 4 * min(glyph, self.metrics - 1))

    @cached_property
    def pairs(self) -> dict[tuple[int, int], int]:
        """The old kerning table's horizontal pairs; none without one."""
        if "kern" not in self.tables:
            return {}
        t, at, out = self.table("kern"), 4, {}
        for _ in range(_u16(t, 2)):
            length, cover = _u16(t, at + 2), _u16(t, at + 4)
            if cover >> 8 == 0 and cover & 5 == 1:
                for i in range(_u16(t, at + 6)):
                    left, right, v = struct.unpack_from(">HHh", t, at + 14 + 6 * i)
                    out[left, right] = out.get((left, right), 0) + v
            at += length
        return out

    def kern(self, left: int, right: int) -> int:
        return self.pairs.get((left, right), 0)

    def _place(self, glyph: int) -> bytes:
        loca, wide = self.table("loca"), 4 if self.long_loca else 2
        if not 0 <= glyph < self.count or (glyph + 2) * wide > len(loca):
            return b""
        a, b = (_u32(loca, g * 4) if self.long_loca else 2 * _u16(loca, g * 2) for g in (glyph, glyph + 1))
        return self.table("glyf")[a:b]

    def contours(self, glyph: int, depth: int = 0) -> list[list[tuple[float, float, bool]]]:
        """Closed contours of (x, y, on the curve); components by offset only."""
        b = self._place(glyph)
        if not b or depth > DEPTH:
            return []
        n = _i16(b, 0)
        try:
            return self._simple(b, n) if n >= 0 else self._composite(b, depth)
        except (struct.error, IndexError) as e:
            raise ValueError(f"glyph {glyph} ends early") from e

    def _simple(self, b: bytes, n: int):
        ends = [_u16(b, 10 + 2 * i) for i in range(n)]
        count = ends[-1] + 1 if ends else 0
        if count > POINTS:
            raise ValueError("a glyph of too many points")
        at, flags = 12 + 2 * n + _u16(b, 10 + 2 * n), []
        while len(flags) < count:
            f = b[at]
            at += 1
            flags.append(f)
            if f & 8:
                flags += [f] * b[at]
                at += 1
        axes = []
        for short, same in ((2, 16), (4, 32)):
            v, out = 0, []
            for f in flags[:count]:
                if f & short:
                    v += b[at] if f & same else -b[at]
                    at += 1
                elif not f & same:
                    v += _i16(b, at)
                    at += 2
                out.append(v)
            axes.append(out)
        points = list(zip(*axes, (bool(f & 1) for f in flags), strict=False))
        return [points[a + 1 : e + 1] for a, e in zip([-1, *ends], ends, strict=False)]

    def _composite(self, b: bytes, depth: int):
        at, out, flags = 10, [], 32
        while flags & 32:
            flags, glyph = _u16(b, at), _u16(b, at + 2)
            at += 4
            dx, dy = struct.unpack_from(">hh" if flags & 1 else ">bb", b, at)
            at += 4 if flags & 1 else 2
            n = 1 if flags & 8 else 2 if flags & 64 else 4 if flags & 128 else 0
            v = [x / 16384 for x in struct.unpack_from(f">{n}h", b, at)]
            at += 2 * n
            xx, xy, yx, yy = (v[0], 0, 0, v[0]) if n == 1 else (v[0], 0, 0, v[1]) if n == 2 else v if n == 4 else (1, 0, 0, 1)
            if flags & 2:
                out += [[(xx * x + yx * y + dx, xy * x + yy * y + dy, on) for x, y, on in c] for c in self.contours(glyph, depth + 1)]
        return out


def contour_path(contour, at=lambda x, y: (x, y)) -> str:
    """A quadratic contour as cubic path text; between two control points lies a point of the curve."""
    if len(contour) < 2:
        return ""
    first = next((i for i, p in enumerate(contour) if p[2]), None)
    mid = lambda p, q: ((p[0] + q[0]) / 2, (p[1] + q[1]) / 2)
    start = contour[first][:2] if first is not None else mid(contour[-1], contour[0])
    ring = contour[first + 1 :] + contour[: first + 1] if first is not None else [*contour, (*start, True)]
    put = lambda p: " ".join(f"{v:.2f}".rstrip("0").rstrip(".") for v in at(*p))
    out, now, ctrl = [f"M{put(start)}"], start, None

    def curve(c, to):
        a, b = (tuple(p + (q - p) * 2 / 3 for p, q in zip(e, c, strict=True)) for e in (now, to))
        out.append(f"C{put(a)} {put(b)} {put(to)}")

    for x, y, on in ring:
        if on:
            if ctrl is None:
                out.append(f"L{put((x, y))}")
            else:
                curve(ctrl, (x, y))
            now, ctrl = (x, y), None
        else:
            if ctrl is not None:
                to = mid(ctrl, (x, y))
                curve(ctrl, to)
                now = to
            ctrl = (x, y)
    if ctrl is not None:
        curve(ctrl, start)
    return " ".join(out) + " Z"


def text_path(font: Font, text: str, size: float = 100.0, tracking: float = 0.0, kerning: bool = True) -> dict:
    """One path for a line, y down, with its width and the characters that are missing or blank."""
    s, pen, last, parts, missing, blank = size / font.units, 0.0, None, [], [], []
    for ch in text:
        g = font.cmap.get(ord(ch), 0)
        if not g:
            missing.append(ch)
            continue
        if last is not None:
            pen += tracking + (font.kern(last, g) * s if kerning else 0.0)
        shape = font.contours(g)
        if not shape and not ch.isspace():
            blank.append(ch)
        parts += [contour_path(c, lambda x, y, pen=pen: (pen + x * s, font.ascender * s - y * s)) for c in shape]
        pen += font.advance(g) * s
        last = g
    return {"d": " ".join(p for p in parts if p), "width": pen, "missing": missing, "blank": blank}
