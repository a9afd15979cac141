"""Colour conversions and differences as column expressions; each has a twin that writes the SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.numbers import byte

# sRGB to XYZ under D65, the white point, and the published full-dichromacy matrices.
XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.072175), (0.0193339, 0.119192, 0.9503041))
WHITE = (0.95047, 1.0, 1.08883)
VISION = {
    "protanopia": ((0.152286, 1.052583, -0.204868), (0.114503, 0.786281, 0.099216), (-0.003882, -0.048116, 1.051998)),
    "deuteranopia": ((0.367322, 0.860646, -0.227968), (0.280085, 0.672501, 0.047413), (-0.01182, 0.04294, 0.968881)),
    "tritanopia": ((1.255528, -0.076749, -0.178779), (-0.078411, 0.930809, 0.147602), (0.004733, 0.691367, 0.3039)),
}
#: (least argument of the cube root, slope, offset) of the two Lab variants in use.
COARSE = (0.008856, 7.787, 16 / 116)
EXACT = (216 / 24389, 24389 / 27 / 116, 16 / 116)


def linear(v: Column, knee: float = 0.04045) -> Column:
    """An sRGB byte as linear light."""
    c = v / 255.0
    return F.when(c <= knee, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, 2.4))


def linear_sql(v: str, knee: float = 0.04045) -> str:
    return f"(CASE WHEN ({v}) / 255.0::DOUBLE <= {knee} THEN ({v}) / 255.0::DOUBLE / 12.92 ELSE pow((({v}) / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END)"


def lab(r: Column, g: Column, b: Column, kind: tuple[float, float, float] = COARSE) -> Column:
    """CIE Lab under D65 as a struct (L, a, b)."""
    least, slope, off = kind
    f = lambda t: F.when(t > least, F.cbrt(t)).otherwise(t * slope + off)
    rgb = [linear(c) for c in (r, g, b)]
    x, y, z = (f((rgb[0] * m[0] + rgb[1] * m[1] + rgb[2] * m[2]) / w) for m, w in zip(XYZ, WHITE, strict=True))
    return F.struct((y * 116 - 16).alias("L"), ((x - y) * 500).alias("a"), ((y - z) * 200).alias("b"))


def lab_sql(r: str, g: str, b: str, kind: tuple[float, float, float] = COARSE) -> str:
    least, slope, off = kind
    rgb = [linear_sql(c) for c in (r, g, b)]

    def f(m: tuple, w: float) -> str:
        t = f"(({rgb[0]} * {m[0]} + {rgb[1]} * {m[1]} + {rgb[2]} * {m[2]}) / {w}::DOUBLE)"
        return f"(CASE WHEN {t} > {least!r} THEN cbrt({t}) ELSE {t} * {slope!r} + {off!r} END)"

    x, y, z = (f(m, w) for m, w in zip(XYZ, WHITE, strict=True))
    return f"{{'L': {y} * 116 - 16, 'a': ({x} - {y}) * 500, 'b': ({y} - {z}) * 200}}"


def distance(p: Column, q: Column) -> Column:
    """CIE76: the Euclidean distance of two Lab structs."""
    return F.sqrt(sum(((p[c] - q[c]) * (p[c] - q[c]) for c in ("a", "b")), (p["L"] - q["L"]) * (p["L"] - q["L"])))


def distance_sql(p: str, q: str) -> str:
    return f"sqrt(pow({p}.L - {q}.L, 2) + pow({p}.a - {q}.a, 2) + pow({p}.b - {q}.b, 2))"


def luminance(r: Column, g: Column, b: Column) -> Column:
    """Relative luminance as contrast ratios use it (its own knee)."""
    return linear(r, 0.03928) * 0.2126 + linear(g, 0.03928) * 0.7152 + linear(b, 0.03928) * 0.0722


def luminance_sql(r: str, g: str, b: str) -> str:
    return f"({linear_sql(r, 0.03928)} * 0.2126 + {linear_sql(g, 0.03928)} * 0.7152 + {linear_sql(b, 0.03928)} * 0.0722)"


def contrast(p: Column, q: Column) -> Column:
    """The ratio, 1 to 21, of two luminances."""
    return (F.greatest(p, q) + 0.05) / (F.least(p, q) + 0.05)


def luma(r: Column, g: Column, b: Column) -> Column:
    """Rec. 601 luma, 0 to 255."""
    return r * 0.299 + g * 0.587 + b * 0.114


def to_hex(r: Column, g: Column, b: Column) -> Column:
    return F.concat(F.lit("#"), *(F.lpad(F.lower(F.hex(byte(c))), 2, "0") for c in (r, g, b)))


def hex_sql(r: str, g: str, b: str) -> str:
    return f"printf('#%02x%02x%02x', {r}, {g}, {b})"


def seen_as(r: Column, g: Column, b: Column, kind: str) -> list[Column]:
    """The bytes of a colour as a dichromat of the kind sees it."""
    rgb = [linear(c) for c in (r, g, b)]

    def one(m: tuple) -> Column:
        c = F.least(F.lit(1.0), F.greatest(F.lit(0.0), rgb[0] * m[0] + rgb[1] * m[1] + rgb[2] * m[2]))
        return F.floor(F.when(c <= 0.0031308, c * 12.92).otherwise(F.pow(c, 1 / 2.4) * 1.055 - 0.055) * 255 + 0.5).cast("long")

    return [one(m) for m in VISION[kind]]


def ciede2000(p: Column, q: Column) -> Column:
    """CIEDE2000 of two Lab structs, from the published formula with its hue wrap and zero-chroma rules."""
    deg = lambda x: F.radians(x)
    c1, c2 = (F.hypot(v["a"], v["b"]) for v in (p, q))
    seventh = lambda c: F.sqrt(F.pow(c, 7.0) / (F.pow(c, 7.0) + 25.0**7))
    k = (F.lit(1.0) - seventh((c1 + c2) / 2)) * 0.5 + 1
    a1, a2 = p["a"] * k, q["a"] * k
    m1, m2 = F.hypot(a1, p["b"]), F.hypot(a2, q["b"])

    def hue(b: Column, a: Column) -> Column:
        h = F.degrees(F.atan2(b, a))
        return F.when((a == 0) & (b == 0), 0.0).when(h >= 0, h).otherwise(h + 360)

    h1, h2 = hue(p["b"], a1), hue(q["b"], a2)
    grey = m1 * m2 == 0
    turn = h2 - h1
    dh = F.when(grey, 0.0).when(turn > 180, turn - 360).when(turn < -180, turn + 360).otherwise(turn)
    big = F.sqrt(m1 * m2) * 2 * F.sin(deg(dh) / 2)
    light, chroma, total = (p["L"] + q["L"]) / 2, (m1 + m2) / 2, h1 + h2
    mean = F.when(grey, total).when(F.abs(turn) <= 180, total / 2).when(total < 360, (total + 360) / 2).otherwise((total - 360) / 2)
    t = 1 - F.cos(deg(mean - 30)) * 0.17 + F.cos(deg(mean * 2)) * 0.24 + F.cos(deg(mean * 3 + 6)) * 0.32 - F.cos(deg(mean * 4 - 63)) * 0.2
    off = light - 50
    sl = off * off * 0.015 / F.sqrt(off * off + 20) + 1
    sc, sh = chroma * 0.045 + 1, chroma * t * 0.015 + 1
    twist = F.exp(-F.pow((mean - 275) / 25, 2.0)) * 30
    rt = -F.sin(deg(twist * 2)) * seventh(chroma) * 2
    x, y, z = (q["L"] - p["L"]) / sl, (m2 - m1) / sc, big / sh
    return F.sqrt(x * x + y * y + z * z + rt * y * z)
