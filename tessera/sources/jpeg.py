"""Baseline JPEG: decoding (grey, 4:4:4, 4:2:2, 4:2:0, restart intervals, RGB by Adobe's mark) and 4:4:4 encoding."""

from __future__ import annotations

import numpy as np

# The zigzag order is a rule; the example tables are those of the standard's Annex K.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8) if (i // 8 + i % 8) % 2 else i % 8)))
LUMA = (16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62, 18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99)
CHROMA = (17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99)
_C = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(1 / 8) if u == 0 else 0.5) for x in range(8)] for u in range(8)])


def dct(block: np.ndarray) -> np.ndarray:
    return _C @ block @ _C.T


def idct(block: np.ndarray) -> np.ndarray:
    return _C.T @ block @ _C


class _Codes:
    """Huffman codes from the numbers of codes by length and the values in order."""

    def __init__(self, counts, values):
        self.read, self.write, code, k = {}, {}, 0, 0
        for n, c in enumerate(counts, 1):
            for _ in range(c):
                self.read[n, code] = values[k]
                self.write[values[k]] = (code, n)
                code, k = code + 1, k + 1
            code <<= 1


class _Bits:
    """The bits of a scan's segment, stuffing taken out."""

    def __init__(self, data: bytes):
        self.v, self.n, self.at = int.from_bytes(data := data.replace(b"\xff\0", b"\xff"), "big"), 8 * len(data), 0

    def get(self, n: int) -> int:
        if self.at + n > self.n:
            raise ValueError("the JPEG ends early")
        self.at += n
        return self.v >> (self.n - self.at) & ((1 << n) - 1)

    def symbol(self, codes: _Codes) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.get(1)
            if (s := codes.read.get((n, code))) is not None:
                return s
        raise ValueError("no such JPEG code")

    def signed(self, n: int) -> int:
        v = self.get(n) if n else 0
        return v - (1 << n) + 1 if n and v < 1 << (n - 1) else v


def size(data: bytes) -> tuple[int, int]:
    for kind, body, _ in _segments(data):
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(body[3:5], "big"), int.from_bytes(body[1:3], "big")
    raise ValueError("a JPEG without a frame")


def _segments(data: bytes):
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("a JPEG that is out of step")
        kind = data[at + 1]
        if kind == 0xFF:
            at += 1
            continue
        if kind == 0xD9:
            return
        n = int.from_bytes(data[at + 2 : at + 4], "big")
        yield kind, data[at + 4 : at + 2 + n], at + 2 + n
        if kind == 0xDA:
            return
        at += 2 + n


def _doubled(p: np.ndarray, axis: int) -> np.ndarray:
    """Twice the samples along an axis, three parts of the nearer and one of the farther neighbour."""
    p = np.moveaxis(p, axis, 0)
    before, after = np.concatenate([p[:1], p[:-1]]), np.concatenate([p[1:], p[-1:]])
    out = np.empty((2 * len(p), *p.shape[1:]))
    out[0::2], out[1::2] = (3 * p + before) / 4, (3 * p + after) / 4
    return np.moveaxis(out, 0, axis)


def decode(data: bytes) -> np.ndarray:
    """(height, width, 4) RGBA samples. Progressive, arithmetic and four-channel files are refused."""
    quant, codes, parts, interval, adobe, scan = {}, {}, [], 0, None, None
    w = h = 0
    for kind, body, end in _segments(data):
        if kind == 0xDB:
            at = 0
            while at < len(body):
                wide = body[at] >> 4
                n = 128 if wide else 64
                quant[body[at] & 15] = np.frombuffer(body[at + 1 : at + 1 + n], ">u2" if wide else np.uint8).astype(float)
                at += 1 + n
        elif kind == 0xC4:
            at = 0
            while at < len(body):
                counts = list(body[at + 1 : at + 17])
                n = sum(counts)
                codes[body[at]] = _Codes(counts, list(body[at + 17 : at + 17 + n]))
                at += 17 + n
        elif kind in (0xC0, 0xC1):
            h, w = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            parts = [{"id": body[6 + 3 * i], "h": body[7 + 3 * i] >> 4, "v": body[7 + 3 * i] & 15, "q": body[8 + 3 * i]} for i in range(body[5])]
            if body[0] != 8 or len(parts) not in (1, 3):
                raise ValueError("a kind of JPEG that isn't decoded")
        elif 0xC2 <= kind <= 0xCF and kind != 0xC8:
            raise ValueError("a progressive or arithmetic JPEG")
        elif kind == 0xDD:
            interval = int.from_bytes(body[:2], "big")
        elif kind == 0xEE and body[:5] == b"Adobe":
            adobe = body[11]
        elif kind == 0xDA:
            scan = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}, end
    if not parts or scan is None or not w or not h:
        raise ValueError("a JPEG without a picture")
    tables, at = scan
    if set(tables) != {p["id"] for p in parts}:
        raise ValueError("a JPEG of several scans")
    segments, start, i = [], at, at
    while True:  # the scan ends at the first mark that is neither stuffing nor a restart
        i = data.find(b"\xff", i)
        if i < 0 or i + 1 >= len(data):
            segments.append(data[start:])
            break
        if data[i + 1] == 0:
            i += 2
        elif 0xD0 <= data[i + 1] <= 0xD7:
            segments.append(data[start:i])
            start = i = i + 2
        else:
            segments.append(data[start:i])
            break
    hm, vm = max(p["h"] for p in parts), max(p["v"] for p in parts)
    if len(parts) == 1:
        hm = vm = parts[0]["h"] = parts[0]["v"] = 1
    wide, tall = -(-w // (8 * hm)), -(-h // (8 * vm))
    for p in parts:
        p["plane"], p["last"] = np.zeros((tall * p["v"] * 8, wide * p["h"] * 8)), 0
        p["dc"], p["ac"] = codes[tables[p["id"]] >> 4], codes[0x10 | tables[p["id"]] & 15]
    bits, used = _Bits(segments[0]), 0
    for m in range(wide * tall):
        if interval and m and m % interval == 0:
            used += 1
            bits = _Bits(segments[used])
            for p in parts:
                p["last"] = 0
        for p in parts:
            for v in range(p["v"]):
                for u in range(p["h"]):
                    block = np.zeros(64)
                    p["last"] += bits.signed(bits.symbol(p["dc"]))
                    block[0], k = p["last"], 1
                    while k < 64:
                        s = bits.symbol(p["ac"])
                        if s == 0:
                            break
                        k += s >> 4
                        if s & 15:
                            if k > 63:
                                raise ValueError("a JPEG block that is too long")
                            block[ZIGZAG[k]] = bits.signed(s & 15)
                        k += 1
                    steps = np.empty(64)
                    steps[ZIGZAG] = quant[p["q"]]
                    y, x = (m // wide * p["v"] + v) * 8, (m % wide * p["h"] + u) * 8
                    p["plane"][y : y + 8, x : x + 8] = idct((block * steps).reshape(8, 8)) + 128
    planes = []
    for p in parts:
        q = np.clip(np.floor(p["plane"] + 0.5), 0, 255)[: -(-h * p["v"] // vm), : -(-w * p["h"] // hm)]
        for axis, f in ((0, vm // p["v"]), (1, hm // p["h"])):
            q = _doubled(q, axis) if f == 2 else np.repeat(q, f, axis)
        planes.append(q[:h, :w])
    out = np.full((h, w, 4), 255, np.uint8)
    if len(planes) == 1:
        rgb = planes * 3
    elif adobe == 0:
        rgb = planes
    else:
        y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
        rgb = [y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb]
    for i, c in enumerate(rgb):
        out[..., i] = np.clip(np.floor(c + 0.5), 0, 255)
    return out


def _optimal(symbols: list[int]) -> tuple[list[int], list[int]]:
    """Codes of at most 16 bits for the symbols by how often they come: (numbers by length, values in order)."""
    times: dict[int, int] = {}
    for s in symbols:
        times[s] = times.get(s, 0) + 1
    # Lengths by rank: a code that is never all ones, of lengths up to 16, by halving the space left.
    order = sorted(times, key=lambda s: (-times[s], s))
    n = max(1, len(order).bit_length())
    short = min(len(order), 2) if len(order) > 4 else 0
    counts = [0] * 16
    rest = len(order) - short
    if short:
        counts[1] = short  # two codes of 2 bits; the other half of the space for the rest
        counts[1 + max(1, (rest + 1 - 1).bit_length())] = rest
    else:
        counts[n - 1] = rest
    return counts, order


def encode(rgba: np.ndarray, quality: int = 90) -> bytes:
    """A 4:4:4 baseline JPEG; alpha is ignored and edge samples fill the last blocks."""
    h, w = rgba.shape[:2]
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    quant = [np.clip((np.array(t) * scale + 50) // 100, 1, 255) for t in (LUMA, CHROMA)]
    r, g, b = (rgba[..., i].astype(float) for i in range(3))
    planes = [0.299 * r + 0.587 * g + 0.114 * b, 128 - 0.168736 * r - 0.331264 * g + 0.5 * b, 128 + 0.5 * r - 0.418688 * g - 0.081312 * b]
    planes = [np.pad(p, ((0, -h % 8), (0, -w % 8)), mode="edge") - 128 for p in planes]
    coded, last = [], [0, 0, 0]
    size_of = lambda v: int(abs(v)).bit_length()
    for y in range(0, planes[0].shape[0], 8):
        for x in range(0, planes[0].shape[1], 8):
            for c, p in enumerate(planes):
                k = 1 if c else 0
                z = np.rint(dct(p[y : y + 8, x : x + 8]).ravel() / quant[k]).astype(int)[ZIGZAG]
                z[1:] = np.clip(z[1:], -1023, 1023)
                diff, last[c] = int(z[0]) - last[c], int(z[0])
                coded.append((k, size_of(diff), diff))
                run = 0
                for v in z[1 : 1 + int(np.flatnonzero(z[1:])[-1]) + 1] if z[1:].any() else ():
                    if not v:
                        run += 1
                        continue
                    while run > 15:
                        coded.append((2 + k, 0xF0, None))
                        run -= 16
                    coded.append((2 + k, run << 4 | size_of(v), int(v)))
                    run = 0
                if not z[63]:
                    coded.append((2 + k, 0, None))
    tables = [_optimal([s for t, s, _ in coded if t == i] or [0]) for i in range(4)]
    codes = [_Codes(*t) for t in tables]
    bits = []
    for t, s, v in coded:
        code, n = codes[t].write[s]
        bits.append(f"{code:0{n}b}")
        if v is not None and (n := s & 15):
            bits.append(f"{v if v > 0 else v + (1 << n) - 1:0{n}b}")
    stream = "".join(bits)
    stream += "1" * (-len(stream) % 8)
    body = int(stream, 2).to_bytes(len(stream) // 8, "big").replace(b"\xff", b"\xff\0")
    seg = lambda kind, b: bytes((0xFF, kind)) + (len(b) + 2).to_bytes(2, "big") + b
    out = [b"\xff\xd8", seg(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")]
    out += [seg(0xDB, bytes([i]) + bytes(int(v) for v in q[ZIGZAG])) for i, q in enumerate(quant)]
    out.append(seg(0xC0, b"\x08" + h.to_bytes(2, "big") + w.to_bytes(2, "big") + bytes((3, 1, 0x11, 0, 2, 0x11, 1, 3, 0x11, 1))))
    out += [seg(0xC4, bytes([i]) + bytes(t[0]) + bytes(t[1])) for i, t in zip((0, 1, 0x10, 0x11), tables, strict=True)]
    return b"".join([*out, seg(0xDA, bytes((3, 1, 0, 2, 0x11, 3, 0x11, 0, 63, 0))), body, b"\xff\xd9"])


def encode_for_cap(rgba: np.ndarray, cap: int, qualities=(92, 85, 78, 70)) -> tuple[bytes, int]:
    """The first quality whose file fits the cap, else the last tried."""
    for q in qualities:
        out = encode(rgba, q)
        if len(out) <= cap:
            break
    return out, q
