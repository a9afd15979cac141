"""Lossless WebP (VP8L): a decoder of the whole format and an encoder with prefix codes, back-references and palettes.

The decoder reads canonical prefix codes, meta prefix images, back-references and the colour cache, then inverts the
predictor, cross-colour, subtract-green and palette transforms. Streams of one group of codes without a colour cache are
read by tables: what a pixel's codes at every bit position would be is looked up for a stretch of the stream at once,
and the pixels are those positions that follow from one another. Any other stream is read symbol by symbol.

The encoder is made for text in pixels. Its codes come from a prior of bytes, so they need no pass of their own, and its
back-references from the last place where four pixels stood before; a picture of few colours has a palette. Of these and
plain bytes of 8 bits the smallest is taken. Predictors and colour transforms make text larger and are never written.
"""

from __future__ import annotations

import heapq
from functools import cache

import numpy as np

MOST_SIDE = 1 << 14

# Fixed values of the format: the order of code-length codes and the neighbours of the first 120 distance codes.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3),
    (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4),
    (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2),
    (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7),
    (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)

#: The bits of each byte in reverse, since a code's first bit is its highest and a stream's first bit is a byte's lowest.
REVERSED = np.array([int(f"{b:08b}"[::-1], 2) for b in range(256)], np.uint8)


class Bits:
    """Writes or reads numbers, lowest bit first."""

    def __init__(self, data: bytes = b""):
        self.data, self.at, self.value = data, 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.at
        self.at += n

    def get(self, n: int) -> int:
        i = self.at >> 3
        if self.at + n > 8 * len(self.data):
            raise ValueError("the stream ends early")
        v = int.from_bytes(self.data[i : i + 5], "little") >> (self.at & 7)
        self.at += n
        return v & ((1 << n) - 1)


#: The bits of a window that a table is looked up by, and the bytes of the stretch that is looked up at once.
LOOK, STRETCH = 12, 1 << 15


def _reversed(code: int, n: int) -> int:
    return int(f"{code:0{n}b}"[::-1], 2) if n else 0


class Code:
    """A canonical prefix code: `flat` is the common length where all of 256 literals, and nothing else, have 8 bits."""

    def __init__(self, lengths: list[int] | None = None, only: int | None = None):
        self.only, self.flat, self.of, self.table = only, False, {}, None
        if only is not None or lengths is None:
            return
        used = [(n, s) for s, n in enumerate(lengths) if n]
        if not used:
            raise ValueError("a prefix code without symbols")
        if len(used) == 1:
            self.only = used[0][1]
            return
        self.flat = len(used) == 256 and used[-1] == (8, 255) and all(n == 8 for n, _ in used)
        if sum(1 << (15 - n) for n, _ in used) != 1 << 15:
            raise ValueError("a prefix code that is not complete")
        code = last = 0
        for n, s in sorted(used):
            code <<= n - last
            self.of[n, code] = s
            code, last = code + 1, n

    @classmethod
    def flat_bytes(cls) -> Code:
        out = cls()
        out.flat = True
        out.of = {(8, s): s for s in range(256)}
        return out

    def lookup(self) -> np.ndarray | None:
        """symbol * 16 + length for every window of LOOK bits, or None if a code is longer."""
        if self.table is None:
            t = np.zeros(1 << LOOK, np.int32)
            if self.only is not None:
                t[:] = self.only << 4
            elif max(n for n, _ in self.of) > LOOK:
                return None
            else:
                for (n, code), symbol in self.of.items():
                    t[_reversed(code, n) :: 1 << n] = symbol << 4 | n
            self.table = t
        return self.table

    def read(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        code = 0
        for n in range(1, 16):
            code = code << 1 | bits.get(1)
            if (s := self.of.get((n, code))) is not None:
                return s
        raise ValueError("no such prefix code")


_FLAT = Code.flat_bytes()


def _read_code(bits: Bits, size: int) -> Code:
    if bits.get(1):
        two = bits.get(1)
        symbols = [bits.get(8 if bits.get(1) else 1)]
        if not two:
            return Code(only=symbols[0])
        symbols.append(bits.get(8))
        return Code([1 if s in symbols else 0 for s in range(size)])
    first = [0] * 19
    for k in LENGTH_ORDER[: 4 + bits.get(4)]:
        first[k] = bits.get(3)
    most = 2 + bits.get(2 + 2 * bits.get(3)) if bits.get(1) else size
    if most > size:
        raise ValueError("more code lengths than symbols")
    used = [s for s, n in enumerate(first) if n]
    if used == [8] and most == 256:  # nothing is read for the only symbol
        return _FLAT
    code = Code(first)
    lengths, last = [], 8
    while len(lengths) < size and most:
        most -= 1
        s = code.read(bits)
        if s < 16:
            lengths.append(s)
            last = s or last
        elif s == 16:
            lengths += [last] * (3 + bits.get(2))
        else:
            lengths += [0] * (3 + bits.get(3) if s == 17 else 11 + bits.get(7))
    if len(lengths) > size:
        raise ValueError("a repeat beyond the alphabet")
    return Code(lengths)


def _reach(bits: Bits, symbol: int) -> int:
    """The number that a length or distance symbol and its extra bits stand for."""
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.get(extra) + 1


def _read_pixels(bits: Bits, w: int, h: int, top: bool) -> np.ndarray:
    """An entropy-coded image: (h, w) ARGB as uint32."""
    cache_bits = bits.get(4) if bits.get(1) else 0
    if cache_bits > 11:
        raise ValueError("a colour cache that is too large")
    groups, tile, meta = 1, 0, None
    if top and bits.get(1):
        tile = bits.get(3) + 2
        meta = (_read_pixels(bits, -(-w // (1 << tile)), -(-h // (1 << tile)), False) >> 8) & 0xFFFF
        groups = int(meta.max()) + 1
    cache_size = 1 << cache_bits if cache_bits else 0
    codes = [_read_codes(bits, cache_size) for _ in range(groups)]
    if groups == 1 and not cache_bits and all(c.flat for c in codes[0][:4]):
        return _read_flat(bits, w * h).reshape(h, w)
    if groups == 1 and not cache_bits and all(c.lookup() is not None for c in codes[0][:4]):
        return _read_stretches(bits, w, h, codes[0])
    out, n, total = [0] * (w * h), 0, w * h
    cache = [0] * cache_size
    shift = 32 - cache_bits

    def seen(p: int) -> None:
        if cache_size:
            cache[(0x1E35A7BD * p & 0xFFFFFFFF) >> shift] = p

    while n < total:
        g, r, b, a, d = codes[int(meta[n // w >> tile, n % w >> tile]) if meta is not None else 0]
        s = g.read(bits)
        if s < 256:
            red, blue = r.read(bits), b.read(bits)
            out[n] = a.read(bits) << 24 | red << 16 | s << 8 | blue
            seen(out[n])
            n += 1
        elif s < 280:
            length = _reach(bits, s - 256)
            dist = _distance(_reach(bits, d.read(bits)), w)
            if dist > n or n + length > total:
                raise ValueError("a back-reference outside the image")
            for _ in range(length):
                out[n] = out[n - dist]
                seen(out[n])
                n += 1
        else:
            out[n] = cache[s - 280]
            seen(out[n])
            n += 1
    return np.array(out, np.uint32).reshape(h, w)


#: The last groups of codes read, which most pictures of a column share: (bits that declare them, how many, codes).
_SEEN: list[tuple[int, int, list]] = []


def _read_codes(bits: Bits, cache_size: int) -> list[Code]:
    """The five codes of a group; declarations that were read before are recognised by their bits."""
    was = bits.at

    def span(n: int) -> int:
        piece = bits.data[was >> 3 : (was + n + 7) >> 3]
        return (int.from_bytes(piece, "little") >> (was & 7)) & ((1 << n) - 1)

    if not cache_size:
        for declared, n, codes in _SEEN:
            if was + n <= 8 * len(bits.data) and span(n) == declared:
                bits.at += n
                return codes
    codes = [_read_code(bits, n) for n in (280 + cache_size, 256, 256, 256, 40)]
    if not cache_size:
        if len(_SEEN) >= 8:
            _SEEN.pop(0)
        _SEEN.append((span(bits.at - was), bits.at - was, codes))
    return codes


def _copy(out: np.ndarray, n: int, dist: int, length: int) -> None:
    if dist > n or n + length > len(out):
        raise ValueError("a back-reference outside the image")
    out[n : n + length] = out[n - dist : n - dist + length] if dist >= length else np.resize(out[n - dist : n], length)


def _distance(code: int, w: int) -> int:
    if code > 120:
        return code - 120
    x, y = NEAR[code - 1]
    return max(1, x + y * w)


def _read_stretches(bits: Bits, w: int, h: int, codes: list[Code]) -> np.ndarray:
    """(h, w) ARGB of literals and back-references, a stretch of the stream at a time."""
    green, red, blue, alpha = (c.lookup() for c in codes[:4])
    total, n = w * h, 0
    out = np.empty(total, np.uint32)
    data = np.frombuffer(bits.data, np.uint8)
    size = 8 * len(data)
    shifts = np.arange(8, dtype=np.uint32)
    while n < total:
        first = bits.at >> 3
        b = np.zeros(min(STRETCH, len(data) - first) + 16, np.uint32)
        piece = data[first : first + len(b)]
        b[: len(piece)] = piece
        wide = b[:-2] | b[1:-1] << 8 | b[2:] << 16
        win = ((wide[:, None] >> shifts) & ((1 << LOOK) - 1)).ravel()
        end = 8 * (len(b) - 14)  # a pixel that begins before this is whole within the windows
        g, r_ = green[win], red[win]
        same = red is blue and red is alpha
        b_, a_ = (r_, r_) if same else (blue[win], alpha[win])
        at = np.arange(end)
        p1 = at + (g[:end] & 15)
        p2 = p1 + (r_[p1] & 15)
        p3 = p2 + (b_[p2] & 15)
        step = p3 + (a_[p3] & 15)
        step[g[:end] >= 256 << 4] = -1
        view, base = memoryview(step), 8 * first
        p, left = bits.at - base, size - base
        while n < total and p < min(end, left):
            taken = []
            add, room = taken.append, total - n
            while p < end and (q := view[p]) >= 0:
                add(p)
                p = q
                if len(taken) == room:
                    break
            if taken:
                t = np.array(taken)
                if p > left:
                    raise ValueError("the stream ends early")
                i1, i2, i3 = p1[t], p2[t], p3[t]
                out[n : n + len(t)] = ((a_[i3] >> 4).astype(np.uint32) << 24) | ((r_[i1] >> 4) << 16).astype(np.uint32) | ((g[t] >> 4) << 8).astype(np.uint32) | (b_[i2] >> 4).astype(np.uint32)
                n += len(t)
            if n < total and p < end and view[p] < 0:
                bits.at = base + p
                symbol = codes[0].read(bits)
                if symbol >= 280:
                    raise ValueError("a colour cache that is not there")
                length = _reach(bits, symbol - 256)
                _copy(out, n, _distance(_reach(bits, codes[4].read(bits)), w), length)
                n, p = n + length, bits.at - base
        bits.at = base + p
        if n < total and bits.at >= size:
            raise ValueError("the stream ends early")
    return out.reshape(h, w)


def _read_flat(bits: Bits, pixels: int) -> np.ndarray:
    """Literals of 8-bit codes: a shift of the whole stream, then the reversed bits are the samples G, R, B, A."""
    i, s = bits.at >> 3, bits.at & 7
    raw = np.frombuffer(bits.data, np.uint8, count=min(4 * pixels + 1, len(bits.data) - i), offset=i)
    if 8 * len(raw) < 32 * pixels + s:
        raise ValueError("the stream ends early")
    raw = raw if len(raw) > 4 * pixels else np.append(raw, np.uint8(0))
    samples = REVERSED[(raw[:-1] >> s) | ((raw[1:] << (8 - s)) if s else 0)]
    bits.at += 32 * pixels
    g, r, b, a = samples.reshape(-1, 4).T.astype(np.uint32)
    return a << 24 | r << 16 | g << 8 | b


def _bytes(p: np.ndarray) -> np.ndarray:
    """ARGB words as (..., 4) int16 channels A, R, G, B."""
    return np.stack([(p >> s).astype(np.int16) & 255 for s in (24, 16, 8, 0)], axis=-1)


def _words(c: np.ndarray) -> np.ndarray:
    c = (c & 255).astype(np.uint32)
    return c[..., 0] << 24 | c[..., 1] << 16 | c[..., 2] << 8 | c[..., 3]


def _half(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a + b) >> 1


def _predict(mode: int, left: np.ndarray, up: np.ndarray, up_left: np.ndarray, up_right: np.ndarray) -> np.ndarray:
    """The predicted channels of one pixel for modes 0 to 13."""
    if mode == 0 or mode > 13:
        return np.array([255, 0, 0, 0], np.int16)
    if mode <= 4:
        return (left, up, up_right, up_left)[mode - 1]
    if mode == 5:
        return _half(_half(left, up_right), up)
    if mode <= 10:
        a, b = ((left, up_left), (left, up), (up_left, up), (up, up_right))[mode - 6] if mode < 10 else (_half(left, up_left), _half(up, up_right))
        return _half(a, b)
    if mode == 11:
        to_left, to_up = np.abs(up - up_left).sum(), np.abs(left - up_left).sum()
        return left if to_left < to_up else up
    if mode == 12:
        return np.clip(left + up - up_left, 0, 255)
    mean = _half(left, up)
    diff = mean - up_left
    return np.clip(mean + (diff + (diff < 0)) // 2, 0, 255)  # halves towards zero


def _undo_predictor(p: np.ndarray, modes: np.ndarray, tile: int) -> np.ndarray:
    c = _bytes(p)
    h, w = p.shape
    c[0, 0] += np.array([255, 0, 0, 0], np.int16)
    c[0] = np.cumsum(c[0], axis=0) & 255
    for y in range(1, h):
        c[y, 0] = (c[y, 0] + c[y - 1, 0]) & 255
        row = (modes[y >> tile] >> 8) & 15
        x = 1
        while x < w:
            mode = int(row[x >> tile])
            end = min(w, ((x >> tile) + 1) << tile)
            if mode == 1:
                c[y, x:end] = (np.cumsum(c[y, x:end].astype(np.int64), axis=0) + c[y, x - 1]) & 255
            elif mode in (0, 2, 4, 8):  # what they look at is whole already
                up, up_left = c[y - 1, x:end], c[y - 1, x - 1 : end - 1]
                guess = {0: np.array([255, 0, 0, 0], np.int16), 2: up, 4: up_left, 8: _half(up_left, up)}[mode]
                c[y, x:end] = (c[y, x:end] + guess) & 255
            else:
                for i in range(x, end):
                    right = c[y - 1, i + 1] if i + 1 < w else c[y, 0]
                    c[y, i] = (c[y, i] + _predict(mode, c[y, i - 1], c[y - 1, i], c[y - 1, i - 1], right)) & 255
            x = end
    return _words(c)


def _undo_cross(p: np.ndarray, elements: np.ndarray, tile: int) -> np.ndarray:
    h, w = p.shape
    e = elements[np.arange(h)[:, None] >> tile, np.arange(w)[None, :] >> tile]
    signed = lambda v: (v & 255).astype(np.uint8).view(np.int8).astype(np.int32)
    red_blue, green_blue, green_red = signed(e >> 16), signed(e >> 8), signed(e)
    green = signed(p >> 8)
    red = (((p >> 16) & 255).astype(np.int32) + (green_red * green >> 5)) & 255
    blue = ((p & 255).astype(np.int32) + (green_blue * green >> 5) + (red_blue * signed(red) >> 5)) & 255
    return p & np.uint32(0xFF00FF00) | red.astype(np.uint32) << 16 | blue.astype(np.uint32)


def _undo_green(p: np.ndarray) -> np.ndarray:
    g = (p >> 8) & 255
    return p & np.uint32(0xFF00FF00) | ((p & 0xFF00FF) + (g << 16 | g)) & np.uint32(0xFF00FF)


def _undo_palette(p: np.ndarray, table: np.ndarray, fold: int, w: int) -> np.ndarray:
    index = (p >> 8) & 255
    if fold:
        bits = 8 >> fold
        x = np.arange(w)
        index = (index[:, x >> fold] >> ((x & ((1 << fold) - 1)) * bits)) & ((1 << bits) - 1)
    return np.append(table, np.zeros(256, np.uint32))[index]


def decode_vp8l(data: bytes) -> np.ndarray:
    """(height, width, 4) RGBA samples of a VP8L chunk."""
    if data[:1] != b"\x2f":
        raise ValueError("not a lossless WebP stream")
    bits = Bits(data)
    bits.at = 8
    w, h = bits.get(14) + 1, bits.get(14) + 1
    bits.get(1)
    if bits.get(3):
        raise ValueError("an unknown version")
    undo, wide, done = [], w, set()
    while bits.get(1):
        kind = bits.get(2)
        if kind in done:
            raise ValueError("a transform twice")
        done.add(kind)
        if kind < 2:
            tile = bits.get(3) + 2
            data_of = _read_pixels(bits, -(-wide // (1 << tile)), -(-h // (1 << tile)), False)
            undo.append((_undo_predictor if kind == 0 else _undo_cross, (data_of, tile)))
        elif kind == 2:
            undo.append((_undo_green, ()))
        else:
            n = bits.get(8) + 1
            table = _words(np.cumsum(_bytes(_read_pixels(bits, n, 1, False)[0]).astype(np.int64), axis=0))
            fold = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append((_undo_palette, (table, fold, wide)))
            wide = -(-wide // (1 << fold))
    p = _read_pixels(bits, wide, h, True)
    for f, args in reversed(undo):
        p = f(p, *args)
    out = np.empty((h, w, 4), np.uint8)
    for i, s in enumerate((16, 8, 0, 24)):
        out[..., i] = (p >> s) & 255
    return out


def riff(chunk: bytes) -> bytes:
    body = b"WEBPVP8L" + len(chunk).to_bytes(4, "little") + chunk + b"\0" * (len(chunk) & 1)
    return b"RIFF" + len(body).to_bytes(4, "little") + body


def decode(data: bytes) -> np.ndarray:
    """RGBA samples of a WebP file with a VP8L chunk."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at = 12
    while at + 8 <= len(data):
        n = int.from_bytes(data[at + 4 : at + 8], "little")
        if data[at : at + 4] == b"VP8L":
            return decode_vp8l(data[at + 8 : at + 8 + n])
        at += 8 + n + (n & 1)
    raise ValueError("no lossless image in this file")


def _plain_header() -> Bits:
    """After the size: subtract green, no cache, no meta image, four 8-bit literal codes and an empty distance code."""
    b = Bits()
    b.put(1, 1)
    b.put(2, 2)
    b.put(0, 1)
    b.put(0, 1)
    b.put(0, 1)
    for size in (280, 256, 256, 256):
        b.put(0, 1)
        n = LENGTH_ORDER.index(8) + 1
        b.put(n - 4, 4)
        for k in LENGTH_ORDER[:n]:
            b.put(int(k == 8), 3)
        b.put(int(size > 256), 1)
        if size > 256:
            b.put(3, 3)
            b.put(254, 8)
    b.put(1, 1)
    b.put(0, 3)
    return b


_PLAIN = _plain_header()


# The encoder's codes. Letters in the order of their frequency in English prose, a fixed value.
FREQUENT = b"etaoinshrdlcumwfgypbvkjxqz"


def byte_prior() -> np.ndarray:
    """A share for each byte: text first of all, continuation and leading bytes of UTF-8 next, anything else least."""
    p = np.full(256, 2.0**-11)
    p[[*b"0123456789"]] = 0.006
    p[[*b".,-'\"!?:;()"]] = 0.006
    p[ord(" ")], p[ord("\n")] = 0.17, 0.008
    for i, c in enumerate(FREQUENT):
        p[c] = 0.1 * 0.88**i
        p[c - 32] = 0.014 * 0.9**i
    p[0x80:0xC0] = 0.0008
    p[0xC3:0xC6] = 0.004
    p[0xFF] = 0.002  # the padding
    return p / p.sum()


def code_lengths(shares: np.ndarray) -> list[int]:
    """Lengths of a complete prefix code by Huffman's rule."""
    heap = [(float(v), i, (i,)) for i, v in enumerate(shares)]
    lengths = [0] * len(heap)
    heapq.heapify(heap)
    while len(heap) > 1:
        (v, _, a), (u, i, b) = heapq.heappop(heap), heapq.heappop(heap)
        for x in a + b:
            lengths[x] += 1
        heapq.heappush(heap, (v + u, i, a + b))
    return lengths


def codewords(lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The canonical codes, first bit lowest, and their lengths."""
    words, code, last = np.zeros(len(lengths), np.uint64), 0, 0
    for n, x in sorted((n, x) for x, n in enumerate(lengths) if n):
        code <<= n - last
        words[x] = _reversed(code, n)
        code, last = code + 1, n
    return words, np.array(lengths, np.int64)


def declare(b: Bits, lengths: list[int]) -> None:
    """A code's lengths, runs shortened, under a prefix code of their own."""
    runs, i = [], 0
    while i < len(lengths):
        j = i
        while j < len(lengths) and lengths[j] == lengths[i]:
            j += 1
        n, v = j - i, lengths[i]
        if v:
            runs.append((v, 0, 0))
            n -= 1
        while n >= 3:
            k = min(n, 138 if not v else 6)
            runs.append((16, k - 3, 2) if v else (17, k - 3, 3) if k <= 10 else (18, k - 11, 7))
            n -= k
        runs += [(v, 0, 0)] * n
        i = j
    shares = np.bincount([x for x, _, _ in runs], minlength=19)
    used = [x for x in range(19) if shares[x]]
    if len(used) == 1:
        used.append(next(x for x in range(19) if x not in used))
    own = [0] * 19
    for x, n in zip(used, code_lengths(np.array([shares[x] + 0.5 for x in used])), strict=True):
        own[x] = min(n, 7)
    while (room := sum(1 << (7 - n) for n in own if n) - 128) > 0:  # codes cut to 7 bits make room by longer ones
        x = max((x for x in used if own[x] < 7), key=lambda x: own[x])
        own[x] += 1
    while room < 0:
        x = next(x for x in sorted(used, key=lambda x: -own[x]) if 1 << (7 - own[x]) <= -room)
        own[x] -= 1
        room = sum(1 << (7 - n) for n in own if n) - 128
    words, _ = codewords(own)
    last = max(i for i, x in enumerate(LENGTH_ORDER) if own[x]) + 1
    b.put(0, 1)
    b.put(max(4, last) - 4, 4)
    for x in LENGTH_ORDER[: max(4, last)]:
        b.put(own[x], 3)
    b.put(0, 1)
    for x, extra, n in runs:
        b.put(int(words[x]), own[x])
        b.put(extra, n)


@cache
def text_codes() -> tuple:
    """(declaration, its bits, words and lengths of green, of the other channels, of distances): the same for every picture.

    Green has a share of 1/64 for the 24 lengths of back-references.
    """
    prior, b = byte_prior(), Bits()
    green, other, far = code_lengths(np.append(prior * (63 / 64), np.full(24, 1 / 64 / 24))), code_lengths(prior), code_lengths(np.full(40, 1 / 40))
    for n in (green, other, other, other, far):
        declare(b, n)
    return b.value, b.at, codewords(green), codewords(other), codewords(far)


def _prefix(value: int) -> tuple[int, int, int]:
    """Symbol, extra bits and their number of a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    high = v.bit_length() - 1
    half = v >> (high - 1) & 1
    return 2 * high + half, v - ((2 + half) << (high - 1)), high - 1


def copies(p: np.ndarray, least: int = 4, most: int = 4096) -> list[tuple[int, int, int]]:
    """(place, distance, length) of runs that repeat an earlier one of `least` pixels or more, without overlap, in order."""
    n = len(p)
    if n <= least:
        return []
    wide = p.astype(np.uint64)
    key = np.zeros(n - least + 1, np.uint64)
    for k in range(least):
        key = (key ^ wide[k : n - least + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    order = np.argsort(key, kind="stable")
    twin = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    if not len(twin):
        return []
    here, before = order[twin + 1], order[twin]
    by = np.argsort(here)
    out, at = [], 0
    for i, j in zip(here[by].tolist(), before[by].tolist(), strict=True):
        if i < at:
            continue
        span = min(most, n - i)
        off = np.flatnonzero(p[i : i + span] != p[j : j + span])
        length = int(off[0]) if len(off) else span
        if length >= least:  # equal keys of different pixels are no copy
            out.append((i, i - j, length))
            at = i + length
    return out


def _packed(head: Bits, values: np.ndarray, lengths: np.ndarray) -> bytes:
    """The bits of head, then each value in its number of bits."""
    use = lengths > 0
    values, lengths = values[use], lengths[use]
    ends = np.cumsum(lengths) + head.at
    at = ends - lengths
    total = int(ends[-1]) if len(ends) else head.at
    out = np.zeros((total >> 6) + 2, np.uint64)
    first = np.frombuffer(head.value.to_bytes(8 * ((head.at >> 6) + 1), "little"), np.uint64)
    out[: len(first)] = first
    if len(at):
        word, low = at >> 6, (at & 63).astype(np.uint64)
        starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        out[word[starts]] |= np.bitwise_or.reduceat(values << low, starts)
        over = (at & 63) + lengths > 64
        out[word[over] + 1] |= values[over] >> (np.uint64(64) - low[over])
    return out.tobytes()[: (total + 7) // 8]


def _head(w: int, h: int) -> Bits:
    b = Bits()
    for value, n in ((0x2F, 8), (w - 1, 14), (h - 1, 14), (1, 1), (0, 3)):
        b.put(value, n)
    return b


def _coded(p: np.ndarray, w: int, h: int) -> bytes:
    """No transform; the codes of text, and back-references."""
    declared, n_bits, green, other, far = text_codes()
    b = _head(w, h)
    # No transform, no cache, no meta image.
    b.put(0, 3)
    b.put(declared, n_bits)
    channels = ((green, 8), (other, 16), (other, 0), (other, 24))
    values, lengths = np.empty((len(p), 4), np.uint64), np.empty((len(p), 4), np.int64)
    for k, ((words, size), shift) in enumerate(channels):
        x = (p >> shift) & 255
        values[:, k], lengths[:, k] = words[x], size[x]
    for i, dist, length in copies(p):
        lengths[i : i + length] = 0
        a, b_ = _prefix(length), _prefix(dist + 120)
        values[i] = green[0][256 + a[0]], a[1], far[0][b_[0]], b_[1]
        lengths[i] = green[1][256 + a[0]], a[2], far[1][b_[0]], b_[2]
    return _packed(b, values.ravel(), lengths.ravel())


def _few(p: np.ndarray, w: int, h: int, colours: np.ndarray) -> bytes:
    """A palette of up to 16 colours, whose numbers share bytes, as literals of one green code."""
    n = len(colours)
    fold = 3 if n <= 2 else 2 if n <= 4 else 1
    b = _head(w, h)
    b.put(1, 1), b.put(3, 2), b.put(n - 1, 8)
    table = _words(np.diff(_bytes(colours), axis=0, prepend=0))
    _small(b, table, False)
    b.put(0, 1)
    index = np.zeros((h, (-(-w >> fold)) << fold), np.uint32)
    index[:, :w] = np.searchsorted(colours, p).reshape(h, w)
    index = index.reshape(h, -1, 1 << fold)
    whole = (index << (np.arange(1 << fold, dtype=np.uint32) * (8 >> fold))).sum(axis=2, dtype=np.uint32)
    _small(b, (whole << 8 | np.uint32(0xFF000000)).ravel(), True)
    return b.value.to_bytes((b.at + 7) // 8, "little")


def _small(b: Bits, p: np.ndarray, top: bool) -> None:
    """A small image of literals under codes of its own, a channel of one value taking no bits."""
    b.put(0, 1)
    if top:
        b.put(0, 1)
    codes = []
    for shift, size in ((8, 280), (16, 256), (0, 256), (24, 256)):
        x = (p >> shift) & 255
        used = np.unique(x)
        if len(used) == 1:
            b.put(1, 1), b.put(0, 1), b.put(1, 1), b.put(int(used[0]), 8)
            codes.append((x, None, None))
            continue
        lengths = [0] * size
        for v, n in zip(used.tolist(), code_lengths(np.bincount(x, minlength=256)[used] + 0.0), strict=True):
            lengths[v] = min(n, 15)
        declare(b, lengths)
        codes.append((x, *codewords(lengths)))
    b.put(1, 1), b.put(0, 1), b.put(0, 1), b.put(0, 1)
    for i in range(len(p)):
        for x, words, size in codes:
            if words is not None:
                b.put(int(words[x[i]]), int(size[x[i]]))


#: Pictures of up to so many pixels are looked at for a palette.
SMALL = 1 << 11


def encode(rgba: np.ndarray) -> bytes:
    """A WebP file of (height, width, 4) samples: the smallest of a palette, coded text and plain bytes."""
    h, w = rgba.shape[:2]
    c = rgba.reshape(-1, 4).astype(np.uint32)
    p = c[:, 3] << 24 | c[:, 0] << 16 | c[:, 1] << 8 | c[:, 2]
    if len(p) <= SMALL and len(colours := np.unique(p)) <= 16:
        return riff(_few(p, w, h, colours))
    coded = _coded(p, w, h)
    return riff(coded if len(coded) < 4 * len(p) + 64 else _flat(rgba))


def _flat(rgba: np.ndarray) -> bytes:
    """Subtract-green, then literals under 8-bit codes."""
    h, w = rgba.shape[:2]
    b = Bits()
    b.put(0x2F, 8)
    b.put(w - 1, 14)
    b.put(h - 1, 14)
    b.put(1, 1)
    b.put(0, 3)
    b.put(_PLAIN.value, _PLAIN.at)
    p = rgba.reshape(-1, 4)
    s = np.empty_like(p)
    s[:, 0] = p[:, 1]
    s[:, 1] = p[:, 0] - p[:, 1]
    s[:, 2] = p[:, 2] - p[:, 1]
    s[:, 3] = p[:, 3]
    v = REVERSED[s.reshape(-1)]
    k = b.at & 7
    out = np.zeros((b.at >> 3) + len(v) + 1, np.uint8)
    head = np.frombuffer(b.value.to_bytes((b.at >> 3) + 1, "little"), np.uint8)
    out[: len(head)] = head
    body = out[b.at >> 3 :]
    body[:-1] |= v << k
    if k:
        body[1:] |= v >> (8 - k)
    return out.tobytes()
