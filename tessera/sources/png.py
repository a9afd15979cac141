"""PNG reading and writing with zlib and numpy."""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"\x89PNG\r\n\x1a\n"
#: Channels of each colour type.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def chunks(data: bytes):
    """(kind, body) of each chunk; a wrong checksum or a cut file is an error."""
    if data[:8] != MAGIC:
        raise ValueError("not a PNG")
    at = 8
    while at < len(data):
        if at + 12 > len(data):
            raise ValueError("the PNG ends early")
        n = int.from_bytes(data[at : at + 4], "big")
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != int.from_bytes(data[at + 8 + n : at + 12 + n], "big"):
            raise ValueError("a PNG chunk with a wrong checksum")
        yield kind, body
        at += 12 + n
        if kind == b"IEND":
            return


def size(data: bytes) -> tuple[int, int]:
    if data[:8] != MAGIC or len(data) < 24:
        raise ValueError("not a PNG")
    return struct.unpack(">II", data[16:24])


def has_alpha(data: bytes) -> bool:
    """Whether the file has an alpha channel, or transparency before its pixels."""
    kind = 0
    for name, body in chunks(data):
        if name == b"IHDR":
            kind = body[9]
        if name == b"tRNS":
            return True
        if name == b"IDAT":
            break
    return kind in (4, 6)


def _unfilter(raw: np.ndarray, bpp: int) -> np.ndarray:
    """(height, stride) bytes of rows that begin with their filter's number."""
    h, stride = raw.shape[0], raw.shape[1] - 1
    out = np.zeros((h, stride), np.uint8)
    above = np.zeros(stride, np.uint8)
    for y in range(h):
        kind, row = raw[y, 0], raw[y, 1:]
        if kind == 0:
            out[y] = row
        elif kind == 1:
            pad = -stride % bpp
            lanes = np.append(row, np.zeros(pad, np.uint8)).reshape(-1, bpp)
            out[y] = np.cumsum(lanes, axis=0, dtype=np.uint8).reshape(-1)[:stride]
        elif kind == 2:
            out[y] = row + above
        elif kind in (3, 4):
            cur, up = [0] * bpp + row.tolist(), [0] * bpp + above.tolist()
            for i in range(bpp, len(cur)):
                a, b, c = cur[i - bpp], up[i], up[i - bpp]
                if kind == 3:
                    guess = (a + b) >> 1
                else:
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                cur[i] = (cur[i] + guess) & 255
            out[y] = cur[bpp:]
        else:
            raise ValueError(f"an unknown PNG filter {kind}")
        above = out[y]
    return out


def decode(data: bytes) -> np.ndarray:
    """(height, width, 4) RGBA samples. 16-bit samples keep their high byte; interlaced files are refused."""
    head, palette, clear, body = None, None, None, []
    for kind, b in chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", b)
        elif kind == b"PLTE":
            palette = np.frombuffer(b, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = b
        elif kind == b"IDAT":
            body.append(b)
    if head is None:
        raise ValueError("a PNG without a header")
    w, h, depth, colour, _, _, lace = head
    if lace:
        raise ValueError("an interlaced PNG")
    if colour not in CHANNELS or not w or not h:
        raise ValueError("an unknown kind of PNG")
    n = CHANNELS[colour]
    stride = (w * n * depth + 7) // 8
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    if len(raw) < h * (stride + 1):
        raise ValueError("the PNG ends early")
    rows = _unfilter(raw[: h * (stride + 1)].reshape(h, stride + 1), max(1, n * depth // 8))
    full = None
    if depth == 16:
        full = rows.reshape(h, w, n, 2)
        v = full[..., 0]
    elif depth == 8:
        v = rows.reshape(h, w, n)
    else:
        bits = np.unpackbits(rows, axis=1).reshape(h, -1, depth)
        v = (bits * (1 << np.arange(depth - 1, -1, -1))).sum(axis=2).astype(np.uint8)[:, : w * n].reshape(h, w, n)
    out = np.full((h, w, 4), 255, np.uint8)
    if colour == 3:
        if palette is None or int(v.max()) >= len(palette):
            raise ValueError("a PNG whose palette is too short")
        out[..., :3] = palette[v[..., 0]]
        if clear is not None:
            alpha = np.full(256, 255, np.uint8)
            alpha[: len(clear)] = np.frombuffer(clear, np.uint8)
            out[..., 3] = alpha[v[..., 0]]
        return out
    scale = 255 // ((1 << depth) - 1) if depth < 8 else 1
    if colour in (0, 4):
        out[..., :3] = v[..., :1] * scale
        if colour == 4:
            out[..., 3] = v[..., 1]
    else:
        out[..., : v.shape[2]] = v
    if clear is not None and colour in (0, 2):
        key = np.frombuffer(clear, ">u2")
        whole = full[..., 0].astype(np.uint16) << 8 | full[..., 1] if full is not None else v.astype(np.uint16)
        out[..., 3] = np.where((whole == key).all(axis=2), 0, 255)
    return out


def chunk(kind: bytes, body: bytes) -> bytes:
    return len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")


def header(w: int, h: int, channels: int) -> bytes:
    return chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {3: 2, 4: 6}[channels], 0, 0, 0))


def deflate(samples: np.ndarray) -> bytes:
    """Rows filtered by their left neighbour in the first row and by the row above in the others, compressed."""
    h, w, n = samples.shape
    flat = samples.reshape(h, w * n)
    rows = np.empty((h, w * n + 1), np.uint8)
    rows[0, 0], rows[1:, 0] = 1, 2
    rows[0, 1:] = flat[0] - np.append(np.zeros(n, np.uint8), flat[0, :-n])
    rows[1:, 1:] = flat[1:] - flat[:-1]
    return zlib.compress(rows.tobytes(), 9)


def encode(rgba: np.ndarray, alpha: bool = True) -> bytes:
    """A PNG of (height, width, 4) samples; without alpha, of colour type 2."""
    samples = np.ascontiguousarray(rgba if alpha else rgba[..., :3])
    h, w, n = samples.shape
    return MAGIC + header(w, h, n) + chunk(b"IDAT", deflate(samples)) + chunk(b"IEND", b"")
