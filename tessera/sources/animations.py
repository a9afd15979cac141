"""Animated and container formats: APNG, GIF and ICO."""

from __future__ import annotations

import struct

import numpy as np

from tessera.sources import png


def encode_apng(frames: list[np.ndarray], delays_ms: list[int], loops: int = 0) -> bytes:
    """Frames of one size, each cleared before the next; delays in milliseconds."""
    h, w = frames[0].shape[:2]
    out, seq = [png.MAGIC, png.header(w, h, 4), png.chunk(b"acTL", struct.pack(">II", len(frames), loops))], 0
    for i, (f, ms) in enumerate(zip(frames, delays_ms, strict=True)):
        out.append(png.chunk(b"fcTL", struct.pack(">IIIIIHHBB", seq, w, h, 0, 0, ms, 1000, 1, 0)))
        seq += 1
        body = png.deflate(np.ascontiguousarray(f))
        if i == 0:
            out.append(png.chunk(b"IDAT", body))
        else:
            out.append(png.chunk(b"fdAT", struct.pack(">I", seq) + body))
            seq += 1
    return b"".join([*out, png.chunk(b"IEND", b"")])


def apng_delays(data: bytes) -> list[int]:
    """The delay of each frame in milliseconds; its length is the number of frames."""
    out = []
    for kind, body in png.chunks(data):
        if kind == b"fcTL":
            num, den = struct.unpack(">HH", body[20:24])
            out.append(round(num * 1000 / (den or 100)))
    return out


def lzw(indices: np.ndarray, bits: int) -> bytes:
    """GIF's LZW: codes from the lowest bit, the table cleared when it holds 4,096, in sub-blocks of up to 255 bytes."""
    clear, stop = 1 << bits, (1 << bits) + 1
    table = {(i,): i for i in range(clear)}
    width, nxt, acc, filled, out = bits + 1, stop + 1, 0, 0, bytearray()

    def put(code: int) -> None:
        nonlocal acc, filled
        acc |= code << filled
        filled += width
        while filled >= 8:
            out.append(acc & 255)
            acc >>= 8
            filled -= 8

    put(clear)
    run: tuple[int, ...] = ()
    for v in indices.tolist():
        longer = (*run, v)
        if longer in table:
            run = longer
            continue
        put(table[run])
        if nxt < 4096:
            table[longer] = nxt
            if nxt == 1 << width and width < 12:
                width += 1
            nxt += 1
        else:
            put(clear)
            table = {(i,): i for i in range(clear)}
            width, nxt = bits + 1, stop + 1
        run = (v,)
    if run:
        put(table[run])
    put(stop)
    if filled:
        out.append(acc & 255)
    blocks = b"".join(bytes([len(out[i : i + 255])]) + out[i : i + 255] for i in range(0, len(out), 255))
    return bytes([bits]) + blocks + b"\0"


def unlzw(data: bytes, bits: int) -> list[int]:
    """The indices of LZW data without its sub-blocks."""
    clear, stop = 1 << bits, (1 << bits) + 1
    value, filled, at, out = 0, 0, 0, []
    table: list[tuple[int, ...]] = []
    width, last = bits + 1, None
    while True:
        while filled < width:
            if at >= len(data):
                raise ValueError("the LZW data ends early")
            value |= data[at] << filled
            filled += 8
            at += 1
        code, value, filled = value & ((1 << width) - 1), value >> width, filled - width
        if code == clear:
            table, width, last = [(i,) for i in range(clear)] + [(), ()], bits + 1, None
            continue
        if code == stop:
            return out
        if last is None:
            entry = table[code]
        else:
            entry = table[code] if code < len(table) else (*last, last[0])
            if len(table) < 4096:
                table.append((*last, entry[0]))
        out += entry
        last = entry
        if len(table) == 1 << width and width < 12:
            width += 1


def encode_gif(frames: list[np.ndarray], palette: np.ndarray, delays_ms: list[int]) -> bytes:
    """A looping GIF of RGBA frames under one palette of up to 255 colours; pixels with alpha below 128 are clear."""
    h, w = frames[0].shape[:2]
    n = len(palette)
    bits = max(2, int(n).bit_length())
    table = np.zeros((1 << bits, 3), np.uint8)
    table[:n] = palette
    out = [b"GIF89a", struct.pack("<HHBBB", w, h, 0xF0 | (bits - 1), 0, 0), table.tobytes(), b"\x21\xff\x0bNETSCAPE2.0\x03\x01\0\0\0"]
    for f, ms in zip(frames, delays_ms, strict=True):
        apart = ((f[..., None, :3].astype(np.int32) - palette.astype(np.int32)) ** 2).sum(axis=3)
        index = np.where(f[..., 3] < 128, n, apart.argmin(axis=2))
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", 2 << 2 | 1, max(2, int(ms / 10 + 0.5)), n) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, w, h, 0) + lzw(index.ravel(), bits))
    return b"".join([*out, b"\x3b"])


def gif_frames(data: bytes) -> list[list[int]] | None:
    """The indices of every frame; null for what isn't a GIF."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        return None
    skip = lambda flags: 3 << ((flags & 7) + 1) if flags & 128 else 0
    at, out = 13 + skip(data[10]), []

    def blocks(at: int) -> tuple[bytes, int]:
        body = []
        while n := data[at]:
            body.append(data[at + 1 : at + 1 + n])
            at += n + 1
        return b"".join(body), at + 1

    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            _, at = blocks(at + 2)
        elif data[at] == 0x2C:
            at += 10 + skip(data[at + 9])
            bits = data[at]
            body, at = blocks(at + 1)
            out.append(unlzw(body, bits))
        else:
            raise ValueError("an unknown GIF block")
    return out


def encode_ico(images: list[np.ndarray]) -> bytes:
    """Square icons of 1 to 256, smallest first: bitmaps with an AND mask below 256, a PNG at 256."""
    images = sorted(images, key=len)
    bodies = []
    for m in images:
        h, w = m.shape[:2]
        if h != w or not 1 <= w <= 256:
            raise ValueError("an icon must be square, from 1 to 256")
        if w == 256:
            bodies.append(png.encode(m))
            continue
        mask = np.packbits(m[::-1, :, 3] < 128, axis=1)
        mask = np.pad(mask, ((0, 0), (0, -mask.shape[1] % 4)))
        pixels = m[::-1][..., [2, 1, 0, 3]]
        head = struct.pack("<IiiHHIIiiII", 40, w, 2 * h, 1, 32, 0, pixels.size + mask.size, 0, 0, 0, 0)
        bodies.append(head + np.ascontiguousarray(pixels).tobytes() + mask.tobytes())
    at, entries = 6 + 16 * len(images), []
    for m, b in zip(images, bodies, strict=True):
        entries.append(struct.pack("<BBBBHHII", len(m) % 256, len(m) % 256, 0, 0, 1, 32, len(b), at))
        at += len(b)
    return struct.pack("<HHH", 0, 1, len(images)) + b"".join(entries) + b"".join(bodies)


def ico_entries(data: bytes) -> list[dict]:
    """Width, height (0 means 256), bytes and kind of each icon."""
    if len(data) < 6 or data[:4] != b"\0\0\1\0":
        raise ValueError("not an icon file")
    out = []
    for i in range(int.from_bytes(data[4:6], "little")):
        w, h, _, _, _, _, n, at = struct.unpack("<BBBBHHII", data[6 + 16 * i : 22 + 16 * i])
        out.append({"width": w or 256, "height": h or 256, "bytes": n, "kind": "png" if data[at : at + 8] == png.MAGIC else "bmp"})
    return out
