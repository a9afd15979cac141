"""Kernels on masks and label maps of one picture: components, fills, distances, skeletons, speckles."""

from __future__ import annotations

from collections import deque

import numpy as np

AROUND4 = ((0, -1), (-1, 0), (1, 0), (0, 1))
AROUND8 = ((-1, -1), (0, -1), (1, -1), (-1, 0), (1, 0), (-1, 1), (0, 1), (1, 1))


def label(mask: np.ndarray, around=AROUND8) -> tuple[np.ndarray, int]:
    """Components numbered from 1 in scan order of their first pixel; 0 outside the mask."""
    h, w = mask.shape
    out, n = np.zeros((h, w), np.int32), 0
    for y, x in np.argwhere(mask):
        if out[y, x]:
            continue
        n += 1
        out[y, x] = n
        todo = deque([(y, x)])
        while todo:
            v, u = todo.popleft()
            for dx, dy in around:
                p, q = v + dy, u + dx
                if 0 <= p < h and 0 <= q < w and mask[p, q] and not out[p, q]:
                    out[p, q] = n
                    todo.append((p, q))
    return out, n


def filled(mask: np.ndarray) -> np.ndarray:
    """The mask and every hole that a walk over sides from outside can't reach."""
    outside, _ = label(np.pad(~mask, 1, constant_values=True), AROUND4)
    return (outside != outside[0, 0])[1:-1, 1:-1]


def chamfer(mask: np.ndarray) -> np.ndarray:
    """3-4 distances to the outside, what lies past the picture being outside."""
    h, w = mask.shape
    far = 4 * (h + w + 2)
    d = np.zeros((h + 2, w + 2), np.int32)
    d[1:-1, 1:-1] = np.where(mask, far, 0)
    for y in range(1, h + 1):
        for x in range(1, w + 1):
            if d[y, x]:
                d[y, x] = min(d[y, x], d[y, x - 1] + 3, d[y - 1, x] + 3, d[y - 1, x - 1] + 4, d[y - 1, x + 1] + 4)
    for y in range(h, 0, -1):
        for x in range(w, 0, -1):
            if d[y, x]:
                d[y, x] = min(d[y, x], d[y, x + 1] + 3, d[y + 1, x] + 3, d[y + 1, x + 1] + 4, d[y + 1, x - 1] + 4)
    return d[1:-1, 1:-1]


def _ring(m: np.ndarray) -> list[np.ndarray]:
    """The eight neighbours of every pixel, clockwise from above, nothing outside."""
    p = np.pad(m, 1).astype(np.uint8)
    h, w = m.shape
    return [p[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for dx, dy in ((0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1))]


def crossings(mask: np.ndarray) -> np.ndarray:
    """How often the ring around each pixel of the mask goes from off to on: 1 at an end, 2 on a line, more at a branch."""
    r = _ring(mask)
    n = sum(((r[i] == 0) & (r[(i + 1) % 8] == 1)).astype(np.int32) for i in range(8))
    return np.where(mask, n, 0)


def thin(mask: np.ndarray) -> np.ndarray:
    """Zhang-Suen thinning until nothing changes; each half pass deletes at once."""
    m = mask.copy()
    while True:
        before = m.sum()
        for half in (0, 1):
            r = _ring(m)
            total = sum(v.astype(np.int32) for v in r)
            up, right, down, left = r[0], r[2], r[4], r[6]
            a, b = (up & right & down, right & down & left) if half == 0 else (up & right & left, up & down & left)
            m = m & ~((total >= 2) & (total <= 6) & (crossings(m) == 1) & (a == 0) & (b == 0))
        if m.sum() == before:
            return m


def majority(labels: np.ndarray, passes: int = 2) -> np.ndarray:
    """A 3 by 3 majority filter; the pixel's own label wins ties, then the lowest. Negative labels stay and don't count."""
    out = labels.copy()
    for _ in range(passes):
        names = np.unique(out[out >= 0])
        p = np.pad(out, 1, constant_values=-1)
        h, w = out.shape
        votes = np.stack([sum((p[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] == v).astype(np.int32) for dx, dy in (*AROUND8, (0, 0))) for v in names]) if len(names) else None
        if votes is None:
            return out
        best = votes.max(axis=0)
        own = sum(np.where(out == v, votes[i], 0) for i, v in enumerate(names))
        out = np.where((out < 0) | (own == best), out, names[votes.argmax(axis=0)])
    return out


def despeckle(labels: np.ndarray, least: int) -> np.ndarray:
    """Pieces of fewer than `least` pixels take the label most of their neighbours have, in scan order, at once."""
    out = labels.copy()
    h, w = out.shape
    seen = np.zeros((h, w), bool)
    for y in range(h):
        for x in range(w):
            if seen[y, x] or out[y, x] < 0:
                continue
            piece, edge, todo = [(y, x)], {}, deque([(y, x)])
            seen[y, x] = True
            while todo:
                v, u = todo.popleft()
                for dx, dy in AROUND4:
                    p, q = v + dy, u + dx
                    if not (0 <= p < h and 0 <= q < w):
                        continue
                    if out[p, q] == out[y, x]:
                        if not seen[p, q]:
                            seen[p, q] = True
                            piece.append((p, q))
                            todo.append((p, q))
                    elif out[p, q] >= 0:
                        edge[out[p, q]] = edge.get(out[p, q], 0) + 1
            if len(piece) < least and edge:
                new = min(edge, key=lambda k: (-edge[k], k))
                for p, q in piece:
                    out[p, q] = new
    return out
