"""The encoder's files through both of the decoder's ways, and what the query's own files hold."""

import numpy as np
import pytest

from tessera.llm import media, webp
from tessera.llm.common import table


def pictures():
    rnd = np.random.default_rng(8)
    text = np.frombuffer((b"The same line of text again and again, with its variations. " * 200)[:9216], np.uint8).reshape(16, 144, 4)
    yield "text", text
    yield "noise", rnd.integers(0, 256, (40, 31, 4)).astype(np.uint8)
    yield "dot", np.array([[[1, 2, 3, 4]]], np.uint8)
    yield "column", rnd.integers(97, 123, (300, 1, 4)).astype(np.uint8)
    for n in (1, 2, 3, 4, 5, 16, 17):
        yield f"{n} colours", rnd.integers(0, 256, (n, 4)).astype(np.uint8)[rnd.integers(0, n, (13, 37))]
    far = rnd.integers(97, 123, (70, 100, 4)).astype(np.uint8)
    far[60:] = far[:10]
    far[30, 5:90] = far[30, 5]
    yield "far copies", far


@pytest.mark.parametrize(("name", "p"), list(pictures()), ids=lambda v: v if isinstance(v, str) else "")
def test_round_trip(monkeypatch, name, p):
    data = webp.encode(p)
    assert np.array_equal(webp.decode(data), p)
    monkeypatch.setattr(webp.Code, "lookup", lambda self: None)  # symbol by symbol
    assert np.array_equal(webp.decode(data), p)


def test_stretches_meet(monkeypatch):
    monkeypatch.setattr(webp, "STRETCH", 64)
    for _, p in pictures():
        assert np.array_equal(webp.decode(webp.encode(p)), p)


def test_lengths_are_complete():
    rnd = np.random.default_rng(1)
    for n in (2, 3, 40, 256, 280):
        lengths = webp.code_lengths(rnd.random(n) ** 6 + 1e-3)
        assert sum(2.0**-k for k in lengths) == 1
        b = webp.Bits()
        webp.declare(b, [min(k, 15) for k in lengths])
        b.data, b.at = (b.value | 1 << b.at + 16).to_bytes((b.at + 24) // 8, "little"), 0
        assert {s: k for (k, _), s in webp._read_code(b, n).of.items()} == dict(enumerate(lengths))


def test_prefix():
    for v in (1, 2, 4, 5, 6, 7, 120, 121, 4096, 1 << 20):
        symbol, extra, n = webp._prefix(v)
        b = webp.Bits(extra.to_bytes(8, "little"))
        assert webp._reach(b, symbol) == v and b.at == n


@pytest.mark.parametrize("cut", [30, 200, 260, 300])
def test_cut_streams_are_refused(cut):
    data = webp.encode(dict(pictures())["column"])
    assert len(data) > cut
    with pytest.raises(ValueError):
        webp.decode(data[:cut])


def test_the_query_is_stored_smaller_by_the_general_path(spark, monkeypatch):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    sizes = media.features(docs).selectExpr("sum(media_bytes) m", "sum(payload_bytes) p").first()
    assert sizes.m < 0.7 * sizes.p
    seen = {"copy": 0, "palette": 0, "coded": 0}
    for name, key in (("_copy", "copy"), ("_undo_palette", "palette"), ("_read_stretches", "coded")):
        real = getattr(webp, name)
        monkeypatch.setattr(webp, name, lambda *a, real=real, key=key: (seen.__setitem__(key, seen[key] + 1), real(*a))[1])
    for r in docs.limit(300).collect():
        payload, _ = media.payload_of(r.text)
        assert media.load(media.store(payload)).tobytes() == payload
    assert np.array_equal(media.load(media.store(media.payload_of(None)[0])), np.full((1, 144, 4), 255))
    assert all(seen.values()), seen
