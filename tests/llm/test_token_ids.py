"""Shard files of token ids: every id comes back, and a reader resumes at any slot."""

import base64
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import queries, token_shards
from tessera.llm.common import reach_package, table

SF = "/root/testdata/sf0.001"


def test_ids_and_resume(spark, tmp_path):
    reach_package(spark)
    rnd = np.random.default_rng(1)
    ids = {k: rnd.integers(0, 49_408, 7 * k).tolist() for k in range(40)}
    d = spark.createDataFrame([*ids.items(), (40, None)], "doc_id bigint, ids array<int>")
    recs = token_shards.records(d, stride=8, shard_slots=16, tokens="ids", width=2).persist()
    where = recs.rdd.mapPartitionsWithIndex(lambda i, it: {(r.shard, i) for r in it}).collect()
    assert len({s for s, _ in where}) == len(set(where)) > 10
    path = f"file://{tmp_path}/shards"
    index = token_shards.write(recs, path, 8, 16, 2)
    want, at = recs.collect(), list(token_shards.resume(path))
    assert [s for s, _ in at] == [r.slot for r in want] == list(range(len(want)))
    texts = defaultdict(dict)
    for r, (_, v) in zip(want, at, strict=True):
        assert len(v) == r.n_tokens
        texts[r.doc_id][r.seq] = v.tolist()
    assert {k: sum((v[i] for i in sorted(v)), []) for k, v in texts.items()} == {k: [*(v or []), 0xFFFE] for k, v in {**ids, 40: None}.items()}
    for slot in (0, 15, 16, 37, len(want) - 1, len(want)):
        assert [(s, v.tolist()) for s, v in token_shards.resume(path, slot)] == [(s, v.tolist()) for s, v in at[slot:]]
    assert token_shards.read(index, path, 8, 16, 2).collect() == want
    assert {f.stat().st_size for f in (tmp_path / "shards").glob("shard-*")} <= {256, len(want) % 16 * 16}


def test_width_is_enough():
    with pytest.raises(ValueError):
        token_shards.packed_bytes([65_534], 2)


def brute_slot(index, n, key):
    """One index at a time, in whole numbers: the network over 2 * half bits, walked until the value is below n."""
    big, half = 2**64 - 1, max(1, ((n - 1).bit_length() + 1) // 2) if n > 1 else 1

    def mix(x, k):
        x = (x ^ k) * 0xBF58476D1CE4E5B9 & big
        x ^= x >> 29
        x = x * 0x94D049BB133111EB & big
        return x ^ x >> 32

    while True:
        left, right = index >> half, index % 2**half
        for r in range(4):
            left, right = right, left ^ mix(right, key * 4 + r + 1) % 2**half
        index = left * 2**half + right
        if index < n:
            return index


def test_slots_by_whole_numbers():
    for n in (1, 2, 77, 1025):
        assert token_shards.feistel(np.arange(n), n, 2026).tolist() == [brute_slot(i, n, 2026) for i in range(n)]


def encoder(name):
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(name), "rb"))}
    return tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pieces_join_to_the_whole():
    import public_tokenizers

    name, rnd = "byte_bpe_50k.tiktoken", np.random.default_rng(3)
    parts = ["a", "it's", " ", "\n", "\t", "  ", "12", "é", "日本", "!?", "\u00a0", "\x1c", "\0", "<|endoftext|>", "'ll", "\r\n", "x\n\n"]
    texts = ["".join(rnd.choice(parts, rnd.integers(1, 30))) for _ in range(4000)]
    whole, pack = encoder(name), token_shards.text_packer(public_tokenizers.path(name), public_tokenizers.PATTERN)
    for t, raw in zip(texts, pack(texts), strict=True):
        assert np.frombuffer(raw, "<u2").tolist() == whole.encode_ordinary(t), t


def test_query_has_the_tokenizers_ids(spark):
    whole = encoder("byte_bpe_multi_50k.tiktoken")
    want = {r.doc_id: whole.encode_ordinary(r.text or "") for r in table(spark, SF, "documents").collect()}
    got, slots, before = defaultdict(dict), [], (-1, 0)
    for r in queries.op9_token_shards(spark, SF).collect():
        assert len(r.record) == 1024 and r.byte_offset % 1024 == 0
        assert (r.shard, r.byte_offset) == (before[0] + 1, 0) if before[1] == 1023 * 1024 or not r.byte_offset else (before[0], before[1] + 1024)
        before = r.shard, r.byte_offset
        slots.append(r.slot)
        got[r.doc_id][r.seq] = np.frombuffer(bytes(r.record), "<u2")[: r.n_tokens].tolist()
    assert slots == list(range(len(slots)))
    assert {k: sum((v[i] for i in sorted(v)), []) for k, v in got.items()} == {k: [*v, 0xFFFE] for k, v in want.items()}


def test_a_text_over_several_shards(spark, tmp_path):
    """One document of more records than a shard has slots, repeated rows, null ids and an empty table."""
    long = "x" * 5000
    d = spark.createDataFrame([(1, long), (1, long), (None, "n"), (None, "n"), (2, None)], "doc_id bigint, text string")
    got = token_shards.records(d, stride=64, shard_slots=16).collect()
    assert [r.slot for r in got] == list(range(2 * 79 + 3)) and max(r.shard for r in got) == 10
    assert sum(bytes(r.record).count(b"x") for r in got) == 10_000
    path = f"file://{tmp_path}/long"
    token_shards.write(token_shards.records(d.limit(0)), path)
    assert list(token_shards.resume(path)) == []


def test_runs_resume(spark, tmp_path):
    """Places with gaps, whose partitions number their own records: slots follow the places, and a reader resumes at any."""
    docs = table(spark, SF, "documents")
    pack = token_shards.text_packer(*token_shards.default_ranks())
    recs = token_shards._in_order(docs, F.col("text"), F.octet_length("tokens"), pack, 7, 64, 16, 2).persist()
    path = f"file://{tmp_path}/runs"
    index = token_shards.write(recs, path, 64, 16, 2)
    order = [(r.doc_id, r.seq) for r in recs.orderBy("place").collect()]
    got = token_shards.read(index, path, 64, 16, 2).collect()
    assert [(r.doc_id, r.seq) for r in got] == order and [r.slot for r in got] == list(range(len(order)))
    assert index.select("run").distinct().count() > 1
    for slot in (0, 15, 16, len(order) // 2, len(order) - 1):
        assert [(s, v.tolist()) for s, v in token_shards.resume(path, slot)] == [(r.slot, np.frombuffer(bytes(r.record), "<u2")[: r.n_tokens].tolist()) for r in got[slot:]]
