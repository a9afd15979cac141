"""Training-order materialisation of token sequences in fixed-stride shards.

Documents become sequences of a fixed number of tokens of a fixed width in bytes: ids of a tokenizer or UTF-8 bytes. A
native pass over the input files counts the sequences of each file split, a row each, and prefix sums over the splits
give every sequence its index. A keyed Feistel permutation with cycle-walking gives each index a place of its own, and
range partitions of places, which are uniform and need no sampling, bring the records into training order: tokens are
cut once and shuffled once, compressed and unpadded. A shard is a run of slots in one file of the shared folder; its
records have one stride, so that a reader resumes at any slot by a multiplication.

Where tokens are counted exactly, places are the slots 0..n-1. Ids of a text are not counted before they are made; its
bytes bound their number, so the places then leave gaps, and a slot is a place's rank: its number in its range partition
plus the partitions before it, which the writer counts. The order follows from the key and the input files.
"""

from __future__ import annotations

import array
import base64
import json
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import few, materialise, shared_dir

#: Tokens of a record, slots of a shard, and the two token values that UTF-8 never has. Of wider tokens, END and PAD are
#: the two largest, as END or PAD before bytes of 0xFF.
STRIDE, SHARD_SLOTS, END, PAD = 2048, 1024, 0xFE, 0xFF
ROUNDS = 4
#: Of the query: bytes of an id, and ids of a record. A document fills its last record up, half a record on average.
ID_BYTES, ID_STRIDE = 2, 512
#: Bytes of tokens that a partition of whole shards should hold, that one should hold when they are read back, and that
#: an Arrow batch may grow to.
PARTITION_BYTES, READ_BYTES, BATCH_BYTES = 128 << 20, 32 << 20, 4 << 20
INDEX = ("slot", "shard", "byte_offset", "doc_id", "seq", "n_tokens")


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    x = (x ^ np.uint64(key)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def feistel(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """Slots of indices below n: a permutation of 0..n-1. Values that leave the range walk on along their cycle."""
    half = max(1, ((n - 1).bit_length() + 1) // 2) if n > 1 else 1
    mask = np.uint64((1 << half) - 1)
    x = index.astype(np.uint64)
    todo = np.ones(len(x), bool)
    while todo.any():
        v = x[todo]
        left, right = v >> np.uint64(half), v & mask
        for r in range(ROUNDS):
            left, right = right, left ^ (_mix(right, key * ROUNDS + r + 1) & mask)
        x[todo] = left << np.uint64(half) | right
        todo = x >= np.uint64(n)
    return x.astype(np.int64)


def packed_bytes(ids: list[int] | np.ndarray, width: int) -> bytes:
    """ids as little-endian numbers of width bytes; refuses those that would be END, PAD or cut off."""
    a = np.asarray(ids, np.int64)
    if a.size and (a.min() < 0 or a.max() >= 256**width - 2):
        raise ValueError(f"an id is not in 0..{256**width - 3}")
    return a.astype(f"<u{width}").tobytes()


def _by_split(docs: DataFrame, column: Column) -> DataFrame:
    """Rows (doc_id, split, tokens) of a table read from files; split names the file split, which one task reads in file order."""
    split = F.xxhash64(F.input_file_name(), F.input_file_block_start(), F.input_file_block_length())
    first = docs.select(F.input_file_name().alias("file")).first()
    if first is not None and not first["file"]:
        docs, column = materialise(docs.select("doc_id", column.alias("tokens"))), F.col("tokens")
    return docs.select("doc_id", split.alias("split"), column.alias("tokens"))


def _offsets(rows: DataFrame, size: Column, stride: int) -> DataFrame:
    """Written rows (split, n, tokens, offset): the sequences of each split, given its rows' tokens, and of those before it."""
    counts = rows.select("split", size.alias("size")).groupBy("split").agg(F.sum(F.floor(F.col("size") / stride) + 1).alias("n"), F.sum("size").alias("tokens"))
    before = Window.orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    # One row a split, so one for 128 MB or so of the table.
    return materialise(counts.select("split", "n", "tokens", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")))


CHANGED = "the input's file splits have changed between the passes"


def _in_order(docs: DataFrame, column: Column, size_of: Column, pack: Callable[[list], list[bytes]], key: int, stride: int, shard_slots: int, width: int) -> DataFrame:
    """Rows (part, place, doc_id, seq, n_tokens, tokens) by place, with partition `part` of whole shards of places.

    size_of: the tokens of a row, or a bound. Tokens are compressed, which costs less than shuffling more.
    """
    rows = _by_split(docs, column)
    offsets = _offsets(rows, size_of, stride)
    total, held = offsets.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("tokens") * width, F.lit(0))).first()
    kind = dict(docs.dtypes)["doc_id"]
    fields = docs.sparkSession.createDataFrame([], f"place bigint, doc_id {kind}, seq int, n_tokens int, tokens binary").schema
    end, size = bytes([END]) + b"\xff" * (width - 1), stride * width

    def cut(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, at_of = to_arrow_schema(fields), {}
        squeeze = zstandard.ZstdCompressor(level=1, write_checksum=False).compress

        def batch(index, rows):
            cols = [feistel(np.array(index, np.int64), total, key), *zip(*rows, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

        for b in batches:
            index, rows, held = [], [], 0
            packed = pack(b.column("tokens").to_pylist())
            for doc_id, split, offset, raw in zip(b.column("doc_id").to_pylist(), b.column("split").to_pylist(), b.column("offset").to_pylist(), packed, strict=True):
                if offset is None:
                    raise ValueError(CHANGED)
                whole, i = raw + end, at_of.get(split, offset)
                for seq, at in enumerate(range(0, len(whole), size)):
                    tokens = whole[at : at + size]
                    index.append(i + seq)
                    rows.append((doc_id, seq, len(tokens) // width, squeeze(tokens)))
                    held += len(tokens)
                    if held >= BATCH_BYTES:
                        yield batch(index, rows)
                        index, rows, held = [], [], 0
                at_of[split] = i + len(whole[::size])
            if rows:
                yield batch(index, rows)

    out = rows.join(few(offsets.select("split", "offset")), "split", "left").select("doc_id", "split", "offset", "tokens").mapInArrow(cut, fields)
    shards = max(1, -(-total // shard_slots))
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = min(shards, max(least, -(-held // PARTITION_BYTES)))
    part = F.floor(F.floor(F.col("place") / shard_slots) * parts / shards).cast("int")
    return out.select(part.alias("part"), "*").repartitionById(parts, F.col("part")).sortWithinPartitions("place")


def _whole(column: pa.Array, size: int) -> list[bytes]:
    """Compressed tokens as records: filled up with PAD."""
    expand, pad = zstandard.ZstdDecompressor().decompress, bytes([PAD])
    return [expand(x.as_buffer()).ljust(size, pad) for x in column]


def records(docs: DataFrame, key: int = 20_26, stride: int = STRIDE, shard_slots: int = SHARD_SLOTS, tokens: str | None = None, width: int = 1) -> DataFrame:
    """Rows (slot, shard, byte_offset, doc_id, seq, n_tokens, record), in slot order, shards whole within partitions.

    tokens: a column of ids (array<int>) or of packed ids (binary) of width bytes each; without it a text gives its UTF-8
    bytes. The tokens and END are cut into records of `stride` tokens, the last filled up with PAD; null counts as empty,
    so every row of docs has a record, repeated rows and null ids too. A long text has as many records as it needs; an
    empty table has none. Other columns are ignored. Equal rows are interchangeable.
    """
    if tokens is None:
        if width != 1:
            raise ValueError("bytes of a text are one byte wide")
        column, pack = F.encode(F.coalesce("text", F.lit("")), "UTF-8"), _as_they_are
    elif dict(docs.dtypes)[tokens] == "binary":
        column, pack = F.col(tokens), _as_they_are
    else:
        column, pack = F.col(tokens), lambda lists: [packed_bytes(x or [], width) for x in lists]
    n = F.col("tokens")
    n = F.size(n) if tokens and dict(docs.dtypes)[tokens] != "binary" else F.floor(F.octet_length(n) / width)
    recs = _in_order(docs, column, F.greatest(F.coalesce(n, F.lit(0)), F.lit(0)), pack, key, stride, shard_slots, width)
    shard, offset = F.floor(F.col("place") / shard_slots), F.col("place") % shard_slots * (stride * width)
    recs = recs.select(F.col("place").alias("slot"), shard.alias("shard"), offset.alias("byte_offset"), "doc_id", "seq", "n_tokens", "tokens")
    target = recs.select(*INDEX, F.col("tokens").alias("record")).schema

    def fill(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(_whole(b.column(len(INDEX)), stride * width), pa.binary())], names=[*INDEX, "record"])

    return recs.mapInArrow(fill, target)


def _as_they_are(raw: list[bytes | None]) -> list[bytes]:
    return [x or b"" for x in raw]


_ENCODERS: dict[str, object] = {}


def text_packer(ranks_path: str, pattern: str, send=None) -> Callable[[list], list[bytes]]:
    """Packs texts (null: empty) as two-byte ids of the byte-level BPE of a ranks file, by the tiktoken library.

    send: a broadcast of the file's bytes, so that executors need no copy of the file.
    """

    def pack(texts):
        import tiktoken

        if ranks_path not in _ENCODERS:
            data = send.value if send is not None else open(ranks_path, "rb").read()
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
            if max(ranks.values()) >= 256**ID_BYTES - 2:
                raise ValueError("the vocabulary needs wider ids")
            _ENCODERS[ranks_path] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        encode = _ENCODERS[ranks_path].encode_ordinary
        return [array.array("H", encode(t)).tobytes() if t else b"" for t in texts]

    return pack


def shard_file(folder: str, run: int, number: int, kind: str = "shard") -> str:
    """Shards are numbered within a run of slots; dense places are one run, 0. kind "ids": the file of its records' ids."""
    return f"{folder}/{kind}-{run:05d}-{number:08d}.bin"


def write(recs: DataFrame, path: str, stride: int = STRIDE, shard_slots: int = SHARD_SLOTS, width: int = 1) -> DataFrame:
    """One file a shard of records() in the folder path (a URI), the ids of its records beside it, then manifest.json; the index, see listed().

    In place of records(), recs may be rows of _in_order(), whose partitions are runs that number their own records. A
    file gets its name when it is whole, so that a task that runs again replaces it. Workers write both files: a table
    written by Spark would cost its JVM some three processes for each file of a local folder, to set its permissions.
    """
    fs.FileSystem.from_uri(path)[0].create_dir(fs.FileSystem.from_uri(path)[1])
    dense, size = "record" in recs.columns, stride * width

    def run(batches):
        store, folder = fs.FileSystem.from_uri(path)
        now, at, out, ids, keys, part = None, 0, None, None, None, ""
        n, last = {}, {}

        def close():
            if out is not None:
                for f in (out, keys, ids):
                    f.close()
                for kind in ("ids", "shard"):
                    store.move(part + kind, shard_file(folder, now, (at - 1) // shard_slots, kind))

        for b in batches:
            runs = [0] * b.num_rows if dense else b.column("part").to_pylist()
            slots = b.column("slot").to_pylist() if dense else [None] * b.num_rows
            held, since = b.column("record").to_pylist() if dense else _whole(b.column("tokens"), size), 0
            named = b.select(INDEX[3:])
            for i, (of, slot, record) in enumerate(zip(runs, slots, held, strict=True)):
                if of != now or at % shard_slots == 0 or (dense and slot % shard_slots == 0 and slot != at):
                    if out is not None:
                        keys.write_batch(named.slice(since, i - since))
                    close()
                    at = slot if dense else at if of == now else 0
                    now, part, since = of, f"{folder}/_{uuid.uuid4().hex}", i
                    out, ids = store.open_output_stream(part + "shard"), store.open_output_stream(part + "ids")
                    keys = pa.ipc.new_stream(ids, named.schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))
                    if at % shard_slots:
                        raise ValueError(f"slot {at} does not begin a shard")
                if len(record) != size or (slot is not None and slot != at):
                    raise ValueError(f"slot {slot} of {len(record)} bytes where {at} of {size} is due")
                out.write(record)
                n[of], last[of] = n.get(of, 0) + 1, max(at, last.get(of, 0))
                at += 1
            if out is not None:
                keys.write_batch(named.slice(since))
        close()
        yield pa.RecordBatch.from_pydict({"run": pa.array(list(n), pa.int32()), "n": pa.array(list(n.values()), pa.int64()), "last": pa.array(list(last.values()), pa.int64())})

    # As many rows as there are partitions.
    total, most = {}, {}
    for r in recs.mapInArrow(run, "run int, n bigint, last bigint").collect():
        total[r["run"]], most[r["run"]] = total.get(r["run"], 0) + r["n"], max(most.get(r["run"], 0), r["last"])
    if any(n != most[of] + 1 for of, n in total.items()):
        raise ValueError("slots are missing")
    counts = [total.get(i, 0) for i in range(max(total, default=-1) + 1)]
    store, folder = fs.FileSystem.from_uri(path)
    with store.open_output_stream(f"{folder}/manifest.json") as f:
        f.write(json.dumps({"runs": counts, "stride": stride, "shard_slots": shard_slots, "width": width}).encode())
    return listed(recs.sparkSession, path, dict(recs.dtypes)["doc_id"])


def _manifest(path: str) -> dict:
    store, folder = fs.FileSystem.from_uri(path)
    with store.open_input_stream(f"{folder}/manifest.json") as f:
        return json.loads(f.read())


def listed(spark: SparkSession, path: str, kind: str, whole: bool = False) -> DataFrame:
    """Rows of INDEX in slot order, of all shards that write() left, with `run` and `number`, which name a shard's file; whole: with `record` instead.

    kind: the type of doc_id. A partition is a stretch of whole shards, read one after another: nothing is shuffled.
    """
    m = _manifest(path)
    per, size = m["shard_slots"], m["stride"] * m["width"]
    slots, shards = (np.cumsum([0, *of], dtype=np.int64) for of in (m["runs"], [-(-n // per) for n in m["runs"]]))
    more = "record binary" if whole else "run int, number bigint"
    target = spark.createDataFrame([], f"slot bigint, shard bigint, byte_offset bigint, doc_id {kind}, seq int, n_tokens int, {more}").schema

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        (store, folder), schema, step = fs.FileSystem.from_uri(path), to_arrow_schema(target), max(1, BATCH_BYTES // size)
        for shard in (x for b in batches for x in b.column(0).to_pylist()):
            of = int(np.searchsorted(shards, shard, "right")) - 1
            number = shard - int(shards[of])
            n, first = min(per, m["runs"][of] - number * per), int(slots[of]) + number * per
            with store.open_input_stream(shard_file(folder, of, number, "ids")) as f:
                ids = pa.ipc.open_stream(f).read_all()
            if len(ids) != n:
                raise ValueError(f"shard {shard} has {len(ids)} records where {n} are due")
            with store.open_input_stream(shard_file(folder, of, number)) as f:
                for at in range(0, n, step):
                    k = min(step, n - at)
                    cols = [first + at + np.arange(k), np.full(k, shard), (at + np.arange(k)) * size]
                    cols = [*cols, *(c.combine_chunks() for c in ids.slice(at, k).columns)]
                    if whole:
                        got = f.read(k * size)
                        if len(got) != k * size:
                            raise ValueError(f"shard {shard} is cut short")
                        ends = pa.py_buffer(np.arange(k + 1, dtype=np.int32) * np.int32(size))
                        cols.append(pa.Array.from_buffers(pa.binary(), k, [None, ends, pa.py_buffer(got)]))
                    else:
                        cols += [np.full(k, of), np.full(k, number)]
                    cols = [c.cast(t.type) if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(cols, schema, strict=True)]
                    yield pa.RecordBatch.from_arrays(cols, schema=schema)

    total = int(shards[-1])
    parts = min(total, max(spark.sparkContext.defaultParallelism, -(-int(slots[-1]) * size // READ_BYTES)))
    return spark.range(0, total, 1, max(1, parts)).mapInArrow(run, target)


def resume(path: str, slot: int = 0) -> Iterator[tuple[int, np.ndarray]]:
    """(slot, tokens) from a slot on in training order, END kept and PAD left out; one seek, no record before it is read."""
    (store, folder), m = fs.FileSystem.from_uri(path), _manifest(path)
    size, per, start = m["stride"] * m["width"], m["shard_slots"], 0
    for run, n in enumerate(m["runs"]):
        while slot < start + n:
            number = (slot - start) // per
            with store.open_input_file(shard_file(folder, run, number)) as f:
                f.seek((slot - start) % per * size)
                for at in range(slot, start + min(n, (number + 1) * per)):
                    record = f.read(size)
                    if len(record) != size:
                        raise ValueError(f"slot {at} is cut short")
                    v = np.frombuffer(record, f"<u{m['width']}")
                    yield at, v[v != 256 ** m["width"] - 1]
                    slot = at + 1
        start += n


def read(index: DataFrame, path: str, stride: int = STRIDE, shard_slots: int = SHARD_SLOTS, width: int = 1) -> DataFrame:
    """Rows of INDEX and `record`, those of records() in the dense case, of any rows of write()'s index, from its files, in slot order."""
    schema = f"{', '.join(f'{c} {t}' for c, t in index.select(*INDEX).dtypes)}, record binary"
    target = index.sparkSession.createDataFrame([], schema).schema

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        store, folder = fs.FileSystem.from_uri(path)
        now, f = None, None
        for b in batches:
            got = []
            for at, *shard in zip(*(b.column(c).to_pylist() for c in ("byte_offset", "run", "number")), strict=True):
                if shard != now:
                    if f is not None:
                        f.close()
                    now, f = shard, store.open_input_file(shard_file(folder, *shard))
                f.seek(at)
                got.append(f.read(stride * width))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in INDEX), pa.array(got, pa.binary())], schema=to_arrow_schema(target))
        if f is not None:
            f.close()

    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    last = (index.agg(F.max("shard")).first()[0] or 0) + 1
    return index.repartitionById(parts, F.floor(F.col("shard") * parts / last).cast("int")).sortWithinPartitions("slot").mapInArrow(run, target)


def default_ranks() -> tuple[str, str]:
    """The ranks file and the split pattern of the byte-level vocabulary among the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def shards(docs: DataFrame, ranks_path: str, pattern: str, key: int = 20_26) -> DataFrame:
    """records() of the vocabulary's ids, by way of shard files in the shared folder, which stay for readers."""
    spark = docs.sparkSession
    with open(ranks_path, "rb") as f:
        pack = text_packer(ranks_path, pattern, spark.sparkContext.broadcast(f.read()))
    for left in (2, 1, 0):
        path = f"{shared_dir(spark)}/tessera/shards-{uuid.uuid4().hex}"
        try:
            # A byte-level id is a byte or more.
            recs = _in_order(docs, F.col("text"), F.coalesce(F.octet_length("tokens"), F.lit(0)), pack, key, ID_STRIDE, SHARD_SLOTS, ID_BYTES)
            write(recs, path, ID_STRIDE, width=ID_BYTES)
            break
        except PySparkException as e:  # a small input is split by the number of cores, which a lost executor changes
            if not left or CHANGED not in str(e):
                raise
    return listed(spark, path, dict(docs.dtypes)["doc_id"], whole=True)
