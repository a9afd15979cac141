"""Exact Jaccard join of documents on word shingles, in the metric space of their shingle sets.

d(x, y) = 1 - |x & y| / |x | y| is a metric; x and y link when d <= TAU. The join runs in four steps, all exact:

1. Sets. Every whole text becomes the sorted 64-bit hashes of its distinct shingles; equal sets are one node.
2. Survivors. If x links with anything, then under any fixed order of shingles its first n - ceil(.8 n) + l of them
   hold l that also stand among the first of its partner. So a node with too few shared shingles there has no link and
   is set aside. Each map task posts a shingle once, so no reducer gets more of one shingle than there are tasks.
3. Regions. The survivors' shingles are ordered by (frequency of the frequent, hash); the members of a region share a shingle
   among the first n - ceil(.8 n) + 1 of each, and every linked pair meets in a region. Equal regions are joined once.
4. Clusters. Regions that share members are one cluster, so a node is in one cluster only and its set travels once.
5. Recursion, in a cluster of bounded size within a task. A region elects pivots and gets the exact distance of each
   member to each. Members nearer to one pivot than to all others by more than 2 TAU are the interior of its Voronoi
   cell; the interiors of two cells have no link (triangle inequality). A cell goes on with its interior and those
   boundary members that lie within TAU of it in distance to the pivot; the boundary members go on among themselves.
   Pivots leave, as do members all of whose possible partners link to the same pivot, being connected by it. What pivots
   no longer divide compares the pairs whose distances to every pivot differ by TAU at most. Regions of one component so
   far are settled.
6. A cluster too large for a task goes the same way in rounds of jobs, region by region, while a round makes the largest
   regions clearly smaller; regions beyond that, and small ones, compare blocks of pairs of different components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, few, materialise, reach_package
from tessera.llm.components import components, labels

WIDTH, TAU, EPS = 5, 0.2, 1e-9
#: Bits of the broadcast filter of surviving rows, and the rows up to which it is used; beyond, a join takes its place.
FILTER_BITS = 1 << 26
FILTER_ROWS = FILTER_BITS >> 3
#: A shingle of this many survivors is frequent; so many frequent ones, the most frequent, come last, by frequency. Results
#: don't depend on it, as any order common to all nodes will do.
FREQUENT, MOST_FREQUENT = 4, 1 << 18
#: Pivots of a region, and the members of a block of pairs. A cluster is joined in one task if its sets hold no more than
#: TASK_SHINGLES and if comparing each with all takes no more than TASK_WORK steps, half a minute; larger ones go by rounds
#: of jobs, in which regions of more than LEAF members elect pivots.
PIVOTS, BLOCK, LEAF, TASK_SHINGLES, TASK_WORK = 4, 256, 256, 1 << 22, 1 << 30
#: A region that a round of jobs has not brought below this share of the largest one is not divided further by pivots.
SHRINK = 0.75
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _Words()


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Ascending distinct hashes (int64) of the runs of `width` words; the whole sequence where there are fewer words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    n = len(words)
    if not n:
        return np.empty(0, np.int64)
    if len(_WORDS) > 200_000:
        _WORDS.clear()
    w = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, n)
    k = min(width, n)
    h = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        h = (h ^ w[j : n - k + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return np.unique(h.view(np.int64))


def least_common(n: int) -> int:
    """The fewest shingles that a set of n shares with any partner."""
    return -(-4 * n // 5)


def _extra(n: int) -> int:
    return max(1, n // 16)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(arrays) if arrays else np.empty(0, np.int64)))


def _sets(docs: DataFrame) -> DataFrame:
    """A row for each row of docs: doc_id, rid, n, sig, need, here, solo; and a witness row for each map task.

    solo: the first shingles that only this set of its task has; here: how many others of the first ones there are;
    the witness row, without sig, has those in its solo. Copies within a task post nothing.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("rid", pa.string()), ("n", pa.int64()), ("sig", pa.binary()), ("need", pa.int64()), ("here", pa.int64()), ("solo", pa.list_(pa.int64()))])

    def run(batches):
        rows, first, seen = [], [], set()
        for b in batches:
            for k, rid, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                s = shingles(text)
                n = len(s)
                sig = xxhash.xxh3_128_digest(s.tobytes())
                rows.append((k, rid, n, sig))
                fresh = n and sig not in seen
                seen.add(sig)
                first.append(s[: n - least_common(n) + _extra(n)] if fresh else s[:0])
        if not rows:
            return
        flat = np.concatenate(first)
        _, inv, times = np.unique(flat, return_inverse=True, return_counts=True)
        alone = times[inv] == 1
        ends = np.cumsum([len(x) for x in first])
        step = 2048
        for a in range(0, len(rows), step):
            part = rows[a : a + step]
            solo, here = [], []
            for e, x in zip(ends[a : a + step], first[a : a + step], strict=True):
                own = alone[e - len(x) : e]
                solo.append(x[own])
                here.append(len(x) - int(own.sum()))
            need = [_extra(least_common(r[2])) if r[2] else 1 for r in part]
            cols = [*zip(*part, strict=True), need, here]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(cols, schema, strict=False)), _lists(solo)], schema=schema)
        several = np.unique(flat[~alone])
        if len(several):
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, f.type) for f in list(schema)[:-1]), _lists([several])], schema=schema)

    rid = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), rid.alias("rid"), "text").mapInArrow(run, "doc_id bigint, rid string, n bigint, sig binary, need bigint, here bigint, solo array<bigint>")


def _survivors(sets: DataFrame) -> DataFrame:
    """Rows (sig, rid): one row of docs for each set that has enough shared shingles among its first ones."""
    # The witness rows, whose sig is null, are one node more.
    posts = sets.where(F.size("solo") > 0).select(F.xxhash64("sig").alias("node"), F.explode("solo").alias("h"))
    n = int(posts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def shared(batches):
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if not got:
            return
        node, h = (np.concatenate(x) for x in zip(*got, strict=True))
        order = np.lexsort((node, h))
        node, h = node[order], h[order]
        # A shingle is shared if two different nodes post it; each of them is told once.
        once = np.append(True, (h[1:] != h[:-1]) | (node[1:] != node[:-1]))
        node, h = node[once], h[once]
        run = np.cumsum(np.append(True, h[1:] != h[:-1])) - 1
        yield pa.RecordBatch.from_arrays([pa.array(node[np.bincount(run)[run] > 1], pa.int64())], names=["node"])

    times = posts.repartition(n, "h").select("node", "h").mapInArrow(shared, "node bigint").groupBy("node").agg(F.count("*").alias("times"))
    own = sets.where("sig is not null and n > 0").select(F.xxhash64("sig").alias("node"), "sig", "rid", "need", "here")
    # All rows of a set say the same of it but for `here`, which counts what its own task shares; a task's first copy says it.
    one = own.groupBy("node", "sig").agg(F.min("rid").alias("rid"), F.max("need").alias("need"), F.max("here").alias("here"))
    return one.join(times, "node", "left").where("here + coalesce(times, 0) >= need").select("sig", "rid")


def _arrays(docs: DataFrame, alive: DataFrame) -> DataFrame:
    """Rows (nid, sig, n, arr, sketch) of the survivors: their whole shingle sets, and how many fall in each of 256 classes.

    Sketches are no farther apart (summed differences) than the sets they are of, which a cap of 255 leaves true.
    """
    rid = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    texts = docs.select(rid.alias("rid"), "text")
    bits = None
    if alive.count() <= FILTER_ROWS:
        place = F.pmod(F.xxhash64("rid"), F.lit(FILTER_BITS))
        maps = alive.groupBy(F.bitmap_bucket_number(place).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
        whole = np.zeros(FILTER_BITS // 8 + 8192, np.uint8)
        for r in maps:  # buckets count from 1 for places from 1, and place 0 is in bucket 0
            whole[4096 * r["k"] : 4096 * (r["k"] + 1)] = np.frombuffer(r["bits"], np.uint8)
        bits = docs.sparkSession.sparkContext.broadcast(whole)
        texts = texts.select(F.bitmap_bucket_number(place).alias("k"), F.bitmap_bit_position(place).alias("p"), "text")
    else:
        texts = texts.join(alive.select("rid").distinct(), "rid", "left_semi").select(F.lit(0).alias("k"), F.lit(0).alias("p"), "text")

    schema = pa.schema([("sig", pa.binary()), ("n", pa.int64()), ("sketch", pa.binary()), ("arr", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            k, p = (batch.column(i).to_numpy() for i in (0, 1))
            hit = np.flatnonzero((bits.value[4096 * k + (p >> 3)] >> (p & 7).astype(np.uint8)) & 1) if bits is not None else np.arange(len(k))
            sets = [s for i in hit.tolist() if len(s := shingles(batch.column(2)[i].as_py()))]
            sigs = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            sketches = [np.minimum(np.bincount(s & 255, minlength=256), 255).astype(np.uint8).tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(sigs, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(sketches, pa.binary()), _lists(sets)], schema=schema)

    return texts.select("k", "p", "text").mapInArrow(run, "sig binary, n bigint, sketch binary, arr array<bigint>").withColumn("nid", F.monotonically_increasing_id())


def _regions(nodes: DataFrame) -> DataFrame:
    """Rows (r1, r2, nid): the members of each region, equal regions once.

    A node of whose shingles fewer than least_common(n) are anyone else's has no link and is in no region.
    """
    counts = materialise(nodes.select("nid", F.explode("arr").alias("h")).groupBy("h").agg(F.count("*").alias("m"), F.min("nid").alias("nid")))
    own = counts.where("m = 1").groupBy("nid").agg(F.count("*").alias("own"))
    keep = materialise(nodes.select("nid", "n").join(own, "nid", "left").where("coalesce(own, 0) <= n - ceil(n * 4 / 5)").select("nid"))
    # The least frequency from which on at most MOST_FREQUENT shingles are: from a histogram of sixteenths of powers of two.
    step = F.floor(F.log2(F.col("m").cast("double")) * 16)
    seen = {r["step"]: r["count"] for r in counts.where(F.col("m") >= FREQUENT).groupBy(step.alias("step")).count().collect()}
    total, least = 0, None
    for k in sorted(seen, reverse=True):
        total += seen[k]
        if total > MOST_FREQUENT:
            break
        least = k
    top = counts.where((F.col("m") >= FREQUENT) & (step >= F.lit(least).cast("long"))).select("h", "m").toPandas().sort_values("h")
    often = top["h"].to_numpy(np.int64), top["m"].to_numpy(np.int64)
    discard(counts)
    send = nodes.sparkSession.sparkContext.broadcast(often)
    schema = pa.schema([("h", pa.int64()), ("nid", pa.int64()), ("e", pa.int64())])

    def first(batches):
        often, times = send.value
        for b in batches:
            hs, ids, es = [], [], []
            for nid, arr in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                s = arr.values.to_numpy()
                n = len(s)
                if len(often):
                    at = np.minimum(np.searchsorted(often, s), len(often) - 1)
                    s = s[np.argsort(np.where(often[at] == s, times[at], 0), kind="stable")]
                s = s[: n - least_common(n) + 1]
                hs.append(s)
                ids.append(np.full(len(s), nid))
                # Before their first common shingle x and y differ in all; e(x) + e(y) <= 0 says that this is few enough.
                es.append(9 * np.arange(len(s)) - n)
            if hs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (hs, ids, es)], schema=schema)

    posts = materialise(nodes.select("nid", "arr").mapInArrow(first, "h bigint, nid bigint, e bigint").join(keep, "nid", "left_semi"))
    best = materialise(posts.groupBy("h").agg(F.min("e").alias("least"), F.count("*").alias("m")).where("m > 1").select("h", "least"))
    near = materialise(posts.join(best, "h").where("e + least <= 0").select("h", "nid", "e"))
    discard(posts, best, keep)
    out = _once(near, ["h"])
    discard(near)
    return out


def _once(members: DataFrame, region: list[str]) -> DataFrame:
    """Rows (r1, r2, nid, e) of written rows (region..., nid, e), those of equal regions once, with a member's least e.

    A region is named by two 64-bit digests of sums over its members' hashes.
    """
    big = "decimal(38,0)"
    sums = [F.sum(F.xxhash64("nid", F.lit(i)).cast(big)).alias(f"s{i}") for i in (1, 2)]
    names = members.groupBy(*region).agg(F.count("*").alias("m"), *sums).where("m > 1")
    names = materialise(names.select(*region, F.xxhash64("s1", "m").alias("q1"), F.xxhash64("s2", "m").alias("q2")))
    out = materialise(members.join(names, region).groupBy("q1", "q2", "nid").agg(F.min("e").alias("e")).withColumnsRenamed({"q1": "r1", "q2": "r2"}))
    discard(names)
    return out


def _distances(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows (a, b, d) with the exact distance of each pair of node ids."""
    arrays = nodes.select(F.col("nid"), "arr")
    # The list of pairs goes to where the first arrays lie; only pairs with an array are shuffled to meet the second ones.
    joined = few(pairs).join(arrays.select(F.col("nid").alias("a"), F.col("arr").alias("x")), "a").join(arrays.select(F.col("nid").alias("b"), F.col("arr").alias("y")), "b")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("d", pa.float64()), ("linked", pa.bool_())])

    def run(batches):
        for t in batches:
            x, y = t.column(2), t.column(3)
            ds, ok = [], []
            for i in range(t.num_rows):
                p, q = x[i].values.to_numpy(), y[i].values.to_numpy()
                if len(p) > len(q):
                    p, q = q, p
                at = np.searchsorted(q, p)
                common = int((q[np.minimum(at, len(q) - 1)] == p).sum())
                union = len(p) + len(q) - common
                ds.append(1 - common / union)
                ok.append(100 * common >= 80 * union)
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), pa.array(ds, pa.float64()), pa.array(ok)], schema=schema)

    return joined.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint, d double, linked boolean")


def _pairs(a, b):
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def _near(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of rows (r1, r2, nid, comp, e, n, sketch, m) of a region that may link and are in different components.

    A region is cut into blocks of about BLOCK members, and a task compares two blocks: no pair is a row before it has
    passed the tests of size, place and sketch, all of which every link passes.
    """
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("nid", F.lit(3)), blocks).cast("int")
    d = members.select("r1", "r2", "nid", "comp", "e", "n", "sketch", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    d = d.select("r1", "r2", F.least("own", "other").alias("k1"), F.greatest("own", "other").alias("k2"), "own", "nid", "comp", "e", "n", "sketch")
    keys = ["r1", "r2", "k1", "k2"]

    def run(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got).combine_chunks()
        r1, r2, k1, k2, own, nid, comp, e, n = (t.column(i).to_numpy() for i in range(9))
        raw = t.column(9).chunk(0)
        sketch = np.frombuffer(raw.buffers()[2], np.uint8, count=256 * t.num_rows, offset=256 * raw.offset).reshape(-1, 256)
        new = (r1[1:] != r1[:-1]) | (r2[1:] != r2[:-1]) | (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
        starts = np.concatenate([[0], np.flatnonzero(new) + 1, [t.num_rows]])
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            firsts, seconds = [], []
            for i in range(a, b - 1):
                j = np.arange(i + 1, b)
                total = n[j] + n[i]
                ok = (comp[j] != comp[i]) & (e[j] + e[i] <= 0) & (5 * np.minimum(n[j], n[i]) >= 4 * np.maximum(n[j], n[i]))
                if k1[a] != k2[a]:
                    ok &= own[j] != own[i]
                j = j[ok]
                apart = np.abs(sketch[j].astype(np.int16) - sketch[i]).sum(axis=1)
                j = j[9 * apart <= total[ok]]
                firsts.append(np.minimum(nid[j], nid[i]))
                seconds.append(np.maximum(nid[j], nid[i]))
            if firsts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (firsts, seconds)], names=["a", "b"])

    return d.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a bigint, b bigint")


class Group:
    """The sets of a cluster, joined by recursion over pivots; `of` gives each member's component so far."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets, self.size = sets, np.array([len(x) for x in sets])
        self.of = np.arange(len(sets))
        self.rounds = 0

    def distances(self, p: int, members: np.ndarray) -> np.ndarray:
        """d(p, x) of each member x; those that link to p join its component."""
        flat, size = np.concatenate([self.sets[i] for i in members]), self.size[members]
        own = self.sets[p]
        hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
        common = np.add.reduceat(hit.astype(np.int64), np.cumsum(size) - size)
        union = size + len(own) - common
        for c in np.unique(self.of[members[100 * common >= 80 * union]]).tolist():
            if c != self.of[p]:
                self.of[self.of == c] = self.of[p]
        return 1 - common / union

    def settled(self, members: np.ndarray) -> bool:
        return len(members) < 2 or bool((self.of[members] == self.of[members[0]]).all())

    def join(self, members: np.ndarray) -> None:
        """Connect all members whose links connect them."""
        todo = [members]
        while todo:
            members = todo.pop()
            if self.settled(members):
                continue
            self.rounds += 1
            pivots, d = [], np.empty((0, len(members)))
            while len(pivots) < min(PIVOTS, len(members) - 1):
                # The next pivot is the member farthest from those before it.
                i = int(d.min(axis=0).argmax()) if pivots else 0
                pivots.append(i)
                d = np.vstack([d, self.distances(int(members[i]), members)])
            rest = np.delete(np.arange(len(members)), pivots)
            linked = d[:, rest] <= TAU + EPS
            # The nearest member that does not link to a pivot: nothing nearer by more than TAU has a partner outside its links.
            outer = np.where(linked, 9.0, d[:, rest]).min(axis=1, initial=9.0)
            done = ((d[:, rest] <= TAU - EPS) & (outer[:, None] - TAU - EPS > d[:, rest])).any(axis=0)
            rest = rest[~done]
            if not len(rest):
                continue
            near = np.sort(d[:, rest], axis=0)
            home = d[:, rest].argmin(axis=0)
            inner = (near[1] - near[0] > 2 * TAU + EPS) if len(pivots) > 1 else np.ones(len(rest), bool)
            parts = [rest[~inner]]
            for k in range(len(pivots)):
                own = rest[inner & (home == k)]
                edge = rest[~inner]
                if len(own):
                    parts.append(np.concatenate([own, edge[d[k, edge] <= d[k, own].max() + TAU + EPS]]))
            # A round costs what it costs to compare PIVOTS members with all; it has to take out as many besides the pivots.
            if max(map(len, parts)) > len(members) - 2 * PIVOTS:
                self.compare(members[rest], d[:, rest])
            else:
                todo += [members[x] for x in parts]

    def compare(self, members: np.ndarray, d: np.ndarray) -> None:
        """The pairs of different components within TAU of each other in distance to every pivot, and in size."""
        n = self.size[members]
        for i in range(len(members) - 1):
            j = np.arange(i + 1, len(members))
            ok = (self.of[members[j]] != self.of[members[i]]) & (5 * np.minimum(n[j], n[i]) >= 4 * np.maximum(n[j], n[i]))
            j = j[ok]
            j = j[(np.abs(d[:, j] - d[:, [i]]) <= TAU + EPS).all(axis=0)]
            if len(j):
                self.distances(int(members[i]), members[j])


def _joined(grouped: DataFrame) -> DataFrame:
    """Links (a, b), enough to connect each component, of rows (root, nid, arr): every root's sets as a Group."""

    def run(batches):
        now, ids, sets = None, [], []

        def links():
            g = Group(sets)
            g.join(np.arange(len(sets)))
            first, at = np.unique(g.of, return_index=True)
            head = np.array(ids, np.int64)[at][np.searchsorted(first, g.of)]
            own = np.array(ids, np.int64)
            apart = own != head
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(own, head)[apart]), pa.array(np.maximum(own, head)[apart])], names=["a", "b"])

        for b in batches:
            for root, nid, arr in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if root != now:
                    if sets:
                        yield links()
                    now, ids, sets = root, [], []
                ids.append(nid)
                sets.append(arr.values.to_numpy())
        if sets:
            yield links()

    return grouped.select("root", "nid", "arr").repartition("root").sortWithinPartitions("root", "nid").mapInArrow(run, "a bigint, b bigint")


def links(nodes: DataFrame, regions: DataFrame) -> DataFrame:
    """Linked pairs (a, b) of node ids that connect all that the full set of links connects."""
    heads = materialise(regions.groupBy("r1", "r2").agg(F.min("nid").alias("b")))
    star = materialise(regions.join(few(heads), ["r1", "r2"]).select(F.col("nid").alias("a"), "b").distinct())
    cluster = materialise(components(star).withColumnRenamed("node", "nid"))
    sizes = materialise(cluster.join(nodes.select("nid", "n"), "nid").groupBy("root").agg(F.count("*").alias("m"), F.sum("n").alias("shingles")))
    small = (F.col("shingles") <= TASK_SHINGLES) & (F.col("m") * F.col("shingles") <= TASK_WORK)
    cluster = materialise(cluster.join(sizes.select("root", small.alias("small")), "root"))
    near = materialise(_joined(nodes.select("nid", "arr").join(few(cluster.where("small").select("nid", "root")), "nid")))
    far = materialise(regions.join(cluster.where("not small").select("nid"), "nid", "left_semi"))
    discard(heads, star, sizes, cluster)
    out = materialise(near.unionByName(_links_by_rounds(nodes, far)))
    discard(near, far)
    return out


def _links_by_rounds(nodes: DataFrame, regions: DataFrame) -> DataFrame:
    """links() of written regions, in rounds of jobs."""
    if regions.isEmpty():
        return nodes.sparkSession.createDataFrame([], "a bigint, b bigint")
    spark = nodes.sparkSession
    nodes = materialise(nodes.select("nid", "n", "arr", "sketch").join(few(materialise(regions.select("nid").distinct())), "nid", "left_semi"))
    sizes = nodes.select("nid", "n", "sketch")
    known = materialise(spark.createDataFrame([], "a bigint, b bigint, d double, linked boolean"))
    most = float("inf")
    depth, region = 0, ["r1", "r2"]
    while not regions.isEmpty():
        # What is known to be connected needs no comparing: a region goes on only with members of several labels.
        members = regions.withColumn("comp", F.col("nid"))
        if depth:
            linked = labels(known.where("linked").select("a", "b")).withColumnRenamed("node", "nid")
            members = materialise(regions.join(linked, "nid", "left").select(*region, "nid", "e", F.coalesce("label", "nid").alias("comp")))
        # A region is large while pivots divide it; after that, blocks do.
        size = members.groupBy(*region).agg(F.count("*").alias("m"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
        size = materialise(size.select(*region, "m", ((F.col("m") > LEAF) & (F.col("m") <= F.lit(most))).alias("large")))
        most = SHRINK * (size.where("large").agg(F.max("m")).first()[0] or 0)
        members = members.join(size, region)
        large = members.where("large")
        seeds = [F.min(F.struct(F.xxhash64("nid", F.lit(10 + i)), "nid"))["nid"].alias(f"p{i}") for i in range(PIVOTS)]
        heads = materialise(large.groupBy(*region).agg(*seeds).select(*region, F.array_distinct(F.array(*(f"p{i}" for i in range(PIVOTS)))).alias("pivots")))
        asked, star = _near(members.where("not large").join(sizes, "nid")), None
        if not heads.isEmpty():
            star = materialise(large.select(*region, "nid", "e").join(heads, region).select(*region, "nid", "e", F.explode("pivots").alias("pivot")))
            asked = asked.unionByName(star.where("nid <> pivot").select(*_pairs(F.col("nid"), F.col("pivot"))))
        asked = asked.distinct()
        fresh = materialise(asked.join(known.select("a", "b"), ["a", "b"], "left_anti") if depth else asked)
        before, known = known, materialise(known.unionByName(_distances(fresh, nodes)))
        discard(before, fresh, heads, size)
        if star is None:
            break
        regions, depth = _split(star, known), depth + 1
    out = materialise(known.where("linked").select("a", "b"))
    discard(nodes, known)
    return out


def _split(star: DataFrame, known: DataFrame) -> DataFrame:
    """The next round's regions of rows (r1, r2, nid, pivot) and the distances known."""
    region = ["r1", "r2"]
    a, b = _pairs(F.col("nid"), F.col("pivot"))
    rows = star.withColumn("a", a).withColumn("b", b).join(known, ["a", "b"], "left").withColumn("d", F.coalesce("d", F.lit(0.0)))
    rows = materialise(rows.select(*region, "nid", "e", "pivot", "d"))
    mine = rows.groupBy(*region, "nid").agg(F.min("e").alias("e"), F.array_sort(F.collect_list(F.struct("d", "pivot"))).alias("ds"))
    mine = materialise(mine.withColumn("is_pivot", F.exists("ds", lambda x: x["pivot"] == F.col("nid"))).where("not is_pivot").drop("is_pivot"))
    per = mine.select(*region, "nid", F.explode("ds").alias("x")).select(*region, "nid", F.col("x.d").alias("d"), F.col("x.pivot").alias("pivot"))
    # The nearest member that does not link to the pivot: nothing nearer by more than TAU has a partner outside its links.
    outer = per.where(F.col("d") > TAU + EPS).groupBy(*region, "pivot").agg(F.min("d").alias("outer"))
    done = per.where(F.col("d") <= TAU - EPS).join(outer, [*region, "pivot"], "left").where(F.coalesce("outer", F.lit(9.0)) - TAU - EPS > F.col("d"))
    open_ = materialise(mine.join(done.select(*region, "nid").distinct(), [*region, "nid"], "left_anti"))
    home, second = F.col("ds")[0], F.get("ds", F.lit(1))
    inner = F.coalesce(second["d"], F.lit(9.0)) - home["d"] > 2 * TAU + EPS
    left = open_.withColumn("inner", inner).withColumn("home", F.col("ds")[0]["pivot"])
    reach = left.where("inner").groupBy(*region, F.col("home").alias("pivot")).agg(F.max(F.col("ds")[0]["d"]).alias("reach"))
    cells = left.where("inner").select(*region, F.col("home").alias("cell"), "nid", "e")
    edge = left.where("not inner").select(*region, "nid", "e", F.explode("ds").alias("x")).select(*region, "nid", "e", F.col("x.d").alias("d"), F.col("x.pivot").alias("pivot"))
    windows = edge.join(reach, [*region, "pivot"]).where(F.col("d") <= F.col("reach") + TAU + EPS).select(*region, F.col("pivot").alias("cell"), "nid", "e")
    rest = left.where("not inner").select(*region, F.lit(-1).cast("long").alias("cell"), "nid", "e")
    parts = materialise(cells.unionByName(windows).unionByName(rest))
    out = _once(parts, [*region, "cell"])
    discard(rows, mine, open_, parts)
    return out


def join(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id) of every row of docs (doc_id, text).

    component_id is the smallest doc_id that links reach, the row's own included. A text without words is linked with
    nothing. Rows with equal sets link; a null doc_id takes part but is never smallest unless alone (then null).
    """
    reach_package(docs.sparkSession)
    sets = materialise(_sets(docs))
    alive = materialise(_survivors(sets))
    members = materialise(sets.where("sig is not null").select("doc_id", "n", "sig"))
    discard(sets)
    nodes = materialise(_arrays(docs, alive))
    discard(alive)
    regions = _regions(nodes)
    found = links(nodes, regions)
    discard(regions)
    roots = materialise(components(found))
    least = materialise(members.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("own"), F.count("*").alias("copies")))
    tied = nodes.select("sig", F.col("nid").alias("node")).join(roots, "node").join(least, "sig")
    of = tied.groupBy("root").agg(F.min("own").alias("component_id"))
    comps = tied.select("sig", "root").distinct().join(of, "root").select("sig", "component_id")
    # Sets of one row and without links need no telling; the list is small against the documents.
    told = least.join(comps, "sig", "left").where("copies > 1 or component_id is not null")
    every = materialise(told.select("sig", F.coalesce("component_id", "own").alias("component_id"), F.lit(True).alias("told")))
    discard(nodes, found, roots, least)
    out = members.join(few(every), "sig", "left")
    root = F.when(F.col("told"), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), root.alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whose doc_id is its component's smallest for one of its rows; a null doc_id stays."""
    found = materialise(join(docs).where("doc_id is not null").select("doc_id", (F.col("doc_id") == F.col("component_id")).alias("stays")))
    gone = materialise(found.groupBy("doc_id").agg(F.bool_or("stays").alias("stays")).where("not stays").select("doc_id"))
    return docs.join(few(gone), "doc_id", "left_anti").select(*docs.columns)
