"""Queries on variable fonts: axis maps, region and tuple weights, index maps, inferred deltas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.numbers import half_up, half_up_sql
from tessera.plans import fixtures as X
from tessera.plans.registry import query

ONE = 1 << 14  # 1.0 in 2.14 fixed point


def byte_of(i: int) -> str:
    return f"greatest(0, least(255, floor(CAST(embedding[{i + 1}] AS DOUBLE) * 512 + 128 + 0.5)))"


def kept_points(points: Column) -> Column:
    """The points (f, t) of an axis map whose f is above all before it; none unless -1, 0 and 1 are mapped to themselves."""
    rising = F.aggregate(points, F.slice(points, 1, 0), lambda acc, p: F.when((F.size(acc) == 0) | (p["f"] > F.element_at(acc, -1)["f"]), F.concat(acc, F.array(p))).otherwise(acc))
    fixed = lambda v: F.exists(rising, lambda p: (p["f"] == v) & (p["t"] == v))
    return F.when(fixed(-ONE) & fixed(0) & fixed(ONE), rising).otherwise(F.slice(points, 1, 0))


_POINTS = f"(0, -{ONE}, -{ONE}), (1, -64 * s0, -60 * s1), (2, 0, CASE WHEN vec_id % 5 = 0 THEN 7 ELSE 0 END), (3, 64 * s2, 60 * s3), (4, 64 * (s4 - 128), 50 * s5), (5, CASE WHEN vec_id % 3 = 0 THEN 16000 ELSE {ONE} END, {ONE})"


@query(
    "axis_map",
    f"WITH e AS (SELECT vec_id, {', '.join(f'CAST({byte_of(i)} AS BIGINT) AS s{i}' for i in range(6))} FROM embeddings), p AS (SELECT vec_id, unnest([{', '.join(f'{{{chr(39)}k{chr(39)}: {a}, {chr(39)}f{chr(39)}: {b}, {chr(39)}t{chr(39)}: {c}}}' for a, b, c in (x.split(', ', 2) for x in _POINTS[1:-1].split('), (')))}]) AS q FROM e), "
    f"r AS (SELECT vec_id, q.k AS k, q.f AS f, q.t AS t, max(q.f) OVER (PARTITION BY vec_id ORDER BY q.k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM p), m AS (SELECT vec_id, string_agg(f || ':' || t, ' ' ORDER BY k) AS map, bool_or(f = -{ONE} AND t = -{ONE}) AND bool_or(f = 0 AND t = 0) AND bool_or(f = {ONE} AND t = {ONE}) AS whole FROM r WHERE top IS NULL OR f > top GROUP BY vec_id) SELECT vec_id AS image_id, CASE WHEN whole THEN map ELSE '' END AS map FROM m",
)
def axis_map(spark, sf):
    """Each axis's map with its points out of order left out; a map without its fixed points bends nothing."""
    s = [X.sample(F.get("embedding", i)) for i in range(6)]
    v = F.col("vec_id")
    long = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("long")
    points = [(-ONE, -ONE), (-64 * s[0], -60 * s[1]), (0, F.when(v % 5 == 0, 7).otherwise(0)), (64 * s[2], 60 * s[3]), (64 * (s[4] - 128), 50 * s[5]), (F.when(v % 3 == 0, 16000).otherwise(ONE), ONE)]
    d = X.table(spark, sf, "embeddings").select(v.alias("image_id"), F.array(*(F.struct(long(f).alias("f"), long(t).alias("t")) for f, t in points)).alias("p"))
    return d.select("image_id", F.array_join(F.transform(kept_points(F.col("p")), lambda p: F.concat_ws(":", p["f"], p["t"])), " ").alias("map"))


def tuple_weight(peak: list[Column], at: list[Column], spans: list[tuple[Column, Column]], between: Column) -> Column:
    """The product over axes of a tuple's tents: from 0 to the peak, or over its own span where `between` says so.

    An axis with its peak at 0 has no say, nor has one whose span isn't in order or goes across 0.
    """
    out = F.lit(1.0)
    for p, v, (a, b) in zip(peak, at, spans, strict=True):
        skip = (p == 0) | (v == p) | (between & ((a > p) | (p > b) | ((a < 0) & (b > 0))))
        plain = F.when((v < F.least(F.lit(0.0), p)) | (v > F.greatest(F.lit(0.0), p)), 0.0).otherwise(v / p)
        span = F.when((v <= a) | (v >= b), 0.0).when(v < p, (v - a) / (p - a)).otherwise((b - v) / (b - p))
        out = out * F.when(skip, 1.0).when(v == 0, 0.0).when(between, span).otherwise(plain)
    return out


def _quarter_sql(i: int) -> str:
    return f"(floor(({byte_of(i)} - 128) / 16.0::DOUBLE) / 4)"


def _weight_sql(k: int) -> str:
    p, v = _quarter_sql(k), _quarter_sql(k + 3)
    a, b, mid = f"({p} - 0.5)", f"({p} + 0.75)", "vec_id % 2 = 0"
    return f"CASE WHEN {p} = 0 OR {v} = {p} OR ({mid} AND {a} < 0 AND {b} > 0) THEN 1 WHEN {v} = 0 THEN 0 WHEN {mid} THEN CASE WHEN {v} <= {a} OR {v} >= {b} THEN 0 WHEN {v} < {p} THEN ({v} - {a}) / 0.5 ELSE ({b} - {v}) / 0.75 END WHEN {v} < least(0, {p}) OR {v} > greatest(0, {p}) THEN 0 ELSE {v} / {p} END"


@query("tuple_scalar", f"SELECT vec_id AS image_id, {half_up_sql(' * '.join(f'({_weight_sql(k)})' for k in range(3)), 6)} AS scalar FROM embeddings")
def tuple_scalar(spark, sf):
    quarter = [F.floor((X.sample(F.get("embedding", i)) - 128) / 16.0) / 4 for i in range(6)]
    peak, at = quarter[:3], quarter[3:]
    w = tuple_weight(peak, at, [(p - 0.5, p + 0.75) for p in peak], F.col("vec_id") % 2 == 0)
    return X.table(spark, sf, "embeddings").select(F.col("vec_id").alias("image_id"), half_up(w, 6).alias("scalar"))


def _tent_sql(i: str) -> str:
    p, v = f"((({i} * 5) % 9 - 4) / 4.0::DOUBLE)", "0.375::DOUBLE"
    return f"CASE WHEN {p} = 0 THEN 1 WHEN {v} = {p} THEN 1 WHEN {v} <= {p} - 1 OR {v} >= {p} + 1 OR ({p} - 1 < 0 AND {p} + 1 > 0) THEN CASE WHEN {p} - 1 < 0 AND {p} + 1 > 0 THEN 1 ELSE 0 END WHEN {v} < {p} THEN {v} - ({p} - 1) ELSE {p} + 1 - {v} END"


@query("store_scalars", f"WITH e AS (SELECT vec_id, unnest(range(0, 4)) AS k, embedding FROM embeddings), r AS (SELECT vec_id, k, CAST(greatest(0, least(255, floor(CAST(embedding[k + 1] AS DOUBLE) * 512 + 128 + 0.5))) AS BIGINT) % 16 AS region FROM e) SELECT vec_id AS image_id, string_agg(printf('%.4f', {half_up_sql(_tent_sql('region'), 4)}), ' ' ORDER BY k) AS scalars FROM r GROUP BY vec_id")
def store_scalars(spark, sf, at: float = 0.375):
    """The weights of each data's regions. A region is weighed once: the 16 of the store are a constant of the plan."""
    weights = []
    for i in range(16):
        p = (i * 5 % 9 - 4) / 4
        low, high = p - 1, p + 1
        flat = p == 0 or low < 0 < high or at == p
        weights.append(1.0 if flat else 0.0 if not low < at < high else at - low if at < p else high - at)
    w = F.array(*map(F.lit, weights))
    four = F.transform(F.slice("embedding", 1, 4), lambda e: F.format_string("%.4f", half_up(F.get(w, (X.sample(e) % 16).cast("int")), 4)))
    return X.table(spark, sf, "embeddings").select(F.col("vec_id").alias("image_id"), F.array_join(four, " ").alias("scalars"))


@query(
    "delta_index_map",
    "WITH e AS (SELECT vec_id, [" + ", ".join(f"CAST({byte_of(i)} AS BIGINT)" for i in range(64)) + "] AS d FROM embeddings), h AS (SELECT vec_id, d, d[1] & 15 AS bits, ((d[1] & 48) >> 4) + 1 AS size, vec_id % 7 AS n, unnest(range(0, 9)) AS g FROM e), "
    "v AS (SELECT *, CASE WHEN n = 0 THEN NULL ELSE list_sum(list_transform(range(0, size), lambda k: d[4 + least(g, n - 1) * size + k + 1] * CAST(pow(256, size - 1 - k) AS BIGINT))) END AS v FROM h) SELECT vec_id AS image_id, g, CASE WHEN n = 0 THEN 0 ELSE v // CAST(pow(2, bits + 1) AS BIGINT) END AS o, CASE WHEN n = 0 THEN g ELSE v % CAST(pow(2, bits + 1) AS BIGINT) END AS i FROM v",
)
def delta_index_map(spark, sf):
    """Outer and inner index of each glyph from packed entries, whose width and split the first byte says; beyond the last entry the last holds."""
    d = X.packed(spark, sf).select("image_id", "data", F.get("data", 0).alias("format"), (F.col("image_id") % 7).alias("n"))
    d = d.select("image_id", "data", "n", F.shiftleft(F.lit(2).cast("long"), 0).alias("two"), (F.col("format").bitwiseAND(F.lit(15)) + 1).cast("int").alias("bits"), (F.shiftright(F.col("format").bitwiseAND(F.lit(48)), 4) + 1).cast("int").alias("size"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(8).cast("long"))).alias("g"))
    entry = F.slice("data", (F.least("g", F.col("n") - 1) * F.col("size") + 5).cast("int"), F.col("size"))
    d = d.select("image_id", "g", "n", "bits", F.when(F.col("n") > 0, F.aggregate(entry, F.lit(0).cast("long"), lambda acc, b: acc * 256 + b)).alias("v"))
    span = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bits"))
    none = F.col("n") == 0
    return d.select("image_id", "g", F.when(none, 0).otherwise(F.floor(F.col("v") / span)).alias("o"), F.when(none, F.col("g")).otherwise(F.col("v") % span).alias("i"))


def _between_sql(p: str) -> str:
    return f"CASE WHEN a.c = b.c THEN CASE WHEN a.d = b.d THEN a.d ELSE 0 END WHEN {p}.c <= least(a.c, b.c) THEN CASE WHEN a.c < b.c THEN a.d ELSE b.d END WHEN {p}.c >= greatest(a.c, b.c) THEN CASE WHEN a.c > b.c THEN a.d ELSE b.d END ELSE a.d + ({p}.c - a.c) * (b.d - a.d) / (b.c - a.c) END"


@query(
    "inferred_deltas",
    "WITH p AS (SELECT vec_id, k, k // 4 AS contour, greatest(0, least(255, floor(CAST(embedding[k + 1] AS DOUBLE) * 512 + 128 + 0.5))) AS c, greatest(0, least(255, floor(CAST(embedding[k + 9] AS DOUBLE) * 512 + 128 + 0.5))) AS d, greatest(0, least(255, floor(CAST(embedding[k + 17] AS DOUBLE) * 512 + 128 + 0.5))) >= 128 AS named FROM embeddings, (SELECT unnest(range(0, 8)) AS k)), "
    "w AS (SELECT p.vec_id, p.k, p.contour, p.c, arg_min(q.k, (p.k - q.k + 4) % 4) AS ka, arg_min(q.k, (q.k - p.k + 4) % 4) AS kb FROM p JOIN p q ON p.vec_id = q.vec_id AND p.contour = q.contour AND q.named WHERE NOT p.named GROUP BY p.vec_id, p.k, p.contour, p.c), "
    f"f AS (SELECT w.vec_id, w.k, {_between_sql('w')} AS d FROM w JOIN p a ON a.vec_id = w.vec_id AND a.k = w.ka JOIN p b ON b.vec_id = w.vec_id AND b.k = w.kb) SELECT p.vec_id AS image_id, p.k AS point, {half_up_sql('CASE WHEN p.named THEN p.d ELSE coalesce(f.d, 0) END', 4)} AS delta FROM p LEFT JOIN f ON f.vec_id = p.vec_id AND f.k = p.k",
)
def inferred_deltas(spark, sf):
    """Deltas of the points that a tuple doesn't name: between the named ones before and after on the contour, else the nearer one's."""
    d = X.packed(spark, sf)

    def point(k):
        return F.struct((k % 4).alias("at"), F.get("data", k).alias("c"), F.get("data", k + 8).alias("d"), (F.get("data", k + 16) >= 128).alias("named"))

    d = d.select("image_id", F.explode(F.array(F.lit(0), F.lit(4))).alias("first"), "data")
    d = d.select("image_id", "first", F.transform(F.sequence(F.col("first"), F.col("first") + 3), point).alias("ps"))

    def nearest(p, back):
        gap = lambda q: ((p["at"] - q["at"]) if back else (q["at"] - p["at"])) + 4
        return F.array_min(F.transform(F.filter("ps", lambda q: q["named"]), lambda q: F.struct((gap(q) % 4).alias("gap"), q["c"].alias("c"), q["d"].alias("d"))))

    def told(p):
        a, b = nearest(p, True), nearest(p, False)
        low, high = F.least(F.struct(a["c"], a["d"]), F.struct(b["c"], b["d"])), F.greatest(F.struct(a["c"], a["d"]), F.struct(b["c"], b["d"]))
        low_c, low_d, high_c, high_d = (x.getField(f).cast("double") for x in (low, high) for f in ("c", "d"))
        inner = F.when(low_c == high_c, F.when(low_d == high_d, low_d).otherwise(0.0)).when(p["c"] <= low_c, low_d).when(p["c"] >= high_c, high_d).otherwise(low_d + (p["c"] - low_c) * (high_d - low_d) / (high_c - low_c))
        return F.when(p["named"], p["d"].cast("double")).otherwise(F.coalesce(inner, F.lit(0.0)))

    out = d.select("image_id", "first", F.posexplode(F.transform("ps", told)).alias("i", "v"))
    return out.select("image_id", (F.col("first") + F.col("i")).cast("long").alias("point"), half_up(F.col("v"), 4).alias("delta"))
