"""Queries on the usage ledger: rollups, prices in force on a day, budgets and plans."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import prices as P
from tessera.functions.numbers import half_up, half_up_sql, strict_sum
from tessera.plans import fixtures as X
from tessera.plans.registry import query


@query(
    "ledger_rollup",
    f"""WITH {X.LEDGER}, r AS (SELECT run, count(*) AS calls, count(*) FILTER (ok) AS images, count(*) FILTER (op = 'signup') AS judge, {half_up_sql('coalesce(sum(cost), 0)', 4)} AS cost, bool_or(cost IS NULL) AS unknown, min(ts) AS first, max(ts) AS last FROM led GROUP BY run),
    t AS (SELECT NULL AS run, count(*) AS calls, count(*) FILTER (ok) AS images, count(*) FILTER (op = 'signup') AS judge, {half_up_sql('coalesce(sum(cost), 0)', 4)} AS cost, bool_or(cost IS NULL) AS unknown, min(ts) AS first, max(ts) AS last FROM led) SELECT * FROM r UNION ALL SELECT * FROM t""",
)
def ledger_rollup(spark, sf):
    """Per run and, in the row without a run, in all."""
    led = X.ledger(spark, sf)
    return led.rollup("run").agg(
        F.count("*").alias("calls"), F.count_if("ok").alias("images"), F.count_if(F.col("op") == "signup").alias("judge"), half_up(F.coalesce(F.sum("cost"), F.lit(0.0)), 4).alias("cost"),
        F.bool_or(F.col("cost").isNull()).alias("unknown"), F.min("ts").alias("first"), F.max("ts").alias("last"),
    )


@query("null_strict_total", f"WITH {X.LEDGER} SELECT run, op, count(*) AS calls, {half_up_sql('CASE WHEN count(cost) = count(*) THEN sum(cost) END', 4)} AS cost FROM led GROUP BY run, op")
def null_strict_total(spark, sf):
    """A total is unknown as soon as one call is unpriced."""
    return X.ledger(spark, sf).groupBy("run", "op").agg(F.count("*").alias("calls"), half_up(strict_sum(F.col("cost")), 4).alias("cost"))


_MODEL = "CASE id % 5 WHEN 0 THEN 'models/gemini-3.8-flash-001' WHEN 1 THEN 'gemini-3.5-flash-lite' WHEN 2 THEN 'gemini-3.5-flash-preview' WHEN 3 THEN 'other-model' ELSE 'gemini-3-pro-image' END"
_DAY = "strftime(ts + INTERVAL (id % 2000) DAY, '%Y-%m-%d')"
_FIT = f"""c AS (SELECT id, regexp_replace({_MODEL}, '^models/', '') AS model, {_DAY} AS day FROM led),
    f AS (SELECT c.id, day, r.*, length(r.model) = max(length(r.model)) OVER (PARTITION BY c.id) AS longest FROM c JOIN rate r ON c.model = r.model OR starts_with(c.model, r.model || '-')),
    p AS (SELECT id, coalesce(arg_max(model, since) FILTER (since <= day), arg_min(model, since)) AS key, coalesce(arg_max(input, since) FILTER (since <= day), arg_min(input, since)) AS input,
          coalesce(arg_max(output, since) FILTER (since <= day), arg_min(output, since)) AS output, coalesce(arg_max(cached, since) FILTER (since <= day), arg_min(cached, since)) AS cached FROM f WHERE longest GROUP BY id)"""


def _calls(spark, sf):
    led = X.ledger(spark, sf)
    i = F.col("id") % 5
    model = F.when(i == 0, "models/gemini-3.8-flash-001").when(i == 1, "gemini-3.5-flash-lite").when(i == 2, "gemini-3.5-flash-preview").when(i == 3, "other-model").otherwise("gemini-3-pro-image")
    day = F.date_format(F.date_add(F.to_date("ts"), (F.col("id") % 2000).cast("int")), "yyyy-MM-dd")
    calls = led.select("id", model.alias("model"), day.alias("day"))
    # A price is looked up once for each model and day.
    prices = calls.select("model", "day").distinct().withColumn("p", P.price(F.col("model"), F.col("day")))
    return calls.join(prices, ["model", "day"], "left").select("id", "p")


@query("price_asof", f"WITH {X.LEDGER}, {P.rates_sql()}, {_FIT} SELECT led.id, p.key, p.input, p.output, p.cached FROM led LEFT JOIN p USING (id)")
def price_asof(spark, sf):
    return _calls(spark, sf).select("id", F.col("p.model").alias("key"), "p.input", "p.output", "p.cached")


@query(
    "text_call_cost",
    f"""WITH {X.LEDGER}, {P.rates_sql()}, {_FIT} SELECT led.id, {half_up_sql("greatest(0, 100 + id % 900 - id % 300) / 1e6::DOUBLE * input + (id % 300) / 1e6::DOUBLE * coalesce(cached, input) + (50 + id % 70 + id % 40) / 1e6::DOUBLE * output", 6)} AS cost FROM led LEFT JOIN p USING (id)""",
)
def text_call_cost(spark, sf):
    i = F.col("id")
    return _calls(spark, sf).select("id", P.text_cost(F.col("p"), 100 + i % 900, i % 300, 50 + i % 70, i % 40).alias("cost"))


@query(
    "image_call_cost",
    f"WITH {X.LEDGER} SELECT id, {half_up_sql('(42 + id % 50) / 1e6::DOUBLE * 1.5 + 1120 / 1e6::DOUBLE * 30 + (greatest(0, 1120 + id % 300 - 1120) + id % 900) / 1e6::DOUBLE * 7.5', 6)} AS cost FROM led",
)
def image_call_cost(spark, sf):
    i = F.col("id")
    p = F.get(P.as_struct(), F.lit(0))
    return X.ledger(spark, sf).select("id", P.image_cost(p, 42 + i % 50, 1120 + i % 300, F.lit(1120), i % 900).alias("cost"))


@query(
    "batch_cost",
    "WITH v(size, per) AS (VALUES ('1K', 0.0336::DOUBLE), ('2K', 0.0504::DOUBLE), ('4K', 0.113::DOUBLE), ('8K', NULL)), n AS (SELECT unnest(range(1, 51)) AS images) SELECT images, size, " + half_up_sql("images * (per + 900 / 1e6::DOUBLE * 7.5)", 4) + " AS cost FROM n, v",
)
def batch_cost(spark, sf):
    """Null, not zero, for a size without a price."""
    some = F.create_map(*(F.lit(v) for m, s, p in P.PER_IMAGE if m == "gemini-nano-banana-2.1" for v in (s, p)))
    n = spark.range(1, 51).select(F.col("id").alias("images"), F.explode(F.array(*map(F.lit, ("1K", "2K", "4K", "8K")))).alias("size"))
    return n.select("images", "size", half_up(F.col("images") * (F.try_element_at(some, F.col("size")) + 900 / 1e6 * 7.5), 4).alias("cost"))


@query(
    "budget_breach",
    f"""WITH {X.LEDGER}, s AS (SELECT run, id, ts, sum(coalesce(cost, 0)) OVER (PARTITION BY run ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS spent FROM led)
    SELECT run, count(*) AS calls, count(*) FILTER (spent <= 500 + 1e-9) AS allowed, min(id) FILTER (spent > 500 + 1e-9) AS first_refused FROM s GROUP BY run""",
)
def budget_breach(spark, sf, budget: float = 500.0):
    """Calls of a run, in time order, until what is spent would pass the budget."""
    w = Window.partitionBy("run").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    s = X.ledger(spark, sf).select("run", "id", F.sum(F.coalesce("cost", F.lit(0.0))).over(w).alias("spent"))
    over = F.col("spent") > budget + 1e-9
    return s.groupBy("run").agg(F.count("*").alias("calls"), F.count_if(~over).alias("allowed"), F.min(F.when(over, F.col("id"))).alias("first_refused"))


@query("sprite_counts", f"WITH {X.FRAMES}, a AS (SELECT action, count(*) AS frames FROM frm GROUP BY action) SELECT action, frames, greatest(1, CAST(ceil(frames / 8.0::DOUBLE) AS BIGINT)) AS best, greatest(1, CAST(ceil(frames / 8.0::DOUBLE) AS BIGINT)) * 3 + frames * 2 AS worst FROM a")
def sprite_counts(spark, sf, strip: int = 8, retries: int = 2, frame_retries: int = 1, repairs: int = 1):
    a = X.packed(spark, sf).groupBy("action").agg(F.count("*").alias("frames"))
    best = F.greatest(F.lit(1), F.ceil(F.col("frames") / strip))
    return a.select("action", "frames", best.alias("best"), (best * (1 + retries) + F.col("frames") * (frame_retries + repairs)).alias("worst"))


@query("strip_parts", f"WITH {X.FRAMES}, a AS (SELECT action, count(*) AS n, CAST(ceil(count(*) / 8.0::DOUBLE) AS BIGINT) AS k FROM frm GROUP BY action), p AS (SELECT action, n, k, unnest(range(0, k)) AS part FROM a) SELECT action, part, part * (n // k) + least(part, n % k) AS first, part * (n // k) + least(part, n % k) + n // k + CASE WHEN part < n % k THEN 1 ELSE 0 END - 1 AS last, n // k + CASE WHEN part < n % k THEN 1 ELSE 0 END AS frames FROM p")
def strip_parts(spark, sf, size: int = 8):
    """Balanced strips, the longer ones first."""
    a = X.packed(spark, sf).groupBy("action").agg(F.count("*").alias("n")).withColumn("k", F.ceil(F.col("n") / size))
    p = a.select("action", "n", "k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("part"))
    base, extra = F.floor(F.col("n") / F.col("k")), F.col("n") % F.col("k")
    first = F.col("part") * base + F.least(F.col("part"), extra)
    n = base + (F.col("part") < extra).cast("long")
    return p.select("action", "part", first.alias("first"), (first + n - 1).alias("last"), n.alias("frames"))


@query("plan_estimate", "WITH p(subjects, candidates, level) AS (SELECT s, c, l FROM (SELECT unnest(range(1, 9)) AS s), (SELECT unnest(range(1, 5)) AS c), (VALUES ('off', 0), ('low', 600), ('medium', 1800), ('high', 3500)) v(l, t)) SELECT subjects, candidates, level, " + half_up_sql(half_up_sql("subjects * candidates * (0.0336::DOUBLE + 900 / 1e6::DOUBLE * 7.5)", 4) + " + subjects * " + half_up_sql("(1500 + 320 * candidates) / 1e6::DOUBLE * 0.75 + (450 + CASE level WHEN 'off' THEN 0 WHEN 'low' THEN 600 WHEN 'medium' THEN 1800 ELSE 3500 END) / 1e6::DOUBLE * 3.75", 6), 4) + " AS cost FROM p")
def plan_estimate(spark, sf):
    """Images at the listed figure with a thinking allowance, and a judge's call for each subject."""
    levels = F.array(*(F.struct(F.lit(n).alias("level"), F.lit(t).alias("think")) for n, t in P.THINKING))
    d = spark.range(1, 9).select(F.col("id").alias("subjects"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("candidates"), levels.alias("v")).select("subjects", F.col("candidates").cast("long").alias("candidates"), F.inline("v"))
    images = half_up(F.col("subjects") * F.col("candidates") * (0.0336 + 900 / 1e6 * 7.5), 4)
    judge = half_up((1500 + 320 * F.col("candidates")) / 1e6 * 0.75 + (450 + F.col("think")) / 1e6 * 3.75, 6)
    return d.select("subjects", "candidates", "level", half_up(images + F.col("subjects") * judge, 4).alias("cost"))


@query("failures", f"WITH {X.LEDGER} SELECT run, op, count(*) AS failed FROM led WHERE NOT ok GROUP BY run, op")
def failures(spark, sf):
    return X.ledger(spark, sf).where("not ok").groupBy("run", "op").agg(F.count("*").alias("failed"))


@query("usage_of", "SELECT event_id AS id, coalesce(CAST(props->>'k' AS BIGINT), 0) AS prompt, event_type = 'view' AS image FROM events")
def usage_of(spark, sf):
    """A number out of the JSON of a call; absent counts as nothing."""
    k = F.from_json("props", "k bigint")["k"]
    return X.table(spark, sf, "events").select(F.col("event_id").alias("id"), F.coalesce(k, F.lit(0)).alias("prompt"), (F.col("event_type") == "view").alias("image"))


@query(
    "judge_pick",
    """WITH s AS (SELECT d.source, d.doc_id, CAST(floor((l.quality * 100 + (1 - l.toxic) * 100 + d.doc_id % 7) / 3.0::DOUBLE * 10 + 0.5) AS DOUBLE) / 10 AS score FROM labels l JOIN documents d USING (doc_id))
    SELECT source, arg_min(doc_id, [-score, doc_id::DOUBLE]) AS pick, max(score) AS score, count(*) AS candidates FROM s GROUP BY source""",
)
def judge_pick(spark, sf):
    """The best mean score of each group, the first of equals."""
    d = X.table(spark, sf, "documents").select("doc_id", "source")
    l = X.table(spark, sf, "labels")
    score = half_up((F.col("quality") * 100 + (1 - F.col("toxic")) * 100 + F.col("doc_id") % 7) / 3.0, 1)
    s = l.join(d, "doc_id").select("source", "doc_id", score.alias("score"))
    best = F.min(F.struct((-F.col("score")).alias("k"), "doc_id"))
    return s.groupBy("source").agg(best["doc_id"].alias("pick"), F.max("score").alias("score"), F.count("*").alias("candidates"))


@query("edit_chain", "SELECT conv_id AS root, turn AS edit, conv_id || CASE WHEN turn > 0 THEN 'e' || turn ELSE '' END AS id, CASE WHEN turn > 0 THEN conv_id || CASE WHEN turn > 1 THEN 'e' || (turn - 1) ELSE '' END END AS parent, max(turn) OVER (PARTITION BY conv_id) + 1 AS next FROM conversations")
def edit_chain(spark, sf):
    """Edits of a root: ids, the parent pointer, and the number that the next edit gets."""
    c = X.table(spark, sf, "conversations").select("conv_id", "turn")
    name = lambda n: F.concat(F.col("conv_id").cast("string"), F.when(n > 0, F.concat(F.lit("e"), n.cast("string"))).otherwise(""))
    return c.select(
        F.col("conv_id").alias("root"), F.col("turn").alias("edit"), name(F.col("turn")).alias("id"), F.when(F.col("turn") > 0, name(F.col("turn") - 1)).alias("parent"), (F.max("turn").over(Window.partitionBy("conv_id")) + 1).alias("next")
    )
