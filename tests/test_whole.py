"""Queries read whole inputs: no cut by id."""

from pyspark.sql import functions as F

from tessera.plans import registry

registry.load()


def parts(spark, tmp_path, rows):
    spark.createDataFrame(rows, "p_partkey bigint, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


def test_write_fnt(spark, tmp_path):
    sf = parts(spark, tmp_path, [(k, "b", 5) for k in (1, 3999, 4000, 70_000)])
    (r,) = registry.QUERIES["write_fnt"](spark, sf).collect()
    assert r.chars == 4 and [x.split()[1] for x in r.lines.split("\n")] == ["id=1", "id=3999", "id=4000", "id=70000"]


def test_normalize_hex(spark, tmp_path):
    from tessera.plans.text import normal_hex

    spelt = {"#AbC": "#aabbcc", "#abcd": "#aabbcc", "#01020380": "#010203", "#12345": None, "teal": None, " rgb(300, 2.5,7) ": "#ff0307", "rgba(1 3 4 / 50%)": "#010304"}
    got = spark.createDataFrame([(k,) for k in spelt], "s string").select("s", normal_hex(F.col("s")).alias("h")).collect()
    assert {r.s: r.h for r in got} == spelt
    sf = str(tmp_path)
    spark.range(16).selectExpr("id AS p_partkey", "CAST(9 AS INT) AS p_size").write.parquet(f"{sf}/part.parquet")
    got = {r.id: r.hex for r in registry.QUERIES["normalize_hex_all"](spark, sf).collect()}
    assert sorted(got) == list(range(16)) and sorted(k for k in got if got[k] is None) == [5, 6, 13, 14]
    assert got[3] == "#030907" and got[4] == "#040304"


def test_strip_aspect(spark, tmp_path):
    sizes = {1: "1:1", 2: "3:2", 3: "16:9", 4: "16:9", 5: "21:9", 40: "21:9"}
    rows = [(k, n) for n in sizes for k in range(n)]
    made = spark.createDataFrame([(1000 * n + k, n) for k, n in rows], "vec_id bigint, label int")
    made.selectExpr("*", "array_repeat(CAST(0 AS FLOAT), 64) AS embedding").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(n,) for _, n in rows], "l_orderkey bigint").write.parquet(f"{tmp_path}/lineitem.parquet")
    for name in ("strip_aspect_all", "strip_aspect_orders"):
        assert sorted(map(tuple, registry.QUERIES[name](spark, str(tmp_path)).collect())) == [(n, n, a) for n, a in sizes.items()]
