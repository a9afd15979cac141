"""Shard files and the ids beside them: what an executor's JVM does not have to write, shuffle or hold."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import queries, token_shards
from tessera.llm.common import reach_package, table, tables_dir

SF = "/root/testdata/sf0.001"


def test_spark_writes_no_index(spark):
    """One table of Spark's, the offsets; the result reads the shards where they lie, so nothing is shuffled or sorted."""
    folder = Path(tables_dir(spark).removeprefix("file:"))
    before = set(folder.rglob("*.parquet"))
    got = queries.op9_token_shards(spark, SF)
    assert len(set(folder.rglob("*.parquet")) - before) == 1
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan and "Sort" not in plan
    docs = table(spark, SF, "documents").count()
    assert got.select("doc_id").distinct().count() == docs and got.where("seq = 0").count() == docs


def test_shards_of_a_partition_need_not_follow(spark, tmp_path):
    """A partition with every second shard: a shard that is done is not written over by the next one's beginning."""
    reach_package(spark)
    d = spark.range(400).select(F.col("id").cast("string").alias("doc_id"), F.repeat(F.lit("ab"), F.col("id").cast("int") % 30).alias("text"))
    recs = token_shards.records(d, stride=16, shard_slots=32).persist()
    want = recs.orderBy("slot").collect()
    dealt = recs.repartitionById(2, (F.col("shard") % 2).cast("int")).sortWithinPartitions("slot")
    path = f"file://{tmp_path}/apart"
    index = token_shards.write(dealt, path, 16, 32)
    assert len(want) > 320
    assert [(s, v.tolist()) for s, v in token_shards.resume(path)] == [(r.slot, list(bytes(r.record))[: r.n_tokens]) for r in want]
    whole = token_shards.listed(spark, path, "string", whole=True)
    assert whole.collect() == want and token_shards.read(index.where("slot % 7 = 0"), path, 16, 32).collect() == [r for r in want if r.slot % 7 == 0]
    cut = recs.where("slot > 5").repartitionById(1, F.lit(0)).sortWithinPartitions("slot")
    with pytest.raises(Exception, match="does not begin a shard"):
        token_shards.write(cut, f"file://{tmp_path}/cut", 16, 32)


def test_batches_within_a_shard(spark, tmp_path, monkeypatch):
    """A shard of more bytes than a batch may have, ids of null, empty runs and an empty folder."""
    reach_package(spark)
    monkeypatch.setattr(token_shards, "BATCH_BYTES", 100)
    d = spark.createDataFrame([(None if i % 5 == 0 else i, list(range(i % 23))) for i in range(90)], "doc_id int, ids array<int>")
    pack = lambda lists: [token_shards.packed_bytes(x or [], 2) for x in lists]
    recs = token_shards._in_order(d, F.col("ids"), F.lit(200), pack, 3, 8, 16, 2).persist()
    path = f"file://{tmp_path}/runs"
    index = token_shards.write(recs, path, 8, 16, 2)
    want = [(r.doc_id, r.seq, r.n_tokens) for r in recs.orderBy("place").collect()]
    got = token_shards.listed(spark, path, "int", whole=True).collect()
    assert [r.slot for r in got] == list(range(len(want))) and [(r.doc_id, r.seq, r.n_tokens) for r in got] == want
    assert [np.frombuffer(bytes(r.record), "<u2")[: r.n_tokens].tolist() for r in got] == [v.tolist() for _, v in token_shards.resume(path)]
    assert [(r.slot, r.shard, r.byte_offset) for r in index.collect()] == [(r.slot, r.shard, r.byte_offset) for r in got]
    none = f"file://{tmp_path}/none"
    assert token_shards.write(recs.where("place < 0"), none, 8, 16, 2).count() == 0 == token_shards.listed(spark, none, "int", whole=True).count()
