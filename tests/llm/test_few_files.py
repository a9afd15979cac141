"""Small rows of many tasks go into few files: each file that Spark writes to a local folder costs an executor processes."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessera.llm import queries, secret_scan
from tessera.llm.common import packed, table, tables_dir

SF = "/root/testdata/sf0.01"


@pytest.fixture
def many_tasks(spark):
    """As the check tool holds them on check_h: many partitions that Spark does not put together."""
    held = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "23", "spark.sql.files.maxPartitionBytes": "64k", "spark.sql.files.openCostInBytes": "1k"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def written(spark):
    return set(Path(tables_dir(spark).removeprefix("file:")).rglob("part-*"))


def test_secret_scan_writes_few_files(spark, many_tasks):
    """A file for each of the tables that stay: two commits of the ledger, spans by blob and the result."""
    docs = table(spark, SF, "documents")
    want = sorted(map(tuple, secret_scan.summary(docs, secret_scan.scan(docs)).collect()))
    before = written(spark)
    got = queries.op1_secret_scan(spark, SF)
    assert docs.rdd.getNumPartitions() > 12
    assert len(written(spark) - before) == 4
    assert sorted(map(tuple, got.collect())) == want and len(want) == docs.count()


def test_ledger_commits_are_written_once(spark, many_tasks):
    """A commit is the scan's own table, whole and without a copy beside it; nothing is kept on executors after it."""
    docs = table(spark, SF, "documents")
    before, ledger = written(spark), secret_scan.Ledger(spark)
    n = ledger.add(docs)
    new = written(spark) - before
    assert len(new) == 1 and "/ledger-" in str(*new) and len(ledger.commits()) == 1
    assert n == ledger.findings().count() == 3 * docs.select(secret_scan.blob_of(F.col("text"))).distinct().count()
    assert ledger.add(docs) == 0 and len(ledger.commits()) == 2
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0


def test_packed_files_follow_the_bytes(spark):
    """More bytes, more files; no rows, an empty table; path: where the caller wants it."""
    d = spark.range(0, 600_000, 1, 40).select("id", F.sha2(F.col("id").cast("string"), 256).alias("h"))
    out = packed(d)
    assert 1 < len(out.inputFiles()) < 10 and out.exceptAll(d).count() == 0 == d.exceptAll(out).count()
    none = packed(d.where("id < 0"), path := f"{tables_dir(spark)}/none-of-them")
    assert none.count() == 0 and none.dtypes == d.dtypes and all(path.removeprefix("file:") in f for f in none.inputFiles())
