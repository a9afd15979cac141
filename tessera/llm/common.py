"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ARROW, ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 512
#: A word: a run of characters other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


#: Folders of written tables that are deleted at the end.
_OWN: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reach_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reach_package(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package wherever the driver was started; clusters get it by --py-files.

    Arrow batches are kept to ARROW_ROWS rows, as one row can be a text of many kilobytes; a smaller setting stands.
    """
    if int(spark.conf.get(ARROW, "10000")) > ARROW_ROWS:
        spark.conf.set(ARROW, str(ARROW_ROWS))
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in (paths := [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]):
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one in the warehouse where the session names none."""
    return spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_tessera"


def _hadoop(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def tables_dir(spark: SparkSession) -> str:
    """The application's folder for written tables, deleted when the driver ends; results still read them until then."""
    path = f"{shared_dir(spark)}/tessera/{spark.sparkContext.applicationId}"
    if path not in _OWN:
        at, store = _hadoop(spark, path)
        store.mkdirs(at)
        store.deleteOnExit(at)
        _OWN.add(path)
    return path


def materialise(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder, or at path, and read it back.

    Cuts the lineage so that a lost executor costs no recomputation of what came before, fixes the rows that later
    passes see, and gives the planner a real size.
    """
    spark = df.sparkSession
    path = path or f"{tables_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


#: Bytes of rows, as Spark keeps them, that a file of packed() has on average.
FILE_BYTES = 1 << 24


def packed(df: DataFrame, path: str | None = None) -> DataFrame:
    """As materialise(), in as few files as the bytes of df's rows need, however many tasks make the rows.

    All tasks make rows and keep them on the executors' disks; fewer then write them, without a shuffle. For small rows
    of many tasks: a file costs an executor several processes where Hadoop has no native library (see README).
    """
    kept = df.persist(StorageLevel.DISK_ONLY)
    try:
        kept.count()
        size = kept.select("*")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
        return materialise(kept.coalesce(max(1, -(-size // FILE_BYTES))), path)
    finally:
        kept.unpersist()


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing will read again."""
    for t in tables:
        at, store = _hadoop(t.sparkSession, t._tessera_path)
        store.delete(at, True)


def map_rows(df: DataFrame, fn: Callable[..., Iterator[tuple] | list[tuple]], schema: str) -> DataFrame:
    """Arrow map: fn gets the batch's columns as Python lists and returns one tuple per output row."""
    fields = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(fields)

    def run(batches):
        for b in batches:
            rows = list(fn(*(c.to_pylist() for c in b.columns)))
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, fields)


def fold(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % F.lit(n)


def first_by_hash(ids: DataFrame, column: str, n: int, seed: str) -> DataFrame:
    """The n rows of ids whose hash of a column is least, rows as they are.

    A cut at three times the share that n is leaves about 3n rows to sort, however many partitions there are; plain
    ORDER BY ... LIMIT would send n rows of each partition to one task.
    """
    h = F.xxhash64(column, F.lit(seed))
    total = ids.count()
    if total > 4 * n:
        ids = ids.where(h.cast("double") < -(2.0**63) + 2.0**64 * (3 * n / total))
    return ids.orderBy(h, column).limit(n)


#: Rows up to which a table of ids, of a few numbers each, is broadcast.
FEW = 1 << 20


def few(ids: DataFrame) -> DataFrame:
    """A written table of ids marked for broadcast if it has no more than FEW rows; beyond, both sides are shuffled."""
    return F.broadcast(ids) if ids.count() <= FEW else ids
