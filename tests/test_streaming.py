"""The streamed ledger gives what the batch gives, late and repeated calls included."""

import datetime as dt

from tessera.streaming import ledger


def test_stream_is_batch(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    rows = [(i, day + dt.timedelta(hours=i), i % 3, "view", None if i % 11 == 0 else i / 8, i % 5 > 0) for i in range(200)]
    src, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    calls = spark.createDataFrame(rows, "id bigint, ts timestamp, run bigint, op string, cost double, ok boolean")
    end = spark.createDataFrame([(10_000, day + dt.timedelta(days=90), 0, "view", 1.0, True)], calls.schema)
    for part in (calls.where("id < 100"), calls.where("id between 90 and 199"), end):
        ledger.append(part, src)
        ledger.write_rollup(ledger.read_stream(spark, src), out, check).awaitTermination()
    got = spark.read.parquet(out).collect()
    want = ledger.rollup(calls).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and want
