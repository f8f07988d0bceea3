"""Streams against plain loops over the same rows."""

from datetime import UTC, datetime

from pyspark.sql import functions as F

import __spark_entry__
from marketlake.streaming import core as X
from marketlake.streaming import timers as T

__spark_entry__.queries()  # the plans register one another

from marketlake.plans.q_data import folder  # noqa: E402
from marketlake.plans.q_stream import tick_feed  # noqa: E402

SF = "/root/testdata/sf0.001"


def fed(spark, rows, schema, steps):
    """A stream of ``rows`` in files of one step each; ``steps`` are the rows' numbers at which a step ends."""
    path = folder(spark, "test-fed")
    spark.createDataFrame([], schema).write.parquet(path)
    cuts = [0, *steps, len(rows)]

    def step(a, b):
        return lambda: spark.createDataFrame(rows[a:b], schema).write.mode("append").parquet(path)

    return spark.readStream.schema(schema).parquet(path), [step(a, b) for a, b in zip(cuts, cuts[1:])]


def test_entries_run_out_in_any_batches(spark):
    times = [0, 5, 11, 40, 41, 100, 300]
    rows = [("a" if k != 3 else "b", datetime.fromtimestamp(1000 + t, UTC)) for k, t in enumerate(times)]
    expected = [("a", 1011, 1031), ("a", 1041, 1061), ("a", 1100, 1120), ("b", 1040, 1060)]
    for steps in ([], [3], [1, 2, 5]):
        stream, arrive = fed(spark, rows, "k string, ts timestamp", steps)
        path = folder(spark, "test-ttl")
        X.run_available(T.expirations(stream, F.col("k"), F.lit(20)), path, steps=arrive)
        got = spark.read.parquet(path + "/data").collect()
        assert sorted((r["key"], r["written"] // 10**6, r["expired"] // 10**6) for r in got) == expected


def test_countdown_in_any_batches(spark):
    rows = [(1, "HIGH", 10_000), (2, "LOW", 10_100), (3, "HIGH", 10_200), (4, "LOW", 12_000)]
    rows = [(k, i, datetime.fromtimestamp(t, UTC)) for k, i, t in rows]
    for steps in ([], [1, 3]):
        stream, arrive = fed(spark, rows, "event_id long, impact string, scheduled_time timestamp", steps)
        path = folder(spark, "test-countdown")
        X.run_available(T.countdown_stream(stream, 60, 30), path, steps=arrive)
        got = T.countdown_seconds(spark.read.parquet(path + "/data")).collect()
        for k, at in ((1, 10_000), (3, 10_200)):
            mine = sorted((r["second"], r["phase"], r["to_event"]) for r in got if r["event_id"] == k)
            assert mine == [(s, "PRE_NEWS" if s < at else "NEWS_WINDOW", at - s) for s in range(at - 60, at + 31)]
        assert {r["event_id"] for r in got} == {1, 3}


def test_late_ticks_are_counted(spark):
    path = folder(spark, "test-late")
    ticks, steps = tick_feed(spark, SF, late=True)
    progress = X.run_available(X.bars_stream(ticks, "H1"), path, steps=steps)
    dropped = sum(op["numRowsDroppedByWatermark"] for p in progress for op in p["stateOperators"])
    assert dropped > 0
