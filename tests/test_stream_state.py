"""State of streams is dealt to keys of bounded size, however many events or predictions there are."""

import datetime as dt
import random

from pyspark.sql import functions as F

from marketlake.plans import catalog

catalog.queries()

from marketlake.plans.q_data import folder  # noqa: E402
from marketlake.plans.q_stream import feed  # noqa: E402
from marketlake.streaming import core as X  # noqa: E402
from marketlake.streaming import timers as T  # noqa: E402

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def test_countdown_keeps_events_in_buckets(spark):
    rows = [(k, "HIGH" if k % 2 else "LOW", T0 + dt.timedelta(seconds=7 * k)) for k in range(400)]
    c = spark.createDataFrame(rows, "event_id long, impact string, scheduled_time timestamp")
    stream, steps = feed(spark, c, F.floor(F.col("event_id") / 100))
    path = folder(spark, "test-buckets")
    progress = X.run_available(T.countdown_stream(stream, 60, 30, buckets=3), path, steps=steps)
    assert max(o["numRowsTotal"] for p in progress for o in p["stateOperators"]) <= 3 * 4
    got = {}
    for r in T.countdown_seconds(spark.read.parquet(path + "/data")).collect():
        got.setdefault(r["event_id"], []).append((r["second"], r["phase"], r["to_event"]))
    start, last = int(T0.timestamp()), int(T0.timestamp()) + 7 * 399 - 60 - 10
    for k, _, _ in rows:
        at = start + 7 * k
        want = [(s, "PRE_NEWS" if s < at else "NEWS_WINDOW", at - s) for s in range(at - 60, at + 31) if s <= last] if k % 2 else []
        assert sorted(got.get(k, [])) == want


def test_outcomes_of_shards(spark):
    g = random.Random(4)
    bars = [("X", 0, n, 100 + g.random() * 4, 96 + g.random() * 4, None, None, None) for n in range(120)]
    preds = [("X", 1, g.randrange(120), None, None, k, 100 + g.random() * 4.2, 96 - g.random() * 0.2 + g.random()) for k in range(300)]
    preds += [("X", 1, 5, None, None, 900, None, None)]
    schema = "symbol string, kind int, bar_no long, high double, low double, prediction_id long, predicted_bsl_level double, predicted_ssl_level double"
    rows, steps = feed(spark, spark.createDataFrame(bars + preds, schema), F.floor(F.col("bar_no") / 30))
    path = folder(spark, "test-shards")
    sizes = X.run_available(X.outcome_stream(rows, 12, shards=5), path, steps=steps)
    assert max(o["numRowsTotal"] for p in sizes for o in p["stateOperators"]) == 5
    plain = []
    for _, _, born, _, _, k, up, down in preds:
        for _, _, n, high, low, *_ in bars[born + 1 :]:
            name = "BSL_HIT" if up is not None and high >= up else "SSL_HIT" if down is not None and low <= down else "TIMEOUT" if n >= born + 12 else None
            if name:
                plain.append((k, name, n))
                break
    assert sorted(tuple(r) for r in spark.read.parquet(path + "/data").collect()) == sorted(plain)
