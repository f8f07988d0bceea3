"""Record files, the isotonic fit and the ledger of archive attempts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlake.operators import isotonic
from marketlake.session import shared_dir
from marketlake.sources import records
from marketlake.sources.io import RECORD
from marketlake.streaming import core, ledger


def folder(spark, name):
    import uuid

    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:8]}"


def ticks(spark, n):
    return spark.range(n).selectExpr("if(id % 7 = 0, null, concat('S', id % 3)) AS symbol", "id AS timestamp_us", "if(id % 5 = 0, null, 1.5D) AS bid", "2.5D AS ask", "id / 100000D AS last", "3.0D AS volume", "cast(id % 4 AS int) AS flags")


def test_records_in_many_tasks_and_a_short_rest(spark):
    records.register(spark)
    path = folder(spark, "records")
    ticks(spark, 1000).coalesce(2).write.format("tick_records").mode("append").save(path)
    fs, at = records.opened(path)
    fs.create_dir(at, recursive=True)
    with fs.open_output_stream(f"{at}/short.bin") as f:
        f.write(np.zeros(3, RECORD).tobytes() + b"xyz")
    with fs.open_output_stream(f"{at}/rest.bin") as f:
        f.write(b"ab")
    with fs.open_output_stream(f"{at}/_hidden.bin") as f:
        f.write(b"ab")
    got = spark.read.format("tick_records").option("splitBytes", 100 * RECORD.itemsize).load(path)
    assert got.rdd.getNumPartitions() == 12  # five ranges in each half, two short files
    rows = got.collect()
    assert sorted(r["error"] for r in rows if r["error"]) == ["short record of 2 bytes", "short record of 3 bytes"]
    assert sum(r["error"] is None for r in rows) == 1003
    mine = sorted((r["timestamp_us"], r["symbol"], r["bid"], r["last"], r["flags"]) for r in rows if r["source"].rsplit("/")[-1].startswith("part-"))
    assert mine == [(i, "" if i % 7 == 0 else f"S{i % 3}", 0.0 if i % 5 == 0 else 1.5, i / 1e5, i % 4) for i in range(1000)]


def test_records_replaced_and_empty(spark):
    records.register(spark)
    path = folder(spark, "records")
    assert spark.read.format("tick_records").load(path).count() == 0
    for n in (50, 20):
        ticks(spark, n).write.format("tick_records").mode("overwrite").save(path)
    assert spark.read.format("tick_records").load(path).count() == 20
    assert not [f for f in records.opened(path)[0].get_file_info(records.pafs.FileSelector(path)) if "_staging" in f.path]


def test_records_stream_waits_for_whole_records(spark):
    records.register(spark)
    path, out = folder(spark, "records"), folder(spark, "records-out")
    fs, at = records.opened(path)
    fs.create_dir(at, recursive=True)
    whole = np.zeros(5, RECORD)
    whole["timestamp_us"] = range(5)

    def put(n):
        def arrive():
            with fs.open_output_stream(f"{at}/grows.bin") as f:
                f.write(whole.tobytes()[:n])
        return arrive

    stream = spark.readStream.format("tick_records").option("splitBytes", RECORD.itemsize).load(path)
    core.run_available(stream, out, steps=[put(2 * RECORD.itemsize + 7), put(5 * RECORD.itemsize)])
    got = spark.read.parquet(out + "/data").collect()
    assert sorted(r["timestamp_us"] for r in got) == list(range(5)) and all(r["error"] is None for r in got)


def plain_fit(x, y):
    """Greatest over all starts of the least mean over all ends, at each score."""
    xs = np.unique(x)
    w, s = np.array([(x == v).sum() for v in xs], float), np.array([y[x == v].sum() for v in xs], float)
    n = len(xs)
    cw, cs = np.concatenate([[0], w.cumsum()]), np.concatenate([[0], s.cumsum()])
    low = np.full((n, n), -np.inf)
    for a in range(n):
        means = (cs[a + 1:] - cs[a]) / (cw[a + 1:] - cw[a])
        low[a, a:] = np.minimum.accumulate(means[::-1])[::-1]
    return xs, low.max(axis=0)


@pytest.mark.parametrize("kind,ranges", [("noisy", 1), ("noisy", 5), ("noisy", 40), ("falling", 5), ("hot", 5)])
def test_isotonic_fit_equals_the_plain_one(spark, kind, ranges):
    g = np.random.default_rng(ranges)
    x = np.round(g.random(10_000), 2 if kind == "noisy" else 1)
    if kind == "hot":
        x[: len(x) // 2] = 0.5
    y = (g.random(len(x)) < (1 - x if kind == "falling" else x)).astype(int)
    xs, want = plain_fit(x, y)
    rows = [(float(a), int(b)) for a, b in zip(x, y)] + [(None, 1), (float("nan"), 0), (0.3, None)]
    blocks = isotonic.fit(spark.createDataFrame(rows, "p double, y int"), "p", "y", ranges)
    ask = np.concatenate([xs, g.random(200) * 1.4 - 0.2])
    q = spark.createDataFrame([(float(a), -1.0) for a in ask] + [(None, -1.0), (float("nan"), -1.0)], "p double, _v double")
    got = isotonic.values(q, blocks, "p", "fitted").collect()
    assert len(got) == len(ask) + 2
    for r in got:
        if r["p"] is None or r["p"] != r["p"]:
            assert r["fitted"] is None
        else:
            assert r["fitted"] == pytest.approx(float(np.interp(r["p"], xs, want)), abs=1e-12)


def test_isotonic_without_rows(spark):
    none = spark.createDataFrame([], "p double, y int")
    blocks = isotonic.fit(none, "p", "y")
    assert blocks.count() == 0
    assert [r["v"] for r in isotonic.values(spark.createDataFrame([(0.5, 1)], "p double, y int"), blocks, "p", "v").collect()] == [None]
    assert isotonic.values(none, blocks, "p", "v").count() == 0


def test_ledger_gives_up_and_takes_repeats(spark):
    path = folder(spark, "ledger")
    calls = []

    def write(df, batch):
        calls.append((batch, df.count()))
        if batch == 1 or (batch == 2 and len([c for c in calls if c[0] == 2]) < 3):
            raise ValueError("no")

    run = ledger.recorded(spark, path, write, most=4)
    for batch in (0, 1, 2):
        run(spark.range(batch + 1), batch)
    run(spark.range(9), 0)  # completed: not written again
    assert [c for c in calls if c[0] == 0] == [(0, 1)]
    tried = []
    while n := ledger.retry(spark, path, write, most=4):
        tried.append(n)
    assert tried == [2, 2, 1]
    got = {r["batch"]: (r["attempts"], r["status"], r["error"]) for r in ledger.status(spark, path).collect()}
    assert got == {0: (1, "completed", None), 1: (4, "failed", "ValueError: no"), 2: (3, "completed", None)}
    assert {c[1] for c in calls if c[0] == 2} == {3}
    assert ledger.attempts(spark, path).where(F.col("status") == "pending").count() == 5
