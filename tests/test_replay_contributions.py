"""Trades of a back-test against a plain loop, contributions against the model's own score."""

import random

import pytest
from pyspark.sql import functions as F

from marketlake.operators import contributions as G
from marketlake.operators import models as ML
from marketlake.operators import structure as S
from marketlake.operators.replay import replay, trades_from
from marketlake.streaming.core import late_rows


def test_trades_against_a_loop(spark, bars_of):
    g = random.Random(4)
    close, bars = 100.0, []
    for _ in range(200):
        o, close = close, close + g.uniform(-2, 2)
        bars.append((o, max(o, close) + g.random(), min(o, close) - g.random(), close))
    preds, horizon = [], 5
    for k in range(300):
        no = None if k % 50 == 0 else g.randrange(200)
        p = [None, 0.2, 0.5] if k % 40 == 1 else [0.4, 0.4, 0.2] if k % 40 == 2 else [g.random() for _ in range(3)]
        ref = bars[no][3] if no is not None else 100.0
        preds.append((k, "X", "M1", no, *p, ref + 3 * g.random(), ref - 3 * g.random()))
    schema = "prediction_id long, symbol string, tf string, bar_no long, p_bsl double, p_ssl double, p_lateral double, predicted_bsl_level double, predicted_ssl_level double"
    want = {}
    for k, _, _, no, b, s, l, up, down in preds:  # noqa: E741
        if no is None or b is None or b == s or max(b, s) < l:
            continue
        for n in range(no + 1, min(no + horizon, 199) + 1):
            hit = up if bars[n][1] >= up else down if bars[n][2] <= down else bars[n][3] if n == no + horizon else None
            if hit is not None:
                want[k] = ((1 if b > s else -1) * (hit - bars[no][3]), n - no, n)
                break
    df, bd = spark.createDataFrame(preds, schema), bars_of(bars)
    got = {r["prediction_id"]: r for r in trades_from(df, bd, horizon).collect()}
    assert got.keys() == want.keys() and len(want) > 100
    for k, (pnl, hold, _) in want.items():
        assert got[k]["pnl"] == pytest.approx(pnl) and got[k]["hold_bars"] == hold
    equity, peak, dd = 0.0, float("-inf"), 0.0
    for k in sorted(want, key=lambda k: (want[k][2], k)):
        equity += want[k][0]
        peak = max(peak, equity)
        dd = max(dd, (peak - equity) / peak if peak > 0 else 0.0)
    r = replay(df, bd, horizon).first()
    assert (r["trades"], r["total_pnl"], r["max_drawdown"]) == (len(want), pytest.approx(equity), pytest.approx(dd))
    assert replay(df.limit(0), bd, horizon).count() == 0


def test_contributions_add_up_to_the_score(spark):
    g = random.Random(2)
    rows = [(i, *(x := [g.random() for _ in range(4)]), 0.5, int(x[0] > 0.6) + int(x[0] + x[1] > 1.2)) for i in range(600)]
    d = ML.as_features(spark.createDataFrame(rows, "id long, a double, b double, c double, d double, e double, label int"), cols := ["a", "b", "c", "d", "e"])
    m = ML.fit_direction(d, trees=6, depth=4)
    for k, p in enumerate(("p_bsl", "p_ssl", "p_lateral")):
        s = G.contributions(m, ML.class_probabilities(m, d), cols, k)
        off = F.abs(F.col("bias") + sum(F.col("contributions")[c] for c in cols) - F.col(p))
        assert s.agg(F.max(off)).first()[0] < 1e-9
        assert s.agg(F.max(F.abs(F.col("contributions")["e"]))).first()[0] == 0.0  # a constant explains nothing
    top = G.strongest(s, cols, 3).collect()
    assert [r["rank"] for r in top] == [1, 2, 3] and {top[0]["feature"], top[1]["feature"]} == {"a", "b"}


def test_fib_table_function(spark):
    S.register_fib_levels(spark)
    e = spark.createDataFrame([("A", 10.0, 0.0), ("B", None, 1.0)], "symbol string, h double, l double")
    got = spark.sql("SELECT symbol, ratio, price FROM {e}, LATERAL fib_levels(h, l)", e=e).collect()
    assert sorted((r["ratio"], round(r["price"], 9)) for r in got if r["symbol"] == "A") == [(0.382, 3.82), (0.5, 5.0), (0.618, 6.18), (0.786, 7.86)]
    assert [r["price"] for r in got if r["symbol"] == "B"] == [None] * 4


def test_late_rows(spark):
    fed = spark.createDataFrame([("A", t) for t in (0, 10, 20, 20, 70, 130)], "symbol string, s long").withColumn("ts", F.timestamp_seconds("s"))
    bars = spark.createDataFrame([("A", 0, 3), ("A", 60, 1)], "symbol string, bucket long, tick_count long")
    assert [tuple(r) for r in late_rows(fed, bars, "M1").collect()] == [("A", 4, 1)]


def test_replay_works_out_trades_once(spark, bars_of, capsys):
    """Neither the predictions nor the trades are worked out anew for each of their readers."""
    from pyspark.sql import functions as F

    from marketlake.operators.replay import replay

    bars = bars_of([(10, 11, 9, 10), (10, 12, 9, 11), (11, 13, 10, 12)])
    preds = spark.range(3).select(F.col("id").alias("prediction_id"), F.lit("X").alias("symbol"), F.lit("M1").alias("tf"), F.lit(0).cast("bigint").alias("bar_no"), F.lit(0.7).alias("p_bsl"), F.lit(0.2).alias("p_ssl"), F.lit(0.1).alias("p_lateral"), F.lit(12.0).alias("predicted_bsl_level"), F.lit(1.0).alias("predicted_ssl_level"))
    out = replay(preds, bars, 2)
    assert out.first()["trades"] == 3
    out.explain()
    plan = capsys.readouterr().out
    # every read of the trades is the cached table, and all that is worked out from predictions lies below it
    assert plan.count("InMemoryRelation") >= 1 and "Range (0, 3" not in plan.split("InMemoryRelation")[0]
