"""Small literal cases."""

import numpy as np
from pyspark.sql import functions as F

from marketlake.functions import ticks as fn
from marketlake.operators import bars as B
from marketlake.operators import flow as L
from marketlake.operators import macro as M
from marketlake.operators import outcomes as O
from marketlake.operators import retrieval as N
from marketlake.operators import structure as S
from marketlake.sources import io


def ticks(spark, rows):
    """rows of (second, last, volume, side)"""
    d = [("X", float(s), i, float(p) - (0.5 if side != "SELL" else 0.0), float(p) + (0.5 if side != "BUY" else 0.0), float(p), float(v)) for i, (s, p, v, side) in enumerate(rows)]
    df = spark.createDataFrame(d, "symbol string, s double, seq long, bid double, ask double, last double, volume double")
    return df.withColumn("ts", F.timestamp_micros((F.col("s") * 1e6).cast("bigint"))).drop("s")


def test_one_minute_bar(spark):
    b = B.ohlcv(ticks(spark, [(i * 10, 2500 + i, 1, "") for i in range(5)]), ["M1"]).first()
    assert (b.open, b.high, b.low, b.close, b.tick_count) == (2500, 2504, 2500, 2504, 5)


def test_two_ticks_in_all_timeframes(spark):
    rows = B.ohlcv(ticks(spark, [(0, 1, 1, ""), (301, 2, 1, "")]), ["M1", "M5", "H1"]).collect()
    got = {(r.tf, r.bucket): r.tick_count for r in rows}
    assert got == {("M1", 0): 1, ("M1", 300): 1, ("M5", 0): 1, ("M5", 300): 1, ("H1", 0): 2}


def test_buys_and_sells_cancel(spark):
    rows = [(i, 100, 10, "BUY") for i in range(10)] + [(10 + i, 100, 10, "SELL") for i in range(10)]
    t = ticks(spark, rows)
    e = t.withColumn("delta", fn.signed_volume(fn.aggressor(F.col("last"), F.col("bid"), F.col("ask")), F.col("volume")))
    assert L.cvd(e, "M1").orderBy(F.col("seq").desc()).first().cvd == 0.0


def test_gap_fill(spark):
    d = spark.createDataFrame([("X", "M1", 0, 0, 2500.0, 2506.0, 2499.0, 2505.0, 100.0, 1), ("X", "M1", 120, 1, 2506.0, 2508.0, 2504.0, 2507.0, 100.0, 1)],
                              "symbol string, tf string, bucket long, bar_no long, open double, high double, low double, close double, volume double, tick_count long")
    r = B.fill_gaps(d).filter("interpolated").collect()
    assert [(x.bucket, x.open, x.close, x.high, x.low, x.volume) for x in r] == [(60, 2505.0, 2506.0, 2506.0, 2505.0, 100.0)]


def test_swings(bars_of):
    hi = S.swings(bars_of([(h - 1, h, h - 2, h - 1) for h in (98, 99, 100, 106, 103)])).filter("is_high").collect()
    assert [(r.price, r.bar_no, r.confirm_bar_no) for r in hi] == [(106.0, 3, 4)]
    lo = S.swings(bars_of([(x + 1, x + 2, x, x + 1) for x in (100, 99, 98, 92, 95)])).filter("not is_high").collect()
    assert [r.price for r in lo] == [92.0]


def test_equal_highs_are_skipped_on_the_older_side(bars_of):
    p = S.swings(bars_of([(1, h, 0, 1) for h in (5, 7, 7, 7, 6)])).filter("is_high").collect()
    assert [(r.price, r.bar_no) for r in p] == [(7.0, 3)]
    assert S.swings(bars_of([(1, h, 0, 1) for h in (7, 7, 6)])).filter("is_high").count() == 0


def test_claim(bars_of):
    b = bars_of([(99, 99.5, 98, 99), (99, 100.5, 98, 99), (99, 100, 98, 99), (99, 101, 98, 99)])
    r = S.claim(S.swings(b), b).filter("is_high").first()
    assert (r.price, r.claimed_bar_no) == (100.5, 3)


def test_mitigation(spark, bars_of):
    z = spark.createDataFrame([("X", "M1", "FVG", 0, True, 0, 0, 99.0, 97.0, 99.0, 97.0, 98.0, False)],
                              "symbol string, tf string, kind string, imb_no long, is_bullish boolean, open_bar_no long, close_bar_no long, near double, far double, top double, bottom double, middle double, invertible boolean")
    wick = bars_of([(100, 101, 99.5, 100), (100, 101, 96.5, 100)])
    body = bars_of([(100, 101, 99.5, 100), (96, 100, 96, 99)])
    assert S.mitigate(z, wick, "wick_filled").first().mitigated_bar_no == 1
    assert S.mitigate(z, wick, "body_filled").first().mitigated_bar_no is None
    assert S.mitigate(z, body, "body_filled").first().mitigated_bar_no == 1
    every = S.mitigate_all(z, wick).first()
    assert [every[r] for r in S.RULES] == [1, 1, 1, None, None]


def test_gap_direction_and_inversion(bars_of):
    rows = [(10, 11, 9, 10.5), (10.5, 14, 10, 13.5), (13.5, 15, 12, 14), (14, 15, 13, 14), (14, 14, 13, 13.5)]
    g = S.fair_value_gaps(bars_of(rows), merge_vi=False).collect()
    assert [(r.is_bullish, r.far, r.near, r.close_bar_no) for r in g] == [(True, 11.0, 12.0, 2)]


def test_equal_highs(bars_of):
    rows = [(99, 99.5, 98, 99), (99, 100.0, 98, 99), (99, 99.2, 98, 99), (99, 99.1, 98, 99), (99, 99.3, 98, 99), (99, 99.4, 98, 99), (99, 100.05, 98, 99), (99, 99.0, 98, 98.5), (99, 100.5, 98, 99)]
    b = bars_of(rows)
    e = S.equal_levels(S.swings(b), b, 0.15).filter("is_high").collect()
    assert [(r.start_no, r.end_no, r.price, r.claimed_bar_no) for r in e] == [(1, 6, 100.05, 8)]


def test_spacing_is_the_median_of_the_last_atrs():
    atr = np.round(np.arange(1.0, 3.31, 0.1), 1)
    assert round(float(np.median(atr[-14:])) * 0.2, 6) == 0.53


def test_outcomes(spark, bars_of):
    b = bars_of([(2490, 2491, 2489, 2490), (2490, 2501, 2489, 2495), (2495, 2496, 2470, 2480)])
    p = spark.createDataFrame([(1, "X", "M1", 0, 2500.0, 2480.0), (2, "X", "M1", 1, 2600.0, 2480.0), (3, "X", "M1", 0, 2600.0, 2400.0), (4, "X", "M1", 2, 2600.0, 2400.0)],
                              "prediction_id long, symbol string, tf string, bar_no long, predicted_bsl_level double, predicted_ssl_level double")
    got = {r.prediction_id: (r.outcome, r.outcome_no) for r in O.resolve(p, b, 2).collect()}
    assert got == {1: ("BSL_HIT", 1), 2: ("SSL_HIT", 2), 3: ("TIMEOUT", 2), 4: ("PENDING", None)}


def test_rerank(spark):
    r = spark.range(1).select(N.rerank_score(F.lit(0.9), F.lit(0)).alias("a"), N.rerank_score(F.lit(0.9), F.lit(30)).alias("b")).first()
    assert abs(r.a - 0.93) < 1e-12 and abs(r.b - 0.63968) < 1e-5


def test_surprise_factor(spark):
    r = spark.range(1).select(*[M.surprise_factor(F.lit(float(z))).alias(f"z{i}") for i, z in enumerate((0, 1, 1.5, 2, 3))]).first()
    assert list(r) == [1.0, 1.0, 1.125, 1.25, 1.75]


def test_no_look_ahead(spark, bars_of):
    """Cutting the bars off must not change any swing confirmed by then."""
    g = np.random.default_rng(11)
    c = np.round(100 + g.normal(size=120).cumsum(), 2)
    rows = [(x, x + abs(a), x - abs(b), x) for x, a, b in zip(c, g.normal(size=120), g.normal(size=120))]
    full, cut = S.tiers(bars_of(rows)), S.tiers(bars_of(rows[:80]))
    pick = ["term", "is_high", "bar_no", "price", "is_extreme"]
    known = {tuple(r) for r in full.filter("confirm_bar_no <= 79").select(*pick).collect()}
    assert known == {tuple(r) for r in cut.select(*pick).collect()} and known


def test_binary_records(spark):
    t = ticks(spark, [(1, 100.12345, 3, ""), (2, 99.5, 4, "")]).withColumn("flags", F.lit(0))
    blobs = io.encode_tick_blobs(t.coalesce(1)).withColumn("content", F.concat("content", F.lit(b"xyz")))
    d = io.decode_tick_blobs(blobs).collect()
    assert sorted((r.symbol, r.timestamp_us, r.last, r.volume) for r in d if not r.error) == [("X", 1_000_000, 100.12345, 3.0), ("X", 2_000_000, 99.5, 4.0)]
    assert [r.error for r in d if r.error] == ["short record of 3 bytes"]


def test_bad_alert_is_kept_as_an_error(spark):
    d = spark.createDataFrame([("{bad",), ('{"symbol":"X","timestamp_us":5,"action":"BUY","price":2.5,"qty":3}',)], "body string")
    rows = io.parse_alerts(d).collect()
    assert sum(r.error is not None for r in rows) == 1
    good = next(r for r in rows if r.error is None)
    assert (good.aggressor, good.last, good.volume) == ("BUY", 2.5, 3.0)
