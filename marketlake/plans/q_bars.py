"""Sources, ticks, bars and bar quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlake.functions import ticks as fn
from marketlake.functions.ticks import r
from marketlake.operators import bars as B
from marketlake.plans.registry import query
from marketlake.plans.sqlviews import R
from marketlake.sources import views as V

BAR_OUT = ["symbol", "tf", "bucket", "bar_no", "open", "high", "low", "close", "volume", "tick_count"]
BAR_SQL = f"symbol, tf, bucket, bar_no, {R('open', 9)} AS open, {R('high', 9)} AS high, {R('low', 9)} AS low, {R('close', 9)} AS close, volume, tick_count"


def bar_out(df, *more):
    return df.select("symbol", "tf", "bucket", "bar_no", *[r(F.col(c), 9).alias(c) for c in ("open", "high", "low", "close")], "volume", "tick_count", *more)


@query("a01_ohlcv", f"SELECT {BAR_SQL}, buy_volume, sell_volume, cvd FROM bars_h1", ("bars_h1",))
def a01(spark, sf):
    return bar_out(V.tick_bars(spark, sf, "H1"), "buy_volume", "sell_volume", "cvd")


@query("a01_ohlcv_daily_tape", f"SELECT {BAR_SQL} FROM day_bars", ("day_bars",))
def a01d(spark, sf):
    return bar_out(V.day_bars(spark, sf))


@query("a02_timeframe_fanout", f"SELECT {BAR_SQL} FROM bars_all", ("bars_all",))
def a02(spark, sf):
    return bar_out(V.quote_bars(spark, sf))


@query("a03_cascade_closure", """
SELECT symbol, tf, count(*) AS closed, max(bucket) AS last_bucket FROM (
  SELECT b.*, max(b.bucket + 60) FILTER (tf = 'M1') OVER (PARTITION BY symbol) AS now_at FROM bars_all b)
WHERE bucket + CASE tf WHEN 'M1' THEN 60 WHEN 'M5' THEN 300 WHEN 'M15' THEN 900 WHEN 'H1' THEN 3600 WHEN 'H4' THEN 14400 ELSE 86400 END <= now_at
GROUP BY 1, 2""", ("bars_all",))
def a03(spark, sf):
    """Bars whose end is reached by the newest M1 close of their symbol."""
    b = V.quote_bars(spark, sf).select("symbol", "tf", "bucket")
    clock = b.filter("tf = 'M1'").groupBy("symbol").agg((F.max("bucket") + 60).alias("now_at"))
    from marketlake.schemas import TIMEFRAMES

    secs = F.create_map(*[x for t, s in TIMEFRAMES.items() for x in (F.lit(t), F.lit(s).cast("bigint"))])
    closed = b.join(clock, "symbol").filter(F.col("bucket") + secs[F.col("tf")] <= F.col("now_at"))
    return closed.groupBy("symbol", "tf").agg(F.count(F.lit(1)).alias("closed"), F.max("bucket").alias("last_bucket"))


@query("a04_latest_bars", f"""SELECT {BAR_SQL} FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bucket DESC) AS rk FROM day_bars)
WHERE rk <= 10""", ("day_bars",))
def a04(spark, sf):
    return bar_out(B.latest(V.day_bars(spark, sf), 10))


@query("a04_bars_since", f"SELECT {BAR_SQL} FROM day_bars WHERE bucket >= 946684800", ("day_bars",))
def a04s(spark, sf):
    return bar_out(V.day_bars(spark, sf).filter(F.col("bucket") >= 946684800))


@query("a05_counters", """
SELECT 'ticks' AS counter, symbol AS name, count(*) AS n FROM ticks GROUP BY 2
UNION ALL SELECT 'bar_closes', symbol || ':' || tf, count(*) FROM bars_all GROUP BY 2
UNION ALL SELECT 'events_by_impact', impact, count(*) FROM calendar GROUP BY 2
UNION ALL SELECT 'predictions_by_direction', CASE WHEN p_bsl >= p_ssl AND p_bsl >= p_lateral THEN 'BSL' WHEN p_ssl >= p_lateral THEN 'SSL' ELSE 'LATERAL' END, count(*)
FROM predictions GROUP BY 2""", ("bars_all", "ticks", "calendar", "predictions"))
def a05(spark, sf):
    n = F.count(F.lit(1)).alias("n")
    t = V.ticks(spark, sf).groupBy(F.col("symbol").alias("name")).agg(n).withColumn("counter", F.lit("ticks"))
    b = V.quote_bars(spark, sf).groupBy(F.concat_ws(":", "symbol", "tf").alias("name")).agg(n).withColumn("counter", F.lit("bar_closes"))
    c = V.calendar(spark, sf).groupBy(F.col("impact").alias("name")).agg(n).withColumn("counter", F.lit("events_by_impact"))
    from marketlake.functions.scoring import dominant

    p = V.predictions(spark, sf).groupBy(dominant(F.col("p_bsl"), F.col("p_ssl"), F.col("p_lateral")).alias("name")).agg(n)
    p = p.withColumn("counter", F.lit("predictions_by_direction"))
    return t.unionByName(b).unionByName(c).unionByName(p).select("counter", "name", "n")


@query("p01_spread_mid", f"SELECT seq, symbol, {R('(ask - bid) * 10000', 4)} AS spread_pips, {R('(bid + ask) / 2')} AS mid FROM ticks", ("ticks",))
def p01(spark, sf):
    t = V.ticks(spark, sf)
    return t.select("seq", "symbol", r(fn.spread_pips(F.col("bid"), F.col("ask")), 4).alias("spread_pips"), r(fn.mid(F.col("bid"), F.col("ask"))).alias("mid"))


@query("p02_abnormal_spread", "SELECT symbol, count(*) AS ticks, count(*) FILTER (WHERE (ask - bid) * 10000 > 500) AS abnormal FROM ticks GROUP BY 1", ("ticks",))
def p02(spark, sf):
    wide = fn.spread_pips(F.col("bid"), F.col("ask")) > V.SPREAD_LIMIT
    return V.ticks(spark, sf).groupBy("symbol").agg(F.count(F.lit(1)).alias("ticks"), F.count_if(wide).alias("abnormal"))


@query("p03_aggressor", "SELECT seq, symbol, aggressor FROM enriched", ("enriched",))
def p03(spark, sf):
    return V.enriched(spark, sf).select("seq", "symbol", "aggressor")


@query("p04_signed_volume", "SELECT symbol, aggressor, count(*) AS n, sum(raw_delta) AS delta FROM enriched GROUP BY 1, 2", ("enriched",))
def p04(spark, sf):
    return V.enriched(spark, sf).groupBy("symbol", "aggressor").agg(F.count(F.lit(1)).alias("n"), F.sum("delta").alias("delta"))


@query("p06_bucket_time", """
SELECT seq, cast(floor(epoch(ts) / 60) * 60 AS bigint) AS m1, cast(floor(epoch(ts) / 900) * 900 AS bigint) AS m15,
       cast(floor(epoch(ts) / 14400) * 14400 AS bigint) AS h4 FROM ticks""", ("ticks",))
def p06(spark, sf):
    ts = F.col("ts")
    return V.ticks(spark, sf).select("seq", fn.bucket_epoch(ts, 60).alias("m1"), fn.bucket_epoch(ts, 900).alias("m15"), fn.bucket_epoch(ts, 14400).alias("h4"))


@query("p07_bar_shape", f"""
SELECT symbol, bar_no, {R('high - greatest(open, close)', 9)} AS upper_wick, {R('least(open, close) - low', 9)} AS lower_wick,
       {R('abs(close - open)', 9)} AS body, {R('high - low', 9)} AS bar_range, {R('(high + low + close) / 3', 7)} AS typical FROM day_bars""", ("day_bars",))
def p07(spark, sf):
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))  # noqa: E741
    return V.day_bars(spark, sf).select(
        "symbol", "bar_no", r(fn.upper_wick(o, h, c), 9).alias("upper_wick"), r(fn.lower_wick(o, l, c), 9).alias("lower_wick"),
        r(fn.body(o, c), 9).alias("body"), r(h - l, 9).alias("bar_range"), r(fn.typical(h, l, c), 7).alias("typical"))


@query("j23_missing_buckets", """
, ends AS (SELECT symbol, max(bucket) AS hi, min(bucket) AS lo FROM bars_h1 GROUP BY 1)
SELECT e.symbol, 'H1' AS tf, g.bucket FROM ends e,
  LATERAL (SELECT unnest(range(greatest(e.lo, e.hi - 199 * 3600), e.hi + 1, 3600)) AS bucket) g
WHERE NOT EXISTS (SELECT 1 FROM bars_h1 b WHERE b.symbol = e.symbol AND b.bucket = g.bucket)""", ("bars_h1",))
def j23(spark, sf):
    return B.missing_buckets(V.quote_bars(spark, sf, ["H1"]), "H1", 200)


@query("j23_desync_report", """
, ends AS (SELECT symbol, max(bucket) AS hi, min(bucket) AS lo FROM bars_h1 GROUP BY 1),
m AS (SELECT e.symbol, count(*) FILTER (b.bucket IS NULL) AS missing FROM
  (SELECT e.*, unnest(range(greatest(e.lo, e.hi - 199 * 3600), e.hi + 1, 3600)) AS bucket FROM ends e) e
  LEFT JOIN bars_h1 b ON b.symbol = e.symbol AND b.bucket = e.bucket GROUP BY 1)
SELECT symbol, 'H1' AS tf, missing, CASE WHEN missing = 0 THEN 'NONE' WHEN missing <= 5 THEN 'MINOR' ELSE 'MAJOR' END AS severity,
       missing <= 5 AS reliable FROM m""", ("bars_h1",))
def j23r(spark, sf):
    return B.desync_report(V.quote_bars(spark, sf, ["H1"]), "H1", 200)


@query("w33_tick_coverage", f"""
SELECT symbol, count(*) AS ticks, count(*) FILTER (WHERE gap > 300) AS gaps, {R('max(gap)')} AS max_gap,
       {R('100.0 * (1 - count(*) FILTER (WHERE gap > 300) / count(*))')} AS coverage,
       CASE WHEN 100.0 * (1 - count(*) FILTER (WHERE gap > 300) / count(*)) >= 95 THEN 'GOOD'
            WHEN 100.0 * (1 - count(*) FILTER (WHERE gap > 300) / count(*)) >= 80 THEN 'WARNING' ELSE 'POOR' END AS status
FROM (SELECT symbol, epoch_us(ts) / 1e6 - epoch_us(prev_ts) / 1e6 AS gap FROM ticks_prev) GROUP BY 1""", ("ticks_prev",))
def w33(spark, sf):
    c = B.tick_coverage(V.ticks(spark, sf), 300.0)
    return c.select("symbol", "ticks", "gaps", r(F.col("max_gap")).alias("max_gap"), r(F.col("coverage")).alias("coverage"), "status")


@query("w33_first_gaps", f"""
SELECT symbol, seq, gap_no, {R('gap')} AS gap_seconds FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) AS gap_no FROM (
    SELECT *, (epoch_us(ts) - epoch_us(prev_ts)) / 1e6 AS gap FROM ticks_prev) WHERE gap > 5) WHERE gap_no <= 10""", ("ticks_prev",))
def w33f(spark, sf):
    return B.first_gaps(V.ticks(spark, sf)).select("symbol", "seq", F.col("gap_no").cast("bigint").alias("gap_no"), r(F.col("gap_seconds")).alias("gap_seconds"))


@query("w33_out_of_order", """
SELECT symbol, count(*) AS late FROM (SELECT *, lag(ts) OVER (PARTITION BY symbol ORDER BY perm) AS p
  FROM (SELECT *, seq + CASE WHEN seq % 10 = 3 THEN 40 ELSE 0 END AS shifted, row_number() OVER (ORDER BY seq + CASE WHEN seq % 10 = 3 THEN 40 ELSE 0 END, seq) AS perm FROM ticks))
WHERE ts < p GROUP BY 1""", ("ticks",))
def w33o(spark, sf):
    """Arrival order with every tenth tick delayed by 40 places."""
    t = V.ticks(spark, sf)
    late = F.col("seq") + F.when(F.col("seq") % 10 == 3, 40).otherwise(0)
    return B.out_of_order(t.withColumn("seq", late * 2 + F.when(F.col("seq") % 10 == 3, 0).otherwise(1))).groupBy("symbol").agg(F.count(F.lit(1)).alias("late"))


@query("w34_tick_interval", f"""
SELECT seq, symbol, {R('CASE WHEN prev_ts IS NOT NULL THEN greatest((epoch_us(ts) - epoch_us(prev_ts)) / 1e6 / 60, 0) END', 9)} AS wait FROM ticks_prev""", ("ticks_prev",))
def w34(spark, sf):
    g = B.tick_gaps(V.ticks(spark, sf))
    wait = F.when(F.col("gap_seconds").isNotNull(), F.greatest(F.col("gap_seconds") / 60.0, F.lit(0.0)))
    return g.select("seq", "symbol", r(wait, 9).alias("wait"))


@query("w35_gap_fill", f"""
, nx AS (SELECT *, lead(bucket) OVER w AS nb, lead(open) OVER w AS n_open, lead(volume) OVER w AS n_vol FROM bars_h1 WINDOW w AS (PARTITION BY symbol ORDER BY bucket))
SELECT symbol, bucket, {R('open')} AS open, {R('high')} AS high, {R('low')} AS low, {R('close')} AS close, {R('volume')} AS volume, FALSE AS interpolated FROM bars_h1
UNION ALL
SELECT symbol, unnest(range(bucket + 3600, nb, 3600)), {R('close')}, {R('greatest(close, n_open)')}, {R('least(close, n_open)')}, {R('n_open')},
       {R('(volume + n_vol) / 2')}, TRUE FROM nx WHERE (nb - bucket) / 3600 - 1 BETWEEN 1 AND 5""", ("bars_h1",))
def w35(spark, sf):
    f = B.fill_gaps(V.quote_bars(spark, sf, ["H1"]), 5)
    return f.select("symbol", "bucket", *[r(F.col(c)).alias(c) for c in ("open", "high", "low", "close", "volume")], "interpolated")


@query("w36_incomplete_parents", """
SELECT symbol, 'D1' AS tf, cast(floor(bucket / 86400) * 86400 AS bigint) AS bucket, count(*) AS children, 24 - count(*) AS missing,
       CASE WHEN count(*) = 24 THEN 'COMPLETE' WHEN 24 - count(*) <= 5 THEN 'INCOMPLETE' ELSE 'UNRELIABLE' END AS state
FROM bars_h1 GROUP BY 1, 3""", ("bars_h1",))
def w36(spark, sf):
    return B.child_count(V.quote_bars(spark, sf, ["H1"]), "D1", "H1").select("symbol", "tf", "bucket", "children", "missing", "state")


@query("w37_sparse_zones", """
, m AS (SELECT symbol, cast(floor(epoch(ts) / 60) * 60 AS bigint) AS minute, count(*) AS n FROM ticks GROUP BY 1, 2),
marks AS (SELECT symbol, minute FROM m WHERE n >= 2 UNION ALL SELECT symbol, min(minute) - 60 FROM m GROUP BY 1 UNION ALL SELECT symbol, max(minute) + 60 FROM m GROUP BY 1)
SELECT symbol, prev + 60 AS zone_start, minute AS zone_end, cast((minute - prev) / 60 - 1 AS bigint) AS minutes FROM
  (SELECT *, lag(minute) OVER (PARTITION BY symbol ORDER BY minute) AS prev FROM marks) WHERE (minute - prev) / 60 - 1 > 30""", ("ticks",))
def w37(spark, sf):
    return B.sparse_zones(V.ticks(spark, sf), 2 / 60, 30)


@query("w37_rows_outside_sparse_zones", """
, m AS (SELECT symbol, cast(floor(epoch(ts) / 60) * 60 AS bigint) AS minute, count(*) AS n FROM ticks GROUP BY 1, 2),
marks AS (SELECT symbol, minute FROM m WHERE n >= 2 UNION ALL SELECT symbol, min(minute) - 60 FROM m GROUP BY 1 UNION ALL SELECT symbol, max(minute) + 60 FROM m GROUP BY 1),
z AS (SELECT symbol, prev + 60 AS a, minute AS b FROM (SELECT *, lag(minute) OVER (PARTITION BY symbol ORDER BY minute) AS prev FROM marks) WHERE (minute - prev) / 60 - 1 > 30)
SELECT seq, symbol FROM ticks t WHERE NOT EXISTS (SELECT 1 FROM z WHERE z.symbol = t.symbol AND epoch(t.ts) >= z.a AND epoch(t.ts) < z.b)""", ("ticks",))
def w37x(spark, sf):
    t = V.ticks(spark, sf)
    return B.outside_zones(t, B.sparse_zones(t, 2 / 60, 30)).select("seq", "symbol")
