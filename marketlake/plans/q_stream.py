"""Streaming queries: each one writes the given table as time-ordered files, streams them through the
operator with ``availableNow``, and reads the result back."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlake.functions.ticks import r
from marketlake.operators import structure as S
from marketlake.plans.q_data import folder
from marketlake.plans.q_zones import day_preds
from marketlake.plans.registry import query
from marketlake.plans.sqlviews import R, view
from marketlake.sources import io
from marketlake.sources import views as V
from marketlake.streaming import core as X

STEPS = 4


def feed(spark, df, part, parts=STEPS, more=()):
    """A stream of ``df`` and the steps by which its files arrive: ``part`` numbers them in time order.

    The table is scanned once; a step's rows lie in as many files as there are tasks, in any order.
    ``more`` holds conditions whose rows arrive once more, each in a step of its own at the end."""
    staged, path = folder(spark, "stream-staged"), folder(spark, "stream-in")
    df.withColumn("_step", part.cast("int")).write.partitionBy("_step").parquet(staged)
    stored = spark.read.parquet(staged)
    df.limit(0).write.parquet(path)  # the folder must be there before the stream is

    def step(condition):
        return lambda: stored.filter(condition).select(*df.columns).write.mode("append").parquet(path)

    return io.stream_ticks(spark, path, df.schema), [step(c) for c in [*(F.col("_step") == i for i in range(parts)), *more]]


def tick_feed(spark, sf, late=False):
    """Ticks in steps of equal time; with ``late`` some of the first step come again at the end."""
    t = V.ticks(spark, sf)
    sec = F.unix_micros("ts")
    lo, hi = t.agg(F.min(sec), F.max(sec)).first()
    part = F.least(F.floor((sec - lo) * STEPS / F.lit(max(hi - lo, 1))), F.lit(STEPS - 1))
    return feed(spark, t, part, more=[(F.col("_step") == 0) & (F.col("seq") % 100 == 7)] if late else [])


def bar_parts():
    return F.least(F.floor(F.col("bar_no") / 700), F.lit(STEPS - 1))


BAR_STREAM = f"""SELECT symbol, bucket, {R('open')} AS open, {R('high')} AS high, {R('low')} AS low, {R('close')} AS close, volume, tick_count FROM bars_h1
WHERE bucket + 3600 <= (SELECT epoch(max(ts)) - 10 FROM ticks)"""


def _bars(spark, sf, late):
    path = folder(spark, "stream-bars")
    ticks, steps = tick_feed(spark, sf, late)
    X.run_available(X.bars_stream(ticks, "H1"), path, steps=steps)
    return spark.read.parquet(path + "/data").select("symbol", "bucket", *[r(F.col(c)).alias(c) for c in ("open", "high", "low", "close")], "volume", "tick_count")


@query("r01_streaming_bars", BAR_STREAM, ("bars_h1", "ticks"))
def r01(spark, sf):
    return _bars(spark, sf, False)


@query("r02_late_ticks", BAR_STREAM, ("bars_h1", "ticks"))
def r02(spark, sf):
    """One more file of old ticks at the end: all behind the watermark, all dropped."""
    return _bars(spark, sf, True)


@query("r02_late_rows", """, p AS (SELECT symbol, seq, epoch(ts) AS s, least(floor((epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM ticks)) * 4 / (SELECT greatest(max(epoch_us(ts)) - min(epoch_us(ts)), 1) FROM ticks)), 3) AS part FROM ticks)
SELECT symbol, count(*) AS closed, sum((part = 0 AND seq % 100 = 7)::int)::bigint AS dropped FROM p WHERE floor(s / 3600) * 3600 + 3600 <= (SELECT epoch(max(ts)) - 10 FROM ticks) GROUP BY 1""", ("ticks",))
def r02l(spark, sf):
    """How many rows the closed bars hold and how many came too late for them."""
    path = folder(spark, "stream-late")
    ticks, steps = tick_feed(spark, sf, True)
    X.run_available(X.bars_stream(ticks, "H1"), path, steps=steps)
    t, sec = V.ticks(spark, sf), F.unix_micros("ts")
    lo, hi = t.agg(F.min(sec), F.max(sec)).first()
    again = (F.least(F.floor((sec - lo) * STEPS / F.lit(max(hi - lo, 1))), F.lit(STEPS - 1)) == 0) & (F.col("seq") % 100 == 7)
    return X.late_rows(t.unionByName(t.filter(again)), spark.read.parquet(path + "/data"), "H1")


@query("r03_streaming_flow", "SELECT symbol, seq, bucket, aggressor, delta, cvd FROM run_h1", ("run_h1",))
def r03(spark, sf):
    path = folder(spark, "stream-flow")
    ticks, steps = tick_feed(spark, sf)
    X.run_available(X.flow_stream(ticks), path, steps=steps)
    return spark.read.parquet(path + "/data").select("symbol", "seq", "bucket", "aggressor", "delta", "cvd")


@query("r04_streaming_structure", """SELECT symbol, 'SWING' AS kind, is_high AS up, bar_no, price AS near FROM piv_st
UNION ALL SELECT symbol, 'FVG', is_bullish, close_bar_no, near FROM fvgs_plain""", ("piv_st", "fvgs_plain"))
def r04(spark, sf):
    path = folder(spark, "stream-structure")
    bars, steps = feed(spark, V.day_bars(spark, sf), bar_parts())
    X.run_available(X.structure_stream(bars), path, steps=steps)
    return spark.read.parquet(path + "/data").select("symbol", "kind", "up", "bar_no", "near")


@query("r05_streaming_outcomes", "SELECT prediction_id, outcome, CASE outcome WHEN 'BSL_HIT' THEN u WHEN 'SSL_HIT' THEN d WHEN 'TIMEOUT' THEN bar_no + 10 END AS outcome_no FROM res10 WHERE outcome <> 'PENDING'", ("res10",))
def r05(spark, sf):
    path = folder(spark, "stream-outcomes")
    b = V.day_bars(spark, sf)
    p = day_preds(spark, sf, b).filter(F.col("bar_no").isNotNull()).select("symbol", F.lit(1).alias("kind"), "bar_no", "prediction_id", "predicted_bsl_level", "predicted_ssl_level")
    rows = b.select("symbol", F.lit(0).alias("kind"), "bar_no", "high", "low").unionByName(p, allowMissingColumns=True)
    rows, steps = feed(spark, rows, bar_parts())
    X.run_available(X.outcome_stream(rows, 10), path, steps=steps)
    return spark.read.parquet(path + "/data")


@query("r06_stale_periods", f"SELECT seq, symbol, {R('(epoch_us(nx) - epoch_us(ts)) / 1e6')} AS quiet FROM (SELECT *, lead(ts) OVER (PARTITION BY symbol ORDER BY ts, seq) AS nx FROM ticks) WHERE epoch_us(nx) - epoch_us(ts) > 3600000000", ("ticks",))
def r06(spark, sf):
    """Batch twin of the staleness alert: ticks followed by an hour of silence."""
    from marketlake.operators.blocks import time_block, with_previous

    t = with_previous(V.ticks(spark, sf), ["ts", "seq"], ["symbol"], ["ts", "seq"], time_block(F.col("ts"), 3600))
    quiet = (F.unix_micros("ts") - F.unix_micros("prev_ts")) / 1e6
    return t.withColumn("quiet", quiet).filter(F.col("quiet") > 3600).select(F.col("prev_seq").alias("seq"), "symbol", r(F.col("quiet")).alias("quiet"))


@query("r06_staleness_stream")
def r06s(spark, sf):
    path = folder(spark, "stream-stale")
    ticks, steps = tick_feed(spark, sf)
    X.run_available(X.staleness(ticks, 30), path, steps=steps)
    return spark.read.parquet(path + "/data").groupBy("symbol").agg(F.count(F.lit(1)).alias("alerts"))


view("gap_runs", """
SELECT * FROM (WITH RECURSIVE k AS (
 SELECT symbol, min(epoch_us(ts)) AS t FROM ticks GROUP BY 1
 UNION ALL SELECT k.symbol, (SELECT min(epoch_us(x.ts)) FROM ticks x WHERE x.symbol = k.symbol AND epoch_us(x.ts) >= k.t + 14400000000::bigint) FROM k WHERE k.t IS NOT NULL)
SELECT symbol, t FROM k WHERE t IS NOT NULL)""", ("ticks",))


@query("r07_minimum_gap", "SELECT symbol AS key, t FROM gap_runs", ("gap_runs",))
def r07(spark, sf):
    path = folder(spark, "stream-gap")
    ticks, steps = tick_feed(spark, sf)
    X.run_available(X.min_gap(ticks, "symbol", 14400), path, steps=steps)
    return spark.read.parquet(path + "/data").select("key", "t")


@query("r10_streaming_zone_status", """SELECT symbol, imb_no, max(lvl)::int AS depth FROM (SELECT z.symbol, z.imb_no, CASE WHEN CASE WHEN is_bullish THEN least(b.open, b.close) <= far ELSE greatest(b.open, b.close) >= far END THEN 4
 WHEN CASE WHEN is_bullish THEN b.low <= far ELSE b.high >= far END THEN 3 WHEN CASE WHEN is_bullish THEN b.low <= middle ELSE b.high >= middle END THEN 2 WHEN CASE WHEN is_bullish THEN b.low < near ELSE b.high > near END THEN 1 ELSE 0 END AS lvl
 FROM fvgs_plain z JOIN day_bars b ON b.symbol = z.symbol AND b.bar_no > z.close_bar_no) WHERE lvl > 0 GROUP BY 1, 2""", ("fvgs_plain", "day_bars"))
def r10s(spark, sf):
    path = folder(spark, "stream-zones")
    b = V.day_bars(spark, sf)
    z = S.fair_value_gaps(b, merge_vi=False).select("symbol", F.lit(1).alias("kind"), F.col("close_bar_no").alias("bar_no"), "imb_no", "is_bullish", "near", "middle", "far")
    rows = b.select("symbol", F.lit(0).alias("kind"), "bar_no", "open", "high", "low", "close").unionByName(z, allowMissingColumns=True)
    rows, steps = feed(spark, rows, bar_parts())
    X.run_available(X.zone_stream(rows), path, steps=steps)
    depth = F.array_position(F.array(*[F.lit(s) for s in S.STATES]), F.col("status")) - 1
    return spark.read.parquet(path + "/data").groupBy("symbol", "imb_no").agg(F.max(depth).cast("int").alias("depth"))


@query("r11_archival_batches", "SELECT symbol, count(*) AS n, sum(volume) AS volume FROM ticks WHERE ts < TIMESTAMP '2024-01-20' GROUP BY 1", ("ticks",))
def r11(spark, sf):
    """Rows due for the archive move in micro-batches; a repeated batch rewrites its own folder."""
    path = folder(spark, "stream-archive")
    ticks, steps = tick_feed(spark, sf)
    due = ticks.filter(F.col("ts") < F.lit("2024-01-20").cast("timestamp"))
    X.run_batches(due, path, X.append_batch(path + "/data"), steps=steps)
    return spark.read.parquet(path + "/data").groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.sum("volume").alias("volume"))


@query("r11_archive_ledger", """, p AS (SELECT *, cast(least(floor((epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM ticks)) * 4 / (SELECT greatest(max(epoch_us(ts)) - min(epoch_us(ts)), 1) FROM ticks)), 3) AS bigint) AS batch FROM ticks)
SELECT batch, CASE WHEN batch % 2 = 0 THEN 3 ELSE 1 END AS attempts, 'completed' AS status, count(*) AS n, sum(volume) AS volume FROM p GROUP BY 1""", ("ticks",))
def r11l(spark, sf):
    """Every second batch fails twice and is archived by the third attempt; no row is lost or doubled."""
    from marketlake.streaming import ledger

    path = folder(spark, "stream-ledger")
    ticks, steps = tick_feed(spark, sf)
    tries: dict[int, int] = {}

    def write(df, batch):
        tries[batch] = tries.get(batch, 0) + 1
        if batch % 2 == 0 and tries[batch] < 3:
            raise OSError("archive not reachable")
        X.append_batch(path + "/data")(df, batch)

    X.run_batches(ticks, path, ledger.recorded(spark, path, write), steps=steps)
    while ledger.retry(spark, path, write):
        pass
    rows = spark.read.parquet(path + "/data").groupBy(F.col("batch").cast("long").alias("batch")).agg(F.count(F.lit(1)).alias("n"), F.sum("volume").alias("volume"))
    return ledger.status(spark, path).drop("error").join(rows, "batch")


@query("r12_deduplicated_upsert", f"SELECT k, max(seq) AS seq, {R('arg_max(last, seq)')} AS last FROM (SELECT symbol || ':' || (seq % 50) AS k, seq, last FROM ticks) GROUP BY 1", ("ticks",))
def r12(spark, sf):
    path = folder(spark, "stream-upsert")
    ticks, steps = tick_feed(spark, sf)
    t = ticks.select(F.concat_ws(":", "symbol", (F.col("seq") % 50).cast("string")).alias("k"), "seq", "last")

    def write(df, batch):
        X.append_batch(path + "/data")(io.latest_per_key(df, ["k"], F.col("seq")), batch)

    X.run_batches(t, path, write, steps=steps)
    return X.latest_table(spark, path + "/data", ["k"], "seq").select("k", "seq", r(F.col("last")).alias("last"))


@query("s04_micro_batches", "SELECT symbol, count(*) AS n, sum(volume) AS volume FROM ticks GROUP BY 1", ("ticks",))
def s04(spark, sf):
    path = folder(spark, "stream-scan")
    ticks, steps = tick_feed(spark, sf)
    X.run_available(ticks.select("symbol", "seq", "volume"), path, steps=steps)
    return spark.read.parquet(path + "/data").groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.sum("volume").alias("volume"))


def _wm(column, table):
    """The last watermark in microseconds: whole milliseconds of the latest event time, less ten seconds."""
    return f"(SELECT (epoch_us(max({column})) // 1000 - 10000) * 1000 FROM {table})"


def time_parts(df, column):
    sec = F.unix_micros(column)
    lo, hi = df.agg(F.min(sec), F.max(sec)).first()
    return F.least(F.floor((sec - lo) * STEPS / F.lit(max((hi or 0) - (lo or 0), 1))), F.lit(STEPS - 1))


TTL = "CASE ns WHEN 'zone' THEN 86400 WHEN 'prediction' THEN 120 WHEN 'macro' THEN 60 WHEN 'calendar' THEN 21600 WHEN 'features' THEN 3600 ELSE 300 END"


@query("s16_ttl_stream", f"""
WITH e AS (SELECT *, ns || ':' || (event_id % 9)::varchar AS key, {TTL} * 1000000::bigint AS ttl FROM (SELECT *, ['zone','prediction','macro','calendar','features','metrics'][cast(event_id % 6 AS integer) + 1] AS ns FROM events)),
n AS (SELECT key, epoch_us(ts) AS t, ttl, lead(epoch_us(ts)) OVER (PARTITION BY key ORDER BY ts) AS nx FROM e)
SELECT key, t AS written, t + ttl AS expired FROM n WHERE coalesce(nx - t > ttl, t + ttl <= {_wm('ts', 'events')})""")
def s16s(spark, sf):
    """Cached entries that run out before they are written again."""
    from marketlake.streaming import timers as T

    path = folder(spark, "stream-ttl")
    e = V.events(spark, sf).select("event_id", "ts")
    rows, steps = feed(spark, e, time_parts(e, "ts"))
    ns = F.element_at(F.array(*[F.lit(x) for x in io.TTL_SECONDS]), (F.col("event_id") % 6 + 1).cast("int"))
    ttl = F.element_at(F.array(*[F.lit(x) for x in io.TTL_SECONDS.values()]), (F.col("event_id") % 6 + 1).cast("int"))
    X.run_available(T.expirations(rows, F.concat_ws(":", ns, (F.col("event_id") % 9).cast("string")), ttl), path, steps=steps)
    return spark.read.parquet(path + "/data").select("key", "written", "expired")


@query("r06_staleness_alerts", f"""
, n AS (SELECT symbol AS key, epoch_us(ts) AS t, lead(epoch_us(ts)) OVER (PARTITION BY symbol ORDER BY ts, seq) AS nx FROM ticks)
SELECT key, t AS written, t + 3600000000 AS expired FROM n WHERE coalesce(nx - t > 3600000000, t + 3600000000 <= {_wm('ts', 'ticks')})""", ("ticks",))
def r06a(spark, sf):
    """Staleness as a stream: a symbol is silent for an hour, whatever batch its ticks are in."""
    from marketlake.streaming import timers as T

    path = folder(spark, "stream-silent")
    ticks, steps = tick_feed(spark, sf)
    X.run_available(T.expirations(ticks, F.col("symbol"), F.lit(3600)), path, steps=steps)
    return spark.read.parquet(path + "/data").select("key", "written", "expired")


@query("r09_countdown_stream", f"""
SELECT phase, count(*) AS seconds, count(DISTINCT event_id) AS events, sum(to_event) AS to_event FROM (
  SELECT event_id, CASE WHEN s < due THEN 'PRE_NEWS' ELSE 'NEWS_WINDOW' END AS phase, due - s AS to_event FROM (
    SELECT event_id, cast(floor(epoch(scheduled_time)) AS bigint) AS due, unnest(range(cast(floor(epoch(scheduled_time)) AS bigint) - 900, cast(floor(epoch(scheduled_time)) AS bigint) + 301)) AS s FROM high)
  WHERE s * 1000000 <= {_wm('scheduled_time', 'calendar')} - 900000000) GROUP BY 1""", ("high", "calendar"))
def r09s(spark, sf):
    """The countdown grid as a stream: every second that the watermark has passed."""
    from marketlake.streaming import timers as T

    path = folder(spark, "stream-countdown")
    c = V.calendar(spark, sf).select("event_id", "impact", "scheduled_time")
    rows, steps = feed(spark, c, time_parts(c, "scheduled_time"))
    X.run_available(T.countdown_stream(rows), path, steps=steps)
    s = T.countdown_seconds(spark.read.parquet(path + "/data"))
    return s.groupBy("phase").agg(F.count(F.lit(1)).alias("seconds"), F.count_distinct("event_id").alias("events"), F.sum("to_event").alias("to_event"))
