"""Sources, sinks, joins of timeframes, retrieval and training sets."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from marketlake.functions import scoring as C
from marketlake.functions import ticks as fn
from marketlake.functions.ticks import r
from marketlake.operators import dataset as T
from marketlake.operators import flow as L
from marketlake.operators import indicators as I
from marketlake.operators import retrieval as N
from marketlake.operators import structure as S
from marketlake.operators import usv as U
from marketlake.operators.blocks import time_block
from marketlake.plans.registry import query
from marketlake.plans.sqlviews import R, view, wilder
from marketlake.session import shared_dir
from marketlake.sources import io
from marketlake.sources import views as V


def folder(spark, name):
    return f"{shared_dir(spark)}/marketlake/{name}-{uuid.uuid4().hex[:12]}"


@query("s01_tick_scan", "SELECT symbol, count(*) AS n, sum(volume) AS volume, max(seq) AS last_seq FROM ticks GROUP BY 1", ("ticks",))
def s01(spark, sf):
    """Ticks written to a symbol/year/month tree and scanned back whole."""
    path = folder(spark, "ticks")
    io.write_ticks(V.ticks(spark, sf), path)
    return io.read_ticks(spark, path).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.sum("volume").alias("volume"), F.max("seq").alias("last_seq"))


@query("s02_partition_pruning", "SELECT symbol, count(*) AS n FROM ticks WHERE symbol IN ('click', 'view') AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-21' GROUP BY 1", ("ticks",))
def s02(spark, sf):
    path = folder(spark, "ticks")
    io.write_ticks(V.ticks(spark, sf), path)
    t = io.read_ticks(spark, path, "2024-01-10", "2024-01-20").filter(F.col("symbol").isin("click", "view"))
    return t.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@query("s03_time_range", "SELECT seq, symbol FROM ticks WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12 12:00:00'", ("ticks",))
def s03(spark, sf):
    t = V.ticks(spark, sf)
    return t.filter(F.col("ts").between(F.lit("2024-01-10").cast("timestamp"), F.lit("2024-01-12 12:00:00").cast("timestamp"))).select("seq", "symbol")


@query("s05_conformance", f"SELECT seq, CASE WHEN seq % 3 = 0 THEN 'XAUUSD' ELSE symbol END AS symbol, {R('CASE WHEN seq % 4 = 0 THEN (bid + ask) / 2 ELSE last END')} AS last, CASE WHEN seq % 5 = 0 THEN 10.0 ELSE volume END AS volume, 0 AS flags FROM ticks", ("ticks",))
def s05(spark, sf):
    s = F.col("seq")
    holes = V.ticks(spark, sf).select(F.when(s % 3 != 0, F.col("symbol")).alias("symbol"), "ts", "seq", "bid", "ask",
                                      F.when(s % 4 == 0, 0.0).otherwise(F.col("last")).alias("last"), F.when(s % 5 != 0, F.col("volume")).alias("volume"))
    return io.conform_ticks(holes).select("seq", "symbol", r(F.col("last")).alias("last"), "volume", "flags")


@query("s06_binary_decode", f"SELECT symbol, epoch_us(ts) AS timestamp_us, {R('round(last * 1e5) / 1e5', 5)} AS last, volume, 0 AS flags FROM ticks", ("ticks",))
def s06(spark, sf):
    blobs = io.encode_tick_blobs(V.ticks(spark, sf))
    d = io.decode_tick_blobs(blobs).filter(F.col("error").isNull())
    return d.select("symbol", "timestamp_us", r(F.col("last"), 5).alias("last"), "volume", "flags")


BINARY = f"SELECT symbol, epoch_us(ts) AS timestamp_us, {R('round(last * 1e5) / 1e5', 5)} AS last, volume, 0 AS flags FROM ticks"


@query("s06_binary_files", BINARY, ("ticks",))
def s06f(spark, sf):
    """Record files written by the data source's writer and read back, several tasks to a file."""
    from marketlake.sources import records

    records.register(spark)
    path = folder(spark, "records")
    t = V.ticks(spark, sf).select("symbol", F.unix_micros("ts").alias("timestamp_us"), "bid", "ask", "last", "volume", "flags")
    t.write.format("tick_records").mode("append").save(path)
    d = spark.read.format("tick_records").load(path).filter(F.col("error").isNull())
    return d.select("symbol", "timestamp_us", r(F.col("last"), 5).alias("last"), "volume", "flags")


@query("s07_alert_source", f"""SELECT symbol, timestamp_us, action, {R('last')} AS last, volume, aggressor FROM (
 SELECT symbol, epoch_us(ts) AS timestamp_us, ['buy', 'sell', 'ohlcv_update', 'close'][cast(seq % 4 AS integer) + 1] AS action, CASE seq % 4 WHEN 3 THEN 0 ELSE last END AS last,
 CASE seq % 4 WHEN 3 THEN 0 ELSE volume END AS volume, CASE seq % 4 WHEN 0 THEN 'BUY' WHEN 1 THEN 'SELL' ELSE 'UNKNOWN' END AS aggressor FROM ticks)""", ("ticks",))
def s07(spark, sf):
    t = V.ticks(spark, sf)
    k = F.col("seq") % 4
    action = F.when(k == 0, "BUY").when(k == 1, "SELL").when(k == 2, "ohlcv_update").otherwise("close")
    trade = F.to_json(F.struct(F.col("symbol"), F.unix_micros("ts").alias("timestamp_us"), action.alias("action"), F.col("last").alias("price"), F.col("volume").alias("qty")))
    bar = F.to_json(F.struct(F.col("symbol").alias("ticker"), F.unix_micros("ts").alias("timestamp_us"), action.alias("strategy"), F.struct(F.col("last").alias("close"), "volume").alias("ohlcv")))
    body = t.select(F.when(k == 2, bar).otherwise(trade).alias("body"))
    a = io.parse_alerts(body).filter(F.col("error").isNull())
    return a.select("symbol", "timestamp_us", "action", r(F.col("last")).alias("last"), "volume", "aggressor")


@query("s08_calendar_feed", f"""SELECT substr(md5(title || ':' || strftime(scheduled_time, '%Y-%m-%dT%H:%M:%S')), 1, 16) AS event_id, currency, impact, cast(floor(epoch(scheduled_time)) AS bigint) AS at, {R('actual * 1000')} AS actual FROM
 (SELECT currency || ' EV' || (event_id % 8) AS title, currency, impact, scheduled_time, round(actual, 2) AS actual FROM calendar) WHERE impact <> 'LOW' AND currency IN ('USD', 'EUR', 'GBP')""", ("calendar",))
def s08(spark, sf):
    c = V.calendar(spark, sf)
    title = F.concat("currency", F.lit(" EV"), (F.col("event_id") % 8).cast("string"))
    item = F.struct(title.alias("title"), F.lit("XX").alias("country"), F.lower("impact").alias("impact"), F.date_format("scheduled_time", "EEE, d MMM yyyy HH:mm:ss 'GMT'").alias("pubDate"),
                    F.concat(F.lit("Forecast: 1,000.5<br>Previous: n/a<br>Actual: "), F.format_number(F.round(F.col("actual"), 2) * 1000, 2)).alias("description"))
    # One small feed document per day, as a provider would send it.
    feed = c.groupBy(F.to_date("scheduled_time").alias("d"), F.pmod("event_id", F.lit(16))).agg(F.to_json(F.struct(F.struct(F.collect_list(item).alias("item")).alias("channel"))).alias("body"))
    p = io.parse_calendar(feed, ["USD", "EUR", "GBP"])
    return p.select("event_id", "currency", "impact", F.unix_seconds("scheduled_time").alias("at"), r(F.col("actual")).alias("actual"))


@query("s09_split_scan", "SELECT label, count(*) AS n FROM predictions WHERE bar_close_time < TIMESTAMP '1998-01-01' GROUP BY 1", ("predictions",))
def s09(spark, sf):
    path = folder(spark, "features")
    p = V.predictions(spark, sf).select("prediction_id", F.array("p_bsl", "p_ssl", "p_lateral").alias("x"), "label", "bar_close_time")
    io.write_split(T.split_by_date(p, F.col("bar_close_time"), "1998-01-01", "2000-01-01"), path)
    return spark.read.parquet(path).filter("split = 'train'").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("s10_inferred_columns", f"SELECT symbol, count(*) AS n, {R('sum(close)', 2)} AS close, sum(volume) AS volume FROM day_bars GROUP BY 1", ("day_bars",))
def s10(spark, sf):
    b = V.day_bars(spark, sf)
    foreign = b.select("symbol", F.col("bucket").alias("DateTime"), F.col("open").alias("O"), F.col("high").alias("HIGH"), F.col("low").alias("Low"), F.col("close").alias("Close"), F.col("volume").alias("Vol"))
    return io.infer_columns(foreign).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), r(F.sum("close"), 2).alias("close"), F.sum("volume").alias("volume"))


view("cal_old", "SELECT event_id % 500 AS k, event_id AS v, actual FROM calendar")
VIEW_UPSERT = "SELECT k, max(v) AS v, arg_max(actual, v) AS actual FROM (SELECT event_id % 500 AS k, event_id AS v, actual FROM calendar) GROUP BY 1"


@query("s12_keyed_upsert", VIEW_UPSERT, ("calendar",))
def s12(spark, sf):
    c = V.calendar(spark, sf).select((F.col("event_id") % 500).alias("k"), F.col("event_id").alias("v"), "actual")
    old, new = c.filter(F.col("v") % 2 == 0), c.filter(F.col("v") % 2 == 1)
    return io.upsert(io.latest_per_key(old, ["k"], F.col("v")), new, ["k"], F.col("v"))


@query("s13_conditional_update", "SELECT prediction_id, CASE WHEN prediction_id % 3 = 0 THEN 'TIMEOUT' WHEN prediction_id % 2 = 0 THEN 'BSL_HIT' ELSE 'PENDING' END AS outcome FROM predictions", ("predictions",))
def s13(spark, sf):
    i = F.col("prediction_id")
    t = V.predictions(spark, sf).select("prediction_id", F.when(i % 3 == 0, "TIMEOUT").otherwise("PENDING").alias("outcome"))
    u = t.filter(i % 2 == 0).select("prediction_id", F.lit("BSL_HIT").alias("outcome"))
    return io.set_where_pending(t, u, "prediction_id", "outcome")


@query("s14_report_sink", "SELECT regime, count(*) AS n FROM predictions GROUP BY 1", ("predictions",))
def s14(spark, sf):
    path = folder(spark, "report")
    io.write_report(V.predictions(spark, sf).groupBy("regime").agg(F.count(F.lit(1)).alias("n")), path)
    return spark.read.schema("regime string, n long").json(path)


@query("s15_archive_retention", """SELECT part, count(*) AS n FROM (SELECT CASE WHEN label <> 2 AND bar_close_time < TIMESTAMP '2000-01-01' - INTERVAL 90 DAY THEN 'archive' ELSE 'keep' END AS part FROM predictions
 UNION ALL SELECT 'retained' FROM predictions WHERE bar_close_time >= TIMESTAMP '2000-01-01' - INTERVAL 365 DAY AND (label <> 2 OR bar_close_time >= TIMESTAMP '2000-01-01' - INTERVAL 30 DAY)) GROUP BY 1""", ("predictions",))
def s15(spark, sf):
    p = V.predictions(spark, sf)
    now, at, done = F.lit("2000-01-01").cast("timestamp"), F.col("bar_close_time"), F.col("label") != 2
    old, keep = io.split_expired(p, done, at, now)
    kept = io.retain(p, done, at, now, 365, 30)
    path = folder(spark, "archive")
    io.append_archive(old, path, at)
    parts = spark.read.schema(old.schema).parquet(path).select(F.lit("archive").alias("part")).unionByName(keep.select(F.lit("keep").alias("part"))).unionByName(kept.select(F.lit("retained").alias("part")))
    return parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("s16_ttl_view", """SELECT ns, count(*) AS n FROM (SELECT *, ['zone','prediction','macro','calendar','features','metrics'][cast(event_id % 6 AS integer) + 1] AS ns FROM events)
 WHERE epoch_us(TIMESTAMP '2024-01-20 12:00:00') - epoch_us(ts) <= 1000000::bigint * CASE ns WHEN 'zone' THEN 86400 WHEN 'prediction' THEN 120 WHEN 'macro' THEN 60 WHEN 'calendar' THEN 21600 WHEN 'features' THEN 3600 ELSE 300 END GROUP BY 1""")
def s16(spark, sf):
    ns = F.element_at(F.array(*[F.lit(x) for x in io.TTL_SECONDS]), (F.col("event_id") % 6 + 1).cast("int"))
    e = V.events(spark, sf).withColumn("ns", ns)
    return io.live_rows(e, F.col("ns"), F.col("ts"), F.lit("2024-01-20 12:00:00").cast("timestamp")).groupBy("ns").agg(F.count(F.lit(1)).alias("n"))


@query("u01_concatenate", "SELECT count(*) AS n, count(bid) AS quoted, sum(volume) AS volume FROM (SELECT bid, volume FROM ticks UNION ALL SELECT NULL, volume FROM day_trades)", ("ticks", "day_trades"))
def u01(spark, sf):
    a = V.ticks(spark, sf).select("symbol", "ts", "last", "volume", "bid")
    b = V.day_trades(spark, sf).select("symbol", "ts", "last", "volume")
    return a.unionByName(b, allowMissingColumns=True).agg(F.count(F.lit(1)).alias("n"), F.count("bid").alias("quoted"), F.sum("volume").alias("volume"))


@query("u03_known_minus_current", "SELECT event_id FROM calendar WHERE event_id % 11 = 0", ("calendar",))
def u03(spark, sf):
    ids = V.calendar(spark, sf).select("event_id")
    return ids.exceptAll(ids.filter(F.col("event_id") % 11 != 0))


# ---------------------------------------------------------------- timeframes at a moment

CLOSED = {"M1": 60, "M5": 300, "M15": 900, "H1": 3600, "H4": 14400, "D1": 86400}
view("usv", "SELECT t.*, " + ", ".join(f"{k}.close AS close_{k}, {k}.atr AS atr_{k}, {k}.bucket AS bucket_{k}" for k in CLOSED) + " FROM ticks t " + " ".join(
    f"ASOF LEFT JOIN (SELECT symbol, bucket, close, atr, to_timestamp(bucket + {s}) AT TIME ZONE 'UTC' AS closed_at FROM {k.lower()}_atr2) {k} ON t.symbol = {k}.symbol AND t.ts >= {k}.closed_at" for k, s in CLOSED.items()),
    ("ticks", *[f"{k.lower()}_atr2" for k in CLOSED]))
from marketlake.plans.sqlviews import tr_view  # noqa: E402

for _k in CLOSED:
    view(f"{_k.lower()}_tr2", tr_view(f"bars_{_k.lower()}"), (f"bars_{_k.lower()}",))
    view(f"{_k.lower()}_atr2", wilder(f"{_k.lower()}_tr2", {"atr": "tr"}, 14, 0, True), (f"{_k.lower()}_tr2",))


def usv(spark, sf):
    t = V.ticks(spark, sf)
    return U.closed_context(t, V.quote_bars(spark, sf).persist())


@query("j01_closed_timeframes", f"SELECT seq, {', '.join(f'bucket_{k}' for k in CLOSED)}, {', '.join(R(f'close_{k}') + f' AS close_{k}' for k in CLOSED)} FROM usv", ("usv",))
def j01(spark, sf):
    u = usv(spark, sf)
    return u.select("seq", *[F.col(f"{k}.bucket").alias(f"bucket_{k}") for k in CLOSED], *[r(F.col(f"{k}.close")).alias(f"close_{k}") for k in CLOSED])


@query("j02_context_attach", f"SELECT u.seq, session, {R('atr_H1', 5)} AS atr_h1, {R('atr_D1', 5)} AS atr_d1 FROM usv u JOIN sess USING (seq)", ("usv", "sess"))
def j02(spark, sf):
    from marketlake.operators.macro import sessions

    u = sessions(usv(spark, sf))
    return u.select("seq", "session", r(F.col("H1.atr"), 5).alias("atr_h1"), r(F.col("D1.atr"), 5).alias("atr_d1"))


MISSING = " + ".join(f"(close_{k} IS NULL)::int" for k in CLOSED)


@query("p27_incomplete_timeframes", f"SELECT seq, ({MISSING})::int AS missing_tfs, {R(f'greatest(1.0 - 0.1 * ({MISSING}), 0)')} AS confidence_multiplier, ({MISSING}) > 0 AS incomplete_mtf FROM usv", ("usv",))
def p27(spark, sf):
    return U.incomplete_penalty(U.as_maps(usv(spark, sf))).select("seq", "missing_tfs", r(F.col("confidence_multiplier")).alias("confidence_multiplier"), "incomplete_mtf")


view("day_ema50", wilder("day_bars", {"ema": "close"}, 50, 0, False, 1 - 2 / 51, 2 / 51), ("day_bars",))
view("bias", """
SELECT e.symbol, e.bar_no, CASE WHEN close > ema AND up THEN 'BULLISH' WHEN close < ema AND dn THEN 'BEARISH' ELSE 'NEUTRAL' END AS bias FROM day_ema50 e JOIN
 (SELECT b.symbol, b.bar_no, coalesce(bool_or(t.is_high), FALSE) AS up, coalesce(bool_or(NOT t.is_high), FALSE) AS dn FROM day_bars b LEFT JOIN triggers t ON t.symbol = b.symbol AND t.trigger_no BETWEEN b.bar_no - 9 AND b.bar_no GROUP BY 1, 2) s USING (symbol, bar_no)""", ("day_ema50", "day_bars", "triggers"))


@query("p21_rule_fallback", f"SELECT symbol, bar_no, bias, CASE bias WHEN 'BULLISH' THEN 0.60 WHEN 'BEARISH' THEN 0.25 ELSE 0.35 END::double AS p_bsl, CASE bias WHEN 'BULLISH' THEN 0.25 WHEN 'BEARISH' THEN 0.60 ELSE 0.35 END::double AS p_ssl FROM bias", ("bias",))
def p21(spark, sf):
    from marketlake.operators.blocks import over_blocks

    b = V.day_bars(spark, sf)
    t = S.mss_triggers(S.swings(b), b).groupBy("symbol", "tf", F.col("trigger_no").alias("bar_no")).agg(F.max(F.col("is_high").cast("int")).alias("u"), F.max((~F.col("is_high")).cast("int")).alias("d"))
    e = I.ema(b, 50).join(t, ["symbol", "tf", "bar_no"], "left")
    e = over_blocks(e, 10, lambda x, w: x.select("*", F.max("u").over(w.rowsBetween(-9, 0)).alias("up"), F.max("d").over(w.rowsBetween(-9, 0)).alias("dn")))
    bias = F.when((F.col("close") > F.col("ema_50")) & (F.col("up") == 1), "BULLISH").when((F.col("close") < F.col("ema_50")) & (F.col("dn") == 1), "BEARISH").otherwise("NEUTRAL")
    e = e.withColumn("bias", bias)
    return e.select("symbol", "bar_no", "bias", C.fallback_probability(F.col("bias"), 0).alias("p_bsl"), C.fallback_probability(F.col("bias"), 1).alias("p_ssl"))


# ---------------------------------------------------------------- retrieval

view("cosines", """
SELECT q.vec_id AS query_id, c.vec_id, round(list_cosine_similarity(q.embedding::double[], c.embedding::double[]), 9) AS cosine, (c.vec_id % 60)::double AS age, c.vec_id % 2 AS y
FROM embeddings q JOIN embeddings c ON q.label = c.label AND q.vec_id <> c.vec_id""")


@query("j24_similar_situations", f"SELECT query_id, vec_id, {R('cosine', 5)} AS cosine, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id)::int AS rank FROM cosines) WHERE rank <= 5", ("cosines",))
def j24(spark, sf):
    v = V.vectors(spark, sf)
    return N.topk_similarity(v, v, 5).select("query_id", "vec_id", r(F.col("cosine"), 5).alias("cosine"), "rank")


@query("j28_neighbour_hold", f"SELECT query_id, {R('sum(cosine * y) / sum(cosine)', 5)} AS p_hold, count(*) AS neighbours FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS rank FROM cosines) WHERE rank <= 5 AND cosine > 0 GROUP BY 1", ("cosines",))
def j28(spark, sf):
    v = V.vectors(spark, sf)
    y = v.select("vec_id", (F.col("vec_id") % 2).alias("y"))
    return N.knn_hold(N.topk_similarity(v, v, 5), y).select("query_id", r(F.col("p_hold"), 5).alias("p_hold"), "neighbours")


@query("k05_reranked_precedents", f"""
SELECT query_id, vec_id, {R('cosine', 5)} AS cosine, {R('score', 5)} AS score, rank, NOT many AS fallback FROM (
 SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id)::int AS rank FROM (
  SELECT *, count(*) FILTER (cosine >= 0.20) OVER (PARTITION BY query_id) >= 3 AS many, 0.7 * cosine + 0.3 / (1 + age) AS score FROM cosines) WHERE cosine >= CASE WHEN many THEN 0.20 ELSE 0.15 END) WHERE rank <= 3""", ("cosines",))
def k05(spark, sf):
    v = V.vectors(spark, sf)
    p = N.precedents(v, v, 3, 0.20, 0.15)
    return p.select("query_id", "vec_id", r(F.col("cosine"), 5).alias("cosine"), r(F.col("score"), 5).alias("score"), "rank", "fallback")


@query("m12_triplets", f"""SELECT p.query_id AS anchor, p.vec_id AS positive, n.vec_id AS negative, {R('p.cosine', 5)} AS pos_cos, {R('n.cosine', 5)} AS neg_cos FROM
 (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS rk FROM cosines) p JOIN (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine, vec_id) AS rk FROM cosines) n USING (query_id)
 WHERE p.rk = 1 AND n.rk = 1 AND p.cosine >= 0.2 AND n.cosine <= -0.1""", ("cosines",))
def m12(spark, sf):
    t = N.triplets(V.vectors(spark, sf), 0.2, -0.1)
    return t.select("anchor", "positive", "negative", r(F.col("pos_cos"), 5).alias("pos_cos"), r(F.col("neg_cos"), 5).alias("neg_cos"))


@query("j25_snapshot_lookup", "SELECT p.prediction_id, b.bar_no FROM predictions p LEFT JOIN day_bars b ON b.symbol = p.symbol AND b.bucket = cast(epoch(p.bar_close_time) AS bigint)", ("predictions", "day_bars"))
def j25(spark, sf):
    p = V.predictions(spark, sf).withColumn("bucket", F.unix_seconds("bar_close_time"))
    return p.join(V.day_bars(spark, sf).select("symbol", "bucket", "bar_no"), ["symbol", "bucket"], "left").select("prediction_id", "bar_no")


# ---------------------------------------------------------------- scalar functions

@query("f17_unit_vectors", f"SELECT vec_id, {R('list_dot_product(embedding::double[], embedding::double[])', 5)} AS norm2, {R('embedding[1]::double / sqrt(list_dot_product(embedding::double[], embedding::double[]))', 5)} AS first FROM embeddings")
def f17(spark, sf):
    v = V.vectors(spark, sf).withColumn("d", F.col("embedding").cast("array<double>"))
    n2 = F.aggregate(F.zip_with("d", "d", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return v.withColumn("n2", n2).select("vec_id", r(F.col("n2"), 5).alias("norm2"), r(F.col("d")[0] / F.sqrt("n2"), 5).alias("first"))


@query("f18_recency", f"SELECT event_id, cast(floor((epoch(TIMESTAMP '2024-02-01') - floor(epoch(ts))) / 86400) AS bigint) AS days, {R('1.0 / (1 + floor((epoch(TIMESTAMP ' + repr('2024-02-01') + ') - floor(epoch(ts))) / 86400))')} AS weight FROM events")
def f18(spark, sf):
    d = N.days_since(F.col("ts"), F.lit("2024-02-01").cast("timestamp")).cast("bigint")
    return V.events(spark, sf).select("event_id", d.alias("days"), r(1.0 / (1 + d)).alias("weight"))


@query("f16_number_extraction", f"SELECT event_id, {R('round(value, 2)', 2)} AS number FROM events")
def f16(spark, sf):
    text = F.concat(F.lit("Actual: "), F.format_number(F.round("value", 2), 2), F.lit("%"))
    return V.events(spark, sf).select("event_id", r(io.extract_number(text), 2).alias("number"))


@query("f19_json_columns", "SELECT event_id, cast(json_extract(props, '$.k') AS bigint) AS k, cast(json_extract(props, '$.k') AS bigint) * 2 AS twice FROM events")
def f19(spark, sf):
    e = V.events(spark, sf).withColumn("j", F.to_json(F.array(F.from_json("props", "k long"), F.struct((F.get_json_object("props", "$.k").cast("long") * 2).alias("k")))))
    back = F.from_json("j", "array<struct<k: long>>")
    return e.select("event_id", back[0]["k"].alias("k"), back[1]["k"].alias("twice"))


@query("f20_keys", "SELECT seq, symbol || ':M1:' || cast(floor(epoch(ts) / 60) * 60 AS bigint) AS key, cast(floor(epoch(ts) / 300) AS bigint) AS cache_bucket FROM ticks", ("ticks",))
def f20(spark, sf):
    m5 = fn.bucket_epoch(F.col("ts"), 300)
    return V.ticks(spark, sf).select("seq", fn.symbol_bar_key(F.col("symbol"), F.lit("M1"), fn.bucket_epoch(F.col("ts"), 60)).alias("key"), (m5 / 300).cast("bigint").alias("cache_bucket"))


@query("f22_timestamp_units", "SELECT event_id, cast(floor(epoch(ts)) AS bigint) * 1000 AS ms FROM events")
def f22(spark, sf):
    t = F.when(F.col("event_id") % 2 == 0, F.unix_seconds("ts")).otherwise(F.unix_seconds("ts") * 1000)
    return V.events(spark, sf).select("event_id", fn.milliseconds(t).alias("ms"))


# ---------------------------------------------------------------- training sets

view("tick_no", "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) - 1 AS no FROM ticks", ("ticks",))


def tick_sequences(spark, sf, length=128):
    return T.sequences(T.tick_rows(V.ticks(spark, sf)), length, T.TICK_ROW, ["symbol"], ["ts", "seq"], time_block(F.col("ts"), 3600))


def column_sums(names, n=5):
    """The sum of each column of a sequence."""
    def total(i):
        return F.aggregate("sequence", F.lit(0.0), lambda a, x: a + x[i])

    return [r(total(i), n).alias(f"sum_{c}") for i, c in enumerate(names)]


@query("m01_tick_sequences", f"""SELECT symbol, no // 128 AS seq_no, count(*) AS rows, {R('arg_min(last, no)')} AS first_last, {', '.join(f"{R(f'sum({e})', 5)} AS sum_{c}" for c, e in zip(T.TICK_ROW, ('last', 'last', 'last', 'last', 'volume', 'ask - bid', 'bid', 'ask')))} FROM tick_no GROUP BY 1, 2 HAVING count(*) = 128""", ("tick_no",))
def m01(spark, sf):
    s = tick_sequences(spark, sf)
    return s.select("symbol", "seq_no", F.size("sequence").cast("bigint").alias("rows"), r(F.col("sequence")[0][3]).alias("first_last"), *column_sums(T.TICK_ROW))


BAR_SQL = ("open", "high", "low", "close", "volume", "high - greatest(open, close)", "least(open, close) - low", "abs(close - open)", "high - low", "(high + low + close) / 3", "0", "tick_count")


@query("m02_timeframe_sequences", f""", n AS (SELECT symbol, tf, bar_no // 30 AS b FROM bars_all GROUP BY ALL HAVING count(*) = 30), c AS (SELECT symbol, min(k) AS m FROM (SELECT symbol, tf, count(*) AS k FROM n GROUP BY 1, 2) GROUP BY 1)
SELECT n.symbol, n.tf, n.b AS seq_no, {', '.join(f"{R(f'sum({e})', 4)} AS sum_{c}" for c, e in zip(T.BAR_ROW, BAR_SQL))}
FROM n JOIN c USING (symbol) JOIN bars_all a ON a.symbol = n.symbol AND a.tf = n.tf AND a.bar_no // 30 = n.b WHERE n.b < c.m GROUP BY 1, 2, 3""", ("bars_all",))
def m02(spark, sf):
    """All twelve columns of all six timeframes, cut to the shortest of them."""
    b = T.bar_rows(V.quote_bars(spark, sf))
    s = T.sequences(b, 30, T.BAR_ROW, ["symbol", "tf"], ["bar_no"], F.floor(F.col("bar_no") / 4096).cast("bigint"))
    return T.equal_lengths(s, ["symbol"], "tf").select("symbol", "tf", "seq_no", *column_sums(T.BAR_ROW, 4))


FEATS = list(V.DRIFT_COLUMNS)


@query("m03_robust_scaling", "SELECT feature, " + R("quantile_cont(v, 0.5)") + " AS center, " + R("quantile_cont(v, 0.95) - quantile_cont(v, 0.05)") + " AS scale FROM long_f WHERE is_ref GROUP BY 1", ("long_f",))
def m03(spark, sf):
    f = T.robust_fit(V.drift_sets(spark, sf)[0], FEATS)
    return f.select("feature", r(F.col("center")).alias("center"), r(F.col("scale")).alias("scale"))


@query("m03_scaled_features", ", fit AS (SELECT feature, quantile_cont(v, 0.5) AS c, quantile_cont(v, 0.95) - quantile_cont(v, 0.05) AS s FROM long_f WHERE is_ref GROUP BY 1) SELECT " + ", ".join(
    R(f"avg((v - c) / CASE WHEN s > 0 THEN s ELSE 1 END) FILTER (feature = '{f}')", 5) + f" AS {f}" for f in FEATS) + " FROM long_f JOIN fit USING (feature) WHERE NOT is_ref", ("long_f",))
def m03s(spark, sf):
    ref, cur = V.drift_sets(spark, sf)
    return T.robust_scale(cur, T.robust_fit(ref, FEATS), FEATS).agg(*[r(F.avg(c), 5).alias(c) for c in FEATS])


@query("k06_temporal_split", """SELECT split, count(*) AS n, min(prediction_id) AS low FROM (SELECT *, CASE WHEN no < floor(cnt * 0.70) THEN 'train' WHEN no < floor(cnt * 0.85) THEN 'val' ELSE 'test' END AS split FROM (
 SELECT *, row_number() OVER (ORDER BY bar_close_time, prediction_id) - 1 AS no, count(*) OVER () AS cnt FROM predictions)) GROUP BY 1""", ("predictions",))
def k06(spark, sf):
    s = T.split_by_order(V.predictions(spark, sf), ["bar_close_time", "prediction_id"], time_block(F.col("bar_close_time"), 86400))
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("prediction_id").alias("low"))


@query("k07_stratified_cap", "SELECT regime, prediction_id FROM (SELECT *, row_number() OVER (PARTITION BY regime ORDER BY md5(prediction_id::varchar), prediction_id) AS rk FROM predictions) WHERE rk <= 5000 // 5", ("predictions",))
def k07(spark, sf):
    return T.stratified_cap(V.predictions(spark, sf), "regime", 5000, F.col("prediction_id")).select("regime", "prediction_id")


@query("k08_adaptive_sampling", """SELECT seq, k AS sample_k FROM (SELECT t.seq, CASE WHEN n <= 10 THEN 1 ELSE least(10, 1 + ceil((n - 10) * 9 / 10.0)) END::bigint AS k FROM ticks t JOIN
 (SELECT floor(epoch(ts) / 3600) AS h, count(*) AS n FROM ticks GROUP BY 1) c ON floor(epoch(t.ts) / 3600) = c.h) WHERE seq % k = 0""", ("ticks",))
def k08(spark, sf):
    return T.adaptive_sample(V.ticks(spark, sf), fn.bucket_epoch(F.col("ts"), 3600), F.col("seq"), 20, 10).select("seq", "sample_k")
