"""Calendar and session queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlake.functions.ticks import r
from marketlake.operators import indicators as I
from marketlake.operators import macro as M
from marketlake.operators.blocks import time_block
from marketlake.plans.registry import query
from marketlake.plans.sqlviews import R, view
from marketlake.sources import views as V

NOW = "2024-01-15 00:00:00"


def _inside(a, b):
    return f"(m >= {a} AND m < {b})" if a < b else f"(m >= {a} OR m < {b})"


view("sess", f"""
SELECT seq, ts, list_filter([{', '.join(f"CASE WHEN {_inside(a, b)} THEN '{i}' END" for i, a, b, _, _ in M.SESSIONS)}], lambda x: x IS NOT NULL) AS sessions,
 CASE {' '.join(f"WHEN {_inside(a, b)} THEN '{i}'" for i, a, b, _, _ in M.SESSIONS)} ELSE 'OFF' END AS session,
 (CASE {' '.join(f"WHEN {_inside(a, b)} THEN {l}" for _, a, b, l, _ in M.SESSIONS)} ELSE 1.0 END)::double AS w_ltf,
 (CASE {' '.join(f"WHEN {_inside(a, b)} THEN {h}" for _, a, b, _, h in M.SESSIONS)} ELSE 1.0 END)::double AS w_htf
FROM (SELECT *, extract(hour FROM ts) * 60 + extract(minute FROM ts) AS m FROM ticks)""", ("ticks",))


@query("j03_sessions", "SELECT seq, sessions, session, w_ltf, w_htf FROM sess", ("sess",))
def j03(spark, sf):
    return M.sessions(V.ticks(spark, sf)).select("seq", "sessions", "session", "w_ltf", "w_htf")


view("high", "SELECT * FROM calendar WHERE impact = 'HIGH'", ("calendar",))
view("ctx", """
SELECT t.*, n.event_id AS next_event_id, l.event_id AS last_event_id, (epoch_us(n.scheduled_time) - epoch_us(t.ts)) / 1e6 AS to_next,
       (epoch_us(t.ts) - epoch_us(l.scheduled_time)) / 1e6 AS since_last,
       (SELECT count(*) FROM high h WHERE h.scheduled_time >= t.ts AND h.scheduled_time <= t.ts + INTERVAL 1800 SECOND) AS ahead
FROM ticks t ASOF LEFT JOIN high n ON t.ts <= n.scheduled_time ASOF LEFT JOIN high l ON t.ts > l.scheduled_time""", ("ticks", "high"))
view("macro", """
SELECT *, CASE WHEN state IN ('NEWS_WINDOW', 'CLUSTER') THEN 0.1 WHEN state = 'PRE_NEWS' THEN 0.3 * to_next / 900 + 0.1 ELSE 1.0 END AS dampening FROM (
SELECT *, CASE WHEN ahead >= 2 THEN 'CLUSTER' WHEN since_last <= 300 OR to_next = 0 THEN 'NEWS_WINDOW' WHEN to_next <= 900 THEN 'PRE_NEWS'
               WHEN since_last < 1800 THEN 'POST_NEWS' ELSE 'NORMAL' END AS state FROM ctx)""", ("ctx",))


def high(spark, sf):
    return V.calendar(spark, sf).filter(F.col("impact") == "HIGH")


@query("j04_next_last_event", f"SELECT seq, next_event_id, last_event_id, {R('to_next')} AS seconds_to_next, {R('since_last')} AS seconds_since_last FROM ctx", ("ctx",))
def j04(spark, sf):
    d = M.next_last_event(V.ticks(spark, sf), high(spark, sf))
    return d.select("seq", "next_event_id", "last_event_id", r(F.col("seconds_to_next")).alias("seconds_to_next"), r(F.col("seconds_since_last")).alias("seconds_since_last"))


@query("j05_events_ahead", "SELECT seq, ahead AS events_ahead FROM ctx", ("ctx",))
def j05(spark, sf):
    return M.events_ahead(V.ticks(spark, sf), high(spark, sf)).select("seq", "events_ahead")


@query("f13_macro_state", f"SELECT seq, state AS macro_state, {R('dampening')} AS dampening, state IN ('CLUSTER', 'PRE_NEWS', 'NEWS_WINDOW') AS guardrail FROM macro", ("macro",))
def f13(spark, sf):
    d = M.with_macro_state(V.ticks(spark, sf), V.calendar(spark, sf))
    return d.select("seq", "macro_state", r(F.col("dampening")).alias("dampening"), "guardrail")


@query("w38_state_changes", "SELECT seq, prev AS prev_macro_state, state AS macro_state FROM (SELECT *, lag(state) OVER (ORDER BY ts, seq) AS prev FROM macro) WHERE prev <> state", ("macro",))
def w38(spark, sf):
    d = M.with_macro_state(V.ticks(spark, sf), V.calendar(spark, sf))
    return M.state_changes(d, "macro_state", [], ["ts", "seq"], time_block(F.col("ts"), 3600)).select("seq", "prev_macro_state", "macro_state")


@query("j06_tick_calendar_merge", """
SELECT m.kind, m.id, count(c.event_id) AS events_so_far FROM (SELECT 0 AS kind, event_id AS id, scheduled_time AS ts FROM high UNION ALL SELECT 1, seq, ts FROM ticks) m
LEFT JOIN high c ON c.scheduled_time <= m.ts GROUP BY 1, 2""", ("ticks", "high"))
def j06(spark, sf):
    """Merged order, checked by the number of events at or before each row."""
    from marketlake.operators.blocks import running_sum

    m = M.merge_streams(V.ticks(spark, sf), high(spark, sf))
    n = running_sum(m, {"n": F.when(F.col("kind") == 0, 1.0).otherwise(0.0)}, [], ["ts", "kind", "id"], time_block(F.col("ts"), 3600))
    return n.select("kind", "id", F.col("n").cast("bigint").alias("events_so_far"))


view("listed", "SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{s}')" for c, symbols in V.LISTED.items() for s in symbols) + ") AS t(currency, symbol)")
view("priced", """
SELECT c.*, a.last AS price_at, b.last AS price_after FROM (SELECT *, scheduled_time + INTERVAL 300 SECOND AS later FROM calendar JOIN listed USING (currency)) c
ASOF LEFT JOIN ticks a ON c.symbol = a.symbol AND c.scheduled_time >= a.ts ASOF LEFT JOIN ticks b ON c.symbol = b.symbol AND c.later >= b.ts""", ("calendar", "listed", "ticks"))


def priced(spark, sf, calendar):
    return M.event_prices(M.for_symbols(calendar, V.LISTED), V.ticks(spark, sf))


@query("j07_post_event_price", f"SELECT event_id, symbol, {R('price_at')} AS price_at, {R('price_after')} AS price_after FROM priced", ("priced",))
def j07(spark, sf):
    e = priced(spark, sf, V.calendar(spark, sf))
    return e.select("event_id", "symbol", r(F.col("price_at")).alias("price_at"), r(F.col("price_after")).alias("price_after"))


view("post", """
SELECT *, CASE WHEN (dir = 'BULLISH' AND move >= 0.8) OR (dir = 'BEARISH' AND move <= -0.8) THEN 'IMPULSIVE_FOLLOW_THROUGH' WHEN move <= -0.5 THEN 'REVERSAL_AFTER_SPIKE'
  WHEN (dir = 'BULLISH' AND move <= -0.2) OR (dir = 'BEARISH' AND move >= 0.2) THEN 'REVERSAL_AFTER_SPIKE' ELSE 'CHOPPY_CONSOLIDATION' END AS regime FROM (
SELECT p.*, (price_after - price_at) / greatest(h.atr, 0.01) AS move, CASE WHEN actual > forecast THEN 'BULLISH' WHEN actual < forecast THEN 'BEARISH' ELSE 'NEUTRAL' END AS dir
FROM priced p ASOF LEFT JOIN (SELECT symbol, atr, to_timestamp(bucket + 3600) AT TIME ZONE 'UTC' AS closed_at FROM h1_atr) h ON p.symbol = h.symbol AND p.scheduled_time >= h.closed_at)""", ("priced", "h1_atr"))


def classified(spark, sf):
    from marketlake.operators.asof import asof

    atr = I.atr_wilder(V.tick_bars(spark, sf)).select("symbol", F.timestamp_seconds(F.col("bucket") + 3600).alias("closed_at"), "atr")
    e = priced(spark, sf, V.calendar(spark, sf))
    e = asof(e, atr, "scheduled_time", "closed_at", ["symbol"], {"atr": "atr"})
    e = e.withColumn("move", M.directional_move(F.col("price_at"), F.col("price_after"), F.col("atr"))).withColumn("dir", M.surprise_direction(F.col("actual"), F.col("forecast")))
    return e.withColumn("regime", M.post_news_regime(F.col("move"), F.col("dir")))


@query("f14_post_news_regime", f"SELECT event_id, symbol, {R('move', 4)} AS move, dir, regime FROM post", ("post",))
def f14(spark, sf):
    return classified(spark, sf).select("event_id", "symbol", r(F.col("move"), 4).alias("move"), "dir", "regime")


@query("a06_outcome_statistics", f"SELECT coalesce(regime, 'ALL') AS regime, count(*) AS n, {R('avg(abs(move))', 4)} AS avg_move, {R('max(abs(move))', 4)} AS max_move FROM post GROUP BY GROUPING SETS ((regime), ())", ("post",))
def a06(spark, sf):
    s = M.outcome_statistics(classified(spark, sf))
    return s.select("regime", "n", r(F.col("avg_move"), 4).alias("avg_move"), r(F.col("max_move"), 4).alias("max_move"))


@query("p12_impact_filter", f"""SELECT event_id, currency, impact FROM calendar WHERE impact IN ('MEDIUM', 'HIGH') AND currency IN ('USD', 'EUR')
 AND scheduled_time BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '{NOW}'""", ("calendar",))
def p12(spark, sf):
    return M.impact_filter(V.calendar(spark, sf), "MEDIUM", ["USD", "EUR"], "2024-01-05 00:00:00", NOW).select("event_id", "currency", "impact")


view("moved", """SELECT event_id, CASE WHEN event_id % 7 = 0 THEN scheduled_time + INTERVAL 45 MINUTE WHEN event_id % 5 = 0 THEN scheduled_time + INTERVAL 20 MINUTE ELSE scheduled_time END AS scheduled_time
FROM calendar WHERE event_id % 11 <> 0""", ("calendar",))


@query("j22_calendar_diff", f"""
SELECT o.event_id, 'RESCHEDULED' AS change, ((epoch(n.scheduled_time) - epoch(o.scheduled_time)) / 60)::double AS minutes FROM calendar o JOIN moved n USING (event_id)
WHERE abs(epoch(n.scheduled_time) - epoch(o.scheduled_time)) > 1800
UNION ALL SELECT event_id, 'CANCELLED', NULL FROM calendar WHERE event_id NOT IN (SELECT event_id FROM moved) AND scheduled_time > TIMESTAMP '{NOW}' - INTERVAL 1 HOUR""", ("calendar", "moved"))
def j22(spark, sf):
    old = V.calendar(spark, sf)
    e = F.col("event_id")
    shift = F.when(e % 7 == 0, 45).when(e % 5 == 0, 20).otherwise(0)
    new = old.filter(e % 11 != 0).withColumn("scheduled_time", F.timestamp_micros(F.unix_micros("scheduled_time") + shift.cast("bigint") * 60_000_000))
    return M.calendar_diff(old, new, NOW)


view("cal_x", "SELECT *, CASE WHEN forecast <> 0 THEN actual - forecast END AS x FROM calendar", ("calendar",))


@query("a07_surprise_statistics", f"SELECT currency, count(x) AS n, {R('avg(x)')} AS mean, {R('coalesce(stddev_samp(x), 0)')} AS std FROM cal_x GROUP BY 1", ("cal_x",))
def a07(spark, sf):
    x = F.when(F.col("forecast") != 0, F.col("actual") - F.col("forecast"))
    return V.calendar(spark, sf).groupBy("currency").agg(F.count(x).alias("n"), r(F.avg(x)).alias("mean"), r(F.coalesce(F.stddev_samp(x), F.lit(0.0))).alias("std"))


PRIOR = "OVER (PARTITION BY title ORDER BY scheduled_time, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
view("prior", f"SELECT *, count(x) {PRIOR} AS prior_n, avg(x) {PRIOR} AS prior_mean, stddev_samp(x) {PRIOR} AS prior_sigma FROM cal_x", ("cal_x",))


@query("w40_prior_sigma", f"SELECT event_id, prior_n, {R('prior_mean', 8)} AS prior_mean, {R('prior_sigma', 4)} AS prior_sigma FROM prior", ("prior",))
def w40(spark, sf):
    p = M.prior_surprise_stats(V.calendar(spark, sf), ["title"])
    return p.select("event_id", "prior_n", r(F.col("prior_mean"), 8).alias("prior_mean"), r(F.col("prior_sigma"), 4).alias("prior_sigma"))


@query("f11_surprise", f"""
SELECT event_id, {R('z', 4)} AS z, {R('CASE WHEN abs(z) <= 1 THEN 1 WHEN abs(z) <= 2 THEN 1 + 0.25 * (abs(z) - 1) WHEN z IS NOT NULL THEN 1.25 + 0.5 * (abs(z) - 2) ELSE 1 END', 4)} AS factor,
       CASE WHEN actual > forecast THEN 'BULLISH' WHEN actual < forecast THEN 'BEARISH' ELSE 'NEUTRAL' END AS direction, coalesce(abs(z) > 2, FALSE) AS major
FROM (SELECT *, CASE WHEN forecast = 0 THEN NULL WHEN coalesce(prior_sigma, 0) < 0.001 THEN (actual - forecast) / greatest(abs(forecast), 0.001) ELSE (actual - forecast) / prior_sigma END AS z FROM prior)""", ("prior",))
def f11(spark, sf):
    p = M.prior_surprise_stats(V.calendar(spark, sf), ["title"])
    z = M.surprise_z(F.col("actual"), F.col("forecast"), F.col("prior_sigma"))
    p = p.withColumn("z", z)
    return p.select("event_id", r(F.col("z"), 4).alias("z"), r(F.coalesce(F.when(F.col("z").isNotNull(), M.surprise_factor(F.col("z"))), F.lit(1.0)), 4).alias("factor"),
                    M.surprise_direction(F.col("actual"), F.col("forecast")).alias("direction"), F.coalesce(F.abs("z") > 2, F.lit(False)).alias("major"))


INEWS = "least((CASE impact WHEN 'LOW' THEN 0.2 WHEN 'MEDIUM' THEN 0.5 WHEN 'HIGH' THEN 1.0 ELSE 0.5 END) * (1 + 0.4 * (actual * 0.5) / 10), 3.0)"


def with_impact(spark, sf):
    return V.calendar(spark, sf).withColumn("i_base", M.news_impact(F.col("impact"), F.col("actual") * 0.5, F.lit(10.0)))


@query("f10_news_impact", f"SELECT event_id, {R(INEWS)} AS i_news, {R(f'CASE WHEN event_id % 2 = 0 THEN {INEWS} * 0.3 ELSE {INEWS} END')} AS dampened FROM calendar", ("calendar",))
def f10(spark, sf):
    c = with_impact(spark, sf)
    return c.select("event_id", r(F.col("i_base")).alias("i_news"), r(M.dampened_impact(F.col("i_base"), F.col("event_id") % 2 == 0)).alias("dampened"))


@query("f12_guardrail_dampening", f"SELECT m.seq, {R(f'CASE WHEN state IN (' + repr('CLUSTER') + ', ' + repr('PRE_NEWS') + ', ' + repr('NEWS_WINDOW') + f') THEN 0.3 ELSE 1.0 END * CASE WHEN c.event_id IS NULL THEN 0.0 ELSE {INEWS} END')} AS i_news FROM macro m LEFT JOIN calendar c ON c.event_id = m.next_event_id", ("macro", "calendar"))
def f12(spark, sf):
    d = M.with_macro_state(V.ticks(spark, sf), V.calendar(spark, sf))
    j = d.join(with_impact(spark, sf).select(F.col("event_id").alias("next_event_id"), "i_base"), "next_event_id", "left")
    return j.select("seq", r(M.dampened_impact(F.coalesce("i_base", F.lit(0.0)), F.col("guardrail"))).alias("i_news"))


@query("f23_category_multiplier", """
SELECT event_id, CASE WHEN regexp_matches(t, 'FOMC') THEN 2.0 WHEN regexp_matches(t, 'NFP') THEN 2.5 WHEN regexp_matches(t, 'INTEREST[ _]RATE') THEN 3.0 ELSE 1.0 END::double AS multiplier
FROM (SELECT event_id, upper(['us cpi y/y', 'fomc minutes', 'nfp release', 'interest rate decision'][cast(event_id % 4 AS integer) + 1]) AS t FROM calendar)""", ("calendar",))
def f23(spark, sf):
    t = F.element_at(F.array(*[F.lit(x) for x in ("us cpi y/y", "fomc minutes", "nfp release", "interest rate decision")]), (F.col("event_id") % 4 + 1).cast("int"))
    return V.calendar(spark, sf).select("event_id", M.category_multiplier(t).alias("multiplier"))


@query("a29_event_clusters", f"""
SELECT currency, epoch_us(min(scheduled_time)) AS trigger_us, count(*) AS events, {R('max(i) * CASE WHEN count(*) > 1 THEN 1.25 ELSE 1 END')} AS i_news FROM (
  SELECT *, sum(CASE WHEN gap < 30 THEN 0 ELSE 1 END) OVER (PARTITION BY currency ORDER BY scheduled_time, event_id) AS cl FROM (
    SELECT *, {INEWS} AS i, (epoch_us(scheduled_time) - epoch_us(lag(scheduled_time) OVER (PARTITION BY currency ORDER BY scheduled_time, event_id))) / 6e7 AS gap FROM high))
GROUP BY currency, cl""", ("high",))
def a29(spark, sf):
    c = M.clusters(with_impact(spark, sf), "i_base")
    return c.select("currency", F.unix_micros("trigger_time").alias("trigger_us"), "events", r(F.col("i_news")).alias("i_news"))


@query("p25_news_alerts", f"SELECT event_id, cast(floor(epoch(scheduled_time)) AS bigint) - cast(epoch(TIMESTAMP '{NOW}') AS bigint) AS seconds_to_event, {R(INEWS)} AS i_news FROM high WHERE scheduled_time > TIMESTAMP '{NOW}'", ("high",))
def p25(spark, sf):
    a = M.alerts(with_impact(spark, sf), NOW, "i_base")
    return a.select("event_id", "seconds_to_event", r(F.col("i_news")).alias("i_news"))


def _mv(h):
    q = "(SELECT {} FROM sec_px s WHERE s.symbol = p.symbol AND s.sec > p.sec AND s.sec <= p.sec + " + str(h) + ")"
    return f"{q.format('max(hi)')} - price_at", f"price_at - {q.format('min(lo)')}"


@query("j27_event_impact", f"""
, sec_px AS (SELECT symbol, cast(floor(epoch(ts)) AS bigint) AS sec, max(last) AS hi, min(last) AS lo FROM ticks GROUP BY 1, 2),
p AS (SELECT *, cast(floor(epoch(scheduled_time)) AS bigint) AS sec FROM priced WHERE impact = 'HIGH'),
m AS (SELECT event_id, symbol, {', '.join(f'{_mv(h)[0]} AS u{h}, {_mv(h)[1]} AS d{h}' for h in (300, 900, 1800))},
  (SELECT count(*) FROM ticks t WHERE t.symbol = p.symbol AND floor(epoch(t.ts)) BETWEEN p.sec - 900 AND p.sec + 900) AS affected FROM p)
SELECT event_id, symbol, {', '.join(R(f'greatest(u{h}, d{h}, 0)') + f' AS max_move_{h // 60}m' for h in (300, 900, 1800))},
  CASE WHEN u1800 > d1800 THEN 1 WHEN u1800 < d1800 THEN -1 ELSE 0 END AS direction, affected FROM m""", ("priced", "ticks"))
def j27(spark, sf):
    t = V.ticks(spark, sf)
    i = M.event_impact(priced(spark, sf, high(spark, sf)), t, t)
    return i.select("event_id", "symbol", *[r(F.col(c)).alias(c) for c in ("max_move_5m", "max_move_15m", "max_move_30m")], "direction", "affected")


@query("r09_countdown_grid", """
SELECT phase, count(*) AS seconds, count(DISTINCT event_id) AS events FROM (
  SELECT event_id, CASE WHEN s < floor(epoch(scheduled_time)) THEN 'PRE_NEWS' ELSE 'NEWS_WINDOW' END AS phase FROM (
    SELECT *, unnest(range(cast(floor(epoch(scheduled_time)) AS bigint) - 900, cast(floor(epoch(scheduled_time)) AS bigint) + 301)) AS s FROM high)) GROUP BY 1""", ("high",))
def r09(spark, sf):
    return M.countdown(V.calendar(spark, sf)).groupBy("phase").agg(F.count(F.lit(1)).alias("seconds"), F.count_distinct("event_id").alias("events"))


@query("f15_event_id", "SELECT event_id, substr(md5(title || ':' || strftime(scheduled_time, '%Y-%m-%dT%H:%M:%S')), 1, 16) AS text_id FROM calendar", ("calendar",))
def f15(spark, sf):
    key = F.concat(F.col("title"), F.lit(":"), F.date_format("scheduled_time", "yyyy-MM-dd'T'HH:mm:ss"))
    return V.calendar(spark, sf).select("event_id", F.substring(F.md5(key), 1, 16).alias("text_id"))
