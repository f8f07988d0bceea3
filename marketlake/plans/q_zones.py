"""Zones, outcomes and retrieval."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marketlake.functions.ticks import r
from marketlake.operators import indicators as I
from marketlake.operators import outcomes as O
from marketlake.operators import structure as S
from marketlake.operators import zones as Z
from marketlake.plans.registry import query
from marketlake.plans.sqlviews import R, view
from marketlake.sources import views as V

ZK = ("symbol", "kind", "imb_no")

view("zones", """
SELECT z.*, CASE WHEN middle > eq THEN 'premium' WHEN middle < eq THEN 'discount' ELSE 'mid' END AS zone, CASE WHEN kind = 'iFVG' THEN 'VI' ELSE kind END || CASE WHEN is_bullish THEN '_BULL' ELSE '_BEAR' END AS zone_type,
  ((imb_no * 37) % 100) / 100.0::double AS p_hold, CASE WHEN middle > eq THEN 1.5 ELSE 1.0 END::double AS w_zone,
  (SELECT min(b.bar_no) FROM day_bars b WHERE b.symbol = z.symbol AND b.bar_no > z.close_bar_no AND CASE WHEN z.is_bullish THEN b.low <= z.far ELSE b.high >= z.far END) AS mitigated_bar_no
FROM (SELECT symbol, kind, imb_no, is_bullish, open_bar_no, close_bar_no, top, bottom, middle, near, far FROM fvgs
      UNION ALL SELECT symbol, 'iFVG', imb_no, NOT is_bullish, open_bar_no, inverted_no, top, bottom, middle, far, near FROM ifvgs
      UNION ALL SELECT symbol, 'GAP', imb_no, is_bullish, open_bar_no, close_bar_no, top, bottom, middle, near, far FROM gaps) z JOIN equil USING (symbol)""", ("fvgs", "ifvgs", "gaps", "equil", "day_bars"))


def zone_table(spark, sf):
    b = V.day_bars(spark, sf)
    f = S.fair_value_gaps(b).persist()
    z = f.unionByName(S.invert(f, b)).unionByName(S.open_gaps(b))
    z = Z.registry(z, S.equilibrium(S.tiers(b)), ((F.col("imb_no") * 37) % 100) / 100.0)
    return S.mitigate(z, b).persist(), b


@query("u05_zone_registry", f"SELECT symbol, kind, imb_no, zone, zone_type, {R('p_hold')} AS p_hold, w_zone, mitigated_bar_no FROM zones", ("zones",))
def u05(spark, sf):
    z, _ = zone_table(spark, sf)
    return z.select(*ZK, "zone", "zone_type", r(F.col("p_hold")).alias("p_hold"), "w_zone", "mitigated_bar_no")


@query("p10_zone_predicates", f"""SELECT symbol, kind, imb_no, price_now >= bottom AND price_now <= top AS contains_price, mitigated_bar_no IS NULL AS active, {R('top - bottom')} AS height, zone_type LIKE '%BULL' AS bullish FROM zones JOIN now USING (symbol)""", ("zones", "now"))
def p10(spark, sf):
    z, b = zone_table(spark, sf)
    z = z.join(S.last_close(b).select("symbol", "tf", "price_now"), ["symbol", "tf"])
    return z.select(*ZK, Z.contains(F.col("price_now"), F.col("top"), F.col("bottom")).alias("contains_price"), F.col("mitigated_bar_no").isNull().alias("active"), r(F.col("top") - F.col("bottom")).alias("height"), F.col("is_bullish").alias("bullish"))


view("zone_touch", "SELECT z.symbol, z.kind, z.imb_no, b.bar_no, row_number() OVER (PARTITION BY z.symbol, z.kind, z.imb_no ORDER BY b.bar_no) AS rk FROM zones z JOIN day_bars b ON b.symbol = z.symbol AND b.bar_no > z.close_bar_no AND b.low <= z.top AND b.high >= z.bottom", ("zones", "day_bars"))


@query("j21_touch_counting", "SELECT symbol, kind, imb_no, count(*) AS touch_count, min(bar_no) AS first_touch_no, max(bar_no) AS last_touch_no FROM zone_touch GROUP BY 1, 2, 3", ("zone_touch",))
def j21(spark, sf):
    z, b = zone_table(spark, sf)
    return Z.touches(z, b).select(*ZK, "touch_count", "first_touch_no", "last_touch_no")


@query("j19_zone_accumulation", f"""SELECT z.symbol, z.kind, z.imb_no, count(*) AS bars_inside, sum(b.volume) AS total FROM zones z JOIN day_bars b ON b.symbol = z.symbol AND b.bar_no > z.close_bar_no AND b.close BETWEEN z.bottom AND z.top GROUP BY 1, 2, 3""", ("zones", "day_bars"))
def j19(spark, sf):
    z, b = zone_table(spark, sf)
    return Z.accumulate(z, b, "volume").select(*ZK, "bars_inside", "total")


@query("j19_level_accumulation", """SELECT p.symbol, p.is_high, p.bar_no, count(*) AS bars_inside, sum(b.volume) AS total FROM piv_lt p JOIN now n USING (symbol) JOIN day_bars b ON b.symbol = p.symbol AND b.bar_no > p.confirm_bar_no
 AND b.close >= p.price - 0.05 * n.atr_now AND b.close <= p.price + 0.05 * n.atr_now GROUP BY 1, 2, 3""", ("piv_lt", "now", "day_bars"))
def j19l(spark, sf):
    b = V.day_bars(spark, sf)
    lt = S.tiers(b).filter("term = 'LT'").withColumnRenamed("bar_no", "pivot_bar")
    atr = I.atr_wilder(b).groupBy("symbol", "tf").agg(F.max_by("atr", "bar_no").alias("atr_now"))
    key = ("symbol", "tf", "is_high", "pivot_bar")
    lv = Z.around_level(lt.join(atr, ["symbol", "tf"]), F.col("atr_now") * 0.05, key)
    return Z.accumulate(lv, b, "volume", key).select("symbol", "is_high", F.col("pivot_bar").alias("bar_no"), "bars_inside", "total")


@query("j20_zones_near_price", f"SELECT symbol, kind, imb_no, {R('p_hold * w_zone')} AS score FROM zones JOIN now USING (symbol) WHERE mitigated_bar_no IS NULL AND price_now BETWEEN bottom - price_now * 0.2 AND top + price_now * 0.2", ("zones", "now"))
def j20(spark, sf):
    z, b = zone_table(spark, sf)
    return Z.near_price(z, b, F.col("price_now") * 0.2).select(*ZK, r(F.col("score")).alias("score"))


@query("k01_top_zones", f"""SELECT symbol, zone_type, kind, imb_no, rank, {R('score')} AS score FROM (SELECT *, p_hold * w_zone AS score, row_number() OVER (PARTITION BY symbol, zone_type ORDER BY p_hold * w_zone DESC, kind, imb_no)::int AS rank FROM zones WHERE mitigated_bar_no IS NULL) WHERE rank <= 5""", ("zones",))
def k01(spark, sf):
    z, _ = zone_table(spark, sf)
    return Z.top_zones(z).select("symbol", "zone_type", "kind", "imb_no", "rank", r(F.col("score")).alias("score"))


@query("k02_overlay", """SELECT symbol, kind, imb_no FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY p_hold DESC, kind, imb_no) AS rk FROM zones WHERE p_hold >= 0.5) WHERE rk <= 50""", ("zones",))
def k02(spark, sf):
    z, _ = zone_table(spark, sf)
    return Z.overlay(z, 0.5, 50).select(*ZK)


view("hold_lab", """
SELECT t.symbol, t.kind, t.imb_no, g AS good_no, d AS bad_no, (g IS NOT NULL AND (d IS NULL OR g < d))::int AS held FROM (
 SELECT z.*, (SELECT min(b.bar_no) FROM day_bars b WHERE b.symbol = z.symbol AND b.bar_no >= f AND b.bar_no < f + 60 AND CASE WHEN is_bullish THEN b.high >= z.top + 0.5 * atr ELSE b.low <= z.bottom - 0.5 * atr END) AS g,
  (SELECT min(b.bar_no) FROM day_bars b WHERE b.symbol = z.symbol AND b.bar_no >= f AND b.bar_no < f + 60 AND CASE WHEN is_bullish THEN b.low < z.bottom ELSE b.high > z.top END) AS d
 FROM (SELECT z.*, t.f, a.atr FROM zones z JOIN (SELECT symbol, kind, imb_no, min(bar_no) AS f FROM zone_touch GROUP BY 1, 2, 3) t USING (symbol, kind, imb_no) JOIN day_atr a ON a.symbol = z.symbol AND a.bar_no = t.f) z) t""", ("zones", "zone_touch", "day_atr", "day_bars"))


@query("a32_zone_history", """
, each AS (SELECT z.*, t.rk, t.bar_no AS f, a.atr FROM zones z JOIN zone_touch t USING (symbol, kind, imb_no) LEFT JOIN day_atr a ON a.symbol = z.symbol AND a.bar_no = t.bar_no WHERE rk <= 3),
lab AS (SELECT symbol, kind, imb_no, rk, (g IS NOT NULL AND (d IS NULL OR g < d))::int AS held FROM (SELECT z.*,
  (SELECT min(b.bar_no) FROM day_bars b WHERE b.symbol = z.symbol AND b.bar_no >= f AND b.bar_no < f + 60 AND CASE WHEN is_bullish THEN b.high >= z.top + 0.5 * atr ELSE b.low <= z.bottom - 0.5 * atr END) AS g,
  (SELECT min(b.bar_no) FROM day_bars b WHERE b.symbol = z.symbol AND b.bar_no >= f AND b.bar_no < f + 60 AND CASE WHEN is_bullish THEN b.low < z.bottom ELSE b.high > z.top END) AS d FROM each z WHERE atr IS NOT NULL)),
h AS (SELECT symbol, kind, imb_no, count(*) AS touches, max(bar_no) FILTER (rk = 1) AS touch_1, max(bar_no) FILTER (rk = 2) AS touch_2, max(bar_no) FILTER (rk = 3) AS touch_3, max(bar_no) AS last FROM zone_touch GROUP BY 1, 2, 3),
l AS (SELECT symbol, kind, imb_no, max(held) FILTER (rk = 1) AS held_1, max(held) FILTER (rk = 2) AS held_2, max(held) FILTER (rk = 3) AS held_3 FROM lab GROUP BY 1, 2, 3)
SELECT symbol, kind, imb_no, coalesce(touches, 0) AS touches, touch_1, touch_2, touch_3, CASE WHEN touch_1 IS NOT NULL THEN p_hold END AS p_hold_1, CASE WHEN touch_2 IS NOT NULL THEN p_hold END AS p_hold_2, CASE WHEN touch_3 IS NOT NULL THEN p_hold END AS p_hold_3,
 held_1, held_2, held_3, CASE WHEN z.mitigated_bar_no IS NOT NULL THEN 'MITIGATED' WHEN n.e - coalesce(last, z.close_bar_no) > 500 THEN 'EXPIRED' ELSE 'ACTIVE' END AS final_status
FROM zones z LEFT JOIN h USING (symbol, kind, imb_no) LEFT JOIN l USING (symbol, kind, imb_no) JOIN (SELECT symbol, max(bar_no) AS e FROM day_bars GROUP BY 1) n USING (symbol)""", ("zone_touch", "zones", "day_atr", "day_bars"))
def a32(spark, sf):
    z, b = zone_table(spark, sf)
    return Z.zone_summary(z, b, I.atr_wilder(b)).drop("tf")


def labelled_zones(spark, sf):
    z, b = zone_table(spark, sf)
    t = Z.touches(z, b)
    return Z.hold_labels(z.join(t, list(Z.ZONE_KEY)), b, I.atr_wilder(b)), b


@query("j18_hold_label", "SELECT symbol, kind, imb_no, good_no, bad_no, held FROM hold_lab", ("hold_lab",))
def j18(spark, sf):
    z, _ = labelled_zones(spark, sf)
    return z.select(*ZK, "good_no", "bad_no", "held")


view("res10", """
SELECT *, CASE WHEN u IS NOT NULL AND (d IS NULL OR u <= d) THEN 'BSL_HIT' WHEN d IS NOT NULL THEN 'SSL_HIT' WHEN e >= bar_no + 10 THEN 'TIMEOUT' ELSE 'PENDING' END AS outcome FROM (
 SELECT p.*, (SELECT max(bar_no) FROM day_bars b WHERE b.symbol = p.symbol) AS e,
  (SELECT min(b.bar_no) FROM day_bars b WHERE b.symbol = p.symbol AND b.bar_no BETWEEN p.bar_no + 1 AND p.bar_no + 10 AND b.high >= p.predicted_bsl_level) AS u,
  (SELECT min(b.bar_no) FROM day_bars b WHERE b.symbol = p.symbol AND b.bar_no BETWEEN p.bar_no + 1 AND p.bar_no + 10 AND b.low <= p.predicted_ssl_level) AS d
 FROM levelled p)""", ("levelled", "day_bars"))


def day_preds(spark, sf, b):
    return V.levelled_predictions(spark, sf, b).withColumn("tf", F.lit("D1"))


@query("j16_prediction_outcome", "SELECT prediction_id, outcome, CASE outcome WHEN 'BSL_HIT' THEN u WHEN 'SSL_HIT' THEN d WHEN 'TIMEOUT' THEN bar_no + 10 END AS outcome_no FROM res10", ("res10",))
def j16(spark, sf):
    b = V.day_bars(spark, sf)
    return O.resolve(day_preds(spark, sf, b), b, 10).select("prediction_id", "outcome", "outcome_no")


@query("j16_outcome_by_priority", "SELECT CASE WHEN u IS NOT NULL THEN 'BSL_HIT' ELSE outcome END AS outcome, count(*) AS n FROM res10 GROUP BY 1", ("res10",))
def j16p(spark, sf):
    b = V.day_bars(spark, sf)
    return O.resolve(day_preds(spark, sf, b), b, 10, "priority").groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


view("pred_bars", "SELECT symbol, bar_no, count(*) AS n FROM levelled WHERE bar_no IS NOT NULL GROUP BY 1, 2", ("levelled",))
view("held_bars", """
SELECT symbol, bar_no, count(*) FILTER (c >= 3) > 0 AS zone_hold FROM (
 SELECT p.symbol, p.bar_no, z.kind, z.imb_no, count(b.bar_no) AS c FROM pred_bars p LEFT JOIN zones z ON z.symbol = p.symbol AND z.close_bar_no <= p.bar_no AND coalesce(z.mitigated_bar_no, 1000000000) > p.bar_no
 LEFT JOIN day_bars b ON b.symbol = p.symbol AND b.bar_no BETWEEN p.bar_no + 1 AND p.bar_no + 10 AND b.close BETWEEN z.bottom AND z.top GROUP BY 1, 2, 3, 4) GROUP BY 1, 2""", ("pred_bars", "zones", "day_bars"))


@query("j17_zone_hold", "SELECT prediction_id, CASE WHEN zone_hold THEN 'ZONE_HOLD' ELSE outcome END AS outcome FROM res10 LEFT JOIN held_bars USING (symbol, bar_no)", ("res10", "held_bars"))
def j17(spark, sf):
    z, b = zone_table(spark, sf)
    return O.resolve(day_preds(spark, sf, b), b, 10, held=Z.held_bars(z, b, 10)).select("prediction_id", "outcome")


@query("j26_pending_predictions", "SELECT symbol, prediction_id FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_close_time DESC, prediction_id DESC) AS rk FROM res10 WHERE outcome = 'PENDING') WHERE rk <= 20", ("res10",))
def j26(spark, sf):
    b = V.day_bars(spark, sf)
    p = day_preds(spark, sf, b).persist()
    open_ = O.pending(O.resolve(p, b, 10)).select("prediction_id")
    w = Window.partitionBy("symbol").orderBy(F.col("bar_close_time").desc(), F.col("prediction_id").desc())
    return p.join(open_, "prediction_id", "left_semi").withColumn("rk", F.row_number().over(w)).filter("rk <= 20").select("symbol", "prediction_id")


@query("k03_newest_predictions", "SELECT symbol, prediction_id, rk FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_close_time DESC, prediction_id DESC) AS rk FROM predictions) WHERE rk <= 50", ("predictions",))
def k03(spark, sf):
    w = Window.partitionBy("symbol").orderBy(F.col("bar_close_time").desc(), F.col("prediction_id").desc())
    return V.predictions(spark, sf).withColumn("rk", F.row_number().over(w).cast("bigint")).filter("rk <= 50").select("symbol", "prediction_id", "rk")


@query("r10_zone_progress", """SELECT z.symbol, z.imb_no, CASE WHEN bf IS NOT NULL THEN 'BODY_FILLED' WHEN wf IS NOT NULL THEN 'WICK_FILLED' WHEN wh IS NOT NULL THEN 'WICK_FILLED_HALF' WHEN wt IS NOT NULL THEN 'WICK_TOUCHED' ELSE 'UNMITIGATED' END AS status FROM (
 SELECT z.symbol, z.imb_no, max(CASE WHEN is_bullish THEN b.low < near ELSE b.high > near END::int) FILTER (CASE WHEN is_bullish THEN b.low < near ELSE b.high > near END) AS wt,
  max(1) FILTER (CASE WHEN is_bullish THEN b.low <= middle ELSE b.high >= middle END) AS wh, max(1) FILTER (CASE WHEN is_bullish THEN b.low <= far ELSE b.high >= far END) AS wf,
  max(1) FILTER (CASE WHEN is_bullish THEN least(b.open, b.close) <= far ELSE greatest(b.open, b.close) >= far END) AS bf
 FROM fvgs z LEFT JOIN day_bars b ON b.symbol = z.symbol AND b.bar_no > z.close_bar_no GROUP BY 1, 2) z""", ("fvgs", "day_bars"))
def r10(spark, sf):
    b = V.day_bars(spark, sf)
    return S.zone_progress(S.fair_value_gaps(b), b).select("symbol", "imb_no", "status")


@query("w39_hold_pulse", f"SELECT symbol, kind, imb_no, {R('abs(p_hold - prev)')} AS change FROM (SELECT *, lag(p_hold) OVER (PARTITION BY symbol, kind ORDER BY imb_no) AS prev FROM zones) WHERE abs(p_hold - prev) > 0.15", ("zones",))
def w39(spark, sf):
    z, _ = zone_table(spark, sf)
    return Z.hold_pulse(z, ["symbol", "tf", "kind"], "imb_no").select(*ZK, r(F.col("change")).alias("change"))


@query("a09_symbolic_counts", f"""
SELECT symbol, mb AS mss_bull, ms AS mss_bear, bb AS bos_bull, bs AS bos_bear, ab AS fvg_bull_active, aa AS fvg_bear_active, fm AS fvg_mitigated, {R('fr', 4)} AS fvg_avg_range FROM
 (SELECT symbol, count(*) FILTER (is_high) AS mb, count(*) FILTER (NOT is_high) AS ms FROM mss_now GROUP BY 1) FULL JOIN
 (SELECT symbol, count(*) FILTER (is_high) AS bb, count(*) FILTER (NOT is_high) AS bs FROM bos_now GROUP BY 1) USING (symbol) FULL JOIN
 (SELECT symbol, count(*) FILTER (is_bullish AND mitigated_bar_no IS NULL) AS ab, count(*) FILTER (NOT is_bullish AND mitigated_bar_no IS NULL) AS aa, count(*) FILTER (mitigated_bar_no IS NOT NULL) AS fm,
   avg(top - bottom) FILTER (mitigated_bar_no IS NULL) AS fr FROM zones WHERE kind = 'FVG' GROUP BY 1) USING (symbol)""", ("mss_now", "bos_now", "zones"))
def a09(spark, sf):
    z, b = zone_table(spark, sf)
    p = S.tiers(b).persist()
    m = S.mss(p, b).groupBy("symbol").agg(F.count_if("is_high").alias("mss_bull"), F.count_if(~F.col("is_high")).alias("mss_bear"))
    s = S.bos(p, b).groupBy("symbol").agg(F.count_if("is_high").alias("bos_bull"), F.count_if(~F.col("is_high")).alias("bos_bear"))
    live = F.col("mitigated_bar_no").isNull()
    f = z.filter("kind = 'FVG'").groupBy("symbol").agg(
        F.count_if(live & F.col("is_bullish")).alias("fvg_bull_active"), F.count_if(live & ~F.col("is_bullish")).alias("fvg_bear_active"),
        F.count_if(~live).alias("fvg_mitigated"), r(F.avg(F.when(live, F.col("top") - F.col("bottom"))), 4).alias("fvg_avg_range"))
    return m.join(s, "symbol", "full").join(f, "symbol", "full")
