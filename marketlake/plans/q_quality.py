"""Probability rules, prediction quality, trades, latency and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlake.functions import scoring as C
from marketlake.functions.ticks import r
from marketlake.operators import drift as D
from marketlake.operators import evaluation as E
from marketlake.plans.registry import query
from marketlake.plans.sqlviews import R, view
from marketlake.sources import views as V

REG = "['NORMAL','TRENDING_LV','TRENDING_HV','CHOPPY_HV'][cast(prediction_id % 4 AS integer) + 1]"
view("preds", f"""
SELECT *, {REG} AS reg, p_bsl - p_ssl AS score, CASE label WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END AS outcome,
 CASE WHEN p_bsl >= p_ssl AND p_bsl >= p_lateral THEN 'BSL' WHEN p_ssl >= p_lateral THEN 'SSL' ELSE 'LATERAL' END AS dom,
 CASE WHEN p_bsl >= p_ssl AND p_bsl >= p_lateral THEN 0 WHEN p_ssl >= p_lateral THEN 1 ELSE 2 END AS pick, greatest(p_bsl, p_ssl, p_lateral) AS pmax,
 (label = 0)::int AS y FROM predictions""", ("predictions",))


def preds(spark, sf):
    p = V.predictions(spark, sf)
    reg = F.element_at(F.array(*[F.lit(x) for x in ("NORMAL", "TRENDING_LV", "TRENDING_HV", "CHOPPY_HV")]), (F.col("prediction_id") % 4 + 1).cast("int"))
    return p.select("*", reg.alias("reg"), C.dominant(*[F.col(c) for c in E.P]).alias("dom"), F.greatest(*E.P).alias("pmax"), (F.col("label") == 0).cast("int").alias("y"))


@query("p13_confidence", """
SELECT prediction_id, CASE WHEN reg IN ('TRENDING_LV','TRENDING_HV') AND pmax >= 0.65 THEN 'HIGH' WHEN pmax >= 0.85 THEN 'HIGH' WHEN pmax >= 0.65 THEN 'MEDIUM' ELSE 'LOW' END AS quality FROM preds""", ("preds",))
def p13(spark, sf):
    return preds(spark, sf).select("prediction_id", C.qualifier(F.col("pmax"), F.col("reg")).alias("quality"))


@query("p14_dominant_direction", "SELECT prediction_id, dom AS direction FROM preds", ("preds",))
def p14(spark, sf):
    return preds(spark, sf).select("prediction_id", F.col("dom").alias("direction"))


@query("p15_threshold_margin", f"SELECT prediction_id, p_bsl >= 0.71 AS hold, {R('least(abs(p_bsl - 0.71) / 0.71, 1)')} AS margin FROM preds", ("preds",))
def p15(spark, sf):
    return preds(spark, sf).select("prediction_id", C.decide(F.col("p_bsl")).alias("hold"), r(C.margin(F.col("p_bsl"))).alias("margin"))


BEAR = "((prediction_id % 11) / 10.0)"


@query("p16_regime_adjustment", f"""
SELECT prediction_id, {R('b / (b + s + l)', 9)} AS bsl, {R('s / (b + s + l)', 9)} AS ssl, {R('l / (b + s + l)', 9)} AS lateral FROM (
 SELECT prediction_id, b0 - sh AS b, least(s0 + sh, 1) AS s, l FROM (
  SELECT *, CASE WHEN {BEAR} > 0.5 THEN b0 * {BEAR} * 0.1 ELSE 0 END AS sh FROM (
   SELECT prediction_id, CASE WHEN q THEN p_bsl / (p_bsl + p_ssl) * (1 - l) ELSE p_bsl END AS b0, CASE WHEN q THEN p_ssl / (p_bsl + p_ssl) * (1 - l) ELSE p_ssl END AS s0, l FROM (
    SELECT *, reg IN ('NORMAL','TRENDING_LV') AS q, CASE WHEN reg IN ('NORMAL','TRENDING_LV') THEN least(1, p_lateral + 0.2 * (p_bsl + p_ssl)) ELSE p_lateral END AS l FROM preds))))""", ("preds",))
def p16(spark, sf):
    b, s, l = C.regime_adjust(*[F.col(c) for c in E.P], F.col("reg"), (F.col("prediction_id") % 11) / 10.0)
    return preds(spark, sf).select("prediction_id", r(b, 9).alias("bsl"), r(s, 9).alias("ssl"), r(l, 9).alias("lateral"))


@query("p17_news_adjustment", f"""
SELECT prediction_id, {R('b * 1.2 / t', 9)} AS bsl, {R('s * 1.2 / t', 9)} AS ssl, {R('(1 - b - s) / t', 9)} AS lateral FROM (SELECT *, b * 1.2 + s * 1.2 + 1 - b - s AS t FROM (
 SELECT prediction_id, p_bsl * (1 - g) AS b, p_ssl * (1 - g) AS s FROM (SELECT *, 0.3 * greatest(1 - (prediction_id % 1200) / 900.0, 0) * 1.04 AS g FROM preds)))""", ("preds",))
def p17(spark, sf):
    b, s, l = C.news_adjust(F.col("p_bsl"), F.col("p_ssl"), F.lit(1.04), (F.col("prediction_id") % 1200).cast("double"), F.lit(1.2))
    return preds(spark, sf).select("prediction_id", r(b, 9).alias("bsl"), r(s, 9).alias("ssl"), r(l, 9).alias("lateral"))


MOM = "((prediction_id % 21) / 10.0 - 1)"
view("quality", "SELECT *, CASE WHEN pmax >= 0.85 THEN 'HIGH' WHEN pmax >= 0.65 THEN 'MEDIUM' ELSE 'LOW' END AS q FROM preds", ("preds",))


@query("p18_rollback_rules", f"""
SELECT prediction_id, q = 'LOW' AS standard, (q = 'LOW' OR (reg = 'CHOPPY_HV' AND q = 'MEDIUM') OR (dom = 'BSL' AND {MOM} < -0.5) OR (dom = 'SSL' AND {MOM} > 0.5)) AS aggressive,
 (q = 'LOW' AND (pmax < 0.5 OR prediction_id % 2 = 0 OR (reg = 'CHOPPY_HV' AND prediction_id % 4 > 2.0))) AS conservative,
 CASE WHEN q = 'LOW' THEN 'LATERAL' ELSE dom END AS final_label FROM quality""", ("quality",))
def p18(spark, sf):
    p = preds(spark, sf)
    i = F.col("prediction_id")
    args = (C.qualifier(F.col("pmax")), F.col("pmax"), F.col("dom"), (i % 21) / 10.0 - 1, (i % 4).cast("double"), F.col("reg"), i % 2)
    std = C.rollback("standard", *args)
    return p.select("prediction_id", std.alias("standard"), C.rollback("aggressive", *args).alias("aggressive"), C.rollback("conservative", *args).alias("conservative"),
                    F.when(std, "LATERAL").otherwise(F.col("dom")).alias("final_label"))


@query("p19_rule_score", f"""
SELECT *, CASE WHEN rating >= 2 THEN 'BULL' WHEN rating <= -2 THEN 'BEAR' ELSE 'NEUTRAL' END AS direction FROM (
SELECT prediction_id, {R('s', 4)} AS score, CASE WHEN s >= 0.8 THEN 4 WHEN s >= 0.6 THEN 3 WHEN s >= 0.4 THEN 2 WHEN s >= 0.15 THEN 1 WHEN s > -0.15 THEN 0 WHEN s >= -0.4 THEN -1 WHEN s >= -0.6 THEN -2 WHEN s >= -0.8 THEN -3 ELSE -4 END AS rating
FROM (SELECT prediction_id, greatest(least(floor((least(greatest((p_bsl - p_ssl) * 2, -1), 1) * 0.3)::double * 10000 + 0.5) / 10000
  + floor((-sign(away) * least(abs(away) / 5, 1) * 0.15)::double * 10000 + 0.5) / 10000 + floor((least((prediction_id % 5) * 0.3::double, 1) * 0.1::double - least((client % 4) * 0.3::double, 1) * 0.1::double) * 10000 + 0.5) / 10000
  + floor((CASE prediction_id % 3 WHEN 0 THEN 0.5 WHEN 1 THEN -0.5 ELSE 0.0 END)::double * 0.05::double * 10000 + 0.5) / 10000, 1), -1) AS s
 FROM (SELECT *, (a - b) / b * 100 AS away FROM preds)))""", ("preds",))
def p19(spark, sf):
    i = F.col("prediction_id")
    reg = F.when(i % 3 == 0, "BULLISH").when(i % 3 == 1, "BEARISH").otherwise("NEUTRAL")
    s = C.rule_score(F.col("p_bsl"), F.col("p_ssl"), F.col("a"), F.col("b"), i % 5, F.col("client") % 4, reg, F.lit("NEUTRAL"))
    p = preds(spark, sf).select("prediction_id", s.alias("s"))
    rate = C.rating(F.col("s"))
    return p.select("prediction_id", r(F.col("s"), 4).alias("score"), rate.alias("rating"), C.rating_direction(rate).alias("direction"))


@query("p20_consensus", f"""
SELECT prediction_id, CASE WHEN x > y2 THEN least(br, 4) WHEN y2 > x THEN greatest(-er, -4) ELSE 0 END AS rating, CASE WHEN x > y2 THEN 'BULL' WHEN y2 > x THEN 'BEAR' ELSE 'NEUTRAL' END AS direction,
 {R('least(greatest(1 - abs(x - y2) / greatest(x, y2, 0.01), 0), 1)')} AS agreement,
 CASE WHEN prediction_id % 7 = 0 THEN 'LOW' WHEN abs(CASE WHEN x > y2 THEN least(br, 4) WHEN y2 > x THEN greatest(-er, -4) ELSE 0 END) >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS confidence
FROM (SELECT *, br * p_bsl AS x, er * p_ssl AS y2 FROM (SELECT *, (prediction_id % 5)::int AS br, (client % 5)::int AS er FROM preds))""", ("preds",))
def p20(spark, sf):
    c = C.consensus((F.col("prediction_id") % 5).cast("int"), F.col("p_bsl"), (F.col("client") % 5).cast("int"), F.col("p_ssl"), F.col("prediction_id") % 7 == 0)
    return preds(spark, sf).select("prediction_id", c["rating"].alias("rating"), c["direction"].alias("direction"), r(c["agreement"]).alias("agreement"), c["confidence"].alias("confidence"))


@query("p22_degraded_confidence", f"SELECT prediction_id, {R('CASE WHEN prediction_id % 2 = 0 THEN pmax * 0.6 ELSE pmax END')} AS confidence FROM preds", ("preds",))
def p22(spark, sf):
    return preds(spark, sf).select("prediction_id", r(C.degraded_confidence(F.col("pmax"), F.col("prediction_id") % 2 == 0)).alias("confidence"))


def _ranked(x, part=""):
    p = f"PARTITION BY {part} " if part else ""
    q = f"PARTITION BY {part + ', ' if part else ''}{x}"
    return f"(rank() OVER ({p}ORDER BY {x}) + (count(*) OVER ({q}) - 1) / 2.0)"


@query("a12_information_coefficient", f"SELECT count(*) AS n, {R('corr(rx, ry)')} AS ic FROM (SELECT {_ranked('score')} AS rx, {_ranked('outcome')} AS ry FROM preds)", ("preds",))
def a12(spark, sf):
    return E.ic(preds(spark, sf)).select("n", r(F.col("ic")).alias("ic"))


@query("a13_ic_by_regime", f"SELECT regime, count(*) AS n, {R('corr(rx, ry)')} AS ic FROM (SELECT regime, {_ranked('score', 'regime')} AS rx, {_ranked('outcome', 'regime')} AS ry FROM preds) GROUP BY 1", ("preds",))
def a13(spark, sf):
    return E.ic(preds(spark, sf), ["regime"]).select("regime", "n", r(F.col("ic")).alias("ic"))


view("ovr", """SELECT prediction_id, regime, 'BSL' AS klass, p_bsl AS p, (label = 0)::int AS yy FROM preds UNION ALL SELECT prediction_id, regime, 'SSL', p_ssl, (label = 1)::int FROM preds
UNION ALL SELECT prediction_id, regime, 'LATERAL', p_lateral, (label = 2)::int FROM preds""", ("preds",))


@query("a14_ic_per_class", f"SELECT klass, {R('corr(rx, ry)')} AS ic FROM (SELECT klass, {_ranked('p', 'klass')} AS rx, {_ranked('yy', 'klass')} AS ry FROM ovr) GROUP BY 1", ("ovr",))
def a14(spark, sf):
    return E.ic_per_class(preds(spark, sf)).select("klass", r(F.col("ic")).alias("ic"))


view("numbered", "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_close_time, prediction_id) AS no FROM preds", ("preds",))
view("frames", f"""
SELECT f.symbol, f.prediction_id AS id, f.no, p.score, p.outcome, rank() OVER (w ORDER BY p.score) + (count(*) OVER (PARTITION BY f.symbol, f.no, p.score) - 1) / 2.0 AS rx,
       rank() OVER (w ORDER BY p.outcome) + (count(*) OVER (PARTITION BY f.symbol, f.no, p.outcome) - 1) / 2.0 AS ry
FROM numbered f JOIN numbered p ON p.symbol = f.symbol AND p.no BETWEEN f.no - 19 AND f.no WHERE f.no >= 20 WINDOW w AS (PARTITION BY f.symbol, f.no)""", ("numbered",))
view("rolling", """SELECT n.*, CASE WHEN no < 20 THEN NULL WHEN isnan(c) OR c IS NULL THEN 0 ELSE c END AS rolling_ic FROM numbered n LEFT JOIN
 (SELECT id, CASE WHEN stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN corr(rx, ry) END AS c FROM frames GROUP BY 1) f ON f.id = n.prediction_id""", ("numbered", "frames"))


def rolling(spark, sf):
    return E.rolling_ic(preds(spark, sf), 20, ["symbol"], "bar_close_time", "prediction_id")


@query("w30_rolling_ic", f"SELECT prediction_id, {R('rolling_ic', 5)} AS rolling_ic FROM rolling", ("rolling",))
def w30(spark, sf):
    return rolling(spark, sf).select("prediction_id", r(F.col("rolling_ic"), 5).alias("rolling_ic"))


#: Labels that stand in for the session and the impact at a prediction: key arithmetic over all rows.
SESSION = ("ASIAN", "LONDON", "NY_AM", "NY_PM")
IMPACT = ("LOW", "MEDIUM", "HIGH")
view("labelled", "SELECT *, " + str(list(SESSION)) + "[cast(prediction_id // 4 % 4 AS integer) + 1] AS session, " + str(list(IMPACT)) + "[cast(client % 3 AS integer) + 1] AS impact FROM rolling", ("rolling",))


def labelled(spark, sf):
    session = F.element_at(F.array(*map(F.lit, SESSION)), (F.floor(F.col("prediction_id") / 4) % 4 + 1).cast("int"))
    impact = F.element_at(F.array(*map(F.lit, IMPACT)), (F.col("client") % 3 + 1).cast("int"))
    return rolling(spark, sf).withColumns({"session": session, "impact": impact})


@query("a13_mean_ic", " UNION ALL ".join(f"SELECT '{k}' AS kind, {k} AS label, count(rolling_ic) AS n, {R('coalesce(avg(rolling_ic), 0)')} AS mean_ic FROM labelled GROUP BY 2" for k in ("regime", "session", "impact")), ("labelled",))
def a13m(spark, sf):
    """Mean rolling IC by regime, by session and by impact."""
    d, out = labelled(spark, sf), None
    for k in ("regime", "session", "impact"):
        m = E.mean_ic(d, k).select(F.lit(k).alias("kind"), F.col(k).alias("label"), "n", r(F.col("mean_ic")).alias("mean_ic"))
        out = m if out is None else out.unionByName(m)
    return out


@query("a15_ic_summary", f"SELECT {R('avg(rolling_ic)')} AS mean, {R('stddev_pop(rolling_ic)')} AS std, {R('min(rolling_ic)')} AS min, {R('max(rolling_ic)')} AS max, {R('avg((rolling_ic > 1e-9)::int)')} AS positive_ratio FROM rolling", ("rolling",))
def a15(spark, sf):
    s = E.ic_summary(rolling(spark, sf))
    return s.select(*[r(F.col(c)).alias(c) for c in s.columns])


CUT = "bar_close_time >= TIMESTAMP '1999-01-01'"


@query("a23_overfit_gap", f"""SELECT {R('b')} AS ic_backtest, {R('f')} AS ic_forward, {R('abs(b - f)')} AS gap, abs(b - f) > 0.15 AS overfit FROM (
 SELECT avg(rolling_ic) FILTER (NOT ({CUT})) AS b, avg(rolling_ic) FILTER ({CUT}) AS f FROM rolling)""", ("rolling",))
def a23(spark, sf):
    g = E.overfit_gap(rolling(spark, sf), F.col("bar_close_time") >= F.lit("1999-01-01").cast("timestamp"))
    return g.select(*[r(F.col(c)).alias(c) for c in ("ic_backtest", "ic_forward", "gap")], "overfit")


REGIMES = ("NORMAL", "TRENDING_LV", "TRENDING_HV", "CHOPPY_HV")


def _perf(label, v):
    own = f"{label} = '{v}'"
    good, wrong = f"count(*) FILTER ({own} AND y = 1 AND p_bsl >= 0.4)", f"count(*) FILTER ({own} AND (y = 1) <> (p_bsl >= 0.4))"
    return R(f"avg(rolling_ic) FILTER ({own})") + f" AS ic_{v}, " + R(f"CASE WHEN 2 * {good} + {wrong} > 0 THEN 2 * {good} / (2 * {good} + {wrong}) END") + f" AS f1_{v}"


@query("a31_performance_table", "SELECT year(bar_close_time)::bigint AS period, " + ", ".join(_perf(k, v) for k, vs in (("reg", REGIMES), ("session", SESSION)) for v in vs) + " FROM labelled GROUP BY 1", ("labelled",))
def a31(spark, sf):
    t = E.performance_table(labelled(spark, sf), F.year("bar_close_time").cast("bigint"), {"reg": REGIMES, "session": SESSION}, "p_bsl", "y", 0.4)
    return t.select("period", *[r(F.col(c)).alias(c) for c in t.columns[1:]])


SQ = {c: f"(p_{c} - (label = {i})::int) * (p_{c} - (label = {i})::int)" for i, c in enumerate(("bsl", "ssl", "lateral"))}


@query("a18_brier", f"SELECT regime, {R('avg(' + ' + '.join(SQ.values()) + ') / 3')} AS brier_cells, {R('avg(' + ' + '.join(SQ.values()) + ')')} AS brier_rows, {', '.join(R(f'avg({e})') + f' AS brier_{c}' for c, e in SQ.items())} FROM preds GROUP BY 1", ("preds",))
def a18(spark, sf):
    b = E.brier(preds(spark, sf), ["regime"])
    return b.select("regime", *[r(F.col(c)).alias(c) for c in b.columns[1:]])


def _ece(bin_, s, h, src, by=""):
    g = f"{by}, " if by else ""
    return f"SELECT {g}{R('sum(n * abs(s - h)) / sum(n)')} AS ece, sum(n)::bigint AS rows FROM (SELECT {g}{bin_} AS bin, count(*) AS n, avg({s}) AS s, avg({h}) AS h FROM {src} GROUP BY ALL) {'GROUP BY ' + by if by else ''}"


LEFT = "least(greatest(floor({} * 10), 0), 9)"


@query("a19_calibration_error", "SELECT 'confidence' AS form, * FROM (" + _ece("least(greatest(ceil(pmax * 10) - 1, 0), 9)", "pmax", "(pick = label)::int", "preds") + ") UNION ALL SELECT klass, ece, rows FROM (" + _ece(LEFT.format("p"), "p", "yy", "ovr", "klass") + ")", ("preds", "ovr"))
def a19(spark, sf):
    p = preds(spark, sf)
    a = E.ece(E.confidence_rows(p), "confidence", "hit", right_closed=True).withColumn("form", F.lit("confidence"))
    b = E.ece(E.one_vs_rest_rows(p), "p", "y", ["klass"]).withColumnRenamed("klass", "form")
    return a.unionByName(b).select("form", r(F.col("ece")).alias("ece"), "rows")


@query("a20_calibration_by_regime", f"""SELECT {R('max(ece)')} AS max_ece, {R('avg(ece)')} AS mean_ece, coalesce(list_sort(list(regime) FILTER (ece < 0.05)), []) AS below_target, coalesce(list_sort(list(regime) FILTER (ece >= 0.05)), []) AS above_target
FROM ({_ece(LEFT.format('p_bsl'), 'p_bsl', 'y', 'preds', 'regime')}) WHERE rows >= 5""", ("preds",))
def a20(spark, sf):
    e = E.ece_report(preds(spark, sf), "p_bsl", "y", "regime")
    return e.select(r(F.col("max_ece")).alias("max_ece"), r(F.col("mean_ece")).alias("mean_ece"), "below_target", "above_target")


CM = """SELECT regime, tp, tn, fp, fn, (tp + tn) / (tp + tn + fp + fn) AS accuracy, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall,
 (tp + fp) / (tp + tn + fp + fn) AS positive_rate FROM (SELECT regime, count(*) FILTER (p_bsl >= 0.4 AND y = 1) AS tp, count(*) FILTER (p_bsl < 0.4 AND y = 0) AS tn, count(*) FILTER (p_bsl >= 0.4 AND y = 0) AS fp, count(*) FILTER (p_bsl < 0.4 AND y = 1) AS fn FROM preds GROUP BY 1)"""


@query("a21_confusion", f"SELECT regime, tp, tn, fp, fn, {R('accuracy')} AS accuracy, {R('precision')} AS precision, {R('recall')} AS recall, {R('positive_rate')} AS positive_rate, {R('CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END')} AS f1 FROM ({CM})", ("preds",))
def a21(spark, sf):
    c = E.confusion(preds(spark, sf), "p_bsl", "y", 0.4, ["regime"])
    return c.select("regime", "tp", "tn", "fp", "fn", *[r(F.col(x)).alias(x) for x in ("accuracy", "precision", "recall", "positive_rate", "f1")])


view("grid", """
SELECT g, th, count(*) FILTER (p_bsl >= th) AS pos, count(*) FILTER (p_bsl >= th AND y = 1) AS tp, count(*) FILTER (y = 1) AS hits, count(*) AS n
FROM preds, (SELECT g, 0.05::double + (0.95::double - 0.05::double) * g / 99 AS th FROM (SELECT unnest(range(100)) AS g)) GROUP BY 1, 2""", ("preds",))


@query("a22_best_threshold", f"""SELECT kind, {R('th')} AS threshold, {R('v')} AS value FROM (
 (SELECT 'f1' AS kind, th, 2.0 * tp / (2 * tp + (hits - tp) + (pos - tp)) AS v FROM grid ORDER BY round(v, 12) DESC, g LIMIT 1)
 UNION ALL (SELECT 'cost', th, (2.5 * (pos - tp) + (hits - tp)) / n AS v FROM grid ORDER BY round(v, 12), g LIMIT 1))""", ("grid",))
def a22(spark, sf):
    p = preds(spark, sf)
    a = E.best_threshold(p, "p_bsl", "y").select(F.lit("f1").alias("kind"), "threshold", F.col("f_beta").alias("value"))
    b = E.cheapest_threshold(p, "p_bsl", "y").select(F.lit("cost").alias("kind"), "threshold", F.col("cost").alias("value"))
    return a.unionByName(b).select("kind", r(F.col("threshold")).alias("threshold"), r(F.col("value")).alias("value"))


@query("a30_area_under_curves", f"""
, c AS (SELECT p_bsl AS s, sum(y) AS p, count(*) AS n FROM preds GROUP BY 1),
k AS (SELECT *, sum(n) OVER (ORDER BY s) AS upto, sum(p) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS seen, sum(p) OVER () AS tot, sum(n) OVER () AS cnt FROM c)
SELECT {R('(sum(p * (upto - (n - 1) / 2.0)) - any_value(tot) * (any_value(tot) + 1) / 2.0) / (any_value(tot) * (any_value(cnt) - any_value(tot))::double)')} AS auroc, {R('sum(p * tp / seen::double) / any_value(tot)')} AS auprc FROM k""", ("preds",))
def a30(spark, sf):
    a = E.auc(preds(spark, sf), "p_bsl", "y")
    return a.select(r(F.col("auroc")).alias("auroc"), r(F.col("auprc")).alias("auprc"))


TM = """SELECT {g} count(*) AS trades, avg((pnl > 0)::int) AS win_rate, sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END) AS gp, sum(CASE WHEN pnl < 0 THEN -pnl ELSE 0 END) AS gl, avg(pnl) AS m, stddev_pop(pnl) AS s, avg(hold_bars) AS h FROM trades {by}"""


@query("a24_trade_metrics", f"SELECT symbol, trades, {R('win_rate')} AS win_rate, {R('CASE WHEN gl > 0 THEN gp / gl ELSE gp END')} AS profit_factor, {R('CASE WHEN s > 0 THEN m / s * sqrt(252.0) ELSE 0 END')} AS sharpe, {R('h')} AS avg_hold_bars FROM ({TM.format(g='symbol,', by='GROUP BY 1')})", ("trades",))
def a24(spark, sf):
    t = E.trade_metrics(V.trades(spark, sf), ["symbol"])
    return t.select("symbol", "trades", *[r(F.col(c)).alias(c) for c in ("win_rate", "profit_factor", "sharpe", "avg_hold_bars")])


ORD = ", ".join(V.TRADE_ORDER)
view("curve", f"SELECT *, max(equity) OVER (ORDER BY {ORD} ROWS UNBOUNDED PRECEDING) AS peak FROM (SELECT *, sum(pnl) OVER (ORDER BY {ORD} ROWS UNBOUNDED PRECEDING) AS equity FROM trades)", ("trades",))


@query("w31_equity_curve", f"SELECT date_trunc('month', l_shipdate)::date::varchar AS month, count(*) AS trades, {R('max(peak)', 4)} AS peak, {R('min(equity)', 4)} AS low FROM curve GROUP BY 1", ("curve",))
def w31(spark, sf):
    c = E.equity_curve(V.trades(spark, sf), [], list(V.TRADE_ORDER))
    m = F.date_format(F.trunc(F.col("l_shipdate").cast("date"), "month"), "yyyy-MM-dd")
    return c.groupBy(m.alias("month")).agg(F.count(F.lit(1)).alias("trades"), r(F.max("peak"), 4).alias("peak"), r(F.min("equity"), 4).alias("low"))


@query("w31_max_drawdown", f"SELECT {R('max(CASE WHEN peak > 0 THEN (peak - equity) / peak ELSE 0 END)')} AS max_drawdown, {R('sum(pnl)', 2)} AS total_pnl FROM curve", ("curve",))
def w31d(spark, sf):
    d = E.max_drawdown(E.equity_curve(V.trades(spark, sf), [], list(V.TRADE_ORDER)), [])
    return d.select(r(F.col("max_drawdown")).alias("max_drawdown"), r(F.col("total_pnl"), 2).alias("total_pnl"))


@query("a26_latency_statistics", f"""
, last AS (SELECT * FROM (SELECT symbol, value, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, seq DESC) AS rk FROM (SELECT t.*, e.value FROM ticks t JOIN events e ON e.event_id = t.seq)) WHERE rk <= 100)
SELECT symbol, n, {R('a')} AS avg, {R('v[least(floor(n * 0.95), n - 1)::int + 1]')} AS p95, {R('v[least(floor(n * 0.99), n - 1)::int + 1]')} AS p99, {R('mx')} AS max FROM (
 SELECT symbol, count(*) AS n, avg(value) AS a, max(value) AS mx, list_sort(list(value)) AS v FROM last GROUP BY 1)""", ("ticks",))
def a26(spark, sf):
    e = V.events(spark, sf).withColumnRenamed("event_type", "symbol")
    s = E.latency_statistics(e, "value", ["symbol"], F.struct("ts", "event_id"))
    return s.select("symbol", "n", *[r(F.col(c)).alias(c) for c in ("avg", "p95", "p99", "max")])


@query("a26_latency_histogram", "SELECT event_type AS symbol, CASE WHEN value <= 1 THEN 1 WHEN value <= 5 THEN 5 WHEN value <= 10 THEN 10 WHEN value <= 50 THEN 50 WHEN value <= 100 THEN 100 END::double AS le, count(*) AS n FROM events GROUP BY 1, 2")
def a26h(spark, sf):
    return E.histogram(V.events(spark, sf).withColumnRenamed("event_type", "symbol"), "value", ["symbol"], [1, 5, 10, 50, 100])


@query("a27_daily_cost", f"""SELECT ts::date::varchar AS day, sum(user_id)::bigint AS tokens, {R('sum(user_id) / 3.0 / 1000 * 0.01 + sum(user_id) * 2 / 3.0 / 1000 * 0.03')} AS cost,
 (sum(user_id) / 3.0 / 1000 * 0.01 + sum(user_id) * 2 / 3.0 / 1000 * 0.03) > 0.6 AS over_budget FROM events GROUP BY 1""")
def a27(spark, sf):
    c = E.daily_cost(V.events(spark, sf), "user_id", F.date_format("ts", "yyyy-MM-dd"), 0.01, 0.03, 0.6)
    return c.select("day", "tokens", r(F.col("cost")).alias("cost"), "over_budget")


@query("a28_performance_by_regime", f"""SELECT coalesce(reg, 'ALL') AS reg, count(*) AS n, {R('avg(rolling_ic)')} AS mean_ic, count(*) FILTER (p_bsl >= 0.4 AND y = 1) AS tp, count(*) FILTER (p_bsl >= 0.4) AS pos FROM rolling GROUP BY ROLLUP (reg)""", ("rolling",))
def a28(spark, sf):
    d = rolling(spark, sf)
    pos = F.col("p_bsl") >= 0.4
    g = d.rollup("reg").agg(F.count(F.lit(1)).alias("n"), r(F.avg("rolling_ic")).alias("mean_ic"), F.count_if(pos & (F.col("y") == 1)).alias("tp"), F.count_if(pos).alias("pos"))
    return g.withColumn("reg", F.coalesce("reg", F.lit("ALL")))


def _psi_sql():
    one = []
    for name, col in V.DRIFT_COLUMNS.items():
        one.append(f"SELECT '{name}' AS feature, {col}::double AS v, l_shipdate < TIMESTAMP '1998-01-01' AS is_ref FROM lineitem")
    return " UNION ALL ".join(one)


view("long_f", _psi_sql())
view("edges", "SELECT feature, list_sort(list_distinct(quantile_cont(v, [0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]))) AS e FROM long_f WHERE is_ref GROUP BY 1", ("long_f",))
view("binned", """SELECT feature, is_ref, CASE WHEN v = e[-1] THEN len(e) - 2 WHEN v < e[1] OR v > e[-1] THEN NULL ELSE len(list_filter(e, lambda x: x <= v)) - 1 END AS bin, count(*) AS n FROM long_f JOIN edges USING (feature) GROUP BY ALL""", ("long_f", "edges"))
view("psi_scores", """
SELECT feature, sum((q - p) * ln(q / p)) AS psi, count(*) AS bins FROM (
 SELECT feature, bin, greatest(coalesce(max(n) FILTER (is_ref), 0) / any_value(tr), 1e-10) AS p, greatest(coalesce(max(n) FILTER (NOT is_ref), 0) / any_value(tc), 1e-10) AS q FROM (
  SELECT *, sum(n) FILTER (is_ref) OVER (PARTITION BY feature) AS tr, sum(n) FILTER (NOT is_ref) OVER (PARTITION BY feature) AS tc FROM binned) WHERE bin IS NOT NULL GROUP BY 1, 2) GROUP BY 1""", ("binned",))


@query("a16_stability_index", f"SELECT feature, {R('psi')} AS psi, bins FROM psi_scores", ("psi_scores",))
def a16(spark, sf):
    return D.psi(*V.drift_sets(spark, sf), list(V.DRIFT_COLUMNS)).select("feature", r(F.col("psi")).alias("psi"), "bins")


@query("a17_drift_report", f"""SELECT {R('avg(psi)')} AS drift_score, {R('avg((psi >= 0.2)::int)')} AS drifted_share, count(*) FILTER (psi < 0.1) AS low, count(*) FILTER (psi >= 0.1 AND psi < 0.25) AS moderate,
 count(*) FILTER (psi >= 0.25) AS high, list(feature ORDER BY psi DESC, feature)[1:5] AS top_features, avg(psi) > 0.4 AS degraded FROM psi_scores""", ("psi_scores",))
def a17(spark, sf):
    d = D.drift_report(D.psi(*V.drift_sets(spark, sf), list(V.DRIFT_COLUMNS)))
    return d.select(r(F.col("drift_score")).alias("drift_score"), r(F.col("drifted_share")).alias("drifted_share"), "low", "moderate", "high", "top_features", "degraded")


@query("p23_model_gate", f"""SELECT regime, list_filter([CASE WHEN ic < 0.05 THEN 'ic' END, CASE WHEN brier > 0.25 THEN 'brier' END, CASE WHEN ece > 0.05 THEN 'ece' END], lambda x: x IS NOT NULL) AS reasons FROM
 (SELECT regime, corr(rx, ry) AS ic FROM (SELECT regime, {_ranked('score', 'regime')} AS rx, {_ranked('outcome', 'regime')} AS ry FROM preds) GROUP BY 1)
 JOIN (SELECT regime, avg({' + '.join(SQ.values())}) / 3 AS brier FROM preds GROUP BY 1) USING (regime) JOIN ({_ece(LEFT.format('p_bsl'), 'p_bsl', 'y', 'preds', 'regime')}) USING (regime)""", ("preds",))
def p23(spark, sf):
    p = preds(spark, sf)
    m = E.ic(p, ["regime"]).join(E.brier(p, ["regime"]), "regime").join(E.ece(p, "p_bsl", "y", ["regime"]), "regime")
    return m.select("regime", C.gate_reasons({"ic": F.col("ic"), "brier": F.col("brier_cells"), "ece": F.col("ece")}).alias("reasons"))


@query("p24_tuning_gates", """SELECT symbol, n >= 200 AND ic < 0.05 AS fine_tune, CASE WHEN old = 0 THEN ic > 0.01 ELSE ic > 1.1 * old END AS deploy, ic <= old * (1.1 - 0.1) AS roll_back FROM (
 SELECT symbol, avg(rolling_ic) AS ic, count(*) AS n, avg(rolling_ic) FILTER (bar_close_time < TIMESTAMP '1997-01-01') AS old FROM rolling GROUP BY 1)""", ("rolling",))
def p24(spark, sf):
    early = F.col("bar_close_time") < F.lit("1997-01-01").cast("timestamp")
    m = rolling(spark, sf).groupBy("symbol").agg(F.avg("rolling_ic").alias("ic"), F.count(F.lit(1)).alias("n"), F.avg(F.when(early, F.col("rolling_ic"))).alias("old"))
    return m.select("symbol", C.should_fine_tune(F.col("ic") < 0.05, F.col("n")).alias("fine_tune"), C.should_deploy(F.col("ic"), F.col("old")).alias("deploy"), C.should_roll_back(F.col("ic"), F.col("old")).alias("roll_back"))


@query("p26_metric_status", f"""SELECT regime, CASE WHEN brier <= 0.20 THEN 'good' WHEN brier <= 0.28 THEN 'warning' ELSE 'degraded' END AS brier_status,
 CASE WHEN acc >= 0.65 THEN 'good' WHEN acc >= 0.5 THEN 'warning' ELSE 'degraded' END AS f1_status FROM (SELECT regime, avg({' + '.join(SQ.values())}) / 3 AS brier, avg((pick = label)::int) AS acc FROM preds GROUP BY 1)""", ("preds",))
def p26(spark, sf):
    p = E.confidence_rows(preds(spark, sf))
    m = E.brier(p, ["regime"]).join(p.groupBy("regime").agg(F.avg("hit").alias("acc")), "regime")
    return m.select("regime", C.status("brier", F.col("brier_cells")).alias("brier_status"), C.status("f1", F.col("acc")).alias("f1_status"))


@query("u04_distinct_labels", "SELECT DISTINCT symbol, regime FROM preds", ("preds",))
def u04(spark, sf):
    return preds(spark, sf).select("symbol", "regime").distinct()
