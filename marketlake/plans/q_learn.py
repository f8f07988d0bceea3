"""Feature vectors, models and composite jobs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marketlake.functions import scoring as C
from marketlake.functions.ticks import r
from marketlake.operators import contributions as G
from marketlake.operators import dataset as T
from marketlake.operators import evaluation as E
from marketlake.operators import features as X
from marketlake.operators import flow as L
from marketlake.operators import indicators as I
from marketlake.operators import isotonic
from marketlake.operators import macro as M
from marketlake.operators import models as ML
from marketlake.operators import structure as S
from marketlake.operators import usv as U
from marketlake.operators import zones as Z
from marketlake.operators.skill import skill
from marketlake.plans import composite as J
from marketlake.plans.q_data import column_sums
from marketlake.plans.q_flow import STATS
from marketlake.plans.q_macro import INEWS, with_impact
from marketlake.plans.q_quality import BEAR, MOM, SQ, _ranked, preds
from marketlake.plans.q_structure import BODY
from marketlake.plans.q_zones import day_preds, labelled_zones, zone_table
from marketlake.plans.registry import query
from marketlake.plans.sqlviews import R, view
from marketlake.sources import views as V


def rv(c, digits=5):
    """Rounded array column."""
    return F.transform(c, lambda x: F.round(x, digits) + F.lit(0.0))


def _near(col, term, high, default):
    return f"coalesce(max({col}) FILTER (term = '{term}' AND is_high = {high}), {default})"


_T = ("ST", "IT", "LT")
_DIST = "CASE WHEN is_high THEN price - price_now ELSE price_now - price END / atr_now"
_V = [_near(f"({_DIST})", t, h, 0) for h in ("TRUE", "FALSE") for t in _T] + [_near("minutes_since", t, h, 200) for h in ("TRUE", "FALSE") for t in _T] + ["0", "0", "0", "0"] + [
    _near("unclaimed / (10.0::double + 1e-9)", t, h, 0) for h in ("TRUE", "FALSE") for t in _T]
view("taken", """SELECT symbol, coalesce(avg((claimed_bar_no IS NOT NULL)::int) FILTER (term = 'IT'), 0) AS it, coalesce(avg((claimed_bar_no IS NOT NULL)::int) FILTER (term = 'LT'), 0) AS lt
FROM (SELECT *, row_number() OVER (PARTITION BY symbol, term ORDER BY bar_no DESC, is_high) AS rk FROM claims) WHERE rk <= 50 GROUP BY 1""", ("claims",))


@query("f01_liquidity_vector", "SELECT symbol, [" + ", ".join(f"round(({v})::double, 5) + 0.0" for v in _V) + ", round(any_value(it), 5) + 0.0, round(any_value(lt), 5) + 0.0] AS f_liq FROM nearest JOIN taken USING (symbol) GROUP BY 1", ("nearest", "taken"))
def f01(spark, sf):
    b = V.day_bars(spark, sf)
    c = S.claim(S.tiers(b), b).persist()
    return X.f_liq(c, b).select("symbol", rv(F.col("f_liq")).alias("f_liq"))


@query("f02_structure_vectors")
def f02(spark, sf):
    f = J.structure_features(V.day_bars(spark, sf))
    return f.select("symbol", rv(F.col("f_struct")).alias("f_struct"), rv(F.col("f_agg")).alias("f_agg"))


@query("f03_session_weights", """SELECT seq, [45 * w_ltf, 49 * w_ltf, 46.0] AS slots FROM (SELECT seq, w_ltf FROM sess)""", ("sess",))
def f03(spark, sf):
    t = M.sessions(V.ticks(spark, sf))
    v = X.session_weighted(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda x: x.cast("double")), F.col("w_ltf"))
    return t.withColumn("v", v).select("seq", F.array(F.col("v")[45], F.col("v")[49], F.col("v")[46]).alias("slots"))


_FLOW = ["CASE WHEN volume > 0 THEN cvd / volume ELSE 0 END", "iii", "sign(close - open) * sign(cvd)", *[STATS[n] for n in ("cvd_slope5", "cvd_slope10", "cvd_slope20", "cvd_std10", "cvd_z", "iii_slope5", "iii_slope10", "iii_mean20", "iii_std20", "iii_z")], "obi",
         STATS["obi_slope5"], STATS["obi_mean20"], STATS["obi_std20"], "spread", STATS["spread_z"]]


@query("f04_flow_vector", "SELECT symbol, bar_no, [" + ", ".join(f"round(({v})::double, 5) + 0.0" for v in _FLOW) + ", 0.0] AS f_flow FROM h1_iii", ("h1_iii",))
def f04(spark, sf):
    return X.flow_vectors(V.flow_bars(spark, sf)).select("symbol", "bar_no", rv(F.col("f_flow")).alias("f_flow"))


@query("f05_macro_vector", f"""SELECT m.seq, [round(CASE WHEN c.event_id IS NULL THEN 0.0 ELSE {INEWS} END, 5), round(coalesce(CASE WHEN l.f <> 0 THEN (l.a - l.f) / greatest(abs(l.f), 0.001) END, 0), 5), round(least(coalesce(to_next / 3600, 1), 1), 5), (state IN ('CLUSTER', 'PRE_NEWS', 'NEWS_WINDOW'))::int, (session = 'ASIAN')::int, (session IN ('LONDON', 'LONDON_OPEN_KZ'))::int,
 (state = 'PRE_NEWS')::int, (state = 'NEWS_WINDOW')::int, (state = 'CLUSTER')::int, CASE WHEN c.event_id IS NULL THEN 0 ELSE 1 END, 0.0, 0.0]::double[] AS f_macro FROM macro m JOIN sess USING (seq) LEFT JOIN (SELECT event_id, impact, actual FROM calendar) c ON c.event_id = m.next_event_id LEFT JOIN (SELECT event_id AS last_id, actual AS a, forecast AS f FROM calendar) l ON l.last_id = m.last_event_id""", ("macro", "sess", "calendar"))
def f05(spark, sf):
    d = M.sessions(M.with_macro_state(V.ticks(spark, sf), V.calendar(spark, sf)))
    c = with_impact(spark, sf)
    j = d.join(c.select(F.col("event_id").alias("next_event_id"), "i_base", F.lit(1.0).alias("code")), "next_event_id", "left")
    # the surprise that is known by then: that of the last event
    last = c.select(F.col("event_id").alias("last_event_id"), M.surprise_z(F.col("actual"), F.col("forecast"), F.lit(None)).alias("surprise"))
    j = j.join(last, "last_event_id", "left")
    zero, far = F.lit(0.0), F.lit(3600.0)
    v = X.f_macro(F.coalesce("i_base", zero), F.coalesce("surprise", zero), F.coalesce("seconds_to_next", far), F.col("guardrail"), F.col("session"), F.col("macro_state"), F.col("macro_state") == "CLUSTER", F.coalesce("code", zero))
    return j.select("seq", rv(v).alias("f_macro"))


@query("f06_zone_vector", """SELECT z.symbol, z.kind, z.imb_no, [round((top - bottom) / atr_now, 4), bar_now - close_bar_no, 1.0, CASE z.kind WHEN 'iFVG' THEN 1.0 ELSE 0.0 END, p_hold, coalesce(n, 0), CASE WHEN mitigated_bar_no IS NOT NULL THEN 0.6 ELSE 0.0 END, 0.0,
 CASE zone WHEN 'premium' THEN 1.0 WHEN 'discount' THEN 0.0 ELSE 0.5 END, w_zone, 0.0, round(abs(middle - price_now) / atr_now, 4), 0.0, 0.0, 0.0, 0.0]::double[] AS f_zone
FROM zones z JOIN now USING (symbol) LEFT JOIN (SELECT symbol, kind, imb_no, count(*) AS n FROM zone_touch GROUP BY 1, 2, 3) t USING (symbol, kind, imb_no)""", ("zones", "now", "zone_touch"))
def f06(spark, sf):
    z, b = zone_table(spark, sf)
    now = S.last_close(b).join(I.atr_wilder(b).groupBy("symbol", "tf").agg(F.max_by("atr", "bar_no").alias("atr_now")), ["symbol", "tf"])
    z = z.join(Z.touches(z, b), list(Z.ZONE_KEY), "left").join(now, ["symbol", "tf"])
    zero = F.lit(0.0)
    v = X.f_zone(F.col("bar_now") - F.col("close_bar_no"), F.col("tf"), F.coalesce("touch_count", F.lit(0)), F.when(F.col("mitigated_bar_no").isNotNull(), "BODY_FILLED").otherwise("UNMITIGATED"), zero, zero, F.col("price_now"), F.col("atr_now"))
    return z.select("symbol", "kind", "imb_no", rv(v, 4).alias("f_zone"))


def contact_rows(spark, sf):
    """Every zone that was touched, with the bar of its first touch."""
    z, b = labelled_zones(spark, sf)
    c = X.contact_inputs(b).select("symbol", "tf", F.col("bar_no").alias("first_touch_no"), "open", "close", "volume", F.col("atr").alias("atr_c"), "body_std", "v_avg20")
    z = z.join(c, ["symbol", "tf", "first_touch_no"])
    zero = F.lit(0.0)
    return z.withColumn("f_contact", X.f_contact(F.col("atr_c"), zero, zero, zero, zero, F.coalesce("body_std", zero), F.col("v_avg20"), zero))


@query("f07_contact_vector", f""", w AS (SELECT symbol, bar_no, stddev_pop({BODY}) OVER (PARTITION BY symbol ORDER BY bar_no ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS sd,
 avg(volume) OVER (PARTITION BY symbol ORDER BY bar_no ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS va, volume AS vol FROM day_bars)
SELECT t.symbol, t.kind, t.imb_no, {R('CASE WHEN z.top <> z.bottom THEN (b.close - z.middle) / ((z.top - z.bottom) / 2) ELSE 0 END', 4)} AS ce, {R('abs(b.open - b.close) / b.atr', 4)} AS body,
 {R('CASE WHEN z.top <> z.bottom THEN (b.close - z.bottom) / (z.top - z.bottom) ELSE 0 END', 4)} AS position,
 {R('CASE WHEN coalesce(w.sd, 0) <> 0 THEN abs(b.open - b.close) / (w.sd * 100) ELSE 0 END', 4)} AS deviation, {R('CASE WHEN w.va <> 0 THEN w.vol / w.va ELSE 0 END', 4)} AS volume_ratio
FROM zone_touch t JOIN zones z USING (symbol, kind, imb_no) JOIN day_atr b ON b.symbol = t.symbol AND b.bar_no = t.bar_no JOIN w ON w.symbol = t.symbol AND w.bar_no = t.bar_no WHERE rk = 1""", ("zone_touch", "zones", "day_atr", "day_bars"))
def f07(spark, sf):
    v = F.col("f_contact")
    return contact_rows(spark, sf).select("symbol", "kind", "imb_no", r(v[0], 4).alias("ce"), r(v[1], 4).alias("body"), r(v[8], 4).alias("position"), r(v[5], 4).alias("deviation"), r(v[6], 4).alias("volume_ratio"))


@query("f08_assembled_vectors", "SELECT symbol, bar_no, 648::bigint AS size_a, 560::bigint AS size_b, round((iii)::double, 5) + 0.0 AS at_537 FROM h1_iii", ("h1_iii",))
def f08(spark, sf):
    f = X.flow_vectors(V.flow_bars(spark, sf))
    z = F.array_repeat(F.lit(0.0), 100)
    none = F.array().cast("array<double>")
    a = X.assemble("A", z, liq=none, flow=F.col("f_flow"), macro=none, struct=none, agg=none)
    b = X.assemble("B", z, zone=none, contact=none, macro=none)
    return f.select("symbol", "bar_no", F.size(a).cast("bigint").alias("size_a"), F.size(b).cast("bigint").alias("size_b"), r(a[537], 5).alias("at_537"))


# ---------------------------------------------------------------- models

COLS = ("a", "b", "p_bsl", "p_ssl", "p_lateral")


def training(spark, sf):
    p = preds(spark, sf)
    return T.split_by_date(p, F.col("bar_close_time"), "1999-06-01", "2000-06-01")


def scored_direction(spark, sf, kind="forest", weight=None):
    d = ML.as_features(training(spark, sf), COLS).drop(*E.P).persist()
    train = d.filter("split = 'train'").select("features", "label")
    if kind == "boosted":
        train = d.filter("split <> 'test'").select("features", "label", (F.col("split") == "val").alias("valid"))
    m = ML.fit_direction(train, trees=10, depth=4, kind=kind)
    return m, d, ML.class_probabilities(m, d)


SPLIT = "CASE WHEN bar_close_time < TIMESTAMP '1999-06-01' THEN 'train' WHEN bar_close_time < TIMESTAMP '2000-06-01' THEN 'val' ELSE 'test' END"


@query("m04_direction_model", f"""SELECT kind, split, count(*) AS n, true AS distributions FROM (SELECT {SPLIT} AS split FROM predictions), (VALUES ('forest'), ('boosted')) k(kind)
GROUP BY 1, 2""", ("predictions",))
def m04(spark, sf):
    """Rows of each split that got a distribution over the three classes, by either kind of model."""
    out = None
    for kind in ("forest", "boosted"):
        _, _, s = scored_direction(spark, sf, kind)
        fine = F.abs(F.col("p_bsl") + F.col("p_ssl") + F.col("p_lateral") - 1) < 1e-9
        for p in E.P:
            fine = fine & F.col(p).between(0, 1)
        s = s.groupBy(F.lit(kind).alias("kind"), "split").agg(F.count(F.lit(1)).alias("n"), F.bool_and(fine).alias("distributions"))
        out = s if out is None else out.unionByName(s)
    return out


def distribution(*cols):
    """True where every probability is one."""
    fine = F.lit(True)
    for c in cols:
        fine = fine & F.col(c).between(0, 1)
    return F.bool_and(fine)


def hold_scores(spark, sf):
    """Zones split by time: the first six tenths of a symbol's bars train, the last two test."""
    z = contact_rows(spark, sf)
    ends = V.day_bars(spark, sf).groupBy("symbol").agg(F.max("bar_no").alias("_end"))
    z = z.join(ends, "symbol").withColumn("label", F.col("held").cast("int")).withColumn("part", F.floor(F.col("close_bar_no") * 10 / (F.col("_end") + 1)))
    d = z.withColumn("features", ML.array_to_vector("f_contact")).select(*Z.ZONE_KEY, "label", "part", "features").persist()
    m = ML.fit_hold(d.filter("part < 6"), trees=5, depth=3)
    return d, ML.hold_probability(m, d)


@query("m05_hold_model", """SELECT floor(close_bar_no * 10 / (e + 1))::bigint AS part, count(*) AS n, sum(held)::bigint AS positives, true AS probabilities
FROM hold_lab JOIN zones USING (symbol, kind, imb_no) JOIN (SELECT symbol, max(bar_no) AS e FROM day_bars GROUP BY 1) USING (symbol) WHERE floor(close_bar_no * 10 / (e + 1)) >= 8 GROUP BY 1""", ("hold_lab", "zones", "day_bars"))
def m05(spark, sf):
    _, s = hold_scores(spark, sf)
    return s.filter("part >= 8").groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("positives"), distribution("p_hold").alias("probabilities"))


def calibration(spark, sf, kind):
    p = training(spark, sf)
    c = ML.calibrated(ML.calibrate(p.filter("split = 'val'"), "p_bsl", "y", kind), p.filter("split = 'test'"))
    # from one of 50 bins of the score to the next the calibrated values go one way only
    w = Window.orderBy("bin")
    steps = c.groupBy(F.floor(F.col("p_bsl") * 50).alias("bin")).agg(F.min("p").alias("lo"), F.max("p").alias("hi"))
    steps = steps.select((F.col("lo") >= F.lag("hi").over(w) - 1e-9).alias("up"), (F.col("hi") <= F.lag("lo").over(w) + 1e-9).alias("down"))
    rising = steps.agg(F.bool_and(F.coalesce("up", F.lit(True))) | F.bool_and(F.coalesce("down", F.lit(True)))).scalar()
    return c.groupBy("regime").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("positives"), distribution("p").alias("probabilities")).withColumn("monotone", rising)


CALIBRATED = f"SELECT regime, count(*) AS n, sum(y)::bigint AS positives, true AS probabilities, true AS monotone FROM (SELECT *, {SPLIT} AS split FROM preds) WHERE split = 'test' GROUP BY 1"


@query("m06_platt_calibration", CALIBRATED, ("preds",))
def m06(spark, sf):
    return calibration(spark, sf, "platt")


@query("m07_isotonic_calibration", CALIBRATED, ("preds",))
def m07(spark, sf):
    return calibration(spark, sf, "isotonic")


# The fit in closed form: at each score the greatest over all starts of the least mean over all ends.
@query("m07_isotonic_values", f""", v AS (SELECT *, {SPLIT} AS split FROM preds),
pts AS (SELECT p_bsl AS x, count(*) AS w, sum(y) AS s FROM v WHERE split = 'val' GROUP BY 1),
c AS (SELECT x, w, s, row_number() OVER (ORDER BY x) AS i, sum(w) OVER (ORDER BY x) AS cw, sum(s) OVER (ORDER BY x) AS cs FROM pts),
least_mean AS (SELECT b.i, min((b.cs - a.cs + a.s) / (b.cw - a.cw + a.w)) OVER (PARTITION BY a.i ORDER BY b.i DESC ROWS UNBOUNDED PRECEDING) AS m FROM c a JOIN c b ON b.i >= a.i),
fit AS (SELECT x, g FROM c JOIN (SELECT i, max(m) AS g FROM least_mean GROUP BY 1) USING (i)),
t AS (SELECT prediction_id, y, p_bsl, a.x AS xa, a.g AS ga FROM (SELECT * FROM v WHERE split = 'test') ASOF LEFT JOIN fit a ON p_bsl >= a.x),
n AS (SELECT t.*, b.x AS xb, b.g AS gb FROM t ASOF LEFT JOIN fit b ON t.p_bsl <= b.x)
SELECT prediction_id, y, {R('CASE WHEN ga IS NULL THEN gb WHEN gb IS NULL OR xa = xb THEN ga ELSE ga + (p_bsl - xa) / (xb - xa) * (gb - ga) END')} AS p FROM n""", ("preds",))
def m07v(spark, sf):
    """The calibrated probability of every test row, by a fit on the validation rows."""
    p = training(spark, sf)
    c = isotonic.values(p.filter("split = 'test'"), isotonic.fit(p.filter("split = 'val'"), "p_bsl", "y"), "p_bsl", "p")
    return c.select("prediction_id", "y", r(F.col("p")).alias("p"))


@query("m08_stacked_learner", f"SELECT regime, count(*) AS n, true AS distributions FROM (SELECT *, {SPLIT} AS split FROM preds) WHERE split = 'test' GROUP BY 1", ("preds",))
def m08(spark, sf):
    p = training(spark, sf).withColumn("consensus", F.col("p_bsl") - F.col("p_ssl")).withColumn("regime_code", (F.col("prediction_id") % 4).cast("double"))
    cols = [*E.P, "consensus", "regime_code"]
    m = ML.stack(p.filter("split = 'train'"), cols)
    t = ML.class_probabilities(m, ML.as_features(p.filter("split = 'test'"), cols).drop(*E.P))
    whole = F.bool_and(F.abs(sum(F.col(c) for c in E.P) - 1) < 1e-9)
    return t.groupBy("regime").agg(F.count(F.lit(1)).alias("n"), (distribution(*E.P) & whole).alias("distributions"))


@query("m09_batch_scoring", f"""
, adjusted AS (SELECT prediction_id, reg, b / (b + s + l) AS b, s / (b + s + l) AS s, l / (b + s + l) AS l FROM (
 SELECT prediction_id, reg, b0 - sh AS b, least(s0 + sh, 1) AS s, l FROM (
  SELECT *, CASE WHEN {BEAR} > 0.5 THEN b0 * {BEAR} * 0.1 ELSE 0 END AS sh FROM (
   SELECT prediction_id, reg, CASE WHEN q THEN p_bsl / (p_bsl + p_ssl) * (1 - l) ELSE p_bsl END AS b0, CASE WHEN q THEN p_ssl / (p_bsl + p_ssl) * (1 - l) ELSE p_ssl END AS s0, l FROM (
    SELECT *, reg IN ('NORMAL','TRENDING_LV') AS q, CASE WHEN reg IN ('NORMAL','TRENDING_LV') THEN least(1, p_lateral + 0.2 * (p_bsl + p_ssl)) ELSE p_lateral END AS l FROM preds))))),
named AS (SELECT *, CASE WHEN b >= s AND b >= l THEN 'BSL' WHEN s >= l THEN 'SSL' ELSE 'LATERAL' END AS dom, CASE WHEN reg IN ('TRENDING_LV','TRENDING_HV') AND greatest(b, s, l) >= 0.65 THEN 'HIGH'
 WHEN greatest(b, s, l) >= 0.85 THEN 'HIGH' WHEN greatest(b, s, l) >= 0.65 THEN 'MEDIUM' ELSE 'LOW' END AS quality FROM adjusted),
ruled AS (SELECT *, quality = 'LOW' OR (reg = 'CHOPPY_HV' AND quality = 'MEDIUM') OR (dom = 'BSL' AND {MOM} < -0.5) OR (dom = 'SSL' AND {MOM} > 0.5) AS rolled_back FROM named)
SELECT quality, CASE WHEN rolled_back THEN 'LATERAL' ELSE dom END AS direction, rolled_back, count(*) AS n FROM ruled GROUP BY 1, 2, 3""", ("preds",))
def m09(spark, sf):
    """Post-processing of the given probabilities under the strictest rollback rules."""
    i = F.col("prediction_id")
    o = ML.post_process(preds(spark, sf), F.col("reg"), (i % 11) / 10.0, "aggressive", (i % 21) / 10.0 - 1, (i % 4).cast("double"), i % 2)
    return o.groupBy("quality", "direction", "rolled_back").agg(F.count(F.lit(1)).alias("n"))


@query("m10_evaluation_job", f"""
, m AS (SELECT (SELECT corr(rx, ry) FROM (SELECT {_ranked('score')} AS rx, {_ranked('outcome')} AS ry FROM preds)) AS ic, (SELECT avg({' + '.join(SQ.values())}) / 3 FROM preds) AS brier,
 (SELECT sum(n * abs(s - h)) / sum(n) FROM (SELECT least(greatest(ceil(pmax * 10) - 1, 0), 9) AS bin, count(*) AS n, avg(pmax) AS s, avg((pick = label)::int) AS h FROM preds GROUP BY 1)) AS ece)
SELECT {R('ic')} AS ic, {R('brier')} AS brier, {R('ece')} AS ece, list_filter([CASE WHEN ic < 0.05 THEN 'ic' END, CASE WHEN brier > 0.25 THEN 'brier' END, CASE WHEN ece > 0.05 THEN 'ece' END], lambda x: x IS NOT NULL) AS reasons,
 NOT (ic < 0.05 OR brier > 0.25 OR ece > 0.05) AS deploy FROM m""", ("preds",))
def m10(spark, sf):
    """The evaluation of the given probabilities, and what keeps them from being deployed."""
    m = ML.evaluate(preds(spark, sf))
    return m.select(*[r(F.col(c)).alias(c) for c in ("ic", "brier", "ece")], "reasons", "deploy")


SKILL = ("brier", "prior_brier", "log_loss", "prior_log_loss")


def rounded_skill(d, *keys):
    return d.select(*keys, "n", *[r(F.col(c)).alias(c) for c in SKILL], "better")


@query("m10_skill", f""", v AS (SELECT *, {SPLIT} AS split FROM preds), s AS (SELECT avg((label = 0)::int) AS s0, avg((label = 1)::int) AS s1, avg((label = 2)::int) AS s2 FROM v WHERE split = 'train'),
e AS (SELECT regime, count(*) AS n, avg(((p_bsl - (label = 0)::int) ** 2 + (p_ssl - (label = 1)::int) ** 2 + (p_lateral - (label = 2)::int) ** 2) / 3) AS brier,
 avg(((s0 - (label = 0)::int) ** 2 + (s1 - (label = 1)::int) ** 2 + (s2 - (label = 2)::int) ** 2) / 3) AS prior_brier,
 avg(-ln(CASE label WHEN 0 THEN p_bsl WHEN 1 THEN p_ssl ELSE p_lateral END)) AS log_loss, avg(-ln(greatest(CASE label WHEN 0 THEN s0 WHEN 1 THEN s1 ELSE s2 END, 1e-15))) AS prior_log_loss FROM v, s WHERE split = 'test' GROUP BY 1)
SELECT regime, n, {', '.join(f"{R(c)} AS {c}" for c in SKILL)}, brier < prior_brier AND log_loss < prior_log_loss AS better FROM e""", ("preds",))
def m10s(spark, sf):
    """The given probabilities of each regime's test rows against the class shares of the training rows."""
    p = training(spark, sf)
    return rounded_skill(skill(p.filter("split = 'test'"), p.filter("split = 'train'"), ["regime"]), "regime")


@query("m04_model_skill")
def m04s(spark, sf):
    """The same figures of a forest and of boosted trees fitted here."""
    out = None
    for kind in ("forest", "boosted"):
        _, d, s = scored_direction(spark, sf, kind)
        k = skill(s.filter("split = 'test'"), d.filter("split = 'train'")).withColumn("kind", F.lit(kind))
        out = k if out is None else out.unionByName(k)
    return rounded_skill(out, "kind")


@query("m11_overconfidence_refit", f"""SELECT CASE WHEN pick <> label AND pmax > 0.4 THEN 0.5 ELSE 1.0 END::double AS weight, count(*) AS n, true AS distributions FROM (SELECT *, {SPLIT} AS split FROM preds) WHERE split = 'train' GROUP BY 1""", ("preds",))
def m11(spark, sf):
    """Rows of the second fit by weight, and whether that fit scores the test rows with distributions."""
    p = training(spark, sf)
    w = ML.overconfident_weights(p.filter("split = 'train'"), 0.4)
    m = ML.fit_direction(ML.as_features(w, COLS).select("features", "label", "weight"), trees=10, depth=4, weight="weight")
    t = ML.class_probabilities(m, ML.as_features(p.filter("split = 'test'"), COLS).drop(*E.P))
    return w.groupBy("weight").agg(F.count(F.lit(1)).alias("n")).withColumn("distributions", t.agg(distribution(*E.P)).scalar())


@query("k09_feature_importance", "SELECT ['" + "', '".join(sorted(COLS)) + "'] AS features, true AS ranked, true AS sums_to_one")
def k09(spark, sf):
    """Every feature has an importance; ranks follow it, and they sum to one."""
    m, _, _ = scored_direction(spark, sf)
    i = ML.importances(m, COLS, spark)
    order = F.sort_array(F.collect_list(F.struct("rank", "importance")))
    down = F.size(F.filter(F.sequence(F.lit(1), F.lit(len(COLS) - 1)), lambda k: F.element_at(order, k)["importance"] < F.element_at(order, k + 1)["importance"])) == 0
    return i.agg(F.sort_array(F.collect_list("feature")).alias("features"), down.alias("ranked"), (F.abs(F.sum("importance") - 1) < 1e-9).alias("sums_to_one"))


@query("k09_feature_contributions")
def k09c(spark, sf):
    """Mean absolute contribution of every feature to the score of the test rows' first class."""
    m, d, _ = scored_direction(spark, sf)
    return G.strongest(G.contributions(m, d.filter("split = 'test'"), COLS, 0), COLS)


# ---------------------------------------------------------------- composite jobs

@query("c01_ticks_to_bars", "SELECT symbol, tf, count(*) AS bars, sum(volume) AS volume, sum(cvd) AS cvd, sum(tick_count)::bigint AS ticks FROM bars_all GROUP BY 1, 2", ("bars_all",))
def c01(spark, sf):
    b = J.ticks_to_bars(V.ticks(spark, sf), spread_limit=V.SPREAD_LIMIT)
    return b.groupBy("symbol", "tf").agg(F.count(F.lit(1)).alias("bars"), F.sum("volume").alias("volume"), F.sum("cvd").alias("cvd"), F.sum("tick_count").alias("ticks"))


@query("c02_state_vectors", f"SELECT u.seq, session, state AS macro_state, {R('close_H1')} AS close_h1, {R('atr_M5', 4)} AS atr_m5 FROM usv u JOIN sess s ON s.seq = u.seq JOIN macro m ON m.seq = u.seq", ("usv", "sess", "macro"))
def c02(spark, sf):
    u = J.build_usv(V.ticks(spark, sf), V.quote_bars(spark, sf).persist(), V.calendar(spark, sf))
    return u.select("seq", "session", "macro_state", r(F.col("bars")["H1"]["close"]).alias("close_h1"), r(F.col("atr")["M5"], 4).alias("atr_m5"))


@query("c03_structure_features")
def c03(spark, sf):
    f = J.structure_features(V.day_bars(spark, sf), w_ltf=F.lit(0.5))
    return f.select("symbol", "pivots", r(F.col("equilibrium")).alias("equilibrium"), rv(F.col("f_struct")).alias("f_struct"))


@query("c04_guarded_features", f"SELECT symbol, count(*) AS pivots, {R('(max(price) FILTER (is_high) + min(price) FILTER (NOT is_high)) / 2')} AS equilibrium, 0.0::double AS total FROM pivots WHERE term <> 'ST' GROUP BY 1", ("pivots",))
def c04(spark, sf):
    f = J.structure_features(V.day_bars(spark, sf), htf_only=True)
    return f.select("symbol", "pivots", r(F.col("equilibrium")).alias("equilibrium"), F.aggregate("f_struct", F.lit(0.0), lambda s, x: s + x).alias("total"))


@query("c05_macro_context", f"SELECT event_id, {R(INEWS)} AS i_news, {R('prior_sigma', 4)} AS prior_sigma, CASE WHEN actual > forecast THEN 'BULLISH' WHEN actual < forecast THEN 'BEARISH' ELSE 'NEUTRAL' END AS direction FROM prior", ("prior",))
def c05(spark, sf):
    c = J.macro_context(V.calendar(spark, sf), M.news_impact(F.col("impact"), F.col("actual") * 0.5, F.lit(10.0)))
    return c.select("event_id", r(F.col("i_news")).alias("i_news"), r(F.col("prior_sigma"), 4).alias("prior_sigma"), "direction")


@query("c06_label_outcomes", "SELECT CASE WHEN coalesce(zone_hold, false) THEN 'ZONE_HOLD' ELSE outcome END AS outcome, count(*) AS n FROM res10 LEFT JOIN held_bars USING (symbol, bar_no) GROUP BY 1", ("res10", "held_bars"))
def c06(spark, sf):
    z, b = zone_table(spark, sf)
    return J.label_outcomes(day_preds(spark, sf, b), b, z, 10).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def _report(spark, sf):
    from marketlake.operators import drift as D

    psi = D.psi(*V.drift_sets(spark, sf), list(V.DRIFT_COLUMNS))
    return J.backtest_report(preds(spark, sf), V.trades(spark, sf), list(V.TRADE_ORDER), psi)


REPORT = f"""SELECT trades, {R('win_rate')} AS win_rate, {R('CASE WHEN gl > 0 THEN gp / gl ELSE gp END')} AS profit_factor, n, {R('ic')} AS ic, {R('dd')} AS max_drawdown, {R('fds')} AS drift_score, fds > 0.4 AS degraded FROM
 (SELECT count(*) AS trades, avg((pnl > 0)::int) AS win_rate, sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END) AS gp, sum(CASE WHEN pnl < 0 THEN -pnl ELSE 0 END) AS gl FROM trades),
 (SELECT count(*) AS n, corr(rx, ry) AS ic FROM (SELECT rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rx, rank() OVER (ORDER BY outcome) + (count(*) OVER (PARTITION BY outcome) - 1) / 2.0 AS ry FROM preds)),
 (SELECT max(CASE WHEN peak > 0 THEN (peak - equity) / peak ELSE 0 END) AS dd FROM curve), (SELECT avg(psi) AS fds FROM psi_scores)"""


@query("a25_backtest_report", REPORT, ("trades", "preds", "curve", "psi_scores"))
def a25(spark, sf):
    return _report(spark, sf).select("trades", r(F.col("win_rate")).alias("win_rate"), r(F.col("profit_factor")).alias("profit_factor"), "n", r(F.col("ic")).alias("ic"), r(F.col("max_drawdown")).alias("max_drawdown"), r(F.col("drift_score")).alias("drift_score"), "degraded")


@query("c07_backtest", REPORT.replace("SELECT trades,", "SELECT trades, ", 1), ("trades", "preds", "curve", "psi_scores"))
def c07(spark, sf):
    """The report through its JSON form, as it is stored."""
    from marketlake.sources import io

    rep = io.as_report(a25(spark, sf))
    return rep.select(F.from_json("report", "trades long, win_rate double, profit_factor double, n long, ic double, max_drawdown double, drift_score double, degraded boolean").alias("j")).select("j.*")


@query("c07_replay", f""", tr AS (SELECT r.symbol, prediction_id, CASE WHEN p_bsl > p_ssl THEN 1 ELSE -1 END * (CASE outcome WHEN 'BSL_HIT' THEN predicted_bsl_level WHEN 'SSL_HIT' THEN predicted_ssl_level ELSE x.close END - n.close) AS pnl, x.bucket AS closed_at, x.bar_no - n.bar_no AS hold
 FROM (SELECT *, CASE outcome WHEN 'BSL_HIT' THEN u WHEN 'SSL_HIT' THEN d ELSE bar_no + 10 END AS out_no FROM res10 WHERE outcome <> 'PENDING' AND p_bsl <> p_ssl AND greatest(p_bsl, p_ssl) >= p_lateral) r
 JOIN day_bars n ON n.symbol = r.symbol AND n.bar_no = r.bar_no JOIN day_bars x ON x.symbol = r.symbol AND x.bar_no = r.out_no),
eq AS (SELECT *, max(equity) OVER (PARTITION BY symbol ORDER BY closed_at, prediction_id ROWS UNBOUNDED PRECEDING) AS peak FROM (SELECT *, sum(pnl) OVER (PARTITION BY symbol ORDER BY closed_at, prediction_id ROWS UNBOUNDED PRECEDING) AS equity FROM tr))
SELECT symbol, count(*) AS trades, {R('avg((pnl > 0)::int)')} AS win_rate, {R('coalesce(sum(pnl) FILTER (pnl > 0), 0) / (-sum(pnl) FILTER (pnl < 0))', 4)} AS profit_factor, {R('avg(pnl) / stddev_pop(pnl) * sqrt(252)', 4)} AS sharpe, {R('avg(hold)')} AS avg_hold_bars,
 {R('sum(pnl)', 2)} AS total_pnl, {R('max(CASE WHEN peak > 0 THEN (peak - equity) / peak ELSE 0 END)', 4)} AS max_drawdown FROM eq GROUP BY 1""", ("res10", "day_bars"))
def c07r(spark, sf):
    """Ticks to report: bars, outcomes of the predictions, their trades and what they made."""
    from marketlake.operators.replay import replay

    b = V.day_bars(spark, sf)
    t = replay(day_preds(spark, sf, b), b, 10)
    return t.select("symbol", "trades", r(F.col("win_rate")).alias("win_rate"), r(F.col("profit_factor"), 4).alias("profit_factor"), r(F.col("sharpe"), 4).alias("sharpe"), r(F.col("avg_hold_bars")).alias("avg_hold_bars"),
                    r(F.col("total_pnl"), 2).alias("total_pnl"), r(F.col("max_drawdown"), 4).alias("max_drawdown"))


@query("c08_drift_report", f"SELECT {R('avg(psi)')} AS drift_score, list(feature ORDER BY psi DESC, feature)[1:5] AS top_features FROM psi_scores", ("psi_scores",))
def c08(spark, sf):
    d = J.drift_report(*V.drift_sets(spark, sf), list(V.DRIFT_COLUMNS))
    return d.select(r(F.col("drift_score")).alias("drift_score"), "top_features")


@query("c09_precedents", """SELECT query_id, count(*) AS hits, bool_or(NOT many) AS fallback FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(0.7 * cosine + 0.3 / (1 + age), 9) DESC, vec_id) AS rk FROM (
 SELECT *, count(*) FILTER (cosine >= 0.20) OVER (PARTITION BY query_id) >= 3 AS many FROM cosines) WHERE cosine >= CASE WHEN many THEN 0.20 ELSE 0.15 END) WHERE rk <= 3 GROUP BY 1""", ("cosines",))
def c09(spark, sf):
    v = V.vectors(spark, sf)
    return J.retrieve_precedents(v, v, 3, 0.20, 0.15).groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"), F.bool_or("fallback").alias("fallback"))


TICK_SQL = ("last", "volume", "spread", "bid", "ask")


@query("c10_training_set", f""", s AS (SELECT *, CASE WHEN ts < TIMESTAMP '2024-01-20' THEN 'train' WHEN ts < TIMESTAMP '2024-01-25' THEN 'val' ELSE 'test' END AS split, ask - bid AS spread FROM ticks),
f AS (SELECT {', '.join(f"quantile_cont({c}, 0.5) AS c_{c}, quantile_cont({c}, 0.95) - quantile_cont({c}, 0.05) AS s_{c}" for c in TICK_SQL)} FROM s WHERE split = 'train'),
o AS (SELECT *, row_number() OVER (PARTITION BY split, symbol ORDER BY ts, seq) - 1 AS no FROM s)
SELECT split, symbol, no // 64 AS seq_no, {', '.join(f"{R(f'sum(({c} - c_{c}) / CASE WHEN s_{c} > 0 THEN s_{c} ELSE 1 END)', 4)} AS sum_{n}" for n, c in zip(T.TICK_ROW, ('last', 'last', 'last', 'last', 'volume', 'spread', 'bid', 'ask')))}
FROM o, f GROUP BY 1, 2, 3 HAVING count(*) = 64""", ("ticks",))
def c10(spark, sf):
    t = J.build_training_set(T.tick_rows(V.ticks(spark, sf)), list(T.TICK_ROW), 64, "2024-01-20", "2024-01-25")
    return t.select("split", "symbol", "seq_no", *column_sums(T.TICK_ROW, 4))


@query("s11_dataset_sink", """SELECT split, count(*) // 1 AS rows FROM (SELECT symbol, CASE WHEN ts < TIMESTAMP '2024-01-20' THEN 'train' WHEN ts < TIMESTAMP '2024-01-25' THEN 'val' ELSE 'test' END AS split, row_number() OVER (PARTITION BY symbol, CASE WHEN ts < TIMESTAMP '2024-01-20' THEN 'train' WHEN ts < TIMESTAMP '2024-01-25' THEN 'val' ELSE 'test' END ORDER BY ts, seq) AS no FROM ticks) WHERE no % 64 = 0 GROUP BY 1""", ("ticks",))
def s11(spark, sf):
    from marketlake.plans.q_data import folder
    from marketlake.sources import io

    path = folder(spark, "training-set")
    io.write_split(J.build_training_set(T.tick_rows(V.ticks(spark, sf)), list(T.TICK_ROW), 64, "2024-01-20", "2024-01-25"), path)
    return spark.read.parquet(path).groupBy("split").agg(F.count(F.lit(1)).alias("rows"))


@query("c11_train_and_gate")
def c11(spark, sf):
    return J.train_and_gate(training(spark, sf), list(COLS))


@query("f09_fib_rows", f"""SELECT symbol, ratio, {R('major_low + ratio * (major_high - major_low)')} AS price FROM equil, (SELECT unnest([0.382, 0.5, 0.618, 0.786])::double AS ratio)""", ("equil",))
def fibs(spark, sf):
    e = S.equilibrium(S.tiers(V.day_bars(spark, sf)))
    return e.select("symbol", F.explode(S.fib_levels(F.col("major_high"), F.col("major_low"))).alias("ratio", "price")).withColumn("price", r(F.col("price")))


@query("f09_fib_table_function", f"""SELECT symbol, ratio, {R('major_low + ratio * (major_high - major_low)')} AS price FROM equil, (SELECT unnest([0.382, 0.5, 0.618, 0.786])::double AS ratio)""", ("equil",))
def fibs_sql(spark, sf):
    """The levels by the SQL table function, as a lateral join."""
    S.register_fib_levels(spark)
    e = S.equilibrium(S.tiers(V.day_bars(spark, sf)))
    return spark.sql("SELECT symbol, ratio, price FROM {e}, LATERAL fib_levels(major_high, major_low)", e=e).withColumn("price", r(F.col("price")))
