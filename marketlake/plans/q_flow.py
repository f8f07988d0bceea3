"""Order flow and indicators."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlake.functions.ticks import r
from marketlake.operators import flow as L
from marketlake.operators import indicators as I
from marketlake.operators.bars import ohlcv
from marketlake.plans.registry import query
from marketlake.plans.sqlviews import R, view, wilder
from marketlake.sources import views as V

W = "OVER (PARTITION BY symbol ORDER BY bar_no"


def cols(df, keys, *names, digits=6):
    return df.select(*keys, *[r(F.col(n), digits).alias(n) for n in names])


BAR = ("symbol", "bar_no")


@query("w01_true_range", f"SELECT symbol, bar_no, {R('tr', 9)} AS tr FROM day_tr", ("day_tr",))
def w01(spark, sf):
    return cols(I.true_range(V.day_bars(spark, sf)), BAR, "tr", digits=9)


@query("w02_atr_wilder", f"SELECT symbol, bar_no, {R('atr', 3)} AS atr FROM day_atr", ("day_atr",))
def w02(spark, sf):
    return cols(I.atr_wilder(V.day_bars(spark, sf)), BAR, "atr", digits=3)


view("day_ema20", wilder("day_bars", {"ema_20": "close"}, 20, 0, False, 1 - 2 / 21, 2 / 21), ("day_bars",))


@query("w03_ema", f"SELECT symbol, bar_no, {R('ema_20', 3)} AS ema_20 FROM day_ema20", ("day_ema20",))
def w03(spark, sf):
    return cols(I.ema(V.day_bars(spark, sf), 20), BAR, "ema_20", digits=3)


@query("w04_sma", f"SELECT symbol, bar_no, {R(f'CASE WHEN bar_no >= 19 THEN avg(close) {W} ROWS 19 PRECEDING) END')} AS sma_20 FROM day_bars", ("day_bars",))
def w04(spark, sf):
    return cols(I.sma(V.day_bars(spark, sf), 20), BAR, "sma_20")


@query("w05_bollinger", f"""
SELECT symbol, bar_no, {R('CASE WHEN bar_no >= 19 THEN m END', 5)} AS middle_band, {R('CASE WHEN bar_no >= 19 THEN m + 2 * s END', 5)} AS upper_band,
       {R('CASE WHEN bar_no >= 19 THEN m - 2 * s END', 5)} AS lower_band
FROM (SELECT *, avg(close) {W} ROWS 19 PRECEDING) AS m, stddev_pop(close) {W} ROWS 19 PRECEDING) AS s FROM day_bars)""", ("day_bars",))
def w05(spark, sf):
    return cols(I.bollinger(V.day_bars(spark, sf)), BAR, "middle_band", "upper_band", "lower_band", digits=5)


RUN = "OVER (PARTITION BY symbol, bucket ORDER BY ts, seq"
view("run_h1", f"""
SELECT *, CASE WHEN rv > 0 THEN cvd / rv ELSE 0 END AS cvd_norm, CASE WHEN ra > 0 THEN cvd / ra ELSE 0 END AS cvd_norm_abs FROM (
SELECT *, sum(delta) {RUN}) AS cvd, sum(volume) {RUN}) AS rv, sum(abs(delta)) {RUN}) AS ra, row_number() {RUN}) AS rn
FROM (SELECT *, cast(floor(epoch(ts) / 3600) * 3600 AS bigint) AS bucket FROM enriched))""", ("enriched",))
view("run_d1", f"""
SELECT *, sum(delta) {RUN}) AS cvd, sum(volume) {RUN}) AS rv
FROM (SELECT *, cast(floor(epoch(ts) / 86400) * 86400 AS bigint) AS bucket FROM enriched)""", ("enriched",))


@query("w06_running_cvd", "SELECT seq, symbol, bucket, cvd FROM run_h1", ("run_h1",))
def w06(spark, sf):
    return L.cvd(V.flow_ticks(spark, sf), "H1").select("seq", "symbol", "bucket", "cvd")


@query("w06_running_cvd_daily", "SELECT seq, symbol, bucket, cvd, rv AS run_volume FROM run_d1", ("run_d1",))
def w06d(spark, sf):
    return L.cvd(V.flow_ticks(spark, sf), "D1").select("seq", "symbol", "bucket", "cvd", "run_volume")


@query("w07_cvd_norm", f"SELECT seq, {R('cvd_norm')} AS cvd_norm, {R('cvd_norm_abs')} AS cvd_norm_abs FROM run_h1", ("run_h1",))
def w07(spark, sf):
    return cols(L.cvd(V.flow_ticks(spark, sf), "H1"), ("seq",), "cvd_norm", "cvd_norm_abs")


def _ma(n):
    return f"CASE WHEN rn >= {n} THEN avg(cvd) {RUN} ROWS {n - 1} PRECEDING) ELSE 0 END"


@query("w08_cvd_averages", f"SELECT seq, {', '.join(R(_ma(n)) + f' AS cvd_ma{n}' for n in (5, 10, 20, 50))} FROM run_h1", ("run_h1",))
def w08(spark, sf):
    return cols(L.cvd_averages(V.flow_ticks(spark, sf), "H1"), ("seq",), "cvd_ma5", "cvd_ma10", "cvd_ma20", "cvd_ma50")


@query("w08_cvd_rolling", f"SELECT symbol, bar_no, {', '.join(f'sum(cvd) {W} ROWS {n - 1} PRECEDING) AS cvd_roll{n}' for n in (5, 10, 20, 50))} FROM bars_h1", ("bars_h1",))
def w08r(spark, sf):
    return L.cvd_windows(V.tick_bars(spark, sf)).select(*BAR, "cvd_roll5", "cvd_roll10", "cvd_roll20", "cvd_roll50")


@query("w09_divergence_ticks", """
SELECT seq, CASE WHEN prev_last IS NULL THEN 0 ELSE (CASE WHEN last > prev_last THEN 1 ELSE -1 END) * (CASE WHEN delta > 0 THEN 1 ELSE -1 END) END AS divergence
FROM enriched""", ("enriched",))
def w09t(spark, sf):
    return L.tick_divergence(V.flow_ticks(spark, sf)).select("seq", "divergence")


@query("w09_divergence_bars", "SELECT symbol, bar_no, coalesce(sign(close - pc) * sign(cvd), 0)::double AS divergence FROM h1_tr", ("h1_tr",))
def w09(spark, sf):
    return L.divergence(V.tick_bars(spark, sf)).select(*BAR, "divergence")


view("h1_iii", f"""
SELECT *, CASE WHEN va > 0 AND atr > 0 THEN cvd / va * abs(close - open) / atr ELSE 0 END AS iii,
       (buy_volume - sell_volume) / (buy_volume + sell_volume + 1e-9) AS obi
FROM (SELECT *, avg(volume) {W} ROWS 29 PRECEDING) AS va FROM h1_atr)""", ("h1_atr",))


@query("w10_intensity", f"SELECT symbol, bar_no, {R('iii')} AS iii, {R('greatest(iii, 0)')} AS iii_bull, {R('least(iii, 0)')} AS iii_bear FROM h1_iii", ("h1_iii",))
def w10(spark, sf):
    return cols(L.iii(V.tick_bars(spark, sf)), BAR, "iii", "iii_bull", "iii_bear")


@query("w11_book_imbalance", f"SELECT symbol, bar_no, {R('obi')} AS obi FROM h1_iii", ("h1_iii",))
def w11(spark, sf):
    return V.tick_bars(spark, sf).select(*BAR, r(L.obi(F.col("buy_volume"), F.col("sell_volume"))).alias("obi"))


def _slope(c, n):
    return f"CASE WHEN bar_no >= {n - 1} THEN regr_slope({c}, bar_no) {W} ROWS {n - 1} PRECEDING) ELSE 0 END"


def _z(c, n):
    s = f"stddev_pop({c}) {W} ROWS {n - 1} PRECEDING)"
    return f"CASE WHEN bar_no >= {n - 1} AND {s} > 1e-12 THEN ({c} - avg({c}) {W} ROWS {n - 1} PRECEDING)) / {s} ELSE 0 END"


def _full(f, c, n):
    return f"CASE WHEN bar_no >= {n - 1} THEN {f}({c}) {W} ROWS {n - 1} PRECEDING) ELSE 0 END"


STATS = {
    "cvd_slope5": _slope("cvd", 5), "cvd_slope10": _slope("cvd", 10), "cvd_slope20": _slope("cvd", 20),
    "cvd_std10": _full("stddev_pop", "cvd", 10), "cvd_z": _z("cvd", 20),
    "iii_slope5": _slope("iii", 5), "iii_slope10": _slope("iii", 10), "iii_mean20": _full("avg", "iii", 20),
    "iii_std20": _full("stddev_pop", "iii", 20), "iii_z": _z("iii", 20),
    "obi_slope5": _slope("obi", 5), "obi_mean20": _full("avg", "obi", 20), "obi_std20": _full("stddev_pop", "obi", 20),
    "spread_z": _z("spread", 20),
}


@query("w12_flow_statistics", f"SELECT symbol, bar_no, {', '.join(R(e, 5) + f' AS {n}' for n, e in STATS.items())} FROM h1_iii", ("h1_iii",))
def w12(spark, sf):
    return cols(L.flow_stats(V.flow_bars(spark, sf)), BAR, *STATS, digits=5)


view("spikes", """
SELECT e.*, coalesce(abs(last - prev_last) > 3 * a.atr, FALSE) AS is_spike FROM enriched e ASOF LEFT JOIN
  (SELECT symbol, atr, to_timestamp(bucket + 300) AT TIME ZONE 'UTC' AS closed_at FROM m5_atr) a
  ON e.symbol = a.symbol AND e.ts >= a.closed_at""", ("enriched", "m5_atr"))


@query("p05_news_spikes", """
SELECT seq, is_spike, CASE WHEN is_spike THEN 0.0 ELSE delta END AS delta,
       coalesce(max(is_spike::int) OVER (PARTITION BY symbol ORDER BY ts RANGE BETWEEN INTERVAL 300 SECOND PRECEDING AND CURRENT ROW), 0) = 1 AS spike_regime
FROM spikes""", ("spikes",))
def p05(spark, sf):
    t = V.flow_ticks(spark, sf)
    return L.news_spikes(t, ohlcv(t, ["M5"])).select("seq", "is_spike", "delta", "spike_regime")


view("day_dm", """
SELECT *, CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0 END AS pdm,
       CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0 END AS mdm,
       greatest(close - pc, 0) AS g, greatest(pc - close, 0) AS l FROM day_tr""", ("day_tr",))
view("day_sm", wilder("day_dm", {"str": "tr", "sp": "pdm", "sm": "mdm"}, 14, 1), ("day_dm",))
view("day_dx", """
SELECT *, CASE WHEN pdi + mdi > 0 THEN 100 * abs(pdi - mdi) / (pdi + mdi) WHEN pdi + mdi <= 0 THEN 0 END AS dx FROM (
SELECT *, CASE WHEN str > 0 THEN 100 * sp / str WHEN str <= 0 THEN 0 END AS pdi, CASE WHEN str > 0 THEN 100 * sm / str WHEN str <= 0 THEN 0 END AS mdi FROM day_sm)""", ("day_sm",))
view("day_adx", wilder("day_dx", {"adx": "dx"}, 14, 14), ("day_dx",))
view("day_vr", f"""
SELECT *, CASE WHEN bar_no >= 60 AND s60 > 0 THEN s5 / s60 END AS vol_ratio FROM (
SELECT *, stddev_samp(ret) {W} ROWS 4 PRECEDING) AS s5, stddev_samp(ret) {W} ROWS 59 PRECEDING) AS s60 FROM (SELECT *, close / pc - 1 AS ret FROM day_adx))""", ("day_adx",))
view("day_regime", """
SELECT *, CASE WHEN adx >= 25 AND vol_ratio >= 1.5 THEN 'TRENDING_HV' WHEN adx >= 25 THEN 'TRENDING_LV' WHEN vol_ratio >= 1.5 THEN 'CHOPPY_HV' ELSE 'NORMAL' END AS regime
FROM day_vr WHERE adx IS NOT NULL AND vol_ratio IS NOT NULL""", ("day_vr",))


@query("w29_adx_vol_ratio", f"SELECT symbol, bar_no, {R('pdi', 5)} AS plus_di, {R('mdi', 5)} AS minus_di, {R('adx', 5)} AS adx, {R('vol_ratio', 5)} AS vol_ratio FROM day_vr", ("day_vr",))
def w29(spark, sf):
    return cols(I.vol_ratio(I.adx(V.day_bars(spark, sf))), BAR, "plus_di", "minus_di", "adx", "vol_ratio", digits=5)


@query("w28_regime_shifts", """
SELECT symbol, bar_no, prev_regime, regime, row_number() OVER (PARTITION BY symbol ORDER BY bar_no) AS shift_no FROM (
  SELECT *, lag(regime) OVER (PARTITION BY symbol ORDER BY bar_no) AS prev_regime FROM day_regime) WHERE prev_regime <> regime""", ("day_regime",))
def w28(spark, sf):
    return I.regime_shifts(I.regimes(V.day_bars(spark, sf))).select(*BAR, "prev_regime", "regime", "shift_no")


view("day_gl", wilder("day_dm", {"sg": "g", "sl": "l"}, 14, 1), ("day_dm",))


@query("w41_rsi", f"SELECT symbol, bar_no, {R('CASE WHEN sg IS NULL THEN NULL WHEN sl = 0 THEN 100 ELSE 100 - 100 / (1 + sg / sl) END', 5)} AS rsi FROM day_gl", ("day_gl",))
def w41(spark, sf):
    return cols(I.rsi(V.day_bars(spark, sf)), BAR, "rsi", digits=5)


def _run(op):
    stop = f"max(CASE WHEN NOT (close {op} open) THEN bar_no END) {W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"least(bar_no - 1 - coalesce({stop}, -1), 10)"


@query("w42_bar_runs", f"SELECT symbol, bar_no, {_run('>')} AS bull_run, {_run('<')} AS bear_run FROM day_bars", ("day_bars",))
def w42(spark, sf):
    return I.bar_runs(V.day_bars(spark, sf)).select(*BAR, "bull_run", "bear_run")


@query("w43_contact_shape", f"""
SELECT symbol, bar_no, {R('CASE WHEN abs(close - open) > 0 THEN (high - greatest(open, close)) / abs(close - open) ELSE 0 END', 4)} AS wick_ratio,
       sign(close - open)::double AS body_sign,
       coalesce(greatest(open, close) <= greatest(po, pc) AND least(open, close) >= least(po, pc) AND pc IS NOT NULL, FALSE) AS inside_bar,
       {R('close - po', 9)} AS close_vs_prev_open FROM day_tr""", ("day_tr",))
def w43(spark, sf):
    c = I.contact_shape(V.day_bars(spark, sf))
    return c.select(*BAR, r(F.col("wick_ratio"), 4).alias("wick_ratio"), "body_sign", "inside_bar", r(F.col("close_vs_prev_open"), 9).alias("close_vs_prev_open"))


@query("w44_approach", f"""
SELECT symbol, bar_no, {R(f'CASE WHEN bar_no >= 5 THEN avg(abs(close - pc)) {W} ROWS 4 PRECEDING) END')} AS approach_speed,
       {R(f'CASE WHEN bar_no >= 9 THEN regr_slope(volume, bar_no) {W} ROWS 9 PRECEDING) END', 5)} AS volume_trend FROM day_tr""", ("day_tr",))
def w44(spark, sf):
    a = I.approach(V.day_bars(spark, sf))
    return a.select(*BAR, r(F.col("approach_speed")).alias("approach_speed"), r(F.col("volume_trend"), 5).alias("volume_trend"))
