"""User-level entry points: operators put together, one function per job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlake.operators import bars as B
from marketlake.operators import dataset as T
from marketlake.operators import drift as D
from marketlake.operators import evaluation as E
from marketlake.operators import features as X
from marketlake.operators import macro as M
from marketlake.operators import models as ML
from marketlake.operators import outcomes as O
from marketlake.operators import retrieval as N
from marketlake.operators import structure as S
from marketlake.operators import usv as U
from marketlake.operators import zones as Z
from marketlake.operators.blocks import KEY, time_block


def ticks_to_bars(ticks: DataFrame, tfs=("M1", "M5", "M15", "H1", "H4", "D1"), spread_limit: float = 0.5) -> DataFrame:
    """Ticks to numbered bars of all timeframes, order flow muted on abnormal spreads."""
    t = B.enrich_ticks(ticks, spread_limit).withColumn("delta", F.when(F.col("is_abnormal"), 0.0).otherwise(F.col("delta")))
    return B.ohlcv(t, list(tfs))


def build_usv(ticks: DataFrame, bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Every tick with the closed bars of all timeframes, its session and the macro state."""
    u = U.incomplete_penalty(U.as_maps(U.closed_context(ticks, bars)))
    return M.with_macro_state(M.sessions(u), calendar)


def structure_parts(bars: DataFrame) -> dict[str, DataFrame]:
    """Pivots with claims, zones with mitigation, equal levels and order blocks of a bar table.

    Each part is used several times below, so each is kept (memory, then disk)."""
    st = S.swings(bars).persist()
    it = S.promote(st, "IT")
    pivots = S.claim(st.unionByName(it).unionByName(S.promote(it, "LT")), bars).persist()
    gaps = S.fair_value_gaps(bars).persist()
    zones = S.mitigate(Z.registry(gaps.unionByName(S.invert(gaps, bars)), S.equilibrium(pivots)), bars).persist()
    levels = S.equal_levels(st, bars).persist()
    blocks = S.order_blocks(S.mss_triggers(st, bars), bars).persist()
    return {"pivots": pivots, "zones": zones, "levels": levels, "blocks": blocks}


def structure_features(bars: DataFrame, htf_only: bool = False, w_ltf: Column | None = None) -> DataFrame:
    """F_liq, F_struct and F_agg per key. Under a guardrail only IT and LT pivots count and the
    vectors are zero."""
    if htf_only:
        p = S.tiers(bars).filter(F.col("term") != "ST")
        eq = S.equilibrium(p).select(*KEY, "equilibrium")
        n = p.groupBy(*KEY).agg(F.count(F.lit(1)).alias("pivots"))
        zero = {k: F.array_repeat(F.lit(0.0), X.SIZES[k]) for k in ("liq", "struct", "agg")}
        return n.join(eq, list(KEY)).select(*KEY, "pivots", "equilibrium", *[v.alias("f_" + k) for k, v in zero.items()])
    s = structure_parts(bars)
    c = X.symbolic_counts(s["pivots"], s["zones"], s["levels"], s["blocks"], bars).join(X.f_liq(s["pivots"], bars), list(KEY))
    struct = X.f_struct(c) if w_ltf is None else X.session_weighted(X.f_struct(c), w_ltf)
    n = s["pivots"].groupBy(*KEY).agg(F.count(F.lit(1)).alias("pivots"))
    return c.join(n, list(KEY)).select(*KEY, "pivots", "equilibrium", "f_liq", struct.alias("f_struct"), X.f_agg(c).alias("f_agg"))


def macro_context(calendar: DataFrame, impact: Column) -> DataFrame:
    """Calendar rows with impact, surprise and direction; sigma from earlier events of the same title."""
    c = M.prior_surprise_stats(calendar, ["title"]).withColumn("i_news", impact)
    z = M.surprise_z(F.col("actual"), F.col("forecast"), F.col("prior_sigma"))
    return c.withColumn("z", z).withColumn("direction", M.surprise_direction(F.col("actual"), F.col("forecast")))


def label_outcomes(preds: DataFrame, bars: DataFrame, zones: DataFrame, horizon: int) -> DataFrame:
    return O.resolve(preds, bars, horizon, held=Z.held_bars(zones, bars, horizon))


def backtest_report(preds: DataFrame, trades: DataFrame, trade_order: list[str], psi: DataFrame) -> DataFrame:
    """One row of quality, trade and drift figures."""
    ic = E.ic(preds).select(F.struct("n", "ic")).scalar()
    t = E.trade_metrics(trades).select("trades", "win_rate", "profit_factor", "sharpe", "avg_hold_bars")
    dd = E.max_drawdown(E.equity_curve(trades.select(*trade_order, "pnl"), [], trade_order), []).select("max_drawdown").scalar()
    d = D.drift_report(psi).select(F.struct("drift_score", "degraded")).scalar()
    r = t.select("*", ic.alias("_i"), dd.alias("max_drawdown"), d.alias("_d"))
    return r.select(*t.columns, "_i.*", "max_drawdown", "_d.*")


def drift_report(ref: DataFrame, cur: DataFrame, cols: list[str]) -> DataFrame:
    return D.drift_report(D.psi(ref, cur, cols))


def retrieve_precedents(queries: DataFrame, corpus: DataFrame, k: int = 3, hi: float = 0.80, lo: float = 0.75) -> DataFrame:
    return N.precedents(queries, corpus, k, hi, lo)


def build_training_set(ticks: DataFrame, cols: list[str], length: int, train_end: str, val_end: str) -> DataFrame:
    """Split by date, scaled by the training part, cut into sequences that never cross a split."""
    t = T.split_by_date(ticks, F.col("ts"), train_end, val_end)
    fit = T.robust_fit(t.filter("split = 'train'"), cols)
    s = T.robust_scale(t, fit, cols)
    return T.sequences(s, length, cols, ["split", "symbol"], ["ts", "seq"], time_block(F.col("ts"), 3600))


def train_and_gate(df: DataFrame, cols: list[str]) -> DataFrame:
    """Fit on train, score test, and say whether to deploy."""
    d = ML.as_features(df, cols).select("split", "label", "regime", "features").persist()
    model = ML.fit_direction(d.filter("split = 'train'").select("features", "label"))
    return ML.evaluate(ML.class_probabilities(model, d.filter("split = 'test'")))
