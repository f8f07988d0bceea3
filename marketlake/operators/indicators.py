"""Bar indicators. Every one reaches back a bounded number of bars, so all run block by block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlake.operators.blocks import KEY, over_blocks
from marketlake.operators.smoothing import exponential, wilder


def _tr(w) -> Column:
    prev = F.lag("close").over(w)
    span = F.col("high") - F.col("low")
    return F.when(prev.isNull(), span).otherwise(F.greatest(span, F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)))


def true_range(bars: DataFrame) -> DataFrame:
    return over_blocks(bars, 1, lambda df, w: df.withColumn("tr", _tr(w)))


def atr_wilder(bars: DataFrame, n: int = 14, out: str = "atr") -> DataFrame:
    """Running mean up to ``n`` true ranges, Wilder smoothing afterwards."""
    return wilder(true_range(bars), {out: F.col("tr")}, n, warmup_mean=True)


def ema(bars: DataFrame, n: int, value: str = "close", out: str | None = None) -> DataFrame:
    return exponential(bars, {out or f"ema_{n}": F.col(value)}, n)


def sma(bars: DataFrame, n: int, value: str = "close", out: str | None = None) -> DataFrame:
    def add(df, w):
        full = F.col("bar_no") >= n - 1
        return df.withColumn(out or f"sma_{n}", F.when(full, F.avg(value).over(w.rowsBetween(-(n - 1), 0))))

    return over_blocks(bars, n, add)


def bollinger(bars: DataFrame, n: int = 20, k: float = 2.0) -> DataFrame:
    def add(df, w):
        f = w.rowsBetween(-(n - 1), 0)
        full = F.col("bar_no") >= n - 1
        m, s = F.avg("close").over(f), F.stddev_pop("close").over(f)
        return df.select("*", F.when(full, m).alias("middle_band"), F.when(full, m + k * s).alias("upper_band"), F.when(full, m - k * s).alias("lower_band"))

    return over_blocks(bars, n, add)


def adx(bars: DataFrame, n: int = 14) -> DataFrame:
    """Directional movement index: +DI, -DI, DX and its Wilder mean."""
    def moves(df, w):
        up = F.col("high") - F.lag("high").over(w)
        down = F.lag("low").over(w) - F.col("low")
        return df.select(
            "*", _tr(w).alias("_tr"),
            F.when((up > down) & (up > 0), up).otherwise(0.0).alias("_pdm"),
            F.when((down > up) & (down > 0), down).otherwise(0.0).alias("_mdm"),
        )

    b = over_blocks(bars, 1, moves)
    b = wilder(b, {"_str": F.col("_tr"), "_sp": F.col("_pdm"), "_sm": F.col("_mdm")}, n, first=1)
    b = b.withColumn("plus_di", F.when(F.col("_str") > 0, 100 * F.col("_sp") / F.col("_str")).when(F.col("_str") <= 0, 0.0))
    b = b.withColumn("minus_di", F.when(F.col("_str") > 0, 100 * F.col("_sm") / F.col("_str")).when(F.col("_str") <= 0, 0.0))
    total = F.col("plus_di") + F.col("minus_di")
    b = b.withColumn("dx", F.when(total > 0, 100 * F.abs(F.col("plus_di") - F.col("minus_di")) / total).when(total <= 0, 0.0))
    b = wilder(b, {"adx": F.col("dx")}, n, first=n)
    return b.drop("_tr", "_pdm", "_mdm", "_str", "_sp", "_sm")


def vol_ratio(bars: DataFrame, short: int = 5, long: int = 60) -> DataFrame:
    """Sample deviation of simple returns over ``short`` bars against ``long`` bars."""
    def add(df, w):
        df = df.withColumn("_ret", F.col("close") / F.lag("close").over(w) - 1)
        s = F.stddev_samp("_ret").over(w.rowsBetween(-(short - 1), 0))
        g = F.stddev_samp("_ret").over(w.rowsBetween(-(long - 1), 0))
        return df.select("*", F.when((F.col("bar_no") >= long) & (g > 0), s / g).alias("vol_ratio")).drop("_ret")

    return over_blocks(bars, long + 1, add)


def regime_label(adx_: Column, ratio: Column, trending: float = 25.0, high: float = 1.5) -> Column:
    return (
        F.when((adx_ >= trending) & (ratio >= high), "TRENDING_HV")
        .when(adx_ >= trending, "TRENDING_LV")
        .when(ratio >= high, "CHOPPY_HV")
        .otherwise("NORMAL")
    )


def regimes(daily: DataFrame) -> DataFrame:
    """Label of every bar for which both inputs exist."""
    b = vol_ratio(adx(daily)).filter(F.col("adx").isNotNull() & F.col("vol_ratio").isNotNull())
    return b.withColumn("regime", regime_label(F.col("adx"), F.col("vol_ratio")))


def regime_shifts(labels: DataFrame) -> DataFrame:
    """Rows where the label differs from the previous bar, numbered per key.

    The number runs over shifts only, which are few against the bars."""
    def prev(df, w):
        return df.withColumn("prev_regime", F.lag("regime").over(w))

    changed = over_blocks(labels, 1, prev).filter(F.col("prev_regime").isNotNull() & (F.col("prev_regime") != F.col("regime")))
    w = Window.partitionBy(*KEY).orderBy("bar_no")
    return changed.withColumn("shift_no", F.row_number().over(w).cast("bigint"))


def rsi(bars: DataFrame, n: int = 14) -> DataFrame:
    def moves(df, w):
        d = F.col("close") - F.lag("close").over(w)
        return df.select("*", F.greatest(d, F.lit(0.0)).alias("_g"), F.greatest(-d, F.lit(0.0)).alias("_l"))

    b = wilder(over_blocks(bars, 1, moves), {"_sg": F.col("_g"), "_sl": F.col("_l")}, n, first=1)
    value = F.when(F.col("_sg").isNull(), F.lit(None)).when(F.col("_sl") == 0, 100.0).otherwise(100 - 100 / (1 + F.col("_sg") / F.col("_sl")))
    return b.withColumn("rsi", value).drop("_g", "_l", "_sg", "_sl")


def bar_runs(bars: DataFrame, cap: int = 10) -> DataFrame:
    """Length of the run of rising (falling) bars that ends just before each bar, at most ``cap``."""
    def add(df, w):
        before = w.rowsBetween(-cap, -1)
        no = F.col("bar_no")
        reach = F.least(no, F.lit(cap).cast("bigint"))
        stop_up = F.max(F.when(~(F.col("close") > F.col("open")), no)).over(before)
        stop_dn = F.max(F.when(~(F.col("close") < F.col("open")), no)).over(before)
        return df.select(
            "*",
            F.coalesce(no - 1 - stop_up, reach).cast("bigint").alias("bull_run"),
            F.coalesce(no - 1 - stop_dn, reach).cast("bigint").alias("bear_run"),
        )

    return over_blocks(bars, cap, add)


def contact_shape(bars: DataFrame) -> DataFrame:
    """Shape of a bar against the bar before it."""
    def add(df, w):
        body = F.abs(F.col("close") - F.col("open"))
        po, pc = F.lag("open").over(w), F.lag("close").over(w)
        inside = (F.greatest("open", "close") <= F.greatest(po, pc)) & (F.least("open", "close") >= F.least(po, pc))
        return df.select(
            "*",
            F.when(body > 0, (F.col("high") - F.greatest("open", "close")) / body).otherwise(0.0).alias("wick_ratio"),
            F.signum(F.col("close") - F.col("open")).alias("body_sign"),
            F.coalesce(inside, F.lit(False)).alias("inside_bar"),
            (F.col("close") - po).alias("close_vs_prev_open"),
            pc.alias("prev_close"),
        )

    return over_blocks(bars, 1, add)


def approach(bars: DataFrame, speed_bars: int = 5, volume_bars: int = 10) -> DataFrame:
    """Mean absolute close-to-close move, and the regression slope of volume."""
    def add(df, w):
        df = df.withColumn("_mv", F.abs(F.col("close") - F.lag("close").over(w)))
        sp = w.rowsBetween(-(speed_bars - 1), 0)
        vo = w.rowsBetween(-(volume_bars - 1), 0)
        no = F.col("bar_no")
        return df.select(
            "*", F.when(no >= speed_bars, F.avg("_mv").over(sp)).alias("approach_speed"),
            F.when(no >= volume_bars - 1, F.regr_slope("volume", "bar_no").over(vo)).alias("volume_trend"),
        ).drop("_mv")

    return over_blocks(bars, max(speed_bars, volume_bars) + 1, add)
