"""Order flow: cumulative delta, divergence, intensity, imbalance and their statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlake.functions import ticks as fn
from marketlake.operators.asof import asof
from marketlake.operators.blocks import over_blocks, running_sum, time_block
from marketlake.operators.indicators import atr_wilder
from marketlake.schemas import TIMEFRAMES

HOUR = 3600


def cvd(ticks: DataFrame, tf: str = "M1") -> DataFrame:
    """Running delta, volume and absolute delta since the bar opened, and both norms.

    A bar longer than an hour is summed hour by hour with the totals carried over."""
    t = ticks.withColumn("bucket", fn.bucket_epoch(F.col("ts"), TIMEFRAMES[tf]))
    sums = {"cvd": F.col("delta"), "run_volume": F.col("volume"), "run_abs": F.abs("delta")}
    if TIMEFRAMES[tf] <= HOUR:
        w = Window.partitionBy("symbol", "bucket").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
        t = t.select("*", *[F.sum(c).over(w).alias(n) for n, c in sums.items()])
    else:
        t = running_sum(t, sums, ["symbol", "bucket"], ["ts", "seq"], time_block(F.col("ts"), HOUR))
    return t.select(
        "*",
        F.when(F.col("run_volume") > 0, F.col("cvd") / F.col("run_volume")).otherwise(0.0).alias("cvd_norm"),
        F.when(F.col("run_abs") > 0, F.col("cvd") / F.col("run_abs")).otherwise(0.0).alias("cvd_norm_abs"),
    )


def cvd_averages(ticks: DataFrame, tf: str = "H1", lengths: Sequence[int] = (5, 10, 20, 50)) -> DataFrame:
    """Means of the running delta over the last n ticks of the bar, 0 until n ticks exist."""
    if TIMEFRAMES[tf] > HOUR:
        raise ValueError("per-tick averages restart with the bar; use a timeframe of at most an hour")
    t = cvd(ticks, tf)
    w = Window.partitionBy("symbol", "bucket").orderBy("ts", "seq")
    rn = F.row_number().over(w)
    return t.select("*", *[
        F.when(rn >= n, F.avg("cvd").over(w.rowsBetween(-(n - 1), 0))).otherwise(0.0).alias(f"cvd_ma{n}") for n in lengths
    ])


def cvd_windows(bars: DataFrame, lengths: Sequence[int] = (5, 10, 20, 50)) -> DataFrame:
    """Sum of the bar delta over the last n bars."""
    return over_blocks(bars, max(lengths), lambda df, w: df.select(
        "*", *[F.sum("cvd").over(w.rowsBetween(-(n - 1), 0)).alias(f"cvd_roll{n}") for n in lengths]))


def tick_divergence(ticks: DataFrame) -> DataFrame:
    """+1 when price and delta agree, -1 when not; "not up" counts as down. 0 on the first tick."""
    price = F.when(F.col("last") > F.col("prev_last"), 1).otherwise(-1)
    flow = F.when(F.col("delta") > 0, 1).otherwise(-1)
    return ticks.withColumn("divergence", F.when(F.col("prev_last").isNull(), 0).otherwise(price * flow))


def divergence(bars: DataFrame) -> DataFrame:
    def add(df, w):
        move = F.col("close") - F.lag("close").over(w)
        return df.withColumn("divergence", F.coalesce(F.signum(move) * F.signum("cvd"), F.lit(0.0)))

    return over_blocks(bars, 1, add)


def iii(bars: DataFrame, volume_bars: int = 30, atr_bars: int = 14) -> DataFrame:
    """Intensity: (delta / mean volume) * (body / ATR), with its rising and falling parts."""
    b = atr_wilder(bars, atr_bars)

    def add(df, w):
        return df.withColumn("_v", F.avg("volume").over(w.rowsBetween(-(volume_bars - 1), 0)))

    value = F.col("cvd") / F.col("_v") * F.abs(F.col("close") - F.col("open")) / F.col("atr")
    b = over_blocks(b, volume_bars, add).withColumn("iii", F.when((F.col("_v") > 0) & (F.col("atr") > 0), value).otherwise(0.0))
    return b.select("*", F.greatest("iii", F.lit(0.0)).alias("iii_bull"), F.least("iii", F.lit(0.0)).alias("iii_bear")).drop("_v")


def obi(bid_volume: Column, ask_volume: Column) -> Column:
    return (bid_volume - ask_volume) / (bid_volume + ask_volume + 1e-9)


def flow_stats(bars: DataFrame) -> DataFrame:
    """Slopes, means, deviations and z-scores of delta, intensity, imbalance and spread."""
    b = iii(bars).withColumn("obi", obi(F.col("buy_volume"), F.col("sell_volume")))

    def add(df, w):
        no = F.col("bar_no")

        def frame(n):
            return w.rowsBetween(-(n - 1), 0)

        def slope(c, n):
            return F.when(no >= n - 1, F.regr_slope(c, "bar_no").over(frame(n))).otherwise(0.0)

        def z(c, n):
            s = F.stddev_pop(c).over(frame(n))
            return F.when((no >= n - 1) & (s > 1e-12), (F.col(c) - F.avg(c).over(frame(n))) / s).otherwise(0.0)

        def full(c, n):
            return F.when(no >= n - 1, c).otherwise(0.0)

        return df.select(
            "*",
            slope("cvd", 5).alias("cvd_slope5"), slope("cvd", 10).alias("cvd_slope10"), slope("cvd", 20).alias("cvd_slope20"),
            full(F.stddev_pop("cvd").over(frame(10)), 10).alias("cvd_std10"), z("cvd", 20).alias("cvd_z"),
            slope("iii", 5).alias("iii_slope5"), slope("iii", 10).alias("iii_slope10"),
            full(F.avg("iii").over(frame(20)), 20).alias("iii_mean20"), full(F.stddev_pop("iii").over(frame(20)), 20).alias("iii_std20"), z("iii", 20).alias("iii_z"),
            slope("obi", 5).alias("obi_slope5"), full(F.avg("obi").over(frame(20)), 20).alias("obi_mean20"), full(F.stddev_pop("obi").over(frame(20)), 20).alias("obi_std20"),
            *([z("spread", 20).alias("spread_z")] if "spread" in bars.columns else []),
        )

    return over_blocks(b, 20, add)


def news_spikes(ticks: DataFrame, m5: DataFrame, factor: float = 3.0, hold_seconds: int = 300) -> DataFrame:
    """Mark ticks that jump more than ``factor`` ATR(M5), mute their delta, and flag the next minutes.

    The ATR is that of the last M5 bar already closed. The flag reaches over block borders by
    copying each spike into every time block it can touch."""
    atr = atr_wilder(m5).select("symbol", F.timestamp_seconds(F.col("bucket") + TIMEFRAMES["M5"]).alias("closed_at"), "atr")
    t = asof(ticks, atr, "ts", "closed_at", ["symbol"], {"atr": "atr_m5"})
    t = t.withColumn("is_spike", F.coalesce(F.abs(F.col("last") - F.col("prev_last")) > factor * F.col("atr_m5"), F.lit(False)))
    t = t.withColumn("delta", F.when(F.col("is_spike"), 0.0).otherwise(F.col("delta")))
    sp = t.filter("is_spike").select("symbol", F.col("ts").alias("spike_ts"))
    t = asof(t, sp, "ts", "spike_ts", ["symbol"], {"spike_ts": "spike_ts"})
    age = (F.unix_micros("ts") - F.unix_micros("spike_ts")) / 1e6
    return t.withColumn("spike_regime", F.coalesce(age <= hold_seconds, F.lit(False))).drop("spike_ts")
