"""Ticks to bars, bar quality, gap filling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlake.functions import ticks as fn
from marketlake.operators.asof import asof
from marketlake.operators.blocks import KEY, over_blocks, time_block, with_previous
from marketlake.schemas import TIMEFRAMES

# Ticks of one symbol are ordered inside one-hour pieces.
TICK_BLOCK_SECONDS = 3600


def enrich_ticks(ticks: DataFrame, spread_threshold: float = 0.5) -> DataFrame:
    """Mid, spread, abnormal flag, previous price, aggressor side and signed volume."""
    t = with_previous(ticks, ["last"], ["symbol"], ["ts", "seq"], time_block(F.col("ts"), TICK_BLOCK_SECONDS))
    last, bid, ask = F.col("last"), F.col("bid"), F.col("ask")
    t = t.withColumn("mid", fn.mid(bid, ask)).withColumn("spread_pips", fn.spread_pips(bid, ask))
    t = t.withColumn("is_abnormal", F.col("spread_pips") > spread_threshold)
    t = t.withColumn("aggressor", fn.aggressor(last, bid, ask, F.col("prev_last")))
    return t.withColumn("delta", fn.signed_volume(F.col("aggressor"), F.col("volume")))


def _number(bars: DataFrame) -> DataFrame:
    """``bar_no``. A key has at most one bar per bucket, so its size is bounded by the calendar."""
    w = Window.partitionBy(*KEY).orderBy("bucket")
    return bars.withColumn("bar_no", (F.row_number().over(w) - 1).cast("bigint"))


def _bar_columns() -> list[str]:
    return ["symbol", "tf", "bucket", "open", "high", "low", "close", "volume", "tick_count", "buy_volume", "sell_volume", "cvd"]


def ohlcv_of(ticks: DataFrame, tf: str, order: Column | None = None, extra: dict[str, Column] | None = None) -> DataFrame:
    """One timeframe straight from ticks, with partial aggregation before the shuffle."""
    order = fn.tick_order(F.col("ts"), F.col("seq")) if order is None else order
    t = ticks
    if "delta" not in t.columns:
        t = t.withColumn("delta", F.lit(0.0))
    t = t.withColumn("bucket", fn.bucket_epoch(F.col("ts"), TIMEFRAMES[tf])).withColumn("_ord", order)
    agg = t.groupBy("symbol", "bucket").agg(
        F.min_by("last", "_ord").alias("open"),
        F.max("last").alias("high"),
        F.min("last").alias("low"),
        F.max_by("last", "_ord").alias("close"),
        F.sum("volume").alias("volume"),
        F.count(F.lit(1)).alias("tick_count"),
        F.sum(F.when(F.col("delta") > 0, F.col("delta")).otherwise(0.0)).alias("buy_volume"),
        F.sum(F.when(F.col("delta") < 0, -F.col("delta")).otherwise(0.0)).alias("sell_volume"),
        F.sum("delta").alias("cvd"),
        *[c.alias(n) for n, c in (extra or {}).items()],
    )
    return agg.withColumn("tf", F.lit(tf)).select(*_bar_columns(), *(extra or {}))


def rollup(m1: DataFrame, tfs: Sequence[str]) -> DataFrame:
    """Higher timeframes from M1 bars: bars are associative, so ticks are aggregated once only."""
    targets = F.array(*[F.struct(F.lit(t).alias("tf"), F.lit(TIMEFRAMES[t]).cast("bigint").alias("secs")) for t in tfs])
    spread = m1.drop("tf").withColumn("_t", F.explode(targets))
    spread = spread.withColumn("tf", F.col("_t.tf")).withColumn(
        "_up", (F.floor(F.col("bucket") / F.col("_t.secs")) * F.col("_t.secs")).cast("bigint")
    )
    out = spread.groupBy("symbol", "tf", "_up").agg(
        F.min_by("open", "bucket").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "bucket").alias("close"),
        F.sum("volume").alias("volume"),
        F.sum("tick_count").alias("tick_count"),
        F.sum("buy_volume").alias("buy_volume"),
        F.sum("sell_volume").alias("sell_volume"),
        F.sum("cvd").alias("cvd"),
    )
    return out.withColumnRenamed("_up", "bucket").select(*_bar_columns())


def ohlcv(ticks: DataFrame, tfs: Sequence[str] = ("M1", "M5", "M15", "H1", "H4", "D1"), numbered: bool = True) -> DataFrame:
    """Bars of every requested timeframe, from one pass over the ticks."""
    if len(tfs) == 1:
        bars = ohlcv_of(ticks, tfs[0])
    else:
        m1 = ohlcv_of(ticks, "M1")
        higher = [t for t in tfs if t != "M1"]
        bars = rollup(m1, higher)
        if "M1" in tfs:
            bars = m1.unionByName(bars)
    return _number(bars) if numbered else bars


number_bars = _number


def latest(bars: DataFrame, n: int = 1, since: int | None = None) -> DataFrame:
    """Newest ``n`` bars per key, optionally only from ``since`` (epoch seconds) on."""
    b = bars if since is None else bars.filter(F.col("bucket") >= since)
    w = Window.partitionBy(*KEY).orderBy(F.col("bucket").desc())
    return b.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= n).drop("_rk")


def missing_buckets(bars: DataFrame, tf: str, lookback: int) -> DataFrame:
    """Expected minus actual buckets over the last ``lookback`` buckets of each symbol."""
    step = TIMEFRAMES[tf]
    b = bars.filter(F.col("tf") == tf).select("symbol", "tf", "bucket")
    ends = b.groupBy("symbol", "tf").agg(F.max("bucket").alias("_hi"), F.min("bucket").alias("_lo"))
    lo = F.greatest(F.col("_lo"), F.col("_hi") - (lookback - 1) * step)
    expected = ends.select("symbol", "tf", F.explode(F.sequence(lo, F.col("_hi"), F.lit(step).cast("bigint"))).alias("bucket"))
    return expected.join(b, ["symbol", "tf", "bucket"], "left_anti")


def desync_report(bars: DataFrame, tf: str, lookback: int, max_gap: int = 5) -> DataFrame:
    """Missing buckets per symbol with severity and a reliability flag."""
    miss = missing_buckets(bars, tf, lookback).groupBy("symbol", "tf").agg(F.count(F.lit(1)).alias("missing"))
    seen = bars.filter(F.col("tf") == tf).groupBy("symbol", "tf").agg(F.count(F.lit(1)).alias("_n"))
    m = F.coalesce(F.col("missing"), F.lit(0)).cast("bigint")
    return seen.join(miss, ["symbol", "tf"], "left").select(
        "symbol", "tf", m.alias("missing"),
        F.when(m == 0, "NONE").when(m <= max_gap, "MINOR").otherwise("MAJOR").alias("severity"),
        (m <= max_gap).alias("reliable"),
    )


def fill_gaps(bars: DataFrame, max_gap: int = 5) -> DataFrame:
    """Interpolate runs of at most ``max_gap`` missing buckets between two bars of a key."""
    steps = F.create_map(*[x for t, s in TIMEFRAMES.items() for x in (F.lit(t), F.lit(s).cast("bigint"))])

    def add(df: DataFrame, w) -> DataFrame:
        return df.select(
            "*", F.lead("bucket").over(w).alias("_nb"), F.lead("open").over(w).alias("_no"), F.lead("volume").over(w).alias("_nv")
        )

    b = over_blocks(bars, 0, add, lookahead=1).withColumn("_step", steps[F.col("tf")])
    n_missing = F.col("_nb") / F.col("_step") - F.col("bucket") / F.col("_step") - 1
    gap = b.filter((n_missing >= 1) & (n_missing <= max_gap))
    filler = gap.select(
        "symbol", "tf",
        F.explode(F.sequence(F.col("bucket") + F.col("_step"), F.col("_nb") - F.col("_step"), F.col("_step"))).alias("bucket"),
        F.col("close").alias("open"),
        F.greatest("close", "_no").alias("high"),
        F.least("close", "_no").alias("low"),
        F.col("_no").alias("close"),
        ((F.col("volume") + F.col("_nv")) / 2).alias("volume"),
        F.lit(0).cast("bigint").alias("tick_count"),
        F.lit(True).alias("interpolated"),
    )
    kept = bars.select("symbol", "tf", "bucket", "open", "high", "low", "close", "volume", "tick_count", F.lit(False).alias("interpolated"))
    return kept.unionByName(filler)


def child_count(bars: DataFrame, parent: str = "H1", child: str = "M1", max_missing: int = 5) -> DataFrame:
    """Children per parent bar; a parent missing more than ``max_missing`` of them is unreliable."""
    step, full = TIMEFRAMES[parent], TIMEFRAMES[parent] // TIMEFRAMES[child]
    c = bars.filter(F.col("tf") == child).withColumn("bucket", (F.floor(F.col("bucket") / step) * step).cast("bigint"))
    out = c.groupBy("symbol", "bucket").agg(F.count(F.lit(1)).alias("children"))
    missing = F.lit(full) - F.col("children")
    return out.select(
        "symbol", F.lit(parent).alias("tf"), "bucket", "children", missing.cast("bigint").alias("missing"),
        F.when(missing == 0, "COMPLETE").when(missing <= max_missing, "INCOMPLETE").otherwise("UNRELIABLE").alias("state"),
    )


def tick_gaps(ticks: DataFrame, max_gap_seconds: float = 5.0) -> DataFrame:
    """Gap to the previous tick of the symbol, in arrival order (``seq``)."""
    t = with_previous(ticks, ["ts"], ["symbol"], ["ts", "seq"], time_block(F.col("ts"), TICK_BLOCK_SECONDS))
    gap = (F.unix_micros("ts") - F.unix_micros("prev_ts")) / 1e6
    return t.withColumn("gap_seconds", gap).withColumn("is_gap", F.coalesce(gap > max_gap_seconds, F.lit(False)))


def tick_coverage(ticks: DataFrame, max_gap_seconds: float = 5.0) -> DataFrame:
    """Gap count, coverage in percent, the first ten gaps and a status, per symbol."""
    g = tick_gaps(ticks, max_gap_seconds)
    stats = g.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("ticks"), F.count_if("is_gap").alias("gaps"), F.max("gap_seconds").alias("max_gap")
    )
    coverage = 100.0 * (1 - F.col("gaps") / F.col("ticks"))
    return stats.withColumn("coverage", coverage).withColumn(
        "status", F.when(coverage >= 95, "GOOD").when(coverage >= 80, "WARNING").otherwise("POOR")
    )


def first_gaps(ticks: DataFrame, k: int = 10, max_gap_seconds: float = 5.0) -> DataFrame:
    g = tick_gaps(ticks, max_gap_seconds).filter("is_gap")
    w = Window.partitionBy("symbol").orderBy("ts", "seq")
    return g.withColumn("gap_no", F.row_number().over(w)).filter(F.col("gap_no") <= k)


def out_of_order(ticks: DataFrame, seq_block: int = 1_000_000) -> DataFrame:
    """Ticks whose time lies before that of the tick received just before them."""
    t = with_previous(ticks, ["ts"], ["symbol"], ["seq"], F.floor(F.col("seq") / seq_block).cast("bigint"))
    return t.filter(F.col("ts") < F.col("prev_ts"))


def sparse_zones(ticks: DataFrame, min_per_second: float = 1.0, min_minutes: int = 30) -> DataFrame:
    """Stretches longer than ``min_minutes`` whose every observed-range minute is thin.

    A minute is thin below 60*min_per_second ticks; minutes without ticks are thin too, so the
    zones are the spaces between consecutive dense minutes (or the ends of the series).
    """
    minute = fn.bucket_epoch(F.col("ts"), 60)
    m = ticks.groupBy("symbol", minute.alias("minute")).agg(F.count(F.lit(1)).alias("n"))
    ends = m.groupBy("symbol").agg(F.min("minute").alias("lo"), F.max("minute").alias("hi"))
    dense = m.filter(F.col("n") >= 60 * min_per_second).select("symbol", "minute")
    marks = dense.unionByName(ends.select("symbol", (F.col("lo") - 60).alias("minute"))).unionByName(
        ends.select("symbol", (F.col("hi") + 60).alias("minute"))
    )
    w = Window.partitionBy("symbol").orderBy("minute")
    z = marks.withColumn("_prev", F.lag("minute").over(w)).filter(F.col("_prev").isNotNull())
    minutes = (F.col("minute") - F.col("_prev")) / 60 - 1
    return z.filter(minutes > min_minutes).select(
        "symbol", (F.col("_prev") + 60).alias("zone_start"), F.col("minute").alias("zone_end"), minutes.cast("bigint").alias("minutes")
    )


def outside_zones(rows: DataFrame, zones: DataFrame, ts: str = "ts") -> DataFrame:
    """Rows that lie in none of their symbol's zones. Zones of a symbol do not overlap, so the last
    one opened before a row is the only one that can hold it."""
    z = zones.select("symbol", F.timestamp_seconds("zone_start").alias("_from"), "zone_end")
    d = asof(rows, z, ts, "_from", ["symbol"], {"zone_end": "_until"})
    return d.filter(F.col("_until").isNull() | (F.unix_micros(ts) >= F.col("_until") * 1_000_000)).drop("_until")
