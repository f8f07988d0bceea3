"""Column functions on ticks and bars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def r(c: Column, digits: int = 6) -> Column:
    """Round for output; adding zero turns -0.0 into 0.0."""
    return F.round(c, digits) + F.lit(0.0)


def mid(bid: Column, ask: Column) -> Column:
    return (bid + ask) / 2


def spread_pips(bid: Column, ask: Column) -> Column:
    return (ask - bid) * 10000


def aggressor(last: Column, bid: Column, ask: Column, prev: Column | None = None) -> Column:
    """Side that crossed the spread: tick rule near the quote first, then the quote rule."""
    quote = F.when(last >= ask, "BUY").when(last <= bid, "SELL").otherwise("UNKNOWN")
    if prev is None:
        return quote
    return (
        F.when((last < prev) & (last <= bid * 1.0001), "SELL")
        .when((last > prev) & (last >= ask * 0.9999), "BUY")
        .otherwise(quote)
    )


def signed_volume(side: Column, volume: Column) -> Column:
    return F.when(side == "BUY", volume).when(side == "SELL", -volume).otherwise(F.lit(0.0))


def epoch(ts: Column) -> Column:
    return F.unix_seconds(ts)


def bucket_epoch(ts: Column, seconds: int | Column) -> Column:
    """Start of the bar that contains ``ts``, in epoch seconds."""
    s = (F.lit(seconds) if isinstance(seconds, int) else seconds).cast("bigint")
    t = F.unix_seconds(ts)
    return t - F.pmod(t, s)


def tick_order(ts: Column, seq: Column) -> Column:
    """(ts, seq) as one number. Fixed width, so first/last stay in a hash aggregate."""
    wide = F.unix_micros(ts).cast("decimal(18,0)") * F.lit("10000000000000000000").cast("decimal(20,0)")
    return (wide + seq.cast("decimal(19,0)")).cast("decimal(38,0)")


def milliseconds(t: Column) -> Column:
    """Epoch values below 1e12 are seconds, larger ones are milliseconds already."""
    return F.when(t < F.lit(1_000_000_000_000), t * 1000).otherwise(t)


def symbol_bar_key(symbol: Column, tf: Column, bucket: Column) -> Column:
    return F.concat_ws(":", symbol, tf, bucket.cast("string"))


def upper_wick(o: Column, h: Column, c: Column) -> Column:
    return h - F.greatest(o, c)


def lower_wick(o: Column, l: Column, c: Column) -> Column:  # noqa: E741
    return F.least(o, c) - l


def body(o: Column, c: Column) -> Column:
    return F.abs(c - o)


def typical(h: Column, l: Column, c: Column) -> Column:  # noqa: E741
    return (h + l + c) / 3
