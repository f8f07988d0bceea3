"""Ordered work in bounded pieces.

A time series of one symbol may hold a third of all rows, so no operator here sorts a whole
tick series in one task. Two schemes are used:

* **Bars** carry a dense ``bar_no`` per (symbol, tf). Windows with a fixed reach run per
  (symbol, tf, block of bars); each block also receives copies of the rows just outside it
  (its halo). One narrow ``explode`` and one shuffle, nothing else.
* **Ticks** are cut by wall-clock blocks (an hour, a day). What must cross a block border is
  reduced to one row per block first; that summary grows with the calendar, not with the ticks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

KEY = ("symbol", "tf")
BLOCK_BARS = 4096


def div(col: Column | str, n: int) -> Column:
    """Integer division that stays a bigint."""
    c = F.col(col) if isinstance(col, str) else col
    return F.floor(c / F.lit(n)).cast("bigint")


def time_block(ts: Column, seconds: int) -> Column:
    t = F.unix_seconds(ts)
    return t - F.pmod(t, F.lit(seconds).cast("bigint"))


def over_blocks(
    bars: DataFrame,
    lookback: int,
    fn: Callable[[DataFrame, WindowSpec], DataFrame],
    lookahead: int = 0,
    size: int = BLOCK_BARS,
    by: Sequence[str] = KEY,
    no: str = "bar_no",
) -> DataFrame:
    """Apply window columns of reach [-lookback, +lookahead] rows, block by block."""
    n = F.col(no)
    blocks = F.sequence(div(F.greatest(n - lookahead, F.lit(0)), size), div(n + lookback, size))
    spread = bars.withColumn("_blk", F.explode(blocks))
    w = Window.partitionBy(*by, "_blk").orderBy(no)
    return fn(spread, w).filter(F.col("_blk") == div(n, size)).drop("_blk")


def with_previous(
    df: DataFrame,
    cols: Sequence[str],
    by: Sequence[str],
    order: Sequence[str],
    block: Column,
    prefix: str = "prev_",
) -> DataFrame:
    """``lag(1)`` of ``cols`` per key: inside time blocks, plus the last row of the block before."""
    b = df.withColumn("_b", block)
    w = Window.partitionBy(*by, "_b").orderBy(*order)
    payload = F.struct(*[F.col(c) for c in cols])
    last = _order_key(df, order)
    tails = b.groupBy(*by, "_b").agg(*[F.max_by(c, last).alias("_c_" + c) for c in cols])
    chain = Window.partitionBy(*by).orderBy("_b")
    carried = tails.select(*by, "_b", *[F.lag("_c_" + c).over(chain).alias("_c_" + c) for c in cols])
    out = b.withColumn("_lag", F.lag(payload).over(w)).join(carried, [*by, "_b"], "left")
    for c in cols:
        out = out.withColumn(prefix + c, F.when(F.col("_lag").isNotNull(), F.col("_lag")[c]).otherwise(F.col("_c_" + c)))
    return out.drop("_b", "_lag", *["_c_" + c for c in cols])


def _order_key(df: DataFrame, order: Sequence[str]) -> Column:
    """The order as one value. (time, whole number) packs into a decimal, which keeps the aggregate a
    hash aggregate; anything else is a struct."""
    kinds = [df.schema[c].dataType.typeName() for c in order]
    if len(order) == 1:
        return F.col(order[0])
    if len(order) == 2 and kinds[0] == "timestamp" and kinds[1] in ("long", "integer"):
        wide = F.unix_micros(order[0]).cast("decimal(18,0)") * F.lit("10000000000000000000").cast("decimal(20,0)")
        return (wide + F.col(order[1]).cast("decimal(19,0)")).cast("decimal(38,0)")
    return F.struct(*[F.col(c) for c in order])


def running_sum(
    df: DataFrame,
    sums: dict[str, Column],
    by: Sequence[str],
    order: Sequence,
    block: Column,
) -> DataFrame:
    """Running sums per key, inclusive of the current row: inside blocks, plus the totals before."""
    b = df.withColumn("_b", block)
    for name, c in sums.items():
        b = b.withColumn("_x_" + name, c)
    totals = b.groupBy(*by, "_b").agg(*[F.sum("_x_" + n).alias("_t_" + n) for n in sums])
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *by, "_b", *[F.coalesce(F.sum("_t_" + n).over(before), F.lit(0.0)).alias("_o_" + n) for n in sums]
    )
    w = Window.partitionBy(*by, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = b.select("*", *[F.sum("_x_" + n).over(w).alias("_i_" + n) for n in sums])
    out = inside.join(offsets, [*by, "_b"])
    keep = [c for c in df.columns if c not in sums]
    return out.select(*keep, *[(F.col("_i_" + n) + F.col("_o_" + n)).alias(n) for n in sums])


def number_rows(df: DataFrame, by: Sequence[str], order: Sequence, block: Column, out: str) -> DataFrame:
    """Dense 0-based row numbers per key, for keys too large to sort in one task.

    ``block`` must grow with ``order``; rows are numbered inside their block and shifted by the
    running count of the blocks before."""
    b = df.withColumn("_b", block)
    counts = b.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    w = Window.partitionBy(*by, "_b").orderBy(*order)
    numbered = b.withColumn("_rn", F.row_number().over(w) - 1)
    return numbered.join(offsets, [*by, "_b"]).withColumn(out, (F.col("_rn") + F.col("_off")).cast("bigint")).drop("_b", "_rn", "_off")
