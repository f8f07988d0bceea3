"""Recursive smoothing y = a*y_prev + b*x (Wilder, EMA) as block windows.

The recursion unrolls to y_t = sum a^(t-i) z_i, where z is the seed (a plain mean) and then b*x.
Inside a block this is ``a^p * running_sum(z * a^-p)``: built-in window functions only. Rows
further back than ``reach`` weigh less than 1e-18, below the resolution of a double, so a block
needs only that many rows of halo and no pass over whole series.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlake.operators.blocks import BLOCK_BARS, over_blocks


def smooth(
    bars: DataFrame,
    inputs: dict[str, Column],
    n: int,
    keep: float,
    gain: float,
    first: int = 0,
    warmup_mean: bool = False,
) -> DataFrame:
    """Add one smoothed column per entry of ``inputs`` (new name -> input column).

    ``first`` is the first ``bar_no`` with a valid input. The seed is the mean of the first ``n``
    inputs, at bar ``first + n - 1``. Before it the value is null, or the running mean with
    ``warmup_mean``.
    """
    if n == 1:
        return bars.select("*", *[F.when(F.col("bar_no") >= first, c).alias(k) for k, c in inputs.items()])
    decay = -math.log(keep)
    reach = math.ceil(41.5 / decay) + n
    size = max(64, min(BLOCK_BARS, int(600 / decay) - reach))
    seed_no = first + n - 1

    def add(df: DataFrame, w) -> DataFrame:
        pos = (F.col("bar_no") - F.col("_blk") * size + reach).cast("double")
        seed_frame = w.rowsBetween(-(n - 1), 0)
        run = w.rowsBetween(Window.unboundedPreceding, 0)
        df = df.select("*", *[c.cast("double").alias("_x_" + k) for k, c in inputs.items()])
        df = df.select("*", *[F.avg("_x_" + k).over(seed_frame).alias("_m_" + k) for k in inputs])
        no = F.col("bar_no")
        for k in inputs:
            z = (
                F.when(no == seed_no, F.col("_m_" + k))
                .when(no > seed_no, F.col("_x_" + k) * gain)
                .otherwise(F.lit(0.0))
            )
            df = df.withColumn("_z_" + k, z * F.exp(pos * decay))
        out = []
        for k in inputs:
            y = F.sum("_z_" + k).over(run) * F.exp(-pos * decay)
            early = F.when((no >= first) & F.lit(warmup_mean), F.avg("_x_" + k).over(seed_frame))
            out.append(F.when(no >= seed_no, y).otherwise(early).alias(k))
        return df.select(*bars.columns, "_blk", *out)

    return over_blocks(bars, reach, add, size=size)


def wilder(bars: DataFrame, inputs: dict[str, Column], n: int = 14, first: int = 0, warmup_mean: bool = False) -> DataFrame:
    return smooth(bars, inputs, n, (n - 1) / n, 1 / n, first, warmup_mean)


def exponential(bars: DataFrame, inputs: dict[str, Column], n: int) -> DataFrame:
    a = 2 / (n + 1)
    return smooth(bars, inputs, n, 1 - a, a)
