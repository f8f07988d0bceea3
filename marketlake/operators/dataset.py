"""Training sets: fixed-length sequences, splits, caps, scaling, sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlake.functions import ticks
from marketlake.operators.blocks import number_rows
from marketlake.operators.ranks import exact_quantiles


# The columns of a tick row and of a bar row, in tensor order.
TICK_ROW = ("open", "high", "low", "close", "volume", "spread", "bid", "ask")
BAR_ROW = ("open", "high", "low", "close", "volume", "upper_wick", "lower_wick", "body", "bar_range", "vwap", "spread", "tick_count")


def tick_rows(df: DataFrame) -> DataFrame:
    """Ticks with the columns of ``TICK_ROW``: a tick is its own open, high, low and close."""
    price = {c: F.col("last") for c in ("open", "high", "low", "close")}
    return df.withColumns({**price, "spread": F.col("ask") - F.col("bid")})


def bar_rows(bars: DataFrame) -> DataFrame:
    """Bars with the columns of ``BAR_ROW``; where they carry no spread it is 0."""
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))  # noqa: E741
    shape = {"upper_wick": ticks.upper_wick(o, h, c), "lower_wick": ticks.lower_wick(o, l, c), "body": ticks.body(o, c), "bar_range": h - l, "vwap": ticks.typical(h, l, c)}
    return bars.withColumns(shape | ({} if "spread" in bars.columns else {"spread": F.lit(0.0)}))


def sequences(df: DataFrame, length: int, cols: Sequence[str], by: Sequence[str], order: Sequence[str], block: Column) -> DataFrame:
    """Non-overlapping runs of ``length`` rows per key as arrays; the incomplete tail is dropped."""
    d = number_rows(df, by, order, block, "_no")
    d = d.withColumn("seq_no", F.floor(F.col("_no") / length).cast("bigint"))
    row = F.struct("_no", F.array(*[F.col(c).cast("double") for c in cols]).alias("x"))
    s = d.groupBy(*by, "seq_no").agg(F.count(F.lit(1)).alias("_n"), F.sort_array(F.collect_list(row)).alias("_rows"))
    return s.filter(F.col("_n") == length).select(*by, "seq_no", F.transform("_rows", lambda v: v["x"]).alias("sequence"))


def equal_lengths(seqs: DataFrame, by: Sequence[str], over: str) -> DataFrame:
    """Cut every ``over`` (say timeframe) of a key to the shortest number of sequences among them."""
    n = seqs.groupBy(*by, over).agg(F.count(F.lit(1)).alias("_n")).groupBy(*by).agg(F.min("_n").alias("_min"))
    return seqs.join(n, list(by)).filter(F.col("seq_no") < F.col("_min")).drop("_min")


def split_by_date(df: DataFrame, ts: Column, train_end: str, val_end: str) -> DataFrame:
    return df.withColumn("split", F.when(ts < F.lit(train_end).cast("timestamp"), "train").when(ts < F.lit(val_end).cast("timestamp"), "val").otherwise("test"))


def split_by_order(df: DataFrame, order: Sequence[str], block: Column, parts=(0.70, 0.15)) -> DataFrame:
    """First 70 % of the rows in time order train, the next 15 % validate, the rest test."""
    d = number_rows(df, [], order, block, "_no")
    n = df.agg(F.count(F.lit(1))).scalar()
    a, b = F.floor(n * parts[0]), F.floor(n * (parts[0] + parts[1]))
    return d.withColumn("split", F.when(F.col("_no") < a, "train").when(F.col("_no") < b, "val").otherwise("test")).drop("_no")


def stratified_cap(df: DataFrame, by: str, total: int, key: Column) -> DataFrame:
    """At most ``total / number of groups`` rows of each group, chosen by a hash of the key.

    The cap is the sampling rule itself. Spark keeps the best rows of each task before the shuffle."""
    groups = df.select(F.count_distinct(by)).scalar()
    w = Window.partitionBy(by).orderBy(F.md5(key.cast("string")), key)
    return df.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= F.floor(F.lit(total) / groups)).drop("_rk")


def robust_fit(train: DataFrame, cols: Sequence[str], low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Median and inter-quantile range per feature, exact, in one long-form pass."""
    long = train.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in cols])).alias("r")).select("r.*")
    q = exact_quantiles(long, "v", ["feature"], [low, 0.5, high])
    return q.select("feature", F.col("quantiles")[1].alias("center"), (F.col("quantiles")[2] - F.col("quantiles")[0]).alias("scale"))


def robust_scale(df: DataFrame, fitted: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(x - median) / range; a range of 0 leaves the centred value. The fit is one value per feature."""
    m = fitted.agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("center", "scale"))))).scalar()
    d = df.withColumn("_m", m)

    def scaled(c):
        s = F.col("_m")[c]
        return (F.col(c) - s["center"]) / F.when(s["scale"] > 0, s["scale"]).otherwise(1.0)

    return d.select(*[x for x in df.columns if x not in cols], *[scaled(c).alias(c) for c in cols])


def adaptive_sample(df: DataFrame, period: Column, key: Column, capacity: int = 10_000, begin: int = 8_000, max_k: int = 10) -> DataFrame:
    """Thin busy periods: above ``begin`` rows keep one in K, K growing to ``max_k`` at ``capacity``.

    Which rows stay depends on the key alone, so a rerun keeps the same ones."""
    d = df.withColumn("_p", period)
    load = d.groupBy("_p").agg(F.count(F.lit(1)).alias("_load"))
    k = F.when(F.col("_load") <= begin, 1).otherwise(F.least(F.lit(max_k), 1 + F.ceil((F.col("_load") - begin) * (max_k - 1) / (capacity - begin))))
    d = d.join(load, "_p").withColumn("sample_k", k.cast("bigint"))
    return d.filter(F.pmod(key, F.col("sample_k")) == 0).drop("_p", "_load")
