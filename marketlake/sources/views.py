"""Market-shaped views over the given tables.

``events`` stands in for quotes and the calendar, ``lineitem`` for a daily tape, ``orders`` for
predictions and ``embeddings`` for stored situations. Nothing is sampled or cut.

Bars are persisted (memory, then disk): structure work reads them many times, they are bounded
by the calendar rather than by the ticks, and a lost executor's part is rebuilt from lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlake.operators.bars import enrich_ticks, number_bars, ohlcv, ohlcv_of
from marketlake.session import use_utc

SPREAD_LIMIT = 500.0


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    use_utc(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def ticks(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    half = (1 + k % 5) * 0.01
    base = F.lit(100.0) + F.col("value")
    bid, ask = base - half, base + half
    return events(spark, sf).select(
        F.col("event_type").alias("symbol"),
        "ts",
        F.col("event_id").alias("seq"),
        bid.alias("bid"),
        ask.alias("ask"),
        F.when(k % 3 == 0, ask).when(k % 3 == 1, bid).otherwise(base).alias("last"),
        (1 + k % 20).cast("double").alias("volume"),
        F.lit(0).alias("flags"),
    )


def enriched(spark: SparkSession, sf: str) -> DataFrame:
    return enrich_ticks(ticks(spark, sf), SPREAD_LIMIT)


def flow_ticks(spark: SparkSession, sf: str) -> DataFrame:
    """Enriched ticks with order flow muted where the spread is abnormal."""
    return enriched(spark, sf).withColumn("delta", F.when(F.col("is_abnormal"), 0.0).otherwise(F.col("delta")))


def tick_bars(spark: SparkSession, sf: str, tf: str = "H1") -> DataFrame:
    return ohlcv(flow_ticks(spark, sf), [tf]).persist()


def flow_bars(spark: SparkSession, sf: str, tf: str = "H1") -> DataFrame:
    """Order-flow bars that also carry the mean spread."""
    extra = {"spread": F.avg("spread_pips")}
    return number_bars(ohlcv_of(flow_ticks(spark, sf), tf, extra=extra)).persist()


def quote_bars(spark: SparkSession, sf: str, tfs=("M1", "M5", "M15", "H1", "H4", "D1")) -> DataFrame:
    """Bars of the plain ticks (no order flow): one scan, no per-tick window."""
    return ohlcv(ticks(spark, sf), list(tfs))


def day_trades(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem")  # noqa: E741
    return l.select(
        F.concat("l_returnflag", "l_linestatus").alias("symbol"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("seq"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("last"),
        F.col("l_quantity").alias("volume"),
    )


def day_bars(spark: SparkSession, sf: str) -> DataFrame:
    """D1 bars of the daily tape. All trades of a day share one time, so ``seq`` alone orders them."""
    bars = number_bars(ohlcv_of(day_trades(spark, sf), "D1", F.col("seq")))
    return bars.drop("buy_volume", "sell_volume", "cvd").persist()


def calendar(spark: SparkSession, sf: str) -> DataFrame:
    """Calendar rows; ``forecast`` is the previous value of the currency, carried over day blocks."""
    from marketlake.operators.blocks import time_block, with_previous

    e = events(spark, sf).filter(F.col("event_type") == "signup")
    k = F.get_json_object("props", "$.k").cast("int")

    def pick(n: int, *names: str):
        c = F.lit(names[-1])
        for i, s in reversed(list(enumerate(names[:-1]))):
            c = F.when(k % n == i, s).otherwise(c)
        return c

    c = e.select(
        "event_id",
        F.concat(F.lit("EV"), (k % 8).cast("string")).alias("title"),
        pick(4, "USD", "EUR", "GBP", "JPY").alias("currency"),
        pick(3, "HIGH", "MEDIUM", "LOW").alias("impact"),
        F.col("ts").alias("scheduled_time"),
        F.col("value").alias("actual"),
    )
    c = with_previous(c, ["actual"], ["currency"], ["scheduled_time", "event_id"], time_block(F.col("scheduled_time"), 86400))
    return c.withColumnRenamed("prev_actual", "forecast")


#: Symbols that a currency's events move: a stand-in list over all symbols.
LISTED = {"USD": ("click", "error", "purchase", "signup", "view"), "EUR": ("click", "view"), "GBP": ("error", "purchase"), "JPY": ("signup",)}

DAY_SYMBOLS = ("AF", "AO", "NF", "NO", "RF", "RO")


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """One prediction per order; probabilities from key arithmetic, label from the status."""
    o = table(spark, sf, "orders")
    a = (1 + F.col("o_orderkey") % 97).cast("double")
    b = (1 + F.col("o_custkey") % 89).cast("double")
    c = (1 + (F.col("o_orderkey") * 7) % 83).cast("double")
    s = a + b + c
    symbols = F.array(*[F.lit(x) for x in DAY_SYMBOLS])
    return o.select(
        F.col("o_orderkey").alias("prediction_id"),
        F.col("o_orderdate").cast("timestamp").alias("bar_close_time"),
        F.element_at(symbols, (F.col("o_orderkey") % 6 + 1).cast("int")).alias("symbol"),
        a.alias("a"),
        b.alias("b"),
        (a / s).alias("p_bsl"),
        (b / s).alias("p_ssl"),
        (c / s).alias("p_lateral"),
        F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2).alias("label"),
        F.col("o_orderpriority").alias("regime"),
        F.col("o_custkey").alias("client"),
    )


def levelled_predictions(spark: SparkSession, sf: str, bars: DataFrame | None = None) -> DataFrame:
    """Predictions with target levels around the last closed daily bar of their symbol."""
    from marketlake.operators.asof import asof

    bars = day_bars(spark, sf) if bars is None else bars
    closed = bars.select("symbol", F.timestamp_seconds(F.col("bucket") + 86400).alias("closed_at"), "bar_no", "close")
    p = asof(predictions(spark, sf), closed, "bar_close_time", "closed_at", ["symbol"],
             {"bar_no": "bar_no", "close": "ref_close"}, block_seconds=86400 * 64)
    return (
        p.withColumn("predicted_bsl_level", F.col("ref_close") * (1 + F.col("a") / 1000))
        .withColumn("predicted_ssl_level", F.col("ref_close") * (1 - F.col("b") / 1000))
    )


TRADE_ORDER = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


def trades(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem")  # noqa: E741
    return l.select(
        *TRADE_ORDER,
        F.concat("l_returnflag", "l_linestatus").alias("symbol"),
        (F.col("l_extendedprice") * (F.col("l_discount") - F.col("l_tax"))).alias("pnl"),
        F.col("l_quantity").alias("hold_bars"),
    )


DRIFT_COLUMNS = {"quantity": "l_quantity", "extendedprice": "l_extendedprice", "discount": "l_discount", "tax": "l_tax"}


def drift_sets(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    l = table(spark, sf, "lineitem")  # noqa: E741
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    cols = [F.col(c).alias(n) for n, c in DRIFT_COLUMNS.items()]
    return l.filter(F.col("l_shipdate") < cut).select(*cols), l.filter(F.col("l_shipdate") >= cut).select(*cols)


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").withColumn("age_days", (F.col("vec_id") % 60).cast("double"))
