"""What the price did after a prediction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlake.operators.blocks import KEY
from marketlake.operators.first_passage import crossing


def resolve(preds: DataFrame, bars: DataFrame, horizon: int = 240, mode: str = "earliest", held: DataFrame | None = None) -> DataFrame:
    """Outcome of every prediction within ``horizon`` bars after its bar.

    ``earliest`` takes the barrier hit first (the upper one on the same bar); ``priority`` takes the
    upper one whenever it is hit at all. A held zone (see ``held_bars``) comes before both. A
    prediction made before the first bar has no bar to count from and stays PENDING."""
    legs = F.array(F.struct(F.lit(True).alias("up"), F.col("predicted_bsl_level").alias("level")), F.struct(F.lit(False).alias("up"), F.col("predicted_ssl_level").alias("level")))
    q = preds.filter(F.col("bar_no").isNotNull())
    rows = q.select("prediction_id", *KEY, "bar_no", F.explode(legs).alias("_l")).select("prediction_id", *KEY, "bar_no", F.col("_l.up").alias("up"), F.col("_l.level").alias("level"))
    hit = crossing(rows, bars, F.col("up"), F.col("level"), F.col("high"), F.col("low"), F.col("bar_no") + 1, False, horizon, "hit")
    both = hit.groupBy("prediction_id", *KEY, "bar_no").agg(F.max(F.when(F.col("up"), F.col("hit"))).alias("bsl_no"), F.max(F.when(~F.col("up"), F.col("hit"))).alias("ssl_no"))
    ends = bars.groupBy(*KEY).agg(F.max("bar_no").alias("_end"))
    both = both.join(ends, list(KEY))
    bsl, ssl = F.col("bsl_no"), F.col("ssl_no")
    first = bsl.isNotNull() if mode == "priority" else bsl.isNotNull() & (ssl.isNull() | (bsl <= ssl))
    over = F.col("_end") >= F.col("bar_no") + horizon
    if held is not None:
        both = both.join(held, [*KEY, "bar_no"], "left").withColumn("zone_hold", F.coalesce("zone_hold", F.lit(False)))
    else:
        both = both.withColumn("zone_hold", F.lit(False))
    out = F.when(F.col("zone_hold"), "ZONE_HOLD").when(first, "BSL_HIT").when(ssl.isNotNull(), "SSL_HIT").when(over, "TIMEOUT").otherwise("PENDING")
    when = F.when(F.col("zone_hold"), F.lit(None)).when(first, bsl).when(ssl.isNotNull(), ssl).when(over, F.col("bar_no") + horizon)
    none = F.lit(None).cast("bigint")
    early = preds.filter(F.col("bar_no").isNull()).select("prediction_id", *KEY, "bar_no", F.lit("PENDING").alias("outcome"), none.alias("outcome_no"), none.alias("bsl_no"), none.alias("ssl_no"))
    done = both.select("prediction_id", *KEY, "bar_no", out.alias("outcome"), when.cast("bigint").alias("outcome_no"), "bsl_no", "ssl_no")
    return done.unionByName(early)


def pending(outcomes: DataFrame) -> DataFrame:
    return outcomes.filter(F.col("outcome") == "PENDING")
