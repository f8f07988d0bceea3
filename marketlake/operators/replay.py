"""From predictions and bars to trades and their report: a back-test without a loop over time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlake.operators import evaluation as E
from marketlake.operators.blocks import KEY
from marketlake.operators.outcomes import resolve


def trades_from(preds: DataFrame, bars: DataFrame, horizon: int = 240) -> DataFrame:
    """One trade for each settled prediction that names a side: the likelier of the two targets, if no less
    likely than staying between them.

    It enters at the close of the prediction's bar and leaves at the target that was hit, or at the close of the
    bar where the time ran out. Pending predictions, equal sides and null probabilities make no trade.
    A prediction id names one row."""
    b, s = F.col("p_bsl"), F.col("p_ssl")
    side = F.when((b > s) & (b >= F.col("p_lateral")), 1).when((s > b) & (s >= F.col("p_lateral")), -1)
    done = resolve(preds, bars, horizon).filter("outcome <> 'PENDING'").select("prediction_id", "outcome", "outcome_no")
    sided = preds.withColumn("side", side).filter("side IS NOT NULL").select("prediction_id", *KEY, "bar_no", "side", "predicted_bsl_level", "predicted_ssl_level")
    t = sided.join(done, "prediction_id")
    start = bars.select(*KEY, "bar_no", F.col("close").alias("entry"))
    end = bars.select(*KEY, F.col("bar_no").alias("outcome_no"), F.timestamp_seconds("bucket").alias("closed_at"), F.col("close").alias("_close"))
    t = t.join(start, [*KEY, "bar_no"]).join(end, [*KEY, "outcome_no"])
    left = F.when(F.col("outcome") == "BSL_HIT", F.col("predicted_bsl_level")).when(F.col("outcome") == "SSL_HIT", F.col("predicted_ssl_level")).otherwise(F.col("_close"))
    return t.select("prediction_id", *KEY, "side", "outcome", "closed_at", "entry", left.alias("exit"), (F.col("side") * (left - F.col("entry"))).alias("pnl"), (F.col("outcome_no") - F.col("bar_no")).alias("hold_bars"))


def replay(preds: DataFrame, bars: DataFrame, horizon: int = 240) -> DataFrame:
    """The report of every key's trades: count, hit rate, profit factor, Sharpe ratio, holding time, drawdown in order of exit.

    The predictions are read for their outcomes and for their sides, the trades for their figures and twice for
    the curve: both are persisted (memory, then disk), so that each is worked out once."""
    t = trades_from(preds.persist(), bars, horizon).persist()
    curve = E.equity_curve(t, list(KEY), ["closed_at", "prediction_id"])
    return E.trade_metrics(t, list(KEY)).join(E.max_drawdown(curve, list(KEY)), list(KEY))
