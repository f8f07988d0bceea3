"""Whether a three-class model is better than knowing the class shares alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlake.operators import evaluation as E

#: Probabilities below this count as this much in the log loss.
LEAST = 1e-15


def _brier(p: Sequence[Column]) -> Column:
    return F.avg(sum((x - (F.col("label") == k).cast("double")) ** 2 for k, x in enumerate(p)) / len(p))


def _log_loss(p: Sequence[Column]) -> Column:
    hit = F.lit(0.0)
    for k, x in enumerate(p):
        hit = F.when(F.col("label") == k, x).otherwise(hit)
    return F.avg(-F.log(F.greatest(hit, F.lit(LEAST))))


def skill(scored: DataFrame, train: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """n, Brier score and log loss of ``scored``, those of the class shares of ``train``, and whether both are lower.

    Rows with a null label or probability count nowhere; without rows of either the figures are null."""
    shares = train.agg(F.struct(*[F.avg((F.col("label") == k).cast("double")).alias(p) for k, p in enumerate(E.P)])).scalar()
    d = scored.dropna(subset=["label", *E.P]).withColumn("_s", shares)
    own, prior = [F.col(p) for p in E.P], [F.col("_s")[p] for p in E.P]
    d = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), _brier(own).alias("brier"), _brier(prior).alias("prior_brier"), _log_loss(own).alias("log_loss"), _log_loss(prior).alias("prior_log_loss"))
    return d.withColumn("better", (F.col("brier") < F.col("prior_brier")) & (F.col("log_loss") < F.col("prior_log_loss")))
