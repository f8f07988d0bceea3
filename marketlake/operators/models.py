"""Training, calibration, stacking, scoring and gates on MLlib."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlake.functions import scoring
from marketlake.operators import evaluation as E


def as_features(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumn("features", array_to_vector(F.array(*[F.col(c).cast("double") for c in cols])))


def fit_direction(train: DataFrame, trees: int = 30, depth: int = 5, weight: str | None = None, kind: str = "forest", seed: int = 7):
    """Three-class direction model on ``features`` and ``label``: a forest, or boosted trees, one model
    for each class against the rest. With a Boolean column ``valid`` the boosted trees stop where the
    rows it marks improve no further; they are not trained on."""
    if kind == "boosted":
        gbt = GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed, labelCol="_y", **({"weightCol": weight} if weight else {}))
        if "valid" in train.columns:
            gbt = gbt.setValidationIndicatorCol("valid")
        return [gbt.fit(train.withColumn("_y", (F.col("label") == k).cast("double"))) for k in range(len(E.P))]
    m = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed)
    return (m.setWeightCol(weight) if weight else m).fit(train)


def class_probabilities(model, df: DataFrame) -> DataFrame:
    """p_bsl, p_ssl, p_lateral from the model's probability vector, or from those of one model for each class."""
    if isinstance(model, list):
        d = df
        for k, m in enumerate(model):
            d = m.transform(d).withColumn(f"_p{k}", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")
        total = sum(F.col(f"_p{k}") for k in range(len(model)))
        return d.select(*df.columns, *[(F.col(f"_p{k}") / total).alias(p) for k, p in enumerate(E.P)])
    d = model.transform(df).withColumn("_p", vector_to_array("probability"))
    return d.select(*df.columns, *[F.col("_p")[i].alias(p) for i, p in enumerate(E.P)])


def with_class_weight(df: DataFrame, y: str = "label") -> DataFrame:
    """Positive rows weigh N0 / N1."""
    w = df.agg(F.count_if(F.col(y) == 0) / F.greatest(F.count_if(F.col(y) == 1), F.lit(1))).scalar()
    return df.withColumn("weight", F.when(F.col(y) == 1, w).otherwise(1.0))


def fit_hold(train: DataFrame, trees: int = 20, depth: int = 4, seed: int = 7):
    """Binary hold model with class weights. Without a row to learn from it is the number 0.5."""
    if train.isEmpty():
        return 0.5
    return GBTClassifier(maxIter=trees, maxDepth=depth, weightCol="weight", seed=seed).fit(with_class_weight(train))


def hold_probability(model, df: DataFrame, out: str = "p_hold") -> DataFrame:
    if isinstance(model, float):
        return df.withColumn(out, F.lit(model))
    d = model.transform(df)
    return d.select(*df.columns, vector_to_array("probability")[1].alias(out))


def calibrate(valid: DataFrame, score: str, y: str, kind: str = "platt"):
    """Sigmoid or monotone map from score to probability, fitted on validation rows."""
    if kind == "platt":
        return Pipeline(stages=[VectorAssembler(inputCols=[score], outputCol="_f"), LogisticRegression(featuresCol="_f", labelCol=y, probabilityCol="_prob", rawPredictionCol="_raw", predictionCol="_pred")]).fit(valid)
    if kind == "isotonic":
        return IsotonicRegression(featuresCol=score, labelCol=y, predictionCol="_pred").fit(valid.withColumn(y, F.col(y).cast("double")))
    raise ValueError(f"unknown kind {kind}")


def calibrated(model, df: DataFrame, out: str = "p") -> DataFrame:
    d = model.transform(df)
    p = vector_to_array("_prob")[1] if isinstance(model, PipelineModel) else F.least(F.greatest(F.col("_pred"), F.lit(0.0)), F.lit(1.0))
    return d.select(*df.columns, p.alias(out))


def stack(train: DataFrame, cols: Sequence[str]):
    """Multinomial logistic meta-learner on the class probabilities, consensus and regime."""
    return LogisticRegression(family="multinomial", maxIter=50).fit(as_features(train, cols))


def overconfident_weights(scored: DataFrame, above: float = 0.85, weight: float = 0.5) -> DataFrame:
    """Half weight for wrong rows the first fit was too sure about, for a second fit."""
    c = E.confidence_rows(scored)
    return c.withColumn("weight", F.when((F.col("hit") == 0) & (F.col("confidence") > above), weight).otherwise(1.0)).drop("hit", "confidence")


def post_process(scored: DataFrame, regime: Column, bear: Column, version: str = "standard", momentum: Column | None = None, volatility: Column | None = None, hold: Column | None = None) -> DataFrame:
    """Regime adjustment, confidence band, dominant class and rollback to LATERAL; the stricter rollback
    versions look at ``momentum``, ``volatility`` and the hold decision."""
    if version != "standard" and (momentum is None or volatility is None or hold is None):
        raise ValueError(f"version {version} needs momentum, volatility and hold")
    momentum, volatility, hold = (F.lit(d) if c is None else c for c, d in ((momentum, 0.0), (volatility, 0.0), (hold, 1)))
    p = scoring.regime_adjust(*[F.col(c) for c in E.P], regime, bear)
    keep = [c for c in scored.columns if c not in E.P]
    d = scored.select(*keep, *[x.alias(n) for x, n in zip(p, E.P)])
    top = F.greatest(*E.P)
    d = d.select("*", scoring.qualifier(top, regime).alias("quality"), scoring.dominant(*[F.col(c) for c in E.P]).alias("direction"))
    back = scoring.rollback(version, F.col("quality"), top, F.col("direction"), momentum, volatility, regime, hold)
    return d.withColumn("rolled_back", back).withColumn("direction", F.when(back, "LATERAL").otherwise(F.col("direction")))


def importances(model, cols: Sequence[str], spark) -> DataFrame:
    """Tree importance and rank of every feature."""
    values = sorted(zip(cols, map(float, model.featureImportances.toArray())), key=lambda x: (-x[1], x[0]))
    return spark.createDataFrame([(c, v, k + 1) for k, (c, v) in enumerate(values)], "feature string, importance double, rank int")


def evaluate(scored: DataFrame) -> DataFrame:
    """IC, Brier, calibration error and the reasons against deployment, in one row."""
    rows = E.confidence_rows(scored)
    ic = E.ic(scored).select("ic").scalar()
    ece = E.ece(rows, "confidence", "hit", right_closed=True).select("ece").scalar()
    m = E.brier(scored).select(ic.alias("ic"), F.col("brier_cells").alias("brier"), ece.alias("ece"))
    reasons = scoring.gate_reasons({k: F.col(k) for k in ("ic", "brier", "ece")})
    return m.select("*", reasons.alias("reasons"), (F.size(reasons) == 0).alias("deploy"))
