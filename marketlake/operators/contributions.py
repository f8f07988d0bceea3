"""Why a forest gives a row its score: contributions of the features along each tree's path.

A node's value is its share of a class. On the way to a leaf, each split's feature gets the change of value
from the node to the child taken; contributions and the mean root value (the bias) add up to the score. The trees,
whose size the model's parameters bound, become Spark expressions, so rows never leave the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _value(node, k: int) -> float:
    s = list(node.impurityStats().stats())
    return float(s[k]) / sum(s)


def _goes_left(split, x: Column) -> Column:
    v = x[split.featureIndex()]
    if split.getClass().getSimpleName() == "CategoricalSplit":
        return v.isin(*[float(c) for c in split.leftCategories()])
    return v <= F.lit(float(split.threshold()))


def _read(node, k: int, x: Column) -> tuple:
    """(value, feature, condition, left, right) of a node and all below it; a leaf is (value,)."""
    if node.getClass().getSimpleName() == "LeafNode":
        return (_value(node, k),)
    return (_value(node, k), node.split().featureIndex(), _goes_left(node.split(), x), _read(node.leftChild(), k, x), _read(node.rightChild(), k, x))


def _features(t: tuple) -> set[int]:
    return set() if len(t) == 1 else {t[1]} | _features(t[3]) | _features(t[4])


def _share(t: tuple, f: int, so_far: float = 0.0) -> Column | float:
    """What feature ``f`` gets in one tree; splits that make no difference to it are left out."""
    if len(t) == 1:
        return so_far
    a, b = (_share(c, f, so_far + (c[0] - t[0] if t[1] == f else 0.0)) for c in t[3:])
    if isinstance(a, float) and isinstance(b, float) and a == b:
        return a
    return F.when(t[2], a).otherwise(b)


def contributions(model, df: DataFrame, cols: Sequence[str], k: int, features: str = "features") -> DataFrame:
    """``df`` with ``bias`` and ``contributions``, a struct of one double for each of ``cols``, for class ``k``."""
    x = F.col("_x")
    trees = [_read(t._java_obj.rootNode(), k, x) for t in model.trees]
    used = [_features(t) for t in trees]

    def total(f: int) -> Column:
        shares = [_share(t, f) for t, u in zip(trees, used) if f in u]
        return sum((s if isinstance(s, Column) else F.lit(s) for s in shares), F.lit(0.0)) / len(trees)

    bias = sum(t[0] for t in trees) / len(trees)
    d = df.withColumn("_x", vector_to_array(features))
    return d.select(*df.columns, F.lit(bias).alias("bias"), F.struct(*[total(i).alias(c) for i, c in enumerate(cols)]).alias("contributions"))


def strongest(scored: DataFrame, cols: Sequence[str], top: int = 20) -> DataFrame:
    """(feature, mean_abs, rank): the ``top`` features by mean absolute contribution over all rows; ties by name."""
    means = scored.agg(*[F.avg(F.abs(F.col("contributions")[c])).alias(c) for c in cols])
    rows = means.select(F.posexplode(F.array_sort(F.array(*[F.struct((-F.col(c)).alias("m"), F.lit(c).alias("feature")) for c in cols]))).alias("rank", "r"))
    return rows.filter(F.col("rank") < top).select("r.feature", (-F.col("r.m")).alias("mean_abs"), (F.col("rank") + 1).alias("rank"))
