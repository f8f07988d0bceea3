"""Isotonic regression by mergeable pools, and the map from score to fitted value.

Rows are counted by score first. The scores are dealt to ranges; each range pools adjacent violators alone,
streaming over its sorted rows, and leaves blocks of (first score, last score, weight, sum). Blocks of FAN
neighbouring ranges are pooled again until one set is left: pooling pooled blocks gives the same fit as pooling
all rows. With labels 0 and 1 blocks have different means with whole parts, so n rows leave at most about
(5 n)^(2/3) / 3 blocks (900,000 for 10^9 rows), which bounds the last task.

Rows whose score or label is null or NaN teach nothing; equal scores are one point; no rows give no blocks. The
value between two blocks is interpolated, outside them the nearest one's; without blocks, or for a null or NaN
score, it is null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlake.operators.ranks import cut_points, slice_of

FAN = 16
BLOCK = "part long, lo double, hi double, w double, s double"


def _pooled(rows: Iterator[tuple], stack: list | None = None) -> list:
    """Blocks of ascending mean from (lo, hi, w, s) in order of score."""
    stack = [] if stack is None else stack
    for lo, hi, w, s in rows:
        while stack and stack[-1][3] * w >= s * stack[-1][2]:
            a, _, v, t = stack.pop()
            lo, w, s = a, v + w, t + s
        stack.append((lo, hi, w, s))
    return stack


def _known(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c)


def fit(df: DataFrame, score: str, label: str, ranges: int | None = None) -> DataFrame:
    """(lo, hi, w, value) of the blocks of the rising fit of ``label`` on ``score``."""
    p = df.select(F.col(score).cast("double").alias("x"), F.col(label).cast("double").alias("y")).where(_known("x") & _known("y"))
    p = p.groupBy("x").agg(F.count(F.lit(1)).cast("double").alias("w"), F.sum("y").alias("s"))
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def alone(batches):
        part, stack = -1, []
        for b in batches:
            if len(b):
                part = int(b["part"].iloc[0])
                _pooled(zip(b["x"], b["x"], b["w"], b["s"]), stack)
        yield pd.DataFrame([(part, *k) for k in stack], columns=["part", "lo", "hi", "w", "s"])

    def merged(key, pdf):
        d = pdf.sort_values("lo")
        return pd.DataFrame([(key[0], *k) for k in _pooled(zip(d["lo"], d["hi"], d["w"], d["s"]))], columns=["part", "lo", "hi", "w", "s"])

    b = p.repartitionByRange(n, "x").sortWithinPartitions("x").withColumn("part", F.spark_partition_id().cast("long")).mapInPandas(alone, BLOCK)
    for _ in range(math.ceil(math.log(max(n, 2), FAN))):
        b = b.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("part").applyInPandas(merged, BLOCK)
    return b.select("lo", "hi", "w", (F.col("s") / F.col("w")).alias("value"))


def values(df: DataFrame, blocks: DataFrame, score: str, out: str) -> DataFrame:
    """``df`` with the fitted value of ``score``.

    Each distinct score finds its neighbours among the block ends in its slice; the slices' own ends, 256 rows
    at most, stand in where a slice has none on one side."""
    x = df.select(F.col(score).cast("double").alias("_x")).where(_known("_x")).distinct()
    ends = blocks.select(F.explode(F.array("lo", "hi")).alias("_x"), F.col("value").alias("_v")).distinct()
    cuts = ends.agg(cut_points("_x").alias("_cuts"))
    both = x.withColumn("_v", F.lit(None).cast("double")).unionByName(ends).groupBy("_x").agg(F.max("_v").alias("_v"))
    both = both.withColumn("_cuts", cuts.scalar()).withColumn("_slice", F.coalesce(slice_of(F.col("_cuts"), F.col("_x")), F.lit(0))).drop("_cuts")
    end = F.when(F.col("_v").isNotNull(), F.struct("_x", "_v"))
    edges = both.groupBy("_slice").agg(F.min(end).alias("_first"), F.max(end).alias("_last"))
    up, down = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.desc("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.select("_slice", F.last("_last", ignorenulls=True).over(up).alias("_below"), F.last("_first", ignorenulls=True).over(down).alias("_above"))
    before = Window.partitionBy("_slice").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("_slice").orderBy(F.desc("_x")).rowsBetween(Window.unboundedPreceding, 0)
    near = both.select("*", F.last(end, ignorenulls=True).over(before).alias("_a"), F.last(end, ignorenulls=True).over(after).alias("_b")).join(F.broadcast(edges), "_slice")
    a, b = F.coalesce("_a", "_below"), F.coalesce("_b", "_above")
    share = (F.col("_x") - a["_x"]) / (b["_x"] - a["_x"])
    v = F.when(a.isNull(), b["_v"]).when(b.isNull() | (a["_x"] == b["_x"]), a["_v"]).otherwise(a["_v"] + share * (b["_v"] - a["_v"]))
    found = near.select(F.col("_x").alias("_score"), v.alias(out))
    return df.join(found, df[score].cast("double") == found["_score"], "left").drop("_score")
