"""Ranks, rank correlation and exact quantiles without a global sort.

For ranks, values are counted first, so a value that fills a third of the table is one row. The distinct
values are cut into 256 ranges by approximate percentiles (only to balance the work), summed inside
a range and shifted by the totals of the ranges before. Quantiles come from counts of cells that are cut
finer and finer. The results are exact.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlake.operators.blocks import running_sum

#: Cells that a range of values is cut into in each pass of ``exact_quantiles``.
CELLS = 4096
FINE = 16
CUTS = [i / (FINE * FINE) for i in range(1, FINE * FINE)]


def cut_points(value: str) -> Column:
    """255 approximate percentiles, an aggregate."""
    return F.percentile_approx(value, F.array(*[F.lit(c) for c in CUTS]), 2000)


def slice_of(cuts: Column, value: Column) -> Column:
    """Which of the 256 slices a value falls in: a binary search of eight steps; no array is made per row."""
    steps = F.array(*[F.lit(FINE * FINE >> k) for k in range(1, 9)])
    return F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get(cuts, at + step - 1) <= value, step).otherwise(0))


def cumulative_counts(df: DataFrame, value: str, by: Sequence[str], weight: Column | None = None) -> DataFrame:
    """One row per distinct value: its count ``n``, ``upto`` (rows at or below it) and its slice."""
    counts = df.groupBy(*by, value).agg(F.sum(weight if weight is not None else F.lit(1)).cast("double").alias("n")).persist()
    cuts = counts.groupBy(*by).agg(cut_points(value).alias("_cuts"))
    c = counts.join(cuts, list(by)) if by else counts.withColumn("_cuts", cuts.scalar())
    c = c.withColumn("_slice", slice_of(F.col("_cuts"), F.col(value))).drop("_cuts").persist()
    return running_sum(c, {"upto": F.col("n")}, by, [value], F.col("_slice"))


def average_ranks(df: DataFrame, value: str, by: Sequence[str], out: str, weight: Column | None = None) -> DataFrame:
    c = cumulative_counts(df.filter(F.col(value).isNotNull()), value, by, weight)
    return c.select(*by, value, (F.col("upto") - (F.col("n") - 1) / 2).alias(out))


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Rank correlation per group; 0 below three rows or when a side is constant."""
    by = list(by)
    pairs = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.count(F.lit(1)).alias("_w")).persist()
    p = pairs.join(average_ranks(pairs, "_x", by, "_rx", F.col("_w")), [*by, "_x"]).join(average_ranks(pairs, "_y", by, "_ry", F.col("_w")), [*by, "_y"])
    w, a, b = F.col("_w"), F.col("_rx"), F.col("_ry")
    s = p.groupBy(*by).agg(F.sum(w).alias("n"), F.sum(w * a).alias("a"), F.sum(w * b).alias("b"), F.sum(w * a * a).alias("aa"), F.sum(w * b * b).alias("bb"), F.sum(w * a * b).alias("ab"))
    va, vb = F.col("aa") - F.col("a") * F.col("a") / F.col("n"), F.col("bb") - F.col("b") * F.col("b") / F.col("n")
    rho = (F.col("ab") - F.col("a") * F.col("b") / F.col("n")) / F.sqrt(va * vb)
    return s.select(*by, F.col("n").cast("bigint").alias("n"), F.when((F.col("n") >= 3) & (va > 0) & (vb > 0), rho).otherwise(0.0).alias("ic"))


def exact_quantiles(df: DataFrame, value: str, by: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Linearly interpolated quantiles, one row per group with an array in the order of ``probs``.

    A radix selection in a few passes: the range of the values is cut into CELLS equal cells, only counts (and the
    least and greatest value) of cells are shuffled, and only cells that hold a wanted rank are cut again, between
    their own least and greatest value, until each holds one value. No row per distinct value is made. ``df`` is
    read once a pass (two or three for values that are not extremely uneven); groups are as many as a broadcast
    holds, such as features. Nulls don't count and rows of a null group are left out; infinities and NaN are
    the last values, as Spark orders them. An empty table gives no row."""
    rows = df.select(*by, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    keys = list(by) or ["_all"]
    if not by:
        rows = rows.withColumn("_all", F.lit(0))
    rows = rows.dropna(subset=keys)
    v, top = F.col("_v"), F.lit(float("inf"))
    finite = ~F.isnan(v) & (F.abs(v) < top)
    ends = rows.groupBy(*keys).agg(F.count_if(v == -top).alias("below"), F.count_if(finite).alias("n"), F.count_if(v == top).alias("above"),
                                   F.count_if(F.isnan(v)).alias("nan"), F.min(F.when(finite, v)).alias("lo"), F.max(F.when(finite, v)).alias("hi")).collect()
    found: dict[tuple, dict[int, float]] = {}
    spots: dict[tuple, list[tuple[float, int, int]]] = {}
    open_ = []  # (group, lo, hi, rows before lo, wanted ranks in between)
    for e in ends:
        group = tuple(e[k] for k in keys)
        total = e["below"] + e["n"] + e["above"] + e["nan"]
        spots[group] = [(p * (total - 1), math.floor(p * (total - 1)), math.ceil(p * (total - 1))) for p in map(float, probs)]
        wanted = sorted({k for _, a, b in spots[group] for k in (a, b)})
        first, last = e["below"], e["below"] + e["n"]
        found[group] = {k: -math.inf if k < first else math.nan if k >= last + e["above"] else math.inf for k in wanted if not first <= k < last}
        if inside := [k for k in wanted if first <= k < last]:
            open_.append((group, e["lo"], e["hi"], first, inside))
    while open_:
        for group, lo, hi, _, ranks in open_:
            if lo == hi:
                found[group].update(dict.fromkeys(ranks, lo))
        open_ = [o for o in open_ if o[1] < o[2]]
        if open_:
            open_ = _narrowed(rows, keys, open_)
    out = [(*group[: len(by)], [found[group][a] if a == b else found[group][a] * (1 - (x - a)) + found[group][b] * (x - a) for x, a, b in spots[group]]) for group in spots]
    return df.sparkSession.createDataFrame(out, T.StructType([*(rows.schema[k] for k in by), T.StructField("quantiles", T.ArrayType(T.DoubleType()))]))


def _narrowed(rows: DataFrame, keys: list[str], open_: list[tuple]) -> list[tuple]:
    """The cells of the open ranges that hold wanted ranks: a few rows for each group."""
    kind = T.StructType([*(rows.schema[k] for k in keys), *T.StructType.fromDDL("_from double, _to double, _half double, _start long, _wanted array<long>")])
    flat = [(*group, lo, hi, 0.5 if math.isinf(hi - lo) else 1.0, before, ranks) for group, lo, hi, before, ranks in open_]
    spans = F.broadcast(rows.sparkSession.createDataFrame(flat, kind))
    # the ranges of a group are disjoint, so a value is in one at most; only plain columns meet the values
    lo, hi, half = F.col("_from"), F.col("_to"), F.col("_half")
    hit = rows.join(spans.drop("_start", "_wanted"), keys).where((lo <= F.col("_v")) & (F.col("_v") <= hi))
    share = (F.col("_v") * half - lo * half) / (hi * half - lo * half)  # never falls as the value rises
    hit = hit.withColumn("_cell", F.least(F.floor(share * CELLS), F.lit(CELLS - 1)))
    cells = hit.groupBy(*keys, "_from", "_cell").agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    cells = cells.join(spans.select(*keys, "_from", "_start", "_wanted"), [*keys, "_from"])
    w = Window.partitionBy(*keys, "_from").orderBy("_cell")  # at most CELLS rows
    cells = cells.withColumn("_upto", F.sum("_n").over(w) + F.col("_start")).withColumn("_before", F.col("_upto") - F.col("_n"))
    ranks = F.filter("_wanted", lambda k: (k >= F.col("_before")) & (k < F.col("_upto")))
    some = cells.withColumn("_ranks", ranks).where(F.size("_ranks") > 0).collect()
    return [(tuple(r[k] for k in keys), r["_lo"], r["_hi"], r["_before"], list(r["_ranks"])) for r in some]
