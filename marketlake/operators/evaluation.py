"""Quality of predictions, calibration, trades and latency."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlake.operators.blocks import number_rows, over_blocks, time_block
from marketlake.operators.ranks import cumulative_counts, cut_points, slice_of, spearman

CLASSES = ("BSL", "SSL", "LATERAL")
P = ("p_bsl", "p_ssl", "p_lateral")


def signed(df: DataFrame) -> DataFrame:
    """Signed score and signed outcome: +1 BSL, -1 SSL, 0 lateral."""
    y = F.when(F.col("label") == 0, 1).when(F.col("label") == 1, -1).otherwise(0)
    return df.withColumn("score", F.col("p_bsl") - F.col("p_ssl")).withColumn("outcome", y)


def ic(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return spearman(signed(df), "score", "outcome", by)


def ic_per_class(df: DataFrame) -> DataFrame:
    """One-against-rest rank correlation of each class."""
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("klass"), F.col(p).alias("p"), (F.col("label") == i).cast("int").alias("y")) for i, (c, p) in enumerate(zip(CLASSES, P))]))
    return spearman(df.select(rows.alias("r")).select("r.*"), "p", "y", ["klass"])


def rolling_ic(df: DataFrame, n: int, by: Sequence[str], ts: str, key: str, block_seconds: int = 86400 * 30) -> DataFrame:
    """Rank correlation over the last ``n`` rows of a key, null before ``n`` rows exist.

    Rows are numbered over time blocks, then each row gathers its ``n``-row frame (bounded) and
    ranks inside it."""
    d = number_rows(signed(df), by, [ts, key], time_block(F.col(ts), block_seconds), "_no")

    def add(x, w):
        return x.withColumn("_f", F.collect_list(F.struct(F.col("score").alias("a"), F.col("outcome").cast("double").alias("b"))).over(w.rowsBetween(-(n - 1), 0)))

    d = over_blocks(d, n - 1, add, by=by, no="_no")
    full = F.when(F.col("_no") >= n - 1, F.col("_f"))
    d = d.withColumn("rolling_ic", frame_ic(F.transform(full, lambda v: v["a"]), F.transform(full, lambda v: v["b"])))
    return d.drop("_f", "_no")


@F.pandas_udf(T.DoubleType())
def frame_ic(a: pd.Series, b: pd.Series) -> pd.Series:
    """Rank correlation of two equally long arrays per row, whole Arrow batches at a time; null stays null."""
    out = pd.Series([None] * len(a), index=a.index, dtype="Float64")
    known = a.notna()
    if not known.any():
        return out

    def ranks(col):
        m = np.stack(col[known].to_numpy()).astype("float64")
        less = (m[:, None, :] < m[:, :, None]).sum(2)
        same = (m[:, None, :] == m[:, :, None]).sum(2)
        return less + (same + 1) / 2.0 - (m.shape[1] + 1) / 2.0

    x, y = ranks(a), ranks(b)
    xx, yy, xy = (x * x).sum(1), (y * y).sum(1), (x * y).sum(1)
    ok = (xx > 0) & (yy > 0)
    out[known] = np.where(ok, xy / np.sqrt(np.where(ok, xx * yy, 1.0)), 0.0)
    return out


def mean_ic(df: DataFrame, label: str) -> DataFrame:
    """Mean of the defined IC values of each label, 0 when there is none."""
    return df.groupBy(label).agg(F.count("rolling_ic").alias("n"), F.coalesce(F.avg("rolling_ic"), F.lit(0.0)).alias("mean_ic"))


def ic_summary(df: DataFrame) -> DataFrame:
    x = F.col("rolling_ic")
    return df.agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg((x > 0).cast("double")).alias("positive_ratio"))


def overfit_gap(df: DataFrame, is_forward: Column, limit: float = 0.15) -> DataFrame:
    a = df.agg(F.avg(F.when(~is_forward, F.col("rolling_ic"))).alias("ic_backtest"), F.avg(F.when(is_forward, F.col("rolling_ic"))).alias("ic_forward"))
    gap = F.abs(F.col("ic_backtest") - F.col("ic_forward"))
    return a.select("*", gap.alias("gap"), (gap > limit).alias("overfit"))


# ---------------------------------------------------------------- calibration

def _sq(i: int) -> Column:
    e = F.col(P[i]) - (F.col("label") == i).cast("double")
    return e * e


def brier(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    total = _sq(0) + _sq(1) + _sq(2)
    return df.groupBy(*by).agg(F.avg(total / 3).alias("brier_cells"), F.avg(total).alias("brier_rows"), *[F.avg(_sq(i)).alias(f"brier_{c.lower()}") for i, c in enumerate(CLASSES)])


def _bin(p: Column, bins: int, right_closed: bool) -> Column:
    b = F.ceil(p * bins) - 1 if right_closed else F.floor(p * bins)
    return F.least(F.greatest(b, F.lit(0)), F.lit(bins - 1)).cast("int")


def ece(df: DataFrame, score: str, hit: str, by: Sequence[str] = (), bins: int = 10, right_closed: bool = False, out: str = "ece") -> DataFrame:
    """Expected calibration error over equal bins: weighted gap of mean score and hit rate."""
    b = df.groupBy(*by, _bin(F.col(score), bins, right_closed).alias("_bin")).agg(F.count(F.lit(1)).alias("_n"), F.avg(score).alias("_s"), F.avg(F.col(hit).cast("double")).alias("_h"))
    return b.groupBy(*by).agg((F.sum(F.col("_n") * F.abs(F.col("_s") - F.col("_h"))) / F.sum("_n")).alias(out), F.sum("_n").alias("rows"))


def confidence_rows(df: DataFrame) -> DataFrame:
    """Confidence of the chosen class and whether it was right."""
    pick = F.when((F.col("p_bsl") >= F.col("p_ssl")) & (F.col("p_bsl") >= F.col("p_lateral")), 0).when(F.col("p_ssl") >= F.col("p_lateral"), 1).otherwise(2)
    return df.withColumn("confidence", F.greatest(*P)).withColumn("hit", (pick == F.col("label")).cast("int"))


def one_vs_rest_rows(df: DataFrame) -> DataFrame:
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("klass"), F.col(p).alias("p"), (F.col("label") == i).cast("int").alias("y")) for i, (c, p) in enumerate(zip(CLASSES, P))]))
    return df.select("regime", rows.alias("r")).select("regime", "r.*")


def ece_report(df: DataFrame, score: str, hit: str, by: str, target: float = 0.05, least: int = 5) -> DataFrame:
    """ECE per regime (at least ``least`` rows) with its largest, mean, and who meets the target."""
    e = ece(df, score, hit, [by]).filter(F.col("rows") >= least)
    return e.agg(F.max("ece").alias("max_ece"), F.avg("ece").alias("mean_ece"),
                 F.sort_array(F.collect_list(F.when(F.col("ece") < target, F.col(by)))).alias("below_target"),
                 F.sort_array(F.collect_list(F.when(F.col("ece") >= target, F.col(by)))).alias("above_target"))


# ---------------------------------------------------------------- binary decisions

def confusion(df: DataFrame, score: str, y: str, threshold: float = 0.71, by: Sequence[str] = ()) -> DataFrame:
    pos, hit = F.col(score) >= threshold, F.col(y) == 1
    c = df.groupBy(*by).agg(F.count_if(pos & hit).alias("tp"), F.count_if(~pos & ~hit).alias("tn"), F.count_if(pos & ~hit).alias("fp"), F.count_if(~pos & hit).alias("fn"))
    tp, tn, fp, fn = (F.col(x) for x in ("tp", "tn", "fp", "fn"))
    n = tp + tn + fp + fn
    precision, recall = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0), F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    c = c.select("*", ((tp + tn) / n).alias("accuracy"), precision.alias("precision"), recall.alias("recall"), ((tp + fp) / n).alias("positive_rate"))
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return c.withColumn("f1", f1)


def _grid_counts(df: DataFrame, score: str, y: str, steps: int, low: float, high: float) -> DataFrame:
    """Positives and hits at or above each grid threshold: one count per grid cell, then a suffix sum
    over the ``steps`` cells. No row meets the grid in a join."""
    t = [low + (high - low) * i / (steps - 1) for i in range(steps)]
    edges = F.array(*[F.lit(x) for x in t])
    # Position by arithmetic, corrected by one against the exact edge values.
    guess = F.least(F.greatest(F.floor((F.col(score) - low) / ((high - low) / (steps - 1))), F.lit(-1)), F.lit(steps - 1)).cast("int")
    up = F.when((guess + 1 < steps) & (F.col(score) >= F.get(edges, guess + 1)), guess + 1).when((guess >= 0) & (F.col(score) < F.get(edges, guess)), guess - 1).otherwise(guess)
    cells = df.groupBy(up.alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(y) == 1).alias("hits"))
    grid = df.sparkSession.range(steps).select(F.col("id").cast("int").alias("g"), F.get(edges, F.col("id").cast("int")).alias("threshold"))
    w = Window.orderBy(F.col("g").desc()).rowsBetween(Window.unboundedPreceding, 0)  # one row per grid step
    s = grid.join(cells, F.col("cell") == F.col("g"), "left").select(
        "g", "threshold", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("pos"), F.coalesce(F.sum("hits").over(w), F.lit(0)).alias("tp"))
    return s.select("*", cells.agg(F.sum("hits")).scalar().alias("all_hits"), cells.agg(F.sum("n")).scalar().alias("all_n"))


def best_threshold(df: DataFrame, score: str, y: str, beta: float = 1.0, steps: int = 100, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Grid threshold of largest F-beta; the first one wins a tie."""
    g = _grid_counts(df, score, y, steps, low, high)
    b2 = beta * beta
    den = (1 + b2) * F.col("tp") + b2 * (F.col("all_hits") - F.col("tp")) + (F.col("pos") - F.col("tp"))
    f = F.when(den > 0, (1 + b2) * F.col("tp") / den).otherwise(0.0)
    best = g.select("g", "threshold", f.alias("f")).agg(F.max_by(F.struct("threshold", "f"), F.struct(F.round("f", 12), -F.col("g"))).alias("b"))
    return best.select("b.threshold", F.col("b.f").alias("f_beta"))


def cheapest_threshold(df: DataFrame, score: str, y: str, cost_fp: float = 2.5, cost_fn: float = 1.0, steps: int = 100, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Grid threshold of least expected cost."""
    g = _grid_counts(df, score, y, steps, low, high)
    cost = (cost_fp * (F.col("pos") - F.col("tp")) + cost_fn * (F.col("all_hits") - F.col("tp"))) / F.col("all_n")
    best = g.select("g", "threshold", cost.alias("cost")).agg(F.min_by(F.struct("threshold", "cost"), F.struct(F.round("cost", 12), "g")).alias("b"))
    return best.select("b.threshold", "b.cost")


def auc(df: DataFrame, score: str, y: str) -> DataFrame:
    """Exact area under ROC (rank sum) and average precision, from counts per distinct score."""
    d = df.select(F.col(score).alias("s"), (F.col(y) == 1).cast("double").alias("y"))
    all_ = cumulative_counts(d, "s", [])
    pos = d.groupBy("s").agg(F.sum("y").alias("hits"))
    cuts = all_.join(pos, "s")
    hits = cumulative_counts(d, "s", [], F.col("y")).select("s", F.col("upto").alias("hits_upto"))
    c = cuts.join(hits, "s").select("*", cuts.agg(F.sum("hits")).scalar().alias("all_hits"), cuts.agg(F.sum("n")).scalar().alias("all_rows"))
    rank_sum = F.sum(F.col("hits") * (F.col("upto") - (F.col("n") - 1) / 2))
    tp, seen = F.col("all_hits") - F.col("hits_upto") + F.col("hits"), F.col("all_rows") - F.col("upto") + F.col("n")
    a = c.agg(rank_sum.alias("rs"), F.sum(F.col("hits") * tp / seen).alias("ap"), F.max("all_hits").alias("all_hits"), F.max("all_rows").alias("all_rows"))
    return a.select(((F.col("rs") - F.col("all_hits") * (F.col("all_hits") + 1) / 2) / (F.col("all_hits") * (F.col("all_rows") - F.col("all_hits")))).alias("auroc"), (F.col("ap") / F.col("all_hits")).alias("auprc"))


# ---------------------------------------------------------------- trades

def trade_metrics(trades: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    pnl = F.col("pnl")
    t = trades.groupBy(*by).agg(
        F.count(F.lit(1)).alias("trades"), F.avg((pnl > 0).cast("double")).alias("win_rate"),
        F.sum(F.when(pnl > 0, pnl).otherwise(0.0)).alias("gross_profit"), F.sum(F.when(pnl < 0, -pnl).otherwise(0.0)).alias("gross_loss"),
        F.avg(pnl).alias("_m"), F.stddev_pop(pnl).alias("_s"), F.avg("hold_bars").alias("avg_hold_bars"))
    return t.select(*by, "trades", "win_rate", "gross_profit", "gross_loss",
                    F.when(F.col("gross_loss") > 0, F.col("gross_profit") / F.col("gross_loss")).otherwise(F.col("gross_profit")).alias("profit_factor"),
                    F.when(F.col("_s") > 0, F.col("_m") / F.col("_s") * F.sqrt(F.lit(252.0))).otherwise(0.0).alias("sharpe"), "avg_hold_bars")


def equity_curve(trades: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Running profit per key in trade order, and the peak so far.

    ``order`` starts with a day-like time and a number. Days are cut into 256 slices of that number
    (approximate percentiles, for balance only); a slice starts from the totals and peaks before it."""
    cuts = trades.agg(cut_points(order[1])).scalar()
    t = trades.withColumn("_cuts", cuts)
    t = t.withColumn("_slice", F.struct(F.unix_seconds(F.col(order[0]).cast("timestamp")), slice_of(F.col("_cuts"), F.col(order[1])))).drop("_cuts")
    w = Window.partitionBy(*by, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    e = t.withColumn("_sum", F.sum("pnl").over(w)).withColumn("_in", F.max("_sum").over(w)).persist()
    # read twice, sorted once (memory, then disk); one row a slice: what it adds, and how high it rises above its start
    slices = e.groupBy(*by, "_slice").agg(F.sum("pnl").alias("_add"), F.max("_sum").alias("_rise"))
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("_start", F.coalesce(F.sum("_add").over(before), F.lit(0.0)))
    slices = slices.select(*by, "_slice", "_start", F.max(F.col("_start") + F.col("_rise")).over(before).alias("_before"))
    e = e.join(slices, [*by, "_slice"]).withColumn("equity", F.col("_start") + F.col("_sum"))
    top = F.col("_start") + F.col("_in")
    return e.withColumn("peak", F.greatest(top, F.coalesce("_before", top))).drop("_slice", "_sum", "_in", "_start", "_before")


def max_drawdown(curve: DataFrame, by: Sequence[str]) -> DataFrame:
    dd = F.when(F.col("peak") > 0, (F.col("peak") - F.col("equity")) / F.col("peak")).otherwise(0.0)
    return curve.groupBy(*by).agg(F.max(dd).alias("max_drawdown"), F.sum("pnl").alias("total_pnl"))


# ---------------------------------------------------------------- operations

def latency_statistics(df: DataFrame, value: str, by: Sequence[str], order: Column, last: int = 100) -> DataFrame:
    """Mean, p95, p99 and max of the newest ``last`` values per key (element ``int(n*q)`` of the sorted ones)."""
    w = Window.partitionBy(*by).orderBy(order.desc())
    newest = df.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= last)
    a = newest.groupBy(*by).agg(F.sort_array(F.collect_list(value)).alias("_v"), F.avg(value).alias("avg"), F.max(value).alias("max"))
    n = F.size("_v")

    def pick(q):
        return F.get("_v", F.least(F.floor(n * q), n - 1).cast("int"))

    return a.select(*by, n.cast("bigint").alias("n"), "avg", pick(0.95).alias("p95"), pick(0.99).alias("p99"), "max")


def histogram(df: DataFrame, value: str, by: Sequence[str], bounds: Sequence[float]) -> DataFrame:
    """Rows at or below each bound (the first bound that holds), the rest as ``inf``."""
    b = F.lit(None).cast("double")
    for x in reversed(bounds):
        b = F.when(F.col(value) <= x, F.lit(float(x))).otherwise(b)
    return df.groupBy(*by, b.alias("le")).agg(F.count(F.lit(1)).alias("n"))


def daily_cost(df: DataFrame, tokens: str, day: Column, price_in: float, price_out: float, budget: float) -> DataFrame:
    """Token cost per day (a third in, two thirds out) with an over-budget flag."""
    d = df.groupBy(day.alias("day")).agg(F.sum(tokens).alias("tokens"))
    cost = F.col("tokens") / 3 / 1000 * price_in + F.col("tokens") * 2 / 3 / 1000 * price_out
    return d.select("day", "tokens", cost.alias("cost"), (cost > budget).alias("over_budget"))


def performance_table(df: DataFrame, row: Column, labels: dict[str, Sequence[str]], score: str, y: str, threshold: float) -> DataFrame:
    """Mean rolling IC and F1 per row key, one column of each for each value of each label."""
    hit, said = F.col(y) == 1, F.col(score) >= threshold
    cols = []
    for name, values in labels.items():
        for v in values:
            own = F.col(name) == v
            good, wrong = F.count_if(own & hit & said), F.count_if(own & (hit != said))
            cols += [F.avg(F.when(own, F.col("rolling_ic"))).alias(f"ic_{v}"), F.when(2 * good + wrong > 0, 2 * good / (2 * good + wrong)).alias(f"f1_{v}")]
    return df.groupBy(row.alias("period")).agg(*cols)
