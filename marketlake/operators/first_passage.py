"""First later bar whose value crosses a level.

Bars are folded into rows of 64 values, those into rows of 64 block extremes, and those into
one short row per key. A level looks into the rest of its own block, then up to the extremes of
the following blocks, then down again: five equi-joins of one row each. No level meets more than
one row per join, so a hot symbol only means more rows of equal weight.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlake.operators.blocks import KEY, div

FAN = 64


def _ordered(df: DataFrame, keys: Sequence[str], no: str, value: str, out: str) -> DataFrame:
    packed = F.sort_array(F.collect_list(F.struct(F.col(no), F.col(value))))
    return df.groupBy(*keys).agg(F.transform(packed, lambda x: x[value]).alias(out))


def _first_at(arr: str, offset: Column, strict: bool, most: int = FAN) -> Column:
    """0-based position of the first crossing among ``most`` values from ``offset`` on, else null."""
    rest = F.slice(F.col(arr), (offset + 1).cast("int"), F.lit(most))
    cross = F.transform(rest, lambda v: (v > F.col("_lvl")) if strict else (v >= F.col("_lvl")))
    pos = F.array_position(cross, F.lit(True))
    return F.when(pos > 0, pos - 1 + offset)


def first_passage(
    levels: DataFrame,
    bars: DataFrame,
    level: Column,
    value: Column,
    start: Column,
    above: bool | Column = True,
    strict: bool = True,
    within: int | None = None,
    out: str = "hit_no",
    by: Sequence[str] = KEY,
) -> DataFrame:
    """Add ``out``: the smallest ``bar_no >= start`` with ``value`` beyond ``level``.

    ``above`` False looks for values below. A null ``value`` never matches. ``within`` bounds
    the search to that many bars from ``start``.
    """
    sign = F.lit(1.0 if above else -1.0)
    base = bars.select(*by, "bar_no", F.coalesce(value * sign, F.lit(float("-inf"))).alias("_v"))
    b1k = [*by, "_b1"]
    blocks = _ordered(base.withColumn("_b1", div("bar_no", FAN)), b1k, "bar_no", "_v", "_a1")
    tops = base.withColumn("_b1", div("bar_no", FAN)).groupBy(*b1k).agg(F.max("_v").alias("_v"))
    tops = tops.withColumn("_b2", div("_b1", FAN))
    supers = _ordered(tops, [*by, "_b2"], "_b1", "_v", "_a2")
    heads = supers.select(*by, "_b2", F.array_max("_a2").alias("_v"))
    roots = _ordered(heads, list(by), "_b2", "_v", "_a3")

    # A settled row gets a spread-out negative key: it joins nothing and loads no single task.
    def spread() -> Column:
        return -1 - F.pmod(F.xxhash64("_s", "_lvl"), F.lit(100_003))

    n_cols = levels.columns
    q = levels.withColumn("_s", F.greatest(start, F.lit(0)).cast("bigint")).withColumn("_lvl", (level * sign).cast("double"))
    q = q.withColumn("_b1", F.coalesce(div("_s", FAN), spread()))

    most = min(within or FAN, FAN)
    q = q.join(blocks, b1k, "left").withColumn("_h", _first_at("_a1", F.pmod("_s", F.lit(FAN)), strict, most)).drop("_a1")
    q = q.withColumn("_hit", F.col("_b1") * FAN + F.col("_h")).drop("_h")
    if within is not None and within <= FAN:
        # A short search ends in its own block or the next one.
        more = F.col("_hit").isNull() & (F.pmod("_s", F.lit(FAN)) + within > FAN)
        q = q.withColumn("_b1", F.when(more, F.col("_b1") + 1).otherwise(spread()))
        q = q.join(blocks, b1k, "left").withColumn("_h", _first_at("_a1", F.lit(0), strict, most))
        hit = F.coalesce("_hit", F.col("_b1") * FAN + F.col("_h"))
        return q.select(*n_cols, F.when(hit < F.col("_s") + within, hit).cast("bigint").alias(out))
    done = F.col("_hit").isNotNull() | F.col("_lvl").isNull() | F.col("_s").isNull()
    if within is not None:
        done = done | ((F.col("_b1") + 1) * FAN >= F.col("_s") + within)

    q = q.withColumn("_own2", div("_b1", FAN)).withColumn("_b2", F.when(done, spread()).otherwise(F.col("_own2")))
    q = q.withColumnRenamed("_b1", "_own1")
    q = q.join(supers, [*by, "_b2"], "left").withColumn("_h", _first_at("_a2", F.pmod("_own1", F.lit(FAN)) + 1, strict))
    q = q.withColumn("_to1", F.col("_b2") * FAN + F.col("_h")).drop("_a2", "_h", "_b2")
    if within is None or within > FAN * FAN:
        q = q.withColumn("_top", F.when(F.col("_hit").isNull() & F.col("_to1").isNull(), F.lit(0).cast("bigint")).otherwise(spread()))
        q = q.join(roots.withColumn("_top", F.lit(0).cast("bigint")), [*by, "_top"], "left")
        q = q.withColumn("_h", _first_at("_a3", F.col("_own2") + 1, strict, 1 << 30)).drop("_a3", "_top")
        q = q.withColumn("_b2", F.coalesce("_h", spread()))
        q = q.join(supers, [*by, "_b2"], "left").withColumn("_h2", _first_at("_a2", F.lit(0), strict))
        q = q.withColumn("_to1", F.coalesce("_to1", F.col("_b2") * FAN + F.col("_h2"))).drop("_a2", "_h", "_h2", "_b2")
    else:
        # A bounded search leaves its super-block at most once.
        q = q.withColumn("_b2", F.when(F.col("_hit").isNull() & F.col("_to1").isNull(), F.col("_own2") + 1).otherwise(spread()))
        q = q.join(supers, [*by, "_b2"], "left").withColumn("_h2", _first_at("_a2", F.lit(0), strict))
        q = q.withColumn("_to1", F.coalesce("_to1", F.col("_b2") * FAN + F.col("_h2"))).drop("_a2", "_h2", "_b2")
    q = q.withColumn("_b1", F.coalesce("_to1", spread()))
    q = q.join(blocks, b1k, "left").withColumn("_h", _first_at("_a1", F.lit(0), strict))
    hit = F.coalesce("_hit", F.col("_b1") * FAN + F.col("_h"))
    if within is not None:
        hit = F.when(hit < F.col("_s") + within, hit)
    return q.select(*n_cols, hit.cast("bigint").alias(out))


def crossing(
    levels: DataFrame,
    bars: DataFrame,
    up: Column,
    level: Column,
    up_value: Column,
    down_value: Column,
    start: Column,
    strict: bool = True,
    within: int | None = None,
    out: str = "hit_no",
    by: Sequence[str] = KEY,
) -> DataFrame:
    """``first_passage`` for levels of both directions in one pass.

    Rows with ``up`` wait for ``up_value`` above the level, the others for ``down_value`` below it.
    Downward work is the upward work with both sides negated."""
    both = F.explode(F.array(F.struct(F.lit(True).alias("up"), up_value.alias("v")), F.struct(F.lit(False).alias("up"), (-down_value).alias("v"))))
    stacked = bars.select(*by, "bar_no", both.alias("_u")).select(*by, "bar_no", F.col("_u.up").alias("_up"), F.col("_u.v").alias("_val"))
    signed = levels.withColumn("_up", up).withColumn("_level", F.when(up, level).otherwise(-level))
    hit = first_passage(signed, stacked, F.col("_level"), F.col("_val"), start, True, strict, within, out, [*by, "_up"])
    return hit.drop("_up", "_level")
