"""As-of join: for every left row the nearest right row in time, per key.

Both sides are put in one frame and the last right value is carried forward, per key and
wall-clock block. A block starts with one carry row: the last right value of any earlier
block. No pair of rows is ever formed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(
    left: DataFrame,
    right: DataFrame,
    left_ts: str,
    right_ts: str,
    by: Sequence[str],
    cols: dict[str, str],
    direction: str = "backward",
    inclusive: bool = True,
    tie: str | None = None,
    block_seconds: int = 3600,
) -> DataFrame:
    """Add to ``left`` the columns ``cols`` (right name -> new name) of the as-of match.

    ``inclusive`` lets a right row with the very same time match. ``tie`` orders right rows
    of equal time (the last one wins backward, the first one forward).
    """
    sign = 1 if direction == "backward" else -1

    def micros(c: str):
        return F.unix_micros(F.col(c)) * F.lit(sign)

    names = left.columns
    row = F.struct(*[F.col(c) for c in names])
    val = F.struct(*[F.col(r).alias(n) for r, n in cols.items()])
    key = [F.col(c) for c in by]
    # At equal time a right row comes before the left row exactly when it may match.
    right_rank, left_rank = (0, 1) if inclusive else (1, 0)
    order = F.col(tie) if tie else F.lit(0)
    if tie and sign < 0:
        order = -F.col(tie)

    step = block_seconds * 1_000_000
    blk = F.floor(F.col("_t") / F.lit(step)).cast("bigint")
    lhs = left.select(*key, micros(left_ts).alias("_t"), F.lit(left_rank).alias("_k"), F.lit(0).cast("bigint").alias("_o"), row.alias("_row"))
    rhs = right.filter(F.col(right_ts).isNotNull()).select(
        *key, micros(right_ts).alias("_t"), F.lit(right_rank).alias("_k"), order.cast("bigint").alias("_o"), val.alias("_val")
    )
    lhs = lhs.withColumn("_b", blk)
    rhs = rhs.withColumn("_b", blk)

    last_of_block = rhs.groupBy(*by, "_b").agg(F.max_by("_val", F.struct("_t", "_o")).alias("_val"))
    wanted = lhs.select(*by, "_b").distinct()
    marks = wanted.withColumn("_w", F.lit(0)).unionByName(
        last_of_block.withColumn("_w", F.lit(1)), allowMissingColumns=True
    )
    w_marks = Window.partitionBy(*by).orderBy("_b", "_w").rowsBetween(Window.unboundedPreceding, 0)
    carry = (
        marks.withColumn("_val", F.last("_val", ignorenulls=True).over(w_marks))
        .filter((F.col("_w") == 0) & F.col("_val").isNotNull())
        .select(*by, (F.col("_b") * step).alias("_t"), F.lit(-1).alias("_k"), F.lit(0).cast("bigint").alias("_o"), "_val", "_b")
    )
    both = lhs.unionByName(rhs, allowMissingColumns=True).unionByName(carry, allowMissingColumns=True)
    w = Window.partitionBy(*by, "_b").orderBy("_t", "_k", "_o").rowsBetween(Window.unboundedPreceding, 0)
    hit = both.withColumn("_val", F.last("_val", ignorenulls=True).over(w)).filter(F.col("_row").isNotNull())
    return hit.select("_row.*", *[F.col("_val")[n].alias(n) for n in cols.values()])


def asof_each(
    left: DataFrame,
    right: DataFrame,
    left_ts: str,
    right_ts: str,
    by: Sequence[str],
    values: dict,
    block_seconds: int = 3600,
) -> DataFrame:
    """Backward, inclusive as-of match for several values at once, each carried forward on its own.

    ``values`` maps a new name to a column of ``right`` that is null where the row does not speak
    for it (say, one name per timeframe). One sort serves all of them."""
    names = left.columns
    step = block_seconds * 1_000_000
    blk = F.floor(F.col("_t") / F.lit(step)).cast("bigint")
    key = [F.col(c) for c in by]
    vals = list(values)
    row = F.struct(*[F.col(c) for c in names])
    lhs = left.select(*key, F.unix_micros(left_ts).alias("_t"), F.lit(1).alias("_k"), row.alias("_row")).withColumn("_b", blk)
    rhs = right.select(*key, F.unix_micros(right_ts).alias("_t"), F.lit(0).alias("_k"), *[c.alias("_v_" + n) for n, c in values.items()]).withColumn("_b", blk)
    tails = rhs.groupBy(*by, "_b").agg(*[F.max_by("_v_" + n, F.when(F.col("_v_" + n).isNotNull(), F.col("_t"))).alias("_v_" + n) for n in vals])
    marks = lhs.select(*by, "_b").distinct().withColumn("_w", F.lit(0)).unionByName(tails.withColumn("_w", F.lit(1)), allowMissingColumns=True)
    wm = Window.partitionBy(*by).orderBy("_b", "_w").rowsBetween(Window.unboundedPreceding, 0)
    carry = marks.select(*by, "_b", "_w", *[F.last("_v_" + n, ignorenulls=True).over(wm).alias("_v_" + n) for n in vals]).filter("_w = 0")
    carry = carry.select(*by, (F.col("_b") * step).alias("_t"), F.lit(-1).alias("_k"), "_b", *["_v_" + n for n in vals])
    both = lhs.unionByName(rhs, allowMissingColumns=True).unionByName(carry, allowMissingColumns=True)
    w = Window.partitionBy(*by, "_b").orderBy("_t", "_k").rowsBetween(Window.unboundedPreceding, 0)
    hit = both.select("_row", *[F.last("_v_" + n, ignorenulls=True).over(w).alias(n) for n in vals]).filter(F.col("_row").isNotNull())
    return hit.select("_row.*", *vals)
