"""State of all timeframes at a moment, from closed bars only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlake.operators.asof import asof_each
from marketlake.operators.indicators import atr_wilder
from marketlake.schemas import TIMEFRAMES


def closed_context(rows: DataFrame, bars: DataFrame, ts: str = "ts", tfs: Sequence[str] = tuple(TIMEFRAMES)) -> DataFrame:
    """Per row and timeframe the newest bar whose end is not after the row: close, bucket and ATR.

    A forming bar never shows: a bar speaks from ``bucket + length`` on."""
    secs = F.create_map(*[x for t in tfs for x in (F.lit(t), F.lit(TIMEFRAMES[t]).cast("bigint"))])
    b = atr_wilder(bars.filter(F.col("tf").isin(list(tfs))))
    b = b.withColumn("closed_at", F.timestamp_seconds(F.col("bucket") + secs[F.col("tf")]))
    state = F.struct("bucket", "open", "high", "low", "close", "volume", "atr")
    return asof_each(rows, b, ts, "closed_at", ["symbol"], {t: F.when(F.col("tf") == t, state) for t in tfs})


def as_maps(context: DataFrame, tfs: Sequence[str] = tuple(TIMEFRAMES)) -> DataFrame:
    """Timeframe columns folded into maps tf -> bar and tf -> ATR, plus the list of known timeframes."""
    known = F.filter(F.array(*[F.when(F.col(t).isNotNull(), F.lit(t)) for t in tfs]), lambda x: x.isNotNull())
    entries = F.filter(F.array(*[F.struct(F.lit(t).alias("key"), F.col(t).alias("value")) for t in tfs]), lambda e: e["value"].isNotNull())
    keep = [c for c in context.columns if c not in tfs]
    return context.select(*keep, F.map_from_entries(entries).alias("bars"), known.alias("locked_tfs")).withColumn(
        "atr", F.transform_values("bars", lambda _, v: v["atr"]))


def incomplete_penalty(df: DataFrame, total: int = len(TIMEFRAMES), step: float = 0.1) -> DataFrame:
    """Confidence multiplier lowered by a tenth per missing timeframe, and a flag."""
    missing = F.lit(total) - F.size("locked_tfs")
    return df.select("*", missing.alias("missing_tfs"), F.greatest(1.0 - step * missing, F.lit(0.0)).alias("confidence_multiplier"), (missing > 0).alias("incomplete_mtf"))
