"""Population stability and feature drift."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlake.operators.ranks import exact_quantiles


def _long(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in cols])).alias("r")).select("r.*")


def psi(ref: DataFrame, cur: DataFrame, cols: Sequence[str], buckets: int = 10, eps: float = 1e-10) -> DataFrame:
    """Stability index per feature. Edges are the distinct quantiles of the first set; the last bin is
    closed on the right; current values outside the edges count only in the denominator."""
    probs = [i / buckets for i in range(buckets + 1)]
    r, c = _long(ref, cols), _long(cur, cols)
    edges = exact_quantiles(r, "v", ["feature"], probs).select("feature", F.array_distinct("quantiles").alias("edges")).persist()

    # bins as rows: sorted edges in pairs, and the last edge, which belongs to the last bin. As few as the edges.
    last = F.element_at("edges", -1)
    ends = F.transform(F.sort_array("edges"), lambda e, i: F.struct(i.alias("bin"), e.alias("lo"), F.get(F.sort_array("edges"), i + 1).alias("hi")))
    ends = F.when(F.size("edges") > 1, F.slice(ends, 1, F.size("edges") - 1)).otherwise(F.slice(ends, 1, 0))
    ends = F.concat(ends, F.array(F.struct((F.size("edges") - 2).alias("bin"), last.alias("lo"), F.lit(None).cast("double").alias("hi"))))
    bins = edges.select("feature", last.alias("_last"), F.explode(ends).alias("_e")).select("feature", "_last", "_e.*").persist()

    def counted(d: DataFrame, name: str) -> DataFrame:
        v, end = F.col("d.v"), F.col("e._last")
        inside = F.when(v == end, F.col("e.hi").isNull()).otherwise((F.col("e.lo") <= v) & (v < F.col("e.hi")))
        d = d.alias("d").join(F.broadcast(bins.alias("e")), (F.col("d.feature") == F.col("e.feature")) & inside, "left")
        n = d.groupBy("d.feature", "e.bin").agg(F.count(F.lit(1)).alias(name))
        return n.join(F.broadcast(edges.select("feature")), "feature", "left_semi")

    b = counted(r, "nr").join(counted(c, "nc"), ["feature", "bin"], "full")
    w = Window.partitionBy("feature")  # at most buckets + 1 rows each
    b = b.select("feature", "bin", "nr", "nc", F.sum("nr").over(w).alias("_r"), F.sum("nc").over(w).alias("_c")).filter(F.col("bin").isNotNull())
    # A null bin equals no other, so outsiders of both sides stay apart and are dropped after the totals.
    p = F.greatest(F.coalesce(F.col("nr"), F.lit(0)) / F.col("_r"), F.lit(eps))
    q = F.greatest(F.coalesce(F.col("nc"), F.lit(0)) / F.col("_c"), F.lit(eps))
    return b.groupBy("feature").agg(F.sum((q - p) * F.log(q / p)).alias("psi"), F.count(F.lit(1)).alias("bins"))


def band(psi_):
    return F.when(psi_ < 0.1, "LOW").when(psi_ < 0.25, "MODERATE").otherwise("HIGH")


def drift_report(scores: DataFrame, top: int = 5, degraded_above: float = 0.4, share_at: float = 0.2) -> DataFrame:
    """Mean score, share of drifted features, counts per band, the top features and a degraded flag."""
    s = scores.withColumn("band", band(F.col("psi")))
    ranked = F.slice(F.transform(F.sort_array(F.collect_list(F.struct(-F.col("psi"), F.col("feature")))), lambda x: x["feature"]), 1, top)
    return s.agg(F.avg("psi").alias("drift_score"), F.avg((F.col("psi") >= share_at).cast("double")).alias("drifted_share"),
                 *[F.count_if(F.col("band") == b).alias(b.lower()) for b in ("LOW", "MODERATE", "HIGH")],
                 ranked.alias("top_features"), (F.avg("psi") > degraded_above).alias("degraded"))
