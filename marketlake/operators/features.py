"""Fixed-length feature vectors, built as array columns at the newest bar of each key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlake.operators import flow as L
from marketlake.operators import indicators as I
from marketlake.operators import structure as S
from marketlake.operators.blocks import KEY

# Vector lengths and codes.
SIZES = {"z": 512, "liq": 24, "flow": 20, "macro": 12, "struct": 64, "agg": 16, "zone": 16, "contact": 20}
TF_CODE = {"M1": 1 / 6, "M5": 2 / 6, "M15": 3 / 6, "H1": 4 / 6, "H4": 5 / 6, "D1": 1.0}
TYPE_CODE = {"FVG": 0.0, "OB": 0.33, "EQ": 0.67, "iFVG": 1.0}
MITIGATION_CODE = {"UNMITIGATED": 0.0, "WICK_TOUCHED": 0.2, "WICK_FILLED": 0.4, "BODY_FILLED": 0.6, "WICK_FILLED_HALF": 0.8, "BODY_FILLED_HALF": 1.0}
TIER_CAP = 10.0


def fit_length(v: Column, n: int) -> Column:
    """Pad with zeros or cut to ``n``; nulls become 0."""
    clean = F.transform(F.coalesce(v, F.array().cast("array<double>")), lambda x: F.coalesce(x.cast("double"), F.lit(0.0)))
    return F.slice(F.concat(clean, F.array_repeat(F.lit(0.0), n)), 1, n)


def _vec(values: Sequence[Column], n: int) -> Column:
    return fit_length(F.array(*[v.cast("double") for v in values]), n)


def _code(table: dict, key: Column, default: float) -> Column:
    m = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[key], F.lit(default))


def f_liq(claimed: DataFrame, bars: DataFrame, cvd: DataFrame | None = None) -> DataFrame:
    """24 values: distance and age of the nearest untaken high and low per tier, delta gathered around
    the IT and LT ones, scaled counts, and the share taken of the newest fifty IT and LT pivots."""
    near = S.nearest_levels(claimed, bars)
    ratio = S.claimed_ratio(claimed).select(*KEY, "term", "claimed_recent")
    g = near if cvd is None else near.join(cvd, [*KEY, "is_high", "term"], "left")
    acc = F.coalesce(F.col("v_acc"), F.lit(0.0)) if cvd is not None else F.lit(0.0)

    def at(value: Column, term: str, high: bool, default: float) -> Column:
        return F.coalesce(F.max(F.when((F.col("term") == term) & (F.col("is_high") == high), value)), F.lit(default))

    tiers = ("ST", "IT", "LT")
    vals = [at(F.col("distance_atr"), t, h, 0.0) for h in (True, False) for t in tiers]
    vals += [at(F.col("minutes_since"), t, h, 200.0) for h in (True, False) for t in tiers]
    vals += [at(acc, t, h, 0.0) for h in (True, False) for t in tiers[1:]]
    vals += [at(F.col("unclaimed") / (TIER_CAP + 1e-9), t, h, 0.0) for h in (True, False) for t in tiers]
    base = g.groupBy(*KEY).agg(F.array(*vals).alias("_v"))
    taken = ratio.groupBy(*KEY).agg(*[F.coalesce(F.max(F.when(F.col("term") == t, F.col("claimed_recent"))), F.lit(0.0)).alias("_" + t) for t in tiers[1:]])
    return base.join(taken, list(KEY)).select(*KEY, fit_length(F.concat("_v", F.array("_IT", "_LT")), SIZES["liq"]).alias("f_liq"))


COUNTS = ("mss_bull", "mss_bear", "bos_bull", "bos_bear", "fvg_bull", "fvg_bear", "fvg_mitigated", "ifvg_active", "ob_bull", "ob_bear",
          "eq_high", "eq_low", "eq_claimed", "eq_unclaimed", "premium_zones", "discount_zones")


def symbolic_counts(pivots: DataFrame, zones: DataFrame, levels: DataFrame, blocks: DataFrame, bars: DataFrame) -> DataFrame:
    """Event, zone and level counts per key, with price against equilibrium and mean displacement."""
    m = S.mss(pivots, bars).groupBy(*KEY).agg(F.count_if("is_high").alias("mss_bull"), F.count_if(~F.col("is_high")).alias("mss_bear"))
    b = S.bos(pivots, bars).groupBy(*KEY).agg(F.count_if("is_high").alias("bos_bull"), F.count_if(~F.col("is_high")).alias("bos_bear"))
    live, fvg = F.col("mitigated_bar_no").isNull(), F.col("kind") == "FVG"
    z = zones.groupBy(*KEY).agg(
        F.count_if(fvg & live & F.col("is_bullish")).alias("fvg_bull"), F.count_if(fvg & live & ~F.col("is_bullish")).alias("fvg_bear"),
        F.count_if(fvg & ~live).alias("fvg_mitigated"), F.count_if((F.col("kind") == "iFVG") & live).alias("ifvg_active"),
        F.count_if(live & (F.col("zone") == "premium")).alias("premium_zones"), F.count_if(live & (F.col("zone") == "discount")).alias("discount_zones"))
    o = blocks.groupBy(*KEY).agg(F.count_if("is_bullish").alias("ob_bull"), F.count_if(~F.col("is_bullish")).alias("ob_bear"))
    e = levels.groupBy(*KEY).agg(F.count_if("is_high").alias("eq_high"), F.count_if(~F.col("is_high")).alias("eq_low"),
                                 F.count("claimed_bar_no").alias("eq_claimed"), F.count_if(F.col("claimed_bar_no").isNull()).alias("eq_unclaimed"))
    d = S.displacement(bars, require_gap=False).groupBy(*KEY).agg(F.avg("d_strength").alias("d_strength_mean"))
    eq = S.equilibrium(pivots).select(*KEY, "equilibrium")
    out = S.last_close(bars)
    for part in (m, b, z, o, e, d, eq):
        out = out.join(part, list(KEY), "left")
    return out.fillna(0, list(COUNTS))


def f_struct(c: DataFrame) -> Column:
    """64 values after the 24 of ``f_liq``: structure events, gap and block counts, equal levels."""
    def n(x):
        return F.col(x).cast("double")

    zero, half = F.lit(0.0), F.lit(0.5)
    score = 2 * n("mss_bull") + 2 * n("mss_bear") + n("bos_bull") + n("bos_bear")
    dist = F.when(F.col("equilibrium") > 0, (F.col("price_now") - F.col("equilibrium")) / (F.col("equilibrium") + 1e-9)).otherwise(0.0)
    one = F.lit(1.0)
    events = [n("mss_bull"), n("mss_bear"), n("bos_bull"), n("bos_bear"), score, zero, zero, zero, zero, zero, dist,
              (dist > 0).cast("double"), (dist < 0).cast("double"), score / F.greatest(n("mss_bull") + n("mss_bear"), one), score / F.greatest(n("bos_bull") + n("bos_bear"), one), zero]
    w = F.when(F.col("premium_zones") > F.col("discount_zones"), 1.5).otherwise(1.0)
    gaps = [n("fvg_bull"), n("fvg_bear"), zero, zero, zero, half, n("ob_bull"), n("ob_bear"), zero, half, n("ifvg_active"),
            n("fvg_mitigated") / (n("fvg_bull") + n("fvg_bear") + n("fvg_mitigated") + 1), F.coalesce("d_strength_mean", zero), w, w, zero]
    total = n("eq_high") + n("eq_low") + 1
    equal = [n("eq_high"), n("eq_low"), zero, zero, zero, zero, n("eq_claimed") / total, n("eq_unclaimed") / total]
    return F.concat(fit_length(F.col("f_liq"), SIZES["liq"]), _vec(events, 16), _vec(gaps, 16), _vec(equal, 8))


def f_agg(c: DataFrame) -> Column:
    def n(x):
        return F.col(x).cast("double")

    zero = F.lit(0.0)
    vals = [n("fvg_bull") + n("fvg_bear") + n("ob_bull") + n("ob_bear"), 2 * n("mss_bull") + n("bos_bull") - 2 * n("mss_bear") - n("bos_bear"), F.coalesce("d_strength_mean", zero), zero, zero,
            n("premium_zones") - n("discount_zones"), F.lit(1.0), F.lit(1.0), F.lit(1.0), zero, zero, n("eq_claimed") / (n("eq_high") + n("eq_low") + 1), n("mss_bull") + n("mss_bear"), n("ob_bull") + n("ob_bear"), zero]
    return _vec(vals, SIZES["agg"])


def session_weighted(v: Column, w_ltf: Column) -> Column:
    """Low-timeframe session weight on the two hold slots."""
    return F.transform(v, lambda x, i: F.when(i.isin(45, 49), x * w_ltf).otherwise(x))


def f_flow(stats: DataFrame) -> DataFrame:
    """20 values per bar from order-flow statistics."""
    body = F.col("close") - F.col("open")
    names = ("cvd_slope5", "cvd_slope10", "cvd_slope20", "cvd_std10", "cvd_z", "iii_slope5", "iii_slope10", "iii_mean20", "iii_std20", "iii_z", "obi", "obi_slope5", "obi_mean20", "obi_std20", "spread", "spread_z")
    vals = [F.when(F.col("volume") > 0, F.col("cvd") / F.col("volume")).otherwise(0.0), F.col("iii"), F.signum(body) * F.signum("cvd"), *[F.col(c) for c in names]]
    return stats.select(*KEY, "bar_no", _vec(vals, SIZES["flow"]).alias("f_flow"))


def f_macro(i_news: Column, surprise: Column, to_next: Column, guard: Column, session: Column, state: Column, cluster: Column, impact_code: Column) -> Column:
    asian, london = session == "ASIAN", session.isin("LONDON", "LONDON_OPEN_KZ")
    flags = [guard, asian, london, state == "PRE_NEWS", state == "NEWS_WINDOW", cluster]
    f = [x.cast("double") for x in flags]
    return _vec([i_news, surprise, F.least(to_next / 3600, F.lit(1.0)), *f, impact_code], SIZES["macro"])


def f_zone(age: Column, tf: Column, touch: Column, status: Column, strength: Column, iii: Column, price: Column, atr: Column) -> Column:
    """16 values of one zone row (``top``, ``bottom``, ``middle``, ``kind``, ``p_hold``, ``w_zone``, ``zone``)."""
    def per(x):
        return F.when(atr != 0, x / atr).otherwise(0.0)

    side = F.when(F.col("zone") == "premium", 1.0).when(F.col("zone") == "discount", 0.0).otherwise(0.5)
    return _vec([per(F.col("top") - F.col("bottom")), age, _code(TF_CODE, tf, 1 / 6), _code(TYPE_CODE, F.col("kind"), 0.0), F.least(F.greatest("p_hold", F.lit(0.0)), F.lit(1.0)), touch,
                 _code(MITIGATION_CODE, status, 0.0), strength, side, F.col("w_zone"), iii, per(F.abs(F.col("middle") - price))], SIZES["zone"])


def f_contact(atr: Column, cvd: Column, slope5: Column, slope10: Column, iii: Column, std: Column, v_avg: Column, spread: Column) -> Column:
    """20 values of the bar that touches a zone (bar columns next to ``top``, ``bottom``, ``middle``)."""
    span = F.col("top") - F.col("bottom")

    def over(a, b):
        return F.when(b != 0, a / b).otherwise(0.0)

    body = F.abs(F.col("open") - F.col("close"))
    return _vec([over(F.col("close") - F.col("middle"), span / 2), over(body, atr), cvd, slope5 - slope10, iii, over(body, std * 100), over(F.col("volume"), v_avg), spread, over(F.col("close") - F.col("bottom"), span)], SIZES["contact"])


def assemble(kind: str, z: Column, **parts: Column) -> Column:
    """X_A (648) = z, liq, flow, macro, struct, agg; X_B (560) = z, zone, contact, macro."""
    names = {"A": ("liq", "flow", "macro", "struct", "agg"), "B": ("zone", "contact", "macro")}[kind]
    return F.concat(fit_length(z, SIZES["z"]), *[fit_length(parts[n], SIZES[n]) for n in names])


def flow_vectors(flow_bars: DataFrame) -> DataFrame:
    return f_flow(L.flow_stats(flow_bars))


def contact_inputs(bars: DataFrame) -> DataFrame:
    """ATR, body deviation and mean volume of every bar, for contact vectors."""
    from marketlake.operators.blocks import over_blocks

    b = S.body_deviation(I.atr_wilder(bars))
    return over_blocks(b, 20, lambda df, w: df.withColumn("v_avg20", F.avg("volume").over(w.rowsBetween(-19, 0))))
