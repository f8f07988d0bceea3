"""Column functions on predicted probabilities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dominant(p_bsl: Column, p_ssl: Column, p_lateral: Column) -> Column:
    """Most likely class; ties favour BSL, then SSL."""
    return (
        F.when((p_bsl >= p_ssl) & (p_bsl >= p_lateral), "BSL").when(p_ssl >= p_lateral, "SSL").otherwise("LATERAL")
    )


def qualifier(p: Column, regime: Column | None = None, high: float = 0.85, medium: float = 0.65) -> Column:
    """Confidence band of the largest probability; trending regimes lift MEDIUM to HIGH."""
    base = F.when(p >= high, "HIGH").when(p >= medium, "MEDIUM").otherwise("LOW")
    if regime is None:
        return base
    return F.when(regime.isin("TRENDING_LV", "TRENDING_HV") & (p >= medium), "HIGH").otherwise(base)


def decide(p: Column, theta: float = 0.71) -> Column:
    return p >= theta


def margin(p: Column, theta: float = 0.71) -> Column:
    return F.least(F.abs(p - theta) / max(theta, 1 - theta), F.lit(1.0))


def _normalise(*p: Column) -> list[Column]:
    total = sum(p[1:], p[0])
    return [F.when(total > 0, x / total).otherwise(x) for x in p]


def regime_adjust(p_bsl: Column, p_ssl: Column, p_lat: Column, regime: Column, bear: Column) -> list[Column]:
    """Quiet regimes move a fifth of the directional mass to lateral; strong bear evidence moves BSL to SSL."""
    quiet = regime.isin("NORMAL", "TRENDING_LV")
    way = p_bsl + p_ssl
    lat = F.when(quiet, F.least(p_lat + way * 0.2, F.lit(1.0))).otherwise(p_lat)
    grown = quiet & (lat > p_lat)
    scale = F.when(grown & (way > 0), (1 - lat) / way).otherwise(1.0)
    bsl, ssl = p_bsl * scale, p_ssl * scale
    shift = F.when(bear > 0.5, bsl * bear * 0.1).otherwise(0.0)
    return _normalise(F.greatest(bsl - shift, F.lit(0.0)), F.least(ssl + shift, F.lit(1.0)), lat)


def news_adjust(p_bsl: Column, p_ssl: Column, i_news: Column, to_news: Column, w_htf: Column, gamma0: float = 0.3, horizon: float = 900.0) -> list[Column]:
    """Directional mass shrinks as news comes near; then the session weight, then sum one.

    Farther than the horizon the factor is zero."""
    gamma = gamma0 * F.greatest(1 - F.greatest(to_news, F.lit(0.0)) / horizon, F.lit(0.0))
    bsl, ssl = p_bsl * (1 - gamma * i_news), p_ssl * (1 - gamma * i_news)
    return _normalise(bsl * w_htf, ssl * w_htf, 1 - bsl - ssl)


def rollback(version: str, quality: Column, p: Column, label: Column, momentum: Column, volatility: Column, regime: Column, hold: Column) -> Column:
    """Should the prediction be overridden to LATERAL?"""
    low = quality == "LOW"
    if version == "standard":
        return low
    if version == "aggressive":
        return low | ((regime == "CHOPPY_HV") & (quality == "MEDIUM")) | ((label == "BSL") & (momentum < -0.5)) | ((label == "SSL") & (momentum > 0.5))
    if version == "conservative":
        return low & ((p < 0.5) | (hold == 0) | ((regime == "CHOPPY_HV") & (volatility > 2.0)))
    raise ValueError(f"unknown version {version}")


# Signal weights, regime tilt, and score steps of the rating -4..4.
RULE_WEIGHTS = {"edge": 0.30, "side": 0.15, "zones": 0.10, "macro": 0.05}
REGIME_TILT = {"BULLISH": 0.5, "BULL": 0.5, "BEARISH": -0.5, "BEAR": -0.5, "TRENDING_UP": 0.3, "TRENDING_DOWN": -0.3}


def rule_score(p_bsl: Column, p_ssl: Column, price: Column, equilibrium: Column, bull_zones: Column, bear_zones: Column, regime: Column, surprise: Column) -> Column:
    """Weighted signals in [-1, 1]; every part is rounded to four digits before the sum."""
    w = RULE_WEIGHTS
    one = F.lit(1.0)
    edge = F.least(F.greatest((p_bsl - p_ssl) * 2, -one), one) * w["edge"]
    away = (price - equilibrium) / equilibrium * 100
    side = F.when((price > 0) & (equilibrium > 0), -F.signum(away) * F.least(F.abs(away) / 5, one) * w["side"]).otherwise(0.0)
    zones = F.least(bull_zones * 0.3, one) * w["zones"] - F.least(bear_zones * 0.3, one) * w["zones"]
    tilt = F.create_map(*[x for k, v in REGIME_TILT.items() for x in (F.lit(k), F.lit(v))])
    macro = F.coalesce(tilt[F.upper(regime)], F.lit(0.0)) * w["macro"]
    news = F.when(surprise == "POSITIVE", 0.1).when(surprise == "NEGATIVE", -0.1).otherwise(0.0) * w["macro"]
    total = sum((F.floor(x * 10000 + 0.5) / 10000 for x in (side, zones, macro, news)), F.floor(edge * 10000 + 0.5) / 10000)
    return F.greatest(F.least(total, one), -one)


def rating(score: Column) -> Column:
    up = F.when(score >= 0.8, 4).when(score >= 0.6, 3).when(score >= 0.4, 2).when(score >= 0.15, 1)
    return up.when(score > -0.15, 0).when(score >= -0.4, -1).when(score >= -0.6, -2).when(score >= -0.8, -3).otherwise(-4)


def rating_direction(rate: Column) -> Column:
    return F.when(rate >= 2, "BULL").when(rate <= -2, "BEAR").otherwise("NEUTRAL")


def consensus(bull_rating: Column, bull_conf: Column, bear_rating: Column, bear_conf: Column, guard: Column) -> dict[str, Column]:
    """Heavier side wins; agreement falls with the gap of the weights."""
    a, b = bull_rating * bull_conf, bear_rating * bear_conf
    rate = F.when(a > b, F.least(bull_rating, F.lit(4))).when(b > a, F.greatest(-bear_rating, F.lit(-4))).otherwise(0)
    agree = 1 - F.abs(a - b) / F.greatest(a, b, F.lit(0.01))
    return {
        "rating": rate,
        "direction": F.when(a > b, "BULL").when(b > a, "BEAR").otherwise("NEUTRAL"),
        "agreement": F.least(F.greatest(agree, F.lit(0.0)), F.lit(1.0)),
        "confidence": F.when(guard, "LOW").when(F.abs(rate) >= 2, "MEDIUM").otherwise("LOW"),
    }


# Fallback probability triples by higher-timeframe bias.
FALLBACK = {"BULLISH": (0.60, 0.25, 0.15), "BEARISH": (0.25, 0.60, 0.15), "NEUTRAL": (0.35, 0.35, 0.30)}


def fallback_probability(bias: Column, which: int) -> Column:
    m = F.create_map(*[x for k, v in FALLBACK.items() for x in (F.lit(k), F.lit(v[which]))])
    return m[bias]


def degraded_confidence(conf: Column, degraded: Column) -> Column:
    return F.when(degraded, conf * 0.6).otherwise(conf)


# Deploy gate and status bands (good, degraded); the last flag says larger is better.
GATE = {"ic": (0.05, True), "brier": (0.25, False), "ece": (0.05, False)}
BANDS = {"ic": (0.10, 0.05, True), "brier": (0.20, 0.28, False), "ece": (0.05, 0.08, False), "f1": (0.65, 0.50, True), "fds": (0.20, 0.40, False)}


def gate_reasons(metrics: dict[str, Column]) -> Column:
    """Names of the metrics that keep a model from being deployed."""
    out = []
    for name, (limit, larger) in GATE.items():
        bad = metrics[name] < limit if larger else metrics[name] > limit
        out.append(F.when(bad, F.lit(name)))
    return F.array_compact(F.array(*out))


def status(metric: str, value: Column) -> Column:
    good, bad, larger = BANDS[metric]
    if larger:
        return F.when(value >= good, "good").when(value >= bad, "warning").otherwise("degraded")
    return F.when(value <= good, "good").when(value <= bad, "warning").otherwise("degraded")


def should_fine_tune(degraded: Column, rows: Column, least: int = 200) -> Column:
    return degraded & (rows >= least)


def should_deploy(new_ic: Column, old_ic: Column, gain: float = 1.1, floor: float = 0.01) -> Column:
    return F.when(old_ic == 0, new_ic > floor).otherwise(new_ic > gain * old_ic)


def should_roll_back(new_ic: Column, old_ic: Column, gain: float = 1.1, slack: float = 0.1) -> Column:
    return new_ic <= old_ic * (gain - slack)
