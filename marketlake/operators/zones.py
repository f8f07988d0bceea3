"""Zones against later bars: touches, accumulation, holding, ranking."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlake.operators.blocks import KEY, div
from marketlake.operators.first_passage import FAN, crossing
from marketlake.operators.structure import last_close, price_side

ZONE_KEY = (*KEY, "kind", "imb_no")


def registry(imbalances: DataFrame, equilibrium: DataFrame, p_hold: Column | None = None) -> DataFrame:
    """Zones of every kind in one shape; premium zones weigh 1.5."""
    z = imbalances.join(equilibrium.select(*KEY, "equilibrium"), list(KEY))
    z = z.withColumn("zone", price_side(F.col("middle"), F.col("equilibrium")))
    family = F.when(F.col("kind") == "iFVG", "VI").otherwise(F.col("kind"))
    hold = F.when(F.col("kind") == "iFVG", 0.3).otherwise(0.5) if p_hold is None else p_hold
    return z.select(
        *ZONE_KEY, "is_bullish", "open_bar_no", "close_bar_no", "top", "bottom", "middle", "near", "far", "zone",
        F.concat_ws("_", family, F.when(F.col("is_bullish"), "BULL").otherwise("BEAR")).alias("zone_type"),
        hold.alias("p_hold"), F.when(F.col("zone") == "premium", 1.5).otherwise(1.0).alias("w_zone"))


def contains(price: Column, top: Column, bottom: Column) -> Column:
    return (price >= bottom) & (price <= top)


def zone_bars(zones: DataFrame, bars: DataFrame, keep: Callable[[Column], Column], cols: Sequence[str], key: Sequence[str] = ZONE_KEY, until: Column | None = None) -> DataFrame:
    """Later bars that satisfy ``keep`` for a zone.

    A zone first meets one row per 4,096 later bars, goes on only where their price range touches it,
    and finds in that row the 64-bar blocks whose range touches it too; then it meets each block's bars
    as one array. ``until`` is the last bar to look at."""
    blk = div("bar_no", FAN)
    names = list(dict.fromkeys(["bar_no", "high", "low", "close", *cols]))
    rows = bars.groupBy(*KEY, blk.alias("_b")).agg(F.collect_list(F.struct(*names)).alias("_bars"), F.max("high").alias("_hi"), F.min("low").alias("_lo"))
    ends = bars.groupBy(*KEY).agg(F.max("bar_no").alias("_end"))
    stop = F.col("_end") if until is None else F.least(F.coalesce(until, F.col("_end")), F.col("_end"))
    z = zones.join(ends, list(KEY)).withColumn("_stop", stop).filter(F.col("_stop") > F.col("close_bar_no"))
    heads = rows.groupBy(*KEY, div("_b", FAN).alias("_s")).agg(F.collect_list(F.struct("_b", "_hi", "_lo")).alias("_blocks"), F.max("_hi").alias("_hi"), F.min("_lo").alias("_lo"))
    first = div(F.col("close_bar_no") + 1, FAN)
    z = z.withColumn("_s", F.explode(F.sequence(div(first, FAN), div("_stop", FAN * FAN))))
    z = z.join(heads, [*KEY, "_s"]).filter((F.col("_hi") >= F.col("bottom")) & (F.col("_lo") <= F.col("top")))
    near = F.filter("_blocks", lambda x: (x["_hi"] >= F.col("bottom")) & (x["_lo"] <= F.col("top")) & (x["_b"] >= first) & (x["_b"] <= div("_stop", FAN)))
    z = z.withColumn("_b", F.explode(F.transform(near, lambda x: x["_b"])))
    z = z.drop("_hi", "_lo", "_s", "_blocks").join(rows.select(*KEY, "_b", "_bars"), [*KEY, "_b"])
    late = F.filter("_bars", lambda x: (x["bar_no"] > F.col("close_bar_no")) & (x["bar_no"] <= F.col("_stop")) & keep(x))
    extra = [c for c in zones.columns if c not in key]
    return z.select(*key, *extra, F.explode(late).alias("_x")).select(*key, *extra, *[F.col("_x")[c].alias(c) for c in dict.fromkeys(["bar_no", *cols])])


def zone_totals(zones: DataFrame, bars: DataFrame, low: str, high: str, value: str | None = None, key: Sequence[str] = ZONE_KEY, early: int = 3) -> DataFrame:
    """Number of later bars whose range [``low``, ``high``] meets a zone, their sum of ``value``, the first and
    last of them, and the ``early`` first ones in order; only zones that some bar meets.

    A tree over the bars carries for every 64 and 4,096 of them the number, the sum and the extremes of both
    ends. Where all bars of a node meet the zone its totals are added; where none does it is left out; only
    nodes at the edge of the zone's prices, or of its time, are opened, the bars within their array."""
    lo, hi, v = F.col(low), F.col(high), F.col(value) if value else F.lit(0.0)
    own = F.struct("bar_no", lo.alias("lo"), hi.alias("hi"), v.cast("double").alias("v"))
    stats = [F.count(F.lit(1)).alias("n"), F.sum("v").alias("v"), F.min("lo").alias("lo"), F.max("lo").alias("top_lo"), F.max("hi").alias("hi"), F.min("hi").alias("low_hi"), F.min("bar_no").alias("a"), F.max("bar_no").alias("b")]
    above = [F.sum("n").alias("n"), F.sum("v").alias("v"), F.min("lo").alias("lo"), F.max("top_lo").alias("top_lo"), F.max("hi").alias("hi"), F.min("low_hi").alias("low_hi"), F.min("a").alias("a"), F.max("b").alias("b")]
    names = ["n", "v", "lo", "top_lo", "hi", "low_hi", "a", "b"]
    rows = bars.select(*KEY, div("bar_no", FAN).alias("_b"), own.alias("x")).select(*KEY, "_b", "x", "x.*").groupBy(*KEY, "_b").agg(F.collect_list("x").alias("_bars"), *stats)
    heads = rows.withColumn("_s", div("_b", FAN)).groupBy(*KEY, "_s").agg(F.collect_list(F.struct("_b", *names)).alias("_blocks"), *above)
    ends = bars.groupBy(*KEY).agg(F.max("bar_no").alias("_end"))
    z = zones.select(*key, "close_bar_no", "top", "bottom").join(ends, list(KEY)).filter(F.col("_end") > F.col("close_bar_no"))
    z = z.withColumn("_s", F.explode(F.sequence(div(F.col("close_bar_no") + 1, FAN * FAN), div("_end", FAN * FAN))))

    def some(x):  # a node, a row or a struct: may some bar of it meet the zone
        return (x["hi"] >= F.col("bottom")) & (x["lo"] <= F.col("top")) & (x["b"] > F.col("close_bar_no"))

    def every(x):
        return (x["low_hi"] >= F.col("bottom")) & (x["top_lo"] <= F.col("top")) & (x["a"] > F.col("close_bar_no"))

    def begin(x):  # the first bars of a node all of whose bars meet; bar numbers have no holes
        return F.sequence(x["a"], F.least(x["a"] + (early - 1), x["b"]))

    def folded(nodes):  # totals of nodes that meet as a whole
        firsts = F.slice(F.sort_array(F.flatten(F.transform(nodes, begin))), 1, early)
        return [F.aggregate(nodes, F.lit(0).cast("bigint"), lambda s, x: s + x["n"]).alias("n"), F.aggregate(nodes, F.lit(0.0), lambda s, x: s + x["v"]).alias("v"),
                F.array_min(F.transform(nodes, lambda x: x["a"])).alias("a"), F.array_max(F.transform(nodes, lambda x: x["b"])).alias("b"), firsts.alias("e")]

    node = F.struct(*[F.col(c) for c in names])
    met = z.join(heads, [*KEY, "_s"]).withColumn("_node", node).filter(some(F.col("_node")))
    whole = F.when(every(F.col("_node")), F.array("_node")).otherwise(F.transform(F.filter("_blocks", every), lambda x: F.struct(*[x[c].alias(c) for c in names])))
    edge = F.when(every(F.col("_node")), F.array().cast("array<bigint>")).otherwise(F.transform(F.filter("_blocks", lambda x: some(x) & ~every(x)), lambda x: x["_b"]))
    met = met.select(*key, "close_bar_no", "top", "bottom", whole.alias("_whole"), edge.alias("_edge"))
    inner = met.filter(F.size("_whole") > 0).select(*key, *folded(F.col("_whole")))
    opened = met.select(*key, "close_bar_no", "top", "bottom", F.explode("_edge").alias("_b")).join(rows.select(*KEY, "_b", "_bars"), [*KEY, "_b"])
    meets = F.filter("_bars", lambda x: (x["bar_no"] > F.col("close_bar_no")) & (x["hi"] >= F.col("bottom")) & (x["lo"] <= F.col("top")))
    opened = opened.select(*key, meets.alias("_x")).filter(F.size("_x") > 0)
    numbers = F.sort_array(F.transform("_x", lambda x: x["bar_no"]))
    outer = opened.select(*key, F.size("_x").cast("bigint").alias("n"), F.aggregate("_x", F.lit(0.0), lambda s, x: s + x["v"]).alias("v"), F.array_min(numbers).alias("a"), F.array_max(numbers).alias("b"), F.slice(numbers, 1, early).alias("e"))
    firsts = F.slice(F.sort_array(F.flatten(F.collect_list("e"))), 1, early)
    return inner.unionByName(outer).groupBy(*key).agg(F.sum("n").alias("n"), F.sum("v").alias("total"), F.min("a").alias("first_no"), F.max("b").alias("last_no"), firsts.alias("firsts"))


def touches(zones: DataFrame, bars: DataFrame, key: Sequence[str] = ZONE_KEY) -> DataFrame:
    """Number of later bars overlapping each zone, the first and the last one."""
    t = zone_totals(zones, bars, "low", "high", key=key)
    return t.select(*key, F.col("n").alias("touch_count"), F.col("first_no").alias("first_touch_no"), F.col("last_no").alias("last_touch_no"))


def accumulate(zones: DataFrame, bars: DataFrame, value: str, key: Sequence[str] = ZONE_KEY, out: str = "total") -> DataFrame:
    """Sum of ``value`` over later bars that close inside the zone."""
    t = zone_totals(zones, bars, "close", "close", value, key)
    return t.select(*key, F.col("n").alias("bars_inside"), F.col("total").alias(out))


def around_level(levels: DataFrame, eps: Column, key: Sequence[str]) -> DataFrame:
    """A level widened to a zone of +-eps, for ``accumulate``."""
    return levels.select(*key, F.col("confirm_bar_no").alias("close_bar_no"), (F.col("price") + eps).alias("top"), (F.col("price") - eps).alias("bottom"))


def held_bars(zones: DataFrame, bars: DataFrame, horizon: int, need: int = 3) -> DataFrame:
    """Bars at which some zone is standing that gets ``need`` closes inside within ``horizon`` bars.

    ``need`` closes in a row of one zone fix an interval of bars from which they are all seen. The
    intervals are laid on the bar axis as +1 and -1 and summed: predictions then join by bar number,
    and never meet zones."""
    z = zones.select(*ZONE_KEY, "close_bar_no", "top", "bottom", "mitigated_bar_no")
    c = zone_bars(z, bars, lambda x: (x["close"] >= F.col("bottom")) & (x["close"] <= F.col("top")), [], until=F.col("mitigated_bar_no") + horizon)
    w = Window.partitionBy(*ZONE_KEY).orderBy("bar_no")
    c = c.withColumn("_last", F.lead("bar_no", need - 1).over(w)).filter(F.col("_last").isNotNull())
    lo = F.greatest(F.col("_last") - horizon, F.col("close_bar_no"), F.lit(0))
    hi = F.least(F.col("bar_no") - 1, F.coalesce(F.col("mitigated_bar_no") - 1, F.col("bar_no") - 1))
    spans = c.select(*KEY, lo.alias("_lo"), hi.alias("_hi")).filter(F.col("_lo") <= F.col("_hi"))
    marks = spans.select(*KEY, F.explode(F.array(F.struct(F.col("_lo").alias("bar_no"), F.lit(1).alias("d")), F.struct((F.col("_hi") + 1).alias("bar_no"), F.lit(-1).alias("d")))).alias("m")).select(*KEY, "m.*")
    marks = marks.groupBy(*KEY, "bar_no").agg(F.sum("d").alias("d"))
    all_ = bars.select(*KEY, "bar_no").join(marks, [*KEY, "bar_no"], "left")
    axis = Window.partitionBy(*KEY).orderBy("bar_no").rowsBetween(Window.unboundedPreceding, 0)
    return all_.select(*KEY, "bar_no", (F.coalesce(F.sum("d").over(axis), F.lit(0)) > 0).alias("zone_hold"))


def near_price(zones: DataFrame, bars: DataFrame, window: Column, types: Sequence[str] | None = None) -> DataFrame:
    """Standing zones whose range, widened by ``window``, holds the newest close; best score first."""
    z = zones.filter(F.col("mitigated_bar_no").isNull())
    if types:
        z = z.filter(F.col("zone_type").isin(list(types)))
    z = z.join(last_close(bars).select(*KEY, "price_now"), list(KEY)).withColumn("_w", window)
    z = z.filter((F.col("price_now") >= F.col("bottom") - F.col("_w")) & (F.col("price_now") <= F.col("top") + F.col("_w")))
    return z.withColumn("score", F.col("p_hold") * F.col("w_zone")).drop("_w")


def top_zones(zones: DataFrame, k: int = 5, by: Sequence[str] = ("symbol", "zone_type")) -> DataFrame:
    z = zones.filter(F.col("mitigated_bar_no").isNull()).withColumn("score", F.col("p_hold") * F.col("w_zone"))
    w = Window.partitionBy(*by).orderBy(F.col("score").desc(), "kind", "imb_no")
    return z.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def overlay(zones: DataFrame, min_hold: float | None = None, limit: int | None = None) -> DataFrame:
    """Zones to draw per symbol: all of them, or what the caller asks for: those of at least
    ``min_hold``, and of these the ``limit`` best."""
    z = zones if min_hold is None else zones.filter(F.col("p_hold") >= min_hold)
    if limit is None:
        return z
    w = Window.partitionBy("symbol").orderBy(F.col("p_hold").desc(), "kind", "imb_no")
    return z.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= limit).drop("_rk")


def hold_labels(zones: DataFrame, bars: DataFrame, atr: DataFrame, bars_ahead: int = 60, reach: float = 0.5) -> DataFrame:
    """1 when, after the first touch, price leaves the zone by ``reach`` ATR on the good side within
    ``bars_ahead`` bars and before it passes the far edge."""
    z = zones.filter(F.col("first_touch_no").isNotNull()).join(atr.select(*KEY, F.col("bar_no").alias("first_touch_no"), "atr"), [*KEY, "first_touch_no"])
    up = F.col("is_bullish")
    good = F.when(up, F.col("top") + reach * F.col("atr")).otherwise(F.col("bottom") - reach * F.col("atr"))
    z = crossing(z, bars, up, good, F.col("high"), F.col("low"), F.col("first_touch_no"), False, bars_ahead, "_good")
    z = crossing(z, bars, ~up, F.when(up, F.col("bottom")).otherwise(F.col("top")), F.col("high"), F.col("low"), F.col("first_touch_no"), True, bars_ahead, "_bad")
    ok = F.col("_good").isNotNull() & (F.col("_bad").isNull() | (F.col("_good") < F.col("_bad")))
    return z.withColumn("held", ok.cast("int")).withColumnsRenamed({"_good": "good_no", "_bad": "bad_no"})


def touch_history(zones: DataFrame, bars: DataFrame, key: Sequence[str] = ZONE_KEY) -> DataFrame:
    """Total touches, the first three touch bars side by side, and the last one; also zones never touched."""
    t = zone_totals(zones, bars, "low", "high", key=key)
    each = [F.get("firsts", F.lit(i - 1)).alias(f"touch_{i}") for i in (1, 2, 3)]
    return zones.select(*key).join(t, list(key), "left").select(*key, F.coalesce("n", F.lit(0)).cast("bigint").alias("touches"), *each, F.col("last_no").alias("last_touch_no"))


def zone_summary(zones: DataFrame, bars: DataFrame, atr: DataFrame, quiet: int = 500) -> DataFrame:
    """The touch history, p_hold and the hold label at each of the first three touches, and the final
    status: MITIGATED, EXPIRED (untouched for more than ``quiet`` bars, since it closed if never touched) or ACTIVE."""
    z = zones.join(touch_history(zones, bars), list(ZONE_KEY))
    each = z.select("*", F.explode(F.array(*[F.struct(F.lit(i).alias("_k"), F.col(f"touch_{i}").alias("first_touch_no")) for i in (1, 2, 3)])).alias("_t")).select("*", "_t.*").drop("_t")
    held = hold_labels(each, bars, atr).groupBy(*ZONE_KEY).agg(*[F.max(F.when(F.col("_k") == i, F.col("held"))).alias(f"held_{i}") for i in (1, 2, 3)])
    now = last_close(bars).select(*KEY, "bar_now")
    silent = F.col("bar_now") - F.coalesce("last_touch_no", "close_bar_no")
    status = F.when(F.col("mitigated_bar_no").isNotNull(), "MITIGATED").when(silent > quiet, "EXPIRED").otherwise("ACTIVE")
    p = [F.when(F.col(f"touch_{i}").isNotNull(), F.col("p_hold")).alias(f"p_hold_{i}") for i in (1, 2, 3)]
    return z.join(held, list(ZONE_KEY), "left").join(now, list(KEY)).select(
        *ZONE_KEY, "touches", "touch_1", "touch_2", "touch_3", *p, "held_1", "held_2", "held_3", status.alias("final_status"))


def hold_pulse(updates: DataFrame, by: Sequence[str], order: str, limit: float = 0.15) -> DataFrame:
    """Updates that move p_hold by more than ``limit`` against the one before."""
    w = Window.partitionBy(*by).orderBy(order)
    u = updates.withColumn("change", F.abs(F.col("p_hold") - F.lag("p_hold").over(w)))
    return u.filter(F.col("change") > limit)
