"""Market structure over ordered bars: swings, gaps, levels and their life-cycles.

Bars run oldest to newest. A swing is known one bar later (``confirm_bar_no``); everything that
follows starts from that bar, never from the swing itself.

Work with a fixed reach runs in blocks of bars. Chains that look back without limit (runs of equal
prices, pivots of pivots) run per (symbol, tf): a key has at most one bar per bucket, half a
million M1 bars a year, whatever the number of ticks; and as all of them share that partitioning,
a whole chain costs no shuffle beyond the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketlake.operators.blocks import KEY, div, over_blocks
from marketlake.operators.first_passage import FAN, crossing
from marketlake.operators.indicators import atr_wilder

SIDE = (*KEY, "is_high")


def _false(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


# ---------------------------------------------------------------- swings

def _series(by=KEY, order: str = "bar_no"):
    return Window.partitionBy(*by).orderBy(order)


def _label(pivots: DataFrame, term: str) -> DataFrame:
    """Number the pivots of a side and tell new extremes (HH, LL) from the rest. Equal counts as new."""
    w = _series(SIDE)
    prev = F.lag("price").over(w)
    new = F.when(F.col("is_high"), F.col("prev_price") <= F.col("price")).otherwise(F.col("prev_price") >= F.col("price"))
    p = pivots.select("*", (F.row_number().over(w) - 1).cast("bigint").alias("pivot_no"), prev.alias("prev_price"))
    return p.withColumn("is_extreme", F.coalesce(new, F.lit(True))).withColumn("term", F.lit(term))


def _last_seen(c: Column, w) -> Column:
    return F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


PIVOT = ("symbol", "tf", "is_high", "pivot_no", "bar_no", "confirm_bar_no", "bucket", "price", "prev_price", "is_extreme", "term")


def swings(bars: DataFrame) -> DataFrame:
    """Short-term swings: a bar beyond the next bar and beyond the last bar of another value before it."""
    w = _series()
    b = bars.select("symbol", "tf", "bar_no", "bucket", "high", "low",
                    F.lag("high").over(w).alias("_ph"), F.lag("low").over(w).alias("_pl"),
                    F.lead("high").over(w).alias("_nh"), F.lead("low").over(w).alias("_nl"))
    b = b.select("*", _last_seen(F.when(F.col("_ph") != F.col("high"), F.col("_ph")), w).alias("_rh"),
                 _last_seen(F.when(F.col("_pl") != F.col("low"), F.col("_pl")), w).alias("_rl"))
    top = (F.col("high") > F.col("_rh")) & (F.col("high") > F.col("_nh"))
    bottom = (F.col("low") < F.col("_rl")) & (F.col("low") < F.col("_nl"))
    both = F.array(
        F.when(top, F.struct(F.lit(True).alias("is_high"), F.col("high").alias("price"))),
        F.when(bottom, F.struct(F.lit(False).alias("is_high"), F.col("low").alias("price"))),
    )
    p = b.select("symbol", "tf", "bar_no", "bucket", F.explode(F.array_compact(both)).alias("_p"))
    p = p.select("symbol", "tf", "bar_no", "bucket", "_p.*", (F.col("bar_no") + 1).alias("confirm_bar_no"))
    return _label(p, "ST").select(*PIVOT)


def promote(pivots: DataFrame, term: str) -> DataFrame:
    """Next tier: a pivot beyond both neighbours of its side (equal older ones skipped).

    The tier starts once enough pivots exist: four highs or three lows for IT, three of either
    for LT. A promotion is known when the newer neighbour is."""
    gate = F.when(F.col("is_high") & F.lit(term == "IT"), 4).otherwise(3)

    w = _series(SIDE, "pivot_no")
    p = pivots.select("symbol", "tf", "is_high", "pivot_no", "bar_no", "bucket", "price",
                      F.lead("price").over(w).alias("_next"), F.lead("confirm_bar_no").over(w).alias("_conf"),
                      _last_seen(F.when(F.col("prev_price") != F.col("price"), F.col("prev_price")), w).alias("_prev"))
    beyond = F.when(F.col("is_high"), (F.col("price") > F.col("_prev")) & (F.col("price") > F.col("_next"))).otherwise(
        (F.col("price") < F.col("_prev")) & (F.col("price") < F.col("_next")))
    p = p.filter(beyond & (F.col("pivot_no") + 2 >= gate))
    p = p.withColumn("confirm_bar_no", F.col("_conf")).drop("_next", "_conf", "_prev", "pivot_no")
    return _label(p, term).select(*PIVOT)


def tiers(bars: DataFrame) -> DataFrame:
    """Swings of all three tiers; a bar promoted twice appears once per tier."""
    st = swings(bars)
    it = promote(st, "IT")
    return st.unionByName(it).unionByName(promote(it, "LT"))


def pivot_label(term: Column, is_high: Column, is_extreme: Column) -> Column:
    kind = F.when(is_high & is_extreme, "HH").when(is_high, "LH").when(is_extreme, "LL").otherwise("HL")
    return F.concat_ws("-", term, kind)


def fractal_swings(bars: DataFrame, k: int, min_move: float = 0.15, atr_bars: int = 14) -> DataFrame:
    """Extremes of a centred window of +-k bars, thinned where neighbours lie within a part of ATR.

    Neighbours of one side closer than ``min_move`` * ATR form a cluster; its widest bar stays."""
    b = atr_wilder(bars, atr_bars)

    def add(df, w):
        around = w.rowsBetween(-k, k)
        full = F.count(F.lit(1)).over(around) == 2 * k + 1
        low, high = F.col("low"), F.col("high")
        top = full & (high == F.max("high").over(around)) & (low > F.lag("low").over(w)) & (low > F.lead("low").over(w))
        bottom = full & (low == F.min("low").over(around)) & (high < F.lag("high").over(w)) & (high < F.lead("high").over(w))
        return df.select("symbol", "tf", "bar_no", "bucket", "high", "low", "atr", "_blk", top.alias("_t"), bottom.alias("_d"))

    b = over_blocks(b, k, add, lookahead=k)
    both = F.array(
        F.when(F.col("_t"), F.struct(F.lit(True).alias("is_high"), F.col("high").alias("price"))),
        F.when(F.col("_d"), F.struct(F.lit(False).alias("is_high"), F.col("low").alias("price"))),
    )
    p = b.select("symbol", "tf", "bar_no", "bucket", "atr", (F.col("high") - F.col("low")).alias("span"), F.explode(F.array_compact(both)).alias("_p"))
    p = p.select("symbol", "tf", "bar_no", "bucket", "atr", "span", "_p.*")
    w = _series(SIDE)
    near = F.abs(F.col("price") - F.lag("price").over(w)) < min_move * F.col("atr")
    p = p.withColumn("_open", F.when(_false(near), 0).otherwise(1))
    p = p.withColumn("_cluster", F.sum("_open").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return (
        p.groupBy(*SIDE, "_cluster")
        .agg(F.max_by(F.struct("bar_no", "bucket", "price"), F.struct(F.col("span"), -F.col("bar_no"))).alias("_k"), F.count(F.lit(1)).alias("merged"))
        .select(*SIDE, "_k.*", "merged", (F.col("_k.bar_no") + k).alias("confirm_bar_no"))
    )


# ---------------------------------------------------------------- displacement

def displacement(bars: DataFrame, length: int = 100, factor: float = 2.0, require_gap: bool = True) -> DataFrame:
    """Does the previous bar's body exceed ``factor`` deviations of the recent bodies?"""
    return displacement_vector(bars, length, {"": (factor, require_gap)})


VECTOR_SETTINGS = {"_1": (1.0, False), "_2": (2.0, False), "_3": (3.0, False), "_1g": (1.0, True), "_2g": (2.0, True)}


def displacement_vector(bars: DataFrame, length: int = 100, settings: dict | None = None) -> DataFrame:
    """Displacement for several (factor, gap required) settings from one window pass."""
    settings = VECTOR_SETTINGS if settings is None else settings

    def add(df, w):
        body = F.abs(F.col("close") - F.col("open"))
        df = df.withColumn("_body", body)
        std = F.stddev_pop("_body").over(w.rowsBetween(-(length - 1), 0))
        b1 = F.lag("_body").over(w)
        rising = F.lag("close").over(w) > F.lag("open").over(w)
        gap = _false(F.when(rising, F.lag("high", 2).over(w) < F.col("low")).otherwise(F.lag("low", 2).over(w) > F.col("high")))
        ready = F.col("bar_no") >= 2
        out = [rising.alias("is_bullish"), gap.alias("gap_confirmed")]
        for tag, (factor, need) in settings.items():
            hit = _false((b1 > std * factor) & ready)
            out.append((hit & gap if need else hit).alias("is_displaced" + tag))
            out.append(F.when(ready & (std > 0), b1 / (std * factor)).otherwise(0.0).alias("d_strength" + tag))
        return df.select("*", *out).drop("_body")

    return over_blocks(bars, length + 1, add)


def body_deviation(bars: DataFrame, length: int = 20) -> DataFrame:
    """Population deviation of the ``length`` bodies before each bar."""
    def add(df, w):
        df = df.withColumn("_body", F.abs(F.col("close") - F.col("open")))
        return df.withColumn("body_std", F.stddev_pop("_body").over(w.rowsBetween(-length, -1))).drop("_body")

    return over_blocks(bars, length, add)


# ---------------------------------------------------------------- gaps

IMBALANCE = ("symbol", "tf", "kind", "imb_no", "is_bullish", "open_bar_no", "close_bar_no", "near", "far", "top", "bottom", "middle", "invertible")


def _gap_flags(df, w, length=None):
    """Raw conditions of the bar and of the bars before it, as columns."""
    def p(c, n):
        return F.lag(c, n).over(w)

    def hi(n):
        return F.greatest(p("open", n), p("close", n)) if n else F.greatest("open", "close")

    def lo(n):
        return F.least(p("open", n), p("close", n)) if n else F.least("open", "close")

    high, low = F.col("high"), F.col("low")
    out = dict(
        gap0=_false((low > p("high", 1)) | (high < p("low", 1))),
        gap1=_false((p("low", 1) > p("high", 2)) | (p("high", 1) < p("low", 2))),
        fvg0=_false((high < p("low", 2)) | (low > p("high", 2))),
        fvg1=_false((p("high", 1) < p("low", 3)) | (p("low", 1) > p("high", 3))),
        up=_false(low > p("high", 2)),
        h1=p("high", 1), l1=p("low", 1), h2=p("high", 2), l2=p("low", 2),
        b0h=hi(0), b0l=lo(0), b1h=hi(1), b1l=lo(1), b2h=hi(2), b2l=lo(2),
    )
    if length:
        df = df.withColumn("_body", F.abs(F.col("close") - F.col("open")))
        out["body1"] = p("_body", 1)
        out["std1"] = F.stddev_pop("_body").over(w.rowsBetween(-length, -1))
    return df.select("symbol", "tf", "bar_no", "high", "low", "_blk", *[c.alias(n) for n, c in out.items()])


def _finish(rows: DataFrame, kind: str) -> DataFrame:
    """Dense numbers, edges and the invertible flag (direction differs from the gap before)."""
    w = _series(KEY, "close_bar_no")
    turn = F.lag("is_bullish").over(w) != F.col("is_bullish")
    return rows.select(
        "*", (F.row_number().over(w) - 1).cast("bigint").alias("imb_no"), F.greatest("near", "far").alias("top"), F.least("near", "far").alias("bottom"),
        ((F.col("near") + F.col("far")) / 2).alias("middle"), _false(turn).alias("invertible"), F.lit(kind).alias("kind"),
    ).select(*IMBALANCE)


def fair_value_gaps(bars: DataFrame, merge_vi: bool = True, level: float | None = None, length: int = 100) -> DataFrame:
    """Three-bar gaps without an open gap at the bar or the bar before.

    ``merge_vi`` moves an edge to the body where neighbouring bodies do not meet, and lets such a
    gap that follows another gap at once extend the newest one instead of opening its own.
    ``level`` keeps gaps whose middle body exceeds that many deviations of ``length`` bodies."""
    f = over_blocks(bars, max(3, (length + 1) if level else 3), lambda df, w: _gap_flags(df, w, length if level else None))
    keep = F.col("fvg0") & ~F.col("gap0") & ~F.col("gap1")
    if level:
        keep = keep & _false(F.col("body1") > F.col("std1") * level)
    f = f.filter(keep)
    up, m = F.col("up"), F.lit(merge_vi)
    near = F.when(up, F.when(m & (F.col("b0l") > F.col("b1h")), F.col("b0l")).otherwise(F.col("low"))).otherwise(
        F.when(m & (F.col("b0h") < F.col("b1l")), F.col("b0h")).otherwise(F.col("high")))
    far = F.when(up, F.when(m & (F.col("b1l") > F.col("b2h")), F.col("b2h")).otherwise(F.col("h2"))).otherwise(
        F.when(m & (F.col("b2l") > F.col("b1h")), F.col("b2l")).otherwise(F.col("l2")))
    joins = m & ((F.col("b1l") > F.col("b2h")) | (F.col("b2l") > F.col("b1h"))) & F.col("fvg1")
    f = f.select("symbol", "tf", "bar_no", up.alias("is_bullish"), near.alias("near"), far.alias("far"), F.when(joins, 0).otherwise(1).alias("_open"))
    f = f.withColumn("_chain", F.sum("_open").over(_series().rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("_chain") > 0)
    first = F.min_by(F.struct("bar_no", "is_bullish", "far"), "bar_no")
    chains = f.groupBy(*KEY, "_chain").agg(first.alias("_f"), F.max_by(F.struct("bar_no", "near"), "bar_no").alias("_l"))
    rows = chains.select(
        *KEY, F.col("_f.is_bullish").alias("is_bullish"),
        (F.col("_f.bar_no") - 1).alias("open_bar_no"), F.col("_l.bar_no").alias("close_bar_no"), F.col("_l.near").alias("near"), F.col("_f.far").alias("far"),
    )
    return _finish(rows, "FVG")


def volume_imbalances(bars: DataFrame, merge_vi: bool = True) -> DataFrame:
    """Bodies of two bars do not meet, no open gap (and no three-bar gap when those are merged)."""
    f = over_blocks(bars, 3, _gap_flags)
    up, down = F.col("b0l") > F.col("b1h"), F.col("b0h") < F.col("b1l")
    keep = _false(up | down) & ~F.col("gap0") & (~F.col("fvg0") | F.lit(not merge_vi))
    rows = f.filter(keep).select(
        *KEY, up.alias("is_bullish"), (F.col("bar_no") - 1).alias("open_bar_no"), F.col("bar_no").alias("close_bar_no"),
        F.when(up, F.col("b0l")).otherwise(F.col("b0h")).alias("near"), F.when(up, F.col("b1h")).otherwise(F.col("b1l")).alias("far"))
    return _finish(rows, "VI")


def open_gaps(bars: DataFrame) -> DataFrame:
    """The bar does not touch the bar before it."""
    f = over_blocks(bars, 3, _gap_flags).filter("gap0")
    down = F.col("high") < F.col("l1")
    rows = f.select(
        *KEY, (~down).alias("is_bullish"), (F.col("bar_no") - 1).alias("open_bar_no"), F.col("bar_no").alias("close_bar_no"),
        F.when(down, F.col("high")).otherwise(F.col("low")).alias("near"), F.when(down, F.col("l1")).otherwise(F.col("h1")).alias("far"))
    return _finish(rows, "GAP")


# ---------------------------------------------------------------- life-cycles

def claim(pivots: DataFrame, bars: DataFrame) -> DataFrame:
    """First bar from confirmation on that trades beyond the pivot."""
    return crossing(pivots, bars, F.col("is_high"), F.col("price"), F.col("high"), F.col("low"), F.col("confirm_bar_no"), out="claimed_bar_no")


RULES = ("wick_touched", "wick_half", "wick_filled", "body_half", "body_filled")


def mitigate(imbalances: DataFrame, bars: DataFrame, rule: str = "wick_filled", out: str = "mitigated_bar_no") -> DataFrame:
    """First later bar that returns into the gap: touch of the near edge, half way, or the far edge,
    by wick or by body."""
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule}")
    body = rule.startswith("body")
    up = F.greatest("open", "close") if body else F.col("high")
    down = F.least("open", "close") if body else F.col("low")
    level = {"touched": "near", "half": "middle", "filled": "far"}[rule.split("_")[1]]
    return crossing(imbalances, bars, ~F.col("is_bullish"), F.col(level), up, down, F.col("close_bar_no") + 1, strict=rule == "wick_touched", out=out)


def mitigate_all(imbalances: DataFrame, bars: DataFrame) -> DataFrame:
    """All five rules at once, one column each: every gap waits for five levels in a single search."""
    edge = {"touched": "near", "half": "middle", "filled": "far"}
    waits = F.array(*[F.struct(F.lit(x).alias("rule"), F.lit("body" if x.startswith("body") else "touch" if x == "wick_touched" else "wick").alias("kind"),
                               F.col(edge[x.split("_")[1]]).alias("level")) for x in RULES])
    z = imbalances.select(*KEY, "kind", "imb_no", "is_bullish", "close_bar_no", F.explode(waits).alias("_w"))
    z = z.select(*KEY, F.col("kind").alias("zone_kind"), "imb_no", "is_bullish", "close_bar_no", F.col("_w.rule").alias("rule"), F.col("_w.kind").alias("by"), F.col("_w.level").alias("level"))
    sides = F.array(F.struct(F.lit("wick").alias("by"), F.col("high").alias("u"), F.col("low").alias("d")),
                    F.struct(F.lit("body").alias("by"), F.greatest("open", "close").alias("u"), F.least("open", "close").alias("d")))
    b = bars.select(*KEY, "bar_no", "open", "high", "low", "close")
    b = b.select(*KEY, "bar_no", F.explode(sides).alias("_s")).select(*KEY, "bar_no", F.col("_s.by").alias("by"), F.col("_s.u").alias("u"), F.col("_s.d").alias("d"))

    def find(rows: DataFrame, series: DataFrame, strict: bool) -> DataFrame:
        return crossing(rows, series, ~F.col("is_bullish"), F.col("level"), F.col("u"), F.col("d"), F.col("close_bar_no") + 1, strict, out="hit", by=(*KEY, "by"))

    touch = find(z.filter("by = 'touch'").withColumn("by", F.lit("wick")), b.filter("by = 'wick'"), True)
    rest = find(z.filter("by <> 'touch'"), b, False)
    wide = touch.unionByName(rest).groupBy(*KEY, "zone_kind", "imb_no", "close_bar_no").pivot("rule", list(RULES)).agg(F.max("hit"))
    return imbalances.join(wide.withColumnRenamed("zone_kind", "kind"), [*KEY, "kind", "imb_no", "close_bar_no"])


def invert(imbalances: DataFrame, bars: DataFrame, candle_colour: bool = False) -> DataFrame:
    """Close through the far edge of an invertible gap: a new zone of the other direction."""
    up = F.when(F.col("close") > F.col("open"), F.col("close")) if candle_colour else F.col("close")
    down = F.when(F.col("close") < F.col("open"), F.col("close")) if candle_colour else F.col("close")
    hit = crossing(imbalances.filter("invertible"), bars, ~F.col("is_bullish"), F.col("far"), up, down, F.col("close_bar_no") + 1, out="inverted_bar_no")
    return hit.filter(F.col("inverted_bar_no").isNotNull()).select(
        *KEY, F.lit("iFVG").alias("kind"), "imb_no", (~F.col("is_bullish")).alias("is_bullish"), "open_bar_no",
        F.col("inverted_bar_no").alias("close_bar_no"), F.col("far").alias("near"), F.col("near").alias("far"), "top", "bottom", "middle", F.lit(False).alias("invertible"))


STATES = ("UNMITIGATED", "WICK_TOUCHED", "WICK_FILLED_HALF", "WICK_FILLED", "BODY_FILLED")


def zone_progress(imbalances: DataFrame, bars: DataFrame) -> DataFrame:
    """Bar at which each depth is reached, and the depth reached by the newest bar."""
    names = {"wick_touched": "touched_no", "wick_half": "half_no", "wick_filled": "wick_no", "body_filled": "body_no"}
    z = mitigate_all(imbalances, bars).drop("body_half").withColumnsRenamed(names)
    state = F.when(F.col("body_no").isNotNull(), STATES[4]).when(F.col("wick_no").isNotNull(), STATES[3])
    state = state.when(F.col("half_no").isNotNull(), STATES[2]).when(F.col("touched_no").isNotNull(), STATES[1]).otherwise(STATES[0])
    return z.withColumn("status", state)


# ---------------------------------------------------------------- equal levels

def eq_spacing(bars: DataFrame, tolerance: float = 0.2, n: int = 14) -> DataFrame:
    """Median of the last ``n`` ATR values times the tolerance."""
    def add(df, w):
        return df.withColumn("spacing", F.percentile("atr", F.lit(0.5)).over(w.rowsBetween(-(n - 1), 0)) * tolerance)

    return over_blocks(atr_wilder(bars), n, add)


def equal_pairs(pivots: DataFrame, bars: DataFrame, tolerance: float = 0.2) -> DataFrame:
    """Pairs of swings of one side, closer in price than the spacing at the newer one, that could see
    each other.

    Nothing between the two may pass the outer one of them. So the outer swing looks, forward or
    backward, only up to the first bar beyond it, and meets other swings by 64-bar time block: a
    swing joins the blocks it reaches, never a whole series."""
    sp = eq_spacing(bars, tolerance).select(*KEY, F.col("bar_no").alias("confirm_bar_no"), "spacing")
    p = pivots.select(*SIDE, "bar_no", "confirm_bar_no", "price").join(sp, [*KEY, "confirm_bar_no"])
    ends = bars.groupBy(*KEY).agg(F.max("bar_no").alias("_end"))
    p = p.join(ends, list(KEY))
    p = crossing(p, bars, F.col("is_high"), F.col("price"), F.col("high"), F.col("low"), F.col("bar_no") + 1, out="_next")
    mirrored = bars.join(ends, list(KEY)).withColumn("bar_no", F.col("_end") - F.col("bar_no"))
    p = crossing(p, mirrored, F.col("is_high"), F.col("price"), F.col("high"), F.col("low"), F.col("_end") - F.col("bar_no") + 1, out="_back").persist()
    until = F.coalesce("_next", "_end")
    since = F.coalesce(F.col("_end") - F.col("_back"), F.lit(0))
    blk = div("bar_no", FAN)

    def ends_of(tag: str, reach=None):
        cols = [F.col("bar_no").alias(tag + "_no"), F.col("price").alias(tag + "_price")]
        if tag == "end":
            cols += [F.col("confirm_bar_no").alias("confirm_no"), "spacing"]
        return p.select(*SIDE, *cols, (F.explode(F.sequence(*[div(x, FAN) for x in reach])) if reach else blk).alias("_b"))

    ahead = ends_of("start", (F.col("bar_no"), until)).join(ends_of("end"), [*SIDE, "_b"])
    behind = ends_of("end", (since, F.col("bar_no"))).join(ends_of("start"), [*SIDE, "_b"])
    diff = F.when(F.col("is_high"), F.col("start_price") - F.col("end_price")).otherwise(F.col("end_price") - F.col("start_price"))
    close = (F.col("start_no") < F.col("end_no")) & (F.abs(diff) < F.col("spacing"))
    out = [*SIDE, "start_no", "end_no", "start_price", "end_price", "confirm_no"]
    pairs = ahead.filter(close & (diff >= 0)).select(*out).unionByName(behind.filter(close & (diff < 0)).select(*out))
    level = F.when(F.col("is_high"), F.greatest("start_price", "end_price")).otherwise(F.least("start_price", "end_price"))
    return pairs.withColumn("price", level)


def line_of_sight(pairs: DataFrame, bars: DataFrame) -> DataFrame:
    """Keep pairs whose joining line no bar in between pierces.

    Each pair meets the 64-bar rows it spans, one row per block, and is dropped if any pierces."""
    pairs = pairs.persist()
    blk = div("bar_no", FAN)
    rows = bars.groupBy(*KEY, blk.alias("_b")).agg(F.collect_list(F.struct("bar_no", "high", "low")).alias("_bars"))
    first, last = F.col("start_no") + 1, F.col("end_no") - 1
    key = [*SIDE, "start_no", "end_no"]
    q = pairs.filter(first <= last).select(*key, "start_price", "end_price", F.explode(F.sequence(div(first, FAN), div(last, FAN))).alias("_b"))
    q = q.join(rows, [*KEY, "_b"])
    slope = (F.col("end_price") - F.col("start_price")) / (F.col("end_no") - F.col("start_no"))

    def pierces(x):
        line = F.col("start_price") + slope * (x["bar_no"] - F.col("start_no"))
        inside = (x["bar_no"] > F.col("start_no")) & (x["bar_no"] < F.col("end_no"))
        return inside & F.when(F.col("is_high"), x["high"] > line).otherwise(x["low"] < line)

    blocked = q.filter(F.exists("_bars", pierces)).select(*key).distinct()
    return pairs.join(blocked, key, "left_anti")


def equal_levels(pivots: DataFrame, bars: DataFrame, tolerance: float = 0.2) -> DataFrame:
    """Equal highs and lows with a free line between them, and the bar that takes them out."""
    free = line_of_sight(equal_pairs(pivots, bars, tolerance), bars)
    return crossing(free, bars, F.col("is_high"), F.col("price"), F.col("high"), F.col("low"), F.col("confirm_no") + 1, out="claimed_bar_no")


# ---------------------------------------------------------------- structure events

def last_close(bars: DataFrame) -> DataFrame:
    """Newest bar of each key: one row per key."""
    return bars.groupBy(*KEY).agg(
        F.max_by("close", "bar_no").alias("price_now"), F.max("bar_no").alias("bar_now"), F.max("bucket").alias("bucket_now"))


def _broken(pivots: DataFrame, bars: DataFrame) -> DataFrame:
    now = last_close(bars).select(*KEY, "price_now")
    p = pivots.filter(F.col("term").isin("ST", "IT")).join(now, list(KEY))
    beyond = F.when(F.col("is_high"), F.col("price_now") > F.col("price")).otherwise(F.col("price_now") < F.col("price"))
    return p.withColumn("broken", beyond)


def mss(pivots: DataFrame, bars: DataFrame) -> DataFrame:
    """Structure shifts at the newest close: it lies beyond a swing that was itself a new extreme.
    Strength is the step from the swing before, relative to price."""
    turn = F.when(F.col("is_high"), F.col("price") > F.col("prev_price")).otherwise(F.col("price") < F.col("prev_price"))
    p = _broken(pivots, bars).filter(F.col("broken") & turn)
    return p.select(*SIDE, "term", "pivot_no", "bar_no", "price", "price_now",
                    F.when(F.col("is_high"), "BULLISH_MSS").otherwise("BEARISH_MSS").alias("event"),
                    (F.abs(F.col("price") - F.col("prev_price")) / F.col("price")).alias("strength"))


def mss_triggers(pivots: DataFrame, bars: DataFrame) -> DataFrame:
    """The bar that first closes beyond each new-extreme swing."""
    turn = F.when(F.col("is_high"), F.col("price") > F.col("prev_price")).otherwise(F.col("price") < F.col("prev_price"))
    hit = crossing(pivots.filter(turn), bars, F.col("is_high"), F.col("price"), F.col("close"), F.col("close"), F.col("confirm_bar_no"), out="trigger_no")
    return hit.filter(F.col("trigger_no").isNotNull())


def bos(pivots: DataFrame, bars: DataFrame, at_least: int = 2) -> DataFrame:
    """Breaks of structure at the newest close: two or more swings broken; the oldest one is kept."""
    b = _broken(pivots, bars).filter("broken").groupBy(*SIDE).agg(
        F.count(F.lit(1)).alias("strength"), F.min_by("price", "bar_no").alias("oldest_price"), F.min("bar_no").alias("oldest_no"))
    return b.filter(F.col("strength") >= at_least).withColumn("event", F.when(F.col("is_high"), "BULLISH_BOS").otherwise("BEARISH_BOS"))


def order_blocks(triggers: DataFrame, bars: DataFrame, trigger_no: str = "trigger_no", reach: int = 19) -> DataFrame:
    """Last opposite candle in the ``reach`` bars before a trigger; strength is trigger range / ATR."""
    def add(df, w):
        back = w.rowsBetween(-reach, -1)
        candle = F.struct("bar_no", "high", "low")
        red = F.last(F.when(F.col("close") < F.col("open"), candle), ignorenulls=True).over(back)
        green = F.last(F.when(F.col("close") > F.col("open"), candle), ignorenulls=True).over(back)
        return df.select("symbol", "tf", "bar_no", "_blk", ((F.col("high") - F.col("low")) / F.col("atr")).alias("strength"), red.alias("_red"), green.alias("_green"))

    b = over_blocks(atr_wilder(bars), reach, add).withColumnRenamed("bar_no", trigger_no)
    t = triggers.select(*KEY, trigger_no).distinct().join(b, [*KEY, trigger_no])
    both = F.array(
        F.when(F.col("_red").isNotNull(), F.struct(F.lit(True).alias("is_bullish"), F.col("_red").alias("c"))),
        F.when(F.col("_green").isNotNull(), F.struct(F.lit(False).alias("is_bullish"), F.col("_green").alias("c"))))
    return t.select(*KEY, trigger_no, "strength", F.explode(F.array_compact(both)).alias("_o")).select(
        *KEY, trigger_no, "strength", F.col("_o.is_bullish").alias("is_bullish"), F.col("_o.c.bar_no").alias("block_no"),
        F.col("_o.c.high").alias("top"), F.col("_o.c.low").alias("bottom"))


def equilibrium(pivots: DataFrame) -> DataFrame:
    """Middle of the highest swing high and the lowest swing low."""
    high, low = F.when(F.col("is_high"), F.col("price")), F.when(~F.col("is_high"), F.col("price"))
    e = pivots.groupBy(*KEY).agg(F.max(high).alias("major_high"), F.min(low).alias("major_low"),
                                 F.min(F.when(F.col("is_high"), F.struct(-F.col("price"), "bar_no")))["bar_no"].alias("high_no"),
                                 F.min(F.when(~F.col("is_high"), F.struct("price", "bar_no")))["bar_no"].alias("low_no"))
    return e.withColumn("equilibrium", (F.col("major_high") + F.col("major_low")) / 2)


FIB_RATIOS = (0.382, 0.5, 0.618, 0.786)


def fib_levels(high: Column, low: Column, mode: str = "spec") -> Column:
    """Map ratio -> price. ``code`` mode hangs the ratios on the middle instead of the low."""
    span, half = high - low, (high + low) / 2
    if mode == "spec":
        prices = [low + span * q for q in FIB_RATIOS]
    else:
        prices = [half - span * 0.382, half, half + span * 0.618, half + span * 0.786]
    return F.map_from_arrays(F.array(*[F.lit(q) for q in FIB_RATIOS]), F.array(*prices))


def price_side(price: Column, ref: Column) -> Column:
    return F.when(price > ref, "premium").when(price < ref, "discount").otherwise("mid")


def encroachment_pct(price: Column, top: Column, bottom: Column) -> Column:
    """Distance from the zone middle in percent of its height, 0 for a flat zone."""
    return F.when(top == bottom, 0.0).otherwise(F.abs(price - (top + bottom) / 2) / F.abs(top - bottom) * 100)


# ---------------------------------------------------------------- levels around the price

def nearest_levels(claimed: DataFrame, bars: DataFrame) -> DataFrame:
    """Per tier and side the unclaimed pivot nearest to the newest close, its distance in ATR and age."""
    last_atr = atr_wilder(bars).groupBy(*KEY).agg(F.max_by("atr", "bar_no").alias("atr_now"))
    now = last_close(bars).join(last_atr, list(KEY))
    p = claimed.filter(F.col("claimed_bar_no").isNull()).join(now, list(KEY))
    pick = F.min_by(F.struct("price", "bar_no", "bucket", "price_now", "atr_now", "bucket_now"), F.struct(F.abs(F.col("price") - F.col("price_now")), -F.col("bar_no")))
    n = p.groupBy(*SIDE, "term").agg(pick.alias("_n"), F.count(F.lit(1)).alias("unclaimed"))
    gap = F.when(F.col("is_high"), F.col("_n.price") - F.col("_n.price_now")).otherwise(F.col("_n.price_now") - F.col("_n.price"))
    return n.select(*SIDE, "term", "unclaimed", F.col("_n.price").alias("price"), F.col("_n.bar_no").alias("bar_no"),
                    (gap / F.col("_n.atr_now")).alias("distance_atr"), ((F.col("_n.bucket_now") - F.col("_n.bucket")) / 60).alias("minutes_since"))


def claimed_ratio(claimed: DataFrame, newest: int = 50) -> DataFrame:
    """Share of claimed pivots per tier, over all and over the newest ones of either side."""
    w = Window.partitionBy(*KEY, "term").orderBy(F.col("bar_no").desc(), "is_high")
    c = claimed.select(*KEY, "term", "is_high", "bar_no", F.col("claimed_bar_no").isNotNull().cast("double").alias("_c"))
    total = c.groupBy(*KEY, "term").agg(F.count(F.lit(1)).alias("pivots"), F.avg("_c").alias("claimed_ratio"))
    recent = c.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= newest).groupBy(*KEY, "term").agg(F.avg("_c").alias("claimed_recent"))
    return total.join(recent, [*KEY, "term"])


def level_density(claimed: DataFrame, bars: DataFrame, part: float = 0.01) -> DataFrame:
    """Unclaimed highs and lows within a part of the newest close."""
    now = last_close(bars).select(*KEY, "price_now")
    p = claimed.join(now, list(KEY))
    near = F.col("claimed_bar_no").isNull() & (F.abs(F.col("price") - F.col("price_now")) <= F.col("price_now") * part)
    return p.groupBy(*KEY).agg(F.count_if(near & F.col("is_high")).alias("bsl_density"), F.count_if(near & ~F.col("is_high")).alias("ssl_density"))


def register_fib_levels(spark: SparkSession) -> None:
    """The same levels as a table function for SQL: ``FROM t, LATERAL fib_levels(high, low)``."""
    ratios = ", ".join(f"({q}D)" for q in FIB_RATIOS)
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION fib_levels(high DOUBLE, low DOUBLE) RETURNS TABLE(ratio DOUBLE, price DOUBLE)
        RETURN SELECT q, fib_levels.low + (fib_levels.high - fib_levels.low) * q FROM VALUES {ratios} AS t(q)""")
