"""Economic calendar and trading sessions: as-of context, clusters, surprises, impact."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlake.operators.asof import asof
from marketlake.operators.blocks import div, running_sum, time_block, with_previous

DAY = 86400

# Session id, start and end minute of day (UTC), weights for low and high timeframes.
SESSIONS = (
    ("LONDON_OPEN_KZ", 420, 480, 1.5, 1.0),
    ("NY_OPEN_KZ", 720, 780, 1.5, 1.0),
    ("LONDON", 420, 660, 1.0, 1.2),
    ("NY_AM", 720, 960, 1.0, 1.2),
    ("NY_PM", 960, 1200, 0.8, 1.0),
    ("ASIAN", 1320, 420, 0.5, 1.0),
)
# Weight, volatility multiplier and order of the impact classes.
BASE_IMPACT = {"LOW": 0.2, "MEDIUM": 0.5, "HIGH": 1.0}
VOLATILITY_MULTIPLIER = {"FOMC": 2.0, "NFP": 2.5, "INTEREST_RATE": 3.0}
IMPACT_ORDER = {"LOW": 1, "MEDIUM": 2, "HIGH": 3}


def _lookup(values: dict, key: Column, default=None) -> Column:
    m = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v))])
    got = m[key]
    return got if default is None else F.coalesce(got, F.lit(default))


# ---------------------------------------------------------------- sessions

def sessions(df: DataFrame, ts: str = "ts") -> DataFrame:
    """All sessions of the UTC minute (they overlap, one wraps midnight) and the first by priority.

    Six fixed intervals: a column expression, not a join."""
    minute = F.hour(ts) * 60 + F.minute(ts)

    def inside(a: int, b: int) -> Column:
        return (minute >= a) & (minute < b) if a < b else (minute >= a) | (minute < b)

    rows = [F.when(inside(a, b), F.struct(F.lit(i).alias("id"), F.lit(l).alias("ltf"), F.lit(h).alias("htf"))) for i, a, b, l, h in SESSIONS]
    found = F.array_compact(F.array(*rows))
    df = df.withColumn("_s", found)
    first = F.when(F.size("_s") > 0, F.col("_s")[0])
    return df.select(*[c for c in df.columns if c != "_s"], F.transform("_s", lambda s: s["id"]).alias("sessions"),
                     F.coalesce(first["id"], F.lit("OFF")).alias("session"), F.coalesce(first["ltf"], F.lit(1.0)).alias("w_ltf"), F.coalesce(first["htf"], F.lit(1.0)).alias("w_htf"))


# ---------------------------------------------------------------- calendar selection

def impact_filter(calendar: DataFrame, minimum: str, currencies: list[str], start=None, end=None) -> DataFrame:
    c = calendar.filter(_lookup(IMPACT_ORDER, F.col("impact"), 0) >= IMPACT_ORDER[minimum]).filter(F.col("currency").isin(currencies))
    if start is not None:
        c = c.filter(F.col("scheduled_time") >= F.lit(start).cast("timestamp"))
    if end is not None:
        c = c.filter(F.col("scheduled_time") <= F.lit(end).cast("timestamp"))
    return c


def calendar_diff(old: DataFrame, new: DataFrame, now: str, moved_minutes: int = 30, grace_hours: int = 1) -> DataFrame:
    """Events moved by more than ``moved_minutes``, and known ones that vanished and are not long past."""
    o = old.select("event_id", F.col("scheduled_time").alias("old_time"))
    n = new.select("event_id", F.col("scheduled_time").alias("new_time"))
    shift = (F.unix_seconds("new_time") - F.unix_seconds("old_time")) / 60
    moved = o.join(n, "event_id").filter(F.abs(shift) > moved_minutes).select("event_id", F.lit("RESCHEDULED").alias("change"), shift.alias("minutes"))
    floor = F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {grace_hours} HOURS")
    gone = o.join(n, "event_id", "left_anti").filter(F.col("old_time") > floor)
    return moved.unionByName(gone.select("event_id", F.lit("CANCELLED").alias("change"), F.lit(None).cast("double").alias("minutes")))


# ---------------------------------------------------------------- context of a moment

def next_last_event(df: DataFrame, calendar: DataFrame, ts: str = "ts", block_seconds: int = 3600) -> DataFrame:
    """Next event at or after the row and last event before it, with seconds each way."""
    cal = calendar.select(F.col("event_id"), F.col("scheduled_time").alias("_at"))
    out = asof(df, cal, ts, "_at", [], {"event_id": "next_event_id", "_at": "_next"}, "forward", True, "event_id", block_seconds)
    out = asof(out, cal, ts, "_at", [], {"event_id": "last_event_id", "_at": "_last"}, "backward", False, "event_id", block_seconds)
    now = F.unix_micros(ts)
    return out.select("*", ((F.unix_micros("_next") - now) / 1e6).alias("seconds_to_next"), ((now - F.unix_micros("_last")) / 1e6).alias("seconds_since_last")).drop("_next", "_last")


def _numbered(calendar: DataFrame) -> DataFrame:
    """Running count of events in time order, by day blocks."""
    c = calendar.select("event_id", F.col("scheduled_time").alias("_at"))
    return running_sum(c, {"_count": F.lit(1.0)}, [], ["_at", "event_id"], time_block(F.col("_at"), DAY))


def events_ahead(df: DataFrame, calendar: DataFrame, seconds: int = 1800, ts: str = "ts", out: str = "events_ahead") -> DataFrame:
    """How many events fall in [row, row + seconds]: a difference of two running counts, no pairs."""
    cal = _numbered(calendar)
    d = df.withColumn("_to", F.col(ts) + F.expr(f"INTERVAL {seconds} SECONDS"))
    d = asof(d, cal, "_to", "_at", [], {"_count": "_upto"}, "backward", True, "event_id", 3600)
    d = asof(d, cal, ts, "_at", [], {"_count": "_before"}, "backward", False, "event_id", 3600)
    n = F.coalesce("_upto", F.lit(0.0)) - F.coalesce("_before", F.lit(0.0))
    return d.withColumn(out, n.cast("bigint")).drop("_to", "_upto", "_before")


def macro_state(to_next: Column, since_last: Column, ahead: Column, pre: int = 900, window: int = 300, post: int = 1800) -> Column:
    return (
        F.when(ahead >= 2, "CLUSTER")
        .when((since_last <= window) | (to_next == 0), "NEWS_WINDOW")
        .when(to_next <= pre, "PRE_NEWS")
        .when(since_last < post, "POST_NEWS")
        .otherwise("NORMAL")
    )


def dampening(state: Column, to_next: Column, pre: int = 900) -> Column:
    return F.when(state.isin("NEWS_WINDOW", "CLUSTER"), 0.1).when(state == "PRE_NEWS", 0.3 * to_next / pre + 0.1).otherwise(1.0)


def guardrail(state: Column) -> Column:
    return state.isin("CLUSTER", "PRE_NEWS", "NEWS_WINDOW")


def with_macro_state(df: DataFrame, calendar: DataFrame, ts: str = "ts") -> DataFrame:
    """State, dampening and guardrail of every row, from the HIGH events around it."""
    high = calendar.filter(F.col("impact") == "HIGH")
    d = events_ahead(next_last_event(df, high, ts), high, 1800, ts)
    d = d.withColumn("macro_state", macro_state(F.col("seconds_to_next"), F.col("seconds_since_last"), F.col("events_ahead")))
    return d.select("*", dampening(F.col("macro_state"), F.col("seconds_to_next")).alias("dampening"), guardrail(F.col("macro_state")).alias("guardrail"))


def state_changes(df: DataFrame, state: str, by: list[str], order: list[str], block: Column) -> DataFrame:
    """Rows where the state differs from the row before."""
    d = with_previous(df, [state], by, order, block)
    return d.filter(F.col("prev_" + state).isNotNull() & (F.col("prev_" + state) != F.col(state)))


def countdown(calendar: DataFrame, before: int = 900, after: int = 300) -> DataFrame:
    """Event-time second grid around each HIGH event, instead of a wall-clock loop."""
    at = F.unix_seconds("scheduled_time")
    c = calendar.filter(F.col("impact") == "HIGH").select("event_id", at.alias("at"), F.explode(F.sequence(at - before, at + after)).alias("second"))
    left = F.col("at") - F.col("second")
    return c.select("event_id", "second", left.alias("seconds_to_event"), F.when(left > 0, "PRE_NEWS").otherwise("NEWS_WINDOW").alias("phase"))


# ---------------------------------------------------------------- impact and surprise

def news_impact(impact: Column, market_move: Column, atr_d1: Column, alpha: float = 0.4, cap: float = 3.0) -> Column:
    return F.least(_lookup(BASE_IMPACT, impact, 0.5) * (1 + alpha * market_move / F.greatest(atr_d1, F.lit(0.01))), F.lit(cap))


def dampened_impact(i_news: Column, active: Column, factor: float = 0.3) -> Column:
    return F.when(active, i_news * factor).otherwise(i_news)


def category_multiplier(title: Column) -> Column:
    """Volatility multiplier of the first category named in the title, else 1."""
    c = F.lit(1.0)
    for name, m in reversed(list(VOLATILITY_MULTIPLIER.items())):
        c = F.when(F.upper(title).rlike(name.replace("_", "[ _]")), m).otherwise(c)
    return c


def surprise_z(actual: Column, forecast: Column, sigma: Column) -> Column:
    """Surprise in sigmas, or relative to the forecast without a usable sigma."""
    diff = actual - forecast
    rel = diff / F.greatest(F.abs(forecast), F.lit(0.001))
    return F.when(forecast == 0, F.lit(None)).otherwise(F.when(F.coalesce(sigma, F.lit(0.0)) < 0.001, rel).otherwise(diff / sigma))


def surprise_factor(z: Column) -> Column:
    a = F.abs(z)
    return F.when(a <= 1, 1.0).when(a <= 2, 1 + 0.25 * (a - 1)).otherwise(1.25 + 0.5 * (a - 2))


def surprise_direction(actual: Column, forecast: Column) -> Column:
    return F.when(actual > forecast, "BULLISH").when(actual < forecast, "BEARISH").otherwise("NEUTRAL")


def prior_surprise_stats(calendar: DataFrame, by: list[str]) -> DataFrame:
    """Count, mean and sample deviation of the surprises strictly before each event of its group."""
    c = calendar.withColumn("_x", F.when(F.col("forecast") != 0, F.col("actual") - F.col("forecast")))
    x = F.coalesce("_x", F.lit(0.0))
    known = F.col("_x").isNotNull().cast("double")
    c = running_sum(c, {"_n": known, "_s": x, "_q": x * x}, by, ["scheduled_time", "event_id"], time_block(F.col("scheduled_time"), DAY))
    n, s, q = F.col("_n") - known, F.col("_s") - x, F.col("_q") - x * x
    var = (q - s * s / n) / (n - 1)
    return c.select(*calendar.columns, n.cast("bigint").alias("prior_n"), F.when(n > 0, s / n).alias("prior_mean"),
                    F.when(n > 1, F.sqrt(F.greatest(var, F.lit(0.0)))).alias("prior_sigma"))


def clusters(calendar: DataFrame, i_news: str, gap_minutes: int = 30, boost: float = 1.25) -> DataFrame:
    """HIGH events of a currency less than ``gap_minutes`` apart become one event."""
    h = calendar.filter(F.col("impact") == "HIGH")
    blk = time_block(F.col("scheduled_time"), DAY)
    order = ["scheduled_time", "event_id"]
    h = with_previous(h, ["scheduled_time"], ["currency"], order, blk)
    gap = (F.unix_micros("scheduled_time") - F.unix_micros("prev_scheduled_time")) / 6e7
    h = h.withColumn("_open", F.when(gap < gap_minutes, 0.0).otherwise(1.0))
    h = running_sum(h, {"cluster_no": F.col("_open")}, ["currency"], order, blk)
    g = h.groupBy("currency", "cluster_no").agg(F.count(F.lit(1)).alias("events"), F.min("scheduled_time").alias("trigger_time"), F.max(i_news).alias("_i"))
    return g.withColumn("i_news", F.when(F.col("events") > 1, F.col("_i") * boost).otherwise(F.col("_i"))).drop("_i")


def alerts(calendar: DataFrame, now: str, i_news: str) -> DataFrame:
    at = F.lit(now).cast("timestamp")
    c = calendar.filter((F.col("impact") == "HIGH") & (F.col("scheduled_time") > at))
    return c.withColumn("seconds_to_event", F.unix_seconds("scheduled_time") - F.unix_seconds(at)).withColumn("i_news", F.col(i_news))


# ---------------------------------------------------------------- what the price did

def for_symbols(calendar: DataFrame, listed: Mapping[str, Sequence[str]]) -> DataFrame:
    """Each event once for each symbol that its currency moves; once without a symbol if it is not listed."""
    rows = [F.when(F.col("currency") == c, F.array(*map(F.lit, s))) for c, s in listed.items()]
    return calendar.withColumn("symbol", F.explode_outer(F.coalesce(*rows)))


def event_prices(calendar: DataFrame, prices: DataFrame, after_seconds: int = 300, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Last price at the event and ``after_seconds`` later, of the event's own ``by`` key."""
    by = list(by)
    p = prices.select(*by, F.col("ts").alias("_pt"), "last", "seq")
    c = calendar.withColumn("_later", F.col("scheduled_time") + F.expr(f"INTERVAL {after_seconds} SECONDS"))
    c = asof(c, p, "scheduled_time", "_pt", by, {"last": "price_at"}, tie="seq", block_seconds=3600)
    return asof(c, p, "_later", "_pt", by, {"last": "price_after"}, tie="seq", block_seconds=3600).drop("_later")


def directional_move(price_at: Column, price_after: Column, atr_h1: Column) -> Column:
    return (price_after - price_at) / F.greatest(atr_h1, F.lit(0.01))


def post_news_regime(move: Column, direction: Column, impulsive: float = 0.8, reversal: float = -0.5, against: float = 0.2) -> Column:
    bull, bear = direction == "BULLISH", direction == "BEARISH"
    return (
        F.when((bull & (move >= impulsive)) | (bear & (move <= -impulsive)), "IMPULSIVE_FOLLOW_THROUGH")
        .when(move <= reversal, "REVERSAL_AFTER_SPIKE")
        .when((bull & (move <= -against)) | (bear & (move >= against)), "REVERSAL_AFTER_SPIKE")
        .otherwise("CHOPPY_CONSOLIDATION")
    )


def event_impact(priced: DataFrame, prices: DataFrame, affected: DataFrame, horizons=(300, 900, 1800), around: int = 900, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Largest move after each event per horizon, its direction, and how many ``affected`` rows lie
    within ``around`` seconds; all within the same ``by`` key.

    Seconds with prices or ``affected`` rows are a row each, cut in blocks as long as the span that is looked
    through, once for each span. A span then is the end of one block and the start of the next, so running
    extremes and sums inside blocks, read at the span's two ends, are all that is needed: no event meets a
    price row in a join, and no row looks through a frame of others."""
    by, sec = list(by), F.unix_seconds("ts")
    px = prices.groupBy(*by, sec.alias("sec")).agg(F.max("last").alias("hi"), F.min("last").alias("lo"))
    af = affected.groupBy(*by, sec.alias("sec")).agg(F.count(F.lit(1)).alias("n"))
    ev = priced.select(*by, F.unix_seconds("scheduled_time").alias("sec"), "event_id", "price_at")
    far = horizons[-1]
    spans = [(h, 1, h) for h in horizons] + [(0, -around, around)]
    cut = [F.struct(F.lit(k).alias("span"), div(F.col("sec"), b - a + 1).alias("_b"), F.col("sec").alias("at"), F.lit(0).alias("end")) for k, a, b in spans]
    ends = []
    for k, a, b in spans:
        first, last = (F.struct(F.lit(k).alias("span"), div(F.col("sec") + x, b - a + 1).alias("_b"), (F.col("sec") + x).alias("at"), F.lit(end).alias("end")) for x, end in ((a, 1), (b, 2)))
        # a span that is one block is read at its last second alone
        ends += [F.when(first["_b"] != last["_b"], first), last]
    seen = px.withColumn("_s", F.explode(F.array(*cut[:-1]))).unionByName(af.withColumn("_s", cut[-1]), allowMissingColumns=True)
    own = ev.select(*by, "sec").distinct().withColumn("_s", F.explode(F.array_compact(F.array(*ends))))
    rows = seen.unionByName(own, allowMissingColumns=True).select(*by, "sec", "hi", "lo", "n", "_s.*")
    start = Window.partitionBy(*by, "span", "_b").orderBy("at")
    rest = Window.partitionBy(*by, "span", "_b").orderBy(F.col("at").desc())
    found = {c: F.when(F.col("end") == 1, f(c).over(rest)).otherwise(f(c).over(start)) for c, f in (("hi", F.max), ("lo", F.min), ("n", F.sum))}
    read = rows.select(*by, "sec", "span", "end", *[x.alias(c) for c, x in found.items()]).filter("end > 0")
    of = lambda k, c: F.when(F.col("span") == k, F.col(c))
    at = read.groupBy(*[F.col(c).alias("_" + c) for c in [*by, "sec"]]).agg(*[x for h in horizons for x in (F.max(of(h, "hi")).alias(f"_u{h}"), F.min(of(h, "lo")).alias(f"_d{h}"))], F.coalesce(F.sum(of(0, "n")), F.lit(0)).alias("affected"))
    same = F.lit(True)
    for c in [*by, "sec"]:
        same = same & F.col(c).eqNullSafe(F.col("_" + c))
    r = ev.join(at, same)
    for h in horizons:
        r = r.withColumns({f"_u{h}": F.col(f"_u{h}") - F.col("price_at"), f"_d{h}": F.col("price_at") - F.col(f"_d{h}")})
    return r.select("event_id", *by, *[F.greatest(F.col(f"_u{h}"), F.col(f"_d{h}"), F.lit(0.0)).alias(f"max_move_{h // 60}m") for h in horizons],
                    F.when(F.col(f"_u{far}") > F.col(f"_d{far}"), 1).when(F.col(f"_u{far}") < F.col(f"_d{far}"), -1).otherwise(0).alias("direction"), "affected")


def merge_streams(ticks: DataFrame, calendar: DataFrame) -> DataFrame:
    """Ticks and events on one time axis; an event sorts before a tick of the same instant."""
    e = calendar.select(F.col("scheduled_time").alias("ts"), F.lit(0).alias("kind"), F.col("event_id").alias("id"))
    t = ticks.select("ts", F.lit(1).alias("kind"), F.col("seq").alias("id"), "symbol", "last")
    return e.unionByName(t, allowMissingColumns=True)


def outcome_statistics(classified: DataFrame) -> DataFrame:
    """Count, mean and largest absolute move by class, plus the total row, in one pass."""
    return classified.rollup("regime").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs("move")).alias("avg_move"), F.max(F.abs("move")).alias("max_move")
    ).withColumn("regime", F.coalesce("regime", F.lit("ALL")))
