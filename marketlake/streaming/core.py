"""Structured Streaming forms of the bar, flow, structure and outcome operators.

State lives per key; a micro-batch is bounded by the files per trigger, so the rows of one key in
one batch are sorted in memory, by event time whatever the order of their files. Everything older is state of fixed size.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from marketlake.functions import ticks as fn
from marketlake.schemas import TIMEFRAMES

# ---------------------------------------------------------------- running a query


def _resumed(start: Callable, steps: Sequence[Callable[[], None]]) -> list[dict]:
    """Let each step's files arrive and process what is there, from the checkpoint on."""
    progress: list[dict] = []
    for arrive in steps or [lambda: None]:
        arrive()
        q = start()
        q.awaitTermination()
        progress += [json.loads(p.json) if hasattr(p, "json") and isinstance(p.json, str) else p for p in q.recentProgress]
    return progress


def run_available(stream: DataFrame, path: str, mode: str = "append", steps: Sequence[Callable[[], None]] = ()) -> list[dict]:
    """Process what is there, write Parquet, and return the progress records. With ``steps`` the query is
    resumed after each of them."""
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", path + "/_checkpoint").option("path", path + "/data").trigger(availableNow=True)
    return _resumed(w.start, steps)


def run_batches(stream: DataFrame, path: str, fn_: Callable[[DataFrame, int], None], mode: str = "append", steps: Sequence[Callable[[], None]] = ()) -> None:
    """Process what is there through ``foreachBatch``; ``steps`` as above."""
    _resumed(stream.writeStream.outputMode(mode).option("checkpointLocation", path + "/_checkpoint").foreachBatch(fn_).trigger(availableNow=True).start, steps)


def append_batch(path: str) -> Callable[[DataFrame, int], None]:
    """Sink of one folder per batch. A repeated batch overwrites its own folder, so nothing doubles."""
    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return write


def latest_table(spark: SparkSession, path: str, keys: list[str], version: str) -> DataFrame:
    """Latest-wins view over the batches written so far."""
    from marketlake.sources.io import latest_per_key

    df = spark.read.parquet(path)
    return latest_per_key(df, keys, F.struct(F.col(version), F.col("batch"))).drop("batch")


# ---------------------------------------------------------------- bars

def bars_stream(ticks: DataFrame, tf: str, delay: str = "10 seconds") -> DataFrame:
    """Tumbling bars. In append mode a row is a closed bar, in update mode the forming one.

    Ticks older than the watermark are dropped and counted by Spark."""
    t = ticks.withWatermark("ts", delay).withColumn("_ord", fn.tick_order(F.col("ts"), F.col("seq")))
    g = t.groupBy("symbol", F.window("ts", f"{TIMEFRAMES[tf]} seconds").alias("_w")).agg(
        F.min_by("last", "_ord").alias("open"), F.max("last").alias("high"), F.min("last").alias("low"), F.max_by("last", "_ord").alias("close"),
        F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("tick_count"))
    return g.select("symbol", F.lit(tf).alias("tf"), F.unix_seconds("_w.start").alias("bucket"), "open", "high", "low", "close", "volume", "tick_count")


def late_rows(fed: DataFrame, bars: DataFrame, tf: str) -> DataFrame:
    """(symbol, closed, dropped): rows of ``fed`` that closed bars hold, and rows of the same buckets that came after the
    watermark had passed them. Rows of bars still forming are in neither."""
    sec = F.unix_seconds("ts")
    bucket = sec - F.pmod(sec, F.lit(TIMEFRAMES[tf]))
    n = fed.groupBy("symbol", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    j = bars.select("symbol", "bucket", "tick_count").join(n, ["symbol", "bucket"])
    return j.groupBy("symbol").agg(F.sum("tick_count").alias("closed"), F.sum(F.col("n") - F.col("tick_count")).alias("dropped"))


def sorted_rows(batches: Iterator[pd.DataFrame], *order: str) -> pd.DataFrame:
    """Rows of one key in this micro-batch, in order."""
    return pd.concat(list(batches), ignore_index=True).sort_values(list(order), kind="stable", ignore_index=True)


# ---------------------------------------------------------------- order flow

FLOW_OUT = "symbol string, seq long, bucket long, aggressor string, delta double, cvd double, run_volume double"


def flow_stream(ticks: DataFrame, tf: str = "H1", spread_limit: float = 500.0) -> DataFrame:
    """Aggressor, signed volume and the running delta of the bar, per symbol across batches.

    State: previous price, current bucket, its delta and volume."""
    step = TIMEFRAMES[tf]

    def fold(key, batches, state):
        prev, bucket, cvd, vol = state.get if state.exists else (float("nan"), -1, 0.0, 0.0)
        d = sorted_rows(batches, "ts", "seq")
        last, bid, ask, v = (d[c].to_numpy() for c in ("last", "bid", "ask", "volume"))
        before = np.concatenate(([prev], last[:-1]))
        quote = np.where(last >= ask, 1, np.where(last <= bid, -1, 0))
        side = np.where((last < before) & (last <= bid * 1.0001), -1, np.where((last > before) & (last >= ask * 0.9999), 1, quote))
        delta = np.where((ask - bid) * 10000 > spread_limit, 0.0, side * v)
        sec = d["ts"].to_numpy().astype("datetime64[s]").astype("int64")
        b = sec - sec % step
        run, runv = np.cumsum(delta), np.cumsum(v)
        starts = np.concatenate(([b[0] != bucket], b[1:] != b[:-1]))
        first = np.maximum.accumulate(np.where(starts, np.arange(len(b)), 0))
        base, basev = run[first] - delta[first], runv[first] - v[first]
        carried = np.cumsum(starts) == 0
        run, runv = np.where(carried, run + cvd, run - base), np.where(carried, runv + vol, runv - basev)
        state.update((float(last[-1]), int(b[-1]), float(run[-1]), float(runv[-1])))
        yield pd.DataFrame({"symbol": key[0], "seq": d["seq"], "bucket": b, "aggressor": np.where(side > 0, "BUY", np.where(side < 0, "SELL", "UNKNOWN")),
                            "delta": delta + 0.0, "cvd": run + 0.0, "run_volume": runv})

    return ticks.select("symbol", "ts", "seq", "bid", "ask", "last", "volume").groupBy("symbol").applyInPandasWithState(
        fold, FLOW_OUT, "prev double, bucket long, cvd double, vol double", "append", GroupStateTimeout.NoTimeout)


# ---------------------------------------------------------------- structure

STRUCT_OUT = "symbol string, kind string, up boolean, bar_no long, near double, far double"


def structure_stream(bars: DataFrame) -> DataFrame:
    """Swings and three-bar gaps as bars close, per (symbol, tf).

    State: the last two bars, whether the last one left an open gap, and per side the value before
    the current run of equal highs or lows."""
    def fold(key, batches, state):
        s = list(state.get) if state.exists else None
        out = []
        for no, h, l in sorted_rows(batches, "bar_no")[["bar_no", "high", "low"]].itertuples(index=False):  # noqa: E741
            if s is None:
                s = [h, l, None, None, False, None, None]
                continue
            h1, l1, h2, l2, gap1, rh, rl = s
            if h != h1:
                if rh is not None and h1 > rh and h1 > h:
                    out.append((key[0], "SWING", True, no - 1, h1, h1))
                rh = h1
            if l != l1:
                if rl is not None and l1 < rl and l1 < l:
                    out.append((key[0], "SWING", False, no - 1, l1, l1))
                rl = l1
            gap = l > h1 or h < l1
            if h2 is not None and not gap and not gap1:
                if l > h2:
                    out.append((key[0], "FVG", True, no, l, h2))
                elif h < l2:
                    out.append((key[0], "FVG", False, no, h, l2))
            s = [h, l, h1, l1, gap, rh, rl]
        state.update(tuple(s))
        yield pd.DataFrame(out, columns=["symbol", "kind", "up", "bar_no", "near", "far"])

    return bars.select("symbol", "tf", "bar_no", "high", "low").groupBy("symbol", "tf").applyInPandasWithState(
        fold, STRUCT_OUT, "h1 double, l1 double, h2 double, l2 double, gap boolean, rh double, rl double", "append", GroupStateTimeout.NoTimeout)


# ---------------------------------------------------------------- outcomes

OUTCOME_OUT = "prediction_id long, outcome string, outcome_no long"


def settle(bars: pd.DataFrame, ids: np.ndarray, born: np.ndarray, up: np.ndarray, down: np.ndarray, horizon: int) -> tuple[pd.DataFrame, np.ndarray]:
    """Outcomes that ``bars`` settle, and which predictions they do. Each looks at its next bars one by one, all
    predictions at once: after at most ``horizon`` bars all of them are settled."""
    no, first = np.unique(bars["bar_no"].to_numpy("int64"), return_index=True)
    high, low = bars["high"].to_numpy("float64")[first], bars["low"].to_numpy("float64")[first]
    done, out = np.zeros(len(ids), dtype=bool), []
    place, left = np.searchsorted(no, born, "right"), np.arange(len(ids))
    while len(left := left[place[left] < len(no)]):
        at = place[left]
        hit_up, hit_dn = high[at] >= up[left], low[at] <= down[left]
        over = hit_up | hit_dn | (no[at] >= born[left] + horizon)
        names = np.where(hit_up, "BSL_HIT", np.where(hit_dn, "SSL_HIT", "TIMEOUT"))
        out.append(pd.DataFrame({"prediction_id": ids[left[over]], "outcome": names[over].astype(object), "outcome_no": no[at[over]]}))
        done[left[over]] = True
        left = left[~over]
        place[left] += 1
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame(), done


def outcome_stream(rows: DataFrame, horizon: int = 240, shards: int = 64) -> DataFrame:
    """Resolve pending predictions as bars close. ``rows`` mixes bars (kind 0) and predictions (kind 1);
    a prediction waits for bars after its own ``bar_no``.

    State: the pending predictions of a shard of the symbol, none older than the horizon. A shard gets all bars of its
    symbol, which the calendar bounds, and the predictions that a hash of their id deals to it."""
    def fold(key, batches, state):
        ids, born, up, down = (np.array(x) for x in state.get) if state.exists else (np.array([], "int64"), np.array([], "int64"), np.array([]), np.array([]))
        d = sorted_rows(batches, "bar_no", "kind")
        d = d[d["bar_no"].notna()]
        new = d[d["kind"] == 1]
        ids, born = np.append(ids, new["prediction_id"].to_numpy("int64")).astype("int64"), np.append(born, new["bar_no"].to_numpy("int64")).astype("int64")
        up, down = (np.append(x, new[c].to_numpy("float64")).astype("float64") for x, c in ((up, "predicted_bsl_level"), (down, "predicted_ssl_level")))
        out, done = settle(d[d["kind"] == 0], ids, born, up, down, horizon)
        state.update(tuple(x[~done].tolist() for x in (ids, born, up, down)))
        if len(out):
            yield out

    cols = ["symbol", "kind", "bar_no", "high", "low", "prediction_id", "predicted_bsl_level", "predicted_ssl_level"]
    own = F.array(F.pmod(F.xxhash64("prediction_id"), F.lit(shards)).cast("int"))
    dealt = rows.select(*cols, F.explode(F.when(F.col("kind") == 0, F.sequence(F.lit(0), F.lit(shards - 1))).otherwise(own)).alias("shard"))
    return dealt.groupBy("symbol", "shard").applyInPandasWithState(
        fold, OUTCOME_OUT, "ids array<long>, born array<long>, up array<double>, down array<double>", "append", GroupStateTimeout.NoTimeout)


# ---------------------------------------------------------------- control

def min_gap(rows: DataFrame, key: str, seconds: float) -> DataFrame:
    """Keep a row only if the last kept row of its key is at least ``seconds`` older. State: that time."""
    us = int(seconds * 1e6)

    def fold(k, batches, state):
        last = state.get[0] if state.exists else None
        keep = []
        d = sorted_rows(batches, "t", "seq")
        for t, seq in zip(d["t"].to_numpy(), d["seq"].to_numpy()):
            if last is None or t - last >= us:
                last = int(t)
                keep.append((k[0], int(seq), last))
        state.update((last,))
        yield pd.DataFrame(keep, columns=["key", "seq", "t"])

    r = rows.select(F.col(key).alias("key"), "seq", F.unix_micros("ts").alias("t"))
    return r.groupBy("key").applyInPandasWithState(fold, "key string, seq long, t long", "last long", "append", GroupStateTimeout.NoTimeout)


def staleness(ticks: DataFrame, seconds: int = 30, delay: str = "10 seconds") -> DataFrame:
    """Alert when event time moves ``seconds`` past the last tick of a symbol. State: last tick time."""
    def fold(k, batches, state):
        if state.hasTimedOut:
            last = state.get[0]
            state.remove()
            yield pd.DataFrame({"symbol": [k[0]], "last_us": [last]})
            return
        newest = max(int(p["t"].max()) for p in batches)
        last = max(newest, state.get[0]) if state.exists else newest
        state.update((last,))
        due = last // 1000 + seconds * 1000
        if due > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(due)
        else:
            state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + 1)

    r = ticks.withWatermark("ts", delay).select("symbol", "ts", F.unix_micros("ts").alias("t"))
    return r.groupBy("symbol").applyInPandasWithState(fold, "symbol string, last_us long", "last long", "append", GroupStateTimeout.EventTimeTimeout)


PROGRESS_OUT = "symbol string, imb_no long, status string, bar_no long"


def zone_stream(rows: DataFrame) -> DataFrame:
    """One-way status of zones as bars close: touched, half, wick filled, body filled.

    ``rows`` mixes bars (kind 0) and zones (kind 1, known at ``bar_no``); filled zones leave the state."""
    names = np.array(["UNMITIGATED", "WICK_TOUCHED", "WICK_FILLED_HALF", "WICK_FILLED", "BODY_FILLED"])

    def fold(key, batches, state):
        z = np.array(state.get[0], dtype=float).reshape(-1, 6) if state.exists else np.empty((0, 6))
        out = []
        d = sorted_rows(batches, "bar_no", "kind")
        for no, g in d.groupby("bar_no", sort=True):
            bar = g[g["kind"] == 0]
            if len(bar) and len(z):
                h, l, o, c = (float(bar[x].iloc[0]) for x in ("high", "low", "open", "close"))  # noqa: E741
                bull, near, mid, far, level = z[:, 1] > 0, z[:, 2], z[:, 3], z[:, 4], z[:, 5]
                wick, body = np.where(bull, -l, h), np.where(bull, -min(o, c), max(o, c))
                sign = np.where(bull, -1.0, 1.0)
                deep = np.select([body >= sign * far, wick >= sign * far, wick >= sign * mid, wick > sign * near], [4, 3, 2, 1], 0)
                moved = deep > level
                out.append(pd.DataFrame({"imb_no": z[moved, 0].astype("int64"), "status": names[deep[moved]], "bar_no": no}))
                z[:, 5] = np.maximum(level, deep)
                z = z[z[:, 5] < 4]
            new = g[g["kind"] == 1]
            if len(new):
                add = np.column_stack([new["imb_no"].astype(float), new["is_bullish"].astype(float), new["near"], new["middle"], new["far"], np.zeros(len(new))])
                z = np.vstack([z, add])
        state.update((z.ravel().tolist(),))
        if out:
            yield pd.concat(out, ignore_index=True).assign(symbol=key[0])[["symbol", "imb_no", "status", "bar_no"]]

    cols = ["symbol", "kind", "bar_no", "open", "high", "low", "close", "imb_no", "is_bullish", "near", "middle", "far"]
    return rows.select(*cols).groupBy("symbol").applyInPandasWithState(fold, PROGRESS_OUT, "z array<double>", "append", GroupStateTimeout.NoTimeout)
