"""Moves after events from block extremes, next to a plain loop; no window looks through a frame of seconds."""

import datetime as dt
import random

from marketlake.operators import macro as M

T0 = 1_704_067_200


def at(s):
    return dt.datetime.fromtimestamp(s, dt.timezone.utc)


def test_event_impact_plain(spark):
    g = random.Random(2)
    ticks = [(g.choice("XY"), T0 + g.randrange(0, 3000), float(g.randrange(50, 150))) for _ in range(1500)]
    events = [(k, g.choice(["X", "Y", "Z", None]), T0 + g.randrange(-50, 3100) if k % 40 else None, float(g.randrange(80, 120)) if k % 9 else None) for k in range(200)]
    events += events[:3]
    t = spark.createDataFrame([(s, at(x), v) for s, x, v in ticks] + [(None, at(T0 + 5), 99.0), ("X", None, 500.0)], "symbol string, ts timestamp, last double")
    e = spark.createDataFrame([(k, s, x and at(x), p) for k, s, x, p in events], "event_id long, symbol string, scheduled_time timestamp, price_at double")
    d = M.event_impact(e, t, t, (60, 180, 600), 100)
    rows = [(r["event_id"], r["symbol"], r["max_move_1m"], r["max_move_3m"], r["max_move_10m"], r["direction"], r["affected"]) for r in d.collect()]
    ticks += [(None, T0 + 5, 99.0), ("X", None, 500.0)]
    plain = []
    for k, s, x, p in events:
        own = [(y, v) for z, y, v in ticks if z == s]
        if x is None:
            seen = {h: [v for y, v in own if y is None] for h in (60, 180, 600)}
            n = len(seen[60])
        else:
            seen = {h: [v for y, v in own if y is not None and x < y <= x + h] for h in (60, 180, 600)}
            n = sum(y is not None and x - 100 <= y <= x + 100 for y, _ in own)
        up, down = ({h: f(v) if v and p is not None else None for h, v in seen.items()} for f in (lambda v: max(v) - p, lambda v: p - min(v)))
        u, w = up[600], down[600]
        plain.append((k, s, *(max(up[h] or 0.0, down[h] or 0.0, 0.0) for h in (60, 180, 600)), 0 if u is None or u == w else 1 if u > w else -1, n))
    assert sorted(rows, key=str) == sorted(plain, key=str)


def test_event_impact_has_no_sliding_frames(spark, capsys):
    t = spark.createDataFrame([("X", at(T0), 1.0)], "symbol string, ts timestamp, last double")
    e = spark.createDataFrame([(1, "X", at(T0), 1.0)], "event_id long, symbol string, scheduled_time timestamp, price_at double")
    M.event_impact(e, t, t).explain(True)
    plan = capsys.readouterr().out
    frames = {p.split(")")[0] for p in plan.split("specifiedwindowframe(")[1:]}
    assert frames and all("unboundedpreceding" in f for f in frames)
