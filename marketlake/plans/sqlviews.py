"""Shared views for the SQL twins, written independently of the Spark operators."""

from __future__ import annotations

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def view(name: str, sql: str, use: tuple[str, ...] = (), recursive: bool = False) -> None:
    VIEWS[name] = (use, sql)


def with_views(use: tuple[str, ...], body: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in VIEWS[n][0]:
            visit(d)
        order.append(n)

    for n in use:
        visit(n)
    if order and body.lstrip().startswith(","):
        body = body.lstrip()
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in order) + "\n" + body


def R(expr: str, digits: int = 6) -> str:
    return f"(round(({expr})::double, {digits}) + 0.0::double)"


view("ticks", """
SELECT event_type AS symbol, ts, event_id AS seq,
       100 + value - 0.01 * (1 + k % 5) AS bid, 100 + value + 0.01 * (1 + k % 5) AS ask,
       CASE k % 3 WHEN 0 THEN 100 + value + 0.01 * (1 + k % 5)
                  WHEN 1 THEN 100 + value - 0.01 * (1 + k % 5) ELSE 100 + value END AS last,
       (1 + k % 20)::double AS volume
FROM (SELECT *, cast(json_extract(props, '$.k') AS integer) AS k FROM events)""")

view("ticks_prev", """
SELECT *, lag(last) OVER (PARTITION BY symbol ORDER BY ts, seq) AS prev_last,
       lag(ts) OVER (PARTITION BY symbol ORDER BY ts, seq) AS prev_ts,
       (ask - bid) * 10000 AS spread_pips FROM ticks""", ("ticks",))

view("enriched", """
SELECT *, CASE aggressor WHEN 'BUY' THEN volume WHEN 'SELL' THEN -volume ELSE 0.0 END AS raw_delta,
       CASE WHEN spread_pips > 500 THEN 0.0 WHEN aggressor = 'BUY' THEN volume
            WHEN aggressor = 'SELL' THEN -volume ELSE 0.0 END AS delta
FROM (SELECT *, CASE WHEN last < prev_last AND last <= bid * 1.0001 THEN 'SELL'
                     WHEN last > prev_last AND last >= ask * 0.9999 THEN 'BUY'
                     WHEN last >= ask THEN 'BUY' WHEN last <= bid THEN 'SELL' ELSE 'UNKNOWN' END AS aggressor
      FROM ticks_prev)""", ("ticks_prev",))


def _tick_bars(tf: str, secs: int) -> str:
    return f"""
SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bucket) - 1 AS bar_no, '{tf}' AS tf FROM (
SELECT symbol, cast(floor(epoch(ts) / {secs}) * {secs} AS bigint) AS bucket,
       arg_min(last, struct_pack(a := ts, b := seq)) AS open, max(last) AS high, min(last) AS low,
       arg_max(last, struct_pack(a := ts, b := seq)) AS close, sum(volume) AS volume, count(*) AS tick_count,
       sum(CASE WHEN delta > 0 THEN delta ELSE 0 END) AS buy_volume,
       sum(CASE WHEN delta < 0 THEN -delta ELSE 0 END) AS sell_volume, sum(delta) AS cvd,
       avg(spread_pips) AS spread
FROM enriched GROUP BY 1, 2)"""


for _tf, _s in (("M1", 60), ("M5", 300), ("M15", 900), ("H1", 3600), ("H4", 14400), ("D1", 86400)):
    view(f"bars_{_tf.lower()}", _tick_bars(_tf, _s), ("enriched",))

view("bars_all", " UNION ALL BY NAME ".join(f"SELECT * FROM bars_{t}" for t in ("m1", "m5", "m15", "h1", "h4", "d1")),
     tuple(f"bars_{t}" for t in ("m1", "m5", "m15", "h1", "h4", "d1")))

view("day_trades", """
SELECT l_returnflag || l_linestatus AS symbol, l_shipdate AS ts, l_extendedprice / l_quantity AS last,
       l_quantity AS volume,
       row_number() OVER (PARTITION BY l_returnflag, l_linestatus, l_shipdate
            ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS seq
FROM lineitem""")

view("day_bars", """
SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bucket) - 1 AS bar_no, 'D1' AS tf FROM (
SELECT symbol, cast(epoch(ts) AS bigint) AS bucket, arg_min(last, seq) AS open, max(last) AS high,
       min(last) AS low, arg_max(last, seq) AS close, sum(volume) AS volume, count(*) AS tick_count
FROM day_trades GROUP BY 1, 2)""", ("day_trades",))

view("calendar", """
SELECT *, lag(actual) OVER (PARTITION BY currency ORDER BY scheduled_time, event_id) AS forecast FROM (
SELECT event_id, 'EV' || (k % 8) AS title,
       CASE k % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'GBP' ELSE 'JPY' END AS currency,
       CASE k % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS impact,
       ts AS scheduled_time, value AS actual
FROM (SELECT *, cast(json_extract(props, '$.k') AS integer) AS k FROM events WHERE event_type = 'signup'))""")

view("predictions", """
SELECT o_orderkey AS prediction_id, o_orderdate AS bar_close_time,
       ['AF','AO','NF','NO','RF','RO'][cast(o_orderkey % 6 AS integer) + 1] AS symbol,
       a, b, a / (a + b + c) AS p_bsl, b / (a + b + c) AS p_ssl, c / (a + b + c) AS p_lateral,
       CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS label,
       o_orderpriority AS regime, o_custkey AS client
FROM (SELECT *, (1 + o_orderkey % 97)::double AS a, (1 + o_custkey % 89)::double AS b,
             (1 + (o_orderkey * 7) % 83)::double AS c FROM orders)""")

view("levelled", """
SELECT p.*, d.bar_no, d.close AS ref_close, d.close * (1 + a / 1000) AS predicted_bsl_level,
       d.close * (1 - b / 1000) AS predicted_ssl_level
FROM predictions p ASOF LEFT JOIN
     (SELECT symbol, bar_no, close, to_timestamp(bucket + 86400) AT TIME ZONE 'UTC' AS closed_at FROM day_bars) d
  ON p.symbol = d.symbol AND p.bar_close_time >= d.closed_at""", ("predictions", "day_bars"))

view("trades", """
SELECT *, l_returnflag || l_linestatus AS symbol, l_extendedprice * (l_discount - l_tax) AS pnl, l_quantity AS hold_bars
FROM lineitem""")


def wilder(table: str, inputs: dict[str, str], n: int = 14, first: int = 0, warm: bool = False, keep: float | None = None, gain: float | None = None) -> str:
    """Closed form of y = keep*y_prev + gain*x with a mean seed, over whole series."""
    keep = (n - 1) / n if keep is None else keep
    gain = 1 / n if gain is None else gain
    seed = first + n - 1
    out = []
    for name, x in inputs.items():
        s = f"avg({x}) FILTER (WHERE bar_no BETWEEN {first} AND {seed}) OVER (PARTITION BY symbol)"
        tail = (f"sum(CASE WHEN bar_no > {seed} THEN ({x}) * {gain!r} * pow({keep!r}, -(bar_no - {seed})) ELSE 0 END) "
                f"OVER (PARTITION BY symbol ORDER BY bar_no)")
        y = f"pow({keep!r}, bar_no - {seed}) * ({s} + {tail})"
        early = f"WHEN bar_no >= {first} THEN avg({x}) FILTER (WHERE bar_no >= {first}) OVER (PARTITION BY symbol ORDER BY bar_no)" if warm else ""
        out.append(f"CASE WHEN bar_no >= {seed} THEN {y} {early} END AS {name}")
    return f"SELECT *, {', '.join(out)} FROM {table}"


def tr_view(table: str) -> str:
    return f"""SELECT *, CASE WHEN pc IS NULL THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr
FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY bar_no) AS pc, lag(high) OVER (PARTITION BY symbol ORDER BY bar_no) AS ph,
             lag(low) OVER (PARTITION BY symbol ORDER BY bar_no) AS pl, lag(open) OVER (PARTITION BY symbol ORDER BY bar_no) AS po FROM {table})"""


for _n, _b in (("day", "day_bars"), ("h1", "bars_h1")):
    view(f"{_n}_tr", tr_view(_b), (_b,))
    view(f"{_n}_atr", wilder(f"{_n}_tr", {"atr": "tr"}, 14, 0, True), (f"{_n}_tr",))
view("m5_tr", tr_view("bars_m5"), ("bars_m5",))
view("m5_atr", wilder("m5_tr", {"atr": "tr"}, 14, 0, True), ("m5_tr",))
