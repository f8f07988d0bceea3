"""Shared helpers against brute force on small random data."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketlake.operators import smoothing
from marketlake.operators.asof import asof, asof_each
from marketlake.operators.blocks import number_rows, over_blocks, running_sum, time_block, with_previous
from marketlake.operators.first_passage import first_passage
from marketlake.operators.ranks import exact_quantiles, spearman


def series(spark, n=500, seed=1):
    g = np.random.default_rng(seed)
    rows = [(s, "M1", i, float(v)) for s in ("A", "B") for i, v in enumerate(np.round(g.normal(0, 3, n).cumsum(), 1))]
    return spark.createDataFrame(rows, "symbol string, tf string, bar_no long, v double"), pd.DataFrame(rows, columns=["symbol", "tf", "bar_no", "v"])


@pytest.mark.parametrize("above,strict,within", [(True, True, None), (False, False, None), (True, False, 7), (False, True, 64), (True, True, 200)])
def test_first_passage(spark, above, strict, within):
    df, pdf = series(spark, 9000 if within is None else 600)
    lv = df.filter(F.col("bar_no") % 37 == 0).withColumnRenamed("bar_no", "at").withColumnRenamed("v", "level")
    got = first_passage(lv, df, F.col("level"), F.col("v"), F.col("at") + 1, above, strict, within).toPandas()
    vals = {s: g["v"].to_numpy() for s, g in pdf.groupby("symbol")}
    for r in got.itertuples():
        seg = vals[r.symbol][r.at + 1:][:within]
        ok = {(True, True): seg > r.level, (True, False): seg >= r.level, (False, True): seg < r.level, (False, False): seg <= r.level}[above, strict]
        want = r.at + 1 + ok.argmax() if ok.any() else None
        assert (None if pd.isna(r.hit_no) else r.hit_no) == want


@pytest.mark.parametrize("direction,inclusive", [("backward", True), ("backward", False), ("forward", True), ("forward", False)])
def test_asof(spark, direction, inclusive):
    g = np.random.default_rng(3)
    left = pd.DataFrame({"k": g.choice(list("ab"), 300), "i": range(300), "sec": g.integers(0, 40000, 300)})
    right = pd.DataFrame({"k": g.choice(list("ab"), 60), "j": range(60), "sec": g.choice(40000, 60, replace=False)})
    right.loc[:20, "sec"] = left["sec"][:21].drop_duplicates().reindex(range(21)).fillna(1).astype(int)
    right = right.drop_duplicates(["k", "sec"])
    ts = F.timestamp_seconds("sec")
    got = asof(spark.createDataFrame(left).withColumn("t", ts), spark.createDataFrame(right).withColumn("t", ts), "t", "t", ["k"], {"j": "j"}, direction, inclusive, block_seconds=3600).toPandas()
    for r in got.itertuples():
        c = right[right["k"] == r.k]
        c = c[(c["sec"] <= r.sec if inclusive else c["sec"] < r.sec) if direction == "backward" else (c["sec"] >= r.sec if inclusive else c["sec"] > r.sec)].sort_values("sec")
        want = None if c.empty else c["j"].iloc[-1 if direction == "backward" else 0]
        assert (None if pd.isna(r.j) else int(r.j)) == want


def test_asof_each_carries_values_apart(spark):
    left = spark.createDataFrame([("a", 100000), ("a", 10)], "k string, sec long").withColumn("t", F.timestamp_seconds("sec"))
    right = spark.createDataFrame([("a", 5, "x", 1), ("a", 90000, "y", 2)], "k string, sec long, n string, v int").withColumn("t", F.timestamp_seconds("sec"))
    got = asof_each(left, right, "t", "t", ["k"], {n: F.when(F.col("n") == n, F.col("v")) for n in "xy"}, 3600)
    assert sorted((r.sec, r.x, r.y) for r in got.collect()) == [(10, 1, None), (100000, 1, 2)]


@pytest.mark.parametrize("n", [2, 5, 14])
def test_smoothing_is_the_recursion(spark, n):
    df, pdf = series(spark, 2000)
    got = smoothing.wilder(df, {"y": F.col("v")}, n, warmup_mean=True).toPandas().sort_values(["symbol", "bar_no"])
    for s, g in pdf.groupby("symbol"):
        y = []
        for i, x in enumerate(g["v"]):
            y.append(np.mean(g["v"][: i + 1]) if i < n else (y[-1] * (n - 1) + x) / n)
        assert np.allclose(got[got["symbol"] == s]["y"], y, atol=1e-9)


def test_ema_seed_and_nulls(spark):
    df, pdf = series(spark, 1500)
    got = smoothing.exponential(df, {"y": F.col("v")}, 9).toPandas().sort_values(["symbol", "bar_no"])
    g = pdf[pdf["symbol"] == "A"]["v"].to_numpy()
    y, a = [np.nan] * 8 + [g[:9].mean()], 0.2
    for x in g[9:]:
        y.append(a * x + (1 - a) * y[-1])
    assert np.allclose(got[got["symbol"] == "A"]["y"].to_numpy(dtype=float), y, equal_nan=True, atol=1e-9)


def test_block_windows_match_plain_windows(spark):
    df, pdf = series(spark, 300)
    got = over_blocks(df, 3, lambda d, w: d.withColumn("m", F.sum("v").over(w.rowsBetween(-3, 2))), lookahead=2, size=16).toPandas()
    assert len(got) == len(pdf)
    for s, g in pdf.groupby("symbol"):
        v = g["v"].to_numpy()
        want = [v[max(0, i - 3):i + 3].sum() for i in range(len(v))]
        assert np.allclose(got[got["symbol"] == s].sort_values("bar_no")["m"], want)


def test_carried_order_helpers(spark):
    g = np.random.default_rng(5)
    pdf = pd.DataFrame({"k": g.choice(list("ab"), 400), "sec": g.integers(0, 50000, 400), "x": g.integers(0, 9, 400).astype(float), "seq": range(400)}).sort_values(["sec", "seq"])
    df = spark.createDataFrame(pdf).withColumn("ts", F.timestamp_seconds("sec"))
    blk = time_block(F.col("ts"), 3600)
    rows = number_rows(with_previous(running_sum(df, {"run": F.col("x")}, ["k"], ["ts", "seq"], blk), ["x"], ["k"], ["ts", "seq"], blk), ["k"], ["ts", "seq"], blk, "no").toPandas()
    for k, d in pdf.groupby("k"):
        got = rows[rows["k"] == k].sort_values("no")
        assert list(got["seq"]) == list(d["seq"])
        assert np.allclose(got["run"], d["x"].cumsum())
        assert np.allclose(got["prev_x"].to_numpy(dtype=float)[1:], d["x"].to_numpy()[:-1])


def test_quantiles_and_rank_correlation(spark):
    g = np.random.default_rng(9)
    pdf = pd.DataFrame({"k": g.choice(list("ab"), 3000), "x": np.where(g.random(3000) < 0.4, 1.0, np.round(g.normal(size=3000), 2)), "y": g.integers(0, 3, 3000).astype(float)})
    df = spark.createDataFrame(pdf)
    q = {r.k: r.quantiles for r in exact_quantiles(df, "x", ["k"], [0, 0.1, 0.5, 0.77, 1.0]).collect()}
    ic = {r.k: r.ic for r in spearman(df, "x", "y", ["k"]).collect()}
    for k, d in pdf.groupby("k"):
        assert np.allclose(q[k], np.quantile(d["x"], [0, 0.1, 0.5, 0.77, 1.0]))
        assert abs(ic[k] - d["x"].rank().corr(d["y"].rank())) < 1e-9
    assert spearman(df.limit(2), "x", "y").first().ic == 0.0


def test_quantiles_by_cells(spark):
    rng = np.random.default_rng(5)
    wide = [5e-324 * k for k in range(9)] + [2.0**k for k in range(-300, 300, 7)] + [-1.7e308, 1.7e308] + [3.25] * 500
    sets = {"even": rng.uniform(-5, 5, 3000).tolist(), "wide": wide, "one": [7.0] * 50, "single": [1.5], "ints": [float(x) for x in rng.integers(0, 4, 999)]}
    rows = [(k, x, "clash") for k, xs in sets.items() for x in xs] + [("even", None, None), (None, 1.0, None), ("ends", float("-inf"), ""), ("ends", 2.0, ""), ("ends", float("inf"), ""), ("ends", float("nan"), "")]
    df = spark.createDataFrame(rows, "k string, x double, _v string")
    probs = [0, 0.05, 1 / 3, 0.5, 0.999, 1.0]
    found = {r.k: r.quantiles for r in exact_quantiles(df, "x", ["k"], probs).collect()}
    assert set(found) == {*sets, "ends"}
    for k, xs in sets.items():
        ordered = sorted(xs)
        for p, q in zip(probs, found[k], strict=True):
            at = p * (len(xs) - 1)
            a, b = ordered[int(at)], ordered[min(int(at) + 1, len(xs) - 1)]
            assert q == pytest.approx(a * (1 - at % 1) + b * (at % 1), rel=1e-12)
    assert found["ends"][0] == float("-inf") and found["ends"][2] == 2.0 and np.isnan(found["ends"][5])
    whole = exact_quantiles(df.where("k = 'even'"), "x", [], [0.5]).collect()
    assert [r.quantiles for r in whole] == [[pytest.approx(found["even"][3])]]
    assert exact_quantiles(df.limit(0), "x", ["k"], [0.5]).count() == 0


def test_zone_totals_against_all_bars(spark):
    """The block tree against every pair of zone and bar, with whole nodes of both levels."""
    from marketlake.operators import zones as Z

    g = np.random.default_rng(4)
    n = 9_500
    close = np.round(100 + g.normal(size=n).cumsum() / 10, 2)
    high, low = close + np.round(abs(g.normal(size=n)), 2), close - np.round(abs(g.normal(size=n)), 2)
    volume = g.integers(1, 9, n).astype(float)
    bars = spark.createDataFrame([("X", "M1", k, float(high[k]), float(low[k]), float(close[k]), float(volume[k])) for k in range(n)], "symbol string, tf string, bar_no long, high double, low double, close double, volume double")
    made = [(k, int(g.integers(0, n)), float(m - w), float(m + w)) for k, (m, w) in enumerate(zip(g.uniform(close.min() - 3, close.max() + 3, 60), g.choice([0.05, 1.0, 10.0, 500.0], 60)))]
    made += [(60, n - 1, 0.0, 500.0), (61, -1, 0.0, 500.0), (62, n - 2, 0.0, 500.0), (63, 63, 0.0, 500.0), (64, 4095, 0.0, 500.0)]
    zones = spark.createDataFrame([("X", "M1", "FVG", k, c, t, b) for k, c, b, t in made], "symbol string, tf string, kind string, imb_no long, close_bar_no long, top double, bottom double")
    no = np.arange(n)
    for lo, hi in ((low, high), (close, close)):
        names = ("low", "high") if lo is low else ("close", "close")
        got = {r["imb_no"]: r for r in Z.zone_totals(zones, bars, *names, value="volume").collect()}
        for k, c, b, t in made:
            at = np.flatnonzero((no > c) & (hi >= b) & (lo <= t))
            assert (k in got) == (len(at) > 0)
            if len(at):
                r = got[k]
                assert (r["n"], r["total"], r["first_no"], r["last_no"], r["firsts"]) == (len(at), volume[at].sum(), at[0], at[-1], at[:3].tolist())


@pytest.mark.parametrize("spread, share", [(0.15, 0.5), (3.0, 1.0)])
def test_search_meets_few_chunks(spark, spread, share):
    """The best five against all pairs; of clustered vectors less than half of the chunk pairs can meet."""
    from marketlake.operators import retrieval as N

    g = np.random.default_rng(8)
    centres = g.normal(size=(12, 16))
    v = centres[g.integers(0, 12, 900)] + spread * g.normal(size=(900, 16))
    v[5] = 0.0
    rows = [(k, x.astype(np.float32).tolist(), k % 2, float(k % 9)) for k, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, age_days double")
    u = np.array([r[1] for r in rows], dtype=np.float32).astype(float)
    u /= np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-300)
    cos = np.round(u @ u.T, 9)
    got = {}
    for r in N.topk_similarity(df, df, 5, chunk=64).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    for k in range(900):
        others = [j for j in range(k % 2, 900, 2) if j != k]
        want = sorted(others, key=lambda j: (-cos[k, j], j))[:5]
        assert np.allclose([cos[k, got[k][i + 1]] for i in range(5)], [cos[k, j] for j in want], atol=2e-9)
    c = N.cells(df, "vec_id", "embedding", "label", (), 64)
    pairs = N.chunk_pairs(c, c).toPandas()
    assert (pairs["nearest"] <= np.arccos(0.8)).mean() <= share
    found = {(r["query_id"], r["vec_id"]) for r in N.precedents(df, df, 3, 0.9, 0.8, chunk=64).collect()}
    score = 0.7 * cos + 0.3 / (1 + np.arange(900) % 9)[None]
    for k in range(0, 900, 7):
        others = [j for j in range(k % 2, 900, 2) if j != k]
        limit = 0.9 if sum(cos[k, j] >= 0.9 for j in others) >= 3 else 0.8
        want = sorted((j for j in others if cos[k, j] >= limit), key=lambda j: (-round(score[k, j], 9), j))[:3]
        assert len({b for a, b in found if a == k}) == len(want)
