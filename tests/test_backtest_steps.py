"""Steps of the back-test report over all rows: bins, quantile passes and slices by plain columns, the curve sorted once."""

import bisect
import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from marketlake.operators import drift, evaluation, ranks


def test_psi_against_a_loop(spark, capsys):
    """Bins of odd values: nulls, NaN, infinities, outsiders, one value only, a feature unknown to the first set."""
    inf, nan = math.inf, math.nan
    ref = [(float(i % 17), 5.0, None, x) for i, x in zip(range(60), [-0.0, 0.0, 0.1, 0.1 + 2e-17, 0.3] * 12)] + [(None, None, None, None), (16.0, 5.0, None, inf)]
    cur = [(float(i % 23) - 2, 5.0 if i % 3 else 6.0, 1.0, 0.1) for i in range(50)] + [(None, nan, 2.0, nan), (nan, -inf, None, inf), (16.0, None, 3.0, -1.0)]
    cols = ["a", "b", "c", "d"]
    frames = [spark.createDataFrame(x, "a double, b double, c double, d double") for x in (ref, cur)]
    out = drift.psi(*frames, cols)
    edges = {r["feature"]: list(dict.fromkeys(r["quantiles"])) for r in ranks.exact_quantiles(drift._long(frames[0], cols), "v", ["feature"], [i / 10 for i in range(11)]).collect()}

    def binned(rows, k, e):
        n = Counter()
        for v in (r[k] for r in rows):
            key = math.inf if v is not None and math.isnan(v) else v  # no edge here is NaN, and NaN comes after all
            pos = -1 if v is None else bisect.bisect_right(sorted(e), key) - 1
            n[len(e) - 2 if v == e[-1] else pos if 0 <= pos < len(e) - 1 else None] += 1
        return n

    expected = {}
    for k, c in enumerate(cols):
        if c in edges:
            r, q = binned(ref, k, edges[c]), binned(cur, k, edges[c])
            bins = {b for b in [*r, *q] if b is not None}
            share = lambda n, b: max(n[b] / sum(n.values()), 1e-10) if b in n else 1e-10
            expected[c] = (sum((share(q, b) - share(r, b)) * math.log(share(q, b) / share(r, b)) for b in bins), len(bins))
    found = {r["feature"]: r for r in out.collect()}
    assert found.keys() == expected.keys() == {"a", "b", "d"}
    for c, (psi, n) in expected.items():
        assert found[c]["psi"] == pytest.approx(psi) and found[c]["bins"] == n
    out.explain()
    # no array of edges is filtered for each row
    assert not re.search(r"filter\(edges", capsys.readouterr().out)


def test_quantile_passes_hash(spark, monkeypatch):
    """No pass sorts the rows: cells are counted by hash aggregates."""
    rows = spark.range(3000).select(F.concat(F.lit("f"), (F.col("id") % 2).cast("string")).alias("k"), F.pow(F.col("id").cast("double"), 3.0).alias("v"))
    kind, plans = type(rows), []
    collect = kind.collect
    monkeypatch.setattr(kind, "collect", lambda self: plans.append(self._jdf.queryExecution().executedPlan().toString()) or collect(self))
    found = {r["k"]: r["quantiles"] for r in ranks.exact_quantiles(rows, "v", ["k"], [0.0, 0.5, 1.0]).collect()}
    assert found == {"f0": [0.0, (1498.0**3 + 1500.0**3) / 2, 2998.0**3], "f1": [1.0, (1499.0**3 + 1501.0**3) / 2, 2999.0**3]}
    assert len(plans) > 2 and not any("SortAggregate" in p for p in plans)


def test_slices(spark):
    cuts = sorted([float(i // 2) for i in range(253)] + [-math.inf, math.inf])
    values = [-math.inf, -1.0, 0.0, 0.5, 77.0, 126.0, 200.0, math.inf]
    df = spark.createDataFrame([(v,) for v in [*values, math.nan, None]], "v double").select("v", ranks.slice_of(F.array(*[F.lit(c) for c in cuts]), F.col("v")).alias("s"))
    assert [r["s"] for r in df.collect()] == [*(bisect.bisect_right(cuts, v) for v in values), 255, 0]


def test_curve_sorts_trades_once(spark, capsys):
    rows = spark.range(500).select((F.col("id") % 5).alias("day"), "id", (F.col("id") % 7 - F.lit(2.9)).alias("pnl")).withColumn("day", F.timestamp_seconds(F.col("day") * 86400))
    curve = evaluation.equity_curve(rows, [], ["day", "id"])
    found = curve.orderBy("day", "id").collect()
    total, top = 0.0, -math.inf
    for r in found:
        total += r["pnl"]
        top = max(top, total)
        assert r["equity"] == pytest.approx(total) and r["peak"] == pytest.approx(top)
    curve.explain()
    assert "InMemoryRelation" in capsys.readouterr().out
