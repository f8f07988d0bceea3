"""Nearest stored situations by cosine.

Vectors of a filter label are dealt to cells around pivots (some of the vectors themselves) and packed into
chunks, each with its centre and the largest angle to it. Two chunks whose centres are further apart than both
radii and the angle that still counts can't hold a pair of interest and never meet: for thresholds that angle is
fixed, for the best k it is the k-th best of the nearest chunks, which meet first. Every other pair of chunks is
one matrix product; only the best few per query leave the task. A label that holds a third of the corpus is
simply many chunks, and nothing is broadcast. A zero vector has cosine 0 with all; its chunk is always met.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 2048
#: Cells that a chunk's worth of vectors is dealt to, the most cells of a label, and chunks that each chunk meets first.
CELLS, MOST_CELLS, FIRST = 4, 256, 2
#: Arrow batches of chunks and pairs of chunks are bounded by bytes (a row holds thousands of vectors), and a pair's
#: cosines are looked at for so many queries at a time.
BATCH_BYTES, QUERIES = "8m", 512
#: Slack of an angle for rounding.
SLACK = 1e-6


def _matrix(rows) -> np.ndarray:
    return np.stack([r["v"] for r in rows]).astype(np.float64)


def _unit(rows) -> np.ndarray:
    m = _matrix(rows)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, 1.0, n)


def _products(batches):
    """(query ids, corpus ids, corpus rows, cosines) of every pair of chunks, for some of its queries at a time."""
    for pdf in batches:
        for q, c in zip(pdf["q"], pdf["c"]):
            u, ci = _unit(c).T, np.array([r["id"] for r in c])
            for i in range(0, len(q), QUERIES):
                some = q[i : i + QUERIES]
                yield np.array([r["id"] for r in some]), ci, c, np.round(_unit(some) @ u, 9)


def _packed(df: DataFrame, group: Sequence[str], size: int, fields: Sequence[str]) -> DataFrame:
    """Rows in groups of about ``size`` of one ``group`` key, as one array ``x`` each."""
    sizes = df.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / size).cast("bigint").alias("_m"))
    d = df.join(sizes, list(group)).withColumn("_part", F.pmod(F.xxhash64("id"), F.col("_m")))
    return d.groupBy(*group, "_part").agg(F.collect_list(F.struct(*fields)).alias("x"))


def cells(df: DataFrame, vec_id: str, vector: str, label: str, extra: Sequence[str] = (), size: int = CHUNK) -> DataFrame:
    """(label, chunk, x, centre, radius): every vector in a chunk of its cell."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    fields = ["id", "v", *extra]
    rows = df.select(F.col(label).alias("_label"), F.col(vec_id).alias("id"), F.col(vector).cast("array<float>").alias("v"), *extra).filter("_label is not null")
    counts = rows.groupBy("_label").agg(F.count(F.lit(1)).alias("_n"))
    number = F.least(F.ceil(F.col("_n") * CELLS / F.lit(size)), F.lit(MOST_CELLS))
    # about as many pivots as cells, by a hash of the id
    pivots = rows.join(counts, "_label").filter(F.pmod(F.xxhash64("id", F.lit(7)), F.col("_n")) < number).groupBy("_label").agg(F.collect_list(F.struct("id", "v")).alias("p"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    outer = ", ".join(f"{c} {kinds[c]}" for c in ["_label", *fields])

    def deal(batches):
        for pdf in batches:
            for name, x, p in zip(pdf["_label"], pdf["x"], pdf["p"]):
                u = _unit(x)
                cell = np.where(np.abs(u).sum(axis=1) == 0, -1, np.argmax(u @ _unit(p).T, axis=1) if p is not None and len(p) else 0)
                yield pd.DataFrame({"_label": [name] * len(x), **{c: [r[c] for r in x] for c in fields}, "_cell": cell})

    dealt = _packed(rows, ["_label"], size, fields).join(pivots, "_label", "left").select("_label", "x", "p").mapInPandas(deal, f"{outer}, _cell long")

    def measured(batches):
        for pdf in batches:
            centres, radii = [], []
            for cell, x in zip(pdf["_cell"], pdf["x"]):
                u = _unit(x)
                c = u.sum(axis=0)
                c = c / max(np.linalg.norm(c), 1e-12)
                centres.append(c)
                radii.append(float(np.arccos(np.clip(u @ c, -1, 1)).max()) + SLACK if cell >= 0 else np.pi)
            yield pdf.assign(centre=centres, radius=radii)

    inner = ", ".join(f"{c}: {kinds[c]}" for c in fields)
    packed = _packed(dealt, ["_label", "_cell"], size, fields).select("_label", "_cell", "_part", "x")
    packed = packed.mapInPandas(measured, f"_label {kinds['_label']}, _cell long, _part long, x array<struct<{inner}>>, centre array<double>, radius double")
    return packed.select("_label", F.struct("_cell", "_part").alias("chunk"), "x", "centre", "radius")


def chunk_pairs(q: DataFrame, c: DataFrame) -> DataFrame:
    """(_label, qc, cc, nearest, farthest): pairs of chunks with bounds of the angles between their vectors."""
    a = q.select("_label", F.col("chunk").alias("qc"), F.col("centre").alias("_u"), F.col("radius").alias("_r"))
    b = c.select("_label", F.col("chunk").alias("cc"), F.col("centre").alias("_w"), F.col("radius").alias("_s"))
    cos = F.aggregate(F.zip_with("_u", "_w", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    angle, reach = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))), F.col("_r") + F.col("_s")
    pairs = a.join(b, "_label").withColumn("_angle", angle)
    return pairs.select("_label", "qc", "cc", F.greatest(F.col("_angle") - reach, F.lit(0.0)).alias("nearest"), F.least(F.col("_angle") + reach, F.lit(np.pi)).alias("farthest"))


def _meet(pairs: DataFrame, q: DataFrame, c: DataFrame) -> DataFrame:
    """The rows of both chunks of each pair, spread so that a large label keeps every task busy."""
    x = q.select("_label", F.col("chunk").alias("qc"), F.col("x").alias("q"))
    y = c.select("_label", F.col("chunk").alias("cc"), F.col("x").alias("c"))
    return pairs.select("_label", "qc", "cc").join(x, ["_label", "qc"]).join(y, ["_label", "cc"]).select("qc", "q", "c")


def _both(queries: DataFrame, corpus: DataFrame, vec_id: str, vector: str, label: str, extra: Sequence[str], chunk: int) -> tuple[DataFrame, DataFrame]:
    c = cells(corpus, vec_id, vector, label, extra, chunk).persist()
    q = c.select("_label", "chunk", F.transform("x", lambda r: F.struct(r["id"].alias("id"), r["v"].alias("v"))).alias("x"), "centre", "radius") if queries is corpus else cells(queries, vec_id, vector, label, (), chunk).persist()
    return q, c


def topk_similarity(queries: DataFrame, corpus: DataFrame, k: int, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", chunk: int = CHUNK) -> DataFrame:
    """Best ``k`` corpus rows of the same label per query (the query itself left out)."""
    q, c = _both(queries, corpus, vec_id, vector, label, [], chunk)
    pairs = chunk_pairs(q, c)

    def run(batches):
        for qi, ci, _, cos in _products(batches):
            cos[qi[:, None] == ci[None, :]] = -np.inf
            order = np.lexsort((np.broadcast_to(ci, cos.shape), -cos), axis=1)[:, :k]
            take = np.take_along_axis(cos, order, 1)
            out = pd.DataFrame({"query_id": np.repeat(qi, order.shape[1]), "vec_id": ci[order].ravel(), "cosine": take.ravel()})
            yield out[np.isfinite(out["cosine"])]

    best = Window.partitionBy("query_id").orderBy(F.col("cosine").desc(), "vec_id")
    row = "query_id long, vec_id long, cosine double"
    order = F.row_number().over(Window.partitionBy("_label", "qc").orderBy("nearest", "cc"))
    pairs = pairs.withColumn("_place", order)
    first = _meet(pairs.filter(F.col("_place") <= FIRST), q, c).mapInPandas(run, row).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).persist()
    # of each query the k-th best so far, of each chunk the widest angle that still counts
    kth = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("cosine")).alias("_kth"))
    members = q.select("_label", F.col("chunk").alias("qc"), F.explode(F.transform("x", lambda r: r["id"])).alias("query_id"))
    open_ = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce("_kth", F.lit(-1.0))))) + SLACK
    widest = members.join(kth, "query_id", "left").groupBy("_label", "qc").agg(F.max(open_).alias("_open"))
    more = pairs.filter(F.col("_place") > FIRST).join(widest, ["_label", "qc"]).filter(F.col("nearest") <= F.col("_open"))
    cand = first.drop("rank").unionByName(_meet(more, q, c).mapInPandas(run, row))
    return cand.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def rerank_score(cosine: Column, days: Column) -> Column:
    return 0.7 * cosine + 0.3 / (1 + days)


def days_since(then: Column, now: Column) -> Column:
    return F.greatest(F.floor((F.unix_seconds(now) - F.unix_seconds(then)) / 86400), F.lit(0))


def precedents(queries: DataFrame, corpus: DataFrame, k: int = 3, hi: float = 0.80, lo: float = 0.75, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", age: str = "age_days", chunk: int = CHUNK) -> DataFrame:
    """Best ``k`` by 0.7*cosine + 0.3*recency above ``hi``; above ``lo`` where fewer than three reach ``hi``.

    A chunk returns its best ``k`` for both thresholds and the number above ``hi``, which is all the
    choice needs."""
    def run(batches):
        for qi, ci, c, cos in _products(batches):
            age_ = np.array([r[age] for r in c])
            cos[qi[:, None] == ci[None, :]] = -np.inf
            score = 0.7 * cos + 0.3 / (1 + age_)[None, :]
            for tag, limit in (("hi", hi), ("lo", lo)):
                ok = cos >= limit
                s = np.where(ok, np.round(score, 9), -np.inf)
                order = np.lexsort((np.broadcast_to(ci, s.shape), -s), axis=1)[:, :k]
                kept = np.take_along_axis(s, order, 1)
                out = pd.DataFrame({
                    "query_id": np.repeat(qi, order.shape[1]), "vec_id": ci[order].ravel(), "cosine": np.take_along_axis(cos, order, 1).ravel(),
                    "score": kept.ravel(), "tag": tag, "above": 0})
                yield out[np.isfinite(out["score"])]
                if tag == "hi":
                    yield pd.DataFrame({"query_id": qi, "vec_id": -1, "cosine": 0.0, "score": 0.0, "tag": "count", "above": ok.sum(axis=1)})

    q, c = _both(queries, corpus, vec_id, vector, label, [age], chunk)
    pairs = chunk_pairs(q, c).filter(F.col("nearest") <= F.lit(float(np.arccos(min(hi, lo)) + SLACK)))
    cand = _meet(pairs, q, c).mapInPandas(run, "query_id long, vec_id long, cosine double, score double, tag string, above long")
    total = F.sum(F.when(F.col("tag") == "count", F.col("above"))).over(Window.partitionBy("query_id"))
    use = F.when(total >= 3, "hi").otherwise("lo")
    c = cand.withColumn("_use", use).filter(F.col("tag") == F.col("_use"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return c.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "vec_id", "cosine", "score", "rank", (F.col("_use") == "lo").alias("fallback"))


def knn_hold(neighbours: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Cosine-weighted mean outcome of the neighbours of each query (positive cosines only)."""
    n = neighbours.filter(F.col("cosine") > 0).join(outcomes, "vec_id")
    return n.groupBy("query_id").agg((F.sum(F.col("cosine") * F.col("y")) / F.sum("cosine")).alias("p_hold"), F.count(F.lit(1)).alias("neighbours"))


def triplets(df: DataFrame, positive: float = 0.85, negative: float = 0.50, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", chunk: int = CHUNK) -> DataFrame:
    """Per anchor its closest row at or above ``positive`` and its farthest at or below ``negative``."""
    def run(batches):
        for qi, ci, _, cos in _products(batches):
            same = qi[:, None] == ci[None, :]
            up, down = np.where(same, -np.inf, cos), np.where(same, np.inf, cos)
            rank = np.argsort(ci)
            a, b = rank[np.argmax(up[:, rank], axis=1)], rank[np.argmin(down[:, rank], axis=1)]
            rows = np.arange(len(qi))
            yield pd.DataFrame({"anchor": qi, "pos": ci[a], "pos_cos": up[rows, a], "neg": ci[b], "neg_cos": down[rows, b]})

    q, c = _both(df, df, vec_id, vector, label, [], chunk)
    near, far = F.col("nearest") <= F.lit(float(np.arccos(positive) + SLACK)), F.col("farthest") >= F.lit(float(np.arccos(negative) - SLACK))
    c = _meet(chunk_pairs(q, c).filter(near | far), q, c).mapInPandas(run, "anchor long, pos long, pos_cos double, neg long, neg_cos double")
    g = c.groupBy("anchor").agg(F.max(F.struct("pos_cos", (-F.col("pos")).alias("p"))).alias("p"), F.min(F.struct("neg_cos", F.col("neg").alias("n"))).alias("n"))
    return g.filter((F.col("p.pos_cos") >= positive) & (F.col("n.neg_cos") <= negative)).select(
        "anchor", (-F.col("p.p")).alias("positive"), F.col("n.n").alias("negative"), F.col("p.pos_cos").alias("pos_cos"), F.col("n.neg_cos").alias("neg_cos"))
