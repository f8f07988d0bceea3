"""Embedding near-duplicates by sorted projection passes.

Vectors that are equal are one class from the start. In each pass the classes of a label are put in the
lexicographic order of concatenated random hashes (signs of projections, BITS of them), and every class
is compared with the WINDOW that follow; verified links of all passes are united. Vectors of a label often
lie in a cone, where plain hashes would agree for all of them, so hashes are taken of the unit vectors less
their label's mean; links are decided on the vectors themselves. The number of passes follows from the
number of vectors and from the mean cosine of a label (see ``passes_for`` and ``centred_cosine``): a pair at
the threshold is met with the same probability at any size.

A window is bounded, a group of near-copies is not. So links are counted group by group afterwards:
all vectors within half the threshold's angle of the group's mean are linked with one another, which
needs no comparison; each other vector is compared with its whole group, in blocks.

Vectors link only if their labels are equal and not null. A vector that is null, zero, or holds a null
or non-finite component links with nothing; vectors of different length don't link. Repeated rows are
returned as often as they come and link with one another.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlake.llm.common import components, small_batches, stored

COSINE = 0.93
BITS, WINDOW = 48, 32
#: Probability with which a pair exactly at the threshold is met.
RECALL = 0.98
#: Rows of a sorted partition, and vectors of a block when a group is compared in full.
ROWS, BLOCK = 20_000, 1_024
#: Numbers in all label means together up to which they are broadcast (32 MB).
MEANS = 4_000_000


def passes_for(largest: int, cosine: float, window: int = WINDOW, recall: float = RECALL) -> int:
    """Passes for labels of up to ``largest`` classes: a pass brings two vectors together if their first
    log2(largest / window) hashes agree, each with probability 1 - angle / pi."""
    alike = 1 - math.acos(cosine) / math.pi
    once = alike ** max(0.0, math.log2(max(largest, 1) / window))
    return 1 if once >= recall else math.ceil(math.log(1 - recall) / math.log(1 - once))


def centred_cosine(cosine: float, mean: float) -> float:
    """Cosine of a pair at ``cosine`` once the label's mean is taken off, at mean cosine ``mean``: less than before."""
    return max(-0.999, (cosine - mean) / max(1 - mean, 1e-9)) if mean < cosine else cosine


def _unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def _matrix(column: pa.Array) -> np.ndarray:
    """A binary column of equal width as rows of float64."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float64).reshape(len(column), -1)


def prepared(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, dims, v): v is null where the vector links with nothing."""
    e = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), e.alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    return rows.select("vec_id", "label", F.when(fine & F.col("label").isNotNull(), F.col("v")).alias("v"))


def _forest(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Places of links that join two groups (of those before them in the list) for the first time."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up] if up in parent else up
            x = up
        return x

    keep = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        if (rx := root(x)) != (ry := root(y)):
            parent[rx] = ry
            keep.append(k)
    return keep


def _compare(group: np.ndarray, cls: np.ndarray, unit: np.ndarray, cosine: float, first: int = 0, last: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links within WINDOW of each other in the given order, as a forest; only pairs that reach over
    from before ``last`` to ``first`` or later are compared."""
    a, b = [], []
    n = len(cls)
    for d in range(1, min(WINDOW, n - 1) + 1):
        low, high = max(0, first - d), min(n - d, n if last is None else last)
        if low >= high:
            continue
        x, y = slice(low, high), slice(low + d, high + d)
        near = (group[x] == group[y]) & (np.einsum("ij,ij->i", unit[x], unit[y]) >= cosine)
        at = np.flatnonzero(near) + low
        a.append(cls[at])
        b.append(cls[at + d])
    a, b = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (a, b))
    keep = _forest(a, b)
    return a[keep], b[keep]


def _hashed(rows: DataFrame, passes: int) -> DataFrame:
    """Each class once for each pass: (pass, label, dims, key, cls, v binary)."""

    def run(it):
        planes: dict[int, np.ndarray] = {}
        for batch in it:
            if not batch.num_rows:
                continue
            dims = batch.column("dims").to_numpy()
            for d in np.unique(dims).tolist():
                b = batch.take(pa.array(np.flatnonzero(dims == d)))
                if d not in planes:
                    planes[d] = np.random.default_rng([11, d]).standard_normal((d, passes * BITS))
                v = np.array(b.column("v").flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, d)
                raw = [r.tobytes() for r in v]
                signs = ((_unit(v) - _matrix(b.column("mean"))) @ planes[d] > 0).reshape(len(v), passes, BITS)
                keys = signs @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                for k in range(passes):
                    n = len(v)
                    yield pa.RecordBatch.from_arrays([pa.array([k] * n, pa.int32()), b.column("label"), b.column("dims"), pa.array(keys[:, k]), b.column("cls"), pa.array(raw, pa.binary())], ["pass", "label", "dims", "key", "cls", "v"])

    return rows.mapInArrow(run, "pass int, label string, dims int, key long, cls long, v binary")


def _groups(passes: list, labels: list, dims: list) -> np.ndarray:
    return pd.factorize(pd.MultiIndex.from_arrays([passes, labels, dims]))[0]


def label_means(classes: DataFrame) -> DataFrame:
    """(label, dims, mean, n): the mean of the unit vectors of each label and width; sums in each task first."""

    def partial(it):
        for b in it:
            if not b.num_rows:
                continue
            dims = b.column("dims").to_numpy()
            for d in np.unique(dims).tolist():
                part = b.take(pa.array(np.flatnonzero(dims == d)))
                unit = _unit(np.array(part.column("v").flatten().to_numpy(zero_copy_only=False)).reshape(-1, d))
                place, names = pd.factorize(np.array(part.column("label").to_pylist(), dtype=object))
                sums = np.zeros((len(names), d))
                np.add.at(sums, place, unit)
                yield pa.RecordBatch.from_arrays([pa.array(names.tolist(), pa.string()), pa.array([d] * len(names), pa.int32()), pa.array(list(sums), pa.list_(pa.float64())), pa.array(np.bincount(place), pa.int64())], ["label", "dims", "total", "n"])

    def whole(rows: pd.DataFrame) -> pd.DataFrame:
        n = int(rows["n"].sum())
        mean = np.sum(np.stack(rows["total"].to_list()), axis=0) / n
        return pd.DataFrame({"label": rows["label"].iloc[:1], "dims": rows["dims"].iloc[:1], "mean": [mean.tobytes()], "n": [n], "cosine": [float(mean @ mean)]})

    sums = classes.select("label", "dims", "v").mapInArrow(partial, "label string, dims int, total array<double>, n long")
    return stored(sums.groupBy("label", "dims").applyInPandas(whole, "label string, dims int, mean binary, n long, cosine double"), "embedding-means")


def window_links(classes: DataFrame, cosine: float) -> DataFrame:
    """Verified links (a, b) of all passes."""
    means = label_means(classes)
    # as many passes as the label needs that needs most
    sizes = means.groupBy(F.round("cosine", 2).alias("mean")).agg(F.max("n").alias("n")).collect()
    passes = max((passes_for(r["n"], centred_cosine(cosine, r["mean"])) for r in sizes), default=1)
    small = means.agg(F.coalesce(F.sum("dims"), F.lit(0))).first()[0] <= MEANS
    means = means.select(F.col("label").alias("_label"), F.col("dims").alias("_dims"), "mean")
    centred = classes.join(F.broadcast(means) if small else means, (F.col("label") == F.col("_label")) & (F.col("dims") == F.col("_dims")))
    hashed = _hashed(centred.select("cls", "label", "dims", "v", "mean"), passes)
    parts = max(1, -(-classes.count() * passes // ROWS))
    order = ["pass", "label", "dims", "key", "cls"]

    def run(it):
        part = TaskContext.get().partitionId()
        names = ["a", "b", "part", "side", "place", "pass", "label", "dims", "v"]
        held: pa.Table | None = None
        seen = 0

        def edge(rows: pa.Table, side: int, start: int):
            n = rows.num_rows
            return pa.RecordBatch.from_arrays([rows["cls"].combine_chunks(), pa.nulls(n, pa.int64()), pa.array([part] * n, pa.int32()), pa.array([side] * n, pa.int32()), pa.array(range(start, start + n), pa.int32()), *(rows[c].combine_chunks() for c in ("pass", "label", "dims", "v"))], names)

        for batch in it:
            rows = pa.Table.from_batches([batch])
            if not rows.num_rows:
                continue
            if seen < WINDOW:
                yield edge(rows.slice(0, WINDOW - seen), 0, seen)
            old = held.num_rows if held is not None else 0
            rows = pa.concat_tables([held, rows]).combine_chunks() if old else rows
            seen += rows.num_rows - old
            group = _groups(*(rows[c].to_pylist() for c in ("pass", "label", "dims")))
            cls, dims = rows["cls"].to_numpy(), rows["dims"].to_numpy()
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                unit = _unit(_matrix(rows["v"].combine_chunks().take(pa.array(at))))
                a, b = _compare(group[at], cls[at], unit, cosine, first=int((at < old).sum()))
                n = len(a)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(n, pa.int32()), pa.array([2] * n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
            held = rows.slice(max(0, rows.num_rows - WINDOW))
        if held is not None:
            yield edge(held, 1, 0)

    ordered = hashed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    found = stored(ordered.mapInArrow(run, "a long, b long, part int, side int, place int, pass int, label string, dims int, v binary"), "embedding-passes")
    # the last WINDOW rows of a partition meet the first of the next one
    follows = found.where("side = 0").select("part").distinct().withColumn("before", F.lag("part").over(Window.orderBy("part")))
    edges = found.where("side < 2").drop("b").join(follows.where("before is not null"), "part", "left")
    edges = edges.withColumn("meet", F.when(F.col("side") == 1, F.col("part")).otherwise(F.col("before"))).where("meet is not null")

    def across(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["side", "place"], ascending=[False, True])
        out = []
        for _, part in rows.groupby("dims", sort=False):
            unit = _unit(np.frombuffer(b"".join(part["v"]), dtype=np.float64).reshape(len(part), -1))
            tail = int((part["side"] == 1).sum())
            out.append(_compare(_groups(part["pass"], part["label"], part["dims"]), part["a"].to_numpy(), unit, cosine, first=tail, last=tail))
        return pd.DataFrame({"a": np.concatenate([x for x, _ in out]), "b": np.concatenate([y for _, y in out])})

    met = edges.select("meet", "side", "place", "a", "pass", "label", "dims", "v").groupBy("meet").applyInPandas(across, "a long, b long")
    return found.where("side = 2").select("a", "b").unionByName(met).distinct()


def _means(members: DataFrame) -> DataFrame:
    """(comp, mean array, size): sums in each task first, then a few rows for each group."""

    def partial(it):
        for b in it:
            if not b.num_rows:
                continue
            comp, dims = b.column("comp").to_numpy(), b.column("dims").to_numpy()
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                unit = _unit(_matrix(b.column("v").take(pa.array(at))))
                own, inverse = np.unique(comp[at], return_inverse=True)
                sums = np.zeros((len(own), d))
                np.add.at(sums, inverse, unit)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(list(sums), pa.list_(pa.float64())), pa.array(np.bincount(inverse), pa.int64())], ["comp", "total", "size"])

    def whole(rows: pd.DataFrame) -> pd.DataFrame:
        mean = np.sum(np.stack(rows["total"].to_list()), axis=0)
        return pd.DataFrame({"comp": [rows["comp"].iloc[0]], "mean": [_unit(mean[None])[0].tobytes()], "size": [int(rows["size"].sum())]})

    return members.select("comp", "dims", "v").mapInArrow(partial, "comp long, total array<double>, size long").groupBy("comp").applyInPandas(whole, "comp long, mean binary, size long")


def counted(members: DataFrame, cosine: float) -> DataFrame:
    """(cls, links): the links of each class with the others of its component, by number of vectors.

    ``members`` is (cls, comp, dims, n, v) of classes in components of at least two.
    """
    half = math.sqrt((1 + cosine) / 2) + 1e-9  # cosine of half the angle: two such vectors are linked for sure

    def near(it):
        for b in it:
            core = np.zeros(b.num_rows, dtype=bool)
            dims = b.column("dims").to_numpy() if b.num_rows else np.zeros(0, int)
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                core[at] = np.einsum("ij,ij->i", _unit(_matrix(b.column("v").take(pa.array(at)))), _matrix(b.column("mean").take(pa.array(at)))) >= half
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("cls", "comp", "dims", "n", "size", "v")), pa.array(core)], ["cls", "comp", "dims", "n", "size", "v", "core"])

    rows = members.join(_means(members), "comp").select("cls", "comp", "dims", "n", "size", "v", "mean")
    rows = stored(rows.mapInArrow(near, "cls long, comp long, dims int, n long, size long, v binary, core boolean"), "embedding-groups")
    inner = rows.groupBy("comp").agg(F.sum(F.when(F.col("core"), F.col("n")).otherwise(0)).alias("core_n"), F.sum(F.when(~F.col("core"), 1).otherwise(0)).alias("rest"))
    sure = rows.where("core").join(inner, "comp").select("cls", (F.col("core_n") - F.col("n")).alias("links"))
    # the rest of a group meets all of it: blocks of the rest against blocks of members
    open_ = rows.join(inner.where("rest > 0").select("comp", "rest"), "comp")
    blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    own = lambda n, seed: F.pmod(F.xxhash64("cls", F.lit(seed)), blocks(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    named = [F.col(c).alias(c) for c in ("comp", "cls", "n", "v")]  # columns of their own, as both sides come from one table
    left = open_.where("not core").select(*named, own(F.col("rest"), 1).alias("i"), every(F.col("size")).alias("j"))
    right = open_.select("comp", every(F.col("rest")).alias("i"), own(F.col("size"), 2).alias("j"), "cls", "n", "v", "core")

    def block(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"cls": np.zeros(0, np.int64), "links": np.zeros(0, np.int64)})
        u, w = (_unit(np.frombuffer(b"".join(z["v"]), dtype=np.float64).reshape(len(z), -1)) for z in (x, y))
        linked = (u @ w.T >= cosine) & (x["cls"].to_numpy()[:, None] != y["cls"].to_numpy()[None])
        core = y["core"].to_numpy(dtype=bool)
        a, b = linked @ y["n"].to_numpy(), (linked.T @ x["n"].to_numpy())[core]
        return pd.DataFrame({"cls": np.concatenate([x["cls"].to_numpy(), y["cls"].to_numpy()[core]]), "links": np.concatenate([a, b])})

    compared = left.groupBy("comp", "i", "j").cogroup(right.groupBy("comp", "i", "j")).applyInPandas(block, "cls long, links long")
    return sure.unionByName(compared).groupBy("cls").agg(F.sum("links").alias("links"))


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows = prepared(vectors)
    classes = rows.where("v is not null").groupBy("label", "v").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"))
    classes = stored(classes.select(F.monotonically_increasing_id().alias("cls"), "label", F.size("v").alias("dims"), "v", "first", "n"), "embedding-classes")
    links = window_links(classes, cosine)
    groups = stored(components(links, "a", "b", "embedding-stars"), "embedding-components")

    def packed(it):
        for b in it:
            sizes = b.column("dims").to_numpy() if b.num_rows else np.zeros(0, int)
            flat = b.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).tobytes()
            ends = np.cumsum(sizes) * 8
            raw = [flat[e - 8 * s : e] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("cls", "comp", "dims", "n")), pa.array(raw, pa.binary())], ["cls", "comp", "dims", "n", "v"])

    members = classes.join(groups, classes["cls"] == groups["node"]).select("cls", F.col("component").alias("comp"), "dims", "n", "v")
    links = counted(stored(members.mapInArrow(packed, "cls long, comp long, dims int, n long, v binary"), "embedding-members"), cosine)
    named = classes.join(groups, classes["cls"] == groups["node"], "left").select("cls", "first", F.coalesce("component", "cls").alias("root"))
    lowest = named.groupBy("root").agg(F.min("first").alias("lowest"))
    named = named.join(lowest, "root").join(links, "cls", "left").select(F.col("cls").alias("of"), "lowest", F.coalesce("links", F.lit(0)).alias("links"))
    classes = stored(classes.join(named, F.col("cls") == F.col("of")).select("label", "v", "lowest", (F.col("links") + F.col("n") - 1).alias("n_links")), "embedding-named")
    linked = rows.where("v is not null").join(classes, ["label", "v"]).select("vec_id", "n_links", F.col("lowest").alias("component_id"))
    alone = rows.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
