"""Whitening of embeddings with distributed block matrices.

Entries are scaled, cut to whole numbers and fitted on the distinct vectors: their number and sums are exact,
they are centred, numbered and cut into blocks of a ``BlockMatrix``, which times its transpose is the scatter
matrix (the product over the rows is split, so that no task holds more than some blocks). Its eigenvectors are
found on the driver - the matrix is as wide as a vector, whatever the number of rows - and a second product
projects all rows, block by block.

Rows whose vector is null, empty, or holds null or non-finite entries are left out, and so are those of another
length than most vectors have (of lengths as frequent the longest stays). A direction without variance can't be
scaled: its rows have null ``whitened`` and explain 0. Entries beyond a long are the largest or smallest one. Repeated rows and null ids are returned as often as they
came; equal vectors count once in the fit. ``deviation`` is null where it exceeds a long. Other columns, of any
name, play no part. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal
from typing import NamedTuple

import numpy as np
from pyspark import SparkContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlake.llm.common import stored

#: Rows of a block, and blocks that a task multiplies and adds up at a time.
BLOCK_ROWS, BLOCKS = 512, 16
EXACT = "decimal(38,0)"


class Fit(NamedTuple):
    n: int
    sums: list[int]
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # a column for each
    trace: float

    @property
    def usable(self) -> np.ndarray:
        """Eigenvalues that are more than rounding."""
        return self.values > len(self.sums) * np.finfo(float).eps * max(float(self.values[0]), 0.0)


def cut(scale: int) -> Callable[[Column], Column]:
    """An entry as a whole number."""
    return lambda c: F.floor(c.cast("double") * scale).cast("long")


def whole(rows: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """(vec_id, x) of the rows that stay."""
    v = F.col(vector)
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))) & (F.size(v) > 0)
    x = rows.where(F.coalesce(fine, F.lit(False))).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(v, cut(scale)).alias("x"))
    return x


def numbered(rows: DataFrame) -> DataFrame:
    """A stored table with ``index``, a number of each row from 0 without gaps, found file by file."""
    named = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    files = sorted((r["_file"], r["n"]) for r in named.groupBy("_file").agg(F.count("*").alias("n")).collect())
    before = np.cumsum([0, *(n for _, n in files)]).tolist()
    offsets = rows.sparkSession.createDataFrame([(f, b) for (f, _), b in zip(files, before, strict=False)], "_file string, _before long")
    return named.join(F.broadcast(offsets), "_file").withColumn("index", F.col("_row") + F.col("_before")).drop("_file", "_row", "_before")


def blocks(rows: DataFrame, fit_n: int, sums: list[int], n: int) -> BlockMatrix:
    """The centred rows (index, x) as a block matrix."""
    mean = F.lit([s / fit_n for s in sums])
    centred = rows.select("index", array_to_vector(F.zip_with("x", mean, lambda x, m: x - m)).alias("vector"))
    matrix = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(centred, "vector"), n, len(sums))
    return matrix.toBlockMatrix(BLOCK_ROWS, len(sums))


def gram(m: BlockMatrix) -> np.ndarray:
    """The transpose times the matrix; the sum over the rows is dealt to tasks of BLOCKS blocks each."""
    parts = max(1, -(-m.numRows() // (BLOCK_ROWS * BLOCKS)))
    turned = m.transpose()  # held by a name: the JVM lets go of what Python does
    product = turned._java_matrix_wrapper._java_model.multiply(m._java_matrix_wrapper._java_model, parts)
    return BlockMatrix(product, m.colsPerBlock, m.colsPerBlock).toLocalMatrix().toArray()


def projected(m: BlockMatrix, by: np.ndarray) -> BlockMatrix:
    """Every row times the matrix ``by``."""
    d, k = by.shape
    sc = SparkContext.getOrCreate()
    local = BlockMatrix(sc.parallelize([((0, 0), DenseMatrix(d, k, by.T.ravel().tolist()))], 1), d, k)
    return m.multiply(local)


def fitted(distinct: DataFrame, width: int) -> tuple[Fit, BlockMatrix]:
    """Eigenvalues and eigenvectors of the covariance of a stored table of distinct vectors x."""
    sums = distinct.select(F.posexplode("x").alias("k", "x")).groupBy("k").agg(F.sum(F.col("x").cast(EXACT)).alias("s"), F.count("*").alias("n")).orderBy("k").collect()
    n, s = sums[0]["n"], [int(r["s"]) for r in sums]
    m = blocks(numbered(distinct), n, s, n)
    cov = gram(m) / n
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    return Fit(n, s, values[::-1], vectors[:, ::-1], float(np.trace(cov))), m


def deviation(fit: Fit) -> Column:
    """Sum over the dimensions of (n x - S)^2, exact; null beyond 38 digits."""
    sums = F.array(*(F.lit(Decimal(v)).cast(EXACT) for v in fit.sums))
    far = F.zip_with("x", sums, lambda x, s: F.try_subtract(F.try_multiply(x.cast(EXACT), F.lit(fit.n).cast(EXACT)).cast(EXACT), s).cast(EXACT))
    squares = F.transform(far, lambda d: F.try_multiply(d, d).cast(EXACT))
    return F.aggregate(squares, F.lit(0).cast(EXACT), lambda a, d: F.try_add(a, d).cast(EXACT))


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(rows: DataFrame, components: int = 4, scale: int = 256, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row for each vector that stays and each of the first ``components`` components."""
    spark = rows.sparkSession
    x = whole(rows, vec_id, vector, scale)
    size = x.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if size is None:
        return spark.createDataFrame([], SCHEMA)
    width, total = size["size"], size["count"]
    x = stored(x.where(F.size("x") == width), "whitening-rows")
    fit, m = fitted(stored(x.select("x").distinct(), "whitening-fit"), width)
    k = min(components, width)
    usable = fit.usable[:k]
    by = fit.vectors[:, :k] / np.sqrt(np.where(usable, fit.values[:k], 1.0))
    # how far the covariance of the projected fit list is from the identity
    u = int(usable.sum())
    error = None
    if u:
        own = projected(m, by[:, :u])
        error = float(np.abs(gram(own) / fit.n - np.eye(u)).max())
    every = stored(numbered(x), "whitening-numbered")
    centred = blocks(every, fit.n, fit.sums, total)
    product = projected(centred, by)
    result = product.toIndexedRowMatrix()
    places = callMLlibFunc("getIndexedRows", result._java_matrix_wrapper._java_model)
    places = places.select("index", vector_to_array("vector").alias("w"))
    both = every.select("index", "vec_id", deviation(fit).alias("deviation")).join(places, "index")
    explained = [float(e / fit.trace) if ok else 0.0 for e, ok in zip(fit.values[:k], usable, strict=True)]
    parts = F.array(*(
        F.struct(F.lit(j + 1).alias("component"), (F.get("w", F.lit(j)) if usable[j] else F.lit(None).cast("double")).alias("whitened"), F.lit(explained[j]).alias("explained"))
        for j in range(k)))
    out = both.select("vec_id", "deviation", F.explode(parts).alias("c"))
    return out.select(
        "vec_id", "c.component", F.lit(fit.n).cast("long").alias("n"), F.col("deviation").try_cast("long").alias("deviation"),
        "c.whitened", "c.explained", F.lit(error).cast("double").alias("identity_error"))
