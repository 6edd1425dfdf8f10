"""Embedding whitening with distributed block matrices.

Vectors become whole numbers x = floor(``SCALE`` * c). The fit list holds each distinct x once; its rows, centred, are
numbered without a gap and laid into the blocks of an MLlib ``BlockMatrix``. The transposed matrix times the matrix is
the scatter, whose size depends on the length of a vector alone; its eigenvectors are found locally. The matrix times the
whitening matrix projects the fit list, block by block. Rows get the projection of their x through a join on a 128-bit
hash of it, so repeated vectors are projected once and a vector that a third of all rows holds is one row of the other
side (the rows' side may be split).

The middle dimension of a product is split into as many parts as there are row blocks, so no task holds more than a few
blocks. The driver sees block numbers, one count per partition, sums per dimension and matrices of dimension x dimension.

Rows whose vector is null, or holds null or non-finite entries or one whose x is no 64-bit number, are left out. Vectors
of different length lie in different spaces; each length is whitened by itself, with its own n. Components without
variance (a single x, constant or dependent dimensions; ``RANK`` of the largest) do not exist, so there may be fewer than
asked for, or none. Keys may be null or repeat; every row gets its own result. ``deviation`` is null where it exceeds 64
bits. Columns other than key and vector are not looked at. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almenara.session import pin, scratch

SCALE = 256
COMPONENTS = 4
BLOCK_ROWS = 1024
BLOCK_COLUMNS = 1024
#: Eigenvalues below this share of the largest are rounding noise.
RANK = 1e-13
#: The first double that is no 64-bit number.
_TOO_LARGE = float(1 << 63)


def whole(vector: Column) -> Column:
    """floor(SCALE * c) of each entry."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE))


def usable(vector: Column) -> Column:
    """No entry is null, non-finite or too large for a 64-bit number."""
    return vector.isNotNull() & F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) * SCALE < _TOO_LARGE, F.lit(False)) & ~F.isnan(c.cast("double")))


def prints(x: Column) -> tuple[Column, Column]:
    return F.xxhash64(x), F.xxhash64(F.lit(7919), x)


def sums(fit: DataFrame, dims: int) -> tuple[int, list[int]]:
    """How many x, and their exact sum per dimension: both halves of a number are added apart, so nothing overflows."""
    halves = [F.sum(part(F.col("x")[i])) for i in range(dims) for part in (lambda c: F.shiftright(c, 32), lambda c: c.bitwiseAND(0xFFFFFFFF))]
    n, *found = fit.agg(F.count(F.lit(1)), *halves).first()
    return n, [(found[2 * i] << 32) + found[2 * i + 1] for i in range(dims)] if n else []


def numbered(fit: DataFrame) -> DataFrame:
    """``index`` from 0 without a gap; ``fit`` is stored, so its partitions stay as they are."""
    place = fit.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    counts = sorted(tuple(r) for r in place.groupBy("part").count().collect())
    base = dict(zip((p for p, _ in counts), np.cumsum([0, *(c for _, c in counts)]).tolist()))
    first = fit.sparkSession.createDataFrame(list(base.items()), "_part int, base long")
    return place.join(F.broadcast(first), F.col("part") == F.col("_part")).withColumn("index", F.col("base") + F.col("at")).drop("part", "_part", "base", "at")


def blocks(rows: DataFrame, n: int, dims: int) -> BlockMatrix:
    """(index, vector) rows as blocks."""
    old = MLUtils.convertVectorColumnsFromML(rows.select("index", "vector"), "vector")
    return IndexedRowMatrix(old, n, dims).toBlockMatrix(BLOCK_ROWS, BLOCK_COLUMNS)


def product(left: BlockMatrix, right: BlockMatrix, splits: int = 1) -> BlockMatrix:
    """left x right with the middle dimension in ``splits`` parts, which MLlib offers on its JVM side."""
    matrix = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(matrix, left.rowsPerBlock, right.colsPerBlock)


def scatter(matrix: BlockMatrix) -> np.ndarray:
    """matrix' x matrix, on the driver."""
    return product(matrix.transpose(), matrix, max(1, matrix.numRowBlocks)).toLocalMatrix().toArray()


def local(spark, matrix: np.ndarray) -> BlockMatrix:
    """A small matrix as blocks that fit the columns of another."""
    cut = [((i, 0), DenseMatrix(len(part), matrix.shape[1], part.ravel(order="F"))) for i, part in enumerate(np.split(matrix, range(BLOCK_COLUMNS, len(matrix), BLOCK_COLUMNS)))]
    return BlockMatrix(spark.sparkContext.parallelize(cut, 1), BLOCK_COLUMNS, matrix.shape[1], len(matrix), matrix.shape[1])


def one_space(rows: DataFrame, dims: int, components: int) -> DataFrame | None:
    """Whitened rows (key, x) of one length."""
    spark = rows.sparkSession
    fit = pin(rows.select("x").distinct())
    n, total = sums(fit, dims)
    if not n or not dims:
        return None
    mean = F.array(*[F.lit(s / n) for s in total])
    centred = numbered(fit).withColumn("vector", array_to_vector(F.zip_with("x", mean, lambda x, m: x.cast("double") - m)))
    matrix = blocks(centred, n, dims)
    covariance = scatter(matrix) / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > RANK * max(float(values[-1]), 0.0)]
    if not len(order):
        return None
    projected = product(matrix, local(spark, vectors[:, order] / np.sqrt(values[order])))
    whitened = pin(projected.toIndexedRowMatrix().rows.map(lambda r: (int(r.index), r.vector.toArray().tolist())).toDF("_index long, whitened array<double>"))
    again = blocks(whitened.select(F.col("_index").alias("index"), array_to_vector("whitened").alias("vector")), n, len(order))
    error = float(np.abs(scatter(again) / n - np.eye(len(order))).max())
    total_column = F.array(*[F.lit(s if abs(s) < 1 << 63 else None).cast("long") for s in total])
    squares = F.zip_with("x", total_column, lambda x, s: F.try_subtract(F.try_multiply(x, F.lit(n)), s))
    deviation = F.aggregate(squares, F.lit(0).cast("long"), lambda a, d: F.try_add(a, F.try_multiply(d, d)))
    a, b = prints(F.col("x"))
    results = centred.select("index", a.alias("_a"), b.alias("_b"), deviation.alias("deviation")).join(whitened, F.col("index") == F.col("_index")).select("_a", "_b", "deviation", "whitened")
    joined = rows.select("key", a.alias("a"), b.alias("b")).join(results, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")))
    share = F.array(*[F.lit(float(v)) for v in values[order] / np.trace(covariance)])
    return joined.select("key", F.lit(n).cast("long").alias("n"), "deviation", F.posexplode("whitened").alias("at", "whitened"), share.alias("share"), F.lit(error).alias("identity_error")).select(
        "key", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", F.element_at("share", F.col("at") + 1).alias("explained"), "identity_error"
    )


def whiten(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Per row and component: key, component, n, deviation, whitened, explained, identity_error."""
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col(key).alias("key"), F.col(vector).alias("v")).filter(usable(F.col("v"))).select("key", whole(F.col("v")).alias("x"))
    lengths = sorted(r[0] for r in rows.select(F.size("x")).distinct().collect())
    folder = scratch(spark, "whitening")
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    spark.createDataFrame([], schema).write.parquet(folder)
    for dims in lengths:
        found = one_space(rows.filter(F.size("x") == dims), dims, components)
        if found is not None:
            found.write.mode("append").parquet(folder)
    return spark.read.schema(schema).parquet(folder).withColumnRenamed("key", key)
