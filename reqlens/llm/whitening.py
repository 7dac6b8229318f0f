"""Whitening of embeddings by distributed block matrices.

Vectors are put on a grid of whole numbers, so sums, deviations and the list of distinct
vectors are exact. The distinct vectors, centred, are indexed into blocks of rows; the
transposed block matrix times itself is the scatter, whose eigenvectors the driver finds
(a matrix of dimension x dimension, whatever the number of rows). The block matrix of all
rows times the whitening matrix projects them.

Blocks are built by DataFrame aggregations and written in the form that Spark's matrix
type has on disk, so that MLlib reads them without Python rows.
"""
from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.ml.linalg import MatrixUDT as _Columns
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices, MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from reqlens.llm.common import numbered, stored

LARGEST = 2.0 ** 62  # entries whose grid number would not fit a long count as not finite

_PLACE = StructType([StructField("_1", LongType()), StructField("_2", LongType())])
_BLOCK = StructType([StructField("place", _PLACE), StructField("block", MatrixUDT())])
_PLAIN = StructType([StructField("place", _PLACE), StructField("block", _Columns.sqlType())])


@dataclass(frozen=True)
class Whitening:
    scale: int = 64            # grid steps of 1
    shift: int = 1_000_000
    components: int = 16       # most that are returned
    block_rows: int = 1024
    block_columns: int = 1024
    blocks_per_split: int = 8  # row blocks that one task of the scatter holds
    least: float = 1e-12       # of the first eigenvalue: below it a component has no variance


def grid(embeddings: DataFrame, opts: Whitening = Whitening()) -> DataFrame:
    """(vec_id, x): usable rows with their vectors as whole numbers."""
    e = F.col("embedding")
    fine = F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) * opts.scale < LARGEST))
    rows = embeddings.filter(e.isNotNull() & (F.size(e) > 0) & fine)
    rows = rows.select("vec_id", F.transform(e, lambda c: F.floor(c.cast("double") * opts.scale) + F.lit(opts.shift).cast(
        "long")).alias("x"))
    sizes = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return rows.filter(F.size("x") == (sizes["size"] if sizes else 0))


def blocks(rows: DataFrame, dims: int, n: int, opts: Whitening, name: str) -> BlockMatrix:
    """(rank, v: centred vector) as a block matrix of n rows. A block gathers at most
    block_rows rows."""
    wide = opts.block_columns
    parts = F.array(*[F.struct(F.lit(j).cast("long").alias("column"), F.slice("v", j * wide + 1, wide).alias("v"))
                      for j in range(-(-dims // wide))])
    cells = rows.select(F.floor(F.col("rank") / opts.block_rows).alias("row"), (F.col("rank") % opts.block_rows).alias("at"),
                        F.explode(parts).alias("p")).select("row", "at", "p.*")
    made = cells.groupBy("row", "column").agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("rows"))
    made = made.select(
        F.struct(F.col("row").cast("long").alias("_1"), F.col("column").alias("_2")).alias("place"),
        F.struct(F.lit(1).cast("byte").alias("type"), F.size("rows").alias("numRows"),
                 F.size(F.col("rows")[0]["v"]).alias("numCols"), F.lit(None).cast("array<int>").alias("colPtrs"),
                 F.lit(None).cast("array<int>").alias("rowIndices"),
                 F.flatten(F.transform("rows", lambda r: r["v"])).alias("values"),
                 F.lit(True).alias("isTransposed")).alias("block"))  # values row by row
    java = callMLlibFunc("createBlockMatrix", stored(made, name, _BLOCK), opts.block_rows, wide, n, dims)
    return BlockMatrix(java, opts.block_rows, wide)


def gram(matrix: BlockMatrix, opts: Whitening) -> np.ndarray:
    """The transposed matrix times the matrix. The rows are split over tasks, and the
    tasks' products summed: without it one task would take them all."""
    turned = matrix.transpose()
    splits = max(1, math.ceil(matrix.numRows() / opts.block_rows / opts.blocks_per_split))
    java = turned._java_matrix_wrapper.call("multiply", matrix._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(java, turned.rowsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()


def _projection(w: np.ndarray, spark, opts: Whitening) -> BlockMatrix:
    """The whitening matrix: dimensions x components."""
    step = opts.block_columns
    parts = [((i, 0), Matrices.dense(len(w[i * step:(i + 1) * step]), w.shape[1], w[i * step:(i + 1) * step].flatten("F").tolist()))
             for i in range(-(-len(w) // step))]
    return BlockMatrix(spark.sparkContext.parallelize(parts, 1), step, w.shape[1], *w.shape)


def _numbers(values, kind: str) -> Column:
    return F.array(*[F.lit(v).cast(kind) for v in values])


def _deviation(n: int, sums: list[int], low: list[int], high: list[int]) -> Column:
    """Sum over dimensions of (n x - S)^2: as long where that holds every step, else by
    decimals; null beyond a long."""
    furthest = max(max(n * b - s, s - n * a) for s, a, b in zip(sums, low, high))
    largest = max(n * max(abs(a), abs(b)) for a, b in zip(low, high))
    if largest < 1 << 62 and furthest ** 2 * len(sums) < 1 << 63:
        apart = F.zip_with("x", _numbers(sums, "long"), lambda x, s: F.lit(n).cast("long") * x - s)
        return F.aggregate(apart, F.lit(0).cast("long"), lambda acc, d: acc + d * d)
    whole = "decimal(38,0)"
    apart = F.zip_with("x", _numbers([str(s) for s in sums], whole), lambda x, s: F.try_subtract(
        F.try_multiply(F.lit(str(n)).cast("decimal(19,0)"), x.cast("decimal(19,0)")).cast(whole), s).try_cast(whole))
    total = F.aggregate(apart, F.lit("0").cast(whole), lambda acc, d: F.try_add(acc, F.try_multiply(d, d).try_cast(whole)).try_cast(whole))
    return total.try_cast("long")


def whiten(embeddings: DataFrame, opts: Whitening = Whitening()) -> DataFrame:
    """For each usable row and component: vec_id, component (from 1), n (distinct vectors),
    deviation, whitened, explained, identity_error.

    Rows whose vector is null, empty, of another length than most (of equally common
    lengths the greatest counts), or holds a null or not finite entry are left out; so are
    entries beyond a long, counted as not finite. Repeated rows are returned as often as
    they stand, and count once in the fit. Null ids stay. Vectors with fewer than 16
    dimensions have as many components. A component without variance has a null whitened
    value and explains nothing (null if there is no variance at all); the identity error is
    over the others, and 0 without any. deviation is null beyond a long. No usable row
    gives no rows. Columns other than vec_id and embedding are not read.
    """
    spark = embeddings.sparkSession
    rows = numbered(grid(embeddings, opts), "whiten-rows")
    fit = numbered(rows.select("x").distinct(), "whiten-fit")
    head = fit.select(F.size("x").alias("dims"), "n").first()
    if head is None:
        return rows.select("vec_id", F.lit(0).alias("component"), "n", *[F.lit(0).cast("long").alias("deviation")], *[
            F.lit(0.0).alias(c) for c in ("whitened", "explained", "identity_error")])
    dims, n = head["dims"], head["n"]
    total = rows.agg(F.max("n")).first()[0]
    entry = [F.get("x", F.lit(i)) for i in range(dims)]
    stats = fit.agg(*[agg(e).alias(f"{name}{i}") for name, agg in (("s", F.sum), ("a", F.min), ("b", F.max))
                      for i, e in enumerate(entry)]).first()
    sums, low, high = ([int(stats[f"{name}{i}"]) for i in range(dims)] for name in "sab")
    mean = _numbers([s / n for s in sums], "double")

    def centred(df: DataFrame) -> DataFrame:
        return df.select("rank", F.zip_with("x", mean, lambda x, m: x.cast("double") - m).alias("v"))

    listed = blocks(centred(fit), dims, n, opts, "whiten-fit-blocks")
    cov = gram(listed, opts) / n
    e, vectors = np.linalg.eigh((cov + cov.T) / 2)
    e, vectors = e[::-1], vectors[:, ::-1]
    k = min(opts.components, dims)
    good = e[:k] > opts.least * max(e[0], 0.0)
    w = vectors[:, :k] / np.sqrt(np.where(good, e[:k], 1.0))
    projection = _projection(w, spark, opts)
    error = np.abs(gram(listed.multiply(projection), opts) / n - np.eye(k))[good][:, good].max(initial=0.0)

    # All rows, as blocks again; the product's blocks hold their values column by column.
    made = blocks(centred(rows), dims, total, opts, "whiten-blocks").multiply(projection)
    made = callMLlibFunc("getMatrixBlocks", made._java_matrix_wrapper._java_model).toDF("place", "block")
    made = stored(made, "whiten-projected", _PLAIN)
    value, height = F.col("block.values"), F.col("block.numRows")
    projected = made.select((F.col("place._1") * opts.block_rows).alias("base"), value.alias("v"), height.alias("h"),
                            F.explode(F.sequence(F.lit(0), height - 1)).alias("at"))
    projected = projected.select((F.col("base") + F.col("at")).alias("rank"), F.array(*[
        F.get("v", F.col("at") + F.col("h") * j) if good[j] else F.lit(None).cast("double") for j in range(k)]).alias("w"))
    out = rows.select("rank", "vec_id", _deviation(n, sums, low, high).alias("deviation")).join(projected, "rank")
    share = e[:k] / e.sum() if e.sum() > 0 else None
    out = out.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    explained = F.lit(None).cast("double") if share is None else F.element_at(_numbers(share.tolist(), "double"), F.col("at") + 1)
    return out.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                      explained.alias("explained"), F.lit(float(error)).alias("identity_error"))
