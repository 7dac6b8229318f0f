"""Helpers that several corpus operators share."""
from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from reqlens.operators.running import running
from reqlens.session import checkpoint_root

WORD = r"[^\x20\x09-\x0D]+"


def stored(df: DataFrame, name: str, schema: StructType | None = None) -> DataFrame:
    """Writes df to the cluster's shared folder and reads it back: a lost executor
    costs a re-read, and Spark knows the table's true size when it plans joins. schema:
    to read it with, if its types have another form of the same content."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(schema or df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def row_key(column: str = "text") -> Column:
    """With doc_id, tells a row from all rows but its exact repeats."""
    return F.xxhash64(F.col(column).isNull(), text_of(column))


def packed(docs: DataFrame) -> DataFrame:
    """row (all columns of docs, whatever their names), doc_id and key."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id",
                       row_key().alias("key"))


def without(docs: DataFrame, bad: DataFrame) -> DataFrame:
    """docs without the rows of the (doc_id, key) pairs of bad. Columns stay as they are."""
    bad = bad.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"))
    rows = packed(docs)
    return rows.join(bad, rows["doc_id"].eqNullSafe(bad["_id"]) & (rows["key"] == bad["_key"]),
                     "left_anti").select("row.*")


def draw_rate(n: int, count: int) -> float:
    """The share of `count` rows that yields n of them almost surely, and hardly more.
    Sampling by rate first keeps a bounded sample from gathering n rows of every task."""
    return min(1.0, (n + 6 * math.sqrt(n) + 10) / max(1, count))


def place_of(hashed: str) -> Column:
    """A hash as a number from 0 to 1."""
    return F.pmod(F.col(hashed), F.lit(1 << 32)) / float(1 << 32)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def n_words(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def prefix_sums(xs: Column, chunk: int = 256) -> Column:
    """Inclusive running sums of an array of long, in chunks so that long arrays
    aren't copied once per element."""
    def running(part: Column, base: Column) -> Column:
        return F.aggregate(part, F.array(base), lambda acc, x: F.concat(
            acc, F.array(F.element_at(acc, -1) + x)),
            lambda acc: F.slice(acc, F.lit(2), F.size(acc)))

    def whole(parts: Column) -> Column:
        totals = F.transform(parts, lambda p: F.aggregate(p, F.lit(0).cast("long"),
                                                          lambda a, x: a + x))
        bases = F.aggregate(totals, F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(
            acc, F.array(F.element_at(acc, -1) + x)))
        return F.flatten(F.transform(F.arrays_zip(parts.alias("p"), bases.alias("b")), lambda z: (
            F.when(z["p"].isNotNull(), running(z["p"], z["b"]))
            .otherwise(F.array().cast("array<bigint>")))))

    count = F.size(xs)
    parts = F.when(count > 0, F.transform(
        F.sequence(F.lit(0), F.floor((count - 1) / chunk).cast("int")),
        lambda c: F.slice(xs, c * chunk + 1, F.lit(chunk)))).otherwise(
        F.array().cast("array<array<bigint>>"))
    return let(parts, whole)


def numbered(rows: DataFrame, name: str, group: str | None = None, order: list[str] = []) -> DataFrame:  # noqa: B006
    """rows with `rank` (from 0) and `n` (rows) within the group, a column without nulls:
    in the order of `order`, or of the input. Rows that tie are told apart by an arbitrary
    number, so copies of one row spread over tasks like others.

    Sorted ranges are written with their rows' places. A row's rank is its place among
    its group in its range, and the sum of the ranges before: tables with a row per
    range and group. No task sees more than a range.
    """
    by = group or "_all"
    rows = rows if group else rows.withColumn(by, F.lit(0))
    if order:
        keys = [by, *order, "_tie"]
        rows = rows.withColumn("_tie", F.monotonically_increasing_id())
        rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
    # The number of a task's first row is its partition times 2^33.
    rows = stored(rows.withColumn("_at", F.monotonically_increasing_id()), name).withColumn(
        "_part", F.shiftright("_at", 33))
    counts = rows.groupBy(by, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    ends = stored(running(counts, [by], "_part", "_n", "_end", width=1024), f"{name}-ends")
    ends = ends.join(ends.groupBy(by).agg(F.sum("_n").alias("n")), by).select(
        by, "_part", (F.col("_end") - F.col("_n") - F.col("_first")).alias("_base"), "n")
    out = rows.join(ends, [by, "_part"]).withColumn("rank", F.col("_at") + F.col("_base")).drop("_at", "_part", "_base")
    return out if group else out.drop(by)
