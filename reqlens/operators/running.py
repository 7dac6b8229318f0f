"""Running aggregates that no single hot key or value can serialise.

A plain `sum() over (partition by client order by ts)` puts all rows of a client
into one task. Here the order axis is cut into blocks: rows run inside
(key, block) partitions, block totals run per key, and the two are added.
"""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SKETCH = 10_000        # accuracy of percentile sketches: ranks are off by a ten-thousandth of the rows at most
BRACKET = 0.0006       # half a bracket: five times the sketch's error, and a few ranks
SKETCH_ROWS = 20_000   # columns of so few rows are ranked whole: there the few ranks are more than that
EDGES = 512            # quantiles that cut the values of a column
BUCKET_ROWS = 100_000  # rows of a bucket, about


def running(df: DataFrame, keys: Sequence[str], at: str, value: str, out: str,
            width: int, ties: Sequence[str] = (), kind: str = "sum") -> DataFrame:
    """Adds `out`: inclusive running sum (or max) of `value` per `keys`, in order
    of the integer column `at`, then `ties`.

    Block totals are one row per key and block: with 60-second blocks a key that
    never pauses has 525,600 a year, whatever number of rows it has.
    """
    agg = F.sum if kind == "sum" else F.max
    block, before = f"_{out}_block", f"_{out}_before"
    keys = list(keys)
    rows = df.withColumn(block, F.floor(F.col(at) / width).cast("bigint"))

    earlier = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    totals = (rows.groupBy(*keys, block).agg(agg(value).alias("_total"))
              .select(*keys, block, agg("_total").over(earlier).alias(before)))

    so_far = Window.partitionBy(*keys, block).orderBy(at, *ties).rowsBetween(
        Window.unboundedPreceding, 0)
    rows = rows.withColumn(out, agg(value).over(so_far)).join(totals, [*keys, block], "left")
    both = (F.coalesce(F.col(before), F.lit(0)) + F.coalesce(F.col(out), F.lit(0))
            if kind == "sum" else F.greatest(before, out))
    return rows.withColumn(out, both).drop(block, before)


def usable(value: Column) -> Column:
    """The value as a double, NULL where it is missing or not a number."""
    value = value.cast("double")
    return F.when(~F.isnan(value), value)


def _buckets(value: str) -> Column:
    """Bucket number of a value: its interval between quantiles, and, where a
    quantile stands for more than BUCKET_ROWS rows, an equal slice of the interval."""
    at = F.size(F.filter("_edges", lambda e: e <= F.col(value)))
    low, high = F.get("_edges", at - 1), F.get("_edges", at)
    slices = F.greatest(F.lit(1), F.ceil(F.col("_rows") / (EDGES * BUCKET_ROWS)))
    part = F.when(low.isNotNull() & high.isNotNull() & (high > low) & (low > F.lit(float("-inf"))),
                  F.floor((F.col(value) - low) / (high - low) * slices)).otherwise(0)
    return at.cast("bigint") * slices + F.least(part.cast("bigint"), slices - 1)


def cumulative_by_value(df: DataFrame, value: str, sums: dict[str, Column],
                        descending: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """One row per distinct `value` (and `by`) with its `sums` and their running
    totals (`cum_<name>`, inclusive) in value order. Missing values and NaN are
    left out.

    Values are first combined map-side, then cut at approximate quantiles, EDGES
    of them for each `by`, and further where the data is large, so a bucket stays
    small however many rows there are and however they cluster. Edges and bucket
    totals are small tables.
    """
    by = list(by)
    key = by or ["_all"]
    rows = df if by else df.withColumn("_all", F.lit(0))
    rows = rows.withColumn(value, usable(F.col(value))).filter(F.col(value).isNotNull())
    steps = [i / EDGES for i in range(1, EDGES)]
    edges = rows.groupBy(*key).agg(
        F.array_distinct(F.percentile_approx(value, steps, 10_000)).alias("_edges"),
        F.count(F.lit(1)).alias("_rows"))

    grouped = rows.groupBy(*key, value).agg(*[F.sum(col).alias(name) for name, col in sums.items()])
    grouped = grouped.join(F.broadcast(edges), key)  # EDGES numbers for each key
    grouped = grouped.withColumn("_bucket", _buckets(value)).drop("_edges", "_rows")

    def way(col):
        return F.desc(col) if descending else F.asc(col)

    earlier = Window.partitionBy(*key).orderBy(way("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    totals = (grouped.groupBy(*key, "_bucket").agg(*[F.sum(n).alias(n) for n in sums])
              .select(*key, "_bucket", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(
                  f"_before_{n}") for n in sums]))
    inside = Window.partitionBy(*key, "_bucket").orderBy(way(value)).rowsBetween(
        Window.unboundedPreceding, 0)
    out = grouped.join(totals, [*key, "_bucket"])
    return out.select(*by, value, *sums, *[
        (F.sum(n).over(inside) + F.col(f"_before_{n}")).alias(f"cum_{n}") for n in sums])


def _brackets(df: DataFrame, columns: Sequence[str], wanted: dict[str, float]) -> list[tuple]:
    """(column, name, low, high, lower rank, upper rank, share between them) for each usable
    column and percentile: values that surely enclose it, from one sketch per column."""
    aside = [q for p in wanted.values() for q in (max(0.0, p - BRACKET), min(1.0, p + BRACKET))]
    facts = df.agg(*[F.struct(
        F.count(usable(F.col(c))).alias("n"), F.min(usable(F.col(c))).alias("least"), F.max(usable(F.col(c))).alias("most"),
        F.percentile_approx(usable(F.col(c)), aside, SKETCH).alias("q")).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    out = []
    for i, c in enumerate(columns):
        f = facts[f"c{i}"]
        for k, (name, p) in enumerate(wanted.items()):
            if f["n"]:
                spot = (f["n"] - 1) * p
                small = f["n"] <= SKETCH_ROWS
                low = f["least"] if small or p <= BRACKET else f["q"][2 * k]
                high = f["most"] if small or p >= 1 - BRACKET else f["q"][2 * k + 1]
                out.append((c, name, low, high, math.floor(spot), math.ceil(spot), spot - math.floor(spot)))
    return out


def percentiles_by(df: DataFrame, columns: Sequence[str], wanted: dict[str, float]) -> DataFrame:
    """Per column, exact, linearly interpolated percentiles (0..1): (column, <names>).

    Two scans for any number of columns. The first, run here, sketches all of them; the
    sketch's error is bounded, so each percentile lies in a bracket of a thousandth of the
    rows. The second counts the rows below each bracket and ranks the distinct values
    inside. The built-in exact `percentile` keeps every distinct value of a column in one
    task. A column without a usable value has NULLs.
    """
    spark, found = df.sparkSession, _brackets(df, columns, wanted)
    if not found:
        names = spark.createDataFrame([(c,) for c in columns], "column string").coalesce(1)
        return names.select("column", *[F.lit(None).cast("double").alias(n) for n in wanted])
    entries = []
    for at, (c, _, low, high, *_) in enumerate(found):
        value = usable(F.col(c))
        # Rows below the bracket are only counted; those above it are left out.
        entries.append(F.when(value <= F.lit(high), F.struct(
            F.lit(at).alias("at"), F.when(value >= F.lit(low), value).alias("value"))))
    rows = df.select(F.inline(F.filter(F.array(*entries), lambda e: e.isNotNull())))
    counts = rows.groupBy("at", "value").agg(F.count(F.lit(1)).alias("n"))
    so_far = Window.partitionBy("at").orderBy(F.asc_nulls_first("value")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("to", F.sum("n").over(so_far))

    def pick(field: int) -> Column:
        rank = F.lit(None).cast("bigint")
        for at, bracket in enumerate(found):
            rank = F.when(F.col("at") == at, F.lit(bracket[field]).cast("bigint")).otherwise(rank)
        return F.max(F.when((F.col("to") - F.col("n") <= rank) & (rank < F.col("to")), F.col("value")))
    picked = ranked.groupBy("at").agg(pick(4).alias("lo"), pick(5).alias("hi"))
    # A bracket that missed would be a wrong result: fail instead.
    sure = F.when(F.col("lo").isNotNull() & F.col("hi").isNotNull(), F.lit(True)).otherwise(
        F.raise_error(F.lit("a percentile lies outside its bracket")).cast("boolean"))

    def final(c: str, name: str) -> Column:
        for at, (column, of, *_, share) in enumerate(found):
            if (column, of) == (c, name):
                return F.max(F.when((F.col("at") == at) & sure, F.col("lo") + (F.col("hi") - F.col("lo")) * share))
        return F.lit(None).cast("double")
    parts = picked.agg(*[F.struct(F.lit(c).alias("column"), *[final(c, n).alias(n) for n in wanted]).alias(f"c{i}")
                         for i, c in enumerate(columns)])
    return parts.select(F.inline(F.array(*[F.col(f"c{i}") for i in range(len(columns))])))


def percentiles(df: DataFrame, value: str, wanted: dict[str, float]) -> DataFrame:
    """One row of percentiles of one column; see percentiles_by."""
    return percentiles_by(df, [value], wanted).select(*wanted)
