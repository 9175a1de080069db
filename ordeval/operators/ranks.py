"""Exact ranks and quantiles from counts of values; nothing holds a whole group.

Equal values are counted first. The counts are dealt over tasks by ranges of (keys, value) that Spark balances, and
written once, so that a range's number is data. A window then holds one group's values within one range, and another one
one row for each range of a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordeval.sources.shared import new_path


def with_keys(df: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, null being equal to null; ``small``'s keys are dropped."""
    renamed = small.select(*[F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)], *[c for c in small.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"__key{i}")) for i, k in enumerate(keys)]
    return df.join(renamed, on, how).drop(*[f"__key{i}" for i in range(len(keys))])


def value_counts(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """(keys, value, n, before, total): rows with the value, rows of the group with a smaller one, all with a value.

    A null value has its own row with ``before`` 0 and is in no other number; NaN is the largest value, null keys are
    a group.
    """
    counted = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    path = new_path(df.sparkSession, "value-counts")
    counted.repartitionByRange(*[F.col(k) for k in keys], F.col(value)).withColumn("__range", F.spark_partition_id()).write.parquet(path)
    counts = df.sparkSession.read.schema(T.StructType([*counted.schema, T.StructField("__range", T.IntegerType())])).parquet(path)
    real = F.when(F.col(value).isNotNull(), F.col("n")).otherwise(0)
    group = Window.partitionBy(*keys)
    above = group.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = counts.groupBy(*keys, "__range").agg(F.sum(real).alias("__n")).select(
        *keys, "__range", F.coalesce(F.sum("__n").over(above), F.lit(0)).alias("__start"), F.sum("__n").over(group).alias("total")
    )
    inside = Window.partitionBy(*keys, "__range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("__inside", F.coalesce(F.sum(real).over(inside), F.lit(0)))
    joined = with_keys(placed, ranges, [*keys, "__range"])
    return joined.select(*keys, value, "n", (F.col("__start") + F.col("__inside")).alias("before"), "total")


def quantile(value: str, p: float) -> Column:
    """Aggregate over ``value_counts``: the exact quantile with linear interpolation; null without values."""
    at = F.lit(p) * (F.col("total") - 1)
    holds = lambda i: F.max(F.when((F.col("before") <= i) & (i < F.col("before") + F.col("n")) & F.col(value).isNotNull(), F.col(value)))
    low, high, part = holds(F.floor(at)), holds(F.ceil(at)), F.max(at - F.floor(at))
    return F.when(low == high, low.cast("double")).otherwise(low * (1 - part) + high * part)


def mean(value: str) -> Column:
    """Aggregate over ``value_counts``: the mean of the values."""
    return F.sum(F.col(value) * F.col("n")) / F.sum(F.when(F.col(value).isNotNull(), F.col("n")))


def average_rank(df: DataFrame, value: str, *keys: str, out: str = "rank") -> DataFrame:
    """Rank by descending value, ties share their mean rank; nulls come last."""
    counts = value_counts(df.select(*keys, value), value, *keys)
    greater = F.when(F.col(value).isNull(), F.col("total")).otherwise(F.col("total") - F.col("before") - F.col("n"))
    rank = greater + (F.col("n") + 1) / F.lit(2.0)
    return with_keys(df, counts.select(*keys, value, rank.alias(out)), [*keys, value])


def global_place(df: DataFrame, order: Sequence[Column], out: str = "place") -> DataFrame:
    """The row's place, from 1, in a sort of the whole table: sorted ranges, written once, and their sizes."""
    path = new_path(df.sparkSession, "sorted")
    df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()).write.parquet(path)
    rows = df.sparkSession.read.schema(T.StructType([*df.schema, T.StructField("__at", T.LongType())])).parquet(path)
    part, inside = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)  # the parts of the id, by its definition
    rows = rows.withColumns({"__part": part, "__inside": inside})
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each task of the sort
    sizes = rows.groupBy("__part").agg(F.count("*").alias("__n"))
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    place = F.col("__start") + F.col("__inside") + 1
    return rows.join(starts, "__part").select(*df.columns, place.alias(out))
