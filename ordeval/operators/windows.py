"""Ranks, top rows and winners (survey W01-W07, O01-O08)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordeval.operators.ranks import with_keys


def average_rank(df: DataFrame, value: str, *keys: str, out: str = "rank") -> DataFrame:
    """W02 for a small table, such as one row for each feature, by windows over whole groups; ``ranks.average_rank`` takes any size."""
    order = Window.partitionBy(*keys).orderBy(F.desc(value))
    ties = Window.partitionBy(*keys, value)
    return df.withColumn(out, F.rank().over(order) + (F.count("*").over(ties) - 1) / F.lit(2.0))


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group; ``order`` must break ties."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("place", place).where(F.col("place") <= k)


def with_group_share(df: DataFrame, value: str, *keys: str, out: str = "share") -> DataFrame:
    """Value over its group's total: totals are added up in parts and joined, so no task holds a group."""
    totals = df.groupBy(*keys).agg(F.sum(value).alias("__whole"))
    joined = with_keys(df, totals, keys) if keys else df.crossJoin(totals)  # one row
    return joined.withColumn(out, F.col(value) / F.col("__whole")).drop("__whole")


def best_row(df: DataFrame, keys: Sequence[str], value: str, tie: str, what: Sequence[str]) -> DataFrame:
    """The row with the largest value, ties to the least ``tie``; one aggregation, no window."""
    packed = F.struct((-F.col(value)).alias("v"), F.col(tie).alias("t"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(what)])
    found = df.groupBy(*keys).agg(F.min(packed).alias("b"))
    return found.select(*keys, (-F.col("b.v")).alias(value), *[F.col(f"b.o{i}").alias(c) for i, c in enumerate(what)])


def select_candidate(candidates: DataFrame, base_qwk: float | Column, base_recall: float | Column, keys: Sequence[str] = ()) -> DataFrame:
    """Best eligible candidate (qwk and recall_2 not much below the baseline); all count if none is eligible."""
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    fits = (F.col("qwk") >= as_column(base_qwk) - 0.01) & (F.col("recall_2") >= as_column(base_recall) - 0.05)
    group = Window.partitionBy(*keys)
    order = group.orderBy(F.desc("macro_f1"), F.desc("qwk"), F.desc("recall_2"), "complexity", "candidate")
    marked = candidates.withColumn("eligible", fits).withColumn("any_eligible", F.max("eligible").over(group))
    pool = marked.where(F.col("eligible") | ~F.col("any_eligible"))
    return pool.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def codes_first(column: str) -> list[Column]:
    """Numbers before text, numbers by value."""
    number = F.col(column).rlike(r"^-?\d+$")
    return [(~number).cast("int").asc(), F.when(number, F.col(column)).try_cast("bigint").asc(), F.col(column).asc()]


def rank_correlation(df: DataFrame, a: str, b: str, *keys: str) -> DataFrame:
    """Spearman's correlation of two columns within each group; a constant column gives null."""
    ranked = average_rank(average_rank(df, a, *keys, out="__a"), b, *keys, out="__b")
    return ranked.groupBy(*keys).agg(F.corr("__a", "__b").alias("rho"))
