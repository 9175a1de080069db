"""Joins with checked cardinality and side marks (survey J01-J06, J09, J11, J14, J15)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordeval.operators.guards import repeated_keys, require


def one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "full_outer", check: bool = True) -> DataFrame:
    """Both sides are unique on the keys; null or repeated keys are an error."""
    if check:
        require(repeated_keys(left, *keys), "the left side repeats a key")
        require(repeated_keys(right, *keys), "the right side repeats a key")
    return left.join(right, list(keys), how)


def with_deltas(joined: DataFrame, columns: Sequence[str], left: str = "_a", right: str = "_b") -> DataFrame:
    """Difference of each column's two sides."""
    return joined.withColumns({f"{c}_delta": F.col(f"{c}{left}") - F.col(f"{c}{right}") for c in columns})


def many_to_one(facts: DataFrame, dimension: DataFrame, keys: Sequence[str], check: bool = True) -> DataFrame:
    """A dimension that is unique on the keys joined to facts; Spark broadcasts it if it is small."""
    if check:
        require(repeated_keys(dimension, *keys), "the dimension repeats a key")
    return facts.join(dimension, list(keys), "left")


def stacked_predictions(predictions: DataFrame, id_col: str, model: str, predicted: str, models: Sequence[str]) -> DataFrame:
    """One row for each id with a column for each model; one aggregation instead of a chain of joins."""
    columns = [F.max(F.when(F.col(model) == m, F.col(predicted))).alias(f"pred_{m}") for m in models]
    return predictions.groupBy(id_col).agg(*columns)


def outer_sides(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Which side has each key."""
    l_ = left.select(*keys).withColumn("__l", F.lit(True))
    r_ = right.select(*keys).withColumn("__r", F.lit(True))
    side = F.when(F.col("__r").isNull(), "missing").when(F.col("__l").isNull(), "extra").otherwise("common")
    return l_.join(r_, list(keys), "full_outer").select(*keys, side.alias("side"))


def cohort_gap(values: DataFrame, internal: str, future: str, keys: Sequence[str], cohort: str = "cohort", value: str = "value") -> DataFrame:
    """Internal minus future of the same keys; one aggregation instead of a self-join."""
    side = lambda c: F.max(F.when(F.col(cohort) == c, F.col(value)))
    return values.groupBy(*keys).agg(side(internal).alias("internal"), side(future).alias("future")).withColumn(
        "gap", F.col("internal") - F.col("future")
    )


def labelled_difference(left: DataFrame, right: DataFrame, keys: Sequence[str], left_label: str, right_label: str) -> DataFrame:
    """What only one side has, with the side's label."""
    names = list(keys)
    a = left.select(names).distinct().join(right.select(names), names, "left_anti").withColumn("side", F.lit(left_label))
    b = right.select(names).distinct().join(left.select(names), names, "left_anti").withColumn("side", F.lit(right_label))
    return a.unionByName(b)
