"""Guards (survey F08-F11, U04, U07, J05, J07): each returns the violations, ``require`` turns them into an error."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A table breaks its contract."""


def require(violations: DataFrame, what: str) -> None:
    """Raise unless there are no violations; shows one of them."""
    first = violations.limit(1).collect()
    if first:
        raise ContractError(f"{what}: {first[0].asDict()}")


def repeated_keys(df: DataFrame, *keys: str) -> DataFrame:
    """keys that are null or not unique."""
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where((F.col("rows") > 1) | null)


def domain_differences(df: DataFrame, column: str, expected: Sequence) -> DataFrame:
    """observed values that aren't expected, and expected ones that aren't observed."""
    wanted = F.array(*[F.lit(v) for v in expected])
    seen = df.agg(F.collect_set(column).alias("seen"))
    return seen.select(
        F.explode(F.concat(
            F.transform(F.array_except("seen", wanted), lambda v: F.struct(v.cast("string").alias("value"), F.lit("unexpected").alias("problem"))),
            F.transform(F.array_except(wanted, "seen"), lambda v: F.struct(v.cast("string").alias("value"), F.lit("missing").alias("problem"))),
        )).alias("d")
    ).select("d.*")


def simplex_violations(df: DataFrame, probabilities: Sequence[str] | str, tolerance: float = 2e-8) -> DataFrame:
    """rows whose probabilities are null, not finite, outside 0..1 or don't sum to 1: columns, or one array (violated if null).

    Spark moves a filter below what computes its columns and computes them again wherever they are named. Here each is named
    once, as what a lambda's variable stands for.
    """
    given = F.col(probabilities) if isinstance(probabilities, str) else F.array(*[F.col(p).cast("double") for p in probabilities])
    wrong = lambda c: c.isNull() | F.isnan(c) | ~c.between(0.0, 1.0)
    broken = lambda a: a.isNull() | F.exists(a, wrong) | (F.abs(F.aggregate(a, F.lit(0.0), lambda s, x: s + x) - 1.0) > tolerance)
    return df.where(F.exists(F.array(given), broken))


def varying_columns(df: DataFrame, *columns: str) -> DataFrame:
    """of columns that must be constant, those with another number of values than one."""
    counted = df.agg(*[F.countDistinct(c).alias(c) for c in columns])
    return counted.unpivot([], list(columns), "column", "values").where("values <> 1")


def shared_ids(assigned: DataFrame, id_col: str, role_col: str) -> DataFrame:
    """Ids with more than one role, with the roles."""
    return (
        assigned.groupBy(id_col)
        .agg(F.countDistinct(role_col).alias("roles"), F.concat_ws(";", F.sort_array(F.collect_set(role_col))).alias("found"))
        .where("roles > 1")
    )


def cover_summary(assigned: DataFrame, everything: DataFrame, id_col: str) -> DataFrame:
    """Rows, distinct ids, ids expected; a partition has all three equal."""
    a = assigned.agg(F.count("*").alias("assigned_rows"), F.countDistinct(id_col).alias("assigned_ids"))
    b = everything.agg(F.countDistinct(id_col).alias("expected_ids"))
    return a.crossJoin(b).withColumn(  # one row each
        "is_partition", (F.col("assigned_rows") == F.col("assigned_ids")) & (F.col("assigned_ids") == F.col("expected_ids"))
    )


def misaligned(left: DataFrame, right: DataFrame, id_col: str, *values: str) -> DataFrame:
    """Ids that only one side has, or whose ``values`` differ."""
    l_, r_ = left.alias("l"), right.alias("r")
    differs = F.lit(False)
    for v in values:
        differs = differs | ~F.col(f"l.{v}").eqNullSafe(F.col(f"r.{v}"))
    joined = l_.join(r_, F.col(f"l.{id_col}") == F.col(f"r.{id_col}"), "full_outer")
    problem = (
        F.when(F.col(f"l.{id_col}").isNull(), "only_right")
        .when(F.col(f"r.{id_col}").isNull(), "only_left")
        .when(differs, "different")
    )
    return joined.select(F.coalesce(f"l.{id_col}", f"r.{id_col}").alias(id_col), problem.alias("problem")).where("problem IS NOT NULL")


def outside(df: DataFrame, allowed: DataFrame, *keys: str) -> DataFrame:
    """Rows whose key isn't in ``allowed``."""
    return df.join(allowed, list(keys), "left_anti")


def not_null(*columns: str) -> Column:
    """All columns are there."""
    found = F.lit(True)
    for c in columns:
        found = found & F.col(c).isNotNull()
    return found
