"""Roles, hash-ranked samples and allocations (survey R01-R06, F06, F07, W03).

Membership depends on a hash of seed and id only, so it is the same on any cluster. The first rows of a class are
found as a cut of the hash: ranges of the hash are counted, and only the range of the cut is ranked. No window holds a
whole class.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordeval.functions.columns import hash32
from ordeval.operators.ranks import with_keys
from ordeval.sources.shared import new_path

SEEDS = (1103, 2207, 3301, 4409, 5501)
SECOND_STAGE = 1_000_003
#: Hash ranges that a class is cut into for ranking.
RANGES = 1024


def temporal_role(year: Column, train: Sequence[int], validation: Sequence[int], test: Sequence[int]) -> Column:
    """A year outside the three lists is an error."""
    return (
        F.when(year.isin(*train), "train").when(year.isin(*validation), "validation").when(year.isin(*test), "test")
        .otherwise(F.raise_error(F.concat(F.lit("no role for year "), year.cast("string"))))
    )


def _hash(seed: int | Column, id_col: str) -> Column:
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    return hash32(F.concat(seed.cast("string"), F.lit(":"), F.col(id_col).cast("string")))


def _range(ranges: int) -> Column:
    return F.floor(F.col("__h") * ranges / F.lit(4294967296)).cast("int")


def rank_in_class(
    df: DataFrame, seed: int | Column, id_col: str, *keys: str, out: str = "rank", size: str | None = None, ranges: int = RANGES
) -> DataFrame:
    """``df`` with the rank by hash within ``keys``: rows of lower hash ranges, counted, plus the rank in its own range.
    ``size`` names a column for the number of rows with these keys. ``seed`` may be a column."""
    hashed = df.withColumn("__h", _hash(seed, id_col)).withColumn("__r", _range(ranges))
    sized = hashed.groupBy(*keys, "__r").agg(F.count("*").alias("__n"))
    group = Window.partitionBy(*keys)
    before = group.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    starts = sized.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    starts = starts.withColumn(size, F.sum("__n").over(group)).drop("__n") if size else starts.drop("__n")
    within = F.row_number().over(Window.partitionBy(*keys, "__r").orderBy("__h", id_col))
    return hashed.withColumn("__w", within).join(starts, [*keys, "__r"]).withColumn(out, F.col("__before") + F.col("__w")).drop("__h", "__r", "__w", "__before")


def class_sizes(df: DataFrame, *keys: str, out: str = "n_class") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(out))


def hash_cuts(df: DataFrame, seed: int | Column, id_col: str, keys: Sequence[str], quota: Column, quotas: DataFrame | None = None) -> DataFrame:
    """(keys, __cut_hash, __cut_id): hash and id of the last row of each group's first ``quota`` rows by (hash, id).

    No row is shuffled but those of the one hash range of each group that holds the cut: hash ranges are counted first.
    ``quota`` is an expression of ``__size``, the rows of the group, and of the columns of ``quotas`` (one row a group). The
    result, at most one row a group, is written once. Ids are unique; equal ids stay together.
    """
    hashed = df.select(*keys, id_col, _hash(seed, id_col).alias("__h")).withColumn("__r", _range(RANGES))
    group = Window.partitionBy(*keys)
    before = group.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    sized = hashed.groupBy(*keys, "__r").agg(F.count("*").alias("__n")).withColumns({"__size": F.sum("__n").over(group), "__before": F.coalesce(F.sum("__n").over(before), F.lit(0))})
    sized = with_keys(sized, quotas, keys) if quotas is not None else sized
    need = quota.cast("long") - F.col("__before")
    edges = sized.withColumn("__need", F.least(need, F.col("__size") - F.col("__before"))).where((F.col("__need") > 0) & (F.col("__need") <= F.col("__n")))
    near = with_keys(hashed, edges.select(*keys, "__r", "__need"), [*keys, "__r"])
    place = F.row_number().over(group.orderBy("__h", id_col))
    cuts = near.withColumn("__place", place).where("__place = __need").select(*keys, F.col("__h").alias("__cut_hash"), F.col(id_col).alias("__cut_id"))
    path = new_path(df.sparkSession, "cuts")
    cuts.write.parquet(path)
    return df.sparkSession.read.schema(cuts.schema).parquet(path)


def first_by_hash(df: DataFrame, cuts: DataFrame, seed: int | Column, id_col: str, keys: Sequence[str], out: str) -> DataFrame:
    """``df`` with a mark of the rows up to their group's cut; a group without a cut has none."""
    joined = with_keys(df.withColumn("__h", _hash(seed, id_col)), cuts, keys, "left")
    h, at = F.col("__h"), F.col("__cut_hash")
    inside = (h < at) | ((h == at) & (F.col(id_col) <= F.col("__cut_id")))
    return joined.withColumn(out, F.coalesce(inside, F.lit(False))).drop("__h", "__cut_hash", "__cut_id")


def random_roles(
    df: DataFrame, seed: int | Column, id_col: str, target: str, locked: Column, train: float = 0.7, validation: float = 0.15, by: Sequence[str] = ()
) -> DataFrame:
    """Stratified 70/15/15 in two stages with exact sizes in each class; ``locked`` rows stay out.

    Rows aren't shuffled: each stage finds the cuts of its groups, then roles are comparisons with them. The cuts are found
    in a copy of the keys and ids that is written once, so ``df`` itself is evaluated twice. ``by`` may hold a column of
    seeds, so many seeds are one flow.
    """
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    keys = [*by, "__locked", target]
    rows = df.withColumn("__locked", locked)
    open_rows = lambda x: x.where(~F.col("__locked"))
    path = new_path(df.sparkSession, "split-keys")
    narrow = rows.select(*keys, id_col)
    narrow.write.parquet(path)
    narrow = df.sparkSession.read.schema(narrow.schema).parquet(path)
    first = hash_cuts(open_rows(narrow), seed, id_col, keys, F.round(F.lit(train) * F.col("__size")))
    second_seed = seed + F.lit(SECOND_STAGE)
    rest = open_rows(first_by_hash(narrow, first, seed, id_col, keys, "__train")).where(~F.col("__train"))
    second = hash_cuts(rest, second_seed, id_col, keys, F.round(F.lit(validation / (1 - train)) * F.col("__size")))
    marked = first_by_hash(rows, first, seed, id_col, keys, "__train")
    marked = first_by_hash(marked, second, second_seed, id_col, keys, "__validation")
    role = (
        F.when(F.col("__locked"), "locked_temporal_test").when(F.col("__train"), "train")
        .when(F.col("__validation"), "validation").otherwise("test")
    )
    return marked.withColumn("role", role).select(*df.columns, "role")


def proportional_allocation(sizes: DataFrame, target: str, rows: int, size: str = "n_class") -> DataFrame:
    """Largest remainders, ties to the lower class; ``sizes`` has one row for each class."""
    everything = Window.partitionBy()
    exact = F.lit(rows) * F.col(size) / F.sum(size).over(everything)
    floored = sizes.withColumn("__floor", F.floor(exact).cast("long")).withColumn("__rest", F.round(exact - F.floor(exact), 9))
    left = F.lit(rows) - F.sum("__floor").over(everything)
    place = F.row_number().over(Window.orderBy(F.desc("__rest"), target))
    return floored.withColumn("quota", F.col("__floor") + (place <= left).cast("long")).select(target, size, "quota")


def quota_sample(df: DataFrame, quotas: DataFrame, seed: int, id_col: str, target: str) -> DataFrame:
    """The first ``quota`` rows of each class by hash; a class of fewer rows is taken whole."""
    cuts = hash_cuts(df, seed, id_col, [target], F.col("quota"), quotas.select(target, "quota"))
    return first_by_hash(df, cuts, seed, id_col, [target], "__chosen").where("__chosen").select(*df.columns)


def stratified_sample(df: DataFrame, rows: int, seed: int, id_col: str, target: str) -> DataFrame:
    """R03, R05."""
    return quota_sample(df, proportional_allocation(class_sizes(df, target), target, rows), seed, id_col, target)


def matched_sample(df: DataFrame, like: DataFrame, seed: int, id_col: str, target: str) -> DataFrame:
    """Rows of ``df`` with the class counts of ``like``."""
    return quota_sample(df, class_sizes(like, target, out="quota"), seed, id_col, target)


def without_period(df: DataFrame, role: str, period: str, value: int) -> DataFrame:
    """a period leaves the training rows only."""
    return df.where(~((F.col(role) == "train") & (F.col(period) == value)))
