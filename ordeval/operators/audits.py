"""Audits of quality, coverage and drift (survey A01-A16, A18, A29, A30, A33, J08, J10, J13).

Fields are unpivoted to long rows and counted in one aggregation; distinct values are small dimension tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ordeval.operators.ranks import mean, quantile, value_counts


def long_fields(df: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """(keys, field, value as text)."""
    return df.select(*keys, *[F.col(c).cast("string").alias(c) for c in fields]).unpivot(list(keys), list(fields), "field", "value")


def counts(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of each key, null groups included."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def frequencies(df: DataFrame, value: str, *within: str) -> DataFrame:
    """Share of each value within its group."""
    whole = Window.partitionBy(*within)
    return counts(df, *within, value).withColumn("share", F.col("n") / F.sum("n").over(whole))


def count_pivot(df: DataFrame, category: str, period: str, periods: Sequence) -> DataFrame:
    """Counts of categories by period, zero-filled; the periods are given, so no extra job finds them."""
    return df.groupBy(category).agg(*[F.count_if(F.col(period) == p).alias(f"n_{p}") for p in periods])


def period_rollup(df: DataFrame, period: str, target: str, classes: Sequence[int] = (0, 1, 2)) -> DataFrame:
    """Class counts of each period and of all."""
    label = F.when(F.grouping(period) == 1, F.lit("ALL")).otherwise(F.col(period).cast("string"))
    return (
        df.rollup(period)
        .agg(label.alias("scope"), F.count("*").alias("n"), *[F.count_if(F.col(target) == k).alias(f"n_{k}") for k in classes])
        .drop(period)
    )


def role_summary(df: DataFrame, role: str, target: str, classes: Sequence[int] = (0, 1, 2)) -> DataFrame:
    """Rows, share of the pool, and class counts and shares of each role."""
    found = df.groupBy(role).agg(F.count("*").alias("n"), *[F.count_if(F.col(target) == k).alias(f"n_{k}") for k in classes])
    shares = [(F.col(f"n_{k}") / F.col("n")).alias(f"share_{k}") for k in classes]
    pool = (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share_of_pool")
    return found.select("*", pool, *shares)


def column_profile(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Rows, missing, distinct, constant, extremes (as text) of each field."""
    long = long_fields(df, [], fields)
    return long.groupBy("field").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("value").isNull()).alias("missing"),
        F.countDistinct("value").alias("distinct_values"),
        (F.countDistinct("value") == 1).alias("is_constant"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
    )


def quality_long(df: DataFrame, period: str, fields: Sequence[str], missing: Sequence[str] = ()) -> DataFrame:
    """Missing values (null or a token) and distinct values by field and period."""
    gone = F.col("value").isNull() | F.col("value").isin(*missing) if missing else F.col("value").isNull()
    found = long_fields(df, [period], fields).groupBy("field", period)
    return found.agg(
        F.count("*").alias("n"), F.count_if(gone).alias("missing"), F.countDistinct(F.when(~gone, F.col("value"))).alias("distinct_values")
    )


def category_flags(df: DataFrame, category: str, period: str, latest: int, rare: int = 100) -> DataFrame:
    """Rare, unseen before the latest period, absent in it, and what to do."""
    is_latest = F.col(period) == latest
    found = df.groupBy(category).agg(
        F.count("*").alias("n"), F.count_if(is_latest).alias("n_latest"), F.count_if(~is_latest).alias("n_before")
    )
    flagged = found.select(
        "*", (F.col("n") < rare).alias("is_rare"), (F.col("n_before") == 0).alias("unseen_before"), (F.col("n_latest") == 0).alias("absent_latest")
    )
    action = F.when(F.col("unseen_before"), "fold_to_unseen").when(F.col("is_rare"), "keep_and_report").otherwise("keep")
    return flagged.withColumn("action", action)


def code_audit(df: DataFrame, keys: Sequence[str], fields: Sequence[str], dictionary: DataFrame) -> DataFrame:
    """Every (keys, field, code) with its label, and whether the dictionary lists it."""
    found = counts(long_fields(df, keys, fields), *keys, "field", "value")
    listed = dictionary.select("field", F.col("code").alias("value"), "label")
    return found.join(listed, ["field", "value"], "left").withColumn("is_listed", F.col("label").isNotNull())


def schema_audit(audited: DataFrame) -> DataFrame:
    """By field, rows, blanks and unknown codes of a code audit."""
    unknown = ~F.col("is_listed") & F.col("value").isNotNull()
    return audited.groupBy("field").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(unknown, F.col("n")).otherwise(0)).alias("unknown"),
    )


def field_audit(df: DataFrame, period: str, fields: Sequence[str], dictionary: DataFrame, formats: dict[str, str]) -> DataFrame:
    """(period, field, position, present, n, non_missing, unknown, format_issue): whether a period has the field at all, codes
    that the dictionary of a field lacks, and values that don't match the field's format; counts of values come first."""
    found = counts(long_fields(df, [period], fields), period, "field", "value")
    listed = dictionary.select("field", F.col("code").alias("value"), F.lit(True).alias("__listed"))
    coded = dictionary.select("field").distinct().withColumn("__coded", F.lit(True))
    marked = found.join(listed, ["field", "value"], "left").join(coded, "field", "left")
    known = F.coalesce("__listed", F.lit(False)) | F.col("__coded").isNull()
    has = F.col("value").isNotNull()
    wrong = F.lit(False)
    for f, pattern in formats.items():
        wrong = wrong | ((F.col("field") == f) & ~F.col("value").rlike(pattern))
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    place = F.array_position(F.array(*[F.lit(f) for f in fields]), F.col("field")).cast("int")
    out = marked.groupBy(period, "field").agg(
        F.sum("n").alias("n"), total(has).alias("non_missing"), total(has & ~known).alias("unknown"), total(has & F.coalesce(wrong, F.lit(False))).alias("format_issue")
    )
    return out.select(period, "field", place.alias("position"), (F.col("non_missing") > 0).alias("present"), "n", "non_missing", "unknown", "format_issue")


def rule_audit(audited: DataFrame, rules: DataFrame) -> DataFrame:
    """(field, kind, n, blank, unknown, decision): totals of a :func:`field_audit` under the rule of their field; what is known
    only after the event goes, a field without a rule or with unknown codes is reviewed."""
    sums = audited.groupBy("field").agg(F.sum("n").alias("n"), F.sum(F.col("n") - F.col("non_missing")).alias("blank"), F.sum("unknown").alias("unknown"))
    decision = (
        F.when(F.col("kind").isNull(), "review_no_rule").when(F.col("kind") == "after_event", "exclude")
        .when(F.col("unknown") > 0, "review_codes").otherwise("keep")
    )
    return sums.join(rules.select("field", "kind"), "field", "left").select("field", "kind", "n", "blank", "unknown", decision.alias("decision"))


def numeric_domain(df: DataFrame, period: str, fields: Sequence[str]) -> DataFrame:
    """(field, period, n, missing, distinct_values, low, high, mean, median, negative, zero, fractional), the median exact."""
    long = df.select(period, *[F.col(f).cast("double").alias(f) for f in fields]).unpivot([period], list(fields), "field", "value")
    found = value_counts(long, "value", "field", period)
    has, x = F.col("value").isNotNull(), F.col("value")
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return found.groupBy("field", period).agg(
        F.sum("n").alias("n"), total(~has).alias("missing"), F.count("value").alias("distinct_values"), F.min("value").alias("low"), F.max("value").alias("high"),
        mean("value").alias("mean"), quantile("value", 0.5).alias("median"), total(has & (x < 0)).alias("negative"), total(has & (x == 0)).alias("zero"),
        total(has & (x != F.floor(x))).alias("fractional"),
    )


def observed_values(df: DataFrame, fields: Sequence[str], period: str) -> DataFrame:
    """Periods and sorted distinct values of each field, joined to text."""
    long = long_fields(df, [period], fields).where("value IS NOT NULL")
    return long.groupBy("field").agg(
        F.concat_ws(";", F.sort_array(F.collect_set(F.col(period).cast("string")))).alias("periods"),
        F.concat_ws("|", F.sort_array(F.collect_set("value"))).alias("observed"),
    )


def split_audit(df: DataFrame, role: str, id_col: str, period: str) -> DataFrame:
    """Rows, distinct ids and periods of each role."""
    return df.groupBy(role).agg(
        F.count("*").alias("n"),
        F.countDistinct(id_col).alias("ids"),
        F.concat_ws(";", F.sort_array(F.collect_set(F.col(period).cast("string")))).alias("periods"),
    )


def drift(df: DataFrame, category: str, period: str) -> DataFrame:
    """Total variation between the category shares of every two periods, with the category that moved most.

    Periods and categories are a small table by then; a category that a period lacks has share 0.
    """
    share = frequencies(df, category, period)
    values, periods = share.select(category).distinct(), share.select(period).distinct()
    full = periods.crossJoin(values).join(share, [period, category], "left").select(period, category, F.coalesce("share", F.lit(0.0)).alias("share"))
    a = full.select(F.col(period).alias("left_period"), category, F.col("share").alias("left_share"))
    b = full.select(F.col(period).alias("right_period"), category, F.col("share").alias("right_share"))
    moved = a.join(b, category).where("left_period < right_period").withColumn("moved", F.abs(F.col("left_share") - F.col("right_share")))
    return moved.groupBy("left_period", "right_period").agg(
        (0.5 * F.sum("moved")).alias("total_variation"),
        F.max_by(category, F.struct(F.round("moved", 12), F.col(category))).alias("most_moved"),
    )


def coverage(df: DataFrame, train: DataFrame, field: str, by: str) -> DataFrame:
    """Rows and values of each group that training rows lack."""
    seen = train.select(field).distinct().withColumn("__seen", F.lit(True))
    marked = df.join(seen, field, "left").withColumn("__new", F.col("__seen").isNull() & F.col(field).isNotNull())
    return marked.groupBy(by).agg(
        F.count("*").alias("n"),
        F.count_if("__new").alias("unseen_rows"),
        F.countDistinct(F.when(F.col("__new"), F.col(field))).alias("unseen_values"),
        (F.count_if("__new") / F.count("*")).alias("unseen_share"),
    )


def described_fields(fields: DataFrame, documented: DataFrame) -> DataFrame:
    """Fields of a table with their documentation, where there is any."""
    return fields.join(documented, "field", "left")
