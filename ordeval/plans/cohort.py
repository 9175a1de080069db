"""The stand-in cohort on the star schema and two rule predictors: scan, decode, role, prediction in one lazy plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ordeval.functions.columns import hash32, month_code, recode, sentinel_to_null
from ordeval.operators.splits import temporal_role

TRAIN, VALIDATION, TEST = (1995, 1996, 1997, 1998, 1999), (2000,), (2001,)
#: Stand-in values of a numeric field by the rest of the customer key modulo 7; -1 is a sentinel.
SPEEDS = {0: 20, 1: 30, 2: 40, 3: 60, 4: -1, 5: 20, 6: 30}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each order: id, year, role, target, group, features."""
    orders = read(spark, sf_dir, "orders")
    customers = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    year, price = F.year("o_orderdate"), F.col("o_totalprice")
    return orders.join(customers, "o_custkey", "left").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("custkey"),
        year.alias("year"),
        F.month("o_orderdate").alias("month"),
        temporal_role(year, TRAIN, VALIDATION, TEST).alias("role"),
        F.when(price >= 490000, 2).when(price >= 390000, 1).otherwise(0).alias("target"),
        F.col("c_mktsegment").alias("segment"),
        F.substring("o_orderpriority", 1, 1).alias("priority_code"),
        F.trim(F.regexp_replace("o_orderpriority", r"^\d-?\s*", "")).alias("priority_label"),
        F.col("o_orderstatus").alias("status"),
        month_code(F.col("o_orderdate")).alias("month_code"),
        sentinel_to_null(recode(F.pmod("o_custkey", F.lit(7)).cast("int"), SPEEDS), [-1]).alias("speed"),
    )


def predictor_a() -> Column:
    return F.pmod(F.col("id") * 7 + F.col("custkey"), F.lit(3)).cast("int")


def predictor_b() -> Column:
    return F.when((F.col("month") <= 2) & (F.col("priority_code") <= "2"), 2).when(F.col("priority_code") == "3", 1).otherwise(0)


def probabilities() -> Column:
    """Three positive shares that sum to 1, from a hash of the id."""
    part = lambda k: (F.pmod(hash32(F.concat(F.lit(f"p{k}:"), F.col("id").cast("string"))), F.lit(97)) + 1).cast("double")
    parts = F.array(F.array(*[part(k) for k in range(3)]))  # as a variable of a lambda each part is computed once
    return F.get(F.transform(parts, lambda q: F.transform(q, lambda x: x / (F.get(q, F.lit(0)) + F.get(q, F.lit(1)) + F.get(q, F.lit(2))))), F.lit(0))


def predicted(df: DataFrame) -> DataFrame:
    """The cohort with predictions a, b and probabilities."""
    return df.withColumns({"pred_a": predictor_a(), "pred_b": predictor_b(), "prob": probabilities()})


def by_model(df: DataFrame) -> DataFrame:
    """(model, role, true_code, predicted_code, ...): each row once for each predictor."""
    both = F.explode(F.array(F.struct(F.lit("A").alias("model"), F.col("pred_a").alias("predicted_code")), F.struct(F.lit("B").alias("model"), F.col("pred_b").alias("predicted_code"))))
    return df.select("id", "year", "role", "segment", F.col("target").alias("true_code"), "prob", both.alias("m")).select("*", "m.*").drop("m")
