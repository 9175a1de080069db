"""Work that must not grow faster than the input: what one task gets, and how often a value is computed."""

import contextlib
import io

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F


def plan_of(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(True)
    return out.getvalue().split("== Physical Plan ==")[1]


def repeated(spark, copies):
    rows = spark.range(40 * copies).select("id", (F.col("id") % 3).cast("int").alias("target"), (F.col("id") % 5).cast("double").alias("a"), (F.col("id") % 2).cast("double").alias("b"))
    return VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(rows)


def test_weights_move_no_row(spark):
    from ordeval.models import fit

    got = fit.weighted(repeated(spark, 3).where("target <> 1 OR id < 30"))
    assert "Exchange" not in plan_of(got)
    sizes = {r["target"]: r["count"] for r in got.groupBy("target").count().collect()}
    assert all(abs(r["weight"] - sum(sizes.values()) / (3 * sizes[r["target"]])) < 1e-12 for r in got.collect())


def test_equal_rows_are_fitted_as_one(spark):
    from ordeval.models import fit

    some, many = (fit.counted(fit.weighted(repeated(spark, n)), "target") for n in (3, 60))
    assert some.count() == many.count() == 30
    assert abs(many.agg(F.sum("weight")).first()[0] - 40 * 60) < 1e-6
    assert many.schema["features"].metadata == repeated(spark, 1).schema["features"].metadata != {}


def test_boosting_holds_equal_rows_once(spark):
    from ordeval.models import boosting

    rows = repeated(spark, 60).withColumn("c", F.col("b").cast("string"))
    bins = boosting.fitted_bins(rows, ["c"], ["a"])
    held = boosting.written_rows(rows, rows.where("id < 90"), bins, [0.0] * 3, {0: 1.0, 1: 1.0, 2: 1.0}, "target")
    n = {r["training"]: (r["rows"], r["n"]) for r in held.groupBy("training").agg(F.count("*").alias("rows"), F.sum("n").alias("n")).collect()}
    assert n == {boosting.TRAIN: (30, 2400), boosting.VALIDATION: (30, 90)}


def test_parts_of_a_forest_hang_on_the_rows(spark, monkeypatch):
    from ordeval.models import fit

    monkeypatch.setattr(fit, "ROWS_A_TASK", 200)
    rows = repeated(spark, 50)
    parts = [[[r["id"] for r in p] for p in fit.dealt(rows.repartition(n), "id").select("id").rdd.glom().collect()] for n in (1, 7)]
    assert len(parts[0]) == 10 and parts[0] == parts[1] and max(map(len, parts[0])) < 300


def test_hashes_of_a_row_are_computed_once(spark):
    import __spark_entry__ as entry

    plan = plan_of(entry.queries()["f10_violations"](spark, "/root/testdata/sf0.001"))
    filters = [line for line in plan.splitlines() if "Filter " in line.split("DataFilters")[0] and "FileScan" not in line]
    assert sum(line.count("md5(") for line in filters) == 3


def test_draws_are_made_once(spark):
    from ordeval.operators import means

    rows = spark.range(60).select("id", F.lit("x").alias("g"), (F.col("id") % 2).alias("s"), F.col("id").cast("double").alias("v"))
    drawn = means.bootstrap_means(rows, ["g"], "s", ["v"], 20, 7)
    assert "CoGroup" not in plan_of(drawn) and drawn.count() == 20
