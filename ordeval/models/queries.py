"""Queries that fit models: rows and invariants can be checked, values not by SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordeval.models import attribution, boosting, fit, ordinal, stability
from ordeval.models.features import NumericScaler, encoder
from ordeval.operators import metrics
from ordeval.plans import cohort as plan
from ordeval.sources.shared import new_path
from ordeval.streaming.events import drained_daily_counts

CATEGORICAL = ["priority_code", "status", "month_code"]
NUMERIC = ["speed_scaled", "speed_missing"]


def prepared(spark: SparkSession, sf_dir: str, one_hot: bool = True) -> tuple[DataFrame, DataFrame]:
    """Encoded training rows and all rows."""
    rows = plan.cohort(spark, sf_dir)
    train = rows.where("role = 'train'")
    scaler = NumericScaler.fit(train, ["speed"])
    encode = encoder(CATEGORICAL, NUMERIC, one_hot).fit(scaler.transform(train))
    out = encode.transform(scaler.transform(rows)).select("id", "role", "target", "features")
    path = new_path(spark, "encoded")  # fits read their rows many times: encode once
    out.write.parquet(path)
    encoded = spark.read.schema(out.schema).parquet(path)
    return encoded.where("role = 'train'"), encoded


def _evaluated(scored: DataFrame) -> DataFrame:
    named = scored.where("role <> 'train'").withColumn("true_code", F.col("target"))
    return metrics.metrics(metrics.confusion_counts(named, ["role"]), ["role"], digits=9)


def m06_dummy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = plan.cohort(spark, sf_dir)
    k = fit.dummy(rows.where("role = 'train'"))
    return _evaluated(rows.withColumn("predicted_code", F.lit(k)))


def m07_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, rows = prepared(spark, sf_dir)
    return _evaluated(fit.scored(fit.logistic(train), rows))


def m08_boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, rows = prepared(spark, sf_dir, one_hot=False)
    return _evaluated(fit.scored(fit.boosted(train), rows))


def m08_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of few trees, stopped and chosen by the validation rows; the winner's metrics on all other rows."""
    train, rows = prepared(spark, sf_dir, one_hot=False)
    candidates = {"shallow": {"depth": 2, "step": 0.3}, "deep": {"depth": 4, "step": 0.3}}
    best, models, _ = fit.boosted_search(train, rows.where("role = 'validation'"), candidates, 0.0, 0.0, cap=4, extended=6)
    return _evaluated(fit.staged(models, rows)).withColumn("candidate", F.lit(best))


def m09_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, rows = prepared(spark, sf_dir)
    slopes, thresholds = fit.ordered_logit(train)
    return _evaluated(fit.ordered_scored(slopes, thresholds, rows))


def m10_staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics with the first one, two and four trees of each class."""
    train, rows = prepared(spark, sf_dir, one_hot=False)
    models = fit.boosted_stopped(train, rows.where("role = 'validation'"), cap=4)
    parts = [_evaluated(fit.staged(models, rows, k)).withColumn("trees", F.lit(k)) for k in (1, 2, 4)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def m11_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, rows = prepared(spark, sf_dir, one_hot=False)
    model = fit.SealedModel(fit.forest(train)).seal()
    return model.score(rows.where("role = 'test'")).select("id", "target", "predicted_code", "prob")


#: Categories and the number of the boosted model, which takes them as they are.
NATIVE = ["priority_code", "status", "month_code", "segment"]
PARAMS = boosting.Params(depth=3, step=0.3)


def softmax_boosted(spark: SparkSession, sf_dir: str, cap: int = 8) -> tuple[boosting.Boosted, DataFrame]:
    """A model of ``cap`` rounds at most, stopped by the validation rows, and all rows of the cohort."""
    rows = plan.cohort(spark, sf_dir)
    model = boosting.fit(rows.where("role = 'train'"), rows.where("role = 'validation'"), NATIVE, ["speed"], PARAMS, cap=cap)
    return model, rows


def m08_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Softmax boosting of three classes with native categories and missing values: candidates of few rounds, the
    winner by validation; its metrics on all other rows."""
    rows = plan.cohort(spark, sf_dir)
    candidates = {"stumps": boosting.Params(depth=1, step=0.3), "trees": PARAMS}
    train, validation = rows.where("role = 'train'"), rows.where("role = 'validation'")
    best, model, _ = boosting.search(train, validation, candidates, NATIVE, ["speed"], 0.0, 0.0, cap=3, extended=5)
    return _evaluated(boosting.scored(model, rows)).withColumn("candidate", F.lit(best))


def m10_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of the first rounds of a softmax booster."""
    model, rows = softmax_boosted(spark, sf_dir, 4)
    parts = [_evaluated(boosting.scored(model, rows, k)).withColumn("rounds", F.lit(k)) for k in range(1, len(model.rounds) + 1)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def m12_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributions of raw margins add up to them on all test rows."""
    model, rows = softmax_boosted(spark, sf_dir)
    attributed = stability.margin_attributions(model, boosting.scored(model, rows.where("role = 'test'")))
    return stability.additivity(attributed, model.features).select("class", "n", (F.col("largest") <= 1e-6).alias("additive"))


def x06_sealed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test rows scored by the model that its seal names; rows by role and those that the model in memory scores otherwise."""
    model, rows = softmax_boosted(spark, sf_dir, 3)
    folder = new_path(spark, "sealed")
    boosting.seal_model(spark, model, folder)
    test = rows.where("role = 'test'")
    own = boosting.scored(model, test).select("id", F.col("margin").alias("own"))
    both = boosting.scored_after_seal(spark, folder, test).join(own, "id")
    return both.groupBy("role").agg(F.count("*").alias("n"), F.count_if(F.col("margin") != F.col("own")).alias("differing"))


def _attributed(spark: SparkSession, sf_dir: str) -> tuple[list[str], DataFrame]:
    """Attributions of the validation and test rows, written once."""
    model, rows = softmax_boosted(spark, sf_dir)
    scored = boosting.scored(model, rows.where("role IN ('validation', 'test')")).withColumnRenamed("role", "cohort")
    return model.features, stability.attributions_in_chunks(model, scored, new_path(spark, "attributions"), 2, carry=["cohort", "target"])


def a28_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance and direction of each feature by cohort and scope, from the attributions of M12."""
    features, attributed = _attributed(spark, sf_dir)
    return stability.importance(attributed, features, ["cohort"])


def m13_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation of importance between validation and test rows by scope, 2,000 draws."""
    features, attributed = _attributed(spark, sf_dir)
    draws = stability.importance_draws(attributed, features, 2000, 3301, "cohort")
    points = stability.importance(attributed, features, ["cohort"]).withColumnRenamed("mean_abs", "value")
    return stability.rank_stability(points, draws, "validation", "test")


def m03_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each column of the reference-level encoding; quarters are sums of months and so dependent."""
    return ordinal.dropped_table(spark, ordinal.reference_columns(_with_quarter(spark, sf_dir).where("role = 'train'"), [*CATEGORICAL, "quarter"], ["speed"]))


def _with_quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.cohort(spark, sf_dir).withColumn("quarter", F.concat(F.lit("Q"), F.ceil(F.col("month") / 3).cast("string")))


def m09_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proportional odds by maximum likelihood on the columns of M03; metrics by role."""
    rows = _with_quarter(spark, sf_dir)
    columns = ordinal.reference_columns(rows.where("role = 'train'"), [*CATEGORICAL, "quarter"], ["speed"])
    encoded = columns.encode(rows.select("id", "role", "target", *CATEGORICAL, "quarter", "speed")).select("id", "role", "target", "x")
    path = new_path(spark, "encoded")  # each step reads the rows: encode once
    encoded.write.parquet(path)
    encoded = spark.read.schema(encoded.schema).parquet(path)
    model = ordinal.fit_ordered(encoded.where("role = 'train'"))
    return _evaluated(fit.ordered_scored(model.slopes, model.thresholds, encoded, F.col("x"))).withColumn("at_maximum", F.lit(model.score < 1e-6))


def m12_attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, rows = prepared(spark, sf_dir, one_hot=False)
    model = fit.forest(train, trees=10, depth=4)
    path = new_path(spark, "forest")
    model.write().save(path)
    test = fit.scored(model, rows.where("role = 'test'"))
    return attribution.additivity(attribution.attributions(test, attribution.saved_leaves(spark, path), "id"), test, "id")


def s20_reloaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A saved model that is read again gives the same predictions: rows and different rows of each role."""
    train, rows = prepared(spark, sf_dir, one_hot=False)
    model = fit.forest(train, trees=10, depth=4)
    path = new_path(spark, "forest")
    model.write().save(path)
    again = fit.scored(type(model).load(path), rows).select("id", F.col("predicted_code").alias("code"), F.col("prob").alias("again"))
    both = fit.scored(model, rows).join(again, "id")
    differs = (F.col("predicted_code") != F.col("code")) | (F.col("prob") != F.col("again"))
    return both.groupBy("role").agg(F.count("*").alias("n"), F.count_if(differs).alias("differing"))


def x_stream_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drained_daily_counts(spark, f"{sf_dir}/events.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        m03_reference, m06_dummy, m07_logistic, m08_boosted, m08_search, m08_softmax, m09_likelihood, m09_ordered, m10_rounds, m10_staged, m11_scored,
        m12_attributions, m12_margins, a28_margins, m13_stability, s20_reloaded, x06_sealed_scores, x_stream_daily_counts,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    """Twins of what doesn't hang on a fit's values, after the cohort's common tables."""
    from ordeval.queries import _N, counts_sql, metrics_sql

    most = "(SELECT target FROM cohort WHERE role = 'train' GROUP BY target ORDER BY count(*) DESC, target LIMIT 1)"
    levels = " UNION ALL ".join(f"SELECT '{c}' AS c, {c} AS v FROM k" for c in (*CATEGORICAL, "quarter"))
    return {
        "m03_reference": f"""k AS (SELECT *, 'Q' || ceil(month / 3.0)::INT::VARCHAR AS quarter FROM cohort WHERE role = 'train'),
l AS (SELECT DISTINCT c, v FROM ({levels})), r AS (SELECT c, v, row_number() OVER (PARTITION BY c ORDER BY v) AS place FROM l)
SELECT c || '=' || v AS name, CASE WHEN place = 1 THEN 'reference' WHEN c = 'quarter' THEN 'dependent' ELSE 'kept' END AS fate FROM r
UNION ALL SELECT DISTINCT c || '=__UNSEEN__', 'unidentified' FROM l UNION ALL SELECT 'speed', 'kept'""",
        "m12_margins": """t AS (SELECT 1 FROM cohort WHERE role = 'test') SELECT k::INT AS class, (SELECT count(*) FROM t) AS n, true AS additive FROM range(3) r(k)""",
        "m06_dummy": f"""k AS (SELECT role, target AS true_code, {most} AS predicted_code FROM cohort WHERE role <> 'train'), w AS ({counts_sql('k', 'role')})
SELECT role, ({_N})::BIGINT AS n, {metrics_sql(metrics.METRICS)} FROM w""",
        "x06_sealed_scores": "t AS (SELECT role FROM cohort WHERE role = 'test') SELECT role, count(*) AS n, 0::BIGINT AS differing FROM t GROUP BY role",
        "s20_reloaded": "t AS (SELECT role FROM cohort) SELECT role, count(*) AS n, 0::BIGINT AS differing FROM t GROUP BY role",
    }
