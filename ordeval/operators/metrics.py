"""Confusion counts and everything computed from them (survey A17, A19-A28, A32, A34).

Rows are aggregated once to at most nine counts for each group; all metrics are arithmetic on those.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordeval.functions.columns import COSTS, direction
from ordeval.operators import ranks

CLASSES = (0, 1, 2)
CELLS = [(i, j) for i in CLASSES for j in CLASSES]
METRICS = (
    "macro_f1", "qwk", "ordinal_mae", "accuracy", "recall_0", "recall_1", "recall_2", "serious_or_worse_recall",
    "mean_asymmetric_cost",
)


def class_weights(df: DataFrame, target: str, *keys: str, classes: int = 3) -> DataFrame:
    """N / (K n_k) for each class of a group."""
    counts = df.groupBy(*keys, target).agg(F.count("*").alias("n_class"))
    n = F.sum("n_class").over(Window.partitionBy(*keys)) if keys else F.sum("n_class").over(Window.partitionBy())
    return counts.withColumn("weight", n / (F.lit(classes) * F.col("n_class")))


def confusion_counts(df: DataFrame, keys: Sequence[str], true: str = "true_code", predicted: str = "predicted_code") -> DataFrame:
    """One wide row of nine counts c00..c22 for each group."""
    cell = lambda i, j: F.count_if((F.col(true) == i) & (F.col(predicted) == j)).alias(f"c{i}{j}")
    return df.groupBy(*keys).agg(*[cell(i, j) for i, j in CELLS])


def confusion_long(wide: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Nine zero-filled rows for each group with the share within the true class."""
    cells = F.array(*[
        F.struct(
            F.lit(i).alias("true_code"), F.lit(j).alias("predicted_code"), F.col(f"c{i}{j}").alias("n"),
            ratio(F.col(f"c{i}{j}"), _row(i)).alias("row_share"),
        ) for i, j in CELLS
    ])
    return wide.select(*keys, F.explode(cells).alias("x")).select(*keys, "x.*")


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def _c(i: int, j: int) -> Column:
    return F.col(f"c{i}{j}").cast("double")


def _total(columns: Sequence[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out + c
    return out


def _row(i: int) -> Column:
    return _total([_c(i, j) for j in CLASSES])


def _column(j: int) -> Column:
    return _total([_c(i, j) for i in CLASSES])


def _n() -> Column:
    return _total([_c(i, j) for i, j in CELLS])


def metric_columns() -> dict[str, Column]:
    """The metrics of a wide row of counts; a division by zero gives 0."""
    n = _n()
    f1 = [ratio(2 * _c(i, i), _row(i) + _column(i)) for i in CLASSES]
    seen = _total([F.lit(float((i - j) ** 2)) * _c(i, j) for i, j in CELLS])
    expected = _total([F.lit(float((i - j) ** 2)) * _row(i) * _column(j) for i, j in CELLS])
    severe = _row(1) + _row(2)
    return {
        "macro_f1": _total(f1) / 3,
        "qwk": 1 - ratio(seen * n, expected),
        "ordinal_mae": ratio(_total([F.lit(float(abs(i - j))) * _c(i, j) for i, j in CELLS]), n),
        "accuracy": ratio(_total([_c(i, i) for i in CLASSES]), n),
        **{f"recall_{i}": ratio(_c(i, i), _row(i)) for i in CLASSES},
        **{f"precision_{j}": ratio(_c(j, j), _column(j)) for j in CLASSES},
        "serious_or_worse_recall": ratio(_total([_c(i, j) for i in (1, 2) for j in (1, 2)]), severe),
        "mean_asymmetric_cost": ratio(_total([F.lit(float(COSTS[i][j])) * _c(i, j) for i, j in CELLS]), n),
    }


def metrics(wide: DataFrame, keys: Sequence[str], names: Sequence[str] = METRICS, digits: int | None = None) -> DataFrame:
    """Wide metric row of each group."""
    all_of = metric_columns()
    shown = [(F.round(all_of[m], digits) + 0.0 if digits is not None else all_of[m]).alias(m) for m in names]
    return wide.select(*keys, _n().cast("long").alias("n"), *shown)


def long_metrics(wide_metrics: DataFrame, keys: Sequence[str], names: Sequence[str] = METRICS) -> DataFrame:
    """(keys, metric, value)."""
    return wide_metrics.unpivot(list(keys), list(names), "metric", "value")


def log_loss(df: DataFrame, keys: Sequence[str], probabilities: str, true: str, floor: float = 1e-15) -> DataFrame:
    """A22."""
    p = F.get(F.col(probabilities), F.col(true).cast("int"))
    return df.groupBy(*keys).agg(F.avg(-F.log(F.least(F.greatest(p, F.lit(floor)), F.lit(1.0)))).alias("log_loss"))


def standardised(wide: DataFrame, reference: DataFrame, on: Sequence[str] = ()) -> DataFrame:
    """Counts reweighted by true class to the class shares r0..r2 of ``reference``."""
    joined = wide.join(reference, list(on)) if on else wide.crossJoin(F.broadcast(reference))  # one row without keys
    n = _n()
    new = {f"c{i}{j}": _c(i, j) * ratio(F.col(f"r{i}") * n, _row(i)) for i, j in CELLS}
    return joined.select(*[new.get(c, F.col(c)).alias(c) for c in wide.columns])


def class_shares(wide: DataFrame, *keys: str) -> DataFrame:
    """Shares r0..r2 of the true classes."""
    return wide.select(*keys, *[ratio(_row(i), _n()).alias(f"r{i}") for i in CLASSES])


def error_structure(df: DataFrame, keys: Sequence[str], true: str, predicted: str, confidence: str) -> DataFrame:
    """Count, share and confidence quantiles of each wrong cell."""
    t, p = F.col(true), F.col(predicted)
    counts = ranks.value_counts(df.select(*keys, true, predicted, confidence), confidence, *keys, true, predicted)
    cells = counts.groupBy(*keys, true, predicted).agg(
        F.sum("n").alias("rows"),
        ranks.mean(confidence).alias("mean_confidence"),
        ranks.quantile(confidence, 0.5).alias("median_confidence"),
        ranks.quantile(confidence, 0.9).alias("p90_confidence"),
    ).withColumnRenamed("rows", "n")
    whole = F.sum("n").over(Window.partitionBy(*keys))
    return (
        cells.withColumn("share", F.col("n") / whole)
        .where(t != p)
        .withColumn("direction", direction(t, p))
        .withColumn("distance", F.abs(t - p))
    )


def seed_summary(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Mean, sample deviation, extremes and signs over seeds."""
    v = F.col(value)
    return df.groupBy(*keys).agg(
        F.count(v).alias("seeds"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.min(v).alias("low"),
        F.max(v).alias("high"), F.count_if(v > 0).alias("positive"), F.count_if(v < 0).alias("negative"),
    )


def intervals(draws: DataFrame, keys: Sequence[str], value: str = "value", level: float = 0.95) -> DataFrame:
    """Exact percentile interval over finite draws, and how many there are."""
    finite = F.when(~F.isnan(value) & ~F.abs(F.col(value)).isin(float("inf")), F.col(value))
    tail = (1 - level) / 2
    got = F.percentile(finite, F.array(F.lit(tail), F.lit(1 - tail)))
    return draws.groupBy(*keys).agg(F.count(finite).alias("draws"), got.alias("q")).select(
        *keys, "draws", F.get("q", F.lit(0)).alias("low"), F.get("q", F.lit(1)).alias("high")
    )


def zero_crossings(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, intervals, crossing_zero, above_zero, below_zero) of intervals (low, high)."""
    low, high = F.col("low"), F.col("high")
    return found.groupBy(*keys).agg(
        F.count("*").alias("intervals"), F.count_if((low <= 0) & (high >= 0)).alias("crossing_zero"), F.count_if(low > 0).alias("above_zero"), F.count_if(high < 0).alias("below_zero")
    )


def contrasts(values: DataFrame, weights: DataFrame, keys: Sequence[str], by: str = "model", value: str = "value") -> DataFrame:
    """Sums of weight * value for each named contrast; ``weights`` (contrast, by, weight) is a small table."""
    joined = values.join(weights, by)
    return joined.groupBy("contrast", *keys).agg(F.sum(F.col("weight") * F.col(value)).alias(value))


def gap_evidence(gaps: DataFrame, keys: Sequence[str], point: str = "point", low: str = "low", high: str = "high") -> DataFrame:
    """Optimism if all points and lower bounds of a group are positive, pessimism if all points and upper ones are negative."""
    up = F.bool_and((F.col(point) > 0) & (F.col(low) > 0))
    down = F.bool_and((F.col(point) < 0) & (F.col(high) < 0))
    label = F.when(up, "consistent_optimism").when(down, "consistent_pessimism").otherwise("mixed_or_uncertain")
    return gaps.groupBy(*keys).agg(label.alias("evidence"))


def gain_gate(deltas: DataFrame, keys: Sequence[str]) -> DataFrame:
    """P20: (keys, passes): macro-F1 gains 0.01 with a positive lower bound, and qwk, severest recall and cost aren't clearly worse."""
    of = lambda m, c: F.max(F.when(F.col("metric") == m, F.col(c)))
    gained = (of("macro_f1", "point") >= 0.01) & (of("macro_f1", "low") > 0)
    kept = (of("qwk", "high") >= 0) & (of("recall_2", "high") >= 0) & (of("mean_asymmetric_cost", "low") <= 0)
    return deltas.groupBy(*keys).agg((gained & kept).alias("passes"))
