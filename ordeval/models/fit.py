"""Models on Spark's ML library (survey M06-M11, M14-M16): dummy, weighted and ordered logistic, forest, one-vs-rest boosting."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordeval.operators import metrics, windows
from ordeval.sources.shared import new_path

CLASSES = 3
Fit = Callable[[DataFrame], Callable[[DataFrame], DataFrame]]


#: Rows of a task that grows trees on rows that aren't counted together, about: Spark ML keeps a few hundred bytes of each.
ROWS_A_TASK = 100_000


def weighted(train: DataFrame, target: str = "target", out: str = "weight") -> DataFrame:
    """A17 as a column of the training rows, from the number of rows of each class: no row is moved."""
    train = train.where(F.col(target).isNotNull())
    sizes = {r[0]: r[1] for r in train.groupBy(target).agg(F.count("*")).collect()}  # a row for each class
    if not sizes:
        return train.withColumn(out, F.lit(1.0))
    n = sum(sizes.values())
    of_class = F.create_map(*[F.lit(x) for k, size in sizes.items() for x in (k, n / (CLASSES * size))])
    return train.withColumn(out, F.element_at(of_class, F.col(target)))


def counted(rows: DataFrame, *keys: str, features: str = "features", weight: str = "weight") -> DataFrame:
    """Equal rows (features, keys) as one row of their summed weight: to trees without resampling the same as each row on its
    own. Their number is that of different rows, however many there are of each; written once, as fits read them often."""
    keys, about = [*keys, "__one"], rows.schema[features].metadata  # which features are categories
    rows = rows.withColumn("__one", F.col(weight)).select(vector_to_array(features).alias(features), *keys)
    # equal keys have equal weights, so a sum is a product, which hangs on no order
    out = rows.groupBy(features, *keys).agg(F.count("*").alias("__n"))
    out = out.select(array_to_vector(features).alias(features, metadata=about), *keys[:-1], (F.col("__n") * F.col("__one")).alias(weight))
    path = new_path(rows.sparkSession, "counted")
    out.write.parquet(path)
    return dealt(rows.sparkSession.read.schema(out.schema).parquet(path))


def dealt(rows: DataFrame, *by: str) -> DataFrame:
    """Rows in parts of about ROWS_A_TASK: files of repeated values are small, what a task makes of them isn't. With ids in
    ``by``, parts and their order hang on the rows alone, and so does what a fit draws in each part."""
    parts = max(1, -(-rows.count() // ROWS_A_TASK))
    return rows.repartition(parts, *by).sortWithinPartitions(*by) if by else rows.repartition(parts)


def logistic(train: DataFrame, target: str = "target", c: float = 1.0, balanced: bool = True):  # noqa: ANN201
    """Multinomial logistic with an L2 penalty; regParam = 1 / (C sum of weights), no standardisation."""
    train = train.where(F.col(target).isNotNull())
    sizes = {r[0]: r[1] for r in train.groupBy(target).agg(F.count("*")).collect()}  # a row for each class, one scan for all
    n = sum(sizes.values())
    weights = {k: n / (CLASSES * size) if balanced else 1.0 for k, size in sizes.items()}
    of_class = F.create_map(*[F.lit(x) for k, w in weights.items() for x in (k, float(w))])
    rows, total = train.withColumn("weight", F.element_at(of_class, F.col(target))), sum(weights[k] * size for k, size in sizes.items())
    return LogisticRegression(
        labelCol=target, weightCol="weight", family="multinomial", elasticNetParam=0.0, regParam=1.0 / (c * total),
        standardization=False, maxIter=500, tol=1e-4,
    ).fit(rows)


def forest(train: DataFrame, target: str = "target", trees: int = 20, depth: int = 5, seed: int = 1103, id_col: str = "id"):  # noqa: ANN201
    """M08 with probabilities for three classes: a weighted random forest."""
    one = RandomForestClassifier(labelCol=target, weightCol="weight", numTrees=trees, maxDepth=depth, maxBins=64, seed=seed)
    ids = [id_col] if id_col in train.columns else []
    return one.fit(dealt(weighted(train, target).select("features", target, "weight", *ids), *ids))


def boosted(train: DataFrame, target: str = "target", trees: int = 10, depth: int = 3, seed: int = 1103):  # noqa: ANN201
    """One-vs-rest boosted trees (the library's boosting has two classes); scores are made probabilities by a softmax."""
    one = GBTClassifier(maxIter=trees, maxDepth=depth, maxBins=64, seed=seed)
    return OneVsRest(classifier=one, labelCol=target, weightCol="weight").fit(counted(weighted(train, target), target))


def boosted_stopped(
    train: DataFrame, validation: DataFrame, target: str = "target", cap: int = 1200, depth: int = 3, step: float = 0.1, tol: float = 0.001, seed: int = 1103
) -> list:
    """A boosted model of each class against the rest, each stopped by the validation rows' error (Spark ML's rule: an
    iteration that improves it by less than ``tol``), or at ``cap`` trees."""
    marked = weighted(train, target).withColumn("__validating", F.lit(False))
    rows = marked.unionByName(validation.select(*train.columns).withColumns({"weight": F.lit(1.0), "__validating": F.lit(True)}))
    rows = counted(rows, target, "__validating")
    one = GBTClassifier(
        labelCol="__is", weightCol="weight", validationIndicatorCol="__validating", validationTol=tol, maxIter=cap, maxDepth=depth,
        stepSize=step, maxBins=64, seed=seed,
    )
    return [one.fit(rows.withColumn("__is", (F.col(target) == k).cast("double"))) for k in range(CLASSES)]


def staged(models: list, rows: DataFrame, trees: int | None = None) -> DataFrame:
    """Rows scored with the first ``trees`` trees of each class's model (all of them by default)."""
    names = [f"__margin{k}" for k in range(len(models))]
    out = rows
    for name, model in zip(names, models, strict=True):
        out = out.withColumn(name, F.lit(0.0))
        for tree, weight in list(zip(model.trees, model.treeWeights, strict=True))[:trees]:
            out = tree.setPredictionCol("__tree").transform(out).withColumn(name, F.col(name) + F.lit(weight) * F.col("__tree")).drop("__tree")
    top = F.greatest(*names)
    parts = [F.exp(F.col(n) - top) for n in names]
    total = sum(parts[1:], parts[0])
    best = F.array_position(F.array(*names), top) - 1  # ties to the lower class
    return out.withColumns({"prob": F.array(*[p / total for p in parts]), "predicted_code": best.cast("int")}).drop(*names)


def boosted_search(
    train: DataFrame, validation: DataFrame, candidates: dict[str, dict], base_qwk: float, base_recall: float, target: str = "target",
    cap: int = 1200, extended: int = 2000,
) -> tuple[str, list, DataFrame]:
    """(winner, its models, one row of validation metrics for each candidate).

    A candidate is a set of parameters of ``boosted_stopped``. A winner that used all ``cap`` trees is fitted once more with
    ``extended``, takes its former self's place, and the winner is chosen again.
    """

    def fitted(name: str, most: int) -> tuple[list, DataFrame]:
        models = boosted_stopped(train, validation, target, cap=most, **candidates[name])
        scores = staged(models, validation).select(F.lit(name).alias("candidate"), F.col(target).alias("true_code"), "predicted_code")
        row = metrics.metrics(metrics.confusion_counts(scores, ["candidate"]), ["candidate"]).first()  # one row
        table = train.sparkSession.createDataFrame([row]).withColumn("complexity", F.lit(sum(len(m.trees) for m in models)))
        return models, table

    def winner() -> tuple[str, DataFrame]:
        tables = [t for _, t in found.values()]
        whole = tables[0]
        for t in tables[1:]:
            whole = whole.unionByName(t)
        return windows.select_candidate(whole, base_qwk, base_recall).first()["candidate"], whole

    found = {name: fitted(name, cap) for name in candidates}
    best, table = winner()
    if max(len(m.trees) for m in found[best][0]) == cap < extended:
        found[best] = fitted(best, extended)
        best, table = winner()
    return best, found[best][0], table


def scored(model, rows: DataFrame) -> DataFrame:  # noqa: ANN001
    """Rows with ``predicted_code`` and ``prob``; the model isn't refitted."""
    out = model.transform(rows)
    if "probability" in out.columns:
        prob = vector_to_array("probability")
    else:
        raw = vector_to_array("rawPrediction")
        shifted = F.transform(raw, lambda x: F.exp(x - F.array_max(raw)))
        prob = F.transform(shifted, lambda x: x / F.aggregate(shifted, F.lit(0.0), lambda a, y: a + y))
    return out.withColumns({"predicted_code": F.col("prediction").cast("int"), "prob": prob})


def ordered_logit(train: DataFrame, target: str = "target", ridge: float = 1e-6):  # noqa: ANN201
    """Proportional odds, P(y <= k) = F(threshold_k - x b): one logistic fit on rows stacked for each threshold,
    with slopes shared by all of them. Returns (slopes, thresholds). The small ridge takes the place of reference
    levels: a full set of levels stays identified."""
    cut = F.explode(F.array(*[F.lit(k) for k in range(CLASSES - 1)]))
    mark = F.array(*[F.when(F.col("__cut") == k, 1.0).otherwise(0.0) for k in range(1, CLASSES - 1)])
    rows = train.withColumn("__cut", cut).select(
        (F.col(target) <= F.col("__cut")).cast("double").alias("__below"), "features", array_to_vector(mark).alias("__mark")
    )
    rows = VectorAssembler(inputCols=["features", "__mark"], outputCol="__stacked").transform(rows)
    model = LogisticRegression(
        featuresCol="__stacked", labelCol="__below", family="binomial", elasticNetParam=0.0, regParam=ridge, standardization=False, maxIter=500, tol=1e-6
    ).fit(rows)
    found = model.coefficients.toArray()
    width = len(found) - (CLASSES - 2)
    return [-float(b) for b in found[:width]], [model.intercept, *[model.intercept + float(b) for b in found[width:]]]


def ordered_probabilities(margin: Column, thresholds: list[float]) -> Column:
    """Class probabilities as differences of the cumulative ones, each at least 0."""
    below = [F.lit(0.0), *[1.0 / (1.0 + F.exp(margin - t)) for t in thresholds], F.lit(1.0)]
    return F.array(*[F.greatest(b - a, F.lit(0.0)) for a, b in zip(below, below[1:])])


def ordered_scored(slopes: list[float], thresholds: list[float], rows: DataFrame, x: Column | None = None) -> DataFrame:
    """Rows with ``prob`` and ``predicted_code`` (ties to the lower class); ``x`` is an array, by default of ``features``."""
    weights = F.array(*[F.lit(b) for b in slopes])
    products = F.zip_with(vector_to_array("features") if x is None else x, weights, lambda x, b: x * b)
    out = rows.withColumn("prob", ordered_probabilities(F.aggregate(products, F.lit(0.0), lambda a, y: a + y), thresholds))
    return out.withColumn("predicted_code", (F.array_position("prob", F.array_max("prob")) - 1).cast("int"))


def dummy(train: DataFrame, target: str = "target") -> int:
    """The most frequent class, ties to the least."""
    n = train.groupBy(target).agg(F.count("*").alias("n"))
    return int(n.orderBy(F.desc("n"), target).first()[target])


class SealedModel:
    """A fitted model whose test rows can be scored only after it is sealed."""

    def __init__(self, model) -> None:  # noqa: ANN001
        self._model, self._sealed = model, False

    def seal(self) -> SealedModel:
        self._sealed = True
        return self

    def score(self, rows: DataFrame, role: str = "test") -> DataFrame:
        if role in ("test", "locked_temporal_test") and not self._sealed:
            raise PermissionError("seal the model before scoring test rows")
        return scored(self._model, rows)
