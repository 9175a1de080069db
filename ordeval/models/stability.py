"""Stability of attribution ranks between two cohorts (survey M12, A28, R11, M13): raw-margin attributions of a boosted
model, their importance by scope, bootstrap draws of the importance vectors, and rank correlations of each draw.

Scopes are the classes, and ``overall``: the mean over classes of a feature's mean absolute attribution.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordeval.models import boosting
from ordeval.models.attribution import attribute
from ordeval.operators import means, metrics, ranks, windows
from ordeval.plans.ledger import table_digest
from ordeval.sources.documents import read_document, write_document

OVERALL = "overall"
#: Different rows that a task walks the leaves with at a time.
CHUNK = 1000


def margin_attributions(model: boosting.Boosted, rows: DataFrame, id_col: str = "id", carry: Sequence[str] = ()) -> DataFrame:
    """(id, carried columns, phi, base, margin): path-dependent attributions of the raw margins, for all classes of the
    first feature, then of the next; ``rows`` are :func:`boosting.scored`."""
    shared = rows.sparkSession.sparkContext.broadcast((model, boosting.leaves(model)))  # sized by rounds and depth
    kept = [id_col, *carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, leaves = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            bins = batch.column(len(kept)).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            different, of_row = np.unique(bins, axis=0, return_inverse=True)  # equal bins have equal attributions
            found, base = [], np.zeros(len(own.start))
            for at in range(0, len(different), CHUNK):
                some = different[at : at + CHUNK]
                phi, base = attribute(some.astype(float), leaves) if leaves else (np.zeros((*some.shape, len(own.start))), base)
                found.append(phi.reshape(len(some), -1))
            found, of_row = np.concatenate(found), of_row.reshape(-1)
            for at in range(0, batch.num_rows, CHUNK):
                b = batch.slice(at, CHUNK)
                phi = found[of_row[at : at + CHUNK]]
                flat = pa.array(phi.tolist(), pa.list_(pa.float64()))
                bases = pa.array(np.tile(base + own.start, (len(phi), 1)).tolist(), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], flat, bases, b.column(len(kept) + 1)], names=[*kept, "phi", "base", "margin"])

    types = dict(rows.dtypes)
    schema = ", ".join([f"`{c}` {types[c]}" for c in kept] + ["phi array<double>", "base array<double>", "margin array<double>"])
    return rows.select(*kept, "bins", "margin").mapInArrow(run, schema)


def attributions_in_chunks(
    model: boosting.Boosted, rows: DataFrame, folder: str, chunks: int, id_col: str = "id", carry: Sequence[str] = ()
) -> DataFrame:
    """:func:`margin_attributions` in ``chunks`` by a hash of the id, each written and sealed under the digests of the
    model and of the rows. A run that breaks goes on with the first chunk that has no seal; another model or other rows have
    a folder of their own."""
    spark = rows.sparkSession
    holds = table_digest(rows.select(id_col, *carry, "bins"))
    place = f"{folder.rstrip('/')}/{hashlib.sha256(f'{model.digest()}|{holds}|{chunks}'.encode()).hexdigest()[:32]}"
    tables = []
    for i in range(chunks):
        seal = read_document(spark, f"{place}/chunk-{i}.json")
        if seal is None:
            name = f"chunk-{i}-{uuid.uuid4().hex[:8]}"
            own = rows.where(F.pmod(F.xxhash64(id_col), F.lit(chunks)) == i)
            margin_attributions(model, own, id_col, carry).write.parquet(f"{place}/{name}")
            seal = json.dumps({"table": name})
            write_document(spark, f"{place}/chunk-{i}.json", seal)
        tables.append(f"{place}/{json.loads(seal)['table']}")
    return spark.read.schema(margin_attributions(model, rows, id_col, carry).schema).parquet(*tables)


def additivity(attributed: DataFrame, features: Sequence[str], classes: int = boosting.CLASSES) -> DataFrame:
    """(class, n, largest): the largest difference between base + attributions and the margin, over all rows."""
    k = F.explode(F.array(*[F.lit(i) for i in range(classes)])).alias("class")
    of_class = F.filter("phi", lambda x, i: i % classes == F.col("class"))
    total = F.aggregate(of_class, F.lit(0.0), lambda a, x: a + x) + F.get("base", F.col("class"))
    gap = F.abs(total - F.get("margin", F.col("class")))
    return attributed.select("phi", "base", "margin", k).groupBy("class").agg(F.count("*").alias("n"), F.max(gap).alias("largest"))


def long_attributions(attributed: DataFrame, features: Sequence[str], keys: Sequence[str] = (), classes: int = boosting.CLASSES) -> DataFrame:
    """(keys, class, feature, value): one row for each row, class and feature."""
    name = F.get(F.array(*[F.lit(f) for f in features]), F.floor(F.col("at") / classes).cast("int"))
    rows = attributed.select(*keys, F.posexplode("phi").alias("at", "value"))
    return rows.select(*keys, (F.col("at") % classes).alias("class"), name.alias("feature"), "value")


def importance(attributed: DataFrame, features: Sequence[str], keys: Sequence[str] = (), classes: int = boosting.CLASSES) -> DataFrame:
    """(keys, scope, feature, mean_abs, mean_signed, median, positive, negative, zero, rank), exact quantiles; the
    overall scope has importance and rank alone."""
    counts = ranks.value_counts(long_attributions(attributed, features, keys, classes), "value", *keys, "class", "feature")
    share = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)) / F.first("total")
    by_class = counts.groupBy(*keys, "class", "feature").agg(
        (F.sum(F.abs("value") * F.col("n")) / F.first("total")).alias("mean_abs"), ranks.mean("value").alias("mean_signed"),
        ranks.quantile("value", 0.5).alias("median"), share(F.col("value") > 0).alias("positive"), share(F.col("value") < 0).alias("negative"),
        share(F.col("value") == 0).alias("zero"),
    ).select(*keys, F.col("class").cast("string").alias("scope"), "feature", "mean_abs", "mean_signed", "median", "positive", "negative", "zero")
    overall = by_class.groupBy(*keys, "feature").agg(F.avg("mean_abs").alias("mean_abs")).withColumn("scope", F.lit(OVERALL))
    return windows.average_rank(by_class.unionByName(overall, allowMissingColumns=True), "mean_abs", *keys, "scope")


def importance_draws(
    attributed: DataFrame, features: Sequence[str], iterations: int, seed: int, cohort: str, id_col: str = "id", target: str = "target",
    classes: int = boosting.CLASSES, leaf: int = means.LEAF,
) -> DataFrame:
    """(cohort, iteration, scope, feature, value): importance vectors of draws from each cohort, by true class."""
    names = [f"v{i}" for i in range(len(features) * classes)]
    wide = attributed.select(cohort, id_col, target, *[F.abs(F.get("phi", F.lit(i))).alias(n) for i, n in enumerate(names)])
    drawn = means.bootstrap_means(wide, [cohort], target, names, iterations, seed, id_col, leaf)
    return scoped(drawn, features, [cohort, "iteration"], classes)


def scoped(wide: DataFrame, features: Sequence[str], keys: Sequence[str], classes: int = boosting.CLASSES) -> DataFrame:
    """(keys, scope, feature, value) from one column for each feature and class."""
    cells = []
    for i, f in enumerate(features):
        own = [F.col(f"v{i * classes + k}") for k in range(classes)]
        cells += [F.struct(F.lit(str(k)).alias("scope"), F.lit(f).alias("feature"), c.alias("value")) for k, c in enumerate(own)]
        cells.append(F.struct(F.lit(OVERALL).alias("scope"), F.lit(f).alias("feature"), (sum(own[1:], own[0]) / classes).alias("value")))
    return wide.select(*keys, F.explode(F.array(*cells)).alias("c")).select(*keys, "c.*")


def rank_stability(points: DataFrame, draws: DataFrame, internal: str, future: str, cohort: str = "cohort") -> DataFrame:
    """(scope, rho, draws, low, high): Spearman's correlation of two cohorts' importance, with the interval of the
    draws'. ``points`` has (cohort, scope, feature, value), ``draws`` an iteration besides; the cohorts' draws are
    independent. A constant ranking has no correlation and is no draw."""

    def correlated(df: DataFrame, *keys: str) -> DataFrame:
        side = lambda c, name: df.where(F.col(cohort) == c).select(*keys, "feature", F.col("value").alias(name))
        return windows.rank_correlation(side(internal, "a").join(side(future, "b"), [*keys, "feature"]), "a", "b", *keys)

    drawn = metrics.intervals(correlated(draws, "iteration", "scope"), ["scope"], "rho")
    return correlated(points, "scope").join(drawn, "scope")
