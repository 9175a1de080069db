"""Train-only preprocessing (survey M01, M02, M04, M05, P01-P03, P15, M15)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ordeval.functions.columns import RESERVED, UNSEEN
from ordeval.operators import ranks


def vocabulary(train: DataFrame, column: str) -> DataFrame:
    """Sorted training levels of one column; nulls and reserved tokens are an error."""
    bad = F.col(column).isNull() | F.col(column).isin(*RESERVED)
    checked = F.when(bad, F.raise_error(F.lit(f"null or reserved level in {column}"))).otherwise(F.col(column))
    return train.select(checked.alias(column)).distinct()


def vocabularies(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(field, level, place) of several columns."""
    long = train.select(*columns).unpivot([], list(columns), "field", "level").distinct()
    return long.withColumn("place", F.row_number().over(Window.partitionBy("field").orderBy("level")) - 1)


def fold_to_vocabulary(df: DataFrame, column: str, levels: DataFrame) -> DataFrame:
    """Levels outside the vocabulary become ``__UNSEEN__``."""
    known = levels.select(F.col(column), F.lit(True).alias("__known"))
    return df.join(known, column, "left").withColumn(column, F.when(F.col("__known"), F.col(column)).otherwise(UNSEEN)).drop("__known")


def without_columns(columns: Sequence[str], dropped: Sequence[str]) -> list[str]:
    """The columns left, in order; a column to drop must be there."""
    missing = set(dropped) - set(columns)
    if missing:
        raise ValueError(f"not there: {sorted(missing)}")
    return [c for c in columns if c not in dropped]


@dataclass
class NumericScaler:
    """Exact training median for missing values, then population standardisation, with a missing mark."""

    columns: list[str]
    median: dict[str, float]
    mean: dict[str, float]
    sd: dict[str, float]

    @classmethod
    def fit(cls, train: DataFrame, columns: Sequence[str]) -> NumericScaler:
        columns = list(columns)
        long = train.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "field", "value")
        got = ranks.value_counts(long, "value", "field").groupBy("field").agg(ranks.quantile("value", 0.5).alias("median")).collect()
        found = {r["field"]: r["median"] for r in got}  # one row for each column
        median = {c: float(found.get(c) or 0.0) for c in columns}
        filled = [F.coalesce(F.col(c).cast("double"), F.lit(median[c])) for c in columns]
        stats = train.agg(*[f(x).alias(f"{n}{i}") for i, x in enumerate(filled) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        mean = {c: float(stats[f"m{i}"] or 0.0) for i, c in enumerate(columns)}
        return cls(columns, median, mean, {c: float(stats[f"s{i}"] or 0.0) or 1.0 for i, c in enumerate(columns)})

    def transform(self, df: DataFrame) -> DataFrame:
        new = {}
        for c in self.columns:
            value = F.coalesce(F.col(c).cast("double"), F.lit(self.median[c]))
            new[f"{c}_scaled"] = (value - self.mean[c]) / self.sd[c]
            new[f"{c}_missing"] = F.col(c).isNull().cast("int")
        return df.withColumns(new)


def encoder(categorical: Sequence[str], numeric: Sequence[str], one_hot: bool = True, out: str = "features") -> Pipeline:
    """Every training level and one more for unseen ones; levels by name."""
    index = StringIndexer(inputCols=list(categorical), outputCols=[f"{c}_index" for c in categorical], stringOrderType="alphabetAsc", handleInvalid="keep")
    stages = [index]
    used = [f"{c}_index" for c in categorical]
    if one_hot:
        stages.append(OneHotEncoder(inputCols=used, outputCols=[f"{c}_hot" for c in categorical], dropLast=False, handleInvalid="keep"))
        used = [f"{c}_hot" for c in categorical]
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=[*used, *numeric], outputCol=out, handleInvalid="error")])
