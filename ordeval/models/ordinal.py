"""Proportional odds by maximum likelihood, on reference-level columns of full rank (survey M03, M09).

Columns: every training level of a category but the first, and scaled numbers. The cross-products of the columns and a
constant come from one aggregation, whatever the number of rows; elimination in order of the columns on that small matrix
finds the ones that those before them (or the constant, which the thresholds stand for) make up, and drops them.

Fit: P(y <= k) = F(threshold_k - x b). Log-likelihood, gradient and Hessian are sums over rows: tasks add up their rows'
and Spark adds up the tasks', so a Newton step is one scan and the driver holds a matrix of the columns. Thresholds after
the first are steps by exponentials, so they stay in order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ordeval.functions.columns import UNSEEN
from ordeval.models.features import NumericScaler, vocabularies

#: A column whose part that earlier columns don't explain is below this share of it is dependent.
TOLERANCE = 1e-9


@dataclass
class ReferenceColumns:
    """The encoding that training rows fix: (name, feature, level) of the columns kept; the others by reason."""

    kept: list[tuple[str, str, str | None]]
    references: dict[str, str]
    unidentified: list[str]
    dependent: list[str]
    scaler: NumericScaler

    def encode(self, df: DataFrame, out: str = "x") -> DataFrame:
        """``df`` with the columns as an array of doubles; levels that training hasn't seen are all zeros, as the reference."""
        scaled = self.scaler.transform(df)
        return scaled.withColumn(out, F.array(*[_value(f, level) for _, f, level in self.kept])).select(*df.columns, out)


def _value(feature: str, level: str | None) -> Column:
    if level is None:
        return F.col(f"{feature}_scaled").cast("double")
    return F.coalesce((F.col(feature).cast("string") == level).cast("double"), F.lit(0.0))


def summed(rows: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], np.ndarray]) -> np.ndarray:
    """The elementwise sum over tasks of what ``fn`` makes of each one's batches: a vector of one length."""
    schema = pa.schema([("place", pa.int32()), ("value", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = fn(batches)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v)], schema=schema)

    got = rows.mapInArrow(run, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(max((r["place"] for r in got), default=-1) + 1)
    for r in got:
        out[r["place"]] = r["value"]
    return out


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1).astype(float)


def cross_products(rows: DataFrame, x: str, width: int) -> np.ndarray:
    """Z'Z of the rows' columns after a constant: (width + 1) squared."""

    def products(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros((width + 1, width + 1))
        for b in batches:
            z = np.hstack([np.ones((b.num_rows, 1)), _matrix(b.column(0), b.num_rows)]) if b.num_rows else np.zeros((0, width + 1))
            total += z.T @ z
        return total.ravel()

    return summed(rows.select(x), products).reshape(width + 1, width + 1)


def dependent_columns(products: np.ndarray, tolerance: float = TOLERANCE) -> tuple[list[int], list[int]]:
    """(unidentified, dependent) columns of cross-products whose first column is the constant, numbered without it: those
    that are zero in all rows, and those that the constant and the columns before them make up."""
    size = np.sqrt(np.diag(products))
    scaled = products / np.outer(np.where(size > 0, size, 1.0), np.where(size > 0, size, 1.0))
    empty = [i - 1 for i in range(1, len(size)) if size[i] == 0]
    found = []
    for i in range(len(size)):
        if size[i] == 0 or scaled[i, i] <= tolerance:
            if size[i]:
                found.append(i - 1)
            continue
        row = scaled[i].copy()
        scaled -= np.outer(row, row) / row[i]  # what column i explains of all others
    return empty, found


def reference_columns(train: DataFrame, categorical: Sequence[str], numeric: Sequence[str]) -> ReferenceColumns:
    """Fitted on training rows: the first level of each category is the reference, dropped columns are listed."""
    levels: dict[str, list[str]] = {c: [] for c in categorical}
    if categorical:
        for r in vocabularies(train, categorical).orderBy("field", "place").collect():  # a row for each level
            levels[r["field"]].append(r["level"])
    scaler = NumericScaler.fit(train, numeric)
    names = [(f"{c}={v}", c, v) for c in categorical for v in [*levels[c][1:], UNSEEN]] + [(c, c, None) for c in numeric]
    whole = ReferenceColumns(names, {c: v[0] for c, v in levels.items() if v}, [], [], scaler)
    empty, tied = dependent_columns(cross_products(whole.encode(train, "__x"), "__x", len(names)))
    kept = [n for i, n in enumerate(names) if i not in empty and i not in tied]
    return ReferenceColumns(kept, whole.references, [names[i][0] for i in empty], [names[i][0] for i in tied], scaler)


@dataclass
class OrderedLogit:
    """Slopes and thresholds with the log-likelihood, the largest part of the score, and the steps it took."""

    slopes: list[float]
    thresholds: list[float]
    log_likelihood: float
    score: float
    steps: int


def _thresholds(a: np.ndarray) -> np.ndarray:
    return np.cumsum(np.concatenate([a[:1], np.exp(a[1:])]))


def row_terms(x: np.ndarray, y: np.ndarray, w: np.ndarray, thresholds: np.ndarray, slopes: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood, gradient and Hessian by (thresholds, slopes) of some rows."""
    cuts = len(thresholds)
    margin = x @ slopes
    edges = np.concatenate([[-np.inf], thresholds, [np.inf]])
    upper, lower = edges[y + 1] - margin, edges[y] - margin
    f = lambda u: np.where(u >= 0, 1 / (1 + np.exp(-np.abs(u))), np.exp(-np.abs(u)) / (1 + np.exp(-np.abs(u))))
    fu, fl = f(upper), f(lower)
    # F(u) - F(l) without cancellation: on the upper side through the tails
    p = np.where(lower > 0, f(-lower) - f(-upper), fu - fl)
    p = np.maximum(p, 1e-300)
    du, dl = fu * f(-upper), fl * f(-lower)
    d2u, d2l = du * (f(-upper) - fu), dl * (f(-lower) - fl)
    zu, zl = (y[:, None] == np.arange(cuts)).astype(float), (y[:, None] - 1 == np.arange(cuts)).astype(float)
    z = lambda t: np.hstack([t, -x])
    gu, gl = z(zu), z(zl)
    first = (w * du / p)[:, None] * gu - (w * dl / p)[:, None] * gl
    hessian = gu.T @ ((w * d2u / p)[:, None] * gu) - gl.T @ ((w * d2l / p)[:, None] * gl)
    one = first / np.sqrt(np.maximum(w, 1e-300))[:, None]
    hessian -= one.T @ one
    return float((w * np.log(p)).sum()), first.sum(axis=0), hessian


def likelihood(rows: DataFrame, thresholds: np.ndarray, slopes: np.ndarray, x: str = "x", target: str = "target", weight: str | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood, gradient and Hessian over all rows in one scan."""
    size = len(thresholds) + len(slopes)

    def terms(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(1 + size + size * size)
        for b in batches:
            if b.num_rows:
                y, w = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64), b.column(2).to_numpy(zero_copy_only=False)
                value, first, second = row_terms(_matrix(b.column(0), b.num_rows), y, w, thresholds, slopes)
                total += np.concatenate([[value], first, second.ravel()])
        return total

    given = rows.select(x, F.col(target).cast("int").alias("y"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"))
    got = summed(given, terms)
    return float(got[0]), got[1 : 1 + size], got[1 + size :].reshape(size, size)


def _by_steps(a: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian by (first threshold, logs of the steps, slopes)."""
    cuts = len(a)
    jacobian = np.eye(len(first))
    steps = np.exp(a[1:])
    for j in range(1, cuts):
        jacobian[:cuts, j] = np.where(np.arange(cuts) >= j, steps[j - 1], 0.0)
    jacobian[:cuts, 0] = 1.0
    out = jacobian.T @ second @ jacobian
    for j in range(1, cuts):
        out[j, j] += first[j:cuts].sum() * steps[j - 1]
    return jacobian.T @ first, out


def fit_ordered(rows: DataFrame, x: str = "x", target: str = "target", classes: int = 3, weight: str | None = None, tolerance: float = 1e-8, most: int = 100) -> OrderedLogit:
    """Newton steps until the score is below ``tolerance`` times the rows' weight, each halved until the likelihood
    rises. Columns must be of full rank (:func:`reference_columns`), and every class must occur."""
    mass = F.sum(F.col(weight)) if weight else F.count("*")
    shares = {int(r[0]): float(r[1]) for r in rows.groupBy(target).agg(mass).collect()}  # a row for each class
    if set(shares) != set(range(classes)):
        raise ValueError(f"rows must have the classes 0 to {classes - 1}: {sorted(shares)}")
    total = sum(shares.values())
    below = np.cumsum([shares[k] for k in range(classes - 1)]) / total
    start = np.log(below / (1 - below))
    a = np.concatenate([start[:1], np.log(np.diff(start))])
    width = len(rows.select(x).first()[0])
    slopes = np.zeros(width)
    value, first, second = likelihood(rows, _thresholds(a), slopes, x, target, weight)
    for step in range(most):
        gradient, hessian = _by_steps(a, first, second)
        if np.abs(gradient).max() <= tolerance * total:
            break
        move, damping = None, 0.0
        while move is None:  # uphill: damp until the matrix is negative definite
            try:
                factor = np.linalg.cholesky(damping * np.diag(np.maximum(-np.diag(hessian), 1e-12)) - hessian)
                move = np.linalg.solve(factor.T, np.linalg.solve(factor, gradient))
            except np.linalg.LinAlgError:
                damping = max(2 * damping, 1e-6)
        length = 1.0
        while True:
            tried = a + length * move[: len(a)], slopes + length * move[len(a) :]
            got = likelihood(rows, _thresholds(tried[0]), tried[1], x, target, weight)
            if got[0] >= value or length < 1e-9:
                break
            length /= 2
        if length < 1e-9:
            break
        (a, slopes), (value, first, second) = tried, got
    gradient, _ = _by_steps(a, first, second)
    return OrderedLogit(slopes.tolist(), _thresholds(a).tolist(), value, float(np.abs(gradient).max() / total), step)


def dropped_table(spark: SparkSession, columns: ReferenceColumns) -> DataFrame:
    """(name, fate) of all columns: one row for each."""
    rows = [(n, "kept") for n, *_ in columns.kept] + [(n, "unidentified") for n in columns.unidentified] + [(n, "dependent") for n in columns.dependent]
    rows += [(f"{c}={v}", "reference") for c, v in columns.references.items()]
    return spark.createDataFrame(rows, "name string, fate string")
