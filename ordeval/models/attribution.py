"""Path-dependent tree attributions of a forest (survey M12), exact and additive.

A leaf on whose path the features j have cover shares r_j and whose conditions a row meets or not (o_j is 1 or 0)
is a game with value v prod(o_j or r_j); its Shapley values are v (o_i - r_i) times a weighted sum of the
coefficients of prod over j other than i of (r_j + o_j y). Leaves are walked in numpy over batches of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Leaf:
    """A leaf's class values and, by feature, its cover share and conditions (threshold or categories, goes left)."""

    value: np.ndarray
    features: list[int]
    shares: list[float]
    tests: list[list[tuple[bool, np.ndarray, bool]]]


def saved_leaves(spark: SparkSession, path: str) -> list[Leaf]:
    """The leaves of a saved forest, read back from its node table (a size fixed by trees and depth)."""
    nodes = spark.read.parquet(f"{path}/data")
    rows = nodes.select("treeID", "nodeData.*").toPandas() if "nodeData" in nodes.columns else nodes.toPandas()
    trees = {int(t): {int(n["id"]): n for n in g.to_dict("records")} for t, g in rows.groupby("treeID")}
    leaves: list[Leaf] = []
    for nodes_of in trees.values():
        cover = {i: float(np.sum(n["impurityStats"])) for i, n in nodes_of.items()}

        def walk(i: int, path_: list[tuple[int, float, tuple[bool, np.ndarray, bool]]]) -> None:
            n = nodes_of[i]
            if int(n["leftChild"]) < 0:
                stats = np.asarray(n["impurityStats"], float)
                grouped: dict[int, tuple[float, list]] = {}
                for f, share, test in path_:
                    s, tests = grouped.get(f, (1.0, []))
                    grouped[f] = (s * share, [*tests, test])
                leaves.append(Leaf(stats / stats.sum() / len(trees), list(grouped), [g[0] for g in grouped.values()], [g[1] for g in grouped.values()]))
                return
            split = n["split"]
            categorical = int(split["numCategories"]) >= 0
            values = np.asarray(split["leftCategoriesOrThreshold"], float)
            for child, left in ((int(n["leftChild"]), True), (int(n["rightChild"]), False)):
                walk(child, [*path_, (int(split["featureIndex"]), cover[child] / cover[i], (categorical, values, left))])

        walk(0, [])
    return leaves


def _meets(x: np.ndarray, tests: list[tuple[bool, np.ndarray, bool]]) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for categorical, values, left in tests:
        goes_left = np.isin(x, values) if categorical else x <= values[0]
        ok &= goes_left == left
    return ok


def attribute(rows: np.ndarray, leaves: list[Leaf]) -> tuple[np.ndarray, np.ndarray]:
    """(rows, features, classes) attributions and the base value of each class."""
    classes = len(leaves[0].value)
    out = np.zeros((len(rows), rows.shape[1], classes))
    base = np.zeros(classes)
    for leaf in leaves:
        d = len(leaf.features)
        base += leaf.value * math.prod(leaf.shares)
        met = [_meets(rows[:, f], t).astype(float) for f, t in zip(leaf.features, leaf.tests, strict=True)]
        for i in range(d):
            poly = np.zeros((d, len(rows)))  # by number of features that are known
            poly[0] = 1.0
            for j in range(d):
                if j != i:
                    known = np.vstack([np.zeros((1, len(rows))), poly[:-1]]) * met[j]
                    poly = poly * leaf.shares[j] + known
            weight = np.array([math.factorial(k) * math.factorial(d - 1 - k) / math.factorial(d) for k in range(d)])
            change = (met[i] - leaf.shares[i]) * (weight @ poly)
            out[:, leaf.features[i], :] += change[:, None] * leaf.value[None, :]
    return out, base


def attributions(scored: DataFrame, leaves: list[Leaf], id_col: str, features: str = "features") -> DataFrame:
    """(id, class, base, phi): one row for each row and class."""
    shared = scored.sparkSession.sparkContext.broadcast(leaves)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                phi, base = attribute(np.stack(b["x"].to_numpy()).astype(float), shared.value)
                k = len(base)
                yield pd.DataFrame({
                    id_col: np.repeat(b[id_col].to_numpy(), k), "class": np.tile(np.arange(k, dtype=np.int32), len(b)),
                    "base": np.tile(base, len(b)), "phi": [phi[i, :, c].tolist() for i in range(len(b)) for c in range(k)],
                })

    kind = dict(scored.dtypes)[id_col]
    given = scored.select(id_col, vector_to_array(features).alias("x"))
    return given.mapInPandas(run, f"`{id_col}` {kind}, class int, base double, phi array<double>")


def additivity(attributed: DataFrame, scored: DataFrame, id_col: str) -> DataFrame:
    """The largest difference between base + sum of attributions and the probability, by class."""
    total = F.col("base") + F.aggregate("phi", F.lit(0.0), lambda a, x: a + x)
    joined = attributed.join(scored.select(id_col, "prob"), id_col)
    return joined.groupBy("class").agg(F.count("*").alias("n"), F.max(F.abs(total - F.get("prob", F.col("class")))).alias("largest"))
