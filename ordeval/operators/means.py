"""Stratified bootstrap of mean vectors at any size (survey R11).

A draw takes as many rows with replacement from each stratum as the stratum has. No task holds a stratum: its rows are
dealt into leaves of about LEAF rows by bits of a hash of their id, which are the leaves of a binary tree. A draw's number
of rows is split down the tree, at each node by a binomial with the share of the left child's rows, and in a leaf evenly
over its rows; that is the multinomial over all rows, factored. A node's generator is seeded by the node's name, so all
leaves below it see the same split without meeting, a lost task draws the same again, and any order or number of
partitions gives the same draws. Sums of leaves are added up before they are shuffled: one row for each group and draw.

A leaf knows the sizes of the nodes on its path, which come from counts of leaves.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordeval.functions.columns import hash32
from ordeval.operators.ranks import with_keys
from ordeval.operators.resample import stream_seed
from ordeval.sources.shared import new_path

LEAF = 1024
#: Draws that share a generator: a task holds one block of them at a time.
BLOCK = 250


def node_rng(*name: object) -> np.random.Generator:
    """The generator of a named node."""
    return np.random.default_rng(stream_seed(*name))


def draws_in_leaf(name: Sequence[object], leaf: int, size: int, lefts: Sequence[int], block: int, draws: int) -> np.ndarray:
    """How many rows each draw of a block takes in a leaf: ``size`` is that of the stratum, ``lefts`` that of the left child
    on each level of the leaf's path."""
    left_to_give, depth = np.full(draws, size, np.int64), len(lefts)
    for level, left in enumerate(lefts):
        node, goes_right = leaf >> (depth - level), leaf >> (depth - level - 1) & 1
        given = node_rng(*name, level, node, block).binomial(left_to_give, left / size)
        left_to_give, size = (left_to_give - given, size - left) if goes_right else (given, left)
    return left_to_give


def sums_in_leaf(name: Sequence[object], leaf: int, depth: int, block: int, counts: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The sums of the rows that each draw of a block takes, evenly from the leaf's rows ``x``."""
    rng = node_rng(*name, "leaf", depth, leaf, block)
    times = np.array([np.bincount(rng.integers(0, len(x), c), minlength=len(x)) for c in counts.tolist()])
    return times @ x


def leaf_of(id_col: str, depth: str) -> Column:
    """The first ``depth`` bits of the hash of the id."""
    return F.floor(hash32(F.col(id_col).cast("string")) / F.pow(F.lit(2.0), F.lit(32) - F.col(depth))).cast("long")


def bootstrap_means(
    df: DataFrame, keys: Sequence[str], stratum: str, values: Sequence[str], iterations: int, seed: int, id_col: str = "id", leaf: int = LEAF
) -> DataFrame:
    """(keys, iteration, mean of each value) of stratified draws from each group; ids tell the rows of a group apart.

    Null keys and strata are groups; a null value counts as 0. Rows of equal ids share a leaf.
    """
    keys, values = list(keys), list(values)
    at = [*keys, stratum]
    filled = [F.coalesce(F.col(v).cast("double"), F.lit(0.0)).alias(v) for v in values]
    rows = df.select(*at, F.col(id_col).alias("__id"), *filled)
    sizes = rows.groupBy(*at).agg(F.count("*").alias("__size"))
    deep = F.ceil(F.log2(F.greatest(F.col("__size") / F.lit(float(leaf)), F.lit(1.0)))).cast("int")
    sizes = sizes.withColumn("__depth", F.least(deep, F.lit(32)))
    dealt = with_keys(rows, sizes.select(*at, "__depth"), at).withColumn("__leaf", leaf_of("__id", "__depth"))
    leaves = dealt.groupBy(*at, "__depth", "__leaf").agg(F.count("*").alias("__m"))
    # the left child of each node on a leaf's path, from the counts of all nodes
    levels = F.explode(F.when(F.col("__depth") > 0, F.sequence(F.lit(1), F.col("__depth"))).otherwise(F.array())).alias("__level")
    node = F.floor(F.col("__leaf") / F.pow(F.lit(2.0), F.col("__depth") - F.col("__level"))).cast("long")
    paths = leaves.select(*at, "__leaf", "__m", levels, "__depth").withColumn("__node", node)
    nodes = paths.groupBy(*at, "__level", "__node").agg(F.sum("__m").alias("__left"))
    lefts = with_keys(paths.withColumn("__node", F.col("__node") - F.col("__node") % 2), nodes, [*at, "__level", "__node"], "left")
    collected = F.sort_array(F.collect_list(F.struct("__level", F.coalesce("__left", F.lit(0)).alias("n"))))
    lists = lefts.groupBy(*at, "__leaf").agg(collected.alias("__path"))
    plan = with_keys(with_keys(leaves, sizes.select(*at, "__size"), at), lists, [*at, "__leaf"], "left").select(*at, "__leaf", "__depth", "__size", F.col("__path.n").alias("__lefts"))
    path, plan_schema = new_path(df.sparkSession, "leaves"), plan.schema  # a row for each leaf, written once
    plan.write.parquet(path)
    plan = df.sparkSession.read.schema(plan_schema).parquet(path)
    types = dict(rows.dtypes)
    schema = ", ".join([f"`{k}` {types[k]}" for k in keys] + ["__iteration int"] + [f"`{v}` double" for v in values])

    def draw(own: pd.DataFrame, path: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["__id", *values], kind="mergesort")
        x, one = own[values].to_numpy(float), path.iloc[0]
        name = (seed, *(one[k] for k in at))
        number, depth, lefts_ = int(one["__leaf"]), int(one["__depth"]), [int(n) for n in (one["__lefts"] if one["__lefts"] is not None else [])]
        parts = []
        for block in range(-(-iterations // BLOCK)):
            n = min(BLOCK, iterations - block * BLOCK)
            counts = draws_in_leaf(name, number, int(one["__size"]), lefts_, block, n)
            parts.append(sums_in_leaf(name, number, depth, block, counts, x))
        frame = pd.DataFrame(np.concatenate(parts), columns=values)
        frame.insert(0, "__iteration", np.arange(iterations, dtype=np.int32))
        for k in reversed(keys):
            frame.insert(0, k, one[k])
        return frame

    group = [*at, "__leaf"]
    sums = dealt.groupBy(*group).cogroup(plan.groupBy(*group)).applyInPandas(draw, schema)
    totals = sizes.groupBy(*keys).agg(F.sum("__size").alias("__total")) if keys else sizes.agg(F.sum("__size").alias("__total"))
    added = sums.groupBy(*keys, "__iteration").agg(*[F.sum(v).alias(v) for v in values])
    path, added_schema = new_path(df.sparkSession, "draws"), added.schema  # a row for each group and draw: whoever reads it twice draws once
    added.write.parquet(path)
    added = df.sparkSession.read.schema(added_schema).parquet(path)
    joined = with_keys(added, totals, keys) if keys else added.crossJoin(F.broadcast(totals))  # one row
    return joined.select(*keys, F.col("__iteration").alias("iteration"), *[(F.col(v) / F.col("__total")).alias(v) for v in values])
