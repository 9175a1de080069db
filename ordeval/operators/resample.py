"""Class-stratified paired bootstrap (survey R07-R12, A26).

The rows of a group are first counted by (true class, joint prediction pattern); a draw then resamples those few
counts within each class, which has the same distribution as resampling records. Iterations are dealt over
tasks: each (group, block of iterations) draws with a generator seeded by its own name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordeval.functions.columns import hash32, interval_evidence
from ordeval.operators.joins import cohort_gap
from ordeval.operators.metrics import contrasts, intervals
from ordeval.operators.splits import rank_in_class

BLOCK = 250


def stream_seed(*name: object) -> int:
    """A generator's seed from its name."""
    return int.from_bytes(hashlib.sha256("|".join(map(str, name)).encode()).digest()[:8], "little")


def stream_seed_column(name: Column) -> Column:
    """:func:`stream_seed` of a text column, as an unsigned decimal: the first 8 bytes of its SHA-256, the lowest first."""
    digest = F.sha2(name, 256)
    swapped = F.concat(*[F.substring(digest, 2 * i + 1, 2) for i in reversed(range(8))])
    return F.conv(swapped, 16, 10)


def pattern_counts(stacked: DataFrame, keys: Sequence[str], true: str, predictions: Sequence[str]) -> DataFrame:
    """(keys, true, predictions, n): the observed joint patterns."""
    return stacked.groupBy(*keys, true, *predictions).agg(F.count("*").alias("n"))


def bootstrap_confusions(
    patterns: DataFrame, keys: Sequence[str], true: str, predictions: Sequence[str], iterations: int, seed: int
) -> DataFrame:
    """(keys, iteration, model, c00..c22) of every draw; models share a draw, groups don't."""
    keys, predictions = list(keys), list(predictions)
    types = dict(patterns.dtypes)
    cells = [f"c{i}{j}" for i in range(3) for j in range(3)]
    schema = ", ".join([f"`{k}` {types[k]}" for k in keys] + ["iteration int", "model string"] + [f"{c} long" for c in cells])
    blocks = F.explode(F.sequence(F.lit(0), F.lit((iterations - 1) // BLOCK))).alias("__block")

    def draw(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([true, *predictions], kind="mergesort").reset_index(drop=True)
        block = int(rows["__block"].iloc[0])
        size = min(BLOCK, iterations - block * BLOCK)
        rng = np.random.default_rng(stream_seed(seed, *rows.loc[0, keys].tolist(), block))
        drawn = np.zeros((size, len(rows)), np.int64)
        for _, at in rows.groupby(true).indices.items():
            n = rows["n"].to_numpy()[at]
            drawn[:, at] = rng.multinomial(int(n.sum()), n / n.sum(), size=size)
        out = []
        for p in predictions:
            cell = (rows[true].astype(int) * 3 + rows[p].astype(int)).to_numpy()
            counts = drawn @ (cell[:, None] == np.arange(9)[None, :]).astype(np.int64)
            frame = pd.DataFrame(counts, columns=cells)
            frame.insert(0, "model", p)
            frame.insert(0, "iteration", np.arange(size, dtype=np.int32) + block * BLOCK)
            for k in reversed(keys):
                frame.insert(0, k, rows.loc[0, k])
            out.append(frame)
        return pd.concat(out, ignore_index=True)

    return patterns.select("*", blocks).groupBy(*keys, "__block").applyInPandas(draw, schema)


def slot_bootstrap(df: DataFrame, id_col: str, true: str, iterations: int, columns: Sequence[str], stream: str = "") -> DataFrame:
    """Record bootstrap that any engine can repeat: slot j of class k in iteration b takes the record
    whose hash rank in the class is hash(b:k:j) modulo the class's size. Draws of another ``stream`` are independent (its
    name goes before the hashed text). Rows times iterations by definition: a check of the bootstrap of counts, which is
    the way at scale."""
    ranked = rank_in_class(df.select(id_col, true, *columns), 0, id_col, true, size="__size")
    draws = F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))).alias("iteration")
    slots = ranked.select(true, "__size", F.col("rank").alias("__slot"), draws)
    name = F.concat_ws(":", *([F.lit(stream)] if stream else []), F.col("iteration").cast("string"), F.col(true).cast("string"), F.col("__slot").cast("string"))
    picks = slots.groupBy("iteration", true, (F.pmod(hash32(name), F.col("__size")) + 1).alias("rank")).agg(F.count("*").alias("times"))
    return picks.join(ranked, [true, "rank"]).select("iteration", true, id_col, *columns, "times")


def judged_intervals(draws: DataFrame, observed: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, draws, low, high, observed, evidence): the interval of the draws, judged with the observed value."""
    points = observed.select(*keys, F.col(value).alias("observed"))
    out = intervals(draws, keys, value).join(points, list(keys))
    return out.withColumn("evidence", interval_evidence(F.col("observed"), F.col("low"), F.col("high")))


def independent_gaps(
    draws: DataFrame, observed: DataFrame, internal: str, future: str, keys: Sequence[str], cohort: str = "role"
) -> DataFrame:
    """Internal minus future. The cohorts' draws come from streams of their own, so equal iterations meet by
    chance only: the difference of two independent samples. ``draws`` has (keys, cohort, iteration, value), ``observed``
    the same without iterations."""
    keys = list(keys)
    return judged_intervals(
        cohort_gap(draws, internal, future, [*keys, "iteration"], cohort), cohort_gap(observed, internal, future, keys, cohort), keys, "gap"
    )


def paired_contrasts(draws: DataFrame, observed: DataFrame, weights: DataFrame, keys: Sequence[str], by: str = "model") -> DataFrame:
    """Weighted sums of models that share each draw, with the observed sums."""
    keys = list(keys)
    return judged_intervals(contrasts(draws, weights, [*keys, "iteration"], by), contrasts(observed, weights, keys, by), ["contrast", *keys], "value")
