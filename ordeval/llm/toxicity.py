"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios (operator 10).

A bounded, hash-chosen sample of labelled rows of each class is found by broadcasting its ids (at most a few
times ``SAMPLE``). Spark counts in how many documents of each class a hashed n-gram occurs; the n-grams whose
log-count ratio is surest stay (``FEATURES`` of them), each scaled by its ratio, and a logistic regression is
fitted on the sample's matrix of that fixed size. The weights are broadcast and whole texts are scored in
batches.

A null text is an empty one; it gets the score of a text without any feature. Without both classes among the
training rows the score is next to 1 or 0 for all. Labels that are null or not 0/1 are ignored, and so are documents
whose labels contradict each other. Repeated rows and ties get equal scores; of rows that repeat a labelled id one text
is learned from, the one with the least hash. Very long texts are read in pieces that overlap, and the features found
in them are put together, so memory grows with the features, not with the text. An empty table gives no rows. Other
columns are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordeval.llm.common import map_arrow, small_batches, small_side, staged
from ordeval.llm.language import BATCH, hashed_ngrams, one_text, pieces, settled, thinned

BUCKETS = 1 << 19
LENGTHS = (4, 5, 6, 7)
#: Labelled documents of each class that the model learns from, about.
SAMPLE = 4_000
FEATURES = 4096
#: An n-gram is in at least so many training documents.
MIN_DOCS = 3
RIDGE = 0.001
STEPS = 300

_GAPS = re.compile(r"[\W_]+")


def plain(text: str | None) -> str:
    """Lower-case words with single spaces, one at both ends."""
    return f" {_GAPS.sub(' ', (text or '').lower()).strip()} "


def present(text: str | None, wanted: np.ndarray | None = None) -> np.ndarray:
    """Buckets of the n-grams of a whole text, each once; only those that ``wanted`` marks."""
    found = []
    for piece in pieces(plain(text), BATCH, max(LENGTHS) - 1):
        part = hashed_ngrams(piece, BUCKETS, LENGTHS)
        found.append(np.unique(part if wanted is None else part[wanted[part]]))
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


def document_counts(train: DataFrame) -> DataFrame:
    """(bucket, toxic, clean): training documents of each class with the n-gram; summed in each task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, BUCKETS), np.int32)
        for b in batches:
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                totals[label, present(text)] += 1
        at = np.flatnonzero(totals.any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(at), pa.array(totals[1, at], pa.int64()), pa.array(totals[0, at], pa.int64())],
            ["bucket", "toxic", "clean"],
        )

    small_batches(train.sparkSession)
    counted = train.select("text", "label").mapInArrow(count, "bucket long, toxic long, clean long")
    return counted.groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def surest(counts: DataFrame, n_toxic: int, n_clean: int, features: int = FEATURES) -> DataFrame:
    """(bucket, ratio) of the n-grams whose log-count ratio is largest against its standard error."""
    a, b = F.col("toxic") + 1.0, F.col("clean") + 1.0
    ratio = F.log(a / (n_toxic + 2.0)) - F.log(b / (n_clean + 2.0))
    error = F.sqrt(1.0 / a - 1.0 / (n_toxic + 2.0) + 1.0 / b - 1.0 / (n_clean + 2.0))
    return (
        counts.where(F.col("toxic") + F.col("clean") >= MIN_DOCS)
        .select("bucket", ratio.alias("ratio"), F.abs(ratio / error).alias("sure"))
        .orderBy(F.desc("sure"), "bucket")
        .limit(features)
    )


def sample_matrix(train: DataFrame, lookup: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dense 0/1 rows of the sample over the chosen features, and the labels; a size fixed by the parameters."""
    shared = train.sparkSession.sparkContext.broadcast(lookup)

    def rows(columns: dict[str, list]) -> dict[str, list]:
        wanted = shared.value >= 0
        found = [shared.value[present(t, wanted)] for t in columns["text"]]
        return {"label": columns["label"], "at": [f[f >= 0].tolist() for f in found]}

    schema = pa.schema([("label", pa.int32()), ("at", pa.list_(pa.int32()))])
    got = map_arrow(train.select("text", "label"), rows, "label int, at array<int>", schema).toPandas()
    # sums of floats hang on their order: rows are in one of their own, not that in which tasks end
    order = sorted(range(len(got)), key=lambda i: (got["label"][i], tuple(got["at"][i])))
    got = got.iloc[order]
    x = np.zeros((len(got), int(lookup.max()) + 1), np.float32)
    for i, at in enumerate(got["at"]):
        x[i, np.asarray(at, np.int64)] = 1.0
    return x, got["label"].to_numpy(np.float32)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by accelerated gradient steps; both classes weigh the same."""
    share = float(y.mean())
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32) / len(y)
    v = np.ones(x.shape[1], np.float32)
    for _ in range(20):  # the largest curvature, for the length of a step
        v /= max(float(np.linalg.norm(v)), 1e-12)
        v = x.T @ (weight * (x @ v))
    bound = 0.3 * (float(np.linalg.norm(v)) + 1.0) + ridge
    w = np.zeros(x.shape[1] + 1, np.float32)
    ahead = w.copy()
    for k in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ ahead[:-1] + ahead[-1], -30, 30)))
        g = weight * (p - y)
        new = ahead - np.append(x.T @ g + ridge * ahead[:-1], g.sum()) / bound
        ahead = new + (k / (k + 3)) * (new - w)
        w = new
    return w[:-1], float(w[-1])


class ToxicityModel:
    """Weight of every bucket (0 for those not chosen) and the intercept."""

    def __init__(self, weights: np.ndarray, intercept: float) -> None:
        self.weights, self.intercept, self.used = weights, intercept, weights != 0

    @classmethod
    def fit(cls, train: DataFrame, tasks: int = 8) -> ToxicityModel:
        """From a bounded table (text, label)."""
        sizes = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
        n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
        nothing = np.zeros(BUCKETS, np.float32)
        if not n_toxic or not n_clean:
            return cls(nothing, 30.0 if n_toxic else -30.0)
        spread = train.repartition(tasks)
        best = surest(document_counts(spread), n_toxic, n_clean).toPandas()
        if best.empty:
            return cls(nothing, float(np.log(n_toxic / n_clean)))
        lookup = np.full(BUCKETS, -1, np.int32)
        lookup[best["bucket"].to_numpy()] = np.arange(len(best))
        x, y = sample_matrix(spread, lookup)
        ratios = best["ratio"].to_numpy(np.float32)
        x *= ratios
        w, intercept = logistic(x, y)
        weights = nothing
        weights[best["bucket"].to_numpy()] = w * ratios
        return cls(weights, intercept)

    def score(self, text: str | None) -> float:
        found = present(text, self.used)
        z = float(self.weights[found].sum(dtype=np.float64)) + self.intercept
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))))


RESULT = pa.schema(
    [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())]
)


def score_documents(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, held_out, score, predicted) from rows (doc_id, text, held_out)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(columns: dict[str, list]) -> dict[str, list]:
        scores = [shared.value.score(t) for t in columns["text"]]
        return {
            "doc_id": columns["doc_id"],
            "held_out": columns["held_out"],
            "score": scores,
            "predicted": [int(s >= 0.5) for s in scores],
        }

    schema = "doc_id long, held_out boolean, score double, predicted int"
    return map_arrow(docs.select("doc_id", "text", "held_out"), score, schema, RESULT)


def toxicity_of(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = 5, held: int = 0) -> DataFrame:
    """Learn from labelled rows whose crc32 of the id is not ``held`` modulo ``folds``; score all documents."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == held, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long"), "text", held_out.alias("held_out"))
    marked = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label"))
        .where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
        .where(F.crc32(F.col("doc_id").cast("string")) % folds != held)
    )
    chosen = small_side(staged(thinned(settled(marked, "label"), sample, "label")), 4 * sample)  # about 2 * sample ids
    train = one_text(docs.select(F.col("doc_id").cast("long"), "text").join(chosen, "doc_id"))
    model = ToxicityModel.fit(staged(train))
    return score_documents(rows, model)
