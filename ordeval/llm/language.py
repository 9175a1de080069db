"""Language identification: multinomial naive Bayes over hashed character n-grams (operator 6).

Character n-grams of one to ``LENGTHS`` letters (lower case, everything but letters is a space) are hashed into
``BUCKETS`` buckets. The counts of all training rows of each language, summed in the tasks that read them, give a matrix
of log probabilities, which is broadcast: its size is fixed by BUCKETS and the number of languages (at most MAX_LANGS).
Texts are scored in batches: the letters of several texts are put together up to ``BATCH`` characters, their n-grams
are the rows of one sparse matrix, and its product with the log probabilities scores all of them. A text longer than
that goes through in pieces that overlap, whose scores add up, so memory doesn't grow with a text's length.

A null text or a text without a letter is ``und`` with score 1. Null and empty language labels are not learned.
Equal scores go to the language that is first by name. Without training rows everything is ``und`` with score 0.
Repeated rows get equal predictions, and each is learned from. An empty table gives no rows. Other columns are not
read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordeval.llm.common import map_arrow, small_batches, staged

BUCKETS = 1 << 15
LENGTHS = (1, 2, 3)
SMOOTHING = 0.5
SEED = 5
#: Characters that are scored at once.
BATCH = 1 << 18
#: Values of the key of a sample whose shares are broadcast; with more of them, Spark chooses the join.
MAX_KEYS = 10_000
#: Languages that a model may have: 128 MB of counts on the driver while it is fitted.
MAX_LANGS = 512

_NO_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> str:
    """Lower-case letters with single spaces for everything else, a space at both ends; '' without a letter."""
    body = _NO_LETTERS.sub(" ", (text or "").lower()).strip()
    return f" {body} " if any(map(str.isalpha, set(body))) else ""


def pieces(text: str, size: int, overlap: int) -> Iterator[str]:
    """``text`` in pieces of ``size`` characters that begin with the last ``overlap`` characters before them: every
    n-gram of ``overlap`` + 1 characters is in one piece whole."""
    yield text[:size]
    for start in range(size, len(text), size):
        yield text[start - overlap : start + size]


def hashed_ngrams(text: str, buckets: int = BUCKETS, lengths: tuple[int, ...] = LENGTHS) -> np.ndarray:
    """The bucket of every character n-gram of ``text``."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    out = []
    for n in lengths:
        if len(codes) >= n:
            h = np.full(len(codes) - n + 1, n, np.uint64)
            for k in range(n):
                h = (h ^ codes[k : len(codes) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            out.append((h >> np.uint64(13)) % np.uint64(buckets))
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


def ngrams_of(text: str, buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """The buckets of the n-grams of each piece of a text; an n-gram that a piece repeats from the one before is
    counted once."""
    overlap = max(LENGTHS) - 1
    for k, piece in enumerate(pieces(text, BATCH, overlap)):
        if k:
            # shorter n-grams that lie in the overlap belong to the piece before
            parts = [hashed_ngrams(piece[overlap - n + 1 :], buckets, (n,)) for n in LENGTHS]
            yield np.concatenate(parts)
        else:
            yield hashed_ngrams(piece, buckets)


def settled(marked: DataFrame, label: str) -> DataFrame:
    """One row (doc_id, label) of each document in ``marked`` whose labels agree; contradictory ones are left out."""
    one = marked.groupBy("doc_id").agg(F.min(label).alias(label), F.max(label).alias("most"))
    return one.where(F.col(label) == F.col("most")).drop("most")


def one_text(given: DataFrame) -> DataFrame:
    """Of rows that repeat a ``doc_id`` the one whose text has the least hash, so a sample of ids is a sample of rows."""
    others = [c for c in given.columns if c != "doc_id"]
    least = F.min_by(F.struct(*others), F.struct(F.xxhash64("text"), "text")).alias("least")
    return given.groupBy("doc_id").agg(least).select("doc_id", *[F.col(f"least.{c}").alias(c) for c in others])


def learned_counts(train: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(lang, bucket, n) from rows (text, lang). Each task sums what it reads before anything is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total = totals.setdefault(lang, np.zeros(buckets, np.int64))
                for found in ngrams_of(letters(text), buckets):
                    total += np.bincount(found, minlength=buckets)
        for lang, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(total[at])], ["lang", "bucket", "n"]
            )

    small_batches(train.sparkSession)
    counted = train.select("text", "lang").mapInArrow(count, "lang string, bucket long, n long")
    return counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def thinned(train: DataFrame, sample: int, key: str) -> DataFrame:
    """About ``sample`` rows of each value of ``key``, chosen by a hash of ``doc_id``.

    The shares, one row for each value, are broadcast behind a check of their number, so texts that aren't chosen stay
    where they are read.
    """
    share = staged(train.groupBy(key).agg((F.lit(float(sample)) / F.count("*")).alias("__share")))
    if share.limit(MAX_KEYS + 1).count() <= MAX_KEYS:
        share = F.broadcast(share)
    chosen = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return train.join(share, key).where(chosen < F.col("__share")).drop("__share")


class NaiveBayes:
    """Log probability of each bucket (row) in each language (column), and the languages."""

    def __init__(self, langs: list[str], logs: np.ndarray) -> None:
        self.langs, self.logs = langs, logs

    @classmethod
    def fit(cls, train: DataFrame, sample: int | None = None) -> NaiveBayes:
        """From all rows (doc_id, text, lang), or about ``sample`` of each language if a caller asks for it; the languages
        get equal prior weight."""
        marked = train.where(F.col("lang").isNotNull() & (F.col("lang") != ""))
        if marked.select("lang").distinct().limit(MAX_LANGS + 1).count() > MAX_LANGS:
            raise ValueError(f"more than {MAX_LANGS} languages: their matrix would not fit")
        rows = learned_counts(thinned(marked, sample, "lang") if sample else marked).toPandas()  # a row for each language and bucket
        langs = sorted(rows["lang"].unique())
        counts = np.zeros((BUCKETS, len(langs)))
        for k, lang in enumerate(langs):
            own = rows[rows["lang"] == lang]
            counts[own["bucket"], k] = own["n"]
        counts += SMOOTHING
        return cls(langs, np.log(counts / counts.sum(axis=0)).astype(np.float32))

    def totals(self, texts: list[str]) -> np.ndarray:
        """Log probability of each text (row) in each language: the texts' n-grams as the rows of a sparse matrix, times
        the log probabilities, by one gather and one segmented sum a batch."""
        out = np.zeros((len(texts), len(self.langs)))
        rows: list[int] = []
        found: list[np.ndarray] = []
        held = 0

        def add_up() -> None:
            if rows:
                starts = np.cumsum([0, *(len(f) for f in found[:-1])])
                np.add.at(out, rows, np.add.reduceat(self.logs[np.concatenate(found)], starts, axis=0, dtype=np.float64))
                rows.clear(), found.clear()

        for i, text in enumerate(texts):
            for ngrams in ngrams_of(text):
                rows.append(i), found.append(ngrams)
                held += len(ngrams)
                if held >= BATCH:
                    add_up()
                    held = 0
        add_up()
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        cleaned = [letters(t) for t in texts]
        langs, scores = ["und"] * len(texts), [1.0] * len(texts)
        if not self.langs:
            return langs, [0.0 if c else 1.0 for c in cleaned]
        live = [i for i, c in enumerate(cleaned) if c]
        totals = self.totals([cleaned[i] for i in live])
        best = totals.argmax(axis=1)
        sure = 1.0 / np.exp(totals - totals.max(axis=1, keepdims=True)).sum(axis=1)
        for i, k, score in zip(live, best.tolist(), sure.tolist(), strict=True):
            langs[i], scores[i] = self.langs[k], score
        return langs, scores


RESULT = pa.schema(
    [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())]
)


def identify(docs: DataFrame, model: NaiveBayes) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) from rows (doc_id, text, held_out)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(columns: dict[str, list]) -> dict[str, list]:
        langs, scores = shared.value.predict(columns["text"])
        return {"doc_id": columns["doc_id"], "held_out": columns["held_out"], "lang_pred": langs, "score": scores}

    schema = "doc_id long, held_out boolean, lang_pred string, score double"
    return map_arrow(docs.select("doc_id", "text", "held_out"), score, schema, RESULT)


def language_of(docs: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """Learn from documents whose crc32 of the id is not ``held`` modulo ``folds``; predict for all."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == held, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.col("lang").cast("string"), held_out.alias("held_out"))
    model = NaiveBayes.fit(rows.where(~F.col("held_out") & F.col("doc_id").isNotNull()))
    return identify(rows, model)
