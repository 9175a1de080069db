"""Quality rules: an isolation forest on rule statistics (operator 5).

Statistics of whole texts are what the forest sees. Every labelled row is learned from: the forest grows on half of the
rows that are marked good (by a hash of the id), each tree on ROWS_A_TREE of that half's rows, drawn anew as the method has
it; documents that few splits isolate are anomalous. The mean depth below which a document is anomalous is calibrated on
all labelled rows that the forest can't have seen, the other half and the bad rows, by counts of depths that Spark adds up.
The forest is broadcast (its size is fixed). Every document is measured once, into a narrow table that is written; what is
learned comes from that table's rows, so texts are never shuffled.

Nulls: a null text has no words, so it fails the base rules. Null ids pass through; labels of null ids are
ignored. A document that is marked good and bad is not learned from. Without labelled rows of either kind the verdict
is the base rules alone. Repeated rows and ties get equal verdicts; of rows that repeat a labelled id one text is
learned from, the one with the least hash. Very long texts are read whole, one at a time. Empty tables give no rows.
Other columns are not read, whatever their names, and pass through :func:`keep_good`.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordeval.llm.common import map_arrow, small_batches, staged
from ordeval.llm.language import settled
from ordeval.operators import ranks

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
TREES, ROWS_A_TREE = 100, 256
SEED = 11
#: Fixed-point unit of the features whose spread is summed exactly.
UNIT = 1 << 20
#: Of the good labelled rows at most this share may be lost by the threshold.
LOSS = 0.002

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What the forest sees besides: characters in all, upper-case letters, letters, digits, other characters.
MORE = ("n_chars_all", "n_upper", "n_letters", "n_digits", "n_marks")
STATISTICS = pa.schema([("doc_id", pa.int64())] + [(c, pa.int64()) for c in COUNTS + MORE])

_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOLS = re.compile(r"[#*$%&|<>]")
FEATURES = ("word_length", "symbols", "dup_lines", "repeats", "upper", "digits", "marks")


def repeated_words(words: list[str]) -> int:
    """Words in three-word windows that are found twice or more in the text, the first included."""
    if len(words) < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    found = Counter(windows)
    total, done = 0, -1
    for i, w in enumerate(windows):
        if found[w] > 1:
            total += i + 2 - max(done, i - 1)
            done = i + 2
    return total


def text_statistics(text: str | None) -> tuple[int, ...]:
    """Values of ``COUNTS`` and ``MORE`` for a whole text."""
    text = text or ""
    words = _WORDS.findall(text)
    seen: set[str] = set()
    dup_lines = 0
    for line in text.split("\n"):
        if line in seen:
            dup_lines += 1
        elif _WORDS.search(line):
            seen.add(line)
    word_chars = sum(map(len, words))
    symbols = len(_SYMBOLS.findall(text))
    chars = Counter(text)
    upper = sum(n for c, n in chars.items() if c.isupper())
    letters = sum(n for c, n in chars.items() if c.isalpha())
    digits = sum(n for c, n in chars.items() if c.isdecimal())
    return (
        len(words), word_chars, symbols, dup_lines, repeated_words(words),
        len(text), upper, letters, digits, word_chars - letters - digits,
    )


def rule_statistics(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text_hash, statistics) of documents (doc_id, text); one pass, no shuffle."""
    schema = pa.schema([*STATISTICS, ("text_hash", pa.int64())])

    def measure(columns: dict[str, list]) -> dict[str, list]:
        rows = _measured(columns["text"])
        return {"doc_id": columns["doc_id"], **{c: rows[c] for c in COUNTS + MORE}, "text_hash": columns["text_hash"]}

    ddl = ", ".join(f"{f.name} long" for f in schema)
    return map_arrow(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")), measure, ddl, schema)


def base_failed() -> Column:
    """The base rules: too few words, or too many words in repeated windows."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))


def features(rows: pd.DataFrame) -> np.ndarray:
    """Ratios that don't depend on a document's length."""
    words = rows["n_words"].clip(lower=1).to_numpy(float)
    chars = rows["word_chars"].clip(lower=1).to_numpy(float)
    letters = rows["n_letters"].clip(lower=1).to_numpy(float)
    columns = (
        rows["word_chars"] / words, rows["n_symbols"] / chars, rows["n_dup_lines"] / np.sqrt(words),
        rows["n_repeat_words"] / words, rows["n_upper"] / letters, rows["n_digits"] / chars, rows["n_marks"] / chars,
    )
    return np.stack([np.asarray(c, float) for c in columns], axis=1)


def mean_path(n: float) -> float:
    """Mean depth of an unsuccessful search in a random tree over n rows."""
    if n <= 1:
        return 0.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n if n > 2 else 1.0


class IsolationForest:
    """Random splits; ``depths`` is the mean path length of each row."""

    def __init__(self, trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> None:
        self.trees = trees

    @classmethod
    def grow(
        cls, rows: np.ndarray, trees: int = TREES, sample: int = ROWS_A_TREE, seed: int = SEED, margin: np.ndarray | None = None
    ) -> IsolationForest:
        """Splits are drawn between bounds wider than a node's rows by ``margin`` (by feature), so that rows outside
        of all that the forest has seen part early, even in a feature that is the same in all of its rows."""
        rng = np.random.default_rng(seed)
        margin = np.zeros(rows.shape[1]) if margin is None else margin
        return cls.of((rows[rng.permutation(len(rows))[:sample]] for _ in range(trees)), min(sample, len(rows)), rng, margin)

    @classmethod
    def of(cls, parts: Iterable[np.ndarray], size: int, rng: np.random.Generator, margin: np.ndarray) -> IsolationForest:
        """A tree on each of ``parts``, which have ``size`` rows."""
        limit = 2 * math.ceil(math.log2(max(2, size)))
        grown = []
        for chosen in parts:
            feature, cut, right, path = [], [], [], []

            def node(part: np.ndarray, depth: int) -> None:
                here = len(feature)
                feature.append(-1), cut.append(0.0), right.append(-1), path.append(depth + mean_path(len(part)))
                spread = part.max(axis=0) - part.min(axis=0) + margin if len(part) else margin
                if len(part) <= 1 or depth >= limit or not (spread > 0).any():
                    return
                f = int(rng.choice(np.flatnonzero(spread > 0)))
                low, high = part[:, f].min() - margin[f], part[:, f].max() + margin[f]
                feature[here], cut[here] = f, float(rng.uniform(low, high))
                goes_left = part[:, f] < cut[here]
                node(part[goes_left], depth + 1)
                right[here] = len(feature)
                node(part[~goes_left], depth + 1)

            node(chosen, 0)
            grown.append((np.array(feature), np.array(cut), np.array(right), np.array(path)))
        return cls(grown)

    def depths(self, rows: np.ndarray) -> np.ndarray:
        total = np.zeros(len(rows))
        for feature, cut, right, path in self.trees:
            at = np.zeros(len(rows), np.int64)
            live = np.flatnonzero(feature[at] >= 0)
            while len(live):
                f = feature[at[live]]
                left = rows[live, f] < cut[at[live]]
                at[live] = np.where(left, at[live] + 1, right[at[live]])
                live = live[feature[at[live]] >= 0]
            total += path[at]
        return total / max(1, len(self.trees))


def calibrated(depths: np.ndarray, good: np.ndarray, loss: float = LOSS) -> float:
    """The depth below which a row is anomalous: most bad rows found, at most ``loss`` of the good ones lost. For arrays;
    :func:`calibrated_rows` takes a table."""
    kept, lost = np.sort(depths[good]), np.sort(depths[~good])
    if not len(kept) or not len(lost):
        return -math.inf
    best, found = -math.inf, 0.0
    for cut in np.unique(depths):
        away = np.searchsorted(kept, cut) / len(kept)
        if away > loss:
            break
        gain = np.searchsorted(lost, cut) / len(lost) - away
        if gain >= found:
            best, found = float(cut), gain
    # half way to the nearest good row that stays
    above = kept[np.searchsorted(kept, best)] if np.isfinite(best) and kept[-1] >= best else best
    below = lost[lost < best].max(initial=best) if np.isfinite(best) else best
    return (above + below) / 2 if np.isfinite(best) and below < above else best


def calibrated_rows(known: DataFrame, loss: float = LOSS) -> float:
    """:func:`calibrated` for rows (depth, good) of any number.

    Between two good depths the upper one loses no more good rows and finds no fewer bad ones, so good depths are all that
    need to be tried; what lies below each comes from counts of depths.
    """
    below = lambda rows, name: ranks.value_counts(rows.select("depth"), "depth").select("depth", F.col("before").alias(name), F.col("total").alias(f"{name}_of"))
    both = below(known.where("good = 1"), "g").join(below(known, "a"), "depth")
    lost = F.col("g") / F.col("g_of")
    gain = F.try_divide(F.col("a") - F.col("g"), F.col("a_of") - F.col("g_of")) - lost
    best = both.where(lost <= loss).agg(F.max(F.struct(gain.alias("gain"), "depth")).alias("b")).first()["b"]
    if best is None or best["gain"] is None:
        return -math.inf
    return best["depth"]


VERDICTS = pa.schema(
    [("doc_id", pa.int64())]
    + [(c, pa.int64()) for c in COUNTS]
    + [("base_failed", pa.bool_()), ("depth", pa.float64()), ("kept", pa.bool_())]
)


class QualityModel:
    """A forest and the depth from which a document is kept; without a forest the base rules decide alone."""

    def __init__(self, forest: IsolationForest | None = None, cut: float = -math.inf) -> None:
        self.forest, self.cut = forest, cut

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
        """On all labelled rows; base failures don't count."""
        return cls.learned(staged(rule_statistics(_given(docs, id_col, text_col))), labels)

    @classmethod
    def learned(cls, measured: DataFrame, labels: DataFrame) -> QualityModel:
        """From :func:`rule_statistics` of all documents."""
        marked = (
            labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("good"))
            .where(F.col("good").isin(0, 1) & F.col("doc_id").isNotNull())
        )
        counts = ["text_hash", *COUNTS, *MORE]
        one = measured.join(settled(marked, "good"), "doc_id").groupBy("doc_id").agg(F.first("good").alias("good"), F.min(F.struct(*counts)).alias("s"))
        known = one.select("doc_id", "good", "s.*").where(~base_failed())
        names = [f"f{i}" for i in range(len(FEATURES))]
        schema = pa.schema([("doc_id", pa.int64()), ("good", pa.int32()), *[(n, pa.float64()) for n in names]])

        def described(columns: dict[str, list]) -> dict[str, list]:
            x = features(pd.DataFrame({c: columns[c] for c in COUNTS + MORE}))
            return {"doc_id": columns["doc_id"], "good": columns["good"], **dict(zip(names, x.T, strict=True))}

        known = staged(map_arrow(known, described, "doc_id long, good int, " + ", ".join(f"{n} double" for n in names), schema))
        half = (F.col("good") == 1) & (F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(2)) == 0)
        fixed = [F.rint(F.col(n) * UNIT).cast("decimal(38,0)") for n in names]  # whole numbers: the sums hang on no order
        sums = [f(v).alias(f"{k}{n}") for v, n in zip(fixed, names, strict=True) for k, f in (("a", F.sum), ("b", lambda v: F.sum(v * v)))]
        size = known.agg(F.count("*").alias("n"), F.count_if(F.col("good") == 1).alias("good"), F.count_if(half).alias("half"), *sums).first()
        if size["good"] in (0, size["n"]):
            return cls()
        margin = np.array([math.sqrt(size["n"] * int(size[f"b{n}"]) - int(size[f"a{n}"]) ** 2) / size["n"] / UNIT for n in names])
        parted = 0 < size["half"] < size["good"]
        grown, n_grown = (known.where(half), size["half"]) if parted else (known.where("good = 1"), size["good"])
        # each tree's rows are those of least hash; twice as many as it takes are looked at
        place = F.xxhash64("doc_id", "tree", F.lit(SEED))
        near = F.pmod(place, F.lit(1 << 30)) < int(min(1.0, 2 * ROWS_A_TREE / n_grown) * (1 << 30))
        drawn = grown.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1)))).where(near)
        order = Window.partitionBy("tree").orderBy(F.pmod(place, F.lit(1 << 30)), "doc_id")
        drawn = drawn.withColumn("place", F.row_number().over(order)).where(F.col("place") <= ROWS_A_TREE).toPandas()  # TREES x ROWS_A_TREE rows
        parts = [p[names].to_numpy() for _, p in drawn.sort_values(["tree", "place"]).groupby("tree")]
        forest = IsolationForest.of(parts, min(ROWS_A_TREE, n_grown), np.random.default_rng(SEED), margin)
        shared = known.sparkSession.sparkContext.broadcast(forest)

        def deep(columns: dict[str, list]) -> dict[str, list]:
            return {"good": columns["good"], "depth": shared.value.depths(np.stack([np.asarray(columns[n], float) for n in names], axis=1))}

        unseen = known.where(~half) if parted else known
        depths = staged(map_arrow(unseen, deep, "good int, depth double", pa.schema([("good", pa.int32()), ("depth", pa.float64())])))
        return cls(forest, calibrated_rows(depths))

    def verdicts(self, rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(base_failed, depth, kept) from columns of counts."""
        n, repeated = rows["n_words"].to_numpy(), rows["n_repeat_words"].to_numpy()
        failed = (n < MIN_WORDS) | (100 * repeated > MAX_REPEATED_PERCENT * n)
        depth = self.forest.depths(features(rows)) if self.forest else np.full(len(rows), np.inf)
        return failed, depth, ~failed & (depth >= self.cut)


def _measured(texts: list[str | None]) -> pd.DataFrame:
    return pd.DataFrame([text_statistics(t) for t in texts], columns=COUNTS + MORE, dtype=np.int64)


def _given(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def quality_verdicts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, COUNTS, base_failed, depth, kept) of every document; one pass over the texts, which are not shuffled."""
    measured = staged(rule_statistics(_given(docs, id_col, text_col)))
    shared = docs.sparkSession.sparkContext.broadcast(QualityModel.learned(measured, labels))

    def judge(columns: dict[str, list]) -> dict[str, list]:
        rows = pd.DataFrame({c: columns[c] for c in COUNTS + MORE}, dtype=np.int64)
        failed, depth, kept = shared.value.verdicts(rows)
        return {"doc_id": columns["doc_id"], **{c: rows[c] for c in COUNTS}, "base_failed": failed, "depth": depth, "kept": kept}

    counts = ", ".join(f"{c} long" for c in COUNTS)
    return map_arrow(measured, judge, f"doc_id long, {counts}, base_failed boolean, depth double, kept boolean", VERDICTS)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that the verdict keeps, with the columns of ``docs``: a filter, so no text is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(QualityModel.fit(docs, labels, id_col, text_col))

    @F.pandas_udf("boolean")
    def good(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.verdicts(_measured(texts.tolist()))[2])

    small_batches(docs.sparkSession)
    return docs.where(good(F.col(text_col)))
