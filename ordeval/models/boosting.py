"""Softmax boosting of several classes with native categories and missing values (survey M08, M08b, M10, M12).

A round grows one tree for each class, level by level. For a level, tasks add up gradients, Hessians and rows by (class,
node, feature, bin) of their rows and Spark adds up the tasks: the driver gets a table whose size is set by parameters
alone and picks the best split of each node. Rows are binned and written once, rows of equal bins, target, weight and role
as one with their number, as all that a round computes is the same for them; every SETTLED rounds their margins are written
anew, so a task applies only the trees since then.

* A split sends a set of bins to the left. Numbers have bins of ranges and the set is a prefix; categories are put in order
  of gradient over Hessian at each node, and the set is a prefix of that order. Missing values and levels that training
  hasn't seen share bin 0, which takes the better side.
* Gradients are rounded to fixed-point integers and summed exactly, so the model doesn't depend on partitions, on the
  order of rows, or on a lost task. Ties go to the lower feature, then to the earlier split.
* Fitting stops when the validation rows' loss hasn't fallen for ``patience`` rounds. The losses come with the first
  sums of the next round, without a scan of their own.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ordeval.models.attribution import Leaf
from ordeval.operators import metrics, ranks, windows
from ordeval.sources.documents import read_document, write_document
from ordeval.sources.shared import new_path

CLASSES = 3
#: Bins of a feature, bin 0 for missing among them.
BINS = 64
#: Fixed-point unit of gradients and Hessians; sums are exact in decimals.
UNIT = 1 << 24
SETTLED = 10
TRAIN, VALIDATION = 1, 0


@dataclass(frozen=True)
class Params:
    """A candidate: depth and size of trees, step, and what keeps leaves from being small."""

    depth: int = 3
    step: float = 0.1
    l2: float = 1.0
    min_rows: int = 20
    min_gain: float = 1e-6


@dataclass
class Tree:
    """Nodes in order of creation. A split node has a feature, the bins that go left, and children; a leaf has a value."""

    feature: list[int] = field(default_factory=lambda: [-1])
    left_bins: list[list[int]] = field(default_factory=lambda: [[]])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])
    rows: list[int] = field(default_factory=lambda: [0])

    def split(self, node: int, feature: int, bins: list[int]) -> tuple[int, int]:
        self.feature[node], self.left_bins[node] = feature, bins
        self.left[node], self.right[node] = len(self.feature), len(self.feature) + 1
        for _ in range(2):
            for column, empty in ((self.feature, -1), (self.left_bins, []), (self.left, -1), (self.right, -1), (self.value, 0.0), (self.rows, 0)):
                column.append(empty)
        return self.left[node], self.right[node]

    def nodes_of(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row of bins."""
        at = np.zeros(len(bins), np.int64)
        feature, left, right = np.array(self.feature), np.array(self.left), np.array(self.right)
        goes = np.zeros((len(feature), BINS), bool)
        for node, own in enumerate(self.left_bins):
            goes[node, own] = True
        while True:
            inner = np.flatnonzero(feature[at] >= 0)
            if not len(inner):
                return at
            here = at[inner]
            at[inner] = np.where(goes[here, bins[inner, feature[here]]], left[here], right[here])


@dataclass
class Boosted:
    """Rounds of one tree for each class on top of the classes' log shares, and how features are binned."""

    features: list[str]
    categories: dict[str, list[str]]
    cuts: dict[str, list[float]]
    start: list[float]
    rounds: list[list[Tree]]
    losses: list[tuple[float, float]]
    best: int
    params: Params

    def digest(self) -> str:
        """The name of the model's content."""
        return hashlib.sha256(self.text().encode()).hexdigest()

    def text(self) -> str:
        """The model as a document; :meth:`read` gets it back."""
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def read(cls, text: str) -> Boosted:
        given = json.loads(text)
        for kind in ("categories", "cuts"):  # in the order of the features, which is that of the bins
            given[kind] = {f: given[kind][f] for f in given["features"] if f in given[kind]}
        given["rounds"] = [[Tree(**t) for t in trees] for trees in given["rounds"]]
        given["losses"] = [tuple(x) for x in given["losses"]]
        return cls(**{**given, "params": Params(**given["params"])})

    def margins(self, bins: np.ndarray, rounds: int | None = None) -> np.ndarray:
        """Raw scores with the first ``rounds`` rounds; by default up to the best one."""
        return added(np.tile(np.array(self.start), (len(bins), 1)), bins, self.rounds[: self.best if rounds is None else rounds])


def added(margins: np.ndarray, bins: np.ndarray, rounds: Sequence[Sequence[Tree]]) -> np.ndarray:
    """``margins`` and the trees' values of ``rounds``."""
    for trees in rounds:
        for k, tree in enumerate(trees):
            margins[:, k] += np.array(tree.value)[tree.nodes_of(bins)]
    return margins


def softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fixed_point(margins: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients and Hessians of the weighted softmax loss, in units of 1 / UNIT."""
    p = softmax(margins)
    k = margins.shape[1]
    g = weight[:, None] * (p - (target[:, None] == np.arange(k)))
    h = weight[:, None] * p * (1 - p) * (k / (k - 1))
    return np.rint(g * UNIT).astype(np.int64), np.rint(h * UNIT).astype(np.int64)


def binned(df: DataFrame, model_bins: tuple[dict[str, list[str]], dict[str, list[float]]]) -> Column:
    """The bins of a row's features as an array: 0 is missing, unseen or NaN."""
    categories, cuts = model_bins
    out = []
    for c, levels in categories.items():
        known = F.create_map(*[x for i, v in enumerate(levels) for x in (F.lit(v), F.lit(i + 1))]) if levels else None
        out.append(F.coalesce(F.try_element_at(known, F.col(c).cast("string")), F.lit(0)) if levels else F.lit(0))
    for c, edges in cuts.items():
        x = F.col(c).cast("double")
        above = F.lit(1)
        for e in edges:
            above = above + (x > e).cast("int")
        out.append(F.when(x.isNull() | F.isnan(x), 0).otherwise(above))
    return F.array(*[c.cast("int") for c in out])


def fitted_bins(train: DataFrame, categorical: Sequence[str], numeric: Sequence[str]) -> tuple[dict[str, list[str]], dict[str, list[float]]]:
    """Levels of categories, the most frequent ones if there are more than bins, and cuts of numbers at exact quantiles."""
    categories, cuts = {}, {}
    for c in categorical:
        found = train.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("level")).agg(F.count("*").alias("n"))
        top = found.orderBy(F.desc("n"), "level").limit(BINS - 1).collect()
        categories[c] = sorted(r["level"] for r in top)
    for c in numeric:
        x = F.col(c).cast("double")
        counts = ranks.value_counts(train.select(F.lit(0).alias("one"), F.when(~F.isnan(x), x).alias("value")).where("value IS NOT NULL"), "value", "one")
        bucket = F.floor(F.col("before") * (BINS - 1) / F.col("total"))
        edges = counts.groupBy(bucket.alias("bucket")).agg(F.max("value").alias("edge")).orderBy("edge").collect()  # a row for each bin
        cuts[c] = [r["edge"] for r in edges[:-1]]
    return categories, cuts


def best_split(g: np.ndarray, h: np.ndarray, n: np.ndarray, categorical: bool, params: Params) -> tuple[float, list[int]] | None:
    """The best set of bins for the left child, from sums by bin in fixed point: (gain, bins)."""
    l2 = params.l2
    score = lambda a, b: a * a / (b + l2)
    present = [b for b in range(1, len(n)) if n[b]]
    if categorical:
        present.sort(key=lambda b: (g[b] / (h[b] + UNIT * l2), b))
    whole = (int(g.sum()), int(h.sum()), int(n.sum()))
    if not whole[2]:
        return None
    none = score(whole[0] / UNIT, whole[1] / UNIT)
    best = None
    for missing_left in (False, True) if n[0] else (False,):
        sums = [int(g[0]), int(h[0]), int(n[0])] if missing_left else [0, 0, 0]
        for i in range(len(present) - (0 if n[0] and not missing_left else 1)):
            b = present[i]
            sums = [sums[0] + int(g[b]), sums[1] + int(h[b]), sums[2] + int(n[b])]
            rest = [w - s for w, s in zip(whole, sums, strict=True)]
            if min(sums[2], rest[2]) < params.min_rows:
                continue
            gain = score(sums[0] / UNIT, sums[1] / UNIT) + score(rest[0] / UNIT, rest[1] / UNIT) - none
            if gain > params.min_gain and (best is None or gain > best[0]):
                # bins that the node doesn't hold go right; bin 0 too, if nothing is missing here
                best = (gain, sorted([*([0] if missing_left else []), *present[: i + 1]]))
    return best


SUMS = pa.schema([("k", pa.int32()), ("node", pa.int32()), ("feature", pa.int32()), ("bin", pa.int32())] + [(c, pa.int64()) for c in ("g", "h", "n")])
#: The feature number of the rows that carry losses: node 1 for training rows, 0 for validation rows.
LOSS = -1


def level_sums(rows: DataFrame, pending: list[list[Tree]], growing: list[Tree], open_nodes: list[list[int]], with_loss: bool) -> dict:
    """Sums of the training rows by (class, node, feature, bin) for the open nodes, and the losses if asked for."""
    width = max((max(nodes, default=-1) for nodes in open_nodes), default=-1) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, loss = None, np.zeros((2, 2))
        for b in batches:
            if not b.num_rows:
                continue
            bins, margins, target, weight, training, n = _columns(b)
            margins = added(margins, bins, pending)
            if with_loss:
                mine = -np.log(np.maximum(softmax(margins)[np.arange(len(target)), target], 1e-15))
                for role in (VALIDATION, TRAIN):
                    w = (weight * n)[training == role]
                    loss[role] += [(mine[training == role] * w).sum(), w.sum()]
            if not width:
                continue
            some = training == TRAIN
            bins = bins[some]
            n = n[some]
            g, h = fixed_point(margins[some], target[some], weight[some])
            g, h = g * n[:, None], h * n[:, None]
            n_features = bins.shape[1]
            if total is None:
                total = np.zeros((len(growing), 3, width, n_features, BINS), np.int64)
            for k, (tree, nodes) in enumerate(zip(growing, open_nodes, strict=True)):
                at = tree.nodes_of(bins)
                held = np.flatnonzero(np.isin(at, nodes))
                for f in range(n_features):
                    cell = at[held] * BINS + bins[held, f]
                    for j, values in enumerate((g[held, k], h[held, k], n[held])):  # whole numbers, which floats would round
                        sums = np.zeros(width * BINS, np.int64)
                        np.add.at(sums, cell, values)
                        total[k, j, :, f] += sums.reshape(width, BINS)
        if total is not None:
            k, node, f, b_ = np.nonzero(total[:, 2])
            columns = [k, node, f, b_]
            values = [total[k, j, node, f, b_] for j in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)) for c in columns] + [pa.array(v) for v in values], schema=SUMS)
        if with_loss:
            fixed = np.rint(loss * UNIT).astype(np.int64)
            role = np.arange(2, dtype=np.int32)
            same = np.full(2, LOSS, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (same, role, same, same, fixed[:, 0], fixed[:, 1], np.ones(2, np.int64))], schema=SUMS)

    big = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    found = rows.mapInArrow(run, "k int, node int, feature int, bin int, g long, h long, n long").groupBy("k", "node", "feature", "bin").agg(*map(big, "ghn"))
    return {(r["k"], r["node"], r["feature"], r["bin"]): (int(r["g"]), int(r["h"]), int(r["n"])) for r in found.collect()}


def _columns(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Bins, margins, target, weight, role and number of a batch of written rows."""
    matrix = lambda i, t: b.column(i).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(t)
    flat = lambda i, t: b.column(i).to_numpy(zero_copy_only=False).astype(t)
    return matrix(0, np.int64), matrix(1, float), flat(2, np.int64), flat(3, float), flat(4, np.int64), flat(5, np.int64)


def _settled(rows: DataFrame, pending: list[list[Tree]]) -> DataFrame:
    """The rows with the margins of ``pending`` added, written."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bins, margins, *_ = _columns(b)
            margins = added(margins, bins, pending)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(margins.tolist(), pa.list_(pa.float64())), *b.columns[2:]], names=b.schema.names)

    schema = "bins array<int>, margins array<double>, target int, weight double, training int, n long"
    path = new_path(rows.sparkSession, "margins")
    (rows.mapInArrow(run, schema) if pending else rows).write.parquet(path)
    return rows.sparkSession.read.schema(schema).parquet(path)


def grown(rows: DataFrame, pending: list[list[Tree]], n_features: int, categorical: int, params: Params, classes: int) -> tuple[list[Tree], dict]:
    """One tree for each class, and the sums of the first level with the losses before it."""
    trees, open_nodes, first = [Tree() for _ in range(classes)], [[0] for _ in range(classes)], {}
    for level in range(params.depth):
        sums = level_sums(rows, pending, trees, open_nodes, with_loss=level == 0)
        first = first or sums
        for k, tree in enumerate(trees):
            opened = []
            for node in open_nodes[k]:
                table = np.zeros((3, n_features, BINS), object)
                for f in range(n_features):
                    for b in range(BINS):
                        if (cell := sums.get((k, node, f, b))) is not None:
                            table[:, f, b] = cell
                if not level:
                    _set_leaf(tree, node, table[:, 0].sum(axis=1), params)
                found = [best_split(*table[:, f], f < categorical, params) for f in range(n_features)]
                f = max(range(n_features), key=lambda f: (found[f][0] if found[f] else 0.0, -f))
                if found[f] is None:
                    continue
                left, right = tree.split(node, f, found[f][1])
                mine = table[:, f][:, found[f][1]].sum(axis=1)
                _set_leaf(tree, left, mine, params)
                _set_leaf(tree, right, table[:, f].sum(axis=1) - mine, params)
                opened += [left, right]
            open_nodes[k] = opened
        if not any(open_nodes):
            break
    return trees, first


def _set_leaf(tree: Tree, node: int, sums: np.ndarray, params: Params) -> None:
    g, h, n = (int(v) for v in sums)
    tree.value[node], tree.rows[node] = -params.step * (g / UNIT) / (h / UNIT + params.l2), n


def _losses(sums: dict) -> tuple[float, float]:
    """Mean loss of the training and of the validation rows."""
    mean = lambda role: (lambda s: s[0] / s[1] if s[1] else math.nan)(sums.get((LOSS, role, LOSS, LOSS), (0, 0, 0)))
    return mean(TRAIN), mean(VALIDATION)


def written_rows(
    train: DataFrame, validation: DataFrame | None, bins: tuple, start: Sequence[float], weights: dict[int, float], target: str
) -> DataFrame:
    """Different binned rows with margins and how many there are of each, written once; validation rows weigh 1."""
    margin = F.array(*[F.lit(float(v)) for v in start])
    of_class = F.create_map(*[x for k, w in weights.items() for x in (F.lit(k), F.lit(float(w)))])
    part = lambda df, w, role: df.select(binned(df, bins).alias("bins"), F.col(target).cast("int").alias("target"), w.alias("weight"), F.lit(role).alias("training"))
    rows = part(train, F.try_element_at(of_class, F.col(target).cast("int")), TRAIN)
    if validation is not None:
        rows = rows.unionByName(part(validation, F.lit(1.0), VALIDATION))
    counted = rows.groupBy("bins", "target", "weight", "training").agg(F.count("*").alias("n"))
    return _settled(counted.select("bins", margin.alias("margins"), "target", "weight", "training", "n"), [])


def fit(
    train: DataFrame, validation: DataFrame | None, categorical: Sequence[str], numeric: Sequence[str], params: Params = Params(), target: str = "target",
    cap: int = 1200, patience: int = 75, balanced: bool = True, classes: int = CLASSES,
) -> Boosted:
    """Rounds until ``cap``, or until the validation loss hasn't fallen for ``patience`` rounds.

    Classes weigh by their balance (A17). Without validation rows all rounds count.
    """
    bins = fitted_bins(train, categorical, numeric)
    counts = {r[0]: r[1] for r in train.groupBy(F.col(target).cast("int")).agg(F.count("*")).collect()}  # a row for each class
    if set(counts) != set(range(classes)):
        raise ValueError(f"training rows must have the classes 0 to {classes - 1} and no others: {sorted(counts, key=str)}")
    total = sum(counts.values())
    weights = {k: total / (classes * n) if balanced else 1.0 for k, n in counts.items()}
    mass = sum(weights[k] * n for k, n in counts.items())
    start = [math.log(weights[k] * counts[k] / mass) for k in range(classes)]
    rows = written_rows(train, validation, bins, start, weights, target)
    rounds: list[list[Tree]] = []
    losses: list[tuple[float, float]] = []
    settled = 0
    while len(rounds) < cap:
        trees, first = grown(rows, rounds[settled:], len(categorical) + len(numeric), len(categorical), params, classes)
        losses.append(_losses(first))  # of the rounds before
        best = _best(losses)
        if validation is not None and len(losses) - 1 - best >= patience:
            break
        rounds.append(trees)
        if len(rounds) - settled >= SETTLED:
            rows, settled = _settled(rows, rounds[settled:]), len(rounds)
    if len(losses) == len(rounds):
        losses.append(_losses(level_sums(rows, rounds[settled:], [], [], with_loss=True)))
    best = _best(losses) if validation is not None else len(rounds)
    return Boosted([*categorical, *numeric], *bins, start, rounds, losses, best, params)


def _best(losses: list[tuple[float, float]]) -> int:
    """The number of rounds with the least validation loss, the smaller of equals."""
    valid = [v if not math.isnan(v) else math.inf for _, v in losses]
    return min(range(len(valid)), key=lambda i: (valid[i], i))


def scored(model: Boosted, rows: DataFrame, rounds: int | None = None) -> DataFrame:
    """Rows with ``bins``, ``margin``, ``prob`` and ``predicted_code`` (ties to the lower class)."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # its size is set by rounds and depth

    @F.pandas_udf("array<double>")
    def margin(bins):  # noqa: ANN001, ANN202
        m = shared.value.margins(np.stack(bins.to_numpy()).astype(np.int64), rounds) if len(bins) else np.zeros((0, 1))
        return type(bins)(list(m))

    top = F.array_max("margin")
    shifted = F.transform("margin", lambda x: F.exp(x - top))
    sum_ = F.aggregate(shifted, F.lit(0.0), lambda a, y: a + y)
    out = rows.withColumn("bins", binned(rows, (model.categories, model.cuts))).withColumn("margin", margin("bins"))
    return out.withColumns({"prob": F.transform(shifted, lambda x: x / sum_), "predicted_code": (F.array_position("margin", top) - 1).cast("int")})


def seal_model(spark: SparkSession, model: Boosted, folder: str) -> str:
    """Write a model and then its seal, the digest of what was written; a model that is sealed stays."""
    if read_document(spark, f"{folder}/seal.json") is not None:
        raise FileExistsError(f"there is a sealed model in {folder}")
    write_document(spark, f"{folder}/model.json", model.text())
    write_document(spark, f"{folder}/seal.json", json.dumps({"model_sha256": model.digest()}))
    return model.digest()


def sealed_model(spark: SparkSession, folder: str) -> Boosted:
    """The sealed model; an error if there is no seal, or the model isn't the one that was sealed."""
    seal, text = read_document(spark, f"{folder}/seal.json"), read_document(spark, f"{folder}/model.json")
    if seal is None or text is None:
        raise PermissionError(f"no sealed model in {folder}")
    if hashlib.sha256(text.encode()).hexdigest() != json.loads(seal)["model_sha256"]:
        raise ValueError(f"the model in {folder} is not the one that was sealed")
    return Boosted.read(text)


def scored_after_seal(spark: SparkSession, folder: str, rows: DataFrame) -> DataFrame:
    """The only way of a study to its test rows: the model is read from its seal, not handed over."""
    return scored(sealed_model(spark, folder), rows)


def search(
    train: DataFrame, validation: DataFrame, candidates: dict[str, Params], categorical: Sequence[str], numeric: Sequence[str], base_qwk: float, base_recall: float,
    target: str = "target", cap: int = 1200, extended: int = 2000, patience: int = 75,
) -> tuple[str, Boosted, DataFrame]:
    """(winner, its model, validation metrics of each candidate). A winner whose best round is the cap is
    fitted once more with ``extended`` rounds, takes its own place, and the winner is chosen again."""

    def tried(name: str, most: int) -> tuple[Boosted, DataFrame]:
        model = fit(train, validation, categorical, numeric, candidates[name], target, most, patience)
        named = scored(model, validation).select(F.lit(name).alias("candidate"), F.col(target).alias("true_code"), "predicted_code")
        row = metrics.metrics(metrics.confusion_counts(named, ["candidate"]), ["candidate"]).first()  # one row
        return model, train.sparkSession.createDataFrame([row]).withColumns({"complexity": F.lit(model.best), "cap": F.lit(most)})

    found = {name: tried(name, cap) for name in candidates}

    def winner() -> tuple[str, DataFrame]:
        table = None
        for _, own in found.values():
            table = own if table is None else table.unionByName(own)
        return windows.select_candidate(table, base_qwk, base_recall).first()["candidate"], table

    best, table = winner()
    if found[best][0].best == cap < extended:
        found[best] = tried(best, extended)
        best, table = winner()
    return best, found[best][0], table


def leaves(model: Boosted) -> list[Leaf]:
    """The leaves of the rounds up to the best, each with its value for its class, and by feature the share of its
    parents' rows and the bins that lead to it; missing values are bin 0 like others."""
    out = []
    for trees in model.rounds[: model.best]:
        for k, tree in enumerate(trees):
            def walk(node: int, path: list[tuple[int, float, tuple]]) -> None:
                if tree.feature[node] < 0:
                    grouped: dict[int, tuple[float, list]] = {}
                    for f, share, test in path:
                        before, tests = grouped.get(f, (1.0, []))
                        grouped[f] = (before * share, [*tests, test])
                    value = np.zeros(len(trees))
                    value[k] = tree.value[node]
                    out.append(Leaf(value, list(grouped), [g[0] for g in grouped.values()], [g[1] for g in grouped.values()]))
                    return
                bins = np.array(tree.left_bins[node], float)
                for child, goes_left in ((tree.left[node], True), (tree.right[node], False)):
                    walk(child, [*path, (tree.feature[node], tree.rows[child] / tree.rows[node], (True, bins, goes_left))])

            walk(0, [])
    return out
