"""Bootstrap of means down a tree, ordered logit by likelihood, softmax boosting: against plain versions on small rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ordeval.functions.columns import UNSEEN
from ordeval.models import attribution, boosting, fit, ordinal, stability
from ordeval.operators import means

# --- R11 -----------------------------------------------------------------------------------------------------------


def one_task_means(rows, keys, values, iterations, seed, leaf):
    """The same tree, one node after the other in one process: (keys, iteration) -> means."""
    import hashlib

    out, groups = {}, {}
    for r in rows:
        groups.setdefault((*(r[k] for k in keys), r["stratum"]), []).append(r)
    for name, own in groups.items():
        depth = math.ceil(math.log2(max(len(own) / leaf, 1)))
        for r in own:
            r["leaf"] = int(hashlib.md5(str(r["id"]).encode()).hexdigest()[:8], 16) >> (32 - depth) if depth else 0
        for block in range(-(-iterations // means.BLOCK)):
            n = min(means.BLOCK, iterations - block * means.BLOCK)

            def down(level, node, given, rows_, block=block, name=name, depth=depth, n=n):
                if not rows_:
                    assert not given.any()
                    return np.zeros((n, len(values)))
                if level == depth:
                    rows_ = sorted(rows_, key=lambda r: (r["id"], *(r[v] for v in values)))
                    x = np.array([[r[v] for v in values] for r in rows_], float)
                    return means.sums_in_leaf((seed, *name), node, depth, block, given, x)
                left = [r for r in rows_ if not r["leaf"] >> (depth - level - 1) & 1]
                right = [r for r in rows_ if r["leaf"] >> (depth - level - 1) & 1]
                to_left = means.node_rng(seed, *name, level, node, block).binomial(given, len(left) / len(rows_))
                return down(level + 1, 2 * node, to_left, left) + down(level + 1, 2 * node + 1, given - to_left, right)

            sums = down(0, 0, np.full(n, len(own), np.int64), own)
            for i in range(n):
                at = (*name[:-1], block * means.BLOCK + i)
                out[at] = out.get(at, 0) + sums[i]
    sizes = {}
    for name, own in groups.items():
        sizes[name[:-1]] = sizes.get(name[:-1], 0) + len(own)
    return {at: v / sizes[at[:-1]] for at, v in out.items()}


def test_tree_bootstrap_equals_one_task(spark):
    rng = random.Random(11)
    rows = [{"id": i, "cohort": rng.choice("ab"), "stratum": rng.choice([0, 0, 0, 0, 1, 2]), "v": rng.gauss(0, 1), "w": rng.random()} for i in range(900)]
    rows += [{"id": 5000 + i, "cohort": "tiny", "stratum": i, "v": 1.0 * i, "w": 0.0} for i in range(3)]
    df = spark.createDataFrame([(r["id"], r["cohort"], r["stratum"], r["v"], r["w"]) for r in rows], "id long, cohort string, stratum int, v double, w double")
    want = one_task_means(rows, ["cohort"], ["v", "w"], 300, 9, 32)
    for parts in (1, 7):
        got = means.bootstrap_means(df.repartition(parts), ["cohort"], "stratum", ["v", "w"], 300, 9, leaf=32).collect()
        assert len(got) == 900
        for r in got:
            assert np.allclose([r["v"], r["w"]], want[r["cohort"], r["iteration"]], atol=1e-12)
    tiny = [r["v"] for r in got if r["cohort"] == "tiny"]
    assert set(tiny) == {1.0}  # one row a stratum: every draw takes it


def test_tree_bootstrap_has_the_spread_of_a_mean(spark):
    """The draws' means and spread are those of the bootstrap, and leaves don't change that."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=2000)
    df = spark.createDataFrame([(i, i % 2, float(v)) for i, v in enumerate(x)], "id long, stratum int, v double")
    within = np.mean([np.var(x[k::2]) for k in (0, 1)])
    for leaf in (50, 5000):
        got = np.array([r["v"] for r in means.bootstrap_means(df, [], "stratum", ["v"], 2000, 3, leaf=leaf).collect()])
        assert len(got) == 2000 and abs(got.mean() - x.mean()) < 0.003
        assert got.std() == pytest.approx(math.sqrt(within / 2000), rel=0.08)


# --- M03, M09 ------------------------------------------------------------------------------------------------------


def ordinal_rows(spark, n, seed=5):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        c, d, x = rng.integers(0, 4), rng.integers(0, 3), rng.normal()
        u = 0.8 * c - 0.5 * (d == 2) + 0.7 * x + rng.logistic()
        rows.append((i, f"c{c}", f"d{d}", f"half{c // 2}", float(x), 2 * float(x) - 1, int(u > 1) + int(u > 3)))
    return spark.createDataFrame(rows, "id long, c string, d string, half string, x double, twice double, target int")


def test_planted_collinear_columns_are_dropped(spark):
    train = ordinal_rows(spark, 600)
    columns = ordinal.reference_columns(train, ["c", "d", "half"], ["x", "twice"])
    assert columns.references == {"c": "c0", "d": "d0", "half": "half0"}
    assert columns.dependent == ["half=half1", "twice"]
    assert columns.unidentified == [f"{c}={UNSEEN}" for c in ("c", "d", "half")]
    assert [n for n, *_ in columns.kept] == ["c=c1", "c=c2", "c=c3", "d=d1", "d=d2", "x"]
    fate = {r["name"]: r["fate"] for r in ordinal.dropped_table(spark, columns).collect()}
    assert fate["c=c0"] == "reference" and fate["twice"] == "dependent" and len(fate) == 14
    x = columns.encode(spark.createDataFrame([(1, "never", "d2", "half0", None, None, 0)], train.schema)).first()["x"]
    assert x[:5] == [0, 0, 0, 0, 1]
    products = np.array([[3.0, 3, 0], [3, 3, 0], [0, 0, 0]])
    assert ordinal.dependent_columns(products) == ([1], [0])  # a constant column, an empty column


def test_ordinal_gradient_equals_finite_differences():
    rng = np.random.default_rng(8)
    x, y, w = rng.normal(size=(60, 3)), rng.integers(0, 3, 60), rng.random(60) + 0.2
    at = np.array([-0.4, 0.9, 0.3, -0.7, 0.1])
    value = lambda v: ordinal.row_terms(x, y, w, v[:2], v[2:])[0]
    first = lambda v: ordinal.row_terms(x, y, w, v[:2], v[2:])[1]
    _, gradient, hessian = ordinal.row_terms(x, y, w, at[:2], at[2:])
    for i, e in enumerate(np.eye(5) * 1e-6):
        assert gradient[i] == pytest.approx((value(at + e) - value(at - e)) / 2e-6, abs=1e-5)
        assert np.allclose(hessian[i], (first(at + e) - first(at - e)) / 2e-6, atol=1e-4)
    a = np.array([-0.4, 0.3])
    stepped = lambda v: ordinal.row_terms(x, y, w, ordinal._thresholds(v[:2]), v[2:])
    point = np.concatenate([a, at[2:]])
    g, h = ordinal._by_steps(a, *stepped(point)[1:])
    for i, e in enumerate(np.eye(5) * 1e-6):
        assert g[i] == pytest.approx((stepped(point + e)[0] - stepped(point - e)[0]) / 2e-6, abs=1e-5)
        ahead, behind = (ordinal._by_steps((point + s * e)[:2], *stepped(point + s * e)[1:])[0] for s in (1, -1))
        assert np.allclose(h[i], (ahead - behind) / 2e-6, atol=1e-4)
    far = ordinal.row_terms(np.array([[40.0], [-40.0]]), np.array([0, 2]), np.ones(2), np.array([0.0, 1.0]), np.array([1.0]))
    assert far[0] == pytest.approx(-81.0, abs=1e-6) and np.isfinite(far[1]).all() and np.isfinite(far[2]).all()


def test_ordered_logit_is_the_maximum(spark):
    train = ordinal_rows(spark, 3000)
    columns = ordinal.reference_columns(train, ["c", "d", "half"], ["x", "twice"])
    encoded = columns.encode(train).cache()
    model = ordinal.fit_ordered(encoded)
    assert model.score < 1e-8 and model.thresholds[0] < model.thresholds[1]
    slopes = dict(zip([n for n, *_ in columns.kept], model.slopes, strict=True))
    assert slopes["c=c3"] == pytest.approx(2.4, abs=0.35) and slopes["d=d2"] == pytest.approx(-0.5, abs=0.25)
    from pyspark.ml.functions import array_to_vector

    stacked = fit.ordered_logit(encoded.withColumn("features", array_to_vector("x")))
    other = ordinal.likelihood(encoded, np.array(stacked[1]), np.array(stacked[0]))[0]
    assert model.log_likelihood >= other
    for i in range(len(model.slopes)):  # no better neighbour
        for step in (-1e-3, 1e-3):
            near = np.array(model.slopes)
            near[i] += step
            assert ordinal.likelihood(encoded, np.array(model.thresholds), near)[0] < model.log_likelihood
    again = ordinal.fit_ordered(encoded.repartition(9))
    assert np.allclose(again.slopes, model.slopes, atol=1e-7)
    with pytest.raises(ValueError, match="classes"):
        ordinal.fit_ordered(encoded.where("target < 2"))


# --- M08, M08b, M10, M12 -------------------------------------------------------------------------------------------


def boosting_rows(spark, n, seed=6, noise=1.0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        c, x, z = f"c{rng.integers(0, 6)}", rng.normal(), rng.normal()
        score = {"c0": 2, "c1": -1, "c2": 0, "c3": 2, "c4": -2, "c5": 0}[c] + x + noise * rng.normal()
        rows.append((i, c if rng.random() > 0.1 else None, float(x) if rng.random() > 0.2 else None, float(z), int(score > 0.5) + int(score > 2)))
    return spark.createDataFrame(rows, "id long, c string, x double, z double, target int").repartition(3)


def plain_boost(bins, target, params, rounds, categorical):
    """A booster of loops over rows, by the same rules: margins after each round."""
    n, k = len(target), 3
    weight = np.array([n / (k * (target == c).sum()) for c in target])
    share = np.array([weight[target == c].sum() for c in range(k)]) / weight.sum()
    margins, unit = np.tile(np.log(share), (n, 1)), boosting.UNIT
    history = []
    for _ in range(rounds):
        step = np.zeros((n, k))
        p = np.exp(margins - margins.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        for c in range(k):
            g = [round(weight[i] * (p[i, c] - (target[i] == c)) * unit) for i in range(n)]
            h = [round(weight[i] * p[i, c] * (1 - p[i, c]) * 1.5 * unit) for i in range(n)]

            def total(rows, v):
                return sum(v[i] for i in rows) / unit

            def grow(rows, depth, c=c, g=g, h=h):
                score = lambda own: total(own, g) ** 2 / (total(own, h) + params.l2)
                best = None
                for f in range(bins.shape[1] if depth else 0):
                    present = sorted({bins[i, f] for i in rows} - {0})
                    if f < categorical:
                        of = {b: [i for i in rows if bins[i, f] == b] for b in present}
                        present.sort(key=lambda b: (total(of[b], g) / (total(of[b], h) + params.l2), b))
                    missing = any(bins[i, f] == 0 for i in rows)
                    for missing_left in (False, True) if missing else (False,):
                        for j in range(1, len(present) + 1):
                            bag = set(present[:j]) | ({0} if missing_left else set())
                            left = [i for i in rows if bins[i, f] in bag]
                            right = [i for i in rows if bins[i, f] not in bag]
                            if min(len(left), len(right)) < params.min_rows:
                                continue
                            gain = score(left) + score(right) - score(rows)
                            if gain > params.min_gain and (best is None or gain > best[0] + 1e-12):
                                best = (gain, left, right)
                if best is None:
                    for i in rows:
                        step[i, c] = -params.step * total(rows, g) / (total(rows, h) + params.l2)
                else:
                    grow(best[1], depth - 1)
                    grow(best[2], depth - 1)

            grow(list(range(n)), params.depth)
        margins = margins + step
        history.append(margins.copy())
    return history


def test_boosting_equals_a_plain_booster(spark):
    df = boosting_rows(spark, 500)
    params = boosting.Params(depth=3, step=0.3, min_rows=15)
    model = boosting.fit(df, None, ["c"], ["x", "z"], params, cap=4)
    rows = boosting.scored(model, df).orderBy("id").collect()
    bins, target = np.array([r["bins"] for r in rows]), np.array([r["target"] for r in rows])
    assert bins[:, 0].min() == 0 and bins[:, 1].min() == 0 and bins.max() <= 63
    history = plain_boost(bins, target, params, 4, 1)
    for rounds in range(1, 5):
        assert np.allclose(model.margins(bins, rounds), history[rounds - 1], atol=1e-9)
    assert np.allclose([r["margin"] for r in rows], history[-1], atol=1e-9)
    again = boosting.fit(df.repartition(7).orderBy("z"), None, ["c"], ["x", "z"], params, cap=4)
    assert again.digest() == model.digest()  # whatever the partitions and the order
    losses = [train for train, _ in model.losses]
    assert len(losses) == 5 and all(b < a for a, b in zip(losses, losses[1:], strict=False))


def test_boosting_stops_by_patience_and_extends_the_cap(spark):
    train, validation = boosting_rows(spark, 400, noise=3.0), boosting_rows(spark, 300, seed=77, noise=3.0)
    eager = boosting.Params(depth=4, step=1.0, min_rows=2, l2=0.1)
    model = boosting.fit(train, validation, ["c"], ["x", "z"], eager, cap=30, patience=3)
    valid = [v for _, v in model.losses]
    assert model.best < len(model.rounds) < 30 and len(model.rounds) == model.best + 3
    assert valid[model.best] == min(valid)
    unseen = boosting.scored(model, spark.createDataFrame([(1, "never", None, 0.0, 0)], train.schema)).first()
    assert unseen["bins"][:2] == [0, 0] and sum(unseen["prob"]) == pytest.approx(1)
    slow = boosting.Params(depth=1, step=0.05)
    best, chosen, table = boosting.search(train, validation, {"slow": slow}, ["c"], ["x"], 0.0, 0.0, cap=2, extended=4, patience=2)
    assert best == "slow" and len(chosen.rounds) == 4 and table.first()["cap"] == 4  # the cap was hit, so it was extended
    with pytest.raises(ValueError, match="classes"):
        boosting.fit(train.where("target > 0"), None, ["c"], ["x"], slow, cap=1)


def test_attributions_of_boosting_add_up_and_are_shapley(spark):
    df = boosting_rows(spark, 300)
    model = boosting.fit(df, None, ["c"], ["x", "z"], boosting.Params(depth=3, step=0.5, min_rows=10), cap=3)
    rows = boosting.scored(model, df).limit(40).collect()
    bins = np.array([r["bins"] for r in rows])
    phi, base = attribution.attribute(bins.astype(float), boosting.leaves(model))
    assert np.allclose(phi.sum(axis=1) + base + model.start, [r["margin"] for r in rows], atol=1e-9)

    def expected(tree, x, known, node=0):
        """The tree's value with only some features known: others weigh their children by rows."""
        if tree.feature[node] < 0:
            return tree.value[node]
        f, left, right = tree.feature[node], tree.left[node], tree.right[node]
        if f in known:
            return expected(tree, x, known, left if x[f] in tree.left_bins[node] else right)
        return sum(tree.rows[c] / tree.rows[node] * expected(tree, x, known, c) for c in (left, right))

    import itertools

    for x, own in zip(bins[:8], phi[:8], strict=True):
        for k in range(3):
            game = lambda known, k=k, x=x: sum(expected(trees[k], x, known) for trees in model.rounds)
            for f in range(3):
                value = 0.0
                for size in range(3):
                    for s in itertools.combinations([j for j in range(3) if j != f], size):
                        value += math.factorial(size) * math.factorial(2 - size) / 6 * (game({*s, f}) - game(set(s)))
                assert own[f, k] == pytest.approx(value, abs=1e-9)


def test_test_rows_wait_for_the_seal(spark, tmp_path):
    from ordeval.sources.documents import read_document, write_document

    df, folder = boosting_rows(spark, 200).withColumn("a", F.concat(F.lit("a"), F.col("id") % 3)), f"{tmp_path}/m"
    model = boosting.fit(df, df, ["c", "a"], ["z", "x"], boosting.Params(depth=2, min_rows=5), cap=2)
    with pytest.raises(PermissionError):
        boosting.scored_after_seal(spark, folder, df)
    assert boosting.seal_model(spark, model, folder) == model.digest()
    again = boosting.sealed_model(spark, folder)
    assert again == model and again.digest() == model.digest()
    scores = {r["id"]: r["margin"] for r in boosting.scored(model, df).collect()}
    assert {r["id"]: r["margin"] for r in boosting.scored_after_seal(spark, folder, df).collect()} == scores
    with pytest.raises(FileExistsError):
        boosting.seal_model(spark, model, folder)
    write_document(spark, f"{folder}/model.json", read_document(spark, f"{folder}/model.json").replace('"best": 2', '"best": 1'))
    with pytest.raises(ValueError, match="not the one"):
        boosting.sealed_model(spark, folder)


def test_attributions_go_on_after_a_break(spark, tmp_path, monkeypatch):
    df = boosting_rows(spark, 200)
    model = boosting.fit(df, None, ["c"], ["x"], boosting.Params(depth=2, min_rows=5), cap=2)
    rows = boosting.scored(model, df)
    real, calls = stability.margin_attributions, []

    def counted(*args):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("lost")
        return real(*args)

    monkeypatch.setattr(stability, "margin_attributions", counted)
    with pytest.raises(RuntimeError, match="lost"):
        stability.attributions_in_chunks(model, rows, str(tmp_path), 4)
    got = stability.attributions_in_chunks(model, rows, str(tmp_path), 4)
    assert len(calls) == 3 + 2 + 1  # two chunks were sealed; the last call is for the schema
    want = {r["id"]: r["phi"] for r in real(model, rows).collect()}
    assert {r["id"]: r["phi"] for r in got.collect()} == want and got.count() == 200
    stability.attributions_in_chunks(model, rows.where("id <> 7"), str(tmp_path), 4)
    assert len(calls) == 11  # other rows have chunks of their own


# --- A28, R11, M13 from M12 ----------------------------------------------------------------------------------------


def average_ranks(values):
    """Rank by descending value, ties sharing their mean."""
    return [sum(v > x for v in values) + (sum(v == x for v in values) + 1) / 2 for x in values]


def test_rank_stability_from_attributions(spark):
    df = boosting_rows(spark, 400).withColumn("cohort", F.when(F.col("id") % 3 == 0, "future").otherwise("internal"))
    model = boosting.fit(df, None, ["c"], ["x", "z"], boosting.Params(depth=2, step=0.5, min_rows=10), cap=2)
    attributed = stability.margin_attributions(model, boosting.scored(model, df), carry=["cohort", "target"]).cache()
    assert {r["class"]: r["largest"] <= 1e-9 for r in stability.additivity(attributed, model.features).collect()} == {0: True, 1: True, 2: True}
    rows = attributed.collect()
    points = {(r["cohort"], r["scope"], r["feature"]): r for r in stability.importance(attributed, model.features, ["cohort"]).collect()}
    assert len(points) == 2 * 4 * 3
    importance = {}
    for cohort in ("internal", "future"):
        phi = np.array([r["phi"] for r in rows if r["cohort"] == cohort]).reshape(-1, 3, 3)  # rows, features, classes
        mean_abs = np.abs(phi).mean(axis=0)
        for scope, values in [*((str(k), mean_abs[:, k]) for k in range(3)), ("overall", mean_abs.mean(axis=1))]:
            importance[cohort, scope] = values
            for f, name in enumerate(model.features):
                got = points[cohort, scope, name]
                assert got["mean_abs"] == pytest.approx(values[f]) and got["rank"] == average_ranks(values.tolist())[f]
                if scope != "overall":
                    own = phi[:, f, int(scope)]
                    assert got["mean_signed"] == pytest.approx(own.mean(), abs=1e-12) and got["median"] == pytest.approx(np.median(own), abs=1e-12)
                    assert [got["positive"], got["negative"], got["zero"]] == pytest.approx([(own > 0).mean(), (own < 0).mean(), (own == 0).mean()])
    draws = stability.importance_draws(attributed, model.features, 200, 5, "cohort", leaf=64).cache()
    assert draws.count() == 2 * 200 * 4 * 3
    by_draw = {}
    for r in draws.collect():
        by_draw.setdefault((r["iteration"], r["scope"]), {})[r["cohort"], r["feature"]] = r["value"]
    found = {r["scope"]: r for r in stability.rank_stability(stability.importance(attributed, model.features, ["cohort"]).withColumnRenamed("mean_abs", "value"), draws, "internal", "future").collect()}

    def rho(a, b):
        a, b = average_ranks(a), average_ranks(b)
        return None if len(set(a)) == 1 or len(set(b)) == 1 else float(np.corrcoef(a, b)[0, 1])

    for scope in ("0", "1", "2", "overall"):
        assert found[scope]["rho"] == pytest.approx(rho(importance["internal", scope].tolist(), importance["future", scope].tolist()))
        drawn = [rho([own["internal", f] for f in model.features], [own["future", f] for f in model.features]) for (_, s), own in by_draw.items() if s == scope]
        drawn = [r for r in drawn if r is not None]
        assert found[scope]["draws"] == len(drawn)
        assert [found[scope]["low"], found[scope]["high"]] == pytest.approx(np.quantile(drawn, [0.025, 0.975]).tolist())
