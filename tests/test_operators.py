"""Core operators: guards, kernels and invariants on toy frames."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordeval.functions import columns as C
from ordeval.models import attribution, fit
from ordeval.models.features import NumericScaler, encoder, fold_to_vocabulary, vocabulary, without_columns
from ordeval.operators import guards, joins, metrics, ranks, resample, splits, verify, windows
from ordeval.sources import readers, writers


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column).first()[0]


def test_codes_and_categories(spark):
    for raw, want in (("3.0", "3"), (" -1.00 ", "-1"), ("A1", "A1"), ("3.5", "3.5"), (None, None)):
        assert one(spark, C.normalize_code(F.col("x")), raw) == want
    assert one(spark, C.normalize_code(F.col("x"), keep_text=False), "A1") is None
    assert one(spark, C.canonical_category(F.col("x")), "") == C.SOURCE_MISSING
    assert one(spark, C.canonical_category(F.col("x")), "None") == "None"
    for bad in (" padded", C.UNSEEN):
        with pytest.raises(Exception, match="padded or reserved"):
            one(spark, C.canonical_category(F.col("x")), bad)
    with pytest.raises(Exception, match="outside the mapping"):
        one(spark, C.recode(F.col("x"), {"1": 2}), "7")
    with pytest.raises(Exception, match="not a number"):
        one(spark, C.checked_number(F.col("x")), "x")
    assert one(spark, C.checked_number(F.col("x")), " ") is None
    assert one(spark, C.parsed_date(F.col("x")), "32/01/2018") is None
    assert str(one(spark, C.parsed_date(F.col("x")), "31/01/2018")) == "2018-01-31"
    assert one(spark, C.hour_code(F.col("x")), "24:00") is None and one(spark, C.hour_code(F.col("x")), "07:59") == "H07"
    assert one(spark, C.plain_text(F.col("x")), "<b>a &amp; b</b>&nbsp;c") == "a & b c"
    with pytest.raises(Exception, match="no rule"):
        one(spark, C.classify(F.col("x"), [("^a", "A")]), "b")


def test_scalar_equality(spark):
    rows = [("1", "1.0", True), ("nan", "NaN", True), ("Infinity", "1", False), (None, None, True), ("a", "b", False), ("1", None, False), ("1", "1.00000000001", True)]
    got = spark.createDataFrame(rows, "a string, b string, want boolean").select(C.close(F.col("a"), F.col("b")).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in got)


def test_guards(spark):
    df = spark.createDataFrame([(1, "train"), (1, "test"), (2, "train"), (None, "test")], "id int, role string")
    assert guards.repeated_keys(df, "id").count() == 2
    with pytest.raises(guards.ContractError):
        guards.require(guards.shared_ids(df, "id", "role"), "roles overlap")
    p = spark.createDataFrame([(0.5, 0.5), (0.9, 0.2), (None, 1.0), (float("nan"), 1.0)], "a double, b double")
    assert guards.simplex_violations(p, ["a", "b"]).count() == 3
    assert {r["value"] for r in guards.domain_differences(df, "role", ["train", "other"]).collect()} == {"test", "other"}
    with pytest.raises(guards.ContractError):
        joins.one_to_one(df, df, ["id"])


def test_metrics_by_definition(spark):
    rng = random.Random(1)
    pairs = [(rng.choice([0, 0, 0, 1, 2]), rng.randrange(3)) for _ in range(500)]
    df = spark.createDataFrame([("g", *p) for p in pairs] + [("one", 0, 0)], "k string, true_code int, predicted_code int")
    got = {r["k"]: r for r in metrics.metrics(metrics.confusion_counts(df, ["k"]), ["k"]).collect()}
    c = np.zeros((3, 3))
    for t, p in pairs:
        c[t, p] += 1
    w = np.subtract.outer(np.arange(3), np.arange(3)) ** 2
    expected = np.outer(c.sum(1), c.sum(0)) / c.sum()
    g = got["g"]
    assert g["qwk"] == pytest.approx(1 - (w * c).sum() / (w * expected).sum())
    assert g["macro_f1"] == pytest.approx(np.mean([2 * c[i, i] / (c[i].sum() + c[:, i].sum()) for i in range(3)]))
    assert g["mean_asymmetric_cost"] == pytest.approx((np.array(C.COSTS) * c).sum() / c.sum())
    assert got["one"]["qwk"] == 1.0 and got["one"]["serious_or_worse_recall"] == 0.0


def test_published_weights(spark):
    counts = {0: 421745, 1: 108920, 2: 7796}
    n = sum(counts.values())
    assert [round(n / (3 * v), 5) for v in counts.values()] == [0.42558, 1.64788, 23.02296]
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 2 + [(2,)], "target int")
    assert {r["target"]: r["weight"] for r in metrics.class_weights(df, "target").collect()} == {0: 0.5, 1: 1.5, 2: 3.0}


def test_splits(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 7 == 0).cast("int").alias("target"), (F.col("id") % 10).alias("year"))
    got = splits.random_roles(df, 1103, "id", "target", F.col("year") == 9).collect()
    assert len(got) == 1000 and {r["role"] for r in got if r["year"] == 9} == {"locked_temporal_test"}
    for k in (0, 1):
        pool = [r["role"] for r in got if r["target"] == k and r["year"] != 9]
        assert abs(pool.count("train") - 0.7 * len(pool)) <= 0.5 and abs(pool.count("validation") - 0.15 * len(pool)) <= 1
    ranks = splits.rank_in_class(df, 5, "id", "target").select("target", "rank").collect()
    for k in (0, 1):
        own = sorted(r["rank"] for r in ranks if r["target"] == k)
        assert own == list(range(1, len(own) + 1))
    quota = splits.proportional_allocation(splits.class_sizes(df, "target"), "target", 101).collect()
    assert sum(r["quota"] for r in quota) == 101
    assert splits.stratified_sample(df, 101, 7, "id", "target").count() == 101
    with pytest.raises(Exception, match="no role"):
        df.select(splits.temporal_role(F.col("year"), [0], [1], [2])).collect()


def test_ranks_and_selection(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (3.0,), (2.0,)], "v double")
    assert sorted(r["rank"] for r in windows.average_rank(df, "v").collect()) == [1.5, 1.5, 3.0, 4.0]
    rows = [("a", 0.5, 0.30, 0.1, 1), ("b", 0.6, 0.10, 0.1, 1), ("c", 0.5, 0.30, 0.1, 0)]
    cand = spark.createDataFrame(rows, "candidate string, macro_f1 double, qwk double, recall_2 double, complexity int")
    assert windows.select_candidate(cand, 0.3, 0.1).first()["candidate"] == "c"
    assert windows.select_candidate(cand, 0.9, 0.1).first()["candidate"] == "b"


def test_ranks_and_quantiles_from_counts(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, float(rng.randrange(40)), rng.random()])) for _ in range(900)]
    rows += [("one", 2.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    counts = ranks.value_counts(df, "v", "k")
    got = {r["k"]: r for r in counts.groupBy("k").agg(*[ranks.quantile("v", p).alias(f"q{p}") for p in (0.0, 0.5, 0.9, 1.0)], ranks.mean("v").alias("mean")).collect()}
    for k in {r[0] for r in rows}:
        own = [v for key, v in rows if key == k and v is not None]
        for p in (0.0, 0.5, 0.9, 1.0):
            want = np.quantile(own, p) if own else None
            assert got[k][f"q{p}"] == (pytest.approx(want) if own else None)
        assert got[k]["mean"] == (pytest.approx(np.mean(own)) if own else None)
    ranked = ranks.average_rank(df, "v", "k").collect()
    assert len(ranked) == len(rows)
    for r in ranked:
        own = [v for key, v in rows if key == r["k"]]
        above = sum(v is not None and (r["v"] is None or v > r["v"]) for v in own)
        assert r["rank"] == above + (own.count(r["v"]) + 1) / 2
    assert ranks.value_counts(df.where("k = 'x'"), "v", "k").count() == 0
    placed = ranks.global_place(df.where("v IS NOT NULL").select("v").distinct(), [F.desc("v")]).collect()
    assert [r["v"] for r in sorted(placed, key=lambda r: r["place"])] == sorted({v for _, v in rows if v is not None}, reverse=True)


def test_cuts_equal_ranks(spark):
    df = spark.range(3000).select("id", (F.col("id") % 3).alias("target"))
    ranked = splits.rank_in_class(df, 9, "id", "target").collect()
    for quota in (0, 1, 250, 5000):
        quotas = df.select("target").distinct().withColumn("quota", F.lit(quota))
        got = {r["id"] for r in splits.quota_sample(df, quotas, 9, "id", "target").collect()}
        assert got == {r["id"] for r in ranked if r["rank"] <= quota}
    assert splits.random_roles(df.where("id < 0"), 9, "id", "target", F.lit(False)).count() == 0


def test_staged_boosting_and_search(spark):
    from pyspark.ml.functions import array_to_vector, vector_to_array

    df = spark.range(300).select("id", (F.col("id") % 3).cast("int").alias("target"), array_to_vector(F.array((F.col("id") % 3 + F.col("id") % 2).cast("double"), F.rand(1))).alias("features"))
    train, validation = df.where("id % 5 <> 0"), df.where("id % 5 = 0")
    models = fit.boosted_stopped(train, validation, cap=3, depth=2)
    whole = {r["id"]: r["prob"] for r in fit.staged(models, validation).collect()}
    raw = [{r["id"]: r["m"] for r in m.transform(validation).select("id", vector_to_array("rawPrediction")[1].alias("m")).collect()} for m in models]
    for i, prob in whole.items():
        e = np.exp([x[i] for x in raw])
        assert prob == pytest.approx(list(e / e.sum()))
    assert all(m.treeWeights[0] == 1.0 and len(m.trees) <= 3 for m in models)
    first = {r["id"]: r["prob"] for r in fit.staged(models, validation, 1).collect()}
    assert any(first[i] != whole[i] for i in whole) or all(len(m.trees) == 1 for m in models)
    best, chosen, table = fit.boosted_search(train, validation, {"a": {"depth": 1, "step": 0.5, "tol": 0.0}, "b": {"depth": 2, "step": 0.5, "tol": 0.0}}, -1.0, -1.0, cap=2, extended=3)
    assert best in ("a", "b") and table.count() == 2 and 1 <= max(len(m.trees) for m in chosen) <= 3


def test_json_differences(spark):
    a = [(1, '{"a": 1, "b": [1, {"c": "x"}], "t": 5}'), (2, '{"a": {}}'), (3, "[1, 2]"), (4, None), (5, '{"a": null}'), (6, '{"a.b": 1}')]
    b = [(1, '{"t": 6, "b": [1.0, {"c": "y", "d": 2}], "a": 1.00000000001}'), (2, '{"a": []}'), (3, "[1]"), (4, None), (5, '{"a": null}'), (6, '{"a": {"b": 1}}')]
    left, right = (spark.createDataFrame(x, "k int, j string") for x in (a, b))
    got = {(r["k"], r["path"], r["problem"]) for r in verify.json_differences(left, right, "k", "j", ignored=["t"]).collect()}
    assert got == {
        (1, '$["b"][1]["c"]', "different"), (1, '$["b"][1]["d"]', "extra"), (2, '$["a"]', "different"), (3, "$[1]", "missing"),
        (6, '$["a.b"]', "missing"), (6, '$["a"]["b"]', "extra"),
    }
    with pytest.raises(ValueError, match="deeper"):
        verify.json_differences(left, right, "k", "j", depth=1)


def test_bootstrap_invariants(spark):
    rows = [("g", t, p, p, n) for t in range(3) for p, n in ((t, 20 - 6 * t), ((t + 1) % 3, 5))]
    patterns = spark.createDataFrame(rows, "k string, t int, a int, b int, n long")
    got = resample.bootstrap_confusions(patterns, ["k"], "t", ["a", "b"], 300, 1).toPandas()
    a, b = (got[got.model == m].sort_values("iteration").drop(columns="model").reset_index(drop=True) for m in "ab")
    assert a.equals(b) and len(a) == 300  # equal models, equal draws
    for t in range(3):
        assert set(a[[f"c{t}{j}" for j in range(3)]].sum(axis=1)) == {20 - 6 * t + 5}
    assert a["c00"].mean() == pytest.approx(20, abs=0.5)
    again = resample.bootstrap_confusions(patterns, ["k"], "t", ["a", "b"], 300, 1).toPandas()
    assert again.sort_values(["model", "iteration"]).values.tolist() == got.sort_values(["model", "iteration"]).values.tolist()
    assert resample.stream_seed("a") != resample.stream_seed("b")


def test_prevalence_shift_vanishes(spark):
    df = spark.createDataFrame([("x", *map(float, (8, 2, 0, 1, 3, 1, 0, 1, 1))), ("y", *map(float, (80, 20, 0, 1, 3, 1, 0, 10, 10)))], "k string, " + ", ".join(f"c{i}{j} double" for i in range(3) for j in range(3)))
    ref = spark.createDataFrame([(0.7, 0.25, 0.05)], "r0 double, r1 double, r2 double")
    qwk = {r["k"]: r["qwk"] for r in metrics.metrics(metrics.standardised(df, ref), ["k"], ("qwk",)).collect()}
    assert qwk["x"] == pytest.approx(qwk["y"])


def test_table_differences(spark):
    a = spark.createDataFrame([(1, 1.0, "x", 5.0), (2, 2.0, "y", 5.0), (3, 3.0, "z", 5.0)], "k int, v double, t string, seconds double")
    b = spark.createDataFrame([(4, 1.0, "x", 0.0), (2, 2.0 + 1e-12, "Y", 0.0), (3, 3.5, "z", 0.0)], "k int, v double, t string, seconds double")
    got = {(r["k"], r["column"], r["problem"]) for r in verify.table_differences(a, b, ["k"], ignored=("seconds",)).collect()}
    assert got == {(1, None, "missing_key"), (4, None, "extra_key"), (2, "t", "different"), (3, "v", "different")}
    with pytest.raises(ValueError, match="columns differ"):
        verify.table_differences(a, b.drop("t"), ["k"])
    assert verify.content_hash(a).first() == verify.content_hash(a.repartition(3)).first()


def test_files(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("v", T.StringType())])
    df = spark.createDataFrame([("1", "None"), ("2", None), ("3", "NA")], schema)
    writers.write_csv(df, f"{tmp_path}/csv", gzip=True)
    got = readers.read_csv(spark, f"{tmp_path}/csv", schema).orderBy("id").collect()
    assert [r["v"] for r in got] == ["None", None, "NA"] and readers.header(spark, f"{tmp_path}/csv") == ["id", "v"]
    swapped = T.StructType(list(reversed(schema.fields)))
    with pytest.raises(Exception):  # noqa: B017
        readers.read_csv(spark, f"{tmp_path}/csv", swapped).collect()
    writers.write_json_lines(df, f"{tmp_path}/json")
    assert readers.read_json_lines(spark, f"{tmp_path}/json", schema).count() == 3
    assert readers.require_same_field_order(spark, f"{tmp_path}/json") == ["id", "v"]
    wider = T.StructType([*schema.fields, T.StructField("w", T.StringType())])
    with pytest.raises(Exception, match="required field"):
        readers.read_json_lines(spark, f"{tmp_path}/json", wider).collect()
    with pytest.raises(guards.ContractError):
        readers.require_schema(df, swapped)
    periods = {2018: f"{tmp_path}/csv"}
    assert {r["period"] for r in readers.read_periods(spark, periods, schema).collect()} == {2018}
    found = readers.file_manifest(spark, f"{tmp_path}/csv", "*.gz")
    status = readers.manifest_status(found.withColumn("sha256", F.lit("0")), found)
    assert {r["status"] for r in status.collect()} == {"SHA256_MISMATCH"}
    pages = spark.createDataFrame([(1, "<table><tr><th>A</th></tr><tr><td>x &lt; y</td><td>z</td></tr></table>")], "id int, html string")
    cells = {(r["row"], r["cell"]): r["value"] for r in readers.table_cells(pages, "html", "id").collect()}
    assert cells == {(0, 0): "A", (1, 0): "x < y", (1, 1): "z"}


def test_features_and_models(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, f"{i % 4}", None if i % 5 == 0 else float(rng.choice([20, 30, 60])), i % 3) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, c string, v double, target int")
    train, rest = df.where("id < 240"), df.where("id >= 240").withColumn("c", F.when(F.col("id") % 2 == 0, "new").otherwise(F.col("c")))
    assert fold_to_vocabulary(rest, "c", vocabulary(train, "c")).where(F.col("c") == C.UNSEEN).count() == 30
    with pytest.raises(Exception, match="null or reserved"):
        vocabulary(train.withColumn("c", F.lit(None).cast("string")), "c").collect()
    scaler = NumericScaler.fit(train, ["v"])
    scaled = scaler.transform(train).agg(F.avg("v_scaled"), F.stddev_pop("v_scaled")).first()
    assert scaled[0] == pytest.approx(0, abs=1e-9) and scaled[1] == pytest.approx(1)
    assert without_columns(["a", "b", "c"], ["b"]) == ["a", "c"]
    encode = encoder(["c"], ["v_scaled", "v_missing"], one_hot=False).fit(scaler.transform(train))
    ready = lambda x: encode.transform(scaler.transform(x))
    model = fit.SealedModel(fit.forest(ready(train), trees=4, depth=3))
    with pytest.raises(PermissionError):
        model.score(ready(rest))
    scored = model.seal().score(ready(rest))
    assert guards.simplex_violations(scored.select(*[F.get("prob", F.lit(i)).alias(f"p{i}") for i in range(3)]), ["p0", "p1", "p2"]).count() == 0
    model._model.write().save(f"{tmp_path}/forest")
    leaves = attribution.saved_leaves(spark, f"{tmp_path}/forest")
    phi = attribution.attributions(scored, leaves, "id")
    assert attribution.additivity(phi, scored, "id").agg(F.max("largest")).first()[0] < 1e-6


def test_ordered_logit_recovers_slopes_and_thresholds(spark):
    from pyspark.ml.linalg import Vectors

    rng = np.random.default_rng(5)
    x = rng.normal(size=(6000, 2))
    latent = x @ [1.5, -0.7] + rng.logistic(size=6000)
    y = (latent > -0.5).astype(int) + (latent > 1.25).astype(int)
    rows = spark.createDataFrame([(i, int(k), Vectors.dense(v)) for i, (k, v) in enumerate(zip(y, x))], ["id", "target", "features"])
    slopes, thresholds = fit.ordered_logit(rows)
    assert np.allclose(slopes, [1.5, -0.7], atol=0.12) and np.allclose(thresholds, [-0.5, 1.25], atol=0.12)
    got = fit.ordered_scored(slopes, thresholds, rows).orderBy("id").toPandas()
    p = np.stack(got["prob"])
    margin = x @ slopes
    below = 1 / (1 + np.exp(margin[:, None] - np.array(thresholds)[None, :]))
    want = np.stack([below[:, 0], below[:, 1] - below[:, 0], 1 - below[:, 1]], axis=1)
    assert np.allclose(p, want, atol=1e-9) and (got["predicted_code"].to_numpy() == want.argmax(axis=1)).all()


def test_independent_gaps_and_contrasts_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    cohorts, models = ("in", "out"), ("A", "B")
    value = {(c, m, i): float(rng.normal(1.0 if c == "in" else 0.0)) for c in cohorts for m in models for i in range(40)}
    point = {(c, m): float(rng.normal()) for c in cohorts for m in models}
    draws = spark.createDataFrame([(c, m, i, v) for (c, m, i), v in value.items()], "role string, model string, iteration int, value double")
    observed = spark.createDataFrame([(c, m, v) for (c, m), v in point.items()], "role string, model string, value double")
    for r in resample.independent_gaps(draws, observed, "in", "out", ["model"]).collect():
        gaps = [value["in", r["model"], i] - value["out", r["model"], i] for i in range(40)]
        assert np.allclose([r["low"], r["high"]], np.percentile(gaps, [2.5, 97.5]))
        assert r["observed"] == pytest.approx(point["in", r["model"]] - point["out", r["model"]]) and r["draws"] == 40
    weights = spark.createDataFrame([("gain", "A", -1.0), ("gain", "B", 1.0)], "contrast string, model string, weight double")
    for r in resample.paired_contrasts(draws, observed, weights, ["role"]).collect():
        sums = [value[r["role"], "B", i] - value[r["role"], "A", i] for i in range(40)]
        low, high = np.percentile(sums, [2.5, 97.5])
        assert np.allclose([r["low"], r["high"]], [low, high])
        seen = point[r["role"], "B"] - point[r["role"], "A"]
        label = "clear_positive" if seen > 0 and low > 0 else "clear_negative" if seen < 0 and high < 0 else "direction_uncertain"
        assert r["evidence"] == label
