"""Further registered queries: projections, filters, joins, sorts, gates and refits."""

from __future__ import annotations


from pyspark.sql import functions as F

from ordeval.functions import columns as C
from ordeval.models import fit
from ordeval.models import queries as model_queries
from ordeval.models.features import NumericScaler, encoder, without_columns
from ordeval.operators import audits, guards, joins, metrics, splits, verify, windows
from ordeval.plans import cohort as plan
from ordeval.queries import (
    _DICT_SQL, _DICTIONARY, _N, _SEED_VALUES, _SLOTS, _VALUES, HASH, METRIC_SQL, candidates, counts_sql, metrics_sql,
    model_values, modelled, query, rounded, seed_values, slot_counts,
)
from ordeval.sources import readers


@query("p01_projection", "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders", False)
def _(s, d):
    orders = plan.read(s, d, "orders")
    wanted = [f for f in orders.schema if f.name in ("o_orderkey", "o_totalprice", "o_orderdate")]
    from pyspark.sql.types import StructType

    return readers.require_schema(orders.select(*[f.name for f in wanted]), StructType(wanted))


@query("p02_ablation_columns", "SELECT id, priority_code, speed::DOUBLE AS speed FROM cohort")
def _(s, d):
    left = without_columns(["priority_code", "status", "month_code", "speed"], ["status", "month_code"])
    return plan.cohort(s, d).select("id", *left).withColumn("speed", F.col("speed").cast("double"))


@query("p03_pattern", "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part", False)
def _(s, d):
    parts = plan.read(s, d, "part").withColumn("scan_seconds", F.lit(1.0))
    return parts.select(*[c for c in parts.columns if c.startswith("p_") and not c.endswith("seconds")])


@query("p04_rename", "SELECT c_custkey AS customer_id, c_name AS customer_name FROM customer", False)
def _(s, d):
    return plan.read(s, d, "customer").select("c_custkey", "c_name").withColumnsRenamed({"c_custkey": "customer_id", "c_name": "customer_name"})


@query("f02_in_list", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')", False)
def _(s, d):
    return plan.read(s, d, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey")


@query("f03_comparisons", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag <> 'N' AND l_quantity <= 5 AND NOT (l_discount > 0.05)", False)
def _(s, d):
    rows = plan.read(s, d, "lineitem").where((F.col("l_returnflag") != "N") & (F.col("l_quantity") <= 5) & ~(F.col("l_discount") > 0.05))
    return rows.select("l_orderkey", "l_linenumber", "l_quantity")


@query("f05_include", "SELECT id FROM cohort WHERE status IN ('F', 'O') AND priority_code IN ('1', '5')")
def _(s, d):
    return verify.matches_include(plan.cohort(s, d), {"status": ["F", "O"], "priority_code": ["1", "5"]}).select("id")


@query("f06_role_rows", "SELECT id FROM cohort WHERE role = 'validation'")
def _(s, d):
    return plan.cohort(s, d).where("role = 'validation'").select("id")


@query("j03_dictionary", f"SELECT c.id, k.label FROM cohort c LEFT JOIN (VALUES {_DICT_SQL}) k(field, code, label) ON k.field = 'status' AND k.code = c.status")
def _(s, d):
    dictionary = s.createDataFrame(_DICTIONARY, "field string, status string, label string").where("field = 'status'").drop("field")
    return joins.many_to_one(plan.cohort(s, d).select("id", "status"), F.broadcast(dictionary), ["status"], check=False).select("id", "label")


@query("j04_lookup", "SELECT o.o_orderkey, o.o_totalprice FROM orders o JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 45) k ON k.l_orderkey = o.o_orderkey", False)
def _(s, d):
    wanted = plan.read(s, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return plan.read(s, d, "orders").join(wanted, "o_orderkey", "left_semi").select("o_orderkey", "o_totalprice")


@query("j07_subset", "SELECT count(*) AS outside FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)", False)
def _(s, d):
    allowed = plan.read(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return guards.outside(plan.read(s, d, "orders"), allowed, "o_custkey").agg(F.count("*").alias("outside"))


@query("j10_period_pairs", "SELECT a.year AS left_year, b.year AS right_year FROM (SELECT DISTINCT year FROM cohort) a JOIN (SELECT DISTINCT year FROM cohort) b ON a.year < b.year")
def _(s, d):
    years = plan.cohort(s, d).select("year").distinct()
    a, b = years.select(F.col("year").alias("left_year")), years.select(F.col("year").alias("right_year"))
    return a.join(b, F.col("left_year") < F.col("right_year"))


@query("j11_domain_fill", """SELECT s.status, p.priority_code, m.month_code, t.target, count(c.id) AS n FROM (SELECT DISTINCT status FROM cohort) s CROSS JOIN (SELECT DISTINCT priority_code FROM cohort) p
CROSS JOIN (SELECT DISTINCT month_code FROM cohort) m CROSS JOIN (SELECT DISTINCT target FROM cohort) t
LEFT JOIN cohort c ON c.status = s.status AND c.priority_code = p.priority_code AND c.month_code = m.month_code AND c.target = t.target GROUP BY 1, 2, 3, 4""")
def _(s, d):
    df = plan.cohort(s, d)
    keys = ["status", "priority_code", "month_code", "target"]
    codes = df.agg(*[F.collect_set(k).alias(k) for k in keys])  # the codes of each column: few, and not rows
    domain = codes
    for k in keys:
        domain = domain.withColumn(k, F.explode(k))
    return domain.join(audits.counts(df, *keys), keys, "left").na.fill(0, ["n"])


@query("j12_spec_join", "SELECT role, n, expected, n >= expected AS enough FROM (SELECT role, count(*) AS n FROM cohort GROUP BY role) JOIN (VALUES ('train', 1000), ('validation', 200), ('test', 100000)) t(role, expected) USING (role)")
def _(s, d):
    spec = s.createDataFrame([("train", 1000), ("validation", 200), ("test", 100000)], "role string, expected int")
    return audits.counts(plan.cohort(s, d), "role").join(F.broadcast(spec), "role").withColumn("enough", F.col("n") >= F.col("expected"))


@query("j13_documented", "SELECT f.field, k.note FROM (VALUES ('o_orderkey'), ('o_totalprice'), ('o_orderdate')) f(field) LEFT JOIN (VALUES ('o_orderkey', 'key'), ('x', 'gone')) k(field, note) USING (field)", False)
def _(s, d):
    fields = s.createDataFrame([(c,) for c in plan.read(s, d, "orders").columns if c in ("o_orderkey", "o_totalprice", "o_orderdate")], "field string")
    return audits.described_fields(fields, s.createDataFrame([("o_orderkey", "key"), ("x", "gone")], "field string, note string"))


@query("j14_side_by_side", f"""WITH {_VALUES} SELECT metric, round(max(CASE WHEN role = 'validation' THEN value END), 9) + 0.0 AS first_source, round(max(CASE WHEN role = 'test' THEN value END), 9) + 0.0 AS second_source,
  max(CASE WHEN role = 'validation' THEN value END) > 0 AND max(CASE WHEN role = 'test' THEN value END) > 0 AS same_sign FROM v WHERE model = 'B' GROUP BY metric""")
def _(s, d):
    gap = joins.cohort_gap(model_values(s, d).where("model = 'B'"), "validation", "test", ["metric"], cohort="role")
    out = gap.select("metric", F.col("internal").alias("first_source"), F.col("future").alias("second_source"))
    out = out.withColumn("same_sign", (F.col("first_source") > 0) & (F.col("second_source") > 0))
    return rounded(out, "first_source", "second_source")


@query("w04_row_share", """SELECT model, true_code, predicted_code, n, round(n::DOUBLE / sum(n) OVER (PARTITION BY model, true_code), 9) AS row_share
FROM (SELECT model, true_code, predicted_code, count(*) AS n FROM modelled GROUP BY ALL)""")
def _(s, d):
    n = audits.counts(modelled(s, d), "model", "true_code", "predicted_code")
    return rounded(windows.with_group_share(n, "n", "model", "true_code", out="row_share"), "row_share")


@query("w05_pool_share", "SELECT role, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 9) AS share FROM cohort GROUP BY role")
def _(s, d):
    return rounded(windows.with_group_share(audits.counts(plan.cohort(s, d), "role"), "n"), "share")


@query("o01_stable_sort", "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority, o_orderkey", False)
def _(s, d):
    return plan.read(s, d, "orders").select("o_orderkey", "o_orderpriority").orderBy("o_orderpriority", "o_orderkey")


@query("o02_descending", "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey", False)
def _(s, d):
    return plan.read(s, d, "supplier").select("s_suppkey", "s_acctbal").orderBy(F.desc("s_acctbal"), "s_suppkey")


@query("o03_sorted_levels", "SELECT p_type, count(*) AS n FROM part GROUP BY p_type ORDER BY p_type", False)
def _(s, d):
    return audits.counts(plan.read(s, d, "part"), "p_type").orderBy("p_type")


@query("o08_first_mismatches", "SELECT c_custkey FROM customer WHERE c_custkey % 17 = 0 ORDER BY c_custkey LIMIT 5", False)
def _(s, d):
    c = plan.read(s, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("x"))
    other = c.withColumn("x", F.when(F.col("k") % 17 == 0, F.col("x") + 1).otherwise(F.col("x")))
    return verify.table_differences(c, other, ["k"]).select(F.col("k").alias("c_custkey")).orderBy("c_custkey").limit(5)


@query("u05_support_union", """SELECT coalesce(a.v, b.v) AS v, coalesce(a.n, 0) AS n_left, coalesce(b.n, 0) AS n_right FROM (SELECT p_size AS v, count(*) AS n FROM part GROUP BY 1) a
FULL OUTER JOIN (SELECT l_linenumber AS v, count(*) AS n FROM lineitem GROUP BY 1) b ON a.v = b.v""", False)
def _(s, d):
    a = audits.counts(plan.read(s, d, "part").select(F.col("p_size").alias("v")), "v").withColumnRenamed("n", "n_left")
    b = audits.counts(plan.read(s, d, "lineitem").select(F.col("l_linenumber").alias("v")), "v").withColumnRenamed("n", "n_right")
    return a.join(b, "v", "full_outer").na.fill(0, ["n_left", "n_right"])


@query("r03_stratified_subset", f"""WITH q AS (SELECT target, floor(200 * count(*)::DOUBLE / sum(count(*)) OVER ())::BIGINT AS low, round(200 * count(*)::DOUBLE / sum(count(*)) OVER () - floor(200 * count(*)::DOUBLE / sum(count(*)) OVER ()), 9) AS rest FROM cohort WHERE role = 'validation' GROUP BY target),
k AS (SELECT target, low + CASE WHEN row_number() OVER (ORDER BY rest DESC, target) <= 200 - sum(low) OVER () THEN 1 ELSE 0 END AS quota FROM q),
r AS (SELECT id, target, row_number() OVER (PARTITION BY target ORDER BY {HASH.format("'4409:' || id::VARCHAR")}, id) AS rk FROM cohort WHERE role = 'validation')
SELECT r.id, r.target FROM r JOIN k USING (target) WHERE rk <= quota""")
def _(s, d):
    return splits.stratified_sample(plan.cohort(s, d).where("role = 'validation'").select("id", "target"), 200, 4409, "id", "target")


@query("s04_folded_counts", "SELECT l_returnflag, l_linestatus, count(*) AS n, min(l_shipdate) AS first_ship FROM lineitem GROUP BY 1, 2", False)
def _(s, d):
    return plan.read(s, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.min("l_shipdate").alias("first_ship"))


@query("s05_lockstep", "SELECT count(*) AS differing FROM predicted WHERE pred_a <> pred_b")
def _(s, d):
    df = plan.predicted(plan.cohort(s, d))
    a, b = df.select("id", F.col("pred_a").alias("label")), df.select("id", F.col("pred_b").alias("label"))
    return guards.misaligned(a, b, "id", "label").agg(F.count("*").alias("differing"))


@query("s13_pushed_counts", "SELECT year(o_orderdate)::INT AS year, o_orderstatus, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1999-01-01' GROUP BY 1, 2", False)
def _(s, d):
    rows = plan.read(s, d, "orders").where(F.col("o_orderdate") >= F.lit("1999-01-01").cast("timestamp_ntz"))
    return rows.groupBy(F.year("o_orderdate").alias("year"), "o_orderstatus").agg(F.count("*").alias("n"))


_PAIRS = """SELECT s_suppkey AS k, CASE s_suppkey % 4 WHEN 0 THEN s_nationkey::VARCHAR WHEN 1 THEN s_name WHEN 2 THEN 'nan' END AS a,
  CASE s_suppkey % 4 WHEN 0 THEN '7.0' WHEN 1 THEN CASE WHEN s_suppkey % 8 = 1 THEN s_name ELSE 'other' END WHEN 2 THEN 'NaN' ELSE CASE WHEN s_suppkey % 8 = 3 THEN '1' END END AS b FROM supplier"""


@query("v01_scalar_equality", f"""SELECT k, CASE WHEN a IS NULL OR b IS NULL THEN a IS NULL AND b IS NULL WHEN k % 4 = 1 THEN a = b ELSE a::DOUBLE = b::DOUBLE END AS same FROM ({_PAIRS})""", False)
def _(s, d):
    k = F.col("s_suppkey")
    a = F.when(k % 4 == 0, F.col("s_nationkey").cast("string")).when(k % 4 == 1, F.col("s_name")).when(k % 4 == 2, "nan")
    b = F.when(k % 4 == 0, "7.0").when(k % 8 == 1, F.col("s_name")).when(k % 4 == 1, "other").when(k % 4 == 2, "NaN").when(k % 8 == 3, "1")
    return plan.read(s, d, "supplier").select(k.alias("k"), C.close(a, b).alias("same"))


@query("v03_json_differences", """SELECT c_custkey, '$["tags"][1]' AS path, 'different' AS problem FROM customer WHERE c_custkey % 13 = 0
UNION ALL SELECT c_custkey, '$["inner"]["balance"]', 'different' FROM customer WHERE c_custkey % 7 = 0
UNION ALL SELECT c_custkey, '$["inner"]["name"]', 'extra' FROM customer WHERE c_custkey % 5 = 0""", False)
def _(s, d):
    """Documents of two versions of a table; ``seen`` is ignored and differs everywhere."""
    k, x = F.col("c_custkey"), F.col("c_acctbal").cast("double")

    def document(tag, balance, seen, name):
        inner = F.struct(balance.alias("balance"), F.lit(seen).alias("seen"), name.alias("name"))
        return F.to_json(F.struct(k.alias("key"), F.array(F.lit("a"), tag).alias("tags"), inner.alias("inner"))).alias("document")

    nothing = F.lit(None).cast("string")
    old = document(F.col("c_mktsegment"), x, 1, nothing)
    new = document(F.when(k % 13 == 0, "OTHER").otherwise(F.col("c_mktsegment")), F.when(k % 7 == 0, x + 1).otherwise(x), 2, F.when(k % 5 == 0, F.col("c_name")))
    df = plan.read(s, d, "customer")
    found = verify.json_differences(df.select(k, old), df.select(k, new), "c_custkey", "document", ignored=["seen"])
    return found.select("c_custkey", "path", "problem")


@query("v04_named_modes", "SELECT id, CASE WHEN id % 7 = 0 THEN 'target' ELSE 'p0' END AS column FROM cohort WHERE id % 7 = 0 OR id % 7 = 1")
def _(s, d):
    a = plan.predicted(plan.cohort(s, d)).select("id", F.col("target").cast("double").alias("target"), F.get("prob", F.lit(0)).alias("p0"))
    b = a.select("id", F.when(F.col("id") % 7 == 0, F.col("target") + 1e-12).otherwise(F.col("target")).alias("target"), F.when(F.col("id") % 7 == 1, F.col("p0") + 1e-3).when(F.col("id") % 7 == 2, F.col("p0") + 1e-12).otherwise(F.col("p0")).alias("p0"))
    return verify.table_differences(a, b, ["id"], exact=("target",)).where("column <> 'target' OR id % 7 = 0 AND expected <> observed").select("id", "column")


@query("v05_draw_diff", f"WITH {_SLOTS} SELECT (iteration)::INT AS iteration FROM (SELECT DISTINCT iteration FROM picks) WHERE iteration % 6 = 0")
def _(s, d):
    draws = metrics.metrics(slot_counts(s, d), ["iteration"], ("accuracy",)).withColumnRenamed("accuracy", "value")
    other = draws.withColumn("value", F.when(F.col("iteration") % 6 == 0, F.col("value") + 0.5).otherwise(F.col("value")))
    return verify.draw_differences(draws, other, ["iteration"]).select("iteration")


@query("v07_propagation", """SELECT count(*) FILTER (model = 'A') AS primary_cells, count(*) FILTER (model = 'B') AS secondary_cells,
  count(DISTINCT CASE WHEN model = 'A' THEN id END) AS primary_draws, count(DISTINCT CASE WHEN model = 'B' THEN id END) AS secondary_draws
FROM modelled WHERE role = 'test' AND true_code <> predicted_code""")
def _(s, d):
    different = modelled(s, d).where("role = 'test' AND true_code <> predicted_code").withColumnRenamed("id", "iteration")
    return verify.propagation(different, F.col("model") == "A")


@query("v08_catalog", f"WITH w AS ({counts_sql('modelled', 'role', 'model')}) SELECT role, model, ({_N})::BIGINT AS n, {metrics_sql(('accuracy',))} FROM w WHERE role IN ('test', 'validation') ORDER BY role, model")
def _(s, d):
    m = metrics.metrics(metrics.confusion_counts(modelled(s, d), ["role", "model"]), ["role", "model"], ("accuracy",), digits=9)
    return verify.catalog_view(m.withColumn("fit_seconds", F.rand()), ["role", "model"], {"role": ["test", "validation"]})


_GAPS = f"""WITH {_SEED_VALUES}, g AS (SELECT i.seed, i.metric, i.value - f.value AS gap FROM v i JOIN v f ON i.seed = f.seed AND i.metric = f.metric AND i.role = 'test' AND f.role = 'locked_temporal_test')
SELECT metric, CASE WHEN bool_and(gap > 0.001) THEN 'consistent_optimism' WHEN bool_and(gap < -0.001) THEN 'consistent_pessimism' ELSE 'mixed_or_uncertain' END AS evidence FROM g GROUP BY metric"""


@query("p19_evidence", _GAPS)
def _(s, d):
    gap = joins.cohort_gap(seed_values(s, d), "test", "locked_temporal_test", ["seed", "metric"], cohort="role")
    bounds = gap.select("metric", F.col("gap").alias("point"), (F.col("gap") - 0.001).alias("low"), (F.col("gap") + 0.001).alias("high"))
    return metrics.gap_evidence(bounds, ["metric"])


@query("p20_gate", f"""WITH {_VALUES}, x AS (SELECT a.role, a.metric, b.value - a.value AS point FROM v a JOIN v b ON a.role = b.role AND a.metric = b.metric AND a.model = 'A' AND b.model = 'B')
SELECT role, max(CASE WHEN metric = 'macro_f1' THEN point END) >= 0.01 AND max(CASE WHEN metric = 'macro_f1' THEN point - 0.005 END) > 0 AND max(CASE WHEN metric = 'qwk' THEN point + 0.005 END) >= 0
  AND max(CASE WHEN metric = 'recall_2' THEN point + 0.005 END) >= 0 AND max(CASE WHEN metric = 'mean_asymmetric_cost' THEN point - 0.005 END) <= 0 AS passes FROM x GROUP BY role""")
def _(s, d):
    gap = joins.cohort_gap(model_values(s, d), "B", "A", ["role", "metric"], cohort="model")
    bounds = gap.select("role", "metric", F.col("gap").alias("point"), (F.col("gap") - 0.005).alias("low"), (F.col("gap") + 0.005).alias("high"))
    return metrics.gain_gate(bounds, ["role"])


@query("m14_constraint", f"""WITH x AS (SELECT model || '-' || segment AS candidate, true_code, predicted_code FROM modelled WHERE role = 'validation'), w AS ({counts_sql('x', 'candidate')}),
m AS (SELECT candidate, {metrics_sql(('macro_f1', 'qwk', 'recall_2'))} FROM w), a AS (SELECT model, true_code, predicted_code FROM modelled WHERE role = 'validation' AND model = 'A'), wa AS ({counts_sql('a', 'model')}),
b AS (SELECT round({METRIC_SQL['qwk']}, 9) AS q, round({METRIC_SQL['recall_2']}, 9) AS r FROM wa), e AS (SELECT m.*, m.qwk >= b.q - 0.01 AND m.recall_2 >= b.r - 0.05 AS ok FROM m, b)
SELECT candidate FROM (SELECT *, bool_or(ok) OVER () AS any_ok FROM e) WHERE ok OR NOT any_ok ORDER BY macro_f1 DESC, qwk DESC, recall_2 DESC, length(candidate), candidate LIMIT 1""")
def _(s, d):
    baseline = modelled(s, d).where("role = 'validation' AND model = 'A'")
    base = metrics.metrics(metrics.confusion_counts(baseline, ["model"]), ["model"], ("qwk", "recall_2"), digits=9)
    joined = candidates(s, d).crossJoin(F.broadcast(base.select(F.col("qwk").alias("base_qwk"), F.col("recall_2").alias("base_recall"))))  # one row
    return windows.select_candidate(joined, F.col("base_qwk"), F.col("base_recall")).select("candidate")


@query("m05_matrix_sanity", "SELECT count(*) AS n, 1::BIGINT AS widths, 0::BIGINT AS not_finite FROM cohort")
def _(s, d):
    train, rows = model_queries.prepared(s, d)
    from pyspark.ml.functions import vector_to_array

    x = vector_to_array("features")
    bad = F.exists(x, lambda v: F.isnan(v) | (F.abs(v) == float("inf")))
    return rows.agg(F.count("*").alias("n"), F.countDistinct(F.size(x)).alias("widths"), F.count_if(bad).alias("not_finite"))


def _refit(s, d, fields, rows):
    train = rows.where("role = 'train'")
    scaler = NumericScaler.fit(train, ["speed"])
    encode = encoder(fields, ["speed_scaled", "speed_missing"]).fit(scaler.transform(train))
    ready = encode.transform(scaler.transform(rows)).select("id", "role", "target", "features")
    scored = fit.scored(fit.logistic(ready.where("role = 'train'")), ready.where("role <> 'train'"))
    named = scored.withColumn("true_code", F.col("target"))
    return metrics.metrics(metrics.confusion_counts(named, ["role"]), ["role"], digits=9)


@query("m15_ablation")
def _(s, d):
    rows, parts = plan.cohort(s, d), []
    for dropped in ("status", "month_code"):
        fields = without_columns(["priority_code", "status", "month_code"], [dropped])
        parts.append(_refit(s, d, fields, rows).withColumn("without", F.lit(dropped)))
    return parts[0].unionByName(parts[1])


@query("m16_year_exclusion")
def _(s, d):
    rows = splits.without_period(plan.cohort(s, d), "role", "year", 1997)
    return _refit(s, d, ["priority_code", "status", "month_code"], rows)


@query("d05_page_fields", r"SELECT page_id, len(regexp_extract_all(html, '(?is)<a(?:\s[^>]*)?>(.*?)</a>', 1)) AS n FROM pages WHERE len(regexp_extract_all(html, '(?is)<a(?:\s[^>]*)?>(.*?)</a>', 1)) > 0", False)
def _(s, d):
    return readers.tagged_texts(plan.read(s, d, "pages"), "a", "html", "page_id").groupBy("page_id").agg(F.count("*").alias("n"))


@query("a10_feature_audit", "SELECT 'speed' AS field, count(*) AS n, count(*) FILTER (speed IS NULL) AS missing, count(DISTINCT speed) AS distinct_values, max(n_max) AS largest FROM cohort, (SELECT max(speed)::DOUBLE AS n_max FROM cohort)")
def _(s, d):
    df = plan.cohort(s, d)
    top = df.agg(F.max("speed").cast("double").alias("largest"))
    prof = audits.column_profile(df, ["speed"]).select("field", "n", "missing", "distinct_values")
    return prof.crossJoin(top)  # one row each


