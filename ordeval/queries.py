"""Registered queries of the survey's operators (key: survey id and a short name) and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordeval.functions import columns as C
from ordeval.operators import audits, guards, joins, means, metrics, ranks, resample, splits, verify, windows
from ordeval.plans import cohort as plan
from ordeval.sources import readers

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

HASH = "('0x' || substr(md5({}), 1, 8))::UBIGINT::BIGINT"
COHORT_SQL = f"""
cohort AS (
  SELECT o_orderkey AS id, o_custkey AS custkey, year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month,
         CASE WHEN year(o_orderdate) BETWEEN 1995 AND 1999 THEN 'train' WHEN year(o_orderdate) = 2000 THEN 'validation'
              WHEN year(o_orderdate) = 2001 THEN 'test' END AS role,
         CASE WHEN o_totalprice >= 490000 THEN 2 WHEN o_totalprice >= 390000 THEN 1 ELSE 0 END AS target,
         c_mktsegment AS segment, substr(o_orderpriority, 1, 1) AS priority_code,
         trim(regexp_replace(o_orderpriority, '^\\d-?\\s*', '')) AS priority_label, o_orderstatus AS status,
         'M' || lpad(month(o_orderdate)::VARCHAR, 2, '0') AS month_code,
         CASE o_custkey % 7 WHEN 0 THEN 20 WHEN 1 THEN 30 WHEN 2 THEN 40 WHEN 3 THEN 60 WHEN 5 THEN 20 WHEN 6 THEN 30 END AS speed
  FROM orders LEFT JOIN customer ON c_custkey = o_custkey
), predicted AS (
  SELECT *, ((id * 7 + custkey) % 3)::INT AS pred_a,
         CASE WHEN month <= 2 AND priority_code <= '2' THEN 2 WHEN priority_code = '3' THEN 1 ELSE 0 END AS pred_b,
         ({HASH.format("'p0:' || id::VARCHAR")} % 97 + 1)::DOUBLE AS q0,
         ({HASH.format("'p1:' || id::VARCHAR")} % 97 + 1)::DOUBLE AS q1,
         ({HASH.format("'p2:' || id::VARCHAR")} % 97 + 1)::DOUBLE AS q2
  FROM cohort
), modelled AS (
  SELECT 'A' AS model, id, year, role, segment, target AS true_code, pred_a AS predicted_code, q0, q1, q2, q0 + q1 + q2 AS qs FROM predicted
  UNION ALL
  SELECT 'B', id, year, role, segment, target, pred_b, q0, q1, q2, q0 + q1 + q2 FROM predicted
)"""

_CELLS = [(i, j) for i in range(3) for j in range(3)]
_ROW = {i: " + ".join(f"c{i}{j}" for j in range(3)) for i in range(3)}
_COL = {j: " + ".join(f"c{i}{j}" for i in range(3)) for j in range(3)}
_N = " + ".join(f"c{i}{j}" for i, j in _CELLS)


def counts_sql(source: str, *keys: str) -> str:
    """Wide counts of each group of ``source``."""
    cells = ", ".join(f"count(*) FILTER (true_code = {i} AND predicted_code = {j})::DOUBLE AS c{i}{j}" for i, j in _CELLS)
    return f"SELECT {', '.join(keys)}, {cells} FROM {source} GROUP BY {', '.join(keys)}"


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) = 0 THEN 0.0 ELSE ({a}) / ({b}) END"


METRIC_SQL = {
    "macro_f1": "(" + " + ".join(f"({_ratio(f'2 * c{i}{i}', f'{_ROW[i]} + {_COL[i]}')})" for i in range(3)) + ") / 3",
    "qwk": "1 - " + _ratio(
        "(" + " + ".join(f"{(i - j) ** 2} * c{i}{j}" for i, j in _CELLS) + f") * ({_N})",
        " + ".join(f"{(i - j) ** 2} * ({_ROW[i]}) * ({_COL[j]})" for i, j in _CELLS),
    ),
    "ordinal_mae": _ratio(" + ".join(f"{abs(i - j)} * c{i}{j}" for i, j in _CELLS), _N),
    "accuracy": _ratio("c00 + c11 + c22", _N),
    **{f"recall_{i}": _ratio(f"c{i}{i}", _ROW[i]) for i in range(3)},
    **{f"precision_{j}": _ratio(f"c{j}{j}", _COL[j]) for j in range(3)},
    "serious_or_worse_recall": _ratio("c11 + c12 + c21 + c22", f"{_ROW[1]} + {_ROW[2]}"),
    "mean_asymmetric_cost": _ratio(" + ".join(f"{C.COSTS[i][j]} * c{i}{j}" for i, j in _CELLS), _N),
}


def metrics_sql(names: tuple[str, ...]) -> str:
    return ", ".join(f"round({METRIC_SQL[m]}, 9) + 0.0 AS {m}" for m in names)


def query(name: str, sql: str | None = None, uses_cohort: bool = True) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is its DuckDB twin, after the cohort's common tables if it uses them."""

    def put(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            glue = "," if sql.lstrip().upper().startswith("WITH ") else ""
            body = sql.lstrip()[5:] if glue else sql
            _SQL[name] = f"WITH {COHORT_SQL}{glue} {body}" if uses_cohort else sql
        return f

    return put


def modelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.by_model(plan.predicted(plan.cohort(spark, sf_dir)))


def rounded(df: DataFrame, *columns: str, digits: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) + 0.0 for c in columns})


# --- metrics -----------------------------------------------------------------------------------------------------


@query("a20_metrics", f"WITH w AS ({counts_sql('modelled', 'role', 'model')}) SELECT role, model, ({_N})::BIGINT AS n, {metrics_sql(metrics.METRICS)} FROM w")
def _(s, d):
    return metrics.metrics(metrics.confusion_counts(modelled(s, d), ["role", "model"]), ["role", "model"], digits=9)


@query("a19_confusion", f"""WITH w AS ({counts_sql('modelled', 'role', 'model')}), t AS (SELECT i, j FROM range(3) a(i), range(3) b(j)),
  m AS (SELECT role, model, true_code, predicted_code, count(*) AS n FROM modelled GROUP BY ALL)
SELECT g.role, g.model, t.i::INT AS true_code, t.j::INT AS predicted_code, coalesce(m.n, 0) AS n,
  round(CASE WHEN sum(coalesce(m.n, 0)) OVER (PARTITION BY g.role, g.model, t.i) = 0 THEN 0.0
        ELSE coalesce(m.n, 0)::DOUBLE / sum(coalesce(m.n, 0)) OVER (PARTITION BY g.role, g.model, t.i) END, 9) + 0.0 AS row_share
FROM w g CROSS JOIN t LEFT JOIN m ON m.role = g.role AND m.model = g.model AND m.true_code = t.i AND m.predicted_code = t.j""")
def _(s, d):
    wide = metrics.confusion_counts(modelled(s, d), ["role", "model"])
    return rounded(metrics.confusion_long(wide, ["role", "model"]), "row_share")


PR = tuple(f"{k}_{i}" for k in ("recall", "precision") for i in range(3))


@query("a21_precision_recall", f"WITH w AS ({counts_sql('modelled', 'year', 'model')}) SELECT year, model, ({_N})::BIGINT AS n, {metrics_sql(PR)} FROM w")
def _(s, d):
    return metrics.metrics(metrics.confusion_counts(modelled(s, d), ["year", "model"]), ["year", "model"], PR, digits=9)


@query("a22_log_loss", "SELECT role, round(avg(-ln(CASE true_code WHEN 0 THEN q0 WHEN 1 THEN q1 ELSE q2 END / qs)), 9) AS log_loss FROM modelled WHERE model = 'A' GROUP BY role")
def _(s, d):
    df = plan.predicted(plan.cohort(s, d)).withColumn("true_code", F.col("target"))
    return rounded(metrics.log_loss(df, ["role"], "prob", "true_code"), "log_loss")


_STD = f"""WITH w AS ({counts_sql('modelled', 'role', 'model')}),
ref AS (SELECT ({_ROW[0]}) / ({_N}) AS r0, ({_ROW[1]}) / ({_N}) AS r1, ({_ROW[2]}) / ({_N}) AS r2 FROM w WHERE role = 'train' AND model = 'A'),
s AS (SELECT role, model, {', '.join(f"c{i}{j} * {_ratio(f'r{i} * ({_N})', _ROW[i])} AS c{i}{j}" for i, j in _CELLS)} FROM w, ref)
SELECT role, model, round({METRIC_SQL['qwk']}, 9) + 0.0 AS qwk FROM s"""


@query("a23_std_qwk", _STD)
def _(s, d):
    wide = metrics.confusion_counts(modelled(s, d), ["role", "model"])
    reference = metrics.class_shares(wide.where("role = 'train' AND model = 'A'"))
    return metrics.metrics(metrics.standardised(wide, reference), ["role", "model"], ("qwk",), digits=9).drop("n")


def roles_of_seeds(s, d):
    """(seed, id, target, role, ...) for the five seeds: one scan, the seeds are a column."""
    base = plan.predicted(plan.cohort(s, d)).select("id", "year", "target", "pred_a", "pred_b")
    seeded = base.withColumn("seed", F.explode(F.array(*[F.lit(x) for x in splits.SEEDS])))
    return splits.random_roles(seeded, F.col("seed"), "id", "target", F.col("year") == 2001, by=["seed"])


def _roles_sql(seed: int) -> str:
    h = HASH.format(f"'{seed}:' || id::VARCHAR")
    h2 = HASH.format(f"'{seed + splits.SECOND_STAGE}:' || id::VARCHAR")
    return f"""SELECT {seed} AS seed, id, year, target, pred_a, pred_b,
  CASE WHEN year = 2001 THEN 'locked_temporal_test' WHEN rk <= round(0.7 * n) THEN 'train'
       WHEN rk2 <= round({0.15 / (1 - 0.7)!r} * n2) THEN 'validation' ELSE 'test' END AS role
FROM (SELECT *, row_number() OVER (PARTITION BY locked, target, rk <= round(0.7 * n) ORDER BY {h2}, id) AS rk2,
             count(*) OVER (PARTITION BY locked, target, rk <= round(0.7 * n)) AS n2
      FROM (SELECT *, year = 2001 AS locked, row_number() OVER (PARTITION BY year = 2001, target ORDER BY {h}, id) AS rk,
                   count(*) OVER (PARTITION BY year = 2001, target) AS n FROM predicted))"""


ROLES_SQL = "roles AS (" + " UNION ALL ".join(_roles_sql(x) for x in splits.SEEDS) + ")"


@query("r02_hash_split", f"WITH {ROLES_SQL} SELECT seed, role, target, count(*) AS n, sum(id)::BIGINT AS ids FROM roles GROUP BY ALL")
def _(s, d):
    return roles_of_seeds(s, d).groupBy("seed", "role", "target").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


def seed_values(s, d):
    df = roles_of_seeds(s, d).select("seed", "role", F.col("target").alias("true_code"), F.col("pred_b").alias("predicted_code"))
    return metrics.long_metrics(metrics.metrics(metrics.confusion_counts(df, ["seed", "role"]), ["seed", "role"]), ["seed", "role"])


_SEED_VALUES = f"""{ROLES_SQL}, m AS (SELECT seed, role, target AS true_code, pred_b AS predicted_code FROM roles),
w AS ({counts_sql('m', 'seed', 'role')}),
v AS ({' UNION ALL '.join(f"SELECT seed, role, '{m}' AS metric, {METRIC_SQL[m]} AS value FROM w" for m in metrics.METRICS)})"""


@query("a24_seed_summary", f"""WITH {_SEED_VALUES}
SELECT role, metric, count(value) AS seeds, round(avg(value), 9) + 0.0 AS mean, round(stddev_samp(value), 9) + 0.0 AS sd,
  round(min(value), 9) + 0.0 AS low, round(max(value), 9) + 0.0 AS high, count(*) FILTER (value > 0) AS positive, count(*) FILTER (value < 0) AS negative
FROM v GROUP BY role, metric""")
def _(s, d):
    return rounded(metrics.seed_summary(seed_values(s, d), ["role", "metric"]), "mean", "sd", "low", "high")


@query("j15_gap", f"""WITH {_SEED_VALUES}
SELECT i.seed, i.metric, round(i.value, 9) + 0.0 AS internal, round(f.value, 9) + 0.0 AS future, round(i.value - f.value, 9) + 0.0 AS gap,
  round(CASE WHEN i.metric IN ('ordinal_mae', 'mean_asymmetric_cost') THEN -1 ELSE 1 END * (i.value - f.value), 9) + 0.0 AS oriented
FROM v i JOIN v f ON i.seed = f.seed AND i.metric = f.metric AND i.role = 'test' AND f.role = 'locked_temporal_test'""")
def _(s, d):
    gap = joins.cohort_gap(seed_values(s, d), "test", "locked_temporal_test", ["seed", "metric"], cohort="role")
    gap = gap.withColumn("oriented", C.orientation(F.col("metric")) * F.col("gap"))
    return rounded(gap, "internal", "future", "gap", "oriented")


@query("a25_conf_quantiles", """SELECT model, true_code, predicted_code, n, round(mean_confidence, 9) AS mean_confidence, round(median_confidence, 9) AS median_confidence,
  round(p90_confidence, 9) AS p90_confidence, round(share, 9) AS share, CASE WHEN predicted_code > true_code THEN 'over' ELSE 'under' END AS direction, abs(true_code - predicted_code)::INT AS distance
FROM (SELECT model, true_code, predicted_code, count(*) AS n, avg(c) AS mean_confidence, quantile_cont(c, 0.5) AS median_confidence, quantile_cont(c, 0.9) AS p90_confidence,
        count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY model) AS share
      FROM (SELECT *, greatest(q0, q1, q2) / qs AS c FROM modelled WHERE role = 'test') GROUP BY model, true_code, predicted_code)
WHERE true_code <> predicted_code""")
def _(s, d):
    df = modelled(s, d).where("role = 'test'").withColumn("confidence", F.array_max("prob"))
    out = metrics.error_structure(df, ["model"], "true_code", "predicted_code", "confidence")
    return rounded(out, "mean_confidence", "median_confidence", "p90_confidence", "share")


_OUTCOME = """CASE WHEN pred_a = target AND pred_b = target THEN 'both_correct' WHEN pred_a = target THEN 'only_a_correct'
 WHEN pred_b = target THEN 'only_b_correct' WHEN pred_a = pred_b THEN 'both_wrong_same' ELSE 'both_wrong_different' END"""


@query("a27_paired", f"""WITH o AS (SELECT target, {_OUTCOME} AS outcome FROM predicted WHERE role = 'test'),
k AS (SELECT unnest(['both_correct', 'only_a_correct', 'only_b_correct', 'both_wrong_same', 'both_wrong_different']) AS outcome),
c AS (SELECT coalesce(target::VARCHAR, 'All') AS scope, outcome, count(*) AS n FROM o GROUP BY GROUPING SETS ((outcome), (outcome, target))),
f AS (SELECT s.scope, k.outcome, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT scope FROM c) s CROSS JOIN k LEFT JOIN c ON c.scope = s.scope AND c.outcome = k.outcome)
SELECT scope, outcome, n, round(n::DOUBLE / sum(n) OVER (PARTITION BY scope), 9) AS share FROM f""")
def _(s, d):
    df = plan.predicted(plan.cohort(s, d)).where("role = 'test'")
    kinds = ("both_correct", "only_a_correct", "only_b_correct", "both_wrong_same", "both_wrong_different")
    got = df.select("target", C.paired_outcome(F.col("target"), F.col("pred_a"), F.col("pred_b")).alias("outcome"))
    scope = F.when(F.grouping("target") == 1, F.lit("All")).otherwise(F.col("target").cast("string"))
    wide = got.rollup("target").agg(scope.alias("scope"), *[F.count_if(F.col("outcome") == k).alias(k) for k in kinds]).drop("target")
    long = wide.unpivot(["scope"], list(kinds), "outcome", "n")
    return rounded(windows.with_group_share(long, "n", "scope"), "share")


def attributions(s, d):
    """Stand-in attributions: three features of each test row from hashes."""
    df = plan.cohort(s, d).where("role = 'test'")
    value = lambda f: (F.pmod(C.hash32(F.concat(F.lit(f"{f}:"), F.col("id").cast("string"))), F.lit(2001)) - 1000) / 1000.0
    return df.select("id", "target", *[value(f).alias(f) for f in ("f1", "f2", "f3")]).unpivot(["id", "target"], ["f1", "f2", "f3"], "feature", "value")


_ATTR = "WITH x AS (" + " UNION ALL ".join(
    f"SELECT id, target, '{f}' AS feature, ({HASH.format(f"'{f}:' || id::VARCHAR")} % 2001 - 1000) / 1000.0::DOUBLE AS value FROM cohort WHERE role = 'test'" for f in ("f1", "f2", "f3")
) + ")"


@query("a28_importance", _ATTR + """, g AS (SELECT target AS scope, feature, avg(abs(value)) AS m, avg(value) AS signed, quantile_cont(value, 0.5) AS median,
  avg(CASE WHEN value > 0 THEN 1.0 ELSE 0.0 END) AS positive FROM x GROUP BY target, feature)
SELECT scope, feature, round(m, 9) AS mean_abs, round(signed, 9) + 0.0 AS mean_signed, round(median, 9) + 0.0 AS median, round(positive, 9) AS positive_share,
  rank() OVER (PARTITION BY scope ORDER BY round(m, 9) DESC) + (count(*) OVER (PARTITION BY scope, round(m, 9)) - 1) / 2.0::DOUBLE AS rank FROM g""")
def _(s, d):
    counts = ranks.value_counts(attributions(s, d).select(F.col("target").alias("scope"), "feature", "value"), "value", "scope", "feature")
    share = lambda x: F.sum(x * F.col("n")) / F.first("total")
    g = counts.groupBy("scope", "feature").agg(
        F.round(share(F.abs("value")), 9).alias("mean_abs"), ranks.mean("value").alias("mean_signed"),
        ranks.quantile("value", 0.5).alias("median"), share((F.col("value") > 0).cast("double")).alias("positive_share"),
    )
    return rounded(windows.average_rank(g, "mean_abs", "scope"), "mean_signed", "median", "positive_share")


@query("m13_rank_correlation", _ATTR + """, m AS (SELECT feature, target, round(avg(abs(value)), 9) AS v FROM x GROUP BY feature, target),
p AS (SELECT a.feature, a.v AS va, b.v AS vb FROM m a JOIN m b ON a.feature = b.feature AND a.target = 0 AND b.target = 1),
r AS (SELECT rank() OVER (ORDER BY va DESC)::DOUBLE AS ra, rank() OVER (ORDER BY vb DESC)::DOUBLE AS rb FROM p)
SELECT 'all' AS scope, round(corr(ra, rb), 9) + 0.0 AS rho FROM r""")
def _(s, d):
    m = attributions(s, d).groupBy("feature").agg(*[F.round(F.avg(F.when(F.col("target") == k, F.abs("value"))), 9).alias(f"v{k}") for k in (0, 1)])
    return rounded(windows.rank_correlation(m.withColumn("scope", F.lit("all")), "v0", "v1", "scope"), "rho")


_VALUES = f"w AS ({counts_sql('modelled', 'role', 'model')}), v AS ({' UNION ALL '.join(f'''SELECT role, model, '{m}' AS metric, {METRIC_SQL[m]} AS value FROM w''' for m in metrics.METRICS)})"


def model_values(s, d):
    wide = metrics.confusion_counts(modelled(s, d), ["role", "model"])
    return metrics.long_metrics(metrics.metrics(wide, ["role", "model"]), ["role", "model"])


@query("a34_contrasts", f"""WITH {_VALUES}, k AS (SELECT * FROM (VALUES ('B - A', 'A', -1.0::DOUBLE), ('B - A', 'B', 1.0), ('mean', 'A', 0.5), ('mean', 'B', 0.5)) t(contrast, model, weight))
SELECT contrast, role, metric, round(sum(weight * value), 9) + 0.0 AS value FROM v JOIN k USING (model) GROUP BY contrast, role, metric""")
def _(s, d):
    weights = s.createDataFrame([("B - A", "A", -1.0), ("B - A", "B", 1.0), ("mean", "A", 0.5), ("mean", "B", 0.5)], "contrast string, model string, weight double")
    return rounded(metrics.contrasts(model_values(s, d), weights, ["role", "metric"]), "value")


@query("a31_main_table", f"""WITH {_VALUES}
SELECT model, metric, round(max(CASE WHEN role = 'validation' THEN value END), 9) + 0.0 AS validation, round(max(CASE WHEN role = 'test' THEN value END), 9) + 0.0 AS test,
  round(avg(value), 9) + 0.0 AS mean, round(stddev_samp(value), 9) + 0.0 AS sd FROM v GROUP BY model, metric""")
def _(s, d):
    of = lambda r: F.max(F.when(F.col("role") == r, F.col("value"))).alias(r)
    out = model_values(s, d).groupBy("model", "metric").agg(of("validation"), of("test"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    return rounded(out, "validation", "test", "mean", "sd")


@query("a17_class_weights", "SELECT target, count(*) AS n_class, round(sum(count(*)) OVER () / (3.0::DOUBLE * count(*)), 9) AS weight FROM cohort WHERE role = 'train' GROUP BY target")
def _(s, d):
    return rounded(metrics.class_weights(plan.cohort(s, d).where("role = 'train'"), "target"), "weight")


@query("a32_majority", "SELECT role, target FROM (SELECT role, target, row_number() OVER (PARTITION BY role ORDER BY count(*) DESC, target) AS r FROM cohort GROUP BY role, target) WHERE r = 1")
def _(s, d):
    n = audits.counts(plan.cohort(s, d), "role", "target")
    return windows.best_row(n, ["role"], "n", "target", ["target"]).select("role", "target")


# --- audits ------------------------------------------------------------------------------------------------------


@query("a01_counts", "SELECT year, status, count(*) AS n FROM cohort GROUP BY year, status")
def _(s, d):
    return audits.counts(plan.cohort(s, d), "year", "status")


@query("a02_value_counts", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1", False)
def _(s, d):
    return audits.counts(plan.read(s, d, "orders"), "o_orderpriority")


@query("a03_frequencies", "SELECT year, priority_code, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY year), 9) AS share FROM cohort GROUP BY year, priority_code")
def _(s, d):
    return rounded(audits.frequencies(plan.cohort(s, d), "priority_code", "year"), "share")


_YEARS = tuple(range(1995, 2002))


@query("a04_count_pivot", f"SELECT priority_code, {', '.join(f'count(*) FILTER (year = {y}) AS n_{y}' for y in _YEARS)} FROM cohort GROUP BY priority_code")
def _(s, d):
    return audits.count_pivot(plan.cohort(s, d), "priority_code", "year", _YEARS)


_N3 = ", ".join(f"count(*) FILTER (target = {k}) AS n_{k}" for k in range(3))


@query("a05_year_rollup", f"SELECT coalesce(year::VARCHAR, 'ALL') AS scope, count(*) AS n, {_N3} FROM cohort GROUP BY ROLLUP (year)")
def _(s, d):
    return audits.period_rollup(plan.cohort(s, d), "year", "target")


@query("a06_role_summary", f"""WITH g AS (SELECT role, count(*) AS n, {_N3} FROM cohort GROUP BY role)
SELECT *, round(n::DOUBLE / sum(n) OVER (), 9) AS share_of_pool, {', '.join(f'round(n_{k}::DOUBLE / n, 9) AS share_{k}' for k in range(3))} FROM g""")
def _(s, d):
    return rounded(audits.role_summary(plan.cohort(s, d), "role", "target"), "share_of_pool", "share_0", "share_1", "share_2")


_FIELDS = ("priority_code", "status", "month_code", "speed")


def _long_sql(*keys: str, fields: tuple[str, ...] = _FIELDS, source: str = "cohort") -> str:
    head = "".join(f"{k}, " for k in keys)
    return " UNION ALL ".join(f"SELECT {head}'{f}' AS field, {f}::VARCHAR AS value FROM {source}" for f in fields)


@query("a07_column_profile", f"""WITH l AS ({_long_sql()}) SELECT field, count(*) AS n, count(*) FILTER (value IS NULL) AS missing, count(DISTINCT value) AS distinct_values,
  count(DISTINCT value) = 1 AS is_constant, min(value) AS low, max(value) AS high FROM l GROUP BY field""")
def _(s, d):
    return audits.column_profile(plan.cohort(s, d), _FIELDS)


@query("a08_distinct", "SELECT count(DISTINCT c_nationkey) AS nations, count(DISTINCT c_mktsegment) AS segments FROM customer", False)
def _(s, d):
    return plan.read(s, d, "customer").agg(F.countDistinct("c_nationkey").alias("nations"), F.countDistinct("c_mktsegment").alias("segments"))


@query("a09_quality_long", f"WITH l AS ({_long_sql('year')}) SELECT field, year, count(*) AS n, count(*) FILTER (value IS NULL) AS missing, count(DISTINCT value) AS distinct_values FROM l GROUP BY field, year")
def _(s, d):
    return audits.quality_long(plan.cohort(s, d), "year", _FIELDS)


@query("a10_token_missing", f"""WITH l AS ({_long_sql('role')}) SELECT field, role, count(*) AS n, count(*) FILTER (value IS NULL OR value = 'F') AS missing,
  count(DISTINCT CASE WHEN value IS NOT NULL AND value <> 'F' THEN value END) AS distinct_values FROM l GROUP BY field, role""")
def _(s, d):
    return audits.quality_long(plan.cohort(s, d), "role", _FIELDS, missing=("F",))


@query("a11_category_flags", """WITH g AS (SELECT month_code, count(*) AS n, count(*) FILTER (year = 2001) AS n_latest, count(*) FILTER (year <> 2001) AS n_before FROM cohort GROUP BY month_code)
SELECT *, n < 100 AS is_rare, n_before = 0 AS unseen_before, n_latest = 0 AS absent_latest,
  CASE WHEN n_before = 0 THEN 'fold_to_unseen' WHEN n < 100 THEN 'keep_and_report' ELSE 'keep' END AS action FROM g""")
def _(s, d):
    return audits.category_flags(plan.cohort(s, d), "month_code", "year", 2001)


_DICTIONARY = [("priority_code", str(i), f"level {i}") for i in range(1, 5)] + [("status", "F", "filled"), ("status", "O", "open")]
_DICT_SQL = ", ".join(f"('{f}', '{c}', '{x}')" for f, c, x in _DICTIONARY)
_CODE_AUDIT = f"""c AS (SELECT year, field, value, count(*) AS n FROM ({_long_sql('year', fields=('priority_code', 'status'))}) GROUP BY ALL),
a AS (SELECT c.field, c.value, c.year, c.n, k.label, k.label IS NOT NULL AS is_listed FROM c LEFT JOIN (VALUES {_DICT_SQL}) k(field, value, label) ON k.field = c.field AND k.value = c.value)"""


def code_audit(s, d):
    dictionary = s.createDataFrame(_DICTIONARY, "field string, code string, label string")
    return audits.code_audit(plan.cohort(s, d), ["year"], ["priority_code", "status"], dictionary)


@query("a13_code_audit", f"WITH {_CODE_AUDIT} SELECT * FROM a")
def _(s, d):
    return code_audit(s, d)


@query("a12_schema_audit", f"""WITH {_CODE_AUDIT} SELECT field, sum(n)::BIGINT AS n, sum(CASE WHEN value IS NULL THEN n ELSE 0 END)::BIGINT AS blank,
  sum(CASE WHEN NOT is_listed AND value IS NOT NULL THEN n ELSE 0 END)::BIGINT AS unknown FROM a GROUP BY field""")
def _(s, d):
    return audits.schema_audit(code_audit(s, d))


@query("a14_leakage_rollup", f"""WITH {_CODE_AUDIT}, r AS (SELECT field, sum(CASE WHEN NOT is_listed THEN n ELSE 0 END)::BIGINT AS unknown FROM a GROUP BY field)
SELECT field, unknown, CASE WHEN unknown > 0 THEN 'review' ELSE 'keep' END AS decision FROM r""")
def _(s, d):
    r = audits.schema_audit(code_audit(s, d)).select("field", "unknown")
    return r.withColumn("decision", F.when(F.col("unknown") > 0, "review").otherwise("keep"))


@query("a15_observed", f"""WITH l AS ({_long_sql('year')}) SELECT field, string_agg(DISTINCT year::VARCHAR, ';' ORDER BY year::VARCHAR) AS periods,
  string_agg(DISTINCT value, '|' ORDER BY value) AS observed FROM l WHERE value IS NOT NULL GROUP BY field""")
def _(s, d):
    return audits.observed_values(plan.cohort(s, d), _FIELDS, "year")


@query("a33_value_check", f"""WITH l AS ({_long_sql('year', fields=('priority_code', 'status'))}), o AS (SELECT field, string_agg(DISTINCT value, '|' ORDER BY value) AS observed FROM l GROUP BY field),
k AS (SELECT field, string_agg(code, '|' ORDER BY code) AS documented FROM (VALUES {_DICT_SQL}) t(field, code, label) GROUP BY field)
SELECT field, observed, documented, observed = documented AS matches FROM o JOIN k USING (field)""")
def _(s, d):
    seen = audits.observed_values(plan.cohort(s, d), ["priority_code", "status"], "year").drop("periods")
    known = s.createDataFrame(_DICTIONARY, "field string, code string, label string")
    told = known.groupBy("field").agg(F.concat_ws("|", F.sort_array(F.collect_set("code"))).alias("documented"))
    return seen.join(F.broadcast(told), "field").withColumn("matches", F.col("observed") == F.col("documented"))


@query("a16_sample_flow", """SELECT coalesce(year::VARCHAR, 'ALL') AS scope, count(*) AS read_rows, count(speed) AS with_speed, count(*) FILTER (role = 'train') AS in_train,
  count(*) - count(speed) AS lost FROM cohort GROUP BY ROLLUP (year)""")
def _(s, d):
    label = F.when(F.grouping("year") == 1, F.lit("ALL")).otherwise(F.col("year").cast("string"))
    return plan.cohort(s, d).rollup("year").agg(
        label.alias("scope"), F.count("*").alias("read_rows"), F.count("speed").alias("with_speed"),
        F.count_if(F.col("role") == "train").alias("in_train"), (F.count("*") - F.count("speed")).alias("lost"),
    ).drop("year")


@query("a18_split_audit", "SELECT role, count(*) AS n, count(DISTINCT id) AS ids, string_agg(DISTINCT year::VARCHAR, ';' ORDER BY year::VARCHAR) AS periods FROM cohort GROUP BY role")
def _(s, d):
    return audits.split_audit(plan.cohort(s, d), "role", "id", "year")


_DRIFT = """WITH f AS (SELECT year, priority_code, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY year) AS share FROM cohort GROUP BY year, priority_code),
g AS (SELECT y.year, v.priority_code, coalesce(f.share, 0.0) AS share FROM (SELECT DISTINCT year FROM f) y CROSS JOIN (SELECT DISTINCT priority_code FROM f) v LEFT JOIN f ON f.year = y.year AND f.priority_code = v.priority_code),
p AS (SELECT a.year AS left_period, b.year AS right_period, 0.5 * sum(abs(a.share - b.share)) AS tv, arg_max(a.priority_code, (round(abs(a.share - b.share), 12), a.priority_code)) AS most
      FROM g a JOIN g b ON a.priority_code = b.priority_code AND a.year < b.year GROUP BY 1, 2)"""


@query("a29_drift_tv", _DRIFT + " SELECT left_period, right_period, round(tv, 9) AS total_variation, most AS most_moved FROM p")
def _(s, d):
    return rounded(audits.drift(plan.cohort(s, d), "priority_code", "year"), "total_variation")


@query("w06_worst_drift", _DRIFT + " SELECT 'priority_code' AS field, round(tv, 9) AS total_variation, left_period, right_period FROM p ORDER BY round(tv, 9) DESC, left_period * 10000 + right_period LIMIT 1")
def _(s, d):
    moved = rounded(audits.drift(plan.cohort(s, d), "priority_code", "year"), "total_variation")
    moved = moved.withColumn("field", F.lit("priority_code")).withColumn("tie", F.col("left_period") * 10000 + F.col("right_period"))
    return windows.best_row(moved, ["field"], "total_variation", "tie", ["left_period", "right_period"])


@query("a30_coverage", """WITH t AS (SELECT DISTINCT segment || month_code AS v FROM cohort WHERE role = 'train' AND month <> 7), x AS (SELECT role, segment || month_code AS v FROM cohort)
SELECT role, count(*) AS n, count(*) FILTER (t.v IS NULL AND x.v IS NOT NULL) AS unseen_rows, count(DISTINCT CASE WHEN t.v IS NULL THEN x.v END) AS unseen_values,
  round(count(*) FILTER (t.v IS NULL AND x.v IS NOT NULL)::DOUBLE / count(*), 9) AS unseen_share FROM x LEFT JOIN t USING (v) GROUP BY role""")
def _(s, d):
    df = plan.cohort(s, d).withColumn("v", F.concat("segment", "month_code"))
    return rounded(audits.coverage(df, df.where("role = 'train' AND month <> 7"), "v", "role"), "unseen_share")


@query("j08_unseen", "SELECT DISTINCT p_type, p_brand FROM part p WHERE p_size > 25 AND NOT EXISTS (SELECT 1 FROM part t WHERE t.p_size <= 25 AND t.p_type = p.p_type AND t.p_brand = p.p_brand)", False)
def _(s, d):
    parts = plan.read(s, d, "part")
    seen = parts.where("p_size <= 25").select("p_type", "p_brand")
    return guards.outside(parts.where("p_size > 25"), seen, "p_type", "p_brand").select("p_type", "p_brand").distinct()


# --- decoding ----------------------------------------------------------------------------------------------------

_CODE = "(o_custkey % 9)::VARCHAR || CASE WHEN o_custkey % 2 = 0 THEN '.0' ELSE '' END"


@query("p05_normalize_code", f"SELECT o_orderkey, ((o_custkey % 9)::INT)::VARCHAR AS code FROM orders", False)
def _(s, d):
    raw = F.concat(F.pmod("o_custkey", F.lit(9)).cast("string"), F.when(F.pmod("o_custkey", F.lit(2)) == 0, ".0").otherwise(""))
    return plan.read(s, d, "orders").select("o_orderkey", C.normalize_code(raw).alias("code"))


@query("p06_decode", "SELECT id, priority_code || ':' || priority_label AS decoded, coalesce(speed::VARCHAR, '__CSV_MISSING__') AS speed_text FROM cohort")
def _(s, d):
    return plan.cohort(s, d).select("id", F.concat_ws(":", "priority_code", "priority_label").alias("decoded"), F.coalesce(F.col("speed").cast("string"), F.lit(C.CSV_MISSING)).alias("speed_text"))


@query("p07_recode", "SELECT id, 2 - target AS severity FROM cohort")
def _(s, d):
    return plan.cohort(s, d).select("id", C.recode(F.col("target"), {0: 2, 1: 1, 2: 0}).alias("severity"))


@query("p08_canonical", "SELECT id, CASE WHEN speed IS NULL THEN '__SOURCE_MISSING__' ELSE speed::VARCHAR END AS category FROM cohort")
def _(s, d):
    return plan.cohort(s, d).select("id", C.canonical_category(F.concat(F.col("speed").cast("string"), F.lit(".0"))).alias("category"))


@query("p09_sentinel", "SELECT id, speed::DOUBLE AS speed FROM cohort")
def _(s, d):
    return plan.cohort(s, d).select("id", F.col("speed").cast("double").alias("speed"))


@query("p10_checked_number", "SELECT id, speed::DOUBLE AS number FROM cohort")
def _(s, d):
    return plan.cohort(s, d).select("id", C.checked_number(F.coalesce(F.col("speed").cast("string"), F.lit(" "))).alias("number"))


@query("p11_dates", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, 'M' || lpad(month(o_orderdate)::VARCHAR, 2, '0') AS month_code FROM orders", False)
def _(s, d):
    shown = F.date_format("o_orderdate", "dd/MM/yyyy")
    date = C.parsed_date(shown)
    return plan.read(s, d, "orders").select("o_orderkey", F.date_format(date, "yyyy-MM-dd").alias("iso"), C.month_code(date).alias("month_code"))


@query("p12_hours", "SELECT event_id, 'H' || lpad(hour(ts)::VARCHAR, 2, '0') AS hour_code FROM events", False)
def _(s, d):
    return plan.read(s, d, "events").select("event_id", C.hour_code(F.date_format("ts", "HH:mm")).alias("hour_code"))


@query("p13_key", "SELECT 'ORD-' || o_orderkey::VARCHAR AS key FROM orders", False)
def _(s, d):
    return plan.read(s, d, "orders").select(F.concat(F.lit("ORD-"), F.col("o_orderkey").cast("string")).alias("key"))


_RULES = (("^[ol]_.*key$", "id"), ("date$", "time"), ("(price|discount|tax|quantity)$", "number"), ("(status|flag|priority|mode)$", "category"), (".*", "other"))


@query("p14_classify", """SELECT name, CASE WHEN regexp_matches(name, '^[ol]_.*key$') THEN 'id' WHEN regexp_matches(name, 'date$') THEN 'time'
  WHEN regexp_matches(name, '(price|discount|tax|quantity)$') THEN 'number' WHEN regexp_matches(name, '(status|flag|priority|mode)$') THEN 'category' ELSE 'other' END AS role
FROM (VALUES ('o_orderkey'), ('o_custkey'), ('o_orderstatus'), ('o_totalprice'), ('o_orderdate'), ('o_orderpriority')) t(name)""", False)
def _(s, d):
    names = plan.read(s, d, "orders").columns
    wanted = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    return s.createDataFrame([(n,) for n in names if n in wanted], "name string").select("name", C.classify(F.col("name"), _RULES).alias("role"))


@query("p15_fold", """WITH v AS (SELECT DISTINCT month_code FROM cohort WHERE role = 'train' AND month <= 9)
SELECT c.id, coalesce(v.month_code, '__UNSEEN__') AS folded FROM cohort c LEFT JOIN v USING (month_code)""")
def _(s, d):
    from ordeval.models.features import fold_to_vocabulary, vocabulary

    df = plan.cohort(s, d)
    return fold_to_vocabulary(df, "month_code", vocabulary(df.where("role = 'train' AND month <= 9"), "month_code")).select("id", F.col("month_code").alias("folded"))


@query("p16_paired_outcome", f"SELECT id, {_OUTCOME} AS outcome FROM predicted")
def _(s, d):
    return plan.predicted(plan.cohort(s, d)).select("id", C.paired_outcome(F.col("target"), F.col("pred_a"), F.col("pred_b")).alias("outcome"))


_COST = "CASE true_code * 3 + predicted_code " + " ".join(f"WHEN {3 * i + j} THEN {C.COSTS[i][j]}" for i, j in _CELLS) + " END"


@query("p17_error_attrs", f"""SELECT model, true_code, predicted_code, count(*) AS n, CASE WHEN predicted_code > true_code THEN 'over' WHEN predicted_code < true_code THEN 'under' ELSE 'correct' END AS direction,
  sum({_COST})::BIGINT AS cost FROM modelled GROUP BY model, true_code, predicted_code""")
def _(s, d):
    t, p = F.col("true_code"), F.col("predicted_code")
    return modelled(s, d).groupBy("model", "true_code", "predicted_code").agg(F.count("*").alias("n"), F.any_value(C.direction(t, p)).alias("direction"), F.sum(C.asymmetric_cost(t, p)).alias("cost"))


@query("p18_orientation", "SELECT unnest([" + ", ".join(f"'{m}'" for m in metrics.METRICS) + "]) AS metric, unnest([" + ", ".join("-1" if m in C.LOWER_IS_BETTER else "1" for m in metrics.METRICS) + "])::INT AS sign", False)
def _(s, d):
    return s.createDataFrame([(m,) for m in metrics.METRICS], "metric string").select("metric", C.orientation(F.col("metric")).alias("sign"))


@query("p21_argmax", "SELECT id, (CASE WHEN q0 >= q1 AND q0 >= q2 THEN 0 WHEN q1 >= q2 THEN 1 ELSE 2 END)::INT AS predicted FROM predicted")
def _(s, d):
    return plan.predicted(plan.cohort(s, d)).select("id", C.argmax_class(F.col("prob")).alias("predicted"))


@query("p22_normalise", "SELECT id, round(q0 / (q0 + q1 + q2), 9) AS p0, round(q2 / (q0 + q1 + q2), 9) AS p2 FROM predicted")
def _(s, d):
    p = C.normalised(F.col("prob"))
    return rounded(plan.predicted(plan.cohort(s, d)).select("id", F.get(p, F.lit(0)).alias("p0"), F.get(p, F.lit(2)).alias("p2")), "p0", "p2")


# --- windows, sorts, sets ----------------------------------------------------------------------------------------


@query("w01_share", "SELECT event_type, user_id, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY event_type), 9) AS share FROM events GROUP BY event_type, user_id", False)
def _(s, d):
    return rounded(windows.with_group_share(audits.counts(plan.read(s, d, "events"), "event_type", "user_id"), "n", "event_type"), "share")


@query("w02_avg_rank", "SELECT p_partkey, p_brand, rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0::DOUBLE AS rank FROM part", False)
def _(s, d):
    return ranks.average_rank(plan.read(s, d, "part").select("p_partkey", "p_brand", "p_size"), "p_size", "p_brand").drop("p_size")


@query("w03_topk", """SELECT model, true_code, predicted_code, id, place FROM (SELECT *, row_number() OVER (PARTITION BY model, true_code, predicted_code ORDER BY round(greatest(q0, q1, q2) / qs, 9) DESC, id)::INT AS place
  FROM modelled WHERE role = 'test' AND true_code <> predicted_code) WHERE place <= 5""")
def _(s, d):
    wrong = modelled(s, d).where("role = 'test' AND true_code <> predicted_code").withColumn("confidence", F.round(F.array_max("prob"), 9))
    keys = ["model", "true_code", "predicted_code"]
    return windows.top_rows(wrong, keys, [F.desc("confidence"), F.asc("id")], 5).select(*keys, "id", "place")


def candidates(s, d):
    """Candidates: the predictors on each validation segment, with made-up complexity."""
    df = modelled(s, d).where("role = 'validation'").withColumn("candidate", F.concat_ws("-", "model", "segment"))
    out = metrics.metrics(metrics.confusion_counts(df, ["candidate"]), ["candidate"], ("macro_f1", "qwk", "recall_2"), digits=9)
    return out.withColumn("complexity", F.length("candidate"))


@query("w07_select", f"""WITH x AS (SELECT model || '-' || segment AS candidate, true_code, predicted_code FROM modelled WHERE role = 'validation'), w AS ({counts_sql('x', 'candidate')}),
m AS (SELECT candidate, ({_N})::BIGINT AS n, {metrics_sql(('macro_f1', 'qwk', 'recall_2'))}, length(candidate)::INT AS complexity FROM w), e AS (SELECT *, qwk >= 0.0 - 0.01 AND recall_2 >= 0.1 - 0.05 AS eligible FROM m),
f AS (SELECT *, bool_or(eligible) OVER () AS any_eligible FROM e)
SELECT candidate, n, macro_f1, qwk, recall_2, complexity, eligible, any_eligible FROM f WHERE eligible OR NOT any_eligible ORDER BY macro_f1 DESC, qwk DESC, recall_2 DESC, complexity, candidate LIMIT 1""")
def _(s, d):
    return windows.select_candidate(candidates(s, d), 0.0, 0.1)


@query("o04_codes_first", "SELECT value, row_number() OVER (ORDER BY NOT regexp_matches(value, '^-?\\d+$'), try_cast(value AS BIGINT), value)::INT AS place FROM (SELECT DISTINCT unnest([o_orderstatus, (o_custkey % 12)::VARCHAR]) AS value FROM orders)", False)
def _(s, d):
    values = plan.read(s, d, "orders").select(F.explode(F.array("o_orderstatus", F.pmod("o_custkey", F.lit(12)).cast("string"))).alias("value")).distinct()
    return ranks.global_place(values, windows.codes_first("value")).withColumn("place", F.col("place").cast("int"))


@query("o05_ordered_head", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25", False)
def _(s, d):
    return plan.read(s, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("s06_first_rows", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 10", False)
def _(s, d):
    return readers.first_rows(plan.read(s, d, "customer").select("c_custkey", "c_name"), 10, "c_custkey")


@query("s14_page_links", """SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY g) - 1)::INT AS place, length(x) > 0 AS has_text
FROM (SELECT page_id, unnest(l) AS x, unnest(range(len(l))) AS g FROM (SELECT page_id, regexp_extract_all(html, '(?is)<p(?:\\s[^>]*)?>(.*?)</p>', 1) AS l FROM pages))""", False)
def _(s, d):
    texts = readers.tagged_texts(plan.read(s, d, "pages"), "p", "html", "page_id")
    raw = F.regexp_extract_all("html", F.lit(r"(?is)<p(?:\s[^>]*)?>(.*?)</p>"), 1)
    found = plan.read(s, d, "pages").select("page_id", F.posexplode(raw).alias("place", "x"))
    return texts.join(found, ["page_id", "place"]).select("page_id", "place", (F.length("x") > 0).alias("has_text"))


@query("u01_union", "SELECT s_nationkey AS nation, 'supplier' AS side FROM supplier UNION ALL SELECT c_nationkey, 'customer' FROM customer", False)
def _(s, d):
    a = plan.read(s, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.lit("supplier").alias("side"))
    return a.unionByName(plan.read(s, d, "customer").select(F.col("c_nationkey").alias("nation"), F.lit("customer").alias("side")))


@query("u02_symmetric_diff", """WITH a AS (SELECT DISTINCT custkey FROM cohort WHERE role = 'validation'), b AS (SELECT DISTINCT custkey FROM cohort WHERE role = 'test')
SELECT custkey, 'only_validation' AS side FROM a WHERE custkey NOT IN (SELECT custkey FROM b) UNION ALL SELECT custkey, 'only_test' FROM b WHERE custkey NOT IN (SELECT custkey FROM a)""")
def _(s, d):
    df = plan.cohort(s, d)
    return joins.labelled_difference(df.where("role = 'validation'"), df.where("role = 'test'"), ["custkey"], "only_validation", "only_test")


@query("u03_difference", "SELECT DISTINCT custkey FROM cohort WHERE role = 'train' EXCEPT SELECT custkey FROM cohort WHERE role = 'test'")
def _(s, d):
    df = plan.cohort(s, d)
    return df.where("role = 'train'").select("custkey").subtract(df.where("role = 'test'").select("custkey"))


@query("u04_disjoint", """SELECT custkey, count(DISTINCT role) AS roles, string_agg(DISTINCT role, ';' ORDER BY role) AS found FROM cohort GROUP BY custkey HAVING count(DISTINCT role) > 1""")
def _(s, d):
    return guards.shared_ids(plan.cohort(s, d), "custkey", "role")


@query("u07_cover", "SELECT count(*) AS assigned_rows, count(DISTINCT id) AS assigned_ids, (SELECT count(DISTINCT o_orderkey) FROM orders) AS expected_ids, count(*) = count(DISTINCT id) AND count(DISTINCT id) = (SELECT count(DISTINCT o_orderkey) FROM orders) AS is_partition FROM cohort")
def _(s, d):
    return guards.cover_summary(plan.cohort(s, d), plan.read(s, d, "orders").select(F.col("o_orderkey").alias("id")), "id")


# --- filters and guards ------------------------------------------------------------------------------------------


@query("f01_masks", "SELECT id FROM cohort WHERE year = 1998 AND status = 'F' AND priority_code IN ('1', '2') AND target <> 0")
def _(s, d):
    return plan.cohort(s, d).where((F.col("year") == 1998) & (F.col("status") == "F") & F.col("priority_code").isin("1", "2") & (F.col("target") != 0)).select("id")


@query("f04_regex", "SELECT c_custkey FROM customer WHERE regexp_matches(c_name, '(?i)customer.*[05]$')", False)
def _(s, d):
    return plan.read(s, d, "customer").where(F.col("c_name").rlike("(?i)customer.*[05]$")).select("c_custkey")


@query("f07_without_year", "SELECT role, year, count(*) AS n FROM cohort WHERE NOT (role = 'train' AND year = 1997) GROUP BY role, year")
def _(s, d):
    return audits.counts(splits.without_period(plan.cohort(s, d), "role", "year", 1997), "role", "year")


@query("f08_repeated_keys", "SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1", False)
def _(s, d):
    return guards.repeated_keys(plan.read(s, d, "lineitem"), "l_orderkey", "l_linenumber")


@query("f09_domain", "SELECT value, 'unexpected' AS problem FROM (SELECT DISTINCT o_orderstatus AS value FROM orders) WHERE value NOT IN ('F', 'X') UNION ALL SELECT 'X', 'missing'", False)
def _(s, d):
    return guards.domain_differences(plan.read(s, d, "orders"), "o_orderstatus", ["F", "X"])


@query("f10_simplex", "SELECT id FROM predicted WHERE abs(q0 / 300.0 + q1 / 300.0 + q2 / 300.0 - 1) > 0.5")
def _(s, d):
    df = plan.predicted(plan.cohort(s, d)).select("id", *[(F.get("prob", F.lit(i)) * 0 + (F.pmod(C.hash32(F.concat(F.lit(f"p{i}:"), F.col("id").cast("string"))), F.lit(97)) + 1) / 300.0).alias(f"p{i}") for i in range(3)])
    return guards.simplex_violations(df, ["p0", "p1", "p2"], 0.5).select("id")


@query("f11_constant", "SELECT 'status' AS column, count(DISTINCT status) AS values FROM cohort WHERE role = 'test'")
def _(s, d):
    df = plan.cohort(s, d).where("role = 'test'").withColumn("role_text", F.col("role"))
    return guards.varying_columns(df, "role_text", "status").withColumn("values", F.col("values").cast("long"))


# --- joins -------------------------------------------------------------------------------------------------------

_M2 = ("macro_f1", "accuracy")


@query("j01_outer_delta", f"""WITH w AS ({counts_sql('modelled', 'role', 'model')}), m AS (SELECT role, model, {metrics_sql(_M2)} FROM w)
SELECT coalesce(a.role, b.role) AS role, a.macro_f1 AS macro_f1_a, a.accuracy AS accuracy_a, b.macro_f1 AS macro_f1_b, b.accuracy AS accuracy_b,
  round(a.macro_f1 - b.macro_f1, 9) + 0.0 AS macro_f1_delta, round(a.accuracy - b.accuracy, 9) + 0.0 AS accuracy_delta
FROM (SELECT * FROM m WHERE model = 'A') a FULL OUTER JOIN (SELECT * FROM m WHERE model = 'B') b ON a.role = b.role""")
def _(s, d):
    m = metrics.metrics(metrics.confusion_counts(modelled(s, d), ["role", "model"]), ["role", "model"], _M2, digits=9)
    side = lambda k: m.where(F.col("model") == k).select("role", *[F.col(c).alias(f"{c}_{k.lower()}") for c in _M2])
    out = joins.with_deltas(joins.one_to_one(side("A"), side("B"), ["role"]), _M2)
    return rounded(out, "macro_f1_delta", "accuracy_delta")


@query("j02_left_dim", "SELECT o_orderkey, c_name, c_nationkey FROM orders LEFT JOIN customer ON c_custkey = o_custkey", False)
def _(s, d):
    facts = plan.read(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("key"))
    dim = plan.read(s, d, "customer").select(F.col("c_custkey").alias("key"), "c_name", "c_nationkey")
    return joins.many_to_one(facts, dim, ["key"]).drop("key")


@query("j05_alignment", """SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'only_right' WHEN b.id IS NULL THEN 'only_left' ELSE 'different' END AS problem
FROM (SELECT id, target FROM cohort WHERE month <> 3) a FULL OUTER JOIN (SELECT id, CASE WHEN month = 1 THEN 2 - target ELSE target END AS target FROM cohort WHERE month <> 4) b ON a.id = b.id
WHERE a.id IS NULL OR b.id IS NULL OR a.target <> b.target""")
def _(s, d):
    df = plan.cohort(s, d).select("id", "target", "month")  # each side lacks a month, one month differs
    right = df.where("month <> 4").withColumn("target", F.when(F.col("month") == 1, 2 - F.col("target")).otherwise(F.col("target")))
    return guards.misaligned(df.where("month <> 3").drop("month"), right.drop("month"), "id", "target")


@query("j06_stack", "SELECT id, max(CASE WHEN model = 'A' THEN predicted_code END) AS pred_A, max(CASE WHEN model = 'B' THEN predicted_code END) AS pred_B FROM modelled GROUP BY id")
def _(s, d):
    return joins.stacked_predictions(modelled(s, d), "id", "model", "predicted_code", ["A", "B"])


@query("j09_sides", "SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'missing' WHEN a.k IS NULL THEN 'extra' ELSE 'common' END AS side FROM (SELECT DISTINCT c_custkey AS k FROM customer) a FULL OUTER JOIN (SELECT DISTINCT o_custkey AS k FROM orders) b ON a.k = b.k", False)
def _(s, d):
    a = plan.read(s, d, "customer").select(F.col("c_custkey").alias("k")).distinct()
    b = plan.read(s, d, "orders").select(F.col("o_custkey").alias("k")).distinct()
    return joins.outer_sides(a, b, ["k"])


# --- sampling and resampling -------------------------------------------------------------------------------------


@query("r01_temporal_roles", "SELECT role, year, count(*) AS n FROM cohort GROUP BY role, year")
def _(s, d):
    return audits.counts(plan.cohort(s, d), "role", "year")


_QUOTA = """q AS (SELECT target, n_class, exact, floor(exact)::BIGINT AS low, round(exact - floor(exact), 9) AS rest FROM (SELECT target, count(*) AS n_class, 500 * count(*)::DOUBLE / sum(count(*)) OVER () AS exact FROM cohort WHERE role = 'train' GROUP BY target)),
quotas AS (SELECT target, n_class, low + CASE WHEN row_number() OVER (ORDER BY rest DESC, target) <= 500 - sum(low) OVER () THEN 1 ELSE 0 END AS quota FROM q)"""


@query("r04_allocation", f"WITH {_QUOTA} SELECT target, n_class, quota FROM quotas")
def _(s, d):
    return splits.proportional_allocation(splits.class_sizes(plan.cohort(s, d).where("role = 'train'"), "target"), "target", 500)


@query("r05_sample", f"""WITH {_QUOTA}, r AS (SELECT id, target, row_number() OVER (PARTITION BY target ORDER BY {HASH.format("'1103:' || id::VARCHAR")}, id) AS rk FROM cohort WHERE role = 'train')
SELECT r.id, r.target FROM r JOIN quotas USING (target) WHERE rk <= quota""")
def _(s, d):
    return splits.stratified_sample(plan.cohort(s, d).where("role = 'train'").select("id", "target"), 500, 1103, "id", "target")


@query("r06_matched", f"""WITH k AS (SELECT target, count(*) AS quota FROM cohort WHERE role = 'test' GROUP BY target), r AS (SELECT id, target, row_number() OVER (PARTITION BY target ORDER BY {HASH.format("'2207:' || id::VARCHAR")}, id) AS rk FROM cohort WHERE role = 'train')
SELECT r.id, r.target FROM r JOIN k USING (target) WHERE rk <= quota""")
def _(s, d):
    df = plan.cohort(s, d).select("id", "target", "role")
    return splits.matched_sample(df.where("role = 'train'").drop("role"), df.where("role = 'test'"), 2207, "id", "target")


SLOT_DRAWS = 50
_SLOTS = f"""t AS (SELECT id, target, pred_b FROM predicted WHERE role = 'test'), n AS (SELECT target, count(*) AS n FROM t GROUP BY target),
r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY {HASH.format("'0:' || id::VARCHAR")}, id) AS rk FROM t),
slots AS (SELECT i.i AS iteration, r.target, {HASH.format("i.i::VARCHAR || ':' || r.target::VARCHAR || ':' || r.rk::VARCHAR")} % n.n + 1 AS rk FROM r JOIN n USING (target), range({SLOT_DRAWS}) i(i)),
picks AS (SELECT iteration, r.target AS true_code, r.pred_b AS predicted_code FROM slots JOIN r ON r.target = slots.target AND r.rk = slots.rk)"""


def slot_counts(s, d):
    df = plan.predicted(plan.cohort(s, d)).where("role = 'test'").select("id", "target", "pred_b")
    picks = resample.slot_bootstrap(df, "id", "target", SLOT_DRAWS, ["pred_b"])
    cell = lambda i, j: F.sum(F.when((F.col("target") == i) & (F.col("pred_b") == j), F.col("times")).otherwise(0)).alias(f"c{i}{j}")
    return picks.groupBy("iteration").agg(*[cell(i, j) for i, j in metrics.CELLS])


@query("r10_slot_bootstrap", f"WITH {_SLOTS} SELECT iteration::INT AS iteration, {', '.join(f'count(*) FILTER (true_code = {i} AND predicted_code = {j}) AS c{i}{j}' for i, j in _CELLS)} FROM picks GROUP BY iteration")
def _(s, d):
    return slot_counts(s, d)


@query("a26_interval", f"""WITH {_SLOTS}, w AS ({counts_sql('picks', 'iteration')}), v AS ({' UNION ALL '.join(f"SELECT '{m}' AS metric, {METRIC_SQL[m]} AS value FROM w" for m in metrics.METRICS)})
SELECT metric, count(value) AS draws, round(quantile_cont(value, 0.025), 9) + 0.0 AS low, round(quantile_cont(value, 0.975), 9) + 0.0 AS high FROM v GROUP BY metric""")
def _(s, d):
    draws = metrics.long_metrics(metrics.metrics(slot_counts(s, d), ["iteration"]), ["iteration"])
    return rounded(metrics.intervals(draws, ["metric"]), "low", "high")


def joint_draws(s, d, iterations=2000):
    stacked = plan.predicted(plan.cohort(s, d)).select("role", "target", "pred_a", "pred_b")
    patterns = resample.pattern_counts(stacked, ["role"], "target", ["pred_a", "pred_b"])
    return resample.bootstrap_confusions(patterns, ["role"], "target", ["pred_a", "pred_b"], iterations, 20240101)


def joint_values(s, d):
    """(role, model, iteration, metric, value)."""
    return metrics.long_metrics(metrics.metrics(joint_draws(s, d), ["role", "model", "iteration"]), ["role", "model", "iteration"])


@query("r09_joint_bootstrap")
def _(s, d):
    return metrics.intervals(joint_values(s, d), ["role", "model", "metric"])


@query("r12_paired_deltas")
def _(s, d):
    """Intervals of the paired differences, judged from the observed difference."""
    keys = ["role", "metric"]
    observed = joins.cohort_gap(model_values(s, d), "B", "A", keys, cohort="model")
    return resample.judged_intervals(joins.cohort_gap(joint_values(s, d), "pred_b", "pred_a", [*keys, "iteration"], cohort="model"), observed, keys, "gap")


@query("r12_independent_gaps")
def _(s, d):
    """H1: validation minus test of each predictor, from the cohorts' own draws."""
    draws = joint_values(s, d).withColumn("model", F.upper(F.substring_index("model", "_", -1)))
    return resample.independent_gaps(draws, model_values(s, d), "validation", "test", ["model", "metric"])


@query("r11_bootstrap_means")
def _(s, d):
    """Intervals of the mean absolute attribution of all test rows, 2,000 draws stratified by class."""
    wide = attributions(s, d).groupBy("id", "target").pivot("feature", ["f1", "f2", "f3"]).agg(F.first(F.abs("value")))
    drawn = means.bootstrap_means(wide, [], "target", ["f1", "f2", "f3"], 2000, 3301)
    return metrics.intervals(drawn.unpivot(["iteration"], ["f1", "f2", "f3"], "feature", "value"), ["feature"])


# --- verification ------------------------------------------------------------------------------------------------


@query("v02_table_diff", """WITH a AS (SELECT c_custkey AS k, c_acctbal AS x, c_mktsegment AS t FROM customer WHERE c_nationkey <> 3),
b AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 17 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS x, CASE WHEN c_custkey % 13 = 0 THEN 'OTHER' ELSE c_mktsegment END AS t FROM customer WHERE c_nationkey <> 4)
SELECT coalesce(a.k, b.k) AS k, NULL AS column, CASE WHEN b.k IS NULL THEN 'missing_key' ELSE 'extra_key' END AS problem FROM a FULL OUTER JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL
UNION ALL SELECT a.k, 'x', 'different' FROM a JOIN b ON a.k = b.k WHERE a.x <> b.x UNION ALL SELECT a.k, 't', 'different' FROM a JOIN b ON a.k = b.k WHERE a.t <> b.t""", False)
def _(s, d):
    c = plan.read(s, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("x"), F.col("c_mktsegment").alias("t"), "c_nationkey")
    other = c.where("c_nationkey <> 4").select("k", F.when(F.col("k") % 17 == 0, F.col("x") + 1).otherwise(F.col("x")).alias("x"), F.when(F.col("k") % 13 == 0, F.lit("OTHER")).otherwise(F.col("t")).alias("t"))
    return verify.table_differences(c.where("c_nationkey <> 3").drop("c_nationkey"), other, ["k"], exact=("t",)).select("k", "column", "problem")


@query("v06_pred_deviation", """SELECT count(*) AS n, count(*) FILTER (pred_a <> pred_b) AS labels_changed, round(max(abs(q0 - q1) / (q0 + q1 + q2)), 9) AS max_p FROM predicted WHERE role = 'test'""")
def _(s, d):
    df = plan.predicted(plan.cohort(s, d)).where("role = 'test'")
    a = df.select("id", F.col("pred_a").alias("label"), F.get("prob", F.lit(0)).alias("p"))
    b = df.select("id", F.col("pred_b").alias("label"), F.get("prob", F.lit(1)).alias("p"))
    return rounded(verify.prediction_deviation(a, b, "id", "label", ["p"]), "max_p")


@query("v09_recompute", f"""WITH w AS ({counts_sql('modelled', 'role', 'model')}) , a AS (SELECT role, model, count(*) FILTER (true_code = predicted_code)::DOUBLE / count(*) AS again FROM modelled GROUP BY role, model)
SELECT role, model, abs({METRIC_SQL['accuracy']} - again) <= 1e-10 AS matches FROM w JOIN a USING (role, model)""")
def _(s, d):
    m = metrics.metrics(metrics.confusion_counts(modelled(s, d), ["role", "model"]), ["role", "model"])
    direct = modelled(s, d).groupBy("role", "model").agg(F.avg((F.col("true_code") == F.col("predicted_code")).cast("double")).alias("again"))
    return m.join(direct, ["role", "model"]).select("role", "model", C.close(F.col("accuracy"), F.col("again")).alias("matches"))


@query("v10_contract", "SELECT count(*) AS n, count(DISTINCT id) = count(*) AS ids_unique, count(*) FILTER (id IS NULL) = 0 AS ids_complete, count(*) FILTER ((year = 2001) <> (role = 'test')) = 0 AS latest_locked FROM cohort")
def _(s, d):
    return verify.data_contract(plan.cohort(s, d), "id", "role", "year", 2001)


# --- features and models -----------------------------------------------------------------------------------------


@query("m01_vocabulary", f"""WITH l AS ({_long_sql(fields=('priority_code', 'status', 'month_code'), source="(SELECT * FROM cohort WHERE role = 'train')")})
SELECT field, value AS level, (row_number() OVER (PARTITION BY field ORDER BY value) - 1)::INT AS place FROM (SELECT DISTINCT field, value FROM l)""")
def _(s, d):
    from ordeval.models.features import vocabularies

    return vocabularies(plan.cohort(s, d).where("role = 'train'"), ["priority_code", "status", "month_code"])


@query("m04_impute_scale", """WITH f AS (SELECT quantile_cont(speed, 0.5) AS med FROM cohort WHERE role = 'train'), x AS (SELECT coalesce(speed, med)::DOUBLE AS v FROM cohort, f WHERE role = 'train'),
g AS (SELECT avg(v) AS mean, stddev_pop(v) AS sd FROM x) SELECT id, round((coalesce(speed, med) - mean) / sd, 9) + 0.0 AS speed_scaled, (speed IS NULL)::INT AS speed_missing FROM cohort, f, g""")
def _(s, d):
    from ordeval.models.features import NumericScaler

    df = plan.cohort(s, d)
    scaled = NumericScaler.fit(df.where("role = 'train'"), ["speed"]).transform(df)
    return rounded(scaled.select("id", "speed_scaled", "speed_missing"), "speed_scaled")


def queries() -> dict[str, Query]:
    from ordeval import audit_queries, file_queries, more_queries, study_queries, table_queries  # noqa: F401  register their queries
    from ordeval.models import queries as model_queries

    return {**_QUERIES, **model_queries.queries()}


def oracle_sql() -> dict[str, str]:
    from ordeval import audit_queries, file_queries, more_queries, study_queries, table_queries  # noqa: F401
    from ordeval.models import queries as model_queries

    return {**_SQL, **{name: f"WITH {COHORT_SQL}, {sql}" for name, sql in model_queries.oracle_sql().items()}}
