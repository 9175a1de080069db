"""Registered queries of a study's last steps: uncertainty of gaps and contrasts from draws that SQL can repeat, encodings,
ordinal probabilities, named streams, snapshots."""

from __future__ import annotations

from pyspark.ml.feature import OneHotEncoder, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordeval.file_queries import customers
from ordeval.models import fit
from ordeval.operators import metrics, resample
from ordeval.plans import cohort as plan
from ordeval.queries import _CELLS, HASH, METRIC_SQL, SLOT_DRAWS, counts_sql, modelled, query, rounded
from ordeval.sources import readers, writers
from ordeval.sources.shared import new_path

_COHORTS = ("validation", "test")


def cohort_draws(s, d):
    """(role, model, iteration, metric, value): slot draws of the validation and the test cohort, each of its own stream; the
    two predictors share a draw."""
    rows = plan.predicted(plan.cohort(s, d)).select("id", "target", "role", "pred_a", "pred_b")
    keys = ["role", "model", "iteration"]
    both = None
    for role in _COHORTS:
        picks = resample.slot_bootstrap(rows.where(F.col("role") == role), "id", "target", SLOT_DRAWS, ["role", "pred_a", "pred_b"], role)
        both = picks if both is None else both.unionByName(picks)
    named = F.explode(F.array(*[F.struct(F.lit(m.upper()).alias("model"), F.col(f"pred_{m}").alias("predicted")) for m in "ab"]))
    long = both.select("role", "iteration", "target", "times", named.alias("m")).select("*", "m.*")
    cell = lambda i, j: F.sum(F.when((F.col("target") == i) & (F.col("predicted") == j), F.col("times")).otherwise(0)).alias(f"c{i}{j}")
    wide = long.groupBy(*keys).agg(*[cell(i, j) for i, j in _CELLS])
    return metrics.long_metrics(metrics.metrics(wide, keys), keys)


def observed_values(s, d):
    keys = ["role", "model"]
    return metrics.long_metrics(metrics.metrics(metrics.confusion_counts(modelled(s, d).where(F.col("role").isin(*_COHORTS)), keys), keys), keys)


def _values_sql(source: str, keys: str) -> str:
    return " UNION ALL ".join(f"SELECT {keys}, '{m}' AS metric, {METRIC_SQL[m]} AS value FROM {source}" for m in metrics.METRICS)


_DRAWS = f"""t AS (SELECT id, target, role, pred_a, pred_b FROM predicted WHERE role IN ('validation', 'test')),
n AS (SELECT role, target, count(*) AS n FROM t GROUP BY role, target),
r AS (SELECT *, row_number() OVER (PARTITION BY role, target ORDER BY {HASH.format("'0:' || id::VARCHAR")}, id) AS rk FROM t),
slots AS (SELECT i.i AS iteration, r.role, r.target, {HASH.format("r.role || ':' || i.i::VARCHAR || ':' || r.target::VARCHAR || ':' || r.rk::VARCHAR")} % n.n + 1 AS rk
  FROM r JOIN n USING (role, target), range({SLOT_DRAWS}) i(i)),
picks AS (SELECT iteration, role, r.target AS true_code, pred_a, pred_b FROM slots JOIN r USING (role, target, rk)),
long AS (SELECT iteration, role, true_code, 'A' AS model, pred_a AS predicted_code FROM picks UNION ALL SELECT iteration, role, true_code, 'B', pred_b FROM picks),
w AS ({counts_sql('long', 'role', 'model', 'iteration')}), v AS ({_values_sql('w', 'role, model, iteration')}),
ow AS ({counts_sql("(SELECT * FROM modelled WHERE role IN ('validation', 'test'))", 'role', 'model')}), o AS ({_values_sql('ow', 'role, model')})"""


def _judged_sql(keys: str) -> str:
    """From ``g`` (keys, value of each draw) and ``og`` (keys, value)."""
    return f"""SELECT {keys}, draws, round(low, 9) + 0.0 AS low, round(high, 9) + 0.0 AS high, round(value, 9) + 0.0 AS observed,
  CASE WHEN round(value, 9) > 0 AND round(low, 9) > 0 THEN 'clear_positive' WHEN round(value, 9) < 0 AND round(high, 9) < 0 THEN 'clear_negative' ELSE 'direction_uncertain' END AS evidence
FROM og JOIN (SELECT {keys}, count(value) AS draws, quantile_cont(value, 0.025) AS low, quantile_cont(value, 0.975) AS high FROM g GROUP BY {keys}) USING ({keys})"""


def to_nine(values, name="value"):
    """Values of sums in another order differ in the last bits: rounded before signs are taken."""
    return values.withColumn(name, F.round(name, 9))


@query("r12_gap_intervals", f"""WITH {_DRAWS},
g AS (SELECT model, metric, a.value - b.value AS value FROM (SELECT model, metric, iteration, round(value, 9) AS value FROM v WHERE role = 'validation') a JOIN (SELECT model, metric, iteration, round(value, 9) AS value FROM v WHERE role = 'test') b USING (model, metric, iteration)),
og AS (SELECT model, metric, a.value - b.value AS value FROM (SELECT model, metric, round(value, 9) AS value FROM o WHERE role = 'validation') a JOIN (SELECT model, metric, round(value, 9) AS value FROM o WHERE role = 'test') b USING (model, metric))
{_judged_sql('model, metric')}""")
def _(s, d):
    """H1 from independent draws."""
    got = resample.independent_gaps(to_nine(cohort_draws(s, d)), to_nine(observed_values(s, d)), *_COHORTS, ["model", "metric"])
    return rounded(got, "low", "high", "observed")


@query("r12_contrast_intervals", f"""WITH {_DRAWS}, k AS (SELECT * FROM (VALUES ('b_minus_a', 'A', -1.0::DOUBLE), ('b_minus_a', 'B', 1.0::DOUBLE), ('mean', 'A', 0.5::DOUBLE), ('mean', 'B', 0.5::DOUBLE)) t(contrast, model, weight)),
g AS (SELECT contrast, role, metric, iteration, sum(weight * round(value, 9)) AS value FROM v JOIN k USING (model) GROUP BY ALL),
og AS (SELECT contrast, role, metric, sum(weight * round(value, 9)) AS value FROM o JOIN k USING (model) GROUP BY ALL)
{_judged_sql('contrast, role, metric')}""")
def _(s, d):
    """H2 from paired draws."""
    named = [("b_minus_a", "A", -1.0), ("b_minus_a", "B", 1.0), ("mean", "A", 0.5), ("mean", "B", 0.5)]
    weights = s.createDataFrame(named, "contrast string, model string, weight double")
    got = resample.paired_contrasts(to_nine(cohort_draws(s, d)), to_nine(observed_values(s, d)), weights, ["role", "metric"])
    return rounded(got, "low", "high", "observed")


@query("r13_streams", """SELECT r_name AS name, ('0x' || substr(h, 15, 2) || substr(h, 13, 2) || substr(h, 11, 2) || substr(h, 9, 2) || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2))::UBIGINT::VARCHAR AS seed
FROM (SELECT r_name, sha256('7|' || r_name) AS h FROM region)""", False)
def _(s, d):
    names = [r["r_name"] for r in plan.read(s, d, "region").select("r_name").collect()]  # the five regions
    return s.createDataFrame([(n, str(resample.stream_seed(7, n))) for n in names], "name string, seed string")


@query("m02_one_hot", """WITH l AS (SELECT priority_code, (row_number() OVER (ORDER BY priority_code) - 1)::INT AS place FROM (SELECT DISTINCT priority_code FROM cohort WHERE role = 'train' AND priority_code <> '3'))
SELECT id, coalesce(place, (SELECT count(*) FROM l))::INT AS place, 1.0::DOUBLE AS total FROM cohort LEFT JOIN l USING (priority_code)""")
def _(s, d):
    """The slot that is 1 for each row; a level that training hasn't seen has the slot after all levels."""
    rows = plan.cohort(s, d).select("id", "role", "priority_code")
    index = StringIndexer(inputCol="priority_code", outputCol="i", stringOrderType="alphabetAsc", handleInvalid="keep")
    indexed = index.fit(rows.where("role = 'train' AND priority_code <> '3'")).transform(rows)
    hot = OneHotEncoder(inputCols=["i"], outputCols=["hot"], dropLast=False, handleInvalid="keep").fit(indexed).transform(indexed)
    slots = vector_to_array("hot")
    return hot.select(
        "id", (F.array_position(slots, 1.0) - 1).cast("int").alias("place"), F.aggregate(slots, F.lit(0.0), lambda a, x: a + x).alias("total")
    )


@query("m09_probabilities", """WITH c AS (SELECT id, 1.0 / (1.0 + exp((id % 11)::DOUBLE / 2.0 - 3.0 + 0.5)) AS c0, 1.0 / (1.0 + exp((id % 11)::DOUBLE / 2.0 - 3.0 - 1.25)) AS c1 FROM cohort)
SELECT id, round(c0, 9) AS p0, round(c1 - c0, 9) AS p1, round(1.0 - c1, 9) AS p2 FROM c""")
def _(s, d):
    margin = F.pmod("id", F.lit(11)).cast("double") / 2.0 - 3.0
    got = plan.cohort(s, d).select("id", fit.ordered_probabilities(margin, [-0.5, 1.25]).alias("p"))
    return rounded(got.select("id", *[F.get("p", F.lit(k)).alias(f"p{k}") for k in range(3)]), "p0", "p1", "p2")


@query("k08_snapshot_pair", "SELECT f.format, count(*) AS n, sum(c_custkey)::BIGINT AS ids, count(*) FILTER (c_acctbal < 0) AS lacking, 0::BIGINT AS differing FROM customer, (VALUES ('csv'), ('json')) f(format) GROUP BY f.format", False)
def _(s, d):
    """A snapshot as gz CSV and gz JSON lines, both read again and held against the table."""
    source = customers(s, d).withColumn("c_name", F.when(F.col("c_acctbal") >= 0, F.col("c_name")))
    schema = T.StructType(list(source.schema))
    csv, lines = new_path(s, "csv"), new_path(s, "json")
    writers.write_csv(source, csv, gzip=True)
    writers.write_json_lines(source, lines)
    read = {"csv": readers.read_csv(s, csv, schema), "json": readers.read_json_lines(s, lines, schema)}
    parts = [got.exceptAll(source).select(F.lit(1).alias("x"), F.lit(k).alias("format")) for k, got in read.items()]
    wrong = parts[0].unionByName(parts[1]).groupBy("format").agg(F.count("*").alias("wrong"))
    rows = read["csv"].withColumn("format", F.lit("csv")).unionByName(read["json"].withColumn("format", F.lit("json")))
    counts = rows.groupBy("format").agg(F.count("*").alias("n"), F.sum("c_custkey").alias("ids"), F.count_if(F.col("c_name").isNull()).alias("lacking"))
    return counts.join(wrong, "format", "left").select("format", "n", "ids", "lacking", F.coalesce("wrong", F.lit(0)).cast("long").alias("differing"))
