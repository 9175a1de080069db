"""Registered queries of audits by period and field, rules over rows, and tables with intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ordeval.functions import columns as C
from ordeval.operators import audits, guards, metrics, resample, verify
from ordeval.plans import cohort as plan
from ordeval.queries import _DICT_SQL, _DICTIONARY, _SLOTS, _VALUES, METRIC_SQL, counts_sql, joint_values, model_values, query, rounded, slot_counts
from ordeval.sources import readers
from ordeval.study_queries import _COHORTS, _DRAWS, _judged_sql, cohort_draws, observed_values, to_nine

_AUDITED = ("priority_code", "status", "month_code", "speed")
_FORMATS = {"month_code": "^M(0[1-9]|1[01])$", "speed": "^[234]0$"}
_FIELD_AUDIT = f"""l AS ({' UNION ALL '.join(f"SELECT year, '{f}' AS field, {i + 1} AS position, {f}::VARCHAR AS value FROM cohort" for i, f in enumerate(_AUDITED))}),
d AS (SELECT * FROM (VALUES {_DICT_SQL}) k(field, code, label)),
fa AS (SELECT year, field, position, count(value) > 0 AS present, count(*) AS n, count(value) AS non_missing,
  count(*) FILTER (value IS NOT NULL AND field IN (SELECT field FROM d) AND NOT EXISTS (SELECT 1 FROM d WHERE d.field = l.field AND d.code = l.value)) AS unknown,
  count(*) FILTER ({' OR '.join(f"(field = '{f}' AND NOT regexp_matches(value, '{p}'))" for f, p in _FORMATS.items())}) AS format_issue
FROM l GROUP BY year, field, position)"""


def field_audit(s, d):
    dictionary = s.createDataFrame(_DICTIONARY, "field string, code string, label string")
    return audits.field_audit(plan.cohort(s, d), "year", _AUDITED, dictionary, _FORMATS)


@query("a12_field_audit", f"WITH {_FIELD_AUDIT} SELECT * FROM fa")
def _(s, d):
    """By year and field, with position, unknown codes and format issues."""
    return field_audit(s, d)


_KINDS = (("priority_code", "at_event"), ("status", "after_event"), ("speed", "at_event"))


@query("a14_rule_audit", f"""WITH {_FIELD_AUDIT}, r AS (SELECT * FROM (VALUES {', '.join(f"('{f}', '{k}')" for f, k in _KINDS)}) t(field, kind))
SELECT field, kind, sum(n)::BIGINT AS n, sum(n - non_missing)::BIGINT AS blank, sum(unknown)::BIGINT AS unknown,
  CASE WHEN kind IS NULL THEN 'review_no_rule' WHEN kind = 'after_event' THEN 'exclude' WHEN sum(unknown) > 0 THEN 'review_codes' ELSE 'keep' END AS decision
FROM fa LEFT JOIN r USING (field) GROUP BY field, kind""")
def _(s, d):
    return audits.rule_audit(field_audit(s, d), s.createDataFrame(list(_KINDS), "field string, kind string"))


@query("a09_numeric_domain", """WITH l AS (SELECT year(o_orderdate)::INT AS year, 'price' AS field, o_totalprice::DOUBLE AS value FROM orders
UNION ALL SELECT year(o_orderdate)::INT, 'shifted', CASE WHEN o_custkey % 5 <> 0 THEN (o_custkey % 9 - 4)::DOUBLE END FROM orders)
SELECT field, year, count(*) AS n, count(*) - count(value) AS missing, count(DISTINCT value) AS distinct_values, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean,
  round(median(value), 6) AS median, count(*) FILTER (value < 0) AS negative, count(*) FILTER (value = 0) AS zero, count(*) FILTER (value <> floor(value)) AS fractional
FROM l GROUP BY field, year""", False)
def _(s, d):
    """The domain of two numbers by year."""
    rows = plan.read(s, d, "orders").select(
        F.year("o_orderdate").alias("year"), F.col("o_totalprice").cast("double").alias("price"),
        F.when(F.col("o_custkey") % 5 != 0, (F.col("o_custkey") % 9 - 4).cast("double")).alias("shifted"),
    )
    return rounded(audits.numeric_domain(rows, "year", ["price", "shifted"]), "mean", "median", digits=6)


_INTERVALS = f"""g AS (SELECT role, model, metric, value FROM v), og AS (SELECT role, model, metric, value FROM o)"""


def cohort_intervals(s, d):
    """(role, model, metric, draws, low, high, observed, evidence) from the slot draws of both cohorts."""
    return resample.judged_intervals(to_nine(cohort_draws(s, d)), to_nine(observed_values(s, d)), ["role", "model", "metric"], "value")


@query("a31_intervals", f"""WITH {_DRAWS}, {_INTERVALS}, j AS ({_judged_sql('role, model, metric')})
SELECT model, metric, {', '.join(f"max(CASE WHEN role = '{r}' THEN {c} END) AS {r}_{c}" for r in _COHORTS for c in ('observed', 'low', 'high'))},
  round(avg(observed), 9) + 0.0 AS mean, round(stddev_samp(observed), 9) + 0.0 AS sd FROM j GROUP BY model, metric""")
def _(s, d):
    """The main table by model and metric: each cohort's value with its interval, mean and deviation over cohorts."""
    found = rounded(cohort_intervals(s, d), "observed", "low", "high")
    cells = [F.max(F.when(F.col("role") == r, F.col(c))).alias(f"{r}_{c}") for r in _COHORTS for c in ("observed", "low", "high")]
    out = found.groupBy("model", "metric").agg(*cells, F.avg("observed").alias("mean"), F.stddev_samp("observed").alias("sd"))
    return rounded(out, "mean", "sd")


@query("a24_zero_crossings", f"""WITH {_DRAWS},
g AS (SELECT model, metric, a.value - b.value AS value FROM (SELECT model, metric, iteration, round(value, 9) AS value FROM v WHERE role = 'validation') a JOIN (SELECT model, metric, iteration, round(value, 9) AS value FROM v WHERE role = 'test') b USING (model, metric, iteration)),
og AS (SELECT model, metric, a.value - b.value AS value FROM (SELECT model, metric, round(value, 9) AS value FROM o WHERE role = 'validation') a JOIN (SELECT model, metric, round(value, 9) AS value FROM o WHERE role = 'test') b USING (model, metric)),
j AS ({_judged_sql('model, metric')})
SELECT model, count(*) AS intervals, count(*) FILTER (low <= 0 AND high >= 0) AS crossing_zero, count(*) FILTER (low > 0) AS above_zero, count(*) FILTER (high < 0) AS below_zero FROM j GROUP BY model""")
def _(s, d):
    """How many intervals of the gap between cohorts hold zero, lie above or below it."""
    gaps = resample.independent_gaps(to_nine(cohort_draws(s, d)), to_nine(observed_values(s, d)), *_COHORTS, ["model", "metric"])
    return metrics.zero_crossings(rounded(gaps, "low", "high"), ["model"])


@query("a26_joint_intervals")
def _(s, d):
    """Intervals of 2,000 joint draws beside the observed values; the draws come from counts, not from rows."""
    drawn = joint_values(s, d).withColumn("model", F.upper(F.substring("model", 6, 1)))
    return resample.judged_intervals(drawn, model_values(s, d), ["role", "model", "metric"], "value")


@query("s14_link_texts", r"""SELECT page_id, (i - 1)::INT AS place, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(x[i], '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS value
FROM (SELECT page_id, regexp_extract_all(html, '(?is)<a(?:\s[^>]*)?>(.*?)</a>', 1) AS x FROM pages), range(1, 100000) r(i) WHERE i <= len(x)""", False)
def _(s, d):
    """The text of every link."""
    return readers.tagged_texts(plan.read(s, d, "pages"), "a", "html", "page_id")


_TYPES = (("^(LARGE|JUMBO|WRAP)", "large"), ("(DRUM|CAN|JAR)$", "round"), ("(BOX|CASE|PACK|PKG)$", "box"), (".*", "other"))


@query("p14_classified_parts", f"""SELECT kind, p_brand, count(*) AS n FROM (SELECT p_brand, CASE {' '.join(f"WHEN regexp_matches(p_type, '{p}') THEN '{k}'" for p, k in _TYPES)} END AS kind FROM part) GROUP BY kind, p_brand""", False)
def _(s, d):
    """Ordered rules over the types of all parts; the first that matches counts."""
    return plan.read(s, d, "part").select("p_brand", C.classify(F.col("p_type"), _TYPES).alias("kind")).groupBy("kind", "p_brand").agg(F.count("*").alias("n"))


@query("p18_oriented", f"""WITH {_VALUES} SELECT role, model, metric, round(CASE WHEN metric IN ({', '.join(repr(m) for m in C.LOWER_IS_BETTER)}) THEN -1 ELSE 1 END * value, 9) + 0.0 AS oriented FROM v""")
def _(s, d):
    """Every metric of every cohort and model, larger being better."""
    values = model_values(s, d).withColumn("oriented", C.orientation(F.col("metric")) * F.col("value"))
    return rounded(values.select("role", "model", "metric", "oriented"), "oriented")


_DOCUMENTED = (("priority_code", "urgency at entry"), ("status", "state of the order"), ("weather", "not in the table"))


@query("j13_field_docs", f"""WITH l AS ({' UNION ALL '.join(f"SELECT '{f}' AS field, {f}::VARCHAR AS value FROM cohort" for f in _AUDITED)}),
k AS (SELECT * FROM (VALUES {', '.join(f"('{f}', '{t}')" for f, t in _DOCUMENTED)}) t(field, note))
SELECT field, count(*) AS n, count(DISTINCT value) AS distinct_values, note, note IS NOT NULL AS documented FROM l LEFT JOIN k USING (field) GROUP BY field, note""")
def _(s, d):
    """What is observed of each field, with its documentation where there is any."""
    found = audits.column_profile(plan.cohort(s, d), _AUDITED).select("field", "n", "distinct_values")
    out = audits.described_fields(found, s.createDataFrame(list(_DOCUMENTED), "field string, note string"))
    return out.withColumn("documented", F.col("note").isNotNull())


@query("r13_row_streams", """SELECT c_custkey, ('0x' || substr(h, 15, 2) || substr(h, 13, 2) || substr(h, 11, 2) || substr(h, 9, 2) || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2))::UBIGINT::VARCHAR AS seed
FROM (SELECT c_custkey, sha256('7|' || c_mktsegment || '|' || c_custkey::VARCHAR) AS h FROM customer)""", False)
def _(s, d):
    """A seed of each customer's own stream, from its name."""
    name = F.concat_ws("|", F.lit("7"), "c_mktsegment", F.col("c_custkey").cast("string"))
    return plan.read(s, d, "customer").select("c_custkey", resample.stream_seed_column(name).alias("seed"))


@query("f10_violations", """SELECT id FROM (SELECT id, CASE WHEN id % 7 = 0 THEN 1.1 ELSE 1.0 END AS f, q0 / qs AS a, q1 / qs AS b, q2 / qs AS c FROM (SELECT *, q0 + q1 + q2 AS qs FROM predicted))
WHERE abs(a * f + b * f + c * f - 1) > 1e-6 OR a * f > 1 OR b * f > 1 OR c * f > 1""")
def _(s, d):
    """rows whose probabilities don't sum to 1, some of them stretched."""
    stretch = F.when(F.col("id") % 7 == 0, 1.1).otherwise(1.0)
    rows = plan.predicted(plan.cohort(s, d)).select("id", F.transform("prob", lambda p: p * stretch).alias("stretched"))
    return guards.simplex_violations(rows, "stretched", 1e-6).select("id")


@query("v05_draw_values", f"""WITH {_SLOTS}, w AS ({counts_sql('picks', 'iteration')}), v AS (SELECT iteration::INT AS iteration, {METRIC_SQL['accuracy']} AS a, {METRIC_SQL['qwk']} AS b FROM w)
SELECT iteration, round(a, 9) + 0.0 AS expected, round(CASE WHEN b > 0 THEN a + b ELSE a END, 9) + 0.0 AS observed FROM v WHERE b > 1e-12""")
def _(s, d):
    """Draws of which some cells are shifted by another metric of theirs: those that differ, with both values."""
    both = metrics.metrics(slot_counts(s, d), ["iteration"], ("accuracy", "qwk"))
    value = F.when(F.col("qwk") > 0, F.col("accuracy") + F.col("qwk")).otherwise(F.col("accuracy"))
    found = verify.draw_differences(both.select("iteration", F.col("accuracy").alias("value")), both.select("iteration", value.alias("value")), ["iteration"])
    return rounded(found, "expected", "observed")
