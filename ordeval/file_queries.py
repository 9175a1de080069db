"""Registered round trips of readers and writers: a table is written to the shared folder, read back and compared."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordeval.operators import metrics, windows
from ordeval.plans import cohort as plan
from ordeval.queries import _SLOTS, METRIC_SQL, counts_sql, query, rounded, slot_counts
from ordeval.sources import readers, writers
from ordeval.sources.shared import new_path

_CUSTOMER = T.StructType([
    T.StructField("c_custkey", T.LongType()), T.StructField("c_name", T.StringType()),
    T.StructField("c_acctbal", T.DoubleType()), T.StructField("c_mktsegment", T.StringType()),
])


def customers(s, d):
    return plan.read(s, d, "customer").select(*[F.col(f.name).cast(f.dataType) for f in _CUSTOMER])


def as_csv(s, df, gzip=False):
    path = new_path(s, "csv")
    writers.write_csv(df, path, gzip)
    return path


@query("s01_typed_csv", "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer", False)
def _(s, d):
    return readers.read_csv(s, as_csv(s, customers(s, d)), _CUSTOMER)


@query("s02_text_columns", "SELECT c_custkey::VARCHAR AS c_custkey, c_mktsegment FROM customer", False)
def _(s, d):
    path = as_csv(s, customers(s, d))
    return readers.read_csv(s, path, readers.text_schema(_CUSTOMER.names), ["c_custkey", "c_mktsegment"])


@query("s03_header", "SELECT column_name AS \"column\", ordinal_position::INT AS place FROM (VALUES ('c_custkey', 1), ('c_name', 2), ('c_acctbal', 3), ('c_mktsegment', 4)) t(column_name, ordinal_position)", False)
def _(s, d):
    names = readers.header(s, as_csv(s, customers(s, d)))
    return s.createDataFrame([(n, i + 1) for i, n in enumerate(names)], "column string, place int")


@query("s07_missing_policy", "SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'NA' WHEN 2 THEN 'None' WHEN 3 THEN 'null' ELSE c_name END AS c_name FROM customer", False)
def _(s, d):
    k = F.pmod("c_custkey", F.lit(5))
    text = F.when(k == 1, "NA").when(k == 2, "None").when(k == 3, "null").when(k == 4, F.col("c_name"))
    schema = T.StructType(_CUSTOMER.fields[:2])
    return readers.read_csv(s, as_csv(s, customers(s, d).select("c_custkey", text.alias("c_name"))), schema)


@query("s08_gzip_csv", "SELECT c_mktsegment, count(*) AS n, sum(c_custkey)::BIGINT AS ids FROM customer GROUP BY 1", False)
def _(s, d):
    got = readers.read_csv(s, as_csv(s, customers(s, d), gzip=True), _CUSTOMER)
    return got.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.sum("c_custkey").alias("ids"))


@query("s09_json_lines", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_name END AS c_name, c_acctbal, c_mktsegment FROM customer", False)
def _(s, d):
    path = new_path(s, "json")
    writers.write_json_lines(customers(s, d).withColumn("c_name", F.when(F.col("c_acctbal") >= 0, F.col("c_name"))), path)
    return readers.read_json_lines(s, path, _CUSTOMER)


@query("s10_field_order", "SELECT name, place::INT AS place FROM (VALUES ('c_custkey', 0), ('c_name', 1), ('c_acctbal', 2), ('c_mktsegment', 3)) t(name, place)", False)
def _(s, d):
    path = new_path(s, "json")
    writers.write_json_lines(customers(s, d), path)
    return s.createDataFrame(list(enumerate(readers.require_same_field_order(s, path))), "place int, name string")


@query("s15_period_split", "SELECT year(o_orderdate)::INT AS year, count(*) AS n, sum(o_orderkey)::BIGINT AS ids FROM orders GROUP BY 1", False)
def _(s, d):
    path = new_path(s, "periods")
    orders = plan.read(s, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"))
    writers.write_periods(orders, path, "year")
    return s.read.parquet(path).groupBy("year").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("ids"))


@query("s16_periods", "SELECT year(o_orderdate)::INT AS period, count(*) AS n, sum(o_orderkey)::BIGINT AS ids FROM orders GROUP BY 1", False)
def _(s, d):
    orders = plan.read(s, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"))
    path = new_path(s, "years")
    orders.hint("rebalance", "year").write.partitionBy("year").csv(path, header=True)
    years = sorted(r["year"] for r in orders.select("year").distinct().collect())
    schema = T.StructType([T.StructField("o_orderkey", T.LongType())])
    got = readers.read_periods(s, {y: f"{path}/year={y}" for y in years}, schema)
    return got.groupBy("period").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("ids"))


@query("s17_manifest_status", """SELECT status, count(*) AS n FROM (SELECT CASE o_orderstatus WHEN 'F' THEN 'SIZE_MISMATCH' WHEN 'O' THEN 'SHA256_MISMATCH' ELSE 'PASS' END AS status
FROM (SELECT DISTINCT o_orderstatus FROM orders) UNION ALL SELECT 'MISSING') GROUP BY 1""", False)
def _(s, d):
    path = new_path(s, "files")
    orders = plan.read(s, d, "orders").select("o_orderkey", "o_orderstatus").hint("rebalance", "o_orderstatus")
    orders.write.partitionBy("o_orderstatus").json(path)
    found = readers.file_manifest(s, f"{path}/*", "*.json")
    is_in = lambda x: F.contains("path", F.lit(f"o_orderstatus={x}/"))
    changed = found.select(
        "path", (F.col("bytes") + is_in("F").cast("long")).alias("bytes"),
        F.when(is_in("O"), F.sha2("path", 256)).otherwise(F.col("sha256")).alias("sha256"),
    )
    gone = s.createDataFrame([(f"{path}/gone.json", 1, "0")], "path string, bytes long, sha256 string")
    folder = F.regexp_extract("path", r"([^/]*)/[^/]*$", 1)  # a status has one folder of one file or more
    return readers.manifest_status(changed.unionByName(gone), found).groupBy("status").agg(F.countDistinct(folder).alias("n"))


@query("k03_rows", "SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region", False)
def _(s, d):
    schema = T.StructType([T.StructField("r_regionkey", T.LongType()), T.StructField("r_name", T.StringType())])
    path = new_path(s, "rows")
    rows = plan.read(s, d, "region").select("r_regionkey", "r_name").collect()  # the five regions
    writers.write_rows(s, [r.asDict() for r in rows], schema, path)
    return readers.read_csv(s, path, schema)


@query("k04_exact_doubles", "SELECT c_custkey, c_acctbal / 7.0::DOUBLE AS seventh FROM customer", False)
def _(s, d):
    schema = T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("seventh", T.DoubleType())])
    return readers.read_csv(s, as_csv(s, customers(s, d).select("c_custkey", (F.col("c_acctbal") / 7.0).alias("seventh"))), schema)


@query("k05_json_document", "SELECT count(*) AS n, min(c_mktsegment) AS first_segment FROM customer", False)
def _(s, d):
    row = customers(s, d).agg(F.count("*").alias("n"), F.min("c_mktsegment").alias("first_segment")).first()
    path = new_path(s, "document")
    for value in ({"old": True}, row.asDict()):  # the second takes the place of the first
        writers.write_json_atomic(s, value, path)
    return s.read.schema("n long, first_segment string").json(path)


@query("k06_saved_draws", f"""WITH {_SLOTS}, w AS ({counts_sql('picks', 'iteration')}), v AS ({' UNION ALL '.join(f"SELECT iteration::INT AS iteration, '{m}' AS metric, {METRIC_SQL[m]} AS value FROM w" for m in metrics.METRICS)})
SELECT iteration, metric, round(value, 9) + 0.0 AS value FROM v""")
def _(s, d):
    """Draws are a long table, written and read again."""
    path = new_path(s, "draws")
    metrics.long_metrics(metrics.metrics(slot_counts(s, d), ["iteration"]), ["iteration"]).write.parquet(path)
    return rounded(s.read.parquet(path).select("iteration", "metric", "value"), "value")


def nation_files(s, d):
    return plan.read(s, d, "nation").select(
        F.concat_ws("/", F.col("n_regionkey").cast("string"), "n_name").alias("path"),
        F.length("n_name").cast("long").alias("bytes"), F.sha2("n_name", 256).alias("sha256"),
    )


@query("k11_merged_manifests", "SELECT n_regionkey::VARCHAR || '/' || n_name AS path, 2::BIGINT AS manifests, length(n_name) > 6 AS conflict FROM nation", False)
def _(s, d):
    one = nation_files(s, d)
    other = one.withColumn("sha256", F.when(F.col("bytes") > 6, F.sha2("sha256", 256)).otherwise(F.col("sha256")))
    return readers.merged_manifests(one, other)


@query("v12_seals", """WITH f AS (SELECT n_regionkey::VARCHAR AS folder, sha256(n_name) || ' ' || n_regionkey::VARCHAR || '/' || n_name AS line FROM nation),
g AS (SELECT folder, sha256(string_agg(line, chr(10) ORDER BY line)) AS seal FROM f GROUP BY folder)
SELECT 'all' AS folder, sha256(string_agg(seal || ' ' || folder, chr(10) ORDER BY seal || ' ' || folder)) AS seal FROM g UNION ALL SELECT folder, seal FROM g""", False)
def _(s, d):
    """Folders are sealed from their files, and all folders from their seals."""
    folders = readers.seals(nation_files(s, d), F.substring_index("path", "/", 1))
    tree = folders.select(F.col("folder").alias("path"), F.col("seal").alias("sha256"))
    return readers.seals(tree, F.lit("all")).unionByName(folders)


@query("o07_last_rows", "SELECT event_type, event_id, place FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC)::INT AS place FROM events) WHERE place <= 5", False)
def _(s, d):
    """The last five of each kind."""
    order = [F.desc("ts"), F.desc("event_id")]
    return windows.top_rows(plan.read(s, d, "events"), ["event_type"], order, 5).select("event_type", "event_id", "place")


@query("u06_ordered_distinct", """SELECT custkey, string_agg(status, '|' ORDER BY first_id) AS statuses FROM (SELECT o_custkey AS custkey, o_orderstatus AS status, min(o_orderkey) AS first_id FROM orders GROUP BY 1, 2) GROUP BY custkey""", False)
def _(s, d):
    """Distinct values in the order of their first appearance."""
    firsts = plan.read(s, d, "orders").groupBy(F.col("o_custkey").alias("custkey"), "o_orderstatus").agg(F.min("o_orderkey").alias("first_id"))
    found = F.array_sort(F.collect_list(F.struct("first_id", "o_orderstatus")))
    return firsts.groupBy("custkey").agg(F.array_join(F.transform(found, lambda x: x["o_orderstatus"]), "|").alias("statuses"))
