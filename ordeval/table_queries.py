"""Registered queries of table functions, checked scans, ordered digests and sealed stages."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from ordeval.file_queries import customers
from ordeval.functions import tables
from ordeval.functions.columns import is_safe_path
from ordeval.operators import verify
from ordeval.plans import cohort as plan
from ordeval.plans.ledger import Ledger, Stage
from ordeval.queries import query
from ordeval.sources import writers
from ordeval.sources.rejects import read_checked
from ordeval.sources.shared import new_path


@query("d05_table_cells", r"""SELECT page_id, 0 AS "table", 0 AS depth, 0 AS "row", (i - 1)::INT AS cell, 1 AS row_span, 1 AS cell_span, false AS header,
  trim(regexp_replace(replace(replace(replace(replace(x[i], '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')) AS text
FROM (SELECT page_id, regexp_extract_all(html, '(?s)<li><a[^>]*>(.*?)</a></li>', 1) AS x FROM pages), range(1, 1000) r(i) WHERE i <= len(x)""", False)
def _(s, d):
    """Each page's menu, made a table of one row, one row for each cell."""
    cell = F.regexp_replace(F.regexp_replace("html", "<li><a[^>]*>", "<td>"), "</a></li>", "</td>")
    html = F.regexp_replace(F.regexp_replace(cell, "<ul>", "<table><tr>"), "</ul>", "</table>")
    return tables.html_table_cells(plan.read(s, d, "pages").select("page_id", html.alias("html"))).drop("html")


def customer_workbooks(s, d):
    """(nation, part, content): a workbook for each nation and thousand of customer keys, with a sheet of customers and another."""

    def write(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("c_custkey")
        rows = [["c_name", "c_custkey", "c_mktsegment", "c_acctbal"], *[[n, int(k), g, float(b)] for n, k, g, b in zip(own["c_name"], own["c_custkey"], own["c_mktsegment"], own["c_acctbal"], strict=True)]]
        one = own.iloc[0]
        content = tables.workbook({"notes": [["written by"], ["nobody <&>"]], "customers": rows})
        return pd.DataFrame({"nation": [one["nation"]], "part": [one["part"]], "content": [content]})

    rows = plan.read(s, d, "customer").select(
        F.col("c_nationkey").cast("int").alias("nation"), F.floor(F.col("c_custkey") / 1000).cast("int").alias("part"), "c_custkey", "c_name", "c_mktsegment", "c_acctbal"
    )
    return rows.groupBy("nation", "part").applyInPandas(write, "nation int, part int, content binary")


@query("s11_workbooks", """SELECT c_nationkey::INT AS nation, (row_number() OVER (PARTITION BY c_nationkey, c_custkey // 1000 ORDER BY c_custkey) + 1)::INT AS row, c_custkey, c_acctbal::DOUBLE AS c_acctbal, c_name
FROM customer""", False)
def _(s, d):
    """One sheet of many workbooks, three of its four columns."""
    path = new_path(s, "workbooks")
    customer_workbooks(s, d).write.parquet(path)
    rows, problems = tables.read_workbooks(s.read.parquet(path), "customers", ["c_custkey", "c_acctbal", "c_name"])
    checked = rows.unionByName(problems.select("nation", "part", "row", *[F.raise_error("problem").alias(c) for c in ("c_custkey", "c_acctbal", "c_name")]))
    return checked.select("nation", "row", F.col("c_custkey").cast("long").alias("c_custkey"), F.col("c_acctbal").cast("double").alias("c_acctbal"), "c_name")


@query("s21_rejects", """WITH r AS (SELECT CASE WHEN c_custkey % 11 = 0 THEN 'overlong' WHEN c_custkey % 13 = 0 THEN 'short' WHEN c_custkey % 17 = 0 THEN 'unreadable' WHEN c_custkey % 19 = 0 THEN 'repeated_header' END AS reason, c_custkey FROM customer)
SELECT coalesce(reason, 'good') AS reason, count(*) AS n, CASE WHEN reason IS NULL OR reason = 'overlong' THEN sum(c_custkey)::BIGINT END AS ids FROM r GROUP BY reason""", False)
def _(s, d):
    """Good rows and rejected lines of files whose faults are known."""
    path, key = new_path(s, "faulty"), F.col("c_custkey")
    quoted = F.concat(F.lit('"'), "c_name", F.lit(', "",'), "c_mktsegment", F.lit('"'))
    line = F.concat_ws(",", key.cast("string"), quoted)
    faulty = (
        F.when(key % 11 == 0, F.concat(line, F.lit(",more"))).when(key % 13 == 0, key.cast("string")).when(key % 17 == 0, F.concat(key.cast("string"), F.lit(',"open')))
        .when(key % 19 == 0, F.lit("key,said")).otherwise(line)
    )

    def headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"value": ["key,said"]})
        yield from batches

    customers(s, d).select(faulty.alias("value")).repartition(4).mapInArrow(headed, "value string").write.text(path)  # a header in each file
    good, rejected = read_checked(s, path, ["key", "said"])
    sums = good.agg(F.lit("good").alias("reason"), F.count("*").alias("n"), F.sum(F.col("key").cast("long")).alias("ids"))
    number = F.when(F.col("reason") == "overlong", F.regexp_extract("raw", r"^\d+", 0).cast("long"))
    return sums.unionByName(rejected.groupBy("reason").agg(F.count("*").alias("n"), F.sum(number).alias("ids")))


_LEAF = r"sha256(o_orderkey::VARCHAR || chr(31) || coalesce(CASE WHEN o_custkey % 7 <> 0 THEN o_orderstatus END, '\N'))"
_TREE = f"l0 AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS place, {_LEAF} AS d FROM orders)" + "".join(
    f", l{i + 1} AS (SELECT place // 1024 AS place, sha256(string_agg(d, chr(10) ORDER BY place)) AS d FROM l{i} GROUP BY place // 1024)" for i in range(4)
)


@query("k02_ordered_digest", f"WITH {_TREE} SELECT (SELECT count(*) FROM orders) AS n, d AS digest FROM l4", False)
def _(s, d):
    """The digest of the orders in order of their key, nulls included."""
    rows = plan.read(s, d, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 7 != 0, F.col("o_orderstatus")).alias("status"))
    return verify.ordered_digest(rows, ["o_orderkey"], ["o_orderkey", "status"])


def _cohort_stage(s, inputs):
    return inputs["orders"].select(F.col("o_orderkey").alias("id"), F.year("o_orderdate").alias("year"), F.when(F.col("o_totalprice") >= 390000, 1).otherwise(0).alias("target"))


def _counts_stage(s, inputs):
    return inputs["cohort"].groupBy("year", "target").agg(F.count("*").alias("n"))


def _totals_stage(s, inputs):
    return inputs["counts"].groupBy("target").agg(F.sum("n").alias("n"))


@query("x02_sealed_stages", """SELECT 'cohort' AS stage, count(*) AS n, 'ran' AS first, 'sealed' AS second FROM orders
UNION ALL SELECT 'counts', count(*), 'ran', 'sealed' FROM (SELECT DISTINCT year(o_orderdate), o_totalprice >= 390000 FROM orders)
UNION ALL SELECT 'totals', count(*), 'ran', 'sealed' FROM (SELECT DISTINCT o_totalprice >= 390000 FROM orders)""", False)
def _(s, d):
    """Three stages over the orders, run and then resumed; rows of each and what the two runs did with it."""
    stages = [Stage("cohort", _cohort_stage, ("orders",)), Stage("counts", _counts_stage, ("cohort",)), Stage("totals", _totals_stage, ("counts",))]
    ledger, sources, out = Ledger(s, new_path(s, "ledger")), {"orders": plan.read(s, d, "orders")}, None
    ledger.run(stages, sources)
    first = ledger.did
    found = ledger.run(stages, sources)
    for name, df in found.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("stage"), "n", F.lit(first[name]).alias("first"), F.lit(ledger.did[name]).alias("second"))
        out = row if out is None else out.unionByName(row)
    return out


@query("k09_report", """SELECT line FROM (SELECT '# Orders by year' AS line UNION ALL SELECT '' UNION ALL SELECT '| year | n | total |' UNION ALL SELECT '| --- | --- | --- |'
UNION ALL SELECT '| ' || year(o_orderdate)::VARCHAR || ' | ' || count(*)::VARCHAR || ' | ' || sum(o_orderkey)::VARCHAR || ' |' FROM orders GROUP BY year(o_orderdate))""", False)
def _(s, d):
    """A report of a small table, read again line by line."""
    years = plan.read(s, d, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("total")).orderBy("year")
    path = new_path(s, "report") + ".md"
    writers.write_report({"Orders by year": years}, path)
    return s.read.text(path).select(F.col("value").alias("line"))


@query("h01_safe_paths", r"""WITH p AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN substr(path, 2) WHEN 1 THEN path WHEN 2 THEN 'a/../' || substr(path, 2) WHEN 3 THEN 'c:' || path ELSE replace(substr(path, 2), '/', '\') END AS path
FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]*(/[^?#]*)', 1) AS path FROM pages))
SELECT page_id, path, path <> '' AND NOT regexp_matches(path, '[\\\x00-\x1f]|^[A-Za-z]:') AND len(list_filter(string_split(path, '/'), lambda x: x IN ('', '.', '..'))) = 0 AS safe FROM p""", False)
def _(s, d):
    """Path safety: the paths of all pages, some of them made unsafe."""
    path = F.regexp_extract("url", "^[a-z]+://[^/]*(/[^?#]*)", 1)
    below = F.substring(path, 2, 1 << 30)
    k = F.col("page_id") % 5
    made = F.when(k == 0, below).when(k == 1, path).when(k == 2, F.concat(F.lit("a/../"), below)).when(k == 3, F.concat(F.lit("c:"), path)).otherwise(F.translate(below, "/", "\\"))
    return plan.read(s, d, "pages").select("page_id", made.alias("path")).withColumn("safe", is_safe_path(F.col("path")))
