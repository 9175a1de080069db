"""Table functions, checked scans, ordered digests, documents that are replaced at once, sealed stages, shipped code."""

import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from ordeval.functions import tables
from ordeval.operators import verify
from ordeval.plans.ledger import Ledger, LedgerError, NotSealed, OutOfOrder, ProtocolChanged, Stage, Tampered, table_digest
from ordeval.sources.documents import names_in, read_document, remove, write_document
from ordeval.sources.rejects import read_checked

# --- D05, S14 ------------------------------------------------------------------------------------------------------


def cells(spark, html):
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    return [tuple(r)[2:] for r in tables.html_table_cells(df).orderBy("table", "row", "cell").collect()]


def test_cells_of_nested_tables_and_spans(spark):
    html = """<table><tr><th rowspan=2>a &amp; b<th colspan="2">c</tr><tr><td>d<td><p>e <b>f</b></p>
      <table><tr><td>inner<script>var x = "<td>no</td>"</script></table> after</tr></table>text<table><td>lone<sup>1</sup>"""
    assert cells(spark, html) == [
        (0, 0, 0, 0, 2, 1, True, "a & b"), (0, 0, 0, 1, 1, 2, True, "c"), (0, 0, 1, 1, 1, 1, False, "d"), (0, 0, 1, 2, 1, 1, False, "e f after"),
        (1, 1, 0, 0, 1, 1, False, "inner"), (2, 0, 0, 0, 1, 1, False, "lone"),
    ]
    assert cells(spark, "<td>no table</td>") == [] and cells(spark, "") == [] and cells(spark, None) == []
    assert cells(spark, "<table><tr><td colspan=x>" + "<i>" * 5000 + "deep")[0][-1] == "deep"


# --- S11 -----------------------------------------------------------------------------------------------------------


def test_workbooks_round_trip(spark, tmp_path):
    rows = [["k", "text", "n"], [1, "a <&> \"b\"", 1.5], [2, None, None], [3, " padded ", -0.1]]
    for name, sheets in {"a": {"other": [["x"], ["y"]], "data": rows}, "b": {"data": [["n", "k"], [7, 8]]}, "c": {"data": [["k", "k", "n"]]}, "d": {"none": [["k"]]}}.items():
        (tmp_path / f"{name}.xlsx").write_bytes(tables.workbook(sheets))
    (tmp_path / "e.xlsx").write_bytes(b"not a workbook")
    files = spark.read.format("binaryFile").load(str(tmp_path)).select(F.substring_index("path", "/", -1).alias("file"), "content")
    got, problems = tables.read_workbooks(files, "data", ["n", "k"])
    assert sorted(tuple(r) for r in got.collect()) == [("a.xlsx", 2, "1.5", "1"), ("a.xlsx", 3, None, "2"), ("a.xlsx", 4, "-0.1", "3"), ("b.xlsx", 2, "7", "8")]
    assert sorted((r["file"], r["problem"].split(":")[0]) for r in problems.collect()) == [("c.xlsx", "repeated column names"), ("e.xlsx", "BadZipFile")]
    text, _ = tables.read_workbooks(files.where("file = 'a.xlsx'"), "data", ["text"])
    assert [r["text"] for r in text.orderBy("row").collect()] == ['a <&> "b"', None, " padded "]


def test_workbook_of_shared_strings(spark):
    import io
    import zipfile

    plain = tables.workbook({"s": [["h"], ["v"]]})
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(plain)) as old, zipfile.ZipFile(out, "w") as new:
        for n in old.namelist():
            new.writestr(n, old.read(n).replace(b't="inlineStr"><is><t xml:space="preserve">v</t></is>', b't="s"><v>1</v>'))
        main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
        new.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>zero</t></si><si><r><t>on</t></r><r><t>e</t></r><rPh><t>no</t></rPh></si></sst>')
    assert list(tables.workbook_sheets(out.getvalue(), "s")) == [("s", 1, ["h"]), ("s", 2, ["one"])]


# --- S21 -----------------------------------------------------------------------------------------------------------


def test_rejected_lines_are_found_by_line(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿k,v\n1,x\n2\n\n3,"a,b"\n4,x,y\nk,v\n5,"open\n6,\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text("k,k\n1,x\n")
    (tmp_path / "c.csv").write_text("v,k\n1,x\n2,y\n")
    (tmp_path / "d.csv").write_text("k,v\n" + "".join(f"{i},v{i}\n" if i % 1000 else f"{i}\n" for i in range(1, 20001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")  # several parts of a file
    try:
        good, rejected = (df.withColumn("file", F.substring_index("file", "/", -1)) for df in read_checked(spark, str(tmp_path), ["k", "v"]))
        assert sorted(tuple(r) for r in good.where("file = 'a.csv'").collect()) == [("a.csv", 2, "1", "x"), ("a.csv", 5, "3", "a,b"), ("a.csv", 9, "6", None)]
        found = sorted((r["file"], r["line"], r["reason"]) for r in rejected.where("file <> 'd.csv'").collect())
        assert found == [
            ("a.csv", 3, "short"), ("a.csv", 6, "overlong"), ("a.csv", 7, "repeated_header"), ("a.csv", 8, "unreadable"),
            ("b.csv", 1, "duplicate_header"), ("b.csv", 2, "under_bad_header"), ("c.csv", 1, "wrong_header"), ("c.csv", 2, "under_bad_header"), ("c.csv", 3, "under_bad_header"),
        ]
        assert sorted((r["line"], r["raw"]) for r in rejected.where("file = 'd.csv'").collect()) == [(1000 * i + 1, str(1000 * i)) for i in range(1, 21)]
        assert good.where("file = 'd.csv' AND line <> k + 1").count() == 0 and good.where("file = 'd.csv'").count() == 19980
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


# --- K02 -----------------------------------------------------------------------------------------------------------


def test_ordered_digest_depends_on_order_alone(spark):
    df = spark.range(5000).select("id", (F.col("id") * 7 % 11).alias("x"), F.when(F.col("id") % 3 > 0, F.lit("a")).alias("t"))
    of = lambda d: tuple(verify.ordered_digest(d, ["id"], ["x", "t"], fan=16).first())
    one = of(df.repartition(1))
    assert one == of(df.repartition(200)) == of(df.orderBy(F.desc("id"))) and one[0] == 5000
    swapped = df.withColumn("id", F.when(F.col("id") == 100, 101).when(F.col("id") == 101, 100).otherwise(F.col("id")))
    assert of(swapped)[1] != one[1]
    assert of(df.where("id < 0"))[0] == 0
    assert of(df.withColumn("t", F.coalesce("t", F.lit("")))) != one  # null isn't empty
    with pytest.raises(ValueError, match="levels"):
        verify.ordered_digest(df, ["id"], ["x"], fan=8)


def test_seals_of_large_folders_are_trees(spark):
    import hashlib

    from ordeval.sources import readers

    files = [(f"{k}/f{i}", 1, f"{i * 7 % 50:02d}") for k, n in (("a", 3), ("b", 10), ("c", 28)) for i in range(n)]
    manifest = spark.createDataFrame(files, "path string, bytes long, sha256 string").repartition(5)
    sha = lambda lines: hashlib.sha256("\n".join(lines).encode()).hexdigest()
    want = {}
    for k in "abc":
        lines = sorted(f"{s} {p}" for p, _, s in files if p[0] == k)
        for _ in range(4):  # levels that the largest folder needs
            lines = [sha(lines[i : i + 3]) for i in range(0, len(lines), 3)]
        want[k] = lines[0]
    folder = F.substring_index("path", "/", 1)
    assert {r["folder"]: r["seal"] for r in readers.seals(manifest, folder, fan=3).collect()} == want
    whole = {r["folder"]: r["seal"] for r in readers.seals(manifest, folder).collect()}
    assert whole["b"] == sha(sorted(f"{s} {p}" for p, _, s in files if p[0] == "b"))
    assert readers.seals(manifest.where("bytes > 5"), folder).count() == 0


# --- K05, X01-X03 --------------------------------------------------------------------------------------------------


def test_documents_are_replaced_at_once(spark, tmp_path):
    path = f"{tmp_path}/deep/doc.json"
    assert read_document(spark, path) is None and names_in(spark, f"{tmp_path}/none") == []
    write_document(spark, path, "one é\n")
    write_document(spark, path, "two")
    assert read_document(spark, path) == "two" and names_in(spark, f"{tmp_path}/deep") == ["doc.json"]
    assert remove(spark, path) and not remove(spark, path)


def _doubled(s, inputs):
    return inputs["src"].select("id", (F.col("x") * 2).alias("x"))


def _summed(s, inputs):
    return inputs["doubled"].groupBy((F.col("id") % 3).alias("k")).agg(F.sum("x").alias("x"))


def _broken(s, inputs):
    return inputs["doubled"].select(F.when(F.col("id") >= 0, F.raise_error("stopped")).alias("x"))


def plan_of(*last):
    return [Stage("doubled", _doubled, ("src",)), Stage("summed", last[0] if last else _summed, ("doubled",))]


def test_ledger_skips_resumes_and_refuses(spark, tmp_path):
    src = spark.range(100).select("id", F.col("id").alias("x"))
    ledger = Ledger(spark, f"{tmp_path}/l")
    with pytest.raises(NotSealed):
        ledger.table("doubled")
    found = ledger.run(plan_of(), {"src": src}, {"seed": 1})
    assert ledger.did == {"doubled": "ran", "summed": "ran"} and found["summed"].count() == 3
    again = Ledger(spark, f"{tmp_path}/l")
    again.run(plan_of(), {"src": src.repartition(7)}, {"seed": 1})  # the same rows in another order
    assert again.did == {"doubled": "sealed", "summed": "sealed"} and again.sweep() == []
    for sources, params, plan, what in (
        ({"src": src.where("id <> 5")}, {"seed": 1}, plan_of(), "source src"), ({"src": src}, {"seed": 2}, plan_of(), "parameters"),
        ({"src": src}, {"seed": 1}, plan_of(_broken), "stage summed"), ({"src": src}, {"seed": 1}, plan_of()[:1], "stage summed"),
    ):
        with pytest.raises(ProtocolChanged, match=what):
            Ledger(spark, f"{tmp_path}/l").run(plan, sources, params)


def test_ledger_resumes_after_a_break(spark, tmp_path):
    src = spark.range(100).select("id", F.col("id").alias("x"))
    stopped = {"now": True}

    def last(s, inputs):
        return _broken(s, inputs) if stopped["now"] else _summed(s, inputs)

    ledger = Ledger(spark, f"{tmp_path}/l")
    with pytest.raises(Exception, match="stopped"):
        ledger.run(plan_of(last), {"src": src})
    stopped["now"] = False
    assert ledger.seal_of("doubled") and ledger.seal_of("summed") is None
    orphans = [n for n in os.listdir(f"{tmp_path}/l/tables") if n.startswith("summed")]
    ledger.run(plan_of(last), {"src": src})
    assert ledger.did == {"doubled": "sealed", "summed": "ran"}
    assert ledger.sweep() == orphans and ledger.table("summed").count() == 3


def test_ledger_refuses_what_was_changed(spark, tmp_path):
    src = spark.range(100).select("id", F.col("id").alias("x"))
    folder = f"{tmp_path}/l"
    ledger = Ledger(spark, folder)
    ledger.run(plan_of(), {"src": src})
    seal = ledger.seal_of("doubled")
    src.write.mode("overwrite").parquet(f"{folder}/tables/{seal['table']}")
    with pytest.raises(Tampered, match="doubled"):
        ledger.run(plan_of(), {"src": src})
    remove(spark, f"{folder}/tables/{seal['table']}")
    with pytest.raises(Tampered, match="can't be read"):
        ledger.table("doubled")
    remove(spark, f"{folder}/seals/doubled.json")
    with pytest.raises(OutOfOrder, match="summed"):
        ledger.run(plan_of(), {"src": src})
    write_document(spark, f"{folder}/seals/doubled.json", json.dumps(seal | {"made_from": "0"}))
    with pytest.raises(Tampered, match="other inputs"):
        ledger.run(plan_of(), {"src": src})
    with pytest.raises(LedgerError, match="named twice"):
        Ledger(spark, f"{tmp_path}/m").run([*plan_of(), *plan_of()], {"src": src})


def test_table_digests(spark):
    a = spark.createDataFrame([(1, [1.0, None], {"k": 1}), (2, None, None)], "i int, x array<double>, m map<string,int>")
    assert table_digest(a) == table_digest(a.orderBy(F.desc("i"))) != table_digest(a.unionByName(a.limit(1)))
    assert table_digest(a.where("i > 5"))["rows"] == 0


# --- shipped code --------------------------------------------------------------------------------------------------

JOB = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {shared!r}).config("spark.sql.shuffle.partitions", "2").getOrCreate()
import __spark_entry__ as e
for name in {names!r}:
    if name in e.queries():
        assert e.queries()[name](spark, "/root/testdata/sf0.001").count() > 0, name
print("DONE")
spark.stop()
"""


def test_workers_get_the_code(tmp_path):
    """A job that starts in another folder, on executors that can't see the repository's modules by themselves."""
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYSPARK_PYTHON": sys.executable}
    job = JOB.format(repo=repo, shared=str(tmp_path / "shared"), names=["r09_joint_bootstrap", "d05_table_cells", "op4_near_duplicates"])
    done = subprocess.run([sys.executable, "-c", job], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "DONE" in done.stdout, done.stderr[-3000:]
