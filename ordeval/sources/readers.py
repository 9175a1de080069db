"""Readers under explicit schemas (survey S01-S11, S14, S16, S21)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordeval.functions.columns import plain_text
from ordeval.operators.guards import ContractError
from ordeval.operators.ranks import global_place, with_keys


def text_schema(columns: Sequence[str]) -> T.StructType:
    """All columns as text."""
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def header(spark: SparkSession, path: str) -> list[str]:
    """The columns of a CSV file."""
    return spark.read.csv(path, header=True, inferSchema=False).columns


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType, columns: Sequence[str] | None = None) -> DataFrame:
    """CSV (gz too) with a fixed schema; only the empty text is missing, a header in another
    order or a malformed row is an error. With ``columns`` only those are parsed."""
    df = spark.read.csv(path, schema=schema, header=True, enforceSchema=False, mode="FAILFAST")
    return df.select(*columns) if columns else df


def read_periods(spark: SparkSession, paths: dict[int, str], schema: T.StructType, period: str = "period") -> DataFrame:
    """Files of several periods as one scan, with the period of each file."""
    df = read_csv(spark, list(paths.values()), schema)
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    of = {p.rstrip("/").rsplit("/", 1)[-1]: k for k, p in paths.items()}
    known = F.create_map(*[F.lit(x) for kv in of.items() for x in kv])
    folder = F.element_at(F.split(F.input_file_name(), "/"), -2)  # a path may be a folder that Spark wrote
    return df.withColumn(period, F.coalesce(F.try_element_at(known, name), F.try_element_at(known, folder)))


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines; a row that lacks a field (null is not lacking) is an error."""
    raw = spark.read.text(path)
    keys = F.from_json("value", "map<string,string>")
    lacking = F.lit(False)
    for f in schema.fieldNames():
        lacking = lacking | ~F.map_contains_key(keys, f)
    checked = F.when(lacking, F.raise_error(F.concat(F.lit("a required field is missing: "), "value"))).otherwise(F.col("value"))
    return raw.select(F.from_json(checked, schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def require_same_field_order(spark: SparkSession, path: str) -> list[str]:
    """Every JSON line has the same fields in the same order; returns them."""
    orders = spark.read.text(path).select(F.json_object_keys("value").alias("k")).distinct().limit(2).collect()
    if len(orders) > 1:
        raise ContractError(f"field orders differ: {orders[0]['k']} and {orders[1]['k']}")
    return list(orders[0]["k"]) if orders else []


def first_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    """A limited scan in a fixed order."""
    return df.orderBy(*order).limit(n)


def table_cells(pages: DataFrame, html: str = "html", *keys: str) -> DataFrame:
    """(keys, row, cell, value) of the HTML table cells of each page."""
    rows = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), 1)
    cells = F.regexp_extract_all(F.col("row_html"), F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), 1)
    by_row = pages.select(*keys, F.posexplode(rows).alias("row", "row_html"))
    return by_row.select(*keys, "row", F.posexplode(cells).alias("cell", "value")).withColumn("value", plain_text(F.col("value")))


def tagged_texts(pages: DataFrame, tag: str, html: str = "html", *keys: str) -> DataFrame:
    """(keys, place, value) of the text of every element with the tag."""
    found = F.regexp_extract_all(F.col(html), F.lit(rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), 1)
    return pages.select(*keys, F.posexplode(found).alias("place", "value")).withColumn("value", plain_text(F.col("value")))


def file_manifest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Path, size and SHA-256 of files, read by the executors."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def manifest_status(expected: DataFrame, found: DataFrame) -> DataFrame:
    """MISSING, SIZE_MISMATCH, SHA256_MISMATCH or PASS for each expected file (path, bytes, sha256)."""
    f = found.select("path", F.col("bytes").alias("__b"), F.col("sha256").alias("__s"))
    status = (
        F.when(F.col("__s").isNull(), "MISSING").when(F.col("bytes") != F.col("__b"), "SIZE_MISMATCH")
        .when(F.col("sha256") != F.col("__s"), "SHA256_MISMATCH").otherwise("PASS")
    )
    return expected.join(f, "path", "left").select("path", status.alias("status"))


def merged_manifests(*manifests: DataFrame) -> DataFrame:
    """One row for each path of several manifests (path, bytes, sha256): in how many it is, and whether they
    contradict each other."""
    every = manifests[0]
    for m in manifests[1:]:
        every = every.unionByName(m)
    facts = F.struct("bytes", "sha256")
    return every.groupBy("path").agg(F.count("*").alias("manifests"), (F.min(facts) != F.max(facts)).alias("conflict"))


def seals(manifest: DataFrame, folder: Column, seal: str = "seal", fan: int = 1024) -> DataFrame:
    """One seal for each folder of a manifest, from its sorted lines ``sha256 path``; a file that changes, comes or
    goes changes the seal, and seals of folders can be sealed again.

    A seal is the digest of up to ``fan`` lines; of a folder with more, the digest of the digests of so many lines each, and
    so on, so no row or task holds a folder.
    """
    lines = manifest.select(folder.alias("folder"), F.concat_ws(" ", "sha256", "path").alias("line"))
    placed = global_place(lines, [F.col("folder"), F.col("line")], "place")
    firsts = placed.groupBy("folder").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    nodes = with_keys(placed, firsts.select("folder", "first"), ["folder"]).select("folder", (F.col("place") - F.col("first")).alias("at"), "line")
    most = firsts.agg(F.max("n")).first()[0] or 0
    while True:
        text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n")  # fan lines
        nodes = nodes.groupBy("folder", F.floor(F.col("at") / fan).alias("up")).agg(F.sha2(text, 256).alias("line")).withColumnRenamed("up", "at")
        if most <= fan:
            return nodes.select("folder", F.col("line").alias(seal))
        most = -(-most // fan)


def require_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly these columns in this order with these types."""
    want = [(f.name, f.dataType.simpleString()) for f in schema]
    if df.dtypes != want:
        raise ContractError(f"schema {df.dtypes} is not {want}")
    return df
