"""Delimited text with its faulty lines as a table (survey S21): good rows and (file, line, reason) from one scan.

Files are read as lines and stay splittable. A task numbers the lines of its part of a file; the parts' counts, a row
each, turn these into line numbers of the file. A record is a line, as in Spark's own reader.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ordeval.sources.shared import new_path

_SCHEMA = pa.schema([("file", pa.string()), ("part", pa.int64()), ("place", pa.int64()), ("values", pa.list_(pa.string())), ("reason", pa.string()), ("raw", pa.string())])


def fault(values: list[str], columns: Sequence[str], is_header: bool) -> str | None:
    """What is wrong with a line's values."""
    if is_header:
        if len(set(values)) != len(values):
            return "duplicate_header"
        return None if values == list(columns) else "wrong_header"
    if values == list(columns):
        return "repeated_header"
    return "overlong" if len(values) > len(columns) else "short" if len(values) < len(columns) else None


def read_checked(spark: SparkSession, path: str, columns: Sequence[str], delimiter: str = ",") -> tuple[DataFrame, DataFrame]:
    """(good, rejected): good rows as text under ``columns`` with ``file`` and ``line``; rejected lines as (file, line, reason,
    raw).

    Reasons: ``duplicate_header`` and ``wrong_header`` (line 1; the file's other lines are then ``under_bad_header``),
    ``repeated_header``, ``overlong``, ``short``, ``unreadable``. Empty lines are skipped but counted. Empty values are null.
    """
    wanted = list(columns)
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, place = None, 0
        for b in batches:
            out: list[tuple] = []
            for value, file, part in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (file, part) != at:
                    at, place = (file, part), 0
                place += 1
                text = value.removeprefix("﻿") if part == 0 and place == 1 else value
                if not text:
                    out.append((file, part, place, None, "empty", None))
                    continue
                try:
                    values = next(csv.reader([text], delimiter=delimiter, strict=True))
                    reason = fault(values, wanted, part == 0 and place == 1)
                    if part == 0 and place == 1 and reason is None:
                        reason = "header"
                except csv.Error:
                    values, reason = None, "unreadable"
                out.append((file, part, place, None if reason else [v or None for v in values], reason, value if reason else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA) if out else pa.RecordBatch.from_pylist([], _SCHEMA)

    where, schema = new_path(spark, "checked-lines"), "file string, part long, place long, values array<string>, reason string, raw string"
    lines.mapInArrow(run, schema).write.parquet(where)
    read = spark.read.schema(schema).parquet(where)
    before = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part of a file
    starts = read.groupBy("file", "part").agg(F.max("place").alias("n")).select("file", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    bad = read.where(F.col("reason").isin("duplicate_header", "wrong_header")).select("file", F.lit(True).alias("bad_file"))
    placed = read.join(starts, ["file", "part"]).join(bad, "file", "left").withColumn("line", F.col("start") + F.col("place"))
    good = placed.where("reason IS NULL AND bad_file IS NULL")
    reason = F.when(F.col("reason").isNull(), "under_bad_header").otherwise(F.col("reason"))
    raw = F.coalesce("raw", F.array_join("values", delimiter, ""))
    rejected = placed.where("coalesce(reason, '') NOT IN ('header', 'empty') AND (reason IS NOT NULL OR bad_file)")
    return (
        good.select("file", "line", *[F.get("values", F.lit(i)).alias(c) for i, c in enumerate(wanted)]),
        rejected.select("file", "line", reason.alias("reason"), raw.alias("raw")),
    )
