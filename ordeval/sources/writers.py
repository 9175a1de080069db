"""Writers (survey K01-K08, K12, S15): Spark's own formats; files are compared by content, not by bytes."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ordeval.sources.documents import write_document


def write_csv(df: DataFrame, path: str, gzip: bool = False) -> None:
    """CSV with a header; doubles are written so that they read back equal."""
    df.write.mode("errorifexists").csv(path, header=True, compression="gzip" if gzip else "none")


def write_json_lines(df: DataFrame, path: str, gzip: bool = True) -> None:
    """JSON lines with null fields kept."""
    df.write.mode("errorifexists").option("ignoreNullFields", "false").json(path, compression="gzip" if gzip else "none")


def write_periods(df: DataFrame, path: str, period: str) -> None:
    """One folder for each period; rows are dealt by period first, so each has few files, and Spark splits a period
    that is too large for one task."""
    df.hint("rebalance", period).write.mode("errorifexists").partitionBy(period).parquet(path)


def write_rows(spark: SparkSession, rows: Sequence[dict], schema: T.StructType, path: str) -> None:
    """A small list of rows; an empty one is an error."""
    if not rows:
        raise ValueError("no rows to write")
    write_csv(spark.createDataFrame(list(rows), schema), path)


def write_json_atomic(spark: SparkSession, value: object, path: str) -> None:
    """A small JSON document in the cluster's file system, replaced in one step."""
    write_document(spark, path, json.dumps(value, sort_keys=True) + "\n")


def markdown_table(rows: Sequence[Sequence[object]], columns: Sequence[str]) -> list[str]:
    """The lines of a table; bars and line ends in values are escaped, null is empty."""
    shown = lambda v: "" if v is None else str(v).replace("\\", "\\\\").replace("|", "\\|").replace("\n", "<br>")
    line = lambda cells: f"| {' | '.join(cells)} |"
    return [line(columns), line(["---"] * len(columns)), *[line([shown(v) for v in row]) for row in rows]]


def write_report(sections: dict[str, DataFrame], path: str, most: int = 10_000) -> None:
    """A Markdown report of small tables in the order given, replaced in one step; a table of more than ``most`` rows is an
    error. Tables are in their own order, so sort them first."""
    out: list[str] = []
    spark = None
    for title, df in sections.items():
        spark = df.sparkSession
        rows = df.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"{title}: more than {most} rows in a report")
        out += [f"# {title}", "", *markdown_table(rows, df.columns), ""]
    if spark is None:
        raise ValueError("a report of nothing")
    write_document(spark, path, "\n".join(out))
