"""What the operators of this subpackage share: the word rule, staged tables, Arrow maps over rows."""

from __future__ import annotations

import atexit
import contextlib
import functools
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ordeval.sources.documents import remove

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.cache
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="ordeval-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_folder(spark: SparkSession) -> str:
    """The folder for this application's staged tables, under ``spark.checkpoint.dir``; a local one only if that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = _own_folder()
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}"


_SCRATCH: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are :func:`staged` inside are removed at its end: what needs them must be written by then."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            remove(spark, path)


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the cluster's shared checkpoint folder and read it back.

    This cuts the lineage: an executor that is lost later costs a reread, not a recomputation.
    The tables stay until the folder is cleared, as checkpoints do, or until the :func:`scratch` around ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Keys of documents that a broadcast may hold: two longs each, some 64 MB in memory.
FEW_KEYS = 1_000_000


def small_side(df: DataFrame, most: int) -> DataFrame:
    """``df`` for a join, broadcast if a count shows at most ``most`` rows, and left to Spark otherwise."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def texts_of(texts: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The rows of ``texts`` whose columns ``on`` are among ``keys``, which is counted first: up to FEW_KEYS are broadcast, so the
    other texts are not shuffled by what follows; beyond that Spark joins by a shuffle. The rows are the same."""
    distinct = keys.select(*on).distinct()
    few = distinct.limit(FEW_KEYS + 1).count() <= FEW_KEYS
    return texts.join(F.broadcast(distinct) if few else distinct, on, "left_semi")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until ``df`` has no such column (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the rows of one Arrow batch: whole texts of any length travel in them."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def map_arrow(
    df: DataFrame,
    fn: Callable[[dict[str, list]], dict[str, list]],
    schema: str,
    arrow_schema: pa.Schema,
) -> DataFrame:
    """``fn`` gets the columns of a batch as Python lists and returns columns; one batch is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)}
            out = fn(columns)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[f.name], type=f.type) for f in arrow_schema], schema=arrow_schema
            )

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)
