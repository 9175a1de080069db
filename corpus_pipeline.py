"""From raw documents to packed training data: STAGES in order, each written as Parquet and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ordeval.llm import mixing, neardup, packing, pii, quality
from ordeval.llm.common import documents, scratch, shared_folder, table
from ordeval.sources.documents import remove


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the isolation forest reject go.

    Null and empty texts have no words and go; null ids are judged like others. Equal texts, ties and repeated rows
    get equal verdicts. Very long texts are read whole. An empty table stays empty; all other columns stay.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the least id: five words, a similarity of 0.8.

    Null and empty texts are in no group and stay. A null id is kept only where its group has no other id, and then
    one text of it. Of repeated rows one stays. Very long texts are compared whole. An empty table stays empty; all
    other columns stay.
    """
    return neardup.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and terms that disclose it are replaced in the texts; ``n_chars`` is counted anew.

    Null texts stay null, empty ones empty; null ids, repeated rows and ties are treated by their texts alone. Very
    long texts are read whole. An empty table stays empty; all other columns stay.
    """
    return pii.sanitised(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target says.

    Null and empty texts have size 0 and follow their source's rate; a null source is a source, null ids are documents
    of their own. Repeated rows share the copies of their group. An empty table stays empty; all other columns stay.
    """
    return mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their bins and texts, one row for each piece of each copy.

    Null and empty texts are pieces of no words, with an empty text. Null ids and repeated rows are documents of their
    own. Very long texts are cut at the capacity. An empty table gives no rows; other columns are left out.
    """
    return packing.packed_texts(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("mix_sources", mix_sources),
    ("pack", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and reread. What a stage has written for
    itself is removed when its result is there, and a result when the next one is."""
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES:
        result = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        with scratch(spark):
            made = stage(spark, docs, sf_dir)
            made.write.parquet(result)
        docs = spark.read.schema(made.schema).parquet(result)
        if before:
            remove(spark, before)
        before = result
    return docs


#: The isolation forest has no SQL twin; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None
