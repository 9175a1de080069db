"""Small documents in the cluster's file system (survey K05, X01-X03): read, replaced at once, removed.

A document is written beside its place and renamed over it, which the file systems of Hadoop do in one step: a reader
sees the old document or the new one, and a driver that is lost in between leaves the old one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _system(spark: SparkSession, path: str):  # noqa: ANN202
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_document(spark: SparkSession, path: str, text: str) -> None:
    """Replace the document at ``path``, or make it; its folder is made if needed."""
    jvm, at, system = _system(spark, path)
    system.mkdirs(at.getParent())
    beside = jvm.org.apache.hadoop.fs.Path(at.getParent(), f".{at.getName()}-{uuid.uuid4().hex}")
    out = system.create(beside, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(system.makeQualified(beside), system.makeQualified(at), options)


def read_document(spark: SparkSession, path: str) -> str | None:
    """The document's text; None if there is none."""
    jvm, at, system = _system(spark, path)
    if not system.exists(at):
        return None
    source = system.open(at)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode()
    finally:
        source.close()


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder, hidden ones left out; none if there is no such folder."""
    _, at, system = _system(spark, folder)
    if not system.exists(at):
        return []
    return sorted(n for n in (s.getPath().getName() for s in system.listStatus(at)) if not n.startswith("."))


def remove(spark: SparkSession, path: str) -> bool:
    """Remove a document or a folder with all that is in it; whether there was one."""
    _, at, system = _system(spark, path)
    return system.delete(at, True)
