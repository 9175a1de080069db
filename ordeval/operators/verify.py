"""Verification of tables (survey V01-V10)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordeval.functions.columns import close
from ordeval.operators.ranks import global_place
from ordeval.sources.shared import new_path


def table_differences(
    reference: DataFrame, candidate: DataFrame, keys: Sequence[str], atol: float = 1e-10, rtol: float = 1e-8,
    exact: Sequence[str] = (), ignored: Sequence[str] = (),
) -> DataFrame:
    """(keys, column, problem, expected, observed) for every missing or extra key and differing cell.

    One full outer join on the keys; cells are compared in place and only the differences are unpivoted.
    """
    keys = list(keys)
    own = [c for c in reference.columns if c not in keys and c not in ignored]
    if set(own) != {c for c in candidate.columns if c not in keys and c not in ignored}:
        raise ValueError(f"columns differ: {sorted(set(own) ^ (set(candidate.columns) - set(keys) - set(ignored)))}")
    a = reference.select(*keys, F.struct(*own).alias("__a"))
    b = candidate.select(*keys, F.struct(*own).alias("__b"))
    joined = a.join(b, keys, "full_outer")
    text = lambda side, c: F.col(f"{side}.{c}").cast("string")
    whole = F.when(F.col("__b").isNull(), "missing_key").when(F.col("__a").isNull(), "extra_key")
    same = lambda c: F.col(f"__a.{c}").eqNullSafe(F.col(f"__b.{c}")) if c in exact else close(F.col(f"__a.{c}"), F.col(f"__b.{c}"), atol, rtol)
    cells = [
        F.when(whole.isNull() & ~same(c), F.struct(F.lit(c).alias("column"), F.lit("different").alias("problem"), text("__a", c).alias("expected"), text("__b", c).alias("observed")))
        for c in own
    ]
    row = F.when(whole.isNotNull(), F.struct(F.lit(None).cast("string").alias("column"), whole.alias("problem"), F.lit(None).cast("string").alias("expected"), F.lit(None).cast("string").alias("observed")))
    found = F.filter(F.array(row, *cells), lambda x: x.isNotNull())
    return joined.select(*keys, F.explode(found).alias("d")).select(*keys, "d.*")


def difference_summary(differences: DataFrame) -> DataFrame:
    """Number of each kind of problem."""
    return differences.groupBy("problem", "column").agg(F.count("*").alias("n"))


def prediction_deviation(a: DataFrame, b: DataFrame, id_col: str, label: str, probabilities: Sequence[str]) -> DataFrame:
    """Rows, label changes, largest change of each probability."""
    names = [label, *probabilities]
    left = a.select(id_col, *[F.col(c).alias(f"{c}_a") for c in names])
    right = b.select(id_col, *[F.col(c).alias(f"{c}_b") for c in names])
    return left.join(right, id_col).agg(
        F.count("*").alias("n"),
        F.count_if(F.col(f"{label}_a") != F.col(f"{label}_b")).alias("labels_changed"),
        *[F.max(F.abs(F.col(f"{p}_a") - F.col(f"{p}_b"))).alias(f"max_{p}") for p in probabilities],
    )


def content_hash(df: DataFrame) -> DataFrame:
    """Rows and an order-free hash of a table's content."""
    h = F.xxhash64(*[F.col(c) for c in sorted(df.columns)])
    return df.agg(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("content"))


def ordered_digest(df: DataFrame, order: Sequence[str], columns: Sequence[str], fan: int = 1024, levels: int = 4) -> DataFrame:
    """(n, digest) of the rows in order: a tree of SHA-256 over the rows' places, so its root is the same for any partitions
    and any order of arrival, and another if two rows change places.

    Row ``i`` is leaf ``i``: the digest of its columns as text, null as ``\\N``, with a unit separator between them. A node is
    the digest of its up to ``fan`` children's, a line each; there are ``levels`` of them. ``order`` must tell rows apart.
    """
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns])
    rows = global_place(df.select(*order, F.sha2(text, 256).alias("__digest")), [F.col(c) for c in order], "__place")
    nodes, n = rows.select((F.col("__place") - 1).alias("__at"), "__digest"), rows.count()
    if n > fan**levels:
        raise ValueError(f"{n} rows need more than {levels} levels of {fan}")
    for _ in range(levels):
        children = F.sort_array(F.collect_list(F.struct("__at", "__digest")))  # fan at most
        joined = F.array_join(F.transform(children, lambda x: x["__digest"]), "\n")
        nodes = nodes.groupBy(F.floor(F.col("__at") / fan).alias("__up")).agg(F.sha2(joined, 256).alias("__digest")).withColumnRenamed("__up", "__at")
    return nodes.agg(F.lit(n).cast("long").alias("n"), F.coalesce(F.max("__digest"), F.sha2(F.lit("").cast("binary"), 256)).alias("digest"))


def propagation(differences: DataFrame, primary: Column) -> DataFrame:
    """Differing draws of primary models against the others."""
    return differences.agg(
        F.count_if(primary).alias("primary_cells"), F.count_if(~primary).alias("secondary_cells"),
        F.countDistinct(F.when(primary, F.col("iteration"))).alias("primary_draws"),
        F.countDistinct(F.when(~primary, F.col("iteration"))).alias("secondary_draws"),
    )


def data_contract(df: DataFrame, id_col: str, role: str, period: str, latest: int) -> DataFrame:
    """Rows, whether ids are unique and complete, and whether the latest period is locked for tests."""
    return df.agg(
        F.count("*").alias("n"),
        (F.countDistinct(id_col) == F.count("*")).alias("ids_unique"),
        (F.count_if(F.col(id_col).isNull()) == 0).alias("ids_complete"),
        (F.count_if((F.col(period) == latest) != (F.col(role) == "test")) == 0).alias("latest_locked"),
    )


def matches_include(df: DataFrame, include: dict[str, Sequence]) -> DataFrame:
    """rows whose columns have one of the values that a contract includes."""
    kept = F.lit(True)
    for column, values in include.items():
        kept = kept & F.col(column).isin(*values)
    return df.where(kept)


def catalog_view(df: DataFrame, keys: Sequence[str], include: dict[str, Sequence] | None = None, volatile: str = "seconds") -> DataFrame:
    """The rows that a catalog includes, without columns whose name ends in ``volatile``, ordered by key."""
    kept = matches_include(df, include or {})
    return kept.select(*[c for c in df.columns if not c.endswith(volatile)]).orderBy(*keys)


def draw_differences(a: DataFrame, b: DataFrame, axes: Sequence[str], value: str = "value", atol: float = 1e-12) -> DataFrame:
    """Cells of two long tensors that differ or that one of them lacks."""
    left, right = a.select(*axes, F.col(value).alias("__a")), b.select(*axes, F.col(value).alias("__b"))
    joined = left.join(right, list(axes), "full_outer")
    return joined.where(F.col("__a").isNull() | F.col("__b").isNull() | (F.abs(F.col("__a") - F.col("__b")) > atol)).select(
        *axes, F.col("__a").alias("expected"), F.col("__b").alias("observed")
    )


def json_leaves(df: DataFrame, key: str, document: str, ignored: Sequence[str] = (), depth: int = 32) -> DataFrame:
    """(key, path, kind, text) of every scalar, null and empty container of JSON documents.

    One level at a time: containers are exploded into their members until none is left; documents nested deeper than
    ``depth`` are an error. Members named in ``ignored`` are left out at every level. Null documents have no rows.
    """
    spark = df.sparkSession
    level = df.where(F.col(document).isNotNull()).select(key, F.lit("$").alias("path"), F.parse_json(document).alias("node"))
    found = None
    for _ in range(depth):
        path = new_path(spark, "json-level")
        kind = F.schema_of_variant("node")
        filled = (kind.startswith("OBJECT<") & (kind != "OBJECT<>")) | (kind.startswith("ARRAY<") & (F.to_json("node") != "[]"))
        level.select(key, "path", "node", kind.alias("kind"), filled.alias("filled")).write.parquet(path)
        rows = spark.read.parquet(path)
        leaves = rows.where("NOT filled").select(key, "path", F.regexp_extract("kind", "^[A-Z]+", 0).alias("kind"), F.to_json("node").alias("text"))
        found = leaves if found is None else found.unionByName(leaves)
        inner = rows.where("filled")
        if inner.isEmpty():
            return found
        exploded = inner.lateralJoin(spark.tvf.variant_explode(F.col("node").outer()))
        step = F.when(F.col("key").isNull(), F.concat(F.lit("["), "pos", F.lit("]"))).otherwise(F.concat(F.lit('["'), "key", F.lit('"]')))
        kept = exploded.where(F.col("key").isNull() | ~F.col("key").isin(*ignored)) if ignored else exploded
        level = kept.select(inner[key], F.concat("path", step).alias("path"), F.col("value").alias("node"))
    raise ValueError(f"a document is deeper than {depth} levels")


def json_differences(
    reference: DataFrame, candidate: DataFrame, key: str, document: str, ignored: Sequence[str] = (), atol: float = 1e-10, rtol: float = 1e-8,
    depth: int = 32,
) -> DataFrame:
    """(key, path, problem, expected, observed): leaves that are missing, extra or different; numbers within a tolerance."""
    a = json_leaves(reference, key, document, ignored, depth).select(key, "path", F.col("kind").alias("__ka"), F.col("text").alias("expected"))
    b = json_leaves(candidate, key, document, ignored, depth).select(key, "path", F.col("kind").alias("__kb"), F.col("text").alias("observed"))
    number = lambda k: F.col(k).isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")
    same = F.when(number("__ka") & number("__kb"), close(F.col("expected"), F.col("observed"), atol, rtol)).otherwise(F.col("expected") == F.col("observed"))
    problem = F.when(F.col("observed").isNull(), "missing").when(F.col("expected").isNull(), "extra").when(~same, "different")
    joined = a.join(b, [key, "path"], "full_outer").withColumn("problem", problem)
    return joined.where(F.col("problem").isNotNull()).select(key, "path", "problem", "expected", "observed")
