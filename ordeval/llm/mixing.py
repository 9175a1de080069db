"""Mixing sources to target weights by systematic sampling (operator 1; DataFrame functions only).

Every document of a source is expected ``target / source_size`` times. The expected copies are summed
along the source's documents, from the longest to the shortest, one random offset is added, and a document
is emitted once for each integer boundary that its span crosses. Because the documents are in order of
size, the words taken differ from the target by less than the longest document of the source.

The prefix sums come from three levels of counts - (source), (source, size), (source, size, range of a hash of id
and text) - so no window ever holds a whole source, however much of the corpus that source has. Rows that repeat id,
source and text are counted first and are one row until the end. The ranges follow the order of the documents, so
their number, which grows with the table, changes the plan alone.

Nulls: a null text has size 0, a null source is a source of its own (the last), null ids are told apart by their texts.
Rows that repeat an id are documents of their own. Ties: equal sizes are in order of the hash, then of the id; equal rows
share their copies in any order. Very long texts are counted whole. An empty table gives no rows. Other columns are not
read, whatever their names, and pass through :func:`mix_documents`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordeval.llm.common import free_name, n_words, staged

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
CAP = 2.0
SEED = 7
#: Documents of one (source, size) are dealt by at least so many ranges of their hash, one more for each ROWS_A_RANGE rows.
RANGES, ROWS_A_RANGE = 256, 100_000
#: Equal rows are handed out again by so many at a time.
EQUAL_ROWS = 10_000


def source_targets(
    sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, cap: float = CAP
) -> DataFrame:
    """Target of each source from a table (source, source_size) with one row per source.

    The sources share ``budget`` times all sizes by weight; a target stops at ``cap`` times its source's
    size and the excess is shared anew until none is above. In order of cap / weight, the level at which
    the first source isn't capped is also the highest of the levels, so one running sum finds it.
    """
    by_name = Window.orderBy(F.col("source").isNull().cast("int"), "source")
    given = F.array(*[F.lit(int(w)) for w in weights])
    by_ratio = Window.orderBy("ratio", F.col("source").isNull().cast("int"), "source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    return (
        sources.withColumn("weight", F.get(given, (F.row_number().over(by_name) - 1) % len(weights)))
        .withColumn("cap", F.lit(float(cap)) * F.col("source_size"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("sized_before", F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(onward))
        .withColumn(
            "level",
            (F.lit(float(budget)) * F.col("total") - F.lit(float(cap)) * F.col("sized_before"))
            / F.col("weight_left"),
        )
        .withColumn("target", F.least("cap", F.max("level").over(everything) * F.col("weight")))
        .select("source", "source_size", "target")
    )


def hash32(text: Column) -> Column:
    """The first 32 bits of the MD5 of a string."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def offset(source: Column, seed: int) -> Column:
    """The source's random offset in [0, 1), the same in every run."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("")))
    return hash32(name).cast("double") / F.lit(4294967296.0)


def systematic_mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    budget: float = BUDGET,
    cap: float = CAP,
    seed: int = SEED,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """(id, source, size, source_size, target, copies, taken, text_hash) of every document."""
    named = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.md5(text_col), F.lit("")))
    groups = staged(
        docs.select(
            F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"),
            F.xxhash64(text_col).alias("text_hash"), hash32(named).alias("key"),
        ).groupBy("id", "source", "size", "text_hash", "key").agg(F.count("*").alias("equal"))
    )
    known = groups.agg(F.coalesce(F.sum("equal"), F.lit(0)).alias("rows"), F.coalesce(F.max("equal"), F.lit(0)).alias("most")).first()
    ranges = max(RANGES, known["rows"] // ROWS_A_RANGE)
    base = groups.withColumn("bucket", F.shiftright(F.col("key") * F.lit(ranges), 32).cast("int"))
    by_bucket = base.groupBy("source", "size", "bucket").agg(F.sum("equal").alias("in_bucket"))
    by_size = by_bucket.groupBy("source", "size").agg(F.sum("in_bucket").alias("in_size"))
    targets = source_targets(
        by_size.groupBy("source").agg(F.sum(F.col("size") * F.col("in_size")).alias("source_size")),
        weights,
        budget,
        cap,
    )
    longer = Window.partitionBy("source").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    size_start = by_size.withColumn("size_start", F.coalesce(F.sum("in_size").over(longer), F.lit(0)))
    starts = (
        by_bucket.withColumn("bucket_start", F.coalesce(F.sum("in_bucket").over(earlier), F.lit(0)))
        .alias("b")
        .join(
            size_start.alias("s"),
            F.col("b.source").eqNullSafe(F.col("s.source")) & (F.col("b.size") == F.col("s.size")),
        )
        .join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source")))
        .select(
            "b.source",
            "b.size",
            "b.bucket",
            (F.col("size_start") + F.col("bucket_start")).alias("start"),
            "source_size",
            "target",
        )
    )
    until = F.sum("equal").over(Window.partitionBy("source", "size", "bucket").orderBy("key", "id", "text_hash"))
    ranked = base.withColumn("first", until - F.col("equal") + 1)
    if known["most"] > EQUAL_ROWS:  # large groups of equal rows are dealt in parts before they are handed out
        part = F.explode(F.sequence(F.lit(0), F.floor((F.col("equal") - 1) / EQUAL_ROWS))).alias("part")
        ranked = ranked.select("*", part).repartition("key", "id", "text_hash", "part").withColumns(
            {"first": F.col("first") + F.col("part") * EQUAL_ROWS, "equal": F.least(F.lit(EQUAL_ROWS), F.col("equal") - F.col("part") * EQUAL_ROWS)}
        )
    place = F.explode(F.sequence(F.col("first"), F.col("first") + F.col("equal") - 1)).alias("place")
    ranked = ranked.select("id", "source", "size", "text_hash", "bucket", place)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    boundary = lambda place: F.floor(F.col("rate") * place + F.col("u"))
    return (
        ranked.alias("d")
        .join(
            starts.alias("o"),
            F.col("d.source").eqNullSafe(F.col("o.source"))
            & (F.col("d.size") == F.col("o.size"))
            & (F.col("d.bucket") == F.col("o.bucket")),
        )
        .select(
            "d.id", "d.source", "d.size", "d.text_hash", "source_size", "target", (F.col("start") + F.col("place")).alias("place")
        )
        .withColumn("rate", rate)
        .withColumn("u", offset(F.col("source"), seed))
        .withColumn(
            "copies",
            F.least(boundary(F.col("place")) - boundary(F.col("place") - 1), F.ceil("rate")).cast("long"),
        )
        .select("id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "text_hash")
    )


def mix_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The documents of the mix, each emitted as often as :func:`systematic_mix` says, with the columns of ``docs``.

    Rows are found again by id, source and text. Rows that repeat all three share the copies of their group: equal
    rows are counted first, so a repeated row is a few rows a task, and the groups' copies go to them in order.
    """
    taken = systematic_mix(docs, id_col=id_col, source_col=source_col, text_col=text_col, **options)
    id_, source, hash_, copies, rows, place = (free_name(docs, f"mix_{c}") for c in ("id", "source", "hash", "copies", "rows", "place"))
    group = [F.col("id").alias(id_), F.col("source").alias(source), F.col("text_hash").alias(hash_)]
    shared = staged(taken.groupBy(*group).agg(F.sum("copies").alias(copies), F.count("*").alias(rows)).where(F.col(copies) > 0))
    same = (
        F.col(id_col).eqNullSafe(F.col(id_))
        & F.col(source_col).eqNullSafe(F.col(source))
        & (F.xxhash64(text_col) == F.col(hash_))
    )
    names = [F.col(f"`{c}`") for c in docs.columns]
    each = lambda n: F.explode(F.sequence(F.lit(1), n.cast("int"))).alias(place)
    out = docs.join(shared.where(F.col(rows) == 1), same).select(*names, each(F.col(copies))).select(*names)
    if shared.where(F.col(rows) > 1).isEmpty():
        return out
    repeated = docs.join(shared.where(F.col(rows) > 1), same)
    own = free_name(docs, "mix_own")
    counted = repeated.groupBy(*names, id_, source, hash_, copies, rows).agg(F.count("*").alias(own))
    so_far = F.sum(own).over(Window.partitionBy(id_, source, hash_).orderBy(*names))
    until = lambda n: F.floor(F.col(copies) * n / F.col(rows))
    dealt = counted.withColumn(place, so_far).withColumn(own, until(F.col(place)) - until(F.col(place) - F.col(own)))
    return out.unionByName(dealt.where(F.col(own) > 0).select(*names, each(F.col(own))).select(*names))
