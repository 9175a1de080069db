"""Conflict-constrained best-fit packing (operator 2).

Documents are dealt by a hash into shards of about ``SHARD_DOCS`` documents, and every shard is packed on its
own in one task, so no task sees more than a shard. In a shard the pieces go from the longest to the shortest.
Open bins are in order of their residual; each carries a bitmap of the sources that it has enough of and a bitmap of
the duplicate clusters in it. The search begins at the tightest residual that fits and goes on to the next bin until
it finds one that is compatible; if none is, it opens a bin.

A document longer than the capacity fills bins of its own; its last piece is packed like a document.
Two documents of one duplicate cluster never share a bin, nor do more of one source than its limit: twice what a bin
would hold of it if the shard were mixed evenly, and at least ``PER_SOURCE``. So a corpus of few sources or of tiny
documents fills its bins too. A fixed ``per_source`` limits every source alike, and bins stay as empty as it demands.

Nulls: a null text is an empty text, a null source is a source, null ids are documents of their own. Empty documents
become pieces of no words, which conflict with nothing but their source's limit. Rows that repeat an id and a text are
copies of each other (one cluster); like null ids they are dealt by row, so no shard gets more of them than of others.
Ties: of equal sizes the lower id, then the cluster comes first; of equal bins the first opened. Very long texts are
cut at the capacity. An empty table gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordeval.llm.common import WORD, n_words, small_batches, staged

CAPACITY = 4096
PER_SOURCE, EVEN = 6, 2
_WORDS = re.compile(WORD)
SHARD_DOCS = 4096

PACKED = "doc_id long, part int, start_word long, n_words long, shard int, bin int, bin_start int, bin_id long, text_hash long"


class Bins:
    """The open bins of a shard in order of residual."""

    def __init__(self, capacity: int, limits: dict[int, int]) -> None:
        self.capacity, self.limits = capacity, limits  # documents of each source in a bin, at most
        self.levels: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by residual
        self.filled = 0  # bit r: some bin has residual r
        self.residual: list[int] = []
        self.held: list[dict[int, int]] = []  # documents of each source
        self.full: list[int] = []  # bit s: no more of source s
        self.clusters: list[int] = []

    def open(self) -> int:
        self.residual.append(self.capacity)
        self.held.append({})
        self.full.append(0)
        self.clusters.append(0)
        self._enter(len(self.residual) - 1, self.capacity)
        return len(self.residual) - 1

    def _enter(self, i: int, level: int) -> None:
        self.levels[level].append(i)
        self.filled |= 1 << level

    def successor(self, size: int, source: int, cluster: int) -> int:
        """The tightest compatible bin, the earliest opened among equals; -1 if there is none."""
        ahead = self.filled >> size
        level = size
        while ahead:
            step = (ahead & -ahead).bit_length() - 1
            level += step
            best = -1
            for i in self.levels[level]:
                if not self.clusters[i] & cluster and not self.full[i] & source and (best < 0 or i < best):
                    best = i
            if best >= 0:
                return best
            ahead >>= step + 1
            level += 1
        return -1

    def put(self, i: int, size: int, source: int, cluster: int) -> int:
        """Add a piece to bin i; returns where in the bin it begins."""
        old = self.residual[i]
        start = self.capacity - old
        self.clusters[i] |= cluster
        self.held[i][source] = held = self.held[i].get(source, 0) + 1
        if held >= self.limits[source]:
            self.full[i] |= source
        if size:
            at = self.levels[old]
            at.remove(i)
            if not at:
                self.filled &= ~(1 << old)
            self.residual[i] = old - size
            self._enter(i, old - size)
        return start


def pack_shard(rows: pd.DataFrame, capacity: int = CAPACITY, per_source: int | None = None) -> pd.DataFrame:
    """Pack one shard: rows of (shard, id, size, source, cluster, text_hash) to rows of ``PACKED``."""
    rows = rows.sort_values(["size", "id", "cluster"], ascending=[False, True, True], kind="mergesort")
    bits: dict[object, int] = {}
    copies = Counter(rows["cluster"])
    cluster_bits: dict[object, int] = {}
    pieces = []
    whole: list[tuple] = []
    shard = int(rows["shard"].iloc[0])
    columns = (rows[c] for c in ("id", "size", "source", "cluster", "text_hash"))
    for doc, size, source, cluster, text in zip(*columns, strict=True):
        size = int(size)
        doc = None if pd.isna(doc) else int(doc)
        source = bits.setdefault(None if pd.isna(source) else source, 1 << len(bits))
        shared = cluster_bits.setdefault(cluster, 1 << len(cluster_bits)) if size and copies[cluster] > 1 else 0
        parts, rest = divmod(size, capacity)
        whole += [(doc, k, k * capacity, capacity, text) for k in range(parts)]
        if rest or not parts:
            pieces.append((rest, doc, parts, parts * capacity, source, shared, text))
    pieces.sort(key=lambda p: -p[0])
    documents, words = Counter(p[4] for p in pieces), max(1, sum(p[0] for p in pieces))
    even = {s: max(PER_SOURCE, -(-EVEN * capacity * n // words)) for s, n in documents.items()}
    bins = Bins(capacity, even if per_source is None else dict.fromkeys(documents, per_source))
    out = []
    for size, doc, part, start, source, cluster, text in pieces:
        i = bins.successor(size, source, cluster)
        if i < 0:
            i = bins.open()
        out.append((doc, part, start, size, i, bins.put(i, size, source, cluster), text))
    opened = len(bins.residual)
    out += [(doc, part, start, size, opened + k, 0, text) for k, (doc, part, start, size, text) in enumerate(whole)]
    packed = pd.DataFrame(out, columns=["doc_id", "part", "start_word", "n_words", "bin", "bin_start", "text_hash"])
    packed["doc_id"] = packed["doc_id"].astype("Int64")
    packed["shard"] = shard
    packed["bin_id"] = (shard << 32) + packed["bin"].astype("int64")
    return packed[["doc_id", "part", "start_word", "n_words", "shard", "bin", "bin_start", "bin_id", "text_hash"]]


def best_fit_pack(
    docs: DataFrame,
    capacity: int = CAPACITY,
    per_source: int | None = None,
    shard_docs: int = SHARD_DOCS,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    cluster_col: str | None = None,
) -> DataFrame:
    """Pieces of documents with their bins (``PACKED``).

    ``cluster_col`` names the duplicate clusters; without it, documents whose words are equal without regard
    to case or white space are one cluster.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.trim(F.regexp_replace(F.lower(text), r"[\x20\x09-\x0D]+", " "))
    cluster = F.col(cluster_col).cast("string") if cluster_col else F.md5(words)
    narrow = staged(
        docs.select(
            F.col(id_col).cast("long").alias("id"),
            n_words(text).alias("size"),
            F.col(source_col).cast("string").alias("source"),
            F.coalesce(cluster, F.concat(F.lit("#"), F.col(id_col).cast("string")), F.lit("#")).alias("cluster"),
            F.xxhash64(text_col).alias("text_hash"),
            F.monotonically_increasing_id().alias("row"),  # fixed by the staged table, also for lost executors
        )
    )
    shards = max(1, -(-narrow.count() // shard_docs))
    narrow = narrow.withColumn("shard", F.pmod(F.xxhash64("id", "cluster", "row"), F.lit(shards)).cast("int")).drop("row")

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        return pack_shard(rows, capacity, per_source)

    return narrow.groupBy("shard").applyInPandas(pack, PACKED)


CUT = pa.schema([("id", pa.int64()), ("h", pa.int64()), ("k", pa.int32()), ("text", pa.string())])


def cut_texts(docs: DataFrame, capacity: int, id_col: str, text_col: str) -> DataFrame:
    """(id, h, k, text): each whole text (hash ``h``) in pieces of ``capacity`` words, from the first character of the
    piece's first word to that of the next piece; the first piece begins with the text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for doc, h, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                starts = [m.start() for m in _WORDS.finditer(text)][capacity::capacity]
                ends = [*starts, len(text)]
                rows += [(doc, h, k, text[s:e]) for k, (s, e) in enumerate(zip([0, *starts], ends, strict=True))]
            columns = list(zip(*rows)) if rows else [[] for _ in CUT]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, CUT, strict=True)], schema=CUT)

    small_batches(docs.sparkSession)
    given = docs.select(F.col(id_col).cast("long"), F.xxhash64(text_col), F.coalesce(F.col(text_col), F.lit("")))
    return given.mapInArrow(cut, "id long, h long, k int, text string")


def packed_texts(
    docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """:func:`best_fit_pack` with the ``text`` of every piece: the pieces of a document put together are its text.

    Equal rows have equal pieces, so a piece is found by id, text and part; one shuffle of the texts.
    """
    packed = staged(best_fit_pack(docs, capacity, id_col=id_col, text_col=text_col, **options))
    pieces = cut_texts(docs, capacity, id_col, text_col).dropDuplicates(["id", "h", "k"])
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("h")) & (F.col("part") == F.col("k"))
    return packed.join(pieces, same).drop("id", "h", "k")


def filled(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Words, pieces and share of the capacity of every bin."""
    return packed.groupBy("bin_id").agg(
        F.sum("n_words").alias("n_words"),
        F.count("*").alias("pieces"),
        (F.sum("n_words") / F.lit(float(capacity))).alias("filled"),
    )

