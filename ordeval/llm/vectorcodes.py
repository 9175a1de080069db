"""Compression of vectors to product-quantisation codes with memoised grid cells (operator 12).

Components become integers, vectors are cut into equal parts, and each part position has a small codebook that is refined
in rounds: assign every part to its nearest entry, then move each entry to its parts' mean. The assignment is exact:

* A part's coarse cell is its components divided by CELL. For a cell that a task meets first, the least and the greatest
  distance from its box to every entry are taken; an entry whose least distance exceeds the smallest greatest distance is
  dominated and can't be nearest anywhere in the box. The entries that are left are kept under the cell's hash.
* Parts are then compared with the entries of their cell only, all at once in numpy.

The memory of cells is cleared when it holds MEMO of them, which costs time and changes nothing. Vectors are never
shuffled: a round is one scan, and sums and counts by (part, entry, component) are added up in each task and then in
Spark. Codebooks have PARTS x ENTRIES rows and are the only thing that the driver holds.

Nulls: vectors that are null, empty, or hold null or non-finite components are dropped; null ids and labels are kept
(ids last in the order of the first codebook, labels as one group). Repeated ids are vectors of their own, in order of
their components. Vectors whose length is not that of the first kept one are dropped, a length that PARTS doesn't
divide is an error, and so are components of 2**21 or more, whose squares don't fit. Ties go to the lower entry; entries
that no part chooses stay, and where fewer than ENTRIES vectors are kept there are as many entries. An empty table gives
no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordeval.llm.common import staged

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
CELL = 32
MEMO = 200_000
LIMIT = 1 << 29
#: Components of the differences that a task holds at a time.
HELD = 1 << 22


def kept_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, label, x): vectors whose components are all there and finite, as doubles."""
    x = F.col(vector_col).cast("array<double>")
    sound = ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.where(F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & sound).select(
        F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), x.alias("x")
    )


def whole(batch: pa.Array, width: int) -> np.ndarray:
    """A column of vectors as a matrix of integers."""
    floors = np.floor(batch.flatten().to_numpy(zero_copy_only=False).reshape(-1, width) * SCALE)
    if floors.size and np.abs(floors).max() >= LIMIT:
        raise ValueError(f"a component is {LIMIT // SCALE} or more: squared distances would not fit")
    return floors.astype(np.int64)


class Cells:
    """The entries of one part's codebook that can be nearest, by coarse cell."""

    def __init__(self, entries: np.ndarray, cell: int = CELL, memo: int = MEMO) -> None:
        self.entries, self.cell, self.memo = entries, cell, memo
        self.known: dict[bytes, np.ndarray] = {}

    def undominated(self, corners: np.ndarray) -> list[np.ndarray]:
        """For each cell (its lowest corner) the entries that are nearest somewhere in it, or tie."""
        low, high = corners[:, None, :] - self.entries, self.entries - (corners[:, None, :] + self.cell - 1)
        outside = np.maximum(np.maximum(low, high), 0)
        across = np.maximum(np.abs(low), np.abs(high))
        least, most = (outside**2).sum(axis=2), (across**2).sum(axis=2)
        return [np.flatnonzero(row) for row in least <= most.min(axis=1, keepdims=True)]

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each part's nearest entry, the lower of equals, and its squared distance."""
        step = max(1, HELD // self.entries.size)
        found = [self._nearest(parts[i : i + step]) for i in range(0, len(parts), step)]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def _nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        coarse = np.ascontiguousarray(parts // self.cell)
        keys, first, cell_of = np.unique(
            coarse.view(np.dtype((np.void, coarse.dtype.itemsize * coarse.shape[1]))).ravel(), return_index=True, return_inverse=True
        )
        names = [k.tobytes() for k in keys]
        if len(self.known) > self.memo:
            self.known.clear()
        new = [i for i, name in enumerate(names) if name not in self.known]
        for i in range(0, len(new), 1024):
            some = new[i : i + 1024]
            for j, left in zip(some, self.undominated(coarse[first[some]] * self.cell), strict=True):
                self.known[names[j]] = left
        lists = [self.known[name] for name in names]
        lengths = np.array([len(x) for x in lists])
        starts = np.cumsum(lengths) - lengths
        offered, many, begin = np.concatenate(lists), lengths[cell_of], starts[cell_of]
        ends = np.cumsum(many)
        at = np.arange(ends[-1]) - np.repeat(ends - many - begin, many)
        distance = ((np.repeat(parts, many, axis=0) - self.entries[offered[at]]) ** 2).sum(axis=1)
        best = np.minimum.reduceat(distance, ends - many)
        entry = np.where(distance == np.repeat(best, many), offered[at], len(self.entries))
        return np.minimum.reduceat(entry, ends - many), best


def _cut(x: np.ndarray, n_parts: int) -> list[np.ndarray]:
    return np.split(x, n_parts, axis=1)


def first_codebooks(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> list[np.ndarray]:
    """For each part position the parts of the vectors with the smallest ids; empty for an empty table."""
    rows = kept.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()
    if not rows:
        return []
    width = len(rows[0]["x"])
    if width % parts:
        raise ValueError(f"vectors of {width} components have no {parts} equal parts")
    books = whole(pa.array([r["x"] for r in rows if len(r["x"]) == width], pa.list_(pa.float64())), width)
    return [np.ascontiguousarray(b) for b in _cut(books, parts)]


def refined(kept: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round: each entry is the floor of its parts' mean."""
    n_parts, width = len(books), sum(b.shape[1] for b in books)
    schema = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("place", pa.int32()), ("n", pa.int64()), ("total", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(b) for b in books]
        n = [np.zeros(len(b), np.int64) for b in books]
        total = [np.zeros(b.shape, np.int64) for b in books]
        for batch in batches:
            for p, parts in enumerate(_cut(whole(batch.column(0), width), n_parts)):
                entry, _ = cells[p].nearest(parts)
                n[p] += np.bincount(entry, minlength=len(n[p]))
                np.add.at(total[p], entry, parts)
        for p in range(n_parts):
            entry, place = np.indices(total[p].shape).reshape(2, -1)
            columns = (np.full(len(entry), p, np.int32), entry.astype(np.int32), place.astype(np.int32), n[p][entry], total[p].ravel())
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)

    partial = kept.where(F.size("x") == width).select("x").mapInArrow(run, "part int, entry int, place int, n long, total long")
    sums = partial.where("n > 0").groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    out = [b.copy() for b in books]
    for r in sums.collect():  # PARTS x ENTRIES x components at most, however many vectors there are
        out[r["part"]][r["entry"], r["place"]] = r["total"] // r["n"]
    return out


def books_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def trained(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks after ``rounds`` rounds over all vectors."""
    books = first_codebooks(kept, parts, entries)
    for _ in range(rounds if books else 0):
        books = refined(kept, books)
    return books


def encoded(kept: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(vec_id, label, code, error): two hex digits a part, and the squared distance to what the code stands for."""
    if not books:
        return kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).where(F.lit(False))
    n_parts, width = len(books), sum(b.shape[1] for b in books)
    types = dict(kept.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(b) for b in books]
        for batch in batches:
            x = whole(batch.column(2), width)
            codes, error = np.zeros((len(x), n_parts), np.uint8), np.zeros(len(x), np.int64)
            for p, parts in enumerate(_cut(x, n_parts)):
                entry, distance = cells[p].nearest(parts)
                codes[:, p] = entry
                error += distance
            text = [row.tobytes().hex() for row in codes]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    sized = kept.where(F.size("x") == width)
    return sized.mapInArrow(run, f"vec_id {types['vec_id']}, label {types['label']}, code string, error long")


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every kept vector."""
    kept = kept_vectors(vectors, id_col, vector_col, label_col)
    books = trained(kept, parts, entries, rounds)
    codes = staged(encoded(kept, books))
    by_label = codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return codes.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256")
    )
