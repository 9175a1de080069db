"""Substring deduplication by a relative Lempel-Ziv parse against an index of all reference blocks (operator 11).

A word goes if a window of WINDOW words covers it whose word sequence also starts in a document with a smaller id.

1. Reference blocks. Of the SEED-word shingles in each window the one with the least hash is the window's anchor: equal
   windows have equal anchors at equal places, wherever they stand. Consecutive windows with one anchor are a block, some
   19 windows long on average. The index has every distinct block of the corpus once, under its anchor, with the least
   id that holds it. It is counted before it is shuffled, so a passage that a third of all documents share is one row.
2. Greedy factors. A document's blocks that an earlier document holds are copied whole; adjacent ones grow into one
   factor, as long as the reference goes on alike.
3. Factor boundaries. Where a factor ends a block differs from all reference blocks of its anchor somewhere. Such
   blocks, of anchors that the index holds with more than one block, are opened once each, and their windows looked up
   one by one, which moves the boundary to the exact word. Only a block's first holder needs that: in all others the
   whole block is a copy.

Blocks are compared by two 64-bit hashes, of their anchor and of all their words, windows by two of their words. Texts are read in three scans: for the index, for the
blocks that are opened, and for the words that stay; the latter two only for the documents concerned.

Nulls: a null text has no words; documents with a null id keep all words, and nobody loses words to them. Rows that
repeat an id are judged alone, and never against each other. Equal texts: the least id keeps the words, all others lose
what is covered; ties don't arise. Very long texts are read in pieces of PIECE words that overlap by a window, so no
window is lost. Texts shorter than a window keep all. An empty table gives no rows. Other columns, whatever their names,
are not read and pass through :func:`without_repeats`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordeval.llm.common import free_name, staged, texts_of

WINDOW, SEED = 50, 12
PIECE = 1 << 19

_RNG = np.random.Generator(np.random.PCG64(20240711))
_BASE = [int(b) * 8 + 5 for b in _RNG.integers(1, 1 << 60, 2)]
_SALT = [np.uint64(int(b)) for b in _RNG.integers(1, 1 << 62, 2)]
_LENGTH = np.uint64(0x9E3779B97F4A7C15)


def _mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class Hashes:
    """Hashes of any runs of a piece's words, from prefix sums: two independent streams of 64 bits."""

    def __init__(self, words: list[bytes]) -> None:
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        self.sums, self.back = [], []
        for base, salt in zip(_BASE, _SALT, strict=True):
            powers = np.full(len(h) + 1, np.uint64(base))
            powers[0] = 1
            sums = np.zeros(len(h) + 1, np.uint64)
            np.cumsum(_mixed(h ^ salt) * np.cumprod(powers)[:-1], out=sums[1:])
            inverse = np.full(len(h) + 1, np.uint64(pow(base, -1, 1 << 64)))
            inverse[0] = 1
            self.sums.append(sums)
            self.back.append(np.cumprod(inverse))

    def of(self, stream: int, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        sums = self.sums[stream]
        run = (sums[start + length] - sums[start]) * self.back[stream][start]
        return _mixed(run + np.asarray(length, np.uint64) * _LENGTH)


def pieces(text: str | None, size: int, overlap: int = WINDOW - 1) -> Iterator[tuple[int, list[bytes], int]]:
    """(place of the first word, words, how many of them are new) of each piece of a text; pieces overlap."""
    rest, words, place = (text or "").encode("utf-8", "surrogatepass"), [], 0
    while True:
        new = rest.split(None, size)
        rest = new.pop() if len(new) > size else b""
        if new:
            words = words[-overlap:] + new
            yield place + len(new) - len(words), words, len(new)
            place += len(new)
        if not rest:
            return


def blocks(hashes: Hashes, n: int) -> tuple[np.ndarray, ...]:
    """(start, windows, anchor, hash) of the blocks of a piece of ``n`` words."""
    starts = np.arange(n - WINDOW + 1)
    if not len(starts):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64))
    seeds = hashes.of(0, np.arange(n - SEED + 1), SEED)
    among = WINDOW - SEED + 1
    least = starts + np.lib.stride_tricks.sliding_window_view(seeds, among).argmin(axis=1)
    first = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    windows = np.diff(np.append(first, len(starts)))
    length = windows + WINDOW - 1
    return first, windows, seeds[least[first]], hashes.of(1, first, length)


BLOCK = pa.schema(
    [(c, pa.int64()) for c in ("doc_id", "h", "start", "windows", "anchor", "block", "n_words")] + [("whole_sha256", pa.string())]
)
BLOCK_DDL = "doc_id long, h long, start long, windows long, anchor long, block long, n_words long, whole_sha256 string"


def block_table(texts: DataFrame, piece: int = PIECE) -> DataFrame:
    """The blocks of all documents, and for each document a row of its own (``start`` is -1) with its number of words and
    the digest of all its words; ``texts`` has (doc_id, h, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        heads: list[tuple] = []
        rows = 0

        def batch() -> pa.RecordBatch:
            columns = [np.concatenate(c) for c in zip(*held, strict=True)] if held else [np.zeros(0, np.int64)] * 6
            n = len(columns[0])
            own = list(zip(*heads, strict=True)) if heads else [[]] * 4
            gap = [-1] * len(heads)
            ends = (own[0], own[1], gap, gap, gap, gap)
            arrays = [pa.concat_arrays([pa.array(c), pa.array(o, pa.int64())]) for c, o in zip(columns, ends, strict=True)]
            none = pa.nulls(n, pa.int64()), pa.nulls(n, pa.string())
            arrays += [pa.concat_arrays([e, pa.array(o, e.type)]) for e, o in zip(none, (own[2], own[3]), strict=True)]
            return pa.RecordBatch.from_arrays(arrays, schema=BLOCK)

        for b in batches:
            for doc, h, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                n, digest = 0, hashlib.sha256()
                for place, words, new in pieces(text, piece):
                    digest.update(b" ".join([b""] * (n > 0) + words[-new:]))
                    n += new
                    if doc is not None and len(words) >= WINDOW:
                        start, windows, *keys = blocks(Hashes(words), len(words))
                        same = [np.full(len(start), v, np.int64) for v in (doc, h)]
                        held.append([*same, start + place, windows, *(k.view(np.int64) for k in keys)])
                        rows += len(start)
                    if rows >= 100_000:
                        yield batch()
                        held, heads, rows = [], [], 0
                heads.append((doc, h, n, digest.hexdigest()))
                rows += 1
        yield batch()

    return texts.mapInArrow(run, BLOCK_DDL)


def opened(texts: DataFrame, wanted: DataFrame, piece: int = PIECE) -> DataFrame:
    """(anchor, block, first, place, w1, w2): the windows of the blocks ``wanted`` (anchor, block, first, h, start, windows), each
    read in the document ``first`` that it names."""
    one = F.struct("start", "windows", "anchor", "block")
    lists = wanted.groupBy(F.col("first").alias("doc_id"), "h").agg(F.sort_array(F.collect_list(one)).alias("of"))
    schema = pa.schema([(c, pa.int64()) for c in ("anchor", "block", "first", "place", "w1", "w2")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                doc, text, of = b.column(0)[i].as_py(), b.column(1)[i].as_py(), b.column(2)[i].values
                start, windows, *keys = (of.field(j).to_numpy() for j in range(4))
                for place, words, _ in pieces(text, piece):
                    # a block of this piece: all of its windows are in it, as when it was found
                    some = (start >= place) & (start + windows + WINDOW - 1 <= place + len(words))
                    if not some.any():
                        continue
                    times = windows[some]
                    offset = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    at = np.repeat(start[some] - place, times) + offset
                    hashes = Hashes(words)
                    found = [hashes.of(s, at, WINDOW).view(np.int64) for s in (0, 1)]
                    own = [np.repeat(k[some], times) for k in keys]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*own, np.full(len(at), doc), offset, *found)], schema=schema)

    joined = texts_of(texts, wanted.withColumn("doc_id", F.col("first")), ["doc_id", "h"]).join(lists, ["doc_id", "h"])
    return joined.select("doc_id", "text", "of").mapInArrow(run, "anchor long, block long, first long, place long, w1 long, w2 long")


def copied(blocks_: DataFrame, texts: DataFrame, piece: int = PIECE) -> DataFrame:
    """(doc_id, h, start, mask): blocks with windows that start in an earlier document; bit i of the mask is the i-th."""
    # anchors that two documents hold, and whether all of their blocks are alike; most of a corpus ends here
    anchors = blocks_.groupBy("anchor").agg(
        F.min("block").alias("low"), F.max("block").alias("high"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most")
    )
    held = staged(anchors.where("least < most").select("anchor", "least", (F.col("low") == F.col("high")).alias("alike")))
    shared = staged(blocks_.select("doc_id", "h", "start", "windows", "anchor", "block").join(held, "anchor"))
    all_of_it = F.expr("shiftleft(1L, cast(windows AS int)) - 1")
    whole = shared.where("alike AND doc_id > least").select("doc_id", "h", "start", all_of_it.alias("mask"))
    various = shared.where("NOT alike").drop("least", "alike")
    key = ["anchor", "block"]
    index = staged(
        various.groupBy(*key).agg(F.min(F.struct("doc_id", "h", "start", "windows")).alias("at"))
        .select(*key, F.col("at.doc_id").alias("first"), F.col("at.h").alias("h"), F.col("at.start").alias("start"), F.col("at.windows").alias("windows"))
    )
    windows = staged(opened(texts, index, piece))
    earlier = windows.groupBy("w1", "w2").agg(F.min("first").alias("least"), F.max("first").alias("most")).where("least < most")
    marks = (
        windows.join(staged(earlier.select("w1", "w2", "least")), ["w1", "w2"]).where("least < first")
        .groupBy(*key).agg(F.bit_or(F.expr("shiftleft(1L, cast(place AS int))")).alias("marks"))
    )
    known = staged(index.select(*key, "first").join(marks, key, "left"))
    mask = F.when(F.col("doc_id") > F.col("first"), all_of_it).otherwise(F.coalesce("marks", F.lit(0)))
    parts = various.join(known, key).select("doc_id", "h", "start", mask.cast("long").alias("mask")).where("mask <> 0")
    return whole.unionByName(parts)


def grown(spans: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """Factors (start, end) in words: windows marked in (start, mask), in order, grow while they touch."""
    out: list[list[int]] = []
    for start, mask in spans:
        while mask:
            skip = (mask & -mask).bit_length() - 1
            run = (~(mask >> skip) & ((mask >> skip) + 1)).bit_length() - 1
            begin, end = start + skip, start + skip + run - 1 + WINDOW
            if out and begin <= out[-1][1]:
                out[-1][1] = max(out[-1][1], end)
            else:
                out.append([begin, end])
            mask = mask >> (skip + run) << (skip + run)
    return [(a, b) for a, b in out]


FACTORS_DDL = "doc_id long, h long, factors array<struct<start: long, words: long>>"
FACTORS = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("factors", pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64())])))])


def parsed(blocks_: DataFrame, texts: DataFrame, piece: int = PIECE) -> DataFrame:
    """(doc_id, h, factors) of the documents that hold something that an earlier one has: maximal spans of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[{"start": a, "words": e - a} for a, e in grown((x["start"], x["mask"]) for x in spans)] for spans in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, FACTORS.field(2).type)], schema=FACTORS)

    marked = copied(blocks_, texts, piece)
    lists = marked.groupBy("doc_id", "h").agg(F.sort_array(F.collect_set(F.struct("start", "mask"))).alias("spans"))
    return lists.mapInArrow(run, FACTORS_DDL)


def kept_words(text: str | None, factors: list[dict], piece: int) -> Iterator[list[bytes]]:
    """The words outside the factors, piece by piece."""
    at, spans = 0, [(f["start"], f["start"] + f["words"]) for f in factors]
    for place, words, new in pieces(text, piece, 1):
        place, words = place + len(words) - new, words[-new:]
        stays = np.ones(new, bool)
        while at < len(spans) and spans[at][0] < place + new:
            stays[max(0, spans[at][0] - place) : spans[at][1] - place] = False
            if spans[at][1] > place + new:
                break
            at += 1
        yield [words[i] for i in np.flatnonzero(stays).tolist()]


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))


def removal_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", piece: int = PIECE) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every document."""
    texts = _texts(docs, id_col, text_col)
    found = staged(block_table(texts, piece))
    factors = staged(parsed(found.where("start >= 0"), texts, piece))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, text, of in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                digest, kept, gone = hashlib.sha256(), 0, sum(f["words"] for f in of)
                for words in kept_words(text, of, piece):
                    digest.update(b" ".join([b""] * (kept > 0 and len(words) > 0) + words))
                    kept += len(words)
                out.append((doc, kept + gone, gone, digest.hexdigest()))
            columns = zip(*out, strict=True) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    cut = texts_of(texts, factors, ["doc_id", "h"]).join(factors, ["doc_id", "h"]).select("doc_id", "text", "factors")
    changed = cut.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")
    heads = found.where("start < 0").join(factors.select("doc_id", "h"), ["doc_id", "h"], "left_anti")
    return changed.unionByName(heads.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("whole_sha256").alias("kept_sha256")))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", piece: int = PIECE) -> DataFrame:
    """``docs`` with the words that stay, joined by one space, where something goes; other texts as they are."""
    texts = _texts(docs, id_col, text_col)
    found = staged(block_table(texts, piece).where("start >= 0"))
    id_, hash_, spans = (free_name(docs, c) for c in ("cut_id", "cut_hash", "cut_factors"))
    factors = staged(parsed(found, texts, piece)).select(F.col("doc_id").alias(id_), F.col("h").alias(hash_), F.col("factors").alias(spans))
    same = (F.col(id_col).cast("long") == F.col(id_)) & (F.xxhash64(text_col) == F.col(hash_))
    out = docs.join(factors, same, "left")
    rest = F.pandas_udf(lambda text, of: text.combine(of, lambda t, f: b" ".join(w for ws in kept_words(t, f, piece) for w in ws).decode("utf-8", "surrogatepass")), "string")
    changed = out.where(F.col(spans).isNotNull()).withColumn(text_col, rest(F.col(text_col), F.col(spans)))
    names = [F.col(f"`{c}`") for c in docs.columns]
    return out.where(F.col(spans).isNull()).select(*names).unionByName(changed.select(*names))
