"""Media columns: PNG in binary columns (operator 3).

A payload of bytes is stored as an 8-bit grey PNG: rows get one of the filters None, Sub and Up (the one with
the least sum of absolute differences), go through zlib and are cut into IDAT chunks with CRC-32 checksums.
Reading tests the signature, every checksum and the sizes, inflates and undoes all five filters with numpy.
The feature is a hash of the lowest frequencies of a cosine transform of the picture. Both ways go through blocks of
BLOCK rows, each with the row before it, so a task holds the payload, the picture and little else.

A damaged picture doesn't end a job: its row has ``error`` and null features. That holds for headers of any length,
number and size too, and no more is inflated than a header of at most MOST samples announces.
A null payload is an empty one; equal payloads, ties and repeated rows included, have equal pictures. Long texts are
pictures of more rows. An empty table gives no rows; other columns stay, and one named like a new one is an error.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 576
CHUNK = 1 << 16
LEVEL = 1
#: Rows that are filtered, packed or read at a time.
BLOCK = 4096
#: Samples of a picture that is read, at most (a column holds no more than 2 GB).
MOST = (1 << 31) - 1
#: The picture is averaged to SIDE x SIDE, and LOW x LOW of its frequencies are hashed.
SIDE, LOW = 32, 8

_K = np.arange(SIDE)
COSINES = np.cos(np.pi * np.outer(_K, _K + 0.5) / SIDE)


class BadPicture(ValueError):
    """The bytes are not a PNG that this module can read."""


def padded(data: bytes, unit: int = WIDTH) -> bytes:
    """``data`` with bytes 255 appended up to a positive multiple of ``unit``."""
    size = max(unit, -(-len(data) // unit) * unit)
    return data + b"\xff" * (size - len(data))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def _filtered(rows: np.ndarray, before: np.ndarray) -> bytes:
    """Lines of a block of rows: each row's filter and its bytes under it; ``before`` is the row above the block."""
    sub = rows.copy()
    sub[:, 1:] -= rows[:, :-1]
    up = rows.copy()
    up[1:] -= rows[:-1]
    up[0] -= before
    cost = np.stack([np.abs(kind.view(np.int8).astype(np.int16)).sum(axis=1, dtype=np.int64) for kind in (rows, sub, up)])
    chosen = cost.argmin(axis=0)
    lines = np.empty((len(rows), rows.shape[1] + 1), np.uint8)
    lines[:, 0] = chosen
    for number, kind in enumerate((rows, sub, up)):
        own = chosen == number
        lines[own, 1:] = kind[own]
    return lines.tobytes()


def encode_png(payload: bytes, width: int = WIDTH, level: int = LEVEL) -> bytes:
    """An 8-bit grey PNG of rows of ``width`` bytes; the payload must fill its rows."""
    if not payload or len(payload) % width:
        raise BadPicture("the payload does not fill rows")
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    packer, before = zlib.compressobj(level), np.zeros(width, np.uint8)
    out, held = bytearray(SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0))), bytearray()
    for y in range(0, len(rows), BLOCK):
        block = rows[y : y + BLOCK]
        held += packer.compress(_filtered(block, before))
        before = block[-1]
        while len(held) >= CHUNK:
            out += _chunk(b"IDAT", bytes(held[:CHUNK]))
            del held[:CHUNK]
    held += packer.flush()
    for i in range(0, len(held), CHUNK):
        out += _chunk(b"IDAT", bytes(held[i : i + CHUNK]))
    return bytes(out + _chunk(b"IEND", b""))


def _chunks(png: bytes) -> dict[bytes, list[memoryview]]:
    """Data of the chunks by kind, in order; nothing is copied."""
    if png[:8] != SIGNATURE:
        raise BadPicture("no PNG signature")
    parts: dict[bytes, list[memoryview]] = {}
    view, at = memoryview(png), 8
    while at < len(png):
        if at + 12 > len(png):
            raise BadPicture("a chunk is cut off")
        size, kind = struct.unpack(">I4s", view[at : at + 8])
        data = view[at + 8 : at + 8 + size]
        if len(data) < size or zlib.crc32(data, zlib.crc32(kind)) != int.from_bytes(view[at + 8 + size : at + 12 + size], "big"):
            raise BadPicture(f"checksum of {kind!r}")
        parts.setdefault(kind, []).append(data)
        at += 12 + size
    if b"IHDR" not in parts or b"IEND" not in parts:
        raise BadPicture("no header or no end")
    return parts


def _unfilter(lines: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Undo the row filters of a block of lines of an 8-bit grey picture; ``before`` is the row above it.

    Runs of None and Sub rows are undone at once, Up rows one by one. Average and Paeth need the sample to the left, so
    where they occur, the samples of a block are undone along its diagonals, each diagonal at once.
    """
    kinds, rows = lines[:, 0], lines[:, 1:].copy()
    if kinds.max(initial=0) > 4:
        raise BadPicture("unknown filter")
    if (kinds >= 3).any():
        return _along_diagonals(kinds, rows, before)
    sub = np.flatnonzero(kinds == 1)
    for i in range(0, len(sub), 256):  # sums in 64 bits: a few rows at a time
        some = sub[i : i + 256]
        rows[some] = np.cumsum(rows[some], axis=1, dtype=np.uint64).astype(np.uint8)
    for y in np.flatnonzero(kinds == 2):
        rows[y] += rows[y - 1] if y else before
    return rows


def _along_diagonals(kinds: np.ndarray, rows: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Sample (y, x) needs (y, x - 1), (y - 1, x) and (y - 1, x - 1): all of them are on earlier diagonals x + y."""
    height, width = rows.shape
    done = np.zeros((height + 1, width + 1), np.int16)  # with the row above and a border of zeros
    done[0, 1:] = before
    for d in range(height + width - 1):
        y = np.arange(max(0, d - width + 1), min(height, d + 1))
        x = d - y
        left, above, corner = done[y + 1, x], done[y, x + 1], done[y, x]
        guess = left + above - corner
        to_left, to_above, to_corner = abs(guess - left), abs(guess - above), abs(guess - corner)
        near = np.where((to_left <= to_above) & (to_left <= to_corner), left, np.where(to_above <= to_corner, above, corner))
        kind = kinds[y]
        add = np.select([kind == 1, kind == 2, kind == 3, kind == 4], [left, above, (left + above) // 2, near], 0)
        done[y + 1, x + 1] = (rows[y, x] + add) & 255
    return done[1:, 1:].astype(np.uint8)


def read_rows(png: bytes) -> tuple[int, int, Iterator[np.ndarray]]:
    """(height, width, rows in blocks) of an 8-bit grey PNG; raises :class:`BadPicture`, also while the blocks are read."""
    parts = _chunks(png)
    if [len(p) for p in parts[b"IHDR"]] != [13]:
        raise BadPicture("not one header of 13 bytes")
    width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", parts[b"IHDR"][0])
    if (depth, colour, interlace) != (8, 0, 0):
        raise BadPicture("not an 8-bit grey picture without interlacing")
    if not width or not height or height * (width + 1) > MOST:
        raise BadPicture("no samples or too many")

    def blocks() -> Iterator[np.ndarray]:
        before, left, inflater, held = np.zeros(width, np.uint8), height, zlib.decompressobj(), bytearray()

        def ready(n: int) -> np.ndarray:
            nonlocal before, left
            rows = _unfilter(np.frombuffer(bytes(held[: n * (width + 1)]), np.uint8).reshape(n, width + 1), before)
            del held[: n * (width + 1)]
            before, left = rows[-1], left - n
            return rows

        size = max(1, min(BLOCK, (1 << 23) // width))
        for part in parts.get(b"IDAT", []):
            while len(part) and not inflater.eof:
                room = left * (width + 1) - len(held) + 1  # no more than the header announces, and one to notice it
                try:
                    held += inflater.decompress(part, min(room, 1 << 22))
                except zlib.error as e:
                    raise BadPicture(str(e)) from e
                part = inflater.unconsumed_tail
                if len(held) > left * (width + 1):
                    raise BadPicture("wrong number of samples")
                while len(held) >= size * (width + 1):
                    yield ready(size)
        while not inflater.eof:  # what the inflater still holds back
            try:
                more = inflater.decompress(inflater.unconsumed_tail, min(left * (width + 1) - len(held) + 1, 1 << 22))
            except zlib.error as e:
                raise BadPicture(str(e)) from e
            held += more
            if not more:
                break
        if len(held) != left * (width + 1) or not inflater.eof:
            raise BadPicture("wrong number of samples")
        while left:
            yield ready(min(size, left))

    return height, width, blocks()


def decode_png(png: bytes) -> np.ndarray:
    """Rows and columns of an 8-bit grey PNG; raises :class:`BadPicture`."""
    return np.concatenate(list(read_rows(png)[2]))


class Averages:
    """The mean of each cell of a SIDE x SIDE grid over a picture that comes in blocks of rows; a picture smaller than the
    grid repeats its rows or columns."""

    def __init__(self, height: int, width: int, side: int = SIDE) -> None:
        self.height, self.at = height, 0
        self.rows_at, self.columns_at = np.arange(side) * height // side, np.arange(side) * width // side
        self.width, self.side = width, side
        self.sums = np.zeros((min(height, side), side), np.int64)

    def add(self, rows: np.ndarray) -> None:
        if self.width >= self.side:
            columns = np.add.reduceat(rows, self.columns_at, axis=1, dtype=np.int64)
        else:
            columns = rows[:, self.columns_at].astype(np.int64)
        y = np.arange(self.at, self.at + len(rows))
        cell = y if self.height < self.side else np.searchsorted(self.rows_at, y, "right") - 1
        np.add.at(self.sums, cell, columns)
        self.at += len(rows)

    def means(self) -> np.ndarray:
        wide = np.maximum(np.diff(np.append(self.columns_at, self.width)), 1) if self.width >= self.side else np.ones(self.side)
        if self.height < self.side:
            return self.sums[self.rows_at] / wide
        return self.sums / (np.diff(np.append(self.rows_at, self.height))[:, None] * wide)


def frequency_hash(means: np.ndarray) -> str:
    """16 hex digits: which of the lowest frequencies of a grid are above their median (the mean itself left out)."""
    low = (COSINES[:LOW] @ means @ COSINES[:LOW].T).round(6).ravel()
    bits = low > np.median(low[1:])
    bits[0] = False
    return np.packbits(bits).tobytes().hex()


def with_pictures(df: DataFrame, payload_col: str, media_col: str = "media", width: int = WIDTH) -> DataFrame:
    """``df`` with a binary PNG column made from a binary payload column (null: empty), padded to whole rows."""

    @F.pandas_udf("binary")
    def encode(payloads):  # noqa: ANN001, ANN202
        return payloads.map(lambda p: encode_png(padded(bytes(p) if p is not None else b"", width), width))

    return _with_new(df, media_col, encode(F.col(payload_col)))


def _with_new(df: DataFrame, name: str, column: Column) -> DataFrame:
    if name.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"there is a column {name} already")
    return df.withColumn(name, column)


READ = "payload_bytes long, payload_sha256 string, tail_crc32 long, feature string, error string"


def read_features(png: bytes | None) -> tuple:
    """Values of ``READ`` from stored bytes."""
    digest, size, tail = hashlib.sha256(), 0, b""
    try:
        height, width, blocks = read_rows(png or b"")
        grid = Averages(height, width)
        for rows in blocks:
            grid.add(rows)
            data = rows.tobytes()
            digest.update(data)
            size, tail = size + len(data), (tail + data[-32:])[-32:]
    except BadPicture as e:
        return None, None, None, None, str(e)
    return size, digest.hexdigest(), zlib.crc32(tail), frequency_hash(grid.means()), None


def with_features(df: DataFrame, media_col: str = "media", read_col: str = "read") -> DataFrame:
    """``df`` with the struct ``read_col`` (``READ``) of what its stored pictures hold."""

    @F.pandas_udf(READ)
    def read(stored):  # noqa: ANN001, ANN202
        import pandas as pd

        out = pd.DataFrame(
            [read_features(None if s is None else bytes(s)) for s in stored],
            columns=["payload_bytes", "payload_sha256", "tail_crc32", "feature", "error"],
        )
        return out.astype({"payload_bytes": "Int64", "tail_crc32": "Int64"})

    return _with_new(df, read_col, read(F.col(media_col)))


def text_media_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each whole text as UTF-8 in a binary PNG column; the stored bytes are read back and described.

    The pictures stay in their task: no column of them is shuffled or kept.
    """
    payloads = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("payload"))
    read = with_features(with_pictures(payloads, "payload"))
    bad = F.when(F.col("read.error").isNotNull(), F.raise_error(F.col("read.error"))).otherwise(F.col("read.payload_bytes"))
    return read.select(
        "doc_id", F.octet_length("payload").cast("long").alias("n_bytes"), bad.cast("long").alias("payload_bytes"), "read.payload_sha256", "read.tail_crc32",
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "read.feature",
    )
