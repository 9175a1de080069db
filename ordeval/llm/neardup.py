"""Near-duplicates by an LSH forest over MinHash signatures, confirmed on full shingle sets (operator 4).

1. One pass over whole texts makes each document's shingle set, a 128-bit hash of the set and a signature.
   Documents with equal sets are one node from here on, however many there are.
2. The forest: TREES orders of the signature (rotations of it). Nodes that share a prefix of DEPTHS[0] values in
   an order form a region; a task reads its regions sorted by the whole order. A node's neighbours with the longest
   common prefix are then those beside it, and are candidates if their codes agree often enough (a bound of 5 standard
   deviations below the threshold). What they leave apart is compared from group to group, so a region loses no pair
   and a group of n copies yields n - 1 candidates, not n * n.
   The depth adapts to the region: where more than REGION nodes share a prefix, longer ones split them further; these
   and a few hubs link most of such a region, and the codes of the nodes outside its main group are compared with all
   nodes of the region, block by block.
3. The candidates' connected components are classes of nodes that may be linked. Links are confirmed on full
   sets inside each class: a search from node to node that compares only with nodes not yet reached. A class
   with more than CLASS_SHINGLES shingles is not held by one task: its nodes are compared with a few hubs, and
   those that no hub reaches are compared with all nodes of the class, block by block.

Two nodes at the threshold miss each other in all regions with probability (1 - t ** 3) ** TREES, below 1e-7 for
0.8, whatever the size of the regions. The price of a large region is up to the square of its nodes in code
comparisons, where no group of it is large.

Nulls: null and empty texts have no shingles, are linked with nothing and are kept. A null id is an id like
others in the result; the least non-null id names a component, and one without any is named null. Rows that repeat an
id are told apart by their texts. Equal texts are one node: ties of any number cost one comparison, and the least id
is kept. Very long texts are sets of hashes like others; a class of them goes to blocks by its shingles. An empty
table gives no rows. Other columns, whatever their names, are not read and pass through :func:`keep_one`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordeval.llm.common import free_name, map_arrow, small_batches, staged, texts_of
from ordeval.llm.components import connected_components

SHINGLE = 5
THRESHOLD = 80
VALUES, TREES = 96, 24
DEPTHS = (3, 6, 12, 24)
REGION = 8192
CLASS_SHINGLES = 2_000_000
HUBS = 8

_RNG = np.random.Generator(np.random.PCG64(20240229))
_XOR = _RNG.integers(0, 1 << 63, VALUES, dtype=np.uint64)[:, None]
_MUL = (_RNG.integers(0, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[:, None]
_PLACE = _RNG.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct ``k``-word shingles; the whole sequence if it has fewer words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), len(words))], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(h) - k + 1
    z = np.zeros(n, np.uint64)
    for i in range(k):
        z += h[i : i + n] * _PLACE[i]
    return np.unique(_mixed(z))


def signature(shingles: np.ndarray) -> np.ndarray:
    """16 low bits of each of VALUES minimum hashes."""
    low = np.full(VALUES, (1 << 32) - 1, np.uint64)
    for i in range(0, len(shingles), 8192):
        part = shingles[None, i : i + 8192]
        low = np.minimum(low, (((part ^ _XOR) * _MUL) >> np.uint64(32)).min(axis=1))
    return low.astype(np.uint16)


SIGNED = pa.schema(
    [("doc_id", pa.int64()), ("h", pa.int64()), ("n", pa.int64())]
    + [(c, pa.binary()) for c in ("node", "sketch", "codes")]
)


def signed(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, h, n, node, sketch, codes): text hash, set size, set hash, signature, and one byte of each value."""

    def sign(columns: dict[str, list]) -> dict[str, list]:
        n, node, sketch, codes = [], [], [], []
        for text in columns["text"]:
            s = shingle_set(text, k)
            v = signature(s) if len(s) else None
            n.append(len(s))
            node.append(hashlib.md5(s.tobytes(), usedforsecurity=False).digest() if len(s) else None)
            sketch.append(v.astype(">u2").tobytes() if len(s) else None)
            codes.append((v >> 8 ^ v & 255).astype(np.uint8).tobytes() if len(s) else None)
        return {"doc_id": columns["doc_id"], "h": columns["h"], "n": n, "node": node, "sketch": sketch, "codes": codes}

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    return map_arrow(given, sign, "doc_id long, h long, n long, node binary, sketch binary, codes binary", SIGNED)


def prefix(tree: Column, depth: int) -> Column:
    """The first ``depth`` values of the signature in a tree's order: a rotation by VALUES / TREES values a tree."""
    around = F.concat(F.col("sketch"), F.col("sketch"))
    return F.substring(around, tree * (2 * VALUES // TREES) + 1, F.lit(2 * depth))


def order(tree: Column) -> Column:
    """The codes of all values in a tree's order."""
    start = tree * (VALUES // TREES)
    return F.concat(F.substring("codes", start + 1, F.lit(VALUES)), F.substring("codes", F.lit(1), start))


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with equal first ``keys`` columns; the input is sorted by them."""
    key, rows = None, []
    for b in batches:
        for row in zip(*(b.column(i).to_pylist() for i in range(b.num_columns)), strict=True):
            if row[:keys] != key:
                if rows:
                    yield key, rows
                key, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield key, rows


def neighbours_of(codes: np.ndarray, need: int) -> np.ndarray:
    """For rows in a tree's order: which agree with the row before them, their neighbour with the longest common
    prefix on that side, in ``need`` codes or more."""
    return np.append(False, (codes[1:] == codes[:-1]).sum(axis=1) >= need)


def hubs_of(codes: np.ndarray, need: int) -> np.ndarray:
    """Index of a hub for each row: rows reached from a hub over steps with ``need`` equal codes or more.

    Runs of neighbours in the order belong together from the start; then each row of a group is compared with all
    rows that no group has yet.
    """
    run = np.cumsum(~neighbours_of(codes, need))
    hub = np.full(len(codes), -1)
    rest = np.arange(len(codes))
    while len(rest):
        start = int(rest[0])
        mine = run[rest] == run[start]
        queue, rest = rest[mine].tolist(), rest[~mine]
        hub[queue] = start
        while queue and len(rest):
            near = (codes[rest] == codes[queue.pop()]).sum(axis=1) >= need
            if near.any():
                near = np.isin(run[rest], run[rest[near]])
                hub[rest[near]] = start
                queue.extend(rest[near].tolist())
                rest = rest[~near]
    return hub


PAIR = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def _pairs(pairs: Iterator[tuple[bytes, bytes]], size: int = 20_000) -> Iterator[pa.RecordBatch]:
    a: list[bytes] = []
    b: list[bytes] = []
    for x, y in pairs:
        a.append(x), b.append(y)
        if len(a) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], schema=PAIR)
            a, b = [], []
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], schema=PAIR)


def _code_links(rows: DataFrame, need: int, by: list[str]) -> DataFrame:
    """Links (a, b) between the rows with ``asks`` and those of the same block (``by``) with ``need`` equal codes
    or more, one for each of the other's present labels; rows (by..., asks, node, label, codes)."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs() -> Iterator[tuple[bytes, bytes]]:
            for _, members in _grouped(batches, len(by)):
                if not (members[0][0] and len(members) > 1):
                    continue
                codes = np.frombuffer(b"".join(c for *_, c in members), np.uint8).reshape(len(members), VALUES)
                codes = np.ascontiguousarray(codes.T)  # sums along the rows: one byte holds VALUES
                for i, (asks, node, label, _) in enumerate(members):
                    if not asks:
                        break
                    same = (codes == codes[:, i : i + 1]).sum(axis=0, dtype=np.uint8)
                    done = {label}
                    for j in np.flatnonzero(same >= need).tolist():
                        if members[j][2] not in done:
                            done.add(members[j][2])
                            yield node, members[j][1]

        yield from _pairs(pairs())

    dealt = rows.select(*by, "asks", "node", "label", "codes").repartition(*by)
    return dealt.sortWithinPartitions(*by, F.desc("asks"), "node").mapInArrow(compare, "a binary, b binary")


def large_regions(large: DataFrame, known: DataFrame, need: int, region: int, hubs: int = HUBS) -> DataFrame:
    """Candidate pairs (a, b) that complete the candidates ``known`` in regions that no task may hold; ``large`` has
    (tree, key, size, node, codes).

    Hubs are compared with all nodes of their region. What is then outside the main group of its region asks all
    nodes of the region, block against block, so every two nodes of different groups are compared.
    """
    at = ["tree", "key"]
    blocks = F.ceil(2 * F.col("size") / F.lit(region)).cast("int")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    rows = large.withColumn("blocks", blocks)
    picked = rows.groupBy(*at).agg(*[F.min_by("node", F.xxhash64("node", F.lit(j))).alias(f"h{j}") for j in range(hubs)])
    picked = picked.select(*at, F.explode(F.array_distinct(F.array(*[f"h{j}" for j in range(hubs)]))).alias("node"))
    own = F.col("node").alias("label")
    copies = rows.join(picked, [*at, "node"]).select(*at, every, F.lit(True).alias("asks"), "node", own, "codes")
    dealt = rows.select(*at, block, F.lit(False).alias("asks"), "node", own, "codes")
    stars = staged(_code_links(copies.unionByName(dealt), need, [*at, "block"]))
    roots = connected_components(known.unionByName(stars))
    labelled = staged(rows.join(roots, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root"))
    groups = labelled.groupBy(*at, "label").agg(F.count("*").alias("members"))
    main = staged(
        groups.groupBy(*at)
        .agg(F.max_by("label", F.struct("members", "label")).alias("main"), (F.sum("members") - F.max("members")).alias("others"))
        .where("others > 0")
    )
    parts = labelled.join(main, at).withColumn("parts", F.ceil(2 * F.col("others") / F.lit(region)).cast("int"))
    asking = parts.where("label <> main").select(
        *at, F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), every, F.lit(True).alias("asks"), "node", "label", "codes"
    )
    asked = parts.select(
        *at, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), block, F.lit(False).alias("asks"), "node", "label", "codes"
    )
    return stars.unionByName(_code_links(asking.unionByName(asked), need, [*at, "part", "block"]))


def candidates(nodes: DataFrame, threshold: int, region: int = REGION, depths: tuple[int, ...] = DEPTHS) -> DataFrame:
    """Candidate pairs (a, b) from the regions of the forest; ``nodes`` has (node, sketch, codes)."""
    t = threshold / 100
    need = int(VALUES * (t - 5 * (t * (1 - t) / VALUES) ** 0.5))
    trees = nodes.select("node", "sketch", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    regions, tied, whole = None, None, None
    for depth in depths:
        keyed = trees.select("node", "tree", prefix(F.col("tree"), depth).alias("key"))
        sized = keyed.groupBy("tree", "key").agg(F.count("*").alias("size"), F.min("node").alias("least")).where("size > 1")
        found = staged(keyed.join(staged(sized), ["tree", "key"]))
        small = found.where(F.col("size") <= region).select("tree", "key", "node")
        regions = small if regions is None else regions.unionByName(small)
        large = found.where(F.col("size") > region)
        if large.isEmpty():
            break
        whole = large if whole is None else whole
        if depth == depths[-1]:
            tied = large.where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
        else:
            trees = large.select("node", "tree").join(nodes.select("node", "sketch"), "node")

    def tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs() -> Iterator[tuple[bytes, bytes]]:
            seen: set[tuple[bytes, bytes]] = set()  # a task meets the same pair in many trees
            for _, rows in _grouped(batches, 2):
                codes = np.frombuffer(b"".join(c for _, c in rows), np.uint8).reshape(len(rows), VALUES)
                for i, j in enumerate(hubs_of(codes, need).tolist()):
                    if i != j and (pair := (rows[i][0], rows[j][0])) not in seen:
                        if len(seen) < 100_000:
                            seen.add(pair)
                        yield pair

        yield from _pairs(pairs())

    coded = regions.join(nodes.select("node", "codes"), "node")
    coded = coded.select("tree", "key", "node", order(F.col("tree")).alias("codes"))
    dealt = coded.repartition("tree", "key").sortWithinPartitions("tree", "key", "codes", "node")
    out = dealt.mapInArrow(tie, "a binary, b binary")
    if whole is None:
        return out
    known = staged(out if tied is None else out.unionByName(tied))
    rows = staged(whole.select("tree", "key", "size", "node").join(nodes.select("node", "codes"), "node"))
    return known.unionByName(large_regions(rows, known, need, region))


class ClassSets:
    """The shingle sets of one class, as numbers of its own vocabulary, for comparing one node with many."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = np.array([len(s) for s in sets])
        self.starts = np.append(0, np.cumsum(self.sizes))
        vocabulary, self.numbers = np.unique(np.concatenate(sets), return_inverse=True)
        self.flags = np.zeros(len(vocabulary), bool)

    def own(self, i: int) -> np.ndarray:
        return self.numbers[self.starts[i] : self.starts[i + 1]]

    def linked(self, i: int, others: np.ndarray, threshold: int) -> np.ndarray:
        """Which of ``others`` have 100 * intersection >= threshold * union with node i."""
        sizes = self.sizes[others]
        near = 100 * np.minimum(sizes, self.sizes[i]) >= threshold * np.maximum(sizes, self.sizes[i])
        some = others[near]
        if not len(some):
            return near
        own = self.own(i)
        self.flags[own] = True
        lengths = self.sizes[some]
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1]) + np.repeat(self.starts[some] - (ends - lengths), lengths)
        common = np.add.reduceat(self.flags[self.numbers[at]].astype(np.int64), ends - lengths)
        self.flags[own] = False
        near[near] = 100 * common >= threshold * (lengths + len(own) - common)
        return near


def exact_roots(sets: list[np.ndarray], threshold: int) -> list[int]:
    """For each set the index of the first set of its component under confirmed links."""
    known = ClassSets(sets)
    root = np.arange(len(sets))
    rest = np.arange(1, len(sets))
    start = 0
    while True:
        queue = [start]
        while queue and len(rest):
            near = known.linked(queue.pop(), rest, threshold)
            root[rest[near]] = start
            queue.extend(rest[near].tolist())
            rest = rest[~near]
        if not len(rest):
            return root.tolist()
        start, rest = int(rest[0]), rest[1:]


def confirmed_in_small(rows: DataFrame, k: int, threshold: int) -> DataFrame:
    """Links (a, b) that span the exact components of each class; rows (class, node, text), a class in one task."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs() -> Iterator[tuple[bytes, bytes]]:
            for _, members in _grouped(batches, 1):
                by_node = {}
                for node, text in members:
                    s = shingle_set(text, k)
                    if hashlib.md5(s.tobytes(), usedforsecurity=False).digest() == node:
                        by_node[node] = s
                nodes = list(by_node)
                if len(nodes) > 1:
                    roots = exact_roots(list(by_node.values()), threshold)
                    yield from ((nodes[i], nodes[j]) for i, j in enumerate(roots) if i != j)

        yield from _pairs(pairs())

    small_batches(rows.sparkSession)
    dealt = rows.select("class", "node", "text").repartition("class").sortWithinPartitions("class", "node")
    return dealt.mapInArrow(confirm, "a binary, b binary")


def _block_links(rows: DataFrame, k: int, threshold: int, by: list[str]) -> DataFrame:
    """Links (a, b) between the rows with ``asks`` and the others of the same block (``by``), one for each of
    the other's present labels; rows (by..., asks, node, label, text)."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs() -> Iterator[tuple[bytes, bytes]]:
            for _, members in _grouped(batches, len(by)):
                if not (members[0][0] and len(members) > 1):
                    continue
                sets = [shingle_set(text, k) for *_, text in members]
                known = ClassSets(sets)
                everyone = np.arange(len(members))
                for i, (asks, node, label, _) in enumerate(members):
                    if not asks:
                        break
                    near = everyone[known.linked(i, everyone, threshold)].tolist()
                    done = {label}
                    for j in near:
                        if members[j][2] not in done:
                            done.add(members[j][2])
                            yield node, members[j][1]

        yield from _pairs(pairs())

    dealt = rows.select(*by, "asks", "node", "label", "text").repartition(*by)
    return dealt.sortWithinPartitions(*by, F.desc("asks"), "node").mapInArrow(compare, "a binary, b binary")


def confirmed_in_large(rows: DataFrame, k: int, threshold: int, limit: int, hubs: int = HUBS) -> DataFrame:
    """As :func:`confirmed_in_small` for classes that no task may hold; rows (class, node, n, text)."""
    rows = staged(rows.select("class", "node", "n", "text").dropDuplicates(["node"]))
    # deal each class into blocks, and put copies of its hubs into every block
    sized = rows.groupBy("class").agg(F.ceil(2 * F.sum("n") / F.lit(limit)).cast("int").alias("blocks"))
    picked = rows.groupBy("class").agg(
        *[F.min_by("node", F.xxhash64("node", F.lit(j))).alias(f"h{j}") for j in range(hubs)]
    )
    picked = picked.select("class", F.explode(F.array_distinct(F.array(*[f"h{j}" for j in range(hubs)]))).alias("node"))
    hub_rows = rows.join(picked.select("node"), "node").join(sized, "class")
    copies = hub_rows.select(
        "class", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("asks"), "node",
        F.col("node").alias("label"), "text",
    )
    blocked = rows.join(sized, "class").select(
        "class", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), F.lit(False).alias("asks"), "node",
        F.col("node").alias("label"), "text",
    )
    stars = staged(_block_links(copies.unionByName(blocked), k, threshold, ["class", "block"]))
    roots = staged(connected_components(stars)) if not stars.isEmpty() else stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
    labelled = rows.join(roots, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")
    largest = (
        labelled.groupBy("class", "label").agg(F.count("*").alias("size"))
        .groupBy("class").agg(F.max_by("label", F.struct("size", "label")).alias("main"))
    )
    labelled = staged(labelled.join(largest, "class").withColumn("away", F.col("label") != F.col("main")))
    # what the main component doesn't reach asks all nodes of its class, block against block
    parts = labelled.groupBy("class").agg(
        F.greatest(F.lit(1), F.ceil(2 * F.sum(F.when(F.col("away"), F.col("n")).otherwise(0)) / F.lit(limit))).cast("int").alias("asking"),
        F.ceil(2 * F.sum("n") / F.lit(limit)).cast("int").alias("asked"),
    )
    all_rows = labelled.join(parts, "class")
    asking = all_rows.where("away").select(
        "class", F.pmod(F.xxhash64("node"), F.col("asking")).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.col("asked") - 1)).alias("other"), F.lit(True).alias("asks"), "node", "label", "text",
    )
    asked = all_rows.select(
        "class", F.explode(F.sequence(F.lit(0), F.col("asking") - 1)).alias("block"),
        F.pmod(F.xxhash64("node"), F.col("asked")).cast("int").alias("other"), F.lit(False).alias("asks"), "node", "label", "text",
    )
    rest = _block_links(asking.unionByName(asked), k, threshold, ["class", "block", "other"])
    return stars.unionByName(rest)


def _components(
    docs: DataFrame, k: int, threshold: int, id_col: str, text_col: str, region: int, class_shingles: int
) -> DataFrame:
    """:func:`near_duplicates` with the hash ``h`` of each text, and ``chosen``: the text that stays for its group."""
    sig = staged(signed(docs, k, id_col, text_col))
    # a node's text is that of one row, found again by its id and hash
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "h")).alias("least")
    nodes = staged(
        sig.where("n > 0").groupBy("node").agg(
            least, F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("codes").alias("codes")
        ).select("node", F.col("least.doc_id").alias("first"), F.col("least.h").alias("h"), "n", "sketch", "codes")
    )
    classes = connected_components(candidates(nodes, threshold, region))
    members = staged(
        classes.select("node", F.col("root").alias("class")).join(nodes.select("node", "first", "h", "n"), "node")
    )
    sizes = members.groupBy("class").agg(F.sum("n").alias("in_class"))
    named_by = lambda c: F.coalesce(F.col(c).cast("long").cast("string"), F.lit("")).alias("id")
    given = docs.select(named_by(id_col), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    # only texts of members of a class are shuffled, where their keys are few enough to tell before
    wanted = members.join(sizes, "class").withColumn("id", named_by("first")).hint("merge")
    texts = texts_of(given, members.select(named_by("first"), "h"), ["id", "h"]).dropDuplicates(["id", "h"]).join(wanted, ["id", "h"])
    links = confirmed_in_small(texts.where(F.col("in_class") <= class_shingles), k, threshold)
    if not sizes.where(F.col("in_class") > class_shingles).isEmpty():
        links = links.unionByName(
            confirmed_in_large(texts.where(F.col("in_class") > class_shingles), k, threshold, class_shingles)
        )
    roots = connected_components(links)
    ends = nodes.select("node", "first", "h").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = F.min(F.struct(F.col("first").isNull().alias("unnamed"), "first", "h", "node")).alias("least")
    names = ends.groupBy("root").agg(least).select("root", F.col("least.first").alias("component_id"), F.col("least.h").alias("stays"))
    named = ends.join(names, "root").select("node", "component_id", "stays")
    return (
        sig.select("doc_id", "h", F.col("n").alias("n_shingles"), "node")
        .join(named, "node", "left")
        .select(
            "doc_id", "h", "n_shingles",
            F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
            (F.col("node").isNull() | (F.col("h") == F.col("stays"))).alias("chosen"),
        )
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def near_duplicates(
    docs: DataFrame,
    k: int = SHINGLE,
    threshold: int = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
    region: int = REGION,
    class_shingles: int = CLASS_SHINGLES,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document.

    Documents are linked if 100 * |A n B| >= ``threshold`` * |A u B| for their sets of ``k``-word shingles.
    """
    return _components(docs, k, threshold, id_col, text_col, region, class_shingles).drop("h", "chosen")


def keep_one(
    docs: DataFrame,
    k: int = SHINGLE,
    threshold: int = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
    region: int = REGION,
    class_shingles: int = CLASS_SHINGLES,
) -> DataFrame:
    """One document of each group of near-duplicates, with the columns of ``docs``.

    Of rows that repeat an id and a text one stays, and of an id's or null ids' texts in one group one text.
    """
    found = _components(docs, k, threshold, id_col, text_col, region, class_shingles).where("kept AND chosen")
    id_, hash_, rows = (free_name(docs, c) for c in ("kept_id", "kept_hash", "kept_rows"))
    kept = staged(found.groupBy(F.col("doc_id").alias(id_), F.col("h").alias(hash_)).agg(F.count("*").alias(rows)))
    same = F.col(id_col).cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64(text_col) == F.col(hash_))
    alone = docs.join(kept.where(F.col(rows) == 1), same, "left_semi")
    if kept.where(F.col(rows) > 1).isEmpty():
        return alone
    repeated = docs.join(kept.where(F.col(rows) > 1), same).dropDuplicates([id_, hash_])
    return alone.unionByName(repeated.select(*[F.col(f"`{c}`") for c in docs.columns]))
