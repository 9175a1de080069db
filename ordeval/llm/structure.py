"""Repair of conversations' structure with a suffix-shared automaton of fault signatures (operator 13).

1. Every row becomes a symbol: the initial of its role, whether its text is cut off, or that it must go (blank, or a
   repetition). A conversation's symbols in order of turn are its signature.
2. The distinct signatures of all conversations are put in order of their reversed strings. Signatures that end alike
   are then neighbours, and a stack of nodes, one a suffix, is the automaton, minimised from the end: for each node and
   each state of the grammar the cheapest cost to go and the first letter of the best audit suffix are computed once,
   whatever number of conversations and signatures ends so. Each letter leads to one node and state, so the letters
   along the path are the best suffix, ties included.
3. Audits go back to the conversations by signature; a stream over the sorted rows applies them to the texts.

Edits: Keep costs 0, Rerole 2, Delete 3, Insert (an empty text) 2, and each cut-off row that stays 1; the roles' initials
must then read ``(s?(ua)+)?``. Of equal costs the audit that is least in ASCII counts.

Only digests and flags of rows are shuffled for 1 and 2; equal rows are counted, and repetitions found by aggregation,
so no task gathers a conversation's rows. Three things of a conversation are sequences by nature and stream through one
task in constant memory but for one byte a row: its signature, its audit, its repaired text.

Nulls: a null conversation id is one conversation; a null turn sorts first and is in no gap; a null role or text is one
space. Ties in turn are in order of role, then of the MD5 of the text; repeated rows are repetitions. Texts of any length
travel once. An empty table gives no rows; a conversation without rows left gets zeros. Other columns, whatever their
names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordeval.llm.common import staged

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
ENDS = (".", "!", "?")
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 2, 3, 2, 1

#: States of the grammar: nothing yet, after s, after u, after a. Row c: the state that role c leads to, if it may come.
START, SYSTEM, USER, ASSISTANT = range(4)
AFTER = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: The user or assistant that may come next in each state: the role of what is inserted or reroled there.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}
ACCEPTS = (START, ASSISTANT)
NEVER = 1 << 62

#: A node: for each state the cost to go, the audit's letter there, and the state after it.
Node = tuple[tuple[int, str, int], ...]


def given_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) of conversations as they are: every row once."""
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
        F.lit(1).alias("copies"),
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """:func:`given_rows` with known faults, chosen by the CRC-32 of ``conv_id:turn``: rows dropped (``copies`` is 0),
    emptied, without their sentence ends, repeated, or said by the user."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    rows = given_rows(conversations)
    return rows.select(
        "conv_id",
        "turn",
        F.when(fault == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(fault == 1, F.lit("")).when(fault == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("copies"),
    )


def row_faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, blank, cut_off, copies, again): distinct rows in narrow form. ``again`` if an
    earlier turn of the conversation has the role and the text; of ``copies`` all but one are repetitions anyway."""
    core = F.rtrim("text", F.lit(SPACE))
    facts = rows.select(
        "conv_id", "turn", "role", F.md5("text").alias("digest"), (core == "").alias("blank"),
        ((core != "") & ~F.right(core, F.lit(1)).isin(*ENDS)).alias("cut_off"), "copies",
    )
    same = ["conv_id", "role", "digest"]
    counted = staged(
        facts.groupBy("conv_id", "turn", "role", "digest")
        .agg(F.first("blank").alias("blank"), F.first("cut_off").alias("cut_off"), F.sum("copies").alias("copies"))
    )
    place = lambda: F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    repeated = (
        counted.where("copies > 0").groupBy(*[F.col(c).alias(f"_{c}") for c in same])
        .agg(F.min(place()).alias("_first"), F.count("*").alias("_places")).where("_places > 1")
    )
    on = F.lit(True)
    for c in same:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    joined = counted.join(repeated, on, "left")
    return joined.select(*counted.columns, F.coalesce(place() > F.col("_first"), F.lit(False)).alias("again"))


SIGNED = pa.schema(
    [("conv_id", pa.int64()), ("signature", pa.string())] + [(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal")]
)
SIGNED_DDL = "conv_id long, signature string, gaps long, blank long, duplicate long, truncated long, illegal long"


def _batches(rows: Iterator[tuple], schema: pa.Schema, weight: int | None = None, size: int = 5000) -> Iterator[pa.RecordBatch]:
    """Record batches of ``size`` rows, or fewer where column ``weight`` has many characters."""
    held: list[tuple] = []
    chars = 0

    def batch() -> pa.RecordBatch:
        columns = list(zip(*held, strict=True)) if held else [[] for _ in schema]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    for row in rows:
        held.append(row)
        chars += len(row[weight] or "") if weight is not None else 0
        if len(held) >= size or chars >= 1 << 24:
            yield batch()
            held, chars = [], 0
    yield batch()


def signatures(faults: DataFrame) -> DataFrame:
    """Signature and counts of each conversation; ``faults`` from :func:`row_faults`.

    Symbols: ``x`` must go; ``s u a o`` by the role's initial (``o``: another), upper case if the text is cut off.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def conversations() -> Iterator[tuple]:
            conv, begun = None, False
            signature, n, low, high, distinct, before = bytearray(), [0] * 4, None, None, 0, None

            def close() -> tuple:
                gaps = high - low + 1 - distinct if distinct else 0
                return (conv, signature.decode(), gaps, *n)

            for b in batches:
                for i, turn, initial, blank, cut_off, copies, again in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if not begun or i != conv:
                        if begun:
                            yield close()
                        conv, begun = i, True
                        signature, n, low, high, distinct, before = bytearray(), [0] * 4, None, None, 0, None
                    if not copies:
                        continue
                    if turn is not None and turn != high:
                        low, high, distinct = turn if low is None else low, turn, distinct + 1
                    n[3] += copies - 1 + (before is not None and before + initial not in ("su", "ua", "au"))
                    before = initial
                    goes = blank or again
                    if goes:
                        signature += b"x"
                    else:
                        symbol = initial if initial in AFTER else "o"
                        signature += (symbol.upper() if cut_off else symbol).encode()
                        n[2] += cut_off
                    signature += b"x" * (copies - 1)
                    n[0 if blank else 1] += copies if goes else copies - 1
            if begun:
                yield close()

        yield from _batches(conversations(), SIGNED, weight=1)

    dealt = faults.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "digest")
    narrow = dealt.select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "blank", "cut_off", "copies", "again")
    return narrow.mapInArrow(run, SIGNED_DDL)


def end_node() -> Node:
    """The node of the empty suffix: nothing to do where the grammar accepts, inserts elsewhere."""
    return _with_inserts([(0, "", s) if s in ACCEPTS else (NEVER, "", s) for s in range(4)])


def _with_inserts(best: list[tuple[int, str, int]]) -> Node:
    """The better of consuming the next row and of inserting first; two inserts in a row are enough to reach any state."""
    out = list(best)
    for _ in range(2):
        out = [min(best[s], (INSERT + out[NEXT[s]][0], "I", NEXT[s])) for s in range(4)]
    return tuple(out)


def node_before(symbol: str, after: Node) -> Node:
    """The node of a suffix that begins with ``symbol`` and goes on as ``after``."""
    best = []
    for s in range(4):
        ways = [(DELETE + after[s][0], "D", s)]
        if symbol != "x":
            role, extra = symbol.lower(), CUT_OFF * symbol.isupper()
            if s in AFTER.get(role, {}):
                ways.append((KEEP + extra + after[AFTER[role][s]][0], "K", AFTER[role][s]))
            ways.append((REROLE + extra + after[NEXT[s]][0], "R", NEXT[s]))
        best.append(min(ways))
    return _with_inserts(best)


def audit_of(path: list[Node]) -> str:
    """The best audit from the start through the nodes of a signature's suffixes; ``path`` holds them from the end."""
    letters, state, at = [], START, len(path) - 1
    while True:
        _, letter, then = path[at][state]
        if not letter:
            return "".join(letters)
        letters.append(letter)
        state = then
        at -= letter != "I"


def audits(reversed_signatures: Iterator[str]) -> Iterator[tuple[str, int, str]]:
    """(reversed signature, cost, audit) of reversed signatures in order: nodes of shared suffixes are computed once."""
    path, last = [end_node()], ""
    for given in reversed_signatures:
        shared = 0
        for x, y in zip(given, last):
            if x != y:
                break
            shared += 1
        del path[shared + 1 :]
        for symbol in given[shared:]:
            path.append(node_before(symbol, path[-1]))
        last = given
        yield given, path[-1][START][0], audit_of(path)


AUDITED = pa.schema([("key", pa.string()), ("cost", pa.int64()), ("audit", pa.string())])


def repair_plans(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation of ``rows``."""
    signed = staged(signatures(row_faults(rows)).withColumn("key", F.md5("signature")))
    distinct = signed.groupBy("key").agg(F.reverse(F.first("signature")).alias("given"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def given() -> Iterator[str]:
            for b in batches:
                yield from b.column(0).to_pylist()

        found = ((hashlib.md5(g[::-1].encode(), usedforsecurity=False).hexdigest(), cost, audit) for g, cost, audit in audits(given()))
        yield from _batches(found, AUDITED, weight=2)

    by_suffix = distinct.select("given").repartitionByRange("given").sortWithinPartitions("given")
    solved = by_suffix.mapInArrow(solve, "key string, cost long, audit string")
    return signed.join(solved, "key").drop("key", "signature")


PLAN = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
REPAIRED_DDL = "conv_id long, position long, edit string, role string, text string, audit string, " + ", ".join(f"{c} long" for c in PLAN)
REPAIRED = pa.schema(
    [("conv_id", pa.int64()), ("position", pa.int64())] + [(c, pa.string()) for c in ("edit", "role", "text", "audit")] + [(c, pa.int64()) for c in PLAN]
)


def repair(rows: DataFrame) -> DataFrame:
    """The repaired conversations: for each one a row with its plan (position 0: audit, cost, counts), then its rows in
    order with their texts, and the edit that made them. Rows come sorted within partitions; ``rows`` as of
    :func:`given_rows`."""
    plans = repair_plans(rows)
    empty = lambda kind, *names: [F.lit(None).cast(kind).alias(c) for c in names]
    heads = plans.select("conv_id", F.lit(0).alias("kind"), *empty("long", "turn"), *empty("string", "role", "digest", "text"), F.lit(0).alias("copies"), "audit", *PLAN)
    texts = rows.where("copies > 0").select(
        "conv_id", F.lit(1).alias("kind"), "turn", "role", F.md5("text").alias("digest"), "text", "copies", *empty("string", "audit"), *empty("long", *PLAN)
    )
    dealt = heads.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = (None,) * (1 + len(PLAN))

        def out() -> Iterator[tuple]:
            conv, audit, at, state, position = None, "", 0, START, 0

            def inserted() -> Iterator[tuple]:
                nonlocal at, state, position
                while audit[at : at + 1] == "I":
                    at, state, position = at + 1, NEXT[state], position + 1
                    yield (conv, position, "I", NAMES[state], "", *nothing)

            for b in batches:
                for i, kind, role, text, copies, *plan in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if kind == 0:
                        yield from inserted()
                        conv, audit, at, state, position = i, plan[0], 0, START, 0
                        yield (conv, 0, None, None, None, *plan)
                    for _ in range(copies):
                        yield from inserted()
                        edit, at = audit[at], at + 1
                        if edit == "D":
                            continue
                        state = AFTER[role[0]][state] if edit == "K" else NEXT[state]
                        position += 1
                        yield (conv, position, edit, role if edit == "K" else NAMES[state], text, *nothing)
            yield from inserted()

        yield from _batches(out(), REPAIRED, weight=4)

    return dealt.select("conv_id", "kind", "role", "text", "copies", "audit", *PLAN).mapInArrow(run, REPAIRED_DDL)


DIGEST = pa.schema([("conv_id", pa.int64())] + [(c, pa.int64()) for c in PLAN] + [("audit", pa.string()), ("repaired_sha256", pa.string())])


def repair_digest(repaired: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) from the rows of :func:`repair`,
    streaming through its partitions as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            head, digest = None, None
            for b in batches:
                for conv, position, _, role, text, audit, *plan in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if position == 0:
                        if head:
                            yield (*head, digest.hexdigest())
                        head, digest = (conv, *plan, audit), hashlib.sha256()
                    else:
                        digest.update(f"{'' if position == 1 else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
            if head:
                yield (*head, digest.hexdigest())

        yield from _batches(out(), DIGEST, weight=7)

    return repaired.mapInArrow(run, "conv_id long, " + ", ".join(f"{c} long" for c in PLAN) + ", audit string, repaired_sha256 string")
