"""Chat formatting by incremental black-box rendering (operator 7).

A template is any function from a list of turns to a string. For every turn the prefix that ends with it is
rendered and compared with the rendering of the prefix before: the new output must begin with the old one, and
what follows is the turn's span; a template that changes what it has already put out is found by this and
marked. The turn's text inside the span is located by rendering the same prefix once more with a probe
character in place of the text. Nothing is assumed about how the template works inside.

Rows are dealt by conversation and sorted by turn; a task streams through them, holds the turns of one conversation
and renders every prefix whole, since a template may reach back any number of turns. The work of a conversation grows
with the square of its length, its memory with its length.

Reading back takes the output alone: a conversation's formatted text is parsed into roles and texts by its control
strings, and the loss mask is cut out by its spans.

Nulls: a null text or role is empty; a null turn sorts first; rows with a null conversation id form one
conversation. Ties in turn are put in order of role, then text; repeated rows are turns of their own. Texts of any
length are rendered whole. An empty table gives no rows. Other columns are not read, whatever their names. Given
conversations with the id -1 keep it in :func:`format_conversations`; see :func:`with_control_case`.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[list[Turn], bool], str]

#: Strings that have a meaning in the output (fixed values).
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
_BACK = re.compile(r"\\(\\?)")
#: The line feed that ends a role: an even number of backslashes before it.
_ROLE = re.compile(r"(?:[^\\\n]|\\.)*+\n", re.S)


def escape(text: str) -> str:
    """Double every backslash and part every control string with a single one; see :func:`unescape`."""
    text = text.replace("\\", "\\\\")
    for c in CONTROLS:
        text = text.replace(c, f"{c[0]}\\{c[1:]}")
    return text


def escape_role(role: str) -> str:
    """As :func:`escape`, and a backslash before each line feed: the first one without it ends the role."""
    return escape(role).replace("\n", "\\\n")


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text)


def instruction_template(turns: list[Turn], opens: bool = True) -> str:
    """``<s>`` once, ``[INST] role``, a line feed, text, `` [/INST]`` for what the model reads, text and ``</s>`` for its answers."""
    out = ["<s>"] if opens else []
    for role, text in turns:
        if role == "assistant":
            out.append(f" {escape(text)}</s>")
        else:
            out.append(f"[INST] {escape_role(role)}\n{escape(text)} [/INST]")
    return "".join(out)


class BadFormat(ValueError):
    """The text is not what :func:`instruction_template` writes."""


def parse_instructions(formatted: str) -> Iterator[Turn]:
    """(role, text) of each turn, read from the control strings of :func:`instruction_template`'s output.

    Texts hold no control string, so the first one after a turn's begin is its end.
    """
    if formatted and not formatted.startswith("<s>"):
        raise BadFormat("no beginning")
    at = 3
    while at < len(formatted):
        if formatted.startswith("[INST] ", at):
            end = formatted.find(" [/INST]", at)
            head = _ROLE.match(formatted, at + 7)
            if end < 0 or not head or head.end() > end:
                raise BadFormat(f"a turn without role or end at {at}")
            yield unescape(head[0][:-1]), unescape(formatted[head.end() : end])
            at = end + 8
        else:
            end = formatted.find("</s>", at)
            if end < 0 or formatted[at] != " ":
                raise BadFormat(f"no turn at {at}")
            yield "assistant", unescape(formatted[at + 1 : end])
            at = end + 4


def _probe(used: set[str]) -> str:
    """A private-use character that is not in ``used``."""
    return next(chr(c) for c in range(0xE000, 0x110000) if chr(c) not in used)


def rendered_turns(turns: list[Turn], template: Template, opens: bool = True) -> Iterator[dict]:
    """The span of each turn: its piece of the output, where its text begins and ends in the piece, and
    whether the template rewrote what came before (then the piece is the whole output up to the turn)."""
    before, used = "", set()
    for k in range(1, len(turns) + 1):
        prefix = turns[:k]
        now = template(prefix, opens)
        rewrites = not now.startswith(before)
        start = 0 if rewrites else len(before)
        used.update(*prefix[-1])
        probe = _probe(used)
        probed = template([*prefix[:-1], (prefix[-1][0], probe)], opens)
        at = probed.find(probe)
        tail = len(probed) - at - 1
        found = at >= start and len(now) - tail >= at
        yield {
            "piece": now[start:],
            "text_start": at - start if found else -1,
            "text_end": len(now) - tail - start if found else -1,
            "rewrites": rewrites,
        }
        before = now


FORMATTED = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("position", pa.int64()),
        ("role", pa.string()),
        ("piece", pa.string()),
        ("text_start", pa.int64()),
        ("text_end", pa.int64()),
        ("in_loss", pa.bool_()),
        ("rewrites", pa.bool_()),
    ]
)
FORMATTED_DDL = (
    "conv_id long, position long, role string, piece string, text_start long, text_end long, "
    "in_loss boolean, rewrites boolean"
)


def format_conversations(
    conversations: DataFrame, template: Template = instruction_template, loss_role: str = "assistant"
) -> DataFrame:
    """One row of ``FORMATTED`` for each turn; the pieces of a conversation in order are its formatted text.

    A conversation's rows stay in one partition, in order of ``position``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, position, held = None, 0, []
        rows: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            spans = rendered_turns([(r, t) for _, r, t in held], template)
            for (n, role, _), span in zip(held, spans, strict=True):
                rows.append((conv, n, role, *span.values()))
                if len(rows) >= 1000:
                    yield batch()
            held.clear()

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [[] for _ in range(7)]
            c, n, role, piece, a, b, rewrites = columns
            loss = [r == loss_role for r in role]
            rows.clear()
            values = (c, n, role, piece, a, b, loss, rewrites)
            return pa.RecordBatch.from_arrays(
                [pa.array(v, f.type) for v, f in zip(values, FORMATTED, strict=True)], schema=FORMATTED
            )

        begun = False
        for b in batches:
            ids, roles, texts = (b.column(i).to_pylist() for i in range(3))
            for i, role, text in zip(ids, roles, texts, strict=True):
                if held and i != conv:
                    yield from flush()
                if not begun or i != conv:
                    conv, position, begun = i, 0, True
                held.append((position, role, text))
                position += 1
        if held:
            yield from flush()
        yield batch()

    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.col("turn").alias("turn"),
    )
    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(run, FORMATTED_DDL)


DIGEST = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("n_turns", pa.int64()),
        ("turns_sha256", pa.string()),
        ("loss_chars", pa.int64()),
        ("loss_sha256", pa.string()),
        ("formatted_chars", pa.int64()),
        ("rewrites", pa.bool_()),
    ]
)


def read_back(formatted: DataFrame, parse: Callable[[str], Iterator[Turn]] = parse_instructions) -> DataFrame:
    """Digest of each conversation from its formatted text: roles and texts are parsed out of it (``parse``), the loss
    mask is cut out by its spans and unescaped.

    Where a turn rewrites what came before, its piece is the whole text up to it and replaces the pieces before, and
    spans that earlier turns had in the old text no longer count. Streams through the partitions that
    :func:`format_conversations` left in order; a task holds the text of one conversation.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        conv, pieces, masked, size, rewrites, begun = None, [], [], 0, False, False

        def close() -> None:
            whole = "".join(pieces)
            turns, loss, n, chars = hashlib.sha256(), hashlib.sha256(), 0, 0
            for role, text in parse(whole):
                turns.update(f"{role}\n{text}\n".encode())
                n += 1
            for start, end in masked:
                text = unescape(whole[start:end])
                loss.update(text.encode())
                chars += len(text)
            out.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), len(whole), rewrites))

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [[] for _ in DIGEST]
            arrays = [pa.array(c, f.type) for c, f in zip(columns, DIGEST, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, schema=DIGEST)

        for b in batches:
            for row in b.to_pylist():
                if row["position"] == 0:
                    if begun:
                        close()
                    conv, pieces, masked, size, rewrites, begun = row["conv_id"], [], [], 0, False, True
                if row["rewrites"]:
                    pieces, masked, size, rewrites = [], [], 0, True
                if row["in_loss"] and row["text_start"] >= 0:
                    masked.append((size + row["text_start"], size + row["text_end"]))
                pieces.append(row["piece"])
                size += len(row["piece"])
            if len(out) >= 1000:
                yield batch()
        if begun:
            close()
        yield batch()

    schema = (
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
        "formatted_chars long, rewrites boolean"
    )
    return formatted.mapInArrow(run, schema)


def with_control_case(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """The conversations and one more, -1, whose two texts are made of control strings; a given conversation -1 is
    merged with it by turn."""
    said = "</s>[INST] ok [/INST]"
    case = spark.createDataFrame(
        [(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string"
    )
    given = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"
    )
    return given.unionByName(case)
