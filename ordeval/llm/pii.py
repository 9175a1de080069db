"""Personal data: base patterns and information-theoretic sanitisation (operator 8).

Emails, IP addresses, card and phone numbers are found by fixed patterns. Protected entities are each found value and
the group it belongs to (an email's domain, the first two parts of an IP address, the first digits of a card or phone
number), so that values that are mentioned once are judged together. From the whole corpus it is then estimated how
strongly the terms of the documents that hold an entity reveal it: with N documents, n(t) that have term t, n(e) that
hold entity e and n(t, e) that have both, the disclosure is PMI(t; e) / IC(e) = log(N n(t, e) / (n(t) n(e))) /
log(N / n(e)), 1 for a term that occurs nowhere else. All four are counts of documents over all their terms.

Terms from GENERALISE on are replaced by the wider class of what they reveal (``[EMAIL TERM]``), from REMOVE on they
are taken out, wherever they occur in a document that holds the entity. A pair must not be a coincidence: its
witnesses are the different contexts of the entity or of the term in the texts that share them, and the chance
that as many meet at random (Chernoff's bound on the binomial tail), times the number of pairs looked at, is at most
CHANCE. So exact copies of one passage are one witness and disclose nothing, and one witness is never enough, however
rare its terms are. Near copies that differ next to the entity or to the term count as witnesses of their own.

The first pass reads whole texts and leaves narrow rows, and the texts that hold entities; those are read again for
the pairs, for the witnesses of the few pairs that disclose, and for the marks. One more pass counts the candidate terms in all documents. Candidate terms are
broadcast up to MAX_TERMS, a bound that is checked; beyond it the same counts are joined.

Nulls: a null text is an empty one and null ids pass through. Rows that repeat an id are told apart by text; repeated
rows get the same spans. Ties: of equal disclosures the first kind of ``BASE`` names the class. Very long texts are
read whole; spans are looked up in order, so many spans cost n log n steps. An empty table gives no rows. Other
columns are not read, whatever their names, and pass through :func:`sanitised`.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ordeval.llm.common import free_name, map_arrow, small_batches, staged

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, *(f"{k}_term" for k in BASE), "drop")
MARKS = {k: "" if k == "drop" else f"[{k.upper().replace('_', ' ')}]" for k in KINDS}
CONTEXT_WORDS = 5
CHANCE = 0.01
GENERALISE, REMOVE = 0.85, 0.97
MAX_TERMS = 200_000

# A run of word characters before an @ is found from the @, so long runs cost no retries.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W\d_]{3,}")

Span = tuple[int, int, str]


def _emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end(), "email"
            done = m.end()
        at = text.find("@", at + 1)


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) in order of start, then kind as in ``BASE``; a failed match is dropped without retries."""
    spans = list(_emails(text))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            spans.append((*m.span(), "ip"))
    for m in _CARD.finditer(text):
        if 14 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
            spans.append((*m.span(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                spans.append((*m.span(), "phone"))
    return in_order(spans)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def listed(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def _merged(spans: list[Span]) -> list[list[int]]:
    """[start, end] of the stretches that spans cover, disjoint and in order."""
    out: list[list[int]] = []
    for start, end, _ in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def free_terms(text: str, spans: list[Span]) -> list[re.Match]:
    """The terms of a text that are no part of a span, in order."""
    terms, bounds, i = [], _merged(spans), 0
    for m in _TERM.finditer(text):
        while i < len(bounds) and bounds[i][1] <= m.start():
            i += 1
        if i == len(bounds) or bounds[i][0] >= m.end():
            terms.append(m)
    return terms


def _context(terms: list[str]) -> int:
    return xxhash.xxh3_64_intdigest(" ".join(terms).encode("utf-8", "surrogatepass")) >> 1


def group_of(kind: str, value: str) -> str:
    """What a value belongs to: the domain of an email, two parts of an IP address, the first digits of a number."""
    if kind == "email":
        return value.rpartition("@")[2].lower()
    return ".".join(value.split(".")[:2]) if kind == "ip" else value[: 6 if kind == "card" else 4]


def mentions(text: str, spans: list[Span], terms: list[str], starts: list[int], ends: list[int]) -> dict[str, int]:
    """The context of the first mention of each entity of a text (the terms around it); values and their groups."""
    out: dict[str, int] = {}
    for s, e, kind in spans:
        value = _digits(text[s:e]) if kind in ("card", "phone") else text[s:e]
        names = [n for n in (f"{kind}:{value}", f"{kind}@{group_of(kind, value)}") if n not in out]
        if names:
            last, following = bisect_right(ends, s), bisect_left(starts, e)
            around = terms[max(0, last - CONTEXT_WORDS) : last] + terms[following : following + CONTEXT_WORDS]
            out.update(dict.fromkeys(names, _context(around)))
    return out


def read_terms(text: str, spans: list[Span]) -> tuple[list[str], dict[str, int]]:
    """The terms of a text outside its spans, in order, and the entities it holds with their contexts."""
    found = free_terms(text, spans)
    terms = [m[0].lower() for m in found]
    return terms, mentions(text, spans, terms, [m.start() for m in found], [m.end() for m in found])


FOUND = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("text_hash", pa.int64()),
        *[(f"n_{k}", pa.int64()) for k in BASE],
        ("base", pa.string()),
        ("entities", pa.list_(pa.string())),
        ("text", pa.string()),
    ]
)


def found_in(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Base spans of every document and the entities it holds; the text of those that hold any."""

    def find(columns: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {f.name: [] for f in FOUND}
        for doc, h, text in zip(columns["doc_id"], columns["text_hash"], columns["text"], strict=True):
            spans = base_spans(text or "")
            kinds = Counter(k for *_, k in spans)
            out["doc_id"].append(doc)
            out["text_hash"].append(h)
            for k in BASE:
                out[f"n_{k}"].append(kinds[k])
            out["base"].append(listed(spans))
            out["entities"].append(list(mentions(text, spans, [], [], [])))
            out["text"].append(text if spans else None)
        return out

    given = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text")
    )
    counts = ", ".join(f"n_{k} long" for k in BASE)
    return map_arrow(given, find, f"doc_id long, text_hash long, {counts}, base string, entities array<string>, text string", FOUND)


def different_texts(found: DataFrame) -> DataFrame:
    """(text_hash, base, n, text, entities): the different texts that hold entities, each with its number of documents.
    Copies are read once from here on; a text is known by its hash and its base spans."""
    texts = found.where("text IS NOT NULL").groupBy("text_hash", "base")
    return staged(texts.agg(F.count("*").alias("n"), F.first("text").alias("text"), F.first("entities").alias("entities")))


def held_entities(texts: DataFrame) -> DataFrame:
    """(text_hash, base, entity) of the entities that more than one text holds: others can have no two witnesses."""
    each = texts.select("text_hash", "base", F.explode("entities").alias("entity"))
    often = each.groupBy("entity").agg(F.count("*").alias("n")).where("n > 1")
    return staged(each.join(often.select("entity"), "entity"))


PART = pa.schema([("entity", pa.string()), ("term", pa.string()), ("docs", pa.int64()), ("texts", pa.int64())])


def texts_with(texts: DataFrame, by_text: DataFrame, what: str) -> DataFrame:
    """(n, text, ``what``) of the texts of ``by_text`` (text_hash, base, ``what``)."""
    small_batches(texts.sparkSession)
    return texts.join(by_text, ["text_hash", "base"]).select("n", "text", what)


def shared_documents(texts: DataFrame, held: DataFrame) -> DataFrame:
    """(entity, term, docs, texts): documents, and different texts, with both. Rows with the term '' count an entity's
    documents, rows with the entity '' those of a term among the documents that hold any.

    Each task sums up its own documents first, so a frequent entity is a few rows a task.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: Counter[tuple[str, str]] = Counter()
        seen: Counter[tuple[str, str]] = Counter()

        def flush() -> pa.RecordBatch:
            columns = [[e for e, _ in docs], [t for _, t in docs], list(docs.values()), list(map(seen.__getitem__, docs))]
            docs.clear(), seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PART, strict=True)], schema=PART)

        for b in batches:
            for n, text, entities in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                terms = {"", *(m[0].lower() for m in free_terms(text, base_spans(text)))}
                for entity in ("", *entities):
                    for term in terms:
                        docs[entity, term] += n
                        seen[entity, term] += 1
                    if len(docs) >= 200_000:
                        yield flush()
        yield flush()

    by_text = held.groupBy("text_hash", "base").agg(F.collect_set("entity").alias("held"))
    parts = texts_with(texts, by_text, "held").mapInArrow(count, "entity string, term string, docs long, texts long")
    return parts.groupBy("entity", "term").agg(F.sum("docs").alias("docs"), F.sum("texts").alias("texts"))


CONTEXTS = pa.schema([("entity", pa.string()), ("term", pa.string()), ("own", pa.int64()), ("far", pa.int64())])


def witnesses_of(texts: DataFrame, held: DataFrame, pairs: DataFrame) -> DataFrame:
    """(entity, term, witnesses) of ``pairs`` (entity, term): in how many different contexts of the entity, or of the
    term, their texts have both; a text is one context of each, that of the first place."""

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = set()
            for text, wanted in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                terms, own = read_terms(text, base_spans(text))
                first: dict[str, int] = {}
                for i, term in enumerate(terms):
                    first.setdefault(term, i)
                for pair in wanted:
                    if (i := first.get(pair["term"])) is not None:
                        far = _context(terms[max(0, i - CONTEXT_WORDS) : i + CONTEXT_WORDS + 1])
                        rows.add((pair["entity"], pair["term"], own[pair["entity"]], far))
            columns = list(zip(*rows)) if rows else [[] for _ in CONTEXTS]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, CONTEXTS, strict=True)], schema=CONTEXTS)

    by_text = held.join(pairs.select("entity", "term"), "entity").groupBy("text_hash", "base")
    wanted = by_text.agg(F.collect_list(F.struct("entity", "term")).alias("wanted"))
    seen = texts_with(texts, wanted, "wanted").mapInArrow(contexts, "entity string, term string, own long, far long")
    return seen.groupBy("entity", "term").agg(F.greatest(F.count_distinct("own"), F.count_distinct("far")).alias("witnesses"))


def documents_with(docs: DataFrame, terms: DataFrame, text_col: str, most: int = MAX_TERMS) -> DataFrame:
    """(term, in_docs): in how many of all documents each of ``terms`` (distinct) occurs.

    Terms are the same at every size: matched in the text as it is, then put in lower case. Each task sums up first.
    """
    few = terms.limit(most + 1).count() <= most
    wanted = docs.sparkSession.sparkContext.broadcast(frozenset(r["term"] for r in terms.collect())) if few else None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            columns = [pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())]
            total.clear()
            return pa.RecordBatch.from_arrays(columns, ["term", "n"])

        for b in batches:
            for text in b.column(0).to_pylist():
                held = {t.lower() for t in set(_TERM.findall(text or ""))}
                total.update(held if wanted is None else wanted.value & held)
                if len(total) > most:
                    yield flush()
        yield flush()

    small_batches(docs.sparkSession)
    counted = docs.select(text_col).mapInArrow(count, "term string, n long")
    if not few:
        counted = counted.join(terms, "term", "left_semi")
    return counted.groupBy("term").agg(F.sum("n").alias("in_docs"))


def surprise(together: Column, in_docs: Column, holding: Column, witnesses: Column, n: Column) -> Column:
    """How unlikely it is, as -log of a bound, that a term that has nothing to do with the entity shares it as often:
    the Chernoff bound of the binomial tail, for as many trials as the pair's witnesses stand for."""
    q, p = together / in_docs, holding / n
    apart = F.when(q < 1, (1 - q) * F.log((1 - q) / (1 - p))).otherwise(F.lit(0.0))
    return F.when(q > p, F.least(witnesses, together) / q * (q * F.log(q / p) + apart)).otherwise(F.lit(0.0))


def disclosing(docs: DataFrame, texts: DataFrame, held: DataFrame, text_col: str = "text") -> DataFrame:
    """(entity, term, disclosure) of the pairs that reach GENERALISE and are no coincidence; all counts are over the
    whole corpus. Each count leaves fewer pairs for the next one."""
    n = F.lit(float(max(2, docs.count())))
    looked = Observation()
    is_pair = (F.col("entity") != "") & (F.col("term") != "")
    counts = shared_documents(texts, held).observe(looked, F.count_if(is_pair).alias("pairs"))
    counts = staged(counts.where("texts >= 2 OR term = ''"))
    limit = math.log(max(1, looked.get["pairs"]) / CHANCE)
    holding = counts.where("term = ''").select("entity", F.least(F.col("docs").cast("double"), n - 1).alias("holding"))
    among = counts.where("entity = ''").select("term", F.col("docs").alias("among"))
    both = counts.where(is_pair).select("entity", "term", F.col("docs").cast("double").alias("together"))

    def revealing(df: DataFrame, in_docs: Column) -> DataFrame:
        pmi = F.log(n * F.col("together") / (in_docs * F.col("holding")))
        named = df.withColumn("in_docs", in_docs).withColumn("disclosure", pmi / F.log(n / F.col("holding")))
        return named.where(F.col("disclosure") >= GENERALISE)

    # a term is in all documents at least as often as among those that hold entities: what can't reach the limit goes
    pairs = staged(revealing(both.join(holding, "entity").join(among, "term"), F.col("among").cast("double")).drop("in_docs"))
    every = documents_with(docs, pairs.select("term").distinct(), text_col).withColumnRenamed("in_docs", "every")
    in_docs = F.greatest(F.coalesce("every", "among"), "among").cast("double")
    pairs = staged(revealing(pairs.join(every, "term", "left"), in_docs).drop("every", "among"))
    unlikely = surprise(F.col("together"), F.col("in_docs"), F.col("holding"), F.col("witnesses"), n)
    met = pairs.join(witnesses_of(texts, held, pairs), ["entity", "term"])
    return met.where((F.col("witnesses") >= 2) & (unlikely >= limit)).select("entity", "term", "disclosure")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, n_*, base, added) of each document; ``added`` are the spans of disclosing terms."""
    found = staged(found_in(docs, id_col, text_col))
    texts = different_texts(found)
    held = held_entities(texts)
    pairs = staged(disclosing(docs, texts, held, text_col))
    place = F.array_position(F.array(*[F.lit(k) for k in BASE]), F.regexp_extract("entity", "^[a-z]+", 0))
    kind = F.when(F.col("most.disclosure") >= REMOVE, F.lit("drop"))
    for i, k in enumerate(BASE):
        kind = kind.when(F.col("most.place") == -i - 1, F.lit(f"{k}_term"))
    wanted = (
        held.join(pairs, "entity")
        .groupBy("text_hash", "base", "term")
        .agg(F.max(F.struct("disclosure", (-place).alias("place"))).alias("most"))
        .select("text_hash", "base", "term", kind.alias("kind"))
        .groupBy("text_hash", "base")
        .agg(F.map_from_entries(F.collect_list(F.struct("term", "kind"))).alias("wanted"))
    )

    @F.pandas_udf("array<struct<start: bigint, end: bigint, kind: string>>")
    def places(texts, wanted):  # noqa: ANN001, ANN202
        import pandas as pd

        def one(text: str, kinds: dict) -> list[dict]:
            kinds, terms = dict(kinds), free_terms(text, base_spans(text))
            return [{"start": m.start(), "end": m.end(), "kind": kinds[t]} for m in terms if (t := m[0].lower()) in kinds]

        return pd.Series([one(t, w) for t, w in zip(texts, wanted, strict=True)], dtype=object)

    small_batches(docs.sparkSession)
    added = texts.join(wanted, ["text_hash", "base"]).select("text_hash", "base", places("text", "wanted").alias("added"))
    return found.drop("entities", "text").join(staged(added), ["text_hash", "base"], "left")


def span_digest(found: DataFrame) -> DataFrame:
    """The contract's columns; all spans in order of start, then kind."""
    order = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    base = F.when(F.col("base") == "", F.array().cast("array<string>")).otherwise(F.split("base", ","))
    part = lambda s, i: F.split(s, ":").getItem(i)
    parsed = F.transform(
        base,
        lambda s: F.struct(
            part(s, 1).cast("long").alias("start"), order[part(s, 0)].alias("o"), part(s, 2).cast("long").alias("end"), part(s, 0).alias("kind")
        ),
    )
    more = F.transform(
        F.coalesce("added", F.array().cast("array<struct<start: bigint, end: bigint, kind: string>>")),
        lambda a: F.struct(a["start"].alias("start"), order[a["kind"]].alias("o"), a["end"].alias("end"), a["kind"].alias("kind")),
    )
    text = F.transform(F.array_sort(F.concat(parsed, more)), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return found.select(
        "doc_id",
        *[f"n_{k}" for k in BASE],
        F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"),
        F.array_join(text, ",").alias("spans"),
    )


def replaced(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its mark; overlapping spans become one, marked as the first of them."""
    out, done = [], 0
    for start, end, kind in in_order(spans):
        if start >= done:
            out += [text[done:start], MARKS[kind]]
        done = max(done, end)
    return "".join(out) + text[done:]


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with base spans and disclosing terms replaced in the text; ``n_chars``, if there, is counted anew.

    Only documents with disclosing terms have rows to join; that table is staged, so its size is known and Spark
    broadcasts it while it is small.
    """
    found = personal_data(docs, id_col, text_col)
    id_, hash_, more = (free_name(docs, c) for c in ("found_id", "found_hash", "found_spans"))
    listed_spans = F.transform("added", lambda a: F.concat_ws(":", a["kind"], a["start"].cast("string"), a["end"].cast("string")))
    marked = found.where("added IS NOT NULL")
    added = staged(
        marked.select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_), listed_spans.alias(more)).distinct()
    )

    @F.pandas_udf("string")
    def clean(texts, added):  # noqa: ANN001, ANN202
        import pandas as pd

        def one(text: str | None, more: object) -> str | None:
            if text is None:
                return None
            spans = base_spans(text)
            for item in more if more is not None else ():
                kind, start, end = item.split(":")
                spans.append((int(start), int(end), kind))
            return replaced(text, spans) if spans else text

        return pd.Series([one(t, a) for t, a in zip(texts, added, strict=True)], dtype=object)

    small_batches(docs.sparkSession)
    same = F.col(id_col).cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64(text_col) == F.col(hash_))
    out = docs.join(added, same, "left").withColumn(text_col, clean(F.col(text_col), F.col(more)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length(text_col).cast("long"))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
