"""Decoding, recoding and labelling expressions (survey P05-P22); all stay inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

CSV_MISSING = "__CSV_MISSING__"
SOURCE_MISSING = "__SOURCE_MISSING__"
UNSEEN = "__UNSEEN__"
RESERVED = (CSV_MISSING, SOURCE_MISSING, UNSEEN)

#: Cost of predicting column j for true class i (fixed values).
COSTS = ((0, 1, 2), (2, 0, 1), (5, 3, 0))
LOWER_IS_BETTER = ("ordinal_mae", "mean_asymmetric_cost")


def hash32(text: Column) -> Column:
    """The first 8 hex digits of the md5 as a number: an order that any engine can reproduce."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def normalize_code(value: Column, keep_text: bool = True) -> Column:
    """``"3.0"`` to ``"3"``; other text is kept or becomes null."""
    text = F.trim(value)
    number = F.regexp_replace(text, r"\.0+$", "").try_cast("bigint").cast("string")
    return F.when(text.rlike(r"^-?\d+(\.0+)?$"), number).otherwise(text if keep_text else F.lit(None))


def recode(value: Column, mapping: dict, strict: bool = True) -> Column:
    """Value by mapping; with ``strict`` a non-null value outside the mapping is an error."""
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    found = F.try_element_at(pairs, value)
    if not strict:
        return found
    error = F.raise_error(F.concat(F.lit("value outside the mapping: "), value.cast("string")))
    return F.when(value.isNotNull() & found.isNull(), error).otherwise(found)


def canonical_category(value: Column) -> Column:
    """Null and empty to a token, integer-like text normalised, padded or reserved text refused."""
    bad = (value != F.trim(value)) | value.isin(*RESERVED)
    shown = normalize_code(value)
    return (
        F.when(value.isNull() | (value == ""), F.lit(SOURCE_MISSING))
        .when(bad, F.raise_error(F.concat(F.lit("padded or reserved category: "), value)))
        .otherwise(shown)
    )


def sentinel_to_null(value: Column, sentinels: Sequence) -> Column:
    """P09."""
    return F.when(~value.isin(*sentinels), value)


def checked_number(value: Column) -> Column:
    """P10: blank to null, a number to double, anything else is an error."""
    text = F.trim(value)
    number = text.try_cast("double")
    wrong = text.isNotNull() & (text != "") & number.isNull()
    return F.when(wrong, F.raise_error(F.concat(F.lit("not a number: "), value)).cast("double")).otherwise(number)


def parsed_date(value: Column, fmt: str = "dd/MM/yyyy") -> Column:
    """A date, or null where the text isn't one."""
    return F.try_to_date(value, fmt) if hasattr(F, "try_to_date") else F.to_date(F.try_to_timestamp(value, F.lit(fmt)))


def month_code(date: Column) -> Column:
    """M01 to M12."""
    return F.concat(F.lit("M"), F.lpad(F.month(date).cast("string"), 2, "0"))


def hour_code(clock: Column) -> Column:
    """H00 to H23 from a valid HH:MM text, else null."""
    return F.when(clock.rlike(r"^([01]\d|2[0-3]):[0-5]\d$"), F.concat(F.lit("H"), F.substring(clock, 1, 2)))


def classify(name: Column, rules: Sequence[tuple[str, str]], strict: bool = True) -> Column:
    """The class of the first rule (pattern, class) that matches; no match is an error."""
    start = F.when(name.rlike(rules[0][0]), F.lit(rules[0][1]))
    chain = reduce(lambda c, r: c.when(name.rlike(r[0]), F.lit(r[1])), rules[1:], start)
    return chain.otherwise(F.raise_error(F.concat(F.lit("no rule for "), name)) if strict else F.lit(None))


def paired_outcome(true: Column, a: Column, b: Column) -> Column:
    """Which of two predictions is right."""
    return (
        F.when((a == true) & (b == true), "both_correct")
        .when(a == true, "only_a_correct")
        .when(b == true, "only_b_correct")
        .when(a == b, "both_wrong_same")
        .otherwise("both_wrong_different")
    )


def direction(true: Column, predicted: Column) -> Column:
    """P17."""
    return F.when(predicted > true, "over").when(predicted < true, "under").otherwise("correct")


def asymmetric_cost(true: Column, predicted: Column) -> Column:
    """Cost of one prediction."""
    costs = F.array(*[F.array(*[F.lit(c) for c in row]) for row in COSTS])
    return F.get(F.get(costs, true.cast("int")), predicted.cast("int"))


def orientation(metric: Column) -> Column:
    """-1 for metrics where less is better, else 1."""
    return F.when(metric.isin(*LOWER_IS_BETTER), -1).otherwise(1)


def interval_evidence(point: Column, low: Column, high: Column) -> Column:
    """P19 for one interval."""
    return (
        F.when((point > 0) & (low > 0), "clear_positive")
        .when((point < 0) & (high < 0), "clear_negative")
        .otherwise("direction_uncertain")
    )


def argmax_class(probabilities: Column) -> Column:
    """Index of the first largest probability."""
    return (F.array_position(probabilities, F.array_max(probabilities)) - 1).cast("int")


def normalised(probabilities: Column, floor: float = 1e-15) -> Column:
    """Clipped to [floor, 1] and divided by their sum."""
    clipped = F.transform(probabilities, lambda p: F.least(F.greatest(p, F.lit(floor)), F.lit(1.0)))
    total = F.aggregate(clipped, F.lit(0.0), lambda a, p: a + p)
    return F.transform(clipped, lambda p: p / total)


def close(a: Column, b: Column, atol: float = 1e-10, rtol: float = 1e-8) -> Column:
    """Equal as text, or numbers with NaN = NaN and infinities exact, or close."""
    x, y = a.try_cast("double"), b.try_cast("double")
    near = F.abs(x - y) <= F.greatest(F.lit(atol), F.lit(rtol) * F.greatest(F.abs(x), F.abs(y)))
    infinite = F.abs(x).isin(float("inf")) | F.abs(y).isin(float("inf"))
    numbers = F.when(F.isnan(x) | F.isnan(y), F.isnan(x) & F.isnan(y)).when(infinite, x == y).otherwise(near)
    return F.coalesce(a.cast("string").eqNullSafe(b.cast("string")) | F.coalesce(numbers, F.lit(False)), F.lit(False))


def plain_text(html: Column) -> Column:
    """Tags out, the five named entities and no-break spaces resolved, white space folded."""
    text = F.regexp_replace(html, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def is_safe_path(path: Column) -> Column:
    """Whether a path is relative and stays below its root: no drive or leading slash, no backslash, no empty, ``.`` or ``..``
    part, no control character; null and empty paths aren't."""
    parts = F.split(path, "/")
    bad = F.exists(parts, lambda p: p.isin("", ".", ".."))
    return F.coalesce((path != "") & ~path.rlike(r"[\\\x00-\x1f]|^[A-Za-z]:") & ~bad, F.lit(False))
