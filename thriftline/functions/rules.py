"""Ordered rule tables turned into native column expressions."""
from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, functions as F

from . import fixed_values as fv


def first_match(rules: Iterable[tuple[str, Column]], otherwise: str | None) -> Column:
    """The label of the first rule whose predicate holds, else ``otherwise``."""
    chain = None
    for label, predicate in rules:
        chain = F.when(predicate, label) if chain is None else chain.when(predicate, label)
    fallback = F.lit(otherwise).cast("string")
    return fallback if chain is None else chain.otherwise(fallback)


def keyword_pattern(keywords: Sequence[str]) -> str:
    """One alternation per rule; rules are never merged, as that loses their order.

    The look-ahead on the first letters only lets the matcher skip positions
    where no keyword can start.
    """
    heads = "".join(sorted({word[0] for word in keywords}))
    if not heads.isalnum():
        raise ValueError("a keyword must start with a letter or digit")
    return f"(?=[{heads}])(?:{'|'.join(keywords)})"


def category_of(text: Column, rules=fv.CATEGORY_RULES, otherwise: str = fv.OTHER_CATEGORY) -> Column:
    """Category of a lower-cased narration (first matching keyword rule)."""
    return first_match(((name, text.rlike(keyword_pattern(words))) for name, words in rules), otherwise)


def category_names(rules=fv.CATEGORY_RULES, otherwise: str = fv.OTHER_CATEGORY) -> list[str]:
    return [name for name, _ in rules] + [otherwise]


def persona_of(rules=fv.PERSONA_RULES, otherwise: str = fv.DEFAULT_PERSONA) -> Column:
    """Persona from the signal columns; predicates are SQL text so a rule set is plain data."""
    return first_match(((name, F.expr(predicate)) for name, predicate in rules), otherwise)


def at_least(value: Column, steps, otherwise: str) -> Column:
    """Label of the first ``(lower bound, label)`` step that ``value`` reaches."""
    return first_match(((label, value >= bound) for bound, label in steps), otherwise)


def one_hot(value: Column, flags: dict[str, str]) -> dict[str, Column]:
    """0/1 indicator per flag column; NULL counts as 0."""
    return {flag: F.when(value == label, 1).otherwise(0) for flag, label in flags.items()}


def membership_bit(value: Column, members: Sequence[str]) -> Column:
    """A one-bit mask for ``value``; ``bit_count(bit_or(...))`` then counts distinct members.

    Works for at most 63 known members and needs no distinct aggregate.  A value
    outside the list raises, because it would silently not be counted.
    """
    if len(members) > 63:
        raise ValueError("a bit mask holds at most 63 members")
    position = F.array_position(F.array(*[F.lit(m) for m in members]), value).cast("int")
    unknown = F.raise_error(F.concat(F.lit("value outside the member list: "), value)).cast("long")
    return (
        F.when(value.isNull(), F.lit(0).cast("long"))
        .when(position > 0, F.call_function("shiftleft", F.lit(1).cast("long"), position - 1))
        .otherwise(unknown)
    )
