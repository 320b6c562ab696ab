"""Column functions for narrations, amounts, dates, replies and language codes."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import fixed_values as fv


def amount(raw: Column) -> Column:
    """'1,234.50' -> 1234.5; blank or unreadable text -> NULL."""
    return F.translate(raw, ",", "").try_cast("double")


def unsigned_amount(raw: Column) -> Column:
    """Digits and points only, so the sign is lost; NULL becomes 0.0, unreadable text NULL."""
    digits = F.regexp_replace(raw, "[^0-9.]", "").try_cast("double")
    return F.when(raw.isNull(), F.lit(0.0)).otherwise(digits)


def spaced_amount(raw: Column) -> Column:
    """Drops commas and spaces, keeps the sign."""
    return F.translate(raw, ", ", "").try_cast("double")


def statement_date(raw: Column, fmt: str = "dd-MM-yyyy") -> Column:
    """Unreadable dates become NULL."""
    return F.try_to_date(raw, fmt)


def merchant(raw: Column, variant: str = "batch") -> Column:
    """First payment handle or upper-case word (batch), or first known brand (dlt).

    No match gives ``''``, never NULL, and so counts as one merchant downstream.
    """
    if variant == "batch":
        return F.regexp_extract(raw, fv.MERCHANT_PATTERN, 0)
    brands = "|".join(fv.MERCHANT_BRANDS_DLT)
    return F.regexp_extract(F.lower(raw), f"({brands})", 1)


def clean_reply(raw: Column, chars: int = fv.REPLY_CHARS, fallback: str = fv.FALLBACK_REPLY) -> Column:
    """Remove closed and unclosed <think> parts, trim, fall back if nothing is left, cut to length.

    The cut is the output size of the speech step; the whole text is cleaned first.
    """
    no_closed = F.regexp_replace(raw, "(?s)<think>.*?</think>", "")
    visible = strip_space(F.regexp_replace(no_closed, "(?s)<think>.*", ""))
    spoken = F.when(F.length(visible) > 0, visible).otherwise(F.lit(fallback))
    return F.substring(spoken, 1, chars)


def strip_space(value: Column) -> Column:
    """Trim all white space, not only blanks."""
    return F.regexp_replace(value, r"^\s+|\s+$", "")


def language_code(raw: Column) -> Column:
    """'hi-IN' -> 'hi'; missing or unsupported codes -> the default language."""
    short = F.split_part(raw, F.lit("-"), F.lit(1))
    return F.when(short.isin(*fv.LANGUAGES), short).otherwise(F.lit(fv.DEFAULT_LANGUAGE))


def language_name(code: Column) -> Column:
    pairs = [F.lit(part) for pair in fv.LANGUAGES.items() for part in pair]
    return F.element_at(F.create_map(*pairs), code)


def title_case(value: Column) -> Column:
    """'shg_woman' -> 'Shg Woman'."""
    return F.initcap(F.replace(value, F.lit("_"), F.lit(" ")))


def rupees(value: Column) -> Column:
    """Whole rupees as text, for the text chunks."""
    return F.round(value, 0).cast("long").cast("string")


def hash_fraction(key: Column, seed: int | str) -> Column:
    """A reproducible number in [0, 1) from a key: the first 32 bits of md5(seed || ':' || key)."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
