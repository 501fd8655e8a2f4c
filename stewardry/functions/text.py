"""Text expressions: normalising, tokens, padding, file names, search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import DEFAULT_FILE_NAME

# Fixed pattern: Unicode white space plus the four ASCII separators.
SPACE = r"[\s\x1c-\x1f]+"


def normalise(name: Column) -> Column:
    """Lower case without outer white space of any kind (ideographic space included)."""
    return F.regexp_replace(F.lower(name), f"(?U)^{SPACE}|{SPACE}$", "")


def tokens(text: Column) -> Column:
    """Distinct white-space separated words."""
    words = F.split(text, f"(?U){SPACE}")
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def grams(text: Column, size: int) -> Column:
    """Distinct substrings of ``size`` code points; empty when the text is shorter."""
    starts = F.sequence(F.lit(1), F.length(text) - (size - 1))
    pieces = F.transform(starts, lambda i: F.substr(text, i, F.lit(size)))
    return F.when(F.length(text) >= size, F.array_distinct(pieces)).otherwise(
        F.array().cast("array<string>")
    )


def word_overlap(left: Column, right: Column) -> Column:
    """Shared words over the larger word set; null when either set is empty."""
    smaller, larger = F.least(F.size(left), F.size(right)), F.greatest(F.size(left), F.size(right))
    return F.when(smaller > 0, F.size(F.array_intersect(left, right)) / larger)


def pad_number(number: Column, width: Column | int) -> Column:
    """Zero-padded to ``width``; longer numbers keep all their digits."""
    width = width if isinstance(width, Column) else F.lit(width)
    digits = number.cast("string")
    return F.when(F.length(digits) >= width, digits).otherwise(
        F.lpad(digits, width, F.lit("0"))
    )


def blank_to_null(value: Column) -> Column:
    """Empty text counts as absent."""
    return F.nullif(value, F.lit(""))


def is_filled(value: Column) -> Column:
    """Neither null nor empty; white space counts as filled."""
    return F.coalesce(F.length(value) > 0, F.lit(False))


def safe_file_name(path: Column) -> Column:
    """Last path part with separators replaced and a default for nothing left."""
    trimmed = F.regexp_replace(path, r"(/\.?)+$", "")
    last = F.regexp_extract(trimmed, r"([^/]*)$", 1)
    last = F.when(last == ".", F.lit("")).otherwise(last)
    clean = F.regexp_replace(last, r"[/\\]", "_")
    return F.coalesce(blank_to_null(clean), F.lit(DEFAULT_FILE_NAME))


def iso_time(at: Column) -> Column:
    """ISO text with microseconds only when there are any."""
    whole = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(at, "SSSSSS")
    return F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))


def matches_any(query: str, columns: list[str]) -> Column:
    """Case-insensitive literal substring search over several columns."""
    needle = F.lower(F.lit(query))
    hits = [F.coalesce(F.contains(F.lower(F.col(c)), needle), F.lit(False)) for c in columns]
    return reduce(lambda a, b: a | b, hits)
