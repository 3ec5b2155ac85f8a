"""Text expressions: normalisation, fingerprints, cuts, keyword matching."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Placeholders for the parts of a message that vary, in this order.
VARIABLE_PARTS = [
    (r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "<uuid>"),
    (r"(?i)\b[0-9a-f]{16,}\b", "<hex>"),
    (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "<ip>"),
    (r"\b\d{4,}\b", "<num>"),
]
STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with"]


def normalise_message(message: Column) -> Column:
    """The message without what differs between two occurrences of one error; null counts as empty."""
    out = F.coalesce(message, F.lit(""))
    for pattern, placeholder in VARIABLE_PARTS:
        out = F.regexp_replace(out, pattern, placeholder)
    return F.lower(F.trim(out))


def fingerprint(message: Column) -> Column:
    return F.sha2(normalise_message(message), 256)


def cut(text: Column, n: int, mark: str = "") -> Column:
    """The first n characters, with mark if something was cut off."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(mark))).otherwise(text)


def tokens(text: Column) -> Column:
    """Distinct words in lower case, without stop words."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9]+")
    return F.array_except(F.array_distinct(F.filter(words, lambda w: w != "")), F.array(*map(F.lit, STOP_WORDS)))


def matches_all(text: Column, words: list[str]) -> Column:
    """Whether all words that aren't stop words occur in the text."""
    own = tokens(text)
    match = F.lit(True)
    for w in words:
        if w.lower() not in STOP_WORDS:
            match &= F.array_contains(own, w.lower())
    return match
