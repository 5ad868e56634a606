"""Column expressions over texts that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = "[ \\t-\\r]+"
NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else. ``lower`` is faster and does the same where all characters are ASCII."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def parts(text: Column, separators: str) -> Column:
    """The non-empty parts between separators; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separators), "")


def drawn(key: Column, wanted: int, of: int) -> Column:
    """True for about ``wanted`` of ``of`` distinct keys, the same ones each time: those with the smallest hashes.

    A filter, unlike the first rows of an order, sends no more than the drawn rows on.
    """
    return F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(min(1.0, wanted / max(1, of)) * (1 << 30))


def positions(n: Column) -> Column:
    """0, 1, ..., n - 1; empty for n <= 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
