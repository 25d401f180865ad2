"""Identifiers: UUID checks and retry-safe generated ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _hex_digits(value: Column) -> Column:
    bare = F.replace(F.replace(value, F.lit("urn:"), F.lit("")), F.lit("uuid:"), F.lit(""))
    return F.replace(F.regexp_replace(bare, r"^[{}]+|[{}]+$", ""), F.lit("-"), F.lit(""))


def _hyphenate(digits: Column) -> Column:
    return F.regexp_replace(digits, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def uuid_valid(value: Column) -> Column:
    """Hyphens, braces and the ``urn:uuid:`` prefix are optional; null and empty are invalid."""
    return F.coalesce(_hex_digits(value).rlike("^[0-9a-fA-F]{32}$"), F.lit(False))


def uuid_canonical(value: Column) -> Column:
    return F.when(uuid_valid(value), _hyphenate(F.lower(_hex_digits(value))))


def stable_id(*key: Column) -> Column:
    """UUID-shaped hash of a key, equal on every retry. Parts are length-prefixed, so unambiguous."""
    parts = []
    for part in key:
        text = F.coalesce(part.cast("string"), F.lit(""))
        parts += [F.char_length(text).cast("string"), F.lit(":"), text]
    return _hyphenate(F.md5(F.concat(*parts)))
