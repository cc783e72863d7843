"""Ids: UUIDs in any spelling, blank references, epoch text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UUID = (
    r"(?iU)^\s*(?:urn:uuid:)?\{?"
    r"([0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12})"
    r"\}?\s*$"
)


def uuid_hex(c: Column) -> Column:
    """32 lower-case hex digits of a UUID spelled with or without hyphens, braces, urn prefix, capitals or white space around; null for any other text."""
    found = F.regexp_extract(c, _UUID, 1)
    return F.when(found != "", F.lower(F.regexp_replace(found, "-", "")))


def uuid_key(c: Column) -> Column:
    """The 16 bytes of a UUID, the compact form for joins and shuffles; null if the text isn't a UUID."""
    return F.unhex(uuid_hex(c))


def dashed(hex32: Column) -> Column:
    """Hyphens into 32 hex digits. One pattern, so that what gives the digits is evaluated once."""
    return F.regexp_replace(hex32, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def uuid_text(key: Column) -> Column:
    """Lower case with hyphens, from 16 bytes."""
    return dashed(F.lower(F.hex(key)))


def is_blank(c: Column) -> Column:
    """Null, empty, or nothing but white space."""
    return c.isNull() | c.rlike(r"(?U)^\s*$")


def epoch(c: Column) -> Column:
    """Epoch text as a number; text that is no number, and null, sort before every time."""
    return F.coalesce(c.try_cast("double"), F.lit(float("-inf")))
