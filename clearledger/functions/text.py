"""Cleaning and masking of text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Escape tokens and what they stand for, the phone pattern, the
# mask texts and the characters that count as white space.
ESCAPED_SPACE = "_x0020_"
ESCAPED_CHARACTERS = {
    "_x0030_": "0",
    "_x0031_": "1",
    "_x0032_": "2",
    "_x0033_": "3",
    "_x0034_": "4",
    "_x0035_": "5",
    "_x0036_": "6",
    "_x0037_": "7",
    "_x0038_": "8",
    "_x0039_": "9",
    "_x0020_": " ",
}
ESCAPE_PREFIX = "_x00"
PHONE_PATTERN = (
    r"(?U)^[\s\x1c-\x1f]*([0-9]{4})[\s\x1c-\x1f]?[0-9]{4}[\s\x1c-\x1f]*\z"
)
PHONE_MASK = "$1 XXXX"
REDACTION = "XXXXX"
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def empty_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def strip(c: Column) -> Column:
    """Trim all Unicode white space, not only U+0020 as ``trim`` does."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def unescape_spaces(c: Column) -> Column:
    return F.replace(c, F.lit(ESCAPED_SPACE), F.lit(" "))


def decode_phone(c: Column) -> Column:
    """Decode escaped digits and spaces, then strip.

    The replacements run one after the other in table order because one of
    them can complete a later token. Values without any token skip them.
    """
    decoded = c
    for token, character in ESCAPED_CHARACTERS.items():
        decoded = F.replace(decoded, F.lit(token), F.lit(character))
    return strip(F.when(c.contains(ESCAPE_PREFIX), decoded).otherwise(c))


def is_phone(c: Column) -> Column:
    return c.rlike(PHONE_PATTERN)


def mask_phone(c: Column) -> Column:
    """Keep the first four digits of an eight-digit number; leave the rest alone.

    White space around a number does not matter; a value that is no number
    keeps its own.
    """
    return F.regexp_replace(c, PHONE_PATTERN, PHONE_MASK)


def redact(c: Column) -> Column:
    return F.when(c != "", F.lit(REDACTION))
