"""Text cleaning as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that counts as white space at the ends of a text.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


_VISIBLE = "".join(chr(code) for code in range(33, 127))


def _visible_ends(text: Column) -> Column:
    """First and last character are visible ASCII, so there is nothing to trim: two comparisons and a
    look-up instead of a search in all white space at both ends. The empty text fails the first one."""
    return (text >= "!") & (text < "\x7f") & F.lit(_VISIBLE).contains(F.substring(text, -1, 1))


def _stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE_SPACE))


def trimmed(text: Column) -> Column:
    return F.when(_visible_ends(text), text).otherwise(_stripped(text))


def clean_text(text: Column) -> Column:
    """Trim; an empty result becomes NULL."""
    return F.when(_visible_ends(text), text).otherwise(F.nullif(_stripped(text), F.lit("")))


def trimmed_or_empty(text: Column) -> Column:
    """Trim; NULL becomes the empty text."""
    return F.coalesce(trimmed(text), F.lit(""))


def is_country_code(text: Column, length: int) -> Column:
    return text.rlike(f"^[A-Z]{{{length}}}\\z")


def short_id(identifier: Column) -> Column:
    """Last path segment of an identifier URL; NULL when nothing is left."""
    path = F.regexp_replace(trimmed(identifier), "/+$", "")
    return F.nullif(F.element_at(F.split(path, "/"), -1), F.lit(""))


def lenient_number(value: Column) -> Column:
    """Numeric value, or NULL where the text is not a number."""
    return value.try_cast("double")


def safe_slug(text: Column) -> Column:
    """Lower-case text with every other run of characters turned into one dash."""
    return F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))
