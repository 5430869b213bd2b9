"""Text scalars, all JVM side."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Every character Python's ``str.strip`` removes; there is none above U+3000.
WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
_NON_BLANK = f"[^{WHITESPACE}]"


def as_column(value: str | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def strip(text: Column) -> Column:
    """Strip Unicode whitespace at both ends (plain ``trim`` only knows the space)."""
    return F.trim(text, F.lit(WHITESPACE))


def not_blank(text: Column) -> Column:
    """True when a non-whitespace character exists; stops at the first one. Null is blank."""
    return F.coalesce(text.rlike(_NON_BLANK), F.lit(False))


def base_lang(lang: Column) -> Column:
    """The language in front of the first dash: ``en-ko`` -> ``en``."""
    return F.split_part(lang, F.lit("-"), F.lit(1))


def text_id(text: Column, lang: Column) -> Column:
    """Content key: language plus the first 16 hex digits of SHA-1 over language and text."""
    digest = F.sha1(F.concat(lang, F.lit("||"), text))
    return F.concat(lang, F.lit("_"), F.substring(digest, 1, 16))


def passage_text(passage: Column) -> Column:
    """Text of a passage struct: ``text``, or ``passage`` where that is empty."""
    empty = F.lit("")
    return F.coalesce(F.nullif(passage["text"], empty), F.nullif(passage["passage"], empty), empty)


def in_language(lang: Column, prefix: str) -> Column:
    return F.startswith(lang, F.lit(prefix))
