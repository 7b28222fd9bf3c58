"""Text cleaning and counting as native column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidepost.settings import STOP_WORDS, UNICODE, WHITESPACE


def filled(text: Column) -> Column:
    """Missing text counts as empty text."""
    return F.coalesce(text, F.lit(""))


def strip_tags(text: Column) -> Column:
    """Drop ``<...>`` spans; a span never crosses a line break."""
    return F.regexp_replace(text, "<[^\\n]*?>", "")


def unescape_newlines(text: Column) -> Column:
    """Turn the two characters backslash and n into one space; real line breaks stay."""
    return F.replace(text, F.lit("\\n"), F.lit(" "))


def letters_only(text: Column, keep_backslash: bool = False) -> Column:
    """Keep ASCII letters and white space.

    ``keep_backslash=True`` is the literal reading of the original character class: white space
    goes as well and backslashes stay, so a document becomes one long token.
    """
    if keep_backslash:
        return F.regexp_replace(text, "[^a-zA-Z\\\\]++", "")
    return F.regexp_replace(text, f"{UNICODE}[^a-zA-Z{WHITESPACE}]++", "")


def tokens(text: Column) -> Column:
    """White-space tokens, never empty ones."""
    return F.array_remove(F.split(text, f"{UNICODE}[{WHITESPACE}]+"), "")


def lowered_tokens(text: Column) -> Column:
    return tokens(F.lower(filled(text)))


def without_stop_words(words: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    stop = list(stop_words)
    return F.filter(words, lambda word: ~word.isin(stop)) if stop else words


def clean_tokens(text: Column, stop_words: Sequence[str] = STOP_WORDS,
                 keep_backslash: bool = False) -> Column:
    """Tags and escaped line breaks out, lower case, letters only, stop words out."""
    plain = F.lower(unescape_newlines(strip_tags(filled(text))))
    return without_stop_words(tokens(letters_only(plain, keep_backslash)), stop_words)


def clean_text(text: Column, stop_words: Sequence[str] = STOP_WORDS,
               keep_backslash: bool = False) -> Column:
    return F.concat_ws(" ", clean_tokens(text, stop_words, keep_backslash))


def word_count(text: Column) -> Column:
    """Pieces between single spaces, empty pieces included; empty text has one."""
    full = filled(text)
    return (F.length(full) - F.length(F.replace(full, F.lit(" "), F.lit(""))) + 1).cast("long")


def company_in_description(company: Column, desc: Column) -> Column:
    """Case-sensitive containment; a missing side is False, an empty company is True."""
    return F.coalesce(F.contains(desc, company), F.lit(False))


def strip_label(text: Column, label: str) -> Column:
    return F.trim(F.replace(text, F.lit(label), F.lit("")))


def delimited_part(text: Column, delimiter: str, part: int) -> Column:
    """The ``part``-th (from 1) piece, trimmed; NULL when the text has fewer pieces."""
    pieces = F.split(text, "\\Q" + delimiter + "\\E")
    return F.when(F.size(pieces) >= part, F.trim(F.get(pieces, F.lit(part - 1))))


def id_from_urn(urn: Column) -> Column:
    """Fourth ``:``-piece of a URN, or NULL."""
    return F.nullif(F.split_part(urn, F.lit(":"), F.lit(4)), F.lit(""))


def id_from_card(attribute: Column, href: Column) -> Column:
    """The id attribute if there is one, else what follows ``view/`` in the link."""
    from_link = F.regexp_extract(href, "view/([^/]*)", 1)
    return F.coalesce(F.nullif(attribute, F.lit("")), F.nullif(from_link, F.lit("")))


def parse_rating(reply: Column) -> Column:
    """The reply as an integer, 0 where it is none."""
    body = F.regexp_replace(reply, f"{UNICODE}^[{WHITESPACE}]+|[{WHITESPACE}]+$", "")
    digits = F.when(F.regexp_like(body, F.lit("^[+-]?[0-9]+$")), body)
    return F.coalesce(digits.try_cast("long"), F.lit(0).cast("long"))
