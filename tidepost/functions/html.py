"""Fields and visible text out of landed HTML, as native column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidepost.settings import UNICODE, WHITESPACE

_ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
             ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]


def unescape_entities(text: Column) -> Column:
    """Named entities to characters, the ampersand last so that nothing is unescaped twice."""
    for entity, char in _ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def squeeze(text: Column) -> Column:
    """Runs of white space to one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{UNICODE}[{WHITESPACE}]+", " "))


def visible_text(html: Column) -> Column:
    """Text pieces of an element joined by one space; comments, scripts and styles do not count."""
    body = F.regexp_replace(html, "(?s)<!--.*?-->", " ")
    body = F.regexp_replace(body, "(?is)<script\\b[^>]*>.*?</script>", " ")
    body = F.regexp_replace(body, "(?is)<style\\b[^>]*>.*?</style>", " ")
    body = F.regexp_replace(body, "(?s)<[^>]*>", " ")
    return squeeze(unescape_entities(body))


def first_of(html: Column, patterns: Sequence[str]) -> Column:
    """First pattern (one capture group each) that finds something, as visible text; else NULL."""
    return F.coalesce(*[F.nullif(visible_text(F.regexp_extract(html, pattern, 1)), F.lit(""))
                        for pattern in patterns])


def first_raw(html: Column, patterns: Sequence[str]) -> Column:
    """Like :func:`first_of` for attribute values."""
    return F.coalesce(*[F.nullif(F.trim(unescape_entities(F.regexp_extract(html, pattern, 1))), F.lit(""))
                        for pattern in patterns])


def first_containing(html: Column, pattern: str, words: str) -> Column:
    """Text of the first element matched by ``pattern`` whose text has ``words``; else NULL."""
    inner = F.transform(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)), visible_text)
    return F.get(F.filter(inner, lambda text: F.contains(text, F.lit(words))), F.lit(0))


def element(tag: str, css_class: str | None = None, dom_id: str | None = None) -> str:
    """Pattern for the inner HTML of the first ``tag`` element with that class or id."""
    head = f"<{tag}\\b"
    if css_class is not None:
        head += f"(?=[^>]*\\bclass=[\"'](?:[^\"']*\\s)?{css_class}(?:\\s[^\"']*)?[\"'])"
    if dom_id is not None:
        head += f"(?=[^>]*\\bid=[\"']{dom_id}[\"'])"
    return f"(?is){head}[^>]*>(.*?)</{tag if tag.isalnum() else '[a-z0-9]+'}>"


def attribute(tag: str, name: str, css_class: str | None = None) -> str:
    """Pattern for an attribute value of the first ``tag`` element with that class."""
    head = f"<{tag}\\b"
    if css_class is not None:
        head += f"(?=[^>]*\\bclass=[\"'](?:[^\"']*\\s)?{css_class}(?:\\s[^\"']*)?[\"'])"
    return f"(?is){head}[^>]*?\\b{name}=[\"']([^\"']*)[\"']"


def inside(tag: str, css_class: str, rest: str) -> str:
    """Pattern for ``rest`` after the opening of the first ``tag`` element with that class."""
    head = f"<{tag}\\b(?=[^>]*\\bclass=[\"'](?:[^\"']*\\s)?{css_class}(?:\\s[^\"']*)?[\"'])[^>]*>"
    return f"(?is){head}.*?" + rest.removeprefix("(?is)")


def posted_at_raw(html: Column, attribute_patterns: Sequence[str],
                  text_patterns: Sequence[str]) -> Column:
    """The ``datetime`` attribute if the element has one, else its text."""
    return F.coalesce(first_raw(html, attribute_patterns), first_of(html, text_patterns))


def posted_at_typed(raw: Column) -> Column:
    """The raw posting time as a timestamp where it is one, else NULL ("2 weeks ago")."""
    return raw.try_cast("timestamp_ntz")
