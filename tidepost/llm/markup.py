"""Blocks of text of an HTML page, with the containers they stand in. Pure functions on one page."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

# Element kinds.
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var wbr br".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title noscript iframe textarea xmp noembed noframes template svg select".split())
BOILERPLATE_TAGS = frozenset("nav aside form footer menu dialog button head fieldset".split())
# Words of class, id and role that name what is not the article.
BOILERPLATE_NAMES = frozenset(
    "ad ads adbox advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "discussion discussions disqus feedback footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pager "
    "pagination popup promo promotion recommended related replies reply respond responses share sharing sidebar signup skip "
    "social sponsor sponsored subscribe toolbar widget contentinfo complementary search alert".split())
# Words that add nothing to such a name: "page-header" and "sidebar_left" are one, "has-sidebar" is not.
HOLDER_WORDS = frozenset(
    "area articles bar block bottom box container content entry group inner items left links list page panel post posts "
    "right section site stories top unit wrap wrapper".split())
MAIN_TAGS = frozenset(("article", "main"))
_CLOSED_BY = {"p": None, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
              "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?([a-zA-Z][^\s/>]*)([^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*)(?:>|\Z)"""
                  r"""|</?[a-zA-Z][^>]*(?:>|\Z)|</?\Z""", re.S)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_RAW_END = {name: re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I) for name in RAW}
_DIGITS = re.compile(r"\d+")
_WORD_PARTS = re.compile(r"[a-z]+")


@dataclass(slots=True)
class Block:
    path: str
    text: str
    words: int
    link_words: int
    main: bool
    dropped: bool
    # Number of the outermost article that the block stands in, 0 outside.
    article: int = 0


@dataclass(slots=True, eq=False)
class _Named:
    """A container dropped for its name only; void if it turns out to hold what the page is about."""

    words: int = 0
    mains: int = 0
    articles: int = 0


@dataclass(slots=True)
class _Open:
    tag: str
    path: str
    main: bool
    dropped: bool
    named: tuple[_Named, ...] = ()
    article: int = 0


def _is_boilerplate(name: str, in_main: bool) -> bool:
    parts = set(_WORD_PARTS.findall(name))
    if in_main:
        parts.discard("header")  # an article's own header holds its heading
    return not parts.isdisjoint(BOILERPLATE_NAMES) and parts <= BOILERPLATE_NAMES | HOLDER_WORDS


def _opened(tag: str, attributes: str, parent: _Open) -> _Open:
    label, names = tag, []
    if "=" in attributes:
        for match in _NAMES.finditer(attributes):
            value = match.group(2) or match.group(3) or match.group(4) or ""
            names.extend(value.lower().split())
            label += "." + _DIGITS.sub("#", value.strip())
    main = parent.main or tag in MAIN_TAGS
    named = parent.named
    if tag not in ("html", "body", "article", "main") and any(_is_boilerplate(n, parent.main) for n in names):
        named = (*named, _Named())
    outer_header = tag == "header" and not parent.main
    return _Open(tag, f"{parent.path}>{label}", main, parent.dropped or outer_header or tag in BOILERPLATE_TAGS, named,
                 parent.article)


def _drop_named(found: list[tuple[Block, tuple[_Named, ...]]], articles: int, outside: int) -> None:
    """Drop what named containers hold, but for those around the page's article or, without one, most of its text."""
    total = 0
    for block, named in found:
        if not block.dropped:
            total += block.words - block.link_words
            for n in named:
                n.words += block.words - block.link_words
    for block, named in found:
        block.dropped = block.dropped or any(not (n.mains or not outside and (
            n.articles == 1 or 2 * n.words > total and (n.articles or not articles))) for n in named)


def blocks(page: str | None) -> list[Block]:
    """The blocks of a page in order; white space inside each is one space, character references are decoded."""
    found: list[tuple[Block, tuple[_Named, ...]]] = []
    if not page:
        return []
    articles = outside = 0
    stack = [_Open("", "", False, False)]
    parts: list[str] = []
    links: list[str] = []
    in_link = False
    at = 0

    def add(raw: str) -> None:
        if raw:
            parts.append(raw)
            if in_link:
                links.append(raw)

    def flush() -> None:
        if parts:
            words = html.unescape("".join(parts)).split()
            if words:
                top = stack[-1]
                linked = len(html.unescape("".join(links)).split()) if links else 0
                found.append((Block(top.path, " ".join(words), len(words), linked, top.main, top.dropped, top.article), top.named))
            parts.clear()
            links.clear()

    while True:
        match = _TAG.search(page, at)
        if match is None:
            add(page[at:])
            break
        add(page[at:match.start()])
        at = match.end()
        if match.group(1) is None:
            continue
        tag = match.group(1).lower()
        closing = page[match.start() + 1] == "/"
        if tag in INLINE:
            if tag == "a":
                in_link = not closing
            elif tag == "br":
                add(" ")
            continue
        flush()
        if closing:
            if any(o.tag == tag for o in stack):
                while stack.pop().tag != tag:
                    pass
                in_link = False
        elif tag in RAW:
            if not (match.group(2) or "").rstrip().endswith("/"):
                end = _RAW_END[tag].search(page, at)
                at = end.end() if end else len(page)
        elif tag not in VOID:
            ends = _CLOSED_BY.get(tag)
            if stack[-1].tag == "p" or (ends and stack[-1].tag in ends):
                stack.pop()
                if ends and stack[-1].tag in ends:
                    stack.pop()
            stack.append(_opened(tag, match.group(2) or "", stack[-1]))
            if tag in MAIN_TAGS and not stack[-1].dropped:
                articles += 1
                if tag == "article" and not stack[-1].article:
                    stack[-1].article = articles
                outside += not stack[-1].named
                for n in stack[-1].named:
                    n.mains += tag == "main"
                    n.articles += tag == "article"
    flush()
    _drop_named(found, articles, outside)
    return [block for block, _ in found]


def article_of(found: list[Block]) -> int:
    """The article that the page is about: the one with most words that are no links, 0 without any."""
    words: dict[int, int] = {}
    for block in found:
        if block.article and not block.dropped:
            words[block.article] = words.get(block.article, 0) + block.words - block.link_words
    return max(words, key=lambda n: (words[n], -n), default=0)
