"""Main text of pages by template deduction from equivalence classes.

Tokens are the containers of a page and its blocks of text. Tokens of one host with the same occurrence
vector (how often on which page) are one equivalence class. A vector is as long as a host has pages, so it
is not gathered: it is folded into counts and a sum of page hashes times occurrences, which is equal where
the vectors are, whatever the order of folding. Texts nest in their
containers by path: a text on most of the pages that have its container, or on the very pages of a class of
containers (a layout), is the template's own, so an empty page, an error page or a second layout changes
nothing. What containers hold besides are their slots; slots of classes that hold mostly links are menus; the
slots left are the pages' own text, from which those of named boilerplate (adverts, notices, comments,
forms and the like) are taken out. If a page marks its article, only slots inside count, and of the article that
it is about everything stays but such boilerplate.

Support is a weight: ``PRIOR_PAGES`` pages without the text are added to those seen, so that the share asked for falls
with the pages that a container has, and a class's share of links is drawn towards that of the same slot on
all hosts as if ``PRIOR_WORDS`` words of those had been read. How large host or table are does not count otherwise.

Defined cases: null html is empty and gives empty text; null url or one without host is a host of its own;
equal pages of a host count once, so a host of copies is one of few pages; a page that says only
what the template says keeps it; very long pages are read whole; unclosed markup ends with
the page; no rows give no rows; other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidepost.llm.markup import Block, article_of, blocks
from tidepost.llm.store import ship, written
from tidepost.llm.urlfilter import host_of

PRIOR_PAGES = 4
PRIOR_WORDS = 50
LINK_SHARE = 0.5
# A text on this share of the pages that have its container is the template's.
FRAME_SHARE = 0.5
_FLUSH_TOKENS = 100_000

_TOKENS = ("host string, token string, within string, is_text boolean, pages long, occurrences long, vector long, "
           "words long, link_words long")


def path_mark(path: str) -> str:
    return xxhash.xxh3_64_hexdigest(path)


def text_mark(path: str, text: str) -> str:
    """A text in its container: the same words elsewhere are another token."""
    return "=" + path_mark(path) + xxhash.xxh3_64_hexdigest(text)


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of many pages, folded per host before they leave the task."""
    sums: dict[tuple[str, str], list[int]] = {}

    def out() -> pa.RecordBatch:
        keys = list(sums)
        values = list(zip(*sums.values(), strict=True))
        batch = pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys]),
             pa.array([k[1][1:17] if k[1][0] == "=" else path_mark(k[1] if k[1] != ">" else "") for k in keys]),
             pa.array([k[1][0] == "=" for k in keys]), *[pa.array(v, pa.int64()) for v in values]],
            ["host", "token", "within", "is_text", "pages", "occurrences", "vector", "words", "link_words"])
        sums.clear()
        return batch

    for batch in batches:
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            found: dict[str, list[int]] = {"": [1, 0, 0]}  # the page itself: once on each
            for b in blocks(page):
                for token in (b.path, text_mark(b.path, b.text)):
                    entry = found.setdefault(token, [0, 0, 0])
                    entry[0] += 1
                    entry[1] += b.words
                    entry[2] += b.link_words
            mark = xxhash.xxh3_64_intdigest(page or "") & 0xFFFFFFFFFF
            for token, (n, words, links) in found.items():
                entry = sums.setdefault((host, token or ">"), [0] * 5)
                for i, x in enumerate((1, n, n * mark, words, links)):
                    entry[i] += x
        if len(sums) > _FLUSH_TOKENS:
            yield out()
    if sums:
        yield out()


def templates(pages: DataFrame) -> DataFrame:
    """Per host: ``fixed`` (texts of the template) and ``menus`` (paths of slots that hold links), as marks, from (host, html)."""
    # Copies of a page say nothing about what its template repeats; they are folded before the shuffle.
    page = F.coalesce("html", F.lit(""))
    distinct = (pages.withColumn("digest", F.md5(page.cast("binary"))).dropDuplicates(["host", "digest"])
                .select("host", "html"))
    tokens = written(distinct.mapInArrow(_tokens, _TOKENS).groupBy("host", "token", "within", "is_text").agg(
        *[F.sum(c).alias(c) for c in ("pages", "occurrences", "vector", "words", "link_words")])
        .filter("not is_text or pages > 1"), "tokens")
    slots = tokens.filter("not is_text and token <> '>'").withColumn("parent", F.xxhash64(F.regexp_replace("token", ">[^>]*$", "")))
    # Equivalence classes: equal vectors of one host. Slots of a class that nest in one container are judged together.
    vector = ["host", "pages", "occurrences", "vector"]
    classes = slots.groupBy(*vector, "parent").agg(F.sum("words").alias("class_words"), F.sum("link_words").alias("class_links"))
    pooled = slots.groupBy("within").agg((F.sum("link_words") / F.greatest(F.sum("words"), F.lit(1))).alias("usual"))
    share = (F.col("class_links") + F.col("usual") * PRIOR_WORDS) / (F.col("class_words") + PRIOR_WORDS)
    links = slots.join(classes, [*vector, "parent"]).join(pooled, "within").filter(share > LINK_SHARE).select("host", "within")
    menus = links.groupBy("host").agg(F.collect_set("within").alias("menus"))
    # A text is nested in its container. It is the template's if it is on most pages that have the container, or on
    # the very pages of a class of containers, a layout.
    containers = tokens.filter("not is_text")
    texts = tokens.filter("is_text")
    on_most = (texts.join(containers.select("host", "within", F.col("pages").alias("held")), ["host", "within"])
               .filter(F.col("pages") - 1 >= (F.col("held") - 1 + PRIOR_PAGES) * FRAME_SHARE))
    layouts = containers.filter((F.col("occurrences") == F.col("pages")) & (F.col("pages") > PRIOR_PAGES)).select(*vector).distinct()
    of_layout = texts.join(layouts, vector, "left_semi")
    fixed = (on_most.select("host", "token").unionByName(of_layout.select("host", "token"))
             .groupBy("host").agg(F.collect_set("token").alias("fixed")))
    return menus.join(fixed, "host", "full")


def main_blocks(page: str | None, menus: set[str], fixed: set[str]) -> list[Block]:
    """The blocks of a page that are its article."""
    found = blocks(page)
    about = article_of(found)
    left = [b for b in found if not b.dropped and (b.article and b.article == about or path_mark(b.path) not in menus)]
    left = [b for b in left if b.main] or left
    # Pages of one text differ elsewhere: what is all that a page says is its text, whoever repeats it.
    return [b for b in left if b.article and b.article == about or text_mark(b.path, b.text) not in fixed] or left


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per page: page_id, url, text and n_chars."""
    ship(pages.sparkSession)
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).cast("string").alias("html"),
                        F.coalesce(host_of(F.col(url).cast("string")), F.lit("")).alias("host"))
    deduced = written(templates(rows.select("host", "html")), "templates")
    joined = rows.join(deduced, "host", "left").select("page_id", "url", "html", "menus", "fixed")

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for page, menus, fixed in zip(*[batch.column(c).to_pylist() for c in ("html", "menus", "fixed")], strict=True):
                found = main_blocks(page, set(menus or ()), set(fixed or ()))
                texts.append("\n".join(b.text for b in found))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    types = dict(rows.dtypes)
    return joined.mapInArrow(extracted, f"page_id {types['page_id']}, url {types['url']}, text string, n_chars long")
