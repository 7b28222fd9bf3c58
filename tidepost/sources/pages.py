"""Landed pages to typed posting rows and to lists of cards: one rule set per page layout.

A page is taken apart once, in Arrow batches, and all fields of a layout are read from its tree.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepost.functions.dom import Node, Select, first_value, parse
from tidepost.functions.html import posted_at_typed
from tidepost.session import ship_package

_CARD = "job-details-jobs-unified-top-card__"


@dataclass(frozen=True)
class Layout:
    """Ordered selectors per field; the first that finds something wins.

    ``labels`` are words taken off a field's text. ``posted`` finds the element with the posting time,
    whose ``datetime`` attribute counts before its text. ``missing`` stands for what is not found. ``cards``
    are the elements of a list, the first selector with any hit; ``card_id`` names a card.
    """

    source: str
    fields: Mapping[str, tuple[Select, ...]] = field(default_factory=dict)
    posted: tuple[Select, ...] = ()
    labels: Mapping[str, str] = field(default_factory=dict)
    missing: str | None = None
    cards: tuple[Select, ...] = ()
    card_id: tuple[Select, ...] = ()

    @property
    def names(self) -> list[str]:
        return [*self.fields, *(["posted_at_raw"] if self.posted else [])]

    def read(self, root: Node) -> dict[str, str | None]:
        found = {name: first_value(root, selects) for name, selects in self.fields.items()}
        for name, label in self.labels.items():
            found[name] = ((found[name] or "").replace(label, "").strip()) or None
        if self.missing is not None:
            found = {name: self.missing if value is None else value for name, value in found.items()}
        if self.posted:
            node = next((n for s in self.posted for n in s.all(root)), None)
            found["posted_at_raw"] = None if node is None else (node.attributes.get("datetime") or node.text() or None)
        return found

    def card_nodes(self, root: Node) -> list[Node]:
        for select in self.cards:
            nodes = list(select.all(root))
            if nodes:
                return nodes
        return []


# Where each layout keeps its fields.
_LOGO = Select("img", within=Select("a", within=Select("div", "top-card-layout__card")), take="alt")
_TITLE = Select("a", within=Select("div", "top-card-layout__entity-info"))
_DESCRIPTION = Select(css=_CARD + "primary-description")

LAYOUTS = {
    "guest_detail": Layout(
        source="LinkedIn",
        fields={"companies": (_LOGO,), "titles": (_TITLE,),
                "level": (Select("li", within=Select("ul", "description__job-criteria-list")),),
                "location": (Select("span", "topcard__flavor topcard__flavor--bullet"),)},
        posted=(Select("span", "topcard__flavor--metadata"), Select("time")),
        labels={"level": "Seniority level"}),
    "api_detail": Layout(
        source="LinkedIn",
        fields={"companies": (_LOGO,), "titles": (_TITLE,), "desc": (Select("div", "show-more-less-html__markup"),)},
        posted=(Select(css="posted-time-ago__text"), Select("time"))),
    "signed_in_detail": Layout(
        source="LinkedIn",
        fields={
            "titles": (Select(css=_CARD + "job-title"), Select("h1"), Select(css="top-card-layout__title"), Select("h2", "t-24")),
            "companies": (Select("a", holding=("href", "/company/")), Select(css=_CARD + "company-name"),
                          Select(css="topcard__flavor--bullet"), Select("a", within=_DESCRIPTION)),
            "location": (Select(css=_CARD + "bullet"), Select(css="topcard__flavor--bullet"),
                         Select("span", within=_DESCRIPTION, nth=2), Select(css=_CARD + "primary-description", part=("|", 2))),
            "desc": (Select(dom_id="workspace"), Select(css="jobs-description__content"),
                     Select(css="show-more-less-html__markup")),
            "level": (Select(css=_CARD + "job-insight", contains="Experience level"),),
            "posted_at_raw": (Select("span", within=_DESCRIPTION, nth=3), Select("span", "tvm__text--low-emphasis", nth=3),
                              Select(css="posted-time-ago__text"))},
        labels={"level": "Experience level"}),
    "search_card": Layout(
        source="Google",
        fields={"titles": (Select("h1", "LZAQDf"),), "companies": (Select("div", "vNEEBe"),),
                "location": (Select("div", "Qk80Jf"),), "desc": (Select("span", "HBvzbc"),)},
        missing="N/A", cards=(Select("c-wiz", holding=("data-encoded-docid", "")), Select("li", "iFjolb gws-plugins-horizon-jobs__li-ed"))),
    "guest_list": Layout(
        source="LinkedIn", cards=(Select("div", "base-card"),)),
    "signed_in_list": Layout(
        source="LinkedIn",
        cards=(Select("li", "jobs-search-results-list__item"), Select(css="job-card-container"),
               Select(css="jobs-search-results__list-item")),
        card_id=(Select("a", "job-card-list__title--link", holding=("href", "view/"), take="href"),)),
}


def postings_from_pages(pages: DataFrame, layout: Layout, job_id: Column, html: str = "html") -> DataFrame:
    """Typed posting rows from pages of one layout; a field that is not found is NULL."""
    ship_package(pages.sparkSession)
    names = layout.names

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [layout.read(parse(page)) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("job_id"), *[pa.array([f[n] for f in found], pa.string()) for n in names]], ["job_id", *names])

    rows = pages.select(job_id.cast("string").alias("job_id"), F.col(html).alias("html")).filter("job_id is not null")
    rows = rows.mapInArrow(read, ", ".join(f"`{n}` string" for n in ["job_id", *names])).withColumn("source", F.lit(layout.source))
    rows = rows.select("job_id", "source", *names)
    return rows.withColumn("posted_at", posted_at_typed(F.col("posted_at_raw"))) if "posted_at_raw" in names else rows


Mark = tuple[str, str]


def _select_marks(select: Select) -> set[Mark]:
    """What a selector needs to find on a page: class words, an id, an attribute, else its tag."""
    marks = {("class", word) for word in (select.css or "").split()}
    if select.dom_id is not None:
        marks.add(("id", select.dom_id))
    if select.holding is not None:
        marks.add(("attribute", select.holding[0]))
    if not marks and select.tag is not None and select.within is None:
        marks.add(("tag", select.tag))
    return marks | (_select_marks(select.within) if select.within is not None else set())


def layout_marks(layouts: Mapping[str, Layout]) -> dict[str, dict[Mark, float]]:
    """Per layout its marks and their weights, which add up to 1: a mark of several layouts says less about each."""
    own = {name: set().union(*[_select_marks(s) for selects in [*layout.fields.values(), layout.posted, layout.cards, layout.card_id]
                               for s in selects]) for name, layout in layouts.items()}
    out = {}
    for name, marks in own.items():
        weights = {m: 1 / sum(m in other for other in own.values()) for m in marks}
        whole = sum(weights.values())
        out[name] = {m: w / whole for m, w in weights.items()} if whole else {}
    return out


def layout_of(root: Node, marks: Mapping[str, Mapping[Mark, float]]) -> str | None:
    """The layout most of whose marks stand in the page's tree, the first of equals; None where no layout has any."""
    seen: set[Mark] = set()
    for node in root.descendants():
        seen.add(("tag", node.tag))
        for name, value in node.attributes.items():
            seen.add(("attribute", name))
            if name == "class":
                seen.update(("class", word) for word in value.split())
            elif name == "id":
                seen.add(("id", value))
    shares = {name: sum(w for m, w in own.items() if m in seen) for name, own in marks.items()}
    best = max(shares, key=lambda name: shares[name], default=None)
    return best if best is not None and shares[best] > 0 else None


def postings_from_mixed_pages(pages: DataFrame, layouts: Mapping[str, Layout], job_id: Column, html: str = "html") -> DataFrame:
    """Typed posting rows from pages of several layouts in one table, each read by its own.

    ``layout`` names it; a page of no known layout has NULL there, in ``source`` and in all fields, as have the fields
    that its layout does not know.
    """
    ship_package(pages.sparkSession)
    names = list(dict.fromkeys(n for layout in layouts.values() for n in layout.names))
    marks = layout_marks(layouts)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page in batch.column("html").to_pylist():
                root = parse(page)
                name = layout_of(root, marks)
                found = layouts[name].read(root) if name is not None else {}
                rows.append([name, layouts[name].source if name is not None else None, *[found.get(n) for n in names]])
            columns = zip(*rows, strict=True) if rows else [[] for _ in range(2 + len(names))]
            yield pa.RecordBatch.from_arrays([batch.column("job_id"), *[pa.array(c, pa.string()) for c in columns]],
                                             ["job_id", "layout", "source", *names])

    rows = pages.select(job_id.cast("string").alias("job_id"), F.col(html).alias("html")).filter("job_id is not null")
    rows = rows.mapInArrow(read, ", ".join(f"`{n}` string" for n in ["job_id", "layout", "source", *names]))
    return rows.withColumn("posted_at", posted_at_typed(F.col("posted_at_raw"))) if "posted_at_raw" in names else rows


def cards_from_pages(pages: DataFrame, layout: Layout, key: str, html: str = "html") -> DataFrame:
    """(key, card, urn, data_id, link, fields): one row per card of a page, numbered from 0 in page order.

    ``urn``, ``data_id`` and ``link`` are what ids are read from; pages without cards have no rows.
    """
    ship_package(pages.sparkSession)
    names = layout.names

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[int] = []
            cards: list[list] = []
            for i, page in enumerate(batch.column("html").to_pylist()):
                for number, node in enumerate(layout.card_nodes(parse(page))):
                    holder = Node("", {}, None, [node])
                    found = layout.read(holder)
                    link = first_value(holder, layout.card_id)
                    rows.append(i)
                    cards.append([number, node.attributes.get("data-entity-urn"), node.attributes.get("data-job-id"), link,
                                  *[found[n] for n in names]])
            columns = list(zip(*cards, strict=True)) if cards else [[] for _ in range(4 + len(names))]
            kinds = [pa.int32()] + [pa.string()] * (3 + len(names))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(pa.array(rows, pa.int64())), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
                ["key", "card", "urn", "data_id", "link", *names])

    schema = f"key {dict(pages.dtypes)[key]}, card int, urn string, data_id string, link string"
    schema += "".join(f", `{n}` string" for n in names)
    return pages.select(F.col(key).alias("key"), F.col(html).alias("html")).mapInArrow(read, schema).withColumnRenamed("key", key)
