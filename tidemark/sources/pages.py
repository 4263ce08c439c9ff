"""Links and article blocks from a table of captured pages.

HTML needs a real parser, so both scans are one ``mapInPandas`` pass over
(page key, html); everything after the raw extraction is column expressions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import contains_ci, relative_time, resolve_url


class _Anchors(HTMLParser):
    """Collects [href, text] of every anchor in page order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found, self._open = [], []

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            entry = [dict(attrs).get("href"), []]
            self.found.append(entry)
            self._open.append(entry)

    def handle_endtag(self, tag):
        if tag == "a" and self._open:
            self._open.pop()

    def handle_data(self, data):
        for entry in self._open:
            entry[1].append(data)


class _Articles(HTMLParser):
    """Collects the parts of every <article> block."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found, self._blocks, self._anchors = [], [], []
        self._times, self._headings = [], []

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag == "article":
            block = {"links": [], "image": None, "figure": "before", "image_seen": False, "time": None, "heading": None}
            self.found.append(block)
            self._blocks.append(block)
        for block in self._blocks:
            if tag == "a":
                entry = [attrs.get("href"), []]
                block["links"].append(entry)
                self._anchors.append(entry)
            elif tag == "time" and block["time"] is None:
                block["time"] = []
                self._times.append(block["time"])
            elif tag == "h1" and block["heading"] is None:
                block["heading"] = []
                self._headings.append(block["heading"])
            elif tag == "figure" and block["figure"] == "before":
                block["figure"] = "inside"
            elif tag == "img" and block["figure"] == "inside" and not block["image_seen"]:
                block["image_seen"] = True
                block["image"] = attrs.get("src") or attrs.get("data-src")

    def handle_endtag(self, tag):
        if tag == "article" and self._blocks:
            self._blocks.pop()
        elif tag == "a":
            self._anchors.clear()
        elif tag == "time":
            self._times.clear()
        elif tag == "h1":
            self._headings.clear()
        elif tag == "figure":
            for block in self._blocks:
                if block["figure"] == "inside":
                    block["figure"] = "after"

    def handle_data(self, data):
        for entry in self._anchors:
            entry[1].append(data)
        for sink in (*self._times, *self._headings):
            sink.append(data)


def _joined(parts):
    return None if parts is None else "".join(parts).strip()


def page_links(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """One row per anchor: key, 1-based position, href, stripped text."""
    kind = pages.schema[key].dataType.simpleString()

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page, source in zip(batch[key], batch[html]):
                parser = _Anchors()
                parser.feed(source or "")
                parser.close()
                rows += [(page, i, href, _joined(text)) for i, (href, text) in enumerate(parser.found, 1)]
            yield pd.DataFrame(rows, columns=[key, "pos", "href", "text"])

    return pages.select(key, html).mapInPandas(extract, f"{key} {kind}, pos int, href string, text string")


def links_by_text(links: DataFrame, phrase: str, text: str = "text") -> DataFrame:
    return links.filter(contains_ci(text, phrase))


def first_and_last_link(links: DataFrame, key: str = "page_id") -> DataFrame:
    """First and last href per page, by position."""
    return links.groupBy(key).agg(
        F.min_by("href", "pos").alias("first_href"), F.max_by("href", "pos").alias("last_href")
    )


def article_blocks(
    pages: DataFrame, key: str = "page_id", html: str = "html", keep: Sequence[str] = ()
) -> DataFrame:
    """Raw article blocks: position, links, image source, time text, heading.

    Columns named in ``keep`` are carried along from the page.
    """
    carried = [key, *keep]
    kinds = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in carried)

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for *page, source in zip(*[batch[c] for c in carried], batch[html]):
                parser = _Articles()
                parser.feed(source or "")
                parser.close()
                for i, block in enumerate(parser.found, 1):
                    links = [{"href": href, "text": _joined(text)} for href, text in block["links"]]
                    rows.append((*page, i, links, block["image"], _joined(block["time"]), _joined(block["heading"])))
            yield pd.DataFrame(rows, columns=[*carried, "pos", "links", "image", "time_text", "heading"])

    schema = (
        f"{kinds}, pos int, links array<struct<href:string,text:string>>, "
        "image string, time_text string, heading string"
    )
    return pages.select(*carried, html).mapInPandas(extract, schema)


def articles(
    pages: DataFrame,
    base_url: str,
    as_of: Column,
    key: str = "page_id",
    html: str = "html",
    require_thumbnail: bool = True,
    cut_ends: bool = False,
    compat: bool = False,
) -> DataFrame:
    """Stories: headline and url from the block's links, thumbnail, publication time.

    The deciding link is the first absolute (or empty) one, else the last; blocks
    without a headline, or without a thumbnail when one is required, are dropped.
    """
    links = F.col("links")
    stop = F.filter(links, lambda a: F.coalesce(a["href"].startswith("http") | (a["href"] == ""), F.lit(True)))
    chosen = F.coalesce(F.get(stop, 0), F.try_element_at(links, F.lit(-1)))
    shaped = article_blocks(pages, key, html).select(
        key,
        "pos",
        chosen["text"].alias("headline"),
        resolve_url(base_url, chosen["href"], cut_ends).alias("article_url"),
        F.when(F.length("image") > 0, resolve_url(base_url, "image")).alias("thumbnail_url"),
        F.coalesce(relative_time("time_text", as_of, compat), as_of).alias("published_at"),
        "heading",
    )
    kept = shaped.filter(F.length("headline") > 0)
    return kept.filter(F.col("thumbnail_url").isNotNull()) if require_thumbnail else kept
