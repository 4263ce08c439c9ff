"""Main text of web pages by the distribution of text over lines.

Markup is stripped so that every block of text is a line and the edges of containers leave
empty lines.  Text lengths are summed over sliding windows of lines.  Where a sum surges
the main text begins, where it dives to nothing it ends; the text between is kept.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML, by what they mean for text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("article aside body details div dl fieldset footer form header main nav section table".split())
DROPPED = frozenset(
    "applet aside audio button canvas datalist dialog footer form frameset head iframe input map menu nav noframes noscript "
    "object optgroup option select svg template video".split()
)
MAIN = frozenset(["article", "main"])
#: Words of class, id and role that name something other than the article.
SIDE = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent "
    "contentinfo cookie cookies disqus gdpr login menu modal navigation nav navbar newsletter notice notices pager pagination "
    "popup promo promoted promotion recommended related reply respond search share sharing sidebar signup social sponsor "
    "sponsored subscribe toolbar widget".split()
)
#: Of these only what stands outside an article.
SIDE_OUTSIDE = frozenset("header footer masthead topbar".split())
#: Words that builders put before their own names of any element: they count alone only.
ALONE = frozenset(["widget"])
#: Last words that name a box: "share-buttons" is one for sharing, "share-price" is none.
BOXES = frozenset(
    "ad ads aside area bar block body box button buttons card cards col column container content control controls embed feed "
    "field fields foot footer form frame grid group head header heading holder icon icons inline inner input item items label "
    "layer left link links list main message module modules more outer overlay panel pane policy-link post posts region right "
    "row section set slot space stories story strip tab tabs text thread tile title toggle tool tools top trail unit view wrap "
    "wrapper zone".split()
)
#: First words of names that say what a page has, not what an element is.
STATES = frozenset("has have is no with without".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(script|style|textarea|title|xmp|noembed)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|</?[a-zA-Z][^>]*(?:>|\Z)",
    re.S | re.I,
)
NAMED = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
PART = re.compile(r"[a-z]+", re.I)

#: Lines of a window.
WINDOW = 3
#: Weights in eighths: of text inside article or main elements, which surges however short, and of text outside on such pages.
MAIN_WEIGHT, OUTSIDE_WEIGHT = 640, 1


class Line:
    __slots__ = ("text", "links", "main")

    def __init__(self, text: str, links: int, main: bool):
        self.text, self.links, self.main = text, links, main


def page_lines(page: str) -> list[Line]:
    """Blocks of text as lines, empty lines where a container begins or ends or something was dropped.

    An element named like a side part, and a form, stays if it holds every article or main
    element of the page, or most of the text that is not linked.
    """
    lines, named, chars, mains = _parse(page, None)
    if not named:
        return lines
    spared = frozenset(at for at, own, inside in named if 2 * own > chars or inside and inside == mains)
    return _parse(page, spared)[0]


def _parse(page: str, spared: frozenset[int] | None) -> tuple[list[Line], list[tuple[int, int, int]], int, int]:
    """(lines, elements that a name would drop, unlinked characters, article and main elements).

    Named elements are (place, unlinked characters, article and main elements inside); they
    are dropped but for ``spared`` places, none at all without it.
    """
    lines: list[Line] = []
    parts: list[str] = []
    named: list[tuple[int, int, int]] = []
    stack: list[tuple[str, bool, bool, tuple[int, int, int] | None]] = []  # name, dropped, main, place and counts before
    dropped, main, links, link_chars, at, chars, mains = 0, 0, 0, 0, 0, 0, 0

    def close(gap: int) -> None:
        nonlocal link_chars
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            lines.append(Line(text, link_chars, main > 0))
        link_chars = 0
        lines.extend(Line("", 0, False) for _ in range(gap))

    def say(raw: str) -> None:
        nonlocal link_chars, chars
        if dropped or not raw:
            return
        plain = html.unescape(raw)
        parts.append(plain)
        if links:
            link_chars += len("".join(plain.split()))
        else:
            chars += len("".join(plain.split()))

    def leave(index: int) -> None:
        nonlocal dropped, main, links
        for name, was_dropped, was_main, before in reversed(stack[index:]):
            if before:
                named.append((before[0], chars - before[1], mains - before[2]))
            if not dropped and name in BLOCKS:
                close(WINDOW if was_main else 1 if name in CONTAINERS else 0)
            dropped -= was_dropped
            main -= was_main
            links -= name == "a"
            if was_dropped and not dropped:
                close(WINDOW)
        del stack[index:]

    for token in TOKEN.finditer(page):
        say(page[at : token.start()])
        at = token.end()
        raw_name, ending, name, rest = token.groups()
        if not name:
            if not raw_name and token[0].startswith("<![CDATA["):
                say(html.escape(token[0][9:].removesuffix("]]>")))
            continue
        name = name.lower()
        if ending:
            index = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if index is not None:
                leave(index)
            elif name in BLOCKS and not dropped:
                close(0)
            continue
        if name in VOID:
            if name in ("br", "wbr", "img", "hr") and not dropped:
                parts.append(" ") if name == "br" else close(0) if name == "hr" else None
            continue
        if name in BLOCKS:
            # A block ends an open paragraph; items and cells end their like.
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p" or stack[i][0] == name and name in ("li", "dt", "dd", "tr", "td", "th", "option"):
                    leave(i)
                    break
                if stack[i][0] in BLOCKS:
                    break
        if rest.endswith("/") and name not in BLOCKS:
            continue
        out = name in DROPPED and name != "form" or name == "header" and not main
        side = None if out or name in MAIN or name in ("html", "body") else aside(rest, main > 0)
        out = out or side is True
        by_name = not dropped and not out and (name == "form" or side == NAME)
        out = out or by_name and spared is not None and token.start() not in spared
        if not dropped and (name in BLOCKS or out):
            close(WINDOW if out or name in MAIN else 1 if name in CONTAINERS else 0)
        stack.append((name, out, name in MAIN, (token.start(), chars, mains) if by_name else None))
        mains += name in MAIN and not dropped
        dropped += out
        main += name in MAIN
        links += name == "a"
    say(page[at:])
    leave(0)
    close(0)
    return lines, named, chars, mains


#: What :func:`aside` gives where class, id or role alone say so.
NAME = "name"


def aside(attributes: str, inside: bool) -> bool | str:
    """True of hidden elements, ``NAME`` if class, id or role name something that isn't part of the article.

    A name counts by its last word, and by its first if the last one names a box.
    """
    if not attributes or attributes.isspace():
        return False
    found = False
    for key, a, b, c in NAMED.findall(attributes):
        key, value = key.lower(), (a or b or c).lower()
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        if key in ("class", "id", "role"):
            for token in value.split():
                words = PART.findall(token)
                if not words or words[0] in STATES:
                    continue
                ends = {words[-1], words[0] if words[-1] in BOXES else words[-1]} - (ALONE if len(words) > 1 else frozenset())
                if ends & SIDE or not inside and ends & SIDE_OUTSIDE:
                    found = NAME
    return found


def main_blocks(lines: list[Line], surge: int = 80) -> list[str]:
    """Texts of the lines between surge and dive points.

    A line weighs its unlinked characters, twice the links off.  If article or main elements hold
    most of the page's weight, or little lies outside, text inside them weighs more and text outside less.  A window
    surges when its sum reaches ``surge``, or half of the largest sum on pages with less; the
    text around it is kept up to the windows that sum to nothing, but for lines of links
    alone, which are menus.
    """
    own = np.array([max(0, len(x.text) - 2 * x.links) if x.text else 0 for x in lines], np.int64)
    main = np.array([x.main for x in lines], bool)
    inside, outside = int(own[main].sum()), int(own[~main].sum())
    marked = 0 < inside and outside <= max(inside, 4 * surge)
    weight = own * np.where(main, MAIN_WEIGHT, OUTSIDE_WEIGHT) if marked else own * 8
    if not len(weight) or not weight.any():
        return []
    total = np.convolve(weight, np.ones(WINDOW, np.int64))[WINDOW - 1 :] if len(weight) >= WINDOW else np.cumsum(weight[::-1])[::-1]
    least = min(8 * surge, max(1, int(total.max()) // 2))
    # A window that sums to nothing lies between two texts.
    flat = np.concatenate(([True], total == 0, [True]))
    starts, ends = np.flatnonzero(flat[:-1] & ~flat[1:]), np.flatnonzero(~flat[:-1] & flat[1:])
    out: list[str] = []
    for a, b in zip(starts.tolist(), ends.tolist()):
        if total[a:b].max() >= least:
            out += [x.text for x in lines[a : b + WINDOW - 1] if x.text and x.links < len(x.text.replace(" ", ""))]
    return out


def main_text(page: str) -> str:
    return "\n\n".join(main_blocks(page_lines(page)))


def extract_text(pages: DataFrame, key: str, url: str, page: str) -> DataFrame:
    """(key, url, text, n_chars) of every page, from its whole markup.

    White space inside a block is one space, blocks stand in page order with an empty line
    between.  A null or empty page, and one without main text, has an empty text.  Rows
    repeat as they do in the input; other columns are not read.
    """
    chosen = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(page).alias("page"))
    kind = chosen.schema["key"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p.as_py() or "") for p in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["key", "url", "text", "n_chars"],
            )

    return chosen.mapInArrow(run, f"key {kind}, url string, text string, n_chars bigint")
