"""Text expressions: words, similarity of word sets, links, times, encodings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters a bare whitespace split treats as separators (ASCII blanks
# and separators, next line, and the Unicode space, line and paragraph separators).
WHITESPACE = "[\\s\\x1c-\\x1f\\x85\\p{Z}]+"

# Fixed value: seconds, some 285,000 years, that any present time can be moved by.
_LONGEST_SECONDS = 9_000_000_000_000

POSITIVE = "POSITIVE"
NEGATIVE = "NEGATIVE"
NEUTRAL = "NEUTRAL"


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(text: str | Column) -> Column:
    """Lower-cased whitespace-separated words, without empty pieces."""
    return F.filter(F.split(F.lower(as_col(text)), WHITESPACE), lambda w: w != "")


def word_set(text: str | Column) -> Column:
    """Distinct lower-cased words, in order of first appearance."""
    return F.array_distinct(words(text))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets given as arrays of distinct items; 0 if both are empty."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union > 0, common / union).otherwise(F.lit(0.0))


def contains_ci(text: str | Column, phrase: str) -> Column:
    return F.contains(F.lower(as_col(text)), F.lit(phrase.lower()))


def head(text: str | Column, size: int = 512) -> Column:
    """The first ``size`` characters."""
    return F.substring(as_col(text), 1, size)


def resolve_url(base: str, href: str | Column, cut_ends: bool = False) -> Column:
    """Links with a scheme stay, those that begin with two slashes take the scheme of
    ``base``, and relative ones are appended to ``base``.

    ``cut_ends`` drops the first and last character of a relative link, which undoes
    links that begin with a dot and end in a stray character.
    """
    link = as_col(href)
    if cut_ends:
        tail = F.substring(link, F.lit(2), F.greatest(F.length(link) - 2, F.lit(0)))
        joined = F.concat(F.lit(base), tail)
    else:
        joined = F.concat(F.lit(base.rstrip("/") + "/"), F.ltrim(link, F.lit("/.")))
    scheme = base.split(":", 1)[0]
    return (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(F.lit(scheme + ":"), link))
        .otherwise(joined)
    )


def base64_text(data: str | Column) -> Column:
    """Base64 on one line."""
    return F.regexp_replace(F.base64(as_col(data)), "[\\r\\n]", "")


def data_uri(data: str | Column, mime: str = "image/jpeg") -> Column:
    """``data:`` URI, null when there are no bytes."""
    raw = as_col(data)
    return F.when(F.octet_length(raw) > 0, F.concat(F.lit(f"data:{mime};base64,"), base64_text(raw)))


def relative_time(text: str | Column, as_of: Column, compat: bool = False) -> Column:
    """``N minutes/hours/days ago`` as a time before ``as_of``.

    Unknown or malformed text gives ``as_of``, and so does a count past the times that an
    interval can reach.  "Yesterday" is one day ago; with ``compat`` it gives ``as_of``,
    because its "day" is then read as a day count without a number.
    """
    said = as_col(text)
    count = F.get(F.filter(F.split(said, WHITESPACE), lambda w: w != ""), 0).try_cast("int")
    unit_seconds = (
        F.when(said.contains("minute"), 60).when(said.contains("hour"), 3600).when(said.contains("day"), 86400)
    )
    # The product needs 64 bits; an interval holds a little more than the bound.
    seconds = count.cast("long") * unit_seconds
    rest = F.pmod(seconds, F.lit(86400))
    ago = F.make_dt_interval(days=((seconds - rest) / 86400).cast("int"), secs=rest.cast("decimal(18,6)"))
    moved = F.when(F.abs(seconds) <= _LONGEST_SECONDS, as_of - ago).otherwise(as_of)
    if compat:
        return moved
    return F.when(said.contains("Yesterday"), as_of - F.make_dt_interval(days=F.lit(1))).otherwise(moved)


def threshold_label(
    score: str | Column, bound: float = 3.0, yes: str = POSITIVE, no: str = NEGATIVE, from_text: bool = False
) -> Column:
    """``yes`` when score >= bound, else ``no``; null and unreadable scores count as ``no``."""
    value = as_col(score)
    if from_text:
        value = value.try_cast("float")
    return F.when(value >= F.lit(bound), yes).otherwise(no)


def lexicon_score(text: str | Column, positive: Sequence[str], negative: Sequence[str]) -> Column:
    """Positive minus negative word occurrences in the whole text, in one pass over its words."""
    return F.aggregate(
        words(F.coalesce(as_col(text), F.lit(""))),
        F.lit(0),
        lambda total, w: total
        + F.when(w.isin(list(positive)), 1).when(w.isin(list(negative)), -1).otherwise(0),
    )


def lexicon_sentiment(text: str | Column, positive: Sequence[str], negative: Sequence[str]) -> Column:
    """NEUTRAL for text without words, else POSITIVE when the score is not below zero."""
    blank = F.size(words(F.coalesce(as_col(text), F.lit("")))) == 0
    return F.when(blank, NEUTRAL).when(lexicon_score(text, positive, negative) >= 0, POSITIVE).otherwise(NEGATIVE)


def fingerprint(*cols: str | Column) -> Column:
    """Order-independent content fingerprint of a group, as an aggregate.

    md5 each row, sum the four 32-bit lanes, md5 the sums.  Constant state per
    group and map-side combined, so a group of any size costs one number row.
    Put a position among ``cols`` to make it sensitive to order.
    """
    parts = [F.coalesce(as_col(c).cast("string"), F.lit("\u0000")) for c in cols]
    row = F.md5(F.concat_ws("\u0001", *parts))
    lanes = [
        F.sum(F.conv(F.substring(row, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(4)
    ]
    return F.md5(F.concat_ws(":", *lanes))
