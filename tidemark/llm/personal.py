"""Personal data: e-mail and IP addresses, card and phone numbers.

Fixed rules find the base spans.  They give up where values run into each other, so
generators with high recall propose further, overlapping spans: every window of number
groups, every '@', numbers without a prefix, addresses spelled with (at) and (dot).  Boosted
trees score the proposals by their form and surroundings; thresholds calibrated on
held-out examples select which of them are redacted beside the base spans.

There are no labels: the trees learn from a bounded sample of base values, set alone, next to
each other as the rules cannot tell them apart, and spoiled.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
#: Characters kept on either side of a sampled value.
CONTEXT = 32

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
DOTTED_RUN = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}")
NUMBER_RUN = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE_REST = re.compile(r"[ ().0-9-]+")
DIGITS = re.compile(r"[0-9]+")
GAP = re.compile(r"[ ().-]{1,3}")
NATIONAL = re.compile(r"(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])")
SPELLED_AT = re.compile(r" ?[\[({] ?(?:at|AT) ?[\])}] ?")
SPELLED_DOMAIN = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?:\.| ?[\[({] ?(?:dot|DOT) ?[\])}] ?)[A-Za-z0-9-]{1,63})+")

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def octet(part: str) -> bool:
    value = part.lstrip("0")
    return len(value) < 4 and (not value or int(value) <= 255)


def digits_of(value: str) -> str:
    return "".join(DIGITS.findall(value))


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) by the fixed rules: per kind the leftmost matches that do not overlap; failing ones are dropped."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            out.append((EMAIL, start, done))
        at = text.find("@", at + 1)
    for found in DOTTED.finditer(text):
        if all(map(octet, found[0].split("."))):
            out.append((IP, *found.span()))
    for found in NUMBER_RUN.finditer(text):
        digits = digits_of(found[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((CARD, *found.span()))
    at = text.find("+")
    while at >= 0:
        end = at + 1
        if text[at + 1 : at + 2] in ("0", "1", "2", "3", "4", "5", "6", "7", "8", "9"):
            rest = PHONE_REST.match(text, at + 2)
            size = len(rest[0].rstrip(" ().-")) if rest else 0
            if size > 1:
                end = at + 2 + size
                if 10 <= len(digits_of(text[at:end])) <= 15:
                    out.append((PHONE, at, end))
        at = text.find("+", end)
    return sorted(out, key=lambda s: (s[1], s[0], s[2]))


def proposals(text: str) -> set[Span]:
    """Spans that may be personal data, overlapping; their number is linear in the text's length."""
    out: set[Span] = set()
    at = text.find("@")
    while at >= 0:
        start = at
        while start > 0 and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.add((EMAIL, start, found.end()))
        at = text.find("@", at + 1)
    for mark in SPELLED_AT.finditer(text):
        start, found = mark.start(), SPELLED_DOMAIN.match(text, mark.end())
        while start > max(0, mark.start() - 64) and text[start - 1] in LOCAL:
            start -= 1
        if found and start < mark.start():
            out.add((EMAIL, start, found.end()))
    for run in DOTTED_RUN.finditer(text):
        parts = [m.span() for m in DIGITS.finditer(text, *run.span())]
        for a, b in zip(parts, parts[3:]):
            if b[1] - a[0] <= 15:
                out.add((IP, a[0], b[1]))
    for run in NUMBER_RUN.finditer(text):
        out |= windows(text, CARD, [m.span() for m in DIGITS.finditer(text, *run.span())], 14, 19)
    at = text.find("+")
    while at >= 0:
        parts, end = [], at + 1
        while len(parts) < 15 and (group := DIGITS.match(text, end)):
            parts.append(group.span())
            gap = GAP.match(text, group.end())
            end = gap.end() if gap else len(text)
        if parts:
            parts[0] = (at, parts[0][1])
            out |= {s for s in windows(text, PHONE, parts, 8, 15) if s[1] == at}
        at = text.find("+", at + 1)
    out |= {(PHONE, *m.span()) for m in NATIONAL.finditer(text)}
    return out


def windows(text: str, kind: int, parts: list[tuple[int, int]], least: int, most: int) -> set[Span]:
    """Spans from the start of one digit group to the end of one, with ``least`` to ``most`` digits."""
    out = set()
    for i, (start, _) in enumerate(parts):
        digits = 0
        for a, b in parts[i:]:
            digits += b - a
            if digits > most + 1:
                break
            if least <= digits - text.startswith("+", start) <= most:
                out.add((kind, start, b))
    return out


#: Words before a value that speak for a kind; a parameter of the features, not of the rules.
HINTS = (("mail", "contact"), ("ip", "host", "addr", "server"), ("card", "visa", "pay", "iban"), ("tel", "phone", "call", "fax", "mobil"))


def char_class(text: str, at: int) -> int:
    """0 outside or space, 1 letter, 2 digit, then signs by their use in numbers and addresses."""
    if not 0 <= at < len(text) or text[at].isspace():
        return 0
    c = text[at]
    return 2 if c.isdigit() else 1 if c.isalpha() else 3 + ".-+@(),;:\"'".find(c)


def described(text: str, spans: Iterable[Span]) -> list[list[float]]:
    """Form and context features of each span."""
    out = []
    for kind, start, end in spans:
        value = text[start:end]
        groups = [len(g) for g in DIGITS.findall(value)] or [0]
        digits = digits_of(value)
        before, after = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
        hint = before.lower()
        tail = before[len(before.rstrip(" ().-0123456789")) :]
        head = after[: len(after) - len(after.lstrip(" ().-0123456789"))]
        last = re.split(r"[.\s\])}]", value)[-1]
        out.append(
            [
                *(float(kind == k) for k in range(4)),
                float(len(value)), float(len(digits)), float(len(groups)), float(min(groups)), float(max(groups)), float(groups[0]), float(groups[-1]),
                float(len(set(groups)) == 1), float(len(set(re.findall(r"[ ().-]", value)))), float("(" in value), float(value.startswith("+")),
                float(bool(digits) and luhn(digits)), float(ord(digits[0]) - 48 if digits else -1),
                float(kind == IP and all(map(octet, value.split(".")))), float(sum(g[0] == "0" and len(g) > 1 for g in DIGITS.findall(value))),
                float(len(last)), float(last.isalpha()), float("@" in value), float(value.count(".")),
                float(char_class(text, start - 1)), float(char_class(text, end)), float(char_class(text, end + 1)),
                float(len(digits_of(tail))), float(len(digits_of(head))), float(len(DIGITS.findall(head))),
                *(float(any(w in hint for w in words)) for words in HINTS),
            ]
        )
    return out


def clashes(span: Span, others: Iterable[Span]) -> bool:
    return any(span[1] < b and a < span[2] for _, a, b in others)


def resolved(base: list[Span], scored: list[tuple[float, Span]]) -> list[Span]:
    """The base spans and, from the likeliest on, the selected ones that overlap none chosen before.

    The selected spans overlap no base span, so only the last chosen one before each end matters.
    """
    chosen: list[Span] = []
    for _, span in sorted(scored, key=lambda x: (-x[0], x[1][1], -x[1][2], x[1][0])):
        at = bisect_left(chosen, span[2], key=lambda s: s[1])
        if not clashes(span, chosen[max(0, at - 1) : at]):
            insort(chosen, span, key=lambda s: s[1])
    return sorted(base + chosen, key=lambda s: (s[1], s[0], s[2]))


def sampled_values(docs: DataFrame, key: str, text: str, per_kind: int) -> list[tuple[int, int, str, str, str]]:
    """(kind, bucket, text before, value, text after) of at most ``per_kind`` base spans a kind.

    Buckets are by a hash of key and value, so the choice is repeatable; this bounds what
    reaches the driver.
    """
    rows = docs.select(F.col(key).cast("string").alias("key"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, kinds, parts = [], [], ([], [], [])
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for kind, a, b in base_spans(value or ""):
                    if b - a <= 4 * CONTEXT:
                        keys.append(key), kinds.append(kind)
                        for part, cut in zip(parts, (value[max(0, a - CONTEXT) : a], value[a:b], value[b : b + CONTEXT])):
                            part.append(cut)
            columns = [pa.array(keys, pa.string()), pa.array(kinds, pa.int32()), *(pa.array(p, pa.string()) for p in parts)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "kind", "before", "value", "after"])

    found = rows.mapInArrow(run, "key string, kind int, before string, value string, after string")
    pick = F.struct(F.xxhash64("value", "key").alias("pick"), "before", "value", "after")
    bucket = F.pmod(F.xxhash64("value", F.lit(1)), F.lit(per_kind)).cast("int")
    chosen = found.groupBy("kind", bucket.alias("bucket")).agg(F.min(pick).alias("p")).select("kind", "bucket", "p.before", "p.value", "p.after")
    return sorted(tuple(r) for r in chosen.collect())


def spoiled(kind: int, value: str) -> list[str]:
    """Strings that look like the value and are none: a failing check digit, a part too large, too few digits, no domain."""
    if kind == EMAIL:
        return [value.split("@")[0] + "@" + value.split("@")[1].split(".")[0]]
    if kind == IP:
        parts = value.split(".")
        return [".".join([*parts[:2], "7" + parts[2].zfill(2)[-2:].replace("0", "9"), parts[3]]), ".".join(parts[:3])]
    if kind == CARD:
        return [value[:-1] + str((int(value[-1]) + step) % 10) for step in (1, 4)] + [value[:-6]]
    return [value[:-5], value.replace("+", "").replace("(", "").replace(")", "")[:-3]]


def variants(kind: int, value: str) -> list[str]:
    """Other spellings of the value that the rules do not know."""
    if kind == EMAIL:
        name, host = value.split("@", 1)
        return [f"{name} (at) {host}", f"{name} [at] " + host.replace(".", " [dot] "), f"{name} (at) " + host.replace(".", " (dot) ")]
    if kind == PHONE and (own := NATIONAL.search(value.replace("+", " "))):
        return [own[0]]
    if kind == CARD and len(value) == 16 and value.isdigit():
        return [" ".join(value[i : i + 4] for i in range(0, 16, 4)), "-".join(value[i : i + 4] for i in range(0, 16, 4))]
    return []


def examples(sample: list[tuple[int, int, str, str, str]]) -> Iterator[tuple[bool, int, int, list[float]]]:
    """(held out, kind, label, features) of all proposals in texts made from sampled values.

    The true spans of such a text are known, whatever the rules find in it.  Whole values are held
    out, with all texts that they lead.
    """
    for i, (kind, bucket, before, value, after) in enumerate(sample):
        texts: list[tuple[str, list[Span]]] = []

        def add(parts: list[tuple[int | None, str]], left: str = before, right: str = after) -> None:
            made, true = left, []
            for k, part in parts:
                if k is not None:
                    true.append((k, len(made), len(made) + len(part)))
                made += part
            texts.append((made + right, true))

        add([(kind, value)])
        for other in variants(kind, value):
            add([(kind, other)])
        for other in spoiled(kind, value):
            add([(None, other)])
        for n, (step, gap) in enumerate(((1, " "), (7, " "), (17, " "), (61, " "), (101, " "), (1009, " "), (211, "-"), (431, ", "))):
            k, _, _, partner, right = sample[(i + step) % len(sample)]
            if gap == "-" and EMAIL in (kind, k):
                continue
            partner = [partner, *variants(k, partner)][n % 2 if k == CARD and variants(k, partner) else 0]
            add([(kind, value), (None, gap), (k, partner)], right=right)
        number = digits_of(value) or str(bucket)
        add([(None, f" {number[:4]}-{number[4:6]}-{number[6:8]} {number[:2]}.{number[2:4]}.{number[4:6]} ")])
        add([(None, f" {number[:3]}.{number[3:5]}.{number[5:6]}.{number[6:9]}.{number[9:11]} ")])
        for made, true in texts:
            found = sorted(proposals(made))
            # Values at the border of the cut-out text may be cut or unknown: those candidates tell nothing.
            inside = [s for s in found if s[1] >= len(before) - 2 and clashes(s, [(0, len(before), len(made) - len(after) or 1)])]
            for span, row in zip(inside, described(made, inside)):
                yield bucket % 3 == 0, span[0], int(span in true), row


@dataclass(frozen=True)
class Detector:
    """Boosted trees and, by kind, the score from which a proposal is selected (above 1: never)."""

    trees: GBTClassificationModel | None
    thresholds: tuple[float, float, float, float]


def fit(docs: DataFrame, key: str, text: str, per_kind: int = 400, precision: float = 0.98, rounds: int = 20, depth: int = 4) -> Detector:
    """A detector from at most ``per_kind`` base values a kind.

    A third of the values is held out; a kind's threshold is the least score at which
    the held-out proposals from there on are true in at least ``precision`` of the cases.
    Without values nothing is learned and nothing will be added to the rules.
    """
    spark = docs.sparkSession
    rows = list(examples(sampled_values(docs, key, text, per_kind)))
    if len({label for held, _, label, _ in rows if not held}) < 2:
        return Detector(None, (2.0, 2.0, 2.0, 2.0))
    # The sample is bounded and in a fixed order: one partition makes the trees repeatable.
    table = spark.createDataFrame(rows, "held boolean, kind int, label int, features array<double>").coalesce(1)
    table = table.select("held", "kind", F.col("label").cast("double").alias("label"), array_to_vector("features").alias("features"))
    learner = GBTClassifier(maxIter=rounds, maxDepth=depth, maxBins=64, seed=7)
    trees = learner.fit(table.where("not held"))
    held = score(trees, table.where("held")).select("kind", "label", "p").toPandas()
    thresholds = []
    for kind in range(len(KINDS)):
        own = held[held["kind"] == kind].groupby("p")["label"].agg(["sum", "count"]).sort_index(ascending=False).cumsum()
        good = own.index[own["sum"] >= precision * own["count"]]
        thresholds.append(float(good.min()) if len(good) else 2.0)
    return Detector(trees, tuple(thresholds))


def score(trees: GBTClassificationModel, rows: DataFrame) -> DataFrame:
    return trees.transform(rows).withColumn("p", F.round(vector_to_array("probability")[1], 9))


SPAN = "struct<kind:int,start:int,end:int>"


def detect(docs: DataFrame, key: str, text: str, detector: Detector) -> DataFrame:
    """(row, key, base, spans) of every row: base spans and all spans, in code points.

    Both are arrays of (kind number, start, end), by start and then kind.  A null text is empty.
    Keys may be null or repeat and are only handed on.  Added spans overlap no base span and
    not each other.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    made = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
    shape = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("features", pa.list_(pa.float64()))]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bases, more = [], []
            for value in batch.column(1).to_pylist():
                base = base_spans(value or "")
                free = sorted(proposals(value or ""))
                free = unclashing(free, base)
                bases.append([dict(zip(("kind", "start", "end"), s)) for s in base])
                more.append([{"kind": k, "start": a, "end": b, "features": f} for (k, a, b), f in zip(free, described(value or "", free))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bases, made), pa.array(more, shape)], ["key", "base", "more"])

    kind = rows.schema["key"].dataType.simpleString()
    found = rows.mapInArrow(run, f"key {kind}, base array<{SPAN}>, more array<struct<kind:int,start:int,end:int,features:array<double>>>")
    found = cut_lineage(found.withColumn("row", F.monotonically_increasing_id()))
    plain = found.where("size(more) = 0").select("row", "key", "base", F.col("base").alias("spans"))
    asked = found.where("size(more) > 0")
    if detector.trees is None:
        return plain.unionByName(asked.select("row", "key", "base", F.col("base").alias("spans")))
    each = asked.select("row", F.explode("more").alias("m")).select("row", "m.kind", "m.start", "m.end", array_to_vector("m.features").alias("features"))
    least = F.element_at(F.array(*map(F.lit, detector.thresholds)), F.col("kind") + 1)
    chosen = score(detector.trees, each).where(F.col("p") >= least)
    by_row = chosen.groupBy("row").agg(F.collect_list(F.struct("p", "kind", "start", "end")).alias("chosen"))
    joined = asked.select("row", "key", "base").join(by_row, "row", "left")

    def settle(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for base, own in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                scored = [(c["p"], (c["kind"], c["start"], c["end"])) for c in own or ()]
                all_spans = resolved([(s["kind"], s["start"], s["end"]) for s in base], scored)
                spans.append([dict(zip(("kind", "start", "end"), s)) for s in all_spans])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(spans, made)], ["row", "key", "base", "spans"])

    settled = joined.mapInArrow(settle, f"row bigint, key {kind}, base array<{SPAN}>, spans array<{SPAN}>")
    return plain.unionByName(settled)


def unclashing(free: list[Span], base: list[Span]) -> list[Span]:
    """The spans that overlap no base span."""
    if not free or not base:
        return free
    edges = sorted((a, b) for _, a, b in base)
    starts = np.array([a for a, _ in edges])
    ends = np.maximum.accumulate([b for _, b in edges])
    out = []
    for s in free:
        at = int(np.searchsorted(starts, s[2]))
        if not at or ends[at - 1] <= s[1]:
            out.append(s)
    return out


def span_text(spans: str | Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    spans = F.col(spans) if isinstance(spans, str) else spans
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets; overlapping spans leave the first one's mark."""
    names = F.array(*(F.lit(f"<{k}>") for k in KINDS))
    start = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))

    def step(state: Column, s: Column) -> Column:
        fresh = s["start"] >= state["at"]
        gap = F.substring(text, state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        mark = F.when(fresh, F.element_at(names, s["kind"] + 1)).otherwise("")
        return F.struct(F.concat(state["done"], gap, mark).alias("done"), F.greatest(state["at"], s["end"]).alias("at"))

    end = F.aggregate(spans, start, step)
    return F.concat(end["done"], F.substring(text, end["at"] + 1, F.length(text)))
