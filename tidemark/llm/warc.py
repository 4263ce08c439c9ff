"""WARC archives: writing, reading, and resolution of revisits.

Records meet by payload digest.  Of records with equal payloads one keeps the payload as a
response, the others become revisits that refer to it; the archives are written anew with
fresh headers.  Payloads of revisits are dropped before anything is written.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import hash_filter, passing
from tidemark.session import cut_lineage

#: What ends each record, and what Spark's text writer puts after each row.
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "record_id string, url string, record_type string, payload binary, payload_bytes bigint, payload_digest string, refers_to string"


def payload_records(rows: DataFrame, record_id: str, url: str, payload: str, order: str) -> DataFrame:
    """Response records of fetched pages: the columns of ``RECORDS`` and ``rank``.

    The payload is UTF-8, null being empty; the digest is SHA-1 in lower-case hex.
    ``order`` ranks records with equal payloads, see :func:`resolve_revisits`.  Only the
    named columns are read.
    """
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    return rows.select(
        F.col(record_id).cast("string").alias("record_id"),
        F.col(url).cast("string").alias("url"),
        F.lit("response").alias("record_type"),
        body.alias("payload"),
        F.octet_length(body).cast("long").alias("payload_bytes"),
        F.sha1(body).alias("payload_digest"),
        F.lit(None).cast("string").alias("refers_to"),
        F.col(order).alias("rank"),
    )


def resolve_revisits(records: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """Decides anew which records keep their payload.

    Among the records with a payload of one digest and length, of ``min_bytes`` or more,
    that of the largest ``rank`` stays a response (of equal ranks the largest record id;
    rows that share even that all stay); the others, and revisits of that digest from earlier archives,
    refer to it and lose their payload.  A revisit whose original isn't here stays as it
    is.  Smaller payloads are all kept.  Null ranks are smaller than all others.

    Headers alone are aggregated and joined by digest, where Spark may split a digest that
    very many records share.  Of the payloads only those of the originals of repeated digests
    are shuffled (and the few that pass a filter by chance); the others stay where they are read.
    ``records`` is read three times and must give the same rows each time.
    """
    payload = F.col("payload").isNotNull()
    headers = records.withColumn("had", payload).drop("payload")
    repeated = (
        headers.where(F.col("payload_bytes") >= min_bytes)
        .groupBy("payload_digest", "payload_bytes")
        .agg(F.count(F.lit(1)).alias("n"), F.max_by("record_id", F.when(F.col("had"), F.struct("rank", "record_id"))).alias("original"))
        .where("n > 1 AND original IS NOT NULL")
        .drop("n")
    )
    repeated = cut_lineage(repeated)
    digest = F.xxhash64("payload_digest", "payload_bytes")
    large = F.coalesce(F.col("payload_bytes") >= min_bytes, F.lit(False))
    may_repeat = large & in_filter(repeated, digest)(digest)
    # One value names a record and its payload, a missing id being a value too.
    name = F.concat_ws(":", F.coalesce("payload_digest", F.lit("")), "payload_bytes", F.concat(F.lit("="), "record_id"))
    judged = cut_lineage(headers.where(may_repeat).join(repeated, ["payload_digest", "payload_bytes"], "left").withColumn("name", name))
    revisit = F.col("original").isNotNull() & ~F.col("record_id").eqNullSafe(F.col("original"))
    keepers = judged.where(~revisit & F.col("had")).select("name").distinct()
    no_payload, no_record = F.lit(None).cast("binary"), F.lit(None).cast("string")
    names = [f.split()[0] for f in RECORDS.split(", ")]

    gone = judged.where(revisit | ~F.col("had"))
    refers = F.when(revisit, F.col("original")).otherwise(F.col("refers_to"))
    gone = gone.withColumns({"record_type": F.lit("revisit"), "payload": no_payload, "refers_to": refers})
    found = records.withColumns({"may": may_repeat, "name": name})
    kept = found.where(F.col("may") & payload & in_filter(keepers, F.xxhash64("name"))(F.xxhash64("name")))
    kept = kept.join(keepers, "name", "left_semi").withColumns({"record_type": F.lit("response"), "refers_to": no_record})
    alone = found.where(~F.col("may")).withColumns(
        {"record_type": F.when(payload, "response").otherwise("revisit"), "refers_to": F.when(~payload, F.col("refers_to"))}
    )
    return alone.select(*names).unionByName(kept.select(*names)).unionByName(gone.select(*names))


def in_filter(rows: DataFrame, h: Column) -> Callable[[Column], Column]:
    """A test whether a hash may be among those of the rows: never false for one that is."""
    bits = rows.sparkSession.sparkContext.broadcast(hash_filter(rows.select(h.alias("h")), "h"))

    @F.pandas_udf("boolean")
    def may_have(values: pd.Series) -> pd.Series:
        out = np.zeros(len(values), bool)
        out[passing(bits.value, values.to_numpy(np.int64).view(np.uint64))] = True
        return pd.Series(out)

    return may_have


def write_archives(records: DataFrame, folder: str, date: str, per_file: int = 20_000) -> None:
    """Writes the records as compressed WARC/1.1 files below ``folder``, a new folder.

    Each task writes a ``warcinfo`` record first.  ``date`` is that of the fresh headers.
    ``per_file`` bounds the records of a file, which a reading task loads as a whole.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        info = b"software: tidemark\r\nformat: WARC File Format 1.1\r\n"
        fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date)]
        head = _header([*fields, ("Content-Type", "application/warc-fields")], len(info))
        yield pa.RecordBatch.from_arrays([pa.array([head + info], pa.binary())], ["record"])
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            yield pa.RecordBatch.from_arrays([pa.array([record_bytes(*row, date) for row in zip(*columns)], pa.binary())], ["record"])

    names = [f.split()[0] for f in RECORDS.split(", ")]
    raw = records.select(*names).mapInArrow(run, "record binary")
    writer = raw.select(F.col("record").cast("string").alias("value")).write
    writer.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(folder)


def record_bytes(record_id, url, record_type, payload, payload_bytes, payload_digest, refers_to, date) -> bytes:
    """One record, without the two line ends that close it."""
    digest = "sha1:" + base64.b32encode(bytes.fromhex(payload_digest)).decode()
    fields = [("WARC-Type", record_type), ("WARC-Date", date), ("WARC-Payload-Digest", digest)]
    # A null id or address has no header line.
    if record_id is not None:
        fields.append(("WARC-Record-ID", f"<{_uri(record_id)}>"))
    if url is not None:
        fields.append(("WARC-Target-URI", _uri(url)))
    if record_type == "revisit":
        fields.append(("WARC-Profile", PROFILE))
        if refers_to is not None:
            fields.append(("WARC-Refers-To", f"<{_uri(refers_to)}>"))
    fields.append(("Content-Type", "application/http; msgtype=response"))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    body = http + (payload or b"") if record_type == "response" else http
    return _header(fields, len(body)) + body


def _header(fields: list[tuple[str, str]], length: int) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields), f"Content-Length: {length}", "", ""]
    return "\r\n".join(lines).encode()


def _uri(value: str) -> str:
    """The value on one line: control characters, spaces and angle brackets are percent-coded."""
    return re.sub(r"[\x00-\x20<>\x7f%]", lambda m: m[0] if m[0] == "%" else quote(m[0], safe=""), value)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The response and revisit records of archives, with the columns of ``RECORDS``.

    Files may be plain or compressed, as a whole or by record.  ``payload_digest`` and
    ``payload_bytes`` of a response are taken from its payload, and a header that says
    otherwise raises; a revisit has those of its headers.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for row in parse_records(inflate(content.as_buffer())):
                    rows.append(row)
                    size += len(row[3] or b"")
                    if size > 8 << 20:
                        yield _batch(rows)
                        rows, size = [], 0
                yield _batch(rows)

    return spark.read.format("binaryFile").load(folder).select("content").mapInArrow(run, RECORDS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string()]
    columns = list(zip(*rows)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds)], [f.split()[0] for f in RECORDS.split(", ")]
    )


def inflate(raw) -> bytes:
    """Plain bytes of a plain or gzip file of one or more members."""
    view = memoryview(raw)
    if bytes(view[:2]) != b"\x1f\x8b":
        return bytes(view)
    parts, rest = [], bytes(view)
    while rest:
        member = zlib.decompressobj(31)
        parts.append(member.decompress(rest))
        rest = member.unused_data
    return b"".join(parts)


def parse_records(data: bytes) -> Iterator[tuple]:
    at = 0
    while at < len(data):
        if data[at : at + 2] == b"\r\n":
            at += 2
            continue
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        head = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        body = end + 4
        at = body + int(head["content-length"])
        kind = head.get("warc-type")
        if kind not in ("response", "revisit"):
            continue
        split = data.index(b"\r\n\r\n", body, at)
        http = data[body:split].decode("latin-1")
        said = head.get("warc-payload-digest", "").removeprefix("sha1:")
        said = base64.b32decode(said).hex() if said else None
        record_id, refers = head.get("warc-record-id"), head.get("warc-refers-to")
        payload = data[split + 4 : at] if kind == "response" else None
        if payload is not None:
            size, digest = len(payload), hashlib.sha1(payload).hexdigest()
            if said not in (None, digest):
                raise ValueError(f"payload of {record_id} does not match its digest")
        else:
            length = re.search(r"(?im)^content-length:\s*(\d+)", http)
            size, digest = int(length[1]) if length else None, said
        yield (
            record_id and record_id[1:-1],
            head.get("warc-target-uri"),
            kind,
            payload,
            size,
            digest,
            refers and refers[1:-1],
        )
