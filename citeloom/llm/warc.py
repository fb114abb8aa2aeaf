"""WARC archives: a writer, and a sequential reader.

An archive is a run of gzip members, one per record. The reader takes an archive in
chunks of any size, inflates it member by member with an incremental zlib object, frames
header and block by Content-Length, and checks both digests of every record.

Archives are kept as rows (archive, data) of a written table, so that they reach any store that
Spark can write, and can be exported as files. A writer closes an archive once it holds
``archive_bytes``; an archive is therefore at most that plus one record, whatever the table's size.

Payloads that repeat are stored once: the record with the smallest key is the response,
the others are revisits that name it and have no block beyond their HTTP head. The keys are
found by an aggregation over digests, and joined to the rows by digest (a join whose
hot digests Spark may split), before any byte is written.

Defined results: a null payload counts as empty; payloads under ``min_revisit`` bytes
are always responses; a null URL is written as ``urn:page:`` and the key; rows with a null
key are kept, with a null key. Repeated rows each have a record. Very long payloads are one record each; an empty table has no
records; other columns of the input play no part, whatever their names. Damaged or truncated members and wrong
digests raise ``WarcError``.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ARCHIVE_BYTES, CHUNK, LEVEL = 8 << 20, 1 << 16, 6
#: Fixed texts of the format.
VERSION, CRLF = b"WARC/1.1", b"\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


class WarcError(ValueError):
    pass


def digest(data: bytes) -> str:
    return "sha256:" + base64.b32encode(hashlib.sha256(data).digest()).decode().rstrip("=")


def record_id(key: str) -> str:
    return f"<urn:page:{key}>"


def record_key(name: str) -> str:
    return name.removeprefix("<urn:page:").removesuffix(">")


def record(key: str, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """A record as one gzip member."""
    block = HTTP_HEAD if refers_to is not None else HTTP_HEAD + payload
    target = url if url and not any(c in url for c in "\r\n") else f"urn:page:{key}"
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(key)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", target),
        ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Payload-Digest", digest(payload)),
        ("WARC-Block-Digest", digest(block)),
        ("X-Payload-Length", str(len(payload))),
        ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        fields[4:4] = [("WARC-Refers-To", record_id(refers_to)), ("WARC-Profile", PROFILE)]
    head = VERSION + CRLF + b"".join(f"{k}: {v}".encode() + CRLF for k, v in fields) + CRLF
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(head + block + CRLF + CRLF) + packer.flush()


@dataclass
class Record:
    fields: dict[str, str]
    block: bytes

    @property
    def key(self) -> str:
        return record_key(self.fields["warc-record-id"])

    @property
    def refers_to(self) -> str | None:
        name = self.fields.get("warc-refers-to")
        return None if name is None else record_key(name)

    @property
    def payload(self) -> bytes:
        return self.block.partition(CRLF + CRLF)[2]


def members(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """The inflated members of a stream that comes in chunks."""
    inflater, parts = None, []
    for chunk in chunks:
        while chunk:
            if inflater is None:
                inflater, parts = zlib.decompressobj(31), []
            try:
                parts.append(inflater.decompress(chunk))
            except zlib.error as e:
                raise WarcError(f"damaged member: {e}") from e
            chunk = b""
            if inflater.eof:
                chunk = inflater.unused_data
                yield b"".join(parts)
                inflater = None
    if inflater is not None:
        raise WarcError("truncated member")


def parse(member: bytes) -> Record:
    head, gap, rest = member.partition(CRLF + CRLF)
    version, *lines = head.split(CRLF)
    if not gap or version != VERSION:
        raise WarcError("no WARC header")
    fields = {}
    for line in lines:
        name, colon, value = line.decode().partition(":")
        if not colon:
            raise WarcError("a header line without a colon")
        fields[name.strip().lower()] = value.strip()
    try:
        length = int(fields["content-length"])
    except (KeyError, ValueError) as e:
        raise WarcError("no usable Content-Length") from e
    block = rest[:length]
    if len(block) != length or rest[length:] != CRLF + CRLF:
        raise WarcError("the block does not have its Content-Length")
    if fields.get("warc-block-digest") not in (None, digest(block)):
        raise WarcError("wrong block digest")
    out = Record(fields, block)
    if out.refers_to is None and fields.get("warc-payload-digest") not in (None, digest(out.payload)):
        raise WarcError("wrong payload digest")
    return out


def read(data: bytes, chunk: int = CHUNK) -> Iterator[Record]:
    """The records of one archive, in order, one in memory at a time."""
    view = memoryview(data)
    return map(parse, members(bytes(view[i : i + chunk]) for i in range(0, len(view), chunk)))


def write_archives(df: DataFrame, key: str, url: str, payload: str, min_revisit: int = 100, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Rows (archive binary): each holds some records of df, in the order of its partition."""
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(url).alias("url"), F.encode(F.coalesce(payload, F.lit("")), "UTF-8").alias("payload"))
    # Short payloads get a key of their own in place of a digest: it finds no partner, and they do not meet in one task.
    rows = rows.withColumn("digest", F.when(F.length("payload") >= min_revisit, F.unhex(F.sha2("payload", 256))).otherwise(F.encode(F.coalesce(F.col("key").cast("string"), F.lit("")), "UTF-8")))
    first = rows.filter(F.length("digest") == 32).groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    # Keys travel as strings: a null among integers would turn the batch into floating point.
    name = F.coalesce(F.col("key").cast("string"), F.lit(""))
    placed = rows.join(first, "digest", "left").select(name.alias("key"), "url", "payload", F.when(~F.col("first").eqNullSafe(F.col("key")), F.col("first")).cast("string").alias("refers_to"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, size = [], 0
        for b in batches:
            for k, u, p, r in zip(b["key"], b["url"], b["payload"], b["refers_to"], strict=True):
                parts.append(record(k, u, bytes(p), r))
                size += len(parts[-1])
                if size >= archive_bytes:
                    yield pd.DataFrame({"data": [b"".join(parts)]})
                    parts, size = [], 0
        if parts:
            yield pd.DataFrame({"data": [b"".join(parts)]})

    return placed.mapInPandas(pack, "data binary")


RECORDS = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


def read_archives(archives: DataFrame, data: str = "data", payloads: bool = True) -> DataFrame:
    """A row for each record; a revisit has no payload of its own, but length and digest of the one it stands for."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def frame(rows: list) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=RECORDS.names)

        for b in batches:
            for archive in b[data]:
                rows, held = [], 0
                for r in read(archive):
                    own = r.refers_to is None
                    code = r.fields["warc-payload-digest"].removeprefix("sha256:")
                    hexed = base64.b32decode(code + "=" * (-len(code) % 8)).hex()
                    body = r.payload if own else None
                    rows.append((r.key, r.fields["warc-type"], r.refers_to, r.fields["warc-target-uri"], len(body) if own else int(r.fields["x-payload-length"]), hexed, body if payloads else None))
                    held += len(r.block)
                    if held > CHUNK * 64:
                        yield frame(rows)
                        rows, held = [], 0
                if rows:
                    yield frame(rows)

    out = archives.select(data).mapInPandas(unpack, RECORDS)
    return out.withColumns({c: F.expr(f"try_cast({c} AS bigint)") for c in ("key", "refers_to")})
