"""Media columns: interleaved document sequences.

``parse_sequences`` reads HTML into an ordered array of items: text blocks and media
references, each with its position; a reference has its digest or URL, its caption (of the
figure, else its alt text) and its declared length. ``store_media`` writes payloads as losslessly compressed
images of 8-bit RGB samples, addressed by the SHA-256 of the payload; ``media_features`` reads the stored bytes
back, decodes them and describes them. ``resolve`` joins references to what was found by
digest, and keeps document, position and caption of every reference on its row. ``assemble`` puts what was resolved back
into the sequences; for that a document need name each payload once only (``wanted``).

No payload is shuffled: the store is written where the payload was read, described where it is
read back, and only the descriptions (some 200 bytes each) meet the references. Copies of a payload are
merged by an aggregation with map-side combine; a join by a hot digest can be split, as its stored side has one row.

Defined results: null and empty HTML have an empty sequence; a null payload counts as empty and is padded to one
whole row of samples; a reference without a stored payload stays, with nulls. Documents are told apart by their key: rows that share one must
have the same HTML (the query's keys hold a digest), and get equal rows. Very long texts are read whole; an empty table has an
empty result; columns but those named play no part.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import slices, write_shared

#: Bytes of a row of samples: 64 pixels of 3 samples.
ROW = 192
#: Bytes of pages or payloads that are worked on at a time.
CHUNK = 1 << 20
ITEMS = "array<struct<position: int, kind: string, text: string, media: string, caption: string, length: bigint>>"
#: Fixed names of the language.
BLOCKS = frozenset("address article aside blockquote body br dd div dl dt figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table td th tr ul".split())
HIDDEN = frozenset("head noscript script style template title".split())
MEDIA = frozenset("audio embed img source video".split())


class _Sequence(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.hidden = 0
        self.figure: int | None = None
        self.caption: list[str] | None = None

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.add(kind="text", text=text)

    def add(self, **item) -> None:
        self.items.append({"position": len(self.items), "kind": None, "text": None, "media": None, "caption": None, "length": None} | item)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in HIDDEN:
            self.hidden += 1
        if self.hidden:
            return
        if tag in BLOCKS or tag in MEDIA or tag == "figcaption":
            self.flush()
        if tag == "figure":
            self.figure = len(self.items)
        elif tag == "figcaption":
            self.caption = []
        elif tag in MEDIA:
            a = dict(attrs)
            if src := a.get("src"):
                length = a.get("data-length") or ""
                self.add(kind="media", media=src.removeprefix("sha256:"), caption=a.get("alt"), length=int(length) if length.isdecimal() and length.isascii() else None)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag in HIDDEN:
            self.hidden -= 1

    def handle_endtag(self, tag: str) -> None:
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption" and self.caption is not None:
            text = " ".join("".join(self.caption).split())
            for item in self.items[self.figure or 0 :] if self.figure is not None else []:
                if item["kind"] == "media":
                    item["caption"] = text
            self.caption = None
        elif tag in BLOCKS:
            self.flush()
            if tag == "figure":
                self.figure = None

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            (self.text if self.caption is None else self.caption).append(data)


def sequence(html: str | None) -> list[dict]:
    parser = _Sequence()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return parser.items


def parse_sequences(df: DataFrame, key: str, html: str) -> DataFrame:
    """key, items: the ordered texts and media references of every document."""

    item = pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("media", pa.string()), ("caption", pa.string()), ("length", pa.int64())])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 1, CHUNK):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sequence(h) for h in b.column(1).to_pylist()], pa.list_(item))], names=["key", "items"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(html).alias("html")).mapInArrow(parse, f"key {kind}, items {ITEMS}").withColumnRenamed("key", key)


def padded(payload: Column) -> Column:
    """Bytes 32 up to a positive multiple of a row of samples."""
    n = F.length(payload)
    return F.rpad(payload, F.greatest(F.lit(ROW), (F.ceil(n / ROW) * ROW).cast("int")), F.expr("X'20'"))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(payload: bytes, level: int = 6) -> bytes:
    """A PNG of 64 pixels a row, 8 bits for each of 3 samples, no row filter; payload: whole rows."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(rows), ROW + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", ROW // 3, len(rows), 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def decode(media: bytes) -> bytes:
    """The samples of what encode() made; every chunk's checksum is verified."""
    if media[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, data, shape = 8, [], None
    while at < len(media):
        (n,) = struct.unpack(">I", media[at : at + 4])
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if struct.pack(">I", zlib.crc32(kind + body)) != media[at + 8 + n : at + 12 + n]:
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            shape = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    if shape is None or shape[2:] != (8, 2, 0, 0, 0):
        raise ValueError("not in the stored form")
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(shape[1], shape[0] * 3 + 1)
    if lines[:, 0].any():
        raise ValueError("filtered rows")
    return lines[:, 1:].tobytes()


def store_media(payloads: DataFrame, payload: str) -> DataFrame:
    """Write every (padded) payload in its stored form; a table of digest and media, as it is read back."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 0, CHUNK):
                made = {}
                for p in b.column(0).to_pylist():
                    if (d := hashlib.sha256(p).digest()) not in made:
                        made[d] = encode(p)
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.binary()) for x in (made, made.values())], names=["digest", "media"])

    return write_shared(payloads.select(F.col(payload).alias("payload")).mapInArrow(put, "digest binary, media binary"), "media", codec="none")


def describe(samples: bytes) -> str:
    """Rows, sum, sum of squares, least, greatest and count of distinct samples, and the three channels' sums."""
    x = np.frombuffer(samples, np.uint8)
    counts = np.bincount(x, minlength=256)
    values = np.arange(256)
    channels = x.reshape(-1, 3).sum(axis=0, dtype=np.int64)
    return ":".join(map(str, (len(x) // ROW, int(counts @ values), int(counts @ values**2), int(x.min()), int(x.max()), int((counts > 0).sum()), *map(int, channels))))


def media_features(store: DataFrame) -> DataFrame:
    """One row for each digest: payload and media sizes and digests, checksum and feature, of the stored bytes."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 1, CHUNK):
                rows = []
                for d, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    samples = decode(m)
                    sha = hashlib.sha256(samples).digest()
                    if sha != d:
                        raise ValueError("the stored form does not give its payload back")
                    rows.append((d, len(samples), zlib.crc32(samples[-16:]), len(m), hashlib.sha256(m).digest(), describe(samples)))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), FOUND.values(), strict=True)], names=list(FOUND))

    found = store.mapInArrow(look, "digest binary, payload_bytes long, tail_crc32 long, media_bytes long, media_sha binary, feature string")
    return found.groupBy("digest").agg(*(F.min(c).alias(c) for c in found.columns[1:]))


FOUND = {"digest": pa.binary(), "payload_bytes": pa.int64(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha": pa.binary(), "feature": pa.string()}


def references(sequences: DataFrame, key: str) -> DataFrame:
    """key, position, media, caption, length of every media reference."""
    item = F.explode(F.filter("items", lambda i: i["kind"] == "media")).alias("i")
    return sequences.select(key, item).select(key, "i.position", "i.media", "i.caption", "i.length")


def wanted(sequences: DataFrame, key: str) -> DataFrame:
    """key, media: what a document's references name, once each."""
    named = F.array_distinct(F.transform(F.filter("items", lambda i: i["kind"] == "media"), lambda i: i["media"]))
    return sequences.select(key, F.explode(named).alias("media"))


def resolve(refs: DataFrame, features: DataFrame) -> DataFrame:
    """Add what is stored under each reference's digest."""
    hexed = F.when(F.col("media").rlike("^[0-9a-f]{64}$"), F.unhex("media"))
    return refs.withColumn("digest", hexed).join(features, "digest", "left")


def assemble(sequences: DataFrame, resolved: DataFrame, key: str) -> DataFrame:
    """Every document's items in order, those of media with what was resolved; a group is one document's references.

    resolved: of references(), by position, or of wanted(), by name, so that a description is sent to a document once.
    """
    by_what = "position" if "position" in resolved.columns else "media"
    cols = [c for c in resolved.columns if c not in (key, "media", "caption", "length")]
    once = resolved.dropDuplicates([key, by_what])
    by = once.groupBy(F.col(key).alias("_key")).agg(F.map_from_entries(F.collect_list(F.struct(by_what, F.struct(*cols)))).alias("_found"))
    joined = sequences.join(by, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")
    return joined.withColumn("items", F.transform("items", lambda i: i.withField("found", F.try_element_at("_found", i[by_what])))).drop("_found")
