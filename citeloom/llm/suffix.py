"""Suffix-array dedup: remove every byte covered by a long string that also starts earlier.

Suffixes are taken at anchors. Every string of ``length`` bytes holds the leftmost of its
least-hashed k-byte tokens, its anchor, and equal strings hold it at the same place; so a run of
strings with one anchor is one suffix record (its bytes, from the first string's start to the last one's end),
some 35 times fewer than byte positions. Then

1. anchors whose token occurs only once in the corpus are dropped (counted by hash over all documents);
2. the records of the rest are range-partitioned by their leading tokens with sampled splitters, which also
   hold document and position, so that a crowd of equal suffixes spreads over buckets. A bucket is sorted by multikey
   quicksort; a record equal to its predecessor repeats it, also across the boundary of buckets;
3. first records that share their token but differ (where repeats begin and end) are compared string by
   string: per token, or, for tokens in crowds, by range partitions as in 2.

Exact copies of a document are found by digest first and removed whole. Texts travel compressed.

Defined results: null texts are empty; a row without an id takes no part and stays whole; rows with equal id and text are one
document and get equal results; rows with one id and several texts are a document for each text, the earlier the lesser the text's
digest; strings are judged on the input, not on what is left. An empty table has an empty result; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import discard, slices, text_of, write_shared
from citeloom.llm.hashing import Prefixes

#: Bytes of an anchor's token.
TOKEN = 32
#: Records of a token beyond which its strings are sorted over many buckets.
CROWD = 4096
#: Bytes of text that are worked on at a time, and of records in a bucket.
CHUNK, BUCKET = 1 << 20, 12 << 20
#: Bytes of text in a part of a batch in which repeated tokens are told.
PART = 8 << 20


def _quiet() -> None:
    np.seterr(over="ignore")


def anchors(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """text, token hash, anchor, first and last string start (all within the text) of every record."""
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.concatenate(([0], np.cumsum(sizes)))
    data = np.frombuffer(b"".join(texts), np.uint8)
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none.view(np.uint64), none, none, none
    h = Prefixes(data).windows(TOKEN)
    bits = np.uint64(max(1, len(h).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    # Sliding minimum over the tokens of a string, by doubling; the place in the low bits makes it the leftmost.
    span, least = 1, key
    tokens = length - TOKEN + 1
    while span * 2 <= tokens:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < tokens:
        least = np.minimum(least[: len(least) - (tokens - span)], least[tokens - span :])
    at = (least & low).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    start = np.flatnonzero(owner[: len(at)] == owner[length - 1 :])
    at, own = at[start], owner[start]
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (own[1:] != own[:-1]) | (start[1:] != start[:-1] + 1))) if len(at) else np.zeros(0, bool))
    last = np.concatenate((new[1:], [len(at)])).astype(np.int64) - 1 if len(new) else none
    text = own[new]
    base = begins[text]
    return text, h[at[new]], at[new] - base, start[new] - base, start[last] - base


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= CHUNK):
            size += len(texts[to])
            to += 1
        yield at, texts[at:to]
        at = to


def token_rows(docs: DataFrame, length: int) -> DataFrame:
    """place, state, h, doc, anchor of every record. docs: doc, text.

    A token that one batch has several times is known to repeat: its rows (state 2) go anywhere, and one more row (state 1) stands
    for them where the token's rows meet. So a token that a third of all documents hold sends a few rows for each batch there.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _quiet()
        for b in (part for whole in batches for part in slices(whole, 1, PART)):
            ids = b.column(0).to_numpy()
            hs, docs_, at_ = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for at, part in _chunks([t.encode("utf-8", "surrogatepass") for t in b.column(1).to_pylist()]):
                text, h, anchor, _, _ = anchors(part, length)
                hs.append(h)
                docs_.append(ids[at + text])
                at_.append(anchor)
            h, doc, anchor = np.concatenate(hs).view(np.int64), np.concatenate(docs_), np.concatenate(at_)
            if not len(h):
                continue
            token, back, count = np.unique(h, return_inverse=True, return_counts=True)
            known = count[back] > 1
            stand = token[count > 1]
            place = np.concatenate((np.where(known, doc, h), stand))
            none = np.zeros(len(stand), np.int64)
            columns = (place, np.concatenate((np.where(known, 2, 0), none + 1)).astype(np.int32), np.concatenate((h, stand)), np.concatenate((doc, none)), np.concatenate((anchor, none)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=TOKENS)

    return docs.mapInArrow(find, "place long, state int, h long, doc long, anchor int")


TOKENS = ("place", "state", "h", "doc", "anchor")


def repeated(rows: DataFrame) -> DataFrame:
    """doc, anchor of the rows whose token occurs again."""

    def again(t: pa.Table) -> Iterator[pa.RecordBatch]:
        h, state = t.column("h").to_numpy(), t.column("state").to_numpy()
        same = np.concatenate(([False], h[1:] == h[:-1], [False]))
        keep = (state == 2) | ((state == 0) & (same[1:] | same[:-1]))
        if keep.any():
            yield from t.filter(pa.array(keep)).select(["doc", "anchor"]).combine_chunks().to_batches()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            now = pa.table(b.columns, names=TOKENS)
            if held is not None:
                now = pa.concat_tables([held, now])
            h = now.column("h").to_numpy()
            last = int(np.flatnonzero(h != h[-1])[-1]) + 1 if len(h) and h[0] != h[-1] else 0
            held = now.slice(last)
            yield from again(now.slice(0, last))
        if held is not None:
            yield from again(held)

    return rows.repartition("place").sortWithinPartitions("h").mapInArrow(find, "doc long, anchor int")


def packed_texts(docs: DataFrame) -> DataFrame:
    """doc, packed: the texts, compressed."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for b in (part for whole in batches for part in slices(whole, 1, PART)):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([packer.compress(t.encode("utf-8", "surrogatepass")) for t in b.column(1).to_pylist()], pa.binary())], names=["doc", "packed"])

    return docs.mapInArrow(pack, "doc long, packed binary")


RECORD = "h long, doc long, first int, last int, suffix binary"


def records(suspects: DataFrame, length: int) -> DataFrame:
    """The suffix records of the anchors that are kept. suspects: doc, packed, kept array<int>."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _quiet()
        unpack = zstandard.ZstdDecompressor()
        for b in (part for whole in batches for part in slices(whole, 1, CHUNK)):
            ids = b.column(0).to_numpy()
            texts = [unpack.decompress(p) for p in b.column(1).to_pylist()]
            lists = b.column(2)
            for at, part in _chunks(texts):
                text, h, anchor, first, last = anchors(part, length)
                if not len(text):
                    continue
                own = lists.slice(at, len(part))
                kept = own.flatten().to_numpy()
                owner = np.repeat(np.arange(len(part)), np.diff(own.offsets.to_numpy()))
                place = np.int64(1) << 40
                ok = np.flatnonzero(np.isin(text * place + anchor, owner * place + kept))
                suffix = [part[t][i : j + length] for t, i, j in zip(text[ok].tolist(), first[ok].tolist(), last[ok].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[ok].view(np.int64)), pa.array(ids[at + text[ok]]), pa.array(first[ok].astype(np.int32)), pa.array(last[ok].astype(np.int32)), pa.array(suffix, pa.binary())], names=["h", "doc", "first", "last", "suffix"]
                )

    return suspects.select("doc", "packed", "kept").mapInArrow(cut, RECORD)


def words_of(strings: pa.Array) -> np.ndarray:
    """The strings as rows of big-endian 8-byte words, zero-padded; the last word is the length."""
    offsets = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    sizes = np.diff(offsets)
    width = -(-int(sizes.max(initial=1)) // 8) * 8
    data = np.frombuffer(strings.buffers()[2] or b"", np.uint8)
    out = np.zeros((len(strings), width), np.uint8)
    inside = np.arange(width) < sizes[:, None]
    out[inside] = data[offsets[0] : offsets[-1]]
    return np.hstack([out.view(">u8").astype(np.uint64), sizes[:, None].astype(np.uint64)])


def multikey_sort(words: np.ndarray, lead: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows, and the rank group of each place in it: equal rows have equal groups.

    Multikey quicksort over 8-byte characters: rows are parted by one character at a time, and only groups that still
    tie are parted by the next. lead: groups that are set before. Equal rows stay in the order given.
    """
    n = len(words)
    order, group, live = np.arange(n), np.zeros(n, np.int64), np.arange(n)
    if lead is not None and n:
        order = np.argsort(lead, kind="stable")
        new = np.concatenate(([True], lead[order][1:] != lead[order][:-1]))
        group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    for k in range(words.shape[1]):
        # places of groups with more than one row; the rest is in order
        g = group[live]
        tied = np.zeros(len(live), bool)
        if len(live) > 1:
            same = (g[1:] == g[:-1])
            tied[1:] |= same
            tied[:-1] |= same
        live = live[tied]
        if not len(live):
            break
        g, character = group[live], words[order[live], k]
        by = np.lexsort((character, g))
        order[live] = order[live][by]
        g, character = g[by], character[by]
        # a group's number is the place of its first row
        new = np.concatenate(([True], (g[1:] != g[:-1]) | (character[1:] != character[:-1])))
        group[live] = live[np.maximum.accumulate(np.where(new, np.arange(len(live)), 0))]
    return order, group


def _flat(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)


def _whole(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    got = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(got).combine_chunks() if got else None


def mark_repeats(rows: DataFrame, size: int, per_row: int) -> tuple[DataFrame, dict[int, bool]]:
    """h, doc, first, last, suffix, part, head, again: whether a record equals an earlier one.

    The records with ``head`` are the first of their bucket, one in each; whether they repeat the last record of the bucket before
    is in the dict, by part. size: the number of rows.
    """
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size * per_row // BUCKET))

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _whole(batches)
        if t is None:
            return
        # earlier strings first among equal ones
        t = t.take(pa.array(np.lexsort((t.column("first").to_numpy(), t.column("doc").to_numpy()))))
        order, group = multikey_sort(words_of(_flat(t.column("suffix"))))
        t = t.take(pa.array(order))
        again = np.concatenate(([False], group[1:] == group[:-1]))
        head = np.arange(len(order)) == 0
        n = len(order)
        tail = np.arange(n) == n - 1
        t = t.append_column("part", pa.array(np.full(n, TaskContext.get().partitionId(), np.int32))).append_column("head", pa.array(head)).append_column("tail", pa.array(tail)).append_column("again", pa.array(again))
        # What repeats its predecessor needs its bytes no more, but at the ends of the bucket.
        bytes_of = pc.if_else(pa.array(again & ~head & ~tail), pa.scalar(None, pa.binary()), _flat(t.column("suffix")))
        yield from t.set_column(t.schema.get_field_index("suffix"), "suffix", bytes_of).to_batches(max_chunksize=1 << 15)

    # Splitters are sampled by Spark; document and position part what is equal.
    dealt = rows.repartitionByRange(parts, "suffix", "doc", "first")
    out = write_shared(dealt.mapInArrow(sort, RECORD + ", part int, head boolean, tail boolean, again boolean"), "suffixes")
    # A record or two of each bucket: as many as there are buckets, not records.
    heads: dict[int, bytes] = {}
    tails: dict[int, bytes] = {}
    for r in out.filter("head OR tail").select("part", "head", "tail", F.unhex(F.sha2("suffix", 256)).alias("digest")).toLocalIterator():
        if r["head"]:
            heads[r["part"]] = bytes(r["digest"])
        if r["tail"]:
            tails[r["part"]] = bytes(r["digest"])
    over, before = {}, None
    for p in sorted(heads):
        over[p] = heads[p] == before
        before = tails[p]
    return out, over


def _resolved(out: DataFrame, over: dict[int, bool]) -> DataFrame:
    """again, with the heads of buckets decided."""
    yes = [p for p, x in over.items() if x]
    return out.withColumn("again", F.col("again") | (F.col("head") & F.col("part").isin(yes))) if yes else out


INTERVAL = "doc long, first int, last int"


def _intervals(doc: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """Runs of consecutive starts, of one document each."""
    by = np.lexsort((start, doc))
    doc, start = doc[by], start[by]
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1)))
    at = np.flatnonzero(new)
    last = np.concatenate((at[1:], [len(doc)])) - 1
    return pa.RecordBatch.from_arrays([pa.array(doc[at]), pa.array(start[at].astype(np.int32)), pa.array(start[last].astype(np.int32))], names=["doc", "first", "last"])


def _strings(t: pa.Table, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start in its document, and place in the rows' bytes of every string of the records."""
    first, last = t.column("first").to_numpy().astype(np.int64), t.column("last").to_numpy()
    count = last - first + 1
    row = np.repeat(np.arange(len(count)), count)
    inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return row, first[row] + inside, np.repeat(np.cumsum(count + length - 1) - (count + length - 1), count) + inside


def compared(firsts: DataFrame, length: int) -> DataFrame:
    """Intervals of string starts that repeat an earlier string with the same token. firsts: no token in a crowd."""

    def compare(t: pa.Table) -> Iterator[pa.RecordBatch]:
        h = t.column("h").to_numpy()
        same = h[1:] == h[:-1]
        many = np.concatenate((same, [False])) | np.concatenate(([False], same))
        if not many.any():
            return
        t = t.filter(pa.array(many)).combine_chunks()
        h, doc = t.column("h").to_numpy(), t.column("doc").to_numpy()
        data = np.frombuffer(b"".join(t.column("suffix").to_pylist()), np.uint8)
        row, start, at = _strings(t, length)
        # whole tokens at a time, some tens of MB of strings
        ends = np.flatnonzero(np.concatenate((h[row][1:] != h[row][:-1], [True]))) + 1
        lo = 0
        while lo < len(row):
            hi = int(ends[max(np.searchsorted(ends, lo + (1 << 17), "right") - 1, np.searchsorted(ends, lo, "right"))])
            part = np.zeros((hi - lo, -(-length // 8) * 8), np.uint8)
            part[:, :length] = np.lib.stride_tricks.sliding_window_view(data, length)[at[lo:hi]]
            order, group = multikey_sort(part.view(">u8").astype(np.uint64), h[row[lo:hi]])
            hit = order[np.concatenate(([False], group[1:] == group[:-1]))] + lo
            if len(hit):
                yield _intervals(doc[row[hit]], start[hit])
            lo = hi

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.nbytes
            if size < BUCKET // 2:
                continue
            t = pa.Table.from_batches(held)
            h = t.column("h").to_numpy()
            last = int(np.flatnonzero(h != h[-1])[-1]) + 1 if h[0] != h[-1] else 0
            if last:
                yield from compare(t.slice(0, last))
            held, size = t.slice(last).to_batches(), 0
        if held and (t := pa.Table.from_batches(held)).num_rows:
            yield from compare(t)

    return firsts.select("h", "doc", "first", "last", "suffix").repartition("h").sortWithinPartitions("h", "doc", "first").mapInArrow(find, INTERVAL)


def single_strings(crowded: DataFrame, length: int) -> DataFrame:
    """A record for each string of the records."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                t = pa.Table.from_batches([b.slice(at, 2048)])
                row, start, place = _strings(t, length)
                data = b"".join(t.column("suffix").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(t.column("h").to_numpy()[row]), pa.array(t.column("doc").to_numpy()[row]), *[pa.array(start.astype(np.int32))] * 2, pa.array([data[i : i + length] for i in place.tolist()], pa.binary())],
                    names=["h", "doc", "first", "last", "suffix"],
                )

    return crowded.select("h", "doc", "first", "last", "suffix").mapInArrow(split, RECORD)


def removed(suspects: DataFrame, intervals: DataFrame, length: int) -> DataFrame:
    """doc, n_removed, n_spans, kept_sha256, spans (start and end in bytes) of every document that loses bytes."""
    by = intervals.groupBy("doc").agg(F.collect_list(F.struct("first", "last")).alias("runs"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            rows = []
            for doc, packed, runs in zip(b["doc"], b["packed"], b["runs"], strict=True):
                text, spans = unpack.decompress(bytes(packed)), []
                for r in sorted((r["first"], r["last"] + length) for r in runs):
                    if spans and r[0] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], r[1])
                    else:
                        spans.append(list(r))
                kept, at = hashlib.sha256(), 0
                for lo, hi in spans:
                    kept.update(text[at:lo])
                    at = hi
                kept.update(text[at:])
                rows.append((doc, sum(hi - lo for lo, hi in spans), len(spans), kept.hexdigest(), [{"start": lo, "end": hi} for lo, hi in spans]))
            yield pd.DataFrame(rows, columns=["doc", "n_removed", "n_spans", "kept_sha256", "spans"])

    return suspects.join(by, "doc").select("doc", "packed", "runs").mapInPandas(cut, "doc long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: bigint, end: bigint>>")


def _by_ordinal(df: DataFrame, narrow: DataFrame, key: str, text: str, length: int) -> DataFrame:
    """dedup() where ids come with several texts: documents are numbered in the order of id and digest, without a window over all rows."""
    by = [key, "sha"]
    rows = narrow.filter(F.col(key).isNotNull()).select(*by).distinct().repartitionByRange(*by).sortWithinPartitions(*by)
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # the row's number in its partition
    rows = write_shared(rows.select(*by, F.spark_partition_id().alias("part"), at.alias("at")), "ordinals")
    start, before = [], 0
    for r in rows.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():  # a row for each partition
        start.append((r["part"], before))
        before += r["n"]
    offsets = df.sparkSession.createDataFrame(start, "part int, before long")
    numbers = write_shared(rows.join(F.broadcast(offsets), "part").select(*by, (F.col("before") + F.col("at")).alias("ordinal")), "ordinals")
    t = text_of(F.col(text))
    numbered = df.select(F.col(key), t.alias("text"), F.unhex(F.sha2(t, 256)).alias("sha")).join(numbers, by, "left").select("ordinal", "text")
    out = dedup(write_shared(numbered, "numbered"), "ordinal", "text", length)
    return out.join(numbers, "ordinal", "left").select(key, *(c for c in out.columns if c != "ordinal"))


def dedup(df: DataFrame, key: str, text: str, length: int = 100) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256, spans of every row."""
    t = text_of(F.col(text))
    docs = df.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc"), t.alias("text"))
    narrow = write_shared(df.select(F.col(key), F.octet_length(t).cast("long").alias("n_bytes"), F.unhex(F.sha2(t, 256)).alias("sha")), "digests")

    several = narrow.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min("sha").alias("lo"), F.max("sha").alias("hi")).filter("lo <> hi")
    if not several.isEmpty():
        return _by_ordinal(df, narrow, key, text, length)
    kept = write_shared(repeated(token_rows(docs, length)).groupBy("doc").agg(F.collect_set("anchor").alias("kept")), "anchors")
    first = narrow.filter(F.col("n_bytes") >= length).groupBy("sha").agg(F.min(key).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    narrow = write_shared(narrow.join(first, "sha", "left").withColumn("copy", F.coalesce(F.col("first") < F.col(key), F.lit(False))).drop("first"), "copies")
    copies = narrow.filter("copy").select(F.col(key).cast("long").alias("doc"))
    texts = packed_texts(docs).dropDuplicates(["doc"])
    suspects = write_shared(texts.join(kept.join(copies, "doc", "left_anti"), "doc"), "suspects", codec="none")
    discard(kept)

    cut = write_shared(records(suspects, length), "records")
    out, over = mark_repeats(cut, cut.count(), length * 2)
    discard(cut)
    marked = _resolved(out, over)
    firsts = marked.filter(~F.col("again"))
    crowds = write_shared(firsts.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") > CROWD).select("h"), "crowds")
    some = not crowds.isEmpty()
    intervals = marked.filter("again").select("doc", "first", "last").unionByName(compared(firsts.join(crowds, "h", "left_anti") if some else firsts, length))
    intervals = write_shared(intervals, "intervals")
    if some:
        crowded = write_shared(single_strings(firsts.join(crowds, "h", "left_semi"), length), "strings")
        single, over = mark_repeats(crowded, crowded.count(), length + 40)
        intervals = write_shared(intervals.unionByName(_resolved(single, over).filter("again").select("doc", "first", "last")), "intervals")
        discard(crowded, single)
    discard(out)
    lost = removed(suspects, intervals, length)

    keep = F.when(F.col("copy"), F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("sha"))))
    every = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    none = F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)")
    return narrow.join(lost, narrow[key].cast("long") == lost["doc"], "left").select(
        key,
        "n_bytes",
        F.when(F.col("copy"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        keep.alias("kept_sha256"),
        F.when(F.col("copy"), every).otherwise(F.coalesce("spans", none)).alias("spans"),
    )

