"""The corpus operators against brute force, and on odd rows."""

import hashlib
import html
import itertools
import os
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citeloom.llm import jaccard, media, mixing, packing, pii, quality, queries, suffix, topk, url_filter, warc

# 1 media


def test_media_round_trip():
    for n in (192, 384, 19200):
        data = bytes(random.Random(n).randrange(256) for _ in range(n))
        assert media.decode(media.encode(data)) == data
    with pytest.raises(ValueError, match="damaged"):
        media.decode(media.encode(bytes(192))[:-20] + b"x" * 20)


def test_sequences(spark):
    page = '<h1>A</h1><p>b <b>c</b></p><figure><img src="sha256:ff" alt="x"><figcaption>cap  tion</figcaption></figure><script>no</script>tail<img src="u.png" alt="alt"><img alt="none">'
    items = media.sequence(page)
    assert [(i["position"], i["kind"], i["text"], i["media"], i["caption"]) for i in items] == [(0, "text", "A", None, None), (1, "text", "b c", None, None), (2, "media", None, "ff", "cap tion"), (3, "text", "tail", None, None), (4, "media", None, "u.png", "alt")]
    assert media.sequence(None) == media.sequence("") == []


def test_media_query(spark, docs):
    payloads = docs.select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("b")).select("doc_id", media.padded(F.col("b")).alias("payload"))
    features = {bytes(r["digest"]): r for r in media.media_features(media.store_media(payloads, "payload")).collect()}
    for r in docs.collect():
        raw = (r["text"] or "").encode()
        p = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        f = features[hashlib.sha256(p).digest()]
        assert (f["payload_bytes"], f["tail_crc32"]) == (len(p), zlib.crc32(p[-16:]))
        assert bytes(f["media_sha"]) == hashlib.sha256(media.encode(p)).digest()


def test_resolve_keeps_places(spark):
    pages = spark.createDataFrame([(1, "<p>t</p><img src='sha256:" + hashlib.sha256(b" " * 192).hexdigest() + "' alt='c'><img src='http://x'>"), (None, None)], "page_id long, html string")
    features = media.media_features(media.store_media(spark.createDataFrame([(bytearray(b" " * 192),)], "p binary"), "p"))
    seq = media.parse_sequences(pages, "page_id", "html")
    found = media.resolve(media.references(seq, "page_id"), features)
    got = {r["position"]: (r["caption"], r["payload_bytes"]) for r in found.collect()}
    assert got == {1: ("c", 192), 2: (None, None)}
    whole = {r["page_id"]: r["items"] for r in media.assemble(seq, found, "page_id").collect()}
    assert [i["found"] and i["found"]["payload_bytes"] for i in whole[1]] == [None, 192, None] and whole[None] == []


def brute_page(text):
    """What op1_media says of a text: payload and sequence, found without the library."""
    raw = text.encode()
    payload = raw.ljust(max(192, -(-len(raw) // 192) * 192))
    sha, lines = hashlib.sha256(payload).hexdigest(), [x for x in text.split("\n") if re.search(r"[^ \t\r\x0b\x0c]", x)]
    flat = lambda x: " ".join(x.split())
    items, captions, positions = [], [], []

    def show(caption):
        positions.append(len(items))
        captions.append(caption)
        items.append(sha)

    esc = lambda x: x.replace("&", "&amp;").replace("<", "&lt;").replace('"', "&quot;")[:60]
    for i, line in enumerate(lines):
        if flat(line):
            items.append(hashlib.sha256(flat(line).encode()).hexdigest())
        if i == 0:
            show(flat(html.unescape(esc(line))))
        if i + 1 == len(lines) // 2:
            show(html.unescape(esc(line)))
    show(flat(html.unescape(esc(lines[-1]))) if lines else "")
    digest = lambda x: hashlib.sha256("\n".join(x).encode()).hexdigest()
    return (len(raw), len(payload), sha, zlib.crc32(payload[-16:]), len(items), ",".join(map(str, positions)), digest(captions), digest(items))


def test_media_op(spark, docs, empty, tmp_path):
    extra = [(2000, "a & b <c> \"d\"\nsecond line\n\n third\tline \nfourth", None, None, None, "k", 1, 1, "p", 1), (2000, "another text", None, None, None, "k", 1, 1, "p", 1), (None, "x", None, None, None, "k", 1, 1, "p", 1), (None, "x", None, None, None, "k", 1, 1, "p", 1)]
    rows = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["n_items"], r["positions"], r["captions_sha256"], r["sequence_sha256"]) for r in queries.op1_media(spark, str(tmp_path)).collect())
    assert got == Counter((r["doc_id"], *brute_page(r["text"] or "")) for r in rows.collect())
    for r in queries.op1_media(spark, str(tmp_path)).collect():
        assert r["media_bytes"] > 0 and len(r["media_sha256"]) == 64
    features = {r["payload_sha256"]: (r["feature"], r["media_bytes"], r["media_sha256"]) for r in queries.op1_media(spark, str(tmp_path)).collect()}
    for t in ("x", "one", extra[0][1]):
        p = t.encode().ljust(-(-len(t.encode()) // 192) * 192)
        x, stored = np.frombuffer(p, np.uint8).astype(int), media.encode(p)
        want = ":".join(map(str, (len(p) // 192, x.sum(), (x**2).sum(), x.min(), x.max(), len(set(p)), x[::3].sum(), x[1::3].sum(), x[2::3].sum())))
        assert features[hashlib.sha256(p).hexdigest()] == (want, len(stored), hashlib.sha256(stored).hexdigest())
    empty.write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.op1_media(spark, f"{tmp_path}/none").count() == 0


def test_media_store_is_gone(spark, tmp_path, monkeypatch):
    """The stored payloads are deleted when they have been read back, before sequences are written."""
    spark.createDataFrame([(1, "a\nb"), (2, "c")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    seen, write = [], queries.write_shared

    def look(df, tag, **how):
        out = write(df, tag, **how)
        seen.append((tag, [os.path.isdir(f.removeprefix("file:").rsplit("/", 1)[0]) for f in stored]))
        return out

    stored, store = [], media.store_media
    monkeypatch.setattr(media, "store_media", lambda *a: (out := store(*a), stored.extend(out.inputFiles()))[0])
    monkeypatch.setattr(queries, "write_shared", look)
    assert queries.op1_media(spark, str(tmp_path)).count() == 2
    assert seen[0][0] == "features" and all(seen[0][1]) and stored
    assert seen[1][0] == "pages" and not any(seen[1][1])


def test_media_names_payloads_once(spark):
    """A document's payload is looked up once, however often it is named; by name or by position the same comes back."""
    sha = hashlib.sha256(b" " * 192).hexdigest()
    pages = spark.createDataFrame([(1, f"<img src='sha256:{sha}'>t<img src='sha256:{sha}'><img src='http://x'>" * 2), (2, "t"), (None, f"<img src='sha256:{sha}'>")], "page_id long, html string")
    features = media.media_features(media.store_media(spark.createDataFrame([(bytearray(b" " * 192),)], "p binary"), "p"))
    seq = media.parse_sequences(pages, "page_id", "html")
    named = media.wanted(seq, "page_id")
    assert sorted((r["page_id"] or 0, r["media"]) for r in named.collect()) == [(0, sha), (1, sha), (1, "http://x")]
    shape = lambda df: {r["page_id"]: [(i["position"], i["kind"], i["media"], i["found"] and i["found"]["payload_bytes"], i["found"] and i["found"]["feature"]) for i in r["items"]] for r in df.collect()}
    once = shape(media.assemble(seq, media.resolve(named, features), "page_id"))
    assert once == shape(media.assemble(seq, media.resolve(media.references(seq, "page_id"), features), "page_id"))
    assert [i[3] for i in once[1]] == [192, None, 192, None] * 2 and once[None][0][3] == 192


def test_media_pages_in_linear_time(spark):
    """The middle line was counted anew for every line, which took the square of a text's lines."""
    row = spark.createDataFrame([("some words\n" * 20000, "d" * 64, 5)], "text string, digest string, n int")
    row = row.select(queries.page_lines(F.col("text")).alias("lines"), "digest", "n")
    began = time.perf_counter()
    page = row.select(queries.page_of(F.col("lines"), F.col("digest"), F.col("n")).alias("html")).first()["html"]
    assert time.perf_counter() - began < 20
    items = media.sequence(page)
    assert len(items) == 20003 and [i["position"] for i in items if i["kind"] == "media"] == [1, 10001, 20002]


# 2 suffix array


def brute_removed(docs, length):
    seen, out = set(), {}
    for k, t in sorted(docs.items()):
        b = t.encode()
        cover = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                cover[i : i + length] = True
            seen.add(w)
        kept = bytes(np.frombuffer(b, np.uint8)[~cover])
        spans = int((np.diff(np.concatenate(([0], cover.astype(int)))) == 1).sum())
        out[k] = (len(b), int(cover.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("crowd", [4096, 2])
def test_suffix(spark, docs, monkeypatch, crowd):
    monkeypatch.setattr(suffix, "CROWD", crowd)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.dedup(docs, "doc_id", "text", 100).collect()}
    assert got == brute_removed({r["doc_id"]: r["text"] or "" for r in docs.collect()}, 100)


def test_suffix_odd_rows(spark, empty):
    assert suffix.dedup(empty, "doc_id", "text").count() == 0
    t = "x y z " * 50
    df = spark.createDataFrame([(5, t), (5, t), (None, t)], "doc_id long, text string")
    rows = suffix.dedup(df, "doc_id", "text").collect()
    assert len(rows) == 3 and len({tuple(map(str, r)) for r in rows if r["doc_id"] == 5}) == 1
    assert [r["n_removed"] for r in rows if r["doc_id"] is None] == [0]


def test_suffix_ids_with_several_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    texts = [(5, a + b), (5, b + c), (5, b + c), (9, c + a), (2, None), (None, a)]
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.dedup(spark.createDataFrame(texts, "doc_id long, text string"), "doc_id", "text").collect())
    order = sorted({(k, t or "") for k, t in texts if k is not None}, key=lambda x: (x[0], hashlib.sha256(x[1].encode()).digest()))
    want = dict(zip(order, brute_removed({i: t for i, (_, t) in enumerate(order)}, 100).values(), strict=True))
    assert got == Counter((k, *(want[k, t or ""] if k is not None else (len(t), 0, 0, hashlib.sha256(t.encode()).hexdigest()))) for k, t in texts)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=20), min_size=1, max_size=30))
def test_multikey_sort(strings):
    import pyarrow as pa

    order, group = suffix.multikey_sort(suffix.words_of(pa.array(strings, pa.binary())))
    assert [strings[i] for i in order] == sorted(strings)
    for i in range(1, len(order)):
        assert (group[i] == group[i - 1]) == (strings[order[i]] == strings[order[i - 1]])


# 3 WARC


def test_warc_reader():
    members = [warc.record("1", "http://a", b"x" * 200, None), warc.record("2", None, b"x" * 200, "1"), warc.record("", "a\r\nb", b"", None)]
    for chunk in (1, 7, 1 << 16):
        got = list(warc.read(b"".join(members), chunk))
        assert [(r.key, r.refers_to, r.payload) for r in got] == [("1", None, b"x" * 200), ("2", "1", b""), ("", None, b"")]
    with pytest.raises(warc.WarcError, match="truncated"):
        list(warc.read(members[0][:-5]))
    with pytest.raises(warc.WarcError):
        list(warc.read(members[0][:40] + b"zz" + members[0][42:]))
    import gzip

    raw = gzip.decompress(members[0])
    with pytest.raises(warc.WarcError, match="digest"):
        warc.parse(raw.replace(b"x" * 200, b"y" * 200))
    with pytest.raises(warc.WarcError, match="Content-Length"):
        warc.parse(raw[:-2])


def test_warc_tables(spark):
    long_ = "<p>" + "z" * 200
    pages = spark.createDataFrame([(3, "u", long_), (1, None, long_), (2, "u", "s"), (4, "u", "s"), (5, "u", None), (None, "u", long_)], "page_id long, url string, html string")
    got = {r["key"]: (r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.read_archives(warc.write_archives(pages, "page_id", "url", "html", archive_bytes=300)).collect()}
    assert got == {1: ("response", None, 203), 3: ("revisit", 1, 203), 2: ("response", None, 1), 4: ("response", None, 1), 5: ("response", None, 0), None: ("revisit", 1, 203)}
    assert warc.read_archives(warc.write_archives(pages.limit(0), "page_id", "url", "html")).count() == 0


def test_warc_odd_tables(spark):
    long_ = "é" * 3_000_000
    pages = spark.createDataFrame([(1, "u", long_, 7, "d", "k"), (2, "u", long_, 7, "d", "k"), (2, "u", "short", 7, "d", "k"), (2, "u", "short", 7, "d", "k")], "page_id long, url string, html string, payload int, digest string, key string")
    got = Counter((r["key"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.read_archives(warc.write_archives(pages, "page_id", "url", "html")).collect())
    assert got == Counter([(1, "response", None, 6_000_000), (2, "revisit", 1, 6_000_000), (2, "response", None, 5), (2, "response", None, 5)])


# 4 quality


def test_pool_adjacent():
    assert quality.pool_adjacent(np.ones(5), np.array([0.0, 2, 1, 1, 3])) == pytest.approx([0, 4 / 3, 4 / 3, 4 / 3, 3])
    assert len(quality.pool_adjacent(np.zeros(0), np.zeros(0))) == 0


def test_quality(spark):
    rng = random.Random(0)
    good = lambda: ". ".join(" ".join(rng.choice("lorem ipsum dolor sit amet elit sed do".split()) for _ in range(9)).capitalize() for _ in range(6))
    bad = lambda: "!! ".join(rng.choice(["BUY", "NOW", "WIN"]) for _ in range(50))
    rows = [(i, good() if i % 3 else bad()) for i in range(300)] + [(1000, None), (1001, ""), (None, good())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)] + [(1000, None), (7777, 1)], "doc_id long, quality int")
    got = quality.score_documents(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    for r in got:
        if r["held_out"] and r["doc_id"] < 300:
            assert (r["score"] >= 0.3) == (r["doc_id"] % 3 > 0)
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_quality_without_labels(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.score_documents(docs, none).collect()} == {0.5}
    assert quality.score_documents(empty, none).count() == 0


def test_fourier_features_approximate_the_kernel():
    rng = np.random.default_rng(3)
    d, k, width = 4, 4096, 1.0
    model = quality.Model(np.zeros(d), np.ones(d), rng.normal(size=(d, k)) / (width * np.sqrt(d)), rng.uniform(0, 2 * np.pi, k), np.zeros(k + d + 1), (np.zeros(2), np.zeros(2)))
    x = rng.normal(size=(30, d))
    z = model.expand(x)[:, :k]
    gauss = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / (2 * d * width**2))
    assert np.abs(z @ z.T - gauss).max() < 0.1


def test_summed_equations_equal_a_dense_solve(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in rng.normal(size=len(quality.NAMES))], int(rng.integers(2))) for i in range(400)]
    train = spark.createDataFrame(rows, "doc_id long, stats array<double>, y int").repartition(5)
    model = quality.fit(train, "doc_id", "y", ridge=1e-2)
    stats, y = np.array([r[1] for r in rows]), np.array([r[2] for r in rows], float)
    assert model.mean == pytest.approx(stats.mean(axis=0)) and model.scale == pytest.approx(stats.std(axis=0))
    x = model.expand(stats)
    dense = np.linalg.solve(x.T @ x + 1e-2 * len(y) / 100 * np.eye(x.shape[1]), x.T @ y)
    assert model.weights == pytest.approx(dense, abs=1e-6)
    assert np.all(np.diff(model.steps[1]) >= 0)


def test_keep_good_keeps_rows_as_they_are(spark, docs, empty):
    labels = docs.select("doc_id", F.col("text").rlike("passage|changed").cast("int").alias("quality"))
    scores = {r["doc_id"]: r["score"] for r in quality.score_documents(docs, labels).collect()}
    wide = docs.withColumn("stats", F.lit("mine"))
    kept = quality.keep_good(wide, labels, 0.3)
    assert kept.columns == wide.columns
    assert Counter(tuple(r) for r in kept.collect()) == Counter(tuple(r) for r in wide.collect() if scores[r["doc_id"]] >= 0.3)
    assert quality.keep_good(empty, labels, 0.3).count() == 0


# 5 packing


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), min_size=1, max_size=20), st.sampled_from(["norm", "dot"]), st.sampled_from([None, 3, 5]), st.sampled_from([None, 4096, 6000]))
def test_plan(histogram, rule, documents, attention):
    made = packing.plan(histogram, 64, documents, attention, rule=rule)
    bins = defaultdict(list)
    for n, count in histogram.items():
        ranges = sorted(made.ranges[n])
        for rank in range(count):
            lo, base, each, offset = next(r for r in reversed(ranges) if r[0] <= rank)
            k = rank - lo
            bins[base + k // each].append((offset + k % each * n, n))
    for items in bins.values():
        at = 0
        for offset, n in sorted(items):
            assert offset == at
            at += n
        assert at <= 64 and len(items) <= (documents or 64) and sum(n * n for _, n in items) <= (attention or 4096)
    assert max(bins) < made.bins == len(bins)
    left = {b: rest for base, n, *rest in made.left for b in range(base, base + n)}
    assert left == {b: [64 - sum(n for _, n in items), (documents or 64) - len(items), (attention or 4096) - sum(n * n for _, n in items)] for b, items in bins.items()}


def test_each_capacity_binds():
    many = {1: 40, 8: 8}
    bins = [packing.plan(many, 64).bins, packing.plan(many, 64, documents=6).bins, packing.plan(many, 64, attention=100).bins]
    assert bins == [2, 8, 8]


def test_tokenizers_agree():
    files = queries.tokenizer_files()
    both, full = packing.Tokenizer(**files), packing.Tokenizer(files["path"])
    for t in ("", "Hello  world\n", "naïve <|endoftext|> x", "  a\u3000b\u00a0", "12 345,67", "Ωmega's 中文"):
        assert both.encode(t) == full.encode(t)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from("ab .,'\n\t0é中 "), st.characters(exclude_categories=["Cs"])), max_size=60), st.sampled_from(["", "<|endoftext|>", "<|endoftext|><|endoftext|> "]))
def test_tokenizers_agree_on_random_texts(text, special):
    files = queries.tokenizer_files()
    t = text[: len(text) // 2] + special + text[len(text) // 2 :]
    assert packing.tokenizer(**files).encode(t) == packing.tokenizer(files["path"], None, None).encode(t)


def test_packing(spark, docs, empty):
    got = packing.pack_documents(docs, "doc_id", "text", **queries.tokenizer_files(), capacity=256).collect()
    full = packing.Tokenizer(queries.tokenizer_files()["path"])
    pieces = defaultdict(list)
    bins = defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for d in docs.collect():
        ids = [*full.encode(d["text"] or ""), 2]
        own = sorted(pieces[d["doc_id"]], key=lambda r: r["piece"])
        assert [(r["start"], r["length"]) for r in own] == packing.cut(len(ids), 256)
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    total = 0
    for items in bins.values():
        at = 0
        for offset, n in sorted(items):
            assert offset == at
            at += n
        assert at <= 256
        total += at
    assert len(bins) <= -(-total // 256) * 1.15 + 1
    assert packing.pack_documents(empty, "doc_id", "text", **queries.tokenizer_files()).count() == 0


# 6 mixing


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.sampled_from([1, 2, 5])), min_size=1, max_size=8))
def test_quotas(sources):
    sizes, weights = [s for s, _ in sources], [w for _, w in sources]
    q = mixing.quotas(sizes, weights, 3)
    assert sum(q) == sum(sizes) and all(t <= 3 * s for t, s in zip(q, sizes, strict=True))
    free = {Fraction(t) / w for t, w, s in zip(q, weights, sizes, strict=True) if s and t < 3 * s}
    assert len(free) <= 1


def test_route_prefers_first_passes():
    patterns = [(("a",), 10), (("a", "b"), 10), (("b",), 5)]
    assert sum(mixing.route(patterns, {"a": 15, "b": 10}, 3)) == 25
    assert mixing.route(patterns, {"a": 15, "b": 10}, 3) == [10, 10, 5]
    assert mixing.route([(("a",), 10)], {"a": 25}, 3) == [25]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([("a",), ("b",), ("a", "b"), ("b", "c"), ("a", "b", "c")]), st.integers(1, 3)), min_size=1, max_size=3, unique_by=lambda p: p[0]), st.fixed_dictionaries({s: st.integers(0, 5) for s in "abc"}))
def test_route_is_optimal(patterns, quota):
    """Against all ways to route: as much as can be, and of those the least cost of repetition."""

    def cost(n, size):
        return sum((k // size + 1) ** 2 for k in range(n))

    best = None
    for flow in itertools.product(*(range(2 * size + 1) for _, size in patterns)):
        # Hall's condition: what patterns inside a set of sources send fits into the quotas of the set's neighbours
        if all(sum(f for f, (m, _) in zip(flow, patterns, strict=True) if set(m) <= set(some)) <= sum(quota[s] for s in some) for n in range(1, 4) for some in itertools.combinations("abc", n)):
            key = (-sum(flow), sum(cost(f, size) for f, (_, size) in zip(flow, patterns, strict=True)))
            best = min(best, key) if best else key
    got = mixing.route(patterns, quota, 2)
    assert (-sum(got), sum(cost(f, size) for f, (_, size) in zip(got, patterns, strict=True))) == best


def test_mixing_overlapping_sources(spark):
    rows = [(i, 1 + i % 4, [["a"], ["b"], ["a", "b"]][i % 3]) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, n long, members array<string>").repartition(4)
    how = {"key": "doc_id", "size": F.col("n"), "sources": F.col("members")}
    seen = []

    def quota(patterns):
        seen.extend(patterns)
        return {"a": 700, "b": 100}

    plan = mixing.plan_mix(df, quota=quota, **how)
    flows = mixing.route(seen, {"a": 700, "b": 100}, 3)
    taken = Counter()
    for r in mixing.take(df, plan, **how).collect():
        assert r["mix_taken"] % r["n"] == 0 and r["mix_taken"] <= 3 * r["n"]
        taken[tuple(r["members"])] += r["mix_taken"]
    assert sum(flows) == 800 and {m for m, _ in seen} == {("a",), ("b",), ("a", "b")}
    assert all(0 <= f - taken[m] < 4 for f, (m, _) in zip(flows, seen, strict=True))


@pytest.mark.parametrize("few", [256, 1])
def test_mixing_without_ids(spark, monkeypatch, few):
    monkeypatch.setattr(mixing, "FEW", few)
    rows = [(None, "ten words are in this text and so they count")] * 50 + [(7, "five words are in this")] * 40 + [(i, "one two three four five six") for i in range(100, 150)]
    df = spark.createDataFrame([(i, t, "s" if i is None or i == 7 else "t", 1, 2, 3) for i, t in rows], "doc_id long, text string, source string, passes int, cuts int, mix_size int")
    out, targets, (size, taken) = queries.mixed(df)
    got = out.collect()
    assert out.columns == [*df.columns, size, taken] and {r["mix_size"] for r in got} == {3} and len(got) == 140
    for s, (_, target) in targets.items():
        assert 0 <= round(target) - sum(r[taken] for r in got if r["source"] == s) < 10


def test_mixing(spark, docs, empty):
    rows, targets, _ = queries.mixed(docs)
    rows = rows.collect()
    again = Counter((r["doc_id"], r["mix_taken"]) for r in queries.mixed(docs.repartition(7))[0].collect())
    assert Counter((r["doc_id"], r["mix_taken"]) for r in rows) == again
    size, taken, least = Counter(), Counter(), defaultdict(list)
    for r in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        assert r["mix_size"] == n and r["mix_taken"] in (0, n, 2 * n, 3 * n)
        size[r["source"]] += n
        taken[r["source"]] += r["mix_taken"]
        if n and r["mix_taken"] < 3 * n:
            least[r["source"]].append(n)
    assert len(rows) == docs.count() and set(targets) == set(size)
    for s, (n, t) in targets.items():
        assert n == size[s] and 0 <= round(t) - taken[s] < max(least[s], default=1)
    assert sum(t for _, t in targets.values()) == sum(size.values())
    assert queries.mixed(empty)[0].count() == 0


# 7 URL filters


def glob_regex(pattern: str) -> re.Pattern:
    out, chars = "", iter(pattern)
    for c in chars:
        out += ".*" if c == "*" else "." if c == "?" else re.escape(next(chars) if c == "\\" else c)
    return re.compile(out, re.S)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab*?.", max_size=30), min_size=1, max_size=9), st.lists(st.text("ab.", max_size=40), max_size=9))
def test_automaton(patterns, urls):
    got = url_filter.Automaton(patterns).match([u.encode() for u in urls])
    assert got.tolist() == [[bool(glob_regex(p).fullmatch(u)) for p in patterns] for u in urls]


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://EXAMPLE.com/en/x?q#f", "https://www.example.com/en/", "http://a.www.example.com/en/1", "http://notexample.com/en/1", "http://x.net/es/1", "http://net/fr/", "http://x.net/de/", "http://example.com", "http://e.com:80/en/", "ftp://com/", "x://a*b.com/\u00e9", "http://example.com/en/1"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(None, "http://com/")], "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(df, queries.URL_RULES, "page_id").collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("example.com", "/en/x", "example.com/en/", "block") and got[14][3] == "block"
    assert got[4][2] == got[5][2] == "www.example.com/en/" and got[6][2] == "com/"
    assert got[7][2:] == ("net/es/", "block") and got[8][2] == "net/fr/" and got[9][2] is None and got[10] == ("example.com", "", None, "allow")
    assert got[11] == ("e.com:80", "/en/", None, "allow") and got[12][2] == "com/" and got[13][2] == "com/" and got[None][2] == "com/"


def test_url_rules_host_in_path(spark):
    urls = ["http://site.org/www.foo.com/x", "https://proxy.com/www.foo.net/es/a", "http://web.archive.org/web/2020/http://www.example.com/en/1", "http://foo.net/a.com/", "http://example.com/x.www.example.com/en/", "http://com.org/", "http://foo.net/es/x.com/longer/", "http://.com/"]
    got = {r["url"]: (r["host"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(spark.createDataFrame([(u,) for u in urls], "url string").selectExpr("url AS id", "url"), queries.URL_RULES, "id").withColumnRenamed("id", "url").collect()}
    hosts = ["site.org", "proxy.com", "web.archive.org", "foo.net", "example.com", "com.org", "foo.net", ".com"]
    rules = [None, "com/", None, None, "com/", None, "net/es/", "com/"]
    verdicts = ["allow", "allow", "allow", "allow", "allow", "allow", "block", "allow"]
    assert got == dict(zip(urls, zip(hosts, rules, verdicts, strict=True), strict=True))
    bare = [url_filter.Rule("foo.org", "", False)]
    df = spark.createDataFrame([(1, "http://a.foo.org"), (2, "http://foo.org.uk/"), (3, "http://x/.foo.org")], "id long, url string")
    assert {r["id"]: r["verdict"] for r in url_filter.filter_urls(df, bare, "id").collect()} == {1: "block", 2: "allow", 3: "allow"}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from(["com", "net", "example", "www", "org", "a"]), max_size=4), st.text(st.sampled_from(list("/.enfrsx")) , max_size=12), st.sampled_from(["", "com/", "x.example.com/en/", "net/es/"])), max_size=8))
def test_rules_against_a_plain_matcher(parts):
    """Hosts inside paths must not fit; the longest fitting rule wins."""
    urls = [(".".join(labels), "/" + path + tail if path or tail else "") for labels, path, tail in parts]
    hit = url_filter.Automaton([r.glob for r in queries.URL_RULES]).match([f".{h}{url_filter.END}{p}".encode() for h, p in urls])
    want = [[(h == r.host or h.endswith("." + r.host)) and p.startswith(r.path) for r in queries.URL_RULES] for h, p in urls]
    assert hit.tolist() == want


def test_url_odd_tables(spark):
    kind = "page_id long, url string, host string, verdict int, rule string"
    assert url_filter.filter_urls(spark.createDataFrame([], kind), queries.URL_RULES, "page_id").count() == 0
    long_ = "http://x.net/es/" + "y" * 100_000
    rows = url_filter.filter_urls(spark.createDataFrame([(1, long_, "h", 5, "r"), (1, long_, "h", 5, "r")], kind), queries.URL_RULES, "page_id").collect()
    assert [(r["page_id"], r["host"], len(r["path"]), r["rule"], r["verdict"]) for r in rows] == [(1, "x.net", 100_004, "net/es/", "block")] * 2


# 8 n-gram Jaccard


def brute_groups(docs, n=5, percent=80):
    sets = {}
    for k, t in docs.items():
        w = (t or "").encode().lower().split()
        sets[k] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {k: (len(s), find(k)) for k, s in sets.items()}


@pytest.mark.parametrize(("crowd", "frequent", "hot", "cell"), [(8, 1 << 17, 4096, 2048), (2, 40, 3, 2), (1, 1, 2, 1), (2, 1 << 17, 2, 3)])
def test_jaccard(spark, docs, monkeypatch, crowd, frequent, hot, cell):
    for name, value in (("CROWD", crowd), ("FREQUENT", frequent), ("HOT", hot), ("CELL", cell), ("MEMBERS", cell)):
        monkeypatch.setattr(jaccard, name, value)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(docs, "doc_id", "text").collect()}
    assert got == brute_groups({r["doc_id"]: r["text"] for r in docs.collect()})


def test_jaccard_odd_rows(spark, empty):
    assert jaccard.join(empty, "doc_id", "text").count() == 0
    near = " ".join(f"w{i}" for i in range(60))
    texts = [(2, "a b c d e f"), (2, "a b c d e f"), (1, "A B C D E F"), (None, "a b c d e f"), (3, None), (None, None), (None, near + " x"), (None, near), (9, "other text"), (9, near + " y"), (None, "alone")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    rows = [tuple(r) for r in jaccard.join(df, "doc_id", "text").collect()]
    assert Counter(rows) == Counter([(1, 2, 1), (2, 2, 1), (2, 2, 1), (None, 2, 1), (3, 0, 3), (None, 0, None), (None, 57, 9), (None, 56, 9), (9, 1, 9), (9, 57, 9), (None, 1, None)])


def test_jaccard_crowds(spark):
    """Groups of near copies of different sizes around shared words, with every path for crowds in use."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for group in range(12):
        base = words[group * 5 : group * 5 + 60 + group * 3]
        for _ in range(15):
            own = list(base)
            for _ in range(rng.randrange(6)):
                own[rng.randrange(len(own))] = rng.choice(words)
            texts.append(" ".join(own[: len(own) - rng.randrange(8)]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    for hot, cell in ((4096, 2048), (5, 4)):
        with pytest.MonkeyPatch.context() as m:
            for name, value in (("OFFER", 2), ("HOT", hot), ("CELL", cell), ("MEMBERS", 3)):
                m.setattr(jaccard, name, value)
            got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(df, "doc_id", "text").collect()}
        assert got == brute_groups(dict(enumerate(texts)))


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=60), st.sets(st.integers(0, 2**64 - 1), max_size=600))
def test_signatures_bound_the_difference(one, two):
    bits = [jaccard.signature(np.array(sorted(x), np.uint64)) for x in (one, two)]
    assert jaccard.differ(*bits) <= len(one ^ two) and jaccard.differ(bits[0], bits[0]) == 0
    assert jaccard.differ(bits[0], jaccard.folded(np.frombuffer(bits[1], np.uint8), jaccard.BRIEF).tobytes()) <= len(one ^ two)


def test_segments_part_the_set():
    s = np.unique(np.random.default_rng(1).integers(0, 2**64 - 1, 500, dtype=np.uint64))
    order = jaccard.Order(s[::7].copy(), np.arange(len(s[::7])))
    parts = order.segments(s)
    assert len(parts) == jaccard.FRAGMENTS and sorted(np.concatenate(parts).tolist()) == s.tolist() and set(parts[-1].tolist()) == set(s[::7].tolist())


# 9 PII


def luhn_number(prefix: str) -> str:
    for d in "0123456789":
        digits = [int(c) for c in prefix + d]
        if sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(reversed(digits))) % 10 == 0:
            return prefix + d
    raise AssertionError


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_pii(t):
    out = []
    for kind, p in BASE.items():
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 13 <= len(d) <= 19 and luhn_number(d[:-1]) == d if len(d) > 1 else False, "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_pii(spark):
    rng = random.Random(4)
    bits = ["a@b.com", "x.y@c-d.e.f", "@", "a@b", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "00001.2.3.255", luhn_number("400000000000000"), luhn_number("4000 0000 0000 000".replace(" ", "")), "4000-0000 00000000", "+1 (555) 555-7713", "+44 20 7946 0958.", "+1", "++12", "é", "🙂", " ", "-", "12", "a@b.com_c@d.org", "\n", "GB82WEST12345698765432", "9" * 40]
    texts = ["".join(rng.choices(bits, k=rng.randrange(0, 12))) for _ in range(400)] + [None, "", "a" * 200000, "9" * 100000, "a.b@" * 20000, "1 " * 50000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = pii.find_pii(df)
    got = {r["doc_id"]: r["b"] for r in found.select("doc_id", pii.joined(F.filter("pii_spans", lambda s: s["base"])).alias("b")).collect()}
    assert {i: brute_pii(t or "") for i, t in enumerate(texts)} == got


def test_pii_added_and_redacted(spark):
    a, b = luhn_number("411111111111111"), luhn_number("550000000000000")
    rows = [("card numbers " + a + " " + b,), ("numbers " + a + " " + b,), ("GB82 WEST 1234 5698 7654 32 and GB82 WEST 1234 5698 7654 33",), ("pay to iban GB82WEST12345698765432 now",), ("GB82WEST12345698765433",), (None,), ("plain 🙂",), ("mail a@b.com and 🙂 +1 (555) 555-7713!",)]
    df = pii.find_pii(spark.createDataFrame(rows, "text string").withColumn("i", F.monotonically_increasing_id()))
    got = [(pii_, t) for pii_, t, _ in sorted(((tuple((s["kind"], s["base"]) for s in r["pii_spans"]), r["text"], r["i"]) for r in pii.redact(df).collect()), key=lambda x: x[2])]
    assert got == [
        ((("card", False), ("card", False)), "card numbers [CARD] [CARD]"),
        ((), "numbers " + a + " " + b),
        ((("iban", False),), "[IBAN] and GB82 WEST 1234 5698 7654 33"),
        ((("iban", False),), "pay to iban [IBAN] now"),
        ((), "GB82WEST12345698765433"),
        ((), None) if got[5][1] is None else ((), ""),
        ((), "plain 🙂"),
        ((("email", True), ("phone", True)), "mail [EMAIL] and 🙂 [PHONE]!"),
    ]


def test_pii_odd_tables(spark, empty):
    assert pii.redact(pii.find_pii(empty)).count() == 0
    df = spark.createDataFrame([("a@b.com", 1, 2), ("a@b.com", 1, 2)], "text string, _pii_spans_email int, score int")
    rows = pii.redact(pii.find_pii(df)).collect()
    assert [(r["text"], r["_pii_spans_email"], r["score"], len(r["pii_spans"])) for r in rows] == [("[EMAIL]", 1, 2, 1)] * 2


def test_pii_is_native(spark, docs):
    plan = pii.redact(pii.find_pii(docs.drop("pii_spans")))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# 10 top-k


@pytest.mark.parametrize("k", [1, 3, 20])
def test_topk(spark, monkeypatch, k):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    monkeypatch.setattr(topk, "TILE_ROWS", 5)
    monkeypatch.setattr(topk, "RESIDENT", 11)
    rng = random.Random(k)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.1, 0.9, 3.0]) for _ in range(rng.choice([3, 4]))]) for i in range(40)]
    rows.append((120, []))
    odd = [(100, None), (140, [1.0, None]), (160, [float("nan")]), (180, [float("inf")]), (None, [1.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").repartition(3)
    ints = topk.integer_vectors(df, "vec_id", "embedding", 64)
    got = defaultdict(list)
    for r in topk.search(ints.filter("id % 5 = 0"), ints, k).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    q = {i: [int(np.floor(64 * np.float64(np.float32(x)))) for x in v] for i, v in rows}
    for i in [*range(0, 40, 5), 120]:
        best = sorted((-sum(a * b for a, b in zip(q[i], q[j], strict=False)), j) for j in q if j != i)[:k]
        assert sorted(got.pop(i)) == [(n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert not got
    assert topk.search(ints.limit(0), ints, k).count() == 0 and topk.search(ints, ints.limit(0), k).count() == 0


def test_topk_repeated_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (0, [1.0]), (1, [1.0]), (1, [1.0])], "vec_id long, embedding array<float>")
    ints = topk.integer_vectors(df, "vec_id", "embedding", 64)
    rows = topk.search(ints.filter("id = 0").distinct(), ints, 20).collect()
    assert [(r["vec_id"], r["score"]) for r in rows] == [(1, 4096), (1, 4096)]


@pytest.mark.parametrize("size", [1, 2**11, 2**26, 2**29])
def test_topk_kinds_are_exact(size):
    """Scores beyond 2**24 and 2**53, with ties, own ids and repeated ones, against Python's integers."""
    rng = random.Random(size)
    rows = [[rng.randrange(-size, size + 1) for _ in range(5)] for _ in range(60)] * 2
    ids = [rng.randrange(100) for _ in rows]
    held = topk.Resident([(np.array(ids[a:b], np.int64), np.array(rows[a:b], np.int64)) for a, b in ((0, 50), (50, 120))])
    j, p, s = held.best(np.array(ids[:30], np.int64), np.array(rows[:30], np.int64), 7)
    for n in range(30):
        want = sorted((-sum(a * b for a, b in zip(rows[n], r, strict=True)), i) for i, r in zip(ids, rows, strict=True) if i != ids[n])[:7]
        assert sorted((-int(x), int(held.ids[y])) for x, y in zip(s[j == n], p[j == n], strict=True)) == want


def test_topk_rate():
    """A block of queries passes resident candidates several times faster than 64-bit integers are added up term by term."""
    rng = np.random.default_rng(1)
    m = np.floor(rng.standard_normal((32768, 64)) * 8).astype(np.int8)
    held, queries = topk.Resident([(np.arange(len(m)), m)]), m[:512]
    began = time.process_time()
    j, p, s = held.best(np.arange(512), queries, 20)
    took = time.process_time() - began
    weights, postings, scores = queries.astype(np.int64), m[:4096].T.astype(np.int64), np.zeros((512, 4096), np.int64)
    began = time.process_time()
    for t in range(64):
        scores += weights[:, t, None] * postings[t]
    assert took < (time.process_time() - began) * len(m) / 4096 / 3
    first = p < 4096
    assert (scores[j[first], p[first]] == s[first]).all()


def test_topk_one_block_a_task(spark, monkeypatch):
    """Blocks by hash shared tasks while other tasks had none."""
    monkeypatch.setattr(topk, "RESIDENT", 64)
    ints = spark.range(1000).selectExpr("id", "array(id % 7, id % 11) AS ints").repartition(3)
    dealt = topk.deal(ints.filter("id % 20 = 0"), ints, 16).withColumn("task", F.spark_partition_id())
    rows = dealt.filter("kind = 0").groupBy("task").agg(F.count_distinct("block").alias("blocks"), F.sum(F.length("ids") / 8).alias("n")).collect()
    assert len(rows) == 16 and all(r["blocks"] == 1 and 58 <= r["n"] <= 66 for r in rows)
    assert {(r["task"], r["n"]) for r in dealt.filter("kind = 1").groupBy("task").agg(F.sum(F.length("ids") / 8).alias("n")).collect()} == {(t, 50) for t in range(16)}
