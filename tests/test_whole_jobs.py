"""Registered queries over whole tables: no rows left out, results as by brute force."""

import datetime
import hashlib
import html
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from citeloom.functions import similarity
from citeloom.operators import containers
from citeloom.plans.queries import QUERIES

PARTS = [(i, f"{w} thing{i % 60}", "LARGE TIN", f"Brand#{(i * i + i // 7) % 90}") for i, w in enumerate(["acta", "annals", "bulletin", "museum", "zoology"] * 40)]


@pytest.fixture(scope="module")
def parts_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("parts"))
    spark.createDataFrame(PARTS, "p_partkey long, p_name string, p_type string, p_brand string").repartition(3).write.parquet(f"{d}/part.parquet")
    return d


def brute_journals(rows):
    """rows: id, issn, normalised name."""
    journal = {issn: issn for _, issn, _ in rows}
    while True:
        before = dict(journal)
        for _, x, n in rows:
            for _, y, m in rows:
                if n == m:
                    journal[x] = journal[y] = min(journal[x], journal[y])
        if journal == before:
            return {i: journal[x] for i, x, _ in rows}


def test_journal_groups(spark, parts_dir):
    rows = [(i, brand, f"{name} {' '.join(kind)}".lower()) for i, name, kind, brand in PARTS]
    got = {r["id"]: r["journal"] for r in QUERIES["journal_groups"](spark, parts_dir).collect()}
    assert got == brute_journals(rows) and 1 < len(set(got.values())) < len({x for _, x, _ in rows})


def test_journals_of_rows_without_issn(spark):
    df = spark.createDataFrame([(1, "b", "x"), (2, "a", "x"), (3, None, "x"), (4, "c", "y"), (5, "b", "z")], "id long, issn string, normalized string")
    assert {r["id"]: r["journal"] for r in containers.journals(df).collect()} == {1: "a", 2: "a", 4: "c", 5: "a"}


def test_variant_resolution(spark, parts_dir):
    got = [(r["variant"], r["name"]) for r in QUERIES["variant_resolution"](spark, parts_dir).collect()]
    docs = QUERIES["container_docs"](spark, parts_dir).select("name", F.explode(F.split("variants", r"\|")).alias("variant")).collect()
    assert sorted(got) == sorted((r["variant"], r["name"]) for r in docs) and {v for v, _ in got} == {f"{name} {kind}" for _, name, kind, _ in PARTS}


TEXTS = [
    "The history of the <b>Museum</b> &amp; Gardens.A new &lt;part&gt;", "Étude sur les araignées de l'Œuvre.Été  \u00a0 1997", "  plain words of the land \n and sea  ", "x" * 190 + " the end of Zoölogy <i>and</i> more than two hundred &quot;signs&quot;",
    "a &amp;lt; b", "<p>only a tag</p>", "a < b and c > d", "", None, "Straße der Bücher \u2013 Þing.\u00c9", "&#39;quoted&apos; &nbsp; &ndash;&mdash;", "word " * 900 + "last.Word",
]
SPACE = "[\\x0c\\n\\r\\t\u00a0 \u1680\u180e\u2028\u2029\u2000-\u200a\u202f\u205f\u3000]+"


@pytest.fixture(scope="module")
def texts_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("texts"))
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(2).write.parquet(f"{d}/documents.parquet")
    return d


def brute_clean(t):
    t = html.unescape(re.sub("<[^>]*>", "", t).replace("&nbsp;", " "))
    return re.sub(SPACE, " ", re.sub(r"\.(.)", lambda m: ". " + m[1] if m[1].isalpha() else m[0], t))


def brute_normal(t):
    t = brute_clean(t)
    for old, new in {"Œ": "OE", "œ": "oe", "Æ": "AE", "æ": "ae", "ß": "sz", "Þ": "TH", "þ": "th"}.items():
        t = t.replace(old, new)
    t = "".join(c for c in unicodedata.normalize("NFD", t.strip(" ")) if c < "\x80")
    return re.sub("[^a-zA-Z0-9 ]", "", t).lower()


def test_clean_text(spark, texts_dir):
    got = {r["doc_id"]: r["digest"] for r in QUERIES["clean_text"](spark, texts_dir).collect()}
    assert got == {i: None if t is None else hashlib.md5(brute_clean(t).encode()).hexdigest() for i, t in enumerate(TEXTS)}


def test_tokens_normalised(spark, texts_dir):
    stops = set("and at from in of on the aus dem der das des die fur und zu zur de du et la le les del y della di van da do e v".split())
    got = {r["doc_id"]: (r["title"], r["tokens"]) for r in QUERIES["tokens_normalised"](spark, texts_dir).collect()}
    titles = {i: None if t is None else brute_normal(t) for i, t in enumerate(TEXTS)}
    assert got == {i: (t, None if t is None else " ".join(w for w in t.split() if w not in stops)) for i, t in titles.items()}


@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    """Orders of four years, some without a date, of 30 customers; the folder they are in and their rows."""
    d, rng = str(tmp_path_factory.mktemp("orders")), random.Random(5)
    rows = [(k, rng.randrange(1, 31), "FOP"[k % 3], None if k % 17 == 0 else datetime.date(1994 + rng.randrange(4), rng.randrange(1, 13), rng.randrange(1, 29)), "1-URGENT") for k in rng.sample(range(1000), 400)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate date, o_orderpriority string").repartition(5).write.parquet(f"{d}/orders.parquet")
    spark.createDataFrame([(c, f"C{c}", "BUILDING") for c in range(1, 31)], "c_custkey long, c_name string, c_mktsegment string").write.parquet(f"{d}/customer.parquet")
    return d, rows


def places(rows, key):
    return {f"urn:o:{r[0]:012d}": i for i, r in enumerate(sorted(rows, key=key), 1)}


def test_export_order(spark, orders):
    d, rows = orders
    got = QUERIES["export_order"](spark, d).collect()
    want = places(rows, lambda r: (r[3].year if r[3] else 999999, r[3].month if r[3] else 0, r[1], r[0]))
    assert {r["_id"]: r["place"] for r in got} == want and len(got) == len(rows)


def test_display_sort(spark, orders):
    d, rows = orders
    got = QUERIES["display_sort"](spark, d).collect()
    want = places(rows, lambda r: (r[3].month if r[3] else 99, r[1], r[0]))
    assert {r["_id"]: r["place"] for r in got} == want and len(got) == len(rows)


def test_best_score():
    rng = random.Random(9)
    for _ in range(400):
        a = "".join(rng.choices("abc ", k=rng.randrange(1, 90)))
        b = "".join(rng.choices("abc ", k=rng.randrange(1, 90)))
        if rng.random() < 0.6:
            i, j = sorted(rng.choices(range(len(a) + 1), k=2))
            b = "".join(rng.choices("abc ", k=rng.randrange(9))) + a[:i] + a[j:] + a[i:j]
        for band in (1, 4, 32):
            assert similarity.best_score(a, b, band) == int(similarity._matrix(a, b).max())


FAR = "filler " * 40


@pytest.fixture(scope="module")
def long_dir(spark, tmp_path_factory):
    """Texts that differ, or have the words asked for, only after 120 characters."""
    d = str(tmp_path_factory.mktemp("long"))
    rows = [(1, FAR + "the end of it"), (2, FAR + "nothing here "), (3, "the start of " + FAR), (4, "the start" + FAR), (5, None)]
    spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    return d


def test_search_of_whole_texts(spark, long_dir):
    want = {f"doc:{i:012d}" for i in (1, 3)}
    for q in ("title_search", "title_search_scores", "search_clusters"):
        assert {r["_id"] for r in QUERIES[q](spark, long_dir).collect()} == want


def test_nonletter_leads_of_whole_texts(spark, tmp_path):
    t = "1 " + FAR
    spark.createDataFrame([(1, t, "en", "s", len(t))], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert [r["value"] for r in QUERIES["nonletter_leads"](spark, str(tmp_path)).collect()] == [t]


def test_alignment_of_whole_texts(spark, long_dir):
    got = {(r["a"], r["b"]): r["score"] for r in QUERIES["alignment_feature"](spark, long_dir).collect()}
    one, two = (FAR + "the end of it"), (FAR + "nothing here")
    assert got[1, 2] == round(similarity._matrix(one, two).max() / (3 * len(two)), 6) < 1


def test_near_equal_titles_match(spark, tmp_path):
    d, day = str(tmp_path), datetime.date(1997, 2, 3)
    rows = [(1, 7, "F", day, "a rather long title of an order"), (21, 7, "F", day, "a rather long title of an ordem"), (41, 7, "F", day, "something else")]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate date, o_orderpriority string").write.parquet(f"{d}/orders.parquet")
    spark.createDataFrame([(7, "C7", "BUILDING")], "c_custkey long, c_name string, c_mktsegment string").write.parquet(f"{d}/customer.parquet")
    a, b, c = (f"urn:o:{k:012d}" for k in (1, 21, 41))
    assert {(r["a"], r["b"]): r["match"] for r in QUERIES["match_decisions"](spark, d).collect()} == {(a, b): True, (a, c): False, (b, c): False}
    bits = {(r["a"], r["b"]): r["features"].split(",")[2:4] for r in QUERIES["feature_vectors_exact"](spark, d).collect()}
    assert bits == {(a, b): ["1", "0"], (a, c): ["0", "1"], (b, c): ["0", "1"]}


def test_flagship_near_equal_containers(spark, tmp_path):
    rows = [(1, "one text", "en", "a source of texts", 8), (2, "one text", "en", "a source of text", 8), (3, "one text", "en", "elsewhere", 8)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r["name"]: r["n"] for r in QUERIES["flagship"](spark, str(tmp_path)).collect()} == {"works": 3, "clusters": 2}
