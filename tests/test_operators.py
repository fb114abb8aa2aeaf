"""Linkage, consensus, containers, sources, exports and streaming on small inputs."""

import json
import math
import random
import time

import pytest
from pyspark.sql import functions as F

from citeloom.catalog import Catalog
from citeloom.functions import text
from citeloom.operators import browse, consensus, containers, coverage, export, linkage, search, views
from citeloom.operators.components import connected_components
from citeloom.sources import csl, markup

NOW = "2024-01-01T00:00:00Z"
RECORDS = [
    {"_id": "a1", "type": "article-journal", "title": ["A new spider"], "container-title": "Acta Arachnologica", "volume": "12", "page": "18-23", "issued": {"date-parts": [[1997, 2]]}, "DOI": "10.1/A", "author": [{"family": "Roth", "given": "L"}], "ISSN": "0001-5202"},
    {"_id": "a2", "title": "A new spider", "container-title": ["Acta Arachnologica"], "volume": 12, "page": "18–23", "issued": {"date-parts": [["1997"]]}, "DOI": "10.1/a", "author": [{"family": "Roth", "given": "Louis"}], "is-referenced-by": [{"DOI": "10.9/x"}, {"DOI": "10.9/x"}]},
    {"_id": "b1", "title": "On beetles", "container-title": "Zootaxa", "volume": "12A", "page": "7", "issued": "1997 (printed)", "author": [{"literal": "Smith, J."}], "reference": [{"key": "r1", "unstructured": "Some text"}]},
    {"id": "12345", "title": "Without an id", "link": [{"content-type": "application/pdf", "URL": "http://x/y.pdf"}]},
]


@pytest.fixture(scope="module")
def works(spark):
    lines = [json.dumps(r) for r in RECORDS] + ["", "not json", '{"broken": ']
    docs = csl.parse_lines(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert docs.filter("bad").count() == 2
    return csl.works(docs, "test", "csl", NOW).cache()


def test_records(works):
    rows = {r["_id"]: r for r in works.collect()}
    assert rows["a1"]["title"] == rows["a2"]["title"] == "A new spider"
    assert rows["a2"]["volume"] == "12" and rows["a1"]["issued"]["month"] == 2 and rows["a2"]["issued"]["year"] == 1997 and rows["b1"]["issued"]["year"] == 1997
    other = next(r for k, r in rows.items() if len(k) == 32)
    assert other["title"] == "Without an id" and other["pdf"] == "http://x/y.pdf" and other["cluster"] == other["_id"]
    assert rows["a1"]["ISSN"] == ["0001-5202"]


def test_array_file(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(RECORDS[:2]))
    (tmp_path / "b.json").write_text('{"no": "array"}')
    rows = csl.read_array(spark, str(tmp_path)).collect()
    assert sorted(r["bad"] for r in rows) == [False, False, True]
    assert csl.walk(spark, str(tmp_path)).count() == 2


def test_linkage(works):
    pairs = linkage.ladder_pairs(works)
    assert [(r["a"], r["b"], r["tier"]) for r in pairs.collect()] == [("a1", "a2", 1)]
    got = linkage.compare(pairs, works, 3).first()
    assert got["features"] == [1, 0, 1, 0, 1, 0, 1, 0, 0, 0, 1, 0, 1, 0, 0, 0, 0, 0, 1, 0] and got["match"] and got["score"] == 7
    clusters = {r["_id"]: r["cluster"] for r in linkage.cluster(works, pairs).collect()}
    assert clusters["a1"] == clusters["a2"] == "a1" and clusters["b1"] == "b1"
    never = pairs.select("a", "b")
    assert {r["cluster"] for r in linkage.cluster(works, pairs, never=never).collect()} == {r["_id"] for r in works.collect()}


def test_hash_views(works):
    rows = {r["_id"]: (r["year"], r["volume"], r["page_first"]) for r in views.work_hash(works).collect()}
    assert rows == {"a1": (1997, 12, 18), "a2": (1997, 12, 18), "b1": (1997, 12, 7)}


@pytest.mark.parametrize("seed", range(4))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)] + [(7, 7)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


FOLDS = [(["F. Naggs", "FRED NAGGS"], "F. Naggs", [0.5, 0.5]), (["A", "B", "B"], "B", [0.2, 0.8]), (["A"] * 5 + ["B"] * 9, "A", [1.0, 0.0]), (["A", "B", "C"], "C", [0.33, 0.33, 0.34]), (["A", "B", "C", "C"], "C", [0.1, 0.1, 0.8]), (["x", None, "y", "y"], "y", [0.2, 0.8]), (["07", "7"], "07", [1.0])]


@pytest.mark.parametrize(("votes", "winner", "beliefs"), FOLDS)
def test_beliefs(spark, votes, winner, beliefs):
    df = spark.createDataFrame([(votes,)], "v array<string>").select(consensus.unique(F.col("v")).alias("u"), consensus.belief(F.col("v")).alias("b"))
    r = df.select(consensus.winner(F.col("u"), F.col("b")).alias("w"), "b").first()
    assert r["w"] == winner and r["b"] == pytest.approx(beliefs)


def test_consensus_record(works):
    merged = works.filter("_id IN ('a1', 'a2')").withColumn("cluster", F.lit("a1"))
    r = consensus.consensus(merged).first()
    assert (r["title"], r["volume"], r["DOI"], r["issued"]["year"], r["page_warning"]) == ("A new spider", "12", "10.1/a", 1997, True)
    assert r["author"][0]["family"] == "Roth" and r["members"] == ["a1", "a2"] and r["is_referenced_by"] == ["10.9/x", "10.9/x"]


def test_log_and_queue(spark, works):
    new = spark.createDataFrame([("a1", f"x{i}", i, "no-match", f"2024-01-0{i}") for i in range(1, 8)], "a string, b string, score int, decision string, at string")
    old = spark.createDataFrame([], "id string, other string, score int, decision string, at string")
    log = {r["id"]: [c["at"] for c in r["comparisons"]] for r in linkage.comparison_log(old, new).collect()}
    assert log["a1"] == [f"2024-01-0{i}" for i in range(3, 8)] and log["x1"] == ["2024-01-01"]
    seen = linkage.mark_visited(works, works.filter("_id = 'a1'"), NOW)
    assert [r["_id"] for r in views.queue(seen).collect()][-1] == "a1"
    assert linkage.drain(seen, NOW).count() == works.count() - 1


def names(spark, raws):
    return containers.keyed(spark.createDataFrame([(i, r, s) for i, (r, s) in enumerate(raws)], "id long, raw string, issn string"))


def brute_runs(rows):
    from citeloom.functions.similarity import token_lcs

    out, k, before = {}, 0, None
    for r in sorted((r for r in rows if r["key_a"]), key=lambda r: (r["key_a"], r["normalized"], r["id"])):
        k += before is None or token_lcs(before, r["tokens"]) < 0.5
        out[r["id"]], before = k, r["tokens"]
    return out


def test_runs(spark):
    rng = random.Random(3)
    words = ["acta", "arachnologica", "zoologica", "boletin", "botanica", "annals", "museum", "paris"]
    df = names(spark, [(" ".join(rng.choices(words, k=rng.randint(1, 4))), None) for _ in range(300)] + [("-", None), ("...", None)]).repartition(7)
    got = {r["id"]: r["cluster_id"] for r in containers.runs(df).collect()}
    want = brute_runs(df.collect())
    assert {k: got[k] for k in want} == want
    rest = [v for k, v in got.items() if k not in want]
    assert len(set(rest)) == 2 and min(rest) > max(want.values())


def test_block_union_and_documents(spark):
    df = names(spark, [("Acta Arachnologica", "1"), ("Acta Archnologica", None), ("Boletin Botanica", "2"), ("Zeta Journal", "2"), ("Acta Arachnologica", None), ("- 7", None)])
    df = df.withColumn("cluster_id", F.col("id") + 10)
    got = {r["id"]: r["cluster_id"] for r in containers.block_union(df).collect()}
    assert got[0] == got[4] and got[2] == got[3] and got[0] != got[2]
    docs = {r["_id"]: r for r in containers.container_docs(df.withColumn("cluster_id", F.when(F.col("id") == 4, 10).otherwise(F.col("cluster_id"))), "1").collect()}
    assert docs["container:acta-arachnologica"]["variants"] == ["Acta Arachnologica"] and docs["container:7"]["junk"]
    reserved = spark.createDataFrame([("container:zeta-journal",), ("container:zeta-journal-2",)], "_id string")
    ids = {r["_id"] for r in containers.container_docs(df, "1", reserved=reserved).collect()}
    assert "container:zeta-journal-3" in ids


def test_catalog(spark, works):
    docs = spark.createDataFrame([("container:a", "Acta", ["1"], ["Acta Arachnologica", "Acta"], "1", False, False)], "_id string, name string, ISSN array<string>, variants array<string>, cluster_run string, junk boolean, curated boolean")
    c = Catalog(works, docs)
    assert c.record("a1").count() == 1 and c.records("a1|b1").count() == 2 and c.by_doi("https://doi.org/10.1/A").count() == 2
    assert c.resolve("Acta").first()["_id"] == "container:a" and c.works_by_container("container:a").count() == 2
    assert [r["text"] for r in c.unstructured("b1").collect()] == ["Some text"]
    assert c.search("new spider").count() == 2 and c.search("").count() == 0
    assert c.features("a1", "a2").first()["match"] and c.features("a1", "zz").count() == 0
    assert [r["_id"] for r in c.containers("A").collect()] == ["container:a"]
    assert c.volumes(1997).first()["volume"] == 12 and c.works_by_volume(1997, 12).count() == 3
    assert c.export(c.works_by_title("Acta Arachnologica"), "bibtex").count() == 2


def test_exports(works):
    r = works.filter("_id = 'a1'").select(export.ris().alias("ris"), export.ris_view().alias("view"), export.openurl().alias("url"), export.tsv().alias("tsv"), export.bibtex().alias("bib"), export.csl_json().alias("csl")).first()
    assert r["ris"].startswith("TY  - JOUR\r\nAU  - Roth, L\r\nPY  - 1997\r\nTI  - A new spider\r\n") and r["ris"].endswith("SN  - 0001-5202\r\nER  - \r\n\r\n")
    assert "SP  - 18\nEP  - 23\n" in r["view"] and "rft.jtitle=Acta+Arachnologica" in r["url"] and len(r["tsv"].split("\t")) == 16
    assert r["bib"].startswith("@article{a1,\n  author = {Roth, L},") and json.loads(r["csl"])["container-title"] == "Acta Arachnologica"


def test_coverage(works):
    asked = coverage.citations(works)
    got = coverage.reconcile(asked, lambda qs: [("m", q, 0.9) if "spider" in q else None for q in qs], "c", NOW)
    s = coverage.summary(got).first()
    assert (s["checked"], s["matched"], s["gaps"], s["percent"], s["middle"]) == (4, 2, 2, 50.0, 0.9)
    assert coverage.upsert(got, got.withColumn("cid", F.lit("d"))).select("cid").distinct().first()["cid"] == "d"


JATS = """<?xml version="1.0"?><!DOCTYPE article PUBLIC "x" "y.dtd"><article xmlns:xlink="http://www.w3.org/1999/xlink"><front><article-meta><article-id pub-id-type="doi">10.5555/example.5.77</article-id></article-meta></front>
<back><ref-list><ref id="B16"><mixed-citation><person-group><name name-style="western"><surname>Marlowe</surname><given-names>WH</given-names></name></person-group> (<year>1856</year>) <ext-link ext-link-type="doi" xlink:href="10.5555/older.1856">x</ext-link></mixed-citation></ref>
<ref id="B2"><element-citation><source>A book</source><publisher-name>P</publisher-name><fpage>1</fpage><lpage>9</lpage></element-citation></ref></ref-list></back></article>"""


def test_jats(spark):
    rows = {r["_id"]: r for r in markup.parse_jats(spark.createDataFrame([(JATS,), ("junk",), (None,)], "value string")).collect()}
    r = rows["https://doi.org/10.5555/example.5.77#B16"]
    assert (r["author"][0]["family"], r["author"][0]["given"], r["year"], r["DOI"], r["title"], r["type"]) == ("Marlowe", "W H", 1856, "10.5555/older.1856", None, "article-journal")
    b = rows["https://doi.org/10.5555/example.5.77#B2"]
    assert (b["type"], b["title"], b["container_title"], b["page"]) == ("book", "A book", None, "1-9")


def test_html_text_and_names(spark, tmp_path):
    html = '<meta name="citation_doi" content="10.1/X"><meta name="citation_reference" content="One ref"><meta name="citation_reference" content="&lt;p class=HeadingRunIn&gt;A&lt;/p&gt;&lt;p class=HeadingRunIn&gt;B&lt;/p&gt;"><title>T</title><a href="/l">x</a>'
    got = markup.html_references(spark.createDataFrame([(html,), (None,)], "html string")).orderBy("row").collect()
    assert [(r["parent"], r["text"]) for r in got] == [("https://doi.org/10.1/x", t) for t in ("One ref", "A", "B")]
    assert markup.page_parts(html)["links"] == ["/l"]
    (tmp_path / "refs.txt").write_text("First\n\nSecond\n")
    assert sorted(r["_id"] for r in markup.text_references(spark, str(tmp_path / "refs.txt"), "10.1/x").collect()) == ["refs.txt#row=0", "refs.txt#row=2"]
    (tmp_path / "n.tsv").write_text("Acta\t0001\n\nZootaxa\t\nBare\n")
    assert sorted((r["raw"], r["issn"]) for r in markup.read_names(spark, str(tmp_path / "n.tsv")).collect()) == [("Acta", "0001"), ("Bare", None), ("Zootaxa", None)]


def test_upsert(spark):
    old = spark.createDataFrame([("a", 1, "2"), ("b", 1, "2")], "_id string, v int, modified string")
    new = spark.createDataFrame([("a", 2, "2"), ("a", 3, "1"), ("c", 4, "0")], "_id string, v int, modified string")
    assert {r["_id"]: r["v"] for r in csl.upsert(old, new).collect()} == {"a": 2, "b": 1, "c": 4}
    assert {r["_id"]: r["v"] for r in csl.upsert(old, new, force=False).collect()} == {"a": 1, "b": 1, "c": 4}


def test_browse(spark, works):
    merged = works.withColumn("cluster", F.when(F.col("_id") == "a2", "a1").otherwise(F.col("cluster")))
    rows = {(r["outer"], r["cluster"]): (r["_id"], r["cluster_size"]) for r in browse.envelope(views.live(merged), F.col("issued.year")).collect()}
    assert rows[1997, "a1"] == ("a1", 2)
    assert {r["cluster"]: r["n"] for r in browse.citation_counts(merged).collect()} == {"a1": 2}
    assert search.query_words(" The  of the ") == ["the", "of"]


def test_streaming(spark, works, tmp_path):
    from citeloom.streaming.incremental import Worker

    worker = Worker(spark, str(tmp_path / "store"))
    plain = works.drop("raw") if "raw" in works.columns else works
    for i, name in enumerate(("a2", "b1", "a1")):
        plain.filter(F.col("_id") == name).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(plain.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    worker.start(stream, str(tmp_path / "check")).awaitTermination(120)
    assert {r["_id"]: r["cluster"] for r in worker.works().collect()} == {"a1": "a1", "a2": "a1", "b1": "b1"}
    # A worker that is started anew goes on with what is there, and a batch that comes again gives the same works.
    again = Worker(spark, str(tmp_path / "store"))
    late = plain.filter(F.col("_id") == "a2").withColumn("_id", F.lit("z9"))
    again.fold(late, 3)
    assert {r["_id"] for r in again.works().collect()} == {"a1", "a2", "b1", "z9"}
    again.fold(late, 3)
    assert {r["_id"]: r["cluster"] for r in again.works().collect()}["a1"] == "a1" and again.works().count() == 4


def test_written_needs_a_shared_folder():
    from types import SimpleNamespace

    from citeloom.operators.tables import shared_dir

    unset = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: unset)))
    with pytest.raises(ValueError, match="share"):
        shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=context))


def test_entities(spark):
    raw = ["a &eacute;&#233;&#xE9; &amp;amp; &lt;b&gt;", "&notreal; &#0; & &copy;", "plain", None, "&#128512;&nbsp;x"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in raw], "x string").select(text.decode_entities(F.col("x"))).collect()]
    assert got == ["a ééé &amp; <b>", "&notreal; &#0; & ©", "plain", None, "😀\u00a0x"]


def test_titles_keep_entities_without_semicolon():
    """A title that was cut in the middle of an entity stays as it is, as in the SQL of html_titles."""
    title = lambda t: markup.page_parts(f"<title>{t}</title><a href='/l?a=1&amp;b'>x</a>")["title"]
    assert title("and&amp;&amp;&amp") == "and&&&amp" and title("x &quot") == "x &quot" and title("&#39") == "&#39" and title("&notit; &no") == "&notit; &no"
    assert title("&lt;b&gt; &eacute;&#233;&#xE9; &amp;lt; &#39;") == "<b> ééé &lt; '"
    assert markup.page_parts("<title>a &amp")["title"] == "a &amp" and markup.page_parts("<a href='/l?a=1&amp;b'>x</a>")["links"] == ["/l?a=1&b"]


def test_keys_are_made_in_steps(spark):
    """Each step once, however many steps build on it; the same keys as in one expression."""
    raws = ["Acta D'Arachnologica N.S.", "ZOOLOGY new series 4", "Ann. Mus.CIVICO &amp; Storia", "THE ALL CAPITALS", "12 3", "", None, "fourth series of the Boletin n. f. 2"]
    df = spark.createDataFrame(list(enumerate(raws)), "id long, raw string")
    keyed = containers.keyed(df)
    plan = keyed._jdf.queryExecution().optimizedPlan().toString()
    assert all(plan.count(step) == 1 for step in ("[a-zA-Z0-9 ]+", r"[A-Z]{1,20}", "^[0-9]+$")), plan
    want = df.select("id", *(c.alias(k) for k, c in text.name_keys(F.col("raw")).items()))
    assert sorted(keyed.drop("raw").collect()) == sorted(want.collect())


def test_token_lcs_of_one_way_likeness(spark):
    from citeloom.functions.similarity import same_token, token_lcs

    def brute(x, y):
        row = [0] * (len(y) + 1)
        for s in x:
            before, row = row, [0]
            for j, t in enumerate(y):
                row.append(before[j] + 1 if same_token(s, t) else max(before[j + 1], row[-1]))
        return 2 * row[-1] / (len(x) + len(y))

    rng, words = random.Random(4), "a ab abc b bc qld queensland boln boletin acta act zoo zo c cd".split()
    for _ in range(500):
        x, y = rng.choices(words, k=rng.randrange(1, 14)), rng.choices(words, k=rng.randrange(1, 80))
        assert token_lcs(" ".join(x), " ".join(y)) == brute(x, y)
    assert token_lcs("", "a") == 0 and token_lcs(None, None) == 0 and token_lcs("a b", "a b") == 1


def test_union_compares_no_pairs_of_unlike_length(spark):
    """Pairs whose lengths rule a link out never reach the alignment in Python."""
    df = names(spark, [("Acta bona" + " b" * i, None) for i in (1, 4, 12)]).withColumn("cluster_id", F.col("id"))
    assert {r["cluster_id"] for r in containers.block_union(df, keys=("key_c",), threshold=0.85).collect()} == {0, 1, 2}
    assert {r["id"]: r["cluster_id"] for r in containers.block_union(names(spark, [("Acta bona", "1"), ("Acta bona", "2"), ("Zoo", "2")]).withColumn("cluster_id", F.col("id")), keys=("key_b",), threshold=2.0).collect()} == {0: 0, 1: 1, 2: 1}


def test_token_lcs_of_long_names():
    """Twenty pairs of 1500 tokens (before: some 4 s each)."""
    from citeloom.functions.similarity import token_lcs

    rng, words, began = random.Random(8), "alpha beta gamma delta epsilon zeta kappa omega".split(), time.perf_counter()
    for _ in range(20):
        assert 0.3 < token_lcs(" ".join(rng.choices(words, k=1500)), " ".join(rng.choices(words, k=1500))) < 1
    assert time.perf_counter() - began < 5


def test_beliefs_at_a_half(spark):
    """What the sums of floats leave behind the tenth place decides no half: A and R end alike, and A came first (before: R)."""
    votes = ["A", "H", "R", "N", "D", "D", "R", "A", "A", "R"]
    r = spark.createDataFrame([(votes,)], "v array<string>").select(consensus.unique(F.col("v")).alias("u"), consensus.belief(F.col("v")).alias("b")).select(consensus.winner(F.col("u"), F.col("b")).alias("w")).first()
    assert r["w"] == "A"


def test_page_coverage_rounds_hundredths(spark):
    """Places that lie at half a hundredth of a percent are rounded as floats are in SQL (before: 33.0 for page 296955 of 900000)."""
    pages = ["0-900000", *(f"{p}-{p + 3}" for p in (296955, 323955, 332955, 341955, 5, 450000))]
    works = spark.createDataFrame([(str(i), p, "1", (1997,)) for i, p in enumerate(pages)], "_id string, page string, volume string, issued struct<year: bigint>")
    got = {r["first"]: r["left"] for r in browse.page_coverage(works).collect()}
    assert got == {p: math.floor(p * 100 / 900000 * 100 + 0.5) / 100 for p in got} and got[296955] == 32.99


def test_array_file_of_many_records(spark, tmp_path):
    """Each record without the file's text behind it: work grows with the file, not with its square."""
    records = [{"_id": f"r{i}", "title": f"A title of a record {i} " + "x" * 300} for i in range(20000)]
    (tmp_path / "a.json").write_text(json.dumps(records))
    began = time.perf_counter()
    rows = csl.read_array(spark, str(tmp_path)).select("text", "bad").collect()
    assert time.perf_counter() - began < 15 and len(rows) == 20000 and not any(r["bad"] for r in rows)
    assert {json.loads(r["text"])["_id"] for r in rows} == {f"r{i}" for i in range(20000)}
    plan = csl.read_array(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode(items" in plan and "value" not in plan[: plan.index("Generate")]


def test_arrays_of_bounded_files(spark, tmp_path):
    for n, rows in enumerate(([], [1], [1, 2, 3], [1, 2, 3, 4, 5, 6], list(range(7)))):
        path = str(tmp_path / str(n))
        export.write_arrays(spark.createDataFrame([(json.dumps({"_id": str(i)}),) for i in rows], "record string").coalesce(1), path, most=3)
        files = [json.loads(f.read_text()) for f in (tmp_path / str(n)).glob("part-*")]
        assert sorted(x["_id"] for f in files for x in f) == sorted(map(str, rows)) and all(len(f) <= 3 for f in files)
        assert csl.read_array(spark, path).filter("NOT bad").count() == len(rows)


def test_many_articles_and_pages(spark):
    """Articles and pages are no tables of their own: what a worker hands back is bounded, and an article costs what its text costs."""
    ref = '<ref id="R{i}"><element-citation><source>S</source><article-title>T{i}</article-title><year>1997a</year></element-citation></ref>'
    xml = [(f'<article><front><article-meta><article-id pub-id-type="doi">10.9/{i}</article-id></article-meta></front><back><ref-list>{ref.format(i=i)}</ref-list></back></article>',) for i in range(12000)]
    df = spark.createDataFrame(xml, "value string").coalesce(1).cache()
    df.count()
    began = time.perf_counter()
    got = {r["_id"]: (r["title"], r["year"]) for r in markup.parse_jats(df).collect()}
    assert time.perf_counter() - began < 10
    assert got == {f"https://doi.org/10.9/{i}#R{i}": (f"T{i}", 1997) for i in range(12000)}


def test_found_hands_back_bounded_batches():
    import pyarrow as pa

    schema = pa.schema([("n", pa.int64())])
    find = lambda t: [{"n": len(t)}] * (len(t) % 3)
    texts = ["x" * i for i in range(400)] + [None, "y" * 5_000_000, "z", "z"] + ["q"] * 9000
    out = list(markup._found(iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"])]), find, schema))
    assert sum(b.num_rows for b in out) == sum(len(t or "") % 3 for t in texts) and max(b.num_rows for b in out) <= markup.ROWS + 2 and len(out) >= 3


def test_letters_are_picked_out(spark):
    """What is left is what a search for all other characters would leave; long texts take a fraction of its time."""
    raws = ["a-b c\u00e9 D9", "", "\u2028 x\n", "...", None, "\U0001f600a\U0001f600 1"]
    df = spark.createDataFrame([(r,) for r in raws], "x string")
    got = df.select(text._letters(F.col("x")).alias("a"), F.regexp_replace("x", "[^a-zA-Z0-9 ]", "").alias("b")).collect()
    assert [r["a"] for r in got] == [r["b"] for r in got] == ["ab c D9", "", " x", "", None, "a 1"]
    plan = df.select(text.normalise_title(F.col("x")))._jdf.queryExecution().optimizedPlan().toString()
    assert "[^a-zA-Z0-9 ]" not in plan


def test_told_words_are_those_that_drop_stops_leaves(spark):
    raws = ["the acta of  the zoo and e v", "  and ", "theo andes 7 di van", "", None, "la"]
    got = spark.createDataFrame([(r,) for r in raws], "x string").select(text.told_words(F.col("x")).alias("a"), text.words(text.drop_stops(F.col("x"))).alias("b")).collect()
    assert [r["a"] for r in got] == [r["b"] for r in got] == [["acta", "zoo"], [], ["theo", "andes", "7"], [], None, []]
