"""Golden values of the column functions and the similarity kernels."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citeloom.functions import csl, similarity, text


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


KEYS = [
    ("Acta Arachnologica", "acta arachnologica", "", "act ara", "act ara", "act ara", "aa"),
    ("Acta Arachnologica, Osaka", "acta arachnologica osaka", "", "act ara osa", "act ara osa", "act ara osa", "aao"),
    ("Acta Arachnologica.(Tokyo)", "acta arachnologicatokyo", "", "act ara", "act ara", "act ara", "aa"),
    ("Acta aracnológica", "acta aracnologica", "", "act ara", "act ara", "act ara", "aa"),
    ("Bull. Mus. Natl. d'Hist. Nat., Paris, (sér. 2)", "bull mus natl hist nat paris", "ser 2", "bul mus nat his nat par", "bul his mus nat nat par", "bul mus nat", "bmnhnp"),
    ("Annals and Magazine of Natural History, Series 2", "annals magazine natural history", "series 2", "ann mag nat his", "ann his mag nat", "ann mag nat", "amnh"),
    ("Abhandlungen N. F. 12", "abhandlungen", "n f", "abh", "abh", "abh", "a"),
    ("Boletin Serie A (Biologia)", "boletin biologia", "serie a", "bol bio", "bio bol", "bol bio", "bb"),
    ("PNAS", "pnas", "", "pna", "pna", "pna", "p"),
    ("Časopis Slezského muzea", "asopis slezskeho muzea", "", "aso sle muz", "aso muz sle", "aso sle muz", "asm"),
    ("-", "", "", "", "", "", ""),
]


def test_name_keys(spark):
    rows = spark.createDataFrame([(k[0],) for k in KEYS], "raw string").select("raw", *(c.alias(n) for n, c in text.name_keys(F.col("raw")).items())).collect()
    got = {r["raw"]: (r["tokens"], r["series"], r["key_a"], r["key_b"], r["key_c"], r["key_d"]) for r in rows}
    assert got == {k[0]: k[1:] for k in KEYS}


@pytest.mark.parametrize(("page", "want"), [("123-45", [123, 145]), ("1234-7", [1234, 1237]), ("101–108", [101, 108]), ("7", [7, 7]), ("x", None), (None, None)])
def test_page_range(spark, page, want):
    assert one(spark, csl.page_range, page) == want


@pytest.mark.parametrize(("s", "want"), [("XLI", 41), ("iv", 4), ("MCMXCIV", 1994), ("abc", 0), ("", 0)])
def test_roman(spark, s, want):
    assert one(spark, csl.roman, s) == want


def test_small_functions(spark):
    assert one(spark, csl.volume_number, "Fasc. 62") == 62
    assert one(spark, csl.volume_number, "abc") is None
    assert one(spark, csl.clean_doi, "https://dx.doi.org/10.1/AB") == "10.1/ab"
    assert one(spark, csl.parse_int, "62A") == 62
    assert one(spark, csl.parse_int, "Fasc. 62") is None
    assert one(spark, text.folded_letter, "Évolution") == "E"
    assert one(spark, text.slug, "Acta Arachnologica") == "acta-arachnologica"
    assert one(spark, text.slug, "...") == "x"
    assert one(spark, text.unaccent, "Čaß æøé") == "Časz aeoe"
    assert one(spark, text.safe_filename, "a b/c") == "a-b-c"
    assert one(spark, lambda c: text.clean_title(c), "A <i>b</i> &amp; c.D\t e") == "A b & c. D e"


def test_first_pages_differ_by_rule(spark):
    df = spark.createDataFrame([("e12", "12-20"), (None, "101–108"), ("5", "9-10")], "f string, p string")
    rows = df.select(csl.page_first_view(F.col("f"), F.col("p")).alias("v"), csl.page_first_worker(F.col("f"), F.col("p")).alias("w")).collect()
    assert [(r["v"], r["w"]) for r in rows] == [(12, None), (101, 101), (5, 5)]


def test_authors(spark):
    df = spark.createDataFrame([([(None, None, "Smith, J.")],), ([(None, None, "J. Smith")],), ([("Roth", "L", None)],)], "a array<struct<family: string, given: string, literal: string>>")
    got = df.select(csl.parse_author(F.col("a")[0]).alias("p")).collect()
    assert [(r["p"]["family"], r["p"]["given"]) for r in got] == [("Smith", "J."), ("Smith", "J."), ("Roth", "L")]


ALIGNED = [("kaj vollesen", "kaj brge vollesen", 0.75), ("ko wanchang", "wan chang ko", 0.6364), ("abc", "xyz", 0.0), ("abc", "abc", 1.0)]


@pytest.mark.parametrize(("a", "b", "want"), ALIGNED)
def test_alignment(a, b, want):
    assert similarity.alignment_score(a, b) == pytest.approx(want, abs=0.06)


def test_alignment_of_nothing():
    assert similarity.alignment_score("", "abc") is None
    assert similarity.align("abc", "xyz").score == 0
    a = similarity.align("xxabcdyy", "zabcd")
    assert (a.spans, a.lines[1]) == (((2, 6), (1, 5)), "||||")


LCS = [("acta arachnologica", "acta arachnologica osaka", 0.8), ("acta archnologica", "acta arachnologica", 1.0), ("bulletin museum national histoire naturelle paris", "bull mus natl hist nat paris", 0.8333), ("acta zoologica", "boletin botanica", 0.0)]


@pytest.mark.parametrize(("a", "b", "want"), LCS)
def test_token_lcs(a, b, want):
    assert similarity.token_lcs(a, b) == pytest.approx(want, abs=1e-4)


@settings(max_examples=60, deadline=None)
@given(st.text("abcd ", max_size=20), st.text("abcd ", max_size=20))
def test_similarities_are_symmetric(a, b):
    assert similarity.alignment_score(a, b) == similarity.alignment_score(b, a)
    assert similarity.token_lcs(a, b) == similarity.token_lcs(b, a)
    if a.split():
        assert similarity.token_lcs(a, a) == 1


def test_udfs_and_columns(spark):
    df = spark.createDataFrame([("act ara", "act ara osa"), ("", "")], "a string, b string")
    rows = df.select(similarity.lcs(F.col("a"), F.col("b")).alias("l"), similarity.shared_prefix(F.col("a"), F.col("b")).alias("p"), similarity.alignment(F.col("a"), F.col("b")).alias("s")).collect()
    assert rows[0]["l"] == pytest.approx(0.8) and rows[0]["p"] == pytest.approx(7 / 11) and rows[0]["s"] == 1.0
    assert (rows[1]["l"], rows[1]["p"], rows[1]["s"]) == (0.0, 1.0, None)
