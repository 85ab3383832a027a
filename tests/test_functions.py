"""Golden values of the text functions."""

import pytest
from pyspark.sql import functions as F

from biblyst.functions import text as T
from biblyst.functions.vector import cosine_distance, usable


def one(spark, f, *args):
    schema = ", ".join(f"c{i} string" for i in range(len(args)))
    df = spark.createDataFrame([args], schema)
    return df.select(f(*[F.col(f"c{i}") for i in range(len(args))]).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [("https://doi.org/10.1257/AER.20180779", "10.1257/aer.20180779"), ("DOI: 10.3386/w12345", "10.3386/w12345"), ("10.1257/aer.100.1.1,", "10.1257/aer.100.1.1"), ("not-a-doi", None), ("", None), ("10.12/tooshortprefix", None), ("hdl:1765/12345", None), (None, None)],
)
def test_doi(spark, raw, want):
    assert one(spark, T.normalize_doi, raw) == want


@pytest.mark.parametrize(("raw", "want"), [("Basel, Switzerland", "Switzerland"), ("College Station, TX (United States)", "United States"), ("Mannheim", ""), ("", ""), (None, "")])
def test_country(spark, raw, want):
    assert one(spark, T.country, raw) == want


@pytest.mark.parametrize(("raw", "want"), [("(Minimum) Wage* Floors", "Minimum"), ("Übermäßige Bürokratie", "rokratie"), ("About After Their", "After"), ("", None)])
def test_keyword(spark, raw, want):
    assert one(spark, T.title_keyword, raw) == want


@pytest.mark.parametrize(("a", "b", "want"), [("A b, C!", "a B c", 1.0), ("x y", "z", 0.0), ("", "", 0.0), (None, "a", 0.0), ("!?", "!", 0.0)])
def test_title_sim(spark, a, b, want):
    assert one(spark, T.title_sim, a, b) == want == one(spark, T.title_sim, b, a)


def test_small_ones(spark):
    assert one(spark, T.first_author_lastname, "Dube; Lester; Reich") == "Dube"
    assert one(spark, T.first_author_lastname, "; Dube") is None
    assert one(spark, T.first_author_token, "Arindrajit Dube; X") == "dube"
    assert one(spark, lambda c: T.parse_year(c, 2026), "Forthcoming") == 2026 and one(spark, lambda c: T.parse_year(c, 2026), "1999-05") == 1999 and one(spark, lambda c: T.parse_year(c, 2026), "x") is None
    assert one(spark, T.journal_name, "The Journal of Behaviour & Banks (JBB)") == "journal of behavior and banks"
    assert one(spark, T.split_marked_list, "a||| b |||") == ["a", "b"] and one(spark, T.split_marked_list, None) == []
    assert one(spark, T.address, "RePEc:aaa:b:c", "article") == "https://ideas.example/a/aaa/b/c.html"
    assert one(spark, T.slugify, "A Big, Big Title of Seven Words!") == "a-big-big-title-of-seven"
    assert one(spark, T.guess_from_article_url, "https://www.nature.com/articles/s41586-020-2489-0") == "10.1038/s41586-020-2489-0"
    assert one(spark, T.doi_from_url, "http://x.example/10.1234/AB?c=1") == "10.1234/ab"
    assert one(spark, T.fill_bibtex_journal, "journal = {}\n\n\nx", "J") == "journal = {J}\nx"
    assert len(one(spark, T.short_hash, "a", "b")) == 8


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0]), (4, None), (5, [float("nan"), 1.0]), (6, [3.0, 4.0])], "i int, v array<float>")
    ok = df.where(usable(F.col("v"), 2))
    assert {r["i"]: round(r["d"], 6) for r in ok.select("i", cosine_distance(F.col("v"), [1, 0]).alias("d")).collect()} == {1: 0.0, 6: 0.4}
