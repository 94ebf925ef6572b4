"""Each case of the resolution rules as one clue."""

import pytest
from pyspark.sql import functions as F

from shelfmark.operators.joins import robots_rules
from shelfmark.plans.resolve import resolve
from shelfmark.schemas import as_books
from shelfmark.sources.registry import isbn_codes, sources

CATALOG = [
    ("gihyo", 1, "独習Perl", ["山田太郎"], "9784297000011"),
    ("gihyo", 2, "独習Perl 第2版", ["山田太郎"], "9784297000028"),
    ("saiensu", 1, "線形代数の基礎", ["佐藤花子"], None),
    ("saiensu", 2, "線形代数の応用", ["佐藤花子"], None),
    ("pragprog", 1, "Practical Rust", ["Ann Lee"], None),
]
BIB = [("9784297000011", "独習Perl", None), ("9784339000016", "電気回路", None), ("9784297000998", "リンク先", "https://gihyo.jp/book/x")]
CLUES = [
    (1, "978-4-297-00001-1", None, None),
    (2, "9784297000011", "独習Perl 第3版", None),
    (3, "9784297000011", "まったく別の本", None),
    (4, "9784000000000", None, None),
    (5, "9784000000000", "Practical Rust", None),
    (6, None, "線形代数", None),
    (7, None, None, "Ann Lee"),
    (8, None, "zzz", None),
    (9, None, None, None),
    (10, "12345", "Practical Rust", None),
    (11, "9784339000016", None, None),
    (12, "9784297000998", None, None),
    (13, "9784873117782", None, None),
    (14, "9784111111111", None, None),
    (15, "12345", None, None),
]


@pytest.fixture(scope="module")
def results(spark):
    catalog = as_books(spark.createDataFrame(CATALOG, "source_id string, position bigint, title string, authors array<string>, isbn string"))
    bib = spark.createDataFrame([(*b, []) for b in BIB], "isbn string, title string, store_link string, authors array<string>")
    bib = as_books(bib, "store_link")
    pages = as_books(
        spark.createDataFrame([("https://gihyo.jp/book/x", "Page X"), ("https://www.oreilly.co.jp/books/9784873117782/", "Old Book")], "url string, title string")
    )
    second = spark.createDataFrame([("9784111111111", "Second", ["Q"])], "isbn string, title string, authors array<string>")
    robots = robots_rules(spark.createDataFrame([("https://gihyo.jp", "")], "origin string, content string"), "bot")
    clues = spark.createDataFrame([(*c, None) for c in CLUES], "clue_id bigint, isbn string, title string, author string, publisher_id string")
    out = resolve(clues, bib, sources(spark), isbn_codes(spark), pages, catalog, second, robots)
    return {r.clue_id: r for r in out.collect()}


def test_one_row_per_clue(results):
    assert sorted(results) == [c[0] for c in CLUES]


@pytest.mark.parametrize(
    "clue, status, confidence, title, source, score",
    [
        (1, "matched", "high", "独習Perl", "isbn:publisher", 1.0),
        (2, "matched", "high", "独習Perl", "isbn:publisher", 0.45),
        (3, "matched", "low", "独習Perl", "isbn:publisher", 0.0),
        (4, "not_found", "low", None, "none", 0.0),
        (5, "matched", "low", "Practical Rust", "search", 1.0),
        (6, "ambiguous", "high", "線形代数の基礎", "search", 0.9),
        (7, "matched", "high", "Practical Rust", "search", 1.0),
        (8, "not_found", "low", None, "none", 0.0),
        (9, "not_found", "low", None, "none", 0.0),
        (10, "matched", "high", "Practical Rust", "search", 1.0),
        (11, "matched", "high", "電気回路", "isbn:openbd", 1.0),
        (12, "matched", "high", "Page X", "isbn:publisher", 1.0),
        (13, "matched", "high", "Old Book", "isbn:publisher", 1.0),
        (14, "matched", "high", "Second", "isbn:calil", 1.0),
        (15, "not_found", "low", None, "none", 0.0),
    ],
)
def test_case(results, clue, status, confidence, title, source, score):
    r = results[clue]
    assert (r.status, r.confidence, r.book and r.book.title, r.source, r.match_score) == (status, confidence, title, source, score)


def test_validation(results):
    v = results[2].validation
    assert (v.isbn_matches, v.isbn_title_agree, v.title_exact, v.edition_differs) == (True, True, False, False)
    assert results[3].validation.isbn_title_agree is False
    assert results[5].validation.isbn_matches is False and "9784000000000" in results[5].reason
    assert results[6].validation.isbn_matches is None
    assert [c.book.title for c in results[6].candidates] == ["線形代数の基礎", "線形代数の応用"]
    assert results[4].reason.startswith("ISBN 9784000000000") and results[9].reason.startswith("isbn / title")
    assert results[13].book.language == "ja" and results[7].book.language == "en"
