"""Edge cases of the column expressions, one tiny frame per rule."""

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import dates, isbn, money, people, scoring, stores, text, urls


def values(spark, expr, rows, schema="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {schema}")
    return [r[1] for r in df.select("i", expr(F.col("x")).alias("y")).orderBy("i").collect()]


def test_match_key(spark):
    rows = ["Ｒｕｓｔ（入門）ー 第２版", "a-b_c/d\\e|f", "\u30b5\u30fc\u30d0\u30fc", "  ", None, "ｶﾞ", "O'Reilly `x` \"y\""]
    assert values(spark, text.match_key, rows) == ["rust入門第2版", "abcdef", "\u30b5\u30d0", "", None, "\u30ac", "oreillyxy"]


def test_editions(spark):
    rows = ["独習php第4版", "増補改訂版lisp新版", "第二十刷x", "第版", "plain"]
    assert values(spark, text.strip_edition, rows) == ["独習php", "lisp", "x", "第版", "plain"]
    assert values(spark, text.has_edition, rows) == [True, True, True, False, False]


def test_bibliographic_title(spark):
    rows = ["A = B : C : D", "x:y=z", " 題\n名　 : ", "A : B = C"]
    got = [tuple(r) for r in values(spark, text.bibliographic_title, rows)]
    assert got == [("A", "C : D", "B"), ("x:y=z", None, None), ("題 名 :", None, None), ("A", "B = C", None)]


def test_titles(spark):
    assert values(spark, text.strip_format_marks, ["本【PDF版】【EPUB版】 ", "本【上】"]) == ["本", "本【上】"]
    assert values(spark, text.join_title_lines, ["【集】\n\t甲\n 乙"]) == ["甲 乙"]
    assert values(spark, text.html_block_text, ["a<br/>b<BR>c&nbsp;<b>d</b>"]) == ["a\nb\nc d"]


@pytest.mark.parametrize(
    "raw, clean, shaped",
    [
        ("978-4-00-000000-1", "9784000000001", True),
        (" ISBN 4-00-000000-x", "400000000X", True),
        ("isbnISBN4", "ISBN4", False),
        ("978400000000", "978400000000", False),
        ("9770000000000", "9770000000000", False),
    ],
)
def test_isbn(spark, raw, clean, shaped):
    assert values(spark, isbn.normalize_isbn, [raw]) == [clean]
    assert values(spark, isbn.looks_like_isbn, [raw]) == [shaped]


def test_isbn_conversion_and_search(spark):
    assert values(spark, isbn.as_isbn13, ["4-87311-778-X", "9784297128152", "bad"]) == ["9784873117782", "9784297128152", "BAD"]
    assert values(spark, lambda c: isbn.extract_isbn(c, "labelled"), ["ISBN：978-4-86354-123-4", "ISBN：978-4-86354-123-45"]) == ["9784863541234", None]
    assert values(spark, lambda c: isbn.extract_isbn(c, "any"), ["ISBN 4-87311-778-X (a)", "none"]) == ["9784873117782", None]


def test_prices(spark):
    assert values(spark, money.parse_price, ["¥3,960", "3,300円（税込）", "未定", ",", None]) == [3960, 3300, None, None, None]
    net = lambda c: money.tax_inclusive(money.parse_price(c), c, "mark")
    assert values(spark, net, ["1,999円＋税", "2000円", "2000円 税別"]) == [2198, 2000, 2200]
    label = lambda c: money.tax_inclusive(money.parse_price(c), c, "label")
    assert values(spark, label, ["300円（税抜）", "330円（税抜300円・税込）", "2,200円（本体2,000円＋税10％）"]) == [330, 330, 2200]
    assert values(spark, money.parse_usd, ["$ 1,039.95 (USD)", "$39"]) == [Decimal("1039.95"), None]


@pytest.mark.parametrize(
    "family, raw, want",
    [
        ("kanji", "2026年3月5日", date(2026, 3, 5)),
        ("slash", "発売 2026/2/20", date(2026, 2, 20)),
        ("slash_padded", "2026/2/20", None),
        ("dot_padded", "2026.02.20", date(2026, 2, 20)),
        ("dot", "2025.9.29", date(2025, 9, 29)),
        ("iso", "(2002-02-01)", date(2002, 2, 1)),
        ("iso", "2002-13-01", None),
        ("kanji_month", "2020年5月発売", date(2020, 5, 1)),
        ("english_month", "Published: July 2026", date(2026, 7, 1)),
        ("english_month", "Published: Foo 2026", None),
        ("compact", "20240115", date(2024, 1, 15)),
        ("compact", "2024-01", date(2024, 1, 1)),
        ("compact", "2024", None),
        ("volume", "2024", date(2024, 1, 1)),
        ("volume", "2024-07", date(2024, 7, 1)),
    ],
)
def test_dates(spark, family, raw, want):
    assert values(spark, lambda c: dates.parse_date(c, family), [raw]) == [want]


def test_people(spark):
    assert values(spark, people.strip_role_word, ["山田　著 ", "監修", "Bob 訳"]) == ["山田", "", "Bob"]
    assert values(spark, people.format_person_name, ["Knuth, Donald, 1938-", "結城, 浩", "A  B", ""]) == ["Donald Knuth", "結城 浩", "A B", ""]
    english = lambda c: people.split_authors(c, "english")
    assert values(spark, english, ["A B with C D, E, and F"]) == [["A B", "C D", "E", "F"]]


def test_dedupe_is_idempotent(spark):
    rows = [["吉川 邦夫", "吉川邦夫", " ", "Ｂｏｂ", "bob", "※・"], [], None]
    once = values(spark, people.dedupe_authors, rows, "array<string>")
    assert once == [["吉川 邦夫", "Ｂｏｂ", "※・"], [], None]
    assert values(spark, people.dedupe_authors, once, "array<string>") == once


def test_stores(spark):
    name = lambda c: stores.classify_store(c)["name"]
    rows = ["https://tatsu-zine.com/books/a", "https://tatsu-zine.com/books/pub/a", "https://www.amazon.co.jp/dp/X", "https://e.org"]
    assert values(spark, name, rows) == ["達人出版会", None, "Kindle", None]
    assert values(spark, stores.extract_asin, ["amazon.co.jp/dp/4000000000 amazon.co.jp/o/ASIN/B000000001", "no"]) == ["B000000001", None]


def test_urls(spark):
    base = F.lit("https://a.example/b/c?x#y")
    rows = ["../d", "/e/./f", "//g.example/h", "?q", "#z", "i", "https://j.example", "mailto:x"]
    assert values(spark, lambda c: urls.resolve_url(base, c), rows) == [
        "https://a.example/d", "https://a.example/e/f", "https://g.example/h", "https://a.example/b/c?q",
        "https://a.example/b/c?x#z", "https://a.example/b/i", "https://j.example/", "mailto:x",
    ]


def test_scores(spark):
    rows = [("メール技術 教科書", "メール技術の教科書"), ("a b c d", "xaxbx"), ("Same！", "same"), ("zz", "aa"), ("", "aa"), ("a a z", "a1")]
    df = spark.createDataFrame(rows, "q string, t string")
    keyed = df.select(text.match_key(F.col("q")).alias("q"), text.token_keys(F.col("q")).alias("k"), text.match_key(F.col("t")).alias("t"))
    got = [r[0] for r in keyed.select(scoring.title_match_score(F.col("q"), F.col("k"), F.col("t"))).collect()]
    assert got == [0.9, 0.45, 1.0, 0.0, 0.0, 0.9 * (2 / 3)]


def test_grades(spark):
    assert values(spark, scoring.confidence, [0.9, 0.5, 0.499], "double") == ["high", "medium", "low"]
    pairs = spark.createDataFrame([(0.6, 0.5), (0.9, 0.85), (1.0, 1.0), (0.4, 0.4), (0.9, None)], "b double, s double")
    got = [r[0] for r in pairs.select(scoring.is_ambiguous(F.col("b"), F.col("s"))).collect()]
    # 0.6 - 0.5 is a little below 0.1 in floating point.
    assert got == [True, True, False, False, False]
