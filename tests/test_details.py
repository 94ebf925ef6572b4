"""Details from pages, feeds and listings in the catalog, and rows made of several pages."""

import json

from pyspark.sql import functions as F

from shelfmark.operators.joins import robots_rules
from shelfmark.operators.merge import merge_fields
from shelfmark.plans import details
from shelfmark.plans.catalog import catalog_from_pages
from shelfmark.plans.details import book_details_from_pages
from shelfmark.schemas import as_books
from shelfmark.sources.registry import sources

SHOP, PRESS, BOOKS, SEA = "https://www.seshop.com", "https://gihyo.jp", "https://tatsu-zine.com", "https://book.mynavi.jp/manatee/detail/id=5"


def robots(spark, text="User-agent: *\nDisallow: /secret"):
    return robots_rules(spark.createDataFrame([(PRESS, text), (SHOP, text)], "origin string, content string"), "bot")


def keyed(**entries):
    one = lambda t, url: {"series": "", "title": t, "subtitle": "", "author": {"著": {"Ann": ""}}, "price": [3000], "release": ["2024.05.06"], "url": url, "cover": ["", "", "", "/c.jpg"]}
    return json.dumps({"list": {k: one(*v) for k, v in entries.items()}})


def catalog(spark, pages):
    df = spark.createDataFrame(pages, "url string, html string, page_kind string")
    books, rejected = catalog_from_pages(df, sources(spark), robots(spark))
    return {(r.source_id, r.url): r for r in books.collect()}, {(r.url, r.reason) for r in rejected.collect()}


def test_list_rows_are_completed_from_their_detail_pages(spark):
    """Price, date and cover of the list stay; authors and ISBN come from the detail page; a lost one changes nothing."""
    item = "<div class=inner><div class=product-data data-category='電子書籍/x' data-price='2000'></div><figure><img src='/i{0}.png'></figure><div class=txt><a href='/product/detail/{0}'>Book {0}</a></div><span class=date>2024.01.02</span></div>"
    pages = [
        (f"{SHOP}/list", item.format(1) + item.format(2), "list"),
        (f"{SHOP}/product/detail/1", "<h1>Book 1 (detail)</h1><a href='/product/author/7'>Ann</a><meta name='cxenseparse:sho-isbn' content='9784798100005'><meta name='cxenseparse:sho-price' content='9999'>", "detail"),
    ]
    got, _ = catalog(spark, pages)
    one, two = got["seshop", f"{SHOP}/product/detail/1"], got["seshop", f"{SHOP}/product/detail/2"]
    assert (one.title, one.authors, one.isbn, float(one.price), str(one.published_at)) == ("Book 1", ["Ann"], "9784798100005", 2000.0, "2024-01-02")
    assert one.cover_image_url == f"{SHOP}/i1.png" and one.currency == two.currency
    assert (two.title, two.authors, two.isbn, float(two.price)) == ("Book 2", [], None, 2000.0)


def test_feeds_of_all_sources_and_bad_bodies(spark):
    volume = {"id": "x", "volumeInfo": {"title": "Vol", "authors": ["Bob"], "infoLink": "http://books.google.com/books?id=x"}, "saleInfo": {}}
    index = {"results": [{"record_type": "book", "href": "/titles/t", "title": "Prag", "author": "Cid"}]}
    edge = {"data": {"searchProducts": {"edges": [{"node": {"product": {"databaseID": "9", "name": "Zine"}}}]}}}
    pages = [
        (f"{PRESS}/api_gh/site/search?search=a", keyed(**{"978-4-297-12815-2": ("Key", "/book/1")}), "feed"),
        (f"{PRESS}/book/1", "<a href='https://www.amazon.co.jp/dp/B00000000X'>k</a><a href='https://honto.jp/x'>h</a>", "linked"),
        ("https://www.googleapis.com/books/v1/volumes?q=a", json.dumps({"items": [volume]}), "feed"),
        ("https://pragprog.com/index.json", json.dumps(index), "feed"),
        ("https://techbookfest.org/api", json.dumps(edge), "feed"),
        (f"{PRESS}/broken", "{broken", "feed"),
        ("https://leanpub.com/feed", "{}", "feed"),
        (f"{PRESS}/null", None, "feed"),
    ]
    got, rejected = catalog(spark, pages)
    assert {k: r.title for k, r in got.items()} == {
        ("gihyo", f"{PRESS}/book/1"): "Key", ("google-books", "https://books.google.com/books?id=x"): "Vol",
        ("pragprog", "https://pragprog.com/titles/t"): "Prag", ("techbookfest", "https://techbookfest.org/product/9"): "Zine",
    }
    press = got["gihyo", f"{PRESS}/book/1"]
    assert press.asin == "B00000000X" and float(press.price) == 3000.0 and press.authors == ["Ann"]
    assert any(s.url == "https://www.amazon.co.jp/dp/B00000000X" for s in press.ebook_stores)
    assert rejected == {(f"{PRESS}/broken", "unread feed"), ("https://leanpub.com/feed", "unread feed"), (f"{PRESS}/null", "unread feed")}


def test_pages_of_a_listing(spark):
    """Pages follow each other by number; a missing one is told, one after the last does not count."""
    book = lambda n: f"<article class=book><h3 itemprop=name><a href='/books/b{n}'>B{n}</a></h3><p itemprop=author>Ann</p></article>"
    pager = "<a href='/books?page=2'>2</a><a href='/books?sort=x&amp;page=12'>last</a>"
    pages = [(f"{BOOKS}/books/", book(1) + pager, "list")] + [(f"{BOOKS}/books?page={n}", book(n) + book(1), "list") for n in (2, 10, 12, 13)]
    got, rejected = catalog(spark, pages)
    order = sorted(got.values(), key=lambda r: r.position)
    assert [r.title for r in order] == ["B1", "B2", "B10", "B12"]
    assert rejected == {(f"{BOOKS}/books?page={n}", "missing page of a listing") for n in (3, 4, 5, 6, 7, 8, 9, 11)}
    only, told = catalog(spark, [(f"{BOOKS}/books?page=4", book(4), "list")])
    assert [r.title for r in only.values()] == ["B4"] and not told


def bib(spark):
    return as_books(spark.createDataFrame([("9784297128152", "B", "text")], "isbn string, title string, description string"))


def test_details_from_pages(spark, monkeypatch):
    """Only asked pages are parsed; each failure has its reason; keyed answers fall back to their first entry."""
    number, other = "978-4-297-12815-2", "978-4-297-15629-9"
    feed = lambda n: details.KEYED_PAGE.format(n)
    pages = [
        (feed(number), keyed(**{"978-4-297-00000-0": ("Wrong", "/book/0"), number: ("Right", "/book/2022/" + number)})),
        (feed(other), keyed(**{"978-4-297-99999-9": ("Paper", "/book/9")})),
        (f"{PRESS}/book/9", "<a href='https://www.amazon.co.jp/dp/B00000000X'>k</a>"),
        (SEA, "<h1 class=title>Sea</h1><a href='https://book.mynavi.jp/ec/products/detail/id=77'>more</a>"),
        ("https://book.mynavi.jp/ec/products/detail/id=77", "<a href='https://www.amazon.co.jp/gp/product/B00000000Y'>k</a>"),
        ("https://www.googleapis.com/books/v1/volumes/v1", json.dumps({"id": "v1", "volumeInfo": {"title": "Vol", "language": "en"}})),
        (f"{SHOP}/empty", "<p>nothing"),
        (f"{SHOP}/null", None),
    ] + [(f"{SHOP}/unasked/{i}", None) for i in range(50)]
    urls = [f"{PRESS}/book/2022/{number}", f"{PRESS}/dp/ebook/2026/{other}", SEA, "https://books.google.com/books?id=v1&x=1", f"{SHOP}/empty", f"{SHOP}/null",
            f"{SHOP}/gone", f"{SHOP}/secret", "https://nowhere.example.com/", f"{PRESS}/magazine", SEA]
    parsed = []
    extract = details.extract
    monkeypatch.setattr(details, "extract", lambda p, r: parsed.append(p.count()) or extract(p, r))
    df = spark.createDataFrame(pages, "url string, html string")
    asked = spark.createDataFrame([(u,) for u in urls], "url string")
    for few in (200_000, 0):
        monkeypatch.setattr(details, "BROADCAST_ROWS", few)
        books, rejected = book_details_from_pages(asked, df, sources(spark), robots(spark), bib(spark))
        got = {r.asked_url: r for r in books.collect()}
        assert {u: (r.title, r.asin, r.language) for u, r in got.items()} == {
            urls[0]: ("Right", None, "ja"), urls[1]: ("Paper", "B00000000X", "ja"), SEA: ("Sea", "B00000000Y", "ja"), urls[3]: ("Vol", None, "en")}
        assert got[urls[0]].description == "text" and got[urls[1]].url == f"{PRESS}/book/9"
        told = {r.url: r.reason for r in rejected.collect()}
        assert "Error" in told.pop(f"{SHOP}/null")
        assert told == {f"{SHOP}/empty": "no record", f"{SHOP}/gone": "not fetched", f"{SHOP}/secret": "robots.txt",
                        "https://nowhere.example.com/": "no source", f"{PRESS}/magazine": "not fetched"}
    assert parsed == [3, 3]


def test_asked_pages_are_taken_without_a_shuffle_of_bodies(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "y")], "url string, html string")
    plan = details.asked_pages(df, spark.createDataFrame([("a",)], "page_url string"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_merge_fields(spark):
    rows = [("k", "detail", None, "", [], 2, "EUR"), ("k", "list", "t", "x", ["A"], 1, None), ("k", "list", "s", None, None, None, "USD"), ("m", "other", "n", "o", ["B"], 3, "X")]
    df = spark.createDataFrame(rows, "key string, kind string, title string, note string, authors array<string>, price int, currency string")
    rank = F.when(F.col("kind") == "detail", 1).when(F.col("kind") == "list", 2)
    own = F.when(F.col("kind") == "list", 0).when(F.col("kind") == "detail", 1)
    got = merge_fields(df, ["key"], {"title": rank, "note": rank, "authors": rank, "price": own}, [F.col("title")], {"price": ["currency"]})
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == [("k", "s", "x", ["A"], 1, None), ("m", None, None, None, None, None)]
    assert plan.count("Exchange hashpartitioning") == 1
