"""Rules of single sources on invented pages, and the job from pages to a catalog."""

import pytest

from shelfmark.operators.joins import robots_rules
from shelfmark.plans.catalog import catalog_from_pages
from shelfmark.sources import html, rulesets
from shelfmark.sources.records import books_from_fields
from shelfmark.sources.registry import sources

# source, page kind, page, and what the first rows have.
PAGES = [
    ("maruzen-publishing", "detail", "<title>Waves | 丸善出版</title><div id=bookData><table><tr><th>著者<td>山田 太郎　著<tr><th>出版年月日<td>2024年5月6日</table></div>",
     [{"title": "Waves", "authors": ["山田", "太郎"], "published_at": "2024-05-06"}]),
    ("personal-media", "list", "<table><tr><th>書名<th>税込<tr><td><a href='/book/x.html'>Old Book</a><td>1,100円<tr><td><a href='/other/'>Toy</a><td>5円</table>",
     [{"title": "Old Book", "price": 1100}]),
    ("oreilly-japan", "detail", "<h1 itemprop=name>Net</h1><div class=option-item><div class=option-name>Print</div><div>4,000円</div></div><div class=option-item><div class=option-name>Ebook</div><div>3,000円</div></div>",
     [{"title": "Net", "price": 3000}]),
    ("oreilly-japan", "list", "<div class=ebookCatalog><table><tbody><tr><td class=isbn>978-4-00-000000-1<td class=title><a href='/b/1'>Net</a><td class=price>3,000円<td>2024/01/02</table></div>",
     [{"isbn": "9784000000001", "cover_image_url": "https://www.oreilly.co.jp/books/images/picture_large978-4-00-000000-1.jpeg"}]),
    ("impress-books", "detail", "<h2>Guide</h2><div class=module-e-book-buy-guide-btn><a href='/cart/1'>buy</a></div>", [{"store": ("インプレスブックス", "https://page/", "social")}]),
    ("cq-publishing", "detail", "<div class=itemTitleWrapper><h2>Chips</h2></div><table summary='商品詳細'><tr><th>著者<td><a>Ann</a><a>Bob (社)</a></table>", [{"authors": ["Ann", "Bob"]}]),
    ("born-digital", "detail", "<h1 class=p-cart-form__name>Draw</h1><div class=p-product-body__description>訳者：Cid\n著者：Ann、Bob\n著者\tDee\n発行所：株式会社 Ink</div>",
     [{"authors": ["Cid", "Ann", "Bob", "Dee"], "publisher": "Ink"}]),
    ("juse-p", "detail", "<h2 class=c-ttl-02>Quality</h2><div class=product-details><ul><li>A5／200頁<li>Ann、Bob<li>定価 2,200円<li>在庫あり</ul></div>", [{"authors": ["Ann", "Bob"], "price": 2200}]),
    ("peaks", "list", "<article class=p-project__unit><div class=p-project__unit_image><a href='/p/1'><img alt='『Quoted』' src=/c.png></a></div></article>", [{"title": "『Quoted』"}]),
    ("peaks", "detail", "<meta name='twitter:title' content='Clean'><meta property='twitter:image' content='https://i/t.png'><h2 class=p-project__intro_title>『Clean』</h2><meta name=description content=no>",
     [{"title": "Clean", "cover_image_url": "https://i/t.png", "description": None}]),
    ("manatee", "detail", "<h1 class=title>Sea</h1><a href='https://www.amazon.co.jp/dp/4000000000'>p</a><a href='https://www.amazon.co.jp/dp/B000000001'>k</a>", [{"asin": "B000000001"}]),
    ("lambdanote", "detail", "<h1>Lambda</h1><script>var x='978-4-00-000000-1'</script>", [{"isbn": "9784000000001"}]),
    ("leanpub", "list", "<ul><li><img src='https://x.cloudfront.net/my-book/s_featured.jpg'><a href='/other'>Other</a><a href='/my-book'> </a><a href='/my-book'>Mine</a></ul>",
     [{"title": "Mine", "url": "https://leanpub.com/my-book"}]),
    ("c-r", "list", "<div class=clearfix><p class=book05><a href='/b/1'>Small</a></p>著者：Ann<br>価格：1,000円</div>", [{"title": "Small", "authors": ["Ann"]}]),
    ("ipa", "list", "<ul class=archive-list><li><a href='/b/1'>Book</a><li><a class='icon--folder' href='/sub/'>Folder</a></ul>", [{"title": "Book"}]),
]


@pytest.mark.parametrize(("source", "kind", "page", "want"), PAGES, ids=[f"{p[0]}-{p[1]}" for p in PAGES])
def test_source(spark, source, kind, page, want):
    df = spark.createDataFrame([("https://page/", page, source, kind)], "url string, html string, source_id string, page_kind string")
    rows = [r.asDict(True) for r in books_from_fields(html.extract(df, rulesets.rules()), sources(spark)).collect()]
    assert len(rows) == len(want)
    for row, w in zip(rows, want):
        got = {**row, "store": tuple((row["ebook_stores"] or [{}])[0].values()), "published_at": str(row["published_at"]), "price": row["price"] and float(row["price"])}
        assert {k: got[k] for k in w} == w


def test_deep_and_wide_pages(spark):
    page = "<font>" * 30_000 + "<a href='/deep'>x</a>" + "<p><a href='/y'>y</a>" * 120
    rules = {("s", "list"): ("a", [("url", "a", "href"), ("title", "", "self")])}
    df = spark.createDataFrame([(7, "u", page, "s", "list")], "page_id int, url string, html string, source_id string, page_kind string")
    rows = html.extract(df, rules).collect()
    assert len(rows) == 121 and {r.page_id for r in rows} == {7} and rows[0].error is None and rows[0].fields["title"] == ["x"]


def test_catalog_from_pages(spark):
    ipa, sea = "https://www.ipa.go.jp/archive/", "https://book.mynavi.jp/manatee/detail/id=5"
    more = "https://book.mynavi.jp/ec/products/detail/id=77"
    item = "<li><a href='{}'>{}</a>"
    pages = [
        (ipa + "index.html", "<ul class=archive-list>" + item.format("/b/1", "One") + "<li><a class=icon--folder href='/archive/sub.html'>More</a></ul>", "list"),
        (ipa + "sub.html", "<ul class=archive-list>" + item.format("/b/2", "Two") + item.format("/b/1", "One again") + "</ul>", "list"),
        (sea, f"<h1 class=title>Sea</h1><a href='{more}'>more</a>", "detail"),
        (more, "<a href='https://www.amazon.co.jp/gp/product/B00000000X'>k</a>", "linked"),
        ("https://www.ipa.go.jp/secret/x.html", "<ul class=archive-list></ul>", "list"),
        ("https://nowhere.example.com/", "", "list"),
    ]
    registry = sources(spark)
    # The linked page lies outside the source's own address.
    robots = robots_rules(spark.createDataFrame([("https://www.ipa.go.jp", "User-agent: *\nDisallow: /secret/")], "origin string, content string"), "bot")
    df = spark.createDataFrame(pages, "url string, html string, page_kind string")
    books, rejected = catalog_from_pages(df, registry, robots)
    got = {(r.source_id, r.title, r.asin) for r in books.collect()}
    assert got == {("ipa", "One", None), ("ipa", "Two", None), ("manatee", "Sea", "B00000000X")}
    assert {(r.url, r.reason) for r in rejected.collect()} == {("https://www.ipa.go.jp/secret/x.html", "robots.txt"), ("https://nowhere.example.com/", "no source")}
