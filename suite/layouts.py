"""One list item and one detail page per book in the layout of every source, with the fields it must give.

A layout is a page with «slots» for the parts of a book, and SQL for what is read from it; a field that
is not named is empty. All pages are invented here.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.operators.joins import robots_rules
from shelfmark.plans.catalog import catalog_from_pages
from shelfmark.plans.details import KEYED_PAGE, book_details_from_pages
from shelfmark.sources import rulesets
from shelfmark.sources.html import extract
from shelfmark.sources.records import books_from_fields

from . import views as v
from .registry import query
from .tables import BIB_SQL, bib_books

TWO = "author1 || '|' || p_brand"
PRICE, DAY = "floor(p_retailprice)", "'2024-05-06'"

LIST = {
    "book-tech": (
        "<div class=contents-index-item><a class=book-ribbon-link href='/b/«k»'>x</a><p class=contents-index-item-detail-title>«name»</p><a href='/publisher_relations/1'>«brand»</a>"
        "<a href='/author_relations/1'>«author»（著）</a><p class=contents-index-item-detail-price_include_tax>«amount»円</p><p class=my-1>2024/5/6</p></div>",
        {"url": "'https://book-tech.com/b/' || k", "authors": "author1", "price": PRICE, "published_at": DAY, "publisher": "p_brand"}),
    "born-digital": (
        "<li class=c-product-list__item><a class=c-product-list__image-wrap href='/?pid=«k»'>i</a><a class=c-product-list__name href='/x'>【PDF】«name»</a><p class=c-product-list__price>«amount»円</p>",
        {"url": "'https://wgn-obs.shop-pro.jp/?pid=' || k", "title": "'【PDF】' || p_name", "price": PRICE}),
    "c-r": (
        "<div class=clearfix><p class=book05><a href='/b/«k»'>«name»</a></p>著者：«author»、«brand» 著<br>価格：«amount»円＋税<br>ISBNコード：«dashed»</div>",
        {"url": "'https://www.c-r.com/b/' || k", "authors": TWO, "price": "floor(floor(p_retailprice) * 1.1::DOUBLE)", "isbn": "isbn"}),
    "coronasha": (
        "<article class=item><dl class=col1><dt><a href='/np/«k»'>i</a></dt></dl><span class=tunogaki>«brand»</span><span class=book-title>«name»</span><ul class=status-list><li>電子版あり</ul>"
        "<ul class=authors><li><a>«author»</a><li><a>«brand»</a></ul><div class=book-info><dl><dt>定価<dd>«amount»円<dt>発行年月日<dd>2024/05/06<dt>ISBN<dd>«dashed»</dl></div></article>",
        {"url": "'https://www.coronasha.co.jp/np/' || k", "title": "p_brand || ' ' || p_name", "authors": TWO, "price": PRICE, "published_at": DAY, "isbn": "isbn"}),
    "cq-publishing": (
        "<ul class='itemList books04'><li><dl><dd class=mainTitle><a href='/lib/«k»'>«name»【PDF版】</a></dd><dd class=subTitle>«type»</dd><dd class=price><span>«amount»円</span></dd></dl></li></ul>",
        {"url": "'https://cc.cqpub.co.jp/lib/' || k", "price": PRICE}),
    "juse-p": ("<div class=product-col><div class=title><h4><a href='/products/«k»'>«name»\n【電子版】</a></h4></div></div>", {"url": "'https://www.juse-p.co.jp/products/' || k"}),
    "lambdanote": (
        "<li class=search-results__list-item><div class=card__heading><a href='/products/«k»'>«name»</a></div><div class=price__regular><span class=price-item>«amount»円</span></div></li>",
        {"url": "'https://www.lambdanote.com/products/' || k", "price": PRICE}),
    "manatee": (
        "<ul class=category_list><li><dl class=detail><dt><a href='/manatee/detail/id=«k»'>«name»</a></dt><dd class=detail__price>«amount»円</dd></dl></li></ul>",
        {"url": "'https://book.mynavi.jp/manatee/detail/id=' || k", "price": PRICE}),
    "maruzen-publishing": (
        "<div class=booklist><div class=item><div class=ttl><a href='/item/«k»'>«name»</a></div><div class=author><a>«author» 著</a><a>«brand»</a></div></div></div>",
        {"url": "'https://www.maruzen-publishing.co.jp/item/' || k", "authors": "replace(author1, ' ', '|') || '|' || p_brand"}),
    "optronics": (
        "<div class=list_area><div class=listrightbloc><h3><a href='/products/«k»'>«name»</a></h3></div><div class=pricebox><span class=price>«amount»円</span></div>"
        "<div class=listcomment>著者：«author»、«brand»\n発行：«brand»㈱</div></div>",
        {"url": "'https://optronics-ebook.com/products/' || k", "authors": TWO, "price": PRICE, "publisher": "p_brand"}),
    "oreilly-japan": (
        "<div class=ebookCatalog><table><tbody><tr><td class=isbn>«dashed»<td class=title><a href='/books/«isbn»/'>«name»</a><td class=price>«amount»円<td>2024/05/06</table></div>",
        {"url": "'https://www.oreilly.co.jp/books/' || isbn || '/'", "price": PRICE, "published_at": DAY, "isbn": "isbn"}),
    "peaks": (
        "<article class=p-project__unit><div class=p-project__unit_image><a href='/p/«k»'><img alt='«name»' src='/c.png'></a></div></article>", {"url": "'https://peaks.cc/p/' || k"}),
    "personal-media": (
        "<table><tr><th>書名<th>価格<tr><td><a href='/book/«k».html'>«name»</a><td>«type»<td>«amount»円</table>",
        {"url": "'https://pages.example.com/book/' || k || '.html'", "price": PRICE}),
    "rutles": (
        "<li class=c-item-list__item><div class=c-item-list__ttl><a href='/?pid=«k»'>【電子版】«name»</a></div><div class=c-item-list__price>«amount»円</div></li>",
        {"url": "'https://shop.rutles.net/?pid=' || k", "title": "'【電子版】' || p_name", "price": PRICE}),
    "saiensu": (
        "<article class=bookListItem><h4 class=bookListItemData_title><p class=minor-mt><a class=link_item href='/b/«k»'>«name»</a></p></h4><small class=bookListItemData_subtitle>―«type»</small>"
        "<span class=bookListItemData_mediaName>電子</span><div class=bookListItemData_author><a class=link_item>«author»(大学) 著</a></div><span class=bookListItemData_priceIncludedTaxNumber>«amount»</span>"
        "<span class=bookListItemData_publishDate>2024年5月6日</span><span class=bookListItemData_publisher>発行：«brand»</span><span class=bookListItemData_isbn2>ISBN «dashed»</span></article>",
        {"url": "'https://www.saiensu.co.jp/b/' || k", "title": "p_name || ' ―' || p_type", "authors": "author1", "price": PRICE, "published_at": DAY, "isbn": "isbn", "publisher": "p_brand"}),
    "seshop": (
        "<div class=inner><div class=product-data data-category='電子書籍/a' data-price='«plain»'></div><div class=txt><a href='/product/detail/«k»'>«name»</a></div><span class=date>2024.05.06</span></div>",
        {"url": "'https://www.seshop.com/product/detail/' || k", "price": PRICE, "published_at": DAY}),
    "tatsu-zine": (
        "<article class=book><h3 itemprop=name><a href='/books/«k»'>«name»</a></h3><p itemprop=author>«author»（著）、«brand»</p></article>",
        {"url": "'https://tatsu-zine.com/books/' || k", "authors": TWO}),
    "leanpub": (
        "<ul><li><img src='https://x.cloudfront.net/book«k»/s_featured.jpg'><a href='/book«k»'>«name»</a><p class=text-neutral-500>«author» and «brand»</p><p class=italic>«type»</p></ul>",
        {"url": "'https://leanpub.com/book' || k", "authors": TWO}),
    "ipa": ("<ul class=archive-list><li><a href='/b/«k»'>«name»</a></ul>", {"url": "'https://pages.example.com/b/' || k"}),
}

SHOP = "<script>\nvar Colorme = {\"product\":{\"sales_price_including_tax\":«plain»,\"model_number\":\"«dashed»\"}};\n</script>"
DETAIL = {
    "book-tech": (
        "<div class=contents-book-about-title><h1>«name»</h1></div><a href='/publisher_relations/1'>«brand»</a><a href='/author_relations/2'>«author»（著）</a>"
        "<p class=contents-book-item-detail-price_include_tax>«amount»円</p><p class=contents-book-about-publicationdate>2024/5/6</p><p class=contents-book-about-id>ISBN: «isbn»</p>",
        {"authors": "author1", "price": PRICE, "published_at": DAY, "isbn": "isbn", "publisher": "p_brand"}),
    "born-digital": (
        f"<h1 class=p-cart-form__name>«name»</h1>{SHOP}<div class=p-product-body__description>著者：«author»、«brand»\n発売日：2024年5月6日\n発行：株式会社 Ink</div>",
        {"authors": TWO, "price": PRICE, "published_at": DAY, "publisher": "'Ink'"}),
    "c-r": (
        "<p class=book_s_title>«name»</p><div class=book_s02>著者：«author»、«brand» 著<br>価格：«amount»円＋税<br>ISBNコード：«dashed»</div>",
        {"authors": TWO, "price": "floor(floor(p_retailprice) * 1.1::DOUBLE)", "isbn": "isbn"}),
    "coronasha": (
        "<h2 class=title><span class=tunogaki>«brand»</span><span class=book-title>«name»</span></h2><ul class=authors><li><a>«author»</a></ul><span class=price>«amount»円</span>"
        "<div class=book-info><dl><dt>発行年月日<dd>2024/05/06<dt>ISBN<dd>«dashed»</dl></div>",
        {"title": "p_brand || ' ' || p_name", "authors": "author1", "price": PRICE, "published_at": DAY, "isbn": "isbn"}),
    "cq-publishing": (
        "<div class=itemTitleWrapper><h2>«name»【PDF版】</h2></div><table summary='商品詳細'><tr><th>著者<td><a>«author»</a> <a>«brand»（社）</a><tr><th>発行日<td>2024/5/6<tr><th>発行元<td>Ink"
        "<tr><th>価格（ライセンス料金）<td>«amount»円</table>",
        {"authors": TWO, "price": PRICE, "published_at": DAY, "publisher": "'Ink'"}),
    "impress-books": (
        "<h2>«name»</h2><dl class=module-book-data><dt>著者<dd>«author»、«brand»<dt>ISBN<dd>«dashed»<dt>発売日<dd>2024/5/6</dl><span class=module-e-book-price>«amount»円</span>",
        {"authors": TWO, "price": PRICE, "published_at": DAY, "isbn": "isbn"}),
    "ipa": (
        "<h1 class='ttl --lv1'>«name»</h1><dl class=data-list><dt><span class=data-list__ttl__inner>発行日</span></dt><dd class=data-list__data>2024年5月6日</dd>"
        "<dt><span class=data-list__ttl__inner>ISBN</span></dt><dd class=data-list__data>«dashed»</dd><dt><span class=data-list__ttl__inner>定価</span></dt><dd class=data-list__data>«amount»円（税抜）</dd></dl>",
        {"price": "floor(floor(p_retailprice) * 1.1::DOUBLE)", "published_at": DAY, "isbn": "isbn"}),
    "juse-p": (
        "<h2 class=c-ttl-02>«name»</h2><div class=product-details><ul><li>A5／99頁<li>«author»、«brand»[著]<li>定価 «amount»円<li>ISBN«dashed»</ul></div>",
        {"authors": TWO, "price": PRICE, "isbn": "isbn"}),
    "lambdanote": (
        "<h1 class=product__title>«name»</h1><div class=price__regular><span class=price-item>«amount»円</span></div><p>ISBN «dashed»</p>"
        "<script type='application/json' id='ProductJson-1'>{\"vendor\":\"«author», «brand»\"}</script>",
        {"authors": TWO, "price": PRICE, "isbn": "isbn"}),
    "leanpub": (
        "<meta property='og:title' content='«name»'><meta name=author content='«author» and «brand»'><script>x=\"{\\\"minimumPaidPrice\\\",19.99,\\\"lastPublishedAt\\\",\\\"2024-05-06T01:02\\\"}\"</script>",
        {"authors": TWO, "price": "19.99", "published_at": DAY}),
    "manatee": (
        "<h1 class=title>«name»</h1><div class=intro><p>«brand»</p></div><ul class=attribute><li><a>«author»</a></ul><div id=item_selectlist><table><tr><td class=price>«amount»円</table></div>"
        "<div class=item_meta_image><img src='/i.png' alt='«dashed».jpg'></div><p class=date>2024-05-06</p>",
        {"authors": "author1", "price": PRICE, "published_at": DAY, "isbn": "isbn", "publisher": "p_brand"}),
    "maruzen-publishing": (
        "<title>«name» | 丸善出版</title><div id=bookData><table><tr><th>著者<td>«author»　«brand» 著<tr><th>発行元<td>Ink<tr><th>出版年月日<td>2024/05/06</table></div>",
        {"authors": "replace(author1, ' ', '|') || '|' || p_brand", "published_at": DAY, "publisher": "'Ink'"}),
    "optronics": (
        "<title>OPTRONICS eBOOK / «name»</title><span id=price02_default>«amount»円</span><div class=main_comment>著者：«author»、«brand»\n発行：«brand»㈱</div>",
        {"authors": TWO, "price": PRICE, "publisher": "p_brand"}),
    "oreilly-japan": (
        "<h1 itemprop=name>«name»</h1><p class=sub_title>― «type»</p><span itemprop=author>«author» 著、«brand» 訳</span><dd itemprop=isbn>«dashed»</dd><dd itemprop=datePublished content='2024-05-06'></dd>"
        "<div class=option-item><div class=option-name>Print</div><div>1円</div></div><div class=option-item><div class=option-name>Ebook</div><div>«amount»円</div></div>",
        {"title": "p_name || ' ―' || p_type", "authors": TWO, "price": PRICE, "published_at": DAY, "isbn": "isbn"}),
    "peaks": (
        "<h2 class=p-project__intro_title>『«name»』</h2><ul class=p-project__intro_author><li><a>«author»,</a><li><a>«brand»</a></ul><select id=editions><option kind=electronic><span>«amount»円</span></select>",
        {"authors": TWO, "price": PRICE}),
    "personal-media": (
        "<body><h1>«name»</h1>\n<p>«author»、«brand» 著\nISBN«dashed»\n2024年5月発売\n定価：«amount»円</p>", {"authors": TWO, "price": PRICE, "published_at": "'2024-05-01'", "isbn": "isbn"}),
    "pragprog": (
        "<h1 class=title>«name»</h1><meta property='book:isbn' content='«isbn»'><h2 class=author>by «author» with «brand»</h2><div class=book-about-text>Published: May 2024</div><div class=buybox>eBook $39.95</div>",
        {"authors": TWO, "price": "39.95", "published_at": "'2024-05-01'", "isbn": "isbn"}),
    "rutles": (
        f"<h2 class=p-product-info__ttl>«name» - 出版社ラトルズ公式ネットショップ</h2>{SHOP}<div class=p-product-explain__body>著者：«author»　«brand»\n発売日：2024年5月6日</div>",
        {"authors": TWO, "price": PRICE, "published_at": DAY, "isbn": "isbn"}),
    "saiensu": (
        "<h2 class=mainDetail_bookTitle>«name»</h2><p class=mainDetail_subTitle>«type»</p><ul class=mainDetail_authorList><li><a class=link_item>«author»(大学) 著</a></ul><b class=price_num>«amount»</b>"
        "<i class=bookDetail_publishDate>発行 2024年5月6日</i><i class=bookDetail_publisher>発行：«brand»</i><i class=bookDetail_isbn>ISBN «dashed»</i>",
        {"title": "p_name || ' ―' || p_type", "authors": "author1", "price": PRICE, "published_at": DAY, "isbn": "isbn", "publisher": "p_brand"}),
    "seshop": (
        "<h1>«name»</h1><a href='/product/author/1'>«author»</a><a href='/product/author/2'>«brand»</a><meta name='cxenseparse:sho-isbn' content='«isbn»'>"
        "<meta name='cxenseparse:sho-price' content='«plain»'><meta name='cxenseparse:sho-releasedate' content='2024.05.06'>",
        {"authors": TWO, "price": PRICE, "published_at": DAY, "isbn": "isbn"}),
    "tatsu-zine": (
        "<h1>«name»</h1><a href='/books/pub/1'>«brand»</a><p itemprop=author>«author»（著）、«brand»</p><span itemprop=price>«amount»円（税込）</span>",
        {"authors": TWO, "price": PRICE, "publisher": "p_brand"}),
    "techbookfest": ("<meta property='og:title' content='«name»'><meta property='og:description' content='«type»'><span class='x-price'>«amount»円</span>", {"price": PRICE}),
    "calil": (
        "<h1 class=title itemprop=name>«name»</h1><div itemprop=author><a>«author»</a><a>«brand»</a></div><span itemprop=publisher>«brand»</span><span itemprop=datePublished>2024-05-06</span>"
        "<div><span>ISBN-13:</span> «isbn»</div>",
        {"authors": TWO, "published_at": DAY, "isbn": "isbn", "publisher": "p_brand"}),
}

FIELDS = ("title", "authors", "price", "published_at", "isbn", "publisher")
EMPTY = {"title": "p_name", "authors": "''", "price": "NULL", "published_at": "NULL", "isbn": "NULL", "publisher": "NULL"}


def _sql(layouts) -> str:
    """What every book's page must give, in the layout that its number falls on."""
    n = len(layouts)
    case = lambda of: f"CASE k % {n} " + " ".join(f"WHEN {i} THEN {of(s, want)}" for i, (s, (_, want)) in enumerate(layouts.items())) + " END"
    url = case(lambda s, w: w.get("url", f"'https://pages.example.com/{s}/' || k"))
    columns = [f"{case(lambda s, w: f'{chr(39)}{s}{chr(39)}')} AS source_id", f"{url} AS url"]
    for f in FIELDS:
        kind = "::DOUBLE" if f == "price" else ""
        columns.append(f"{case(lambda s, w, f=f, kind=kind: f'({w.get(f, EMPTY[f])}){kind}')} AS {f}")
    return v.with_views(f"SELECT k, {', '.join(columns)} FROM book")


def _fill(text: str):
    """A column of texts whose «slots» are the parts of each book."""
    k = F.col("k").cast("string")
    slots = {
        "name": F.col("p_name"), "type": F.col("p_type"), "author": F.col("author1"), "brand": F.col("p_brand"), "k": k, "isbn": F.col("isbn"),
        "amount": F.format_number(F.floor("p_retailprice"), 0), "plain": F.floor("p_retailprice").cast("string"), "number": F.lpad(k, 9, "0"),
        "dashed": F.concat(F.lit("978-4-"), F.substring("isbn", 5, 8), F.lit("-"), F.substring("isbn", 13, 1)),
    }
    return F.concat(*[slots[p] if j % 2 else F.lit(p) for j, p in enumerate(text.replace("»", "«").split("«"))])


def _records(spark, d, layouts, kind):
    """Pages of all books and the records read from them; publishers only where the page names one."""
    html, source = None, None
    for i, (name, (text, _)) in enumerate(layouts.items()):
        page = _fill(text)
        here = F.col("k") % len(layouts) == i
        html = F.when(here, page) if html is None else html.when(here, page)
        source = F.when(here, name) if source is None else source.when(here, name)
    pages = v.book_rows(spark, d).select("k", source.alias("source_id"), html.alias("html"), F.lit(kind).alias("page_kind"))
    pages = pages.withColumn("url", F.concat(F.lit("https://pages.example.com/"), "source_id", F.lit("/"), F.col("k").cast("string")))
    books = books_from_fields(extract(pages.drop("k"), rulesets.rules()), v.sources(spark))
    named = [s for s, (_, want) in layouts.items() if "publisher" in want]
    return books.select(
        F.regexp_extract("page_url", "([0-9]+)$", 1).cast("bigint").alias("k"), "source_id", "url", "title", F.array_join("authors", "|").alias("authors"),
        F.col("price").cast("double").alias("price"), F.col("published_at").cast("string").alias("published_at"), "isbn",
        F.when(F.col("source_id").isin(*named), F.col("publisher")).alias("publisher"))


@query("list_records", _sql(LIST))
def list_records(spark, d):
    return _records(spark, d, LIST, "list")


@query("detail_records", _sql(DETAIL))
def detail_records(spark, d):
    return _records(spark, d, DETAIL, "detail")


def _pages(books, *kinds):
    """Pages (url, html, page_kind) of the books that fit a condition, by (condition, url, html, page kind)."""
    out = None
    for condition, url, html, kind in kinds:
        rows = books.where(condition).select(_fill(url).alias("url"), _fill(html).alias("html"), F.lit(kind).alias("page_kind"))
        out = rows if out is None else out.unionByName(rows)
    return out


ENTRY = '{"series":"","title":"«name»","subtitle":"","author":{"著":{"«author»":""}},"price":[«plain»],"release":["2024.05.06"],"url":"/book/«k»","cover":["","","",""]}'


# Feeds of four sources, broken ones among them, and list rows of which half have a detail page.
@query("catalog_from_feeds", v.with_views("""
SELECT CASE k % 5 WHEN 0 THEN 'gihyo' WHEN 1 THEN 'google-books' WHEN 2 THEN 'pragprog' WHEN 3 THEN 'techbookfest' ELSE 'seshop' END AS source_id,
  CASE k % 5 WHEN 0 THEN 'https://gihyo.jp/book/' || k WHEN 1 THEN 'https://books.google.com/books?id=v' || k WHEN 2 THEN 'https://pragprog.com/titles/' || k
    WHEN 3 THEN 'https://techbookfest.org/product/' || k ELSE 'https://www.seshop.com/product/detail/' || k END AS url,
  p_name AS title, CASE k % 5 WHEN 2 THEN author1 || '|' || p_brand WHEN 3 THEN '' WHEN 4 THEN CASE WHEN k % 2 = 0 THEN author1 ELSE '' END ELSE author1 END AS authors,
  CASE WHEN k % 5 IN (0, 3, 4) THEN floor(p_retailprice) END::DOUBLE AS price, CASE WHEN k % 5 IN (0, 4) THEN '2024-05-06' END AS published_at,
  CASE WHEN k % 5 = 0 AND k % 3 = 0 THEN 'B' || lpad(k::VARCHAR, 9, '0') END AS asin, CASE WHEN k % 5 = 4 AND k % 2 = 0 THEN isbn END AS isbn
FROM book
UNION ALL SELECT 'rejected', 'https://pragprog.com/broken/' || k, 'unread feed', '', NULL, NULL, NULL, NULL FROM book WHERE k % 10 = 2"""))
def catalog_from_feeds(spark, d):
    volume = '{"items":[{"id":"v«k»","volumeInfo":{"title":"«name»","authors":["«author»"],"infoLink":"http://books.google.com/books?id=v«k»"},"saleInfo":{}}]}'
    index = '{"results":[{"record_type":"book","href":"/titles/«k»","title":"«name»","author":"«author» and «brand»"},{"record_type":"news","title":"x"}]}'
    edges = '{"data":{"searchProducts":{"edges":[{"node":{"product":{"databaseID":"«k»","name":"«name»","ebookVariant":{"price":«plain»}}}},{"node":{}}]}}}'
    shop = "https://www.seshop.com/product"
    detail = "<h1>Detail «name»</h1><a href='/product/author/1'>«author»</a><meta name='cxenseparse:sho-isbn' content='«isbn»'><meta name='cxenseparse:sho-price' content='1'>"
    pages = _pages(
        v.book_rows(spark, d),
        ("k % 5 = 0", "https://gihyo.jp/api_gh/site/search?search=«k»", '{"list":{"978-4-999-«number»-0":' + ENTRY + "}}", "feed"),
        ("k % 5 = 0 and k % 3 = 0", "https://gihyo.jp/book/«k»", "<a href='https://www.amazon.co.jp/dp/B«number»'>k</a>", "linked"),
        ("k % 5 = 1", "https://www.googleapis.com/books/v1/volumes?q=«k»", volume, "feed"),
        ("k % 5 = 2", "https://pragprog.com/index/«k».json", index, "feed"),
        ("k % 5 = 3", "https://techbookfest.org/api/«k»", edges, "feed"),
        ("k % 5 = 4", "https://www.seshop.com/list/«k»", LIST["seshop"][0], "list"),
        ("k % 5 = 4 and k % 2 = 0", f"{shop}/detail/«k»", detail, "detail"),
        ("k % 10 = 2", "https://pragprog.com/broken/«k»", "{broken", "feed"),
    )
    none = robots_rules(spark.createDataFrame([("https://none.example.com", "")], "origin string, content string"), "librarybot")
    books, rejected = catalog_from_pages(pages, v.sources(spark), none)
    own = books.select(
        "source_id", "url", "title", F.array_join("authors", "|").alias("authors"), F.col("price").cast("double").alias("price"),
        F.col("published_at").cast("string").alias("published_at"), "asin", F.when(F.col("source_id") == "seshop", F.col("isbn")).alias("isbn"))
    bad = rejected.select(F.lit("rejected").alias("source_id"), "url", F.col("reason").alias("title"), F.lit("").alias("authors"))
    return own.unionByName(bad, allowMissingColumns=True)


# Details of all books from fetched pages: page of a source, keyed answer with and without the number, nothing fetched, no source.
@query("details_from_pages", v.with_views("""
SELECT CASE k % 4 WHEN 1 THEN 'https://gihyo.jp/book/2024/978-4-999-' || lpad(k::VARCHAR, 9, '0') || '-0' WHEN 3 THEN 'https://elsewhere.example.com/' || k
    ELSE 'https://www.saiensu.co.jp/b/' || k END AS url,
  CASE k % 4 WHEN 2 THEN 'not fetched' WHEN 3 THEN 'no source' ELSE 'ok' END AS outcome,
  CASE k % 4 WHEN 0 THEN p_name WHEN 1 THEN CASE WHEN k % 8 = 1 THEN p_name ELSE 'Paper ' || p_name END END AS title,
  CASE WHEN k % 4 = 0 THEN bib.description END AS description, CASE WHEN k % 8 = 1 THEN 'B' || lpad(k::VARCHAR, 9, '0') END AS asin
FROM book LEFT JOIN bib ON bib.isbn = book.isbn""", BIB_SQL))
def details_from_pages(spark, d):
    wrong = '"978-4-999-000000000-9":' + ENTRY.replace("«name»", "Paper «name»").replace("/book/«k»", "/paper/«k»")
    pages = _pages(
        v.book_rows(spark, d),
        ("k % 4 in (0, 3)", "https://www.saiensu.co.jp/b/«k»", "<h2 class=mainDetail_bookTitle>«name»</h2><i class=bookDetail_isbn>ISBN «dashed»</i>", "detail"),
        ("k % 8 = 1", KEYED_PAGE.format("978-4-999-«number»-0"), '{"list":{' + wrong + ',"978-4-999-«number»-0":' + ENTRY + "}}", "detail"),
        ("k % 8 = 5", KEYED_PAGE.format("978-4-999-«number»-0"), '{"list":{' + wrong + "}}", "detail"),
        ("k % 8 = 1", "https://gihyo.jp/book/«k»", "<a href='https://www.amazon.co.jp/dp/B«number»'>k</a>", "detail"),
    ).drop("page_kind")
    asked = _pages(
        v.book_rows(spark, d),
        ("k % 4 in (0, 2)", "https://www.saiensu.co.jp/b/«k»", "", ""),
        ("k % 4 = 1", "https://gihyo.jp/book/2024/978-4-999-«number»-0", "", ""),
        ("k % 4 = 3", "https://elsewhere.example.com/«k»", "", ""),
    ).select("url")
    none = robots_rules(spark.createDataFrame([("https://none.example.com", "")], "origin string, content string"), "librarybot")
    good, bad = book_details_from_pages(asked, pages, v.sources(spark), none, bib_books(spark, d))
    own = good.select(F.col("asked_url").alias("url"), F.lit("ok").alias("outcome"), "title", "description", "asin")
    return own.unionByName(bad.select("url", F.col("reason").alias("outcome")), allowMissingColumns=True)
