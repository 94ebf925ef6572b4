"""Page rules and feeds on small invented pages."""

from pyspark.sql import functions as F

from shelfmark.sources import html, pages, rulesets
from shelfmark.sources.feeds import explode_keyed_catalog
from shelfmark.sources.records import books_from_fields
from shelfmark.sources.registry import SOURCES, sources


def test_every_rule_is_readable():
    known = {s[0] for s in SOURCES} | {"calil"}
    for (source, _), (item, fields) in rulesets.rules().items():
        assert source in known
        for selector in ([item] if item else []) + [s for _, s, a in fields if a != "re"]:
            assert html._steps(selector.replace("||", ","))


def test_selectors_on_unclosed_tags():
    root = html.tree("<ul><li class='a b' id=x>1<li data-k='v1'>2 <b>3</b></ul><p>4<br><p>5<script>var t='</p><li>6</li>'</script>")
    find = lambda s: [n.text().strip() for n in html.select(root, s)]
    assert find("ul li") == ["1", "2 3"]
    assert find("li.a.b, li b") == ["1", "3"]
    assert find("#x") == ["1"] and find("li[data-k^='v']") == ["2 3"] and find("li:not(.a)") == ["2 3"]
    assert find("li:eq(-1)") == ["2 3"] and find("p:eq(0)") == ["4"]


def test_entities_without_semicolon_can_stay(spark):
    page = "<html lang='a&ampb'><script>x && y &amp</script><h1>R&amp;D &amp&amp;&amp</h1><footer>&copy; A & B &#65; &#6</footer>"
    root = html.tree(page, closed_entities=True)
    assert [html.select(root, s)[0].text() for s in ("h1", "footer", "script")] == ["R&D &amp&&amp", "© A & B A &#6", "x && y &amp"]
    assert html.select(root, "html")[0].attrs["lang"] == "a&ampb"
    assert html.select(html.tree(page), "h1")[0].text() == "R&D &&&"
    row = spark.createDataFrame([("u", page, "s", "detail")], "url string, html string, source_id string, page_kind string")
    got = html.extract(row, {("s", "detail"): (None, [("title", "h1", "text")])}, closed_entities=True)
    assert got.first().fields == {"title": ["R&D &amp&&amp"]}


def books(spark, *rows):
    df = spark.createDataFrame(rows, "url string, html string, source_id string, page_kind string")
    got = html.extract(df, rulesets.rules())
    return got, {r.title: r for r in books_from_fields(got, sources(spark)).collect()}


def test_sources(spark):
    raw, got = books(
        spark,
        ("https://www.c-r.com/1", "<p class=book_s_title>甲</p><div class=book_s02>著者：乙、丙 著<br>価格：2,000円＋税<br>ISBNコード：978-4-86354-123-4</div>", "c-r", "detail"),
        ("https://www.c-r.com/l", "<div class=clearfix><p class=book05><a href='/a'>丁</a><p class=book05><a href='/b'>戊</a></div>", "c-r", "list"),
        ("https://www.personal-media.co.jp/book/1.html", "<body><h1>TRON</h1>\n<p>X、Y 著\nISBN978-4-89362-123-4\n2020年5月発売\n定価：1,100円</p><a href='../webshop/book/9'>b</a>", "personal-media", "detail"),
        ("https://www.oreilly.co.jp/ebook/", "<table class=ebookCatalog><tbody><tr><td class=isbn>978-4-87311-778-2<td class=title><a href='/books/9784873117782/'>T</a><td class=price>2,640<td>2016/12/24</table>", "oreilly-japan", "list"),
        ("https://www.ipa.go.jp/x", "<h1 class='ttl --lv1'>Not a book</h1>", "ipa", "detail"),
        ("https://x/y", "<p>", "nobody", "detail"),
    )
    assert set(got) == {"甲", "TRON", "T"}
    a = got["甲"]
    assert (a.authors, float(a.price), a.isbn) == (["乙", "丙"], 2200.0, "9784863541234")
    p = got["TRON"]
    assert (p.authors, str(p.published_at), p.isbn, float(p.price)) == (["X", "Y"], "2020-05-01", "9784893621234", 1100.0)
    assert p.ebook_stores[0].url == "https://www.personal-media.co.jp/webshop/book/9"
    t = got["T"]
    assert (t.url, str(t.published_at)) == ("https://www.oreilly.co.jp/books/9784873117782/", "2016-12-24")
    assert [r.url for r in raw.where("error is not null").collect()] == ["https://x/y"]


def test_broken_inputs_give_no_rows(spark):
    feed = spark.createDataFrame([("{broken",), (None,), ('{"list":{}}',)], "body string")
    assert explode_keyed_catalog(feed).count() == 0
    bodies = spark.createDataFrame([("a", bytearray(b"\x1f\x8bxx"), None), ("b", bytearray("é".encode()), "text/html; charset=bogus")], "url string, body binary, content_type string")
    assert {r.url: r.html for r in pages.decode_bodies(bodies).collect()} == {"a": None, "b": "é"}


def test_euc_jp(spark):
    body = bytearray("技術書".encode("euc_jp"))
    df = spark.createDataFrame([("a", body, 'text/html; Charset="EUC-JP"')], "url string, body binary, content_type string")
    assert pages.decode_bodies(df).first().html == "技術書"


def test_key_value_maps(spark):
    df = spark.createDataFrame([("<dl><dt>a<dd>1</dd><dt>b</dt><dd>2</dd></dl><th>c</th><td> 3 </td>", "k：v\nk\tw\nnone")], "h string, t string")
    r = df.select(pages.kv_tags(F.col("h")).alias("h"), pages.kv_lines(F.col("t")).alias("t")).first()
    assert r.t == {"k": "w"} and r.h["c"] == "3"


def test_links_of_untidy_markup(spark):
    page = """<!-- <a href="/no"> --><script>var x = '<a href="/no">'</script><A class=x HREF=/bare>1</a>
    <a title="a > b" href='/one?x=1&amp;y=2'>2</a><abbr href="/no"></abbr><a data-href="/no" href = "/last">3</a><a name=top>"""
    df = spark.createDataFrame([(1, page)], "page_id int, html string")
    assert [(r.pos, r.href) for r in pages.page_links(df).collect()] == [(0, "/bare"), (1, "/one?x=1&y=2"), (2, "/last")]


def test_meta_tags_of_untidy_markup(spark):
    page = """<meta name=author content=Ann><!-- <meta name="no" content="x"> --><meta content='a &amp; "b" > c' property="og:title"><title>T</title>"""
    row = spark.createDataFrame([(page,)], "html string").select(pages.meta_tags(F.col("html")).alias("m")).first()
    assert row.m == {"title": "T", "author": "Ann", "og:title": 'a & "b" > c'}


def test_broken_bodies_are_named(spark):
    rows = [(1, "é".encode("latin-1"), "text/html; charset=latin-1"), (2, b"\x1f\x8bnot gzip", None), (3, None, None), (4, "é".encode(), "text/html; charset=unknown")]
    got = pages.decode_bodies(spark.createDataFrame(rows, "id int, body binary, content_type string")).collect()
    assert sorted((r.id, r.html, r.error) for r in got) == [(1, "é", None), (2, None, "broken gzip body"), (3, None, None), (4, "é", None)]


def test_few_bodies_are_decoded_at_a_time(spark, monkeypatch):
    """Batches leave a worker in parts of a few bodies; other columns and the order of rows stay."""
    monkeypatch.setattr(pages, "BODIES", 3)
    rows = [(i, None if i == 5 else f"text {i}".encode(), None) for i in range(10)]
    df = spark.createDataFrame(rows, "id int, body binary, content_type string").coalesce(1)
    got = pages.decode_bodies(df)
    assert [tuple(r) for r in got.collect()] == [(i, None if i == 5 else f"text {i}", None) for i in range(10)]
    assert "ArrowEvalPython" not in got._jdf.queryExecution().executedPlan().toString()
