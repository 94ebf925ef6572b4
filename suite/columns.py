"""Column operators and scores, each on whole derived tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions import dates, isbn, money, people, scoring, stores, text, urls
from shelfmark.operators.enrich import stamp_defaults, with_distinct_authors
from shelfmark.schemas import as_books
from shelfmark.sources.bibliography import text_by_type

from . import views as v
from .registry import query, table

col, lit = F.col, F.lit


def _s(name):
    """String form of a date or number column."""
    return col(name).cast("string").alias(name)


@query("collapse_ws", v.with_views(
    "SELECT k, p_name || ' ' || p_brand || ' x' AS title FROM book"))
def collapse_ws(spark, d):
    b = v.book_rows(spark, d)
    messy = F.concat(lit("　 "), "p_name", lit("\n\t　"), "p_brand", lit("  x "))
    return b.select("k", text.collapse_ws(messy).alias("title"))


@query("parse_bib_title", v.with_views("""
SELECT k, CASE WHEN k % 4 = 0 THEN p_name ELSE bib_title END AS title,
  CASE WHEN k % 4 = 0 THEN 'volume ' || p_size END AS subtitle,
  CASE WHEN k % 4 = 0 THEN p_type END AS alternative_title FROM book"""))
def parse_bib_title(spark, d):
    return v.book_rows(spark, d).select("k", text.bibliographic_title(col("bib_title")).alias("t")).select("k", "t.*")


@query("clean_title", v.with_views("""
SELECT k, p_name AS no_marks, p_name || ' ' || p_type AS joined, p_name AS unquoted, p_name AS no_site,
  CASE WHEN k % 2 = 0 THEN p_brand || ' ' || p_name || ' ―' || p_type ELSE p_name END AS composed FROM book"""))
def clean_title(spark, d):
    b = v.book_rows(spark, d)
    even = col("k") % 2 == 0
    return b.select(
        "k",
        text.strip_format_marks(F.concat("p_name", lit("【PDF版】 【EPUB版】　"))).alias("no_marks"),
        text.join_title_lines(F.concat(lit("【集】\n\t"), "p_name", lit("\n\n　"), "p_type")).alias("joined"),
        text.strip_outer_quotes(F.concat(lit("『"), "p_name", lit("』"))).alias("unquoted"),
        text.strip_site_name(F.concat("p_name", lit(" | 書店.jp")), "\\s*[|｜]\\s*書店.*$").alias("no_site"),
        text.title_with_parts(
            col("p_name"), F.when(even, col("p_type")), F.when(even, col("p_brand")).otherwise("")
        ).alias("composed"),
    )


@query("normalize_for_match", v.with_views(f"SELECT k, {v.sql_key('title')} AS title_key FROM book"))
def normalize_for_match(spark, d):
    return v.book_rows(spark, d).select("k", text.match_key(col("title")).alias("title_key"))


@query("strip_edition", v.with_views(f"""
SELECT k, {v.sql_edition(v.sql_key('title'))} AS stripped,
  CASE WHEN k % 7 = 0 OR k % 13 = 0 THEN 'yes' ELSE 'no' END AS has_edition FROM book"""))
def strip_edition(spark, d):
    b = v.book_rows(spark, d).select("k", text.match_key(col("title")).alias("key"))
    return b.select(
        "k",
        text.strip_edition(col("key")).alias("stripped"),
        F.when(text.has_edition(col("key")), "yes").otherwise("no").alias("has_edition"),
    )


@query("normalize_isbn", v.with_views("SELECT k, isbn AS clean, 'ISBN' || isbn AS first_only FROM book"))
def normalize_isbn(spark, d):
    b = v.book_rows(spark, d)
    dashed = F.concat(lit("isbn 978-4-"), F.substring("isbn", 5, 8), lit(" - "), F.substring("isbn", 13, 1))
    return b.select(
        "k",
        isbn.normalize_isbn(dashed).alias("clean"),
        isbn.normalize_isbn(F.concat(lit("Isbn isbn "), "isbn")).alias("first_only"),
    )


@query("looks_like_isbn", v.with_views("""
SELECT k, 'yes' AS plain, CASE WHEN k % 2 = 0 THEN 'yes' ELSE 'no' END AS ten, 'no' AS short FROM book"""))
def looks_like_isbn(spark, d):
    yes = lambda c: F.when(isbn.looks_like_isbn(c), "yes").otherwise("no")
    nine = F.substring("isbn", 4, 9)
    return v.book_rows(spark, d).select(
        "k",
        yes(col("isbn")).alias("plain"),
        yes(F.concat(nine, F.when(col("k") % 2 == 0, "x").otherwise("y"))).alias("ten"),
        yes(F.substring("isbn", 1, 12)).alias("short"),
    )


@query("isbn10_to_13", v.with_views("SELECT k, isbn AS isbn13 FROM book"))
def isbn10_to_13(spark, d):
    return v.book_rows(spark, d).select(
        "k", isbn.as_isbn13(F.concat(F.substring("isbn", 4, 9), lit("-X"))).alias("isbn13")
    )


@query("extract_isbn", v.with_views("""
SELECT k, isbn AS a, isbn AS b, CASE WHEN k % 3 = 0 THEN NULL ELSE isbn END AS c, isbn AS d, isbn AS e, isbn AS f,
  isbn AS g, isbn AS h, isbn AS i FROM book"""))
def extract_isbn(spark, d):
    x = isbn.extract_isbn
    dashed = F.concat(lit("978-4-"), F.substring("isbn", 5, 8), lit("-"), F.substring("isbn", 13, 1))
    return v.book_rows(spark, d).select(
        "k",
        x(F.concat(lit("定価 1,000円 ISBN"), F.substring("isbn", 4, 9), lit("0 x")), "any").alias("a"),
        x(F.concat(lit("コード: "), dashed, lit(" 頁 12")), "digit_run").alias("b"),
        x(F.concat(lit("ISBNコード："), dashed, F.when(col("k") % 3 == 0, "-1").otherwise("")), "labelled").alias("c"),
        x(F.concat(lit("<p>"), dashed, lit("</p>")), "prefixed").alias("d"),
        x(F.concat(lit("id "), "isbn", lit(" end")), "plain").alias("e"),
        x(F.concat(dashed, lit(".JPG")), "image_name").alias("f"),
        x(F.concat(lit("https://s.example/book/2022/"), dashed), "url_tail").alias("g"),
        x(F.concat(lit("ISBN"), dashed), "digit_led").alias("h"),
        x(F.concat(lit("x"), "isbn", lit("y")), "any").alias("i"),
    )


@query("parse_price", v.with_views("""
SELECT k, floor(p_retailprice)::BIGINT AS a, NULL::BIGINT AS b, floor(p_retailprice)::BIGINT AS c FROM book"""))
def parse_price(spark, d):
    shown = F.format_number(F.floor("p_retailprice"), 0)
    return v.book_rows(spark, d).select(
        "k",
        money.parse_price(F.concat(lit("本体 ¥"), shown, lit("円（2刷）"))).alias("a"),
        money.parse_price(F.concat(lit("未定, "), "p_name")).alias("b"),
        money.parse_yen_price(F.concat(shown, lit("円 (税込)"))).alias("c"),
    )


@query("tax_inclusive_price", v.with_views("""
SELECT k, CASE WHEN k % 4 = 3 THEN floor(p_retailprice)::BIGINT ELSE floor(floor(p_retailprice) * 1.1::DOUBLE)::BIGINT END AS marked,
  CASE WHEN k % 2 = 0 THEN floor(floor(p_retailprice) * 1.1::DOUBLE)::BIGINT ELSE floor(p_retailprice)::BIGINT END AS labelled FROM book"""))
def tax_inclusive_price(spark, d):
    b = v.book_rows(spark, d)
    amount = F.floor("p_retailprice").cast("string")
    mark = F.element_at(F.array(*[lit(x) for x in ("＋税", "税別", " 本体", "（税込）")]), (col("k") % 4 + 1).cast("int"))
    b = b.select(
        "k",
        F.concat(lit("価格："), amount, lit("円"), mark).alias("m"),
        F.concat(lit("本体"), amount, lit("円（税抜"), F.when(col("k") % 2 == 0, "）").otherwise("・税込）")).alias("n"),
    )
    return b.select(
        "k",
        money.tax_inclusive(money.parse_price(col("m")), col("m"), "mark").alias("marked"),
        money.tax_inclusive(money.parse_price(col("n")), col("n"), "label").alias("labelled"),
    )


@query("parse_usd_price", v.with_views("""
SELECT k, CASE WHEN k % 3 = 0 THEN NULL ELSE round(p_retailprice, 2) END AS price,
  CASE WHEN k % 3 = 0 THEN NULL ELSE 'USD' END AS currency FROM book"""))
def parse_usd_price(spark, d):
    b = v.book_rows(spark, d)
    shown = F.when(col("k") % 3 == 0, "free").otherwise(F.concat(lit("$ "), F.format_number(F.round("p_retailprice", 2), 2)))
    b = b.select("k", money.parse_usd(F.concat(lit("eBook "), shown, lit(" (USD)"))).alias("p"))
    return b.select("k", col("p").cast("double").alias("price"), money.currency_if_priced(col("p"), "USD").alias("currency"))


@query("typed_price", v.with_views("""
SELECT k, CASE WHEN bib_amount IS NULL THEN NULL ELSE floor(p_retailprice)::BIGINT END AS price FROM book"""))
def typed_price(spark, d):
    price = lambda t, a: F.struct(lit(t).alias("PriceType"), a.alias("PriceAmount"))
    return v.book_rows(spark, d).select(
        "k", money.typed_price(F.array(price("01", lit("5")), price("03", col("bib_amount")), price("03", lit("7")))).alias("price")
    )


@query("parse_date", v.with_views("""
SELECT k, CASE WHEN k % 5 IN (0, 4) THEN strftime(make_date(1990 + k % 30, 1 + k % 12, 1 + k % 28), '%Y-%m-%d')
    WHEN k % 5 = 1 THEN strftime(make_date(1990 + k % 30, 1 + k % 12, 1), '%Y-%m-%d') END AS compact,
  CASE k % 3 WHEN 0 THEN '2021-01-01' WHEN 1 THEN '2021-04-01' ELSE '2021-04-' || lpad((1 + k % 28)::VARCHAR, 2, '0') END AS volume,
  strftime(make_date(2000 + k % 20, 1 + k % 12, 1 + k % 28), '%Y-%m-%d') AS kanji,
  strftime(make_date(2000 + k % 20, 1 + k % 12, 1 + k % 28), '%Y-%m-%d') AS slash,
  CASE WHEN 1 + k % 12 > 9 AND 1 + k % 28 > 9 THEN strftime(make_date(2000 + k % 20, 1 + k % 12, 1 + k % 28), '%Y-%m-%d') END AS slash_padded,
  strftime(make_date(2000 + k % 20, 1 + k % 12, 1 + k % 28), '%Y-%m-%d') AS dot,
  strftime(make_date(2000 + k % 20, 1 + k % 12, 1), '%Y-%m-%d') AS kanji_month,
  strftime(make_date(2000 + k % 20, 1 + k % 12, 1), '%Y-%m-%d') AS english_month FROM book"""))
def parse_date(spark, d):
    y, m, dd = [(col("k") % n + o).cast("string") for n, o in ((20, 2000), (12, 1), (28, 1))]
    month = F.initcap(F.element_at(F.array(*[lit(x) for x in dates.MONTHS]), (col("k") % 12 + 1).cast("int")))
    vol = F.when(col("k") % 3 == 0, "2021").when(col("k") % 3 == 1, "2021-04").otherwise(
        F.concat(lit("2021-04-"), F.lpad(dd, 2, "0"), lit("T00")))
    p = dates.parse_date
    slashed = F.concat_ws("/", y, m, dd)
    out = {
        "compact": p(col("bib_pubdate"), "compact"),
        "volume": p(vol, "volume"),
        "kanji": p(F.concat(lit("発売日 "), y, lit("年"), m, lit("月"), dd, lit("日")), "kanji"),
        "slash": p(F.concat(slashed, lit(" 発売")), "slash"),
        "slash_padded": p(slashed, "slash_padded"),
        "dot": p(F.concat_ws(".", y, m, dd), "dot"),
        "kanji_month": dates.first_date(F.concat(y, lit("年"), m, lit("月")), "kanji", "kanji_month"),
        "english_month": p(F.concat(lit("Published: "), month, lit(" "), y), "english_month"),
    }
    return v.book_rows(spark, d).select("k", *[c.cast("string").alias(n) for n, c in out.items()])


@query("split_authors", v.with_views("""
SELECT k, author1 || '|' || p_brand AS bibliography, author1 || '|Paul|' || p_brand AS english,
  author1 || '|' || p_type AS listed FROM book"""))
def split_authors(spark, d):
    b = v.book_rows(spark, d)
    join = lambda c: F.array_join(c, "|")
    return b.select(
        "k",
        join(people.split_authors(col("bib_author"), "bibliography", people.strip_role_word)).alias("bibliography"),
        join(people.split_authors(F.concat("author1", lit(" with Paul, and "), "p_brand"), "english")).alias("english"),
        join(people.split_authors(F.concat("author1", lit("[x]，、 "), "p_type", lit("[y]")), "ideographic",
                                  lambda n: people.strip_brackets(n, "square"))).alias("listed"),
    )


@query("strip_author_role", v.with_views("""
SELECT k, author1 AS a, author1 AS b, author1 AS c, author1 AS d, p_brand || '著者' AS e FROM book"""))
def strip_author_role(spark, d):
    role = F.element_at(F.array(*[lit(x) for x in people.ROLE_WORDS.split("|")]), (col("k") % 8 + 1).cast("int"))
    return v.book_rows(spark, d).select(
        "k",
        people.strip_role_word(F.concat("author1", lit("　"), role, lit("　 "))).alias("a"),
        people.strip_trailing_parens(F.concat("author1", lit(" （"), role, lit(")"))).alias("b"),
        text.trim_blanks(people.strip_brackets(F.concat("author1", lit("(所属) ")), "round")).alias("c"),
        people.strip_colon_role(F.concat("author1", lit(":監修"))).alias("d"),
        people.strip_role_word(F.concat("p_brand", lit("著者"))).alias("e"),
    )


@query("format_person_name", v.with_views("""
SELECT k, 'First ' || p_brand AS a, '山田 ' || p_brand AS b, 'One Name' AS c FROM book"""))
def format_person_name(spark, d):
    return v.book_rows(spark, d).select(
        "k",
        people.format_person_name(F.concat("p_brand", lit(",  First, 1950-"))).alias("a"),
        people.format_person_name(F.concat(lit("山田, "), "p_brand")).alias("b"),
        people.format_person_name(lit(" One   Name ")).alias("c"),
    )


@query("contributors", v.with_views("""
SELECT k, 'Ann X=author|J ' || p_brand || '=translator|' || author1 || '=author' AS people FROM book"""))
def contributors(spark, d):
    person = lambda seq, role, name: F.struct(
        seq.alias("SequenceNumber"), role.alias("ContributorRole"), F.struct(name.alias("content")).alias("PersonName"))
    entries = F.array(
        person(lit("10"), F.array(lit("Z99")), col("author1")),
        person(lit("2"), F.array(lit(""), lit("B06")), F.concat("p_brand", lit(", J, 1950-"))),
        person(lit("3"), F.array(lit("A01")), lit("  ")),
        person(lit(None).cast("string"), lit(None).cast("array<string>"), lit("Ann  X")),
    )
    c = people.contributors(entries)
    return v.book_rows(spark, d).select(
        "k", F.array_join(F.transform(c, lambda x: F.concat_ws("=", x["name"], x["role"])), "|").alias("people"))


_AUTHORS_SQL = """CASE WHEN k % 5 = 4 THEN '' WHEN k % 10 = 3 THEN author1
  WHEN k % 3 = 1 AND lower(split_part(p_name, ' ', 1) || (k % 53)) <> lower(replace(author1, ' ', '')) THEN authors_text
  ELSE author1 END"""


@query("dedupe_authors", v.with_views(f"SELECT k, {_AUTHORS_SQL} AS authors FROM book"))
def dedupe_authors(spark, d):
    return with_distinct_authors(v.catalog(spark, d)).select(
        col("position").alias("k"), F.array_join("authors", "|").alias("authors"))


@query("author_fallback", v.with_views("""
SELECT k, CASE WHEN k % 2 = 0 THEN 'Ann|' || p_brand ELSE author1 || '|' || p_brand END AS authors FROM book"""))
def author_fallback(spark, d):
    who = lambda n: F.struct(n.alias("name"), lit("author").alias("role"))
    known = F.when(col("k") % 2 == 0, F.array(who(lit("Ann")), who(col("p_brand")), who(lit("ＡＮＮ"))))
    b = v.book_rows(spark, d).withColumn("c", known)
    return b.select("k", F.array_join(people.bibliography_authors(col("c"), col("bib_author")), "|").alias("authors"))


@query("text_by_type", v.with_views("""
SELECT k, CASE WHEN bib_text03 <> '' THEN bib_text03 ELSE bib_text02 END AS description FROM book"""))
def text_by_type_q(spark, d):
    entry = lambda t, c: F.struct(lit(t).alias("TextType"), c.alias("Text"))
    texts = F.array(entry("02", col("bib_text02")), entry("03", col("bib_text03")), entry("03", lit("later")))
    return v.book_rows(spark, d).select("k", text_by_type(texts, "03", "02").alias("description"))


@query("strip_html", """
SELECT page_id, length(regexp_replace(html, '<[^>]+>', '', 'g')) AS n_plain, md5(regexp_replace(html, '<[^>]+>', '', 'g')) AS plain,
  md5(replace(regexp_replace(regexp_replace(html, '(?i)<br\\s*/?>', chr(10), 'g'), '<[^>]+>', '', 'g'), '&nbsp;', ' ')) AS block
FROM pages""")
def strip_html(spark, d):
    return table(spark, d, "pages").select(
        "page_id",
        F.length(text.strip_html(col("html"))).alias("n_plain"),
        F.md5(text.strip_html(col("html"))).alias("plain"),
        F.md5(text.html_block_text(col("html"))).alias("block"),
    )


_HOST = "regexp_extract(url, '^[a-z]+://[^/?#]*')"


@query("resolve_url", f"""
SELECT page_id, {_HOST} || '/x/y' AS rooted, regexp_extract(url, '^[a-z]+:') || '//cdn.example.com/z' AS no_scheme,
  regexp_extract(url, '^[^?#]*') || '?q=1' AS query_only, regexp_extract(url, '^[^?#]*/') || 'next.html#a' AS sibling,
  {_HOST} || '/up' AS parent, 'https://other.example.com/' AS absolute, regexp_replace(url, '^http://', 'https://') AS secure
FROM pages""")
def resolve_url(spark, d):
    base = col("url")
    r = lambda ref: urls.resolve_url(base, lit(ref))
    return table(spark, d, "pages").select(
        "page_id",
        r("/x/./y").alias("rooted"),
        r("//cdn.example.com/z").alias("no_scheme"),
        r("?q=1").alias("query_only"),
        r("next.html#a").alias("sibling"),
        r("../../../up").alias("parent"),
        r("https://other.example.com").alias("absolute"),
        urls.force_https(base).alias("secure"),
    )


# Store links by the remainder of the row number; the second part tells what must come out.
_LINKS = [
    ("https://www.amazon.co.jp/dp/B0", "Kindle", "drm"),
    ("https://tatsu-zine.com/books/", "達人出版会", "social"),
    ("https://tatsu-zine.com/books/pub/", None, None),
    ("https://gihyo.jp/dp/ebook/2020/", "Gihyo Digital Publishing", "social"),
    ("https://www.saiensu.co.jp/?", "サイエンス社", "password_pdf"),
    ("https://honto.jp/ebook/", "honto", "drm"),
    ("https://techbookfest.org/product/", "技術書典", "free"),
    ("https://unknown.example.com/", None, None),
]


def _pick(values, k="k"):
    return F.element_at(F.array(*[lit(x) for x in values]), (col(k) % len(values) + 1).cast("int"))


def _case(values, k="k"):
    whens = " ".join(f"WHEN {i} THEN " + ("NULL" if x is None else f"'{x}'") for i, x in enumerate(values))
    return f"CASE {k} % {len(values)} {whens} END"


@query("classify_store", v.with_views(
    f"SELECT k, {_case([x[1] for x in _LINKS])} AS store, {_case([x[2] for x in _LINKS])} AS drm FROM book"))
def classify_store(spark, d):
    b = v.book_rows(spark, d).withColumn("link", F.concat(_pick([x[0] for x in _LINKS]), col("k").cast("string")))
    return b.select("k", stores.classify_store(col("link")).alias("s")).select("k", col("s.name").alias("store"), "s.drm")


@query("extract_asin", v.with_views("""
SELECT k, CASE k % 3 WHEN 0 THEN 'B' || lpad(k::VARCHAR, 9, '0') WHEN 1 THEN '4' || lpad(k::VARCHAR, 9, '0') END AS asin,
  CASE WHEN k % 3 = 0 THEN 'B' || lpad(k::VARCHAR, 9, '0') END AS from_stores FROM book"""))
def extract_asin(spark, d):
    code = F.lpad(col("k").cast("string"), 9, "0")
    paper = F.concat(lit(" https://www.amazon.co.jp/gp/product/4"), code)
    kindle = F.concat(lit(" https://www.amazon.co.jp/dp/B"), code)
    links = F.when(col("k") % 3 == 0, F.concat(paper, kindle)).when(col("k") % 3 == 1, paper).otherwise("none")
    store = lambda u: F.struct(lit("s").alias("name"), u.alias("url"), lit("drm").alias("drm"))
    listed = F.when(col("k") % 3 == 0, F.array(store(lit("https://x.example")), store(paper), store(kindle)))
    return v.book_rows(spark, d).select(
        "k", stores.extract_asin(links).alias("asin"), stores.asin_from_stores(listed).alias("from_stores"))


_GUIDES = [
    ("ソーシャルDRM・パスワード", "social"), ("このPDFはdrm-FREEです", "free"), ("DRMフリー", "free"),
    ("パスワードが必要", "password_pdf"), ("案内なし", "social"),
]


@query("drm_from_text", v.with_views(f"SELECT k, {_case([x[1] for x in _GUIDES])} AS drm FROM book"))
def drm_from_text(spark, d):
    return v.book_rows(spark, d).select("k", stores.drm_from_text(F.concat(_pick([x[0] for x in _GUIDES]), "p_name")).alias("drm"))


@query("drm_label", v.with_views(f"SELECT k, {_case(list(stores.DRM_LABELS.values()))} AS label FROM book"))
def drm_label(spark, d):
    return v.book_rows(spark, d).select("k", stores.drm_label(_pick(list(stores.DRM_LABELS))).alias("label"))


@query("stamp_defaults", v.with_views("""
SELECT k, CASE WHEN k % 10 = 0 THEN 'fr' WHEN source_id IN ('leanpub', 'pragprog') THEN 'en' ELSE 'ja' END AS language,
  CASE WHEN price IS NOT NULL THEN 'JPY' END AS currency,
  CASE k % 4 WHEN 0 THEN 'OWN' WHEN 1 THEN 'B' || lpad(k::VARCHAR, 9, '0') END AS asin FROM book"""))
def stamp_defaults_q(spark, d):
    books = v.catalog(spark, d)
    k = col("position")
    link = F.concat(lit("https://www.amazon.co.jp/dp/B"), F.lpad(k.cast("string"), 9, "0"))
    books = as_books(
        books.withColumn("language", F.when(k % 10 == 0, "fr"))
        .withColumn("asin", F.when(k % 4 == 0, "OWN"))
        .withColumn("ebook_stores", F.when(k % 4 < 2, F.array(F.struct(lit("Kindle").alias("name"), link.alias("url"), lit("drm").alias("drm")))))
    )
    return stamp_defaults(books, v.sources(spark)).select(k.alias("k"), "language", "currency", "asin")


# --- Scores: every book against two clues, those of its number and the one before, counted around ---

_PAIRS = """
pairs AS (SELECT c.clue_id, c.title AS query, c.author AS query_author, b.* FROM (SELECT *, count(*) OVER () AS n FROM clues) c JOIN book b
  ON b.k % n = c.clue_id % n OR b.k % n = (c.clue_id + 1) % n),
keyed AS (SELECT *, """ + v.sql_key("query") + " AS q, " + v.sql_key("title") + " AS t, " + v.sql_key("query_author") + """ AS a,
  list_filter(list_transform(string_split(replace(query, '　', ' '), ' '), lambda x: """ + v.sql_key("x") + """), lambda x: x <> '') AS toks,
  list_transform(CASE WHEN authors_text = '' THEN []::VARCHAR[] ELSE string_split(authors_text, '|') END, lambda x: """ + v.sql_key("x") + """) AS au
  FROM pairs)"""
_TITLE_SQL = """(CASE WHEN q IS NULL OR q = '' THEN 0::DOUBLE WHEN q = t THEN 1::DOUBLE
  WHEN len(list_filter(toks, lambda x: contains(t, x))) = 0 THEN 0::DOUBLE
  ELSE least(0.9::DOUBLE, 0.9::DOUBLE * (len(list_filter(toks, lambda x: contains(t, x)))::DOUBLE / len(toks)::DOUBLE)) END)"""
_AUTHOR_SQL = "coalesce(list_max(list_transform(au, lambda x: " + v.sql_contain("a", "x") + ")), 0::DOUBLE)"
_MEAN_SQL = f"""(CASE WHEN query IS NOT NULL AND query_author IS NOT NULL THEN ({_TITLE_SQL} + {_AUTHOR_SQL}) / 2::DOUBLE
  WHEN query IS NOT NULL THEN {_TITLE_SQL} WHEN query_author IS NOT NULL THEN {_AUTHOR_SQL} ELSE 0::DOUBLE END)"""


def _scored(sql):
    return v.with_views(f"SELECT clue_id, k, {sql} FROM keyed", v.CLUES, _PAIRS)


def _keyed(spark, d):
    b, c = v.book_rows(spark, d), v.clue_rows(spark, d)
    n = c.count()
    near = c.withColumn("place", F.explode(F.array(col("clue_id") % n, (col("clue_id") + 1) % n)))
    asked = near.select("clue_id", "place", col("isbn").alias("clue_isbn"), col("title").alias("query"), col("author").alias("query_author"))
    pairs = asked.join(b.withColumn("place", col("k") % n), "place").drop("place")
    authors = F.when(col("authors_text") == "", F.array().cast("array<string>")).otherwise(F.split("authors_text", "[|]"))
    return pairs.select(
        "*",
        text.match_key(col("query")).alias("q"),
        text.match_key(col("title")).alias("t"),
        text.match_key(col("query_author")).alias("a"),
        text.token_keys(col("query")).alias("toks"),
        text.match_keys(authors).alias("au"),
    )


def _title():
    return scoring.title_match_score(col("q"), col("toks"), col("t"))


def _author():
    return scoring.author_match_score(col("a"), col("au"))


@query("containment_score", _scored(v.sql_contain("q", "t") + " AS score"))
def containment_score(spark, d):
    return _keyed(spark, d).select("clue_id", "k", scoring.containment_score(col("q"), col("t")).alias("score"))


@query("title_match_score", _scored(f"{_TITLE_SQL} AS score"))
def title_match_score(spark, d):
    return _keyed(spark, d).select("clue_id", "k", _title().alias("score"))


@query("author_match_score", _scored(f"{_AUTHOR_SQL} AS score"))
def author_match_score(spark, d):
    return _keyed(spark, d).select("clue_id", "k", _author().alias("score"))


def _mean(df):
    df = df.withColumn("ts", _title()).withColumn("au_s", _author())
    return df.withColumn("score", scoring.mean_score(col("ts"), col("au_s"), col("query").isNotNull(), col("query_author").isNotNull()))


@query("match_score", _scored(f"{_MEAN_SQL} AS score"))
def match_score(spark, d):
    return _mean(_keyed(spark, d)).select("clue_id", "k", "score")


_SAME_SQL = v.sql_contain(v.sql_edition("q"), v.sql_edition("t"))


@query("same_work_score", _scored(f"{_SAME_SQL} AS score"))
def same_work_score(spark, d):
    return _keyed(spark, d).select("clue_id", "k", scoring.same_work_score(col("q"), col("t")).alias("score"))


@query("title_exact", _scored("CASE WHEN q <> '' AND q = t THEN 'yes' ELSE 'no' END AS exact"))
def title_exact(spark, d):
    return _keyed(spark, d).select("clue_id", "k", F.when(scoring.title_exact(col("q"), col("t")), "yes").otherwise("no").alias("exact"))


@query("round3", _scored(f"{v.sql_round3(_MEAN_SQL)} AS score"))
def round3(spark, d):
    return _mean(_keyed(spark, d)).select("clue_id", "k", scoring.round3(col("score")).alias("score"))


@query("confidence", _scored(f"CASE WHEN {_MEAN_SQL} >= 0.9::DOUBLE THEN 'high' WHEN {_MEAN_SQL} >= 0.5::DOUBLE THEN 'medium' ELSE 'low' END AS grade"))
def confidence(spark, d):
    return _mean(_keyed(spark, d)).select("clue_id", "k", scoring.confidence(col("score")).alias("grade"))


VALIDATION_SQL = f"""
  CASE WHEN asked IS NULL THEN 'null' WHEN coalesce(book_isbn = asked, FALSE) THEN 'true' ELSE 'false' END AS isbn_matches,
  CASE WHEN query IS NULL THEN 'null' WHEN {_SAME_SQL} >= 0.5::DOUBLE THEN 'true' ELSE 'false' END AS isbn_title_agree,
  CASE WHEN query IS NULL THEN 'null' WHEN q <> '' AND q = t THEN 'true' ELSE 'false' END AS title_exact,
  CASE WHEN query IS NULL THEN NULL ELSE {v.sql_round3(_SAME_SQL)} END AS same_work,
  CASE WHEN query IS NOT NULL AND NOT coalesce(book_isbn = asked, FALSE) AND {_SAME_SQL} >= 0.5::DOUBLE AND q <> t
    AND ({v.sql_edition('q')} <> q OR {v.sql_edition('t')} <> t) THEN 'true' ELSE 'false' END AS edition_differs"""


def validation_columns(prefix="v"):
    flags = ["isbn_matches", "isbn_title_agree", "title_exact", "edition_differs"]
    return [F.coalesce(col(f"{prefix}.{f}").cast("string"), lit("null")).alias(f) for f in flags] + [col(f"{prefix}.same_work").alias("same_work")]


@query("validation", v.with_views(
    "SELECT clue_id, k, " + VALIDATION_SQL + " FROM (SELECT *, CASE WHEN clue_id % 2 = 0 THEN lpad(clue_id::VARCHAR, 13, '9') END AS asked,"
    " CASE WHEN clue_id % 4 = 0 THEN lpad(clue_id::VARCHAR, 13, '9') WHEN clue_id % 6 = 2 THEN NULL ELSE isbn END AS book_isbn FROM keyed)",
    v.CLUES, _PAIRS))
def validation(spark, d):
    fake = F.lpad(col("clue_id").cast("string"), 13, "9")
    df = _keyed(spark, d).select(
        "*",
        F.when(col("clue_id") % 2 == 0, fake).alias("asked"),
        F.when(col("clue_id") % 4 == 0, fake).when(col("clue_id") % 6 == 2, None).otherwise(col("isbn")).alias("book_isbn"),
    )
    return df.select(
        "clue_id", "k", scoring.validation(col("asked"), F.when(col("query").isNotNull(), col("q")), col("book_isbn"), col("t")).alias("v")
    ).select("clue_id", "k", *validation_columns())
