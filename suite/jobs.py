"""End-to-end jobs: search, details, lookup by ISBN, resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.operators.joins import robots_rules
from shelfmark.plans.by_isbn import books_by_isbn
from shelfmark.plans.details import book_details
from shelfmark.plans.resolve import REASON_EMPTY, REASON_ISBN, REASON_NO_MATCH, REASON_OTHER_BOOK, not_found, resolve
from shelfmark.plans.search import search
from shelfmark.sources.bibliography import bibliography_to_books, read_bibliography
from shelfmark.sources.registry import catalog_by_source
from shelfmark.storage import materialize

from . import views as v
from .columns import _AUTHOR_SQL, _AUTHORS_SQL, _MEAN_SQL, _SAME_SQL, _TITLE_SQL, VALIDATION_SQL, validation_columns
from .registry import query, table
from shelfmark.operators.ranking import clamp_limit

from .tables import ASKS, BIB_SQL, SOURCES_SQL, _ENRICH_SQL, asks, bib_books

col, lit = F.col, F.lit


@query("list_sources", v.with_views("""
SELECT ordinal, source_id, name, base_url, coalesce(n, 0) AS n_books FROM sources
LEFT JOIN (SELECT source_id, count(*) AS n FROM book GROUP BY source_id) USING (source_id)""", SOURCES_SQL))
def list_sources(spark, d):
    return catalog_by_source(v.sources(spark), v.catalog(spark, d))


@query("source_registry", v.with_views("""
SELECT k, s.ordinal, s.name, coalesce(s.language, 'ja') AS language, coalesce(s.scale, 'major') AS scale FROM book JOIN sources s USING (source_id)""", SOURCES_SQL))
def source_registry(spark, d):
    reg = F.broadcast(v.sources(spark))
    return v.catalog(spark, d).select(col("position").alias("k"), "source_id").join(reg, "source_id").select(
        "k", "ordinal", "name", F.coalesce("language", lit("ja")).alias("language"), F.coalesce("scale", lit("major")).alias("scale"))


@query("bibliography_to_books", v.with_views("""
SELECT isbn, title, subtitle, alternative_title, authors, contributors, publisher, published_at,
  coalesce(store_link, 'https://api.openbd.jp/v1/get?isbn=' || isbn) AS url, price, cover_image_url, description FROM bib""", BIB_SQL))
def bibliography_to_books_q(spark, d):
    b = bibliography_to_books(read_bibliography(v.batches(spark, d)))
    return b.select(
        "isbn", "title", "subtitle", "alternative_title",
        F.array_join("authors", "|").alias("authors"),
        F.array_join(F.transform("contributors", lambda x: F.concat_ws("=", x["name"], x["role"])), "|").alias("contributors"),
        "publisher", col("published_at").cast("string").alias("published_at"), "url",
        col("price").cast("double").alias("price"), "cover_image_url", "description")


@query("read_bibliography", v.with_views("SELECT isbn, bib_title AS title, bib_k AS k FROM bib", BIB_SQL))
def read_bibliography_q(spark, d):
    e = read_bibliography(v.batches(spark, d))
    n = F.regexp_extract(e.entry["onix"]["CollateralDetail"]["TextContent"][0]["Text"], "[0-9]+", 0)
    text = F.transform(e.entry["onix"]["CollateralDetail"]["TextContent"], lambda t: F.regexp_extract(t["Text"], "[0-9]+", 0))
    k = F.array_max(F.transform(text, lambda t: t.try_cast("bigint")))
    return e.select("isbn", col("entry.summary.title").alias("title"), k.alias("k"))


# --- Search ---

# Catalog rows as the search sees them: enriched, authors de-duplicated.
_SHELF_SQL = f"""
shelf AS (SELECT e.k, e.isbn, e.source_id, e.title, s.ordinal, s.scale, {v.sql_key('e.title')} AS t,
  list_transform(CASE WHEN e.authors_text = '' THEN []::VARCHAR[] ELSE string_split(e.authors_text, '|') END, lambda x: {v.sql_key('x')}) AS au
  FROM (SELECT b.k, b.isbn, b.source_id, b.title, CASE WHEN b.authors_text = '' THEN coalesce(bib.authors, '') ELSE b.authors_text END AS authors_text
    FROM book b LEFT JOIN bib USING (isbn)) e JOIN sources s USING (source_id))"""
_TOKENS_SQL = f"list_filter(list_transform(string_split(trim(replace(query, '　', ' ')), ' '), lambda x: {v.sql_key('x')}), lambda x: x <> '')"


def _ranked_sql(queries, limit):
    """Best rows per query and source, ranked over all sources."""
    return f"""
fq AS (SELECT query_id, title AS query, author AS query_author, publisher_id, {limit} AS n FROM {queries} WHERE title IS NOT NULL OR author IS NOT NULL),
forms AS (SELECT DISTINCT query, query_author, publisher_id FROM fq),
fk AS (SELECT *, {v.sql_key('query')} AS q, {v.sql_key('query_author')} AS a, {_TOKENS_SQL} AS toks FROM forms),
scored AS (SELECT query, query_author, publisher_id, source_id, k, ordinal, scale, {v.sql_round3(_MEAN_SQL)} AS match_score FROM fk JOIN shelf
  ON publisher_id IS NULL OR publisher_id = source_id),
cut AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query, query_author, publisher_id, source_id ORDER BY match_score DESC, k) AS rn
  FROM scored WHERE match_score > 0) WHERE rn <= 50),
ranked AS (SELECT query_id, source_id, k, match_score, row_number() OVER (PARTITION BY query_id ORDER BY match_score DESC,
  coalesce(scale, '') = 'minor', ordinal, k) AS rank FROM cut JOIN fq ON fq.query IS NOT DISTINCT FROM cut.query
  AND fq.query_author IS NOT DISTINCT FROM cut.query_author AND fq.publisher_id IS NOT DISTINCT FROM cut.publisher_id AND rn <= n)"""


def _requests(spark, d):
    """Queries as they come from outside, with their limit clamped."""
    return asks(spark, d).withColumn("limit", clamp_limit(col("limit")))


@query("search_books", v.with_views("""
SELECT query_id, rank, ranked.source_id, ranked.k, match_score, shelf.title, shelf.isbn FROM ranked JOIN shelf ON shelf.k = ranked.k""",
    BIB_SQL, SOURCES_SQL, _SHELF_SQL, ASKS, _ranked_sql("asks", 'least(coalesce("limit", 10), 50)')))
def search_books(spark, d):
    out = search(_requests(spark, d), v.catalog(spark, d), bib_books(spark, d), v.sources(spark), columns=["title", "isbn"])
    return out.select("query_id", "rank", "source_id", col("position").alias("k"), "match_score", "title", "isbn")


@query("search_books_source_order", v.with_views(f"""
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY match_score DESC, coalesce(scale, '') = 'minor', ordinal, k) AS rank,
  source_id, k, match_score FROM (SELECT query_id, source_id, k, ordinal, scale, {v.sql_round3(_MEAN_SQL)} AS match_score FROM (
    SELECT *, {v.sql_key('query')} AS q, {v.sql_key('query_author')} AS a, {_TOKENS_SQL} AS toks FROM (
    SELECT query_id, n, asks2.query, asks2.query_author, shelf.*, row_number() OVER (PARTITION BY query_id, source_id ORDER BY k) AS rn FROM (
      SELECT query_id, title AS query, author AS query_author, publisher_id, least(coalesce("limit", 10), 50) AS n FROM asks) asks2
    JOIN shelf ON (publisher_id IS NULL OR publisher_id = source_id) AND CASE WHEN source_id = 'pragprog' THEN
      (query IS NOT NULL OR query_author IS NOT NULL)
      AND (query IS NULL OR len(list_filter(string_split(lower(trim(query)), ' '), lambda x: NOT contains(lower(shelf.title || coalesce(' ' || description, '')), x))) = 0)
      AND (query_author IS NULL OR contains(lower(replace(authors_text, '|', ', ')), lower(query_author)))
      WHEN source_id = 'tatsu-zine' THEN contains(lower(shelf.title), lower(trim(query)))
      AND (query_author IS NULL OR contains(lower(replace(authors_text, '|', ' ')), lower(trim(query_author))))
      ELSE contains(lower(shelf.title), lower(trim(query))) END) WHERE rn <= CASE source_id WHEN 'google-books' THEN least(n, 40) ELSE n END)) WHERE match_score > 0""",
    BIB_SQL, SOURCES_SQL, _SHELF_SQL.replace("e.title, s.ordinal", "e.title, e.description, e.authors_text, s.ordinal").replace(
        "AS authors_text\n", "AS authors_text, bib.description\n"), ASKS))
def search_books_source_order(spark, d):
    out = search(_requests(spark, d), v.catalog(spark, d), bib_books(spark, d), v.sources(spark), "source_order")
    return out.select("query_id", "rank", "source_id", col("position").alias("k"), "match_score")


# --- By ISBN ---

def _inputs(spark, d):
    return dict(
        bib=bib_books(spark, d), registry=v.sources(spark), codes=v.isbn_codes(spark), page_books=v.page_books(spark, d),
        catalog=v.catalog(spark, d), secondary=v.secondary(spark, d), robots=robots_rules(v.shop_robots(spark), "librarybot"))


# The chain in SQL: link page, catalog of the owning source, bibliography; else fixed page, secondary.
_CHAIN_SQL = f"""
link_page AS (SELECT isbn, store_link AS url, min('Page ' || title) AS title FROM book WHERE k % 12 = 1 GROUP BY isbn, store_link),
fixed_page AS (SELECT isbn, min('Page ' || title) AS title FROM book WHERE k % 30 = 6 GROUP BY isbn),
owned AS (SELECT isbn, code_source AS source_id, min(k) AS k FROM book WHERE source_id = code_source GROUP BY isbn, code_source),
fallback AS (SELECT isbn, min(k) AS k FROM book WHERE k % 9 = 0 GROUP BY isbn),
chain AS (
  SELECT bib.isbn, 1 AS p, 'isbn:publisher' AS source, l.title, l.isbn AS book_isbn, 'gihyo' AS source_id, l.url FROM bib JOIN link_page l ON l.url = bib.store_link
    WHERE NOT (starts_with(bib.store_link, 'https://gihyo.jp/book/1') AND NOT starts_with(bib.store_link, 'https://gihyo.jp/book/11'))
  UNION ALL SELECT o.isbn, 2, 'isbn:publisher', b.title, b.isbn, o.source_id, b.url FROM owned o JOIN bib ON bib.isbn = o.isbn JOIN book b ON b.k = o.k
  UNION ALL SELECT isbn, 4, 'isbn:openbd', title, isbn, NULL, coalesce(store_link, 'https://api.openbd.jp/v1/get?isbn=' || isbn) FROM bib
  UNION ALL SELECT isbn, 1, 'isbn:publisher', title, isbn, 'oreilly-japan', 'https://www.oreilly.co.jp/books/' || isbn || '/' FROM fixed_page WHERE isbn NOT IN (SELECT isbn FROM bib)
  UNION ALL SELECT isbn, 2, 'isbn:calil', 'Secondary ' || k, isbn, NULL, 'https://secondary.example.com/book/' || isbn FROM fallback WHERE isbn NOT IN (SELECT isbn FROM bib)),
by_isbn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY isbn ORDER BY p) AS rn FROM chain) WHERE rn = 1)"""


def _isbn_out(df):
    return df.select("isbn", "source", col("book.title").alias("title"), col("book.source_id").alias("source_id"), col("book.url").alias("url"),
                     col("book.language").alias("language"))


_ISBN_COLS = "source, by_isbn.title, by_isbn.source_id, url, CASE WHEN source IS NULL THEN NULL WHEN by_isbn.source_id IN ('leanpub', 'pragprog') THEN 'en' ELSE 'ja' END AS language"


@query("isbn_resolve", v.with_views(f"SELECT isbn, {_ISBN_COLS} FROM by_isbn", BIB_SQL, _CHAIN_SQL))
def isbn_resolve(spark, d):
    from shelfmark.plans.by_isbn import by_isbn

    return _isbn_out(by_isbn(v.book_rows(spark, d).select("isbn"), **_inputs(spark, d)))


# Keyword listings of the owning source: a row of another book, for some ISBNs then one of the same.
_LISTED_SQL = """
listing AS (SELECT isbn AS keyword, code_source AS source_id, 2 * k AS position, 'Other ' || k AS title, NULL AS isbn, 'https://list.example.com/' || k AS url FROM book WHERE k % 7 = 3
  UNION ALL SELECT isbn, code_source, 2 * k + 1, 'Same ' || k, isbn, 'https://list.example.com/same/' || k FROM book WHERE k % 14 = 3),
listed AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY coalesce(isbn <> keyword, true), position) AS nth FROM listing
  WHERE source_id IS NOT NULL) WHERE nth = 1)"""
_LISTED_CHAIN_SQL = _CHAIN_SQL.replace("  UNION ALL SELECT isbn, 4,", """  UNION ALL SELECT l.keyword, 3, 'isbn:publisher', l.title, l.isbn, l.source_id, l.url FROM listed l JOIN bib ON bib.isbn = l.keyword
  UNION ALL SELECT isbn, 4,""")


@query("isbn_resolve_listing", v.with_views(f"SELECT isbn, {_ISBN_COLS} FROM by_isbn", BIB_SQL, _LISTED_SQL, _LISTED_CHAIN_SQL))
def isbn_resolve_listing(spark, d):
    """The chain with keyword listings: the row of the same ISBN, else a source's first row."""
    from shelfmark.plans.by_isbn import by_isbn

    rows = v.book_rows(spark, d)
    listed = lambda keep, place, word, isbn, path: rows.where(keep).select(
        col("isbn").alias("keyword"), col("code_source").alias("source_id"), place.alias("position"), F.concat(lit(word), col("k").cast("string")).alias("title"),
        isbn.alias("isbn"), F.concat(lit(path), col("k").cast("string")).alias("url"))
    root = "https://list.example.com/"
    listing = listed("k % 7 = 3", 2 * col("k"), "Other ", lit(None).cast("string"), root).unionByName(listed("k % 14 = 3", 2 * col("k") + 1, "Same ", col("isbn"), f"{root}same/"))
    return _isbn_out(by_isbn(rows.select("isbn"), **_inputs(spark, d), listing=listing.where("source_id is not null")))


_WANTED_SQL = "wanted AS (SELECT DISTINCT CASE WHEN k % 10 = 0 THEN '9780' || substring(isbn, 5, 9) ELSE isbn END AS isbn FROM book)"


@query("books_by_isbn", v.with_views(f"SELECT wanted.isbn, {_ISBN_COLS} FROM wanted LEFT JOIN by_isbn ON by_isbn.isbn = wanted.isbn", BIB_SQL, _CHAIN_SQL, _WANTED_SQL))
def books_by_isbn_q(spark, d):
    wanted = v.book_rows(spark, d).select(
        F.when(col("k") % 10 == 0, F.concat(lit("9780"), F.substring("isbn", 5, 9))).otherwise(col("isbn")).alias("isbn")).distinct()
    return _isbn_out(books_by_isbn(wanted, **_inputs(spark, d)))


# --- Details ---


@query("book_details", v.with_views("""
SELECT asked.url, CASE WHEN NOT starts_with(asked.url, 'https://gihyo.jp') THEN 'no source'
    WHEN starts_with(asked.url, 'https://gihyo.jp/book/1') AND NOT starts_with(asked.url, 'https://gihyo.jp/book/11') THEN 'robots.txt'
    WHEN p.title IS NULL THEN 'no record' ELSE 'ok' END AS outcome,
  CASE WHEN outcome = 'ok' THEN p.title END AS title, CASE WHEN outcome = 'ok' THEN bib.description END AS description,
  CASE WHEN outcome = 'ok' THEN 'B' || lpad(regexp_extract(asked.url, '[0-9]+$'), 9, '0') END AS asin
FROM (SELECT coalesce(store_link, url) AS url FROM book) asked
LEFT JOIN (SELECT isbn, store_link AS url, min('Page ' || title) AS title FROM book WHERE k % 12 = 1 GROUP BY isbn, store_link) p ON p.url = asked.url
LEFT JOIN bib ON bib.isbn = p.isbn""", BIB_SQL))
def book_details_q(spark, d):
    urls = v.book_rows(spark, d).select(F.coalesce("store_link", "url").alias("url"))
    i = _inputs(spark, d)
    good, bad = book_details(urls, i["page_books"], i["registry"], i["robots"], i["bib"])
    none = lit(None).cast("string")
    return good.select("url", lit("ok").alias("outcome"), "title", "description", "asin").unionByName(
        bad.select("url", col("reason").alias("outcome"), none.alias("title"), none.alias("description"), none.alias("asin")))


# --- Resolution (flagship) ---

_RESOLVE_SQL = (
    f"""
asked AS (SELECT clue_id, trim(isbn) AS isbn, CASE WHEN regexp_matches(replace(trim(isbn), '-', ''), '^(97[89][0-9]{{10}}|[0-9]{{9}}[0-9X])$')
  THEN replace(trim(isbn), '-', '') END AS asked, title, author, publisher_id FROM clues),
hit AS (SELECT a.*, b.source, b.title AS book_title, b.book_isbn FROM asked a JOIN by_isbn b ON b.isbn = a.asked),
rest AS (SELECT * FROM asked WHERE clue_id NOT IN (SELECT clue_id FROM hit)),
texts AS (SELECT clue_id AS query_id, title, author, publisher_id FROM rest),"""
    + _ranked_sql("texts", "5").lstrip("\n")
    + f""",
best AS (SELECT query_id AS clue_id, k, match_score, lead(match_score) OVER (PARTITION BY query_id ORDER BY rank) AS second, rank FROM ranked),
top AS (SELECT query_id AS clue_id, string_agg(k::VARCHAR, ',' ORDER BY rank) AS ks FROM ranked WHERE rank <= 3 GROUP BY query_id),
judged AS (
  SELECT clue_id, 'isbn' AS via, source, book_title, book_isbn, title AS query, asked, NULL::DOUBLE AS match_score, NULL::DOUBLE AS second, NULL AS isbn FROM hit
  UNION ALL SELECT r.clue_id, 'search', 'search', s.title, s.isbn, r.title, r.asked, b.match_score, b.second, r.isbn
    FROM rest r JOIN best b ON b.clue_id = r.clue_id AND b.rank = 1 JOIN shelf s ON s.k = b.k),
jk AS (SELECT *, {v.sql_key('query')} AS q, {v.sql_key('book_title')} AS t, {_TOKENS_SQL} AS toks FROM judged),
valid AS (SELECT clue_id, via, source, book_title, book_isbn, match_score, second, query, isbn, asked, {v.sql_round3(_TITLE_SQL)} AS title_score, {VALIDATION_SQL} FROM jk)"""
)

_OUT = "isbn_matches, isbn_title_agree, title_exact, same_work, edition_differs"
_AMB = "via = 'search' AND second IS NOT NULL AND match_score < 1 AND match_score >= 0.5::DOUBLE AND match_score - second < 0.1::DOUBLE"


_RESOLVE_ROWS = f"""
SELECT valid.clue_id, CASE WHEN {_AMB} THEN 'ambiguous' ELSE 'matched' END AS status,
  CASE WHEN via = 'isbn' THEN (CASE WHEN isbn_title_agree = 'false' THEN 'low' ELSE 'high' END)
    WHEN asked IS NOT NULL AND isbn_matches <> 'true' THEN 'low' WHEN match_score >= 0.9::DOUBLE THEN 'high' WHEN match_score >= 0.5::DOUBLE THEN 'medium' ELSE 'low' END AS confidence,
  book_title, book_isbn, CASE WHEN via = 'search' THEN match_score WHEN query IS NULL THEN 1::DOUBLE ELSE title_score END AS match_score, source, {_OUT},
  CASE WHEN {_AMB} THEN ks END AS candidates,
  CASE WHEN via = 'search' AND asked IS NOT NULL AND isbn_matches <> 'true' THEN '{REASON_OTHER_BOOK[0]}' || isbn || '{REASON_OTHER_BOOK[1]}' || coalesce(book_isbn, '{REASON_OTHER_BOOK[2]}') || '{REASON_OTHER_BOOK[3]}' END AS reason
FROM valid LEFT JOIN top ON top.clue_id = valid.clue_id
UNION ALL SELECT clue_id, 'not_found', 'low', NULL, NULL, 0::DOUBLE, 'none', 'null', 'null', 'null', NULL, 'null', NULL,
  CASE WHEN title IS NOT NULL OR author IS NOT NULL THEN '{REASON_NO_MATCH}' WHEN asked IS NOT NULL THEN '{REASON_ISBN[0]}' || isbn || '{REASON_ISBN[1]}' ELSE '{REASON_EMPTY}' END
  FROM rest WHERE clue_id NOT IN (SELECT clue_id FROM best)"""


@query("resolve_books", v.with_views(_RESOLVE_ROWS, v.CLUES, BIB_SQL, SOURCES_SQL, _SHELF_SQL, _CHAIN_SQL, _RESOLVE_SQL))
def resolve_books(spark, d):
    out = resolve(v.clue_rows(spark, d), **_inputs(spark, d))
    return resolved_columns(out)


@query("resolve_books_failed", v.with_views(f"""
SELECT * FROM ({_RESOLVE_ROWS}) WHERE clue_id % 9 <> 2
UNION ALL SELECT clue_id, 'not_found', 'low', NULL, NULL, 0::DOUBLE, 'none', 'null', 'null', 'null', NULL, 'null', NULL, 'no answer to clue ' || clue_id
FROM clues WHERE clue_id % 9 = 2""", v.CLUES, BIB_SQL, SOURCES_SQL, _SHELF_SQL, _CHAIN_SQL, _RESOLVE_SQL))
def resolve_books_failed(spark, d):
    """Clues of which some failed before they were looked up."""
    clues = v.clue_rows(spark, d)
    errors = clues.where("clue_id % 9 = 2").select("clue_id", F.concat(lit("no answer to clue "), col("clue_id").cast("string")).alias("message"))
    return resolved_columns(resolve(clues, **_inputs(spark, d), errors=errors))


def resolved_columns(out):
    """Results as plain columns."""
    return out.select(
        "clue_id", "status", "confidence",
        col("book.title").alias("book_title"), col("book.isbn").alias("book_isbn"),
        "match_score", "source", *validation_columns("validation"),
        F.array_join(F.transform("candidates", lambda c: c["book"]["position"].cast("string")), ",").alias("candidates"),
        "reason")


@query("resolve_error_row", """
SELECT event_id AS clue_id, 'not_found' AS status, 'low' AS confidence, 0::DOUBLE AS match_score, 'none' AS source, 'failed with ' || value AS reason
FROM events WHERE event_type = 'error'""")
def resolve_error_row(spark, d):
    failed = table(spark, d, "events").where("event_type = 'error'").select(
        col("event_id").alias("clue_id"), F.concat(lit("failed with "), col("value").cast("string")).alias("message"))
    like = spark.createDataFrame([], "clue_id bigint, status string, confidence string, book struct<title:string>, match_score double, "
                                     "source string, validation struct<isbn_matches:boolean>, candidates array<struct<match_score:double>>, reason string")
    return not_found(failed, col("message"), like).select("clue_id", "status", "confidence", "match_score", "source", "reason")
