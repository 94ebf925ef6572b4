"""Filters, joins, summaries, windows and set operations on whole derived tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions import scoring, text, urls
from shelfmark.operators import filters, joins, ranking, summary
from shelfmark.operators.enrich import enrich
from shelfmark.operators.keyword_join import keyword_filter, token_and_filter
from shelfmark.operators.score_join import score_join
from shelfmark.sources.bibliography import bibliography_to_books, read_bibliography
from shelfmark.sources.registry import ISBN_CODES, SOURCES
from shelfmark.storage import materialize

from . import views as v
from .columns import _AUTHOR_SQL, _AUTHORS_SQL, _MEAN_SQL, _PAIRS, _case, _keyed, _mean, _pick
from .registry import query, table

col, lit = F.col, F.lit

# The registry as SQL, for the other engine.
SOURCES_SQL = "sources AS (SELECT * FROM (VALUES " + ", ".join(
    "(" + ", ".join("NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x) for x in (*s, i)) + ")"
    for i, s in enumerate(SOURCES)
) + ") AS s(source_id, name, base_url, language, scale, detail_url_template, ordinal))"
CODES_SQL = "codes AS (SELECT * FROM (VALUES " + ", ".join(f"('{s}', '{c}')" for s, c in ISBN_CODES) + ") AS c(source_id, code))"

# One keyword query per customer.
ASKS = """
asks AS (SELECT c.c_custkey AS query_id,
  CASE c.c_custkey % 4 WHEN 0 THEN split_part(b.p_name, ' ', 2) || ' ' || b.p_type WHEN 1 THEN '  ' || b.p_name || ' '
    WHEN 3 THEN b.p_name || ' ' || b.p_size ELSE NULL END AS title,
  CASE WHEN c.c_custkey % 3 = 0 THEN b.author1 ELSE NULL END AS author,
  CASE WHEN c.c_custkey % 10 = 0 THEN b.source_id ELSE NULL END AS publisher_id,
  CASE WHEN c.c_custkey % 7 = 0 THEN NULL ELSE cast(c.c_custkey % 60 AS int) END AS "limit"
  FROM customer c JOIN book b ON b.k = c.c_custkey)"""


@v.stored
def asks(spark, d):
    text_ = f"WITH {v.BOOK}, {ASKS} SELECT * FROM asks".replace('"limit"', "`limit`")
    text_ = text_.replace("FROM part", "FROM {part}").replace("FROM customer", "FROM {customer}")
    return spark.sql(text_, part=v.spread(table(spark, d, "part")), customer=table(spark, d, "customer"))


@v.stored
def bib_books(spark, d):
    return bibliography_to_books(read_bibliography(v.batches(spark, d)))


# The bibliography as rows, in SQL. The last answer for an ISBN counts.
BIB_SQL = """
bib AS (SELECT isbn, k AS bib_k, bib_title, p_brand AS publisher,
  CASE WHEN k % 6 = 4 THEN (CASE WHEN lower(replace(author1, ' ', '')) = '' THEN '' ELSE 'Ann ' || author1 || '|J ' || p_brand END)
    ELSE author1 || '|' || p_brand END AS authors,
  CASE WHEN k % 6 = 4 THEN 'Ann ' || author1 || '=author|J ' || p_brand || '=translator' END AS contributors,
  CASE WHEN k % 5 IN (0, 4) THEN strftime(make_date(1990 + k % 30, 1 + k % 12, 1 + k % 28), '%Y-%m-%d')
    WHEN k % 5 = 1 THEN strftime(make_date(1990 + k % 30, 1 + k % 12, 1), '%Y-%m-%d') END AS published_at,
  CASE WHEN bib_amount IS NULL THEN NULL ELSE floor(p_retailprice) END AS price,
  nullif(bib_cover, '') AS cover_image_url,
  CASE WHEN bib_text03 <> '' THEN bib_text03 ELSE bib_text02 END AS description, store_link,
  CASE WHEN k % 4 = 0 THEN p_name ELSE bib_title END AS title,
  CASE WHEN k % 4 = 0 THEN 'volume ' || p_size END AS subtitle,
  CASE WHEN k % 4 = 0 THEN p_type END AS alternative_title
  FROM (SELECT *, row_number() OVER (PARTITION BY isbn ORDER BY k DESC) AS last FROM book WHERE in_bib = 1) WHERE last = 1)"""


# --- Filters ---


@query("filter_source", v.with_views("SELECT k, isbn FROM book WHERE source_id = 'gihyo'"))
def filter_source(spark, d):
    return filters.filter_source(v.catalog(spark, d), "gihyo").select(col("position").alias("k"), "isbn")


@query("keyword_filter", v.with_views("""
SELECT query_id, source_id, k FROM asks JOIN book ON contains(lower(book.title), lower(trim(asks.title)))
WHERE asks.author IS NULL OR contains(lower(replace(authors_text, '|', ' ')), lower(author))""", ASKS))
def keyword_filter_q(spark, d):
    return keyword_filter(asks(spark, d), v.catalog(spark, d), with_author=True).withColumnRenamed("position", "k")


@query("token_and_filter", v.with_views("""
SELECT query_id, source_id, k FROM asks JOIN book ON
  (asks.title IS NULL OR len(list_filter(string_split(lower(trim(asks.title)), ' '), lambda x: NOT contains(lower(book.title || ' ' || p_brand), x))) = 0)
  AND (author IS NULL OR contains(lower(replace(authors_text, '|', ', ')), lower(author)))
WHERE asks.title IS NOT NULL OR author IS NOT NULL""", ASKS))
def token_and_filter_q(spark, d):
    index = v.catalog(spark, d).select(
        "source_id", "position",
        F.lower(F.concat_ws(" ", "title", "publisher")).alias("haystack"),
        F.array_join("authors", ", ").alias("author_text"),
    )
    return token_and_filter(asks(spark, d), index).withColumnRenamed("position", "k")


_MEDIA = ["born-digital", "rutles", "saiensu", "seshop", "coronasha", "gihyo"]


@query("media_filter", v.with_views(f"""
SELECT k FROM book WHERE k % 6 = 5 OR k % 12 < 6"""))
def media_filter(spark, d):
    e = col("k") % 12 < 6
    rows = v.book_rows(spark, d).select(
        "k",
        _pick(_MEDIA).alias("source_id"),
        F.when(e & (col("k") % 6 == 0), F.concat(lit("【PDF】"), "p_name"))
        .when(e, F.concat("p_name", lit("【電子版】"))).otherwise(col("p_name")).alias("title"),
        F.when(e, "電子").otherwise("紙").alias("media"),
        F.when(e, "電子書籍/IT").when(col("k") % 12 == 9, None).otherwise("書籍").alias("category"),
        F.when(e, F.array(lit("在庫あり"), lit("電子版あり"))).otherwise(F.array(lit("在庫あり"))).alias("statuses"),
    )
    return filters.media_filter(rows).select("k")


@query("valid_rows", v.with_views("SELECT k FROM book WHERE k % 5 <> 0 AND k % 7 <> 0 AND k % 11 <> 1"))
def valid_rows(spark, d):
    rows = v.book_rows(spark, d).select(
        "k",
        F.when(col("k") % 5 == 0, " 　").otherwise(col("title")).alias("title"),
        F.when(col("k") % 7 == 0, None).when(col("k") % 11 == 1, "").otherwise(col("url")).alias("url"),
    )
    return filters.valid_rows(rows).select("k")


@query("relevance_filter", v.with_views(
    f"SELECT clue_id, k, {v.sql_round3(_MEAN_SQL)} AS score FROM keyed WHERE (query IS NULL AND query_author IS NULL) OR {v.sql_round3(_MEAN_SQL)} > 0",
    v.CLUES, _PAIRS))
def relevance_filter(spark, d):
    df = _mean(_keyed(spark, d)).withColumn("score", scoring.round3(col("score")))
    return filters.relevance_filter(df, col("query").isNotNull() | col("query_author").isNotNull(), "score").select("clue_id", "k", "score")


_ORIGIN = "lower(regexp_extract(url, '^[a-z]+://[^/?#]*'))"
_PATH = "regexp_extract(url, '^[a-z]+://[^/?#]*([^#]*)', 1)"
# What the rules text below means, for the SQL side: sites with an even number of characters in their
# origin have a section for the agent, every seventh has no rules at all.
ROBOTS_SQL = f"""
paths AS (SELECT page_id, url, {_ORIGIN} AS origin, {_PATH} AS p FROM pages),
verdict AS (SELECT *, CASE WHEN length(origin) % 7 = 0 THEN TRUE
  WHEN length(origin) % 2 = 0 THEN (CASE WHEN starts_with(p, '/en/25') OR starts_with(p, '/en/28') THEN TRUE WHEN starts_with(p, '/en/2') THEN FALSE ELSE TRUE END)
  ELSE (CASE WHEN starts_with(p, '/fr/8') THEN TRUE WHEN starts_with(p, '/fr/') THEN FALSE WHEN starts_with(p, '/en/1') THEN FALSE ELSE TRUE END) END AS allowed FROM paths)"""
_ANY = "# all\nUser-Agent: *\nUser-agent: otherbot\n# note\nDisallow: /fr/ # french\nAllow: /fr/8\nCrawl-delay: 5\nDisallow: /en/1\nDisallow:\n\nDisallow: /de/\n"
_OWN = "User-agent: LibraryBot\nDisallow: /en/2\nAllow: /en/25\nAllow: /en/28\nDisallow: /en/28\nUser-agent: third\nDisallow: /\n"


def robots_files(spark, d):
    origin = urls.origin(col("url"))
    n = F.length("origin")
    return (
        table(spark, d, "pages").select(origin.alias("origin")).distinct().where(n % 7 != 0)
        .withColumn("content", F.when(n % 2 == 0, F.concat(lit(_ANY), lit("\n"), lit(_OWN))).otherwise(lit(_ANY)))
    )


def page_rules(spark, d):
    return joins.robots_rules(robots_files(spark, d), "librarybot")


@query("robots_filter", "WITH " + ROBOTS_SQL.strip() + " SELECT page_id, url FROM verdict WHERE allowed")
def robots_filter(spark, d):
    return joins.robots_filter(table(spark, d, "pages").select("page_id", "url"), page_rules(spark, d))


@query("fresh_snapshot", """
WITH logged AS (SELECT user_id, event_id, epoch(ts) AS at, ts, CASE event_type WHEN 'view' THEN 3600 WHEN 'click' THEN 21600
    WHEN 'purchase' THEN 86400 WHEN 'signup' THEN 864000 END AS ttl_s FROM events),
last AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM logged)
SELECT user_id, event_id FROM last WHERE rn = 1 AND (ttl_s IS NULL OR TIMESTAMP '2024-01-30 12:00:00' <= ts + to_seconds(ttl_s))""")
def fresh_snapshot(spark, d):
    ttl = F.create_map(*[lit(x) for kv in {"view": filters.PAGE_TTL, "click": filters.ROBOTS_TTL, "purchase": filters.CATALOG_TTL, "signup": 864000}.items() for x in kv])
    log = table(spark, d, "events").select(
        col("user_id").alias("url"), col("ts").cast("timestamp_ntz").alias("fetched_at"), "event_id",
        F.element_at(ttl, col("event_type")).cast("bigint").alias("ttl_s"),
    )
    as_of = lit("2024-01-30 12:00:00").cast("timestamp_ntz")
    return filters.fresh_snapshot(log, as_of).select(col("url").alias("user_id"), "event_id")


_ROUTE = """routed AS (SELECT clue_id, CASE WHEN clue_id % 4 = 0 THEN (CASE WHEN clue_id % 8 = 0 THEN isbn ELSE substring(lpad(clue_id::VARCHAR, 9, '1') || 'X', 1, 10) END) ELSE title END AS title,
  CASE WHEN clue_id % 12 = 0 THEN 'Someone' END AS author FROM clues)"""


@query("isbn_route", v.with_views("""
SELECT clue_id AS query_id, CASE WHEN clue_id % 4 = 0 AND clue_id % 12 <> 0 THEN 'isbn' ELSE 'text' END AS route FROM routed""", v.CLUES, _ROUTE))
def isbn_route(spark, d):
    q = v.clue_rows(spark, d)
    ten = F.concat(F.lpad(col("clue_id").cast("string"), 9, "1"), lit("x"))
    q = q.select(
        col("clue_id").alias("query_id"),
        F.when(col("clue_id") % 8 == 0, col("isbn")).when(col("clue_id") % 4 == 0, ten).otherwise(col("title")).alias("title"),
        F.when(col("clue_id") % 12 == 0, "Someone").alias("author"),
    )
    a, b = filters.isbn_route(q)
    return a.select("query_id", lit("isbn").alias("route")).unionByName(b.select("query_id", lit("text").alias("route")))


@query("limit_clamp", v.with_views("""
SELECT query_id, least(coalesce("limit", 10), 50) AS n, least(coalesce("limit", 10), 40) AS n_volumes FROM asks""", ASKS))
def limit_clamp(spark, d):
    return asks(spark, d).select(
        "query_id", ranking.clamp_limit(col("limit")).alias("n"), ranking.clamp_limit(col("limit"), 40).alias("n_volumes"))


# --- Joins ---

_URLS = ["https://gihyo.jp/book/", "https://book.mynavi.jp/manatee/books/", "https://book.mynavi.jp/other/", "http://gihyo.jp/book/",
         "https://www.oreilly.co.jp/books/", "https://shop.example.com/", "https://pragprog.com/titles/"]
_URL_SOURCES = ["gihyo", "manatee", None, None, "oreilly-japan", None, "pragprog"]


@query("url_source_join", v.with_views(f"SELECT k, {_case(_URL_SOURCES)} AS source_id FROM book"))
def url_source_join(spark, d):
    rows = v.book_rows(spark, d).select("k", F.concat(_pick(_URLS), col("k").cast("string")).alias("url"))
    return joins.url_source_join(rows, v.sources(spark)).select("k", "source_id")


@query("isbn_source_join", v.with_views("SELECT k, CASE WHEN k % 8 = 0 THEN NULL ELSE code_source END AS source_id FROM book"))
def isbn_source_join(spark, d):
    rows = v.book_rows(spark, d).select("k", F.when(col("k") % 8 == 0, "9791000000008").otherwise(col("isbn")).alias("isbn"))
    return joins.isbn_source_join(rows, v.isbn_codes(spark)).select("k", "source_id")


_ENRICH_SQL = """
enriched AS (SELECT b.k, b.isbn, b.source_id, b.title, CASE WHEN b.authors_text = '' THEN coalesce(bib.authors, '') ELSE b.authors_text END AS authors_text,
  bib.contributors, coalesce(b.published, bib.published_at) AS published_at, coalesce(b.price, bib.price) AS price,
  bib.cover_image_url, bib.description, b.url FROM book b LEFT JOIN bib ON b.isbn = bib.isbn AND b.k % 17 <> 0)"""
ENRICH_VIEWS = (BIB_SQL, _ENRICH_SQL)


@query("enrich", v.with_views(
    "SELECT k, title, authors_text AS authors, contributors, published_at, price, cover_image_url, description FROM enriched", *ENRICH_VIEWS))
def enrich_q(spark, d):
    books = v.catalog(spark, d)
    books = books.withColumn("isbn", F.when(col("position") % 17 != 0, col("isbn")))
    return enrich(books, bib_books(spark, d)).select(
        col("position").alias("k"),
        "title",
        F.array_join("authors", "|").alias("authors"),
        F.array_join(F.transform("contributors", lambda x: F.concat_ws("=", x["name"], x["role"])), "|").alias("contributors"),
        col("published_at").cast("string").alias("published_at"),
        col("price").cast("double").alias("price"),
        "cover_image_url",
        "description",
    )


@query("robots_join", "WITH " + ROBOTS_SQL.strip() + " SELECT page_id, CASE WHEN allowed THEN 'yes' ELSE 'no' END AS allowed FROM verdict")
def robots_join(spark, d):
    out = joins.robots_join(table(spark, d, "pages").select("page_id", "url"), page_rules(spark, d))
    return out.select("page_id", F.when(col("allowed"), "yes").otherwise("no").alias("allowed"))


SCORE_SQL = f"""
forms AS (SELECT DISTINCT title AS query, author AS query_author, publisher_id FROM clues WHERE title IS NOT NULL OR author IS NOT NULL),
shelf AS (SELECT k, source_id, {v.sql_key('title')} AS t, list_transform(CASE WHEN authors_text = '' THEN []::VARCHAR[] ELSE string_split(authors_text, '|') END, lambda x: {v.sql_key('x')}) AS au FROM book),
fk AS (SELECT *, {v.sql_key('query')} AS q, {v.sql_key('query_author')} AS a,
  list_filter(list_transform(string_split(replace(query, '　', ' '), ' '), lambda x: {v.sql_key('x')}), lambda x: x <> '') AS toks FROM forms),
scored AS (SELECT query, query_author, publisher_id, source_id, k, {v.sql_round3(_MEAN_SQL)} AS match_score FROM fk JOIN shelf
  ON publisher_id IS NULL OR publisher_id = source_id)"""


@query("score_join", v.with_views("""
SELECT query AS query_title, query_author, publisher_id, source_id, k, match_score FROM scored WHERE match_score > 0""", v.CLUES, SCORE_SQL))
def score_join_q(spark, d):
    forms = v.clue_rows(spark, d).select(col("title").alias("query_title"), col("author").alias("query_author"), "publisher_id").where(
        "query_title is not null or query_author is not null").distinct()
    books = materialize(v.catalog(spark, d).select("source_id", "position", text.match_key(col("title")).alias("title_key"), text.match_keys(col("authors")).alias("author_keys")))
    forms = materialize(forms)
    return score_join(forms, books).withColumnRenamed("position", "k")


@query("detail_by_isbn_template", v.with_views("""
SELECT DISTINCT b.isbn, 'oreilly-japan' AS source_id, 'Page ' || first_title AS title FROM book b JOIN (
  SELECT isbn, min(title) AS first_title FROM book WHERE k % 30 = 6 GROUP BY isbn) p ON p.isbn = b.isbn"""))
def detail_by_isbn_template(spark, d):
    isbns = v.book_rows(spark, d).select("isbn").distinct()
    out = joins.detail_by_isbn_template(isbns, v.sources(spark), v.isbn_codes(spark), v.page_books(spark, d))
    return out.select("isbn", "source_id", "title")


@query("secondary_lookup", v.with_views("""
SELECT b.isbn, 'Secondary ' || s.k AS title FROM (SELECT DISTINCT isbn FROM book) b LEFT JOIN (
  SELECT isbn, min(k) AS k FROM book WHERE k % 9 = 0 GROUP BY isbn) s ON s.isbn = b.isbn"""))
def secondary_lookup(spark, d):
    isbns = v.book_rows(spark, d).select("isbn").distinct()
    return joins.secondary_lookup(isbns, v.secondary(spark, d)).select("isbn", "title")


@query("unresolved_anti", v.with_views("""
SELECT clue_id, CASE WHEN title IS NOT NULL OR author IS NOT NULL THEN 'search' ELSE 'not_found' END AS route FROM clues
WHERE isbn IS NULL OR isbn NOT IN (SELECT isbn FROM book WHERE in_bib = 1)""", v.CLUES))
def unresolved_anti(spark, d):
    c = v.clue_rows(spark, d)
    known = v.book_rows(spark, d).where("in_bib = 1").select("isbn").distinct()
    a, b = joins.unresolved_anti(c, c.join(known, "isbn", "left_semi"))
    return a.select("clue_id", lit("search").alias("route")).unionByName(b.select("clue_id", lit("not_found").alias("route")))


@query("first_row_fallback", v.with_views("""
SELECT l.isbn, l.n AS position, CASE WHEN l.isbn = l.row_isbn THEN 'same' ELSE 'other' END AS kind FROM (
  SELECT b.isbn, n.n, CASE WHEN n.n = 2 AND b.k % 4 = 0 THEN b.isbn ELSE 'x' || b.k || '-' || n.n END AS row_isbn,
    row_number() OVER (PARTITION BY b.isbn ORDER BY CASE WHEN n.n = 2 AND b.k % 4 = 0 THEN 0 ELSE 1 END, n.n) AS rn
  FROM (SELECT isbn, min(k) AS k FROM book GROUP BY isbn) b, (VALUES (0), (1), (2), (3)) AS n(n)) l WHERE rn = 1"""))
def first_row_fallback(spark, d):
    firsts = v.book_rows(spark, d).groupBy("isbn").agg(F.min("k").alias("k"))
    listing = firsts.withColumn("position", F.explode(F.array(*[lit(i) for i in range(4)]))).select(
        col("isbn").alias("keyword"), "position",
        F.when((col("position") == 2) & (col("k") % 4 == 0), col("isbn"))
        .otherwise(F.concat(lit("x"), col("k").cast("string"), lit("-"), col("position").cast("string"))).alias("isbn"),
    )
    out = joins.first_row_fallback(firsts, listing)
    return out.select("isbn", "found.position", F.when(col("found.isbn") == col("isbn"), "same").otherwise("other").alias("kind"))


# --- Summaries ---

_LOG_SQL = f"""
log AS (SELECT event_id, user_id % 24 AS ordinal, CASE WHEN event_type <> 'error' THEN NULL WHEN value < 20 THEN 'タイムアウト (12000ms)'
  WHEN value < 40 THEN 'robots.txt によりアクセスが禁止されています: x' WHEN value < 80 THEN 'HTTP 503: x' ELSE 'boom HTTP 1' END AS message,
  CASE WHEN value < 20 THEN 'timeout' WHEN value < 40 THEN 'robots' WHEN value < 80 THEN 'http' ELSE 'other' END AS type FROM events)"""


def fetch_log(spark, d):
    value = col("value")
    small = v.sources(spark).select("source_id", "ordinal")
    log = table(spark, d, "events").select(
        "event_id",
        (col("user_id") % 24).cast("int").alias("ordinal"),
        F.when(col("event_type") != "error", None)
        .when(value < 20, "タイムアウト (12000ms)")
        .when(value < 40, "robots.txt によりアクセスが禁止されています: x")
        .when(value < 80, "HTTP 503: x")
        .otherwise("boom HTTP 1")
        .alias("message"),
    )
    return log.join(F.broadcast(small), "ordinal")


@query("classify_error", f"WITH {_LOG_SQL.strip()} SELECT event_id, type FROM log WHERE message IS NOT NULL")
def classify_error(spark, d):
    return fetch_log(spark, d).where("message is not null").select("event_id", summary.classify_error(col("message")).alias("type"))


_LABEL = " ".join(f"WHEN '{k}' THEN '{x}'" for k, x in summary.ERROR_LABELS.items())


@query("error_summary", f"""WITH {_LOG_SQL.strip()}, {SOURCES_SQL}
SELECT type, CASE type {_LABEL} END AS label, sum(n)::BIGINT AS "count", string_agg(source_id, ',' ORDER BY ordinal) AS sources, min(ordinal)::INT AS first_seen FROM (
  SELECT type, log.ordinal, source_id, count(*) AS n FROM log JOIN sources USING (ordinal) WHERE message IS NOT NULL GROUP BY ALL) GROUP BY type""")
def error_summary(spark, d):
    out = summary.error_summary(fetch_log(spark, d).where("message is not null"))
    return out.withColumn("sources", F.array_join("sources", ","))


@query("partial_results", f"""WITH {_LOG_SQL.strip()} SELECT event_id, CASE WHEN message IS NULL THEN 'row' ELSE 'error' END AS kind FROM log""")
def partial_results(spark, d):
    good, bad = summary.partial_results(fetch_log(spark, d).withColumnRenamed("message", "error"))
    return good.select("event_id", lit("row").alias("kind")).unionByName(bad.select("event_id", lit("error").alias("kind")))


# --- Windows and set operations: the books at the ten places around each customer's number, with a score ---

_NEAR_SQL = f"""
near AS (SELECT c_custkey AS clue_id, b.k, b.source_id, s.ordinal, s.scale, ((c_custkey * 7 + b.k * 3) % 11)::DOUBLE / 10::DOUBLE AS match_score
  FROM (SELECT c_custkey, unnest(range(10)) AS o FROM customer) JOIN book b ON b.k % (SELECT count(*) FROM customer) = (c_custkey + o) % (SELECT count(*) FROM customer)
    AND b.k <> c_custkey + c_custkey % 9 JOIN sources s USING (source_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY clue_id ORDER BY match_score DESC, coalesce(scale, '') = 'minor', ordinal, k) AS rank FROM near),
pair AS (SELECT *, lead(match_score) OVER (PARTITION BY clue_id ORDER BY rank) AS second FROM ranked)"""
_NEAR_VIEWS = (SOURCES_SQL, _NEAR_SQL)


def _near(spark, d):
    c = v.spread(table(spark, d, "customer").select(col("c_custkey").alias("clue_id")))
    n = c.count()
    near = c.withColumn("place", F.explode(F.transform(F.sequence(col("clue_id"), col("clue_id") + 9), lambda k: k % n)))
    books = v.book_rows(spark, d).select("k", "source_id", (col("k") % n).alias("place"))
    small = F.broadcast(v.sources(spark).select("source_id", "ordinal", "scale"))
    score = ((col("clue_id") * 7 + col("k") * 3) % 11).cast("double") / lit(10.0)
    # Both sides grow, and Spark takes ten places of a customer for one row: neither is sent to the driver.
    return near.hint("merge").join(books, "place").where("k <> clue_id + clue_id % 9").drop("place").join(small, "source_id").withColumn("match_score", score).withColumn("position", col("k"))


@query("per_source_limit", v.with_views("""
SELECT source_id, k FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY k) AS rn FROM book) WHERE rn <= 3 + length(source_id) % 7"""))
def per_source_limit(spark, d):
    rows = v.catalog(spark, d).select("source_id", col("position").alias("k"))
    return ranking.top_per_group(rows, ["source_id"], [col("k")], 3 + F.length("source_id") % 7, cap=9)


@query("rank_by_score", v.with_views("SELECT clue_id, k, rank FROM ranked", *_NEAR_VIEWS))
def rank_by_score(spark, d):
    return ranking.rank_by_score(_near(spark, d), "clue_id").select("clue_id", "k", "rank")


@query("best_and_second", v.with_views("SELECT clue_id, k, match_score, second AS second_score FROM pair WHERE rank = 1", *_NEAR_VIEWS))
def best_and_second(spark, d):
    ranked = ranking.rank_by_score(_near(spark, d), "clue_id")
    return ranking.best_and_second(ranked, "clue_id").select("clue_id", "k", "match_score", "second_score")


_AMBIGUOUS_SQL = "second IS NOT NULL AND match_score < 1 AND match_score >= 0.5::DOUBLE AND match_score - second < 0.1::DOUBLE"


@query("ambiguous", v.with_views(f"SELECT clue_id, CASE WHEN {_AMBIGUOUS_SQL} THEN 'yes' ELSE 'no' END AS ambiguous FROM pair WHERE rank = 1", *_NEAR_VIEWS))
def ambiguous(spark, d):
    best = ranking.best_and_second(ranking.rank_by_score(_near(spark, d), "clue_id"), "clue_id")
    flag = scoring.is_ambiguous(col("match_score"), col("second_score"))
    return best.select("clue_id", F.when(flag, "yes").otherwise("no").alias("ambiguous"))


@query("top3_candidates", v.with_views(f"""
SELECT clue_id, string_agg(k::VARCHAR, ',' ORDER BY rank) AS books FROM ranked WHERE rank <= 3
  AND clue_id IN (SELECT clue_id FROM pair WHERE rank = 1 AND {_AMBIGUOUS_SQL}) GROUP BY clue_id""", *_NEAR_VIEWS))
def top3_candidates(spark, d):
    ranked = ranking.with_runner_up(ranking.rank_by_score(_near(spark, d), "clue_id"), "clue_id").where("rank <= 3")
    per_clue = ranked.groupBy("clue_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "k"))).alias("top"),
        F.min_by(F.struct("match_score", "second_score"), "rank").alias("b"),
    )
    return per_clue.where(scoring.is_ambiguous(col("b.match_score"), col("b.second_score"))).select(
        "clue_id", F.array_join(F.transform("top", lambda x: x["k"].cast("string")), ",").alias("books"))


@query("input_order", v.with_views("SELECT clue_id, k FROM ranked WHERE rank = 1 ORDER BY clue_id", *_NEAR_VIEWS))
def input_order(spark, d):
    return ranking.rank_by_score(_near(spark, d), "clue_id").where("rank = 1").select("clue_id", "k").orderBy("clue_id")


@query("source_priority", v.with_views("""
SELECT source_id, (row_number() OVER (ORDER BY coalesce(scale, '') = 'minor', ordinal) - 1)::INT AS priority, n FROM sources
JOIN (SELECT source_id, count(*) AS n FROM book GROUP BY source_id) USING (source_id)""", SOURCES_SQL))
def source_priority(spark, d):
    counts = v.catalog(spark, d).groupBy("source_id").agg(F.count("*").alias("n"))
    present = v.sources(spark).join(counts, "source_id")
    return ranking.source_priority(present).select("source_id", "priority", "n")


@query("first_match", v.with_views("SELECT source_id, title, min(k) AS k FROM book GROUP BY source_id, title"))
def first_match(spark, d):
    rows = v.catalog(spark, d).select("source_id", "title", col("position").alias("k"))
    return ranking.first_match(rows, ["source_id", "title"], col("k"))


@query("union_sources", v.with_views("""
SELECT isbn, source_id, title FROM book UNION ALL SELECT isbn, NULL, 'Page ' || min(title) FROM book WHERE k % 12 = 1 GROUP BY isbn, store_link
UNION ALL SELECT isbn, NULL, 'Page ' || min(title) FROM book WHERE k % 30 = 6 GROUP BY isbn"""))
def union_sources(spark, d):
    cat, pages_ = v.catalog(spark, d), v.page_books(spark, d).select("isbn", "title")
    return ranking.union_sources(cat, pages_).select("isbn", "source_id", "title")


@query("distinct_urls", f"SELECT url, min(page_id) AS page_id FROM (SELECT page_id, {_ORIGIN} AS url FROM pages) GROUP BY url")
def distinct_urls(spark, d):
    rows = table(spark, d, "pages").select("page_id", urls.origin(col("url")).alias("url"))
    return ranking.distinct_urls(rows, col("page_id")).select("url", "page_id")
