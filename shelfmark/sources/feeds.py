"""JSON feeds to book rows. Payloads that do not parse give no rows, never an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.people import split_authors
from ..functions.text import empty_to_null, strip_html, trim_blanks
from ..functions.urls import force_https, host, resolve_url
from ..schemas import EDGES, INDEX, KEYED_CATALOG, VOLUMES, as_books

KEYED_BASE = "https://gihyo.jp"
INDEX_BASE = "https://pragprog.com"
EDGES_BASE = "https://techbookfest.org"
VOLUME_BASE = "https://books.google.com"


def _own_store(name: str, drm: str, url: Column) -> Column:
    return F.array(F.struct(F.lit(name).alias("name"), url.alias("url"), F.lit(drm).alias("drm")))


def explode_keyed_catalog(feed: DataFrame, body: str = "body") -> DataFrame:
    """Object keyed by ISBN to rows, in the order of the object."""
    parsed = feed.withColumn("__p", F.from_json(body, KEYED_CATALOG)["list"])
    rows = parsed.select(
        *feed.columns, F.posexplode("__p").alias("position", "isbn_key", "e")
    ).drop(body)
    e = F.col("e")
    names = F.flatten(F.transform(F.map_values(e["author"]), lambda m: F.map_keys(m)))
    release = F.get(e["release"], F.lit(0))
    price, cover = F.get(e["price"], F.lit(0)), F.get(e["cover"], F.lit(3))
    base = F.lit(KEYED_BASE)
    return rows.select(
        *[c for c in feed.columns if c != body],
        F.lit("gihyo").alias("source_id"),
        F.col("position").cast("bigint"),
        F.concat_ws(" ", e["title"], empty_to_null(e["subtitle"])).alias("title"),
        F.transform(names, lambda n: trim_blanks(strip_html(n))).alias("authors"),
        F.lit("技術評論社").alias("publisher"),
        dates.parse_date(release, "dot").alias("published_at"),
        empty_to_null(release).alias("release_text"),
        F.replace("isbn_key", F.lit("-"), F.lit("")).alias("isbn"),
        resolve_url(base, e["url"]).alias("url"),
        F.when(price > 0, price).cast("decimal(12,2)").alias("price"),
        F.when(cover != "", resolve_url(base, cover)).alias("cover_image_url"),
    )


def read_volumes(feed: DataFrame, body: str = "body") -> DataFrame:
    """Volume search responses to rows; a response without items gives none."""
    keep = [c for c in feed.columns if c != body]
    v = F.col("v")
    info, listed = v["volumeInfo"], v["saleInfo"]["listPrice"]
    isbn13 = F.filter(info["industryIdentifiers"], lambda x: x["type"] == "ISBN_13")
    rows = feed.select(*keep, F.posexplode(F.from_json(body, VOLUMES)["items"]).alias("position", "v"))
    return rows.select(
        *keep,
        F.lit("google-books").alias("source_id"),
        F.col("position").cast("bigint"),
        info["title"].alias("title"),
        F.coalesce(info["authors"], F.array().cast("array<string>")).alias("authors"),
        F.coalesce(info["publisher"], F.lit("")).alias("publisher"),
        dates.parse_date(empty_to_null(info["publishedDate"]), "volume").alias("published_at"),
        info["language"].alias("language"),
        F.get(isbn13, F.lit(0))["identifier"].alias("isbn"),
        force_https(
            F.coalesce(info["infoLink"], F.concat(F.lit(f"{VOLUME_BASE}/books?id="), v["id"]))
        ).alias("url"),
        F.when(listed["currencyCode"] == "JPY", F.floor(listed["amount"] + F.lit(0.5)))
        .cast("decimal(12,2)")
        .alias("price"),
        force_https(empty_to_null(info["imageLinks"]["thumbnail"])).alias("cover_image_url"),
        info["description"].alias("description"),
    )


def read_index(feed: DataFrame, body: str = "body") -> DataFrame:
    """Search index to book rows; records of other types are dropped. `haystack` is for filtering."""
    keep = [c for c in feed.columns if c != body]
    rows = feed.select(*keep, F.posexplode(F.from_json(body, INDEX)["results"]).alias("position", "r"))
    r = F.col("r")
    url = resolve_url(F.lit(INDEX_BASE), r["href"])
    text = F.concat_ws(
        " ",
        empty_to_null(r["title"]),
        empty_to_null(r["subtitle"]),
        empty_to_null(F.array_join(r["keywords"], " ")),
    )
    return rows.where(r["record_type"] == "book").select(
        *keep,
        F.lit("pragprog").alias("source_id"),
        F.col("position").cast("bigint"),
        trim_blanks(r["title"]).alias("title"),
        split_authors(F.coalesce(r["author"], F.lit("")), "english").alias("authors"),
        F.lit("Pragmatic Bookshelf").alias("publisher"),
        F.lit("en").alias("language"),
        url.alias("url"),
        empty_to_null(trim_blanks(r["subtitle"])).alias("description"),
        F.when(r["image"] != "", resolve_url(F.lit(INDEX_BASE), r["image"])).alias("cover_image_url"),
        _own_store("Pragmatic Bookshelf", "free", url).alias("ebook_stores"),
        F.lower(text).alias("haystack"),
        r["author"].alias("author"),
    )


def flatten_edges(feed: DataFrame, body: str = "body", limit: Column | None = None) -> DataFrame:
    """Edges and nodes to rows; nodes without a product are dropped before counting to `limit`."""
    keep = [c for c in feed.columns if c != body]
    edges = F.from_json(body, EDGES)["data"]["searchProducts"]["edges"]
    products = F.filter(F.transform(edges, lambda x: x["node"]["product"]), lambda p: p.isNotNull())
    rows = feed.select(*keep, F.posexplode(products).alias("position", "p"))
    if limit is not None:
        rows = rows.where(F.col("position") < limit)
    p = F.col("p")
    url = F.concat(F.lit(f"{EDGES_BASE}/product/"), p["databaseID"])
    return rows.select(
        *keep,
        F.lit("techbookfest").alias("source_id"),
        F.col("position").cast("bigint"),
        p["name"].alias("title"),
        F.when(p["organization"].isNotNull(), F.array(p["organization"]["name"]))
        .otherwise(F.array().cast("array<string>"))
        .alias("authors"),
        F.lit("技術書典").alias("publisher"),
        url.alias("url"),
        p["ebookVariant"]["price"].cast("decimal(12,2)").alias("price"),
        p["description"].alias("description"),
        p["coverImage"]["url"].alias("cover_image_url"),
        F.substring(p["firstPublishedAt"], 1, 10).try_cast("date").alias("published_at"),
        _own_store("技術書典", "free", url).alias("ebook_stores"),
    )


#: How the feed of each source is read.
READERS = {"gihyo": explode_keyed_catalog, "google-books": read_volumes, "pragprog": read_index, "techbookfest": flatten_edges}
# Hosts that serve a source's feed outside its own address.
FEED_HOSTS = {"www.googleapis.com": "google-books"}


def feed_source(url: Column, source: Column) -> Column:
    """The source of a feed's URL: that of its address, or that which its host serves."""
    hosts = F.create_map(*[F.lit(x) for kv in FEED_HOSTS.items() for x in kv])
    return F.coalesce(source, F.try_element_at(hosts, host(url)))


def read_feeds(feeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Book rows of `feeds(url, html, source_id)`, bodies of any source, and (url, reason) of the others.

    Rows are keyed by `page_url`, have the page kind `feed`, and name in `more_url` the page that
    completes them. A body that is no JSON, and a source without a reader, is told as unread.
    """
    known = F.col("source_id").isin(*READERS)
    good = known & F.get_json_object("html", "$").isNotNull()
    unread = feeds.where(~F.coalesce(good, F.lit(False))).select("url", F.lit("unread feed").alias("reason"))
    books = None
    for source, read in READERS.items():
        own = feeds.where(good & (F.col("source_id") == source)).select(F.col("url").alias("page_url"), F.col("html").alias("body"))
        rows = read(own).withColumn("page_kind", F.lit("feed")).withColumn("more_url", F.col("url") if source == "gihyo" else F.lit(None).cast("string"))
        rows = as_books(rows, "page_url", "page_kind", "more_url")
        books = rows if books is None else books.unionByName(rows)
    return books, unread
