"""Book records of a table of detail-page URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.enrich import enrich, stamp_defaults, with_distinct_authors
from ..operators.joins import robots_join, url_source_join
from ..operators.ranking import first_match
from ..schemas import as_books
from ..sources import rulesets
from ..sources.feeds import explode_keyed_catalog, read_volumes
from ..sources.html import extract
from ..sources.pages import follow_link
from ..sources.records import books_from_fields
from ..storage import materialize
from .catalog import linked_pages

# The addresses of feeds that stand for a detail page, and what they are asked for.
KEYED_PAGE = "https://gihyo.jp/api_gh/site/search?search={}&limit=1"
KEYED_NUMBER = "/(978-[\\d-]+)\\s*$"
VOLUME_PAGE = "https://www.googleapis.com/books/v1/volumes/{}"
VOLUME_NUMBER = "[?&]id=([^&]+)"
#: URLs asked for that are broadcast to the pages; with more of them the pages are shuffled.
BROADCAST_ROWS = 200_000


def _checked(urls: DataFrame, registry: DataFrame, robots: DataFrame) -> DataFrame:
    routed = robots_join(url_source_join(urls, registry), robots, registry)
    reason = F.when(F.col("source_id").isNull(), "no source").when(~F.col("allowed"), "robots.txt")
    return routed.withColumn("reason", reason)


def book_details(
    urls: DataFrame, page_books: DataFrame, registry: DataFrame, robots: DataFrame, bib: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Books of the URLs, and the rejected URLs with the reason.

    A URL is rejected when no source owns it, when robots rules forbid it, or when its page gave
    no record. `page_books`: book rows of extracted detail pages by `url`.
    """
    checked = _checked(urls, registry, robots)
    usable = checked.where("reason is null").select("url", "source_id")
    found = usable.join(page_books.drop("source_id"), "url", "left")
    missing = found.where("title is null").select("url", F.lit("no record").alias("reason"))
    done = _finished(found.where("title is not null"), registry, bib)
    return done, checked.where("reason is not null").select("url", "reason").unionByName(missing)


def _finished(books: DataFrame, registry: DataFrame, bib: DataFrame) -> DataFrame:
    return enrich(with_distinct_authors(stamp_defaults(books, registry)), bib)


def asked_pages(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of `pages(url, …)` whose URL is in `wanted(page_url, …)`, with its columns.

    Bodies that nobody asked for leave in the scan: up to BROADCAST_ROWS URLs are broadcast. Beyond,
    both sides are joined by URL.
    """
    few = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return pages.join(F.broadcast(wanted) if few else wanted, F.col("url") == F.col("page_url")).drop("page_url")


def _address(template: str, url: Column, number: str) -> Column:
    found = F.regexp_extract(url, number, 1)
    return F.when(found != "", F.replace(F.lit(template), F.lit("{}"), found))


def book_details_from_pages(
    urls: DataFrame, pages: DataFrame, registry: DataFrame, robots: DataFrame, bib: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """As `book_details`, from fetched `pages(url, html)`; of these only the ones asked for are parsed.

    Most sources are asked for the URL itself. Those with a feed are asked for their feed's answer: of
    a keyed answer the entry of the URL's number counts, else its first one, completed from the entry's
    own page; a volume is an answer of one. Pages that rows link to complete them where they were
    fetched. Of a page that was fetched twice one row stays. Rejected further: URLs whose page was
    not fetched, could not be read, or gave no record. `asked_url` is the URL asked for, `url` the book's own.
    """
    checked = _checked(urls.select("url").distinct(), registry, robots)
    asked = checked.where("reason is null").select("url", "source_id")
    by_key, by_volume = F.col("source_id") == "gihyo", F.col("source_id") == "google-books"
    page = F.when(by_key, _address(KEYED_PAGE, F.col("url"), KEYED_NUMBER)).when(by_volume, _address(VOLUME_PAGE, F.col("url"), VOLUME_NUMBER)).otherwise(F.col("url"))
    asked = materialize(asked.select("url", "source_id", page.alias("page_url")))
    wanted = asked.select(F.col("url").alias("asked_url"), "source_id", "page_url").where("page_url is not null")
    fetched = materialize(asked_pages(pages.select("url", "html"), wanted))

    plain = fetched.where(~by_key & ~by_volume).withColumn("page_kind", F.lit("detail"))
    parsed = materialize(extract(plain.select("url", "html", "source_id", "page_kind"), rulesets.rules()))
    own = books_from_fields(parsed, registry)
    entries = explode_keyed_catalog(fetched.where(by_key).select("asked_url", F.col("html").alias("body")))
    number = F.replace(F.regexp_extract("asked_url", KEYED_NUMBER, 1), F.lit("-"), F.lit(""))
    entry = first_match(entries, ["asked_url"], (F.col("isbn") != number), F.col("position"))
    keyed = as_books(entry.withColumn("more_url", F.col("url")), "asked_url", "more_url")
    items = F.concat(F.lit('{"items":['), "html", F.lit("]}"))
    volumes = as_books(read_volumes(fetched.where(by_volume).select("asked_url", items.alias("body"))), "asked_url").withColumn("more_url", F.lit(None).cast("string"))
    rows = as_books(own.withColumn("asked_url", F.col("page_url")), "asked_url", "more_url").unionByName(keyed).unionByName(volumes)
    rows = materialize(first_match(rows, ["asked_url"], F.col("title"), F.col("url")))

    named = rows.where("more_url is not null").select(F.col("more_url").alias("page_url")).distinct()
    further = asked_pages(pages.select("url", "html"), named)
    complete = follow_link(rows, linked_pages(further, robots), "more_url")
    books = _finished(complete.drop("more_url"), registry, bib)

    got = rows.select(F.col("asked_url").alias("url"), F.lit(True).alias("got")).distinct()
    errors = parsed.where("error is not null").groupBy("url").agg(F.min("error").alias("error"))
    seen = fetched.select(F.col("asked_url").alias("url"), F.lit(True).alias("seen")).distinct()
    told = asked.select("url").join(got, "url", "left").where("got is null").join(errors, "url", "left").join(seen, "url", "left")
    why = F.coalesce("error", F.when(F.col("seen"), "no record").otherwise("not fetched"))
    return books, checked.where("reason is not null").select("url", "reason").unionByName(told.select("url", why.alias("reason")))
