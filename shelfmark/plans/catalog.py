"""From fetched pages and feeds to one catalog of book rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stores import extract_asin
from ..operators.filters import media_filter, valid_rows
from ..operators.joins import robots_join, url_source_join
from ..operators.merge import merge_fields
from ..operators.summary import max_page
from ..schemas import BOOK
from ..sources import rulesets
from ..sources.feeds import feed_source, read_feeds
from ..sources.html import extract
from ..sources.pages import extract_stores, follow_link, page_links
from ..sources.records import books_from_fields, folder_pages
from ..storage import materialize

# Sources whose list goes before the detail page, but for these fields; sources whose
# list has several pages.
LIST_FIRST = {"seshop": ("authors", "isbn", "description")}
PAGED = ("tatsu-zine",)


def linked_pages(further: DataFrame, robots: DataFrame) -> DataFrame:
    """What further pages (url, html) tell of a book: its Kindle number and the stores they link to."""
    # Linked pages may lie outside the address of the source that names them.
    seen = robots_join(further, robots).where("allowed").select("url", "html")
    numbers = seen.groupBy("url").agg(F.min(extract_asin(F.col("html"))).alias("asin"))
    stores = extract_stores(page_links(seen), "url")
    none = F.lit(None)
    return numbers.join(stores, "url", "left").select(
        F.col("url").alias("linked_url"),
        F.array().cast("array<string>").alias("authors"),
        none.cast("string").alias("isbn"),
        "asin",
        none.cast("string").alias("description"),
        F.col("ebook_stores").cast(BOOK["ebook_stores"]).alias("ebook_stores"),
    )


def _page_no(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "[?&]page=([0-9]+)", 1).try_cast("int"), F.lit(1))


def _listing(url: Column) -> Column:
    return F.regexp_replace(url, "/?([?#].*)?$", "")


def listing_pages(lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(url, page_no, beyond) of pages of listings, and (url, reason) of pages that are missing.

    `lists(url, html)`: the pager of the first page tells the last one. Pages after it do not belong to
    the listing any more; of a listing without its first page nothing is known, and all pages count.
    """
    numbered = lists.select("url", _listing(F.col("url")).alias("listing"), _page_no(F.col("url")).alias("page_no"))
    links = page_links(lists.where(_page_no(F.col("url")) == 1).select("url", "html"))
    firsts = numbered.where("page_no = 1").select("listing").distinct()
    told = links.groupBy(_listing(F.col("url")).alias("listing")).agg(F.max(max_page(F.array("href"))).alias("last_page"))
    last = firsts.join(told, "listing", "left").withColumn("last_page", F.coalesce("last_page", F.lit(1)))
    placed = numbered.join(last, "listing", "left").select("url", "page_no", F.coalesce(F.col("page_no") > F.col("last_page"), F.lit(False)).alias("beyond"))
    wanted = last.select("listing", F.explode(F.sequence(F.lit(1), "last_page")).alias("page_no"))
    missing = wanted.join(numbered, ["listing", "page_no"], "left_anti").select(
        F.concat("listing", F.lit("?page="), F.col("page_no").cast("string")).alias("url"), F.lit("missing page of a listing").alias("reason")
    )
    return placed.distinct(), missing


def _rank(column: str) -> Column:
    """Detail pages go before lists and feeds, for some sources the other way."""
    detail = F.when(F.col("page_kind") == "detail", 1).otherwise(2)
    for source, kept in LIST_FIRST.items():
        if column not in kept:
            detail = F.when((F.col("source_id") == source) & (F.col("page_kind") == "list"), 0).otherwise(detail)
    return detail


def catalog_from_pages(pages: DataFrame, registry: DataFrame, robots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(books, rejected) of `pages(url, html, page_kind)`; page_kind is list, detail, feed or linked.

    Pages of no source, pages that robots rules forbid, pages and feeds that cannot be read and
    missing pages of a listing are rejected (url, reason). A list page that another one names as its
    folder counts as part of that list; pages of a listing follow each other by number. Linked pages
    complete the rows that lead to them. The rows of one source and URL become one: each field from
    the detail page, where it lacks it from the list or feed, for some sources the other way round; several
    sources may have the same book.
    """
    own, further = pages.where("page_kind <> 'linked'"), pages.where("page_kind = 'linked'")
    routed = robots_join(url_source_join(own, registry), robots, registry)
    served = F.when(F.col("page_kind") == "feed", feed_source(F.col("url"), F.col("source_id"))).otherwise(F.col("source_id"))
    checked = routed.withColumn("source_id", served)
    reason = F.when(F.col("source_id").isNull(), "no source").when(~F.col("allowed"), "robots.txt")
    checked = checked.withColumn("reason", reason)
    usable = checked.where("reason is null").select("url", "html", "source_id", "page_kind")
    # Written, so that pages are parsed once for their books, folders and errors.
    found = materialize(extract(usable.where("page_kind <> 'feed'"), rulesets.rules()))
    read = valid_rows(books_from_fields(found, registry))
    # Lists mix printed and electronic editions; detail pages are of the edition asked for.
    rows = media_filter(read.where("page_kind = 'list'")).unionByName(read.where("page_kind = 'detail'"))
    fed, unread_feeds = read_feeds(usable.where("page_kind = 'feed'"))
    every = rows.unionByName(valid_rows(fed), allowMissingColumns=True)

    paged = usable.where((F.col("page_kind") == "list") & F.col("source_id").isin(*PAGED))
    numbers, missing = listing_pages(paged)
    numbers = materialize(numbers).withColumnRenamed("url", "page_url")
    placed = every.join(numbers, "page_url", "left").where(~F.coalesce("beyond", F.lit(False)))
    placed = placed.withColumn("position", F.shiftleft(F.coalesce("page_no", F.lit(1)).cast("bigint") - 1, 32) + F.col("position"))

    complete = follow_link(placed, linked_pages(further, robots), "more_url")
    # Rows of a folder come after those of the list that names it.
    folders = folder_pages(found).groupBy(F.col("url").alias("page_url")).agg(F.min("page_url").alias("__index"))
    ordered = complete.join(folders, "page_url", "left")
    order = [(F.col("page_kind") != "detail"), F.col("__index").isNotNull(), F.coalesce("page_no", F.lit(1)), F.col("page_url"), F.col("position")]
    given = [c for c in BOOK if c not in ("source_id", "url", "position", "currency")]
    ranks = {c: _rank(c) for c in given} | {"page_url": F.lit(0)}
    books = merge_fields(ordered, ["source_id", "url"], ranks, order, {"price": ["currency"], "page_url": ["position"]})
    books = books.withColumn("authors", F.coalesce("authors", F.array().cast("array<string>")))
    unread = found.where("error is not null").select("url", F.col("error").alias("reason"))
    rejected = checked.where("reason is not null").select("url", "reason").unionByName(unread).unionByName(unread_feeds).unionByName(missing)
    return books.select("page_url", *BOOK), rejected
