"""Looking up a table of ISBNs through the chain of places a book can be found in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.people import dedupe_authors
from ..functions.stores import asin_from_stores
from ..operators.joins import first_row_fallback, isbn_source_join, robots_join, url_source_join
from ..operators.ranking import first_match
from ..schemas import BOOK, as_books
from ..sources.registry import DEFAULT_LANGUAGE

# Where a book came from.
BIBLIOGRAPHY, PUBLISHER, SECONDARY = "isbn:openbd", "isbn:publisher", "isbn:calil"


def _packed(df: DataFrame, key: str, name: str) -> DataFrame:
    """(key, book struct) of book-shaped rows."""
    kept = df.withColumn("__key", F.col(key))
    return as_books(kept, "__key").select(
        F.col("__key").alias(key), F.struct(*[F.col(c) for c in BOOK]).alias(name)
    )


def by_isbn(
    isbns: DataFrame,
    bib: DataFrame,
    registry: DataFrame,
    codes: DataFrame,
    page_books: DataFrame,
    catalog: DataFrame,
    secondary: DataFrame,
    robots: DataFrame,
    strict_isbn: bool = False,
    listing: DataFrame | None = None,
) -> DataFrame:
    """(isbn, source, book) for every distinct ISBN that can be found.

    `bib`: one row per ISBN with `store_link`; `page_books`: book rows of fetched detail pages by
    `url`; `robots`: rules from `robots_rules`; `secondary`: fallback rows by ISBN; `listing`:
    keyword listings (keyword, source_id, position, …) for the fallback to the first row.

    ISBNs in the bibliography: page behind the store link, else the catalog of the source the ISBN
    belongs to, else the bibliography row. Others: the page at the ISBN's fixed address, else
    the secondary bibliography.

    Every place is joined to the ISBNs by ISBN, one row each, so the ISBNs are shuffled once for
    all of them, and once more by URL for the pages.
    """
    asked = isbns.select("isbn").where("isbn is not null").distinct()
    owned = isbn_source_join(asked, codes).withColumnRenamed("source_id", "code_source")

    own_rows = isbn_source_join(
        catalog.where("isbn is not null").withColumnRenamed("source_id", "listed"), codes
    ).where("source_id = listed")
    in_catalog = first_match(own_rows.drop("listed"), ["isbn"], F.col("position"))
    base = (
        owned.join(_packed(bib, "isbn", "bib_book"), "isbn", "left")
        .join(bib.select("isbn", "store_link"), "isbn", "left")
        .join(_packed(in_catalog, "isbn", "catalog_book"), "isbn", "left")
        .join(_packed(secondary, "isbn", "secondary_book"), "isbn", "left")
    )
    if listing is not None and not strict_isbn:
        own = isbn_source_join(
            listing.withColumnRenamed("source_id", "listed"), codes, "keyword"
        ).where("source_id = listed").drop("listed")
        found = first_row_fallback(asked, own).select(F.col("isbn").alias("keyword"), "found.*")
        base = base.join(
            _packed(found, "keyword", "listed_book").withColumnRenamed("keyword", "isbn"), "isbn", "left"
        )

    known = F.col("bib_book").isNotNull()
    # The registry has a fixed few dozen rows.
    templates = registry.select(F.col("source_id").alias("code_source"), "detail_url_template")
    fixed = F.replace("detail_url_template", F.lit("{isbn}"), F.col("isbn"))
    routed = robots_join(
        url_source_join(
            base.join(F.broadcast(templates), "code_source", "left").withColumn(
                "url", F.when(known, F.col("store_link")).otherwise(fixed)
            ),
            registry,
        ),
        robots,
        registry,
    )
    page_source = F.when(known, F.col("source_id")).otherwise(F.col("code_source"))
    usable = F.col("allowed") & page_source.isNotNull() & F.col("url").isNotNull()
    # ISBNs without a page get a key that matches nothing and spreads them.
    with_page = (
        routed.withColumn("page_source", page_source)
        .withColumn("url", F.when(usable, F.col("url")).otherwise(F.concat(F.lit("no page "), "isbn")))
        .join(_packed(page_books.drop("source_id"), "url", "page_book"), "url", "left")
    )
    page = F.when(
        F.col("page_book").isNotNull(), F.col("page_book").withField("source_id", F.col("page_source"))
    )
    listed = F.col("listed_book") if "listed_book" in base.columns else None
    chain = [c for c in (F.col("catalog_book"), listed, F.col("bib_book")) if c is not None]
    picked = with_page.select(
        F.col("isbn").alias("asked"),
        F.coalesce(page, F.when(known, F.coalesce(*chain)).otherwise(F.col("secondary_book"))).alias("book"),
        F.when(F.col("page_book").isNotNull(), PUBLISHER)
        .when(known, F.when(F.coalesce(*chain[:-1]).isNotNull(), PUBLISHER).otherwise(BIBLIOGRAPHY))
        .otherwise(SECONDARY)
        .alias("source"),
    ).where("book is not null")
    flat = picked.select("asked", "source", "book.*")
    langs = registry.select("source_id", F.col("language").alias("__language"))
    stamped = flat.join(F.broadcast(langs), "source_id", "left")
    filled = {
        "language": F.coalesce("language", "__language", F.lit(DEFAULT_LANGUAGE)),
        "authors": dedupe_authors(F.coalesce("authors", F.array().cast("array<string>"))),
        "asin": F.coalesce(F.col("asin"), asin_from_stores(F.col("ebook_stores"))),
    }
    book = F.struct(*[filled.get(c, F.col(c)).alias(c) for c in BOOK])
    return stamped.select(F.col("asked").alias("isbn"), "source", book.alias("book"))


def books_by_isbn(isbns: DataFrame, *args, **kwargs) -> DataFrame:
    """Every ISBN asked for, unmatched ones with null book and source."""
    return isbns.join(by_isbn(isbns, *args, **kwargs), "isbn", "left")
