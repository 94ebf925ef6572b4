"""Filling gaps in book rows from the bibliography, and defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.people import dedupe_authors
from ..functions.stores import asin_from_stores
from ..sources.registry import DEFAULT_LANGUAGE

FILLED = ["contributors", "published_at", "price", "cover_image_url", "description"]


def enrich(books: DataFrame, bib: DataFrame) -> DataFrame:
    """Left join on ISBN that fills what a row lacks and overwrites nothing.

    Authors count as missing when the array is empty, the other columns when null; titles,
    publisher and URL are never touched. `bib` holds one row per ISBN.
    """
    right = bib.select(
        F.col("isbn").alias("__isbn"),
        F.col("authors").alias("__authors"),
        *[F.col(c).alias(f"__{c}") for c in FILLED],
    )
    # A made-up key that matches nothing spreads the rows without an ISBN over all partitions.
    spread = F.concat_ws("\u0000", F.lit("no isbn"), "source_id", F.col("position").cast("string"))
    keyed = books.withColumn("__key", F.coalesce(F.col("isbn"), spread)).join(
        right, F.col("__key") == F.col("__isbn"), "left"
    )
    no_authors = F.coalesce(F.size("authors"), F.lit(0)) <= 0
    filled = {
        "authors": F.when(no_authors, F.coalesce("__authors", "authors")).otherwise(F.col("authors")),
        **{c: F.coalesce(c, f"__{c}") for c in FILLED},
    }
    return keyed.select(*[filled.get(c, F.col(c)).alias(c) for c in books.columns])


def stamp_defaults(books: DataFrame, registry: DataFrame) -> DataFrame:
    """Language of the row, else of its source, else the default; identifier from store links."""
    langs = registry.select("source_id", F.col("language").alias("__language"))
    # The registry has a fixed few dozen rows.
    out = books.join(F.broadcast(langs), "source_id", "left")
    stamped = {
        "language": F.coalesce("language", "__language", F.lit(DEFAULT_LANGUAGE)),
        "asin": F.coalesce(F.col("asin"), asin_from_stores(F.col("ebook_stores"))),
        "currency": F.coalesce(F.col("currency"), F.when(F.col("price").isNotNull(), "JPY")),
    }
    return out.select(*[stamped.get(c, F.col(c)).alias(c) for c in books.columns])


def with_distinct_authors(books: DataFrame) -> DataFrame:
    return books.withColumn("authors", dedupe_authors(F.coalesce("authors", F.array().cast("array<string>"))))
