"""The reference bibliography: batch responses to one row per ISBN."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, money, people
from ..functions.text import bibliographic_title, empty_to_null
from ..schemas import BIB_ENTRY

# Fixed value: address used when an entry has no store link.
ENTRY_URL = "https://api.openbd.jp/v1/get?isbn="


def read_bibliography(batches: DataFrame) -> DataFrame:
    """(isbn, entry) from `batches(pos, isbns array, body json)`.

    A response lists entries by position of the requested ISBNs, null for unknown ones. When an
    ISBN was asked for twice the later answer wins.
    """
    entries = F.from_json("body", f"array<{BIB_ENTRY}>")
    rows = batches.select(
        "pos", F.posexplode(F.arrays_zip(F.col("isbns").alias("isbn"), entries.alias("entry"))).alias("i", "e")
    ).select("pos", "i", "e.isbn", "e.entry")
    found = rows.where("entry is not null and isbn is not null")
    return found.groupBy("isbn").agg(F.max_by("entry", F.struct("pos", "i")).alias("entry"))


def text_by_type(texts: Column, *types: str) -> Column:
    """First non-empty text, looking at the first entry of each type in turn."""
    def first(kind: str) -> Column:
        of_kind = F.filter(texts, lambda t: t["TextType"] == kind)
        return empty_to_null(F.get(of_kind, F.lit(0))["Text"])

    picks = [first(t) for t in types]
    return F.coalesce(*picks)


def bibliography_to_books(bib: DataFrame) -> DataFrame:
    """Book rows of bibliography entries, keyed by the ISBN asked for."""
    e = F.col("entry")
    s, onix = e["summary"], e["onix"]
    flat = bib.select(
        "isbn",
        bibliographic_title(s["title"]).alias("t"),
        people.contributors(onix["DescriptiveDetail"]["Contributor"]).alias("contributors"),
        s["author"].alias("summary_author"),
        s["publisher"].alias("publisher"),
        dates.parse_date(s["pubdate"], "compact").alias("published_at"),
        F.element_at(e["hanmoto"], "storelink").alias("store_link"),
        s["isbn"].alias("entry_isbn"),
        money.typed_price(onix["ProductSupply"]["SupplyDetail"]["Price"]).alias("price"),
        empty_to_null(s["cover"]).alias("cover_image_url"),
        text_by_type(onix["CollateralDetail"]["TextContent"], "03", "02").alias("description"),
    )
    return flat.select(
        "isbn",
        "t.*",
        people.bibliography_authors(F.col("contributors"), F.col("summary_author")).alias("authors"),
        "contributors",
        "publisher",
        "published_at",
        F.coalesce("store_link", F.concat(F.lit(ENTRY_URL), "entry_isbn")).alias("url"),
        "store_link",
        F.col("price").cast("decimal(12,2)").alias("price"),
        "cover_image_url",
        "description",
    )
