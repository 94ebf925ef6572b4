"""The output form of book rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stores import drm_label
from ..functions.text import collapse_ws


def format_books(books: DataFrame) -> DataFrame:
    """Titles on one line, a label next to each store's protection code; nothing is dropped."""
    stores = F.transform("ebook_stores", lambda s: s.withField("drm_label", drm_label(s["drm"])))
    return books.withColumns(
        {
            "title": collapse_ws(F.col("title")),
            "subtitle": collapse_ws(F.col("subtitle")),
            "ebook_stores": stores,
        }
    )


def write_books(books: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Write formatted books, one folder per source, so that readers of one source skip the rest."""
    format_books(books).write.partitionBy("source_id").mode(mode).format(fmt).save(path)
