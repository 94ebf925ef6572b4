"""Row filters of the catalog and query jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.isbn import looks_like_isbn
from ..functions.text import trim_blanks

# Seconds a fetched page, robots file or whole catalog stays valid.
PAGE_TTL = 3600
ROBOTS_TTL = 6 * 3600
CATALOG_TTL = 24 * 3600


def filter_source(books: DataFrame, source_id: str | None) -> DataFrame:
    return books if source_id is None else books.where(F.col("source_id") == source_id)


def _blank(c: Column) -> Column:
    return F.coalesce(trim_blanks(c), F.lit("")) == ""


# How each source marks its electronic editions, as (column, test, value).
MEDIA_RULES = {
    "born-digital": ("title", "startswith", "【"),
    "rutles": ("title", "contains", "【電子版】"),
    "saiensu": ("media", "equals", "電子"),
    "seshop": ("category", "startswith", "電子書籍"),
    "coronasha": ("statuses", "has", "電子版あり"),
}


def media_filter(rows: DataFrame) -> DataFrame:
    """Electronic editions only, for the sources that list both kinds; other sources pass."""
    tests = {
        "startswith": lambda c, v: c.startswith(v),
        "contains": lambda c, v: F.contains(c, F.lit(v)),
        "equals": lambda c, v: c == v,
        "has": lambda c, v: F.array_contains(c, v),
    }
    keep = None
    for source, (column, test, value) in MEDIA_RULES.items():
        hit = F.coalesce(tests[test](F.col(column), value), F.lit(False))
        keep = F.when(F.col("source_id") == source, hit) if keep is None else keep.when(
            F.col("source_id") == source, hit
        )
    return rows.where(keep.otherwise(F.lit(True)))


def valid_rows(rows: DataFrame) -> DataFrame:
    """Drop items without a title or a link."""
    return rows.where(~_blank(F.col("title")) & ~_blank(F.col("url")))


def relevance_filter(scored: DataFrame, has_query: Column, score: str = "match_score") -> DataFrame:
    """Rows of a real query need a score above 0; without a query all rows stay."""
    return scored.where(~has_query | (F.col(score) > 0))


def fresh_snapshot(fetch_log: DataFrame, as_of: Column) -> DataFrame:
    """Latest fetch of each URL that is still valid at `as_of`; without a TTL for ever."""
    rest = [c for c in fetch_log.columns if c not in ("url", "fetched_at")]
    latest = fetch_log.groupBy("url").agg(
        F.max_by(F.struct("fetched_at", *rest), F.struct("fetched_at", *rest)).alias("r")
    )
    rows = latest.select("url", "r.*")
    expiry = F.col("fetched_at") + F.make_dt_interval(secs=F.col("ttl_s").cast("decimal(18,6)"))
    return rows.where(F.col("ttl_s").isNull() | (as_of <= expiry))


def isbn_route(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queries whose title is an ISBN and that name no author, and all the others."""
    by_isbn = F.coalesce(looks_like_isbn(F.col("title")), F.lit(False)) & (
        F.coalesce(F.col("author"), F.lit("")) == ""
    )
    return queries.where(by_isbn), queries.where(~by_isbn)
