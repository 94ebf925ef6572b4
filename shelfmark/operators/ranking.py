"""Top rows per group, ranks, runners-up, first matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The largest and the usual number of rows asked for per source.
MAX_LIMIT = 50
DEFAULT_LIMIT = 10


def clamp_limit(c: Column, cap: int = MAX_LIMIT) -> Column:
    return F.least(F.coalesce(c, F.lit(DEFAULT_LIMIT)), F.lit(cap))


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], limit: Column, cap: int) -> DataFrame:
    """First rows of each group in `order`, as many as the row's `limit` says; no limit is over `cap`.

    The constant cap is filtered first: Spark then keeps only `cap` rows per group before the
    shuffle, so that a group with a third of all rows costs no more than another.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("__rn", F.row_number().over(w))
        .where(F.col("__rn") <= cap)
        .where(F.col("__rn") <= limit)
        .drop("__rn")
    )


def score_order(score: str = "match_score") -> list[Column]:
    """Best score first; ties: major sources, registry order, position."""
    return [
        F.col(score).desc(),
        (F.coalesce(F.col("scale"), F.lit("")) == "minor").asc(),
        F.col("ordinal").asc(),
        F.col("position").asc(),
    ]


def rank_by_score(df: DataFrame, key: str, score: str = "match_score") -> DataFrame:
    """Rank of each row within `key`, starting at 1."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*score_order(score))))


def with_runner_up(ranked: DataFrame, key: str, score: str = "match_score") -> DataFrame:
    """Each ranked row with the score of the next row of its group (null for the last)."""
    w = Window.partitionBy(key).orderBy("rank")
    return ranked.withColumn("second_score", F.lead(score).over(w))


def best_and_second(ranked: DataFrame, key: str, score: str = "match_score") -> DataFrame:
    """Best row of each group with the runner-up's score."""
    return with_runner_up(ranked, key, score).where("rank = 1")


def source_priority(registry: DataFrame) -> DataFrame:
    """Registry in the order sources are asked: major ones first, otherwise as registered."""
    minor = F.coalesce(F.col("scale"), F.lit("")) == "minor"
    return registry.withColumn(
        "priority", F.row_number().over(Window.orderBy(minor.asc(), F.col("ordinal").asc())) - 1
    )


def first_match(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each group in a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def union_sources(*frames: DataFrame) -> DataFrame:
    """All rows of all sources; the same book from two sources stays twice."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def distinct_urls(books: DataFrame, *order: Column) -> DataFrame:
    """Keep the first row of each URL."""
    return first_match(books, ["url"], *order)
