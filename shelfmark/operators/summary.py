"""What went wrong where: classes and summaries of a fetch log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Label of each class of failure.
ERROR_LABELS = {
    "robots": "robots.txt によりアクセス禁止",
    "timeout": "タイムアウト",
    "http": "HTTPエラー",
    "other": "その他のエラー",
}


def classify_error(message: Column) -> Column:
    return (
        F.when(message.startswith("タイムアウト"), "timeout")
        .when(F.contains(message, F.lit("robots.txt")), "robots")
        .when(message.rlike("^HTTP [0-9]"), "http")
        .otherwise("other")
    )


def error_summary(errors: DataFrame) -> DataFrame:
    """Failures by class with the sources hit, classes in order of first appearance.

    `errors(source_id, ordinal, message)`. Failures are first counted per source, so that the
    list gathered for a class is no longer than the registry.
    """
    per_source = (
        errors.withColumn("type", classify_error(F.col("message")))
        .groupBy("type", "source_id", "ordinal")
        .agg(F.count("*").alias("n"))
    )
    labels = F.create_map(*[F.lit(x) for kv in ERROR_LABELS.items() for x in kv])
    return (
        per_source.groupBy("type")
        .agg(
            F.sum("n").alias("count"),
            F.min("ordinal").alias("first_seen"),
            F.array_sort(F.collect_list(F.struct("ordinal", "source_id", "n"))).alias("hits"),
        )
        .select(
            "type",
            F.element_at(labels, F.col("type")).alias("label"),
            "count",
            F.transform("hits", lambda h: h["source_id"]).alias("sources"),
            "first_seen",
        )
    )


def partial_results(extracted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that worked and rows that failed of one job whose rows carry an `error` column."""
    return extracted.where("error is null").drop("error"), extracted.where("error is not null")


def max_page(links: Column) -> Column:
    """Largest page number among pager links; at least 1."""
    pages = F.transform(links, lambda h: F.regexp_extract(h, "[?&]page=([0-9]+)", 1).try_cast("int"))
    return F.greatest(F.lit(1), F.array_max(pages))
