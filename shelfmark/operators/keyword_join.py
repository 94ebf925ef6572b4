"""Keyword filters of local catalogs, for a whole table of queries at once.

Both work on the raw lower-cased texts, not on match keys, and find their pairs through
`contained_pairs`, so that no query is compared with every row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WS, empty_to_null, trim_blanks
from ..storage import materialize
from .score_join import BROADCAST_ROWS, contained_pairs

#: Rows and queries of one text that meet in one cell.
ROWS, QUERIES = 20_000, 200
#: A row is about so many times as large as a query.
WEIGHT = 8


def _needle(c: Column) -> Column:
    return empty_to_null(F.lower(trim_blanks(c)))


def _pairs(needles: DataFrame, haystacks: DataFrame) -> DataFrame:
    return contained_pairs(
        needles.where("needle is not null and needle != ''").distinct(),
        haystacks.where("haystack is not null and haystack != ''").distinct(),
    )


def _answers(asked: DataFrame, found: DataFrame, rows: DataFrame, key: str, text: str) -> DataFrame:
    """(query_id, source_id, position): rows of the texts found for a key, given to all queries of the key.

    `asked(query_id, key, wanted)`, `found(key, text)`, `rows(text, source_id, position, names)`. Queries of
    one key and author lie in rows of about `QUERIES`; these and a key's rows meet in cells of at most about
    `ROWS` times `QUERIES` answers, and are told apart there, so that no answer is dealt out again.
    Cells are cut so that little is copied: a query is a number, a row far more, so the rows are split first.
    """
    found = materialize(found)
    counts = asked.groupBy(key, "wanted").agg(F.count("*").alias("n"))
    sizes = rows.groupBy(text).agg(F.count("*").alias("b"))
    cells = F.ceil(F.col("a") / QUERIES * F.col("b") / ROWS)
    cols = F.least(F.col("b"), cells, F.ceil(F.sqrt(cells * WEIGHT * F.col("b") / F.col("a"))))
    shape = (
        found.join(sizes, text).groupBy(key).agg(F.sum("b").alias("b"))
        .join(counts.groupBy(key).agg(F.sum("n").alias("a")), key)
        .select(key, cells.alias("cells"), cols.alias("cols"))
        .select(key, F.col("cols").cast("int").alias("cols"), F.ceil(F.col("cells") / F.col("cols")).cast("int").alias("lines"))
        .where("cols > 1 or lines > 1")
    )
    shape = materialize(shape)
    if shape.count() <= BROADCAST_ROWS:
        shape = F.broadcast(shape)
    one = F.lit(1)
    spark = asked.sparkSession
    # As many parts as asked for: the answers are far larger than what is dealt out.
    parts = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    counts = counts.select(F.col(key).alias("k"), F.col("wanted").alias("w"), F.ceil(F.col("n") / QUERIES).alias("of"))
    packed = (
        asked.join(counts, (F.col(key) == F.col("k")) & F.col("wanted").eqNullSafe(F.col("w")))
        .groupBy(key, "wanted", F.pmod(F.xxhash64("query_id"), "of").alias("part"))
        .agg(F.collect_list(F.struct("query_id")).alias("ids"))
    )
    left = packed.join(shape, key, "left").withColumn("line", F.pmod(F.xxhash64("wanted", "part"), F.coalesce("lines", one)).cast("int"))
    left = left.withColumn("col", F.explode(F.sequence(F.lit(0), F.coalesce("cols", one) - 1))).drop("cols", "lines", "part")
    books = found.join(rows, text).drop(text)
    right = books.join(shape, key, "left").withColumn("col", F.pmod(F.xxhash64("source_id", "position"), F.coalesce("cols", one)).cast("int"))
    right = right.withColumn("line", F.explode(F.sequence(F.lit(0), F.coalesce("lines", one) - 1))).drop("cols", "lines")
    on = [key, "line", "col"]
    met = left.repartition(parts, *on).join(right.repartition(parts, *on), on)
    met = met.where(F.col("wanted").isNull() | F.contains("names", F.col("wanted")))
    return met.select(F.explode("ids").alias("id"), "source_id", "position").select("id.query_id", "source_id", "position")


def keyword_filter(queries: DataFrame, books: DataFrame, with_author: bool = False) -> DataFrame:
    """(query_id, source_id, position) of rows whose title contains the query title.

    A query without a title finds nothing. `with_author`: the joined author names must contain
    the query author as well, if it has one.
    """
    asked = queries.select(
        "query_id", _needle(F.col("title")).alias("needle"), _needle(F.col("author")).alias("wanted")
    ).where("needle is not null")
    rows = books.select(
        "source_id",
        "position",
        F.lower("title").alias("haystack"),
        *([F.lower(F.array_join("authors", " ")).alias("names")] if with_author else []),
    )
    found = _pairs(asked.select("needle"), rows.select("haystack"))
    if not with_author:
        asked, rows = asked.withColumn("wanted", F.lit(None).cast("string")), rows.withColumn("names", F.lit(None).cast("string"))
    return _answers(asked, found, rows, "needle", "haystack")


def token_and_filter(queries: DataFrame, index: DataFrame) -> DataFrame:
    """(query_id, source_id, position) of index rows with every title token and the author.

    `index(source_id, position, haystack, author_text)`. A query with neither finds nothing; one with
    only an author is filtered by the author alone.
    """
    asked = queries.select(
        "query_id", _needle(F.col("title")).alias("title"), _needle(F.col("author")).alias("wanted")
    )
    rows = index.select("source_id", "position", "haystack", F.lower("author_text").alias("names"))
    titles = (
        asked.where("title is not null")
        .select(F.col("title").alias("needle"))
        .distinct()
        .withColumn("parts", F.filter(F.array_distinct(F.split("needle", f"{WS}+")), lambda p: p != ""))
    )
    texts = rows.select("haystack").where("haystack is not null and haystack != ''").distinct()
    # A row is looked up under the rarest n-gram of all tokens and must hold the others as well.
    complete = contained_pairs(titles, texts).withColumnRenamed("needle", "title")
    by_title = _answers(asked.where("title is not null"), complete, rows, "title", "haystack")
    only_author = asked.where("title is null and wanted is not null")
    names = _pairs(
        only_author.select(F.col("wanted").alias("needle")), rows.select(F.col("names").alias("haystack"))
    ).select(F.col("needle").alias("wanted"), F.col("haystack").alias("names"))
    by_author = (
        only_author.join(names.join(rows, "names").drop("names", "haystack"), "wanted").select("query_id", "source_id", "position")
    )
    return by_title.unionByName(by_author)
