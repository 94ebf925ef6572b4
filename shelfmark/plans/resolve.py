"""Resolving vague clues to one book each, with a grade and an explanation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.isbn import looks_like_isbn, normalize_isbn
from ..functions.text import empty_to_null, match_key, token_keys, trim_blanks
from ..operators.ranking import with_runner_up
from ..operators.top_matches import top_matches
from ..schemas import BOOK
from ..storage import materialize
from .by_isbn import by_isbn
from .search import prepare_catalog

# Number of candidates shown, and reasons.
CANDIDATES = 3
REASON_ISBN = ("ISBN ", " の書誌情報が見つかりませんでした")
REASON_EMPTY = "isbn / title / author のいずれも指定がありません"
REASON_NO_MATCH = "一致する書籍が見つかりませんでした"
REASON_OTHER_BOOK = ("要求ISBN ", " は解決できず、書名一致で代替候補を返しています（返却ISBN: ", "なし", "）")

RESULT = [
    "clue_id",
    "status",
    "confidence",
    "book",
    "match_score",
    "source",
    "validation",
    "candidates",
    "reason",
]


def _clean(clues: DataFrame) -> DataFrame:
    isbn = trim_blanks(F.col("isbn"))
    shaped = F.coalesce(looks_like_isbn(isbn), F.lit(False))
    return clues.select(
        "clue_id",
        isbn.alias("isbn"),
        F.when(shaped, normalize_isbn(isbn)).alias("request_isbn"),
        empty_to_null(F.col("title")).alias("title"),
        empty_to_null(F.col("author")).alias("author"),
        empty_to_null(F.col("publisher_id")).alias("publisher_id"),
    ).withColumn("title_key", match_key(F.col("title")))


def _book_struct() -> Column:
    return F.struct(*[F.col(c) for c in BOOK])


def not_found(clues: DataFrame, reason, like: DataFrame) -> DataFrame:
    """Result rows for clues without an answer; columns and types as in `like`."""
    empty = {
        "clue_id": F.col("clue_id"),
        "status": F.lit("not_found"),
        "confidence": F.lit("low"),
        "match_score": F.lit(0.0),
        "source": F.lit("none"),
        "reason": reason,
    }
    types = dict((f.name, f.dataType) for f in like.schema.fields)
    return clues.select(*[empty.get(c, F.lit(None).cast(types[c])).alias(c) for c in RESULT])


def resolve(
    clues: DataFrame,
    bib: DataFrame,
    registry: DataFrame,
    codes: DataFrame,
    page_books: DataFrame,
    catalog: DataFrame,
    secondary: DataFrame,
    robots: DataFrame,
    strict_isbn: bool = False,
    listing: DataFrame | None = None,
    errors: DataFrame | None = None,
) -> DataFrame:
    """One result row per clue of `clues(clue_id, isbn, title, author, publisher_id)`.

    `errors(clue_id, message)`: clues that failed on the way here, as by a source that did not
    answer; they are not looked up and come out as not_found with the message as reason.
    """
    failed = None
    if errors is not None:
        failed = errors.groupBy("clue_id").agg(F.min("message").alias("message"))
        clues, unanswered = clues.join(failed, "clue_id", "left_anti"), clues.select("clue_id").join(failed, "clue_id")
    asked = materialize(_clean(clues))
    hits = by_isbn(
        asked.select(F.col("request_isbn").alias("isbn")),
        bib, registry, codes, page_books, catalog, secondary, robots, strict_isbn, listing,
    ).select(F.col("isbn").alias("request_isbn"), "source", "book")

    # Written once: the clues that were found and those still open are read from it.
    with_isbn = materialize(asked.where("request_isbn is not null").join(hits, "request_isbn", "left"))
    by_number = _matched_by_isbn(with_isbn.where("book is not null"))
    open_isbn = with_isbn.where("book is null").select(asked.columns)
    rest = open_isbn.unionByName(asked.where("request_isbn is null"))
    has_text = F.col("title").isNotNull() | F.col("author").isNotNull()

    searched = _search_branch(rest.where(has_text), catalog, bib, registry)
    nothing = not_found(
        rest.where(~has_text),
        F.when(
            F.col("request_isbn").isNotNull(), F.concat(F.lit(REASON_ISBN[0]), "isbn", F.lit(REASON_ISBN[1]))
        ).otherwise(F.lit(REASON_EMPTY)),
        searched,
    )
    out = by_number.unionByName(searched).unionByName(nothing)
    return out if failed is None else out.unionByName(not_found(unanswered, F.col("message"), out))


def _matched_by_isbn(found: DataFrame) -> DataFrame:
    keyed = found.select(
        "*",
        match_key(F.col("book.title")).alias("book_key"),
        token_keys(F.col("title")).alias("tokens"),
        normalize_isbn(F.col("book.isbn")).alias("book_isbn"),
    )
    score = scoring.title_match_score(F.col("title_key"), F.col("tokens"), F.col("book_key"))
    graded = keyed.withColumn(
        "validation",
        scoring.validation(
            F.col("request_isbn"), F.when(F.col("title").isNotNull(), F.col("title_key")),
            F.col("book_isbn"), F.col("book_key"),
        ),
    ).withColumn("score", F.when(F.col("title").isNotNull(), scoring.round3(score)).otherwise(F.lit(1.0)))
    disagrees = F.coalesce(~F.col("validation.isbn_title_agree"), F.lit(False))
    return graded.select(
        "clue_id",
        F.lit("matched").alias("status"),
        F.when(disagrees, "low").otherwise("high").alias("confidence"),
        "book",
        F.col("score").alias("match_score"),
        "source",
        "validation",
        F.lit(None).cast(_candidates_type(found)).alias("candidates"),
        F.lit(None).cast("string").alias("reason"),
    )


def _candidates_type(df: DataFrame) -> str:
    book = df.schema["book"].dataType.simpleString()
    return f"array<struct<match_score:double,book:{book}>>"


def _search_branch(clues: DataFrame, catalog: DataFrame, bib: DataFrame, registry: DataFrame) -> DataFrame:
    books = prepare_catalog(catalog, bib, registry)
    clues = materialize(clues)
    forms = clues.select(
        F.col("title").alias("query_title"), F.col("author").alias("query_author"), "publisher_id"
    ).distinct()
    # Five rows per source are asked for, and three over all sources are looked at.
    top = with_runner_up(
        top_matches(forms, books.select("source_id", "position", "title_key", "author_keys"), registry, CANDIDATES)
        .withColumn("form", F.struct("query_title", "query_author", "publisher_id")),
        "form",
    ).drop("form")
    asked = clues.select("clue_id", "title", "author", F.col("publisher_id").alias("wanted"))
    top = asked.join(
        top,
        F.col("title").eqNullSafe(F.col("query_title"))
        & F.col("author").eqNullSafe(F.col("query_author"))
        & F.col("wanted").eqNullSafe(F.col("publisher_id")),
    ).select("clue_id", "rank", "match_score", "second_score", "source_id", "position")
    with_books = top.join(
        books.select("source_id", "position", _book_struct().alias("book"), F.col("title_key").alias("book_key")),
        ["source_id", "position"],
    )
    per_clue = with_books.groupBy("clue_id").agg(
        F.min_by(F.struct("match_score", "second_score", "book", "book_key"), "rank").alias("best"),
        F.map_from_entries(F.collect_list(F.struct("rank", F.struct("match_score", "book")))).alias("by_rank"),
    )
    joined = clues.join(per_clue, "clue_id", "left")
    found = joined.where("best is not null").select(
        *clues.columns, "best.*", "by_rank", normalize_isbn(F.col("best.book.isbn")).alias("book_isbn")
    )
    graded = found.withColumn(
        "validation",
        scoring.validation(
            F.col("request_isbn"), F.when(F.col("title").isNotNull(), F.col("title_key")),
            F.col("book_isbn"), F.col("book_key"),
        ),
    )
    other = F.col("request_isbn").isNotNull() & ~F.coalesce("validation.isbn_matches", F.lit(False))
    ambiguous = scoring.is_ambiguous(F.col("match_score"), F.col("second_score"))
    before, middle, none, after = REASON_OTHER_BOOK
    reason = F.concat(
        F.lit(before), "isbn", F.lit(middle), F.coalesce("book.isbn", F.lit(none)), F.lit(after)
    )
    ranks = F.filter(
        F.transform(F.array(*[F.lit(i) for i in range(1, CANDIDATES + 1)]), lambda i: F.try_element_at(F.col("by_rank"), i)),
        lambda c: c.isNotNull(),
    )
    matched = graded.select(
        "clue_id",
        F.when(ambiguous, "ambiguous").otherwise("matched").alias("status"),
        F.when(other, "low").otherwise(scoring.confidence(F.col("match_score"))).alias("confidence"),
        "book",
        "match_score",
        F.lit("search").alias("source"),
        "validation",
        F.when(ambiguous, ranks).alias("candidates"),
        F.when(other, reason).alias("reason"),
    )
    return matched.unionByName(
        not_found(joined.where("best is null"), F.lit(REASON_NO_MATCH), matched)
    )

