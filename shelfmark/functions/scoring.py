"""Match scores between a query and a book, all on columns of match keys.

Keys come from `text.match_key`; computing them once per distinct string before any join
is the caller's job, so that no score normalises a text again for every pair.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import has_edition, strip_edition

# Thresholds of the grading rules.
SAME_WORK = 0.5
HIGH = 0.9
MEDIUM = 0.5
AMBIGUOUS_GAP = 0.1
TOKEN_CAP = 0.9


def containment_score(a: Column, b: Column) -> Column:
    """1 when equal, 0.5 plus half the length ratio when one contains the other, else 0."""
    la, lb = F.length(a).cast("double"), F.length(b).cast("double")
    return (
        F.when(a.isNull() | b.isNull() | (a == "") | (b == ""), F.lit(0.0))
        .when(a == b, F.lit(1.0))
        .when(F.contains(b, a), F.lit(0.5) + F.lit(0.5) * (la / lb))
        .when(F.contains(a, b), F.lit(0.5) + F.lit(0.5) * (lb / la))
        .otherwise(F.lit(0.0))
    )


def token_score(matched: Column, total: Column) -> Column:
    """Capped share of matched query tokens."""
    share = F.lit(TOKEN_CAP) * (matched.cast("double") / total.cast("double"))
    return F.when((total > 0) & (matched > 0), F.least(F.lit(TOKEN_CAP), share)).otherwise(F.lit(0.0))


def title_match_score(query_key: Column, query_tokens: Column, title_key: Column) -> Column:
    """1 when equal, else the capped share of query tokens found in the title."""
    matched = F.size(F.filter(query_tokens, lambda t: F.contains(title_key, t)))
    return (
        F.when(query_key.isNull() | title_key.isNull() | (query_key == "") | (title_key == ""), F.lit(0.0))
        .when(query_key == title_key, F.lit(1.0))
        .otherwise(token_score(matched, F.size(query_tokens)))
    )


def author_match_score(query_key: Column, author_keys: Column) -> Column:
    """Best containment score over the authors."""
    best = F.array_max(F.transform(author_keys, lambda a: containment_score(query_key, a)))
    return F.coalesce(best, F.lit(0.0))


def mean_score(title_score: Column, author_score: Column, has_title: Column, has_author: Column) -> Column:
    """Mean of the parts the query has; 0 when it has none."""
    return (
        F.when(has_title & has_author, (title_score + author_score) / F.lit(2.0))
        .when(has_title, title_score)
        .when(has_author, author_score)
        .otherwise(F.lit(0.0))
    )


def same_work_score(a_key: Column, b_key: Column) -> Column:
    """Containment score with edition marks folded away."""
    return containment_score(strip_edition(a_key), strip_edition(b_key))


def title_exact(a_key: Column, b_key: Column) -> Column:
    return (a_key != "") & (a_key == b_key)


def round3(x: Column) -> Column:
    return F.floor(x * F.lit(1000.0) + F.lit(0.5)).cast("double") / F.lit(1000.0)


def confidence(score: Column) -> Column:
    return F.when(score >= HIGH, "high").when(score >= MEDIUM, "medium").otherwise("low")


def validation(request_isbn: Column, query_key: Column, book_isbn: Column, title_key: Column) -> Column:
    """How the book found agrees with the clue; parts that cannot be judged are null.

    `query_key` must be null when the clue has no title.
    """
    isbn_matches = F.when(
        request_isbn.isNotNull(), F.coalesce(book_isbn == request_isbn, F.lit(False))
    )
    has_title = query_key.isNotNull()
    same = same_work_score(query_key, title_key)
    exact = F.coalesce(title_exact(query_key, title_key), F.lit(False))
    agree = same >= SAME_WORK
    marked = F.coalesce(has_edition(query_key), F.lit(False)) | F.coalesce(has_edition(title_key), F.lit(False))
    differs = has_title & ~F.coalesce(isbn_matches, F.lit(False)) & agree & ~exact & marked
    return F.struct(
        isbn_matches.alias("isbn_matches"),
        F.when(has_title, agree).alias("isbn_title_agree"),
        F.when(has_title, exact).alias("title_exact"),
        F.when(has_title, round3(same)).alias("same_work"),
        F.coalesce(differs, F.lit(False)).alias("edition_differs"),
    )


def is_ambiguous(best: Column, second: Column) -> Column:
    """A runner-up exists and is too close to a good but not perfect best score."""
    return F.coalesce(
        second.isNotNull() & (best < 1.0) & (best >= MEDIUM) & ((best - second) < AMBIGUOUS_GAP),
        F.lit(False),
    )
