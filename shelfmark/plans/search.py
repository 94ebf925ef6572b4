"""Searching a catalog with a whole table of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.text import empty_to_null, match_key, match_keys, token_keys
from ..operators.enrich import enrich, stamp_defaults, with_distinct_authors
from ..operators.filters import relevance_filter
from ..operators.keyword_join import keyword_filter, token_and_filter
from ..operators.ranking import DEFAULT_LIMIT, rank_by_score, top_per_group
from ..operators.top_matches import form_hits
from ..storage import materialize, shuffles_dropped

# How local catalogs are searched, and rows that a source gives at most.
ALL_TOKENS = ("pragprog",)
WITH_AUTHOR = ("tatsu-zine",)
SOURCE_LIMITS = {"google-books": 40}
FORM = ["query_title", "query_author", "publisher_id"]
#: Books of a source that a query may want for its answers to lie in one row; beyond that they are rows.
LISTED = 1_000


def prepare_catalog(catalog: DataFrame, bib: DataFrame, registry: DataFrame) -> DataFrame:
    """Catalog rows enriched, de-duplicated, stamped and with the keys scores are made of.

    Written once: the score join reads it from several sides, and keys are made once per row.
    """
    books = with_distinct_authors(stamp_defaults(enrich(catalog, bib), registry))
    keyed = books.withColumn("title_key", match_key(F.col("title"))).withColumn(
        "author_keys", match_keys(F.col("authors"))
    )
    return materialize(keyed)


def query_forms(queries: DataFrame) -> DataFrame:
    """Queries with empty parts as null and the usual limit where none is given.

    Limits are taken as they are: whoever takes requests from outside clamps them, see
    `ranking.clamp_limit`.
    """
    return queries.select(
        "query_id",
        empty_to_null(F.col("title")).alias("query_title"),
        empty_to_null(F.col("author")).alias("query_author"),
        empty_to_null(F.col("publisher_id")).alias("publisher_id"),
        F.coalesce(F.col("limit"), F.lit(DEFAULT_LIMIT)).alias("limit"),
    )


def _largest(forms: DataFrame) -> int:
    return forms.agg(F.max("limit")).first()[0] or DEFAULT_LIMIT


def ranked_hits(queries: DataFrame, books: DataFrame, registry: DataFrame, columns: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, rank, source_id, position, match_score, columns): the best rows per query and source.

    Queries that ask for the same are scored once, as many rows as the largest of them wants. These
    lie in one row, in order, so that the answers of a query are ranked where it meets that row:
    answers, which are far more, are neither joined nor sorted. `columns` of the books lie there as well.
    """
    # What was shuffled for the best rows goes once they are written.
    with shuffles_dropped(queries.sparkSession):
        forms = materialize(query_forms(queries))
        distinct = forms.groupBy(*FORM).agg(F.max("limit").alias("limit"))
        best, numbered = form_hits(distinct, books.select("source_id", "position", "title_key", "author_keys"), registry, per_source=True)
        best = materialize(best)
    return _given(forms, numbered, best, registry, books.select("source_id", "position", *columns))


def _given(forms: DataFrame, numbered: DataFrame, best: DataFrame, registry: DataFrame, books: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, source_id, position, match_score): to each query what its limit leaves of its form's answers.

    `best(form_id, source_id, position, match_score, rank)`, the rank within the source; `numbered(form_id, FORM)`.
    With further columns of `books`, those of each answer; answers that no row of `books` has are ranked, then dropped.
    """
    book = ["source_id", "position"]
    columns = [c for c in books.columns if c not in book] if books is not None else []
    same = [F.col(f"n.{c}").eqNullSafe(F.col(f"f.{c}")) for c in FORM]
    asked = forms.alias("f").join(numbered.alias("n"), same).select("f.query_id", "n.form_id", "f.limit")
    # The registry breaks ties between sources only, after each source was cut.
    small = F.broadcast(registry.select("source_id", "scale", "ordinal"))
    out = ["query_id", "rank", "source_id", "position", "match_score"]
    if _largest(forms) > LISTED:
        cut = best.withColumnRenamed("rank", "nth").join(asked, "form_id").where("nth <= limit")
        ranked = rank_by_score(cut.join(small, "source_id"), "query_id").select(*out)
        return ranked.join(books, book).select(*out, *columns) if columns else ranked
    minor = (F.coalesce(F.col("scale"), F.lit("")) == "minor").alias("minor")
    if columns:
        rows = books.groupBy(*book).agg(F.collect_list(F.struct(*columns)).alias("rows"))
        best = best.join(rows, book, "left")
    hit = F.struct((-F.col("match_score")).alias("worse"), minor, "ordinal", "position", "source_id", F.col("rank").alias("nth"), *(["rows"] if columns else []))
    lists = best.join(small, "source_id").groupBy("form_id").agg(F.sort_array(F.collect_list(hit)).alias("hits"))
    own = F.filter("hits", lambda h: h["nth"] <= F.col("limit"))
    met = asked.join(lists, "form_id").select("query_id", F.posexplode(own).alias("at", "hit"))
    answer = [F.col("query_id"), (F.col("at") + 1).alias("rank"), F.col("hit.source_id"), F.col("hit.position"), (-F.col("hit.worse")).alias("match_score")]
    if not columns:
        return met.select(*answer)
    return met.select(*answer, F.explode("hit.rows").alias("row")).select(*out, *[F.col("row")[c].alias(c) for c in columns])


def source_order_hits(queries: DataFrame, books: DataFrame, registry: DataFrame) -> DataFrame:
    """(query_id, rank, source_id, position, match_score) cut before scoring.

    Every source filters its own catalog by keyword and stops at the limit; the rows that are left
    are scored, and those with score 0 dropped. Sources in ALL_TOKENS want every token of the title
    (and the author) in title, description and, where the catalog has them, keywords; sources in
    WITH_AUTHOR want the title as one text and the author.
    """
    forms = materialize(query_forms(queries))
    most = _largest(forms)
    # Queries that ask for the same are looked up and scored once, with as many rows as the largest of them wants.
    distinct = forms.groupBy(*FORM).agg(F.max("limit").alias("limit")).where("limit > 0")
    numbered = materialize(distinct.select(F.monotonically_increasing_id().alias("form_id"), *FORM, "limit"))
    shapes = numbered.select(F.col("form_id").alias("query_id"), F.col("query_title").alias("title"), F.col("query_author").alias("author"), "publisher_id", "limit")
    words = F.col("keywords") if "keywords" in books.columns else F.array().cast("array<string>")
    rows = top_per_group(
        books.select(
            "source_id", "position", "title", "authors", "title_key", "author_keys", "description", words.alias("keywords")
        ),
        ["source_id", "title", "authors", "description", "keywords"],
        [F.col("position")],
        F.lit(most),
        cap=most,
    )
    by_token, by_author = F.col("source_id").isin(*ALL_TOKENS), F.col("source_id").isin(*WITH_AUTHOR)
    index = rows.where(by_token).select(
        "source_id",
        "position",
        F.lower(F.concat_ws(" ", "title", "description", F.array_join("keywords", " "))).alias("haystack"),
        F.array_join("authors", ", ").alias("author_text"),
    )
    hits = (
        keyword_filter(shapes, rows.where(~by_token & ~by_author))
        .unionByName(keyword_filter(shapes, rows.where(by_author), with_author=True))
        .unionByName(token_and_filter(shapes, index))
    )
    asked = hits.join(shapes, "query_id").where(
        F.col("publisher_id").isNull() | (F.col("publisher_id") == F.col("source_id"))
    )
    own = F.create_map(*[F.lit(x) for kv in SOURCE_LIMITS.items() for x in kv])
    cap = F.coalesce(F.try_element_at(own, F.col("source_id")), F.lit(most))
    w = Window.partitionBy("query_id", "source_id").orderBy("position")
    # Numbered once the sources have cut, which is how far a smaller limit of a query goes.
    cut = asked.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most).where(F.col("nth") <= F.least("limit", cap))
    pairs = cut.join(rows.drop("title", "description", "authors", "keywords"), ["source_id", "position"]).select(
        "*",
        match_key(F.col("title")).alias("query_key"),
        token_keys(F.col("title")).alias("query_tokens"),
        match_key(F.col("author")).alias("query_author_key"),
    )
    score = scoring.mean_score(
        scoring.title_match_score(F.col("query_key"), F.col("query_tokens"), F.col("title_key")),
        scoring.author_match_score(F.col("query_author_key"), F.col("author_keys")),
        F.col("title").isNotNull(),
        F.col("author").isNotNull(),
    )
    scored = relevance_filter(pairs.withColumn("match_score", scoring.round3(score)), F.lit(True))
    best = scored.select(F.col("query_id").alias("form_id"), "source_id", "position", "match_score", F.col("nth").alias("rank"))
    return _given(forms, numbered, best, registry)


def search(
    queries: DataFrame, catalog: DataFrame, bib: DataFrame, registry: DataFrame, limit_scope: str = "score", columns: list[str] | None = None
) -> DataFrame:
    """(query_id, rank, match_score, book columns) for `queries(query_id, title, author, publisher_id, limit)`.

    `limit_scope="score"` keeps the best `limit` rows per query and source;
    `limit_scope="source_order"` keeps the first `limit` rows a source's own filter finds, in its
    own order, and scores them afterwards.

    `columns`: the only book columns wanted besides source and position. Where scores decide, a few of them
    are laid beside the answers of queries that ask for the same, so that no answer is shuffled.
    """
    books = prepare_catalog(catalog, bib, registry)
    wanted = tuple(dict.fromkeys(c for c in columns or () if c not in ("source_id", "position")))
    if limit_scope == "score" and wanted:
        return ranked_hits(queries, books, registry, wanted)
    if limit_scope == "score":
        hits = ranked_hits(queries, books, registry)
    elif limit_scope == "source_order":
        hits = source_order_hits(queries, books, registry)
    else:
        raise ValueError(f"unknown limit_scope: {limit_scope}")
    kept = books.drop("title_key", "author_keys") if columns is None else books.select("source_id", "position", *wanted)
    return hits.join(kept, ["source_id", "position"])
