"""The few best books per query, without scoring every pair that shares a common word.

A title score counts the query's tokens in a title. The books that hold both of a query's two rarest
tokens are scored first; the `k`-th best of them is a bound for every group (a source, or all books).
A book that holds at most one of a query's first tokens can match that one and the later ones, so
pairs of tokens are followed, rarest first, only as far as this reaches the bound: an equi-join on
both tokens. A book that holds one single token cannot go before the first books, in the order that
breaks ties, which hold it: `k` of them are kept for every token and group once, for all queries, and
looked at only where one token alone reaches the bound. Books of a matching author are found in the
same way: all that hold a token of the query, and the first `k` of the author. Ties are kept, so the
result is exactly that of scoring all pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.text import match_key, token_keys
from ..storage import materialize
from .score_join import author_scores, contained_pairs

FORM = ["query_title", "query_author", "publisher_id"]
#: With more tokens, rounded scores of different numbers of tokens may be equal: such queries are
#: scored against every title that holds one of them.
LONG = 400
EVERY = "*"


def _lists(shelf: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    """The first `k` rows of each group, and their number in it."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return shelf.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= k)


def best_hits(queries: DataFrame, books: DataFrame, registry: DataFrame, per_source: bool) -> DataFrame:
    """(query columns, source_id, position, match_score, rank): the best books per query, see `form_hits`."""
    hits, forms = form_hits(queries, books, registry, per_source)
    return hits.join(forms, "form_id").select(*FORM, "source_id", "position", "match_score", "rank")


def form_hits(queries: DataFrame, books: DataFrame, registry: DataFrame, per_source: bool) -> tuple[DataFrame, DataFrame]:
    """(form_id, source_id, position, match_score, rank): the best books per query; and the queries by form_id.

    `queries(query_title, query_author, publisher_id, limit)` must be distinct but for the limit;
    `books(source_id, position, title_key, author_keys)`. With `per_source` the best `limit` books of
    every source, ranked within it by score and position, else the best `limit` of all sources, ranked
    as in `ranking.score_order`. Books with a score of 0 are no hits; a query without parts has none.
    """
    small = registry.select("source_id", (F.coalesce(F.col("scale"), F.lit("")) == "minor").alias("minor"), "ordinal")
    forms = materialize(
        queries.where("limit > 0").select(
            F.monotonically_increasing_id().alias("form_id"),
            *FORM,
            F.col("limit").cast("int").alias("k"),
            match_key(F.col("query_title")).alias("query_key"),
            token_keys(F.col("query_title")).alias("tokens"),
        )
    )
    most = forms.agg(F.max("k")).first()[0] or 1
    order = ["position"] if per_source else ["minor", "ordinal", "position"]
    placed = books.join(F.broadcast(small), "source_id").select("source_id", *order, "title_key", "author_keys")
    by_grp = _grouped(placed, forms, per_source)
    book = ["source_id", *order]

    # Queries with equal titles share everything but the author.
    texts = forms.where("query_key != ''").groupBy("query_title").agg(
        F.min("form_id").alias("text_id"), F.first("query_key").alias("query_key"), F.first("tokens").alias("tokens")
    )
    tokens = materialize(
        texts.select("query_title", "text_id", "query_key", F.size("tokens").alias("total"), F.explode("tokens").alias("needle"))
        .groupBy("query_title", "text_id", "query_key", "total", "needle")
        .agg(F.count("*").cast("int").alias("times"))
    )
    titles = placed.where("title_key != ''").select(F.col("title_key").alias("haystack")).distinct()
    postings = materialize(contained_pairs(tokens.select("needle").distinct(), titles).withColumnRenamed("haystack", "title_key"))

    units, parts = _units(forms, tokens, placed, per_source)
    groups = [r.source_id for r in registry.select("source_id").collect()]
    plain = _by_title(units.where("author_key = ''"), tokens, postings, by_grp, order, most, groups)
    named = _by_author(units.where("author_key != ''"), tokens, postings, by_grp, order, most)
    if per_source:
        # Lists of every source are many rows: each part is written, so that its shuffles can go before the next.
        plain, named = materialize(plain), materialize(named)
    found = plain.unionByName(named)

    mean = scoring.mean_score(F.col("title_score"), F.col("author_score"), F.col("has_title"), F.col("has_author"))
    scored = parts.join(found, "unit_id").where("nth <= k").withColumn("match_score", scoring.round3(mean)).where("match_score > 0")
    # A query without author has one list, in order already; others merge several.
    single = scored.where("not has_author").withColumn("rank", F.col("nth"))
    several = scored.where("has_author").groupBy("form_id", "grp", *book, "k").agg(F.max("match_score").alias("match_score"))
    w = Window.partitionBy("form_id", "grp").orderBy(F.col("match_score").desc(), *order)
    several = several.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).where("rank <= k")
    cols = ["form_id", "source_id", "position", "match_score", "rank"]
    return single.select(*cols).unionByName(several.select(*cols)), forms.select("form_id", *FORM)


def top_matches(queries: DataFrame, books: DataFrame, registry: DataFrame, k: int) -> DataFrame:
    """(query columns, source_id, position, match_score, rank): the best `k` books per query of all sources."""
    return best_hits(queries.withColumn("limit", F.lit(k)), books, registry, per_source=False)


def _grouped(placed: DataFrame, forms: DataFrame, per_source: bool) -> DataFrame:
    """Books with the group they compete in: their source, or all books; sources that a query names as well."""
    own = placed.withColumn("grp", F.col("source_id"))
    if per_source:
        return own
    asked = forms.where("publisher_id is not null").select(F.col("publisher_id").alias("grp")).distinct()
    return placed.withColumn("grp", F.lit(EVERY)).unionByName(own.join(asked, "grp", "left_semi").select(*placed.columns, "grp"))


def _units(forms: DataFrame, tokens: DataFrame, placed: DataFrame, per_source: bool) -> tuple[DataFrame, DataFrame]:
    """Lists that queries are made of, each needed once, and which of them a query takes.

    A unit is a query title (or none), a group, and an author of books (or none).
    """
    ids = tokens.select("query_title", "text_id").distinct()
    scope = F.coalesce("publisher_id", F.lit("" if per_source else EVERY)).alias("scope")
    flags = [F.col("query_title").isNotNull().alias("has_title"), F.col("query_author").isNotNull().alias("has_author")]
    known = forms.join(ids, "query_title", "left").select("form_id", "query_author", scope, "k", F.coalesce("text_id", F.lit(-1)).alias("text_id"), *flags)
    plain = known.where("text_id >= 0").withColumn("author_key", F.lit("")).withColumn("author_score", F.lit(0.0))
    names = placed.select(F.explode("author_keys").alias("author_key")).where("author_key != ''").distinct()
    matches = author_scores(known.where("has_author").select("query_author").distinct(), names)
    named = known.where("has_author").join(matches, "query_author")
    taken = materialize(plain.unionByName(named.select(*plain.columns)).drop("query_author"))
    keys = ["text_id", "scope", "author_key"]
    units = materialize(taken.groupBy(*keys).agg(F.max("k").alias("most")).withColumn("unit_id", F.monotonically_increasing_id()))
    return units, taken.join(units.drop("most"), keys).drop(*keys)


def _title_score() -> Column:
    return F.when(F.col("query_key") == F.col("title_key"), F.lit(1.0)).otherwise(scoring.token_score(F.col("matched"), F.col("total")))


def _scope_of(frame: DataFrame) -> DataFrame:
    """Rows of the group that the unit asks for: a named source, all books, or every source by itself."""
    return frame.where((F.col("scope") == "") | (F.col("scope") == F.col("grp")))


def _ordered(tokens: DataFrame, postings: DataFrame) -> DataFrame:
    """Tokens of each text, rarest first, with what a text can still match.

    `reach`: most tokens of a title that holds at most one token before this one; `single`: of a title
    that holds only one token.
    """
    rarity = postings.groupBy("needle").agg(F.count("*").alias("df"))
    w = Window.partitionBy("text_id").orderBy("df", "needle")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    after = w.rowsBetween(0, Window.unboundedFollowing)
    return tokens.join(rarity, "needle").select(
        "*",
        F.row_number().over(w).alias("nth"),
        (F.coalesce(F.max("times").over(before), F.lit(0)) + F.sum("times").over(after)).alias("reach"),
        F.max("times").over(Window.partitionBy("text_id")).alias("single"),
    )


def _by_title(units: DataFrame, tokens: DataFrame, postings: DataFrame, shelf: DataFrame, order: list[str], most: int, groups: list[str]) -> DataFrame:
    """(unit_id, grp, book, title_score, nth) of books by their titles alone."""
    book = ["source_id", *order]
    ordered = materialize(_ordered(tokens, postings))
    short = ordered.where(F.col("total") <= LONG)
    # Pairs of tokens that some query has, and the titles that hold both.
    a = short.select("text_id", F.col("needle").alias("x"), F.col("nth").alias("first"))
    b = short.select("text_id", F.col("needle").alias("y"), "nth", "reach", "total")
    pairs = a.join(b, "text_id").where("first < nth").select("text_id", "nth", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "reach", "total")
    both = (
        postings.select("title_key", F.col("needle").alias("x"))
        .join(postings.select("title_key", F.col("needle").alias("y")), "title_key")
        .where("x < y")
        .join(pairs.select("x", "y").distinct(), ["x", "y"])
    )
    # Books of one title and group score equally: the first of them are enough.
    firsts = materialize(_lists(shelf.where("title_key != ''"), ["title_key", "grp"], order, most).drop("nth", "author_keys"))
    held = materialize(both.join(firsts, "title_key"))
    every = F.when(F.col("scope") == "", F.array(*[F.lit(g) for g in groups])).otherwise(F.array("scope"))
    asked = units.select("unit_id", "text_id", "most", F.explode(every).alias("grp"))
    texts = tokens.select("text_id", "query_key", "total").distinct()
    words = tokens.groupBy("text_id").agg(F.collect_list(F.struct("needle", "times")).alias("words"))

    def scored(found: DataFrame) -> DataFrame:
        """Books (unit_id, text_id, grp, book, title_key, most) with their whole title score, each once."""
        once = found.groupBy("unit_id", "grp", *book).agg(*[F.first(c).alias(c) for c in ("text_id", "title_key", "most")])
        inside = F.filter("words", lambda w: F.contains(F.col("title_key"), w["needle"]))
        matched = F.aggregate(inside, F.lit(0), lambda n, w: n + w["times"])
        full = once.join(words, "text_id").join(texts, "text_id").withColumn("matched", matched)
        return full.select("unit_id", "grp", *book, _title_score().alias("title_score"), "most")

    cols = ["unit_id", "text_id", "grp", *book, "title_key", "most"]
    equal = asked.join(texts, "text_id").join(firsts, (F.col("query_key") == F.col("title_key")) & (asked["grp"] == firsts["grp"]))
    equal = equal.drop(firsts["grp"]).select(*cols)
    lead = asked.join(pairs.where("nth = 2"), "text_id").join(held, ["x", "y", "grp"]).select(*cols)
    w = Window.partitionBy("unit_id", "grp").orderBy(F.col("title_score").desc(), *order)

    def best(found: DataFrame) -> DataFrame:
        dealt = found.repartition("unit_id", "grp").groupBy("unit_id", "grp", *book).agg(F.max("title_score").alias("title_score"), F.first("most").alias("most"))
        return dealt.withColumn("nth", F.row_number().over(w)).where("nth <= most")

    first = materialize(best(scored(lead.unionByName(equal))))
    bounds = first.where("nth = most").select("unit_id", "grp", F.col("title_score").alias("bound"))
    open_ = asked.join(bounds, ["unit_id", "grp"], "left").withColumn("bound", F.coalesce("bound", F.lit(0.0)))
    reached = scoring.token_score(F.col("reach"), F.col("total")) >= F.col("bound")
    more = open_.join(pairs.where("nth > 2"), "text_id").where(reached).select("unit_id", "text_id", "grp", "most", "x", "y")
    more = more.join(held, ["x", "y", "grp"]).select(*cols)
    lists = _lists(postings.join(firsts, "title_key"), ["needle", "grp"], order, most).withColumnRenamed("nth", "place")
    alone = open_.join(short, "text_id").where(scoring.token_score(F.col("single"), F.col("total")) >= F.col("bound"))
    alone = alone.join(lists, ["needle", "grp"]).where("place <= most").withColumnRenamed("times", "matched")
    alone = alone.select("unit_id", "grp", *book, _title_score().alias("title_score"), "most")
    long = asked.join(ordered.where(F.col("total") > LONG), "text_id").join(postings, "needle").join(firsts, ["title_key", "grp"]).select(*cols)
    rest = scored(more.unionByName(long)).unionByName(alone)
    return best(first.drop("nth").unionByName(rest)).drop("most")


def _by_author(units: DataFrame, tokens: DataFrame, postings: DataFrame, shelf: DataFrame, order: list[str], most: int) -> DataFrame:
    """(unit_id, grp, book, title_score, nth) of books of one author."""
    book = ["source_id", *order]
    asked_names = units.select("author_key").distinct()
    named = shelf.withColumn("author_key", F.explode(F.array_distinct("author_keys"))).drop("author_keys").join(asked_names, "author_key", "left_semi")
    held = named.where("title_key != ''").join(postings, "title_key")
    texts = tokens.select("text_id", "query_key", "total", "needle", "times")
    with_title = _scope_of(units.join(texts, "text_id").join(held, ["author_key", "needle"]))
    matched = with_title.groupBy("unit_id", "grp", *book, "title_key", "query_key", "total", "most").agg(F.sum("times").cast("int").alias("matched"))
    matched = matched.select("unit_id", "grp", *book, _title_score().alias("title_score"), "most")
    # Books that hold no token score equally: the first of the author are enough.
    lists = _lists(named, ["author_key", "grp"], order, most).withColumnRenamed("nth", "place").drop("title_key")
    rest = _scope_of(units.join(lists, "author_key").where("place <= most")).select("unit_id", "grp", *book, F.lit(0.0).alias("title_score"), "most")
    merged = matched.unionByName(rest).repartition("unit_id", "grp")
    once = merged.groupBy("unit_id", "grp", *book).agg(F.max("title_score").alias("title_score"), F.first("most").alias("most"))
    w = Window.partitionBy("unit_id", "grp").orderBy(F.col("title_score").desc(), *order)
    return once.withColumn("nth", F.row_number().over(w)).where("nth <= most").drop("most")
