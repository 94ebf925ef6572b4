"""Operators against brute force, and their invariants."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfmark.functions import scoring, text
from shelfmark.operators import joins, ranking
from shelfmark.operators.enrich import enrich
from shelfmark.operators import keyword_join, score_join as joined
from shelfmark.operators.score_join import contained_pairs, score_join
from shelfmark.operators import top_matches as top
from shelfmark.operators.top_matches import top_matches
from shelfmark.plans import search
from shelfmark.plans.search import ranked_hits
from shelfmark.schemas import as_books
from shelfmark.sources.registry import isbn_codes, sources


def test_contained_pairs_is_lossless(spark):
    rnd = random.Random(7)
    word = lambda n: "".join(rnd.choice("abc😀") for _ in range(n))
    needles = sorted({word(rnd.randint(1, 5)) for _ in range(60)})
    hay = sorted({word(rnd.randint(1, 12)) for _ in range(60)})
    got = contained_pairs(
        spark.createDataFrame([(x,) for x in needles], "needle string"), spark.createDataFrame([(x,) for x in hay], "haystack string")
    ).collect()
    assert sorted(map(tuple, got)) == sorted((n, h) for n in needles for h in hay if n in h)


def test_one_gram_in_most_titles_and_needles_is_dealt_to_bounded_cells(spark):
    """90 % of 400 titles and of 300 needles share their rarest n-gram; nothing is lost, no cell is crowded."""
    hay = [f"{i:03d}xyz{i % 7}" if i % 10 else f"{i:03d}other" for i in range(400)]
    need = [f"xyz{i % 7}" if i < 7 else f"{i:03d}xyz" if i % 10 else f"{i:03d}oth" for i in range(300)]
    needles = spark.createDataFrame([(x,) for x in sorted(set(need))], "needle string")
    titles = spark.createDataFrame([(x,) for x in hay], "haystack string")
    rarest = needles.select("needle", F.lit("xyz").alias("gram"), F.lit(360).cast("long").alias("df")).where("needle like '%xyz%'")
    spread, dealt = joined.cells(rarest, titles, split=50, needles=20)
    sides = spread.groupBy("gram", "row", "col").count().join(dealt.groupBy("gram", "row", "col").agg(F.count("*").alias("h")), ["gram", "row", "col"])
    assert sides.agg(F.max(F.col("count") * F.col("h"))).first()[0] <= 4 * 50 * 20
    assert sides.count() > 50
    got = joined.pairs_under(rarest, titles, 50, 20).collect()
    asked = [r.needle for r in rarest.collect()]
    assert sorted(map(tuple, got)) == sorted((n, h) for n in asked for h in hay if n in h)


def test_all_tokens_are_looked_up_under_the_rarest_of_them(spark):
    """A row is a candidate only under the rarest n-gram of all tokens, not under each token by itself."""
    hay = [f"common {i % 5} word{i:03d}" for i in range(200)]
    needles = spark.createDataFrame([("common word007", ["common", "word007"]), ("common 9", ["common", "9"])], "needle string, parts array<string>")
    titles = spark.createDataFrame([(h,) for h in hay], "haystack string")
    assert {(r.needle, r.df < 50) for r in joined.rarest_grams(needles, titles).collect()} == {("common word007", True), ("common 9", True)}
    got = contained_pairs(needles, titles).collect()
    assert sorted(map(tuple, got)) == sorted((n, h) for n, p in (("common word007", ["common", "word007"]), ("common 9", ["common", "9"])) for h in hay if all(x in h for x in p))


def test_keyword_filters_in_small_cells(spark, monkeypatch):
    """Texts of many rows and queries are dealt to cells; every answer comes once."""
    monkeypatch.setattr(keyword_join, "ROWS", 3)
    monkeypatch.setattr(keyword_join, "QUERIES", 2)
    rnd = random.Random(11)
    titles, names = ["red ring small", "red bolt", "old ring", "Red Ring"], [["Ann Lee"], ["Bob"], [], None]
    books = [("gihyo", i, rnd.choice(titles), rnd.choice(names)) for i in range(60)]
    asks = [(i, rnd.choice(["red ring", " RED ", "ring", "ring red", None, "zzz"]), rnd.choice([None, "lee", "Bob"])) for i in range(50)]
    b = spark.createDataFrame(books, "source_id string, position bigint, title string, authors array<string>")
    q = spark.createDataFrame(asks, "query_id bigint, title string, author string")
    writes = lambda a, n: a is None or (n is not None and a.lower() in " ".join(n).lower())
    got = keyword_join.keyword_filter(q, b, with_author=True).collect()
    assert sorted(map(tuple, got)) == sorted((i, s, p) for i, t, a in asks for s, p, x, n in books if t and t.strip().lower() in x.lower() and writes(a, n))
    index = b.select("source_id", "position", F.lower("title").alias("haystack"), F.array_join("authors", " ").alias("author_text"))
    got = keyword_join.token_and_filter(q, index).collect()
    has = lambda t, x: t is None or all(w in x.lower() for w in t.lower().split())
    assert sorted(map(tuple, got)) == sorted((i, s, p) for i, t, a in asks for s, p, x, n in books if (t or a) and has(t, x) and writes(a, n))


def one_title(spark, books, asks):
    """Books of one title, and queries of it, each third with an author."""
    b = spark.range(books).select(F.lit("gihyo").alias("source_id"), F.col("id").alias("position"), F.lit("red ring").alias("title"), F.array(F.lit("Ann")).alias("authors"))
    q = spark.range(asks).select(F.col("id").alias("query_id"), F.lit("red ring").alias("title"), F.when(F.col("id") % 3 == 0, "ann").alias("author"))
    return q, b


def test_keyword_filter_copies_few_rows(spark, monkeypatch):
    """Where a title has many queries and rows, a row is not copied for every few queries."""
    monkeypatch.setattr(keyword_join, "ROWS", 10)
    monkeypatch.setattr(keyword_join, "QUERIES", 10)
    shapes, real = [], keyword_join.materialize
    monkeypatch.setattr(keyword_join, "materialize", lambda df: (lambda kept: (shapes.extend(kept.collect()) if "cols" in kept.columns else None, kept)[1])(real(df)))
    q, b = one_title(spark, 60, 400)
    found = keyword_join.keyword_filter(q, b, with_author=True)
    assert found.count() == found.distinct().count() == 60 * 400
    assert len(shapes) == 1 and shapes[0].cols * shapes[0].lines >= 400 * 60 / 100 and shapes[0].lines < 400 / 10 / 2


def test_token_and_filter_deals_rows_once_and_no_answers(spark):
    """Queries with and without author meet rows in one join; queries without id and repeated ones keep their answers."""
    q, b = one_title(spark, 30, 20)
    q = q.withColumn("query_id", F.when(F.col("query_id") > 2, F.floor(F.col("query_id") / 2))).where("title is not null")
    index = b.select("source_id", "position", F.col("title").alias("haystack"), F.array_join("authors", " ").alias("author_text"))
    found = keyword_join.token_and_filter(q, index)
    want = sorted(((r.query_id, k) for r in q.collect() for k in range(30)), key=str)
    assert sorted(((r.query_id, r.position) for r in found.collect()), key=str) == want
    assert found._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 2


def small_catalog(spark, seed=3, n=150):
    rnd = random.Random(seed)
    words = ["net", "network", "tcp", "ip", "data", "base", "a", "入門", "実践"]
    names = ["Ann Lee", "Lee", "山田 太郎", "山田", "Bob"]
    ids = ["gihyo", "oreilly-japan", "saiensu", "pragprog"]
    books = [
        (rnd.choice(ids), i, " ".join(rnd.sample(words, rnd.randint(1, 4))), rnd.sample(names, rnd.randint(0, 2))) for i in range(n)
    ]
    queries = [
        (
            " ".join(rnd.choices(words + ["zzz"], k=rnd.randint(1, 4))) if rnd.random() < 0.8 else None,
            rnd.choice(names + ["Carl"]) if rnd.random() < 0.5 else None,
            rnd.choice([None, None, "gihyo"]),
        )
        for _ in range(60)
    ]
    queries = sorted({q for q in queries if q[0] or q[1]}, key=str)
    b = spark.createDataFrame(books, "source_id string, position bigint, title string, authors array<string>")
    b = b.select("source_id", "position", text.match_key(F.col("title")).alias("title_key"), text.match_keys(F.col("authors")).alias("author_keys"))
    q = spark.createDataFrame(queries, "query_title string, query_author string, publisher_id string")
    return q, b


def brute_force(q, b):
    keyed = q.select(
        "*", text.match_key(F.col("query_title")).alias("qk"), text.token_keys(F.col("query_title")).alias("toks"),
        text.match_key(F.col("query_author")).alias("ak"),
    )
    pairs = keyed.crossJoin(b).where("publisher_id is null or publisher_id = source_id")
    score = scoring.mean_score(
        scoring.title_match_score(F.col("qk"), F.col("toks"), F.col("title_key")),
        scoring.author_match_score(F.col("ak"), F.col("author_keys")),
        F.col("query_title").isNotNull(), F.col("query_author").isNotNull(),
    )
    return pairs.withColumn("match_score", scoring.round3(score)).where("match_score > 0").select(
        "query_title", "query_author", "publisher_id", "source_id", "position", "match_score")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_score_join_equals_brute_force(spark):
    q, b = small_catalog(spark)
    assert rows(score_join(q, b)) == rows(brute_force(q, b))


def test_top_matches_equals_brute_force(spark):
    reg = sources(spark)
    for seed in (3, 11):
        q, b = small_catalog(spark, seed)
        for k in (1, 3):
            all_pairs = brute_force(q, b).join(reg.select("source_id", "scale", "ordinal"), "source_id")
            form = F.concat_ws("|", *[F.coalesce(c, F.lit("~")) for c in ("query_title", "query_author", "publisher_id")])
            want = ranking.rank_by_score(all_pairs.withColumn("form", form), "form").where(F.col("rank") <= k)
            cols = ["query_title", "query_author", "publisher_id", "source_id", "position", "match_score", "rank"]
            assert rows(top_matches(q, b, reg, k).select(*cols)) == rows(want.select(*cols))


def test_best_hits_of_every_source_equal_brute_force(spark, monkeypatch):
    """Also with rounded scores that merge, which queries of over LONG tokens have."""
    reg = sources(spark)
    for seed, long in ((5, 400), (6, 2)):
        monkeypatch.setattr(top, "LONG", long)
        q, b = small_catalog(spark, seed)
        q = q.withColumn("limit", F.pmod(F.xxhash64(*q.columns), F.lit(4)).cast("int"))
        w = Window.partitionBy("query_title", "query_author", "publisher_id", "source_id").orderBy(F.col("match_score").desc(), "position")
        want = brute_force(q.drop("limit"), b).withColumn("rank", F.row_number().over(w))
        same = [F.col(f"w.{c}").eqNullSafe(F.col(f"q.{c}")) for c in ("query_title", "query_author", "publisher_id")]
        want = want.alias("w").join(q.alias("q"), same).where("rank <= limit").select("w.*")
        assert rows(top.best_hits(q, b, reg, per_source=True).select(*want.columns)) == rows(want)


def test_rank_is_the_same_after_repartition(spark):
    df = spark.range(500).select(
        (F.col("id") % 7).alias("q"), (F.col("id") % 3 / 3).alias("match_score"), F.lit(None).cast("string").alias("scale"),
        (F.col("id") % 5).alias("ordinal"), F.col("id").alias("position"))
    a = ranking.rank_by_score(df, "q").select("q", "position", "rank")
    b = ranking.rank_by_score(df.repartition(13, "position"), "q").select("q", "position", "rank")
    assert rows(a) == rows(b)


def test_top_per_group_plan_limits_before_the_shuffle(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 3)
    plan = ranking.top_per_group(df, ["g"], [F.col("id")], F.lit(5), cap=5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_limits_over_the_usual_bound_are_kept(spark):
    q, b = small_catalog(spark)
    books = spark.range(120).select(
        F.lit("saiensu").alias("source_id"), F.col("id").alias("position"), F.lit("same book").alias("title"),
        F.array(F.lit("one author")).alias("authors"), F.lit("samebook").alias("title_key"), F.array(F.lit("oneauthor")).alias("author_keys"),
    )
    asked = spark.createDataFrame([(1, "same book", None, None, 60), (2, "same book", None, None, None)], "query_id long, title string, author string, publisher_id string, limit int")
    hits = ranked_hits(asked, books, sources(spark))
    assert {r.query_id: r["count"] for r in hits.groupBy("query_id").count().collect()} == {1: 60, 2: 10}


def test_answers_are_ranked_where_a_query_meets_its_list(spark, monkeypatch):
    """Answers are neither sorted nor dealt out by query; rows beyond the bound give the same."""
    names = [s.source_id for s in sources(spark).select("source_id").limit(5).collect()]
    books = spark.createDataFrame(
        [(names[i % 5], i, f"red{'blue' if i % 3 else 'pink'}{i % 4}", [f"author{i % 2}"]) for i in range(60)],
        "source_id string, position long, title_key string, author_keys array<string>")
    asked = spark.createDataFrame(
        [(1, "red blue", None, None, 3), (2, "red blue", None, None, 1), (3, "blue 2", "author 1", None, 4), (4, None, "author 0", names[0], None), (5, "red", None, None, 0), (6, None, None, None, 5)],
        "query_id long, title string, author string, publisher_id string, limit int")
    hits = ranked_hits(asked, books, sources(spark))
    assert "windowspecdefinition(query_id" not in hits._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(search, "LISTED", 0)
    by_rows = ranked_hits(asked, books, sources(spark))
    assert rows(hits) == rows(by_rows) and hits.count() > 20


def test_source_order_looks_up_once_what_queries_share(spark, monkeypatch):
    """Filters get one row for queries that ask for the same; each query's own limit cuts before the scores."""
    books = spark.range(90).select(
        F.when(F.col("id") < 60, "google-books").otherwise("saiensu").alias("source_id"), F.col("id").alias("position"),
        F.concat(F.lit("Red "), F.col("id").cast("string")).alias("title"), F.array(F.lit("One")).alias("authors"),
        F.concat(F.lit("red"), F.col("id").cast("string")).alias("title_key"), F.array(F.lit("one")).alias("author_keys"), F.lit(None).cast("string").alias("description"))
    limits = [3, 50, None, 0, 45]
    asked = spark.createDataFrame([(i, "red", None, None, limits[i % 5]) for i in range(40)], "query_id long, title string, author string, publisher_id string, limit int")
    seen, real = [], search.keyword_filter
    monkeypatch.setattr(search, "keyword_filter", lambda queries, *a, **k: seen.append(queries.count()) or real(queries, *a, **k))
    hits = search.source_order_hits(asked, books, sources(spark)).collect()
    assert seen == [1, 1]
    for i in range(40):
        n = [3, 50, 10, 0, 45][i % 5]
        mine = sorted((r.rank, r.source_id, r.position) for r in hits if r.query_id == i)
        want = {("google-books", k) for k in range(min(n, 40))} | {("saiensu", 60 + k) for k in range(min(n, 30))}
        assert {m[1:] for m in mine} == want and [m[0] for m in mine] == list(range(1, len(want) + 1))


def test_search_lays_wanted_columns_beside_the_answers_of_a_form(spark):
    """Book columns are joined to what queries share, not to each answer; repeated rows and unknown books keep the ranks."""
    rows = [("saiensu", i, f"Red {i % 3}", f"n{i}", [["One"], []][i % 2]) for i in range(12)] + [("saiensu", 3, "Red 0", "again", [])]
    books = spark.createDataFrame(rows, "source_id string, position long, title string, isbn string, authors array<string>")
    books = books.withColumn("title_key", text.match_key(F.col("title"))).withColumn("author_keys", text.match_keys(F.col("authors")))
    asked = spark.createDataFrame([(i, ["red 0", "red 1"][i % 2], [None, "One"][i // 2 % 2], None, [2, 9, None][i % 3]) for i in range(24)], "query_id long, title string, author string, publisher_id string, limit int")
    plain = search.ranked_hits(asked, books, sources(spark))
    joined_ = plain.join(books.select("source_id", "position", "title", "isbn"), ["source_id", "position"])
    got = search.ranked_hits(asked, books, sources(spark), ("title", "isbn"))
    cols = ["query_id", "rank", "source_id", "position", "match_score", "title", "isbn"]
    assert got.columns == cols and got.count() > 100
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, joined_.select(*cols).collect()))
    # The join with queries is the last one: above it nothing is joined or grouped.
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("posexplode") < plan.index("Join")


def test_score_join_has_no_nested_loop(spark):
    q, b = small_catalog(spark)
    plan = score_join(q, b)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_enrich_fills_and_never_overwrites(spark):
    books = as_books(
        spark.createDataFrame(
            [("s", 1, "t1", [], "1", None, None), ("s", 2, "t2", ["X"], "1", 5.0, "own"), ("s", 3, "t3", ["X"], None, None, None)],
            "source_id string, position bigint, title string, authors array<string>, isbn string, price double, description string",
        )
    )
    bib = as_books(
        spark.createDataFrame([("1", "B", ["Y"], 9.0, "bib")], "isbn string, title string, authors array<string>, price double, description string")
    )
    got = {r.position: (r.title, r.authors, r.price and float(r.price), r.description) for r in enrich(books, bib).collect()}
    assert got == {1: ("t1", ["Y"], 9.0, "bib"), 2: ("t2", ["X"], 5.0, "own"), 3: ("t3", ["X"], None, None)}


ROBOTS = """# comment
User-agent: *
Disallow: /a
Allow: /a/b
# still the same section
Disallow: /c?x

User-agent: first
User-agent: Second
Disallow: /only
Disallow:

Disallow: /nobody
"""


def allowed(spark, content, agent, paths):
    files = spark.createDataFrame([("https://s.example", content)], "origin string, content string")
    urls = spark.createDataFrame([(i, f"https://s.example{p}") for i, p in enumerate(paths)], "i int, url string")
    out = joins.robots_join(urls, joins.robots_rules(files, agent)).orderBy("i").collect()
    return [r.allowed for r in out]


def test_robots(spark):
    assert allowed(spark, ROBOTS, "bot", ["/", "/a", "/a/b/c", "/c", "/c?x=1", "/only", "/nobody"]) == [True, False, True, True, False, True, True]
    assert allowed(spark, ROBOTS, "second", ["/a", "/only", "/nobody"]) == [True, False, True]
    assert allowed(spark, "", "bot", ["/a"]) == [True]
    assert allowed(spark, "User-agent: *\r\nAllow: /x\r\nDisallow: /x", "bot", ["/x"]) == [True]


def test_robots_of_an_origin_with_most_urls(spark):
    """90 % of the URLs have one origin; its rules are copied to the parts its URLs are dealt to."""
    files = spark.createDataFrame([("https://hot.example", "User-agent: *\nDisallow: /a"), ("https://s.example", ROBOTS)], "origin string, content string")
    urls = [(i, f"https://hot.example/{'ab'[i % 2]}") for i in range(270)] + [(i, f"https://s.example/a{i}") for i in range(270, 290)]
    urls += [(i, None if i % 2 else "nonsense") for i in range(290, 300)]
    df = spark.createDataFrame(urls, "i int, url string")
    rules = joins.robots_rules(files, "bot")
    got = {r.i: r.allowed for r in joins.robots_join(df, rules, split=20).collect()}
    assert got == {i: not (u or "").startswith(("https://hot.example/a", "https://s.example/a")) for i, u in urls}
    assert got == {r.i: r.allowed for r in joins.robots_join(df, rules).collect()}


def test_isbn_codes(spark):
    isbns = spark.createDataFrame([("9784297128152",), ("9784873117782",), ("9784000000000",), ("9780000000000",)], "isbn string")
    got = {r.isbn: r.source_id for r in joins.isbn_source_join(isbns, isbn_codes(spark)).collect()}
    assert got == {"9784297128152": "gihyo", "9784873117782": "oreilly-japan", "9784000000000": None, "9780000000000": None}


def test_registry_is_unique(spark):
    reg = sources(spark).collect()
    assert len(reg) == 24 and len({r.source_id for r in reg}) == 24 and len({r.base_url for r in reg}) == 24


def test_score_join_meets_titles_in_small_cells_and_scores_each_pair_once(spark, monkeypatch):
    """Pairs share up to three tokens, one of them in nearly all titles; books of a title come in several rows."""
    for name, n in (("TEXTS", 3), ("TITLES", 2), ("CHUNK", 2)):
        monkeypatch.setattr(joined, name, n)
    books = [(["gihyo", "pragprog"][i % 2], i, f"vol {i % 9} net" if i % 10 else "other") for i in range(60)]
    b = spark.createDataFrame(books, "source_id string, position bigint, title_key string").withColumn("author_keys", F.array().cast("array<string>"))
    q = spark.createDataFrame(
        [(f"vol {i} net net", None, [None, "gihyo", "", "nobody"][i % 4]) for i in range(12)] + [("vol 1 net", None, None), ("zzz", None, None)],
        "query_title string, query_author string, publisher_id string",
    )
    assert rows(score_join(q, b)) == rows(brute_force(q, b))
