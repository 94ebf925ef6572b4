"""Book-shaped inputs derived from the given tables, spelled once for both engines.

`BOOK` turns every row of `part` into one book with the messy columns the library cleans.
`CLUES` turns every row of `customer` into one reference to resolve.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.text import IGNORED
from shelfmark.schemas import as_books
from shelfmark.sources.registry import ISBN_CODES, SOURCES, isbn_codes, sources

from shelfmark.storage import materialize

from .registry import table

_CODE = " ".join(f"WHEN {i} THEN '{c}'" for i, (_, c) in enumerate(ISBN_CODES))
_CODE_SOURCE = " ".join(f"WHEN {i} THEN '{s}'" for i, (s, _) in enumerate(ISBN_CODES))
_SOURCE = " ".join(f"WHEN {i} THEN '{s[0]}'" for i, s in enumerate(SOURCES))
_SUM = " + ".join(
    f"{3 if i % 2 else 1} * cast(substring(p12, {i + 1}, 1) as int)" for i in range(12)
)

BOOK = f"""
b0 AS (SELECT p_partkey AS k, p_name, p_type, p_brand, p_size, p_retailprice,
  CASE p_partkey % 15 {_CODE} END AS code,
  CASE p_partkey % 15 {_CODE_SOURCE} END AS code_source,
  CASE p_partkey % 24 {_SOURCE} END AS listed_source FROM part),
b1 AS (SELECT *, '9784' || code || lpad(cast(k % (CASE length(code) WHEN 3 THEN 100000 WHEN 4 THEN 10000
  WHEN 5 THEN 1000 ELSE 100 END) AS string), cast(8 - length(code) AS int), '0') AS p12 FROM b0),
b2 AS (SELECT *, p12 || cast((10 - ({_SUM}) % 10) % 10 AS string) AS isbn,
  split_part(p_name, ' ', 2) || ' ' || cast(k % 97 AS string) AS author1 FROM b1),
book AS (SELECT k, isbn, code, code_source, p_name, p_type, p_brand, p_size, p_retailprice, author1,
  CASE WHEN k % 2 = 0 THEN code_source ELSE listed_source END AS source_id,
  p_name || ' ' || lower(p_type) || (CASE WHEN k % 11 = 0 THEN '　Ｖｏｌ．' ELSE ' vol ' END)
    || cast(p_size AS string) || (CASE WHEN k % 7 = 0 THEN ' 第2版' WHEN k % 13 = 0 THEN ' 新版' ELSE '' END) AS title,
  CASE WHEN k % 5 = 4 THEN '' WHEN k % 10 = 3 THEN author1 || '|' || upper(author1)
    WHEN k % 3 = 1 THEN author1 || '|' || split_part(p_name, ' ', 1) || ' ' || cast(k % 53 AS string)
    ELSE author1 END AS authors_text,
  CASE WHEN k % 4 = 1 THEN NULL ELSE floor(p_retailprice) END AS price,
  CASE WHEN k % 3 = 2 THEN NULL ELSE '2020-01-' || lpad(cast(1 + k % 28 AS string), 2, '0') END AS published,
  'https://catalog.example.com/b/' || cast(k AS string) AS url,
  CASE WHEN k % 3 = 0 THEN 0 ELSE 1 END AS in_bib,
  CASE WHEN k % 4 = 0 THEN p_name || '  = ' || p_type || ' : volume ' || cast(p_size AS string)
    ELSE p_name || ' ' || lower(p_type) || ' vol ' || cast(p_size AS string) END AS bib_title,
  CASE k % 5 WHEN 0 THEN cast(1990 + k % 30 AS string) || lpad(cast(1 + k % 12 AS string), 2, '0') || lpad(cast(1 + k % 28 AS string), 2, '0')
    WHEN 1 THEN cast(1990 + k % 30 AS string) || lpad(cast(1 + k % 12 AS string), 2, '0')
    WHEN 2 THEN cast(1990 + k % 30 AS string) WHEN 3 THEN ''
    ELSE cast(1990 + k % 30 AS string) || '-' || lpad(cast(1 + k % 12 AS string), 2, '0') || '-' || lpad(cast(1 + k % 28 AS string), 2, '0') END AS bib_pubdate,
  author1 || '／著、' || p_brand || '　訳' AS bib_author,
  CASE WHEN k % 7 = 0 THEN NULL ELSE cast(p_retailprice AS string) || ' JPY' END AS bib_amount,
  CASE WHEN k % 8 = 0 THEN '' ELSE 'https://cover.example.com/' || isbn || '.jpg' END AS bib_cover,
  CASE WHEN k % 9 = 0 THEN '' ELSE 'long text ' || cast(k AS string) END AS bib_text03,
  CASE WHEN k % 10 = 0 THEN NULL ELSE 'short text ' || cast(k AS string) END AS bib_text02,
  CASE k % 6 WHEN 1 THEN 'https://gihyo.jp/book/' || cast(k AS string) WHEN 2 THEN 'https://shop.example.org/' || cast(k AS string)
    ELSE NULL END AS store_link
  FROM b2)"""

CLUES = """
clues AS (SELECT c.c_custkey AS clue_id,
  CASE c.c_custkey % 8 WHEN 0 THEN b.isbn WHEN 1 THEN substring(b.isbn, 1, 3) || '-' || substring(b.isbn, 4, 1) || '-' || substring(b.isbn, 5, 9)
    WHEN 2 THEN ' ' || b.isbn WHEN 3 THEN '9780000' || lpad(cast(c.c_custkey % 1000000 AS string), 6, '0')
    WHEN 7 THEN (CASE WHEN c.c_custkey % 3 = 0 THEN '12345' ELSE NULL END) ELSE NULL END AS isbn,
  CASE c.c_custkey % 8 WHEN 1 THEN b.title WHEN 2 THEN 'Unrelated Matter' WHEN 3 THEN b.p_type || ' ' || b.p_name
    WHEN 4 THEN b.title WHEN 5 THEN split_part(b.p_name, ' ', 2) || ' ' || c.c_mktsegment
    WHEN 7 THEN (CASE WHEN c.c_custkey % 3 = 1 THEN 'zzz yyy' ELSE NULL END) ELSE NULL END AS title,
  CASE c.c_custkey % 8 WHEN 5 THEN b.author1 WHEN 6 THEN split_part(b.p_name, ' ', 2) || ' ' || cast(c.c_custkey % 97 AS string)
    ELSE NULL END AS author,
  CASE WHEN c.c_custkey % 16 = 4 THEN b.source_id ELSE NULL END AS publisher_id
  FROM customer c JOIN book b ON b.k = c.c_custkey)"""


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt evenly over all cores: a table that came in one file is read, and written, by one task."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def stored(make):
    """Keep a derived input as a table, as a job would find it: written once per session and directory."""
    kept = {}

    def get(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in kept:
            kept[key] = materialize(spread(make(spark, sf_dir)), keep=True)
        return kept[key]

    get.__doc__ = make.__doc__
    return get


@stored
def book_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(f"WITH {BOOK} SELECT * FROM book".replace("FROM part", "FROM {part}"), part=spread(table(spark, sf_dir, "part")))


@stored
def clue_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = f"WITH {BOOK}, {CLUES} SELECT * FROM clues"
    text = text.replace("FROM part", "FROM {part}").replace("FROM customer", "FROM {customer}")
    return spark.sql(text, part=spread(table(spark, sf_dir, "part")), customer=table(spark, sf_dir, "customer"))


def _list(c):
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, "[|]"))


@stored
def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = book_rows(spark, sf_dir)
    return as_books(
        b.select(
            "source_id",
            F.col("k").alias("position"),
            "title",
            _list(F.col("authors_text")).alias("authors"),
            F.col("p_brand").alias("publisher"),
            F.col("published").cast("date").alias("published_at"),
            "isbn",
            "url",
            "price",
        )
    )


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bibliography responses: twenty ISBNs asked for at once, unknown ones answered with null."""
    b = book_rows(spark, sf_dir)
    person = lambda seq, role, name: F.struct(
        F.lit(seq).alias("SequenceNumber"),
        F.array(F.lit(""), F.lit(role)).alias("ContributorRole"),
        F.struct(name.alias("content")).alias("PersonName"),
    )
    people = F.when(
        F.col("k") % 6 == 4,
        F.array(
            person("2", "B06", F.concat(F.col("p_brand"), F.lit(", J, 1950-"))),
            person("10", "X99", F.lit(" ")),
            person("1", "A01", F.concat(F.lit("Ann   "), F.col("author1"))),
        ),
    )
    text = lambda kind, c: F.when(
        c.isNotNull(), F.struct(F.lit(kind).alias("TextType"), c.alias("Text"))
    )
    price = lambda kind, c: F.struct(F.lit(kind).alias("PriceType"), c.alias("PriceAmount"))
    entry = F.struct(
        F.struct(
            "isbn",
            F.col("bib_title").alias("title"),
            F.col("p_brand").alias("publisher"),
            F.col("bib_pubdate").alias("pubdate"),
            F.col("bib_cover").alias("cover"),
            F.col("bib_author").alias("author"),
        ).alias("summary"),
        F.struct("isbn", F.col("store_link").alias("storelink")).alias("hanmoto"),
        F.struct(
            F.struct(people.alias("Contributor")).alias("DescriptiveDetail"),
            F.struct(
                F.array_compact(
                    F.array(text("02", F.col("bib_text02")), text("03", F.col("bib_text03")))
                ).alias("TextContent")
            ).alias("CollateralDetail"),
            F.struct(
                F.struct(
                    F.array(
                        price("01", F.lit("1")),
                        price(F.when(F.col("bib_amount").isNull(), "02").otherwise("03"), F.col("bib_amount")),
                    ).alias("Price")
                ).alias("SupplyDetail")
            ).alias("ProductSupply"),
        ).alias("onix"),
    )
    rows = b.select(
        F.floor(F.col("k") / 20).alias("pos"),
        "k",
        "isbn",
        F.when(F.col("in_bib") == 1, F.to_json(entry)).otherwise("null").alias("body"),
    )
    grouped = rows.groupBy("pos").agg(F.array_sort(F.collect_list(F.struct("k", "isbn", "body"))).alias("r"))
    return grouped.select(
        "pos",
        F.col("r.isbn").alias("isbns"),
        F.concat(F.lit("["), F.array_join("r.body", ","), F.lit("]")).alias("body"),
    )


@stored
def page_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Book rows of the detail pages that were fetched: half of the store links and of the fixed addresses."""
    b = book_rows(spark, sf_dir)
    shop = b.where("k % 12 = 1").withColumn("url", F.col("store_link"))
    fixed = b.where("k % 30 = 6").withColumn(
        "url", F.concat(F.lit("https://www.oreilly.co.jp/books/"), "isbn", F.lit("/"))
    )
    rows = shop.unionByName(fixed).select(
        "url",
        F.concat(F.lit("Page "), "title").alias("title"),
        F.array("author1").alias("authors"),
        F.col("p_brand").alias("publisher"),
        "isbn",
        F.array(
            F.struct(
                F.lit("Kindle").alias("name"),
                F.concat(F.lit("https://www.amazon.co.jp/dp/B"), F.lpad(F.col("k").cast("string"), 9, "0")).alias("url"),
                F.lit("drm").alias("drm"),
            )
        ).alias("ebook_stores"),
    )
    # ISBNs with two-digit serials repeat, and so do their addresses: the first page counts.
    firsts = rows.groupBy("url").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "url"]), "title").alias("r"))
    return as_books(firsts.select("url", "r.*"))


@stored
def secondary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = book_rows(spark, sf_dir).where("k % 9 = 0").groupBy("isbn").agg(F.min("k").alias("k"))
    return rows.select(
        "isbn",
        F.concat(F.lit("Secondary "), F.col("k").cast("string")).alias("title"),
        F.array(F.lit("Calvin")).alias("authors"),
        F.concat(F.lit("https://secondary.example.com/book/"), "isbn").alias("url"),
    )


ROBOTS_TEXT = "User-agent: *\nDisallow: /book/1\nAllow: /book/11\n"


def shop_robots(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("https://gihyo.jp", ROBOTS_TEXT)], "origin string, content string")


def sql_key(x: str) -> str:
    """Match key in SQL, for the texts these views contain."""
    ignored = (" " + IGNORED).replace("'", "''")
    return f"translate(lower(translate({x}, 'Ｖｏｌ．　', 'Vol. ')), '{ignored}', '')"


def sql_edition(key: str) -> str:
    return f"regexp_replace({key}, '第[0-9]+[版刷]|新版', '', 'g')"


def sql_contain(a: str, b: str) -> str:
    return (
        f"(CASE WHEN {a} IS NULL OR {b} IS NULL OR {a} = '' OR {b} = '' THEN 0::DOUBLE WHEN {a} = {b} THEN 1::DOUBLE "
        f"WHEN contains({b}, {a}) THEN 0.5::DOUBLE + 0.5::DOUBLE * (length({a})::DOUBLE / length({b})::DOUBLE) "
        f"WHEN contains({a}, {b}) THEN 0.5::DOUBLE + 0.5::DOUBLE * (length({b})::DOUBLE / length({a})::DOUBLE) "
        f"ELSE 0::DOUBLE END)"
    )


def sql_round3(x: str) -> str:
    return f"(floor(({x}) * 1000::DOUBLE + 0.5::DOUBLE) / 1000::DOUBLE)"


def with_views(body: str, *extra: str) -> str:
    """SQL with the shared views in front."""
    return "WITH " + ",\n".join([BOOK.strip(), *[e.strip() for e in extra]]) + "\n" + body.strip()


__all__ = [
    "BOOK", "CLUES", "batches", "book_rows", "catalog", "clue_rows", "isbn_codes", "page_books",
    "secondary", "shop_robots", "sources", "spread", "sql_contain", "sql_edition", "sql_key", "sql_round3", "with_views",
]
