"""The registered sources and the publisher codes inside their ISBNs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Id, name, base URL, default language, scale, detail URL template; in registry order.
SOURCES = [
    ("book-tech", "BOOK TECH", "https://book-tech.com", None, None, None),
    ("born-digital", "ボーンデジタル", "https://wgn-obs.shop-pro.jp", None, None, None),
    ("c-r", "C&R研究所", "https://www.c-r.com", None, None, None),
    ("coronasha", "コロナ社", "https://www.coronasha.co.jp", None, None, None),
    ("cq-publishing", "CQ出版社", "https://cc.cqpub.co.jp", None, None, None),
    ("gihyo", "技術評論社", "https://gihyo.jp", None, None, None),
    ("impress-books", "インプレスブックス", "https://book.impress.co.jp", None, None, None),
    ("ipa", "IPA（情報処理推進機構）", "https://www.ipa.go.jp", None, "minor", None),
    ("juse-p", "日科技連出版社", "https://www.juse-p.co.jp", None, None, None),
    ("lambdanote", "ラムダノート", "https://www.lambdanote.com", None, None, None),
    ("leanpub", "Leanpub", "https://leanpub.com", "en", None, None),
    ("manatee", "マナティ", "https://book.mynavi.jp/manatee", None, None, None),
    ("maruzen-publishing", "丸善出版", "https://www.maruzen-publishing.co.jp", None, None, None),
    ("optronics", "オプトロニクス社", "https://optronics-ebook.com", None, None, None),
    (
        "oreilly-japan",
        "オライリー・ジャパン",
        "https://www.oreilly.co.jp",
        None,
        "minor",
        "https://www.oreilly.co.jp/books/{isbn}/",
    ),
    ("peaks", "PEAKS", "https://peaks.cc", None, "minor", None),
    ("personal-media", "パーソナルメディア", "https://www.personal-media.co.jp", None, "minor", None),
    ("pragprog", "Pragmatic Bookshelf", "https://pragprog.com", "en", None, None),
    ("rutles", "ラトルズ", "https://shop.rutles.net", None, None, None),
    ("saiensu", "サイエンス社", "https://www.saiensu.co.jp", None, None, None),
    ("seshop", "SEshop (翔泳社)", "https://www.seshop.com", None, None, None),
    ("tatsu-zine", "達人出版会", "https://tatsu-zine.com", None, None, None),
    ("techbookfest", "技術書典オンラインマーケット", "https://techbookfest.org", None, None, None),
    ("google-books", "Google Books", "https://books.google.com", None, None, None),
]
# Publisher code after the prefix 9784, and the source it belongs to.
ISBN_CODES = [
    ("coronasha", "339"),
    ("maruzen-publishing", "621"),
    ("gihyo", "297"),
    ("saiensu", "7819"),
    ("seshop", "7981"),
    ("oreilly-japan", "8144"),
    ("oreilly-japan", "87311"),
    ("juse-p", "8171"),
    ("impress-books", "8443"),
    ("born-digital", "86246"),
    ("personal-media", "89362"),
    ("rutles", "89977"),
    ("manatee", "8399"),
    ("lambdanote", "908686"),
    ("optronics", "902312"),
]
# Fixed value: language of rows whose source names none.
DEFAULT_LANGUAGE = "ja"


def sources(spark: SparkSession) -> DataFrame:
    """The registry as a table; `ordinal` is the registry order."""
    rows = [(*s, i) for i, s in enumerate(SOURCES)]
    return spark.createDataFrame(
        rows,
        "source_id string, name string, base_url string, language string, scale string, "
        "detail_url_template string, ordinal int",
    )


def isbn_codes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ISBN_CODES, "source_id string, code string")


def list_sources(registry: DataFrame) -> DataFrame:
    return registry.select("ordinal", "source_id", "name", "base_url")


def catalog_by_source(registry: DataFrame, books: DataFrame) -> DataFrame:
    """Registry listing with the number of catalog rows of each source."""
    counts = books.groupBy("source_id").agg(F.count("*").alias("n_books"))
    listed = list_sources(registry).join(counts, "source_id", "left")
    return listed.withColumn("n_books", F.coalesce("n_books", F.lit(0)))
