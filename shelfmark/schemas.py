"""Schemas of the tables that flow through the jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTRIBUTORS = "array<struct<name:string,role:string>>"
STORES = "array<struct<name:string,url:string,drm:string>>"

# One row per book of one source; `position` is the order in which the source lists it.
BOOK = {
    "source_id": "string",
    "position": "bigint",
    "title": "string",
    "subtitle": "string",
    "alternative_title": "string",
    "authors": "array<string>",
    "contributors": CONTRIBUTORS,
    "publisher": "string",
    "published_at": "date",
    "language": "string",
    "isbn": "string",
    "asin": "string",
    "url": "string",
    "price": "decimal(12,2)",
    "currency": "string",
    "cover_image_url": "string",
    "description": "string",
    "tags": "array<string>",
    "ebook_stores": STORES,
}

# Nested bibliography entry (library record), keyed by the ISBN that was asked for.
BIB_ENTRY = (
    "struct<summary:struct<isbn:string,title:string,publisher:string,pubdate:string,"
    "cover:string,author:string>,"
    "hanmoto:map<string,string>,"
    "onix:struct<"
    "DescriptiveDetail:struct<Contributor:array<struct<SequenceNumber:string,"
    "ContributorRole:array<string>,PersonName:struct<content:string,collationkey:string>>>>,"
    "CollateralDetail:struct<TextContent:array<struct<TextType:string,ContentAudience:string,"
    "Text:string>>>,"
    "ProductSupply:struct<SupplyDetail:struct<Price:array<struct<PriceType:string,"
    "PriceAmount:string,CurrencyCode:string>>>>>>"
)
KEYED_CATALOG = (
    "struct<list:map<string,struct<series:string,title:string,subtitle:string,"
    "author:map<string,map<string,string>>,price:array<bigint>,release:array<string>,"
    "url:string,cover:array<string>>>>"
)
VOLUMES = (
    "struct<totalItems:bigint,items:array<struct<id:string,volumeInfo:struct<title:string,"
    "authors:array<string>,publisher:string,publishedDate:string,description:string,"
    "language:string,industryIdentifiers:array<struct<type:string,identifier:string>>,"
    "imageLinks:struct<thumbnail:string,smallThumbnail:string>,infoLink:string>,"
    "saleInfo:struct<listPrice:struct<amount:double,currencyCode:string>>>>>"
)
INDEX = (
    "struct<results:array<struct<record_type:string,href:string,title:string,subtitle:string,"
    "author:string,keywords:array<string>,code:string,image:string>>>"
)
EDGES = (
    "struct<data:struct<searchProducts:struct<edges:array<struct<node:struct<product:struct<"
    "id:string,databaseID:string,name:string,description:string,organization:struct<name:string>,"
    "coverImage:struct<url:string>,ebookVariant:struct<price:bigint>,firstPublishedAt:string,"
    "status:string>>>>>>>"
)


def as_books(df: DataFrame, *keep: str) -> DataFrame:
    """Bring a frame to the book schema: missing columns null, types fixed, `keep` carried."""
    have = set(df.columns)
    cols = [
        (F.col(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in BOOK.items()
    ]
    return df.select(*[k for k in keep if k not in BOOK], *cols)
