"""E-book stores, store identifiers and copy protection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# URL pattern, URL pattern that must not match, store name, protection.
# The first matching line wins.
STORES = [
    ("techbookfest\\.org/product/", None, "技術書典", "free"),
    ("oreilly\\.co\\.jp/books/", None, "オライリー・ジャパン", "free"),
    ("shop\\.rutles\\.net/", None, "ラトルズ", "free"),
    ("peaks\\.cc/books/", None, "PEAKS", "free"),
    ("optronics-ebook\\.com/products/", None, "オプトロニクス社", "free"),
    ("pragprog\\.com/titles/", None, "Pragmatic Bookshelf", "free"),
    ("gihyo\\.jp/dp/ebook/", None, "Gihyo Digital Publishing", "social"),
    ("seshop\\.com/product/", None, "SEshop", "social"),
    ("book-tech\\.com/books/", None, "BOOK TECH", "social"),
    ("wgn-obs\\.shop-pro\\.jp/\\?pid=", None, "ボーンデジタル", "social"),
    ("cc\\.cqpub\\.co\\.jp/lib/system/doclib_item/", None, "CQ出版 Tech Village", "social"),
    ("book\\.mynavi\\.jp/manatee/", None, "マナティ", "social"),
    ("www\\.lambdanote\\.com/products/", None, "ラムダノート", "social"),
    ("tatsu-zine\\.com/books/", "tatsu-zine\\.com/books/pub/", "達人出版会", "social"),
    ("book\\.impress\\.co\\.jp/books/", None, "インプレスブックス", "social"),
    ("saiensu\\.co\\.jp", None, "サイエンス社", "password_pdf"),
    ("amazon\\.co\\.jp", None, "Kindle", "drm"),
    ("kinokuniya\\.co\\.jp/(?:kinoppystore|f/dsg-08)", None, "Kinoppy", "drm"),
    ("coop-ebook\\.jp/mem/", None, "VarsityWave eBooks", "drm"),
    ("books\\.rakuten\\.co\\.jp|rakuten\\.kobo\\.com|kobo\\.com", None, "楽天Kobo", "drm"),
    ("booklive\\.jp", None, "BookLive", "drm"),
    ("honto\\.jp", None, "honto", "drm"),
    ("bookwalker\\.jp", None, "BOOK☆WALKER", "drm"),
    ("ebookjapan\\.yahoo\\.co\\.jp", None, "eBookJapan", "drm"),
    ("store\\.line\\.me", None, "LINEマンガ", "drm"),
]
# Display label of each protection code.
DRM_LABELS = {
    "free": "DRMフリー",
    "social": "DRMフリー (ソーシャル)",
    "password_pdf": "パスワード付きPDF",
    "drm": "DRM付き",
}
ASIN_PATTERN = "amazon\\.co\\.jp/(?:dp|gp/product|o/ASIN)/([A-Z0-9]{10})"


def classify_store(url: Column) -> Column:
    """struct(name, drm) of the first store pattern in the URL; unknown stores are null."""
    out = None
    for pattern, unless, name, drm in STORES:
        hit = url.rlike(pattern)
        if unless is not None:
            hit = hit & ~url.rlike(unless)
        store = F.struct(F.lit(name).alias("name"), F.lit(drm).alias("drm"))
        out = F.when(hit, store) if out is None else out.when(hit, store)
    return out


def _prefer_kindle(asins: Column) -> Column:
    kindle = F.get(F.filter(asins, lambda a: a.startswith("B")), F.lit(0))
    return F.coalesce(kindle, F.get(asins, F.lit(0)))


def extract_asin(text: Column) -> Column:
    """Store identifier in a text: one starting with B if there is any, else the first."""
    return _prefer_kindle(F.regexp_extract_all(text, F.lit(ASIN_PATTERN), F.lit(1)))


def asin_from_stores(stores: Column) -> Column:
    """Same choice over the links of an ebook_stores array."""
    asins = F.transform(stores, lambda s: extract_asin(s["url"]))
    return _prefer_kindle(F.filter(asins, lambda a: a.isNotNull()))


def drm_from_text(c: Column) -> Column:
    return (
        F.when(c.rlike("(?i)ソーシャルDRM"), "social")
        .when(c.rlike("(?i)DRM-?free|DRMフリー"), "free")
        .when(c.rlike("(?i)パスワード"), "password_pdf")
        .otherwise("social")
    )


def drm_label(c: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in DRM_LABELS.items() for x in kv]), c)
