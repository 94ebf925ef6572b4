"""Book rows from extracted fields: every conversion is a column expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, isbn, money, people, stores
from ..functions.text import (
    collapse_ws,
    empty_to_null,
    join_title_lines,
    strip_format_marks,
    strip_outer_quotes,
    strip_site_name,
    title_with_parts,
    trim_blanks,
)
from ..functions.urls import resolve_url
from ..schemas import as_books
from . import rulesets as R
from .pages import kv_entries, kv_lines, line_classifier
from .registry import SOURCES

SHOP_JSON = "struct<product:struct<sales_price_including_tax:bigint,model_number:string>>"
VENDOR_JSON = "struct<vendor:string>"
# Fixed value: where a cover's address names its book.
COVER_SLUG = "cloudfront\\.net/([^/]+)/s_featured"


def _field(name: str) -> Column:
    """First text of a field."""
    return F.get(_all(name), F.lit(0))


def _all(name: str) -> Column:
    return F.try_element_at(F.col("fields"), F.lit(name))


def _by_op(column: str, readers: dict[str, Column], usual: Column) -> Column:
    """The reading each source asks for in `OPS`, else the usual one."""
    out = None
    for op in sorted(set(R.OPS[column].values())):
        named = [s for s, o in R.OPS[column].items() if o == op]
        hit = F.col("source_id").isin(*[s for s in named if "/" not in s])
        for source, kind in (s.split("/") for s in named if "/" in s):
            hit = hit | ((F.col("source_id") == source) & (F.col("page_kind") == kind))
        out = F.when(hit, readers[op]) if out is None else out.when(hit, readers[op])
    return out.otherwise(usual)


def _lookup(values: dict[str, str], default: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, F.col("source_id")), default)


def _labelled(label: str) -> Column:
    return empty_to_null(trim_blanks(F.regexp_extract(_field("meta"), f"{label}[：:]\\s*([^\\n<]+)", 1)))


def _title() -> Column:
    raw = _field("title")
    site = None
    for source, pattern in R.SITE_NAMES.items():
        cut = strip_site_name(raw, pattern)
        site = F.when(F.col("source_id") == source, cut) if site is None else site.when(F.col("source_id") == source, cut)
    sub = trim_blanks(F.regexp_replace(_field("sub"), "^[\\s\\u3000―-]+", ""))
    return _by_op(
        "title",
        {
            "marks": strip_format_marks(raw),
            "lines": join_title_lines(raw),
            "quotes": F.coalesce(_field("clean_title"), strip_outer_quotes(raw)),
            "site": site,
            "parts": title_with_parts(raw, sub, F.coalesce(_field("lead"), F.lit(""))),
        },
        collapse_ws(raw),
    )


def _authors() -> Column:
    text, role = _field("authors"), people.strip_role_word
    each = lambda clean: F.filter(F.transform(_all("authors"), clean), lambda n: n != "")
    each_of = lambda name, clean: F.filter(F.transform(_all(name), lambda n: trim_blanks(clean(n))), lambda n: n != "")
    split = people.split_authors
    keyed = F.filter("kv_rows", lambda e: e["key"].isin("著者", "著", "翻訳", "翻訳者", "訳者", "訳"))
    wide = lambda n: role(people.strip_brackets(n, "wide"))
    # The first item that is neither price, ISBN, size nor stock.
    listed = F.filter(_all("items"), lambda x: ~x.rlike("^(定価|ISBN|[A-Z][0-9]／)|在庫|品切"))
    named = F.filter(
        F.transform(listed, lambda x: split(x, "ideographic", lambda n: people.strip_brackets(n, "square"))), lambda names: F.size(names) > 0
    )
    return _by_op(
        "authors",
        {
            "parens": each(people.strip_trailing_parens),
            "no_comma": each(lambda n: F.regexp_replace(n, ",\\s*$", "")),
            "round_role": each(lambda n: role(people.strip_brackets(n, "round"))),
            "blank_role": F.flatten(F.transform(F.coalesce(_all("authors"), F.array(text)), lambda n: split(n, "blank", role))),
            "labelled_full": split(_labelled("著者"), "full", role),
            "labelled": split(_labelled("著者"), "newline"),
            "labelled_wide": split(
                _labelled("著者"), "wide_blank", lambda n: people.strip_colon_role(people.strip_brackets(n, "round"))
            ),
            "vendor_wide": F.coalesce(each_of("author_links", wide), split(text, "bibliography", wide)),
            "vendor": split(F.from_json(_field("vendor_json"), VENDOR_JSON)["vendor"], "vendor"),
            "newline": split(text, "newline"),
            "english": split(F.regexp_replace(text, "(?i)^by\\s+", ""), "english"),
            "english_and": split(text, "english_and"),
            "comma_role": split(text, "newline", role),
            "comma_parens": split(text, "comma_blank", people.strip_trailing_parens),
            "keys": F.flatten(F.transform(keyed, lambda e: split(e["value"], "comma"))),
            "items": F.get(named, F.lit(0)),
            "lines": F.col("by_line.authors"),
        },
        _all("authors"),
    )


def _date() -> Column:
    text = _field("date")
    return _by_op(
        "date",
        {
            **{f: dates.parse_date(text, f) for f in ("slash_padded", "kanji", "iso", "english_month", "dot_padded")},
            "iso_or_dots": dates.first_date(text, "iso", "slash", "kanji"),
            "slash_or_kanji": dates.first_date(text, "slash", "kanji", "kanji_month"),
            "labelled": dates.parse_date(_labelled("発売日"), "kanji"),
            "keys": dates.parse_date(F.try_element_at(F.col("kv"), F.lit("発売日")), "kanji"),
            "lines": F.col("by_line.published_at"),
        },
        dates.parse_date(text, "slash"),
    )


def _price() -> Column:
    text = _field("price")
    usual = money.parse_price(text)
    listed = _labelled("価格")
    shop = F.col("shop")["product"]["sales_price_including_tax"]
    first_item = F.get(F.filter(_all("items"), lambda x: x.startswith("定価")), F.lit(0))
    readers = {
        "net_mark": money.tax_inclusive(money.parse_price(listed), listed, "mark"),
        "net_label": money.tax_inclusive(usual, text, "label"),
        "usd": money.parse_usd(text),
        "usd_number": text.try_cast("decimal(12,2)"),
        "shop": F.coalesce(shop, usual),
        "items": money.parse_price(first_item),
        "lines": F.col("by_line.price"),
        "yen": money.parse_yen_price(text),
    }
    return _by_op("price", {k: c.cast("decimal(12,2)") for k, c in readers.items()}, usual.cast("decimal(12,2)"))


def _isbn() -> Column:
    text = _field("isbn")
    bare = empty_to_null(F.regexp_replace(text, "[-\\s]", ""))
    item = F.get(F.filter(_all("items"), lambda x: x.startswith("ISBN")), F.lit(0))
    return _by_op(
        "isbn",
        {
            "labelled": isbn.extract_isbn(_field("meta"), "labelled"),
            "bare": bare,
            "url_book": F.coalesce(bare, empty_to_null(F.regexp_extract("url", "/book/([^/?#]+)", 1))),
            "any": isbn.extract_isbn(text, "any"),
            "items": isbn.extract_isbn(item, "digit_run"),
            "page": isbn.extract_isbn(_field("page_text"), "prefixed"),
            "image_name": isbn.extract_isbn(text, "image_name"),
            "lines": F.col("by_line.isbn"),
            "shop": empty_to_null(F.replace(F.col("shop")["product"]["model_number"], F.lit("-"), F.lit(""))),
            "digit_run": isbn.extract_isbn(text, "digit_run"),
            "plain": isbn.extract_isbn(text, "plain"),
        },
        bare,
    )


def _publisher() -> Column:
    text = _field("publisher")
    own = _lookup(R.PUBLISHERS, _lookup({s[0]: s[1] for s in SOURCES}, F.lit("")))
    company = F.try_element_at(F.filter("kv_rows", lambda e: e["key"].startswith("発行") | (e["key"] == "発売")), F.lit(-1))["value"]
    return F.coalesce(
        _by_op(
            "publisher",
            {
                "issued": trim_blanks(F.regexp_replace(text, "^発行[：:]", "")),
                "labelled": empty_to_null(trim_blanks(F.regexp_replace(_labelled("発行"), "[㈱㈲]", ""))),
                "keys": trim_blanks(F.regexp_replace(company, "^株式会社\\s*|\\s*株式会社$", "")),
            },
            text,
        ),
        own,
    )


def _link_store(links: Column, part: str, name: str, drm: str) -> Column:
    href = F.get(F.filter(links, lambda h: F.contains(h, F.lit(part))), F.lit(0))
    store = F.struct(F.lit(name).alias("name"), resolve_url(F.col("url"), href).alias("url"), F.lit(drm).alias("drm"))
    return F.when(href.isNotNull(), store)


def _stores(url: Column) -> Column:
    """Own store of the source, then the stores its page links name, each once."""
    kind = "struct<name:string,url:string,drm:string>"
    own_name = _lookup({s: n for s, (n, _) in R.OWN_STORE.items()}, F.lit(None))
    own_drm = _lookup({s: d for s, (_, d) in R.OWN_STORE.items()}, F.lit(None))
    own = F.when(
        own_name.isNotNull(), F.array(F.struct(own_name.alias("name"), url.alias("url"), own_drm.alias("drm")))
    ).otherwise(F.array().cast(f"array<{kind}>"))
    skip = _lookup({s: x for s, x in R.LINKED_STORES.items() if x}, F.lit("\u0000"))
    found = F.transform(
        F.filter(F.coalesce(_all("links"), F.array().cast("array<string>")), lambda h: ~F.contains(h, skip)),
        lambda h: F.struct(
            stores.classify_store(h)["name"].alias("name"), h.alias("url"), stores.classify_store(h)["drm"].alias("drm")
        ),
    )
    linked = F.when(F.col("source_id").isin(*R.LINKED_STORES), F.filter(found, lambda s: s["name"].isNotNull()))
    links = F.coalesce(_all("links"), F.array().cast("array<string>"))
    told = F.array().cast(f"array<{kind}>")
    for source, stores_of in R.LINK_STORES.items():
        named = [_link_store(links, *s) for s in stores_of]
        told = F.when(F.col("source_id") == source, F.array_compact(F.array(*named))).otherwise(told)
    every = F.concat(own, told, F.coalesce(linked, F.array().cast(f"array<{kind}>")))
    once = F.aggregate(
        every,
        F.array().cast(f"array<{kind}>"),
        lambda acc, s: F.when(F.exists(acc, lambda x: x["name"] == s["name"]), acc).otherwise(F.concat(acc, F.array(s))),
    )
    return F.when(F.size(once) > 0, once)


def folder_pages(extracted: DataFrame) -> DataFrame:
    """(page_url, url): the folders that list pages of `ipa` name, each a list page of its own."""
    links = extracted.where("error is null and source_id = 'ipa' and page_kind = 'list'").select(
        F.col("url").alias("page_url"), F.explode(_all("folder")).alias("href")
    )
    return links.select("page_url", resolve_url(F.col("page_url"), F.col("href")).alias("url")).distinct()


def books_from_fields(extracted: DataFrame, registry: DataFrame) -> DataFrame:
    """Book rows of list and detail pages, keyed by `page_url`; items without title or link are dropped.

    Pages that failed are in `extracted` with an `error` and give no row here.
    """
    base = registry.select("source_id", F.col("base_url").alias("__base"), F.col("language").alias("__language"))
    rows = (
        extracted.where("error is null")
        .join(F.broadcast(base), "source_id", "left")
        # The parts several columns are read from, made once.
        .withColumns(
            {
                "kv": kv_lines(F.coalesce(_field("meta"), F.lit(""))),
                "kv_rows": kv_entries(F.coalesce(_field("meta"), F.lit(""))),
                "by_line": line_classifier(F.coalesce(_field("lines"), F.lit(""))),
                "shop": F.from_json(_field("shop_json"), SHOP_JSON),
            }
        )
    )
    detail = F.col("page_kind") == "detail"
    # Two sources write links relative to the page, the others relative to the site.
    root = F.when(F.col("source_id").isin("ipa", "personal-media") | F.col("__base").isNull(), F.col("url")).otherwise(
        F.col("__base")
    )
    slug = empty_to_null(F.regexp_extract(_field("cover"), COVER_SLUG, 1))
    link = F.when(F.col("source_id") == "leanpub", F.concat(F.col("__base"), F.lit("/"), slug)).otherwise(
        resolve_url(root, _field("url"))
    )
    # The link that leads to the book itself and has a text.
    own_link = F.concat(F.lit("/"), slug, F.lit("\n"))
    linked_title = F.split(F.get(F.filter(_all("linked"), lambda x: x.startswith(own_link)), F.lit(0)), "\n", 2)[1]
    picture = F.when(
        (F.col("source_id") == "oreilly-japan") & ~detail,
        F.concat(F.col("__base"), F.lit("/books/images/picture_large"), _field("isbn"), F.lit(".jpeg")),
    ).otherwise(resolve_url(root, _field("cover")))
    notice = lambda t: t.startswith("本ページの情報") | F.contains(t, F.lit("本事業は終了"))
    description = F.when(
        F.col("source_id") == "ipa", F.get(F.filter(_all("description"), lambda t: ~notice(t)), F.lit(0))
    ).otherwise(strip_site_name(_field("description"), "^＜翔泳社の公式通販＞\\s*[｜|]\\s*"))
    one = (F.col("source_id") != "c-r") | detail | (F.size(_all("title")) == 1)
    # Folders are lists of their own, see `folder_pages`; a row of column heads is no book.
    entry = detail | ((F.col("source_id") != "ipa") | _field("folder").isNull()) & (
        (F.col("source_id") != "personal-media") | _field("heads").isNull() & F.contains(_field("url"), F.lit("/book/"))
    )
    required = (F.col("source_id") != "ipa") | ~detail | _field("required").isNotNull()
    books = rows.where(one & required & entry).select(
        F.col("url").alias("page_url"),
        "page_kind",
        "source_id",
        "position",
        F.when(detail, F.col("url")).otherwise(link).alias("url"),
        F.when((F.col("source_id") == "leanpub") & ~detail, linked_title).otherwise(_title()).alias("title"),
        F.coalesce(_authors(), F.array().cast("array<string>")).alias("authors"),
        _publisher().alias("publisher"),
        _date().alias("published_at"),
        F.col("__language").alias("language"),
        _isbn().alias("isbn"),
        _price().alias("price"),
        picture.alias("cover_image_url"),
        stores.extract_asin(F.array_join(_all("asin"), " ")).alias("page_asin"),
        description.alias("description"),
        stores.drm_from_text(_field("guide")).alias("guide_drm"),
        _field("buy").alias("buy_url"),
        # Kept for `media_filter`.
        _field("media").alias("media"),
        _field("category").alias("category"),
        _all("statuses").alias("statuses"),
        F.get(_all("more"), F.lit(0)).alias("more_url"),
        "fields",
    )
    dollars = F.col("source_id").isin("pragprog", "leanpub") & F.col("price").isNotNull()
    full = books.withColumn("currency", F.when(dollars, "USD")).withColumn(
        "ebook_stores", _stores(F.col("url"))
    ).withColumn(
        # One source sells through a button whose guide text tells the protection.
        "ebook_stores",
        F.when(
            F.col("buy_url").isNotNull(),
            F.array(F.struct(F.lit("インプレスブックス").alias("name"), F.col("url").alias("url"), F.col("guide_drm").alias("drm"))),
        ).otherwise(F.col("ebook_stores")),
    ).withColumn("asin", F.coalesce("page_asin", stores.asin_from_stores(F.col("ebook_stores")))).where("title != '' and url != ''")
    return as_books(full, "page_url", "page_kind", "media", "category", "statuses", "more_url")
