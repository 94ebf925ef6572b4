"""Raw pages: bodies, links, meta tags, embedded JSON, key-value blocks, paging, linked pages."""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import parse_price
from ..functions.people import split_authors
from ..functions.stores import classify_store
from ..functions.dates import parse_date
from ..functions.isbn import extract_isbn
from ..functions.text import decode_entities, empty_to_null, strip_html, trim_blanks
from ..operators.ranking import first_match
from ..operators.summary import max_page

# A tag's attributes, in which a quoted value may hold anything; a value, quoted or bare.
_BEFORE_HREF = "(?:[^>\"'\\s]++|\\s(?!href\\s*=)|\"[^\"]*+\"|'[^']*+')*+"
_VALUE = "(\"[^\"]*\"|'[^']*'|[^\\s>\"']+)"
LINK = f"(?is)<a(?=[\\s/]){_BEFORE_HREF}\\shref\\s*=\\s*{_VALUE}"
META = "(?is)<meta\\s(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>"
#: Parts of a page whose tags are no elements of it.
UNSEEN = "(?is)<!--.*?-->|<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>"
CHARSET = "(?i)charset=[\"']?([^;\"'\\s]+)"


def read_pages(pages: DataFrame) -> DataFrame:
    """Fetched pages (`url, html, status`): only those answered with 200."""
    return pages.where("status = 200").drop("status")


#: Bodies that are decoded at a time.
BODIES = 128


def _decode(body: bytes | None, charset: str | None) -> str | None:
    if body is None:
        return None
    if body[:2] == b"\x1f\x8b":
        try:
            body = gzip.decompress(body)
        except (OSError, EOFError, zlib.error):
            return None
    try:
        return body.decode(charset or "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def decode_bodies(df: DataFrame) -> DataFrame:
    """`df(url, body, content_type)` with `html`: gunzipped if packed, decoded by its charset.

    A charset that is missing or unknown counts as UTF-8; a broken gzip body gives null and says so in
    `error`, which is null for all other rows. A worker holds a few bodies as Python objects at a time,
    however many rows a batch has.
    """
    charset = empty_to_null(F.lower(F.regexp_extract(F.coalesce("content_type", F.lit("")), CHARSET, 1)))
    rest = [c for c in df.columns if c not in ("body", "content_type", "html", "error")]
    keep = df.select(*rest, F.col("body").isNotNull().alias("__had"), "body", charset.alias("__charset"))
    names = [*rest, "__had", "html"]
    schema = keep.select(*rest, "__had", F.col("__charset").alias("html")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BODIES):
                part = batch.slice(at, BODIES)
                body, own = part.column(len(rest) + 1).to_pylist(), part.column(len(rest) + 2).to_pylist()
                html = pa.array([_decode(b, c) for b, c in zip(body, own)], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(rest) + 1], html], names=names)

    broken = F.col("__had") & F.col("html").isNull()
    decoded = keep.mapInArrow(run, schema)
    return decoded.select(*rest, "html", F.when(broken, "broken gzip body").alias("error"))


def page_links(pages: DataFrame, html: str = "html") -> DataFrame:
    """Every link of a page in document order, as (…, pos, href)."""
    keep = [c for c in pages.columns if c != html]
    links = F.transform(F.regexp_extract_all(_seen(F.col(html)), F.lit(LINK), F.lit(1)), _bare_value)
    return pages.select(*keep, F.posexplode(links).alias("pos", "href"))


def _seen(html: Column) -> Column:
    return F.regexp_replace(html, UNSEEN, "")


def _bare_value(c: Column) -> Column:
    """An attribute's value without its quotes, with entities decoded."""
    return decode_entities(F.regexp_replace(c, "^([\"'])(.*)\\1$", "$2"))


def extract_stores(links: DataFrame, key: str) -> DataFrame:
    """(key, ebook_stores): the first link of each known store, in document order.

    At most one link per known store is left before the list of a page is gathered.
    """
    named = links.withColumn("s", classify_store(F.col("href"))).where("s is not null")
    named = named.select(key, "pos", "href", F.col("s.name").alias("name"), F.col("s.drm").alias("drm"))
    firsts = first_match(named, [key, "name"], F.col("pos"))
    rows = F.array_sort(F.collect_list(F.struct("pos", "name", F.col("href").alias("url"), "drm")))
    return firsts.groupBy(key).agg(rows.alias("r")).select(
        key,
        F.transform(
            "r", lambda x: F.struct(x["name"].alias("name"), x["url"].alias("url"), x["drm"].alias("drm"))
        ).alias("ebook_stores"),
    )


def first_wins(entries: Column) -> Column:
    """Map of array<struct<key, value>>; the first value of a key counts."""
    numbered = F.array_sort(F.transform(entries, lambda e, i: F.struct(e["key"].alias("key"), i.alias("i"), e["value"].alias("value"))))
    # Sorted by key and place, the first row of a key differs from the row before it.
    firsts = F.transform(
        F.array(numbered),
        lambda rows: F.filter(rows, lambda e, i: (i == 0) | ~F.get(rows, i - 1)["key"].eqNullSafe(e["key"])),
    )[0]
    ordered = F.array_sort(F.transform(firsts, lambda e: F.struct(e["i"].alias("i"), e["key"].alias("key"), e["value"].alias("value"))))
    return F.map_from_entries(F.transform(ordered, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))))


def last_wins(entries: Column) -> Column:
    """Same, but a later value of a key replaces an earlier one."""
    return first_wins(F.reverse(entries))


def _attr(tag: Column, name: str) -> Column:
    return _bare_value(F.regexp_extract(tag, f"(?is)\\s{name}\\s*=\\s*{_VALUE}", 1))


def meta_tags(html: Column) -> Column:
    """Map of <meta> name or property to content, and "title" to the page title."""
    html = _seen(html)
    tags = F.regexp_extract_all(html, F.lit(META), F.lit(0))
    entries = F.transform(
        tags,
        lambda t: F.struct(
            F.coalesce(empty_to_null(_attr(t, "property")), empty_to_null(_attr(t, "name"))).alias("key"),
            _attr(t, "content").alias("value"),
        ),
    )
    title = F.struct(
        F.lit("title").alias("key"), F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1).alias("value")
    )
    return first_wins(F.filter(F.concat(F.array(title), entries), lambda e: e["key"].isNotNull()))


def embedded_json(html: Column, pattern: str, schema: str) -> Column:
    """Struct parsed from the JSON the pattern's first group finds; null when absent or broken."""
    return F.from_json(empty_to_null(F.regexp_extract(html, pattern, 1)), schema)


def kv_tags(html: Column) -> Column:
    """Map of dt/dd or th/td pairs in order; a later key replaces an earlier one."""

    def texts(tags: str) -> Column:
        # A cell ends at its end tag or, where that is missing, at the next cell.
        pattern = f"(?is)<(?:{tags})(?:\\s[^>]*)?>(.*?)(?=</?(?:dt|dd|dl|th|td|tr|table)\\b|$)"
        found = F.regexp_extract_all(html, F.lit(pattern), F.lit(1))
        return F.transform(found, lambda x: trim_blanks(strip_html(x)))

    pairs = F.arrays_zip(texts("dt|th").alias("key"), texts("dd|td").alias("value"))
    return last_wins(F.filter(pairs, lambda p: (p["key"] != "") & p["value"].isNotNull()))


def kv_entries(text: Column) -> Column:
    """array<struct<key, value>> of the "key：value" or tab-separated lines, in order."""
    cut = "\\t|："
    lines = F.transform(F.split(text, "\\r?\\n"), trim_blanks)
    parts = F.transform(lines, lambda x: F.struct(trim_blanks(F.split(x, cut, 2)[0]).alias("key"), trim_blanks(F.get(F.split(x, cut, 2), F.lit(1))).alias("value")))
    return F.filter(parts, lambda e: (e["key"] != "") & (e["value"] != ""))


def kv_lines(text: Column) -> Column:
    """Map of "key：value" or tab-separated lines; a later key replaces an earlier one."""
    return last_wins(kv_entries(text))


# Words that end an author line.
AUTHOR_LINE = "^(.+?)\\s+(?:著者|著|監修|編著|編集|編|訳|監訳|共著|共編|翻訳)$"


def line_classifier(text: Column) -> Column:
    """struct(authors, isbn, published_at, price) from the lines of a free text.

    Each line belongs to the first class it fits: author line, ISBN, release month, list price.
    Authors of all lines add up, of the others the first hit counts.
    """
    lines = F.filter(F.transform(F.split(text, "[\\n\\r]+"), trim_blanks), lambda x: x != "")

    def kind(x: Column) -> Column:
        return (
            F.when(x.rlike(AUTHOR_LINE), "author")
            .when(F.contains(x, F.lit("ISBN")), "isbn")
            .when(F.contains(x, F.lit("発売")), "month")
            .when(x.startswith("定価"), "price")
        )

    def of(k: str) -> Column:
        return F.filter(lines, lambda x: kind(x) == k)

    authors = F.flatten(
        F.transform(of("author"), lambda x: split_authors(F.regexp_extract(x, AUTHOR_LINE, 1), "listed"))
    )
    first = lambda values: F.get(F.filter(values, lambda x: x.isNotNull()), F.lit(0))
    return F.struct(
        authors.alias("authors"),
        first(F.transform(of("isbn"), lambda x: extract_isbn(x, "digit_led"))).alias("isbn"),
        first(F.transform(of("month"), lambda x: parse_date(x, "kanji_month"))).alias("published_at"),
        first(F.transform(of("price"), parse_price)).alias("price"),
    )


def paginated_union(pages: DataFrame) -> DataFrame:
    """Rows of all pages of a listing, in page order.

    `pages(listing, page_no, links, items)`: the pager links of page 1 tell the last page; pages
    beyond it are ignored. `position` grows with page and item, so that no listing has to be
    sorted in one place.
    """
    last = pages.where("page_no = 1").select("listing", max_page(F.col("links")).alias("last_page"))
    wanted = pages.join(last, "listing").where("page_no between 1 and last_page")
    return wanted.select("listing", "page_no", F.posexplode("items").alias("i", "item")).withColumn(
        "position", F.shiftleft(F.col("page_no").cast("bigint"), 32) + F.col("i")
    )


def expand_folders(links: DataFrame) -> DataFrame:
    """Books of a two-level catalog: the index page's own links, then those of its folder pages.

    `links(page_url, pos, title, url, is_folder, is_index)`. Only one level is opened, a URL is
    kept once, where it comes first; a folder that could not be read adds nothing.
    """
    top = links.where("is_index").select("page_url", "pos", "title", "url", "is_folder")
    own = top.where("not is_folder").select(
        F.col("page_url").alias("catalog"), F.lit(0).alias("level"), F.lit(0).alias("folder_pos"), "pos", "title", "url"
    )
    inner = links.where("not is_folder").select(
        F.col("page_url").alias("folder"), F.col("pos").alias("pos"), "title", "url"
    )
    folders = top.where("is_folder").select(
        F.col("page_url").alias("catalog"), F.col("url").alias("folder"), F.col("pos").alias("folder_pos")
    )
    below = folders.join(inner, "folder").select(
        "catalog", F.lit(1).alias("level"), "folder_pos", "pos", "title", "url"
    )
    order = [F.col("level"), F.col("folder_pos"), F.col("pos")]
    return first_match(own.unionByName(below), ["catalog", "url"], *order)


def follow_link(books: DataFrame, linked: DataFrame, url_col: str) -> DataFrame:
    """Complete rows from a linked page; a page that was not fetched changes nothing.

    `linked(linked_url, authors, isbn, asin, description, ebook_stores)`, one row per URL. Authors
    are replaced when the page names any; the other columns are filled only where missing.
    """
    filled = ["isbn", "asin", "description", "ebook_stores"]
    right = linked.select(
        F.col("linked_url").alias("__url"), *[F.col(c).alias(f"__{c}") for c in ["authors", *filled]]
    )
    # Rows without a link get a key that matches nothing and spreads them.
    key = F.coalesce(F.col(url_col), F.concat(F.lit("no link "), F.col("position").cast("string")))
    joined = books.withColumn("__key", key).join(right, F.col("__key") == F.col("__url"), "left")
    new = {
        "authors": F.when(F.size("__authors") > 0, F.col("__authors")).otherwise(F.col("authors")),
        **{c: F.coalesce(c, f"__{c}") for c in filled},
    }
    return joined.select(*[new.get(c, F.col(c)).alias(c) for c in books.columns])
