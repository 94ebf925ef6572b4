"""Text columns: whitespace, titles, match keys, edition folding, markup."""

from __future__ import annotations

from unicodedata import normalize

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# The code points treated as white space by the matching rules.
BLANKS = "\t\n\x0b\x0c\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + (
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
WS = "[\\t-\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"

# Characters that do not count when two texts are compared.
IGNORED = (
    "【】〔〕「」『』《》[](){}（）｛｝<>＜＞、。，．・,.:;：；!！?？~〜～-－—―ー_/\\|=+*'\"`"
)

# Edition marks, in match order.
EDITION_MARKS = (
    "第[0-9一二三四五六七八九十百]+[版刷]|増補改訂版|改訂新版|改訂版|増補版|新装版|普及版|新版"
)

_ASCII = "^[\\x00-\\x7F]*$"


def _composed(values) -> list:
    return [None if v is None else normalize("NFKC", v) for v in values]


def _nfkc(values: pa.Array) -> pa.Array:
    return pa.array(_composed(values.to_pylist()), pa.string())


def _nfkc_items(lists: pa.Array) -> pa.Array:
    rows = [None if row is None else _composed(row) for row in lists.to_pylist()]
    return pa.array(rows, pa.list_(pa.string()))


def is_ascii(c: Column) -> Column:
    return c.rlike(_ASCII)


def nfkc(c: Column) -> Column:
    """NFKC form. Only values with non-ASCII characters are sent to Python."""
    udf = F.arrow_udf(_nfkc, StringType())
    return F.coalesce(udf(F.when(~is_ascii(c), c)), c)


def nfkc_items(c: Column) -> Column:
    """NFKC form of every element; all-ASCII arrays stay in the JVM."""
    udf = F.arrow_udf(_nfkc_items, ArrayType(StringType()))
    return F.coalesce(udf(F.when(F.exists(c, lambda x: ~is_ascii(x)), c)), c)


def trim_blanks(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def collapse_ws(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, f"{WS}+", " "))


def empty_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def drop_ignored(c: Column) -> Column:
    """Lower-case an NFKC text and delete the characters that do not count."""
    return F.translate(F.lower(c), BLANKS + IGNORED, "")


def match_key(c: Column) -> Column:
    """Key under which two spellings of one text are equal."""
    return drop_ignored(nfkc(c))


def match_keys(c: Column) -> Column:
    """`match_key` of every element of an array."""
    return F.transform(nfkc_items(c), drop_ignored)


def token_keys(c: Column) -> Column:
    """Blank-separated tokens of a text as match keys, empty ones dropped, repeats kept."""
    return F.filter(match_keys(F.split(c, f"{WS}+")), lambda t: t != "")


def strip_edition(key: Column) -> Column:
    return F.regexp_replace(key, EDITION_MARKS, "")


def has_edition(key: Column) -> Column:
    return strip_edition(key) != key


def bibliographic_title(raw: Column) -> Column:
    """Split "main = parallel : subtitle" into struct(title, subtitle, alternative_title)."""
    text = collapse_ws(raw)
    cut = F.split(text, " : ", 2)
    left = F.trim(cut[0])
    cut_left = F.split(left, " = ", 2)
    return F.struct(
        F.trim(cut_left[0]).alias("title"),
        empty_to_null(F.trim(F.get(cut, F.lit(1)))).alias("subtitle"),
        empty_to_null(F.trim(F.get(cut_left, F.lit(1)))).alias("alternative_title"),
    )


def strip_format_marks(c: Column) -> Column:
    """Remove trailing bracketed format marks such as 【…版】, however many."""
    return F.trim(F.regexp_replace(c, f"({WS}*【[^】]*版】{WS}*)+$", ""))


def join_title_lines(c: Column) -> Column:
    """One line from several: trimmed, blank lines and whole-line 【…】 marks dropped."""
    lines = F.transform(F.split(c, "\\r?\\n"), trim_blanks)
    kept = F.filter(lines, lambda x: (x != "") & ~x.rlike("^【[^】]*】$"))
    return F.array_join(kept, " ")


def strip_outer_quotes(c: Column) -> Column:
    return F.regexp_replace(c, "^[『「]|[』」]$", "")


def strip_site_name(c: Column, pattern: str) -> Column:
    """Remove a site's fixed prefix or suffix from a page title."""
    return trim_blanks(F.regexp_replace(c, pattern, ""))


def title_with_parts(main: Column, sub: Column, lead: Column | None = None) -> Column:
    """Compose "lead main ―sub", leaving out the missing parts."""
    composed = F.concat(
        trim_blanks(main), F.when(F.coalesce(sub, F.lit("")) != "", F.concat(F.lit(" ―"), sub)).otherwise("")
    )
    return composed if lead is None else F.concat_ws(" ", empty_to_null(trim_blanks(lead)), composed)


def strip_html(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", "")


# Named characters; the ampersand comes last, so that nothing is decoded twice.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#39;": "'", "&nbsp;": "\u00a0", "&amp;": "&"}


def decode_entities(c: Column) -> Column:
    for name, char in ENTITIES.items():
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def html_block_text(c: Column) -> Column:
    """Markup to text, keeping line breaks as newlines and &nbsp; as a blank."""
    return F.replace(strip_html(F.regexp_replace(c, "(?i)<br\\s*/?>", "\n")), F.lit("&nbsp;"), F.lit(" "))
