"""Publication dates in the formats the sources use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How each format family writes year, month and day.
YMD_PATTERNS = {
    "kanji": "([0-9]{4})年([0-9]{1,2})月([0-9]{1,2})日",
    "slash": "([0-9]{4})/([0-9]{1,2})/([0-9]{1,2})",
    "slash_padded": "([0-9]{4})/([0-9]{2})/([0-9]{2})",
    "dot_padded": "([0-9]{4})\\.([0-9]{2})\\.([0-9]{2})",
    "dot": "^([0-9]{4})\\.([0-9]{1,2})\\.([0-9]{1,2})$",
    "iso": "([0-9]{4})-([0-9]{2})-([0-9]{2})",
}
KANJI_MONTH = "([0-9]{4})年([0-9]{1,2})月"
ENGLISH_MONTH = "Published:\\s*([A-Za-z]+)\\s+([0-9]{4})"
MONTHS = (
    "january february march april may june july august september october november december"
).split()


def _date(y: Column, m: Column, d: Column) -> Column:
    text = F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))
    return text.try_cast("date")


def _groups(c: Column, pattern: str, n: int) -> list[Column]:
    return [F.regexp_extract(c, pattern, i + 1) for i in range(n)]


def parse_date(c: Column, family: str) -> Column:
    """Date of a text in one format family; month precision becomes day 1, no match null.

    Besides `YMD_PATTERNS`: kanji_month, english_month, compact (YYYYMMDD or YYYYMM,
    a bare year is null) and volume (a bare year is January 1).
    """
    first = F.lit("01")
    if family in YMD_PATTERNS:
        return _date(*_groups(c, YMD_PATTERNS[family], 3))
    if family == "kanji_month":
        return _date(*_groups(c, KANJI_MONTH, 2), first)
    if family == "english_month":
        name, year = _groups(c, ENGLISH_MONTH, 2)
        names = F.array(*[F.lit(m) for m in MONTHS])
        month = F.array_position(names, F.lower(name))
        return F.when(month > 0, _date(year, month.cast("string"), first))
    if family == "compact":
        digits = F.regexp_replace(c, "[^0-9]", "")
        y, m = F.substring(digits, 1, 4), F.substring(digits, 5, 2)
        return F.when(F.length(digits) >= 8, _date(y, m, F.substring(digits, 7, 2))).when(
            F.length(digits) == 6, _date(y, m, first)
        )
    if family == "volume":
        parts = F.split(c, "-")
        y, m = parts[0], F.get(parts, F.lit(1))
        return (
            F.when(F.size(parts) >= 3, F.substring(c, 1, 10).try_cast("date"))
            .when(F.size(parts) == 2, _date(y, m, first))
            .otherwise(_date(y, first, first))
        )
    raise ValueError(f"unknown family: {family}")


def first_date(c: Column, *families: str) -> Column:
    return F.coalesce(*[parse_date(c, f) for f in families])
