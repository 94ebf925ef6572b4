"""Author columns: splitting, roles, display names, contributors, de-duplication."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, collapse_ws, is_ascii, match_keys, trim_blanks

# Separators by style of the source.
SEPARATORS = {
    "bibliography": "[/／、,，]",
    "full": "[、，,／/・]",
    "comma": "[、，,]",
    "vendor": "[,、/／]",
    "newline": "[、,\n]",
    "listed": "[,，、・]",
    "english": "(?i)\\s*,\\s*|\\s+with\\s+|\\s+and\\s+",
    "english_and": "(?i)\\s*,\\s*|\\s+and\\s+",
    "blank": f"{WS}+(?={WS}*[^\\s\\u3000])",
    "wide_blank": "\\u3000",
    "ideographic": "[、，]",
    "comma_blank": "[,、]\\s*",
}
# Role words that may follow a name.
ROLE_WORDS = "著|訳|編|監修|監訳|著訳|著・訳|他"
# Contributor role codes; all others count as author.
ROLE_CODES = {
    "A01": "author",
    "B06": "translator",
    "B01": "editor",
    "B21": "editor",
    "B13": "supervisor",
}


def strip_role_word(c: Column) -> Column:
    """Remove one role word at the end, with the blanks around it."""
    return trim_blanks(F.regexp_replace(c, f"{WS}*({ROLE_WORDS}){WS}*$", ""))


def strip_trailing_parens(c: Column) -> Column:
    return trim_blanks(F.regexp_replace(c, f"{WS}*[（(][^)）]*[)）]{WS}*$", ""))


def strip_brackets(c: Column, style: str) -> Column:
    """Remove bracketed role or affiliation anywhere: round, wide (both widths) or square."""
    pattern = {"round": "\\(.*?\\)", "wide": "[(（].*?[)）]", "square": "\\[.*?\\]"}[style]
    return F.regexp_replace(c, pattern, "")


def strip_colon_role(c: Column) -> Column:
    return F.regexp_replace(c, ":.*$", "")


def split_authors(c: Column, style: str, clean=None) -> Column:
    """Names of a text, trimmed, optionally cleaned one by one, empty ones dropped."""
    names = F.transform(F.split(c, SEPARATORS[style]), trim_blanks)
    if style.startswith("english"):
        names = F.transform(names, lambda n: trim_blanks(F.regexp_replace(n, "(?i)^(?:and|with)\\s+", "")))
    if clean is not None:
        names = F.transform(names, lambda n: trim_blanks(clean(n)))
    return F.filter(names, lambda n: n != "")


def format_person_name(c: Column) -> Column:
    """Library heading "Last, First, years" to a display name."""
    name = trim_blanks(c)
    parts = F.split(name, f",{WS}*")
    last, first = parts[0], F.get(parts, F.lit(1))
    swapped = is_ascii(F.concat(last, first)) & (F.concat(last, first) != "")
    return (
        F.when(F.size(parts) < 2, collapse_ws(name))
        .when(swapped, F.concat_ws(" ", first, last))
        .otherwise(F.concat_ws(" ", last, first))
    )


def contributors(entries: Column) -> Column:
    """Role-typed names in sequence order; null when there is none.

    `entries`: array<struct<SequenceNumber, ContributorRole: array, PersonName: struct<content>>>.
    """
    codes = F.create_map(*[F.lit(x) for kv in ROLE_CODES.items() for x in kv])

    def one(e: Column, i: Column) -> Column:
        code = F.get(F.filter(e["ContributorRole"], lambda r: r != ""), F.lit(0))
        return F.struct(
            F.coalesce(e["SequenceNumber"].try_cast("double"), F.lit(0.0)).alias("seq"),
            i.alias("idx"),
            format_person_name(F.coalesce(e["PersonName"]["content"], F.lit(""))).alias("name"),
            F.coalesce(F.element_at(codes, F.coalesce(code, F.lit("A01"))), F.lit("author")).alias("role"),
        )

    ordered = F.array_sort(F.transform(entries, one))
    named = F.filter(ordered, lambda e: e["name"] != "")
    out = F.transform(named, lambda e: F.struct(e["name"].alias("name"), e["role"].alias("role")))
    return F.when(F.size(out) > 0, out)


def dedupe_authors(c: Column) -> Column:
    """Ordered distinct names: equal match keys are one person, first spelling kept."""
    names = F.filter(F.transform(c, trim_blanks), lambda n: n != "")
    pairs = F.arrays_zip(names.alias("n"), match_keys(names).alias("k"))
    empty = F.array().cast("array<string>")
    folded = F.aggregate(
        pairs,
        F.struct(empty.alias("out"), empty.alias("seen")),
        lambda acc, p: F.when((p["k"] == "") | F.array_contains(acc["seen"], p["k"]), acc).otherwise(
            F.struct(
                F.concat(acc["out"], F.array(p["n"])).alias("out"),
                F.concat(acc["seen"], F.array(p["k"])).alias("seen"),
            )
        ),
    )
    return folded["out"]


def bibliography_authors(entries_contributors: Column, summary_author: Column) -> Column:
    """Contributor names if there are any, else the split summary text; de-duplicated."""
    from_text = split_authors(F.coalesce(summary_author, F.lit("")), "bibliography", strip_role_word)
    names = F.when(
        F.size(entries_contributors) > 0, F.transform(entries_contributors, lambda x: x["name"])
    ).otherwise(from_text)
    return dedupe_authors(names)
