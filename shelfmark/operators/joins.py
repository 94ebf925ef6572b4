"""Joins of URLs, ISBNs and clues with sources, robots rules and books."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import host, origin, path_and_query
from ..storage import materialize
from .ranking import first_match


def url_source_join(urls: DataFrame, registry: DataFrame) -> DataFrame:
    """Each URL with the source whose base URL it starts with; null when there is none.

    The registry, a fixed few dozen rows, is folded to one row per host with its base URLs in
    registry order, so that the lookup is one broadcast join and URLs are not shuffled.
    """
    bases = (
        registry.groupBy(host(F.col("base_url")).alias("__host"))
        .agg(F.array_sort(F.collect_list(F.struct("ordinal", "base_url", "source_id"))).alias("__bases"))
    )
    owner = F.get(F.filter("__bases", lambda b: F.startswith(F.col("url"), b["base_url"])), F.lit(0))
    return (
        urls.withColumn("__host", host(F.col("url")))
        .join(F.broadcast(bases), "__host", "left")
        .withColumn("source_id", owner["source_id"])
        .drop("__host", "__bases")
    )


def isbn_source_join(isbns: DataFrame, codes: DataFrame, column: str = "isbn") -> DataFrame:
    """Each ISBN with the source its publisher code belongs to; null when there is none."""
    # No code is a prefix of another, so at most one of the four lengths matches. The code
    # table is fixed and tiny.
    cut = F.when(F.col(column).startswith("9784"), F.substring(column, 5, 6))
    out = isbns.withColumn("__cut", cut)
    found = None
    for n in range(3, 7):
        part = codes.where(F.length("code") == n).select(
            F.col("code").alias(f"__c{n}"), F.col("source_id").alias(f"__s{n}")
        )
        out = out.join(F.broadcast(part), F.substring("__cut", 1, n) == F.col(f"__c{n}"), "left")
        found = F.col(f"__s{n}") if found is None else F.coalesce(found, F.col(f"__s{n}"))
    return out.select(*isbns.columns, found.alias("source_id"))


def robots_rules(robots: DataFrame, agent: str) -> DataFrame:
    """(origin, ordinal, allow, path) of the section that applies to `agent`.

    `robots(origin, content)`, one file per origin. Runs of user-agent lines open a section; a
    blank line, or a user-agent line after a rule, closes it; comment lines do neither.
    """
    lines = robots.select(
        F.lower("origin").alias("origin"), F.posexplode(F.split("content", "\\r?\\n")).alias("n", "raw")
    ).withColumn("raw", F.trim("raw"))
    body = F.trim(F.substring_index("raw", "#", 1))
    parsed = lines.where(~F.col("raw").startswith("#")).select(
        "origin",
        "n",
        F.when(F.col("raw") == "", "blank")
        .when(F.contains(body, F.lit(":")), F.lower(F.trim(F.substring_index(body, ":", 1))))
        .alias("key"),
        F.trim(F.substring(body, F.instr(body, ":") + 1, F.length(body))).alias("value"),
    ).where("key in ('blank', 'user-agent', 'allow', 'disallow')")
    w = Window.partitionBy("origin").orderBy("n")
    starts = (F.col("key") == "user-agent") & (F.coalesce(F.lag("key").over(w), F.lit("blank")) != "user-agent")
    opened = (
        parsed.withColumn("starts", starts.cast("int"))
        .withColumn("section", F.sum("starts").over(w))
        # Rules after a blank line belong to no section until an agent line opens one.
        .withColumn("blanks", F.sum((F.col("key") == "blank").cast("int")).over(w))
    )
    agents = (
        opened.where("key = 'user-agent'")
        .groupBy("origin", "section")
        .agg(
            F.max((F.lower("value") == agent.lower()).cast("int")).alias("own"),
            F.max((F.col("value") == "*").cast("int")).alias("any"),
            F.max("blanks").alias("blanks"),
        )
    )
    chosen = (
        agents.where("own = 1 or any = 1")
        .groupBy("origin")
        .agg(F.min_by(F.struct("section", "blanks"), F.struct(-F.col("own"), F.col("section"))).alias("s"))
        .select("origin", "s.section", "s.blanks")
    )
    return (
        opened.where("key in ('allow', 'disallow') and value != ''")
        .join(chosen, ["origin", "section", "blanks"])
        .select(
            "origin",
            F.col("n").alias("ordinal"),
            (F.col("key") == "allow").alias("allow"),
            F.col("value").alias("path"),
        )
    )


#: URLs of one origin that meet its rules in one task, and parts that URLs without origin are dealt to.
SPLIT, LOST = 100_000, 1_000


def robots_join(urls: DataFrame, rules: DataFrame, registry: DataFrame | None = None, split: int = SPLIT) -> DataFrame:
    """`urls(url, …)` with `allowed`: longest matching path decides, ties go to the earlier rule.

    URLs without a rules file or a matching rule are allowed. Rules are folded to one row per
    origin, which is no more than the one file they came from, so that each URL meets one row.
    With `registry` only the origins of registered sources count; those few are broadcast. Without
    it, origins are counted first: the URLs of one with more than `split` of them are dealt to parts,
    and its rules copied to each.
    """
    per_origin = rules.groupBy(F.col("origin").alias("__origin")).agg(
        F.array_sort(
            F.collect_list(F.struct((-F.length("path")).alias("n"), "ordinal", "path", "allow"))
        ).alias("__rules")
    )
    located = urls.withColumn("__origin", origin(F.col("url"))).withColumn("__path", path_and_query(F.col("url")))
    first = F.get(F.filter("__rules", lambda r: F.startswith(F.col("__path"), r["path"])), F.lit(0))
    if registry is not None:
        known = registry.select(origin(F.col("base_url")).alias("__origin")).distinct()
        met = located.join(F.broadcast(per_origin.join(F.broadcast(known), "__origin", "left_semi")), "__origin", "left")
    else:
        counted = located.groupBy("__origin").count().where(F.col("count") > split)
        # Fewer rows than all URLs divided by `split`.
        crowded = materialize(counted.join(per_origin, "__origin", "left_semi").select("__origin", F.ceil(F.col("count") / split).cast("int").alias("__of")))
        of, own = F.coalesce("__of", F.lit(1)), F.xxhash64(F.monotonically_increasing_id())
        part = F.when(F.col("__origin").isNull(), F.pmod(own, F.lit(LOST))).otherwise(F.pmod(own, of)).cast("int")
        dealt = located.join(F.broadcast(crowded), "__origin", "left").withColumn("__part", part).drop("__of")
        copied = per_origin.join(F.broadcast(crowded), "__origin", "left").select(
            "__origin", "__rules", F.explode(F.sequence(F.lit(0), of - 1)).alias("__part")
        )
        met = dealt.join(copied, ["__origin", "__part"], "left").drop("__part")
    return met.withColumn("allowed", F.coalesce(first["allow"], F.lit(True))).drop("__origin", "__path", "__rules")


def robots_filter(urls: DataFrame, rules: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    return robots_join(urls, rules, registry).where("allowed").drop("allowed")


def detail_urls(isbns: DataFrame, registry: DataFrame, codes: DataFrame) -> DataFrame:
    """(isbn, source_id, url) for ISBNs whose source has a detail URL template."""
    templates = registry.where("detail_url_template is not null").select("source_id", "detail_url_template")
    return (
        isbn_source_join(isbns, codes)
        .join(F.broadcast(templates), "source_id")
        .select("isbn", "source_id", F.replace("detail_url_template", F.lit("{isbn}"), F.col("isbn")).alias("url"))
    )


def detail_by_isbn_template(
    isbns: DataFrame, registry: DataFrame, codes: DataFrame, page_books: DataFrame
) -> DataFrame:
    """Book rows of the detail pages the ISBNs point at."""
    right = page_books.drop("source_id", "isbn")
    return detail_urls(isbns, registry, codes).join(right, "url")


def secondary_lookup(isbns: DataFrame, secondary: DataFrame) -> DataFrame:
    """Left join with the fallback bibliography."""
    return isbns.join(secondary, "isbn", "left")


def unresolved_anti(clues: DataFrame, resolved: DataFrame, key: str = "clue_id") -> tuple[DataFrame, DataFrame]:
    """Clues the ISBN path left open: those with a title or author, and those with neither."""
    rest = clues.join(resolved.select(key), key, "left_anti")
    has_text = F.col("title").isNotNull() | F.col("author").isNotNull()
    return rest.where(has_text), rest.where(~has_text)


def first_row_fallback(isbns: DataFrame, listing: DataFrame, strict: bool = False) -> DataFrame:
    """For each ISBN the listed row with that ISBN, else the first row of its keyword listing.

    `listing(keyword, position, isbn, …)`: what a source lists for a keyword. The fallback may be
    another book; `strict` leaves it out. The listed row's own ISBN is in `found.isbn`.
    """
    rows = listing.withColumn("__other", ~F.coalesce(F.col("isbn") == F.col("keyword"), F.lit(False)))
    if strict:
        rows = rows.where(~F.col("__other"))
    best = first_match(rows, ["keyword"], F.col("__other"), F.col("position"))
    cols = [c for c in listing.columns if c != "keyword"]
    found = best.select(F.col("keyword").alias("isbn"), F.struct(*cols).alias("found"))
    return isbns.select("isbn").join(found, "isbn")
