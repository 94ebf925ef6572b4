"""URL columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLIT = "^([a-zA-Z][a-zA-Z0-9+.-]*:)//([^/?#]*)([^?#]*)"


def origin(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _SPLIT, 2))


def path_and_query(url: Column) -> Column:
    """What robots rules are matched against; an empty path counts as "/"."""
    rest = F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^#]*)", 1)
    return F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))


def force_https(url: Column) -> Column:
    return F.regexp_replace(url, "^http://", "https://")


def _without_dots(path: Column) -> Column:
    """Resolve "." and ".." segments of an absolute path."""
    segments = F.split(path, "/")
    keep = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc))
        .otherwise(F.concat(acc, F.array(s))),
    )
    tail = F.when(path.rlike("/\\.{1,2}$"), "/").otherwise("")
    return F.concat(F.array_join(keep, "/"), tail)


def resolve_url(base: Column, ref: Column) -> Column:
    """Absolute URL of a link found on `base`."""
    scheme = F.regexp_extract(base, _SPLIT, 1)
    site = F.concat(scheme, F.lit("//"), F.regexp_extract(base, _SPLIT, 2))
    raw = F.regexp_extract(base, _SPLIT, 3)
    base_path = F.when(raw == "", F.lit("/")).otherwise(raw)
    folder = F.regexp_extract(base_path, "^(.*/)", 1)
    target = F.when(ref.startswith("/"), ref).otherwise(F.concat(folder, ref))
    t_path = F.regexp_extract(target, "^[^?#]*", 0)
    t_rest = F.substring(target, F.length(t_path) + 1, F.length(target))
    t_clean = F.when(t_path.rlike("(^|/)\\.{1,2}(/|$)"), _without_dots(t_path)).otherwise(t_path)
    bare_host = ref.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+$")
    return (
        F.when(bare_host, F.concat(ref, F.lit("/")))
        .when(ref.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), ref)
        .when(ref.startswith("//"), F.concat(scheme, ref))
        .when(ref == "", F.regexp_extract(base, "^[^#]*", 0))
        .when(ref.startswith("#"), F.concat(F.regexp_extract(base, "^[^#]*", 0), ref))
        .when(ref.startswith("?"), F.concat(site, base_path, ref))
        .otherwise(F.concat(site, t_clean, t_rest))
    )
